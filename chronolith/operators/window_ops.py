"""Row-returning extremes and means of a closed time window.

The extreme is one value found by a partial and a final hash aggregate; it meets
the window again in a one-row broadcast, so no row of the window is shuffled.
An empty window gives no rows; null values are ignored.

Floating means are compared exactly and whatever the order of summing: each
value is cut into ``PARTS`` whole numbers of ``BITS`` bits, counted from the
largest magnitude in the window, whose sums are exact.  What lies more than
``PARTS * BITS`` bits below the largest doesn't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.functions.encoding import Instant
from chronolith.operators.search import range_find

BITS, PARTS = 40, 4


def _against(window: DataFrame, bound: Column, keep) -> DataFrame:
    name = "__bound"
    while name in window.columns:
        name += "_"
    one = window.agg(bound.alias(name))  # a global aggregate: exactly one row, so the broadcast is of fixed size
    return window.join(F.broadcast(one), keep(F.col(name))).select(*[window[c] for c in window.columns])


def window_max(df: DataFrame, c: str, t: str, start: Instant, end: Instant) -> DataFrame:
    """All rows of the window that hold its largest ``c``."""
    w = range_find(df, t, start, end)
    return _against(w, F.max(w[c]), lambda b: w[c] == b)


def window_min(df: DataFrame, c: str, t: str, start: Instant, end: Instant) -> DataFrame:
    """All rows of the window that hold its smallest ``c``."""
    w = range_find(df, t, start, end)
    return _against(w, F.min(w[c]), lambda b: w[c] == b)


def window_mean(df: DataFrame, c: str, t: str, start: Instant, end: Instant) -> DataFrame:
    """Rows of the window with ``c`` at or above its mean.

    The mean of whole numbers is cut toward zero (``sum div count``); that of
    other numbers is exact.  With a NaN or infinite value in the window the mean
    is what IEEE sums give, and NaN counts as the largest value.
    """
    w = range_find(df, t, start, end)
    kind = w.schema[c].dataType
    if isinstance(kind, T.IntegralType):
        mean = F.call_function("div", F.sum(w[c].cast("bigint")), F.count(w[c]))
        return _against(w, mean, lambda b: w[c] >= b)
    if isinstance(kind, T.DecimalType):
        exact = w[c].cast(T.DecimalType(38, kind.scale))
        total = F.struct(F.sum(exact).alias("s"), F.count(exact).alias("n"))
        return _against(w, total, lambda b: exact * b["n"].cast("decimal(20,0)") >= b["s"])
    return _floating_mean(w, w[c].cast("double"))


def _parts(v: Column, top: Column) -> list[Column]:
    """Whole numbers q with v = sum of q[i] * 2 ^ (top - BITS * (i + 1)), toward zero."""
    out, rest = [], v
    for i in range(PARTS):
        scale = F.pow(F.lit(2.0), top - BITS * (i + 1))
        q = (rest / scale).cast("bigint")
        out.append(q)
        rest = rest - q.cast("double") * scale
    return out


def _floating_mean(w: DataFrame, v: Column) -> DataFrame:
    taken = set(w.columns)
    name = lambda x: next(n for n in (f"__{x}{'_' * k}" for k in range(len(taken) + 1)) if n not in taken)
    top, sums, own = name("top"), name("sums"), name("own")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    # The power of two above the largest magnitude; one more guards the logarithm's rounding.
    most = F.max(F.when(finite & (v != 0), F.floor(F.log2(F.abs(v))).cast("int"))) + 2
    least = F.lit(BITS * PARTS - 1074)  # the last part then counts the smallest numbers there are
    one = F.broadcast(w.agg(F.greatest(F.coalesce(most, F.lit(0)), least).alias(top)))  # one row
    each = w.crossJoin(one).select("*", v.alias(own))
    known = F.when(finite, F.array(*[q.cast("decimal(20,0)") for q in _parts(v, F.col(top))]))
    each = each.withColumn(sums, known)
    special = F.sum(F.when(~finite, v)).alias("odd")
    total = each.agg(F.struct(special, F.count(own).alias("n"), *[F.sum(F.get(sums, F.lit(i))).alias(f"q{i}") for i in range(PARTS)]).alias("s"))
    met = name("met")
    both = each.crossJoin(F.broadcast(total.withColumnRenamed("s", met)))  # one row
    carry: Column = F.lit(0).cast("decimal(38,0)")
    step = F.lit(1 << BITS).cast("decimal(38,0)")
    whole = lambda x: x.cast("decimal(38,0)")
    for i in range(PARTS - 1, -1, -1):
        d = whole(whole(F.get(sums, F.lit(i)) * F.col(met)["n"].cast("decimal(18,0)")) - whole(F.col(met)[f"q{i}"])) + carry
        carry = whole(d) if i == 0 else whole(F.call_function("div", whole(d) - F.pmod(whole(d), step), step))
    keep = F.when(F.col(met)["odd"].isNull(), carry >= 0).otherwise(F.col(own) >= F.col(met)["odd"])
    return both.filter(keep).select(*w.columns)
