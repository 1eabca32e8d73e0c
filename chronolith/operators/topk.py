"""The most frequent keys of a time slot, ties at the last place included."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.functions.encoding import Axis, Instant, to_encoded


def _slot(df: DataFrame, t: str, start: Instant, end: Instant) -> DataFrame:
    axis = Axis(df, t)
    if to_encoded(start) == to_encoded(end):
        return df.filter(axis.equals(start))
    return df.filter(axis.at_least(start) & axis.below(end))


def _counts(slot: DataFrame, key: str, k: int) -> DataFrame:
    """(key, n, rank) for RANK() <= k, by the k-th largest count: no window over all keys."""
    if k <= 0:
        raise ValueError("k must be positive")
    n = slot.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    floor = n.orderBy(F.desc("n")).limit(k).agg(F.min("n").alias("__floor"))  # k rows at most
    top = n.join(F.broadcast(floor), F.col("n") >= F.col("__floor")).drop("__floor")
    # Ranks come from the distinct counts among the winners, each with how many keys hold it.
    steps = top.groupBy("n").agg(F.count(F.lit(1)).alias("__held"))  # k rows at most
    ranks = steps.select(
        "n", (F.sum("__held").over(Window.orderBy(F.desc("n"))) - F.col("__held") + 1).cast("int").alias("rank")
    )
    return top.join(F.broadcast(ranks), "n").select(key, "n", "rank")


def slot_topk_counts(df: DataFrame, key: str, t: str, start: Instant, end: Instant, k: int) -> DataFrame:
    """(key, n, rank) of the keys whose count in ``[start, end)`` ranks k-th or better; null keys don't count."""
    return _counts(_slot(df, t, start, end), key, k)


def slot_topk(
    df: DataFrame, key: str, t: str, start: Instant, end: Instant, k: int, order: tuple[str, ...] = ()
) -> DataFrame:
    """One whole row for each such key: its earliest, ties broken by ``order`` and then by the other columns that have an order."""
    slot = _slot(df, t, start, end)
    keys = _counts(slot, key, k).select(key)
    rest = [f.name for f in slot.schema if f.name not in (t, *order) and _ordered(f.dataType)]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in slot.columns]), F.struct(*[F.col(f"`{c}`") for c in (t, *order, *rest)])).alias("__first")
    rows = slot.join(keys, key, "left_semi").groupBy(key).agg(first)
    return rows.select(*[F.col("__first")[c].alias(c) for c in slot.columns])


def _ordered(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))
