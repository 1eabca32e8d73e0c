"""Temporal searches.  All are plain predicates, so Parquet and cached batches prune by them.

Null keys never match.  A window whose start lies after its end is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.functions.encoding import Axis, Instant, to_encoded


def range_find(df: DataFrame, t: str, start: Instant, end: Instant) -> DataFrame:
    """Rows with ``start <= t <= end``, both ends included."""
    axis = Axis(df, t)
    return df.filter(axis.at_least(start) & axis.at_most(end))


def temporal_find(df: DataFrame, t: str | tuple[str, str] | list[str], at: Instant) -> DataFrame:
    """Rows at an instant; with two columns, rows whose closed interval holds it."""
    if isinstance(t, str):
        return df.filter(Axis(df, t).equals(at))
    st, ed = t
    return df.filter(Axis(df, st).at_most(at) & Axis(df, ed).at_least(at))


def interval_find(df: DataFrame, st: str, ed: str, start: Instant, end: Instant) -> DataFrame:
    """Rows whose interval meets the window: ``st < end AND ed >= start``.

    A window of one instant asks for the intervals that begin there; use
    ``temporal_find`` for those that hold it.
    """
    if to_encoded(start) == to_encoded(end):
        return df.filter(Axis(df, st).equals(start))
    return df.filter(Axis(df, st).below(end) & Axis(df, ed).at_least(start))


def in_time(df: DataFrame, c: str, low: int, high: int) -> DataFrame:
    """Rows whose column, read as a whole number, lies in ``[low, high]``; other text never matches."""
    return df.filter(F.expr(f"try_cast(`{c}` AS BIGINT)").between(low, high))


def full_scan(df: DataFrame) -> DataFrame:
    """Every row: a search without a predicate."""
    return df
