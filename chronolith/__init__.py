"""Chronolith: temporal search, windowed extremes and slot top-k on Spark DataFrames."""

from chronolith.functions.encoding import decode, encode, period_bucket
from chronolith.operators.search import full_scan, in_time, interval_find, range_find, temporal_find
from chronolith.operators.topk import slot_topk, slot_topk_counts
from chronolith.operators.window_ops import window_max, window_mean, window_min
from chronolith.plans.engine import Engine, TemporalFrame
from chronolith.sources.registry import IndexRegistry, IndexType

__all__ = [
    "Engine",
    "IndexRegistry",
    "IndexType",
    "TemporalFrame",
    "decode",
    "encode",
    "full_scan",
    "in_time",
    "interval_find",
    "period_bucket",
    "range_find",
    "slot_topk",
    "slot_topk_counts",
    "temporal_find",
    "window_max",
    "window_mean",
    "window_min",
]
