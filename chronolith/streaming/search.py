"""Searches on streams.  Filters keep no state, so the batch verbs run as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions.encoding import Instant
from chronolith.operators.search import interval_find, range_find, temporal_find

__all__ = ["interval_find", "range_find", "slot_counts", "slot_topk", "temporal_find"]


def slot_counts(stream: DataFrame, key: str, t: str, slot: str, late: str, start: Instant | None = None, end: Instant | None = None) -> DataFrame:
    """Counts of each key in tumbling slots, with a watermark: the input of a top-k per slot."""
    if start is not None and end is not None:
        stream = range_find(stream, t, start, end)
    kept = stream.withWatermark(t, late).groupBy(F.window(t, slot), key).agg(F.count(F.lit(1)).alias("n"))
    return kept.select(F.col("window.start").alias("slot_start"), F.col("window.end").alias("slot_end"), key, "n")


def slot_topk(counts: DataFrame, key: str, k: int, write):
    """A writer that hands (slot, key, n, rank) of each finished slot's most frequent keys to ``write(frame, batch)``.

    ``counts`` are those of ``slot_counts``.  In append mode a slot is emitted once, whole, when the watermark
    passes it, so ranks within a batch are those of the slot; ties at the last place are included.
    """
    if k <= 0:
        raise ValueError("k must be positive")

    def ranked(batch: DataFrame, number: int) -> None:
        by = Window.partitionBy("slot_start").orderBy(F.desc("n"))
        write(batch.filter(F.col(key).isNotNull()).withColumn("rank", F.rank().over(by)).filter(F.col("rank") <= k), number)

    return counts.writeStream.outputMode("append").foreachBatch(ranked)
