"""Minimax contiguous partition of atomic groups into shards (DataFrame functions only).

Groups are equal texts, ordered by the SHA-256 of the text.  The smallest shard
capacity for which a greedy walk needs no more than the wanted shards is found
by binary search, and the order is cut there.

The walk needs prefix sums over all groups.  It gets them from a trie of digest
prefixes: 4,096 sums first, then sums one hex digit deeper, only for the few
nodes in which a cut can fall for a capacity that is still open.  What reaches
the driver is bounded by shards and digits, not by rows.

Groups that alone reach the mean of what is left get a shard of their own,
before the rest is cut: no order of the rest could make those shards smaller.

Null text counts as empty.  Repeated rows each take a slot.  An empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.store import saved

TOP_DIGITS = 3
DIGITS = 64


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(
        docs[id_col].alias("doc_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("digest"),
    )


class Order:
    """Byte sums of consecutive digest prefixes; ``groups`` has digest and bytes."""

    def __init__(self, groups: DataFrame):
        self.groups, self.nodes = groups, []
        self._put(self._sums(groups, TOP_DIGITS), [])

    def _sums(self, groups: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        by = groups.groupBy(F.substring("digest", 1, digits).alias("p")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        return [tuple(r) for r in by.collect()]

    def _put(self, more: list[tuple[str, int, int]], gone: list[str]) -> None:
        out = set(gone)
        self.nodes = sorted([x for x in self.nodes if x[0] not in out] + more)
        self.ends, at = [], 0
        for _, b, _ in self.nodes:
            at += b
            self.ends.append(at)
        self.total = at

    def refine(self, spans: list[tuple[int, int]]) -> bool:
        """One digit more for the nodes of several groups inside the spans."""
        hit: dict[int, set[str]] = {}
        for low, high in spans:
            for i in range(bisect_right(self.ends, low), len(self.nodes)):
                start = self.ends[i] - self.nodes[i][1]
                if start >= high:
                    break
                if self.nodes[i][2] > 1:
                    hit.setdefault(len(self.nodes[i][0]), set()).add(self.nodes[i][0])
        for digits, names in hit.items():
            if digits < DIGITS:
                inside = self.groups.filter(F.substring("digest", 1, digits).isin(sorted(names)))
                self._put(self._sums(inside, digits + 1), list(names))
        return bool(hit)

    def walk(self, capacity: int, shards: int, hopeful: bool, at: int = 0) -> list[int]:
        """Where each shard ends at the latest; inside a node of several groups, anywhere (hopeful) or nowhere."""
        out = []
        for _ in range(shards):
            i = bisect_right(self.ends, at + capacity)
            if i == len(self.nodes):
                at = self.total
            else:
                at = at + capacity if hopeful and self.nodes[i][2] > 1 else max(at, self.ends[i - 1] if i else 0)
            out.append(at)
        return out


def smallest_capacity(order: Order, shards: int, largest: int) -> int:
    low = max(largest, -(-order.total // shards)) - 1  # too small, or as good as that
    high = low + 1 + largest  # enough for any greedy walk
    while True:
        # the largest capacity known to fail, and the smallest known to do, at this resolution
        a, b = low, high
        while b - a > 1:
            m = (a + b) // 2
            a, b = (m, b) if order.walk(m, shards, True)[-1] < order.total else (a, m)
        low = a
        a, b = low, high
        while b - a > 1:
            m = (a + b) // 2
            a, b = (a, m) if order.walk(m, shards, False)[-1] >= order.total else (m, b)
        high = b
        if high - low <= 1:
            return high
        spans = list(zip(order.walk(low, shards, False), order.walk(high, shards, True), strict=True))
        if not order.refine([(x, y + 1) for x, y in spans]):
            return high


def cuts(order: Order, shards: int, capacity: int) -> list[str]:
    """The last digest of each shard but the last.

    Each cut falls next to an equal share of what is left, if that keeps to the
    capacity and leaves the rest able to; else as late as the capacity lets it.
    """
    at, out = 0, []
    for left in range(shards, 1, -1):
        i = bisect_right(order.ends, at + (order.total - at) // left)
        near = [order.ends[x] for x in (i - 1, i) if 0 <= x < len(order.ends) and at < order.ends[x] <= at + capacity]
        near.sort(key=lambda e: abs(e - at - (order.total - at) / left))
        fits = [e for e in near if order.walk(capacity, left - 1, False, e)[-1] >= order.total]
        at = fits[0] if fits else order.walk(capacity, 1, False, at)[0]
        if at >= order.total:
            break
        out.append(order.nodes[bisect_right(order.ends, at) - 1][0].ljust(DIGITS, "f"))
    return out


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row; equal texts share a shard."""
    rows = saved(profile(docs, id_col, text_col), "shard_rows")
    groups = saved(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard_groups")
    n_rows, total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    top = groups.orderBy(F.desc("bytes"), "digest").limit(shards + 1).collect()  # bounded by the shards
    alone: list[str] = []
    left, largest = total, 0
    for g in top:
        if shards - len(alone) > 1 and g["bytes"] * (shards - len(alone)) >= left:
            alone.append(g["digest"])
            left -= g["bytes"]
        else:
            largest = g["bytes"]
            break
    ends: list[str] = []
    if largest:
        order = Order(groups.filter(~F.col("digest").isin(alone)) if alone else groups)
        ends = cuts(order, shards - len(alone), smallest_capacity(order, shards - len(alone), largest))
    return numbered(rows.withColumn("shard", shard_of(alone, ends)), n_rows)


def shard_of(alone: list[str], ends: list[str]) -> Column:
    after = F.lit(len(alone))
    for e in ends:
        after = after + (F.col("digest") > e).cast("int")
    for i, d in enumerate(alone):
        after = F.when(F.col("digest") == d, F.lit(i)).otherwise(after)
    return after.cast("int")


def numbered(rows: DataFrame, n_rows: int) -> DataFrame:
    """Gapless slots from 0 in each shard, whatever its share of the rows.

    Rows are numbered in small parts of a shard, and each part begins where the
    counts of the parts before it end.
    """
    parts = max(256, n_rows // 50_000)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(parts)))
    counts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "size", "text_crc32")
    own = dealt.withColumn("rank", F.row_number().over(inside))
    joined = own.join(starts, (own["shard"] == starts["s"]) & (own["part"] == starts["p"]))
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).cast("bigint").alias("slot"))
