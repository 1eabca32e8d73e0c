import zlib

import pytest

from chronolith.llm import sharding


def best_capacity(sizes, k):
    """By trying every capacity upward."""
    c = max(max(sizes), -(-sum(sizes) // k))
    while True:
        n, at = 1, 0
        for s in sizes:
            if at + s > c:
                n, at = n + 1, 0
            at += s
        if n <= k:
            return c
        c += 1


@pytest.mark.parametrize("k", [1, 3, 7])
def test_capacity_is_smallest(spark, docs, k):
    groups = sharding.profile(docs).groupBy("digest").agg({"size": "sum"}).withColumnRenamed("sum(size)", "bytes")
    order = sharding.Order(groups)
    sizes = [r["bytes"] for r in sorted(groups.collect(), key=lambda r: r["digest"])]
    c = sharding.smallest_capacity(order, k, max(sizes))
    assert c == best_capacity(sizes, k)
    assert len(sharding.cuts(order, k, c)) <= k - 1


def test_whole(spark, docs):
    rows = sharding.assign(docs, shards=5).collect()
    src = docs.select("doc_id", "text").collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in src)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(5))
    shard = {}
    for r in rows:
        assert shard.setdefault(r["text_crc32"], r["shard"]) == r["shard"]


def test_hot_group_alone(spark):
    df = spark.createDataFrame([(i, "hot" * 100) for i in range(50)] + [(100 + i, f"text {i}" * 20) for i in range(60)], "doc_id bigint, text string")
    rows = sharding.assign(df, shards=4).collect()
    hot = {r["shard"] for r in rows if r["doc_id"] < 100}
    rest = {}
    for r in rows:
        if r["doc_id"] >= 100:
            rest[r["shard"]] = rest.get(r["shard"], 0) + r["size"]
    assert len(hot) == 1 and not hot & set(rest) and len(rest) == 3 and max(rest.values()) < 1.2 * min(rest.values())


def test_empty(nothing):
    assert sharding.assign(nothing).count() == 0
