"""N-gram Jaccard join by T-occurrence search, exact.

A document's set holds its distinct word n-grams (hashed to 64 bits); a shorter
document has its whole sequence as the one member.  Two documents link when
their Jaccard similarity reaches the threshold, that is, when they share at
least T members.

1. Rows of equal sets are one class, a node, with the smallest id as
   representative.
2. Members are ordered rare before frequent.  Frequent ones, the long inverted
   lists, are counted over all classes: each batch counts exactly and reports
   what it saw ``least_seen`` times or more.  The order need only be the same
   everywhere; an inexact count changes no result.
3. A class can reach T with another only if they share a member among its first
   ``n - ceil(t n) + 1``.  Only these go to the inverted lists, and lists of one
   class are dropped.  A member dropped so may still lie behind the prefix of a
   longer class; what the listed ones bound is the overlap of two prefixes.
4. Each list is merged around its member that can share most (a star); the links
   found join most of a group of near copies.  For members of different
   components all pairs of the lists are counted, and those that reach the
   number of shared members that T needs within the prefixes are candidates.
5. Each query meets its candidates in blocks of at most ``BLOCK``, so that its
   text travels once for each block and a query with very many is spread over
   tasks.  A block is searched by DivideSkip: inverted lists of the query's
   members over the block; the longest lists are set aside, the short ones merged
   by a heap, and documents that reached ``T - L`` are sought in the long lists by
   binary search.

Steps 3 and 4 lose no link between different components, so the components are
exact.

Rules: null and empty texts, and texts of white space, have no set and link with
nothing.  Ids are whole numbers; a null id links with nothing.  Repeated rows are
one.  Where an id has several texts with words, each is a node, and the id joins
them: what one reaches the others reach; a row without words stays by itself.  ``one_of_each`` judges texts and not ids: of each
group of linked texts the one with the smallest id stays, the first by digest
among ties, and no other text goes with a repeated id.  Texts of any length are
read whole.  An empty table gives none.  ``one_of_each`` returns all columns as
they are, whatever their names.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.components import components
from chronolith.llm.store import SPACES, discard, dropped, released, saved, scratch, small_batches, whole_id

FACTORS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))

#: Candidates that a query meets at once.
BLOCK = 512


def member_hashes(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    m = len(w) - n + 1
    h = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        x = w[i : i + m] * FACTORS[i % len(FACTORS)] + np.uint64(i)
        h = (h ^ (x ^ (x >> np.uint64(29)))) * FACTORS[0]
        h ^= h >> np.uint64(32)
    return np.unique(h)


def needed(a: int, b: int, percent: int) -> int:
    """The least overlap of sets of these sizes at the threshold: percent / 100 of the union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def divide_skip(query: np.ndarray, others: list[np.ndarray], need: list[int], mu: float = 0.01) -> list[bool]:
    """Which candidates share ``need`` members or more with the query.

    Lists of candidates by member of the query; L of the longest are put aside,
    so many that the heap merge and the binary searches cost about the same.
    """
    k = len(others)
    sizes = [len(o) for o in others]
    tokens = np.concatenate(others)
    doc = np.repeat(np.arange(k), sizes)
    at = np.minimum(np.searchsorted(query, tokens), len(query) - 1)
    hit = query[at] == tokens
    at, doc = at[hit], doc[hit]
    order = np.argsort(at, kind="stable")  # by member; candidates stay in order inside a list
    doc = doc[order]
    lengths = np.bincount(at, minlength=len(query))
    ends = np.cumsum(lengths)
    lists = sorted((ends[i] - lengths[i], ends[i]) for i in np.flatnonzero(lengths))
    lists.sort(key=lambda s: s[0] - s[1])  # the longest first
    least = min(need)
    longest = lists[0][1] - lists[0][0] if lists else 1
    aside = min(max(0, least - 1), int(least / (mu * np.log2(longest) + 1)), len(lists))
    long, short = [doc[a:b] for a, b in lists[:aside]], [doc[a:b].tolist() for a, b in lists[aside:]]
    counts = [0] * k
    for d, run in groupby(heapq.merge(*short)):
        counts[d] = sum(1 for _ in run)
    maybe = np.array([d for d in range(k) if counts[d] >= need[d] - aside], dtype=np.int64)
    total = np.array(counts)
    for own in long:
        p = np.minimum(np.searchsorted(own, maybe), len(own) - 1)
        total[maybe] += own[p] == maybe
    return [bool(total[d] >= need[d]) for d in range(k)]


def _sizes(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, th, n_members, digest) of every row; th is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [member_hashes(t.as_py(), n) for t in b.column(2)]
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary())], names=["doc_id", "th", "n_members", "digest"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id bigint, th bigint, n_members bigint, digest binary")


def frequent_members(texts: DataFrame, n: int, least_seen: int, most: int) -> np.ndarray:
    """Hashes of the most frequent members, at most ``most``: they come last in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [member_hashes(t.as_py(), n) for t in b.column(1)]
            h, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            often = c >= least_seen
            yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(c[often].astype(np.int64))], names=["h", "c"])

    seen = texts.mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    top = seen.orderBy(F.desc("c"), "h").limit(most).select("h").toPandas()
    return np.sort(top["h"].to_numpy(dtype=np.int64).view(np.uint64))


def _entries(texts: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(member, doc, n, long): the first members of each class in the common order."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)  # at most ``most`` hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for b in batches:
            members, docs, sizes, longs = [], [], [], []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = member_hashes(t.as_py(), n)
                if not len(s):
                    continue
                p = prefix_length(len(s), percent)
                if len(often):
                    known = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
                else:
                    known = np.zeros(len(s), dtype=bool)
                first = np.concatenate([s[~known], s[known]])[:p]
                members.append(first)
                docs.append(np.full(len(first), doc, dtype=np.int64))
                sizes.append(np.full(len(first), len(s), dtype=np.int32))
                longs.append(np.arange(len(first)) >= len(s) - known.sum())
            if members:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(members).view(np.int64)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(longs))],
                    names=["member", "doc", "n", "long"],
                )

    return texts.mapInArrow(run, "member bigint, doc bigint, n int, long boolean")


def _shared_only(entries: DataFrame) -> DataFrame:
    """Entries of rare members that another class has too: neighbours in sorted partitions, nothing held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None  # the last row, not yet decided unless its member came before
        joined = False
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column(0).to_numpy(zero_copy_only=False)
            same = m[1:] == m[:-1]
            before = kept is not None and kept.column(0)[0].as_py() == m[0]
            keep = np.concatenate([[before], same]) | np.concatenate([same, [False]])
            if kept is not None and (joined or before):
                yield kept
            kept, joined = b.slice(b.num_rows - 1), bool(keep[-1])
            yield b.slice(0, b.num_rows - 1).filter(pa.array(keep[:-1]))
        if kept is not None and joined:
            yield kept

    dealt = entries.repartition("member").sortWithinPartitions("member")
    return dealt.mapInArrow(run, entries.schema)


def _need(n1: Column, n2: Column, percent: int) -> Column:
    """How many members the prefixes must share: of all T, those outside can be at most the longer rest."""
    rest = F.greatest(F.ceil(n1 * percent / 100), F.ceil(n2 * percent / 100)) - 1
    return F.ceil((n1 + n2) * percent / (100 + percent)) - rest


def _reach(n1: Column, left1: Column, n2: Column, left2: Column, percent: int) -> Column:
    """Whether sets of these sizes, with ``left`` members of their prefixes in lists, can reach the threshold."""
    return (F.least(n1, n2) * (100 + percent) >= (n1 + n2) * percent) & (F.least(left1, left2) >= _need(n1, n2, percent))


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link.  Rows come sorted by query and block, the query's text first."""
    n_blocks = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    asked = saved(pairs.groupBy("a").agg(n_blocks), "ngram_asked")
    # Texts lie in buckets by document, so only the pairs move to them, and each text then once to its query's block.
    mine = pairs.join(asked, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b")
    mine = mine.join(texts.withColumnRenamed("doc", "b"), "b").select("a", "block", "b", "text")
    own = asked.join(texts.withColumnRenamed("doc", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("bigint").alias("b"), "text")
    both = mine.unionByName(own).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int] | None = None
        query = np.zeros(0, dtype=np.uint64)
        ids: list[int] = []
        sets: list[np.ndarray] = []
        held = 0

        def searched() -> pa.RecordBatch:
            good = divide_skip(query, sets, [needed(len(query), len(s), percent) for s in sets])
            found = [i for i, g in zip(ids, good, strict=True) if g]
            ids.clear()
            sets.clear()
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

        for batch in batches:
            for a, block, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if b is None:
                    if ids:
                        yield searched()
                    now, query, held = (a, block), member_hashes(text.as_py(), n), 0
                    continue
                ids.append(b)
                sets.append(member_hashes(text.as_py(), n))
                held += len(sets[-1])
                if len(ids) >= BLOCK or held >= 1 << 21:  # a block by chance larger, or of very long texts, is searched in parts
                    yield searched()
                    held = 0
        if ids:
            yield searched()

    good = saved(both.mapInArrow(run, "a bigint, b bigint"), "ngram_links")
    dropped(asked)
    return good


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return lists.withColumn("comp", F.col("doc"))
    return lists.join(labels.select(F.col("node").alias("doc"), F.col("comp").alias("own")), "doc", "left").withColumn("comp", F.coalesce("own", "doc")).drop("own")


def _open(lists: DataFrame, percent: int) -> DataFrame:
    """Lists whose members lie in several components, each with the one of whose prefix least is in no list."""
    unlisted = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("left")
    by = lists.groupBy("member").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct(unlisted, "doc", "n", "left", "comp")).alias("p"))
    return by.filter("low != high").select("member", *[F.col(f"p.{c}").alias(f"{c}_p") for c in ("doc", "n", "left", "comp")])


def _bucketed(rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, str, str]:
    """The text of each node, in buckets by node: a table under the shared folder, its name and path."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), classes.count() // 20_000)
    name, path = f"ngram_texts_{uuid.uuid4().hex}", scratch(spark, "ngram_texts")
    # Most nodes have their representative's id as number; the few others are told by id and text.
    other = classes.filter("node != rep").select(F.col("rep").alias("r"), F.col("th").alias("t"), "node")
    # Rows of an id without others hold one set, if any: each of their texts stands for it.
    numbered = rows.join(other, (rows["doc_id"] == other["r"]) & (rows["th"] == other["t"]), "left").select(F.coalesce("node", "doc_id").alias("doc"), "text")
    own = numbered.filter(F.btrim("text", F.lit(SPACES)) != "").repartition(n, "doc").join(classes.select(F.col("node").alias("doc")), "doc")  # a semi join would be pushed below, and the texts move twice
    once = Window.partitionBy("doc").orderBy("doc")  # repeated rows, of one id and text
    own = own.withColumn("k", F.row_number().over(once)).filter("k = 1")
    own.select("doc", "text").write.bucketBy(n, "doc").option("path", path).saveAsTable(name)
    released(spark)
    return spark.table(name), name, path


def _classes(sizes: DataFrame) -> DataFrame:
    """(digest, rep, th, node) of each distinct set: the smallest id that has it, with its text's hash, and the node's number.

    A node's number is its id, but where an id has several sets: those are numbered below all ids.
    """
    some = sizes.filter("n_members > 0 AND doc_id IS NOT NULL")
    several = some.groupBy(F.col("doc_id").alias("rep")).agg(F.min("digest").alias("low"), F.max("digest").alias("high")).filter("low != high").select("rep", F.lit(True).alias("several"))
    least = sizes.agg(F.min("doc_id")).first()[0] or 0
    found = some.groupBy("digest").agg(F.min(F.struct("doc_id", "th")).alias("m")).select("digest", F.col("m.doc_id").alias("rep"), F.col("m.th").alias("th"))
    number = F.when(F.col("several"), F.lit(least).cast("bigint") - 1 - F.monotonically_increasing_id()).otherwise(F.col("rep"))
    return found.join(several, "rep", "left").select("digest", "rep", "th", number.alias("node"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, least_seen: int = 8, most_frequent: int = 1_000_000) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sizes, classes, links, labels): size and digest of each row, nodes, linked nodes, and their components."""
    small_batches(docs.sparkSession)
    rows = docs.select(whole_id(docs, id_col).alias("doc_id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("th"))
    sizes = saved(_sizes(rows, n), "ngram_sizes")
    classes = saved(_classes(sizes), "ngram_classes")
    texts, name, path = _bucketed(rows, classes)
    entries = saved(_entries(texts, n, percent, frequent_members(texts, n, least_seen, most_frequent)), "ngram_entries")
    shared = saved(_shared_only(entries.filter("NOT long")).unionByName(entries.filter("long")).select("member", "doc", "n").distinct(), "ngram_shared")
    dropped(entries)
    # Two prefixes can share no more than either has in lists.
    left = shared.groupBy("doc").agg(F.count(F.lit(1)).cast("int").alias("left"))
    lists = saved(shared.join(left, "doc").select("member", "doc", "n", "left"), "ngram_lists")
    dropped(shared)
    found: DataFrame | None = None
    labels: DataFrame | None = None
    for star in (True, False):
        own = _labelled(lists, labels)
        opened = _open(own, percent)
        if star:
            near = own.join(opened, "member").filter((F.col("comp") != F.col("comp_p")) & _reach(F.col("n"), F.col("left"), F.col("n_p"), F.col("left_p"), percent))
            pairs = near.select(F.col("doc_p").alias("a"), F.col("doc").alias("b")).distinct()
        else:
            own = own.join(opened.select("member"), "member", "left_semi")
            other = own.select("member", *[F.col(c).alias(f"{c}_p") for c in ("doc", "n", "left", "comp")])
            near = own.join(other, "member").filter((F.col("doc_p") < F.col("doc")) & (F.col("comp") != F.col("comp_p")) & _reach(F.col("n"), F.col("left"), F.col("n_p"), F.col("left_p"), percent))
            counted = near.groupBy(F.col("doc_p").alias("a"), F.col("doc").alias("b"), "n_p", "n").agg(F.count(F.lit(1)).alias("c"))
            pairs = counted.filter(F.col("c") >= _need(F.col("n"), F.col("n_p"), percent)).select("a", "b")
        pairs = saved(pairs, "ngram_pairs")
        good = _verified(pairs, texts, n, percent)
        dropped(pairs)
        found = good if found is None else found.unionByName(good)
        if labels is None or good.limit(1).count():
            labels = components(found)
    dropped(lists)
    docs.sparkSession.sql(f"DROP TABLE {name}")
    discard(path)
    return sizes, classes, found, labels


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85, **options) -> DataFrame:
    """(doc_id, n_members, component_id) of every row."""
    sizes, classes, found, labels = links(docs, id_col, text_col, n, percent, **options)
    held = sizes.filter("n_members > 0 AND doc_id IS NOT NULL").select("doc_id", "digest").distinct().join(classes, "digest")
    joined = held.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a != z").select(F.col("doc_id").alias("d"), "a")
    joined = saved(held.join(joined, held["doc_id"] == joined["d"]).filter("a != node").select("a", F.col("node").alias("b")), "ngram_joined")
    if joined.limit(1).count():
        labels = components(found.unionByName(joined))
    own = classes.join(labels, classes["node"] == labels["node"], "left").select("digest", "rep", F.coalesce("comp", classes["node"]).alias("comp"))
    least = own.groupBy("comp").agg(F.min("rep").alias("component_id"))
    own = own.join(least, "comp").select(F.col("digest").alias("d"), "component_id")
    out = sizes.join(own, sizes["digest"] == own["d"], "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", "n_members", F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, **options) -> DataFrame:
    """The rows of ``docs`` whose text comes first in its group of linked texts, by id; repeated rows stay together."""
    sizes, classes, _, labels = links(docs, id_col, text_col, n, percent, **options)
    own = classes.join(labels, classes["node"] == labels["node"], "left").select("digest", "rep", F.coalesce("comp", classes["node"]).alias("comp"))
    first = own.groupBy("comp").agg(F.min(F.struct("rep", "digest")).alias("f"))
    own = own.join(first, "comp").select(F.col("digest").alias("d"), "f")
    rows = sizes.filter("doc_id IS NOT NULL").join(own, sizes["digest"] == own["d"])
    gone = rows.filter((F.col("f.digest") != F.col("digest")) | (F.col("f.rep") != F.col("doc_id")))
    gone = saved(gone.select(F.col("doc_id").alias("__gone"), F.col("th").alias("__th")).distinct(), "ngram_gone")
    return docs.join(gone, (docs[id_col] == gone["__gone"]) & (F.xxhash64(docs[text_col]) == gone["__th"]), "left_anti")
