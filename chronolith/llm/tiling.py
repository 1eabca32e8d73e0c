"""Benchmark decontamination by greedy string tiling.

Words of documents and benchmark items are numbered by the benchmark's
vocabulary.  Karp-Rabin hashes over ``min_match`` words are the seeds; a document
meets the items with which it shares seeds enough to cover what is asked.  The
longest common run of unmarked words is then found by running Karp-Rabin: its
length by bisection over hashes of all windows of a length, the run itself by
comparing words.  All runs of that length are marked as tiles, from the
document's start on, and the next length is sought, until none of ``min_match``
words is left.  The share of an item's words under tiles is its coverage:
passages count in whatever order they stand.  An item shorter than
``min_match`` words is looked for as a whole.

Items come to the tasks in blocks of at most ``block_items`` items and about
``block_bytes`` of text; a longer benchmark takes more passes over the documents.

Rules: null text counts as empty and matches nothing; so do items without words.
Repeated documents are judged one by one, repeated items count once; an item id
with several texts has them judged one by one.  Among runs of one length the
first in the document goes first, with its first place in the item.  Texts of
any length are read whole, and a repeated word or phrase is not listed pair by
pair.  Empty tables give no matches.  Ids are whole numbers.  ``clean`` returns all
columns as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.store import small_batches, whole_id

WORD = re.compile(r"\w+")
BASE = np.uint64(0x100000001B3)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of k words, modulo 2^64."""
    n = len(ids) - k + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k if n > 0 else 0):
        h = h * BASE + ids[i : i + n].astype(np.uint64)
    return h


class Index:
    """Seeds of a block of items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], min_match: int):
        self.k = min_match
        self.vocabulary: dict[str, int] = {}
        self.names, self.words = [], []
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                self.names.append(name)
                self.words.append(np.array(ids, dtype=np.int64))
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in {min(self.k, len(w)) for w in self.words}:
            h, item, place = [], [], []
            for i, w in enumerate(self.words):
                if min(self.k, len(w)) == k:
                    own = rolling(w, k)
                    h.append(own)
                    item.append(np.full(len(own), i))
                    place.append(np.arange(len(own)))
            h, item, place = np.concatenate(h), np.concatenate(item), np.concatenate(place)
            order = np.argsort(h, kind="stable")
            self.by_length[k] = h[order], item[order], place[order]

    def near(self, doc: np.ndarray, coverage: float) -> list[int]:
        """Items of which the seeds that stand in the document cover the share asked, or more; at least one word."""
        out: list[int] = []
        sizes = self.sizes
        for k, (h, item, place) in self.by_length.items():
            own = np.unique(rolling(doc, k))
            low, high = np.searchsorted(h, own, "left"), np.searchsorted(h, own, "right")
            n = high - low
            if not n.any():
                continue
            at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            order = np.lexsort((place[at], item[at]))
            i, p = item[at][order], place[at][order]
            until = np.concatenate([np.where(i[1:] == i[:-1], p[1:] - p[:-1], k), [k]])
            words = np.bincount(i, np.minimum(until, k), minlength=len(self.words))
            out += np.flatnonzero((words > 0) & (words >= coverage * sizes)).tolist()
        return sorted(out)


def _sums(x: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Running sums of words times powers: any window's hash is a difference, shifted to one exponent."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(x) * power[: len(x)], dtype=np.uint64)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _free(marked: np.ndarray, n: int) -> np.ndarray:
    """Places where n unmarked words follow."""
    held = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(held[n:] == held[: len(held) - n])


def tiles(doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(document place, item place, length) of the tiles, longest first.  Words that are no item's are 0 in the document."""
    most = max(len(doc), len(item)) + 1
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most, BASE | np.uint64(1))]), dtype=np.uint64)
    sums = _sums(doc, power), _sums(item, power)
    marked = doc == 0, np.zeros(len(item), dtype=bool)

    def windows(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = _free(marked[side], n)
        return at, (sums[side][at + n] - sums[side][at]) * power[most - at]

    def shared(n: int) -> bool:
        return bool(np.isin(windows(0, n)[1], windows(1, n)[1]).any())

    out: list[tuple[int, int, int]] = []
    longest = min(len(doc), len(item))
    while longest >= k:
        low, high = k - 1, longest
        while low < high:  # the longest length that some window of both has
            n = (low + high + 1) // 2
            low, high = (n, high) if shared(n) else (low, n - 1)
        if low < k:
            return out
        n, longest = low, low - 1
        at, h = windows(0, n)
        spots, g = windows(1, n)
        order = np.argsort(g, kind="stable")
        spots, g = spots[order], g[order]
        first = {}
        for i, x in zip(at[np.isin(h, g)].tolist(), h[np.isin(h, g)], strict=True):
            if marked[0][i] or marked[0][i + n - 1]:
                continue
            start, end = np.searchsorted(g, x, "left"), np.searchsorted(g, x, "right")
            j = first.get(int(x), int(start))
            while j < end and (marked[1][spots[j]] or marked[1][spots[j] + n - 1]):
                j += 1
            first[int(x)] = j
            if j < end and np.array_equal(doc[i : i + n], item[spots[j] : spots[j] + n]):
                marked[0][i : i + n] = True
                marked[1][spots[j] : spots[j] + n] = True
                out.append((i, int(spots[j]), n))
    return out


def covered(text: str, index: Index, coverage: float = 0.0) -> list[tuple[int, int, int, int, int]]:
    """(item number, tiles, words under tiles, longest tile, words of the item) of items with a tile, as far as they can reach the coverage."""
    get = index.vocabulary.get
    doc = np.array([get(w, 0) for w in words_of(text)], dtype=np.int64)
    out = []
    for item in index.near(doc, coverage):
        n = len(index.words[item])
        own = tiles(doc, index.words[item], min(index.k, n))
        if own:
            out.append((item, len(own), sum(t[2] for t in own), own[0][2], n))
    return out


def _blocks(items: DataFrame, item_col: str, item_text: str, block_items: int, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about the same size, one after the other."""
    small_batches(items.sparkSession)
    bench = items.select(whole_id(items, item_col).alias("item_id"), items[item_text].alias("text")).distinct()
    held = bench.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n = max(1, -(-held["n"] // block_items), -(-(held["b"] or 0) // block_bytes))
    for block in range(n):
        rows = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block).collect()
        yield sorted(((r["item_id"], r["text"] or "") for r in rows), key=repr)


def match(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = 5, coverage: float = 0.5, block_items: int = 200_000, block_bytes: int = 32 << 20
) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest) of the pairs at or above the coverage."""
    own = docs.select(whole_id(docs, id_col).alias("doc_id"), docs[text_col].alias("text"))
    out = None
    for block in _blocks(items, item_col, item_text, block_items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, min_match)
            for b in batches:
                found = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    for item, n, words, longest, size in covered(text.as_py() or "", index, coverage):
                        if words >= coverage * size:
                            found.append((doc_id, index.names[item], words / size, n, longest))
                cols = list(zip(*found, strict=True)) if found else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "coverage", "tiles", "longest"])

        part = own.mapInArrow(run, "doc_id bigint, item_id bigint, coverage double, tiles int, longest int")
        out = part if out is None else out.unionByName(part)
    return out


def clean(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", min_match: int = 5, coverage: float = 0.5, block_items: int = 200_000, block_bytes: int = 32 << 20
) -> DataFrame:
    """The rows of ``docs`` without those that cover an item; no shuffle."""
    at = docs.columns.index(text_col)
    for block in _blocks(items, item_col, item_text, block_items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, min_match)
            for b in batches:
                keep = [all(x[2] < coverage * x[4] for x in covered(t.as_py() or "", index, coverage)) for t in b.column(at)]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
