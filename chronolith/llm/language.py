"""Language identification by prediction by partial matching over bytes.

Each language has a tree of the byte contexts of up to ``order`` bytes that its
texts hold, of whatever order they are, with frozen counts.  A byte's code
length comes from the longest context that the language knows: where that lacks
the byte, an escape is paid (distinct over seen plus distinct) and the next
shorter context is asked, without the bytes that the longer one had (exclusion),
down to a uniform code over what is left of 256.  So the shares of all bytes at
a place sum to one.  Strings longer than ``sure`` bytes enter the trees if seen
``least_seen`` times.  The language of the shortest total code wins.

The trees of all languages share one sorted list of strings for each length; a
string's row has the counts of each language.  As the trees are frozen, the cost
of the last byte of each longest string is computed once for all languages; the
places of a text that hold such a string cost one look-up, and only the others
walk the trees.

``score`` is the share of the winner under the code lengths of an average
stretch of ``STRETCH`` bytes (of the text, if it is shorter): near 1 where any
line of the text tells, near an equal share where the text tells nothing.

The trees are fitted on a sample of the labelled rows, about ``sample`` documents
of each language (all, if there are fewer), chosen by a hash of their id; that
bounds them, and what the driver gathers and sends.

Rules: prediction reads nothing but the text.  Text that is null or has no letter
is ``und`` with score 0, and so is all text if nothing was learned; an empty
table gives none.  Among languages with codes of one length the first by name
wins.  Repeated rows are judged one by one, and each counts in the fit.  Texts of
any length are counted and coded whole by one rule.  Ids are whole numbers; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.store import small_batches, whole_id

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
CHUNK = 1 << 19  # bytes looked up at once
STRETCH = 16


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def strings(b: np.ndarray, length: int) -> np.ndarray:
    """The strings of so many bytes, each as a number, by their last byte; the first ``length - 1`` are left out."""
    n = max(0, len(b) - length + 1)
    out = np.zeros(n, dtype=np.int64)
    for i in range(length):
        out = (out << 8) | b[i : i + n]
    return out


def count_strings(docs: DataFrame, lang_col: str, text_col: str, order: int) -> DataFrame:
    """(lang, length, key, n) of all strings of up to ``order + 1`` bytes: summed in the task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                by.setdefault(lang, []).append(np.frombuffer(text.as_py().encode().lower(), dtype=np.uint8).astype(np.int64))
            for lang, texts in by.items():
                for length in range(1, order + 2):
                    key, n = np.unique(np.concatenate([strings(t, length) for t in texts]), return_counts=True)
                    m = len(key)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(np.full(m, length, np.int32)), pa.array(key), pa.array(n.astype(np.int64))], names=["lang", "length", "key", "n"])

    labelled = docs.select(docs[lang_col].alias("lang"), docs[text_col].alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    return labelled.mapInArrow(run, "lang string, length int, key bigint, n bigint").groupBy("lang", "length", "key").agg(F.sum("n").alias("n"))


class Model:
    """Context trees of all languages, by length of the string; the last row of each table stands for what isn't there."""

    def __init__(self, counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]], order: int = 4):
        self.langs, self.order = sorted(counts), order
        k = max(1, len(self.langs))
        self.keys = [np.zeros(1, dtype=np.int64)]
        seen = [np.zeros((1, k))]
        for length in range(1, order + 2):
            own = [counts[x].get(length, (np.zeros(0, np.int64),) * 2) for x in self.langs]
            keys = np.unique(np.concatenate([np.zeros(0, np.int64), *[o[0] for o in own]]))
            n = np.zeros((len(keys), k))
            for i, (key, c) in enumerate(own):
                n[np.searchsorted(keys, key), i] = c
            self.keys.append(keys)
            seen.append(n)
        add = lambda rows, at, values: np.add.at(rows, at, values)
        total, distinct = [], []
        for j in range(order + 1):  # contexts of j bytes, and what follows them
            t, d = np.zeros((len(self.keys[j]), k)), np.zeros((len(self.keys[j]), k))
            up = np.searchsorted(self.keys[j], self.keys[j + 1] >> 8)
            add(t, up, seen[j + 1])
            add(d, up, seen[j + 1] > 0)
            total.append(t)
            distinct.append(d)
        log = lambda x: np.log2(np.maximum(x, 1e-300))
        lined = lambda x, last: np.vstack([x, np.full((1, k), last)]).astype(np.float32)
        #: log2 of a string's count, NaN where a language lacks it.
        self.count = [None, *[lined(np.where(n > 0, log(n), np.nan), np.nan) for n in seen[1:]]]
        self.known = [np.vstack([t > 0, np.zeros((1, k), dtype=bool)]) for t in total]
        #: log2 of the sum of a context's shares, and the cost of its escape; then the same of the next shorter one after it.
        self.whole = [lined(log(t + d), 0) for t, d in zip(total, distinct, strict=True)]
        self.escape = [lined(np.where(t > 0, log(t + d) - log(d), 0), 0) for t, d in zip(total, distinct, strict=True)]
        self.whole_after, self.escape_after = [None], [None]
        for j in range(1, order + 1):
            shorter = np.searchsorted(self.keys[j - 1], self.keys[j] & ((1 << 8 * (j - 1)) - 1))
            also = np.zeros_like(total[j])
            ends = np.searchsorted(self.keys[j], self.keys[j + 1] & ((1 << 8 * j) - 1))
            add(also, np.searchsorted(self.keys[j], self.keys[j + 1] >> 8), np.where(seen[j + 1] > 0, seen[j][ends], 0))
            t, d = total[j - 1][shorter] - also, distinct[j - 1][shorter] - distinct[j]
            self.whole_after.append(lined(log(t + d), 0))
            self.escape_after.append(lined(np.where(d > 0, log(t + d) - log(d), 0), 0))
        self.rest = np.log2(np.maximum(256 - distinct[0][0], 1))
        longest = self.keys[order + 1]
        self.ready = lined(self._walk(longest, np.full(len(longest), order)), 0)

    def _find(self, length: int, own: np.ndarray) -> np.ndarray:
        keys = self.keys[length]
        if not len(keys):
            return np.full(len(own), -1)
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        return np.where(keys[at] == own, at, -1)

    def costs(self, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language; ``place`` is a byte's place in its text."""
        key = b.copy()  # of the string of ``order + 1`` bytes that ends here
        for i in range(1, self.order + 1):
            key[i:] |= b[:-i] << (8 * i)
        row = self._find(self.order + 1, key)
        row[place < self.order] = -1
        out = self.ready[row]
        other = np.flatnonzero(row < 0)
        out[other] = self._walk(key[other], place[other])
        return out

    def _walk(self, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each string, down the trees."""
        n, k = len(key), self.count[1].shape[1]
        cost = np.zeros((n, k), dtype=np.float32)
        done, begun = np.zeros((n, k), dtype=bool), np.zeros((n, k), dtype=bool)

        def rows(length: int, own: np.ndarray) -> np.ndarray:
            at = self._find(length, own & ((1 << 8 * length) - 1))
            at[place < length - (own is key)] = -1
            return at

        before, longer = key >> 8, None
        for j in range(self.order, -1, -1):
            at = rows(j, before)
            known = self.known[j][at]
            whole, escape = self.whole[j][at], self.escape[j][at]
            if longer is not None:
                whole = np.where(begun, self.whole_after[j + 1][longer], whole)
                escape = np.where(begun, self.escape_after[j + 1][longer], escape)
            got = self.count[j + 1][rows(j + 1, key)]
            hit = known & ~done & ~np.isnan(got)
            cost += np.where(hit, whole - got, np.where(known & ~done, escape, 0))
            done |= hit
            begun |= known
            longer = at
        return np.where(done, cost, cost + self.rest).astype(np.float32)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), self.count[1].shape[1]))
        group: list[tuple[int, int, bytes]] = []  # text, place of its first byte that counts, bytes
        size = 0
        for i, t in enumerate(texts):
            for a in range(0, len(t), CHUNK):
                part = t[max(0, a - self.order) : a + CHUNK]
                if group and size + len(part) > CHUNK:
                    self._add(out, group)
                    group, size = [], 0
                group.append((i, a, part))
                size += len(part)
        if group:
            self._add(out, group)
        return out

    def _add(self, out: np.ndarray, group: list[tuple[int, int, bytes]]) -> None:
        b = np.frombuffer(b"".join(t for _, _, t in group), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(t) for _, _, t in group])
        starts = ends - np.array([len(t) for _, _, t in group])
        skip = np.array([min(a, self.order) for _, a, _ in group])
        place = np.arange(len(b)) - np.repeat(starts, ends - starts)
        cost = self.costs(b, place)
        cost[place < np.repeat(skip, ends - starts)] = 0
        np.add.at(out, [i for i, _, _ in group], np.add.reduceat(cost, starts, axis=0, dtype=np.float64))


def fit(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", sample: int = 2000, order: int = 4, sure: int = 3, least_seen: int = 2) -> Model:
    """From labelled rows; the caller leaves out those that are held back."""
    small_batches(docs.sparkSession)
    labelled = docs.filter(docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    held = {r[0]: r["count"] for r in labelled.groupBy(lang_col).count().collect()}  # one row for each language
    parts = 1_000_000
    chosen = F.lit(0)
    for lang, n in held.items():
        chosen = F.when(docs[lang_col] == lang, F.lit(min(parts, -(-sample * parts // n)))).otherwise(chosen)
    own = labelled.filter(F.pmod(F.xxhash64(docs[id_col], F.lit("sample")), F.lit(parts)) < chosen)
    counted = count_strings(own, lang_col, text_col, order).filter((F.col("length") <= sure) | (F.col("n") >= least_seen))
    got = counted.toPandas()  # the strings of the sample, whatever the corpus
    counts = {lang: {int(x): (h["key"].to_numpy(), h["n"].to_numpy()) for x, h in g.sort_values("key").groupby("length")} for lang, g in got.groupby("lang")}
    return Model(counts, order)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the sample's strings, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            known = [bool(m.langs and t and has_letter(t)) for t in texts]
            raw = [t.encode().lower() if k else b"" for t, k in zip(texts, known, strict=True)]
            bits = m.bits(raw)
            best = bits.argmin(1)
            least = bits.min(1)
            size = np.maximum([len(r) for r in raw], 1)
            near = (bits - least[:, None]) * (np.minimum(size, STRETCH) / size)[:, None]
            score = np.where(known, 1 / np.exp2(-np.minimum(near, 1000)).sum(1), 0.0)
            lang = [m.langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), known, strict=True)]
            rate = [x / len(r) if r else None for x, r in zip(least.tolist(), raw, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    own = docs.select(whole_id(docs, id_col).alias("doc_id"), docs[text_col].alias("text"))
    return own.mapInArrow(run, "doc_id bigint, lang_pred string, score double, bits_per_byte double")
