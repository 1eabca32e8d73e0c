"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text is cut before each run of spaces that follows other characters, and
around line breaks.  No piece crosses such a place, so the lattice of a text is
the chain of the lattices of its chunks.  For each distinct chunk of a batch the
forward pass sums the weights of all segmentations that end at each place; a
backward draw then picks the last piece in proportion to its share, and goes on
where that piece begins.  Draws are numbered by row key, chunk and step, so the
same row gives the same pieces in any partitioning.

The files' scores are log-weights for a unigram model.  A BPE model's scores are
ranks; a piece then weighs ``1 / (rank + 3)``.  ``alpha`` sharpens (above 1) or
flattens the weights.

Nothing is normalised: a space becomes the space mark, and each other character
without a piece, the mark itself included, is spelled in byte pieces.  Decoding
thus gives back every text.

Rules: null text gives null pieces, empty text none.  Rows that are equal in key
and text get equal pieces; draws leave no ties.  Texts of any length are
segmented whole, chunk by chunk.  An empty table gives none.  Keys are whole
numbers, null counts as 0.  Columns named ``pieces``, ``lossless`` or ``decoded``
are replaced; others stay, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.llm.store import small_batches, whole_id

#: Where the public model lies; a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CHUNK = re.compile(r" *[^ \n]+|\n| +")
BATCH = 1 << 19  # characters segmented at once
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finaliser: equal inputs, equal and well-spread outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Pieces:
    """Vocabulary with hashed look-up by length, and bytes of every id."""

    def __init__(self, model_bytes: bytes, alpha: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        scores = np.array([sp.get_score(i) for i in range(n)])
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ranked = scores[plain].min() < -200
        self.log_weight = alpha * np.where(ranked, -np.log(3.0 + np.abs(scores)), scores)
        self.spelled = float(self.log_weight[plain].min() - 2.0 * alpha)
        self.byte_id = np.full(256, -1, dtype=np.int32)
        self.raw: list[bytes] = [b""] * n
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(names[i][3:-1], 16)] = i
                self.raw[i] = bytes([int(names[i][3:-1], 16)])
        for i in plain:
            self.raw[i] = names[i].replace(MARK, " ").encode()
        if (self.byte_id < 0).any():
            raise ValueError("lossless decoding needs a model with all byte pieces")
        own = [i for i in plain if names[i]]
        if any(re.search(f"[^{MARK}]{MARK}|[\n ]", names[i]) for i in own):
            raise ValueError("the model has pieces that hold a space after another character, or a line break: they could cross a cut")
        by: dict[int, list[int]] = {}
        for i in own:
            by.setdefault(len(names[i]), []).append(i)
        self.longest = max(by, default=1)
        self.whole: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        begins: dict[int, set[int]] = {}
        for length in range(1, self.longest + 1):
            ids = by.get(length, [])
            h = np.array([self._hash(names[i]) for i in ids], dtype=np.uint64)
            order = np.argsort(h)
            self.whole[length] = (h[order], np.array(ids, dtype=np.int32)[order])
        for i in own:
            for length in range(1, len(names[i])):
                begins.setdefault(length, set()).add(self._hash(names[i][:length]))
        self.begins = {k: np.array(sorted(v), dtype=np.uint64) for k, v in begins.items()}

    @staticmethod
    def _hash(s: str) -> int:
        h = 0
        for c in s:
            h = ((h ^ ord(c)) * int(BASE)) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h

    def decode(self, ids) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")


def _among(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x would stand, and whether it is there."""
    if not len(sorted_values):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return at, sorted_values[at] == x


class Lattices:
    """Backward distributions of many chunks: for each end, pieces with cumulative shares."""

    def __init__(self, chunks: list[str], v: Pieces):
        lengths = np.array([len(c) for c in chunks], dtype=np.int64)
        points = self._marked(chunks)
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        chunk = np.repeat(np.arange(len(chunks)), lengths)
        self.start = first + np.arange(len(chunks))  # nodes: one more than characters in each chunk
        self.end = self.start + lengths
        node = np.arange(len(points)) + chunk  # of the place before each character
        left = first[chunk] + lengths[chunk] - np.arange(len(points))
        at = np.arange(len(points))
        h = np.zeros(len(points), dtype=np.uint64)
        starts, ends, ids, weights = [], [], [], []
        for length in range(1, v.longest + 1):
            h = (h ^ points[at + length - 1].astype(np.uint64)) * BASE
            h ^= h >> np.uint64(29)
            where, hit = _among(v.whole[length][0], h)
            if hit.any():
                got = v.whole[length][1][where[hit]]
                starts.append(node[at[hit]])
                ends.append(node[at[hit]] + length)
                ids.append(got.astype(np.int64))
                weights.append(v.log_weight[got])
            if length == 1:  # characters without a piece are spelled: the id says which character
                bare = at[~hit]
                cp = np.where(points[bare] == 0xFFFFFFFF, ord(MARK), points[bare]).astype(np.int64)
                starts.append(node[bare])
                ends.append(node[bare] + 1)
                ids.append(np.where(cp < 128, v.byte_id[np.minimum(cp, 127)], -1 - cp))
                weights.append(np.full(len(bare), v.spelled))
            on = (left[at] > length) & _among(v.begins.get(length, np.zeros(0, np.uint64)), h)[1]
            at, h = at[on], h[on]
            if not len(at):
                break
        start, end = np.concatenate(starts), np.concatenate(ends)
        order = np.argsort(end, kind="stable")
        self.edge_start, end, self.edge_id = start[order], end[order], np.concatenate(ids)[order]
        weight = np.concatenate(weights)[order]
        del points, h, at, left, node, chunk, starts, ends, ids, weights, start, order  # as large as what stays
        # Forward: all chunks at once, by distance of the end from the chunk's start.
        nodes = int(lengths.sum()) + len(chunks)
        head = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        size = np.diff(np.concatenate([head, [len(end)]]))
        group_node = end[head]
        base = np.repeat(self.start, lengths + 1)
        depth = group_node - base[group_node]
        by_depth = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[by_depth], np.arange(1, depth.max() + 2 if len(depth) else 1))
        total = np.zeros(nodes)
        share = np.empty(len(end))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            g = by_depth[a:b]
            n = size[g]
            e = np.repeat(head[g] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            x = total[self.edge_start[e]] + weight[e]
            cut = np.concatenate([[0], np.cumsum(n)[:-1]])
            top = np.maximum.reduceat(x, cut)
            y = np.exp(x - np.repeat(top, n))
            s = np.add.reduceat(y, cut)
            total[group_node[g]] = top + np.log(s)
            share[e] = y / np.repeat(s, n)
        # One sorted array for all draws: number of the group plus the share up to each edge.
        self.group = np.zeros(nodes, dtype=np.int64)
        self.group[group_node] = np.arange(len(head))
        run = np.cumsum(share)
        run -= np.repeat(run[head] - share[head], size)
        self.last = head + size - 1
        run[self.last] = 1.0
        self.reach = np.repeat(np.arange(len(head)), size) + np.minimum(run, 1.0)
        self.total = total
        self.nodes = nodes

    @staticmethod
    def _marked(chunks: list[str]) -> np.ndarray:
        p = _points("".join(chunks)).copy()
        p[p == ord(MARK)] = 0xFFFFFFFF  # the mark itself has no piece here
        p[p == 32] = ord(MARK)
        return p

    def draw(self, which: np.ndarray, seed: np.ndarray, v: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one segmentation for each chunk asked for, in order, and how many ids each has."""
        node, begin = self.end[which].copy(), self.start[which]
        active = np.arange(len(which))
        count = np.zeros(len(which), dtype=np.int64)
        steps = []
        step = 0
        while len(active):
            g = self.group[node[active]]
            stride = np.uint64(((step + 1) * int(BASE)) & 0xFFFFFFFFFFFFFFFF)
            u = (_mix(seed[active] + stride) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e = np.minimum(np.searchsorted(self.reach, g + u, side="right"), self.last[g])
            steps.append((active, self.edge_id[e]))
            count[active] += 1
            node[active] = self.edge_start[e]
            active = active[node[active] > begin[active]]
            step += 1
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
        for i, (a, ids) in enumerate(steps):
            out[ends[a] - 1 - i] = ids
        if not len(out) or out.min() >= 0:
            return out.astype(np.int32), count
        cp = -1 - out
        wide = np.where(out < 0, 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000), 1)
        full = np.repeat(out, wide)
        at = np.cumsum(wide) - wide
        for i in np.flatnonzero(out < 0):
            full[at[i] : at[i] + wide[i]] = v.byte_id[list(chr(int(cp[i])).encode("utf-8", "surrogatepass"))]
        whole = np.add.reduceat(wide, ends - count)
        return full.astype(np.int32), whole


class Sampler:
    """Segments texts, some at a time: their distinct chunks share one set of lattices."""

    def __init__(self, v: Pieces, seed: int = 0):
        self.v, self.seed = v, np.uint64(seed & 0xFFFFFFFFFFFFFFFF)

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        part: list[str] = []
        own: list[int] = []
        size = 0
        for t, k in zip(texts, keys, strict=True):
            if part and size + len(t) > BATCH:
                out += self._together(part, own)
                part, own, size = [], [], 0
            part.append(t)
            own.append(k)
            size += len(t)
        return out + (self._together(part, own) if part else [])

    def _together(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        cut = [CHUNK.findall(t) for t in texts]
        number: dict[str, int] = {}
        which = np.array([number.setdefault(c, len(number)) for x in cut for c in x], dtype=np.int64)
        if not len(which):
            return [np.zeros(0, dtype=np.int32) for _ in texts]
        lattices = Lattices(list(number), self.v)
        n = np.array([len(x) for x in cut])
        row = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        key = _mix(np.array([(k + (int(self.seed) * int(BASE)) + 1) & 0xFFFFFFFFFFFFFFFF for k in keys], dtype=np.uint64))
        seed = _mix(key[row] + place.astype(np.uint64) * BASE)
        ids, count = lattices.draw(which, seed, self.v)
        chunk_ends = np.concatenate([[0], np.cumsum(count)])
        bounds = chunk_ends[np.concatenate([[0], np.cumsum(n)])]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _parts(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows in parts of at most ``BATCH`` bytes of text, a longer text by itself: only one part is held decoded."""
    first = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()):
        if i > first and size + n > BATCH:
            yield b.slice(first, i - first)
            first, size = i, 0
        size += n
    if b.num_rows:
        yield b.slice(first)


def _shared(df: DataFrame, model: str):
    """The model file's bytes, some hundred kilobytes, read where the driver or the shared store has it."""
    spark = df.sparkSession
    small_batches(spark)
    rows = spark.read.format("binaryFile").load(model if "://" in model else f"file://{model}").select("content").collect()
    return spark.sparkContext.broadcast(bytes(rows[0][0]))


def encode(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = 1.0, seed: int = 0, check: bool = True) -> DataFrame:
    """The rows with two more columns: pieces, and (``check``) whether they decode to the text.

    Columns of ``df`` with these names are replaced.
    """
    shared = _shared(df, model)
    names = [c for c in df.columns if c not in ("pieces", "lossless")]
    apart = [] if text_col in names else [df[text_col].alias("__text")]  # else it would move twice
    at = len(names) + 1 if apart else names.index(text_col)
    own = df.select(*[df[c] for c in names], whole_id(df, key_col).alias("__key"), *apart)
    schema = own.drop("__key", "__text").schema.add("pieces", T.ArrayType(T.IntegerType())).add("lossless", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Pieces(shared.value, alpha)
        sampler = Sampler(v, seed)
        for b in (part for whole in batches for part in _parts(whole, at)):
            texts = b.column(at).to_pylist()
            ids = sampler.encode([t or "" for t in texts], [k or 0 for k in b.column(len(names)).to_pylist()])
            ok = [None if t is None else v.decode(x.tolist()) == t for t, x in zip(texts, ids, strict=True)] if check else [None] * len(ids)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            mask = pa.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=mask)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], lists, pa.array(ok, pa.bool_())], names=[*names, "pieces", "lossless"])

    return own.mapInArrow(run, schema)


def decode(df: DataFrame, pieces_col: str = "pieces", model: str = MODEL) -> DataFrame:
    """The rows with the text of their pieces in one more column, ``decoded``."""
    shared = _shared(df, model)
    names = [c for c in df.columns if c != "decoded"]
    own = df.select(*[df[c] for c in names], df[pieces_col].alias("__pieces"))
    schema = own.drop("__pieces").schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Pieces(shared.value)
        for b in batches:
            texts = [None if x is None else v.decode(x) for x in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, "decoded"])

    return own.mapInArrow(run, schema)
