"""Secret scans: base patterns, and a battery of randomness tests for long tokens.

Besides the base patterns, every run of at least ``min_length`` token characters
is tested.  Its encoding (decimal, hex, base32, base36, base62, base64) is the
smallest that holds its characters.  Three tests ask whether its symbols could
be uniform and independent: chi-squared over the alphabet, runs above and below
the middle, and lag-one serial correlation.  Fisher's rule makes one score of
the three p-values: near 0 for words, uniform for random strings.

A run that no alphabet holds, as it mixes '/' or '+' with '-' or '_', is tested in
parts: those in each alphabet, and those between all four; they may overlap.

False discoveries are controlled by target and decoy: runs of letters alone of
one case are decoys of all other runs.  For each class of length, over all
documents, the cutoff is the lowest score at which decoys above it are at most
``fdr`` times the targets above it, and never below ``alpha``.  The one-case runs
are targets too, scored in 26 letters, in classes of their own.  The decoys of
these are the words of the documents, all of each document's put together in
runs one after the other; the share of them above a score stands for the share
of false targets.

Rules: null text counts as empty and has no spans.  Rows, repeated ones too, are
independent but for the cutoffs, a table of length classes and score steps of
fixed size.  Base spans of one start are listed by kind; a random run that meets
a base span is left out, and runs that overlap are both listed.  Texts of any
length are searched whole.  An empty table gives none.  Ids are whole numbers;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.store import saved, small_batches, whole_id

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")

#: Alphabets from the smallest to the largest.
ALPHABETS = tuple(
    (name, {c: i for i, c in enumerate(chars)})
    for name, chars in (
        ("decimal", "0123456789"),
        ("hex", "0123456789abcdef"),
        ("HEX", "0123456789ABCDEF"),
        ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
        ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
        ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
        ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
        ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    )
)
BASE26 = (("base26", {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}),)
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+")
#: The parts of a run that no alphabet holds.
PARTS = (re.compile(r"[A-Za-z0-9+/]+"), re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"[A-Za-z0-9]+"))
LENGTH_CLASSES = (20, 24, 32, 48, 64, 128)
STEPS = 200
#: Length classes of one-case letters, as targets, begin here; their decoys are shorter than LONGEST_DECOY, but for a last one that takes a short rest.
LETTERS, LONGEST_DECOY = 100, 192

SCHEMA = (
    "doc_id bigint, base array<struct<kind:int,start:int,end:int>>, "
    "runs array<struct<start:int,end:int,encoding:string,cls:int,score:double,decoy:boolean>>"
)
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("base", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))),
        (
            "runs",
            pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("cls", pa.int32()), ("score", pa.float64()), ("decoy", pa.bool_())])),
        ),
    ]
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start and kind.  The tests before each pattern only tell that it can't match."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if max(map(len, text.split()), default=0) >= 32:
        out += [(2, m.start(), m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], x[0]))


def encoding_of(token: str, alphabets=ALPHABETS) -> tuple[str, dict[str, int]] | None:
    own = set(token)
    return next(((n, a) for n, a in alphabets if own <= a.keys()), None)


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def p_uniform(v: list[int], k: int) -> float:
    """Pearson's statistic against its exact mean and variance under equal chances."""
    n = len(v)
    x = k / n * sum(c * c for c in Counter(v).values()) - n
    return _tail((x - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))


def p_runs(v: list[int], k: int) -> float:
    up = [2 * x >= k for x in v]
    n, a = len(v), sum(up)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    runs = 1 + sum(x != y for x, y in zip(up, up[1:], strict=False))
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    return 2 * _tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0


def p_serial(v: list[int]) -> float:
    n, s, q = len(v), sum(v), sum(x * x for x in v)
    spread = n * q - s * s
    if not spread:
        return 0.0
    r = (n * (sum(x * y for x, y in zip(v, v[1:], strict=False)) + v[-1] * v[0]) - s * s) / spread
    return 2 * _tail(abs(r + 1 / (n - 1)) / (math.sqrt(n * (n - 3) / (n + 1)) / (n - 1)))


def randomness(token: str, alphabets=ALPHABETS) -> tuple[str, float] | None:
    """The encoding and Fisher's combined p-value."""
    found = encoding_of(token, alphabets)
    if not found:
        return None
    name, alphabet = found
    v = [alphabet[c] for c in token]
    x = -sum(math.log(max(p, 1e-300)) for p in (p_uniform(v, len(alphabet)), p_runs(v, len(alphabet)), p_serial(v)))
    return name, math.exp(-x) * (1 + x + x * x / 2)


def token_runs(text: str, min_length: int) -> list[tuple[int, int, str, int, float, bool]]:
    if max(map(len, text.split()), default=0) < min_length:
        return []
    out = []
    for m in TOKEN.finditer(text):
        if len(m[0]) < min_length:
            continue
        for at, token in parts_of(m[0]):
            if len(token) < min_length:
                continue
            start, cls = m.start() + at, sum(len(token) >= x for x in LENGTH_CLASSES)
            letters = token.isalpha() and (token[1:].islower() or token.isupper())
            out.append((start, start + len(token), *_scored(token, cls), letters))
            if letters:
                out.append((start, start + len(token), *_scored(token.lower(), LETTERS + cls, BASE26), False))
    return out


def parts_of(run: str) -> list[tuple[int, str]]:
    """The run, or if it mixes alphabets its parts in each of them and those between all separators; parts may overlap."""
    if encoding_of(run):
        return [(0, run)]
    return sorted({(m.start(), m[0]) for p in PARTS for m in p.finditer(run)})


def _scored(token: str, cls: int, alphabets=ALPHABETS) -> tuple[str, int, float]:
    name, score = randomness(token, alphabets)
    return name, cls, score


def word_decoys(text: str, min_length: int) -> list[tuple[int, int, str, int, float, bool]]:
    """Runs of letters made of all the text's words in order, of lengths that the text's hash picks."""
    joined = "".join(w for w in text.split() if len(w) < min_length and w.isascii() and w.isalpha()).lower()
    if len(joined) < min_length:
        return []
    out, at, h = [], 0, xxhash.xxh3_64_intdigest(text)
    while at < len(joined):
        cls, ends = h % len(LENGTH_CLASSES), (*LENGTH_CLASSES[1:], LONGEST_DECOY)
        n = max(min_length, LENGTH_CLASSES[cls] + h // 8 % (ends[cls] - LENGTH_CLASSES[cls]))
        if len(joined) - at - n < min_length:  # a rest too short for a run of its own
            n = len(joined) - at
        out.append((0, 0, *_scored(joined[at : at + n], LETTERS + sum(n >= x for x in LENGTH_CLASSES), BASE26), True))
        at, h = at + n, xxhash.xxh3_64_intdigest(h.to_bytes(8, "little"))
    return out


def examine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 20) -> DataFrame:
    """Base spans and tested runs of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, runs = [], []
            for t in b.column(1):
                text = t.as_py() or ""
                base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in base_spans(text)])
                runs.append([dict(zip(("start", "end", "encoding", "cls", "score", "decoy"), x, strict=True)) for x in token_runs(text, min_length) + word_decoys(text, min_length)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, ARROW.field(1).type), pa.array(runs, ARROW.field(2).type)], schema=ARROW)

    return docs.select(whole_id(docs, id_col).alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def cutoffs(tested: DataFrame, fdr: float, alpha: float) -> dict[int, float]:
    """The lowest accepted score of each length class, from counts of all runs."""
    step = F.least(F.floor(F.col("r.score") * STEPS), F.lit(STEPS - 1)).cast("int")
    rows = tested.select(F.explode("runs").alias("r")).groupBy(F.col("r.cls").alias("cls"), F.col("r.decoy").alias("decoy"), step.alias("step"))
    n = {(r["cls"], r["decoy"], r["step"]): r["count"] for r in rows.count().collect()}
    out = {}
    for cls in {k[0] for k in n}:
        decoys = targets = 0
        best = None
        of = {d: sum(c for k, c in n.items() if k[:2] == (cls, d)) for d in (True, False)}
        for s in range(STEPS - 1, -1, -1):
            decoys += n.get((cls, True, s), 0)
            targets += n.get((cls, False, s), 0)
            # Made decoys may be many or few: their share says how many targets are false.
            false = (decoys + 1) / (of[True] + 1) * of[False] if cls >= LETTERS else decoys
            if targets and false <= fdr * targets:
                best = s / STEPS
        if best is not None:
            out[cls] = max(best, alpha)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 20, fdr: float = 0.05, alpha: float = 0.01) -> DataFrame:
    """(doc_id, base, spans): spans holds the base ones and the random runs that meet none of them."""
    small_batches(docs.sparkSession)
    tested = saved(examine(docs, id_col, text_col, min_length), "secret_runs")
    limit = cutoffs(tested, fdr, alpha)

    def accepted(r: Column) -> Column:
        c = F.lit(2.0)
        for cls, v in limit.items():
            c = F.when(r["cls"] == cls, F.lit(v)).otherwise(c)
        meets = F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
        return ~r["decoy"] & (r["score"] >= c) & ~meets

    more = F.transform(F.filter("runs", accepted), lambda r: F.struct(F.lit(3).alias("kind"), r["start"].alias("start"), r["end"].alias("end")))
    both = F.array_sort(F.transform(F.concat("base", more), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return tested.select("doc_id", "base", both.alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
