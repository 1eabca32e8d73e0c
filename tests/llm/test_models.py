"""Pieces by round trip and exact shares; languages by held-out rows and exact code lengths."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chronolith.llm import language, pieces
from tests.oracle import DATA

VOCABULARY = pieces.Pieces(open(pieces.MODEL, "rb").read())


def test_pieces_frames(spark, docs, nothing):
    out = pieces.encode(docs)
    rows = out.collect()
    assert all(r["lossless"] is (None if r["text"] is None else True) for r in rows) and len(rows) == docs.count()
    again = {r["doc_id"]: r["pieces"] for r in pieces.encode(docs.repartition(3, "source")).collect()}
    assert again == {r["doc_id"]: r["pieces"] for r in rows}
    back = pieces.decode(out).filter("NOT (decoded <=> text)")
    assert back.count() == 0 and pieces.encode(nothing).count() == 0


def test_pieces_text():
    texts = ["", " ", "a▁b \n\n  c", "日本語😀", "x" * 3000, "▁▁", "a  b   c ", "\n \n", "\t\r\x00", "é"]
    got = pieces.Sampler(VOCABULARY, 3).encode(texts, list(range(len(texts))))
    assert [VOCABULARY.decode(x.tolist()) for x in got] == texts


def test_sampled_shares():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)

    def all_of(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            i = sp.piece_to_id(s[:n])
            if i != sp.unk_id():
                for rest, w in all_of(s[n:]):
                    yield (i, *rest), w + VOCABULARY.log_weight[i]

    flat = pieces.Pieces(open(pieces.MODEL, "rb").read(), alpha=0.3)
    VOCABULARY_OLD, weights = VOCABULARY.log_weight, flat.log_weight
    VOCABULARY.log_weight = weights
    every = dict(all_of("▁thing"))
    VOCABULARY.log_weight = VOCABULARY_OLD
    total = np.logaddexp.reduce(list(every.values()))
    drawn = Counter(tuple(x.tolist()) for x in pieces.Sampler(flat).encode([" thing"] * 20000, list(range(20000))))
    assert set(drawn) <= set(every)
    for ids, w in every.items():
        p = math.exp(w - total)
        assert abs(drawn[ids] / 20000 - p) < 5 * math.sqrt(p / 20000) + 1e-3


def test_code_lengths():
    """Against the rule written out for one byte at a time; the shares of all bytes sum to one."""
    r = random.Random(1)
    text = {k: "".join(r.choice(a) for _ in range(300)).encode() for k, a in (("x", "abc "), ("y", "bcd "))}
    least = 2
    counts, plain = {}, {}
    for lang, t in text.items():
        plain[lang] = Counter(t[i : i + n] for n in range(1, 6) for i in range(len(t) - n + 1))
        plain[lang] = {k: v for k, v in plain[lang].items() if len(k) <= 3 or v >= least}
        own = {}
        for n in range(1, 6):
            some = sorted((int.from_bytes(k), v) for k, v in plain[lang].items() if len(k) == n)
            own[n] = np.array([k for k, _ in some]), np.array([v for _, v in some])
        counts[lang] = own
    m = language.Model(counts)

    def cost(lang, before, c):
        bits, gone, begun = 0.0, set(), False
        for j in range(min(4, len(before)), -1, -1):
            ctx = before[len(before) - j :]
            n = {k[-1]: v for k, v in plain[lang].items() if len(k) == j + 1 and k[:-1] == ctx}
            if not n:
                continue
            left = {s: v for s, v in n.items() if s not in gone}
            gone |= n.keys()
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if c in left:
                return bits - math.log2(left[c] / whole)
            bits -= math.log2(len(left) / whole)
        return bits + math.log2(256 - len(gone))

    probe = b"abd cbabcz\xc3 bcdb"
    want = [sum(cost(lang, probe[:i], probe[i]) for i in range(len(probe))) for lang in m.langs]
    again = probe * 3
    want3 = [sum(cost(lang, again[:i], again[i]) for i in range(len(again))) for lang in m.langs]
    for chunk in (1 << 19, 7, 1):
        language.CHUNK, old = chunk, language.CHUNK
        got = m.bits([probe, b"", again])
        language.CHUNK = old
        assert got[0] == pytest.approx(want, rel=1e-5) and got[2] == pytest.approx(want3, rel=1e-5) and (got[1] == 0).all()
    for lang in m.langs:
        for before in (b"", b"a", b"bc", b"bcd ", b"zz"):
            assert sum(2 ** -cost(lang, before, c) for c in range(256)) == pytest.approx(1)


def test_pieces_memory():
    """What texts hold at once while they are segmented stays small, however many meet in a batch."""
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(1 << 11)) for _ in range(64)]
    tracemalloc.start()
    got = pieces.Sampler(VOCABULARY).encode(texts, list(range(64)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 160 << 20 and all(VOCABULARY.decode(x) == t for x, t in zip(got, texts, strict=True))


def test_pieces_parts(spark):
    texts = ["a" * 9, None, "", "é" * pieces.BATCH, "b" * (pieces.BATCH - 1), "c", "d"]
    b = pa.record_batch([pa.array(range(7)), pa.array(texts)], names=["k", "t"])
    assert [p.column(0).to_pylist() for p in pieces._parts(b, 1)] == [[0, 1, 2], [3], [4, 5], [6]] and not list(pieces._parts(b.slice(7), 1))
    df = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id bigint, pieces string")
    got = pieces.encode(df, text_col="pieces").orderBy("doc_id").collect()
    assert VOCABULARY.decode(got[0]["pieces"]) == "x y" and got[1]["pieces"] is None and got[0]["lossless"]


def test_letters():
    assert language.has_letter("½ a") and language.has_letter("漢") and not language.has_letter("½ ² 12 _ -") and not language.has_letter("")


def test_languages(spark, docs, nothing):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit(df.filter("crc32(string(doc_id)) % 5 != 0"))
    got = language.predict(df.filter("crc32(string(doc_id)) % 5 = 0"), model).join(df, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["lang"]: r["text"] for r in got if r["text"] and r["lang"] and len(r["text"]) > 400}
    (a, b), probe = sorted(by)[:2], lambda t: language.predict(spark.createDataFrame([(1, t)], "doc_id bigint, text string"), model).first()["score"]
    assert probe(by[a][:200] + by[b][:200]) < min(probe(by[a]), probe(by[b]))
    with pytest.raises(TypeError):
        language.predict(df.selectExpr("string(doc_id) AS doc_id", "text"), model)
    odd = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert odd[900]["lang_pred"] == odd[901]["lang_pred"] == odd[902]["lang_pred"] == "und" and odd[905]["lang_pred"] in model.langs
    none = language.fit(nothing)
    assert language.predict(nothing, none).count() == 0 and {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}
