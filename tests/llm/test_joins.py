"""N-gram join against all pairs; tiling, secrets and components against plain Python."""

import random
import re

import numpy as np
import pytest

from chronolith.llm import components, ngramjoin, secrets, tiling


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def reachable(rows, n, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, n))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("n,percent,seen", [(4, 85, 8), (5, 80, 2)])
def test_ngram_components(docs, n, percent, seen):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = ngramjoin.grouped(docs, n=n, percent=percent, least_seen=seen).collect()
    want = reachable(rows, n, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)
    assert all(r["n_members"] == len(shingles(dict(rows)[r["doc_id"]], n)) for r in got)
    assert sum(k != v for k, v in want.items()) > 5


def test_near_copy_chain(spark):
    """A large group around a base, copies that only reach each other through it, and outsiders."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4))):
            w[r.randrange(len(w))] = f"e{i}x{r.randrange(99)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: x["component_id"] for x in ngramjoin.grouped(df, least_seen=2).collect()}
    assert got == reachable(rows, 4, 85)
    kept = {x["doc_id"] for x in ngramjoin.one_of_each(df, n=4, percent=85).collect()}
    assert kept == set(got.values())


@pytest.mark.parametrize("seen", [2, 8])
def test_ngram_sizes(spark, seen):
    """Pairs that link although one is longer by up to 1/t: its own members may fill its prefix."""
    r = random.Random(6)
    rows = []
    for i in range(150):
        w = [f"p{i}x{j}" for j in range(r.randrange(40, 103))]
        more = [f"q{i}x{j}" for j in range(r.randrange(0, len(w) // 5))]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + more))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: x["component_id"] for x in ngramjoin.grouped(df, least_seen=seen).collect()}
    sets = {i: shingles(t, 4) for i, t in rows}
    assert got == {i: i - (i % 2 and 100 * len(sets[i - 1] & sets[i]) >= 85 * len(sets[i - 1] | sets[i])) for i in sets}


def test_ngram_repeated_ids(spark):
    """An id with several texts joins what they reach; of texts none is lost."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    for rows in ([(3, a), (5, a), (5, b), (4, b)], [(3, a), (5, a), (5, b), (9, b)], [(7, a), (7, b), (7, a), (6, c), (8, c + " d"), (8, None), (None, a), (9, "")]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "doc_id AS node", "doc_id AS th", "doc_id AS comp")
        got = [(x["doc_id"], x["component_id"]) for x in ngramjoin.grouped(df).collect()]
        known = reachable([(i, t) for i, t in rows if i is not None], 4, 85)
        assert sorted(got, key=str) == sorted(((i, known.get(i) if shingles(t, 4) else i) for i, t in rows), key=str)
        kept = ngramjoin.one_of_each(df, n=4, percent=85)
        assert kept.columns == df.columns
        left = sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str)
        want = [(3, a), (4 if (4, b) in rows else 5, b)] if len(rows) == 4 else [(6, c), (7, a), (7, a), (7, b), (8, None), (9, ""), (None, a)]
        assert left == sorted(want, key=str)
    with pytest.raises(TypeError):
        ngramjoin.grouped(spark.createDataFrame([("x", a)], "doc_id string, text string"))


def test_ngram_blocks(spark, monkeypatch):
    """A query with more candidates than a block."""
    monkeypatch.setattr(ngramjoin, "BLOCK", 7)
    r = random.Random(11)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, " ".join(base[:-1] + [f"e{i}"]) if i else " ".join(base)) for i in range(60)] + [(100 + i, " ".join(base[:40] + [f"x{i}y{r.randrange(9)}z{j}" for j in range(60)])) for i in range(20)]
    got = {x["doc_id"]: x["component_id"] for x in ngramjoin.grouped(spark.createDataFrame(rows, "doc_id bigint, text string"), least_seen=2).collect()}
    assert got == reachable(rows, 4, 85)


def test_divide_skip():
    r = np.random.default_rng(1)
    for _ in range(50):
        q = np.unique(r.integers(0, 300, 80).astype(np.uint64))
        others = [np.unique(np.concatenate([q[r.random(len(q)) < r.random()], r.integers(0, 300, 20).astype(np.uint64)])) for _ in range(12)]
        need = [ngramjoin.needed(len(q), len(o), 60) for o in others]
        assert ngramjoin.divide_skip(q, others, need) == [len(np.intersect1d(q, o)) >= t for o, t in zip(others, need)]


def test_components(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 150), (7, 7)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100, 150: 150, 200: 150}


def plain_tiles(doc, item, k):
    """Longest unmarked common run, again and again."""
    md, mi, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not md[i + n] and not mi[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < k:
            return out
        n, i, j = best
        md[i : i + n] = mi[j : j + n] = [True] * n
        out.append(n)


def test_tiling():
    r = random.Random(2)
    for _ in range(60):
        item = [f"i{r.randrange(30)}" for _ in range(r.randrange(3, 40))]
        a, b = sorted((r.randrange(len(item) + 1), r.randrange(len(item) + 1)))
        doc = [f"i{r.randrange(40)}" for _ in range(20)] + item[b:] + ["z"] + item[:a] + item[a:b]
        index = tiling.Index([(1, " ".join(item))], 4)
        got = tiling.covered(" ".join(doc), index)
        want = plain_tiles(doc, item, min(4, len(item)))
        assert (got[0][2], got[0][1], got[0][3]) == (sum(want), len(want), max(want)) if want else not got


def test_tiling_repeats():
    """Few different words, so that runs repeat and overlap, against the plain rule."""
    r = random.Random(12)
    for _ in range(80):
        item = [f"i{r.randrange(3)}" for _ in range(r.randrange(2, 30))]
        doc = [f"i{r.randrange(4)}" for _ in range(r.randrange(0, 60))]
        want = plain_tiles(doc, [w for w in item], min(3, len(item)))
        got = tiling.covered(" ".join(doc), tiling.Index([(1, " ".join(item))], 3))
        assert [x[1:4] for x in got] == ([(len(want), sum(want), max(want))] if want else [])
        for coverage in (0.5, 1.0):
            some = tiling.covered(" ".join(doc), tiling.Index([(1, " ".join(item))], 3), coverage)
            assert [x for x in some if x[2] >= coverage * x[4]] == [x for x in got if x[2] >= coverage * x[4]]


def test_tiling_long():
    import time

    began = time.perf_counter()
    r = random.Random(13)
    long = "same " * 20000
    assert tiling.covered(long, tiling.Index([(1, long)], 5))[0][1:4] == (1, 20000, 20000)
    mixed = " ".join(r.choice("ab") for _ in range(20000))
    assert tiling.covered(mixed, tiling.Index([(1, mixed)], 5), 0.5)[0][2] == 20000
    shared = tiling.Index([(i, f"a phrase that all items have in them {i} " + " ".join(f"x{i}y{j}" for j in range(20))) for i in range(5000)], 5)
    assert tiling.covered("here a phrase that all items have in them it is", shared, 0.5) == []
    assert time.perf_counter() - began < 20


def test_tiling_frames(spark, docs, nothing):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, "tiny item"), (1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id bigint, text string")
    rows = [(0, "x ZETA eta, theta! y alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta"), (2, None), (3, "a tiny item here"), (3, "a tiny item here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in tiling.match(df, items, min_match=3).collect())
    assert got == [(0, 1, 1.0), (1, 1, 0.5), (3, 4, 1.0), (3, 4, 1.0)]
    assert got == sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in tiling.match(df, items, min_match=3, block_items=1).collect())
    assert [r["doc_id"] for r in tiling.clean(df, items, min_match=3).collect()] == [2]
    with pytest.raises(TypeError):
        tiling.match(df, items.selectExpr("string(item_id) AS item_id", "text"))
    assert got == sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in tiling.match(df, items, min_match=3, block_bytes=8).collect())
    assert tiling.clean(docs, items).count() == docs.count() and tiling.match(nothing, items).count() == 0 and tiling.match(df, nothing.selectExpr("doc_id AS item_id", "text")).count() == 0


def test_secret_spans(spark, docs, nothing):
    r = random.Random(3)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    rows = [(0, f"é my Password: 'abcd1234' and {key} end"), (1, "token=secret:abcdefgh12"), (2, "AKIA" + "Q" * 12 + " AKIA123"), (3, None), (4, "0" * 40), (5, "donaudampfschifffahrtsgesellschaft " * 3), (6, "tokeN =  \"0123456789abcdef0123456789abcdef\"")]
    got = {x["doc_id"]: x for x in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", secrets.listed("base").alias("b"), secrets.listed("spans").alias("s")).collect()}
    at = rows[0][1].index(key)
    assert got[0]["b"] == "assign:5:24" and got[0]["s"] == f"assign:5:24,random:{at}:{at + 40}"
    assert got[1]["b"] == "" or got[1]["b"].startswith("assign:0")
    assert got[2]["s"] == "access:0:16" and got[3]["s"] == "" and got[4]["s"] == "hex:0:40" and got[5]["s"] == ""
    assert got[6]["b"] == "assign:0:42,hex:10:42"
    assert secrets.scan(docs).count() == docs.count() and secrets.scan(nothing).count() == 0


def test_secret_letters_and_paths(spark):
    """Random keys of one case, and keys behind a slug in a path."""
    r = random.Random(8)
    words = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years much where your way down should because long each just state those people too mr how little good world make very year still see own work men day get here old life both between being under three never know same last another while us might great go come since against right used take use place".split()
    rows = [(i, " ".join(r.choice(words) for _ in range(80))) for i in range(600)]
    low = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(56))
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    both = key[:15] + "/" + key[15:30] + "+" + key[30:]
    rows += [(1000, f"a {low} b"), (1001, f"a {low.upper()[::-1]} b"), (1002, f"see /services/T00_x/B-1/{key} now"), (1003, f"see a-b_{both}_c"), (1004, "antidisestablishmentarianisms" * 2)]
    got = {x["doc_id"]: x["s"] for x in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", secrets.listed("spans").alias("s")).collect()}
    assert got[1000] == got[1001] == "random:2:58" and got[1004] == ""
    for i, k in ((1002, key), (1003, both)):
        at = rows[i - 400][1].index(k)
        assert f"random:{at}:{at + len(k)}" in got[i].split(",")
    assert not any(got[i] for i in range(600))


def test_secret_decoys_hold_all_words(monkeypatch):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for _ in range(3000)]
    seen = []
    monkeypatch.setattr(secrets, "_scored", lambda token, cls, alphabets: seen.append(token) or ("", cls, 0.0))
    for text in (" ".join(words), "1234 " * 1000 + " ".join(words[:9]), "ab " * 10, "ab " * 9):
        seen.clear()
        got = secrets.word_decoys(text, 20)
        joined = "".join(w for w in text.split() if w.isalpha())
        assert "".join(seen) == joined * (len(joined) >= 20) and all(len(t) >= 20 for t in seen)
        assert [x[3] for x in got] == [secrets.LETTERS + sum(len(t) >= x for x in secrets.LENGTH_CLASSES) for t in seen] and all(x[5] for x in got)


def test_randomness():
    r = random.Random(4)
    p = [secrets.randomness("".join(r.choice("0123456789abcdef") for _ in range(64)))[1] for _ in range(400)]
    assert 0.02 < np.mean(np.array(p) < 0.1) < 0.25
    assert secrets.randomness("thethingofothersandthenothingelseeverthere")[1] < 0.01 and secrets.encoding_of("QRSTU234")[0] == "base32"
    assert re.fullmatch("hex", secrets.encoding_of("12ab")[0])
