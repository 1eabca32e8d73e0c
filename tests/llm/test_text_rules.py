"""Quality rules, line copies and licences against plain Python, odd rows included."""

import random
import re
from collections import Counter, defaultdict

from chronolith.llm import licenses, lines, quality

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    covered = {j for i, x in enumerate(g) if c[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts(docs):
    got = {r["doc_id"]: tuple(r[1:6]) for r in quality.assess(docs).collect()}
    want = {r["doc_id"]: counts(r["text"] or "") for r in docs.collect()}
    assert got == want


def test_quality_depleted(spark):
    fresh = lambda i: " ".join(f"own{i}x{j}" for j in range(60))
    plate = "\n".join(" ".join(f"plate{j}y{k}" for k in range(20)) for j in range(4))
    rows = [(i, plate, "h") for i in range(10)] + [(10 + i, plate + "\n" + fresh(i) + "\n" + fresh(i + 50), "h") for i in range(5)] + [(20, plate, "other"), (5, plate, "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in quality.assess(df, min_docs=3, share=0.01).collect()}
    assert got[0]["kept"] and got[0]["removed_words"] == 0
    assert all(not got[i]["kept"] and got[i]["removed_words"] == 80 for i in range(1, 10))
    assert all(got[10 + i]["kept"] and got[10 + i]["removed_words"] == 80 for i in range(5)) and got[20]["kept"]
    assert sorted(r["doc_id"] for r in quality.kept(df, min_docs=3, share=0.01).collect()) == [0, 10, 11, 12, 13, 14, 20]


def assessed(rows, min_docs=20, share=0.001, max_lost=0.7):
    """(removed words, kept) of each document (id, host, text), by the definition."""
    docs = dict.fromkeys((i, h, t or "") for i, t, h in rows)
    norm = lambda line: " ".join(WORD.findall(line.translate(LOW)))
    held, total = defaultdict(set), Counter(h for _, h, _ in docs)
    for d in docs:
        for line in d[2].split("\n"):
            if norm(line):
                held[d[1], norm(line)].add(d)
    above = {k: min(d[0] for d in v) for k, v in held.items() if len(v) > min_docs and len(v) > share * total[k[0]]}
    out = {}
    for i, h, t in docs:
        lost = sum(len(norm(x).split()) for x in t.split("\n") if above.get((h, norm(x)), i) != i)
        n, *_, again = counts(t)
        out[i, h, t] = lost, n >= 50 and 2 * again <= n and lost <= max_lost * n
    return out


def test_quality_verdicts(spark):
    """Repeated rows, ids with several texts, one text in several hosts, both sides of the limits."""
    import random

    r = random.Random(9)
    plates = [" ".join(f"plate{j}y{k}" for k in range(r.randrange(1, 25))) for j in range(8)]
    rows = []
    for i in range(260):
        own = [" ".join(f"own{i}x{j}w{k}" for k in range(r.randrange(1, 20))) for j in range(r.randrange(1, 6))]
        some = r.choices(plates, k=r.randrange(0, 9))
        rows.append((i % 230, "\n".join(r.sample(own + some, len(own + some))), r.choice(["a", "a", "b", None])))
    rows += [(500 + i, "\n".join(plates), "c") for i in range(30)] + [(500, "\n".join(plates), "d")] + rows[:40] + rows[100:110] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "doc_id AS host", "doc_id AS gone", "doc_id AS rows")
    for limits in ({}, {"min_docs": 3, "share": 0.3}, {"min_docs": 1, "share": 0.0, "max_lost": 0.3}):
        want = assessed(rows, **limits)
        got = quality.assess(df, **limits)
        assert sorted((x["doc_id"], x["removed_words"], x["kept"]) for x in got.collect()) == sorted((i, *want[i, h, t or ""]) for i, t, h in rows)
        left = Counter(x["doc_id"] for x in quality.kept(df, **limits).collect())
        assert left == Counter(i for i, t, h in rows if want[i, h, t or ""][1])
        assert any(not k and n for n, k in want.values()) or not limits


def test_quality_two_hosts(spark):
    text = "\n".join(" ".join(f"w{j}x{k}" for k in range(20)) for j in range(3))
    df = spark.createDataFrame([(i, text, "a") for i in range(30)] + [(29, text, "b")], "doc_id bigint, text string, source string")
    got = sorted((r["doc_id"], r["removed_words"], r["kept"]) for r in quality.assess(df).collect())
    assert got == [(0, 0, True), *[(i, 60, False) for i in range(1, 29)], (29, 0, True), (29, 60, False)]


def test_quality_lines_go(spark):
    """Lines above the limit leave the text of all but the earliest holder, in the pipeline too."""
    import corpus_pipeline

    fresh = lambda i: " ".join(f"own{i}x{j}" for j in range(60))
    rows = [(i, f"All rights  reserved.\n\n{fresh(i)}\n ALL RIGHTS reserved.\nlast{i}", "en", host, 1) for i, host in [(i, "h") for i in range(25)] + [(50, "other"), (51, None)]]
    rows += [(3, *rows[3][1:]), (60, fresh(60), "en", "h", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = sorted((i, t if i in (0, 50, 51, 60) else f"\n{fresh(i)}\nlast{i}") for i, t, *_ in rows)
    assert sorted((r["doc_id"], r["text"]) for r in quality.kept(df).collect()) == want
    got = corpus_pipeline.quality_rules(spark, df, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == want and all(r["n_chars"] == len(r["text"]) for r in got)


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def deduped(rows, least=5, near_from=10):
    first, spots = {}, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        for p, line in enumerate((text or "").split("\n")):
            w = tuple(WORD.findall(line.translate(LOW)))
            if len(w) >= least:
                spots.append((i, p, w))
                first.setdefault(w, (i, p))
    long = [w for w in first if len(w) >= near_from]
    near = {x for x in long for y in long if x != y and first[y] < first[x] and one_edit(x, y)}
    gone = defaultdict(set)
    for i, p, w in spots:
        if w in near or first[w] != (i, p):
            gone[i].add(p)
    return {i: (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[i]), len(gone[i])) for i, t in rows}


def test_lines(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in lines.dedup(docs).collect()}
    assert got == deduped(dict(rows).items()) and sum(v[1] for v in got.values()) > 20


def test_line_edits(spark):
    base = "the quick brown fox jumps over the lazy dog again today".split()
    rows = [(0, " ".join(base)), (1, " ".join(base[:3] + ["new"] + base[4:])), (2, " ".join(base[:5] + base[6:])), (3, " ".join(["put"] + base)), (4, " ".join(base[::-1])), (5, "short line"), (6, "short line"), (7, " ".join(base + ["a", "b"]))]
    rows += [(8, "a a a a a a b b b b b b"), (9, "a a a a a b b b b b b"), (10, " ".join(base).upper())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["lines_removed"] for r in lines.dedup(df).collect()}
    assert got == {i: v[1] for i, v in deduped(rows).items()}
    assert [i for i, n in got.items() if n] and got[4] == got[6] == got[7] == 0 and got[1] == got[2] == got[3] == got[9] == got[10] == 1


def test_lines_any_length(spark, docs, monkeypatch):
    """The query takes short lines and scripts without spaces."""
    from chronolith.llm import queries

    rows = [(0, "All rights reserved.\nles.\n\none two three four five\na b c d"), (1, "ALL  rights reserved.\nLes.\n\none two three 4 five\na b c e"), (2, "les.\none two three four five six"), (3, "你好世界今天天气很好\n你好世界"), (4, "你好世界明天天气很好\n你好世间\nสวัสดี"), (5, "你好世界\nสวัสดี"), (6, None)]
    want = {0: 0, 1: 3, 2: 2, 3: 0, 4: 1, 5: 2, 6: 0}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in queries.op5_line_dedup(spark, "").collect()}
    assert {i: v[1] for i, v in got.items()} == want and got[1][0] == "\na b c e" and got[4][0] == "你好世间\nสวัสดี"
    pairs = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] != 904}
    got = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in lines.dedup(docs.filter("doc_id != 904"), **lines.ANY_LENGTH).collect()}
    assert got == deduped(pairs.items(), 1, 5)


def test_line_gaps(spark, monkeypatch):
    """Lines that share one half leave out words of the other half only."""
    made = {}
    keep = lines.saved
    monkeypatch.setattr(lines, "saved", lambda df, name: made.setdefault(name, keep(df, name)))
    monkeypatch.setattr(lines, "dropped", lambda *_: None)
    base = [f"w{i}" for i in range(20)]
    df = spark.createDataFrame([(0, " ".join(base)), (1, " ".join(base[:-1] + ["other"]))], "doc_id bigint, text string")
    assert sorted(r["lines_removed"] for r in lines.dedup(df, **lines.ANY_LENGTH).collect()) == [0, 1]
    n = Counter(r["role"] for r in made["line_variants"].collect())
    assert n == {0: 2 * 11, 1: 2 * 11, 2: 2}


def test_line_gaps_lose_nothing(spark):
    """Lines of all lengths from few words, so that edits can be placed in several ways, with capitals, accents and odd spaces."""
    r = random.Random(5)
    made = []
    for _ in range(400):
        w = list(r.choice(made)) if made and r.random() < 0.6 else [r.choice("aBcÉé") for _ in range(r.randrange(1, 14))]
        for _ in range(r.randrange(3)):
            i = r.randrange(len(w))
            w[i : i + r.randrange(2)] = r.choice([[], ["a"], ["É"], ["z9"]])
            w = w or ["a"]
        made.append(w)
    spaced = lambda w: r.choice(["", "", " ", "\t"]) + "".join(x + r.choice([" "] * 9 + ["  ", "\t", "\r", "\x0b"]) for x in w)
    rows = [(i, "\n".join(spaced(w) for w in made[i * 4 : i * 4 + 4])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for least, near_from in ((1, 5), (1, 2)):
        got = {x["doc_id"]: (x["text"], x["lines_removed"]) for x in lines.dedup(df, min_words=least, near_words=near_from).collect()}
        assert got == deduped(rows, least, near_from)


def test_licenses(spark):
    rows = [
        (0, "Foo\nReleased under the MIT License.\nbar"),
        (1, "mit license MIT-License"),
        (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without any restriction"),
        (3, "all the rights are ours and reserved, " + " ".join(f"filler{i}" for i in range(20)) + " all rights reserved"),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "gnu general public license"),
        (6, None),
        (7, ""),
        (8, "Ünder the gnu\x00general public\tlicense 2"),
    ]
    df = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r["doc_id"]: r["license"] for r in df.collect()}
    assert got[0]["labels"] == ["mit"] and (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"]) == (1, 4, 4)
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["n_words"]) == (2, 0, 2, 4)
    assert got[2]["labels"] == ["mit"] and got[2]["n_base"] == 0 and got[2]["first_word"] is None and 0.9 <= got[2]["score"] <= 1
    assert got[3]["labels"] == ["proprietary"] and [(b["first_word"], b["share"]) for b in got[3]["blocks"]] == [(27, 1.0)]
    assert got[4]["base_labels"] == ["cc-by"] and got[4]["labels"] == ["cc-by", "cc-by-nc"]
    assert got[5]["score"] == 1.0 and got[6]["n_words"] == got[7]["n_words"] == 0
    assert (got[8]["first_word"], got[8]["n_words"]) == (2, 7)


def license_labels(text, threshold=0.9):
    """Labels and best share of all windows, by the definition."""
    w = [x for x in re.split(licenses.BREAKS, text.translate(LOW)) if x]
    found = {x for p, x in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}
    base, best = bool(found), 0.0
    for label, t in licenses.TEMPLATES:
        own, n = set(licenses.word_list(t)), licenses.window(t)
        share = max((len(own & set(w[i : i + n])) / len(own) for i in range(len(w))), default=0)
        if share >= threshold - 1e-9:
            found.add(label)
            best = max(best, share)
    return sorted(found), 1.0 if base else best


def test_license_windows(spark):
    """Notices wrapped, in comments, inside long lines, with words lost or put in, against all windows."""
    import random

    r = random.Random(7)
    common = "the of and to in is that for it as was with be by on not he this are or all rights use".split()
    rows = [(0, "# Permission is hereby granted, free of charge, to any\n# person obtaining a copy of this software and associated\n# documentation files (the Software), to deal in the\n#  Software without restriction"), (1, ""), (2, " \t--"), (3, "reserved " * 3000), (4, "all the rights that one has are reserved")]
    for i in range(5, 120):
        label, t = r.choice(licenses.TEMPLATES)
        w = t.split()
        for _ in range(r.randrange(0, 5)):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = [r.choice(common)]
        before, after = ([r.choice([*common, f"f{r.randrange(99)}"]) for _ in range(r.randrange(0, 60))] for _ in range(2))
        rows.append((i, "".join(x + r.choice(" \n") for x in before + w + after)))
    df = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "doc_id AS license", "doc_id AS words"))
    got = {x["doc_id"]: (x["license"]["labels"], round(x["license"]["score"], 9)) for x in df.collect()}
    want = {i: license_labels(t) for i, t in rows}
    assert got == {i: (a, round(b, 9)) for i, (a, b) in want.items()} and got[0][0] == ["mit"] and got[4][0] == []
    assert 60 < sum(bool(a) for a, _ in got.values()) < 118 and df.columns == ["doc_id", "text", "license", "words"]


def test_empty(nothing):
    assert quality.assess(nothing).count() == 0 and lines.dedup(nothing).count() == 0 and licenses.scan(nothing).count() == 0
