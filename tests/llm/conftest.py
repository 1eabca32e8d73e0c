import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (900, None, None, None, None),
    (901, "", "en", "s", 0),
    (902, " \t\n\r\n", "en", None, 6),
    (903, "word " * 30000, "en", "s", 150000),
    (904, "é" * 5000 + "\n" + "漢字 かな▁ x", None, "s", 1),
    (905, "x", "de", "s", 1),
    (905, "x", "de", "s", 1),
]


def sentence(r, n, words=400):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Texts of several lines, with exact copies, near copies and shared lines."""
    r = random.Random(seed)
    shared = [sentence(r, 14) for _ in range(4)]
    rows = []
    for i in range(n):
        lines = [sentence(r, r.randrange(4, 30)) for _ in range(r.randrange(3, 9))]
        if r.random() < 0.5:
            lines.insert(r.randrange(len(lines)), r.choice(shared))
        text = "\n".join(lines)
        if rows and r.random() < 0.4:
            text = r.choice(rows)[1]
            for _ in range(r.randrange(0, 4)):
                w = text.split(" ")
                w[r.randrange(len(w))] = "edited" + str(r.randrange(9))
                text = " ".join(w)
        rows.append((i, text, r.choice(["en", "de", None]), f"s{r.randrange(3)}", len(text)))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """The made corpus and odd rows, with columns whose names the operators use inside."""
    return with_clashes(spark.createDataFrame(corpus() + ODD, DOCS))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def with_clashes(df):
    for c in ("k", "at", "pos", "line", "norm", "h1", "comp", "member", "text_hash", "host", "words", "license", "pieces", "lines_removed", "digest", "shard", "rows", "base"):
        df = df.selectExpr("*", f"doc_id * 2 AS {c}")
    return df
