"""Quality rules with cross-document line frequency (DataFrame functions only).

Each document has plain counts (words, symbols, repeated lines, words in
repeated three-word windows), and a verdict by line frequency: lines are
normalised (ASCII lower case, runs of white space as one space), hashed, and
counted by distinct documents for each host.  A line above the host's limit,
more than ``min_docs`` documents and more than ``share`` of the host's, is
removed from every document of the host but the earliest that holds it; a
document that loses more than ``max_lost`` of its words so is depleted, and
rejected.  ``kept`` returns the others without those lines.

Rules: a document is what is equal in id, host and text: repeated rows count
once and share a verdict, and one id may have several documents, in one host or
more, each judged by itself.  Null text counts as empty, and a null host is a
host of its own, as is a null id an id.  Of documents with a line, the one with
the smallest id is the earliest; all of that id keep the line.  Texts without a
word have zero counts and fail the base rule.  Texts of any length are read
whole.  An empty table gives none.  ``kept`` returns the columns as they are,
whatever their names; ``assess`` returns its own.

Nothing is capped: a line's documents are counted by partial sums, so a line
that a third of all rows hold costs one row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.store import SPACE_RUN, SPACES, ascii_lower, bind, saved

#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""

    def covered(w: Column) -> Column:
        n = F.size(w)
        grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

        def marked(g: Column) -> Column:
            pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def spread(s: Column) -> Column:
                again = lambda j: F.get(s, j)["h"]
                hit = F.filter(
                    F.sequence(F.lit(0), F.size(s) - 1),
                    lambda j: ((j > 0) & again(j).eqNullSafe(again(F.greatest(j - 1, F.lit(0))))) | again(j).eqNullSafe(again(j + 1)),
                )
                at = F.transform(hit, lambda j: F.get(s, j)["i"])
                return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

            return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(bind(pairs, spread))

        return F.when(n < 3, F.lit(0)).otherwise(bind(grams, marked))

    return bind(words, covered)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def _norm(line: Column) -> Column:
    return F.regexp_replace(ascii_lower(F.btrim(line, F.lit(SPACES))), SPACE_RUN, " ")


def counts(docs: DataFrame, text_col: str = "text") -> dict[str, Column]:
    text = F.coalesce(docs[text_col], F.lit(""))
    dup = bind(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    both = bind(words_of(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    return {
        "word_counts": both,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": dup.cast("bigint"),
    }


def _text_hash(docs: DataFrame, text_col: str) -> Column:
    return F.xxhash64(F.coalesce(docs[text_col], F.lit("")))


def _documents(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(doc_id, host, text_hash, rows) of each document."""
    own = docs.select(docs[id_col].alias("doc_id"), docs[host_col].alias("host"), _text_hash(docs, text_col).alias("text_hash"))
    return own.groupBy("doc_id", "host", "text_hash").agg(F.count(F.lit(1)).alias("rows"))


def _own_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row for each document and distinct normalised line, with the words of all its places in all rows."""
    text = F.coalesce(docs[text_col], F.lit(""))
    n_words = F.length(F.col("norm")) - F.length(F.replace(F.col("norm"), F.lit(" "), F.lit(""))) + 1
    each = docs.select(docs[id_col].alias("doc_id"), docs[host_col].alias("host"), _text_hash(docs, text_col).alias("text_hash"), F.explode(_lines(text)).alias("line")).withColumn("norm", _norm(F.col("line")))
    keyed = each.select("doc_id", "host", "text_hash", F.xxhash64("norm").alias("h1"), F.crc32("norm").alias("h2"), n_words.cast("bigint").alias("words"))
    return keyed.groupBy("doc_id", "host", "text_hash", "h1", "h2").agg(F.sum("words").alias("words"))


def line_limits(lines: DataFrame, documents: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(host, h1, h2, holder) of the lines that more documents of a host hold than its limit."""
    held = lines.groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("held"), F.min("doc_id").alias("holder"))
    often = held.filter(F.col("held") > min_docs)
    hosts = documents.groupBy(F.col("host").alias("k")).agg(F.count(F.lit(1)).alias("docs"))
    return often.join(hosts, often["host"].eqNullSafe(hosts["k"])).filter(F.col("held") > F.col("docs") * share).select("host", "h1", "h2", "holder")


def assess(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat: float = 0.5,
    min_docs: int = 20,
    share: float = 0.001,
    max_lost: float = 0.7,
) -> DataFrame:
    """Counts, removed words and verdict of every row; rows of equal id, host and text share them."""
    return _assessed(docs, id_col, text_col, host_col, min_words, max_repeat, min_docs, share, max_lost).drop("gone", "host")


def _assessed(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_words: int, max_repeat: float, min_docs: int, share: float, max_lost: float) -> DataFrame:
    """As ``assess``, and ``host`` and ``gone``: keys of the lines to remove."""
    documents = saved(_documents(docs, id_col, text_col, host_col), "quality_documents")
    lines = saved(_own_lines(docs, id_col, text_col, host_col), "quality_lines")
    limits = saved(line_limits(lines, documents, min_docs, share), "quality_limits").withColumnsRenamed({"host": "k", "h1": "k1", "h2": "k2"})
    hits = lines.join(limits, lines["host"].eqNullSafe(limits["k"]) & (lines["h1"] == limits["k1"]) & (lines["h2"] == limits["k2"]))
    hits = hits.filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    key = ("doc_id", "host", "text_hash")
    lost = hits.groupBy(*key).agg(F.sum("words").alias("lost"), F.collect_set(F.struct("h1", "h2")).alias("gone"))
    lost = _matched(lost, documents.filter("rows > 1"), key, "rows").withColumn("lost", F.col("lost") / F.coalesce("rows", F.lit(1)))
    c = counts(docs, text_col)
    own = docs.select(docs[id_col].alias("doc_id"), docs[host_col].alias("host"), _text_hash(docs, text_col).alias("text_hash"), *[v.alias(k) for k, v in c.items()])
    out = _matched(own, lost, key, "lost", "gone")
    n, r, gone = F.col("word_counts.n").cast("bigint"), F.col("word_counts.r").cast("bigint"), F.coalesce(F.col("lost"), F.lit(0)).cast("bigint")
    failed = (n < min_words) | (r > n * max_repeat)
    return out.select(
        "doc_id",
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        r.alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (gone <= n * max_lost)).alias("kept"),
        gone.alias("removed_words"),
        "text_hash",
        "host",
        "gone",
    )


def _matched(left: DataFrame, right: DataFrame, key: tuple[str, ...], *columns: str) -> DataFrame:
    """``left`` with these columns of the row of ``right`` that has its key, nulls being equal."""
    right = right.select(*[F.col(k).alias(f"__{k}") for k in key], *columns)
    same = F.lit(True)
    for k in key:
        same = same & left[k].eqNullSafe(right[f"__{k}"])
    return left.join(right, same, "left").drop(*[f"__{k}" for k in key])


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines of these keys."""
    key = lambda line: bind(_norm(line), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.crc32(x).alias("h2")))
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(gone, key(x))), "\n")


def kept(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat: float = 0.5,
    min_docs: int = 20,
    share: float = 0.001,
    max_lost: float = 0.7,
) -> DataFrame:
    """The rows of ``docs`` that pass, without the lines above their host's limit; the earliest holder keeps them."""
    found = _assessed(docs, id_col, text_col, host_col, min_words, max_repeat, min_docs, share, max_lost)
    key = ("doc_id", "text_hash", "host")
    marks = found.filter(~F.col("kept") | F.col("gone").isNotNull()).select(*key, "kept", "gone").dropDuplicates(list(key))
    marks = marks.select(*[F.col(c).alias(f"__{c}") for c in marks.columns])
    own = {"doc_id": docs[id_col], "text_hash": _text_hash(docs, text_col), "host": docs[host_col]}
    same = F.lit(True)
    for k in key:
        same = same & own[k].eqNullSafe(F.col(f"__{k}"))
    both = docs.join(marks, same, "left").filter(F.coalesce("__kept", F.lit(True)))
    text = F.when(F.col("__gone").isNull(), docs[text_col]).otherwise(_without(docs[text_col], F.col("__gone")))
    return both.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
