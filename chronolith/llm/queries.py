"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import language, licenses, lines, maintext, ngramjoin, pieces, quality, secrets, sharding, tiling
from chronolith.llm.store import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    found = ngramjoin.grouped(table(spark, d, "documents").select("doc_id", "text"), n=4, percent=85)
    return found.withColumnRenamed("n_members", "n_shingles")


def op2_sharding(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sharding.assign(docs, shards=24).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op3_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    found = secrets.scan(table(spark, d, "documents").select("doc_id", "text"))

    def count(k: int) -> Column:  # k from outside the lambda: a second parameter would get the element's place
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")

    n = [count(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *n, F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"))


def op4_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Every document that covers half of a benchmark item or more, with the item."""
    return tiling.match(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))


def op5_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return lines.dedup(table(spark, d, "documents").select("doc_id", "text"), **lines.ANY_LENGTH)


def op6_main_text(spark: SparkSession, d: str) -> DataFrame:
    out = maintext.extract(table(spark, d, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def op7_license_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = licenses.scan(table(spark, d, "documents").select("doc_id", "text"))
    x = F.col("license")
    return docs.select(
        "doc_id",
        *[x[c].alias(c) for c in ("n_words", "n_base", "first_word", "last_word")],
        F.array_join(x["base_labels"], ",").alias("base_labels"),
        F.array_join(x["labels"], ",").alias("labels"),
        x["score"].alias("score"),
    )


def op8_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.fit(docs.filter(~held_out))
    return language.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op9_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return quality.assess(docs).drop("text_hash")


def op10_pieces(spark: SparkSession, d: str) -> DataFrame:
    out = pieces.encode(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), "lossless", "pieces")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_sharding, op3_secret_scan, op4_decontamination, op5_line_dedup, op6_main_text, op7_license_scan, op8_language_id, op9_quality_rules, op10_pieces)}


#: Characters that part words, as the SQL patterns have them.
SQL_BREAKS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _ngram_sql(n: int, percent: int) -> str:
    """All pairs that share a shingle, counted; components by reachability."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({SQL_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END) AS g FROM w),
s AS MATERIALIZED (SELECT doc_id, unnest(g) AS h FROM g),
k AS MATERIALIZED (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM g),
o AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM o JOIN k a ON a.doc_id = x JOIN k b ON b.doc_id = y WHERE 100 * o >= {percent} * (a.n + b.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.c = l.x),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT k.doc_id, n AS n_shingles, component_id FROM k JOIN m ON k.doc_id = m.doc_id"""


def _license_sql(threshold: float = 0.9, slack: float = 1.25) -> str:
    """Every window of a template's length, in the texts that hold enough of its words at all."""
    rows = []
    for label, t in licenses.TEMPLATES:
        words = licenses.word_list(t)
        rows.append(f"('{label}', {words!r}, {licenses.window(t, slack)})")
    base = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()!r})) - 1 AS spot FROM w" for p, label in licenses.PHRASES.items()
    )
    return f"""
WITH t(label, words, n) AS (VALUES {', '.join(rows)}),
w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({SQL_LOWER}, '[^{SQL_BREAKS}]+') AS w FROM documents),
b AS MATERIALIZED ({base}),
bb AS (SELECT doc_id, count(*) AS n, min(spot) AS f, max(spot) AS l, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM b GROUP BY 1),
c AS MATERIALIZED (SELECT doc_id, label, words, n, w, unnest(range(1, len(w) + 1)) AS i FROM w, t WHERE len(list_intersect(list_distinct(w), words)) >= {threshold} * len(words) - 1e-9),
h AS (SELECT doc_id, label, len(list_intersect(w[i:i + n - 1], words)) / len(words) AS share FROM c WHERE list_contains(words, w[i])),
k AS MATERIALIZED (SELECT doc_id, label, share FROM h WHERE share >= {threshold} - 1e-9),
a AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM (SELECT doc_id, label FROM b UNION ALL SELECT doc_id, label FROM k) GROUP BY 1),
s AS (SELECT doc_id, max(share) AS share FROM k GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(bb.n, 0) AS n_base, bb.f AS first_word, bb.l AS last_word, coalesce(bb.labels, '') AS base_labels,
  coalesce(a.labels, '') AS labels, CASE WHEN bb.n > 0 THEN 1.0 ELSE coalesce(s.share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN bb USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)"""


def _quality_sql(min_words: int = 50, min_docs: int = 20, share: float = 0.001, max_lost: float = 0.7) -> str:
    """Documents are distinct (id, host, text), numbered by k."""
    space = r"[\x20\x09-\x0D]+"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, * FROM (SELECT doc_id, source, coalesce(text, '') AS text, count(*) AS copies FROM documents GROUP BY ALL)),
w AS (SELECT k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
g AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
r AS (SELECT k, count(DISTINCT p) AS r FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
l AS (SELECT k, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
n AS MATERIALIZED (SELECT k, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{space}', ' ', 'g')) AS line FROM (SELECT k, unnest(l) AS line FROM l)),
h AS (SELECT source, count(*) AS total FROM d GROUP BY 1),
f AS (SELECT d.source, line, min(doc_id) AS holder, count(DISTINCT k) AS held FROM n JOIN d USING (k) GROUP BY 1, 2),
b AS (SELECT f.source, line, holder FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE held > {min_docs} AND held > {share} * total),
z AS (SELECT k, sum(len(string_split(n.line, ' ')))::BIGINT AS lost FROM n JOIN d USING (k) JOIN b ON b.source IS NOT DISTINCT FROM d.source AND b.line = n.line WHERE doc_id <> holder GROUP BY 1),
o AS (SELECT doc_id, copies, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{space}', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r, 0) AS n_repeat_words,
  (len(w) < {min_words} OR 100 * coalesce(r, 0) > 50 * len(w)) AS base_failed, coalesce(lost, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (k) JOIN l USING (k) LEFT JOIN r USING (k) LEFT JOIN z USING (k))
SELECT * EXCLUDE (copies, c), NOT base_failed AND removed_words <= {max_lost} * n_words AS kept FROM (SELECT *, unnest(range(copies)) AS c FROM o)"""


def oracle_sql() -> dict[str, str]:
    """The other operators' SQL would be no SQL: they are tested against brute force in tests/llm."""
    return {"op1_ngram_jaccard_join": _ngram_sql(4, 85), "op7_license_scan": _license_sql(), "op9_quality_rules": _quality_sql()}
