"""Documents to tokens: quality rules, line copies, near copies, benchmark leaks, pieces.

Each stage takes what its predecessor kept, as documents, and returns documents;
the last adds their pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import lines, ngramjoin, pieces, quality, tiling
from chronolith.llm.store import SPACES, saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and lines above their host's limit."""
    return quality.kept(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier elsewhere go, and documents of which nothing is left."""
    out = lines.dedup(docs, **lines.ANY_LENGTH)
    left = F.btrim("text", F.lit(SPACES)) != ""
    return out.filter((F.col("lines_removed") == 0) | left).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngramjoin.one_of_each(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their pieces."""
    return pieces.encode(docs.select(*COLUMNS))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", decontamination),
    ("pieces", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
