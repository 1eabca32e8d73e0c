"""Time-clustered layouts.

In memory: range-partitioned by period and key and sorted, so that the minima
and maxima kept for each cached batch prune a search.  On disk: directories by
period and a JSON manifest; the search adds the period conjunct itself.

Intervals have one more level of directories above, by the power of two of their
length: those that can meet a window began at most that long before it, so a few
long ones cost the short ones nothing, and both ends prune.  Where an end is no
calendar instant the length is unknown; such rows are looked at whatever the
window's start.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.functions.encoding import Instant, decode, divisor, encode, is_calendar, kind_of, to_datetime, to_encoded

PERIOD, SPAN = "__period", "__span"
#: Lengths of unknown size.
UNKNOWN = 99


def cluster(df: DataFrame, columns: list[str], partitions: int | None = None, period: str = "month") -> DataFrame:
    """Range-partitioned by period and first column, and sorted.  Without a count, AQE sizes the partitions."""
    key = df[columns[0]]
    by = (_bucket(df, columns[0], period), key) if is_calendar(kind_of(df, columns[0])) or isinstance(kind_of(df, columns[0]), T.IntegralType) else (key,)
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*columns)


def in_memory(df: DataFrame, columns: list[str], partitions: int | None = None, level: StorageLevel | None = None, period: str = "month") -> DataFrame:
    return cluster(df, columns, partitions, period).persist(level or StorageLevel.MEMORY_AND_DISK)


@dataclass
class Manifest:
    name: str
    index_type: str
    columns: list[str]
    period: str
    spans: list[int]  # the powers of two of the intervals' lengths in seconds; empty for points
    schema: str


def _digits(df: DataFrame, c: str):
    return encode(df[c]) if is_calendar(kind_of(df, c)) else df[c]


def _instant(df: DataFrame, c: str):
    return df[c].cast("timestamp_ntz") if is_calendar(kind_of(df, c)) else decode(df[c])


def _bucket(df: DataFrame, c: str, period: str):
    return F.call_function("div", _digits(df, c), F.lit(divisor(period)).cast("bigint"))


def _span(df: DataFrame, columns: list[str]):
    st, ed = (F.unix_timestamp(_instant(df, c).cast("timestamp")) for c in columns)
    return F.when((ed - st).isNotNull(), F.floor(F.log2(F.greatest(ed - st, F.lit(0)) + 2)).cast("int")).otherwise(UNKNOWN)


def write(df: DataFrame, path: str, name: str, index_type: str, columns: list[str], period: str) -> Manifest:
    """Parquet under ``path``, one directory for each period of the first column, for intervals below their lengths."""
    keys, out = [PERIOD], df.withColumn(PERIOD, _bucket(df, columns[0], period))
    if len(columns) > 1:
        keys, out = [SPAN, PERIOD], out.withColumn(SPAN, _span(df, columns))
    # Range partitioning by period and all columns of the key splits a large period over tasks and sorts files for row-group pruning.
    out = out.repartitionByRange(*keys, *columns).sortWithinPartitions(*keys, *columns)
    out.write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/data")
    spans: list[int] = []
    if len(columns) > 1:  # at most a hundred, from the names of directories
        data = df.sparkSession.read.schema(T.StructType([*df.schema, T.StructField(SPAN, T.IntegerType()), T.StructField(PERIOD, T.LongType())])).parquet(f"{path}/data")
        spans = sorted(r[0] for r in data.select(SPAN).distinct().collect())
    m = Manifest(name, index_type, columns, period.lower(), spans, df.schema.json())
    df.sparkSession.createDataFrame([(json.dumps(asdict(m)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return m


def read(spark: SparkSession, path: str) -> tuple[DataFrame, Manifest]:
    m = Manifest(**json.loads(spark.read.text(f"{path}/manifest").first()[0]))
    schema = T.StructType.fromJson(json.loads(m.schema))
    if len(m.columns) > 1:
        schema = schema.add(SPAN, T.IntegerType())
    schema = schema.add(PERIOD, T.LongType())
    return spark.read.schema(schema).parquet(f"{path}/data"), m


def prune(df: DataFrame, m: Manifest, start: Instant, end: Instant) -> DataFrame:
    """The directories that can hold rows of the window.

    Exact: a row that meets it begins at most its length before its start.
    Bounds that are no calendar instant prune only a point layout.
    """
    low, high, by = to_encoded(start), to_encoded(end), divisor(m.period)
    period = F.col(PERIOD)
    if len(m.columns) == 1:
        return df.filter(period.between(low // by, high // by))
    at = to_datetime(start)
    if at is None:
        return df
    keep = F.lit(False)
    for span in m.spans:
        try:
            first = 0 if span == UNKNOWN else to_encoded(at - timedelta(seconds=1 << (span + 1)))
        except OverflowError:
            first = 0
        own = (F.col(SPAN) == span) & (period <= high // by)
        keep = keep | (own & (period >= first // by) if first else own)
    return df.filter(keep)
