"""Tables written to the folder that driver and executors share, and helpers that several operators use."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Only where the session names no folder and all tasks run on one machine, as in local tests.
LOCAL_DEFAULT = "/tmp/checkpoints/chronolith"

#: The white space that ends a word, and the same as a pattern.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names: spark.checkpoint.dir, else the context's checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and hasattr(spark, "_jsc"):
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_DEFAULT
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    return path


_written: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


def discard(*paths: str) -> None:
    """Deletes folders that nothing reads any more; without a JVM at hand they stay."""
    for path in paths:
        spark = _written.pop(path, None)
        if spark is not None and getattr(spark, "_jsc", None) is not None:
            _delete(spark, path)


def _clean() -> None:
    for path in list(_written):
        try:
            discard(path)
        except Exception:  # the session has ended; its folders go with the cluster's checkpoint folder
            return


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written once and read back: cuts the lineage, survives the loss of executors, is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    released(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes what ``saved`` wrote for frames that nothing reads any more."""
    discard(*[f.scratch_path for f in frames])


def released(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now, not when the driver happens to collect its garbage."""
    gc.collect()
    if hasattr(spark, "_jvm"):
        spark._jvm.System.gc()


def whole_id(docs: DataFrame, id_col: str) -> Column:
    """The id as BIGINT; ids of other types than whole numbers are refused here, not by a failing task."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col!r} must be a whole number, not {docs.schema[id_col].dataType.simpleString()}")
    return docs[id_col].cast("bigint")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def bind(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: inside a lambda an expression is computed anew for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def small_batches(spark: SparkSession, most: str = "16m") -> None:
    """Batches for Python of so many bytes at most, as rows hold whole texts.  A session with a smaller bound keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).lower()
    digits = now.rstrip("bkmgt")
    size = int(digits or -1) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}.get(now.rstrip("b")[-1:], 1)
    if not 0 < size <= 16 << 20:
        spark.conf.set(key, most)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
