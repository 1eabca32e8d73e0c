"""Named layouts of source frames: create, list, look up, re-level, drop, persist, load."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from enum import Enum

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from chronolith.functions.encoding import divisor
from chronolith.sources import layout


class IndexType(Enum):
    HASH = "hash"
    STEID = "steid"
    INTERVAL_TREE = "interval_tree"

    @classmethod
    def parse(cls, x: str | IndexType) -> IndexType:
        if isinstance(x, cls):
            return x
        folded = str(x).lower().replace("type", "").replace("_", "").replace("interval", "intervaltree")
        for kind in cls:
            if folded.replace("treetree", "tree") == kind.value.replace("_", ""):
                return kind
        raise ValueError(f"unknown index type {x!r}")


@dataclass
class IndexInfo:
    name: str
    table: str
    columns: list[str]
    index_type: IndexType
    period: str
    source: DataFrame = field(repr=False)
    data: DataFrame = field(repr=False)
    level: StorageLevel = field(default_factory=lambda: StorageLevel.MEMORY_AND_DISK)
    location: str = ""
    manifest: layout.Manifest | None = None


class IndexRegistry:
    """Several indexes for each source; a source is known by its analysed plan."""

    def __init__(self, spark: SparkSession):
        self.spark, self._all, self._lock = spark, [], threading.RLock()

    def create(
        self,
        df: DataFrame,
        index_type: str | IndexType,
        name: str,
        columns: list[str],
        period: str = "month",
        partitions: int | None = None,
        table: str = "",
        level: StorageLevel = StorageLevel.MEMORY_AND_DISK,
    ) -> IndexInfo:
        kind = IndexType.parse(index_type)
        divisor(period)
        need = 1 if kind is IndexType.HASH else 2
        if len(columns) != need or any(c not in df.columns for c in columns):
            raise ValueError(f"a {kind.value} index needs {need} of the columns {df.columns}, not {columns}")
        with self._lock:
            if self.has(df, name):
                raise ValueError(f"this source has an index {name!r} already")
            info = IndexInfo(name, table, list(columns), kind, period, df, layout.in_memory(df, columns, partitions, level, period), level)
            self._all.append(info)
            return info

    def of(self, df: DataFrame) -> list[IndexInfo]:
        with self._lock:
            return [x for x in self._all if x.source is df or x.source.sameSemantics(df)]

    def lookup(self, df: DataFrame, name: str | None = None, columns: list[str] | None = None) -> IndexInfo | None:
        for x in self.of(df):
            if name in (None, x.name) and columns in (None, x.columns):
                return x
        return None

    def has(self, df: DataFrame, name: str | None = None) -> bool:
        return self.lookup(df, name) is not None

    def is_empty(self) -> bool:
        return not self._all

    def show(self, df: DataFrame | None = None) -> DataFrame:
        rows = [(x.name, x.table, ",".join(x.columns), x.index_type.value, x.period, x.location) for x in (self._all if df is None else self.of(df))]
        return self.spark.createDataFrame(rows, "name string, table string, columns string, index_type string, period string, location string")

    def set_storage_level(self, df: DataFrame, name: str, level: StorageLevel) -> None:
        with self._lock:
            info = self._must(df, name)
            info.data.unpersist()
            info.data.persist(level)
            info.level = level

    def _must(self, df: DataFrame, name: str) -> IndexInfo:
        info = self.lookup(df, name)
        if info is None:
            raise KeyError(f"this source has no index {name!r}")
        return info

    def _drop(self, gone: list[IndexInfo]) -> int:
        with self._lock:
            for x in gone:
                if not x.manifest:
                    x.data.unpersist()
            self._all = [x for x in self._all if all(x is not y for y in gone)]
            return len(gone)

    def drop(self, df: DataFrame) -> None:
        if not self._drop(self.of(df)):
            raise KeyError("this source has no index")

    def drop_by_name(self, df: DataFrame, name: str) -> None:
        self._drop([self._must(df, name)])

    def drop_by_columns(self, df: DataFrame, columns: list[str]) -> None:
        if not self._drop([x for x in self.of(df) if x.columns == list(columns)]):
            raise KeyError(f"this source has no index on {columns}")

    def try_drop(self, df: DataFrame) -> bool:
        return bool(self._drop(self.of(df)))

    def try_drop_by_name(self, df: DataFrame, name: str) -> bool:
        return bool(self._drop([x for x in self.of(df) if x.name == name]))

    def clear(self) -> None:
        self._drop(list(self._all))

    def persist(self, df: DataFrame, name: str, path: str) -> None:
        """Writes the index as Parquet by period, with its manifest."""
        info = self._must(df, name)
        layout.write(info.source, path, info.name, info.index_type.value, info.columns, info.period)

    def load(self, path: str, source: DataFrame | None = None) -> IndexInfo:
        """Registers a written index; without a source, the loaded rows are their own source."""
        data, m = layout.read(self.spark, path)
        rows = data.drop(layout.PERIOD, layout.SPAN)
        with self._lock:
            src = rows if source is None else source
            self.try_drop_by_name(src, m.name)
            info = IndexInfo(m.name, "", m.columns, IndexType(m.index_type), m.period, src, data, location=path, manifest=m)
            self._all.append(info)
            return info
