"""The verbs on one frame, answered from a registered layout when there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkConf, StorageLevel
from pyspark.sql import DataFrame, SparkSession

from chronolith.functions.encoding import Instant, is_calendar
from chronolith.operators import search, topk, window_ops
from chronolith.sources import layout
from chronolith.sources.registry import IndexInfo, IndexRegistry, IndexType


class Engine:
    """A session with a registry; ``with Engine.builder()...`` isn't needed, any SparkSession will do."""

    def __init__(self, spark: SparkSession):
        self.spark, self.indexes = spark, IndexRegistry(spark)

    @classmethod
    def get_or_create(cls, master: str | None = None, app_name: str | None = None, conf: SparkConf | None = None, hive: bool = False, **config: object) -> Engine:
        """The active session, or the default one, or a new one; options as ``spark__sql__x=...`` or a SparkConf."""
        b = SparkSession.builder
        b = b.master(master) if master else b
        b = b.appName(app_name) if app_name else b
        b = b.config(conf=conf) if conf else b
        for k, v in config.items():
            b = b.config(k.replace("__", "."), v)
        return cls((b.enableHiveSupport() if hive else b).getOrCreate())

    @staticmethod
    def active() -> SparkSession | None:
        """The thread's active session."""
        return SparkSession.getActiveSession()

    def _sessions(self):
        return self.spark._jvm.org.apache.spark.sql.classic.SparkSession

    def set_active(self) -> None:
        self._sessions().setActiveSession(self.spark._jsparkSession)

    def clear_active(self) -> None:
        self._sessions().clearActiveSession()

    def set_default(self) -> None:
        self._sessions().setDefaultSession(self.spark._jsparkSession)

    def clear_default(self) -> None:
        self._sessions().clearDefaultSession()

    def frame(self, df: DataFrame) -> TemporalFrame:
        return TemporalFrame(self, df)

    def table(self, name: str) -> TemporalFrame:
        return self.frame(self.spark.table(name))

    def create_frame(self, rows, schema) -> TemporalFrame:
        return self.frame(self.spark.createDataFrame(rows, schema))

    def read_points(self, path: str, names: tuple[str, ...] = ("time", "attr1", "attr2", "attr3", "attr4", "attr5")) -> TemporalFrame:
        """Comma-separated point records; lines of fewer than three fields are dropped."""
        return self._read_text(path, [(n, "bigint" if i == 0 else "int") for i, n in enumerate(names)])

    def read_intervals(self, path: str) -> TemporalFrame:
        """Comma-separated (name, event_time_st, event_time_ed, free, location); short lines are dropped."""
        kinds = [("name", "string"), ("event_time_st", "bigint"), ("event_time_ed", "bigint"), ("free", "int"), ("location", "int")]
        return self._read_text(path, kinds)

    def _read_text(self, path: str, kinds: list[tuple[str, str]]) -> TemporalFrame:
        from pyspark.sql import functions as F

        parts = self.spark.read.text(path).select(F.split("value", ",", -1).alias("v")).filter(F.size("v") >= 3)
        picked = [F.expr(f"try_cast(trim(get(v, {i})) AS {kind})").alias(n) for i, (n, kind) in enumerate(kinds)]
        return self.frame(parts.select(*picked))

    def index_table(self, table: str, index_type: str | IndexType, name: str, columns: list[str], period: str = "month") -> IndexInfo:
        return self.indexes.create(self.spark.table(table), index_type, name, columns, period, table=table)

    def has_index(self, table: str, name: str) -> bool:
        return self.indexes.has(self.spark.table(table), name)

    def show_index(self, table: str) -> DataFrame:
        return self.indexes.show(self.spark.table(table))

    def sql_range_function(self, name: str, table: str, t: str) -> None:
        """``SELECT * FROM name(start, end)`` as a range search on a table, for SQL users."""
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.table(table).schema)
        kind = self.spark.table(table).schema[t].dataType.simpleString()
        self.spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s {kind}, e {kind}) RETURNS TABLE({cols}) "
            f"RETURN SELECT * FROM {table} WHERE `{t}` BETWEEN s AND e"
        )

    def sql_functions(self, prefix: str, table: str, t: str, ed: str | None = None, value: str | None = None, key: str | None = None) -> list[str]:
        """Table functions on a table for SQL users, with encoded bounds; their names.

        ``prefix_range(s, e)`` and ``prefix_at(p)`` on the time column; with an end
        column ``prefix_interval(s, e)``, and ``prefix_at`` finds the intervals that
        hold an instant; with a value ``prefix_max(s, e)`` and ``prefix_min(s, e)``;
        with a key ``prefix_topk(s, e, k)``.  On timestamps a bound stands for its
        whole second, and one that is no calendar instant finds nothing.
        """
        schema = self.spark.table(table).schema
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

        def bound(c: str, x: str, later: bool = False) -> str:
            if not is_calendar(schema[c].dataType):
                return x
            at = f"CAST(try_to_timestamp(lpad(CAST({x} AS STRING), 14, '0'), 'yyyyMMddHHmmss') AS {schema[c].dataType.simpleString()})"
            return f"({at} + INTERVAL 1 SECOND)" if later else at

        upto = lambda c, x: f"`{c}` {'<' if is_calendar(schema[c].dataType) else '<='} {bound(c, x, True)}"
        since = lambda c, x: f"`{c}` >= {bound(c, x)}"
        window = f"SELECT * FROM {table} WHERE {since(t, 's')} AND {upto(t, 'e')}"
        bodies = {"range": ("s BIGINT, e BIGINT", cols, window), "at": ("p BIGINT", cols, f"SELECT * FROM {table} WHERE {upto(t, 'p')} AND {since(ed or t, 'p')}")}
        if ed:
            meets = f"(s = e AND {since(t, 's')} AND {upto(t, 's')}) OR (s <> e AND `{t}` < {bound(t, 'e')} AND {since(ed, 's')})"
            bodies["interval"] = ("s BIGINT, e BIGINT", cols, f"SELECT * FROM {table} WHERE {meets}")
        if value:
            for f in ("max", "min"):
                picked = ", ".join(f"w.`{x.name}`" for x in schema)
                bodies[f] = ("s BIGINT, e BIGINT", cols, f"SELECT {picked} FROM ({window}) w JOIN (SELECT {f}(`{value}`) AS __x FROM ({window})) ON w.`{value}` = __x")
        if key:
            counts = f"SELECT `{key}`, count(*) AS n FROM {table} WHERE {since(t, 's')} AND `{t}` < {bound(t, 'e')} AND `{key}` IS NOT NULL GROUP BY 1"
            bodies["topk"] = ("s BIGINT, e BIGINT, k INT", f"`{key}` {schema[key].dataType.simpleString()}, n BIGINT, rank INT", f"SELECT * FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS rank FROM ({counts})) WHERE rank <= k")
        for name, (given, out, body) in bodies.items():
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}({given}) RETURNS TABLE({out}) RETURN {body}")
        return [f"{prefix}_{name}" for name in bodies]


class TemporalFrame:
    def __init__(self, engine: Engine, df: DataFrame):
        self.engine, self.df = engine, df

    def index(self, index_type: str | IndexType, name: str, columns: list[str], period: str = "month", partitions: int | None = None) -> TemporalFrame:
        self.engine.indexes.create(self.df, index_type, name, columns, period, partitions)
        return self

    def set_storage_level(self, name: str, level: StorageLevel) -> TemporalFrame:
        self.engine.indexes.set_storage_level(self.df, name, level)
        return self

    def _layout(self, columns: list[str], start: Instant, end: Instant) -> DataFrame:
        """The layout whose key is the searched column, else the frame itself."""
        for info in self.engine.indexes.of(self.df):
            if info.columns[: len(columns)] == columns:
                if info.manifest:
                    return layout.prune(info.data, info.manifest, start, end).drop(layout.PERIOD, layout.SPAN)
                return info.data
        return self.df

    def _pair(self, t: str | list[str]) -> list[str]:
        """A start column alone takes its end from an interval index."""
        if not isinstance(t, str):
            return list(t)
        for info in self.engine.indexes.of(self.df):
            if len(info.columns) == 2 and info.columns[0] == t:
                return info.columns
        raise ValueError(f"no interval index begins with {t!r}; name both columns")

    def range_find(self, t: str, start: Instant, end: Instant) -> DataFrame:
        return search.range_find(self._layout([t], start, end), t, start, end)

    def temporal_find(self, t: str | list[str], at: Instant) -> DataFrame:
        columns = [t] if isinstance(t, str) else list(t)
        return search.temporal_find(self._layout(columns, at, at), t, at)

    def interval_find(self, t: str | list[str], start: Instant, end: Instant) -> DataFrame:
        st, ed = self._pair(t)
        return search.interval_find(self._layout([st, ed], start, end), st, ed, start, end)

    def _window(self, f: Callable[..., DataFrame], c: str, t: str, start: Instant, end: Instant) -> DataFrame:
        return f(self._layout([t], start, end), c, t, start, end)

    def max(self, c: str, t: str, start: Instant, end: Instant) -> DataFrame:
        return self._window(window_ops.window_max, c, t, start, end)

    def min(self, c: str, t: str, start: Instant, end: Instant) -> DataFrame:
        return self._window(window_ops.window_min, c, t, start, end)

    def mean(self, c: str, t: str, start: Instant, end: Instant) -> DataFrame:
        return self._window(window_ops.window_mean, c, t, start, end)

    def slot_topk(self, key: str, t: str, start: Instant, end: Instant, k: int, order: tuple[str, ...] = ()) -> DataFrame:
        return topk.slot_topk(self._layout([t], start, end), key, t, start, end, k, order)

    def slot_topk_counts(self, key: str, t: str, start: Instant, end: Instant, k: int) -> DataFrame:
        return topk.slot_topk_counts(self._layout([t], start, end), key, t, start, end, k)
