"""The registered queries of the temporal engine and the SQL each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions.encoding import encode, period_bucket
from chronolith.operators import search, topk, window_ops
from chronolith.plans.engine import Engine

Query = Callable[[SparkSession, str], DataFrame]

DAY = (20240105000000, 20240106000000)
WINDOW = (20240105000000, 20240108000000)
SPAN = (19980301000000, 19980915000000)
YEAR = (19970101000000, 19980101000000)
AT = 19980301000000
EVENT = "event_id, ts, user_id, event_type, value"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").selectExpr(*EVENT.split(", "))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """Order date to ship date of each line, earlier first."""
    lines = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = _table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return lines.join(orders, "l_orderkey").select(
        "l_orderkey", "l_linenumber", F.least("o_orderdate", "l_shipdate").alias("st"), F.greatest("o_orderdate", "l_shipdate").alias("ed")
    )


INTERVALS = (
    "(SELECT l_orderkey, l_linenumber, least(o_orderdate, l_shipdate) AS st, greatest(o_orderdate, l_shipdate) AS ed "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)


def _at(x: int) -> str:
    s = str(x)
    return f"TIMESTAMP '{s[:4]}-{s[4:6]}-{s[6:8]} {s[8:10]}:{s[10:12]}:{s[12:]}'"


def _in(t: str, w: tuple[int, int]) -> str:
    return f"{t} >= {_at(w[0])} AND {t} < {_at(w[1])} + INTERVAL 1 SECOND"


def _indexed_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Written to the shared folder, loaded and searched."""
    from chronolith.plans.storage import scratch

    engine, df = Engine(spark), events(spark, d)
    path = scratch(spark, "index")
    frame = engine.frame(df).index("hash", "by_time", ["ts"], "day")
    engine.indexes.persist(df, "by_time", path)
    engine.indexes.clear()
    engine.indexes.load(path, df)
    return frame.range_find("ts", *DAY)


def _interval_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from chronolith.plans.storage import scratch
    from chronolith.sources import layout

    df, path = intervals(spark, d), scratch(spark, "interval_index")
    layout.write(df, path, "spans", "steid", ["st", "ed"], "month")
    engine = Engine(spark)
    engine.indexes.load(path, df)
    return engine.frame(df).interval_find("st", *SPAN)


def _open_ends(spark: SparkSession, d: str) -> DataFrame:
    """Encoded intervals, some without an end, some with one that is no instant, from a written index."""
    from chronolith.plans.storage import scratch
    from chronolith.sources import layout

    key = F.col("l_orderkey") % 50
    ed = F.when(key == 0, F.lit(99999999999999)).when(key == 1, encode("ed") + 99).otherwise(encode("ed"))
    df, path = intervals(spark, d).select("l_orderkey", "l_linenumber", encode("st").alias("st"), ed.alias("ed")), scratch(spark, "open_ends")
    layout.write(df, path, "spans", "interval_tree", ["st", "ed"], "year")
    engine = Engine(spark)
    engine.indexes.load(path, df)
    return engine.frame(df).interval_find("st", *SPAN)


def _lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """What the registry says at each step of an index's life."""
    from pyspark import StorageLevel

    engine, df = Engine(spark), events(spark, d)
    df.createOrReplaceTempView("lifecycle_events")
    own, said = engine.indexes, []
    note = lambda step: said.append((step, own.show().count(), engine.has_index("lifecycle_events", "a"), own.is_empty()))
    note("start")
    t = spark.table("lifecycle_events")
    engine.index_table("lifecycle_events", "HashType", "a", ["ts"], "day")
    engine.index_table("lifecycle_events", "hash", "b", ["value"])
    engine.table("lifecycle_events").index("interval", "c", ["ts", "value"])
    note("created")
    own.set_storage_level(t, "a", StorageLevel.DISK_ONLY)
    said.append((f"level {own.lookup(t, 'a').level == StorageLevel.DISK_ONLY}", own.show(t).count(), own.has(t), own.is_empty()))
    own.drop_by_name(t, "b")
    note("dropped by name")
    own.drop_by_columns(t, ["ts", "value"])
    note("dropped by columns")
    said.append((f"tried {own.try_drop_by_name(t, 'b')} {own.try_drop(t)} {own.try_drop(t)}", 0, own.has(t), own.is_empty()))
    engine.table("lifecycle_events").index("hash", "a", ["ts"])
    own.drop(t)
    note("dropped")
    engine.table("lifecycle_events").index("hash", "a", ["ts"])
    own.clear()
    note("cleared")
    return spark.createDataFrame(said, "step string, n int, has_a boolean, empty boolean").withColumn("n", F.col("n").cast("bigint"))


def _points_text(spark: SparkSession, d: str) -> DataFrame:
    """The smallest attribute of a window, from points in text."""
    from chronolith.plans.storage import scratch

    path = scratch(spark, "points")
    points = events(spark, d).select(F.concat_ws(",", encode("ts"), "user_id", "event_id", (F.col("user_id") * 7) % 101 - 50, F.lit(1), F.lit("x")).alias("value"))
    points.unionByName(spark.createDataFrame([("bad,1",), ("",)], "value string")).write.text(path)
    return Engine(spark).read_points(path).min("attr3", "time", *WINDOW)


def _intervals_text(spark: SparkSession, d: str) -> DataFrame:
    from chronolith.plans.storage import scratch

    path = scratch(spark, "intervals")
    intervals(spark, d).select(F.concat_ws(",", "l_orderkey", encode("st"), encode("ed"), "l_linenumber", F.lit(" 3")).alias("value")).write.text(path)
    return Engine(spark).read_intervals(path).interval_find(["event_time_st", "event_time_ed"], *SPAN)


def _sql(call: str, **given) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        engine = Engine(spark)
        (intervals if "ed" in given else events)(spark, d).createOrReplaceTempView("sql_rows")
        engine.sql_functions("found", "sql_rows", **given)
        return spark.sql(f"SELECT * FROM {call}")

    return run


def _listing(spark: SparkSession, d: str) -> DataFrame:
    engine, df = Engine(spark), events(spark, d)
    engine.frame(df).index("hash", "by_time", ["ts"], "day")
    out = engine.indexes.show(df)
    engine.indexes.clear()
    return out


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    return search.range_find(events(spark, d), "ts", *DAY).select("event_id", encode("ts").alias("time"), "value")


def _by_period(unit: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        # Spark prunes to ts before the exchange and combines on the map side.
        b = period_bucket(encode("ts"), unit)
        return events(spark, d).groupBy(b.alias("period")).agg(F.count(F.lit(1)).alias("n"))

    return run


def queries() -> dict[str, Query]:
    e, i = events, intervals
    out: dict[str, Query] = {
        "range_find": lambda s, d: search.range_find(e(s, d), "ts", *DAY),
        "range_find_encoded": _encoded,
        "range_find_indexed": lambda s, d: Engine(s).frame(e(s, d)).index("hash", "by_time", ["ts"], "day").range_find("ts", *DAY),
        "index_roundtrip": _indexed_roundtrip,
        "index_listing": _listing,
        "temporal_find": lambda s, d: search.temporal_find(_table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate", AT),
        "temporal_find_interval": lambda s, d: search.temporal_find(i(s, d), ["st", "ed"], AT),
        "interval_find": lambda s, d: search.interval_find(i(s, d), "st", "ed", *SPAN),
        "interval_find_point": lambda s, d: search.interval_find(i(s, d), "st", "ed", AT, AT),
        "interval_find_indexed": lambda s, d: Engine(s).frame(i(s, d)).index("steid", "spans", ["st", "ed"]).interval_find("st", *SPAN),
        "interval_index_roundtrip": _interval_roundtrip,
        "in_time": lambda s, d: search.in_time(_table(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", 3, 9),
        "in_time_text": lambda s, d: search.in_time(_table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.regexp_replace("o_orderpriority", "-.*", "")).otherwise("none").alias("code")), "code", 2, 4),
        "interval_index_open_ends": _open_ends,
        "index_lifecycle": _lifecycle,
        "points_from_text": _points_text,
        "intervals_from_text": _intervals_text,
        "sql_range": _sql(f"found_range({DAY[0]}, {DAY[1]})", t="ts"),
        "sql_max": _sql(f"found_max({WINDOW[0]}, {WINDOW[1]})", t="ts", value="value"),
        "sql_topk": _sql(f"found_topk({WINDOW[0]}, {WINDOW[1]}, 10)", t="ts", key="user_id"),
        "sql_at": _sql(f"found_at({AT})", t="st", ed="ed"),
        "sql_interval": _sql(f"found_interval({SPAN[0]}, {SPAN[1]})", t="st", ed="ed"),
        "window_mean_tiny": lambda s, d: window_ops.window_mean(e(s, d).select("event_id", "ts", (F.col("value") * 1e-12).alias("tiny")), "tiny", "ts", *WINDOW),
        "window_mean_wide": lambda s, d: window_ops.window_mean(e(s, d).select("event_id", "ts", (F.col("value") * F.when(F.col("event_id") % 2 == 0, 1e30).otherwise(1e-6)).alias("wide")), "wide", "ts", *WINDOW),
        "full_scan": lambda s, d: search.full_scan(e(s, d)),
        "window_max": lambda s, d: window_ops.window_max(e(s, d), "value", "ts", *WINDOW),
        "window_min": lambda s, d: window_ops.window_min(e(s, d), "value", "ts", *WINDOW),
        "window_mean_int": lambda s, d: window_ops.window_mean(e(s, d), "user_id", "ts", *WINDOW),
        "window_mean_double": lambda s, d: window_ops.window_mean(e(s, d), "value", "ts", *WINDOW),
        "slot_topk_counts": lambda s, d: topk.slot_topk_counts(e(s, d), "user_id", "ts", *WINDOW, 10),
        "slot_topk_rows": lambda s, d: topk.slot_topk(e(s, d), "event_type", "ts", *WINDOW, 3, ("event_id",)),
        "topk": lambda s, d: topk.slot_topk_counts(_table(s, d, "lineitem").select("l_partkey", "l_shipdate"), "l_partkey", "l_shipdate", *YEAR, 10),
        "search_then_aggregate": lambda s, d: search.range_find(e(s, d), "ts", *WINDOW).groupBy("event_type").agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        ),
    }
    return out | {f"period_{u}": _by_period(u) for u in ("year", "month", "day", "hour", "minute")}


def oracle_sql() -> dict[str, str]:
    day, window = _in("ts", DAY), _in("ts", WINDOW)
    slot = f"ts >= {_at(WINDOW[0])} AND ts < {_at(WINDOW[1])}"
    span = f"SELECT * FROM {INTERVALS} WHERE st < {_at(SPAN[1])} AND ed >= {_at(SPAN[0])}"
    found = f"SELECT {EVENT} FROM events WHERE {day}"
    w = f"WITH w AS (SELECT {EVENT} FROM events WHERE {window}) SELECT * FROM w WHERE "
    digits = lambda c: f"CAST(strftime({c}, '%Y%m%d%H%M%S') AS BIGINT)"
    exact = "CAST(value AS DECIMAL(38,10))"

    def counts(key: str, table: str, where: str, k: int) -> str:
        n = f"SELECT {key}, count(*) AS n FROM {table} WHERE {where} GROUP BY {key}"
        return f"SELECT {key}, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM ({n})) WHERE r <= {k}"

    year = f"l_shipdate >= {_at(YEAR[0])} AND l_shipdate < {_at(YEAR[1])}"
    out = {
        "range_find": found,
        "range_find_encoded": f"SELECT event_id, CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS time, value FROM events WHERE {day}",
        "range_find_indexed": found,
        "index_roundtrip": found,
        "index_listing": "SELECT 'by_time' AS name, '' AS \"table\", 'ts' AS columns, 'hash' AS index_type, 'day' AS period, '' AS location",
        "temporal_find": f"SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE {_in('o_orderdate', (AT, AT))}",
        "temporal_find_interval": f"SELECT * FROM {INTERVALS} WHERE st < {_at(AT)} + INTERVAL 1 SECOND AND ed >= {_at(AT)}",
        "interval_find": span,
        "interval_find_point": f"SELECT * FROM {INTERVALS} WHERE {_in('st', (AT, AT))}",
        "interval_find_indexed": span,
        "interval_index_roundtrip": span,
        "in_time": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 3 AND 9",
        "full_scan": f"SELECT {EVENT} FROM events",
        "in_time_text": "SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN split_part(o_orderpriority, '-', 1) ELSE 'none' END AS code FROM orders) WHERE TRY_CAST(code AS BIGINT) BETWEEN 2 AND 4",
        "interval_index_open_ends": f"SELECT * FROM (SELECT l_orderkey, l_linenumber, {digits('st')} AS st, CASE l_orderkey % 50 WHEN 0 THEN 99999999999999 WHEN 1 THEN {digits('ed')} + 99 ELSE {digits('ed')} END AS ed "
        f"FROM {INTERVALS}) WHERE st < {SPAN[1]} AND ed >= {SPAN[0]}",
        "index_lifecycle": "SELECT * FROM (VALUES ('start', 0, false, true), ('created', 3, true, false), ('level True', 3, true, false), ('dropped by name', 2, true, false), ('dropped by columns', 1, true, false), "
        "('tried False True False', 0, false, true), ('dropped', 0, false, true), ('cleared', 0, false, true)) AS t(step, n, has_a, empty)",
        "points_from_text": f"WITH w AS (SELECT {digits('ts')} AS time, user_id::INT AS attr1, event_id::INT AS attr2, ((user_id * 7) % 101 - 50)::INT AS attr3, 1 AS attr4, NULL::INT AS attr5 FROM events WHERE {window}) "
        "SELECT * FROM w WHERE attr3 = (SELECT min(attr3) FROM w)",
        "intervals_from_text": f"SELECT l_orderkey::VARCHAR AS name, {digits('st')} AS event_time_st, {digits('ed')} AS event_time_ed, l_linenumber::INT AS free, 3 AS location FROM ({span})",
        "sql_range": found,
        "sql_max": f"{w} value = (SELECT max(value) FROM w)",
        "sql_topk": counts("user_id", "events", slot, 10),
        "sql_at": f"SELECT * FROM {INTERVALS} WHERE st < {_at(AT)} + INTERVAL 1 SECOND AND ed >= {_at(AT)}",
        "sql_interval": span,
        "window_mean_tiny": f"WITH w AS (SELECT event_id, ts, value * 1e-12::DOUBLE AS tiny FROM events WHERE {window}) SELECT * FROM w WHERE tiny >= (SELECT favg(tiny) FROM w)",
        "window_mean_wide": f"WITH w AS (SELECT event_id, ts, value * CASE WHEN event_id % 2 = 0 THEN 1e30::DOUBLE ELSE 1e-6::DOUBLE END AS wide FROM events WHERE {window}) SELECT * FROM w WHERE wide >= (SELECT favg(wide) FROM w)",
        "window_max": f"{w} value = (SELECT max(value) FROM w)",
        "window_min": f"{w} value = (SELECT min(value) FROM w)",
        "window_mean_int": f"{w} user_id >= (SELECT sum(user_id) // count(user_id) FROM w)",
        "window_mean_double": f"{w} {exact} * (SELECT count(value) FROM w) >= (SELECT sum({exact}) FROM w)",
        "slot_topk_counts": counts("user_id", "events", slot, 10),
        "slot_topk_rows": f"WITH s AS (SELECT {EVENT} FROM events WHERE {slot}), k AS ({counts('event_type', 'events', slot, 3)}) "
        f"SELECT {EVENT} FROM (SELECT s.*, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM s "
        "WHERE event_type IN (SELECT event_type FROM k)) WHERE rn = 1",
        "topk": counts("l_partkey", "lineitem", year, 10),
        "search_then_aggregate": f"SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high FROM events WHERE {window} GROUP BY event_type",
    }
    for u, k in (("year", 10), ("month", 8), ("day", 6), ("hour", 4), ("minute", 2)):
        out[f"period_{u}"] = f"SELECT CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) // {10**k} AS period, count(*) AS n FROM events GROUP BY 1"
    return out
