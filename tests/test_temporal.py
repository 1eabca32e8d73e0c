"""Hand-made cases: edges, ties, nulls, year ends, long intervals, empty windows; and layouts against plain frames."""

from datetime import datetime, timedelta

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st

from chronolith import Engine, IndexType, range_find, slot_topk, slot_topk_counts, temporal_find, interval_find, in_time, window_max, window_mean, window_min
from chronolith.functions.encoding import decode, encode, period_bucket
from chronolith.plans.storage import scratch


def points(spark, rows):
    return spark.createDataFrame(rows, "time bigint, v int")


def ids(df, c="v"):
    return sorted(r[c] for r in df.collect())


def test_closed_edges_and_nulls(spark):
    df = points(spark, [(9, 0), (10, 1), (20, 2), (21, 3), (None, 4)])
    assert ids(range_find(df, "time", 10, 20)) == [1, 2]
    assert ids(range_find(df, "time", 20, 10)) == []


def test_second_truncation_and_year_crossing(spark):
    at = [datetime(2017, 12, 31, 23, 59, 59, 500000), datetime(2018, 1, 1), datetime(2018, 1, 1, 0, 0, 0, 500000), datetime(2018, 1, 1, 0, 0, 1)]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(at)], "time timestamp_ntz, v int")
    assert ids(range_find(df, "time", 20171231235959, 20180101000000)) == [0, 1, 2]
    assert ids(temporal_find(df, "time", 20180101000000)) == [1, 2]
    assert ids(range_find(df, "time", 20179999999999, 20180199000000)) == [1, 2, 3]


def test_interval_rules(spark):
    rows = [("long", 0, 99), ("ends_at_start", 1, 10), ("begins_at_end", 20, 30), ("before", 1, 9), ("zero", 15, 15), ("null", None, 50)]
    df = spark.createDataFrame(rows, "n string, st bigint, ed bigint")
    assert ids(interval_find(df, "st", "ed", 10, 20), "n") == ["ends_at_start", "long", "zero"]
    assert ids(interval_find(df, "st", "ed", 15, 15), "n") == ["zero"]
    assert ids(temporal_find(df, ["st", "ed"], 15), "n") == ["long", "zero"]


def test_extremes(spark):
    df = points(spark, [(1, -5), (2, 3), (3, 3), (4, 3), (5, -5), (6, None), (99, 100)])
    assert ids(window_max(df, "v", "time", 1, 6)) == [3, 3, 3]
    assert ids(window_min(df, "v", "time", 1, 6)) == [-5, -5]
    assert ids(window_max(df, "v", "time", 50, 60)) == []
    assert ids(window_mean(points(spark, [(1, 1), (2, 2), (3, 2)]), "v", "time", 1, 3)) == [1, 2, 2]
    assert ids(window_mean(points(spark, [(1, -7), (2, 0)]), "v", "time", 1, 3)) == [0]


@pytest.mark.parametrize("k,want", [(1, 2), (2, 2), (3, 4), (4, 4), (5, 5)])
def test_topk_ties(spark, k, want):
    df = points(spark, [(i, key) for key, n in enumerate((5, 5, 3, 3, 1)) for i in range(n)] + [(9, 4), (10, 4)])
    got = slot_topk_counts(df, "v", "time", 0, 9, k).collect()
    assert len(got) == want and {r["rank"] for r in got} <= {1, 3, 5}
    assert len(slot_topk(df, "v", "time", 0, 9, k).collect()) == want


def test_topk_rejects(spark):
    with pytest.raises(ValueError):
        slot_topk(points(spark, []), "v", "time", 0, 1, 0)


def test_codec(spark):
    df = spark.createDataFrame([(20180104041617,), (20181399000000,), (None,)], "t bigint")
    got = [r[0] for r in df.select(decode("t")).collect()]
    assert got == [datetime(2018, 1, 4, 4, 16, 17), None, None]
    assert df.select(encode(decode("t"))).first()[0] == 20180104041617
    assert df.select(period_bucket("t", "Month")).first()[0] == 201801
    with pytest.raises(ValueError):
        period_bucket("t", "week")


def test_in_time(spark):
    df = spark.createDataFrame([("5",), ("x",), (None,), ("12",)], "s string")
    assert ids(in_time(df, "s", 1, 9), "s") == ["5"]


@settings(max_examples=5, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.tuples(st.integers(0, 400), st.integers(0, 90)), max_size=30), st.integers(0, 400), st.integers(0, 90), st.sampled_from([1, 3, None]))
def test_layouts_change_nothing(spark, spans, start, length, parts):
    base = datetime(2017, 11, 1)
    rows = [(i, base + timedelta(hours=7 * a), base + timedelta(hours=7 * a + 5 * b)) for i, (a, b) in enumerate(spans)]
    df = spark.createDataFrame(rows, "v int, st timestamp_ntz, ed timestamp_ntz")
    engine = Engine(spark)
    s, e = base + timedelta(hours=7 * start), base + timedelta(hours=7 * start + 5 * length)
    plain = engine.frame(df)
    want = ids(plain.interval_find(["st", "ed"], s, e)), ids(plain.range_find("st", s, e)), ids(plain.temporal_find(["st", "ed"], s))
    plain.index("steid", "i", ["st", "ed"], "month", parts)
    assert (ids(plain.interval_find("st", s, e)), ids(plain.range_find("st", s, e)), ids(plain.temporal_find(["st", "ed"], s))) == want
    path = scratch(spark, "t")
    engine.indexes.persist(df, "i", path)
    engine.indexes.clear()
    engine.indexes.load(path, df)
    assert (ids(plain.interval_find("st", s, e)), ids(plain.range_find("st", s, e)), ids(plain.temporal_find(["st", "ed"], s))) == want


def test_open_ends_on_disk(spark):
    """Open and undecodable ends, and one very long interval, in a written index."""
    from chronolith.sources import layout

    rows = [("open", 20200101000000, 99999999999999), ("short", 20210301000000, 20210302000000), ("odd", 20210101000000, 20210399000000), ("odd start", 20210199000000, 20210601000000), ("century", 19200101000000, 20210401000000), ("before", 20200101000000, 20200102000000), ("null", None, 20210401000000)]
    df = spark.createDataFrame(rows, "n string, st bigint, ed bigint")
    engine, path = Engine(spark), scratch(spark, "open")
    layout.write(df, path, "i", "steid", ["st", "ed"], "month")
    for s, e in ((20210301000000, 20210305000000), (20210501000000, 20210502000000), (20200101120000, 20200101120000), (20210399000000, 20210401000000)):
        want = ids(interval_find(df, "st", "ed", s, e), "n"), ids(temporal_find(df, ["st", "ed"], s), "n")
        engine.indexes.load(path, df)
        frame = engine.frame(df)
        assert (ids(frame.interval_find("st", s, e), "n"), ids(frame.temporal_find(["st", "ed"], s), "n")) == want
    data, m = layout.read(spark, path)
    kept = layout.prune(data, m, 20210301000000, 20210305000000)
    assert kept.filter("n = 'before'").count() == 0 and kept.filter("n = 'century'").count() == 1


def test_means(spark):
    mean = lambda rows: sorted((r["v"] for r in window_mean(spark.createDataFrame([(1, v) for v in rows], "time bigint, v double").repartition(3), "v", "time", 1, 1).collect()), key=str)
    assert mean([1e-12, 3e-12]) == [3e-12] and mean([1e30, 1.0, None]) == [1e30] and mean([0.1] * 10) == [0.1] * 10 and mean([]) == [] and mean([-2.5, -1.5, -2.0]) == [-1.5, -2.0]
    assert mean([5e-324, 0.0]) == [5e-324] and mean([1.7e308, 1.7e308]) == [1.7e308] * 2 and mean([1e16, 1.0, -1e16, 1.0]) == [1.0, 1.0, 1e16]
    assert mean([1.0, float("inf")]) == [float("inf")] and [str(x) for x in mean([1.0, float("nan")])] == ["nan"] and mean([-0.0, 0.0]) in ([-0.0, 0.0], [0.0, -0.0])
    dec = spark.createDataFrame([(1, 1), (1, 2), (1, 4)], "time bigint, v int").selectExpr("time", "CAST(v AS DECIMAL(30,12)) / 3 AS v")
    assert window_mean(dec, "v", "time", 1, 1).count() == 1


@settings(max_examples=8, deadline=None, phases=[Phase.explicit, Phase.generate])
@given(st.lists(st.floats(-1e9, 1e9, width=32), min_size=1, max_size=20))
def test_mean_is_exact(spark, values):
    from fractions import Fraction

    got = sorted(r["v"] for r in window_mean(spark.createDataFrame([(1, v) for v in values], "time bigint, v double"), "v", "time", 1, 1).collect())
    assert got == sorted(v for v in values if Fraction(v) * len(values) >= sum(map(Fraction, values)))


def test_topk_with_maps(spark):
    df = points(spark, [(2, 7), (1, 7), (3, 8)]).selectExpr("time", "v", "map('a', time) AS m", "array(map('b', v)) AS n")
    got = slot_topk(df, "v", "time", 0, 9, 1).collect()
    assert [(r["time"], r["v"], r["m"]) for r in got] == [(1, 7, {"a": 1})]


def test_zones(spark):
    from datetime import timezone

    df = spark.createDataFrame([(datetime(2024, 1, 1, 12),)], "t timestamp_ntz")
    two = timezone(timedelta(hours=2))
    assert temporal_find(df, "t", datetime(2024, 1, 1, 14, tzinfo=two)).count() == 1 and range_find(df, "t", "2024-01-01T14:00:00+02:00", "2024-01-01T14:00:00+02:00").count() == 1
    assert temporal_find(df, "t", datetime(2024, 1, 1, 14)).count() == 0


def test_sessions(spark):
    from pyspark import SparkConf

    engine = Engine.get_or_create(conf=SparkConf().set("spark.sql.session.timeZone", "UTC"), spark__sql__ansi__enabled=True)
    engine.clear_active()
    engine.set_active()
    engine.set_default()
    assert Engine.active() is not None


def test_registry(spark):
    from pyspark import StorageLevel

    engine = Engine(spark)
    df = points(spark, [(1, 1)])
    df.createOrReplaceTempView("pts")
    assert engine.indexes.is_empty()
    engine.index_table("pts", "HashType", "a", ["time"])
    engine.table("pts").index(IndexType.STEID, "b", ["time", "v"])
    t = spark.table("pts")
    assert engine.has_index("pts", "a") and not engine.has_index("pts", "c")
    assert engine.show_index("pts").count() == 2
    with pytest.raises(ValueError):
        engine.index_table("pts", "hash", "a", ["time"])
    with pytest.raises(ValueError):
        IndexType.parse("btree")
    engine.indexes.set_storage_level(t, "a", StorageLevel.DISK_ONLY)
    engine.indexes.drop_by_name(t, "a")
    with pytest.raises(KeyError):
        engine.indexes.drop_by_name(t, "a")
    engine.indexes.drop_by_columns(t, ["time", "v"])
    assert not engine.indexes.try_drop(t) and not engine.indexes.try_drop_by_name(t, "b")
    engine.sql_range_function("find_pts", "pts", "time")
    assert spark.sql("SELECT * FROM find_pts(0, 5)").count() == 1


def test_text_sources(spark, tmp_path):
    (tmp_path / "p.txt").write_text("20180104041617,1,2,3,4,5\nbad,1\n20180104041618,1,2,-3,4,x\n")
    engine = Engine(spark)
    got = engine.read_points(str(tmp_path / "p.txt"))
    assert got.df.count() == 2 and ids(got.min("attr3", "time", 20180104041617, 20180104072614), "attr3") == [-3]


def test_stream(spark, tmp_path):
    from chronolith.streaming.search import range_find as find

    spark.range(10).selectExpr("id AS time").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("time bigint").parquet(str(tmp_path / "in"))
    q = find(s, "time", 3, 5).writeStream.format("memory").queryName("found").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").count() == 3


def test_stream_topk(spark, tmp_path):
    from chronolith.streaming.search import slot_counts, slot_topk as ranked

    rows = [(datetime(2024, 1, 1, h, m), k) for h in (0, 1) for m, k in ((1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c"))] + [(datetime(2024, 1, 1, 9), "z")]
    spark.createDataFrame(rows, "t timestamp, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))
    found = []
    q = ranked(slot_counts(s, "k", "t", "1 hour", "0 seconds"), "k", 1, lambda batch, n: found.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["slot_start"].hour, r["k"], r["n"], r["rank"]) for r in found) == [(0, "a", 2, 1), (0, "b", 2, 1), (1, "a", 2, 1), (1, "b", 2, 1)]
