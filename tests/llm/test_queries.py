import hashlib

import pytest

from chronolith.llm import queries
from tests.oracle import DATA, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, DATA)) == duck_rows(queries.oracle_sql()[name])


def test_secret_columns(spark, tmp_path):
    """Counts by kind and the digest of the listed base spans, whatever the order and number of kinds in a text."""
    h, a, s = "0123456789abcdef" * 2, "AKIA" + "Q" * 12, "token=abcdefgh"
    cases = [
        (0, f"{s} {h}", "assign:0:14,hex:15:47"),
        (1, f"{h} {s} {s}", "hex:0:32,assign:33:47,assign:48:62"),
        (2, a, "access:0:16"),
        (3, f"é\U0001f600 {a} {a} {h} {s}", "access:3:19,access:20:36,hex:37:69,assign:70:84"),
        (4, f"PassWd : '{h}'", "assign:0:42,hex:10:42"),
        (5, f"api_key='{a}", "assign:0:25,access:9:25"),
        (6, "to\u212aen=abcdefgh \u017fecret=abcdefgh token=secret:abcdefgh12 AKIA" + "Q" * 11 + " " + h[1:] + "F" + h[:31], ""),
        (6, "token=secret=abcdefg", "assign:0:20"),
        (7, f"{s}\n" * 300, ",".join(f"assign:{15 * i}:{15 * i + 14}" for i in range(300))),
        (8, None, ""), (8, "", ""), (9, s, "assign:0:14"), (9, s, "assign:0:14"),
    ]
    spark.createDataFrame([c[:2] for c in cases], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.queries()["op3_secret_scan"](spark, str(tmp_path))
    assert dict(out.dtypes) | {f"n_{k}": "bigint" for k in ("assign", "access", "hex")} == dict(out.dtypes)
    got = sorted(tuple(r) for r in out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect())
    assert got == sorted((i, *(b.count(k) for k in ("assign", "access", "hex")), hashlib.sha256(b.encode()).hexdigest()) for i, _, b in cases)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns and 0 < docs.count() <= before, name
    last = p.STAGES[-1][1](spark, docs, DATA)
    assert last.filter("lossless").count() == docs.count()
    assert p.run(spark, DATA).count() == docs.count()
