"""What only larger tables showed: ties of rounding, long grids, many candidates, long files."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulseloom.functions import arrays as A
from pulseloom.operators import catalog as C
from pulseloom.operators import sampling as S
from pulseloom.plans.files import ORACLES, QUERIES
from pulseloom.plans.registry import rounded
from pulseloom.sources import text as T
from pulseloom.sources.staging import staged

#: Values at which a product with 100, in doubles, lies on the other side of a half than the printed digits do.
HALVES = [-0.012550000101327896, 0.08995000272989273, -0.1993499994277954, 0.012550000101327896, 0.125, -0.125, -0.00001, 0.0]


def same_as_sql(spark, name, folder, *tables):
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        for t in tables:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        rel = c.execute(ORACLES[name])
        cols, want = [d[0] for d in rel.description], sorted(rel.fetchall(), key=str)
    got = sorted((tuple(r) for r in QUERIES[name](spark, str(folder)).select(*cols).collect()), key=str)
    assert len(want) > 0 and got == want


@pytest.fixture
def halves(spark, tmp_path):
    rows = [(i, [HALVES[(i + j) % len(HALVES)] for j in range(64)]) for i in range(len(HALVES))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return tmp_path


def test_export_rows_round_halves_as_sql_does(spark, halves):
    same_as_sql(spark, "export_rows", halves, "embeddings")


def test_export_files_round_halves_as_sql_does(spark, halves):
    same_as_sql(spark, "export_file_lines", halves, "embeddings")


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_to_sample_are_not_sent_to_the_driver(spark):
    """Staged candidates pack into small files; the row per group is what is sent, never they."""
    pool = staged(spark.range(20_000).selectExpr("id", "id % 3 AS g"), "pool")
    limits = staged(spark.createDataFrame([(0, 100), (1, 0), (2, 10**9)], "g long, limit long"), "limits")
    taken = S.take_exact(pool, ["g"], limits, 1, ["id"])
    plan = plan_of(taken)
    assert {r["g"]: r["count"] for r in taken.groupBy("g").count().collect()} == {0: 100, 2: 6666}
    assert "Inner, BuildRight" in plan and "Inner, BuildLeft" not in plan


def test_picks_are_not_sent_to_the_driver(spark):
    """Rejections are told from the picks by a join that grows with the picks."""
    c = spark.createDataFrame([("a", r, 300 + 60 * i) for r in range(4) for i in range(50)], "subject string, run int, t long")
    need = spark.createDataFrame([("a", 20)], "subject string, need int")
    picked, rejected = C.pick_interictal(c, need, 3, quality=lambda df: df.withColumn("reason", F.expr("CASE WHEN t % 180 = 0 THEN 'ecg' END")))
    assert picked.count() == 20 and "SortMergeJoin [subject" in plan_of(rejected)


def test_last_windows_end_the_grid(spark):
    r = spark.range(0, 1400, 7).selectExpr("id AS rec", "id AS n_samples", "256.0D AS fs")
    for inclusive in (True, False):
        every = A.sliding_windows(r, 512, 128, inclusive).withColumn("n", F.count("*").over(Window.partitionBy("rec")))
        want = every.where("win_idx + 1 = n").drop("n")
        got = A.last_windows(r, 512, 128, inclusive).select(want.columns)
        assert want.count() > 100 and sorted(got.collect()) == sorted(want.collect())


def test_grids_of_long_recordings_are_not_spelled_out(spark, tmp_path):
    """Three recordings of 4 x 10^12 windows each."""
    spark.range(3).selectExpr("id + 70000000000000 AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert "Generate" not in plan_of(QUERIES["window_grids"](spark, str(tmp_path)))
    same_as_sql(spark, "window_grids", tmp_path, "customer")


def test_lists_longer_than_a_split_or_a_chunk(spark, tmp_path, monkeypatch):
    """Lines are numbered over splits of 4 KB, and headers counted over chunks of 7 lines, as in whole files."""
    monkeypatch.setattr(T, "CHUNK", 7, raising=False)
    text = {"a": "".join(f"PN01-{i}.edf\r\nSeizure start time: {i % 24:02d}.00.00\n{'x' * (i % 50)}\n" for i in range(800)), "b": "Seizure end time: 01.00.00\n\nPN\xe9\nPN02-7.edf", "c": "PN03-1.edf\n" * 3}
    for name, body in text.items():
        (tmp_path / f"{name}.txt").write_bytes(body.encode("latin-1"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = T.numbered_lines(spark, str(tmp_path))
        read = [r[0] for r in lines.select(F.spark_partition_id()).distinct().collect()]
        got = sorted((r["doc"][-5], r["line_no"], r["line"]) for r in lines.collect())
        blocks = T.seizure_list(lines).select(F.substring("doc", -5, 1), "block", "file", "starts", "ends").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(n, i, x) for n in "abc" for i, x in enumerate(text[n].removesuffix("\n").replace("\r\n", "\n").split("\n"))] and len(read) > 3
    want = [("a", i + 1, f"PN01-{i}.edf", [i % 24 * 3600], []) for i in range(800)] + [("b", 0, None, [], [3600]), ("b", 1, "PN02-7.edf", [], [])] + [("c", i, "PN03-1.edf", [], []) for i in (1, 2, 3)]
    assert sorted(tuple(r) for r in blocks) == want


def test_six_places_are_rounded_as_sql_does(spark):
    """Halves of the seventh place, in doubles: the product with 10^6 decides."""
    with duckdb.connect() as c:
        rows = c.execute("SELECT k, k / 1e7::DOUBLE AS x, round(k / 1e7::DOUBLE, 6) AS r FROM range(-9999995, 9999995, 9990) t(k)").fetchall()
    got = rounded(spark.createDataFrame([r[:2] for r in rows] + [(None, None)], "k long, x double"), "x").collect()
    assert {r["k"]: r["x"] for r in got} == {k: r for k, _, r in rows} | {None: None}
