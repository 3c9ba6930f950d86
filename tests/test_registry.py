"""Every query with SQL gives DuckDB's rows on the smallest tables; the rest give rows."""

import math

import duckdb
import pytest

from pulseloom.plans.files import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v) + 0:.5f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    at = "/root/testdata/sf0.01" if name == "risk_curves" else SF  # the smallest tables have no seizure that it could follow
    assert QUERIES[name](spark, at).count() > 0


#: Queries that may come out empty without SQL noticing it, and rows that the smallest tables give at least.
LEAST = {"interictal_candidates": 1000, "segment_index": 1000, "lead_export_counts": 1, "interictal_picks": 100, "interictal_rejections": 3, "risk_of_one_recording": 1000, "edf_slices": 500, "bids_events": 1500}


@pytest.mark.parametrize("name", sorted(LEAST))
def test_gives_enough_rows(spark, name):
    assert QUERIES[name](spark, SF).count() >= LEAST[name]


def test_recordings_and_alerts_grow_with_the_tables(spark):
    at = "/root/testdata/sf0.01"
    assert QUERIES["cooldown_alerts"](spark, at).count() > 5 and QUERIES["file_alert_metrics"](spark, at).count() == 4
