import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulseloom.operators import alerts as L
from pulseloom.operators import risk as R
from pulseloom.operators.scan import latest, numbered, overlaps
from pulseloom.streaming.risk import CausalRisk, stream_risk

SMALL = R.RiskSettings(smooth=4, median=12, median_min=5, baseline=20, baseline_min=6, fp_short=6, fp_long=15, trend=3, trend_long=8, z=10, peak=8, min_fp_short=0.05, min_fp_long=0.05, min_trend=0.0, min_z=0.2, cooldown=9)


def frame(n=160, seed=3):
    r = np.random.default_rng(seed)
    return pd.DataFrame({"rec": 0, "subject": 0, "win_idx": range(n), "time": 1 + 0.5 * np.arange(n), "prob": r.random(n), "delta": r.random(n) * 50, "ratio": r.random(n), "centroid": r.random(n) * 20})


def by_pandas(df, s):
    d = df.copy()
    d["prob_sm"] = d["prob"].rolling(s.smooth, min_periods=1).mean()
    for c in ("delta", "ratio", "centroid"):
        m = d[c].rolling(s.median, min_periods=s.median_min).median()
        d[f"{c}_n"] = (m - m.mean()) / (m.std() + 1e-6)
    d["risk"] = (0.4 * d.prob_sm + 0.3 * d.ratio_n.clip(0) + 0.2 * (-d.delta_n).clip(0) + 0.1 * d.centroid_n.clip(0)).clip(0, 1)
    d["trend"] = d.risk.diff().rolling(s.trend).mean()
    d["z"] = (d.risk - d.risk.rolling(s.z).mean()) / (d.risk.rolling(s.z).std() + 1e-6)
    sums = np.cumsum(d.risk.fillna(0).to_numpy())
    for name, win in (("fp_short", s.fp_short), ("fp_long", s.fp_long)):
        out = []
        for i, x in enumerate(d.risk):
            left_null = i >= win and np.isnan(d.risk[i - win])
            out.append(np.nan if np.isnan(x) or left_null else (sums[i] - (sums[i - win] if i >= win else 0)) / min(win, i + 1))
        d[name] = out
    return d


def test_risk_frame_equals_pandas(spark):
    df = frame()
    got = R.risk_frame(spark.createDataFrame(df), ["rec", "subject"], s=SMALL).toPandas().sort_values("win_idx").reset_index(drop=True)
    want = by_pandas(df, SMALL)
    for c in ("prob_sm", "delta_n", "risk", "trend", "z", "fp_short", "fp_long"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-9, equal_nan=True)


def test_median_forms_agree(spark):
    df = spark.createDataFrame(frame())
    a = R.risk_frame(df, ["rec", "subject"], s=SMALL).select("win_idx", F.round("risk", 9).alias("r"))
    b = R.whole_risk_frame(df, ["rec", "subject"], s=SMALL).select("win_idx", F.round("risk", 9).alias("r"))
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("mode", ["published", "causal"])
def test_blocks_with_halos_equal_whole_recordings(spark, monkeypatch, mode):
    monkeypatch.setattr(R, "BLOCK", 30)
    one, two = frame(190, 1), frame(31, 2).assign(rec=1, win_idx=lambda d: d.win_idx * 3 + 5)  # with gaps in the order
    one.loc[50:70, "prob"] = np.nan
    one.loc[100:104, "delta"] = np.nan
    df = spark.createDataFrame(pd.concat([one, two, frame(1).assign(rec=2)])).replace(float("nan"), None).repartition(5)
    got = R.risk_frame(df, ["rec", "subject"], s=SMALL, mode=mode).toPandas().sort_values(["rec", "win_idx"])
    want = R.whole_risk_frame(df, ["rec", "subject"], s=SMALL, mode=mode).toPandas().sort_values(["rec", "win_idx"])
    assert len(got) == 222 and got["candidate"].tolist() == want["candidate"].tolist()
    for c in ("prob_sm", "delta_n", "ratio_n", "risk", "fp_short", "fp_long", "trend", "trend_long", "z", "peakness"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-7, equal_nan=True, err_msg=c)


def test_rows_are_numbered_over_many_tasks(spark):
    rows = [(k, i * 3) for k, n in (("a", 500), ("b", 1), ("c", 77)) for i in range(n)]
    got = numbered(spark.createDataFrame(rows, "rec string, t long").repartition(6), ["rec"], ["t"])
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, t, t // 3) for k, t in rows)


COLUMNS = ("risk", "fp_short", "fp_long", "trend", "z")


@pytest.mark.parametrize("cuts", [[61], [1, 2, 3, 40, 41, 90], list(range(1, 120))])
def test_stream_layer_equals_causal_batch(spark, cuts):
    df = frame(120)
    df.loc[30:37, "delta"] = np.nan
    want = R.risk_frame(spark.createDataFrame(df).replace(float("nan"), None), ["rec", "subject"], s=SMALL, mode="causal")
    kept = {r["win_idx"] for r in R.cooldown_alerts(want, None, ["rec", "subject"], SMALL, scope="full").collect()}
    rows, layer = want.orderBy("win_idx").toPandas(), CausalRisk(SMALL)
    out = pd.concat([layer.push(part.sample(frac=1, random_state=1)) for part in (df[a:b] for a, b in zip([0, *cuts], [*cuts, len(df)], strict=True))])
    for c in COLUMNS:
        np.testing.assert_allclose(out[c].to_numpy(float), rows[c].to_numpy(float), atol=1e-7, equal_nan=True, err_msg=c)
    assert set(out["win_idx"][out["alert"].astype(bool)]) == kept
    assert len(layer.push(df[5:8])) == 0 and layer.late == 3 and len(layer.raw) == 11 and len(layer.risks) == 15


def test_stream_drops_late_rows_and_forgets_idle_recordings(spark, tmp_path):
    ts = lambda d: pd.Timestamp("2024-01-01") + pd.to_timedelta(d["time"], unit="s")
    one, two = frame(60), frame(40, 9).assign(rec=1)
    far = frame(1).assign(rec=2, time=9e6)
    again = frame(30, 4).assign(time=lambda d: d.time + 9e6)  # the first recording, from its first window on
    late = one[20:25]
    for i, part in enumerate((pd.concat([one[:40], two[:10]]), pd.concat([one[40:], late, two[10:]]), far, far.assign(win_idx=1), again)):
        spark.createDataFrame(part.assign(ts=ts(part))).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = stream_risk(stream, SMALL, delay="1 second", idle=1000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").toPandas()
    first = got[(got.rec == 0) & (got.time < 1e6)].sort_values("win_idx")
    assert first.win_idx.tolist() == list(range(60)) and first.late.max() == 5
    np.testing.assert_allclose(first.risk.to_numpy(float), CausalRisk(SMALL).push(one).risk.to_numpy(float), equal_nan=True)
    np.testing.assert_allclose(got[got.rec == 1].sort_values("win_idx").z.to_numpy(float), CausalRisk(SMALL).push(two).z.to_numpy(float), equal_nan=True, atol=1e-9)
    anew = got[(got.rec == 0) & (got.time > 1e6)].sort_values("win_idx")
    assert anew.win_idx.tolist() == list(range(30))
    np.testing.assert_allclose(anew.risk.to_numpy(float), CausalRisk(SMALL).push(again).risk.to_numpy(float), equal_nan=True)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(idx=st.lists(st.integers(0, 400), max_size=30), gap=st.integers(0, 60), strict=st.booleans())
def test_greedy_keep_equals_loop(spark, idx, gap, strict):
    kept, last = [], -gap
    for x in sorted(set(idx)):
        if (x - last > gap) if strict else (x - last >= gap):
            kept.append(x)
            last = x
    row = spark.range(1).select(F.array(*[F.lit(x) for x in sorted(set(idx))]).cast("array<bigint>").alias("a"))
    assert row.select(R.greedy_keep(F.col("a"), gap, strict, -gap).alias("k")).first()["k"] == kept


def test_zones_and_stretch(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.3), (2, 0.95), (3, None)], "i int, x double")
    rows = df.select("i", R.risk_zone(F.col("x")).alias("z"), R.risk_level(F.col("x")).alias("l"), R.minmax_or_half(F.col("x"), Window.partitionBy()).alias("m"), R.clip_stretch(F.col("x")).alias("c")).orderBy("i").collect()
    assert [r["z"] for r in rows] == ["Low", "Medium", "High", None] and [r["l"] for r in rows] == [2, 4, 10, None]
    assert rows[0]["m"] == 0 and rows[2]["m"] == 1 and rows[3]["m"] is None and rows[2]["c"] == 1


def test_medians_of_blocks_equal_those_of_whole_recordings(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    from pulseloom.operators import risk

    monkeypatch.setattr(risk, "BLOCK", 9)
    r = np.random.default_rng(0)
    rows = [(k, i * 2, None if r.random() < 0.1 else float(r.normal())) for k, n in (("a", 100), ("b", 9), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "rec string, win_idx long, v double").repartition(3)
    got = risk.rolling_medians(df, ["rec"], "win_idx", {"m": ("v", 7, 3), "k": ("v", 20, 1)}).toPandas().sort_values(["rec", "win_idx"])
    want = pd.DataFrame(rows, columns=["rec", "win_idx", "v"]).sort_values(["rec", "win_idx"])
    for new, n, least in (("m", 7, 3), ("k", 20, 1)):
        np.testing.assert_allclose(got[new].to_numpy(float), want.groupby("rec")["v"].rolling(n, min_periods=least).median().to_numpy())
    assert len(got) == len(rows)


def test_as_of_search_and_interval_pairs_equal_loops(spark):
    r = random.Random(4)
    facts = [(r.choice("ab"), r.choice([r.uniform(0, 9000), float(r.randrange(0, 9000, 600))]), float(r.randrange(50))) for _ in range(60)] + [("a", None, 99.0)]
    rows = [(r.choice("abc"), r.choice([r.uniform(-10, 9500), float(r.randrange(0, 9000, 600)), None]), i) for i in range(80)]
    f, q = spark.createDataFrame(facts, "rec string, at double, v double"), spark.createDataFrame(rows, "rec string, t double, i int")
    for strict in (False, True):
        got = latest(q, f, ["rec"], F.col("t"), F.col("at"), F.col("v"), "best", strict, bucket=700.0)
        hit = lambda t, a: t is not None and a is not None and (a < t if strict else a <= t)
        want = sorted((i, max((v for k, a, v in facts if k == rec and hit(t, a)), default=None)) for rec, t, i in rows)
        assert sorted((x["i"], x["best"]) for x in got.collect()) == want
    spans = [(r.choice("ab"), a, a + r.choice([0, 3, 40, 900, -1]), i) for i in range(60) for a in [r.randrange(0, 3000)]]
    left = spark.createDataFrame([(k, float(a), float(b), i) for k, a, b, i in spans], "rec string, a double, b double, i int")
    right = spark.createDataFrame([(k, float(c), float(d), j) for k, c, d, j in spans[::2]], "rec string, c double, d double, j int")
    pairs = sorted((x["i"], x["j"]) for x in overlaps(left, right, ["rec"], ("a", "b"), ("c", "d"), 100.0).collect())
    assert pairs == sorted((i, j) for k, a, b, i in spans for q, c, d, j in spans[::2] if k == q and a <= b and c <= d and a <= d and c <= b)


def test_many_intervals_in_one_recording(spark):
    n = 100_000
    seizures = spark.range(n).select(F.lit(1).alias("rec"), (F.col("id") * 10.0).alias("onset_s"), (F.col("id") * 10.0 + 2).alias("end_s"))
    windows = spark.range(n).select(F.lit(1).alias("rec"), (F.col("id") * 10.0 + F.col("id") % 10).alias("t_start_s"), (F.col("id") * 10.0 + F.col("id") % 10 + 1).alias("t_end_s"))
    assert L.label_windows(windows, seizures, ["rec"]).agg(F.sum("label")).first()[0] == n // 10 * 4 - 1  # offsets 0, 1, 2 touch their own, 9 the next one
    near = L.align_to_onset(windows.select("rec", F.col("t_start_s").alias("time")), seizures, ["rec"], 5.0, 4.0)
    assert near.count() == n - 1 and near.agg(F.min("aligned"), F.max("aligned")).first()[0] >= -5


@pytest.mark.parametrize("gap", [0, 3, 40])
def test_spaced_equals_the_fold_over_recordings(spark, gap):
    r = random.Random(gap)
    rows = [(k, i) for k, top, n in (("a", 3000, 900), ("b", 200, 30), ("c", 90, 90)) for i in sorted(r.sample(range(top), n))]
    kept = set()
    for k in "abc":
        last = -gap
        for i in (i for q, i in rows if q == k):
            if i - last > gap:
                kept.add((k, i))
                last = i
    assert {tuple(x) for x in R.spaced(spark.createDataFrame(rows, "rec string, win_idx long"), ["rec"], gap, -gap).collect()} == kept
