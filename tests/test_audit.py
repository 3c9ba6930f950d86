"""Boundary cases of the audit as golden rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pulseloom.functions import text as X
from pulseloom.operators import audit as U
from pulseloom.operators import catalog as C
from pulseloom.operators import sampling as S

SEIZURES = [  # ann_id, run, onset, duration
    (1, 1, 4046.0, 20.0), (2, 1, 10629.0, 30.0), (3, 2, 233.0, 10.0), (4, 3, 539.0, 94.0), (5, 3, 782.0, 10.0), (6, 4, 13207.0, 87.0), (7, 4, 14028.0, 10.0),
]


def labelled(spark):
    s = spark.createDataFrame([("sub-1", *r) for r in SEIZURES], "subject string, ann_id int, run int, onset_s double, duration_s double")
    return U.lead_labels(U.gap_from_previous(s))


def test_lead_labels_golden(spark):
    got = {r["ann_id"]: r for r in labelled(spark).collect()}
    want = {
        1: (4046, ">= (from run start)", "yes", True), 2: (6563, "same run", "yes", True), 3: (233, ">= (from run start)", "unknown", False),
        5: (149, "same run", "no", False), 7: (734, "same run", "no", True),
    }
    for k, (since, basis, lead, ok) in want.items():
        r = got[k]
        assert (r["since_prev_s"], r["since_prev_basis"], r["lead_seizure"], r["preictal_ok_run"]) == (since, basis, lead, ok)


def test_gates_and_reasons(spark):
    a = labelled(spark).withColumn("in_recording", F.lit(True)).withColumn("preictal_ok", F.col("preictal_ok_run"))
    q = spark.createDataFrame([(1, "poor", 0.70), (2, "clean", 0.9), (6, "usable", 0.80)], "ann_id int, ecg_verdict string, eeg_clean double")
    got = {r["ann_id"]: r for r in U.audit_quality_join(a, q).collect()}
    assert got[1]["skip_reason"] == "ECG poor, EEG only 70% clean" and not got[1]["usable"]
    assert got[2]["usable_lead"] and got[2]["skip_reason"] is None
    assert got[7]["ecg_verdict"] == "no_ecg" and got[5]["ecg_verdict"] == "n/a" and got[5]["skip_reason"] == "no clean pre-ictal"


def test_scalar_functions(spark):
    r = spark.range(1).select(
        X.normalise_channel(F.lit("EEG Fp1-Ref")).alias("n"), X.to_seconds(F.lit("01.02.03")).alias("t"), X.offset_from_start(F.lit(86000), F.lit(100)).alias("o"),
        X.lobes_of(F.lit("front_xyz")).alias("l"), X.lobes_of(F.lit("n/a")).alias("e"), X.human_bytes(F.lit(1536)).alias("h"), X.human_bytes(F.lit(12)).alias("b"),
        X.sample_timestamp_ms(F.lit(1), 256.0).alias("ms"), X.electrode_side(F.lit("BTEright")).alias("s"), X.run_of(F.lit("a/run-07_x")).alias("run"),
        X.match_sample_axes(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit(9), F.lit(8))).alias("m"),
        X.montage_check(F.array(F.lit("EEG F7-Ref"), F.lit("T3"), F.lit("EKG")), [("F7", "T3"), ("T3", "T5")]).alias("mc"),
    ).first()
    assert (r["n"], r["t"], r["o"], r["l"], r["e"], r["h"], r["b"]) == ("FP1", 3723, 500, ["frontal", "xyz"], [], "1.5 KB", "12 B")
    assert (r["ms"], r["s"], r["run"], r["m"]) == ("3.90625", "right", 7, [9, 8, 8])
    assert r["mc"]["missing"] == ["T5"] and not r["mc"]["montage_ok"] and r["mc"]["cardiac"] == ["EKG"]


def greedy(candidates, need, seed, apart, reasons):
    """The sequential pass, per subject: picks, and rejections by reason up to the last pick."""
    picks, rejected = set(), Counter()
    for subject in need:
        chosen = []
        for _, s, run, t in sorted(c for c in candidates if c[1] == subject):
            if len(chosen) == need[subject]:
                break
            if any(r == run and abs(t - u) < apart for r, u in chosen):
                rejected[subject, "overlap"] += 1
            elif reasons.get(t):
                rejected[subject, reasons[t]] += 1
            else:
                chosen.append((run, t))
                picks.add((subject, run, t))
    return picks, dict(rejected)


@pytest.mark.parametrize("seed", [1, 2])
def test_picks_equal_the_sequential_pass(spark, seed):
    rows = [(s, r, 300 + 60 * i) for s, n in (("a", 40), ("b", 9), ("c", 25)) for r in (1, 2) for i in range(n)]
    need = {"a": 9, "b": 30, "c": 5, "d": 3}
    c = spark.createDataFrame(rows, "subject string, run int, t long").repartition(3)
    order = [(r["h"], *r[:3]) for r in c.select("*", S.hash_order(seed, "subject", "run", "t").alias("h")).collect()]
    reasons = {t: "ecg" if t % 180 == 0 else "eeg" for t in range(300, 4000, 60) if t % 180 == 0 or t % 420 == 0}
    judge = lambda df: df.withColumn("reason", F.expr("CASE WHEN t % 180 = 0 THEN 'ecg' WHEN t % 420 = 0 THEN 'eeg' END"))
    picked, rejected = C.pick_interictal(c, spark.createDataFrame(list(need.items()), "subject string, need int"), seed, quality=judge, factor=1)
    picks, passed = greedy(order, need, seed, 240, reasons)
    assert {tuple(r) for r in picked.collect()} == picks and {(r[0], r[1]): r[2] for r in rejected.collect()} == passed


def test_candidates_fill_the_gaps_between_many_seizures(spark):
    r = random.Random(3)
    runs = [("s", i, r.choice([100.0, 780.0, 5000.0, 40_000.0, 40_030.5])) for i in range(12)]
    seizures = [("s", i, r.uniform(-100, d + 50), r.choice([0.0, 20.0, 33.3, 4000.0])) for _, i, d in runs[1:] for _ in range(r.choice([0, 1, 2, 6]))] + [("s", 3, None, 5.0), ("t", 3, 500.0, 5.0)]
    got = C.interictal_candidates(spark.createDataFrame(runs, "subject string, run int, duration_s double"), spark.createDataFrame(seizures, "subject string, run int, onset_s double, duration_s double"))
    want = []
    for s, run, d in runs:
        t = 300
        while t <= d - 540:
            if all(t + 240 <= on - 1800 or t >= on + du + 1800 for z, q, on, du in seizures if (z, q) == (s, run) and on is not None):
                want.append((s, run, t))
            t += 60
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 500


def test_exact_samples_don_t_depend_on_partitioning(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    a = S.downsample_majority(df, "label", ["vec_id"], 2.0, seed=5)
    b = S.downsample_majority(df.repartition(11), "label", ["vec_id"], 2.0, seed=5)
    n = {r["label"]: r["count"] for r in a.groupBy("label").count().collect()}
    assert n == {1: 429, 0: 858} and a.exceptAll(b).count() == 0 and a.distinct().count() == 1287
    h = S.holdout_fraction(df, ["vec_id"], seed=2)
    assert h.where("fold = 'validation'").count() == 600 and h.count() == 3000
    w = S.sample_with_replacement(df, ["label"], spark.createDataFrame([(0, 50), (1, 1000)], "label int, draws long"), ["vec_id"])
    assert {r["label"]: r["count"] for r in w.groupBy("label").count().collect()} == {0: 50, 1: 1000}


def test_draws_are_uniform_and_many_draws_make_no_array(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE_ROWS", 20)
    monkeypatch.setattr(S, "RUN", 7)
    df = spark.range(300).select(F.col("id").alias("vec_id"), (F.col("id") % 3).cast("int").alias("label"))
    wanted = spark.createDataFrame([(0, 20_000), (1, 3), (2, 0), (9, 5)], "label int, draws long")
    a = S.sample_with_replacement(df, ["label"], wanted, ["vec_id"], 4)
    rows = a.collect()
    assert sorted((r["label"], r["draw"]) for r in rows) == [(0, i) for i in range(1, 20_001)] + [(1, 1), (1, 2), (1, 3)]
    times = Counter(r["vec_id"] for r in rows if r["label"] == 0)
    assert len(times) == 100 and sum((n - 200) ** 2 / 200 for n in times.values()) < 160  # chi-square of 99 degrees: 1 in 10,000
    assert S.sample_with_replacement(df.repartition(9), ["label"], wanted, ["vec_id"], 4).exceptAll(a).count() == 0
    monkeypatch.setattr(S, "RUN", 4096)
    ranges = spark.createDataFrame([(0, r, 100 + r, 10**12) for r in range(50)], "label int, r_ long, c_ long, draws long")
    dealt = [r["d_"] for r in S.split_draws(ranges, ["label"], 1).orderBy("r_").collect()]
    assert sum(dealt) == 10**12 and max(abs(d / 10**12 * sum(range(100, 150)) / (100 + r) - 1) for r, d in enumerate(dealt)) < 1e-3


def test_cells_of_the_sweep_are_bounded(spark):
    from pulseloom.operators.sweep import training_sets

    rows = [(i, f"s{i % 3}", i // 4, 0, 60.0 * (i // 4), int(i // 4 % 3 == 0), [float(i % 5), 1.0]) for i in range(600)]
    f = spark.createDataFrame(rows, "vec_id long, subject string, segment_id long, run int, t_start_s double, label int, features array<double>")
    train, test = training_sets(f, ["s0", "s1"], [1], most=10)
    n = {(r["patient"], r["stage"], r["label"]): r["count"] for r in train.groupBy("patient", "stage", "label").count().collect()}
    assert all(v == (20 if stage == "mixed" else 10) for (_, stage, _), v in n.items()) and len(n) == 16
    assert test.where("stage = 'generic'").count() > 100


def test_time_split_has_no_future(spark):
    rows = [(i, "s", i // 2, (i // 2) % 3, 60.0 * (i // 2), int((i // 2) % 2 == 0)) for i in range(40)]
    s = S.time_split(spark.createDataFrame(rows, "vec_id int, subject string, segment_id int, run int, t_start_s double, label int"))
    early = s.where("period = 'EARLY'").agg(F.max(F.struct("run", "t_start_s")).alias("m")).first()["m"]
    later = s.where("period = 'LATER'").agg(F.min(F.struct("run", "t_start_s")).alias("m")).first()["m"]
    assert tuple(early) < tuple(later)
