"""More registered queries: run records and issues, names and stamps, segment bookkeeping, usability roll-ups, export rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions import arrays as A
from pulseloom.functions import text as X
from pulseloom.operators import audit as U
from pulseloom.operators import catalog as C
from pulseloom.operators import sampling as S
from pulseloom.plans.registry import ORACLES, QUERIES, query, rounded
from pulseloom.plans.views import view
from pulseloom.sources import sinks as K


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- run records -----------------------------------------------------------------

_RUN_SQL = """
ev AS (SELECT c_custkey % 50 AS subject, c_custkey // 50 AS run, CASE WHEN c_custkey % 6 <> 0 THEN CAST(3600 + c_custkey % 9 AS DOUBLE) END AS events_s FROM customer),
ee AS (SELECT c_custkey % 50 AS subject, c_custkey // 50 AS run, CASE WHEN c_custkey % 13 <> 0 THEN CAST(3600 AS DOUBLE) END AS eeg_s, CASE WHEN c_custkey % 13 = 0 THEN 'unreadable' END AS eeg_error FROM customer),
ec AS (SELECT c_custkey % 50 AS subject, c_custkey // 50 AS run, CAST(3598 + c_custkey % 7 AS DOUBLE) AS ecg_s FROM customer WHERE c_custkey % 4 <> 0),
sc AS (SELECT c_custkey % 50 AS subject, c_custkey // 50 AS run, CAST(3600 + c_custkey % 5 AS DOUBLE) AS sidecar_s FROM customer WHERE c_custkey % 3 = 0),
rn AS (SELECT ev.*, eeg_s, eeg_error, ecg_s, CASE WHEN ecg_s IS NULL THEN 'missing' END AS ecg_error, sidecar_s, coalesce(eeg_s, events_s) AS base
  FROM ev LEFT JOIN ee USING (subject, run) LEFT JOIN ec USING (subject, run) LEFT JOIN sc USING (subject, run))"""


@query(f"WITH {_RUN_SQL.strip()} SELECT subject, run, concat_ws('; ', 'EEG ' || eeg_error, 'ECG ' || ecg_error, CASE WHEN abs(ecg_s - base) > 2 THEN 'ECG EDF ' || format('{{:.1f}}', ecg_s) || ' s' END, CASE WHEN abs(sidecar_s - base) > 2 THEN 'JSON ' || format('{{:.1f}}', sidecar_s) || ' s' END, CASE WHEN abs(events_s - base) > 2 THEN 'events ' || format('{{:.1f}}', events_s) || ' s' END) AS issues FROM rn")
def run_issues(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    key = [F.expr("c_custkey % 50").alias("subject"), F.expr("c_custkey DIV 50").alias("run")]
    ev = c.select(*key, F.expr("CASE WHEN c_custkey % 6 <> 0 THEN CAST(3600 + c_custkey % 9 AS DOUBLE) END").alias("events_s"))
    ee = c.select(*key, F.expr("CASE WHEN c_custkey % 13 <> 0 THEN 3600.0D END").alias("eeg_s"), F.expr("CASE WHEN c_custkey % 13 = 0 THEN 'unreadable' END").alias("eeg_error"))
    ec = c.where("c_custkey % 4 <> 0").select(*key, F.expr("CAST(3598 + c_custkey % 7 AS DOUBLE)").alias("ecg_s"))
    sc = c.where("c_custkey % 3 = 0").select(*key, F.expr("CAST(3600 + c_custkey % 5 AS DOUBLE)").alias("sidecar_s"))
    runs = U.assemble_runs(ee, ec, sc, ev).withColumn("ecg_error", F.when(F.col("ecg_s").isNull(), "missing"))
    return U.duration_mismatch(runs).select("subject", "run", F.array_join("issues", "; ").alias("issues"))


@query("SELECT s.subject, min(c_custkey) AS first_row FROM (SELECT DISTINCT substr(split_part(c_name, '#', 2), 3) AS subject FROM customer) s LEFT JOIN customer c ON contains(upper(c_name || ' ' || c_mktsegment), upper(s.subject)) GROUP BY 1")
def subject_sheet(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    s = c.select(F.expr("substr(split_part(c_name, '#', 2), 3)").alias("subject")).distinct()
    return C.subject_info(s, c.select("c_custkey", "c_name", "c_mktsegment"), ["c_name", "c_mktsegment"], "c_custkey").select("subject", F.col("c_custkey").alias("first_row"))


# ---- names and stamps ---------------------------------------------------------------


@query("SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS at_s, (hour(ts) * 3600 + minute(ts) * 60 + second(ts) - 43200 + 86400) % 86400 AS from_noon, hour(ts) < 12 AS next_day FROM events")
def stamp_offsets(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    at = X.to_seconds(F.date_format("ts", "HH.mm.ss"))
    return e.select("event_id", at.cast("long").alias("at_s"), X.offset_from_start(F.lit(43200), at).cast("long").alias("from_noon"), X.crosses_midnight(F.lit(43200), at).alias("next_day"))


_LABELS = "[CASE WHEN p_size % 2 = 0 THEN 'EEG F7-Ref' ELSE 'F7' END, CASE WHEN p_size % 3 = 0 THEN 'EEG T3-Ref' ELSE 'x' END, 'EEG T5', CASE WHEN p_size % 5 = 0 THEN 'EKG1' ELSE 'Annotations' END]"


@query(f"WITH l AS (SELECT p_partkey, {_LABELS} AS labels, p_size FROM part) SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'T3' END AS missing, p_size % 3 = 0 AS montage_ok, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'x' END AS odd, CASE WHEN p_size % 5 = 0 THEN 'EKG1' ELSE '' END AS cardiac, p_size % 3 = 0 AND p_size % 5 = 0 AS usable FROM l")
def montages(spark, sf_dir):
    labels = F.array(
        F.expr("CASE WHEN p_size % 2 = 0 THEN 'EEG F7-Ref' ELSE 'F7' END"), F.expr("CASE WHEN p_size % 3 = 0 THEN 'EEG T3-Ref' ELSE 'x' END"), F.lit("EEG T5"),
        F.expr("CASE WHEN p_size % 5 = 0 THEN 'EKG1' ELSE 'Annotations' END"),
    )
    m = _table(spark, sf_dir, "part").select("p_partkey", X.montage_check(labels, [("F7", "T3"), ("T3", "T5")]).alias("m"))
    joined = lambda c: F.array_join(f"m.{c}", ",").alias(c)
    return m.select("p_partkey", joined("missing"), "m.montage_ok", joined("odd"), joined("cardiac"), (F.col("m.montage_ok") & (F.size("m.cardiac") > 0)).alias("usable"))


# ---- usability ------------------------------------------------------------------------

_FILES = "SELECT concat('PN', lpad(CAST(o_custkey % 14 AS VARCHAR), 2, '0')) AS subject, o_orderkey % 5 = 0 AND o_custkey % 14 < 9 AS usable, CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'usable' WHEN 2 THEN 'check' ELSE 'mains' END AS verdict FROM orders WHERE o_custkey % 14 > 1"


def _files(spark, sf_dir):
    name = F.concat(F.lit("PN"), F.lpad(F.expr("CAST(o_custkey % 14 AS STRING)"), 2, "0"))
    o = _table(spark, sf_dir, "orders").where("o_custkey % 14 > 1")
    return o.select(name.alias("subject"), F.expr("o_orderkey % 5 = 0 AND o_custkey % 14 < 9").alias("usable"), F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'usable' WHEN 2 THEN 'check' ELSE 'mains' END").alias("verdict"))


@query(f"WITH f AS ({_FILES}) SELECT subject, count(*) AS files, count(*) FILTER (usable) AS usable_files, bool_or(usable) AS any_usable, count(DISTINCT CASE WHEN usable THEN subject END) AS usable_subjects FROM f GROUP BY ROLLUP (subject)")
def file_usability(spark, sf_dir):
    return A.file_usability_rollup(_files(spark, sf_dir))


@query(f"WITH f AS ({_FILES}) SELECT subject, count(*) FILTER (verdict = 'ok') AS ok, count(*) FILTER (verdict IN ('ok', 'usable')) AS ok_or_usable, count(*) AS n, count(DISTINCT CASE WHEN verdict = 'ok' THEN subject END) AS subjects_ok, count(DISTINCT CASE WHEN verdict IN ('ok', 'usable') THEN subject END) AS subjects_some FROM f GROUP BY ROLLUP (subject)")
def cardiac_tally(spark, sf_dir):
    return A.cardiac_tally(_files(spark, sf_dir))


# ---- segments ---------------------------------------------------------------------------


@query("WITH s AS (SELECT subject, segment_id, CASE WHEN label = 1 THEN 'ictal' WHEN segment_id % 2 = 0 THEN 'interictal' ELSE 'preictal' END AS kind, count(*) AS n_windows, count(*) FILTER (vec_id % 3 <> 0) AS n_windows_ok FROM fx_features GROUP BY ALL) SELECT kind, count(*) AS segments, CAST(sum(n_windows) AS BIGINT) AS windows, CAST(sum(n_windows_ok) AS BIGINT) AS windows_ok FROM s GROUP BY 1", "fx_features")
def segment_summary(spark, sf_dir):
    return C.segment_summary(_segments(spark, sf_dir))


def _segments(spark, sf_dir):
    f = view(spark, sf_dir, "fx_features")
    kind = F.when(F.col("label") == 1, "ictal").when(F.col("segment_id") % 2 == 0, "interictal").otherwise("preictal")
    return f.groupBy("subject", "segment_id", kind.alias("kind")).agg(F.count("*").alias("n_windows"), F.count_if(F.col("vec_id") % 3 != 0).alias("n_windows_ok"))


@query("WITH s AS (SELECT DISTINCT subject, segment_id FROM fx_features WHERE label = 0 AND segment_id % 2 = 0), n AS (SELECT subject, CAST(round_even(count(DISTINCT segment_id) * CAST(0.5 AS DOUBLE), 0) AS INTEGER) AS need FROM fx_features GROUP BY 1) SELECT n.subject, need, coalesce(got, 0) AS got FROM n LEFT JOIN (SELECT subject, count(*) AS got FROM s GROUP BY 1) USING (subject) WHERE coalesce(got, 0) < need", "fx_features")
def interictal_shortfall(spark, sf_dir):
    s = _segments(spark, sf_dir)
    need = s.groupBy("subject").agg(F.bround(F.count_distinct("segment_id") * 0.5, 0).cast("int").alias("need"))
    return C.shortfall(s.where("kind = 'interictal'"), need)


@query("SELECT vec_id, i.run, i.t_start_s, CASE WHEN label = 1 THEN 1 ELSE 0 END AS label FROM fx_features f JOIN (SELECT DISTINCT segment_id, CAST(run AS INTEGER) AS run, t_start_s FROM fx_features WHERE segment_id % 3 <> 1) i USING (segment_id)", "fx_features")
def windows_with_time(spark, sf_dir):
    f = view(spark, sf_dir, "fx_features")
    index = f.where("segment_id % 3 <> 1").select("segment_id", "run", "t_start_s").distinct()
    return S.segment_windows_time(f.select("vec_id", "segment_id", "label"), index).select("vec_id", "run", "t_start_s", "label")


@query("SELECT DISTINCT subject FROM fx_features WHERE subject <> 'sub-2' ORDER BY 1", "fx_features")
def other_subjects(spark, sf_dir):
    return S.other_subjects(view(spark, sf_dir, "fx_features"), "sub-2")


@query("WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS idx, CAST(unnest(embedding) AS DOUBLE) * 100 AS v, unnest(list_resize(embedding[1:40], 64, embedding[40])) AS c FROM embeddings) SELECT vec_id, CAST(idx AS INTEGER) AS idx, format('{:.5f}', idx * 1000 / 256.0::DOUBLE) AS timestamp, format('{:.2f}', round(round(v, 6), 2) + 0.0::DOUBLE) AS bte, format('{:.2f}', round(round(CAST(c AS DOUBLE) * 100, 6), 2) + 0.0::DOUBLE) AS cross FROM e")
def export_rows(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    scaled = lambda c: F.transform(c, lambda v: A.rounded_product(A.rounded_product(v.cast("double") * 100, 6), 2))
    seg = e.select(F.lit("training").alias("split"), F.lit("seizure").alias("label"), F.col("vec_id").alias("segment_id"), scaled(F.col("embedding")).alias("bte"), scaled(X.match_sample_axes(F.col("embedding"), F.slice("embedding", 1, 40))).alias("cross"))
    return K.training_rows(seg).select(F.col("segment_id").alias("vec_id"), "idx", "timestamp", "bte", "cross")


@query("SELECT ann_id, subject, run, onset_s, CAST(row_number() OVER (ORDER BY subject, run, onset_s, ann_id) AS INTEGER) AS place FROM fx_annot ORDER BY subject, run, onset_s, ann_id LIMIT 25", "fx_annot")
def first_events(spark, sf_dir):
    """The 25 first events, with the place that their order gives them."""
    first = C.order_events(view(spark, sf_dir, "fx_annot"), "onset_s", "ann_id").limit(25).select("ann_id", "subject", "run", "onset_s").collect()  # 25 rows
    return spark.createDataFrame([(*r, i) for i, r in enumerate(first, 1)], "ann_id long, subject string, run long, onset_s double, place int")


@query("WITH x AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'mV' WHEN 1 THEN ' V ' WHEN 2 THEN 'µV' ELSE 'uV' END AS dim, embedding FROM embeddings) SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * CASE vec_id % 4 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1 END, 6) AS first_uv FROM x")
def microvolts(spark, sf_dir):
    e = _table(spark, sf_dir, "embeddings")
    dim = F.expr("CASE vec_id % 4 WHEN 0 THEN 'mV' WHEN 1 THEN ' V ' WHEN 2 THEN 'µV' ELSE 'uV' END")
    return rounded(e.select("vec_id", F.element_at(X.to_microvolts(F.col("embedding"), dim), 1).alias("first_uv")), "first_uv")


_EDGES = "list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0 AND (i = 0 OR embedding[i] <= 0))"


@query(f"SELECT vec_id, array_to_string({_EDGES}, ',') AS edges FROM embeddings")
def edge_trains(spark, sf_dir):
    """Where each vector, read as a signal, comes up through zero."""
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.array_join(A.rising_edges(F.transform("embedding", lambda x: x > 0)).cast("array<string>"), ",").alias("edges"))


@query("WITH x AS (SELECT vec_id, label, generate_subscripts(features, 1) AS i, CAST(unnest(features) AS DOUBLE) AS v FROM fx_features), st AS (SELECT i, avg(v) AS mean, stddev_pop(v) + 1e-8 AS spread FROM x GROUP BY 1) SELECT vec_id, round(sum((v - mean) / spread), 4) AS total, round(max((v - mean) / spread), 4) AS top FROM x JOIN st USING (i) GROUP BY 1", "fx_features")
def standardised_features(spark, sf_dir):
    f = view(spark, sf_dir, "fx_features")
    return S.standardize(f, f).select("vec_id", F.round(F.aggregate("features", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.round(F.array_max("features"), 4).alias("top"))


@query("SELECT subject, segment_id, CASE WHEN max(label) = 1 THEN 1 ELSE 0 END AS label FROM fx_features GROUP BY ALL HAVING max(label) = 1 OR segment_id % 2 = 0", "fx_features")
def segment_labels(spark, sf_dir):
    return C.label_segments(_segments(spark, sf_dir)).select("subject", "segment_id", "label")


_PATHS = "concat('sub-', p_size, CASE p_partkey % 2 WHEN 0 THEN '/ecg/' ELSE '/eeg/' END, p_partkey, CASE p_partkey % 3 WHEN 0 THEN '_events.tsv' WHEN 1 THEN '_ecg.edf' ELSE '_eeg.edf' END)"


@query("SELECT p_partkey, concat('sub-', p_size, '/eeg/', p_partkey) AS stem, concat('sub-', p_size) AS subject, CASE p_partkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN 'n/a' ELSE p_type END AS vigilance FROM part")
def recording_stems(spark, sf_dir):
    p = _table(spark, sf_dir, "part").withColumn("path", F.expr(_PATHS))
    state = F.expr("CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_type END")
    return p.select("p_partkey", X.eeg_key(F.col("path")).alias("stem"), X.subject_of(F.col("path")).alias("subject"), X.vigilance_token(state).alias("vigilance"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS chosen, p_type AS other FROM part")
def chosen_channels(spark, sf_dir):
    """A channel by its label, else by its place; annotations don't count for the place of the fallback."""
    p = _table(spark, sf_dir, "part")
    channel = lambda label, dim: F.struct(label.alias("label"), dim.alias("dim"))
    cardiac = F.when(F.col("p_size") % 2 == 0, "EKG left").otherwise("Fp1")
    channels = F.array(channel(F.lit("EDF Annotations"), F.lit("")), channel(F.lit("T3"), F.col("p_type")), channel(cardiac, F.col("p_brand")))
    return p.select("p_partkey", X.pick_channel(channels, "E[CK]G", 0)["dim"].alias("chosen"), X.channels_at(channels, [1])[0]["dim"].alias("other"))


__all__ = ["ORACLES", "QUERIES"]
