"""Registered queries of the sources and sinks: given tables are written in a file format, read back, and held to SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.functions import arrays as A
from pulseloom.plans.extra import _table
from pulseloom.plans.registry import _AUDIT, ORACLES, QUERIES, _audit, query
from pulseloom.plans.views import view
from pulseloom.sources import edf as E
from pulseloom.sources import sinks as K
from pulseloom.sources import text as T
from pulseloom.sources.named import write_named
from pulseloom.sources.staging import scratch

# ---- EDF ---------------------------------------------------------------------------

def _file() -> Column:
    return F.regexp_extract("path", r"rec-(\d+)\.edf$", 1).cast("long")


def _recordings(spark: SparkSession, sf_dir: str) -> str:
    """The vectors as records of two channels at 32 Hz, a hundred to a recording; digital steps are thousandths."""
    e = _table(spark, sf_dir, "embeddings")
    half = lambda at: F.slice("embedding", at, 32).cast("array<double>")
    root = scratch(spark, "edf")
    E.write_edf(e.select(F.expr("vec_id DIV 100").alias("file"), (F.col("vec_id") % 100).alias("record"), F.array(half(1), half(33)).alias("samples")), root, ["EEG left", "EEG right"], prefix="rec-")
    return root


_DIGITAL = "d AS (SELECT vec_id, vec_id // 100 AS file, generate_subscripts(embedding, 1) - 1 AS i, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 1000) AS BIGINT) AS v FROM embeddings)"


def _thousandths(signal) -> Column:
    return F.transform(signal, lambda v: F.round(v.cast("double") * 1000).cast("long"))


_SUM = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)


@query(f"WITH {_DIGITAL} SELECT vec_id, CAST(i // 32 AS INTEGER) AS ch, CASE WHEN i // 32 = 0 THEN 'EEG left' ELSE 'EEG right' END AS label, CAST(count(*) AS INTEGER) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (i % 32 + 1)) AS BIGINT) AS weighted FROM d GROUP BY 1, 2, 3")
def edf_samples(spark, sf_dir):
    """Recordings written as EDF and read back record by record through the data source."""
    s = E.read_edf(spark, _recordings(spark, sf_dir), records=1).withColumn("v", _thousandths(F.col("signal")))
    weighted = _SUM(F.transform("v", lambda v, i: v * (i + 1)))
    return s.select((_file() * 100 + F.expr("first DIV 32")).alias("vec_id"), "ch", "label", F.size("v").alias("n"), _SUM(F.col("v")).alias("total"), weighted.alias("weighted"))


@query("SELECT vec_id // 100 AS file, CAST(count(*) AS DOUBLE) AS duration_s, 2 AS channels, count(*) * 32 AS n_samples, 'EEG left,EEG right' AS labels, CAST(32 AS DOUBLE) AS fs FROM embeddings GROUP BY 1")
def edf_header_rows(spark, sf_dir):
    h = E.edf_headers(spark, _recordings(spark, sf_dir))
    return h.select(_file().alias("file"), "duration_s", F.size("channels").alias("channels"), F.col("channels")[0]["n_samples"].alias("n_samples"), F.array_join(F.transform("channels", lambda c: c["label"]), ",").alias("labels"), F.col("channels")[1]["fs"].alias("fs"))


@query(f"WITH {_DIGITAL}, s AS (SELECT vec_id, file, i // 32 AS ch, vec_id % 100 * 32 + i % 32 AS at, v FROM d) SELECT e.vec_id, CAST(count(s.v) AS INTEGER) AS n, CAST(coalesce(sum(s.v), 0) AS BIGINT) AS total FROM embeddings e LEFT JOIN s ON s.file = e.vec_id // 100 AND s.ch = e.vec_id % 2 AND s.at >= e.vec_id % 100 * 32 + 8 AND s.at < e.vec_id % 100 * 32 + 48 GROUP BY 1")
def edf_slices(spark, sf_dir):
    """A slice for each vector: 1.25 seconds from a quarter of a second into its record, of one channel, cut at the file's end."""
    root = _recordings(spark, sf_dir)
    paths = E.edf_headers(spark, root).select("path", _file().alias("file"))
    asked = _table(spark, sf_dir, "embeddings").select("vec_id", F.expr("vec_id DIV 100").alias("file"), (F.col("vec_id") % 2).cast("int").alias("ch"), (F.col("vec_id") % 100 + 0.25).alias("t0_s"), F.lit(1.25).alias("dur_s"))
    got = E.read_segments(spark, asked.join(paths, "file"))
    return got.select("vec_id", F.size("signal").alias("n"), _SUM(_thousandths(F.col("signal"))).alias("total"))


# ---- text formats ----------------------------------------------------------------------


def _stamp(seconds) -> Column:
    part = lambda of: F.lpad(of.cast("string"), 2, "0")
    return F.concat_ws(".", part(F.floor(seconds / 3600)), part(F.floor(seconds / 60) % 60), part(seconds % 60))


@query("SELECT o_custkey % 10 AS list, 'PN' || lpad(CAST(o_custkey % 14 AS VARCHAR), 2, '0') || '-' || o_orderkey || '.edf' AS file, CAST(o_orderkey * 37 % 86400 AS INTEGER) AS reg_start, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS seizures, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey * 41 % 86400 AS INTEGER) END AS start_s, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey * 43 % 86400 AS INTEGER) END AS end_s FROM orders")
def listed_seizures(spark, sf_dir):
    """Orders as blocks of loose seizure lists, written and read: some without a seizure, some without its end."""
    o = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    lines = F.array_compact(F.array(
        F.format_string("PN%02d-%d.edf", F.col("o_custkey") % 14, key), F.concat(F.lit("Registration start time: "), _stamp(key * 37 % 86400)),
        F.when(key % 3 != 0, F.concat(F.lit("Seizure start time: "), _stamp(key * 41 % 86400))), F.when(key % 3 == 1, F.concat(F.lit("Seizure end time: "), _stamp(key * 43 % 86400))),
    ))
    root = scratch(spark, "lists")
    write_named(o.select(F.format_string("list-%d.txt", F.col("o_custkey") % 10).alias("name"), key.alias("seq"), F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("data")), root)
    got = T.read_seizure_list(spark, root).where("file IS NOT NULL")
    return got.select(F.regexp_extract("doc", r"list-(\d+)", 1).cast("long").alias("list"), "file", "reg_start", F.size("starts").alias("seizures"), F.get("starts", F.lit(0)).alias("start_s"), F.get("ends", F.lit(0)).alias("end_s"))


@query("SELECT 'sub-' || lpad(CAST(o_custkey % 20 AS VARCHAR), 3, '0') AS subject, CAST(o_orderkey // 1000 AS INTEGER) AS run, CAST(o_orderkey % 1000 AS DOUBLE) AS onset_s, CAST(o_orderkey % 90 AS DOUBLE) AS duration_s, o_orderkey % 4 <> 0 AS is_seizure, CASE WHEN (o_orderkey // 1000) % 3 <> 0 THEN CAST(4000 AS DOUBLE) END AS rec_s FROM orders")
def bids_events(spark, sf_dir):
    """Orders as event tables by subject and run, written and read."""
    o = _table(spark, sf_dir, "orders")
    subject, run, key = F.format_string("sub-%03d", F.col("o_custkey") % 20), F.expr("o_orderkey DIV 1000"), F.col("o_orderkey")
    name = F.format_string("%1$s/ses-01/eeg/%1$s_run-%2$02d_events.tsv", subject, run)
    kind, rec = F.when(key % 4 == 0, "bckg").otherwise("sz_foc"), F.when(run % 3 == 0, "n/a").otherwise("4000")
    row = F.concat_ws("\t", (key % 1000).cast("string"), F.concat((key % 90).cast("string"), F.lit(" ")), kind, F.lit("left"), F.lit("n/a"), F.lit("un"), rec)
    rows = o.select(name.alias("name"), key.alias("seq"), F.concat(row, F.lit("\n")).alias("data"))
    header = "onset\tduration\teventType\tlateralization\tlocalization\tvigilance\trecordingDuration\n"
    root = scratch(spark, "events")
    write_named(rows.unionByName(rows.select("name", F.lit(-1).cast("long").alias("seq"), F.lit(header).alias("data")).distinct()), root)
    return T.read_events(spark, root).select("subject", "run", "onset_s", "duration_s", "is_seizure", "rec_s")


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN CAST(s_suppkey * 10 AS DOUBLE) WHEN 1 THEN s_suppkey + CAST(0.5 AS DOUBLE) END AS rec_s FROM supplier")
def sidecar_durations(spark, sf_dir):
    """Suppliers as JSON sidecars: whole, fractional, quoted and broken durations."""
    s = _table(spark, sf_dir, "supplier").select("s_suppkey")
    key = F.col("s_suppkey").cast("string")
    body = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit('{"RecordingDuration": '), (F.col("s_suppkey") * 10).cast("string"), F.lit("}"))).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit('{"a": 1, "RecordingDuration": '), key, F.lit(".5}")))
    body = F.coalesce(body.when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit('{"RecordingDuration": "'), key, F.lit('"}'))), F.lit('{"RecordingDuration": '))
    root = scratch(spark, "sidecars")
    write_named(s.select(F.concat(F.lit("run-"), key, F.lit("_eeg.json")).alias("name"), F.lit(0).cast("long").alias("seq"), body.alias("data")), root)
    return T.read_sidecars(spark, root).select(F.regexp_extract("path", r"run-(\d+)_", 1).cast("long").alias("s_suppkey"), "rec_s")


@query("SELECT DISTINCT 'sub-' || c_nationkey || '-' || c_custkey % 50 AS subject FROM customer")
def participants(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    root = scratch(spark, "participants")
    c.select(F.format_string(" sub-%d-%d", "c_nationkey", F.col("c_custkey") % 50).alias("participant_id"), F.col("c_mktsegment").alias("group")).write.csv(root, sep="\t", header=True)
    return T.read_participants(spark, root)


@query("SELECT key, size FROM fx_remote", "fx_remote")
def listed_inventory(spark, sf_dir):
    root = scratch(spark, "inventory")
    view(spark, sf_dir, "fx_remote").select("key", "size").write.csv(root, header=True)
    return T.read_inventory(spark, root)


@query(f"WITH {_AUDIT.strip()} SELECT subject, CAST(run AS VARCHAR) AS run, onset_s, CAST(round_even(since_prev_s, 0) AS DOUBLE) AS since_prev_s, since_prev_basis, lead_seizure, ecg_verdict, usable_lead FROM (SELECT *, usable AND lead_seizure = 'yes' AS usable_lead FROM us) WHERE usable", "fx_annot")
def audit_file(spark, sf_dir):
    """The audit written as its CSV file, and its usable rows read back."""
    a = _audit(spark, sf_dir)
    for c, kind in (f.split(" ") for f in T.AUDIT.replace(",\n", ", ").split(", ")):
        if c not in a.columns:
            a = a.withColumn(c, F.lit(None).cast(kind))
    root = scratch(spark, "audit")
    K.write_audit(a, root)
    return T.read_audit(spark, root).select("subject", "run", "onset_s", "since_prev_s", "since_prev_basis", "lead_seizure", "ecg_verdict", "usable_lead")


@query("SELECT CASE WHEN label = 1 THEN 'seizure' ELSE 'non_seizure' END AS class, subject || '.edf_' || CAST(t_start_s * 256 AS BIGINT) AS window, round(CAST(features[1] AS DOUBLE), 6) AS ch1 FROM fx_features", "fx_features")
def labelled_window_files(spark, sf_dir):
    f = view(spark, sf_dir, "fx_features")
    root = scratch(spark, "windows")
    K.write_labelled_windows(f.select("subject", F.concat("subject", F.lit(".edf")).alias("file"), (F.col("t_start_s") * 256).cast("long").alias("start_sample"), "label", F.col("features")[0].cast("double").alias("ch1")), root)
    return spark.read.parquet(root).select("class", "window", F.round("ch1", 6).alias("ch1"))


@query("SELECT DISTINCT subject, segment_id, CASE WHEN label = 1 THEN 'seizure' ELSE 'non_seizure' END AS label, subject || '/' || segment_id || '.csv' AS file FROM fx_features", "fx_features")
def manifest_file(spark, sf_dir):
    f = view(spark, sf_dir, "fx_features").select("subject", "segment_id", F.when(F.col("label") == 1, "seizure").otherwise("non_seizure").alias("label")).distinct()
    root = scratch(spark, "manifest")
    K.write_manifest(f.select("*", F.lit("training").alias("split"), F.lit("yes").alias("lead_seizure"), F.lit("awake").alias("vigilance"), F.lit(2.0).alias("duration_s"), F.format_string("%s/%d.csv", "subject", "segment_id").alias("file")), root)
    m: DataFrame = spark.read.csv(root, header=True)
    return m.select("subject", F.col("segment_id").cast("long").alias("segment_id"), "label", "file")


@query("SELECT vec_id, CASE WHEN n = 0 THEN '' ELSE CAST(n AS VARCHAR) || ',' || first || ',' || last END AS shown FROM (SELECT vec_id, 64 AS n, format('{:.2f}', round(round(CAST(embedding[1] AS DOUBLE) * 100, 6), 2) + 0.0::DOUBLE) AS first, format('{:.2f}', round(round(CAST(embedding[64] AS DOUBLE) * 100, 6), 2) + 0.0::DOUBLE) AS last FROM embeddings)")
def export_file_lines(spark, sf_dir):
    """The training export written to its flat names; of each file its number of samples, first and last value."""
    scaled = F.transform("embedding", lambda v: A.rounded_product(A.rounded_product(v.cast("double") * 100, 6), 2))
    root = scratch(spark, "export")
    K.write_training_export(_table(spark, sf_dir, "embeddings").select(F.lit("training").alias("split"), F.lit("seizure").alias("label"), F.col("vec_id").alias("segment_id"), scaled.alias("bte"), scaled.alias("cross")), root, flat=True)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    lines = F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: x != "")
    value = lambda i: F.element_at(F.split(F.element_at(lines, i), ","), 2)
    return files.select(F.regexp_extract("path", r"\.(\d+)\.csv$", 1).cast("long").alias("vec_id"), F.concat_ws(",", (F.size(lines) - 1).cast("string"), value(2), value(-1)).alias("shown"))


__all__ = ["ORACLES", "QUERIES"]
