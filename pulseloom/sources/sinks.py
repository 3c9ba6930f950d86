"""Sinks: partitioned tables; a file per segment only where the export format asks for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.functions.text import sample_timestamp_ms
from pulseloom.sources.named import write_named

#: The columns of the audit and manifest files, in their order.
AUDIT_COLUMNS = [
    "subject", "run", "onset_s", "duration_s", "type", "localization", "lateralization", "vigilance", "since_prev_s", "since_prev_basis", "lead_seizure",
    "in_recording", "preictal_ok", "ecg_verdict", "bpm", "rr_cv", "ecg_mains_pct", "eeg_clean_pct", "eeg_notes", "usable", "usable_lead",
]
MANIFEST_COLUMNS = ["split", "label", "subject", "segment_id", "lead_seizure", "vigilance", "duration_s", "file"]


def write_labelled_windows(windows: DataFrame, path: str) -> None:
    """`windows(subject, file, start_sample, label, ch1..)` partitioned by class."""
    named = windows.withColumn("window", F.concat("file", F.lit("_"), F.col("start_sample")))
    named.withColumn("class", F.when(F.col("label") == 1, "seizure").otherwise("non_seizure")).write.mode("overwrite").partitionBy("class").parquet(path)


def audit_text(audit: DataFrame) -> DataFrame:
    """Audit rows as they are written: fixed order, whole seconds, two-place ratios, empty text for null."""
    text = lambda c, f: F.when(F.col(c).isNotNull(), F.format_string(f, F.col(c).cast("double")))
    whole = lambda c: F.bround(F.col(c), 0).cast("long").cast("string")
    made = {"since_prev_s": whole("since_prev_s"), "bpm": whole("bpm"), "rr_cv": text("rr_cv", "%.2f"), "ecg_mains_pct": whole("ecg_mains_pct"), "eeg_clean_pct": whole("eeg_clean_pct")}
    flag = lambda c: F.when(F.col(c), "True").otherwise("False")
    flags = {c: flag(c) for c in ("in_recording", "preictal_ok", "usable", "usable_lead")}
    every = made | flags
    return audit.select(*[F.coalesce(every.get(c, F.col(c).cast("string")), F.lit("")).alias(c) for c in AUDIT_COLUMNS])


def write_audit(audit: DataFrame, path: str) -> None:
    audit_text(audit).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_catalog(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True, emptyValue="")


def write_segments(segments: DataFrame, path: str) -> None:
    """Signals as array columns with masks and labels, by subject."""
    segments.write.mode("overwrite").partitionBy("subject").parquet(path)


def training_rows(segments: DataFrame, fs: float = 256.0) -> DataFrame:
    """`segments(split, label, segment_id, bte, cross[, ecg])` -> one row per sample: idx, timestamp (ms, 5 places), values (2 places)."""
    channels = ["bte", "cross", *(["ecg"] if "ecg" in segments.columns else [])]
    rows = segments.select("split", "label", "segment_id", F.posexplode(F.arrays_zip(*channels)).alias("idx", "v"))
    values = [F.format_string("%.2f", F.col(f"v.{c}").cast("double")).alias(c) for c in channels]
    return rows.select("split", "label", "segment_id", "idx", sample_timestamp_ms(F.col("idx"), fs).alias("timestamp"), *values)


def export_files(segments: DataFrame, fs: float = 256.0) -> DataFrame:
    """The export's files as rows (name, seq, data): `{split}/{label}.{segment_id}.csv`, a header and a line for each sample."""
    channels = ["bte", "cross", *(["ecg"] if "ecg" in segments.columns else [])]
    name = F.concat("split", F.lit("/"), "label", F.lit("."), F.col("segment_id").cast("string"), F.lit(".csv")).alias("name")
    lines = training_rows(segments, fs).select(name, F.col("idx").cast("long").alias("seq"), F.concat(F.concat_ws(",", "timestamp", *channels), F.lit("\n")).alias("data"))
    heads = segments.select(name, F.lit(-1).cast("long").alias("seq"), F.lit(",".join(["timestamp", *channels]) + "\n").alias("data"))
    return heads.unionByName(lines)


def write_training_export(segments: DataFrame, path: str, fs: float = 256.0, flat: bool = False) -> None:
    """A CSV file per segment, in folders by split, label and segment; `{split}/{label}.{segment_id}.csv` if `flat`.

    Flat files are written under their names by the tasks themselves; the driver moves nothing.
    """
    if flat:
        write_named(export_files(segments, fs), path)
        return
    rows = training_rows(segments, fs).repartition("split", "label", "segment_id").sortWithinPartitions("split", "label", "segment_id", "idx")
    rows.drop("idx").write.mode("overwrite").partitionBy("split", "label", "segment_id").option("maxRecordsPerFile", 0).csv(path, header=True)


def write_features(features: DataFrame, path: str, reuse: bool = True) -> DataFrame:
    """Feature rows by subject; an earlier table at the path is read back instead if `reuse`."""
    spark = features.sparkSession
    if reuse:
        try:
            return spark.read.parquet(path)
        except Exception as e:  # only a missing table is no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
    features.write.mode("overwrite").partitionBy("subject").parquet(path)
    return spark.read.parquet(path)


def write_manifest(segments: DataFrame, path: str) -> None:
    segments.select(*MANIFEST_COLUMNS).write.mode("overwrite").csv(path, header=True)
