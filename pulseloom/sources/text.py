"""Text sources: sectioned logs, BIDS tables, sidecars, inventories, header repair.

Files become numbered lines split by split; sections are running counts of header
lines, made in chunks of a file's lines and added up over the chunks before. No
file is one row or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.functions.text import first_int, to_seconds

EVENTS = "onset double, duration double, eventType string, lateralization string, localization string, vigilance string, recordingDuration string"
AUDIT = (
    "subject string, run string, onset_s double, duration_s double, type string, localization string, lateralization string, vigilance string, since_prev_s double,"
    " since_prev_basis string, lead_seizure string, in_recording boolean, preictal_ok boolean, ecg_verdict string, bpm double, rr_cv double, ecg_mains_pct double,"
    " eeg_clean_pct double, eeg_notes string, usable boolean, usable_lead boolean"
)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc (file path), line_no from 0, line. Read as ISO-8859-1, which no byte can break; a line ends at LF or CR LF.

    Files are read in splits, so that a file may be larger than a task's memory. A split's lines are numbered as they come,
    and moved on by what the file's earlier splits hold.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("from_"), F.monotonically_increasing_id().alias("row_"), F.col("value").cast("binary").alias("value"))
    splits = raw.groupBy("doc", "from_").agg(F.min("row_").alias("first_"), F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("doc").orderBy("from_").rowsBetween(Window.unboundedPreceding, -1))
    moves = splits.select("doc", "from_", (F.coalesce(before, F.lit(0)) - F.col("first_")).alias("move_"))
    lines = raw.join(F.broadcast(moves), ["doc", "from_"])  # a row for each split, as many as the driver plans
    return lines.select("doc", (F.col("row_") + F.col("move_")).alias("line_no"), F.regexp_replace(F.decode("value", "ISO-8859-1"), r"\r$", "").alias("line"))


#: Line numbers whose headers one task counts.
CHUNK = 1 << 16


def block_id(lines: DataFrame, is_header: Column, doc: str = "doc") -> DataFrame:
    """Adds `block`: how many header lines came so far in the file (0: before the first).

    Headers are counted within chunks of a file's lines; those of the chunks before come in as one more row of each chunk.
    """
    marked = lines.withColumn("head_", F.when(is_header, 1).otherwise(0).cast("long")).withColumn("chunk_", F.floor(F.col("line_no") / CHUNK))
    earlier = Window.partitionBy(doc).orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy(doc, "chunk_").agg(F.sum("head_").alias("head_")).withColumn("head_", F.sum("head_").over(earlier)).where("head_ > 0")
    both = marked.withColumn("first_", F.lit(False)).unionByName(carried.withColumn("first_", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(doc, "chunk_").orderBy(F.desc("first_"), "line_no").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("block", F.sum("head_").over(w)).where("NOT first_").select(*lines.columns, "block")


def pair_by_position(starts: Column, ends: Column, truncate: bool) -> Column:
    """array<struct<start, end>>: the i-th start with the i-th end; pairs lacking a side are cut, or keep a null end."""
    z = F.arrays_zip(starts.alias("start"), ends.alias("end"))
    return F.filter(z, lambda p: p["start"].isNotNull() & (p["end"].isNotNull() if truncate else F.lit(True)))


def _ordered(cond: Column, value: Column) -> Column:
    got = F.sort_array(F.collect_list(F.when(cond & value.isNotNull(), F.struct("line_no", value.alias("v")))))
    return F.transform(got, lambda x: x["v"])


def summary_seizures(lines: DataFrame) -> DataFrame:
    """Summary log lines -> doc, file, start_s, end_s; numbered forms (`Seizure 2 Start Time`) count too."""
    line = F.col("line")
    df = block_id(lines, F.contains(line, F.lit("File Name:")))
    name = F.trim(F.regexp_extract(line, r"File Name:\s*(\S+)", 1))
    after = F.regexp_extract(line, r":(.*)$", 1)
    per = df.where("block > 0").groupBy("doc", "block").agg(
        F.max(F.when(F.contains(line, F.lit("File Name:")), name)).alias("file"),
        _ordered(line.rlike(r"Seizure( \d+)? Start Time:"), first_int(after)).alias("s"), _ordered(line.rlike(r"Seizure( \d+)? End Time:"), first_int(after)).alias("e"),
    )
    return per.select("doc", "file", F.explode(pair_by_position(F.col("s"), F.col("e"), True)).alias("p")).select("doc", "file", F.col("p.start").alias("start_s"), F.col("p.end").alias("end_s"))


def seizure_list(lines: DataFrame) -> DataFrame:
    """Loose list -> doc, block, file (null before the first name), reg_start, reg_end, starts[], ends[] in seconds of day."""
    line = F.lower(F.col("line"))
    names = line.rlike(r"pn\d+[-\w]*\.edf")
    df = block_id(lines, names).withColumn("stamp", to_seconds(F.nullif(F.regexp_extract("line", r"(\d{1,2}[.:]\d{2}[.:]\d{2})", 1), F.lit(""))))
    kind = (
        F.when(names, "name").when(F.contains(line, F.lit("registration start")), "reg_start").when(F.contains(line, F.lit("registration end")), "reg_end")
        .when(F.contains(line, F.lit("seizure start")) | F.contains(line, F.lit("start time")), "start").when(F.contains(line, F.lit("seizure end")) | F.contains(line, F.lit("end time")), "end")
    )
    df = df.withColumn("kind", kind)
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("stamp")), F.when((F.col("kind") == k) & F.col("stamp").isNotNull(), F.col("line_no")))
    per = df.where("kind IS NOT NULL").groupBy("doc", "block").agg(
        F.max(F.when(F.col("kind") == "name", F.regexp_extract("line", r"(?i)(PN\d+[-\w]*\.edf)", 1))).alias("file"),
        last("reg_start").alias("reg_start"), last("reg_end").alias("reg_end"),
        _ordered(F.col("kind") == "start", F.col("stamp")).alias("starts"), _ordered(F.col("kind") == "end", F.col("stamp")).alias("ends"),
    )
    return per


def read_summary_seizures(spark: SparkSession, path: str) -> DataFrame:
    return summary_seizures(numbered_lines(spark, path))


def read_seizure_list(spark: SparkSession, path: str) -> DataFrame:
    return seizure_list(numbered_lines(spark, path))


def _trimmed(df: DataFrame) -> DataFrame:
    return df.select(*[F.trim(f.name).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema.fields])


def read_events(spark: SparkSession, path: str, missing_as_zero: bool = False) -> DataFrame:
    """BIDS events -> path, subject, run, onset_s, duration_s, ..., rec_s (the file's recording duration), is_seizure."""
    df = spark.read.csv(path, sep="\t", header=True, schema=EVENTS, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, recursiveFileLookup=True, pathGlobFilter="*_events.tsv")
    df = df.withColumn("path", F.col("_metadata.file_path"))
    rec = F.nullif(F.nullif(F.col("recordingDuration"), F.lit("n/a")), F.lit("")).try_cast("double")
    whole = F.max(rec).over(Window.partitionBy("path"))
    df = df.withColumn("rec_s", F.coalesce(whole, F.lit(0.0)) if missing_as_zero else whole)
    df = df.withColumn("subject", F.regexp_extract("path", r"/(sub-[^/_]+)", 1)).withColumn("run", F.nullif(F.regexp_extract("path", r"run-(\d+)", 1), F.lit("")).try_cast("int"))
    return df.withColumnRenamed("onset", "onset_s").withColumnRenamed("duration", "duration_s").withColumn("is_seizure", F.coalesce(F.startswith("eventType", F.lit("sz")), F.lit(False))).drop("recordingDuration")


def read_participants(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Distinct participant ids in order; the first n if asked."""
    df = spark.read.csv(path, sep="\t", header=True).select(F.trim("participant_id").alias("subject")).where("subject <> ''").distinct().orderBy("subject")
    return df.limit(first) if first else df


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """path, rec_s: the numeric RecordingDuration of each JSON file; null if malformed, absent or a string."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("v"))
    field = F.try_variant_get("v", "$.RecordingDuration", "variant")
    number = F.when(~F.contains(F.schema_of_variant(field), F.lit("STRING")), F.try_variant_get("v", "$.RecordingDuration", "double"))
    return raw.select("path", number.alias("rec_s"))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Remote listing: key, size."""
    return spark.read.csv(path, schema="key string, size long", header=True)


def local_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files under a root as key (relative), size; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = root.removeprefix("file://").rstrip("/") + "/"
    return df.select(F.col("path").substr(F.locate(base, "path") + len(base), F.length("path")).alias("key"), F.col("length").alias("size"))


def read_audit(spark: SparkSession, path: str, select: str | None = "usable") -> DataFrame:
    """Audit rows, those whose flag column is true."""
    df = spark.read.csv(path, header=True, schema=AUDIT)
    return df.where(F.col(select)) if select else df


def read_segment_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _trimmed(spark.read.csv(path, header=True, schema=schema))


def repair_header(lines: DataFrame, header: str, marker: str = "ch1", have: str = "CH6") -> DataFrame:
    """Numbered CSV lines -> doc, line_no, line with one header, and `repaired`.

    The second line goes if it holds the marker in any case; the header is put
    first unless the first line has `have`.
    """
    again = (F.col("line_no") == 1) & F.contains(F.lower("line"), F.lit(marker.lower()))
    per = lines.groupBy("doc").agg(F.bool_or(again).alias("doubled"), F.bool_or((F.col("line_no") == 0) & F.contains("line", F.lit(have))).alias("headed"))
    kept = lines.where(~again).join(per, "doc").select("doc", "line_no", "line", F.col("doubled").alias("repaired"))
    top = per.where("NOT headed").select("doc", F.lit(-1).cast("int").alias("line_no"), F.lit(header).alias("line"), F.col("doubled").alias("repaired"))
    return kept.unionByName(top)


def repaired_count(repaired: DataFrame) -> DataFrame:
    return repaired.where("repaired").agg(F.count_distinct("doc").alias("repaired_files"))
