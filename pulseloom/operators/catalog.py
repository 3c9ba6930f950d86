"""Catalogue of annotations, segment requests, splits and object inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.functions.text import lobes_of
from pulseloom.operators.sampling import hash_order, take_exact
from pulseloom.sources.staging import staged


def catalog_totals(recordings: DataFrame, seizures: DataFrame) -> DataFrame:
    """One row: subjects, recordings, with_ecg, hours (sum of hours rounded to 2 places), seizures, preictal_ok, both."""
    r = recordings.agg(
        F.count_distinct("subject").alias("subjects"), F.count("*").alias("recordings"), F.count_if("has_ecg").alias("with_ecg"),
        F.round(F.sum(F.bround("duration_h", 2)), 6).alias("hours"),
    )
    s = seizures.agg(F.count("*").alias("seizures"), F.count_if("preictal_ok").alias("preictal_ok"), F.count_if(F.col("preictal_ok") & F.col("has_ecg")).alias("preictal_ok_ecg"))
    return r.crossJoin(s)  # two single rows


def category_distribution(seizures: DataFrame, values: Column) -> DataFrame:
    """Counts of the values in an array column and their share of all seizures (sums over 100 for multi-label); most frequent first."""
    n = seizures.agg(F.count("*").alias("total"))
    got = seizures.select(F.explode(values).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    out = got.crossJoin(F.broadcast(n))  # one row
    return out.select("category", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct")).orderBy(F.desc("n"), "category")


def lobes_or_unclear(localization: Column) -> Column:
    a = lobes_of(localization)
    return F.when(F.size(a) > 0, a).otherwise(F.array(F.lit("unclear")))


def dominant(seizures: DataFrame, value: Column, order: list[str], by: str = "subject") -> DataFrame:
    """Most frequent value per subject; the first seen on ties."""
    per = seizures.select(by, value.alias("value"), F.struct(*order).alias("o")).groupBy(by, "value").agg(F.count("*").alias("n"), F.min("o").alias("o"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "o"))
    return per.withColumn("r", rank).where("r = 1").select(by, F.col("value").alias("dominant"), "n")


def pilot_subjects(ranked: DataFrame, k: int = 4, least: int = 3) -> DataFrame:
    """`ranked(subject, lobe, n)` -> k subjects: the best of each clear lobe with enough seizures, then by rank."""
    rank = F.row_number().over(Window.partitionBy("lobe").orderBy(F.desc("n"), "subject"))
    pick = (F.col("r") == 1) & (F.col("lobe") != "unclear") & (F.col("n") >= least)
    return ranked.withColumn("r", rank).withColumn("is_pick", pick).orderBy(F.desc("is_pick"), F.desc("n"), "subject").limit(k).select("subject", "lobe", "n", "is_pick")


def flag_ecg(recordings: DataFrame, files: DataFrame) -> DataFrame:
    """Adds `has_ecg`: an ECG file exists under the EEG's stem. `recordings(path)`, `files(path)`."""
    stem = lambda c, tail: F.regexp_replace(c, tail, "")
    ecg = files.where(F.contains("path", F.lit("/ecg/")) & F.endswith("path", F.lit("_ecg.edf")))
    ecg = ecg.select(stem(F.replace("path", F.lit("/ecg/"), F.lit("/eeg/")), "_ecg\\.edf$").alias("stem")).distinct().withColumn("found", F.lit(True))
    out = recordings.withColumn("stem", stem(F.col("path"), "_(events\\.tsv|eeg\\.edf)$")).join(ecg, "stem", "left")
    return out.withColumn("has_ecg", F.coalesce("found", F.lit(False))).drop("found", "stem")


def interictal_candidates(runs: DataFrame, seizures: DataFrame, length_s: float = 240.0, grid_s: int = 60, edge_s: int = 300, away_s: float = 1800.0) -> DataFrame:
    """Grid starts of each run `(subject, run, duration_s)`, a row each, that stay `away_s` from every seizure of the run.

    Each seizure blocks a range of grid numbers. Sorted by their begin, with the greatest end so far, the ranges leave gaps,
    and only these are filled with grid starts: the work is linear in seizures and candidates.
    """
    key = ["subject", "run"]
    grid = runs.select(*key, F.floor((F.col("duration_s") - edge_s - length_s - edge_s) / grid_s).alias("last")).where("last >= 0")
    lo, hi = F.col("onset_s") - away_s - length_s, F.col("onset_s") + F.col("duration_s") + away_s  # both open
    number = lambda t: (t - edge_s) / grid_s
    blocked = seizures.select(*key, (F.floor(number(lo)) + 1).alias("a"), (F.ceil(number(hi)) - 1).alias("b")).where("a <= b AND b >= 0")
    blocked = blocked.groupBy(*key, F.greatest("a", F.lit(0)).alias("a")).agg(F.max("b").alias("b"))  # no more rows than the run's grid
    ends = grid.select(*key, (F.col("last") + 1).alias("a"), F.lit(None).cast("long").alias("b"), "last")
    w = Window.partitionBy(*key).orderBy("a", F.asc_nulls_last("last"))
    free = F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(0))
    marked = blocked.withColumn("last", F.lit(None).cast("long")).unionByName(ends).withColumn("free", free).withColumn("last", F.max("last").over(Window.partitionBy(*key)))
    gaps = marked.withColumn("upto", F.least(F.col("a") - 1, "last")).where("last IS NOT NULL AND free <= upto").select(*key, "free", "upto").distinct()
    return gaps.select(*key, F.explode(F.transform(F.sequence("free", "upto"), lambda i: i * grid_s + edge_s)).alias("t"))


def first_come(rows: DataFrame, apart_s: float) -> DataFrame:
    """Rows (subject, run, t, h) that a greedy pass in the order of (h, t) keeps when kept ones of a run are `apart_s` apart.

    The maximal independent set by rounds of local minima: a row that is first among all undecided ones near it is kept,
    those near it drop out. A round looks at neighbours in time only.
    """
    near = Window.partitionBy("subject", "run").orderBy("t").rangeBetween(-int(apart_s) + 1, int(apart_s) - 1)
    left, kept = staged(rows.select("subject", "run", F.col("t").cast("long").alias("t"), "h"), "undecided"), None
    while True:
        first = left.withColumn("first", F.min(F.struct("h", "t")).over(near) == F.struct("h", "t"))
        told = staged(first.withColumn("beside", F.max("first").over(near)), "round")
        won = told.where("first").select("subject", "run", "t", "h")
        kept = won if kept is None else kept.unionByName(won)
        left = told.where("NOT beside").select("subject", "run", "t", "h")
        if left.isEmpty():
            return kept


def pick_interictal(candidates: DataFrame, need: DataFrame, seed: int = 0, apart_s: float = 240.0, quality=None, factor: int = 4) -> tuple[DataFrame, DataFrame]:
    """Greedy pick of `need(subject, need)` candidates `(subject, run, t)` per subject in the order of a seeded hash.

    A candidate is passed over if it is less than `apart_s` from one picked before it in its run ("overlap"), else if
    `quality(candidates)` gives it a `reason` (a column that it adds; null: good). Only the first `factor` times the need are
    judged; where they don't suffice, twice as many, until the need is met or all are judged. Returns the picks
    (subject, run, t) and, by subject and reason, how many were passed over up to the last pick (`rejected`).
    Candidates and picks pack into files far smaller than they are in memory, so none of them may be broadcast on that account.
    """
    ids = ["subject", "run", "t"]
    quality = quality or (lambda df: df.withColumn("reason", F.lit(None).cast("string")))
    pool = staged(candidates.select("subject", "run", F.col("t").cast("long").alias("t")).join(need.where("need > 0").select("subject", "need"), "subject"), "pool")
    sizes = staged(pool.groupBy("subject", "need").agg(F.count("*").alias("all")), "sizes")
    judged, times = None, factor
    asking = sizes.select("subject", (F.col("need") * times).alias("limit"))
    while True:
        some = take_exact(pool, ["subject"], asking, seed, ids).select(*ids)
        if judged is not None:
            some = some.join(judged.select(*ids).hint("merge"), ids, "left_anti")
        new = quality(some).select(*ids, hash_order(seed, *ids).alias("h"), "reason")
        judged = staged(new if judged is None else judged.unionByName(new), "judged")
        kept = first_come(judged.where("reason IS NULL"), apart_s)
        rank = F.row_number().over(Window.partitionBy("subject").orderBy("h", "run", "t"))
        # No more rows a subject than the candidates judged for it, a multiple of its need.
        picked = staged(kept.withColumn("r", rank).join(need.select("subject", "need"), "subject").where("r <= need"), "picked")
        got = picked.groupBy("subject").agg(F.count("*").alias("got"))
        short = sizes.join(got, "subject", "left").where(f"coalesce(got, 0) < need AND need * {times} < all")
        if short.isEmpty():
            break
        times *= 2
        asking = staged(short.select("subject", (F.col("need") * times).alias("limit")), "asking")
    upto = picked.groupBy("subject").agg(F.max(F.when(F.col("r") == F.col("need"), F.struct("h", "run", "t"))).alias("upto"))
    near = Window.partitionBy("subject", "run").orderBy("t").rangeBetween(-int(apart_s) + 1, int(apart_s) - 1)
    mark = picked.select(*ids, F.lit(True).alias("p")).hint("merge")
    seen = judged.join(mark, ids, "left").withColumn("before", F.min(F.when(F.col("p"), F.struct("h", "run", "t"))).over(near))
    own = F.struct("h", "run", "t")
    seen = seen.join(upto, "subject", "left").where(F.col("p").isNull() & (F.col("upto").isNull() | (own < F.col("upto"))))
    why = F.when(F.col("before") < own, "overlap").otherwise(F.coalesce("reason", F.lit("overlap")))
    return picked.select(*ids), seen.groupBy("subject", why.alias("reason")).agg(F.count("*").alias("rejected"))


def segment_requests(audit: DataFrame, ictal: bool = True, preictal_s: float = 240.0) -> DataFrame:
    """Selected seizures -> one request per segment: kind, t0_s, dur_s, with the seizure's columns."""
    pre = F.struct(F.lit("preictal").alias("kind"), (F.col("onset_s") - preictal_s).alias("t0_s"), F.lit(preictal_s).alias("dur_s"))
    ict = F.struct(F.lit("ictal").alias("kind"), F.col("onset_s").alias("t0_s"), F.col("duration_s").alias("dur_s"))
    return audit.withColumn("q", F.explode(F.array(pre, ict) if ictal else F.array(pre))).select("*", "q.*").drop("q")


def segment_id(subject: Column, run: Column, kind: Column, t0: Column) -> Column:
    return F.concat(subject, F.lit("_run-"), F.lpad(run.cast("string"), 2, "0"), F.lit("_"), kind, F.lit("_"), F.bround(t0, 0).cast("long").cast("string"))


def segment_index(*parts: DataFrame) -> DataFrame:
    """Bag union by name of pre-ictal, ictal and interictal requests."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def lead_only(segments: DataFrame) -> DataFrame:
    """Interictal segments, and those of seizures whose pre-ictal segment is a lead one."""
    key = ["subject", "run", "seizure_onset_s"]
    lead = segments.where("kind = 'preictal' AND lead_seizure = 'yes'").select(*key).distinct()
    return segments.where("kind = 'interictal'").unionByName(segments.where("kind <> 'interictal'").join(lead, key, "left_semi").select(segments.columns))


def assign_split(kind: Column, subject: Column, test_subjects: list[str]) -> Column:
    return F.when(kind == "preictal", "preictal_eval").when(subject.isin(*test_subjects), "testing").otherwise("training")


def segment_label(kind: Column) -> Column:
    return F.when(kind == "ictal", "seizure").when(kind == "interictal", "non_seizure").otherwise(kind)


def label_segments(segments: DataFrame) -> DataFrame:
    """Ictal 1, interictal 0, pre-ictal dropped."""
    return segments.where("kind IN ('ictal', 'interictal')").withColumn("label", F.when(F.col("kind") == "ictal", 1).otherwise(0))


def export_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("split", "label").agg(F.count("*").alias("n")).orderBy("split", "label")


def segment_summary(segments: DataFrame) -> DataFrame:
    """Per kind: segments, windows, windows_ok."""
    return segments.groupBy("kind").agg(F.count("*").alias("segments"), F.sum("n_windows").alias("windows"), F.sum("n_windows_ok").alias("windows_ok"))


def shortfall(got: DataFrame, need: DataFrame) -> DataFrame:
    """Subjects with fewer interictal segments than needed."""
    n = got.groupBy("subject").agg(F.count("*").alias("got"))
    return need.join(n, "subject", "left").select("subject", "need", F.coalesce("got", F.lit(0)).alias("got")).where("got < need")


def missing_objects(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote rows without a local row of the same key and size."""
    return remote.join(local.select("key", "size"), ["key", "size"], "left_anti")


def sync_plan(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Per (subject, modality), per subject and in total: files, bytes, have (bytes there), remaining."""
    have = remote.join(local.select("key", "size").distinct().withColumn("there", F.lit(True)), ["key", "size"], "left")
    return have.rollup("subject", "modality").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum(F.when(F.col("there"), F.col("size")).otherwise(0)).alias("have"),
        F.sum(F.when(F.col("there"), 0).otherwise(F.col("size"))).alias("remaining"),
    )


def fits(remaining: Column, free_bytes: int, keep_free: int) -> Column:
    return F.lit(free_bytes) - remaining >= F.lit(keep_free)


def empty_groups(requested: DataFrame, remote: DataFrame) -> DataFrame:
    """Requested (subject, modality) pairs of which nothing is there."""
    return requested.join(remote.select("subject", "modality").distinct(), ["subject", "modality"], "left_anti")


def unmatched_names(listed: DataFrame, files: DataFrame) -> DataFrame:
    """`listed(subject, file)` names that no file has, in any case; `ambiguous` if the subject has more than one file."""
    low = F.lower("file")
    per = files.groupBy("subject").agg(F.count("*").alias("n_files"))
    lost = listed.withColumn("low", low).join(files.select("subject", low.alias("low")).distinct(), ["subject", "low"], "left_anti").drop("low")
    return lost.join(per, "subject", "left").withColumn("ambiguous", F.coalesce("n_files", F.lit(0)) > 1).drop("n_files")


def subject_info(subjects: DataFrame, info: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Each subject with the first info row whose values, joined, contain its name (any case).

    Containment has no equality to join on, so rows of the sheet are exploded to their substrings of the lengths that
    names have (few), and the join is by hash. A null name has no row, an empty one is contained in the first.
    """
    sizes = [r[0] for r in subjects.where("subject IS NOT NULL").select(F.length(F.upper("subject"))).distinct().collect()]
    text = F.upper(F.concat_ws(" ", *columns))
    cut = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: text.substr(i, F.lit(n))))
    none = F.expr("CAST(array() AS array<string>)")
    parts = F.array_distinct(F.concat(none, *[F.coalesce(cut(n), none) for n in sizes]))
    token = info.select(order, *columns, F.explode(parts).alias("word"))
    hit = subjects.withColumn("word", F.upper("subject")).join(token, "word", "left").drop("word")
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(order))
    return hit.withColumn("r", rank).where("r = 1").drop("r")


def order_events(df: DataFrame, onset: str = "onset_s", *ties: str) -> DataFrame:
    """By subject, run as a number, onset, then `ties`."""
    return df.orderBy("subject", F.col("run").cast("int"), onset, *ties)



def top_categories(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values and their counts, by count and then by value, with their `place` from 1."""
    n = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), column)))  # k rows
