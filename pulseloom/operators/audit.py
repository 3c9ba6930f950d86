"""Audit of annotated seizures: gaps, lead labels, gates, verdict joins and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREICTAL_S, LEAD_S, TOLERANCE_S, MIN_CLEAN = 240.0, 1800.0, 2.0, 0.75
GOOD_VERDICTS = ("clean", "usable", "recovered")


def gap_from_previous(seizures: DataFrame) -> DataFrame:
    """Adds `prev_end` (end of the seizure just before in the run) and `since_prev_run`; `preictal_ok_run`."""
    w = Window.partitionBy("subject", "run").orderBy("onset_s", "ann_id")
    df = seizures.withColumn("prev_end", F.lag(F.col("onset_s") + F.col("duration_s")).over(w))
    df = df.withColumn("since_prev_run", F.col("onset_s") - F.col("prev_end"))
    return df.withColumn("preictal_ok_run", preictal_ok(F.col("onset_s"), F.col("since_prev_run")))


def preictal_ok(onset: Column, since_prev: Column, window_s: float = PREICTAL_S) -> Column:
    return (onset >= window_s) & (since_prev.isNull() | (since_prev >= window_s))


def in_recording(onset: Column, duration: Column, rec_duration: Column, tol: float = TOLERANCE_S) -> Column:
    return rec_duration.isNull() | (onset + duration <= rec_duration + tol)


def timing_basis(runs: DataFrame) -> DataFrame:
    """`runs(subject, start_ts)` -> subject, use_clock: every start known, all distinct, and not all in 2000 or before."""
    known = F.count("start_ts") == F.count(F.lit(1))
    return runs.groupBy("subject").agg((known & (F.count_distinct("start_ts") == F.count(F.lit(1))) & F.coalesce(F.max(F.year("start_ts")) > 2000, F.lit(False))).alias("use_clock"))


def lead_labels(seizures: DataFrame, basis: DataFrame | None = None, lead_s: float = LEAD_S) -> DataFrame:
    """Adds since_prev_s, since_prev_basis, lead_seizure (yes / no / unknown).

    With a usable clock (`basis(subject, use_clock)` and a `start_ts` column)
    seizures are ordered by absolute onset over all runs of the subject; else
    within the run, where the first seizure only has a lower bound.
    """
    run = Window.partitionBy("subject", "run").orderBy("onset_s", "ann_id")
    df = seizures.withColumn("prev_run", F.lag(F.col("onset_s") + F.col("duration_s")).over(run))
    same = F.when(F.col("prev_run").isNotNull(), F.col("onset_s") - F.col("prev_run")).otherwise(F.col("onset_s"))
    how = F.when(F.col("prev_run").isNotNull(), "same run").otherwise(">= (from run start)")
    if basis is not None:
        df = df.join(basis, "subject", "left")
        start = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("start_ts").cast("timestamp_ntz")) / 1e6  # no time zone, so no hour is lost
        df = df.withColumn("abs_on", F.when(F.col("use_clock"), start + F.col("onset_s")))
        whole = Window.partitionBy("subject").orderBy("abs_on", "ann_id")
        df = df.withColumn("prev_abs", F.lag(F.col("abs_on") + F.col("duration_s")).over(whole))
        clock = F.col("use_clock") & F.col("abs_on").isNotNull()
        since = F.when(clock, F.col("abs_on") - F.col("prev_abs")).otherwise(same)
        how = F.when(clock, F.when(F.col("prev_abs").isNull(), "first seizure").otherwise("EDF clock")).otherwise(how)
    else:
        since = same
    df = df.withColumn("since_prev_s", since).withColumn("since_prev_basis", how)
    first = F.col("since_prev_basis") == "first seizure"
    lead = F.when(first | (F.col("since_prev_s") >= lead_s), "yes").when(F.startswith("since_prev_basis", F.lit(">=")), "unknown").otherwise("no")
    return df.withColumn("lead_seizure", lead).drop("prev_run", "abs_on", "prev_abs", "use_clock")


def usable(in_rec: Column, pre_ok: Column, verdict: Column, clean: Column) -> Column:
    return F.coalesce(in_rec & pre_ok & verdict.isin(*GOOD_VERDICTS) & (clean >= MIN_CLEAN), F.lit(False))


def skip_reason(in_rec: Column, pre_ok: Column, verdict: Column, clean: Column) -> Column:
    """Why a seizure isn't usable; null if it is."""
    quality = F.concat_ws(
        ", ",
        F.when(~verdict.isin(*GOOD_VERDICTS), F.concat(F.lit("ECG "), verdict)),
        F.when(clean < MIN_CLEAN, F.concat(F.lit("EEG only "), F.bround(clean * 100, 0).cast("int"), F.lit("% clean"))),
    )
    return F.when(~in_rec, "outside recording").when(~pre_ok, "no clean pre-ictal").when(quality != "", quality)


def audit_quality_join(seizures: DataFrame, quality: DataFrame, key: str = "ann_id") -> DataFrame:
    """Verdicts for seizures that pass both gates, `n/a` for the rest; without an ECG `no_ecg`.

    `seizures` has in_recording, preictal_ok and since/lead columns; `quality(key, ecg_verdict, eeg_clean)`.
    """
    gate = F.col("in_recording") & F.col("preictal_ok")
    df = seizures.join(quality, key, "left")
    df = df.withColumn("ecg_verdict", F.when(~gate, "n/a").otherwise(F.coalesce("ecg_verdict", F.lit("no_ecg"))))
    df = df.withColumn("eeg_clean", F.when(gate, F.col("eeg_clean")))
    ok = usable(F.col("in_recording"), F.col("preictal_ok"), F.col("ecg_verdict"), F.col("eeg_clean"))
    df = df.withColumn("usable", ok).withColumn("usable_lead", ok & (F.col("lead_seizure") == "yes"))
    return df.withColumn("skip_reason", skip_reason(F.col("in_recording"), F.col("preictal_ok"), F.col("ecg_verdict"), F.col("eeg_clean")))


def audit_rollup(audit: DataFrame) -> DataFrame:
    """Per subject and in total (subject null): seizures, checked, usable, usable_lead, EEG and lead counts, usable_pct."""
    flag = lambda c: F.count_if(c)
    return audit.rollup("subject").agg(
        F.count("*").alias("seizures"), flag(F.col("in_recording") & F.col("preictal_ok")).alias("checked"), flag(F.col("usable")).alias("usable"),
        flag(F.col("usable_lead")).alias("usable_lead"), flag(F.col("eeg_clean") >= MIN_CLEAN).alias("eeg_ok"),
        flag(F.col("lead_seizure") == "yes").alias("lead_yes"), flag(F.col("lead_seizure") == "no").alias("lead_no"),
        flag(F.col("lead_seizure") == "unknown").alias("lead_unknown"),
        F.round(100.0 * flag(F.col("usable")) / F.count("*"), 6).alias("usable_pct"), F.grouping("subject").cast("int").alias("is_total"),
    )


def verdict_counts(audit: DataFrame) -> DataFrame:
    rows = audit.where(F.col("in_recording") & F.col("preictal_ok"))
    return rows.groupBy("ecg_verdict").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ecg_verdict")


def duration_mismatch(runs: DataFrame, tol: float = TOLERANCE_S) -> DataFrame:
    """Adds `issues` array: durations that differ from the EEG's (or else the annotation's), and files missing or unreadable.

    `runs` has eeg_s, ecg_s, sidecar_s, events_s (doubles) and eeg_error, ecg_error (strings: null, missing, unreadable, incomplete).
    """
    base = F.coalesce("eeg_s", "events_s")
    named = F.array(*[F.struct(F.lit(n).alias("label"), F.col(c).alias("val")) for n, c in (("ECG EDF", "ecg_s"), ("JSON", "sidecar_s"), ("events", "events_s"))])
    odd = F.filter(named, lambda x: x["val"].isNotNull() & (F.abs(x["val"] - base) > tol))
    said = F.transform(odd, lambda x: F.format_string("%s %.1f s", x["label"], x["val"]))
    files = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{n} "), F.col(c))) for n, c in (("EEG", "eeg_error"), ("ECG", "ecg_error"))]), lambda x: x.isNotNull())
    return runs.withColumn("issues", F.concat(files, said))


def assemble_runs(eeg: DataFrame, ecg: DataFrame, sidecar: DataFrame, events: DataFrame) -> DataFrame:
    """Run records from four sources on (subject, run); missing sides stay null."""
    key = ["subject", "run"]
    out = events
    for other in (eeg, ecg, sidecar):
        out = out.join(other, key, "left")
    return out


def eeg_clean_fraction(flags: DataFrame) -> DataFrame:
    """`flags(id, win, channel, bad)` -> id, n_win, clean (share of windows where no channel is bad), notes by bad count."""
    win = flags.groupBy("id", "win").agg(F.bool_or("bad").alias("bad"))
    clean = win.groupBy("id").agg(F.count("*").alias("n_win"), F.avg((~F.col("bad")).cast("double")).alias("clean"))
    chan = flags.groupBy("id", "channel").agg(F.count_if("bad").alias("k"), F.count("*").alias("n")).where("k > 0")
    note = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), "channel", "k", "n"))), lambda x: F.concat(x["channel"], F.lit(" "), x["k"], F.lit("/"), x["n"])), ", ")
    return clean.join(chan.groupBy("id").agg(note.alias("notes")), "id", "left")
