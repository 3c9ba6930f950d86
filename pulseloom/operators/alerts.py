"""Alerts against seizures: as-of searches and interval joins within a recording, and their metrics.

Whether a moment lies in some interval, and which alert was the last before it,
are as-of questions: the greatest end, or alert, so far. They are answered by one
sort of both sides together (`scan.latest`), without a join. Where pairs are
wanted (alignment to onsets), intervals are dealt to cells of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.operators.scan import latest, overlaps


def label_windows(windows: DataFrame, seizures: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `label`: 1 if the window [t_start_s, t_end_s] touches any seizure [onset_s, end_s] (both closed), else 0.

    It does if, of the seizures that begin by its end, the last to end ends at its start or later.
    """
    seen = latest(windows, seizures, keys, F.col("t_end_s"), F.col("onset_s"), F.col("end_s"), "seen_")
    return seen.withColumn("label", F.coalesce(F.col("seen_") >= F.col("t_start_s"), F.lit(False)).cast("int")).drop("seen_")


def early_warning(alerts: DataFrame, seizures: DataFrame, keys: list[str]) -> DataFrame:
    """Each seizure with the last alert strictly before it: `last_alert`, `ewt` (null if none), `detected`."""
    s = seizures.select(*keys, "onset_s", "end_s")
    out = latest(s, alerts, keys, F.col("onset_s"), F.col("time"), F.col("time"), "last_alert", strict=True)
    return out.withColumn("ewt", F.col("onset_s") - F.col("last_alert")).withColumn("detected", F.col("last_alert").isNotNull())


def false_alarms(alerts: DataFrame, seizures: DataFrame, keys: list[str], before_s: float = 60.0) -> DataFrame:
    """Alerts outside every closed [onset - before_s, end]."""
    seen = latest(alerts, seizures, keys, F.col("time"), F.col("onset_s") - before_s, F.col("end_s"), "seen_")
    return seen.where("NOT coalesce(seen_ >= time, false)").drop("seen_")


def align_to_onset(rows: DataFrame, seizures: DataFrame, keys: list[str], pre_s: float = 600.0, post_s: float = 60.0) -> DataFrame:
    """Rows from `pre_s` before to `post_s` after each onset, with `onset_s` and `aligned` = time - onset."""
    s = seizures.select(*keys, "onset_s").distinct().withColumn("from_", F.col("onset_s") - pre_s).withColumn("to_", F.col("onset_s") + post_s)
    near = overlaps(rows, s, keys, ("time", "time"), ("from_", "to_"), pre_s + post_s).drop("from_", "to_")
    return near.withColumn("aligned", F.col("time") - F.col("onset_s"))


def file_alert_metrics(scores: DataFrame, alerts: DataFrame, seizures: DataFrame, keys: list[str]) -> DataFrame:
    """Per recording: sensitivity (null without seizures), ewt (mean, 0 if none), fa_hr (0 without duration)."""
    span = scores.groupBy(*keys).agg((F.max_by("time", "win_idx") / 3600).alias("hours"))
    ew = early_warning(alerts, seizures, keys)
    ew = ew.groupBy(*keys).agg(F.avg(F.col("detected").cast("double")).alias("sensitivity"), F.avg("ewt").alias("ewt"), F.count("*").alias("n_seizures"))
    fa = false_alarms(alerts, seizures, keys).groupBy(*keys).agg(F.count("*").alias("fa"))
    out = span.join(ew, keys, "left").join(fa, keys, "left")
    rate = F.when(F.col("hours") > 0, F.coalesce("fa", F.lit(0)) / F.col("hours")).otherwise(F.lit(0.0))
    return out.select(*keys, "sensitivity", F.coalesce("ewt", F.lit(0.0)).alias("ewt"), rate.alias("fa_hr"), F.coalesce("n_seizures", F.lit(0)).alias("n_seizures"))


def subject_alert_summary(files: DataFrame, subject: str = "subject") -> DataFrame:
    """Per subject: mean of known sensitivities, of positive warning times, of false alarm rates over all files."""
    return files.groupBy(subject).agg(
        F.coalesce(F.avg("sensitivity"), F.lit(0.0)).alias("sensitivity"),
        F.coalesce(F.avg(F.when(F.col("ewt") > 0, F.col("ewt"))), F.lit(0.0)).alias("ewt"),
        F.avg("fa_hr").alias("fa_hr"),
    )


def best_file(files: DataFrame, keys: list[str]) -> DataFrame:
    """The file with the longest warning time among those with seizures; the first on ties."""
    return files.where((F.col("n_seizures") > 0) & (F.col("ewt") > 0)).orderBy(F.desc("ewt"), *keys).limit(1)


def best_segment(risk: DataFrame, alerts: DataFrame, seizures: DataFrame, keys: list[str], subject: str = "subject", min_rows: int = 200, min_before: int = 100, min_after: int = 20, min_ewt: float = 30.0) -> DataFrame:
    """Per subject the seizure segment with the best warning: keys, onset_s, ewt, n_alerts."""
    mark = alerts.select(*keys, "win_idx", F.lit(True).alias("alert"))
    seg = align_to_onset(risk.join(mark, [*keys, "win_idx"], "left"), seizures, keys)
    per = seg.groupBy(subject, *[k for k in keys if k != subject], "onset_s").agg(
        F.count("*").alias("n"), F.count_if(F.col("aligned") < 0).alias("n_before"), F.count_if(F.col("aligned") >= 0).alias("n_after"),
        F.count_if(F.col("alert")).alias("n_alerts"), F.min(F.when(F.col("alert"), F.col("time"))).alias("first_alert"),
    )
    per = per.withColumn("ewt", F.col("onset_s") - F.col("first_alert"))
    per = per.where((F.col("n") >= min_rows) & (F.col("n_before") >= min_before) & (F.col("n_after") >= min_after) & (F.col("ewt") >= min_ewt))
    rank = F.row_number().over(Window.partitionBy(subject).orderBy(F.desc(F.col("ewt") + 0.1 * F.col("n_alerts")), *keys, "onset_s"))
    return per.withColumn("r", rank).where("r = 1").select(subject, *[k for k in keys if k != subject], "onset_s", "ewt", "n_alerts")


def rank_subjects_by_score(best: DataFrame, subject: str = "subject") -> DataFrame:
    """Subjects by warning time, best first."""
    return best.orderBy(F.desc("ewt"), subject)
