"""Array functions on signals: windows, statistics, rails, quantisation, effective rate (column expressions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _last_start(win: int, inclusive: bool, n_samples: str) -> Column:
    """The greatest sample at which a window may start; below 0 there is none."""
    return F.col(n_samples) - win - (0 if inclusive else 1)


def _timed(df: DataFrame, win: int, fs: str) -> DataFrame:
    s, r = F.col("start_sample"), F.col(fs)
    return df.withColumns({"t_start_s": s / r, "t_end_s": (s + win) / r, "t_mid_s": (s + win // 2) / r})


def sliding_windows(recordings: DataFrame, win: int, step: int, inclusive: bool, n_samples: str = "n_samples", fs: str = "fs") -> DataFrame:
    """One row per window: win_idx, start_sample, t_start_s, t_end_s, t_mid_s.

    Exclusive: starts below N - win (a window that ends exactly at N is dropped).
    Inclusive: floor((N - win) / step) + 1 windows, none if N < win. No samples are copied.
    """
    last = _last_start(win, inclusive, n_samples)
    starts = F.posexplode(F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(step).cast("long"))).alias("win_idx", "start_sample")
    return _timed(recordings.where(last >= 0).select("*", starts), win, fs)


def last_windows(recordings: DataFrame, win: int, step: int, inclusive: bool, n_samples: str = "n_samples", fs: str = "fs") -> DataFrame:
    """The last row that `sliding_windows` gives each recording, without the rows before it: of a grid's extent, win_idx + 1 is the count."""
    last = _last_start(win, inclusive, n_samples).cast("long")
    start = last - last % step
    return _timed(recordings.where(last >= 0).select("*", (start / step).cast("long").alias("win_idx"), start.alias("start_sample")), win, fs)


def tumbling_windows(segments: DataFrame, win_s: float = 2.0, duration: str = "duration_s", fs: str = "fs") -> DataFrame:
    """Adds win, from_sample, to_sample for duration // win_s windows."""
    n = F.floor(F.col(duration) / win_s).cast("int")
    df = segments.where(n > 0).withColumn("win", F.explode(F.sequence(F.lit(0), n - 1)))
    edge = lambda k: F.floor((F.col("win") + k) * win_s * F.col(fs)).cast("long")
    return df.withColumn("from_sample", edge(0)).withColumn("to_sample", edge(1))


def rounded_product(x: Column, places: int) -> Column:
    """x to `places` places as round(x * 10^places) / 10^places, halves away from zero: the product decides, as in numpy and SQL
    engines on doubles. `F.round` looks at the decimal digits that x prints as, and takes 8.995 (stored as 8.99499..) to 9.00."""
    return F.round(x * 10.0**places, 0) / 10.0**places


def signal_stats(x: Column) -> Column:
    """struct(n, min, max, std, p2p, mean, zero_share, repeat_share) of an array; null statistics if it is empty."""
    n = F.size(x).cast("double")
    total = lambda f: F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v.cast("double")))
    mean = total(lambda v: v) / n
    var = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    zero = total(lambda v: F.when(v == 0, 1.0).otherwise(0.0)) / n
    s = F.struct(
        F.size(x).alias("n"), F.array_min(x).cast("double").alias("min"), F.array_max(x).cast("double").alias("max"), F.sqrt(var).alias("std"),
        (F.array_max(x) - F.array_min(x)).cast("double").alias("p2p"), mean.alias("mean"), zero.alias("zero_share"), repeat_share(x).alias("repeat_share"),
    )
    return F.when(F.size(x) > 0, s)


def repeat_share(x: Column) -> Column:
    """Share of samples equal to the one before, among the n - 1 that have one."""
    n = F.size(x)
    same = F.zip_with(F.slice(x, 2, n - 1), F.slice(x, 1, n - 1), lambda a, b: a == b)
    return F.when(n > 1, F.size(F.filter(same, lambda e: e)) / (n - 1)).otherwise(F.lit(0.0))


def rail_fraction(x: Column, pmin: Column, pmax: Column) -> Column:
    """Share of samples within 1 % of the physical limits; 0 if the limits are no range."""
    tol = 0.01 * (pmax - pmin)
    near = F.filter(x, lambda v: (v >= pmax - tol) | (v <= pmin + tol))
    return F.when((pmax > pmin) & (F.size(x) > 0), F.size(near) / F.size(x)).otherwise(F.lit(0.0))


def quantisation_step(x: Column) -> Column:
    """Smallest positive gap between distinct values; null with fewer than two."""
    u = F.array_sort(F.array_distinct(x))
    n = F.size(u)
    return F.when(n > 1, F.array_min(F.zip_with(F.slice(u, 2, n - 1), F.slice(u, 1, n - 1), lambda a, b: a - b)))


def quantisation_levels(x: Column) -> Column:
    return (F.array_max(x) - F.array_min(x)) / quantisation_step(x)


def effective_rate(x: Column, fs: Column, limit: float = 0.2) -> Column:
    r = repeat_share(x)
    return F.when(r > limit, fs * (1 - r)).otherwise(fs)


def class_counts(windows: DataFrame, by: list[str], stride_s: float = 0.5) -> DataFrame:
    """Windows per class, minutes, distinct segments."""
    return windows.groupBy(*by, "label").agg(F.count("*").alias("windows"), (F.count("*") * stride_s / 60).alias("minutes"), F.count_distinct("segment_id").alias("segments"))


def binary_scores(pred: DataFrame, by: list[str]) -> DataFrame:
    """`pred(by, label, predicted)` -> accuracy, recall_1, recall_0, balanced (%); a recall without rows is null."""
    hit = F.col("label") == F.col("predicted")
    rate = lambda v: 100.0 * F.avg(F.when(F.col("label") == v, hit.cast("double")))
    out = pred.groupBy(*by).agg((100.0 * F.avg(hit.cast("double"))).alias("accuracy"), rate(1).alias("recall_1"), rate(0).alias("recall_0"), F.count("*").alias("n"))
    return out.withColumn("balanced", (F.col("recall_1") + F.col("recall_0")) / 2)


def event_detection(pred: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Seizure segments of which at least `threshold` of the windows are predicted 1: detected, total."""
    seg = pred.where("label = 1").groupBy(*by, "segment_id").agg(F.avg(F.col("predicted").cast("double")).alias("share"))
    return seg.groupBy(*by).agg(F.count_if(F.col("share") >= threshold).alias("detected"), F.count("*").alias("total"))


def stage_summary(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population std over the seeds."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))


def file_usability_rollup(files: DataFrame) -> DataFrame:
    """Per subject and in total: files, usable files, subjects with one (total row), any_usable."""
    return files.rollup("subject").agg(F.count("*").alias("files"), F.count_if("usable").alias("usable_files"), F.bool_or("usable").alias("any_usable"), F.count_distinct(F.when(F.col("usable"), F.col("subject"))).alias("usable_subjects"))


def cardiac_tally(verdicts: DataFrame) -> DataFrame:
    """`verdicts(subject, verdict)` -> per subject and in total: ok, ok_or_usable, n, and subjects with at least one of each."""
    ok, some = F.col("verdict") == "ok", F.col("verdict").isin("ok", "usable")
    return verdicts.rollup("subject").agg(
        F.count_if(ok).alias("ok"), F.count_if(some).alias("ok_or_usable"), F.count("*").alias("n"),
        F.count_distinct(F.when(ok, F.col("subject"))).alias("subjects_ok"), F.count_distinct(F.when(some, F.col("subject"))).alias("subjects_some"),
    )


def rising_edges(mask: Column) -> Column:
    """Indexes (from 0) at which the mask is true and was not one sample before; the first sample counts, null is false."""
    before = lambda i: F.coalesce(F.get(mask, i - 1), F.lit(False))
    at = F.transform(mask, lambda m, i: F.when(m & ((i == 0) | ~before(i)), i))
    return F.filter(at, lambda i: i.isNotNull())
