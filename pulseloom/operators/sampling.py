"""Seeded exact sampling and leakage-free splits.

Random choices are orders by a hash of (seed, stable id): the same picks under
any partitioning. Exact counts over large classes never rank a whole class in
one task: hashes fall into ranges, ranges are counted and cumulated on the small
table, whole ranges are kept, and only rows of the range where the count is
reached are ranked.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

RANGES = 4096


def seeded(seed: int, *ids: str) -> Column:
    return F.xxhash64(F.lit(seed), *ids)


def hash_order(seed: int, *ids: str) -> Column:
    """The order in which `take_exact` takes rows: that of `seeded` read as unsigned."""
    return seeded(seed, *ids).bitwiseXOR(F.lit(-(1 << 63)))


def take_exact(df: DataFrame, group: list[str], limits: DataFrame, seed: int, ids: list[str], ranges: int = RANGES) -> DataFrame:
    """The first `limit` rows of each group in hash order; `limits(group, limit)`."""
    bits = (ranges - 1).bit_length()
    tagged = df.withColumn("h_", seeded(seed, *ids)).withColumn("r_", F.shiftrightunsigned("h_", 64 - bits))
    counts = tagged.groupBy(*group, "r_").agg(F.count("*").alias("n_"))
    upto = F.sum("n_").over(Window.partitionBy(*group).orderBy("r_"))
    over = F.col("upto_") > F.col("limit")
    cut = counts.withColumn("upto_", upto).join(limits.where("limit > 0"), group).groupBy(*group).agg(
        F.min(F.when(over, F.col("r_"))).alias("edge_"), (F.max("limit") - F.coalesce(F.max(F.when(~over, F.col("upto_"))), F.lit(0))).alias("room_"),
    )
    # One row a group. Left to itself, Spark may send the rows instead, as their files are small for what they hold.
    near = tagged.join(F.broadcast(cut), group)
    rank = F.row_number().over(Window.partitionBy(*group, "r_").orderBy("h_", *ids))
    edge = near.where("r_ = edge_").withColumn("k_", rank).where("k_ <= room_").drop("k_")
    return near.where("edge_ IS NULL OR r_ < edge_").unionByName(edge).select(df.columns)


def downsample_majority(df: DataFrame, label: str, ids: list[str], ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """All rows of label 1 and exactly min(n0, floor(n1 * ratio)) of label 0, without replacement."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    one = n.agg(F.coalesce(F.max(F.when(F.col(label) == 1, F.col("n"))), F.lit(0)).alias("n1"))
    limits = n.crossJoin(one).select(label, F.when(F.col(label) == 1, F.col("n")).otherwise(F.least("n", F.floor(F.col("n1") * ratio))).alias("limit"))  # one row
    return take_exact(df, [label], limits, seed, ids)


def balance_classes(df: DataFrame, label: str, ids: list[str], seed: int = 0, by: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Both classes cut to the size of the smaller one (within each `by` group), or to `most` if that is less."""
    by = by or []
    bound = (lambda n: F.least(n, F.lit(most).cast("long"))) if most is not None else (lambda n: n)
    n = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    if by:
        m = n.groupBy(*by).agg(bound(F.min("n")).alias("limit"), F.count("*").alias("c")).where("c > 1")
        limits = n.join(m, by).select(*by, label, "limit")
    else:
        limits = n.crossJoin(n.agg(bound(F.min("n")).alias("limit"), F.count("*").alias("c")).where("c > 1")).select(label, "limit")  # one row
    return take_exact(df, [*by, label], limits, seed, ids)


def holdout_fraction(df: DataFrame, ids: list[str], seed: int = 0, parts: int = 5) -> DataFrame:
    """Adds `fold`: `validation` for exactly floor(n / parts) rows in hash order, else `fit`."""
    all_ = df.withColumn("g_", F.lit(0))
    limits = all_.groupBy("g_").agg(F.floor(F.count("*") / parts).alias("limit"))
    val = take_exact(all_, ["g_"], limits, seed, ids).select(*ids).withColumn("v_", F.lit(True))
    return df.join(val, ids, "left").withColumn("fold", F.when(F.col("v_"), "validation").otherwise("fit")).drop("v_")


#: Rows that a hash range holds on average, and draws that one array holds at most.
RANGE_ROWS, RUN = 50_000, 4_096


def split_draws(ranges: DataFrame, group: list[str], seed: int) -> DataFrame:
    """`ranges(group, r_, c_, draws)` -> with `d_`, the draws of a group dealt to its ranges in proportion to their rows `c_`.

    One multinomial draw for each group, seeded by the group, exact for any number of draws. What a task gets is a group's
    ranges, not its rows.
    """
    schema = StructType([*ranges.schema.fields, StructField("d_", LongType())])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r_")
        mark = "|".join(str(pdf.iloc[0][g]) for g in group)
        rng = np.random.default_rng([seed & 0xFFFFFFFF, zlib.crc32(mark.encode())])
        c = pdf["c_"].to_numpy(float)
        return pdf.assign(d_=rng.multinomial(int(pdf.iloc[0]["draws"]), c / c.sum()))

    return ranges.groupBy(*group).applyInPandas(deal, schema)


def sample_with_replacement(df: DataFrame, group: list[str], wanted: DataFrame, ids: list[str], seed: int = 0) -> DataFrame:
    """`wanted(group, draws)` -> exactly `draws` rows per group drawn with replacement, with `draw` 1..draws.

    Rows fall into ranges by hash; the draws are dealt to the ranges by a multinomial draw, and made range by range: each
    picks one of the range's rows by its rank there. Draws are made in runs of RUN, so no array grows with their number, and
    no task ranks more than a range. A row that is drawn often is met by as many runs, not by one task.
    """
    most = df.groupBy(*group).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    count = 1 << max(0, int(most // RANGE_ROWS).bit_length())
    tagged = df.withColumn("r_", F.pmod(seeded(seed + 1, *ids), F.lit(count)))
    sizes = tagged.groupBy(*group, "r_").agg(F.count("*").alias("c_")).join(wanted.where("draws > 0").select(*group, F.col("draws").cast("long").alias("draws")), group)
    dealt = split_draws(sizes, group, seed)
    before = F.coalesce(F.sum("d_").over(Window.partitionBy(*group).orderBy("r_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = dealt.withColumn("before_", before).where("d_ > 0").withColumn("run_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("d_") - 1) / RUN))))
    picks = runs.withColumn("j_", F.explode(F.sequence(F.col("run_") * RUN, F.least((F.col("run_") + 1) * RUN, "d_") - 1)))
    picks = picks.select(*group, "r_", F.pmod(F.xxhash64(F.lit(seed), *group, "r_", "j_"), F.col("c_")).alias("k_"), (F.col("before_") + F.col("j_") + 1).alias("draw"))
    ranked = tagged.withColumn("k_", (F.row_number().over(Window.partitionBy(*group, "r_").orderBy(*ids)) - 1).cast("long"))
    return picks.join(ranked, [*group, "r_", "k_"]).drop("r_", "k_")


def subject_holdout(features: DataFrame, subject: str) -> tuple[DataFrame, DataFrame]:
    """(training rows of the others, test rows of the subject)."""
    return features.where(F.col("subject") != subject), features.where(F.col("subject") == subject)


def other_subjects(features: DataFrame, subject: str) -> DataFrame:
    return features.where(F.col("subject") != subject).select("subject").distinct().orderBy("subject")


def time_split(windows: DataFrame, frac: float = 0.33) -> DataFrame:
    """Adds `period` EARLY / LATER per subject, cut at the start of seizure number early_n = max(1, round-half-even(n * frac)).

    `windows(subject, segment_id, run, t_start_s, label)`. A window is EARLY if
    its (run, t_start_s) is before the cut, lexicographically. Subjects with too
    few seizures for a LATER one have no cut and are dropped.
    """
    seizures = windows.where("label = 1").select("subject", "segment_id", "run", "t_start_s").distinct()
    n = F.count("*").over(Window.partitionBy("subject"))
    rank = F.row_number().over(Window.partitionBy("subject").orderBy("run", "t_start_s", "segment_id")) - 1
    early_n = F.greatest(F.lit(1), F.bround(F.col("n") * frac, 0).cast("int"))
    cut = seizures.withColumn("n", n).withColumn("i", rank).where((F.col("i") == early_n) & (early_n < F.col("n")))
    cut = cut.select("subject", F.struct("run", "t_start_s").alias("cut"))
    df = windows.join(cut, "subject")
    return df.withColumn("period", F.when(F.struct("run", "t_start_s") < F.col("cut"), "EARLY").otherwise("LATER")).drop("cut")


def split_guard(split: DataFrame) -> DataFrame:
    """Per subject the window counts by (period, label), and `ok`: EARLY normal, LATER normal and LATER seizure exist."""
    n = lambda p, v: F.count_if((F.col("period") == p) & (F.col("label") == v))
    out = split.groupBy("subject").agg(n("EARLY", 0).alias("early_normal"), n("EARLY", 1).alias("early_seizure"), n("LATER", 0).alias("later_normal"), n("LATER", 1).alias("later_seizure"))
    return out.withColumn("ok", (F.col("early_normal") > 0) & (F.col("later_normal") > 0) & (F.col("later_seizure") > 0))


def feature_stats(rows: DataFrame, by: list[str], features: str = "features") -> DataFrame:
    """Mean and population std + 1e-8 of every element of the array column, per group: by, mean, spread (arrays).

    A partial aggregation over fixed-size vectors; nothing is exploded.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    got = rows.groupBy(*by).agg(Summarizer.metrics("mean", "std", "count").summary(array_to_vector(F.transform(features, lambda x: x.cast("double")))).alias("s"))
    n = F.col("s.count")
    spread = F.transform(vector_to_array("s.std"), lambda x: x * F.sqrt((n - 1) / n) + 1e-8)
    return got.select(*by, vector_to_array("s.mean").alias("mean"), spread.alias("spread"))


def apply_stats(rows: DataFrame, stats: DataFrame, by: list[str], features: str = "features") -> DataFrame:
    """Features standardised with the group's stats."""
    joined = rows.join(stats, by) if by else rows.crossJoin(F.broadcast(stats))  # one row of global statistics
    z = F.transform(F.arrays_zip(features, "mean", "spread"), lambda x: (x[features] - x["mean"]) / x["spread"])
    return joined.withColumn(features, z).drop("mean", "spread")


def calibrate(split: DataFrame, patient: str | None = None) -> DataFrame:
    """Each subject's features by the statistics of its own label-0 rows (only EARLY ones for `patient`)."""
    base = split.where("label = 0")
    if patient is not None:
        base = base.where((F.col("subject") != patient) | (F.col("period") == "EARLY"))
    return apply_stats(split, feature_stats(base, ["subject"]), ["subject"])


def standardize(rows: DataFrame, fitted_on: DataFrame) -> DataFrame:
    """Features by the statistics of all rows of the training set `fitted_on`, whatever their subject or label."""
    return apply_stats(rows, feature_stats(fitted_on, []), [])


def mix_personal(others: DataFrame, own: DataFrame, ids: list[str], share: float = 0.5, seed: int = 0) -> DataFrame:
    """`others` plus, per label, floor(n_others * share / (1 - share)) draws with replacement from `own`."""
    wanted = others.groupBy("label").agg(F.floor(F.count("*") * share / (1 - share)).alias("draws"))
    return others.unionByName(sample_with_replacement(own, ["label"], wanted, ids, seed).select(others.columns))


def segment_windows_time(features: DataFrame, index: DataFrame) -> DataFrame:
    """Attach (run, t_start_s) to every window by its segment."""
    return features.join(index.select("segment_id", F.col("run").cast("int").alias("run"), "t_start_s"), "segment_id")
