"""Risk layer over window scores: rolling statistics, normalisation, fusion, cooldown.

Recordings are cut into blocks with halos (`scan`), so that a task's work does not
grow with a recording: medians are rolled within a block, moments are scanned over
blocks, trailing sums are differences of running sums. The column functions are
the same statistics as windows over a whole recording, for short ones and as the
form that the blocks are tested against. Frames are in rows, as window scores
have a constant stride. Warm-up rows are null, never NaN.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import WindowSpec

from pulseloom.operators.scan import Running, block_moments, latest, numbered, with_halo
from pulseloom.sources.staging import staged

#: Rows of a recording that one call of the grouped helper gets, beside those its windows reach back to.
BLOCK = 4096


@dataclass(frozen=True)
class RiskSettings:
    """Window lengths (rows) and thresholds of the risk layer."""

    smooth: int = 20
    median: int = 200
    median_min: int = 50
    baseline: int = 600
    baseline_min: int = 100
    fp_short: int = 120
    fp_long: int = 600
    trend: int = 20
    trend_long: int = 100
    z: int = 200
    peak: int = 100
    min_fp_short: float = 0.12
    min_fp_long: float = 0.35
    min_trend: float = 0.001
    min_z: float = 1.2
    lookback_s: float = 600.0
    cooldown: int = 300


def _trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def rolling_mean(x: Column, w: WindowSpec, n: int, min_periods: int | None = None) -> Column:
    """Mean of the last n rows; null with fewer than `min_periods` (default n) non-null values."""
    f = _trailing(w, n)
    return F.when(F.count(x).over(f) >= (n if min_periods is None else min_periods), F.avg(x).over(f))


def rolling_median(x: Column, w: WindowSpec, n: int, min_periods: int) -> Column:
    """Exact median of the last n rows. The frame is evaluated per row: for long recordings use `rolling_medians`."""
    f = _trailing(w, n)
    return F.when(F.count(x).over(f) >= min_periods, F.percentile(x, F.lit(0.5)).over(f))


def rolling_medians(df: DataFrame, keys: list[str], order: str, specs: dict[str, tuple[str, int, int]], dense: bool = False) -> DataFrame:
    """Adds {new: (column, rows, min_periods)} rolling medians in a vectorised helper.

    A recording is cut into blocks of BLOCK rows, each with the rows before it that its first windows reach back to, so
    that a task's group does not grow with the recording. `dense`: `order` counts the rows of a recording from 0.
    """
    back = max(n for _c, n, _least in specs.values()) - 1
    size = max(BLOCK, back)
    placed = df.withColumn("at_", F.col(order)) if dense else numbered(df, keys, [order])
    schema = StructType([*df.schema.fields, *[StructField(n, DoubleType()) for n in specs]])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at_")
        for new, (col, n, least) in specs.items():
            pdf[new] = pdf[col].rolling(n, min_periods=least).median()
        return pdf[pdf["at_"] // size == pdf["block_"]].drop(columns=["at_", "block_"])

    out = with_halo(placed, size, back).groupBy(*keys, "block_").applyInPandas(one, schema)
    return out.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in specs})


def zscore_recording(x: Column, w: WindowSpec, causal: bool = False) -> Column:
    """(x - mean) / (sample std + 1e-6) over the whole recording, or over the rows so far if `causal`."""
    f = w.rowsBetween(Window.unboundedPreceding, 0 if causal else Window.unboundedFollowing)
    return (x - F.avg(x).over(f)) / (F.stddev_samp(x).over(f) + F.lit(1e-6))


def firing_power(x: Column, w: WindowSpec, n: int) -> Column:
    """Trailing mean whose window grows at the start. A null counts as 0 in the sum but 1 in the divisor; the result is
    null where x is, and where the value that has just left the window was null."""
    f = _trailing(w, n)
    leaves = (F.row_number().over(w) > n) & F.lag(x, n).over(w).isNull()
    return F.when(x.isNotNull() & ~leaves, F.sum(F.coalesce(x, F.lit(0.0))).over(f) / F.count(F.lit(1)).over(f))


def rolling_z(x: Column, w: WindowSpec, n: int) -> Column:
    f = _trailing(w, n)
    return F.when(F.count(x).over(f) >= n, (x - F.avg(x).over(f)) / (F.stddev_samp(x).over(f) + F.lit(1e-6)))


def risk_fusion(prob: Column, ratio: Column, delta: Column, centroid: Column) -> Column:
    """Weighted sum clipped to 0..1; null if any input is."""
    pos = lambda c: F.greatest(c, F.lit(0.0))
    whole = prob.isNotNull() & ratio.isNotNull() & delta.isNotNull() & centroid.isNotNull()
    mixed = 0.4 * prob + 0.3 * pos(ratio) + 0.2 * pos(-delta) + 0.1 * pos(centroid)
    return F.when(whole, F.least(F.greatest(mixed, F.lit(0.0)), F.lit(1.0)))


def alert_condition(s: RiskSettings) -> Column:
    c = F.col("fp_short") > s.min_fp_short
    c = c & (F.col("fp_long") > s.min_fp_long) & (F.col("trend") > s.min_trend) & (F.col("z") > s.min_z)
    return F.coalesce(c, F.lit(False))


MEDIANS = ("delta", "ratio", "centroid")


def whole_risk_frame(scores: DataFrame, keys: list[str], order: str = "win_idx", s: RiskSettings = RiskSettings(), mode: str = "published") -> DataFrame:
    """`risk_frame` by windows over whole recordings: for short ones, as a recording is one task and frames cost rows x frame."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = scores.withColumns({f"{c}_sm": rolling_median(F.col(c), w, s.median, s.median_min) for c in MEDIANS})
    df = df.withColumn("prob_sm", rolling_mean(F.col("prob"), w, s.smooth, 1))
    df = df.withColumns({f"{c}_n": zscore_recording(F.col(f"{c}_sm"), w, mode == "causal") for c in MEDIANS})
    df = df.withColumn("risk", risk_fusion(F.col("prob_sm"), F.col("ratio_n"), F.col("delta_n"), F.col("centroid_n")))
    r = F.col("risk")
    df = df.withColumns({"fp_short": firing_power(r, w, s.fp_short), "fp_long": firing_power(r, w, s.fp_long), "step": r - F.lag(r).over(w), "z": rolling_z(r, w, s.z), "peakness": r - rolling_mean(r, w, s.peak)})
    df = df.withColumns({"trend": rolling_mean(F.col("step"), w, s.trend), "trend_long": rolling_mean(F.col("step"), w, s.trend_long)})
    return df.drop("step").withColumn("candidate", alert_condition(s))


def _smoothed(scores: DataFrame, keys: list[str], s: RiskSettings, size: int, keep: int) -> DataFrame:
    """Blocks of rows `at_` with a halo of `keep` rows, smoothed; written to the shared folder, as moments and risk both read them."""
    back = keep + max(s.median, s.smooth) - 1
    fields = [*scores.schema.fields, *[StructField(n, DoubleType()) for n in ("prob_sm", *(f"{c}_sm" for c in MEDIANS))]]
    cut = with_halo(scores, size, back)
    schema = StructType([*fields, cut.schema["block_"]])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at_")
        pdf["prob_sm"] = pdf["prob"].rolling(s.smooth, min_periods=1).mean()
        for c in MEDIANS:
            pdf[f"{c}_sm"] = pdf[c].rolling(s.median, min_periods=s.median_min).median()
        pdf = pdf[pdf["at_"] >= pdf["block_"] * size - keep]
        return pdf[[f.name for f in schema.fields]]

    rows = cut.groupBy(*keys, "block_").applyInPandas(one, schema)
    return staged(rows.withColumns({f.name: F.nanvl(f.name, F.lit(None).cast("double")) for f in fields[-4:]}), "smoothed")


def risk_frame(scores: DataFrame, keys: list[str], order: str = "win_idx", s: RiskSettings = RiskSettings(), mode: str = "published", dense: bool = False, block: int | None = None) -> DataFrame:
    """Window scores (prob, delta, ratio, centroid) -> with smoothed, normalised and temporal columns and `candidate`.

    `mode`: "published" normalises over the whole recording; "causal" over the rows so far. `dense` says that `order` counts
    the rows of a recording from 0, which spares the sort that numbers them. A recording is many blocks of `block` rows
    (BLOCK, or what the longest window asks for), each a group of its own.
    """
    keep = max(s.fp_short, s.fp_long, s.z, s.peak, s.trend + 1, s.trend_long + 1)
    size = max(block or BLOCK, keep + max(s.median, s.smooth) - 1)
    placed = scores.withColumn("at_", F.col(order).cast("long")) if dense else numbered(scores, keys, [order])
    rows = _smoothed(placed, keys, s, size, keep)
    own = F.col("at_") >= F.col("block_") * size
    smooth = [f"{c}_sm" for c in MEDIANS]
    df = rows.join(block_moments(rows.where(own), keys, smooth), [*keys, "block_"])
    run = Running(df, keys)
    if mode == "causal":  # the rows of the halo are counted in the blocks before: their sums are taken off again
        halo = Window.partitionBy(*keys, "block_")
        for c in smooth:
            x = F.col(c) - F.col(f"{c}_mean")
            run.add(**{f"{c}_r0": F.col(c).isNotNull().cast("double"), f"{c}_r1": x, f"{c}_r2": x * x})
            ahead = {f"{c}_h{k}": F.max(F.when(~own & (F.col("at_") == F.col("block_") * size - 1), F.col(f"{c}_r{k}"))).over(halo) for k in range(3)}
            run.df = run.df.withColumns(ahead)
        sofar = lambda c, k, name: F.col(f"{c}_{name}") + F.col(f"{c}_r{k}") - F.coalesce(F.col(f"{c}_h{k}"), F.lit(0.0))

        def normal(c: str) -> Column:
            n, s1, s2 = sofar(c, 0, "n"), sofar(c, 1, "s1"), sofar(c, 2, "s2")
            sd = F.sqrt(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)) / (n - 1))
            return F.when(F.col(c).isNotNull() & (n > 1.5), (F.col(c) - F.col(f"{c}_mean") - s1 / n) / (sd + 1e-6))
    else:
        normal = lambda c: (F.col(c) - F.col(f"{c}_mean")) / (F.col(f"{c}_sd") + 1e-6)
    run.df = run.df.withColumns({f"{c}_n": normal(f"{c}_sm") for c in MEDIANS})
    run.df = run.df.withColumn("risk", risk_fusion(F.col("prob_sm"), F.col("ratio_n"), F.col("delta_n"), F.col("centroid_n")))
    r, w = F.col("risk"), run.w
    run.df = run.df.withColumn("step_", r - F.lag(r).over(w))
    q = r - 0.5
    run.add(sum_=r, known_=r.isNotNull().cast("double"), q_=q, qq_=q * q, steps_=F.col("step_"), stepped_=F.col("step_").isNotNull().cast("double"))
    full = lambda count, n, value: F.when(run.last(count, n) > n - 0.5, value)

    def power(n: int) -> Column:
        leaves = (F.col("at_") >= n) & F.lag(r, n).over(w).isNull()
        return F.when(r.isNotNull() & ~leaves, run.last("sum_", n) / F.least(F.col("at_") + 1, F.lit(n)))

    mean, square = run.last("q_", s.z) / s.z, run.last("qq_", s.z)
    sd = F.sqrt(F.greatest(square - s.z * mean * mean, F.lit(0.0)) / (s.z - 1))
    df = run.df.withColumns({
        "fp_short": power(s.fp_short), "fp_long": power(s.fp_long), "z": F.when(r.isNotNull(), full("known_", s.z, (q - mean) / (sd + 1e-6))),
        "peakness": r - full("known_", s.peak, run.last("sum_", s.peak) / s.peak),
        "trend": full("stepped_", s.trend, run.last("steps_", s.trend) / s.trend), "trend_long": full("stepped_", s.trend_long, run.last("steps_", s.trend_long) / s.trend_long),
    })
    made = [*smooth, "prob_sm", *(f"{c}_n" for c in MEDIANS), "risk", "fp_short", "fp_long", "z", "peakness", "trend", "trend_long"]
    return df.where(own).select(*scores.columns, *made).withColumn("candidate", alert_condition(s))


def relative_risk(risk: DataFrame, keys: list[str], order: str = "win_idx", s: RiskSettings = RiskSettings(), dense: bool = False) -> DataFrame:
    """Adds `baseline` (rolling median of risk) and `rel_risk` = max(risk - baseline, 0)."""
    df = rolling_medians(risk, keys, order, {"baseline": ("risk", s.baseline, s.baseline_min)}, dense)
    d = F.col("risk") - F.col("baseline")
    return df.withColumn("rel_risk", F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))))


def greedy_keep(sorted_positions: Column, gap: int, strict: bool = True, first_at: int | None = None) -> Column:
    """Fold over an ascending array: keep x if x - last kept > gap (>= if not strict); `first_at` is the imaginary last."""
    empty = F.expr("CAST(array() AS array<bigint>)")

    def step(acc: Column, x: Column) -> Column:
        far = x - acc["last"]
        ok = acc["last"].isNull() | ((far > gap) if strict else (far >= gap))
        return F.when(ok, F.struct(x.alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    start = F.struct(F.lit(first_at).cast("bigint").alias("last"), empty.alias("kept"))
    return F.aggregate(F.transform(sorted_positions, lambda v: v.cast("bigint")), start, step, lambda a: a["kept"])


def spaced(rows: DataFrame, keys: list[str], gap: int, first_at: int, at: str = "win_idx") -> DataFrame:
    """Distinct positions `rows(keys, at)` -> those a greedy pass keeps: more than `gap` after the last kept one (`first_at` to begin with).

    No recording is gathered. Every position has a next one, the first more than `gap` later, found by an as-of search. A
    position that is more than `gap` after the one before it is kept whatever happened earlier; from these the links are
    followed, twice as far in each round.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    rows = rows.where(F.col(at) > first_at + gap).select(*keys, F.col(at).cast("long").alias(at)).distinct()
    back = F.col(at) - F.lag(at).over(w)
    heads = rows.withColumn("head_", back.isNull() | (back > gap))
    linked = latest(heads, rows, keys, -(F.col(at) + gap + 1), -F.col(at), -F.col(at), "next_", bucket=float(1 << 16))
    linked = staged(linked.select(*keys, at, "head_", (-F.col("next_")).alias("next_")), "links")
    kept, jumps = linked.where("head_").select(*keys, at), linked.where("next_ IS NOT NULL").select(*keys, at, "next_")
    while True:
        reached = kept.join(jumps, [*keys, at]).select(*keys, F.col("next_").alias(at))
        more = staged(reached.join(kept, [*keys, at], "left_anti").distinct(), "reached")
        if more.isEmpty():
            return kept
        kept = staged(kept.unionByName(more), "kept")
        far = jumps.select(*keys, F.col(at).alias("next_"), F.col("next_").alias("far_"))
        jumps = staged(jumps.join(far, [*keys, "next_"]).select(*keys, at, F.col("far_").alias("next_")), "jumps")


def cooldown_alerts(risk: DataFrame, seizures: DataFrame, keys: list[str], s: RiskSettings = RiskSettings(), scope: str = "published") -> DataFrame:
    """Rows of `risk` that raise an alert: keys, win_idx, time.

    Only candidate rows are looked at, and thinned by `spaced`. "published": from
    `lookback_s` before the first seizure to the end of the recording, nothing in
    recordings without seizures. "full": everywhere.
    """
    rows = risk.where("candidate").select(*keys, "win_idx", "time")
    if scope == "published":
        first = seizures.groupBy(*keys).agg(F.min("onset_s").alias("first_onset"))
        rows = rows.join(first, keys).where(F.col("first_onset") - F.col("time") <= s.lookback_s)
    rows = staged(rows.select(*keys, "win_idx", "time"), "candidates")
    return rows.join(spaced(rows, keys, s.cooldown, -s.cooldown), [*keys, "win_idx"])


def risk_zone(x: Column) -> Column:
    return F.when(x < 0.3, "Low").when(x < 0.6, "Medium").when(x.isNotNull(), "High")


def risk_level(x: Column) -> Column:
    """Tenths 1..10."""
    return F.when(x.isNotNull(), F.least(F.greatest(F.floor(x * 10) + 1, F.lit(1)), F.lit(10)))


def minmax_or_half(x: Column, w: WindowSpec) -> Column:
    """Stretch to 0..1 over the partition, 0.5 where the range is under 1e-6. `w` has no order."""
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(x.isNull(), None).when(hi - lo < 1e-6, F.lit(0.5)).otherwise(F.least(F.greatest((x - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))


def clip_stretch(x: Column, top: float = 0.8) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(top)) / top)
