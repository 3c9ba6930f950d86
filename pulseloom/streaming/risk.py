"""Causal risk and alerts on a stream of window scores, one state per recording.

The state is typed: a value state with the running moments, counts and the last
alert, and two list states with the rows that trailing windows reach back to. Its
size is fixed by the settings. A batch of a recording is computed at once, as
arrays behind those rows. Windows at or before the last one emitted are late:
they are dropped and counted. A recording that has been silent for `idle` in
event time is forgotten by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from pulseloom.operators.risk import MEDIANS, RiskSettings

OUTPUT = "rec long, win_idx long, time double, risk double, fp_short double, fp_long double, trend double, z double, alert boolean, late long"
INPUT = ["prob", *MEDIANS]
#: State schemas: totals, rows of the smoothing windows, risks of the windows over risk.
TOTALS = "last long, rows long, late long, last_alert long, until long, " + ", ".join(f"{c}_n double, {c}_mean double, {c}_m2 double" for c in MEDIANS)
RAW, RISKS = ", ".join(f"{c} double" for c in INPUT), "risk double"


@dataclass
class CausalRisk:
    """The risk layer of one recording, a batch of windows at a time; equals the batch layer in causal mode with scope "full"."""

    s: RiskSettings
    last: int = -1
    rows: int = 0
    late: int = 0
    last_alert: int | None = None
    moments: dict = field(default_factory=lambda: {c: (0.0, 0.0, 0.0) for c in MEDIANS})
    raw: pd.DataFrame = field(default_factory=lambda: pd.DataFrame({c: np.zeros(0) for c in INPUT}))
    risks: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def _normal(self, c: str, x: np.ndarray) -> np.ndarray:
        """Values by the moments of all values so far, this one included."""
        n0, mean0, m0 = self.moments[c]
        known = ~np.isnan(x)
        if not known.any():
            return np.full(len(x), np.nan)
        origin = mean0 if n0 else x[known][0]
        d = np.where(known, x - origin, 0.0)
        n, s1, s2 = n0 + known.cumsum(), d.cumsum() + n0 * (mean0 - origin), (d * d).cumsum() + m0 + n0 * (mean0 - origin) ** 2
        with np.errstate(invalid="ignore", divide="ignore"):
            mean, m2 = s1 / n, np.maximum(s2 - s1 * s1 / n, 0)
            out = np.where(known & (n > 1), (d - mean) / (np.sqrt(m2 / (n - 1)) + 1e-6), np.nan)
        self.moments[c] = (float(n[-1]), float(origin + mean[-1]), float(m2[-1]))
        return out

    def push(self, batch: pd.DataFrame) -> pd.DataFrame:
        """`batch(win_idx, time, prob, delta, ratio, centroid)` -> the columns of OUTPUT but `rec`, for windows that are not late."""
        s = self.s
        batch = batch.sort_values("win_idx", kind="stable")
        new = batch[(batch["win_idx"] > self.last) & ~batch["win_idx"].duplicated()]
        self.late += len(batch) - len(new)
        n = len(new)
        if not n:
            return pd.DataFrame(columns=[c.split()[0] for c in OUTPUT.split(", ")][1:])
        raw = pd.concat([self.raw, new[INPUT].astype(float)], ignore_index=True)
        tail = lambda series: series.to_numpy()[-n:]
        prob = tail(raw["prob"].rolling(s.smooth, min_periods=1).mean())
        z = {c: self._normal(c, tail(raw[c].rolling(s.median, min_periods=s.median_min).median())) for c in MEDIANS}
        up = lambda v: np.maximum(v, 0)
        risk = np.clip(0.4 * prob + 0.3 * up(z["ratio"]) + 0.2 * up(-z["delta"]) + 0.1 * up(z["centroid"]), 0, 1)
        every = pd.Series(np.concatenate([self.risks, risk]))
        at = self.rows + np.arange(n)

        def power(win: int) -> np.ndarray:
            left = tail(every.shift(win))
            out = tail(every.fillna(0).rolling(win, min_periods=1).sum()) / np.minimum(at + 1, win)
            return np.where(np.isnan(risk) | ((at >= win) & np.isnan(left)), np.nan, out)

        short, long_ = power(s.fp_short), power(s.fp_long)
        trend = tail(every.diff().rolling(s.trend).mean())
        window = every.rolling(s.z)
        high = tail((every - window.mean()) / (window.std() + 1e-6))
        hit = (short > s.min_fp_short) & (long_ > s.min_fp_long) & (trend > s.min_trend) & (high > s.min_z)
        alert, last = np.zeros(n, bool), -s.cooldown if self.last_alert is None else self.last_alert
        for i in np.flatnonzero(hit):  # candidates only
            if at[i] - last > s.cooldown:
                alert[i], last = True, int(at[i])
        self.last_alert, self.last, self.rows = last, int(new["win_idx"].iloc[-1]), self.rows + n
        self.raw = raw.tail(max(s.median, s.smooth) - 1)
        self.risks = every.to_numpy()[-(max(s.fp_short, s.fp_long, s.z, s.trend + 1)) :]
        out = {"win_idx": new["win_idx"].to_numpy(), "time": new["time"].to_numpy(float), "risk": risk, "fp_short": short, "fp_long": long_, "trend": trend, "z": high, "alert": alert, "late": self.late}
        return pd.DataFrame(out)


class RiskProcessor(StatefulProcessor):
    """`CausalRisk` of a recording in Spark's state."""

    def __init__(self, s: RiskSettings, event_time: str, idle: int | None):
        self.s, self.event_time, self.idle = s, event_time, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)
        self.raw, self.risks = handle.getListState("raw", RAW), handle.getListState("risks", RISKS)

    def _read(self) -> tuple[CausalRisk, int | None]:
        layer, until = CausalRisk(self.s), None
        if self.totals.exists():
            layer.last, layer.rows, layer.late, layer.last_alert, until, *m = self.totals.get()
            layer.moments = {c: tuple(m[3 * i : 3 * i + 3]) for i, c in enumerate(MEDIANS)}
            layer.raw = pd.DataFrame(list(self.raw.get()) if self.raw.exists() else [], columns=INPUT).astype(float)
            layer.risks = np.array([r[0] for r in self.risks.get()] if self.risks.exists() else [], float)
        return layer, until

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        layer, until = self._read()
        batch = pd.concat(list(rows))  # a trigger's windows of one recording
        out = layer.push(batch)
        if self.idle is not None:
            seen = int(batch[self.event_time].max().timestamp() * 1000) + self.idle
            if until is None or seen > until:
                if until is not None:
                    self.handle.deleteTimer(until)
                self.handle.registerTimer(seen)
                until = seen
        null = lambda v: None if v != v else float(v)
        self.totals.update((layer.last, layer.rows, layer.late, layer.last_alert, until, *(v for c in MEDIANS for v in layer.moments[c])))
        self.raw.put([tuple(map(null, r)) for r in layer.raw.to_numpy()])
        self.risks.put([(null(v),) for v in layer.risks])
        if len(out):
            out.insert(0, "rec", key[0])
            yield out.astype(object).where(out.notna(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.totals, self.raw, self.risks):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_risk(scores: DataFrame, s: RiskSettings = RiskSettings(), event_time: str = "ts", delay: str = "10 minutes", idle: int | None = None) -> DataFrame:
    """Streaming `scores(rec, win_idx, time, prob, delta, ratio, centroid, ts)` -> risk and alert per window, as they arrive.

    Rows of a trigger are ordered by win_idx; the state of a recording goes when
    the watermark passes its last event time by `idle` milliseconds, after which
    it begins anew. Needs the RocksDB state store, which is set for the session.
    """
    scores.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = scores.withWatermark(event_time, delay).select("rec", "win_idx", "time", *INPUT, event_time)
    return source.groupBy("rec").transformWithStateInPandas(RiskProcessor(s, event_time, idle), StructType.fromDDL(OUTPUT), "append", "none" if idle is None else "eventTime")


def stream_windows(samples: DataFrame, window: str = "2 seconds", slide: str = "500 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """Long-form samples (rec, ts, value) -> overlapping event-time windows with count, mean and range; batch or stream."""
    w = F.window("ts", window, slide)
    return samples.withWatermark("ts", delay).groupBy("rec", w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("p2p")).select("rec", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "p2p")
