"""Filters over recordings that lie in chunks of samples, equal to those over whole signals.

`chunks(keys, chunk, x)`: chunk numbers from 0 without gaps, all but a recording's
last of one size. A chunk is convolved with what its neighbours lend it
(overlap-save); the notch takes the disturbed frequencies' parts from all chunks,
adds them up, and subtracts their waves chunk by chunk. No recording is in one
task, nor in one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from pulseloom.functions.signal import band_taps, filtered
from pulseloom.operators.scan import numbered


def recording_medians(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n (samples), median, of each recording: samples are ranked over all tasks, and those in the middle looked up."""
    sizes = chunks.groupBy(*keys).agg(F.sum(F.size("x").cast("long")).alias("n")).where("n > 0")
    ranked = numbered(chunks.select(*keys, F.explode("x").alias("v")), keys, ["v"])
    middle = sizes.select(*keys, F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("at_"))
    return ranked.join(middle, [*keys, "at_"]).groupBy(*keys).agg(F.avg("v").alias("median")).join(sizes, keys)


def _sized(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with their recording's n and median, and the number of their first sample."""
    first = F.sum(F.size("x").cast("long")).over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = chunks.select(*keys, "chunk", F.coalesce(first, F.lit(0)).alias("first"))
    return chunks.select(*keys, "chunk", F.col("x").cast("array<double>").alias("x")).join(starts, [*keys, "chunk"]).join(recording_medians(chunks, keys), keys)


def band_chunks(chunks: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """keys, chunk, y: the 5 to 15 Hz band of the recording less its median. Recordings of fewer than 402 samples only lose the median."""
    taps = band_taps(fs)
    reach = len(taps) // 2
    rows = _sized(chunks, keys)
    lend = F.explode(F.array(
        F.struct(F.col("chunk").alias("to"), F.lit(0).alias("side"), F.col("x").alias("part")),
        F.struct((F.col("chunk") + 1).alias("to"), F.lit(-1).alias("side"), F.slice("x", -F.least(F.size("x"), F.lit(reach)), reach).alias("part")),
        F.struct((F.col("chunk") - 1).alias("to"), F.lit(1).alias("side"), F.slice("x", 1, reach).alias("part")),
    ))
    met = rows.where("size(x) > 0").select(*keys, "n", "median", lend.alias("l")).select(*keys, "n", "median", F.col("l.to").alias("chunk"), F.struct("l.side", "l.part").alias("l"))
    met = met.groupBy(*keys, "chunk", "n", "median").agg(F.sort_array(F.collect_list("l")).alias("parts")).where("exists(parts, p -> p.side = 0)")  # three at most
    schema = StructType([*[f for f in chunks.schema.fields if f.name in keys], StructField("chunk", LongType()), StructField("y", ArrayType(DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for n, median, parts in zip(pdf["n"], pdf["median"], pdf["parts"], strict=True):
                sides = [p["side"] for p in parts]
                x = np.concatenate([np.asarray(p["part"], float) for p in parts]) - median
                before = len(parts[0]["part"]) if sides[0] == -1 else 0
                own = len(parts[sides.index(0)]["part"])
                y = filtered(x[None], taps)[0] if n >= 2 * len(taps) else x
                out.append(y[before : before + own].tolist())
            yield pdf[[*keys, "chunk"]].assign(y=out)

    return met.select(*keys, F.col("chunk").cast("long").alias("chunk"), "n", "median", "parts").mapInPandas(run, schema)


def mains_bins(n: int, fs: float, base: float, width: float = 1.0) -> np.ndarray:
    """Numbers of the frequencies of n samples that lie within `width` of a harmonic of the mains."""
    f = np.fft.rfftfreq(n, 1 / fs)
    harmonics = np.arange(base, fs / 2, base)
    return np.flatnonzero((np.abs(f[:, None] - harmonics) <= width).any(1)) if len(harmonics) else np.zeros(0, np.int64)


def _waves(n: int, first: int, size: int, bins: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[slice, np.ndarray]]:
    """exp(-2 pi i k t / n) for the samples from `first` on and runs of bins, a few MB at a time; phases are reduced as integers."""
    step = max(1, most // max(1, size))
    for at in range(0, len(bins), step):
        turns = (np.arange(first, first + size)[:, None] * bins[at : at + step][None]) % n
        yield slice(at, at + step), np.exp(-2j * np.pi * turns / n)


def notch_chunks(chunks: DataFrame, keys: list[str], fs: float, base: float) -> DataFrame:
    """keys, chunk, y: the recording less its median and less all frequencies within 1 Hz of a harmonic of `base`.

    The number of such frequencies grows with a recording's length, and so does the work for each of its chunks.
    """
    rows = _sized(chunks, keys).where("size(x) > 0")
    kept = [f for f in chunks.schema.fields if f.name in keys]
    parts = StructType([*kept, StructField("k", LongType()), StructField("re", DoubleType()), StructField("im", DoubleType())])

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for key, first, x, n, median in zip(pdf[keys].itertuples(index=False), pdf["first"], pdf["x"], pdf["n"], pdf["median"], strict=True):
                bins, x = mains_bins(n, fs, base), np.asarray(x, float) - median
                for some, wave in _waves(n, first, len(x), bins):
                    total = x @ wave
                    yield pd.DataFrame({"k": bins[some], "re": total.real, "im": total.imag}).assign(**dict(zip(keys, key, strict=True)))[[*keys, "k", "re", "im"]]

    sums = rows.select(*keys, "first", "x", "n", "median").mapInPandas(gather, parts).groupBy(*keys, "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    spectrum = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "re", "im"))).alias("spectrum"))  # the recording's disturbed frequencies

    def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for first, x, n, median, found in zip(pdf["first"], pdf["x"], pdf["n"], pdf["median"], pdf["spectrum"], strict=True):
                y = np.asarray(x, float) - median
                if found is not None:
                    k, part = np.array([f["k"] for f in found]), np.array([complex(f["re"], f["im"]) for f in found])
                    part *= np.where((k == 0) | (2 * k == n), 1, 2) / n
                    for some, wave in _waves(n, first, len(y), k):
                        y = y - (wave.conj() @ part[some]).real
                out.append(y.tolist())
            yield pdf[[*keys, "chunk"]].assign(y=out)

    schema = StructType([*kept, StructField("chunk", LongType()), StructField("y", ArrayType(DoubleType()))])
    return rows.join(spectrum, keys, "left").select(*keys, F.col("chunk").cast("long").alias("chunk"), "first", "x", "n", "median", "spectrum").mapInPandas(clean, schema)
