"""Small-network scoring and the patient x stage x seed sweep.

Training sets are drawn by Spark as (patient, stage, seed, window id) rows before
any feature is joined. Each fit is one group, whose size the class balance caps;
scoring joins the weights back to the later rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.operators.sampling import apply_stats, balance_classes, feature_stats, sample_with_replacement, take_exact, time_split

HIDDEN = (64, 32)
WEIGHTS = "patient string, stage string, seed int, weights array<double>, mean array<double>, spread array<double>"


def layer_sizes(n_in: int, hidden: tuple[int, ...] = HIDDEN) -> list[tuple[int, int]]:
    widths = [n_in, *hidden, 1]
    return list(zip(widths[:-1], widths[1:], strict=True))


def unpack(flat: np.ndarray, n_in: int, hidden: tuple[int, ...] = HIDDEN) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in layer_sizes(n_in, hidden):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def forward(x: np.ndarray, layers) -> list[np.ndarray]:
    acts = [x]
    for i, (w, b) in enumerate(layers):
        z = acts[-1] @ w + b
        acts.append(np.maximum(z, 0) if i < len(layers) - 1 else 1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return acts


def fit(x: np.ndarray, y: np.ndarray, seed: int, epochs: int = 30, batch: int = 32, rate: float = 1e-3, hidden: tuple[int, ...] = HIDDEN) -> np.ndarray:
    """Weights of a ReLU network with a sigmoid output, by Adam on the log loss."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate([np.concatenate([rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b)]) for a, b in layer_sizes(x.shape[1], hidden)])
    m, v, t = np.zeros_like(flat), np.zeros_like(flat), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            layers = unpack(flat, x.shape[1], hidden)
            acts = forward(x[rows], layers)
            d = (acts[-1] - y[rows, None]) / len(rows)
            grads = []
            for i in range(len(layers) - 1, -1, -1):
                grads.append(np.concatenate([(acts[i].T @ d).ravel(), d.sum(0)]))
                if i:
                    d = (d @ layers[i][0].T) * (acts[i] > 0)
            g, t = np.concatenate(grads[::-1]), t + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return flat


def fit_groups(training: DataFrame, epochs: int = 30) -> DataFrame:
    """`training(patient, stage, seed, label, features)` -> one row of weights per group, with the statistics used."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        x, y = np.stack(pdf["features"].to_numpy()).astype(float), pdf["label"].to_numpy(float)
        mean, spread = x.mean(0), x.std(0) + 1e-8
        k = pdf.iloc[0]
        w = fit((x - mean) / spread, y, int(k["seed"]), epochs)
        return pd.DataFrame([(k["patient"], k["stage"], k["seed"], w, mean, spread)], columns=["patient", "stage", "seed", "weights", "mean", "spread"])

    return training.groupBy("patient", "stage", "seed").applyInPandas(one, WEIGHTS)


def mlp_score(rows: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """Rows joined to their models: adds prob and predicted (prob > 0.5). `rows` has the keys and features."""
    fields = [f for f in rows.schema.fields if f.name != "features"]
    joined = rows.join(models, keys)
    names = [f.name for f in fields]

    def run(frames):
        for pdf in frames:
            parts = []
            for _, g in pdf.groupby(keys, sort=False):
                x = np.stack(g["features"].to_numpy()).astype(float)
                first = g.iloc[0]
                p = forward((x - np.asarray(first["mean"])) / np.asarray(first["spread"]), unpack(np.asarray(first["weights"]), x.shape[1]))[-1][:, 0]
                parts.append(g[names].assign(prob=p, predicted=(p > 0.5).astype(int)))
            if parts:
                yield pd.concat(parts)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return joined.mapInPandas(run, f"{schema}, prob double, predicted int")


def training_sets(features: DataFrame, patients: list[str], seeds: list[int], frac: float = 0.33, share: float = 0.5, most: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """(training rows, LATER rows to score) for every patient, stage and seed; `features(vec_id, subject, segment_id, run, t_start_s, label, features)`.

    A cell learns from at most `most` rows of each class of the other subjects, and of the patient's own (drawn by hash, exact,
    before features are joined), so that its training set is bounded however many rows there are; all rows are scored.

    The fan-out is of ids only: one balanced draw serves all patients and seeds,
    and the raw and calibrated features are joined to the picked ids at the end.
    """
    split = time_split(features, frac).select("vec_id", "subject", "segment_id", "label", "period", "features")
    normal = split.where("label = 0")
    whole = apply_stats(split, feature_stats(normal, ["subject"]), ["subject"]).select("vec_id", F.col("features").alias("calibrated"))
    early = apply_stats(split, feature_stats(normal.where("period = 'EARLY'"), ["subject"]), ["subject"]).select("vec_id", F.col("features").alias("own"))
    table = split.select("vec_id", "features").join(whole, "vec_id").join(early, "vec_id")

    grid = F.explode(F.array(*[F.struct(F.lit(p).alias("patient"), F.lit(s).cast("int").alias("seed")) for p in patients for s in seeds])).alias("g")
    ids = split.select("vec_id", "subject", "segment_id", "label", "period", grid).select("*", "g.*").drop("g")
    key, mine = ["patient", "seed"], F.col("subject") == F.col("patient")
    others = balance_classes(ids.where(~mine), "label", ["seed", "vec_id"], by=key, most=most)
    own = ids.where(mine & (F.col("period") == "EARLY"))
    own = take_exact(own, [*key, "label"], own.select(*key, "label").distinct().withColumn("limit", F.lit(most).cast("long")), 1, ["seed", "vec_id"])
    wanted = others.groupBy(*key, "label").agg(F.floor(F.count("*") * share / (1 - share)).alias("draws"))
    drawn = sample_with_replacement(own, [*key, "label"], wanted, ["vec_id"])
    staged = lambda rows, *names: rows.select(*key, "vec_id", "segment_id", "label", F.explode(F.array(*map(F.lit, names))).alias("stage"), mine.alias("mine"))
    picked = staged(others, "generic", "calibrated", "mixed").unionByName(staged(drawn, "mixed")).unionByName(staged(own, "personal"))
    later = staged(ids.where(mine & (F.col("period") == "LATER")), "generic", "calibrated", "mixed", "personal")
    used = F.when(F.col("stage") == "generic", F.col("features").cast("array<double>")).when(F.col("mine"), F.col("own")).otherwise(F.col("calibrated"))
    fill = lambda rows: rows.join(table, "vec_id").select(*key, "stage", "vec_id", "segment_id", "label", used.alias("features"))
    return fill(picked), fill(later)


def stage_sweep(features: DataFrame, patients: list[str], seeds: list[int], epochs: int = 30, most: int = 20_000) -> DataFrame:
    """Predictions of every (patient, stage, seed) on its LATER rows; score with `binary_scores` and `event_detection`."""
    train, test = training_sets(features, patients, seeds, most=most)
    return mlp_score(test, fit_groups(train, epochs), ["patient", "stage", "seed"])

