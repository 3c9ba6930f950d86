"""Prediction by partial matching: code length of whole texts under a byte-context trie learnt from the corpus.

A text is its words, A-Z in lower case, joined by single spaces and closed by an
end byte. The trie is a set of Spark tables, one per context length 0..order:
counts of (context, next byte). Escapes are estimated by method D (a context
seen n times with d distinct followers: escape d / 2n, a follower seen c times
(2c - 1) / 2n), and symbols of longer
contexts are excluded from shorter ones. As every follower of a context also
follows its suffixes, what is excluded from a context's suffix is one sum per
context, found by a join; so the probability of each (context, byte) that occurs
anywhere is worked out once, by joins between the levels.

Documents travel in compressed blocks (blocks.py). A block sends its distinct
(context, byte) keys and words, not its positions, to the corpus tables, and gets
their probabilities and counts back; then it scores its texts, chunk by chunk.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm.blocks import BLOCK_BYTES, CHUNK, END, FRAME_BYTES, block_table, distinct_counts, make_blocks, unpacked, words_of
from pulseloom.llm.common import crc_bucket, drop_stage, stage, table

ORDER = 5
_U = np.uint64


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def stream_keys(data: bytes, order: int, most: int = CHUNK):
    """Keys (context bytes and next byte) at every byte of a frame, in chunks; contexts start anew after each END."""
    padded = END * order + data + bytes(8)
    if data.count(END) > 1:
        padded = END * order + data[:-1].replace(END, END * (order + 1)) + END + bytes(8)
    windows = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    for lo in range(0, len(data), most):
        at = np.arange(lo, min(len(data), lo + most))
        at += order * np.searchsorted(ends, at)
        yield (windows[at].astype(_U) >> _U(64 - 8 * (order + 1))).astype(np.int64)


def block_keys(made: DataFrame, order: int) -> DataFrame:
    """(block, key, n): distinct keys of each block with their count in training texts, 0 included."""
    import pyarrow as pa

    def keys(row):
        return distinct_counts(((pa.array(k), f["train"]) for f, data in unpacked(row["frames"]) for k in stream_keys(data, order)), "key")

    return block_table(made.select("block", "frames"), "key long, n long", keys)


def block_words(made: DataFrame) -> DataFrame:
    """(block, word, n): distinct words of each block, the end among them, with their count in training texts."""

    def words(row):
        return distinct_counts(((words_of(data)[0], f["train"]) for f, data in unpacked(row["frames"])), "word", 500_000)

    return block_table(made.select("block", "frames"), "word binary, n long", words)


def key_scores(counts: DataFrame, order: int) -> DataFrame:
    """`counts(key, n)`, n may be 0 -> `(key, lp)`: log10 of the blended probability of each key's byte in its context."""
    level = [None] * (order + 1)
    level[order] = counts
    mask = lambda j: F.lit((1 << 8 * (j + 1)) - 1)
    for j in range(order - 1, -1, -1):
        above = level[j + 1].select(F.col("key").bitwiseAND(mask(j)).alias("key"), "n")
        level[j] = stage(above.groupBy("key").agg(F.sum("n").alias("n")), f"level{j}")
    contexts = [None] * (order + 1)
    for j in range(order + 1):
        seen = level[j].where("n > 0").withColumn("context", F.shiftrightunsigned("key", 8))
        if j:
            lower = level[j - 1].select(F.col("key").alias("low"), F.col("n").alias("below"))
            seen = seen.withColumn("low", F.col("key").bitwiseAND(mask(j - 1))).join(lower, "low")
        else:
            seen = seen.withColumn("below", F.lit(0).cast("long"))
        contexts[j] = seen.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("below").alias("gone"))
    zero = F.lit(0).cast("long")
    walk = level[order].select("key", F.col("key").alias("low"), F.col("n").alias("c"), F.lit(0.0).alias("acc"), zero.alias("gone_above"), zero.alias("kinds_above"))
    done = []
    for j in range(order, -1, -1):
        walk = walk.withColumn("context", F.shiftrightunsigned("low", 8)).join(contexts[j], "context", "left")
        t = F.coalesce("total", zero) - F.col("gone_above")
        d = F.coalesce("kinds", zero) - F.col("kinds_above")
        lp = F.when(F.col("c") > 0, F.col("acc") + F.log10((2 * F.col("c") - 1) / (2 * t)))
        acc = F.col("acc") + F.when(F.col("total").isNotNull() & (d > 0), F.log10(d / (2 * t))).otherwise(F.lit(0.0))
        walk = stage(walk.select("key", "low", lp.alias("lp"), acc.alias("acc"), F.coalesce("gone", zero).alias("gone_above"), F.coalesce("kinds", zero).alias("kinds_above")), f"walk{j}")
        done.append(walk.where("lp IS NOT NULL").select("key", "lp"))
        walk = walk.where("lp IS NULL").drop("lp")
        if j:
            lower = level[j - 1].select(F.col("key").alias("low"), F.col("n").alias("c"))
            walk = walk.withColumn("low", F.col("low").bitwiseAND(mask(j - 1))).join(lower, "low")
    done.append(walk.select("key", (F.col("acc") - F.log10(F.lit(256) - F.col("kinds_above"))).alias("lp")))
    for used in level[:order]:
        drop_stage(used)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def ppm_scores(docs: DataFrame, train: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_bits.

    `train` says which rows are learnt from (null: not). `score` is the log10
    probability of the text's words and end under the trie, `code_bits` the same
    as a code length in bits; `base_score` is the smoothed unigram score. Null
    and empty texts are the end alone. Null ids stay null; repeated rows are
    learnt from and scored as often as they occur; an empty table gives an empty
    result; other columns are ignored. A frequent key or word has one row per
    block at most, which bounds what the tasks that count it read.
    """
    made = make_blocks(docs, {"doc_id": F.col("doc_id").cast("long")}, train, normal, block_bytes, frame_bytes)
    keys = stage(block_keys(made, order), "keys")
    counts = stage(keys.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    scores = key_scores(counts, order)

    by_word = Window.partitionBy("word")
    words = block_words(made).select("block", "word", F.sum("n").over(by_word).alias("c"), (F.min("block").over(by_word) == F.col("block")).alias("once"), "n")
    words = stage(words, "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("once") & (F.col("c") > 0), 1)), F.lit(0)).alias("v")).first()
    trained, kinds = int(total["n"]), int(total["v"])

    back = keys.select("block", "key").join(scores, "key").select("block", "key", F.lit(None).cast("binary").alias("word"), "lp", F.lit(None).cast("long").alias("c"))
    back = back.unionByName(words.select("block", F.lit(None).cast("long").alias("key"), "word", F.lit(None).cast("double").alias("lp"), "c"))

    def score(block, known):
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "code_bits"]
        grams = known.select(["key", "lp"]).filter(pc.is_valid(known["key"])).combine_chunks()
        terms = known.select(["word", "c"]).filter(pc.is_valid(known["word"])).combine_chunks()
        del known
        place, value = pd.Index(grams["key"].to_numpy()), grams["lp"].to_numpy()
        term = {w: i for i, w in enumerate(terms["word"].to_pylist())}
        count = terms["c"].to_numpy()
        base = np.log10((count + 0.5) / (trained + 0.5 * (kinds + 1)))
        del grams, terms
        found = {n: [] for n in names}
        for row in block.to_pylist():
            for frame, data in unpacked(row["frames"]):
                words, per = words_of(data)
                d = words.dictionary_encode()
                at = np.array([term[w] for w in d.dictionary.to_pylist()])[d.indices.to_numpy()]
                first = np.cumsum(per) - per
                found["n_tokens"].append(per)
                found["n_known"].append(np.add.reduceat((count[at] > 0).astype(np.int64), first))
                found["base_score"].append(np.add.reduceat(base[at], first))
                # A text's score is the difference of a running sum kept by text, so that long texts need no array of their own.
                ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
                total, lo = np.zeros(len(ends)), 0
                for k in stream_keys(data, order):
                    got = value[place.get_indexer(k)]
                    i, j = np.searchsorted(ends, [lo, lo + len(k) - 1])
                    starts = np.maximum(np.concatenate([[0], ends[:-1] + 1])[i : j + 1] - lo, 0)
                    total[i : j + 1] += np.add.reduceat(got, starts)
                    lo += len(k)
                found["score"].append(total)
                found["held_out"].append(np.full(len(ends), not frame["train"]))
            found["doc_id"] += row["doc_id"]
        whole = {n: np.concatenate(found[n]) for n in ("held_out", "n_tokens", "n_known", "base_score", "score")}
        whole |= {"train_tokens": np.full(len(whole["score"]), trained), "code_bits": -whole["score"] * np.log2(10)}
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        del place, value, term, count, base
        pa.default_memory_pool().release_unused()
        return pa.table([pa.array(found["doc_id"] if n == "doc_id" else whole[n], t) for n, t in zip(names, types, strict=True)], names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, code_bits double"
    return made.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, schema)


def op1_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scores(table(spark, sf_dir, "documents"), crc_bucket("doc_id", 5) != 1)
