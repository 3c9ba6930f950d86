"""Quality by the perplexity of an interpolated modified Kneser-Ney n-gram model of trusted text.

The n-grams are ORDER characters (lower case, white-space runs are one space; a
text begins and ends with END), each a 16-bit symbol: characters of the basic
plane are themselves, those beyond fold into its private-use area. Texts travel
in compressed blocks (blocks.py). Each block sends its distinct n-grams, with
their number in trusted texts, and gets their probabilities back:

1. Counts of trusted n-grams, continuation counts, context totals and discounts
   are sharded tables, one for each order, written once.
2. The probability of every n-gram that occurs in any text is made from the lowest
   order up: its discounted share (joined by n-gram) plus what its context leaves
   (joined by context) times the probability of its suffix (joined by suffix).
3. Blocks join their n-grams to that table and score their texts.

A document is kept if its bits per symbol are at most the quantile that trusted
documents of its language reach. Bits are rounded to three places first, so that
the exact quantile has a bounded state.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.blocks import BLOCK_BYTES, CHUNK, END, FRAME_BYTES, block_table, distinct_counts, make_blocks, unpacked
from pulseloom.llm.common import stage, table

ORDER, SYMBOL_BITS = 4, 16
QUANTILE = 0.99
#: Trusted rows of one broadcast, 16 MB; more mean more passes, each over other blocks.
MARKS = 4_000_000
_PRIVATE, _PRIVATE_SIZE = 0xE000, 0x1900


def normal(text: bytes) -> bytes:
    return " ".join(text.decode("utf-8", "replace").lower().split()).encode("utf-8", "replace")


def stream_grams(data: bytes, most: int = CHUNK):
    """(n-grams that end at each symbol of a frame, the symbols' texts) in chunks; the highest symbol is the oldest."""
    text, end = data.decode(), END.decode()
    gap = ORDER - 1
    padded = end * gap + text[:-1].replace(end, end * ORDER) + end
    points = np.frombuffer(padded.encode("utf-32-le"), np.uint32)
    symbols = np.where(points < 1 << SYMBOL_BITS, points, _PRIVATE + points % _PRIVATE_SIZE).astype(">u2").tobytes() + bytes(8)
    windows = np.ndarray((len(points),), ">u8", symbols, strides=(2,))
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == END[0])
    for lo in range(0, len(text), most):
        at = np.arange(lo, min(len(text), lo + most))
        owner = np.searchsorted(ends, at)
        yield windows[at + gap * owner].astype(np.uint64).view(np.int64), owner


def suffix(gram, level: int):
    """The last `level` symbols of n-grams."""
    return F.col(gram).bitwiseAND(F.lit((1 << SYMBOL_BITS * level) - 1)) if level < ORDER else F.col(gram)


def trusted_marks(made: DataFrame, trusted: DataFrame) -> DataFrame:
    """(block, marks): the places of a block's texts whose id is trusted. Only ids are shuffled."""
    ids = made.select("block", F.posexplode("doc_id").alias("place", "doc_id")).where("doc_id IS NOT NULL")
    hits = ids.join(trusted, "doc_id", "left_semi")
    return stage(hits.groupBy("block").agg(F.collect_list("place").alias("marks")), "marks")


def block_grams(made: DataFrame, marks: DataFrame, most: int = MARKS) -> DataFrame:
    """(block, key, n): the distinct n-grams of each block, with their number in marked texts.

    Marks are sent to the blocks for a range of input parts at a time, of at most
    `most` marks (or one part's); every range is a pass over its own blocks only.
    """
    import pyarrow as pa

    def grams(row):
        marked = np.zeros(sum(f["texts"] for f in row["frames"]), bool)
        marked[row["marks"] or []] = True

        def found():
            first = 0
            for frame, data in unpacked(row["frames"]):
                for gram, owner in stream_grams(data):
                    chosen = marked[first + owner]
                    yield pa.array(gram[chosen]), True
                    yield pa.array(gram[~chosen]), False
                first += frame["texts"]

        return distinct_counts(found(), "key")

    part = F.shiftright("block", 32)
    per = marks.groupBy(part.alias("part")).agg(F.sum(F.size("marks")).alias("n"))
    parts = (made.agg(F.max(part)).first()[0] or 0) + 1
    step = max(1, most // max(1, per.agg(F.max("n")).first()[0] or 1))
    out = None
    for lo in range(0, parts, step):
        inside = (F.col("block") >= lo << 32) & (F.col("block") < lo + step << 32)
        with_marks = made.where(inside).select("block", "frames").join(F.broadcast(marks.where(inside)), "block", "left")
        one = block_table(with_marks, "key long, n long", grams)
        if parts > step:
            one = stage(one, "grams")
        out = one if out is None else out.unionByName(one)
    return stage(out, "grams") if parts <= step else out


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """`(key, n)` of the highest order -> for each order 1..ORDER: (key, share), (context, left).

    share: the discounted part of an n-gram's context; left: the weight that a
    context leaves to the lower order. Lower orders count the distinct symbols
    that precede an n-gram. Discounts are those of the modified method, from the
    numbers of n-grams seen once to four times, kept in [0, count]; 0.5 where
    these numbers say nothing.
    """
    out, now = [], stage(counts, "order")
    for level in range(ORDER, 0, -1):
        seen = now.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        y = seen["n1"] / (seen["n1"] + 2 * seen["n2"]) if seen["n1"] else 0.0
        d = [max(0.0, min(float(i), i - (i + 1) * y * seen[f"n{i + 1}"] / seen[f"n{i}"])) if seen["n1"] and seen[f"n{i}"] else 0.5 for i in (1, 2, 3)]
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(F.lit(d[2]))
        context = F.shiftrightunsigned("key", SYMBOL_BITS)
        whole = stage(now.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(discount).alias("held")), "contexts")
        rows = now.withColumn("context", context).join(whole, "context")
        out.append((stage(rows.select("key", ((F.col("n") - discount) / F.col("total")).alias("share")), "shares"), whole.select("context", (F.col("held") / F.col("total")).alias("left"))))
        if level > 1:
            now = stage(now.groupBy(suffix("key", level - 1).alias("key")).agg(F.count("*").alias("n")), "order")
    return out[::-1]


def gram_bits(keys: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Distinct `keys(key)` -> (key, bits): -log2 of the interpolated probability of each n-gram's last symbol."""
    wanted = [keys]
    for level in range(ORDER - 1, 0, -1):
        wanted.append(stage(wanted[-1].select(suffix("key", level).alias("key")).distinct(), "wanted"))
    below = None
    for level, (ask, (share, left)) in enumerate(zip(wanted[::-1], model, strict=True), 1):
        found = ask.join(share, "key", "left").withColumn("context", F.shiftrightunsigned("key", SYMBOL_BITS)).join(left, "context", "left")
        if below is None:
            lower = F.lit(1.0 / (1 << SYMBOL_BITS))
        else:
            found = found.withColumn("low", suffix("key", level - 1)).join(below.select(F.col("key").alias("low"), F.col("p").alias("lower")), "low")
            lower = F.col("lower")
        p = F.coalesce("share", F.lit(0.0)) + F.coalesce("left", F.lit(1.0)) * lower
        below = stage(found.select("key", p.alias("p")), "probabilities")
    return below.select("key", (-F.log2("p")).alias("bits"))


def perplexities(docs: DataFrame, trusted: DataFrame, block_bytes: int = BLOCK_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """doc_id, lang, n_symbols (characters and the end; 0 for texts without any) and bits (per symbol, or null). `trusted(doc_id)`: distinct ids to learn from."""
    made = make_blocks(docs, {"doc_id": F.col("doc_id"), "lang": F.col("lang").cast("string")}, F.lit(False), normal, block_bytes, frame_bytes)
    keys = block_grams(made, trusted_marks(made, trusted))
    counts = stage(keys.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    bits = gram_bits(counts.select("key"), kneser_ney(counts.where("n > 0")))
    back = keys.select("block", "key").join(bits, "key").select("block", "key", "bits")

    def score(block, known):
        import pandas as pd
        import pyarrow as pa

        place, value = pd.Index(known["key"].to_numpy()), known["bits"].to_numpy()
        ids, langs, sizes, sums = [], [], [], []
        for row in block.to_pylist():
            for frame, data in unpacked(row["frames"]):
                n, total = np.zeros(frame["texts"], np.int64), np.zeros(frame["texts"])
                for gram, owner in stream_grams(data):
                    n += np.bincount(owner, minlength=len(n))
                    total += np.bincount(owner, value[place.get_indexer(gram)], len(total))
                sizes.append(np.where(n > 1, n, 0))
                sums.append(total)
            ids += row["doc_id"]
            langs += row["lang"]
        n = np.concatenate(sizes)
        mean = np.round(np.concatenate(sums) / np.maximum(n, 1), 3)
        return pa.table([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(n), pa.array(mean, mask=n == 0)], names=["doc_id", "lang", "n_symbols", "bits"])

    return made.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, "doc_id long, lang string, n_symbols long, bits double")


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, lang, n_symbols, bits, perplexity, threshold, kept.

    Trusted rows are those with a label quality = 1. `threshold` is the quantile
    of the bits of the language's trusted rows (null lang is a group of its own;
    a language without trusted rows takes the quantile of all of them); a row is
    kept if its bits are at most that, so rows at the threshold are kept. Texts
    without any character but white space, and null ones, have null bits and are
    not kept. With nothing trusted, `threshold` is null and every other text is
    kept. Repeated rows count as often as they occur; null ids are never trusted;
    extra columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    trusted = stage(labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "trusted")
    scored = stage(perplexities(docs, trusted, block_bytes), "perplexities")
    good = scored.join(trusted, "doc_id", "left_semi").where("bits IS NOT NULL")
    tally = stage(good.groupBy("lang", "bits").agg(F.count("*").alias("n")), "tally")
    own = tally.groupBy(F.col("lang").alias("for_lang")).agg(F.percentile("bits", F.lit(quantile), F.col("n")).alias("own"))
    general = tally.agg(F.percentile("bits", F.lit(quantile), F.col("n")).alias("q")).first()["q"]
    out = scored.join(own, scored["lang"].eqNullSafe(own["for_lang"]), "left")
    out = out.withColumn("threshold", F.coalesce("own", F.lit(general).cast("double")))
    kept = F.col("bits").isNotNull() & F.coalesce(F.col("bits") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_symbols", "bits", F.round(F.pow(F.lit(2.0), "bits"), 3).alias("perplexity"), "threshold", kept.alias("kept"))


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
