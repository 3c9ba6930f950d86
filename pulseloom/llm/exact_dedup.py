"""Exact duplicates through an extendible-hash index on shared files (DataFrame functions only).

1. Prints: every text is normalised (white-space runs become one space) and gets
   a 64-bit key and its SHA-256; (id, key, SHA-256) is all that is written.
2. Directory: it begins with few buckets and doubles by leading bits of the key.
   Each round splits the buckets that hold more than `capacity` distinct keys,
   until none does; a bucket that is left whole is final.
3. Insertion: a print goes to the bucket that owns its key, and only there meets
   prints that are equal: entries are made in buckets, pre-aggregated before the
   shuffle, so a text that a third of all rows share leaves each task once.
4. Index: owner tasks get ranges of keys within buckets, chain the entries that
   share a key, and write them to the shared folder by bucket.
5. Bytes: entries of more than one row are compared byte by byte, by grouping on
   the text itself. Only texts whose key shares its leading bits with such an
   entry travel for that. Where equal prints hide different texts, the chain
   gets an entry for each, with its text.
6. Lookup: a row finds in its bucket its place in the chain of its key, by
   SHA-256, and by the text where the chain has texts. Which texts are equal,
   which row stays and how many there are is what that entry says.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm.common import SPACE, stage, table

CAPACITY = 10_000
#: Leading bits by which texts are picked for comparison: at most 2**18 of them are sent to the tasks.
PICK_BITS = 18
_BUCKET = "struct<depth: int, prefix: bigint>"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm")).select(
        "doc_id", "norm", F.xxhash64("norm").alias("key"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha")
    )


def leading(depth: int):
    """The `depth` leading bits of `key`."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`keys(key)` -> `(depth, prefix)`: the buckets, each the keys that begin with the `depth` bits of `prefix`.

    No bucket holds more than `capacity` distinct keys, unless it is one key.
    The first round is the one before buckets may fit on average, and every round
    looks at the keys of overfull buckets only.
    """
    buckets, over = None, stage(keys.distinct(), "keys")
    depth = max(0, int(math.log2(max(1.0, over.count() / capacity))) - 1)  # below, buckets hold twice the capacity on average
    while True:
        loads = stage(over.groupBy(leading(depth).alias("prefix")).agg(F.count("*").alias("load")), "loads")
        full = (F.col("load") > capacity) if depth < 64 else F.lit(False)
        done = loads.where(~full).select(F.lit(depth).alias("depth"), "prefix")
        buckets = done if buckets is None else buckets.unionByName(done)
        split = loads.where(full).select("prefix")
        if split.isEmpty():
            return stage(buckets, "directory")
        over = over.join(split, leading(depth) == split["prefix"], "left_semi")
        depth += 1


def placed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """`rows` with the bucket (depth, prefix) that owns their key. A row asks once for each depth the directory has, at most 65."""
    depths = sorted(r["depth"] for r in buckets.select("depth").distinct().collect())
    ways = [F.struct(F.lit(d).alias("depth"), leading(d).alias("prefix")) for d in depths]
    tried = rows.withColumn("b", F.explode(F.array(*ways) if ways else F.expr(f"CAST(array() AS array<{_BUCKET}>)")))
    return tried.select(*rows.columns, "b.depth", "b.prefix").join(buckets, ["depth", "prefix"])


def compared(prints: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, sha, norm, keep_id, group_size) of entries whose texts differ in spite of equal prints."""
    shared = entries.where("group_size > 1")
    picks = shared.select(leading(PICK_BITS).alias("pick")).distinct()
    # At most 2**PICK_BITS rows. A text that is picked without need is a group of its own and drops out.
    near = prints.withColumn("pick", leading(PICK_BITS)).join(F.broadcast(picks), "pick", "left_semi")
    texts = near.groupBy("key", "sha", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    slim = stage(texts.groupBy("key", "sha").agg(F.count("*").alias("texts")).where("texts > 1").select("key", "sha"), "unlike")
    if slim.isEmpty():
        return slim.select("key", "sha", F.lit(None).cast("string").alias("norm"), F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"))
    return texts.join(slim, ["key", "sha"], "left_semi")


def build_index(prints: DataFrame, slim: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The index (depth, prefix, key, chain, sha, norm, keep_id, group_size; norm is null unless prints are ambiguous), and the prints by bucket."""
    buckets = directory(slim.select("key"), capacity)
    inserted = stage(placed(slim, buckets), "inserted")
    bucket = ["depth", "prefix", "key", "sha"]
    entries = stage(inserted.groupBy(*bucket).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "entries")
    unlike = compared(prints, entries)
    plain = entries.join(unlike.select("key", "sha").distinct(), ["key", "sha"], "left_anti").withColumn("norm", F.lit(None).cast("string"))
    owned = plain.unionByName(placed(unlike, buckets))
    chained = owned.withColumn("chain", F.row_number().over(Window.partitionBy("depth", "prefix", "key").orderBy("sha", "norm")))
    return stage(chained.repartitionByRange("key").sortWithinPartitions("key", "chain"), "index"), inserted


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the smallest id stays; ids that
    are null lose to any other, and if all are null none is kept by id and
    `kept` is null. Rows that repeat an id with one text are all kept with it.
    Other columns of `docs`, whatever their names, are ignored. An empty table
    gives an empty result.
    """
    prints = fingerprints(docs, id_col, text_col)
    slim = stage(prints.select("doc_id", "key", "sha"), "prints")
    index, inserted = build_index(prints, slim, capacity)
    place = ["depth", "prefix", "key", "sha"]
    found = inserted.join(index.where("norm IS NULL").select(*place, "keep_id", "group_size"), place)
    odd = index.where("norm IS NOT NULL")
    if not odd.isEmpty():
        rows = prints.join(odd.select("key", "sha").distinct(), ["key", "sha"], "left_semi")
        found = found.select("doc_id", "sha", "keep_id", "group_size").unionByName(rows.join(odd.select("key", "sha", "norm", "keep_id", "group_size"), ["key", "sha", "norm"]).select("doc_id", "sha", "keep_id", "group_size"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
