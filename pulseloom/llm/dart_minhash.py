"""Near duplicates by DartMinHash signatures, banded joins and exact verification.

A text is the multiset of its five-word shingles. Each occurrence of a shingle
is a cell of weight one. Into the strip of a cell, darts fall along the rank axis
as a Poisson process that only the cell's hash decides, so equal cells of two
texts get equal darts. A text keeps, for each of `coordinates` hashed
coordinates, its dart of least rank; a coordinate agrees with probability equal
to the weighted Jaccard similarity. Only the part of the axis with about
k log k + 2k darts is thrown, more only while coordinates are empty, which
makes the cost per text nearly independent of its length beyond one hash a cell.

Bands of coordinates are joined on their hash. Within a bucket every text is
compared with leaders, never all pairs: first with the bucket's least and largest
text (an order all buckets share, so a dense group has few leaders and one link
each joins it), then, in buckets that still hold several components, with two
members of their own order, and only across components. Where a bucket is mixed even then,
each member leads if they are few; the texts of larger ones are joined on their
rare cells, which finds all links among them without pairing texts that only
share something frequent. Similarity is verified on the exact multisets.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm.arrays import _U, cells, mix, shingle_hashes, word_digests
from pulseloom.llm.common import forget, map_texts, stage, table
from pulseloom.llm.components import components, extended

BANDS, ROWS, THRESHOLD = 32, 5, 0.8
#: In mixed buckets of up to so many texts each member leads; larger ones are joined on rare cells.
FEW = 16
_GOLD = _U(0x9E3779B97F4A7C15)


def _levels(first: float, widest: float = 32.0):
    """Cut points of the rank axis: halves up to `widest`, then equal steps."""
    lo, width = 0.0, first
    while True:
        yield lo, width
        lo += width
        width = min(widest, lo)


def _poisson_cdf(m: float) -> np.ndarray:
    n = int(m + 10 * math.sqrt(m) + 12)
    logs = np.arange(n) * math.log(m) - m - np.array([math.lgamma(i + 1) for i in range(n)])
    return np.cumsum(np.exp(logs))


def signatures(cell: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Dart ids, texts x k; a text without cells has zeros."""
    n = np.diff(bounds)
    docs = len(n)
    sig, rank = np.zeros(docs * k, _U), np.full(docs * k, np.inf)
    need = np.where(n > 0, (k * math.log(k) + 2 * k) / np.maximum(n, 1), 0.0)
    open_ = n > 0
    owner = np.repeat(np.arange(docs), n)
    for level, (lo, width) in enumerate(_levels(1 / 64)):
        if not open_.any():
            return sig.reshape(docs, k)
        if not open_.all():
            live = open_[owner]
            cell, owner = cell[live], owner[live]
        h = mix(cell ^ _U((level + 1) * int(_GOLD) % 2**64))
        count = np.searchsorted(_poisson_cdf(width), (h >> _U(11)).astype(np.float64) / 2**53)
        src = np.repeat(np.arange(len(h)), count)
        nth = np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(h[src] + (nth + 1).astype(_U) * _GOLD)
        r = lo + width * ((dart >> _U(11)).astype(np.float64) / 2**53)
        coordinate = (mix(dart) % _U(k)).astype(np.int64)
        slot = owner[src] * k + coordinate
        order = np.argsort(-r)  # the last assignment, of least rank, stays
        slot, dart, r = slot[order], dart[order], r[order]
        new_rank, new_dart = np.full(docs * k, np.inf), np.zeros(docs * k, _U)
        new_rank[slot], new_dart[slot] = r, dart
        better = new_rank < rank
        rank[better], sig[better] = new_rank[better], new_dart[better]
        full = np.isfinite(rank).reshape(docs, k).all(1)
        open_ &= ~(full & (need <= lo + width))
    return sig.reshape(docs, k)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    key = np.zeros((len(sig), bands), _U)
    for j in range(rows):
        key = mix(key * _GOLD + parts[:, :, j])
    return mix(key + (np.arange(bands, dtype=_U) * _GOLD)[None, :])


def node_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def signature_table(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, mark (hash of the text), node (the text's words as a number), digest (SHA-256 of the words), cells (their number) and bands (hashed keys; empty for texts without words)."""

    def sign(texts, _):
        import pyarrow as pa

        forget()
        s, bounds, _whole, _n = shingle_hashes(texts)
        keys = band_keys(signatures(cells(s, bounds), bounds, bands * rows), bands, rows)
        n = np.diff(bounds)
        used = keys[n > 0].astype(np.int64).ravel() if len(n) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)), pa.array(used))
        digests = word_digests(texts)
        return None, [[node_of(d) for d in digests], pa.array(digests, pa.binary()), n.astype(np.int64), lists]

    marked = docs.select("doc_id", text_mark(), "text")
    return map_texts(marked, sign, "node long, digest binary, cells long, bands array<long>", ["doc_id", "mark"], most=1_000_000)


def text_mark():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")


def apart(signed: DataFrame) -> DataFrame:
    """`signed` with nodes numbered anew where texts with different words share a number."""
    while True:
        seen = signed.groupBy("node").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
        clash = stage(seen.where("lo <> hi").select(F.col("node").alias("shared")), "clash")
        if clash.isEmpty():
            return signed
        again = signed.join(clash, signed["node"] == clash["shared"], "left")
        node = F.when(F.col("shared").isNotNull(), F.xxhash64("node", "digest")).otherwise(F.col("node"))
        signed = stage(again.withColumn("node", node).drop("shared"), "signed")


def verified(links: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) whose texts' Jaccard similarity, as sets of cells, reaches the threshold."""
    left = texts.select(F.col("node").alias("a"), F.col("cells").alias("na"), F.col("held").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("cells").alias("nb"), F.col("held").alias("tb"))
    pairs = links.select("a", "b").join(left, "a").join(right, "b").where((F.least("na", "nb") >= threshold * F.greatest("na", "nb")))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.where(both / (F.col("na") + F.col("nb") - both) >= threshold).select("a", "b")


def mixed_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, node, ...) of buckets that hold several components, with their root."""
    own = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = own.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("key")
    return own.join(mixed, "key")


def led_links(mixed: DataFrame, lead: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of the members of a bucket with its leaders (rows of `mixed`) of other components."""
    lead = lead.select("key", F.col("node").alias("leader"), F.col("root").alias("of"), F.col("cells").alias("c"))
    hits = mixed.join(lead, "key").where((F.col("root") != F.col("of")) & (F.least("cells", "c") >= threshold * F.greatest("cells", "c")))
    return hits.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def rare_links(mixed: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of all members of different components that can reach the threshold, found on their rare cells.

    Cells are ordered alike for all texts: those in one component only, then the
    others by frequency. Texts of x <= y cells that reach threshold t have
    c >= t / (1 + t) * (x + y) cells in common, so behind (and with) their first
    common cell each has c cells at least. That cell therefore lies among the
    first x - 2t / (1 + t) * x cells of the shorter text and the first y - ty of
    the longer one, and a join on these cells loses no link. Frequent cells, such
    as those of passages that many texts share, come last and are not joined.
    """

    def spell(batches):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for node, root, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s, bounds, _w, _n = shingle_hashes([unpack.decompress(packed).decode()])
                found = pa.array(cells(s, bounds).view(np.int64))
                same = [pa.array(np.full(len(found), v, np.int64)) for v in (node, root, len(found))]
                yield pa.RecordBatch.from_arrays([*same, found], names=["node", "root", "size", "cell"])

    nodes = mixed.select("node", "root").distinct()
    spelt = stage(nodes.join(texts, "node").select("node", "root", "packed").mapInArrow(spell, "node long, root long, size long, cell long"), "cells")
    often = spelt.groupBy("cell").agg(F.count("*").alias("often"), F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("cell", "often")
    by_node = Window.partitionBy("node")
    left = F.count("*").over(by_node) - F.row_number().over(by_node.orderBy("often", "cell")) + 1  # cells of the text from this one on
    placed = spelt.join(often, "cell").withColumn("left", left).where(F.col("left") >= threshold * F.col("size") - 1e-6)
    placed = stage(placed.select("cell", "node", "root", "size", "left"), "placed")
    share = threshold / (1 + threshold)
    short = placed.where(F.col("left") >= 2 * share * F.col("size") - 1e-6).toDF("cell", "a_", "of", "sa", "la")
    meet = (F.col("root") != F.col("of")) & (F.col("sa") <= F.col("size")) & (F.least("la", "left") >= share * (F.col("sa") + F.col("size")) - 1e-6)
    return placed.join(short, "cell").where(meet).select(F.least("node", "a_").alias("a"), F.greatest("node", "a_").alias("b")).distinct()


def near_links(docs: DataFrame, signed: DataFrame, threshold: float, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Verified links between texts, and their components `(node, root)`."""
    nodes = signed.where("size(bands) > 0").groupBy("node").agg(F.first("bands").alias("bands"), F.first("cells").alias("cells"), F.min(F.struct("doc_id", "mark")).alias("rep"))
    nodes = stage(nodes, "nodes")
    spread = nodes.select("node", "cells", F.explode("bands").alias("key"))
    lead = spread.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("n > 1")
    hits = spread.join(lead, "key").select("node", F.explode(F.array("lo", "hi")).alias("leader")).where("node <> leader")
    links = stage(hits.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "candidates")

    ids = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep"), "node")
    wanted = ids.select(F.col("rep.doc_id").alias("wanted_id"), F.col("rep.mark").alias("wanted_mark"), F.col("node").alias("wanted"))

    def hold(texts, _):
        import pyarrow as pa
        import zstandard

        forget()
        s, bounds, _whole, _n = shingle_hashes(texts)
        squeeze = zstandard.ZstdCompressor(level=3)
        packed = pa.array([squeeze.compress(t.encode("utf-8", "replace")) for t in texts], pa.binary())
        return None, [np.diff(bounds), packed, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(cells(s, bounds).view(np.int64)))]

    # A text is fetched by the row that stands for it: by its mark too, so that null ids meet equal texts only.
    marked = docs.select("doc_id", text_mark(), "text")
    fetched = marked.join(wanted, (F.col("mark") == F.col("wanted_mark")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("text", "wanted")
    texts = map_texts(fetched, hold, "cells long, packed binary, held array<long>", ["wanted"], most=1_000_000).withColumnRenamed("wanted", "node")
    texts = stage(texts.dropDuplicates(["node"]), "texts")

    both = stage(verified(links, texts, threshold), "verified")
    roots = components(both)

    # Buckets of up to three texts are done: their least and largest met all others. In the others two more members lead. In
    # buckets that are still mixed then, all members lead if they are few; large ones are joined on the rare cells of their texts.
    members = spread.join(lead.where("n > 3").select("key", "n"), "key")
    mixed = stage(mixed_buckets(members, roots), "mixed")
    own = F.struct(F.xxhash64("key", "node").alias("h"), "node", "root", "cells")
    two = mixed.groupBy("key").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
    two = two.select("key", F.explode(F.array("lo", "hi")).alias("l")).select("key", "l.node", "l.root", "l.cells")
    few = F.col("n") <= FEW

    def joined(fresh: DataFrame, both: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        more = stage(verified(fresh, texts, threshold), "verified")
        return (both, roots) if more.isEmpty() else (both.union(more), extended(roots, more))

    fresh = stage(led_links(mixed, two, threshold).join(links, ["a", "b"], "left_anti"), "fresh")
    both, roots = joined(fresh, both, roots)
    mixed = stage(mixed_buckets(mixed.drop("root"), roots), "mixed")
    last = led_links(mixed.where(few), mixed.where(few), threshold).union(rare_links(mixed.where(~few), texts, threshold)).distinct()
    both, roots = joined(stage(last.join(links.union(fresh), ["a", "b"], "left_anti"), "fresh"), both, roots)
    return both, roots


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, class_id (least id in its class), class_size, n_links, kept.

    Texts with the same words are one text; texts without any word (null and
    empty among them) are one text. Classes are the components of verified links.
    `n_links` counts the verified links of the row's text that joined its class
    (links to leaders of its buckets, not all pairs). A class of which all ids
    are null has a null class_id; repeated rows count in class_size. An empty
    table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = apart(stage(signature_table(docs, bands, rows), "signed"))
    links, roots = near_links(docs, signed, threshold, bands, rows)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    by_node = signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("many"))
    by_node = by_node.join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = by_node.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("many").alias("class_size"))
    info = by_node.select("node", "root", F.coalesce("n_links", F.lit(0)).alias("n_links")).join(by_root, "root")
    out = signed.select("doc_id", "node").join(info, "node")
    return out.select("doc_id", "class_id", "class_size", "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
