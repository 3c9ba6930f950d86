"""Benchmark decontamination: size-partitioned MinHash containment search.

Benchmark items are short and documents long, so a plain MinHash of a whole
document would say little about an item in it. Items are therefore partitioned
by size (powers of two of their number of shingles), and for the partition with
upper size u a document is cut into overlapping windows of at most 2u shingles,
u apart, so that a passage of up to u shingles lies whole in one window. With
containment t an item of the partition then has a Jaccard similarity of at least
t/2 / (2 + t/2) with that window, and it agrees in one of `hashes` minima with
probability above 1 - 2e-6 at t = 0.8 and 64 hashes. Every agreement is
verified on the exact five-word shingles (the words themselves, not hashes) of
the whole document.

An item of k < 5 words is one shingle of k words. The least hash of a set of one
is that of its element under every hash, so for these partitions the search is a
lookup of the documents' k-word shingles, again verified on the words.

The benchmark's sketches are sent to the tasks only in blocks of a bounded size:
items are dealt to as many blocks as their number asks for, and each block is one
pass over the documents.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.arrays import _U, WIDTH, mix, run_hashes, shingle_hashes, words
from pulseloom.llm.common import kept, map_texts, stage, table

HASHES, THRESHOLD = 64, 0.8
BLOCK_ITEMS, BLOCK_CHARS = 10_000, 16_000_000


def _multipliers(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=_U)) | _U(1)


def shingle_set(w: list[str], width: int) -> set[tuple]:
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


class Sketches:
    """A block of items: minima by size partition as sorted arrays per hash, hashes of short items by width, and exact shingles."""

    def __init__(self, texts: list[str | None], hashes: int = HASHES):
        self.mult = _multipliers(hashes)
        item_words = [words(t or "") for t in texts]
        self.width = [min(WIDTH, len(w)) for w in item_words]
        self.exact = [shingle_set(w, k) if k else set() for w, k in zip(item_words, self.width, strict=True)]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(1, WIDTH):
            if some := [i for i, x in enumerate(self.width) if x == k]:
                h = run_hashes([texts[i] for i in some], k)[0]
                order = np.argsort(h)
                self.short[k] = h[order], np.array(some)[order]
        s, bounds, _w, _n = shingle_hashes(texts)
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[int]] = {}
        sets = [np.unique(s[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
        for i, x in enumerate(sets):
            if self.width[i] == WIDTH:
                by_size.setdefault(1 << (len(x) - 1).bit_length(), []).append(i)
        for u, items in sorted(by_size.items()):
            minima = np.array([[(sets[i] * m).min() for m in self.mult] for i in items], _U)
            order = np.argsort(minima, axis=0)
            self.parts[u] = (np.take_along_axis(minima, order, 0), np.array(items)[order])

    def candidates(self, texts: list[str]) -> set[tuple[int, int]]:
        """(text, item) pairs that agree in some minimum."""
        found: set[tuple[int, int]] = set()

        def agreeing(keys, items, low, owner):
            lo, hi = np.searchsorted(keys, low), np.searchsorted(keys, low, "right")
            for w in np.flatnonzero(hi > lo):
                found.update((int(owner[w]), int(i)) for i in items[lo[w] : hi[w]])

        for k, (keys, items) in self.short.items():
            h, owner = run_hashes(texts, k)
            agreeing(keys, items, h, owner)
        s, bounds, _w, _n = shingle_hashes(texts) if self.parts else (None, np.zeros(1, int), None, None)
        n = np.diff(bounds)
        live = np.flatnonzero(n)
        if not len(live):
            return found
        grids = {}
        for u in self.parts:
            blocks = -(-n[live] // u)
            owner = np.repeat(live, blocks)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            grids[u] = (bounds[owner] + nth * u, owner, np.flatnonzero(owner[1:] == owner[:-1]))
        for j, m in enumerate(self.mult):
            v = s * m
            for u, (minima, items) in self.parts.items():
                at, owner, pairs = grids[u]
                low = np.minimum.reduceat(v, at)
                low[pairs] = np.minimum(low[pairs], low[pairs + 1])  # a block and the next are a window
                agreeing(minima[:, j], items[:, j], low, owner)
        return found


def sketches_of(key: str, texts: list[str | None], hashes: int) -> Sketches:
    """The worker's sketches of a block, kept over its tasks."""
    return kept(("sketches", key), lambda: Sketches(texts, hashes))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, hashes: int = HASHES) -> DataFrame:
    """Pairs (doc_id, item_id, containment, n_shingles) where the document has at least `threshold` of the item's distinct shingles.

    Shingles are of five words, or of all words of an item that has fewer. Null
    and empty texts, and items without a word, match nothing. Repeated document
    rows give repeated pairs; repeated items too. Empty tables give an empty
    result; extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["chars"] // BLOCK_CHARS))
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        sent = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.collect()])
        one = map_texts(docs, _matcher(sent, uuid.uuid4().hex, threshold, hashes), "item_id long, containment double, n_shingles long", ["doc_id"], most=1_000_000)
        if blocks > 1:  # so that one block at a time is in memory
            one = stage(one, "contained")
            sent.destroy()
        out = one if out is None else out.unionByName(one)
    return out


def _matcher(sent, key: str, threshold: float, hashes: int):
    def match(texts, _):
        block = sketches_of(key, [t for _i, t in sent.value], hashes)
        by_text: dict[int, list[int]] = {}
        for t, i in sorted(block.candidates(texts)):
            by_text.setdefault(t, []).append(i)
        rows, ids, share, size = [], [], [], []
        for t, found in by_text.items():
            own = words(texts[t])
            whole = {k: shingle_set(own, k) for k in {block.width[i] for i in found}}
            for i in found:
                item = block.exact[i]
                c = len(item & whole[block.width[i]]) / len(item)
                if c >= threshold:
                    rows.append(t)
                    ids.append(sent.value[i][0])
                    share.append(c)
                    size.append(len(item))
        return rows, [ids, share, size]

    return match


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round("containment", 6))


ORACLE = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10ffff}]+') FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT DISTINCT least(5, len(w)) AS k FROM w WHERE kind = 'b' AND len(w) > 0),
s AS (
  SELECT DISTINCT kind, id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s
  FROM w, k WHERE len(w) >= k AND (kind = 'd' OR k = least(5, len(w)))),
size AS (SELECT id, count(*) AS n FROM s WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, round(count(*)::DOUBLE / any_value(n), 6) AS containment, any_value(n) AS n_shingles
FROM s d JOIN s b ON d.s = b.s AND d.k = b.k AND d.kind = 'd' AND b.kind = 'b' JOIN size ON size.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(n)
"""
