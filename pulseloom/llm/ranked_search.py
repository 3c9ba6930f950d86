"""Ranked lexical search over a length-stratified index.

A document's score depends on its length only through the integer normaliser m,
so documents of one m form a stratum in which a posting's impact is a function
of its term frequency alone.

1. Forward rows: each text's distinct terms and their frequencies, in one pass.
2. Index: rows are sorted by m (ranges of m go to tasks, a stratum that many
   documents share is cut by a hash of the document) and gathered into leaves:
   documents of one m, at most `leaf_docs` of them, with postings by term and,
   within a term, by falling frequency. A leaf knows the highest frequency of
   each of its terms.
3. Search: the postings of the queries' terms are picked from the leaves. Their
   document frequencies give the weights. Weights and highest frequencies bound
   what a leaf can give to a query. A first visit of the best leaves of each
   batch gives every query a threshold; then all leaves are visited in the order
   of their bounds, and a leaf is left out for a query when its bound is under
   the query's tenth best score so far. Impacts are computed once for each
   frequency of a leaf. What is left out cannot reach the ten, so results are
   those of a full ranking.

Queries are sent to the tasks in blocks of a bounded size; each block is one
pass over the index, never over the texts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm.common import map_texts, small_batches, stage, table

K = 10
LEAF_DOCS, LEAF_POSTINGS = 4096, 1_000_000
BLOCK_ITEMS, BLOCK_CHARS = 1_000, 2_000_000
SCALE = 1_000_000_000
#: ASCII letters to lower case; all ASCII but letters and digits to spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _binary(data: np.ndarray, sizes: np.ndarray):
    """Arrow array of the runs of `data` with these sizes."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _lines(blob: bytes):
    """Arrow array of the lines of a blob, each closed by a line feed (no term holds one)."""
    a = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero(a == 10)
    return _binary(a[a != 10], np.diff(ends, prepend=-1) - 1)


def forward_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms (distinct, a line each), tfs (int32), for documents with a term."""

    def count(texts, _):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        at = np.cumsum([0, *(len(r) + 1 for r in raw)])
        a = np.frombuffer((b" ".join(raw) + b" ").translate(_TABLE), np.uint8)
        inside = a != 32
        edge = np.diff(inside.astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        words = _binary(a[inside], ends - starts).dictionary_encode()
        owner = np.searchsorted(at, starts, "right") - 1
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair, tf = np.unique((owner << 32) | code, return_counts=True)
        known = words.dictionary.to_pylist()
        own, code = pair >> 32, pair & 0xFFFFFFFF
        cuts = np.searchsorted(own, np.arange(len(texts) + 1))
        rows, n, terms, tfs = [], [], [], []
        for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if lo < hi:
                rows.append(i)
                n.append(int(tf[lo:hi].sum()))
                terms.append(b"\n".join(map(known.__getitem__, code[lo:hi].tolist())) + b"\n")
                tfs.append(tf[lo:hi].astype("<i4").tobytes())
        return rows, [n, terms, tfs]

    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(taken, count, "n long, terms binary, tfs binary", ["doc_id"])


def normaliser(documents: int, total: int):
    """m of a document with `n` terms; the product may pass 64 bits before it is divided."""
    return F.expr(f"CAST(25 + (CAST(75 * n AS DECIMAL(38, 0)) * {int(documents)}L) DIV {int(total)}L AS BIGINT)")


LEAF = "m long, docs array<bigint>, terms binary, starts binary, tfs binary, places binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf_docs: int = LEAF_DOCS, leaf_postings: int = LEAF_POSTINGS) -> tuple[DataFrame, int]:
    """The index of all documents that have a term, a row for each leaf (LEAF), and their number N.

    terms are the leaf's terms in order, a line each; the postings of term i are
    those from starts[i] to starts[i + 1] (int32) of tfs and places (int32), a
    place being one of the leaf's `docs`. Null and empty texts are not in it;
    repeated rows are indexed each; a null id is kept. An empty table gives an
    empty index.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    forward = stage(forward_rows(docs, id_col, text_col), "forward")
    total = forward.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    schema = to_arrow_schema(StructType.fromDDL(LEAF))

    def gather(batches):
        import pyarrow as pa

        def leaf(m, rows):
            words = _lines(b"".join(r[1] for r in rows)).dictionary_encode()
            size = np.array([len(r[2]) // 4 for r in rows])
            order = pa.compute.sort_indices(words.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            term = rank[words.indices.to_numpy(zero_copy_only=False)]
            tf = np.frombuffer(b"".join(r[2] for r in rows), "<i4")
            place = np.repeat(np.arange(len(rows)), size)
            by = np.lexsort((place, -tf.astype(np.int64), term))
            starts = np.searchsorted(term[by], np.arange(len(order) + 1))
            lines = b"\n".join(words.dictionary.take(pa.array(order)).to_pylist()) + b"\n"
            made = [[m], [[r[0] for r in rows]], [lines], *([c.astype("<i4").tobytes()] for c in (starts, tf[by], place[by]))]
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(made, schema, strict=True)], schema=schema)

        pending, now, held = [], None, 0
        for batch in batches:
            for m, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if pending and (m != now or len(pending) >= leaf_docs or held >= leaf_postings):
                    yield leaf(now, pending)
                    pending, held = [], 0
                now = m
                pending.append(row)
                held += len(row[2]) // 4
        if pending:
            yield leaf(now, pending)

    placed = forward.select(normaliser(total["documents"], max(1, total["terms"])).alias("m"), "doc_id", "terms", "tfs")
    placed = placed.repartitionByRange("m", F.xxhash64("doc_id", "terms")).sortWithinPartitions("m", "doc_id")
    small_batches(docs.sparkSession)
    return stage(placed.mapInArrow(gather, LEAF), "leaves"), total["documents"]


class Queries:
    """A block of queries: the terms, and for each (query, term) pair how often the query has the term."""

    def __init__(self, texts: list[str | None]):
        self.own = [terms_of(t) for t in texts]
        self.terms = sorted({t for ts in self.own for t in ts})
        place = {t: i for i, t in enumerate(self.terms)}
        pairs = [(q, place[t]) for q, ts in enumerate(self.own) for t in ts]
        self.times = np.zeros((len(self.terms), len(texts)), np.int64)
        for q, t in pairs:
            self.times[t, q] += 1

    def weigh(self, documents: int, df: dict[int, int]) -> None:
        w = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.terms))]
        self.weights = self.times * np.array(w, np.int64)[:, None]
        #: Scores below 2**53 are exact in doubles, whose products are much faster.
        self.exact_in_doubles = not self.weights.size or self.weights.sum(0).max() * 1_000_000 < 1 << 53


PICKED = "m long, docs array<bigint>, asked binary, starts binary, tfs binary, places binary"


def _pick(sent):
    """Leaves -> the postings of the queries' terms in them; leaves without one are left out."""

    def run(batches):
        import pyarrow as pa

        wanted = pa.array(sent.value.terms, pa.large_binary())
        for batch in batches:
            made = []
            for i in range(batch.num_rows):
                terms, starts, tfs, places = (batch.column(j)[i].as_py() for j in range(2, 6))
                asked = pa.compute.index_in(_lines(terms), value_set=wanted)
                here = np.flatnonzero(asked.is_valid().to_numpy(zero_copy_only=False))
                if len(here):
                    s = np.frombuffer(starts, "<i4")
                    size = s[here + 1] - s[here]
                    begins = np.concatenate([[0], np.cumsum(size)])
                    take = np.repeat(s[here] - begins[:-1], size) + np.arange(begins[-1])
                    ids = asked.take(pa.array(here)).to_numpy(zero_copy_only=False)
                    columns = [ids, begins, np.frombuffer(tfs, "<i4")[take], np.frombuffer(places, "<i4")[take]]
                    made.append([batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), *(c.astype("<i4").tobytes() for c in columns)])
            if made:
                kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["m", "docs", "asked", "starts", "tfs", "places"])

    return run


class Leaf:
    """A leaf's postings of the queries' terms, with the impact of each."""

    def __init__(self, m: int, docs: list, asked: bytes, starts: bytes, tfs: bytes, places: bytes):
        self.docs, self.asked, self.starts, self.places = docs, *(np.frombuffer(c, "<i4") for c in (asked, starts, places))
        kinds, at = np.unique(np.frombuffer(tfs, "<i4"), return_inverse=True)
        once = np.array([(SCALE * tf) // (1000 * tf + 8 * m) for tf in kinds.tolist()], np.int64)  # an impact for each frequency
        self.impact = once[at]

    def bounds(self, q: Queries) -> np.ndarray:
        """No document of the leaf scores more for a query than its terms would with their highest frequencies."""
        return self.impact[self.starts[:-1]] @ q.weights[self.asked]

    def scores(self, q: Queries, some: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Scores of the documents lo..hi for some of the queries."""
        kind = np.float64 if q.exact_in_doubles else np.int64
        grid = np.zeros((hi - lo, len(self.asked)), kind)
        column = np.repeat(np.arange(len(self.asked)), np.diff(self.starts))
        here = (self.places >= lo) & (self.places < hi)
        grid[self.places[here] - lo, column[here]] = self.impact[here]
        return (grid @ q.weights[np.ix_(self.asked, some)].astype(kind)).astype(np.int64)


class Best:
    """The best documents of each query so far, at most k (equal scores: the lower id), and the score to reach."""

    def __init__(self, queries: int, k: int, least: np.ndarray):
        self.k, self.least, self.found = k, np.maximum(least, 1), [[] for _ in range(queries)]

    def visit(self, leaf: Leaf, q: Queries, bounds: np.ndarray, together: int = 512) -> None:
        some = np.flatnonzero(bounds >= self.least)
        for lo in range(0, len(leaf.docs) if len(some) else 0, together):
            hi = min(lo + together, len(leaf.docs))
            scores = leaf.scores(q, some, lo, hi)
            for j in np.flatnonzero((scores >= self.least[some]).any(0)):
                item, column = some[j], scores[:, j]
                good = np.flatnonzero(column >= self.least[item])
                if len(good) > self.k:
                    good = good[column[good] >= np.partition(column[good], -self.k)[-self.k]]
                new = [(-int(column[i]), leaf.docs[lo + i] is None, leaf.docs[lo + i] or 0) for i in good]
                self.found[item] = sorted(self.found[item] + new)[: self.k]
                if len(self.found[item]) == self.k:
                    self.least[item] = max(self.least[item], -self.found[item][-1][0])


def _visit(sent, k: int, first_only: bool, together: int = 64):
    """Picked leaves -> the best documents of the task for each query: (item, doc_id, score). `first_only` visits one leaf for each query and batch."""

    def run(batches):
        import pyarrow as pa

        q, least = sent.value
        best = Best(len(q.own), k, least)
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for at in range(0, len(rows), together):
                leaves = [Leaf(*r) for r in rows[at : at + together]]
                bounds = np.stack([leaf.bounds(q) for leaf in leaves])
                if first_only:
                    top = bounds.argmax(0)
                    bounds = np.where(np.arange(len(leaves))[:, None] == top, bounds, 0)
                for i in np.argsort(-bounds.max(1), kind="stable"):
                    best.visit(leaves[i], q, bounds[i])
        out = [(item, None if no_id else doc, -score) for item, own in enumerate(best.found) for score, no_id, doc in own]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["item", "doc_id", "score"])

    return run


def search(index: DataFrame, documents: int, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """For each row of `items` the k documents with the highest positive scores: item_id, rank, doc_id, score.

    A null text, or one without terms, finds nothing; a term that a query repeats counts as often; repeated items are answered
    each. Documents without an id come after others of their score.
    """
    spark = index.sparkSession
    items = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-size["chars"] // BLOCK_CHARS))
    out = None
    small_batches(spark)
    for block in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        q = Queries([r["text"] for r in some])
        sent = spark.sparkContext.broadcast(q)
        picked = stage(index.mapInArrow(_pick(sent), PICKED), "picked")
        df = picked.mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # terms of the block
        q.weigh(documents, {r["term"]: r["n"] for r in df})
        first = spark.sparkContext.broadcast((q, np.ones(len(some), np.int64)))
        tenth = _ranked(picked.mapInArrow(_visit(first, k, True), "item long, doc_id long, score long")).where(F.col("rank") == k).collect()  # a row for each item of the block
        least = np.ones(len(some), np.int64)
        for r in tenth:
            least[r["item"]] = r["score"]
        known = spark.sparkContext.broadcast((q, least))
        ranked = _ranked(picked.mapInArrow(_visit(known, k, False), "item long, doc_id long, score long")).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(some)], "item long, item_id long")
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        part = stage(part, "ranked") if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def _frequencies(batches):
    """Picked leaves -> (term, number of documents) of the task."""
    import pyarrow as pa

    total: dict[int, int] = {}
    for batch in batches:
        for asked, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            for t, n in zip(np.frombuffer(asked, "<i4").tolist(), np.diff(np.frombuffer(starts, "<i4")).tolist(), strict=True):
                total[t] = total.get(t, 0) + n
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, documents = build_index(table(spark, sf_dir, "documents"))
    return search(index, documents, table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10ffff}]+') AS w FROM benchmark),
c AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, CAST(25 + (75 * len(w) * nn) // ll AS BIGINT) AS m FROM d, c WHERE len(w) > 0),
a AS (SELECT i, t, count(*) AS times FROM (SELECT i, unnest(w) AS t FROM q) GROUP BY ALL),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM a) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM p, c GROUP BY t, nn),
s AS (SELECT a.i, p.r, CAST(sum(a.times * f.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) AS BIGINT) AS score
  FROM a JOIN p USING (t) JOIN f USING (t) JOIN m USING (r) GROUP BY a.i, p.r),
o AS (SELECT q.item_id, m.doc_id, s.score, row_number() OVER (PARTITION BY s.i ORDER BY s.score DESC, m.doc_id NULLS LAST) AS rank FROM s JOIN q USING (i) JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM o WHERE rank <= 10
"""
