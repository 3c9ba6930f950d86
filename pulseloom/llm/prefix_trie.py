"""Conversation prefix trie by double arrays over shards of sorted prefixes.

1. Turns become 128-bit keys (of SHA-256) with their number of words. Rows are
   sorted by conversation and turn over all tasks, so that a turn's position does
   not ask for a conversation in one task.
2. Sequences are cut into segments of SEGMENT turns. Segments are sorted by the
   node they begin at, their turns and their conversation: what shares a prefix
   stands together, and a prefix that many conversations share, even a whole
   conversation that many repeat, is cut by conversation.
3. A shard is a run of that order of a bounded number of turns. In it turns get
   dense ids, and the sequences are packed level by level into a double array:
   the child of state s by turn t is at BASE[s] + t, and CHECK there names s.
   Walking the sequences through the arrays gives the nodes and, level by level
   back up, what their subtrees hold.
4. Only nodes on the paths of a shard's first and last sequence, those that
   further segments begin at, and the nodes above these can be in other shards
   too. Their parts are merged by node, and their subtrees summed by pointer
   doubling; all other nodes are complete as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm.common import small_batches, stage, table

SEGMENT, SHARD_TURNS, BUCKET = 512, 500_000, 65_536
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"
_NONE = np.iinfo(np.int64).max


# ---- sequences ------------------------------------------------------------------


def turn_keys(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, hi, lo (128 bits of the SHA-256 of role and text), words of the text. Rows without a conv_id belong to no conversation."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    long = lambda at: F.shiftleft(F.conv(F.substring(digest, at, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring(digest, at + 8, 8), 16, 10).cast("long"))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), long(1).alias("hi"), long(17).alias("lo"), words.alias("words"))


def positions(keys: DataFrame) -> DataFrame:
    """`keys` in order of turn (null first; equal turns by key), with `pos` from 0 in each conversation; written to the shared folder."""
    ranged = keys.repartitionByRange("conv_id", "turn", "hi", "lo").sortWithinPartitions("conv_id", "turn", "hi", "lo")

    def number(batches):
        import pyarrow as pa

        last, seen = None, 0
        for b in batches:
            conv = b.column(0).to_numpy()
            if not len(conv):
                continue
            new = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            at = np.arange(len(conv)) - np.repeat(new, np.diff(np.append(new, len(conv))))
            if conv[0] == last:
                at[: new[1] if len(new) > 1 else len(at)] += seen
            last, seen = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=["conv_id", "hi", "lo", "words", "part", "at"])

    small_batches(keys.sparkSession)
    rows = stage(ranged.select("conv_id", "hi", "lo", "words", F.spark_partition_id().alias("part")).mapInArrow(number, "conv_id long, hi long, lo long, words long, part int, at long"), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # A task's range has at most one conversation that began in an earlier one: no more rows than tasks.
    carried = parts.select("conv_id", "part", before.alias("before")).where("before > 0")
    return rows.join(F.broadcast(carried), ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "hi", "lo", "words")


def own_sequences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`positions` -> rows (conv_id, depth, hi, lo, words) and conversations (conv_id, length) as they are."""
    return turns.withColumnRenamed("pos", "depth"), turns.groupBy("conv_id").agg(F.count("*").alias("length"))


def rebuilt_sequences(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first h turns of the one at the head of their block of `every`, h = crc32(conv_id) % `most`.

    Their own first h turns are left out. Returns rows (conv_id, depth, hi, lo, words) and conversations (conv_id, length).
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    block = F.col("conv_id") - F.col("conv_id") % every
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", h.alias("h"), block.alias("block"))
    donors = convs.where("conv_id = block").select("block", F.col("n").alias("given"))
    convs = stage(convs.join(donors, "block", "left").select("conv_id", "n", "h", "block", F.least("h", F.coalesce("given", F.lit(0))).alias("head")), "conversations")
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).select(F.col("conv_id").alias("block"), F.col("pos").alias("depth"), "hi", "lo", "words")
    begun = convs.select("conv_id", "block", "head").where("head > 0").join(heads, "block").where("depth < head").select("conv_id", "depth", "hi", "lo", "words")
    # The join is by (conversation, run of positions), so that a long conversation is many keys.
    shifts = convs.select("conv_id", "h", "head", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / BUCKET))).alias("bucket"))
    own = turns.withColumn("bucket", F.floor(F.col("pos") / BUCKET)).join(shifts, ["conv_id", "bucket"]).where("pos >= h")
    rows = begun.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("depth"), "hi", "lo", "words"))
    return rows, convs.select("conv_id", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def segments(rows: DataFrame, convs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """One row per `size` turns of a conversation: k, s1, s2 (the node it begins at), seq, words, x (node keys' parts), conv_id, ended."""
    part = lambda seed: F.xxhash64(F.lit(seed), "depth", "hi", "lo")
    turn = F.struct((F.col("depth") % size).alias("j"), "hi", "lo", "words", part(1).alias("x1"), part(2).alias("x2"))
    per = rows.withColumn("k", F.floor(F.col("depth") / size)).groupBy("conv_id", "k").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.bit_xor(part(1)).alias("x1"), F.bit_xor(part(2)).alias("x2")
    )  # at most `size` turns each
    per = convs.select("conv_id", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("length") - 1) / size), F.lit(0)))).alias("k")).join(per, ["conv_id", "k"], "left")
    per = stage(per, "segments")
    w = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.where(F.col("length") > size).select("conv_id", "k", F.bit_xor("x1").over(w).alias("s1"), F.bit_xor("x2").over(w).alias("s2")).where("k > 0")
    zero, none = F.lit(0).cast("long"), F.expr("CAST(array() AS array<struct<j: bigint, hi: bigint, lo: bigint, words: bigint, x1: bigint, x2: bigint>>)")
    turns = F.coalesce("turns", none)
    pick = lambda *names: F.transform(turns, lambda t: F.struct(*[t[n].alias(n) for n in names]))
    return per.join(starts, ["conv_id", "k"], "left").select(
        "k", F.coalesce("s1", zero).alias("s1"), F.coalesce("s2", zero).alias("s2"), pick("hi", "lo").alias("seq"), pick("words", "x1", "x2").alias("more"), "conv_id",
        (F.col("length") <= (F.col("k") + 1) * size).alias("ended"),
    )


# ---- shards ---------------------------------------------------------------------


class DoubleArray:
    """BASE and CHECK over dense codes, grown level by level. Slot 0 is no state; roots have no CHECK (-1)."""

    def __init__(self, roots: int):
        self.base, self.check, self.used = np.zeros(1024, np.int64), np.full(1024, -1), np.zeros(1024, bool)
        self._room(roots + 1)
        self.used[: roots + 1] = True
        self.cursor = 1

    def _room(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base, self.check, self.used = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1)), np.append(self.used, np.zeros(more, bool))

    def _free(self, n: int) -> np.ndarray:
        """The first n free slots."""
        while True:
            free = np.flatnonzero(~self.used[self.cursor :])
            if len(free) >= n:
                self.cursor += int(free[0]) if len(free) else 0
                return np.flatnonzero(~self.used[self.cursor :])[:n] + self.cursor
            self._room(2 * len(self.base) + n)

    def place(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Give distinct (parent, code) pairs, sorted by parent and code, their states."""
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        size = np.diff(np.append(first, len(parents)))
        for i in np.argsort(-size, kind="stable"):
            if size[i] == 1:
                break
            own = codes[first[i] : first[i] + size[i]]
            tries = max(1, min(64, 200_000 // len(own)))
            slot = int(self._free(1)[0])
            while True:
                bases = slot - own[0] + np.arange(tries)
                self._room(int(bases[-1] + own[-1]) + 2)
                fits = np.flatnonzero(~self.used[bases[:, None] + own].any(1))
                if len(fits):
                    break
                slot += tries
            base = bases[fits[0]]
            self.base[parents[first[i]]] = base
            self.used[base + own] = True
        single = first[size == 1]
        if len(single):  # a single child goes to any free slot
            slots = self._free(len(single))
            self.base[parents[single]] = slots - codes[single]
            self.used[slots] = True
        states = self.base[parents] + codes
        self.check[states] = parents
        return states

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of states by codes; all must be there."""
        out = self.base[states] + codes
        if (self.check[out] != states).any():
            raise ValueError("CHECK does not name the parent")
        return out


def shard_nodes(group: np.ndarray, starts: np.ndarray, offsets: np.ndarray, turn: np.ndarray, words: np.ndarray, x: np.ndarray, conv: np.ndarray, ended: np.ndarray, depth0: np.ndarray) -> dict:
    """Nodes of one shard's sorted sequences, by the double array.

    group: of each row, its start (row of `starts`, two key columns, at `depth0`);
    offsets: where its turns begin in `turn` (n x 2), `words` and `x` (n x 2).
    """
    n_roots, lengths = len(starts), np.diff(offsets)
    code = np.unique(turn, axis=0, return_inverse=True)[1].ravel() if len(turn) else np.zeros(0, np.int64)
    # Rows that repeat the row before are one sequence.
    same = np.zeros(len(conv), bool)
    for i in range(1, len(conv)):
        same[i] = group[i] == group[i - 1] and lengths[i] == lengths[i - 1] and np.array_equal(code[offsets[i] : offsets[i + 1]], code[offsets[i - 1] : offsets[i]])
    head = np.flatnonzero(~same)
    times, least = np.diff(np.append(head, len(conv))), np.minimum.reduceat(conv, head)
    trie = DoubleArray(n_roots)
    state = group[head] + 1
    levels, made = [np.unique(state)], {}
    trail = {0: [state[0]], len(head) - 1: [state[-1]]}
    count, lowest = [(state.copy(), times)], [(state.copy(), least)]
    for d in range(int(lengths.max(initial=0))):
        live = np.flatnonzero(lengths[head] > d)
        at = offsets[head[live]] + d
        pair, example = np.unique(np.stack([state[live], code[at]], 1), axis=0, return_index=True)
        kids = trie.place(pair[:, 0], pair[:, 1])
        made[d] = (kids, at[example])
        state[live] = trie.step(state[live], code[at])
        count.append((state[live].copy(), times[live]))
        lowest.append((state[live].copy(), least[live]))
        levels.append(kids)
        for u, path in trail.items():
            if lengths[head[u]] > d:
                path.append(state[u])
    slots = len(trie.base)
    n, low, depth = np.zeros(slots, np.int64), np.full(slots, _NONE), np.zeros(slots, np.int64)
    word, key = np.zeros(slots, np.int64), np.zeros((slots, 2), np.int64)
    for s, c in count:
        np.add.at(n, s, c)
    for s, c in lowest:
        np.minimum.at(low, s, c)
    key[1 : n_roots + 1], depth[1 : n_roots + 1] = starts, depth0
    for d, (kids, example) in made.items():
        parent = trie.check[kids]
        word[kids], key[kids], depth[kids] = words[example], key[parent] ^ x[example], depth[parent] + 1
    open_ = np.zeros(slots, bool)
    open_[1 : n_roots + 1] = True
    for path in trail.values():
        open_[path] = True
    going_on = np.zeros(len(head), bool)
    np.logical_or.at(going_on, np.cumsum(~same) - 1, ~ended)
    open_[state[going_on]] = True
    kids_n, closed_n, leaves, saved = (np.zeros(slots, np.int64) for _ in range(4))
    for kids in reversed(levels[1:]):
        parent = trie.check[kids]
        np.logical_or.at(open_, parent, open_[kids])
        np.add.at(kids_n, parent, 1)
        done = kids[~open_[kids]]
        leaves[done] = np.where(kids_n[done] == 0, 1, leaves[done])
        saved[done] += (n[done] - 1) * word[done]
        up = trie.check[done]
        np.add.at(closed_n, up, 1)
        np.add.at(leaves, up, leaves[done])
        np.add.at(saved, up, saved[done])
    return {"nodes": np.concatenate(levels), "trie": trie, "n": n, "low": low, "depth": depth, "word": word, "key": key, "open": open_, "kids": kids_n, "closed": closed_n, "leaves": leaves, "saved": saved, "end": np.repeat(state, times), "roots": n_roots}


OUT = (
    "kind int, shard long, x1 long, x2 long, p1 long, p2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, "
    "ends_sha256 string, ids string"
)
CLOSED, OPEN, ENDS = 0, 1, 2


def _shards(size: int, most: int):
    """Sorted segments -> nodes by shard: closed ones complete, open ones and their members in parts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(OUT))

    def emit(rows, shard):
        import pyarrow as pa

        t = pa.Table.from_batches(rows)
        k, s1, s2 = (t.column(i).to_numpy() for i in range(3))
        conv, ended = t.column(5).to_numpy(), t.column(6).to_numpy()
        seq, more = t.column(3).combine_chunks(), t.column(4).combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(seq.value_lengths().to_numpy())]).astype(np.int64)
        turn = np.stack([c.to_numpy(zero_copy_only=False) for c in seq.flatten().flatten()], 1) if len(seq.flatten()) else np.zeros((0, 2), np.int64)
        words, x1, x2 = (c.to_numpy(zero_copy_only=False) for c in more.flatten().flatten())
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])
        first = np.flatnonzero(new)
        f = shard_nodes(np.cumsum(new) - 1, np.stack([s1[first], s2[first]], 1), offsets, turn, words, np.stack([x1, x2], 1), conv, ended, k[first] * size)
        nodes, parent = f["nodes"], f["trie"].check[f["nodes"]]
        is_open = f["open"][nodes]
        order = np.flatnonzero(ended)  # conversations end at their states, in order of state and conversation
        order = order[np.lexsort((conv[order], f["end"][order]))]
        at, ids = f["end"][order], list(map(str, conv[order].tolist()))
        cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else np.zeros(1, np.int64)
        ends = {int(at[a]): (a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)}
        sha = [None if o else hashlib.sha256(",".join(ids[slice(*ends.get(s, (0, 0)))]).encode()).hexdigest() for s, o in zip(nodes.tolist(), is_open, strict=True)]
        root, below = nodes <= f["roots"], parent >= 0
        upper = below & f["open"][parent]
        deep = root & (f["depth"][nodes] > 0)  # counted where the segment before ends
        pick = lambda a, hide: pa.array(a, pa.int64(), mask=hide)
        p = np.where(below, parent, 0)
        columns = [
            pa.array(np.where(is_open, OPEN, CLOSED), pa.int32()), pa.array(np.full(len(nodes), shard)), pa.array(f["key"][nodes, 0]), pa.array(f["key"][nodes, 1]), pick(f["key"][p, 0], ~below), pick(f["key"][p, 1], ~below),
            pa.array(f["depth"][nodes]), pick(f["low"][nodes], deep), pick(f["low"][p], ~below | upper), pa.array(np.where(deep, 0, f["n"][nodes])), pa.array(np.where(is_open, f["closed"][nodes], f["kids"][nodes])),
            pa.array(f["leaves"][nodes]), pa.array(f["saved"][nodes]), pa.array(f["word"][nodes]), pa.array(sha, pa.string()), pa.nulls(len(nodes), pa.string()),
        ]
        whole = pa.Table.from_arrays([c.cast(g.type) for c, g in zip(columns, schema, strict=True)], schema=schema)
        yield from whole.to_batches(max_chunksize=20_000)
        for s in nodes[is_open].tolist():
            a, b = ends.get(s, (0, 0))
            for lo in range(a, b, 20_000):
                row = {"kind": ENDS, "shard": shard, "x1": int(f["key"][s, 0]), "x2": int(f["key"][s, 1]), "conv_id": int(conv[order[lo]]), "ids": ",".join(ids[lo : min(b, lo + 20_000)])}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    def run(batches):
        from pyspark import TaskContext

        part, seq, held, pending = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            at = 0
            sizes = np.cumsum(batch.column(3).value_lengths().to_numpy() + 1)
            while at < batch.num_rows:  # fill the shard up to `most` turns
                done = int(sizes[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, done + most - held, "right"))) if not pending or held < most else at
                if to > at:
                    pending.append(batch.slice(at, to - at))
                    held += int(sizes[to - 1]) - done
                    at = to
                if held >= most or at < batch.num_rows:
                    yield from emit(pending, (part << 32) + seq)
                    pending, held, seq = [], 0, seq + 1
        if pending:
            yield from emit(pending, (part << 32) + seq)

    return run


# ---- merging --------------------------------------------------------------------


def _hashed(batches):
    """Rows (x1, x2, ids) sorted by node and conversation -> SHA-256 of each node's ids, a piece at a time."""
    import pyarrow as pa

    now, state, done = None, None, []
    for batch in batches:
        for x1, x2, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (x1, x2) != now:
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = (x1, x2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if len(done) > 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip(("x1", "x2", "sha"), d, strict=True)) for d in done])
            done = []
    if now:
        done.append((*now, state.hexdigest()))
    if done:
        yield pa.RecordBatch.from_pylist([dict(zip(("x1", "x2", "sha"), d, strict=True)) for d in done])


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """`nodes(x1, x2, p1, p2, n_leaves, saved_tokens)` -> x1, x2 with both summed over each node's subtree.

    Pointer doubling: after r rounds a node holds the sum over descendants less than 2**r below it, and adds those of the nodes 2**r below.
    """
    now = stage(nodes.select("x1", "x2", F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s")), "subtrees")
    while not now.where("a1 IS NOT NULL").isEmpty():
        given = now.where("a1 IS NOT NULL").groupBy(F.col("a1").alias("x1"), F.col("a2").alias("x2")).agg(F.sum("l").alias("gl"), F.sum("s").alias("gs"))
        hop = now.select(F.col("x1").alias("a1"), F.col("x2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        now = now.join(given, ["x1", "x2"], "left").join(hop, ["a1", "a2"], "left")
        now = stage(now.select("x1", "x2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), (F.col("l") + F.coalesce("gl", F.lit(0))).alias("l"), (F.col("s") + F.coalesce("gs", F.lit(0))).alias("s")), "subtrees")
    return now.select("x1", "x2", F.col("l").alias("n_leaves"), F.col("s").alias("saved_tokens"))


def prefix_trie(rows: DataFrame, convs: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of all prefixes of the sequences `rows(conv_id, depth, hi, lo, words)` of `convs(conv_id, length)`.

    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Conversations without turns are members of the root. No conversation at all gives no node.
    """
    small_batches(rows.sparkSession)
    keys = ["k", "s1", "s2", "seq", "conv_id"]
    cut = segments(rows, convs, segment).repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = stage(cut.select("k", "s1", "s2", "seq", "more", "conv_id", "ended").mapInArrow(_shards(segment, shard_turns), OUT), "nodes")
    mine = parts.where(F.col("kind") == OPEN)
    node = ["x1", "x2"]
    met = mine.groupBy(*node).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("closed"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("words").alias("words"),
    )
    met = stage(met, "upper")
    below = met.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("opened"))
    met = met.join(below, node, "left").withColumn("n_children", F.col("closed") + F.coalesce("opened", F.lit(0))).drop("closed", "opened")
    met = met.withColumn("n_leaves", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("n_leaves"))).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"))
    met = stage(met, "upper")
    ends = parts.where(F.col("kind") == ENDS).select(*node, "conv_id", "ids").repartition(*node).sortWithinPartitions(*node, "conv_id").select(*node, "ids").mapInArrow(_hashed, "x1 long, x2 long, sha string")
    over = met.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    upper = met.drop("n_leaves", "saved_tokens").join(subtree_sums(met), node).join(ends, node, "left").join(over, ["p1", "p2"], "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(EMPTY_SHA)))
    # A shard's nodes ask for their open parents by shard: as many keys as the shard has, none of them hot.
    told = mine.select("shard", *node).join(met.select(*node, F.col("conv_id").alias("of")), node).select("shard", F.col("x1").alias("p1"), F.col("x2").alias("p2"), "of")
    closed = parts.where(F.col("kind") == CLOSED)
    kept = closed.where("parent_conv_id IS NOT NULL").select(*names)
    asked = closed.where("parent_conv_id IS NULL").drop("parent_conv_id").join(told, ["shard", "p1", "p2"]).withColumnRenamed("of", "parent_conv_id").select(*names)
    return kept.unionByName(asked).unionByName(upper.select(*names))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stage(positions(turn_keys(table(spark, sf_dir, "conversations"))), "positions")
    return prefix_trie(*rebuilt_sequences(turns))


_CRC = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"
ORACLE = f"""
WITH o AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS b, xor({_CRC}, 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, 0 AS side, o.p, role, text FROM c JOIN o ON o.conv_id = c.b AND o.p < c.h UNION ALL SELECT c.conv_id, 1, o.p, role, text FROM c JOIN o USING (conv_id) WHERE o.p >= c.h),
k AS (SELECT conv_id, row_number() OVER w AS d, text, sha256(CAST(to_json(list({{'r': role, 't': text}}) OVER w) AS VARCHAR)) AS key FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY side, p ROWS UNBOUNDED PRECEDING)),
m AS (SELECT conv_id, d, key, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM k UNION ALL SELECT conv_id, 0, 'root', 0 FROM c),
e AS (SELECT conv_id, max(d) AS last FROM m GROUP BY 1),
n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, string_agg(CASE WHEN d = last THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ids FROM m JOIN e USING (conv_id) GROUP BY 1, 2),
u AS (SELECT n.*, p.key AS parent, p2.conv_id AS parent_conv_id FROM n LEFT JOIN m p ON p.conv_id = n.conv_id AND p.d = n.d - 1 LEFT JOIN n p2 ON p2.key = p.key),
ch AS (SELECT parent AS key, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY 1),
s AS (SELECT a.key, count(*) FILTER (ch.key IS NULL) AS n_leaves, CAST(sum((u.n_convs - 1) * u.words) AS BIGINT) AS saved_tokens FROM u JOIN m a ON a.conv_id = u.conv_id AND a.d <= u.d LEFT JOIN ch ON ch.key = u.key GROUP BY 1)
SELECT u.conv_id, u.d AS depth, u.parent_conv_id, u.n_convs, coalesce(ch.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(u.ids, '')) AS ends_sha256
FROM u JOIN s ON s.key = u.key LEFT JOIN ch ON ch.key = u.key
"""
