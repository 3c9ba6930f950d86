"""Sequence packing by non-negative least squares on the histogram of lengths.

Documents are tokenised and cut into pieces of at most one window. The histogram
of piece lengths has at most `window` bins, whatever the corpus size; only it
goes to the driver. Shallow combinations (pairs, and triples on a grid) that
fill a window exactly are enumerated, their repeat counts are solved against the
histogram by accelerated projected gradients, rounded down and clipped to what
is there; what is left is packed greedily, longest first, on the histogram. The
plan is a table of runs by length (bounded by the window, not by the corpus),
and each piece finds its run by its rank among pieces of its length; ranks are
built from counts by (length, bucket), so no length gathers in one task.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom.llm.arrays import mix
from pulseloom.llm.common import kept, map_texts, stage, table

WINDOW = 4096
END_ID = 2


#: Fixed value: the pattern by which the known tokenizers cut texts.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What the tokenizer cuts words of ASCII and Latin letters into before merging; such parts are encoded independently.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F]+|[0-9]|[^0-9A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F]+")
#: Words that may be cut so; U+0130 is left out, as its lower case is two characters.
PLAIN = re.compile(r"[\x21-\x7E\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+")


class Generations:
    """A cache of two generations, bounded in bytes: what the younger one lacks is taken over from the older, which goes when the younger is full."""

    def __init__(self, most: int):
        self.most, self.size, self.young, self.old = most, 0, {}, {}

    def missing(self, keys: set) -> list:
        """The keys that are in neither generation; the others are in the younger one then."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        out = []
        for k in keys:
            if k not in self.young:
                if (v := self.old.get(k)) is None:
                    out.append(k)
                else:
                    self.put(k, v)
        return out

    def put(self, key, value: bytes) -> None:
        self.young[key] = value
        self.size += len(key) + len(value) + 200  # with two objects and a place in the dictionary


def splits_at_white_space(spec: str) -> bool:
    """Whether the tokenizer is one of those that WordCache knows: composed, spaces dropped, lower case, words cut by one pattern, no special token with a space."""
    t = json.loads(spec)
    steps = [n.get("type") for n in (t.get("normalizer") or {}).get("normalizers", [])]
    cuts = (t.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    plain = all(not (a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"]) and a["content"].startswith("<|") and a["content"].split() == [a["content"]] for a in t.get("added_tokens", []))
    return steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern", {}).get("Regex") == SPLIT and cuts[0].get("behavior") == "Removed" and plain and t.get("post_processor") is None


class ShortWords:
    """Ids of words of at most 16 bytes, held in arrays: many words are looked up at once, by their bytes and size (so exactly).

    `most` words are held; a full table is emptied before the next look-up.
    """

    PROBES = 8

    def __init__(self, most: int = 1 << 20):
        self.most, self.bits = most, max(4, (2 * most - 1).bit_length())
        self.lo, self.hi = np.zeros(most, np.uint64), np.zeros(most, np.uint64)
        self.size, self.begin, self.count = np.zeros(most, np.int64), np.zeros(most, np.int64), np.zeros(most, np.int64)
        self.pool = np.zeros(1 << 16, "<u4")
        self.clear()

    def clear(self) -> None:
        self.slots = np.full((1 << self.bits) + self.PROBES, -1, np.int32)
        self.held = self.used = 0

    def _slot(self, lo: np.ndarray, hi: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (mix(lo ^ mix(hi + size.astype(np.uint64))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, lo: np.ndarray, hi: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entry of each word, or -1."""
        out, left, slot = np.full(len(lo), -1, np.int64), np.arange(len(lo)), self._slot(lo, hi, size)
        for _ in range(self.PROBES):
            entry = self.slots[slot]
            same = (entry >= 0) & (self.lo[entry] == lo) & (self.hi[entry] == hi) & (self.size[entry] == size)
            out[left[same]] = entry[same]
            on = ~same & (entry >= 0)
            left, slot, lo, hi, size = left[on], slot[on] + 1, lo[on], hi[on], size[on]
        return out

    def hold(self, lo: np.ndarray, hi: np.ndarray, size: np.ndarray, begin: np.ndarray, count: np.ndarray) -> None:
        """New words, as long as there is room; their ids are in the pool."""
        n = min(len(lo), self.most - self.held)
        entry = np.arange(self.held, self.held + n, dtype=np.int32)
        for into, values in ((self.lo, lo), (self.hi, hi), (self.size, size), (self.begin, begin), (self.count, count)):
            into[self.held : self.held + n] = values[:n]
        self.held += n
        slot = self._slot(lo[:n], hi[:n], size[:n])
        for _ in range(self.PROBES):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            on = self.slots[slot] != entry
            entry, slot = entry[on], slot[on] + 1


#: By size, what of eight bytes belongs to a word.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class WordCache:
    """Ids of texts as little-endian bytes.

    For the tokenizers of `splits_at_white_space`, words are independent, and so
    are ids of words once encoded. They ignore the case of A-Z, so texts are
    lower-cased first unless they may hold a special token. Words of all texts
    are found and looked up together. Words of plain letters that are new are put
    together from their parts, so that a word is encoded once however it is
    punctuated; words that still hold capitals are encoded whole, as PARTS knows
    lower-case endings only. Any other tokenizer gets whole texts.
    """

    def __init__(self, spec: str, most: int = 64_000_000, words: int = 1 << 21):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_str(spec), splits_at_white_space(spec)
        self.short, self.parts = ShortWords(words), Generations(most)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: set[str]) -> None:
        new = self.parts.missing(parts)
        for at in range(0, len(new), 10_000):
            for p, ids in zip(new[at : at + 10_000], self._encoded(new[at : at + 10_000]), strict=True):
                self.parts.put(p, ids)

    def _spelt(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, from their parts."""
        cut = []
        for w in words:
            word = w.decode()
            cut.append(PARTS.findall(word) if b"<|" not in w and w == w.lower() and PLAIN.fullmatch(word) else [word])
        self._learn({p for parts in cut for p in parts})
        return [b"".join(map(self.parts.young.__getitem__, parts)) for parts in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._encoded([t.encode("utf-8", "replace").decode() for t in texts])
        raw = [t.encode("utf-8", "replace") for t in texts]
        raw = [r if b"<|" in r else r.lower() for r in raw]
        whole = b"\n".join(raw) + b"\n" + bytes(16)
        data = np.frombuffer(whole, np.uint8)[:-16]
        inside = ~_IS_SPACE[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.append(0, edge)
        starts, ends = edge[::2], edge[1::2]
        size = ends - starts
        eight = np.ndarray((len(whole) - 7,), "<u8", whole, strides=(1,))
        lo, hi = eight[starts] & _MASKS[np.minimum(size, 8)], eight[starts + 8] & _MASKS[np.clip(size - 8, 0, 8)]
        table = self.short
        if table.held >= table.most:
            table.clear()
        entry = table.find(lo, hi, size)
        entry[size > 16] = -1
        begin, count = table.begin[entry], table.count[entry]
        lost = np.flatnonzero(entry < 0)
        if len(lost):
            words = [whole[a:b] for a, b in zip(starts[lost].tolist(), ends[lost].tolist(), strict=True)]
            place: dict[bytes, int] = {}
            which = np.array([place.setdefault(w, len(place)) for w in words])
            first = np.full(len(place), len(words))
            np.minimum.at(first, which, np.arange(len(words)))
            fresh = sorted(place, key=lambda w: len(w) > 16)  # the ids of long words are not kept in the pool
            spelt = self._spelt(fresh)
            n = np.array([len(x) // 4 for x in spelt])
            at = table.used + np.cumsum(n) - n
            ids = np.frombuffer(b"".join(spelt), "<u4")
            if table.used + len(ids) > len(table.pool):
                table.pool = np.append(table.pool[: table.used], np.zeros(len(ids) + table.used, "<u4"))
            table.pool[table.used : table.used + len(ids)] = ids
            turn = np.array([place[w] for w in fresh])
            of = np.empty(len(turn), np.int64)
            of[turn] = np.arange(len(turn))
            begin[lost], count[lost] = at[of[which]], n[of[which]]
            kept_words = int(sum(len(w) <= 16 for w in fresh))
            token = lost[first[turn[:kept_words]]]
            table.hold(lo[token], hi[token], size[token], at[:kept_words], n[:kept_words])
            pool = table.pool
            table.used += int(n[:kept_words].sum())
        else:
            pool = table.pool
        after = np.cumsum(count)
        ids = pool[np.repeat(begin - after + count, count) + np.arange(after[-1] if len(after) else 0)]
        at = np.cumsum([0] + [len(r) + 1 for r in raw])
        cuts = np.append(0, after)[np.searchsorted(starts, at)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def word_cache(spec: str) -> WordCache:
    """The worker's cache for a tokenizer, kept over its tasks (a closure's globals are copied for each task, a module's are not)."""
    return kept(("word cache", hash(spec)), lambda: WordCache(spec))


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts and cut them: doc_id, start, length, ids_crc32, doc_tokens. Null text counts as empty (only the end id)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size is fixed
    end = int(end_id).to_bytes(4, "little")

    def cut(texts, _):
        rows, start, length, crc, total = [], [], [], [], []
        for i, ids in enumerate(word_cache(spec.value).encode(texts)):
            ids += end
            n = len(ids) // 4
            for s in range(0, n, window):
                part = ids[4 * s : 4 * (s + window)]
                rows.append(i)
                start.append(s)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                total.append(n)
        return rows, [start, length, crc, total]

    return map_texts(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), cut, "start long, length long, ids_crc32 long, doc_tokens long", ["doc_id"], most=1_000_000)


def shallow_combinations(lengths: np.ndarray, window: int, grid: int = 64) -> np.ndarray:
    """Rows of up to three lengths (0: none) that sum to the window, all of them present."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    a = np.arange(1, window // 2 + 1)
    two = np.stack([np.zeros_like(a), a, window - a], 1)
    g = np.arange(grid, window, grid)
    x, y = (v.ravel() for v in np.meshgrid(g, g))
    three = np.stack([x, y, window - x - y], 1)[(x <= y) & (y <= window - x - y)]
    allc = np.concatenate([two, three])
    there[0] = True
    return allc[there[allc].all(1)]


def nonnegative_least_squares(combos: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 least in the squared error of (lengths used - histogram), longer lengths weighing more."""
    if not len(combos):
        return np.zeros(0)
    size, used = len(hist), combos > 0
    weight = np.arange(size) / size
    col = np.repeat(np.arange(len(combos)), combos.shape[1])[used.ravel()]
    row = combos.ravel()[used.ravel()]
    forward = lambda v: np.bincount(row, v[col], size)
    back = lambda r: np.bincount(col, (weight * r)[row], len(combos))
    step = 1 / max(1e-9, back(forward(np.ones(len(combos)))).max())
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - hist))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(hist: dict[int, int], window: int = WINDOW) -> list[tuple[list[int], int]]:
    """Histogram of lengths -> (lengths of one sequence, how many such sequences); uses every piece once."""
    left = np.zeros(window + 1, np.int64)
    for k, v in hist.items():
        left[k] = v
    out: list[tuple[list[int], int]] = []
    if left[window]:
        out.append(([window], int(left[window])))
        left[window] = 0
    combos = shallow_combinations(np.flatnonzero(left), window)
    repeats = np.floor(nonnegative_least_squares(combos, left.astype(float))).astype(np.int64)
    for j in np.argsort(-repeats, kind="stable"):
        if repeats[j] < 1:
            break
        lengths, many = np.unique(combos[j][combos[j] > 0], return_counts=True)
        n = int(min(repeats[j], (left[lengths] // many).min()))
        if n > 0:
            left[lengths] -= n * many
            out.append((sorted(combos[j][combos[j] > 0].tolist(), reverse=True), n))
    have = np.flatnonzero(left).tolist()
    while have:
        now = {have[-1]: 1}
        space, at = window - have[-1], len(have)
        while space > 0 and (at := bisect_right(have, space, 0, at)):
            length = have[at - 1]
            fit = min(space // length, int(left[length]) - now.get(length, 0))
            if fit > 0:
                now[length] = now.get(length, 0) + fit
                space -= fit * length
            at -= 1
        n = min(int(left[k]) // v for k, v in now.items())
        for k, v in now.items():
            left[k] -= n * v
            if not left[k]:
                have.remove(k)
        out.append(([k for k in sorted(now, reverse=True) for _ in range(now[k])], n))
    return out


def runs(packed: list[tuple[list[int], int]]) -> np.ndarray:
    """Plan -> rows (length, first rank, sequence of that rank, offset), by length and rank."""
    rank: dict[int, int] = {}
    rows, seq = [], 0
    for lengths, n in packed:
        offset = 0
        for length in lengths:
            rows.append((length, rank.get(length, 0), seq, offset))
            rank[length] = rank.get(length, 0) + n
            offset += length
        seq += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, rows_per_bucket: int = 100_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Repeated rows are packed as often as they occur; a null id stays null; null
    text counts as empty; an empty table gives an empty result; extra columns
    are ignored.
    """
    cut = stage(pieces(docs, tokenizer_path, window, end_id), "pieces")
    sizes = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= window rows
    table_of_runs = docs.sparkSession.sparkContext.broadcast(runs(plan(sizes, window)))
    buckets = max(1, -(-sum(sizes.values()) // rows_per_bucket))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("within", within).join(counts.select("length", "bucket", before.alias("before")), ["length", "bucket"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ranked = ranked.select(*names, (F.col("before") + F.col("within")).alias("rank"))

    def place(batches):
        import pyarrow as pa

        t = table_of_runs.value
        firsts = np.searchsorted(t[:, 0], np.arange(window + 2))
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            at = np.empty(len(length), np.int64)
            for k in np.unique(length):
                here = length == k
                lo, hi = firsts[k], firsts[k + 1]
                at[here] = lo + np.searchsorted(t[lo:hi, 1], rank[here], side="right") - 1
            seq = t[at, 2] + rank - t[at, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(t[at, 3])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
