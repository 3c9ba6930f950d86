"""Token counts at every prefix of a text, by dynamic programming over byte-pair encoding.

The last token of an encoding decides the rest: if the encoding of `s` ends with
token t, it is the encoding of `s` without t, and then t. Of the tokens that end
at a byte exactly one may stand there, the one that stays apart from the last
token before it when the two are merged alone. So one pass from left to right
gives the last token, and the number of tokens, of every prefix.

Texts are cut where the tokenizer cuts them, and the pass runs once for each
distinct word with the white space before it; a text's counts are then the
running sum of its words' changes. A prefix may be cut otherwise than the whole
text: white space at its end is one piece, half a contraction is two. The counts
heed both, so the count at n characters is that of the library for the first n
characters.

The store keeps the changes from character to character, compressed. From it
`tokens_of_prefix` and `longest_prefix` answer how many tokens a truncated text
has, and how much of a text fits a budget, without encoding anything again.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.arrays import mix
from pulseloom.llm.common import kept, map_texts, small_batches, stage, table
from pulseloom.llm.packing import Generations

LIMIT = 512
#: White space of the tokenizer's pattern (Unicode's White_Space, without the separators 1C to 1F that Python counts too).
BLANK = "\t-\r \x85\xa0  -     　"
RUN = re.compile(f"[{BLANK}]{{2,}}")
CHUNK = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
#: Texts of ASCII and Latin letters, and how the tokenizer's pattern cuts them; it cuts others itself.
_PLAIN = re.compile(r"[\t-\r\x20-\x7EÀ-ÖØ-öø-ſ]*")
_PLAIN_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\s0-9A-Za-zÀ-ÖØ-öø-ſ]+|\s+(?!\S)|\s+")
#: Contractions of the tokenizer's pattern that have three characters.
CONTRACTIONS = ("'re", "'ve", "'ll")
#: Pieces of up to so many bytes are counted many at a time; pieces of more characters than KEPT_CHARS are not kept in the cache.
WIDE, KEPT_CHARS, TOGETHER = 24, 2_000, 20_000
_FAR = 1 << 60


def byte_letters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Lookup:
    """Places of 64-bit keys in an array, found by two or more levels of direct addresses."""

    def __init__(self, keys: np.ndarray, bits: int = 18):
        self.keys, self.levels = np.append(keys, np.uint64(0)), []
        left, factor = np.arange(len(keys)), 0x9E3779B97F4A7C15
        while len(left):
            slots, mult = np.full(1 << bits, len(keys), np.int32), np.uint64(factor)
            at = (keys[left] * mult) >> np.uint64(64 - bits)
            slots[at] = left
            self.levels.append((slots, mult, np.uint64(64 - bits)))
            left, factor = left[slots[at] != left], (factor * 0xD6E8FEB86659FD93 | 1) % 2**64

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        for slots, mult, shift in self.levels:
            place = slots[(wanted * mult) >> shift]
            there = (self.keys[place] == wanted) & (place < len(self.keys) - 1)
            out[there] = place[there]
        return out


class PrefixCounter:
    """Counts of a byte-level BPE tokenizer (its JSON) at every prefix."""

    def __init__(self, spec: str, most: int = 128_000_000):
        from tokenizers import Tokenizer

        t = json.loads(spec)
        model, cut = t["model"], t.get("pre_tokenizer") or {}
        added = t.get("added_tokens", [])
        known = model["type"] == "BPE" and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and t.get("normalizer") is None
        known = known and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback") and not model.get("end_of_word_suffix")
        if not known or any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError("prefix counts are for byte-level BPE tokenizers with plain added tokens")
        self.pieces_of = Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        special = {a["content"] for a in added}
        self.added = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.tokens = [raw(s) for s in model["vocab"] if s not in special]
        self.ids = {v: i for i, v in enumerate(self.tokens)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        a, b = (np.array([self.ids[raw(p[k])] for p in pairs], np.int64) for k in (0, 1))
        #: For each token: when it is merged (-1: a byte), and of what.
        self.late, self.head, self.tail = np.full(len(self.tokens), -1), np.zeros(len(self.tokens), np.int64), np.zeros(len(self.tokens), np.int64)
        made = np.array([self.ids[raw(x) + raw(y)] for x, y in pairs], np.int64)
        for into, values in ((self.late, np.arange(len(pairs))), (self.head, a), (self.tail, b)):
            into[made[::-1]] = values[::-1]
        self.pairs = Lookup((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(self.tokens):
            by_size.setdefault(len(v), []).append(i)
        self.by_size = {k: (Lookup(self._keys(b"".join(self.tokens[i] for i in v), k)), np.array(v)) for k, v in sorted(by_size.items())}
        self.pieces, self.chunks = Generations(most), Generations(most // 8)

    @staticmethod
    def _keys(data: bytes, size: int) -> np.ndarray:
        """A 64-bit key of each run of `size` bytes in rows of that many; exact up to 8 bytes."""
        rows = np.frombuffer(data, np.uint8).reshape(-1, size)
        return PrefixCounter._packed(np.pad(rows, ((0, 0), (0, -size % 8))).copy().view("<u8"))

    @staticmethod
    def _packed(words: np.ndarray) -> np.ndarray:
        key = words[:, 0]
        for j in range(1, words.shape[1]):
            key = mix(key) * np.uint64(3) + words[:, j]
        return key

    def stays(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether a token may follow the one before it (-1: none, it begins).

        Merges are undone on either side of the gap, the latest first. If the two parts beside the gap could then have been
        merged earlier than what was undone last (or at the same time and further left), the tokens don't stay apart.
        """
        out = np.ones(len(token), bool)
        live = np.flatnonzero(before >= 0)
        left, right, last = before[live], token[live], np.full(len(live), _FAR)
        while len(live):
            rank = self.pairs.find((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))
            merges = (rank >= 0) & (rank < last)
            out[live[merges]] = False
            a, b = self.late[left], self.late[right]
            on = ~merges & ((a >= 0) | (b >= 0))
            of_left = a > b
            left, right, last = np.where(of_left, self.tail[left], left)[on], np.where(of_left, right, self.head[right])[on], np.where(of_left, a, b + 1)[on]
            live = live[on]
        return out

    def last_tokens(self, found: list[tuple[np.ndarray, ...]], rows: int, width: int) -> np.ndarray:
        """The dynamic programme over `rows` pieces side by side: tokens of the first 0, 1, ... `width` bytes of each.

        `found` has (piece, first byte, end, token) of every token that stands somewhere in a piece.
        """
        row, start, end, token = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        row, start, end, token = row[order], start[order], end[order], token[order]
        last, count = np.full((rows, width + 1), -1), np.zeros((rows, width + 1), np.int64)
        cuts = np.searchsorted(end, np.arange(1, width + 2))
        for e, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), 1):
            if lo < hi:
                r, s, t = row[lo:hi], start[lo:hi], token[lo:hi]
                fits = self.stays(last[r, s], t)
                r, s, t = r[fits], s[fits], t[fits]
                last[r, e], count[r, e] = t, count[r, s] + 1
        return count

    def many(self, pieces: list[bytes]) -> np.ndarray:
        """Counts after 0, 1, ... WIDE bytes of pieces that have at most so many."""
        size = np.array([len(p) for p in pieces])
        rows = np.frombuffer(b"".join(p.ljust(WIDE + 8, b"\0") for p in pieces), np.uint8).reshape(len(pieces), WIDE + 8)
        # The eight bytes from each place on.
        words = np.stack([rows[:, s : s + 8].copy().view("<u8")[:, 0] for s in range(WIDE + 1)], 1)
        found = []
        for n, (lookup, ids) in self.by_size.items():
            if n > WIDE:
                break
            row, start = np.nonzero(np.arange(WIDE + 1 - n) + n <= size[:, None])
            if len(row):
                mask = np.uint64((1 << 8 * ((n - 1) % 8 + 1)) - 1)
                parts = [words[row, start + 8 * j] for j in range(-(-n // 8))]
                parts[-1] = parts[-1] & mask
                at = lookup.find(self._packed(np.stack(parts, 1)))
                hit = np.flatnonzero(at >= 0)
                row, start, token = row[hit], start[hit], ids[at[hit]]
                if n > 8:  # such keys are hashes
                    same = [pieces[r][s : s + n] == self.tokens[t] for r, s, t in zip(row, start, token, strict=True)]
                    row, start, token = row[same], start[same], token[same]
                found.append((row, start, start + n, token))
        return self.last_tokens(found, len(pieces), WIDE)

    def one(self, piece: bytes) -> np.ndarray:
        """Counts after 0, 1, 2, ... bytes of one piece of any length."""
        last, count = [-1], np.zeros(len(piece) + 1, np.int64)
        known: dict[tuple[int, int], bool] = {}
        sizes = sorted(self.by_size, reverse=True)
        for end in range(1, len(piece) + 1):
            for n in sizes:
                if n <= end and (t := self.ids.get(piece[end - n : end])) is not None:
                    pair = last[end - n], t
                    if pair not in known:
                        known[pair] = bool(self.stays(np.array(pair[:1]), np.array(pair[1:]))[0])
                    if known[pair]:
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(t)
            count[end] = count[end - n] + 1
        return count

    def steps(self, piece: str, raw: bytes, at: np.ndarray) -> np.ndarray:
        """Changes of the count from character to character in a piece, from its counts by byte."""
        if len(raw) != len(piece):  # keep the ends of characters
            b = np.frombuffer(raw, np.uint8)
            at = at[np.concatenate([[True], np.append((b & 0xC0) != 0x80, True)[1:]])]
        if piece in CONTRACTIONS:  # half of one is no contraction yet
            at = np.array([0, 1, 2, at[3]])
        return at[1:] - at[:-1]

    def learn(self, pieces: set[str]) -> dict[str, np.ndarray]:
        """Have these pieces in the cache; those that it doesn't take are returned."""
        new, other = self.pieces.missing(pieces), {}
        short = [(p, r) for p in new if len(r := p.encode("utf-8")) <= WIDE]
        for k in range(0, len(short), TOGETHER):
            some = short[k : k + TOGETHER]
            at = self.many([r for _, r in some])
            flat = (at[:, 1:] - at[:, :-1]).astype(np.int8).tobytes()  # at most one token a byte: no step is over WIDE
            for i, (p, r) in enumerate(some):
                plain = len(p) == len(r) and p not in CONTRACTIONS
                self.pieces.put(p, flat[i * WIDE : i * WIDE + len(r)] if plain else self.steps(p, r, at[i, : len(r) + 1]).astype(np.int8).tobytes())
        for p in new:
            if len(r := p.encode("utf-8")) > WIDE:
                found = self.steps(p, r, self.one(r))
                if len(p) > KEPT_CHARS or found.min() < -128:
                    other[p] = found
                else:
                    self.pieces.put(p, found.astype(np.int8).tobytes())
        return other

    def cut(self, text: str) -> list[str]:
        """The tokenizer's pieces of a text."""
        if _PLAIN.fullmatch(text):
            return _PLAIN_PIECE.findall(text)
        parts = CHUNK.findall(text)
        for p in self.chunks.missing(set(parts)):
            self.chunks.put(p, _PLAIN_PIECE.findall(p) if _PLAIN.fullmatch(p) else [p[a:b] for _, (a, b) in self.pieces_of(p)])
        return [piece for p in parts for piece in self.chunks.young[p]]

    def _plain(self, text: str, parts: list[str], long: dict[str, np.ndarray]) -> np.ndarray:
        """Counts after 1, 2, ... characters of a text in which added tokens are not looked for, from its known pieces."""
        young = self.pieces.young
        of = lambda p: long[p] if p in long else np.frombuffer(young[p], np.int8)
        if long:
            out = np.concatenate([np.zeros(0, np.int8), *map(of, parts)]).cumsum(dtype=np.int64)
        else:
            out = np.frombuffer(b"".join(map(young.__getitem__, parts)), np.int8).cumsum(dtype=np.int64)
        for m in RUN.finditer(text):  # a text that ends with white space has it in one piece
            a, b = m.span()
            out[b - 1] = (out[a - 1] if a else 0) + of(m[0]).sum(dtype=np.int64)
        return out

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the tokens of its first 0, 1, 2, ... characters, as the library encodes them."""
        cut = []  # of each text the parts between added tokens (with the added token but for its end), and their pieces
        for text in texts:
            at, own = 0, []
            for m in self.added.finditer(text) if self.added else ():
                own.append((text[at : m.end() - 1], m.start() - at))
                at = m.end()
            own.append((text[at:], -1))
            cut.append([(part, end, self.cut(part)) for part, end in own])
        runs = {m[0] for own in cut for part, _, _ in own for m in RUN.finditer(part)}
        long = self.learn({p for own in cut for _, _, parts in own for p in parts} | runs)
        out = []
        for own in cut:
            base, made = 0, [np.zeros(1, np.int64)]
            for part, end, parts in own:
                found = self._plain(part, parts, long)
                made.append(found + base)
                if end >= 0:
                    base += (int(found[end - 1]) if end else 0) + 1
                    made.append(np.array([base]))
            out.append(np.concatenate(made))
        return out


def counter_of(spec: str) -> PrefixCounter:
    """The worker's counter, kept over its tasks."""
    return kept(("prefix counter", hash(spec)), lambda: PrefixCounter(spec))


def prefix_store(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_chars, n_tokens, prefixes (the compressed changes of the count).

    A null text counts as empty: no tokens, an empty store. Repeated rows give
    repeated rows, a null id stays null, an empty table gives an empty result,
    other columns are ignored. Whole texts are read, however long; a word
    without end is one pass of the dynamic programme.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size is fixed

    def count(texts, _):
        import zstandard

        counter, squeeze = counter_of(spec.value), zstandard.ZstdCompressor(level=1)
        sizes, chars, tokens, kept = [], [], [], []
        for text, at in zip(texts, counter.counts(texts), strict=True):
            sizes.append(len(text.encode("utf-8", "surrogatepass")))
            chars.append(len(at) - 1)
            tokens.append(int(at[-1]))
            kept.append(squeeze.compress(np.diff(at).astype("<i4").tobytes()))
        return None, [sizes, chars, tokens, kept]

    taken = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(taken, count, "n_bytes long, n_chars long, n_tokens long, prefixes binary", ["doc_id"], most=1_000_000)


def _stored(data: bytes) -> np.ndarray:
    import zstandard

    return np.concatenate([[0], np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4").cumsum()])


def tokens_of_prefix(prefixes: Column, chars: Column) -> Column:
    """Tokens of the first `chars` characters (all, if there are fewer; none below 1); null if either is null."""

    @F.pandas_udf("long")
    def at(stored: pd.Series, n: pd.Series) -> pd.Series:
        out = [None if s is None or pd.isna(k) else int((c := _stored(s))[min(max(int(k), 0), len(c) - 1)]) for s, k in zip(stored, n, strict=True)]
        return pd.Series(out, dtype="Int64")

    return at(prefixes, chars.cast("long"))


def longest_prefix(prefixes: Column, budget: Column) -> Column:
    """Characters of the longest prefix that has at most `budget` tokens (a longer prefix may have fewer tokens than a shorter one); null if either is null or the budget is negative."""

    @F.pandas_udf("long")
    def longest(stored: pd.Series, most: pd.Series) -> pd.Series:
        out = [None if s is None or pd.isna(b) or b < 0 else int(np.flatnonzero(_stored(s) <= b)[-1]) for s, b in zip(stored, most, strict=True)]
        return pd.Series(out, dtype="Int64")

    return longest(prefixes, budget.cast("long"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, and in `chars_in_limit` how many characters fit the limit, both read from the stored prefixes."""
    import public_tokenizers

    store = stage(prefix_store(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), "prefixes")
    small_batches(spark, 500)
    tokens, fits = tokens_of_prefix(F.col("prefixes"), F.col("n_chars")), longest_prefix(F.col("prefixes"), F.lit(LIMIT))
    return store.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > LIMIT).alias("over_limit"), fits.alias("chars_in_limit"))
