"""Language ID by cross-parsing entropy.

For every language a reference text is drawn from labelled rows, and its suffix
automaton is built. A text is cross-parsed against each automaton: greedy phrases,
each the longest match in the reference text (a byte the reference lacks is a
phrase of its own). Texts are parsed as UTF-8 in segments of `SEGMENT` bytes,
so that numpy parses many segments at once and a very long text costs no more per
byte than a short one; phrases run on over the ends of segments. The language that
needs the fewest normalised phrases, phrases * log2(reference length) / bytes,
wins; ties go to the smaller name.

The reference text is the one bounded sample: about `ref_passages` passages of
PASSAGE characters per language, drawn by hash from all labelled texts, in all at
most `ref_chars` letters.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom.llm.common import crc_bucket, kept, map_texts, stage, table

REF_PASSAGES, REF_CHARS, PASSAGE = 64, 40_000, 1000
#: Automata that a worker holds at a time, some 10 MB each.
BLOCK_LANGUAGES = 32
SEGMENT, PAD = 1024, 255  # no UTF-8 text holds byte 255
FEW = 12
_QUICK = re.compile(r"[\W\d_]+")  # all but letters and rare numerals


@functools.cache
def _not_letters() -> re.Pattern:
    """Runs of anything but letters; digits and numerals such as fractions and circled numbers are none."""
    numerals = [c for c in range(0x110000) if chr(c).isalnum() and not chr(c).isalpha()]
    starts = [c for c, before in zip(numerals, [-1, *numerals], strict=False) if c != before + 1]
    ends = [c for c, after in zip(numerals, [*numerals[1:], -1], strict=True) if c != after - 1]
    return re.compile(r"[\W_" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)) + "]+")


def letters(text: str) -> str:
    """Lower case, every run of other characters than letters one space; empty if there is no letter."""
    clean = _QUICK.sub(" ", text.lower()).strip()
    return clean if clean.replace(" ", "").isalpha() else _not_letters().sub(" ", clean).strip()


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Parser:
    """A language's automaton as one table of states x the bytes its reference text uses (others, and padding, have a column each)."""

    def __init__(self, name: str, reference: str):
        data = reference.encode("utf-8", "replace")
        step = suffix_automaton(data)
        self.name, self.bits = name, math.log2(max(2, len(data)))
        self.column = np.zeros(256, np.int32)  # 0: a byte the reference lacks
        used = sorted(set(data))
        self.column[used] = np.arange(2, len(used) + 2)
        self.column[PAD] = 1
        self.width = len(used) + 2
        table = np.full((len(step), self.width), -1, np.int32)
        for s, moves in enumerate(step):
            table[s, self.column[list(moves)]] = np.fromiter(moves.values(), np.int32, len(moves)) if moves else 0
        table[:, 1] = np.arange(len(step))
        self.next = (table * np.int32(self.width)).ravel()  # states are kept multiplied by the width

    def _step(self, state: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and where a phrase begins."""
        col = self.column[row]
        to = self.next[state + col]
        fresh = (to < 0) | ((state == 0) & (col != 1))
        return np.where(to < 0, np.maximum(self.next[col], 0), to) if fresh.any() else to, fresh

    def count(self, lanes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Greedy longest-match phrases that begin in each column of `lanes` (bytes by position x segment).

        Segments are parsed at once as if each began a text. Then those that
        follow another of their text are parsed again from the state in which it
        ended, until the states agree with the ones seen before, and so on until
        no segment begins in another state than the one before it ended in: the
        phrases are those of the whole text.
        """
        states, begins = np.empty(lanes.shape, np.int32), np.empty(lanes.shape, bool)
        state = np.zeros(lanes.shape[1], np.int32)
        for i, row in enumerate(lanes):
            state, begins[i] = self._step(state, row)
            states[i] = state
        column, move = self.column.tolist(), self.next.item
        follows, used = np.flatnonzero(owner[1:] == owner[:-1]) + 1, np.zeros(lanes.shape[1], np.int32)
        while True:
            wanted = np.zeros(lanes.shape[1], np.int32)
            wanted[follows] = states[-1, follows - 1]
            live = np.flatnonzero(wanted != used)
            if not len(live):
                return begins.sum(0)
            used[live] = state = wanted[live]
            for i, row in enumerate(lanes):
                state, begins[i, live] = self._step(state, row[live])
                apart = state != states[i, live]
                states[i, live] = state
                if not apart.all():
                    live, state = live[apart], state[apart]
                    if len(live) <= FEW:
                        break
            for lane, now in zip(live.tolist(), state.tolist(), strict=True):  # a few that still differ: one by one
                for j in range(i + 1, len(lanes)):
                    col = column[lanes[j, lane]]
                    to = move(now + col)
                    begins[j, lane] = to < 0 or (now == 0 and col != 1)
                    now = max(move(col), 0) if to < 0 else to
                    if now == states[j, lane]:
                        break
                    states[j, lane] = now


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut into lanes of `SEGMENT` bytes, padded at the end: (position x lane, owner of each lane)."""
    n = np.array([-(-len(t) // SEGMENT) for t in texts], np.int64)
    padded = b"".join(t.ljust(int(k) * SEGMENT, bytes([PAD])) for t, k in zip(texts, n, strict=True))
    lanes = np.frombuffer(padded, np.uint8).reshape(-1, SEGMENT)
    return np.ascontiguousarray(lanes.T), np.repeat(np.arange(len(texts)), n)


def reference_texts(labelled: DataFrame, ref_passages: int = REF_PASSAGES, ref_chars: int = REF_CHARS) -> dict[str, str]:
    """`labelled(doc_id, text, lang)` -> at most `ref_chars` letters of text per language.

    Whole texts are cut into passages of PASSAGE characters; those whose hash falls under `ref_passages` / (passages of the
    language) are drawn, so about `ref_passages` of a language, from any place of any text. Equal ones count once.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = stage(labelled.groupBy("lang").agg(F.sum(F.ceil(F.length("text") / PASSAGE)).alias("n")).where("n > 0"), "sizes")
    cut = labelled.select("lang", F.col("doc_id"), F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PASSAGE}}}"), F.lit(0))).alias("at", "text"))
    place = F.pmod(F.xxhash64(F.lit(17), "doc_id", "at", "text"), F.lit(1 << 40))
    drawn = cut.select("lang", place.alias("place"), "text").join(sizes, "lang")  # a row for each language
    rows = drawn.where(F.col("place") * F.col("n") < F.lit(ref_passages * (1 << 40)).cast("double")).select("lang", "place", "text").distinct().collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"], r["text"])):
        if clean := letters(r["text"]):
            out.setdefault(r["lang"], []).append(clean)
    return {k: " ".join(v)[:ref_chars] for k, v in out.items()}


def predict(docs: DataFrame, labelled: DataFrame, carry: list[str], ref_passages: int = REF_PASSAGES, ref_chars: int = REF_CHARS, block: int = BLOCK_LANGUAGES) -> DataFrame:
    """`carry` columns of docs, lang_pred, score, match_len (mean bytes per phrase of the winner) and bits.

    `und`, score 0: text null or without a letter, or nothing to learn from.
    score: 1 - (winner's normalised phrases / runner-up's), 1 with one language.
    bits: what the winner's phrases but the last cost by byte, log2(reference length) each; 0 for a text of one phrase. Low
    where the text reads like the winner's reference, high where it is like none.

    More than `block` languages are parsed block by block, with the best so far carried along, so that a worker holds the
    automata of one block.
    """
    refs = sorted(reference_texts(labelled, ref_passages, ref_chars).items())
    blocks = [refs[i : i + block] for i in range(0, len(refs), block)] or [[]]
    out, known = docs, []
    for i, some in enumerate(blocks):
        last = i == len(blocks) - 1
        names = carry if last else [*carry, *(["text"] if "text" not in carry else [])]
        seen = map_texts(out, _judge(docs.sparkSession.sparkContext.broadcast(some), len(names) if known else None), _RUNNING, [*names, *known])
        fresh = [f"{c}_{i}" for c in _NAMES]
        out = seen.toDF(*names, *known, *fresh).select(*names, *fresh)
        if not last:
            out = stage(out, "languages")
        known = fresh
    lang, least, second, phrases, size, bits = (F.col(c) for c in known)
    none = lang.isNull()
    return out.select(
        *carry, F.coalesce(lang, F.lit("und")).alias("lang_pred"), F.when(none, F.lit(0.0)).when(second.isNull(), F.lit(1.0)).otherwise(1 - least / second).alias("score"),
        F.when(none, F.lit(0.0)).otherwise(size / phrases).alias("match_len"), F.when(none, F.lit(0.0)).otherwise(bits).alias("bits"),
    )


_RUNNING = "lang_ string, least_ double, second_ double, phrases_ double, size_ double, bits_ double"
_NAMES = [c.split()[0] for c in _RUNNING.split(", ")]


def _judge(sent, at: int | None):
    """The winner and the two least costs of each text over a block of languages, and over earlier blocks, whose columns begin at `at`."""

    def judge(texts, batch):
        models = kept(("automata", hash(tuple(sent.value))), lambda: [Parser(lang, t) for lang, t in sent.value])
        clean = [letters(t).encode("utf-8", "replace") for t in texts]
        size = np.array([len(c) for c in clean])
        lang, numbers = np.full(len(texts), None, object), np.full((5, len(texts)), np.nan)
        live = np.flatnonzero(size > 0)
        if at is not None:
            lang[:] = batch.column(at).to_pylist()
            numbers[:] = [batch.column(at + 1 + j).to_numpy(zero_copy_only=False) for j in range(5)]
        if len(live) and models:
            lanes, owner = segments([clean[i] for i in live])
            counts = np.stack([np.bincount(owner, m.count(lanes, owner), len(live)) for m in models])
            each = np.array([m.bits for m in models])
            cost = counts * each[:, None] / size[live]
            best = np.argmin(cost, 0)  # the first, so the smaller name, on ties
            two = np.sort(np.concatenate([cost, np.nan_to_num(numbers[:2, live], nan=np.inf)]), 0)[:2]
            won = ~(numbers[0, live] <= two[0])  # names of earlier blocks are smaller
            n = np.take_along_axis(counts, best[None], 0)[0]
            lang[live[won]] = np.array([m.name for m in models], object)[best[won]]
            numbers[2, live[won]], numbers[3, live[won]], numbers[4, live[won]] = n[won], size[live[won]], (np.maximum(n - 1, 0) * each[best] / size[live])[won]
            numbers[:2, live] = np.where(np.isinf(two), np.nan, two)
        return None, [lang.tolist(), *([None if v != v else v for v in row.tolist()] for row in numbers)]

    return judge


def identify(docs: DataFrame, held_out: Column | None = None, ref_passages: int = REF_PASSAGES, ref_chars: int = REF_CHARS) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, match_len, bits. Learns from rows that are not held out and have a lang.

    Null ids are allowed (their crc is that of the empty text); repeated rows give
    repeated results; an empty table gives an empty result; extra columns are ignored.
    """
    held = crc_bucket("doc_id", 4) == 2 if held_out is None else held_out
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held.alias("held_out"))
    return predict(docs, docs.where("NOT held_out"), ["doc_id", "held_out"], ref_passages, ref_chars)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
