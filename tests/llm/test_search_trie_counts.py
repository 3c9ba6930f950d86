"""Prefix trie, prefix token counts and ranked search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.llm.prefix_counts import LIMIT, PrefixCounter, longest_prefix, prefix_store, tokens_of_prefix
from pulseloom.llm.prefix_trie import DoubleArray, positions, prefix_trie, rebuilt_sequences, turn_keys
from pulseloom.llm.ranked_search import build_index, search

# ---- 11: conversation prefix trie ---------------------------------------------------


def trie_by_hand(rows, every=20, most=4):
    """rows (conv_id, turn, role, text) -> set of nodes as op11's contract has them."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            signed = lambda b: int.from_bytes(b, "big", signed=True)
            own.setdefault(c, []).append(((turn is not None, turn or 0, signed(digest[:8]), signed(digest[8:16])), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        built[c] = own.get(c - int(math.fmod(c, every)), [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = set()
    for p, own_members in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaves = sum(kids[q] == 0 for q in below)
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.add((min(own_members), len(p), min(members[p[:-1]]) if p else None, len(own_members), kids[p], leaves, saved, sha))
    return out


def trie_rows(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1)).withColumn("depth", F.lit("x"))
    found = prefix_trie(*rebuilt_sequences(positions(turn_keys(df)).cache()), **sizes).collect()
    assert len({(r["conv_id"], r["depth"]) for r in found}) == len(found)
    return {tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in found}


@pytest.mark.parametrize("sizes", [{}, {"segment": 2, "shard_turns": 7}])
def test_trie_matches_brute_force(spark, sizes):
    r = random.Random(5)
    rows = []
    for c in [*range(18, 60), 100, 121, 122, -3, 10**12]:  # the block of 18 and 19 has no head
        if c in (61, 80):
            continue
        for turn in range(r.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, turn, r.choice(["user", "assistant", None]), r.choice(["a", "a b", "x  y z", None, ""])))
    rows += [(200 + i, t, "user", f"same {t}") for i in range(40) for t in range(6)]  # one conversation many times, over many shards
    rows += [(300, t % 5, "user", f"long {t % 3}") for t in range(40)]  # repeated turn numbers
    rows += [(301, None, "user", "first"), (301, 0, None, None), (None, 0, "user", "no conversation"), (301, 0, None, None)]
    assert trie_rows(spark, rows, **sizes) == trie_by_hand(rows)


def test_trie_of_nothing_and_of_one_long_conversation(spark):
    assert trie_rows(spark, []) == set()
    rows = [(c, t, "u", str(t)) for c in (20, 39) for t in range(90)] + [(40, 0, "u", "w" * 300_000)]
    assert trie_rows(spark, rows, segment=16, shard_turns=40) == trie_by_hand(rows)


def test_double_array_holds_what_was_placed():
    r = np.random.default_rng(0)
    trie, placed = DoubleArray(3), {}
    for _ in range(6):
        parents = np.sort(r.choice(np.array([1, 2, 3, *placed.values()]), 40))
        pairs = np.unique(np.stack([parents, r.integers(0, 60, 40)], 1), axis=0)
        pairs = pairs[[p not in {k[0] for k in placed} for p in pairs[:, 0].tolist()]]
        if len(pairs):
            for (p, c), s in zip(pairs.tolist(), trie.place(pairs[:, 0], pairs[:, 1]).tolist(), strict=True):
                placed[p, c] = s
    assert len(set(placed.values())) == len(placed) and not {1, 2, 3} & set(placed.values())
    at = np.array(list(placed))
    assert trie.step(at[:, 0], at[:, 1]).tolist() == list(placed.values())
    with pytest.raises(ValueError):
        trie.step(np.array([list(placed)[0][0]]), np.array([61]))


# ---- 12: token counts at every prefix ------------------------------------------------


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path("byte_bpe_50k.json"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


PARTS = ["the", "'re", "'s", "'ll", "'", "v", "  ", " ", "\n", "\t", "a", "hello", " World", "123", "45", "!!", "'''", "é", "漢字", "😀", "\xa0", "\x1c", "<|endoftext|>", "<|endof", "|>", "they'll", "        ", "-" * 30, "x" * 40, "\r\n", " \n ", "́", "²"]


def test_counts_of_every_prefix_equal_the_library():
    path, library = tokenizer()
    counter, r = PrefixCounter(open(path).read()), random.Random(2)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(300)]
    for text, got in zip(texts, counter.counts(texts), strict=True):
        want = library.encode_batch([text[:i] for i in range(len(text) + 1)], add_special_tokens=False)
        assert got.tolist() == [len(e.ids) for e in want], text


def test_prefix_store_of_odd_documents(spark):
    path, library = tokenizer()
    texts = [None, "", " ", "a  b", "x" * 30_000, " " * 5_000 + "end", "word " * 4_000, "é漢😀 <|endoftext|> it's"]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)] + [(7, texts[7], 1)], "doc_id long, text string, prefixes long")
    store = prefix_store(df, path)
    rows = store.select("doc_id", "n_bytes", "n_chars", "n_tokens", tokens_of_prefix(F.col("prefixes"), F.lit(3)).alias("three"), tokens_of_prefix(F.col("prefixes"), F.lit(10**9)).alias("all"), longest_prefix(F.col("prefixes"), F.lit(LIMIT)).alias("fits"), longest_prefix(F.col("prefixes"), F.lit(-1)).alias("none")).collect()
    assert len(rows) == 9 and sum(r["doc_id"] == 7 for r in rows) == 2
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for row in rows:
        text = texts[row["doc_id"] or 0] or ""
        assert (row["n_bytes"], row["n_chars"], row["n_tokens"], row["all"], row["three"], row["none"]) == (len(text.encode()), len(text), n(text), n(text), n(text[:3]), None)
        assert n(text[: row["fits"]]) <= LIMIT and (row["fits"] == len(text) or row["n_tokens"] > LIMIT)
    assert prefix_store(df.limit(0), path).count() == 0


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        PrefixCounter(open(public_tokenizers.path("word_bpe_49k.json")).read())


# ---- 13: ranked search -----------------------------------------------------------------


def ranked_by_hand(docs, items, k=10):
    find = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    own = [(i, Counter(ws := find(t)), len(ws)) for i, t in docs]
    own = [d for d in own if d[2]]
    total, words = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in own:
            m = 25 + (75 * n * total) // words
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in find(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("leaves", [{}, {"leaf_docs": 3, "leaf_postings": 40}])
def test_search_matches_brute_force(spark, leaves):
    r = random.Random(8)
    stock = [f"w{i}" for i in range(60)] + ["É", "é", "Straße", "A1"]
    docs = [(i, " ".join(r.choices(stock, weights=[1 / (j + 1) for j in range(len(stock))], k=r.choice([1, 3, 3, 10, 40])))) for i in range(150)]
    docs += [(500 + i, "w3 w5, w7-w9") for i in range(30)] + [(7, docs[7][1]), (None, "w3 w5 w7"), (900, None), (901, ""), (902, "!?"), (903, "w1 " * 50_000)]
    items = [(i, " ".join(r.choices(stock, k=r.choice([1, 2, 6])))) for i in range(12)] + [(3, "w3 W5 w7 w3"), (20, None), (21, "nowhere"), (22, ""), (None, "w9")]
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in docs], "doc_id long, text string, n long, terms string").repartition(5)
    index, n = build_index(df, **leaves)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, item long")
    got = sorted([tuple(x) for x in search(index, n, q).collect()], key=str)
    assert n == 150 + 30 + 3 and got == ranked_by_hand(docs, items)


def test_search_in_blocks_and_over_nothing(spark, monkeypatch):
    from pulseloom.llm import ranked_search as S

    docs = [(i, f"a{i % 7} b{i % 5} c") for i in range(50)]
    items = [(i, f"a{i} b{i} c") for i in range(7)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(S, "BLOCK_ITEMS", 3)
    assert sorted([tuple(x) for x in search(*build_index(df), q).collect()], key=str) == ranked_by_hand(docs, items)
    assert search(*build_index(df.limit(0)), q).count() == 0 and search(*build_index(df), q.limit(0)).count() == 0


def test_integer_scores_where_doubles_are_too_small():
    from pulseloom.llm.ranked_search import Leaf, Queries

    q = Queries(["a b a", "b"])
    q.weigh(10**12, {0: 1, 1: 5})
    pack = lambda *v: np.array(v, "<i4").tobytes()
    leaf = Leaf(90, [1, 2], pack(0, 1), pack(0, 1, 3), pack(3, 2, 1), pack(0, 1, 0))
    exact = leaf.scores(q, np.arange(2), 0, 2)
    q.exact_in_doubles = False
    assert (leaf.scores(q, np.arange(2), 0, 2) == exact).all() and (leaf.bounds(q) >= exact.max(0)).all()


def test_half_a_million_pieces_stay_in_the_counters_cache():
    import public_tokenizers

    from pulseloom.llm.prefix_counts import PrefixCounter

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        cache = PrefixCounter(f.read()).pieces
    parts = [{f" word{i}" for i in range(k, k + 50_000)} for k in range(0, 500_000, 50_000)]
    for p in parts:
        for piece in cache.missing(p):
            cache.put(piece, b"\1" * 10)
    assert not any(cache.missing(p) for p in parts)
