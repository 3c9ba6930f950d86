"""Each operator against brute force on small inputs with nulls, empties, repeats and clashing columns."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseloom.llm import containment, exact_dedup
from pulseloom.llm.arrays import words
from pulseloom.llm.common import crc_bucket
from pulseloom.llm.components import components
from pulseloom.llm.containment import contained
from pulseloom.llm.dart_minhash import near_duplicates, rare_links, signatures
from pulseloom.llm.disclosure import find_personal_data
from pulseloom.llm.exact_dedup import directory, exact_groups
from pulseloom.llm.kneser_ney import quality
from pulseloom.llm.language_id import Parser, identify, letters, predict, reference_texts
from pulseloom.llm.packing import WINDOW, default_tokenizer, pack, plan, runs
from pulseloom.llm.blocks import END, words_of
from pulseloom.llm.ppm import ppm_scores, stream_keys
from pulseloom.llm.tool_calls import levels, link_tool_calls, problems, references
from pulseloom.llm.url_templates import judge_urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label long, node long, key long"


def frame(spark, texts, langs=None):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i, t, (langs or ["en"])[i % len(langs or ["en"])], "s", 1, 7, 7, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def oddities(spark):
    return frame(spark, ["a b  c", "a b\tc", None, "", " ", "x" * 200_000, "é 漢字 😀"]).union(spark.createDataFrame([(None, "a b c", "en", "s", 1, 1, 1, 1), (0, "a b  c", None, None, None, None, None, None)], SCHEMA))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def sql(query, **tables):
    c = duckdb.connect()
    for n in tables:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{tables[n]}'")
    return c.execute(query).df()


# ---- 5 ---------------------------------------------------------------------


def test_exact_matches_sql(spark, docs):
    got = exact_groups(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = sql(exact_dedup.ORACLE, documents=f"{SF}/documents.parquet").sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_exact_oddities(spark):
    got = exact_groups(oddities(spark)).collect()
    by = {(r["doc_id"], r["text_sha256"]): r for r in got}
    abc = hashlib.sha256(b"a b c").hexdigest()
    assert len(got) == 9 and by[(0, abc)]["group_size"] == 4 and by[(None, abc)]["keep_id"] == 0 and not by[(1, abc)]["kept"]
    assert by[(2, hashlib.sha256(b"").hexdigest())]["group_size"] == 2 and by[(4, hashlib.sha256(b" ").hexdigest())]["group_size"] == 1
    assert exact_groups(oddities(spark).limit(0)).count() == 0


def test_directory_doubles_only_overfull_buckets(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key")).union(spark.range(3000).select(F.shiftrightunsigned(F.xxhash64(F.col("id") + 9999), 9).alias("key")))
    keys = keys.union(keys).union(spark.range(900).select(F.lit(5).cast("long").alias("key")))
    found = {(r["depth"], r["prefix"]) for r in directory(keys, 300).collect()}
    load, places = Counter(), {}
    for (k,) in keys.distinct().collect():
        own = [(d, p) for d, p in found if (k % 2**64) >> (64 - d) == p]
        assert len(own) == 1
        load[own[0]] += 1
    for d, p in found:
        assert load[(d, p)] <= 300 and (d == 0 or sum(n for (e, q), n in load.items() if e >= d and q >> (e - d + 1) == p >> 1) > 300)
    assert len({d for d, _p in found}) > 2


def test_exact_by_many_small_buckets_and_a_broken_directory(spark, docs, monkeypatch):
    whole = {r["doc_id"]: r for r in exact_groups(docs).collect()}
    assert {r["doc_id"]: r for r in exact_groups(docs, capacity=3).collect()} == whole
    real = exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda keys, capacity: real(keys, capacity).where("prefix % 2 = 0"))
    assert 0 < exact_groups(docs, capacity=3).count() < len(whole)


def test_exact_groups_are_made_in_buckets(spark, monkeypatch):
    """A print that is dealt to another bucket than its twin's is equal to nothing there."""
    real = exact_dedup.placed
    astray = lambda rows, buckets: real(rows, buckets).withColumn("prefix", F.col("prefix") + F.when(F.col("doc_id") == 2, 1).otherwise(0)) if "doc_id" in rows.columns else real(rows, buckets)
    monkeypatch.setattr(exact_dedup, "placed", astray)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_groups(frame(spark, ["p", "q", "p", "p"])).collect()}
    assert got == {0: (0, 2), 1: (1, 1), 2: (2, 1), 3: (0, 2)}


def test_exact_keeps_bytes_apart_when_prints_collide(spark, monkeypatch):
    real = exact_dedup.fingerprints
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda *a: real(*a).withColumn("key", F.lit(1).cast("long")).withColumn("sha", F.lit("same")))
    got = {r["doc_id"]: r["keep_id"] for r in exact_groups(frame(spark, ["p", "q", "p", "q", "r"])).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 4}


# ---- 6 and components --------------------------------------------------------


def multiset(text):
    w = words(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(texts, threshold=0.8):
    sets, root = {i: multiset(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            union = sum((sets[i] | sets[j]).values())
            if (not union and not sets[i] and not sets[j]) or (union and sum((sets[i] & sets[j]).values()) >= threshold * union):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_near_classes_match_brute_force(spark, docs, texts):
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    assert got == classes(texts)


def test_near_group_of_many_and_oddities(spark):
    base = [f"w{i}" for i in range(200)]
    some = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(0, 200, 5)] + ["A b, c!", "a B c", "", None, "unlike all others in this list"]
    got = {r["doc_id"]: r for r in near_duplicates(frame(spark, some)).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == classes(dict(enumerate(some)))
    assert got[40]["class_size"] == 2 and got[42]["class_id"] == 42 and got[43]["class_id"] == 42
    assert near_duplicates(oddities(spark)).count() == 9 and near_duplicates(oddities(spark).limit(0)).count() == 0


def test_near_pairs_inside_a_family_below_the_threshold(spark):
    r = np.random.default_rng(3)
    base, some = [f"w{i}" for i in range(800)], []
    for pair in range(50):
        at = r.permutation(np.arange(5, 795, 6))[:20].tolist()
        for side, own in enumerate((at[4:12], at[12:])):
            new = dict.fromkeys(own, f"x{pair}s{side}") | dict.fromkeys(at[:4], f"y{pair}")
            some.append(" ".join(new.get(i, w) for i, w in enumerate(base)))
    got = {x["doc_id"]: x["class_id"] for x in near_duplicates(frame(spark, some)).collect()}
    assert got == classes(dict(enumerate(some))) and len(set(got.values())) == 50


def test_signature_agreement_estimates_similarity():
    r = np.random.default_rng(0)
    shared, a, b = (r.integers(0, 2**63, n).astype(np.uint64) for n in (300, 100, 100))
    sig = signatures(np.concatenate([shared, a, shared, b]), np.array([0, 400, 800]), 2000)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.04


def similar_pairs(texts, threshold=0.8):
    """Pairs of ids at or over the threshold, found through the rarer half of their shingles."""
    sets = {i: multiset(t) for i, t in texts.items()}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    close = set()
    for i, s in sets.items():
        some = sorted(s, key=lambda x: len(holders[x]))[: max(1, len(s) // 2)]
        for j in {j for x in some for j in holders[x] if j > i}:
            if sum((s & sets[j]).values()) >= threshold * sum((s | sets[j]).values()):
                close.add((i, j))
    return close


def test_near_recall_of_pairs(spark):
    r, texts = np.random.default_rng(11), {x["doc_id"]: x["text"] or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for g in range(30):
        base = [f"v{k}" for k in r.integers(0, 3000, 200)]
        for _ in range(8):
            own = list(base)
            for at in r.integers(0, 200, 1 + g % 3):
                own[at] = f"y{r.integers(0, 10**9)}"
            texts[10**6 + len(texts)] = " ".join(own)
    pairs = similar_pairs(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in near_duplicates(df).collect()}
    assert len(pairs) > 500 and sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_rare_cells_find_every_link_between_components(spark):
    import zstandard

    r = np.random.default_rng(17)
    passage, some = [f"p{i}" for i in range(90)], []
    for g in range(60):  # texts around one passage, many just under or over the threshold, of unlike lengths
        own = [f"o{g}w{i}" for i in range(int(r.integers(0, 30)))]
        for _ in range(3):
            w = list(passage[: int(r.integers(60, 91))]) + own
            for at in r.integers(0, len(w), int(r.integers(0, 3))):
                w[at] = f"x{r.integers(0, 10**9)}"
            some.append(" ".join(w))
    some += ["same same same same same same same", "same same same same same same same same", "one two", "one two three four five six"]
    sets = [multiset(t) for t in some]
    root = [k % 7 for k in range(len(some))]  # any components: links inside one are not asked for
    want = {
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and root[i] != root[j] and sum((a & b).values()) >= 0.8 * sum((a | b).values())
    }
    mixed = spark.createDataFrame([(1, k, root[k]) for k in range(len(some))] + [(2, 0, root[0])], "key long, node long, root long")
    packed = [(k, sum(sets[k].values()), bytearray(zstandard.ZstdCompressor().compress(t.encode()))) for k, t in enumerate(some)]
    got = {(x["a"], x["b"]) for x in rare_links(mixed, spark.createDataFrame(packed, "node long, cells long, packed binary"), 0.8).collect()}
    assert len(want) > 100 and want <= got and len(got) < len(some) ** 2 // 4
    assert not rare_links(mixed.limit(0), spark.createDataFrame(packed, "node long, cells long, packed binary"), 0.8).collect()


def test_near_with_null_ids_and_shared_numbers(spark, monkeypatch):
    from pulseloom.llm import dart_minhash

    base = " ".join(f"w{i}" for i in range(100))
    some = [base] * 40 + [base.replace("w50", "z"), base.replace("w7 ", "q "), "other words here", "Other, words here", "more of other words"]
    df = spark.createDataFrame([(None, t, 1, 2) for t in some] + [(5, base + " end", 1, 2)], "doc_id long, text string, node long, mark long")
    by_node = Counter((r["class_size"], r["n_links"] > 0) for r in near_duplicates(df).collect())
    assert by_node[(43, True)] == 43 and by_node[(2, False)] == 2 and by_node[(1, False)] == 1
    monkeypatch.setattr(dart_minhash, "node_of", lambda digest: digest[0] % 2)
    assert Counter((r["class_size"], r["n_links"] > 0) for r in near_duplicates(df).collect()) == by_node


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 150: 100}
    from pulseloom.llm.components import extended

    r = np.random.default_rng(1)
    for _ in range(2):
        some = [tuple(map(int, e)) for e in r.integers(0, 60, (45, 2))]
        frames_ = [spark.createDataFrame(some[i::3], "a long, b long") for i in range(3)]
        grown = extended(extended(components(frames_[0]), frames_[1]), frames_[2])
        whole = components(spark.createDataFrame(some, "a long, b long"))
        assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, whole.collect()))


# ---- 7 -----------------------------------------------------------------------


def share(own, item):
    k = min(5, len(item))
    s = containment.shingle_set(item, k)
    return len(s & containment.shingle_set(own, k)) / len(s)


def test_containment_matches_sql(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = contained(docs, bench).withColumn("containment", F.round("containment", 6)).toPandas().sort_values(["doc_id", "item_id"]).reset_index(drop=True)
    want = sql(containment.ORACLE, documents=f"{SF}/documents.parquet", benchmark=f"{SF}/benchmark.parquet").sort_values(["doc_id", "item_id"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_containment_in_long_documents_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK_ITEMS", 2)
    item = " ".join(f"q{i}" for i in range(40))
    noise = " ".join(f"n{i % 997}" for i in range(30_000))
    some = [f"{noise} {item.upper()} {noise}", f"{noise} {' '.join(item.split()[:38])}", noise, None, ""]
    items = spark.createDataFrame([(1, item), (2, None), (3, "only three words"), (4, ""), (5, item)], "item_id long, text string").withColumn("doc_id", F.lit(7)).withColumn("containment", F.lit("x"))
    got = {(r["doc_id"], r["item_id"]): round(r["containment"], 4) for r in contained(frame(spark, some), items).collect()}
    assert got == {(0, 1): 1.0, (0, 5): 1.0, (1, 1): round(34 / 36, 4), (1, 5): round(34 / 36, 4)}
    assert contained(frame(spark, some).limit(0), items).count() == 0 and contained(frame(spark, some), items.limit(0)).count() == 0


def test_short_items_in_longer_texts(spark):
    noise = " ".join(f"n{i % 997}" for i in range(60_000))
    some = [f"{noise} Only THREE words {noise}", "only three", "only, three words", "three words only", "one", "a b c d", "x a b c d y", None, "only three words only three words"]
    item_texts = ["only three words", "three words", "one", "a b c d", "only three words"]
    items = spark.createDataFrame(list(enumerate(item_texts)), "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["containment"], r["n_shingles"]) for r in contained(frame(spark, some), items).collect())
    assert got == sorted((d, i, 1.0, 1) for d, t in enumerate(some) for i, x in enumerate(item_texts) if t and len(words(t)) >= len(words(x)) and share(words(t), words(x)) == 1)
    assert {(0, 0), (0, 1), (8, 4), (6, 3)} <= {g[:2] for g in got}


# ---- 8 -----------------------------------------------------------------------


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in texts.items()}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, parts in by_doc.items():
        assert sum(n for _s, n in parts) == len(ids[i]) and sorted(parts)[0][0] == 0
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= WINDOW
    assert set(by_doc) == set(texts) and sorted(by_seq) == list(range(len(by_seq)))
    return len(by_seq)


def test_packing_is_a_partition_of_the_ids(spark, docs, texts):
    rows = pack(docs, default_tokenizer(), rows_per_bucket=37).collect()
    tokens = sum(r["length"] for r in rows)
    assert check_packing(rows, texts) <= -(-tokens // WINDOW) + 2


def test_packing_oddities(spark):
    some = ["Don't  STOP <|endoftext|> <|ENDOFTEXT|>", None, "", "é É ß İ\u00a0x 漢字 123abc!!", "word " * 9000, "x" * 5000]
    check_packing(pack(frame(spark, some), default_tokenizer()).collect(), dict(enumerate(some)))
    assert pack(frame(spark, some).limit(0), default_tokenizer()).count() == 0


def test_packing_of_capital_contractions_beside_special_tokens(spark):
    some = ["<| IT'S DON'T", "<|endoftext|> We'RE I'M IT'LLx don't'S", "a<|b \u00c9'S x", "\u0130'S \u0130x", "IT'S DON'T"]
    check_packing(pack(frame(spark, some), default_tokenizer()).collect(), dict(enumerate(some)))


def test_ids_equal_the_tokenizers_on_random_texts():
    from tokenizers import Tokenizer

    from pulseloom.llm.packing import WordCache

    with open(default_tokenizer(), encoding="utf-8") as f:
        spec = f.read()
    t, cache, r = Tokenizer.from_str(spec), WordCache(spec, most=20_000), np.random.default_rng(5)
    bits = ["<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "'S", "'s", "'LL", "'ve", "'", "\u0130", "i\u0307", "\u00c9", "e\u0301", "\u0301", "\u01c5", "\ufb01", "\u1e9e", "\u03a3", "A", "b", "cD", "9", "42", "!", "?!", "--", " ", "  ", "\t\n", "\u00a0", "\u2003", "\u6f22", "\U0001f600", "\x00", "\u200b", "don", "t"]
    for _ in range(60):
        some = ["".join(r.choice(bits, r.integers(0, 12))) for _ in range(50)]
        assert cache.encode(some) == [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(some, add_special_tokens=False)]


def test_caches_are_bounded_and_other_tokenizers_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    from pulseloom.llm.packing import Generations, WordCache

    g = Generations(10_000)
    for i in range(5000):
        for k in g.missing({f"k{i}", "same"}):
            g.put(k, b"v" * 4)
        assert g.young["same"] == b"vvvv" and len(g.young) + len(g.old) < 120
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        cache = WordCache(f.read())
    some = ["Two  words's", "", " leading", "tail \n"]
    assert not cache.by_word and cache.encode(some) == [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]


def test_plan_uses_every_piece_once():
    r = np.random.default_rng(4)
    hist = dict(Counter(np.minimum(r.integers(1, 4096, 3000), 4096).tolist())) | {4096: 5, 7: 100}
    packed, used = plan(hist), Counter()
    for lengths, n in packed:
        assert sum(lengths) <= WINDOW and n > 0
        for x in lengths:
            used[x] += n
    assert used == Counter(hist)
    t = runs(packed)
    assert len(t) == sum(len(c) for c, _n in packed) and plan({}) == []


# ---- 1 -----------------------------------------------------------------------


def ppm_by_hand(texts, train, order):
    """Per document (base, known, score) straight from the definitions."""
    toks = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    body = {i: END * order + b" ".join(w) + END for i, w in toks.items()}
    follow, count = {}, Counter()
    for i in texts:
        if train(i):
            count.update([*toks[i], END])
            for p in range(order, len(body[i])):
                for k in range(order + 1):
                    follow.setdefault(body[i][p - k : p], Counter())[body[i][p]] += 1
    total, kinds, out = sum(count.values()), len(count), {}
    for i, b in body.items():
        lp = 0.0
        for p in range(order, len(b)):
            gone = set()
            for k in range(order, -1, -1):
                live = {s: n for s, n in follow.get(b[p - k : p], {}).items() if s not in gone}
                if b[p] in live:
                    lp += math.log10((2 * live[b[p]] - 1) / (2 * sum(live.values())))
                    break
                if live:
                    lp += math.log10(len(live) / (2 * sum(live.values())))
                gone |= set(live)
            else:
                lp -= math.log10(256 - len(gone))
        w = [*toks[i], END]
        out[i] = (sum(math.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w), sum(count[x] > 0 for x in w), lp, len(w), total)
    return out


@pytest.mark.parametrize("order", [2, 5])
def test_ppm_matches_definition(spark, docs, texts, order):
    some = {i: t for i, t in texts.items() if i < 40} | {1000: None, 1001: "", 1002: "Ünseen WORDS zzqx\x85y", 1003: " \t\n"}
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in ppm_scores(df, crc_bucket("doc_id", 5) != 1, order, block_bytes=9000, frame_bytes=2500).collect()}
    want = ppm_by_hand(some, lambda i: zlib.crc32(str(i).encode()) % 5 != 1, order)
    assert set(got) == set(some)
    for i, (base, known, lp, n, total) in want.items():
        r = got[i]
        assert (r["n_known"], r["n_tokens"], r["train_tokens"]) == (known, n, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], lp, rel_tol=1e-9)


@pytest.mark.parametrize("chunk", [1, 7, 50, 10**6])
def test_keys_of_frames_in_chunks(chunk):
    some = [b"", b"ab cd", b"x", b"", b"longer than the order"]
    data = b"".join(x + END for x in some)
    got = np.concatenate(list(stream_keys(data, 3, chunk)))
    want = [int.from_bytes((END * 3 + x + END)[p : p + 4], "big") for x in some for p in range(len(x) + 1)]
    assert got.tolist() == want


def test_words_of_frames():
    words, per = words_of(b"a bb\n\n\nccc\n")
    assert words.to_pylist() == [b"a", b"bb", END, END, END, b"ccc", END] and per.tolist() == [3, 1, 1, 2]


def test_ppm_probabilities_sum_to_one(spark):
    from pulseloom.llm.ppm import key_scores

    counts = Counter()
    data = b"abracadabra alakazam abra"
    for p in range(2, len(data)):
        counts[int.from_bytes(data[p - 2 : p + 1], "big")] += 1
    for ctx in (b"ab", b"zz"):
        rows = {int.from_bytes(ctx + bytes([s]), "big"): 0 for s in range(256)} | dict(counts)
        df = spark.createDataFrame(list(rows.items()), "key long, n long")
        lp = [r["lp"] for r in key_scores(df, 2).collect() if r["key"] >> 8 == int.from_bytes(ctx, "big")]
        assert len(lp) == 256 and math.isclose(sum(10**x for x in lp), 1, rel_tol=1e-9)


def test_ppm_empty_table(spark, docs):
    assert ppm_scores(docs.limit(0), F.lit(True)).count() == 0
    assert ppm_scores(oddities(spark), F.col("doc_id") > 0).count() == 9


# ---- 9 -----------------------------------------------------------------------


def kneser_ney_by_hand(texts, trusted):
    """Per document (symbols, bits) straight from the definitions, with counts in dictionaries."""
    body = {i: "\n" * 3 + " ".join((t or "").lower().split()) + "\n" for i, t in texts.items()}
    body = {i: "".join(c if ord(c) < 65536 else chr(0xE000 + ord(c) % 0x1900) for c in b) for i, b in body.items()}
    grams = Counter(b[p - 3 : p + 1] for i, b in body.items() if i in trusted for p in range(3, len(b)))
    tables = {}
    for k in (4, 3, 2, 1):
        n = [sum(v == j for v in grams.values()) for j in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [0.0] + [max(0.0, min(j, j - (j + 1) * y * n[j + 1] / n[j])) if n[1] and n[j] else 0.5 for j in (1, 2, 3)]
        total, held = Counter(), Counter()
        for g, v in grams.items():
            total[g[:-1]] += v
            held[g[:-1]] += d[min(v, 3)]
        tables[k] = grams, d, total, held
        lower = Counter(g[1:] for g in grams)
        grams = lower

    def p(g):
        if not g:
            return 1 / 65536
        c, d, total, held = tables[len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        return ((c[g] - d[min(c[g], 3)]) if g in c else 0.0) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * p(g[1:])

    out = {}
    for i, b in body.items():
        bits = [-math.log2(p(b[q - 3 : q + 1])) for q in range(3, len(b))]
        out[i] = (len(bits), round(sum(bits) / len(bits), 3)) if len(bits) > 1 else (0, None)
    return out, p, body


def test_quality_matches_definition(spark, docs, texts):
    some = {i: t for i, t in texts.items() if i < 50} | {1000: None, 1001: " \t", 1002: "\U0001f600 \u6f22\u5b57 \u00c4", 1003: "Zq", 1004: texts[0]}
    lang = {i: ["en", "de", None, "xx"][i % 4] for i in some}
    trusted = {i for i in some if i % 3 == 0 and lang[i] != "xx"}
    rows = [(i, t, lang[i], 9, 9) for i, t in some.items()] + [(None, "a null id", "en", 9, 9), (0, some[0], lang[0], 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, bits long, block long").repartition(3)
    labels = spark.createDataFrame([(i, 1, 2) for i in trusted] + [(i, 1, 2) for i in list(trusted)[:3]] + [(None, 1, 2), (2, 0, 2)], "doc_id long, quality int, lang int")
    twice = {f"{i}": t for i, t in some.items()} | {"0 again": some[0], "null": "a null id"}
    want, p, body = kneser_ney_by_hand(twice, {f"{i}" for i in trusted} | {"0 again"})
    got = quality(df, labels, 0.8, block_bytes=20_000).collect()
    assert len(got) == len(rows)
    own = {}
    for i, (_n, b) in want.items():
        k = None if i == "null" else int(i.split()[0])
        if k in trusted and b is not None:
            own.setdefault(lang[k], []).append(b)
    general = np.quantile([b for v in own.values() for b in v], 0.8)
    for r in got:
        n, b = want["null" if r["doc_id"] is None else str(r["doc_id"])]
        assert r["n_symbols"] == n and (b is None) == (r["bits"] is None) and (b is None or abs(r["bits"] - b) < 1.5e-3)
        limit = np.quantile(own[r["lang"]], 0.8) if r["lang"] in own else general
        assert abs(r["threshold"] - limit) < 2e-3 and r["kept"] == (r["bits"] is not None and r["bits"] <= r["threshold"])
    seen = sorted({c for b in body.values() for c in b})
    for context in ("the", "zzz", "\n\n\n"):
        assert math.isclose(sum(p(context + c) for c in seen) + (65536 - len(seen)) * p(context + "\u2603"), 1, rel_tol=1e-9)


def test_grams_by_ranges_of_parts(spark, docs):
    from pulseloom.llm import kneser_ney as K

    made = K.make_blocks(docs.repartition(5).select("doc_id", "text", "lang"), {"doc_id": F.col("doc_id")}, F.lit(False), K.normal, 50_000)
    marks = K.trusted_marks(made, docs.where("doc_id % 2 = 0").select("doc_id"))
    rows = [sorted(map(tuple, K.block_grams(made, marks, most).collect())) for most in (10**6, 1)]
    assert rows[0] == rows[1] and sum(r[2] for r in rows[0]) > 0


def test_quality_keeps_trusted_and_drops_junk(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r["quality"]: r["k"] for r in got}
    assert share[1] > 0.93 and share.get(0, 0) < 0.6
    odd = quality(oddities(spark), labels.limit(0)).collect()
    assert len(odd) == 9 and all(r["threshold"] is None for r in odd) and sum(not r["kept"] for r in odd) == 3
    assert quality(docs.limit(0), labels).count() == 0


# ---- 10 ----------------------------------------------------------------------


def phrases_by_hand(text, reference):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) + 0 and text[at : at + size + 1] in reference:
            size += 1
        if text[at : at + 1] not in reference:
            size = 1
        n, at = n + 1, at + size
    return n


def test_parser_counts_longest_match_phrases():
    r = np.random.default_rng(0)
    ref = bytes(r.choice(list(b"abcd "), 300).tolist())
    p = Parser("x", ref.decode())
    for n in (1, 5, 60, 500, 512, 513, 1500, 6000):
        t = bytes(r.choice(list(b"abcde "), n).tolist())
        from pulseloom.llm.language_id import segments

        lanes, owner = segments([t, t[: n // 2 + 1]])
        got = np.bincount(owner, p.count(lanes, owner), 2).astype(int).tolist()
        assert got == [phrases_by_hand(t, ref), phrases_by_hand(t[: n // 2 + 1], ref)]


def test_phrases_run_over_whole_segments():
    from pulseloom.llm.language_id import segments

    p = Parser("x", "ab" * 3000)
    some = [b"ab" * 2000, b"ab" * 400 + b"b" + b"ab" * 700, b"a" * 1100, b"x" * 1030]
    lanes, owner = segments(some)
    assert np.bincount(owner, p.count(lanes, owner), 4).tolist() == [phrases_by_hand(t, b"ab" * 3000) for t in some]


def test_language_prediction_matches_definition(spark, docs):
    from pulseloom.llm.language_id import letters, reference_texts

    learnt = {r["doc_id"] for r in docs.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    refs = {k: v.encode() for k, v in reference_texts(docs.where(F.col("doc_id").isin(list(learnt))), ref_passages=8, ref_chars=1200).items()}
    rows = docs.where("doc_id < 60").collect()
    got = {r["doc_id"]: r for r in identify(docs, None, 8, 1200).where("doc_id < 60").collect()}
    assert len(refs) == 4
    for r in rows:
        clean = letters(r["text"] or "").encode()
        if not clean:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0)
            continue
        cost = {k: phrases_by_hand(clean, v) * math.log2(len(v)) / len(clean) for k, v in refs.items()}
        best, second = sorted(cost.items(), key=lambda c: (c[1], c[0]))[:2]
        assert got[r["doc_id"]]["lang_pred"] == best[0] and math.isclose(got[r["doc_id"]]["score"], 1 - best[1] / second[1], abs_tol=1e-12)


def test_numerals_are_no_letters(spark):
    got = identify(frame(spark, ["the cat", "\u00bd \u00b2 \u2460 12 \u216b", "\u5b57 \u00bd"], ["en"]), F.lit(False)).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["en", "und", "en"]


def test_references_come_from_whole_texts_and_null_ids(spark):
    from pulseloom.llm.language_id import reference_texts

    text = " ".join("abcdefghij"[int(c)] * 6 for i in range(4000) for c in str(i))
    df = spark.createDataFrame([(None, text, "en")] * 5 + [(None, "zz yy", "fr")], "doc_id long, text string, lang string")
    refs = reference_texts(df, ref_passages=20)
    assert 1000 < len(refs["en"]) <= 40_000 and refs["fr"] == "zz yy" and not text.startswith(refs["en"][:500])


def test_language_blocks_carry_the_best_along(spark, docs):
    few = docs.where("doc_id < 120").union(docs.sparkSession.createDataFrame([(None, None, None, None, None), (5, "", "zz", "s", 0)], docs.schema))
    rows = [sorted((str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in predict(few, docs, ["doc_id", "text"], block=b).collect())) for b in (32, 1)]
    assert rows[0] == rows[1] and len(rows[0]) == few.count()


def test_pipeline_stages_take_odd_tables(spark, docs):
    import corpus_pipeline as P

    odd = docs.where("doc_id < 40").union(spark.createDataFrame([(None, "Of the the and of that.", None, None, None), (7, None, "en", "s", 0), (7, "", None, "s", 0)], docs.schema))
    odd = odd.union(odd.where("doc_id < 3")).withColumn("key", F.lit(1)).withColumn("lang_pred", F.lit("x")).withColumn("text_", F.lit(2))
    for name, f in P.STAGES[:-1]:
        kept = f(spark, odd, SF)
        assert kept.columns == P.COLUMNS and f(spark, odd.limit(0), SF).count() == 0, name
        assert kept.where("doc_id IS NULL").count() == 1, name
    assert P.packing(spark, odd, SF).select("doc_id").distinct().count() == 41 and P.packing(spark, odd.limit(0), SF).count() == 0


def test_language_held_out_accuracy(spark, docs):
    got = identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out AND length(text) > 40")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r["n"] > 20 and r["a"] > 0.95


def test_language_oddities(spark, docs):
    got = identify(docs.select("doc_id", "text", "lang").union(oddities(spark).select(F.col("doc_id") + 10**6, "text", "lang"))).where("doc_id >= 1000000").collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"] - 10**6, r)
    assert by[2]["lang_pred"] == by[3]["lang_pred"] == by[4]["lang_pred"] == "und" and by[2]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in identify(frame(spark, ["abc", "1 2"], [None])).collect()} == {"und"} and identify(docs.limit(0)).count() == 0


# ---- 3 -----------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def fine(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text) if fine(k, m.group())]


def test_base_spans_match_plain_patterns(spark, texts):
    hard = [
        "a@b.c%d@e.f x@y.z@q.r", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "+1 (555) 555-1234 ++12345678 +1-+22222222", "4111 1111-1111 1111 x 4111111111111111 41111111111111112",
        "é😀 a.b@c.d 😀 +441234567890)", "a@b..c a@-.x @b.c", "a@b.c" * 50, "0" * 3000, "y" * 20_000 + "@b.c", None, "",
    ]
    every = {**texts, **{10**6 + i: t for i, t in enumerate(hard)}}
    got = {r["doc_id"]: r for r in find_personal_data(spark.createDataFrame(list(every.items()), "doc_id long, text string")).collect()}
    for i, t in every.items():
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[i]["spans"].startswith(",".join(want)) and got[i]["n_ip"] == sum(w.startswith("ip") for w in want)


def terms_by_hand(texts, disclosure=0.9, support=3):
    """{term: replacement} straight from the definitions."""
    distinct = set(texts)
    bags, held = {}, {}
    for t in distinct:
        w = {x for x in re.split(r"[\W\d_]+", re.sub(PLAIN["email"], " ", t).lower()) if len(x) >= 3}
        bags[t] = w | {x[:2] + "*" for x in w}
        held[t] = {(s.split(":")[0], t[int(s.split(":")[1]) : int(s.split(":")[2])].lower()) for s in base_spans(t)}
    df = Counter(x for b in bags.values() for x in b)
    ne = Counter(e for h in held.values() for e in h)
    both = Counter((x, e) for t in distinct for e in held[t] for x in bags[t])
    n, over = len(distinct), set()
    for (x, e), k in both.items():
        if k >= support and df[x] >= support and ne[e] >= support and n > ne[e] and math.log(k * n / (df[x] * ne[e])) / math.log(n / ne[e]) >= disclosure - 1e-12:
            over.add(x)
    return {x: "" if x[:2] + "*" in over else f"[{x[:2]}*]" for x in over if not x.endswith("*")}


def test_terms_match_brute_force(spark):
    texts = {x["doc_id"]: x["text"] or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for i in range(40):
        texts[10**6 + i] = f"note {'abcdefghij'[i % 10]}{'klmn'[i // 10]}x from Zorblax and plain folk of Thaville to bob{i % 4}@corp.example.com" + (" Quillan" if i % 4 == 1 else " Xqarn" if i % 4 == 2 else "")
        texts[2 * 10**6 + i] = f"thaw and zoom {i} times, number {i * 7}"
    want = terms_by_hand(list(texts.values()))
    got = {x["doc_id"]: x for x in find_personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), redact=True).collect()}
    assert {"quillan", "xqarn"} <= set(want) and {w[:1] for w in want.values()} == {"", "["}
    for i, t in texts.items():
        spans = [f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]+", t) if m.group().lower() in want]
        assert got[i]["spans"] == ",".join(base_spans(t) + spans) and got[i]["n_term"] == len(spans)
        clean = re.sub(r"[^\W\d_]+", lambda m: want.get(m.group().lower(), m.group()), t)
        assert base_spans(t) or got[i]["sanitised"] == clean


def test_terms_that_reveal_an_entity_are_removed(spark):
    some = [f"report {c} Zorblax bob@corp.example.com note{c}" for c in "pqrs"] + [f"the plain word number {i} without any of it" for i in range(30)]
    got = {r["doc_id"]: r for r in find_personal_data(frame(spark, some), redact=True).collect()}
    assert "term:9:16" in got[0]["spans"] and "Zorblax" not in got[0]["sanitised"] and "[EMAIL]" in got[0]["sanitised"]
    assert all(not got[i]["spans"] for i in range(4, 34)) and got[9]["sanitised"] == some[9]
    assert find_personal_data(oddities(spark)).count() == 9 and find_personal_data(oddities(spark).limit(0)).count() == 0


def test_addresses_with_zero_octets(spark):
    some = ["10.0.0.1 and 127.0.0.1", "0.0.0.0", "001.000.0.1", "255.255.255.0 x 192.168.0.7", "0256.0.0.1", "000.00.0.0255 1.2.3.300"]
    got = {r["doc_id"]: r for r in find_personal_data(frame(spark, some)).collect()}
    assert {i: r["spans"] for i, r in got.items()} == {i: ",".join(base_spans(t)) for i, t in enumerate(some)}
    assert [got[i]["n_ip"] for i in range(6)] == [2, 1, 1, 2, 0, 1]


def test_terms_count_in_distinct_texts_and_wherever_they_stand(spark):
    held = [f"Quillan met us {c} and spoke of the plain word at length before we wrote to bob@corp.example.com about it{c}" for c in ("one", "two", "three")]
    some = held + [held[0]] * 9 + [f"we met us and spoke of the plain word number{i} at length before we wrote to nobody about it" for i in range(88)]
    got = {r["doc_id"]: r for r in find_personal_data(frame(spark, some)).collect()}
    assert all("term:0:7" in got[i]["spans"] and got[i]["n_term"] == 1 for i in range(12))
    assert all(not got[i]["spans"] for i in range(12, 100))


# ---- 2 -----------------------------------------------------------------------


def judged(url):
    host, path = "", ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        host, _, tail = rest.partition("/")
        path = "/" + tail if "/" in rest else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_urls_match_by_hand(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = [None, "", "nothing", "HTTP://WWW.Example.COM/en/x?y", "a://b.com", "x://example.com/en", "x://notexample.com/en/", "q://h.net/fr/1#/es/", "://", "x://É.COM/a\nb"]
    every = pages.union(spark.createDataFrame([(10**6 + i, u) for i, u in enumerate(odd)], "page_id long, url string"))
    for r in judge_urls(every).join(every, "page_id").collect():
        host, path, best = judged(r["url"])
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == best if best else r["rule"] is None and r["verdict"] in ("allow", "block")
    assert judge_urls(every.limit(0)).count() == 0


def shaped(segment):
    s = re.sub(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?=\.|$)", "{uuid}", segment)
    s = re.sub(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?=\.|$)", "{date}", s)
    s = re.sub(r"^(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?=\.|$)", "{hex}", s)
    return re.sub(r"[0-9]+", "{n}", s)


def templates_by_hand(urls, label):
    """url number -> (verdict without a rule, template, level, labelled, purity), straight from the definitions."""
    found = [judged(u)[:2] for u in urls]
    segs = [[shaped(x) for x in p.split("/") if x] for _h, p in found]
    parts = [[] for _ in urls]
    for depth in range(max(map(len, segs), default=0)):
        load = {}
        here = [(h, tuple(parts[i])) for i, (h, _p) in enumerate(found)]
        for i, s in enumerate(segs):
            if depth < len(s):
                load.setdefault(here[i], Counter())[s[depth]] += 1
        for i, s in enumerate(segs):
            if depth < len(s):
                c = load[here[i]]
                loose = len(c) > 20 and c[s[depth]] < 0.05 * sum(c.values()) and "{" not in s[depth]
                parts[i] = [*parts[i], "{*}" if loose else s[depth]]
    leaf = {}
    for i, (h, _p) in enumerate(found):
        x = leaf.setdefault((h, *parts[i]), [0, 0, 0])
        x[0] += 1
        x[1] += label[i] is False
        x[2] += label[i] is True
    good, bad = (sum(x[k] for x in leaf.values()) for k in (1, 2))
    prior = (bad + 1) / (good + bad + 2)
    merged = {}  # (level, above, below) -> labels
    groups = {}
    for node in leaf:
        for level in range(len(node)):
            groups.setdefault(node[:level], {}).setdefault(node[level], []).append(node)
    joins = set()
    for above, kids in groups.items():
        pool = Counter()
        for nodes in kids.values():
            for node in nodes:
                pool[node[len(above) + 1 :]] += leaf[node][0]
        n_all, all_g, all_b = (sum(leaf[x][k] for nodes in kids.values() for x in nodes) for k in (0, 1, 2))
        for name, nodes in kids.items():
            n, g, b = (sum(leaf[x][k] for x in nodes) for k in (0, 1, 2))
            distance = sum((sum(leaf[x][0] for x in nodes if x[len(above) + 1 :] == r) - n * c / n_all) ** 2 / (n * c / n_all) for r, c in pool.items())
            free = len(pool) - 1
            ok = distance <= free + 3 * math.sqrt(2 * free) + 1e-9 or distance <= 0.1 * n + 1e-9
            og, ob = all_g - g, all_b - b
            if g + b >= 3 and og + ob >= 3:
                p = (all_b + 1) / (all_g + all_b + 2)
                ok = ok and abs(b / (g + b) - ob / (og + ob)) <= 2 * math.sqrt(p * (1 - p) * (1 / (g + b) + 1 / (og + ob)))
            if ok:
                joins.add((above, name))
                for x in nodes:
                    m = merged.setdefault((above, x[len(above) + 1 :]), [0, 0])
                    m[0] += leaf[x][1]
                    m[1] += leaf[x][2]
    out = []
    for i, (h, _p) in enumerate(found):
        node = (h, *parts[i])
        _n, g, b = leaf[node]
        level = None
        if g + b < 3:
            for k in range(len(node) - 1, -1, -1):
                m = merged.get((node[:k], node[k + 1 :]), [0, 0]) if (node[:k], node[k]) in joins else [0, 0]
                if sum(m) >= 3:
                    level, (g, b) = k, m
                    break
        purity = round((b + 2 * prior) / (g + b + 2), 6)
        out.append(("block" if g + b >= 3 and purity >= 0.8 else "allow", "/" + "/".join(parts[i]), level, g + b, purity))
    return out


def check_templates(spark, urls, rows):
    label = [None if (best := judged(u)[2]) is None else best[1] == "block" for u in urls]
    want, blocked = templates_by_hand(urls, label), 0
    assert len(rows) == len(urls)
    for r in rows:
        i = r["page_id"]
        assert (r["template"], r["level"], r["labelled"]) == want[i][1:4] and math.isclose(r["purity"], want[i][4], abs_tol=2e-6)
        if r["rule"] is None:
            assert r["verdict"] == want[i][0]
            blocked += r["verdict"] == "block"
    return blocked


def test_templates_match_brute_force(spark):
    r = np.random.default_rng(2)
    pages = [x["url"] for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()]
    hosts = ["a.example.com", "b.example.com", "c.net", "d.net", "e.org", "f.org", "", "g.com"]
    for _ in range(700):
        h, lang = hosts[int(r.integers(0, 8))], ("en", "fr", "es", "de")[int(r.integers(0, 4))]
        tail = [f"user/u{'abcdefghij'[int(r.integers(0, 10))]}{'klmnopqrst'[int(r.integers(0, 10))]}/post/{r.integers(0, 99)}", f"{r.integers(0, 999)}.html", "/".join("wxyz"[int(k)] for k in r.integers(0, 4, 12)), ""][int(r.integers(0, 4))]
        pages.append(f"http://{h}/{lang}/{tail}")
    pages += [None, "none", pages[0], pages[0], "http://e.org/" + "/".join("abc"[k % 3] for k in range(40))]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string").withColumn("host", F.lit("x")).withColumn("level", F.lit(1)).withColumn("parts", F.lit(2))
    assert check_templates(spark, pages, judge_urls(df).collect()) > 0


def test_templates_are_the_same_at_any_depth(spark):
    names = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:03d}")
    tails = [f"x{names(i)}/y{names(i * 7 % 200)}/end" for i in range(200)]
    found = []
    for deep in (0, 8, 30):
        above = "/".join("abcdefgh"[k % 8] for k in range(deep))
        df = spark.createDataFrame([(i, f"http://h.org/{above}/{t}") for i, t in enumerate(tails)] + [(999, "http://h.org/" + "s/" * 2_000)], "page_id long, url string")
        rows = {r["template"] for r in judge_urls(df).where("page_id < 999").collect()}
        found.append({"/".join(t.split("/")[deep + 1 :]) for t in rows})
    assert found == [{"{*}/{*}/end"}] * 3


def test_templates_generalise_and_reject(spark):
    rows = [(i, f"http://h.org/user/{i}/edit") for i in range(50)] + [(100 + i, f"http://h.org/p/title-of-{'abcdefghij'[i % 10]}{'klmno'[i // 10]}") for i in range(50)] + [(200, "http://h.org/deep/" + "/".join("s" * 30))]
    labels = spark.createDataFrame([(i, True) for i in range(10)] + [(100 + i, False) for i in range(4)], "page_id long, bad boolean")
    got = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [], labels).collect()}
    assert {got[i]["template"] for i in range(50)} == {"/user/{n}/edit"} and all(got[i]["verdict"] == "block" for i in range(50))
    assert {got[100 + i]["template"] for i in range(50)} == {"/p/{*}"} and got[120]["verdict"] == "allow" and got[200]["template"] == "/deep" + "/s" * 30


# ---- 4 -----------------------------------------------------------------------


def test_levels_and_problems():
    assert levels([set(), {0}, {1}, {4}, {3}, {4}]) == [0, 1, 2, -1, -1, -1]
    assert references({"a": [{"$ref": "x"}, {"b": {"$ref": "y"}}]}) == {"x", "y"}
    schema = {"f": {"required": ["n"], "properties": {"n": "integer", "s": "string"}}}
    assert problems("f", {"n": True, "z": 1}, schema) == ["n is no integer", "unexpected z"] and problems("g", {}, schema) == ["unknown tool"] and problems("f", {"n": 3, "s": "t"}, schema) == []


def test_linking(spark):
    call = lambda *c: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in c]})
    result = lambda *r: json.dumps({"tool_results": [{"id": i, "content": x} for i, x in r]})
    schema = {"f": {"required": ["q"], "properties": {"q": "string", "after": "object"}}}
    rows = [
        (1, 0, call(("b", "f", {"q": "2", "after": {"$ref": "a"}}), ("a", "f", {"q": "1"}))), (1, 1, result(("a", {"y": 1, "x": [2]}), ("b", None), ("z", 0))), (1, 2, call(("c", "f", {"after": {"$ref": "a"}}), ("d", "f", {"q": "1", "after": {"$ref": "nope"}}))),
        (2, 0, result(("e", 1))), (2, 1, call(("e", "f", {"q": ""}))), (2, 2, None), (2, 3, "{broken"), (None, 0, call(("n", "f", {"q": "1"}))), (None, 1, result(("n", 1))),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("status", F.lit(1))
    got = {(r["conv_id"], r["call_id"], r["turn"]): r for r in link_tool_calls(df, schema).collect()}
    assert len(got) == 9 and got[(1, "b", 0)]["level"] == 1 and got[(1, "a", 0)]["level"] == 0 and got[(1, "a", 0)]["status"] == "linked"
    assert got[(1, "a", 0)]["json"] == '{"call":{"arguments":{"q":"1"},"id":"a","name":"f"},"result":{"x":[2],"y":1}}'
    assert got[(1, "c", 2)]["errors"] == "missing q" and got[(1, "d", 2)]["errors"] == "unknown reference" and got[(1, "c", 2)]["status"] == "unanswered"
    assert got[(2, "e", 1)]["status"] == "unanswered" and got[(2, "e", None)]["status"] == "early" and got[(1, "z", None)]["status"] == "orphan"
    assert got[(None, "n", 0)]["status"] == "unanswered" and got[(None, "n", None)]["status"] == "orphan"
    assert link_tool_calls(df.limit(0)).count() == 0


def links_by_hand(rows, schemas):
    """Counter of (conv_id, turn, call_id, status, errors, result_turn, result json)."""
    low = lambda t: -(10**9) if t is None else t
    calls, results, out = [], [], Counter()
    for conv, turn, text in rows:
        m = json.loads(text) if text else {}
        own = m.get("tool_calls", [])
        first = {}
        for j, c in enumerate(own):
            first.setdefault(c["id"], j)
        for j, c in enumerate(own):
            bad = set(problems(c["name"], c["arguments"], schemas)) | ({"repeated id"} if first[c["id"]] != j else set())
            calls.append((conv, turn, j, c["id"], [r for r in references(c["arguments"]) if r not in first], bad))
        results += [(conv, turn, j, r["id"], json.dumps(r["content"])) for j, r in enumerate(m.get("tool_results", []))]
    owner = {}
    for conv, turn, j, i, *_ in calls:
        if conv is not None and i is not None:
            owner[(conv, i)] = min(owner.get((conv, i), (10**9, 0)), (low(turn), j))
    answer, rest = {}, []
    for conv, turn, j, i, content in sorted(results, key=lambda r: (low(r[1]), r[2], r[4])):
        if (conv, i) in owner and low(turn) >= owner[(conv, i)][0] and (conv, i) not in answer:
            answer[(conv, i)] = (turn, content)
        else:
            rest.append((conv, turn, i, content))
    for conv, turn, j, i, refs, bad in calls:
        if any(turn is None or (conv, r) not in owner or owner[(conv, r)][0] in (-(10**9),) or owner[(conv, r)][0] >= turn for r in refs):
            bad = bad | {"unknown reference"}
        mine = owner.get((conv, i)) == (low(turn), j)
        if (conv, i) in owner and not mine:
            out[(conv, turn, i, "repeated", "; ".join(sorted(bad | {"repeated id"})), None, "null")] += 1
        elif (conv, i) in answer and mine:
            out[(conv, turn, i, "linked", "; ".join(sorted(bad)), *answer[(conv, i)])] += 1
        else:
            out[(conv, turn, i, "unanswered", "; ".join(sorted(bad | ({"missing id"} if i is None else set()))), None, "null")] += 1
    for conv, turn, i, content in rest:
        kind, why = ("orphan", "no call") if (conv, i) not in owner else ("extra", "answered before") if low(turn) >= owner[(conv, i)][0] else ("early", "before its call")
        out[(conv, None, i, kind, why, turn, content)] += 1
    return out


def test_linking_matches_brute_force_on_random_conversations(spark):
    r, rows = np.random.default_rng(8), []
    schema = {"f": {"required": ["q"], "properties": {"q": "string", "after": "object"}}}
    for n in range(400):
        conv = None if n % 29 == 0 else int(r.integers(0, 12)) if n % 3 else 5  # one conversation holds a third
        turn = None if n % 37 == 0 else int(r.integers(0, 6))
        ids = [f"i{k}" for k in r.integers(0, 8, r.integers(1, 4))]
        if r.random() < 0.5:
            text = json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": {"q": "1"} | ({"after": {"$ref": f"i{r.integers(0, 8)}"}} if r.random() < 0.3 else {})} for i in ids]})
        else:
            text = json.dumps({"tool_results": [{"id": i, "content": int(r.integers(0, 3))} for i in ids]})
        rows += [(conv, turn, text)] * (1 + (n % 11 == 0))
    # A message that needs a cycle of its own would be an error of another kind; those are tested above.
    got = Counter()
    for x in link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, text string"), schema).collect():
        errors = "; ".join(e for e in x["errors"].split("; ") if e != "cyclic reference")
        got[(x["conv_id"], x["turn"], x["call_id"], x["status"], errors, x["result_turn"], x["json"].rpartition('"result":')[2][:-1])] += 1
    want = links_by_hand(rows, schema)
    assert got == want and {k[3] for k in want} == {"linked", "unanswered", "repeated", "early", "extra", "orphan"}


# ---- pipeline ------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, docs, texts):
    import corpus_pipeline as P

    assert [n for n, _f in P.STAGES] == ["language", "exact", "near", "decontaminate", "packing"]
    more = {10**6: None, 10**6 + 1: "1234 !!", 10**6 + 2: " ", 10**6 + 3: None, 10**6 + 4: "Все люди рождаются свободными и равными", 10**6 + 5: "qzxvkjq wqzzxkv jqxzvkw xqjzkvw qxkzjvw", 10**6 + 6: "Of the the and."}
    texts = texts | more
    extra = spark.createDataFrame([(i, t, None, "s", 0) for i, t in more.items()], "doc_id long, text string, lang string, source string, n_chars long")
    every = docs.select(*P.COLUMNS).union(extra)
    kept = {}
    for name, f in P.STAGES[:-1]:
        every = f(spark, every, SF)
        assert every.columns == P.COLUMNS
        kept[name] = {r["doc_id"] for r in every.select("doc_id").collect()}
    refs = reference_texts(docs)
    fits = set()
    for i, t in texts.items():
        clean = letters(t or "").encode()
        cost = min(((phrases_by_hand(clean, r.encode()) * math.log2(len(r.encode())), math.log2(len(r.encode()))) for r in refs.values()), default=(0, 0)) if clean else None
        if cost and (cost[0] - cost[1]) / len(clean) <= P.MAX_BITS:
            fits.add(i)
    assert kept["language"] == fits and 10**6 + 6 in fits and not {10**6 + 4, 10**6 + 5} & fits
    first = {}
    for i in sorted(kept["language"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert kept["exact"] == set(first.values())
    roots = classes({i: texts[i] for i in kept["exact"]})
    assert kept["near"] == set(roots.values())
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i in kept["near"] if not any(share(words(texts[i]), w) >= 0.8 for w in items if w)}
    assert kept["decontaminate"] == clean
    check_packing(P.packing(spark, every, SF).collect(), {i: texts[i] for i in clean})


def test_links_to_all_leaders_are_verified_at_once_without_python(spark):
    from pulseloom.llm.dart_minhash import verified

    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words, "x"]), " ".join(["y", *words])]
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r["class_id"], r["class_size"], r["n_links"]) for r in got} == {(0, 3, 2)}
    held = spark.createDataFrame([(1, 5, [1, 2, 3, 4, 5]), (2, 4, [2, 3, 4, 5]), (3, 4, [3, 4, 5, 6])], "node long, cells long, held array<long>")
    found = verified(spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long"), held, 0.8)
    assert [tuple(r) for r in found.collect()] == [(1, 2)]
    assert "Arrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_word_cache_keeps_many_words_and_forgets_none_wrongly():
    import itertools

    from pulseloom.llm.packing import WordCache

    with open(default_tokenizer(), encoding="utf-8") as f:
        spec = f.read()
    texts = [" ".join("".join(w) for w in itertools.product(a, "bcdfghjklm", "aeiouy", "nprstvwxz", "aeiou", "lmnrst.")) for a in "bcdfghklmnprst"]
    cache, small = WordCache(spec), WordCache(spec, words=1_000)
    first, calls = [cache.encode([t])[0] for t in texts], []
    cache._encoded = lambda new: calls.append(new)
    assert [cache.encode([t])[0] for t in texts] == first and not calls
    some = [texts[0][:40_000], "a\0 a b\0\0 " + "x" * 17 + " Don'T", "", " ", "<|endoftext|> A"]
    assert [small.encode([t]) for t in some * 2] == [WordCache(spec).encode([t]) for t in some * 2]
    assert cache.tokenizer.encode(some[0], add_special_tokens=False).ids == list(memoryview(small.encode(some[:1])[0]).cast("I"))
