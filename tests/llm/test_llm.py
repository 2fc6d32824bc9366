"""Corpus operators against brute force, exact round trips and held-out labels."""

import collections
import hashlib
import itertools
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import minhash
from gridloom.llm import queries as Q
from gridloom.llm.bpe import bpe_decode, bpe_encode, loaded
from gridloom.llm.components import components
from gridloom.llm.licenses import TEMPLATES, bigrams, license_scan, normalised
from gridloom.llm.minhash import band_hashes, banding, near_duplicates, prefix_stars, spanning_links, without_duplicates
from gridloom.llm.neighbours import balanced_parts, fit, nearest, nearest_neighbours
from gridloom.llm.packing import ROUTE_TERMS, TERMS, Index, Router, fit_router, pack_documents
from gridloom.llm.pii import KEY_SETTING, pseudonymise
from gridloom.llm.quality import quality_rules, without_low_quality
from gridloom.llm.repair import LEAST, compress, decode_slice, encode_to_files, expand
from gridloom.llm.sharding import karmarkar_karp, shard_documents
from gridloom.llm.toxicity import toxicity, without_toxic
from gridloom.llm.words import Words
from tests.compare import connection, difference

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score double, key string, row int"
LONG = "alpha beta gamma delta " * 9000
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "One two three four five six"), (7, "one two three four five six"), (8, LONG),
    (9, "naïve “quotes” 日本語 😀 Σ İ"), (9, "repeated id"), (None, "no id here at all"), (4, "one"), (12, "'s don't 've <|endoftext|> x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None if i == 7 else "en", None, None, "clash", 0.5, None, 3) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(Q.TOKENIZER)


def words(text, lower=False):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def thue_morse(n, letters="ab"):
    """A word, and the one with its two letters exchanged: sums of powers modulo 2**64 do not tell them apart."""
    bits = [k.bit_count() % 2 for k in range(n)]
    return ["".join(letters[b ^ x] for b in bits) for x in (0, 1)]


def test_words_of_equal_polynomials_are_told_apart(spark, tokenizer):
    for n in (1024, 4096, 8192):
        one, two = thue_morse(n)
        assert len(set(Words([one, two]).hashes.tolist())) == 2
        ids, count = loaded(Q.TOKENIZER).encode([one, two, f"{one} {two}"])
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in (one, two, f"{one} {two}")]
        assert ids.tolist() == [i for w in want for i in w] and count.tolist() == [len(w) for w in want]
    rows = [(1, one), (2, two), (3, f"{one}\n{two}\n{one} x"), (4, "a b c d"), (5, "a b c d")]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df, width=3, percent=85).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4)}
    assert {r.doc_id: r.n_dup_lines for r in quality_rules(df).collect()} == dict.fromkeys(range(1, 6), 0)
    files = {r.doc_id: r.ids for r in encode_to_files(df, Q.TOKENIZER).collect()}
    assert all(files[i] == np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes() for i, t in rows)


def test_hashes_of_words_of_all_lengths_differ():
    words = [x * n for x in ("a", "b", "é", "\x01") for n in range(1, 40)] + ["a" * k + "\0" * j for k in range(1, 12) for j in range(1, 9)]
    found = Words([" ".join(words)])
    assert len(set(found.hashes.tolist())) == len(set(words)) == len(found.hashes)
    assert [Words([w]).hashes[0] for w in words] == found.hashes.tolist()


# ---- near duplicates


def brute_components(rows, width, percent):
    """rows (doc_id, text) -> {row number: (n, component)} by comparing every pair."""
    sets = []
    for _, text in rows:
        w = words(text, True)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(zip([i for i, _ in rows], sets, strict=True), 2):
        if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return [(i, len(s), find(i) if i is not None else None) for (i, _), s in zip(rows, sets, strict=True)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_all_pairs(docs, texts, width, percent):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs, width=width, percent=percent).collect()}
    assert got == set(brute_components(sorted(texts.items()), width, percent))


def test_near_copies_chained_and_shared_passages(spark):
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in rng.integers(0, 10**6, 220)]
    rows = []
    for k in range(120):
        copy = list(base)
        for at in rng.integers(0, len(base), rng.integers(0, 9)):
            copy[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((1000 - k, " ".join(copy)))
    passage = " ".join(base[:60])
    rows += [(2000 + k, " ".join(f"y{v}" for v in rng.integers(0, 10**6, 80)) + " " + passage) for k in range(40)]
    rows += [(3000 + k, rows[0][1]) for k in range(60)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    assert got == set(brute_components(rows, 3, 85))


@pytest.mark.parametrize("block", [2_000, 20_000])
def test_large_clusters_are_cut_without_loss(spark, monkeypatch, block):
    """Tasks so small that the clusters of candidates are cut: groups, chains of near copies, and a hub that is near few."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    rng = np.random.default_rng(7)
    common, rows = [f"b{k}" for k in range(120)], []
    for g in range(3):
        text = [f"g{g}w{k}" for k in range(80)]
        for k in range(50):
            if k % 5:
                text = list(text)  # a chain: each differs from the last
            at = rng.integers(0, len(text))
            text[at : at + 4] = [f"x{rng.integers(0, 10**9)}" for _ in range(4)]
            rows.append((int(rng.integers(0, 10**6)), " ".join(common + text)))
    rows += [(10**6 + k, " ".join(common + [f"u{k}v{v}" for v in range(k % 60)])) for k in range(80)]
    rows += [(10**6 + k, rows[k][1] + " again") for k in range(5)]  # ids that stand for two texts
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    assert got == set(brute_components(rows, 3, 85))


def test_prefix_stars_leave_documents_apart_that_share_boilerplate(spark):
    """2,000 unlike documents, each with the same 100 words and 60 of its own: no star joins them, so nothing is compared."""
    sets = [(k, 160, k, k, sorted([*range(100), *range(1000 + 60 * k, 1060 + 60 * k)]), 0) for k in range(2000)]
    sets.append((5000, 160, 5000, 5000, [*sets[7][4][:-1], 999_999], 0))
    found = prefix_stars(spark.createDataFrame(sets, "id long, n long, fa long, fb long, shingles array<long>, cluster long"), 85).collect()
    assert {(r.id, r.hub) for r in found} == {(5000, 7)}


def test_near_duplicates_odd_rows(odd, none):
    got = near_duplicates(odd, width=3, percent=85).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[3].component_id == 3
    assert by[7].component_id == 6 and not by[7].kept and by[8].n_shingles == 4 and by[5].component_id == 5
    assert by[None].component_id is None and by[None].kept
    assert near_duplicates(none).count() == 0
    kept = without_duplicates(odd, width=3, percent=85)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in odd.collect()} - {7}


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(5, 5), (3, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {k: 100 for k in range(100, 160)}


def test_components_of_a_hot_hub(spark):
    edges = [(k, 7) for k in range(100, 3100)] + [(k, k + 5000) for k in range(100, 200)] + [(8, 9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys([7, *range(100, 3100), *range(5100, 5200)], 7) | {8: 8, 9: 8}


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_at_the_threshold_share_a_bucket(percent):
    """Sets from 7 to 600 shingles, as unlike as a link allows."""
    rng, (rows, bands), missed = np.random.default_rng(percent), banding(percent), 0
    for size in (7, 12, 30, 90, 300, 600):
        for _ in range(60):
            values = rng.integers(0, 2**63, 2 * size).astype(np.uint64)
            apart = int(size * (100 - percent) / (100 + percent))  # on either side
            both = [np.sort(np.concatenate((values[: size - apart], values[size + k * apart : size + (k + 1) * apart]))) for k in (0, 1)]
            keys = band_hashes(np.repeat([0, 1], [len(b) for b in both]), np.concatenate(both), 2, rows, bands)
            missed += not (keys[0] == keys[1]).any()
    assert missed == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1), min_size=1, max_size=12))
def test_spanning_links_span_all_links(sets):
    values = np.concatenate([np.array(sorted(s)) for s in sets])
    links = spanning_links(np.array([len(s) for s in sets]), values, 60)
    rows = list(enumerate(sets))
    want, got = {k: {k} for k, _ in rows}, {k: {k} for k, _ in rows}
    for pairs, groups in ((links, got), ([(a, b) for (a, s), (b, t) in itertools.combinations(rows, 2) if 100 * len(s & t) >= 60 * len(s | t)], want)):
        for a, b in pairs:
            both = groups[a] | groups[b]
            for x in both:
                groups[x] = both
    assert want == got and len(links) < len(sets)


# ---- sharding


def test_karmarkar_karp_two_way():
    parts = karmarkar_karp([8, 7, 6, 5, 4], 2)
    sums = [sum(s for s, p in zip([8, 7, 6, 5, 4], parts, strict=True) if p == k) for k in (0, 1)]
    assert abs(sums[0] - sums[1]) == 2 and karmarkar_karp([], 3) == [] and len(set(karmarkar_karp([5, 5, 5], 3))) == 3


def test_karmarkar_karp_against_a_plain_version():
    """Partitions as lists of (sum, items), the two of largest spread combined until one is left."""
    rng = np.random.default_rng(3)
    for k in (2, 3, 5):
        for _ in range(20):
            sizes = rng.integers(1, 60, rng.integers(1, 14)).tolist()
            left = [[(size, [i])] + [(0, [])] * (k - 1) for i, size in enumerate(sizes)]
            born = list(range(len(left)))
            while len(left) > 1:
                order = sorted(range(len(left)), key=lambda i: (left[i][-1][0] - left[i][0][0], born[i]))
                one, two = left[order[0]], left[order[1]]
                mixed = sorted([(a + b, x + y) for (a, x), (b, y) in zip(one, reversed(two), strict=True)], key=lambda p: -p[0])
                least = mixed[-1][0]
                born = [born[i] for i in range(len(left)) if i not in order[:2]] + [max(born) + 1]
                left = [left[i] for i in range(len(left)) if i not in order[:2]] + [[(s - least, x) for s, x in mixed]]
            got = karmarkar_karp(sizes, k)
            loads = sorted(sum(s for s, p in zip(sizes, got, strict=True) if p == q) for q in range(k))
            assert loads == sorted(sum(sizes[i] for i in items) for _, items in left[0])


def test_sharding_is_whole_and_balanced(docs, texts):
    rows = shard_documents(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    load, slots, shard_of = collections.Counter(), collections.defaultdict(list), {}
    for r in rows:
        text = texts[r.doc_id]
        assert (r["size"], r.text_crc32) == (len(text.encode()) + 8, zlib.crc32(text.encode())) and r.law == "bytes" and r.grown_shard is None
        assert shard_of.setdefault(text, r.shard) == r.shard and 0 <= r.shard < 24
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) - min(load.values()) < 0.05 * sum(load.values()) / 24


def test_sharding_odd_rows(odd, none):
    rows = shard_documents(odd).collect()
    assert len(rows) == len(ODD) and {r["size"] for r in rows if r.doc_id in (1, 2)} == {8}
    assert len({r.shard for r in rows if r.doc_id == 4}) == 1 and shard_documents(none).count() == 0


# ---- quality


def brute_base(text):
    w, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    count = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    again = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def test_quality_base_counts_and_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    good, junk = [], []
    for r in quality_rules(docs).collect():
        base = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert base == brute_base(texts[r.doc_id]) and r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r.base_failed and r.kept)
        if r.doc_id in labels and not r.base_failed:
            (good if labels[r.doc_id] else junk).append(r.kept)
    assert all(good) and sum(junk) <= 0.1 * len(junk)


def test_quality_matches_its_sql(spark):
    assert difference(spark, connection(SF), Q.op3_divergence_quality, Q.oracle_sql()["op3_divergence_quality"], SF) is None


def test_quality_tests_classes_without_common_words(spark, tmp_path):
    """No word holds a share of the words; a text of digits among letters diverges by its classes, as in the SQL."""
    letters = ["".join(chr(97 + (k // 26**i) % 26) for i in range(4)) for k in range(2000)]
    rows = [(d, " ".join(letters[60 * d : 60 * d + 60]), "en") for d in range(30)] + [(30, " ".join(str(10**6 + k) for k in range(60)), "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert difference(spark, con, Q.op3_divergence_quality, Q.oracle_sql()["op3_divergence_quality"], str(tmp_path)) is None
    kept = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [d for d, k in kept.items() if not k] == [30]


def test_quality_of_small_languages_does_not_hang_on_the_corpus(spark):
    """A text of a language with few words keeps its verdict, whatever else is in the table."""
    rng = np.random.default_rng(5)

    def text(letters):
        return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(80))

    small = [(k, text("aeioklmnp"), "fi-FI") for k in range(30)] + [(30, text("#$%&<>|*12345"), "fi")]
    common = [(100 + k, " ".join(["the", "of", "and"] * 50 + [text("rstuvw")]), "en") for k in range(60)]
    verdicts = []
    for rows in (small, small + common):
        got = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
        verdicts.append([got[k] for k in range(31)])
    assert verdicts == [[True] * 30 + [False]] * 2


def test_quality_odd_rows(odd, none):
    got = quality_rules(odd).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == sorted((i or 0, len(words(t))) for i, t in ODD)
    assert {brute_base(t) for _, t in ODD} == {(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got}
    assert quality_rules(none).count() == 0 and without_low_quality(odd).columns == odd.columns


# ---- toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity(docs, labels).collect() if r.held_out and r.doc_id in toxic]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in held)
    hit = [(r.predicted, toxic[r.doc_id]) for r in held]
    assert sum(p for p, t in hit if t) >= 0.9 * sum(t for _, t in hit)
    assert sum(p for p, t in hit if not t) <= 0.02 * sum(not t for _, t in hit)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2, None, "x") for k in range(13)] + [(None, 1, 1, "x"), (500, 1, None, "x")], "doc_id long, toxic int, quality int, text string")
    got = toxicity(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity(none, labels).count() == 0 and {r.score for r in toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert without_toxic(odd, labels.limit(0)).columns == odd.columns


# ---- tokens


def test_bpe_equals_the_library(spark, docs, texts, tokenizer):
    encoded = bpe_decode(bpe_encode(docs, Q.TOKENIZER), Q.TOKENIZER).collect()
    for r in encoded:
        want = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.decoded == tokenizer.decode(want, skip_special_tokens=False)
    digest = {r.doc_id: r for r in Q.op5_bpe_round_trip(spark, SF).collect()}
    ids = tokenizer.encode(texts[7], add_special_tokens=False).ids
    assert digest[7].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and digest[7].n_tokens == len(ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aabcdehinorst'’ .,!?#<|>09éÉßÑñΣςİ́日 \n\x1c endoftext"), max_size=40), max_size=6))
def test_bpe_equals_the_library_on_odd_texts(texts):
    library = Tokenizer.from_file(Q.TOKENIZER)
    ids, count = loaded(Q.TOKENIZER).encode(texts)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert count.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_bpe_equals_the_library_on_code_points_and_marks(tokenizer):
    """Letters of late versions of Unicode, each mark, and sequences of marks, which the library orders by its own tables."""
    pick = random.Random(8)
    points = [c for c in [*range(1, 0x3200), *range(0xA000, 0xAC00), *range(0xF900, 0x13500), *range(0x1E000, 0x1FC00), 0x2FA1D, 0xE0001, 0x10FFFF] if not 0xD800 <= c < 0xE000]
    marks = [chr(c) for c in [*range(0x300, 0x370), *range(0x8D0, 0x900), *range(0x1DC0, 0x1E00), 0x315, 0x1161, 0x11A8, 0x3099]]
    texts = [f"a{chr(c)}b" for c in points]
    texts += ["".join(pick.choice(pick.choice((marks, "aeAO가ᄀ", [chr(pick.choice(points))]))) for _ in range(9)) for _ in range(3000)]
    ids, count = loaded(Q.TOKENIZER).encode(texts)
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    at = np.concatenate(([0], np.cumsum(count)))
    assert [t for t, w, a, b in zip(texts, want, at, at[1:], strict=False) if ids[a:b].tolist() != w] == []


def test_bpe_of_long_words(tokenizer):
    texts = ["x" * 30_000, "".join(random.Random(2).choices("abcdefgh", k=30_000)) + " and", "é!" * 800, "é" * 5000, "'" * 3000, "<|endoftext|>" * 300 + "᷺" * 1200]
    ids, count = loaded(Q.TOKENIZER).encode(texts)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert count.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_bpe_odd_rows(odd, none):
    got = bpe_decode(bpe_encode(odd, Q.TOKENIZER), Q.TOKENIZER).collect()
    assert len(got) == len(ODD) and {(len(r.ids), r.decoded) for r in got if r.doc_id in (1, 2, 3)} == {(0, "")}
    assert sorted((r.doc_id or 0) for r in got) == sorted((i or 0) for i, _ in ODD) and len({r.decoded for r in got if r.doc_id == 4}) == 1
    assert bpe_decode(bpe_encode(none, Q.TOKENIZER), Q.TOKENIZER).count() == 0


def test_bpe_decode_odd_lists(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, [], "x"), (3, [-1, 10**6, 320], "x"), (3, [320], "x")], "doc_id long, ids array<int>, decoded string")
    got = bpe_decode(df, Q.TOKENIZER)
    word = loaded(Q.TOKENIZER).names[320].as_py()
    assert got.columns == ["doc_id", "ids", "decoded"] and [r.decoded for r in got.orderBy("doc_id", "ids").collect()] == [None, "", f"  {word}", word]


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_packing_holds_every_id_once(request, table, tokenizer):
    docs = request.getfixturevalue(table)
    rows = pack_documents(docs.coalesce(1), Q.TOKENIZER).collect()
    sequences = collections.defaultdict(list)
    pieces = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert sum(sum(n for _, n in p) < 2048 for p in sequences.values()) == 1
    want = collections.Counter()
    for r in docs.collect():
        want[r.doc_id, tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1])] += 1
    if table == "docs":
        for (i, ids), _ in want.items():
            own = sorted(pieces[i])
            assert [s for s, _, _ in own] == list(itertools.accumulate([0] + [len(x) for _, x, _ in own[:-1]]))
            assert tuple(x for _, part, _ in own for x in part) == ids and {n for _, _, n in own} == {len(ids)}
    assert sum(len(part) for p in pieces.values() for _, part, _ in p) == sum(len(ids) * n for (_, ids), n in want.items())


def test_packing_prefers_neighbours_and_empty_table(spark, none):
    rows = [(k, " ".join([f"topic{k % 2}word{j}" for j in range(12)] + [f"own{k}"])) for k in range(40)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), Q.TOKENIZER, window=600).collect()
    mixed = collections.defaultdict(set)
    for r in got:
        mixed[r.sequence_id].add(r.doc_id % 2)
    assert sum(len(v) > 1 for v in mixed.values()) <= 3 and pack_documents(none, Q.TOKENIZER).count() == 0


def test_packing_scores_every_term_of_a_seed():
    """Neighbours that share only the lighter terms of a seed of many, against scores summed term by term."""
    light = [f"light{k}" for k in range(10)]
    texts = [" ".join([f"heavy{k} heavy{k}" for k in range(80)] + light), " ".join(light), "light3 other", "nothing in common"]
    owned = Words(texts, lower=True)
    index = Index(owned, np.ones(TERMS, np.int64), 1000, 50.0)
    held = [dict(zip(index.term[index.doc == d].tolist(), index.weight[index.doc == d].tolist(), strict=True)) for d in range(4)]
    score = {d: sum(held[d].get(t, 0) for t in held[0]) for d in (1, 2, 3)}
    assert index.neighbours(0, np.array([False, True, True, True])) == sorted((d for d in score if score[d]), key=lambda d: -score[d]) == [1, 2]


def test_packing_order_is_that_of_plain_bm25():
    """Neighbours by BM25 written out over dictionaries, with document frequencies of all texts."""
    pick = random.Random(6)
    texts = [" ".join(pick.choices([f"w{k}" for k in range(60)], weights=[1 / (k + 1) for k in range(60)], k=pick.randrange(1, 40))) for _ in range(50)]
    tf = [collections.Counter(t.split()) for t in texts]
    df, mean = collections.Counter(w for c in tf for w in c), sum(map(len, map(str.split, texts))) / len(texts)
    idf = {w: np.log1p((len(texts) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    words = Words(texts, lower=True)
    counted = np.zeros(TERMS, np.int64)
    for w, n in df.items():
        counted[int(Words([w]).hashes[0]) >> 46] += n
    index = Index(words, counted, len(texts), mean)
    for seed in range(50):
        score = {d: sum(idf[w] * tf[d][w] * 2.2 / (tf[d][w] + 1.2 * (0.25 + 0.75 * sum(tf[d].values()) / mean)) for w in tf[seed]) for d in range(50) if d != seed and tf[d].keys() & tf[seed].keys()}
        got = index.neighbours(seed, np.arange(50) != seed)
        assert sorted(got) == sorted(score) and all(score[a] >= score[b] - 1e-9 for a, b in itertools.pairwise(got))


def test_packing_ranks_neighbours_as_they_are_taken():
    """The first ones are those of the whole list, with equal scores across the place where the order is cut."""
    pick = random.Random(3)
    texts = [" ".join(pick.choices([f"w{k}" for k in range(30)], k=pick.randrange(1, 6))) for _ in range(400)]
    index = Index(Words(texts, lower=True), np.ones(TERMS, np.int64), 1000, 3.0)
    for seed in range(40):
        unused = np.arange(400) % 7 != seed % 7
        whole = index.neighbours(seed, unused)
        term = index.term[index.doc == seed]
        at = np.concatenate([np.arange(index.start[t], index.start[t + 1]) for t in term])
        score = (np.bincount(index.holders[at], index.held[at], 400) + index.dense @ (index.dense[seed] > 0)) * unused
        assert whole == sorted(np.flatnonzero(score).tolist(), key=lambda d: (-score[d], d))
        assert list(itertools.islice(index.ranked(seed, unused), 5)) == whole[:5]


def test_router_brings_topics_together(spark, none):
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(f"topic{k % 4}word{w}" for w in rng.integers(0, 40, 60)) + " and some of the rest") for k in range(400)]
    router = fit_router(spark.createDataFrame(rows, "id long, text string"))
    held = collections.defaultdict(collections.Counter)
    for k, text in rows:
        bucket, tf = np.unique((Words([text]).hashes >> np.uint64(53)).astype(np.int64), return_counts=True)
        leaf, _ = router(np.zeros(len(bucket), np.int64), bucket, tf, 1)
        held[leaf[0]][k % 4] += 1
    assert len(held) >= 4 and sum(max(c.values()) for c in held.values()) >= 0.98 * len(rows)
    empty = fit_router(none.select("id", "text"))
    assert empty(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 2)[0].tolist() == [0, 0]
    assert Router(np.zeros(30, np.int64), np.arange(30), np.ones(30, np.int64), 1).leaves == 1 and ROUTE_TERMS <= TERMS


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), min_size=1, max_size=8), st.data())
def test_repair_round_trip_and_random_access(docs, data):
    ids = np.array([i for d in docs for i in d], np.int64)
    cuts = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    symbols, at, rules, expansion = compress(ids, cuts, 6)
    assert expand(symbols, rules, 6).tolist() == ids.tolist()
    left = collections.Counter()  # pairs that stand apart from each other
    for k, d in enumerate(docs):
        own = symbols[at[k] : at[k + 1]]
        assert expand(own, rules, 6).tolist() == d
        last = {}
        for i, pair in enumerate(itertools.pairwise(own.tolist())):
            if last.get(pair) != i - 1 or pair[0] != pair[1]:
                left[pair], last[pair] = left[pair] + 1, i
        if d:
            start = data.draw(st.integers(0, len(d) - 1))
            length = data.draw(st.integers(1, len(d) - start))
            assert decode_slice(own, rules, expansion, 6, start, length).tolist() == d[start : start + length]
    assert max(left.values(), default=0) < LEAST  # no pair pays for a rule


def test_repair_writes_a_passage_once():
    """A passage of 500 ids in 40 documents becomes one symbol in each."""
    rng = np.random.default_rng(1)
    passage = rng.permutation(30_000)[:500]
    docs = [np.concatenate((rng.integers(30_000, 40_000, 20), passage, rng.integers(30_000, 40_000, 20))) for _ in range(40)]
    ids, cuts = np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    symbols, _, rules, expansion = compress(ids, cuts, 50_000)
    assert len(symbols) == 40 * 41 and expansion.max() == 500 and (expand(symbols, rules, 50_000) == ids).all()


def test_files_give_back_every_id_in_order(docs, texts, tokenizer, odd, none):
    rows = sorted(encode_to_files(docs, Q.TOKENIZER).collect())
    start = 0
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
        assert r.start == start and r.ids == np.array(ids, "<u4").tobytes()
        start += len(ids)
    got = sorted((r.start, len(r.ids) // 4, r.doc_id is None) for r in encode_to_files(odd, Q.TOKENIZER).collect())
    assert len(got) == len(ODD) and got[0][2] and [s for s, _, _ in got] == list(itertools.accumulate([0] + [n for _, n, _ in got[:-1]]))
    assert encode_to_files(none, Q.TOKENIZER).count() == 0


# ---- nearest neighbours


def test_neighbours_recall_and_exact_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = collections.defaultdict(list)
    for r in Q.op6_learned_partitions(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    hit = total = 0
    assert set(got) == set(ids[ids % 100 == 0].tolist())
    for q, found in got.items():
        distance = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        assert [r["rank"] for r in found] == list(range(1, 11)) and all(abs(r.score - distance[ids == r.vec_id][0]) < 1e-12 for r in found)
        best = [i for i in np.lexsort((ids, distance)) if ids[i] != q][:10]
        hit, total = hit + len({r.vec_id for r in found} & set(ids[best].tolist())), total + 10
    assert hit >= 0.9 * total


def test_routing_prunes_a_clustered_table():
    """40,000 vectors around 1,000 centres, a sample of an eighth: few parts are read, and nine in ten neighbours found."""
    rng, n, parts, k = np.random.default_rng(3), 40_000, 64, 10
    vectors = rng.normal(size=(1000, 32))[rng.integers(0, 1000, n)] + rng.normal(size=(n, 32)) * 0.4
    ids = np.arange(n)
    sample = np.sort(rng.choice(n, n // 8, replace=False))
    router, probes = fit(ids[sample], vectors[sample], parts, k, 1 / 8)
    order = router.order(vectors)
    read, home = order[::100, :probes], order[:, 0]
    query, found, _ = nearest(vectors[::100], vectors, k, ids[::100], ids)
    assert np.bincount(home, minlength=parts)[read].sum(axis=1).mean() < 0.3 * n
    assert (read[query] == home[found][:, None]).any(axis=1).mean() >= 0.9


def test_neighbours_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, part int, query_id string"
    bad = [(900, None), (901, []), (902, [0.0, 0.0]), (903, [1.0, None]), (904, [float("nan"), 1.0]), (905, [float("inf"), 1.0]), (906, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    same = [(100 + k, [1.0, 2.0]) for k in range(30)]
    rows = [(i, v, None, 1, "clash") for i, v in bad + same + [(200, [5.0, 5.0]), (300, [5.0, 6.0])]]
    got = nearest_neighbours(spark.createDataFrame(rows, schema)).orderBy("query_id", "rank").collect()
    assert [(r.vec_id, r.score) for r in got if r.query_id == 100] == [(101 + k, 0.0) for k in range(10)]
    assert {r.query_id for r in got} == {100, 200, 300} and got[-1].vec_id not in (900, 906)
    assert nearest_neighbours(spark.createDataFrame([], schema)).count() == 0


def test_neighbours_of_very_large_and_small_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(40, 3))
    vectors[0], vectors[1], vectors[2], vectors[3:6] = [1e160, 0, 0], [1e160, 1e158, 0], [1.5e308, -1.5e308, 0], vectors[3:6] * 1e-200
    table = spark.createDataFrame([(100 * i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest_neighbours(table, k=39).collect()}
    assert len(got) == 40 * 39 and got[0, 1] == (100, 1e158) and {got[300, 1][0], got[300, 2][0]} == {400, 500} and 0 < got[300, 1][1] < 1e-199


@pytest.mark.parametrize("n", [1, 2, 11, 12, 24, 60])
def test_neighbours_are_k_or_all_in_small_tables(spark, n):
    vectors = np.random.default_rng(n).normal(size=(n, 4))
    vectors[n // 2 :] = vectors[0]  # half of the rows are alike
    table = spark.createDataFrame([(100 * i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    found = collections.Counter(r.query_id for r in nearest_neighbours(table, k=10).collect())
    assert found == {100 * i: min(10, n - 1) for i in range(n) if n > 1}


def test_balanced_parts_are_balanced():
    vectors = np.random.default_rng(0).normal(size=(257, 5))
    graph = np.argsort(((vectors[:, None] - vectors[None]) ** 2).sum(-1), axis=1)[:, 1:6]
    sizes = np.bincount(balanced_parts(graph, vectors, 8), minlength=8)
    assert sizes.max() - sizes.min() <= 2 and sizes.sum() == 257


# ---- personal data


def luhn(digits):
    return sum(int(d) for d in digits[::-2]) % 10 == -sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]) % 10


def test_pseudonyms_keep_format_links_and_difference(spark):
    cards = ["4785380592391139", "4316-5226-7852-5456", "4316 5226 7852 5456", "4994226020900891"]
    texts = [f"card {c} and date 2024-02-29, 29/02/2024, 31.12.1999; ip 10.0.0.255, call +1 (743) 555-3824 or (743) 555-3824, ssn 123-45-6789, a.b@mail5.example.com." for c in cards]
    rows = [(k, t) for k, t in enumerate(texts)] + [(9, "not valid: 4785380592391138 2023-02-30 300.1.1.1 12345 v1.2.3 2024-13-01")]
    got = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[9].text == rows[-1][1] and got[9].n_private == 0
    new = [re.search(r"card ([\d -]+?) and", got[k].text)[1] for k in range(4)]
    assert all(luhn(re.sub(r"\D", "", c)) for c in new) and [re.sub(r"\d", "0", c) for c in new] == [re.sub(r"\d", "0", c) for c in cards]
    assert re.sub(r"\D", "", new[1]) == re.sub(r"\D", "", new[2]) and len({re.sub(r"\D", "", c) for c in new}) == 3
    for k in range(4):
        for secret in (cards[k], "2024-02-29", "10.0.0.255", "555-3824", "123-45-6789", "a.b@mail5"):
            assert secret not in got[k].text
        date = re.search(r"date (\d{4})-(\d\d)-(\d\d), (\d\d)/(\d\d)/(\d{4})", got[k].text).groups()
        assert date[:3] == date[:2:-1] and got[k].text.split(" and ")[1] == got[0].text.split(" and ")[1]
        assert got[k].n_private == 9


def plain_feistel(left, right, left_size, right_size, key, tweak):
    for i in range(8):
        mixed = int(hashlib.sha256(f"{key}:{tweak}:{i}:{right}".encode()).hexdigest()[:14], 16)
        left, right = right, (left + mixed) % (left_size if i % 2 == 0 else right_size)
    return left, right


def plain_digits(digits, key, tweak):
    u, v = len(digits) // 2, len(digits) - len(digits) // 2
    a, b = plain_feistel(int(digits[:u]), int(digits[u:]), 10**u, 10**v, key, f"{tweak}{len(digits)}")
    return f"{a:0{u}d}{b:0{v}d}"


def test_pseudonyms_are_those_of_a_plain_feistel_network(spark):
    pick, values, want = random.Random(7), [], []
    for _ in range(40):
        payload = "".join(pick.choices("0123456789", k=pick.randrange(12, 19)))
        values.append(payload + next(c for c in "0123456789" if luhn(payload + c)))
        new = plain_digits(payload, "k'1", "card")
        want.append(new + next(c for c in "0123456789" if luhn(new + c)))
        social = "".join(pick.choices("0123456789", k=9))
        values.append(f"{social[:3]}-{social[3:5]}-{social[5:]}")
        new = plain_digits(social, "k'1", "social")
        want.append(f"{new[:3]}-{new[3:5]}-{new[5:]}")
        phone = "".join(pick.choices("0123456789", k=10))
        values.append(f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}")
        new = plain_digits(phone, "k'1", "phone")
        want.append(f"+1 ({new[:3]}) {new[3:6]}-{new[6:]}")
        octets = [pick.randrange(256) for _ in range(4)]
        values.append(".".join(map(str, octets)))
        a, b = plain_feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, "k'1", "address")
        want.append(f"{a // 256}.{a % 256}.{b // 256}.{b % 256}")
        day = pick.randrange(150 * 487)
        values.append(str(np.datetime64("1900-01-01") + day))
        a, b = plain_feistel(day // 487, day % 487, 150, 487, "k'1", "date")
        want.append(str(np.datetime64("1900-01-01") + (a * 487 + b)))
        name = f"x{pick.randrange(10**6)}@Mail.example.com"
        values.append(name)
        want.append("user" + hashlib.sha256(f"k'1:mail:{name.lower()}".encode()).hexdigest()[:32] + "@example.invalid")
    df = spark.createDataFrame([(k, f"so {v}, then") for k, v in enumerate(values)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pseudonymise(df, key="k'1").collect()}
    assert [got[k] for k in range(len(values))] == [f"so {w}, then" for w in want]


def test_pseudonyms_of_long_runs(spark):
    """Values and runs that would need a deep stack, or time with the square of their length."""
    texts = ["x@a" + ".a" * 100_000, "1" * 1_000_000, "1." * 300_000, "@" * 500_000, "a@" * 300_000, "1-" * 300_000, "+1 " * 200_000, "x@y.org 10.0.0.1 " * 20_000]
    got = {r.doc_id: r for r in pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k").collect()}
    assert got[0].n_private == 1 and re.fullmatch(r"user[0-9a-f]{32}@example\.invalid", got[0].text) and got[7].n_private == 40_000
    assert all(got[k].text == texts[k] for k in (1, 3, 5))


def test_pseudonyms_need_a_key(spark):
    df = spark.createDataFrame([(1, "a@b.org", "kept")], "doc_id long, text string, _found string")
    with pytest.raises(ValueError, match="key"):
        pseudonymise(df, key="")
    one, two = (pseudonymise(df).first().text for _ in range(2))
    assert one != two  # drawn each time
    spark.conf.set(KEY_SETTING, "mine")
    try:
        row = pseudonymise(df).first()
        assert row.text == pseudonymise(df, key="mine").first().text and row._found == "kept"
        secret = pseudonymise(df, key="a-key-none-may-read")
        assert secret.count() == 1 and "none-may-read" not in secret._jdf.queryExecution().toString()
    finally:
        spark.conf.unset(KEY_SETTING)


def test_date_pseudonyms_are_a_permutation(spark):
    days = spark.sql("SELECT explode(sequence(date'2019-11-01', date'2021-03-01')) AS d").selectExpr("row_number() OVER (ORDER BY d) AS doc_id", "cast(d AS string) AS text")
    got = [r.text for r in pseudonymise(days).collect()]
    assert len(set(got)) == days.count() and all(np.datetime64("1900-01-01") <= np.datetime64(t) <= np.datetime64("2100-01-02") for t in got)


def test_pseudonyms_odd_rows(odd, none, docs, texts):
    got = pseudonymise(odd)
    assert got.columns == [*odd.columns, "n_private"] and collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(ODD)
    assert pseudonymise(none).count() == 0
    for r in pseudonymise(docs.select("doc_id", "text")).collect():
        mails = re.findall(r"[\w.]+@\w+\.example\.com", texts[r.doc_id])
        numbers = [n for n in re.findall(r"(?<!\w)\d{16}(?!\w)", texts[r.doc_id]) if luhn(n)]
        assert not any(x in r.text for x in mails + numbers) and (r.n_private > 0 or r.text == texts[r.doc_id])


# ---- licenses


def brute_licenses(text):
    found = set()
    for part in re.split(r"[\n\r]+|(?<=[.!?:;])\s+", text or ""):
        own = bigrams(normalised(part))
        best = min(((-2 * len(own & b) / (len(own) + len(b)), name) for name, b in ((n, bigrams(normalised(t))) for n, t in TEMPLATES) if own or b), default=(0, ""))
        if best[0] <= -0.8:
            found.add(best[1])
    return sorted(found)


def test_license_scan_matches_brute_force(spark, docs, odd, none):
    extra = [(10**6 + k, f"Some text. {t}. More\nlines {t.upper()}!") for k, (_, t) in enumerate(TEMPLATES)]
    extra += [(2 * 10**6 + k, " ".join(t.split()[:-1])) for k, (_, t) in enumerate(TEMPLATES)]
    both = docs.select("doc_id", "text").unionAll(spark.createDataFrame(extra, "doc_id long, text string")).unionAll(odd.select("doc_id", "text"))
    want = collections.Counter((r.doc_id, tuple(brute_licenses(r.text))) for r in both.collect())
    assert collections.Counter((r.doc_id, tuple(r.licenses)) for r in license_scan(both).collect()) == want
    assert license_scan(odd).count() == len(ODD) and license_scan(none).count() == 0


def test_license_texts_and_headers_across_lines(spark):
    """Whole texts and headers as published, wrapped at other widths and on one line, within other text."""
    from gridloom.llm.licenses import TEXTS

    around = "Some words that are about nothing at all stand here before it, and\nothers come after it. " * 3
    rows, want = [], {}
    for name, text in TEXTS:
        flat = " ".join(text.split())
        for cut in (text, "\n".join(textwrap.wrap(flat, 47)), f"{around}{flat} {around}", f"{around}\n// " + "\n// ".join(textwrap.wrap(flat, 60)) + f"\n{around}"):
            want[len(rows)] = name
            rows.append((len(rows), cut))
    found = {r.doc_id: r for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(k, want[k], found[k].licenses) for k in want if found[k].licenses != [want[k]]] == []
    assert all(r.n_notices == 1 and r.best_dice >= 0.8 for r in found.values())


def test_license_windows_match_brute_force(spark):
    """Every window by its sets of bigrams, for texts with repeats and near copies."""
    pick = random.Random(4)
    texts = [("A", "one two three one two four five six one two three seven"), ("B", "eight nine ten two three one eleven")]
    rows = []
    for k in range(60):
        words = pick.choices("one two three four five six".split(), k=pick.randrange(30))
        own = pick.choice(texts)[1].split()
        own[pick.randrange(len(own))] = pick.choice(own)
        at = pick.randrange(len(words) + 1)
        rows.append((k, " ".join(words[:at] + own + words[at:])))
    want = {}
    for k, text in rows:
        words, best = text.split(), 0
        for _, t in texts:
            size, b = len(t.split()), bigrams(t.split())
            for i in range(max(0, len(words) - size) + 1):
                a = bigrams(words[i : i + size])
                best = max(best, 2 * len(a & b) / (len(a) + len(b)))
        want[k] = round(best, 9) if best >= 0.8 - 1e-9 else None
    found = license_scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=[("Z", "zeta eta theta iota kappa")], texts=texts)
    # The best coefficient of all is that of the chosen window, unless one with more common bigrams overlaps it.
    got = {r.doc_id: r.best_dice for r in found.collect()}
    assert {k for k in got if got[k] is None} == {k for k in want if want[k] is None}
    assert all(got[k] <= want[k] + 1e-9 for k in got if got[k] is not None)
    assert sum(abs(got[k] - want[k]) < 1e-9 for k in got if got[k] is not None) > 0.9 * sum(x is not None for x in want.values())


# ---- the pipeline


def test_pipeline_stages_on_odd_rows_and_empty_tables(odd, none):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, none):
            got = stage(df.sparkSession, df, SF)
            n = got.count()
            if name != "packing":
                assert got.columns == df.columns
            assert n == {"quality": 0}.get(name, df.count()) or name in ("packing", "near_dedup", "quality") and df is odd
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(odd.sparkSession, odd, SF).collect()}
    assert kept == {r.doc_id for r in odd.collect()} - {7}


def test_pipeline_stages_keep_columns_and_clean_documents(spark, docs):
    import corpus_pipeline

    spark.conf.set(KEY_SETTING, "of this test")
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, SF).persist()
        seen.append((name, after.count()))
        if name != "packing":
            assert after.dtypes == docs.dtypes
            now = after
    assert [n for n, _ in seen] == ["toxicity", "quality", "near_dedup", "pii", "packing"]
    assert seen[0][1] > 0.8 * docs.count() and seen[2][1] == seen[3][1]
    # How documents are cut depends on the partitions; their tokens do not.
    tokens = [df.groupBy("doc_id").agg({"length": "sum"}).collect() for df in (after, corpus_pipeline.run(spark, SF))]
    spark.conf.unset(KEY_SETTING)
    assert sorted(tokens[0]) == sorted(tokens[1])
