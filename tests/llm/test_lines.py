"""Line deduplication against brute force; minimal perfect hashes; special tokens beside strange marks."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridloom.llm import lines, queries as Q
from gridloom.llm.bpe import Bpe, bpe_encode
from tests.compare import connection, difference

SCHEMA = "doc_id long, text string, n_lines string, n_dropped string, digest string, shard string"


def _plain(texts, least, points=1):
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    held = collections.Counter(k for s in split for k in {key(x) for x in s})
    common = {k for k, n in held.items() if n >= least and len(k) >= points}
    return [(len(s), sum(key(x) in common for x in s), "\n".join(x for x in s if key(x) not in common)) for s in split]


def _some(seed, n):
    pick = random.Random(seed)
    pool = ["Cookie notice", " cookie NOTICE\t", "", " ", "É", "é", "a", "\x1c", "x\r", "x", "日本語", "İ", "　a", *(f"line {k}" for k in range(60))]
    texts = ["\n".join(pick.choices(pool, k=pick.randrange(9))) for _ in range(n)]
    return [None, "", "\n", "\n\n", *texts, *[texts[0]] * 15, "Cookie notice\n" * 30_000 + "the end"]


@pytest.mark.parametrize("least,points,keys", [(10, 1, 1 << 15), (10, 1, 7), (3, 2, 7), (1, 1, 7), (10**6, 1, 50)])
def test_lines_are_dropped_as_by_brute_force(spark, monkeypatch, least, points, keys):
    monkeypatch.setattr(lines, "SHARD_KEYS", keys)
    texts = _some(1, 120)
    ids = [None, 3, 3, *range(10, 7 + len(texts))]
    docs = spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(7)
    got = lines.dedup_lines(docs, min_documents=least, min_chars=points)
    assert sorted(got.columns) == sorted(docs.columns) and {(r.digest, r.shard) for r in got.select("digest", "shard").distinct().collect()} == {("z", "w")}
    want = sorted(((i or 0), *w) for i, w in zip(ids, _plain(texts, least, points), strict=True))
    assert sorted(((r.doc_id or 0), r.n_lines, r.n_dropped, r.text) for r in got.collect()) == want


def test_lines_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert lines.dedup_lines(none).count() == 0 and lines.without_common_lines(none).columns == none.columns
    one = spark.createDataFrame([(1, None, "a", "b", "c", "d"), (2, "x", "a", "b", "c", "d")], SCHEMA)
    assert [tuple(r) for r in lines.without_common_lines(one, min_documents=1).orderBy("doc_id").collect()] == [(1, None, "a", "b", "c", "d"), (2, "", "a", "b", "c", "d")]


def test_minimal_perfect_hashes():
    pick = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 5000):
        a, b = pick.integers(0, 2**64, n, np.uint64), pick.integers(0, 2**32, n, np.uint32)
        if n > 100:
            a[:50] = a[0]  # keys that share their first half
        counts = pick.integers(1, 400, n)
        index = lines.LineIndex.build(a, b, counts, 255)
        assert sorted(index.places(a, b)) == list(range(n)) and index.probe(a, b).tolist() == np.minimum(counts, 255).tolist()
        again = lines.LineIndex.of_row(index.row(), 255)
        assert again.probe(a, b).tolist() == index.probe(a, b).tolist()
        strange = again.probe(pick.integers(0, 2**64, 2000, np.uint64), pick.integers(0, 2**32, 2000, np.uint32))
        assert (strange > 0).sum() <= 3  # fingerprints of 16 bits
        if n > 1000:
            assert sum(map(len, index.levels)) * 8 < 4.5 * n


def test_line_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(spark, connection(sf), Q.op13_line_dedup, Q.oracle_sql()["op13_line_dedup"], sf) is None
    assert hashlib.sha256(b"").hexdigest() == _digest_of_empty(spark)


def _digest_of_empty(spark):
    from pyspark.sql import functions as F

    return lines.dedup_lines(spark.createDataFrame([(1, None, "", "", "", "")], SCHEMA)).select(F.sha2("text", 256)).first()[0]


# ---- special tokens beside strange code points
MARKED = ["a <|endoftext|> b", "café <|endoftext|>", "தமிழ் <|endoftext|> x", "\U00020000<|endoftext|>", "ᄀ<|endoftext|>가", "<|endoftext|>", "abَ <|endoftext|>", "plain words"]


@pytest.mark.parametrize("order", list(itertools.permutations(range(3))))
def test_special_tokens_with_marks_in_any_order(order):
    tokenizer = Tokenizer.from_file(Q.TOKENIZER)
    encoder = Bpe(Q.TOKENIZER)
    groups = [MARKED[0:1] + MARKED[5:6] + MARKED[7:], MARKED[1:3], MARKED[3:5] + MARKED[6:7]]
    for k in order:  # a piece each, one encoder
        ids, count = encoder.encode(groups[k])
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in groups[k]]
        assert count.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    ids, count = encoder.encode(MARKED * 2)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in MARKED * 2]
    assert ids.tolist() == [i for w in want for i in w]


def test_special_tokens_with_marks_in_tables(spark):
    tokenizer = Tokenizer.from_file(Q.TOKENIZER)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(MARKED * 3)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: list(r.ids) for r in bpe_encode(docs, Q.TOKENIZER).collect()}
    assert got == {k: tokenizer.encode(t, add_special_tokens=False).ids for k, t in enumerate(MARKED * 3)}
