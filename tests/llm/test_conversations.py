"""Prefix tries and repair of conversations against brute force, on given and on odd rows."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gridloom.llm import dialogue, queries as Q, trie, turns
from tests.compare import connection, difference

SCHEMA = "conv_id long, turn long, role string, text string, pos long, depth string, conv string"
ODD = [
    (0, 0, "user", "a b."), (0, 1, "assistant", "c!"), (0, None, "system", "s."), (5, 0, None, None), (5, 1, "user", ""), (5, 1, "user", ""), (7, 3, "assistant", "x" * 200_000),
    (None, 0, "user", "nobody."), (None, None, None, None), (21, 0, "user", "a b."), (22, 0, "user", "a b."), (22, 1, "assistant", "c!"), (23, 9, "", "?"), (24, 0, "Üser", " \t\n."), (24, 1, "robot", "é…"),
    (60, 0, "user", "only"), (61, 0, "user", "only"), (61, 2, "user", "two words"), (-20, 0, "user", "minus."), (-3, 0, "assistant", "minus three"),
]


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA)


def _random(seed, n=400):
    pick = random.Random(seed)
    texts, roles = ["Yes.", "no", "", "  ", "why?", "ok!\n", "two words"], ["user", "assistant", "system", "user", "assistant", None, "tool"]
    return [(pick.choice([0, 1, 2, 3, 20, 21, 40, 55]), pick.choice([None, *range(12)]), pick.choice(roles), pick.choice([None, *texts])) for _ in range(n)]


# ---- tries
def _plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = int(c - np.fmod(c, 20))  # the remainder has the sign of c, as in SQL
        whole[c] = tuple(own.get(donor, [])[:h] + v[h:])
    nodes = collections.defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    out = {}
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        saved = sum((len(nodes[p]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) for p in below if p)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in below)
        ends = sorted(c for c in members if whole[c] == path)
        children = sum(len(q) == len(path) + 1 for q in below)
        out[min(members), len(path)] = (min(nodes[path[:-1]]) if path else None, len(members), children, leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def _trie(spark, rows):
    got = trie.prefix_trie(*trie.rebuilt(_table(spark, rows))).collect()
    assert len(got) == len({(r[0], r[1]) for r in got})
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}


@pytest.mark.parametrize("rows", [ODD, _random(1), [(c, t, "user", f"{t}") for c in range(3) for t in range(70)]], ids=["odd", "random", "chains"])
def test_trie_is_the_plain_one(spark, rows):
    assert _trie(spark, rows) == _plain_trie(rows)


def test_trie_of_nothing(spark):
    assert _trie(spark, []) == {} and _trie(spark, [(None, 1, "user", "x")]) == {}


def test_subtree_totals_of_random_trees(spark):
    pick, n = random.Random(4), 300
    up = [None] + [pick.choice((k - 1, pick.randrange(k))) if pick.random() < 0.9 else max(0, k - 1) for k in range(1, n)]
    value = [pick.randrange(100) for _ in range(n)]
    nodes = spark.createDataFrame([(k, 0, up[k], None if up[k] is None else 0, value[k], 1) for k in range(n)], "c long, d long, pc long, pd long, v long, one long")
    want = [[value[k], 1] for k in range(n)]
    for k in reversed(range(1, n)):
        want[up[k]][0] += want[k][0]
        want[up[k]][1] += want[k][1]
    got = {r.c: [r.v, r.one] for r in trie.subtree_totals(nodes, ["v", "one"]).collect()}
    assert [got[k] for k in range(n)] == want


def test_numbers_of_long_groups(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("IF(id % 3 = 0, 1, id) AS g", "5000 - id AS t", "id AS i")
    got = turns.numbered(rows, "g", ["t", "i"]).where("g = 1").orderBy("t").collect()
    assert [r.pos for r in got if r.i % 3 == 0 or r.i == 1] == list(range(1, 1669))
    monkeypatch.setattr(trie, "CHUNK_TURNS", 4)
    long = [(c, t, "user", "w " * (t % 3)) for c in (1, 2) for t in range(40)]
    assert _trie(spark, long) == _plain_trie(long)


# ---- repair
def _damage(rows):
    out = collections.defaultdict(list)
    for c, turn, role, text in rows:
        key = " " if c is None else str(c)
        kind = zlib.crc32(f"{key}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[key] += [(turn is not None, turn or 0, role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v) for c, v in out.items()}


def _plain_repair(damaged_turns):
    rows = [(t if known else None, role, text) for known, t, role, text in damaged_turns]
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    goes = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, q, inserted):
        """(cost, audit, lines) from row i on in state q, of all edits with at most three inserts in a row."""
        found = [(0, "", ())] if i == len(rows) and q in (0, 3) else []
        if inserted < 3:
            for letter in "ua":
                if letter in goes[q]:
                    c, a, t = best(i, goes[q][letter], inserted + 1)
                    found.append((c + 3, "I" + a, (names[letter] + ":", *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, q, 0)
            found.append((c + 4, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                late = 3 * (faults[i] == "truncated")
                if role[:1] in goes[q]:
                    c, a, t = best(i + 1, goes[q][role[0]], 0)
                    found.append((c + late, "K" + a, (f"{role}:{text}", *t)))
                for letter in "ua":
                    if letter in goes[q]:
                        c, a, t = best(i + 1, goes[q][letter], 0)
                        found.append((c + late + 3, "R" + a, (f"{names[letter]}:{text}", *t)))
        return min(found, default=(10**9, "", ()))

    cost, audit, lines = best(0, 0, 0)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def _repair(spark, rows, size=256, passes=8):
    df = _table(spark, rows)
    got = dialogue.dialogue_repair(df, dialogue.damaged(df), size, passes).collect()
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got}


#: Runs of turns that are all deleted, or leave the differences of the costs as they are, and a turn that matters at the end.
STUBBORN = [(1, t, "user", "same.") for t in range(60)] + [(1, 70, "assistant", "end.")] + [(2, t, " ", f"no end {t}") for t in range(60)] + [(2, 70, "assistant", "end.")]


@pytest.mark.parametrize("rows,size,passes", [(ODD, 256, 8), (ODD, 3, 0), (_random(2), 256, 8), (_random(2), 3, 8), (_random(2), 3, 1), (_random(3, 90), 2, 0), (STUBBORN, 4, 2), (STUBBORN, 4, 99)])
def test_repair_is_the_plain_one(spark, rows, size, passes):
    left = _damage(rows)
    want = {c: _plain_repair(left.get(" " if c is None else str(c), [])) for c in {r[0] for r in rows}}
    assert _repair(spark, rows, size, passes) == want


def test_repair_of_nothing(spark):
    assert _repair(spark, []) == {}


def test_fix_ups_find_what_one_pass_finds():
    """Chunks with speculative ends, mended until nothing changes, against costs of the whole sequence."""
    pick, rounds = np.random.default_rng(7), []
    for odds in ([1] * 12, [0, 5, 5, 0, 0, 1, 1, 0, 0, 0, 0, 0], [0, 0, 0, 0, 9, 1, 1, 0, 9, 1, 1, 0]):
        codes = pick.choice(12, 600, p=np.array(odds) / sum(odds))
        whole = dialogue._costs(codes[None, :], dialogue._END[None, :])
        parts = [codes[k : k + 50][None, :] for k in range(0, 600, 50)]
        edges = [dialogue.packed(dialogue._END[None, :])] * 12
        found = [dialogue.packed(dialogue._costs(p, dialogue.unpacked(e))[0]) for p, e in zip(parts, edges, strict=True)]
        for rounds_taken in range(13):
            stale = [k for k in range(11) if edges[k] != found[k + 1]]
            if not stale:
                break
            now = {k: (found[k + 1], dialogue.fix_up(parts[k], edges[k], found[k + 1], found[k])) for k in stale}
            for k, (edge, out) in now.items():
                edges[k], found[k] = edge, out
        rounds.append(rounds_taken)
        assert [x[0] for x in found] == [dialogue.packed(whole[k])[0] for k in range(0, 600, 50)]
    assert rounds[0] <= 2 and rounds[1] <= 2


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_dialogue_repair"])
def test_conversation_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert difference(spark, connection(sf), Q.queries()[name], Q.oracle_sql()[name], sf) is None
