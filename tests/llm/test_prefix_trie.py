"""The trie and its totals against dictionaries of prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from opsmetrics.llm import prefix_trie
from opsmetrics.llm.queries import id_bucket
from opsmetrics.session import stage


def digest(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def plain_report(convs):
    """`convs`: id -> [(role, text)]."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = own + sum(saved[k] for k in kids.get(p, []))
    return sorted(((
        min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
        digest([c for c in m if len(convs[c]) == len(p)])) for p, m in members.items()), key=str)


def plain_graft(convs):
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + convs[c][h:]
    return out


def rows_of(convs):
    return [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]


def found(df, graft=True):
    turns = prefix_trie.turns(df)
    if graft:
        ids, rows = prefix_trie.grafted(turns, F.col("conv_id") - F.col("conv_id") % 100, id_bucket("conv_id", 6), 5)
    else:
        ids, rows = turns.select("conv_id").distinct(), turns
    return sorted((tuple(r) for r in prefix_trie.report(ids, rows).collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture
def convs():
    rng = random.Random(2)
    turn = lambda: (rng.choice(["user", "assistant", ""]), rng.choice(["", "é", "a b", "hello", "x" * 50]))
    out = {c: [turn() for _ in range(rng.randrange(1, 9))] for c in rng.sample(range(400), 60)}
    long = [turn() for _ in range(70)]
    out |= {500: long, 501: long[:60] + [turn()], 502: long[:33], 503: long, 504: [("user", "only")]}
    return out


def test_report_of_rebuilt_conversations(spark, convs, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "IDS", 2)
    df = spark.createDataFrame(rows_of(convs), SCHEMA).withColumns({"node": F.lit(1), "depth": F.lit("x"), "pos": F.lit(0)})
    assert found(df) == plain_report(plain_graft(convs))


def test_copies_nulls_and_ties(spark):
    rows = [(c, None, "user", "hi") for c in range(20, 40)] + [(1, 0, None, None), (1, 1, "b", "y"), (1, 1, "a", "z"), (1, None, "u", "first"),
            (2, 5, "u", "first"), (2, 6, "", ""), (None, 0, "user", "nobody's")]
    convs = {c: [("user", "hi")] for c in range(20, 40)} | {1: [("u", "first"), ("", ""), ("a", "z"), ("b", "y")], 2: [("u", "first"), ("", "")]}
    assert found(spark.createDataFrame(rows, SCHEMA), graft=False) == plain_report(convs)
    assert found(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("seed", range(2))
def test_totals_of_random_forests(spark, seed):
    rng = random.Random(seed)
    parent, depth = {0: None, 1: None}, {0: 0, 1: 0}
    for v in range(2, 250):
        # chains, stars and lone roots
        p = v - 1 if rng.random() < 0.8 else rng.choice([0, 0, rng.randrange(v)])
        parent[v], depth[v] = p, depth[p] + 1
    leaves, saved = {v: rng.randrange(3) for v in parent}, {v: rng.randrange(100) for v in parent}
    want = {v: [leaves[v], saved[v]] for v in parent}
    for v in sorted(parent, key=lambda v: -depth[v]):
        if parent[v] is not None:
            want[parent[v]][0] += want[v][0]
            want[parent[v]][1] += want[v][1]
    df = spark.createDataFrame([(v, p, depth[v], leaves[v], saved[v]) for v, p in parent.items()],
                               "node long, parent long, depth long, leaves long, saved long")
    got = {r.node: [r.leaves, r.saved] for r in stage(prefix_trie.subtree_totals(df), "totals").collect()}
    assert got == want
