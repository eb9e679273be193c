"""Signatures against the definition, classes against all pairs."""

import random

import numpy as np
import pytest

from opsmetrics.llm import superminhash_dedup as smh
from opsmetrics.llm.components import roots

ALL = (1 << 64) - 1


def plain_mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ALL
    return x ^ (x >> 31)


def plain_signature(elements, slots):
    """Every element walks its whole permutation."""
    best = [ALL] * slots
    for e in map(int, elements):
        place = list(range(slots))
        for j in range(slots):
            x = plain_mix((e + (j + 1) * 0x9E3779B97F4A7C15) & ALL)
            k = j + (((x & 0xFFFFFFFF) * (slots - j)) >> 32)
            place[j], place[k] = place[k], place[j]
            best[place[j]] = min(best[place[j]], (j << 32) | (x >> 32))
    return best


@pytest.mark.parametrize("slots", [7, 160])
def test_signatures(slots, monkeypatch):
    monkeypatch.setattr(smh, "ELEMENTS", 64)  # several blocks a set, several sets a block
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64)) for n in (1, 2, 0, 40, 300, 5)]
    for got, s in zip(smh.signatures(sets, slots), sets, strict=True):
        assert got.tolist() == plain_signature(s, slots)


def test_the_estimate():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        x = rng.integers(0, 2 ** 63, 200).astype(np.uint64)
        a, b = smh.signatures([x[:150], x[50:]])
        errors.append((a == b).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_classes(rows):
    """(id, n, component) per row; rows are (id, text)."""
    sets = [plain_set(t) for _, t in rows]
    name = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    out = []
    for (i, _), s, n in zip(rows, sets, name, strict=True):
        ids = [r[0] for r, m in zip(rows, name, strict=True) if m == n and r[0] is not None]
        out.append((i, len(s), min(ids, default=None) if s else i))
    return sorted(out, key=str)


def families(seed):
    """Copies, near copies in chains and around the limit, texts that share much but too little."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, i = [], 0
    for size in (12, 80, 400):
        base = [word() for _ in range(size)]
        text = list(base)
        for _ in range(14):
            rows.append((i, " ".join(text)))
            i += 1
            at = rng.randrange(len(text))
            text[at] = word()  # a chain: each link near, the ends far
        for _ in range(10):
            some = list(base)
            for at in rng.sample(range(size), max(1, size // 40)):
                some[at] = word()
            rows.append((i, " \n".join(some)))
            i += 1
        rows += [(i, " ".join(base)), (i + 1, " ".join(base).upper())]
        i += 2
    rows += [(i, None), (i + 1, " \t"), (i + 2, "one two"), (i + 3, "One  two"), (None, rows[3][1]), (None, "quite alone here it is now"),
             (3, "a text under a used id of its own")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_classes_against_all_pairs(spark, docs, block, monkeypatch):
    monkeypatch.setattr(smh, "BLOCK", block)
    rows = families(block)
    df = docs(rows, row=1, uid=2, n=3, id="x", key=4, root=5)
    got = sorted((tuple(r) for r in smh.clusters(df).collect()), key=str)
    assert got == plain_classes(rows)


def test_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, roots(smh.forest(df)).collect())) == sorted(map(tuple, roots(df).collect()))
    assert smh.clusters(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_very_long_text(spark, docs):
    text = " ".join(f"w{i % 70000}x{i}" for i in range(300_000))
    rows = [(1, text), (2, text + " tail"), (3, "x" * 3_000_000)]
    assert sorted(map(tuple, smh.clusters(docs(rows)).collect())) == [(1, 299_996, 1), (2, 299_997, 1), (3, 1, 3)]
