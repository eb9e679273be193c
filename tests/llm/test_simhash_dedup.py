import random

import numpy as np
import xxhash

from opsmetrics.llm.components import roots
from opsmetrics.llm.queries import QUERIES
from opsmetrics.llm.simhash_dedup import components, covering_masks, fingerprint, keep_one, linked, word_runs

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [words[i:i + 3] for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest id reachable over all pairs that differ in at most two bits."""
    ids = sorted(prints)
    name = {i: i for i in ids}
    while True:
        new = {i: min(name[j] for j in ids if (prints[i] ^ prints[j]).bit_count() <= 2) for i in ids}
        if new == name:
            return name
        name = new


def test_fingerprints():
    for text in (None, "", " \n", "one", "Two WORDS", "a b c", "É é A b c d", "x " * 1000, "\x1c a\x0bb c"):
        assert fingerprint(text) == plain_fingerprint(text)
    assert fingerprint("A b\tc") == fingerprint("a B c") != fingerprint("É b c")


def test_long_texts_in_pieces():
    rng = random.Random(1)
    text = "".join(rng.choice(["ab ", "c", "  d\n", "xyz"]) for _ in range(3000)).encode()
    for piece in (1, 2, 7, 1000):
        assert [w for run in word_runs(text, piece) for w in run] == text.split()


def test_every_close_pair_collides():
    masks = covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)


def cloud(n, seed):
    """Fingerprints in chains and clumps, of few free bits, so that buckets are crowded."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for _ in range(8):
        f = rng.getrandbits(64)
        for _ in range(n):
            f ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            out.add(f)
    base = rng.getrandbits(64)
    out |= {base ^ rng.getrandbits(7) for _ in range(60)}
    return out


def test_linked_pairs_against_brute_force(spark):
    prints = sorted(cloud(12, 3))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = plain_components(dict(zip(signed, prints, strict=True)))
    for compared in (256, 4, 1):  # pairs; both ways; neighbour keys for all buckets
        edges = linked(df, compared=compared)
        for a, b in edges.collect():
            assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
        found = {r.node: r.root for r in roots(edges).collect()}
        assert {x: found.get(x, x) for x in signed} == want


def test_roots_of_a_long_chain_and_loops(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 500), (7, 7), (300, 299), (301, 300), (300, 301)]
    found = {r.node: r.root for r in roots(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, 300: 299, 301: 299}
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark, table):
    texts = dict(table("documents", "doc_id, text"))
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    name = plain_components(prints)
    got = {r.doc_id: r for r in QUERIES["op7_simhash_dedup"](spark, SF).collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == name


def test_near_copies_nulls_and_repeats(spark, docs):
    words = " ".join(f"w{i}" for i in range(3000))
    df = docs([(9, words), (4, words + " tail"), (7, None), (3, "  "), (3, ""), (None, words), (None, "alone here now"), (8, "other words here")],
              fp=1, id=2, kept_id=3, copy=4, component_id=5)
    got = sorted(((r.id or 0, r.component_id) for r in components(df).collect()), key=str)
    assert got == sorted([(9, 4), (4, 4), (7, 3), (3, 3), (3, 3), (0, 4), (0, None), (8, 8)], key=str)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 8]
    assert components(docs([])).count() == 0 and keep_one(docs([])).count() == 0


def test_texts_that_stay(spark, docs):
    """Ids are null or stand on several texts: each component keeps a row of its own all the same."""
    words = " ".join(f"w{i}" for i in range(3000))
    df = docs([(4, words), (None, words + " tail"), (None, "alone here now"), (None, "unrelated and without id"),
               (None, "unrelated and without id"), (5, "one text of id five"), (5, "quite another text under it"), (6, None), (6, "")])
    got = sorted((r.doc_id or 0, r.text or "") for r in keep_one(df).collect())
    assert got == sorted([(4, words), (0, "alone here now"), (0, "unrelated and without id"),
                          (5, "one text of id five"), (5, "quite another text under it"), (6, "")])
