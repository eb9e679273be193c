"""The manifest against a plain tree of lists."""

import hashlib
import random

import pytest

from opsmetrics.llm.merkle import fold, leaves, manifest, proof_digest

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(hashes, fan):
    """The root, and per leaf the (left, right) siblings level by level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        runs = [level[i:i + fan] for i in range(0, len(level), fan)]
        for leaf, node in enumerate(at):
            run, slot = runs[node // fan], node % fan
            paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1:])))
        level, at = [sha(*r) for r in runs], [n // fan for n in at]
    return level[0], paths


def plain_manifest(rows, fan):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    out, roots, per = [], [], []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        root, paths = plain_tree([plain_leaf(r) for r in mine], fan)
        roots.append(root)
        per.append((mine, paths))
    top, ways = plain_tree(roots, fan)
    for (mine, paths), sub, way in zip(per, roots, ways, strict=True):
        out += [(r[0], plain_leaf(r), sub, top, p + way) for r, p in zip(mine, paths, strict=True)]
    return sorted(out, key=str)


def random_rows(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot", "hot", "a", "é", "b", None, "", *(f"s{k}" for k in range(9))]), rng.choice([None, "en"]), None,
             rng.choice([None, "", "x", "line\nline é", "z" * 3000])) for i in rng.sample(range(10 * n), n)]


def shuffled_rows(rows):
    out = [(i, text, lang, source, n) for i, source, lang, n, text in rows]
    random.Random(5).shuffle(out)
    return out


@pytest.mark.parametrize(("fan", "depth", "n"), [(3, 1, 40), (3, 2, 150), (3, 7, 60), (2, 2, 50), (4, 1, 40)])
def test_against_the_plain_tree(spark, docs, fan, depth, n):
    rows = random_rows(n, fan + depth)
    df = docs(shuffled_rows(rows), row=1, path="x", root=2, leaf="y", g=3, pos=4, seq=5, grp=6)
    found = manifest(leaves(df, COLUMNS), fan, depth).select("id", "leaf", "subroot", "root", "path")
    got = sorted(((r[0], r[1], r[2], r[3], [(x.left, x.right) for x in r[4]]) for r in found.collect()), key=str)
    assert got == plain_manifest(rows, fan)
    folded = manifest(leaves(df, COLUMNS), fan, depth)
    bad = folded.where(fold(folded["leaf"], folded["path"]) != folded["root"])
    assert bad.count() == 0
    proofs = dict(folded.select("id", proof_digest(folded["path"])).collect())
    assert proofs == {r[0]: sha("".join(a + b for a, b in r[4])) for r in got}


def test_ties_repeats_nulls_and_alone(spark, docs):
    rows = [(None, "s", None, None, "t"), (None, "s", None, None, "t"), (4, "s", None, None, "b"), (4, "s", None, None, "a"), (1, None, None, None, None)]
    found = manifest(leaves(docs(shuffled_rows(rows)), COLUMNS)).collect()
    got = sorted(((r.id, r.leaf, r.subroot, r.root, [(x.left, x.right) for x in r.path]) for r in found), key=str)
    assert got == plain_manifest(rows, 3)
    one = manifest(leaves(docs([(7, "x")]), COLUMNS)).first()
    assert one.leaf == one.subroot == one.root == plain_leaf((7, None, None, None, "x")) and one.path == []
    assert manifest(leaves(docs([]), COLUMNS)).count() == 0


def test_a_change_shows(spark, docs):
    from pyspark.sql import functions as F

    df = docs([(i, f"text\n{i}" if i % 2 else f"text {i}", "en", "s", 1) for i in range(20)])
    rows = leaves(df, COLUMNS, altered={"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))})
    found = manifest(rows)
    holds = {r[0]: r[1] for r in found.select("id", fold(found["altered"], found["path"]) == found["root"]).collect()}
    assert holds == {i: i % 2 == 0 for i in range(20)}
