import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opsmetrics.llm.mixing import fit_budget, knapsack, mix, plan_mix
from opsmetrics.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), min_size=1, max_size=4), st.integers(0, 60))
def test_knapsack_is_the_best_subset(counts, budget):
    sizes, n = np.array(list(counts)), np.array(list(counts.values()))
    off = min(abs(int(sizes @ np.array(t)) - budget) for t in product(*(range(c + 1) for c in n)))
    take = knapsack(sizes, n, budget)
    assert (take <= n).all() and (take >= 0).all() and abs(int(sizes @ take) - budget) == off


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 5000), st.integers(1, 40), min_size=1, max_size=30), st.floats(0, 1), st.sampled_from([0, 50, 1 << 16]))
def test_fit_is_near(counts, share, dp):
    sizes, n = np.array(list(counts)), np.array(list(counts.values()))
    budget = int(share * int(sizes @ n))
    take = fit_budget(sizes, n, budget, dp)
    assert (take <= n).all() and (take >= 0).all()
    left = sizes[(take < n) & (sizes > 0)]
    assert not len(left) or budget - int(sizes @ take) < left.min()  # no document more would come nearer
    assert int(sizes @ take) - budget <= sizes.max() / 2


def expected_targets(size_of, weights=(5, 2, 1), ratio=1.5, cap=2.0):
    names = sorted(size_of, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total = ratio * sum(size_of.values())
    share, free = {s: total * w[s] / sum(w.values()) for s in names}, set(names)
    while over := [s for s in free if share[s] > cap * size_of[s] * (1 + 1e-12)]:
        excess = sum(share[s] - cap * size_of[s] for s in over)
        for s in over:
            share[s] = cap * size_of[s]
        free -= set(over)
        for s in free:
            share[s] += excess * w[s] / sum(w[f] for f in free)
    return share


def test_query_against_the_rules(spark, table):
    size, of = {}, {}
    for i, source, text in table("documents", "doc_id, source, text"):
        size[i], of[i] = len(WORD.findall(text or "")), source
    totals = Counter()
    for i in size:
        totals[of[i]] += size[i]
    want, taken = expected_targets(totals), Counter()
    rows = QUERIES["op6_source_mix"](spark, SF).collect()
    assert {r.doc_id: r["size"] for r in rows} == size
    for r in rows:
        assert r.target == pytest.approx(want[of[r.doc_id]]) and r.source_size == totals[of[r.doc_id]]
        assert 0 <= r.taken <= 2 * r["size"]
        taken[of[r.doc_id]] += r.taken
    for s in totals:
        assert abs(taken[s] - want[s]) <= 60  # some sources have seven documents
    again = QUERIES["op6_source_mix"](spark, SF).collect()
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again}


def test_null_source_empty_texts_and_repeats(spark, docs):
    df = docs([(1, "a b c", None, "x"), (1, "a b c", None, "x"), (2, None, None, None), (None, " ", None, None), (3, "a\fb", None, None), (4, "", None, "é")],
              size=1, id=2, source_id=3, copies=4)
    plan = plan_mix(df).collect()
    assert sorted(((r.id or 0, r.source, r["size"], r.source_size) for r in plan), key=str) == sorted(
        [(1, "x", 3, 6), (1, "x", 3, 6), (2, None, 0, 2), (0, None, 0, 2), (3, None, 2, 2), (4, "é", 0, 0)], key=str)
    mixed = mix(df)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect())[1] == sum(r.copies for r in plan if r.id == 1)


def test_the_mix_repeats_rows_as_planned(spark, docs, table):
    df = docs(table("documents", "doc_id, text, lang, source, n_chars"))
    plan = Counter({r.id: r.copies for r in plan_mix(df).collect() if r.copies})
    assert Counter(r.doc_id for r in mix(df).select("doc_id").collect()) == plan


def test_empty_table(docs):
    assert plan_mix(docs([])).count() == 0 and mix(docs([])).count() == 0
