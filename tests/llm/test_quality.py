import zlib

import numpy as np
import pytest

from opsmetrics.llm.quality import Model, Settings, fit, keep_good, score, term_counts, train
from opsmetrics.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_terms():
    assert term_counts(None).sum() == term_counts(" \n").sum() == 0
    assert term_counts("a a b")[-1] == 0.5
    assert term_counts("x y " * 900_000)[:-1].sum() == len("x y " * 900_000)


def test_votes_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    counts = rng.poisson(1.0, (60, term_counts("").size)).astype(np.float32)
    labels = (np.arange(60) % 3 > 0).astype(float)
    model = train(counts, labels, Settings(length=8, neighbours=5))
    new = rng.poisson(1.0, (7, counts.shape[1])).astype(np.float32)
    for row, got in zip(new, model.score(new), strict=True):
        v = model.embed(row[None])[0]
        cosine = [(float(v @ w), y) for w, y in zip(model.vectors, labels, strict=True)]
        near = sorted(cosine, reverse=True)[:5]
        votes = [(max(c, 0) ** 4 * (0.5 / labels.mean() if y else 0.5 / (1 - labels.mean())), y) for c, y in near]
        assert got == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), rel=1e-3)


def test_no_labels_one_label_and_unknown_texts():
    empty = train(np.zeros((0, term_counts("").size), np.float32), np.zeros(0))
    assert isinstance(empty, Model) and list(empty.score(term_counts("a b")[None])) == [0.5]
    one = train(np.stack([term_counts("some words here"), term_counts("other words there")]), np.ones(2), Settings(length=2))
    assert one.score(term_counts("some words")[None])[0] == 1 and one.score(term_counts("")[None])[0] == 0.5


def test_rows_nulls_and_clashing_columns(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None), (99, 1)], "doc_id long, quality int")
    df = docs([(1, "clean words of prose"), (2, "$$$ &&& %%% ###"), (2, "$$$ &&& %%% ###"), (None, "clean words"), (5, None)],
              row="r", text_2=1, score=2, id=3)
    model = fit(df, labels)
    assert sorted(model.labels) == [0, 1]
    got = score(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    kept = keep_good(df, model, 0.3)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.row, r.score) for r in kept.collect()) == [(0, "r", 2), (1, "r", 2), (5, "r", 2)]
    assert score(docs([]), model).count() == 0 and keep_good(docs([]), model, 0.3).count() == 0
    assert fit(docs([]), labels).labels.size == 0


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op9_quality"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in quality]
    good = [r.predicted for r in held if quality[r.doc_id]]
    bad = [r.predicted for r in held if not quality[r.doc_id]]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.25


def test_at_most_the_sample_reaches_the_driver(spark, docs, monkeypatch):
    """A labelled id that stands on very many rows is one text to learn from."""
    from opsmetrics.llm import quality

    seen = []
    monkeypatch.setattr(quality, "train", lambda counts, labels, settings: seen.append(len(counts)))
    df = docs([(i, f"text number {i}") for i in range(300)] + [(5, f"again {k}") for k in range(600)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    quality.fit(df, labels, settings=Settings(sample=100))
    quality.fit(df, labels, settings=Settings(sample=1000))
    assert seen == [200, 300]
