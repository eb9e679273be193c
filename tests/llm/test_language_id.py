import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsmetrics.llm.byte_ngrams import ngram_counts
from opsmetrics.llm.language_id import UNDETERMINED, Settings, fit, predict, subwords, train
from opsmetrics.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RED, BLUE = "rouge vert bleu maison " * 5, "blau und haus gruen " * 5


def small_model():
    texts = [RED, BLUE] * 20
    return train(np.stack([subwords(t) for t in texts]), ["fr", "de"] * 20, Settings(epochs=4))


def test_counts_in_pieces_are_those_of_the_whole(monkeypatch):
    from opsmetrics.llm import byte_ngrams

    data, symbols = bytes(range(256)) * 5 + b"the end", np.arange(256, dtype=np.uint8) * np.array([b % 7 > 0 for b in range(256)])
    for table in (None, symbols):
        whole = [ngram_counts(data[:n], (2, 3, 4), 10, table) for n in (0, 1, 2, 3, 1287)]
        for piece in (1, 2, 5, 64, 1286):
            monkeypatch.setattr(byte_ngrams, "PIECE", piece)
            assert all((ngram_counts(data[:n], (2, 3, 4), 10, table) == w).all() for n, w in zip((0, 1, 2, 3, 1287), whole, strict=True))
            monkeypatch.undo()


def test_count_of_ngrams():
    assert ngram_counts(b"abc", (3,), 8).sum() == 3  # " ab", "abc", "bc "
    symbols = np.array([b if chr(b).isalpha() else 0 for b in range(256)], dtype=np.uint8)
    assert ngram_counts(b"ab cd", (3,), 8, symbols).sum() == 4  # ".ab", "ab.", ".cd", "cd."


def test_model_learns_and_rejects():
    model = small_model()
    assert model.langs == ("de", "fr")
    assert model.predict("la maison rouge")[0] == "fr" and model.predict("und das haus")[0] == "de"
    for text in (None, "", " 12 - 3!", "\n"):
        assert model.predict(text) == (UNDETERMINED, 0.0, False)
    lang, score, accepted = model.predict("é")
    assert lang in model.langs and 0 <= score <= 1
    assert (model.logits == small_model().logits).all()


def test_nothing_to_learn_from(docs):
    df = docs([(1, "text", None), (2, None, "en")], id=1, lang_pred=2, score=3)
    got = predict(df, fit(df)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [(UNDETERMINED, 0.0)] * 2
    assert predict(docs([]), small_model()).count() == 0


def test_nulls_repeats_and_the_bound(docs):
    rows = [(i % 50, (RED, BLUE)[i % 2], ("fr", "de")[i % 2]) for i in range(200)] + [(None, RED, "fr"), (60, None, "fr"), (61, RED, None), (62, "x" * 3_000_000, "de")]
    df = docs(rows)
    model = fit(df, settings=Settings(sample=20, epochs=3))
    got = predict(df, model).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.id == 60} == {UNDETERMINED}


def test_too_many_labels_are_an_error(docs):
    with pytest.raises(ValueError):
        fit(docs([(i, RED, f"l{i}") for i in range(6)]), settings=Settings(most_langs=5))


def test_held_out_accuracy_and_labels_unseen(spark, table):
    langs = dict(table("documents", "doc_id, lang"))
    got = QUERIES["op1_language_id"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(langs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.95


def test_held_out_rows_do_not_change_the_model(spark, table):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    spoiled = df.withColumn("lang", F.when(learn, F.col("lang")).otherwise("zz")).withColumn("text", F.when(learn, F.col("text")).otherwise("q"))
    a, b = fit(df, learn), fit(spoiled, learn)
    assert a.langs == b.langs and np.allclose(a.logits, b.logits)


def plain_prediction(model, text):
    """Mean of the subwords' logits, softmax, best, one n-gram at a time."""
    data = [0] + [b if b > 127 or chr(b).isalpha() else 0 for b in text.lower().encode()] + [0]
    sums, n = [0.0] * len(model.langs), 0
    for order in (2, 3):
        for i in range(len(data) - order + 1):
            gram = data[i:i + order]
            if all(gram[1:-1]):
                packed = order
                for b in gram:
                    packed = (packed << 8 | b) & 0xFFFFFFFF
                bucket = (packed * 2654435761 & 0xFFFFFFFF) >> 19
                sums = [s + float(x) for s, x in zip(sums, model.logits[bucket], strict=True)]
                n += 1
    logits = [s / max(n, 1) + float(b) for s, b in zip(sums, model.bias, strict=True)]
    top = max(logits)
    parts = [np.exp(x - top) for x in logits]
    best = int(np.argmax(parts))
    score = parts[best] / sum(parts)
    return model.langs[best], score, bool(score >= model.reject_below)


def test_at_most_the_sample_reaches_the_driver(spark, docs):
    """One id on many rows counts once; and the prediction is the forward pass of the definition."""
    from opsmetrics.llm import language_id as lid

    rows = [(i, f"{'der die das und' if i % 2 else 'the and of to'} {i} word{i}", "de" if i % 2 else "en") for i in range(300)]
    rows += [(7, f"der die das {k}", "de") for k in range(500)]
    settings = lid.Settings(sample=200)
    counts, langs = lid._labelled_counts(docs(rows), F.lit(True), settings, "doc_id", "text", "lang")
    assert 100 < len(counts) <= 200 and len(langs) == len(counts)
    model = lid.train(counts, langs, settings)
    got = lid.predict(docs(rows[:40]), model).collect()
    for r, (_, text, _) in zip(sorted(got, key=lambda r: r.id), rows[:40], strict=True):
        lang, score, ok = plain_prediction(model, text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-5 and r.accepted == ok
