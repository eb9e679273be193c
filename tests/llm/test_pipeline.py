from collections import Counter, defaultdict

from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from opsmetrics.llm.queries import GOOD_FROM, QUERIES, TOKENIZER
from opsmetrics.session import stage

SF = "/root/testdata/sf0.001"


def test_each_stage_against_its_operator_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    after = {}
    for name, step in pipeline.STAGES:
        out = stage(step(spark, docs, SF), "test")
        after[name] = out.collect()
        if name != "best-fit packing":
            assert out.columns == docs.columns
            docs = out
    good = {r.doc_id for r in QUERIES["op9_quality"](spark, SF).collect() if r.score >= GOOD_FROM}
    assert {r.doc_id for r in after["quality classifier"]} == good and len(after["quality classifier"]) == len(good)

    first = {}
    for i in sorted(good):
        first.setdefault(" ".join(text[i].split()) if text[i].split() else text[i], i)
    exact = [r.doc_id for r in after["exact dedup"]]
    assert sorted(exact) == sorted(first.values())

    near = [r.doc_id for r in after["simhash near-dedup"]]
    assert len(set(near)) == len(near) and set(near) <= set(exact)

    mixed = Counter(r.doc_id for r in after["mixing sources"])
    assert set(mixed) <= set(near) and max(mixed.values()) <= 2

    tokenizer, copies, places = Tokenizer.from_file(TOKENIZER), Counter(), defaultdict(list)
    for r in after["best-fit packing"]:
        copies[r.doc_id, r.piece] += 1
        places[r.sequence_id].append((r.offset, r.length))
    want = {(i, p): n for i, n in mixed.items()
            for p in range(-(-(len(tokenizer.encode(text[i], add_special_tokens=False).ids) + 1) // 4096))}
    assert copies == want
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))]


def test_run_is_registered_and_gives_the_last_stage(spark):
    import __spark_entry__ as entry

    out = entry.queries()["pipeline"](spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()


CLASHES = {"id": 1, "row": 2, "digest": "x", "copy": 3, "fp": 4, "size": 5, "seq": 6, "piece": "p", "keep_id": 7, "number": 8}


def test_stages_with_null_ids_long_texts_and_clashing_columns(spark, docs):
    """Every stage keeps all columns as they are; clean documents without an id go through all of them."""
    words = " ".join(f"word{i}" for i in range(400))
    rows = [(i, f"a document of its own number {i} about topic {i * 7919} " * 3, "en", f"src{i % 3}", 1) for i in range(30)]
    rows += [(None, words, "en", None, 1), (None, "another text without an id " + words[:300], "en", "src1", 1), (40, None), (41, ""), (41, ""),
             (50, "word " * 300_000, "en", "src2", 1), (3, "a second text under an id that is used " + words[500:900], "en", "src0", 1)]
    df = docs(rows, **CLASHES)
    for name, step in pipeline.STAGES[1:]:
        out = stage(step(spark, df, SF), "edges")
        if name != "best-fit packing":
            assert out.columns == docs(rows, **CLASHES).columns
            ids = Counter(r.doc_id for r in out.select("doc_id").collect())
            assert ids[None] >= 2 and set(range(30)) <= set(ids), name
            assert out.where("digest = 'x' AND piece = 'p' AND number = 8").count() == out.count()
        df = out
    assert df.where("doc_id IS NULL").count() >= 2 and df.agg({"length": "max"}).first()[0] == 4096


def test_stages_over_an_empty_table(spark, docs):
    df = docs([], **CLASHES)
    for name, step in pipeline.STAGES:
        df = stage(step(spark, df, SF), "empty")
        assert df.count() == 0, name
