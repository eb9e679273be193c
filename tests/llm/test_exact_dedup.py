from opsmetrics.llm.exact_dedup import DigestIndex, add_batch, keep_first

CLASHES = {"id": 1, "digest": "x", "kept": True, "row": 2, "copy": 3}


def decide(docs, index, rows):
    return sorted((r.id if r.id is not None else -1, r.keep_id, r.group_size, r.kept) for r in add_batch(docs(rows, **CLASHES), index).collect())


def test_groups_nulls_ties_and_repeats(spark, docs, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4).open()
    got = decide(docs, index, [(3, "a  b"), (1, "a\tb"), (2, "a b "), (5, None), (4, ""), (7, "c"), (7, "c"), (None, "d"), (9, " ")])
    assert got == [
        (-1, None, 1, True), (1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False), (4, 4, 2, True), (5, 4, 2, False),
        (7, 7, 2, False), (7, 7, 2, True), (9, 9, 1, True)]


def test_the_index_persists_and_grows(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    first = DigestIndex(spark, path, 4).open()
    decide(docs, first, [(1, "a"), (2, "b")])
    spark.sql(f"DROP TABLE {first.table}")  # another session knows the files only
    again = DigestIndex(spark, path, 4).open()
    assert decide(docs, again, [(10, "a"), (11, "c"), (12, "c")]) == [
        (10, 1, 1, False), (11, 11, 2, True), (12, 11, 2, False)]
    assert decide(docs, again, [(11, "c")]) == [(11, 11, 1, True)]  # a batch run again
    assert sorted(r.keep_id for r in again.rows().collect()) == [1, 2, 11]


def test_the_index_side_is_not_shuffled(spark, docs, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4).open()
    decide(docs, index, [(1, "a")])
    new = index.plain_rows().join(index.rows().hint("merge"), "digest", "left_anti")
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_keep_first_keeps_whole_rows(spark, docs, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4).open()
    df = docs([(2, "x y", "en", "s", 3), (1, "x  y", "de", "t", 4), (3, "z"), (3, "z"), (None, None)], **CLASHES)
    kept = keep_first(df, index)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id or 0, r.lang, r.digest) for r in kept.collect()), key=str) == [
        (0, None, "x"), (1, "de", "x"), (3, None, "x")]


def test_empty(spark, docs, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4).open()
    assert add_batch(docs([]), index).count() == 0 and keep_first(docs([]), index).count() == 0


def test_batches_against_a_filled_index(spark, docs, tmp_path):
    """Several batches by ascending ids decide as one does; the later ones meet the earlier in the index."""
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(None, "text 3"), (None, "alone"), (3, "text 3")]
    one = DigestIndex(spark, str(tmp_path / "one"), 4).open()
    many = DigestIndex(spark, str(tmp_path / "it's many"), 4).open()
    want, got = (sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in add_batch(docs(rows, **CLASHES), index, batches=n).collect()), key=str)
                 for index, n in ((one, 1), (many, 4)))
    assert got == want and len(got) == len(rows)
    assert many.rows().count() == 8
    files = [f for f in (tmp_path / "it's many").iterdir() if f.suffix == ".parquet"]
    small = many.compacted(str(tmp_path / "small"))
    assert sorted(map(tuple, small.rows().collect())) == sorted(map(tuple, many.rows().collect()))
    assert len([f for f in (tmp_path / "small").iterdir() if f.suffix == ".parquet"]) <= min(4, len(files))
    many.close()
    assert not spark.catalog.tableExists(many.table) and many.open().rows().count() == 8


def test_a_very_long_text(spark, docs, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4).open()
    long = "word  " * 1_000_000
    assert decide(docs, index, [(1, long), (2, "word " * 1_000_000), (3, long + "x")]) == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)]
