import hashlib
import random

import regex
from pyspark.sql import functions as F

from opsmetrics.llm.order_minhash import PIECE, fingerprint_edits, fingerprint_text, likeness, next_ids, with_fingerprint
from opsmetrics.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def plain_fingerprints(spark, texts, k=2, kept=2):
    """The definition, step by step, with Spark's hash of the same values and nothing else."""
    def hashes(rows, kind):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i long, v {kind}")
        return df

    words = [regex.findall(PIECE, t or "") for t in texts]
    grams = [[tuple(w[i:i + k]) for i in range(len(w) - k + 1)] or ([tuple(w)] if w else []) for w in words]
    flat = sorted({g for gs in grams for g in gs})
    df = hashes([list(g) for g in flat], "array<string>")
    h = {flat[r.i]: r.h & ~((1 << 28) - 1) for r in df.select("i", F.xxhash64(*[F.get("v", j) for j in range(k)]).alias("h")).collect()}
    pairs, keys = set(), []
    for gs in grams:
        seen, key = {}, []
        for at, g in enumerate(gs):
            n = seen.get(h[g], 0)
            seen[h[g]] = n + 1
            key.append((h[g] >> 28, n, at))
        keys.append(key)
        pairs |= {(a, b) for a, b, _ in key}
    pairs = sorted(pairs)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, a long, b int")
    ph = {pairs[r.i]: r.h >> 28 for r in df.select("i", F.xxhash64(F.lit(29), "a", "b").alias("h")).collect()}
    tuples, out = [], []
    for key in keys:
        bins = {}
        for a, b, at in key:
            bins.setdefault(ph[a, b] >> 31, []).append((ph[a, b], at))
        least = [(b, m) for b in sorted(bins) for m in sorted(bins[b])[:kept]]
        chosen = {}
        for at, (b, _) in enumerate(least):
            if b not in chosen:  # its own, and those of the bins that follow where it has too few
                mates = [least[(at + j) % len(least)][1] for j in range(min(kept, len(least)))]
                chosen[b] = tuple(x & ((1 << 35) - 1) for x, _ in sorted(mates, key=lambda t: t[1]))
        out.append(chosen)
        tuples += chosen.values()
    tuples = sorted(set(tuples))
    th = {tuples[r.i]: (r.h & MASK) >> 37 for r in hashes([list(t) for t in tuples], "array<long>").select("i", F.xxhash64("v").alias("h")).collect()}
    return [[(b + 16) << 27 | th[c[b]] for b in sorted(c)] for c in out]


def fingerprints(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    return [r.fp for r in with_fingerprint(df, "text", "fp").orderBy("i").collect()]


def test_against_the_definition(spark):
    rng = random.Random(4)
    texts = [None, "", " \n ", "one", "one two", "a a a a a a a", "x y x y x y"]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (3, 10, 50, 200, 2000)]
    texts += [" ".join(f"w{rng.randrange(500)}" for _ in range(1000)), "x" * 70, "日本語の文章 mixed テスト", "q=1&page=20/abc_def-ghi?j", "é" * 40]
    assert fingerprints(spark, texts) == plain_fingerprints(spark, texts)


def test_equal_texts_in_different_columns(spark, docs):
    """The edited text of one document is another one's text."""
    words = [f"w{i}" for i in range(66)]
    whole = " ".join(words)
    kept = whole[:len(whole) - len(whole) // 4]
    df = docs([(1, whole), (2, "Z" * 400), (3, kept + "Z" * (len(whole) // 4)), (4, "")])
    got = {r.id: r for r in fingerprint_edits(df).collect()}
    assert got[1].edited_sha256 == hashlib.sha256((kept + "Z" * (len(whole) // 4)).encode()).hexdigest()
    assert got[1].edited_fp == got[3].fp


def test_order_matters_and_edits_show(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(600)]
    half = words[300:] + words[:300]
    few = [w if rng.random() > 0.02 else "new" for w in words]
    shuffled = rng.sample(words, len(words))
    df = spark.createDataFrame([tuple(" ".join(x) for x in (words, words, half, few, shuffled))], "a string, same string, half string, few string, shuffled string")
    for c in df.columns:
        df = with_fingerprint(df, c, f"{c}_fp")
    r = df.select(*[likeness(F.col("a_fp"), F.col(f"{c}_fp")).alias(c) for c in ("same", "half", "few", "shuffled")]).first()
    assert r.same == 1 and r.few > 0.6 and r.shuffled < 0.1
    # the halves swapped keep nearly all k-mers, and about half of the pairs change their order
    assert 0.25 < r.half < 0.85


def test_next_ids(spark, docs):
    got = {r.id: r.next_id for r in next_ids(docs([(5, ""), (-3, ""), (1 << 40, ""), (5, ""), (None, "")]), "doc_id").collect()}
    assert got == {-3: 5, 5: 1 << 40, 1 << 40: -3}
    assert next_ids(docs([]), "doc_id").count() == 0


def test_edge_rows(spark, docs):
    df = docs([(1, "aéb 😀d e"), (2, None), (4, "same text here"), (4, "same text here"), (None, "no id of its own"), (3, "x" * 400_000)],
              id=1, fp=2, text_key=3, n=4)
    got = fingerprint_edits(df).collect()
    assert len(got) == 6
    by = {r.id: r for r in got}
    assert by[1].n_chars == 8 and by[1].edited_sha256 == hashlib.sha256("aéb 😀d".encode()).hexdigest()
    assert by[2].near_edited == 1 and by[2].fp == [] and by[2].near_next == 0
    assert by[4].edited_sha256 == hashlib.sha256(("same text h" + "aéb").encode()).hexdigest()
    assert by[None].edited_sha256 == hashlib.sha256("no id of its".encode()).hexdigest()
    assert fingerprint_edits(docs([])).count() == 0


def test_query_against_the_texts(spark, table):
    texts = table("documents", "doc_id, coalesce(text, '')", "doc_id")
    got = {r.doc_id: r for r in QUERIES["op8_order_minhash"](spark, SF).collect()}
    names, near = {}, []
    for n, (i, text) in enumerate(texts):
        following, quarter = texts[(n + 1) % len(texts)][1], len(text) // 4
        edited = text[:len(text) - quarter] + following[:quarter]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert names.setdefault(text, r.fingerprint) == r.fingerprint
        if len(text) > 100:
            near.append(r.near_edited > r.near_next or text == following)
    assert len(got) == len(texts) and all(near)


def test_only_dataframe_functions(spark):
    plan = QUERIES["op8_order_minhash"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and fingerprint_text(F.array(F.lit(1))) is not None


def test_texts_without_word_gaps_and_short_ones(spark, docs):
    rng = random.Random(7)
    cjk = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(4000))
    token = "".join(rng.choice("abcdefghij/") for _ in range(4000))
    note = "a short note about nothing in particular that ends here"
    long_note = " ".join(f"w{i}" for i in range(70))
    df = docs([(1, cjk), (2, token), (3, note), (4, "other"), (5, " ".join(long_note.split()[:60])), (6, long_note), (7, " ".join(long_note.split()[:60]))])
    got = {r.id: r for r in fingerprint_edits(df).collect()}
    assert all(0.25 < got[i].near_edited < 1 for i in (1, 2, 3)), got
    assert got[5].near_next > 0.5 and got[6].near_next > 0.5


def test_every_tuple_of_a_short_text_carries_order(spark):
    rng = random.Random(8)
    rows = []
    for i in range(200):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(24)]
        rows.append((i, " ".join(words), " ".join(words[12:] + words[:12])))
    df = spark.createDataFrame(rows, "i long, a string, b string")

    both = with_fingerprint(with_fingerprint(df, "a", "fa"), "b", "fb")
    # of pairs from two swapped halves about half change their order; single k-mers never would
    assert both.agg(F.avg(likeness(F.col("fa"), F.col("fb")))).first()[0] < 0.65
    few = spark.createDataFrame([(0, "a b c d"), (1, "c d a b")], "i long, t string")
    fps = [r.fp for r in with_fingerprint(few, "t", "fp", k=1).orderBy("i").collect()]
    assert len(fps[0]) == len(fps[1]) and fps[0] != fps[1]
