import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from math import ceil

import numpy as np
import pytest
from tokenizers import Tokenizer

from opsmetrics.llm.packing import pack, pack_documents
from opsmetrics.llm.queries import QUERIES, TOKENIZER
from opsmetrics.llm.tokens import WordTokenizer

SF = "/root/testdata/sf0.001"


def best_fit_decreasing(sizes, capacity):
    gaps, opened = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect_left(gaps, s)
        room = gaps.pop(at) if at < len(gaps) else capacity
        opened += at == len(gaps) and room == capacity
        if room > s:
            insort(gaps, room - s)
    return opened


def check(rows, capacity):
    """Every sequence is gapless from 0 and holds at most its capacity; returns how many there are."""
    by = defaultdict(list)
    for seq, offset, size in rows:
        by[seq].append((offset, size))
    for places in by.values():
        at = 0
        for offset, size in sorted(places):
            assert offset == at
            at += size
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("sizes", [
    [], [100], [1] * 500, [60] * 100, [51] * 40, [99, 1] * 30, list(range(1, 101)) * 3, [34, 34, 32] * 50, [3] * 900 + [70] * 30],
    ids=lambda s: f"{len(s)}")
def test_pack(spark, sizes):
    capacity = 100
    size_of = dict(enumerate(sizes))
    df = spark.createDataFrame(list(size_of.items()), "id long, size long")
    got = pack(df, capacity).collect()
    assert sorted(r.id for r in got) == sorted(size_of)
    n = check([(r.seq, r.offset, size_of[r.id]) for r in got], capacity)
    assert ceil(sum(sizes) / capacity) <= n <= 1.1 * best_fit_decreasing(sizes, capacity) + 1


def test_many_ranges(spark, monkeypatch):
    from opsmetrics.llm import packing

    monkeypatch.setattr(packing, "RANGE_ROWS", 40)
    rng = np.random.default_rng(2)
    sizes = np.concatenate([rng.integers(1, 4096, 150), rng.integers(1, 60, 150), np.full(150, 700)]).tolist()
    got = pack(spark.createDataFrame(list(enumerate(sizes)), "id long, size long"), 4096).collect()
    assert len(got) == len(sizes) and len({r.id for r in got}) == len(sizes)
    assert check([(r.seq, r.offset, sizes[r.id]) for r in got], 4096) <= 1.05 * best_fit_decreasing(sizes, 4096) + 1


def test_tokens_are_those_of_the_whole_text():
    whole, mine = Tokenizer.from_file(TOKENIZER), WordTokenizer(TOKENIZER)
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = ["", " ", "The the, THE!\n\nx", "é ́a ß İΣ Σ", "<|endoftext|>a <|startoftext|>", "it's 123 can't", "日本語 한국어"]
    texts += [f"ab{s}cd{s}{s}́e" for s in spaces]
    texts += [f"Ab{c}c {c} {c}x {c}{c}y Éß{c} x{c}." for c in map(chr, range(33, 0x250)) if not c.isspace()]
    texts += ["<|endoftext|>." * 2, "a<|startoftext|> b", "ﬁ ½ ª µ ﷺ 👍🏽 é ḍ̇ ö", "THE!! the$$$ it's, 's 'S don't!! x'll"]
    for _ in range(2):  # the second time from the cache
        assert mine.ids(texts) == [
            np.array(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_the_cache_is_bounded(monkeypatch):
    from opsmetrics.llm import tokens

    monkeypatch.setattr(tokens, "GENERATION", 5)
    mine = WordTokenizer(TOKENIZER)
    for n in range(20):
        words = " ".join(f"w{i}" for i in range(n, n + 4))
        assert mine.ids([words]) == WordTokenizer(TOKENIZER).ids([words])
        assert len(mine._young) <= 10 and len(mine._old) <= 10


def test_documents(spark, docs):
    words = " ".join(["word"] * 10_000)
    df = docs([(1, words), (1, words), (2, None), (3, ""), (None, "a b")], id=1, number=2, seq=3, offset=4)
    got = pack_documents(df, TOKENIZER, capacity=4096).collect()
    assert sorted((r.id or 0, r.piece, r.start, r.length) for r in got) == [
        (0, 0, 0, 3), *[(1, 0, 0, 4096)] * 2, *[(1, 1, 4096, 4096)] * 2, *[(1, 2, 8192, 1809)] * 2, (2, 0, 0, 1), (3, 0, 0, 1)]
    assert check([(r.sequence_id, r.offset, r.length) for r in got], 4096) == 5
    assert pack_documents(docs([]), TOKENIZER).count() == 0


def test_query_against_the_tokenizer(spark, table):
    whole = Tokenizer.from_file(TOKENIZER)
    rows = QUERIES["op5_best_fit_packing"](spark, SF).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    total = 0
    for i, text in table("documents", "doc_id, text"):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        total += len(ids)
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in pieces] == [
            (n, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes())) for n, at in enumerate(range(0, len(ids), 4096))]
    assert check([(r.sequence_id, r.offset, r.length) for r in rows], 4096) <= ceil(total / 4096) + 1
