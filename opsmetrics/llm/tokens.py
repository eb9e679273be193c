"""Token ids of whole texts, and their pieces of bounded length."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.session import ship_package

SLAB = 1 << 20  # characters tokenised together
GENERATION = 1 << 20  # words kept per generation of the cache, about 200 MB
JOINED = 4096  # words in one call of the tokenizer
ID_BYTES = 4
# str.split() parts at these, the tokenizer's white space does not
_NOT_ITS_SPACE = "\x1c\x1d\x1e\x1f"
# Letters of Latin-1 whose lower case is one letter, then marks other than the apostrophe: the
# tokenizer takes the run of letters, in lower case, and the run of marks, each for itself.
_PLAIN = re.compile(r"([A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+)([!-&(-/:-@\[-`{-~]*)")
# The alphabet of byte-level vocabularies: printable bytes stand for themselves, the others are
# numbered on from 256.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """A tokenizer that drops white space and never joins over it, so that a text's ids are those
    of its words in order. Ids of words met before come from a bounded cache of two generations;
    all others from the tokenizer. Ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _letters(self, letters: str) -> bytes:
        """The ids of a run of lower-case letters: one word of the model, in its byte alphabet."""
        found = self._model.tokenize(letters.encode().decode("latin-1").translate(_BYTE_LETTERS))
        return array("I", [t.id for t in found]).tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that the young generation does not have; it has them then."""
        if len(self._young) + len(words) > GENERATION:
            self._old, self._young = self._young, {}
        young, old, plain, found, others = self._young, self._old, _PLAIN.fullmatch, {}, []
        for w in words:
            if (ids := old.get(w)) is None:
                if (parts := plain(w)) is None:
                    others.append(w)
                    continue
                letters, marks = parts[1].lower(), parts[2]
                if (ids := young.get(letters)) is None:
                    young[letters] = ids = self._letters(letters)
                if marks:
                    if (after := young.get(marks)) is None:
                        young[marks] = after = self._encode([marks])[0]
                    ids += after
            found[w] = ids
        found.update(zip(others, self._encode_words(others), strict=True))
        young.update(found)
        return found

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, from texts of many words and the places of their tokens."""
        out: list[bytes] = []
        for at in range(0, len(words), JOINED):
            some = words[at:at + JOINED]
            found = self._tokenizer.encode(" ".join(some), add_special_tokens=False)
            places = np.array([begin for begin, _ in found.offsets], dtype=np.int64)
            begins = np.cumsum(np.array([len(w) + 1 for w in some[:-1]], dtype=np.int64))
            cuts = [0, *(np.searchsorted(places, begins) * ID_BYTES).tolist(), len(places) * ID_BYTES]
            ids = array("I", found.ids).tobytes()
            out += [ids[a:b] for a, b in pairwise(cuts)]
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes. Each word is looked up once; texts with words that are
        not known yet wait until these are learned together."""
        known, out, waiting = self._young.get, [], []
        for n, text in enumerate(texts):
            if any(c in text for c in _NOT_ITS_SPACE):
                out.append(self._encode([text])[0])
                continue
            words = text.split()
            ids = list(map(known, words))
            if None in ids:
                waiting.append((n, words, ids))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        new = {w for _, words, ids in waiting for w, i in zip(words, ids, strict=True) if i is None}
        found = self._learn(list(new)) if new else {}
        for n, words, ids in waiting:
            out[n] = b"".join([found[w] if i is None else i for w, i in zip(words, ids, strict=True)])
        return out


def slabs(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a column, null as empty, in lists of about `SLAB` characters."""
    some, size = [], 0
    for t in texts:
        some.append(t.as_py() or "")
        size += len(some[-1])
        if size >= SLAB:
            yield some
            some, size = [], 0
    if some:
        yield some


_LOADED: dict[str, WordTokenizer] = {}  # one per worker process and vocabulary


def token_pieces(
    docs: DataFrame, tokenizer_path: str, longest: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents' ids, each with `end_id` after them, cut into pieces of at most `longest`.

    One row per piece: where it starts, its length and the CRC-32 of its ids. A map, no shuffle.
    """
    ship_package(docs.sparkSession)
    end, step = array("I", [end_id]).tobytes(), longest * ID_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _LOADED.get(tokenizer_path) or _LOADED.setdefault(tokenizer_path, WordTokenizer(tokenizer_path))
        for batch in batches:
            owner, at = batch.column(0).to_pylist(), 0
            rows: list[tuple] = []
            for texts in slabs(batch.column(1)):
                for ids in tokenizer.ids(texts):
                    ids += end
                    for piece, begin in enumerate(range(0, len(ids), step)):
                        part = ids[begin:begin + step]
                        rows.append((owner[at], piece, begin // ID_BYTES, len(part) // ID_BYTES, zlib.crc32(part)))
                    at += 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)
