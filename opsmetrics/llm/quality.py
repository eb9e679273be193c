"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed byte trigrams and one for words that repeat the word before them. Log counts
times inverse document frequency, reduced by a truncated singular value decomposition of the
labelled sample, give vectors of length one. The labelled vectors go to all tasks (the sample is
bounded); each document is compared with all of them in blocks, exactly, and its nearest
neighbours vote with their cosine, each label weighted as if both were equally frequent.

Defined results: a text without any known term, so also a null or empty one, is like nothing and
scores the even vote 0.5; of equal cosines any neighbours vote; without labelled rows every score
is 0.5; with one label only, that label. Rows are judged alone. Texts are read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmetrics.llm.boxes import boxed, unboxed
from opsmetrics.llm.byte_ngrams import ngram_counts
from opsmetrics.session import ship_package

BITS = 11
ORDERS = (3,)
SCORES = "id long, score double"
BLOCK = 256  # documents compared at once: a block of cosines is BLOCK x sample


@dataclass(frozen=True)
class Settings:
    sample: int = 2000  # labelled texts of each label
    length: int = 64  # of a vector
    neighbours: int = 15
    power: float = 4.0  # a neighbour's vote is its cosine to this power
    repeats: float = 1.0  # weight of the share of repeated words
    passes: int = 3  # of the randomised decomposition
    seed: int = 5


def term_counts(text: str | None) -> np.ndarray:
    """Trigram counts by bucket, and the share of words equal to the word before."""
    data = (text or "").encode("utf-8", "replace")
    out = np.zeros((1 << BITS) + 1, dtype=np.float32)
    if data.strip():
        out[:-1] = ngram_counts(data, ORDERS, BITS)
        words = data.split()
        out[-1] = sum(map(eq, words, words[1:])) / max(len(words) - 1, 1)
    return out


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    axes: np.ndarray  # terms x length
    vectors: np.ndarray  # labelled texts x length, of length one
    labels: np.ndarray
    settings: Settings

    def terms(self, counts: np.ndarray) -> np.ndarray:
        """Rows of length one: weighted trigrams of length one, and the repeats beside them."""
        out = np.empty(counts.shape, dtype=np.float32)
        grams = out[:, :-1]
        np.log1p(counts[:, :-1], out=grams)
        grams *= self.idf
        grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-12)
        out[:, -1] = self.settings.repeats * counts[:, -1]
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return out

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(self.terms(counts) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The votes of the nearest labelled texts, for a block of documents."""
        n = len(self.labels)
        if not n:
            return np.full(len(counts), 0.5)
        cosine = self.embed(counts) @ self.vectors.T
        k = min(self.settings.neighbours, n)
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.take_along_axis(cosine, near, 1).clip(0).astype(np.float64) ** self.settings.power
        good = self.labels.mean()
        if 0 < good < 1:
            vote *= np.where(self.labels[near] > 0.5, 0.5 / good, 0.5 / (1 - good))
        total = vote.sum(axis=1)
        known = (vote * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300)
        return np.where(total > 0, known, 0.5)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def train(counts: np.ndarray, labels: np.ndarray, settings: Settings = Settings()) -> Model:
    """The latent-semantic space of the labelled texts, by a randomised decomposition."""
    rng = np.random.default_rng(settings.seed)
    terms = counts.shape[1]
    idf = np.log((1 + len(counts)) / (1 + (counts[:, :-1] > 0).sum(axis=0))).astype(np.float32)
    flat = Model(idf, np.zeros((terms, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0), settings)
    if not len(counts):
        return flat
    a = flat.terms(counts)
    k = min(settings.length, len(a))
    span = np.linalg.qr(a @ rng.normal(size=(terms, k + 10)).astype(np.float32))[0]
    for _ in range(settings.passes):
        span = np.linalg.qr(a @ (a.T @ span))[0]
    axes = np.linalg.svd(span.T @ a, full_matrices=False)[2][:k].T.astype(np.float32)
    return Model(idf, axes, _unit(a @ axes), np.asarray(labels, dtype=np.float64), settings)


def fit(
    docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, settings: Settings = Settings(),
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Model:
    """Learn from labelled rows for which `may_learn` (of `labels`) holds: at most
    `settings.sample` of either label, first in a seeded order. Their term counts go to the driver,
    16 KB each; of repeated labels of one document the mean counts."""
    spark = docs.sparkSession
    ship_package(spark)
    may_learn = F.lit(True) if may_learn is None else may_learn
    rated = labels.where(may_learn & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        (F.avg(F.col(label_col)) >= 0.5).cast("int").alias("label"))
    order = [F.xxhash64(F.lit(settings.seed), "id"), F.col("id")]
    some = [rated.where(F.col("label") == v).orderBy(*order).limit(settings.sample) for v in (0, 1)]
    picked = some[0].unionAll(some[1])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_counts(t.as_py()).astype("<f4").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(found, pa.binary())], names=["id", "label", "terms"])

    # an id may stand on many rows: one of each goes on, cut in every task before the shuffle
    one = Window.partitionBy("id").orderBy(F.xxhash64("text"))
    sample = texts.join(F.broadcast(picked), "id").withColumn("copy", F.row_number().over(one)).where("copy = 1")
    got = sample.select(F.col("id").cast("long"), "label", "text").mapInArrow(
        count, "id long, label int, terms binary").toPandas().sort_values("id", ignore_index=True)
    counts = np.empty((len(got), (1 << BITS) + 1), dtype=np.float32)
    for row, terms in zip(counts, got.pop("terms"), strict=True):
        row[:] = np.frombuffer(terms, "<f4")
    return train(counts, got["label"].to_numpy(), settings)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) per row. A map over the rows, no shuffle."""
    run = _scorer(docs, model)
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(
        lambda batches: run(batches, ["id"], "text"), SCORES)


def keep_good(docs: DataFrame, model: Model, at_least: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score `at_least`, all columns as they are; nothing is shuffled."""
    run = _scorer(docs, model)
    rows = boxed(docs, text=F.col(text_col))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return unboxed(rows.mapInArrow(lambda batches: run(batches, ["row"], "text"), schema).where(F.col("score") >= at_least))


def _scorer(docs: DataFrame, model: Model):
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch], carried: list[str], text_col: str) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts, scores = batch.column(text_col), []
            for at in range(0, batch.num_rows, BLOCK):
                scores.append(m.score(np.stack([term_counts(t.as_py()) for t in texts[at:at + BLOCK]])))
            column = pa.array(np.concatenate(scores) if scores else [], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), column], names=[*carried, "score"])

    return run
