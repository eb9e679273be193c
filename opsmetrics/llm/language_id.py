"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed subwords (byte n-grams of the lower-cased text
that do not cross a word boundary). Embeddings and softmax are trained by stochastic gradient
descent in numpy on a bounded sample per language. A part of the sample is held back: it sets the
temperature of the scores, and the score below which a prediction is rejected so that the accepted
ones reach a wanted precision.

Because the mean is linear, embeddings times weights is one table of logits per subword; a task
needs that table only.

Defined results: a null text, or one without any letter, is `und` with score 0 and rejected; a
text with letters always has one of the learned languages as prediction, of equal logits the first
in order; without any labelled row everything is `und`. Rows are judged alone, so repeats and order
do not matter. Texts are read whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.byte_ngrams import ngram_counts
from opsmetrics.session import ship_package, stage

UNDETERMINED = "und"
ORDERS = (2, 3)
BITS = 13
# Letters of ASCII stay, its other characters are boundaries, all bytes beyond are parts of letters.
_SYMBOLS = np.array(
    [b if chr(b).isalpha() or b > 127 else 0 for b in range(256)], dtype=np.uint8)

PREDICTION = "id long, lang_pred string, score double, accepted boolean"


def subwords(text: str) -> np.ndarray:
    return ngram_counts(text.lower().encode("utf-8", "replace"), ORDERS, BITS, _SYMBOLS)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Settings:
    sample: int = 4000  # labelled texts to learn from, in all
    most_langs: int = 1000  # more labels than this are no languages: an error
    width: int = 16  # length of an embedding
    epochs: int = 12
    batch: int = 32
    rate: float = 0.5
    held_back: float = 0.2  # share of the sample for calibration
    precision: float = 0.99  # wanted among accepted predictions
    seed: int = 11


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logits: np.ndarray  # per subword bucket and language, temperature included
    bias: np.ndarray
    reject_below: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0, False
        counts = subwords(text)
        chances = softmax((counts @ self.logits) / max(counts.sum(), 1) + self.bias)
        best = int(chances.argmax())
        return self.langs[best], float(chances[best]), bool(chances[best] >= self.reject_below)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(counts: np.ndarray, langs: list[str], settings: Settings = Settings()) -> Model:
    """Fit on one row of subword counts per text; float rows are scaled in place. The rows are taken
    in an order drawn by the seed, so equal samples give equal models."""
    names = tuple(sorted(set(langs)))
    if not names:
        return Model((), np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    rng = np.random.default_rng(settings.seed)
    order = rng.permutation(len(langs))
    y = np.array([names.index(lang) for lang in langs])[order]
    x = np.asarray(counts, dtype=np.float32)
    x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
    back = int(len(y) * settings.held_back)
    emb = rng.normal(0, 1 / settings.width, (x.shape[1], settings.width)).astype(np.float32)
    out, bias = np.zeros((settings.width, len(names)), np.float32), np.zeros(len(names), np.float32)
    scale = np.float32(np.sqrt(x.shape[1]))  # a mean over many buckets is small; this evens the steps
    share = np.bincount(y[back:], minlength=len(names)).clip(1)
    weight = (share.mean() / share).astype(np.float32)
    for epoch in range(settings.epochs):
        rate = settings.rate * (1 - epoch / settings.epochs)
        for at in range(back, len(y), settings.batch):
            xb, yb = x[order[at:at + settings.batch]] * scale, y[at:at + settings.batch]
            mean = xb @ emb
            grad = softmax(mean @ out + bias)
            grad[np.arange(len(yb)), yb] -= 1
            grad *= (weight[yb] / len(yb))[:, None]
            d_mean = grad @ out.T
            out -= rate * (mean.T @ grad)
            bias -= rate * grad.sum(axis=0)
            emb -= rate * (xb.T @ d_mean)
    table = (emb * scale) @ out
    held = x[order[:back]] @ table + bias
    heat = _temperature(held, y[:back]) if back else 1.0
    return Model(names, table / heat, bias / heat, _reject_below(softmax(held / heat), y[:back], settings.precision))


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on the held-back rows."""
    grid = np.geomspace(0.25, 8, 61)
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _reject_below(chances: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score from which on the held-back predictions reach the precision."""
    if not len(y):
        return 0.0
    score, right = chances.max(axis=1), chances.argmax(axis=1) == y
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= precision
    return float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0


def _labelled_counts(docs: DataFrame, may_learn: Column, settings: Settings, id_col: str, text_col: str, lang_col: str):
    """Subword counts and languages of the sample: of each language about the same number of texts,
    first in a seeded order. The seeded number of a row and the size of its language tell whether
    it can be among them; only twice as many as wanted are ranked, however large a language is."""
    rows = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = stage(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "languages")
    langs = sizes.count()
    if langs > settings.most_langs:
        raise ValueError(f"{langs} languages; at most {settings.most_langs} are learned")
    each = max(settings.sample // max(langs, 1), 1)
    place = F.pmod(F.xxhash64(F.lit(settings.seed), "id"), F.lit(1 << 31)) / float(1 << 31)
    near = rows.select("id", "lang", place.alias("place")).join(F.broadcast(sizes), "lang").where(  # checked above
        F.col("place") < 2.0 * each / F.col("rows"))
    first = Window.partitionBy("lang").orderBy("place", "id")
    ids = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).select("id")
    sample = rows.join(F.broadcast(ids.distinct().limit(each * max(langs, 1))), "id")  # at most `sample` ids
    # an id may stand on many rows: one of each goes on, cut in every task before the shuffle
    one = Window.partitionBy("id").orderBy(F.xxhash64("lang", "text"))
    sample = sample.withColumn("copy", F.row_number().over(one)).where("copy = 1")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sums = [], []
            for t in batch.column("text"):
                c = subwords(t.as_py())
                at = np.flatnonzero(c)
                found.append(at.astype("<u2").tobytes())
                sums.append(c[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("lang"), pa.array(found, pa.binary()), pa.array(sums, pa.binary())],
                names=["id", "lang", "at", "n"])

    got = sample.select(F.col("id").cast("long"), "lang", "text").mapInArrow(
        count, "id long, lang string, at binary, n binary").toPandas().sort_values(["lang", "id"], ignore_index=True)
    counts = np.zeros((len(got), 1 << BITS), dtype=np.float32)
    for i, (at, n) in enumerate(zip(got["at"], got["n"], strict=True)):
        counts[i, np.frombuffer(at, "<u2")] = np.frombuffer(n, "<f4")
    return counts, got["lang"].tolist()


def fit(
    docs: DataFrame, may_learn: Column | None = None, settings: Settings = Settings(),
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Model:
    """Learn from the rows for which `may_learn` holds; at most `settings.sample` of them reach the
    driver, as subword counts."""
    ship_package(docs.sparkSession)
    may_learn = F.lit(True) if may_learn is None else may_learn
    return train(*_labelled_counts(docs, may_learn, settings, id_col, text_col, lang_col), settings)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, accepted per row. A map over the rows, no shuffle."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                 pa.array([g[2] for g in got], pa.bool_())], names=["id", "lang_pred", "score", "accepted"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, PREDICTION)
