"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are words. Targets share a total by weight and stop at `cap` times their source. A source
is taken whole as often as its target holds it; the remaining budget is fitted: documents are
counted by exact size, every size gives its share, and a bounded knapsack over what is left picks how many more of each size make the budget up. Which documents of a size are taken is decided by
a seeded order.

Defined results: a null text has no words and a document without words is taken zero words; null
sources are one source, ordered last; repeated rows are separate documents; a table without words
has targets of zero. Only id, source and text are read here, other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.boxes import boxed, unboxed
from opsmetrics.session import ship_package, stage

WORD, WHITE_SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
RANK_BITS = 10  # a (source, size) class is ranked in up to 2^10 parts


def word_count(text: Column) -> Column:
    """Words as one letter each, without what is between them: no list of words is built."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(letters, WHITE_SPACE, "")).cast("long")


def _text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def source_targets(sizes: DataFrame, weights: Sequence[float], total_ratio: float, cap: float) -> DataFrame:
    """(source, source_id, source_size, target) from (source, source_size) rows.

    Sources in code point order take the weights in turn. The total is shared by weight; a share
    above `cap` times its source is cut there and the excess goes to the others by weight. The
    fixed point is min(cap, weight x level): sources reach their cap in the order of cap / weight,
    so the level follows from running sums. One row per source passes through one task.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    by_cap = Window.orderBy("_full", "source_id").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("_full", "source_id").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("source_id"), F.lit(len(weights))) + 1)
    level = (total_ratio * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(by_cap), F.lit(0.0))) \
        / F.sum("_weight").over(rest)
    return (
        sizes.withColumn("source_id", F.row_number().over(by_name) - 1)
        .withColumn("_weight", weight)
        .withColumn("_cap", cap * F.col("source_size"))
        .withColumn("_full", F.col("_cap") / F.col("_weight"))
        .withColumn("_level", level)
        .withColumn("_at", F.max(F.when(F.col("_full") >= F.col("_level"), F.col("_level"))).over(everything))
        .withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_weight") * F.col("_at"), F.col("_cap"))))
        .select("source", "source_id", "source_size", "target")
    )


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_words: int) -> np.ndarray:
    """How many documents of each size to take, so that their words make up `budget`.

    Each size gives the whole part of its share. Of what then is missing, the largest documents
    that fit are taken until at most `dp_words` are missing; a bounded knapsack finds the sum
    nearest to that, below or above, and the documents that make it.
    """
    total = int(sizes @ counts)
    if budget <= 0 or total == 0:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left, missing = counts - take, budget - int(sizes @ take)
    for i in np.argsort(-sizes, kind="stable"):
        if missing <= dp_words:
            break
        if sizes[i] > 0:
            n = min(int(left[i]), missing // int(sizes[i]))
            take[i], left[i], missing = take[i] + n, left[i] - n, missing - n * int(sizes[i])
    return take + knapsack(sizes, left, missing)


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Counts of a subset whose sum is nearest to `budget`, of two as near the smaller.

    The empty subset is off by `budget`, so sums up to twice that can be nearest. Counts are split
    into powers of two, so an item is used once or not; `by[s]` is the first item that made the
    sum s reachable, which also leads back from it.
    """
    top = 2 * budget
    by = np.full(top + 1, -1, dtype=np.int64)
    reached = np.zeros(top + 1, dtype=bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        size, n, part = int(sizes[i]), int(counts[i]), 1
        n = min(n, top // size) if size else 0
        while n > 0 and not reached[budget]:
            k = min(part, n)
            n, part, w = n - k, part * 2, k * size
            new = np.zeros_like(reached)
            new[w:] = reached[:top + 1 - w]
            new &= ~reached
            by[new] = len(items)
            reached |= new
            items.append((int(i), k))
    sums = np.flatnonzero(reached)
    take, s = np.zeros_like(counts), int(sums[np.abs(sums - budget).argmin()])
    while s:
        i, k = items[by[s]]
        take[i] += k
        s -= k * int(sizes[i])
    return take


def _fit_source(dp_words: int):
    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        total, target = int(sizes @ counts), float(pdf["target"].iloc[0])
        whole = int(target // total) if total else 0
        take = fit_budget(sizes, counts, int(round(target - whole * total)), dp_words)
        return pd.DataFrame({"source_id": key[0], "size": sizes, "n": counts, "whole": whole, "more": take})

    return fit


def plan_mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total_ratio: float = 1.5, cap: float = 2.0,
    seed: int = 17, dp_words: int = 1 << 16, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """One row per document: id, source, text_key, size, source_size, target, copies.

    Texts are read once, into a table of narrow rows. Sizes are counted per (source, size) before
    the shuffle, and one task fits one source from its counts, of which there are as many as
    distinct sizes. A class of equal sizes is ranked in parts of its seeded order: parts are
    counted, a running sum over them gives the rank at which each begins, and only the rows of one
    part are sorted together. `dp_words` bounds the knapsack's table, not what it may take.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = F.col(text_col)
    rows = stage(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
        _text_key(text).alias("text_key"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("order")), "sizes")
    counted = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    per_source = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = stage(source_targets(per_source, weights, total_ratio, cap), "targets")

    def on_source(df: DataFrame) -> DataFrame:
        named = targets.withColumnRenamed("source", "_source")
        return df.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    takes = stage(
        on_source(counted).select("source_id", "size", "n", "target").groupBy("source_id")
        .applyInPandas(_fit_source(dp_words), "source_id int, size long, n long, whole long, more long"), "takes")
    part = F.shiftright("order", 64 - RANK_BITS)
    classed = on_source(rows).withColumn("part", part).join(takes, ["source_id", "size"])
    before = Window.partitionBy("source_id", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        on_source(rows).groupBy("source_id", "size", part.alias("part")).agg(F.count(F.lit(1)).alias("_in_part"))
        .withColumn("_before", F.coalesce(F.sum("_in_part").over(before), F.lit(0))).drop("_in_part")
    )
    inside = Window.partitionBy("source_id", "size", "part").orderBy("order", "id", "text_key")
    return (
        classed.join(parts, ["source_id", "size", "part"])
        .withColumn("rank", F.col("_before") + F.row_number().over(inside))
        .withColumn("copies", F.col("whole") + (F.col("rank") <= F.col("more")).cast("long"))
        .select("id", "source", "text_key", "size", "source_size", "target", "copies")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each row of `docs` as often as the plan takes it, all columns as they are."""
    key = ("id", "source", "text_key")

    def numbered(df: DataFrame) -> DataFrame:
        return df.withColumn("no", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(1))))

    plan = numbered(plan_mix(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options).select(*key, "copies"))
    rows = numbered(boxed(docs, id=F.col(id_col), source=F.col(source_col), text_key=_text_key(F.col(text_col))))
    same = F.lit(True)
    for c in (*key, "no"):
        same = same & rows[c].eqNullSafe(plan[c])
    taken = rows.join(plan.where("copies > 0"), same).select("row", "copies")
    return unboxed(taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))))
