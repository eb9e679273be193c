"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row per
digest, anti-joined with the index by sort-merge (the index side is neither shuffled nor
rewritten) and what is new is appended.

Defined results: a null text counts as empty, so all null and blank-free empty texts are one
group. Equal rows: exactly one row of a group stays, the one with the smallest id (a null id comes
last, of repeated ids any one row). An empty batch adds nothing and returns no rows. A long text is
hashed whole by one task and never shuffled. Columns other than the id and the text are never looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsmetrics.llm.boxes import boxed, unboxed
from opsmetrics.session import stage

WHITE_SPACE_RUN = r"[\x20\x09-\x0D]+"
INDEX_SCHEMA = T.StructType([
    T.StructField("digest", T.StringType()), T.StructField("keep_id", T.LongType())])


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE_RUN, " ")


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(normalised(text), 256)


@dataclass(frozen=True)
class DigestIndex:
    """A table of (digest, keep_id) below `path`, in `buckets` buckets sorted by digest.

    The files are the index: a session that has not seen it yet declares the table again over the
    same path. `path` must be visible to all executors; `buckets` must not change later.
    """

    spark: SparkSession
    path: str
    buckets: int

    @property
    def table(self) -> str:
        return f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()[:16]}"

    def open(self) -> DigestIndex:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(self.buckets)} BUCKETS LOCATION {_quoted(self.path)}")
        return self

    def close(self) -> None:
        """Take the table out of the session's catalog; the files stay, `open` declares them again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def compacted(self, path: str) -> DigestIndex:
        """A copy with one sorted file per bucket. Every append adds a file to the buckets it has rows
        for, and Spark sorts a bucket of several files anew at each join, so an index that has taken
        dozens of batches is copied and the copy used from then on."""
        fresh = DigestIndex(self.spark, path, self.buckets).open()
        fresh.append_new(self.rows())
        return fresh

    def rows(self) -> DataFrame:
        """The bucketed table, for joins on the digest without a shuffle of the index."""
        return self.spark.table(self.table)

    def plain_rows(self) -> DataFrame:
        """The same rows without the bucketing, so that a skewed join may split them."""
        return self.spark.read.schema(INDEX_SCHEMA).parquet(self.path)

    def append_new(self, groups: DataFrame) -> None:
        """Add the (digest, keep_id) rows whose digest is not there yet; one row per digest.

        Running it again with the same rows adds nothing, so a job that failed half-way is
        simply run again.
        """
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        (
            fresh.select("digest", "keep_id").repartition(self.buckets, "digest")
            .sortWithinPartitions("digest").write.insertInto(self.table)
        )


def _quoted(path: str) -> str:
    escaped = path.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _decide(
    docs: DataFrame, index: DigestIndex, id_col: str, text_col: str, batches: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Add the rows to the index, in `batches` by ascending ids. Returns their (id, digest, row) rows and, per digest, keep_id,
    own_id (the smallest of these rows) and group_size; both are written tables."""
    rows = stage(
        docs.select(F.col(id_col).cast("long").alias("id"), text_digest(F.col(text_col)).alias("digest"))
        .withColumn("row", F.monotonically_increasing_id()), "digests")
    found = []
    for part in _id_ranges(rows, batches):
        # written, because the optimizer would move the anti-join below the aggregate, onto all rows
        groups = stage(rows.where(part).groupBy("digest").agg(
            F.min("id").alias("own_id"), F.count(F.lit(1)).alias("group_size")), "groups")
        index.append_new(groups.withColumnRenamed("own_id", "keep_id"))
        found.append(groups)
    whole = reduce(DataFrame.unionAll, found).groupBy("digest").agg(
        F.min("own_id").alias("own_id"), F.sum("group_size").alias("group_size"))
    decided = stage(whole.join(index.plain_rows(), "digest").withColumn(
        "stays", F.col("own_id").eqNullSafe(F.col("keep_id"))).select("digest", "keep_id", "stays", "group_size"), "decided")
    return rows, decided


def _id_ranges(rows: DataFrame, batches: int) -> list[Column]:
    """Conditions for batches of ascending ids, about equal in size; null ids are in the last."""
    cuts = rows.approxQuantile("id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    marks = [None, *sorted({int(c) for c in cuts}), None]
    parts = []
    for low, high in pairwise(marks):
        part = F.lit(True) if high is None else F.col("id") < high
        part = part if low is None else part & (F.col("id") >= low)
        parts.append(part)
    parts[-1] = parts[-1] | F.col("id").isNull()
    return parts


def add_batch(
    docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = 1,
) -> DataFrame:
    """Decide every row of `docs` against the index, and add them to it, in one or more batches by
    ascending ids: a later batch meets what the earlier ones have put in.

    Returns one row per input row: id, digest, keep_id (the id that stays: of an earlier batch, or
    the smallest of these rows), group_size (of these rows those with the digest), kept. The texts
    are read once; everything after is (id, digest) rows. Counting is combined before the
    shuffle; the join back to the rows is a plain equi-join whose skewed side Spark can split.
    """
    rows, decided = _decide(docs, index, id_col, text_col, batches)
    # before the join, where no row needs its whole group: a hot digest stays splittable
    numbered = rows.withColumn("copy", F.row_number().over(Window.partitionBy("id", "digest").orderBy("row")))
    kept = F.col("stays") & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return numbered.join(decided, "digest").select("id", "digest", "keep_id", "group_size", kept.alias("kept"))


def keep_first(
    docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = 1,
) -> DataFrame:
    """The rows of `docs` that stay, all columns as they are. One (id, digest) per group is looked
    up, so a large group is no hot key."""
    _, decided = _decide(docs, index, id_col, text_col, batches)
    kept = decided.where("stays").select(F.col("keep_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    rows = boxed(docs, id=F.col(id_col), digest=text_digest(F.col(text_col)))
    same = rows["id"].eqNullSafe(kept["kept_id"]) & (rows["digest"] == kept["kept_digest"])
    again = Window.partitionBy("id", "digest").orderBy(F.lit(1))
    return unboxed(rows.join(kept, same, "left_semi").withColumn("copy", F.row_number().over(again)).where("copy = 1"))
