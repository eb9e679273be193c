"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint bit is the majority over the 64-bit hashes of all word shingles. Fingerprints link
when at most `radius` bits differ. A bit position i carries a vector m(i) of radius + 1 bits, and
for every non-zero vector v there is a table that keeps the bits with an odd product <m(i), v>.
Any `radius` positions leave a v orthogonal to all of them, so every pair within the radius agrees
in some table: candidates are complete, nothing is left to chance.

Defined results: a null or blank text has no words and fingerprint zero, which is linked like any
other; fewer words than a shingle give one shingle of all of them; equal fingerprints are one
class whatever its size; a null id never names a component unless all its ids are null; an empty
table gives an empty table. Texts are read whole, in pieces, so long ones need no more memory than
their own bytes. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.boxes import boxed, unboxed
from opsmetrics.llm.components import roots
from opsmetrics.session import ship_package, stage

BITS = 64
PIECE = 1 << 20  # bytes of a text that are split into words at once
COMPARED = 256  # a larger bucket is linked by neighbour keys instead of pairwise


def word_runs(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """All words of the text, a list per piece; words are never cut."""
    rest = b""
    for at in range(0, len(text), piece):
        part = rest + text[at:at + piece]
        words, rest = part.split(), b""
        if at + piece < len(text) and words and not part[-1:].isspace():
            rest = words.pop()
        yield words
    if rest:
        yield [rest]


def shingle_hashes(text: str, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included, in arrays."""
    carry: list[bytes] = []
    hashed = 0
    for run in word_runs(text.encode("utf-8").lower()):  # lower() of bytes changes A-Z only
        run = carry + run
        if len(run) >= words:
            joined = b" ".join(run)
            lengths = np.fromiter(map(len, run), np.int64, len(run))
            ends = np.cumsum(lengths + 1) - 1
            spans = zip((ends - lengths)[:len(run) - words + 1].tolist(), ends[words - 1:].tolist(), strict=True)
            hashes = np.array([xxhash.xxh64_intdigest(joined[i:j], seed) for i, j in spans], dtype="<u8")
            hashed += len(hashes)
            yield hashes
        carry = run[len(run) - words + 1:] if len(run) >= words else run
    if not hashed and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), seed)], dtype="<u8")


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    for hashes in shingle_hashes(text or "", words, seed):
        for at in range(0, len(hashes), 1 << 14):
            some = hashes[at:at + (1 << 14)]
            bits = np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
    with_digest: bool = False,
) -> DataFrame:
    """(id, fp) per row; fp is the 64-bit fingerprint as a signed long. A map, no shuffle. With
    `with_digest` also the digest of the text, by which a row is found again among others of its id."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter(
                (fingerprint(t.as_py(), words, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]],
                names=["id", "fp", *(["digest"] if with_digest else [])])

    narrow = docs.select(
        docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"),
        *([_digest(docs[text_col]).alias("digest")] if with_digest else []))
    return narrow.mapInArrow(run, "id long, fp long" + ", digest string" * with_digest)


def _digest(text: Column) -> Column:
    """Of the text as it is; null is empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def covering_masks(radius: int) -> list[int]:
    """The kept bits of each table, as signed longs. m(i) runs through the non-zero vectors."""
    vectors = (1 << (radius + 1)) - 1
    masks = [
        sum(1 << i for i in range(BITS) if ((i % vectors + 1) & v).bit_count() % 2)
        for v in range(1, vectors + 1)]
    return [_signed(m) for m in masks]


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _free_masks(mask: int, radius: int) -> list[int]:
    """All ways to clear `radius` of the bits that a table leaves free, as and-masks."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [_signed(((1 << BITS) - 1) ^ sum(1 << i for i in some)) for some in combinations(free, radius)]


def linked(prints: DataFrame, radius: int = 2, compared: int = COMPARED) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, enough to connect all that are linked.

    `prints` has one row per distinct fingerprint `fp`. Buckets of one table and masked value are
    compared pairwise, up to `compared` members. In a larger one every fingerprint is filed under
    all ways to clear `radius` free bits: members of one file differ in those bits only, so they
    are at most 2^radius and all linked, and every linked pair shares a file. Either way the work
    grows with the number of fingerprints, not with the square of a bucket.
    """
    masks = covering_masks(radius)
    keyed = prints.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.lit(m).alias("mask"))
                                  for i, m in enumerate(masks)])).alias("t")
    ).select("fp", "t.table", F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"))
    crowded = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stage(keyed.join(crowded, ["table", "key"]), "buckets")

    few = met.where(F.col("n") <= compared).select("table", "key", "fp")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    pairs = few.join(few.withColumnRenamed("fp", "other"), ["table", "key"]).where(
        (F.col("fp") > F.col("other")) & near).select(F.col("fp").alias("a"), F.col("other").alias("b"))

    clears = F.array(*[F.array(*[F.lit(x) for x in _free_masks(m, radius)]) for m in masks])
    files = (
        met.where(F.col("n") > compared).select("fp", F.explode(clears[F.col("table")]).alias("clear"))
        .groupBy("clear", F.col("fp").bitwiseAND(F.col("clear")).alias("file"))
        .agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    )
    stars = files.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).where("a > b")
    return pairs.unionAll(stars).distinct()


def rooted(prints: DataFrame, radius: int = 2) -> DataFrame:
    """`prints`, one row per distinct `fp`, with the `root` of its component, a fingerprint."""
    found = roots(linked(prints.select("fp"), radius)).withColumnRenamed("node", "fp")
    return prints.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def components(
    docs: DataFrame, radius: int = 2, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, fp, component_id) per row; a component is named by its smallest id.

    Copies meet in one row per distinct fingerprint before anything is compared, and the join back
    to the rows is a plain equi-join that Spark can split where a fingerprint is hot.
    """
    rows = stage(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    found = rooted(rows.groupBy("fp").agg(F.min("id").alias("first")), radius)
    names = found.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(found.join(names, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3, seed: int = 42
) -> DataFrame:
    """One row of each component: the one with the smallest id, null ids last. All columns as they are.

    An id names no row of its own: it may be null or stand on several texts. A component therefore
    chooses an (id, digest of the text), and of rows that are equal in both any one stays.
    """
    prints = stage(fingerprints(docs, words, seed, id_col, text_col, with_digest=True), "fingerprints")
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "digest"))
    found = rooted(prints.groupBy("fp").agg(least.alias("first")), radius)
    kept = found.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.id").alias("kept_id"), F.col("first.digest").alias("kept_digest"))
    rows = boxed(docs, id=F.col(id_col).cast("long"), digest=_digest(F.col(text_col)))
    same = rows["id"].eqNullSafe(kept["kept_id"]) & (rows["digest"] == kept["kept_digest"])
    again = Window.partitionBy("id", "digest").orderBy(F.lit(1))
    return unboxed(rows.join(kept, same, "left_semi").withColumn("copy", F.row_number().over(again)).where("copy = 1"))
