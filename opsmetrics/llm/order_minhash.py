"""Document fingerprints by Order MinHash.

Symbols are pieces of words (`PIECE`), k-mers are runs of `K` symbols. Most words are one piece. Characters of
scripts without word gaps are pieces of their own, and a long token is cut where its characters say
so, so an edit moves no other cut. This is one rule for every text, so any two are comparable.
Each k-mer carries the number of its earlier occurrences in the text, so all are distinct. A hash of
both deals them into 2^BIN_BITS bins; of every bin the `KEPT` least are selected, put back into text
order and hashed as a tuple. A bin with fewer takes the missing ones from the bins that follow, after
the last from the first, so every tuple carries order. Equal tuples need the same k-mers in the same
order, so the share of agreeing bins falls with the edit distance and not only with the overlap of the
sets. Only DataFrame expressions run, all of them linear in the text but for one sort of its k-mers.

Defined results: a null text counts as empty and has an empty fingerprint; two empty fingerprints
are alike (1), an empty and another one are not (0); a text of fewer symbols than a k-mer is one
k-mer; a text with fewer than `KEPT` k-mers hashes those it has; bins empty in both texts do not
count. Equal texts have equal fingerprints, whichever column they stand in. A text is one value of
its row with a few arrays of its length beside it while it is fingerprinted: some tens of bytes a
character, which a task must have room for; texts of 8 million characters are tested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.session import stage

K = 2
KEPT = 2
BIN_BITS = 5
# --- fixed values: letters of scripts written without gaps (South-East Asian, kana, Han), and the
# characters after which a token is cut
_SINGLE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_CUT = "jkqxzJKQXZ0-2/=&_-"
_LONGEST = 15
# in one pass and without going back: up to 15 plain characters and the cut after them, or one of the others alone
PIECE = rf"[^\x20\x09-\x0D{_SINGLE}{_CUT}]{{1,{_LONGEST}}}+[{_CUT}]?+|[{_SINGLE}{_CUT}]"
# A k-mer travels as one long: its hash above, its position below. 28 bits hold any position,
# because a Spark array has fewer than 2^28 longs.
_AT_BITS = 28
_AT = (1 << _AT_BITS) - 1
_HASH = ~_AT
_TUPLE_BITS = 32 - BIN_BITS
_SEED = 29


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _packed(hash_: Column, at: Column) -> Column:
    return hash_.bitwiseAND(_long(_HASH)).bitwiseOR(at.cast("long"))


def _at(packed: Column) -> Column:
    return packed.bitwiseAND(_long(_AT))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, _AT_BITS)


def symbols(text: Column) -> Column:
    """The pieces of the words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def with_fingerprint(df: DataFrame, text_col: str, out: str, k: int = K, kept: int = KEPT) -> DataFrame:
    """`df` with `out`, an array of one integer per non-empty bin (bin above, tuple below).

    Each step is a column of its own, because later steps use it several times; their names are made
    so that they clash with no column of `df`.
    """
    mark = "_"
    while any(c.startswith(f"{mark}{out}_") for c in df.columns):
        mark += "_"
    words, kmers, starts, numbered, chosen = (f"{mark}{out}_{x}" for x in ("words", "kmers", "starts", "numbered", "chosen"))
    df = df.withColumn(words, symbols(F.coalesce(F.col(text_col), F.lit(""))))

    def upto(n: Column) -> Column:
        return F.sequence(F.lit(0), n)

    def hashed(k: int) -> Column:
        def kmer(i: Column) -> Column:
            return _packed(F.xxhash64(*[F.get(F.col(words), i + j) for j in range(k)]), i)

        last = F.size(words) - F.least(F.lit(k), F.size(words))  # -1 steps are avoided by the empty case
        return F.transform(upto(last), kmer)

    none = F.array().cast("array<bigint>")
    df = df.withColumn(kmers, F.when(F.size(words) > 0, F.sort_array(hashed(k))).otherwise(none))

    # equal hashes are neighbours now: where each run of them starts gives the occurrence numbers
    same = F.size(kmers)
    df = df.withColumn(starts, F.when(same > 0, F.filter(upto(same - 1), lambda i: (i == 0) | (
        _hash(F.get(F.col(kmers), i)) != _hash(F.get(F.col(kmers), i - 1))))).otherwise(F.array().cast("array<int>")))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(same))
    occurrence = F.flatten(F.zip_with(F.col(starts), ends, lambda a, b: upto(b - a - 1)))
    df = df.withColumn(numbered, F.when(same > 0, F.sort_array(F.zip_with(
        F.col(kmers), occurrence, lambda x, n: _packed(F.xxhash64(F.lit(_SEED), _hash(x), n), _at(x))))).otherwise(none))

    def bin_of(x: Column) -> Column:
        return F.shiftright(x, 64 - BIN_BITS)

    df = df.withColumn(chosen, F.filter(F.col(numbered), lambda x, i: (i < kept) | (
        bin_of(x) != bin_of(F.get(F.col(numbered), i - kept)))))

    def tuple_of(x: Column, i: Column) -> Column:
        """The selected k-mers of the bin that begins at i, in text order, as one hash."""
        # the chosen are in the order of their bins
        around = F.slice(F.concat(F.col(chosen), F.slice(F.col(chosen), 1, kept - 1)), i + 1, F.lit(kept))
        mates = F.slice(around, F.lit(1), F.least(F.lit(kept), F.size(chosen)))
        in_order = F.sort_array(F.transform(mates, lambda y: F.shiftleft(_at(y), 64 - _AT_BITS - 1).bitwiseOR(
            _hash(y).bitwiseAND(_long((1 << (63 - _AT_BITS)) - 1)))))
        ids = F.transform(in_order, lambda y: y.bitwiseAND(_long((1 << (63 - _AT_BITS)) - 1)))
        below = F.shiftrightunsigned(F.xxhash64(ids), 64 - _TUPLE_BITS)
        return F.shiftleft(bin_of(x) + (1 << (BIN_BITS - 1)), _TUPLE_BITS).bitwiseOR(below)

    def first_of_bin(x: Column, i: Column) -> Column:
        return (i == 0) | (bin_of(x) != bin_of(F.get(F.col(chosen), i - 1)))

    tuples = F.transform(F.col(chosen), lambda x, i: F.when(first_of_bin(x, i), tuple_of(x, i)))
    return df.withColumn(out, F.array_compact(tuples)).drop(words, kmers, starts, numbered, chosen)


def likeness(a: Column, b: Column) -> Column:
    """Agreeing bins by bins that are not empty in both."""
    def bins(x: Column) -> Column:
        return F.transform(x, lambda v: F.shiftright(v, _TUPLE_BITS))

    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def fingerprint_text(fingerprint: Column) -> Column:
    """Eight hex digits per bin."""
    return F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def next_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, next_id): the next larger id, after the largest the smallest.

    Ids are dealt by range; a range looks inside itself, and one row per range says where the next
    one begins.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = stage(
        docs.select(F.col(id_col).alias("id")).where("id is not null").distinct()
        .repartitionByRange(ranges, "id").withColumn("part", F.spark_partition_id()), "ids")
    begins = ids.groupBy("part").agg(F.min("id").alias("begin"))
    in_order = Window.orderBy("part")
    follows = begins.select("part", F.coalesce(
        F.lead("begin").over(in_order), F.first("begin").over(in_order)).alias("_follows"))
    inside = ids.withColumn("_inside", F.lead("id").over(Window.partitionBy("part").orderBy("id")))
    return inside.join(follows, "part").select("id", F.coalesce("_inside", "_follows").alias("next_id"))


def fingerprint_edits(
    docs: DataFrame, share: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprint each text, its edited text, and compare it with that and with the next text.

    The edited text has its last 1/`share` of code points replaced by the first as many (or all)
    of the next document. A row without id has no next document: that counts as an empty text. Of
    rows that repeat an id, the one with the least hash of its text is the next document of others.

    Texts are dealt by id once. Only the wanted beginnings go to the document before, and only
    fingerprints are compared with the next one's.
    """
    following = stage(next_ids(docs, id_col), "next-ids")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the joins below drop null ids anyway: said before the shuffle, both sides are the same one
    rows = texts.where("id is not null").repartition(parts, "id")
    asked = stage(docs.select(
        F.col(id_col).alias("id"), F.floor(F.length(text_col) / share).cast("int").alias("n"),
    ).groupBy("id").agg(F.max("n").alias("n")).join(following, "id").select(
        F.col("next_id").alias("id"), F.col("id").alias("to"), "n"), "asked")
    one = Window.partitionBy("id").orderBy(F.xxhash64("text"))
    named = rows.withColumn("_no", F.row_number().over(one)).where("_no = 1").drop("_no")
    beginnings = named.join(asked, "id").select(
        F.col("to").alias("id"), F.substring("text", F.lit(1), F.col("n")).alias("begin"))
    followed = rows.join(beginnings, "id", "left").unionByName(
        texts.where("id is null").withColumn("begin", F.lit(None).cast("string")))
    quarter = F.floor(F.length("text") / share).cast("int")
    both = followed.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.length("text") - quarter),
        F.substring(F.coalesce("begin", F.lit("")), F.lit(1), quarter)))
    for text, out in (("text", "fp"), ("edited", "edited_fp")):
        both = with_fingerprint(both, text, out)
    done = stage(both.select(
        "id", F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("text_key"),
        F.sha2("edited", 256).alias("edited_sha256"), "fp", "edited_fp"), "fingerprints")
    firsts = done.withColumn("_no", F.row_number().over(Window.partitionBy("id").orderBy("text_key"))).where("_no = 1")
    nexts = following.join(firsts.select(F.col("id").alias("next_id"), F.col("fp").alias("next_fp")), "next_id").select("id", "next_fp")
    empty = F.array().cast("array<bigint>")
    return done.join(nexts, "id", "left").withColumn("next_fp", F.coalesce("next_fp", empty)).select(
        "id", "n_chars", "edited_sha256", "fp", "edited_fp",
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
