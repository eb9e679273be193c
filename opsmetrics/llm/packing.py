"""Best-fit packing in bulk-synchronous rounds.

A round sorts the unplaced pieces and the gaps of the open sequences together, by ranges of their
size. Each range is swept upwards: a gap takes the largest piece that fits and is still free, which
is the last one passed (successor matching, as brackets match). What a range leaves over - gaps
without a piece below them, pieces without a gap above - is matched between ranges: a piece of a
lower range fits every gap of a higher one, so numbers per range and ranks inside them decide who
meets whom. Then gaps are updated and the next round begins; when a round places nothing, as many
sequences are opened as the rest needs at least.

A gap takes more than one piece in a round only if the next is small against it, and freely after
`FREELY_AFTER` rounds, so tiny pieces need few rounds.

Only (number, size) rows are shuffled; the driver sees a few numbers per range.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opsmetrics.llm.tokens import token_pieces
from opsmetrics.session import ship_package, stage

SMALL = 3  # a further piece is small when it is at most this part of the gap
FREELY_AFTER = 8
RANGE_ROWS = 100_000

PIECE, GAP, USED = 0, 1, 2
SWEPT = "part int, kind int, id long, size long, rank long, seq long, room long"


def _sweep(small: int):
    """Sweep one range in ascending order; see `SWEPT`.

    A PIECE row with `seq` was placed where `room` tokens were left; without, it is left over and
    `rank` counts from the smallest. A GAP row is untouched and `rank` counts from the smallest;
    a USED row is a gap's new size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: list[tuple[int, int]] = []
        part, untouched = 0, 0
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("part", "kind", "id", "size"))
            for part, kind, i, size in zip(*columns, strict=True):
                if kind == PIECE:
                    free.append((i, size))
                    continue
                room = size
                while free and free[-1][1] <= (room if room == size else room // small):
                    piece, length = free.pop()
                    out.append((part, PIECE, piece, length, None, i, room))
                    room -= length
                if room == size:
                    out.append((part, GAP, i, size, untouched, None, None))
                    untouched += 1
                elif room:
                    out.append((part, USED, i, room, None, None, None))
            yield _swept(out)
        yield _swept([(part, PIECE, i, size, rank, None, None) for rank, (i, size) in enumerate(free)])

    return run


def _swept(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
        names=["part", "kind", "id", "size", "rank", "seq", "room"])


@dataclass
class _Between:
    """Which left-over pieces of a range meet which untouched gaps of a higher range."""

    intervals: list[tuple[int, int, int, int, int, int]]  # part, ranks from, to; pieces per gap; gap part, gap rank
    keep: dict[int, int]  # pieces with a lower rank stay unplaced


def _between(parts: dict[int, dict[int, tuple[int, int, int]]], small: int) -> _Between:
    """`parts`: per range and kind (number, least size, largest size). Ranges are passed upwards
    with a stack of what they left, like the sweep inside a range."""
    stack: list[list[int]] = []
    found, keep = [], {}
    for q in sorted(parts):
        gaps, least, _ = parts[q].get(GAP, (0, 0, 0))
        used = 0
        while used < gaps and stack:
            p, many, largest = stack[-1]
            each = max(1, least // (largest * small))
            n = min(gaps - used, -(-many // each))
            taken = min(many, n * each)
            found.append((p, many - taken, many, each, q, used))
            used += n
            stack[-1][1] -= taken
            if not stack[-1][1]:
                stack.pop()
        pieces, _, largest = parts[q].get(PIECE, (0, 0, 0))
        if pieces:
            stack.append([q, pieces, largest])
    for p, many, _ in stack:
        keep[p] = many
    return _Between(found, keep)


@dataclass
class _State:
    """What is unplaced and which gaps are open, with the numbers that decide what comes next."""

    left: DataFrame  # id, size
    gaps: DataFrame  # seq, gap
    pieces: int
    tokens: int
    open_gaps: int


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """(id, seq, offset) for (id, size) rows with unique ids and sizes of 1 to `capacity`.

    `pieces` should be a written table: it is read again.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    left = pieces.select("id", F.col("size").cast("long").alias("size")).where("size > 0")
    number, tokens = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    state = _State(left, spark.range(0).select(F.col("id").alias("seq"), F.col("id").alias("gap")), number, tokens, 0)
    places = left.select("id", F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("offset")).where("false")
    opened, rounds, stuck = 0, 0, True
    while state.pieces:
        if stuck:
            more = -(-state.tokens // capacity)
            state.gaps = state.gaps.unionAll(spark.range(opened, opened + more).select(
                F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap")))
            opened, state.open_gaps = opened + more, state.open_gaps + more
        rounds += 1
        done = _round(spark, state, capacity, 1 if rounds > FREELY_AFTER else SMALL)
        stuck = done is None
        if done is not None:
            state, placed = done
            places = places.unionAll(placed)
    return places


def _round(spark: SparkSession, state: _State, capacity: int, small: int) -> tuple[_State, DataFrame] | None:
    """The state after one round and what it placed, or None where nothing fits."""
    items = state.left.select("size", F.lit(PIECE).alias("kind"), "id").unionAll(
        state.gaps.select(F.col("gap").alias("size"), F.lit(GAP).alias("kind"), F.col("seq").alias("id")))
    ranges = -(-(state.pieces + state.open_gaps) // RANGE_ROWS)
    # equal sizes: pieces before gaps, each in the order of their numbers, so a hot size is cut too
    order = ("size", "kind", "id")
    # what one task may hold is one range and needs no shuffle
    ranged = items.coalesce(1) if ranges == 1 else items.repartitionByRange(ranges, *order)
    swept = stage(
        ranged.sortWithinPartitions(*order)
        .select(F.spark_partition_id().alias("part"), "kind", "id", "size").mapInArrow(_sweep(small), SWEPT), "swept")
    summary = swept.groupBy("part", "kind", F.col("seq").isNotNull().alias("matched")).agg(
        F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("size").alias("largest"), F.sum("size").alias("sum")
    ).collect()  # at most four rows per range
    parts: dict[int, dict[int, tuple[int, int, int]]] = {}
    for r in summary:
        if not r["matched"] and r["kind"] != USED:
            parts.setdefault(r["part"], {})[r["kind"]] = (r["n"], r["least"], r["largest"])
    plan = _between(parts, small)

    free = swept.where((F.col("kind") == PIECE) & F.col("seq").isNull()).select("part", "id", "size", "rank")
    untouched = swept.where(F.col("kind") == GAP).select(
        F.col("part").alias("q"), F.col("rank").alias("gap_rank"), F.col("id").alias("seq"), F.col("size").alias("gap"))
    used = swept.where(F.col("kind") == USED).select(F.col("id").alias("seq"), F.col("size").alias("gap"))
    inside = swept.where((F.col("kind") == PIECE) & F.col("seq").isNotNull()).select(
        "id", "seq", (capacity - F.col("room")).alias("offset"))
    if not plan.intervals:
        if not any(r["matched"] for r in summary):
            return None
        rest = [r for r in summary if r["kind"] == PIECE and not r["matched"]]
        return _State(
            free.select("id", "size"), untouched.select("seq", "gap").unionAll(used), sum(r["n"] for r in rest),
            sum(r["sum"] for r in rest), sum(r["n"] for r in summary if r["kind"] != PIECE)), inside

    crossed = stage(_crossed(spark, free, untouched, plan, capacity), "crossed")
    filled = crossed.groupBy("seq").agg(F.sum("size").alias("filled"))
    gaps = stage(untouched.join(filled, "seq", "left").select(
        "seq", (F.col("gap") - F.coalesce("filled", F.lit(0))).alias("gap")).where("gap > 0").unionAll(used), "gaps")
    keep = spark.createDataFrame(pa.table(
        {"part": list(plan.keep.keys()), "keep": list(plan.keep.values())},
        schema=pa.schema([("part", pa.int32()), ("keep", pa.int64())])))
    left = stage(free.join(F.broadcast(keep), "part").where("rank < keep").select("id", "size"), "unplaced")
    number, tokens = left.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    return _State(left, gaps, number, tokens, gaps.count()), inside.unionAll(crossed.select("id", "seq", "offset"))


def _crossed(spark: SparkSession, free: DataFrame, untouched: DataFrame, plan: _Between, capacity: int) -> DataFrame:
    """Pieces that meet a gap of a higher range, by their ranks."""
    # at most two rows per range
    kinds = {"p": pa.int32(), "low": pa.int64(), "high": pa.int64(), "each": pa.int64(), "q": pa.int32(), "gap_low": pa.int64()}
    meets = spark.createDataFrame(pa.table(
        [pa.array(c, t) for c, t in zip(zip(*plan.intervals, strict=True), kinds.values(), strict=True)], names=list(kinds)))
    in_interval = (F.col("part") == F.col("p")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    below = Window.partitionBy("seq").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        free.join(F.broadcast(meets), in_interval)
        .withColumn("gap_rank", F.col("gap_low") + F.floor((F.col("high") - 1 - F.col("rank")) / F.col("each")))
        .select("id", "size", "rank", "q", "gap_rank")
        .join(untouched, ["q", "gap_rank"])
        .withColumn("filled", F.sum("size").over(below))
        .select("id", "seq", "size", (capacity - F.col("gap") + F.col("filled") - F.col("size")).alias("offset"))
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Documents packed into sequences of at most `capacity` tokens; one row per piece.

    id, piece, start, length, ids_crc32 as in `token_pieces`, sequence_id and offset. Pieces of
    full length are sequences of their own and take no part in the rounds.

    Defined results: a null or empty text is the end token alone; repeated rows are packed once
    each; an empty table gives an empty table; other columns are not looked at.
    """
    pieces = stage(
        token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col)
        .withColumn("number", F.monotonically_increasing_id()), "pieces")
    places = pack(pieces.where(F.col("length") < capacity).select(F.col("number").alias("id"), F.col("length").alias("size")), capacity)
    placed = pieces.join(places.withColumnRenamed("id", "number"), "number", "left")
    # even numbers are packed sequences, odd ones full pieces
    return placed.select(
        "id", "piece", "start", "length", "ids_crc32",
        F.coalesce(F.col("seq") * 2, F.col("number") * 2 + 1).alias("sequence_id"),
        F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
