"""Near-dedup by SuperMinHash signatures.

Every shingle draws one pseudo-random permutation of the signature's slots and offers slot p(j) the
value j + r(j), r uniform in [0, 1); a slot keeps the least offer. Offers of one shingle fall on
different slots and rise with j, which lowers the variance of the estimate against independent hashes,
and a document is done at the first level j below which all its slots lie: mostly after two or three
steps a shingle instead of one for every slot. Levels run for all shingles of many documents at once.

Documents with one set of shingles are one class from the start. Bands of equal slots make buckets.
Members of a bucket whose sizes and signatures allow a link are suspects; their full sets are built
again from their texts. In a bucket all suspects are confirmed against its first member; what that
leaves in different components is confirmed in blocks of bounded size, the most similar first, by
union-find. Every link is confirmed on full sets, and a task returns no more links than it has
members. The forests of the tasks are grouped by union-find in batches and `components.roots`.

With 32 bands of 5 of 160 slots a pair of similarity 0.85 shares no band with probability 7e-9, and
its signature estimate is below the bound of 0.65 with less. No bucket is cut and no partner is capped.

Defined results: a document without words has an empty set and is linked with nothing; fewer words
than a shingle are one shingle of all of them; ids may be null or repeated: rows are told apart by
their sets, and a null id never names a component unless all its ids are null; an empty table gives
an empty table. Texts are read whole, in pieces; a set takes 8 bytes a shingle, about the text's own
size. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.components import roots
from opsmetrics.llm.simhash_dedup import shingle_hashes
from opsmetrics.session import ship_package, stage

SLOTS, BANDS = 160, 32
LIKELY = 0.65  # share of equal slots below which a pair is not confirmed on its sets
ELEMENTS = 1 << 15  # shingles that go through the levels together
BLOCK = 1024  # members of a bucket in one block, about
SHINGLES = 1 << 22  # shingles of a block's sets, about
FIRST_BANDS = 4

_LOW = np.uint64(0xFFFFFFFF)
_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers (multiplications wrap)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(elements: np.ndarray, level: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Per element the value level + r as a 64-bit fixed-point number and a slot number in [level, slots)."""
    x = _mix(elements + np.uint64(((level + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    pick = np.int64(level) + (((x & _LOW) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)
    return np.uint64(level << 32) | (x >> np.uint64(32)), pick


def _offer(signs: np.ndarray, owner: np.ndarray, elements: np.ndarray) -> None:
    """Lower `signs` (documents x slots) by all offers of the elements; owner is each one's row."""
    slots = signs.shape[1]
    places = None  # each element's permutation, as far as it is drawn
    for level in range(slots):
        value, pick = _draws(elements, level, slots)
        if level == 0:
            place, first = pick, pick
        else:
            if places is None:
                places = np.tile(np.arange(slots, dtype=np.int16), (len(elements), 1))
                places[np.arange(len(elements)), first] = 0
            at = np.arange(len(elements))
            place = places[at, pick].astype(np.int64)
            places[at, pick] = places[:, level]
        np.minimum.at(signs.reshape(-1), owner * slots + place, value)
        # a later offer is at least the next level: of use only to documents with a slot above it
        more = signs.max(axis=1) >= np.uint64((level + 1) << 32)
        stay = more[owner]
        if not stay.all():
            elements, owner = elements[stay], owner[stay]
            if not len(elements):
                return
            places = places[stay] if places is not None else None
            first = first[stay] if places is None else first


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """One row of `slots` 64-bit values per set."""
    signs = np.full((len(sets), slots), _UNSET)
    group: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            rows = sorted({d for d, _ in group})
            local = {d: i for i, d in enumerate(rows)}
            some = signs[rows]
            owner = np.concatenate([np.full(len(e), local[d], dtype=np.int64) for d, e in group])
            _offer(some, owner, np.concatenate([e for _, e in group]))
            signs[rows] = some
        group, size = [], 0

    for d, elements in enumerate(sets):
        for at in range(0, len(elements), ELEMENTS):
            piece = elements[at:at + ELEMENTS]
            if size + len(piece) > ELEMENTS:
                flush()
            group.append((d, piece))
            size += len(piece)
    flush()
    return signs


def band_keys(signs: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band, of its slots and its number; equal slots give equal keys."""
    width = signs.shape[1] // bands
    parts = signs[:, :bands * width].reshape(len(signs), bands, width)
    key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signs), bands)).copy()
    for i in range(width):
        key = _mix(key ^ parts[:, :, i])
    return key


def shingle_set(text: str | None, words: int, seed: int) -> np.ndarray:
    """The distinct shingles of a text by their XXH64, ascending."""
    runs = list(shingle_hashes(text or "", words, seed))
    return np.unique(np.concatenate(runs)).astype(np.uint64) if runs else np.zeros(0, dtype=np.uint64)


def _signed_rows(docs: DataFrame, words: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text_digest, n, d1, d2, bands, print) per row: d1 and d2 are a digest of the set,
    print has 16 bits of each slot. A map, no shuffle; written."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words, seed) for t in batch.column(1)]
            signs = signatures(sets)
            digests = np.array([
                np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype="<i8") for s in sets],
                dtype=np.int64).reshape(-1, 2)
            keys = band_keys(signs).view(np.int64)
            prints = (_mix(signs) & np.uint64(0xFFFF)).astype("<u2")
            ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1))),
                pa.array([p.tobytes() for p in prints], pa.binary())],
                names=["id", "text_digest", "n", "d1", "d2", "bands", "print"])

    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"),
                         F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("text_digest"))
    signed = narrow.mapInArrow(
        run, "id long, text_digest string, n long, d1 long, d2 long, bands array<long>, print binary")
    return stage(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")


def _top(above: dict[int, int], x: int) -> int:
    """The root of x in a forest of parents; paths are shortened on the way."""
    root = x
    while (up := above.get(root, root)) != root:
        root = up
    while x != root:
        above[x], x = root, above[x]
    return root


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, at most one per node and batch of a task: union-find."""
    ship_package(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above: dict[int, int] = {}
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((_top(above, a), _top(above, b)))
                above[low] = low
                above[high] = low
            pairs = [(x, _top(above, x)) for x in above]
            pairs = [(x, r) for x, r in pairs if x != r]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame, members: str, shingles: str | None = None) -> DataFrame:
    """`rows` (key, uid, ...) dealt into the groups (key, lo, hi) in which they are compared.

    A bucket is dealt into blocks of about `BLOCK` members, or of `SHINGLES` shingles where the sets go
    along; a block meets itself and every other one in a group of rows of its own, so a task holds two
    blocks at most, whatever the bucket's size.
    """
    number = F.ceil(F.col(members) / BLOCK)
    if shingles:
        number = F.greatest(number, F.ceil(F.col(shingles) / SHINGLES))
    rows = rows.withColumn("blocks", number).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("long"))
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumns({
        "lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")


def _per_group(rows: DataFrame, columns: list[str], schema: str, work: Callable[[list[tuple]], pa.RecordBatch]) -> DataFrame:
    """`work` on the rows of each (key, lo, hi); a task holds one group at a time."""
    order = ["key", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    yield work(group)
                    group = []
                group.append(row)
        if group:
            yield work(group)

    return rows.repartition(*order).sortWithinPartitions(*order).select(*order, *columns).mapInArrow(run, schema)


def _prints(group: list[tuple], at: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[at] for r in group), dtype="<u2").reshape(-1, SLOTS)


def _suspects(met: DataFrame, distinct: DataFrame, percent: int) -> DataFrame:
    """The uids that share a bucket with one whose size and signature allow a link. A member is told by
    the first such partner, so a bucket of near copies needs a few comparisons each."""
    rows = _blocks(met, "members").join(distinct.select("uid", "n", "print"), "uid")

    def work(group: list[tuple]) -> pa.RecordBatch:
        uid, n = (np.array([r[i] for r in group], dtype=np.int64) for i in (3, 4))
        prints, known = _prints(group, 5), np.zeros(len(group), dtype=bool)
        for i in range(len(group)):
            other = np.flatnonzero(~known if known[i] else np.arange(len(group)) > i)
            other = other[(other > i) & (100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i]))]
            if len(other):
                near = other[(prints[other] == prints[i]).sum(axis=1) >= LIKELY * SLOTS]
                known[near] = True
                known[i] |= len(near) > 0
        return pa.RecordBatch.from_arrays([pa.array(uid[known])], ["uid"])

    return _per_group(rows, ["uid", "n", "print"], "uid long", work).distinct()


def _sets(suspects: DataFrame, distinct: DataFrame, docs: DataFrame, words: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(uid, n, print, members): the full sets of the suspects, built again from their texts, so that no
    table ever holds the sets of all documents. Written."""
    wanted = stage(suspects.join(distinct.select(
        "uid", "n", "print", F.col("id").alias("w_id"), F.col("text_digest").alias("w_digest")), "uid"), "wanted")
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    same = F.col("id").eqNullSafe(F.col("w_id")) & (F.sha2("text", 256) == F.col("w_digest"))
    one = Window.partitionBy("uid").orderBy(F.lit(1))
    found = texts.join(wanted.select("uid", "w_id", "w_digest"), same).select("uid", "text").withColumn(
        "copy", F.row_number().over(one)).where("copy = 1")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), words, seed).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["uid", "members"])

    sets = found.select("uid", "text").mapInArrow(build, "uid long, members binary")
    return stage(wanted.select("uid", "n", "print").join(sets, "uid"), "sets")


def _linked(x: bytes, y: bytes, percent: int) -> bool:
    a, b = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _star_links(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links between a bucket's first member and its others: a row per member and bucket at most."""
    stars = met.where("uid > pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b")).distinct()

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("uid").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(-1, SLOTS) for i in (2, 3))
                batch = batch.filter(pa.array((x == y).sum(axis=1) >= LIKELY * SLOTS))
            yield batch.select([0, 1])

    near = stars.join(side("a", "n", "print"), "a").join(side("b", "n", "print"), "b").where(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    pairs = stage(near.select("a", "b", "print_a", "print_b").mapInArrow(likely, "a long, b long"), "likely")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_linked(x, y, percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    full = pairs.join(side("a", "members"), "a").join(side("b", "members"), "b")
    return stage(full.select("a", "b", "members_a", "members_b").mapInArrow(confirm, "a long, b long"), "links")


def _block_links(met: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join components which still share a bucket; its first member is compared already.

    In a group of rows the most similar pairs come first and a pair inside one component is passed
    over, so a group of near copies is joined with about one confirmation a member, and what is
    returned is at most one link for each.
    """
    rest = met.where("uid <> pivot").select("key", "uid").join(sets.select("uid", "n"), "uid").join(
        found.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    mixed = rest.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"),
        F.sum("n").alias("shingles")).where("low <> high").drop("low", "high")
    dealt = _blocks(rest.join(mixed, "key"), "members", "shingles").select("key", "lo", "hi", "block", "uid", "root")
    rows = dealt.join(sets, "uid")

    def work(group: list[tuple]) -> pa.RecordBatch:
        block, uid, root, n = (np.array([r[i] for r in group], dtype=np.int64) for i in (3, 4, 5, 6))
        prints, apart = _prints(group, 7), group[0][1] != group[0][2]
        pairs = []
        for i in range(len(group)):
            other = np.flatnonzero((uid > uid[i]) & (root != root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
            if apart:
                other = other[block[other] != block[i]]
            if len(other):
                same = (prints[other] == prints[i]).sum(axis=1)
                near = same >= LIKELY * SLOTS
                pairs.append(np.stack([same[near], np.full(near.sum(), i), other[near]]))
        above: dict[int, int] = {}
        links = ([], [])
        if pairs:
            order = np.concatenate(pairs, axis=1)
            for _, i, j in order[:, np.argsort(-order[0], kind="stable")].T.tolist():
                a, b = _top(above, int(root[i])), _top(above, int(root[j]))
                if a != b and _linked(group[i][8], group[j][8], percent):
                    above[max(a, b)] = min(a, b)
                    links[0].append(int(uid[i]))
                    links[1].append(int(uid[j]))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["a", "b"])

    return stage(_per_group(rows, ["block", "uid", "root", "n", "print", "members"], "a long, b long", work), "links")


def clusters(
    docs: DataFrame, words: int = 5, percent: int = 85, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_shingles, component_id) per row. Sets link when 100 x intersection >= percent x union;
    a component is named by its smallest id. The bands are made for a percent of 85 and more."""
    rows = _signed_rows(docs, words, seed, id_col, text_col)
    classes = stage(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("uid"), F.min("id").alias("first_id")), "classes")
    distinct = stage(rows.join(classes.select("uid", "first_id"), F.col("row") == F.col("uid")).select(
        "uid", "id", "text_digest", "first_id", "n", "bands", "print"), "distinct")

    members = distinct.select("uid", F.posexplode("bands").alias("band", "key"))
    crowded = members.groupBy("key").agg(F.min("uid").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    met = stage(members.join(crowded, "key"), "buckets")
    sets = _sets(_suspects(met, distinct, percent), distinct, docs, words, seed, id_col, text_col)

    links = _star_links(met, sets, percent)
    found = roots(forest(links))
    # a few bands join most of what belongs together; the others then have little left to compare
    for some in (F.col("band") < FIRST_BANDS, F.col("band") >= FIRST_BANDS):
        links = links.unionAll(_block_links(met.where(some), found, sets, percent))
        found = roots(forest(links))

    named = distinct.select("uid", "first_id").join(found.withColumnRenamed("node", "uid"), "uid", "left").withColumn(
        "root", F.coalesce("root", "uid"))
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    per_set = stage(classes.select("d1", "d2", "uid").join(named.select("uid", "root"), "uid").join(names, "root").select(
        "d1", "d2", "component_id"), "components")
    linked = rows.where("n > 0").join(per_set, ["d1", "d2"]).select("id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
