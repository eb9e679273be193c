"""Merkle manifest of a dataset: a tree per group over its rows, and a tree over the groups' roots.

Siblings come from lag and lead columns. The rows of a group are cut into chunks of fan^depth
consecutive leaves, so no run of siblings crosses a chunk. Inside a chunk the first leaf of a node
stands for it: at level j the siblings of a node are fan^j, 2 fan^j, ... rows away, a mask by slot and
run length says which of them exist, and the row of a first child hashes the parent. The chunks'
roots are the leaves of the next, much smaller table, until one node per group is left; these
subroots are the leaves of the last tree. Windows only ever see one chunk, and a leaf meets its
upper siblings by one join on (group, chunk), so a hot group is no hot key.

Defined results: a null field is `-`, an empty one `0:`; long texts are hashed whole by one task and
never shuffled; leaves ascend by id (null ids first, then by leaf), so that ties and repeated rows give
the same tree in whatever order they are read; a null group is a group of its own, the first; a group
of one leaf has that leaf as its root; an empty table gives no rows. Only the named columns are read,
so further columns of any name are no matter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.ranks import numbered
from opsmetrics.session import stage

FAN, DEPTH = 3, 7  # 2,187 leaves a chunk stay below the window operator's in-memory rows
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as `bytes:value`, null as `-`."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def node_hash(parts: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def leaves(
    docs: DataFrame, columns: Sequence[str], id_col: str = "doc_id", group_col: str = "source",
    altered: dict[str, Column] | None = None,
) -> DataFrame:
    """(id, grp, leaf, altered) per row of `docs`; `altered` is the leaf with some columns replaced."""
    def leaf(instead: dict[str, Column]) -> Column:
        return node_hash([field(instead.get(c, docs[f"`{c}`"])) for c in columns])

    return docs.select(
        docs[id_col].cast("long").alias("id"), docs[group_col].cast("string").alias("grp"),
        leaf({}).alias("leaf"), leaf(altered or {}).alias("altered"))


def _windowed(nodes: DataFrame, fan: int, depth: int) -> DataFrame:
    """`nodes` (g, n, pos, hash, ...) with their chunk, the siblings of `depth` levels as `path`, and,
    in a chunk's first row, its root as `top`."""
    df = nodes.withColumns({"chunk": F.expr(f"pos div {fan ** depth}L"), "h0": F.col("hash")})
    w = Window.partitionBy("g", "chunk").orderBy("pos")
    levels = []
    for j in range(depth):
        step, h = fan ** j, F.col(f"h{j}")
        node, count = F.expr(f"pos div {step}L"), F.expr(f"(n + {step - 1}L) div {step}L")
        slot, stands = node % fan, F.col("pos") % step == 0
        left = F.concat(*[
            F.when(slot >= i, F.lag(h, i * step).over(w)).otherwise("") for i in range(fan - 1, 0, -1)])
        right = F.concat(*[
            F.when((slot + i < fan) & (node + i < count), F.lead(h, i * step).over(w)).otherwise("")
            for i in range(1, fan)])
        df = df.withColumns({f"l{j}": F.when(stands, left), f"r{j}": F.when(stands, right)})
        df = df.withColumn(f"h{j + 1}", F.when(
            stands & (slot == 0), F.when(count > 1, node_hash([h, F.col(f"r{j}")])).otherwise(h)))
        # a row takes the siblings of the node it lies under from that node's first row
        back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        levels.append(F.when(count > 1, F.struct(*[
            F.last(f"{side[0]}{j}", ignorenulls=True).over(back).alias(side) for side in ("left", "right")])))
    return df.select(
        *nodes.columns, "chunk", F.col(f"h{depth}").alias("top"), F.array_compact(F.array(*levels)).alias("path"))


def _alone(tops: DataFrame) -> DataFrame:
    """Nothing above: a tree's last node is its root."""
    return tops.select("g", "pos", F.col("hash").alias("subroot"), F.col("hash").alias("root"),
                       F.array().cast(PATH).alias("path"))


def _climb(
    nodes: DataFrame, largest: int, fan: int, depth: int, crown: Callable[[DataFrame], DataFrame] = _alone,
) -> DataFrame:
    """`nodes` with subroot, root and path; `largest` is the greatest n."""
    size = fan ** depth
    inner = _windowed(nodes, fan, depth)
    tops = stage(inner.where(F.col("pos") % size == 0).select(
        "g", F.expr(f"(n + {size - 1}L) div {size}L").alias("n"), F.col("chunk").alias("pos"),
        F.col("top").alias("hash")), "tops")
    above = crown(tops) if largest <= size else _climb(tops, -(-largest // size), fan, depth, crown)
    above = above.select(F.col("g").alias("_g"), F.col("pos").alias("_chunk"), "subroot", "root", F.col("path").alias("_path"))
    return inner.join(above, (F.col("g") == F.col("_g")) & (F.col("chunk") == F.col("_chunk"))).select(
        *nodes.columns, "subroot", "root", F.concat("path", "_path").alias("path"))


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def manifest(rows: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """(id, leaf, altered, subroot, root, path) per row of `leaves`.

    path lists, from the leaf to the root, the hashes of the siblings left and right of the way.
    """
    def over_groups(subroots: DataFrame) -> DataFrame:
        groups = numbered(subroots.select(F.lit(0).alias("all"), F.col("g").alias("group"), "hash"), ["all"], ["group"])
        crowned = stage(_climb(groups, _largest(groups), fan, depth), "crown")
        return crowned.select(F.col("group").alias("g"), F.lit(0).cast("long").alias("pos"),
                              F.col("hash").alias("subroot"), "root", "path")

    written = stage(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    placed = numbered(written, ["grp"], ["id", "leaf", "row"]).withColumn("hash", F.col("leaf"))
    return _climb(placed, _largest(placed), fan, depth, over_groups).select(
        "id", "leaf", "altered", "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """The hash of all siblings, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, x: node_hash([x["left"], h, x["right"]]))
