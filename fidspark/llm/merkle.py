"""Merkle manifest of a table, level by level, with lag and lead windows.

Rows are leaves; within a group they stand in order of their id. At each level
every FAN_OUT consecutive nodes are a run. Fixed-offset lag and lead columns
over the run's neighbourhood, masked by a node's slot and its run's length, are
its siblings to the left and to the right; the first child of each run hashes
itself with its right siblings, which gives the parent. The groups' subroots
then go through the same levels to one root. A leaf's proof is the list of its
siblings on the way up; it comes down from the top, one join a level, whose
sizes fall by FAN_OUT.

Nodes get their places from a range sort: place within the sorted partition,
plus the rows of the group in the partitions before. So no group, however
large, lies in one task, and windows span BLOCK nodes. Only digests and ids are
shuffled, never the rows' texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidspark.llm.common import stage, total

FAN_OUT = 8
#: Nodes per window partition, whole runs.
BLOCK_RUNS = 8
_STEP = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts in a row."""
    return F.sha2(F.concat(*parts), 256)


def group_key(value: Column) -> Column:
    """A text that orders as the values do bytewise, null first."""
    return F.coalesce(F.concat(F.lit("1"), value.cast("string")), F.lit("0"))


def _placed(nodes: DataFrame, order: Sequence[str], tag: str) -> DataFrame:
    """``nodes`` with their place (from 0) in group ``_g`` by ``order``, and the group's size ``_n``."""
    ranked = nodes.repartitionByRange("_g", *order).sortWithinPartitions("_g", *order)
    ranked = stage(ranked.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), tag)
    parts = ranked.groupBy("_g", "_part").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    along = Window.partitionBy("_g").orderBy("_part")
    parts = parts.select(
        "_g", "_part", "_first", F.sum("_rows").over(Window.partitionBy("_g")).alias("_n"),
        F.coalesce(F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return (ranked.join(parts, ["_g", "_part"]).withColumn("_pos", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_part", "_at", "_first", "_before"))


def _with_siblings(nodes: DataFrame, fan_out: int) -> DataFrame:
    """``nodes`` plus _left and _right: the digests of the run's others, joined."""
    slot = F.col("_pos") % fan_out
    length = F.least(F.lit(fan_out), F.col("_n") - F.col("_pos") + slot)
    near = Window.partitionBy("_g", F.floor(F.col("_pos") / (fan_out * BLOCK_RUNS))).orderBy("_pos")
    left = [F.when(slot >= k, F.lag("_digest", k).over(near)).otherwise("") for k in range(fan_out - 1, 0, -1)]
    right = [F.when(slot + k < length, F.lead("_digest", k).over(near)).otherwise("") for k in range(1, fan_out)]
    return nodes.withColumns({"_left": F.concat(*left), "_right": F.concat(*right)})


def _levels(nodes: DataFrame, fan_out: int, tag: str) -> list[DataFrame]:
    """The levels of all groups' trees, each staged, from the leaves up; a group ends with its one node (_n = 1)."""
    out, largest = [], total(nodes, F.max("_n"))
    while True:
        here = stage(_with_siblings(nodes, fan_out), f"{tag}{len(out)}")
        out.append(here)
        if largest <= 1:
            return out
        largest = -(-largest // fan_out)
        nodes = here.filter((F.col("_n") > 1) & (F.col("_pos") % fan_out == 0)).select(
            "_g", F.floor(F.col("_pos") / fan_out).alias("_pos"), F.ceil(F.col("_n") / fan_out).alias("_n"),
            digest(F.col("_digest"), F.col("_right")).alias("_digest"))


def _tops(levels: list[DataFrame]) -> DataFrame:
    """(_g, _digest): the node that remains of each group."""
    return reduce(DataFrame.unionByName, [x.filter("_n = 1").select("_g", "_digest") for x in levels])


def _descend(levels: list[DataFrame], above: DataFrame, carried: Sequence[str], fan_out: int) -> DataFrame:
    """The lowest level with what ``above`` has per group: _path, to which each level prepends its siblings, and ``carried``."""
    down = None
    for here in reversed(levels):
        extra = [c for c in here.columns if c not in ("_left", "_right")]
        found = here.filter("_n = 1").select(*extra).join(above, "_g")
        if down is not None:
            parent = down.select(F.col("_g").alias("_pg"), F.col("_pos").alias("_pp"), "_path", *carried)
            many = (here.filter("_n > 1").join(parent, (F.col("_g") == F.col("_pg")) & (F.floor(F.col("_pos") / fan_out) == F.col("_pp")))
                    .select(*extra, F.concat(F.array(F.struct(F.col("_left").alias("left"), F.col("_right").alias("right"))), "_path").alias("_path"),
                            *carried))
            found = found.unionByName(many)
        down = found
    return down


def manifest(rows: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """``rows`` (group, id, leaf, any others) plus subroot, root and path, the siblings (left, right) of each level.

    Leaves of a group stand by id, null first, rows of one id by their leaf; a
    null group is one of its own and comes first. A group of one leaf has the
    leaf as its subroot, one group its subroot as the root; such levels add no
    step to the path. Equal rows get different places, which may be swapped
    without any digest changing. No rows give no rows. ``rows`` is staged once,
    so it should hold digests, not texts.
    """
    if fan_out < 2:
        raise ValueError("a run has at least two nodes")
    kept = rows.select(group_key(F.col("group")).alias("_g"), F.col("id").alias("_id"), F.col("leaf").alias("_digest"), F.struct("*").alias("_row"))
    low = _levels(_placed(kept, ["_id", "_digest"], "leaves"), fan_out, "level")
    tops = _placed(_tops(low).select(F.lit("").alias("_g"), F.col("_g").alias("_group"), "_digest"), ["_group"], "subroots")
    high = _levels(tops, fan_out, "top")
    root = _tops(high).select("_g", F.col("_digest").alias("root"), F.array().cast(_STEP).alias("_path"))
    above = _descend(high, root, ["root"], fan_out).select(F.col("_group").alias("_g"), F.col("_digest").alias("subroot"), "root", "_path")
    return _descend(low, above, ["subroot", "root"], fan_out).select("_row.*", "subroot", "root", F.col("_path").alias("path"))


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to along ``path``."""
    return F.aggregate(path, leaf, lambda d, s: digest(s["left"], d, s["right"]))


def document_leaf(text: Column) -> Column:
    """The leaf of a row of documents whose text is ``text``."""
    return digest(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text))


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, grouped by lang: doc_id, lang, leaf, tampered, subroot, root, path.

    ``tampered`` is the leaf a row would have if its text's A to Z were
    lower-cased, for rows whose doc_id (as decimal text) has a CRC-32 that 3
    divides; null for others, and where doc_id is null. Null fields and texts
    are leaves as any. Other columns are not looked at. Texts of any length are
    read once, in place.
    """
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    leaves = docs.select(
        F.col("lang").alias("group"), F.col("doc_id").alias("id"), document_leaf(F.col("text")).alias("leaf"),
        F.when(chosen, document_leaf(lower)).alias("tampered"))
    return manifest(leaves).withColumnsRenamed({"group": "lang", "id": "doc_id"})
