"""Exact deduplication by deterministic block naming.

Texts lose their white space and are cut into blocks of fixed size. Distinct
blocks, in sorted order, get integer names; then adjacent names are paired and
the distinct pairs named again, until one integer stands for each document.
Two documents share (number of blocks, final name) exactly if their texts are
equal: a name is given to a text or a pair, never to a hash of it.

Block texts are shuffled once, pre-aggregated per task, under a 64-bit sort
key. Where a key belongs to one text only (the rule), rows take their name by
the key; texts whose keys collide are named and joined by the text itself. A
document that holds a block or pair which occurs once in the corpus has no
copy, so it leaves the recursion with that level. Only names and pairs, two
integers each, take part above the first level.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidspark.llm.common import SPACES, hot_keys, join_split, stage, text_of

BLOCK_CHARS = 16384
_NONE = -(2**63)  # partner of an odd last block


def _rows(docs: DataFrame, block_chars: int, sort_key: Callable[[Column], Column]) -> DataFrame:
    """One row per document: _rid, doc_id, n_chars, norm, blocks[(key, block)]."""
    norm = docs.select(
        F.monotonically_increasing_id().alias("_rid"), F.col("doc_id"), F.length(text_of()).cast("long").alias("n_chars"),
        F.regexp_replace(text_of(), SPACES, "").alias("norm"))
    cut = F.when(F.col("norm") == "", F.array(F.lit(""))).when(
        F.length("norm") <= block_chars, F.array("norm")).otherwise(
        F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))
    return norm.withColumn("blocks", F.transform(cut, lambda b: F.struct(sort_key(b).alias("key"), b.alias("block"))))


def _named(distinct: DataFrame, *order: str) -> DataFrame:
    """Integer names in sorted order; staged, so that they are given once."""
    ordered = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ordered.withColumn("name", F.monotonically_increasing_id()), "names")


def _first_names(docs: DataFrame, heads: DataFrame, block_chars: int, sort_key) -> DataFrame:
    """(_rid, pos, name, n): a name for each block and how often it occurs."""
    texts = (_rows(docs, block_chars, sort_key).select(F.explode("blocks").alias("b"))
             .groupBy("b.key", "b.block").agg(F.count("*").alias("n")))
    keys = _named(texts.groupBy("key").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n")), "key")
    places = heads.select("_rid", F.posexplode("keys").alias("pos", "key"))
    named = places.join(keys, "key")
    plain = named.filter("n_texts = 1").select("_rid", "pos", "name", "n")
    clash = keys.filter("n_texts > 1").select("key")
    if clash.isEmpty():
        return plain
    clashing = (_rows(docs, block_chars, sort_key).select("_rid", F.posexplode("blocks").alias("pos", "b"))
                .select("_rid", "pos", F.col("b.key").alias("key"), F.col("b.block").alias("block"))
                .join(clash, "key", "left_semi"))
    names = _named(clashing.groupBy("key", "block").agg(F.count("*").alias("n")), "key", "block")
    return plain.unionByName(clashing.join(names, ["key", "block"])
                             .select("_rid", "pos", (-F.col("name") - 1).alias("name"), "n"))


def document_names(docs: DataFrame, block_chars: int = BLOCK_CHARS,
                   sort_key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: _rid, doc_id, n_chars, text_sha256, n_blocks, name.

    ``name`` is null for a document without a copy; else (n_blocks, name) is
    shared by exactly the documents with equal text. ``docs`` is read twice
    and must give the same rows in the same order (files, or a staged table).
    """
    heads = stage(_rows(docs, block_chars, sort_key).select(
        "_rid", "doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"),
        F.col("blocks.key").alias("keys")), "heads")
    sizes = heads.select("_rid", F.size("keys").alias("n_blocks"))
    left = _first_names(docs, heads, block_chars, sort_key).join(sizes, "_rid")
    done, level = None, 0
    longest = heads.agg(F.max(F.size("keys")).alias("n")).first()["n"] or 1
    while True:
        left = stage(left, f"level{level}")
        # the length of a document at this level tells when one name is left
        length = F.ceil(F.col("n_blocks") / F.lit(2**level))
        single = left.filter((length == 1) & (F.col("n") > 1)).select("_rid", "name")
        done = single if done is None else done.unionByName(single)
        if 2**level >= longest:
            break
        alone = left.filter("n = 1").select("_rid").distinct()
        open_ = left.filter(length > 1).join(alone, "_rid", "left_anti")
        if open_.isEmpty():
            break
        pairs = open_.groupBy("_rid", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(_NONE)).alias("b"))
        pairs = stage(pairs, f"pairs{level}")
        names = _named(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), "a", "b")
        left = pairs.join(names, ["a", "b"]).select("_rid", "pos", "name", "n", "n_blocks")
        level += 1
    return heads.join(done, "_rid", "left").select(
        "_rid", "doc_id", "n_chars", "text_sha256", F.size("keys").alias("n_blocks"), "name")


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS,
                sort_key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: _rid, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in its original text
    stays, then the smallest doc_id (nulls last), then the first in input
    order, so repeated rows leave exactly one. A null text is empty; empty and
    white-space texts are equal to each other. Other columns are not looked
    at. An empty table gives an empty table. ``_rid`` is
    monotonically_increasing_id() of the input, for joining back.
    """
    rows = stage(document_names(docs, block_chars, sort_key), "named")
    order = F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("keep_id"),
                     F.col("_rid").alias("keep_rid"))
    text = ["n_blocks", "name"]
    groups = stage(rows.filter("name is not null").groupBy(*text)
                   .agg(F.count("*").alias("group_size"), F.min(order).alias("k"))
                   .select(*text, "group_size", "k.keep_id", "k.keep_rid"), "groups")
    copies = (join_split(rows.filter("name is not null"), groups, text, hot_keys(groups, text, "group_size"), ["_rid"])
              .select("_rid", "doc_id", "keep_id", "group_size", (F.col("_rid") == F.col("keep_rid")).alias("kept"),
                      "text_sha256"))
    alone = rows.filter("name is null").select(
        "_rid", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(copies)


def drop_copies(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows that are copies; same columns."""
    kept = exact_dedup(docs, block_chars).filter("kept").select("_rid")
    packed = docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct("*").alias("_row"))
    return packed.join(kept, "_rid", "left_semi").select("_row.*")
