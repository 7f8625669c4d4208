"""Line deduplication with a log-template tree.

Lines are parsed to a fixed depth: words that hold a digit become variable
fields, then a line goes to the leaf of its number of words and its first
DEPTH words. Within a leaf, a word at a place that fewer than LEAST_DOCS
lines share is generalised to a variable field too. What remains is the
line's template. Templates that recur in LEAST_DOCS documents or more, and
whose words are mostly fixed, are dropped from all of them. A line of fewer
than LEAST_WORDS words says less about itself and must recur in SHORT_DOCS.
Documents with equal texts count as one, so copies do not make their own lines
recur.

Leaves and templates are chosen on 64-bit keys; texts move only for lines in
leaves that recur, after equal ones have fallen together. The rows of a line,
a leading word or a template that many share are joined in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidspark.llm.common import hot_keys, join_split, let, stage, text_of, words_of

DEPTH, LEAST_DOCS, LEAST_WORDS, SHORT_DOCS, FIXED = 3, 3, 5, 6, 0.6
FIELD = "<*>"
_MASK = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _parsed(docs: DataFrame, depth: int, least_words: int, with_words: bool = False) -> DataFrame:
    """(_rid, n, doc_key, leaf, short, line_key[, words]) of each line that has a word.

    A line's words are taken apart once, within the array of lines: as columns
    the filter on empty ones would do it a second time.
    """
    def parse(line: Column, n: Column) -> Column:
        masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, _MASK, FIELD)).otherwise(line)
        return let(words_of(masked), lambda w: F.when(F.size(w) > 0, F.struct(
            n.alias("n"), F.xxhash64(F.size(w), F.slice(w, 1, depth)).alias("leaf"), (F.size(w) < least_words).alias("short"), F.xxhash64(w).alias("line_key"), *([w.alias("words")] * with_words))))

    # numbered before the lines are taken apart: a generator in the same select would come first
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), text_of().alias("_t")).withColumn("doc_key", F.xxhash64("_t"))
    lines = rows.select("_rid", "doc_key", F.explode(F.transform(F.split("_t", "\n"), parse)).alias("line"))
    return lines.filter("line is not null").select("_rid", "doc_key", "line.*")


def _recurring(df: DataFrame, key: str, least_docs: int, short_docs: int) -> DataFrame:
    """The keys that stand in enough different documents, with their number; lines of one key are all short or none is."""
    counted = df.select(key, "short", "doc_key").distinct().groupBy(key, "short").agg(F.count("*").alias("n_docs"))
    return counted.filter(F.col("n_docs") >= F.when(F.col("short"), short_docs).otherwise(least_docs)).drop("short")


def line_templates(docs: DataFrame, depth: int = DEPTH, least_docs: int = LEAST_DOCS, least_words: int = LEAST_WORDS, short_docs: int = SHORT_DOCS,
                   fixed: float = FIXED) -> DataFrame:
    """(_rid, n, template, n_docs): the lines to drop, with their recurring template."""
    heads = stage(_parsed(docs, depth, least_words), "lines")
    leaves = stage(_recurring(heads, "leaf", least_docs, short_docs).select("leaf"), "leaves")
    there = stage(heads.join(leaves, "leaf", "left_semi"), "candidates")
    line, place = ["leaf", "line_key"], ["leaf", "i", "word"]
    weights = stage(there.groupBy(*line, "doc_key").agg(F.count("*").alias("n")).groupBy(*line).agg(
        F.count("*").alias("weight"), F.sum("n").alias("n_lines")), "weights")
    hot_lines = hot_keys(weights, line, "n_lines")
    texts = (_parsed(docs, depth, least_words, with_words=True).select(*line, "words").join(leaves, "leaf", "left_semi").groupBy(*line).agg(F.min("words").alias("words"))
             .join(weights, line))
    tokens = stage(texts.select(*line, "weight", F.posexplode("words").alias("i", "word")), "tokens")
    # the leading words stand in all lines of a leaf
    shared = stage(tokens.groupBy(*place).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).filter(F.col("w") >= least_docs), "shared")
    known = join_split(tokens, shared.select(*place, F.lit(True).alias("kept")), place, hot_keys(shared, place, "n"), ["line_key"], "left")
    general = (known.groupBy(*line).agg(F.sort_array(F.collect_list(F.struct("i", F.when(F.col("kept"), F.col("word")).otherwise(FIELD).alias("w")))).alias("t"))
               .withColumn("words", F.col("t.w"))
               .filter(F.size(F.array_remove("words", FIELD)) >= fixed * F.size("words"))
               .select(*line, F.xxhash64("leaf", "words").alias("key"), F.array_join("words", " ").alias("template")))
    general = stage(general, "templates")
    lines = join_split(there, general.select(*line, "key"), line, hot_lines, ["_rid", "n"])
    often = _recurring(lines, "key", least_docs, short_docs)
    # one row per recurring template, then per line that has it, then per place of that line
    named = stage(often.join(general.groupBy("key").agg(F.min("template").alias("template"), F.count("*").alias("n")), "key"), "recurring")
    dropped = join_split(general.select(*line, "key"), named.drop("n"), ["key"], hot_keys(named, ["key"], "n"), ["line_key"])
    return join_split(there.select("_rid", "n", *line), dropped.drop("key"), line, hot_lines, ["_rid", "n"]).select("_rid", "n", "template", "n_docs")


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, text without the lines of recurring templates, n_lines, n_dropped, dropped (line numbers).

    A null text stays null, with no lines; an empty text has one line, which
    has no words and stays. A long text is taken apart into its lines like any
    other. Rows with equal texts lose the same lines. An empty table gives an
    empty table; columns other than doc_id and text are not looked at. The input is read
    several times and must give the same rows in the same order (files, or a
    staged table).
    """
    gone = line_templates(docs, **options).groupBy("_rid").agg(F.sort_array(F.collect_list("n")).alias("dropped"))
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), "doc_id", F.col("text").alias("_t"))
    lines = F.split("_t", "\n")
    out = rows.join(gone, "_rid", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    kept = F.when(F.size("dropped") == 0, F.col("_t")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("dropped", i)), "\n"))
    return out.select("doc_id", kept.alias("text"), F.when(F.col("_t").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
                      F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.col("dropped").cast("array<string>"), ",").alias("dropped"))
