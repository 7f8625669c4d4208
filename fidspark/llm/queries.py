"""Registered queries of the operators, with production parameters and digest columns, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidspark.llm import (exact_dedup, license_scan, line_dedup, merkle, mixing, packing, pii, quality_classifier, quality_rules, ranked_search,
                          simhash, substring_dedup, warc)
from fidspark.llm.common import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = pii.find(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in pii.PATTERNS), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/fidspark-llm/warc-{uuid.uuid4().hex}"
    warc.write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# The base32 text of a SHA-1: 20 bits, five hex digits, give four characters.
_B32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // {d}) % 32 AS INT) + 1, 1)"
ORACLE["op2_warc"] = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages
)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 8), lambda i: list_transform([CAST('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5) AS BIGINT)],
         lambda v: {" || ".join(_B32.format(d=32**k) for k in (3, 2, 1, 0))})[1]), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM p
"""


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash.classes(docs).select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_classifier.score_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("raw")


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return judged.select("doc_id", *(f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                         "base_failed", "kept", "posterior")


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(docs, tokenizer_path())


@query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup.drop_lines(docs)


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup.exact_dedup(docs).drop("_rid")


ORACLE["op8_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").cast("string").alias("source"), "text")
    taken = F.aggregate("drawn", F.lit(0).cast("long"), lambda n, d: n + d["words"])
    return mixing.draws(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("drawn").alias("copies"))


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("blocks")


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op11_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS (
  SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM d
), windows AS (
  SELECT rid, i, n, string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS t FROM words
), counted AS (
  SELECT rid, i, count(*) OVER (PARTITION BY t) AS c FROM windows WHERE i <= n - 34
), gone AS (
  SELECT DISTINCT rid, i + k AS i FROM counted, range(35) AS r(k) WHERE c > 1
), kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE["op12_ranked_search"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_TERMS.format("text")} AS t FROM documents
), size AS (
  SELECT rid, doc_id, len(t) AS n FROM d WHERE len(t) > 0
), tf AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(t) AS term FROM d) GROUP BY rid, term
), items AS (
  SELECT item_id, qid, term, count(*) AS q
  FROM (SELECT item_id, row_number() OVER () AS qid, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY item_id, qid, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT count(*) FROM size) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf SEMI JOIN items USING (term) GROUP BY term
), scored AS (
  SELECT qid, item_id, rid, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM items JOIN w USING (term) JOIN tf USING (term)
  JOIN (SELECT rid, doc_id, 75 + (25 * n * (SELECT count(*) FROM size)) // (SELECT CAST(sum(n) AS BIGINT) FROM size) AS m FROM size) USING (rid)
  GROUP BY qid, item_id, rid, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.document_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root",
                        (F.col("folded_root") == F.col("root")).alias("verified"))


def _merkle_sql(low: int = 8, high: int = 3) -> str:
    """Up to 8 ** low leaves a lang and 8 ** high langs."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda t: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", t)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), "
           "lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)")
    parts = [f"""leaves AS (SELECT *, coalesce('1' || lang, '0') AS g, {leaf("text")} AS leaf,
                 CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} END AS bad FROM documents)""",
             """a0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n,
                 leaf AS d, doc_id, bad FROM leaves)"""]

    def levels(name: str, count: int) -> None:
        for k in range(count + 1):
            if k:
                parts.append(f"""{name}{k} AS (SELECT g, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d
                                 FROM {name}{k - 1} GROUP BY g, pos // 8, n)""")
            parts.append(f"""{name}{k}s AS (SELECT x.g, x.pos, x.n, x.d, coalesce(string_agg(y.d, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l,
                             coalesce(string_agg(y.d, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r
                             FROM {name}{k} x JOIN {name}{k} y ON x.g = y.g AND x.pos // 8 = y.pos // 8 GROUP BY x.g, x.pos, x.n, x.d)""")

    levels("a", low)
    parts.append(f"b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n, d, g AS lg FROM a{low})")
    levels("b", high)
    steps, joins, acc = [], [], "coalesce(a0.bad, a0.d)"
    for name, count, pos in (("a", low, "a0.pos"), ("b", high, "b0.pos")):
        for k in range(count):
            s = f"{name}{k}s"
            joins.append(f"JOIN {s} ON {s}.g = {name}0.g AND {s}.pos = {pos} // {8**k}")
            steps.append(f"{s}.l || {s}.r")
        if name == "a":
            joins.append("JOIN b0 ON b0.lg = a0.g")
    parts.append(f"""up0 AS (SELECT a0.doc_id, a0.d AS leaf, b0.d AS subroot, (SELECT d FROM b{high}) AS root, sha256({' || '.join(steps)}) AS proof_sha256,
                     {acc} AS f, {', '.join(f'{n}{k}s.l AS {n}{k}l, {n}{k}s.r AS {n}{k}r, {n}{k}s.n AS {n}{k}n' for n, c in (('a', low), ('b', high)) for k in range(c))}
                     FROM a0 {' '.join(joins)})""")
    last = 0
    for n, c in (("a", low), ("b", high)):
        for k in range(c):
            parts.append(f"up{last + 1} AS (SELECT * REPLACE (CASE WHEN {n}{k}n = 1 THEN f ELSE sha256({n}{k}l || f || {n}{k}r) END AS f) FROM up{last})")
            last += 1
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM up{last}"


ORACLE["op13_merkle_manifest"] = _merkle_sql()
