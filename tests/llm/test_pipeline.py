"""The pipeline stage by stage against what each stage promises, on odd, empty and given tables."""

from collections import Counter

import duckdb
import pandas as pd
import pytest
from llm_fixtures import docs, no_docs  # noqa: F401

import corpus_pipeline
from fidspark.llm import exact_dedup, quality_rules, simhash
from fidspark.llm.common import stage
from fidspark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = stage(f(spark, docs, SF), "test")
        assert docs.columns == names
        kept[name] = docs
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {r.doc_id for r in quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).filter("kept").collect()}
    assert {r.doc_id for r in kept["quality_rules"].collect()} == good
    assert {r.doc_id for r in kept["exact_dedup"].collect()} == {r.doc_id for r in exact_dedup.exact_dedup(kept["quality_rules"]).filter("kept").collect()}
    assert {r.doc_id for r in kept["simhash_near_dedup"].collect()} == {r.component_id for r in simhash.classes(kept["exact_dedup"]).collect()}
    mixed = Counter(r.doc_id for r in kept["mix_sources"].collect())
    assert max(mixed.values()) <= 2 and all(r.text == texts[r.doc_id] or r.text in " ".join(texts[r.doc_id].split()) for r in kept["mix_sources"].collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == mixed


@pytest.mark.parametrize("table", ["docs", "no_docs"])
def test_every_stage_takes_odd_tables(spark, request, table):
    docs = request.getfixturevalue(table)
    for _, f in corpus_pipeline.STAGES:
        f(spark, stage(docs, "test"), SF).collect()


def test_near_dedup_keeps_unrelated_texts_with_null_or_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = spark.createDataFrame([(None, a), (None, b), (None, b), (7, c), (7, d), (8, d), (None, d)], "doc_id long, text string")
    assert Counter(tuple(r) for r in simhash.keep_one(stage(rows, "test")).collect()) == Counter([(None, a), (None, b), (7, c), (7, d)])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(ORACLE[name]).fetchdf()
    got = QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: Counter(tuple(None if pd.isna(v) else v for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
