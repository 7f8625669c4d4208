"""Line templates, ridge scores, isotonic curves and disclosing terms against plain versions of their definitions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from llm_fixtures import docs  # noqa: F401
from pyspark.sql import functions as F

from fidspark.llm import common, line_dedup, pii, quality_classifier
from fidspark.llm.quality_rules import with_stats
from test_operators import WORD, brute_spans, rows_of

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- line templates
def brute_dropped(rows, depth=3, least=3, least_words=5, short=6, fixed=0.6):
    """Per text the numbers of its dropped lines; the tree's leaves are not used to find them."""
    lines = [(t, n, tuple("<*>" if re.search("[0-9]", w) else w for w in WORD.findall(x)))
             for t in {t for _, t in rows} for n, x in enumerate(t.split("\n"))]
    lines = [(t, n, w) for t, n, w in lines if w]
    leaf = lambda w: (len(w), w[:depth])
    share = Counter((leaf(w), i, x) for t, w in {(t, w) for t, _, w in lines} for i, x in enumerate(w))
    template = lambda w: (leaf(w), tuple(x if share[leaf(w), i, x] >= least else "<*>" for i, x in enumerate(w)))
    texts = defaultdict(set)
    for t, _, w in lines:
        texts[template(w)].add(t)
    out = defaultdict(list)
    for t, n, w in lines:
        words = template(w)[1]
        if len(texts[template(w)]) >= (short if len(w) < least_words else least) and sum(x != "<*>" for x in words) >= fixed * len(words):
            out[t].append(n)
    return {t: ",".join(map(str, sorted(out[t]))) for _, t in rows}


def check_lines(df):
    rows = rows_of(df)
    want = brute_dropped(rows)
    assert Counter((r.doc_id, r.dropped) for r in line_dedup.drop_lines(df).collect()) == Counter((i, want[t]) for i, t in rows)
    return want


def test_lines_of_documents_match_brute_force(spark, docs):
    assert any(check_lines(spark.read.parquet(f"{SF}/documents.parquet")).values())
    check_lines(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_of_random_texts_match_brute_force(spark, seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(["a", "b", "c", "d1", "e22"]) for _ in range(rng.choice([0, 1, 2, 4, 5, 6, 7])))
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(1, 9)))) for i in range(150)]
    want = check_lines(spark.createDataFrame(rows + rows[:20], "doc_id long, text string"))
    assert 0 < sum(map(bool, want.values())) < len(want)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_joins_equal_plain_ones(spark, how):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 900).cast("long").alias("k"), (F.col("id") % 2).alias("z"))
    counted = rows.groupBy("k", "z").agg(F.count("*").alias("n")).filter("k % 5 <> 1").cache()
    hot = common.hot_keys(counted, ["k", "z"], "n")
    assert len(hot) == 2 and common.hot_keys(counted.limit(0), ["k", "z"], "n") == []
    got = common.join_split(rows, counted, ["k", "z"], hot, ["id"], how)
    want = rows.join(counted, ["k", "z"], how)
    assert got.columns == want.columns and Counter(got.collect()) == Counter(want.collect())


# ---------------------------------------------------------------- quality classifier
def test_isotonic_equals_the_least_maximum_of_means():
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 40):
        n = rng.integers(1, 5, size)
        y = np.array([rng.integers(0, k + 1) for k in n], float)
        x = np.sort(rng.normal(size=size))
        mean = lambda j, k: y[j:k + 1].sum() / n[j:k + 1].sum()
        want = [max(min(mean(j, k) for k in range(i, size)) for j in range(i + 1)) for i in range(size)]
        at, level = quality_classifier.isotonic(list(zip(x.tolist(), y.tolist(), n.tolist())))
        # a pool's knot is the mean score of its rows: each level stands where brute force has it
        pools = [[i for i in range(size) if abs(want[i] - v) < 1e-9] for v in level]
        assert sorted(i for p in pools for i in p) == list(range(size)) and (np.diff(level) > 0).all()
        assert np.allclose(at, [np.average(x[p], weights=n[p]) for p in pools])


def test_ridge_scores_equal_a_direct_solution(spark):
    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    x = F.array(*(F.coalesce(c, F.lit(0.0)) for c in quality_classifier.statistics()))
    rows = with_stats(d.select("doc_id", F.col("text").alias("_text")), "_text").select("doc_id", x.alias("x")).toPandas()
    got = quality_classifier.score_documents(d, labels).toPandas().set_index("doc_id").loc[rows.doc_id]
    quality = labels.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y")).toPandas().set_index("doc_id").y
    xs, y = np.stack(rows.x), quality.reindex(rows.doc_id).to_numpy()
    train = ~got.held_out.to_numpy() & ~np.isnan(y)
    scale = xs[train].std(0)
    z = quality_classifier.Cosines(xs[train].mean(0), np.where(scale > 1e-9, scale, 1.0))(xs)
    # least squares on rows of the penalty below the data: no normal equations
    k = z.shape[1]
    penalty = np.full(k, math.sqrt(quality_classifier.RIDGE * train.sum()))
    penalty[-1] = math.sqrt(1e-9)
    w, *_ = np.linalg.lstsq(np.vstack((z[train], np.diag(penalty))), np.concatenate((y[train], np.zeros(k))), rcond=None)
    assert np.abs(z @ w - got.raw.to_numpy()).max() < 1e-5
    # calibration never turns two documents round
    order = np.argsort(got.raw.to_numpy(), kind="stable")
    assert (np.diff(got.score.to_numpy()[order]) > -1e-12).all()


# ---------------------------------------------------------------- disclosing terms
def brute_terms(rows, generalise=0.75, remove=0.9, support=2, near=1):
    def parsed(line):
        spans = [s.rsplit(":", 2) for s in brute_spans(line).split(",") if s]
        spans = [(kind, int(a), int(b)) for kind, a, b in spans]
        digits = lambda v: re.sub("[^0-9]", "", v)
        key = {"email": str.lower, "ip": str, "card": digits, "phone": digits}
        entities = {f"{kind}:{key[kind](line[a:b])}" for kind, a, b in spans}
        free = [m[0] for m in WORD.finditer(line) if not any(a < m.end() and m.start() < b for _, a, b in spans)]
        return entities, {regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", w.lower()) for w in free} - {""}

    units, seen = {}, {}
    for rid, (_, text) in enumerate(rows):
        lines = [x for x in text.split("\n") if WORD.search(x)]
        for i, line in enumerate(lines):
            around = tuple(lines[max(0, i - near):i + near + 1])
            unit = around, min(i, near)
            if unit in units:
                continue
            for x in around:
                seen.setdefault(x, parsed(x))
            units[unit] = rid, set().union(*(seen[x][0] for x in around)), seen[line][0], set().union(*(seen[x][1] for x in around))
    n, n_term = len(units), Counter(t for _, _, _, terms in units.values() for t in terms)
    count, centre, rids = Counter(), Counter(), defaultdict(set)
    for rid, entities, own, terms in units.values():
        for key in [(e,) for e in entities] + [(e, t) for e in entities for t in terms]:
            count[key] += 1
            centre[key] += key[0] in own
            rids[key].add(rid)
    enough = {k for k in count if max(centre[k], len(rids[k])) >= support}
    out = set()
    for key in enough:
        if len(key) == 2 and key[:1] in enough:
            e, both = count[key[:1]], count[key]
            ic = math.log2(n / e)
            share = math.log2(both * n / (e * max(n_term[key[1]], both))) / ic if ic > 0 else 0.0
            if share >= generalise:
                out.add((*key, "removed" if share >= remove else "generalised"))
    return out


def test_disclosing_terms_match_brute_force(spark, docs):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").coalesce(1)
    for df in (d, docs.select("doc_id", "text").coalesce(1)):
        got = {(r.entity, r.term, r.kind) for r in pii.disclosing_terms(df).collect()}
        assert got == brute_terms(rows_of(df))


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosing_terms_of_random_texts_match_brute_force(spark, seed):
    rng = random.Random(seed)
    people = [(f"p{k}@x.org", f"Name{k}") for k in range(12)]

    def line():
        words = [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 5))]
        if rng.random() < 0.4:
            words += list(rng.choice(people))
        if rng.random() < 0.2:
            words.append(people[rng.randrange(6)][1])
        return " ".join(words + ["10.0.0.%d" % rng.randrange(3)] * (rng.random() < 0.1))

    rows = [(i, "\n".join(line() for _ in range(rng.randrange(0, 5)))) for i in range(250)]
    df = spark.createDataFrame(rows + rows[:30], "doc_id long, text string").coalesce(1)
    got = {(r.entity, r.term, r.kind) for r in pii.disclosing_terms(df, generalise=0.5, remove=0.8).collect()}
    want = brute_terms(rows_of(df), 0.5, 0.8)
    assert got == want and len({k for *_, k in want}) == 2
