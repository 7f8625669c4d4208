"""Substring dedup, ranked search and the Merkle manifest against brute force, with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import SCHEMA, docs, no_docs  # noqa: F401
from pyspark.sql import functions as F

from fidspark.llm import merkle, ranked_search, substring_dedup
from fidspark.llm.recompression import Parse, split_words, word_names

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def key(row):
    return tuple((x is None, x) for x in row)


# --- substring dedup

def plain_repeats(rows, width):
    words = [WORDS.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[p:p + width]) for w in words for p in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - width + 1):
            if count[tuple(w[p:p + width])] > 1:
                gone.update(range(p, p + width))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=key)


def repeats(df, width):
    return sorted((tuple(r) for r in substring_dedup.repeated(df, width).collect()), key=key)


@pytest.mark.parametrize("width", [1, 2, 7, 35])
def test_signatures_and_anchors_follow_the_words_alone(width):
    rnd = random.Random(width)
    for size in (1, 2, 3, 60):
        texts = [" ".join(f"w{rnd.randrange(size)}" for _ in range(rnd.choice([0, 1, 35, 200]))) for _ in range(6)]
        texts += ["q " * 90, "x y " * 60, "a b a c " * 40, texts[0] + " " + texts[1], None, ""]
        words, starts = split_words(pa.array(texts, pa.string()))
        p = Parse(word_names(words), starts[:-1], width)
        a, b = p.signatures(np.arange(len(p.at)))
        flat, of_words, of_names = words.to_pylist(), {}, {}
        for i, at in enumerate(p.at):
            window, names = tuple(flat[at:at + width]), (a[i], b[i])
            assert of_words.setdefault(window, (*names, p.anchor[i])) == (*names, p.anchor[i])
            assert of_names.setdefault(names, window) == window
        assert len(p.at) == sum(max(0, n - width + 1) for n in np.diff(starts))


def test_word_names_tell_words_apart():
    words = pa.array(["", "a", "aa", "a\0", "abcdefgh", "abcdefghi", "abcdefg", "é", "x" * 100, "x" * 101], pa.large_string())
    assert len(set(word_names(words).tolist())) == 10
    assert (word_names(words.slice(3, 4)) == word_names(words)[3:7]).all()


@pytest.mark.parametrize("width", [5, 35])
def test_repeats_match_brute_force(spark, docs, width):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert repeats(docs, width) == plain_repeats(rows, width)


def test_repeats_of_random_texts(spark, monkeypatch):
    rnd = random.Random(3)
    passage = " ".join(f"p{rnd.randrange(30)}" for _ in range(50))
    rows = []
    for i in range(150):
        own = " ".join(f"v{rnd.randrange(400)}" for _ in range(rnd.randrange(120)))
        cut = " ".join(passage.split()[rnd.randrange(20):rnd.randrange(25, 51)])
        rows.append((i // 2, own + "\n" + cut + " " + own[:rnd.randrange(60)] if i % 3 else own))
    rows += [(500, "to " * 300), (501, "to " * 36), (502, "be or " * 100), (503, passage.split()[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert repeats(df, 10) == plain_repeats(rows, 10)
    assert repeats(df, 35) == plain_repeats(rows, 35)


def test_a_long_text_repeats_within_itself_over_slices(spark):
    rnd = random.Random(5)
    half = [f"k{rnd.randrange(10**6)}" for _ in range(substring_dedup.SLICE_WORDS)]
    text = " ".join(half + ["between"] + half[100:160] + ["end"])
    (row,) = substring_dedup.repeated(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_words, row.n_removed) == (len(half) + 62, 120)


def test_repeats_of_no_rows(no_docs):  # noqa: F811
    assert substring_dedup.repeated(no_docs).collect() == []


# --- ranked search

def plain_search(docs_, items, top=20):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = [(d, rx.findall((t or "").translate(lower))) for d, t in docs_]
    terms = [(d, t) for d, t in terms if t]
    n, length = len(terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    counts = [(d, len(t), Counter(t)) for d, t in terms]
    out = []
    for item, text in items:
        found = []
        for d, size, tf in counts:
            m = 75 + 25 * size * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m))
                        for w in rx.findall((text or "").translate(lower)) if tf[w])
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(found[:top])]
    return sorted(out, key=key)


def ranks(d, i, **options):
    return sorted((tuple(r) for r in ranked_search.search(d, i, **options).collect()), key=key)


def test_search_matches_brute_force(spark, docs):  # noqa: F811
    items = [(0, "the quick brown fox, the river bank"), (1, None), (2, ""), (3, "nothing-of-this zzz"), (3, "HÉLLO Wörld spam spam spam"), (4, "b c d e f g today 4111"), (None, "fox")]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string")
    want = plain_search(rows, items)
    assert ranks(docs, asked) == want
    assert ranks(docs, asked, part_docs=3, block_chars=30) == want


def test_search_of_random_texts_with_ties(spark):
    rnd = random.Random(11)
    word = lambda: f"t{int(rnd.paretovariate(0.6)) % 300}"
    rows = [(i % 400, " ".join(word() for _ in range(rnd.choice([0, 3, 30, 200])))) for i in range(500)]
    rows += rows[:60] + [(None, rows[3][1])] * 2
    items = [(q, " ".join(word() for _ in range(rnd.choice([1, 2, 9, 40])))) for q in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranks(df, asked, part_docs=64) == plain_search(rows, items)
    assert ranks(df, asked, top=3, part_docs=64) == plain_search(rows, items, 3)


def test_pair_bounds_skip_what_single_bounds_do_not():
    """Two terms that never meet: their pair's bound is the greater one, not the sum."""
    plan = ranked_search.Plan(["aa bb"])
    texts = [(i, "aa") for i in range(8)] + [(i + 8, "bb") for i in range(8)]
    row = ranked_search._postings(iter(texts), plan.terms)
    plan.weigh(16, {0: 8, 1: 8})
    tf = np.asarray(row["tf"], np.int64)
    impact = np.repeat(plan.weights[row["terms"]], 8) * tf
    batch = ranked_search._row({"ids": row["ids"], "no_id": row["no_id"], "terms": row["terms"], "ends": row["ends"], "docs": row["docs"], "impact": impact,
                                "pair_best": [0], "pair_ends": [0], "pair_docs": []}, ranked_search._SCORED)
    part = ranked_search._Part(batch, 0, 2)
    (unit,) = plan.units[0]
    assert part.bound(unit) == impact.max() < sum(part.most)
    assert len(part.search([unit], int(impact.max()) + 1)[0]) == 0
    assert len(part.search([unit], int(impact.max()))[0]) == 16


def test_search_of_no_rows(spark, docs, no_docs):  # noqa: F811
    items = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert ranked_search.search(no_docs, items).collect() == []
    assert ranked_search.search(docs, items.limit(0)).collect() == []


# --- Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fan_out=8):
    """The root, and for each leaf its path of (left, right)."""
    paths, level, members = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        up, held = [], []
        for lo in range(0, len(level), fan_out):
            run = level[lo:lo + fan_out]
            for k in range(len(run)):
                for i in members[lo + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(sha(*run))
            held.append([i for m in members[lo:lo + fan_out] for i in m])
        level, members = up, held
    return level[0], paths


def plain_manifest(rows, fan_out=8):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for r in rows:
        leaf = lambda t, r=r: sha(*(enc(v) for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], t)))
        bad = None
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
            bad = leaf(r["text"] and re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r["text"]), bad, r["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = plain_tree([x[2] for x in groups[g]], fan_out)
    root, above = plain_tree([trees[g][0] for g in names], fan_out)
    out = []
    for g, up in zip(names, above):
        for (_, _, leaf, bad, doc_id), path in zip(groups[g], trees[g][1]):
            path = path + up
            fold = bad or leaf
            for left, right in path:
                fold = sha(left, fold, right)
            out.append((doc_id, leaf, trees[g][0], root, sha(*(x for s in path for x in s)), fold, fold == root))
    return sorted(out, key=key)


def manifest_rows(df):
    m = merkle.document_manifest(df)
    fold = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    m = m.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")), fold.alias("f"), (fold == F.col("root")))
    return sorted((tuple(r) for r in m.collect()), key=key)


def test_manifest_matches_brute_force(spark, docs):  # noqa: F811
    assert manifest_rows(docs) == plain_manifest([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("sizes", [[1], [8], [9], [73, 1, 64], [600, 5]])
def test_manifest_of_group_sizes(spark, sizes):
    rows = [(i * 7 + g, f"Text {i % 50}", f"l{g}", None, 5) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    got = manifest_rows(df)
    assert got == plain_manifest([r.asDict() for r in df.collect()])
    assert any(r[-1] for r in got) and (sum(sizes) < 8 or not all(r[-1] for r in got))


def test_manifest_of_many_groups(spark):
    rows = [(i, "T", None if g == 0 else f"é{g}", "s", 1) for g in range(20) for i in range(g % 3 + 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest_rows(df) == plain_manifest([r.asDict() for r in df.collect()])


def test_manifest_of_no_rows(no_docs):  # noqa: F811
    assert merkle.document_manifest(no_docs).collect() == []
