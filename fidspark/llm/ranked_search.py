"""Ranked lexical search: exact top results by MaxScore with bounds on pairs of terms.

Queries are taken in blocks of bounded size. For a block, one pass over all
documents counts its terms and leaves an index: posting lists of the block's
terms for every ITEMS_A_PART documents, stored as arrays. When document
frequencies are known, a second pass turns counts into impacts and precomputes,
for the pairs of terms that the queries use, the list of documents that hold
both and their greatest joint impact.

A query's terms are paired, rarest first. What a pair can add to a document is
at most the greater of its joint maximum and its single maxima, less than their
sum where documents that hold one term seldom hold the other. MaxScore runs on
these bounds: the pairs whose bounds together stay below the threshold cannot
bring in a document, only the lists of the others are opened, and a document
is dropped as soon as its score so far and the bounds left stay below. The
threshold starts from the exact scores of documents in the pair lists, the best
of all parts, and rises in each task. Bounds decide what is skipped, never
what is found. Scores are whole numbers throughout.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidspark.llm.common import stage, text_of, total

TOP = 20
#: Documents per part of the index, and characters of queries per block.
PART_DOCS, BLOCK_CHARS = 1024, 1 << 20
#: Pair lists longer than this share of a part keep their joint maximum alone.
LIST_SHARE = 1 / 8
# Fixed values of the score.
SCALE, B, K = 1_000_000_000, 25, 12

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_INDEX = "n_docs long, n_terms long, ids array<long>, no_id array<boolean>, sizes array<int>, terms array<int>, ends array<int>, docs array<int>, tf array<int>"
_SCORED = "ids array<long>, no_id array<boolean>, terms array<int>, ends array<int>, docs array<int>, impact array<long>, pair_best array<long>, pair_ends array<int>, pair_docs array<int>"
_HITS = "q int, no_id boolean, doc_id long, score long"


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other than ASCII characters, A to Z lower-cased, in UTF-8."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Plan:
    """A block of queries: its terms, numbered, each query's units of one or two terms with their repeats, and all pairs, numbered."""

    def __init__(self, texts: list[str]):
        self.counts = [Counter(terms_of(t)) for t in texts]
        self.terms = {t: i for i, t in enumerate(sorted(set().union(*self.counts)))}
        self.units: list[list[tuple]] = []
        self.pairs: list[tuple[int, int, int, int]] = []
        self.weights = np.zeros(len(self.terms), np.int64)

    def weigh(self, n_docs: int, df: dict[int, int]) -> None:
        """Weights of the terms, then units: terms by falling weight, two and two; terms of weight 0 add nothing."""
        for i in self.terms.values():
            if df.get(i):
                self.weights[i] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[i] + 1)))
        known: dict[tuple, int] = {}
        for counts in self.counts:
            found = sorted(((int(-self.weights[self.terms[t]]), self.terms[t], k) for t, k in counts.items()))
            flat = [(i, k) for w, i, k in found if w]
            units: list[tuple] = []
            for (a, ka), (b, kb) in zip(flat[::2], flat[1::2]):
                units.append((known.setdefault((a, ka, b, kb), len(known)), a, ka, b, kb))
            if len(flat) % 2:
                units.append((-1, *flat[-1], -1, 0))
            self.units.append(units)
        self.pairs = list(known)


def _postings(texts: Iterator[tuple], terms: dict[bytes, int]) -> dict | None:
    """Posting lists of some documents (id, text) as one row of the index."""
    n_docs = n_terms = 0
    ids, sizes, term, doc, tf = [], [], [], [], []
    for doc_id, text in texts:
        found = terms_of(text)
        if not found:
            continue
        n_docs, n_terms = n_docs + 1, n_terms + len(found)
        mine = [(terms[t], k) for t, k in Counter(found).items() if t in terms]
        if mine:
            term += [t for t, _ in mine]
            tf += [k for _, k in mine]
            doc += [len(ids)] * len(mine)
            ids.append(doc_id)
            sizes.append(len(found))
    order = np.lexsort((doc, term)).astype(np.int64)
    sorted_terms = np.asarray(term, np.int32)[order]
    here, first = np.unique(sorted_terms, return_index=True)
    return {"n_docs": n_docs, "n_terms": n_terms, "ids": [x or 0 for x in ids], "no_id": [x is None for x in ids], "sizes": sizes, "terms": here,
            "ends": np.append(first[1:], len(order))[:len(here)].astype(np.int32), "docs": np.asarray(doc, np.int32)[order], "tf": np.asarray(tf, np.int32)[order]}


_ARROW = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
          "array<boolean>": pa.list_(pa.bool_())}


def _row(values: dict, schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values[name]], _ARROW[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _array(batch: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


class _Part:
    """A part of the index: documents, lists of the terms and of the pairs."""

    def __init__(self, batch: pa.RecordBatch, row: int, n_terms: int):
        for name in ("ids", "no_id", "terms", "ends", "docs", "impact", "pair_best", "pair_ends", "pair_docs"):
            setattr(self, name, _array(batch, row, name))
        self.slot = np.full(n_terms + 1, -1)
        self.slot[self.terms] = np.arange(len(self.terms))
        self.most = np.maximum.reduceat(self.impact, np.append(0, self.ends[:-1])) if len(self.ends) else self.impact

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        k = self.slot[term]
        lo = self.ends[k - 1] if k else 0
        return self.docs[lo:self.ends[k]], self.impact[lo:self.ends[k]]

    def parts_of(self, unit: tuple) -> list[tuple[int, int]]:
        """The unit's terms that stand here, with their repeats."""
        return [(t, k) for t, k in (unit[1:3], unit[3:5]) if k and self.slot[t] >= 0]

    def bound(self, unit: tuple) -> int:
        """The most the unit adds to a document."""
        single = max((int(self.most[self.slot[t]]) * k for t, k in self.parts_of(unit)), default=0)
        return max(single, int(self.pair_best[unit[0]])) if unit[0] >= 0 else single

    def pair_list(self, pair: int) -> np.ndarray:
        return self.pair_docs[self.pair_ends[pair - 1] if pair else 0:self.pair_ends[pair]]

    def scores(self, units: list[tuple], docs: np.ndarray) -> np.ndarray:
        """What the units add to the documents ``docs``, which are sorted."""
        out = np.zeros(len(docs), np.int64)
        for unit in units:
            for t, k in self.parts_of(unit):
                own, impact = self.list_of(t)
                at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
                out += np.where(own[at] == docs, impact[at] * k, 0)
        return out

    def search(self, units: list[tuple], least: int) -> tuple[np.ndarray, np.ndarray]:
        """All documents scoring at least ``least`` (and above 0), by MaxScore over the units' bounds, and their scores."""
        none = np.zeros(0, np.int64)
        ranked = sorted(((b, u) for u in units if (b := self.bound(u))), key=lambda x: (x[0], x[1][1]))
        below = np.cumsum([b for b, _ in ranked]) if ranked else none
        if not len(below) or below[-1] < least:
            return none, none
        split = int(np.searchsorted(below, least, "left"))  # the units before it stay below the threshold together
        score, seen = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
        for _, unit in ranked[split:]:
            for t, k in self.parts_of(unit):
                own, impact = self.list_of(t)
                score[own] += impact * k
                seen[own] = True
        docs = np.flatnonzero(seen)
        score = score[docs]
        for i in range(split - 1, -1, -1):
            keep = score + below[i] >= least
            docs, score = docs[keep], score[keep]
            if not len(docs):
                return none, none
            score = score + self.scores([ranked[i][1]], docs)
        keep = score >= max(least, 1)
        return docs[keep], score[keep]

    def hits(self, docs: np.ndarray, score: np.ndarray) -> list[tuple]:
        """Documents as they rank: score falling, then ids rising, documents without one last."""
        return [(int(s), -int(self.no_id[d]), -int(self.ids[d])) for d, s in zip(docs, score)]


def _keep(best: list[tuple], found: list[tuple], top: int) -> None:
    for hit in found:
        if len(best) < top:
            heapq.heappush(best, hit)
        elif hit > best[0]:
            heapq.heapreplace(best, hit)


def _hits(best: list[list[tuple]]) -> pa.RecordBatch:
    rows = [(q, bool(n), -d, s) for q, own in enumerate(best) for s, n, d in own]
    q, no_id, doc, score = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(no_id, pa.bool_()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                                      names=["q", "no_id", "doc_id", "score"])


def _index(docs: DataFrame, plan: Plan, part_docs: int) -> DataFrame:
    terms = plan.terms

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                held.append((doc_id, text))
                if len(held) == part_docs:
                    yield _row(_postings(held, terms), _INDEX)
                    held = []
        if held:
            yield _row(_postings(held, terms), _INDEX)

    return stage(docs.mapInArrow(build, _INDEX), "postings")


def _scored(index: DataFrame, plan: Plan, n_docs: int, n_terms: int) -> DataFrame:
    """The index with impacts and the lists and joint maxima of all pairs."""
    weights, pairs = plan.weights, plan.pairs

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = {k: _array(batch, row, k) for k in ("ids", "no_id", "sizes", "terms", "ends", "docs", "tf")}
                length = (100 - B) + B * x["sizes"].astype(np.int64) * n_docs // n_terms
                tf = x["tf"].astype(np.int64)
                count = np.diff(np.append(0, x["ends"]))
                impact = np.repeat(weights[x["terms"]], count) * ((SCALE * tf) // (1000 * tf + K * length[x["docs"]]))
                at = {int(t): (int(e - c), int(e)) for t, e, c in zip(x["terms"], x["ends"], count)}
                best, ends, found = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int32), []
                used = 0
                for i, (a, ka, b, kb) in enumerate(pairs):
                    if a in at and b in at:
                        (a0, a1), (b0, b1) = at[a], at[b]
                        both, ia, ib = np.intersect1d(x["docs"][a0:a1], x["docs"][b0:b1], assume_unique=True, return_indices=True)
                        if len(both):
                            best[i] = (impact[a0:a1][ia] * ka + impact[b0:b1][ib] * kb).max()
                            if len(both) <= max(TOP, LIST_SHARE * len(x["ids"])):
                                found.append(both)
                                used += len(both)
                    ends[i] = used
                yield _row(x | {"impact": impact, "pair_best": best, "pair_ends": ends,
                                "pair_docs": np.concatenate(found) if found else np.zeros(0, np.int32)}, _SCORED)

    return stage(index.filter("size(ids) > 0").mapInArrow(build, _SCORED), "scored")


def _best(hits: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "no_id", "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _block(docs: DataFrame, texts: list[str], top: int, part_docs: int) -> DataFrame:
    """(q, rank, doc_id, score) for a block of queries, numbered from 0."""
    plan = Plan(texts)
    index = _index(docs, plan, part_docs)
    n_docs, n_terms = total(index, F.sum("n_docs")), total(index, F.sum("n_terms"))
    lengths = F.zip_with("terms", F.zip_with("ends", F.concat(F.array(F.lit(0)), "ends"), lambda e, s: e - s), lambda t, n: F.struct(t.alias("t"), n.alias("n")))
    df = index.select(F.explode(lengths).alias("x")).filter("x.t is not null").groupBy("x.t").agg(F.sum("x.n").alias("n"))
    plan.weigh(n_docs, {r["t"]: r["n"] for r in df.collect()})  # one row per term of the block
    scored = _scored(index, plan, n_docs, max(1, n_terms))
    units, size = plan.units, len(plan.terms)

    def from_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in units]
        for batch in batches:
            for row in range(batch.num_rows):
                part = _Part(batch, row, size)
                for q, own in enumerate(units):
                    lists = [part.pair_list(u[0]) for u in own if u[0] >= 0]
                    seen = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int32)
                    if len(seen):
                        _keep(best[q], part.hits(seen, part.scores(own, seen)), top)
        yield _hits(best)

    some = _best(scored.mapInArrow(from_lists, _HITS), top).filter(F.col("rank") == top).select("q", "score").collect()  # a number per query
    start = {r["q"]: r["score"] for r in some}

    def search_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in units]
        for batch in batches:
            for row in range(batch.num_rows):
                part = _Part(batch, row, size)
                for q, own in enumerate(units):
                    least = max(start.get(q, 0), best[q][0][0] if len(best[q]) == top else 0)
                    _keep(best[q], part.hits(*part.search(own, least)), top)
        yield _hits(best)

    ranked = _best(scored.mapInArrow(search_parts, _HITS), top)
    return ranked.select("q", "rank", F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, part_docs: int = PART_DOCS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each item's ``top`` documents by score, as item_id, rank (from 1), doc_id, score.

    All documents (doc_id, text) are ranked for all items (item_id, text);
    those that score 0 are left out. Equal scores go by doc_id, nulls last;
    repeated rows rank one by one. A null or empty text has no terms: such a
    document is not counted, such an item has no rows. Items that share an id
    are ranked one by one. Other columns are not looked at. Items are taken in
    blocks of about ``block_chars`` characters, a block at a time against all
    documents; a part of the index holds ``part_docs`` documents, a longer
    text makes it longer. No documents or no items give no rows.
    """
    spark = docs.sparkSession
    asked = stage(items.select("item_id", text_of().alias("text"), F.monotonically_increasing_id().alias("_i")), "items")
    blocks = max(1, -(-total(asked, F.sum(F.length("text"))) // block_chars))
    kind = asked.schema["item_id"].dataType.simpleString()
    docs = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("_i"), F.lit(blocks)) == b).orderBy("_i").collect()  # block_chars characters or so
        if block:
            names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(block)], f"q int, item_id {kind}")
            out = out.unionByName(names.join(_block(docs, [r["text"] for r in block], top, part_docs), "q").drop("q"))
    return out
