"""SimHash near-duplicates found with vantage-point trees.

A fingerprint has 64 bits. If two fingerprints differ in at most k bits, then
of P parts of the word one differs in at most k // P bits. For each part there
is a vantage-point tree over the distance "differing bits in this part", a
pseudo-metric: a node keeps points within its radius on the inside and the
rest outside, and a query with radius r must go to both sides only if its own
distance to the vantage point is within r of the node's radius (triangle
inequality). Small radii on parts prune well, where k bits on whole words,
whose distances crowd around 32, do not. The exact distance of the whole word
decides in the end.

The top of each tree comes from a bounded, hash-chosen sample of the distinct
fingerprints (SAMPLE; it shapes the shards, not the result). Every distinct
fingerprint lives in one shard per tree and visits the shards its ball
reaches. Within a shard the tree goes on in numpy, and each shard returns a
spanning forest of the links it finds, never all pairs. Components then come
from star contraction over these links in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidspark.llm.common import stage, text_of

SHINGLE, MAX_BITS, PARTS, HASH_SEED = 3, 3, 2, 42
#: Sampled fingerprints for the tops of the trees, and points a shard holds at least and at most.
SAMPLE, SHARD_LEAST, SHARD_MOST = 8192, 8192, 1 << 20
_LEAF, _BLOCK, _WORDS = 128, 1024, 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of lower-cased (A-Z) word shingles, repeats included; 0 for a text without words.

    A bit is set if it is set in over half the XXH64 (seed 42) shingle hashes.
    A text shorter than a shingle is hashed whole.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    ends = ends[min(shingle, len(words)) - 1:]
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, _WORDS):
        part = [h(joined[a:b], HASH_SEED) for a, b in zip(starts[lo:min(n, lo + _WORDS)].tolist(), ends[lo:lo + _WORDS].tolist())]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without ``_text`` plus fp (the fingerprint's bits as a signed long)."""
    schema = docs.drop("_text").schema.add("fp", "long")
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fps)], names=[*names, "fp"])

    return docs.mapInArrow(run, schema)


def _mask(part: int, parts: int) -> int:
    lo, hi = 64 * part // parts, 64 * (part + 1) // parts
    return ((1 << hi) - 1) ^ ((1 << lo) - 1)


def _distance(points: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ np.uint64(vantage)) & np.uint64(mask))


def _vantage(points: np.ndarray, mask: int) -> tuple[int, int] | None:
    """(vantage point, radius) that halves ``points`` best with few points on the boundary; None if nothing splits them."""
    best = None
    some = points[:: max(1, len(points) // 512)]
    for v in points[:: max(1, len(points) // 8)][:8].tolist():
        counts = np.bincount(_distance(some, v, mask), minlength=66)
        inside = np.cumsum(counts)[:-1]
        shorter = np.minimum(inside, len(some) - inside)
        for r in np.argsort(-shorter)[:3].tolist():
            score = shorter[r] - (counts[r] + counts[r + 1]) / 2
            if shorter[r] and (best is None or score > best[0]):
                best = (score, v, r)
    return best and best[1:]


def plant(sample: np.ndarray, mask: int, leaves: int) -> tuple | int:
    """Top of a tree: (vantage, radius, inside, outside) down to shard numbers."""
    number = iter(range(1 << 30))

    def grow(points: np.ndarray, want: int) -> tuple | int:
        at = _vantage(points, mask) if want > 1 and len(points) > 1 else None
        if at is None:
            return next(number)
        near = _distance(points, at[0], mask) <= at[1]
        return (*at, grow(points[near], want // 2), grow(points[~near], want - want // 2))

    return grow(sample, leaves)


def visit(tree: tuple | int, points: np.ndarray, mask: int, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indices that reach it, whether each lives there)."""
    todo = [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at, home
            continue
        v, r, inside, outside = node
        d = _distance(points[at], v, mask).astype(np.int64)
        a, b = d - radius <= r, d + radius > r
        todo += [(inside, at[a], (home & (d <= r))[a]), (outside, at[b], (home & (d > r))[b])]


def _settle(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable over the edges, for each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def local_links(points: np.ndarray, home: np.ndarray, mask: int, radius: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (as indices) of the links between points at home and any points.

    The tree goes on down to _LEAF points; what cannot be split is compared in
    blocks of bounded size, each of which gives at most one link per point.
    """
    us, vs = [], []

    def compare(q: np.ndarray, h: np.ndarray) -> None:
        for i in range(0, len(q), _BLOCK):
            for j in range(0, len(h), _BLOCK):
                a, b = q[i:i + _BLOCK], h[j:j + _BLOCK]
                hit = np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= max_bits
                x, y = np.nonzero(hit)
                keep = a[x] != b[y]
                if keep.any():
                    own, back = np.unique(np.concatenate((a[x[keep]], b[y[keep]])), return_inverse=True)
                    half = len(back) // 2
                    label = own[_settle(back[:half], back[half:], len(own))]
                    new = label != own
                    us.append(own[new])
                    vs.append(label[new])

    todo = [(np.arange(len(points)), np.flatnonzero(home), 0)]
    while todo:
        q, h, depth = todo.pop()
        if not len(h) or len(q) < 2:
            continue
        at = _vantage(points[h], mask) if len(h) > _LEAF and depth < 40 else None
        if at is None:
            compare(q, h)
            continue
        dq, dh = (_distance(points[x], at[0], mask).astype(np.int64) for x in (q, h))
        r = at[1]
        todo += [(q[dq - radius <= r], h[dh <= r], depth + 1), (q[dq + radius > r], h[dh > r], depth + 1)]
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    u, v = np.concatenate(us), np.concatenate(vs)
    label = _settle(u, v, len(points))
    own = np.flatnonzero(label != np.arange(len(points)))
    return own, label[own]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, parts: int = PARTS, sample: int = SAMPLE,
          shard_least: int = SHARD_LEAST, shard_most: int = SHARD_MOST) -> DataFrame:
    """(u, v) with u > v: links that connect what differs in at most ``max_bits`` bits. ``distinct``: one row per fp."""
    n = distinct.count()
    share = min(1.0, sample / max(n, 1))
    picked = distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < round(share * (1 << 30))).select("fp").collect()
    points = np.sort(np.array([r["fp"] for r in picked], np.int64)).view(np.uint64)
    points = np.random.default_rng(HASH_SEED).permutation(points)
    leaves = max(1, -(-n // min(shard_most, max(shard_least, n // 64))))
    radius, trees = max_bits // parts, [(m, plant(points, m, leaves)) for m in (_mask(p, parts) for p in range(parts))]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for t, (mask, tree) in enumerate(trees):
                for shard, at, home in visit(tree, fps.view(np.uint64), mask, radius):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t << 32 | shard, np.int64)), pa.array(fps[at]), pa.array(home)],
                                                     names=["shard", "fp", "home"])

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by("fp")
        fps = group.column("fp").to_numpy()
        mask = trees[group.column("shard")[0].as_py() >> 32][0]
        u, v = local_links(fps.view(np.uint64), group.column("home").to_numpy(), mask, radius, max_bits)
        return pa.table({"u": fps[u], "v": fps[v]})

    shards = distinct.select("fp").mapInArrow(route, "shard long, fp long, home boolean")
    return shards.groupBy("shard").applyInArrow(search, "u long, v long").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each linked node reaches; by large-star and small-star rounds until nothing changes."""
    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    e = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = mark(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        e = stage(small, "edges")
        new = mark(e)
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, parts: int = PARTS, **tree) -> DataFrame:
    """One row per input row: _rid, doc_id, fp, root, component_id.

    component_id is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits, the row's own included (null if all are
    null). It does not tell components apart when doc_ids are null or repeated;
    root, a fingerprint of the component, does. Null and empty texts have
    fingerprint 0 and are linked like any other; a text of any length has one
    fingerprint of all its shingles. Repeated rows have equal fingerprints. An empty table gives an
    empty table. Columns other than doc_id and text are not looked at.
    """
    rows = stage(fingerprints(docs.select(F.monotonically_increasing_id().alias("_rid"), "doc_id", text_of().alias("_text")), shingle), "fps")
    groups = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "groups")
    roots = components(links(groups, max_bits, parts, **tree))
    joined = groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("_rid", "doc_id", "fp", "root", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: smallest doc_id (nulls last), then first in input order; same columns.

    The input is read twice and must give the same rows in the same order
    (files, or a staged table).
    """
    named = stage(classes(docs, shingle, max_bits), "classes")
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_rid"))["_rid"].alias("_rid"))
    packed = docs.select(F.monotonically_increasing_id().alias("_rid"), F.struct("*").alias("_row"))
    return packed.join(first.select("_rid"), "_rid", "left_semi").select("_row.*")
