"""Substring dedup: words covered by windows that also stand elsewhere, found by recompression.

``recompression`` gives equal windows of words equal anchors (a high symbol in
their interior) and equal signatures (all symbols that the rounds pop). So:

1. Texts are packed into chunks, which are staged once.
2. Each chunk sends the names of its anchors, each at most twice, to buckets by
   a part of the name. A bucket returns one bit per name: stands it twice?
3. Only windows with a shared anchor can be repeated. Their signatures go the
   same way, 96 bits and the bucket's; a bucket again returns one bit for each.
4. Each chunk removes what its repeated windows cover.

Names go as packed arrays, one row per bucket and chunk, so a passage that
stands in a third of all texts sends one name per chunk, and buckets, dealt by
names, stay equally large; their number grows with the corpus. Chunk and
answers meet in a join by the chunk's number. Signatures are compared by 96
bits and the bucket number, not by the words themselves.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidspark.llm.common import stage, total
from fidspark.llm.recompression import Parse, split_words, word_names

WIDTH = 35
CHUNK_BYTES, BUCKET_WORDS, SLICE_WORDS = 1 << 19, 1 << 20, 60_000
_SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("side", pa.bool_()), ("data", pa.binary())])
_BACK = "chunk long, bucket long, side boolean, data binary"


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue()


def _unpacked(data: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(data)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in input order, as many as have CHUNK_BYTES of text together, as one row."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK_BYTES, "right")))
            part = batch.slice(lo, hi - lo)
            words = int(split_words(part.column("text"))[1][-1])
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()), "words": pa.array([words], pa.int64()),
                                              "data": pa.array([_packed(part)], pa.binary())})
            number, lo = number + 1, hi


class _Chunk:
    """A chunk's words and the parses of its slices, which overlap by a window less one word."""

    def __init__(self, data: bytes, width: int, parsed: bool = True):
        self.rows = _unpacked(data)
        self.words, self.starts = split_words(self.rows.column("text"))
        self.slices = []
        if parsed:
            names = word_names(self.words)
            for lo in range(0, max(0, len(names) - width + 1), SLICE_WORDS):
                hi = lo + SLICE_WORDS + width - 1
                inside = self.starts[(self.starts > lo) & (self.starts < hi)] - lo
                self.slices.append((lo, Parse(names[lo:hi], np.append(0, inside), width)))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of all anchors, sorted; how often each stands here; per window (slice by slice) the index of its own."""
        names, each, n = [], [], 0
        for _, p in self.slices:
            new = np.ones(len(p.at), bool)
            new[1:] = (p.anchor[1:] != p.anchor[:-1]) | (p.place[1:] != p.place[:-1])
            names.append(p.anchor[new])
            each.append(n + np.cumsum(new) - 1)
            n += len(names[-1])
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, which, count = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        return found, count, which[np.concatenate(each)]


def _rows_by_bucket(chunk: int, bucket: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket that has entries; ``bucket`` is sorted, ``data`` has a row of bytes for each entry."""
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    offsets = np.append(cuts, len(bucket)).astype(np.int32) * np.int32(data.shape[1])
    values = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int64)), pa.array(np.full(len(cuts), chunk)),
                                       pa.array(np.zeros(len(cuts), bool)), values], schema=_SENT)


def _sent_anchors(found: np.ndarray, count: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of sending, bucket of each entry sent); a name that stands here twice or more is sent twice."""
    bucket = (found >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    order = np.repeat(order, np.minimum(count[order], 2))
    return order, bucket[order]


def _answers(batch: pa.RecordBatch, row: int) -> list[dict]:
    return sorted((x for x in batch.column("marks")[row].as_py() or []), key=lambda x: x["bucket"])


def _bits(answers: list[dict], sizes: np.ndarray) -> np.ndarray:
    """The answers for all entries sent, ``sizes`` of them by bucket."""
    parts = [np.unpackbits(np.frombuffer(x["data"], np.uint8), count=int(k)) for x, k in zip(answers, sizes)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _per_bucket(bucket: np.ndarray) -> np.ndarray:
    return np.diff(np.flatnonzero(np.append(np.append(True, bucket[1:] != bucket[:-1]), True))) if len(bucket) else np.zeros(0, np.int64)


def _twice(table: pa.Table, width: int) -> pa.Table:
    """One bucket: for each chunk, a bit for each entry of ``width`` bytes, set if an equal entry stands elsewhere."""
    side = np.asarray(table.column("side").combine_chunks().cast(pa.uint8()), dtype=bool)
    asked = table.filter(pa.array(~side))
    sizes = np.asarray(pc.binary_length(asked.column("data")).combine_chunks(), dtype=np.int64) // width
    every = np.frombuffer(b"".join(asked.column("data").to_pylist()), np.uint32).reshape(-1, width // 4)
    order = np.lexsort(every.T)
    ranked = every[order]
    same = (ranked[1:] == ranked[:-1]).all(axis=1) if len(ranked) else np.zeros(0, bool)
    shared = np.zeros(len(every), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    ends = np.cumsum(sizes)
    bits = [np.packbits(shared[e - k:e]).tobytes() for e, k in zip(ends, sizes)]
    chunks = asked.column("chunk").combine_chunks()
    rest = table.filter(pa.array(side))
    return pa.table({
        "chunk": pa.concat_arrays([chunks, rest.column("chunk").combine_chunks()]),
        "bucket": pa.concat_arrays([asked.column("bucket").combine_chunks(), rest.column("bucket").combine_chunks()]),
        "side": pa.array(np.append(np.zeros(len(asked), bool), np.ones(len(rest), bool))),
        "data": pa.concat_arrays([pa.array(bits, pa.binary()), rest.column("data").combine_chunks().cast(pa.binary())])})


def _asked(sent: DataFrame, width: int, tag: str) -> DataFrame:
    """The answers of the buckets, staged, gathered per chunk."""
    back = sent.groupBy("bucket").applyInArrow(lambda t: _twice(t, width), _BACK)
    return stage(back, tag).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "side", "data")).alias("marks"))


def repeated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (the words that stay, joined by single spaces).

    Removed is each word covered by a window of ``width`` words of one text
    whose words also start anywhere else, in the same text or another, as the
    input stands. A text of fewer words loses nothing; a null text has none and
    is kept as an empty one. Rows count one by one: repeated rows, ids that are
    null or stand twice, make windows repeated like any other row. Other
    columns are not looked at. Texts of any length are parsed in slices of
    SLICE_WORDS words, which overlap. An empty table gives an empty table.
    """
    if width < 1:
        raise ValueError("a window has at least one word")
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = stage(docs.select("doc_id", F.col("text").cast("string").alias("text"))
                   .mapInArrow(_chunks, "chunk long, words long, data binary"), "chunks")
    buckets = max(16, -(-total(chunks, F.sum("words")) // BUCKET_WORDS))

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
                found, count, _ = _Chunk(data.as_py(), width).anchors()
                order, bucket = _sent_anchors(found, count, buckets)
                yield _rows_by_bucket(number, bucket, found[order].astype(np.uint32).view(np.uint8).reshape(-1, 4))

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (number, data) in enumerate(zip(batch.column("chunk").to_pylist(), batch.column("data"))):
                chunk = _Chunk(data.as_py(), width)
                found, count, which = chunk.anchors()
                order, bucket = _sent_anchors(found, count, buckets)
                shared = np.zeros(len(found), bool)
                shared[order] = _bits(_answers(batch, row), _per_bucket(bucket))
                yield from _sent_windows(number, chunk, shared[which] if len(which) else np.zeros(0, bool), buckets)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in enumerate(batch.column("data")):
                yield _without(_Chunk(data.as_py(), width, parsed=False), _answers(batch, row), width)

    sent = "bucket long, chunk long, side boolean, data binary"
    marks = _asked(chunks.mapInArrow(send_anchors, sent), 4, "anchors")
    marks = _asked(chunks.join(marks, "chunk", "left").mapInArrow(send_windows, sent), 12, "windows")
    return chunks.join(marks, "chunk", "left").mapInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept string")


def _sent_windows(number: int, chunk: _Chunk, candidate: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Each signature of the chunk's candidates once, and, as a side row, what tells which window an answer is for.

    The side row has the windows repeated within the chunk, which need no
    answer, and the other candidates, with their buckets, in order.
    """
    at, sig, sig2, done = [], [], [], 0
    for lo, p in chunk.slices:
        which = np.flatnonzero(candidate[done:done + len(p.at)])
        done += len(p.at)
        a, b = p.signatures(which)
        at.append(p.at[which].astype(np.int64) + lo)
        sig.append(a)
        sig2.append(b)
    if not at:
        return
    at, sig, sig2 = np.concatenate(at), np.concatenate(sig), np.concatenate(sig2)
    by_name = np.lexsort((sig2, sig))
    a, b = sig[by_name], sig2[by_name]
    same = np.append(False, (a[1:] == a[:-1]) & (b[1:] == b[:-1])) if len(a) else np.zeros(0, bool)
    twice = same | np.append(same[1:], False) if len(a) else same
    here = np.zeros(len(at), bool)
    here[by_name[twice]] = True
    once, more = np.flatnonzero(~here), by_name[twice & ~same]
    bucket = ((sig2 >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    entry = np.append(once, more)
    entry = entry[np.argsort(bucket[entry], kind="stable")]
    data = np.zeros((len(entry), 12), np.uint8)
    data[:, :8] = sig[entry].view(np.uint8).reshape(-1, 8)
    data[:, 8:] = sig2[entry].astype(np.uint32).view(np.uint8).reshape(-1, 4)
    yield _rows_by_bucket(number, bucket[entry], data)
    n = len(chunk.words)
    flags = np.zeros((2, n), bool)
    flags[0, at[once]] = True
    flags[1, at[here]] = True
    side = pa.RecordBatch.from_pydict({"n": pa.array([len(once)], pa.int64()), "once": [np.packbits(flags[0]).tobytes()], "here": [np.packbits(flags[1]).tobytes()],
                                       "bucket": [bucket[once].astype(np.min_scalar_type(buckets)).tobytes()]})
    yield pa.RecordBatch.from_arrays([pa.array([number % buckets], pa.int64()), pa.array([number], pa.int64()), pa.array([True]),
                                      pa.array([_packed(side)], pa.binary())], schema=_SENT)


def _without(chunk: _Chunk, answers: list[dict], width: int) -> pa.RecordBatch:
    """The chunk's rows without the words that its repeated windows cover."""
    n, starts = len(chunk.words), chunk.starts
    edge = np.zeros(n + 1, np.int64)
    for x in answers:
        if not x["side"]:
            continue
        side = _unpacked(x["data"]).to_pylist()[0]
        flags = [np.flatnonzero(np.unpackbits(np.frombuffer(side[k], np.uint8), count=n)) for k in ("once", "here")]
        bucket = np.frombuffer(side["bucket"], f"u{len(side['bucket']) // max(1, side['n'])}" if side["n"] else "u1").astype(np.int64)
        # the answers of a bucket begin with those for its windows, in order
        size = dict(zip(*np.unique(bucket, return_counts=True)))
        asked = [y for y in answers if not y["side"] and y["bucket"] in size]
        told = _bits(asked, np.array([size[y["bucket"]] for y in asked], np.int64))
        begin = np.append(flags[0][np.argsort(bucket, kind="stable")][told], flags[1])
        edge[begin] += 1
        np.add.at(edge, begin + width, -1)
    gone = np.cumsum(edge[:n]) > 0
    left = np.concatenate(([0], np.cumsum(~gone)))[starts]
    words = chunk.words.filter(pa.array(~gone)).cast(pa.string())
    kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words), " ")
    n_words = np.diff(starts)
    return pa.RecordBatch.from_arrays([chunk.rows.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array((n_words - np.diff(left)).astype(np.int64)), kept],
                                      names=["doc_id", "n_words", "n_removed", "kept"])
