"""Best-fit packing of tokenised documents with large-item matching.

Documents above a third of the capacity can share a sequence with at most one
other such document: they are matched greedily, the largest with the largest
that fits. Smaller documents then best-fit, longest first, into the gaps.

Tokenising runs per Arrow batch in the tasks; ids are the tokenizer's own. A
tokenizer whose chain is known to treat words between white space separately
(WORD_CHAIN) is asked once per word, with a bounded per-process cache; any
other gets whole texts. Pieces are dealt by a hash into
groups of about GROUP_PIECES, each packed in one task from lengths alone; only
the last sequences of a group stay partly empty.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidspark.llm.common import stage, text_of

CAPACITY, END_ID = 2048, 0
GROUP_PIECES, CACHE_WORDS, BATCH = 1 << 16, 500_000, 256
_LOADED: dict[str, _Words] = {}


# A chain that lower-cases, and cuts text into letters, single digits and other signs, none with white space,
# as "normalizer" and "pre_tokenizer" of a tokenizer file have it.
WORD_CHAIN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)

# A word of plain letters between plain punctuation (no apostrophe): the tokenizer cuts it into these three, so its model
# can be asked for each of them without the rest of its chain.
_PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: The printable stand-ins of bytes in byte-level vocabularies: themselves, or the next free code point above 255.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_STAND_INS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}


class _Words:
    """Ids of words by a tokenizer, with caches that keep what the last CACHE_WORDS to 2 * CACHE_WORDS new words needed."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        chain = json.loads(self.tokenizer.to_str())
        self.by_word = ((chain["normalizer"], chain["pre_tokenizer"]) == WORD_CHAIN and chain["post_processor"] is None
                        and all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"])
                                for t in chain["added_tokens"]))
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _core(self, text: str) -> bytes:
        ids = self.cores.get(text)
        if ids is None:
            if len(self.cores) >= CACHE_WORDS:
                self.cores.clear()
            tokens = self.tokenizer.model.tokenize("".join(map(_STAND_INS.__getitem__, text.encode())))
            ids = self.cores[text] = np.array([t.id for t in tokens], "<u4").tobytes()
        return ids

    def learn(self, words: set[bytes]) -> None:
        """Fill the cache for ``words``."""
        if len(self.now) + len(words) > CACHE_WORDS:
            self.before, self.now = self.now, {}
        odd = []
        for w in words:
            if (ids := self.before.get(w)) is None:
                text = w.decode("utf-8", "surrogatepass")
                m = None if "<|" in text else _PLAIN(text)
                if m is None:
                    odd.append(w)
                    continue
                ids = b"".join(self._core(x) for x in (m[1], m[2].lower(), m[3]) if x)
            self.now[w] = ids
        for lo in range(0, len(odd), 4096):
            some = odd[lo:lo + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in some], add_special_tokens=False)):
                self.now[w] = np.array(e.ids, "<u4").tobytes()


def encode(texts: list[str], path: str) -> Iterator[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit integers, without special tokens."""
    if path not in _LOADED:
        _LOADED[path] = _Words(path)
    known = _LOADED[path]
    if not known.by_word:
        for e in known.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()
        return
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").split()
        new = set(words).difference(known.now)
        if new:
            before = known.now
            known.learn(new)
            if known.now is not before:  # a new generation: the text's other words, too
                known.learn(set(words).difference(known.now))
        yield b"".join(map(known.now.__getitem__, words))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: piece_id, doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian unsigned 32-bit).

    A document is its ids and END_ID; only one longer than ``capacity`` is
    cut, into pieces of ``capacity``. A null text is empty: one piece, END_ID.
    """
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"piece_id long, doc_id {doc_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                some = batch.slice(lo, BATCH)
                at, rows = [], []
                for i, ids in enumerate(encode(some.column("_text").to_pylist(), tokenizer)):
                    ids += END_ID.to_bytes(4, "little")
                    for k, b in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[b:b + 4 * capacity]
                        at.append(i)
                        rows.append((number, k, b // 4, len(part) // 4, zlib.crc32(part), part))
                        number += 1
                cols = list(zip(*rows))
                arrays = [pa.array(cols[0], pa.int64()), some.column("doc_id").take(pa.array(at, pa.int64())), pa.array(cols[1], pa.int32()),
                          *(pa.array(c, pa.int64()) for c in cols[2:5]), *([pa.array(cols[5], pa.binary())] if with_ids else [])]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", text_of().alias("_text")).mapInArrow(run, schema)


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each item; items are 1 to ``capacity`` long.

    Bit sets over lengths and gaps find "the largest that fits" and "the
    smallest gap that is enough" at once.
    """
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_length: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        by_length.setdefault(int(lengths[i]), []).append(i)
    n_seq, gaps, open_gaps = 0, {}, 0
    large = [x for x in by_length if 3 * x > capacity]
    mask = sum(1 << x for x in large)
    while mask:
        a = mask.bit_length() - 1
        i = by_length[a].pop()
        mask ^= (not by_length[a]) << a
        seq[i], used = n_seq, a
        fit = mask & ((1 << (capacity - a + 1)) - 1)
        if fit:
            b = fit.bit_length() - 1
            j = by_length[b].pop()
            mask ^= (not by_length[b]) << b
            seq[j], offset[j], used = n_seq, a, a + b
        if used < capacity:
            gaps.setdefault(capacity - used, []).append(n_seq)
            open_gaps |= 1 << (capacity - used)
        n_seq += 1
    for x in sorted((x for x in by_length if 3 * x <= capacity), reverse=True):
        for i in by_length[x]:
            fit = open_gaps >> x
            if fit:
                gap = x + (fit & -fit).bit_length() - 1
                s = gaps[gap].pop()
                open_gaps ^= (not gaps[gap]) << gap
            else:
                gap, s = capacity, n_seq
                n_seq += 1
            seq[i], offset[i] = s, capacity - gap
            if gap > x:
                gaps.setdefault(gap - x, []).append(s)
                open_gaps |= 1 << (gap - x)
    return seq, offset


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids (binary).

    Every input row is packed, repeated rows and null doc_ids too; a text of
    any length is cut into full pieces and a last one. Of equal lengths the
    piece that comes first goes first. An empty table gives an empty table;
    other columns are not looked at.
    """
    cut = stage(pieces(docs.select("doc_id", "text"), tokenizer, capacity, with_ids), "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    narrow = cut.drop("ids").withColumn("_group", F.pmod(F.xxhash64("piece_id"), F.lit(groups)))
    schema = narrow.drop("_group").schema.add("sequence_id", "long").add("offset", "long")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece_id")
        seq, offset = pack_lengths(group.column("length").to_numpy(), capacity)
        number = group.column("_group")[0].as_py() << 32
        return group.drop_columns("_group").append_column("sequence_id", pa.array(seq + number)).append_column("offset", pa.array(offset))

    placed = narrow.groupBy("_group").applyInArrow(run, schema)
    if not with_ids:
        return placed.drop("piece_id")
    return placed.join(cut.select("piece_id", "ids"), "piece_id").drop("piece_id")
