"""Recompression of word sequences: rounds that name runs and pairs alike in every text.

A round first gives each run of one symbol a name, made of the symbol and the
length of the run, then splits the symbols by one bit of their names into left
and right ones and gives each adjacent (left, right) pair a name. Names are 64
bits mixed from the names below, so equal words get equal names in every task
without a dictionary that would have to travel.

What a round makes of a window of words depends on the window alone, but for
its ends: the first and last run may go on outside, and a first right (last
left) symbol may be paired outside. A round pops these; what is left is the
window's interior, whose symbols stand in the parse of the whole text. The
symbols popped in all rounds, in order, are a signature of the window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_RUN, _PAIR, _POP, _LAST = (_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mix(a: np.ndarray, b: np.ndarray, salt: np.uint64) -> np.ndarray:
    """A 64-bit name of an ordered pair of 64-bit values."""
    x = (a ^ salt) * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(32)
    x += b * _U(0x9FB21C651E98DF25)
    x ^= x >> _U(29)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(32)
    return x


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (nulls have none) and where each text's words begin, with the end at last."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    words, ends = lists.values, np.asarray(lists.offsets)
    full = np.asarray(pc.not_equal(pc.binary_length(words), 0))
    return words.filter(pa.array(full)), np.concatenate(([0], np.cumsum(full)))[ends]


def word_names(words: pa.Array) -> np.ndarray:
    """64-bit names of words, mixed from eight bytes at a time and the length."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + n + 1] if n else np.zeros(1, np.int64)
    left, at = np.diff(offsets), offsets[:-1]
    names = mix(left.astype(np.uint64), np.zeros(n, np.uint64), _LAST)
    if not n:
        return names
    data = np.concatenate((np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]], np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, strides=(1,))
    at = at - offsets[0]
    live = np.arange(n)
    while len(live):
        value = eight[at]
        short = left < 8
        value[short] &= (_U(1) << (left[short] * 8).astype(np.uint64)) - _U(1)
        names[live] = mix(names[live], value, _RUN)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return names


class _Round:
    """One round over symbols ``sym``, texts beginning at ``starts``: what it pops at either end of a window, and the symbols it makes."""

    def __init__(self, sym: np.ndarray, starts: np.ndarray, level: int):
        n = len(sym)
        self.sym = sym
        new = np.ones(n, bool)
        np.not_equal(sym[1:], sym[:-1], out=new[1:])
        new[starts] = True
        self.run = np.cumsum(new, dtype=np.int32) - np.int32(1)
        head = np.flatnonzero(new)
        self.first = np.append(head, n)
        if len(head) < n:
            runs, size = sym[head], np.diff(self.first)
            long = np.flatnonzero(size > 1)
            runs[long] = mix(runs[long], size[long].astype(np.uint64), _RUN)
            starts = self.run[starts]
        else:
            runs = sym
        self.runs, k = runs, len(runs)
        # a bit of its own for each round, as most symbols stay what they are
        right = ((runs >> _U(level % 64)) & _U(1)).astype(bool)
        first = np.ones(k, bool)
        np.less_equal(right[1:], right[:-1], out=first[1:])
        first[starts] = True
        into = np.cumsum(first, dtype=np.int32) - np.int32(1)
        self.next, self.next_starts = runs[first], into[starts]
        pairs = np.flatnonzero(~first)
        self.next[into[pairs]] = mix(runs[pairs - 1], runs[pairs], _PAIR)
        # by the run of a window's first (last) symbol: is a right (left) symbol popped too, and where does the interior begin (end)
        self.pops_right = np.append(right[1:], False)
        self.pops_left = np.append(False, ~right[:-1])
        run, into = np.arange(k), np.append(into, np.int32(len(self.next)))
        self.begin = into[np.minimum(run + 1 + self.pops_right, k)][self.run]
        end = run - self.pops_left
        self.end = np.where(end > 0, into[end - 1] + 1, 0)[self.run]


class Parse:
    """The rounds over words whose texts begin at ``starts``, as many as windows of ``width`` words last."""

    def __init__(self, names: np.ndarray, starts: np.ndarray, width: int):
        self.width, self.rounds = width, []
        n = len(names)
        inside = np.zeros(n + 1, np.int32)
        inside[starts[starts < n]] = 1
        inside = np.cumsum(inside, dtype=np.int32)
        #: First words of the windows, none of which goes over the end of a text.
        self.at = np.flatnonzero(inside[:n - width + 1] == inside[width - 1:n]).astype(np.int32) if n >= width else np.zeros(0, np.int32)
        m = len(self.at)
        #: The name of each window's anchor: the first interior symbol of the last round before which it has one.
        self.anchor = np.zeros(m, np.uint64)
        #: Where it stands among its round's symbols.
        self.place = np.zeros(m, np.int32)
        live, lo, last, sym = np.arange(m, dtype=np.int32), self.at, self.at + np.int32(width - 1), names
        starts = np.unique(starts[starts < n])
        while len(live):
            level = len(self.rounds)
            r = _Round(sym, starts, level)
            self.rounds.append(r)
            begin, end = r.begin[lo], r.end[last]
            keep = begin < end
            gone = ~keep
            self.anchor[live[gone]] = sym[lo[gone]] + np.full(1, level, np.uint64) * _RUN
            self.place[live[gone]] = lo[gone]
            sym, starts = r.next, r.next_starts
            live, lo, last = live[keep], begin[keep], end[keep] - 1

    def signatures(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two signatures of each of the windows ``which``, indices of ``at``."""
        m = len(which)
        out, out2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        live, lo, hi = np.arange(m), self.at[which].astype(np.int64), self.at[which].astype(np.int64) + self.width
        sig, sig2 = np.full(m, _POP), np.full(m, _LAST)
        for r in self.rounds:
            if not len(live):
                break
            a, b = r.run[lo], r.run[hi - 1]
            runs = np.append(r.runs, _U(0))
            size0 = np.minimum(r.first[a + 1], hi) - lo
            size1 = np.where(a == b, 0, hi - r.first[b])
            # what the round pops: part of the first run and a right symbol after it, part of the last run and a left symbol before it
            inner = b - a - 1
            after = np.where((inner > 0) & r.pops_right[a], runs[a + 1], _U(0))
            left = r.pops_left[b] & (inner > (after != 0))
            before = np.where(left, runs[b - 1], _U(0))
            part = mix(r.sym[lo], (size0 << 32 | size1).astype(np.uint64), _POP)
            part = mix(mix(part, r.sym[hi - 1], _RUN), mix(after, before, _PAIR), _LAST)
            sig, sig2 = mix(sig, part, _RUN), mix(sig2, part, _PAIR)
            lo, hi = r.begin[lo], r.end[hi - 1]
            keep = lo < hi
            gone = live[~keep]
            out[gone], out2[gone] = sig[~keep], sig2[~keep]
            live, lo, hi, sig, sig2 = live[keep], lo[keep], hi[keep], sig[keep], sig2[keep]
        return out, out2
