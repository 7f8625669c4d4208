"""License scans: exact set-similarity join of text blocks with license templates.

A template is a known notice, a block a line of the text or a window of words
wherever the lines break, as long as the template divided by THRESHOLD. A block
meets a template if it holds at least THRESHOLD of the template's distinct
words. The join is exact: the template words are ordered by how many lines of
the corpus hold them, rarest first (one counting pass over all texts; the order
decides what is pruned, not what is found). A block that meets a template must
share a word of the template's prefix (prefix filter), be long enough (length
filter), and at their first common word, enough words must be left on both
sides (positional filter). What remains is counted out. A text holds all its
blocks, so it goes through the filters first, and its windows are looked at
only for the templates that the text as a whole meets.

The templates are a bounded set that tasks hold whole; each text is read by
one pass of a small kernel per Arrow batch, with no shuffle of texts.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidspark.llm.common import text_of

THRESHOLD = 0.8

# Base phrases, and notices (label, words that must be there, text).
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
TEMPLATES = [
    ("apache-2.0", "apache", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "mit", "Released under the MIT License"),
    ("mit", "sublicense", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
     "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl-3.0", "gnu 3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "gnu", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation"),
    ("lgpl", "lesser", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "affero", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met"),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2.0", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "unencumbered", "This is free and unencumbered software released into the public domain"),
]

# A-Z to a-z; what no word contains to a space; line feeds stay.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c == 10 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def plain(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE)


class Index:
    """Templates in global order with their prefixes, for ``meet``."""

    def __init__(self, templates: Sequence[tuple[str, str, str]], counts: dict[bytes, int], threshold: float) -> None:
        vocabulary = {w for _, _, t in templates for w in plain(t).split()}
        self.rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
        self.templates, self.prefix = [], {}
        for k, (label, keys, text) in enumerate(templates):
            parts = plain(text).split()
            words = sorted({self.rank[w] for w in parts})
            need = max(1, math.ceil(threshold * len(words) - 1e-9))
            self.templates.append((label, {self.rank[w] for w in keys.encode().split()}, words, set(words), need, math.ceil(len(parts) / threshold - 1e-9)))
            for i, w in enumerate(words[:len(words) - need + 1]):
                self.prefix.setdefault(w, []).append((k, i))
        self.starts = frozenset(w for w, r in self.rank.items() if r in self.prefix)

    def meet(self, block: list[bytes]) -> Iterator[tuple[int, float, bool]]:
        """(template, containment, whether its key words are there) of each template that the block meets."""
        if self.starts.isdisjoint(block):
            return
        own = sorted({self.rank[w] for w in block if w in self.rank})
        have, seen = set(own), set()
        for j, r in enumerate(own):
            for k, i in self.prefix.get(r, ()):
                _, keys, words, members, need, _ = self.templates[k]
                if k in seen or len(own) < need or 1 + min(len(words) - i - 1, len(own) - j - 1) < need:
                    continue
                seen.add(k)
                common = len(members & have)
                if common >= need:
                    yield k, common / len(words), keys <= have

    def passages(self, text: list[bytes], k: int) -> Iterator[tuple[int, int, float, bool]]:
        """(first word, last word, largest containment, key words) of each run of overlapping windows that meet template k."""
        _, keys, words, members, need, width = self.templates[k]
        at = [(p, r) for p, r in enumerate(map(self.rank.get, text)) if r in members]
        held, lo, run = Counter(), 0, None
        for p, r in at:
            held[r] += 1
            # what comes again is not needed: the later place stays longer
            while at[lo][0] <= p - width or held[at[lo][1]] > 1:
                held[at[lo][1]] -= 1
                if not held[at[lo][1]]:
                    del held[at[lo][1]]
                lo += 1
            if len(held) >= need:
                c, keyed = len(held) / len(words), keys <= held.keys()
                if run and at[lo][0] <= run[1]:
                    run = run[0], p, max(run[2], c), run[3] or keyed
                else:
                    if run:
                        yield run
                    run = at[lo][0], p, c, keyed
        if run:
            yield run


def block_counts(docs: DataFrame, templates: Sequence[tuple[str, str, str]]) -> dict[bytes, int]:
    """In how many blocks of all texts each template word stands (a bounded vocabulary)."""
    vocabulary = frozenset(w for _, _, t in templates for w in plain(t).split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("_text"):
                for line in plain(text.as_py()).split(b"\n"):
                    if hits := vocabulary.intersection(line.split()):
                        counts.update(hits)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["w", "n"])

    counted = docs.select(text_of().alias("_text")).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return {r["w"].encode(): r["n"] for r in counted.collect()}


def base_places(words: list[bytes], phrases: Sequence[tuple[str, str]] = PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of each place where a phrase's words stand consecutively."""
    joined, out = b" " + b" ".join(words) + b" ", []
    for label, phrase in phrases:
        p = b" " + phrase.encode() + b" "
        at = joined.find(p)
        while at >= 0:
            out.append((joined.count(b" ", 0, at), label))
            at = joined.find(p, at + 1)
    return sorted(out)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES,
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, keyed_labels, keyed_score, blocks.

    ``labels`` are the base labels and those of all templates that a block
    meets; ``score`` is 1 with a base place, else the largest containment of a
    met template, else 0. ``keyed_labels`` and ``keyed_score`` are the same for
    blocks of one line that also hold the template's key words. ``blocks`` lists all
    (line, last_line, label, containment, keyed): lines, then runs of
    overlapping windows that span lines; keyed tells whether the key words are
    there. A null or empty text has no words and empty labels. A text of any
    length is read whole, windows cost a step per template word in it. Repeated
    rows get equal results, an empty table gives an empty one, other columns
    are not looked at.
    """
    index = Index(templates, block_counts(docs, templates), threshold)
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {doc_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, keyed_labels string, keyed_score double, "
              "blocks array<struct<line:int,last_line:int,label:string,containment:double,keyed:boolean>>")
    block_type = pa.list_(pa.struct([("line", pa.int32()), ("last_line", pa.int32()), ("label", pa.string()), ("containment", pa.float64()), ("keyed", pa.bool_())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.float64(), block_type]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "keyed_labels", "keyed_score", "blocks"]

    def block(line: int, last: int, k: int, c: float, keyed: bool) -> dict:
        return {"line": line, "last_line": last, "label": index.templates[k][0], "containment": c, "keyed": keyed}

    def of(text: str) -> tuple:
        lines = [line.split() for line in plain(text).split(b"\n")]
        words, one, more = [w for line in lines for w in line], [], []
        if met := [k for k, _, _ in index.meet(words)]:
            one = [block(n, n, *m) for n, line in enumerate(lines) for m in index.meet(line)]
            ends = list(accumulate(map(len, lines)))
            for k in met:
                for first, last, c, keyed in index.passages(words, k):
                    a, b = bisect_right(ends, first), bisect_right(ends, last)
                    if a < b:
                        more.append(block(a, b, k, c, keyed))
        places = base_places(words, phrases)
        base = {label for _, label in places}
        found = lambda blocks: (",".join(sorted(base | {b["label"] for b in blocks})), 1.0 if places else max((b["containment"] for b in blocks), default=0.0))
        return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)),
                *found(one + more), *found([b for b in one if b["keyed"]]), one + more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of(t.as_py()) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types))], names=names)

    return docs.select("doc_id", text_of().alias("_text")).mapInArrow(run, schema)
