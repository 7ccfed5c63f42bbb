"""License scans as an exact set-similarity join between phrase templates and blocks of consecutive words.

A block is any `width` consecutive words of a text. It meets a template when the template's distinct words that it
holds make at least `threshold` of them. Three filters find the candidates without looking at every block:

* prefix: with the template's words in rising order of their frequency in the whole corpus, a block that holds
  `need` of m words holds at least one of the first m - need + 1, so only those rare words open blocks;
* length: a text of fewer than `need` words is passed over;
* position: around a rare word, blocks are checked only if enough template words stand within reach.

What remains is counted exactly. Phrases are templates with threshold 1, as wide as they have words, whose words
must also stand in the template's order. Words are runs of digits, letters a-z after lower-casing A-Z, and bytes
outside ASCII.

Null and empty texts have no words and no finds. Overlapping blocks of one template are reported once, as the range
from the first to the last block, with the best containment among them. Repeated templates are taken once. Empty
tables give empty results. Columns that the operator adds replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytecode as B


@dataclass(frozen=True)
class Template:
    """Words in order, by spaces; `ordered` asks for the phrase itself, else `threshold` of its distinct words."""

    label: str
    words: str
    ordered: bool = False
    threshold: float = 0.8
    slack: int = 2

    @property
    def distinct(self) -> list[bytes]:
        return sorted({w.encode() for w in self.words.split()})

    @property
    def need(self) -> int:
        m = len(self.distinct)
        return m if self.ordered else max(1, int(np.ceil(self.threshold * m - 1e-9)))

    @property
    def width(self) -> int:
        return len(self.words.split()) + (0 if self.ordered else self.slack)


# fixed values: the four phrases and their labels
PHRASES = (Template("gpl", "gnu general public license", True), Template("apache", "apache license", True), Template("cc-by", "cc by", True), Template("mit", "mit license", True))

#: wordings that license lines and headers commonly use
WORDINGS = (
    Template("gpl-3.0", "licensed under the gnu general public license version 3", threshold=1.0),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", threshold=1.0),
    Template("apache-2.0", "licensed under the apache license version 2 0", threshold=1.0),
    Template("mit-release", "released under the mit license", threshold=1.0, slack=1),
    Template("cc-by-nc", "licensed under cc by nc 4 0", threshold=1.0),
    Template("cc-by-sa", "licensed under cc by sa 4 0", threshold=1.0),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("gpl-grant", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("no-warranty", "the software is provided as is without warranty of any kind express or implied"),
)


class Vocabulary:
    """The distinct words of all templates, found by hash and numbered."""

    def __init__(self, templates: tuple[Template, ...]):
        self.words = sorted({w for t in templates for w in t.distinct})
        joined = np.frombuffer(b"".join(self.words) + b" ", dtype=np.uint8)
        ends = np.cumsum([len(w) for w in self.words])
        codes = B.pieces(B.Chunk(joined, np.array([0, len(joined)]), 0).sums(), ends - [len(w) for w in self.words], ends)
        order = np.argsort(codes)
        self.codes, self.number = codes[order], order
        self.flags = np.zeros(1 << 20, dtype=bool)
        self.flags[(codes & B.U64((1 << 20) - 1)).astype(np.int64)] = True

    def places(self, low: B.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Where words of the vocabulary stand, which they are, the first word of each row, and the count of words."""
        starts, ends, first = low.words(B.WORDY)
        codes = B.pieces(low.sums(), starts, ends)
        at = np.flatnonzero(self.flags[(codes & B.U64((1 << 20) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        real = self.codes[k] == codes[at]
        return at[real], self.number[k[real]], first, len(starts)


def _frequencies(templates: tuple[Template, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(templates)
        total = np.zeros(len(known.words), dtype=np.int64)
        for batch in batches:
            for chunk in B.chunks(batch.column(0)):
                total += np.bincount(known.places(chunk.lower())[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["word", "n"])
    return run


def frequencies(docs: DataFrame, templates: tuple[Template, ...], text: str = "text") -> list[int]:
    """How often each word of the templates occurs in all texts; as many numbers as the templates have words."""
    rows = docs.select(F.col(text)).mapInArrow(_frequencies(templates), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = [0] * len(Vocabulary(templates).words)
    for r in rows:
        out[r["word"]] = r["n"]
    return out


class _Join:
    """The templates with their rare words, ready for scanning."""

    def __init__(self, templates: tuple[Template, ...], frequency: list[int]):
        self.known = Vocabulary(templates)
        number = {w: i for i, w in enumerate(self.known.words)}
        self.templates, self.by_rare = [], {}
        for t in dict.fromkeys(templates):
            own = sorted((number[w] for w in t.distinct), key=lambda i: (frequency[i], i))
            k = len(self.templates)
            self.templates.append((t, set(own), [number[w.encode()] for w in t.words.split()]))
            for i in own[:len(own) - t.need + 1]:
                self.by_rare.setdefault(i, []).append(k)
        self.rare = np.zeros(len(self.known.words), dtype=bool)
        self.rare[list(self.by_rare)] = True

    def finds(self, low: B.Chunk) -> tuple[np.ndarray, dict[int, list[tuple]]]:
        """Words of each row, and by row (label, ordered, first start, last start, containment)."""
        at, word, first, _ = self.known.places(low)
        found: dict[tuple[int, int], dict[int, float]] = {}
        for j in np.flatnonzero(self.rare[word]).tolist():
            i = int(at[j])
            row = int(np.searchsorted(first, i, side="right")) - 1
            begin, end = int(first[row]), int(first[row + 1])
            for k in self.by_rare[int(word[j])]:
                t, own, order = self.templates[k]
                if end - begin < t.need:
                    continue
                lo, hi = np.searchsorted(at, max(begin, i - t.width + 1)), np.searchsorted(at, min(end, i + t.width))
                near = [(int(at[x]), int(word[x])) for x in range(lo, hi) if int(word[x]) in own]
                if len({w for _, w in near}) < t.need:
                    continue
                starts = found.setdefault((row, k), {})
                for s in range(max(begin, i - t.width + 1), min(i, max(begin, end - t.width)) + 1):
                    if s in starts:
                        continue
                    block = [(p, w) for p, w in near if s <= p < s + t.width]
                    share = len({w for _, w in block}) / len(own)
                    if len({w for _, w in block}) >= t.need and (not t.ordered or [w for _, w in block] == order):
                        starts[s] = share
        out: dict[int, list[tuple]] = {}
        for (row, k), starts in sorted(found.items()):
            t, begin = self.templates[k][0], int(first[row])
            places = sorted(starts)
            while places:
                n = 1
                while not t.ordered and n < len(places) and places[n] - places[n - 1] < t.width:
                    n += 1
                out.setdefault(row, []).append((t.label, t.ordered, places[0] - begin, places[n - 1] - begin, max(starts[p] for p in places[:n])))
                places = places[n:]
        return np.diff(first), out


FOUND = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("phrase", T.BooleanType()), T.StructField("first", T.LongType()),
                                  T.StructField("last", T.LongType()), T.StructField("containment", T.DoubleType())]))


def _scan(templates: tuple[Template, ...], frequency: list[int], text: str):
    kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = _Join(templates, frequency)
        for batch in batches:
            counts, finds = [], []
            for chunk in B.chunks(batch.column(batch.schema.get_field_index(text))):
                n, found = join.finds(chunk.lower())
                counts += n.tolist()
                finds += [[dict(zip(("label", "phrase", "first", "last", "containment"), x)) for x in found.get(r, ())] for r in range(chunk.rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), pa.array(finds, kind)], names=[*batch.schema.names, "n_words", "finds"])
    return run


def scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + WORDINGS, text: str = "text") -> DataFrame:
    """docs with n_words and `finds`: label, whether it is a phrase, first and last start, containment."""
    base = docs.select(*[c for c in docs.columns if c not in ("n_words", "finds")])
    frequency = frequencies(base, templates, text)
    schema = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("finds", FOUND)])
    return base.mapInArrow(_scan(templates, frequency, text), schema)
