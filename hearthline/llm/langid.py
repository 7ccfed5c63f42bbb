"""Language identification with bit-sliced Bloom filters of byte n-grams.

Every language has a Bloom filter of the n-grams that are typical of it. The filters are stored side by side: slot s
of the one table holds a word whose bit l says whether slot s is set for language l, so that a few lookups and their
bitwise AND return all languages that contain an n-gram. A text's n-grams are looked up, bits are counted by
language, and each count is corrected for the filter's false positives: with a share f of a language's slots set and
k lookups, an n-gram outside is taken for inside with p = f^k, so of n n-grams about (count - n p) / (1 - p) are its
own. The language with the largest corrected count wins; the score is its share of all corrected counts.

N-grams are of bytes, A-Z lower-cased, all else but letters and bytes outside ASCII as spaces, and have no space but
at their ends. An n-gram is typical of a language if at least `floor` occurrences were seen and its frequency there
is at least `share` of its highest frequency in any language.

The model is fitted on about `lang_rows` rows of each language at most, chosen by a hash of id and text, so that rare
languages stay and copies of one text are no single choice. The filters are as long as the typical n-grams of the
fullest language ask for; where 2^`max_bits` slots are too few, n-grams seen more rarely than a power of two are left
out. A slot has one word for every 63 languages, so that there may be any number of them. The driver holds the names
of the languages and the filters, which are broadcast: at most 2^`max_bits` words for every 63 languages.

Every text is judged whole. Null texts and texts without a letter are `und` with score 0. Texts without a known n-gram
get the language with most training text and score 0, ties go to the smaller code. Without labelled rows every text
with a letter is `und` too. Columns that the operator adds replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import bytecode as B

SIZES = (3, 5)
LOOKUPS = 3
LANG_ROWS = 10_000
MIN_BITS, MAX_BITS = 16, 22
IN_WORD = 63  # languages; the sign bit stays free
LETTERS = np.full(256, 32, dtype=np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


def grams(chunk: B.Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: hashes of the n-grams, and for each row the number of its first (rows + 1 entries)."""
    data = LETTERS[chunk.data]
    space = (data == 32).astype(np.int32)
    spaces = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(space, out=spaces[1:])
    row_end = np.repeat(chunk.offsets[1:], np.diff(chunk.offsets))
    for n in SIZES:
        many = max(0, len(data) - n + 1)
        code = np.full(many, n, dtype=B.U64)
        for i in range(n):
            code <<= B.U64(8)
            code |= data[i:i + many]
        inner = spaces[n - 1:n - 1 + many] - spaces[1:1 + many]
        fits = np.flatnonzero((inner == 0) & (row_end[:many] >= np.arange(many) + n))
        yield B.mix(code[fits]), np.searchsorted(fits, chunk.offsets)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def _count(langs: list[str]):
    """N-grams of texts with their language, as its number in langs."""
    number = {name: i for i, name in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_lang = [number[x] for x in batch.column(0).to_pylist()]
            seen: dict[int, list] = {}
            for chunk in B.chunks(batch.column(1)):
                own: dict[int, list[int]] = {}
                for r in range(chunk.rows):
                    own.setdefault(own_lang[chunk.first + r], []).append(r)
                for codes, first in grams(chunk):
                    for lang, rows in own.items():
                        part = np.unique(np.concatenate([codes[first[r]:first[r + 1]] for r in rows]), return_counts=True)
                        seen.setdefault(lang, []).append(part)
                for lang, parts in seen.items():  # what is held stays near the number of different n-grams
                    if sum(len(k) for k, _ in parts[1:]) > max(200_000, len(parts[0][0])):
                        seen[lang] = [_merged(parts)]
            for lang, parts in seen.items():
                key, n = _merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), lang, dtype=np.int32)), pa.array(key.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
    return run


@dataclass
class Model:
    """Languages in order of their bit, slots by word and number, false-positive rates, and the language of most text."""

    langs: list[str]
    slots: np.ndarray
    wrong: np.ndarray
    usual: int

    def masks(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        """For each word of a slot: the languages of that word that have all slots of a code set."""
        low, step, last = codes & B.U64(0xFFFFFFFF), (codes >> B.U64(32)) | B.U64(1), B.U64(self.slots.shape[1] - 1)
        places = [((low + B.U64(i) * step) & last).astype(np.int64) for i in range(LOOKUPS)]
        for word in self.slots:
            out = word[places[0]]
            for at in places[1:]:
                out = out & word[at]
            yield out

    def counts(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many codes of each row every language's filter contains."""
        out = np.zeros((len(first) - 1, len(self.langs)), dtype=np.int64)
        for w, masks in enumerate(self.masks(codes)):
            for i in range(w * IN_WORD, min(len(self.langs), (w + 1) * IN_WORD)):
                ones = np.zeros(len(masks) + 1, dtype=np.int64)
                np.cumsum((masks >> masks.dtype.type(i - w * IN_WORD)) & masks.dtype.type(1), out=ones[1:])
                out[:, i] = np.diff(ones[first])
        return out


def _places(bits: int) -> Column:
    """A gram's slots, as in `Model.masks`."""
    low, step = F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1).cast("long"))
    return F.array(*[(low + step * i).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) for i in range(LOOKUPS)])


def _length(sizes: list[tuple[int, int, int]], max_bits: int) -> tuple[int, int]:
    """From (language, power of two of n, n-grams): bits of a slot's number that leave filters half full at most, and the least power they hold."""
    power = 0
    while True:
        held: dict[int, int] = {}
        for lang, p, k in sizes:
            held[lang] = held.get(lang, 0) + (k if p >= power else 0)
        bits = max(MIN_BITS, (2 * LOOKUPS * max(held.values(), default=0)).bit_length())
        if bits <= max(MIN_BITS, max_bits):
            return bits, power
        power += 1


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", lang_rows: int = LANG_ROWS, floor: int = 5, share: float = 0.25,
        max_bits: int = MAX_BITS) -> Model:
    """Learn from the rows with a language; everything but names and filters stays in Spark."""
    known = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    there = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(there)
    if not langs:
        return Model([], np.zeros((1, 1 << MIN_BITS), dtype=np.uint8), np.zeros(0), 0)
    fine = 1 << 30
    parts = {x: min(fine, fine * lang_rows // n) for x, n in there.items() if n > lang_rows}
    if parts:
        wanted = F.coalesce(F.create_map(*[F.lit(v) for pair in parts.items() for v in pair])[F.col("lang")], F.lit(fine))
        known = known.where(F.pmod(F.xxhash64("key", "text", F.lit(4)), F.lit(fine)) < wanted)
    counts = cut_lineage(known.select("lang", "text").mapInArrow(_count(langs), "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    every = [sums.get(i, 0) for i in range(len(langs))]
    rated = counts.where(F.col("n") >= floor).select("gram", "lang", "n", (F.col("n") / F.array(*[F.lit(x).cast("long") for x in every])[F.col("lang")]).alias("rate"))
    best = rated.groupBy("gram").agg(F.collect_list(F.struct("lang", "n", "rate")).alias("by"), F.max("rate").alias("top"))  # one entry a language
    typical = cut_lineage(best.select("gram", F.explode(F.filter("by", lambda x: x.rate >= F.col("top") * share)).alias("x")).select("gram", "x.lang", "x.n"))
    power = F.floor(F.log2("n")).cast("int")
    bits, least = _length([tuple(r) for r in typical.groupBy("lang", power.alias("power")).agg(F.count(F.lit(1)).alias("k")).collect()], max_bits)
    marks = typical.where(power >= least).select(F.explode(_places(bits)).alias("slot"), F.expr(f"lang div {IN_WORD}").alias("word"), F.expr(f"shiftleft(1L, lang % {IN_WORD})").alias("bits"))
    filled = marks.groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most 2^bits rows of three numbers for each word
    slots = np.zeros((-(-len(langs) // IN_WORD), 1 << bits), dtype=np.uint64)
    slots[filled["word"].to_numpy(np.int64), filled["slot"].to_numpy(np.int64)] = filled["bits"].to_numpy(np.int64).view(np.uint64)
    full = np.array([((slots[i // IN_WORD] >> B.U64(i % IN_WORD)) & B.U64(1)).mean() for i in range(len(langs))])
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    return Model(langs, slots.astype(kind), np.minimum(full ** LOOKUPS, 0.999), int(np.argmax(every)))


def _judge(shared, text: str, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            names, scores = [], []
            for chunk in B.chunks(batch.column(batch.schema.get_field_index(text))):
                counts, many = np.zeros((chunk.rows, len(model.langs))), np.zeros(chunk.rows)
                for codes, first in grams(chunk):
                    many += np.diff(first)
                    counts += model.counts(codes, first)
                own = np.maximum(0, (counts - many[:, None] * model.wrong) / (1 - model.wrong)) if model.langs else counts
                sums = own.sum(axis=1)
                best = np.argmax(own, axis=1) if model.langs else np.zeros(chunk.rows, dtype=int)
                for r in range(chunk.rows):
                    names.append("und" if not model.langs else model.langs[best[r] if sums[r] > 0 else model.usual])
                    scores.append(float(own[r, best[r]] / sums[r]) if sums[r] > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *added])
    return run


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    taken, added = {c.lower() for c in base.columns}, []
    for name in ("lang", "score"):  # names that no column has
        number = 0
        while f"{name}_{number}" in taken:
            number += 1
        added.append(f"{name}_{number}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*base.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])
    found = base.mapInArrow(_judge(shared, text, added), schema)
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & (F.col(added[0]) != "und")
    return found.select(*[F.col(f"`{c}`") for c in base.columns], F.when(lettered, F.col(added[0])).otherwise("und").alias("lang_pred"),
                        F.when(lettered, F.col(added[1])).otherwise(0.0).alias("score"))
