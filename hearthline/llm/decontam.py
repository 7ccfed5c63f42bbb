"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over all training windows.

A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window. Words are
runs of digits, letters a-z after lower-casing A-Z, and bytes outside ASCII. Windows of documents are hashed while
scanning; a hash that is in the set is verified word by word before it counts.

The set is cut into slices of at most `slice_windows` windows, counted before anything is collected. Usually there
is one slice and one scan; a larger benchmark takes one scan for each slice, the finds so far stored in between, so
that memory stays bounded and no window is left out.

Null or empty texts have no words and no finds, null and repeated items do no harm (finds name distinct items), a
null item id reads as 'null'. An empty table on either side gives no finds. Columns that the operator adds replace
columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import bytecode as B

WIDTH = 13
SLICE_WINDOWS = 200_000
_FLAG_BITS = 22


def _window_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column(0).to_pylist()
            out: dict[str, list] = {"key": [], "n": [], "words": [], "item": []}
            for chunk in B.chunks(batch.column(1)):
                low = chunk.lower()
                starts, ends, first = low.words(B.WORDY)
                codes, raw = B.pieces(low.sums(), starts, ends), low.data.tobytes()
                for r in range(low.rows):
                    a, b = first[r], first[r + 1]
                    n = min(width, b - a)
                    if n:
                        own = [raw[starts[i]:ends[i]] for i in range(a, b)]
                        for i, key in enumerate(B.sequences(codes[a:b], n).view(np.int64).tolist()):
                            out["key"].append(key)
                            out["n"].append(int(n))
                            out["words"].append(b" ".join(own[i:i + n]))
                            out["item"].append(items[low.first + r])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.int64()), ("n", pa.int32()), ("words", pa.binary()), ("item", pa.string())]))
    return run


def benchmark_windows(benchmark: DataFrame, width: int = WIDTH, item: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct windows of all items: key (hash), n (words), words (joined by spaces), item (id as a string)."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")), F.col(text))
    return rows.mapInArrow(_window_rows(width), "key long, n int, words binary, item string").distinct()


class WindowSet:
    """One slice of the windows, as each task looks it up."""

    def __init__(self, rows: list):
        self.flags, self.by_key, self.lengths = np.zeros(1 << _FLAG_BITS, dtype=bool), {}, sorted({r["n"] for r in rows})
        for r in rows:
            key = r["key"] & ((1 << 64) - 1)
            self.flags[key & ((1 << _FLAG_BITS) - 1)] = True
            self.by_key.setdefault((r["n"], key), {}).setdefault(bytes(r["words"]), []).append(r["item"])

    def find(self, low: B.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, set]]:
        """Word starts and ends, first word of each row, which words are hit, and items by row."""
        starts, ends, first = low.words(B.WORDY)
        codes, raw, change, items = B.pieces(low.sums(), starts, ends), None, np.zeros(len(starts) + 1, dtype=np.int32), {}
        for n in self.lengths:
            keys = B.sequences(codes, n)
            maybe = np.flatnonzero(self.flags[(keys & B.U64((1 << _FLAG_BITS) - 1)).astype(np.int64)])
            for i in maybe[B.inside_row(first, n, len(starts))[maybe]].tolist():
                known = self.by_key.get((n, int(keys[i])))
                if known is None:
                    continue
                raw = low.data.tobytes() if raw is None else raw
                found = known.get(b" ".join([raw[starts[j]:ends[j]] for j in range(i, i + n)]))
                if found:
                    change[i] += 1
                    change[i + n] -= 1
                    items.setdefault(int(np.searchsorted(first, i, side="right")) - 1, set()).update(found)
        return starts, ends, first, np.cumsum(change[:-1]) > 0, items


def _scan(shared, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: WindowSet = shared.value
        for batch in batches:
            counts, hits, found = [], [], []
            before = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hit_words", "items")]
            for chunk in B.chunks(batch.column(batch.schema.get_field_index(text))):
                _, _, first, hit, items = windows.find(chunk.lower())
                counts += np.diff(first).tolist()
                at = np.flatnonzero(hit)
                cut = np.searchsorted(at, first)
                for r in range(chunk.rows):
                    own = (at[cut[r]:cut[r + 1]] - first[r]).tolist()
                    earlier, named = before[0][chunk.first + r], before[1][chunk.first + r]
                    hits.append(sorted({*own, *earlier}) if earlier else own)
                    found.append(sorted({*items.get(r, ()), *named}))
            made = {"n_words": pa.array(counts, pa.int64()), "hit_words": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(found, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(i)) for i, c in enumerate(batch.schema.names)], names=batch.schema.names)
    return run


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, slice_windows: int = SLICE_WINDOWS, item: str = "item_id", text: str = "text",
         item_text: str = "text") -> DataFrame:
    """docs with n_words, hit_words (positions inside an occurrence of a window) and items (ids of those windows)."""
    windows = cut_lineage(benchmark_windows(benchmark, width, item, item_text))
    slices = max(1, -(-windows.count() // slice_windows))
    made = {"n_words": F.lit(0).cast("long"), "hit_words": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}
    out = docs.select(*[c for c in docs.columns if c not in made], *[v.alias(c) for c, v in made.items()])
    for k in range(slices):
        rows = windows.where(F.pmod("key", F.lit(slices)) == k).collect()  # at most about slice_windows rows
        shared = docs.sparkSession.sparkContext.broadcast(WindowSet(rows))
        out = out.mapInArrow(_scan(shared, text), T.StructType(out.schema.fields))
        out = cut_lineage(out) if k + 1 < slices else out
    return out


def is_contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """At least one hit word in `share`."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = 20, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, columns as they were. Columns of docs may bear any name."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = scan(plain, benchmark, text=f"c{docs.columns.index(text)}", **options)
    kept = found.where(~is_contaminated(F.col("n_words"), F.size("hit_words").cast("long"), share))
    return kept.select(*plain.columns).toDF(*docs.columns)


def _cut(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cuts = batch.schema.get_field_index(text), batch.column(batch.schema.get_field_index("hit_words")).to_pylist()
            old = batch.column(at)
            new: list = [None] * len(cuts)
            for chunk in B.chunks(old):
                starts, ends, first = chunk.lower().words(B.WORDY)
                for r in range(chunk.rows):
                    raw, gone = chunk.data[chunk.offsets[r]:chunk.offsets[r + 1]].tobytes(), cuts[chunk.first + r]
                    kept, at_byte, i = [], 0, 0
                    while i < len(gone):  # a run of hit words goes from its first byte to its last
                        j = i
                        while j + 1 < len(gone) and gone[j + 1] == gone[j] + 1:
                            j += 1
                        kept.append(raw[at_byte:starts[first[r] + gone[i]] - chunk.offsets[r]])
                        at_byte, i = ends[first[r] + gone[j]] - chunk.offsets[r], j + 1
                    new[chunk.first + r] = b"".join([*kept, raw[at_byte:]]).decode("utf-8", "replace") if old[chunk.first + r].is_valid else None
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
    return run


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """All documents, with the hit words and what stands between neighbouring hit words cut out of the text."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    name = f"c{docs.columns.index(text)}"
    found = scan(plain, benchmark, text=name, **options)
    return found.mapInArrow(_cut(name), T.StructType(found.schema.fields)).select(*plain.columns).toDF(*docs.columns)
