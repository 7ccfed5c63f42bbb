"""Repeated windows of text, found by a radix sort of suffixes to a limited depth.

A suffix counts here only through its first `window` bytes, its window: groups of suffixes with equal windows are the
repeated strings. The sort goes from coarse to fine digits, and only groups that can still hold a repeat go on:

1. First digit: the anchor of a window, its `gram`-byte piece with the least hash (the first of equals). Equal windows
   have equal anchors at equal places. Neighbouring suffixes mostly share one anchor occurrence, so they are handled
   as one run: the longest stretch of windows with the same anchor. This is the pass over all text.
2. Second digit: the whole string of a run. Runs with equal strings hold equal windows throughout, so all but those in
   the document with the least id are repeats. Anchors whose runs are all equal end here.
3. Third digit: the anchor with bytes at its sides. A window has `window - gram` bytes around its anchor; three digits
   (two thirds of these to the right, a third to each side, two thirds to the left) cover every place that the anchor
   can have in it, so equal windows agree in at least one. Of each different run whose anchor has other runs one copy is
   looked at, and it goes on only where one of its digits recurs in another document.
4. Last digit: the window itself.

Each pass deals digits to groups by number, sorts inside the tasks, and drops what is settled. Runs are settled within
a slice of the input before they are dealt: of equal runs in a slice only those of the least document travel, so a passage that a
third of all documents share costs a group one entry for each slice. The number of groups follows the bytes of the
input. Marks return to the documents by a key of id and text.

A document's byte is removed if it is covered by a window that also starts in a document with a smaller id; windows
never cross documents and are judged on the input. Null texts are empty; texts shorter than a window keep all bytes.
Documents with a null id neither lose bytes nor make others lose any. Rows of equal ids do not make each other lose
bytes. Columns that the operator adds replace columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import bytecode as B

WINDOW, GRAM = 50, 20
SLICE_BYTES, PACK_BYTES, CHUNK_BYTES = 8 << 20, 4 << 20, 1 << 19
RUN_GROUP_BYTES, TEXT_GROUP_BYTES = 16 << 20, 16 << 20
BLOBS = "kind int, part int, data binary"
_DIGITS, _MARKS, _OPEN, _TEXTS = 0, 1, 2, 3  # what a blob holds: runs, ranges to remove, ranges to look at, texts


def _press(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(pickle.dumps(arrays, protocol=5))


def _unpress(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary())],
                                      names=["kind", "part", "data"])


def runs(chunk: B.Chunk, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, string hash, row, start in the row, and length of every run of a chunk."""
    return runs_and_sides(chunk, window, gram)[:5]


def runs_and_sides(chunk: B.Chunk, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, string hash, row, start in the row, length, and the three side digits of every run of a chunk."""
    size, many = len(chunk.data), window - gram + 1
    if size < window:
        return *(np.zeros(0, dtype=t) for t in (B.U64, B.U64, np.int64, np.int64, np.int64)), np.zeros((0, 3), dtype=np.uint16)
    sums = chunk.sums()
    at = np.arange(size - gram + 1)
    code = B.pieces(sums, at, at + gram)
    least = (code & ~B.U64(0xFFFFFFFF)) | at.astype(B.U64)  # high half of the hash, then the place
    step = 1
    while step * 2 <= many:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < many:
        least = np.minimum(least[:step - many], least[many - step:])
    anchor = (least & B.U64(0xFFFFFFFF)).astype(np.int64)
    first = np.arange(size - window + 1)
    whole = np.repeat(chunk.offsets[1:], np.diff(chunk.offsets))[:len(first)] >= first + window
    fresh = whole.copy()
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    last = whole.copy()
    last[:-1] &= fresh[1:] | ~whole[1:]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + window
    row = np.searchsorted(chunk.offsets, starts, side="right") - 1
    return (code[anchor[starts]], B.mix(B.pieces(sums, starts, ends) ^ (ends - starts).astype(B.U64)), row, starts - chunk.offsets[row], ends - starts,
            _sides(sums, anchor[starts], starts, ends, window, gram))


def _sides(sums: np.ndarray, anchor: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Digits of 16 bits from the bytes beside each run's anchor; 0 where no window of the run has the anchor there."""
    third = (window - gram) // 3
    out = np.zeros((len(anchor), 3), dtype=np.uint16)
    for k in range(3):
        a, z = anchor - k * third, anchor + gram + (2 - k) * third
        has = (a >= starts) & (z <= ends)
        digit = B.mix(B.pieces(sums, a[has], z[has])) >> B.U64(48)
        out[has, k] = np.maximum(digit, B.U64(1))
    return out


def _recurs(anchor: np.ndarray, digits: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which runs share a digit with a run of the same anchor in another document."""
    out = np.zeros(len(doc), dtype=bool)
    for k in range(digits.shape[1]):
        some = np.flatnonzero(digits[:, k])
        value = anchor[some] << B.U64(16) | digits[some, k].astype(B.U64)
        order = np.argsort(value, kind="stable")
        v, d = value[order], doc[some][order]
        cut = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, dtype=np.int64)
        if len(cut):
            two = np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut)
            out[some[order]] |= np.repeat(two, np.diff(np.r_[cut, len(v)]))
    return out


def _row_keys(chunk: B.Chunk, ids: np.ndarray) -> np.ndarray:
    return B.mix(B.pieces(chunk.sums(), chunk.offsets[:-1], chunk.offsets[1:]) ^ B.mix(ids.view(B.U64) + B.U64(77)))


def _split(part: np.ndarray, kind: int, arrays: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """One blob for each part, entries in their given order."""
    order = np.argsort(part, kind="stable")
    found, cut = np.unique(part[order], return_index=True)
    return [(kind, int(p), _press(*[a[o] for a in arrays])) for p, o in zip(found, np.split(order, cut[1:]))] if len(part) else []


def _marks(kind: int, rows: np.ndarray, start: np.ndarray, length: np.ndarray, anchor: np.ndarray | None, parts: int) -> list[tuple[int, int, bytes]]:
    """Ranges for the documents: to remove, or (with their anchors) to be looked at by window."""
    order = np.lexsort((start, rows))
    arrays = [rows, start.astype(np.uint32), length.astype(np.uint32), *([] if anchor is None else [anchor])]
    return _split((rows % B.U64(parts)).astype(np.int64)[order], kind, [a[order] for a in arrays])


def _later(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by value; where each value's group begins; and, in that order, which have an earlier document in their group."""
    order = np.argsort(value, kind="stable")
    v, d = value[order], doc[order]
    cut = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, dtype=np.int64)
    least = np.repeat(np.minimum.reduceat(d, cut), np.diff(np.r_[cut, len(v)])) if len(v) else d
    return order, cut, d > least


def _settle(found: list, keys: np.ndarray, ids: np.ndarray, window: int, groups: int, parts: int) -> pa.RecordBatch:
    """Marks for the runs that an earlier document of the slice holds too; the other runs, dealt by anchor."""
    anchor, code, row, start, length, sides = (np.concatenate(x) for x in zip(*found))
    word = (anchor & ~B.U64((1 << 40) - 1)) | (code >> B.U64(24))
    order, _, later = _later(word, ids[row])
    gone, stay = order[later], np.sort(order[~later])
    out = _marks(_MARKS, keys[row[gone]], start[gone], length[gone], None, parts)
    group = (anchor[stay] % B.U64(groups)).astype(np.int64)
    deal = np.argsort(group, kind="stable")
    g, cut = np.unique(group[deal], return_index=True)
    for p, o in zip(g, np.split(stay[deal], cut[1:])) if len(stay) else ():
        docs, place = np.unique(row[o], return_inverse=True)
        out.append((_DIGITS, int(p), _press(word[o], place.astype(np.uint16 if len(docs) < 65536 else np.uint32), ids[docs], keys[docs],
                                            start[o].astype(np.uint32), length[o].astype(np.uint8 if window < 128 else np.uint32), sides[o])))
    return _rows(out)


def _first_pass(window: int, gram: int, groups: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            found, keys, begin, held = [], [], 0, 0
            for chunk in B.chunks(batch.column(1), CHUNK_BYTES):
                if held >= SLICE_BYTES:
                    yield _settle(found, np.concatenate(keys), ids[begin:chunk.first], window, groups, parts)
                    found, keys, begin, held = [], [], chunk.first, 0
                anchor, code, row, start, length, sides = runs_and_sides(chunk, window, gram)
                keys.append(_row_keys(chunk, ids[chunk.first:chunk.first + chunk.rows]))
                fits = known[row + chunk.first]
                found.append([x[fits] for x in (anchor, code, row + (chunk.first - begin), start.astype(np.uint32), length.astype(np.uint32), sides)])
                held += len(chunk.data)
            if found:
                yield _settle(found, np.concatenate(keys), ids[begin:], window, groups, parts)
    return run


def _grouped(work: Callable[[int, int, list[bytes]], list[tuple[int, int, bytes]]]):
    """Apply `work` to the blobs of each (kind, part), which come sorted; several batches may share one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for kind, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (kind, part) != at:
                    if held:
                        yield _rows(work(*at, held))
                    at, held = (kind, part), []
                held.append(data.as_py())
        if held:
            yield _rows(work(*at, held))
    return run


def _run_groups(parts: int):
    def work(kind: int, part: int, blobs: list[bytes]) -> list[tuple[int, int, bytes]]:
        if kind == _MARKS:
            return [(kind, part, b) for b in blobs]
        cols = []
        for b in blobs:
            word, place, ids, keys, start, length, sides = _unpress(b)
            cols.append((word, ids[place], keys[place], start, length, sides))
        word, doc, key, start, length, sides = (np.concatenate(x) for x in zip(*cols))
        order, cut, later = _later(word, doc)
        top = word[order][cut] >> B.U64(40)  # the anchor of each different run; equal ones stand together
        edge = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
        alone = np.repeat(np.diff(np.r_[edge, len(top)]) == 1, np.diff(np.r_[edge, len(top)]))
        open_ = ~np.repeat(alone, np.diff(np.r_[cut, len(order)])) & ~later
        gone, more = order[later], order[open_]
        more = more[_recurs(word[more] >> B.U64(40), sides[more], doc[more])]
        anchor = (word[more] >> B.U64(40) << B.U64(32)) | B.U64(part)
        return _marks(_MARKS, key[gone], start[gone], length[gone], None, parts) + _marks(_OPEN, key[more], start[more], length[more], anchor, parts)
    return work


def _pack_texts(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            known = np.asarray(batch.column(0).is_valid())
            for chunk in B.chunks(batch.column(1), PACK_BYTES):
                own = slice(chunk.first, chunk.first + chunk.rows)
                keys = _row_keys(chunk, ids[own])
                out, part = [], (keys % B.U64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                p, cut = np.unique(part[order], return_index=True)
                for q, o in zip(p, np.split(order, cut[1:])):
                    texts = [chunk.data[chunk.offsets[i]:chunk.offsets[i + 1]] for i in o]
                    out.append((_TEXTS, int(q), _press(ids[own][o], known[own][o], keys[o], np.array([len(t) for t in texts], dtype=np.int64), np.concatenate(texts))))
                yield _rows(out)
    return run


def _by_part(work: Callable[[list[bytes], list[bytes]], pa.RecordBatch | None]):
    """Blobs come sorted by part, marks before texts: apply `work` to the marks and texts of each part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])
        for batch in batches:
            for kind, part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if part != at:
                    if at is not None and (out := work(*held)) is not None:
                        yield out
                    at, held = part, ([], [])
                held[kind == _TEXTS].append(data.as_py())
        if at is not None and (out := work(*held)) is not None:
            yield out
    return run


def _gather(marks: list[bytes], columns: int) -> tuple[np.ndarray, ...]:
    """All ranges of a part in order of row and start: row key, start, length and, where there is one, the anchor."""
    if not marks:
        return tuple(np.zeros(0, t) for t in (B.U64, np.int64, np.int64, B.U64)[:columns])
    found = [np.concatenate(x) for x in zip(*[_unpress(b) for b in marks])]
    order = np.lexsort((found[1], found[0]))
    return tuple(x[order] if x.dtype == B.U64 else x[order].astype(np.int64) for x in found)


def _cut_runs(groups: int):
    """The bytes of the runs that are to be looked at by window, dealt by anchor."""
    def work(marks: list[bytes], texts: list[bytes]) -> pa.RecordBatch | None:
        key, start, length, anchor = _gather(marks, 4)
        if not len(key):
            return None
        found = []
        for b in texts:
            ids, known, keys, sizes, data = _unpress(b)
            begin = np.cumsum(sizes) - sizes
            lo, hi = np.searchsorted(key, keys), np.searchsorted(key, keys, side="right")
            mine = np.flatnonzero(known & (hi > lo))
            if not len(mine):
                continue
            row = np.repeat(mine, (hi - lo)[mine])
            at = np.concatenate([np.arange(lo[i], hi[i]) for i in mine])
            size = length[at]
            src = np.repeat(begin[row] + start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            found.append((anchor[at], ids[row], keys[row], start[at].astype(np.uint32), size.astype(np.uint32), data[src]))
        if not found:
            return None
        anchor, doc, own, start, size, raw = (np.concatenate(x) for x in zip(*found))
        end, out = np.cumsum(size.astype(np.int64)), []
        group = (B.mix(anchor) % B.U64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        g, cut = np.unique(group[order], return_index=True)
        for q, o in zip(g, np.split(order, cut[1:])):
            held = np.concatenate([raw[end[i] - size[i]:end[i]] for i in o])
            out.append((_DIGITS, int(q), _press(anchor[o], doc[o], own[o], start[o], size[o], held)))
        return _rows(out)
    return work


def _window_groups(window: int, parts: int):
    def work(kind: int, part: int, blobs: list[bytes]) -> list[tuple[int, int, bytes]]:
        anchor, doc, key, start, size, raw = (np.concatenate(x) for x in zip(*[_unpress(b) for b in blobs]))
        size = size.astype(np.int64)
        begin, many = np.cumsum(size) - size, size - window + 1
        run = np.repeat(np.arange(len(size), dtype=np.int32), many)
        inside = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
        code = np.empty(len(run), dtype=B.U64)
        edge = np.cumsum(many) - many
        at = 0
        while at < len(size):  # some runs at a time
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + CHUNK_BYTES)))
            some = slice(edge[at], edge[to] if to < len(size) else len(run))
            own = raw[begin[at]:begin[to] if to < len(size) else len(raw)]
            first = begin[run[some]] - begin[at] + inside[some]
            code[some] = B.pieces(B.Chunk(own, np.array([0, len(own)]), 0).sums(), first, first + window) ^ B.mix(anchor[run[some]])
            at = to
        order, _, later = _later(code, doc[run])
        gone = np.sort(order[later])
        if not len(gone):
            return []
        r, i = run[gone], inside[gone]
        fresh = np.r_[True, (r[1:] != r[:-1]) | (i[1:] != i[:-1] + 1)]
        a = np.flatnonzero(fresh)
        z = np.r_[a[1:], len(gone)] - 1
        return _marks(_MARKS, key[r[a]], start[r[a]].astype(np.int64) + i[a], i[z] - i[a] + window, None, parts)
    return work


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _finish(marks: list[bytes], texts: list[bytes]) -> pa.RecordBatch | None:
    key, start, length = _gather(marks, 3)
    ids_out, sizes_out, spans, kept = [], [], [], []
    for b in texts:
        ids, known, keys, sizes, data = _unpress(b)
        begin = np.cumsum(sizes) - sizes
        lo, hi = np.searchsorted(key, keys), np.searchsorted(key, keys, side="right")
        for i in range(len(ids)):
            ids_out.append(int(ids[i]) if known[i] else None)
            sizes_out.append(int(sizes[i]))
            text = data[begin[i]:begin[i] + sizes[i]]
            if not known[i] or lo[i] == hi[i]:
                spans.append([])
                kept.append(text.tobytes())
                continue
            change = np.zeros(len(text) + 1, dtype=np.int32)
            np.add.at(change, start[lo[i]:hi[i]], 1)
            np.add.at(change, start[lo[i]:hi[i]] + length[lo[i]:hi[i]], -1)
            gone = np.cumsum(change[:-1]) > 0
            edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
            spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
            kept.append(text[~gone].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(ids_out, pa.int64()), pa.array(sizes_out, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary())],
                                      names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed, first and last byte) and kept (the bytes that stay) for every row."""
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    groups, parts = max(8, -(-total // RUN_GROUP_BYTES)), max(8, -(-total // TEXT_GROUP_BYTES))
    first = plain.mapInArrow(_first_pass(window, gram, groups, parts), BLOBS)
    marks = cut_lineage(first.repartition(groups, "kind", "part").sortWithinPartitions("kind", "part").mapInArrow(_grouped(_run_groups(parts)), BLOBS))
    texts = plain.mapInArrow(_pack_texts(parts), BLOBS)

    def met(more: DataFrame) -> DataFrame:
        return more.unionByName(texts).repartition(parts, "part").sortWithinPartitions("part", "kind")
    # an entry of some 14 pressed bytes stands for a run of some 70
    left = marks.where(F.col("kind") == _OPEN).agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    last = max(8, -(-5 * left // RUN_GROUP_BYTES))
    opened = met(marks.where(F.col("kind") == _OPEN)).mapInArrow(_by_part(_cut_runs(last)), BLOBS)
    windows = cut_lineage(opened.repartition(last, "part").sortWithinPartitions("kind", "part").mapInArrow(_grouped(_window_groups(window, parts)), BLOBS))
    return met(marks.where(F.col("kind") == _MARKS).unionByName(windows)).mapInArrow(_by_part(_finish), "doc_id long, n_bytes long, spans array<struct<first:long,last:long>>, kept binary")
