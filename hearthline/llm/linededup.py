"""Line dedup by a segment-partition edit join.

A line is removed if an earlier line (smaller document id, then higher up) is equal or at most `edits` byte edits
away. Lines shorter than `least` bytes are left alone. Equal lines are found by a hash of the whole line. For the
rest, lines of length l are cut into edits + 1 segments; a line within reach holds one of them unchanged, moved by no
more than the edits left and right of it allow. Segments are the index, keyed by length, segment number and content;
each line probes the indexes of its own and of slightly smaller lengths with its substrings. Candidates are verified
by a banded bit-parallel automaton, over many pairs at once.

A key with more than `crowd` lines gives no pairs. Its lines go on to the next level, where lines are cut into
edits + k segments of which k must be unchanged together, so keys are finer; the lines that were crowded before are
the only ones there. On the last level crowded keys are cut into blocks, and each pair of blocks is one unit of work.
No pair within reach is lost at any level, and no task holds a whole crowd.

Line breaks are the only thing that separates lines; text is compared as it is. Null texts stay null. Repeated rows of
one id are one place: they do not remove each other's lines. Lines of documents with a null id count as last. A
document may lose all its lines, its text is then empty. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import bytecode as B

GROUP_BYTES = 16 << 20
_BREAK = np.ones(256, dtype=bool)
_BREAK[10] = False


@dataclass(frozen=True)
class Edits:
    """Parameters of the join."""

    edits: int = 2
    least: int = 20
    crowd: int = 32
    levels: int = 3
    block: int = 256


def _key_plan(edits: int, k: int) -> list[tuple[tuple[int, ...], int, tuple[int, ...]]]:
    """(segments, length difference, shift of each): the index first, then what a line probes.

    The moves between neighbouring matches, and from the last to the end, are insertions or deletions, so their sum is
    at most the number of edits. With one segment, those left of segment i are at most i, those right at most edits - i.
    """
    out = []
    for segments in combinations(range(edits + k), k):
        for less in range(edits + 1):
            for shifts in product(range(-edits, edits + 1), repeat=k):
                path = (0, *shifts, less)
                if sum(abs(b - a) for a, b in zip(path, path[1:])) > edits:
                    continue
                if k == 1 and (abs(shifts[0]) > segments[0] or abs(less - shifts[0]) > edits - segments[0]):
                    continue
                out.append((segments, less, shifts))
    return sorted(out, key=lambda x: (x[1] != 0 or any(x[2]), x))


def line_keys(sums: np.ndarray, start: np.ndarray, length: np.ndarray, edits: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, line numbers, and whether each is an index entry."""
    keys, rows, index = [], [], []
    pieces = edits + k
    for number, (segments, less, shifts) in enumerate(_key_plan(edits, k)):
        own = length - less
        code = B.mix(own.astype(B.U64) * B.U64(64) + B.U64(k))
        fits = own >= pieces
        for s, shift in zip(segments, shifts):
            a, z = own * s // pieces + shift, own * (s + 1) // pieces + shift
            fits &= (a >= 0) & (z <= length)
            code = B.mix(code ^ B.pieces(sums, start + np.where(fits, a, 0), start + np.where(fits, z, 0)) ^ B.U64(s + 1))
        at = np.flatnonzero(fits)
        keys.append(code[at])
        rows.append(at)
        index.append(np.full(len(at), less == 0 and not any(shifts)))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(index)


def _lines(chunk: B.Chunk, least: int) -> tuple[np.ndarray, ...]:
    """Sums, start, length, row, number in the row and hash (even) of every line of at least `least` bytes.

    Line numbers count all lines of a row, empty ones too.
    """
    start, end, first = chunk.words(_BREAK)
    row = B.rows_of(first)
    breaks = np.zeros(len(chunk.data) + 1, dtype=np.int64)
    np.cumsum(chunk.data == 10, out=breaks[1:])
    kept = np.flatnonzero(end - start >= least)
    start, end, row = start[kept], end[kept], row[kept]
    sums = chunk.sums()
    code = B.mix(B.pieces(sums, start, end) ^ (end - start).astype(B.U64)) & ~B.U64(1)
    return sums, start, end - start, row, breaks[start] - breaks[chunk.offsets[row]], code


def _occurrences(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in B.chunks(batch.column(2)):
                _, _, _, row, number, code = _lines(chunk, least)
                at = pa.array(row + chunk.first)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(number.astype(np.int32))],
                                                 names=["line", "row", "doc", "pos"])
    return run


def _line_texts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in B.chunks(batch.column(2)):
                _, start, length, _, _, code = _lines(chunk, least)
                code, at = np.unique(code, return_index=True)
                raw = chunk.data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array([raw[s:s + n] for s, n in zip(start[at], length[at])], pa.binary())], names=["line", "text"])
    return run


def _deal(keys: np.ndarray, lines: np.ndarray, groups: int) -> pa.RecordBatch:
    """One row for each group: keys in order and, beside them, line hashes whose lowest bit marks an index entry."""
    order = np.lexsort((keys, keys % B.U64(groups)))
    keys, lines = keys[order], lines[order]
    part = (keys % B.U64(groups)).astype(np.int64)
    g, cut = np.unique(part, return_index=True)
    rows = list(zip(np.split(keys, cut[1:]), np.split(lines, cut[1:]))) if len(g) else []
    return pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array([k.tobytes() for k, _ in rows], pa.binary()), pa.array([n.tobytes() for _, n in rows], pa.binary())],
                                      names=["part", "keys", "lines"])


def _first_level(plan: Edits, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, keys, lines = np.zeros(0, dtype=B.U64), [], []
            for chunk in B.chunks(batch.column(2)):
                sums, start, length, _, _, code = _lines(chunk, plan.least)
                code, at = np.unique(code, return_index=True)
                new = ~np.isin(code, seen, assume_unique=True)
                code, at = code[new], at[new]
                seen = np.concatenate([seen, code])
                key, row, index = line_keys(sums, start[at], length[at], plan.edits, 1)
                keys.append(key)
                lines.append(code[row] | index.astype(B.U64))
            if keys:
                yield _deal(np.concatenate(keys), np.concatenate(lines), groups)
    return run


def _next_level(plan: Edits, groups: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy().view(B.U64)
            for chunk in B.chunks(batch.column(1)):
                own = ids[chunk.first:chunk.first + chunk.rows]
                key, row, index = line_keys(chunk.sums(), chunk.offsets[:-1], np.diff(chunk.offsets), plan.edits, k)
                yield _deal(key, own[row] | index.astype(B.U64), groups)
    return run


def _match(plan: Edits, last: bool):
    """Within each key: pairs of lines (key 0), or if crowded the lines (with their key), for the level after."""
    def solve(keys: list[bytes], lines: list[bytes]) -> pa.RecordBatch:
        key, line = np.frombuffer(b"".join(keys), dtype=B.U64), np.frombuffer(b"".join(lines), dtype=B.U64)
        order = np.lexsort((line, key))
        key, line = key[order], line[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])]
        key, line = key[new], line[new]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[cut, len(key)])
        indexed = np.add.reduceat((line & B.U64(1)).astype(np.int64), cut)
        useful = (size > 1) & (indexed > 0)
        crowded = useful & (size > plan.crowd)
        few = np.repeat(useful & ~crowded, size)
        after = np.repeat(np.r_[cut[1:], len(key)], size) - np.arange(len(key)) - 1
        i = np.repeat(np.flatnonzero(few), after[few])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after[few]) - after[few], after[few])
        fits = ((line[i] | line[j]) & B.U64(1) == 1) & (line[i] >> B.U64(1) != line[j] >> B.U64(1))
        a, b = line[i[fits]] & ~B.U64(1), line[j[fits]] & ~B.U64(1)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), dtype=B.U64)
        many = np.flatnonzero(np.repeat(crowded, size))
        k, n = key[many] | B.U64(1), line[many]
        left, right = np.concatenate([pair[:, 0], n & ~B.U64(1)]), np.concatenate([pair[:, 1], n & B.U64(1)])
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (np.concatenate([np.zeros(len(pair), dtype=B.U64), k]), left, right)], names=["key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, lines = None, [], []
        for batch in batches:
            for part, key, line in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if part != at:
                    if keys:
                        yield solve(keys, lines)
                    at, keys, lines = part, [], []
                keys.append(key.as_py())
                lines.append(line.as_py())
        if keys:
            yield solve(keys, lines)
    return run


def within(left: list[bytes], right: list[bytes], edits: int) -> np.ndarray:
    """Whether each pair is at most `edits` edits apart.

    For every number of errors e, a word holds one bit for each offset from the diagonal: bit b says that j bytes of
    the right and j + b - edits bytes of the left were used up with e errors. One step takes the next right byte.
    """
    n = len(left)
    if not n:
        return np.zeros(0, dtype=bool)
    a, b = (np.frombuffer(b"".join(x) + b"\0", dtype=np.uint8) for x in (left, right))
    la, lb = (np.array([len(x) for x in y], dtype=np.int64) for y in (left, right))
    sa, sb = np.cumsum(la) - la, np.cumsum(lb) - lb
    width = 2 * edits + 1
    kind = np.uint16
    full = kind((1 << width) - 1)
    out = np.zeros(n, dtype=bool)
    live = np.flatnonzero(np.abs(la - lb) <= edits)
    state = [np.full(len(live), sum(1 << (edits + i) for i in range(e + 1)), dtype=kind) for e in range(edits + 1)]
    j = 0
    while len(live):
        done = lb[live] == j
        if done.any():
            bit = (la[live] - j + edits)[done]
            out[live[done]] = (state[edits][done] >> bit.astype(kind)) & kind(1) == 1
            stay = ~done
            live, state = live[stay], [s[stay] for s in state]
            if not len(live):
                break
        byte = b[sb[live] + j]
        same = np.zeros(len(live), dtype=kind)
        for off in range(width):
            i = j + off - edits
            if i >= 0:
                ok = i < la[live]
                same |= ((a[np.where(ok, sa[live] + i, 0)] == byte) & ok).astype(kind) << kind(off)
        fresh = [state[0] & same]
        for e in range(1, edits + 1):
            fresh.append(((state[e] & same) | state[e - 1] | (state[e - 1] >> kind(1)) | (fresh[e - 1] << kind(1))) & full)
        state, j = fresh, j + 1
        if j % 8 == 0:
            stay = state[edits] != 0
            live, state = live[stay], [s[stay] for s in state]
    return out


def _verify_pairs(edits: int):
    """(a, b, text of a, text of b) to the pairs within reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                own = batch.slice(at, 2000)
                near = within(own.column(2).to_pylist(), own.column(3).to_pylist(), edits)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1)], names=["a", "b"]).filter(pa.array(near))
    return run


def _verify_units(edits: int):
    """Sorted by unit: (unit, side, line, doc, pos, text) to the lines that have an earlier line within reach."""
    def solve(rows: list[tuple]) -> list[int]:
        rows.sort(key=lambda r: (r[3], r[4]))
        text, line, side = [r[5] for r in rows], np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
        # one edit changes the counts of byte classes by at most 2 in all
        counts = np.stack([np.bincount(np.frombuffer(x, dtype=np.uint8) & 63, minlength=64) for x in text]).astype(np.int32) if rows else np.zeros((0, 64), np.int32)
        gone, waiting = np.zeros(len(rows), dtype=bool), []

        def settle() -> None:
            pairs = [(i, j) for i, j in waiting if not gone[j]]
            near = within([text[i] for i, _ in pairs], [text[j] for _, j in pairs], edits)
            gone[np.isin(line, [line[j] for (_, j), k in zip(pairs, near) if k])] = True
            waiting.clear()
        for i in range(len(rows) - 1):  # every line meets the later ones that are still there
            fits = ~gone[i + 1:] & (line[i + 1:] != line[i]) & ((side[i + 1:] == 2) | (side[i + 1:] != side[i]))
            fits &= np.abs(counts[i + 1:] - counts[i]).sum(axis=1) <= 2 * edits
            waiting += [(i, j) for j in (np.flatnonzero(fits) + i + 1).tolist()]
            if len(waiting) >= 2000:
                settle()
        settle()
        return sorted(set(line[gone].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            found = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != at:
                    found += solve(held)
                    at, held = row[0], []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["line"])
        yield pa.RecordBatch.from_arrays([pa.array(solve(held), pa.int64())], names=["line"])
    return run


def near_lines(rows: DataFrame, places: DataFrame, plan: Edits) -> DataFrame:
    """The distinct lines that have an earlier, different line within reach.

    rows: (row, doc, text); places: (line, doc, pos), one row for each distinct line, its first place.
    """
    groups = max(8, -(-(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // GROUP_BYTES))
    shape = "part int, keys binary, lines binary"
    dealt = rows.mapInArrow(_first_level(plan, groups), shape)
    gone = []
    for level in range(1, plan.levels + 1):
        last = level == plan.levels
        found = cut_lineage(dealt.repartition(groups, "part").sortWithinPartitions("part").mapInArrow(_match(plan, last), "key long, a long, b long"))
        pairs = found.where("key = 0").select("a", "b").distinct()
        crowded = found.where("key <> 0").select("key", F.col("a").alias("line"))
        needed = pairs.select(F.col("a").alias("line")).unionAll(pairs.select(F.col("b").alias("line"))).unionAll(crowded.select("line")).distinct()
        texts = cut_lineage(rows.mapInArrow(_line_texts(plan.least), "line long, text binary").join(needed, "line", "left_semi")
                            .dropDuplicates(["line"]).join(places, "line")) if level == 1 else texts
        met = (pairs.join(texts.select(F.col("line").alias("a"), F.col("text").alias("ta")), "a")
               .join(texts.select(F.col("line").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb"))
        near = met.mapInArrow(_verify_pairs(plan.edits), "a long, b long")
        order = [texts.select(F.col("line").alias(x), F.struct("doc", "pos", "line").alias(f"o{x}")) for x in "ab"]
        gone.append(near.join(order[0], "a").join(order[1], "b").select(F.when(F.col("oa") > F.col("ob"), F.col("a")).otherwise(F.col("b")).alias("line")))
        if last or crowded.isEmpty():
            break
        dealt = texts.join(crowded.select("line").distinct(), "line", "left_semi").select("line", "text").mapInArrow(_next_level(plan, groups, level + 1), shape)
    if last:
        size = crowded.groupBy("key").agg(F.ceil(F.count_distinct("line") / plan.block).cast("int").alias("of"))
        placed = crowded.distinct().join(size, "key").withColumn("own", F.pmod(F.xxhash64("line"), F.col("of")).cast("int"))
        units = placed.select("key", "line", "own", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("with"))
        units = units.select(F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with")).alias("unit"), "line",
                             F.when(F.col("own") == F.col("with"), 2).otherwise((F.col("own") > F.col("with")).cast("int")).alias("side"))
        work = units.join(texts, "line").select("unit", "side", "line", "doc", "pos", "text").repartition("unit").sortWithinPartitions("unit")
        gone.append(work.mapInArrow(_verify_units(plan.edits), "line long"))
    out = gone[0]
    for g in gone[1:]:
        out = out.unionAll(g)
    return cut_lineage(out.distinct())


def _rewrite(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cuts = batch.schema.get_field_index(text), batch.column(batch.schema.get_field_index("removed_lines")).to_pylist()
            new = []
            for value, gone in zip(batch.column(at), cuts):
                value = value.as_py()
                if value is not None and gone:
                    out = set(gone)
                    value = "\n".join(x for i, x in enumerate(value.split("\n")) if i not in out)
                new.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)
    return run


def dedup_lines(docs: DataFrame, plan: Edits = Edits(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with shorter texts, and `removed_lines`, the numbers (from 0) of the lines that went, in order.

    Columns of docs may bear any name; one named removed_lines is replaced.
    """
    names = [c for c in docs.columns if c != "removed_lines"]
    plain = docs.select(*names).toDF(*[f"c{i}" for i in range(len(names))])
    k, t = f"c{names.index(key)}", f"c{names.index(text)}"
    last = F.lit((1 << 63) - 1)
    rows = plain.select(F.xxhash64(k, t).alias("row"), F.coalesce(F.col(k).cast("long"), last).alias("doc"), F.coalesce(F.col(t), F.lit("")).alias("text"))
    found = cut_lineage(rows.mapInArrow(_occurrences(plan.least), "line long, row long, doc long, pos int"))
    places = cut_lineage(found.groupBy("line").agg(F.min(F.struct("doc", "pos")).alias("p")).select("line", "p.doc", "p.pos"))
    gone = near_lines(rows, places, plan)
    judged = places.join(gone.withColumn("near", F.lit(True)), "line", "left").select("line", F.col("doc").alias("fd"), F.col("pos").alias("fp"), "near")
    out = found.join(judged, "line").where(F.col("near").isNotNull() | (F.col("doc") != F.col("fd")) | (F.col("pos") != F.col("fp")))
    marks = out.select("row", "pos").distinct().groupBy("row").agg(F.array_sort(F.collect_list("pos")).alias("removed_lines"))  # the lines of one row
    joined = (plain.withColumn("row", F.xxhash64(k, t)).join(marks, "row", "left").drop("row")
              .withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>"))))
    schema = T.StructType(joined.schema.fields)
    return joined.mapInArrow(_rewrite(t), schema).toDF(*names, "removed_lines")
