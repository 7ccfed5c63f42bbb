"""Near-duplicate embeddings by counting collisions on one-dimensional projections.

Unit vectors are projected on `lines` random orthonormal directions. Two vectors whose cosine is `least` differ on a
line by about sigma = sqrt(2 - 2 least) / sqrt(d). A query's window on a line reaches `window` sigma to both sides;
two vectors collide where each is inside the other's window. A pair at the threshold collides on a known share of the
lines, so the needed count is calibrated: the largest count that such a pair reaches with probability 1 - 1e-7. Pairs
that reach it are verified in double precision.

So that not all pairs are counted, each of `bands` chooses `per_band` lines, each line's order is cut into cells of
`cell` sigma with a random offset, and only vectors that share the cells of all lines of a band are compared there. A
pair at the threshold shares a band's cells with probability about (1 - 0.8 / cell) ^ per_band and misses all bands
with probability below 0.004 at the defaults, closer pairs much less. A pair is counted in its first common band
only, so links are neither repeated nor shuffled as pairs: each task returns, for each vector, its number of links
and one edge of a spanning forest.

Equal vectors are collapsed beforehand and count with their number. Cells with more than `block` vectors are cut into
blocks, and every pair of blocks is one unit of work, so no task holds a whole hot cell and no pair is left out.

Vectors of each length are compared among themselves, one length after the other: those of different lengths have no
cosine. Vectors that are null, zero, or hold null or non-finite components link with nothing, as do rows with a null id (whose component is null, and which are kept). Repeated ids are one node. An empty table gives
an empty result. The result has its own four columns; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import bytecode as B
from .graph import components

PAIRS_AT_ONCE = 40_000


@dataclass(frozen=True)
class Plan:
    """Parameters of the search; see the text above."""

    least: float = 0.95
    lines: int = 64
    window: float = 1.645
    bands: int = 24
    per_band: int = 9
    cell: float = 5.0
    block: int = 512
    seed: int = 11


class Lines:
    """The projections of a plan for vectors of d components; the same in every task."""

    def __init__(self, plan: Plan, d: int):
        rng = np.random.default_rng(plan.seed)
        parts, have = [], 0
        while have < plan.lines:
            q, _ = np.linalg.qr(rng.standard_normal((d, d)))
            parts.append(q[:, :plan.lines - have])
            have += parts[-1].shape[1]
        self.plan, self.directions = plan, np.concatenate(parts, axis=1)
        self.sigma = np.sqrt(max(2 - 2 * plan.least, 1e-12)) / np.sqrt(d)
        self.chosen = np.stack([rng.permutation(plan.lines)[:min(plan.per_band, plan.lines)] for _ in range(plan.bands)])
        self.offsets = rng.random(self.chosen.shape)
        self.reach = plan.window * self.sigma
        p = erf(plan.window / sqrt(2))  # of a collision on one line
        miss, need = 0.0, 0
        while miss + comb(plan.lines, need) * p ** need * (1 - p) ** (plan.lines - need) < 1e-7:
            miss += comb(plan.lines, need) * p ** need * (1 - p) ** (plan.lines - need)
            need += 1
        self.need = need

    def places(self, units: np.ndarray) -> np.ndarray:
        return units @ self.directions

    def keys(self, places: np.ndarray) -> np.ndarray:
        """A key of each band for each vector."""
        out = np.empty((len(places), len(self.chosen)), dtype=np.int64)
        for b, (own, shift) in enumerate(zip(self.chosen, self.offsets)):
            cells = np.floor(places[:, own] / (self.plan.cell * self.sigma) + shift).astype(np.int64).view(B.U64)
            code = np.full(len(places), b + 1, dtype=B.U64)
            for i in range(cells.shape[1]):
                code = B.mix(code * B.U64(31) + cells[:, i])
            out[:, b] = code.view(np.int64)
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype=np.float64) for x in column.to_pylist()]) if len(column) else np.zeros((0, 1))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.column(1).to_pylist():
            v = None if x is None or None in x or not x else np.asarray(x, dtype=np.float64) + 0.0
            norm = 0.0 if v is None else np.abs(v).max()
            out.append(None if v is None or not np.isfinite(norm) or norm == 0 else v.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "v"])


def _units(column: pa.Array) -> np.ndarray:
    v = _vectors(column)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _keys(plan: Plan, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines(plan, d)
        for batch in batches:
            keys = lines.keys(lines.places(_units(batch.column(2))))
            first = np.arange(len(keys) + 1) * keys.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, B.lists(keys.ravel(), first, pa.int64())], names=[*batch.schema.names, "keys"])
    return run


def _compare(plan: Plan, d: int):
    """Rows come sorted by unit of work; one that goes on in the next batch is held back."""
    names = ["rep", "links", "root"]

    def solve(rows: pa.Table, lines: Lines) -> pa.RecordBatch | None:
        unit, side = rows["unit"].to_numpy(), rows["side"].to_numpy()
        band, rep, n = rows["band"].to_numpy(), rows["rep"].to_numpy(), rows["n"].to_numpy()
        cut = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        size = np.diff(np.r_[cut, len(unit)])
        if not (size > 1).any():
            return None
        kept = np.repeat(size > 1, size)
        unit, side, band, rep, n = unit[kept], side[kept], band[kept], rep[kept], n[kept]
        units = _units(rows["v"].combine_chunks().filter(pa.array(kept)))
        places = lines.places(units)
        keys = lines.keys(places)
        size = size[size > 1]
        cut = np.r_[0, np.cumsum(size)]
        left = np.arange(len(unit))
        many = np.repeat(cut[1:], size) - left - 1  # each row meets the rows after it in its unit
        links, root = np.zeros(len(unit), dtype=np.int64), np.arange(len(unit))
        at, upto, joined = 0, np.r_[0, np.cumsum(many)], []
        while at < len(unit):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS_AT_ONCE, side="right")) - 1)
            i = np.repeat(left[at:to], many[at:to])
            j = i + 1 + np.arange(len(i)) - np.repeat(upto[at:to] - upto[at], many[at:to])
            at = to
            fits = (side[i] == 2) | (side[i] != side[j])  # inside one block, or across two
            i, j = i[fits], j[fits]
            own = np.argmax(keys[i] == keys[j], axis=1) == band[i]
            i, j = i[own], j[own]
            near = np.count_nonzero(np.abs(places[i] - places[j]) <= lines.reach, axis=1) >= lines.need
            i, j = i[near], j[near]
            close = np.einsum("ij,ij->i", units[i], units[j]) >= plan.least
            i, j = i[close], j[close]
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            joined.append(np.stack([i, j]))
        pairs = np.concatenate(joined, axis=1)
        while True:  # the smallest row of each linked part
            before = root.copy()
            low = np.minimum(root[pairs[0]], root[pairs[1]])
            np.minimum.at(root, pairs[0], low)
            np.minimum.at(root, pairs[1], low)
            root = root[root]
            if np.array_equal(root, before):
                break
        own = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(links[own]), pa.array(rep[root[own]])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, held = Lines(plan, d), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            unit = rows["unit"].to_numpy()
            whole = int(np.searchsorted(unit, unit[-1]))
            held = rows.slice(whole)
            if whole:
                out = solve(rows.slice(0, whole), lines)
                if out is not None:
                    yield out
        if held is not None:
            out = solve(held, lines)
            if out is not None:
                yield out
    return run


def _found(classes: DataFrame, plan: Plan, d: int) -> DataFrame:
    """(rep, links, root) of the linked ones among classes of vectors of length d."""
    keyed = (classes.mapInArrow(_keys(plan, d), "rep long, n long, v binary, keys array<long>")
             .select("rep", "n", "v", F.posexplode("keys").alias("band", "cell")))
    full = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1")
    blocks = F.ceil(F.col("_size") / plan.block).cast("int")
    placed = keyed.join(full, "cell").withColumn("_of", blocks).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_of")).cast("int"))
    # a row of block b works in every unit {b, c}; side 2 marks the unit of the block alone
    work = placed.select("rep", "n", "v", "band", "cell", "_own", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)).alias("_with"))
    unit = F.xxhash64("cell", F.least("_own", "_with"), F.greatest("_own", "_with"))
    side = F.when(F.col("_own") == F.col("_with"), 2).otherwise((F.col("_own") > F.col("_with")).cast("int"))
    work = work.select(unit.alias("unit"), side.alias("side"), "band", "rep", "n", "v").repartition("unit").sortWithinPartitions("unit")
    return cut_lineage(work.mapInArrow(_compare(plan, d), "rep long, links long, root long"))


def link(vectors: DataFrame, plan: Plan = Plan(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_pack, "id long, v binary")
    rows = cut_lineage(rows)
    valid = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull())
    classes = cut_lineage(valid.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).select("rep", "n", "v"))
    # only vectors of one length have a cosine; one row for each length
    lengths = [r["b"] // 8 for r in classes.groupBy(F.octet_length("v").alias("b")).count().where("count > 1").orderBy("b").collect()]
    found = None
    for d in lengths or [1]:
        own = _found(classes.where(F.octet_length("v") == 8 * d), plan, d)
        found = own if found is None else found.unionByName(own)
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found, "rep", "root")
    by_class = (classes.join(totals, "rep", "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
                .select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    joined = rows.join(by_class.select("v", "n_links", "component_id"), "v", "left")
    known = F.col("id").isNotNull()
    component = F.when(known, F.coalesce("component_id", "id"))
    return joined.select(F.col("id").alias("vec_id"), F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                         component.alias("component_id"), (~known | (F.col("id") == component)).alias("kept"))
