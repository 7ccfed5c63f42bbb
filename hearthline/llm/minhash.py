"""Near-duplicate documents with an LSH forest over MinHash signatures.

A document's set is its distinct shingles of `shingle` words (its whole word sequence if it has fewer). Documents of
equal sets are collapsed into one class. Signatures stand in several sorted orders; a region is a stretch of an order
that agrees on its first values, so what it holds are the neighbours of longest common prefix. Depth follows how full a
region is:

* `trees` orders of separate values start at `depth` values. A region with at most `region` classes gives all its pairs
  as candidates; a fuller one first gives each class's pair with the region's pivot, the class closest to the region's
  consensus, the most frequent value at each place of the signature. Candidates are verified, components found;
* classes of full regions go on into `orders` more orders, each a permutation of all values, from `depth` + 1 values on.
  A region that holds one component only is done. A full one goes a value deeper, as far as `deepest`: the depth at
  which a pair at the threshold shares a region in none of the orders with probability below 0.0001. Here classes outside the region's most frequent component meet all others in another component than they. Both sides are
  cut into blocks of at most about `block` classes and `load` shingles, each pair of blocks is one unit of work. A unit
  compares signatures: pairs that agree on fewer values than a pair at the threshold does with probability 1 - 1e-7 are
  left out. Classes that have a pair left get their texts, and the unit returns verified edges of a spanning forest.

Candidates are pairs of ids; each is verified on the two full sets. No pair list of a large region is ever made, and no
region's rows are collected: regions are counted with map-side combining, and consensus is taken from a sample of a
region (that only names the pivot; every class meets it). Comparisons are quadratic only in regions that are still full
at the last depth and hold several components there.

With 16 trees of depth 4 a pair of similarity 0.85 misses every region it could share with probability
(1 - 0.85^4)^16, below 0.00001; where all its regions are full to the last depth, with the probability named above.

Null and empty texts have no shingles and link with nothing. Rows with a null id link with nothing, have a null
component and are kept. Rows with one id are one document for linking. Columns that the operator adds replace columns
of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import bytecode as B
from .graph import components

PAIRS_AT_ONCE = 20_000


@dataclass(frozen=True)
class Forest:
    """Parameters; similarity is percent: 100 * intersection >= percent * union links."""

    percent: int = 85
    shingle: int = 5
    trees: int = 16
    depth: int = 4
    region: int = 32
    sample: int = 256
    block: int = 256
    load: int = 1 << 20
    orders: int = 64

    @property
    def values(self) -> int:
        return self.trees * self.depth

    @property
    def need(self) -> int:
        """Equal values of two signatures that a pair at the threshold has with probability 1 - 1e-7."""
        p, miss, need = self.percent / 100, 0.0, 0
        while miss + comb(self.values, need) * p ** need * (1 - p) ** (self.values - need) < 1e-7:
            miss += comb(self.values, need) * p ** need * (1 - p) ** (self.values - need)
            need += 1
        return need

    @property
    def deepest(self) -> int:
        """Largest depth at which a pair at the threshold misses all orders with probability below 0.0001."""
        p, v, d = self.percent / 100, self.values, self.depth + 1

        def miss(depth: int) -> float:  # over the number of equal values; orders share their values, so they are no independent tries
            return sum(comb(v, a) * p ** a * (1 - p) ** (v - a) * (1 - comb(a, depth) / comb(v, depth)) ** self.orders for a in range(v + 1))
        while d < v and miss(d + 1) < 1e-4:
            d += 1
        return d

    def permutations(self) -> np.ndarray:
        rng = np.random.default_rng(5)
        return np.stack([rng.permutation(self.values) for _ in range(self.orders)])

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        n = np.arange(1, self.values + 1, dtype=B.U64)
        return B.mix(n) | B.U64(1), B.mix(n + B.U64(1 << 32))


def shingle_sets(chunk: B.Chunk, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted in the row, and the number of each row's first."""
    low = chunk.lower()
    starts, ends, first = low.words(B.SPACED)
    codes = B.pieces(low.sums(), starts, ends)
    full = B.sequences(codes, shingle)
    fits = B.inside_row(first, shingle, len(codes))
    row = [B.rows_of(first)[:len(full)][fits]]
    value = [full[fits]]
    for n in range(1, shingle):  # rows of fewer words
        short = np.flatnonzero(np.diff(first) == n)
        if len(short):
            at = first[short]
            value.append(B.sequences(codes[(at[:, None] + np.arange(n)).ravel()], n)[::n])
            row.append(short)
    row, value = np.concatenate(row), np.concatenate(value)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return value, np.searchsorted(row, np.arange(chunk.rows + 1))


def _sign(forest: Forest, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, plus = forest.seeds()
        for batch in batches:
            counts, one, two, signs = [], [], [], []
            for chunk in B.chunks(batch.column(batch.schema.get_field_index(text))):
                value, first = shingle_sets(chunk, forest.shingle)
                n = np.diff(first)
                some = np.flatnonzero(n)
                sign = np.zeros((chunk.rows, forest.values), dtype=np.uint32)
                sums = np.zeros((2, chunk.rows), dtype=B.U64)
                if len(some):
                    at = first[some]
                    for i in range(forest.values):
                        mixed = (value * times[i] + plus[i]) >> B.U64(32)
                        sign[some, i] = np.minimum.reduceat(mixed, at)
                    sums[0, some] = np.add.reduceat(B.mix(value), at)
                    sums[1, some] = np.add.reduceat(B.mix(value ^ B.U64(0xA5A5A5A5A5A5A5A5)), at)
                counts.append(n)
                one.append(sums[0].view(np.int64))
                two.append(sums[1].view(np.int64))
                signs += [s.tobytes() if k else None for s, k in zip(sign, n)]
            kept = [i for i, c in enumerate(batch.schema.names) if c != text]
            arrays = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (counts, one, two)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *[pa.array(x, pa.int64()) for x in arrays], pa.array(signs, pa.binary())],
                                             names=[*[batch.schema.names[i] for i in kept], "n", "print1", "print2", "sign"])
    return run


def _prefixes(forest: Forest):
    """Keys of the regions of each class, one for each tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = batch.column(batch.schema.get_field_index("sign")).to_pylist()
            table = np.frombuffer(b"".join(signs), dtype=np.uint32).reshape(len(signs), forest.values).astype(B.U64)
            keys = np.empty((len(signs), forest.trees), dtype=B.U64)
            for t in range(forest.trees):
                code = np.full(len(signs), t + 1, dtype=B.U64)
                for i in range(forest.depth):
                    code = B.mix(code * B.U64(33) + table[:, t * forest.depth + i])
                keys[:, t] = code
            first = np.arange(len(signs) + 1) * forest.trees
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), B.lists(keys.ravel().view(np.int64), first, pa.int64())], names=["rep", "n", "keys"])
    return run


def _orders(forest: Forest):
    """For each class and order a row with the keys of its prefixes, from the first further depth to the last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, levels = forest.permutations(), forest.deepest - forest.depth
        for batch in batches:
            signs = batch.column(3).to_pylist()
            table = np.frombuffer(b"".join(signs), dtype=np.uint32).reshape(len(signs), forest.values).astype(B.U64)
            keys = np.empty((len(signs), forest.orders, levels), dtype=B.U64)
            for t in range(forest.orders):
                code = np.full(len(signs), t + 1, dtype=B.U64)
                for i in range(forest.deepest):
                    code = B.mix(code * B.U64(33) + table[:, places[t, i]])
                    if i >= forest.depth:
                        keys[:, t, i - forest.depth] = code
            same = np.repeat(np.arange(len(signs)), forest.orders)
            first = np.arange(len(same) + 1) * levels
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(same)) for i in range(3)], B.lists(keys.ravel().view(np.int64), first, pa.int64())],
                                             names=["rep", "n", "comp", "keys"])
    return run


def _consensus(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for signs in batch.column(1).to_pylist():
                table = np.stack([np.frombuffer(s, dtype=np.uint32) for s in signs])
                modes = np.empty(forest.values, dtype=np.uint32)
                for i in range(forest.values):
                    value, count = np.unique(table[:, i], return_counts=True)
                    modes[i] = value[np.argmax(count)]
                out.append(modes.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["region", "modes"])
    return run


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        two = [np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1) for i in (2, 3)] if batch.num_rows else [np.zeros((0, 1))] * 2
        same = (two[0] == two[1]).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int64())], names=["region", "rep", "same"])


def _pairs_of(members):
    """All pairs of a short array of (rep, n), smaller rep first."""
    at = F.transform(members, lambda x, i: F.transform(F.slice(members, i + 2, F.size(members)), lambda y: F.struct(x.rep.alias("a"), y.rep.alias("b"), x.n.alias("na"), y.n.alias("nb"))))
    return F.flatten(at)


def candidates(classes: DataFrame, forest: Forest) -> tuple[DataFrame, DataFrame | None]:
    """From (rep, n, sign): distinct pairs (a, b), a < b, of class representatives, and (rep, n) of the classes in full regions."""
    rows = (classes.select("rep", "n", "sign").mapInArrow(_prefixes(forest), "rep long, n long, keys array<long>")
            .select("rep", "n", F.explode("keys").alias("region")))
    counts = rows.groupBy("region").agg(F.count(F.lit(1)).alias("full")).where("full > 1")
    rows = cut_lineage(rows.join(counts, "region"))
    small = rows.where(F.col("full") <= forest.region).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("rep", "n"))).alias("members"))
    pairs = small.select(F.explode(_pairs_of(F.col("members"))).alias("p")).select("p.*")
    large, met = rows.where(F.col("full") > forest.region), None
    if not large.isEmpty():
        signed = large.join(classes.select("rep", "sign"), "rep")
        part = F.pmod(F.xxhash64("rep", "region"), F.col("full")) < forest.sample
        modes = (signed.where(part).groupBy("region").agg(F.collect_list("sign").alias("signs"))  # about `sample` members of each
                 .mapInArrow(_consensus(forest), "region long, modes binary"))
        same = signed.select("region", "rep", "sign").join(modes, "region").mapInArrow(_agreement, "region long, rep long, same long")
        pivots = cut_lineage(same.groupBy("region").agg(F.min_by("rep", F.struct(-F.col("same"), "rep")).alias("pivot")))
        named = pivots.join(classes.select(F.col("rep").alias("pivot"), F.col("n").alias("pn")), "pivot")
        meeting = cut_lineage(large.join(named, "region").select("rep", "n", "pivot", "pn"))
        met = meeting.select("rep", "n").distinct()
        first = F.col("rep") < F.col("pivot")
        pairs = pairs.unionByName(meeting.where(F.col("rep") != F.col("pivot")).select(
            F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"), F.when(first, F.col("n")).otherwise(F.col("pn")).alias("na"),
            F.when(first, F.col("pn")).otherwise(F.col("n")).alias("nb")))
    # sizes alone rule out many pairs: the intersection is at most the smaller set, the union at least the larger
    sized = pairs.where(100 * F.least("na", "nb") >= forest.percent * F.greatest("na", "nb"))
    return cut_lineage(sized.select("a", "b").distinct()), met


def _near_in_unit(forest: Forest, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a unit's rows, in order, that are in two components and whose signatures may be similar enough."""
    side, n, comp = (rows[c].to_numpy() for c in ("side", "n", "comp"))
    table = np.frombuffer(b"".join(rows["sign"].to_pylist()), dtype=np.uint32).reshape(len(side), forest.values)
    at, left = 0, []
    while at < len(side):
        to = min(len(side), at + max(1, PAIRS_AT_ONCE // len(side)))
        i, j = np.nonzero(np.arange(at, to)[:, None] < np.arange(len(side))[None, :])
        i, at = i + at, to
        fits = ((side[i] == 2) | (side[i] != side[j])) & (comp[i] != comp[j])  # inside one block, or across two
        fits &= 100 * np.minimum(n[i], n[j]) >= forest.percent * np.maximum(n[i], n[j])
        i, j = i[fits], j[fits]
        near = (table[i] == table[j]).sum(axis=1) >= forest.need
        left.append(np.stack([i[near], j[near]]))
    i, j = np.concatenate(left, axis=1)
    return i, j


def _hopeful(forest: Forest):
    """The rows of a unit that have a pair left."""
    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j = _near_in_unit(forest, rows)
        if len(i):
            yield from rows.take(pa.array(np.union1d(i, j))).combine_chunks().to_batches()
    return solve


def _spanning(forest: Forest):
    """Edges between components that join all which the unit's verified pairs join."""
    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        i, j = _near_in_unit(forest, rows)
        comp = rows["comp"].to_numpy()
        _, root = np.unique(comp, return_inverse=True)
        sets = []
        for text in rows["text"].chunks:
            for chunk in B.chunks(text):
                value, first = shingle_sets(chunk, forest.shingle)
                sets += [value[first[r]:first[r + 1]] for r in range(chunk.rows)]
        edges, cut = [], np.r_[np.flatnonzero(np.r_[True, i[1:] != i[:-1]]), len(i)] if len(i) else [0]
        for a, z in zip(cut[:-1], cut[1:]):  # the pairs of one row
            x, other = i[a], j[a:z]
            other = other[root[other] != root[x]]
            if not len(other):
                continue
            size = np.array([len(sets[y]) for y in other])
            value = np.concatenate([sets[y] for y in other])
            place = np.minimum(np.searchsorted(sets[x], value), len(sets[x]) - 1)
            both = np.add.reduceat((sets[x][place] == value).astype(np.int64), np.cumsum(size) - size)
            for y in other[100 * both >= forest.percent * (len(sets[x]) + size - both)]:
                if root[y] != root[x]:
                    edges.append((comp[x], comp[y]))
                    root[root == root[y]] = root[x]
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return solve


def _by_unit(solve):
    """Rows come sorted by unit of work; one that goes on in the next batch is held back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            rows = new if held is None else pa.concat_tables([held, new])
            unit = rows["unit"].to_numpy()
            cut = np.r_[0, np.flatnonzero(unit[1:] != unit[:-1]) + 1]
            for a, z in zip(cut[:-1], cut[1:]):
                if z - a > 1:
                    yield from solve(rows.slice(a, z - a))
            held = rows.slice(cut[-1])
        if held is not None and held.num_rows > 1:
            yield from solve(held)
    return run


def deepened(members: DataFrame, forest: Forest) -> DataFrame:
    """(region, rep, n, comp, out, k, m) of the regions in which classes (rep, n, comp, sign) are compared.

    out: not in the region's main component; k and m: how many blocks the classes outside it and those inside are cut into.
    Regions are told full or done from counts by prefix and component; a class meets a region's row only where it is compared.
    """
    rows = cut_lineage(members.select("rep", "n", "comp", "sign").mapInArrow(_orders(forest), "rep long, n long, comp long, keys array<long>"))
    shares = cut_lineage(rows.groupBy("keys", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("load")))
    levels, found, above = forest.deepest - forest.depth, [], None

    def blocks(classes, load):
        return F.ceil(F.greatest(classes / forest.block, load / forest.load)).cast("int")
    for level in range(levels):
        own = shares.groupBy(F.col("keys")[level].alias("region"), "comp").agg(
            F.sum("k").alias("k"), F.sum("load").alias("load"), F.min(F.col("keys")[max(level - 1, 0)]).alias("parent"))
        sizes = own.groupBy("region").agg(
            F.sum("k").alias("full"), F.sum("load").alias("load"), F.max_by(F.struct("comp", "k", "load"), F.struct("k", "comp")).alias("main"),
            F.count(F.lit(1)).alias("comps"), F.min("parent").alias("parent")).where("comps > 1")
        if above is not None:
            sizes = sizes.join(above, "parent", "left_semi")
        sizes = cut_lineage(sizes)
        full = F.col("full") > (forest.region if level + 1 < levels else 1 << 62)
        cuts = sizes.where(~full).select("region", F.col("main.comp").alias("main"), blocks(F.col("full") - F.col("main.k"), F.col("load") - F.col("main.load")).alias("k"),
                                         blocks(F.col("main.k"), F.col("main.load")).alias("m"))
        met = rows.select(F.col("keys")[level].alias("region"), "rep", "n", "comp").join(cuts, "region")
        found.append(met.select("region", "rep", "n", "comp", (F.col("comp") != F.col("main")).alias("out"), "k", "m"))
        above = sizes.where(full).select(F.col("region").alias("parent"))
        if level + 1 < levels and above.isEmpty():
            break
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def settled(met: DataFrame, classes: DataFrame, parts: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """Edges (a, b) between components (of `parts`) that the pairs of full regions join; docs has (id, text)."""
    own = parts.select(F.col("node").alias("rep"), "component")
    members = met.join(own, "rep", "left").join(classes.select("rep", "sign"), "rep").withColumn("comp", F.coalesce("component", "rep"))
    # a class is in at most one region of each order, so it meets its signature once with the list of them
    held = deepened(members, forest).groupBy("rep").agg(F.collect_list(F.struct("region", "n", "comp", "out", "k", "m")).alias("at"))
    placed = held.join(classes.select("rep", "sign"), "rep").select("rep", "sign", F.explode("at").alias("p")).select("rep", "sign", "p.*")
    # blocks 0 to k - 1 are outside the main component and meet all; the m others meet those
    mine = F.when(F.col("out"), F.pmod(F.xxhash64("rep"), F.col("k"))).otherwise(F.col("k") + F.pmod(F.xxhash64("rep"), F.col("m"))).cast("int")
    last = F.when(F.col("out"), F.col("k") + F.col("m") - 1).otherwise(F.col("k") - 1)
    work = placed.withColumn("own", mine).select("region", "rep", "n", "comp", "sign", "own", F.explode(F.sequence(F.lit(0), last)).alias("with"))
    unit = F.xxhash64("region", F.least("own", "with"), F.greatest("own", "with"))
    side = F.when(F.col("own") == F.col("with"), 2).otherwise((F.col("own") > F.col("with")).cast("int"))
    work = work.select(unit.alias("unit"), side.alias("side"), "rep", "n", "comp", "sign")
    shape = ["unit", "side", "rep", "n", "comp", "sign"]
    hopeful = cut_lineage(work.select(*shape).repartition("unit").sortWithinPartitions("unit").mapInArrow(
        _by_unit(_hopeful(forest)), "unit long, side int, rep long, n long, comp long, sign binary"))
    needed = hopeful.select(F.col("rep").alias("id")).distinct()
    texts = docs.join(needed.hint("merge"), "id", "left_semi").dropDuplicates(["id", "text"]).select(F.col("id").alias("rep"), "text")
    return cut_lineage(hopeful.join(texts, "rep").select(*shape, "text").repartition("unit").sortWithinPartitions("unit")
                       .mapInArrow(_by_unit(_spanning(forest)), "a long, b long").distinct())


def _verify(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for at in range(0, batch.num_rows, 64):
                own = batch.slice(at, 64)
                sets = []
                for i in (2, 3):
                    mine = []
                    for chunk in B.chunks(own.column(i)):
                        value, first = shingle_sets(chunk, forest.shingle)
                        mine += [value[first[r]:first[r + 1]] for r in range(chunk.rows)]
                    sets.append(mine)
                for x, y in zip(*sets):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(both > 0 and 100 * both >= forest.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))
    return run


def verified(pairs: DataFrame, docs: DataFrame, forest: Forest) -> DataFrame:
    """The pairs whose full sets are similar enough; docs has (id, text). Texts travel as texts, not as sets."""
    needed = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    # the ids grow with the documents, so this join is a merge at every size
    texts = cut_lineage(docs.select("id", "text").join(needed.hint("merge"), "id", "left_semi").dropDuplicates(["id", "text"]))
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return with_b.select("a", "b", "ta", "tb").mapInArrow(_verify(forest), "a long, b long")


def link(docs: DataFrame, forest: Forest = Forest(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = cut_lineage(plain.mapInArrow(_sign(forest, "text"), "id long, n long, print1 long, print2 long, sign binary"))
    some = signed.where("n > 0 AND id IS NOT NULL")
    groups = cut_lineage(some.groupBy("print1", "print2", "n").agg(F.min("id").alias("rep")))
    classes = cut_lineage(some.join(groups, ["print1", "print2", "n"]).where("id = rep").select("rep", "n", "sign").dropDuplicates(["rep", "sign"]))
    pairs, met = candidates(classes, forest)
    links = cut_lineage(verified(pairs, plain, forest).distinct())
    # rows of one id are one node even where their texts differ
    same = some.join(groups, ["print1", "print2", "n"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    repeated = some.groupBy("id").agg(F.count_distinct("print1", "print2", "n").alias("k")).where("k > 1").select(F.col("id").alias("a"))
    tied = same.join(repeated, "a", "left_semi")
    parts = components(links.unionByName(tied), "a", "b")
    if met is not None:
        more = settled(met, classes, parts, plain, forest)
        if not more.isEmpty():
            joined = components(more, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("whole"))
            inside = parts.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
            alone = joined.select(F.col("component").alias("node"), F.col("whole").alias("component")).join(parts.select("node"), "node", "left_anti")
            parts = cut_lineage(inside.unionByName(alone))
    by_class = groups.join(parts, groups.rep == parts.node, "left").select("print1", "print2", "n", F.coalesce("component", "rep").alias("component"))
    out = signed.select("id", "n", "print1", "print2").join(by_class, ["print1", "print2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
