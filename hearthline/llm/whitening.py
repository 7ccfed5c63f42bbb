"""Embedding whitening with an exact covariance: integer scatter, its characteristic polynomial, components, projection.

Entries become integers x = floor(scale * c) + shift. Tasks sum products of a block of vectors exactly, Spark adds the parts
up by matrix cell, and n * (sum of x x') - S S' is the covariance times n^2 in integers. Its characteristic polynomial is
found modulo primes, a batch of primes for each task; the roots come from integer bisection, the components from inverse
iteration, one task for each root (see `polynomial.py`). Rows are then projected where they are: nothing of the vectors is
shuffled or collected; what passes the driver is bounded by the square of the dimension. `identity_error` is measured on the
projected rows.

A vector that is null, empty, or holds a null, non-finite or overlong entry (scaled beyond 2^50) is dropped. Vectors of
each length are fitted among themselves. Repeated rows count as often as they occur, null ids are kept. Components of
variance zero have no whitened values and are left out, so equal vectors, a single one or an empty table give no rows.
The result has its own columns only, whatever else the table holds.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import polynomial

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LONGEST = 2.0 ** 50


def prepared(table: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """Usable rows as (id, y): y holds floor(scale * entry) as longs. The shift moves no covariance and no deviation."""
    scaled = F.transform(F.col(f"`{vector}`"), lambda c: c.cast("double") * F.lit(float(scale)))
    fine = F.forall("v", lambda c: F.coalesce(F.abs(c) < LONGEST, F.lit(False)))  # false for NaN, which sorts last, too
    rows = table.select(F.col(f"`{key}`").alias("id"), scaled.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    return rows.select("id", F.transform("v", lambda c: F.floor(c)).alias("y"))


def _block(batch: pa.RecordBatch, at: int, d: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def products(y: np.ndarray) -> np.ndarray:
    """y'y in Python integers: by doubles where they are exact, else by two halves of 26 bits in longs."""
    if float(np.abs(y).max(initial=0)) ** 2 * max(len(y), 1) < 2.0 ** 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    total = np.zeros((y.shape[1],) * 2, object)
    for start in range(0, len(y), 512):
        part = y[start:start + 512]
        high, low = part >> 26, part & (2 ** 26 - 1)
        cross = (high.T @ low).astype(object)
        total = total + (high.T @ high).astype(object) * 2 ** 52 + (cross + cross.T) * 2 ** 26 + (low.T @ low).astype(object)
    return total


def _partial_sums(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[pa.RecordBatch]:
    """Cells (i, j), i <= j, of the task's sum of products; column sums stand in row -1, the number of rows in (-1, -1)."""
    total, sums, count = np.zeros((d, d), object), np.zeros(d, object), 0
    for batch in batches:
        y = _block(batch, 0, d)
        total, count = total + products(y), count + len(y)
        sums = sums + np.array([int(v) for v in y.sum(axis=0)], object) if len(y) * LONGEST < 2.0 ** 62 else sums + y.astype(object).sum(axis=0)
    if count:
        cells = [(i, j, total[i, j]) for i in range(d) for j in range(i, d)] + [(-1, j, sums[j]) for j in range(d)] + [(-1, -1, count)]
        i, j, v = zip(*cells)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(x) for x in v], pa.string())], ["i", "j", "v"])


def scatter(rows: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the column sums S and n * (sum of y y') - S S' of vectors of length d, exact."""
    parts = rows.select("y").mapInArrow(lambda batches: _partial_sums(batches, d), "i int, j int, v string")
    cells = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # (d + 1)(d + 2) / 2 rows
    at = {(r.i, r.j): int(r.v) for r in cells}
    n, sums = at[-1, -1], [at[-1, j] for j in range(d)]
    return n, sums, [[n * at[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def characteristic(spark, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients of the characteristic polynomial, constant term first; primes are dealt to tasks."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    primes = polynomial.primes_below(2 ** 31, polynomial.coefficient_bits(trace, d))
    at_once = max(1, 2 ** 21 // d ** 2)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(0).to_pylist()
            for start in range(0, len(mine), at_once):
                some = mine[start:start + at_once]
                found = polynomial.residues(matrix, some)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(found.tolist(), pa.list_(pa.int64()))], ["prime", "found"])
    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(q,) for q in primes], "prime long").repartition(tasks).mapInArrow(solve, "prime long, found array<long>").collect()
    by_prime = {r.prime: r.found for r in rows}
    return polynomial.combine(np.array([by_prime[q] for q in primes]), primes)


def components(spark, matrix: list[list[int]], wanted: int = COMPONENTS) -> tuple[list[float], np.ndarray]:
    """The largest positive eigenvalues of an integer covariance, falling, with their unit eigenvectors as rows."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if not trace:
        return [], np.zeros((0, len(matrix)))
    roots, scale = polynomial.largest_roots(characteristic(spark, matrix), trace, wanted)
    jobs, left = [], wanted
    for number, (root, times) in enumerate(roots):
        jobs.append((number, str(root), min(times, left)))
        left -= min(times, left)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                found = polynomial.null_space(matrix, int(job["root"]), scale, job["times"])
                yield pa.RecordBatch.from_arrays([pa.array([job["number"]] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()),
                                                  pa.array(found.tolist(), pa.list_(pa.float64()))], ["number", "k", "vector"])
    rows = spark.createDataFrame(jobs, "number int, root string, times int").repartition(len(jobs), "number").mapInArrow(solve, "number int, k int, vector array<double>").collect()
    rows = sorted(rows, key=lambda r: (r.number, r.k))
    return [roots[r.number][0] / (1 << scale) for r in rows], np.array([r.vector for r in rows])


def _project(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], scales: list[float], vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Whitened values and the exact deviation of each row; both need n * y - S, in longs where those hold them."""
    d = len(sums)
    for batch in batches:
        y = _block(batch, 1, d)
        if not len(y):
            continue
        most = n * int(np.abs(y).max()) + max(abs(s) for s in sums)
        if most ** 2 * d < 2 ** 63:
            centred = y * n - np.array(sums, np.int64)
            deviation = [int(v) for v in (centred * centred).sum(axis=1)]
        else:
            centred = y.astype(object) * n - np.array(sums, object)
            deviation = list((centred * centred).sum(axis=1))
        white = (centred.astype(float) @ vectors.T) / np.array(scales)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([str(v) for v in deviation], pa.string()),
                                          pa.array(white.tolist(), pa.list_(pa.float64()))], ["id", "deviation", "white"])


def identity_error(white: DataFrame, count: int) -> float:
    """Largest absolute entry of the covariance of white[0..count) minus the identity, measured on the rows."""
    entry = [F.col("white").getItem(k) for k in range(count)]
    pairs = [(a, b) for a in range(count) for b in range(a, count)]
    found = white.agg(*[F.covar_pop(entry[a], entry[b]).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row for each usable vector and component: key, component, n, deviation (exact), whitened, explained, identity_error."""
    spark = table.sparkSession
    id_type = table.schema[key].dataType.simpleString()
    rows = cut_lineage(prepared(table, key, vector, scale))
    made = []
    for length in sorted(r.d for r in rows.select(F.size("y").alias("d")).distinct().collect()):
        mine = rows.where(F.size("y") == length)
        n, sums, matrix = scatter(mine, length)
        values, vectors = components(spark, matrix, wanted)
        if not values:
            continue
        trace = sum(matrix[i][i] for i in range(length))
        scales = [math.sqrt(v) for v in values]  # the matrix is n^2 times the covariance, as n * y - S is n times the centred row
        project = functools.partial(_project, n=n, sums=sums, scales=scales, vectors=vectors)
        white = cut_lineage(mine.mapInArrow(project, f"id {id_type}, deviation string, white array<double>"))
        share = F.element_at(F.array(*[F.lit(v / trace) for v in values]), F.col("component"))
        made.append(white.select("id", F.col("deviation").cast("decimal(38,0)").alias("deviation"), F.posexplode("white").alias("at", "whitened"))
                    .select(F.col("id").alias(key), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened")
                    .withColumn("explained", share).withColumn("identity_error", F.lit(identity_error(white, len(values)))))
    if not made:
        return spark.createDataFrame([], f"`{key}` {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return functools.reduce(DataFrame.unionByName, made)
