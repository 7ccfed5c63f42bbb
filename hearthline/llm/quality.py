"""Quality classifier as a sparse rule ensemble.

Statistics of every whole text (shares of kinds of bytes, word and line lengths, repetition) are computed in one
scan. Shallow boosted trees are grown on the labelled rows; every path from a root is a conjunctive rule over the
statistics. A logistic model with an L1 penalty weighs the rules and sets most weights to zero; what remains is
compiled into one Spark column expression.

The score uses the text alone. At most about `train_rows` labelled rows, chosen by a hash of id and statistics (so that
copies of one text are no single choice), are used for fitting (a documented bound; all are used below it). Null and empty texts have statistics of 0 and get a
score like any other. Null labels are left out; several labels of one document count as several rows. Without
labels, or with labels of one class only, the score is the share of label 1 (0.5 without any). Repeated documents
get equal scores. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import bytecode as B

STATS = ("log_bytes", "log_words", "mean_word", "long_words", "short_words", "words_per_line", "upper", "digit", "symbol", "stop", "pipe", "space",
         "wide", "symbol_words", "bang_words", "distinct_words", "distinct_lines", "short_lines", "upper_words")
TRAIN_ROWS = 60_000


def _kind(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("0123456789")
_SYMBOL, _STOP, _PIPE = _kind("#$%&*@^~_=+<>{}[]\\/"), _kind(".,;:!?"), _kind("|")
_WIDE = np.arange(256) >= 128


def _distinct(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many different codes each row has."""
    row = B.rows_of(first)
    order = np.lexsort((codes, row))
    c, r = codes[order], row[order]
    new = np.ones(len(c), dtype=bool)
    new[1:] = (c[1:] != c[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=len(first) - 1)


def measure(chunk: B.Chunk) -> np.ndarray:
    """One row of statistics, in order of STATS, for each text."""
    n = chunk.rows
    starts, ends, first = chunk.words(B.SPACED)
    size, words = np.diff(chunk.offsets), np.diff(first)
    row = B.rows_of(first)
    sums = chunk.sums()

    def bytes_of(kind: np.ndarray) -> np.ndarray:
        total = np.zeros(len(chunk.data) + 1, dtype=np.int64)
        np.cumsum(kind[chunk.data], out=total[1:])
        return np.diff(total[chunk.offsets])

    def words_with(flag: np.ndarray) -> np.ndarray:
        return np.bincount(row[flag], minlength=n)

    length = ends - starts
    last = chunk.data[ends - 1] if len(ends) else chunk.data[:0]
    not_feed = np.ones(256, dtype=bool)
    not_feed[10] = False
    line_start, line_end, line_first = chunk.words(not_feed)
    lines = np.diff(line_first)
    up = np.zeros(len(chunk.data) + 1, dtype=np.int64)
    np.cumsum(_UPPER[chunk.data], out=up[1:])
    shouted = (up[ends] - up[starts]) * 2 > length
    short = np.bincount(B.rows_of(line_first)[line_end - line_start < 20], minlength=n)
    per_byte, per_word, per_line = np.maximum(size, 1), np.maximum(words, 1), np.maximum(lines, 1)
    columns = [np.log1p(size), np.log1p(words), np.bincount(row, weights=length, minlength=n) / per_word, words_with(length > 14) / per_word, words_with(length < 4) / per_word,
               words / per_line, bytes_of(_UPPER) / per_byte, bytes_of(_DIGIT) / per_byte, bytes_of(_SYMBOL) / per_byte, bytes_of(_STOP) / per_byte,
               bytes_of(_PIPE) / per_byte, bytes_of(~B.SPACED) / per_byte, bytes_of(_WIDE) / per_byte, words_with(_SYMBOL[last]) / per_word,
               words_with(last == 33) / per_word, _distinct(B.pieces(sums, starts, ends), first) / per_word,
               _distinct(B.pieces(sums, line_start, line_end), line_first) / per_line, short / per_line, words_with(shouted) / per_word]
    return np.column_stack(columns).astype(np.float64)


def _measure(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            parts = [measure(c) for c in B.chunks(batch.column(at))] or [np.zeros((0, len(STATS)))]
            values = np.concatenate(parts)
            kept = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *[pa.array(values[:, i]) for i in range(len(STATS))]],
                                             names=[*[batch.schema.names[i] for i in kept], *[f"stat_{s}" for s in STATS]])
    return run


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs but the text, and stat_ columns."""
    added = {f"stat_{s}" for s in STATS}
    kept = [f for f in docs.schema.fields if f.name != text and f.name.lower() not in added]
    return docs.select(*[F.col(f"`{f.name}`") for f in kept], text).mapInArrow(_measure(text), T.StructType([*kept, *[T.StructField(f"stat_{s}", T.DoubleType()) for s in STATS]]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether it is at most the bound, bound)


def paths(node, so_far: Rule = ()) -> list[Rule]:
    """Every path below a fitted tree's node, as rules with one bound for each statistic and side."""
    out = [so_far] if so_far else []
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        for below, child in ((True, node.leftChild()), (False, node.rightChild())):
            k, bound = int(split.featureIndex()), float(split.threshold())
            old = [c for c in so_far if c[:2] == (k, below)]
            bound = (min if below else max)([bound, *[c[2] for c in old]])
            rest = tuple(c for c in so_far if c[:2] != (k, below))
            out += paths(child, tuple(sorted((*rest, (k, below, bound)))))
    return out


def condition(rule: Rule) -> Column:
    parts = [F.col(f"stat_{STATS[k]}") <= bound if below else F.col(f"stat_{STATS[k]}") > bound for k, below, bound in rule]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


@dataclass
class RuleModel:
    """Rules with their weights, and the intercept."""

    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self) -> Column:
        """The model as one expression over the stat_ columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(rows: DataFrame, label: str = "label", key: str = "doc_id", train_rows: int = TRAIN_ROWS, trees: int = 12, depth: int = 3, penalty: float = 0.0005, seed: int = 7, step: float = 0.1) -> RuleModel:
    """Grow trees, take their paths as rules, and weigh these by lasso logistic regression."""
    rows = rows.where(F.col(label).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"), *[f"stat_{s}" for s in STATS])
    total = rows.count()
    if total > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("key", *[f"stat_{s}" for s in STATS]), F.lit(1_000_000)) < int(1_000_000 * train_rows / total))
    rows = cut_lineage(rows)
    mean = rows.agg(F.avg("label")).first()[0]
    if mean is None or mean in (0.0, 1.0):
        p = min(max(0.5 if mean is None else mean, 0.001), 0.999)
        return RuleModel([], math.log(p / (1 - p)))
    data = rows.select("label", array_to_vector(F.array(*[f"stat_{s}" for s in STATS])).alias("x")).repartition(8)
    grown = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=64, seed=seed, stepSize=step).fit(data)
    rules = sorted({rule for tree in grown._java_obj.trees() for rule in paths(tree.rootNode())})
    fired = rows.select("label", array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("x")).repartition(8)
    weighed = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False).fit(fired)
    weights = weighed.coefficients.toArray()
    return RuleModel([(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-9], float(weighed.intercept))


def classify(measured: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """Measured rows with score and predicted instead of the statistics."""
    kept = [c for c in measured.columns if c.lower() not in {f"stat_{s}" for s in STATS} | {"score", "predicted"}]
    out = measured.select(*[F.col(f"`{c}`") for c in kept], model.score().alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
