"""Mixing sources to target weights with hash thresholds instead of sorting.

A source's target is its share of the budget by weight, at most `cap` times its size, the excess shared anew.
Whole copies are taken as often as they fit; the rest of the target is filled with the documents whose hash of
the id lies under a threshold. The threshold is found from histograms of words by hash bucket: only the bucket
that holds the budget is refined, three times by 12 bits, and its few hashes decide the last place. Everything
is DataFrame functions, sums are combined before the shuffle, and no group is larger than 4096 buckets.

Null texts have size 0, a null source is a source (last in order), a null id hashes as the word 'null'. Rows with
equal ids share a hash and are taken together. A source without words has target 0. An empty table gives an
empty result. Columns that the operator adds replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HASH_BITS, STEP_BITS, STEPS = 60, 12, 3
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(key: Column) -> Column:
    """The id's fixed place on the line from 0 to 2^60, the same in every run."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """From (source, source_size): the target of each source. One row per source goes through one window.

    Sources in order of cap * size / weight reach their cap one after another as the level of words for each
    unit of weight rises; the first source that does not reach it gives the level of all that follow.
    """
    by_code = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_code) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    rising = Window.orderBy("_reach", "_w", F.col("source").cast("binary").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = (sizes.withColumn("_w", w).withColumn("_most", F.col("source_size") * F.lit(float(cap)))
         .withColumn("_reach", F.col("_most") / F.col("_w"))
         .withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(everything).cast("double"))
         .withColumn("_before", F.coalesce(F.sum("_most").over(rising), F.lit(0.0)))
         .withColumn("_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(rising), F.lit(0.0)))
         .withColumn("_level", (F.col("_budget") - F.col("_before")) / F.col("_left")))
    s = s.withColumn("_line", F.max(F.when(F.col("_reach") > F.col("_level"), F.col("_level"))).over(everything))
    return s.select("source", "source_size", F.when(F.col("_reach") > F.col("_level"), F.col("_w") * F.col("_line"))
                    .otherwise(F.col("_most")).alias("target"))


def thresholds(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with `copies` (whole copies of all documents) and `under` (documents whose place is less get one more)."""
    goal = plan.where("source_size > 0").select(
        "source", F.floor(F.col("target") / F.col("source_size")).alias("copies"),
        (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("_need"))
    rows, edge = narrow, goal.withColumn("_low", F.lit(0).cast("long"))
    for step in range(1, STEPS + 1):
        width = HASH_BITS - STEP_BITS * step
        bucket = F.shiftright("place", width)
        found = rows.groupBy("source", bucket.alias("_b")).agg(F.sum("size").alias("_s"))
        running = Window.partitionBy("source").orderBy("_b")
        e = edge.select(F.col("source").alias("_src"), "_need")
        found = (found.withColumn("_to", F.sum("_s").over(running)).join(e, F.col("source").eqNullSafe(F.col("_src")))
                 .where((F.col("_to") - F.col("_s") <= F.col("_need")) & (F.col("_need") < F.col("_to"))))
        edge = cut_lineage(found.select("source", "_b", (F.col("_need") - (F.col("_to") - F.col("_s"))).alias("_need")))
        k = edge.select(F.col("source").alias("_src"), F.col("_b").alias("_in"))
        rows = rows.join(k, F.col("source").eqNullSafe(F.col("_src")) & (F.shiftright("place", width) == F.col("_in")), "left_semi")
    last = rows.groupBy("source", "place").agg(F.sum("size").alias("_s"))
    e = edge.select(F.col("source").alias("_src"), "_need")
    last = (last.withColumn("_to", F.sum("_s").over(Window.partitionBy("source").orderBy("place")))
            .join(e, F.col("source").eqNullSafe(F.col("_src")))
            .where((F.col("_to") - F.col("_s") <= F.col("_need")) & (F.col("_need") < F.col("_to")))
            .select(F.col("source").alias("_src"),
                    F.when(F.col("_to") - F.col("_need") < F.col("_need") - (F.col("_to") - F.col("_s")), F.col("place") + 1)
                    .otherwise(F.col("place")).alias("_under")))
    g = goal.select(F.col("source").alias("_src2"), "copies")
    return (plan.join(g, F.col("source").eqNullSafe(F.col("_src2")), "left")
            .join(last, F.col("source").eqNullSafe(F.col("_src")), "left")
            .select("source", "source_size", "target", F.coalesce("copies", F.lit(0)).cast("int").alias("copies"),
                    F.coalesce("_under", F.lit(0)).cast("long").alias("under")))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, key: str = "doc_id",
                text: str = "text", source: str = "source") -> DataFrame:
    """Every document with its `size`, its source's `source_size` and `target`, and `copies`, how often it is taken."""
    narrow = cut_lineage(docs.select(F.col(source).alias("source"), place(F.col(key)).alias("place"), words(F.col(text)).alias("size")))
    sizes = cut_lineage(narrow.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = cut_lineage(thresholds(narrow, targets(sizes, weights, share, cap)))
    made = ["size", "source_size", "target", "copies"]
    p = plan.select(F.col("source").alias("_plan_source"), F.col("source_size").alias("_plan_size"), F.col("target").alias("_plan_target"),
                    F.col("copies").alias("_plan_copies"), F.col("under").alias("_plan_under"))
    keep = [c for c in docs.columns if c not in made]
    return (docs.join(p, F.col(source).eqNullSafe(F.col("_plan_source")))
            .select(*keep, words(F.col(text)).alias("size"), F.col("_plan_size").alias("source_size"), F.col("_plan_target").alias("target"),
                    (F.col("_plan_copies") + F.when(place(F.col(key)) < F.col("_plan_under"), 1).otherwise(0)).alias("copies")))
