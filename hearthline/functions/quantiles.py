"""Exact order statistics that survive a group holding most of the rows.

A plain exact percentile gathers every distinct value of a group in one task. Here the values of all measures are
counted (combined before the shuffle) and cut into value bins; bin totals tell which bins hold a wanted rank, and only
inside a bin are values put in order. Every group takes this one way, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BINS_PER_E_FOLD = 256
WIDE_BINS_PER_E_FOLD = 32


def value_bin(col: Column, per_e_fold: int = BINS_PER_E_FOLD) -> Column:
    """Monotone bin number: equal relative width for large values, either sign."""
    magnitude = F.floor(F.log1p(F.abs(col)) * per_e_fold)
    return F.when(col < 0, -magnitude - 1).otherwise(magnitude)


def rank_of(p: float, n: Column, rule: str) -> Column:
    """Zero-based fractional rank of a probability among n sorted values."""
    if rule == "inclusive":
        return (n - 1) * F.lit(p)
    low = F.greatest((n + 1) * F.lit(p) - 1, F.lit(0.0))
    return F.least(low, (n - 1).cast("double"))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of which null equals null; the left side's keys stay."""
    other = right.select(*[F.col(k).alias(f"_key_{k}") if k in keys else F.col(k) for k in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(other[f"_key_{k}"])
    return left.join(other, on, how).drop(*[f"_key_{k}" for k in keys])


def measured(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """One row for each value of each measure (`_m`, by position): keys, _m, _v. Nulls are left out."""
    entries = [F.struct(F.lit(i).alias("_m"), F.col(v).cast("double").alias("_v")) for i, v in enumerate(measures)]
    return df.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e._m", "_e._v").where(F.col("_v").isNotNull())


def counted(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """How often each value of each measure (`_m`, by position) occurs: keys, _m, _bin, _v, _n. Nulls are left out."""
    return measured(df, keys, measures).groupBy(*keys, "_m", value_bin(F.col("_v")).alias("_bin"), "_v").agg(F.count(F.lit(1)).alias("_n"))


def exact_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, dict[str, float]], rule: str = "inclusive", also: list[Column] = ()) -> DataFrame:
    """One row per group: the mergeable aggregates in `also`, then the interpolated quantiles
    {measure: {output name: probability}}. Nulls are ignored; a group without values has null quantiles.

    The input is read twice, for the counts and for the aggregates.
    """
    found = quantiles_of_counts(counted(df, keys, list(wanted)), keys, list(wanted.values()), rule)
    groups = df.groupBy(*keys).agg(*(also or [F.count(F.lit(1)).alias("_any")]))
    done = same_keys(groups, found, keys, "left")
    return done.drop("_any")


def bins_of(counts: DataFrame, keys: list[str], also: list[Column] = ()) -> DataFrame:
    """Counts by bin (`_bn`), with further sums of the counted rows. A group has as many rows as its values span bins."""
    return counts.groupBy(*keys, "_m", "_bin").agg(F.sum("_n").alias("_bn"), *also)


def quantiles_of_counts(counts: DataFrame, keys: list[str], wanted: list[dict[str, float]], rule: str = "inclusive", bins: DataFrame | None = None) -> DataFrame:
    """Quantiles of counted values: one dictionary {output name: probability} for each measure number.

    `bins` may hold the counts by bin where they are kept already. Counts may state a value several times.
    """
    bins = bins_of(counts, keys) if bins is None else bins
    # spread counts are many times the file they come from, which is what their size is taken from: they must not be broadcast
    chosen = _wanted_bins(bins, keys, wanted, rule).hint("merge")
    inside = same_keys(counts, chosen, [*keys, "_m", "_bin"], "inner").groupBy(*keys, "_m", "_bin", "_start", "_total", "_v").agg(F.sum("_n").alias("_n"))
    return _picked(inside, keys, wanted, rule).select(*keys, *[name for names in wanted for name in names])


def _holds(lo: str, hi: str, rank: Column) -> Column:
    return (F.col(lo) <= rank) & (rank < F.col(hi))


def _wanted_bins(bins: DataFrame, keys: list[str], wanted: list[dict[str, float]], rule: str) -> DataFrame:
    """The bins that hold a wanted rank: keys, _m, _bin, values before the bin (_start) and in the group (_total)."""
    group = Window.partitionBy(*keys, "_m")
    bins = (bins.withColumn("_end", F.sum("_bn").over(group.orderBy("_bin"))).withColumn("_total", F.sum("_bn").over(group))
            .withColumn("_start", F.col("_end") - F.col("_bn")))
    needed = F.lit(False)
    for i, names in enumerate(wanted):
        for p in names.values():
            rank = rank_of(p, F.col("_total"), rule)
            for whole in (F.floor(rank), F.ceil(rank)):
                needed = needed | ((F.col("_m") == i) & _holds("_start", "_end", whole))
    return bins.where(needed).select(*keys, "_m", "_bin", "_start", "_total")


def _picked(inside: DataFrame, keys: list[str], wanted: list[dict[str, float]], rule: str, one_bin: list[str] | None = None) -> DataFrame:
    """Quantiles from the counted values of the wanted bins, and the number of values of each measure (_total_0, ...).

    `one_bin`: what tells a bin of a group from all others, where that is less than the keys, measure and bin.
    """
    in_bin = Window.partitionBy(*(one_bin or [*keys, "_m", "_bin"])).orderBy("_v")
    placed = inside.withColumn("_to", F.col("_start") + F.sum("_n").over(in_bin)).withColumn("_from", F.col("_to") - F.col("_n"))
    picks, out = [], []
    for i, names in enumerate(wanted):
        for name, p in names.items():
            rank = rank_of(p, F.col("_total"), rule)
            for side, whole in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
                picks.append(F.max(F.when((F.col("_m") == i) & _holds("_from", "_to", whole), F.col("_v"))).alias(f"_{side}_{name}"))
            out.append(_between(name, rank_of(p, F.col(f"_total_{i}"), rule)))
        picks.append(F.max(F.when(F.col("_m") == i, F.col("_total"))).alias(f"_total_{i}"))
    return placed.groupBy(*keys).agg(*picks).select(*keys, *out, *[f"_total_{i}" for i in range(len(wanted))])


def _number(keys: list[str], seed: int) -> Column:
    """Hash of a group's keys in which a null has its own place."""
    return F.xxhash64(F.lit(seed), *[c for k in keys for c in (F.col(k), F.col(k).isNull())])


def numbered(groups: DataFrame, keys: list[str]) -> Column:
    """A number for each of the stored `groups` (one row each), made from its keys alone; no two of them share it."""
    seed = 0
    while not groups.groupBy(_number(keys, seed).alias("_g")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        seed += 1
    return _number(keys, seed)


def spread_quantiles(df: DataFrame, finest: list[str], keys: list[str], spread: Callable[[DataFrame], DataFrame], wanted: dict[str, dict[str, float]],
                     counts: dict[str, str], rule: str = "inclusive", kept: bool = False, times: str | None = None) -> DataFrame:
    """Quantiles {measure: {output name: probability}} of groups (`keys`) that are made of finer ones (`finest`), and the
    number of values {measure: output name}. `spread` adds the keys to rows of the finer groups, one row for each group
    that they are part of. Groups without any value have no row.

    A row counts once, or as often as its column `times` says.
    The stored input (`kept`: `df` is stored already) is read twice: once to count it by wide bins, which alone are spread
    over the groups, and once for the values of bins that hold a wanted rank. Only bins and those values move, with a number
    in place of the keys of their group; the keys are joined back at the end.
    """
    measures, names = list(wanted), list(wanted.values())
    once = F.lit(1).cast("long").alias("_n") if times is None else F.col(times).alias("_n")
    stored = df if kept else cut_lineage(df.select(*finest, *measures, *([times] if times else [])))
    number = numbered(finer := cut_lineage(stored.select(*finest).distinct()), finest)
    parts = cut_lineage(spread(finer.withColumn("_g", number)).select("_g", *keys))
    groups = cut_lineage(parts.select(*keys).distinct().withColumn("_k", F.monotonically_increasing_id()))
    links = cut_lineage(same_keys(parts, groups.hint("merge"), keys, "inner").select("_g", "_k"))
    # measure and bin are one number, so that little moves with a value
    values = measured(stored.select(number.alias("_g"), once, *measures), ["_g", "_n"], measures).select(
        "_g", (value_bin(F.col("_v"), WIDE_BINS_PER_E_FOLD) * len(measures) + F.col("_m")).alias("_c"), "_v", "_n")
    bins = cut_lineage(values.groupBy("_g", "_c").agg(F.sum("_n").alias("_n")))
    whole = bins.join(links.hint("merge"), "_g").groupBy("_k", "_c").agg(F.sum("_n").alias("_bn")).select(
        "_k", F.pmod("_c", F.lit(len(measures))).cast("int").alias("_m"), F.floor(F.col("_c") / len(measures)).alias("_bin"), "_bn")
    chosen = cut_lineage(_wanted_bins(whole, ["_k"], names, rule).withColumn("_w", F.monotonically_increasing_id()))
    sought = chosen.join(links.hint("merge"), "_k").select("_g", (F.col("_bin") * len(measures) + F.col("_m")).alias("_c"), "_w")
    inside = values.join(sought.hint("merge"), ["_g", "_c"]).groupBy("_w", "_v").agg(F.sum("_n").alias("_n"))
    found = _picked(inside.join(chosen.hint("merge"), "_w"), ["_k"], names, rule, ["_w"])
    return found.join(groups.hint("merge"), "_k").select(
        *keys, *[F.coalesce(f"_total_{measures.index(m)}", F.lit(0)).alias(name) for m, name in counts.items()], *[name for group in names for name in group])


def _between(name: str, rank: Column) -> Column:
    low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
    return (low + (high - low) * (rank - F.floor(rank))).alias(name)


def weighted_lower_quantile(df: DataFrame, keys: list[str], value: str, weight: str,
                            wanted: dict[str, float]) -> DataFrame:
    """First value whose running weight reaches q x total; the middle value when weights vanish.

    Meant for groups of bounded size, such as the nearest comparables of one dwelling.
    """
    w = Window.partitionBy(*keys)
    ordered = w.orderBy(value, weight).rowsBetween(Window.unboundedPreceding, 0)
    ranked = (df.withColumn("_acc", F.sum(weight).over(ordered))
              .withColumn("_pos", F.count(F.lit(1)).over(ordered))
              .withColumn("_all", F.count(F.lit(1)).over(w))
              .withColumn("_total", F.sum(weight).over(
                  w.orderBy(value, weight).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    aggs = []
    for name, q in wanted.items():
        reached = F.min(F.when(F.col("_acc") >= F.lit(q) * F.col("_total"), F.col(value)))
        middle = F.max(F.when(F.col("_pos") == F.floor(F.col("_all") / 2) + 1, F.col(value)))
        aggs.append(F.when(F.max("_total") <= 0, middle)
                    .otherwise(F.coalesce(reached, F.max(value))).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)
