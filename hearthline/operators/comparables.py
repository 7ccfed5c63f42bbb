"""Comparable sales for whole tables of dwellings: radius search, similarity, selection.

The search goes through an adaptive tree of evidence cells (`search_tree.py`): a dwelling is searched around once for all
its valuation dates, its reach shrinks to the distance that surely holds enough sales, and each date's sales are cut out of
the sites' sorted arrays. The true distance decides afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import geo
from ..functions.parse import month_no
from ..policies import SearchPolicy
from ..session import cut_lineage
from . import search_tree as ST


def search_window(as_of: Column, months: int, symmetric: Column, today: Column) -> tuple[Column, Column]:
    """First and last day of eligible sales; nothing after today is ever eligible."""
    years = months // 12
    start = F.make_date(F.year(as_of) - years, F.month(as_of), F.lit(1))
    forward = F.make_date(F.year(as_of) + years, F.month(as_of), F.lit(28))
    return start, F.least(F.when(symmetric, forward).otherwise(as_of), today)


def type_affinity(a: Column, b: Column) -> Column:
    """How far a sale of one type is evidence for another, symmetric."""
    pair = F.concat_ws("|", F.least(a, b), F.greatest(a, b))
    table = F.create_map(*[F.lit(x) for p, q, w in K.TYPE_AFFINITY for x in ("|".join(sorted((p, q))), w)])
    unknown = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return (F.when(unknown, K.TYPE_UNKNOWN).when(a == b, 1.0)
            .otherwise(F.coalesce(F.try_element_at(table, pair), F.lit(K.TYPE_UNLISTED))))


def similarity(distance_m: Column, months: Column, target_type: Column, sale_type: Column,
               target_area: Column, sale_area: Column) -> Column:
    """Type affinity times the weighted nearness in space, time and size; an unknown size has no weight."""
    near = F.exp(-distance_m / K.DECAY_METRES)
    fresh = F.exp(-months / K.DECAY_MONTHS)
    alike = F.exp(-2.0 * F.abs(F.log(sale_area / target_area)))
    base = K.WEIGHT_DISTANCE * near + K.WEIGHT_RECENCY * fresh
    sized = (target_area > 0) & (sale_area > 0)
    return type_affinity(target_type, sale_type) * (
        F.when(sized, base + K.WEIGHT_SIZE * alike).otherwise(base / (K.WEIGHT_DISTANCE + K.WEIGHT_RECENCY)))


def places_of(targets: DataFrame, evidence: DataFrame, typed: bool) -> tuple[DataFrame, DataFrame]:
    """Distinct dwellings to search around, and the questions (targets) asked at each: its valuation dates share one search."""
    want = F.col("property_type") if typed else F.lit(ST.ANY)
    home = F.coalesce(F.col("property_id").cast("string"), F.concat(F.lit("target "), "target_id"))
    named = targets.where("lat IS NOT NULL AND lon IS NOT NULL").select(
        F.concat_ws("@", home, "lat", "lon", "country", want).alias("place"), want.alias("want"), F.struct(*targets.columns).alias("t"))
    asked = cut_lineage(named.groupBy("place", "want").agg(F.collect_list("t").alias("asked")))  # as many as one dwelling's dates
    own = evidence.where("property_id IS NOT NULL").groupBy("property_id").agg(F.count(F.lit(1)).alias("own_sales"))
    first = F.element_at("asked", 1)
    places = asked.select("place", "want", *[first[c].alias(c) for c in ("property_id", "country", "lat", "lon")],
                          F.array_distinct(F.transform("asked", lambda t: F.struct(t["date_from"].alias("date_from"), t["date_to"].alias("date_to")))).alias("spans"))
    return places.join(own, "property_id", "left").withColumn("own_sales", F.coalesce("own_sales", F.lit(0).cast("long"))), asked.select("place", "asked")


def _distance() -> Column:
    return geo.haversine_m(F.col("lat"), F.col("lon"), F.col("sale_lat"), F.col("sale_lon"))


def radius_candidates(targets: DataFrame, evidence: DataFrame, tree: ST.SearchTree, policy: SearchPolicy, typed: bool) -> DataFrame:
    """Every sale of another dwelling that can be among each target's nearest within its radius, with its distance."""
    places, asked = places_of(targets, evidence, typed)
    leaves = ST.leaves_in_reach(places, tree, policy.radius_steps_m[-1], policy.nearest, policy.radius_steps_m, policy.target_comparables)
    hits = ST.sales_near(leaves, tree.sites, asked, _distance(), typed, policy.nearest)
    return hits.select("target.*", "reach_m", "distance_m", "sale_lat", "sale_lon", F.explode("sales").alias("s")).select(
        *targets.columns, "reach_m", "distance_m", "sale_lat", "sale_lon", "s.*")


def expand_radius(candidates: DataFrame, policy: SearchPolicy) -> DataFrame:
    """Smallest policy radius with enough sales, else the last; the nearest sales inside it."""
    w = Window.partitionBy("target_id")
    steps = policy.radius_steps_m
    used = F.lit(float(steps[-1]))
    for step in reversed(steps):
        within = F.count(F.when(F.col("distance_m") <= float(step), 1)).over(w)
        used = F.when(within >= policy.target_comparables, float(step)).otherwise(used)
    order = w.orderBy("distance_m", F.col("sold_date").desc(), "sale_key")
    return (candidates.withColumn("radius_m", used).where(F.col("distance_m") <= F.col("radius_m"))
            .withColumn("nearness", F.row_number().over(order)).where(F.col("nearness") <= policy.nearest))


def scored(found: DataFrame) -> DataFrame:
    months = F.abs(month_no(F.col("sold_date")) - month_no(F.col("as_of")))
    return found.withColumn("months_apart", months).withColumn("similarity", similarity(
        F.col("distance_m"), months, F.col("property_type"), F.col("sale_type"), F.col("floor_area"), F.col("sale_area")))


def search(targets: DataFrame, evidence: DataFrame, tree: ST.SearchTree, policy: SearchPolicy, typed: bool) -> DataFrame:
    return scored(expand_radius(radius_candidates(targets, evidence, tree, policy, typed), policy))


def val_comparables(targets: DataFrame, evidence: DataFrame, policy: SearchPolicy, tree: ST.SearchTree | None = None) -> DataFrame:
    """Comparables worth using per target: its own type first, every type where that is too thin.

    `tree` may hold the stored evidence of an earlier job with the same `nearest`.
    """
    tree = tree or ST.build(evidence, policy.nearest)
    typed = targets.where(F.coalesce(F.col("property_type") != "other", F.lit(False)))
    good = F.col("similarity") >= K.MIN_SIMILARITY
    first = cut_lineage(search(typed, evidence, tree, policy, True).where(good).withColumn("type_restricted", F.lit(True)))
    enough = first.groupBy("target_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= policy.min_comparables).select("target_id")
    rest = targets.join(enough, "target_id", "left_anti")
    second = search(rest, evidence, tree, policy, False).where(good).withColumn("type_restricted", F.lit(False))
    return first.join(enough, "target_id", "left_semi").unionByName(second)


def val_comparables_by_policy(targets: DataFrame, evidence: DataFrame, policies: dict[str, SearchPolicy], other: SearchPolicy) -> DataFrame:
    """Comparables where countries search by different policies: each country with its own, the rest with `other`."""
    def of(rows: DataFrame, names: list[str], inside: bool) -> DataFrame:
        member = F.coalesce(F.col("country").isin(names), F.lit(False))
        return rows.where(member if inside else ~member)
    out = val_comparables(of(targets, list(policies), False), of(evidence, list(policies), False), other)
    for policy in dict.fromkeys(policies.values()):
        names = [c for c, p in policies.items() if p == policy]
        out = out.unionByName(val_comparables(of(targets, names, True), of(evidence, names, True), policy))
    return out


def radius_counts(targets: DataFrame, evidence: DataFrame, radius_m: float) -> DataFrame:
    """Sales of other dwellings within a radius: how many, and how near the nearest is. Counts are cut out of sorted arrays."""
    places, asked = places_of(targets, evidence, False)
    looking, sites = ST.fixed_grid(places, evidence, radius_m)
    hits = ST.sales_near(looking.select("place", "want", "spans", "own_sales", "country", "lat", "lon", "reach_m", "node"), sites, asked, _distance(), False, None)
    return hits.groupBy("target.target_id").agg(F.sum(F.size("sales")).alias("sales_within"), F.min("distance_m").alias("nearest_m"))
