"""Automated valuation of whole tables of (dwelling, date) targets."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.parse import month_no
from ..policies import SearchPolicy
from .comparables import search_window, val_comparables
from .index_series import restate_ratios


def targets_for(dwellings: DataFrame, as_of: Column, today: date, policy: SearchPolicy, symmetric: Column | None = None) -> DataFrame:
    """Located dwellings with a valuation date and their search window; past years look both ways."""
    day = F.lit(today)
    historical = F.year(as_of) < F.year(day)
    both_ways = historical if symmetric is None else symmetric
    start, end = search_window(as_of, policy.months, both_ways, day)
    return dwellings.where("lat IS NOT NULL AND lon IS NOT NULL").select(
        F.concat_ws("@", "property_id", as_of).alias("target_id"), "property_id", "country", "lat", "lon", "property_type", "floor_area", "district",
        as_of.alias("as_of"), start.alias("date_from"), end.alias("date_to"), historical.alias("is_historical"))


def restated_comparables(comps: DataFrame, indices: DataFrame, links: DataFrame) -> DataFrame:
    """Comparables with their price restated at the valuation date; without a series they drop out."""
    asked = comps.withColumns({
        "_district": F.coalesce("sale_district", "district"), "_from": month_no(F.col("sold_date")), "_to": month_no(F.col("as_of"))})
    requests = asked.select("country", F.col("_district").alias("district"), F.col("sale_type").alias("property_type"),
                            F.col("_from").alias("from_month"), F.col("_to").alias("to_month"))
    ratios = restate_ratios(requests, indices, links).select(
        "country", F.col("district").alias("_district"), F.col("property_type").alias("sale_type"), F.col("from_month").alias("_from"),
        F.col("to_month").alias("_to"), "ratio", F.col("area_level").alias("adjustment_level"))
    out = asked.join(ratios, ["country", "_district", "sale_type", "_from", "_to"])
    return out.withColumn("adjusted_price", F.col("price") * F.col("ratio")).where("adjusted_price > 0").drop("_district", "_from", "_to")


def own_sales(targets: DataFrame, evidence: DataFrame, indices: DataFrame, links: DataFrame, strictly_before: bool = False) -> DataFrame:
    """Own evidence sale per target, restated: the latest up to the date, else the nearest in time.

    With `strictly_before`, only earlier sales count, so a held-out sale is never its own evidence.
    """
    sales = evidence.select("property_id", F.col("sale_key").alias("own_key"), F.col("price").alias("own_price"),
                            F.col("transaction_date").alias("own_date"), F.col("property_type").alias("own_type"), F.col("district").alias("own_district"))
    pairs = targets.select("target_id", "property_id", "country", "as_of").join(sales, "property_id")
    if strictly_before:
        pairs = pairs.where("own_date < as_of")
    gap = F.abs(F.datediff("as_of", "own_date"))
    order = F.struct((F.col("own_date") > F.col("as_of")).cast("int"), gap, -F.col("own_price"), "own_key")
    chosen = (pairs.groupBy("target_id", "country", "as_of")
              .agg(F.min_by(F.struct("own_price", "own_date", "own_type", "own_district"), order).alias("o"))
              .select("target_id", "country", "as_of", "o.*", month_no(F.col("o.own_date")).alias("_from"), month_no(F.col("as_of")).alias("_to")))
    requests = chosen.select("country", F.col("own_district").alias("district"), F.col("own_type").alias("property_type"),
                             F.col("_from").alias("from_month"), F.col("_to").alias("to_month"))
    ratios = restate_ratios(requests, indices, links).select(
        "country", F.col("district").alias("own_district"), F.col("property_type").alias("own_type"), F.col("from_month").alias("_from"),
        F.col("to_month").alias("_to"), "ratio")
    out = chosen.join(ratios, ["country", "own_district", "own_type", "_from", "_to"])
    return out.select("target_id", "own_price", "own_date", (F.col("own_price") * F.col("ratio")).alias("own_value"),
                      (F.abs(F.datediff("as_of", "own_date")) / 365.25).alias("own_years"))


def summarise(comps: DataFrame) -> DataFrame:
    """One row per target: weighted centre, spread and the facts that the grade looks at.

    A target has at most a fixed number of comparables, so its windows stay small.
    """
    v, wt = F.col("_v"), F.col("_w")
    w = Window.partitionBy("target_id")
    running = w.orderBy("_v", "_w", "sale_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = comps.withColumns({"_v": F.log("adjusted_price"), "_w": F.greatest("similarity", F.lit(1e-4))})
    rows = rows.withColumns({"_acc": F.sum(wt).over(running), "_total": F.sum(wt).over(w), "_n": F.count(F.lit(1)).over(w),
                             "_by_distance": F.row_number().over(w.orderBy("distance_m", "sale_key"))})

    def quantile(q):
        return F.min(F.when(F.col("_acc") >= q * F.col("_total") - 1e-12, v))
    rows = rows.withColumn("_centre", quantile(0.5).over(w)).withColumn("_dev", F.abs(v - F.col("_centre")))
    by_dev = w.orderBy("_dev", "_w", "sale_key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_dev_acc", F.sum(wt).over(by_dev))
    votes = [F.count_if(F.col("adjustment_level") == level).alias(f"_at_{level}") for level in ("local_authority", "region", "country")]
    out = rows.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("comparable_count"), F.sum("_w").alias("effective_weight"), F.max("_centre").alias("centre_log"),
        quantile(0.25).alias("p25_log"), quantile(0.75).alias("p75_log"),
        F.min(F.when(F.col("_dev_acc") >= 0.5 * F.col("_total") - 1e-12, F.col("_dev"))).alias("_mad"),
        F.max(F.when(F.col("_by_distance") == F.floor(F.col("_n") / 2) + 1, F.col("distance_m"))).alias("median_distance_m"),
        F.min("months_apart").alias("months_to_nearest"), F.max("similarity").alias("top_similarity"),
        F.max("radius_m").alias("radius_m"), F.bool_and("type_restricted").alias("type_restricted"), *votes)
    spread = F.when(F.col("comparable_count") < 4, F.col("_mad") * 1.4826).otherwise(
        F.greatest(F.lit(0.0), (F.col("p75_log") - F.col("p25_log")) / 1.349))
    # most frequent level; the more local one wins a tie
    most = F.greatest("_at_local_authority", "_at_region", "_at_country")
    level = (F.when(F.col("_at_local_authority") == most, "local_authority").when(F.col("_at_region") == most, "region").otherwise("country"))
    return out.withColumns({"dispersion": spread, "adjustment_level": level}).drop("_mad", "_at_local_authority", "_at_region", "_at_country")


def steps(value: Column, table: list[tuple[str, float, float]], otherwise: float) -> Column:
    """Score of the first rule met: (comparison, limit, score)."""
    out = None
    for op, limit, score in table:
        met = {"<=": value <= limit, ">=": value >= limit, ">": value > limit, "<": value < limit}[op]
        out = F.when(met, score) if out is None else out.when(met, score)
    return out.otherwise(otherwise)


# --- fixed values: limits and scores of the nine facts, and the sentences shown for them ---------

def grade_score(horizon_years: Column) -> Column:
    """Sum of nine scored facts about the evidence."""
    own = F.col("own_years")
    level = (F.when(F.col("adjustment_level") == "local_authority", 0.6).when(F.col("adjustment_level") == "region", 0.1)
             .when(F.col("adjustment_level") == "country", -0.5).otherwise(-1.2))
    return (steps(F.col("effective_weight"), [(">=", 12, 2.0), (">=", 6, 1.2), (">=", 3, 0.5)], -1.0)
            + steps(F.col("median_distance_m"), [("<=", 400, 1.5), ("<=", 1000, 0.8), ("<=", 2500, 0.1)], -0.8)
            + steps(F.col("dispersion"), [("<=", 0.14, 1.3), ("<=", 0.24, 0.5), ("<=", 0.38, -0.4)], -1.3)
            + steps(F.col("top_similarity"), [(">=", 0.8, 0.5), ("<", 0.5, -0.5)], 0.0)
            + steps(F.col("months_to_nearest"), [(">", 36, -0.9), (">", 18, -0.3)], 0.0) + level
            + F.when(own.isNull(), 0.0).otherwise(steps(own, [("<=", 4, 1.4), ("<=", 10, 0.7)], 0.2))
            - F.when(horizon_years > 0, F.least(F.lit(2.4), 0.42 * horizon_years)).otherwise(0.0))


def grade_of(score: Column) -> Column:
    high, medium, low = K.GRADE_FLOORS
    rounded = F.round(score, 9)
    return F.when(rounded >= high, "HIGH").when(rounded >= medium, "MEDIUM").when(rounded >= low, "LOW").otherwise("VERY_LOW")


def grade_reasons(horizon_years: Column) -> Column:
    """Plain sentences behind a grade, in a fixed order."""
    n = F.col("comparable_count").cast("string")
    weight, far, spread = F.col("effective_weight"), F.col("median_distance_m"), F.col("dispersion")
    months, own = F.col("months_to_nearest"), F.col("own_years")
    parts = [
        F.when(weight >= 6, F.concat(n, F.lit(" sales close by"))).when(weight >= 3, F.concat(F.lit("no more than "), n, F.lit(" sales close by")))
        .otherwise(F.concat(F.lit("hardly any sales to compare ("), n, F.lit(")"))),
        F.when(far <= 400, "compared sales lie a few doors away").when(far <= 1000, "compared sales lie in the neighbourhood")
        .when(far > 2500, "compared sales lie far apart"),
        F.when(spread <= 0.14, "their prices are close together").when(spread > 0.38, "their prices differ a great deal")
        .when(spread > 0.24, "their prices differ noticeably"),
        F.when(F.col("top_similarity") < 0.5, "none of them resembles the dwelling well"),
        F.when(months > 36, "the latest of them is over three years old"),
        F.when(F.col("adjustment_level") == "country", "prices were moved with a national index")
        .when(~F.col("adjustment_level").isin("local_authority", "region"), "prices were not moved with any index"),
        F.when(own <= 4, F.concat(F.lit("own sale "), F.bround(own).cast("int").cast("string"), F.lit(" year(s) ago")))
        .when(own <= 10, "own sale within ten years"),
        F.when(horizon_years > 0, F.concat(F.lit("projected ahead by "), F.bround(horizon_years).cast("int").cast("string"), F.lit(" years"))),
    ]
    return F.array_compact(F.array(*parts))


def half_width(grade: Column, dispersion: Column, historical: Column, years_back: Column) -> Column:
    """Log half width of the published interval."""
    band = F.create_map(*[F.lit(x) for kv in K.GRADE_HALF_WIDTH.items() for x in kv])
    base = F.greatest(F.element_at(band, grade), dispersion * K.DISPERSION_SHARE)
    past = F.when(historical, F.least(F.lit(0.06), 0.004 * years_back)).otherwise(0.0)
    return F.least(base + past, F.lit(K.MAX_HALF_WIDTH))


def estimate(targets: DataFrame, summary: DataFrame, own: DataFrame, today: date) -> DataFrame:
    """Blend, grade and interval; a status without a figure where the evidence is too thin."""
    rows = targets.join(summary, "target_id", "left").join(own, "target_id", "left")
    weight = F.col("effective_weight")
    own_share = F.least(K.OWN_MAX_SHARE * F.exp(-F.col("own_years") / K.OWN_DECAY_YEARS),
                        K.OWN_EVIDENCE_SHARE * weight / (weight + K.OWN_EVIDENCE_OFFSET))
    rows = rows.withColumns({"comparable_count": F.coalesce("comparable_count", F.lit(0)),
                             "own_share": F.when(F.col("own_value").isNotNull(), own_share).otherwise(0.0)})
    blended = F.exp((1 - F.col("own_share")) * F.col("centre_log") + F.when(
        F.col("own_value").isNotNull(), F.col("own_share") * F.log("own_value")).otherwise(0.0))
    thin = (F.col("comparable_count") < K.MIN_COMPARABLES) | F.coalesce(weight < K.MIN_EVIDENCE_WEIGHT, F.lit(True))
    rows = rows.withColumn("score", grade_score(F.lit(0.0))).withColumn("confidence", F.when(~thin, grade_of(F.col("score"))))
    ok = ~thin & (F.col("confidence") != "VERY_LOW")
    years_back = F.abs(F.lit(today.year) - F.year("as_of"))
    rows = rows.withColumns({
        "status": F.when(ok, "OK").otherwise("INSUFFICIENT_EVIDENCE"), "half_width": F.when(ok, half_width(
            F.col("confidence"), F.col("dispersion"), F.col("is_historical"), years_back)),
        "_estimate": F.when(ok, blended), "reasons": F.when(~thin, grade_reasons(F.lit(0.0)))})
    return rows.withColumns({
        "estimated_price": F.bround("_estimate"), "low_estimate": F.bround(F.col("_estimate") * F.exp(-F.col("half_width"))),
        "high_estimate": F.bround(F.col("_estimate") * F.exp("half_width"))}).drop("_estimate")


def val_avm(targets: DataFrame, evidence: DataFrame, indices: DataFrame, links: DataFrame, policy: SearchPolicy, today: date,
            strictly_before: bool = False) -> DataFrame:
    """Value every target from nearby sales, or say why not."""
    comps = restated_comparables(val_comparables(targets, evidence, policy), indices, links)
    own = own_sales(targets, evidence, indices, links, strictly_before)
    return estimate(targets, summarise(comps), own, today)


def evidence_struct() -> Column:
    """What an estimate rests on, as one explainable value."""
    return F.struct(
        "comparable_count", F.round("effective_weight", 2).alias("effective_weight"), "radius_m",
        F.bround("median_distance_m").alias("median_distance_m"), F.bround(F.exp("centre_log")).alias("median_comparable"),
        F.round("dispersion", 4).alias("dispersion"), F.bround(F.exp("p25_log")).alias("price_low"), F.bround(F.exp("p75_log")).alias("price_high"),
        "type_restricted", "adjustment_level", F.round("own_share", 3).alias("own_share"), F.bround("own_value").alias("own_value"), "reasons")


def demoted(grade: Column) -> Column:
    return F.when(grade == "HIGH", "MEDIUM").when(grade == "MEDIUM", "LOW").otherwise("VERY_LOW")


def val_backcast(wanted: DataFrame, current: DataFrame, indices: DataFrame, links: DataFrame, today: date) -> DataFrame:
    """Current estimate restated at a past date: weaker grade, wider interval, only for past months.

    `wanted` holds (property_id, as_of); `current` the estimates of today.
    """
    now = current.where("status = 'OK'").select("property_id", "country", "district", "property_type", "estimated_price", "low_estimate",
                                                "high_estimate", "confidence", "comparable_count")
    rows = wanted.where(F.col("as_of") < F.lit(today.replace(day=1))).join(now, "property_id").withColumns(
        {"_from": F.lit(today.year * 12 + today.month), "_to": month_no(F.col("as_of"))})
    requests = rows.select("country", "district", "property_type", F.col("_from").alias("from_month"), F.col("_to").alias("to_month"))
    ratios = restate_ratios(requests, indices, links).select(
        "country", "district", "property_type", F.col("from_month").alias("_from"), F.col("to_month").alias("_to"), "ratio", "area_level")
    rows = rows.join(ratios, ["country", "district", "property_type", "_from", "_to"])
    once = demoted(F.col("confidence"))
    grade = F.when(F.col("area_level") == "country", demoted(once)).otherwise(once)
    years = F.greatest(F.lit(0.0), F.datediff(F.lit(today), "as_of") / 365.25)
    base = F.coalesce(F.log(F.col("high_estimate") / F.col("low_estimate")) / 2, F.lit(K.BACKCAST_BASE))
    half = (base + F.least(F.lit(K.BACKCAST_CAP), K.BACKCAST_PER_YEAR * years)
            + F.when(F.col("area_level") != "local_authority", K.BACKCAST_NONLOCAL).otherwise(0.0))
    value = F.col("estimated_price") * F.col("ratio")
    out = rows.select("property_id", "as_of", "country", value.alias("_value"), half.alias("half_width"), grade.alias("confidence"),
                      F.col("estimated_price").alias("current_estimate"), "area_level", "comparable_count")
    ok = F.col("confidence") != "VERY_LOW"
    return out.select(
        "property_id", "as_of", "country", F.when(ok, "OK").otherwise("INSUFFICIENT_EVIDENCE").alias("status"), "confidence",
        F.when(ok, F.bround("_value")).alias("estimated_price"), F.when(ok, F.bround(F.col("_value") * F.exp(-F.col("half_width")))).alias("low_estimate"),
        F.when(ok, F.bround(F.col("_value") * F.exp("half_width"))).alias("high_estimate"), "current_estimate", "area_level", "comparable_count")
