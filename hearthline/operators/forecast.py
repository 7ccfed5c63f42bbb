"""Market projections: drift fitted per series, shrunk toward the nation, with measured intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.parse import month_no
from ..policies import ForecastPolicy

SERIES = ["country", "area_code", "area_level", "segment"]


def positions(indices: DataFrame) -> DataFrame:
    """Log index with its place in the series; a series has at most one point per month."""
    w = Window.partitionBy(*SERIES).orderBy("period")
    return (indices.where("index_value > 0").select(*SERIES, "period", "index_value", F.log("index_value").alias("y"))
            .withColumn("x", F.row_number().over(w)))


def tail_fits(points: DataFrame, policy: ForecastPolicy) -> DataFrame:
    """At every month: least-squares slope of the trailing windows, using that prefix only."""
    w = Window.partitionBy(*SERIES).orderBy("x")
    long, short = (w.rowsBetween(-(n - 1), 0) for n in (policy.long_months, policy.short_months))

    def slope(rows, size):
        enough = F.least(F.col("x"), F.lit(size)) >= 3
        return F.when(enough, F.regr_slope("y", "x").over(rows)).otherwise(0.0)
    n = F.least(F.col("x"), F.lit(policy.long_months))
    spread = F.regr_syy("y", "x").over(long) - F.pow(F.regr_sxy("y", "x").over(long), 2) / F.regr_sxx("y", "x").over(long)
    return points.withColumns({
        "g_long": slope(long, policy.long_months), "g_short": slope(short, policy.short_months), "months": F.col("x"),
        "residual_sigma": F.when(n > 3, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 2))).otherwise(0.0)})


def shrink(fits: DataFrame, national: DataFrame, policy: ForecastPolicy) -> DataFrame:
    """Local drift pulled toward the national one at the same month; short histories borrow more."""
    rows = fits.join(national, ["country", "period"], "left")
    own = F.col("months") / (F.col("months") + F.lit(policy.shrink_months))
    known = F.col("national_g").isNotNull()
    used = F.when(known, own * F.col("g_long") + (1 - own) * F.col("national_g")).otherwise(F.col("g_long"))
    return rows.withColumns({"g_used": used, "shrinkage": F.when(known, 1 - own).otherwise(0.0), "momentum": F.col("g_short") - used})


def national_drift(fits: DataFrame, policy: ForecastPolicy) -> DataFrame:
    whole = fits.where(f"area_level = 'country' AND segment = 'all' AND months >= {policy.min_months}")
    return whole.groupBy("country", "period").agg(F.min_by("g_long", "area_code").alias("national_g"))


def fc_fit(indices: DataFrame, policy: ForecastPolicy) -> DataFrame:
    """One fit per series long enough, at its last month."""
    fits = tail_fits(positions(indices), policy)
    last = fits.join(fits.groupBy(*SERIES).agg(F.max("period").alias("period")), [*SERIES, "period"], "left_semi")
    nation = last.where(f"area_level = 'country' AND segment = 'all' AND months >= {policy.min_months}").groupBy("country").agg(
        F.min_by("g_long", "area_code").alias("national_g"))
    rows = last.where(F.col("months") >= policy.min_months).join(nation, "country", "left")
    own = F.col("months") / (F.col("months") + F.lit(policy.shrink_months))
    known = F.col("national_g").isNotNull()
    used = F.when(known, own * F.col("g_long") + (1 - own) * F.col("national_g")).otherwise(F.col("g_long"))
    return rows.select(*SERIES, F.col("period").alias("origin_period"), F.col("index_value").alias("origin_index"), "months", "g_long", "g_short",
                       used.alias("g_used"), F.when(known, 1 - own).otherwise(0.0).alias("shrinkage"), (F.col("g_short") - used).alias("momentum"),
                       "residual_sigma")


def log_change(horizon: Column, policy: ForecastPolicy, drift: Column | None = None, momentum: Column | None = None) -> Column:
    """Closed form of the damped projection in log terms."""
    d = F.lit(policy.drift) if drift is None else drift
    m = F.lit(policy.momentum) if momentum is None else momentum
    phi = policy.damping
    fading = horizon.cast("double") if phi >= 1 else phi * (1 - F.pow(F.lit(phi), horizon)) / (1 - phi)
    return d * F.col("g_used") * horizon + m * F.col("momentum") * fading


def with_sigma(rows: DataFrame, sigma: DataFrame | None) -> DataFrame:
    """Error sd at each `horizon`: linear between measured horizons, square root outside them.

    `sigma` has a handful of rows, one per measured horizon.
    """
    years = F.sqrt(F.col("horizon") / 12.0)
    if sigma is None:
        return rows.withColumns({"sigma": K.PROVISIONAL_SIGMA * years, "interval_basis": F.lit("provisional")})
    table = sigma.agg(F.array_sort(F.collect_list(F.struct(F.col("horizon").alias("h"), F.col("sigma").alias("s")))).alias("_t"))
    out = rows.withColumn("_t", table.scalar())
    h = F.col("horizon")
    above = F.get(F.filter("_t", lambda e: e["h"] >= h), F.lit(0))
    below = F.try_element_at(F.filter("_t", lambda e: e["h"] <= h), F.lit(-1))
    line = F.when(below["h"] == above["h"], below["s"]).otherwise(
        below["s"] + (h - below["h"]) / (above["h"] - below["h"]) * (above["s"] - below["s"]))
    value = (F.when(below.isNull(), above["s"] * F.sqrt(h / above["h"])).when(above.isNull(), below["s"] * F.sqrt(h / below["h"])).otherwise(line))
    measured = F.size("_t") > 0
    return out.withColumns({"sigma": F.when(measured, value).otherwise(K.PROVISIONAL_SIGMA * years),
                            "interval_basis": F.when(measured, "backtest").otherwise("provisional")}).drop("_t")


def fc_project(rows: DataFrame, policy: ForecastPolicy, sigma: DataFrame | None) -> DataFrame:
    """Index ratio and 80 % band at `horizon` months; nothing moves at or before the origin."""
    out = with_sigma(rows, sigma)
    ahead = F.col("horizon") > 0
    ratio = F.when(ahead, F.exp(log_change(F.col("horizon"), policy))).otherwise(1.0)
    width = F.when(ahead, K.INTERVAL_Z * F.col("sigma")).otherwise(0.0)
    return out.withColumns({"ratio": ratio, "ratio_low": ratio * F.exp(-width), "ratio_high": ratio * F.exp(width),
                            "target_period": F.add_months("origin_period", F.greatest(F.col("horizon"), F.lit(0)))})


# --- fixed values: limits and scores of the forecast grade ---

def fc_grade(level: Column, basis: Column) -> Column:
    score = (F.lit(3.0) - 0.42 * F.col("horizon") / 12.0
             + F.when(level == "local_authority", 0.5).when(level.isin("region", "country"), -0.3).otherwise(0.0)
             + F.when(F.col("months") >= 240, 0.3).otherwise(0.0) - F.when(F.col("residual_sigma") > 0.05, 0.4).otherwise(0.0)
             - F.when(basis != "backtest", 0.5).otherwise(0.0))
    s = F.round(score, 9)
    return F.when(s >= 2.6, "HIGH").when(s >= 1.4, "MEDIUM").when(s >= 0.3, "LOW").otherwise("VERY_LOW")


def fc_fallback(requests: DataFrame, fits: DataFrame) -> DataFrame:
    """First fit long enough: (area, segment), (area, all), then the request's own nation."""
    nations = fits.where("area_level = 'country'").groupBy("country").agg(F.min("area_code").alias("_nation"))
    asked = requests.join(nations, "country", "left").withColumn("_o", F.explode(F.array(
        F.struct(F.lit(0).alias("p"), F.col("requested_area").alias("area_code"), F.col("requested_segment").alias("segment")),
        F.struct(F.lit(1).alias("p"), F.col("requested_area").alias("area_code"), F.lit("all").alias("segment")),
        F.struct(F.lit(2).alias("p"), F.col("_nation").alias("area_code"), F.lit("all").alias("segment"))))).select(*requests.columns, "_o.*")
    facts = [c for c in fits.columns if c not in ("country", "area_code", "segment")]
    found = asked.join(fits, ["country", "area_code", "segment"])
    best = found.groupBy(*requests.columns).agg(F.min_by(F.struct("area_code", "segment", *facts), "p").alias("f"))
    return best.select(*requests.columns, "f.*")


def fc_market(places: DataFrame, years: DataFrame, indices: DataFrame, links: DataFrame, sigma: DataFrame | None, policy: ForecastPolicy) -> DataFrame:
    """Market movement per (country, district, type) to the middle of each wanted year."""
    fits = fc_fit(indices, policy)
    requests = places.join(links.select("country", "district", F.col("area_code").alias("requested_area")), ["country", "district"], "left").withColumns(
        {"requested_area": F.coalesce("requested_area", F.lit("")), "requested_segment": F.coalesce("property_type", F.lit("all"))})
    fitted = fc_fallback(requests.select("country", "requested_area", "requested_segment").distinct(), fits)
    wanted = years.agg(F.collect_set("year").alias("_y")).scalar()  # calendar years
    ahead = fitted.withColumn("year", F.explode(wanted)).withColumn(
        "horizon", (F.col("year") * 12 + 6 - month_no(F.col("origin_period"))).cast("int")).where(F.col("horizon").between(1, policy.max_horizon))
    out = fc_project(ahead, policy, sigma).withColumn("forecast_confidence", fc_grade(F.col("area_level"), F.col("interval_basis")))
    keep = ["country", "requested_area", "requested_segment", "year", "area_code", "area_level", "segment", "origin_period", "target_period", "horizon", "ratio", "ratio_low",
            "ratio_high", "sigma", "interval_basis", "forecast_confidence", "months", "g_used", "g_short", "shrinkage", "residual_sigma"]
    joined = requests.join(out.select(*keep), ["country", "requested_area", "requested_segment"])
    return joined.select("country", "district", "property_type", *keep[3:])


def yearly_pct(monthly: Column, share: float = 1.0) -> Column:
    return F.round((F.exp(monthly * share * 12) - 1) * 100, 2)


def fc_describe(policy: ForecastPolicy) -> list[Column]:
    """Readable diagnostics of a fit."""
    return [yearly_pct(F.col("g_used")).alias("fitted_annual_pct"), yearly_pct(F.col("g_used"), policy.drift).alias("applied_annual_pct"),
            yearly_pct(F.col("g_short")).alias("recent_annual_pct"), F.round("shrinkage", 3).alias("national_weight"),
            F.round("residual_sigma", 4).alias("residual_sd"), F.lit(round(math.log(0.5) / math.log(policy.damping), 1)).alias("momentum_half_life"),
            F.when(F.col("months") < policy.long_months, "history shorter than the long window").otherwise("").alias("note")]


def fc_area(stats: DataFrame, links: DataFrame, indices: DataFrame, sigma: DataFrame | None, policy: ForecastPolicy, year: int) -> DataFrame:
    """Latest area medians projected with each area's own series; omitted where none fits.

    `links` maps (country, area_level, area_code) to `index_area_code`.
    """
    latest_year = stats.groupBy("country").agg(F.max("year").alias("year"))
    rows = stats.where("median_price IS NOT NULL").join(latest_year, ["country", "year"], "left_semi").join(
        links, ["country", "area_level", "area_code"])
    requests = rows.select("country", F.col("index_area_code").alias("requested_area"), F.col("segment").alias("requested_segment")).distinct()
    fitted = fc_fallback(requests, fc_fit(indices, policy)).withColumn(
        "horizon", (F.lit(year * 12 + 6) - month_no(F.col("origin_period"))).cast("int")).where(F.col("horizon").between(1, policy.max_horizon))
    moved = fc_project(fitted, policy, sigma).withColumn("confidence", fc_grade(F.col("area_level"), F.col("interval_basis"))).select(
        "country", F.col("requested_area").alias("index_area_code"), F.col("requested_segment").alias("segment"), "ratio", "confidence",
        F.col("area_code").alias("forecast_market"))
    return rows.join(moved, ["country", "index_area_code", "segment"]).withColumns(
        {"median_price": F.col("median_price") * F.col("ratio"), "data_year": F.col("year"), "year": F.lit(year)})


# --- rolling evaluation ------------------------------------------------------

def origins(indices: DataFrame, policy: ForecastPolicy) -> DataFrame:
    """Fits at each January, seeing only the months up to it, with the later actual movements."""
    levels = ["local_authority", "region", "country"]
    reach = policy.min_months + max(policy.horizons)
    points = positions(indices.where(F.col("segment") == "all").where(F.col("area_level").isin(levels)))
    long = points.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= reach).select(*SERIES)
    fits = tail_fits(points.join(long, SERIES, "left_semi"), policy)
    january = (F.month("period") == 1) & (F.year("period") >= policy.min_origin_year) & (F.col("months") >= policy.min_months)
    w = Window.partitionBy(*SERIES).orderBy("x")
    later = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("y", h).over(w).alias("y")) for h in policy.horizons])
    return shrink(fits.withColumn("_later", later).where(january), national_drift(fits, policy), policy)


def origin_errors(indices: DataFrame, policy: ForecastPolicy) -> DataFrame:
    """Predicted minus actual in log terms per series, origin and horizon, with two baselines."""
    rows = origins(indices, policy).withColumn("_a", F.explode("_later")).where("_a.y IS NOT NULL")
    actual = F.col("_a.y") - F.col("y")
    rows = rows.withColumns({"horizon": F.col("_a.horizon"), "actual": actual}).drop("_later", "_a")
    return rows.withColumns({"error": log_change(F.col("horizon"), policy) - F.col("actual"), "error_flat": -F.col("actual"),
                             "error_linear": F.col("g_short") * F.col("horizon") - F.col("actual")})


def agg_backtest(errors: DataFrame, policy: ForecastPolicy) -> DataFrame:
    """Per horizon: size, error measures, spread, and skill against both baselines."""
    from ..functions.quantiles import exact_quantiles

    def rmse(column):
        return F.sqrt(F.avg(F.col(column) * F.col(column)))
    rows = errors.withColumn("_pp", F.abs(F.exp("error") - 1) * 100)
    out = exact_quantiles(rows, ["horizon"], {"_pp": {"median_ae_pp": 0.5}}, also=[
        F.count(F.lit(1)).alias("n"), F.avg("_pp").alias("mae_pp"), rmse("error").alias("rmse"), F.avg("error").alias("bias"),
        F.stddev_pop("error").alias("sigma"), rmse("error_flat").alias("rmse_flat"), rmse("error_linear").alias("rmse_linear")])
    return out.where(F.col("n") >= policy.min_observations).withColumns(
        {"skill_flat": 1 - F.col("rmse") / F.col("rmse_flat"), "skill_linear": 1 - F.col("rmse") / F.col("rmse_linear")})


def sigma_table(backtest: DataFrame) -> DataFrame:
    return backtest.select("horizon", F.round("sigma", 5).alias("sigma"))


def fc_calibrate(errors: DataFrame, policy: ForecastPolicy) -> DataFrame:
    """Pooled error of each shrinkage setting over the same fits, best first.

    The projection is linear in both settings, so six sums per pass serve the whole grid and the
    errors are read once instead of once per setting.
    """
    a = F.col("g_used") * F.col("horizon")
    phi = policy.damping
    b = F.col("momentum") * (phi * (1 - F.pow(F.lit(phi), F.col("horizon"))) / (1 - phi))
    c = F.col("actual")
    sums = errors.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x * y).alias(n) for n, x, y in (
        ("aa", a, a), ("bb", b, b), ("cc", c, c), ("ab", a, b), ("ac", a, c), ("bc", b, c))])
    grid = F.array(*[F.struct(F.lit(d).alias("drift"), F.lit(m).alias("momentum")) for d in K.DRIFT_GRID for m in K.MOMENTUM_GRID])
    rows = sums.withColumn("_g", F.explode(grid)).select("*", "_g.drift", "_g.momentum")
    d, m = F.col("drift"), F.col("momentum")
    square = d * d * F.col("aa") + m * m * F.col("bb") + F.col("cc") + 2 * d * m * F.col("ab") - 2 * d * F.col("ac") - 2 * m * F.col("bc")
    pooled, flat = F.sqrt(F.greatest(square, F.lit(0.0)) / F.col("n")), F.sqrt(F.col("cc") / F.col("n"))
    return rows.select("drift", "momentum", "n", pooled.alias("pooled_rmse"), (1 - pooled / flat).alias("skill_flat")).orderBy("pooled_rmse", "drift", "momentum")
