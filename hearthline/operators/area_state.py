"""Area statistics kept up to date from a stored state of counted sales.

The state holds, by all area codes together, type, year, price, price per square metre and position, how often they occur
together. A batch of sales appends its rows as they are, the old versions of sales that it replaced append theirs with a
minus sign; nothing stored is rewritten, nothing is grouped to be appended, and the sales themselves are never read again.
The state is partitioned by year, so only the years of a batch are read; of those, only the areas it touches are counted by
bin, and only bins that hold a wanted rank are put in order. `compacted` adds the appended rows up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..session import cut_lineage
from . import area_stats as A

AREAS = ["country", "area_level", "area_code", "year"]


def _levels() -> list[str]:
    return list(K.LEVEL_MIN_SALES)


def _append(path: str, counts: DataFrame) -> None:
    counts.write.partitionBy("year").mode("append").parquet(path)


def start(path: str, sales: DataFrame) -> None:
    """A state of the sales loaded so far."""
    _append(path, A.finest_rows(sales, _levels()))


def add(path: str, batch: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """Append a batch to the state and return the areas and years it touches.

    `replaced` holds the old versions of sales that the batch changed; the areas they leave are touched, too.
    """
    change = A.finest_rows(batch, _levels())
    if replaced is not None:
        change = change.unionByName(A.finest_rows(replaced, _levels()).withColumn("_n", -F.col("_n")))
    _append(path, change)
    moved = batch if replaced is None else batch.select(*_touching()).unionByName(replaced.select(*_touching()))
    return A.with_levels(A.evidence(moved.select(*_touching())), _levels()).select(*AREAS).distinct()


def _touching() -> list[str]:
    return [*dict.fromkeys(["country", "year", "market_value_basis", "is_residential", "lat", "lon", *_levels()])]


def settled(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """Rows with everything appended so far added up; those that no sale has any more are gone."""
    stored = spark.read.parquet(path)
    stored = stored if years is None else stored.where(F.col("year").isin(years))  # prunes folders
    keys = [c for c in stored.columns if c != "_n"]
    return stored.groupBy(*keys).agg(F.sum("_n").alias("_n")).where("_n > 0")


def refreshed(stored: DataFrame, path: str, touched: DataFrame) -> DataFrame:
    """The statistics after a batch: groups it touches from the state, all others as they were."""
    years = [r.year for r in touched.select("year").distinct().collect()]  # calendar years: a few dozen at most
    fresh = A.stats_of_rows(cut_lineage(settled(stored.sparkSession, path, years)), _levels(), touched=touched)
    return stored.join(touched, AREAS, "left_anti").unionByName(fresh)


def compacted(spark: SparkSession, path: str, into: str) -> None:
    """The state written anew, each value once."""
    _append(into, settled(spark, path))
