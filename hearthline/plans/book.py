"""How queries are registered beside the SQL that states them a second time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def book():
    """A module's query and SQL tables, and the decorator that fills them."""
    queries, oracle = {}, {}

    def query(name: str, sql: str | None = None):
        def add(fn):
            queries[name] = fn
            if sql is not None:
                oracle[name] = sql
            return fn
        return add
    return queries, oracle, query


def rounded(df: DataFrame, digits: int = 4, keep: list[str] = ()) -> DataFrame:
    """Round computed doubles, so that the last bits of different libraries do not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c)
                       for c, t in df.dtypes])
