"""Ways to deal a stream's rows to instances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shuffled(df: DataFrame, n: int) -> DataFrame:
    """Round robin over n instances."""
    return df.repartition(n)


def by_fields(df: DataFrame, n: int, *fields: str) -> DataFrame:
    """Rows that are equal in the fields go to one instance."""
    missing = [f for f in fields if f not in df.columns]
    if missing or not fields:
        raise ValueError(f"no fields to deal by: {missing or 'none named'}")
    return df.repartition(n, *fields)


def to_all(df: DataFrame, n: int) -> DataFrame:
    """Every instance gets every row: an `instance` column from 0."""
    return df.withColumn("instance", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
