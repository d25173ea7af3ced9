"""Operations on typed tables: aggregates, ordering, first row, changes, and column statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aggregated(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """One row: count, and sum, max and min of a column as doubles (0 without rows)."""
    rows = df if where is None else df.where(where)
    value = F.col(column).cast("double")
    zero = F.lit(0.0)
    return rows.agg(F.count("*").alias("count"), F.coalesce(F.sum(value), zero).alias("sum"), F.coalesce(F.max(value), zero).alias("max"), F.coalesce(F.min(value), zero).alias("min"))


def projected(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns by name; an unknown one raises KeyError."""
    for c in columns:
        if c not in df.columns:
            raise KeyError(f"unknown column {c!r}")
    return df.select(*columns)


def ordered(df: DataFrame, by: list[tuple[str, str]], descending: bool = False) -> DataFrame:
    """Rows by columns cast to the given types, all in one direction."""
    keys = [F.col(c).cast(kind) for c, kind in by]
    return df.orderBy(*[k.desc() if descending else k.asc() for k in keys])


def first_row(df: DataFrame, where: Column, columns: list[str]):
    """The first matching row; LookupError if there is none."""
    row = projected(df.where(where), columns).first()
    if row is None:
        raise LookupError("No record found")
    return row


def updated(df: DataFrame, where: Column, values: dict) -> DataFrame:
    """All rows, with the given values in those that match."""
    return df.withColumns({c: F.when(where, F.lit(v) if not isinstance(v, Column) else v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def deleted(df: DataFrame, where: Column | None = None) -> DataFrame:
    """The rows that don't match (a null condition doesn't); without a condition none."""
    return df.limit(0) if where is None else df.where(~F.coalesce(where, F.lit(False)))


def upserted(df: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """df with the rows of changes in place of those with the same keys, and the others of changes added.

    Columns that changes lacks keep their value, or are null in added rows. One full join on the keys.
    """
    new = changes.select(*keys, F.struct(*[changes[c] for c in changes.columns if c not in keys]).alias("_new"))
    both = df.join(new, keys, "full")
    return both.select(*[c if c in keys or c not in changes.columns else F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in df.columns])


def mean_and_deviation(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Mean and population standard deviation."""
    return df.groupBy(*by).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def normalised(df: DataFrame, column: str, *by: str) -> DataFrame:
    """column scaled to 0..1 within groups; a constant column is 0. Bounds are aggregates that are joined, not windows."""
    bounds = df.groupBy(*by).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    rows = df.join(bounds, list(by)) if by else df.crossJoin(F.broadcast(bounds))  # one row
    span = F.col("_high") - F.col("_low")
    return rows.withColumn("normalised", F.when(span == 0, 0.0).otherwise((F.col(column) - F.col("_low")) / span)).drop("_low", "_high")


def numbered(df: DataFrame, column: str, *by: str) -> DataFrame:
    """The place (from 0) of each row by a column within its group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(column)) - 1)
