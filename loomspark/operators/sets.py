"""Unions and top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tagged_union(frames: dict[str, DataFrame], tag: str = "origin") -> DataFrame:
    """UNION ALL on the common columns, with the name of each row's frame."""
    common = None
    for f in frames.values():
        common = set(f.columns) if common is None else common & set(f.columns)
    out = None
    for name, f in frames.items():
        part = f.select(*sorted(common)).withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def split(df: DataFrame, names: list[str], tag: str = "origin") -> dict[str, DataFrame]:
    return {n: df.filter(F.col(tag) == n).drop(tag) for n in names}


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows; the order has to end in a tie-break."""
    return df.orderBy(*order).limit(k)


def top_in_group(df: DataFrame, k: int, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= k).drop("__n")


def positions(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Positions from 0 after a sort of an aggregate: one task, so for reports."""
    return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def nth(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The row at place k from 0 of a total order, as a table of one row: the first k + 1 are found without a sort of all."""
    return df.orderBy(*order).offset(k).limit(1)
