"""Splits and samples.  Random ones go by a seeded hash of a key, so none depends on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.maths import hash_bucket
from loomspark.operators.columns import uniform
from loomspark.operators.ranks import quantiles


def by_hash(df: DataFrame, key: str, ratio: float) -> tuple[DataFrame, DataFrame]:
    """(rest, test): rows never change sides when the table grows."""
    test = hash_bucket(F.col(key)) < 256 * ratio
    return df.filter(~test), df.filter(test)


def random(df: DataFrame, key: str, ratio: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rest, test): each row by a seeded hash of its key, so that other files or partitions give the same rows."""
    test = uniform(F.col(key), seed) < ratio
    return df.filter(~test), df.filter(test)


def stratified(df: DataFrame, stratum: str, key: str, ratio: float) -> DataFrame:
    """``in_test`` for exactly round(ratio * n) rows of every stratum, picked by the hash of their key."""
    spread = F.md5(F.col(key).cast("string"))
    w = Window.partitionBy(stratum)
    return df.withColumn("in_test", F.row_number().over(w.orderBy(spread, key)) <= F.round(F.count("*").over(w) * ratio))


def ordered(df: DataFrame, order: str, ratio: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(first, rest): the first part of an order by its exact quantile, which needs no global sort of rows."""
    edge = quantiles(df, order, [ratio]).select(F.col("q")[0].alias("__e"))
    held = df.crossJoin(F.broadcast(edge))  # one row
    low = F.col(order).cast("double") <= F.col("__e")
    return held.filter(low).drop("__e"), held.filter(~low).drop("__e")


def permuted(df: DataFrame, key: str, seed: int, n: int | None = None) -> DataFrame:
    """Rows in the order of a seeded hash of their key; ``n`` of them are found by each task's own first ones, without a sort of all."""
    out = df.orderBy(uniform(F.col(key), seed), key)
    return out.limit(n) if n else out


def folds(key: str, n: int = 10) -> Column:
    """The number of a row's fold by its key."""
    return F.pmod(F.col(key), F.lit(n)).cast("int")
