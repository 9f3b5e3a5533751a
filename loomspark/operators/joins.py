"""Joins.  Sides are broadcast by Spark's own size check; hints stand only where the size is one row or a literal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left(df: DataFrame, other: DataFrame, on: list[str] | str | dict[str, str]) -> DataFrame:
    """Left equi-join on shared names, or on differently named keys, which are all kept."""
    if isinstance(on, dict):
        test = None
        for a, b in on.items():
            one = df[a] == other[b]
            test = one if test is None else test & one
        return df.join(other, test, "left")
    return df.join(other, on, "left")


def first_match(df: DataFrame, other: DataFrame, on: list[str], key: str, order: list[Column]) -> DataFrame:
    """Left join that may fan out, then one row for each ``key``: the first in ``order``."""
    rows = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.join(other, on, "left").withColumn("__n", rows).filter("__n = 1").drop("__n")


def lookup(c: Column, lists: dict[str, list]) -> Column:
    """The name of the first list that holds the value, else null."""
    out = None
    for name, values in lists.items():
        out = F.when(c.isin(values), name) if out is None else out.when(c.isin(values), name)
    return out


def nearest_km(df: DataFrame, points: DataFrame, lon: str, lat: str, plon: str, plat: str, out: str, most: int = 100_000) -> DataFrame:
    """Whole kilometres to the nearest of ``points``, a checked small set that travels as one array."""
    from loomspark.functions.maths import haversine_km

    n = points.count()
    if n > most:
        raise ValueError(f"{n} points are more than {most}; cut them into cells first")
    one = points.agg(F.collect_list(F.struct(F.col(plon).alias("lon"), F.col(plat).alias("lat"))).alias("__p"))
    distance = F.transform("__p", lambda p: haversine_km(F.col(lon), F.col(lat), p["lon"], p["lat"]).cast("int"))
    return df.crossJoin(F.broadcast(one)).withColumn(out, F.array_min(distance)).drop("__p")


def with_scalars(df: DataFrame, one: DataFrame) -> DataFrame:
    """The columns of a one-row frame on every row."""
    return df.crossJoin(F.broadcast(one.limit(1)))


def grid(spark, x: tuple[int, int, int], y: tuple[int, int, int]) -> DataFrame:
    """All (x, y) of two integer ranges (start, stop, step; the stop is excluded)."""
    side = lambda r, name: F.explode(F.sequence(F.lit(r[0]), F.lit(r[1] - 1), F.lit(r[2]))).alias(name)
    return spark.range(1).select(side(x, "x")).select("x", side(y, "y"))


def each(frames: list[DataFrame], step) -> list[DataFrame]:
    return [f.transform(step) for f in frames]


def aligned(df: DataFrame, other: DataFrame, row_id: str, column: str, out: str | None = None) -> DataFrame:
    """``df`` with a column of another table on the rows of the same id, null where it has none."""
    return df.join(other.select(row_id, F.col(column).alias(out or column)), row_id, "left")


def by_position(frames: dict[str, DataFrame], order: str, column: str) -> DataFrame:
    """(position, one column for each table): rows that stand at the same place of their table's order, numbered by running counts."""
    from loomspark.operators.ranks import running_before, splitters

    out = None
    for name, f in frames.items():
        one = running_before(f.select(order, F.col(column).alias(name)).withColumn("__one", F.lit(1)), {"position": "__one"}, [order], splitters(f, order)).select("position", name)
        out = one if out is None else out.join(one, "position", "full")
    return out
