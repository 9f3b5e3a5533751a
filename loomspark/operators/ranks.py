"""Ranks, exact quantiles and running counts of ordered values, without a task that holds all of them.

Rows are first counted by value (map-side).  A large table's distinct values
are then laid into buckets by splitters from a bounded sample of them, so that
each bucket is a window of its own and only totals of buckets, at most
``BUCKETS`` a key, are ordered in one place.  Splitters change where work
runs, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Planner's bytes up to which a table's distinct values are one window, buckets beyond it, and values sampled for each bucket.
SMALL, BUCKETS, SAMPLED = 64 << 20, 256, 16


def small(df: DataFrame, rows: int | None = None) -> bool:
    """``rows``: how many there are, where that is known; the planner multiplies the sizes of joined tables."""
    return (int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if rows is None else 24 * rows) <= SMALL


def splitters(df: DataFrame, column: str, rows: int | None = None) -> list:
    """Values that cut the distinct values of a column into about equal parts: every so many of those with the least hashes."""
    if small(df, rows):
        return []
    some = df.select(F.col(column).alias("v")).filter("v is not null").distinct().orderBy(F.xxhash64("v"), "v").limit(BUCKETS * SAMPLED).collect()
    values = sorted(r.v for r in some)
    return values[SAMPLED::SAMPLED]


def bucket_of(value: Column, edges: list) -> Column:
    """How many of the edges are at or below a value."""
    return F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= value)) if edges else F.lit(0)


def running_before(df: DataFrame, sums: dict[str, str], order: list[str], edges: list, keys: list[str] = ()) -> DataFrame:
    """``df`` with sums of columns over all rows before, by ``order`` within ``keys``.  ``sums``: new name to column; ``edges`` are of the first column of the order."""
    keys = list(keys)
    if not edges:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})
    cut = df.withColumn("__bucket", bucket_of(F.col(order[0]), edges))
    inner = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # totals of buckets
    totals = cut.groupBy(*keys, "__bucket").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = totals.select(*keys, "__bucket", *[F.coalesce(F.sum(f"__t_{n}").over(outer), F.lit(0)).alias(f"__o_{n}") for n in sums])
    placed = cut.withColumns({n: F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()}).join(before, [*keys, "__bucket"])
    return placed.withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in sums}).drop("__bucket", *[f"__o_{n}" for n in sums])


def ranked_values(df: DataFrame, column: str, keys: list[str] = (), rows: int | None = None, **also: Column) -> DataFrame:
    """(keys, column, n, before): each distinct value, its rows, and the rows of smaller values.  ``rows``: as in ``small``.  ``also``: further aggregates of a value's rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in also.items()])
    return running_before(counts, {"before": "n"}, [column], splitters(df, column, rows), keys)


def quantiles(df: DataFrame, column: str, at: list[float], keys: list[str] = ()) -> DataFrame:
    """(keys, q): exact quantiles, interpolated between neighbours; one row where there are no keys."""
    if small(df):
        # a bounded table: the built-in aggregate is the same in one pass
        q = F.percentile(F.col(column).cast("double"), F.array(*[F.lit(float(a)) for a in at])).alias("q")
        return df.groupBy(*keys).agg(q) if keys else df.agg(q)
    ranked = ranked_values(df.select(*keys, column), column, keys)
    totals = ranked.groupBy(*keys).agg(F.sum("n").alias("total"))
    held = ranked.join(totals, list(keys)) if keys else ranked.crossJoin(F.broadcast(totals))  # one row

    def value(a: float, up: bool) -> Column:
        place = F.lit(float(a)) * (F.col("total") - 1)
        i = F.ceil(place) if up else F.floor(place)
        return F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col(column).cast("double")))

    both = [F.struct(value(a, False).alias("low"), value(a, True).alias("high"), F.max(F.lit(float(a)) * (F.col("total") - 1) - F.floor(F.lit(float(a)) * (F.col("total") - 1))).alias("part")) for a in at]
    found = held.groupBy(*keys).agg(F.array(*both).alias("pairs")) if keys else held.agg(F.array(*both).alias("pairs"))
    return found.select(*keys, F.transform("pairs", lambda p: p["low"] + (p["high"] - p["low"]) * p["part"]).alias("q"))
