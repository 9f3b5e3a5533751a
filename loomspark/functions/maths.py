"""Numeric functions, bins and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def log1p(c: Column) -> Column:
    return F.log1p(c)


def ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def logit(p: Column, edge: float = 1e-10) -> Column:
    p = clip(p, edge, 1 - edge)
    return F.ln(p / (1 - p))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Null stays null."""
    out = c
    if high is not None:
        out = F.when(out > high, F.lit(high)).otherwise(out)
    if low is not None:
        out = F.when(out < low, F.lit(low)).otherwise(out)
    return out


def rounded(c: Column, digits: int) -> Column:
    """Halves away from zero, of the scaled double as it is; ``F.round`` takes the shortest decimal of the unscaled one, which differs where that is a half."""
    return F.round(c * 10.0**digits) / 10.0**digits


def exponential(x: Column, a: float, b: float, c: float) -> Column:
    """a * 2 ** ((x - c) * b)"""
    return a * F.pow(F.lit(2.0), (x - c) * b)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    lon1, lat1, lon2, lat2 = (F.radians(c) for c in (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def within(distance: Column, most: float) -> Column:
    return F.when(distance > most, 0).otherwise(1)


def threshold_bins(c: Column, edges: tuple[float, ...]) -> Column:
    """Bin numbers from 0, right-closed."""
    out = None
    for i, e in enumerate(edges):
        out = F.when(c <= e, i) if out is None else out.when(c <= e, i)
    return out.when(c > edges[-1], len(edges))


def ten_buckets(c: Column, largest: Column, n: int = 10) -> Column:
    """n equal left-closed buckets over [0, largest + 1); negative values have none."""
    return F.when(c >= 0, F.floor(c / (largest + 1) * n)).cast("int")


def cut_equal(df: DataFrame, column: str, n: int, out: str) -> DataFrame:
    """n right-closed bins of equal width from 1; the smallest value is in bin 1."""
    edge = df.agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / n
    bin_ = F.greatest(F.lit(1), F.least(F.lit(n), F.ceil(F.try_divide(F.col(column) - F.col("__lo"), width))))
    return df.crossJoin(F.broadcast(edge)).withColumn(out, bin_.cast("int")).drop("__lo", "__hi")  # one row


def cut_quantiles(df: DataFrame, column: str, q: int, out: str, fit: DataFrame | None = None) -> DataFrame:
    """q bins from 1 by exact quantiles of ``fit`` (or of ``df`` itself), right-closed."""
    from loomspark.operators.ranks import quantiles

    at = [i / q for i in range(1, q)]
    edges = quantiles(df if fit is None else fit, column, at).withColumnRenamed("q", "__q")
    bin_ = None
    for i in range(q - 1):
        test = F.col(column) <= F.col("__q")[i]
        bin_ = F.when(test, i + 1) if bin_ is None else bin_.when(test, i + 1)
    return df.crossJoin(F.broadcast(edges)).withColumn(out, bin_.when(F.col(column).isNotNull(), q)).drop("__q")  # one row


def over_mean(df: DataFrame, column: str, out: str) -> DataFrame:
    mean = df.agg(F.avg(column).alias("__m"))
    return df.crossJoin(F.broadcast(mean)).withColumn(out, (F.col(column) > F.col("__m")).cast("int")).drop("__m")  # one row


def hash_bucket(c: Column) -> Column:
    """0 to 255: the last byte of the md5 of a 64-bit number's bytes, lowest first."""
    text = F.lpad(F.hex(c.cast("long")), 16, "0")
    little = F.concat(*[F.substring(text, p, 2) for p in range(15, 0, -2)])
    return F.conv(F.right(F.md5(F.unhex(little)), F.lit(2)), 16, 10).cast("int")
