"""Projections, predicates and null handling: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.ranks import quantiles, small


def project(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns; names that aren't there become null columns."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def at_positions(df: DataFrame, start: int | None = None, stop: int | None = None, picks: list[int] | None = None) -> DataFrame:
    return df.select(*([df.columns[i] for i in picks] if picks is not None else df.columns[start:stop]))


def insert_at(df: DataFrame, position: int, name: str, value: Column) -> DataFrame:
    order = [c for c in df.columns if c != name]
    return df.withColumn(name, value).select(*order[:position], name, *order[position:])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Unknown names are ignored."""
    return df.withColumnsRenamed(names)


def open_interval(df: DataFrame, column: str, low, high) -> DataFrame:
    """Both ends are excluded."""
    return df.filter((F.col(column) > low) & (F.col(column) < high))


def in_box(df: DataFrame, **bounds: tuple[float, float]) -> DataFrame:
    """Strictly inside an interval of each named column."""
    for column, (low, high) in bounds.items():
        df = open_interval(df, column, low, high)
    return df


def same(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) == F.col(b))


def without(df: DataFrame, mask: Column) -> DataFrame:
    """Drop rows where the mask is true; a null mask keeps its row."""
    return df.filter(~F.coalesce(mask, F.lit(False)))


def fill_statistic(df: DataFrame, column: str, fit: DataFrame | None = None, statistic=None) -> DataFrame:
    """Null filled by an exact statistic of ``fit`` (or of the frame itself), the median if none is given: a broadcast of one row."""
    source = df if fit is None else fit
    one = source.agg(statistic(column).alias("__s")) if statistic else quantiles(source, column, [0.5]).select(F.col("q")[0].alias("__s"))
    return df.crossJoin(F.broadcast(one)).withColumn(column, F.coalesce(F.col(column).cast("double"), F.col("__s"))).drop("__s")


class MedianImputer:
    """Exact, interpolated medians of all numeric columns."""

    def __init__(self, columns: list[str] | None = None):
        self.columns, self.medians = columns, {}

    def fit(self, df: DataFrame) -> MedianImputer:
        columns = self.columns or numeric(df)
        if small(df):
            row = df.agg(*[F.median(c).alias(c) for c in columns]).first()
            self.medians = {c: row[c] for c in columns}
        else:
            self.medians = {c: (quantiles(df, c, [0.5]).first().q or [None])[0] for c in columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in self.medians.items()})


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed alone, wherever its row lies."""
    return F.conv(F.left(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), F.lit(12)), 16, 10).cast("long") / F.lit(float(1 << 48))


def fill_random(df: DataFrame, column: str, key: str, seed: int) -> DataFrame:
    """Null filled by whole numbers from [mean - std, mean + std), which the row's key and the seed give again."""
    one = df.agg((F.avg(column) - F.stddev(column)).alias("__lo"), (F.avg(column) + F.stddev(column)).alias("__hi"))
    value = F.floor(F.col("__lo") + uniform(F.col(key), seed) * (F.col("__hi") - F.col("__lo")))
    return df.crossJoin(F.broadcast(one)).withColumn(column, F.coalesce(F.col(column).cast("long"), value)).drop("__lo", "__hi")


def null_profile(df: DataFrame) -> DataFrame:
    """(column, present, missing) in one pass over the data."""
    n = F.count("*")
    wide = df.agg(*[F.struct(F.count(c).alias("present"), (n - F.count(c)).alias("missing")).alias(c) for c in df.columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.present").alias("present"), F.col(f"{c}.missing").alias("missing")) for c in df.columns])).alias("r")).select("r.*")


def replace_values(c: Column, values: list, new) -> Column:
    return F.when(c.isin(values), F.lit(new)).otherwise(c)


def mapped(c: Column, table: dict) -> Column:
    """A dictionary lookup; what isn't in it gives null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def numeric(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


def columns_but(df: DataFrame, excluded: list[str]) -> list[str]:
    """The other columns, sorted, so that a model's inputs have one order."""
    return sorted(set(df.columns) - set(excluded))


def slice_rows(df: DataFrame, row_id: str, start: int, stop: int) -> DataFrame:
    """Rows by an explicit row id, the stop excluded: a filter that reaches the scan."""
    return df.filter((F.col(row_id) >= start) & (F.col(row_id) < stop))


def beside(df: DataFrame, other: DataFrame, row_id: str) -> DataFrame:
    """Column concatenation: the columns of two tables side by side, by their row id."""
    clash = (set(df.columns) & set(other.columns)) - {row_id}
    if clash:
        raise ValueError(f"both tables have {sorted(clash)}")
    return df.join(other, row_id)
