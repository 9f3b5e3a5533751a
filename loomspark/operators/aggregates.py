"""Aggregates and the reports made of them.  Null group keys are dropped, as the reference semantics has it."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.operators.columns import numeric
from loomspark.operators.ranks import quantiles, ranked_values, small


def by(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Group by keys that aren't null."""
    return df.dropna(subset=keys).groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def all_numeric(df: DataFrame, keys: list[str], how=F.avg) -> DataFrame:
    return by(df, keys, **{c: how(c) for c in numeric(df) if c not in keys})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share)"""
    counts = by(df, [column], n=F.count("*"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__total")).drop("__total")  # one row


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of each column, a row each."""
    at = [0.25, 0.5, 0.75]
    plain = lambda c: [F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.min(c).cast("double").alias("min")]
    if small(df):
        wide = df.agg(*[F.struct(*plain(c), F.percentile(c, F.array(*map(F.lit, at))).alias("q"), F.max(c).cast("double").alias("max")).alias(f"c{i}") for i, c in enumerate(columns)])
    else:
        wide = df.agg(*[F.struct(*plain(c), F.max(c).cast("double").alias("max")).alias(f"p{i}") for i, c in enumerate(columns)])
        for i, c in enumerate(columns):
            wide = wide.crossJoin(F.broadcast(quantiles(df, c, at).withColumnRenamed("q", f"q{i}")))  # one row
        wide = wide.select(*[F.col(f"p{i}").withField("q", F.col(f"q{i}")).alias(f"c{i}") for i in range(len(columns))])
    one = wide.select(F.explode(F.array(*[F.struct(*[F.col(f"c{i}.{n}").alias(n) for n in ("column", "count", "mean", "std", "min", "q", "max")]) for i in range(len(columns))])).alias("r"))
    return one.select("r.column", "r.count", "r.mean", "r.std", "r.min", F.col("r.q")[0].alias("q25"), F.col("r.q")[1].alias("q50"), F.col("r.q")[2].alias("q75"), "r.max")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of all column pairs, both ways and with themselves, in one pass."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("corr")) for i, p in enumerate(pairs) for a, b in (p, p[::-1])]
    rows += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("corr")) for c in columns]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``; give descending columns for the last."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def majority(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The most frequent label; the smallest of equals."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("__c"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("__c")).alias("c"), F.col(label).alias("label"))).alias("m")).select(*keys, F.col("m.label").alias(label))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def histogram_width(df: DataFrame, column: str, width: float) -> DataFrame:
    return df.groupBy((F.floor(F.col(column) / width).cast("long")).alias("bin")).agg(F.count("*").alias("n"))


def histogram_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal left-closed bins from 0; the largest value is in the last one."""
    edge = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    place = F.floor(F.try_divide(F.col(column) - F.col("__lo"), F.col("__hi") - F.col("__lo")) * bins)
    return df.crossJoin(F.broadcast(edge)).groupBy(F.least(F.lit(bins - 1), F.coalesce(place, F.lit(0))).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def zero_filled(df: DataFrame, value: Column, n: int, name: str) -> DataFrame:
    """Counts of 0 to n - 1, also where nothing is counted."""
    counts = df.groupBy(value.cast("int").alias(name)).agg(F.count("*").alias("n"))
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias(name)).join(counts, name, "left").select(name, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def box_summary(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    at = [0.25, 0.5, 0.75]
    if small(df):
        out = by(df, keys, low=F.min(column), q=F.percentile(column, F.array(*map(F.lit, at))), high=F.max(column))
    else:
        out = by(df, keys, low=F.min(column), high=F.max(column)).join(quantiles(df.dropna(subset=keys), column, at, keys), keys)
    return out.select(*keys, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "high")


def group_median(df: DataFrame, keys: list[str], column: str, out: str = "median") -> DataFrame:
    """Exact medians of groups that may be of any size."""
    return quantiles(df.dropna(subset=keys), column, [0.5], keys).select(*keys, F.col("q")[0].alias(out))


def share_of(df: DataFrame, keys: list[str], within: list[str], digits: int = 2) -> DataFrame:
    """Percentages of a group's count in that of its ``within`` group."""
    counts = by(df, keys, n=F.count("*"))
    total = F.sum("n").over(Window.partitionBy(*within))
    return counts.withColumn("pct", F.round(F.col("n").cast("double") / total * 100, digits))


def success_rate(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Counts, successes, failures and the percentage."""
    out = by(df, keys, n=F.count(flag), hits=F.sum(F.col(flag).cast("long")))
    return out.withColumn("misses", F.col("n") - F.col("hits")).withColumn("pct", F.col("hits") * F.lit(100.0).cast("double") / F.col("n"))


def gap_pct(a: Column, b: Column, digits: int = 2) -> Column:
    return F.round(F.abs(a - b) / b * 100, digits)


def tree(df: DataFrame, outer: str, inner: str, leaf: list[str], order: str) -> DataFrame:
    """outer, then inner, then leaves, as nested arrays in order."""
    leaves = df.groupBy(outer, inner).agg(F.array_sort(F.collect_list(F.struct(*([order] + [c for c in leaf if c != order])))).alias("children"))
    return leaves.groupBy(outer).agg(F.array_sort(F.collect_list(F.struct(F.col(inner).alias("name"), "children"))).alias("children"))


def pairs_to_map(df: DataFrame, keys: list[str], k: str, v: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias("map"))


def average_rank(value: Column, keys: list[Column] = ()) -> Column:
    """Ranks from 1 where equal values share their mean rank."""
    w = Window.partitionBy(*keys).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0).cast("double")


def rank_table(df: DataFrame, column: str, out: str, rows: int | None = None) -> DataFrame:
    """(column, out): each distinct value and its average rank; ``rows``: how many ``df`` has, where that is known."""
    return ranked_values(df, column, rows=rows).select(column, (F.col("before") + (F.col("n") + 1) / F.lit(2.0).cast("double")).alias(out))


def value_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Average ranks over a whole table: counts of distinct values are ranked instead of rows, and joined back."""
    return df.join(rank_table(df, column, out), column)


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the curve by rank sums; one row."""
    ranked = ranked_values(df.select(F.col(score).alias("v"), F.col(label).cast("long").alias("y")), "v", p=F.sum("y")).withColumn("r", F.col("before") + (F.col("n") + 1) / F.lit(2.0).cast("double"))
    one = ranked.agg(F.sum(F.col("r") * F.col("p")).alias("ranks"), F.sum("p").cast("double").alias("p"), F.sum(F.col("n") - F.col("p")).cast("double").alias("q"))
    return one.select(F.try_divide(F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"))


def errors(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """mse, rmse, mae and r2 in one pass; one row."""
    t, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    one = df.agg(F.avg(F.pow(t - p, 2)).alias("mse"), F.avg(F.abs(t - p)).alias("mae"), F.var_pop(t).alias("__v"))
    return one.select("mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide("mse", "__v")).alias("r2"))
