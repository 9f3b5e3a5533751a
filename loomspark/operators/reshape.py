"""Reshaping, encoders and scalers."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.ranks import running_before, splitters


#: Rows that a transposed table may have.
MOST_COLUMNS = 1000


def unpivot(df: DataFrame, ids: list[str], decode: dict[str, tuple], names: list[str], value: str) -> DataFrame:
    """A row for each column of ``decode``, whose key attributes become columns ``names``."""
    rows = [F.struct(*[F.lit(a).alias(n) for a, n in zip(attributes, names)], F.col(c).alias(value)) for c, attributes in decode.items()]
    return df.select(*ids, F.explode(F.array(*rows)).alias("__r")).select(*ids, "__r.*")


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """0 to n - 1 in alphabetical order; null stays null.  Distinct labels are ranked and joined back, however many there are."""
    labels = df.select(column).filter(F.col(column).isNotNull()).distinct()
    codes = running_before(labels.withColumn("__n", F.lit(1)), {out: "__n"}, [column], splitters(df, column)).select(column, F.col(out).cast("int").alias(out))
    return df.join(codes, column, "left")


class CategoricalEncoder:
    """One-hot (a 0/1 array, or a sparse index) or ordinal codes of several columns, categories sorted.

    ``unknown``: "error" raises in ``transform``, "ignore" gives zeros; ordinal
    codes can't be ignored.
    """

    def __init__(self, columns: list[str], encoding: str = "onehot", unknown: str = "error", categories: dict[str, list] | None = None):
        if encoding not in ("onehot", "onehot-dense", "ordinal"):
            raise ValueError(f"unknown encoding {encoding}")
        if unknown not in ("error", "ignore"):
            raise ValueError(f"unknown handling {unknown}")
        if encoding == "ordinal" and unknown == "ignore":
            raise ValueError("ordinal codes need a code for every value")
        if categories and any(list(v) != sorted(v) for v in categories.values()):
            raise ValueError("given categories have to be sorted")
        self.columns, self.encoding, self.unknown, self.categories = columns, encoding, unknown, dict(categories or {})

    def fit(self, df: DataFrame) -> CategoricalEncoder:
        rest = [c for c in self.columns if c not in self.categories]
        if rest:
            row = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in rest]).first()
            self.categories |= {c: row[c] for c in rest}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c in self.columns:
            known = F.array(*[F.lit(v) for v in self.categories[c]])
            at = F.array_position(known, F.col(c))
            if self.unknown == "error":
                at = F.when(at > 0, at).otherwise(F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("long"))
            if self.encoding == "ordinal":
                new[f"{c}_code"] = (at - 1).cast("int")
            elif self.encoding == "onehot":
                new[f"{c}_index"] = F.when(at > 0, (at - 1).cast("int"))
            else:
                new[f"{c}_onehot"] = F.array(*[F.when(at == i + 1, 1).otherwise(0) for i in range(len(self.categories[c]))])
        return df.withColumns(new)


def one_hot_columns(df: DataFrame, column: str, levels: list) -> DataFrame:
    """A 0/1 column for each level; all are kept."""
    return df.withColumns({f"{column}_{v}": F.when(F.col(column) == v, 1).otherwise(0) for v in levels})


def polynomial(df: DataFrame, columns: list[str], degree: int) -> DataFrame:
    """All products of up to ``degree`` columns, without a constant."""
    new = {}
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(columns, d):
            value = F.lit(1.0)
            for c in combo:
                value = value * F.col(c)
            new["_x_".join(combo)] = value
    return df.withColumns(new)


class StandardScaler:
    """Centre and divide by the population deviation; a constant column stays 0."""

    def __init__(self, columns: list[str]):
        self.columns, self.stats = columns, {}

    def fit(self, df: DataFrame) -> StandardScaler:
        row = df.agg(*[f(c).alias(f"{c}{s}") for c in self.columns for f, s in ((F.avg, "_m"), (F.stddev_pop, "_s"))]).first()
        self.stats = {c: (row[f"{c}_m"], row[f"{c}_s"] or 1.0) for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in self.stats.items()})


class RatioAdder(Transformer):
    """Ratios of columns: ``{"out": (a, b)}``; null where the divisor is 0."""

    def __init__(self, ratios: dict[str, tuple[str, str]]):
        super().__init__()
        self.ratios = ratios

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({o: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) for o, (a, b) in self.ratios.items()})


class ColumnSelector(Transformer):
    def __init__(self, columns: list[str]):
        super().__init__()
        self.columns = columns

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns)


def housing_ratios(rooms: str = "total_rooms", bedrooms: str = "total_bedrooms", population: str = "population", households: str = "households", bedrooms_per_room: bool = True) -> RatioAdder:
    ratios = {"rooms_per_household": (rooms, households), "population_per_household": (population, households)}
    return RatioAdder(ratios | ({"bedrooms_per_room": (bedrooms, rooms)} if bedrooms_per_room else {}))


class FeatureUnion(Transformer):
    """The columns that several transformers add to the same table, side by side in one plan; each may be a ``PipelineModel`` and reads columns of the table."""

    def __init__(self, parts: list[Transformer], keep: list[str]):
        super().__init__()
        self.parts, self.keep = parts, keep

    def _transform(self, df: DataFrame) -> DataFrame:
        out, made = df, []
        for part in self.parts:
            before = out.columns
            out = part.transform(out)
            if not set(before) <= set(out.columns):
                raise ValueError("a part of a union may add columns only")
            made += [c for c in out.columns if c not in before]
        return out.select(*self.keep, *made)


def transposed(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """A row for each column (``field``) and a column for each value of ``name``: for reports, whose rows are few and become columns."""
    columns = columns or [c for c in df.columns if c != name]
    long = df.select(name, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("r")).select(name, "r.*")
    rows = [r[0] for r in df.select(name).distinct().orderBy(name).limit(MOST_COLUMNS + 1).collect()]
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} rows can't become columns")
    return long.groupBy("field").pivot(name, rows).agg(F.first("value"))
