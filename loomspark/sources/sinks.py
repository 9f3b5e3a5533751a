"""Sinks and reports."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.strings import fixed_format


def keyed(df: DataFrame, root: str, key: str) -> None:
    """Overwrite one table of a keyed store."""
    df.write.mode("overwrite").parquet(f"{root}/{key}")


def feature(df: DataFrame, row_id: str, name: str, root: str) -> None:
    """One feature column with its row id, under the feature's name."""
    df.select(row_id, name).write.mode("overwrite").parquet(f"{root}/{name}")


def csv(df: DataFrame, path: str, digits: dict[str, int] | None = None, sep: str = ",", encoding: str = "UTF-8", files: int | None = None) -> None:
    """CSV with a header; ``digits`` fixes the decimals of some columns.  ``files``: how many, else one a partition."""
    out = df.withColumns({c: fixed_format(F.col(c), n) for c, n in (digits or {}).items()}) if digits else df
    out = out.coalesce(files) if files else out
    out.write.mode("overwrite").options(header=True, sep=sep, encoding=encoding).csv(path)


def json_lines(df: DataFrame, path: str, column: str | None = None) -> None:
    """Nested rows as JSON text, one a line."""
    df.select((F.col(column) if column else F.to_json(F.struct(*df.columns))).cast("string").alias("value")).write.mode("overwrite").text(path)


def ranked_lines(df: DataFrame, name: str, value: str) -> DataFrame:
    """(rank, line): ``"0. name - value"`` in descending order.  A report: its rows are as many as there are names."""
    rank = F.row_number().over(Window.orderBy(F.col(value).desc_nulls_last(), F.col(name).asc())) - 1
    return df.select(rank.alias("rank"), name, value).select("rank", F.format_string("%s. %s - %s", "rank", name, value).alias("line"))


def html_table(df: DataFrame, title: str, most: int = 100) -> str:
    """The first rows as an HTML table; the rows of a page, so they are few."""
    rows = df.limit(most).collect()
    cells = lambda tag, values: "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values)
    body = "".join(f"<tr>{cells('td', r)}</tr>" for r in rows)
    return f"<h2>{html.escape(title)}</h2><table><tr>{cells('th', df.columns)}</tr>{body}</table>"


def preview(df: DataFrame, n: int = 5) -> dict:
    """Columns and types, row count and the first rows."""
    return {"columns": df.dtypes, "rows": df.count(), "head": df.limit(n).collect()}
