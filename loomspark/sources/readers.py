"""Scans.  Schemas may be declared in part; NaN becomes NULL once, here; row identity is a column that is asked for."""

from __future__ import annotations

import gzip
import shutil
import struct
import tarfile
from pathlib import Path
from urllib.parse import urlparse
from urllib.request import urlopen

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# fixed values: number types of the idx format
IDX = {8: ">u1", 9: ">i1", 11: ">i2", 12: ">i4", 13: ">f4", 14: ">f8"}

# -- csv -----------------------------------------------------------------------


def csv(spark: SparkSession, path: str, schema: StructType | str | None = None, types: dict[str, str] | None = None, columns: list[str] | None = None, timestamps: list[str] | None = None, null: str = "", timestamp_format: str | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header.

    ``schema`` declares all columns; without it types are inferred, and
    ``types`` casts some (names that aren't there are ignored).  ``columns``
    projects, ``timestamps`` parses.
    """
    reader = spark.read.options(header=True, sep=sep, encoding=encoding, nullValue=null)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", types is None and timestamps is None).csv(path)
    if columns:
        df = df.select(*[quoted(c) for c in columns])
    cast = {c: quoted(c).try_cast(t) for c, t in (types or {}).items() if c in df.columns}
    when = {c: (F.try_to_timestamp(quoted(c), F.lit(timestamp_format)) if timestamp_format else F.try_to_timestamp(quoted(c))) for c in timestamps or [] if c in df.columns}
    return df.withColumns(cast | when) if cast or when else df


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def csv_range(spark: SparkSession, path: str, schema: StructType | str, start: int, count: int) -> DataFrame:
    """Rows ``start`` to ``start + count`` (from 0) of a file: numbers are dealt by offset sums of partitions, not by one task."""
    df = spark.read.options(header=True).schema(schema).csv(path)
    return numbered(df, "__row").filter((F.col("__row") >= start) & (F.col("__row") < start + count)).drop("__row")


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Consecutive row numbers in scan order."""
    schema = StructType([*df.schema.fields]).add(name, "long")
    return df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF(schema)


def many_csv(spark: SparkSession, paths: dict[str, str], tag: str = "model", **options) -> DataFrame:
    """Several files as one table with the name of each row's file."""
    out = None
    for name, path in paths.items():
        part = csv(spark, path, **options).withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# -- keyed stores, json ----------------------------------------------------------


def keyed(spark: SparkSession, root: str, key: str, columns: list[str] | None = None) -> DataFrame:
    """One table of a keyed store, which is a folder of Parquet tables."""
    df = spark.read.parquet(f"{root}/{key}")
    return df.select(*columns) if columns else df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def remembered(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path`` if it is complete, else ``make()``, which is then kept there."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def json_items(spark: SparkSession, path: str, array: str = "items") -> DataFrame:
    """The members of an array of a JSON document, a row each, their fields as columns."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(array).alias("item")).select("item.*")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features with their properties as columns; geometry is kept as JSON."""
    features = json_items(spark, path, "features")
    return features.select("properties.*", F.to_json("geometry").alias("geometry"))


def unpack(archive: str, folder: str) -> list[str]:
    """Extract a local tar archive (downloads are an operator's task, not a query's) and name its files."""
    with tarfile.open(archive) as tar:
        tar.extractall(folder, filter="data")
        return [str(Path(folder, m.name)) for m in tar.getmembers() if m.isfile()]


def fetch(url: str, folder: str, name: str | None = None) -> str:
    """Download a file into a folder, as a task of an operator before any query; an archive is then ``unpack``'s."""
    target = Path(folder, name or Path(urlparse(url).path).name)
    target.parent.mkdir(parents=True, exist_ok=True)
    with urlopen(url) as source, target.open("wb") as sink:
        shutil.copyfileobj(source, sink)
    return str(target)


def idx(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, values): the entries of an idx file (plain or gzipped), each a flat array; read by Spark, a file at a time."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                kind, dims = data[2], data[3]
                shape = struct.unpack_from(f">{dims}I", data, 4)
                values = np.frombuffer(data, IDX[kind], int(np.prod(shape)), 4 + 4 * dims).reshape(shape[0], -1)
                for k in range(0, len(values), 10_000):
                    part = values[k : k + 10_000].astype(np.float64)
                    lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1], pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part))), lists], names=["row_id", "values"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row_id long, values array<double>")


def idx_images(spark: SparkSession, images: str, labels: str, classes: int) -> DataFrame:
    """(row_id, image, label, one_hot) of a pair of idx files."""
    from loomspark.functions.vectors import one_hot

    both = idx(spark, images).withColumnRenamed("values", "image").join(idx(spark, labels).select("row_id", F.col("values")[0].cast("int").alias("label")), "row_id")
    return both.withColumn("one_hot", one_hot(F.col("label"), classes))


def labelled_images(df: DataFrame, label: str, classes: int) -> DataFrame:
    """(image, label, one_hot) of a wide table with a label column and a column for each pixel."""
    from loomspark.functions.vectors import one_hot

    rest = [quoted(c).cast("double") for c in df.columns if c != label]
    return df.select(F.array(*rest).alias("image"), F.col(label).cast("int").alias("label"), one_hot(F.col(label), classes).alias("one_hot"))


def records(spark: SparkSession, rows, schema: str | StructType) -> DataFrame:
    """Dicts or tuples as a table."""
    return spark.createDataFrame(rows, schema)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating columns without NaN."""
    return df.withColumns({c: F.when(F.isnan(quoted(c)), None).otherwise(quoted(c)) for c, t in df.dtypes if t in ("float", "double")} or {})
