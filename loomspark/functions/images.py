"""Convolution and pooling of images in array columns, by numpy on Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructType


def convolved(image: np.ndarray, kernels: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Images (n, height, width, in) by kernels (rows, columns, in, out), zeros around them: (n, height, width, out)."""
    rows, columns = kernels.shape[:2]
    top, left = (rows - 1) // 2, (columns - 1) // 2
    framed = np.pad(image, ((0, 0), (top, rows - 1 - top), (left, columns - 1 - left), (0, 0)))
    windows = np.lib.stride_tricks.sliding_window_view(framed, (rows, columns), axis=(1, 2))  # n, height, width, in, rows, columns
    return np.einsum("nhwirc,rcio->nhwo", windows, kernels) + bias


def pooled(image: np.ndarray, size: int = 2) -> np.ndarray:
    """The largest of each square; edges that fill no square stand for themselves."""
    n, height, width, depth = image.shape
    framed = np.pad(image, ((0, 0), (0, -height % size), (0, -width % size), (0, 0)), constant_values=-np.inf)
    return framed.reshape(n, framed.shape[1] // size, size, framed.shape[2] // size, size, depth).max(axis=(2, 4))


def conv_pool(df: DataFrame, column: str, out: str, height: int, width: int, kernels: np.ndarray, bias: np.ndarray, pool: int = 2, relu: bool = True) -> DataFrame:
    """``df`` with an array: its images convolved, rectified and pooled, row by row of the result; depth varies fastest.  Null images stay null."""
    depth = kernels.shape[2]
    schema = StructType([*df.schema.fields]).add(out, ArrayType(DoubleType()))

    def run(batches):
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column))
            known = np.flatnonzero(np.asarray(values.is_valid()))
            made: list = [None] * batch.num_rows
            if len(known):
                images = np.stack(values.take(pa.array(known)).to_numpy(zero_copy_only=False)).astype(np.float64)
                layer = convolved(images.reshape(-1, height, width, depth), kernels, bias)
                layer = pooled(np.maximum(layer, 0) if relu else layer, pool)
                for i, x in zip(known.tolist(), layer.reshape(len(known), -1)):
                    made[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)
