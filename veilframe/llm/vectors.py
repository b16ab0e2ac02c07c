"""Vectors of a list column as integer rows, and tables that rounds over them share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared


def finite(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose vector is given and holds only finite numbers: their places, begins and lengths, and all values as doubles."""
    offs = np.asarray(column.offsets, np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok = (bad[offs[1:]] == bad[offs[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(ok)
    return rows, offs[:-1][rows], np.diff(offs)[rows], flat


def floors(x: np.ndarray, scale: int, most: float) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; OverflowError from `most` on."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * x)
    if not (np.abs(out) < most).all():
        raise OverflowError("a component is too large for exact sums")
    return out.astype(np.int64)


def packed(x: np.ndarray) -> tuple[bytes, int]:
    """Integers in 4 bytes each where they fit, else 8."""
    kind = "<i4" if np.abs(x).max(initial=0) < 2**31 else "<i8"
    return np.ascontiguousarray(x.astype(kind)).tobytes(), int(kind[-1])


def unpacked(data: bytes, width: int, columns: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").reshape(-1, columns).astype(np.int64) if columns else np.zeros((0, 0), np.int64)


def bucketed(df: DataFrame, parts: int, key: str, name: str) -> DataFrame:
    """Writes `df`, whose rows are dealt by `key` into `parts` already, as that many buckets in the shared folder.

    Two such tables meet on the key without a shuffle.  The catalog's entry goes
    at once; the DataFrame knows its files and buckets.
    """
    spark, path, entry = df.sparkSession, shared.fresh(df.sparkSession, name), f"veilframe_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(parts, key).option("compression", "zstd").option("path", path).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return shared.remember(out, path)


def plain(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))


def summed(cells: DataFrame, *keys: str | Column) -> DataFrame:
    """Exact sums of long cells, which may pass 64 bits together."""
    return cells.groupBy(*keys).agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
