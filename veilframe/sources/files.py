"""Files that tasks write, in a folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under one of the driver's own, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="veilframe-files-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        root = "file://" + _OWN[0]
    return f"{root.rstrip('/')}/veilframe-files/{name}-{uuid.uuid4().hex}"


def children(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, in order; nothing where there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().toString() for f in fs.listStatus(path)) if fs.exists(path) else []


def write_each(rows: DataFrame, folder: str, name_col: str, content_col: str) -> DataFrame:
    """A file for each row, under the name that the row gives; returns name and bytes once all are written.

    A file is written under a name of its own and moved into place, so a task
    that runs again leaves the same files.  Of rows that share a name one stays.
    """

    def each(batches):
        fs, path = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(path, recursive=True)
        for b in batches:
            sizes = []
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = f"{path}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                fs.move(part, f"{path}/{name}")
                sizes.append(len(content.as_buffer()))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    named = rows.select(F.col(name_col).cast("string").alias("name"), F.col(content_col).cast("binary").alias("content")).where("name is not null and content is not null")
    listed = f"{folder.rstrip('/')}-list"
    named.mapInArrow(each, "name string, bytes long").write.parquet(listed)
    return rows.sparkSession.read.schema("name string, bytes long").parquet(listed)
