"""Staging in the cluster's shared folder, text blocks, and exchanges by partition number."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv

BLOCK_BYTES = 4 << 20
_OWN: list[str] = []
_FOLDERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: What a worker process keeps from task to task, by kind.
KEPT: dict[str, dict] = {}


def kept(kind: str) -> dict:
    return KEPT.setdefault(kind, {})


def _give_back() -> None:
    """Freed memory goes back to the system; an allocator would keep it for the worker's life."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def task(each: Callable, *kinds: str) -> Callable:
    """`each` for mapInArrow, in a worker that starts and ends with nothing but the kept `kinds`.

    Workers outlive tasks and stages, so without this whatever one stage keeps
    would add to what the next needs.
    """

    def run(batches):
        if any(held and kind not in kinds for kind, held in KEPT.items()):
            for kind in KEPT.keys() - set(kinds):
                KEPT[kind].clear()
            _give_back()
        try:
            yield from each(batches)
        finally:
            _give_back()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; where it is unset, an own one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="veilframe-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        root = "file://" + _OWN[0]
    return f"{root.rstrip('/')}/veilframe"


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lineage ends here, lost executors cost nothing."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def remember(df: DataFrame, path: str) -> DataFrame:
    """Notes the folder that `df` reads, for `drop`."""
    _FOLDERS[df] = path
    return df


def staged_counting(df: DataFrame, name: str, of) -> tuple[DataFrame, int]:
    """`staged`, and how many of the rows `of` holds for, counted as they are written."""
    seen = Observation()
    out = staged(df.observe(seen, F.count_if(of).alias("n")), name)
    return out, seen.get["n"]


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*tables: DataFrame) -> None:
    """Deletes staged tables, once all that reads them has been written itself."""
    for df in tables:
        folder = _FOLDERS.pop(df, None)
        if folder:
            remove(df.sparkSession, folder)


def parts(spark: SparkSession) -> int:
    """How many pieces an exchange is dealt into: the session's shuffle partitions, which follow the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_shared(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for Python tasks; a bare path is a local one."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


def put_file(uri: str, chunks) -> int:
    """Writes a file under a name of its own and moves it into place, so a repeated task does no harm."""
    fs, path = open_shared(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part, n = f"{path}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(part) as out:
        for c in chunks:
            out.write(c)
            n += len(c)
    fs.move(part, path)
    return n


def slices(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about `limit` bytes in a text column; one row is never cut."""
    _, offs = tv.text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def stage_blocks(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, rest: bool = False) -> DataFrame:
    """Documents as rows of about `block_bytes` of text, in the shared folder.

    Columns: block_id, ids (int64), known (1 where the id isn't null), lens
    (int64), payload (zstd of the texts, one after the other), and with `rest`
    an Arrow stream of all columns but the text (whatever their names) and
    given (1 where the text isn't null); `block_table` undoes it.  A block is
    one row, so each later pass sees the same documents in the same order however
    the files are split.  Text is compressed once and shuffled as it is.
    """

    def pack(batches):
        from pyspark import TaskContext

        nth = 0
        z = zstandard.ZstdCompressor(level=1)
        part = TaskContext.get().partitionId()
        rows, size = [], 0

        def flush():
            nonlocal nth, rows, size
            tab = pa.concat_arrays([r[1] for r in rows])
            ids = pa.concat_arrays([r[0] for r in rows])
            data, offs = tv.text_buffers(tab)
            fields = [
                pa.array([(part << 32) + nth], pa.int64()),
                pa.array([ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
                pa.array([ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary()),
                pa.array([np.diff(offs).astype("<i8").tobytes()], pa.binary()),
                pa.array([z.compress(data.tobytes())], pa.binary()),
            ]
            if rest:
                fields.append(pa.array([tab.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary()))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows[0][2].schema) as out:
                    for r in rows:
                        out.write_batch(r[2])
                fields.append(pa.array([z.compress(sink.getvalue().to_pybytes())], pa.binary()))
            nth, rows, size = nth + 1, [], 0
            return pa.record_batch(fields, names)

        for batch in batches:
            for s in slices(batch, 1, block_bytes):
                column = s.column(1).cast(pa.large_string())
                rows.append((s.column(0).cast(pa.int64()), column, s.select(range(2, s.num_columns)) if rest else None))
                size += int(tv.text_buffers(column)[1][-1])
                if size >= block_bytes // 2 or sum(len(r[0]) for r in rows) >= 20_000:
                    yield flush()
        if rows:
            yield flush()

    names = ["block_id", "ids", "known", "lens", "payload"] + ["given", "rest"] * rest
    others = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col] if rest else []
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *others)
    return staged(plain.mapInArrow(task(pack), "block_id long, ids binary, known binary, lens binary, payload binary" + ", given binary, rest binary" * rest), name)


def open_block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, known, text bytes and offsets of a block row."""
    ids = np.frombuffer(row["ids"], "<i8")
    lens = np.frombuffer(row["lens"], "<i8")
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["payload"], max_output_size=int(lens.sum()) or 1), np.uint8)
    return ids, np.frombuffer(row["known"], np.uint8).astype(bool), data, np.concatenate([[0], np.cumsum(lens)])


def text_array(data: np.ndarray, offs: np.ndarray, given: bytes) -> pa.Array:
    """Texts of a block as a string column; null where they were."""
    whole = pa.Array.from_buffers(pa.large_string(), len(offs) - 1, [None, pa.py_buffer(offs.astype("<i8")), pa.py_buffer(np.ascontiguousarray(data))])
    return pc.if_else(pa.array(np.frombuffer(given, np.uint8).astype(bool)), whole, None).cast(pa.string())


def block_table(row: dict, schema, text_col: str, texts: pa.Array | None = None) -> pa.Table:
    """All columns of a block staged with `rest`, its texts as they were or as given."""
    if texts is None:
        _, _, data, offs = open_block(row)
        texts = text_array(data, offs, row["given"])
    rest = iter(pa.ipc.open_stream(pa.BufferReader(zstandard.ZstdDecompressor().decompress(row["rest"]))).read_all().combine_chunks().columns)
    return pa.table([texts if f.name == text_col else next(rest) for f in schema], names=[f.name for f in schema])


def block_rows(batches, columns: list[str] | None = None) -> Iterator[dict]:
    """Rows of batches as dicts, one at a time."""
    for b in batches:
        names = b.schema.names
        for i in range(b.num_rows):
            yield {n: b.column(j)[i].as_py() for j, n in enumerate(names) if columns is None or n in columns}


def crc_rest(id_col, n: int):
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)
