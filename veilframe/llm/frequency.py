"""What is known of hashes over a whole corpus, told back to the blocks that hold them.

A block sends its distinct 64-bit hashes in order, cut into ranges: 32 bits of
each (those below the ones that name the range) as compressed differences, and
columns beside them.  Whoever holds a range settles it and answers each block
in the order of its hashes.  A hash that stands everywhere is one entry for
each block.  Two hashes that fall together in those bits are taken for one,
which must only cost work.

Frequency classes are such answers: 0 for one occurrence, else 1 +
floor(log2(occurrences)).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textvec as tv


def bounds(n: int) -> np.ndarray:
    return np.array([(i << 64) // n for i in range(n)], np.uint64)


def _planes(x: np.ndarray, z: zstandard.ZstdCompressor) -> bytes:
    """Numbers with their byte planes apart, so that bytes which hardly vary cost nothing."""
    size = x.dtype.itemsize
    return bytes([size]) + z.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, size).T).tobytes())


def _numbers(b: bytes, d: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = np.frombuffer(d.decompress(b[1:]), np.uint8).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{b[0]}").ravel()


def starts(s: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def swap(rows: DataFrame, n: int, make: Callable[[dict], tuple[np.ndarray, list[np.ndarray]]], settle: Callable[[np.ndarray, list[np.ndarray]], list[np.ndarray]], name: str) -> str:
    """Numbers for the blocks' hashes, settled over all blocks, as a folder of files.

    `make` gives a block's hashes in ascending order with columns of up to 64
    bits; `settle` gets the entries of one range (32 bits of each hash) and
    answers columns of the same length.  Blocks read theirs with `answers`.
    """
    edges = bounds(n)

    def send(batches):
        z = zstandard.ZstdCompressor(level=1)
        for r in shared.block_rows(batches):
            key, cols = make(r)
            cut = np.append(np.searchsorted(key, edges), len(key))
            low = ((key * tv.U(n)) >> tv.U(32)).astype(np.uint32)
            out = []
            for b in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(cut[b], cut[b + 1])
                out.append((b, _planes(np.diff(low[own], prepend=np.uint32(0)), z), [_planes(c[own], z) for c in cols]))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()), pa.array([r["block_id"]] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.list_(pa.binary()))], ["bucket", "block_id", "low", "cols"])

    def reduce(batches):
        d, z, held = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1), []
        for r in shared.block_rows(batches):
            held.append((r["bucket"], r["block_id"], np.cumsum(_numbers(r["low"], d), dtype=np.uint32), [_numbers(c, d) for c in r["cols"]]))
        if not held:
            return
        out = settle(np.concatenate([x[2] for x in held]), [np.concatenate(c) for c in zip(*(x[3] for x in held), strict=True)])
        at, rows, size = 0, [], 0
        for bucket, block, x, _ in held:
            rows.append((block, bucket, [_planes(c[at : at + len(x)], z) for c in out]))
            at, size = at + len(x), size + sum(map(len, rows[-1][2]))
            if size >= 1 << 20 or at == len(out[0]):
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.list_(pa.binary())), strict=True)], ["block_id", "bucket", "cols"])
                rows, size = [], 0

    sent = rows.mapInArrow(shared.task(send), "bucket int, block_id long, low binary, cols array<binary>").repartitionById(n, F.col("bucket"))
    back = sent.mapInArrow(shared.task(reduce), "block_id long, bucket int, cols array<binary>")
    return filed(back.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "cols")).alias("value")), name)


def answers(folder: str, block_id: int) -> list[np.ndarray] | None:
    """What `settle` answered to the block, in the order of its hashes; None if it sent none."""
    d, got = zstandard.ZstdDecompressor(), sorted(fetch(folder, block_id), key=lambda x: x["bucket"])
    return [np.concatenate([_numbers(x["cols"][k], d) for x in got]) for k in range(len(got[0]["cols"]))] if got else None


def replies(rows: DataFrame, n: int, values: Callable[[dict], np.ndarray], name: str) -> str:
    """Frequency classes of the blocks' hashes, to be read with `read`."""

    def make(row):
        u = np.sort(values(row))
        first = starts(u)
        return u[first], [np.diff(first, append=len(u)).astype(np.uint32)]

    def settle(low, cols):
        key = low.astype(np.uint64) << tv.U(32)
        key |= np.arange(len(key), dtype=np.uint64)
        key.sort()
        value, place = key >> tv.U(32), (key & tv.U(0xFFFFFFFF)).astype(np.int64)
        first = starts(value)
        total = np.add.reduceat(cols[0].astype(np.int64)[place], first)
        out = np.empty(len(key), np.uint8)
        out[place] = np.repeat(np.where(total == 1, 0, 1 + np.floor(np.log2(total))).astype(np.uint8), np.diff(first, append=len(value)))
        return [out]

    return swap(rows, n, make, settle, name)


def filed(grouped: DataFrame, name: str) -> str:
    """Writes a list for each block, (block_id, value), to an Arrow file of its own in the shared folder, and returns that folder.

    Blocks take their answers from there, so a block's text is never shuffled
    to meet them, whatever the size of either.
    """
    folder = shared.fresh(grouped.sparkSession, name)

    def put(batches):
        for b in batches:
            for i in range(b.num_rows):
                own = pa.record_batch([b.column(1)[i].values], ["value"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_file(sink, own.schema) as out:
                    out.write_batch(own)
                block = b.column(0)[i].as_py()
                n = shared.put_file(f"{folder}/{block}", [sink.getvalue()])
                yield pa.record_batch([pa.array([block], pa.int64()), pa.array([n], pa.int64())], ["block_id", "bytes"])

    shared.drop(shared.staged(grouped.select("block_id", "value").mapInArrow(shared.task(put), "block_id long, bytes long"), f"{name}-files"))
    return folder


def fetch(folder: str, block_id: int) -> list:
    """A block's list; empty if it has none."""
    fs, path = shared.open_shared(f"{folder}/{block_id}")
    if fs.get_file_info(path).type != pafs.FileType.File:
        return []
    with fs.open_input_file(path) as f:
        return pa.ipc.open_file(f).read_all().column(0).to_pylist()


def read(u: np.ndarray, folder: str, block_id: int) -> np.ndarray:
    """The frequency class of each of the block's hashes, in their own order."""
    order = np.argsort(u, kind="stable")
    first = starts(u[order])
    got = answers(folder, block_id)
    q = np.zeros(len(u), np.uint8)
    if got:
        q[order] = np.repeat(got[0], np.diff(first, append=len(u)))
    return q
