"""Token ids as sorted-string-table shards.

A shard holds documents in ascending key order.  Layout: data blocks, each a
zstd frame of entries (shared key bytes, own key bytes, value length, own key,
value) with keys prefix-compressed and restarting in each block; a sparse
index (first key, offset, length of each block); a Bloom filter over the keys;
a JSON footer and, last, its length and a magic word.  A reader takes the
footer, asks the filter, finds the block by binary search in the index, and
walks that block.

Defined cases: null or empty text gives only the end id; a null key sorts
before all others; equal keys (repeated rows) keep an entry each, by crc32 of
the text and then by token ids, and may span shards; very long texts are one entry in a block of its own; an empty
table gives no shards and no rows.  Further columns of the input are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .encoding import encoder, vocabulary

MAGIC = b"VFSST001"
BLOCK = 64 << 10
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_of(doc_id: int | None) -> bytes:
    """Order-preserving bytes of a nullable long."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        n |= (c & 127) << shift
        at += 1
        if c < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, k: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key) * 2654435761 % (1 << 32) | 1
    return [(a + i * b) % bits for i in range(k)]


def write_shard(entries):
    """entries: (key, value) in ascending order.  Yields byte chunks of the file."""
    z, block, index, keys, at, last, n_ids, first = zstandard.ZstdCompressor(level=1), bytearray(), [], [], 0, b"", 0, b""
    for key, value in entries:
        if not block:
            first, last = key, b""
        same = 0
        while same < min(len(key), len(last)) and key[same] == last[same]:
            same += 1
        block += _varint(same) + _varint(len(key) - same) + _varint(len(value)) + key[same:] + value
        last, n_ids = key, n_ids + len(value) // 4
        keys.append(key)
        if len(block) >= BLOCK:
            out = z.compress(bytes(block))
            index.append((first.hex(), at, len(out)))
            at += len(out)
            block = bytearray()
            yield out
    if block:
        out = z.compress(bytes(block))
        index.append((first.hex(), at, len(out)))
        at += len(out)
        yield out
    bits = max(64, 10 * len(keys))
    bloom = np.zeros((bits + 7) // 8, np.uint8)
    for key in keys:
        for p in _probes(key, bits, 7):
            bloom[p >> 3] |= 1 << (p & 7)
    tail = z.compress(json.dumps(index).encode())
    filt = bloom.tobytes()
    footer = json.dumps({"index": [at, len(tail)], "bloom": [at + len(tail), len(filt)], "bits": bits, "k": 7, "docs": len(keys), "ids": n_ids, "first": keys[0].hex(), "last": keys[-1].hex()}).encode()
    yield tail + filt + footer + struct.pack("<I", len(footer)) + MAGIC


class Shard:
    """Reader of a shard's bytes (or of a memory map over them)."""

    def __init__(self, data):
        self.data = data
        if bytes(data[-8:]) != MAGIC:
            raise ValueError("not a shard, or cut short")
        n = struct.unpack("<I", bytes(data[-12:-8]))[0]
        self.footer = json.loads(bytes(data[-12 - n : -12]))
        at, n = self.footer["index"]
        self.z = zstandard.ZstdDecompressor()
        self.index = [(bytes.fromhex(k), o, m) for k, o, m in json.loads(self.z.decompress(bytes(data[at : at + n])))]
        at, n = self.footer["bloom"]
        self.bloom = bytes(data[at : at + n])

    def block(self, i: int):
        _, at, n = self.index[i]
        raw, key, p = self.z.decompress(bytes(self.data[at : at + n])), b"", 0
        while p < len(raw):
            same, p = _read_varint(raw, p)
            own, p = _read_varint(raw, p)
            size, p = _read_varint(raw, p)
            key = key[:same] + raw[p : p + own]
            p += own
            yield key, raw[p : p + size]
            p += size

    def __iter__(self):
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[bytes]:
        """Values of a key: none if the filter excludes it, else by binary search over the sparse index."""
        key = key_of(doc_id)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.footer["bits"], self.footer["k"])):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        found = []
        for i in range(max(lo - 1, 0), len(self.index)):
            if self.index[i][0] > key:
                break
            found += [v for k, v in self.block(i) if k == key]
        return found


def write(docs: DataFrame, path: str, vocab: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards under `path` in the order of ids; returns shard, file, n_docs, n_ids (read from Parquet)."""

    def shard(batches):
        from pyspark import TaskContext

        enc, end, held = encoder(vocabulary(vocab)), struct.pack("<I", end_id), []
        z, d = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in batches:
            for s in shared.slices(batch, 1, 2 << 20):
                for i, crc, ids in zip(s.column(0).to_pylist(), s.column(2).to_pylist(), enc.encode(s.column(1)), strict=True):
                    held.append(((key_of(i), crc), z.compress(ids + end), len(ids) // 4 + 1))
        if not held:
            return
        held.sort(key=lambda x: x[0])
        n = TaskContext.get().partitionId()
        file = f"{path}/shard-{n:06d}.sst"
        shared.put_file(file, write_shard((k[0], d.decompress(v)) for k, v, _ in _settled(held)))
        yield pa.RecordBatch.from_pydict({"shard": [n], "file": [file], "n_docs": [len(held)], "n_ids": [sum(x[2] for x in held)]}, pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.crc32(text.cast("binary")).alias("crc"))
    # the checksum splits rows that share an id, or have none, over several shards
    dealt = plain.repartitionByRange(shared.parts(docs.sparkSession), F.col("id").asc_nulls_first(), "crc")
    return shared.staged(dealt.mapInArrow(shared.task(shard, "encoders"), "shard long, file string, n_docs long, n_ids long"), "sst-manifest")


def _settled(held):
    """Entries of equal keys in the order of their token ids, so that a repeated task writes the same file."""
    at = 0
    while at < len(held):
        to = at + 1
        while to < len(held) and held[to][0] == held[at][0]:
            to += 1
        yield from sorted(held[at:to], key=lambda x: zstandard.ZstdDecompressor().decompress(x[1])) if to - at > 1 else held[at:to]
        at = to


def read(manifest: DataFrame) -> DataFrame:
    """Documents from the shards, with the number of ids before each.

    The driver sums one number per shard; shards are ranges of many documents,
    so this list stays a small fraction of any input.
    """
    spark = manifest.sparkSession
    start, at = {}, 0
    for r in manifest.select("shard", "n_ids").orderBy("shard").toLocalIterator():
        start[r.shard], at = at, at + r.n_ids
    starts = spark.createDataFrame(list(start.items()), "shard long, start long")
    files = manifest.select("shard", "file").join(starts, "shard").repartitionById(max(1, len(start)), F.col("shard").cast("int") % F.lit(max(1, len(start))))

    def open_files(batches):
        for r in shared.block_rows(batches):
            fs, path = shared.open_shared(r["file"])
            with fs.open_input_file(path) as f:
                shard = Shard(f.read())
            at, rows = r["start"], []
            for key, value in shard:
                n = len(value) // 4
                rows.append((id_of(key), at, n, zlib.crc32(value)))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("file", "start").mapInArrow(shared.task(open_files), SCHEMA)


def round_trip(docs: DataFrame) -> DataFrame:
    return read(write(docs, shared.fresh(docs.sparkSession, "sst")))
