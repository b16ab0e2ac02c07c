"""WARC archives: writing, normalising whole-file gzip streams, and reading back.

Each task writes its records as one gzip stream over the whole file.  The
normaliser inflates such a stream once, front to back, and writes every record
as a gzip member of its own with a sidecar index (offset, length, type, record
and payload digest of each record).  The reader goes by the sidecar, so a
record can be fetched alone.

Of records with equal payloads of `least` bytes or more, the one with the
smallest id is the response and the others are revisits without a body.
Defined cases: a null or empty payload is a response of 0 bytes; a null id
sorts after all others and is written without a number; rows that repeat an id
stay rows, and if they share a payload too, one is the response and the rest
revisits of that id; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import json
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _name(i) -> str:
    return f"<urn:x-page:{'' if i is None else i}>"


def _number(name: str):
    own = name.removeprefix("<urn:x-page:").removesuffix(">")
    return int(own) if own else None


def record(page_id, url: str, payload: bytes, digest: str, size: int, refers_to, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit carries no body but names what it repeats."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c not in "\r\n"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = head if revisit else head + payload
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def split_records(chunks):
    """Records of an inflated stream, one at a time."""
    held = bytearray()
    chunks = iter(chunks)
    done = False
    while True:
        while not done and held.find(b"\r\n\r\n") < 0:
            more = next(chunks, None)
            done = more is None
            held += more or b""
        end = held.find(b"\r\n\r\n")
        if end < 0:
            if held.strip():
                raise ValueError("archive is cut short")
            return
        size = next(int(x.split(b":", 1)[1]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
        need = end + 4 + size + 4
        while not done and len(held) < need:
            more = next(chunks, None)
            done = more is None
            held += more or b""
        if len(held) < need:
            raise ValueError("archive is cut short")
        yield bytes(held[:need])
        del held[:need]


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.decode("utf-8", "replace").split(": ", 1) for x in head.split(b"\r\n")[1:])
    http, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.decode("latin-1").split(": ", 1) for x in http.split(b"\r\n")[1:]), body


def inflate(stream, size: int = 1 << 20):
    """Inflates gzip of any number of members, front to back, in bounded memory."""
    z = zlib.decompressobj(31)
    while chunk := stream.read(size):
        while chunk:
            out = z.decompress(chunk, 4 * size)
            if out:
                yield out
            chunk = z.unconsumed_tail
            if z.eof:
                chunk = z.unused_data
                z = zlib.decompressobj(31)


def typed(pages: DataFrame, least: int = 100, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """Each page with its payload, digest, the id of the response that it repeats, if any, and whether it is a revisit."""
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(url, F.lit("")).alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.length("payload").cast("long"))
    keyed = shared.staged(base.filter(F.col("size") >= least).select("digest", "page_id", "url"), "digests")
    firsts = keyed.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    # rows that share the response's id too: the one of the least URL is the response
    twins = keyed.join(firsts, "digest").filter("page_id = refers_to").groupBy("digest").agg(F.count("*").alias("n"), F.min("url").alias("least")).filter("n > 1").drop("n")
    repeated = shared.staged(firsts.join(twins, "digest", "left"), "repeated")
    shared.drop(keyed)
    rows = base.join(repeated, "digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    columns = ["page_id", "url", F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "digest", "size", "refers_to", "revisit"]
    if not repeated.filter("least is not null").limit(1).count():
        return rows.withColumn("revisit", revisit).select(*columns)
    twin = F.col("least").isNotNull() & F.col("page_id").eqNullSafe(F.col("refers_to"))
    # whole twins may be equal in all columns: they are counted, and the first of the count is the response
    again = rows.filter(twin).groupBy("digest", "url", "page_id", "size", "refers_to", "least").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
    again = again.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).withColumn("revisit", (F.col("nth") > 1) | (F.col("url") != F.col("least")))
    return rows.filter(~twin).withColumn("revisit", revisit).select(*columns).unionByName(again.select(*columns))


def write(pages: DataFrame, path: str, **options) -> DataFrame:
    """Writes one whole-stream gzip archive for each task; returns their files."""
    ready = typed(pages, **options)

    def archive(batches):
        from pyspark import TaskContext

        file, n = f"{path}/part-{TaskContext.get().partitionId():06d}.warc.gz", 0

        def stream():
            nonlocal n
            z = zlib.compressobj(1, zlib.DEFLATED, 31)
            for r in shared.block_rows(batches):
                yield z.compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["size"], r["refers_to"], r["revisit"]))
                n += 1
            yield z.flush()

        shared.put_file(file, stream())
        if n:
            yield pa.record_batch([pa.array([file]), pa.array([n], pa.int64())], ["file", "n"])

    return shared.staged(ready.mapInArrow(shared.task(archive), "file string, n long"), "archives")


def normalise(files: DataFrame) -> DataFrame:
    """Rewrites each archive with a gzip member for each record and a sidecar of JSON lines beside it."""
    spark = files.sparkSession

    def each(batches):
        for r in shared.block_rows(batches):
            fs, path = shared.open_shared(r["file"])
            out = r["file"].removesuffix(".warc.gz") + ".members.warc.gz"
            index, at = [], 0

            def members(fs=fs, path=path, index=index):
                nonlocal at
                with fs.open_input_stream(path, compression=None) as f:
                    for raw in split_records(inflate(f)):
                        z = zlib.compressobj(1, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        fields, _, _ = parse(raw)
                        index.append(json.dumps({"offset": at, "length": len(member), "type": fields["WARC-Type"], "id": fields["WARC-Record-ID"], "digest": fields["WARC-Payload-Digest"]}) + "\n")
                        at += len(member)
                        yield member

            shared.put_file(out, members())
            side = out + ".index.jsonl"
            shared.put_file(side, (x.encode() for x in index))
            yield pa.record_batch([pa.array([out]), pa.array([side]), pa.array([len(index)], pa.int64())], ["file", "sidecar", "n"])

    return shared.staged(files.repartition(shared.parts(spark)).mapInArrow(shared.task(each), "file string, sidecar string, n long"), "members")


def read(members: DataFrame) -> DataFrame:
    """A row for each record, by the sidecar's offsets; payload digests are checked against the bodies."""

    def each(batches):
        for r in shared.block_rows(batches):
            fs, path = shared.open_shared(r["file"])
            _, side = shared.open_shared(r["sidecar"])
            with fs.open_input_stream(side, compression=None) as f:
                index = [json.loads(x) for x in f.read().decode().splitlines()]
            rows = []
            with fs.open_input_file(path) as f:
                for x in index:
                    f.seek(x["offset"])
                    fields, http, body = parse(zlib.decompress(f.read(x["length"]), 31))
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} doesn't hold")
                    rows.append((_number(fields["WARC-Record-ID"]), int(http["Content-Length"]), digest, fields["WARC-Type"], _number(fields["WARC-Refers-To"]) if revisit else None))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()], strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return members.repartition(shared.parts(members.sparkSession)).mapInArrow(shared.task(each), OUT)


def round_trip(pages: DataFrame) -> DataFrame:
    return read(normalise(write(pages, shared.fresh(pages.sparkSession, "warc"))))
