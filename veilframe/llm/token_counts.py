"""Token counts through a digest cache.

A text's count depends only on its normalised content (null becomes the empty
text; nothing else is folded, since any other change could alter a count) and
on the tokenizer file.  Both are named by SHA-256 digests.  The cache is a
Parquet table (content digest, tokenizer digest, n_tokens).  Texts are staged in
blocks and stay there: only digests are shuffled.  Of each digest that the
cache lacks, one row is chosen; its block encodes it, the counts are appended,
and every row is joined to the cache.

The registered query starts with an empty cache of its own: a kept one would
make any second run of it over the same table measure nothing.

Defined cases: null and empty texts count 0 tokens; repeated rows and copies
share one cache entry; a null id is returned as it is; an empty table gives no
rows.  Special strings inside texts are handled as the library's default.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frequency, shared
from .encoding import vocabulary

CACHE = "content string, tokenizer string, n_tokens long"
_MODELS: dict[str, object] = shared.kept("counters")


def tokenizer_digest(name: str) -> str:
    with open(vocabulary(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(name: str):
    """A function from texts to counts, one model for each worker process."""
    if name not in _MODELS:
        path = vocabulary(name)
        if name.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _MODELS[name] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            from .encoding import encoder

            enc = encoder(path)
            _MODELS[name] = lambda texts: [len(x) // 4 for x in enc.encode(texts)]
    return _MODELS[name]


def count_tokens(docs: DataFrame, vocab: str = "piece_bpe_32k.model", limit: int = 4096, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; `cache` is the folder of the cache table, a new one if none is named."""
    spark = docs.sparkSession
    cache = cache or shared.fresh(spark, "token-cache")
    version = tokenizer_digest(vocab)
    blocks = shared.stage_blocks(docs, "token-blocks", id_col, text_col)

    def digests(batches):
        for row in shared.block_rows(batches):
            ids, known, data, offs = shared.open_block(row)
            own = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.record_batch([pa.array(ids, mask=~known), pa.array(own), pa.array(np.diff(offs)), pa.array(np.full(len(ids), row["block_id"])), pa.array(np.arange(len(ids), dtype=np.int32))], ["doc_id", "content", "n_bytes", "block_id", "nth"])

    rows = shared.staged(blocks.mapInArrow(shared.task(digests), "doc_id long, content string, n_bytes long, block_id long, nth int"), "digests")
    # of each digest that the cache lacks one row is encoded, where its text lies
    known = _open(spark, cache).filter(F.col("tokenizer") == version)
    once = rows.groupBy("content").agg(F.min(F.struct("block_id", "nth")).alias("at")).join(known, "content", "left_anti")
    misses = frequency.filed(once.groupBy(F.col("at.block_id").alias("block_id")).agg(F.collect_list("at.nth").alias("value")), "misses")

    def encode(batches):
        count = _counter(vocab)
        for row in shared.block_rows(batches):
            _, _, data, offs = shared.open_block(row)
            held, size = [], 0
            todo = sorted(frequency.fetch(misses, row["block_id"]))
            for k, i in enumerate(todo):
                held.append(data[offs[i] : offs[i + 1]].tobytes())
                size += len(held[-1])
                if size >= 1 << 20 or k + 1 == len(todo):
                    n = count([x.decode("utf-8", "replace") for x in held])
                    yield pa.record_batch([pa.array([hashlib.sha256(x).hexdigest() for x in held]), pa.array(n, pa.int64())], ["content", "n_tokens"])
                    held, size = [], 0

    counted = blocks.mapInArrow(shared.task(encode, "counters", "encoders"), "content string, n_tokens long")
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    shared.drop(blocks)
    shared.remove(spark, misses)
    counts = _open(spark, cache).filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counts = shared.staged(counts, "counts")  # one row a digest, so the join can split a digest of very many rows
    return rows.join(counts, "content", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _open(spark, cache: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(CACHE).parquet(cache)
    return spark.createDataFrame([], CACHE)
