"""Registered queries over images that Spark makes from the given tables, and their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import images, reads, regions
from ..sources import files, readers
from .catalog import registered, table


def weights(rasters: DataFrame, *keep: str) -> DataFrame:
    """Of each raster the sum of its bytes, each times its place (from 1): any change or shift shows."""

    def each(batches):
        for b in batches:
            sums = [int(np.frombuffer(v.as_buffer(), np.uint8).astype(np.int64) @ np.arange(1, len(v.as_buffer()) + 1)) for v in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sums, pa.int64())], [*b.schema.names[:-1], "weight"])

    own = rasters.select(*keep, "rgba")
    return own.mapInArrow(each, ", ".join(f"{n} {t}" for n, t in own.dtypes[:-1]) + ", weight long")


_BYTES = "list_sum(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x, i: i * CAST(('0x' || x) AS BIGINT)))"


@registered(f"SELECT doc_id AS image_id, 256 AS width, CAST(greatest(1, ceil(strlen(coalesce(text, '')) / 1024.0)) AS INT) AS height, CAST(coalesce({_BYTES}, 0) AS BIGINT) AS weight FROM documents")
def png_round_trip(spark, sf_dir):
    """Each document's bytes as pixels, written as PNG files and read back from the folder."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    height = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 1024)).cast("int")
    rasters = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image_id"), F.lit(256).alias("width"), height.alias("height"), F.rpad(text, height * 1024, F.lit(b"\0")).alias("rgba"))
    folder = files.work_folder(spark, "png")
    readers.write_png(rasters, folder)
    found = readers.image_files(spark, folder).withColumn("image_id", F.regexp_extract("path", r"(-?[0-9]+)\.png$", 1))
    return weights(images.decoded(found, id_col="image_id"), "image_id", "width", "height")


def _squares(spark, sf_dir) -> DataFrame:
    """Embeddings as opaque gray images of 8 x 8 pixels."""
    gray = F.transform("embedding", lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 127).cast("int")), 2, "0"))
    rgba = F.unhex(F.array_join(F.transform(gray, lambda g: F.concat(g, g, g, F.lit("FF"))), ""))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), rgba.alias("rgba"))


def _resized(spark, sf_dir, side: int) -> DataFrame:
    from ..operators.images import _rows, pixels, resized

    made = _squares(spark, sf_dir).mapInPandas(lambda it: _rows(it, lambda r: resized(pixels(r), side, side)), images.RASTER)
    return weights(made, "image_id", "width", "height")


def _squares_sql(side: int, pixel: str) -> str:
    """Sum over new pixels of gray three times and 255, each times its place."""
    at = f"CAST(p // {side} AS BIGINT)", f"CAST(p % {side} AS BIGINT)"
    return (
        "WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127) AS BIGINT)) AS g FROM embeddings), "
        f"n AS (SELECT vec_id, p, {pixel.format(r=at[0], c=at[1])} AS v FROM g, (SELECT unnest(range(0, {side * side})) AS p)) "
        f"SELECT vec_id AS image_id, {side} AS width, {side} AS height, CAST(sum(v * (12 * p + 6) + 255 * (4 * p + 4)) AS BIGINT) AS weight FROM n GROUP BY vec_id"
    )


@registered(_squares_sql(4, "CAST(floor((g[16 * {r} + 2 * {c} + 1] + g[16 * {r} + 2 * {c} + 2] + g[16 * {r} + 2 * {c} + 9] + g[16 * {r} + 2 * {c} + 10] + 2) / 4) AS BIGINT)"))
def image_halves(spark, sf_dir):
    """Images made smaller: each new pixel is the mean of four."""
    return _resized(spark, sf_dir, 4)


_NEAR = "(8 * least(7, greatest(0, {r} // 2)) + least(7, greatest(0, {c} // 2)) + 1)"
_FAR_ROW = "(8 * least(7, greatest(0, {r} // 2 + 2 * ({r} % 2) - 1)) + least(7, greatest(0, {c} // 2)) + 1)"
_FAR_COLUMN = "(8 * least(7, greatest(0, {r} // 2)) + least(7, greatest(0, {c} // 2 + 2 * ({c} % 2) - 1)) + 1)"
_FAR_BOTH = "(8 * least(7, greatest(0, {r} // 2 + 2 * ({r} % 2) - 1)) + least(7, greatest(0, {c} // 2 + 2 * ({c} % 2) - 1)) + 1)"


@registered(_squares_sql(16, f"CAST(floor((9 * g[{_NEAR}] + 3 * g[{_FAR_ROW}] + 3 * g[{_FAR_COLUMN}] + g[{_FAR_BOTH}] + 8) / 16) AS BIGINT)"))
def image_doubles(spark, sf_dir):
    """Images made larger: linear between the centres of the old pixels."""
    return _resized(spark, sf_dir, 16)


def _page_reader():
    """Reads pages that are wide and bright at the top left: as many words as the sides' ratio; of others one that isn't sure."""

    def read(row):
        a = images.pixels(row)[..., 0].astype(float)
        h, w = a.shape
        corners = [a[: h // 2, : w // 2], a[: h // 2, w // 2 :], a[h // 2 :, w // 2 :], a[h // 2 :, : w // 2]]
        upright = w > h and int(np.argmax([c.mean() if c.size else 0 for c in corners])) == 0
        n = round(w / h) if upright else 1
        return pd.DataFrame({"block": 0, "para": 0, "line": 0, "word": range(n), "text": "word" if upright else "x", "confidence": 90.0 if upright else 10.0, "x0": 0.0, "y0": 0.0, "x1": float(w), "y1": float(h)})

    return read


@registered("SELECT p_partkey AS image_id, CAST((4 - p_partkey % 4) % 4 AS INT) AS quarter_turns, CAST(3 + p_size % 10 AS INT) AS words, array_to_string(list_transform(range(0, 3 + p_size % 10), lambda i: 'word'), ' ') || chr(10) AS text FROM part")
def turned_pages(spark, sf_dir):
    """Pages laid in all four turns, read in the one that fits; parts with the same page share a read."""
    n = (F.col("p_size") % 10 + 3).cast("int")
    top = F.concat(F.repeat(F.lit("FFFFFFFF"), 2 * n), F.repeat(F.lit("0A0A0AFF"), 2 * n))
    rgba = F.unhex(F.concat(top, top, F.repeat(F.lit("0A0A0AFF"), 8 * n)))
    upright = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (4 * n).alias("width"), F.lit(4).alias("height"), rgba.alias("rgba"), (F.col("p_partkey") % 4).cast("int").alias("quarter_turns"))
    found = reads.read_upright(images.orient(upright), _page_reader, "page-reader-1", files.work_folder(spark, "reads"))
    text = regions.rebuild_text(reads.word_rows(found))
    return found.select("image_id", "quarter_turns").join(text, "image_id").select("image_id", "quarter_turns", F.size("words").alias("words"), "text")
