"""Raster operators over rows of raw RGBA pixels, Arrow batches at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import png

#: Side limits in pixels, the largest enlargement, and the weights of luma.
MAX_SIDE, SEARCH_SIDE, OCR_SIDE, OCR_SCALE, LUMA = 4096, 1200, 2400, 2.0, (0.299, 0.587, 0.114)
RASTER = "image_id long, width int, height int, rgba binary"


def pixels(row) -> np.ndarray:
    return np.frombuffer(row.rgba, np.uint8).reshape(row.height, row.width, 4)


def bands(size: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """The banded matrix that resamples `size` pixels to `to`: for each new pixel the old ones and their weights.

    A smaller side averages what each new pixel covers; a larger one is linear
    between the centres of the two nearest, and constant beyond the outer ones.
    """
    if to >= size:
        centre = (np.arange(to) + 0.5) * size / to - 0.5
        first = np.floor(centre)
        share = centre - first
        return np.clip(first[:, None].astype(int) + np.arange(2), 0, size - 1), np.stack([1 - share, share], axis=1)
    begin, end = np.arange(to) * size / to, (np.arange(to) + 1) * size / to
    index = np.floor(begin)[:, None].astype(int) + np.arange(-(-size // to) + 1)
    weight = np.maximum(np.minimum(end[:, None], index + 1) - np.maximum(begin[:, None], index), 0)
    return np.minimum(index, size - 1), weight / weight.sum(axis=1, keepdims=True)


def resized(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels resampled by one banded product over rows and one over columns, rounded half up.

    Colours count by their alpha, so what a clear pixel holds doesn't show.  A
    band of new rows is made at a time.
    """
    if a.shape[:2] == (height, width):
        return a
    (rows, row_weights), (cols, col_weights) = bands(a.shape[0], height), bands(a.shape[1], width)
    out = np.empty((height, width, 4), np.uint8)
    for at in range(0, height, 64):
        index, weight = rows[at : at + 64], row_weights[at : at + 64]
        low = index.min()
        x = a[low : index.max() + 1].astype(np.float64)
        x[..., :3] *= x[..., 3:] / 255
        y = sum(weight[:, t, None, None] * x[index[:, t] - low] for t in range(index.shape[1]))
        z = sum(col_weights[None, :, t, None] * y[:, cols[:, t]] for t in range(cols.shape[1]))
        alpha = z[..., 3:]
        z[..., :3] = np.divide(z[..., :3] * 255, alpha, out=np.zeros_like(z[..., :3]), where=alpha > 0)
        out[at : at + 64] = np.floor(np.clip(z, 0, 255) + 0.5)
    return out


def capped_size(width: int, height: int, cap: int) -> tuple[int, int]:
    scale = min(1.0, cap / max(width, height))
    return max(1, round(width * scale)), max(1, round(height * scale))


def oriented(a: np.ndarray, turns: int, cap: int = MAX_SIDE) -> np.ndarray:
    """Quarter turns clockwise, any integer; never enlarged."""
    w, h = capped_size(a.shape[1], a.shape[0], cap)
    return np.rot90(resized(a, w, h), -(turns % 4))


def luma(a: np.ndarray) -> np.ndarray:
    return (a[..., 0] * LUMA[0] + a[..., 1] * LUMA[1] + a[..., 2] * LUMA[2]).astype(np.uint8)


def histogram(gray: np.ndarray) -> np.ndarray:
    return np.bincount(gray.ravel(), minlength=256)


def cut(counts: np.ndarray, share: float = 0.02) -> tuple[int, int]:
    need = share * counts.sum()
    return int(np.argmax(np.cumsum(counts) >= need)), 255 - int(np.argmax(np.cumsum(counts[::-1]) >= need))


def preprocessed(a: np.ndarray) -> tuple[np.ndarray, float]:
    """Enlarged if small, gray, stretched between the cut-off bins; and the scale."""
    scale = min(OCR_SCALE, max(1.0, OCR_SIDE / max(a.shape[:2])))
    if scale > 1:
        a = resized(a, round(a.shape[1] * scale), round(a.shape[0] * scale))
    gray = luma(a)
    lo, hi = cut(histogram(gray))
    if lo != hi:
        gray = np.clip((gray.astype(float) - lo) * 255 / (hi - lo), 0, 255).astype(np.uint8)
    return np.dstack([gray, gray, gray, np.full_like(gray, 255)]), scale


def painted(a: np.ndarray, rects) -> np.ndarray:
    """Opaque near-black fill over each rectangle, clipped to the image."""
    out = a.copy()
    for r in rects:
        x0, y0, x1, y1 = max(0, int(np.floor(r["x"]))), max(0, int(np.floor(r["y"]))), int(np.ceil(r["x"] + r["w"])), int(np.ceil(r["y"] + r["h"]))
        out[y0 : max(y0, y1), x0 : max(x0, x1)] = (10, 10, 10, 255)
    return out


def _rows(frames, change: Callable, extra: tuple[str, ...] = ()):
    for pdf in frames:
        rows = []
        for row in pdf.itertuples(index=False):
            made = change(row)
            a, more = made if isinstance(made, tuple) else (made, ())
            rows.append((row.image_id, a.shape[1], a.shape[0], np.ascontiguousarray(a).tobytes(), *more))
        yield pd.DataFrame(rows, columns=["image_id", "width", "height", "rgba", *extra])


def orient(images: DataFrame, turns_col: str = "quarter_turns", cap: int = MAX_SIDE) -> DataFrame:
    own = images.select("image_id", "width", "height", "rgba", F.col(turns_col).alias("turns"))
    return own.mapInPandas(lambda it: _rows(it, lambda r: oriented(pixels(r), int(r.turns), cap)), RASTER)


def all_turns(images: DataFrame, cap: int = SEARCH_SIDE) -> DataFrame:
    """Each image in all four quarter turns, small: the columns of a raster and quarter_turns."""
    own = images.select("image_id", "width", "height", "rgba", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("turns"))
    return own.mapInPandas(lambda it: _rows(it, lambda r: (oriented(pixels(r), int(r.turns), cap), (int(r.turns),)), ("quarter_turns",)), RASTER + ", quarter_turns int")


def preprocess(images: DataFrame) -> DataFrame:
    def change(r):
        a, scale = preprocessed(pixels(r))
        return a, (scale,)

    return images.select("image_id", "width", "height", "rgba").mapInPandas(lambda it: _rows(it, change, ("scale",)), RASTER + ", scale double")


def paint(images: DataFrame, rects_col: str = "rects") -> DataFrame:
    own = images.select("image_id", "width", "height", "rgba", F.col(rects_col).alias("rects"))
    return own.mapInPandas(lambda it: _rows(it, lambda r: painted(pixels(r), r.rects if r.rects is not None else ())), RASTER)


def _batched(rows, kinds: dict, most: int = 1 << 22):
    """Rows as record batches of about `most` bytes in their binary columns."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size >= most or len(held) == 1000:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))


def decoded(files: DataFrame, cap: int = MAX_SIDE, most_pixels: int = 1 << 27, id_col: str | None = None, content_col: str = "content") -> DataFrame:
    """PNG files (rows of `path` and content) as rasters, no side over `cap`: path, the raster's columns, and error.

    A file that isn't a whole PNG, or has more than `most_pixels`, is a row with
    its error and no pixels.  `image_id` is the named column, else a hash of the
    path.
    """

    def read(made) -> tuple:
        if isinstance(made, png.PngError):
            return None, None, None, str(made)
        a = oriented(made, 0, cap)
        return a.shape[1], a.shape[0], np.ascontiguousarray(a).tobytes(), None

    kinds = {"path": pa.string(), "image_id": pa.int64(), "width": pa.int32(), "height": pa.int32(), "rgba": pa.binary(), "error": pa.string()}

    def each(batches):
        for b in batches:
            contents = ((v.as_py() or b"") for v in b.column(2))
            yield from _batched(((b.column(0)[i].as_py(), b.column(1)[i].as_py(), *read(made)) for i, made in enumerate(png.decode_each(contents, most_pixels))), kinds)

    image_id = F.col(id_col).cast("long") if id_col else F.xxhash64("path")
    return files.select("path", image_id.alias("image_id"), F.col(content_col).alias("content")).mapInArrow(each, f"path string, {RASTER}, error string")


def as_png(images: DataFrame, level: int = 6) -> DataFrame:
    """image_id and the image as a PNG; rasters without pixels (or with null ones) are left out."""

    def each(batches):
        for b in batches:
            rows = ((c[i].as_py() for c in b.columns) for i in range(b.num_rows))
            made = ((image_id, png.encode(np.frombuffer(rgba, np.uint8).reshape(height, width, 4), level)) for image_id, width, height, rgba in rows)
            yield from _batched(made, {"image_id": pa.int64(), "png": pa.binary()})

    whole = images.select("image_id", "width", "height", "rgba").where("rgba is not null and width > 0 and height > 0")
    return whole.mapInArrow(each, "image_id long, png binary")


def gray_histogram(images: DataFrame) -> DataFrame:
    """image_id, bin, pixels for all 256 bins; a frame for each batch of images."""

    def each(frames):
        for pdf in frames:
            counts = [histogram(luma(pixels(row))) for row in pdf.itertuples(index=False)]
            if counts:
                yield pd.DataFrame({"image_id": np.repeat(pdf["image_id"].to_numpy(), 256), "bin": np.tile(np.arange(256), len(counts)), "pixels": np.concatenate(counts)})

    return images.select("image_id", "width", "height", "rgba").mapInPandas(each, "image_id long, bin int, pixels long")


#: Loaded models of this worker process, by the version that the caller names.
_HELD: dict[str, Callable] = {}


def held(version: str, load: Callable[[], Callable]) -> Callable:
    """The model of a version, loaded once for each process; a load that fails leaves nothing, so the next call tries again."""
    if version not in _HELD:
        _HELD[version] = load()
    return _HELD[version]


def with_model(images: DataFrame, model: Callable[[], Callable], schema: str, error_col: str | None = None, version: str | None = None) -> DataFrame:
    """Rows from an external model (OCR words, faces).

    `model` loads it: once for each worker process where `version` names it, and
    then a failed load is a failure of the image that asked for it; else once for
    each task.  An image that it fails on gives no
    rows, so text findings stay; with `error_col`, a string column of the
    schema, it gives one row that holds the image's id and the reason.
    """
    names = [f.name for f in StructType.fromDDL(schema).fields]

    def each(frames):
        run = None if version else model()
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                try:
                    out = (run or held(version, model))(row)
                except Exception as e:  # noqa: BLE001  best effort for each image
                    if error_col:
                        known = {"image_id": row.image_id, error_col: f"{type(e).__name__}: {e}"}
                        yield pd.DataFrame({n: pd.Series([known.get(n)], dtype=object) for n in names})
                    continue
                if len(out):
                    yield out.assign(**{error_col: None}) if error_col else out

    return images.mapInPandas(each, schema)
