"""PNG files made by hand for every colour type, depth and filter; writing; resizing against a plain loop."""

import random
import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.operators import images
from veilframe.sources import files, png, readers


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def plain_filter(kind, row, above, size):
    """One scanline filtered, byte by byte."""
    out = bytearray([kind])
    for i, v in enumerate(row):
        a, b, c = row[i - size] if i >= size else 0, above[i], above[i - size] if i >= size else 0
        p = a + b - c
        nearest = min((abs(p - x), n, x) for n, x in enumerate((a, b, c)))[2]
        out.append((v - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
    return bytes(out)


def packed_bits(values, depth):
    bits = "".join(f"{v:0{depth}b}" for v in values)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def made(rng, width, height, colour, depth, interlaced=False, clear=None, filters=range(5)):
    """A file, and the RGBA pixels it stands for."""
    channels, top = png.CHANNELS[colour], (1 << depth) - 1
    palette = [[rng.randrange(256) for _ in range(3)] for _ in range(min(256, 1 << depth))]
    grid = [[tuple(rng.choice([0, top, rng.randint(0, top)]) for _ in range(channels)) for _ in range(width)] for _ in range(height)]
    eight = lambda v: int(Fraction(v * 255, top) + Fraction(1, 2))
    want = np.zeros((height, width, 4), np.uint8)
    for y, row in enumerate(grid):
        for x, v in enumerate(row):
            if colour == 3:
                want[y, x] = (*palette[v[0]], clear[v[0]] if clear and v[0] < len(clear) else 255)
                continue
            rgb = [eight(v[0])] * 3 if colour in (0, 4) else [eight(c) for c in v[:3]]
            want[y, x] = (*rgb, eight(v[-1]) if colour in (4, 6) else 0 if clear and v == tuple(clear) else 255)
    flat = b""
    size = max(1, channels * depth // 8)
    for x0, y0, dx, dy in png.PASSES if interlaced else ((0, 0, 1, 1),):
        part = [row[x0::dx] for row in grid[y0::dy]]
        if not part or not part[0]:
            continue
        above = None
        for row in part:
            raw = packed_bits([c for v in row for c in v], depth) if depth < 16 else b"".join(struct.pack(">H", c) for v in row for c in v)
            flat += plain_filter(rng.choice(list(filters)), raw, above or bytes(len(raw)), size)
            above = raw
    z = zlib.compress(flat)
    parts = [png.SIGNATURE, chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced))), chunk(b"tEXt", b"a\0b")]
    parts += [chunk(b"PLTE", bytes(c for p in palette for c in p))] * (colour == 3)
    if clear:
        parts.append(chunk(b"tRNS", bytes(clear) if colour == 3 else b"".join(struct.pack(">H", c) for c in clear)))
    cut = len(z) // 2
    return b"".join([*parts, chunk(b"IDAT", z[:cut]), chunk(b"IDAT", z[cut:]), chunk(b"IEND", b"")]), want


@pytest.mark.parametrize("colour, depth", [(c, d) for c, ds in png.DEPTHS.items() for d in ds])
@pytest.mark.parametrize("interlaced", [False, True])
def test_every_colour_type_and_depth(colour, depth, interlaced):
    rng = random.Random(colour * 100 + depth)
    for width, height in ((1, 1), (3, 2), (13, 9), (8, 33)):
        top = (1 << depth) - 1
        clear = {0: [top], 2: [top, 0, top], 3: [7, 0, 200]}.get(colour)
        for with_clear in (None, clear):
            data, want = made(rng, width, height, colour, depth, interlaced, with_clear)
            assert np.array_equal(png.decode(data), want)


@pytest.mark.parametrize("filters", [[k] for k in range(5)] + [[0, 3], [1, 2, 4], [2, 3]])
def test_every_filter(filters, monkeypatch):
    monkeypatch.setattr(png, "BAND", 5)
    rng = random.Random(len(filters))
    for shape in ((1, 40), (40, 1), (17, 23)):
        for colour, depth in ((2, 8), (6, 8), (0, 1), (6, 16)):
            data, want = made(rng, *shape, colour, depth, filters=filters)
            assert np.array_equal(png.decode(data), want)


def test_small_images_share_their_bands(monkeypatch):
    rng, sizes, unfiltered = random.Random(4), [], png.unfiltered
    monkeypatch.setattr(png, "unfiltered", lambda data, height, stride, size: sizes.append(height) or unfiltered(data, height, stride, size))
    kinds = [(w, h, c, d, i) for w, h in ((6, 3), (6, 1), (5, 9)) for c, d in ((6, 8), (2, 8), (3, 2), (0, 16)) for i in (False, True)] * 3
    files, want = zip(*(made(rng, *k) for k in kinds), strict=True)
    bad = list(damaged().values())
    got = list(png.decode_each([x for i, f in enumerate(files) for x in (f, bad[i % len(bad)])]))
    assert all(np.array_equal(a, b) for a, b in zip(got[::2], want, strict=True))
    assert all(isinstance(e, png.PngError) for e in got[1::2])
    assert len(sizes) < len(files)
    small = [png.encode(np.random.default_rng(i).integers(0, 256, (2, 64, 4), dtype=np.uint8).cumsum(axis=0, dtype=np.uint8)) for i in range(1500)]
    sizes.clear()
    assert len(list(png.decode_each(small))) == 1500 and max(sizes) <= 2 * (2 * png.BAND) and len(sizes) < 5


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10**6), width=st.integers(1, 40), height=st.integers(1, 40), kind=st.sampled_from(["noise", "flat", "slope", "opaque"]))
def test_what_is_written_reads_back(seed, width, height, kind):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 256, (height, width, 4), dtype=np.uint8)
    if kind == "flat":
        a[:] = a[0, 0]
    if kind == "slope":
        a[:] = (np.arange(width)[None, :, None] * 3 + np.arange(height)[:, None, None] * 5) % 256
    if kind == "opaque":
        a[..., 3] = 255
    assert np.array_equal(png.decode(png.encode(a)), a)


def test_writing_in_bands_and_large_images_end_soon(monkeypatch):
    a = np.random.default_rng(1).integers(0, 256, (1200, 900, 4), dtype=np.uint8)
    a[300:900] = (np.arange(900)[None, :, None] // 7 + np.arange(600)[:, None, None] // 5) % 256
    data = png.encode(a)
    assert np.array_equal(png.decode(data), a)
    kinds = {int(k) for k in zlib.decompress(b"".join(b for k, b in png.chunks(data) if k == b"IDAT"))[:: 900 * 4 + 1]}
    assert len(kinds) > 2  # rows choose their filters
    tall = np.zeros((20_000, 3, 4), np.uint8)
    tall[::2] = 77
    assert np.array_equal(png.decode(png.encode(tall)), tall)


def test_filters_are_chosen_by_the_least_sum():
    rng = np.random.default_rng(3)
    rows = np.cumsum(rng.integers(-3, 4, (40, 50, 3)), axis=1).astype(np.uint8)
    above = rng.integers(0, 256, (50, 3), dtype=np.uint8)
    got = png.filtered(rows, above)
    cost = lambda line: sum(min(v, 256 - v) for v in line[1:])
    for i in range(40):
        raw, over = rows[i].tobytes(), (rows[i - 1] if i else above).tobytes()
        each = [plain_filter(k, raw, over, 3) for k in range(5)]
        assert got[i].tobytes() == min(each, key=cost)


def damaged():
    good, _ = made(random.Random(1), 5, 4, 6, 8)
    paletted, _ = made(random.Random(1), 5, 4, 3, 8)
    head = lambda *v: chunk(b"IHDR", struct.pack(">IIBBBBB", *v))
    body = chunk(b"IDAT", zlib.compress(bytes(1000))) + chunk(b"IEND", b"")
    sig = png.SIGNATURE
    return {
        "empty": b"", "not": b"GIF89a" + bytes(50), "cut": good[:-20], "half": good[: len(good) // 2], "flipped": good[:45] + bytes([good[45] ^ 1]) + good[46:], "no header": sig + body,
        "depth": sig + head(5, 5, 3, 0, 0, 0, 0) + body, "colour": sig + head(5, 5, 8, 5, 0, 0, 0) + body, "no pixels": sig + head(0, 5, 8, 0, 0, 0, 0) + body, "method": sig + head(5, 5, 8, 0, 1, 0, 0) + body,
        "few": sig + head(500, 500, 8, 0, 0, 0, 0) + body, "inflate": sig + head(5, 5, 8, 0, 0, 0, 0) + chunk(b"IDAT", b"junk") + chunk(b"IEND", b""), "filter": sig + head(2, 1, 8, 0, 0, 0, 0) + chunk(b"IDAT", zlib.compress(b"\x09ab")) + chunk(b"IEND", b""),
        "no palette": sig + head(5, 5, 8, 3, 0, 0, 0) + body, "outside": paletted.replace(b"PLTE", b"PLTE") and sig + head(1, 1, 8, 3, 0, 0, 0) + chunk(b"PLTE", b"abc") + chunk(b"IDAT", zlib.compress(b"\0\x07")) + chunk(b"IEND", b""),
        "critical": sig + head(5, 5, 8, 0, 0, 0, 0) + chunk(b"ABCD", b"") + body, "large": sig + head(1 << 20, 1 << 20, 8, 0, 0, 0, 0) + body,
    }


@pytest.mark.parametrize("name", sorted(damaged()))
def test_damaged_files(name):
    with pytest.raises(png.PngError):
        png.decode(damaged()[name])


def test_files_in_a_folder(spark, tmp_path):
    rng = np.random.default_rng(5)
    rasters = [(i, w, h, bytearray(rng.integers(0, 256, (h, w, 4), dtype=np.uint8).tobytes())) for i, (w, h) in enumerate([(3, 5), (64, 2), (9, 30), (1, 1)])]
    df = spark.createDataFrame([*rasters, (9, 0, 0, None)], images.RASTER)
    told = readers.write_png(df, f"{tmp_path}/out")
    assert sorted(r.name for r in told.collect()) == [f"{i}.png" for i in range(4)]
    for name, data in damaged().items():
        (tmp_path / "out" / f"{name}.png").write_bytes(data)
    (tmp_path / "out" / "photo.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    found = images.decoded(readers.image_files(spark, f"{tmp_path}/out"), cap=20).collect()
    assert len(found) == 4 + len(damaged()) - 1 + 1  # Spark's reader has no row for a file of no bytes
    good = {int(r.path.split("/")[-1][:-4]): r for r in found if r.error is None}
    assert sorted(good) == [0, 1, 2, 3] and len({r.image_id for r in found}) == len(found)
    assert bytes(good[0].rgba) == bytes(rasters[0][3]) and (good[1].width, good[1].height) == (20, 1) and (good[2].width, good[2].height) == (6, 20)
    assert all(r.rgba is None and r.width is None and r.error for r in found if r.path.split("/")[-1][:-4] not in "0123")
    assert files.work_folder(spark, "x") != files.work_folder(spark, "x")


def test_many_small_files_are_few_tasks(spark, tmp_path):
    df = spark.range(1500).selectExpr("id image_id", "2 width", "1 height", "unhex(lpad(hex(id), 16, '0')) rgba")
    readers.write_png(df, f"{tmp_path}/out")
    found = readers.image_files(spark, f"{tmp_path}/out")
    assert found.rdd.getNumPartitions() <= 16
    got = images.decoded(found.withColumn("id", F.regexp_extract("path", "([0-9]+).png", 1)), id_col="id").select("image_id", F.conv(F.hex("rgba"), 16, 10).cast("long").alias("n"), "error").collect()
    assert sorted((r.image_id, r.n, r.error) for r in got) == [(i, i, None) for i in range(1500)]


def plain_resized(a, width, height):
    """Exact averages and linear values, pixel by pixel."""

    def taps(size, to, j):
        if to >= size:
            centre = Fraction((2 * j + 1) * size, 2 * to) - Fraction(1, 2)
            lo = centre.__floor__()
            return [(min(max(lo + t, 0), size - 1), (centre - lo) if t else 1 - (centre - lo)) for t in (0, 1)]
        begin, end = Fraction(j * size, to), Fraction((j + 1) * size, to)
        return [(i, (min(end, i + 1) - max(begin, i)) / (end - begin)) for i in range(begin.__floor__(), end.__ceil__())]

    out = np.zeros((height, width, 4))
    for y in range(height):
        for x in range(width):
            alpha, rgb = Fraction(0), [Fraction(0)] * 3
            for i, p in taps(a.shape[0], height, y):
                for j, q in taps(a.shape[1], width, x):
                    share = p * q * int(a[i, j, 3])
                    alpha += share
                    rgb = [c + share * int(v) for c, v in zip(rgb, a[i, j, :3], strict=True)]
            out[y, x] = (*(float(c / alpha) if alpha else 0.0 for c in rgb), float(alpha))
    return out


@pytest.mark.parametrize("shape, to", [((6, 8), (3, 4)), ((7, 9), (4, 5)), ((5, 3), (11, 8)), ((6, 5), (9, 2)), ((1, 1), (3, 3)), ((9, 9), (1, 1)), ((4, 4), (4, 7))])
def test_resized_is_the_plain_one(shape, to):
    rng = np.random.default_rng(shape[0])
    for clear in (False, True):
        a = rng.integers(0, 256, (*shape, 4), dtype=np.uint8)
        a[..., 3] = np.where(rng.random(shape) < 0.4, 0, a[..., 3]) if clear else 255
        want = plain_resized(a, to[1], to[0])
        got = images.resized(a, to[1], to[0]).astype(float)
        assert got.shape[:2] == to and (np.abs(got - want) <= 0.5 + 1e-6).all()


def test_resizing_in_bands_and_extremes():
    a = np.full((300, 5, 4), 200, np.uint8)
    assert (images.resized(a, 2, 150) == 200).all() and (images.resized(a, 11, 700) == 200).all()
    assert images.resized(a, 5, 300) is a
    steps = np.repeat(np.array([0, 255], np.uint8), 500)[:, None, None].repeat(4, 1).repeat(4, 2)
    steps[..., 3] = 255
    assert images.resized(steps, 4, 4)[..., 0].tolist() == [[0] * 4, [0] * 4, [255] * 4, [255] * 4]
