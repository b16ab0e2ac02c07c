"""PNG images as arrays of RGBA pixels, after ISO/IEC 15948: reading all colour types and writing 8-bit ones.

Scanline filters are undone without a loop over pixels.  None, Sub and Up are
running sums.  Average and Paeth need the pixel to the left and two above, so a
band of rows is laid out by anti-diagonals: every pixel of one depends only on
the two before it, and a whole anti-diagonal is done at once.  Small images share
such bands, a row of zeros before each, as their first rows have nothing above.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the standard: channels of each colour type and its bit depths.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Fixed values of the standard: first column and row, and steps, of the seven interlaced passes.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
NONE, SUB, UP, AVERAGE, PAETH = range(5)
BAND = 512


class PngError(ValueError):
    """A file that isn't a whole, valid PNG."""


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and content of each chunk up to the end chunk, checked."""
    if data[:8] != SIGNATURE:
        raise PngError("not a PNG")
    at = 8
    while at + 12 <= len(data):
        (size,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4:
            break
        if struct.unpack(">I", check)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise PngError(f"chunk {kind!r} is damaged")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise PngError("cut short")


def paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and above left, the one nearest to left + above - above left; the earlier of equals."""
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def skewed(rows: np.ndarray) -> np.ndarray:
    """Rows (n, width, bytes) by anti-diagonals: (width + n - 1, n, bytes), zeros outside."""
    n, width, size = rows.shape
    wide = np.zeros((n, width + n, size), rows.dtype)
    wide[:, :width] = rows
    return np.ascontiguousarray(wide.reshape(-1, size)[: n * (width + n - 1)].reshape(n, width + n - 1, size).transpose(1, 0, 2))


def straightened(diagonals: np.ndarray, width: int) -> np.ndarray:
    """The rows of `skewed` again."""
    long, n, size = diagonals.shape
    wide = np.zeros((n * (long + 1), size), diagonals.dtype)
    wide[: n * long] = diagonals.transpose(1, 0, 2).reshape(-1, size)
    return wide.reshape(n, long + 1, size)[:, :width]


def unfiltered_band(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A band of scanlines (n, pixels, bytes a pixel) of any filters, below the finished row `above`."""
    kinds = np.concatenate([[NONE], kinds])[:, None]
    raw = skewed(np.concatenate([above[None], rows])).astype(np.int16)
    out = np.zeros((len(raw) + 2, *raw.shape[1:]), np.int16)
    # masks as wide as the rows, all ones where a neighbour counts: a comparison that is spread over few bytes costs more than the arithmetic
    whole = lambda *of: np.ascontiguousarray(np.broadcast_to(-np.isin(kinds, of).astype(np.int16), (len(kinds), rows.shape[2])))
    left_mask, over_mask, is_paeth, halves = whole(SUB, AVERAGE), whole(UP, AVERAGE), whole(PAETH), -whole(AVERAGE)
    for d in range(len(raw)):
        # pixels outside the image are zeros to their neighbours
        lo, hi = max(0, d - (rows.shape[1] - 1)), min(len(kinds), d + 1)
        at = slice(lo, hi)
        left, over, corner = out[d + 1, at], np.zeros_like(raw[d, at]), np.zeros_like(raw[d, at])
        skip = lo == 0
        over[skip:], corner[skip:] = out[d + 1, lo + skip - 1 : hi - 1], out[d, lo + skip - 1 : hi - 1]
        guess = (((left & left_mask[at]) + (over & over_mask[at])) >> halves[at]) + (paeth(left, over, corner) & is_paeth[at])
        out[d + 2, at] = (raw[d, at] + guess) & 255
    return straightened(out[2:], rows.shape[1])[1:].astype(np.uint8)


def unfiltered(data: np.ndarray, height: int, stride: int, size: int) -> np.ndarray:
    """Scanlines without their filters, (height, stride), for `size` bytes a pixel."""
    lines = data.reshape(height, stride + 1)
    kinds, rows = lines[:, 0], lines[:, 1:].reshape(height, stride // size, size)
    if kinds.max(initial=0) > PAETH:
        raise PngError("no such filter")
    out, at = np.empty_like(rows), 0
    above = np.zeros(rows.shape[1:], np.uint8)
    while at < height:
        kind, to = kinds[at], at + 1
        if kind in (AVERAGE, PAETH):
            # plain rows between such rows go along, a longer run of them ends the band
            last = at
            while to < height and to - at < BAND and to - last < 8:
                last = to if kinds[to] in (AVERAGE, PAETH) else last
                to += 1
            to = last + 1
            out[at:to] = unfiltered_band(kinds[at:to], rows[at:to], above)
        else:
            while to < height and kinds[to] == kind:
                to += 1
            own = rows[at:to]
            if kind == SUB:
                own = np.cumsum(own, axis=1, dtype=np.uint8)
            elif kind == UP:
                own = np.cumsum(np.concatenate([above[None], own]), axis=0, dtype=np.uint8)[1:]
            out[at:to] = own
        above, at = out[to - 1], to
    return out.reshape(height, stride)


def samples(lines: np.ndarray, width: int, channels: int, depth: int) -> np.ndarray:
    """Samples (height, width, channels) of scanlines, as they are stored."""
    if depth == 16:
        return lines.reshape(len(lines), width, channels, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if depth == 8:
        return lines.reshape(len(lines), width, channels)
    bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(len(lines), width, 1, depth)
    return bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)


def to_rgba(raw: np.ndarray, colour: int, depth: int, palette: np.ndarray | None, clear: bytes | None) -> np.ndarray:
    """Samples as 8-bit RGBA: scaled to the full range with rounding, palette and transparency applied."""
    full = (1 << depth) - 1
    out = np.full((*raw.shape[:2], 4), 255, np.uint8)
    if colour == 3:
        if palette is None:
            raise PngError("no palette")
        if raw.max(initial=0) >= len(palette):
            raise PngError("a colour is outside the palette")
        alpha = np.full(len(palette), 255, np.uint8)
        if clear:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        out[..., :3], out[..., 3] = palette[raw[..., 0]], alpha[raw[..., 0]]
        return out
    eight = ((raw.astype(np.uint32) * 255 + full // 2) // full).astype(np.uint8) if depth != 8 else raw
    grey = colour in (0, 4)
    out[..., :3] = eight[..., :1] if grey else eight[..., :3]
    if colour in (4, 6):
        out[..., 3] = eight[..., -1]
    elif clear is not None:
        key = np.frombuffer(clear, ">u2")
        if len(key) != raw.shape[2]:
            raise PngError("a wrong transparent colour")
        out[..., 3][(raw == key).all(axis=2)] = 0
    return out


class Opened(NamedTuple):
    """A file's header, colours and inflated passes: place, width, height and filtered lines of each."""

    head: tuple[int, int, int, int]
    palette: np.ndarray | None
    clear: bytes | None
    passes: list[tuple[tuple[int, int, int, int], int, int, np.ndarray]]


def opened(data: bytes, most_pixels: int) -> Opened:
    head, palette, clear, packed = None, None, None, []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            if len(body) != 13:
                raise PngError("a wrong header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            if not body or len(body) % 3:
                raise PngError("a wrong palette")
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed.append(body)
        elif not kind[0] & 32 and kind != b"IEND":
            raise PngError(f"chunk {kind!r} is unknown")
    if head is None:
        raise PngError("no header")
    width, height, depth, colour, compression, filters, interlaced = head
    if not width or not height or depth not in DEPTHS.get(colour, ()) or compression or filters or interlaced > 1:
        raise PngError("a wrong header")
    if width * height > most_pixels:
        raise PngError(f"{width} x {height} pixels are more than {most_pixels}")
    channels = CHANNELS[colour]
    bits, size = channels * depth, max(1, channels * depth // 8)
    areas = [(0, 0, 1, 1)] if not interlaced else PASSES
    shapes = [(-(-(width - x) // dx), -(-(height - y) // dy)) if x < width and y < height else (0, 0) for x, y, dx, dy in areas]
    need = sum(h * (1 + -(-w * bits // 8)) for w, h in shapes if w)
    try:
        inflate = zlib.decompressobj()
        flat = inflate.decompress(b"".join(packed), need)
    except zlib.error as e:
        raise PngError(f"damaged pixels: {e}") from None
    if len(flat) < need:
        raise PngError("too few pixels")
    bytes_, at, passes = np.frombuffer(flat, np.uint8), 0, []
    for area, (w, h) in zip(areas, shapes, strict=True):
        if w:
            lines = bytes_[at : at + h * (1 + -(-w * bits // 8))].reshape(h, -1)
            if lines[:, 0].max() > PAETH:
                raise PngError("no such filter")
            passes.append((area, w, h, lines))
            at += lines.size
    return Opened((width, height, depth, colour), palette, clear, passes)


def laid(image: Opened, plain: list[np.ndarray]) -> np.ndarray:
    """RGBA pixels of the passes' scanlines without filters."""
    width, height, depth, colour = image.head
    out = np.empty((height, width, 4), np.uint8)
    for ((x, y, dx, dy), w, _, _), lines in zip(image.passes, plain, strict=True):
        out[y::dy, x::dx] = to_rgba(samples(lines, w, CHANNELS[colour], depth), colour, depth, image.palette, image.clear)
    return out


def together(images: list[Opened | PngError]) -> list[np.ndarray | PngError]:
    """The pixels of each image; passes of equal stride are laid below each other, a row of zeros before each."""
    alike: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, image in enumerate(images):
        if isinstance(image, Opened):
            for n, (_, _, _, lines) in enumerate(image.passes):
                alike.setdefault((lines.shape[1] - 1, max(1, CHANNELS[image.head[3]] * image.head[2] // 8)), []).append((i, n))
    plain: dict[tuple[int, int], np.ndarray] = {}
    for (stride, size), spots in alike.items():
        own, zeros = [images[i].passes[n][3] for i, n in spots], np.zeros((1, stride + 1), np.uint8)
        rows = own[0] if len(own) == 1 else np.concatenate([x for lines in own for x in (zeros, lines)])
        done, at = unfiltered(rows, len(rows), stride, size), 0
        for spot, lines in zip(spots, own, strict=True):
            at += len(own) > 1
            plain[spot] = done[at : at + len(lines)]
            at += len(lines)
    out: list[np.ndarray | PngError] = []
    for i, image in enumerate(images):
        try:
            out.append(laid(image, [plain[i, n] for n in range(len(image.passes))]) if isinstance(image, Opened) else image)
        except PngError as e:
            out.append(e)
    return out


def decode_each(files: Iterable[bytes], most_pixels: int = 1 << 27) -> Iterator[np.ndarray | PngError]:
    """RGBA pixels (height, width, 4) of each file in order, or its error; about two bands of rows or a large image are held at a time."""
    held, rows = [], 0
    for data in files:
        try:
            image = opened(data, most_pixels)
        except PngError as e:
            image = e
        more = sum(h for _, _, h, _ in image.passes) if isinstance(image, Opened) else 1
        if held and rows + more > 2 * BAND:
            yield from together(held)
            held, rows = [], 0
        held.append(image)
        rows += more
    yield from together(held)


def decode(data: bytes, most_pixels: int = 1 << 27) -> np.ndarray:
    """RGBA pixels (height, width, 4).  PngError for what isn't a whole, valid PNG, and for more than `most_pixels`."""
    (made,) = decode_each([data], most_pixels)
    if isinstance(made, PngError):
        raise made
    return made


def filtered(rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Scanlines (n, pixels, bytes a pixel) with the filter each that gives the least sum of absolute differences."""
    n, pixels, size = rows.shape
    x = rows.astype(np.int16)
    b = np.concatenate([above[None].astype(np.int16), x[:-1]])
    a, c = np.zeros_like(x), np.zeros_like(x)
    a[:, 1:], c[:, 1:] = x[:, :-1], b[:, :-1]
    guesses = (0, a, b, (a + b) >> 1, paeth(a, b, c))
    best, least = None, None
    for kind, guess in enumerate(guesses):
        made = ((x - guess) & 255).astype(np.uint8).reshape(n, -1)
        cost = np.abs(made.view(np.int8).astype(np.int32)).sum(axis=1)
        if best is None:
            best, least = np.concatenate([np.zeros((n, 1), np.uint8), made], axis=1), cost
        else:
            better = cost < least
            best[better, 0], best[better, 1:], least[better] = kind, made[better], cost[better]
    return best


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode(rgba: np.ndarray, level: int = 6) -> bytes:
    """A PNG of RGBA pixels: 8-bit RGB where all are opaque, else RGBA; a band of rows at a time."""
    height, width = rgba.shape[:2]
    if not height or not width:
        raise PngError("an image has at least one pixel")
    opaque = bool((rgba[..., 3] == 255).all())
    pixels = rgba[..., :3] if opaque else rgba
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if opaque else 6, 0, 0, 0))]
    z, above = zlib.compressobj(level), np.zeros((width, pixels.shape[2]), np.uint8)
    for at in range(0, height, BAND):
        rows = pixels[at : at + BAND]
        packed = z.compress(filtered(rows, above).tobytes())
        if packed:
            out.append(_chunk(b"IDAT", packed))
        above = rows[-1]
    out += [_chunk(b"IDAT", z.flush()), _chunk(b"IEND", b"")]
    return b"".join(out)
