"""Token ids of whole texts by the tokenizers library, one call per distinct piece.

A byte-level BPE splits a text before every blank that is followed by a
non-blank, whatever comes before or after; so a text's ids are those of its
pieces, joined.  Pieces repeat, texts don't: a worker keeps the ids of the
pieces that it met lately, in arrays, in two generations of at most KEPT_BYTES
each, and tells pieces apart by 64-bit hashes and their lengths.  Texts where
the rule doesn't hold (a blank before other white space or an end, or a special
token's string) are encoded whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from . import shared
from . import textvec as tv

KEPT_BYTES = 32 << 20
_PIECE = np.ones(256, bool)
_PIECE[32] = False


def byte_characters() -> dict[int, str]:
    """The published byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def white_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that begins at each place is white space (as Unicode has it, and the four separators below the blank)."""
    wide = np.concatenate([data, np.zeros(3, np.uint8)])
    a, b, c = wide[at], wide[at + 1], wide[at + 2]
    out = (a == 32) | ((a >= 9) & (a <= 13)) | ((a >= 28) & (a <= 31))
    out |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    out |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    out |= (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    return out | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each first on, as many as its size says."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


class Pieces:
    """Ids of pieces, found by key; keys ascend."""

    def __init__(self):
        self.key, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.at, self.n = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def bytes(self) -> int:
        return 20 * len(self.key) + 4 * self.used

    def find(self, key: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 for what isn't here."""
        if not len(self.key):
            return np.full(len(key), -1)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[i] == key) & (self.size[i] == size), i, -1)

    def add(self, key: np.ndarray, size: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Adds ascending keys that aren't here."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(ids), self.used // 2), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = self.used + np.cumsum(n) - n
        self.used += len(ids)
        where = np.searchsorted(self.key, key)
        for name, new in (("key", key), ("size", size), ("at", at), ("n", n)):
            old = getattr(self, name)
            setattr(self, name, np.insert(old, where, new.astype(old.dtype)))


class PieceEncoder:
    """encode(texts) -> list of bytes: little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.pieces, self.older = Pieces(), Pieces()
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        decoder = {c: b for b, c in byte_characters().items()}
        size = self.tok.get_vocab_size()
        self.width = np.zeros(size, np.int64)
        for piece, i in self.tok.get_vocab().items():
            self.width[i] = len(piece) if all(c in decoder for c in piece) else 0
        self.splits = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 64):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]
        return out

    def joined(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and how many each has: encoded as one text with their blanks, and cut where their bytes end."""
        text = data[_ranges(begin - 1, end - begin + 1)].tobytes()
        ids = np.array(self.tok.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
        ends, stops = np.cumsum(self.width[ids]), np.cumsum(end - begin + 1)
        cut = np.searchsorted(ends, stops, side="left") + 1
        if not len(ends) or ends[-1] != stops[-1] or not np.array_equal(ends[cut - 1], stops):
            own = self.whole([data[a - 1 : b].tobytes().decode("utf-8", "replace") for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
            return np.frombuffer(b"".join(own), "<u4"), np.array([len(x) // 4 for x in own])
        return ids, np.diff(cut, prepend=0)

    def learn(self, data: np.ndarray, key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places in `pieces` of distinct ascending keys; what isn't there is encoded, or comes from the older generation."""
        if self.pieces.bytes() > KEPT_BYTES:
            self.older, self.pieces = self.pieces, Pieces()
        size = (end - begin).astype(np.int32)
        new = np.flatnonzero(self.pieces.find(key, size) < 0)
        old = self.older.find(key[new], size[new])
        again, new, old = new[old >= 0], new[old < 0], old[old >= 0]
        parts = [(again, self.older.n[old], self.older.ids[_ranges(self.older.at[old].astype(np.int64), self.older.n[old])])]
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            ids, n = self.joined(data, begin[some], end[some])
            parts.append((some, n, ids))
        for some, n, ids in parts:
            if len(some):
                self.pieces.add(key[some], size[some], n, ids)
        return self.pieces.find(key, size)

    def encode(self, texts) -> list[bytes]:
        """Ids of each text of a list or an Arrow column; null counts as empty."""
        data, offs = tv.text_buffers(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string()))
        n = len(offs) - 1
        filled = offs[1:] > offs[:-1]
        odd = np.zeros(n, bool) if self.splits else filled.copy()
        if len(data):
            odd[filled] |= data[offs[:-1][filled]] == 32
            blank = np.flatnonzero(data == 32)
            text = np.searchsorted(offs, blank, side="right") - 1
            odd[text[(blank + 1 == offs[text + 1]) | white_space(data, blank + 1)]] = True
            raw = data.tobytes()
            for s in self.special:
                at = raw.find(s)
                while at >= 0:
                    odd[np.searchsorted(offs, at, side="right") - 1] = True
                    at = raw.find(s, at + 1)
        key, begin, end = tv.hashed_spans(data, offs, _PIECE, tv.EXACT)
        text = np.searchsorted(offs, begin, side="right") - 1
        keep = ~odd[text]
        key, begin, end, text = key[keep], begin[keep], end[keep], text[keep]
        head = begin == offs[text]
        heads = self.whole([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(begin[head].tolist(), end[head].tolist(), strict=True)])
        size = np.empty(len(key), np.int64)
        size[head] = [len(x) // 4 for x in heads]
        body = np.flatnonzero(~head)
        order = np.argsort(key[body])
        s = key[body][order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        one = body[order[first]]
        place = self.learn(data, key[one], begin[one], end[one])
        found = np.empty(len(body), np.int64)
        found[order] = np.repeat(place, np.diff(first, append=len(s)))
        size[body] = self.pieces.n[found]
        at = np.cumsum(size) - size
        ids = np.empty(int(size.sum()), "<u4")
        ids[_ranges(at[head], size[head])] = np.frombuffer(b"".join(heads), "<u4")
        ids[_ranges(at[body], size[body])] = self.pieces.ids[_ranges(self.pieces.at[found].astype(np.int64), size[body])]
        stop = 4 * np.bincount(text, size, minlength=n)[:n].astype(np.int64).cumsum()
        raw, out = ids.tobytes(), []
        for a, b in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True):
            out.append(raw[a:b])
        left = np.flatnonzero(odd)
        for i, x in zip(left.tolist(), self.whole([data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace") for i in left.tolist()]), strict=True):
            out[i] = x
        return out


_ENCODERS: dict[str, PieceEncoder] = shared.kept("encoders")


def encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, found where the code runs."""
    import public_tokenizers

    return public_tokenizers.path(name)
