"""Byte-level BPE by a file of ranks: encoding with byte offsets, and decoding.

A rank file names tokens as bytes, by the order in which merges make them.  The
tokenizers library wants characters and pairs, so each byte becomes the
character that the published byte-level alphabet gives it, and each token the
pair of parts that it falls into when only lower ranks may merge; a match of the
pattern that is a token itself is taken whole.  Such a tokenizer
is built on the driver (its size is the vocabulary's) and goes to the tasks as
text.  Texts are encoded in Arrow batches, distinct pieces once for as long as a
worker keeps them (see `encoding`); nothing is shuffled.

Every byte of a text belongs to exactly one token, so offsets are running sums
of the tokens' byte lengths.  A character of several bytes may be split over
tokens: both of them then cover it, and a run of tokens that is decoded by
itself can begin and end inside a character.  `split_characters` sets such bytes
apart, and `CharacterStream` carries them to the next run.

Defined cases: null and empty texts have no tokens; repeated rows and null ids
are rows like any other; special strings are ordinary text; texts of any length
are encoded whole; an empty table gives no rows; further columns are ignored.
Decoding a null id, or one outside the vocabulary, raises ValueError; a null list
decodes to the empty text; bytes that aren't UTF-8 become U+FFFD in a text and stay as they
are in the bytes.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import textvec as tv
from .encoding import PieceEncoder, Pieces, byte_characters, vocabulary

#: Fixed value: the published pattern of this vocabulary, under which a text may be cut before any blank that is followed by a non-blank.
BLANK_FIRST = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids whose bytes are gathered at once.
RUN = 1 << 16
_CODECS: dict[str, object] = shared.kept("byte-codecs")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_pairs(token: bytes, rank: int, ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two parts that merge into a token last; where merges of lower rank leave more than two, any two tokens that make it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        least, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
        if least >= rank:
            return [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [(parts[0], parts[1])]


def tokenizer_text(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizer of the library, as JSON: the vocabulary and merges in characters, matches of the pattern apart."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every byte must be a token")
    letters = byte_characters()
    spell = lambda token: "".join(letters[b] for b in token)
    pairs = [p for t, r in sorted(ranks.items(), key=lambda x: x[1]) if len(t) > 1 for p in merge_pairs(t, r, ranks)]
    model = models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=[(spell(a), spell(b)) for a, b in pairs], ignore_merges=True)
    tok = Tokenizer(model)
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    tok.decoder = decoders.ByteLevel()
    return tok.to_str()


class ByteCodec(PieceEncoder):
    """Encoder of texts, and the byte table that turns ids back."""

    def __init__(self, text: str, blank_first: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.special = Tokenizer.from_str(text), []
        self.pieces, self.older = Pieces(), Pieces()
        back = {c: b for b, c in byte_characters().items()}
        vocab = self.tok.get_vocab()
        tokens = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            tokens[i] = bytes(back[c] for c in piece)
        self.known = np.zeros(len(tokens), bool)
        self.known[list(vocab.values())] = True
        self.width = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.width) - self.width
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        names = [b"%d " % i for i in range(len(tokens))]
        self.name_width = np.array([len(n) for n in names], np.int64)
        self.name_first = np.cumsum(self.name_width) - self.name_width
        self.name_table = np.frombuffer(b"".join(names), np.uint8)
        self.splits = blank_first

    def token_bytes(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of ids, a run of ids at a time."""
        for at in range(0, len(ids), RUN):
            own = ids[at : at + RUN]
            if own.min() < 0 or own.max() >= len(self.known) or not self.known[own].all():
                raise ValueError("an id is outside the vocabulary")
            yield gathered(self.table, self.first[own], self.width[own])

    def id_names(self, ids: np.ndarray) -> Iterator[bytes]:
        """The ids in decimal, joined by blanks, a run of ids at a time."""
        for at in range(0, len(ids), RUN):
            own = ids[at : at + RUN]
            text = gathered(self.name_table, self.name_first[own], self.name_width[own])
            yield text if at + RUN < len(ids) else text[:-1]


def gathered(table: np.ndarray, first: np.ndarray, size: np.ndarray) -> bytes:
    """The slices of a byte table that begin at `first`, one after the other."""
    at = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
    return table[at].tobytes()


def character_spans(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) that each token touches, from its end in bytes.

    A token that begins inside a character counts that character, as does one
    that ends inside it.
    """
    begins = np.concatenate([[0], ends[:-1]])
    upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters that begin before each byte
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = (data & 0xC0) == 0x80
    return upto[begins] - inside[begins], upto[ends]


def split_characters(data: bytes) -> tuple[bytes, str, bytes]:
    """Bytes that end a character begun before, whole characters, and bytes of one that goes on after."""
    at = 0
    while at < min(3, len(data)) and data[at] & 0xC0 == 0x80:
        at += 1
    stop = len(data)
    for back in range(1, min(4, len(data) - at) + 1):
        lead = data[-back]
        if lead & 0xC0 == 0x80:
            continue
        need = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 1
        stop = len(data) - back if need > back else stop
        break
    return data[:at], data[at:stop].decode("utf-8", "replace"), data[stop:]


class CharacterStream:
    """Text of token runs in order; bytes of an unfinished character wait for the next run."""

    def __init__(self, codec: ByteCodec):
        self.codec, self.rest = codec, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, final: bool = False) -> str:
        return "".join(self.rest.decode(b) for b in self.codec.token_bytes(ids)) + (self.rest.decode(b"", True) if final else "")


def _codec(key: str, text: str, blank_first: bool) -> ByteCodec:
    """One codec for each worker process and tokenizer."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = ByteCodec(text, blank_first)
    return _CODECS[key]


class Tokens:
    """A tokenizer made from a rank file, for use in tasks."""

    def __init__(self, vocab: str = "byte_bpe_50k.tiktoken", pattern: str = BLANK_FIRST):
        self.text = tokenizer_text(read_ranks(vocabulary(vocab)), pattern)
        self.blank_first = pattern == BLANK_FIRST
        self.key = hashlib.sha256(self.text.encode()).hexdigest()

    def codec(self) -> ByteCodec:
        return _codec(self.key, self.text, self.blank_first)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, tokens: Tokens | None = None, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id and ids (array of int); with `offsets` the end of each token in bytes, and the characters that it touches."""
    tokens = tokens or Tokens()

    def each(batches):
        codec = tokens.codec()
        for batch in batches:
            for s in shared.slices(batch, 1, 2 << 20):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in codec.encode(s.column(1))]
                lists = [ids]
                if offsets:
                    data, offs = tv.text_buffers(s.column(1))
                    ends = [np.cumsum(codec.width[x]) for x in ids]
                    spans = [character_spans(data[a:b], e) if len(e) else (e, e) for a, b, e in zip(offs[:-1], offs[1:], ends, strict=True)]
                    lists += [ends, [x for x, _ in spans], [x for _, x in spans]]
                yield pa.RecordBatch.from_arrays([s.column(0), *(_list_column(x) for x in lists)], names)

    names = ["doc_id", "ids", "byte_end", "char_start", "char_end"][: 5 if offsets else 2]
    return _texts(docs, id_col, text_col).mapInArrow(shared.task(each, "byte-codecs"), "doc_id long, " + ", ".join(f"{n} array<int>" for n in names[1:]))


def _list_column(rows: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows).astype(np.int32)))


def decode(rows: DataFrame, tokens: Tokens | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, data (the exact bytes), text, and head and tail: bytes of characters that the ids have only a part of."""
    tokens = tokens or Tokens()

    def each(batches):
        codec = tokens.codec()
        for b in batches:
            lists = b.column(1)
            if lists.values.null_count:
                raise ValueError("an id is null")
            offs, flat = np.asarray(lists.offsets, np.int64), lists.values.to_numpy(zero_copy_only=False)
            given, at = lists.is_valid().to_numpy(zero_copy_only=False), 0
            while at < b.num_rows:
                data, size, first = [], 0, at
                while at < b.num_rows and size < 4 << 20:
                    own = flat[offs[at] : offs[at + 1]] if given[at] else flat[:0]
                    data.append(b"".join(codec.token_bytes(own)))
                    size, at = size + len(data[-1]), at + 1
                cut = [split_characters(x) for x in data]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, at - first), pa.array(data, pa.binary()), pa.array([t for _, t, _ in cut], pa.string()), pa.array([h for h, _, _ in cut], pa.binary()), pa.array([t for _, _, t in cut], pa.binary())],
                    ["doc_id", "data", "text", "head", "tail"],
                )

    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return plain.mapInArrow(shared.task(each, "byte-codecs"), "doc_id long, data binary, text string, head binary, tail binary")


def round_trip(docs: DataFrame, tokens: Tokens | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of what they decode to: encoded and decoded where the text lies."""
    tokens = tokens or Tokens()

    def each(batches):
        codec = tokens.codec()
        for batch in batches:
            for s in shared.slices(batch, 1, 2 << 20):
                n, told, back = [], [], []
                for raw in codec.encode(s.column(1)):
                    ids = np.frombuffer(raw, "<u4")
                    named, data = hashlib.sha256(), hashlib.sha256()
                    for x in codec.id_names(ids):
                        named.update(x)
                    for x in codec.token_bytes(ids):
                        data.update(x)
                    n.append(len(ids))
                    told.append(named.hexdigest())
                    back.append(data.hexdigest())
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n, pa.int64()), pa.array(told, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(shared.task(each, "byte-codecs"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
