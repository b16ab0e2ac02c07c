"""Byte-level BPE against the tiktoken library, on real rows, odd rows and generated texts."""

import functools
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, SF, odd_rows
from veilframe.llm import byte_bpe, encoding
from veilframe.llm.encoding import vocabulary

VOCABULARIES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]
TEXTS = ["", " ", "   ", "a", " a  b\n\n c\t\td ", "don't we'll  I'M", "naïve 😀 ﷺ 𠮷 é", "x" * 70_000, " " * 5000 + "y", "<|endoftext|>", "1234567890 ½ ٣", "\x00\x1f\x7f\x85\xa0　z", "日本語 テキスト", "\r\n \r\n"]


@functools.cache
def library(name):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(vocabulary(name)), special_tokens={})


@functools.cache
def codec_of(name):
    return byte_bpe.Tokens(name).codec()


@pytest.fixture(scope="module", params=VOCABULARIES)
def both(request):
    return codec_of(request.param), library(request.param)


def ids_of(codec, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]


def test_pattern_is_the_published_one():
    assert byte_bpe.BLANK_FIRST == public_tokenizers.PATTERN


def test_codec_equals_the_library(both):
    codec, lib = both
    own = TEXTS + [r[1] or "" for r in odd_rows()]
    assert ids_of(codec, own) == [lib.encode_ordinary(t) for t in own]
    codec.splits = False  # another pattern: texts are encoded whole
    assert ids_of(codec, own) == [lib.encode_ordinary(t) for t in own]
    codec.splits = True


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n'stlvemd09aé")), max_size=60))
def test_generated_texts(text):
    codec, lib = codec_of(VOCABULARIES[0]), library(VOCABULARIES[0])
    (ids,) = ids_of(codec, [text])
    assert ids == lib.encode_ordinary(text)
    assert b"".join(codec.token_bytes(np.array(ids, np.uint32))) == text.encode()


def test_both_libraries_class_characters_alike():
    """Splitting rests on letters, numbers and white space being the same in both."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([i]): i for i in range(256)}
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        want = set(bytes(tiktoken.Encoding("own", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode())
        rest = pre_tokenizers.Split(Regex(f"{kind}+"), "removed").pre_tokenize_str(every)
        assert set(every) - set("".join(t for t, _ in rest)) == want, kind


@pytest.mark.parametrize("which", ["odd", "real", "empty"])
def test_round_trip(spark, which):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if which == "real" else spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    docs = docs.limit(0) if which == "empty" else docs
    lib, want = library(VOCABULARIES[0]), []
    for r in docs.select("doc_id", "text").collect():
        ids = lib.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = byte_bpe.round_trip(docs)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_text_longer_than_a_slice(spark):
    rows = [(1, "wort für wort 😀 " * 300_000), (2, "short")]
    lib = library(VOCABULARIES[0])
    got = {r.doc_id: r for r in byte_bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        ids = lib.encode_ordinary(t)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_encode_with_offsets_and_decode(spark):
    rows = list(enumerate(TEXTS)) + [(None, "again 😀"), (None, "again 😀"), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    tokens, lib = byte_bpe.Tokens(), library(VOCABULARIES[0])
    enc = byte_bpe.encode(docs, tokens, offsets=True)
    found = enc.collect()
    assert len(found) == len(rows)
    for r in found:
        text = dict(rows).get(r.doc_id) or ""
        assert r.ids == lib.encode_ordinary(text)
        data, at = text.encode(), 0
        for i, end, a, b in zip(r.ids, r.byte_end, r.char_start, r.char_end, strict=True):
            assert data[at:end] == lib.decode_single_token_bytes(i)
            starts = [k for k in range(len(data[:end])) if data[k] & 0xC0 != 0x80]
            assert b == len(starts) and a == (sum(1 for k in starts if k <= at) - 1 if len(data) < 5000 else a)
            at = end
            if len(data) >= 5000:
                break
    back = byte_bpe.decode(enc.drop("char_start", "char_end", "byte_end"), tokens).collect()
    assert sorted((str(r.doc_id), bytes(r.data).decode(), r.text, bytes(r.head), bytes(r.tail)) for r in back) == sorted((str(i), t or "", t or "", b"", b"") for i, t in rows)


def test_split_characters_between_runs(spark):
    text = "aé😀日本" * 40 + "😀"
    tokens = byte_bpe.Tokens()
    codec = tokens.codec()
    ids = np.frombuffer(codec.encode([text])[0], "<u4")
    assert len(ids) > len(text)  # characters are split
    stream = byte_bpe.CharacterStream(codec)
    assert "".join(stream.feed(ids[i : i + 1], i + 1 == len(ids)) for i in range(len(ids))) == text
    runs = spark.createDataFrame([(i, ids[i : i + 3].tolist()) for i in range(0, len(ids), 3)] + [(10**6, None)], "doc_id long, ids array<int>")
    back = sorted(byte_bpe.decode(runs, tokens).collect())
    assert back[-1].text == "" and "�" not in "".join(r.text for r in back)
    assert b"".join(bytes(r.head) + r.text.encode() + bytes(r.tail) for r in back).decode() == text
    for a, b in zip(back[:-2], back[1:-1]):
        (bytes(a.tail) + bytes(b.head)).decode()


@pytest.mark.parametrize("ids", [[50256], [-1], [3, None]])
def test_ids_outside_the_vocabulary(spark, ids):
    with pytest.raises(Exception, match="an id is"):
        byte_bpe.decode(spark.createDataFrame([(1, ids)], "doc_id long, ids array<int>")).collect()


def test_no_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = byte_bpe.round_trip(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_a_token_made_of_parts_of_higher_rank():
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"ab": 257}
    assert byte_bpe.merge_pairs(b"abc", 256, ranks) == [(b"ab", b"c")]
    codec = byte_bpe.ByteCodec(byte_bpe.tokenizer_text(ranks, byte_bpe.BLANK_FIRST), True)
    lib = tiktoken.Encoding("own", pat_str=byte_bpe.BLANK_FIRST, mergeable_ranks=ranks, special_tokens={})
    for t in ("abc", "xabc", "abc ab abc", "ab abab"):
        assert ids_of(codec, [t]) == [lib.encode_ordinary(t)]
    with pytest.raises(ValueError, match="every byte"):
        byte_bpe.tokenizer_text({b"a": 0}, byte_bpe.BLANK_FIRST)


def test_forgetting_pieces_changes_nothing(monkeypatch):
    codec, lib = byte_bpe.Tokens().codec(), library(VOCABULARIES[0])
    monkeypatch.setattr(encoding, "KEPT_BYTES", 1 << 10)
    texts = [f"word{i} and w{i % 7} ü{i}" for i in range(500)]
    for at in range(0, 500, 50):
        assert ids_of(codec, texts[at : at + 50]) == [lib.encode_ordinary(t) for t in texts[at : at + 50]]
