"""Texts larger than the block or slice that an operator cuts its input into, beside short ones and none."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from veilframe.llm import byte_bpe, decontaminate, jaccard_join, lm_scoring, packing, quality, shared, sst_output, substring_dedup, token_counts, warc

PASSAGE = " ".join(f"leak{i}" for i in range(30))


def words(seed, n):
    return np.char.add("w", np.random.default_rng(seed).integers(0, 10**7, n).astype(str)).tolist()


@pytest.fixture(scope="module")
def texts():
    """1: over two blocks, 2 and 3: short and none, 4: 1 but for some words, 5: a copy of 1."""
    long = words(1, 1_100_000)
    near = [*long]
    near[::40_000] = ["other"] * len(near[::40_000])
    near += PASSAGE.split()
    whole = " ".join(long)
    assert len(whole) > 2 * shared.BLOCK_BYTES
    return {1: whole, 2: "a short text of seven words only", 3: None, 4: " ".join(near), 5: whole}


@pytest.fixture(scope="module")
def docs(spark, texts):
    # a file for each row, so that rows aren't shipped within task descriptions
    return shared.staged(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2), "long-texts")


def by_id(df):
    rows = {r.doc_id: r for r in df.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5]
    return rows


def test_jaccard_join(docs, texts):
    got = by_id(jaccard_join.join(docs))
    assert {d: r.component_id for d, r in got.items()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 1}
    for d in (1, 2, 4):
        w = texts[d].split()
        assert got[d].n_shingles == len(set(zip(*(w[k:] for k in range(5)), strict=False)))


def test_substring_dedup(docs, texts):
    got = by_id(substring_dedup.measured(docs))
    assert [got[d].n_bytes for d in (1, 2, 3)] == [len(texts[1]), len(texts[2]), 0]
    assert [got[d].n_removed for d in (1, 2, 3)] == [0, 0, 0]
    assert (got[5].n_removed, got[5].n_spans, got[5].kept_sha256) == (len(texts[5]), 1, hashlib.sha256(b"").hexdigest())
    # of 4 the changed words and the passage at its end stay; a run is removed between two of them
    kept = re.findall("other", texts[4])
    assert got[4].n_spans == len(kept)
    assert got[4].n_bytes - got[4].n_removed < len(PASSAGE) + 16 * len(kept)


def test_decontaminate(spark, docs):
    got = by_id(decontaminate.report(docs, spark.createDataFrame([(9, PASSAGE)], "item_id long, text string")))
    assert {d: (r.contaminated, r.item_id) for d, r in got.items()} == {d: (d == 4, 9 if d == 4 else None) for d in got}


def test_token_counts(docs, texts):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = by_id(token_counts.count_tokens(docs))
    for d in (1, 2, 3):
        n = len(model.encode(texts[d] or ""))
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len(texts[d] or ""), n, n > 4096)
    assert got[5].n_tokens == got[1].n_tokens


@pytest.fixture(scope="module")
def ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return {d: t.encode(texts[d] or "", add_special_tokens=False).ids for d in (1, 2, 3)}


def test_token_tables(docs, ids):
    got = by_id(sst_output.round_trip(docs))
    for d, own in ids.items():
        assert (got[d].n_tokens, got[d].ids_crc32) == (len(own) + 1, zlib.crc32(np.array([*own, 0], "<u4").tobytes()))
    assert got[5].ids_crc32 == got[1].ids_crc32
    assert got[5].start == sum(got[d].n_tokens for d in (1, 2, 3, 4))


def test_packing(docs, ids):
    pieces = packing.pack(docs).collect()
    for d, own in ids.items():
        whole = np.array([*own, 2], "<u4")
        mine = sorted((r for r in pieces if r.doc_id == d), key=lambda r: r.piece)
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1].tolist()]
        assert sum(r.length for r in mine) == len(whole)
        assert all(r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes()) for r in mine)
    total = Counter()
    for r in pieces:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 1024
    assert len(total) >= math.ceil(sum(total.values()) / 1024)


def test_byte_bpe(docs, texts):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    t = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.round_trip(docs))
    for d in (1, 2, 3):
        own = t.encode_ordinary(texts[d] or "")
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256((texts[d] or "").encode()).hexdigest()


def test_quality(spark, docs):
    labels = spark.createDataFrame([(2, 0), (4, 1), (3, 0)], "doc_id long, quality int")
    got = by_id(quality.classify(docs, labels))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[1].score == got[5].score


def test_warc(docs, texts):
    pages = docs.selectExpr("doc_id as page_id", "concat('http://a.example/', doc_id) as url", "text as html")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {p: (r.record_type, r.refers_to) for p, r in got.items()} == {p: ("revisit", 1) if p == 5 else ("response", None) for p in texts}
    for p, r in got.items():
        payload = (texts[p] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())


def test_lm_scoring(spark):
    """Texts larger than a 16 MB slice: one that teaches and one, not taught, that is scored."""
    taught, held = ([d for d in range(40) if (zlib.crc32(str(d).encode()) % 5 == 1) is out][0] for out in (False, True))
    texts = {taught: " ".join(words(2, 400_000) * 5), held: " ".join(words(3, 200_000) * 10)}
    assert min(map(len, texts.values())) > 16 << 20
    docs = shared.staged(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2), "long-texts")
    got = {r.doc_id: r for r in lm_scoring.score_held_out(docs).collect()}
    c = Counter(texts[taught].split()) + Counter({"</end>": 1})
    n, v = c.total(), len(c)
    own = Counter(texts[held].split()) + Counter({"</end>": 1})
    base = sum(k * math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w, k in own.items())
    r = got[held]
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, own.total(), sum(k for w, k in own.items() if w in c), n)
    assert r.base_score == pytest.approx(base, rel=1e-9)
    assert r.score < 0 and got[taught].score > got[taught].base_score
