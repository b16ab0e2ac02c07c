"""Users' rules with very many hits: the same spans as a plain scan, at a cost that follows the hits."""

import random
import time

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tests.test_scan import plain_greedy
from veilframe.functions import rules
from veilframe.operators import marked
from veilframe.operators.scan import CustomRule, ScanConfig, scan, scan_array

OWN = (CustomRule("w", "word", "[a-zé]{3,}", "g", "low"), CustomRule("p", "pair", "[a-zé]{3,} [a-zé]{3,}", "g", "high"), CustomRule("n", "digits", "[0-9]*", "g", "critical"), CustomRule("x", "any", "[^a-z ]{2,4}", "g", "medium"), CustomRule("m", "marks", "[\u0001\u0002]", "g"))
EMAIL = next(i for i, r in enumerate(rules.RULES) if r.category == "email")


def plain(text, email):
    """Every rule's hits by Python's expressions, and the plain choice; the engine's mark counts as another such character."""
    found = [(EMAIL, *m.span(), "Email address", "medium", "email", 0.9) for m in regex.finditer(rules.RULES[EMAIL].pattern, text) if email]
    for k, r in enumerate(OWN):
        found += [(len(rules.RULES) + k, *m.span(), r.label, r.severity or "high", "custom", 0.8) for m in regex.finditer(r.pattern, text.replace("\ufdd0", "\ufdd2")) if m.group()]
    return [(h[5], h[3], h[4], h[1], h[2], text[h[1] : h[2]], h[6], h[4] != "low") for h in plain_greedy(found)]


@pytest.mark.parametrize("email", [False, True])
def test_users_rules_equal_a_plain_scan(spark, email):
    rng = random.Random(4)
    words = ["abc", "de", "some", "café", "12", "4567", "a@b.co", "x.y@mail.org", " ", " ", " ", "\n", "\u0001", "\u0002", "\ufdd0", "\ufdd1", "Ab-"]
    texts = ["", None, " ", "\ufdd0", "\ufdd0\ufdd0abc def", *("".join(rng.choice(words) for _ in range(rng.choice((3, 30, 400)))) for _ in range(80)), "abc " * 3000, ""]
    config = ScanConfig(enabled={c: c == "custom" or (email and c == "email") for c in rules.CATEGORIES}, custom_rules=OWN)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    got = {r.i: [tuple(s) for s in r.spans] for r in df.select("i", scan_array(F.col("text"), config).alias("spans")).collect()}
    assert got == {i: plain(t or "", email) for i, t in enumerate(texts)}


def test_slices_do_not_change_the_spans(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["a \ufdd0bc\ufdd0 d\ufdd0ef\ufdd0", None, "", "\ufdd0é😀\ufdd0\ufdd0x\ufdd0", "\ufdd0\ufdd0y", "no", "\ufdd0" + "q" * 50 + "\ufdd0"])
    none = pa.nulls(7, pa.string())
    run = marked.spans([(30, "L", "low", 0.8)], rules.SEVERITIES)
    whole = run(none, texts).to_pylist()
    assert [[(s["start"], s["end"], s["text"]) for s in own] for own in whole] == [[(2, 4, "bc"), (6, 8, "ef")], [], [], [(0, 2, "é😀"), (2, 3, "x")], [], [], [(0, 50, "q" * 50)]]
    for size in (1, 7, 20):
        monkeypatch.setattr(marked, "SLICE", size)
        assert run(none, texts).to_pylist() == whole
        assert run(none[3:], texts.slice(3, 4)).to_pylist() == whole[3:]
    assert run(none[:0], texts.slice(0, 0)).to_pylist() == []


@pytest.mark.parametrize("shape", ["chain", "apart", "same", "nested", "random", "falling"])
def test_greedy_equals_a_plain_one(shape):
    rng, n = random.Random(1), 20_000
    span = {"chain": lambda i: (7 * i, 7 * i + 9), "apart": lambda i: (9 * i, 9 * i + 9), "same": lambda i: (5, 5 + i % 9 + 1), "nested": lambda i: (i, 2 * n - i), "random": lambda i: (s := rng.randrange(10 * n), s + rng.randrange(1, 400)), "falling": lambda i: (7 * i, 7 * i + 9)}[shape]
    hs = sorted(((i, *span(i), "l", "low" if shape == "falling" else rng.choice(list(rules.SEVERITIES)), "custom", 0.8) for i in range(n)), key=lambda h: h[1])
    weak = np.array([-(rules.SEVERITIES[h[4]] * 1000000.0 + h[6] * 10000.0 + (h[2] - h[1])) for h in hs])
    ordinal, lo, hi = (np.array([h[k] for h in hs]) for k in range(3))
    kept = marked.greedy(lo, hi, np.lexsort((lo, ordinal, weak)))
    assert [hs[k] for k in np.flatnonzero(kept)] == plain_greedy(hs)


def test_a_hit_costs_the_same_in_long_texts(spark):
    """As many words in one text as in a hundred: cutting each span out of its text, and masks as long as the text, made the one text far slower."""
    rng = random.Random(2)
    words = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(600)) for _ in range(100)]
    config = ScanConfig(enabled={c: c == "custom" for c in rules.CATEGORIES}, custom_rules=OWN[:2])
    frames = [spark.createDataFrame([(t,) for t in texts], "text string").repartition(1).persist() for texts in (words, [" . ".join(words)])]
    assert [f.count() for f in frames] == [100, 1]

    def took(df):
        began = time.time()
        n = scan(df, id_cols=[], config=config).agg(F.sum(F.length("text"))).first()[0]
        return time.time() - began, n

    for f in frames:
        took(f)
    (short, n), (long, m) = (min(took(f) for _ in range(3)) for f in frames)
    for f in frames:
        f.unpersist()
    assert n == m
    assert long < 2 * short + 0.5
