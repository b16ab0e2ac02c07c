"""Reads are kept by content, models load once a process, turned images are read again."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilframe.operators import images, reads, regions
from veilframe.operators.scan import ScanConfig, scan


def page(n, turns=0, shade=255):
    """An upright page is wide, and bright at its top left."""
    a = np.full((4, 4 * n, 4), 10, np.uint8)
    a[:2, : 2 * n] = shade
    a[..., 3] = 255
    return np.ascontiguousarray(np.rot90(a, -turns))


def words_of(row):
    """Words of an upright page: as many as its sides' ratio; else one that isn't sure."""
    a = images.pixels(row).astype(float)[..., 0]
    h, w = a.shape
    corners = [a[: h // 2, : w // 2].mean(), a[: h // 2, w // 2 :].mean(), a[h // 2 :, w // 2 :].mean(), a[h // 2 :, : w // 2].mean()]
    upright = w > h and int(np.argmax(corners)) == 0
    n = round(w / h) if upright else 1
    return pd.DataFrame({"block": 0, "para": 0, "line": 0, "word": range(n), "text": ["mail a@b.co" if i == 0 and upright else "word" if upright else "x" for i in range(n)], "confidence": 90.0 if upright else 10.0, "x0": 0.0, "y0": 0.0, "x1": float(w), "y1": float(h)})


def counting(folder, failing=()):
    """A model that leaves a line for each load and call."""

    def load():
        with open(f"{folder}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")
        if os.path.exists(f"{folder}/broken"):
            os.remove(f"{folder}/broken")
            raise RuntimeError("no model")

        def run(row):
            with open(f"{folder}/calls", "a") as f:
                f.write(f"{row.image_id} {row.width} {row.height}\n")
            if row.image_id in failing:
                raise RuntimeError("unreadable")
            return words_of(row)

        return run

    return load


def lines(path):
    return open(path).read().split("\n")[:-1] if os.path.exists(path) else []


@pytest.fixture
def own(tmp_path):
    return str(tmp_path)


def frame(spark, pages):
    return spark.createDataFrame([(i, *(a.shape[1], a.shape[0], bytearray(a.tobytes()))) if a is not None else (i, None, None, None) for i, a in pages], images.RASTER)


def test_only_new_contents_are_read(spark, own):
    pages = [(1, page(9)), (2, page(9)), (3, page(3)), (4, None)]
    model, cache = counting(own), f"{own}/cache"
    got = {r.image_id: r.words for r in reads.read(frame(spark, pages), model, f"{own}-a", cache).collect()}
    assert {i: None if w is None else len(w) for i, w in got.items()} == {1: 9, 2: 9, 3: 3, 4: None}
    assert len(lines(f"{own}/calls")) == 2
    again = reads.read(frame(spark, [*pages, (5, page(4))]), model, f"{own}-a", cache)
    assert again.count() == 5 and len(lines(f"{own}/calls")) == 3
    reads.read(frame(spark, pages), model, f"{own}-b", cache).collect()  # another version reads for itself
    assert len(lines(f"{own}/calls")) == 5


def test_settings_change_calls_no_model(spark, own):
    df, model, cache = frame(spark, [(1, page(9)), (2, page(3, 1))]), counting(own), f"{own}/cache"

    def findings(config):
        rows = reads.word_rows(reads.read_upright(df, model, own, cache))
        text = regions.rebuild_text(rows)
        return sorted(tuple(r) for r in scan(text.select("image_id", "text"), config=config).select("image_id", "text").collect())

    assert findings(ScanConfig()) == [(1, "a@b.co"), (2, "a@b.co")]
    before = len(lines(f"{own}/calls"))
    assert findings(ScanConfig(enabled={"email": False})) == [] and findings(ScanConfig(min_confidence=0.95)) == []
    assert len(lines(f"{own}/calls")) == before


def test_failures_are_tried_again_and_empty_reads_kept(spark, own):
    cache, df = f"{own}/cache", frame(spark, [(1, page(9)), (2, page(3))])
    got = {r.image_id: r.words for r in reads.read(df, counting(own, failing=(2,)), own, cache).collect()}
    assert got[2] is None and len(got[1]) == 9
    images._HELD.clear()

    def none():
        return lambda row: words_of(row).iloc[:0]

    got = {r.image_id: r.words for r in reads.read(df, none, f"{own}-none", cache).collect()}
    assert got == {1: [], 2: []}
    assert reads.read(df, lambda: 1 / 0, f"{own}-none", cache).count() == 2  # nothing is left to read
    assert {r.image_id: r.words is None for r in reads.read(df, lambda: 1 / 0, f"{own}-broken", cache).collect()} == {1: True, 2: True}


def test_model_loads_once_a_process(spark, own):
    df = frame(spark, [(i, page(9, shade=100 + i)) for i in range(60)]).repartition(30)
    model = counting(own)
    kept = images.with_model(df, lambda: (lambda run: lambda row: run(row).assign(image_id=row.image_id)[["image_id", "text"]])(model()), "image_id long, text string", version=own)
    assert kept.count() == 60 * 9
    loads = lines(f"{own}/loads")
    assert len(loads) == len(set(loads)) < 30  # 30 tasks


def test_a_failed_load_is_tried_again(spark, own):
    open(f"{own}/broken", "w").close()
    model = counting(own)
    df = frame(spark, [(i, page(9, shade=100 + i)) for i in range(4)]).coalesce(1)
    found = images.with_model(df, lambda: (lambda run: lambda row: run(row).assign(image_id=row.image_id)[["image_id", "text"]])(model()), "image_id long, text string, error string", "error", own).collect()
    assert sum(r.error is not None for r in found) == 1 and len({r.image_id for r in found}) == 4
    assert len(lines(f"{own}/loads")) == 2


def test_turned_images_are_read_again_and_no_others(spark, own):
    pages = [(i, page(n, t, 100 + i)) for i, (n, t) in enumerate([(9, 0), (3, 0), (9, 1), (5, 2), (3, 3), (12, 0)])] + [(20, np.zeros((5, 5, 4), np.uint8)), (21, None)]
    df, cache = frame(spark, pages), f"{own}/cache"
    got = {r.image_id: r for r in reads.read_upright(df, counting(own), own, cache).collect()}
    calls = lines(f"{own}/calls")

    class Row:
        def __init__(self, a):
            self.width, self.height, self.rgba = a.shape[1], a.shape[0], a.tobytes()

    seen, expect, real = set(), {}, lambda ws: int(((ws.confidence >= 60) & ws.text.str.fullmatch("[^\\W\\d_]{4,}")).sum())

    def look(a):
        seen.add((a.shape, a.tobytes()))
        return words_of(Row(a))

    for i, a in pages:
        if a is None:
            continue
        first, scale = images.preprocessed(a)
        words, turns = look(first), 0
        if real(words) < 8:
            small = [real(look(images.oriented(a, t, images.SEARCH_SIDE))) for t in range(4)]
            turns = int(np.argmax(small)) if max(small) else 0
            if turns:
                full, scale = images.preprocessed(images.oriented(a, turns))
                words = look(full)
        expect[i] = (turns, scale, words.text.tolist())
    assert {i: (r.quarter_turns, r.scale, [w.text for w in r.words]) for i, r in got.items() if i != 21} == expect
    assert got[21].words is None and got[21].quarter_turns == 0
    assert len(calls) == len(seen)
    reads.read_upright(df, counting(own), own, cache).collect()
    assert lines(f"{own}/calls") == calls


def test_copies_are_prepared_and_turned_once(spark, own, monkeypatch):
    prepare = images.preprocessed

    def noted(a):
        with open(f"{own}/prepared", "a") as f:
            f.write("x\n")
        return prepare(a)

    monkeypatch.setattr(images, "preprocess", lambda df: df.select("image_id", "width", "height", "rgba").mapInPandas(lambda it: images._rows(it, lambda r: (lambda made: (made[0], (made[1],)))(noted(images.pixels(r))), ("scale",)), images.RASTER + ", scale double"))
    pages = [(i, page(9, i % 2)) for i in range(400)] + [(900, None)]
    got = {r.image_id: r for r in reads.read_upright(frame(spark, pages), counting(own), own, f"{own}/cache").collect()}
    assert len(got) == 401 and got[900].words is None and got[900].quarter_turns == 0
    assert all(got[i].quarter_turns == (4 - i % 2) % 4 and len(got[i].words) == 9 and got[i].scale == 2.0 for i in range(400))
    assert len(lines(f"{own}/prepared")) < 20
