"""Words, boxes, images, settings, state, reports, sources."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.functions import settings
from veilframe.operators import history, images, regions, report
from veilframe.operators.scan import CustomRule, ScanConfig, scan
from veilframe.sources import readers

BOX = "struct<x:double,y:double,w:double,h:double>"


@pytest.fixture(scope="module")
def tree(spark):
    word = lambda t, x, c=90.0: (t, c, (x, 10.0, x + 20.0, 20.0))
    blocks = [([([([word("Card", 0.0), word("4111", 30.0)],), ([word("1111", 0.0)],)],)],), ([([([word("last", 5.0)],)],)],)]
    return spark.createDataFrame([(1, 0, 2.0, blocks)], readers.OCR_TREE)


def test_rebuild_text_with_offsets_and_scale(tree):
    r = regions.rebuild_text(readers.ocr_words(tree)).first()
    assert r.text == "Card 4111\n1111\nlast\n"
    assert [(w.text, r.text[w.start : w.end]) for w in r.words] == [(t, t) for t in ("Card", "4111", "1111", "last")]
    assert tuple(r.words[1].box) == (15.0, 5.0, 10.0, 5.0)


def test_locate(spark):
    det = "struct<category:string,label:string,severity:string,start:int,end:int,text:string,confidence:double,redact_by_default:boolean>"
    d = lambda a, b, hide=True: ("email", "E", "medium", a, b, "t", 0.9, hide)
    words = [("a", 0, 4, (0.0, 0.0, 4.0, 1.0)), ("b", 5, 9, (5.0, 0.0, 4.0, 1.0)), ("c", 10, 14, (10.0, 0.0, 4.0, 1.0))]
    df = spark.createDataFrame([([d(0, 4), d(2, 12, False), d(4, 5)], words)], f"s array<{det}>, w array<struct<text:string,start:int,end:int,box:{BOX}>>")
    r = df.select(regions.locate(F.col("s"), F.col("w")).alias("r")).first().r
    assert [[b.x for b in x.boxes] for x in r] == [[0.0], [0.0, 5.0, 10.0], []] and [x.hidden for x in r] == [True, False, True]
    rects = df.select(regions.cover_rects(regions.locate(F.col("s"), F.col("w")), F.array(F.expr(f"cast((1, 1, 9, 9) as {BOX})"))).alias("c")).first().c
    assert [tuple(x) for x in rects] == [(-2.0, -2.0, 8.0, 5.0), (1.0, 1.0, 9.0, 9.0)]
    shown = df.select(history.toggle_all(regions.locate(F.col("s"), F.col("w"))).alias("r")).first().r
    assert all(x.hidden for x in shown)
    back = df.select(history.toggle_all(history.toggle_all(regions.locate(F.col("s"), F.col("w")))).alias("r")).first().r
    assert not any(x.hidden for x in back)
    one = df.select(history.toggle(regions.locate(F.col("s"), F.col("w")), F.lit(1)).alias("r")).first().r
    assert [x.hidden for x in one] == [True, True, True]
    board = df.select(report.dashboard(regions.locate(F.col("s"), F.col("w")), F.array(F.lit(1))).alias("d")).first().d
    assert tuple(board) == (3, 1, 4, "3 of 4 hidden")
    faces = spark.createDataFrame([(7, (1.0, 2.0, 3.0, 4.0), 0.9), (7, (1.0, 2.0, 3.0, 4.0), 0.4)], f"image_id long, box {BOX}, score double")
    got = regions.join_faces(df.select(F.lit(7).cast("long").alias("image_id"), regions.locate(F.col("s"), F.col("w")).alias("regions")), faces).first().regions
    off = regions.join_faces(df.select(F.lit(7).cast("long").alias("image_id"), regions.locate(F.col("s"), F.col("w")).alias("regions")), faces, settings=settings.DEFAULTS | {"faces": False})
    assert [x.detection.category for x in off.first().regions] == ["email"] * 3
    assert [x.detection.category for x in got] == ["email"] * 3 + ["face"] and got[3].hidden and got[3].detection.text == ""


def test_real_words(spark):
    rows = [("Word", 60.0, True), ("Word", 59.9, False), ("abc", 99.0, False), ("ab1d", 99.0, False), ("word.", 99.0, False), ("știre", 80.0, True)]
    df = spark.createDataFrame([(t, c) for t, c, _ in rows], "t string, c double")
    assert [r.ok for r in df.select(regions.real_word(F.col("t"), F.col("c")).alias("ok")).collect()] == [x for *_, x in rows]


def test_orientation(spark):
    scores = spark.createDataFrame([(1, 0, 3), (1, 1, 7), (1, 2, 7), (2, 0, 9)], "image_id long, quarter_turns int, score int")
    assert {r.image_id: r.quarter_turns for r in regions.best_orientation(scores).collect()} == {1: 1, 2: 0}
    assert [r.image_id for r in regions.needs_search(scores).collect()] == [1]


def test_drawn_boxes(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 50.0, 50.0, -10.0, 20.0), (2, 1.0, 1.0, 4.0, 90.0), (3, nan, 1.0, 50.0, 50.0)], "i int, ax double, ay double, bx double, by double").withColumns({"width": F.lit(100), "height": F.lit(100)})
    assert [(r.i, *r.box) for r in regions.drawn_boxes(df).collect()] == [(1, 0.0, 20.0, 50.0, 30.0)]


def test_images(spark):
    a = np.zeros((4, 6, 4), np.uint8)
    a[..., 3] = 255
    a[0, 0, :3] = 200
    df = spark.createDataFrame([(1, 6, 4, bytearray(a.tobytes()), 1)], "image_id long, width int, height int, rgba binary, quarter_turns int")
    r = images.orient(df).first()
    assert (r.width, r.height) == (4, 6) and images.pixels(r)[0, 3, 0] == 200
    assert np.array_equal(images.oriented(a, -3), images.oriented(a, 1))
    assert images.oriented(np.zeros((10, 5000, 4), np.uint8), 0).shape[:2] == (8, 4096)
    p = images.preprocess(df).first()
    assert (p.width, p.height, p.scale) == (12, 8, 2.0)
    painted = df.withColumn("rects", F.array(F.expr(f"cast((-1, 1, 3, 2) as {BOX})")))
    q = images.pixels(images.paint(painted).first())
    assert (q[1:3, :2, :3] == 10).all() and q[0, 0, 0] == 200
    assert images.gray_histogram(df).agg(F.sum("pixels")).first()[0] == 24
    cut = regions.percentile_cut(images.gray_histogram(df)).first()
    assert (cut.lo, cut.hi) == images.cut(images.histogram(images.luma(a)))

    def broken():
        def run(row):
            raise RuntimeError

        return run

    assert images.with_model(df, broken, "image_id long").count() == 0
    told = images.with_model(df, broken, "image_id long, x double, error string", "error").collect()
    assert sorted(r.image_id for r in told) == sorted(r.image_id for r in df.collect()) and all(r.x is None and r.error for r in told)


def test_history(spark):
    ev = [("a", 1, "add", (0.0, 0.0, 9.0, 9.0), None), ("a", 2, "add", (1.0, 0.0, 9.0, 9.0), None), ("a", 3, "undo", None, None), ("a", 4, "redo", None, None), ("a", 5, "delete", None, 0), ("a", 6, "undo", None, None), ("a", 7, "add", (2.0, 0.0, 9.0, 9.0), None), ("a", 8, "redo", None, None), ("b", 1, "undo", None, None)]
    df = spark.createDataFrame(ev, f"session_id string, seq int, action string, box {BOX}, index int")
    assert {r.session_id: [b.x for b in r.boxes] for r in history.manual_boxes(df).collect()} == {"a": [0.0, 1.0, 2.0], "b": []}
    v = spark.createDataFrame([(1, 1, "old"), (1, 2, None), (2, 5, "x")], "k int, version int, v string")
    assert {(r.k, r.v) for r in history.latest(v, ["k"]).collect()} == {(1, None), (2, "x")}


SAVED = [None, "", "{broken", "[1]", '{"enabled":{"email":false,"phone":"x"},"minConfidence":0.35}', '{"minConfidence":"0.5","faces":false}', '{"faces":"no","minConfidence":null}', '{"faces":"true","enabled":{"email":"false"},"minConfidence":1}', '{"enabled":[1],"minConfidence":0.15,"faces":false,"x":"\\"minConfidence\\":\\"9\\""}', '7', 'null', '{"minConfidence":true}']


def test_settings(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAVED)], "i int, s string").select("i", settings.merge(F.col("s")).alias("m"))
    for r in df.collect():
        want = settings.load(SAVED[r.i])
        assert (r.m.faces, r.m.min_confidence) == (want["faces"], want["min_confidence"]), SAVED[r.i]
        assert r.m.enabled["email"] == want["enabled"]["email"]
    assert settings.load(settings.save(settings.DEFAULTS)) == settings.DEFAULTS
    assert settings.to_config(settings.load(SAVED[4])) == ScanConfig(enabled=settings.load(SAVED[4])["enabled"], min_confidence=0.35)
    for enabled, floor in (({"nope": True}, 0.0), ({}, 0.96), ({}, 0.33), ({}, -0.05)):
        with pytest.raises(ValueError):
            settings.check({"enabled": enabled, "min_confidence": floor})
    settings.check(settings.DEFAULTS | {"min_confidence": 0.35})


def test_mask_and_findings(spark, tmp_path):
    df = spark.createDataFrame([("  abc ",), ("",), ("abcdef",), ("abcdefg",), ("a  b c d e",)], "s string")
    assert [r.m for r in df.select(report.mask(F.col("s")).alias("m")).collect()] == ["•••", "•", "••••••", "abc…fg", "a b… e"]
    spans = scan(spark.createDataFrame([(1, "a@b.co")], "i int, text string"))
    readers.write_findings(spans, f"{tmp_path}/f")
    assert "text" not in spark.read.parquet(f"{tmp_path}/f").columns
    assert tuple(spans.groupBy().agg(F.collect_list(F.struct("start")).alias("x")).select(report.text_dashboard(F.col("x")).alias("d")).first().d) == (0, 1, 1, "1 found")


def test_sources(spark, tmp_path):
    spark.createDataFrame([(1, " "), (2, "x"), (3, None), (4, "\n\t\r\n"), (5, "\u00a0\u2003"), (6, "")], "i int, text string").write.json(f"{tmp_path}/j")
    assert [r.i for r in readers.texts(spark, f"{tmp_path}/j", "json").collect()] == [2]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.PNG").write_bytes(b"1")
    (tmp_path / "p" / "b.txt").write_bytes(b"2")
    assert [r.path[-5:] for r in readers.image_files(spark, f"{tmp_path}/p").collect()] == ["a.PNG"]
    own = spark.createDataFrame([("a", "L", "x+", None, None)], "id string, label string, pattern string, flags string, severity string")
    assert readers.custom_rules(own) == (CustomRule("a", "L", "x+"),)
    assert json.loads(settings.save(settings.DEFAULTS))["faces"] is True


def test_orientation_flow(spark):
    kind = "image_id long, quarter_turns int, text string, confidence double"
    first = spark.createDataFrame([(1, 0, f"word{'abcdefgh'[i]}", 90.0) for i in range(8)] + [(2, 0, "xq", 90.0), (3, 0, "x", 1.0)], kind)
    searched = spark.createDataFrame([(2, t, "word", 90.0) for t in (1, 2, 2, 3, 3)] + [(3, t, "x", 1.0) for t in range(4)] + [(1, 3, "word", 90.0)], kind)
    assert {r.image_id: r.quarter_turns for r in regions.orientation_flow(first, searched).collect()} == {1: 0, 2: 2, 3: 0}


def plain_text(words):
    text, spots, last = "", [], None
    for w in sorted(words):
        before = "" if last is None else " " if last == w[:3] else "\n"
        text += before + w[4]
        spots.append((w[4], len(text) - len(w[4]), len(text)))
        last = w[:3]
    return text + "\n", spots


def test_text_of_a_very_long_page(spark):
    rng = random.Random(3)
    page = [(0, 0, i // 9, i % 9, rng.choice(["ă", "word", "", "x" * 30])) for i in range(100_000)]
    rng.shuffle(page)
    rows = [(1, *w, 0.0, 0.0, 1.0, 1.0, 1.0) for w in page] + [(2, 0, 0, 0, 0, "", 0.0, 0.0, 1.0, 1.0, 1.0), (2, 0, 0, 0, 1, "b", 0.0, 0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "image_id long, block int, para int, line int, word int, text string, x0 double, y0 double, x1 double, y1 double, scale double").repartition(3)
    for r in regions.rebuild_text(df).collect():
        assert (r.text, [(w.text, w.start, w.end) for w in r.words]) == plain_text([w[1:6] for w in rows if w[0] == r.image_id])


@pytest.mark.parametrize("small", [-1, 4096])
def test_locate_many_spans_and_words(spark, small, monkeypatch):
    monkeypatch.setattr(regions, "SMALL", small)
    rng = random.Random(5)
    det = "struct<start:int,end:int,redact_by_default:boolean>"
    texts = []
    for _ in range(60):
        at, words, spans = 0, [], []
        for _ in range(rng.randrange(12)):
            at += rng.randrange(3)
            words.append((at, at + rng.randrange(4), (float(len(words)), 0.0, 1.0, 1.0)))
            at = words[-1][1]
        for _ in range(rng.randrange(8)):
            s = rng.randrange(25)
            spans.append((s, s + rng.randrange(1, 9), bool(s % 2)))
        texts.append((spans, words))
    wide = ([(5 * i, 5 * i + 7, True) for i in range(20_000)], [(3 * i, 3 * i + 2, (float(i), 0.0, 1.0, 1.0)) for i in range(40_000)])
    df = spark.createDataFrame([(i, *t) for i, t in enumerate([*texts, wide])], f"i int, s array<{det}>, w array<struct<start:int,end:int,box:{BOX}>>")
    for r in df.select("i", "w", regions.locate(F.col("s"), F.col("w")).alias("r")).collect():
        if r.i < len(texts):
            spans, words = texts[r.i]
            assert [([b.x for b in x.boxes], x.hidden) for x in r.r] == [([w[2][0] for w in words if w[0] < e and s < w[1]], hide) for s, e, hide in spans]
        else:
            assert [[b.x for b in x.boxes] for x in r.r[:3]] == [[0, 1, 2], [2, 3], [3, 4, 5]] and len(r.r) == 20_000


@pytest.mark.parametrize("width", [1, 7, 256])
def test_locate_rows_is_the_plain_join(spark, width):
    rng = random.Random(width)
    spans = [(rng.randrange(4), s := rng.randrange(-5, 60), s + rng.randrange(0, 30), f"d{i % 9}" if i % 4 else None) for i in range(80)]
    spans += [spans[0], spans[0], (None, 3, 9, "n"), (9, 0, 5, "no words")]
    words = [(rng.randrange(4), s := rng.randrange(-5, 60), s + rng.randrange(0, 12), i) for i in range(60)] + [(None, 3, 9, 99)]
    got = regions.locate_rows(spark.createDataFrame(spans, "image_id int, start int, end int, name string"), spark.createDataFrame(words, "image_id int, start int, end int, box int"), width=width)
    assert got.columns == ["image_id", "start", "end", "name", "word_start", "box"]
    want = []
    for k, s, e, name in spans:
        own = [(k, s, e, name, a, i) for q, a, z, i in words if k is not None and q == k and a < e and s < z]
        want += own or [(k, s, e, name, None, None)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_locate_rows_joins_on_bins(spark):
    spans, words = spark.createDataFrame([(1, 0, 5, "a")], "image_id int, start int, end int, name string"), spark.createDataFrame([(1, 0, 5, 1)], "image_id int, start int, end int, box int")
    plan = regions.locate_rows(spans.hint("merge"), words)._jdf.queryExecution().optimizedPlan().toString()
    assert "(bin#" in plan and plan.count("bin#") > 4


def test_locate_rows_deals_its_pairs(spark):
    spans = spark.range(600).selectExpr("id % 3 image_id", "cast(id % 97 as int) start", "cast(id % 97 + 5 as int) end", "id name").coalesce(1)
    words = spark.range(900).selectExpr("id % 2 image_id", "cast(id % 97 as int) start", "cast(id % 97 + 3 as int) end", "id box").coalesce(1)
    own = regions.locate_rows(spans, words).groupBy(F.spark_partition_id()).count().collect()
    assert len(own) == 4 and max(r["count"] for r in own) < sum(r["count"] for r in own) / 2
    joins = regions.locate_rows(spans.hint("merge"), words)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in joins  # spans aren't numbered, and pairs don't go back to them


def test_a_long_session_is_replayed_in_time(spark):
    rng, log, plain, past, future = random.Random(8), [], [], [], []
    for i in range(10_000):
        action = rng.choice(["add", "add", "delete", "undo", "redo"])
        at = rng.randrange(-1, 30)
        log.append(("s", i, action, (float(i), 0.0, 1.0, 1.0) if action == "add" else None, at if action == "delete" else None))
        if action == "add" or action == "delete" and 0 <= at < len(plain):
            past.append(plain)
            plain, future = [*plain, float(i)] if action == "add" else [*plain[:at], *plain[at + 1 :]], []
        elif action == "undo" and past:
            future.append(plain)
            plain = past.pop()
        elif action == "redo" and future:
            past.append(plain)
            plain = future.pop()
    df = spark.createDataFrame(log, f"session_id string, seq int, action string, box {BOX}, index int").repartition(3)
    began = time.time()
    assert [b.x for b in history.manual_boxes(df).first().boxes] == plain
    assert time.time() - began < 10
