"""From OCR words to text, from spans to boxes, from boxes to cover rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound, counts_before

#: What counts as a real word, and when a page is clearly upright.
REAL_WORD_CONFIDENCE, REAL_WORD_LETTERS, UPRIGHT_WORDS = 60.0, 4, 8
#: Padding of a cover rectangle, in pixels and as a share of its height.
PAD_PIXELS, PAD_SHARE = 2.0, 0.15
#: Pairs of spans and words of a text that are compared one by one.
SMALL = 4096
#: Fixed value: the smallest side of a hand-drawn box.
DRAWN_SIDE = 6.0


def real_word(text: Column, confidence: Column) -> Column:
    return (confidence >= REAL_WORD_CONFIDENCE) & text.rlike(rf"^\p{{L}}{{{REAL_WORD_LETTERS},}}$")


def rebuild_text(words: DataFrame, keys: tuple[str, ...] = ("image_id",), lines: tuple[str, ...] = ("block", "para", "line"), word: str = "word") -> DataFrame:
    """Text of each image with the offsets of its words.

    One blank goes before a word unless the text is empty or ends in a line
    break; a line break ends every line.  Boxes are scaled back to the image.
    Returns the keys, text, and words (text, start, end, box) in order.
    """
    box = F.struct((F.col("x0") / F.col("scale")).alias("x"), (F.col("y0") / F.col("scale")).alias("y"), ((F.col("x1") - F.col("x0")) / F.col("scale")).alias("w"), ((F.col("y1") - F.col("y0")) / F.col("scale")).alias("h"))
    rows = words.select(*keys, F.struct(*[F.col(c) for c in lines]).alias("line"), F.col(word).alias("nth"), F.col("text").alias("own"), box.alias("box"))
    # where a word begins is a running sum, so neither the text nor the list of words grows word by word
    order = Window.partitionBy(*keys).orderBy("line", "nth", "own", "box")
    last = F.lag("line").over(order)
    rows = rows.withColumn("before", F.when(F.row_number().over(order) == 1, "").when(last != F.col("line"), "\n").otherwise(" "))
    end = F.sum(F.length("before") + F.length("own")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = rows.withColumn("end", end)
    spot = F.struct("line", "nth", "own", "box", "end", "before")
    whole = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(spot)).alias("ws"))
    text = F.concat(F.array_join(F.transform("ws", lambda w: F.concat(w["before"], w["own"])), ""), F.lit("\n"))
    found = F.transform("ws", lambda w: F.struct(w["own"].alias("text"), (w["end"] - F.length(w["own"])).alias("start"), w["end"].alias("end"), w["box"].alias("box")))
    return whole.select(*keys, text.alias("text"), found.alias("words"))


def locate(spans: Column, words: Column) -> Column:
    """Regions: each span with the boxes of all words it touches (perhaps none), hidden where it is redacted by default.

    Words stand in the order of the text and don't overlap, as `rebuild_text` has
    them: so those that a span touches are a slice, found by counting.  Up to SMALL
    pairs of a span and a word are compared instead.
    """

    def cut(both):
        first = counts_before(F.transform(both["words"], lambda w: w["end"]), F.transform(both["spans"], lambda d: d["start"]), touching=True)
        stop = counts_before(F.transform(both["words"], lambda w: w["start"]), F.transform(both["spans"], lambda d: d["end"]))
        return bound(F.struct(first.alias("first"), stop.alias("stop")), lambda at: F.transform(both["spans"], lambda d, k: region(both["words"], d, at["first"][k], at["stop"][k])))

    def region(words, d, first, stop):
        return shown(d, F.slice(words, first + 1, F.greatest(stop - first, F.lit(0))))

    def compared(both):
        return F.transform(both["spans"], lambda d: shown(d, F.filter(both["words"], lambda w: (w["start"] < d["end"]) & (d["start"] < w["end"]))))

    def shown(d, touched):
        return F.struct(d.alias("detection"), F.transform(touched, lambda w: w["box"]).alias("boxes"), d["redact_by_default"].alias("hidden"))

    few = lambda both: F.size(both["spans"]).cast("long") * F.size(both["words"]) <= SMALL
    return bound(F.struct(spans.alias("spans"), words.alias("words")), lambda both: F.when(few(both), compared(both)).otherwise(cut(both)))


def locate_rows(spans: DataFrame, words: DataFrame, key: str = "image_id", width: int = 256) -> DataFrame:
    """The same as a left join of tables: equal keys and overlapping offsets; every span stays.

    Only different intervals of an image are compared: they fall into bins of
    `width`, and the bin is a second join key, so an interval meets those of its
    own stretch of the text only.  A pair that shares several bins counts in the
    first of them.  Spans then find the intervals that theirs meets, and each of
    these its words, by equality: every row that these joins make is a row of the
    result, and a page of any length is split over tasks.
    """
    bins = lambda: F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / width)))
    intervals = lambda df: df.select(F.col(key).alias("k"), "start", "end").distinct().withColumn("bin", bins())
    d, w = intervals(spans).alias("d"), intervals(words).alias("w")
    first = F.floor(F.greatest("d.start", "w.start") / width)
    on = (F.col("d.k") == F.col("w.k")) & (F.col("d.bin") == F.col("w.bin")) & (F.col("w.start") < F.col("d.end")) & (F.col("d.start") < F.col("w.end")) & (F.col("d.bin") == first)
    pairs = d.join(w, on).select("d.k", "d.start", "d.end", F.col("w.start").alias("from"), F.col("w.end").alias("to")).alias("p")
    n, own = spans.alias("n"), words.select(F.col(key).alias("k"), "start", "end", "box").alias("o")
    met = n.join(pairs, (F.col(f"n.{key}") == F.col("p.k")) & (F.col("n.start") == F.col("p.start")) & (F.col("n.end") == F.col("p.end")), "left")
    # dealt by number, as few rows may meet many; spans that meet nothing have no k, and are dealt by their own offsets
    met = met.select(F.struct("n.*").alias("n"), F.col("p.k").alias("k"), F.coalesce("from", "n.start").alias("from"), F.coalesce("to", "n.end").alias("to"))
    met = met.repartition(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "from", "to").alias("m")
    found = met.join(own, (F.col("m.k") == F.col("o.k")) & (F.col("m.from") == F.col("o.start")) & (F.col("m.to") == F.col("o.end")), "left")
    return found.select("m.n.*", F.col("o.start").alias("word_start"), "box")


def face_regions(faces: DataFrame, key: str = "image_id") -> DataFrame:
    """Faces as regions: critical, hidden, without text, whatever the switches and the floor say."""
    detection = F.struct(
        F.lit("face").alias("category"), F.lit("Face").alias("label"), F.lit("critical").alias("severity"), F.lit(0).alias("start"), F.lit(0).alias("end"),
        F.lit("").alias("text"), F.col("score").cast("double").alias("confidence"), F.lit(True).alias("redact_by_default"),
    )
    region = F.struct(detection.alias("detection"), F.array("box").alias("boxes"), F.lit(True).alias("hidden"))
    return faces.where(F.col("score") >= 0.5).groupBy(key).agg(F.array_sort(F.collect_list(region), lambda a, b: F.when(a["detection"]["confidence"] > b["detection"]["confidence"], -1).when(a["detection"]["confidence"] < b["detection"]["confidence"], 1).otherwise(0)).alias("faces"))


def join_faces(regions: DataFrame, faces: DataFrame | None, key: str = "image_id", column: str = "regions", settings: dict | None = None) -> DataFrame:
    """Text regions first, then faces; nothing is merged.  Where the settings have faces off, or there are none, only text regions."""
    if faces is None or settings is not None and not settings["faces"]:
        return regions
    both = regions.join(face_regions(faces, key), key, "left")
    return both.withColumn(column, F.concat(F.col(column), F.coalesce(F.col("faces"), F.filter(F.col(column), lambda r: F.lit(False))))).drop("faces")


def drawn_boxes(drags: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Rectangles from the two ends of a drag, clamped to the image; too small ones (and NaN) are ignored."""
    clamp = lambda c, top: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(top).cast("double"))
    x0, x1, y0, y1 = clamp("ax", width), clamp("bx", width), clamp("ay", height), clamp("by", height)
    box = F.struct(F.least(x0, x1).alias("x"), F.least(y0, y1).alias("y"), F.abs(x1 - x0).alias("w"), F.abs(y1 - y0).alias("h"))
    rest = [c for c in drags.columns if c not in ("ax", "ay", "bx", "by", width, height)]
    known = F.greatest("ax", "ay", "bx", "by") < float("inf")  # NaN counts as the largest
    return drags.where(known).select(*rest, box.alias("box")).where((F.col("box.w") >= DRAWN_SIDE) & (F.col("box.h") >= DRAWN_SIDE))


def cover_rects(regions: Column, manual: Column | None = None) -> Column:
    """What to paint: padded boxes of hidden regions, then hand-drawn boxes as they are."""

    def padded(b):
        pad = F.greatest(F.lit(PAD_PIXELS), b["h"] * PAD_SHARE)
        return F.struct((b["x"] - pad).alias("x"), (b["y"] - pad).alias("y"), (b["w"] + 2 * pad).alias("w"), (b["h"] + 2 * pad).alias("h"))

    own = F.flatten(F.transform(F.filter(regions, lambda r: r["hidden"]), lambda r: F.transform(r["boxes"], padded)))
    return own if manual is None else F.concat(own, F.coalesce(manual, F.filter(own, lambda b: F.lit(False))))


def orientation_scores(words: DataFrame) -> DataFrame:
    """Real words of each image and quarter turn."""
    return words.groupBy("image_id", "quarter_turns").agg(F.count_if(real_word(F.col("text"), F.col("confidence"))).alias("score"))


def best_orientation(scores: DataFrame) -> DataFrame:
    """The turn of the highest score; of equals, the smallest turn."""
    return scores.groupBy("image_id").agg(F.max_by("quarter_turns", F.struct(F.col("score"), -F.col("quarter_turns"))).alias("quarter_turns"), F.max("score").alias("score"))


def needs_search(scores: DataFrame) -> DataFrame:
    """Images whose first read isn't clearly upright."""
    return scores.where((F.col("quarter_turns") == 0) & (F.col("score") < UPRIGHT_WORDS)).select("image_id")


def percentile_cut(histogram: DataFrame, share: float = 0.02, key: str = "image_id") -> DataFrame:
    """Lowest and highest gray bin once `share` of the pixels is cut off at each end."""
    up = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    run = histogram.withColumn("below", F.sum("pixels").over(up)).withColumn("above", F.sum("pixels").over(down)).withColumn("all", F.sum("pixels").over(Window.partitionBy(key)))
    return run.groupBy(key).agg(F.min(F.when(F.col("below") >= share * F.col("all"), F.col("bin"))).alias("lo"), F.max(F.when(F.col("above") >= share * F.col("all"), F.col("bin"))).alias("hi"))


def orientation_flow(first_reads: DataFrame, searched: DataFrame) -> DataFrame:
    """The turn of each image: 0 where the first read is clearly upright, else the best of the searched turns.

    `first_reads` are words at turn 0, `searched` words of all four turns (only
    of images that `needs_search` names; others are ignored).  Images without a
    single real word in either stay at 0.
    """
    first = orientation_scores(first_reads)
    turned = searched.join(needs_search(first), "image_id", "left_semi")
    best = best_orientation(orientation_scores(turned)).select("image_id", F.when(F.col("score") > 0, F.col("quarter_turns")).otherwise(0).alias("turns"))
    return first.where(F.col("quarter_turns") == 0).select("image_id").distinct().join(best, "image_id", "left").select("image_id", F.coalesce("turns", F.lit(0)).alias("quarter_turns"))
