"""Registered queries of the scan engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, settings, validators
from ..operators import history, regions, report
from ..operators.scan import CustomRule, ScanConfig, scan, scan_array
from . import keyed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def registered(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def only(*categories: str) -> ScanConfig:
    return ScanConfig(enabled={c: c in categories for c in rules.CATEGORIES})


# planted spans, one query a detector

def _keyed(name: str, case: keyed.Case):
    def query(spark, sf_dir):
        texts = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(case.text).alias("text"))
        return scan(texts, config=only(case.category))

    QUERIES[f"scan_{name}"] = query
    ORACLE_SQL[f"scan_{name}"] = keyed.oracle(case)


for _name, _case in keyed.CASES.items():
    _keyed(_name, _case)

# scans of the documents

EMAIL = r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,10}[A-Za-z]{2,24}"
# A word boundary instead of the rule's right boundary, so that a card right after another's one blank is found too; they differ at "_" and "<" only
CARD = r"(?:^|[^0-9A-Za-z<])([0-9](?:[ -]?[0-9]){13,18})\b"
LUHN = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN (len({0}) - i) % 2 = 1 THEN CASE WHEN 2 * CAST({0}[i] AS INT) > 9 THEN 2 * CAST({0}[i] AS INT) - 9 ELSE 2 * CAST({0}[i] AS INT) END ELSE CAST({0}[i] AS INT) END)) % 10 = 0"


@registered()
def scan_documents(spark, sf_dir):
    return report.findings(scan(table(spark, sf_dir, "documents"), id_cols=["doc_id"]))


@registered()
def scan_pages(spark, sf_dir):
    return report.findings(scan(table(spark, sf_dir, "pages"), "html", ["page_id"]))


@registered(f"SELECT doc_id, hit AS text FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS hit FROM documents)")
def email_hits(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), id_cols=["doc_id"], config=only("email")).select("doc_id", "text")


@registered(f"SELECT page_id, hit AS text FROM (SELECT page_id, unnest(regexp_extract_all(html, '{EMAIL}')) AS hit FROM pages)")
def email_hits_in_pages(spark, sf_dir):
    return scan(table(spark, sf_dir, "pages"), "html", ["page_id"], only("email")).select("page_id", "text")


_CARDS = f"SELECT doc_id, hit, regexp_replace(hit, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{CARD}', 1)) AS hit FROM documents)"
_BRAND = "CASE WHEN regexp_full_match(d, '4[0-9]{12,18}') THEN 'Visa' WHEN regexp_full_match(d, '5[1-5][0-9]{14}|(222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12}') THEN 'Mastercard' WHEN regexp_full_match(d, '3[47][0-9]{13}') THEN 'American Express' WHEN regexp_full_match(d, '6011[0-9]{12}|65[0-9]{14}|64[4-9][0-9]{13}') THEN 'Discover' ELSE 'Payment card' END"


# Detectors but these three find nothing in the generated documents; a hit of another would show as a difference
_CONTROL = " + ".join(f"{w} * CAST(hit[{i + 1}] AS INT)" for i, w in enumerate((2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9)))
_FOUND = (
    f"WITH mails AS (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) FROM documents), "
    f"cards AS (SELECT doc_id, hit, d FROM ({_CARDS}) WHERE len(d) BETWEEN 14 AND 19 AND {LUHN.format('d')}), "
    f"numbers AS (SELECT doc_id, hit, ({_CONTROL}) % 11 AS c FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[1-9][0-9]{{12}}')) AS hit FROM documents)), "
    "own AS (SELECT doc_id, hit FROM numbers n WHERE CAST(hit[13] AS INT) = CASE WHEN c = 10 THEN 1 ELSE c END AND NOT EXISTS (SELECT 1 FROM cards k WHERE k.doc_id = n.doc_id AND contains(k.hit, n.hit))), "
    "found AS (SELECT doc_id, 'email' AS category, 'medium' AS severity FROM mails UNION ALL SELECT doc_id, 'credit_card', 'critical' FROM cards UNION ALL SELECT doc_id, 'national_id', 'high' FROM own) "
)


@registered(_FOUND + "SELECT category, severity, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM found GROUP BY 1, 2")
def category_counts(spark, sf_dir):
    """The flagship: all rules over all documents."""
    return scan(table(spark, sf_dir, "documents"), id_cols=["doc_id"]).groupBy("category", "severity").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("documents"))


@registered(f"SELECT doc_id, hit AS text, {_BRAND} AS label FROM ({_CARDS}) WHERE len(d) BETWEEN 14 AND 19 AND {LUHN.format('d')}")
def card_hits(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), id_cols=["doc_id"], config=only("credit_card")).select("doc_id", "text", "label")


@registered(f"SELECT {_BRAND} AS label, count(*) AS hits FROM ({_CARDS}) WHERE len(d) BETWEEN 14 AND 19 AND {LUHN.format('d')} GROUP BY 1")
def card_brand_counts(spark, sf_dir):
    return card_hits(spark, sf_dir).groupBy("label").agg(F.count("*").alias("hits"))


@registered("SELECT doc_id, count(*) AS hits, min(hit) AS first_hit FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}([.][0-9]{1,3}){3}')) AS hit FROM documents) GROUP BY doc_id")
def custom_rule_hits(spark, sf_dir):
    """A user's rule (here IPv4-shaped), all built-in ones off."""
    own = CustomRule("ip", "Address", r"[0-9]{1,3}([.][0-9]{1,3}){3}", "g")
    config = ScanConfig(enabled=dict.fromkeys((c for c in rules.CATEGORIES if c != "custom"), False), custom_rules=(own, CustomRule("bad", "Broken", "([", "g")))
    return scan(table(spark, sf_dir, "documents"), id_cols=["doc_id"], config=config).groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("text").alias("first_hit"))


@registered("SELECT lang, source, count(DISTINCT doc_id) AS documents, count(*) AS hits FROM (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '" + EMAIL + "')) FROM documents) GROUP BY lang, source")
def email_hits_by_source(spark, sf_dir):
    spans = scan(table(spark, sf_dir, "documents"), id_cols=["doc_id", "lang", "source"], config=only("email"))
    return spans.groupBy("lang", "source").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("hits"))


# switches, floor, overlap

_MIXED = f"('mail u' || {keyed.K} || '@example.org code CVV ' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || ' card ' || {keyed.SPACED_CARD} || ' Nume: ' || {keyed.LETTERS})"


def _mixed(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_MIXED).alias("text"))


def _counts(spans):
    return spans.groupBy("o_orderkey").agg(F.array_join(F.array_sort(F.collect_list("category")), ",").alias("found"))


@registered("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'credit_card,email' ELSE 'email' END AS found FROM orders")
def confidence_floor(spark, sf_dir):
    return _counts(scan(_mixed(spark, sf_dir), config=ScanConfig(min_confidence=0.9)))


@registered("SELECT o_orderkey, 'cvv,name' AS found FROM orders")
def category_switch(spark, sf_dir):
    return _counts(scan(_mixed(spark, sf_dir), config=ScanConfig(enabled={"email": False, "credit_card": False})))


@registered("SELECT CAST(count(*) AS BIGINT) AS orders, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS critical, CAST(2 * count(*) AS BIGINT) AS high, CAST(count(*) AS BIGINT) AS other FROM orders")
def severity_rollup(spark, sf_dir):
    counts = report.severity_rollup(scan(_mixed(spark, sf_dir)), ["o_orderkey"])
    return counts.agg(F.count("*").alias("orders"), F.sum("critical").alias("critical"), F.sum("high").alias("high"), F.sum("other").alias("other"))


@registered(f"SELECT o_orderkey, 'mrz' AS category, CAST(5 AS INT) AS \"start\", CAST(5 + 5 + length({keyed.CARD}) + 2 + 6 + 4 AS INT) AS \"end\" FROM orders")
def overlap_resolve(spark, sf_dir):
    """A card number inside a machine-readable zone: one span, the zone."""
    text = f"('zone IDROU' || {keyed.CARD} || '<<' || {keyed.LETTERS} || '<<<< end')"
    return scan(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(text).alias("text"))).select("o_orderkey", "category", "start", "end")


# validators over constructed numbers

@registered(f"SELECT o_orderkey, {keyed.CARD} AS number, o_orderkey % 2 = 0 AS valid FROM orders")
def luhn_on_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(keyed.CARD).alias("number")).withColumn("valid", validators.luhn(F.col("number")))


@registered(f"SELECT o_orderkey, {keyed.IBAN} AS number, o_orderkey % 2 = 0 AS valid FROM orders")
def iban_on_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(keyed.IBAN).alias("number")).withColumn("valid", validators.iban(F.col("number")))


@registered(f"SELECT o_orderkey, {keyed.CNP} AS number, o_orderkey % 2 = 0 AS valid FROM orders")
def cnp_on_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(keyed.CNP).alias("number")).withColumn("valid", validators.cnp(F.col("number")))


@registered(f"SELECT o_orderkey, 'RO' || {keyed.CUI} AS number, o_orderkey % 2 = 0 AS valid FROM orders")
def cui_on_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(f"'RO' || {keyed.CUI}").alias("number")).withColumn("valid", validators.cui(F.col("number")))


_STRUCT = "(CAST(1 + o_orderkey % 9 AS STRING) || '85' || lpad(CAST(o_orderkey % 15 AS STRING), 2, '0') || lpad(CAST(o_orderkey % 34 AS STRING), 2, '0') || lpad(CAST(o_orderkey % 56 AS STRING), 2, '0') || '1234')"


@registered(f"SELECT o_orderkey, {_STRUCT} AS number, o_orderkey % 9 < 8 AND o_orderkey % 15 BETWEEN 1 AND 12 AND o_orderkey % 34 BETWEEN 1 AND 31 AND o_orderkey % 56 BETWEEN 1 AND 52 AS valid FROM orders")
def cnp_structure_on_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_STRUCT).alias("number")).withColumn("valid", validators.cnp_structure(F.col("number")))


@registered("SELECT DISTINCT regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, c_custkey FROM customer")
def digits_only(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(validators.digits_only(F.col("c_name")).alias("digits"), "c_custkey")


@registered("SELECT p_partkey, regexp_replace(translate(p_name || p_brand || p_type, 'OoQDIlZzASGTBbgq', '0000112245678899'), '[^0-9]', '', 'g') AS digits FROM part")
def unconfuse_digits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", validators.unconfuse(F.concat("p_name", "p_brand", "p_type")).alias("digits"))



@registered("SELECT o_orderkey, CASE WHEN length(s) <= 6 THEN repeat('•', CAST(greatest(length(s), 1) AS INT)) ELSE substr(s, 1, 3) || '…' || right(s, 2) END AS masked FROM (SELECT o_orderkey, trim(regexp_replace(CASE WHEN o_orderkey % 3 = 0 THEN substr(o_orderpriority, 1, 4) ELSE '  ' || o_orderpriority || '   x ' END, '\\s+', ' ', 'g')) AS s FROM orders)")
def mask_text(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.substring("o_orderpriority", 1, 4)).otherwise(F.concat(F.lit("  "), "o_orderpriority", F.lit("   x ")))
    return table(spark, sf_dir, "orders").select("o_orderkey", report.mask(raw).alias("masked"))


# words, boxes, orientation

_WORD = "(l_returnflag || l_linestatus || CAST(l_linenumber AS STRING))"


def _words(spark, sf_dir):
    """Line items as the words of an image: three words a line."""
    n = F.col("l_linenumber") - 1
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.expr(_WORD)).alias("text")).select(
        F.col("l_orderkey").alias("image_id"), F.lit(0).alias("quarter_turns"), F.lit(0).alias("block"), F.lit(0).alias("para"), F.floor(n / 3).cast("int").alias("line"), (n % 3).cast("int").alias("word"), "text",
        F.lit(90.0).alias("confidence"), (n * 20).cast("double").alias("x0"), F.lit(10.0).alias("y0"), (n * 20 + 16).cast("double").alias("x1"), F.lit(20.0).alias("y1"), F.lit(2.0).alias("scale"),
    )


_SQL_WORDS = f"SELECT l_orderkey AS image_id, CAST(l_linenumber - 1 AS INT) AS n, min({_WORD}) AS text FROM lineitem GROUP BY 1, 2"
_SQL_LINES = f"SELECT image_id, n // 3 AS line, string_agg(text, ' ' ORDER BY n) AS s FROM ({_SQL_WORDS}) GROUP BY 1, 2"
_SQL_SPOTS = f"SELECT image_id, n, text, sum(length(text) + 1) OVER (PARTITION BY image_id ORDER BY n) - length(text) - 1 AS s0 FROM ({_SQL_WORDS})"


@registered(f"SELECT image_id, string_agg(s || chr(10), '' ORDER BY line) AS text FROM ({_SQL_LINES}) GROUP BY image_id")
def text_rebuild(spark, sf_dir):
    return regions.rebuild_text(_words(spark, sf_dir)).select("image_id", "text")


@registered(f"SELECT image_id, CAST(s0 AS INT) AS \"start\", CAST(s0 + length(text) AS INT) AS \"end\", text AS word, n * 10.0 AS x, 5.0 AS y, 8.0 AS w, 5.0 AS h FROM ({_SQL_SPOTS})".replace("10.0 AS x, 5.0 AS y, 8.0 AS w, 5.0 AS h", "CAST(10 AS DOUBLE) AS x, CAST(5 AS DOUBLE) AS y, CAST(8 AS DOUBLE) AS w, CAST(5 AS DOUBLE) AS h"))
def word_offsets(spark, sf_dir):
    words = regions.rebuild_text(_words(spark, sf_dir)).select("image_id", F.explode("words").alias("w"))
    return words.select("image_id", "w.start", "w.end", F.col("w.text").alias("word"), "w.box.x", "w.box.y", "w.box.w", "w.box.h")


def _located(spark, sf_dir):
    """One custom span a line break apart from others: the letter N and what follows on its line."""
    config = ScanConfig(enabled=dict.fromkeys((c for c in rules.CATEGORIES if c != "custom"), False), custom_rules=(CustomRule("n", "N words", "N[A-Z][0-9]( [A-Z0-9]+)?", ""),))
    images = regions.rebuild_text(_words(spark, sf_dir))
    return images.select("image_id", regions.locate(scan_array(F.col("text"), config), F.col("words")).alias("regions"))


_SQL_HITS = f"SELECT image_id, line, unnest(regexp_extract_all(s, 'N[A-Z][0-9]( [A-Z0-9]+)?')) AS hit FROM ({_SQL_LINES})"


@registered(f"SELECT image_id, CAST(count(*) AS BIGINT) AS regions, CAST(sum(len(string_split(hit, ' '))) AS BIGINT) AS boxes FROM ({_SQL_HITS}) GROUP BY image_id")
def locate_boxes(spark, sf_dir):
    r = _located(spark, sf_dir).where(F.size("regions") > 0)
    boxes = F.aggregate("regions", F.lit(0).cast("long"), lambda a, x: a + F.size(x["boxes"]))
    return r.select("image_id", F.size("regions").cast("long").alias("regions"), boxes.alias("boxes"))


@registered(f"SELECT image_id, CAST(sum(len(string_split(hit, ' '))) AS BIGINT) AS rects, CAST(sum(len(string_split(hit, ' '))) * 108 AS DOUBLE) AS area FROM ({_SQL_HITS}) GROUP BY image_id")
def cover_rects(spark, sf_dir):
    r = _located(spark, sf_dir).where(F.size("regions") > 0).select("image_id", regions.cover_rects(F.col("regions")).alias("rects"))
    return r.select("image_id", F.size("rects").cast("long").alias("rects"), F.aggregate("rects", F.lit(0.0), lambda a, b: a + b["w"] * b["h"]).alias("area"))


@registered("SELECT image_id, CAST(hits AS INT) AS protected, CAST(0 AS INT) AS exposed, CAST(hits AS STRING) || ' of ' || CAST(hits AS STRING) || ' hidden' AS summary FROM (SELECT image_id, count(*) AS hits FROM (" + _SQL_HITS + ") GROUP BY 1)")
def image_dashboard(spark, sf_dir):
    r = _located(spark, sf_dir).where(F.size("regions") > 0)
    return r.select("image_id", report.dashboard(F.col("regions"), F.lit(None).cast("array<int>")).alias("d")).select("image_id", "d.protected", "d.exposed", "d.summary")


@registered("SELECT s.s_suppkey, c.c_custkey FROM supplier s LEFT JOIN customer c ON s.s_nationkey = c.c_nationkey AND c.c_custkey % 97 < s.s_suppkey % 97 + 5 AND s.s_suppkey % 97 < c.c_custkey % 97 + 3")
def locate_rows(spark, sf_dir):
    """The table form of the interval join, on keys as offsets."""
    spans = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("image_id"), "s_suppkey", (F.col("s_suppkey") % 97).alias("start"), (F.col("s_suppkey") % 97 + 5).alias("end"))
    words = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("image_id"), (F.col("c_custkey") % 97).alias("start"), (F.col("c_custkey") % 97 + 3).alias("end"), F.col("c_custkey").alias("box"))
    return regions.locate_rows(spans, words).select("s_suppkey", F.col("box").alias("c_custkey"))


@registered("SELECT image_id, quarter_turns, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, quarter_turns) AS r FROM (SELECT user_id AS image_id, CAST(event_id % 4 AS INT) AS quarter_turns, count(*) FILTER (WHERE value >= 60 AND length(event_type) >= 4) AS score FROM events GROUP BY 1, 2)) WHERE r = 1")
def orientation_argmax(spark, sf_dir):
    words = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), (F.col("event_id") % 4).cast("int").alias("quarter_turns"), F.col("event_type").alias("text"), F.col("value").alias("confidence"))
    return regions.best_orientation(regions.orientation_scores(words))


@registered("WITH h AS (SELECT CAST(p_size % 5 AS INT) AS image_id, CAST(p_partkey % 256 AS INT) AS bin, count(*) AS pixels FROM part GROUP BY 1, 2), c AS (SELECT *, sum(pixels) OVER (PARTITION BY image_id ORDER BY bin) AS below, sum(pixels) OVER (PARTITION BY image_id ORDER BY bin DESC) AS above, sum(pixels) OVER (PARTITION BY image_id) AS n FROM h) SELECT image_id, min(bin) FILTER (WHERE below >= 0.02 * n) AS lo, max(bin) FILTER (WHERE above >= 0.02 * n) AS hi FROM c GROUP BY image_id")
def percentile_cut(spark, sf_dir):
    h = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 5).cast("int").alias("image_id"), (F.col("p_partkey") % 256).cast("int").alias("bin")).agg(F.count("*").alias("pixels"))
    return regions.percentile_cut(h)


@registered("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_wins(spark, sf_dir):
    return history.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


_SAVED = "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '{broken' WHEN 2 THEN '{\"enabled\":{\"email\":false},\"minConfidence\":0.' || CAST(1 + o_orderkey % 9 AS STRING) || '}' ELSE '{\"faces\":false,\"minConfidence\":\"high\"}' END"


@registered("SELECT o_orderkey, o_orderkey % 4 <> 2 AS email, TRUE AS phone, o_orderkey % 4 <> 3 AS faces, CASE WHEN o_orderkey % 4 = 2 THEN CAST('0.' || CAST(1 + o_orderkey % 9 AS STRING) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS min_confidence FROM orders")
def settings_merge(spark, sf_dir):
    got = table(spark, sf_dir, "orders").select("o_orderkey", settings.merge(F.expr(_SAVED)).alias("s"))
    return got.select("o_orderkey", F.col("s.enabled")["email"].alias("email"), F.col("s.enabled")["phone"].alias("phone"), "s.faces", "s.min_confidence")


@registered("SELECT c_custkey, least(x0, x1) AS x, abs(x1 - x0) AS w FROM (SELECT c_custkey, least(greatest(c_acctbal / 50, 0), 100) AS x0, CAST(c_custkey % 100 AS DOUBLE) AS x1 FROM customer) WHERE abs(x1 - x0) >= 6")
def drawn_boxes(spark, sf_dir):
    drags = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 50).alias("ax"), F.lit(5.0).alias("ay"), (F.col("c_custkey") % 100).cast("double").alias("bx"), F.lit(95.0).alias("by"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    return regions.drawn_boxes(drags).select("c_custkey", "box.x", "box.w")


# state of a session, faces, pixels, OCR output

def _flags(spark, sf_dir):
    """Three regions an image, hidden or not by the key's remainders."""
    region = lambda hidden: F.struct(F.lit("x").alias("detection"), F.array().cast("array<int>").alias("boxes"), hidden.alias("hidden"))
    own = F.array(*[region(F.col("c_custkey") % n == 0) for n in (2, 3, 5)])
    return table(spark, sf_dir, "customer").select("c_custkey", own.alias("regions"))


def _shown(regions):
    return F.array_join(F.transform(regions, lambda r: F.when(r["hidden"], F.lit("h")).otherwise(F.lit("v"))), "")


@registered("SELECT c_custkey, CASE WHEN (c_custkey % 2 = 0) <> (c_custkey % 4 = 0) THEN 'h' ELSE 'v' END || CASE WHEN (c_custkey % 3 = 0) <> (c_custkey % 4 = 1) THEN 'h' ELSE 'v' END || CASE WHEN (c_custkey % 5 = 0) <> (c_custkey % 4 = 2) THEN 'h' ELSE 'v' END AS flags FROM customer")
def region_toggle(spark, sf_dir):
    """One region switched; a number beyond the last changes nothing."""
    return _flags(spark, sf_dir).select("c_custkey", _shown(history.toggle(F.col("regions"), (F.col("c_custkey") % 4).cast("int"))).alias("flags"))


@registered("SELECT c_custkey, CASE WHEN c_custkey % 30 = 0 THEN 'vvv' ELSE 'hhh' END AS flags FROM customer")
def region_toggle_all(spark, sf_dir):
    return _flags(spark, sf_dir).select("c_custkey", _shown(history.toggle_all(F.col("regions"))).alias("flags"))


#: Sessions of two boxes: what is done, in order.
_SESSIONS = ("add add", "add add undo", "add add undo redo", "add add delete undo", "add undo add redo", "add add delete", "undo add redo")


@registered("SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '1,2' WHEN 1 THEN '1' WHEN 2 THEN '1,2' WHEN 3 THEN '1,2' WHEN 4 THEN '2' WHEN 5 THEN '2' ELSE '1' END AS boxes FROM customer")
def box_undo_redo(spark, sf_dir):
    """Hand-drawn boxes after a session's log; a delete takes the first box, an edit forgets what was undone."""
    log = F.split(F.element_at(F.array(*map(F.lit, _SESSIONS)), (F.col("c_custkey") % 7 + 1).cast("int")), " ")
    events = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(log).alias("seq", "action"), log.alias("log"))
    nth = F.size(F.filter(F.slice("log", F.lit(1), F.col("seq") + 1), lambda a: a == "add")).cast("double")
    box = F.when(F.col("action") == "add", F.struct(nth.alias("x"), F.lit(0.0).alias("y"), F.lit(9.0).alias("w"), F.lit(9.0).alias("h")))
    got = history.manual_boxes(events.select("c_custkey", "seq", "action", box.alias("box"), F.lit(0).alias("index")), key="c_custkey")
    return got.select("c_custkey", F.array_join(F.transform("boxes", lambda b: b["x"].cast("int").cast("string")), ",").alias("boxes"))


@registered("SELECT n.n_nationkey AS image_id, CAST(1 + count(s.s_suppkey) AS INT) AS regions, coalesce(string_agg(CAST(s.s_suppkey % 10 AS VARCHAR), '' ORDER BY s.s_suppkey % 10 DESC), '') AS tenths FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_suppkey % 10 >= 5 GROUP BY 1")
def face_join(spark, sf_dir):
    """Faces of half confidence or more follow an image's text regions, the surest first."""
    box = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(5.0).alias("w"), F.lit(5.0).alias("h"))
    faces = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("image_id"), box.alias("box"), (F.col("s_suppkey") % 10 / 10).alias("score"))
    text = F.array(F.struct(F.struct(F.lit("email").alias("category"), F.lit("Email address").alias("label"), F.lit("medium").alias("severity"), F.lit(0).alias("start"), F.lit(5).alias("end"), F.lit("a@b.c").alias("text"), F.lit(0.9).alias("confidence"), F.lit(True).alias("redact_by_default")).alias("detection"), F.array(box).alias("boxes"), F.lit(True).alias("hidden")))
    both = regions.join_faces(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("image_id"), text.alias("regions")), faces)
    own = F.slice("regions", F.lit(2), F.size("regions"))
    return both.select("image_id", F.size("regions").alias("regions"), F.array_join(F.transform(own, lambda r: F.round(r["detection"]["confidence"] * 10).cast("int").cast("string")), "").alias("tenths"))


@registered("WITH px AS (SELECT p_partkey AS image_id, unnest([p_partkey % 256, p_size, 255]) AS r, unnest([p_size, p_partkey % 256, 255]) AS g, unnest([7, 0, 255]) AS b FROM part) SELECT image_id, CAST(floor(r * CAST(0.299 AS DOUBLE) + g * CAST(0.587 AS DOUBLE) + b * CAST(0.114 AS DOUBLE)) AS INT) AS bin, count(*) AS pixels FROM px GROUP BY 1, 2")
def gray_bins(spark, sf_dir):
    """Luma histograms of images of three pixels."""
    from ..operators import images

    byte = lambda c: F.lpad(F.hex(c.cast("int")), 2, "0")
    key, size = F.col("p_partkey") % 256, F.col("p_size")
    rgba = F.unhex(F.concat(byte(key), byte(size), F.lit("07FF"), byte(size), byte(key), F.lit("00FFFFFFFFFF")))
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), F.lit(3).alias("width"), F.lit(1).alias("height"), rgba.alias("rgba"))
    return images.gray_histogram(own).where("pixels > 0")


@registered("WITH w AS (SELECT user_id AS image_id, CAST(event_id % 4 AS INT) AS t, count(*) FILTER (WHERE value >= 60 AND length(event_type) >= 4) AS score FROM events GROUP BY 1, 2), f AS (SELECT DISTINCT image_id, score FROM w WHERE t = 0), b AS (SELECT image_id, t, score, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, t) AS r FROM w) SELECT f.image_id, CAST(CASE WHEN f.score >= 8 OR b.score = 0 THEN 0 ELSE b.t END AS INT) AS quarter_turns FROM f JOIN b ON b.image_id = f.image_id AND b.r = 1")
def orientation_choice(spark, sf_dir):
    """Upright where the first read has eight real words, else the best of all four turns."""
    words = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), (F.col("event_id") % 4).cast("int").alias("quarter_turns"), F.col("event_type").alias("text"), F.col("value").alias("confidence"))
    return regions.orientation_flow(words.where("quarter_turns = 0"), words)


@registered("SELECT s_suppkey AS image_id, CAST(l.line AS INT) AS line, CAST(w.word AS INT) AS word, 'w' || CAST(l.line AS VARCHAR) || CAST(w.word AS VARCHAR) AS text, CAST(10 * w.word AS DOUBLE) AS x0 FROM supplier, (SELECT unnest([0, 1]) AS line) l, (SELECT unnest([0, 1, 2]) AS word) w WHERE w.word <= s_suppkey % 3")
def ocr_tree_words(spark, sf_dir):
    """An OCR tree of two lines, as one row for each word."""
    from ..sources import readers

    def word(nth, n):
        return F.struct(F.concat(F.lit(f"w{nth}"), n.cast("string")).alias("text"), F.lit(91.5).alias("confidence"), F.struct((n * 10).cast("double").alias("x0"), F.lit(0.0).alias("y0"), (n * 10 + 8).cast("double").alias("x1"), F.lit(9.0).alias("y1")).alias("bbox"))

    def line(nth):
        return F.struct(F.transform(F.sequence(F.lit(0), (F.col("s_suppkey") % 3).cast("int")), lambda n: word(nth, n)).alias("words"))

    lines = F.array(line(0), line(1))
    blocks = F.array(F.struct(F.array(F.struct(lines.alias("lines"))).alias("paragraphs")))
    tree = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_id"), F.lit(0).alias("quarter_turns"), F.lit(1.0).alias("scale"), blocks.alias("blocks"))
    return readers.ocr_words(tree).select("image_id", "line", "word", "text", "x0")


@registered(
    "WITH r(category, rules) AS (VALUES ('api_key', 8), ('jwt', 1), ('credit_card', 1), ('iban', 1), ('bic', 1), ('cvv', 1), ('national_id', 4), ('tax_id', 1), ('mrz', 1), ('id_document', 1), ('name', 1), ('email', 1), ('phone', 2)), "
    "h AS (SELECT unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['email', 'cvv', 'name', 'credit_card'] ELSE ['email', 'cvv', 'name'] END) AS category FROM orders) "
    "SELECT r.category, CAST(r.rules AS BIGINT) AS rules, (SELECT count(*) FROM h WHERE h.category = r.category) AS hits FROM r"
)
def rule_table(spark, sf_dir):
    """The rules of each category, with what they find in texts made from orders."""
    found = scan(_mixed(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("hits"))
    own = rules.rules_table(spark).groupBy("category").agg(F.count("*").alias("rules"))
    return own.join(found, "category", "left").select("category", "rules", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
