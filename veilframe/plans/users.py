"""Registered queries over users' own rules and settings, and their SQL."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from ..functions import rules, settings
from ..operators import history, regions
from ..operators.scan import CustomRule, ScanConfig, scan
from ..sources import readers
from .catalog import _counts, _mixed, registered, table

_NONE = dict.fromkeys((c for c in rules.CATEGORIES if c != "custom"), False)


def own(*custom: CustomRule) -> ScanConfig:
    """A user's rules alone."""
    return ScanConfig(enabled=_NONE, custom_rules=custom)


# rules: switch, defaults, flags, empty matches, overlaps

@registered("SELECT o_orderkey, s.own, CASE WHEN s.own THEN 'custom,email' ELSE 'email' END AS found FROM orders, (SELECT unnest([TRUE, FALSE]) AS own) s")
def custom_switch(spark, sf_dir):
    """A user's rule with its category on and off; the mail is found either way."""
    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("'mail u' || CAST(o_orderkey AS STRING) || '@example.org ref N-' || CAST(o_orderkey AS STRING)").alias("text"))
    rule = CustomRule("n", "Reference", "N-[0-9]+", "g")
    one = lambda on: _counts(scan(texts, config=ScanConfig(enabled={c: c in ("email", "custom") and (c == "email" or on) for c in rules.CATEGORIES}, custom_rules=(rule,)))).withColumn("own", F.lit(on))
    return one(True).unionByName(one(False))


_PARTS = "'ref A' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 2 = 0 THEN ' tag B' || CAST(c_custkey AS STRING) ELSE '' END || ' key C' || CAST(c_custkey AS STRING)"


@registered(
    "SELECT c_custkey, 'A words' AS label, 'high' AS severity, CAST(0.8 AS DOUBLE) AS confidence, TRUE AS redact_by_default, 'A' || c_custkey AS text FROM customer "
    "UNION ALL SELECT c_custkey, 'B words', 'low', 0.8, FALSE, 'B' || c_custkey FROM customer WHERE c_custkey % 2 = 0 "
    "UNION ALL SELECT c_custkey, 'C words', 'critical', 0.8, TRUE, 'C' || c_custkey FROM customer"
)
def custom_defaults(spark, sf_dir):
    """Rules without a severity are high, and all but low ones are hidden from the start."""
    texts = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_PARTS).alias("text"))
    made = own(CustomRule("a", "A words", "A[0-9]+"), CustomRule("b", "B words", "B[0-9]+", "g", "low"), CustomRule("c", "C words", "C[0-9]+", "g", "critical"))
    return scan(texts, config=made).select("c_custkey", "label", "severity", "confidence", "redact_by_default", "text")


@registered(
    "SELECT c_custkey, 'any case' AS label, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'whole line', c_mktsegment FROM customer "
    "UNION ALL SELECT c_custkey, 'over lines', 'en' || chr(10) || 'x' FROM customer"
)
def custom_flags(spark, sf_dir):
    """Flags for case, lines and dots; the same patterns without them find nothing, an unknown flag drops its rule."""
    texts = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("\n", "c_name", "c_mktsegment", F.lit("en"), F.lit("x")).alias("text"))
    patterns = (("any case", "customer#[0-9]+", "gi"), ("whole line", "^[A-Z]+$", "gm"), ("over lines", "en.x", "gs"))
    made = [CustomRule(name, name, p, f) for name, p, f in patterns] + [CustomRule(f"plain {name}", f"plain {name}", p, "g") for name, p, _ in patterns]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return scan(texts, config=own(*made, CustomRule("odd", "odd", "[a-z]+", "q"))).select("c_custkey", "label", "text")


@registered("SELECT c_custkey, unnest(regexp_extract_all(c_name || ' ' || c_nationkey, '[0-9]+')) AS text FROM customer")
def custom_empty_matches(spark, sf_dir):
    """A pattern that also matches nothing: the scan goes on behind each place, and empty matches are no spans."""
    texts = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", "c_name", F.col("c_nationkey").cast("string")).alias("text"))
    return scan(texts, config=own(CustomRule("d", "Digits", "[0-9]*", "g"))).select("c_custkey", "text")


_PAIR = "[a-z]{4,} [a-z]{4,}"


@registered(
    f"WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_PAIR}') AS p, regexp_extract_all(regexp_replace(text, '{_PAIR}', '|', 'g'), '[a-z]{{4,}}') AS w FROM documents WHERE regexp_matches(text, '[a-z]{{4,}}')) "
    "SELECT doc_id, CAST(len(p) AS BIGINT) AS pairs, CAST(len(w) AS BIGINT) AS singles, CAST(coalesce(list_sum(list_transform(p || w, lambda x: length(x))), 0) AS BIGINT) AS covered FROM t"
)
def overlap_many(spark, sf_dir):
    """Thousands of overlapping hits in a text: pairs of words are severe and win, words beside no pair stay."""
    made = own(CustomRule("w", "word", "[a-z]{4,}", "g", "low"), CustomRule("p", "pair", _PAIR, "g", "high"))
    spans = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), config=made)
    return spans.groupBy("doc_id").agg(F.count_if(F.col("label") == "pair").alias("pairs"), F.count_if(F.col("label") == "word").alias("singles"), F.sum(F.col("end") - F.col("start")).alias("covered"))


@registered("SELECT c_custkey, CAST(i.at AS INT) AS \"start\", 'field' AS label FROM customer, (SELECT unnest([18, 24]) AS at) i")
def custom_control_characters(spark, sf_dir):
    """A pattern for control characters, which separate fields of some formats."""
    texts = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("\u0001"), F.lit("field"), F.lit("\u0002")).alias("text"))
    return scan(texts, config=own(CustomRule("s", "field", "[\u0001\u0002]", "g"))).select("c_custkey", "start", "label")


# settings, sources, versions

@registered("SELECT o_orderkey, 'credit_card' AS found FROM orders WHERE o_orderkey % 2 = 0")
def settings_round_trip(spark, sf_dir):
    """What a user saved, loaded, saved again and turned into a scan: no mails, nothing below the floor."""
    got = settings.load(settings.save(settings.load('{"enabled":{"email":false,"odd":1},"minConfidence":0.9}')))
    settings.check(got)
    return _counts(scan(_mixed(spark, sf_dir), config=settings.to_config(got)))


@registered(
    "SELECT n.n_nationkey AS image_id, s.faces, CAST(CASE WHEN s.faces THEN (SELECT count(*) FROM supplier WHERE s_nationkey = n.n_nationkey AND s_suppkey % 10 >= 5) ELSE 0 END AS INT) AS regions "
    "FROM nation n, (SELECT unnest([TRUE, FALSE]) AS faces) s"
)
def face_switch(spark, sf_dir):
    """Faces of the same images under two users' settings."""
    box = F.struct(*[F.lit(0.0).alias(c) for c in "xywh"])
    faces = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("image_id"), box.alias("box"), (F.col("s_suppkey") % 10 / 10).alias("score"))
    kind = dict(regions.face_regions(faces).dtypes)["faces"]
    text = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("image_id"), F.array().cast(kind).alias("regions"))

    def under(saved):
        user = settings.load(saved)
        return regions.join_faces(text, faces, settings=user).select("image_id", F.lit(user["faces"]).alias("faces"), F.size("regions").alias("regions"))

    return under("{}").unionByName(under('{"faces":false}'))


@registered("SELECT c_custkey, c_custkey % 4 = 3 AS kept FROM customer")
def blank_texts(spark, sf_dir):
    """Blanks, line breaks and wide white space are no text; a letter among them is."""
    wide = F.array(*map(F.lit, ("", " \n\t\r\n", "\u2003\u00a0\u3000\ufeff", "\n x\n")))
    return table(spark, sf_dir, "customer").select("c_custkey", readers.not_blank(wide[(F.col("c_custkey") % 4).cast("int")]).alias("kept"))


@registered("SELECT user_id, version, event_type, CAST(event_id AS VARCHAR) AS id FROM (SELECT *, event_id % 7 AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7 DESC, event_type DESC, CAST(event_id AS VARCHAR) DESC) AS r FROM events) WHERE r = 1")
def latest_of_equals(spark, sf_dir):
    """Rows of equal version: the largest other columns decide, a map among them by its JSON."""
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 7).alias("version"), F.create_map(F.lit("id"), F.col("event_id").cast("string")).alias("m"), "event_type")
    return history.latest(e, ["user_id"]).select("user_id", "version", "event_type", F.col("m")["id"].alias("id"))
