"""Finding sensitive spans: extraction with offsets, confirmation, floor, and overlap resolution, all in one narrow pass.

Offsets are code points, half-open.  Nothing here shuffles: a document's spans
come from its own row, on batch and streaming DataFrames alike.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import bound, counts_before, sums_before
from ..functions.rules import CATEGORIES, RULES, SEVERITIES, Rule, facts
from . import marked

SPAN = "struct<category:string,label:string,severity:string,start:int,end:int,text:string,confidence:double,redact_by_default:boolean>"
HIT = "struct<ordinal:int,start:int,end:int,label:string,severity:string,category:string,confidence:double,text:string>"


#: A user's flags in Java's dialect: ignoring case goes beyond ASCII there and here, and characters are whole code points without a flag.
JAVA_FLAGS = {"i": "iu", "m": "m", "s": "s", "u": ""}


@dataclass(frozen=True)
class CustomRule:
    id: str
    label: str
    pattern: str
    flags: str = ""
    severity: str | None = None


@dataclass(frozen=True)
class ScanConfig:
    """`enabled` has category switches (a missing one is on); the floor keeps hits of at least `min_confidence`."""

    enabled: dict[str, bool] = field(default_factory=dict)
    custom_rules: tuple[CustomRule, ...] = ()
    min_confidence: float = 0.0

    def on(self, category: str) -> bool:
        return self.enabled.get(category) is not False


def compile_custom(rule: CustomRule, spark: SparkSession | None = None) -> Rule | None:
    """A user's rule, or None with a warning if its flags or pattern can't be used; the scan goes on without it."""
    flags = rule.flags.replace("g", "")
    severity = rule.severity or "high"
    try:
        if set(flags) - set(JAVA_FLAGS):
            raise ValueError(f"flags {flags!r}")
        if severity not in SEVERITIES:
            raise ValueError(f"severity {severity!r}")
        own = "".join(JAVA_FLAGS[f] for f in sorted(set(flags)))
        prefix = f"(?{own})" if own else ""
        spark = spark or SparkSession.active()
        spark._jvm.java.util.regex.Pattern.compile(prefix + rule.pattern)
    except Exception as e:  # noqa: BLE001  a bad pattern of any kind
        warnings.warn(f"custom rule {rule.id} is skipped: {e}", stacklevel=2)
        return None
    return Rule("custom", rule.label, severity, prefix + rule.pattern, 0.8)


def active_rules(config: ScanConfig) -> list[tuple[int, Rule]]:
    """Rules that enter the plan, with their place in the table (the last tie-break)."""
    rules = [(i, r) for i, r in enumerate(RULES) if config.on(r.category)]
    if config.on("custom"):
        own = [compile_custom(r) for r in config.custom_rules]
        rules += [(len(RULES) + i, r) for i, r in enumerate(own) if r]
    return rules


MATCH = "array<struct<start:int,end:int,hit:string>>"
#: Marks before and after a match, and what stands for either in a text.  Built-in rules never ask for control
#: characters, which keep a text in one byte a character; a user's rules may, so theirs are noncharacters, the same
#: before and after: gaps and matches alternate, and a text is split at one character in half the time.
BUILT_IN, USERS = ("\u0001", "\u0002", "\u0003"), (marked.MARK, marked.MARK, "\ufdd2")
#: Lengths that are added up in one array.
RUN = 32


def altered(text: Column, marks: tuple[str, str, str]) -> Column:
    """Whether a mark stands in the text."""
    begin, end, _ = marks
    return F.contains(text, F.lit(begin)) if begin == end else F.contains(text, F.lit(begin)) | F.contains(text, F.lit(end))


def unmarked(text: Column, marks: tuple[str, str, str] = BUILT_IN) -> Column:
    """The text with the marks, should they stand in it, as another such character, one for one."""
    begin, end, other = marks
    return F.when(altered(text, marks), F.translate(text, begin + end, other * 2)).otherwise(text)


def matches(text: Column, pattern: str) -> Column:
    """All matches in order as array<struct<start, end, hit>>."""
    return offsets(F.split(tagged(unmarked(text), pattern), at(BUILT_IN), -1))


def tagged(plain: Column, pattern: str, marks: tuple[str, str, str] = BUILT_IN) -> Column:
    """The text with a mark before and another after each match."""
    return F.regexp_replace(plain, F.lit(pattern), F.lit(f"{marks[0]}$0{marks[1]}"))


def at(marks: tuple[str, str, str]) -> str:
    return marks[0] if marks[0] == marks[1] else f"[{marks[0]}{marks[1]}]"


def offsets(parts: Column) -> Column:
    """The matches of a text that was split at its marks, but for empty ones.

    Gaps and matches alternate: a match begins behind all earlier gaps and matches and its own gap.
    """

    def found(ps):
        pairs = F.transform(F.sequence(F.lit(1), F.size(ps) - 2, F.lit(2)), lambda i: F.length(ps[i - 1]) + F.length(ps[i]))
        spot = lambda n, k, befores: F.struct((befores[k] + F.length(ps[k * 2])).alias("start"), (befores[k] + n).alias("end"), ps[k * 2 + 1].alias("hit"))
        spots = bound(pairs, lambda ns: bound(sums_before(ns, RUN), lambda befores: F.transform(ns, lambda n, k: spot(n, k, befores))))
        return F.when(F.size(ps) > 2, F.filter(spots, lambda m: m["hit"] != "")).otherwise(F.array().cast(MATCH))

    return bound(parts, found)


def confirmed(m: Column, n: Column, rules: list[tuple[int, Rule]], floor: float) -> Column:
    """A match of the n-th active rule as a hit, or null if the rule's check rejects it or it is below the floor."""
    each = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])[n]
    label, confidence = each([r.label for _, r in rules], "string"), each([r.confidence for _, r in rules], "double")

    def hit(label, confidence):
        made = F.struct(
            each([i for i, _ in rules], "int").alias("ordinal"), m["start"].alias("start"), m["end"].alias("end"), label.alias("label"),
            each([r.severity for _, r in rules], "string").alias("severity"), each([r.category for _, r in rules], "string").alias("category"), confidence.alias("confidence"), m["hit"].alias("text"),
        )
        return F.when(confidence >= floor, made)

    checks = [(k, r.confirm) for k, (_, r) in enumerate(rules) if r.confirm]
    if not checks:
        return hit(label, confidence)
    said = F
    for k, check in checks:
        said = said.when(n == k, check(m["hit"]))
    return bound(said.otherwise(F.struct(label.alias("label"), confidence.alias("confidence"))), lambda s: hit(s["label"], s["confidence"]))


def strength(h: Column) -> Column:
    """Severity rank by a million, confidence by ten thousand, and the length, added in this order."""
    rank = F.coalesce(*[F.when(h["severity"] == s, F.lit(float(r))) for s, r in SEVERITIES.items()])
    return rank * 1000000.0 + h["confidence"] * 10000.0 + (h["end"] - h["start"]).cast("double")


#: Hits of a group that are compared with each other.
FEW = 16
#: A start and a place in one number: starts count by this.
PLACES = 1 << 31


def resolve(found: Column) -> Column:
    """Greedy selection: strongest first, each kept unless it meets a kept one; then by start."""
    return bound(found, lambda hs: F.when(F.size(hs) < 2, hs).otherwise(F.transform(kept(hs), lambda at: hs[at])))


def kept(hs: Column) -> Column:
    """Places of the hits that the greedy selection keeps, in order of their starts.

    Hits in order of start fall into groups that don't meet: a group begins where
    as many hits have ended as begun.  Each group is chosen from by itself, so the
    work follows the groups' sizes, not the text's.  Up to the choice there are
    only numbers, which cost less to sort and to hand on than hits.
    """
    keys = F.sort_array(F.transform(hs, lambda h, at: _key(h["start"], at)))
    ends = F.sort_array(F.transform(hs, lambda h: h["end"]))
    return bound(F.struct(keys.alias("keys"), ends.alias("ends")), lambda s: F.when(F.size(hs) > 1, _by_group(hs, s)).otherwise(F.transform(s["keys"], _place)))


def _key(start: Column, at: Column) -> Column:
    return start.cast("bigint") * F.lit(PLACES) + at


def _place(key: Column) -> Column:
    return key.bitwiseAND(F.lit(PLACES - 1)).cast("int")


def _by_group(hs: Column, s: Column) -> Column:
    """The choice from two or more hits, given the keys in order and the ends in order."""
    keys, ends, n = s["keys"], s["ends"], F.size(hs)
    firsts = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), n - 1), lambda k: ends[k - 1] <= F.shiftright(keys[k], 31)))
    one = lambda first, behind: F.when(behind == first + 1, F.array(_place(keys[first]))).otherwise(_of_group(hs, F.slice(keys, first + 1, behind - first)))
    each = lambda fs: F.flatten(F.transform(fs, lambda first, j: one(first, F.coalesce(F.get(fs, j + 1), n))))
    return bound(firsts, lambda fs: F.when(F.size(fs) == n, F.transform(keys, _place)).otherwise(each(fs)))


def _of_group(hs: Column, keys: Column) -> Column:
    """The strongest alone where it meets all others; few are compared, many go through a mask."""
    ranked = lambda at: F.struct((-strength(hs[at])).alias("weak"), hs[at]["ordinal"].alias("ordinal"), hs[at]["start"].alias("start"), hs[at]["end"].alias("end"), at.alias("at"))
    rest = lambda rs: F.when(F.size(rs) <= FEW, _few(rs)).otherwise(_chosen(rs))
    choice = lambda rs: bound(F.array_min(rs), lambda best: F.when(F.forall(rs, lambda r: _meet(r, best)), F.array(best["at"])).otherwise(rest(rs)))
    return bound(F.transform(keys, lambda key: ranked(_place(key))), choice)


def _meet(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _few(rs: Column) -> Column:
    """The choice where comparing each hit with the kept ones costs less than a mask."""
    step = lambda own, r: F.when(F.exists(own, lambda k: _meet(k, r)), own).otherwise(F.concat(own, F.array(r)))
    own = F.aggregate(F.sort_array(rs), F.slice(rs, 1, 0), step)
    return F.transform(F.sort_array(F.transform(own, lambda r: _key(r["start"], r["at"]))), _place)


def _chosen(rs: Column) -> Column:
    """The choice from many hits in order of start.

    Hits are numbered by start.  A hit covers the numbers from its own to that of
    the last hit which begins before its end; two hits meet just if one covers
    the other's number.  A mask of a byte for each number says what is taken: 2
    where a kept hit stands, 1 where it covers others.  So testing a hit compares
    a slice of bytes, keeping one copies the mask, and the rest is sorting.
    """
    covers = counts_before(F.transform(rs, lambda r: r["start"]), F.transform(rs, lambda r: r["end"]))
    ranked = lambda cs: F.sort_array(F.transform(rs, lambda r, k: F.struct(r["weak"].alias("weak"), r["ordinal"].alias("ordinal"), r["start"].alias("start"), k.alias("lo"), cs[k].alias("hi"))))
    fill = lambda n, byte: F.repeat(F.lit(byte), n).cast("binary")
    state = F.struct(fill(F.size(rs), "\0").alias("none"), fill(F.size(rs), "\1").alias("over"), bound(covers, ranked).alias("order"))

    def mark(s):
        def step(mask, h):
            size = h["hi"] - h["lo"]
            free = F.substr(mask, h["lo"] + 1, size) == F.substr(s["none"], F.lit(1), size)
            return F.when(free, F.overlay(mask, F.concat(F.lit(b"\2"), F.substr(s["over"], F.lit(1), size - 1)), h["lo"] + 1, size)).otherwise(mask)

        return F.aggregate(s["order"], s["none"], step)

    taken = lambda mask: F.filter(rs, lambda r, k: F.substr(mask, k + 1, F.lit(1)) == F.lit(b"\2"))
    return F.transform(bound(bound(state, mark), taken), lambda r: r["at"])


def candidates(text: Column, config: ScanConfig | None = None) -> Column:
    """All hits of all active rules before overlap resolution; a rejected hit still uses up its characters.

    Each rule that its trigger lets through marks its matches in a copy of the
    text; what follows, from marks to confirmed hits, is one expression for all.
    """
    config = config or ScanConfig()
    return _hits(text, active_rules(config), config.min_confidence)


def _hits(text: Column, rules: list[tuple[int, Rule]], floor: float) -> Column:
    if not rules:
        return F.array().cast(f"array<{HIT}>")

    user = [r.category == "custom" for _, r in rules]

    def found(t):
        marks = [tagged(t["own"] if u else t["plain"], f"(?={r.begins}){r.pattern}" if r.begins else r.pattern, USERS if u else BUILT_IN) for u, (_, r) in zip(user, rules, strict=True)]
        copies = F.array(*[F.struct(F.lit(n).alias("n"), (F.when(r.trigger(t), m) if r.trigger else m).alias("marked")) for n, ((_, r), m) in enumerate(zip(rules, marks, strict=True))])
        some = F.filter(copies, lambda c: c["marked"].isNotNull())
        made = F.flatten(F.transform(some, lambda c: F.transform(offsets(split(c)), lambda m: confirmed(m, c["n"], rules, floor))))
        return F.filter(made, lambda h: h.isNotNull())

    def split(c):
        parts = F.split(c["marked"], at(BUILT_IN), -1)
        # a user's rules come after the built-in ones
        return F.when(c["n"] < user.index(True), parts).otherwise(F.split(c["marked"], at(USERS), -1)) if any(user) else parts

    known = facts(text, [r for _, r in rules]).withField("plain", unmarked(text))
    return bound(known.withField("own", unmarked(text, USERS)) if any(user) else known, found)


def scan_array(text: Column, config: ScanConfig | None = None) -> Column:
    """The non-overlapping spans of a text, ascending by start; null and empty texts have none.

    Users' rules alone may match any number of times: their spans are made from marked texts
    by array operations over a batch of texts.  With built-in rules all is one JVM expression.
    """
    config = config or ScanConfig()
    text = F.coalesce(text, F.lit(""))
    rules = active_rules(config)
    if rules and all(r.category == "custom" for _, r in rules):
        known = [(i, r.label, r.severity, r.confidence) for i, r in rules if r.confidence >= config.min_confidence]
        plain = unmarked(text, USERS)
        return F.arrow_udf(marked.spans(known, SEVERITIES), f"array<{SPAN}>")(F.when(altered(text, USERS), text), *[tagged(plain, r.pattern, USERS) for _, r in rules if r.confidence >= config.min_confidence])
    differs = F.lit(False)
    for marks in {USERS if r.category == "custom" else BUILT_IN for _, r in rules}:
        differs = differs | altered(text, marks)
    # cutting a span out walks the text up to it, so only texts that held marks, whose copies differ, are cut
    cut = lambda s: s.withField("text", F.substr(text, s["start"] + 1, s["end"] - s["start"]))
    span = lambda h: F.struct(*[h[c].alias(c) for c in ("category", "label", "severity", "start", "end", "text", "confidence")], (h["severity"] != "low").alias("redact_by_default"))
    # a rule's own hits stand apart, in order
    chosen = lambda hs: F.transform(hs, span) if len(rules) < 2 else F.transform(kept(hs), lambda at: span(hs[at]))
    return bound(bound(_hits(text, rules, config.min_confidence), chosen), lambda spans: F.when(differs, F.transform(spans, cut)).otherwise(spans))


def scan(df: DataFrame, text_col: str = "text", id_cols: list[str] | None = None, config: ScanConfig | None = None) -> DataFrame:
    """One row for each span, with the id columns.  inline_outer keeps the scan a single evaluation of each pattern."""
    ids = id_cols if id_cols is not None else [c for c in df.columns if c != text_col]
    spans = df.select(*ids, scan_array(F.col(text_col), config).alias("__spans"))
    return spans.select(*ids, F.inline_outer("__spans")).where(F.col("category").isNotNull())


def category_names() -> tuple[str, ...]:
    return CATEGORIES
