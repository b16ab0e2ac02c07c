"""The flagship and the findings queries against a plain Python scan: its own checks, its own greedy choice of spans."""

from collections import Counter

import pytest
import regex

from tests.test_queries import SF
from veilframe.functions import rules
from veilframe.plans import catalog

RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def weighed(d, weights, ten):
    r = sum(int(c) * w for c, w in zip(d, weights, strict=True))
    return ten(r)


def personal(d):
    return len(d) == 13 and d.isdigit() and weighed(d[:12], (2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9), lambda s: 1 if s % 11 == 10 else s % 11) == int(d[12])


def shaped(d):
    return "1" <= d[0] <= "8" and 1 <= int(d[3:5]) <= 12 and 1 <= int(d[5:7]) <= 31 and 1 <= int(d[7:9]) <= 52


def iban(s):
    s = s.replace(" ", "").upper()
    return 15 <= len(s) <= 34 and s[:2].isalpha() and s[2:4].isdigit() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def digits(s):
    return "".join(c for c in s if c in "0123456789")


def confirmed(rule, hit):
    """Confidence of a hit, or None, for the rules that the tables' texts can reach."""
    if rule.category == "credit_card":
        return rule.confidence if 13 <= len(digits(hit)) <= 19 and luhn(digits(hit)) else None
    if rule.category == "iban":
        return rule.confidence if iban(hit) else None
    if rule.category == "phone":
        n = len(digits(hit))
        return rule.confidence if (8 <= n <= 15 if hit[0] == "+" else n == 10) else None
    if rule.category == "national_id" and rule.pattern == "[1-9][0-9]{12}":
        return rule.confidence if personal(hit) and shaped(hit) else None
    return rule.confidence if rule.confirm is None else NotImplemented


def spans(text):
    found = []
    for nth, rule in enumerate(rules.RULES):
        for m in regex.finditer(rule.pattern, text):
            said = confirmed(rule, m.group())
            if said is NotImplemented:
                raise NotImplementedError(f"{rule.category}: {m.group()!r}")
            if said is not None:
                found.append((-(RANK[rule.severity] * 1e6 + said * 1e4 + m.end() - m.start()), nth, m.start(), m.end(), rule.category, rule.severity, said))
    kept = []
    for f in sorted(found):
        if all(f[3] <= k[2] or k[3] <= f[2] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: f[2])


@pytest.fixture(scope="module")
def plain(spark):
    def read(name, key, text):
        return {r[0]: spans(r[1] or "") for r in catalog.table(spark, SF, name).select(key, text).collect()}

    return {"documents": read("documents", "doc_id", "text"), "pages": read("pages", "page_id", "html")}


def test_category_counts(spark, plain):
    hits = Counter((s[4], s[5]) for own in plain["documents"].values() for s in own)
    docs = Counter(x for own in plain["documents"].values() for x in {(s[4], s[5]) for s in own})
    got = {(r.category, r.severity): (r.hits, r.documents) for r in catalog.QUERIES["category_counts"](spark, SF).collect()}
    assert got == {k: (n, docs[k]) for k, n in hits.items()}


@pytest.mark.parametrize("query, name, key", [("scan_documents", "documents", "doc_id"), ("scan_pages", "pages", "page_id")])
def test_findings(spark, plain, query, name, key):
    want = Counter((i, s[4], s[5], s[2], s[3], s[6]) for i, own in plain[name].items() for s in own)
    got = Counter((r[key], r.category, r.severity, r.start, r.end, r.confidence) for r in catalog.QUERIES[query](spark, SF).collect())
    assert got == want
