"""Texts built from table keys by one SQL expression that Spark and DuckDB read alike.

Each case plants one kind of sensitive span in a sentence.  `text` builds the
sentence, `hit` the planted span, `at` the number of characters before it,
`ok` says whether it must be found, `label` and `confidence` what it is found
as.  Half of the check digits are right and half are one too high.
"""

from __future__ import annotations

from dataclasses import dataclass

K = "CAST(o_orderkey AS STRING)"
HEX = f"(md5({K}) || md5({K} || 'x') || md5({K} || 'y'))"


@dataclass(frozen=True)
class Case:
    category: str
    before: str
    hit: str
    after: str
    label: str
    severity: str
    confidence: str
    ok: str = "TRUE"

    @property
    def text(self) -> str:
        return f"({self.before} || {self.hit} || {self.after})"


def digit(s: str, i: int) -> str:
    return f"CAST(substr({s}, {i}, 1) AS INT)"


def weighted(s: str, weights) -> str:
    return "(" + " + ".join(f"{w} * {digit(s, i + 1)}" for i, w in enumerate(weights)) + ")"


def luhn_digit(body: str, n: int) -> str:
    """The check digit after n digits."""
    parts = [f"CASE WHEN {2} * {digit(body, i)} > 9 THEN 2 * {digit(body, i)} - 9 ELSE 2 * {digit(body, i)} END" if (n - i) % 2 == 0 else digit(body, i) for i in range(1, n + 1)]
    return f"((10 - ({' + '.join(f'({p})' for p in parts)}) % 10) % 10)"


CARD_BODY = f"('4' || lpad({K}, 14, '7'))"
CARD = f"({CARD_BODY} || CAST(({luhn_digit(CARD_BODY, 15)} + o_orderkey % 2) % 10 AS STRING))"

SPACED_CARD = f"(substr({CARD}, 1, 4) || ' ' || substr({CARD}, 5, 4) || ' ' || substr({CARD}, 9, 4) || ' ' || substr({CARD}, 13, 4))"

CNP_BODY = f"('285061440' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0'))"
CNP_CONTROL = f"(CASE WHEN {weighted(CNP_BODY, (2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9))} % 11 = 10 THEN 1 ELSE {weighted(CNP_BODY, (2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9))} % 11 END)"
CNP = f"({CNP_BODY} || CAST(({CNP_CONTROL} + o_orderkey % 2) % 10 AS STRING))"

CUI_BODY = "lpad(CAST(o_orderkey % 100000000 AS STRING), 8, '1')"
CUI_SUM = weighted(CUI_BODY, (5, 3, 2, 1, 7, 5, 3, 2))
CUI_CONTROL = f"(CASE WHEN {CUI_SUM} * 10 % 11 = 10 THEN 0 ELSE {CUI_SUM} * 10 % 11 END)"
CUI = f"({CUI_BODY} || CAST(({CUI_CONTROL} + o_orderkey % 2) % 10 AS STRING))"

# an IBAN of DE and 18 digits: mod 97 of digits || 131400 in two steps that fit a long
IBAN_BODY = f"lpad({K}, 18, '3')"
IBAN_HIGH = f"(CAST(substr({IBAN_BODY}, 1, 9) AS BIGINT) % 97)"
IBAN_LOW = f"(({IBAN_HIGH} * 1000000000 + CAST(substr({IBAN_BODY}, 10, 9) AS BIGINT)) % 97)"
IBAN_CHECK = f"(98 - ({IBAN_LOW} * 1000000 + 131400) % 97)"
IBAN = f"('DE' || lpad(CAST({IBAN_CHECK} - o_orderkey % 2 AS STRING), 2, '0') || {IBAN_BODY})"

EVEN = "o_orderkey % 2 = 0"
NUMBER = f"lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '5')"
LETTERS = f"upper(translate(substr({HEX}, 1, 6), '0123456789', 'ghijklmnop'))"

CASES: dict[str, Case] = {
    "github_tokens": Case("api_key", "'use '", f"('ghp_' || substr({HEX}, 1, 36))", "' now'", "GitHub token", "critical", "0.99"),
    "openai_keys": Case("api_key", "'use '", f"('sk-proj-' || substr({HEX}, 1, 30))", "' now'", "OpenAI API key", "critical", "0.9"),
    "aws_keys": Case("api_key", "'use '", f"('AKIA' || upper(substr({HEX}, 1, 16)))", "' now'", "AWS access key ID", "critical", "0.97"),
    "google_keys": Case("api_key", "'use '", f"('AIza' || substr({HEX}, 1, 35))", "' now'", "Google API key", "critical", "0.95"),
    "slack_tokens": Case("api_key", "'use '", f"('xoxb-' || substr({HEX}, 1, 24))", "' now'", "Slack token", "critical", "0.95"),
    "stripe_keys": Case("api_key", "'use '", f"('sk_live_' || substr({HEX}, 1, 24))", "' now'", "Stripe secret key", "critical", "0.97"),
    "sendgrid_keys": Case("api_key", "'use '", f"('SG.' || substr({HEX}, 1, 22) || '.' || substr({HEX}, 23, 43))", "' now'", "SendGrid API key", "critical", "0.97"),
    "private_keys": Case("api_key", f"({K} || ' ')", "'-----BEGIN RSA PRIVATE KEY-----'", "' body'", "Private key block", "critical", "0.99"),
    "json_web_tokens": Case("jwt", "'Bearer '", f"('eyJ' || substr({HEX}, 1, 20) || '.' || substr({HEX}, 21, 30) || '.' || substr({HEX}, 51, 30))", "' end'", "JSON Web Token", "high", "0.92"),
    "payment_cards": Case("credit_card", "'card '", CARD, "' end'", "Visa", "critical", "0.97", EVEN),
    "ibans": Case("iban", "'pay '", IBAN, "', please'", "IBAN", "high", "0.98", EVEN),
    "bank_codes": Case("bic", "'SWIFT: '", f"({LETTERS} || '22')", "' end'", "SWIFT/BIC", "high", "0.9"),
    "security_codes": Case("cvv", "'CVC '", "lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0')", "' end'", "Card security code", "high", "0.85"),
    "personal_numbers": Case("national_id", "'no '", CNP, "' end'", "CNP (RO)", "high", "CASE WHEN o_orderkey % 2 = 0 THEN 0.95 ELSE 0.8 END"),
    "labelled_numbers": Case("national_id", "'CNP: '", CNP, "'.'", "CNP (RO)", "high", "CASE WHEN o_orderkey % 2 = 0 THEN 0.97 ELSE 0.85 END"),
    "split_numbers": Case("national_id", "'no '", f"(substr({CNP}, 1, 7) || ' ' || substr({CNP}, 8, 6))", "' end'", "CNP (RO)", "high", "CASE WHEN o_orderkey % 2 = 0 THEN 0.9 ELSE 0.8 END"),
    "misread_numbers": Case("national_id", "'no '", f"(translate(substr({CNP}, 1, 6), '0158', 'OISB') || substr({CNP}, 7, 7))", "' end'", "CNP (RO)", "high", "CASE WHEN o_orderkey % 2 = 0 THEN 0.95 ELSE 0.8 END"),
    "tax_numbers": Case("tax_id", "'CUI '", CUI, "' end'", "Tax ID (RO)", "high", "0.95", EVEN),
    "machine_zones": Case("mrz", "'zone '", f"('IDROU' || {LETTERS} || '<<' || {LETTERS} || '<<<<')", "' end'", "ID machine-readable zone", "critical", "0.96"),
    "id_cards": Case("id_document", "'act '", f"('seria XR nr. ' || {NUMBER})", "' end'", "ID card number (RO)", "high", "0.9"),
    "names": Case("name", "'Nume: '", LETTERS, "' end'", "Name", "high", "0.6"),
    "emails": Case("email", "'mail '", f"('u' || {K} || '@mail.example.org')", "' end'", "Email address", "medium", "0.9"),
    "international_phones": Case("phone", "'call '", f"('+40 721 ' || {NUMBER})", "' end'", "Phone number", "medium", "0.9"),
    "national_phones": Case("phone", "'call '", f"('0721-' || {NUMBER})", "' end'", "Phone number", "medium", "0.9"),
}


def oracle(case: Case) -> str:
    """The planted spans, by arithmetic alone."""
    return (
        f"SELECT o_orderkey, '{case.category}' AS category, '{case.label}' AS label, '{case.severity}' AS severity, CAST(length({case.before}) AS INT) AS \"start\", "
        f"CAST(length({case.before}) + length({case.hit}) AS INT) AS \"end\", {case.hit} AS text, CAST({case.confidence} AS DOUBLE) AS confidence, TRUE AS redact_by_default "
        f"FROM orders WHERE {case.ok}"
    )
