"""Check digits and string helpers as Column functions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bound

#: Weights of the published Romanian control digits.
CNP_WEIGHTS = (2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9)
CUI_WEIGHTS = (7, 5, 3, 2, 1, 7, 5, 3, 2)
#: Letters that OCR takes for digits, and the digits.
LOOKALIKES, LOOKALIKE_DIGITS = "OoQDIlZzASGTBbgq", "0000112245678899"


def digits_only(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def unconfuse(s: Column) -> Column:
    """Look-alike letters as digits; anything else that isn't a digit goes."""
    return digits_only(F.translate(s, LOOKALIKES, LOOKALIKE_DIGITS))


def luhn(s: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", s), F.lit(False))


def _digit(s: Column, i: int) -> Column:
    return F.ascii(F.substring(s, i, 1)) - 48


def _weighted(s: Column, weights) -> Column:
    return sum((_digit(s, i + 1) * w for i, w in enumerate(weights)), F.lit(0))


def iban(s: Column) -> Column:
    """ISO 13616: mod 97 over the rotated text, a character at a time."""
    s = F.upper(s)
    turned = F.concat(F.substr(s, F.lit(5)), F.substring(s, 1, 4))

    def step(acc, c):
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))
    return s.rlike("^[A-Z0-9]{15,34}$") & (F.when(s.rlike("^[A-Z0-9]{15,34}$"), rest) == 1)


def cui(s: Column) -> Column:
    """Romanian tax number: an optional RO, then 2 to 10 digits of which the last is the control."""

    def check(s):
        control = bound(F.lpad(F.substr(s, F.lit(1), F.length(s) - 1), 9, "0"), lambda body: _weighted(body, CUI_WEIGHTS) * 10 % 11)
        return s.rlike("^[0-9]{2,10}$") & (bound(control, lambda c: F.when(c == 10, 0).otherwise(c)) == F.ascii(F.right(s, F.lit(1))) - 48)

    return bound(F.regexp_replace(s, "^(?i:RO)", ""), check)


def cnp(s: Column) -> Column:
    """Romanian personal number: the control digit of 13."""
    control = bound(_weighted(s, CNP_WEIGHTS) % 11, lambda c: F.when(c == 10, 1).otherwise(c))
    return s.rlike("^[0-9]{13}$") & (control == _digit(s, 13))


def cnp_structure(s: Column) -> Column:
    """First digit 1 to 8, month, day of at most 31, county of at most 52."""
    part = lambda at: F.substring(s, at, 2)
    return s.rlike("^[1-8][0-9]{12}$") & part(4).between("01", "12") & part(6).between("01", "31") & part(8).between("01", "52")


def card_brand(s: Column) -> Column:
    """Issuer by the ranges of ISO/IEC 7812."""
    return (
        F.when(s.rlike("^4[0-9]{12,18}$"), "Visa")
        .when(s.rlike("^(?:5[1-5][0-9]{14}|(?:222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12})$"), "Mastercard")
        .when(s.rlike("^3[47][0-9]{13}$"), "American Express")
        .when(s.rlike("^(?:6011[0-9]{12}|65[0-9]{14}|64[4-9][0-9]{13})$"), "Discover")
        .otherwise("Payment card")
    )
