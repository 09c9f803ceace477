"""Identifier validity rules as Boolean column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.text import B0, B1, WS, digits_of, let, trim_ws

# Verhoeff dihedral multiplication and permutation tables.
VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]
# First letters of valid DEA registrant codes, fourth letters of PAN.
DEA_REGISTRANTS = "ABCDEFGHJKLMPRSTUX"
PAN_HOLDER_TYPES = "PCHABGJLFT"
# Label families that bind a number to something not a provider.
NON_PROVIDER_LABEL = (
    r"(?i)" + B0 + r"(?:asset\s*tag|serial(?:\s+number)?|tracking(?:\s+number)?"
    r"|batch(?:\s+(?:id|number))?|reference(?:\s+number)?|order\s+number"
    r"|invoice(?:\s+number)?|part\s+number|sku|upc|barcode|internal\s+id)" + B1
).replace(r"\s", WS)


def digit(s: Column, i: int) -> Column:
    """Digit at 1-based position i; never raises, whatever the character."""
    return F.ascii(F.substring(s, i, 1)) - 48


def weighted(s: Column, weights: list[int]) -> Column:
    return reduce(lambda a, b: a + b, [digit(s, i + 1) * w for i, w in enumerate(weights)])


def _safe(condition: Column, verdict: Column) -> Column:
    return F.when(condition, verdict).otherwise(F.lit(False))


def _of_digits(rule: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The rule over the digits of a value, which are taken out once."""

    @wraps(rule)
    def over(value: Column) -> Column:
        return let(digits_of(value), rule)

    return over


def luhn_sum(s: Column, double_first_from_right: bool = False) -> Column:
    """Luhn sum of a digit string of any length."""
    n = F.length(s)
    parity = 0 if double_first_from_right else 1

    def add(acc: Column, i: Column) -> Column:
        d = F.ascii(s.substr(i, F.lit(1))) - 48
        doubled = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when((n - i) % 2 == parity, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def is_luhn(digits: Column) -> Column:
    return _safe(
        digits.rlike("^[0-9]{13,19}$"), let(digits, lambda d: luhn_sum(d) % 10 == 0)
    )


def valid_luhn(value: Column) -> Column:
    return let(digits_of(value), is_luhn)


def valid_npi(value: Column) -> Column:
    return let(digits_of(value), lambda d: _safe(F.length(d) == 10, is_luhn(F.concat(F.lit("80840"), d))))


@_of_digits
def valid_ssn(d: Column) -> Column:
    area, group, serial = d.substr(1, 3), d.substr(4, 2), d.substr(6, 4)
    return (
        (F.length(d) == 9)
        & ~area.isin("000", "666")
        & (area <= "899")
        & (group != "00")
        & (serial != "0000")
    )


@_of_digits
def valid_itin(d: Column) -> Column:
    group = d.substr(4, 2)
    in_range = (
        group.between("50", "65")
        | group.between("70", "88")
        | group.between("90", "92")
        | group.between("94", "99")
    )
    return (F.length(d) == 9) & d.startswith("9") & in_range & (d.substr(6, 4) != "0000")


def valid_card_expiry(value: Column, today: Column) -> Column:
    """``MM/YY`` or ``MM/YYYY``, not past and at most 15 years ahead of ``today``."""
    parts = F.split(value, "/")
    month = F.get(parts, F.lit(0)).try_cast("int")
    raw = F.get(parts, F.lit(1))
    year = raw.try_cast("int") + F.when(F.length(raw) == 2, 2000).otherwise(0)
    now = F.year(today)
    return F.coalesce(month.between(1, 12) & year.between(now, now + 15), F.lit(False))


def valid_dea(value: Column) -> Column:
    s = F.regexp_replace(value, f"(?:{WS}|-)", "")
    odd = digit(s, 3) + digit(s, 5) + digit(s, 7)
    even = digit(s, 4) + digit(s, 6) + digit(s, 8)
    return s.rlike(f"^[{DEA_REGISTRANTS}][A-Z][0-9]{{7}}$") & (
        (odd + even * 2) % 10 == digit(s, 9)
    )


def valid_mbi(value: Column) -> Column:
    s = F.regexp_replace(value, f"(?:{WS}|-)", "")
    letter, alnum = "[AC-HJKMNP-RT-Y]", "[0-9AC-HJKMNP-RT-Y]"
    return s.rlike(
        f"^[0-9]{letter}{alnum}[0-9]{letter}{alnum}[0-9]{letter}{letter}[0-9]{{2}}$"
    )


def non_provider_bound(preceding: Column) -> Column:
    return F.right(preceding, F.lit(48)).rlike(NON_PROVIDER_LABEL)


def _alnum(s: Column, i: int) -> Column:
    """0-9 -> 0-9, A-Z -> 10-35, and the three CUSIP symbols * @ #."""
    c = F.substring(s, i, 1)
    return (
        F.when(c == "*", 36).when(c == "@", 37).when(c == "#", 38)
        .when(c.between("0", "9"), F.ascii(c) - 48)
        .otherwise(F.ascii(c) - 55)
    )


def valid_cusip(value: Column) -> Column:
    s = F.upper(trim_ws(value))

    def part(i: int) -> Column:
        product = _alnum(s, i) * (1 if i % 2 else 2)
        return F.floor(product / 10).cast("int") + product % 10

    total = reduce(lambda a, b: a + b, [part(i) for i in range(1, 9)])
    return s.rlike("^[0-9A-Z*@#]{8}[0-9]$") & ((10 - total % 10) % 10 == digit(s, 9))


def valid_isin(value: Column) -> Column:
    s = F.upper(trim_ws(value))
    chars = F.filter(F.split(s.substr(1, 11), ""), lambda c: c != "")
    expanded = F.array_join(
        F.transform(
            chars,
            lambda c: F.when(c.between("0", "9"), c).otherwise(
                (F.ascii(c) - 55).cast("string")
            ),
        ),
        "",
    )
    return _safe(
        s.rlike("^[A-Z]{2}[0-9A-Z]{9}[0-9]$"),
        let(expanded, lambda e: (10 - luhn_sum(e, True) % 10) % 10) == digit(s, 12),
    )


def valid_sedol(value: Column) -> Column:
    s = F.upper(trim_ws(value))
    total = reduce(
        lambda a, b: a + b, [_alnum(s, i + 1) * w for i, w in enumerate([1, 3, 1, 7, 3, 9])]
    )
    return s.rlike("^[0-9B-DF-HJ-NP-TV-Z]{6}[0-9]$") & ((10 - total % 10) % 10 == digit(s, 7))


def valid_loinc(value: Column) -> Column:
    s = trim_ws(value)
    body = F.regexp_extract(s, "^([0-9]{3,5})-([0-9])$", 1)
    check = F.right(s, F.lit(1))
    return _safe(
        s.rlike("^[0-9]{3,5}-[0-9]$"),
        let(body, lambda b: (10 - luhn_sum(b, True) % 10) % 10) == F.ascii(check) - 48,
    )


@_of_digits
def valid_canadian_sin(d: Column) -> Column:
    return _safe(d.rlike("^[1-79][0-9]{8}$"), luhn_sum(d) % 10 == 0)


@_of_digits
def valid_aadhaar(d: Column) -> Column:
    table = F.lit([v for row in VERHOEFF_D for v in row])
    permute = F.lit([v for row in VERHOEFF_P for v in row])

    def step(acc: Column, i: Column, s: Column) -> Column:
        v = F.ascii(s.substr(F.lit(13) - i, F.lit(1))) - 48
        p = F.get(permute, ((i - 1) % 8) * 10 + v)
        return F.get(table, acc * 10 + p)

    return _safe(
        d.rlike("^[2-9][0-9]{11}$"),
        let(
            d,
            lambda s: F.aggregate(
                F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, i: step(a, i, s)
            )
            == 0,
        ),
    )


def valid_pan_india(value: Column) -> Column:
    return F.upper(trim_ws(value)).rlike(f"^[A-Z]{{3}}[{PAN_HOLDER_TYPES}][A-Z][0-9]{{4}}[A-Z]$")


@_of_digits
def valid_nhs(d: Column) -> Column:
    check = (11 - weighted(d, [10, 9, 8, 7, 6, 5, 4, 3, 2]) % 11) % 11
    return (F.length(d) == 10) & (check != 10) & (check == digit(d, 10))


@_of_digits
def valid_australian_tfn(d: Column) -> Column:
    return (
        F.when(F.length(d) == 9, weighted(d, [1, 4, 3, 7, 5, 8, 6, 9, 10]) % 11 == 0)
        .when(F.length(d) == 8, weighted(d, [4, 3, 7, 5, 8, 6, 9, 10]) % 11 == 0)
        .otherwise(F.lit(False))
    )


@_of_digits
def valid_cpf(d: Column) -> Column:
    first = (weighted(d, list(range(10, 1, -1))) * 10) % 11 % 10
    second = (weighted(d, list(range(11, 1, -1))) * 10) % 11 % 10
    return (
        d.rlike("^[0-9]{11}$")
        & ~d.rlike(r"^([0-9])\1{10}$")
        & (first == digit(d, 10))
        & (second == digit(d, 11))
    )


VALIDATORS = {
    "ssn": valid_ssn,
    "itin": valid_itin,
    "dea": valid_dea,
    "mbi": valid_mbi,
    "luhn": valid_luhn,
    "npi": valid_npi,
    "cusip": valid_cusip,
    "isin": valid_isin,
    "sedol": valid_sedol,
    "loinc": valid_loinc,
    "canadian_sin": valid_canadian_sin,
    "aadhaar": valid_aadhaar,
    "pan_india": valid_pan_india,
    "nhs": valid_nhs,
    "australian_tfn": valid_australian_tfn,
    "cpf": valid_cpf,
}
