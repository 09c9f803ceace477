"""DuckDB building blocks for span queries.

RE2 has no lookaround, so shapes are matched with ``\\b`` where that is the same
and checked against the neighbouring characters afterwards.
"""

from __future__ import annotations

from spanveil.functions import secrets as sec
from spanveil.functions.text import B0, B1, WB

# Fixed values, written out a second time: a slip on either side shows as a difference.
WS_SET = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = f"[{WS_SET}]"
DASH_SET = (
    r"\x{2D}\x{58A}\x{5BE}\x{1400}\x{1806}\x{2010}-\x{2015}\x{2212}\x{2E17}\x{2E1A}\x{2E3A}\x{2E3B}\x{2E40}"
    r"\x{301C}\x{3030}\x{30A0}\x{FE31}\x{FE32}\x{FE58}\x{FE63}\x{FF0D}"
)
DASH, SEP = f"[{DASH_SET}]", f"[{WS_SET}{DASH_SET}]"
DEA_REGISTRANTS, PAN_HOLDER_TYPES = "ABCDEFGHJKLMPRSTUX", "PCHABGJLFT"
PLACEHOLDER_PREFIX = "(?i)^(?:example|sample|test|changeme|your_|xxxx|sk_test_[0-9a-z]{6}|ghp_TEST)"
ENVIRONMENT_REFERENCE = r"^(?:process\.env\.|os\.environ|ENV\[|env:|\$\{?[A-Z][A-Z0-9_]*\}?$)"
LOCAL_HOST = r"(?i)\b(?:localhost|127\.0\.0\.1|0\.0\.0\.0|example\.(?:com|test|org)|host\.docker\.internal)\b"
DEFAULT_LOGIN = "(?i)[:@](?:example|sample|test|changeme|password|root|admin|postgres|redis|mongo)?[:@]?"
NON_PROVIDER_LABEL = (
    rf"(?i)\b(?:asset{WS}*tag|serial(?:{WS}+number)?|tracking(?:{WS}+number)?|batch(?:{WS}+(?:id|number))?"
    rf"|reference(?:{WS}+number)?|order{WS}+number|invoice(?:{WS}+number)?|part{WS}+number|sku|upc|barcode|internal{WS}+id)\b"
)


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    return pattern.replace(WB, r"\b").replace(B0, r"\b").replace(B1, r"\b")


def hits(corpus: str, pattern: str, group: int = 0) -> str:
    """SELECT src, id, text, v, s: each match and its 0-based offset."""
    p = q(pattern)
    return f"""
SELECT src, id, text, m[i] AS v, CAST(
    list_sum(list_transform(g[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT src, id, text, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g
  FROM ({corpus}) WHERE regexp_matches(text, {p})))"""


def before(n: int) -> str:
    return f"substr(text, greatest(s - {n}, 0) + 1, least({n}, s))"


LEFT = "(CASE WHEN s = 0 THEN '' ELSE substr(text, s, 1) END)"
RIGHT = "substr(text, s + length(v) + 1, 1)"
LOOSE = f"NOT regexp_matches({LEFT}, '[0-9A-Za-z]') AND NOT regexp_matches({RIGHT}, '[0-9A-Za-z]')"
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"


def wsum(d: str, weights: list[int]) -> str:
    return (
        f"list_sum(list_transform(range(1, {len(weights) + 1}), "
        f"lambda k: (ascii(substr({d}, k, 1)) - 48) * list_extract({weights}, k)))"
    )


def luhn_sum(d: str, doubled: int = 1) -> str:
    """``doubled`` is the parity, counted from the right end, of doubled digits."""
    return (
        f"list_sum(list_transform(range(0, length({d})), lambda k: "
        f"CASE WHEN k % 2 = {doubled} THEN "
        f"((ascii(substr({d}, length({d}) - k, 1)) - 48) * 2) // 10 "
        f"+ ((ascii(substr({d}, length({d}) - k, 1)) - 48) * 2) % 10 "
        f"ELSE ascii(substr({d}, length({d}) - k, 1)) - 48 END))"
    )


def alnum_value(c: str) -> str:
    return f"(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#', {c}) - 1)"


def valid(kind: str, v: str = "v") -> str:
    """Validity of column ``v`` as a Boolean SQL expression."""
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    up = f"upper(trim({v}))"
    compact = f"regexp_replace({v}, '[\\s-]', '', 'g')"
    if kind == "ssn":
        return (
            f"(regexp_matches({d}, '^[0-8][0-9]{{8}}$') AND substr({d},1,3) NOT IN ('000','666') "
            f"AND substr({d},4,2) <> '00' AND substr({d},6,4) <> '0000')"
        )
    if kind == "itin":
        return (
            f"regexp_matches({d}, '^9[0-9]{{2}}(5[0-9]|6[0-5]|7[0-9]|8[0-8]|9[0-2]|9[4-9])"
            f"(000[1-9]|00[1-9][0-9]|0[1-9][0-9]{{2}}|[1-9][0-9]{{3}})$')"
        )
    if kind == "luhn":
        return f"(length({d}) BETWEEN 13 AND 19 AND {luhn_sum(d)} % 10 = 0)"
    if kind == "npi":
        d80 = f"('80840' || {d})"
        return f"(length({d}) = 10 AND {luhn_sum(d80)} % 10 = 0)"
    if kind == "dea":
        return (
            f"(CASE WHEN regexp_matches({compact}, '^[{DEA_REGISTRANTS}][A-Z][0-9]{{7}}$') THEN "
            f"{wsum(f'substr({compact}, 3)', [1, 2, 1, 2, 1, 2])} % 10 = "
            f"CAST(right({compact}, 1) AS INT) ELSE FALSE END)"
        )
    if kind == "mbi":
        a, n = "[A-HJKMNP-RT-Y]", "[0-9A-HJKMNP-RT-Y]"
        return (
            f"(regexp_matches({compact}, '^[0-9]{a}{n}[0-9]{a}{n}[0-9]{a}{a}[0-9][0-9]$') "
            f"AND NOT contains({compact}, 'B'))"
        )
    if kind == "cusip":
        terms = " + ".join(
            f"(({alnum_value(f'substr({up},{i},1)')} * {2 - i % 2}) // 10 + "
            f"({alnum_value(f'substr({up},{i},1)')} * {2 - i % 2}) % 10)"
            for i in range(1, 9)
        )
        return (
            f"(CASE WHEN regexp_matches({up}, '^[0-9A-Z*@#]{{8}}[0-9]$') THEN "
            f"(10 - ({terms}) % 10) % 10 = CAST(right({up}, 1) AS INT) ELSE FALSE END)"
        )
    if kind == "isin":
        expanded = (
            f"list_aggregate(list_transform(range(1, 12), lambda j: "
            f"CAST({alnum_value(f'substr({up}, j, 1)')} AS VARCHAR)), 'string_agg', '')"
        )
        return (
            f"(CASE WHEN regexp_matches({up}, '^[A-Z]{{2}}[0-9A-Z]{{9}}[0-9]$') THEN "
            f"(10 - {luhn_sum(expanded, 0)} % 10) % 10 = CAST(right({up}, 1) AS INT) ELSE FALSE END)"
        )
    if kind == "sedol":
        terms = " + ".join(
            f"{alnum_value(f'substr({up},{i + 1},1)')} * {w}" for i, w in enumerate([1, 3, 1, 7, 3, 9])
        )
        return (
            f"(CASE WHEN regexp_matches({up}, '^[0-9B-DF-HJ-NP-TV-Z]{{6}}[0-9]$') THEN "
            f"(10 - ({terms}) % 10) % 10 = CAST(right({up}, 1) AS INT) ELSE FALSE END)"
        )
    if kind == "loinc":
        body = f"split_part(trim({v}), '-', 1)"
        return (
            f"(CASE WHEN regexp_matches(trim({v}), '^[0-9]{{3,5}}-[0-9]$') THEN "
            f"(10 - {luhn_sum(body, 0)} % 10) % 10 = CAST(right(trim({v}), 1) AS INT) ELSE FALSE END)"
        )
    if kind == "canadian_sin":
        return f"(regexp_matches({d}, '^[1-79][0-9]{{8}}$') AND {luhn_sum(d)} % 10 = 0)"
    if kind == "aadhaar":
        # the dihedral group of a pentagon, and the powers of one permutation
        turn = lambda i, j: (i + j if j < 5 else i + j - 5) if i < 5 else (i - 5 - j if j < 5 else i - j)
        table = [turn(i, j) % 5 + (5 if (i < 5) != (j < 5) else 0) for i in range(10) for j in range(10)]
        perm, row = [], list(range(10))
        for _ in range(8):
            perm += row
            row = [[1, 5, 7, 6, 2, 8, 3, 0, 9, 4][x] for x in row]
        acc = "0"
        for i in range(12):
            p = f"list_extract({perm}, {(i % 8) * 10} + ascii(substr({d}, {12 - i}, 1)) - 47)"
            acc = f"list_extract({table}, {acc} * 10 + {p} + 1)"
        return f"(CASE WHEN regexp_matches({d}, '^[2-9][0-9]{{11}}$') THEN {acc} = 0 ELSE FALSE END)"
    if kind == "pan_india":
        return (
            f"regexp_matches({up}, '^[A-Z]{{3}}[{PAN_HOLDER_TYPES}][A-Z][0-9]{{4}}[A-Z]$')"
        )
    if kind == "nhs":
        c = f"((11 - {wsum(d, [10, 9, 8, 7, 6, 5, 4, 3, 2])} % 11) % 11)"
        return f"(length({d}) = 10 AND {c} <> 10 AND {c} = ascii(right({d}, 1)) - 48)"
    if kind == "australian_tfn":
        return (
            f"(CASE length({d}) WHEN 9 THEN {wsum(d, [1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0 "
            f"WHEN 8 THEN {wsum(d, [4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0 ELSE FALSE END)"
        )
    if kind == "cpf":
        one = f"(({wsum(d, [10, 9, 8, 7, 6, 5, 4, 3, 2])} * 10) % 11 % 10)"
        two = f"(({wsum(d, [11, 10, 9, 8, 7, 6, 5, 4, 3, 2])} * 10) % 11 % 10)"
        return (
            f"(length({d}) = 11 AND {d} <> repeat(substr({d}, 1, 1), 11) "
            f"AND {one} = ascii(substr({d}, 10, 1)) - 48 AND {two} = ascii(substr({d}, 11, 1)) - 48)"
        )
    raise KeyError(kind)


OUT = "src, id, s AS start_pos, s + length(v) AS end_pos"


def shape(corpus: str, pattern: str, where: str, confidence: str) -> str:
    return (
        f"SELECT {OUT}, CAST({confidence} AS DOUBLE) AS confidence, v AS value "
        f"FROM ({hits(corpus, pattern)}) WHERE {where}"
    )


def near(cue: str, n: int = 40) -> str:
    return f"regexp_matches({before(n)}, {q(re2(cue))})"


def cued_pair(corpus, kind, cue, formatted, bare, without) -> str:
    return (
        shape(corpus, formatted, valid(kind), f"CASE WHEN {near(cue)} THEN 0.95 ELSE {without} END")
        + " UNION ALL "
        + shape(corpus, bare, f"{valid(kind)} AND {near(cue)}", "0.85")
    )


def labelled(corpus: str, label: str, strong: float, weak: float) -> str:
    ident = "regexp_extract(rest, '[A-Za-z0-9][A-Za-z0-9_-]{2,20}')"
    return f"""
SELECT src, id, e + strpos(rest, ident) - 1 AS start_pos,
       e + strpos(rest, ident) - 1 + length(ident) AS end_pos,
       CAST(CASE WHEN regexp_matches(v, '[:#]') THEN {strong} ELSE {weak} END AS DOUBLE) AS confidence,
       ident AS value
FROM (SELECT *, {ident} AS ident FROM (
  SELECT *, s + length(v) AS e, substr(text, s + length(v) + 1, 40) AS rest
  FROM ({hits(corpus, label)})))
WHERE regexp_matches(ident, '[0-9]') AND NOT regexp_matches(ident, '^[0-9]{{13,}}$')"""


def after_label(corpus, label, run, kind, confidence) -> str:
    return f"""
SELECT src, id, e + length(string_split_regex(rest, {q(run)})[1]) AS start_pos,
       e + length(string_split_regex(rest, {q(run)})[1]) + length(v) AS end_pos,
       CAST({confidence} AS DOUBLE) AS confidence, v AS value
FROM (SELECT src, id, e, rest, regexp_extract(rest, {q(run)}) AS v FROM (
  SELECT *, s + length(v) AS e, substr(text, s + length(v) + 1, 24) AS rest
  FROM ({hits(corpus, label)})))
WHERE v <> '' AND {valid(kind)}"""


def secrets(corpus: str) -> str:
    arms = []
    for rank, f in enumerate(sec.SECRET_FORMATS):
        pattern, shift = re2(f.pattern), "0"
        value = "v"
        if f.name == "Bearer token":
            pattern = pattern.replace(f"(?<=Bearer{WS})", f"Bearer{WS}")
            value, shift = "substr(v, 8)", "7"
        elif f.group:
            value = f"regexp_extract(v, {q(pattern)}, 1)"
            shift = f"strpos(v, {value}) - 1"
        keep = "TRUE"
        if f.confidence <= 0.80:
            keep = (
                f"NOT (regexp_matches(value, {q(PLACEHOLDER_PREFIX)}) "
                f"OR regexp_matches(value, {q(ENVIRONMENT_REFERENCE)}) "
                f"OR (regexp_matches(value, {q(re2(LOCAL_HOST))}) "
                f"AND regexp_matches(value, {q(DEFAULT_LOGIN)})))"
            )
        arms.append(
            f"SELECT * FROM (SELECT src, id, s + {shift} AS start_pos, {value} AS value, "
            f"{rank} AS rank, {f.confidence} AS confidence FROM ({hits(corpus, pattern)})) WHERE {keep}"
        )
    return (
        "SELECT src, id, start_pos, start_pos + length(value) AS end_pos, "
        "CAST(confidence AS DOUBLE) AS confidence, value FROM ("
        + " UNION ALL ".join(arms)
        + ") QUALIFY row_number() OVER (PARTITION BY src, id, start_pos ORDER BY rank) = 1"
    )


def address(corpus: str, street: str, tail: str) -> str:
    w = tail[0]
    body, zip9, zip5 = tail[1:]
    return f"""
SELECT src, id, s AS start_pos, s + length(value) AS end_pos,
       CAST(CASE WHEN has_zip THEN 0.84 ELSE 0.72 END AS DOUBLE) AS confidence, value
FROM (SELECT *, regexp_matches(tail, '\\b[0-9]{{5}}(?:-[0-9]{{4}})?\\b') AS has_zip,
             regexp_replace(v || tail, {q(f'(?:,|{WS})+$')}, '') AS value
  FROM (SELECT *, t0 || CASE WHEN z9 <> '' THEN z9 ELSE z5 END AS tail FROM (
    SELECT *, regexp_extract(substr(rest, length(t0) + 1), {q(zip9)}, 1) AS z9,
           regexp_extract(substr(rest, length(t0) + 1), {q(zip5)}, 1) AS z5 FROM (
      SELECT *, regexp_extract(rest, {q(body)}) AS t0 FROM (
        SELECT *, substr(text, s + length(v) + 1, 120) AS rest
        FROM ({hits(corpus, street)}) WHERE NOT regexp_matches({LEFT}, '[0-9A-Za-z]'))))))
WHERE has_zip OR regexp_matches(substr(tail, 1, 60), '\\b(?:[A-Z]{{2}}|[A-Z][a-z]+)\\b')"""


def names(corpus: str, label: str) -> str:
    name = r"\b[A-Z][a-zA-Z.'-]*(?:[ \t]+[A-Z][a-zA-Z.'-]*){1,2}\b"
    return f"""
SELECT src, id, e + length(string_split_regex(rest, {q(name)})[1]) AS start_pos,
       e + length(string_split_regex(rest, {q(name)})[1]) + length(v) AS end_pos,
       CAST(0.52 AS DOUBLE) AS confidence, v AS value
FROM (SELECT src, id, e, rest, regexp_extract(rest, {q(name)}) AS v FROM (
  SELECT *, s + length(v) AS e, substr(text, s + length(v) + 1, 60) AS rest
  FROM ({hits(corpus, label)})))
WHERE length(v) >= 3"""


def detector(category: str, corpus: str) -> str:
    """SELECT src, id, start_pos, end_pos, confidence, value for one category."""
    from spanveil.functions import detectors as det

    if category == "email":
        value = "regexp_replace(v, '[.,;:!?()\\[\\]]+$', '')"
        pattern = re2(det.EMAIL).replace(")*+", ")*")
        return (
            f"SELECT src, id, s AS start_pos, s + length(value) AS end_pos, "
            f"CAST(0.92 AS DOUBLE) AS confidence, value FROM (SELECT *, {value} AS value "
            f"FROM ({hits(corpus, pattern)})) WHERE contains(value, '.') "
            f"AND regexp_matches(value, '[A-Za-z]')"
        )
    if category == "phone":
        pattern = (
            rf"(?:\+?1{SEP}?)?(?:\([2-9][0-8][0-9]\){SEP}?|[2-9][0-8][0-9]{SEP}?)"
            rf"[2-9][0-9]{{2}}{SEP}?[0-9]{{4}}"
        )
        d = f"regexp_replace({DIGITS}, '^1', '')"
        return shape(
            corpus, pattern,
            f"{LOOSE} AND length({d}) = 10 AND substr({d}, 1, 3) <> '900' "
            f"AND substr({d}, 4) <> '5550100'", "0.88",
        )
    if category == "ssn":
        dashed = rf"\b[0-9]{{3}}{DASH}[0-9]{{2}}{DASH}[0-9]{{4}}\b"
        itin = r"\b9[0-9]{2}[- ][0-9]{2}[- ][0-9]{4}\b|\b9[0-9]{8}\b"
        return " UNION ALL ".join([
            shape(corpus, dashed, valid("ssn"), "0.93"),
            shape(corpus, r"\b[0-9]{9}\b", f"{valid('ssn')} AND {near(det.SSN_CUE)}", "0.85"),
            shape(corpus, itin,
                  f"{valid('itin')} AND ({near(det.ITIN_CUE)} OR {near(det.SSN_CUE)})", "0.88"),
        ])
    if category == "canadian_sin":
        return cued_pair(corpus, "canadian_sin", det.SIN_CUE,
                         r"\b[1-79][0-9]{2}[ -][0-9]{3}[ -][0-9]{3}\b", r"\b[1-79][0-9]{8}\b", 0.90)
    if category == "uk_nhs":
        return cued_pair(corpus, "nhs", det.NHS_CUE,
                         r"\b[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}\b", r"\b[0-9]{10}\b", 0.90)
    if category == "aadhaar":
        return cued_pair(corpus, "aadhaar", det.AADHAAR_CUE,
                         r"\b[2-9][0-9]{3}[ -][0-9]{4}[ -][0-9]{4}\b", r"\b[2-9][0-9]{11}\b", 0.92)
    if category == "australian_tfn":
        return cued_pair(corpus, "australian_tfn", det.TFN_CUE,
                         r"\b[0-9]{3}[ -][0-9]{3}[ -][0-9]{2,3}\b", r"\b[0-9]{8,9}\b", 0.88)
    if category == "cpf":
        return cued_pair(corpus, "cpf", det.CPF_CUE,
                         r"\b[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}\b", r"\b[0-9]{11}\b", 0.92)
    if category == "pan_india":
        return shape(corpus, r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", valid("pan_india"),
                     f"CASE WHEN {near(det.PAN_CUE)} THEN 0.95 ELSE 0.90 END")
    if category == "dob":
        return shape(corpus, re2(det.DOB), near(det.DOB_CUE), "0.80")
    if category == "medical_record_number":
        return labelled(corpus, re2(det.MRN_LABEL).split("(?=")[0], 0.82, 0.72)
    if category == "member_id":
        return labelled(corpus, re2(det.MEMBER_LABEL).split("(?=")[0], 0.78, 0.68)
    if category == "npi":
        bound = f"regexp_matches({before(48)}, {q(re2(NON_PROVIDER_LABEL))})"
        shaped = f"regexp_matches({before(40)}, {q(f'{WS}|[().-]')})"
        return (
            after_label(corpus, re2(det.NPI_LABEL).split("(?=")[0], r"\b[0-9]{10}\b", "npi", 0.93)
            + " UNION ALL "
            + shape(corpus, r"\b[0-9]{10}\b",
                    f"{valid('npi')} AND NOT {bound} AND NOT {shaped}", "0.70")
        )
    if category == "dea":
        return shape(corpus, r"\b[A-Z]{2}[0-9]{7}\b", valid("dea"), "0.90")
    if category == "mbi":
        return after_label(corpus, re2(det.MBI_LABEL).split("(?=")[0],
                           r"\b[A-Z0-9]{11}\b|\b[A-Z0-9]{4}-[A-Z0-9]{3}-[A-Z0-9]{4}\b", "mbi", 0.92)
    if category == "payment_card":
        return shape(corpus, re2(det.CARD), valid("luhn"),
                     f"CASE WHEN {near(det.CARD_CUE, 30)} THEN 0.97 ELSE 0.95 END")
    if category == "secrets":
        return secrets(corpus)
    if category == "address":
        b = f"[{WS_SET}]".replace(r"\s\x0B", r" \t\x0B\f\r")
        street = (
            rf"[0-9]{{1,5}}{b}+[A-Za-z][A-Za-z0-9.'-]*(?:{b}+[A-Za-z0-9.'-]+)*{b}+"
            rf"(?:{det.STREET_SUFFIXES})(?:\.)?\b"
        )
        body = (
            rf"^(?:,{b}+(?:Apt|Unit|Suite|#|Ste)\.?{b}*[0-9]+[A-Za-z]?)?"
            rf"(?:,{b}+[A-Z][a-zA-Z.'-]*(?:{b}+[A-Z][a-zA-Z.'-]*)*)?(?:,{b}+[A-Z]{{2}}(?:\.{b}+)?)?"
        )
        zip9 = rf"^({b}+[0-9]{{5}}-[0-9]{{4}})(?:[^0-9]|$)"
        zip5 = rf"^({b}+[0-9]{{5}})(?:[^0-9]|$)"
        return address(corpus, street, (b, body, zip9, zip5))
    if category == "possible_name":
        words = det._NAME_WORDS
        label = (
            rf"(?im)(?:^\b{words}\s*[:.]?\s*|\b{words}\s*[:.]\s*)"
        ).replace(r"\s", WS)
        return names(corpus, label)
    raise KeyError(category)


def resolved(raw: str) -> str:
    """One winner per chain of overlaps, by gaps and islands."""
    from spanveil.constants import CATEGORY_PRIORITY

    return f"""
SELECT src, id, category, start_pos, end_pos, confidence, value FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY src, id ORDER BY start_pos, end_pos, category, confidence
                             ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN start_pos >= coalesce(max(end_pos) OVER (
        PARTITION BY src, id ORDER BY start_pos, end_pos, category, confidence
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh
    FROM ({raw})))
QUALIFY row_number() OVER (PARTITION BY src, id, island ORDER BY
  list_position({CATEGORY_PRIORITY}, category), start_pos - end_pos, confidence DESC,
  start_pos, value) = 1"""


def raw_all(corpus: str) -> str:
    from spanveil.constants import DEFAULT_CATEGORIES

    return " UNION ALL ".join(
        f"SELECT src, id, '{c}' AS category, start_pos, end_pos, confidence, value FROM ({detector(c, corpus)})"
        for c in DEFAULT_CATEGORIES
    )


def stars(v: str) -> str:
    return f"regexp_replace({v}, '[^\\n\\r]', '*', 'g')"


def mask_value(c: str = "category", v: str = "value") -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"

    def tail(digits, n, prefix):
        return f"CASE WHEN length({digits}) < {n} THEN {stars(v)} ELSE '{prefix}' || right({digits}, {n}) END"

    pan = f"upper(regexp_replace({v}, '[\\s-]', '', 'g'))"
    d1 = f"regexp_replace({d}, '^1', '')"
    return f"""(CASE {c}
 WHEN 'email' THEN CASE WHEN strpos({v}, '@') <= 1 THEN {stars(v)}
   ELSE substr({v}, 1, 1) || '***@' || substr({v}, strpos({v}, '@') + 1) END
 WHEN 'phone' THEN {tail(d1, 4, '***-***-')}
 WHEN 'ssn' THEN {tail(d, 4, '***-**-')}
 WHEN 'canadian_sin' THEN {tail(d, 3, '***-***-')}
 WHEN 'australian_tfn' THEN {tail(d, 3, '***-***-')}
 WHEN 'uk_nhs' THEN {tail(d, 4, '***-***-')}
 WHEN 'aadhaar' THEN {tail(d, 4, '****-****-')}
 WHEN 'pan_india' THEN CASE WHEN length({pan}) < 5 THEN {stars(v)} ELSE '*****' || substr({pan}, 6) END
 WHEN 'cpf' THEN {tail(d, 2, '***.***.***-')}
 WHEN 'payment_card' THEN {tail(d, 4, '*' * 12)}
 WHEN 'npi' THEN {tail(d, 4, '******-')}
 WHEN 'dea' THEN '*********'
 WHEN 'mbi' THEN {tail(d, 4, '*' * 7)}
 WHEN 'dob' THEN '**/**/****'
 WHEN 'secrets' THEN substr({v}, 1, 1) || '***'
 WHEN 'possible_name' THEN '********'
 ELSE regexp_replace({v}, '{"[^" + WS_SET + "]"}', '*', 'g') END)"""


def mask_context(x: str) -> str:
    not_ws = q("[^" + WS_SET + "]+")
    return (
        f"regexp_replace(regexp_replace(regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g'), "
        f"{not_ws}, '*', 'g'), {q(WS + '+')}, ' ', 'g')"
    )


def redacted(corpus: str, spans: str, repl: str) -> str:
    """SELECT src, id, redacted: gaps and replacements stitched in order."""
    return f"""
SELECT c.src, c.id, coalesce(string_agg(substr(c.text, p.prev_end + 1, p.start_pos - p.prev_end)
         || {repl}, '' ORDER BY p.start_pos), '')
       || substr(any_value(c.text), coalesce(max(p.end_pos), 0) + 1) AS redacted
FROM ({corpus}) c LEFT JOIN (
  SELECT *, coalesce(lag(end_pos) OVER (PARTITION BY src, id ORDER BY start_pos), 0) AS prev_end
  FROM ({spans})) p ON c.src = p.src AND c.id = p.id
GROUP BY c.src, c.id"""
