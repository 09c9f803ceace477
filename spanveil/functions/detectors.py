"""Category detectors: text column in, array of spans out.

Each detector is a pattern, a validity rule and a cue rule over the fold of
``match_spans``.  ``FAMILIES`` groups detectors behind one cheap probe, so a text
that cannot hold any member pays for the probe only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.constants import DEFAULT_CATEGORIES
from spanveil.functions import checksums as ck
from spanveil.functions.overlaps import resolve_overlaps
from spanveil.functions.secrets import SECRET_FORMATS, SecretFormat, is_placeholder, secret_pattern, secret_probe
from spanveil.functions.text import (
    B0, B1, DASH, NO_ALNUM_AFTER, NO_ALNUM_BEFORE, NOT_WS, SEP, WB, WS, WS_SET,
    Match, ahead, all_of, cut, digits_of, let, mark_of, matcher, no_spans, places_of, span,
)

CUE_WINDOW = 40
CARD_CUE_WINDOW = 30
#: What every number written in one run begins with.
_RUN = "[0-9]{8}"

# Possessive quantifiers keep Java's matcher iterative on hostile runs; every
# place they are used the part that follows cannot start with the repeated set.
_LOCAL = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
EMAIL = WB + _LOCAL + r"{1,64}(?:\." + _LOCAL + r"{1,63})*+@" + _LABEL + r"(?:\." + _LABEL + r")*+"
PHONE = (
    NO_ALNUM_BEFORE + rf"(?:\+?1{SEP}?)?(?:\([2-9][0-8][0-9]\){SEP}?|[2-9][0-8][0-9]{SEP}?)"
    rf"[2-9][0-9]{{2}}{SEP}?[0-9]{{4}}" + NO_ALNUM_AFTER
)
SSN_DASHED = (
    NO_ALNUM_BEFORE + rf"(?!000|666|9[0-9][0-9])[0-9]{{3}}{DASH}(?!00)[0-9]{{2}}{DASH}"
    r"(?!0000)[0-9]{4}" + NO_ALNUM_AFTER
)
SSN_BARE = B0 + r"(?!000|666|9[0-9][0-9])[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}" + B1
ITIN = f"{B0}9[0-9]{{2}}[- ][0-9]{{2}}[- ][0-9]{{4}}{B1}|{B0}9[0-9]{{8}}{B1}"


def _cue(words: str) -> str:
    return ("(?i)" + B0 + words + B1).replace(r"\s", WS)


# Words that make a nearby number count as an identifier.
SSN_CUE = _cue(r"(?:ssn|social\s+security(?:\s*(?:number|no|#))?)")
ITIN_CUE = _cue(
    r"(?:itin|individual\s+taxpayer(?:\s+identification)?(?:\s*(?:number|no|#))?)"
)
SIN_CUE = _cue(
    r"(?:sin|social\s+insurance(?:\s*(?:number|no|#))?|nas"
    r"|num[éÉe]ro\s+d['’]assurance\s+sociale)"
)
NHS_CUE = _cue(r"(?:nhs(?:\s*(?:number|no|#))?|national\s+health\s+service)")
AADHAAR_CUE = _cue(r"(?:aadhaar|aadhar|uidai)(?:\s*(?:number|no|#))?")
PAN_CUE = _cue(r"(?:pan(?:\s*(?:card|number|no|#))?|permanent\s+account\s+number)")
TFN_CUE = _cue(r"(?:tfn|tax\s+file\s+number)")
CPF_CUE = _cue(r"(?:cpf|cadastro\s+de\s+pessoas?\s+f[íÍi]sicas?)")
DOB_CUE = _cue(r"(?:dob|date\s+of\s+birth|born|birth\s*date|birthday|birthdate)")
CARD_CUE = _cue(r"(?:visa|mastercard|amex|american\s+express|discover|card)")

DOB = (
    f"{B0}(?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12][0-9]|3[01])[/-](?:[0-9]{{4}}|[0-9]{{2}}){B1}"
    f"|{B0}[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{4}}{B1}"
    f"|{B0}(?:19|20)[0-9]{{2}}[/-](?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12][0-9]|3[01]){B1}"
)
CARD = (
    f"{B0}[0-9]{{4}}{SEP}?[0-9]{{4}}{SEP}?[0-9]{{4}}{SEP}?[0-9]{{4}}{B1}"
    f"|{B0}[0-9]{{4}}{SEP}?[0-9]{{6}}{SEP}?[0-9]{{5}}{B1}"
    f"|{B0}[0-9]{{13,19}}{B1}"
)


def _label(words: str) -> str:
    """A label, an optional : or #, and the promise of something after it."""
    return ("(?i)" + B0 + words + r"\s*[:#]?\s*").replace(r"\s", WS) + f"(?={NOT_WS})"


# Labels in front of record, member, provider and Medicare numbers.
MRN_LABEL = _label(
    r"(?:mrn|medical\s+record\s*(?:number|no|#)?|record\s*(?:number|no|#))"
)
MEMBER_LABEL = _label(r"(?:member\s*(?:id|no|number|#)|patient\s*id|memberid)")
NPI_LABEL = _label(
    r"(?:npi|national\s+provider\s+(?:id|number|identifier)|provider\s+(?:npi|number|id))"
)
MBI_LABEL = _label(
    r"(?:mbi|medicare(?:\s+beneficiary)?(?:\s+(?:id|identifier|number))?|hicn)"
)
_NAME_WORDS = r"(?:patient(?:\s+name)?|member(?:\s+name)?|full\s+name|name)"
NAME_LABEL = (
    r"(?i)(?:(?<![^\n])" + _NAME_WORDS + r"\s*[:.]?\s*|" + B0 + _NAME_WORDS + r"\s*[:.]\s*)"
).replace(r"\s", WS) + f"(?={NOT_WS})"
NAME = f"{B0}[A-Z][a-zA-Z.'-]*(?:[ \\t]+[A-Z][a-zA-Z.'-]*){{1,2}}{WB}"
IDENTIFIER = "[A-Za-z0-9][A-Za-z0-9_-]{2,20}"
NPI_RUN = f"{B0}[0-9]{{10}}{B1}"
MBI_RUN = f"{B0}[A-Z0-9]{{11}}{B1}|{B0}[A-Z0-9]{{4}}-[A-Z0-9]{{3}}-[A-Z0-9]{{4}}{B1}"
DEA = f"{B0}[A-Z]{{2}}[0-9]{{7}}{B1}"
PAN = f"{B0}[A-Z]{{5}}[0-9]{{4}}[A-Z]{B1}"

# Street suffixes and the unit words of an address tail.
STREET_SUFFIXES = (
    "St|Street|Ave|Avenue|Rd|Road|Blvd|Boulevard|Dr|Drive|Ln|Lane|Ct|Court|Pl|Place|Way"
    "|Ter|Terrace|Cir|Circle|Pkwy|Parkway"
)
_BLANK_SET = WS_SET.replace(r"\s\x0B", r" \t\x0B\f\r")
# The words between the number and the suffix form one character-class run: any
# text over that set splits into words, so no repeated group is needed and a very
# long line cannot exhaust the matcher's stack.
STREET = (
    NO_ALNUM_BEFORE + rf"[0-9]{{1,5}}[{_BLANK_SET}]+[A-Za-z][A-Za-z0-9.'\-{_BLANK_SET}]*"
    rf"[{_BLANK_SET}]+(?:{STREET_SUFFIXES})(?:\.(?=[A-Za-z0-9_])|{B1})"
)
_W = f"[{_BLANK_SET}]"
#: The blanks as the matcher tests them fastest, and what every street ends with.
_BLANK = f"[[^!-~]&&{_W}]"
_STREET_END = rf"{_BLANK}(?:{STREET_SUFFIXES})(?:\.|{B1})"
ADDRESS_TAIL = (
    rf"^(?:,{_W}+(?:Apt|Unit|Suite|#|Ste)\.?{_W}*[0-9]+[A-Za-z]?)?"
    rf"(?:,{_W}+[A-Z][a-zA-Z.'-]*(?:{_W}+[A-Z][a-zA-Z.'-]*)*)?"
    rf"(?:,{_W}+[A-Z]{{2}}(?:\.{_W}+)?)?"
    rf"(?:{_W}+[0-9]{{5}}(?:-[0-9]{{4}})?(?![0-9]))?"
)


def _hit(m: Match, category: str, confidence) -> Column:
    return span(m.start, m.end, category, confidence, m.value)


def _shared(pattern: str) -> str:
    """Top-level alternatives that all begin with ``B0``, with one test of it for all."""
    head, *more = pattern.split("|" + B0)
    return B0 + "(?:" + "|".join([head.removeprefix(B0), *more]) + ")" if more else pattern


def _any_of(low: Column, stems: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(s) for s in stems])


@dataclass(frozen=True)
class Shape:
    """A pattern of a detector and what its matches become.

    ``gate`` holds for every (text, lower-case text) with a match that counts.  ``emit`` and
    ``derive`` are those of ``match_spans``, as are ``window``, ``rest`` and ``first``.  Of the
    credential formats, those with a ``rank``, the first one owns a start offset.
    """

    category: str
    pattern: str
    emit: Callable[[Match], tuple[Column | None, Column]]
    window: int = 0
    rest: int = 0
    first: str | None = None
    derive: Callable[[Match], Column] | None = None
    gate: Callable[[Column, Column], Column] | None = None
    rank: int = -1


def _stems(stems: list[str]) -> Callable[[Column, Column], Column]:
    return lambda text, low: _any_of(low, stems)


def _cued(pattern: str, valid: Callable, cue: str, category: str, with_cue: float, without_cue: float | None,
          stems: Iterable[str] = (), first: str = "[0-9]") -> Shape:
    """Matches of a shape; a cue nearby is required or only raises confidence.

    ``stems`` are lower-case strings one of which every cue contains.  Where the
    cue is required they let a text without any skip the shape altogether.
    """

    def emit(m: Match):
        near = m.before(CUE_WINDOW).rlike(matcher(cue))
        if without_cue is None:
            return valid(m.value) & near, _hit(m, category, with_cue)
        confidence = F.when(near, F.lit(with_cue)).otherwise(F.lit(without_cue))
        return valid(m.value), _hit(m, category, confidence)

    gate = _stems(list(stems)) if without_cue is None and stems else None
    return Shape(category, _shared(pattern), emit, CUE_WINDOW, first=first, gate=gate)


def _formatted_or_bare(category, valid, cue, stems, formatted, bare, without_cue) -> list[Shape]:
    return [
        _cued(formatted, valid, cue, category, 0.95, without_cue),
        _cued(bare, valid, cue, category, 0.85, None, stems, first=_RUN),
    ]


def _email() -> Shape:
    def emit(m: Match):
        value = m.derived
        return (
            value.contains(".") & value.rlike("[A-Za-z]"),
            span(m.start, m.start + F.length(value), "email", 0.92, value),
        )

    bare = lambda m: F.regexp_replace(m.value, r"[.,;:!?()\[\]]+$", "")
    # what follows a run of the local part is not in its set: no shorter run can match
    pattern = matcher(EMAIL.replace(_LOCAL + "{1,64}", _LOCAL + "{1,64}+(?=[.@])").replace("{1,63})", "{1,63}+)"))
    return Shape("email", pattern, emit, derive=bare, gate=lambda text, low: text.contains("@"))


def _phone() -> Shape:
    def emit(m: Match):
        d = m.derived
        ok = (F.length(d) == 10) & ~d.startswith("900") & (d.substr(4, 7) != "5550100")
        return ok, _hit(m, "phone", 0.88)

    bare = lambda m: F.regexp_replace(digits_of(m.value), "^1", "")
    return Shape("phone", PHONE, emit, first="[+(0-9]", derive=bare)


def _labelled_identifier(label, category, strong, weak, first) -> Shape:
    """First identifier in the 40 characters after a label, if it has a digit."""

    def emit(m: Match):
        ident = m.derived
        start = m.end + F.position(ident, m.rest) - 1
        ok = ident.rlike("[0-9]") & ~ident.rlike("^[0-9]{13,}$")
        confidence = F.when(m.value.rlike("[:#]"), F.lit(strong)).otherwise(F.lit(weak))
        return ok, span(start, start + F.length(ident), category, confidence, ident)

    ident_of = lambda m: F.regexp_extract(m.rest, IDENTIFIER, 0)
    return Shape(category, label, emit, rest=40, first=first, derive=ident_of)


def _after_label(label, run, valid, category, confidence, first) -> Shape:
    """First run of a shape in the 24 characters after a label, if it is valid."""

    def emit(m: Match):
        ident = m.derived
        at = F.length(F.get(F.split(m.rest, run, 2), F.lit(0)))
        start = m.end + at
        return (ident != "") & valid(ident), span(
            start, start + F.length(ident), category, confidence, ident
        )

    return Shape(category, label, emit, rest=24, first=first, derive=lambda m: F.regexp_extract(m.rest, run, 0))


def _npi() -> Shape:
    def emit(m: Match):
        ok = (
            ck.valid_npi(m.value)
            & ~ck.non_provider_bound(m.left)
            & ~m.before(CUE_WINDOW).rlike(f"(?:{WS}|[().-])")
        )
        return ok, _hit(m, "npi", 0.70)

    return Shape("npi", NPI_RUN, emit, window=48, first=_RUN)


def _address() -> Shape:
    def emit(m: Match):
        tail = m.derived
        has_zip = tail.rlike(f"{B0}[0-9]{{5}}(?:-[0-9]{{4}})?{B1}")
        has_word = tail.substr(1, 60).rlike(f"{B0}(?:[A-Z]{{2}}|[A-Z][a-z]+){B1}")
        value = F.regexp_replace(F.concat(m.value, tail), f"(?:,|{WS})+$", "")
        confidence = F.when(has_zip, F.lit(0.84)).otherwise(F.lit(0.72))
        return has_zip | has_word, span(
            m.start, m.start + F.length(value), "address", confidence, value
        )

    tail_of = lambda m: F.regexp_extract(m.rest, ADDRESS_TAIL, 0)
    street = STREET.replace(_W, _BLANK).replace(f"[A-Za-z0-9.'\\-{_BLANK_SET}]", f"[A-Za-z0-9.'\\-{_BLANK}]")
    ends = lambda text, low: F.rlike(text, F.lit(matcher(_STREET_END)))
    return Shape("address", street, emit, rest=120, first=f"[0-9]{{1,5}}{_BLANK}", derive=tail_of, gate=ends)


def _payment_card() -> Shape:
    def emit(m: Match):
        near = m.before(CARD_CUE_WINDOW).rlike(matcher(CARD_CUE))
        confidence = F.when(near, F.lit(0.97)).otherwise(F.lit(0.95))
        return ck.valid_luhn(m.value), _hit(m, "payment_card", confidence)

    return Shape("payment_card", _shared(CARD), emit, window=CARD_CUE_WINDOW, first="[0-9]{4}")


def _possible_name() -> Shape:
    def emit(m: Match):
        name = m.derived
        start = m.end + F.length(F.get(F.split(m.rest, NAME, 2), F.lit(0)))
        return F.length(name) >= 3, span(
            start, start + F.length(name), "possible_name", 0.52, name
        )

    name_of = lambda m: F.regexp_extract(m.rest, NAME, 0)
    return Shape("possible_name", NAME_LABEL, emit, rest=60, first="[PpMmFfNn]", derive=name_of)


def _secret(fmt: SecretFormat, rank: int) -> Shape:
    def emit(m: Match):
        value = m.derived if fmt.group else m.value
        start = m.start + (F.position(value, m.value) - 1 if fmt.group else 0)
        accept = ~is_placeholder(value) if fmt.confidence <= 0.80 else None
        return accept, span(start, start + F.length(value), "secrets", fmt.confidence, value)

    inner = (lambda m: F.regexp_extract(m.value, fmt.pattern, 1)) if fmt.group else None
    return Shape(
        "secrets", secret_pattern(fmt), emit, derive=inner, gate=lambda text, low: secret_probe(text, low, fmt), rank=rank
    )


SHAPES: dict[str, list[Shape]] = {
    "email": [_email()],
    "phone": [_phone()],
    "ssn": [
        Shape("ssn", SSN_DASHED, lambda m: (ck.valid_ssn(m.value), _hit(m, "ssn", 0.93)), first="[0-9]{3}[^0-9]"),
        _cued(SSN_BARE, ck.valid_ssn, SSN_CUE, "ssn", 0.85, None, ["ssn", "social"], first=_RUN),
        _cued(ITIN, ck.valid_itin, f"{ITIN_CUE}|{SSN_CUE}", "ssn", 0.88, None,
              ["ssn", "social", "itin", "individual"], first="9"),
    ],
    "dob": [_cued(DOB, lambda v: F.lit(True), DOB_CUE, "dob", 0.80, None, ["dob", "birth", "born"])],
    "medical_record_number": [_labelled_identifier(MRN_LABEL, "medical_record_number", 0.82, 0.72, "[MmRr]")],
    "member_id": [_labelled_identifier(MEMBER_LABEL, "member_id", 0.78, 0.68, "[MmPp]")],
    "npi": [_after_label(NPI_LABEL, NPI_RUN, ck.valid_npi, "npi", 0.93, "[NnPp]"), _npi()],
    "dea": [Shape("dea", DEA, lambda m: (ck.valid_dea(m.value), _hit(m, "dea", 0.90)), first="[A-Z]")],
    "mbi": [_after_label(MBI_LABEL, MBI_RUN, ck.valid_mbi, "mbi", 0.92, "[MmHh]")],
    "address": [_address()],
    "payment_card": [_payment_card()],
    "secrets": [_secret(f, i) for i, f in enumerate(SECRET_FORMATS)],
    "possible_name": [_possible_name()],
    "canadian_sin": _formatted_or_bare(
        "canadian_sin", ck.valid_canadian_sin, SIN_CUE, ["sin", "insurance", "nas", "assurance"],
        f"{B0}(?!0|8)[0-9]{{3}}[ -][0-9]{{3}}[ -][0-9]{{3}}{B1}",
        f"{B0}(?!0|8)[0-9]{{9}}{B1}", 0.90,
    ),
    "uk_nhs": _formatted_or_bare(
        "uk_nhs", ck.valid_nhs, NHS_CUE, ["nhs", "national"],
        f"{B0}[0-9]{{3}}[ -][0-9]{{3}}[ -][0-9]{{4}}{B1}", f"{B0}[0-9]{{10}}{B1}", 0.90,
    ),
    "aadhaar": _formatted_or_bare(
        "aadhaar", ck.valid_aadhaar, AADHAAR_CUE, ["aadha", "uidai"],
        f"{B0}[2-9][0-9]{{3}}[ -][0-9]{{4}}[ -][0-9]{{4}}{B1}",
        f"{B0}[2-9][0-9]{{11}}{B1}", 0.92,
    ),
    "pan_india": [_cued(PAN, ck.valid_pan_india, PAN_CUE, "pan_india", 0.95, 0.90, first="[A-Z]")],
    "australian_tfn": _formatted_or_bare(
        "australian_tfn", ck.valid_australian_tfn, TFN_CUE, ["tfn", "tax"],
        f"{B0}[0-9]{{3}}[ -][0-9]{{3}}[ -][0-9]{{2,3}}{B1}", f"{B0}[0-9]{{8,9}}{B1}", 0.88,
    ),
    "cpf": _formatted_or_bare(
        "cpf", ck.valid_cpf, CPF_CUE, ["cpf", "cadastro"],
        rf"{B0}[0-9]{{3}}\.[0-9]{{3}}\.[0-9]{{3}}-[0-9]{{2}}{B1}",
        f"{B0}[0-9]{{11}}{B1}", 0.92,
    ),
}


def _detector(shapes: list[Shape]) -> Callable[..., Column]:
    """The shapes of a category alone, over a text."""

    def detect(text: Column, low: Column | None = None) -> Column:
        scan = lambda low: _spans_of_hits(text, _hits(text, low, mark_of(text), shapes), shapes)
        return let(F.lower(text), scan) if low is None else scan(low)

    return detect


DETECTORS: dict[str, Callable[..., Column]] = {c: _detector(shapes) for c, shapes in SHAPES.items()}

#: The matches of one shape in a text: ``shape`` is its place in a list of shapes.
_HITS = "array<struct<shape:int,window:int,rest:int,pieces:array<string>,afters:array<string>>>"
#: From so many characters on, what stands behind many matches is taken in one pass.
_LONG = 4_000


def _hits(text: Column, low: Column, mark: Column, shapes: list[Shape], of: list[Shape] | None = None) -> Column:
    """Gaps and matches of every shape that a text holds, one item a shape.

    No lambda is among these expressions, so that a projection of its own compiles them.
    ``shape`` counts in ``of``.
    """

    def hit(s: Shape) -> Column:
        regex = F.lit(matcher(s.pattern, s.first))
        afters = F.lit(None).cast("array<string>")
        if s.rest:
            afters = F.when(F.length(text) > _LONG, F.regexp_extract_all(text, ahead(regex, s.rest), F.lit(1)))
        item = F.struct(
            F.lit((of or shapes).index(s)).alias("shape"), F.lit(s.window).alias("window"), F.lit(s.rest).alias("rest"),
            cut(text, regex, mark).alias("pieces"), afters.alias("afters"),
        )
        found = F.rlike(text, regex)
        return F.when(found if s.gate is None else s.gate(text, low) & found, F.array(item)).otherwise(_no_hits())

    return all_of([hit(s) for s in shapes])


def _no_hits() -> Column:
    return F.expr(f"cast(array() as {_HITS})")


def _spans_of_hits(text: Column, hits: Column, shapes: list[Shape]) -> Column:
    """Spans of the matches that count.  Matches of all shapes are placed by one expression."""
    wide = any(s.window for s in shapes)
    behind = any(s.rest for s in shapes)

    def places(h: Column) -> Column:
        at = places_of(
            text, h["pieces"], h["window"] if wide else None, h["rest"] if behind else None, h["afters"] if behind else None
        )
        return let(at, lambda ps: F.transform(ps, lambda p: F.struct(h["shape"].alias("shape"), p.alias("p"))))

    def choose(number: Column, made: dict[int, Column], lo: int, hi: int) -> Column | None:
        """``made`` of a shape's number, found by halving."""
        inside = [k for k in made if lo <= k < hi]
        if not inside:
            return None
        if hi - lo == 1:
            return made[lo]
        half = (lo + hi) // 2
        left, right = choose(number, made, lo, half), choose(number, made, half, hi)
        if left is None:
            return F.when(number >= half, right)
        return F.when(number < half, left) if right is None else F.when(number < half, left).otherwise(right)

    def match(p: Column, derived: Column | None = None) -> Match:
        return Match(
            p["value"], p["start"], p["end"], p["left"] if wide else F.lit(""), p["rest"] if behind else None, derived
        )

    def with_derived(x: Column) -> Column:
        made = {k: s.derive(match(x["p"])) for k, s in enumerate(shapes) if s.derive}
        own = choose(x["shape"], made, 0, len(shapes)) if made else F.lit(None).cast("string")
        return F.struct(x["shape"].alias("shape"), x["p"].alias("p"), own.alias("d"))

    def seen(x: Column) -> Column:
        made = {}
        for k, s in enumerate(shapes):
            accept, item = s.emit(match(x["p"], x["d"]))
            made[k] = item if accept is None else F.when(accept, item)
        return choose(x["shape"], made, 0, len(shapes))

    ranked = [k for k, s in enumerate(shapes) if s.rank >= 0]
    found = F.transform(F.flatten(F.transform(hits, places)), with_derived)
    if not ranked:
        kept = F.filter(F.transform(found, seen), lambda s: s.isNotNull())
    else:
        # credentials behind all else at their start, in claim order
        claim = lambda x: F.when(x["shape"] >= ranked[0], x["shape"]).otherwise(-1)
        claims = F.filter(
            F.transform(found, lambda x: let(seen(x), lambda s: F.struct(
                s["start"].alias("start"), claim(x).alias("rank"), s.alias("s")))),
            lambda c: c["s"].isNotNull(),
        )
        first = lambda cs: lambda c, i: (c["rank"] < 0) | (i == 0) | ~(
            (F.get(cs, i - 1)["start"] == c["start"]) & (F.get(cs, i - 1)["rank"] >= 0))
        kept = let(F.sort_array(claims), lambda cs: F.transform(F.filter(cs, first(cs)), lambda c: c["s"]))
    return F.when(F.size(hits) == 0, no_spans()).otherwise(kept)


# A probe must hold for every text any member can match.  Eight digits with at
# most two other characters between neighbours is necessary for all the number
# shapes: the widest gap is the ") " of a phone number.
_EIGHT_DIGITS = r"[0-9](?:[^0-9]{0,2}+[0-9]){7}"
# The written forms of the national numbers; without one of them they need a cue.
_GROUPED = (
    rf"{B0}[0-9]{{3}}(?:[0-9][ -][0-9]{{4}}[ -][0-9]{{4}}|[ -][0-9]{{3}}[ -][0-9]{{2,4}}"
    rf"|\.[0-9]{{3}}\.[0-9]{{3}}-[0-9]{{2}}){B1}"
)
_NATIONAL_STEMS = ["sin", "insurance", "nas", "assurance", "nhs", "national", "aadha", "uidai", "tfn", "tax", "cpf",
                   "cadastro"]
_STREET_STEMS = ["st", "ave", "rd", "road", "blvd", "boulevard", "dr", "ln", "lane", "ct",
                 "court", "pl", "way", "ter", "cir", "pkwy", "parkway"]
FAMILIES: list[tuple[Callable[[Column, Column], Column], list[str]]] = [
    (
        lambda t, low: F.rlike(t, F.lit(_EIGHT_DIGITS)),
        ["phone", "ssn", "npi", "payment_card"],
    ),
    (
        lambda t, low: F.rlike(t, F.lit(matcher(_GROUPED, "[0-9]{3}"))) | _any_of(low, _NATIONAL_STEMS),
        ["canadian_sin", "uk_nhs", "aadhaar", "australian_tfn", "cpf"],
    ),
    (lambda t, low: _any_of(low, ["dob", "birth", "born"]), ["dob"]),
    (lambda t, low: F.rlike(t, F.lit("[A-Z]{2}[0-9]{4}")), ["dea", "pan_india"]),
    (lambda t, low: _any_of(low, ["mrn", "record"]), ["medical_record_number"]),
    (lambda t, low: _any_of(low, ["member", "patient"]), ["member_id"]),
    (lambda t, low: _any_of(low, ["mbi", "medicare", "hicn"]), ["mbi"]),
    (lambda t, low: _any_of(low, ["name", "patient", "member"]), ["possible_name"]),
    (
        lambda t, low: F.rlike(t, F.lit(f"[0-9]{WS}+[A-Za-z]")) & _any_of(low, _STREET_STEMS),
        ["address"],
    ),
    (lambda t, low: t.contains("@"), ["email"]),
    (lambda t, low: F.lit(True), ["secrets"]),
]


def _enabled(categories: Iterable[str]) -> list[Shape]:
    """The shapes of some categories, credential formats last."""
    wanted = set(categories)
    shapes = [s for _, members in FAMILIES for c in members if c in wanted for s in SHAPES[c]]
    return sorted(shapes, key=lambda s: s.rank)


def text_hits(text: Column, low: Column, mark: Column, categories: Iterable[str] = DEFAULT_CATEGORIES) -> Column:
    """What the patterns of all enabled detectors hold in a text, for ``spans_of_hits``."""
    shapes = _enabled(categories)
    parts = []
    for probe, members in FAMILIES:
        wanted = [s for s in shapes if s.category in members]
        if wanted:
            parts.append(F.when(probe(text, low), _hits(text, low, mark, wanted, shapes)).otherwise(_no_hits()))
    return all_of(parts) if parts else _no_hits()


def spans_of_hits(text: Column, hits: Column, categories: Iterable[str] = DEFAULT_CATEGORIES) -> Column:
    """Spans of all enabled detectors, unresolved."""
    shapes = _enabled(categories)
    return _spans_of_hits(text, hits, shapes) if shapes else no_spans()


def raw_spans(text: Column, categories: Iterable[str] = DEFAULT_CATEGORIES) -> Column:
    """Spans of all enabled detectors, unresolved, as one expression."""
    categories = list(categories)
    made = let(
        F.struct(F.lower(text).alias("low"), mark_of(text).alias("mark")),
        lambda x: text_hits(text, x["low"], x["mark"], categories),
    )
    return let(made, lambda hits: spans_of_hits(text, hits, categories))


def resolved_spans(found: Column, categories: Iterable[str] = DEFAULT_CATEGORIES, extra: Column | None = None) -> Column:
    """``found`` and the ``extra`` spans (user rules) of enabled categories, resolved."""
    if extra is not None:
        enabled = list(categories)
        found = F.concat(found, F.filter(extra, lambda s: s["category"].isin(enabled)))
    return resolve_overlaps(found)


def detect_all(text: Column, categories: Iterable[str] = DEFAULT_CATEGORIES,
               extra: Column | None = None) -> Column:
    """Resolved spans of the enabled detectors and of ``extra`` spans (user rules) of
    enabled categories."""
    return resolved_spans(raw_spans(text, categories), categories, extra)


def detect_enabled(text: Column, enabled: Column, extra: Column | None = None) -> Column:
    """Resolved spans of the categories in the row's own ``enabled`` array.

    Spans of other categories are dropped before overlaps are resolved, so that what
    is off can never hide what is on.
    """
    found = raw_spans(text, DETECTORS)
    if extra is not None:
        found = F.concat(found, extra)
    return resolve_overlaps(F.filter(found, lambda s: F.array_contains(enabled, s["category"])))
