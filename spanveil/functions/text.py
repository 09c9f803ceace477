"""Span extraction as native column expressions.

A span is located without a Python UDF: ``regexp_extract_all`` gives the matched
pieces, ``split`` gives the gaps around them, and one ordered fold over the zipped
arrays turns piece lengths into offsets.  Offsets count code points, start is
0-based and inclusive, end is exclusive.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,category:string,confidence:double,value:string>"
SPANS = f"array<{SPAN}>"

# The white space set of ECMAScript, spelled out because Java's \s
# is ASCII only.
WS_SET = (
    r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
WS = f"[{WS_SET}]"
NOT_WS = f"[^{WS_SET}]"
# Characters accepted as a dash inside an identifier.
DASH_SET = (
    r"\x{2D}\x{58A}\x{5BE}\x{1400}\x{1806}\x{2010}-\x{2015}\x{2212}\x{2E17}\x{2E1A}"
    r"\x{2E3A}\x{2E3B}\x{2E40}\x{301C}\x{3030}\x{30A0}\x{FE31}\x{FE32}\x{FE58}\x{FE63}\x{FF0D}"
)
DASH = f"[{DASH_SET}]"
SEP = f"[{WS_SET}{DASH_SET}]"

# ASCII word boundaries.  Java's \b treats accented letters as word characters.
B0 = r"(?<![A-Za-z0-9_])"
B1 = r"(?![A-Za-z0-9_])"
WB = f"(?:(?<=[A-Za-z0-9_]){B1}|{B0}(?=[A-Za-z0-9_]))"
NO_ALNUM_BEFORE = r"(?<![0-9A-Za-z])"
NO_ALNUM_AFTER = r"(?![0-9A-Za-z])"


_ALNUM = f"[{string.digits}{string.ascii_letters}]"
#: Classes as the matcher tests them fastest: single characters are one table lookup, ranges a
#: chain of tests, which printable ASCII need not run through.
_FAST = {
    "[A-Za-z0-9_]": r"\w", "[0-9A-Za-z]": _ALNUM, "[A-Za-z0-9]": _ALNUM,
    WS: f"[[^!-~]&&{WS}]", SEP: f"[[^!-,.-~]&&{SEP}]", DASH: f"[[^!-,.-~]&&{DASH}]", NOT_WS: f"[!-~[^{WS_SET}]]",
}


def matcher(pattern: str, first: str | None = None) -> str:
    """A fixed pattern as Java's matcher runs it fastest; the matches stay the same.

    Classes are written as in ``_FAST``, and ``first`` (a class or prefix that every match
    begins with) is looked for before all else.
    """
    if first:
        pattern = f"(?={first})(?:{pattern})"
    for slow, fast in _FAST.items():
        # what is fast already holds the slow form
        pattern = fast.join(part.replace(slow, fast) for part in pattern.split(fast))
    return pattern


def all_of(arrays: list[Column]) -> Column:
    """The arrays end to end.  ``concat`` takes them through a lazy list, which costs far more."""
    return F.flatten(F.array(*arrays)) if len(arrays) > 1 else arrays[0]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``.

    Without the binding Catalyst repeats the expression at each use.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_spans() -> Column:
    return F.expr(f"cast(array() as {SPANS})")


def span(start, end, category, confidence, value) -> Column:
    """One span struct in sort order: (start, end) first."""
    return F.struct(
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        (F.lit(category) if isinstance(category, str) else category).alias("category"),
        (confidence if isinstance(confidence, Column) else F.lit(float(confidence)))
        .cast("double")
        .alias("confidence"),
        value.alias("value"),
    )


@dataclass
class Match:
    """One regex match: its place and what stands around it."""

    value: Column
    start: Column
    end: Column
    left: Column
    rest: Column | None
    derived: Column | None = None

    def before(self, n: int) -> Column:
        """Up to ``n`` characters in front of the match."""
        return F.substring(self.left, -n, n)


def match_spans(
    text: Column,
    pattern: str | Column,
    emit: Callable[[Match], tuple[Column | None, Column]],
    *,
    window: int = 0,
    rest: int = 0,
    item: str = SPAN,
    limit: int | None = None,
    first: str | None = None,
    derive: Callable[[Match], Column] | None = None,
) -> Column:
    """Array of whatever ``emit`` builds for each non-overlapping match.

    ``emit`` returns (accept, item); a None accept keeps every match.  ``window``
    characters before the match are cut out for it, so cue checks cost
    one pass over the text however many matches there are.  ``rest`` characters
    after the match are cut out too, for many matches by a lookahead.  Patterns must not match
    empty and must not contain capturing groups when ``rest`` is used.  ``first`` is a class that
    every match begins with: the matcher then passes over all other places at once.
    ``derive`` makes a value that ``emit`` uses several times; it is computed once a match.
    """
    if first:
        pattern = matcher(pattern, first)
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern

    def seen(m: Column, derived: Column | None = None) -> Column:
        accept, made = emit(Match(
            m["value"], m["start"], m["end"], m["left"] if window else F.lit(""), m["rest"] if rest else None, derived
        ))
        return made if accept is None else F.when(accept, made)

    def made(pieces: Column) -> Column:
        afters = F.regexp_extract_all(text, ahead(regex, rest), F.lit(1)) if rest else None
        places = places_of(
            text, pieces, F.lit(window) if window else None, F.lit(rest) if rest else None, afters, limit
        )
        if derive is None:
            return F.transform(places, lambda m: seen(m))
        own = lambda m: derive(Match(m["value"], m["start"], m["end"], F.lit(""), m["rest"] if rest else None))
        both = F.transform(places, lambda m: F.struct(m.alias("m"), own(m).alias("d")))
        return F.transform(both, lambda b: seen(b["m"], b["d"]))

    found = F.filter(let(let(mark_of(text), lambda sep: cut(text, regex, sep)), made), lambda x: x.isNotNull())
    return F.when(F.rlike(text, regex), found).otherwise(F.expr(f"cast(array() as array<{item}>)"))


def mark_of(text: Column) -> Column:
    """What parts gaps and matches of a text."""
    return F.when(text.contains(_MARK), F.concat(F.lit(_MARK), F.sha2(text, 256))).otherwise(F.lit(_MARK))


def cut(text: Column, regex: Column, sep: Column) -> Column:
    """Gaps (even) and matches (odd) of a text; one pass marks every match."""
    return F.split(F.regexp_replace(text, regex, F.concat(sep, F.lit("$0"), sep)), sep, -1)


def ahead(regex: Column, rest: int) -> Column:
    """The pattern with the ``rest`` characters behind it as its group."""
    return F.concat(F.lit("(?:"), regex, F.lit(")(?=([\\s\\S]{0,%d}))" % rest))


def places_of(
    text: Column, pieces: Column, window: Column | None, rest: Column | None, afters: Column | None, limit: int | None = None,
) -> Column:
    """(value, start, end, left, rest) of the matches among ``pieces``, which hold one at least.

    Few ones are placed by adding up sizes, many by a fold, in which ``afters`` has what stands
    behind each; where that is null, as for short texts, it is cut out.
    """

    def place(i: Column, sizes: Column, start: Column, left: Column | None, after: Column | None) -> Column:
        fields = [
            F.get(pieces, i * 2 + 1).alias("value"), start.alias("start"),
            (start + F.get(sizes, i * 2 + 1)).alias("end"),
        ]
        if window is not None:
            fields.append(left.alias("left"))
        if rest is not None:
            fields.append(after.alias("rest"))
        return F.struct(*fields)

    def behind(end: Column) -> Column:
        return F.when(rest > 0, F.substr(text, end + 1, rest)).otherwise(F.lit(""))

    def placed(sizes: Column) -> Column:
        def few(start: Column, i: Column) -> Column:
            left = after = None
            if window is not None:
                left = F.when(
                    window > 0, F.substr(text, F.greatest(start - window, F.lit(0)) + 1, F.least(start, window))
                ).otherwise(F.lit(""))
            if rest is not None:
                after = behind(start + F.get(sizes, i * 2 + 1))
            return place(i, sizes, start, left, after)

        def step(acc: Column, i: Column, after: Column | None) -> tuple[dict[str, Column], None, Column]:
            start = acc["pos"] + F.get(sizes, i * 2)
            lead = F.concat(acc["tail"], F.get(pieces, i * 2)) if window is not None else F.lit("")
            end = start + F.get(sizes, i * 2 + 1)
            made = place(
                i, sizes, start, F.substr(lead, -window, window) if window is not None else None,
                F.coalesce(F.get(after, i), behind(end)) if rest is not None else None,
            )
            tail = F.substr(F.concat(lead, F.get(pieces, i * 2 + 1)), -window, window) if window is not None else F.lit("")
            return {"pos": end, "tail": tail}, None, made

        n = F.shiftright(F.size(sizes), 1)
        places = F.sequence(F.lit(0), (n if limit is None else F.least(n, F.lit(limit))) - 1, F.lit(1))
        starts = F.transform(
            places, lambda i: F.aggregate(F.slice(sizes, F.lit(1), i * 2 + 1), F.lit(0), lambda a, x: a + x)
        )
        kind = (
            "value:string,start:int,end:int" + (",left:string" if window is not None else "")
            + (",rest:string" if rest is not None else "")
        )

        def folded(after: Column | None) -> Column:
            state = {"pos": F.lit(0), "tail": F.lit("")}
            return fold_out(places, state, lambda a, i: step(a, i, after), f"struct<{kind}>", bind=False)

        many = folded(None) if afters is None else let(afters, folded)
        return F.when(F.size(sizes) <= 2 * _FEW + 1, F.transform(starts, few)).otherwise(many)

    return let(F.transform(pieces, lambda p: F.length(p)), placed)


#: Parts gaps and matches.  A text that holds it is parted by it and the text's own digest,
#: which no text contains.
_MARK = "\ufffe"
#: Matches whose places come from plain sums, without a fold.
_FEW = 8
#: Items folded at a time; an output array is never grown beyond it item by item.  Every step
#: of an aggregate copies what it holds, so blocks and chunks are short.
_BLOCK = 32
#: Items of a chunk, from which blocks are cut.
_CHUNK = 2_048


def fold_out(
    items: Column,
    state: dict[str, Column],
    step: Callable[[Column, Column], tuple[dict[str, Column], Column | None, Column]],
    item: str,
    finish: Callable[[Column], Column] | None = None,
    bind: bool = True,
) -> Column:
    """Ordered fold over ``items`` that emits an array of ``item``.

    ``step`` returns the next state, whether to emit (None: always) and what.
    ``finish`` turns the last state into an array put at the end.  Appending copies an
    array, so outputs are collected per block of items and flattened once: the time is
    linear in the items.  ``bind`` is off where ``items`` is cheap to compute again: binding
    copies what comes out.
    """
    none = F.expr(f"cast(array() as array<{item}>)")

    def pack(values: dict[str, Column], out: Column) -> Column:
        return F.struct(*[v.alias(k) for k, v in values.items()], out.alias("out"))

    def one(acc: Column, x: Column) -> Column:
        values, accept, made = step(acc, x)
        grown = F.concat(acc["out"], F.array(made))
        if accept is not None:
            grown = F.when(accept, grown).otherwise(acc["out"])
        return pack(values, grown)

    nested = F.expr(f"cast(array() as array<array<{item}>>)")

    def parts(xs: Column, size: int) -> Column:
        return F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int"))

    def folded(xs: Column) -> Column:
        def chunk(acc: Column, c: Column) -> Column:
            def block(held: Column, b: Column) -> Column:
                # results are not bound by ``let``, which would copy all that is collected
                return F.aggregate(
                    F.slice(c, b * _BLOCK + 1, _BLOCK), pack({k: held[k] for k in state}, none), one,
                    lambda r: pack({k: r[k] for k in state}, F.concat(held["out"], F.array(r["out"]))),
                )

            return F.aggregate(
                parts(c, _BLOCK), pack({k: acc[k] for k in state}, nested), block,
                lambda r: pack({k: r[k] for k in state}, F.concat(acc["out"], F.array(F.flatten(r["out"])))),
            )

        def end(acc: Column) -> Column:
            flat = F.flatten(acc["out"])
            return flat if finish is None else F.concat(flat, finish(acc))

        # a slice copies its whole source first, so blocks are cut from chunks
        chunks = F.transform(parts(xs, _CHUNK), lambda c: F.slice(xs, c * _CHUNK + 1, _CHUNK))
        many = F.aggregate(chunks, pack(state, nested), chunk, end)
        empty = none if finish is None else finish(pack(state, none))
        return F.when(F.size(xs) > 0, many).otherwise(empty)

    return let(items, folded) if bind else folded(items)


def ranks_in(starts: Column, places: Column) -> Column:
    """For each of ``places`` how many of ``starts`` are not after it; both ascend.

    One merge of the two arrays instead of a scan of all starts for every place.
    """
    marks = F.concat(
        F.transform(starts, lambda x: F.struct(x.cast("long").alias("at"), F.lit(0).alias("kind"))),
        F.transform(places, lambda x: F.struct(x.cast("long").alias("at"), F.lit(1).alias("kind"))),
    )
    return fold_out(
        # the plain sort: array_sort would call a comparator for every pair
        F.sort_array(marks), {"n": F.lit(0)},
        lambda a, m: ({"n": a["n"] + 1 - m["kind"]}, m["kind"] == 1, a["n"]), "int",
    )


def rank_in(starts: Column, place: Column) -> Column:
    """How many of the ascending ``starts`` are not after ``place``, by halving."""

    def search(xs: Column) -> Column:
        def halve(span: Column, _: Column) -> Column:
            def half(middle: Column) -> Column:
                after = F.get(xs, middle) > place
                return F.struct(
                    F.when(after, span["lo"]).otherwise(middle + 1).alias("lo"),
                    F.when(after, middle).otherwise(span["hi"]).alias("hi"),
                )

            middle = F.floor((span["lo"] + span["hi"]) / 2).cast("int")
            return F.when(span["lo"] < span["hi"], let(middle, half)).otherwise(span)

        rounds = F.sequence(F.lit(0), F.floor(F.log2(F.size(xs) + F.lit(1))).cast("int"))
        whole = F.struct(F.lit(0).alias("lo"), F.size(xs).alias("hi"))
        return F.aggregate(rounds, whole, halve, lambda span: span["lo"])

    return let(starts, search)


def regex_spans(text: Column, pattern: str | Column, category="match", confidence=1.0) -> Column:
    """Every non-overlapping match of a pattern, with offsets."""
    return match_spans(
        text, pattern, lambda m: (None, span(m.start, m.end, category, confidence, m.value))
    )


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def trim_ws(value: Column) -> Column:
    """Strip ECMAScript white space on both sides."""
    return F.regexp_replace(value, f"^{WS}+|{WS}+$", "")
