"""License scans: ordered signature rules behind a keyword filter.

A text becomes a line of lower-case words.  One automaton pass finds the keywords;
only rules one of whose keywords occurs run, and only near it.  Detections are taken
in order of priority, then length, then place; one that lies inside the words of a
detection already taken is suppressed.
"""

from __future__ import annotations

import itertools
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from spanveil.llm.common import map_arrow, texts


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched against whole words joined by one space."""

    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    weight: float = 0.9


#: Phrases whose every place is reported, and their labels.
BASE = (
    Rule("cc-by", "cc by", ("cc by",), 0, 0.6),
    Rule("gpl", "general public license", ("general public licen",), 0, 0.7),
    Rule("reserved", "all rights reserved", ("rights reserved",), 0, 0.3),
)

# Building blocks of the rules, as published license names spell them.
_LICENCE = "licen[cs]e"
_GIVEN = "(?:(?:released|licensed|distributed|available|provided|published) )?(?:under|subject to|according to)"
_VERSION = "(?:(?:version|v|ver|vers) ?)?"
_LATER = "(?: or (?:at your option )?any later version)"
_HERE = "licen"

#: Families with versions: label stem, name, keywords, versions.
_FAMILIES = (
    ("apache", f"(?:the )?apache(?: software)? {_LICENCE}", ("apache",), ("1.0", "1.1", "2.0")),
    ("gpl", f"(?:the )?(?:gnu )?(?:general public {_LICENCE}|gpl)", ("general public", "gpl"), ("1", "2", "3", "1.0", "2.0", "3.0")),
    ("lgpl", f"(?:the )?(?:gnu )?(?:(?:lesser|library) general public {_LICENCE}|lgpl)", ("general public", "lgpl"), ("2", "2.0", "2.1", "3", "3.0")),
    ("agpl", f"(?:the )?(?:gnu )?(?:affero general public {_LICENCE}|agpl)", ("affero", "agpl"), ("1", "1.0", "3", "3.0")),
    ("gfdl", f"(?:gnu )?(?:free documentation {_LICENCE}|gfdl)", ("free documentation", "gfdl"), ("1.1", "1.2", "1.3")),
    ("mpl", f"(?:mozilla public {_LICENCE}|mpl)", ("mozilla", "mpl"), ("1.0", "1.1", "2.0")),
    ("epl", f"(?:eclipse public {_LICENCE}|epl)", ("eclipse", "epl"), ("1.0", "2.0")),
    ("cddl", f"(?:common development and distribution {_LICENCE}|cddl)", ("common development", "cddl"), ("1.0", "1.1")),
    ("cpl", f"common public {_LICENCE}", ("common public",), ("1.0",)),
    ("eupl", f"(?:european union public {_LICENCE}|eupl)", ("european union", "eupl"), ("1.0", "1.1", "1.2")),
    ("ofl", f"(?:sil )?(?:open font {_LICENCE}|ofl)", ("open font", "ofl"), ("1.0", "1.1")),
    ("artistic", f"artistic {_LICENCE}", ("artistic",), ("1.0", "2.0")),
    ("afl", f"academic free {_LICENCE}", ("academic free",), ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl", f"open software {_LICENCE}", ("open software",), ("1.0", "2.0", "2.1", "3.0")),
    ("lppl", f"latex project public {_LICENCE}", ("latex project",), ("1.0", "1.1", "1.2", "1.3a", "1.3c")),
    ("php", f"php {_LICENCE}", ("php",), ("3.0", "3.01")),
    ("python", f"(?:python software foundation|psf) {_LICENCE}", ("python", "psf"), ("2", "2.0")),
    ("zpl", f"zope public {_LICENCE}", ("zope",), ("1.1", "2.0", "2.1")),
    ("bsl", f"(?:business source|boost software) {_LICENCE}", ("business source", "boost"), ("1.0", "1.1")),
    ("elastic", f"elastic {_LICENCE}", ("elastic",), ("1.0", "2.0")),
    ("sspl", f"(?:server side public {_LICENCE}|sspl)", ("server side", "sspl"), ("1", "1.0")),
    ("cecill", f"cecill(?: free software)?(?: {_LICENCE}(?: agreement)?)?", ("cecill",), ("1.0", "1.1", "2.0", "2.1")),
    ("ecl", f"educational community {_LICENCE}", ("educational community",), ("1.0", "2.0")),
    ("ms-pl", f"microsoft (?:public|reciprocal) {_LICENCE}", ("microsoft",), ("1.0",)),
    ("odbl", f"open (?:data commons )?(?:database|data commons attribution) {_LICENCE}", ("open data", "open database"), ("1.0",)),
)

#: Creative Commons elements: code words and spelled out.
_CC = (
    ("by", "attribution"), ("by-sa", "attribution share ?alike"), ("by-nc", "attribution non ?commercial"),
    ("by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("by-nc-sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
)
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Single rules: label, pattern, keywords, weight.
_SINGLE = (
    ("mit", f"{_GIVEN} (?:the )?(?:terms of the )?mit(?: x11)?(?: {_LICENCE})?", ("mit",), 0.95),
    ("mit", f"(?:the )?mit {_LICENCE}", ("mit",), 0.9),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted",), 0.95),
    ("isc", f"isc {_LICENCE}", ("isc",), 0.9),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("hereby granted",), 0.9),
    ("bsd", f"bsd(?: style)? {_LICENCE}", ("bsd",), 0.8),
    ("bsd-0-clause", f"(?:bsd (?:0|zero) clause|(?:0|zero) clause bsd)(?: {_LICENCE})?", ("bsd",), 0.9),
    ("bsd-1-clause", f"(?:bsd (?:1|one) clause|(?:1|one) clause bsd)(?: {_LICENCE})?", ("bsd",), 0.9),
    ("bsd-2-clause", f"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd)(?: {_LICENCE})?", ("bsd",), 0.9),
    ("bsd-3-clause", f"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: {_LICENCE})?", ("bsd",), 0.9),
    ("bsd-4-clause", f"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: {_LICENCE})?", ("bsd",), 0.9),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution",), 0.85),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse", ("nor the names",), 0.9),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", ("advertising materials",), 0.9),
    ("apache", f"{_GIVEN} (?:the )?apache(?: software)? {_LICENCE}", ("apache",), 0.85),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license", ("applicable law",), 0.9),
    ("apache-2.0", "www apache org licenses license 2 0", ("apache",), 0.95),
    ("gpl", f"(?:gnu )?general public {_LICENCE}", ("general public",), 0.7),
    ("gpl", "this program is free software(?: you can redistribute it)?", ("free software",), 0.7),
    ("gpl", "www gnu org (?:licenses|copyleft) (?:gpl|agpl|lgpl)?", ("www gnu org",), 0.6),
    ("lgpl", f"(?:lesser|library) general public {_LICENCE}", ("general public",), 0.85),
    ("agpl", f"affero general public {_LICENCE}", ("affero",), 0.85),
    ("gfdl", f"free documentation {_LICENCE}", ("free documentation",), 0.85),
    ("mpl", f"mozilla public {_LICENCE}", ("mozilla",), 0.85),
    ("epl", f"eclipse public {_LICENCE}", ("eclipse",), 0.85),
    ("ofl", f"open font {_LICENCE}", ("open font",), 0.85),
    ("zlib", f"zlib(?: libpng)? {_LICENCE}", ("zlib",), 0.9),
    ("zlib", "altered source versions must be plainly marked as such", ("plainly marked",), 0.9),
    ("boost", f"boost software {_LICENCE}", ("boost",), 0.9),
    ("unlicense", "(?:the )?unlicense", ("unlicense",), 0.9),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",), 0.95),
    ("wtfpl", "(?:wtfpl|do what the fuck you want to public licen[cs]e)", ("wtfpl", "do what the"), 0.9),
    ("beerware", f"beer ?ware(?: {_LICENCE})?", ("beerware", "beer ware"), 0.8),
    ("openssl", f"openssl {_LICENCE}", ("openssl",), 0.9),
    ("ssleay", f"ssleay {_LICENCE}", ("ssleay",), 0.9),
    ("postgresql", f"postgresql {_LICENCE}", ("postgresql",), 0.9),
    ("ncsa", f"(?:university of illinois )?ncsa(?: open source)? {_LICENCE}", ("ncsa",), 0.9),
    ("x11", f"x11 {_LICENCE}", ("x11",), 0.85),
    ("vim", f"vim {_LICENCE}", ("vim",), 0.85),
    ("ruby", f"ruby {_LICENCE}", ("ruby",), 0.8),
    ("perl", "same terms as perl itself", ("as perl",), 0.85),
    ("sleepycat", f"sleepycat {_LICENCE}", ("sleepycat",), 0.9),
    ("w3c", "w3c (?:software|document)(?: notice and)? licen[cs]e", ("w3c",), 0.9),
    ("unicode", "unicode (?:data files and software )?licen[cs]e", ("unicode",), 0.85),
    ("commons-clause", "commons clause(?: licen[cs]e condition)?", ("commons clause",), 0.9),
    ("polyform", "polyform (?:noncommercial|small business|strict|shield|perimeter)(?: licen[cs]e)?", ("polyform",), 0.9),
    ("openrail", "(?:creativeml )?open ?rail(?: m)?(?: licen[cs]e)?", ("openrail", "open rail"), 0.9),
    ("cc0", "(?:cc0|cc zero|creative commons zero)", ("cc0", "cc zero", "commons zero"), 0.95),
    ("cc", "creative commons", ("creative commons",), 0.6),
    ("cc", "creativecommons org licen[cs]es", ("creativecommons",), 0.8),
    ("cc-by", "creative commons attribution", ("creative commons",), 0.85),
    ("public-domain", "(?:in|into|to) the public domain", ("public domain",), 0.7),
    ("public-domain", "public domain (?:dedication|mark|notice)", ("public domain",), 0.85),
    ("public-domain", "no (?:known )?copyright(?: restrictions)?", ("copyright",), 0.6),
    ("proprietary", "proprietary and confidential", ("proprietary",), 0.8),
    ("proprietary", "confidential and proprietary", ("proprietary",), 0.8),
    ("proprietary", "unauthori[sz]ed (?:copying|use|reproduction|distribution)", ("unauthori",), 0.7),
    ("proprietary", "(?:may not|must not|cannot) be (?:reproduced|copied|distributed|republished|redistributed)", ("reproduced", "copied", "distributed", "republished"), 0.6),
    ("proprietary", "no part of this (?:publication|work|book|document|material) may be reproduced", ("no part of",), 0.85),
    ("proprietary", "without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)(?: of the (?:author|publisher|copyright owner|owner))?", ("permission", "consent"), 0.4),
    ("eula", "end user licen[cs]e agreement", ("end user",), 0.8),
    ("eula", "by (?:installing|using|downloading) (?:the|this) software you agree", ("you agree",), 0.8),
    ("non-commercial", "(?:for )?(?:non ?commercial|personal) use only", ("use only",), 0.6),
    ("non-commercial", "not for commercial use", ("commercial use",), 0.6),
    ("evaluation", "(?:for )?evaluation (?:purposes|use) only", ("evaluation",), 0.6),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", ("copyright",), 0.5),
    ("copyright", "(?:c|©) copyright", ("copyright",), 0.4),
    ("copyright", "alle rechte vorbehalten", ("rechte vorbehalten",), 0.4),
    ("copyright", "tous droits réservés", ("droits réservés",), 0.4),
    ("copyright", "todos los derechos reservados", ("derechos reservados",), 0.4),
    ("warranty", "the software is provided as is without warranty of any kind", ("as is",), 0.5),
    ("warranty", "without even the implied warranty of merchantability", ("merchantability",), 0.5),
)

#: Identifiers used in `SPDX-License-Identifier:` tags.
_SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause "
    "BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 "
    "CC-BY-ND-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3 GPL-2.0-only "
    "GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only "
    "LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PHP-3.01 "
    "PostgreSQL PSF-2.0 Ruby SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()


def _words_of(name: str) -> str:
    return re.sub("[^0-9a-z]+", " ", name.lower()).strip()


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules, the base phrases first; a larger priority wins."""
    made = list(BASE)
    for label, pattern, keywords, weight in _SINGLE:
        made.append(Rule(label, pattern, keywords, 10, weight))
    for stem, name, keywords, versions in _FAMILIES:
        for version in versions:
            number = _words_of(version)
            made.append(Rule(f"{stem}-{version}", f"{name} {_VERSION}{number}", keywords, 30, 0.95))
            made.append(Rule(f"{stem}-{version}+", f"{name} {_VERSION}{number}{_LATER}", keywords, 40, 0.97))
    for (code, spelled), version in itertools.product(_CC, _CC_VERSIONS):
        number, words = _words_of(version), _words_of(code)
        names = f"(?:cc {words}|creative commons (?:{words}|{spelled}))"
        made.append(Rule(f"cc-{code}-{version}", f"{names}(?: (?:international|unported|generic|{_LICENCE}))* {_VERSION}{number}", (f"cc {words}", "creative commons"), 30, 0.97))
    for code, spelled in _CC:
        words = _words_of(code)
        made.append(Rule(f"cc-{code}", f"(?:cc {words}|creative commons {spelled})", (f"cc {words}", "creative commons"), 20, 0.85))
    for name in _SPDX:
        made.append(Rule(f"spdx:{name.lower()}", f"spdx license identifier {_words_of(name)}", ("spdx license",), 50, 0.99))
    return tuple(made)


#: Characters around a keyword within which every rule's match lies.
REACH = 400
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Scanner:
    """Compiled rules behind one automaton over their keywords."""

    def __init__(self) -> None:
        import ahocorasick

        self.rules = rules()
        self.regexes = [re.compile(f"(?<![^ ])(?:{r.pattern})(?![^ ])") for r in self.rules]
        gates: dict[str, list[int]] = {}
        for i, rule in enumerate(self.rules):
            for word in rule.keywords:
                gates.setdefault(word, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, which in gates.items():
            self.automaton.add_word(word, tuple(which))
        self.automaton.make_automaton()

    def near(self, line: str) -> dict[int, list[list[int]]]:
        """Per rule the stretches of the line around its keywords, merged."""
        found: dict[int, list[list[int]]] = {}
        size = len(line)
        for end, which in self.automaton.iter(line):
            lo, hi = max(0, end - REACH), min(size, end + REACH)
            for i in which:
                spans = found.setdefault(i, [])
                if spans and spans[-1][1] >= lo:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
        return found

    def detections(self, line: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) of every match, in characters of the line."""
        hits = set()
        for i, spans in self.near(line).items():
            regex = self.regexes[i]
            for lo, hi in spans:
                for m in regex.finditer(line, lo, hi):
                    # a match cut by the stretch is judged against the whole line
                    if (m.start() == 0 or line[m.start() - 1] == " ") and (m.end() == len(line) or line[m.end()] == " "):
                        hits.add((m.start(), m.end(), i))
        return sorted(hits)

    def kept(self, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Detections that do not lie inside one taken before them.

        A binary indexed tree holds, by start, the furthest end of what is taken.
        """
        order = sorted(hits, key=lambda h: (-self.rules[h[2]].priority, h[0] - h[1], h[0], h[2]))
        rank = {start: i + 1 for i, start in enumerate(sorted({h[0] for h in hits}))}
        furthest = [0] * (len(rank) + 1)
        taken: list[tuple[int, int, int]] = []
        for hit in order:
            i, reach = rank[hit[0]], 0
            while i:
                reach = max(reach, furthest[i])
                i &= i - 1
            if reach < hit[1]:
                taken.append(hit)
                i = rank[hit[0]]
                while i < len(furthest):
                    furthest[i] = max(furthest[i], hit[1])
                    i += i & -i
        return sorted(taken)


@lru_cache(1)
def scanner() -> Scanner:
    return Scanner()


def scan(text: bytes) -> dict:
    """Words, base places, labels, kept spans (in words) and score of one text."""
    words = _WORD.findall(text.lower())
    line = b" ".join(words).decode("utf-8", "replace")
    scan_ = scanner()
    hits = scan_.detections(line)
    out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base": [], "labels": [], "spans": [], "score": 0.0}
    if not hits:
        return out
    blanks = [m.start() for m in re.finditer(" ", line)]
    place = lambda at: bisect_left(blanks, at)
    base = [h for h in hits if h[2] < len(BASE)]
    kept = scan_.kept(hits)
    out["n_base"] = len(base)
    if base:
        out["first_word"], out["last_word"] = place(base[0][0]), place(base[-1][0])
    out["base"] = sorted({scan_.rules[h[2]].label for h in base})
    out["spans"] = [(scan_.rules[i].label, place(a), place(b) + 1, scan_.rules[i].weight) for a, b, i in kept]
    out["labels"] = sorted({*out["base"], *(s[0] for s in out["spans"])})
    out["score"] = 1 - math.prod(1 - s[3] for s in out["spans"])
    return out


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double, spans array<struct<label:string,first:long,last:long>>"
)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License detections of every document, one row each; map only.

    ``spans`` are the kept detections in words (``last`` excluded).  Null and empty
    texts have no words, no labels and score 0; a null ``doc_id`` stays null;
    repeated rows are scanned each; further columns are not read.  Texts are scanned
    whole: memory is that of one text, and rules run only around their keywords.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t) for t in texts(batch.column(1))]
        spans = [[{"label": s[0], "first": s[1], "last": s[2]} for s in r["spans"]] for r in rows]
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([r["n_words"] for r in rows], pa.int64()),
                pa.array([r["n_base"] for r in rows], pa.int64()),
                pa.array([r["first_word"] for r in rows], pa.int64()),
                pa.array([r["last_word"] for r in rows], pa.int64()),
                pa.array([",".join(r["base"]) for r in rows], pa.string()),
                pa.array([",".join(r["labels"]) for r in rows], pa.string()),
                pa.array([r["score"] for r in rows], pa.float64()),
                pa.array(spans, kind),
            ],
            ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
        )

    return map_arrow(docs, ["doc_id", "text"], SCHEMA, work)
