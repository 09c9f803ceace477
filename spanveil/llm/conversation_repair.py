"""Repair of conversation structure: cheapest edits by bidirectional Dijkstra.

A conversation's rows and the roles ``(s?(ua)+)?`` span a lattice: a node is (rows
consumed, state of the role pattern), an edge keeps, re-roles or deletes a row or inserts
one.  A forward and a reverse heap grow towards each other; when their tops together
exceed the best crossing, all crossings of that cost are known, and the one with the least
audit wins.  Two audits of equal cost between the same nodes are never a prefix of one
another (the longer one would have paid for an insertion), so the least audit of a whole is
made of the least audits of its parts.  That also allows to cut: rows are range
partitioned by conversation and turn, pieces of ``PIECE`` rows are solved between all
states where they lie, and only their results meet in the fold of a conversation.

A row travels to the fold as one byte; texts are read once more, in order, by the task
that hashes the repaired conversation as they stream by.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import stored
from spanveil.session import ship_package

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: Rows solved at a time between all states.
PIECE = 256

#: State after a role: 0 nothing yet, 1 system, 2 user, 3 assistant.
_STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ACCEPTED = (0, 3)
_LEGAL = {"su", "ua", "au"}
#: Code of a row: upper case where truncated, '-' where it must be deleted, 'o' any other role.
_NO_TEXT = hashlib.sha256(b"").hexdigest()


def _edges(code: str, at: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """(row, state, cost, letter) of every edit at a node."""
    for role in "ua":
        to = _STEPS.get((state, role))
        if to is not None:
            yield at, to, INSERT, "I"
    if at == len(code):
        return
    yield at + 1, state, DELETE, "D"
    kind = code[at]
    if kind == "-":
        return
    extra = TRUNCATED if kind.isupper() else 0
    to = _STEPS.get((state, kind.lower()))
    if to is not None:
        yield at + 1, to, KEEP + extra, "K"
    for role in "ua":
        to = _STEPS.get((state, role))
        if to is not None:
            yield at + 1, to, REROLE + extra, "R"


def _reverse(code: str, at: int, state: int) -> Iterator[tuple[int, int, int, str]]:
    """(row, state, cost, letter) of every edit that leads to a node."""
    for (one, role), two in _STEPS.items():
        if two != state:
            continue
        if role != "s":
            yield at, one, INSERT, "I"
        if at and code[at - 1] != "-":
            kind = code[at - 1]
            extra = TRUNCATED if kind.isupper() else 0
            if role == kind.lower():
                yield at - 1, one, KEEP + extra, "K"
            if role != "s":
                yield at - 1, one, REROLE + extra, "R"
    if at:
        yield at - 1, state, DELETE, "D"


@lru_cache(1 << 16)
def search(code: str, begin: int, ends: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and least audit from state ``begin`` before ``code`` to one of ``ends`` behind it."""
    n = len(code)
    front = {(0, begin): (0, "")}
    back = {(n, state): (0, "") for state in ends}
    # at equal cost only kept rows lead on, so nodes nearer to the source come first
    ahead = [(0, 0, begin)]
    behind = [(0, -n, state) for state in ends]
    heapq.heapify(behind)
    closed_front, closed_back = set(), set()
    best = min((front[v][0] + back[v][0] for v in front.keys() & back.keys()), default=None)
    while ahead or behind:
        top_front = ahead[0][0] if ahead else None
        top_back = behind[0][0] if behind else None
        if best is not None and (top_front is None or top_back is None or top_front + top_back > best):
            break
        if top_back is None or (top_front is not None and top_front <= top_back):
            cost, at, state = heapq.heappop(ahead)
            if (at, state) in closed_front:
                continue
            closed_front.add((at, state))
            audit = front[at, state][1]
            for i, to, price, letter in _edges(code, at, state):
                label = (cost + price, audit + letter)
                if (i, to) not in front or label < front[i, to]:
                    front[i, to] = label
                    heapq.heappush(ahead, (label[0], i, to))
                if (i, to) in back:
                    whole = label[0] + back[i, to][0]
                    best = whole if best is None else min(best, whole)
        else:
            cost, at, state = heapq.heappop(behind)
            at = -at
            if (at, state) in closed_back:
                continue
            closed_back.add((at, state))
            audit = back[at, state][1]
            for i, to, price, letter in _reverse(code, at, state):
                label = (cost + price, letter + audit)
                if (i, to) not in back or label < back[i, to]:
                    back[i, to] = label
                    heapq.heappush(behind, (label[0], -i, to))
                if (i, to) in front:
                    whole = label[0] + front[i, to][0]
                    best = whole if best is None else min(best, whole)
    if best is None:
        return None
    # every cheapest path has a crossing whose two labels are settled
    return best, min(
        front[v][1] + back[v][1] for v in front.keys() & back.keys() if front[v][0] + back[v][0] == best
    )


def between(code: str) -> list[tuple[int, str] | None]:
    """Results between all 16 pairs of states, begin first."""
    return [search(code, begin, (end,)) for begin in range(4) for end in range(4)]


def folded(pieces: list[tuple[str, list[tuple[int, str] | None] | None]]) -> tuple[int, str]:
    """Cost and audit of a conversation from its pieces in order: (code, results or None)."""
    if sum(len(code) for code, _ in pieces) <= PIECE:
        return search("".join(code for code, _ in pieces), 0, _ACCEPTED)
    done: list[str] = []  # audit that all live states have in common
    live = {0: (0, "")}
    for code, results in pieces:
        results = results or between(code)
        new: dict[int, tuple[int, str]] = {}
        for begin, (cost, audit) in live.items():
            for end in range(4):
                found = results[4 * begin + end]
                if found is not None:
                    label = (cost + found[0], audit + found[1])
                    if end not in new or label < new[end]:
                        new[end] = label
        common = len(os.path.commonprefix([audit for _, audit in new.values()]))
        done.append(next(iter(new.values()))[1][:common])
        live = {end: (cost, audit[common:]) for end, (cost, audit) in new.items()}
    cost, audit = min(live[end] for end in _ACCEPTED if end in live)
    return cost, "".join(done) + audit


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) after the damage that the query prescribes.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (it stays as ``gone``), 1 empties its
    text, 2 removes ``.!?``, 3 repeats it, 4 makes its role user.  Nulls are one space.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return (
        rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
        .select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"),
                F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_"))
        .drop("_")
    )


def _coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h1, h2, initial, code, gone): a row without its text.

    ``code`` is '-' for blank, ',' for duplicate, else the role's class, upper case where
    truncated.  Rows are equal by 128 bits of hash over role and text.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    flags = rows.select(
        "conv_id", "turn", "role", "gone", F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit("row"), "text", "role").alias("h2"), initial.alias("initial"),
        F.when(last == "", "-").when(last.isin(".", "!", "?"), initial).otherwise(F.upper(initial)).alias("code"),
    )
    alive = flags.where("NOT gone")
    # first places of contents that occur again: totals are made before the shuffle
    again = stored(
        alive.groupBy("conv_id", "h1", "h2").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("conv_id").alias("c"), F.col("h1").alias("x1"), F.col("h2").alias("x2"), "first")
    )
    joined = flags.join(
        again.hint("merge"),
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")), "left",
    )
    later = F.col("first").isNotNull() & (F.struct("turn") > F.col("first"))
    # rows equal in turn and content are told apart in order, where they lie side by side
    code = F.when((F.col("code") != "-") & later, ",").otherwise(F.col("code"))
    return joined.select("conv_id", "turn", "role", "h1", "h2", "initial", code.alias("code"), "gone")


_PIECES = (
    "conv_id long, part long, code string, first string, last string, low long, high long, turns long, "
    "blank long, duplicate long, truncated long, illegal long, results array<struct<cost: long, audit: string>>"
)
_ROLES = ("s", "u", "a", "o")


class _Piece:
    """Rows of one conversation in order, up to ``PIECE`` of them, with their statistics."""

    def __init__(self, conv):
        self.conv, self.code, self.first, self.last = conv, [], None, None
        self.low = self.high = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial: str, code: str) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            if turn != self.high:
                self.turns += 1
            self.high = turn
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in _LEGAL
        self.last = initial
        self.blank += code == "-"
        self.duplicate += code == ","
        self.truncated += code.isupper()
        self.code.append("-" if code == "," else code)

    def row(self, part: int) -> tuple:
        code = "".join(self.code)
        # only longer conversations fill a piece: theirs are solved here, side by side
        results = [r and {"cost": r[0], "audit": r[1]} for r in between(code)] if len(code) == PIECE else None
        return (
            self.conv, part, code, self.first, self.last, self.low, self.high, self.turns,
            self.blank, self.duplicate, self.truncated, self.illegal, results,
        )


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_RESULTS = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
_PIECES_ARROW = pa.schema(
    [(n, _RESULTS if n == "results" else pa.string() if n in ("code", "first", "last") else pa.int64())
     for n in ("conv_id", "part", "code", "first", "last", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "results")]
)


def _pieces(rows: DataFrame) -> DataFrame:
    """Pieces of every conversation; a conversation may begin and end in any partition."""
    order = ["conv_id", "turn", "role", "h1", "h2", "gone"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("p", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, seen, number, out, part = None, None, 0, [], 0
        for batch in batches:
            for conv, turn, h1, h2, initial, code, gone, p in zip(*[c.to_pylist() for c in batch.columns]):
                part = p << 40
                if piece is None or piece.conv != conv:
                    if piece is not None:
                        out.append(piece.row(part + number))
                        number += 1
                    piece, seen = _Piece(conv), None
                if gone:
                    continue
                if len(piece.code) == PIECE:
                    out.append(piece.row(part + number))
                    number += 1
                    piece = _Piece(conv)
                # equal rows of one turn lie side by side, in one partition: all but the first repeat it
                here = (turn, h1, h2)
                if code != "-" and here == seen:
                    code = ","
                seen = here
                piece.add(turn, initial, code)
            if len(out) >= 512:
                yield _arrow(out, _PIECES_ARROW)
                out = []
        if piece is not None:
            out.append(piece.row(part + number))
        if out:
            yield _arrow(out, _PIECES_ARROW)

    ship_package(rows.sparkSession)
    return spread.select("conv_id", "turn", "h1", "h2", "initial", "code", "gone", "p").mapInArrow(run, _PIECES)


_FOLDED = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, dead string"
)
_FOLDED_ARROW = pa.schema(
    [(n, pa.string() if n in ("audit", "dead") else pa.int64()) for n in (c.split()[0] for c in _FOLDED.split(", "))]
)


def _fold(conv, pieces: list[dict]) -> tuple:
    """One row of ``_FOLDED`` from the pieces of a conversation."""
    pieces = sorted((p for p in pieces if p["code"]), key=lambda p: p["part"])
    if not pieces:
        return conv, 0, 0, 0, 0, 0, 0, "", ""
    turns, illegal, low, high, last = 0, 0, None, None, None
    for p in pieces:
        turns += p["turns"] - (high is not None and p["low"] == high)
        low = p["low"] if low is None else low
        high = high if p["high"] is None else p["high"]
        illegal += p["illegal"] + (last is not None and last + p["first"] not in _LEGAL)
        last = p["last"]
    solved = [(p["code"], p["results"] and [r and (r["cost"], r["audit"]) for r in p["results"]]) for p in pieces]
    cost, audit = folded(solved)
    gaps = 0 if low is None else high - low + 1 - turns
    sums = [sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated")]
    return conv, gaps, *sums, illegal, cost, audit, ""


def _folds(pieces: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_fold(c, p) for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield _arrow(rows, _FOLDED_ARROW)

    names = [f.name for f in _PIECES_ARROW if f.name != "conv_id"]
    grouped = pieces.groupBy("conv_id").agg(F.collect_list(F.struct(*names)).alias("pieces"))
    return grouped.mapInArrow(run, _FOLDED).drop("dead")


_OUT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
_OUT_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _OUT.split(", ")])


class Repaired:
    """Walks an audit along the rows of a conversation and yields the repaired rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.made = audit, 0, 0
        # an odd number of rows begins with the system's
        self.odd = (len(audit) - audit.count("D")) % 2

    def _role(self) -> str:
        role = "assistant" if (self.made - self.odd) % 2 else "user"
        self.made += 1
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._role(), ""

    def next(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.made += 1
            yield role, text
        elif letter == "R":
            yield self._role(), text


def repaired(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of ``folds`` with the hash of the repaired conversation, texts streamed by."""
    order = ["conv_id", "kind", "turn", "role", "h1", "h2"]
    stats = [f.name for f in _FOLDED_ARROW if f.name not in ("conv_id", "dead")]
    heads = folds.select("conv_id", F.lit(0).alias("kind"), F.struct(*stats).alias("fold"))
    lines = rows.where("NOT gone").select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit("row"), "text", "role").alias("h2"),
    )
    both = heads.unionByName(lines, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = conv = walk = digest = None
        empty, out = True, []

        def write(made) -> None:
            nonlocal empty
            for role, text in made:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False

        def close() -> None:
            if fold is not None:
                write(walk.inserted())
                out.append((conv, *fold.values(), digest.hexdigest()))

        for batch in batches:
            for here, kind, head, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                if kind == 0:
                    close()
                    conv, fold, walk, digest, empty = here, head, Repaired(head["audit"]), hashlib.sha256(), True
                else:
                    write(walk.next(role, text))
            if len(out) >= 1024:
                yield _arrow(out, _OUT_ARROW)
                out = []
        close()
        if out:
            yield _arrow(out, _OUT_ARROW)

    ship_package(rows.sparkSession)
    return both.select("conv_id", "kind", "fold", "role", "text").mapInArrow(run, _OUT)


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cheapest repair and hash of every conversation in ``rows``.

    ``rows`` has conv_id, turn, role, text and ``gone`` (rows that only keep their
    conversation in the result).  Rows are taken by turn, nulls first; ties by role, then by
    hash of role and text, so equal rows stand side by side and the result does not depend on
    the input's order.  Null role and text count as one space; a null conv_id is a
    conversation of its own.  Without rows: zeros, '' and the hash of nothing.  Further columns
    are not read.  A conversation of any length is solved in pieces by many tasks; its audit
    (one character an edit) and the hash of its text, which has no parallel form, are made by
    one task that holds the audit but streams the rows.
    """
    rows = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone"
    )
    folds = stored(_folds(stored(_pieces(_coded(rows)))))
    return repaired(rows, folds)
