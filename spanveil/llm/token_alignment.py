"""Alignment of two tokenizers' tokens over the same bytes, with an identity fast path.

A document is encoded once by both tokenizers.  Byte offsets where a token of each ends
cut it into groups.  Nearly all groups hold one token of each, with the same bytes: for
them a table made once gives the B id of an A id, so that a vector of the length of A's
vocabulary counts them.  Only links of other groups travel as (A id, B id) pairs.

Neither tokenizer joins characters across a blank or line break that stands between
visible characters, or between a word and the sign that ends it where no piece of B has both.
So a text falls into units there, and the groups of a unit are found once per worker; a text
with other white space is encoded whole.

1. ``encoded``: per document the distinct ids and counts of its identity groups and of
   its irregular pairs, written once to the shared folder.
2. Identity groups are summed in one vector a task; pairs are summed by a group-by.
   Both bring the highest count of each B id.
3. Documents read their counts: identity groups and the frequent pairs from vectors and
   a table of at most ``1 / FREQUENT`` pairs, the rest by a join on the pair.  A pair of
   the join holds less than ``FREQUENT`` of all irregular links, so no key is hot.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import map_arrow, slices, stored, texts
from spanveil.session import ship_package

#: Units after which a worker's memory begins anew.
REMEMBERED = 400_000
#: Units encoded in one piece, and characters of the longest that is remembered.
TOGETHER = 5_000
LONGEST_UNIT = 512
#: Signs that may be cut off the end of a word, where no piece of B joins a word and the sign.
_SIGNS = ".,;:!?"
_LETTER = "[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]"
#: Cuts are made only beside letters, digits and ASCII signs.
_SAFE = re.compile(r" ?[\w!-~](?:.*[\w!-~])?\Z", re.S)
#: Share of all irregular links from which a pair counts as frequent.
FREQUENT = 1 / 65_536
_SHIFT = 32


def byte_table() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    Latin-1's printable ones stand for themselves, the rest for U+0100 onwards."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteLevel:
    """Tokenizer A: a byte-level ``tokenizers`` file; encodes a blank and the text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.made = Tokenizer.from_file(path)
        self.made.no_truncation()
        self.made.no_padding()
        self.made.encode_special_tokens = True
        table = byte_table()
        self.size = self.made.get_vocab_size(with_added_tokens=True)
        entries = [self.made.id_to_token(i) or "" for i in range(self.size)]
        special = {i for i, t in self.made.get_added_tokens_decoder().items()}
        self.bytes = [
            t.encode() if i in special else bytes(table[c] for c in t) for i, t in enumerate(entries)
        ]

    def encode(self, values: list[str]) -> list[list[int]]:
        """Ids of texts that already begin with their blank."""
        return [e.ids for e in self.made.encode_batch_fast(values, add_special_tokens=False)]


class Pieces:
    """Tokenizer B: a sentencepiece model, which adds the blank itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.made = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.made.get_piece_size()
        self.normal = np.zeros(self.size, bool)
        self.bytes = []
        for i in range(self.size):
            piece = self.made.id_to_piece(i)
            if self.made.is_byte(i):
                self.bytes.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
                self.normal[i] = not (self.made.is_control(i) or self.made.is_unknown(i))
        line = self.made.encode("\n")
        # no piece joins a visible character and a following blank, or anything and a break
        crossing = any(
            "▁" in p.lstrip("▁") or "\n" in p
            for p in (self.made.id_to_piece(i) for i in np.flatnonzero(self.normal).tolist())
        )
        pieces = [self.made.id_to_piece(i) for i in np.flatnonzero(self.normal).tolist()]
        joined = {m for p in pieces for m in re.findall(rf"{_LETTER}([{_SIGNS}])", p)}
        signs = "".join(c for c in _SIGNS if c not in joined)
        word = rf" ?[^ \n]*{_LETTER}(?=[{signs}]+(?![^ \n]))|" if signs else ""
        self.unit = re.compile(rf"{word} ?[^ \n]+|\n")
        self.cuts = not crossing and [self.bytes[i] for i in line] == [b" ", b"\n"]

    def encode(self, values: list[str]) -> list[list[int]]:
        return self.made.encode(values, num_threads=1)


class Aligner:
    """Both tokenizers and the identity table from A ids to B ids (-1: none)."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        by_bytes: dict[bytes, int] = {}
        for i in range(self.b.size):
            known = by_bytes.get(self.b.bytes[i])
            if known is None or (self.b.normal[i] and not self.b.normal[known]):
                by_bytes[self.b.bytes[i]] = i
        self.identity = np.array([by_bytes.get(x, -1) if x else -1 for x in self.a.bytes], np.int64)
        self.a_length = np.array([len(x) for x in self.a.bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b.bytes], np.int64)
        self.same_as = self.identity.tolist()
        self.one = [f"{i}|{k}" for i, k in enumerate(self.same_as)]
        self.plain = all(self.a.bytes) and all(self.b.bytes)
        self.forget()

    def forget(self) -> None:
        """Begin the memory of units anew: their places in columns of counts and lists."""
        self.place: dict[str, int] = {}
        self.shown: list[str] = []
        # n_a, n_b, groups, links, characters, whether it may be used, is a break, begins blank
        self.facts = np.zeros((8, 0), np.int64)
        self.same, self.pairs = _Lists(), _Lists()

    def groups(self, whole: str, a: list[int], b: list[int]):
        """Place of the last A and B token of every group, which groups are regular, and
        their texts and pairs; None where the tokens do not restore the text."""
        data = whole.encode()
        if b"".join(map(self.a.bytes.__getitem__, a)) != data or b"".join(map(self.b.bytes.__getitem__, b)) != data:
            return None
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
        cuts = np.intersect1d(a_ends, b_ends)
        # tokens of no bytes end where their neighbour does and belong to the same group
        a_last = np.searchsorted(a_ends, cuts, "right") - 1
        b_last = np.searchsorted(b_ends, cuts, "right") - 1
        a_many, b_many = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        regular = (a_many == 1) & (b_many == 1)
        regular &= self.identity[a_ids[a_last]] == b_ids[b_last]
        a_from, b_from = np.searchsorted(a_ends, cuts, "left"), np.searchsorted(b_ends, cuts, "left")
        links = (a_last - a_from + 1) * (b_last - b_from + 1)
        last = a_ids[a_last]
        parts = list(map(self.one.__getitem__, last.tolist()))
        pairs = []
        for g in np.flatnonzero(~regular).tolist():
            i, k = int(a_last[g]), int(b_last[g])
            parts[g] = (
                ",".join(map(str, a[i - int(a_many[g]) + 1:i + 1])) + "|" + ",".join(map(str, b[k - int(b_many[g]) + 1:k + 1]))
            )
            pairs.append([(x << _SHIFT) | y for x in a[a_from[g]:i + 1] for y in b[b_from[g]:k + 1]])
        return cuts, a_last, b_last, regular, links, parts, last[regular].tolist(), pairs

    def align(self, whole: str, a: list[int], b: list[int]) -> tuple | None:
        """Record of a text with its blank: groups, n_a, n_b, n_groups, n_links, identity
        ids, irregular pairs; None where the tokens do not restore it."""
        found = self.groups(whole, a, b)
        if found is None:
            return None
        _, _, _, _, links, parts, same, pairs = found
        return ";".join(parts), len(a), len(b), len(parts), int(links.sum()), same, list(chain.from_iterable(pairs))

    def _text(self, text: str) -> tuple | None:
        return self.align(" " + text, *self.a.encode([" " + text]), *self.b.encode([text])) if text else None

    def _together(self, units: list[str], lead: str) -> list[tuple | None]:
        """Records of units that are encoded as one text, each behind ``lead``."""
        whole = "".join([lead + u for u in units])
        a = self.a.encode([whole])[0]
        b = self.b.encode([whole if lead else whole[1:]])[0]
        if lead:
            b = b[1:]  # the blank that B adds
        found = self.groups(whole, a, b)
        ends = np.cumsum([len((lead + u).encode()) for u in units])
        if found is None or not np.isin(ends, found[0], assume_unique=True).all():
            # one unit that is not restored must not spoil the others
            half = len(units) // 2
            return self._together(units[:half], lead) + self._together(units[half:], lead) if half else [None]
        # without empty tokens every group has one link
        cuts, a_last, b_last, regular, _, parts, same, pairs = found
        odd = list(chain.from_iterable(pairs))
        behind = np.searchsorted(cuts, ends) + 1
        n_a, n_b = np.diff(a_last[behind - 1], prepend=-1).tolist(), np.diff(b_last[behind - 1], prepend=-1).tolist()
        skip = len(lead)  # it is a group of its own at the front
        ends_, same_to = behind.tolist(), np.cumsum(np.append(0, regular))
        begins = [0, *ends_[:-1]]
        begins = [x + skip for x in begins] if skip else begins
        s_from, s_to = same_to[begins].tolist(), same_to[ends_].tolist()
        return [
            (";".join(parts[x:y]), na - skip, nb - skip, y - x, y - x, same[s:e], odd[x - s:y - e])
            for x, y, na, nb, s, e in zip(begins, ends_, n_a, n_b, s_from, s_to)
        ]

    def learn(self, units: list[str]) -> None:
        """Remember units; those whose texts must be encoded whole as not usable."""
        known: dict[str, tuple | None] = dict.fromkeys(units)
        new = [u for u in units if len(u) <= LONGEST_UNIT and _SAFE.match(u)]
        if "\n" in known:
            known["\n"] = self.align("\n", self.a.encode(["\n"])[0], self.b.encode(["\n"])[0][1:])
        for lead in ("", "\n"):
            # units with a blank, and those behind a line break
            some = [u for u in new if (u[0] == " ") == (lead == "")]
            for i in range(0, len(some), TOGETHER):
                piece = some[i:i + TOGETHER]
                known.update(zip(piece, self._together(piece, lead)))
        first = len(self.place)
        self.place.update((u, first + i) for i, u in enumerate(known))
        none = ("", 0, 0, 0, 0, (), ())
        records = [r or none for r in known.values()]
        self.shown += [r[0] for r in records]
        facts = [
            *[np.array([r[k] for r in records], np.int64) for k in range(1, 5)],
            np.array([len(u) for u in known], np.int64), np.array([r is not None for r in known.values()], np.int64),
            np.array([u == "\n" for u in known], np.int64), np.array([u[0] in " \n" for u in known], np.int64),
        ]
        self.facts = np.concatenate([self.facts, np.stack(facts)], axis=1)
        self.same.add([r[5] for r in records])
        self.pairs.add([r[6] for r in records])

    def batch(self, values: list[str]) -> tuple:
        """Columns of ``ENCODED`` but ``doc_id`` for some texts."""
        n = len(values)
        by_units = self.plain and self.b.cuts
        units = [self.b.unit.findall(" " + v) if v and by_units else [] for v in values]
        flat = list(chain.from_iterable(units))
        new = set(flat).difference(self.place)
        if len(self.place) + len(new) > REMEMBERED:
            self.forget()
            new = set(flat)
        if new:
            self.learn(list(new))
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        many = np.array(list(map(len, units)), np.int64)
        doc = np.repeat(np.arange(n), many)
        sums = np.stack([np.bincount(doc, self.facts[k][at], n) for k in range(5)]).astype(np.int64)
        # a text is cut only if its units make it up and white space stands alone
        usable, line, blank = (self.facts[k][at] for k in (5, 6, 7))
        bad = usable == 0
        bad[:-1] |= (line[:-1] & blank[1:] & (doc[:-1] == doc[1:])).astype(bool)
        whole = (many == 0) | (np.bincount(doc, bad, n) > 0) | (sums[4] != np.array([len(v) + 1 for v in values], np.int64))
        sums = sums[:4]
        sums[:, whole] = 0
        ends, places = np.cumsum(many).tolist(), at.tolist()
        shown = self.shown.__getitem__
        texts_ = [
            "" if w else ";".join(map(shown, places[e - m:e])) for w, m, e in zip(whole.tolist(), many.tolist(), ends)
        ]
        keep = ~whole[doc]
        same, pairs = ([held.gathered(at[keep], doc[keep])] for held in (self.same, self.pairs))
        for i in np.flatnonzero(whole).tolist():
            r = self._text(values[i])
            if r is not None:
                texts_[i], sums[:, i] = r[0], r[1:5]
                same.append((np.full(len(r[5]), i), np.array(r[5], np.int64)))
                pairs.append((np.full(len(r[6]), i), np.array(r[6], np.int64)))
        digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts_]
        return sums, digests, _counted(same, n), _counted(pairs, n)


class _Lists:
    """Lists of numbers end to end."""

    def __init__(self) -> None:
        self.size, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.begin = self.size

    def add(self, lists: list) -> None:
        size = np.array(list(map(len, lists)), np.int64)
        values = np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum()))
        self.size, self.values = np.append(self.size, size), np.append(self.values, values)
        self.begin = np.cumsum(self.size) - self.size

    def gathered(self, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, value) for the values of the lists at some places."""
        n = self.size[at]
        where = np.arange(int(n.sum())) + np.repeat(self.begin[at] - (np.cumsum(n) - n), n)
        return np.repeat(doc, n), self.values[where]


def _counted(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the documents' lists, distinct values and their counts."""
    doc, value = (np.concatenate(x) for x in zip(*parts))
    kinds, place = np.unique(value, return_inverse=True)
    key, times = np.unique(doc * max(len(kinds), 1) + place, return_counts=True)
    of = key // max(len(kinds), 1)
    ends = np.append(0, np.cumsum(np.bincount(of, minlength=n)))
    return ends, kinds[key % max(len(kinds), 1)], times


@lru_cache(2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


ENCODED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "same array<int>, same_n array<int>, pairs array<long>, pairs_n array<int>"
)


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document with ``ENCODED`` columns; a pair is A id * 2**32 + B id."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums, digests, same, pairs = aligner(a_path, b_path).batch([t.decode("utf-8") for t in texts(batch.column(1))])
        listed = lambda ends, flat, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat).cast(kind))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), *[pa.array(row) for row in sums], pa.array(digests, pa.string()),
                listed(same[0], same[1], pa.int32()), listed(same[0], same[2], pa.int32()),
                listed(pairs[0], pairs[1], pa.int64()), listed(pairs[0], pairs[2], pa.int32()),
            ],
            [c.split()[0] for c in ENCODED.split(", ")],
        )

    return map_arrow(docs, ["doc_id", "text"], ENCODED, work)


def _vector(rows: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(id, n): occurrences of each A id in identity groups, one vector a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(aligner(a_path, b_path).a.size, np.int64)
        for batch in batches:
            ids = batch.column(0).flatten().to_numpy()
            counts += np.bincount(ids, batch.column(1).flatten().to_numpy(), len(counts)).astype(np.int64)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["id", "n"])

    ship_package(rows.sparkSession)
    return rows.select("same", "same_n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def link_counts(rows: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """(id, n) of identity links by A id, and (pair, n) of the others."""
    same = stored(_vector(rows, a_path, b_path))
    pairs = rows.select(F.explode_outer(F.arrays_zip("pairs", "pairs_n")).alias("p")).where("p IS NOT NULL")
    pairs = stored(pairs.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pairs_n").alias("n")))
    return same, pairs


def align_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per
    row of ``docs``.

    ``a_path`` is a byte-level file of the tokenizers library, ``b_path`` a sentencepiece
    model; every executor has both.  Texts that are null, empty or not restored by either
    tokenizer have zeros and ''.  ``n_best`` counts links whose pair is, in all documents,
    the most frequent one of its B id (all of them at a tie).  Repeated rows count each; a null
    ``doc_id`` stays null; further columns are not read.  A task holds the tokens of a few
    megabytes of text, or of one longer text.
    """
    rows = stored(encoded(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()))
    same, pairs = link_counts(rows, a_path, b_path)
    made = aligner(a_path, b_path)
    # both vectors have the length of a vocabulary, whatever the corpus
    vector = np.zeros(made.a.size, np.int64)
    for r in same.collect():
        vector[r.id] = r.n
    best = np.zeros(made.b.size, np.int64)
    held = made.identity >= 0
    np.maximum.at(best, made.identity[held], vector[held])
    tops = pairs.groupBy(F.col("pair").bitwiseAND(F.lit(2**_SHIFT - 1)).alias("id")).agg(F.max("n").alias("n"))
    for r in tops.collect():
        best[r.id] = max(best[r.id], r.n)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    # at most 1 / FREQUENT pairs can have this share of the links
    often = pairs.where(F.col("n") >= max(1, total * FREQUENT))
    known = dict(sorted((r.pair, r.n) for r in often.collect()))
    keys = np.fromiter(known.keys(), np.int64, len(known))
    values = np.fromiter(known.values(), np.int64, len(known))
    shared = rows.sparkSession.sparkContext.broadcast((vector, best, keys, values))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, best, keys, values = shared.value
        same_best = (vector == best[np.maximum(made_identity.value, 0)]).astype(np.int64)
        pair_best = (values == best[keys & (2**_SHIFT - 1)]).astype(np.int64)
        for whole in batches:
            for batch in slices(whole):
                yield one(batch, vector, same_best, keys, values, pair_best)

    def sums(column: pa.Array, flat: np.ndarray) -> np.ndarray:
        """Sums of the flattened values of every list."""
        ends = np.cumsum([0, *column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)]).astype(np.int64)
        running = np.concatenate([[0], np.cumsum(flat)])
        return running[ends[1:]] - running[ends[:-1]]

    def one(batch, vector, same_best, keys, values, pair_best) -> pa.RecordBatch:
        row, ids, ids_n, found, found_n = batch.columns
        at, times = ids.flatten().to_numpy(), ids_n.flatten().to_numpy().astype(np.int64)
        count, good = sums(ids, vector[at] * times), sums(ids, same_best[at] * times)
        pair, times = found.flatten().to_numpy(), found_n.flatten().to_numpy().astype(np.int64)
        place = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
        hit = keys[place] == pair if len(keys) else np.zeros(len(pair), bool)
        count += sums(found, np.where(hit, values[place] if len(keys) else 0, 0) * times)
        good += sums(found, np.where(hit, pair_best[place] if len(keys) else 0, 0) * times)
        left = np.concatenate([[0], np.cumsum(~hit)])
        ends = np.cumsum([0, *found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)]).astype(np.int64)
        rest = pa.ListArray.from_arrays(pa.array(left[ends], pa.int32()), pa.array(pair[~hit], pa.int64()))
        rest_n = pa.ListArray.from_arrays(pa.array(left[ends], pa.int32()), pa.array(times[~hit].astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            [row, pa.array(count), pa.array(good), rest, rest_n], ["row", "count", "good", "rest", "rest_n"]
        )

    made_identity = rows.sparkSession.sparkContext.broadcast(made.identity)
    counted = stored(
        rows.select("row", "same", "same_n", "pairs", "pairs_n")
        .mapInArrow(read, "row long, count long, good long, rest array<long>, rest_n array<int>")
    )
    # the highest counts have a vocabulary's length: a bounded broadcast
    highest = rows.sparkSession.createDataFrame(
        [(i, int(n)) for i, n in enumerate(best) if n], "b long, highest long"
    )
    rest = counted.where(F.size("rest") > 0).select(
        "row", F.explode(F.arrays_zip("rest", "rest_n")).alias("p")
    ).select("row", F.col("p.rest").alias("pair"), F.col("p.rest_n").alias("m"))
    rest = (
        rest.join(pairs.hint("merge"), "pair")
        .withColumn("b", F.col("pair").bitwiseAND(F.lit(2**_SHIFT - 1))).join(F.broadcast(highest), "b")
        .groupBy("row").agg(
            F.sum(F.col("m") * F.col("n")).alias("more_count"),
            F.sum(F.when(F.col("n") == F.col("highest"), F.col("m")).otherwise(0)).alias("more_good"),
        )
    )
    counts = counted.select("row", "count", "good").join(rest.hint("merge"), "row", "left")
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(
        counts.hint("merge"), "row"
    ).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("good") + F.coalesce("more_good", F.lit(0))).alias("n_best"),
        (F.col("count") + F.coalesce("more_count", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
