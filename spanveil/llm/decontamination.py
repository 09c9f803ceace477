"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

The CGK walk reads a window of words: at each step it writes the word under the
pointer and a random bit of (step, word) says whether the pointer moves on, so two
windows a few edits apart fall back into step and their embeddings differ in few
places.  A repetition samples some steps of the embedding as a hash key; windows of
the size of an item whose key is that of the item are candidates, and word edit
distance decides.  Half the repetitions walk from a window's first word forwards,
half from its last word backwards, so edits near one end cost no recall.  In long items
walks are short and begin at several places, as offsets left by edits add up along a
walk; the edit distance then counts both ways from that place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import LOWER, Words, map_arrow, mixed

#: Edits allowed, as a share of the item's words.
EDITS = 0.1
#: Repetitions (half per direction) and sampled steps of one; see the recall test.
REPETITIONS = 24
SAMPLED = 4
#: Steps of a walk, at most, and places of a longer item at which walks begin.
STRETCH = 32
PLACES = 4
#: Bytes of item text indexed at a time; every further block reads the documents again.
BLOCK_BYTES = 1 << 20

_PAD, _OTHER = 0, 1
_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[48:58] = _WORD_BYTES[97:123] = _WORD_BYTES[128:] = True


def bound(n: int, edits: float = EDITS) -> int:
    return int(n * edits + 1e-9)


def _ladder(n: int) -> int:
    """Smallest size of the class of items with n words: powers of two."""
    return 1 << (n.bit_length() - 1)


@dataclass
class Table:
    """One repetition over the items of a class."""

    steps: np.ndarray  # sampled steps, ascending
    forward: bool
    seed: int  # of the random moves
    allowed: list[np.ndarray]  # per sampled step the symbols that items have there
    keys: np.ndarray  # ascending
    items: np.ndarray
    offset: int = 0  # words of an item before (behind) the first one walked

    def moves(self, size: int) -> list[np.ndarray]:
        """64-bit words of random bits for every symbol, a bit per step; a pad never moves."""
        symbol = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        words = range(int(self.steps[-1]) // 64 + 1)
        made = [mixed(symbol + np.uint64(self.seed) + np.uint64(w)) for w in words]
        for word in made:
            word[_PAD] = 0
        return made

    def walk(self, symbols: np.ndarray, at: np.ndarray, filtered: bool) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``at`` that may match, by index, and their keys."""
        which, pos = np.arange(len(at)), at.copy()
        key = np.zeros(len(at), np.uint64)
        sample, bits = 0, self.moves(len(self.allowed[0]))
        for step in range(int(self.steps[-1]) + 1):
            here = symbols[pos]
            if step == self.steps[sample]:
                if filtered:
                    keep = np.flatnonzero(self.allowed[sample][here])
                    which, pos, key, here = which[keep], pos[keep], key[keep], here[keep]
                    if not len(which):
                        break
                else:
                    self.allowed[sample][here] = True
                key = mixed(key + here.astype(np.uint64) + np.uint64(1))
                sample += 1
            move = (bits[step >> 6][here] >> np.uint64(step & 63)) & np.uint64(1)
            pos = pos + move.astype(np.int64) if self.forward else pos - move.astype(np.int64)
        return which, key


class Index:
    """LSH tables over a block of items."""

    def __init__(self, ids: list[int], values: list[str], edits: float = EDITS, repetitions: int = REPETITIONS, sampled: int = SAMPLED, seed: int = 42):
        words = _words(pa.array(values, pa.string()))
        self.ids = np.array(ids, np.int64)
        self.edits = edits
        self.vocabulary = np.unique(words.codes)
        self.items = [words.codes[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        symbols = np.searchsorted(self.vocabulary, words.codes) + 2
        # one bit per hash bucket tells most foreign words apart without a search
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        rng = np.random.default_rng(seed)
        sizes = np.array([len(i) for i in self.items])
        self.classes: dict[int, tuple[int, int, list[Table]]] = {}
        for low in sorted({_ladder(int(n)) for n in sizes if n}):
            own = np.flatnonzero((sizes >= low) & (sizes < 2 * low))
            self.classes[low] = (
                int(sizes[own].min()), bound(int(sizes[own].max()), edits),
                [self._table(rng, low, own, symbols, words.first, r % 2 == 0, sampled, r // 2) for r in range(repetitions)],
            )

    def _table(self, rng, low: int, own: np.ndarray, symbols: np.ndarray, first: np.ndarray, forward: bool, sampled: int, turn: int) -> Table:
        length = max(min(low, STRETCH), sampled)
        offset = max(low - length, 0) * (turn % PLACES) // (PLACES - 1)
        parts = np.array_split(np.arange(length), sampled)
        steps = np.array([rng.choice(p) for p in parts])
        size = len(self.vocabulary) + 2
        table = Table(steps, forward, int(rng.integers(2**62)), [np.zeros(size, bool) for _ in steps], np.zeros(0, np.uint64), own, offset)
        padded, starts, ends = _padded(symbols, first)
        _, keys = table.walk(padded, (starts + offset if forward else ends - 1 - offset)[own], False)
        order = np.argsort(keys, kind="stable")
        table.keys, table.items = keys[order], own[order]
        return table

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), _OTHER, np.int64)
        some = np.flatnonzero(self.sieve[(codes >> np.uint64(44)).astype(np.int64)])
        place = np.searchsorted(self.vocabulary, codes[some])
        place[place == len(self.vocabulary)] = 0
        hit = self.vocabulary[place] == codes[some]
        out[some[hit]] = place[hit] + 2
        return out

    def candidates(self, words: Words) -> np.ndarray:
        """Rows (word, item, forwards, offset): the word stands at that offset from the
        first word of the item, or from its last."""
        padded, starts, _ = _padded(self.symbols(words.codes), words.first)
        row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        slot = np.arange(len(words)) + row + 1  # of every word in ``padded``
        known = np.concatenate([[0], np.cumsum(padded > _OTHER)])
        found = []
        for shortest, edits, tables in self.classes.values():
            for forward, offset in sorted({(t.forward, t.offset) for t in tables}, reverse=True):
                # of the first words of an occurrence no more than the edits are foreign
                need = max(1, shortest - offset - edits)
                low = slot if forward else np.maximum(slot - need + 1, 0)
                high = np.minimum(slot + need, len(padded)) if forward else slot + 1
                at = np.flatnonzero(known[high] - known[low] >= need - edits)
                for table in tables:
                    if (table.forward, table.offset) == (forward, offset) and len(at):
                        which, keys = table.walk(padded, slot[at], True)
                        lo = np.searchsorted(table.keys, keys, "left")
                        n = np.searchsorted(table.keys, keys, "right") - lo
                        hits = np.flatnonzero(n)
                        for w, a, c in zip(at[which[hits]], lo[hits], n[hits]):
                            found += [(w, i, forward, offset) for i in table.items[a:a + c]]
        return np.unique(np.array(found, np.int64).reshape(-1, 4), axis=0)

    def matches(self, words: Words) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Best (distance, first word, words) of every (row, item) within the bound."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for word, item, forward, offset in self.candidates(words).tolist():
            row = int(np.searchsorted(words.first, word, "right")) - 1
            begin, end = int(words.first[row]), int(words.first[row + 1])
            target = self.items[item]
            limit = bound(len(target), self.edits)
            # the item is cut at the word, and each piece is compared away from the cut
            cut, at = (offset, word) if forward else (len(target) - offset, word + 1)
            behind, after = edit_distance(target[cut:], words.codes[at:min(end, at + len(target) - cut + limit)], limit)
            if behind > limit:
                continue
            before, ahead = edit_distance(target[:cut][::-1], words.codes[max(begin, at - cut - limit):at][::-1], limit - behind)
            distance, start, used = behind + before, at - ahead, ahead + after
            if distance <= limit:
                now = (distance, start - begin, used)
                best[row, item] = min(best.get((row, item), now), now)
        return best


def _padded(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with a pad before, between and after rows; first and past-last slot of each row."""
    rows = len(first) - 1
    out = np.zeros(len(symbols) + rows + 1, np.int64)
    out[np.arange(len(symbols)) + np.repeat(np.arange(rows), np.diff(first)) + 1] = symbols
    shift = np.arange(rows) + 1
    return out, first[:-1] + shift, first[1:] + shift


def edit_distance(target: np.ndarray, text: np.ndarray, limit: int) -> tuple[int, int]:
    """Smallest word edit distance of ``target`` to a prefix of ``text``, and its length."""
    n = len(target)
    if len(text) >= n and np.array_equal(text[:n], target):
        return 0, n
    steps = np.arange(len(text) + 1)
    row = steps.copy()
    for i in range(n):
        moved = np.empty_like(row)
        moved[0] = row[0] + 1
        moved[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != target[i]))
        row = np.minimum.accumulate(moved - steps) + steps  # insertions
        if row.min() > limit:
            return limit + 1, 0
    used = int(np.argmin(row))
    return int(row[used]), used


def _words(column: pa.Array) -> Words:
    return Words(column, ~_WORD_BYTES, fold=LOWER)


def indexes(benchmark: DataFrame, edits: float = EDITS, repetitions: int = REPETITIONS, sampled: int = SAMPLED, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """Indexes over blocks of the items; a block's text has a bounded size."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = part.orderBy("item_id", "text").collect()
        if rows:
            yield Index([r.item_id for r in rows], [r.text for r in rows], edits, repetitions, sampled)


SCHEMA = "doc_id long, item_id long, first_word long, n_words long, distance long"


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance): the best place of every item in
    every document that holds it within the edit bound; map only.

    Words are lower-case runs of letters, digits and non-ASCII characters, so case and
    punctuation are no edits.  Items without words match nothing, items of fewer than
    ten words match exactly; null and empty texts hold nothing; repeated rows and equal
    items report each; a null ``doc_id`` stays null; further columns are not read.
    """

    def with_index(index: Index):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            words = _words(batch.column(1))
            found = index.matches(words)
            if not found:
                return None
            keys = sorted(found)
            rows = [found[k] for k in keys]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([k[0] for k in keys], pa.int64())),
                    pa.array(index.ids[[k[1] for k in keys]]),
                    pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                    pa.array([r[0] for r in rows], pa.int64()),
                ],
                ["doc_id", "item_id", "first_word", "n_words", "distance"],
            )

        return map_arrow(docs, ["doc_id", "text"], SCHEMA, work)

    out = None
    for index in indexes(benchmark, **options):
        part = with_index(index)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` less those that hold an item; all columns stay, nothing is shuffled.

    Null and empty texts hold none and stay; repeated rows stay or go together; an edit
    distance of exactly the bound counts as held; without items every document stays.
    """

    def with_index(docs: DataFrame, index: Index) -> DataFrame:
        place = docs.columns.index("text")

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = np.ones(batch.num_rows, bool)
            keep[[k[0] for k in index.matches(_words(batch.column(place)))]] = False
            return batch.filter(pa.array(keep))

        return map_arrow(docs, docs.columns, docs.schema, work)

    for index in indexes(benchmark, **options):
        docs = with_index(docs, index)
    return docs
