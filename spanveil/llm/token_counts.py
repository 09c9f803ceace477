"""Token counts of whole texts, huge ones by overlapping chunks.

A text up to ``chunk`` characters is encoded whole.  Where a tokenizer drops white space
before it merges, which is tried when it is loaded, such a text is cut at ASCII blanks instead
and every distinct word is encoded once per worker.  A larger text is encoded in overlapping
chunks with offsets.  Two neighbours are spliced inside their overlap at a border of
pre-tokens that both report, if they agree on the tokens around it; while none is found the
overlap is widened, then the chunk doubled, at the last to the end of the text.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanveil.llm.common import BLANKS, map_arrow, texts

CHUNK = 32_768
OVERLAP = 512
#: Words remembered by a worker; the memory starts anew when it is full.
REMEMBERED = 400_000
#: Tokens on either side of a splice on which both chunks must agree.
AGREE = 3

#: Words that a tokenizer must count alike alone and between blanks to be cut there.
_PROBES = ("the", "Cat", "it's", "42", "naïve", "x,y.", "<|endoftext|>", "日本", "\U0001f600", "a_b-c")


@lru_cache(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


class Counter:
    """Counts tokens with one tokenizer file."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer = tokenizer(path)
        self.chunk, self.overlap = chunk, overlap
        self.memory: dict[bytes, int] = {}
        self.by_words = self._drops_blanks()

    def _drops_blanks(self) -> bool:
        """Whether no token reaches across or consists of ASCII blanks."""
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        alone = {w: ids(w) for w in _PROBES}
        return all(
            ids(f"{b}{one}{b}{two}{b}{b}") == alone[one] + alone[two]
            for b in (chr(x) for x in BLANKS) for one, two in zip(_PROBES, _PROBES[1:] + _PROBES[:1])
        )

    def learn(self, words: set[bytes]) -> None:
        if len(self.memory) + len(words) > REMEMBERED:
            self.memory.clear()
        new = list(words - self.memory.keys())
        for i in range(0, len(new), 20_000):
            some = new[i:i + 20_000]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in some], add_special_tokens=False)
            self.memory.update(zip(some, map(len, found)))

    def counts(self, values: list[bytes]) -> list[int]:
        """Tokens of every text."""
        if not self.by_words:
            short = [i for i, v in enumerate(values) if len(v) <= self.chunk]
            made = self.tokenizer.encode_batch_fast([values[i].decode("utf-8") for i in short], add_special_tokens=False)
            known = dict(zip(short, map(len, made)))
            return [known[i] if i in known else self.spliced(v.decode("utf-8"))[0] for i, v in enumerate(values)]
        whole = [None if len(v) > self.chunk else v.split() for v in values]
        self.learn({w for words in whole if words for w in words})
        get = self.memory.__getitem__
        return [
            self.spliced(v.decode("utf-8"))[0] if words is None else sum(map(get, words))
            for v, words in zip(values, whole)
        ]

    def encode(self, text: str, start: int, stop: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a chunk, absolute character offsets, and which tokens begin a pre-token."""
        made = self.tokenizer.encode(text[start:stop], add_special_tokens=False)
        at = np.array(made.offsets, np.int64).reshape(-1, 2) + start
        words = np.array([-1 if w is None else w for w in made.word_ids], np.int64)
        return made.ids, at[:, 0], at[:, 1], np.diff(words, prepend=-2) != 0

    def spliced(self, text: str) -> tuple[int, list[int]]:
        """Tokens of a text of any size, and the places of its splices."""
        size, total, splices, width = len(text), 0, [], self.chunk
        start, begin = 0, 0  # of the chunk; of the tokens of it not yet counted
        stop = min(size, width)
        one = self.encode(text, start, stop)
        while stop < size:
            borders = one[1][one[3]]
            borders = borders[borders > one[1][begin]] if begin < len(one[1]) else borders[:0]
            # the overlap reaches back behind the last border; without one a wider chunk is needed
            overlap = max(self.overlap, stop - int(borders[-1]) + self.overlap) if len(borders) else 0
            cut = None
            while overlap:
                follow = max(start + 1, stop - overlap)
                reach = min(size, follow + max(self.chunk, 2 * overlap))
                other = self.encode(text, follow, reach)
                cut = self._splice(one, other, follow, stop, begin)
                if cut is not None or follow <= start + 1:
                    break
                overlap *= 4
            if cut is None:
                # no common border as far back as the chunk begins: take it twice as long
                width *= 2
                stop = min(size, start + width)
                one = self.encode(text, start, stop)
                continue
            at = max(begin, int(np.searchsorted(one[1], cut)))
            total += at - begin
            splices.append(cut)
            one, width = other, self.chunk
            begin = int(np.searchsorted(other[1], cut))
            start, stop = follow, reach
        return total + len(one[0]) - begin, splices

    def _splice(self, one, two, follow: int, stop: int, begin: int) -> int | None:
        """A border in the middle of the overlap at which both encodings are in step."""
        ids1, left1, right1, word1 = one
        ids2, left2, right2, word2 = two
        middle = (follow + stop) // 2
        inner = lambda left, word: left[word & (left > follow) & (left < stop - 1)]
        cuts = np.intersect1d(inner(left1, word1), inner(left2, word2))
        for cut in cuts[np.argsort(np.abs(cuts - middle), kind="stable")].tolist():
            i, j = int(np.searchsorted(left1, cut)), int(np.searchsorted(left2, cut))
            if i <= begin or (i and right1[i - 1] > cut) or (j and right2[j - 1] > cut):
                continue
            before = min(AGREE, i - begin, j)
            after = min(AGREE, len(ids1) - i, len(ids2) - j)
            if before < 1 or after < 1:
                continue
            # the last tokens may belong to a word that the chunk's end cut, the first ones to
            # one that its beginning cut: whole pre-tokens must lie between them and the border
            same = (
                list(ids1[i - before:i + after]) == list(ids2[j - before:j + after])
                and np.array_equal(left1[i - before + 1:i + after], left2[j - before + 1:j + after])
                and right1[i + after - 1] < stop and word1[i + 1:].any()
                and left2[j - before] > follow and word2[1:j].any()
            )
            if same:
                return cut
        return None


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Bytes and tokens of every document, one row each; map only.

    ``path`` is a tokenizer file present on every executor.  Null and empty texts
    have 0 tokens; a null ``doc_id`` stays null; repeated rows are counted each;
    further columns are not read.  ``chunk`` and ``overlap`` change memory, not
    results: encodings of a huge text are held for one or two chunks at a time.
    """

    held: dict[str, Counter] = {}

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if path not in held:
            held[path] = Counter(path, chunk, overlap)
        values = texts(batch.column(1))
        counts = held[path].counts(values)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([len(v) for v in values], pa.int64()), pa.array(counts, pa.int64()),
                pa.array([c > limit for c in counts], pa.bool_()),
            ],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_arrow(docs, ["doc_id", "text"], SCHEMA, work)
