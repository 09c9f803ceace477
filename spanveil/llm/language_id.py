"""Language identification by multilingual mixtures.

Each language has a multinomial over hashed byte trigrams.  A document is a mixture
of them: expectation-maximisation estimates the proportions, and languages are
added, largest first, while the likelihood gains more than a penalty per language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import map_arrow, slices, texts
from spanveil.session import ship_package

BUCKETS = 1 << 14
SMOOTHING = 0.05
ROUNDS = 25
#: Nats a further language must gain, times the logarithm of the trigrams.
PENALTY = 3.0
UNKNOWN = "und"

_TO_BLANK = re.compile(rb"[\x00-\x60\x7b-\x7f]+")


def trigrams(text: bytes) -> np.ndarray:
    """Bucket of every byte trigram of the lower-cased letters, words set off by blanks."""
    line = b" " + _TO_BLANK.sub(b" ", text.decode("utf-8", "replace").lower().encode()) + b" "
    raw = np.frombuffer(line, np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    key = raw[:-2] * np.uint32(65536) + raw[1:-1] * np.uint32(256) + raw[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Languages in order of name and the logarithm-free trigram table (languages x buckets)."""

    languages: tuple[str, ...]
    table: np.ndarray

    def mixture(self, counts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the rows of ``table`` and the log-likelihood."""
        share = np.full(len(table), 1 / len(table))
        total = counts.sum()
        mixed = share @ table
        for _ in range(ROUNDS if len(table) > 1 else 0):
            renewed = share * (table @ (counts / mixed)) / total
            done = np.abs(renewed - share).max() < 1e-4
            share = renewed
            mixed = share @ table
            if done:
                break
        return share, float(counts @ np.log(mixed))

    def infer(self, text: bytes) -> dict[str, float]:
        """Proportions of the languages selected for a text; empty if there is no letter."""
        if not self.languages or not any(map(str.isalpha, text.decode("utf-8", "replace"))):
            return {}
        seen = np.bincount(trigrams(text), minlength=BUCKETS)
        used = np.flatnonzero(seen)
        if not len(used):
            return {self.languages[0]: 1.0}
        counts = seen[used].astype(float)
        table = self.table[:, used]
        share, _ = self.mixture(counts, table)
        order = np.argsort(-share, kind="stable")
        single = np.log(table) @ counts
        order = np.concatenate([[int(np.argmax(single))], order[order != int(np.argmax(single))]])
        chosen, best = order[:1], float(single[order[0]])
        shares = np.ones(1)
        price = PENALTY * np.log(counts.sum() + 1)
        for k in range(2, len(order) + 1):
            tried, level = self.mixture(counts, table[order[:k]])
            if level - price <= best:
                break
            chosen, shares, best = order[:k], tried, level
        return {self.languages[i]: float(s) for i, s in zip(chosen, shares)}


def fit(docs: DataFrame, usable: Column) -> Model:
    """Trigram counts of all rows with a language for which ``usable`` holds.

    Counts are summed per task before they are shuffled; the driver receives
    languages x buckets numbers, whatever the input's size.
    """
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                for text, language in zip(texts(part.column(0)), part.column(1).to_pylist()):
                    counts = held.setdefault(language, np.zeros(BUCKETS, np.int64))
                    counts += np.bincount(trigrams(text), minlength=BUCKETS)
        for language, counts in held.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(used), pa.string()), pa.array(used), pa.array(counts[used])],
                ["lang", "bucket", "n"],
            )

    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = sums.toPandas()
    languages = tuple(sorted(rows["lang"].unique()))
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    for i, language in enumerate(languages):
        own = rows[rows["lang"] == language]
        table[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return Model(languages, table / table.sum(1, keepdims=True) if len(languages) else table)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, languages) of every document; map only.

    ``score`` is the share of the largest language.  Null, empty and letterless texts
    are ``und`` with score 0, and so is everything if nothing was learned.  Ties go to
    the language first in order; repeated rows are judged each; further columns are
    not read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [model.infer(t) for t in texts(batch.column(1))]
        best = [min(m.items(), key=lambda x: (-x[1], x[0])) if m else (UNKNOWN, 0.0) for m in found]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([b[0] for b in best], pa.string()),
                pa.array([min(1.0, b[1]) for b in best], pa.float64()),
                pa.array([sorted(m.items()) for m in found], pa.map_(pa.string(), pa.float64())),
            ],
            ["doc_id", "lang_pred", "score", "languages"],
        )

    schema = "doc_id long, lang_pred string, score double, languages map<string,double>"
    return map_arrow(docs, ["doc_id", "text"], schema, work)


def identify(docs: DataFrame) -> DataFrame:
    """Predictions with the held-out quarter marked; a null id counts as not held out."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs, ~fold)
    return predict(docs, model).select(
        "doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


#: Least share of the largest language of a document that is kept.
LEAST_SHARE = 0.5


def with_known_language(docs: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """``docs`` without those that are ``und`` or have no language of at least ``least``.

    Learns from every row with a language.  All columns stay, nothing is shuffled.  Null,
    empty and letterless texts go; repeated rows stay or go together; a share of exactly
    ``least`` stays.
    """
    model = fit(docs, F.lit(True))
    place = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [max(model.infer(t).values(), default=0.0) >= least for t in texts(batch.column(place))]
        return batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, docs.columns, docs.schema, work)
