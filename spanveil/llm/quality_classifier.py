"""Compression classifier: zstandard dictionaries of good and bad labelled text.

A text is compressed in pieces once with either dictionary.  The difference of the
two sizes, divided by the text's bytes, goes through a logistic curve fitted on
labelled rows that no dictionary has seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import map_arrow, stored, texts

#: Bytes compressed at a time: small enough for the dictionary to matter.
PIECE = 1024
LEVEL = 3
#: Labelled rows of a class that train a dictionary, and as many that calibrate.
SAMPLE_ROWS = 4000
#: Pieces of a class that go into a dictionary, and its size in bytes.
SAMPLE_PIECES = 6000
DICTIONARY = 112_640


@dataclass(frozen=True)
class Model:
    """Dictionaries (None: nothing to learn from) and the calibration curve."""

    good: bytes | None
    bad: bytes | None
    slope: float
    intercept: float


def _dictionary(pieces: list[bytes]) -> bytes | None:
    import zstandard

    if not pieces:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: it is the dictionary itself
        return b"".join(pieces)[-DICTIONARY:]


class Scorer:
    """Normalised size difference of texts under a model."""

    def __init__(self, model: Model):
        import zstandard

        def compressor(dictionary: bytes):
            held = zstandard.ZstdCompressionDict(dictionary)
            held.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(
                dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
            )

        self.usable = bool(model.good and model.bad)
        if self.usable:
            self.good, self.bad = compressor(model.good), compressor(model.bad)

    def difference(self, text: bytes) -> float:
        """Bytes saved per byte by the good dictionary over the bad one; 0 if empty."""
        if not text or not self.usable:
            return 0.0
        saved = 0
        for i in range(0, len(text), PIECE):
            piece = text[i:i + PIECE]
            saved += len(self.bad.compress(piece)) - len(self.good.compress(piece))
        return saved / len(text)


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve by Newton steps with a light ridge."""
    if len(x) == 0:
        return 0.0, 0.0
    scale = float(np.std(x)) or 1.0
    inputs = np.stack([x / scale, np.ones(len(x))], 1)
    weights = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        gradient = inputs.T @ (y - p) - 1e-3 * weights
        hessian = (inputs * (p * (1 - p))[:, None]).T @ inputs + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        weights = weights + step
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0] / scale), float(weights[1])


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, sample_rows: int = SAMPLE_ROWS, sample_pieces: int = SAMPLE_PIECES
) -> Model:
    """Learn from ``labels`` (doc_id, quality) rows for which ``usable`` holds.

    At most ``sample_rows`` rows a class and role are used, the first by a hash of
    their id, so the choice is the same on every run.  A dictionary is trained on at most
    ``sample_pieces`` pieces of ``PIECE`` bytes of them, the first by a hash of the piece.
    """
    rank = F.xxhash64("doc_id", F.lit("quality"))
    chosen = None
    known = labels.where(usable & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    for quality in (0, 1):
        for role in (0, 1):
            some = known.where((F.col("quality") == quality) & (F.pmod(F.shiftrightunsigned(rank, 7), F.lit(2)) == role))
            some = some.orderBy(rank, "doc_id").limit(sample_rows).withColumn("role", F.lit(role))
            chosen = some if chosen is None else chosen.union(some)
    # bounded by 4 * sample_rows rows of three numbers, so it may be broadcast
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text") != ""))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [
            (t[i:i + PIECE], q) for t, q in zip(texts(batch.column(0)), batch.column(1).to_pylist())
            for i in range(0, len(t), PIECE)
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.int32())], ["piece", "quality"]
        )

    pieces = map_arrow(sample.where("role = 0"), ["text", "quality"], "piece binary, quality int", cut)
    order = F.xxhash64("piece")
    held: list[bytes | None] = []
    for quality in (0, 1):
        rows = pieces.where(F.col("quality") == quality).orderBy(order, "piece").limit(sample_pieces).collect()
        held.append(_dictionary([bytes(r.piece) for r in rows]))
    model = Model(held[1], held[0], 0.0, 0.0)
    marked = _differences(sample.where("role = 1"), ["quality"], model, "quality int, x double").collect()
    x, y = np.array([r.x for r in marked]), np.array([float(r.quality) for r in marked])
    slope, intercept = calibrate(x, y)
    return Model(model.good, model.bad, slope, intercept)


def _differences(docs: DataFrame, columns: list[str], model: Model, schema: str) -> DataFrame:
    held: list[Scorer] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Scorer(model))
        made = [held[0].difference(t) for t in texts(batch.column(len(columns)))]
        names = [*columns, "x"]
        return pa.RecordBatch.from_arrays([*batch.columns[:len(columns)], pa.array(made, pa.float64())], names)

    return map_arrow(docs, [*columns, "text"], schema, work)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document, whole texts, map only.

    Null and empty texts get the curve's value at no difference; without labelled
    rows of both classes every score is that too (0.5 where there are none at all).
    Repeated rows and equal texts get equal scores; further columns are not read.
    """
    found = _differences(docs, ["doc_id"], model, "doc_id long, x double")
    level = F.lit(model.slope) * F.col("x") + F.lit(model.intercept)
    return found.select("doc_id", (1 / (1 + F.exp(-level))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores with the held-out third marked; a null id counts as not held out."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit(docs, labels, ~fold)
    return score(docs, model).select(
        "doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
