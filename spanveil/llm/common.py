"""Shared pieces: running Python over text partitions, words as numpy arrays, shared folders."""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanveil.session import require_local, ship_package

#: ASCII white space, the separators of most word definitions here.
BLANKS = b" \t\n\x0b\x0c\r"

_SLICE = 1 << 20
_BYTE_CODES = np.random.default_rng(42).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _BASE, np.uint64))


def map_arrow(
    df: DataFrame,
    columns: list[str],
    schema: str,
    work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None],
    limit: int = 4 << 20,
) -> DataFrame:
    """Apply ``work`` to record batches holding only ``columns``; no shuffle.

    A batch is cut so that ``work`` sees about ``limit`` bytes of text at a time (one
    row at least), which bounds what numpy needs however Spark sized the batch.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit):
                out = work(part)
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.select(*columns).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch by the size of its first binary column, or else string column.

    A column named ``text`` goes before others.
    """
    n = batch.num_rows
    kinds = (pa.types.is_binary, pa.types.is_large_binary, pa.types.is_string, pa.types.is_large_string)
    held = [c for k in kinds for c in batch.columns if k(c.type)]
    if "text" in batch.schema.names:
        held = [batch.column(batch.schema.names.index("text"))]
    column = held[0] if held else None
    if n == 0:
        return
    if column is None:
        yield batch
        return
    offsets = _buffers(column)[0]
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start)
        start = stop


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string or binary array."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at.astype(np.int64), raw


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of every value; null counts as empty."""
    offsets, raw = _buffers(column.fill_null(""))
    held = raw.tobytes() if len(raw) == 0 else raw[offsets[0]:offsets[-1]].tobytes()
    base = offsets[0]
    return [held[a - base:b - base] for a, b in zip(offsets[:-1], offsets[1:])]


class Words:
    """Words of a column: byte ranges, 64-bit codes and the first word of each row.

    ``separator`` is a table of 256 booleans, ``fold`` one of 256 replacement bytes.  ``first[i]:first[i + 1]`` are the
    words of row i.  Codes are polynomial hashes over random byte codes.
    """

    def __init__(self, column: pa.Array, separator: np.ndarray, codes: bool = True, fold: np.ndarray | None = None):
        offsets, raw = _buffers(column.fill_null(""))
        base = int(offsets[0])
        self.data = raw[base:int(offsets[-1])]
        if fold is not None:
            self.data = fold[self.data]
        rows = offsets - base
        inside = ~separator[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edges = rows[1:-1]
        edges = edges[(edges > 0) & (edges < len(inside))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, rows)
        self.codes = word_codes(self.data, self.starts, self.ends) if codes else None

    def __len__(self) -> int:
        return len(self.starts)


#: Lower case for A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separators(chars: bytes = BLANKS) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit code of every word; ``starts`` ascend and words do not overlap."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + _SLICE, "right")), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        at, length = starts[i:j] - a, ends[i:j] - starts[i:j]
        # position inside the word; separators lie past the word's length and weigh nothing
        gaps = np.diff(np.append(at, b - a))
        inner = np.arange(b - a) - np.repeat(at, gaps)
        powers = _POWERS
        if inner[-1] >= len(powers) or gaps.max() > len(powers):
            powers = np.cumprod(np.full(int(gaps.max()), _BASE, np.uint64))
        value = _BYTE_CODES[data[a:b]] * powers[inner]
        value[inner >= np.repeat(length, gaps)] = 0
        out[i:j] = np.add.reduceat(value, at) + length.astype(np.uint64)
        i = j
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise hashes so that all their bits are usable."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive codes, rows not regarded."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out *= _BASE
        out += codes[i:i + count]
    return mixed(out)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    held = {c.lower() for c in df.columns}
    return [next(c for i in itertools.count() if (c := f"__{name}{i or ''}") not in held) for name in names]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint folder.

    Where the session names none, as in tests, the checkpoint folder is set once; on a
    cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            require_local(spark)
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            held = context._jsc.sc().getCheckpointDir()
        root = held.get()
    return os.path.join(root, f"spanveil-{uuid.uuid4().hex}")


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives executors."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
