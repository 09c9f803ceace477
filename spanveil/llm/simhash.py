"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints are cut into three segments: four differing bits leave one segment with
at most one.  Each segment is indexed under every variant that has one of its bits
masked; fingerprints that share a variant are compared.  Within one bucket members
are linked as a spanning forest of all pairs within the distance, so no connection
is lost and no bucket emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.common import fresh, map_arrow, stored, texts
from spanveil.llm.components import components
from spanveil.session import ship_package

#: Bit ranges of the segments.
SEGMENTS = ((0, 22), (22, 43), (43, 64))
DISTANCE = 4
#: Members of a bucket from which it is cut further inside its task.
LARGE = 1024
_BLOCK = 1 << 16


def fingerprint(text: bytes, width: int = 4) -> int:
    """64-bit SimHash over word shingles; XXH64 with seed 42, majority of bits."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
        return int(hashes[0])
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    count, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for i in range(0, count, _BLOCK):
        j = min(count, i + _BLOCK)
        pairs = zip(starts[i:j].tolist(), ends[i + width - 1:j + width - 1].tolist())
        hashes = np.array([digest(line[a:b], 42) for a, b in pairs], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int((np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)) * (2 * ones > count)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every document; ``fp`` is the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(t) for t in texts(batch.column(1))], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs, ["doc_id", "text"], "doc_id long, fp long", work)


def _variants(fp: Column) -> Column:
    """One key per bit: its segment with that bit masked, and which bit it was."""
    keys = []
    for low, high in SEGMENTS:
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        for bit in range(low, high):
            masked = part.bitwiseAND(F.lit(~(1 << (bit - low))))
            keys.append(masked.bitwiseOR(F.lit(bit << 24)))
    return F.array(*keys)


def forest(values: np.ndarray, distance: int, rest: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (positions) that join all values within ``distance`` of one another.

    ``rest`` names the bits on which members may differ; a large bucket is cut by
    ``distance + 1`` pieces of them, one of which two neighbours have in common.
    """
    if rest is not None and len(values) > LARGE:
        out = []
        for piece in np.array_split(rest, distance + 1):
            mask = np.bitwise_or.reduce(np.left_shift(np.uint64(1), piece.astype(np.uint64)))
            part = values & mask
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order])) + 1
            for members in np.split(order, edges):
                if len(members) > 1:
                    out += [(members[a], members[b]) for a, b in forest(values[members], distance)]
        return out
    left, out = np.arange(len(values)), []
    while len(left) > 1:
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            at = waiting.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= distance
            hits = left[near]
            if len(hits):
                out.append((np.full(len(hits), at), hits))
                left = left[~near]
                waiting.extend(hits)
    return out


def _bucket_links(key: int, values: np.ndarray, distance: int):
    bit = key >> 24
    low, high = next(s for s in SEGMENTS if s[0] <= bit < s[1])
    rest = np.array([b for b in range(64) if not low <= b < high])
    return forest(values, distance, rest)


def links(reps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) of representatives whose fingerprints are within ``distance`` bits, enough
    of them to connect all that are connected.  ``reps``: (fp, rep), fp unique."""
    if distance // len(SEGMENTS) > 1:
        raise ValueError("three segments find at most five differing bits")
    ship_package(reps.sparkSession)
    keyed = reps.select(F.explode(_variants(F.col("fp"))).alias("key"), "fp", "rep")
    dealt = keyed.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            if len(now[0]) == 0:
                continue
            done = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on
            if done:
                yield from found([c[:done] for c in now])
            held = [c[done:] for c in now]
        yield from found(held)

    def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys, fps, ids = columns[0], columns[1].view(np.uint64), columns[2]
        if len(keys) < 2:
            return
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        two = starts[sizes == 2]
        near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance]
        a, b = [ids[near]], [ids[near + 1]]
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            for x, y in _bucket_links(int(keys[start]), fps[start:start + size], distance):
                a.append(ids[start + x])
                b.append(ids[start + y])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    Equal fingerprints become one representative before anything is compared, so a
    group of copies costs one row however large it is.  Null and empty texts have the
    fingerprint zero and link like any other.  Repeated rows keep their rows; a null
    ``doc_id`` never is a component's id, unless it is alone, then that is null too.
    Further columns are not read; no rows give no rows.  A long text is hashed in
    blocks of shingles, so it costs memory for itself and one block.
    """
    prints = stored(fingerprints(docs))
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(reps.where(F.col("rep").isNotNull()), distance))
    classes = stored(
        reps.join(found, reps.rep == found.node, "left")
        .select("fp", F.coalesce("component", "rep").alias("component_id"))
    )
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, that of the smallest id.

    Of rows with that id one stays.  Rows without an id cannot be named in a group;
    they stay as they are.  All columns stay.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    keep = near_duplicates(named.select("doc_id", "text"), distance).where("doc_id = component_id").select("doc_id").distinct()
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    (place,) = fresh(docs, "number")
    kept = named.join(keep, "doc_id", "left_semi").withColumn(place, number).where(F.col(place) == 1)
    return kept.select(*docs.columns).union(docs.where(F.col("doc_id").isNull()).select(*docs.columns))
