"""Substring dedup by prefix-partitioned suffix trees.

Every window of ``LENGTH`` words is a suffix cut at the tree's depth that matters.  The
suffixes are partitioned by a prefix of their words taken at a point the words
themselves choose: the smallest hash among the window's short word sequences (its
seed), so equal windows always meet.  Neighbouring windows with one seed are a stretch;
it travels as one entry, since its windows are repeated together or at its edges only.

1. Stretches with equal words are one leaf: all but the first are repeats.  Seeds with
   one kind of stretch need nothing more.
2. For seeds with several kinds the words are fetched and each memory-sized group of
   seeds becomes a suffix tree, built level by level (depth 1, 2, 4, 8, 16, 20) by
   doubling ranks; leaves below one node at the full depth are equal windows, and all
   but the earliest are repeats.
3. A seed with more stretches than a group may hold is split by the longest prefix, the
   whole window; such a group is a single node and only its earliest leaf is asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import BLANKS, Words, grams, map_arrow, mixed, separators, stored, texts
from spanveil.session import ship_package

#: Words of a window, and of a seed within it.
LENGTH = 20
SEED = 8
#: Text whose seeds make one group, and stretches that make one tree.
GROUP_BYTES = 8 << 20
TREE_STRETCHES = 20_000
_SLICE = 8 << 20

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_SEPARATORS = separators(BLANKS)

# What a row of ``stretches`` holds: entries to compare, seeds known to have several
# kinds of stretch, and entries already decided.
_COMPARE, _SEVERAL, _GONE, _CHECK = range(4)
_ENTRIES = "seeds array<long>, kinds array<long>, docs array<long>, starts array<int>, counts array<int>"


def _word_array(column: pa.Array) -> Words:
    return Words(column, _SEPARATORS)


def stretches_of(words: Words) -> dict[str, np.ndarray]:
    """Stretches of a batch: row, first window (words from 0), windows, seed, kind."""
    codes, first = words.codes, words.first
    empty = {k: np.zeros(0, np.int64) for k in ("row", "start", "count")} | {k: np.zeros(0, np.uint64) for k in ("seed", "kind")}
    if len(codes) < LENGTH:
        return empty
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    short = grams(codes, SEED)
    span = LENGTH - SEED + 1
    at = np.arange(len(short) - span + 1)
    whole = row[at] == row[at + LENGTH - 1]
    anchor = np.lib.stride_tricks.sliding_window_view(short, span).argmin(1) + at
    at, anchor = at[whole], anchor[whole]
    if not len(at):
        return empty
    fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, len(at)))
    start, anchor = at[begin], anchor[begin]
    end = start + count - 1 + LENGTH
    # hash of the words start..end from running sums of codes times powers
    powers = np.cumprod(np.full(len(codes), _BASE, np.uint64))
    inverse = np.cumprod(np.full(len(codes), _INVERSE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(codes) * powers)])
    kind = (sums[end] - sums[start]) * inverse[start]
    kind = mixed(mixed(kind) + (anchor - start).astype(np.uint64) * np.uint64(64) + count.astype(np.uint64))
    return {"row": row[start], "start": start - first[row[start]], "count": count, "seed": short[anchor], "kind": kind}


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Whether each element of sorted keys begins a new group."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return fresh


def decide(seed, kind, doc, start, count) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the entries, which of them repeat an earlier one, which seeds (per entry)
    have several kinds.  Equal places are not earlier than one another."""
    order = np.lexsort((start, doc, kind, seed))
    seed, kind, doc, start = seed[order], kind[order], doc[order], start[order]
    same = _groups(seed, kind)
    lead = np.maximum.accumulate(np.where(same, np.arange(len(seed)), 0))
    later = (doc != doc[lead]) | (start != start[lead])
    number = np.cumsum(_groups(seed)) - 1
    several = np.bincount(number, weights=same, minlength=number[-1] + 1 if len(number) else 0) > 1
    return order, later, several[number]


def _seed_rows(docs: DataFrame, groups: int) -> DataFrame:
    """Stretches of every document, dealt to groups of seeds.

    Within a batch only the first of equal stretches goes on to be compared, and a seed
    seen with several kinds sends one mark, so a hot passage or line costs a row a batch.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        column = batch.column(0)
        known = column.is_valid()
        if known.false_count:
            batch = batch.filter(known)
        if not batch.num_rows:
            return None
        found = stretches_of(_word_array(batch.column(1)))
        if not len(found["seed"]):
            return None
        doc = batch.column(0).to_numpy()[found["row"]]
        seed, kind, start, count = found["seed"], found["kind"], found["start"], found["count"]
        order, later, several = decide(seed, kind, doc, start, count)
        seed, kind, doc, start, count = (x[order] for x in (seed, kind, doc, start, count))
        role = np.where(later, _GONE, np.where(several, _CHECK, _COMPARE))
        marked = np.unique(seed[several])
        role = np.append(role, np.full(len(marked), _SEVERAL))
        seed = np.append(seed, marked)
        fill = np.zeros(len(marked), np.int64)
        kind, doc = np.append(kind, fill.astype(np.uint64)), np.append(doc, fill)
        start, count = np.append(start, fill), np.append(count, fill)
        # what is decided needs no meeting of seeds: it is dealt by document
        dealt = np.where(role <= _SEVERAL, seed, mixed(doc.astype(np.uint64))) % np.uint64(groups)
        by = np.lexsort((start, doc, role, dealt))
        edges = np.flatnonzero(_groups(dealt[by], role[by]))
        cuts = pa.array(np.append(edges, len(by)), pa.int32())
        lists = lambda x, kind: pa.ListArray.from_arrays(cuts, pa.array(x[by], kind))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(dealt[by][edges].astype(np.int32)), pa.array(role[by][edges].astype(np.int32)),
                lists(seed.view(np.int64), pa.int64()), lists(kind.view(np.int64), pa.int64()),
                lists(doc, pa.int64()), lists(start, pa.int32()), lists(count, pa.int32()),
            ],
            ["dealt", "role", "seeds", "kinds", "docs", "starts", "counts"],
        )

    return map_arrow(docs, ["doc_id", "text"], f"dealt int, role int, {_ENTRIES}", work, _SLICE)


def _compared(table: pa.Table) -> pa.Table:
    """Decisions of one group of seeds: (doc_id, check, start, count, seed)."""
    role = np.repeat(
        table["role"].to_numpy(), np.array([len(x) for x in table["seeds"]], np.int64)
    )
    flat = lambda name: table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    seed, kind, doc, start, count = map(flat, ("seeds", "kinds", "docs", "starts", "counts"))
    marks = np.unique(seed[role == _SEVERAL])
    open_ = role == _COMPARE
    entries = [x[open_] for x in (seed, kind, doc, start, count)]
    order, later, several = decide(*entries)
    seed0, _, doc0, start0, count0 = (x[order] for x in entries)
    several |= np.isin(seed0, marks)
    use = later | several
    decided = role >= _GONE
    return pa.table({
        "doc_id": np.append(doc0[use], doc[decided]),
        "check": np.append(~later[use], role[decided] == _CHECK),
        "start": np.append(start0[use], start[decided]).astype(np.int32),
        "count": np.append(count0[use], count[decided]).astype(np.int32),
        "seed": np.append(seed0[use], seed[decided]),
    })


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, body): texts compressed once, for the two joins that move them."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        body = [press.compress(t) for t in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.binary())], ["doc_id", "body"])

    return map_arrow(docs, ["doc_id", "text"], "doc_id long, body binary", work)


def _unpacked(column: pa.Array) -> list[bytes]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return [press.decompress(b) for b in column.to_pylist()]


def _fetched(docs: DataFrame, checks: DataFrame) -> DataFrame:
    """(seed, doc_id, start, count, words) of the stretches to be looked into."""
    wanted = checks.groupBy("doc_id").agg(F.collect_set(F.struct("seed", "start", "count")).alias("wanted"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, wanted_ in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1)), batch.column(2).to_pylist()):
            words = text.split()
            for w in wanted_:
                start, count = w["start"], w["count"]
                if start + count + LENGTH - 1 <= len(words):
                    rows.append((w["seed"], doc, start, count, b" ".join(words[start:start + count + LENGTH - 1]).decode()))
        names = ["seed", "doc_id", "start", "count", "words"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names
        )

    joined = _packed(docs).join(wanted, "doc_id")
    return map_arrow(
        joined, ["doc_id", "body", "wanted"], "seed long, doc_id long, start int, count int, words string", work
    )


def nodes(words: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Node of every position at ``depth``: equal for suffixes that share so many words.

    Ranks of depth 1, 2, 4, ... are the tree's levels; positions nearer to the end than
    the depth get ranks without meaning.
    """
    level, done, held = np.unique(words, return_inverse=True)[1].astype(np.int64), 1, {}
    held[1] = level
    while done * 2 <= depth:
        level = _paired(level, level, done)
        done *= 2
        held[done] = level
    rest = depth - done
    while rest:
        step = 1 << (rest.bit_length() - 1)
        level = _paired(level, held[step], done)
        done, rest = done + step, rest - step
    return level


def _paired(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    moved = np.append(right[shift:], np.full(min(shift, len(right)), -1))
    pair = left * (int(right.max(initial=0)) + 2) + moved + 1
    return np.unique(pair, return_inverse=True)[1].astype(np.int64)


def _tree(table: pa.Table) -> pa.Table:
    """Windows of one group that stand earlier too: (doc_id, start, count)."""
    known: dict[bytes, int] = {}
    codes, lengths = [], []
    for text in table["words"].to_pylist():
        words = text.encode().split()
        codes += [known.setdefault(w, len(known)) for w in words]
        lengths.append(len(words))
    count = table["count"].to_numpy().astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(begin, count) + inner
    doc = np.repeat(table["doc_id"].to_numpy(), count)
    start = np.repeat(table["start"].to_numpy().astype(np.int64), count) + inner
    node = nodes(np.array(codes, np.int64))[place]
    order = np.lexsort((start, doc, node))
    node, doc, start = node[order], doc[order], start[order]
    lead = np.maximum.accumulate(np.where(_groups(node), np.arange(len(node)), 0))
    later = (doc != doc[lead]) | (start != start[lead])
    return pa.table({
        "doc_id": doc[later], "start": start[later].astype(np.int32), "count": np.ones(later.sum(), np.int32),
    })


def _windows(stretches: DataFrame) -> DataFrame:
    """(h1, h2, doc_id, start) of every window of the stretches."""
    words = F.split("words", " ")
    rows = stretches.select("doc_id", "start", words.alias("w"), F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("k"))
    window = F.slice("w", F.col("k") + 1, LENGTH)
    return rows.select(
        F.xxhash64(window).alias("h1"), F.xxhash64(F.lit("window"), window).alias("h2"),
        "doc_id", (F.col("start") + F.col("k")).alias("start"),
    )


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, start, count): runs of windows that also start earlier, word places from 0."""
    ship_package(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = size // GROUP_BYTES + 1
    made = "doc_id long, check boolean, start int, count int, seed long"
    decided = stored(_seed_rows(docs, groups).groupBy("dealt").applyInArrow(_compared, made))
    gone = decided.where("not check").select("doc_id", "start", "count")
    fetched = stored(_fetched(docs, decided.where("check")))
    sizes = fetched.groupBy("seed").agg(F.count("*").alias("n"))
    large = stored(sizes.where(F.col("n") > TREE_STRETCHES).select("seed"))
    trees = fetched.count() // TREE_STRETCHES + 1
    small = fetched.join(large, "seed", "left_anti").withColumn("dealt", F.pmod(F.xxhash64("seed"), F.lit(trees)))
    below = small.groupBy("dealt").applyInArrow(_tree, "doc_id long, start int, count int")
    hot = _windows(fetched.join(large, "seed", "left_semi"))
    place = F.struct("doc_id", "start")
    leads = stored(
        hot.groupBy("h1", "h2").agg(F.min(place).alias("lead"), F.max(place).alias("last"))
        .where("lead <> last").select("h1", "h2", "lead")
    )
    later = hot.join(leads, ["h1", "h2"]).where(place > F.col("lead")).select("doc_id", "start", F.lit(1).alias("count"))
    return gone.unionByName(below).unionByName(later)


def covered(starts: list[int], counts: list[int], size: int) -> np.ndarray:
    """Words covered by runs of windows."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, np.array(starts, np.int64), 1)
    np.add.at(change, np.minimum(np.array(starts, np.int64) + np.array(counts, np.int64) + LENGTH - 1, size), -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept), one row per row of ``docs``.

    Words covered by a window that also starts earlier go; ``kept`` is the rest joined
    by one blank.  Null and empty texts have no words.  A row without an id is neither
    compared nor cut.  Rows with one id are one document: equal texts are cut alike and
    are not earlier than each other.  Further columns are not read.
    """
    runs = repeated_windows(docs).groupBy("doc_id").agg(
        F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts")
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        totals, removed, kept = [], [], []
        for text, starts, counts in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            words = text.split()
            if starts:
                stay = ~covered(starts, counts, len(words))
                rest = [w for w, s in zip(words, stay.tolist()) if s]
            else:
                rest = words
            totals.append(len(words))
            removed.append(len(words) - len(rest))
            kept.append(b" ".join(rest).decode())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )

    joined = _packed(docs).join(runs, "doc_id", "left")
    schema = "doc_id long, n_words long, n_removed long, kept string"
    return map_arrow(joined, ["doc_id", "body", "starts", "counts"], schema, work)


#: DuckDB statement for the digest of ``remove_repeats``.
SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS v
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20)
), leads AS (
  SELECT v, min(row(doc_id, s)) AS lead FROM windows GROUP BY v HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i
  FROM windows JOIN leads USING (v) WHERE row(doc_id, s) > lead
), kept AS (
  SELECT p.doc_id, string_agg(p.x, ' ' ORDER BY p.i) AS t
  FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM words) p
  ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i
  GROUP BY p.doc_id
), lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(l.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM words d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN lost l ON d.doc_id = l.doc_id
"""
