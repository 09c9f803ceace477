"""Substring, line and SimHash dedup, decontamination, mixing, components, pipeline."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from cases import ODD, SCHEMA, SF, duck, empty, lower, normal, odd, rows
from pyspark.sql import functions as F

from spanveil.llm import decontamination, line_dedup, simhash, source_mixing, substring_dedup
from spanveil.llm.components import components
from spanveil.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_oracles(spark, key):
    df = QUERIES[key](spark, SF)
    result = duck().execute(ORACLES[key])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert normal(df.collect(), df.columns) == normal(result.fetchall(), names)


def brute_repeats(docs):
    first, out = {}, {}
    words = {d: WORD.findall(t or "") for d, t in docs}
    for d, w in sorted(words.items()):
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s:s + 20]), (d, s))
    for d, w in words.items():
        gone = {k for s in range(len(w) - 19) if first[tuple(w[s:s + 20])] != (d, s) for k in range(s, s + 20)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def some_texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "ß,", "x.y"]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(15, 60))) for _ in range(6)]
    made = []
    for d in range(n):
        parts = [
            rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))
            for _ in range(rng.randint(0, 5))
        ]
        made.append((d, rng.choice([" ", "\n", " \t"]).join(parts)))
    made += [(n, "same " * 90), (n + 1, "same " * 35), (n + 2, made[3][1]), (n + 3, made[3][1]), (n + 4, None)]
    return made


@pytest.mark.parametrize("bound", [1, 20_000])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, bound):
    """With a bound of one stretch a tree, every shared seed is split to the full depth."""
    monkeypatch.setattr(substring_dedup, "TREE_STRETCHES", bound)
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 2000)
    docs = some_texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(docs)


def test_tree_levels_are_equal_prefixes():
    words = np.array([1, 2, 1, 2, 1, 2, 3] * 9)
    for depth in (1, 2, 3, 5, 8, 20):
        node = substring_dedup.nodes(words, depth)
        at = range(len(words) - depth + 1)
        for i in at:
            for j in at:
                assert (node[i] == node[j]) == (list(words[i:i + depth]) == list(words[j:j + depth]))


def test_substring_dedup_odd_rows(spark):
    got = substring_dedup.remove_repeats(odd(spark, True)).collect()
    assert len(got) == len(ODD)
    assert all(r.n_removed == 0 for r in got if r.doc_id != 7)
    assert [r.n_removed for r in got if r.doc_id == 7] == [40_000 - 1]  # all but what window 0 starts
    assert substring_dedup.remove_repeats(empty(spark)).collect() == []
    copies = spark.createDataFrame([(1, "a b c d e f g " * 4), (1, "a b c d e f g " * 4)], "doc_id long, text string")
    assert len({tuple(r) for r in substring_dedup.remove_repeats(copies).collect()}) == 1


def brute_lines(docs):
    def near(a, b):
        if min(len(a), len(b)) < 5 or abs(len(a) - len(b)) > 1:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return row[-1] <= 1

    lines = [((d, i), x, WORD.findall(x)) for d, t in sorted(docs) if t for i, x in enumerate(t.split("\n")) if WORD.search(x)]
    gone = {}
    for k, (place, line, words) in enumerate(lines):
        if any(p < place and (x == line or near(w, words)) for p, x, w in lines[:k]):
            gone.setdefault(place[0], []).append(place[1])
    return gone


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "d", "e"]
    base = [rng.choices(vocabulary, k=rng.randint(1, 9)) for _ in range(30)] + [[f"w{i % 50}" for i in range(200)]]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(line))
                line = rng.choice([line[:at] + line[at + 1:], line[:at] + ["z"] + line[at:], line[:at] + ["y"] + line[at + 1:]]) or ["q"]
            lines.append(" ".join(line))
        docs.append((d, "\n".join(lines)))
    got = line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    want = brute_lines(docs)
    assert {r.doc_id: r.removed_lines for r in got} == {d: ",".join(map(str, want.get(d, []))) for d, _ in docs}


def test_line_dedup_odd_rows(spark):
    docs = odd(spark, True)
    got = line_dedup.without_duplicate_lines(docs)
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [
        (False, i) for i in (1, 2, 3, 4, 5, 5, 7, 8, 9)
    ] + [(True, 0)]
    assert line_dedup.without_duplicate_lines(empty(spark)).collect() == []
    cut = spark.createDataFrame([(1, "a b\n\nc", None, None, 6), (2, "a b\nnew\n", None, None, 8)], SCHEMA)
    assert [(r.text, r.n_chars) for r in line_dedup.without_duplicate_lines(cut).orderBy("doc_id").collect()] == [("a b\n\nc", 6), ("new\n", 4)]


def brute_print(text):
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    docs = [*rows(), *((1000 + i, t) for i, (_, t, *_) in enumerate(ODD))]
    prints = [brute_print(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {docs[i][0]: (f"{prints[i]:016x}", docs[find(i)][0]) for i in range(len(docs))}
    got = simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.collect()} == want


def linked(n, pairs):
    parent = list(range(n))
    for a, b in pairs:
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    out = []
    for i in range(n):
        while parent[i] != i:
            i = parent[i]
        out.append(i)
    return out


@pytest.mark.parametrize("large", [4, 10_000])
def test_links_lose_no_connection(spark, monkeypatch, large):
    """Dense and sparse fingerprints, with buckets cut further or not."""
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 2**63, 12, dtype=np.uint64)
    made = set()
    for c in centers.tolist():
        for _ in range(60):
            made.add(c ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))}))
    values = sorted(made)
    n = len(values)
    want = linked(n, [(i, j) for i in range(n) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 4])
    whole = [(int(a), int(b)) for x, y in simhash.forest(np.array(values, np.uint64), 4, np.arange(64)) for a, b in zip(x, y)]
    assert linked(n, whole) == want
    reps = spark.createDataFrame([(int(np.uint64(v).view(np.int64)), i) for i, v in enumerate(values)], "fp long, rep long")
    assert linked(n, [(r.a, r.b) for r in simhash.links(reps).collect()]) == want


def test_one_of_each_keeps_rows_without_id(spark):
    docs = odd(spark, True)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and ids.count(None) == 1 and 1 in ids and 2 not in ids
    assert simhash.one_of_each(empty(spark)).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 240)] + [(5, 5)]
    edges += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = linked(401, edges)
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_distance(item, text, limit):
    best = limit + 1
    for start in range(len(text)):
        row = list(range(len(item) + 1))
        best = min(best, row[-1])
        for x in text[start:start + len(item) + limit]:
            new = [row[0] + 1]
            for j, y in enumerate(item):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
            best = min(best, row[-1])
    return best


def test_decontamination_recall_and_exactness(spark):
    """Items with random edits up to the bound, between foreign words: recall 0.97 at least,
    and no match that brute force denies."""
    rng = random.Random(6)
    items = duck().execute("SELECT item_id, text FROM benchmark ORDER BY 1").fetchall()
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", lower(t))
    pool = [w for _, t in rows()[:50] for w in split(t)]
    docs, planted = [], set()
    for k in range(3):
        for item, text in items:
            words = split(text)
            edits = rng.randint(0, decontamination.bound(len(words)))
            for _ in range(edits):
                at = rng.randrange(len(words))
                words = rng.choice([words[:at] + words[at + 1:], words[:at] + [rng.choice(pool)] + words[at:], words[:at] + [rng.choice(pool)] + words[at + 1:]])
            docs.append((len(docs), " ".join(rng.choices(pool, k=20) + [w.title() if w.isascii() else w for w in words] + rng.choices(pool, k=20))))
            planted.add((docs[-1][0], item))
    docs += [(10_000 + d, t) for d, t in rows()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(planted & set(got)) >= 0.97 * len(planted)
    texts, bodies = dict(docs), dict(items)
    for (d, i), distance in list(got.items())[:60]:
        item = split(bodies[i])
        limit = decontamination.bound(len(item))
        assert brute_distance(item, split(texts[d]), limit) <= distance <= limit
    exact = {(d, i) for d, t in docs for i, x in items if f" {' '.join(split(x))} " in f" {' '.join(split(t))} "}
    assert exact <= set(got) and all(got[e] == 0 for e in exact)
    blocks = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_bytes=2000)
    assert exact <= {(r.doc_id, r.item_id) for r in blocks.collect()}


@pytest.mark.parametrize("size", [60, 120, 250, 1000])
def test_decontamination_recall_of_long_items(size):
    """A tenth of the words edited, anywhere or all near both ends."""
    rng = random.Random(size)
    word = lambda: f"w{rng.randrange(5000)}"
    lost = {"anywhere": 0, "ends": 0}
    for kind in lost:
        for _ in range(25):
            item = [word() for _ in range(size)]
            index, words = decontamination.Index([1], [" ".join(item)]), list(item)
            edits = decontamination.bound(size)
            for k in range(edits):
                at = rng.randrange(len(words)) if kind == "anywhere" else k if k % 2 else len(words) - 1 - k
                words = rng.choice([words[:at] + words[at + 1:], words[:at] + [word()] + words[at:], words[:at] + [word()] + words[at + 1:]])
            text = [word() for _ in range(30)] + words + [word() for _ in range(30)]
            got = index.matches(decontamination._words(pa.array([" ".join(text)])))
            lost[kind] += not got
            assert all(d <= edits and abs(n - len(words)) <= 2 * edits for d, _, n in got.values())
    assert lost["anywhere"] == 0 and (size < 250 or lost["ends"] == 0), lost


def test_decontamination_odd_rows(spark):
    bench = spark.createDataFrame(
        [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "THE CAT, sat on the mat and looked at the moon"), (None, "x"), (6, "THE CAT, sat on the mat and looked at the moon")],
        "item_id long, text string",
    )
    docs = odd(spark, True)
    got = decontamination.contaminated(docs, bench).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id or 0, r.item_id) for r in got)) == sorted(
        [(4, 4)] + [(d, i) for d in (5, 5, 6, 0) for i in (5, 6)]
    ), key
    assert sorted(r.doc_id for r in decontamination.without_contaminated(docs, bench).collect()) == [1, 2, 3, 7, 8, 9]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, nothing).collect() == []
    assert decontamination.without_contaminated(docs, nothing).count() == len(ODD)
    assert decontamination.contaminated(empty(spark), bench).collect() == []


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            out[s] = 3 * sizes[s]
            free.discard(s)
        left = sum(sizes.values()) - sum(out.values())
    return {**out, **{s: left * weight[s] / sum(weight[x] for x in free) for s in free}}


def test_mix_meets_targets_and_repeats(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op6_source_mixing"](spark, sf).collect()}
    source = {r.doc_id: (r.source, len(WORD.findall(r.text))) for r in docs.collect()}
    sizes, taken, largest = {}, {}, {}
    for d, (s, n) in source.items():
        assert got[d].size == n and got[d].taken <= 3 * n and got[d].taken % max(n, 1) == 0
        sizes[s] = sizes.get(s, 0) + n
        taken[s] = taken.get(s, 0) + got[d].taken
        largest[s] = max(largest.get(s, 0), n)
    want = brute_targets(sizes)
    for d, (s, _) in source.items():
        assert got[d].source_size == sizes[s] and abs(got[d].target - want[s]) < 1e-6 * want[s] + 1e-9
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 2e-4 * want[s]
    again = {r.doc_id: r.taken for r in QUERIES["op6_source_mixing"](spark, sf).collect()}
    assert again == {d: r.taken for d, r in got.items()}


def test_mix_rates_minimise_relative_entropy(spark):
    """At the solution every uncut rate is exp(level * size / mean)."""
    groups = spark.createDataFrame([("s", n, 3) for n in range(1, 40)], "source_key string, size long, n long")
    wanted = spark.createDataFrame([("s", 2340, 1500.0, 26.0)], "source_key string, source_size long, target double, mean double")
    level = source_mixing.solve(groups, wanted).first().level
    total = sum(3 * n * min(3.0, float(np.exp(level * n / 26.0))) for n in range(1, 40))
    assert abs(total / 1500 - 1) < 2e-4


#: (size, documents): a few huge and many short ones.
SPREADS = {
    "words": [(100_000, 10), (50, 20_000)], "pages": [(500_000, 3), (400, 5_000)],
    "far": [(5_000_000, 1), (1, 3_000_000)], "even": [(7, 100)],
}


def test_mix_meets_targets_of_a_few_huge_and_many_short_documents(spark):
    groups, wanted, shares = [], [], (3.0, 2.99, 1.5, 1.0, 0.7, 0.3, 0.01)
    for name, sizes in SPREADS.items():
        own = sum(n * c for n, c in sizes)
        mean = sum(n * n * c for n, c in sizes) / own
        for share in shares:
            groups += [(f"{name} {share}", n, c) for n, c in sizes]
            wanted.append((f"{name} {share}", own, share * own, mean))
    got = {
        r.source_key: r for r in source_mixing.solve(
            spark.createDataFrame(groups, "source_key string, size long, n long"),
            spark.createDataFrame(wanted, "source_key string, source_size long, target double, mean double"),
        ).collect()
    }
    for key, _, target, mean in wanted:
        rate = lambda n: min(3.0, float(np.exp(min(got[key].level * n / mean, 40.0))))
        total = sum(c * n * rate(n) for k, n, c in groups if k == key)
        assert abs(total / target - 1) < 2e-4, (key, total / target)


def test_mix_takes_every_document_of_a_source_at_its_limit(spark):
    docs = [(d, "w " * 20_000, "a") for d in range(3)] + [(100 + d, "w " * 10, "a") for d in range(500)]
    docs += [(1000 + d, "w " * 20_000, "b") for d in range(60)]
    got = source_mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    assert {r.copies for r in got if r.doc_id < 1000} == {3}


def test_mixture_keeps_the_copies_of_rows_without_an_id(spark):
    """Rows of one id, source and size have all copies that the mix gives them."""
    docs = [(None, f"{'x' * (d + 1)} b c", "a") for d in range(41)] + [(7, "one two", "a")] * 5
    docs += [(None, f"{'y' * (d + 1)} b c", "b") for d in range(29)] + [(8, f"{d} z", "b") for d in range(3)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string")
    sums = lambda found: {tuple(r)[:2]: r.n for r in found.groupBy("source", "size").agg(F.sum("copies").alias("n")).collect() if r.n}
    want = source_mixing.mix(docs, keep_source=True).withColumn("source", F.substring("source_key", 2, 9))
    got = source_mixing.mixture(docs)
    assert sums(got) == sums(want)
    rows_ = got.collect()
    assert all(1 <= r.copies <= 3 for r in rows_) and len({(r.doc_id, r.text) for r in rows_ if r.doc_id is None}) == sum(r.doc_id is None for r in rows_)


def test_mix_reports_targets_it_cannot_meet(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "ROUNDS", 1)
    groups = spark.createDataFrame([("s", n, c) for n, c in SPREADS["words"]], "source_key string, size long, n long")
    wanted = spark.createDataFrame([("s", 2_000_000, 5_000_000.0, 50_025.0)], "source_key string, source_size long, target double, mean double")
    with pytest.raises(RuntimeError):
        source_mixing.solve(groups, wanted)


def test_mix_targets_of_few_sources(spark):
    for sizes in ({"a": 100, "b": 1, "c": 1}, {"a": 5}, {"z": 10, None: 1000, "é": 20, "B": 3}, {"a": 0, "b": 7}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_mixing.targets(df).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in sizes), (got, want)


def test_mix_odd_rows(spark):
    docs = odd(spark, True)
    got = source_mixing.mix(docs).collect()
    assert len(got) == len(ODD) and all(r.taken <= 3 * r.size for r in got)
    assert source_mixing.mix(empty(spark)).collect() == []
    taken = source_mixing.mixture(docs)
    assert set(source_mixing.MIXED) <= set(taken.columns) and len(set(taken.columns)) == len(taken.columns)
    assert all(r.copies > 0 and r.taken == r.copies * r.size for r in taken.collect())


def test_pipeline_stages(spark):
    """Every stage against brute force on its own input."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.createDataFrame([
        (9001, "12 34", "en", "src0", 5), (9002, None, None, None, None),
    ], SCHEMA))
    columns, held = docs.columns, [docs.collect()]
    from spanveil.llm.common import stored

    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        held.append(docs.collect())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
    first, lang, lines, near, clean, mixed = held
    ids = lambda x: {r.doc_id for r in x}
    assert ids(first) - ids(lang) == {9001, 9002}
    gone = brute_lines([(r.doc_id, r.text) for r in lang])
    want = {}
    for r in lang:
        kept = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone.get(r.doc_id, []))
        if WORD.search(kept):
            want[r.doc_id] = kept
    assert {r.doc_id: r.text for r in lines} == want
    prints = {r.doc_id: brute_print(r.text) for r in lines}
    order = sorted(prints)
    root = linked(len(order), [(i, j) for i in range(len(order)) for j in range(i) if (prints[order[i]] ^ prints[order[j]]).bit_count() <= 4])
    assert ids(near) == {order[i] for i in range(len(order)) if root[i] == i}
    items = [decontamination._words(pa.array([t])).codes for _, t in duck().execute("SELECT item_id, text FROM benchmark").fetchall()]
    for r in near:
        text = decontamination._words(pa.array([r.text])).codes
        holds = any(len(w) and np.any(np.all(np.lib.stride_tricks.sliding_window_view(text, len(w)) == w, 1)) for w in items if len(w) <= len(text))
        assert not (holds and r.doc_id in ids(clean))
    assert len(clean) >= 0.9 * len(near)
    assert ids(mixed) <= ids(clean) and all(1 <= r.copies <= 3 for r in mixed)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} <= ids(first)


def test_stages_keep_columns_of_any_name(spark):
    clash = {"__id": "1", "__key": "2", "__number": "3", "__removed": "4", "__text": "'t'", "__size": "5", "__rows": "6", "__copies": "7"}
    docs = odd(spark).selectExpr("*", *[f"{v} AS {k}" for k, v in clash.items()])
    for stage in (line_dedup.without_duplicate_lines, simhash.one_of_each, source_mixing.mixture):
        out = stage(docs)
        assert set(docs.columns) <= set(out.columns)
        assert {(r["__id"], r["__key"], r["__number"], r["__text"]) for r in out.collect()} == {(1, 2, 3, "t")}


def test_variants_of_a_long_line_in_linear_time(spark):
    import time

    def seconds(n):
        df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)], "line string")
        some = df.select(F.size(line_dedup._variants(F.col("line"), F.lit(True), F.lit(True))).alias("n"))
        best = []
        for _ in range(2):
            begin = time.perf_counter()
            assert some.first().n == 2 * n + 1
            best.append(time.perf_counter() - begin)
        return min(best)

    assert seconds(32_000) < 6 * seconds(8_000) + 0.5


def test_empty_pipeline(spark, tmp_path):
    import corpus_pipeline

    empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
