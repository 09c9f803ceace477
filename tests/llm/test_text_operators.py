"""License scan, token counts, quality classifier, language ID, quality rules."""

import collections
import os
import re
import zlib

import pytest
from cases import ODD, SF, duck, empty, lower, odd, rows
from pyspark.sql import functions as F

from spanveil.llm import language_id, license_scan, quality_classifier, quality_rules, token_counts
from spanveil.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_license_base_places_match_brute_force(spark):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    got = {r.doc_id: r for r in QUERIES["op1_license_scan"](spark, SF).collect()}
    for doc, text in rows():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [
            (i, label) for p, label in phrases.items() for i in range(len(words))
            if words[i:i + len(p.split())] == p.split()
        ]
        r = got[doc]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert r.first_word == (min(places)[0] if places else None)
        assert r.last_word == (max(places)[0] if places else None)
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1


def test_license_priority_and_containment():
    found = license_scan.scan(b"Licensed under CC BY-NC 4.0; GNU Lesser General Public License v2.1 or any later version")
    assert found["labels"] == ["cc-by", "cc-by-nc-4.0", "gpl", "lgpl-2.1+"]
    assert [s[0] for s in found["spans"]] == ["cc-by-nc-4.0", "lgpl-2.1+"]
    assert license_scan.scan("MIT License. SPDX-License-Identifier: Apache-2.0".encode())["labels"] == ["mit", "spdx:apache-2.0"]
    assert license_scan.scan(b"a summit about emits")["labels"] == []
    assert len(license_scan.rules()) >= 300
    far = b"x " * 5000 + b"all rights reserved" + b" y" * 5000
    assert license_scan.scan(far)["first_word"] == 5000


def test_license_rules_hold_one_of_their_keywords():
    scanner = license_scan.scanner()
    for text in ("released under the mit license", "apache license version 2 0", "mozilla public license 1 1"):
        direct = {i for i, r in enumerate(scanner.regexes) if r.search(text)}
        assert {h[2] for h in scanner.detections(text)} == direct


def test_token_counts_equal_the_tokenizer(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    made = token_counts.tokenizer(path)
    values = rows()
    want = {d: len(made.encode(t, add_special_tokens=False)) for d, t in values}
    got = QUERIES["op7_token_counts"](spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.n_bytes == len(dict(values)[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048) for r in got)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = token_counts.count_tokens(docs, path, chunk=300, overlap=20)
    assert {r.doc_id: r.n_tokens for r in small.collect()} == want


@pytest.mark.parametrize("chunk, overlap", [(17, 2), (60, 6), (200, 20)])
def test_splices_of_hard_texts(chunk, overlap):
    import public_tokenizers

    counter = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"), chunk, overlap)
    texts = [
        "<|endoftext|> a<|startoftext|>b it's we'll don't " * 5, "x́ ́a Σας ΟΔΟΣ " * 9,
        "é" * 500 + " " + "b" * 300, "a" * 900, "<|endoftext|>" * 30, "!?" * 300, "the cat sat " * 30,
    ]
    for t in texts:
        assert counter.spliced(t)[0] == len(counter.tokenizer.encode(t, add_special_tokens=False)), t[:20]


def test_quality_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op4_quality_classifier"](spark, sf).collect()}
    labels = duck(sf).execute("SELECT doc_id, quality FROM labels").fetchall()
    held = [(q, got[d]) for d, q in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(r.held_out for _, r in held) and all(0 <= r.score <= 1 for r in got.values())
    assert sum(q == r.predicted for q, r in held) / len(held) > 0.9
    good = [r.predicted for q, r in held if q == 1]
    assert sum(good) / len(good) > 0.97


def test_quality_classifier_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(odd(spark, True), labels).collect()
    assert len(got) == len(ODD) and {r.score for r in got} == {0.5}
    assert quality_classifier.classify(empty(spark), labels).collect() == []


def test_language_id_accuracy_and_mixture(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_language_id"](spark, sf).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(got[r.doc_id].held_out for r in held)
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.98
    model = language_id.fit(docs, F.lit(True))
    one, two = (next(r.text for r in docs.where(F.col("lang") == x).collect() if 900 < len(r.text) < 2000) for x in ("de", "es"))
    found = model.infer((one[:900] + "\n" + two[:900]).encode())
    assert set(found) == {"de", "es"} and abs(found["de"] - 0.5) < 0.15


def test_language_id_odd_rows(spark):
    got = {r.doc_id: r for r in language_id.identify(odd(spark, True)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 8)] == ["und"] * 4 and got[9].lang_pred in ("en", "fr")
    assert language_id.identify(empty(spark)).collect() == []
    kept = language_id.with_known_language(odd(spark, True))
    assert {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 3, 8}) and kept.columns == odd(spark, True).columns


def brute_rules(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = collections.Counter(windows)
    covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_rules_counts_and_ratio(spark):
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0")
    table = quality_rules.weights(docs, good)
    got = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, SF).collect()}
    for doc, text in rows():
        r, want = got[doc], brute_rules(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    # the ratio again, from buckets that Spark gives for each document
    grams = quality_rules.hashed(docs.select("doc_id", "text")).select("doc_id", quality_rules.grams().alias("g")).collect()
    trusted = {r.doc_id for r in good.collect()}
    raw, target = collections.Counter(), collections.Counter()
    for r in grams:
        raw.update(r.g)
        target.update(r.g if r.doc_id in trusted else [])
    size, n, m = 1 << 16, sum(raw.values()), sum(target.values())
    for b in list(raw)[:500]:
        want = math.log((target[b] + 1) / (m + size)) - math.log((raw[b] + 1) / (n + size))
        assert abs(table[b] - want) < 1e-9
    for r in grams[:50]:
        assert abs(got[r.doc_id].llr - sum(table[b] for b in r.g) / max(1, len(r.g))) < 1e-6


@pytest.mark.parametrize("extra", [False, True])
def test_odd_rows_keep_their_number(spark, extra):
    import public_tokenizers

    docs = odd(spark, extra)
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (8, 0, None)], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("word_bpe_49k.json")
    made = token_counts.tokenizer(path)
    scans = license_scan.scan_licenses(docs).collect()
    tokens = token_counts.count_tokens(docs, path).collect()
    rules = quality_rules.apply_rules(docs, labels).collect()
    assert len(scans) == len(tokens) == len(rules) == len(ODD)
    assert sorted(r.n_tokens for r in tokens) == sorted(len(made.encode(x[1] or "", add_special_tokens=False)) for x in ODD)
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rules) == sorted(
        brute_rules(x[1] or "") for x in ODD
    )


def test_empty_tables(spark):
    import public_tokenizers

    docs, labels = empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert license_scan.scan_licenses(docs).collect() == []
    assert token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).collect() == []
    assert quality_rules.apply_rules(docs, labels).collect() == []


# --- linear work, whole statistics, letters ------------------------------------------------


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(["½", "²", "Ⅷ", "①", "12 ½", "é", "日", "ª"])], cases_schema())
    model = language_id.fit(docs.withColumn("text", F.lit("the cat sat")), F.lit(True))
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert [got[i] for i in range(8)] == ["und"] * 5 + ["en"] * 3


def cases_schema():
    from cases import SCHEMA

    return SCHEMA


def test_language_mixture_equals_grid_search():
    """The share EM finds has the likelihood of the best point of a fine grid."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(20):
        table = rng.dirichlet(np.ones(6), 2)
        counts = rng.integers(1, 30, 6).astype(float)
        model = language_id.Model(("a", "b"), table)
        share, value = model.mixture(counts, table)
        grid = np.linspace(0, 1, 2001)
        best = max(float(counts @ np.log(g * table[0] + (1 - g) * table[1] + 1e-300)) for g in grid)
        assert value >= best - 0.05 and abs(share.sum() - 1) < 1e-9


@pytest.mark.parametrize("name, kind", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_any_tokenizer_counts_as_its_library(spark, name, kind):
    import public_tokenizers

    path = public_tokenizers.path(name)
    counter = token_counts.Counter(path, 200, 16)
    assert counter.by_words == kind
    texts = [
        "The cat sat on the mat, and it's 42 degrees.", " two  blanks\n\nand\ttabs ", "", "日本語のテキスト。" * 60, "x" * 900,
        "<|endoftext|> a", "mixed " * 100 + "漢字" * 200, "def f(x):\n    return x\n" * 40,
    ] + [t for _, t in rows()[:40]]
    want = [len(counter.tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    assert counter.counts([t.encode() for t in texts]) == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()} == dict(enumerate(want))


def _seconds(work, size):
    import time

    best = []
    for _ in range(2):
        begin = time.perf_counter()
        work(size)
        best.append(time.perf_counter() - begin)
    return min(best)


def test_texts_without_blanks_are_counted_in_linear_time():
    import public_tokenizers

    counter = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    for unit in ("漢字仮名交", "aGVsbG8"):
        work = lambda n: counter.spliced(unit * (n // len(unit)))  # noqa: B023,E731
        assert _seconds(work, 240_000) < 8 * _seconds(work, 60_000) + 0.3
        text = unit * 15_000
        assert counter.spliced(text)[0] == len(counter.tokenizer.encode(text, add_special_tokens=False))


def test_repeated_licenses_are_scanned_in_linear_time():
    work = lambda n: license_scan.scan(b"licensed under the mit license and apache license 2.0 all rights reserved " * n)
    assert _seconds(work, 8000) < 6 * _seconds(work, 2000) + 0.2


def test_suppression_equals_comparing_all_pairs():
    import random

    scanner, rng = license_scan.scanner(), random.Random(1)
    for _ in range(200):
        hits = {(a, a + rng.randint(1, 12), rng.randrange(len(scanner.rules))) for a in rng.choices(range(40), k=rng.randint(0, 30))}
        order = sorted(hits, key=lambda h: (-scanner.rules[h[2]].priority, h[0] - h[1], h[0], h[2]))
        taken = []
        for h in order:
            if not any(t[0] <= h[0] and h[1] <= t[1] for t in taken):
                taken.append(h)
        assert scanner.kept(sorted(hits)) == sorted(taken)


def test_gated_license_rules_equal_ungated_ones():
    scanner = license_scan.scanner()
    found = 0
    for _, text in rows():
        line = " ".join(w.decode() for w in license_scan._WORD.findall(text.lower().encode()))
        direct = {(m.start(), m.end(), i) for i, r in enumerate(scanner.regexes) for m in r.finditer(line)}
        assert set(scanner.detections(line)) == direct
        found += len(direct)
    assert found > 5


def test_all_trusted_rows_count(spark):
    """Weights follow every trusted id, not a first part of them."""
    docs = spark.createDataFrame([(i, "alpha beta" if i < 30_000 else "gamma delta") for i in range(60_000)], "doc_id long, text string")
    trusted = spark.range(30_000).select(F.col("id").alias("doc_id")).union(spark.range(50).select(F.col("id").alias("doc_id")))
    found = docs.join(trusted.distinct(), "doc_id")
    table = quality_rules.weights(docs, trusted)
    direct = quality_rules.weights(docs.withColumn("doc_id", F.col("doc_id") + 100_000), trusted)
    assert found.count() == 30_000 and max(table) > 0.5 and set(direct) == {0.0}
    rows_ = quality_rules.hashed(docs.limit(1)).select(F.explode(quality_rules.grams()).alias("b")).collect()
    import math

    size, n = 1 << quality_rules.BUCKET_BITS, 5  # words, endings, one pair
    want = math.log((30_000 + 1) / (30_000 * n + size)) - math.log((30_000 + 1) / (60_000 * n + size))
    assert any(abs(table[r.b] - want) < 1e-6 for r in rows_)


def test_quality_score_equals_its_formula(spark):
    """Scores are the calibrated logistic of the size difference, text by text."""
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.fit(docs, labels, F.lit(True), 200, 100)
    scorer = quality_classifier.Scorer(model)
    for r in quality_classifier.score(docs.limit(40), model).join(docs, "doc_id").collect():
        x = model.slope * scorer.difference((r.text or "").encode()) + model.intercept
        assert r.score == pytest.approx(1 / (1 + math.exp(-x)))
