"""Keys of larger tables, tables of one row group, spans in one pass."""

import re

import pytest
from pyspark.sql import functions as F

from spanveil.functions import text as tx
from spanveil.functions.text import SPANS, regex_spans
from spanveil.operators.custom_rules import java_pattern
from spanveil.plans import carriers
from spanveil.plans import catalog  # noqa: F401
from spanveil.plans.registry import QUERIES, table
from spanveil.session import SCAN_PARTITIONS, spread

SF = "/root/testdata/sf0.001"
WIDE = [
    (6700417999, 10, 0), (67004179993, 11, 0), (670041799931, 12, 0), (670041799931, 13, 0),
    (999999000001, 15, 400000000000000), (7777777777771, 16, 4000000000000000), (48271, 9, 200000000),
]


def test_carriers_of_large_keys(spark):
    keys = [0, 1, 149_999, 1_185_866, 9_000_000, 54_000_000, 6_000_000_000, 10**12]
    rows = spark.createDataFrame([(k,) for k in keys], "o_orderkey long")
    made = [F.expr(carriers._spark(carriers.num(*n))) for n in WIDE]
    got = [tuple(r) for r in rows.select("o_orderkey", *made).orderBy("o_orderkey").collect()]
    assert got == [(k, *[str((k * m + a) % 10**w).zfill(w) for m, w, a in WIDE]) for k in keys]
    texts = rows.filter("o_orderkey < 6e9").select(F.expr(carriers._spark(carriers.TEXTS["mixed"])).alias("t"))
    assert texts.filter("t IS NULL").count() == 0


def test_one_row_group_keeps_all_cores_busy(spark):
    assert spark.conf.get(SCAN_PARTITIONS, None) is None
    docs = table(spark, SF, "documents").select("doc_id")
    dealt = spread(docs)
    full = dealt.groupBy(F.spark_partition_id().alias("p")).count()
    assert full.count() >= spark.sparkContext.defaultParallelism
    assert dealt.exceptAll(docs).count() == 0 and dealt.count() == docs.count()
    made = carriers.corpus(spark, SF, "mixed").filter("src = 'gen'")
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() >= spark.sparkContext.defaultParallelism


def test_rule_test_counts_every_pair(spark):
    rows = QUERIES["rule_test"](spark, SF)
    assert rows.count() == table(spark, SF, "documents").count() * table(spark, SF, "nation").count()
    assert rows.filter("match_count = 0").count() > 0


def test_marks_in_texts_and_word_starts(spark):
    texts = ["\ufffea1\ufffe b22\ufffe", "a1", "", "\ufffe", "x a1 a1a2", None, "é a1😀 b22\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = rows.select("id", tx.regex_spans(F.col("text"), "[a-z][0-9]+").alias("s")).orderBy("id").collect()
    want = [[(m.start(), m.end(), m.group()) for m in re.finditer("[a-z][0-9]+", t or "")] for t in texts]
    assert [[(s.start, s.end, s.value) for s in r.s] for r in got] == want
    words = "Tab tabs a-tab _tab 9tab Étab tab"
    made = java_pattern(r"\btab", "gi")
    assert made.startswith("(?i)(?=t)")
    found = spark.createDataFrame([(words,)], "t string").select(tx.regex_spans(F.col("t"), made).alias("s")).first().s
    assert [s.start for s in found] == [m.start() for m in re.finditer(r"(?i)(?<![A-Za-z0-9_])tab", words)]


def test_steps_hold_little():
    # every step of an aggregate copies what it holds
    assert tx._BLOCK / 2 + tx._CHUNK / (2 * tx._BLOCK) <= 64


def test_values_are_cleaned_once(spark):
    # a lambda's body is not searched for common expressions: what is written twice runs twice
    from spanveil.functions import checksums, masking

    row = spark.createDataFrame([("x",)], "v string")
    cleaned = lambda made: row.select(made(F.col("v")))._jdf.queryExecution().analyzed().toString().count("regexp_replace(")
    for name in ("ssn", "itin", "cpf", "nhs", "australian_tfn", "canadian_sin", "aadhaar", "luhn", "npi"):
        plan = row.select(checksums.VALIDATORS[name](F.col("v")))._jdf.queryExecution().analyzed().toString()
        assert plan.count("[^0-9]") <= 2, name  # the expression and its name
    assert cleaned(masking.mask_context) <= 2


def test_masked_context_in_one_pass(spark):
    from spanveil.functions.masking import mask_context

    texts = ["", " ", "\n\t ", "a", " a", "a ", "é😀 b\n\nc  ", "x y", " q　r ", "*", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [r.m for r in rows.select("id", mask_context(F.col("t")).alias("m")).orderBy("id").collect()]
    assert got == [None if t is None else " ".join("*" for _ in t.split()) for t in texts]
    long = spark.createDataFrame([("éa" * 200_000 + " x\n" * 100_000,)], "t string")
    assert long.select(F.length(mask_context(F.col("t"))).alias("n")).first().n == 200_001


def test_few_and_many_matches_alike(spark):
    word = "aé😀 7 "
    texts = [word * n for n in (1, tx._FEW - 1, tx._FEW, tx._FEW + 1, 40, 5000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    emit = lambda m: (m.derived != "9", F.struct(m.start.alias("s"), m.end.alias("e"), m.left.alias("l"), m.rest.alias("r")))
    made = tx.match_spans(
        F.col("t"), "[0-9]", emit, window=7, rest=3, item="struct<s:int,e:int,l:string,r:string>", derive=lambda m: m.value
    )
    for r in rows.select("t", made.alias("m")).collect():
        want = [(i, i + 1, r.t[max(0, i - 7):i], r.t[i + 1:i + 4]) for i, c in enumerate(r.t) if c == "7"]
        assert [tuple(x) for x in r.m] == want


def test_national_numbers_are_sought_only_where_one_can_stand(spark):
    from spanveil.functions import detectors as det

    probe, members = next((p, m) for p, m in det.FAMILIES if "canadian_sin" in m)
    texts = {
        "social 219-09-9999 visa 4111111111111111": False, "ref 130 692 544.": True, "ref 9434765919": False,
        "NHS 9434765919": True, "ref 2341 2341 2346": True, "ref 529.982.247-25": True, "TFN 12345678": True,
        "Social Insurance no 130692544": True, "ref 130-692-54": True,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    seen = rows.select("t", probe(F.col("t"), F.lower("t")).alias("p"), *[det.DETECTORS[c](F.col("t")).alias(c) for c in members])
    for r in seen.collect():
        assert r.p == texts[r.t] and (r.p or not any(r[c] for c in members)), r.t


def test_fast_patterns_match_alike(spark):
    from spanveil.functions import detectors as det

    texts = [
        "born 01/02/1990, 2001-02-03 x9/9/2001 9-9-2001", "4111 1111 1111 1111 3782-822463-10005 x4111111111111 12345678901234",
        "912-70-1234 912701234 1912701234", "_1EG4-TE5-MK73 1EG4TE5MK73",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern, first in ((det.DOB, "[0-9]"), (det.CARD, "[0-9]{4}"), (det.ITIN, "9"), (det.MBI_RUN, "[0-9A-Z]{4}")):
        fast = tx.matcher(det._shared(pattern), first)
        assert fast.count("(?<!") <= pattern.count("(?<!")
        both = rows.select(*[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(n) for n, p in (("a", pattern), ("b", fast))])
        assert all(r.a == r.b for r in both.collect())


def test_walk_hands_over_rows_of_many_pages(spark):
    from spanveil.operators import pages as pg

    html = ["<body>" + "<p class='c' style='Opacity: 0'>x</p>" * pg._ROWS, None, "", "<svg width='9px'><text>t</text></svg><input value=v>"]
    rows = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    els = pg.elements(rows)
    assert "MapInArrow" in els._jdf.queryExecution().executedPlan().toString()
    got = sorted(els.collect(), key=lambda r: (r.page_id, r.seq))
    assert len(got) == 1 + 2 * pg._ROWS + 5 and all(r.excluded and r.hidden for r in got[1:-5])
    assert [r.attrs for r in got[:3]] == [{}, {"class": "c", "style": "Opacity: 0"}, None]
    assert [(r.kind, r.text, r.small_svg, r.parent, r.table_no) for r in got[-5:]] == [
        ("element", None, True, -1, None), ("element", None, True, 0, None), ("text", "t", True, 0, None),
        ("element", None, False, -1, None), ("input", "v", False, -1, None),
    ]


def test_segments_are_trimmed_at_their_ends(spark):
    from spanveil.operators import segments as sg

    blank = re.compile(r"[ \t\n\x0b\f\r\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
    for code in range(0x10000):
        assert bool(blank.match(chr(code))) == (chr(code) in sg._TRIM), code
    raws = [sg._TRIM + "é😀 b\u200b c" + sg._TRIM, "a", sg._TRIM, "", " a\n\nb\u3000", "\u200c x", None, "x" + " " * 30_000 + "y"]
    rows = spark.createDataFrame([(1, i, t, i == 4) for i, t in enumerate(raws)], "doc_id long, seq long, raw string, is_input boolean")
    made = sg.trim_segments(rows)
    assert "regexp_replace" not in made._jdf.queryExecution().analyzed().toString()
    got = [(r.seq, r.text, r.start_offset, r.end_offset) for r in made.orderBy("seq").collect()]
    want = []
    for i, t in enumerate(raws):
        kept = (t or "").strip(sg._TRIM)
        if kept:
            lead = 0 if i == 4 else len(t) - len(t.lstrip(sg._TRIM))
            want.append((i, kept, lead, lead + len(kept)))
    assert got == want


def test_leak_check_scans_only_what_holds_a_value(spark, monkeypatch):
    from spanveil.operators import scan

    rows = spark.createDataFrame(
        [(1, "a@b.de x", "[R] x"), (2, "none", "none"), (3, "a@b.de c@d.de", "[R] c@d.de"), (4, None, None)],
        "id long, text string, redacted string",
    )
    scanned = scan.scan_documents(rows, categories=["email"])
    check = lambda df: sorted(tuple(r) for r in scan.leak_verify(df, "redacted", ["id"], ["email"]).collect())
    want = [(1, 1, 0, True), (2, 0, 0, False), (3, 2, 1, False), (4, 0, 0, False)]
    assert check(scanned) == want
    refused = F.raise_error(F.lit("scanned again")).cast(SPANS)
    monkeypatch.setattr(scan, "detection_column", lambda *a: refused)
    assert check(scanned.filter("id <> 3")) == [want[0], want[1], want[3]]
    with pytest.raises(Exception, match="scanned again"):
        check(scanned)


def test_texts_that_are_several_surfaces_are_scanned_once(spark):
    from spanveil.operators import scan

    names = F.array(F.lit("alt"), F.lit("title"))
    texts = spark.createDataFrame([(1, "a@b.de\nc@d.de"), (2, "")], "id long, text string").select(
        "id", "text", F.length("text").alias("page_chars"), names.alias("attributes")
    )
    found = lambda surface: scan.report_only(texts.withColumn("surface", surface), ["id"], ["email"])
    both = sorted(found(F.array(F.lit("svg"), F.lit("attr"))).collect())
    assert both == sorted([r for s in ("svg", "attr") for r in found(F.lit(s)).collect()]) and len(both) == 4


def test_selection_reads_findings_that_were_detected_once(spark, monkeypatch):
    from spanveil.operators import scan
    from spanveil.plans import findings

    monkeypatch.setattr(scan, "detection_column", lambda text, categories=(): regex_spans(F.col(text), "DOB", "dob"))
    plan = findings.apply_selection(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "DOB" not in plan


def test_pages_from_tokens_and_from_arrays_of_tokens(spark):
    from spanveil.operators import tokens as tk
    from spanveil.plans import findings

    parts = findings.word_pages(spark, SF)
    rows = tk.assemble_pages(findings.words(spark, SF))
    pages = tk.assemble_pages(parts)
    assert parts.count() == pages.count() == findings.page_keys(spark, SF).count()
    assert rows.exceptAll(pages).count() == 0 and pages.exceptAll(rows).count() == 0
    # parts of one page, in any order and twice
    box = F.struct(*[F.lit(1.0).alias(c) for c in ("x", "y", "width", "height")])
    token = lambda seq, word: F.struct(F.lit(seq).alias("seq"), F.lit(seq // 2).alias("line"), F.lit(word).alias("word"), box.alias("bbox"))
    split = [F.array(token(2, "é😀"), token(3, "d")), F.array(token(0, "a"), token(1, "bc"))]
    made = spark.range(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("page"), F.explode(F.array(*split)).alias("part"))
    page = tk.assemble_pages(made).first()
    assert page.page_text == "a bc\né😀 d" and [(t.start, t.end) for t in page.tokens] == [(0, 1), (2, 4), (5, 7), (8, 9)]


def test_few_and_many_spans_meet_the_same_tokens(spark, monkeypatch):
    from spanveil.operators import tokens as tk

    rows = spark.createDataFrame(
        [([(0, 3), (4, 4), (5, 9), (10, 12)], s) for s in ([], [(0, 1)], [(2, 6)], [(3, 4), (4, 5)], [(8, 11), (11, 30)])],
        "t array<struct<start:int,end:int>>, s array<struct<start:int,end:int>>",
    )
    cut = lambda: [r.c for r in rows.select(tk.token_slices(F.col("t"), F.col("s")).alias("c")).collect()]
    few = cut()
    monkeypatch.setattr(tk, "_FEW_SPANS", -1)
    assert few == cut() and [len(c) for c in few] == [0, 1, 1, 2, 2]


def test_fast_classes_hold_the_same_characters(spark):
    codes = spark.range(0x10000).filter("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    wrong = [F.count_if(F.rlike("c", F.lit(slow)) != F.rlike("c", F.lit(fast))) for slow, fast in tx._FAST.items()]
    assert not any(codes.select(*wrong).first())
    assert tx.matcher(tx.matcher(f"{tx.SEP}a[0-9A-Za-z]")) == tx.matcher(f"{tx.SEP}a[0-9A-Za-z]")


def test_patterns_run_once_and_outside_of_lambdas(spark):
    from spanveil.functions import detectors as det
    from spanveil.operators import scan

    texts = [
        "MRN: AB12345 12 Main St, Springfield, IL 62704 a@b.de sk-ant-0123456789012345678901234", None, "", "\ufffe 219-09-9999",
        "MRN: A123 " * 30, "Patient name: Jane Doe\nmember id X99-1200 NPI 1234567893; " * 100,
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    made = scan.with_spans(rows)
    both = made.select("*", scan.detection_column("text").alias("one")).orderBy("id").collect()
    assert all(r.spans == r.one for r in both)
    assert [len(r.spans) for r in both][1:5] == [0, 0, 1, 30] and len(both[5].spans) >= 200
    assert all(r.text[s.start:s.end] == s.value for r in both for s in r.spans)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.splitlines() if tx.matcher(det.PHONE, "[+(0-9]") in x]
    assert len(lines) == 1 and "AS _hits" in lines[0] and "lambda" not in lines[0].split("AS _hits")[0]
