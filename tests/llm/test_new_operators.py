"""Fingerprints, conversation repair and tokenizer alignment against brute force."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import struct
import zlib

import duckdb
import pytest
import xxhash
from cases import SCHEMA, SF, empty, odd, rows
from pyspark.sql import functions as F

from spanveil.llm import conversation_repair, fingerprints, token_alignment
from spanveil.llm.queries import ALIGNED, QUERIES

# --- fingerprints -----------------------------------------------------------------------


def _long(value, seed):
    return xxhash.xxh64_intdigest(struct.pack("<q" if value < 2**63 else "<Q", value), seed)


def _terms(text):
    words = {w for w in re.split(r"[\W_]+", text.lower()) if w}
    hashed = {xxhash.xxh64_intdigest("term", xxhash.xxh64_intdigest(w, 42)) for w in words}
    return hashed or {xxhash.xxh64_intdigest(text, 42)}


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def _brute_fingerprint(text, kept_buckets):
    found = _terms(text)
    kept = {t for t in found if t % fingerprints.BUCKETS in kept_buckets}
    chosen = sorted(map(_signed, kept if len(kept) >= fingerprints.LEAST_TERMS else found))
    level = len(chosen).bit_length() - 1
    out = [level]
    for k, salt in ((level, 1), (level + 1, 1)):
        for s in range(fingerprints.SUBSETS):
            mine = [
                t for t in chosen
                if (xxhash.xxh64_intdigest(struct.pack("<i", salt), _long(t, 42)) >> 8) % 2**k == s
            ]
            value = 42
            for t in mine:
                value = _long(t, value)
            out.append(_signed(value) % 65_535 + 1 if mine else 0)
    return out


def _brute_likeness(a, b):
    n = fingerprints.SUBSETS
    levels = lambda f: {f[0]: f[1:1 + n], f[0] + 1: f[1 + n:]}
    shared = levels(a).keys() & levels(b).keys()
    if not shared:
        return 0.0
    one, two = levels(a)[max(shared)], levels(b)[max(shared)]
    held = [(x, y) for x, y in zip(one, two) if x or y]
    return sum(x == y for x, y in held) / len(held) if held else 0.0


def _brute_documents(docs):
    """Expected rows; ``docs`` in the order of the operator."""
    counts = collections.Counter(b for _, t in docs for b in {x % fingerprints.BUCKETS for x in _terms(t)})
    low, high = (share * len(docs) for share in fingerprints.BAND)
    kept = {b for b, n in counts.items() if low <= n <= high}
    show = lambda f: f"{f[0]:02x}" + "".join(f"{x:04x}" for x in f[1:])
    out = []
    for i, (doc, text) in enumerate(docs):
        other = docs[(i + 1) % len(docs)][1]
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + other[:quarter]
        a, b, c = (_brute_fingerprint(t, kept) for t in (text, edited, other))
        out.append((
            doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b),
            _brute_likeness(a, b), _brute_likeness(a, c),
        ))
    return out


def test_fingerprints_equal_brute_force(spark):
    got = sorted(tuple(r) for r in QUERIES["op11_fingerprints"](spark, SF).collect())
    want = sorted(_brute_documents([(d, t or "") for d, t in rows()]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5:] for g in got] == [pytest.approx(w[5:]) for w in want]
    # a quarter replaced stays alike, unrelated neighbours do not
    alike = [g[5] for g in got if g[1] > 200]
    assert sum(alike) / len(alike) > 0.4 and sum(g[6] for g in got) / len(got) < 0.05


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_next_document_over_any_number_of_blocks(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        ids = random.Random(3).sample(range(-500, 5000), 300) + [None]
        docs = spark.createDataFrame([(i, i) for i in ids], "doc_id long, tie long")
        docs = docs.withColumn("tie", F.coalesce("tie", F.lit(7)))
        got = {r.doc_id: r.next.doc_id for r in fingerprints.with_next(docs, ["doc_id"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(ids, key=lambda i: (i is not None, i))
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_fingerprints_of_odd_rows(spark):
    found = fingerprints.fingerprint_documents(odd(spark, extra=True))
    assert found.columns == [
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    ]
    got = found.collect()
    assert len(got) == 11 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    prints = collections.defaultdict(set)
    for r in got:
        prints[r.doc_id].add(r.fingerprint)
    assert prints[1] == prints[2] and prints[5] == prints[6] == prints[None]
    # both empty: their edited texts and fingerprints are equal
    assert {r.near_edited for r in got if r.doc_id in (1, 2)} == {1.0}
    assert fingerprints.fingerprint_documents(empty(spark)).count() == 0
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(4, "alone", "en", "a", 5)], SCHEMA)).first()
    assert one.edited_sha256 == hashlib.sha256(b"alona").hexdigest() and one.near_next == 1.0


def test_fingerprints_need_no_python(spark):
    plan = QUERIES["op11_fingerprints"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- conversation repair ----------------------------------------------------------------

PATTERN = re.compile(r"(s?(ua)+)?\Z")
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def _cheapest(code):
    """Plain Dijkstra over (cost, audit), forward only."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(code) and q in (0, 3):
            return cost, audit
        if (i, q) in seen:
            continue
        seen.add((i, q))
        moves = [(3, "I", i, STEP.get((q, r))) for r in "ua"]
        if i < len(code):
            moves.append((4, "D", i + 1, q))
            if code[i] != "-":
                extra = 3 if code[i].isupper() else 0
                moves.append((extra, "K", i + 1, STEP.get((q, code[i].lower()))))
                moves += [(3 + extra, "R", i + 1, STEP.get((q, r))) for r in "ua"]
        for price, letter, j, to in moves:
            if to is not None:
                heapq.heappush(heap, (cost + price, audit + letter, j, to))


def test_bidirectional_search_equals_plain_search():
    for n in range(5):
        for code in itertools.product("suaoSUA-", repeat=n):
            code = "".join(code)
            assert conversation_repair.search(code, 0, (0, 3)) == _cheapest(code), code
    rng = random.Random(5)
    for _ in range(300):
        code = "".join(rng.choices("suaoUA-", [1, 6, 6, 1, 2, 2, 2], k=rng.randint(5, 60)))
        assert conversation_repair.search(code, 0, (0, 3)) == _cheapest(code), code


@pytest.mark.parametrize("width", [1, 3, 16])
def test_pieces_fold_to_the_whole(monkeypatch, width):
    monkeypatch.setattr(conversation_repair, "PIECE", width)
    rng = random.Random(width)
    for _ in range(80):
        code = "".join(rng.choices("suaoUA-", [1, 5, 5, 1, 2, 2, 3], k=rng.randint(0, 60)))
        cuts = sorted({0, len(code), *(rng.randint(0, len(code)) for _ in range(4))})
        pieces = [(code[a:b], conversation_repair.between(code[a:b]) if rng.random() < 0.5 else None) for a, b in zip(cuts, cuts[1:])]
        assert conversation_repair.folded(pieces or [("", None)]) == _cheapest(code), code


def _brute_conversations(table):
    """Expected rows from (conv_id, turn, role, text) by the words of the contract."""
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text in table:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        held = by_conv[conv]
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        held += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, held in by_conv.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, faults, code = set(), collections.Counter(), ""
        for _, role, text in held:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            first = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not solid:
                fault, letter = "blank", "-"
            elif (role, text) in seen:
                fault, letter = "duplicate", "-"
            elif solid[-1] not in ".!?":
                fault, letter = "truncated", first.upper()
            else:
                fault, letter = None, first
            faults[fault] += 1
            seen.add((role, text))
            code += letter
        turns = [r[0] for r in held if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in held]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = _cheapest(code)
        made, queue = [], list(held)
        odd_count = (len(audit) - audit.count("D")) % 2
        for letter in audit:
            role = ("user", "assistant")[(len(made) - odd_count) % 2]
            if letter == "I":
                made.append((role, ""))
                continue
            _, own, text = queue.pop(0)
            if letter != "D":
                made.append((own if letter == "K" else role, text))
        assert not queue and PATTERN.match("".join(r[:1] for r, _ in made))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def test_repair_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted((tuple(r) for r in QUERIES["op12_conversation_repair"](spark, sf).collect()), key=str)
    table = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet'").fetchall()
    assert got == _brute_conversations(table)


def test_repair_of_odd_conversations(spark):
    rng = random.Random(8)
    texts = ["Fine.", "no end", "", " \t", "Why?", None, "Ja! ", "é ", "A b c.\n"]
    table = []
    for conv in [*range(60), None]:
        turns = rng.sample(range(-3, 40), rng.randint(1, 9)) + ([None] if rng.random() < 0.3 else [])
        table += [(conv, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for t in turns]
    table += [(99, 5, "user", "Same."), (99, 5, "user", "Same."), (99, 5, "user", "Same."), (99, 6, "assistant", "x" * 300_000 + ".")]
    # one long conversation over many pieces and partitions
    table += [(100, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"Say {t}.", f"cut {t}", ""])) for t in range(1500)]
    df = spark.createDataFrame(table, TURNS).repartition(5)
    extra = df.selectExpr("*", "1 AS code", "2 AS h1", "'x' AS gone", "3 AS kind", "4 AS part", "'c' AS c")
    got = sorted((tuple(r) for r in conversation_repair.repair(conversation_repair.damaged(extra)).collect()), key=str)
    assert got == _brute_conversations(table)
    none = conversation_repair.repair(conversation_repair.damaged(spark.createDataFrame([], TURNS)))
    assert none.count() == 0


# --- tokenizer alignment ----------------------------------------------------------------


def _brute_alignment(docs):
    import public_tokenizers

    a_path, b_path = map(public_tokenizers.path, ALIGNED)
    made = token_alignment.aligner(a_path, b_path)
    whole, pairs = [], collections.Counter()
    for doc, text in docs:
        a = made.a.made.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = made.b.made.encode(text) if text else []
        a_bytes, b_bytes = [made.a.bytes[i] for i in a], [made.b.bytes[i] for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            whole.append((doc, 0, 0, 0, [], ""))
            continue
        a_ends = list(itertools.accumulate(map(len, a_bytes)))
        b_ends = list(itertools.accumulate(map(len, b_bytes)))
        at = collections.defaultdict(list)
        for i, e in zip(b, b_ends):
            at[e].append(i)
        links = [(i, k) for i, e in zip(a, a_ends) for k in at.get(e, ())]
        pairs.update(links)
        groups, i, k = [], 0, 0
        for cut in sorted(set(a_ends) & set(b_ends)):
            one, two = [], []
            while i < len(a) and a_ends[i] <= cut:
                one.append(str(a[i]))
                i += 1
            while k < len(b) and b_ends[k] <= cut:
                two.append(str(b[k]))
                k += 1
            groups.append(",".join(one) + "|" + ",".join(two))
        whole.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.Counter()
    for (_, k), n in pairs.items():
        best[k] = max(best[k], n)
    return sorted(
        (
            (d, x, y, g, len(links), sum(pairs[p] == best[p[1]] for p in links), sum(pairs[p] for p in links), h)
            for d, x, y, g, links, h in whole
        ),
        key=str,
    )


@pytest.mark.parametrize("frequent", [1 / 65_536, 0.01, 2.0])
def test_alignment_equals_brute_force(spark, monkeypatch, frequent):
    """With a bound above 1 every irregular pair takes the join."""
    monkeypatch.setattr(token_alignment, "FREQUENT", frequent)
    got = sorted((tuple(r) for r in QUERIES["op13_token_alignment"](spark, SF).collect()), key=str)
    assert got == _brute_alignment(rows())


ODD_TEXTS = [
    "<|endoftext|> and <s> </s> <unk>", "a  b\t\tc\n\n\nd", "▁x", " 　ﬁ ½", "中文字符和 emoji \U0001f600\U0001f468‍\U0001f469",
    "\x00\x01null", " lead and trail ", "'s 'll don't", "A" * 3000, "0x41 <0x41>", "﻿bom", "é" + "é",
]


def test_alignment_of_odd_rows(spark):
    import public_tokenizers

    paths = list(map(public_tokenizers.path, ALIGNED))
    base = odd(spark, extra=True)
    more = spark.createDataFrame([(100 + i, t, "en", "a", len(t)) for i, t in enumerate(ODD_TEXTS)], SCHEMA)
    docs = base.unionByName(more, allowMissingColumns=True)
    found = token_alignment.align_tokens(docs, *paths)
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == _brute_alignment([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert token_alignment.align_tokens(empty(spark), *paths).count() == 0
    nothing = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", "a", 0)], SCHEMA)
    assert {tuple(r)[1:] for r in token_alignment.align_tokens(nothing, *paths).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_units_equal_whole_texts():
    """Groups put together from units are those of the whole text; a unit that is not
    restored leaves the others usable."""
    import public_tokenizers

    made = token_alignment.Aligner(*map(public_tokenizers.path, ALIGNED))
    texts = [t or "" for _, t in rows()[:60]] + ODD_TEXTS + ["one a▁b two", "x, y; z! e.g. 3.14 (q). end.", "a.b² c². d", "l1.\nl2,\nl3?!"]
    sums, digests, same, pairs = made.batch(texts)
    for i, text in enumerate(texts):
        want = made._text(text) or ("", 0, 0, 0, 0, [], [])
        assert tuple(sums[:, i]) == tuple(want[1:5]), text
        assert digests[i] == (hashlib.sha256(want[0].encode()).hexdigest() if want[0] else "")
        for (ends, ids, times), values in ((same, want[5]), (pairs, want[6])):
            part = slice(ends[i], ends[i + 1])
            assert dict(zip(ids[part].tolist(), times[part].tolist())) == collections.Counter(values)
    assert made.facts[5][made.place[" two"]] and not made.facts[5][made.place[" a▁b"]]


def test_identity_table_matches_bytes():
    import public_tokenizers

    made = token_alignment.aligner(*map(public_tokenizers.path, ALIGNED))
    held = [(i, int(k)) for i, k in enumerate(made.identity) if k >= 0]
    assert len(held) > 10_000 and all(made.a.bytes[i] == made.b.bytes[k] for i, k in held)
    known = set(made.b.bytes)
    assert all(k >= 0 for i, k in enumerate(made.identity) if made.a.bytes[i] in known)
