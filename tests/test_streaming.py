"""Streams fed from files with availableNow give the rows of their batch twins."""

import datetime as dt
import os

import pandas as pd
from pyspark.sql import functions as F

from spanveil.streaming import jobs

T0 = dt.datetime(2026, 1, 1)


def stream(spark, tmp_path, name, rows, schema):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def run(df, checkpoint, name, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start())
    q.awaitTermination(180)
    return df.sparkSession.table(name)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_redact_stream_equals_batch(spark, tmp_path, checkpoint):
    rows = [(1, "mail bob@ex.org"), (2, "nothing"), (3, "4111111111111111 and 219-09-9999")]
    out = run(jobs.redact_messages(stream(spark, tmp_path, "m", rows, "id int, text string")), checkpoint, "redacted")
    got = {r.id: r.text for r in out.collect()}
    assert got == {1: "mail [REDACTED]", 2: "nothing", 3: "[REDACTED] and [REDACTED]"}


def test_debounce_and_sessions(spark, tmp_path, checkpoint):
    rows = [(1, at(i * 0.1), "added") for i in range(60)] + [(1, at(20), "text"), (2, at(20), "removed")]
    # A far later event pushes the watermark so that all bursts close.
    rows += [(9, at(9_000), "added")]
    df = jobs.debounce(stream(spark, tmp_path, "c", rows, "doc_id long, ts timestamp, kind string"))
    got = {(r.doc_id, r.added, r.changed, r.removed, r.decision) for r in run(df, checkpoint, "bursts").collect()}
    assert {(1, 60, 0, 0, "reset"), (1, 0, 1, 0, "rescan"), (2, 0, 0, 1, "rescan")} <= got
    rows = [(1, at(0), "5m"), (1, at(200), "5m"), (1, at(600), "5m"), (2, at(0), "never"), (3, at(90_000), "5m")]
    df = jobs.session_expiry(stream(spark, tmp_path, "e", rows, "user_id long, ts timestamp, session_timeout string"))
    ended = {(r.user_id, r.events) for r in run(df, checkpoint, "ended").collect()}
    assert ended == {(1, 2), (1, 1)}


def test_stream_joins(spark, tmp_path, checkpoint):
    pending = [(1, "a", at(0)), (2, "b", at(0)), (3, "c", at(0)), (9, "z", at(9_000))]
    results = [(1, "a", at(10)), (2, "other", at(10)), (3, "c", at(61)), (9, "z", at(9_001))]
    df = jobs.drop_stale(
        stream(spark, tmp_path, "r", results, "tab_id int, session_id string, result_ts timestamp"),
        stream(spark, tmp_path, "p", pending, "tab_id int, session_id string, request_ts timestamp"))
    assert {r.tab_id for r in run(df, checkpoint, "fresh").collect()} == {1, 9}
    requests = [(i, at(0)) for i in (1, 2, 3, 4)] + [(9, at(9_000))]
    reports = [(1, True, at(5)), (2, False, at(5)), (3, True, at(100)), (9, True, at(9_001))]
    df = jobs.settle_stream(
        stream(spark, tmp_path, "q", requests, "request_id int, ts timestamp"),
        stream(spark, tmp_path, "d", reports, "request_id int, delivered boolean, report_ts timestamp"))
    got = {r.request_id: r.outcome for r in run(df, checkpoint, "settled").collect()}
    assert {1: "ok", 2: "error", 3: "error", 4: "error"}.items() <= got.items()


def test_first_report_settles_a_delivery(spark, tmp_path, checkpoint):
    requests = [(1, at(0)), (2, at(0)), (9, at(4000))]
    reports = [(1, True, at(5)), (1, True, at(9)), (2, True, at(6)), (9, True, at(4001))]
    rs, ps = "request_id int, ts timestamp", "request_id int, delivered boolean, report_ts timestamp"
    df = jobs.settle_stream(stream(spark, tmp_path, "q", requests, rs), stream(spark, tmp_path, "d", reports, ps))
    rows = [(r.request_id, r.outcome) for r in run(df, checkpoint, "first").collect()]
    assert sorted(x for x in rows if x[0] < 9) == [(1, "ok"), (2, "ok")]
    mixed = [(1, False, at(5)), (1, True, at(9)), (2, True, at(3)), (2, False, at(4))]
    batch = jobs.settle_stream(spark.createDataFrame(requests, rs), spark.createDataFrame(mixed, ps))
    assert sorted((r.request_id, r.outcome) for r in batch.collect()) == [(1, "error"), (2, "ok"), (9, "error")]


def test_keyed_state(spark, tmp_path, checkpoint):
    rows = [(1, at(i), i) for i in range(520)] + [(2, at(1), 1)]
    ring = jobs.audit_ring_stream(stream(spark, tmp_path, "a", rows, "tenant long, ts timestamp, event_id long"))
    got = {r.tenant: (r.kept, r.oldest) for r in run(ring, checkpoint, "ring", "update").collect()}
    assert got == {1: (500, at(20)), 2: (1, at(1))}
    packs = [("p", 3, at(0)), ("p", 2, at(1)), ("p", 5, at(2)), ("q", 1, at(0))]
    df = jobs.anti_rollback_stream(stream(spark, tmp_path, "k", packs, "pack_id string, seq long, arrived_at timestamp"))
    assert {(r.pack_id, r.seq, r.verdict) for r in run(df, checkpoint, "packs").collect()} == {
        ("p", 3, "ok"), ("p", 2, "stale-sequence"), ("p", 5, "ok"), ("q", 1, "ok")}


POLICIES = [(1, "this-tab", False), (2, "always-on", True), (3, "off", True), (4, "always-on", False)]
MESSAGE, OPENED = "message_id long, user_id long, tab_id long, ts timestamp, text string", "tab_id long, activated_at timestamp"


def batches(spark, tmp_path, name, parts, schema):
    """A file stream that gives one of ``parts`` a micro-batch."""
    path = tmp_path / name
    path.mkdir()
    for i, rows in enumerate(parts):
        made = tmp_path / f"{name}-{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(made))
        target = path / f"{i:03}.parquet"
        next(made.glob("*.parquet")).rename(target)
        # the source takes older files first
        os.utime(target, (1_700_000_000 + 10 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_guard_stream_equals_batch(spark, tmp_path, checkpoint):
    messages = [(1, 1, 10, at(5), "a"), (2, 1, 10, at(50), "b"), (3, 2, 20, at(5), "c"), (4, 3, 30, at(5), "d"),
                (5, 4, 10, at(60), "e"), (6, 77, 30, at(1), "f"), (7, 1, 40, at(2), None)]
    last = [(9, 1, 99, at(9_000), "z")]
    opened = [(10, at(20)), (30, at(0)), (10, at(70))]
    policies = spark.createDataFrame(POLICIES, "user_id long, mode string, has_access boolean")
    df = jobs.guard_stream(
        batches(spark, tmp_path, "g", [messages, last], MESSAGE), policies, stream(spark, tmp_path, "o", opened, OPENED))
    rows = [(r.message_id, r.guarded) for r in run(df, checkpoint, "guard").collect() if r.message_id < 9]
    batch = jobs.guard_messages(spark.createDataFrame(messages, MESSAGE), policies.fillna(False), spark.createDataFrame(opened, OPENED))
    want = {r.message_id: r.guarded for r in batch.collect()}
    assert len(rows) == len(dict(rows)) and dict(rows) == want
    assert want == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False}


def test_late_activation_guards_earlier_message(spark, tmp_path, checkpoint):
    """The activation comes one batch after the message it covers, inside the watermark."""
    asked = [[(1, 1, 10, at(30), "a"), (2, 1, 10, at(5), "b")], [(3, 1, 11, at(31), "c")], [(9, 1, 99, at(9_000), "z")]]
    opened = [[(55, at(1))], [(10, at(20))], [(56, at(9_000))]]
    policies = spark.createDataFrame(POLICIES, "user_id long, mode string, has_access boolean")
    df = jobs.guard_stream(batches(spark, tmp_path, "g", asked, MESSAGE), policies, batches(spark, tmp_path, "o", opened, OPENED))
    got = [(r.message_id, r.guarded) for r in run(df, checkpoint, "late").collect() if r.message_id < 9]
    assert sorted(got) == [(1, True), (2, False), (3, False)]


def test_idle_tabs_leave_the_state(spark, tmp_path, checkpoint):
    asked = [[(1, 1, 10, at(30), "a")], [(2, 1, 99, at(9_000), "y")], [(3, 1, 99, at(9_001), "z")]]
    opened = [[(10, at(20))], [(99, at(8_999))], [(99, at(9_000))]]
    policies = spark.createDataFrame(POLICIES, "user_id long, mode string, has_access boolean")
    df = jobs.guard_stream(
        batches(spark, tmp_path, "g", asked, MESSAGE), policies, batches(spark, tmp_path, "o", opened, OPENED),
        idle=dt.timedelta(seconds=600), salts=2)
    run(df, checkpoint, "idle")
    state = spark.read.format("statestore").option("stateVarName", "tab").load(f"{checkpoint}/idle")
    assert {r.key.tab_id for r in state.select("key").collect()} == {99}


def test_hot_keys_are_spread(spark, tmp_path, checkpoint, monkeypatch):
    """A hot tenant reaches the ring trimmed by every task; a hot pack's stale rows are dealt."""
    monkeypatch.setattr(jobs.AuditRing, "keep", 20)
    rows = [(1, at((i * 7919) % 3000), i) for i in range(3000)] + [(2, at(5), 5)]
    df = jobs.audit_ring_stream(stream(spark, tmp_path, "a", rows, "tenant long, ts timestamp, event_id long"))
    newest = sorted(r[1] for r in rows if r[0] == 1)[-20:]
    got = {r.tenant: (r.kept, r.oldest, r.newest) for r in run(df, checkpoint, "hot_ring", "update").collect()}
    assert got == {1: (20, newest[0], newest[-1]), 2: (1, at(5), at(5))}
    pieces = [pd.DataFrame({"k": [1] * 50 + [2], "o": list(range(i, i + 50)) + [i]}) for i in range(0, 500, 50)]
    passed = pd.concat(jobs.newest_per_key(iter(pieces), "k", ["o"], 7))
    assert sorted(passed.o[passed.k == 1]) == list(range(493, 500)) and (passed.k == 2).sum() == 7
    packs = [("p", (i * 7919) % 10_007, at(i)) for i in range(4000)] + [("q", 3, at(0)), ("q", 3, at(1)), (None, 1, at(0))]
    parts = [packs[:1500], packs[1500:1501], packs[1501:]]
    schema = "pack_id string, seq long, arrived_at timestamp"
    df = jobs.anti_rollback_stream(batches(spark, tmp_path, "k", parts, schema))
    best, want = {}, []
    for pack, seq, _ in packs:
        fresh = seq > best.get(pack, -1)
        want.append((pack, seq, "ok" if fresh else "stale-sequence"))
        best[pack] = max(seq, best.get(pack, -1))
    assert sorted(map(tuple, run(df, checkpoint, "hot_packs").collect()), key=str) == sorted(want, key=str)
    state = spark.read.format("statestore").option("stateVarName", "highest").load(f"{checkpoint}/hot_packs")
    assert {r.key.pack_id for r in state.select("key").collect()} == {"p", "q", None}


def test_incremental_rescan(spark, tmp_path, checkpoint):
    schema = "doc_id long, seq long, node_id string, text string"
    seed = spark.createDataFrame([(1, 0, "a", "bob@ex.org"), (1, 1, "b", "plain"), (2, 0, "a", "219-09-9999")], schema)
    sink = jobs.RescanSink(str(tmp_path / "state"))
    sink.seed(seed)
    changes = stream(spark, tmp_path, "ch", [(1, 0, "a", "gone", "removed"), (1, 1, "b", "amy@ex.org", "text")], schema + ", kind string")
    q = changes.writeStream.foreachBatch(sink).option("checkpointLocation", f"{checkpoint}/rescan").trigger(availableNow=True).start()
    q.awaitTermination(180)
    found = sink.current(spark, "findings")
    assert {(r.doc_id, r.finding_id) for r in found.collect()} == {(1, "email_0_10_0"), (2, "ssn_0_11_0")}
    # A replayed batch lands in the same version.
    sink(spark.createDataFrame([(1, 0, "a", "gone", "removed"), (1, 1, "b", "amy@ex.org", "text")], schema + ", kind string"), 0)
    assert sink.current(spark, "segments").filter(F.col("doc_id") == 1).count() == 1


def test_rescan_reads_touched_buckets_and_compacts(spark, tmp_path, checkpoint):
    schema = "doc_id long, seq long, node_id string, text string"
    rows = [(d, k, f"n{k}", f"mail u{d}_{k}@ex.org" if k % 2 else f"line {k}") for d in range(40) for k in range(3)]
    sink = jobs.RescanSink(str(tmp_path / "state"), buckets=8, most_live=3)
    sink.seed(spark.createDataFrame(rows, schema))
    state = {(d, n): (k, t) for d, k, n, t in rows}
    for batch in range(3):
        made = []
        for d in (5, 6, 7 + batch):
            made += [(d, 1, "n1", "gone", "removed"), (d, 2, "n2", f"call +1 (743) 555-10{batch}{d % 10}", "text"), (d, 9, f"x{batch}", "new a@ex.org", "added")]
        changes = spark.createDataFrame(made, schema + ", kind string")
        sink(changes, batch)
        if batch == 1:
            sink(changes, batch)  # a retried batch changes nothing
        for d, k, n, t, kind in made:
            state.pop((d, n), None)
            if kind != "removed":
                state[d, n] = (k, t)
    touched = {r[0] for r in spark.createDataFrame([(d,) for d in (5, 6, 7, 8, 9)], "doc_id long").select(sink._bucket()).collect()}
    live = sink.live(spark)
    assert all(len(live[b]) == 1 for b in live if b not in touched) and any(len(live[b]) > 1 for b in touched)
    some = sorted(touched)[:1]
    read = sink.current(spark, "segments", buckets=some).inputFiles()
    assert read and all(f"bucket={some[0]}/" in f for f in read)
    shown = lambda kind: sorted(map(str, sink.current(spark, kind).collect()))
    segments, findings = shown("segments"), shown("findings")
    assert {(r.doc_id, r.node_id): (r.seq, r.text) for r in sink.current(spark, "segments").collect()} == state
    after = spark.createDataFrame([(d, k, n, t) for (d, n), (k, t) in state.items()], schema)
    none = after.select("doc_id", F.lit("").alias("finding_id")).filter("false")
    want = {(r.doc_id, r.finding_id) for r in jobs.rescan_findings(after, none)[0].collect()}
    assert {(r.doc_id, r.finding_id) for r in sink.current(spark, "findings").collect()} == want
    assert sink.compact(spark, 2, most_live=1)
    assert all(len(v) == 1 for v in sink.live(spark).values())
    assert shown("segments") == segments and shown("findings") == findings
