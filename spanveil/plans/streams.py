"""Batch twins of the streaming jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanveil.plans import sql_text as sql
from spanveil.plans.registry import query, table
from spanveil.streaming import jobs

_OPTION = "CASE user_id % 3 WHEN 0 THEN 300 WHEN 1 THEN 900 ELSE 1800 END"


@query("stream_session_expiry", f"""
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM (
  SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < {_OPTION} * 1000000 THEN 0 ELSE 1 END AS f
    FROM events)) GROUP BY user_id, s""")
def stream_session_expiry(spark, sf_dir):
    k = F.col("user_id") % 3
    events = table(spark, sf_dir, "events").select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(k == 0, "5m").when(k == 1, "15m").otherwise("30m").alias("session_timeout"),
    )
    return jobs.session_expiry(events).select(
        "user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events"
    )


# Events of one user stand for changes of one document; a quiet hour closes a burst.
_KIND = "CASE event_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'text' END"


@query("stream_debounce", f"""
SELECT doc_id, CAST(added AS BIGINT) AS added, CAST(removed AS BIGINT) AS removed, CAST(changed AS BIGINT) AS changed, CASE WHEN added + removed + changed > 50 THEN 'reset' ELSE 'rescan' END AS decision FROM (
  SELECT user_id AS doc_id, s, least(count_if(kind = 'added'), 500) AS added, least(count_if(kind = 'removed'), 500) AS removed,
    least(count_if(kind = 'text'), 500) AS changed FROM (
    SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT *, {_KIND} AS kind, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 14400000000 THEN 0 ELSE 1 END AS f
      FROM events)) GROUP BY user_id, s)""")
def stream_debounce(spark, sf_dir):
    changes = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), F.expr(_KIND).alias("kind")
    )
    return jobs.debounce(changes, quiet_ms=4 * 3600 * 1000).select("doc_id", "added", "removed", "changed", "decision")


@query("stream_guard", """
SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN false WHEN 1 THEN conv_id % 2 = 0 ELSE turn >= 1 + conv_id % 2 END AS guarded FROM conversations""")
def stream_guard(spark, sf_dir):
    c = F.col
    base = F.timestamp_seconds(c("conv_id") * 1000 + c("turn"))
    messages = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", c("conv_id").alias("user_id"), c("conv_id").alias("tab_id"), base.alias("ts")
    )
    users = messages.select("user_id").distinct()
    k = c("user_id")
    policies = users.select(
        k, F.when(k % 3 == 0, "off").when(k % 3 == 1, "always-on").otherwise("this-tab").alias("mode"), (k % 2 == 0).alias("has_access")
    )
    activations = users.select(k.alias("tab_id"), F.timestamp_seconds(k * 1000 + 1 + k % 2).alias("activated_at"))
    return jobs.guard_messages(messages, policies, activations).select("conv_id", "turn", "guarded")


# Every third message gets an address appended; the given ones hold no values.
_MESSAGES = """SELECT role AS src, conv_id * 1000 + turn AS id,
  text || CASE WHEN turn % 3 = 0 THEN ' mail bob' || conv_id || '@ex.org or +1 (743) 555-3824' ELSE '' END AS text FROM conversations"""


@query("stream_redact", f"""
WITH m AS MATERIALIZED ({_MESSAGES}), hit AS MATERIALIZED ({sql.resolved(sql.raw_all("SELECT * FROM m"))})
SELECT id // 1000 AS conv_id, id % 1000 AS turn, redacted AS text FROM ({sql.redacted("SELECT * FROM m", "SELECT * FROM hit", "'[REDACTED]'")})""")
def stream_redact(spark, sf_dir):
    extra = F.concat(F.lit(" mail bob"), "conv_id", F.lit("@ex.org or +1 (743) 555-3824"))
    messages = table(spark, sf_dir, "conversations").withColumn(
        "text", F.concat("text", F.when(F.col("turn") % 3 == 0, extra).otherwise(""))
    )
    return jobs.redact_messages(messages).select("conv_id", "turn", "text")


@query("stream_audit_ring", """
SELECT tenant, count(*) AS kept, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM (
  SELECT user_id % 7 AS tenant, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts DESC, event_id DESC) <= 500) GROUP BY tenant""")
def stream_audit_ring(spark, sf_dir):
    from spanveil.operators.audit import audit_ring

    events = table(spark, sf_dir, "events").withColumn("tenant", F.col("user_id") % 7)
    shown = "yyyy-MM-dd HH:mm:ss"
    return audit_ring(events, ["tenant"]).groupBy("tenant").agg(
        F.count("*").alias("kept"), F.date_format(F.min("ts"), shown).alias("oldest"),
        F.date_format(F.max("ts"), shown).alias("newest"),
    )


@query("stream_anti_rollback", """
SELECT event_id, pack_id, seq, CASE WHEN seq <= max(seq) OVER (PARTITION BY pack_id ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'stale-sequence' ELSE 'ok' END AS verdict
FROM (SELECT event_id, 'p' || (user_id % 3) AS pack_id, (event_id * 7919) % 10007 AS seq FROM events)""")
def stream_anti_rollback(spark, sf_dir):
    arrivals = table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("p"), F.col("user_id") % 3).alias("pack_id"),
        ((F.col("event_id") * 7919) % 10007).alias("seq"),
    )
    return jobs.anti_rollback_batch(arrivals, "event_id").select("event_id", "pack_id", "seq", "verdict")


# Lines of the documents; every fourth line of an even document changes.
_LINES = """SELECT doc_id, i - 1 AS seq, parts[i] AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""
_AFTER = f"""SELECT doc_id, seq, CASE WHEN seq % 4 = 1 AND doc_id % 2 = 0 THEN 'call +1 (743) 555-' || lpad(CAST(1000 + seq AS VARCHAR), 4, '0') ELSE text END AS text
FROM ({_LINES}) WHERE NOT (seq % 4 = 2 AND doc_id % 2 = 0)"""


@query("stream_incremental_rescan", f"""
WITH t AS MATERIALIZED (SELECT 'doc' AS src, doc_id AS id, string_agg(text, chr(10) ORDER BY seq) AS text FROM ({_AFTER}) GROUP BY doc_id),
hit AS MATERIALIZED ({sql.resolved(sql.raw_all("SELECT * FROM t"))})
SELECT id AS doc_id, category || '_' || start_pos || '_' || end_pos || '_' || (row_number() OVER (PARTITION BY id ORDER BY start_pos) - 1) AS finding_id,
  category FROM hit""")
def stream_incremental_rescan(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    segments = lines.select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.concat(F.lit("seg_"), "seq").alias("node_id"), "text")
    even = segments.filter("doc_id % 2 = 0 AND seq % 4 IN (1, 2)")
    call = F.concat(F.lit("call +1 (743) 555-"), F.lpad((1000 + F.col("seq")).cast("string"), 4, "0"))
    changes = even.withColumns({"kind": F.when(F.col("seq") % 4 == 1, "text").otherwise("removed"), "text": call})
    known = segments.select("doc_id", F.lit("").alias("finding_id")).limit(0)
    found, _ = jobs.rescan_findings(jobs.rescan_documents(segments, changes), known)
    return found.select("doc_id", "finding_id", "category")


@query("stream_stale_drop", """
SELECT o_orderkey AS tab_id FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 90 <= 60""")
def stream_stale_drop(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    ts = F.col("o_orderdate").cast("timestamp")
    pending = orders.select(k.alias("tab_id"), k.alias("session_id"), ts.alias("request_ts"))
    results = orders.select(
        k.alias("tab_id"), F.when(k % 4 == 0, -1 - k).otherwise(k).alias("session_id"),
        (ts + F.make_dt_interval(secs=(k % 90).cast("decimal(18,6)"))).alias("result_ts"),
    )
    return jobs.drop_stale(results, pending).select("tab_id")


@query("stream_delivery_settle", """
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 120 <= 60 AND o_orderkey % 7 <> 0 THEN 'ok' ELSE 'error' END AS outcome FROM orders""")
def stream_delivery_settle(spark, sf_dir):
    from spanveil.plans.governance import deliveries

    return jobs.settle_stream(*deliveries(spark, sf_dir)).select("request_id", "outcome")
