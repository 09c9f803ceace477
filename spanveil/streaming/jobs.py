"""Structured Streaming forms of the jobs, each with its batch twin."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spanveil.constants import DEFAULT_CATEGORIES, MAX_AUDIT_EVENTS, SESSION_GAPS
from spanveil.functions.masking import redact_placeholder
from spanveil.operators.audit import DELIVERY_SECONDS
from spanveil.operators.prefix import with_running
from spanveil.operators.scan import build_findings, detection_column, with_segments

DEBOUNCE_MS = 150
RESCAN_QUIET_MS = 500
RESET_ABOVE = 50
SCAN_SECONDS = 60


# ---- stateless -----------------------------------------------------------------
def redact_messages(
    messages: DataFrame, text: str = "text", categories: Iterable[str] = DEFAULT_CATEGORIES
) -> DataFrame:
    """Messages with the text replaced by its redacted form, batch or stream.

    The raw column is overwritten, so no later step can pass it on, and a failing
    micro-batch writes nothing.
    """
    spans = detection_column(text, categories)
    scanned = messages.withColumn("_spans", spans)
    return scanned.withColumn(text, redact_placeholder(F.col(text), F.col("_spans"))).withColumn(
        "redactions", F.size("_spans")
    ).drop("_spans")


def guard_decision(mode: Column, has_access: Column, activated_at: Column, sent_at: Column) -> Column:
    """Is this message guarded under the sender's protection mode?"""
    return F.coalesce(
        F.when(mode == "off", False)
        .when(mode == "always-on", has_access)
        .otherwise(activated_at <= sent_at),
        F.lit(False),
    )


def guard_messages(messages: DataFrame, policies: DataFrame, activations: DataFrame) -> DataFrame:
    """Batch twin: as-of lookup of the tab's first activation per message.

    A tab counts as authorised from its first activation on, so one minimum per
    tab replaces a row-by-row as-of join.
    """
    first = activations.groupBy("tab_id").agg(F.min("activated_at").alias("activated_at"))
    joined = messages.join(policies, "user_id", "left").join(first, "tab_id", "left")
    return joined.withColumn(
        "guarded",
        guard_decision(F.col("mode"), F.col("has_access"), F.col("activated_at"), F.col("ts")),
    )


# ---- windows ---------------------------------------------------------------------
def debounce(changes: DataFrame, quiet_ms: int = DEBOUNCE_MS, watermark: str = "10 seconds",
             most: int | None = None) -> DataFrame:
    """Bursts of changes per document, closed by a quiet gap.

    Input: doc_id, ts, kind (added, removed or text).  Above 50 changes in all the
    session is reset, not rescanned.  With ``most`` a kind counts so many at most.
    """

    def capped(kind: str) -> Column:
        n = F.count_if(F.col("kind") == kind)
        return n if most is None else F.least(n, F.lit(most))

    bursts = (
        changes.withWatermark("ts", watermark)
        .groupBy("doc_id", F.session_window("ts", f"{quiet_ms} milliseconds").alias("w"))
        .agg(capped("added").alias("added"), capped("removed").alias("removed"), capped("text").alias("changed"))
    )
    total = F.col("added") + F.col("removed") + F.col("changed")
    return bursts.select(
        "doc_id", F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"),
        "added", "removed", "changed", F.when(total > RESET_ABOVE, "reset").otherwise("rescan").alias("decision"),
    )


def timeout_gap(option: Column) -> Column:
    """Inactivity gap of a session option; "never" keeps a session for a century."""
    gap = F.lit("36500 days")
    for name, seconds in SESSION_GAPS.items():
        gap = F.when(option == name, f"{seconds} seconds").otherwise(gap)
    return gap


def session_expiry(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Sessions per user, ended by the user's own inactivity timeout.

    Input: user_id, ts, session_timeout ("5m", "15m", "30m" or "never").
    """
    return (
        events.withWatermark("ts", watermark)
        .groupBy("user_id", F.session_window("ts", timeout_gap(F.col("session_timeout"))).alias("w"))
        .agg(F.count("*").alias("events"))
        .select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("expires_at"), "events")
    )


# ---- stream-stream joins ------------------------------------------------------------
def drop_stale(results: DataFrame, pending: DataFrame, seconds: int = SCAN_SECONDS) -> DataFrame:
    """Results whose session is the tab's pending one, no later than 60 s after it.

    ``results``: tab_id, session_id, result_ts, ...; ``pending``: tab_id,
    session_id, request_ts.  Both sides carry watermarks, so state is bounded.
    """
    r = results.withWatermark("result_ts", f"{seconds} seconds").alias("r")
    p = pending.withWatermark("request_ts", f"{seconds} seconds").alias("p")
    timely = F.expr(
        "r.tab_id = p.tab_id AND r.session_id = p.session_id AND r.result_ts >= p.request_ts "
        f"AND r.result_ts <= p.request_ts + INTERVAL {seconds} SECONDS"
    )
    return r.join(p, timely).select("r.*")


def settle_stream(requests: DataFrame, reports: DataFrame, seconds: int = DELIVERY_SECONDS) -> DataFrame:
    """Delivery outcome per request; a missing, late or negative report is an error.

    The first report of a request counts: of a stream the first to arrive, remembered
    until the watermark passes it, of a table the earliest.
    """
    q = requests.withWatermark("ts", f"{seconds} seconds").alias("q")
    if reports.isStreaming:
        first = reports.withWatermark("report_ts", f"{seconds} seconds").dropDuplicatesWithinWatermark(["request_id"])
    else:
        first = reports.groupBy("request_id").agg(
            F.min_by("delivered", "report_ts").alias("delivered"), F.min("report_ts").alias("report_ts")
        )
    p = first.alias("p")
    match = F.expr(
        "q.request_id = p.request_id AND p.report_ts >= q.ts "
        f"AND p.report_ts <= q.ts + INTERVAL {seconds} SECONDS"
    )
    return q.join(p, match, "leftOuter").select(
        F.col("q.request_id").alias("request_id"), F.col("q.ts").alias("ts"),
        F.when(F.col("p.delivered"), "ok").otherwise("error").alias("outcome"),
    )


# ---- keyed state ----------------------------------------------------------------------
class AuditRing(StatefulProcessor):
    """Newest ``keep`` events per key; emits the ring's size and span when it changes."""

    keep = MAX_AUDIT_EVENTS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "ts timestamp, event_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.ring.get())
        for batch in rows:
            held.extend(batch[["ts", "event_id"]].itertuples(index=False, name=None))
            # Trimmed per batch, so the list never outgrows one batch plus the ring.
            held = sorted(held, key=lambda e: (e[0], e[1]))[-self.keep :]
        self.ring.put(held)
        yield pd.DataFrame({
            "tenant": [key[0]], "kept": [len(held)],
            "oldest": [held[0][0]], "newest": [held[-1][0]],
        })

    def close(self) -> None:
        pass


def newest_per_key(rows: Iterator[pd.DataFrame], key: str, order: list[str], keep: int) -> Iterator[pd.DataFrame]:
    """The newest ``keep`` rows of every key among those that pass, in bounded memory.

    Several times the rows kept are held at most; then what is left goes out and the
    selection starts anew, which only lets some more rows pass.
    """
    held = None

    def trimmed(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.sort_values(order).groupby(key, dropna=False, sort=False).tail(keep)

    for batch in rows:
        held = trimmed(batch if held is None else pd.concat([held, batch], ignore_index=True))
        if len(held) > 16 * max(keep, 4096):
            yield held
            held = None
    if held is not None and len(held):
        yield held


def audit_ring_stream(events: DataFrame) -> DataFrame:
    """Ring per tenant as a stream; input: tenant bigint, ts, event_id bigint.

    Two levels: every task first keeps its own newest events of a tenant, so that the
    keyed state receives at most a ring a task, however hot the tenant is.
    """
    keep = AuditRing.keep

    def newest(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return newest_per_key(rows, "tenant", ["ts", "event_id"], keep)

    partial = events.select(
        F.col("tenant").cast("bigint").alias("tenant"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").cast("bigint").alias("event_id"),
    ).mapInPandas(newest, "tenant bigint, ts timestamp, event_id bigint")
    return partial.groupBy("tenant").transformWithStateInPandas(
        statefulProcessor=AuditRing(),
        outputStructType="tenant bigint, kept bigint, oldest timestamp, newest timestamp",
        outputMode="Update", timeMode="None",
    )


class AntiRollback(StatefulProcessor):
    """Accepts a pack only when its sequence is above all accepted before.

    Key: pack_id, salt.  Rows of other salts than 0 are known to be stale.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.highest = handle.getValueState("highest", "seq bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pack, salt = key[0], key[1]
        if salt:
            for batch in rows:
                yield pd.DataFrame({"pack_id": pack, "seq": batch["seq"], "verdict": "stale-sequence"})
            return
        # candidates only: two numbers each
        at, seqs = [], []
        for batch in rows:
            at.append(batch["arrived_at"].to_numpy())
            seqs.append(batch["seq"].to_numpy())
        at, seqs = np.concatenate(at), np.concatenate(seqs)
        seqs = seqs[np.lexsort((seqs, at))]
        best = self.highest.get()[0] if self.highest.exists() else None
        reached = np.maximum.accumulate(seqs)
        fresh = np.append(True, seqs[1:] > reached[:-1])
        if best is not None:
            fresh &= seqs > best
        if fresh.any():
            self.highest.update((int(reached[-1]),))
        for i in range(0, len(seqs), 10_000):
            verdict = np.where(fresh[i:i + 10_000], "ok", "stale-sequence")
            yield pd.DataFrame({"pack_id": pack, "seq": seqs[i:i + 10_000], "verdict": verdict})

    def close(self) -> None:
        pass


#: Keys over which rows that need no state are dealt.
SALTS = 64


def anti_rollback_stream(packs: DataFrame) -> DataFrame:
    """Verdict per arriving pack; input: pack_id string, seq bigint, arrived_at.

    Two levels: a row with an earlier one of its pack at or above its sequence is stale
    whatever the state says.  Tasks find most of them piece by piece and deal them over
    ``SALTS`` keys; only rows that raise the maximum of their piece meet in the pack's key.
    """

    def marked(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch.sort_values(["pack_id", "arrived_at", "seq"])
            reached = batch.groupby("pack_id", dropna=False)["seq"].cummax()
            same = batch["pack_id"].eq(batch["pack_id"].shift()) | (batch["pack_id"].isna() & batch["pack_id"].shift().isna())
            stale = same & (batch["seq"] <= reached.shift())
            stale.iloc[:1] = False
            batch["salt"] = np.where(stale, 1 + np.arange(len(batch)) % SALTS, 0)
            yield batch

    dealt = packs.select("pack_id", F.col("seq").cast("bigint").alias("seq"), "arrived_at").mapInPandas(
        marked, "pack_id string, seq bigint, arrived_at timestamp, salt bigint"
    )
    return dealt.groupBy("pack_id", "salt").transformWithStateInPandas(
        statefulProcessor=AntiRollback(), outputStructType="pack_id string, seq bigint, verdict string",
        outputMode="Append", timeMode="None",
    )


def anti_rollback_batch(packs: DataFrame, order: str) -> DataFrame:
    """Batch twin: running maximum of the sequence per pack, safe for a hot pack."""
    earlier = with_running(packs, ["pack_id"], order, maxes={"_best": F.col("seq")})
    stale = F.coalesce(F.col("seq") <= F.col("_best"), F.lit(False))
    return earlier.withColumn("verdict", F.when(stale, "stale-sequence").otherwise("ok")).drop("_best")


def _millis(micros: int) -> int:
    """Milliseconds at which so many microseconds have passed."""
    return -(-micros // 1000)


class TabGuard(StatefulProcessor):
    """Judges a tab's messages once no earlier activation can arrive any more.

    A message that an activation already covers, or whose mode does not ask the tab, goes
    out at once: an earlier activation cannot change that.  Any other is held with an
    event-time timer at its own time; when the watermark passes it, it is judged.  A tab
    without rows for ``idle_ms`` of event time leaves the state.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tab = handle.getValueState("tab", "since bigint, seen bigint, idle bigint")
        self.held = handle.getListState("held", "message_id bigint, text string, us bigint")

    @staticmethod
    def _out(ids, texts, guarded) -> pd.DataFrame:
        return pd.DataFrame({"message_id": ids, "text": texts, "guarded": guarded}).astype({"guarded": bool})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since, seen, idle = self.tab.get() if self.tab.exists() else (None, None, None)
        waiting = []
        for batch in rows:
            first = batch["us"][~batch["is_message"]].min()
            if pd.notna(first):
                since = int(first) if since is None else min(since, int(first))
            newest = _millis(int(batch["us"].max()))
            seen = newest if seen is None else max(seen, newest)
            asked = batch[batch["is_message"]]
            always = (asked["mode"] == "always-on") & asked["has_access"]
            tab = asked["mode"] == "this-tab"
            covered = tab & (asked["us"] >= since if since is not None else False)
            now = ~tab | covered
            if now.any():
                yield self._out(asked["message_id"][now], asked["text"][now], (always | covered)[now])
            waiting.extend(asked.loc[~now, ["message_id", "text", "us"]].itertuples(index=False, name=None))
        waiting = [(int(m), None if t is None else str(t), int(at)) for m, t, at in waiting]
        if waiting:
            self.held.appendList(waiting)
            for at in {_millis(at) for _, _, at in waiting}:
                self.handle.registerTimer(at)
        # the idle timer moves with the newest row
        if idle is not None and idle != seen + self.idle_ms:
            self.handle.deleteTimer(idle)
        self.handle.registerTimer(seen + self.idle_ms)
        self.tab.update((since, seen, seen + self.idle_ms))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        since, seen, idle = self.tab.get() if self.tab.exists() else (None, None, None)
        due, left = [], []
        for message, text, at in self.held.get() if self.held.exists() else ():
            (due if _millis(at) <= passed else left).append((message, text, at))
        if due:
            # timers of one watermark all see it passed: the first of them releases everything due
            if left:
                self.held.put(left)
            else:
                self.held.clear()
            yield self._out(
                [m for m, _, _ in due], [t for _, t, _ in due], [since is not None and since <= at for _, _, at in due]
            )
        if idle is not None and idle <= passed and not left:
            self.tab.clear()

    def close(self) -> None:
        pass


def guard_stream(
    messages: DataFrame, policies: DataFrame, activations: DataFrame,
    watermark: str = "1 minute", idle: dt.timedelta = dt.timedelta(days=30), salts: int = 16,
) -> DataFrame:
    """Stream form of ``guard_messages``: two streams keyed by tab, static policies.

    An activation may arrive ``watermark`` late and still guards messages sent after it.
    A tab's messages are dealt over ``salts`` keys, to each of which its few activations go,
    so a hot tab is not one task; messages without a policy are judged by the tab.  As in
    every watermarked job, rows later than the watermark are dropped, unguarded or not.
    """
    asked = messages.join(policies, "user_id", "left").select(
        "tab_id", "ts", F.lit(True).alias("is_message"), "message_id", "text",
        F.coalesce("mode", F.lit("this-tab")).alias("mode"), F.coalesce("has_access", F.lit(False)).alias("has_access"),
        F.pmod(F.xxhash64("message_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    opened = activations.select(
        "tab_id", F.col("activated_at").alias("ts"), F.lit(False).alias("is_message"),
        F.lit(None).cast("bigint").alias("message_id"), F.lit(None).cast("string").alias("text"),
        F.lit("off").alias("mode"), F.lit(False).alias("has_access"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    both = asked.unionByName(opened).withColumn("us", F.unix_micros("ts")).withWatermark("ts", watermark)
    return both.groupBy("tab_id", "salt").transformWithStateInPandas(
        statefulProcessor=TabGuard(int(idle.total_seconds() * 1000)),
        outputStructType="message_id bigint, text string, guarded boolean",
        outputMode="Append", timeMode="EventTime",
    )


# ---- incremental rescan ------------------------------------------------------------------
def rescan_documents(segments: DataFrame, changes: DataFrame) -> DataFrame:
    """Current segments after a batch of changes.

    ``segments`` and ``changes`` carry (doc_id, seq, node_id, text); changes add a
    kind.  Removed and changed nodes go, added and changed ones come in.
    """
    touched = changes.select("doc_id", "node_id").distinct()
    kept = segments.join(touched, ["doc_id", "node_id"], "left_anti")
    fresh = changes.filter("kind <> 'removed'").select("doc_id", "seq", "node_id", "text")
    return kept.select("doc_id", "seq", "node_id", "text").unionByName(fresh)


def rescan_findings(segments: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all findings of the rebuilt documents, those whose id is new)."""
    texts = segments.groupBy("doc_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), "\n"
        ).alias("text")
    )
    scanned = texts.withColumn("spans", detection_column("text"))
    found = build_findings(with_segments(scanned), ["doc_id"])
    return found, found.join(known.select("doc_id", "finding_id"), ["doc_id", "finding_id"], "left_anti")


class RescanSink:
    """``foreachBatch`` writer that rebuilds only the documents a batch touches.

    Three tables (documents touched, their segments, their findings) lie in folders
    ``version=V/bucket=B``, the bucket being a hash of the document.  A manifest for each
    version lists which versions of which buckets are live, so a batch opens only
    the folders of the buckets it touches.  A document's state is its rows of the newest live
    version that has it.  ``compact`` rewrites buckets of several live versions into one.

    A batch reads the newest manifest before its own and overwrites just its own version,
    whose manifest comes last: a retried batch cannot apply a change twice, and one that
    died half way is not seen.
    """

    def __init__(self, root: str, buckets: int = 64, most_live: int = 8):
        self.root, self.buckets, self.most_live = root, buckets, most_live

    # batches have even versions, the compaction after a batch the odd one that follows
    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def _versions(self, spark: SparkSession) -> list[int]:
        """Versions that have a manifest."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        done = [s.getPath() for s in files.listStatus(path)]
        success = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")
        return sorted(int(p.getName().split("=")[1]) for p in done if files.exists(success(p)))

    def live(self, spark: SparkSession, before: int | None = None) -> dict[int, list[int]]:
        """Live versions by bucket, as of a version; buckets times live versions at most."""
        known = [v for v in self._versions(spark) if before is None or v < before]
        if not known:
            return {}
        rows = spark.read.schema("bucket int, live bigint").parquet(f"{self.root}/manifest/version={known[-1]}").collect()
        held: dict[int, list[int]] = {}
        for r in rows:
            held.setdefault(r.bucket, []).append(r.live)
        return held

    _FIELDS = {
        "docs": "doc_id bigint", "segments": "doc_id bigint, seq bigint, node_id string, text string",
        "findings": "doc_id bigint, finding_id string",
    }

    def _read(self, spark: SparkSession, kind: str, live: dict[int, list[int]]) -> DataFrame:
        """Rows with ``version`` and ``bucket``; only folders of live versions are opened."""
        folders = [f"{self.root}/{kind}/version={v}/bucket={b}" for b, versions in live.items() for v in versions]
        # a version may leave a bucket without rows, and then without a folder
        paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in folders]
        files = paths[0].getFileSystem(spark._jsc.hadoopConfiguration()) if paths else None
        folders = [f for f, p in zip(folders, paths) if files.exists(p)]
        if not folders:
            return spark.createDataFrame([], f"{self._FIELDS[kind]}, version bigint, bucket int")
        reader = spark.read.option("basePath", f"{self.root}/{kind}")
        if kind != "findings":
            reader = reader.schema(f"{self._FIELDS[kind]}, version bigint, bucket int")
        return reader.parquet(*folders)

    def current(
        self, spark: SparkSession, kind: str, before: int | None = None,
        only: DataFrame | None = None, buckets: Iterable[int] | None = None,
    ) -> DataFrame:
        """Rows of a table as of a version, for some or all documents and buckets."""
        live = self.live(spark, before)
        if buckets is not None:
            live = {b: live[b] for b in buckets if b in live}
        docs = self._read(spark, "docs", live)
        if only is not None:
            docs = docs.join(only, "doc_id", "left_semi")
        newest = docs.groupBy("doc_id").agg(F.max("version").alias("version"))
        return self._read(spark, kind, live).join(newest, ["doc_id", "version"]).drop("version", "bucket")

    def _write(self, df: DataFrame, kind: str, version: int) -> None:
        # rebalanced, so that a large bucket is written by several tasks
        rows = df.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{kind}/version={version}")

    def _publish(self, spark: SparkSession, live: dict[int, list[int]], version: int) -> None:
        rows = [(b, v) for b, versions in live.items() for v in versions]
        spark.createDataFrame(rows, "bucket int, live bigint").coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/manifest/version={version}"
        )

    def _apply(self, segments: DataFrame, touched: DataFrame, version: int, before: dict[int, list[int]], buckets: list[int]) -> None:
        spark = segments.sparkSession
        self._write(segments.select("doc_id", "seq", "node_id", "text"), "segments", version)
        stored = self._read(spark, "segments", {b: [version] for b in buckets}).drop("version", "bucket")
        none = stored.select("doc_id", F.lit("").alias("finding_id")).filter("false")
        self._write(rescan_findings(stored, none)[0], "findings", version)
        self._write(touched.select(F.col("doc_id").cast("bigint").alias("doc_id")), "docs", version)
        self._publish(spark, {**before, **{b: [*before.get(b, []), version] for b in buckets}}, version)

    def _buckets_of(self, docs: DataFrame) -> list[int]:
        return sorted(r[0] for r in docs.select(self._bucket().alias("b")).distinct().collect())

    def seed(self, segments: DataFrame) -> None:
        docs = segments.select("doc_id").distinct()
        self._apply(segments, docs, -2, {}, self._buckets_of(docs))

    def __call__(self, changes: DataFrame, batch_id: int) -> None:
        spark, version = changes.sparkSession, 2 * batch_id
        touched = changes.select("doc_id").distinct()
        buckets = self._buckets_of(touched)
        before = self.live(spark, version)
        old = self.current(spark, "segments", version, touched, buckets)
        self._apply(rescan_documents(old, changes), touched, version, before, buckets)
        if any(len(v) > self.most_live for v in self.live(spark, version + 1).values()):
            self.compact(spark, batch_id)

    def compact(self, spark: SparkSession, batch_id: int, most_live: int | None = None) -> list[int]:
        """Rewrite buckets with more than ``most_live`` live versions; their old folders are
        no longer read by later batches, and can be removed once no batch can be retried."""
        version = 2 * batch_id + 1
        live = self.live(spark, version)
        limit = self.most_live if most_live is None else most_live
        full = {b: v for b, v in live.items() if len(v) > limit}
        if not full:
            return []
        docs = self._read(spark, "docs", full).select("doc_id").distinct()
        for kind in ("segments", "findings"):
            self._write(self.current(spark, kind, version, buckets=full), kind, version)
        self._write(docs, "docs", version)
        self._publish(spark, {**live, **{b: [version] for b in full}}, version)
        return sorted(full)
