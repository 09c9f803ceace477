"""Counts-only audit trail and reports over findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.constants import MAX_AUDIT_EVENTS
from spanveil.sources.readers import keep_newest

# Actions and outcomes an event may carry.
ACTIONS = [
    "page_scan_completed", "masks_applied", "masks_removed", "doc_previewed", "doc_redacted",
    "doc_cleared", "session_cleared", "preset_applied", "preset_overridden", "account_linked",
]
OUTCOMES = ["ok", "denied", "error"]
DELIVERY_SECONDS = 60


def count_by_category(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys, "category").agg(F.count("*").alias("n"))


def counts_map(counts: DataFrame, keys: list[str]) -> DataFrame:
    """One ``map<category, n>`` per key, in category order; at most 20 entries."""
    entries = F.array_sort(F.collect_list(F.struct("category", "n")))
    return counts.groupBy(*keys).agg(
        F.map_from_entries(entries).alias("counts"), F.sum("n").alias("total")
    )


def top_categories_notice(counts: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """Short notice per key: total and the most frequent categories."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "category")))
    grouped = counts.groupBy(*keys).agg(ranked.alias("_c"), F.sum("n").alias("total"))
    listed = F.transform(
        F.slice("_c", 1, top),
        lambda x: F.concat(-x["r"], F.lit(" "), F.replace(x["category"], F.lit("_"), F.lit(" "))),
    )
    return grouped.select(
        *keys,
        F.concat(
            F.col("total"), F.when(F.col("total") == 1, " value").otherwise(" values"),
            F.lit(" detected on this page: "), F.array_join(listed, ", "), F.lit("."),
        ).alias("notice"),
    )


def unique_categories(findings: DataFrame, keys: list[str]) -> DataFrame:
    return findings.groupBy(*keys).agg(F.array_sort(F.collect_set("category")).alias("categories"))


def host_of(url: Column) -> Column:
    """Host with port of a URL, default ports removed, null when there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\\s]+)(?:[/?#\\]|$)", 1)
    bare = F.lower(F.regexp_replace(authority, "^.*@", ""))
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    port = (
        F.when(scheme == "http", F.regexp_replace(bare, ":(?:80)?$", ""))
        .when(scheme == "https", F.regexp_replace(bare, ":(?:443)?$", ""))
        .otherwise(bare)
    )
    return F.nullif(port, F.lit(""))


def scan_events(counts: DataFrame, scans: DataFrame, keys: list[str]) -> DataFrame:
    """One counts-only event per scan; a scan without findings gets an empty map."""
    mapped = counts_map(counts, keys)
    empty = F.expr("cast(map() as map<string,bigint>)")
    return scans.join(mapped.drop("total"), keys, "left").select(
        *keys, "ts", F.lit("page_scan_completed").alias("action"), "host",
        F.coalesce("counts", empty).alias("counts"), F.lit("ok").alias("outcome"),
    )


def validate_events(events: DataFrame) -> DataFrame:
    """Add ``violation``: the first broken rule, null when the event is sound."""
    c = F.col
    checks = [
        ("ts", F.length("ts") > 0),
        ("action", c("action").isin(ACTIONS)),
        ("outcome", c("outcome").isin(OUTCOMES)),
        ("host", c("host").isNull() | F.length("host").between(1, 253)),
        ("counts", c("counts").isNull() | F.forall(F.map_values("counts"), lambda v: v >= 0)),
        ("doc_hash", c("doc_hash").isNull() | c("doc_hash").rlike("^[a-f0-9]{64}$")),
        ("pages", c("pages").isNull() | (c("pages") >= 0)),
        ("preset_id", c("preset_id").isNull() | F.length("preset_id").between(1, 32)),
        ("gateway_origin", c("gateway_origin").isNull()
         | (c("gateway_origin").startswith("https://") & (F.length("gateway_origin") <= 2048))),
        ("enabled_categories", c("enabled_categories").isNull()
         | F.forall("enabled_categories", lambda x: F.coalesce(F.length(x).between(1, 64), F.lit(False)))),
    ]
    return events.withColumn(
        "violation", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in checks])
    )


def canonical_line() -> Column:
    """Event as JSON with a fixed key order; absent keys are left out."""
    return F.to_json(
        F.struct(
            "ts", "action", "host", "counts", F.col("doc_hash").alias("docHash"), "pages",
            F.col("preset_id").alias("presetId"), F.col("gateway_origin").alias("gatewayOrigin"),
            F.col("enabled_categories").alias("enabledCategories"), "outcome",
        ),
        {"ignoreNullFields": "true"},
    )


def audit_ring(events: DataFrame, keys: list[str], keep: int = MAX_AUDIT_EVENTS) -> DataFrame:
    return keep_newest(events, keys, ["ts", "event_id"], keep)


def audit_manifest(ring: DataFrame, keys: list[str], exported_at: Column) -> DataFrame:
    """Digest of the exact JSON lines of a ring; at most its 500 events are joined."""
    lines = F.array_sort(F.collect_list(F.struct("ts", "event_id", canonical_line().alias("line"))))
    body = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    return ring.groupBy(*keys).agg(lines.alias("_l")).select(
        *keys, F.size("_l").cast("bigint").alias("event_count"), exported_at.alias("exported_at"),
        F.sha2(body, 256).alias("digest"),
    )


def audit_verify(manifest: DataFrame, ring: DataFrame, keys: list[str]) -> DataFrame:
    """Recompute each digest; any later edit shows."""
    again = audit_manifest(ring, keys, F.lit(None).cast("string")).select(
        *keys, F.col("digest").alias("_now")
    )
    return manifest.join(again, keys, "left").select(
        *keys, F.coalesce(F.col("digest") == F.col("_now"), F.lit(False)).alias("intact")
    )


def safe_projection(events: DataFrame) -> DataFrame:
    """The metadata that may leave the device, nothing else."""
    return events.select(
        "event_id", "timestamp", "installation_id", "tenant_id", "user_id", "event_type",
        "policy_id", "policy_version", "operation_result", "request_id", "extension_version",
    )


def settle_deliveries(requests: DataFrame, reports: DataFrame,
                      seconds: int = DELIVERY_SECONDS) -> DataFrame:
    """A redaction is ok only with a timely positive report; silence is an error."""
    first = reports.groupBy("request_id").agg(
        F.min_by("delivered", "report_ts").alias("delivered"), F.min("report_ts").alias("report_ts")
    )
    limit = F.col("ts") + F.expr(f"INTERVAL {seconds} SECONDS")
    timely = F.col("delivered") & (F.col("report_ts") <= limit)
    return requests.join(first, "request_id", "left").select(
        "request_id", "ts", F.lit("doc_redacted").alias("action"),
        F.when(timely, "ok").otherwise("error").alias("outcome"),
    )


def successful_outputs(jobs: DataFrame) -> DataFrame:
    """Complete jobs in enqueue order."""
    return jobs.filter("status = 'complete'").orderBy("enqueued_at", "file_key")
