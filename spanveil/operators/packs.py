"""Rule packs: parsing, admission, sequence bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.constants import MAX_PACK_BYTES, MAX_PACK_RULES
from spanveil.operators.rules import community_rule_valid

PACK_SCHEMA = (
    "packId string, issuedAt string, expiresAt string, seq double, minClientVersion string, "
    "rules array<struct<ruleId:string,name:string,category:string,pattern:string,flags:string,"
    "confidence:double,totalVotes:double,upvotes:double,downvotes:double,"
    "verificationStatus:string,createdByHandle:string,createdAt:string>>"
)
_FIELDS = {
    "rule_id": "ruleId", "name": "name", "category": "category", "pattern": "pattern",
    "flags": "flags", "confidence": "confidence", "total_votes": "totalVotes",
    "upvotes": "upvotes", "downvotes": "downvotes", "verification_status": "verificationStatus",
    "created_by_handle": "createdByHandle", "created_at": "createdAt",
}
MAX_CONFIDENCE = 0.90


def version_numbers(version: Column) -> Column:
    """Dotted version as integers, null when it cannot be parsed."""
    plain = F.regexp_replace(F.trim(version), "^[vV]", "")
    numbers = F.transform(F.split(plain, r"\."), lambda n: n.try_cast("bigint"))
    return F.when(plain.rlike(r"^[0-9]+(\.[0-9]+)*$"), numbers)


def compare_versions(a: Column, b: Column) -> Column:
    """First difference of the padded number lists, 0 when equal, null if unparsable."""
    pairs = F.arrays_zip(version_numbers(a).alias("a"), version_numbers(b).alias("b"))
    gaps = F.transform(pairs, lambda p: F.coalesce(p["a"], F.lit(0)) - F.coalesce(p["b"], F.lit(0)))
    return F.when(
        gaps.isNotNull(),
        F.coalesce(F.get(F.filter(gaps, lambda g: g != 0), F.lit(0)), F.lit(0)),
    ).cast("bigint")


def parse_packs(packs: DataFrame, body: str = "body") -> DataFrame:
    """Add ``pack``, ``reason`` (null when sound) and ``detail``.

    One invalid rule rejects the whole pack and is named by its index.
    """
    p = F.col("pack")
    parsed = packs.withColumn("pack", F.from_json(F.col(body), PACK_SCHEMA))
    bad_rules = F.filter(
        F.transform(
            p["rules"],
            lambda r, i: F.struct(i.alias("i"), community_rule_valid(lambda n: r[_FIELDS[n]]).alias("ok")),
        ),
        lambda x: ~x["ok"],
    )
    first_bad = F.get(bad_rules, F.lit(0))["i"]
    malformed = ~F.coalesce(
        p["packId"].rlike("^[A-Za-z0-9._-]{1,64}$")
        & p["issuedAt"].try_cast("timestamp").isNotNull()
        & p["expiresAt"].try_cast("timestamp").isNotNull()
        & (p["seq"] >= 0) & (p["seq"] == F.floor(p["seq"]))
        & version_numbers(p["minClientVersion"]).isNotNull()
        & (F.size(p["rules"]) <= MAX_PACK_RULES) & p["rules"].isNotNull(),
        F.lit(False),
    )
    reason = (
        F.when(F.octet_length(body) > MAX_PACK_BYTES, "too-large")
        .when(malformed, "malformed")
        .when(first_bad.isNotNull(), "invalid-rules")
    )
    return parsed.withColumn("reason", reason).withColumn(
        "detail", F.when(F.col("reason") == "invalid-rules", F.concat(F.lit("rule at index "), first_bad))
    )


def admit_packs(parsed: DataFrame, accepted: DataFrame, now: Column, client_version: Column,
                skew_hours: int = 24) -> DataFrame:
    """Verdict per parsed pack.

    ``has_key`` and ``signature_ok`` are input columns; ``accepted`` holds the
    highest sequence per pack_id.
    """
    p = F.col("pack")
    best = accepted.groupBy(F.col("pack_id").alias("_id")).agg(F.max("seq").alias("_best"))
    joined = parsed.join(best, p["packId"] == F.col("_id"), "left")
    newer = compare_versions(client_version, p["minClientVersion"])
    verdict = (
        F.when(~F.col("has_key"), "not-configured")
        .when(F.col("reason").isNotNull(), F.col("reason"))
        .when(p["expiresAt"].try_cast("timestamp") <= now, "expired")
        .when(p["issuedAt"].try_cast("timestamp") - F.expr(f"INTERVAL {skew_hours} HOURS") > now, "not-yet-valid")
        .when(newer.isNull() | (newer < 0), "client-too-old")
        .when(~F.col("signature_ok"), "bad-signature")
        .when(p["seq"] <= F.col("_best"), "stale-sequence")
    )
    return joined.withColumn("verdict", F.coalesce(verdict, F.lit("ok"))).drop("_id", "_best")


def accept_packs(accepted: DataFrame, fresh: DataFrame) -> DataFrame:
    """Highest accepted sequence and its expiry per pack."""
    both = accepted.select("pack_id", "seq", "expires_at").unionByName(
        fresh.select("pack_id", "seq", "expires_at")
    )
    return both.groupBy("pack_id").agg(
        F.max("seq").alias("seq"), F.max_by("expires_at", F.struct("seq", "expires_at")).alias("expires_at")
    )


def clamp_confidence(rules: DataFrame) -> DataFrame:
    return rules.withColumn("confidence", F.least("confidence", F.lit(MAX_CONFIDENCE))).withColumn(
        "source", F.lit("community")
    )
