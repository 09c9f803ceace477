"""Queries: rules, packs, policies, settings, audit and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanveil.constants import ALL_CATEGORIES, DEFAULT_CATEGORIES, DISPLAY_LABELS, PRESETS
from spanveil.operators import audit, packs, policy, rules
from spanveil.operators import scan as sc
from spanveil.plans import sql_text as sql
from spanveil.plans.findings import (
    CORPUS,
    FINDINGS, KEYS, MIXED, RESOLVED, SCAN, all_rows, mixed_findings, mixed_scan, nation_rules,
)
from spanveil.plans.carriers import corpus
from spanveil.plans.registry import query, table
from spanveil.plans.sql_text import q

c = F.col
CATS = "[" + ", ".join(f"'{x}'" for x in ALL_CATEGORIES) + "]"
DEFAULTS = "[" + ", ".join(f"'{x}'" for x in DEFAULT_CATEGORIES) + "]"


def joined(column):
    return F.array_join(column, ",")


# ---- rules ---------------------------------------------------------------------
# Patterns of the rule tables: safe ones and one of each kind of defect.
PATTERNS = [
    r"\bTKT-\d{6}\b", r"[A-Z]{2}\-\d{4}", r"\d{3}[A-Z]{2}", r"(a+)+b", r"a*", r"[z-a]\d", r"x{3,1}",
    r"\1abc", r"EMP#[0-9]{4,8}", r"\B?", r"cost\$5", r"a|b", r"[^\]x]{2}:\w+", "",
]
_PATTERN_SQL = "list_extract([" + ", ".join(q(p) for p in PATTERNS) + "], CAST(p_partkey % 14 AS INT) + 1)"
_RULES_SQL = f"""
SELECT p_partkey, CASE WHEN p_partkey % 23 = 0 THEN 'no-uuid' ELSE substr(md5(CAST(p_partkey AS VARCHAR)) || '----', 1, 36) END AS id,
  CASE WHEN p_partkey % 29 = 0 THEN '' ELSE p_name END AS name,
  CASE WHEN p_partkey % 31 = 0 THEN 'other' ELSE 'custom' END AS category, {_PATTERN_SQL} AS pattern,
  CASE WHEN p_partkey % 37 = 0 THEN 'gs' WHEN p_partkey % 2 = 0 THEN 'gi' ELSE '' END AS flags,
  CASE WHEN p_partkey % 41 = 0 THEN 1.5 ELSE 0.8 END AS confidence,
  CASE WHEN p_partkey % 43 = 0 THEN ['ok', ''] WHEN p_partkey % 3 = 0 THEN NULL ELSE [p_brand] END AS context_cues,
  CASE WHEN p_partkey % 47 = 0 THEN 0 WHEN p_partkey % 5 = 0 THEN 4 END AS min_length,
  CASE WHEN p_partkey % 10 = 5 THEN 3 WHEN p_partkey % 7 = 0 THEN 9 END AS max_length,
  CASE WHEN p_partkey % 53 = 0 THEN '' ELSE '2026-01-01T00:00:00Z' END AS created_at,
  CASE WHEN p_partkey % 59 = 0 THEN 'web' ELSE 'local' END AS source, CAST(p_partkey % 12 AS INT) AS capture_group,
  CASE WHEN p_partkey % 2 = 0 THEN 'accepted' ELSE 'odd' END AS contribution_status FROM part"""


def rule_table(spark, sf_dir):
    k = c("p_partkey")
    return table(spark, sf_dir, "part").select(
        k, F.when(k % 23 == 0, "no-uuid").otherwise(
            F.concat(F.md5(k.cast("string")), F.lit("----")).substr(1, 36)).alias("id"),
        F.when(k % 29 == 0, "").otherwise(c("p_name")).alias("name"),
        F.when(k % 31 == 0, "other").otherwise("custom").alias("category"),
        F.get(F.lit(PATTERNS), (k % 14).cast("int")).alias("pattern"),
        F.when(k % 37 == 0, "gs").when(k % 2 == 0, "gi").otherwise("").alias("flags"),
        F.when(k % 41 == 0, 1.5).otherwise(0.8).alias("confidence"),
        F.when(k % 43 == 0, F.array(F.lit("ok"), F.lit(""))).when(k % 3 == 0, None)
        .otherwise(F.array("p_brand")).alias("context_cues"),
        F.when(k % 47 == 0, 0).when(k % 5 == 0, 4).alias("min_length"),
        F.when(k % 10 == 5, 3).when(k % 7 == 0, 9).alias("max_length"),
        F.when(k % 53 == 0, "").otherwise("2026-01-01T00:00:00Z").alias("created_at"),
        F.when(k % 59 == 0, "web").otherwise("local").alias("source"),
        (k % 12).cast("int").alias("capture_group"),
        F.when(k % 2 == 0, "accepted").otherwise("odd").alias("contribution_status"),
    )


def _safe_sql(p="pattern", f="flags"):
    ranges = f"regexp_extract_all(regexp_replace(array_to_string(regexp_extract_all({p}, {q(rules._CLASS)}), ' '), {q(chr(92) * 2 + '.')}, '', 'g'), '(.)-(.)')"
    counts = f"regexp_extract_all({p}, '\\{{([0-9]+,[0-9]+)\\}}', 1)"
    return f"""coalesce(length({p}) BETWEEN 1 AND 512 AND regexp_full_match({p}, {q(rules.SAFE_GRAMMAR[1:-1])})
  AND regexp_full_match({f}, '[gim]*') AND NOT regexp_matches({p}, {q(rules.ADJACENT_QUANTIFIERS)})
  AND regexp_full_match({p}, '(?:[^\\\\]|\\\\[^1-9k])*')
  AND len(list_filter({ranges}, lambda x: ascii(x) > ascii(substr(x, 3, 1)))) = 0
  AND len(list_filter({counts}, lambda x: CAST(split_part(x, ',', 1) AS INT) > CAST(split_part(x, ',', 2) AS INT))) = 0
  AND NOT regexp_full_match({p}, {q(rules.MATCHES_EMPTY[1:-1])}), false)"""


_CUES_BAD = "len(list_filter(context_cues, lambda x: length(x) NOT BETWEEN 1 AND 40)) > 0"


@query("rule_validate", f"""
SELECT p_partkey, CASE WHEN NOT regexp_full_match(id, '[0-9a-f-]{{36}}') THEN 'id'
  WHEN length(name) NOT BETWEEN 1 AND 80 THEN 'name' WHEN NOT list_contains({CATS}, category) THEN 'category'
  WHEN length(pattern) NOT BETWEEN 1 AND 512 THEN 'pattern' WHEN NOT regexp_full_match(flags, '[gim]*') THEN 'flags'
  WHEN NOT {_safe_sql()} THEN 'unsafe' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence'
  WHEN context_cues IS NOT NULL AND {_CUES_BAD} THEN 'context_cues'
  WHEN min_length < 1 THEN 'min_length' WHEN max_length < 1 THEN 'max_length' WHEN min_length > max_length THEN 'length_order'
  WHEN created_at = '' THEN 'created_at' WHEN source NOT IN ('local', 'community') THEN 'source' END AS error,
  CAST(CASE WHEN capture_group BETWEEN 0 AND 9 THEN capture_group ELSE 0 END AS INT) AS capture_group,
  CASE WHEN contribution_status IN ('local_only','submitted','under_review','accepted','rejected') THEN contribution_status ELSE 'local_only' END AS contribution_status
FROM ({_RULES_SQL})""")
def rule_validate(spark, sf_dir):
    return rules.validate_rules(rule_table(spark, sf_dir)).select(
        "p_partkey", "error", "capture_group", "contribution_status"
    )


@query("rule_safe_regex", f"SELECT p_partkey, {_safe_sql()} AS safe FROM ({_RULES_SQL})")
def rule_safe_regex(spark, sf_dir):
    return rule_table(spark, sf_dir).select(
        "p_partkey", rules.safe_regex(c("pattern"), c("flags")).alias("safe")
    )


_COMMUNITY = f"""SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'bad id' ELSE 'r' || p_partkey END AS rule_id, name, category, pattern,
  flags, confidence, p_partkey * 700 AS total_votes, p_partkey AS upvotes, CASE WHEN p_partkey % 61 = 0 THEN -1 ELSE 3 END AS downvotes,
  'verified' AS verification_status, source AS created_by_handle,
  CASE WHEN p_partkey % 17 = 0 THEN 'yesterday' ELSE '2026-01-01T00:00:00Z' END AS created_at FROM ({_RULES_SQL})"""


@query("rule_community_validate", f"""
SELECT p_partkey, regexp_full_match(rule_id, '[A-Za-z0-9_-]{{1,64}}') AND length(name) BETWEEN 1 AND 120
  AND list_contains({CATS}, category) AND length(pattern) BETWEEN 1 AND 500 AND regexp_full_match(flags, '[gim]*')
  AND confidence BETWEEN 0 AND 1 AND total_votes BETWEEN 0 AND 1000000 AND downvotes >= 0
  AND TRY_CAST(created_at AS TIMESTAMPTZ) IS NOT NULL AND {_safe_sql()} AS valid FROM ({_COMMUNITY})""")
def rule_community_validate(spark, sf_dir):
    k = c("p_partkey")
    rows = rule_table(spark, sf_dir).withColumns({
        "rule_id": F.when(k % 13 == 0, "bad id").otherwise(F.concat(F.lit("r"), k)),
        "total_votes": k * 700, "upvotes": k, "downvotes": F.when(k % 61 == 0, -1).otherwise(3),
        "verification_status": F.lit("verified"), "created_by_handle": c("source"),
        "created_at": F.when(k % 17 == 0, "yesterday").otherwise("2026-01-01T00:00:00Z"),
    })
    return rows.select("p_partkey", rules.community_rule_valid(F.col).alias("valid"))


@query("rule_upsert", """
WITH a AS (SELECT 'o' || (p_partkey % 5) AS owner, p_partkey % 700 AS id, p_partkey AS pos, p_name AS name, 0 AS fresh FROM part WHERE p_partkey < 700
  UNION ALL SELECT 'o' || (p_partkey % 5), p_partkey % 900, p_partkey, p_name, 1 FROM part WHERE p_partkey >= 700),
kept AS (SELECT * FROM a WHERE id % 11 <> 0)
SELECT owner, id, pos, name FROM (
  SELECT owner, id, name, row_number() OVER (PARTITION BY owner ORDER BY f0, p0) AS pos FROM (
    SELECT owner, id, arg_max(name, fresh * 1000000 + pos) AS name, min(fresh) AS f0, arg_min(pos, fresh * 1000000 + pos) AS p0
    FROM kept GROUP BY owner, id))""")
def rule_upsert(spark, sf_dir):
    k = c("p_partkey")
    part = table(spark, sf_dir, "part")
    owner = F.concat(F.lit("o"), k % 5).alias("owner")

    def rows(df, mod):
        return df.select(owner, (k % mod).alias("id"), k.alias("pos"), c("p_name").alias("name"))

    existing, fresh = rows(part.filter("p_partkey < 700"), 700), rows(part.filter("p_partkey >= 700"), 900)
    gone = existing.unionByName(fresh).filter("id % 11 = 0").select("owner", "id").distinct()
    return rules.upsert(existing, fresh, gone)


_SCREEN = """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'for bob@real.com' ELSE p_name END AS name,
  CASE p_partkey % 6 WHEN 0 THEN '\\d{3}-\\d{4}' WHEN 1 THEN lpad(CAST(p_partkey * 482711 % 1000000000 AS VARCHAR), 9, '0')
    WHEN 2 THEN 'AB' || lpad(CAST(p_partkey * 7919 % 10000000 AS VARCHAR), 7, '0') ELSE 'x' END AS pattern,
  CASE WHEN p_partkey % 4 = 0 THEN ['id ', '２１９ ' || chr(8211) || '09 9999'] END AS context_cues FROM part"""
_FOLD = "regexp_replace(translate(t, '０１２３４５６７８９', '0123456789'), '[\\s\\x{2010}-\\x{2015}\\x{2212}\\x{2043}]+', '-', 'g')"
_REAL = " OR ".join(sql.valid(k, "d") for k in rules.DIGIT_KINDS + ["luhn"])


@query("rule_screen", f"""
WITH f AS (SELECT p_partkey, 0 AS o, 'name' AS field, name AS t FROM ({_SCREEN}) UNION ALL
  SELECT p_partkey, 1, 'pattern', pattern FROM ({_SCREEN}) UNION ALL
  SELECT p_partkey, 1 + i, 'contextCue', context_cues[i] FROM (SELECT *, unnest(range(1, len(context_cues) + 1)) AS i FROM ({_SCREEN}))),
s AS (SELECT *, {_FOLD} AS scan FROM f),
runs AS (SELECT p_partkey, o, regexp_replace(r, '[./-]', '', 'g') AS d FROM (
  SELECT p_partkey, o, unnest(regexp_extract_all(scan, '-?[0-9][0-9./-]{{4,24}}[0-9]|[0-9]{{6,19}}')) AS r FROM s)),
num AS (SELECT DISTINCT p_partkey, o FROM runs WHERE length(d) BETWEEN 6 AND 19 AND ({_REAL})),
deas AS (SELECT DISTINCT p_partkey, o FROM (SELECT p_partkey, o, unnest(regexp_extract_all(scan, '\\b[A-Za-z][A-Za-z0-9]{{8,10}}\\b')) AS v FROM s) WHERE {sql.valid('dea')}),
k AS (SELECT s.p_partkey, s.o, s.field, CASE WHEN regexp_matches(scan, '[\\p{{L}}\\p{{N}}._%+-]+@[\\p{{L}}\\p{{N}}.-]+\\.\\p{{L}}{{2,}}') THEN 'email address'
    WHEN deas.o IS NOT NULL THEN 'provider identifier' WHEN num.o IS NOT NULL THEN 'government or provider identifier' END AS kind
  FROM s LEFT JOIN deas ON deas.p_partkey = s.p_partkey AND deas.o = s.o LEFT JOIN num ON num.p_partkey = s.p_partkey AND num.o = s.o)
SELECT p_partkey, arg_min(field, o) FILTER (kind IS NOT NULL) AS blocked_field, arg_min(kind, o) FILTER (kind IS NOT NULL) AS blocked_kind,
  count(kind) = 0 AS safe FROM k GROUP BY p_partkey""")
def rule_screen(spark, sf_dir):
    k = c("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k, F.when(k % 9 == 0, "for bob@real.com").otherwise(c("p_name")).alias("name"),
        F.when(k % 6 == 0, r"\d{3}-\d{4}")
        .when(k % 6 == 1, F.lpad((k * 482711 % 1000000000).cast("string"), 9, "0"))
        .when(k % 6 == 2, F.concat(F.lit("AB"), F.lpad((k * 7919 % 10000000).cast("string"), 7, "0")))
        .otherwise("x").alias("pattern"),
        F.when(k % 4 == 0, F.array(F.lit("id "), F.lit("２１９ –09 9999"))).alias("context_cues"),
    )
    return rules.screen_rules(rows).select("p_partkey", "blocked_field", "blocked_kind", "safe")


@query("rule_payload", f"""
SELECT name, category, pattern, flags, CAST(capture_group AS INT) AS capture_group, CAST(confidence AS DOUBLE) AS confidence,
  array_to_string(context_cues, ',') AS context_cues, CAST(min_length AS INT) AS min_length, CAST(max_length AS INT) AS max_length FROM ({_RULES_SQL})""")
def rule_payload(spark, sf_dir):
    return rules.contribution_payload(rule_table(spark, sf_dir)).withColumn("context_cues", joined("context_cues"))


@query("rule_submission_check")
def rule_submission_check(spark, sf_dir):
    k = c("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("submission_id"), F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name")).alias("rule_name"),
        F.when(k % 7 == 0, "([a").when(k % 13 == 0, None).otherwise(c("p_brand")).alias("pattern"),
        F.when(k % 17 == 0, "").otherwise(" custom ").alias("category"),
        F.array(F.lit(" a "), F.lit("  "), c("p_type")).alias("cues"),
    )
    return rules.submission_check(rows).withColumn("cues", joined("cues"))


@query("rule_infer")
def rule_infer(spark, sf_dir):
    # Brand codes and derived ids of each part type are the examples of one rule.
    k = c("p_partkey")
    example = (
        F.when(k % 25 % 2 == 0, F.concat(F.lit("TKT-"), F.lpad(k.cast("string"), 5, "0"), F.lit("-"), (k % 90).cast("string")))
        .otherwise(c("p_brand"))
    )
    rows = table(spark, sf_dir, "part").select(
        (k % 25).alias("rule_id"), k.alias("ord"), example.alias("example"), (k % 10 != 9).alias("is_positive")
    )
    return rules.infer_rules(rows).withColumn("limitations", joined("limitations"))


@query("rule_test", """
SELECT d.doc_id, n_nationkey AS rule_id,
  CAST(len(regexp_extract_all(text, '(?i)\\b' || chr(97 + n_nationkey) || '[a-z]{' || (4 + n_nationkey % 3) || '}\\b')) AS BIGINT) AS match_count
FROM documents d, nation""")
def rule_test(spark, sf_dir):
    listed = rules.collect_rule_list(nation_rules(spark, sf_dir).withColumnRenamed("id", "rule_id"))
    return rules.count_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), listed, hits_only=False)


# Candidate rules: one letter pattern per nation; labels make the corpora.
_GATE_P = "'(?:' || chr(97 + n_nationkey) || '[a-z]*|' || CASE WHEN n_nationkey % 5 = 0 THEN 'e' ELSE 'qqq' || n_nationkey END || ')'"


@query("rule_gate", f"""
WITH corpus AS MATERIALIZED (SELECT CASE WHEN quality = 1 THEN 'positive' ELSE 'negative' END AS kind, text FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT 'benign', text FROM benchmark),
r AS (SELECT n_nationkey, {_GATE_P} || CASE WHEN n_nationkey % 7 = 3 THEN '\\1' ELSE '' END AS pattern, {_GATE_P} AS runnable,
  n_nationkey % 7 = 3 AS backref, CASE WHEN n_nationkey % 2 = 0 THEN 'secrets' ELSE 'custom' END AS category,
  20 + n_nationkey AS distinct_examples, n_nationkey % 6 = 5 AS reported FROM nation),
f AS (SELECT n_nationkey, count_if(kind = 'positive') AS n_pos, count_if(kind = 'positive' AND h) AS hit_pos,
    count_if(kind = 'negative' AND h) AS hit_neg, count_if(kind = 'benign') AS n_ben, count_if(kind = 'benign' AND h) AS hit_ben
  FROM (SELECT n_nationkey, kind, CASE WHEN backref THEN false ELSE regexp_matches(text, runnable) END AS h FROM corpus, r) GROUP BY n_nationkey)
SELECT n_nationkey AS rule_id, CAST(n_pos AS BIGINT) AS n_pos, CAST(hit_pos AS BIGINT) AS hit_pos, CAST(hit_neg AS BIGINT) AS hit_neg,
  CAST(n_ben AS BIGINT) AS n_ben, CAST(hit_ben AS BIGINT) AS hit_ben,
  concat_ws(',', CASE WHEN backref THEN 'prohibited construct: backreference' END, CASE WHEN n_pos = 0 THEN 'no positives' END,
    CASE WHEN n_pos = 0 OR hit_pos / n_pos < 0.98 THEN 'precision' END, CASE WHEN hit_neg > 0 THEN 'matches negatives' END,
    CASE WHEN n_ben = 0 THEN 'no benign corpus' END,
    CASE WHEN n_ben > 0 AND hit_ben / n_ben > (CASE category WHEN 'secrets' THEN 0.1 ELSE 1 END) / 20000 THEN 'benign rate' END,
    CASE WHEN distinct_examples < 25 THEN 'distinct examples' END, CASE WHEN reported THEN 'reported' END) AS failures
FROM r JOIN f USING (n_nationkey)""")
def rule_gate(spark, sf_dir):
    k = c("n_nationkey")
    pattern = F.concat(
        F.lit("(?:"), F.char(k + 97), F.lit("[a-z]*|"),
        F.when(k % 5 == 0, "e").otherwise(F.concat(F.lit("qqq"), k)), F.lit(")"),
        # The added group reference never matches; it must be refused.
        F.when(k % 7 == 3, "\\1").otherwise(""),
    )
    candidates = table(spark, sf_dir, "nation").select(
        k.alias("rule_id"), pattern.alias("pattern"), F.lit("").alias("flags"),
        F.when(k % 2 == 0, "secrets").otherwise("custom").alias("category"), F.lit(0.8).alias("confidence"),
        (k + 20).alias("distinct_examples"), (k % 6 == 5).alias("reported"),
    )
    labelled = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.when(c("quality") == 1, "positive").otherwise("negative").alias("kind"), "text"
    )
    corpus = labelled.unionByName(
        table(spark, sf_dir, "benchmark").select(F.lit("benign").alias("kind"), "text")
    )
    return rules.gate_rules(corpus, candidates).drop("accepted").withColumn("failures", joined("failures"))


# ---- packs ----------------------------------------------------------------------
NOW = "TIMESTAMP '2026-01-15 00:00:00'"
_RULE_JSON = """'{"ruleId":"r' || o_orderkey || '","name":"n","category":"' || CASE WHEN o_orderkey % 13 = 0 THEN 'nope' ELSE 'custom' END || '","pattern":"TKT-[0-9]{6}","flags":"g","confidence":0.95,"totalVotes":1,"upvotes":1,"downvotes":0,"verificationStatus":"ok","createdByHandle":"h","createdAt":"2026-01-01T00:00:00Z"}'"""
_PACK_JSON = f"""(CASE WHEN o_orderkey % 19 = 0 THEN 'not json' ELSE '{{"packId":"' || CASE WHEN o_orderkey % 17 = 0 THEN 'bad id' ELSE 'p' || (o_orderkey % 40) END
 || '","issuedAt":"' || CASE WHEN o_orderkey % 11 = 0 THEN '2027-03-01' ELSE '2026-01-01' END || 'T00:00:00Z","expiresAt":"'
 || CASE WHEN o_orderkey % 7 = 0 THEN '2026-01-02' WHEN o_orderkey % 23 = 0 THEN 'soon' ELSE '2026-06-01' END || '","seq":' || CASE WHEN o_orderkey % 29 = 0 THEN '1.5' ELSE CAST(o_orderkey % 100 AS STRING) END
 || ',"minClientVersion":"' || CASE o_orderkey % 5 WHEN 0 THEN 'v1.2' WHEN 1 THEN '1.10.0' WHEN 2 THEN '0.9' WHEN 3 THEN '1.2.0' ELSE '1.2.x' END || '","rules":['
 || {_RULE_JSON} || ',' || {_RULE_JSON} || ']}}' END)"""
_DATE_BAD = "o_orderkey % 23 = 0 AND o_orderkey % 7 <> 0"
_PARSE_REASON = f"""CASE WHEN o_orderkey % 19 = 0 OR o_orderkey % 17 = 0 OR ({_DATE_BAD}) OR o_orderkey % 29 = 0 OR o_orderkey % 5 = 4 THEN 'malformed'
  WHEN o_orderkey % 13 = 0 THEN 'invalid-rules' END"""


def parsed_packs(spark, sf_dir):
    return packs.parse_packs(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_PACK_JSON).alias("body")))


@query("pack_parse", f"""
SELECT o_orderkey, reason, CASE WHEN reason = 'invalid-rules' THEN 'rule at index 0' END AS detail
FROM (SELECT o_orderkey, {_PARSE_REASON} AS reason FROM (SELECT o_orderkey, {_PACK_JSON} AS body FROM orders))""")
def pack_parse(spark, sf_dir):
    return parsed_packs(spark, sf_dir).select("o_orderkey", "reason", "detail")


@query("pack_admit", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN 'not-configured' WHEN reason IS NOT NULL THEN reason
  WHEN o_orderkey % 7 = 0 THEN 'expired' WHEN o_orderkey % 11 = 0 THEN 'not-yet-valid' WHEN o_orderkey % 5 = 1 THEN 'client-too-old'
  WHEN o_orderkey % 37 = 0 THEN 'bad-signature' WHEN o_orderkey % 100 <= best THEN 'stale-sequence' ELSE 'ok' END AS verdict
FROM (SELECT o_orderkey, {_PARSE_REASON} AS reason FROM orders)
LEFT JOIN (SELECT o_custkey % 30 AS p, max(o_orderkey % 60) AS best FROM orders GROUP BY 1) b ON b.p = o_orderkey % 40""")
def pack_admit(spark, sf_dir):
    k = c("o_orderkey")
    rows = parsed_packs(spark, sf_dir).withColumns({"has_key": k % 31 != 0, "signature_ok": k % 37 != 0})
    accepted = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("p"), c("o_custkey") % 30).alias("pack_id"), (k % 60).alias("seq")
    )
    return packs.admit_packs(rows, accepted, F.expr(NOW), F.lit("1.2.0")).select("o_orderkey", "verdict")


_VERSIONS = """SELECT o_orderkey, (o_orderkey % 3) || '.' || (o_orderkey % 7) || CASE WHEN o_orderkey % 2 = 0 THEN '.0' ELSE '' END AS a,
  CASE WHEN o_orderkey % 10 = 9 THEN '1.x' ELSE 'v' || (o_orderkey % 2) || '.' || (o_orderkey % 5) || '.' || (o_orderkey % 4) END AS b FROM orders"""


@query("pack_version_compare", f"""
SELECT o_orderkey, CASE WHEN b = '1.x' THEN NULL ELSE CASE WHEN a1 <> b1 THEN a1 - b1 WHEN a2 <> b2 THEN a2 - b2 ELSE a3 - b3 END END AS cmp
FROM (SELECT *, o_orderkey % 3 AS a1, o_orderkey % 7 AS a2, 0 AS a3, o_orderkey % 2 AS b1, o_orderkey % 5 AS b2, o_orderkey % 4 AS b3 FROM ({_VERSIONS}))""")
def pack_version_compare(spark, sf_dir):
    k = c("o_orderkey")
    a = F.concat(k % 3, F.lit("."), k % 7, F.when(k % 2 == 0, ".0").otherwise(""))
    b = F.when(k % 10 == 9, "1.x").otherwise(F.concat(F.lit("v"), k % 2, F.lit("."), k % 5, F.lit("."), k % 4))
    return table(spark, sf_dir, "orders").select(k, packs.compare_versions(a, b).alias("cmp"))


@query("pack_accept", """
SELECT 'p' || (o_custkey % 40) AS pack_id, max(o_orderkey % 500) AS seq, arg_max(o_orderpriority, lpad(CAST(o_orderkey % 500 AS VARCHAR), 9, '0') || o_orderpriority) AS expires_at
FROM orders GROUP BY 1""")
def pack_accept(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("p"), c("o_custkey") % 40).alias("pack_id"), (c("o_orderkey") % 500).alias("seq"),
        c("o_orderpriority").alias("expires_at"), "o_orderkey",
    )
    return packs.accept_packs(rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 2 = 1"))


@query("pack_confidence_clamp", "SELECT n_nationkey AS id, CAST(least(0.8 + n_nationkey / 100.0, 0.9) AS DOUBLE) AS confidence, 'community' AS source FROM nation")
def pack_confidence_clamp(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("id"), (0.8 + c("n_nationkey") / 100).alias("confidence"))
    return packs.clamp_confidence(rows)


# ---- policies and settings ---------------------------------------------------------
_PRESET_ROWS = ", ".join(f"('{p}', '{x}')" for p, cats in PRESETS.items() for x in cats)
PRESET_NAMES = [*PRESETS, "custom"]


@query("preset_expand", f"""
SELECT c_custkey AS user_id, p.preset, category FROM (SELECT c_custkey, list_extract({PRESET_NAMES}, CAST(c_custkey % 10 AS INT) + 1) AS preset FROM customer) u
JOIN (VALUES {_PRESET_ROWS}) p(preset, category) ON u.preset = p.preset""")
def preset_expand(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("user_id"), F.get(F.lit(PRESET_NAMES), (c("c_custkey") % 10).cast("int")).alias("preset")
    )
    return policy.expand_presets(users)


def raw_settings(spark, sf_dir):
    k = c("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("user_id"), (k % 6).alias("tenant_id"),
        F.when(k % 7 == 0, None).when(k % 5 == 0, F.array(F.lit("ssn"), F.lit("bogus"), F.lit("email")))
        .otherwise(F.lit(["phone", "email"])).alias("enabled_categories"),
        F.when(k % 3 == 0, F.create_map(F.lit("ssn"), F.lit(0.9), F.lit("email"), F.lit(1.5), F.lit("zzz"), F.lit(0.1))).alias("thresholds"),
        F.when(k % 4 == 0, "always-on").when(k % 4 == 1, "loud").when(k % 4 == 2, "off").alias("protection_mode"),
        F.when(k % 8 == 3, False).alias("paste_guard_enabled"), (k % 200).alias("max_visible_chars"),
        (k % 20).alias("max_node_chars"), F.when(k % 2 == 0, -1.0).otherwise(6.0).alias("mask_padding"),
        F.when(k % 2 == 0, "15m").otherwise("2h").alias("session_timeout"),
        F.when(k % 9 == 0, "").otherwise(c("c_name")).alias("account_label"),
        F.when(k % 5 == 1, "   ").otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("stamp_text"),
    )


_MODE = """CASE WHEN c_custkey % 4 = 0 THEN 'always-on' WHEN c_custkey % 4 = 2 THEN 'off' WHEN c_custkey % 8 = 3 THEN 'off' ELSE 'this-tab' END"""
_ENABLED = f"""CASE WHEN c_custkey % 7 = 0 THEN {DEFAULTS} WHEN c_custkey % 5 = 0 THEN ['ssn', 'email'] ELSE ['phone', 'email'] END"""


@query("settings_normalize", f"""
SELECT c_custkey AS user_id, array_to_string({_ENABLED}, ',') AS enabled_categories,
  CASE WHEN c_custkey % 3 = 0 THEN 'ssn=0.9' ELSE '' END AS thresholds, {_MODE} AS protection_mode, {_MODE} <> 'off' AS paste_guard_enabled,
  CASE WHEN c_custkey % 200 >= 100 THEN c_custkey % 200 ELSE 250000 END AS max_visible_chars,
  CASE WHEN c_custkey % 20 >= 10 THEN c_custkey % 20 ELSE 10000 END AS max_node_chars,
  CAST(CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 6 END AS DOUBLE) AS mask_padding,
  CASE WHEN c_custkey % 2 = 0 THEN '15m' ELSE 'never' END AS session_timeout,
  CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS account_label,
  CASE WHEN c_custkey % 5 = 1 THEN '[REDACTED]' ELSE c_mktsegment END AS stamp_text FROM customer""")
def settings_normalize(spark, sf_dir):
    rows = policy.normalize_settings(raw_settings(spark, sf_dir))
    shown = F.transform(F.map_entries("thresholds"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.withColumns({"enabled_categories": joined("enabled_categories"), "thresholds": joined(shown)})


# Tenant policies by nation: sound, empty, absent and broken ones.
POLICIES = [
    '{"protectionMode":"always-on","userCanDisable":false,"enforcedCategories":["ssn","email","ssn"]}',
    "{}", None, '{"protectionMode":"loud"}', '{"protectionMode":"off","userCanDisable":false,"enforcedCategories":["npi"]}',
    '{"userCanDisable":"yes"}', '{"userCanDisable":true,"enforcedCategories":["secrets"]}', '{"enforcedCategories":["bogus"]}',
    "[1]", '{"protectionMode":"this-tab","enforcedCategories":[]}', "nonsense", '{"protectionMode":7}',
]
_POLICY_SQL = "list_extract([" + ", ".join("NULL" if p is None else q(p) for p in POLICIES) + f"], CAST(n_nationkey % {len(POLICIES)} AS INT) + 1)"
_POLICY = f"""SELECT n_nationkey AS tenant_id, raw IS NOT NULL AS managed, raw IS NULL OR ok AS valid,
  CASE WHEN raw IS NULL THEN 'this-tab' WHEN ok THEN coalesce(j->>'protectionMode', 'this-tab') ELSE 'always-on' END AS protection_mode,
  CASE WHEN raw IS NULL THEN true WHEN ok THEN coalesce(CAST(j->>'userCanDisable' AS BOOLEAN), false) ELSE false END AS user_can_disable,
  CASE WHEN raw IS NULL THEN [] WHEN ok THEN coalesce(cats, []) ELSE {CATS} END AS enforced
FROM (SELECT *, coalesce(json_type(j) = 'OBJECT'
    AND (json_type(j, '$.protectionMode') IS NULL OR (json_type(j, '$.protectionMode') = 'VARCHAR' AND j->>'protectionMode' IN ('off', 'this-tab', 'always-on')))
    AND (json_type(j, '$.userCanDisable') IS NULL OR json_type(j, '$.userCanDisable') = 'BOOLEAN')
    AND (cats IS NULL OR list_has_all({CATS}, cats)), false) AS ok
  FROM (SELECT *, CASE WHEN n_nationkey % 12 = 0 THEN ['ssn', 'email'] ELSE TRY_CAST(j->'enforcedCategories' AS VARCHAR[]) END AS cats
   FROM (SELECT n_nationkey, raw, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM (SELECT n_nationkey, {_POLICY_SQL} AS raw FROM nation))))"""


def tenant_policies(spark, sf_dir):
    raw = table(spark, sf_dir, "nation").select(
        c("n_nationkey").alias("tenant_id"),
        F.get(F.array(*[F.lit(p).cast("string") for p in POLICIES]), (c("n_nationkey") % len(POLICIES)).cast("int")).alias("raw"),
    )
    return policy.parse_policies(raw)


@query("policy_parse", f"SELECT * REPLACE (array_to_string(enforced, ',') AS enforced) FROM ({_POLICY})")
def policy_parse(spark, sf_dir):
    return tenant_policies(spark, sf_dir).withColumn("enforced", joined("enforced"))


_USERS = f"SELECT c_custkey AS user_id, CAST(c_nationkey AS INT) AS tenant_id, {_MODE} AS protection_mode, {_ENABLED} AS enabled_categories FROM customer"
_EFFECTIVE = f"""SELECT user_id, u.tenant_id, CASE WHEN off THEN 'off' WHEN locked THEN
    CASE WHEN list_position(['off','this-tab','always-on'], u.protection_mode) >= list_position(['off','this-tab','always-on'], p.protection_mode)
      THEN u.protection_mode ELSE p.protection_mode END ELSE u.protection_mode END AS mode, locked, managed,
  CASE WHEN off THEN list_sort(enforced) ELSE list_sort(list_distinct(list_concat(enabled_categories, enforced))) END AS enabled_categories,
  CASE WHEN managed THEN list_sort(enforced) ELSE [] END AS locked_categories
FROM ({_USERS}) u JOIN (SELECT *, managed AND NOT user_can_disable AS locked, managed AND NOT user_can_disable AND protection_mode = 'off' AS off FROM ({_POLICY})) p
ON u.tenant_id = p.tenant_id"""


def effective(spark, sf_dir):
    users = policy.normalize_settings(raw_settings(spark, sf_dir)).join(
        table(spark, sf_dir, "customer").select(c("c_custkey").alias("user_id"), c("c_nationkey").alias("tenant_id")), "user_id"
    )
    return policy.effective_protection(users, tenant_policies(spark, sf_dir))


@query("policy_effective", f"""SELECT * REPLACE (array_to_string(enabled_categories, ',') AS enabled_categories,
  array_to_string(locked_categories, ',') AS locked_categories) FROM ({_EFFECTIVE})""")
def policy_effective(spark, sf_dir):
    return effective(spark, sf_dir).withColumns({
        "enabled_categories": joined(F.array_sort("enabled_categories")),
        "locked_categories": joined(F.array_sort("locked_categories")),
    })


# Texts are dealt to all customers in turn; spans are filtered before they compete.
_FLOORED = f"""SELECT r.* FROM ({sql.raw_all(MIXED)}) r
JOIN eff e ON e.user_id = 1 + r.id % (SELECT count(*) FROM customer) WHERE list_contains(e.enabled_categories, category)"""


@query("policy_scan_floor", f"""WITH {CORPUS}, eff AS MATERIALIZED ({_EFFECTIVE})
SELECT src, id, category, start_pos, value FROM ({sql.resolved(_FLOORED)})""")
def policy_scan_floor(spark, sf_dir):
    enabled = effective(spark, sf_dir).select("user_id", "enabled_categories")
    users = table(spark, sf_dir, "customer").count()
    texts = corpus(spark, sf_dir, "mixed").withColumn("user_id", 1 + c("id") % users)
    floored = texts.join(enabled, "user_id").withColumn("spans", policy.scan_floor(c("text"), c("enabled_categories")))
    return all_rows(floored).select("src", "id", "category", "start_pos", "value")


def packages(spark, sf_dir):
    """One policy package per supplier, rules from its key; some tampered or expired."""
    k = c("s_suppkey")
    rule = lambda i: F.struct(
        F.concat(F.lit("r"), (k * i) % 7).alias("id"), F.lit("custom").alias("category"), c("s_name").alias("pattern"),
        F.when(k % 3 == 0, F.array(F.lit("z"), F.lit("a"))).alias("cues"), F.lit(0.5).alias("confidence"), F.lit("d").alias("description"),
    )
    rows = table(spark, sf_dir, "supplier").select(
        (k % 20).alias("tenant_id"), k.alias("cached_at"), F.concat(F.lit("pol"), k).alias("policy_id"),
        F.when(k % 13 == 0, "").otherwise("1").alias("policy_version"),
        F.when(k % 5 == 0, "2025-12-01T00:00:00Z").otherwise("2026-12-01T00:00:00Z").alias("expires_at"),
        F.array(rule(2), rule(3), rule(5)).alias("rules"),
    )
    digest = policy.policy_hash(c("rules"))
    return rows.withColumn(
        "policy_hash", F.when(k_mod(rows, 7), F.sha2(F.lit("other"), 256)).otherwise(F.upper(digest))
    )


def k_mod(rows, n):
    return rows["cached_at"] % n == 0


_PKG = """SELECT s_suppkey % 20 AS tenant_id, s_suppkey AS k, 'pol' || s_suppkey AS policy_id,
  CASE WHEN s_suppkey % 13 = 0 THEN 'malformed' WHEN s_suppkey % 5 = 0 THEN 'expired' WHEN s_suppkey % 7 = 0 THEN 'tampered' END AS problem FROM supplier"""


def _canonical_sql():
    def rule(i):
        cues = "CASE WHEN k % 3 = 0 THEN '\"cues\":[\"a\",\"z\"],' ELSE '' END"
        return (f"{{'o': 'r' || (k * {i}) % 7, 'j': '{{\"category\":\"custom\",\"confidence\":0.5,' || {cues} || "
                f"'\"description\":\"d\",\"id\":\"r' || (k * {i}) % 7 || '\",\"pattern\":\"' || s_name || '\"}}'}}")
    return f"""SELECT policy_id, canonical, sha256(canonical) AS digest FROM (SELECT 'pol' || k AS policy_id,
  '[' || array_to_string(list_transform(list_sort([{rule(2)}, {rule(3)}, {rule(5)}]), lambda x: x.j), ',') || ']' AS canonical
  FROM (SELECT s_suppkey AS k, s_name FROM supplier))"""


@query("policy_canonical_hash", _canonical_sql())
def policy_canonical_hash(spark, sf_dir):
    rows = packages(spark, sf_dir)
    return rows.select("policy_id", policy.canonical_rules(c("rules")).alias("canonical"), policy.policy_hash(c("rules")).alias("digest"))


@query("policy_verify", f"SELECT policy_id, problem FROM ({_PKG})")
def policy_verify(spark, sf_dir):
    return policy.verify_policies(packages(spark, sf_dir), F.expr(NOW)).select("policy_id", "problem")


@query("policy_active", f"""
SELECT tenant_id, policy_id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY k DESC) AS n FROM ({_PKG}))
WHERE n = 1 AND problem IS NULL""")
def policy_active(spark, sf_dir):
    return policy.active_policies(packages(spark, sf_dir), F.expr(NOW)).select("tenant_id", "policy_id")


# ---- audit and reports ---------------------------------------------------------------
_COUNTS = f"SELECT src, id, category, count(*) AS n FROM ({RESOLVED}) GROUP BY ALL"


def counts(spark, sf_dir):
    return audit.count_by_category(all_rows(mixed_scan(spark, sf_dir)), KEYS)


@query("count_by_category", SCAN + _COUNTS)
def count_by_category(spark, sf_dir):
    return counts(spark, sf_dir)


@query("top_categories_notice", SCAN + f"""
SELECT src, id, sum(n) || CASE WHEN sum(n) = 1 THEN ' value' ELSE ' values' END || ' detected on this page: '
  || string_agg(n || ' ' || replace(category, '_', ' '), ', ' ORDER BY n DESC, category) FILTER (k <= 3) || '.' AS notice
FROM (SELECT *, row_number() OVER (PARTITION BY src, id ORDER BY n DESC, category) AS k FROM ({_COUNTS})) GROUP BY src, id""")
def top_categories_notice(spark, sf_dir):
    return audit.top_categories_notice(counts(spark, sf_dir), KEYS)


@query("unique_categories", SCAN + f"SELECT src, id, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM ({RESOLVED}) GROUP BY src, id")
def unique_categories(spark, sf_dir):
    return audit.unique_categories(all_rows(mixed_scan(spark, sf_dir)), KEYS).withColumn("categories", joined("categories"))


@query("scan_stats", SCAN + f"""
SELECT src, id, visible_chars, attr_chars, false AS truncated, deferred, findings,
  CASE WHEN failed THEN 'SCAN_FAILED' WHEN blocked > 0 THEN 'BLOCKED_BY_BROWSER_SECURITY' WHEN deferred > 0 THEN 'PARTIALLY_SCANNED'
    WHEN findings = 0 THEN 'NO_SENSITIVE_DATA_DETECTED' ELSE 'FULLY_SCANNED' END AS coverage_status FROM (
  SELECT c.src, c.id, length(text) AS visible_chars, CASE WHEN c.id % 3 = 0 THEN length(regexp_extract(text, '^[^\n]*')) ELSE 0 END AS attr_chars,
    CASE WHEN c.id % 5 = 0 THEN c.id % 4 ELSE 0 END AS deferred, coalesce(n, 0) AS findings, CASE WHEN c.id % 11 = 0 THEN 1 ELSE 0 END AS blocked,
    c.id % 97 = 0 AS failed
  FROM ({MIXED}) c LEFT JOIN (SELECT src, id, count(*) AS n FROM ({RESOLVED}) GROUP BY src, id) f ON c.src = f.src AND c.id = f.id)""")
def scan_stats(spark, sf_dir):
    k = c("id")
    return sc.scan_stats(
        mixed_scan(spark, sf_dir), KEYS,
        attr_chars=F.when(k % 3 == 0, F.length(F.regexp_extract("text", "^[^\n]*", 0))),
        deferred=F.when(k % 5 == 0, k % 4), blocked=F.when(k % 11 == 0, 1), failed=k % 97 == 0,
    )


_URLS = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://User:pw@EX.org:443/a' WHEN 2 THEN 'http://ex.org:8080?x' WHEN 3 THEN 'not a url'
  WHEN 4 THEN 'http://ex.org:80' ELSE url END AS u, url FROM pages"""
_HOST = """CASE page_id % 6 WHEN 1 THEN 'ex.org' WHEN 2 THEN 'ex.org:8080' WHEN 3 THEN NULL WHEN 4 THEN 'ex.org' ELSE regexp_extract(url, '://([^/?#]+)', 1) END"""


@query("host_extract", f"SELECT page_id, {_HOST} AS host FROM ({_URLS})")
def host_extract(spark, sf_dir):
    k = c("page_id")
    url = (F.when(k % 6 == 1, "https://User:pw@EX.org:443/a").when(k % 6 == 2, "http://ex.org:8080?x")
           .when(k % 6 == 3, "not a url").when(k % 6 == 4, "http://ex.org:80").otherwise(c("url")))
    return table(spark, sf_dir, "pages").select(k, audit.host_of(url).alias("host"))


@query("audit_build", SCAN + f"""
SELECT c.src, c.id, '2026-01-15T00:00:00Z' AS ts, 'page_scan_completed' AS action, 'host' || (c.id % 9) || '.example' AS host,
  coalesce(counts, '{{}}') AS counts, 'ok' AS outcome FROM ({MIXED}) c LEFT JOIN (
  SELECT src, id, '{{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}}' AS counts FROM ({_COUNTS}) GROUP BY src, id) m
ON c.src = m.src AND c.id = m.id""")
def audit_build(spark, sf_dir):
    scanned = mixed_scan(spark, sf_dir)
    scans = scanned.select(*KEYS, F.lit("2026-01-15T00:00:00Z").alias("ts"), F.concat(F.lit("host"), c("id") % 9, F.lit(".example")).alias("host"))
    found = audit.count_by_category(all_rows(scanned), KEYS)
    return audit.scan_events(found, scans, KEYS).withColumn("counts", F.to_json("counts"))


_EVENTS = f"""SELECT o_orderkey AS event_id, o_custkey % 5 AS tenant, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ts,
  CASE WHEN o_orderkey % 31 = 0 THEN 'other' ELSE list_extract({audit.ACTIONS}, CAST(o_orderkey % 10 AS INT) + 1) END AS action,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN '' ELSE 'h' || (o_orderkey % 50) || '.example' END AS host,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 41 = 0 THEN -1 ELSE o_orderkey % 9 END END AS n,
  CASE WHEN o_orderkey % 5 = 0 THEN md5(CAST(o_orderkey AS VARCHAR)) || CASE WHEN o_orderkey % 7 = 0 THEN 'zz' ELSE md5('x') END END AS doc_hash,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 21 - 1 END AS pages, CASE WHEN o_orderkey % 6 = 0 THEN repeat('p', CAST(o_orderkey % 35 AS INT)) END AS preset_id,
  CASE WHEN o_orderkey % 10 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'http://a' ELSE 'https://a' END END AS gateway_origin,
  CASE WHEN o_orderkey % 8 = 0 THEN ['ssn', 'email'] END AS enabled_categories,
  CASE WHEN o_orderkey % 43 = 0 THEN 'maybe' ELSE 'ok' END AS outcome FROM orders"""


def events(spark, sf_dir):
    k = c("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("event_id"), (c("o_custkey") % 5).alias("tenant"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.when(k % 31 == 0, "other").otherwise(F.get(F.lit(audit.ACTIONS), (k % 10).cast("int"))).alias("action"),
        F.when(k % 3 == 0, None).when(k % 37 == 0, "").otherwise(F.concat(F.lit("h"), k % 50, F.lit(".example"))).alias("host"),
        F.when(k % 2 == 0, F.create_map(F.lit("ssn"), F.when(k % 41 == 0, -1).otherwise(k % 9))).alias("counts"),
        F.when(k % 5 == 0, F.concat(F.md5(k.cast("string")), F.when(k % 7 == 0, "zz").otherwise(F.md5(F.lit("x"))))).alias("doc_hash"),
        F.when(k % 4 == 0, k % 21 - 1).alias("pages"), F.when(k % 6 == 0, F.repeat(F.lit("p"), (k % 35).cast("int"))).alias("preset_id"),
        F.when(k % 10 == 0, F.when(k % 3 == 0, "http://a").otherwise("https://a")).alias("gateway_origin"),
        F.when(k % 8 == 0, F.lit(["ssn", "email"])).alias("enabled_categories"),
        F.when(k % 43 == 0, "maybe").otherwise("ok").alias("outcome"),
    )


@query("audit_validate", f"""
SELECT event_id, CASE WHEN action = 'other' THEN 'action' WHEN outcome = 'maybe' THEN 'outcome' WHEN host = '' THEN 'host' WHEN n < 0 THEN 'counts'
  WHEN NOT regexp_full_match(doc_hash, '[a-f0-9]{{64}}') THEN 'doc_hash' WHEN pages < 0 THEN 'pages'
  WHEN preset_id = '' OR length(preset_id) > 32 THEN 'preset_id' WHEN gateway_origin NOT LIKE 'https://%' THEN 'gateway_origin' END AS violation
FROM ({_EVENTS})""")
def audit_validate(spark, sf_dir):
    return audit.validate_events(events(spark, sf_dir)).select("event_id", "violation")


def _pair(key, value, quoted=True):
    shown = f"'\"' || {value} || '\"'" if quoted else value
    return f"CASE WHEN {value} IS NOT NULL THEN '\"{key}\":' || {shown} END"


_LINE = "'{' || concat_ws(',', " + ", ".join([
    _pair("ts", "ts"), _pair("action", "action"), _pair("host", "host"),
    "CASE WHEN n IS NOT NULL THEN '\"counts\":{\"ssn\":' || n || '}' END", _pair("docHash", "doc_hash"),
    _pair("pages", "pages", False), _pair("presetId", "preset_id"), _pair("gatewayOrigin", "gateway_origin"),
    "CASE WHEN enabled_categories IS NOT NULL THEN '\"enabledCategories\":[\"ssn\",\"email\"]' END", _pair("outcome", "outcome"),
]) + ") || '}'"


@query("audit_canonical", f"SELECT event_id, {_LINE} AS line FROM ({_EVENTS})")
def audit_canonical(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", audit.canonical_line().alias("line"))


_RING = f"SELECT * FROM ({_EVENTS}) QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY ts DESC, event_id DESC) <= 500"


@query("audit_ring", f"SELECT tenant, event_id, ts FROM ({_RING})")
def audit_ring(spark, sf_dir):
    return audit.audit_ring(events(spark, sf_dir), ["tenant"]).select("tenant", "event_id", "ts")


_MANIFEST = f"""SELECT tenant, count(*) AS event_count, '2026-01-15T00:00:00Z' AS exported_at,
  sha256(string_agg({_LINE}, chr(10) ORDER BY ts, event_id)) AS digest FROM ({_RING}) GROUP BY tenant"""


def manifest(spark, sf_dir, ring):
    return audit.audit_manifest(ring, ["tenant"], F.lit("2026-01-15T00:00:00Z"))


@query("audit_manifest", _MANIFEST)
def audit_manifest(spark, sf_dir):
    return manifest(spark, sf_dir, audit.audit_ring(events(spark, sf_dir), ["tenant"]))


@query("audit_verify", f"""SELECT tenant, tenant <> 3 AS intact FROM ({_MANIFEST})""")
def audit_verify(spark, sf_dir):
    ring = audit.audit_ring(events(spark, sf_dir), ["tenant"])
    edited = ring.withColumn("outcome", F.when(c("tenant") == 3, "denied").otherwise(c("outcome")))
    return audit.audit_verify(manifest(spark, sf_dir, ring), edited, ["tenant"])


_SAFE = """SELECT event_id, ts AS timestamp, 'inst' AS installation_id, user_id % 5 AS tenant_id, user_id, event_type, 'pol' AS policy_id,
  '1' AS policy_version, 'ok' AS operation_result, event_id AS request_id, '1.0' AS extension_version FROM events"""


@query("event_safe_projection", f"SELECT * REPLACE (strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp) FROM ({_SAFE})")
def event_safe_projection(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumns({
        "timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "installation_id": F.lit("inst"), "tenant_id": c("user_id") % 5,
        "policy_id": F.lit("pol"), "policy_version": F.lit("1"), "operation_result": F.lit("ok"),
        "request_id": c("event_id"), "extension_version": F.lit("1.0"),
    })
    return audit.safe_projection(rows)


@query("delivery_settle", """
SELECT o_orderkey AS request_id, 'doc_redacted' AS action, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 120 <= 60 AND o_orderkey % 7 <> 0 THEN 'ok' ELSE 'error' END AS outcome FROM orders""")
def delivery_settle(spark, sf_dir):
    requests, reports = deliveries(spark, sf_dir)
    return audit.settle_deliveries(requests, reports).drop("ts")


def deliveries(spark, sf_dir):
    k = c("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    requests = orders.select(k.alias("request_id"), c("o_orderdate").cast("timestamp").alias("ts"))
    reports = orders.filter(k % 5 != 0).select(
        k.alias("request_id"), (k % 7 != 0).alias("delivered"),
        (c("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(k % 120).cast("decimal(18,6)"))).alias("report_ts"),
    )
    return requests, reports


@query("successful_outputs", "SELECT CAST(o_orderkey AS VARCHAR) AS file_key, 'complete' AS status, o_orderkey * 3 AS enqueued_at FROM orders WHERE o_orderstatus = 'F' ORDER BY 3, 1")
def successful_outputs(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(
        c("o_orderkey").cast("string").alias("file_key"),
        F.when(c("o_orderstatus") == "F", "complete").otherwise("failed").alias("status"), (c("o_orderkey") * 3).alias("enqueued_at"),
    )
    return audit.successful_outputs(jobs)


# ---- exports -------------------------------------------------------------------------
@query("sink_audit_jsonl", f"SELECT {_LINE} AS line FROM ({_EVENTS})")
def sink_audit_jsonl(spark, sf_dir):
    return events(spark, sf_dir).select(audit.canonical_line().alias("line"))


_LABELLED = "CASE category " + " ".join(f"WHEN '{x}' THEN {q(v)}" for x, v in DISPLAY_LABELS.items()) + " ELSE category END"


@query("sink_findings_csv", SCAN + f"""
SELECT {_LABELLED} AS "Category", preview AS "Preview", CAST(round(confidence * 100) AS INT) || '%' AS "Confidence", source AS "Source",
  '' AS "Attribute", 'N/A' AS "Page", start_offset AS "Start Offset", end_offset AS "End Offset", 0 AS "Rect Count" FROM ({FINDINGS})""")
def sink_findings_csv(spark, sf_dir):
    from spanveil.sources.sinks import findings_table

    return findings_table(mixed_findings(spark, sf_dir))


@query("sink_findings_json", SCAN + f"""
SELECT src, id, '2026-01-15T00:00:00Z' AS "exportedAt", CAST(count(*) AS INT) AS "totalFindings",
  string_agg(finding_id || '=' || preview, ',' ORDER BY start_offset) AS findings FROM ({FINDINGS}) GROUP BY src, id""")
def sink_findings_json(spark, sf_dir):
    from spanveil.sources.sinks import findings_envelopes

    scanned = sc.finding_array(sc.with_segments(mixed_scan(spark, sf_dir)))
    rows = findings_envelopes(scanned, KEYS, F.lit("2026-01-15T00:00:00Z"))
    shown = F.transform("findings", lambda f: F.concat(f["id"], F.lit("="), f["preview"]))
    return rows.withColumn("findings", joined(shown))


@query("sink_redacted", f"""{SCAN}
SELECT r.src, r.id, regexp_replace('file' || r.id || CASE WHEN r.id % 3 = 0 THEN '.PDF' WHEN r.id % 3 = 1 THEN '.docx' ELSE '.v2.pdf' END,
  '(?i)\\.(pdf|docx)$', '') || '-redacted.pdf' AS output_name, redacted, coalesce(n, 0) AS redacted_count
FROM ({sql.redacted(MIXED, RESOLVED, "'[REDACTED]'")}) r
LEFT JOIN (SELECT src, id, count(*) AS n FROM resolved GROUP BY src, id) f ON r.src = f.src AND r.id = f.id""")
def sink_redacted(spark, sf_dir):
    from spanveil.sources.sinks import redacted_documents

    k = F.col("id") % 3
    name = F.concat(F.lit("file"), "id", F.when(k == 0, ".PDF").when(k == 1, ".docx").otherwise(".v2.pdf"))
    return redacted_documents(mixed_scan(spark, sf_dir).withColumn("name", name), KEYS, "name")
