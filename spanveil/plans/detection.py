"""Queries: shared span operators, category detectors, validators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanveil.functions import checksums as ck
from spanveil.functions import detectors as det
from spanveil.operators.scan import explode_spans
from spanveil.operators.validation import validate_identifier_column
from spanveil.plans import sql_text as sql
from spanveil.plans.carriers import VALUES, corpus, corpus_sql, values
from spanveil.plans.registry import query

# query suffix -> (category, carrier)
DETECTOR_KEYS = {
    "email": "email", "phone": "phone", "ssn": "ssn", "canadian_sin": "canadian_sin",
    "uk_nhs": "uk_nhs", "aadhaar": "aadhaar", "pan_india": "pan_india",
    "australian_tfn": "australian_tfn", "cpf": "cpf", "dob": "dob",
    "mrn": "medical_record_number", "member_id": "member_id", "npi": "npi", "dea": "dea",
    "mbi": "mbi", "secrets": "secrets", "address": "address", "payment_card": "payment_card",
    "possible_name": "possible_name",
}


def span_rows(df, spans_col="spans"):
    return explode_spans(df, spans_col, "src", "id").select(
        "src", "id", F.col("start").cast("bigint").alias("start_pos"),
        F.col("end").cast("bigint").alias("end_pos"), "confidence", "value",
    )


def _register_detector(name: str, category: str) -> None:
    @query(f"detect_{name}", sql.detector(category, corpus_sql(name)))
    def run(spark, sf_dir):
        texts = corpus(spark, sf_dir, name)
        return span_rows(texts.withColumn("spans", det.DETECTORS[category](F.col("text"))))


for _name, _category in DETECTOR_KEYS.items():
    _register_detector(_name, _category)


_WORD_NUMBER = r"[A-Za-z]+ [0-9]{2,}"


@query("op_regex_spans", f"""
SELECT src, id, s AS start_pos, s + length(v) AS end_pos, CAST(1 AS DOUBLE) AS confidence, v AS value
FROM ({sql.hits(corpus_sql("phone"), _WORD_NUMBER)})""")
def op_regex_spans(spark, sf_dir):
    from spanveil.functions.text import regex_spans

    texts = corpus(spark, sf_dir, "phone")
    return span_rows(texts.withColumn("spans", regex_spans(F.col("text"), _WORD_NUMBER)))


@query("op_cue_window", f"""
SELECT src, id, s AS start_pos, v AS value, {sql.near(det.SSN_CUE)} AS has_cue
FROM ({sql.hits(corpus_sql("ssn"), r"[0-9]{4,}")})""")
def op_cue_window(spark, sf_dir):
    from spanveil.functions.text import match_spans

    item = "struct<start_pos:bigint,value:string,has_cue:boolean>"
    found = match_spans(
        F.col("text"), "[0-9]{4,}",
        lambda m: (None, F.struct(
            m.start.cast("bigint").alias("start_pos"), m.value.alias("value"),
            m.before(40).rlike(det.SSN_CUE).alias("has_cue"))),
        window=40, item=item,
    )
    texts = corpus(spark, sf_dir, "ssn").withColumn("spans", found)
    return explode_spans(texts, "spans", "src", "id")


_RECORD = r"(?i)record\s*(?:number|no|#)\s*"


@query("op_label_capture", f"""
SELECT src, id, e AS label_end, nullif(regexp_extract(rest, '[A-Za-z0-9]{{3,}}'), '') AS captured,
       CASE WHEN regexp_matches(rest, '[A-Za-z0-9]{{3,}}')
            THEN e + length(string_split_regex(rest, '[A-Za-z0-9]{{3,}}')[1]) END AS start_pos
FROM (SELECT *, s + length(v) AS e, substr(text, s + length(v) + 1, 40) AS rest
  FROM ({sql.hits(corpus_sql("mrn"), _RECORD)}))""")
def op_label_capture(spark, sf_dir):
    from spanveil.functions.text import match_spans

    def emit(m):
        ident = F.nullif(F.regexp_extract(m.rest, "[A-Za-z0-9]{3,}", 0), F.lit(""))
        at = F.length(F.get(F.split(m.rest, "[A-Za-z0-9]{3,}", 2), F.lit(0)))
        return None, F.struct(
            m.end.cast("bigint").alias("label_end"), ident.alias("captured"),
            F.when(ident.isNotNull(), (m.end + at).cast("bigint")).alias("start_pos"))

    found = match_spans(
        F.col("text"), _RECORD, emit, rest=40,
        item="struct<label_end:bigint,captured:string,start_pos:bigint>",
    )
    texts = corpus(spark, sf_dir, "mrn").withColumn("spans", found)
    return explode_spans(texts, "spans", "src", "id")


@query("secret_placeholder_filter", f"""
SELECT id, value, (regexp_matches(value, {sql.q(sql.sec.PLACEHOLDER_PREFIX)})
  OR regexp_matches(value, {sql.q(sql.sec.ENVIRONMENT_REFERENCE)})
  OR (regexp_matches(value, {sql.q(sql.re2(sql.sec.LOCAL_HOST))})
      AND regexp_matches(value, {sql.q(sql.sec.DEFAULT_LOGIN)}))) AS is_placeholder
FROM (SELECT id, regexp_extract(text, '(?:password: |client_secret=)(.*)$', 1) AS value
      FROM ({corpus_sql("secrets")})) WHERE value <> ''""")
def secret_placeholder_filter(spark, sf_dir):
    from spanveil.functions.secrets import is_placeholder

    value = F.regexp_extract("text", "(?:password: |client_secret=)(.*)$", 1)
    return (
        corpus(spark, sf_dir, "secrets")
        .select("id", value.alias("value")).filter("value <> ''")
        .select("id", "value", is_placeholder(F.col("value")).alias("is_placeholder"))
    )


def _register_validator(kind: str) -> None:
    key = {"luhn": "valid_luhn", "nhs": "valid_nhs"}.get(kind, f"valid_{kind}")

    @query(key, f"SELECT id, value, {sql.valid(kind, 'value')} AS valid FROM "
                f"(SELECT o_orderkey AS id, {VALUES[kind]} AS value FROM orders)")
    def run(spark, sf_dir):
        return validate_identifier_column(values(spark, sf_dir, kind), "value", kind)


for _kind in ck.VALIDATORS:
    _register_validator(_kind)

_TODAY = "2026-01-01"


@query("valid_card_expiry", f"""
SELECT id, value, (m BETWEEN 1 AND 12 AND y BETWEEN 2026 AND 2041) AS valid FROM (
  SELECT *, CAST(split_part(value, '/', 1) AS INT) AS m,
    CASE length(split_part(value, '/', 2)) WHEN 2 THEN 2000 ELSE 0 END
      + CAST(split_part(value, '/', 2) AS INT) AS y
  FROM (SELECT o_orderkey AS id, {VALUES['card_expiry']} AS value FROM orders))""")
def valid_card_expiry(spark, sf_dir):
    today = F.lit(_TODAY).cast("date")
    return values(spark, sf_dir, "card_expiry").withColumn(
        "valid", ck.valid_card_expiry(F.col("value"), today)
    )


@query("non_provider_bound", f"""
SELECT id, value, regexp_matches(right(value, 48), {sql.q(sql.re2(ck.NON_PROVIDER_LABEL))}) AS bound
FROM (SELECT o_orderkey AS id, {VALUES['preceding']} AS value FROM orders)""")
def non_provider_bound(spark, sf_dir):
    return values(spark, sf_dir, "preceding").withColumn(
        "bound", ck.non_provider_bound(F.col("value"))
    )
