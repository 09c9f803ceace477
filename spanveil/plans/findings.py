"""Queries: scan pipeline, masking, redaction, token geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanveil.constants import DEFAULT_CATEGORIES, DISPLAY_LABELS, PLACEHOLDER_LABELS
from spanveil.functions import masking as mk
from spanveil.functions.text import span
from spanveil.operators import custom_rules as cr
from spanveil.operators import scan
from spanveil.operators import tokens as tk
from spanveil.plans import sql_text as sql
from spanveil.plans.carriers import K, VALUES, _spark, corpus, corpus_sql
from spanveil.plans.detection import span_rows
from spanveil.plans.registry import query, table
from spanveil.session import spread, stored

# Every statement over the mixed corpus starts with the texts and the resolved
# spans as materialised tables.
MIXED_TEXTS = corpus_sql("mixed")
MIXED = "SELECT src, id, text FROM corpus"
RESOLVED = "SELECT * FROM resolved"
CORPUS = f"corpus AS MATERIALIZED ({MIXED_TEXTS})"
SCAN = f"WITH {CORPUS}, resolved AS MATERIALIZED ({sql.resolved(sql.raw_all(MIXED))}) "
KEYS = ["src", "id"]
# Fixed for the queries: thresholds of a strict user.
THRESHOLDS = {"secrets": 0.9, "medical_record_number": 0.8, "phone": 0.88, "ssn": 0.9}
_THRESHOLD_SQL = (
    "CASE category " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in THRESHOLDS.items()) + " ELSE 0 END"
)


def mixed_scan(spark, sf_dir):
    return scan.scan_documents(corpus(spark, sf_dir, "mixed"), dealt=True)


def all_rows(df):
    return scan.explode_spans(df, "spans", *KEYS).select(
        *KEYS, "category", F.col("start").cast("bigint").alias("start_pos"),
        F.col("end").cast("bigint").alias("end_pos"), "confidence", "value",
    )


# Overlapping raw spans cut from the documents themselves: three shapes that nest
# and chain, so that most clusters have several members.
_SHAPES = [
    ("address", 0.72, r"[A-Za-z]+ [A-Za-z]+ [A-Za-z]+"),
    ("email", 0.92, r"[A-Za-z]+ [a-z]{2,4}"),
    ("secrets", 0.80, r"[a-z]{5,} [A-Za-z]+"),
]
_DOCS = "SELECT 'doc' AS src, doc_id AS id, text FROM documents"
_OVERLAPPING = " UNION ALL ".join(
    f"SELECT src, id, '{c}' AS category, s AS start_pos, s + length(v) AS end_pos, "
    f"CAST({p} AS DOUBLE) AS confidence, v AS value FROM ({sql.hits(_DOCS, r)})"
    for c, p, r in _SHAPES
)


@query("resolve_overlaps", sql.resolved(_OVERLAPPING))
def resolve_overlaps(spark, sf_dir):
    from spanveil.functions.overlaps import resolve_overlaps as resolve
    from spanveil.functions.text import regex_spans

    docs = spread(table(spark, sf_dir, "documents")).select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "text"
    )
    raw = F.concat(*[regex_spans(F.col("text"), r, c, p) for c, p, r in _SHAPES])
    return all_rows(docs.withColumn("spans", resolve(raw)))


# One rule per nation, so the rule table is derived from given data.
_RULES_SQL = """
SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'custom' ELSE 'member_id' END AS category,
  '\\b' || chr(97 + n_nationkey) || '[a-z]{' || (4 + n_nationkey % 3) || '}\\b' AS pattern,
  0.5 + n_nationkey / 100.0 AS confidence FROM nation"""


def nation_rules(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.alias("id"),
        F.when(k % 3 == 0, "custom").otherwise("member_id").alias("category"),
        F.concat(F.lit("\\b"), F.char(k + 97), F.lit("[a-z]{"), 4 + k % 3, F.lit("}\\b")).alias("pattern"),
        F.lit("gi").alias("flags"),
        (0.5 + k / 100).alias("confidence"),
    )


def _custom_sql(corpus):
    return f"""
SELECT src, id, category, start_pos, end_pos, CAST(confidence AS DOUBLE) AS confidence, value FROM (
 SELECT src, id, category, confidence, m[i] AS value,
   CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
     + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start_pos,
   start_pos + length(m[i]) AS end_pos
 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT d.src, d.id, r.category, r.confidence,
    regexp_extract_all(d.text, '(?i)' || r.pattern) AS m, string_split_regex(d.text, '(?i)' || r.pattern) AS g
  FROM ({corpus}) d, ({_RULES_SQL}) r)))"""


@query("detect_custom_rules", _custom_sql(_DOCS))
def detect_custom_rules(spark, sf_dir):
    rules = cr.collect_rules(nation_rules(spark, sf_dir))
    docs = spread(table(spark, sf_dir, "documents")).select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "text"
    )
    return all_rows(docs.withColumn("spans", cr.custom_rule_spans(F.col("text"), rules)))


# Built-in categories and the user rules of enabled categories compete together.
_ENABLED = [*DEFAULT_CATEGORIES, "custom"]


@query("detect_all", f"WITH {CORPUS} " + sql.resolved(
    sql.raw_all(MIXED) + f" UNION ALL SELECT src, id, category, start_pos, end_pos, confidence, value FROM ({_custom_sql(MIXED)})"
))
def detect_all(spark, sf_dir):
    rules = cr.custom_rule_spans(F.col("text"), cr.collect_rules(nation_rules(spark, sf_dir)))
    return all_rows(scan.scan_documents(corpus(spark, sf_dir, "mixed"), categories=_ENABLED, extra=rules, dealt=True))


@query("threshold_filter", SCAN + f"SELECT * FROM ({RESOLVED}) WHERE confidence >= {_THRESHOLD_SQL}")
def threshold_filter(spark, sf_dir):
    return scan.threshold_filter(all_rows(mixed_scan(spark, sf_dir)), THRESHOLDS)


def _findings_sql(prefix="", pad=120, node=None, source=None, offset="0", selected="true", where="TRUE"):
    node = f"'{node}'" if node is not None else (
        "'seg_' || CAST(length(substr(text, 1, start_pos)) - length(replace(substr(text, 1, start_pos), chr(10), '')) AS VARCHAR)"
    )
    lead = f"'{prefix}_' || " if prefix else ""
    source = source or "local-rules"
    ctx = sql.mask_context(
        f"substr(text, greatest(start_pos - {pad}, 0) + 1, end_pos + {pad} - greatest(start_pos - {pad}, 0))"
    )
    return f"""
SELECT src, id, {lead}category || '_' || start_pos || '_' || end_pos || '_' || i AS finding_id,
  category, confidence, {sql.mask_value()} AS preview, {node} AS node_id,
  start_pos + {offset} AS start_offset, end_pos + {offset} AS end_offset,
  {ctx} AS context_preview, '{source}' AS source, {selected} AS selected
FROM (SELECT r.*, c.text, row_number() OVER (PARTITION BY r.src, r.id ORDER BY r.start_pos) - 1 AS i
      FROM ({RESOLVED}) r JOIN ({MIXED}) c ON r.src = c.src AND r.id = c.id) WHERE {where}"""


FINDINGS = _findings_sql()


def mixed_findings(spark, sf_dir):
    return scan.build_findings(scan.with_segments(mixed_scan(spark, sf_dir)), KEYS)


@query("finding_build", SCAN + FINDINGS)
def finding_build(spark, sf_dir):
    return mixed_findings(spark, sf_dir)


# Every text of the corpus is a page that also holds it as SVG text, as a caption with a
# lead, and line by line as attribute values.
_SURFACES = """SELECT surface || ':' || src AS src, id, CASE surface WHEN 'caption' THEN 'Caption: ' || text ELSE text END AS text,
  length(text) AS page_chars, surface FROM (SELECT *, unnest(['svg', 'caption', 'attr']) AS surface FROM corpus)"""
_ATTRIBUTES = ["aria-label", "alt", "placeholder", "title"]


@query("finding_build_report_only", f"""WITH {CORPUS}, surfaces AS MATERIALIZED ({_SURFACES}),
resolved AS MATERIALIZED ({sql.resolved(sql.raw_all("SELECT src, id, text FROM surfaces"))})
SELECT split_part(src, ':', 2) AS src, id, surface || '_' || category || '_' || start_pos || '_' || end_pos || '_' || i AS finding_id,
  category, confidence, {sql.mask_value()} AS preview,
  CASE surface WHEN 'svg' THEN 'svg' WHEN 'caption' THEN 'video-caption' ELSE '' END AS node_id,
  start_pos + shift AS start_offset, end_pos + shift AS end_offset,
  CASE surface WHEN 'attr' THEN {sql.mask_context("substr(text, greatest(start_pos - 120, 0) + 1, end_pos + 120 - greatest(start_pos - 120, 0))")}
    ELSE {sql.mask_context("substr(text, greatest(start_pos - 80, 0) + 1, end_pos + 80 - greatest(start_pos - 80, 0))")} END AS context_preview,
  CASE surface WHEN 'attr' THEN 'attr' ELSE 'local-rules' END AS source,
  CASE surface WHEN 'attr' THEN {_ATTRIBUTES}[1 + (length(substr(text, 1, start_pos)) - length(replace(substr(text, 1, start_pos), chr(10), ''))) % 4] END AS attribute,
  false AS selected
FROM (SELECT r.*, s.text, s.surface, CASE s.surface WHEN 'svg' THEN page_chars + 1 WHEN 'caption' THEN page_chars + 2000 ELSE 0 END AS shift,
    row_number() OVER (PARTITION BY r.src, r.id ORDER BY r.start_pos) - 1 AS i
  FROM resolved r JOIN surfaces s ON r.src = s.src AND r.id = s.id)""")
def finding_build_report_only(spark, sf_dir):
    lines = F.size(F.split("text", "\n"))
    names = F.transform(F.sequence(F.lit(0), lines - 1), lambda i: F.get(F.array(*map(F.lit, _ATTRIBUTES)), i % 4))
    surface = lambda text, *names: F.struct(F.array(*map(F.lit, names)).alias("surface"), text.alias("text"))
    pages = corpus(spark, sf_dir, "mixed").select(
        *KEYS, F.length("text").alias("page_chars"), names.alias("attributes"),
        F.explode(F.array(
            surface(F.col("text"), "svg", "attr"), surface(F.concat(F.lit("Caption: "), "text"), "caption")
        )).alias("s"),
    )
    return scan.report_only(pages.select(*KEYS, "page_chars", "attributes", "s.*"), KEYS)


@query("finding_merge_media", SCAN + FINDINGS + " UNION ALL "
       + f"""SELECT src, id, 'media_img-' || (id % 8) || '_' || finding_id, category, confidence, preview,
  node_id, start_offset, end_offset, context_preview, 'local-rules', false
  FROM ({FINDINGS}) WHERE confidence >= {_THRESHOLD_SQL}""")
def finding_merge_media(spark, sf_dir):
    media = F.concat(F.lit("img-"), F.col("id") % 8)
    return scan.with_media(mixed_findings(spark, sf_dir), media, THRESHOLDS)


@query("confidence_label", SCAN + f"""
SELECT src, id, start_pos, CASE WHEN confidence >= 0.9 THEN 'High' WHEN confidence >= 0.7 THEN 'Medium'
  ELSE 'Low' END AS label FROM ({RESOLVED})""")
def confidence_label(spark, sf_dir):
    rows = all_rows(mixed_scan(spark, sf_dir))
    return rows.select(*KEYS, "start_pos", mk.confidence_label(F.col("confidence")).alias("label"))


_SECRET_CASE = "CASE " + " ".join(
    f"WHEN regexp_matches(value, {sql.q(p)}) THEN {sql.q(n)}" for p, n in mk.SECRET_NAMES
) + " END"
_DISPLAY = "CASE category " + " ".join(f"WHEN '{c}' THEN {sql.q(v)}" for c, v in DISPLAY_LABELS.items()) + " ELSE category END"


@query("secret_display_name", SCAN + f"""
SELECT src, id, start_pos, coalesce(CASE WHEN category = 'secrets' THEN {_SECRET_CASE} END, {_DISPLAY})
  AS display_name FROM ({RESOLVED})""")
def secret_display_name(spark, sf_dir):
    rows = all_rows(mixed_scan(spark, sf_dir))
    name = mk.display_name(F.col("category"), F.col("value"))
    return rows.select(*KEYS, "start_pos", name.alias("display_name"))


_ANY = f"SELECT o_orderkey AS id, {VALUES['category']} AS category, {VALUES['any']} AS value FROM orders"


def any_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.expr(_spark(VALUES["category"])).alias("category"),
        F.expr(_spark(VALUES["any"])).alias("value"),
    )


@query("mask_value", f"SELECT id, category, {sql.mask_value()} AS preview FROM ({_ANY})")
def mask_value(spark, sf_dir):
    preview = mk.mask_value(F.col("category"), F.col("value"))
    return any_values(spark, sf_dir).select("id", "category", preview.alias("preview"))


@query("mask_context", f"WITH {CORPUS} SELECT src, id, {sql.mask_context('text')} AS masked FROM ({MIXED})")
def mask_context(spark, sf_dir):
    return corpus(spark, sf_dir, "mixed").select(
        *KEYS, mk.mask_context(F.col("text")).alias("masked")
    )


_LABEL = "(CASE category " + " ".join(f"WHEN '{c}' THEN '{v}'" for c, v in PLACEHOLDER_LABELS.items()) + " END)"


@query("placeholder_label", f"SELECT id, category, {_LABEL} AS label FROM ({_ANY})")
def placeholder_label(spark, sf_dir):
    return any_values(spark, sf_dir).select(
        "id", "category", mk.placeholder_label(F.col("category")).alias("label")
    )


@query("redact_placeholder", SCAN + sql.redacted(MIXED, RESOLVED, "'[REDACTED]'"))
def redact_placeholder(spark, sf_dir):
    redacted = mk.redact_placeholder(F.col("text"), F.col("spans"))
    return mixed_scan(spark, sf_dir).select(*KEYS, redacted.alias("redacted"))


@query("redact_labels", SCAN + sql.redacted(MIXED, RESOLVED, _LABEL.replace("category", "p.category", 1)))
def redact_labels(spark, sf_dir):
    redacted = mk.redact_labels(F.col("text"), F.col("spans"))
    return mixed_scan(spark, sf_dir).select(*KEYS, redacted.alias("redacted"))


_BLOCKS = "repeat('█', CAST(p.end_pos - p.start_pos AS INT))"


@query("redact_slice", SCAN + f"""
SELECT src, id, substr(redacted, lo + 1, hi - lo) AS redacted FROM (
  SELECT *, greatest(0, least(id % 50, length(redacted))) AS lo,
    greatest(greatest(0, least(id % 50, length(redacted))), least(120 + id % 7, length(redacted))) AS hi
  FROM ({sql.redacted(MIXED, RESOLVED, _BLOCKS)}))""")
def redact_slice(spark, sf_dir):
    lo, hi = F.col("id") % 50, 120 + F.col("id") % 7
    return mixed_scan(spark, sf_dir).select(
        *KEYS, mk.redact_slice(F.col("text"), F.col("spans"), lo, hi).alias("redacted")
    )


@query("leak_verify", f"""
{SCAN}, red AS MATERIALIZED (
  SELECT src, id, redacted AS text FROM ({sql.redacted(MIXED, RESOLVED, "'[REDACTED]'")})),
again AS MATERIALIZED ({sql.resolved(sql.raw_all('SELECT src, id, text FROM red'))})
SELECT c.src, c.id, coalesce(f.n, 0) AS checked, coalesce(a.n, 0) AS surviving,
       coalesce(a.n, 0) = 0 AND coalesce(f.n, 0) > 0 AS verified
FROM ({MIXED}) c
LEFT JOIN (SELECT src, id, count(*) AS n FROM resolved GROUP BY ALL) f ON c.src = f.src AND c.id = f.id
LEFT JOIN (SELECT src, id, count(*) AS n FROM again WHERE EXISTS (SELECT 1 FROM resolved
   WHERE resolved.src = again.src AND resolved.id = again.id AND resolved.value = again.value) GROUP BY ALL) a
  ON c.src = a.src AND c.id = a.id""")
def leak_verify(spark, sf_dir):
    scanned = mixed_scan(spark, sf_dir)
    redacted = scanned.withColumn("redacted", mk.redact_placeholder(F.col("text"), F.col("spans")))
    return scan.leak_verify(redacted, "redacted", KEYS)


@query("apply_selection", SCAN + f"""
SELECT src, id, finding_id, CASE WHEN source = 'attr' THEN false ELSE start_offset % 2 = 0 END AS selected
FROM (SELECT * REPLACE (CASE WHEN id % 5 = 0 THEN 'attr' ELSE source END AS source) FROM ({FINDINGS}))""")
def apply_selection(spark, sf_dir):
    found = mixed_findings(spark, sf_dir).withColumn(
        "source", F.when(F.col("id") % 5 == 0, "attr").otherwise(F.col("source"))
    )
    # read twice below, detected once
    found = stored(found.select(*KEYS, "finding_id", "source", "start_offset", "selected"))
    chosen = found.filter("start_offset % 2 = 0").select(*KEYS, "finding_id")
    return scan.apply_selection(found, chosen, KEYS).select(*KEYS, "finding_id", "selected")


_FORM = "(CASE category " + " ".join(
    f"WHEN '{c}' THEN regexp_full_match(preview, {sql.q(p[1:-1])})" for c, p in mk.PREVIEW_FORMS.items()
) + " ELSE false END)"
_PREVIEWS = f"""SELECT id, category, CASE WHEN id % 4 = 0 THEN value ELSE {sql.mask_value()} END AS preview
FROM ({_ANY})"""


@query("preview_conformance", f"""
SELECT id, category, preview, length(preview) BETWEEN 1 AND 256 AND {_FORM} AS conforms FROM ({_PREVIEWS})""")
def preview_conformance(spark, sf_dir):
    masked = mk.mask_value(F.col("category"), F.col("value"))
    rows = any_values(spark, sf_dir).select(
        "id", "category", F.when(F.col("id") % 4 == 0, F.col("value")).otherwise(masked).alias("preview")
    )
    return rows.withColumn("conforms", mk.preview_conforms(F.col("category"), F.col("preview")))


@query("finding_conformance", SCAN + f"""
SELECT src, id, finding_id, CASE
  WHEN NOT regexp_full_match(finding_id, '[a-z][a-z0-9:_-]{{0,127}}') THEN 'id'
  WHEN confidence < 0 OR confidence > 1 THEN 'confidence'
  WHEN source NOT IN ('local-rules','local-model','gateway','attr','custom-pattern') THEN 'source'
  WHEN NOT (length(preview) BETWEEN 1 AND 256 AND {_FORM}) THEN 'preview'
  WHEN length(context_preview) > 512 THEN 'context_preview'
  WHEN end_offset < start_offset OR start_offset < 0 THEN 'offsets'
  WHEN source = 'attr' AND selected THEN 'attribute' END AS violation
FROM (SELECT * REPLACE (CASE WHEN id % 9 = 1 THEN 1.5 ELSE confidence END AS confidence,
   CASE WHEN id % 9 = 2 THEN 'other' ELSE source END AS source,
   CASE WHEN id % 9 = 3 THEN upper(finding_id) ELSE finding_id END AS finding_id,
   CASE WHEN id % 9 = 4 THEN start_offset - 1 ELSE end_offset END AS end_offset)
 FROM ({FINDINGS}))""")
def finding_conformance(spark, sf_dir):
    from spanveil.operators.conformance import finding_violation

    k = F.col("id") % 9
    found = mixed_findings(spark, sf_dir).withColumns({
        "confidence": F.when(k == 1, 1.5).otherwise(F.col("confidence")),
        "source": F.when(k == 2, "other").otherwise(F.col("source")),
        "finding_id": F.when(k == 3, F.upper("finding_id")).otherwise(F.col("finding_id")),
        "end_offset": F.when(k == 4, F.col("start_offset") - 1).otherwise(F.col("end_offset")),
    })
    return found.select(*KEYS, "finding_id", finding_violation(found.columns).alias("violation"))


# ---- tokens ------------------------------------------------------------------
# Words of every text; 200 to a page, ten to a line, one column of 100 px each.
_WORDS_SQL = f"""
SELECT id * 2 + CASE WHEN src = 'gen' THEN 1 ELSE 0 END AS doc_id, (i - 1) // 200 AS page,
  (i - 1) % 200 AS seq, ((i - 1) % 200) // 10 AS line, ws[i] AS text,
  CAST(100 * ((i - 1) % 10) AS DOUBLE) AS x, CAST(20 * (((i - 1) % 200) // 10) AS DOUBLE) AS y,
  CAST(6 * length(ws[i]) AS DOUBLE) AS width, CAST(CASE WHEN length(ws[i]) = 2 THEN 0 ELSE 12 END AS DOUBLE) AS height
FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (
  SELECT src, id, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM ({MIXED})))"""
_PLACED = f"""
SELECT *, CAST(sum(length(sep) + length(text)) OVER (PARTITION BY doc_id, page ORDER BY seq
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_pos, end_pos - length(text) AS start_pos FROM (
  SELECT *, CASE WHEN seq = 0 THEN '' WHEN line <> lag(line) OVER (PARTITION BY doc_id, page ORDER BY seq)
    THEN chr(10) ELSE ' ' END AS sep FROM ({_WORDS_SQL}))"""
_PAGES = f"""SELECT doc_id, page, string_agg(sep || text, '' ORDER BY seq) AS page_text
FROM ({_PLACED}) GROUP BY doc_id, page"""


_PER_PAGE, _PER_LINE = 200, 10


def _laid(i):
    """Page, place on it, line and box of the word with the number ``i``, given its text."""
    at = i % _PER_PAGE
    line = F.floor(at / _PER_LINE)

    def token(text, name):
        return [at.alias("seq"), line.alias("line"), text.alias(name), F.struct(
            (100 * (i % _PER_LINE)).cast("double").alias("x"), (20 * line).cast("double").alias("y"),
            (6 * F.length(text)).cast("double").alias("width"),
            F.when(F.length(text) == 2, 0.0).otherwise(12.0).alias("height"),
        ).alias("bbox")]

    return F.floor(i / _PER_PAGE), token


def texts_of_words(spark, sf_dir):
    return corpus(spark, sf_dir, "mixed").select(
        (F.col("id") * 2 + F.when(F.col("src") == "gen", 1).otherwise(0)).alias("doc_id"),
        F.filter(F.split("text", " "), lambda w: w != "").alias("ws"),
    )


def words(spark, sf_dir):
    ws = texts_of_words(spark, sf_dir).select("doc_id", F.posexplode("ws").alias("i", "text"))
    page, token = _laid(F.col("i").cast("bigint"))
    return ws.select("doc_id", page.alias("page"), *token(F.col("text"), "text"))


def page_numbers(ws):
    """The pages that some words fill, in order."""
    return F.sequence(F.lit(0).cast("bigint"), F.floor((F.size(ws) - 1) / _PER_PAGE))


def word_pages(spark, sf_dir):
    """The words of ``words``, a row and an array for every page of a text."""

    def part(ws, page):
        def placed(i):
            _, token = _laid(i)
            return F.struct(*token(F.get(ws, i.cast("int")), "word"))

        last = F.least(page * _PER_PAGE + _PER_PAGE, F.size(ws)) - 1
        return F.struct(page.alias("page"), F.transform(F.sequence(page * _PER_PAGE, last), placed).alias("part"))

    parts = F.transform(page_numbers(F.col("ws")), lambda page: part(F.col("ws"), page))
    texts = texts_of_words(spark, sf_dir).select("doc_id", F.explode(F.when(F.size("ws") > 0, parts)).alias("p"))
    return texts.select("doc_id", "p.*")


def page_keys(spark, sf_dir):
    """Every page once; its words are counted, not laid out."""
    filled = F.when(F.size("ws") > 0, page_numbers(F.col("ws")))
    return texts_of_words(spark, sf_dir).select("doc_id", F.explode(filled).alias("page")).distinct()


def pages(spark, sf_dir):
    return tk.assemble_pages(word_pages(spark, sf_dir))


@query("ocr_page_text", f"WITH {CORPUS} " + _PAGES)
def ocr_page_text(spark, sf_dir):
    return pages(spark, sf_dir).select(*tk.PAGE, "page_text")


@query("ocr_token_spans", f"WITH {CORPUS} SELECT doc_id, page, seq, start_pos, end_pos, text FROM ({_PLACED})")
def ocr_token_spans(spark, sf_dir):
    return tk.token_spans(pages(spark, sf_dir))


_SIZES = f"SELECT DISTINCT doc_id, page, 1000 AS width_px, 400 + doc_id % 3 AS height_px FROM ({_WORDS_SQL})"


def sizes(spark, sf_dir):
    return page_keys(spark, sf_dir).withColumns({
        "width_px": F.lit(1000).cast("bigint"), "height_px": 400 + F.col("doc_id") % 3,
    })


@query("box_scale", f"""WITH {CORPUS}
SELECT w.doc_id, w.page, seq, x * 612 / width_px AS x, y * 792 / height_px AS y,
  width * 612 / width_px AS width, height * 792 / height_px AS height
FROM ({_WORDS_SQL}) w JOIN ({_SIZES}) s ON w.doc_id = s.doc_id AND w.page = s.page""")
def box_scale(spark, sf_dir):
    b = F.col("bbox")
    joined = words(spark, sf_dir).join(sizes(spark, sf_dir), tk.PAGE)
    return joined.select(
        *tk.PAGE, "seq",
        *[(b[c] * n / F.col(of)).alias(c) for c, n, of in (
            ("x", 612, "width_px"), ("y", 792, "height_px"), ("width", 612, "width_px"),
            ("height", 792, "height_px"))],
    )


@query("text_layer_first", f"""WITH {CORPUS}
SELECT s.doc_id, s.page, coalesce(n, 0) AS token_count, n IS NULL AS needs_ocr FROM ({_SIZES}) s
LEFT JOIN (SELECT doc_id, page, count(*) AS n FROM ({_WORDS_SQL}) WHERE doc_id % 3 <> 0 GROUP BY ALL) t
ON s.doc_id = t.doc_id AND s.page = t.page""")
def text_layer_first(spark, sf_dir):
    return tk.text_layer_first(sizes(spark, sf_dir), words(spark, sf_dir).filter("doc_id % 3 <> 0"))


_PAGE_SPANS = f"""
SELECT src AS page, id AS doc_id, category, start_pos, end_pos, confidence, value,
  row_number() OVER (PARTITION BY src, id ORDER BY start_pos) - 1 AS i
FROM ({sql.resolved(sql.raw_all('SELECT page AS src, doc_id AS id, page_text AS text FROM pg'))})"""
_COVERED = """
SELECT f.doc_id, f.page, f.i, w.seq, w.line, w.x, w.y, w.width, w.height
FROM found f JOIN placed w ON f.doc_id = w.doc_id AND f.page = w.page
  AND w.start_pos < f.end_pos AND w.end_pos > f.start_pos"""
_RECTS = f"""
SELECT doc_id, page, i, line, island, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width,
  max(y + height) - min(y) AS height FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page, i, line ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN x >= coalesce(max(x + width) OVER (PARTITION BY doc_id, page, i, line ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e9) + 10 THEN 1 ELSE 0 END AS fresh FROM ({_COVERED})))
GROUP BY doc_id, page, i, line, island HAVING max(x + width) > min(x) AND max(y + height) > min(y)"""
_WITH = f"WITH {CORPUS}, placed AS MATERIALIZED ({_PLACED}), pg AS MATERIALIZED ({_PAGES.replace(f'({_PLACED})', 'placed')}), found AS MATERIALIZED ({_PAGE_SPANS}), rects AS MATERIALIZED ({_RECTS})"
_CTX40 = sql.mask_context(
    "substr(page_text, greatest(start_pos - 40, 0) + 1, start_pos - greatest(start_pos - 40, 0)) || ' ' || substr(page_text, end_pos + 1, 40)"
)


def doc_findings(spark, sf_dir):
    return tk.page_findings(pages(spark, sf_dir))


@query("finding_build_doc", f"""{_WITH}
SELECT f.doc_id, f.page, 'doc:' || f.page || ':' || f.i AS finding_id, category, confidence,
  {sql.mask_value()} AS preview, start_pos AS start_offset, end_pos AS end_offset,
  {_CTX40} AS context_preview, r.n AS rect_count
FROM found f JOIN pg ON f.doc_id = pg.doc_id AND f.page = pg.page
JOIN (SELECT doc_id, page, i, count(*) AS n FROM rects GROUP BY ALL) r
  ON f.doc_id = r.doc_id AND f.page = r.page AND f.i = r.i""")
def finding_build_doc(spark, sf_dir):
    return doc_findings(spark, sf_dir).select(
        *tk.PAGE, "finding_id", "category", "confidence", "preview", "start_offset", "end_offset",
        "context_preview", F.size("rects").cast("bigint").alias("rect_count"),
    )


@query("finding_rects", f"""{_WITH}
SELECT doc_id, page, 'doc:' || page || ':' || i AS finding_id,
  row_number() OVER (PARTITION BY doc_id, page, i ORDER BY line, island) - 1 AS rect_no, x, y, width, height
FROM rects""")
def finding_rects(spark, sf_dir):
    return tk.finding_rects(doc_findings(spark, sf_dir)).withColumn(
        "rect_no", F.col("rect_no").cast("bigint")
    )


_EXPLICIT = "SELECT doc_id, page, 10.0::DOUBLE AS x, 380.5::DOUBLE AS y, (50 + doc_id % 5)::DOUBLE AS width, 30.25::DOUBLE AS height FROM pg WHERE doc_id % 7 = 0"
_BOXES = f"""SELECT *, 'explicit' AS origin FROM ({_EXPLICIT}) UNION ALL
SELECT doc_id, page, x, y, width, height, 'derived' FROM rects WHERE doc_id % 7 <> 0"""


def explicit_boxes(spark, sf_dir):
    return page_keys(spark, sf_dir).filter("doc_id % 7 = 0").select(
        "doc_id", "page", F.lit(10.0).alias("x"), F.lit(380.5).alias("y"),
        (50 + F.col("doc_id") % 5).cast("double").alias("width"), F.lit(30.25).alias("height"),
    )


def boxes(spark, sf_dir):
    return tk.redaction_boxes(doc_findings(spark, sf_dir), explicit_boxes(spark, sf_dir))


@query("redaction_boxes", f"{_WITH} {_BOXES}")
def redaction_boxes(spark, sf_dir):
    return boxes(spark, sf_dir)


@query("box_pad_clip", f"""{_WITH}
SELECT b.doc_id, b.page, greatest(0, x - 4) AS paint_x, greatest(0, y - 4) AS paint_y,
  least(width_px - greatest(0, x - 4), width + 8) AS paint_width,
  least(height_px - greatest(0, y - 4), height + 8) AS paint_height,
  greatest(0, floor(x - 4)) AS verify_x, greatest(0, floor(y - 4)) AS verify_y,
  greatest(0, least(width_px, ceil(x + width + 4)) - greatest(0, floor(x - 4))) AS verify_width,
  greatest(0, least(height_px, ceil(y + height + 4)) - greatest(0, floor(y - 4))) AS verify_height
FROM ({_BOXES}) b JOIN ({_SIZES}) s ON b.doc_id = s.doc_id AND b.page = s.page
WHERE least(width_px - greatest(0, x - 4), width + 8) > 0 AND least(height_px - greatest(0, y - 4), height + 8) > 0""")
def box_pad_clip(spark, sf_dir):
    return tk.box_pad_clip(boxes(spark, sf_dir), sizes(spark, sf_dir))


# Painting lost half of every box's width in each third document.
_PAINTED = """SELECT doc_id, page, px AS x, py AS y, pw * CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 1 END AS width, ph AS height FROM (
  SELECT b.doc_id, b.page, greatest(0, x - 4) AS px, greatest(0, y - 4) AS py,
    least(width_px - greatest(0, x - 4), width + 8) AS pw, least(height_px - greatest(0, y - 4), height + 8) AS ph
  FROM bx b JOIN sz s ON b.doc_id = s.doc_id AND b.page = s.page) WHERE pw > 0 AND ph > 0"""
_REQUIRED = """SELECT row_number() OVER () AS rid, b.doc_id, b.page, greatest(0, floor(x - 4)) AS x1, greatest(0, floor(y - 4)) AS y1,
  greatest(greatest(0, floor(x - 4)), least(width_px, ceil(x + width + 4))) AS x2,
  greatest(greatest(0, floor(y - 4)), least(height_px, ceil(y + height + 4))) AS y2
FROM bx b JOIN sz s ON b.doc_id = s.doc_id AND b.page = s.page"""
# Strips between the x edges of what is painted inside a required box; in each, the
# union of the y intervals by a running maximum.
_SHARES = """SELECT r.rid, r.doc_id, (x2 - x1) * (y2 - y1) AS size, coalesce(a.area, 0) AS area FROM rq r LEFT JOIN (
  SELECT rid, sum((hi - lo) * len) AS area FROM (
    SELECT rid, lo, hi, sum(greatest(0, y2 - greatest(y1, coalesce(reach, -1e9)))) AS len FROM (
      SELECT s.rid, lo, hi, y1, y2, max(y2) OVER (PARTITION BY s.rid, lo ORDER BY y1, y2
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM (SELECT * FROM (SELECT rid, e AS lo, lead(e) OVER (PARTITION BY rid ORDER BY e) AS hi
        FROM (SELECT rid, x1 AS e FROM cl UNION SELECT rid, x2 FROM cl)) WHERE hi IS NOT NULL) s
      JOIN cl c ON c.rid = s.rid AND c.x1 <= lo AND c.x2 >= hi)
    GROUP BY rid, lo, hi) GROUP BY rid) a ON r.rid = a.rid"""
_CLIPPED = """SELECT r.rid, greatest(r.x1, p.x) AS x1, least(r.x2, p.x + p.width) AS x2, greatest(r.y1, p.y) AS y1,
  least(r.y2, p.y + p.height) AS y2
FROM rq r JOIN pt p ON r.doc_id = p.doc_id AND r.page = p.page
  AND p.x < r.x2 AND p.x + p.width > r.x1 AND p.y < r.y2 AND p.y + p.height > r.y1"""


def _verdict_sql(painted: str = "TRUE") -> str:
    return f"""{_WITH}, bx AS MATERIALIZED ({_BOXES}), sz AS MATERIALIZED ({_SIZES}), rq AS MATERIALIZED ({_REQUIRED}),
pt AS MATERIALIZED (SELECT * FROM ({_PAINTED}) WHERE {painted}), cl AS MATERIALIZED ({_CLIPPED}), sh AS MATERIALIZED ({_SHARES}),
vd AS (SELECT doc_id, count(*) FILTER (size > 0) AS checked_regions, count(*) FILTER (size > 0 AND area / size >= 0.85) AS covered_regions,
  count(*) FILTER (NOT (size > 0 AND area / size >= 0.85)) AS failures FROM sh GROUP BY doc_id)"""


def box_rows(spark, sf_dir):
    """Findings and padded boxes of every page, from one detection."""
    rows = tk.padded_boxes(tk.redaction_rows(doc_findings(spark, sf_dir), explicit_boxes(spark, sf_dir)), sizes(spark, sf_dir))
    half = F.when(F.col("doc_id") % 3 == 0, 0.5).otherwise(1.0)
    lost = F.col("painted").withField("width", F.col("painted.width") * half)
    return rows.withColumn("painted", F.when(F.col("painted").isNotNull(), lost))


@query("redaction_verify", f"""{_verdict_sql()}
SELECT *, failures = 0 AND checked_regions > 0 AS verified FROM vd""")
def redaction_verify(spark, sf_dir):
    return tk.verify_boxes(box_rows(spark, sf_dir))


@query("redaction_manifest", f"""{_WITH}
SELECT s.doc_id, s.pages, s.total_px, coalesce(b.n, 0) AS redacted_count FROM (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS pages, CAST(sum(width_px * height_px) AS BIGINT) AS total_px
  FROM ({_SIZES}) GROUP BY doc_id) s
LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({_BOXES}) GROUP BY doc_id) b ON s.doc_id = b.doc_id""")
def redaction_manifest(spark, sf_dir):
    return tk.redaction_manifest(sizes(spark, sf_dir), boxes(spark, sf_dir))


# Each fifth document is not painted yet.
@query("redaction_stage", f"""{_verdict_sql("doc_id % 5 <> 0")},
n AS (SELECT doc_id, count(*) AS detected_values FROM (SELECT DISTINCT doc_id, page, i FROM rects) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS painted_regions FROM pt GROUP BY doc_id)
SELECT d.doc_id, coalesce(detected_values, 0) AS detected_values, coalesce(painted_regions, 0) AS painted_regions,
  CASE WHEN painted_regions > 0 AND failures = 0 AND checked_regions > 0 THEN 'verified' WHEN painted_regions > 0 THEN 'redacted'
    WHEN detected_values > 0 THEN 'detected' END AS stage
FROM (SELECT doc_id FROM n UNION SELECT doc_id FROM bx) d LEFT JOIN n ON d.doc_id = n.doc_id
LEFT JOIN m ON d.doc_id = m.doc_id LEFT JOIN vd ON d.doc_id = vd.doc_id""")
def redaction_stage(spark, sf_dir):
    drawn = F.when(F.col("doc_id") % 5 != 0, F.col("painted"))
    return tk.redaction_stage(box_rows(spark, sf_dir).withColumn("painted", drawn))
