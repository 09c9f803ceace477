"""Queries: sources, segments, offsets, Unicode."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanveil.functions.text import WS_SET
from spanveil.operators import segments as sg
from spanveil.plans.registry import query, table
from spanveil.plans.sql_text import q
from spanveil.session import spread
from spanveil.sources import readers

# Lines of the documents as text nodes; a third is wrapped in strippable blanks
# and every fifth stands for an input value.
_RAW = """SELECT doc_id, i - 1 AS seq, (doc_id + i - 1) % 5 = 0 AS is_input,
  CASE WHEN (i - 1) % 3 = 0 THEN chr(160) || ' ' || parts[i] || chr(8203) ELSE parts[i] END AS raw
FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""
_T = rf"[{WS_SET}\x{{200B}}]"
_TRIMMED = f"regexp_replace(raw, {q(f'^{_T}+|{_T}+$')}, '', 'g')"


def _segments_sql():
    return f"""SELECT doc_id, seq, 'seg_' || seq AS node_id, start_offset,
  start_offset + length(text) AS end_offset, text, truncated FROM (
  SELECT doc_id, seq, t AS text, false AS truncated,
    CASE WHEN is_input THEN 0 ELSE length(raw) - length(regexp_replace(raw, {q(f'^{_T}+')}, '')) END AS start_offset
  FROM (SELECT *, {_TRIMMED} AS t FROM ({_RAW})) WHERE t <> '')"""


def raw_segments(spark, sf_dir):
    lines = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line")
    )
    wrapped = F.when(
        F.col("seq") % 3 == 0, F.concat(F.lit("\u00a0 "), "line", F.lit("\u200b"))
    ).otherwise(F.col("line"))
    return lines.select(
        "doc_id", F.col("seq").cast("bigint").alias("seq"),
        ((F.col("doc_id") + F.col("seq")) % 5 == 0).alias("is_input"), wrapped.alias("raw"),
    )


def segments(spark, sf_dir):
    return sg.trim_segments(raw_segments(spark, sf_dir))


@query("src_documents", "SELECT doc_id, lang, source, length(text) AS chars FROM documents")
def src_documents(spark, sf_dir):
    docs = readers.read_documents(spark, f"{sf_dir}/documents.parquet")
    return docs.select(
        "doc_id", "lang", "source", F.length("text").cast("bigint").alias("chars")
    )


# A control record per customer; some are no JSON, some have a wrong type.
_CONTROL = """CASE WHEN c_custkey % 11 = 0 THEN 'not json' ELSE '{"id":"r' || c_custkey || '","confidence":'
  || CASE WHEN c_custkey % 7 = 0 THEN '"x"' ELSE '0.5' END || '}' END"""


@query("src_control_json", """SELECT 'r' || c_custkey AS id, 0.5::DOUBLE AS confidence
FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0""")
def src_control_json(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").select(F.expr(_CONTROL).alias("value"))
    good, _ = readers.parse_control_json(lines, readers.RULE_SCHEMA)
    return good.select("id", "confidence")


@query("src_pages", "SELECT page_id, url, length(html) AS chars FROM pages")
def src_pages(spark, sf_dir):
    pages = readers.read_pages(spark, f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


@query("src_messages", f"""SELECT conv_id, turn, role, text FROM conversations
WHERE regexp_matches(text, '[^{WS_SET}]')""")
def src_messages(spark, sf_dir):
    return readers.read_messages(spark, f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text"
    )


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    docs = readers.read_documents(spark, f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", readers.content_hash(F.col("text")).alias("content_hash"))


_INTAKE = """SELECT o_orderkey AS seq, CAST(o_custkey AS VARCHAR) AS file_key,
  (o_orderkey * 7919) % 30000000 AS byte_length,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 25 END AS page_count FROM orders"""


@query("intake_admission", f"""
SELECT seq, file_key, CASE WHEN coalesce(max(ok) OVER (PARTITION BY file_key ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'duplicate_key'
    WHEN byte_length > 20971520 THEN 'too_large' WHEN page_count > 20 THEN 'too_many_pages' END AS refusal
FROM (SELECT *, CASE WHEN byte_length <= 20971520 AND coalesce(page_count, 0) <= 20 THEN 1 ELSE 0 END AS ok
      FROM ({_INTAKE}))""")
def intake_admission(spark, sf_dir):
    k = F.col("o_orderkey")
    jobs = table(spark, sf_dir, "orders").select(
        k.alias("seq"), F.col("o_custkey").cast("string").alias("file_key"),
        ((k * 7919) % 30000000).alias("byte_length"),
        F.when(k % 4 != 0, k % 25).alias("page_count"),
    )
    return readers.admit(jobs).select("seq", "file_key", "refusal")


@query("segment_trim", _segments_sql())
def segment_trim(spark, sf_dir):
    return sg.trim_segments(raw_segments(spark, sf_dir))


_SEG = f"seg AS MATERIALIZED ({_segments_sql()})"


@query("segment_budget", f"""WITH {_SEG}
SELECT doc_id, seq, before AS chars_before, truncated OR before + length(text) >= 1500 AS truncated FROM (
  SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM seg) WHERE before < 1500""")
def segment_budget(spark, sf_dir):
    return sg.apply_budget(segments(spark, sf_dir), 1500).select(
        "doc_id", "seq", "chars_before", "truncated"
    )


_SCAN = """SELECT doc_id, string_agg(text, chr(10) ORDER BY seq) AS combined FROM seg GROUP BY doc_id"""
_STARTS = """SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM seg"""


def scanned(spark, sf_dir):
    return sg.scan_text(sg.apply_budget(segments(spark, sf_dir)))


@query("scan_text", f"""WITH {_SEG}
SELECT a.doc_id, combined, starts FROM ({_SCAN}) a JOIN (
  SELECT doc_id, string_agg(CAST(s AS VARCHAR), ',' ORDER BY seq) AS starts FROM ({_STARTS}) GROUP BY doc_id) b
ON a.doc_id = b.doc_id""")
def scan_text(spark, sf_dir):
    return scanned(spark, sf_dir).select(
        "doc_id", "combined",
        F.array_join(F.transform("segment_starts", lambda s: s.cast("string")), ",").alias("starts"),
    )


_OFFSETS = "SELECT doc_id, unnest([-1, doc_id % 97, (doc_id * 31) % 3000, 5000]) AS pos FROM documents"


@query("segment_at_offset", f"""WITH {_SEG}, st AS MATERIALIZED ({_STARTS}), tot AS (
  SELECT doc_id, max(s + length(text)) AS n FROM st GROUP BY doc_id),
num AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS idx FROM st)
SELECT o.doc_id, o.pos, CASE WHEN o.pos < 0 OR o.pos >= any_value(tot.n) THEN -1 ELSE max(num.idx) END AS segment_index
FROM ({_OFFSETS}) o JOIN tot ON o.doc_id = tot.doc_id LEFT JOIN num ON num.doc_id = o.doc_id AND num.s <= o.pos
GROUP BY o.doc_id, o.pos""")
def segment_at_offset(spark, sf_dir):
    d = F.col("doc_id")
    wanted = table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.array(F.lit(-1).cast("bigint"), d % 97, (d * 31) % 3000,
                                    F.lit(5000).cast("bigint"))).alias("pos")
    ).distinct()
    starts = scanned(spark, sf_dir).select(
        "doc_id", "segment_starts", F.length("combined").alias("n")
    )
    at = sg.segment_at(F.col("segment_starts"), F.col("n"), F.col("pos"))
    return wanted.join(starts, "doc_id").select("doc_id", "pos", at.cast("bigint").alias("segment_index"))


# Ranges over the combined text: every 7th word pair boundary, some crossing lines.
_RANGES = """SELECT doc_id, CAST(i AS BIGINT) AS range_id, i * 211 AS start_pos, i * 211 + 90 AS end_pos
FROM (SELECT doc_id, unnest(range(0, length(text) // 211 + 1)) AS i FROM documents)"""
_MAPPED = f"""SELECT r.doc_id, r.range_id, st.node_id,
  st.start_offset + greatest(r.start_pos - s, 0) AS node_start,
  st.start_offset + least(r.end_pos - s, length(text)) AS node_end
FROM ({_RANGES}) r JOIN st ON r.doc_id = st.doc_id JOIN tot ON tot.doc_id = r.doc_id
WHERE r.start_pos < tot.n AND greatest(r.start_pos - s, 0) < least(r.end_pos - s, length(text))"""
_ST = f"WITH {_SEG}, st AS MATERIALIZED ({_STARTS}), tot AS (SELECT doc_id, max(s + length(text)) AS n FROM st GROUP BY doc_id)"


def ranges(spark, sf_dir):
    n = F.floor(F.length("text") / 211)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), n)).alias("range_id")
    ).withColumns({"start_pos": F.col("range_id") * 211, "end_pos": F.col("range_id") * 211 + 90})


@query("map_range", f"{_ST} {_MAPPED}")
def map_range(spark, sf_dir):
    return sg.map_range(scanned(spark, sf_dir), ranges(spark, sf_dir))


@query("redact_blocks", f"""{_ST}, mapped AS MATERIALIZED ({_MAPPED}),
chars AS (SELECT doc_id, seq, text, start_offset, unnest(range(0, length(text))) AS k FROM st),
hit AS (SELECT DISTINCT m.doc_id, m.node_id, unnest(range(node_start, node_end)) AS pos FROM mapped m),
painted AS (SELECT c.doc_id, c.seq, string_agg(CASE WHEN h.pos IS NULL THEN substr(c.text, c.k + 1, 1) ELSE '█' END, '' ORDER BY c.k) AS text
  FROM chars c LEFT JOIN hit h ON h.doc_id = c.doc_id AND h.node_id = 'seg_' || c.seq AND h.pos = c.start_offset + c.k
  GROUP BY c.doc_id, c.seq)
SELECT doc_id, string_agg(text, chr(10) ORDER BY seq) AS redacted FROM painted GROUP BY doc_id""")
def redact_blocks(spark, sf_dir):
    segs = sg.apply_budget(segments(spark, sf_dir))
    mapped = sg.map_range(sg.scan_text(segs), ranges(spark, sf_dir))
    return sg.scan_text(sg.redact_segments(segs, mapped)).select(
        "doc_id", F.col("combined").alias("redacted")
    )


@query("selection_span", f"""{_ST}
SELECT d.doc_id, start_pos, end_pos FROM (SELECT DISTINCT doc_id FROM st) d LEFT JOIN (
  SELECT doc_id, min(s + lo - start_offset) AS start_pos, max(s + hi - start_offset) AS end_pos FROM (
    SELECT *, greatest(start_offset, least(3, end_offset)) AS lo, greatest(start_offset, least(25 + seq, end_offset)) AS hi
    FROM st WHERE seq % 3 = 1 AND (doc_id + seq) % 4 <> 0) WHERE hi > lo GROUP BY doc_id) x ON d.doc_id = x.doc_id""")
def selection_span(spark, sf_dir):
    segs = segments(spark, sf_dir)
    picked = segs.select(
        "doc_id", "node_id", F.lit(3).cast("bigint").alias("from_offset"),
        (25 + F.col("seq")).alias("to_offset"),
        ((F.col("seq") % 3 == 1) & ((F.col("doc_id") + F.col("seq")) % 4 != 0)).alias("live"),
    )
    return sg.selection_span(segs, picked)


# Odd characters are put into the document texts by position-free replacement.
_ODD = "replace(replace(replace(text, ' de ', chr(160) || ' ' || chr(8203) || 'de '), '. ', '.' || chr(8204) || chr(65279) || '  '), 'qu', 'q' || chr(8205) || 'u')"


def odd_text():
    t = F.replace(F.col("text"), F.lit(" de "), F.lit("\u00a0 \u200bde "))
    t = F.replace(t, F.lit(". "), F.lit(".\u200c\ufeff  "))
    return F.replace(t, F.lit("qu"), F.lit("q\u200du"))


@query("unicode_normalize", rf"""
SELECT doc_id, n AS normalized, n <> t AS changed FROM (SELECT doc_id, t,
  regexp_replace(replace(regexp_replace(t, '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g'), chr(160), ' '), ' {{2,}}', ' ', 'g') AS n
  FROM (SELECT doc_id, {_ODD} AS t FROM documents))""")
def unicode_normalize(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", odd_text().alias("t"))
    normal = sg.normalize_unicode(F.col("t"))
    return docs.select("doc_id", normal.alias("normalized"), "t").select(
        "doc_id", "normalized", (F.col("normalized") != F.col("t")).alias("changed")
    )


@query("unicode_offset_map", rf"""
WITH ch AS MATERIALIZED (SELECT doc_id, i - 1 AS orig, CASE WHEN c = chr(160) THEN ' ' ELSE c END AS c FROM (
    SELECT doc_id, i, substr(t, i, 1) AS c FROM (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS i FROM (
      SELECT doc_id, substr({_ODD}, 1) AS t FROM documents)))
  WHERE NOT regexp_matches(c, '[\x{{200B}}-\x{{200D}}\x{{FEFF}}]')),
kept AS (SELECT doc_id, orig FROM (SELECT *, lag(c) OVER (PARTITION BY doc_id ORDER BY orig) AS p FROM ch)
  WHERE c <> ' ' OR p IS DISTINCT FROM ' ')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY orig) - 1 AS normalized_index, orig AS original_index FROM kept""")
def unicode_offset_map(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", odd_text().alias("t"))
    runs = docs.select("doc_id", F.explode_outer(sg.offset_runs(F.col("t"))).alias("r")).filter("r IS NOT NULL")
    return runs.select(
        "doc_id", (F.col("r.normal") - F.col("r.original")).alias("shift"),
        F.explode(F.sequence(F.col("r.original"), F.col("r.original") + F.col("r.length") - 1)).alias("i"),
    ).select(
        "doc_id", (F.col("i") + F.col("shift")).cast("bigint").alias("normalized_index"),
        F.col("i").cast("bigint").alias("original_index"),
    )


# Even documents are pages; the next one is in a frame of it, which one of three may not read,
# and every fourth page has a second frame from elsewhere.
_FRAMES = """SELECT doc_id, frame_order, accessible, row_number() OVER (PARTITION BY doc_id ORDER BY frame_order) - 1 AS n,
  CAST(coalesce(sum(CAST(accessible AS INT)) OVER (PARTITION BY doc_id ORDER BY frame_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS frame_no
FROM (SELECT doc_id, 0 AS frame_order, doc_id % 3 <> 0 AS accessible FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 1, false FROM documents WHERE doc_id % 4 = 0)"""


@query("frame_merge", f"""WITH {_SEG}, frames AS MATERIALIZED ({_FRAMES}),
allseg AS (SELECT doc_id, -1 AS frame, seq, text FROM seg WHERE doc_id % 2 = 0
  UNION ALL SELECT f.doc_id, f.frame_no, seq, text FROM seg s JOIN frames f ON s.doc_id = f.doc_id + 1 AND f.frame_order = 0 AND f.accessible),
placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY frame, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM allseg),
merged AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY frame, seq) AS combined, string_agg(CAST(CAST(s AS BIGINT) AS VARCHAR), ',' ORDER BY frame, seq) AS starts FROM placed GROUP BY doc_id),
edges AS (SELECT doc_id, string_agg(CASE WHEN accessible THEN 'iframe:complete' ELSE 'cross-origin-frame:inaccessible' END
  || ':iframe_boundary_' || n || ':frame_' || frame_no, ',' ORDER BY n) AS boundaries FROM frames GROUP BY doc_id)
SELECT m.doc_id, combined, starts, coalesce(boundaries, '') AS boundaries FROM merged m LEFT JOIN edges e ON m.doc_id = e.doc_id""")
def frame_merge(spark, sf_dir):
    d = F.col("doc_id")
    segs = segments(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id")
    found = docs.filter(d % 2 == 0).select("doc_id", F.lit(0).alias("frame_order"), (d % 3 != 0).alias("accessible")).unionByName(
        docs.filter(d % 4 == 0).select("doc_id", F.lit(1).alias("frame_order"), F.lit(False).alias("accessible"))
    )
    edges = sg.frame_boundaries(found)
    readable = edges.filter("accessible AND frame_order = 0").select("doc_id", "frame_no")
    frames = segs.filter(d % 2 == 1).withColumn("doc_id", d - 1).join(readable, "doc_id")
    merged = sg.scan_text(sg.assemble_frames(segs.filter(d % 2 == 0), frames))
    listed = edges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "boundary"))).alias("b")).select(
        "doc_id", F.array_join(F.transform("b", lambda x: F.concat_ws(
            ":", *[x["boundary"][f] for f in ("kind", "status", "node_id", "frame_id")])), ",").alias("boundaries"))
    return merged.join(listed, "doc_id", "left").select(
        "doc_id", "combined", F.array_join(F.transform("segment_starts", lambda x: x.cast("string")), ",").alias("starts"),
        F.coalesce("boundaries", F.lit("")).alias("boundaries"),
    )
