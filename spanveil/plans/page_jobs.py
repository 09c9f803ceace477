"""Queries: HTML walk, inventory, media, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanveil.functions.text import WS_SET
from spanveil.operators import pages as pg
from spanveil.operators import scan
from spanveil.operators import segments as sg
from spanveil.plans.registry import query, table
from spanveil.plans.sql_text import q

# The given pages have no forms, tables or media, so one block that depends on the
# page id is put at the head of every body.
P = "CAST(page_id AS STRING)"
_BLOCK = (
    "'<div id=\"top\" aria-label=\" call  (743) 555-38' || substr(" + P + " || '00', 1, 2) || '\" title=\"t\">"
    "<img src=\"https://cdn.example.com/i' || " + P + " || '.png\" width=\"' || CAST(20 + page_id % 300 AS STRING)"
    " || '\" height=\"200\" alt=\"photo of bob' || " + P + " || '@example.org\">"
    "<iframe src=\"https://ads.example.net/x\"></iframe><svg width=\"100\" height=\"40\"><text>jo' || " + P +
    " || '@ex.org</text><text>jo' || " + P + " || '@ex.org</text><title>chart</title></svg>"
    "<table><tr><th>Name</th><th>SSN</th></tr><tr><th>Row</th><td>219-09-9999</td></tr></table>"
    "<form><input type=\"text\" value=\" v' || " + P + " || ' \"><input type=\"password\" value=\"secret\">"
    "<textarea name=\"n\">note ' || " + P + " || '</textarea><input autocomplete=\"cc-number\" value=\"4111\"></form>"
    "<p hidden>gone</p><div data-sensitive-scan-ignore title=\"no\">ignored</div>"
    "<embed type=\"application/pdf\" src=\"a.pdf\"><canvas></canvas><video src=\"v.mp4\"></video></div>'"
)
HTML = f"replace(html, '<body>', '<body>' || {_BLOCK})"


def rich_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.expr(HTML).alias("html"))


def walked(spark, sf_dir):
    return pg.elements(rich_pages(spark, sf_dir))


def page_segment_rows(spark, sf_dir):
    nodes = pg.text_nodes(walked(spark, sf_dir))
    trimmed = sg.trim_segments(nodes.select("doc_id", "seq", "raw", "is_input"))
    return sg.apply_budget(trimmed)


@query("page_segments")
def page_segments(spark, sf_dir):
    return page_segment_rows(spark, sf_dir).withColumnRenamed("doc_id", "page_id")


@query("page_attributes")
def page_attributes(spark, sf_dir):
    rows = sg.apply_budget(pg.attributes(walked(spark, sf_dir)))
    return rows.withColumnRenamed("doc_id", "page_id")


@query("attribute_at_offset")
def attribute_at_offset(spark, sf_dir):
    found = pg.attribute_scan(sg.apply_budget(pg.attributes(walked(spark, sf_dir))))
    probes = found.withColumn("pos", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(25), F.lit(60), F.lit(9999))))
    return probes.select(
        F.col("doc_id").alias("page_id"), "pos", pg.attribute_at(probes, F.col("pos")).alias("attribute")
    )


@query("page_svg_text")
def page_svg_text(spark, sf_dir):
    return pg.svg_text(walked(spark, sf_dir))


@query("page_table_cells")
def page_table_cells(spark, sf_dir):
    return pg.table_cells(walked(spark, sf_dir))


@query("segment_table_role")
def segment_table_role(spark, sf_dir):
    els = walked(spark, sf_dir)
    nodes = pg.text_nodes(els).filter(F.trim("raw") != "")
    return pg.segment_table_role(nodes, pg.table_cells(els))


@query("element_path")
def element_path(spark, sf_dir):
    return pg.element_paths(walked(spark, sf_dir))


@query("page_visibility")
def page_visibility(spark, sf_dir):
    return pg.visibility(walked(spark, sf_dir))


@query("unscannable_regions")
def unscannable_regions(spark, sf_dir):
    return pg.unscannable(walked(spark, sf_dir), table(spark, sf_dir, "pages"))


def _tags(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(h, {q('<(?:' + pattern + ')' + chr(92) + 'b')})) AS BIGINT)"


@query("page_inventory", f"""
SELECT page_id, {_tags('input|textarea|select')} AS form_controls,
  CAST(CASE WHEN page_id % 300 >= 4 THEN 1 ELSE 0 END AS BIGINT) AS images, CAST(0 AS BIGINT) AS data_images,
  {_tags('svg')} AS inline_svgs, {_tags('canvas')} AS canvases, {_tags('video')} AS videos,
  {_tags('audio')} AS audios, {_tags('embed|object')} AS embedded_pdfs, CAST(0 AS BIGINT) AS same_host_frames,
  {_tags('iframe|frame')} AS cross_host_frames, {_tags('table')} AS tables, {_tags('a')} AS links,
  {_tags('li')} AS list_items
FROM (SELECT page_id, {HTML} AS h FROM pages)""")
def page_inventory(spark, sf_dir):
    return pg.inventory(walked(spark, sf_dir), table(spark, sf_dir, "pages"))


_CELLS = """SELECT l_orderkey AS doc_id, l_linenumber AS n, l_orderkey % 4 AS table_no,
  CAST(l_linenumber - 1 AS BIGINT) AS r, l_partkey % 6 AS c,
  CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_returnflag = 'N' THEN 'cell' WHEN l_linenumber = 1 THEN 'header' ELSE 'row-header' END AS role
FROM lineitem"""


@query("table_context_label", f"""
SELECT doc_id, n, CASE WHEN role IS NOT NULL THEN 'Table table_' || table_no || ', ' || replace(role, '-', ' ')
  || ', row ' || (r + 1) || ', col ' || (c + 1) END AS label FROM ({_CELLS})""")
def table_context_label(spark, sf_dir):
    c = F.col
    role = (
        F.when(c("l_returnflag") == "A", None).when(c("l_returnflag") == "N", "cell")
        .when(c("l_linenumber") == 1, "header").otherwise("row-header")
    )
    label = pg.table_context(
        c("l_orderkey") % 4, role, (c("l_linenumber") - 1).cast("bigint"), c("l_partkey") % 6
    )
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("n"), label.alias("label")
    )


_CUES = """SELECT conv_id, turn, '<v Bob><c.x> ' || text || '</c>' || chr(10) AS text FROM conversations"""


@query("caption_text", f"""
SELECT conv_id, turn, t AS text FROM (SELECT conv_id, turn,
  trim(regexp_replace(regexp_replace(text, '<[^>]*>', '', 'g'), {q(f'[{WS_SET}]+')}, ' ', 'g')) AS t FROM ({_CUES}))
WHERE t <> ''""")
def caption_text(spark, sf_dir):
    cues = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("<v Bob><c.x> "), "text", F.lit("</c>\n")).alias("text")
    )
    return pg.caption_text(cues)


# Lineitem rows stand for media elements of a page (the order's month of customer).
_MEDIA = """SELECT l_suppkey AS page_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq,
  CASE l_linenumber % 3 WHEN 0 THEN 'img' WHEN 1 THEN 'canvas' ELSE 'video' END AS tag,
  'https://cdn' || (l_partkey % 3) || '.example.com/i' || (l_partkey % 40) || '.png' AS url,
  CAST(l_quantity AS INT) * 12 AS width, CAST(l_quantity AS INT) * 10 AS height,
  l_returnflag <> 'R' AS visible, l_partkey % 4 = 0 AS in_viewport FROM lineitem"""


def media(spark, sf_dir):
    c = F.col
    n, p = c("l_linenumber"), c("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("page_id"), ((c("l_orderkey") * 10 + n) * 1000000 + p).alias("seq"),
        F.when(n % 3 == 0, "img").when(n % 3 == 1, "canvas").otherwise("video").alias("tag"),
        F.concat(F.lit("https://cdn"), p % 3, F.lit(".example.com/i"), p % 40, F.lit(".png")).alias("url"),
        (c("l_quantity").cast("int") * 12).alias("width"), (c("l_quantity").cast("int") * 10).alias("height"),
        (c("l_returnflag") != "R").alias("visible"), (p % 4 == 0).alias("in_viewport"),
    )


_UNIQUE = f"""SELECT page_id, min(seq) AS seq, any_value(tag) AS tag, arg_min(url, seq) AS url, arg_min(in_viewport, seq) AS in_viewport
FROM ({_MEDIA}) WHERE visible AND ((tag = 'video' AND width >= 40 AND height >= 30) OR (tag <> 'video' AND width >= 24 AND height >= 14))
GROUP BY page_id, CASE WHEN tag = 'img' THEN 'u' || url ELSE 's' || seq END"""


@query("media_queue", f"""
SELECT u.page_id, seq, tag, url, position, deferred FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY in_viewport DESC, seq) AS position FROM ({_UNIQUE})) u
JOIN (SELECT page_id, greatest(count(*) - 8, 0) AS deferred FROM ({_UNIQUE}) GROUP BY page_id) d ON u.page_id = d.page_id
WHERE position <= 8""")
def media_queue(spark, sf_dir):
    queued, counts = pg.media_queue(media(spark, sf_dir))
    return queued.join(counts, "page_id").select(
        "page_id", "seq", "tag", "url", F.col("position").cast("bigint").alias("position"), "deferred"
    )


@query("pdf_queue", r"""
SELECT page_id, CASE WHEN length(folder) > length(origin) THEN folder ELSE origin || '/' END || 'a.pdf' AS pdf_url FROM (
  SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS origin,
    regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)', 1) AS folder FROM pages)""")
def pdf_queue(spark, sf_dir):
    pages = rich_pages(spark, sf_dir)
    return pg.pdf_queue(pg.elements(pages), pages).select("page_id", "pdf_url")


@query("image_candidates", f"""
SELECT page_id, seq, url AS src, width, height, url LIKE 'https://cdn0.%' AS same_origin FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY width * height DESC, seq) AS place
  FROM ({_MEDIA}) WHERE width * height >= 40000) WHERE place <= 12""")
def image_candidates(spark, sf_dir):
    images = media(spark, sf_dir).withColumnRenamed("url", "src").withColumn(
        "url", F.lit("https://cdn0.example.com/page")
    )
    return pg.image_candidates(images).select("page_id", "seq", "src", "width", "height", "same_origin")


_BOUNDS = """SELECT l_orderkey AS doc_id, CASE l_linenumber % 4 WHEN 0 THEN 'iframe' WHEN 1 THEN 'shadow-root'
  WHEN 2 THEN 'cross-origin-frame' ELSE 'closed-shadow-root' END AS kind,
  CASE WHEN l_returnflag = 'R' THEN 'inaccessible' ELSE 'complete' END AS status FROM lineitem"""
_COVERAGE = f"""SELECT doc_id, 'complete' AS dom,
  CASE WHEN bool_or(kind IN ('shadow-root', 'closed-shadow-root')) AND count_if(status = 'inaccessible') > 0 THEN 'partial' ELSE 'complete' END AS shadow_dom,
  'complete' AS same_origin_frames,
  CASE WHEN bool_or(kind = 'cross-origin-frame') AND count_if(status = 'inaccessible') > 0 THEN 'inaccessible' ELSE 'complete' END AS cross_origin_frames,
  count(*) AS total_boundaries, CAST(count_if(status = 'inaccessible') AS BIGINT) AS inaccessible_boundaries,
  count_if(status = 'inaccessible') = 0 AND doc_id % 11 <> 0 AS complete
FROM ({_BOUNDS}) GROUP BY doc_id"""


def coverage(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    kind = F.when(n == 0, "iframe").when(n == 1, "shadow-root").when(n == 2, "cross-origin-frame").otherwise("closed-shadow-root")
    bounds = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), kind.alias("kind"),
        F.when(F.col("l_returnflag") == "R", "inaccessible").otherwise("complete").alias("status"),
    )
    cut = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 11 == 0).alias("truncated")
    )
    return pg.coverage_update(bounds, cut)


@query("coverage_update", _COVERAGE)
def coverage_update(spark, sf_dir):
    return coverage(spark, sf_dir)


@query("coverage_summary", f"""
SELECT doc_id, concat_ws(', ', 'DOM: ' || dom, CASE WHEN shadow_dom <> 'complete' THEN 'Shadow DOM: ' || shadow_dom END,
  CASE WHEN same_origin_frames <> 'complete' THEN 'Frames: ' || same_origin_frames END,
  CASE WHEN cross_origin_frames <> 'complete' THEN 'Cross-origin: ' || cross_origin_frames END,
  CASE WHEN inaccessible_boundaries > 0 THEN inaccessible_boundaries || ' inaccessible boundary(ies)' END) AS summary
FROM ({_COVERAGE})""")
def coverage_summary(spark, sf_dir):
    return coverage(spark, sf_dir).select("doc_id", pg.coverage_summary().alias("summary"))


_REASON = """CASE l_partkey % 5 WHEN 0 THEN 'drm-protected-media' WHEN 1 THEN 'cross-origin-isolation'
  WHEN 2 THEN 'ocr-budget-exceeded' WHEN 3 THEN 'scan-error' ELSE 'tainted-canvas-no-tab-capture' END"""


@query("coverage_status", f"""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 17 = 0 THEN 'SCAN_FAILED'
  WHEN coalesce(d, 0) > 0 THEN 'UNSUPPORTED_CONTENT_PRESENT' WHEN coalesce(b, 0) > 0 THEN 'BLOCKED_BY_BROWSER_SECURITY'
  WHEN o_orderkey % 3 = 0 OR coalesce(u, 0) > 0 THEN 'PARTIALLY_SCANNED'
  WHEN coalesce(f, 0) = 0 THEN 'NO_SENSITIVE_DATA_DETECTED' ELSE 'FULLY_SCANNED' END AS coverage_status
FROM orders LEFT JOIN (
  SELECT l_orderkey, count_if(l_returnflag = 'R' AND r = 'drm-protected-media') AS d,
    count_if(l_returnflag = 'R' AND r IN ('cross-origin-isolation', 'tainted-canvas-no-tab-capture')) AS b,
    count_if(l_returnflag = 'R') AS u, count_if(l_returnflag = 'A') AS f
  FROM (SELECT *, {_REASON} AS r FROM lineitem) GROUP BY l_orderkey) x ON l_orderkey = o_orderkey""")
def coverage_status(spark, sf_dir):
    k = F.col("o_orderkey")
    scans = table(spark, sf_dir, "orders").select(
        k.alias("doc_id"), F.when(k % 3 == 0, 1).otherwise(0).alias("deferred"), (k % 17 == 0).alias("had_error")
    )
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    unresolved = items.filter("l_returnflag = 'R'").select("doc_id", F.expr(_REASON).alias("reason"))
    return pg.coverage_status(scans, items.filter("l_returnflag = 'A'").select("doc_id"), unresolved)


@query("scan_page_findings")
def scan_page_findings(spark, sf_dir):
    """Page scan end to end: walk, segments, combined text, findings."""
    texts = sg.scan_text(page_segment_rows(spark, sf_dir))
    scanned = scan.scan_documents(texts, "combined")
    return scan.build_findings(scanned, ["doc_id"], "combined")
