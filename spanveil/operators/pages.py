"""HTML pages: one walk into an element table, everything after it in columns.

The walk is the only Python in the library's data path.  It turns each page into
rows with inherited flags and the number of their parent; what follows from those rows
(paths, visibility, budgets, tables, inventory) is column expressions.  Stored HTML has
no layout, so visibility and sizes come from static markup only.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.constants import MAX_IMAGE_CANDIDATES, MAX_MEDIA_PER_PAGE
from spanveil.functions.text import WS_SET, let
from spanveil.session import spread

# Markup that hides or excludes a subtree.
EXCLUDED_TAGS = {
    "script", "style", "noscript", "template", "svg", "canvas", "meter", "progress",
    "object", "embed", "iframe",
}
EXCLUDED_AUTOCOMPLETE = {
    "cc-number", "cc-exp", "cc-exp-month", "cc-exp-year", "cc-csc", "cc-name", "cc-type",
    "one-time-code",
}
IGNORE_ATTRIBUTE = "data-sensitive-scan-ignore"
SCANNED_ATTRIBUTES = ["aria-label", "alt", "placeholder", "title"]
TEXT_INPUTS = {"text", "search", "email", "tel", "url"}
VOID_TAGS = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
    "track", "wbr",
}
# An opening tag on the left ends an open element on the right.
IMPLIED_END = {
    "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "p": {"p"}, "div": {"p"}, "ul": {"p"}, "ol": {"p"}, "table": {"p"},
    "article": {"p"}, "section": {"p"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"},
}
SVG_TEXT = {"text", "tspan", "title", "desc"}

ELEMENTS = (
    "page_id long, seq long, kind string, tag string, owner long, parent long, text string, "
    "attrs map<string,string>, in_body boolean, excluded boolean, hidden boolean, "
    "ignored boolean, in_svg boolean, small_svg boolean, table_no long, table_row long, "
    "table_col long"
)


_BLANKS, _SIZE = re.compile(r"\s"), re.compile(r"[0-9.]+")
_UNSEEN = re.compile(r"display:none|visibility:(?:hidden|collapse)|opacity:0(?:\.0*)?(?:;|$)")


class _Node:
    __slots__ = ("tag", "attrs", "parent", "number", "flags", "cell", "rows", "cols")

    def __init__(self, tag, attrs, parent, number):
        self.tag, self.attrs, self.parent, self.number = tag, attrs, parent, number
        self.flags, self.cell, self.rows, self.cols = {}, None, 0, 0


class _Walk(HTMLParser):
    """Collects (node, kind, text) in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {}, None, -1)
        self.open, self.events, self.tables, self.elements = [self.root], [], 0, 0

    def _flags(self, node):
        up, a = node.parent.flags, node.attrs
        gone = "hidden" in a or "inert" in a or a.get("aria-hidden") == "true"
        unseen = "style" in a and _UNSEEN.search(_BLANKS.sub("", a["style"].lower()))
        auto = a["autocomplete"].split()[:1] if "autocomplete" in a else up.get("auto", [])
        small = node.tag == "svg" and (self._below(a.get("width"), 24) or self._below(a.get("height"), 14))
        ignored = up.get("ignored", False) or IGNORE_ATTRIBUTE in a
        hidden = (up.get("hidden", False) or gone or bool(unseen)
                  or node.tag in {"template", "script", "style", "noscript"})
        return {
            "auto": auto, "ignored": ignored, "hidden": hidden,
            "body": up.get("body", False) or node.tag == "body",
            "excluded": up.get("excluded", False) or ignored or gone or bool(unseen)
            or node.tag in EXCLUDED_TAGS or a.get("type", "").lower() == "password"
            or bool(auto and auto[0].lower() in EXCLUDED_AUTOCOMPLETE),
            "svg": up.get("svg", False) or node.tag == "svg",
            "small": up.get("small", False) or small,
        }

    @staticmethod
    def _below(given, least):
        m = _SIZE.match(given or "")
        return m is not None and float(m.group()) < least

    def _table(self):
        return next((n for n in reversed(self.open) if n.tag == "table"), None)

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and self.open[-1].tag in IMPLIED_END.get(tag, ()):
            self.open.pop()
        parent = self.open[-1]
        node = _Node(tag, {k: v or "" for k, v in attrs}, parent, self.elements)
        self.elements += 1
        node.flags, node.cell = self._flags(node), parent.cell
        if tag == "table":
            node.cell, self.tables = (self.tables, -1, -1), self.tables + 1
        elif tag in ("tr", "td", "th") and (table := self._table()) is not None:
            number = table.cell[0]
            if tag == "tr":
                table.rows, table.cols = table.rows + 1, 0
            else:
                node.cell = (number, table.rows - 1, table.cols)
                table.cols += 1
        self.events.append((node, "element", None))
        if tag == "input" and node.attrs.get("type", "text").lower() in TEXT_INPUTS:
            self.events.append((node, "input", node.attrs.get("value", "")))
        if tag not in VOID_TAGS:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        node = self.open[-1]
        self.events.append((node, "input" if node.tag == "textarea" else "text", data))


def _walk_page(page_id: int, html: str) -> Iterator[tuple]:
    """Rows of a page in the order of ``ELEMENTS``."""
    walk = _Walk()
    walk.feed(html or "")
    walk.close()
    for seq, (node, kind, text) in enumerate(walk.events):
        if node.tag == "#root":
            continue
        f = node.flags
        yield (
            page_id, seq, kind, node.tag, node.number, node.parent.number, text,
            list(node.attrs.items()) if kind == "element" else None,
            f["body"], f["excluded"], f["hidden"], f["ignored"], f["svg"], f["small"], *(node.cell or (None, None, None)),
        )


# Workers may not have the package installed; ship this module with the function.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "map": pa.map_(pa.string(), pa.string())}
_SCHEMA = pa.schema([
    (name, _KINDS[kind]) for name, kind in (c.split() for c in re.sub(r"<[^>]*>", "", ELEMENTS).split(","))
])
#: Rows handed over at a time, of however many pages.
_ROWS = 8_192


def elements(pages: DataFrame) -> DataFrame:
    """Element, text and input rows of every page, in document order.

    ``owner`` is the number of the element a row is or lies in, ``parent`` that of the
    element around it (-1: none).
    """

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(column, f.type) for column, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for page_id, html in zip(batch.column("page_id"), batch.column("html")):
                for row in _walk_page(page_id.as_py(), html.as_py()):
                    rows.append(row)
                    if len(rows) == _ROWS:
                        yield pack(rows)
                        rows = []
        if rows:
            yield pack(rows)

    return spread(pages.select("page_id", "html")).mapInArrow(run, ELEMENTS)


#: Levels of a path at most.
PATH_LEVELS = 5


def with_paths(els: DataFrame, wanted: Column, *columns: str) -> DataFrame:
    """(page_id, columns, path) of the rows of ``els`` for which ``wanted`` holds.

    ``path`` is a short selector of the owning element.  Elements of one tag below one
    parent are numbered by a window; a page's elements, as its markup, are one row then, in
    which each path follows the parents: up to an element with an id, ``PATH_LEVELS``
    levels or the root.  The markup is walked once.
    """
    attr = lambda n: F.coalesce(F.try_element_at("attrs", F.lit(n)), F.lit(""))
    element = F.col("kind") == "element"
    twins = Window.partitionBy("page_id", "parent", "tag")
    one = element.cast("int")
    nth = F.sum(one).over(twins.orderBy("owner", "seq").rowsBetween(Window.unboundedPreceding, 0))
    classes = F.slice(F.filter(F.split(attr("class"), f"[{WS_SET}]+"), lambda c: c != ""), 1, 2)
    named = F.when(attr("name") != "", F.concat(F.lit('[name="'), attr("name"), F.lit('"]'))).otherwise(
        F.array_join(F.transform(classes, lambda c: F.concat(F.lit("."), c)), "")
    )
    among = F.when(F.sum(one).over(twins) > 1, F.concat(F.lit(":nth-of-type("), nth, F.lit(")"))).otherwise("")
    part = F.when(attr("id") != "", F.concat("tag", F.lit("#"), attr("id"))).otherwise(F.concat("tag", named, among))
    node = F.struct(
        "owner", "parent", F.when(F.col("tag") != "html", part).alias("part"), (attr("id") != "").alias("last")
    )
    rows = els.select("page_id", F.when(element, node).alias("node"), F.when(wanted, F.struct("owner", *columns)).alias("row"))
    pages = rows.groupBy("page_id").agg(
        F.sort_array(F.collect_list("node")).alias("nodes"), F.collect_list("row").alias("rows")
    )

    def climb(x: Column) -> Column:
        start = F.struct(x["owner"].alias("at"), F.lit("").alias("path"))

        def step(state: Column, _: Column) -> Column:
            def add(e: Column) -> Column:
                longer = F.when(state["path"] == "", e["part"]).otherwise(F.concat(e["part"], F.lit(" > "), state["path"]))
                end = F.lit(-1).cast("long")
                return F.when(e["part"].isNull(), F.struct(end.alias("at"), state["path"].alias("path"))).otherwise(
                    F.struct(F.when(e["last"], end).otherwise(e["parent"]).alias("at"), longer.alias("path"))
                )

            return F.when(state["at"] < 0, state).otherwise(let(F.get("nodes", state["at"].cast("int")), add))

        levels = F.array(*map(F.lit, range(PATH_LEVELS)))
        return F.struct(*[x[c].alias(c) for c in columns], F.aggregate(levels, start, step)["path"].alias("path"))

    found = pages.select("page_id", F.explode_outer(F.transform("rows", climb)).alias("x")).filter("x IS NOT NULL")
    return found.select("page_id", "x.*")


def text_nodes(els: DataFrame) -> DataFrame:
    """Visible text nodes and input values of the body, ready for trimming."""
    return els.filter(F.col("kind").isin("text", "input") & F.col("in_body") & ~F.col("excluded")).select(
        F.col("page_id").alias("doc_id"), "seq", F.col("text").alias("raw"),
        (F.col("kind") == "input").alias("is_input"), "table_no", "table_row", "table_col",
    )


def collapse(text: Column) -> Column:
    one = F.regexp_replace(text, rf"[{WS_SET}\x{{200B}}]+", " ")
    return F.regexp_replace(one, "^ | $", "")


def attributes(els: DataFrame, cap: int | None = None) -> DataFrame:
    """Scanned attribute values; report-only, so they carry no node offsets."""
    names = [F.lit(n) for n in SCANNED_ATTRIBUTES]
    listed = F.transform(
        F.array(*names),
        lambda n, i: F.struct(i.alias("i"), n.alias("name"), F.try_element_at("attrs", n).alias("v")),
    )
    raw = (
        els.filter((F.col("kind") == "element") & ~F.col("ignored"))
        .select("page_id", "seq", F.explode(F.filter(listed, lambda x: x["v"].isNotNull())).alias("a"))
    )
    value = collapse(F.col("a.v"))
    return raw.select(
        F.col("page_id").alias("doc_id"),
        (F.col("seq") * len(SCANNED_ATTRIBUTES) + F.col("a.i")).alias("seq"),
        F.col("a.name").alias("attribute"),
        (value if cap is None else F.substring(value, 1, cap)).alias("text"),
        (F.lit(False) if cap is None else F.length(value) > cap).alias("truncated"),
    ).filter("text <> ''")


def attribute_scan(attrs: DataFrame) -> DataFrame:
    """Combined attribute text of a page with the name that owns each segment."""
    from spanveil.operators.segments import scan_text

    named = attrs.withColumn("node_id", F.col("attribute")).withColumn(
        "start_offset", F.lit(0).cast("bigint")
    )
    return scan_text(named).withColumnRenamed("node_ids", "attributes")


def attribute_at(scan: DataFrame, offset: Column) -> Column:
    """Attribute owning a combined offset, empty outside."""
    from spanveil.operators.segments import segment_at

    index = segment_at(F.col("segment_starts"), F.length("combined"), offset)
    return F.when(index < 0, "").otherwise(F.get(F.col("attributes"), index))


def svg_text(els: DataFrame) -> DataFrame:
    """Readable text inside inline SVG, one row per (path, text)."""
    wanted = (
        (F.col("kind") == "text") & F.col("in_svg") & ~F.col("small_svg")
        & F.col("tag").isin(sorted(SVG_TEXT))
    )
    named = with_paths(els, wanted, "tag", "text").withColumn("text", collapse(F.col("text")))
    return named.filter("text <> ''").select("page_id", "path", "tag", "text").dropDuplicates(["page_id", "path", "text"])


def table_cells(els: DataFrame) -> DataFrame:
    """Role and position of every table cell."""
    role = F.when(F.col("tag") == "td", "cell").when(F.col("table_row") == 0, "header").otherwise("row-header")
    return els.filter((F.col("kind") == "element") & F.col("tag").isin("td", "th")).filter(
        F.col("table_no").isNotNull()
    ).select("page_id", "table_no", "table_row", "table_col", role.alias("role"))


def table_shapes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("page_id", "table_no").agg(
        (F.max("table_row") + 1).alias("rows"), (F.max("table_col") + 1).alias("cols")
    )


def segment_table_role(segments: DataFrame, cells: DataFrame) -> DataFrame:
    """Attach role and context label to segments by exact cell key."""
    keyed = cells.withColumnRenamed("page_id", "doc_id")
    key = ["doc_id", "table_no", "table_row", "table_col"]
    return segments.join(keyed, key, "left").withColumn(
        "table_context", table_context(F.col("table_no"), F.col("role"), F.col("table_row"), F.col("table_col"))
    )


def table_context(table_no: Column, role: Column, row: Column, col: Column) -> Column:
    """``Table table_0, header, row 1, col 2``; null without a role."""
    text = F.format_string(
        "Table table_%d, %s, row %d, col %d", table_no, F.replace(role, F.lit("-"), F.lit(" ")), row + 1, col + 1
    )
    return F.when(role.isNotNull(), text)


def number(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def _attr(name: str) -> Column:
    return F.try_element_at(F.col("attrs"), F.lit(name))


def visibility(els: DataFrame) -> DataFrame:
    """Static visibility of elements; attribute text is metadata by nature."""
    zero = (number(_attr("width")) == 0) | (number(_attr("height")) == 0)
    state = (
        F.when(F.col("hidden") | F.coalesce(zero, F.lit(False)), "HIDDEN_COLLAPSED_UI")
        .when(~F.col("in_body"), "HIDDEN_METADATA")
        .otherwise("UNVERIFIED_VISIBILITY")
    )
    rows = with_paths(els.withColumn("visibility", state), F.col("kind") == "element", "seq", "tag", "visibility")
    return rows.select("page_id", "seq", "tag", "path", "visibility")


def element_paths(els: DataFrame) -> DataFrame:
    """Selector of every element."""
    return with_paths(els, F.col("kind") == "element", "seq", "tag")


def _pdf() -> Column:
    source = F.coalesce(_attr("src"), _attr("data"), F.lit(""))
    return F.coalesce(F.lower(_attr("type")).contains("pdf"), F.lit(False)) | source.rlike(r"(?i)\.pdf($|\?|#)")


def inventory(els: DataFrame, pages: DataFrame) -> DataFrame:
    """Element counts per page; pages without elements keep zero rows."""
    tag = F.col("tag")
    big = (F.coalesce(number(_attr("width")), F.lit(1e9)) >= 24) & (
        F.coalesce(number(_attr("height")), F.lit(1e9)) >= 14
    )
    src = F.coalesce(_attr("src"), F.lit(""))
    host = F.expr("try_parse_url(attrs['src'], 'HOST')")
    own = F.expr("try_parse_url(url, 'HOST')")
    cross = host.isNotNull() & (host != F.coalesce(own, F.lit("")))
    counted = {
        "form_controls": tag.isin("input", "textarea", "select"),
        "images": (tag == "img") & big,
        "data_images": (tag == "img") & big & src.rlike("^(?:data|blob):"),
        "inline_svgs": (tag == "svg") & big,
        "canvases": (tag == "canvas") & big,
        "videos": tag == "video",
        "audios": tag == "audio",
        "embedded_pdfs": tag.isin("embed", "object") & _pdf(),
        "same_host_frames": tag.isin("iframe", "frame") & ~cross,
        "cross_host_frames": tag.isin("iframe", "frame") & cross,
        "tables": tag == "table",
        "links": tag == "a",
        "list_items": tag == "li",
    }
    rows = els.filter("kind = 'element'").join(pages.select("page_id", "url"), "page_id")
    return rows.groupBy("page_id").agg(
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in counted.items()]
    )


def unscannable(els: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions whose content stored markup cannot show, with the reason."""
    host = F.expr("try_parse_url(attrs['src'], 'HOST')")
    own = F.expr("try_parse_url(url, 'HOST')")
    tag = F.col("tag")
    reason = (
        F.when(tag.isin("iframe", "frame") & host.isNotNull() & (host != F.coalesce(own, F.lit(""))),
               "cross-origin-isolation")
        .when(tag.isin("embed", "object") & _pdf(), "pdf-viewer-plugin-isolated")
        .when(tag == "canvas", "tainted-canvas-no-tab-capture")
        .when(tag.isin("video", "audio"), "ocr-budget-exceeded")
    )
    kinds = ["iframe", "frame", "embed", "object", "canvas", "video", "audio"]
    rows = with_paths(els, (F.col("kind") == "element") & tag.isin(kinds), "tag", "attrs")
    return rows.join(pages.select("page_id", "url"), "page_id").withColumn("reason", reason).filter("reason IS NOT NULL").select(
        "page_id", "tag", "path", F.coalesce(_attr("src"), _attr("data")).alias("resource_url"), "reason"
    )


# ---- candidate tables ----------------------------------------------------------
def media_queue(candidates: DataFrame, keep: int = MAX_MEDIA_PER_PAGE) -> tuple[DataFrame, DataFrame]:
    """(queued media, per-page counts with the deferred rest).

    Input: page_id, seq, tag, url, width, height, visible, in_viewport.  Hidden
    and tiny media are skipped, an image URL counts once per page.
    """
    tag = F.col("tag")
    large = (
        F.when(tag == "video", (F.col("width") >= 40) & (F.col("height") >= 30))
        .otherwise((F.col("width") >= 24) & (F.col("height") >= 14))
    )
    usable = candidates.filter("visible").filter(large & ((tag != "img") | (F.coalesce("url", F.lit("")) != "")))
    once = F.when(tag == "img", F.concat(F.lit("u"), "url")).otherwise(F.concat(F.lit("s"), "seq"))
    unique = usable.groupBy("page_id", once.alias("_k")).agg(
        F.min_by(F.struct("seq", "tag", "url", "in_viewport"), "seq").alias("m")
    ).select("page_id", "m.*")
    first = Window.partitionBy("page_id").orderBy(F.col("in_viewport").desc(), "seq")
    queued = unique.withColumn("position", F.row_number().over(first)).filter(f"position <= {keep}")
    counts = unique.groupBy("page_id").agg(
        F.greatest(F.count("*") - keep, F.lit(0)).cast("bigint").alias("deferred")
    )
    return queued, counts


def pdf_queue(els: DataFrame, pages: DataFrame) -> DataFrame:
    """Embedded PDFs, one row per page and resolved URL, in document order."""
    raw = F.coalesce(_attr("src"), _attr("data"), F.lit(""))
    wanted = (
        (F.col("kind") == "element") & ~F.col("hidden") & F.col("tag").isin("embed", "object", "iframe") & _pdf() & (raw != "")
    )
    rows = with_paths(els, wanted, "seq", "attrs").join(pages.select("page_id", "url"), "page_id")
    origin = F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    # A base without a path has no slash after its host; its folder is the root.
    base = F.when(F.length(folder) > F.length(origin), folder).otherwise(F.concat(origin, F.lit("/")))
    resolved = (
        F.when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), raw)
        .when(raw.startswith("//"), F.concat(scheme, raw))
        .when(raw.startswith("/"), F.concat(origin, raw))
        .otherwise(F.concat(base, raw))
    )
    return rows.select("page_id", "seq", "path", resolved.alias("pdf_url")).groupBy(
        "page_id", "pdf_url"
    ).agg(F.min("seq").alias("seq"), F.min_by("path", "seq").alias("path"))


def image_candidates(images: DataFrame, keep: int = MAX_IMAGE_CANDIDATES) -> DataFrame:
    """Largest images per page with enough pixels to hold text."""
    pixels = F.col("width") * F.col("height")
    origin = [F.expr(f"concat(try_parse_url({c}, 'PROTOCOL'), '://', try_parse_url({c}, 'AUTHORITY'))")
              for c in ("src", "url")]
    fit = images.filter((pixels >= 40_000) & (F.coalesce("src", F.lit("")) != ""))
    top = Window.partitionBy("page_id").orderBy(pixels.desc(), "seq")
    ranked = fit.withColumn("place", F.row_number().over(top)).filter(f"place <= {keep}")
    return ranked.withColumn("same_origin", F.coalesce(origin[0] == origin[1], F.lit(False)))


def caption_text(cues: DataFrame) -> DataFrame:
    """Plain text of caption cues; empty ones are dropped."""
    plain = F.regexp_replace("text", "<[^>]*>", "")
    return cues.withColumn("text", F.trim(F.regexp_replace(plain, f"[{WS_SET}]+", " "))).filter("text <> ''")


def coverage_update(boundaries: DataFrame, truncated: DataFrame) -> DataFrame:
    """Coverage state per document from boundary rows and the truncation flag."""
    kind = F.col("kind")
    totals = boundaries.groupBy("doc_id").agg(
        F.count("*").alias("total_boundaries"),
        F.count_if(F.col("status") == "inaccessible").alias("inaccessible"),
        F.bool_or(kind.isin("shadow-root", "closed-shadow-root")).alias("_shadow"),
        F.bool_or(kind == "cross-origin-frame").alias("_cross"),
    )
    bad = F.col("inaccessible") > 0
    return totals.join(truncated, "doc_id", "left").select(
        "doc_id", F.lit("complete").alias("dom"),
        F.when(F.col("_shadow") & bad, "partial").otherwise("complete").alias("shadow_dom"),
        F.lit("complete").alias("same_origin_frames"),
        F.when(F.col("_cross") & bad, "inaccessible").otherwise("complete").alias("cross_origin_frames"),
        "total_boundaries", F.col("inaccessible").alias("inaccessible_boundaries"),
        (~bad & ~F.coalesce("truncated", F.lit(False))).alias("complete"),
    )


def coverage_summary() -> Column:
    c = F.col
    parts = [F.concat(F.lit("DOM: "), "dom")]
    for label, name in (("Shadow DOM", "shadow_dom"), ("Frames", "same_origin_frames"),
                        ("Cross-origin", "cross_origin_frames")):
        parts.append(F.when(c(name) != "complete", F.concat(F.lit(f"{label}: "), name)))
    n = c("inaccessible_boundaries")
    parts.append(F.when(n > 0, F.concat(n, F.lit(" inaccessible boundary(ies)"))))
    return F.concat_ws(", ", *parts)


# Reasons that mean the browser kept content out of reach.
BLOCKED_REASONS = [
    "cross-origin-isolation",
    "chrome-internal-page",
    "file-url-permission-disabled",
    "pdf-viewer-plugin-isolated",
    "tainted-canvas-no-tab-capture",
]


def coverage_state(found: Column, deferred: Column, failed: Column, drm: Column, blocked: Column, unread: Column) -> Column:
    """Status of a scan from its counts, the gravest first."""
    return (
        F.when(failed, "SCAN_FAILED")
        .when(drm > 0, "UNSUPPORTED_CONTENT_PRESENT")
        .when(blocked > 0, "BLOCKED_BY_BROWSER_SECURITY")
        .when((deferred > 0) | (unread > 0), "PARTIALLY_SCANNED")
        .when(found == 0, "NO_SENSITIVE_DATA_DETECTED")
        .otherwise("FULLY_SCANNED")
    )


def coverage_status(scans: DataFrame, findings: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Honest status per scan: never clean while anything stayed unread.

    ``scans``: doc_id, deferred, had_error.  The two fact tables are aggregated to
    one row per document before they meet the scans.
    """
    zero = F.lit(0).cast("bigint")
    facts = (
        findings.select("doc_id", F.lit(1).alias("f"), zero.alias("d"), zero.alias("b"), zero.alias("u"))
        .unionByName(unresolved.select(
            "doc_id", zero.cast("int").alias("f"),
            (F.col("reason") == "drm-protected-media").cast("bigint").alias("d"),
            F.col("reason").isin(BLOCKED_REASONS).cast("bigint").alias("b"),
            F.lit(1).cast("bigint").alias("u")))
        .groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in "fdbu"])
    )

    def n(c: str) -> Column:
        return F.coalesce(F.col(c), zero)

    status = coverage_state(n("f"), F.col("deferred"), F.col("had_error"), n("d"), n("b"), n("u"))
    return scans.join(facts, "doc_id", "left").select("doc_id", status.alias("coverage_status"))
