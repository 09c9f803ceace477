"""Document scans: text table in, findings and redacted text out.

Everything from detection to redaction stays inside the row, so these jobs read,
compute and write without a shuffle.  Only aggregates over findings shuffle, and
those combine on the map side first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from spanveil.constants import DEFAULT_CATEGORIES
from spanveil.functions.detectors import detect_all, resolved_spans, spans_of_hits, text_hits
from spanveil.functions.masking import context_window, mask_context, mask_value
from spanveil.functions.text import let, mark_of, no_spans, ranks_in, regex_spans
from spanveil.operators.pages import coverage_state
from spanveil.session import spread


def explode_spans(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per span.

    The outer form is deliberate: for the inner form Catalyst infers a filter on
    the size of the array, pushes it below the projection that computes it and so
    runs every detector again.
    """
    return (
        df.select(*keep, F.explode_outer(column).alias("_s"))
        .filter(F.col("_s").isNotNull())
        .select(*keep, "_s.*")
    )


_built: dict[tuple, Column] = {}


def _once(kind: str, text: str, categories: Iterable[str], build: Callable[[list[str]], Column]) -> Column:
    """An expression built once per session: assembling some fifty detectors costs seconds of
    driver time, and the finished expression can be reused in any number of plans."""
    categories = list(categories)
    key = (SparkSession.active().sparkContext.applicationId, kind, text, tuple(categories))
    if key not in _built:
        _built[key] = build(categories)
    return _built[key]


def detection_column(text: str, categories: Iterable[str] = DEFAULT_CATEGORIES) -> Column:
    """The ``detect_all`` expression over a named column, built once per session."""
    return _once("all", text, categories, lambda c: detect_all(F.col(text), c))


def with_spans(
    df: DataFrame, text: str = "text", categories: Iterable[str] = DEFAULT_CATEGORIES, extra: Column | None = None,
) -> DataFrame:
    """Add the resolved ``spans`` of a text column, as ``detection_column`` has them.

    Probes and patterns stand in a projection outside of all lambdas, which Spark compiles; as
    its result is read twice behind it, the projections are not merged.  The lambda of ``_some``
    keeps it out of whole-stage code, whose one method would be too long for the JIT compiler.
    """
    categories = list(categories)
    low, mark, hits = F.col("_low"), F.col("_mark"), F.col("_hits")
    held = _once("hits", text, categories, lambda c: text_hits(F.col(text), low, mark, c))
    found = _once("spans", text, categories, lambda c: spans_of_hits(F.col(text), hits, c))
    some = F.exists(F.array(F.col(text)), lambda t: t.isNotNull())
    prepared = df.withColumns({"_low": F.lower(text), "_mark": mark_of(F.col(text))}).withColumns({"_hits": held, "_some": some})
    spans = F.when(F.col("_some"), resolved_spans(found, categories, extra)).otherwise(no_spans())
    return prepared.withColumn("spans", spans).drop("_low", "_mark", "_hits", "_some")


def scan_documents(
    docs: DataFrame,
    text: str = "text",
    categories: Iterable[str] = DEFAULT_CATEGORIES,
    extra: Column | None = None,
    dealt: bool = False,
) -> DataFrame:
    """Documents with a resolved ``spans`` array; ``dealt`` ones are spread over the cores already."""
    return with_spans(docs if dealt else spread(docs), text, categories, extra)


def with_segments(df: DataFrame, text: str = "text") -> DataFrame:
    """Attach ``segment_starts``: offset of every line of a combined text."""
    breaks = regex_spans(F.col(text), "\n")
    return df.withColumn(
        "segment_starts", F.concat(F.array(F.lit(0)), F.transform(breaks, lambda b: b["end"]))
    )


def threshold_filter(findings: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Keep findings at or above their category threshold (0 when unset)."""
    if not thresholds:
        return findings
    pairs = [F.lit(x) for item in thresholds.items() for x in item]
    floor = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("category")), F.lit(0.0))
    return findings.filter(F.col("confidence") >= floor)


def threshold_spans(spans: Column, thresholds: Column) -> Column:
    """Array form with a per-row ``map<string,double>`` of thresholds."""
    return F.filter(
        spans,
        lambda s: s["confidence"]
        >= F.coalesce(F.try_element_at(thresholds, s["category"]), F.lit(0.0)),
    )


def finding_array(
    df: DataFrame,
    text: str = "text",
    *,
    prefix: str = "",
    source: str | None = None,
    node_id: str | None = None,
    pad: int = 120,
    selected: bool = True,
    offset: int = 0,
    custom_categories: Iterable[str] = (),
) -> DataFrame:
    """Add ``findings``: one struct per span, never with the raw value.

    Runs inside the row: the span index, the owning segment and the masked context
    all come from the arrays next to the text.
    """
    custom = ["custom", *custom_categories]

    def origin(category: Column) -> Column:
        if source:
            return F.lit(source)
        return F.when(category.isin(custom), "custom-pattern").otherwise("local-rules")

    def describe(s: Column, i: Column, owners: Column | None) -> Column:
        owner = F.lit(node_id) if owners is None else F.concat(F.lit("seg_"), F.get(owners, i) - 1)
        return F.struct(
            F.concat_ws("_", F.lit(prefix) if prefix else F.lit(None).cast("string"),
                        s["category"], s["start"], s["end"], i).alias("finding_id"),
            s["category"].alias("category"),
            s["confidence"].alias("confidence"),
            mask_value(s["category"], s["value"]).alias("preview"),
            owner.alias("node_id"),
            (s["start"] + offset).cast("bigint").alias("start_offset"),
            (s["end"] + offset).cast("bigint").alias("end_offset"),
            mask_context(context_window(F.col(text), s["start"], s["end"], pad)).alias(
                "context_preview"
            ),
            origin(s["category"]).alias("source"),
            F.lit(selected).alias("selected"),
        )

    if node_id is not None:
        return df.withColumn("findings", F.transform("spans", lambda s, i: describe(s, i, None)))
    # spans ascend, so their segments come from one merge with the segment starts
    owners = ranks_in(F.col("segment_starts"), F.transform("spans", lambda s: s["start"]))
    found = let(owners, lambda o: F.transform("spans", lambda s, i: describe(s, i, o)))
    return df.withColumn("findings", found)


def build_findings(df: DataFrame, keys: list[str], text: str = "text", **options) -> DataFrame:
    """Findings of scanned documents, one row each; options as in ``finding_array``."""
    return explode_spans(finding_array(df, text, **options), "findings", *keys)


def with_media(findings: DataFrame, media: Column, thresholds: dict[str, float]) -> DataFrame:
    """Findings of pages and, under each, the one that its media item gave.

    ``media`` names the item a finding was read from as well (null: none).  A media finding
    stays unselected and must reach its category's threshold.  One read of ``findings``.
    """
    pairs = [F.lit(x) for item in thresholds.items() for x in item]
    floor = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("category")), F.lit(0.0)) if pairs else F.lit(0.0)
    changed = {
        "finding_id": F.concat(F.lit("media_"), media, F.lit("_"), "finding_id"),
        "source": F.lit("local-rules"), "selected": F.lit(False),
    }
    own = F.struct(*[F.col(c) for c in findings.columns])
    copy = F.struct(*[changed.get(c, F.col(c)).alias(c) for c in findings.columns])
    both = F.array(own, F.when(media.isNotNull() & (F.col("confidence") >= floor), copy))
    return findings.select(F.explode(both).alias("f")).filter("f IS NOT NULL").select("f.*")


def merge_findings(base: DataFrame, *more: DataFrame) -> DataFrame:
    """Append later findings of a session; no shuffle."""
    for extra in more:
        base = base.unionByName(extra, allowMissingColumns=True)
    return base


def apply_selection(findings: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Set ``selected`` from a table of chosen ids; attribute findings stay off."""
    picked = chosen.select(*keys, "finding_id").distinct().withColumn("_on", F.lit(True))
    return (
        findings.drop("selected")
        .join(picked, [*keys, "finding_id"], "left")
        .withColumn(
            "selected",
            F.when(F.col("source") == "attr", False).otherwise(
                F.coalesce(F.col("_on"), F.lit(False))
            ),
        )
        .drop("_on")
    )


def leak_verify(scanned: DataFrame, redacted: str, keys: list[str],
                categories: Iterable[str] = DEFAULT_CATEGORIES) -> DataFrame:
    """Re-detect on the redacted text; verified when no original value survives.

    Both span arrays live in the same row, so the check is an array test and not
    a join back to the originals.  A value can only be detected again where the redacted
    text still holds it, so other texts are not scanned twice.
    """
    held = F.exists("spans", lambda s: F.col(redacted).contains(s["value"]))
    again = F.when(~held, no_spans()).otherwise(detection_column(redacted, categories))
    return (
        scanned.select(*keys, "spans", redacted)
        .withColumn("_again", again)
        .select(
            *keys,
            F.size("spans").cast("bigint").alias("checked"),
            F.size(
                F.filter(
                    "_again",
                    lambda a: F.exists("spans", lambda s: s["value"] == a["value"]),
                )
            ).cast("bigint").alias("surviving"),
        )
        .withColumn("verified", (F.col("surviving") == 0) & (F.col("checked") > 0))
    )


def scan_stats(
    scanned: DataFrame, keys: list[str], text: str = "text", *, truncated: Column | None = None,
    attr_chars: Column | None = None, deferred: Column | None = None, failed: Column | None = None,
    blocked: Column | None = None, unread: Column | None = None,
) -> DataFrame:
    """Statistics of each scan, inside its row.

    ``truncated`` is what the step that cuts texts says; without one nothing was cut.  The
    other facts (characters of attributes, media put off, regions left unread, of them those
    blocked) default to none; together with the findings they give the coverage.
    """
    none = F.lit(0).cast("bigint")
    off = F.lit(False)
    given = lambda c, default: default if c is None else F.coalesce(c, default)
    found = F.size("spans").cast("bigint")
    stopped, late = given(blocked, none).cast("bigint"), given(deferred, none).cast("bigint")
    return scanned.select(
        *keys, F.length(text).cast("bigint").alias("visible_chars"), given(attr_chars, none).cast("bigint").alias("attr_chars"),
        given(truncated, off).alias("truncated"), late.alias("deferred"), found.alias("findings"),
        coverage_state(found, late, given(failed, off), none, stopped, given(unread, none) + stopped).alias("coverage_status"),
    )


#: Characters between a page's text and the report-only texts that follow it.
CAPTION_OFFSET = 2000


def report_only(surfaces: DataFrame, keys: list[str], categories: Iterable[str] = DEFAULT_CATEGORIES) -> DataFrame:
    """Findings of the texts beside a page's own: never selected, never masked.

    ``surfaces``: keys, ``surface`` ('svg', 'caption' or 'attr'; an array where one text is
    several of them, which is then scanned once), ``text``, ``page_chars`` (length of the
    page's text) and, for attributes, ``attributes``, the owner of every line.
    SVG text is placed one character behind the page's text and captions
    ``CAPTION_OFFSET`` behind it; attribute text has offsets of its own and names the
    attribute a value begins in.  Rows of all surfaces share one detection.
    """
    scanned = with_segments(with_spans(surfaces, "text", categories))
    if isinstance(surfaces.schema["surface"].dataType, ArrayType):
        scanned = scanned.withColumn("surface", F.explode("surface"))
    attr = F.col("surface") == "attr"
    shift = F.when(F.col("surface") == "svg", F.col("page_chars") + 1).when(
        F.col("surface") == "caption", F.col("page_chars") + CAPTION_OFFSET
    ).otherwise(0)
    node = F.when(F.col("surface") == "svg", "svg").when(F.col("surface") == "caption", "video-caption").otherwise("")

    def describe(s: Column, i: Column, owners: Column) -> Column:
        window = F.when(attr, context_window(F.col("text"), s["start"], s["end"], 120)).otherwise(
            context_window(F.col("text"), s["start"], s["end"], 80)
        )
        return F.struct(
            F.concat_ws("_", F.col("surface"), s["category"], s["start"], s["end"], i).alias("finding_id"),
            s["category"].alias("category"), s["confidence"].alias("confidence"),
            mask_value(s["category"], s["value"]).alias("preview"), node.alias("node_id"),
            (s["start"] + shift).cast("bigint").alias("start_offset"), (s["end"] + shift).cast("bigint").alias("end_offset"),
            mask_context(window).alias("context_preview"),
            F.when(attr, "attr").otherwise("local-rules").alias("source"),
            F.when(attr, F.coalesce(F.get("attributes", F.get(owners, i) - 1), F.lit(""))).alias("attribute"),
            F.lit(False).alias("selected"),
        )

    owners = ranks_in(F.col("segment_starts"), F.transform("spans", lambda s: s["start"]))
    found = let(owners, lambda o: F.transform("spans", lambda s, i: describe(s, i, o)))
    return explode_spans(scanned.withColumn("findings", found), "findings", *keys)
