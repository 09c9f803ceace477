"""Text segments: trimming, budgets, combined text and offset mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.functions.text import fold_out, let, match_spans, rank_in
from spanveil.operators.prefix import with_running

# White space plus NBSP and zero-width space, as stripped from page text.  Given as a set of
# characters: a pattern would be tried at every place of the text.
_TRIM = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_segments(raw: DataFrame, cap: int | None = None) -> DataFrame:
    """Trim (doc_id, seq, raw, is_input); drop blanks; mark what a cap cuts.

    ``start_offset`` is the length of the stripped lead for text nodes and 0 for
    input values, whose text is not anchored in a node.
    """
    trimmed = F.btrim("raw", F.lit(_TRIM))
    lead = F.length("raw") - F.length(F.ltrim("raw", F.lit(_TRIM)))
    return (
        raw.withColumn("_t", trimmed)
        .filter(F.length("_t") > 0)
        .withColumn("text", F.col("_t") if cap is None else F.substring("_t", 1, cap))
        .withColumn("start_offset", F.when(F.col("is_input"), 0).otherwise(lead))
        .select(
            "doc_id", "seq", F.concat(F.lit("seg_"), "seq").alias("node_id"),
            F.col("start_offset").cast("bigint").alias("start_offset"),
            (F.col("start_offset") + F.length("text")).cast("bigint").alias("end_offset"),
            "text", (F.lit(False) if cap is None else F.length("_t") > cap).alias("truncated"),
        )
    )


def apply_budget(segments: DataFrame, budget: int | None = None) -> DataFrame:
    """Keep a segment while the total before it is under the document's budget.

    Without a budget all segments stay and nothing is computed.
    """
    if budget is None:
        return segments
    n = F.length("text").cast("bigint")
    running = with_running(segments, ["doc_id"], "seq", sums={"chars_before": n})
    return running.filter(F.col("chars_before") < budget).withColumn(
        "truncated", F.col("truncated") | (F.col("chars_before") + n >= budget)
    )


def scan_text(segments: DataFrame) -> DataFrame:
    """One row per document: segments joined by line breaks, and their starts.

    The combined text of a document is one value, so a document's segments meet in a row.
    """
    grouped = segments.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "node_id", "start_offset", "text"))).alias("s"),
        F.bool_or("truncated").alias("truncated"),
    )
    texts = F.transform("s", lambda x: x["text"])

    def starts(s: Column) -> Column:
        return fold_out(
            s, {"pos": F.lit(0).cast("bigint")},
            lambda a, x: ({"pos": a["pos"] + F.length(x["text"]) + 1}, None, a["pos"]), "bigint",
        )

    return grouped.select(
        "doc_id", F.array_join(texts, "\n").alias("combined"),
        starts(F.col("s")).alias("segment_starts"),
        F.transform("s", lambda x: x["node_id"]).alias("node_ids"),
        F.transform("s", lambda x: x["start_offset"]).alias("node_offsets"),
        "truncated",
    )


def place_segments(segments: DataFrame) -> DataFrame:
    """Add the combined-text range of each segment without building the text."""
    n = F.length("text").cast("bigint")
    placed = with_running(segments, ["doc_id"], "seq", sums={"combined_start": n + 1})
    return placed.withColumn("combined_end", F.col("combined_start") + n)


def segment_at(starts: Column, length: Column, offset: Column) -> Column:
    """Index of the last segment starting at or before an offset, else -1."""
    return F.when((offset < 0) | (offset >= length), F.lit(-1)).otherwise(rank_in(starts, offset) - 1)


def map_range(scan: DataFrame, ranges: DataFrame) -> DataFrame:
    """Node ranges covered by each (doc_id, range_id, start_pos, end_pos).

    One equi join on the document, whose hot keys AQE can split, as every range is looked
    up by itself: the first and the last segment it touches by halving, then one row for
    each of that slice, so the work is in the ranges and their hits.
    """
    offsets = scan.select(
        "doc_id", "segment_starts", "node_ids", "node_offsets",
        F.length("combined").cast("bigint").alias("n"),
    )
    starts = F.col("segment_starts")
    inside = (F.col("start_pos") >= 0) & (F.col("start_pos") < F.col("n")) & (F.col("end_pos") > F.col("start_pos"))
    slices = ranges.join(offsets, "doc_id").filter(inside).withColumn(
        "i", F.explode_outer(F.sequence(
            rank_in(starts, F.col("start_pos")) - 1, rank_in(starts, F.col("end_pos") - 1) - 1
        ))
    )
    i = F.col("i")
    start = F.get(starts, i)
    length = F.coalesce(F.get(starts, i + 1) - 1, F.col("n")) - start
    lo = F.greatest(F.col("start_pos") - start, F.lit(0))
    hi = F.least(F.col("end_pos") - start, length)
    base = F.get(F.col("node_offsets"), i)
    # a range may touch only the break behind a segment
    return slices.select(
        "doc_id", "range_id", F.get(F.col("node_ids"), i).alias("node_id"),
        (base + lo).alias("node_start"), (base + hi).alias("node_end"), (hi > lo).alias("hit"),
    ).filter("hit").drop("hit")


def redact_segments(segments: DataFrame, mapped: DataFrame, block: str = "█") -> DataFrame:
    """Block the mapped node ranges inside each segment; separators stay."""
    hits = mapped.groupBy("doc_id", "node_id").agg(
        F.array_sort(F.collect_set(F.struct("node_start", "node_end"))).alias("hits")
    )
    base = F.col("start_offset")
    ordered = F.transform(
        F.coalesce(F.col("hits"), F.expr("cast(array() as array<struct<node_start:bigint,node_end:bigint>>)")),
        lambda h: F.struct((h["node_start"] - base).alias("s"), (h["node_end"] - base).alias("e")),
    )

    def paint(acc: Column, h: Column) -> tuple[dict[str, Column], None, Column]:
        lo = F.greatest(h["s"], acc["pos"])
        hi = F.greatest(h["e"], lo)
        piece = F.concat(
            F.substr(F.col("text"), acc["pos"] + 1, lo - acc["pos"]), F.repeat(F.lit(block), (hi - lo).cast("int"))
        )
        return {"pos": hi}, None, piece

    rest = lambda a: F.array(F.substr(F.col("text"), a["pos"] + 1))
    painted = F.array_join(
        fold_out(ordered, {"pos": F.lit(0).cast("bigint")}, paint, "string", rest), ""
    )
    return segments.join(hits, ["doc_id", "node_id"], "left").withColumn("text", painted).drop("hits")


def selection_span(segments: DataFrame, picked: DataFrame) -> DataFrame:
    """Combined-text span of requested node ranges; null where none is live.

    ``picked``: (doc_id, node_id, from_offset, to_offset, live).
    """
    placed = place_segments(segments)
    joined = picked.filter("live").join(placed, ["doc_id", "node_id"])
    lo = F.greatest("start_offset", F.least("from_offset", "end_offset"))
    hi = F.greatest("start_offset", F.least("to_offset", "end_offset"))
    found = (
        joined.withColumn("lo", lo).withColumn("hi", hi).filter("hi > lo")
        .groupBy("doc_id").agg(
            F.min(F.col("combined_start") + F.col("lo") - F.col("start_offset")).alias("start_pos"),
            F.max(F.col("combined_start") + F.col("hi") - F.col("start_offset")).alias("end_pos"),
        )
    )
    return picked.select("doc_id").distinct().join(found, "doc_id", "left")


# ---- Unicode -----------------------------------------------------------------
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{FEFF}]"


def normalize_unicode(text: Column) -> Column:
    """Drop zero-width characters, NBSP to space, collapse runs of spaces."""
    plain = F.regexp_replace(F.regexp_replace(text, ZERO_WIDTH, ""), r"\x{A0}", " ")
    return F.regexp_replace(plain, " {2,}", " ")


#: Stretches of which at most the first space stays.
_STRETCH = r"[ \x{A0}\x{200B}-\x{200D}\x{FEFF}]{2,}|[\x{200B}-\x{200D}\x{FEFF}]"
RUN = "struct<normal:int,original:int,length:int>"


def offset_runs(text: Column) -> Column:
    """Runs of characters that normalisation keeps side by side, in order.

    A run says where it begins in the normalised and in the original text and how long it
    is; runs are as many as there are changes, not characters.  Zero-width characters are
    skipped, NBSP counts as a space, and of a run of spaces only the first is kept.
    """

    def stretch(m) -> tuple[None, Column]:
        # place of the first space in the stretch, from 1; 0 without one
        lead = F.regexp_extract(m.value, r"^[^ \x{A0}]*", 0)
        space = F.when(F.length(lead) < F.length(m.value), F.length(lead) + 1).otherwise(0)
        return None, F.struct(m.start.alias("start"), m.end.alias("end"), space.cast("int").alias("space"))

    def run(normal: Column, original: Column, length: Column) -> Column:
        return F.struct(normal.cast("int").alias("normal"), original.cast("int").alias("original"), length.cast("int").alias("length"))

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], None, Column]:
        own = x["start"] - acc["at"] + F.when(x["space"] == 1, 1).otherwise(0)
        # a space at the end of a stretch begins the next run
        joins = (x["space"] > 1) & (x["start"] + x["space"] == x["end"])
        alone = (x["space"] > 1) & ~joins
        made = F.array(
            run(acc["normal"], acc["at"], own),
            run(acc["normal"] + own, x["start"] + x["space"] - 1, F.when(alone, 1).otherwise(0)),
        )
        return {"normal": acc["normal"] + own + F.when(alone, 1).otherwise(0), "at": x["end"] - joins.cast("int")}, None, made

    found = match_spans(text, _STRETCH, stretch, item="struct<start:int,end:int,space:int>")
    last = lambda acc: F.array(F.array(run(acc["normal"], acc["at"], F.length(text) - acc["at"])))
    runs = fold_out(found, {"normal": F.lit(0), "at": F.lit(0)}, step, f"array<{RUN}>", last)
    return F.filter(F.flatten(runs), lambda r: r["length"] > 0)


def offset_map(runs: Column) -> Column:
    """Original index of every normalised character, spelled out from the runs."""
    return F.flatten(F.transform(runs, lambda r: F.sequence(r["original"], r["original"] + r["length"] - 1)))


def to_original(runs: Column, offset: Column) -> Column:
    """Original offset of a normalised one, clamped at both ends; by halving."""

    def look(held: Column) -> Column:
        last = F.element_at(held, -1)
        at = F.least(F.greatest(offset, F.lit(0)), last["normal"] + last["length"] - 1)
        i = rank_in(F.transform(held, lambda r: r["normal"]), at) - 1
        return let(F.get(held, i), lambda r: r["original"] + at - r["normal"])

    return let(runs, lambda held: F.when(F.size(held) == 0, offset).otherwise(look(held)).cast("long"))


def to_normalized(runs: Column, offset: Column) -> Column:
    """Normalised offset of an original one; unmapped offsets stay as they are."""

    def look(held: Column) -> Column:
        i = rank_in(F.transform(held, lambda r: r["original"]), offset) - 1

        def inside(r: Column) -> Column:
            into = offset - r["original"]
            return F.when((into >= 0) & (into < r["length"]), r["normal"] + into).otherwise(offset)

        return let(F.get(held, i), inside)

    return let(runs, lambda held: F.coalesce(look(held), offset).cast("long"))


def assemble_frames(parents: DataFrame, frames: DataFrame) -> DataFrame:
    """Append frame segments to their page: parents first, then frames in order."""
    columns = ["doc_id", "frame_no", "seq", "node_id", "start_offset", "end_offset", "text",
               "truncated"]
    own = parents.withColumn("frame_no", F.lit(-1).cast("bigint")).select(*columns)
    prefixed = frames.withColumn(
        "node_id", F.concat(F.lit("frame_"), F.col("frame_no"), F.lit("_"), F.col("node_id"))
    ).select(*columns)
    both = own.unionByName(prefixed)
    # Offsets per frame come from one small aggregate, so no document is windowed
    # row by row.
    spans = both.groupBy("doc_id", "frame_no").agg((F.max("seq") + 1).alias("n"))
    ahead = Window.partitionBy("doc_id").orderBy("frame_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shift = spans.select(
        "doc_id", "frame_no", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shift")
    )
    return both.join(shift, ["doc_id", "frame_no"]).withColumn(
        "seq", F.col("seq") + F.col("shift")
    ).drop("shift", "frame_no")


def frame_boundaries(frames: DataFrame) -> DataFrame:
    """Boundary record of every frame of a page, readable or not.

    ``frames``: doc_id, frame_order, accessible.  Adds ``number`` (place among all frames),
    ``frame_no`` (readable frames before it, the number it is merged under) and ``boundary``.
    Frames of a page are few: they are numbered in one window of the page.
    """
    before = Window.partitionBy("doc_id").orderBy("frame_order").rowsBetween(Window.unboundedPreceding, -1)
    read = F.coalesce(F.sum(F.col("accessible").cast("bigint")).over(before), F.lit(0).cast("bigint"))
    number = F.count("*").over(before)
    return frames.withColumns({"number": number, "frame_no": read}).withColumn("boundary", F.struct(
        F.when(F.col("accessible"), "iframe").otherwise("cross-origin-frame").alias("kind"),
        F.when(F.col("accessible"), "complete").otherwise("inaccessible").alias("status"),
        F.concat(F.lit("iframe_boundary_"), "number").alias("node_id"),
        F.concat(F.lit("frame_"), "frame_no").alias("frame_id"),
    ))
