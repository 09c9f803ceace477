"""Overlap resolution: one winner per chain of overlapping spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.constants import CATEGORY_PRIORITY
from spanveil.functions.text import SPAN, fold_out, let


def priority(category: Column) -> Column:
    """Rank of a category, lower is better; unknown categories rank first."""
    return F.array_position(F.lit(CATEGORY_PRIORITY), category)


def _ranked(s: Column) -> Column:
    rank = F.struct(
        priority(s["category"]).alias("p"),
        (s["start"] - s["end"]).alias("n"),
        (-s["confidence"]).alias("c"),
        s["start"].alias("s"),
    )
    return F.struct(s.alias("s"), rank.alias("r"))


def resolve_overlaps(spans: Column) -> Column:
    """Array form: one ordered fold inside the row, no shuffle.

    Ranks are taken once a span, and spans of which none overlaps need no fold.
    """

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column, Column]:
        s = x["s"]
        fresh = s["start"] >= acc["reach"]
        state = {
            "reach": F.greatest(acc["reach"], s["end"]),
            "best": F.when(fresh | (x["r"] < acc["best"]["r"]), x).otherwise(acc["best"]),
        }
        return state, fresh & acc["best"].isNotNull(), acc["best"]["s"]

    ranked = "struct<s:" + SPAN + ",r:struct<p:bigint,n:int,c:double,s:int>>"
    state = {"reach": F.lit(-1), "best": F.expr(f"cast(null as {ranked})")}

    def resolved(spans: Column) -> Column:
        fold = fold_out(F.transform(spans, _ranked), state, step, SPAN, lambda a: F.array(a["best"]["s"]))
        meets = lambda i: F.get(spans, i)["start"] < F.get(spans, i - 1)["end"]
        return F.when(F.exists(F.sequence(F.lit(1), F.size(spans) - 1), meets), fold).otherwise(spans)

    return let(F.sort_array(spans), lambda a: F.when(F.size(a) > 1, resolved(a)).otherwise(a))


def resolve_overlaps_long(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Row form over a long span table: gaps and islands with windows.

    Used where spans already arrive as rows.  The window is per document.
    """
    by_pos = Window.partitionBy(*keys).orderBy("start", "end", "category", "confidence", "value")
    reach = F.max("end").over(by_pos.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum("fresh").over(by_pos.rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.withColumn(
        "fresh", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    ).withColumn("island", island)
    best = Window.partitionBy(*keys, "island").orderBy(
        priority(F.col("category")), F.col("start") - F.col("end"),
        F.col("confidence").desc(), "start", "value",
    )
    return (
        marked.withColumn("place", F.row_number().over(best))
        .filter("place = 1")
        .drop("fresh", "island", "place")
    )
