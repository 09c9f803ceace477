"""Mixing sources to target weights by entropy balancing.

Documents get rates ``exp(lambda * size / mean)`` (three at most), the rates closest
to one, in relative entropy, that meet the token constraint of their source.  A
source's lambda is found by Newton steps on the dual, kept inside a bracket that holds
it for sizes of any spread, over a table of (source, size, documents) instead of the
documents.  Rates become copies by
systematic rounding along the sizes, which keeps a source's total within about one
document of its target.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanveil.llm.common import fresh, stored

#: Copies of a document, and so words of a source, are at most so many times the given.
MOST = 3.0
#: A source's words are this close to the target before rounding, as a share.
TOLERANCE = 1e-4
ROUNDS = 60
#: Blocks into which the documents of one (source, size) are dealt.
BLOCKS = 64
#: Exponents are cut here, far above any rate.
_REACH = 40.0


def size_of(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Add ``target`` to (source, source_size): weights 1, 2, 3 repeating by name, null
    last; shares of all words, cut at ``MOST`` times the source, the excess dealt again.

    Done at once: with sources in ascending order of limit / weight, those before the
    first one whose share of what is left stays below its limit are cut.
    """
    # one row a source; without a key it would be one task, so only names are ranked there
    names = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    weighed = sources.withColumn("weight", (F.row_number().over(names) - 1) % 3 + 1)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = MOST * F.col("source_size")
    return (
        weighed.withColumn("total", F.sum("source_size").over(total))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        .withColumn("weights", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("weights"))
        # the level of the first source that is not cut holds for all after it
        .withColumn("free", F.col("level") * F.col("weight") <= limit)
        .withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), F.col("level").alias("level")))).over(total)["level"])
        .withColumn("target", F.least(limit, F.coalesce(F.col("level") * F.col("weight"), limit)))
        .select("source", "source_size", "target")
    )


def _rate(level: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(MOST), F.exp(F.least(level * size / mean, F.lit(_REACH))))


def solve(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """Dual solution (source_key, level, mean) for ``groups`` (source_key, size, n).

    The first bracket holds the solution for sizes of any spread: at ``near`` no rate is
    past target / source_size, at ``far`` every rate is (or is at its limit).  Both lie on
    one side of 0, so steps that close the gap too slowly halve the bracket's logarithm.
    A source at its limit has every rate there.  A gap left after all rounds is an error.
    """
    ends = groups.groupBy("source_key").agg(F.min("size").alias("least"), F.max("size").alias("largest"))
    full = F.col("target") >= MOST * F.col("source_size")
    bend = F.coalesce(F.ln(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0.0))
    # a little wider, as the ends are rounded
    near = bend * F.col("mean") / F.col("largest") * (1 - 1e-6)
    far = F.when(bend > 0, math.log(MOST)).otherwise(bend) * F.col("mean") / F.col("least") * (1 + 1e-6)
    # all rates are 1 at 0 and the slope there is the source's size
    first = F.try_divide(F.col("target"), F.col("source_size")) - 1
    low, high = F.least(near, far), F.greatest(near, far)
    start = wanted.join(ends, "source_key", "left").select(
        "source_key", "target", "mean", full.alias("full"), low.alias("low"), high.alias("high"),
        F.when(full, float("inf")).otherwise(F.greatest(low, F.least(high, first))).alias("level"),
        F.when(full, 0.0).otherwise(1.0).alias("gap"),
    )
    state = stored(start)
    for round_ in range(ROUNDS + 1):
        open_ = state.where(F.abs("gap") > TOLERANCE)
        if open_.isEmpty():
            break
        if round_ == ROUNDS:
            raise RuntimeError(f"mix: targets not met after {ROUNDS} rounds: {open_.limit(5).collect()}")
        live = groups.join(state.select("source_key", "level", "mean"), "source_key")
        rate = _rate(F.col("level"), F.col("size"), F.col("mean"))
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < MOST, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = live.groupBy("source_key").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        now = state.join(sums, "source_key", "left").withColumn("words", F.coalesce("words", F.lit(0.0)))
        short = F.col("target") - F.col("words")
        low = F.when(short > 0, F.col("level")).otherwise(F.col("low"))
        high = F.when(short > 0, F.col("high")).otherwise(F.col("level"))
        newton = F.col("level") + F.try_divide(short, F.col("slope"))
        gap = F.when(F.col("full"), 0.0).otherwise(short / F.col("target"))
        fast = F.abs(gap) <= F.abs("gap") / 2
        inside = F.coalesce(fast & (newton > low) & (newton < high), F.lit(False))
        met = F.abs(gap) <= TOLERANCE
        state = stored(now.select(
            "source_key", "target", "mean", "full", low.alias("low"), high.alias("high"),
            F.when(met, F.col("level")).when(inside, newton).otherwise(F.signum(high + low) * F.sqrt(low * high)).alias("level"),
            gap.alias("gap"),
        ))
    # sums of doubles may differ in their last digits from run to run; levels of any
    # magnitude keep ten digits
    level = F.format_string("%.9e", "level").cast("double")
    return state.select("source_key", level.alias("level"), "mean")


def mix(docs: DataFrame, keep_source: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), one row per row of ``docs``.

    Null sources are a source of their own, the last.  Empty and null texts have size
    0 and are taken once.  A source without words gets no target.  Ties and repeated
    rows are told apart only by their place in a block, with equal results for equal
    rows but for the last copy.  Further columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = stored(docs.select("doc_id", key.alias("source_key"), size_of(F.col("text")).alias("size")))
    groups = stored(sized.groupBy("source_key", "size").agg(F.count("*").alias("n")))
    sums = groups.groupBy("source_key").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.try_divide(F.sum(F.col("n") * F.col("size") * F.col("size")), F.sum(F.col("n") * F.col("size"))).alias("mean"),
    )
    named = sums.withColumn("source", F.when(F.col("source_key") != "n", F.substring("source_key", 2, 2**31 - 1)))
    wanted = stored(
        targets(named.select("source", "source_size"))
        .withColumn("source_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
        .join(sums.select("source_key", F.coalesce("mean", F.lit(1.0)).alias("mean")), "source_key")
        .select("source_key", "source_size", "target", "mean")
    )
    levels = wanted.select("source_key", "source_size", "target").join(solve(groups.where("size > 0"), wanted), "source_key")
    rates = groups.join(levels, "source_key").withColumn(
        "rate", F.when(F.col("size") == 0, 1.0).otherwise(_rate(F.col("level"), F.col("size"), F.col("mean")))
    )
    # running sum of rates along the sizes of a source: over a table of sizes, not documents
    along = Window.partitionBy("source_key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rates = stored(
        rates.withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(along), F.lit(0.0)))
        .select("source_key", "size", "rate", "before", "source_size", "target")
    )
    # place of a document among those of its source and size, by blocks
    block = F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS))
    placed = sized.withColumn("block", block)
    counts = placed.groupBy("source_key", "size", "block").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy("source_key", "size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.select("source_key", "size", "block", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("ahead")))
    within = Window.partitionBy("source_key", "size", "block").orderBy("doc_id")
    placed = (
        placed.withColumn("place", F.row_number().over(within) - 1)
        .join(counts, ["source_key", "size", "block"]).join(rates, ["source_key", "size"])
    )
    at = F.col("before") + F.col("rate") * (F.col("ahead") + F.col("place"))
    copies = (F.floor(at + F.col("rate") + 0.5 - 1e-9) - F.floor(at + 0.5 - 1e-9)).cast("long")
    return placed.withColumn("copies", F.least(copies, F.lit(int(MOST)))).select(
        "doc_id", *(["source_key"] if keep_source else []), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


MIXED = ("size", "source_size", "target", "copies", "taken")


def mixture(docs: DataFrame) -> DataFrame:
    """``docs`` that the mix takes, with how often: the columns of ``MIXED`` are added
    (or replaced).  Rows of one id, source and size (those without an id, too) share
    their copies evenly; where these do not divide, some rows have one more."""
    base = docs.select([c for c in docs.columns if c not in MIXED])
    own = ("id", "key", "size", "source_size", "target", "copies", "rows", "place", "taken")
    named_ = dict(zip(own, fresh(docs, *own)))
    name = named_.__getitem__
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    shares = stored(mix(docs.select("doc_id", "source", "text"), keep_source=True).groupBy("doc_id", "source_key", "size").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        F.sum("copies").alias("copies"), F.count("*").alias("rows"),
    ).where("copies > 0"))

    def joined(some: DataFrame) -> DataFrame:
        some = some.toDF(*[name(c) for c in ("id", "key", "size", "source_size", "target", "copies", "rows")])
        # one row a document: merged at every size, never broadcast while small
        return base.join(
            some.hint("merge"),
            F.col("doc_id").eqNullSafe(F.col(name("id"))) & (key == F.col(name("key"))) & (size_of(F.col("text")) == F.col(name("size"))),
        )

    def named(rows: DataFrame, copies: Column) -> DataFrame:
        rows = rows.withColumn(name("copies"), copies)
        return rows.select(
            *base.columns, *[F.col(name(c)).alias(c) for c in ("size", "source_size", "target", "copies")],
            (F.col(name("copies")) * F.col(name("size"))).alias("taken"),
        )

    even = F.col("copies") % F.col("rows") == 0
    out = named(joined(shares.where(even)), (F.col(name("copies")) / F.col(name("rows"))).cast("long"))
    # only rows whose copies do not divide are numbered; mostly there are none
    uneven = stored(shares.where(~even))
    if uneven.isEmpty():
        return out
    numbers = Window.partitionBy(*map(name, ("id", "key", "size"))).orderBy(F.xxhash64("text"))
    upto = lambda i: F.floor(i * F.col(name("copies")) / F.col(name("rows"))).cast("long")
    place = F.row_number().over(numbers)
    numbered = joined(uneven).withColumn(name("place"), place)
    rest = named(numbered, upto(F.col(name("place"))) - upto(F.col(name("place")) - 1))
    return out.union(rest.where("copies > 0"))
