"""I-Match fingerprints in DataFrame functions only.

A text's terms are its distinct lower-cased runs of letters and digits.  Those whose
document frequency lies in a band form the lexicon: frequent terms stand in every text,
rare ones are mostly slips.  A fingerprint has one hash for each of several randomised
subsets of the lexicon, over the sorted terms of the text in that subset.

Frequencies are counted for ``BUCKETS`` hash buckets of terms, so the lexicon is a bit
mask of fixed size, which goes into the plan and is read in the row of a document.  A
bucket's share of rare terms is about (terms a document) / ``BUCKETS`` of all documents,
far below the band's lower end at every size of the corpus.

A hash survives an edit only if no term of its subset is touched, so subsets should hold
about one term of the text.  They are drawn at levels: level k takes a term with
probability 2**-k, and a text uses the two levels next to the logarithm of its number of
terms.  Two fingerprints are compared on a level that both have; texts so different in
size that they share none are unlike.

The next document is read by a window over blocks of the id order.  The first row of a
block is dealt to the block before it as well, so texts are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets in which document frequencies are counted.
BUCKETS = 1 << 20
#: Band of document frequency, as shares of all documents.
BAND = (0.002, 0.1)
#: Texts with fewer terms in the band use all their terms.
LEAST_TERMS = 8
#: Randomised subsets of the lexicon at each of the two levels of a text.
SUBSETS = 32
#: Blocks of the id order for each shuffle partition.
BLOCKS = 8
_HASH = 65_535
_NOT_TERM = r"[^\p{L}\p{N}]+"


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, inside one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def terms(text: Column) -> Column:
    """64-bit hashes of the distinct terms; a text without any is one term itself."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), _NOT_TERM), lambda w: w != ""))
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x, F.lit("term")))
    return once(words, lambda w: F.when(F.size(w) > 0, hashes(w)).otherwise(F.array(F.xxhash64(text))))


def _bucket(term: Column) -> Column:
    return term.bitwiseAND(F.lit(BUCKETS - 1))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> list[int]:
    """Bit mask of the buckets in the band, 64 a number.

    The driver gets at most ``BUCKETS / 64`` numbers.
    """
    found = docs.select(F.transform(terms(F.coalesce("text", F.lit(""))), _bucket).alias("buckets"))
    counts = found.select(F.explode_outer(F.array_distinct("buckets")).alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("df")
    )
    total = docs.count()
    kept = counts.where((F.col("df") >= band[0] * total) & (F.col("df") <= band[1] * total))
    words = kept.groupBy(F.shiftright("bucket", 6).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bucket & 63 AS int))")).alias("bits")
    )
    mask = [0] * (BUCKETS // 64)
    for r in words.collect():
        mask[r["at"]] = r["bits"]
    return mask


def fingerprint(text: Column, mask: Column) -> Column:
    """Array of 1 + 2 * ``SUBSETS`` numbers: the lower level, its hashes, those of the next.

    A hash is 0 where the text has no term of the subset.
    """

    def kept(found: Column) -> Column:
        def inside(t: Column) -> Column:
            word = F.get(mask, F.shiftright(_bucket(t), 6).cast("int"))
            return F.call_function("getbit", word, t.bitwiseAND(F.lit(63)).cast("int")) == 1

        some = F.filter(found, inside)
        return once(some, lambda s: F.sort_array(F.when(F.size(s) >= LEAST_TERMS, s).otherwise(found)))

    def hashed(sorted_terms: Column) -> Column:
        level = F.floor(F.log2(F.size(sorted_terms).cast("double"))).cast("int")

        def at(k: Column, salt: int) -> Column:
            # the subset of a term at level k: 2**k of them when these are fewer than all
            spread = F.call_function("shiftleft", F.lit(1).cast("long"), k)
            drawn = F.transform(sorted_terms, lambda t: F.struct(
                F.shiftrightunsigned(F.xxhash64(t, F.lit(salt)), 8).bitwiseAND(F.greatest(spread, F.lit(1).cast("long")) - 1).alias("subset"),
                t.alias("term"),
            ))
            drawn = F.filter(drawn, lambda x: x["subset"] < SUBSETS)

            def one(d: Column, s: Column) -> Column:
                mine = F.filter(d, lambda x: x["subset"] == s)
                return once(mine, lambda m: F.when(F.size(m) > 0, (
                    F.pmod(F.xxhash64(F.transform(m, lambda x: x["term"])), F.lit(_HASH)) + 1
                ).cast("int")).otherwise(F.lit(0)))

            return once(drawn, lambda d: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda s: one(d, s.cast("long"))))

        return once(level, lambda k: F.concat(F.array(k), at(k, 1), at(k + 1, 1)))

    return once(once(terms(text), kept), hashed)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that either text has terms of, 0 to 1.

    Taken on the highest level that both fingerprints have.
    """

    def share(one: Column, two: Column) -> Column:
        pairs = F.zip_with(one, two, lambda x, y: F.when(F.greatest(x, y) > 0, (x == y).cast("int")))
        held = F.filter(pairs, lambda x: x.isNotNull())
        return once(held, lambda h: F.coalesce(
            F.try_divide(F.aggregate(h, F.lit(0), lambda s, x: s + x).cast("double"), F.size(h).cast("double")), F.lit(0.0)
        ))

    low = lambda x: F.slice(x, 2, SUBSETS)
    high = lambda x: F.slice(x, 2 + SUBSETS, SUBSETS)
    step = F.get(b, F.lit(0)) - F.get(a, F.lit(0))
    return (
        F.when(step == 0, share(high(a), high(b))).when(step == 1, share(high(a), low(b)))
        .when(step == -1, share(low(a), high(b))).otherwise(0.0)
    )


def printed(fp: Column) -> Column:
    """Two hexadecimal digits of the level and four of every hash."""
    width = lambda i: F.when(i == 0, 2).otherwise(4)
    return F.array_join(F.transform(fp, lambda x, i: F.lower(F.lpad(F.hex(x.cast("long")), width(i), "0"))), "")


def with_fingerprint(docs: DataFrame, mask: list[int], name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` (null: empty) as an array column."""
    made = fingerprint(F.coalesce("text", F.lit("")), _literal(mask))
    return docs.withColumn(name, F.explode(F.array(made)))


def _literal(mask: list[int]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(str, mask)) + "]"), "array<bigint>")


def with_next(rows: DataFrame, columns: list[str], ids: DataFrame | None = None) -> DataFrame:
    """Add ``next`` (struct of ``columns``), the values of the next row by (doc_id, tie);
    after the last comes the first.

    ``ids`` gives the keys of the same rows where those are cheaper to compute.  The id order
    is cut where Spark's range partitioner cuts it; only the first key of every
    block comes to the driver, ``BLOCKS`` a shuffle partition.
    """
    spark = rows.sparkSession
    blocks = BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct("doc_id", "tie")
    ids = (rows if ids is None else ids).select("doc_id", "tie").repartitionByRange(blocks, "doc_id", "tie")
    firsts = sorted(
        (r.first for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("first")).collect()),
        key=lambda f: (f.doc_id is not None, f.doc_id, f.tie),
    )
    if not firsts:
        return rows.withColumn("next", F.struct(*columns))
    edge = F.from_json(
        F.lit("[" + ",".join(f'{{"doc_id":{"null" if f.doc_id is None else f.doc_id},"tie":{f.tie}}}' for f in firsts) + "]"),
        "array<struct<doc_id:bigint,tie:bigint>>",
    )
    here = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("tie").alias("tie"))
    n = len(firsts)

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"] + 1) / 2).cast("int")
        up = F.get(edge, middle) <= here
        return F.struct(
            F.when(up, middle).otherwise(span["low"]).alias("low"),
            F.when(up, span["high"]).otherwise(middle - 1).alias("high"),
        )

    steps = F.array(*[F.lit(i) for i in range(max(1, (n - 1).bit_length()))])
    start = F.struct(F.lit(0).alias("low"), F.lit(n - 1).alias("high"))
    # where low = high the middle is that place itself and nothing moves but a first row's high
    place = F.aggregate(steps, start, lambda s, i: once(s, lambda x: F.when(x["low"] < x["high"], halve(x, i)).otherwise(x)))["low"]
    placed = rows.withColumn("block", F.explode(F.array(place)))
    first = F.get(edge, F.col("block")) == here
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.col("block") - 1, F.lit(n)).alias("block"), F.lit(True).alias("guest"))
    dealt = placed.withColumn("seat", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own)))).drop("block")
    dealt = dealt.select("*", "seat.block", "seat.guest").drop("seat")
    along = Window.partitionBy("block").orderBy("guest", "doc_id", "tie")
    return (
        dealt.withColumn("next", F.lead(F.struct(*columns)).over(along))
        .where("NOT guest").drop("block", "guest")
    )


def fingerprint_documents(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    One row per row of ``docs``.  The edited text of a document has its last quarter of code
    points (rounded down) replaced by the first as many, or all, of the next document by
    ``doc_id``; after the last comes the first.  Null texts are empty; null ids come first,
    rows of one id by a hash of their text, so equal texts get equal results whatever the
    input's order.  Texts without letters or digits are one term; an empty text is like
    another empty one only.  Further columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    mask = lexicon(rows, band)
    rows = rows.withColumn("tie", F.xxhash64("text"))
    paired = with_next(with_fingerprint(rows, mask), ["text", "fp"], rows)
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.col("next.text"), F.lit(1), quarter))
    made = paired.select(
        "doc_id", n.cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"),
        F.explode(F.array(edited)).alias("text"),
    )
    made = with_fingerprint(made, mask, "edited_fp")
    return made.select(
        "doc_id", "n_chars", F.sha2("text", 256).alias("edited_sha256"), printed(F.col("fp")).alias("fingerprint"),
        printed(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
