"""Quality rules: counts of a text and a hashed n-gram log-likelihood ratio.

Two multinomials over the same hashed n-grams, of trusted documents and of the raw
corpus, give every n-gram a weight; a document's mean weight per n-gram is compared
with a fixed threshold.  Everything is column expressions: weights are a literal
array of a fixed length, so scoring needs neither a join nor a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.session import pinned

#: Hashed n-grams; a power of two.
BUCKET_BITS = 16
#: Added to every count.
SMOOTHING = 1.0
#: Least mean log-likelihood ratio of a kept document.
THRESHOLD = -0.3
#: Words of a window (an even number) for the repetition rule.
WINDOW = 8
LEAST_WORDS = 20
REPEATED_PERCENT = 30

_BLANK = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _BLANK), lambda w: w != "")


def hashed(df: DataFrame) -> DataFrame:
    """Add ``words``, ``hashes`` of them and ``pairs`` of neighbouring hashes."""
    df = pinned(df, words=words_of(F.col("text")))
    df = pinned(df, hashes=F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("hashes")
    pair = lambda i: F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1))
    return pinned(df, pairs=F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), pair)).otherwise(
        F.array().cast("array<bigint>")
    ))


def repeated_words(pairs: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more, from pair hashes.

    Sorting (hash, place) puts equal windows side by side; linear passes do the rest.
    """
    n = F.size(pairs) + 1
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(pairs, i + k) for k in range(0, WINDOW, 2)])
    ))

    def covered(sorted_: Column) -> Column:
        same = lambda p, q: F.coalesce(p["h"] == q["h"], F.lit(False))
        before = lambda i: F.when(i > 0, F.get(sorted_, i - 1))
        again = F.filter(sorted_, lambda p, i: same(p, before(i)) | same(p, F.get(sorted_, i + 1)))
        places = F.array_sort(F.transform(again, lambda p: p["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
        return F.aggregate(
            places, start,
            lambda a, i: F.struct(
                (a["n"] + i + WINDOW - F.greatest(i, a["upto"])).cast("long").alias("n"), (i + WINDOW).alias("upto")
            ),
            lambda a: a["n"],
        )

    # the sorted array is bound once by passing it through a lambda
    def count(w: Column) -> Column:
        made = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.element_at(F.transform(F.array(made), covered), 1)

    several = F.transform(F.array(windows), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), count(w)))
    return F.coalesce(F.when(n >= WINDOW, F.element_at(several, 1)), F.lit(0)).cast("long")


def grams() -> Column:
    """Buckets of a text's words, word endings and word pairs; for rows of ``hashed``."""
    bucket = lambda h: F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")
    ending = lambda w: bucket(F.xxhash64(F.lit(1), F.right(w, F.lit(2))))
    return F.concat(F.transform("hashes", bucket), F.transform("words", ending), F.transform("pairs", bucket))


def weights(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """Log-likelihood ratio of every bucket, trusted documents against all.

    All documents and all ids in ``trusted`` are counted; ids that repeat count once.
    Without trusted text, or any text at all, every weight is zero.
    """
    size = 1 << BUCKET_BITS
    ids = trusted.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    # the ids grow with the corpus: merged at every size, never broadcast while few
    marked = docs.select("doc_id", "text").join(ids.withColumn("known", F.lit(1)).hint("merge"), "doc_id", "left")
    rows = hashed(marked).select("known", F.explode(grams()).alias("bucket"))
    # at most one row a bucket comes to the driver
    found = rows.groupBy("bucket").agg(F.count("*").alias("r"), F.count("known").alias("t")).collect()
    r_all, t_all = sum(x.r for x in found), sum(x.t for x in found)
    if not t_all:
        return [0.0] * size
    of = lambda n, total: math.log((n + SMOOTHING) / (total + SMOOTHING * size))
    out = [of(0, t_all) - of(0, r_all)] * size
    for x in found:
        out[x.bucket] = of(x.t, t_all) - of(x.r, r_all)
    return out


def judge(docs: DataFrame, table: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Counts and verdict of every document, one row per row; no shuffle.

    Null and empty texts have zero counts, fail the base rule and are not kept; ties
    with the threshold are kept; repeated rows are judged each; further columns are
    not read.
    """
    literal = F.split(F.lit(",".join(f"{w:.9g}" for w in table)), ",").cast("array<double>")
    text = F.coalesce("text", F.lit(""))
    rows = pinned(hashed(docs.select("doc_id", text.alias("text"))), grams=grams())
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.translate("text", "#*$%&|<>", "")
    score = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get(literal, g))
    rows = pinned(
        rows,
        n_words=F.size("words").cast("long"),
        word_chars=F.char_length(F.regexp_replace("text", _BLANK, "")).cast("long"),
        n_symbols=(F.char_length("text") - F.char_length(symbols)).cast("long"),
        n_dup_lines=F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long"),
        n_repeat_words=repeated_words(F.col("pairs")),
        llr=F.when(F.size("grams") > 0, score / F.size("grams")).otherwise(0.0),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr",
    )


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rules with the documents labelled good and not toxic as trusted target."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    return judge(docs, weights(docs, good))
