"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an equal line, or one within one word edit, stands at an earlier
(document, line).  Lines equal by hash are counted once.  A line within one edit of
another shares the first or the last half of its words with it, so lines whose halves
nobody shares are set aside first.  The others emit every variant within the bound as a
hashed key: the words without the i-th, and the words as they are split at i, each with
i.  Lines with an equal variant are compared with the earliest of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import fresh, stored
from spanveil.session import pinned

#: Lines of fewer words must be equal; from here one edit leaves 0.8 of the words.
LEAST_WORDS = 5
#: Words hashed at a time in running hashes, and words from which such chunks are cut.
_CHUNK = 32
_PART = 8192
_BLANK = r"[\x20\x09-\x0D]+"


def words_of(line: Column) -> Column:
    return F.filter(F.split(line, _BLANK), lambda w: w != "")


def _text_key() -> Column:
    """Tells rows of one id apart; rows equal in id and text are decided alike."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, line_no, line, h1, h2) of every line with a word in it."""
    split = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    # generators take the outer form: for the inner one Catalyst infers a filter on the
    # array's size and computes the array twice
    rows = split.select("doc_id", _text_key(), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit("line"), "line")})


#: Half keys of a line: as the shorter and as the longer of a pair, first and last half.
_HALVES = ("k0", "k1", "k2", "k3")


def _halves(words: Column) -> Column:
    """Struct of ``_HALVES`` from word hashes; the even ones are first halves."""
    n = F.size(words)
    keys = []
    for shorter in (n, n - 1):
        half = F.floor((shorter - 1) / 2).cast("int")
        first, last = F.slice(words, F.lit(1), half), F.slice(words, n - half + 1, half)
        keys += [F.xxhash64(shorter, F.lit("first"), first), F.xxhash64(shorter, F.lit("last"), last)]
    return F.struct(*[k.alias(c) for k, c in zip(keys, _HALVES)])


def _cut(xs: Column, size: int) -> Column:
    """Consecutive pieces of an array; each cut copies the whole array."""
    places = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")))
    return F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda c: F.slice(xs, c * size + 1, size))


def _running(hashes: Column) -> Column:
    """Hash of the first k words for k = 0..n: whole chunks are chained, and only the rest of
    a chunk is hashed anew.  Chunks are cut from parts, so that no cut copies a long line."""
    chunks = F.flatten(F.transform(_cut(hashes, _PART), lambda part: _cut(part, _CHUNK)))

    def each(held: Column) -> Column:
        cut = held["chunks"]
        chained = F.aggregate(
            F.filter(cut, lambda c: F.size(c) == _CHUNK), F.array(F.lit(0).cast("long")),
            lambda a, c: F.concat(a, F.array(F.xxhash64(F.element_at(a, -1), c))),
        )

        def along(chain: Column) -> Column:
            none = F.array().cast("array<long>")

            def upto(k: Column) -> Column:
                c = F.floor(k / _CHUNK).cast("int")
                rest = F.coalesce(F.slice(F.get(cut, c), F.lit(1), k - c * _CHUNK), none)
                return F.xxhash64(F.get(chain, c), rest)

            return F.transform(F.sequence(F.lit(0), F.size(hashes)), upto)

        return F.element_at(F.transform(F.array(chained), along), 1)

    return F.element_at(F.transform(F.array(F.struct(chunks.alias("chunks"))), each), 1)


def _variants(line: Column, head: Column, tail: Column) -> Column:
    """Hashed variants within one edit, each with its place.

    ``head`` and ``tail`` say which half another line shares: where only the first half
    is shared the edit lies behind it, where only the last is, before it.
    """
    hashes = F.transform(words_of(line), lambda w: F.xxhash64(w))

    def keys(h: Column) -> Column:
        n = F.size(h)
        half = F.floor((n - 2) / 2).cast("int")
        low = F.when(tail, F.lit(1)).otherwise(half + 1)
        high = F.when(head, n + 1).otherwise(n - half + 1)
        both = F.array(F.struct(_running(h).alias("head"), _running(F.reverse(h)).alias("tail")))

        def made(b: Column) -> Column:
            shorter = F.transform(F.sequence(low, F.least(high, n)), lambda i: F.xxhash64(i, F.get(b["head"], i - 1), F.get(b["tail"], n - i)))
            whole = F.transform(F.sequence(low, high), lambda i: F.xxhash64(i, F.get(b["head"], i - 1), F.get(b["tail"], n - i + 1)))
            return F.concat(shorter, whole)

        return F.element_at(F.transform(both, made), 1)

    return F.element_at(F.transform(F.array(hashes), keys), 1)


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one inserted, deleted or changed word."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    rest = lambda w, i: F.slice(w, i, F.greatest(F.size(w) - i + 1, F.lit(0)))
    return (
        (at == 0) | (rest(a, at + 1) == rest(b, at + 1))
        | (rest(a, at + 1) == rest(b, at)) | (rest(a, at) == rest(b, at + 1))
    )


def _near(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(h1, h2) of lines with an earlier line within one edit.

    ``groups`` has the distinct lines with the place where each stands first and its halves.
    """
    halves = F.array(*[
        F.struct(F.col(k).alias("key"), F.lit(i % 2 == 0).alias("head")) for i, k in enumerate(_HALVES)
    ])
    keyed = groups.where("k0 IS NOT NULL").select("doc_id", "line_no", "h1", F.explode_outer(halves).alias("k"))
    keyed = keyed.select("doc_id", "line_no", "h1", "k.*")
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    # what follows grows with the corpus, so it is merged at every size, never broadcast
    spots = keyed.join(shared.hint("merge"), "key", "left_semi").groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct("line_no", "h1", "head"))).alias("spots")
    )

    def whole(s: Column, i: Column) -> Column:
        """A spot with what the one before it, of the same line, says; null if another follows."""
        held = F.col("spots")
        same = lambda o: (o["line_no"] == s["line_no"]) & (o["h1"] == s["h1"])
        also = F.coalesce(same(F.get(held, i - 1)), F.lit(False))
        made = F.struct(s["line_no"].alias("line_no"), s["h1"].alias("h1"), s["head"].alias("head"), (~s["head"] | also).alias("tail"))
        return F.when(~F.coalesce(same(F.get(held, i + 1)), F.lit(False)), made)

    spots = spots.withColumn("spots", F.filter(F.transform("spots", whole), lambda x: x.isNotNull()))
    # each passing line is read once more, where it stands first; a document's own list only
    found = docs.select("doc_id", "text").join(spots.hint("merge"), "doc_id")
    found = pinned(found, lines=F.split("text", "\n")).select(
        "doc_id", "lines", F.explode("spots").alias("spot")
    ).select("doc_id", "spot.*", F.get("lines", F.col("spot.line_no")).alias("line"))
    # dealt anew, as few lines make many variants
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = stored(
        found.where(F.xxhash64("line") == F.col("h1")).withColumn("h2", F.xxhash64(F.lit("line"), "line"))
        .repartition(parts, "h1", "h2").dropDuplicates(["h1", "h2"])
    )
    place = F.struct("doc_id", "line_no", "h1", "h2")
    variants = _variants(F.col("line"), F.col("head"), F.col("tail"))
    emitted = lines.select(F.explode_outer(variants).alias("variant"), place.alias("here"))
    leads = stored(
        emitted.groupBy("variant").agg(F.min("here").alias("lead"), F.count("*").alias("n"))
        .where("n > 1").select("variant", "lead")
    )
    pairs = emitted.join(leads, "variant").where("here > lead").select(
        F.col("here.h1").alias("h1"), F.col("here.h2").alias("h2"),
        F.col("lead.h1").alias("lead_h1"), F.col("lead.h2").alias("lead_h2"),
    ).distinct()
    one = lines.select("h1", "h2", "line")
    two = lines.select(F.col("h1").alias("lead_h1"), F.col("h2").alias("lead_h2"), F.col("line").alias("lead_line"))
    both = pairs.join(one, ["h1", "h2"]).join(two, ["lead_h1", "lead_h2"])
    return both.where(within_one_edit(words_of(F.col("line")), words_of(F.col("lead_line")))).select("h1", "h2").distinct()


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, removed): line numbers, ascending from 0, that go from a document.

    Documents that lose none are absent.
    """
    rows = lines_of(docs)
    lines = rows.select("doc_id", "text_key", "line_no", "h1", "h2")
    hashes = F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w))
    halves = F.element_at(F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= LEAST_WORDS, _halves(h))), 1)
    # one scan gives the places and the halves of all lines
    groups = stored(
        pinned(rows.select("doc_id", "line_no", "line", "h1", "h2"), halves=halves).groupBy("h1", "h2").agg(
            F.min(F.struct("doc_id", "line_no")).alias("first"), (F.count("*") > 1).alias("several"),
            *[F.first(f"halves.{k}").alias(k) for k in _HALVES],
        ).select("h1", "h2", "first.*", "several", *_HALVES)
    )
    near = stored(_near(docs, groups))
    decided = groups.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("several or near")
    decided = stored(decided.select(
        "h1", "h2", F.struct("doc_id", "line_no").alias("first"), F.coalesce("near", F.lit(False)).alias("near")
    ))
    gone = lines.join(decided, ["h1", "h2"]).where(F.col("near") | (F.struct("doc_id", "line_no") > F.col("first")))
    return gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def without_duplicate_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with duplicate lines cut from ``text``; documents left without a line go.

    Other columns stay as they are, but ``n_chars`` is counted anew where it exists.
    Blank lines stay in a kept document.  Null texts, texts without a line that has a
    word, and rows without an id are kept unchanged.  Rows equal in id and text are
    treated alike; within one id the earliest line is kept in all of them.
    """
    id_, key, gone, new = fresh(docs, "id", "key", "removed", "text")
    removed = duplicate_lines(docs.select("doc_id", "text")).toDF(id_, key, gone)
    joined = docs.join(removed, (F.col("doc_id") == F.col(id_)) & (_text_key() == F.col(key)), "left")
    lines = F.split("text", "\n")
    rest = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i)
    )
    cut = F.col(gone).isNotNull()
    text = F.when(cut, F.array_join(rest, "\n")).otherwise(F.col("text"))
    # a generator computes the new text once, for the filter and the columns
    out = joined.withColumn(new, F.explode(F.array(text))).where(~cut | F.col(new).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length(new).cast("long")).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(new)).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed_lines): one row per row of ``docs``.

    ``n_lines`` counts lines with a word.  Null and empty texts have none; rows
    without an id lose none; repeated rows report alike; further columns are not read.
    Of equal lines the one at the smallest (document, line) stays.  A line may be as long as
    its text: hashing its variants takes time in proportion to its words.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", _text_key(), F.size(lines).cast("long").alias("n_lines"))
    return rows.join(duplicate_lines(docs), ["doc_id", "text_key"], "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
    )


#: DuckDB statement for ``report``.
SQL = r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line_no, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
  WHERE regexp_matches(string_split(text, chr(10))[i], '[^\x20\x09-\x0D]')
), firsts AS (
  SELECT line, min(row(doc_id, line_no)) AS f,
    list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM lines GROUP BY line
), places AS (
  SELECT line, f, w, unnest(range(1, len(w) + 2)) AS i FROM firsts WHERE len(w) >= 5
), variants AS (
  SELECT line, f, i, array_to_string(w[1:i - 1], ' ') || chr(1) || array_to_string(w[i:], ' ') AS v FROM places
  UNION ALL
  SELECT line, f, i, array_to_string(w[1:i - 1], ' ') || chr(1) || array_to_string(w[i + 1:], ' ')
  FROM places WHERE i <= len(w)
), leads AS (
  SELECT i, v, min(f) AS f FROM variants GROUP BY i, v HAVING count(*) > 1
), near AS (
  SELECT DISTINCT a.line FROM variants a JOIN leads b ON a.i = b.i AND a.v = b.v AND a.f > b.f
), gone AS (
  SELECT l.doc_id, l.line_no FROM lines l JOIN firsts f ON l.line = f.line
  WHERE row(l.doc_id, l.line_no) > f.f OR l.line IN (SELECT line FROM near)
), lost AS (
  SELECT doc_id, count(*) AS n, string_agg(line_no::varchar, ',' ORDER BY line_no) AS removed FROM gone GROUP BY doc_id
), counted AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(l.n, 0) AS n_removed, coalesce(l.removed, '') AS removed_lines
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id LEFT JOIN lost l ON d.doc_id = l.doc_id
"""
