"""Rule tables: validation, safety, screening, inference, testing, acceptance."""

from __future__ import annotations

import re
import sys
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanveil.constants import ALL_CATEGORIES
from spanveil.functions import checksums as ck
from spanveil.functions.text import B0, B1, WB, let, trim_ws
from spanveil.operators.custom_rules import may_match, rule_table
from spanveil.operators.pattern_check import slow
from spanveil.session import pinned, spread

# The grammar of a rule the scanner is willing to run.  It has no
# groups, alternation or lookaround, so only quantifiers need further checks.
_ESCAPE = r"\\[^\r\n]"
_CLASS = r"\[(?:\\.|[^\]\r\n])*\]"
_QUANT = r"(?:[*+?]|\{[0-9]+(?:,[0-9]*)?\})"
SAFE_GRAMMAR = rf"^(?:(?:{_ESCAPE}|[A-Za-z0-9_./:#@,;'\"~!$%&+=-]|{_CLASS}){_QUANT}?)+$"
_ATOM = r"(?:\\[dDwWsSbB]|\[(?:\\.|[^\]])+\]|\\.|[A-Za-z0-9_])"
ADJACENT_QUANTIFIERS = f"{_ATOM}{_QUANT}{_ATOM}{_QUANT}"
NO_BACKREFERENCE = r"^(?:[^\\]|\\[^1-9k])*$"
FLAGS = "^[gim]*$"
_OPTIONAL = r"(?:[*?]|\{0+(?:,[0-9]*)?\})"
MATCHES_EMPTY = rf"^(?:(?:{_ESCAPE}|[A-Za-z0-9_./:#@,;'\"~!$%&+=-]|{_CLASS}){_OPTIONAL}|\\B)+$"
MAX_PATTERN = 512


def _class_out_of_order(pattern: Column) -> Column:
    """A character range that runs backwards does not compile."""
    classes = F.regexp_extract_all(pattern, F.lit(r"\[((?:\\.|[^\]\r\n])*)\]"), F.lit(1))
    plain = F.transform(classes, lambda c: F.regexp_replace(c, r"\\.", ""))
    spans = F.flatten(
        F.transform(plain, lambda c: F.regexp_extract_all(c, F.lit("(.-.)"), F.lit(1)))
    )
    return F.exists(spans, lambda r: F.ascii(F.substring(r, 1, 1)) > F.ascii(F.substring(r, 3, 1)))


def _count_out_of_order(pattern: Column) -> Column:
    """{n,m} with n above m does not compile."""
    pairs = F.regexp_extract_all(pattern, F.lit(r"\{([0-9]+,[0-9]+)\}"), F.lit(1))
    return F.exists(
        pairs,
        lambda p: F.get(F.split(p, ","), F.lit(0)).try_cast("bigint")
        > F.get(F.split(p, ","), F.lit(1)).try_cast("bigint"),
    )


def safe_regex(pattern: Column, flags: Column, limit: int = MAX_PATTERN) -> Column:
    """True when the scanner may run a rule's pattern."""
    ok = (
        F.length(pattern).between(1, limit)
        & pattern.rlike(SAFE_GRAMMAR)
        & flags.rlike(FLAGS)
        & ~pattern.rlike(ADJACENT_QUANTIFIERS)
        & pattern.rlike(NO_BACKREFERENCE)
        & ~_class_out_of_order(pattern)
        & ~_count_out_of_order(pattern)
        & ~pattern.rlike(MATCHES_EMPTY)
    )
    return F.coalesce(ok, F.lit(False))


def may_match_empty(pattern: Column) -> Column:
    """True when every atom is optional or of zero width, so a match may be empty."""
    atoms = rf"(?:{_ESCAPE}|[A-Za-z0-9_./:#@,;'\"~!$%&+=-]|{_CLASS}){_OPTIONAL}"
    return pattern.rlike(rf"^(?:\\[bB]{_QUANT}?|{atoms})+$")


# Statuses of a contributed rule.
STATUSES = ["local_only", "submitted", "under_review", "accepted", "rejected"]


def validate_rules(rules: DataFrame) -> DataFrame:
    """Add ``error`` (first broken rule, null when valid); coerce lenient fields."""
    c = F.col
    cues_ok = c("context_cues").isNull() | (
        (F.size("context_cues") <= 10)
        & F.forall("context_cues", lambda x: F.coalesce(F.length(x).between(1, 40), F.lit(False)))
    )
    checks = [
        ("id", c("id").rlike("^[0-9a-f-]{36}$")),
        ("name", F.length("name").between(1, 80)),
        ("category", c("category").isin(ALL_CATEGORIES)),
        ("pattern", F.length("pattern").between(1, MAX_PATTERN)),
        ("flags", c("flags").rlike(FLAGS) & (F.length("flags") <= 4)),
        ("unsafe", safe_regex(c("pattern"), c("flags"))),
        ("confidence", c("confidence").between(0, 1)),
        ("context_cues", cues_ok),
        ("min_length", c("min_length").isNull() | (c("min_length") >= 1)),
        ("max_length", c("max_length").isNull() | (c("max_length") >= 1)),
        ("length_order", c("min_length").isNull() | c("max_length").isNull()
         | (c("min_length") <= c("max_length"))),
        ("created_at", F.length("created_at") > 0),
        ("source", c("source").isin("local", "community")),
    ]
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in checks])
    return rules.withColumns({
        "error": error,
        "capture_group": F.when(c("capture_group").between(0, 9), c("capture_group")).otherwise(0),
        "contribution_status": F.when(
            c("contribution_status").isin(STATUSES), c("contribution_status")
        ).otherwise("local_only"),
    })


def community_rule_valid(r, size_limit: int = 500) -> Column:
    """Validity of a community rule; ``r`` maps a field name to its column."""
    votes = [F.coalesce(r(v).between(0, 1_000_000), F.lit(False))
             for v in ("total_votes", "upvotes", "downvotes")]
    ok = (
        r("rule_id").rlike("^[A-Za-z0-9_-]{1,64}$")
        & F.length(r("name")).between(1, 120)
        & r("category").isin(ALL_CATEGORIES)
        & F.length(r("pattern")).between(1, size_limit)
        & r("flags").rlike(FLAGS) & (F.length(r("flags")) <= 4)
        & r("confidence").between(0, 1)
        & reduce(lambda a, b: a & b, votes)
        & (F.length(r("created_by_handle")) <= 64)
        & r("created_at").try_cast("timestamp").isNotNull()
        & (F.length(r("verification_status")) <= 32)
        & safe_regex(r("pattern"), r("flags"))
    )
    return F.coalesce(ok, F.lit(False))


def upsert(existing: DataFrame, updates: DataFrame, deleted: DataFrame | None = None,
           keep: int | None = None) -> DataFrame:
    """Replace by id, else append; with ``keep`` only the first so many per owner stay.

    Both inputs carry (owner, pos, id, ...); updates come after all existing
    positions.  A replaced rule keeps its place.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    if deleted is not None:
        both = both.join(deleted.select("owner", "id"), ["owner", "id"], "left_anti")
    payload = [c for c in existing.columns if c not in ("owner", "id", "pos")]
    merged = both.groupBy("owner", "id").agg(
        F.min(F.struct("_new", "pos")).alias("_place"),
        F.max_by(F.struct(*payload), F.struct("_new", "pos")).alias("_row"),
    )
    order = Window.partitionBy("owner").orderBy("_place")
    placed = merged.withColumn("pos", F.row_number().over(order))
    return (
        (placed if keep is None else placed.filter(F.col("pos") <= keep))
        .select("owner", "id", F.col("pos").cast("bigint").alias("pos"), "_row.*")
    )


# Full-width forms fold to ASCII; no identifier is defined over other digits.
_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "\u3000\u00a0"
_NARROW = "".join(chr(0x21 + i) for i in range(94)) + "  "
EMAIL_LITERAL = r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}{2,}"
DEA_LITERAL = f"{B0}[A-Za-z][A-Za-z0-9]{{8,10}}{B1}"
NUMERIC_LITERAL = r"-?[0-9][0-9./-]{4,24}[0-9]|[0-9]{6,19}"
# Kinds a bare digit string can satisfy.
DIGIT_KINDS = ["ssn", "itin", "nhs", "npi", "cusip", "sedol", "canadian_sin", "aadhaar",
               "australian_tfn", "cpf"]


def fold_for_screen(text: Column) -> Column:
    wide = F.translate(text, _WIDE, _NARROW)
    return F.regexp_replace(wide, r"[\s\x{2010}-\x{2015}\x{2212}\x{2043}]+", "-")


def literal_kind(text: Column) -> Column:
    """Kind of personal data written literally in a rule field, else null."""

    def judge(scan: Column) -> Column:
        dea = F.exists(F.regexp_extract_all(scan, F.lit(DEA_LITERAL), F.lit(0)), ck.valid_dea)
        runs = F.transform(
            F.regexp_extract_all(scan, F.lit(NUMERIC_LITERAL), F.lit(0)),
            lambda r: F.regexp_replace(r, "[./-]", ""),
        )

        def real(d: Column) -> Column:
            kinds = [ck.VALIDATORS[k](d) for k in DIGIT_KINDS] + [ck.is_luhn(d)]
            return F.length(d).between(6, 19) & reduce(lambda a, b: a | b, kinds)

        return (
            F.when(scan.rlike(EMAIL_LITERAL), "email address")
            .when(dea, "provider identifier")
            .when(F.exists(runs, real), "government or provider identifier")
        )

    return let(fold_for_screen(text), judge)


def screen_rules(rules: DataFrame) -> DataFrame:
    """First field that holds literal personal data: field and kind, never the value."""
    fields = F.concat(
        F.array(
            F.struct(F.lit("name").alias("field"), F.col("name").alias("text")),
            F.struct(F.lit("pattern").alias("field"), F.col("pattern").alias("text")),
        ),
        F.transform(
            F.coalesce("context_cues", F.expr("cast(array() as array<string>)")),
            lambda c: F.struct(F.lit("contextCue").alias("field"), c.alias("text")),
        ),
    )
    judged = F.transform(fields, lambda f: F.struct(f["field"].alias("field"), literal_kind(f["text"]).alias("kind")))
    first = F.get(F.filter(judged, lambda j: j["kind"].isNotNull()), F.lit(0))
    return rules.withColumn("_hit", first).select(
        *rules.columns, F.col("_hit.field").alias("blocked_field"), F.col("_hit.kind").alias("blocked_kind"),
        F.col("_hit").isNull().alias("safe"),
    )


def contribution_payload(rules: DataFrame) -> DataFrame:
    """The shareable part of a rule: no id, time, origin or status."""
    return rules.select(
        "name", "category", "pattern", "flags", "capture_group", "confidence", "context_cues",
        "min_length", "max_length",
    )


# Workers may not have the package installed; ship this module with the function.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(T.BooleanType())
def _compiles(patterns: pd.Series) -> pd.Series:
    """Compile check; runs on the rules table only, never on texts."""
    import re

    def ok(p):
        try:
            re.compile(p or "")
            return True
        except re.error:
            return False

    return patterns.map(ok)


def submission_check(submissions: DataFrame) -> DataFrame:
    """Add ``error`` and trim what would be sent; blank cues go."""
    blank = {c: F.coalesce(trim_ws(F.col(c)), F.lit("")) == "" for c in ("rule_name", "pattern", "category")}
    error = (
        F.when(blank["rule_name"], "Rule name is required.")
        .when(blank["pattern"], "Regex pattern is required.")
        .when(blank["category"], "Category is required.")
        .when(~_compiles(F.col("pattern")), "Invalid regular expression pattern.")
    )
    cues = F.filter(F.transform("cues", trim_ws), lambda c: c != "")
    return submissions.select(
        "submission_id", error.alias("error"), trim_ws(F.col("rule_name")).alias("rule_name"),
        trim_ws(F.col("category")).alias("category"), trim_ws(F.col("pattern")).alias("pattern"),
        F.coalesce(cues, F.expr("cast(array() as array<string>)")).alias("cues"),
    )


# ---- inference -----------------------------------------------------------------
MAX_EXAMPLES = 50
_EMPTY = "cast(array() as array<string>)"
# Separators in order of preference; classes in order of preference.
SEPARATORS = ["-", ".", "/", "_", " "]
CLASSES = [("[A-Z]", "[A-Z]"), ("[a-z]", "[a-z]"), ("[0-9]", "\\d"), ("[-./_ ]", "[-./_ ]")]
# Caveats reported with an inferred pattern.
LIMIT_FEW = "Fewer than 5 examples were provided. More examples improve pattern quality."
LIMIT_LOOSE = (
    "No common prefix or separator was detected. The pattern may have a higher false-positive rate."
)
LIMIT_PROPOSED = (
    "This is a proposed pattern only. Test it thoroughly before adding it to your local logic."
)
LIMIT_NEGATIVE = "The proposed pattern matched at least one negative example. Review it before saving."


def _generalize(text: Column) -> Column:
    """Literal text as a pattern that keeps its shape and drops its content."""

    def shape(c: Column) -> Column:
        return (
            F.when(c.rlike("[A-Z]"), "[A-Z]").when(c.rlike("[a-z]"), "[a-z]")
            .when(c.rlike("[0-9]"), "\\d").when(c.rlike(r"[^\x20-\x7E]"), ".")
            .when(c.rlike(r"[.*+?^${}()|\[\]\\]"), F.concat(F.lit("\\"), c)).otherwise(c)
        )

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, shape), "")


def _common_prefix(examples: Column, need: Column) -> Column:
    """Leading characters of the shortest example shared by enough examples."""
    shortest = F.array_min(
        F.transform(examples, lambda e, i: F.struct(F.length(e).alias("n"), i.alias("i"), e.alias("e")))
    )["e"]

    def build(s: Column) -> Column:
        chars = F.filter(F.split(s, ""), lambda c: c != "")
        shared = F.transform(
            chars,
            lambda c, i: F.size(F.filter(examples, lambda e: F.substr(e, i + 1, F.lit(1)) == c)) >= need,
        )
        stop = F.array_position(shared, F.lit(False))
        return F.when(stop > 0, F.substr(s, F.lit(1), (stop - 1).cast("int"))).otherwise(s)

    return let(shortest, build)


def _strip(e: Column, prefix: Column, suffix: Column) -> Column:
    b = F.when((prefix != "") & e.startswith(prefix), F.substr(e, F.length(prefix) + 1)).otherwise(e)
    cut = F.substr(b, F.lit(1), F.length(b) - F.length(suffix))
    return F.when((suffix != "") & b.endswith(suffix), cut).otherwise(b)


def _token_pattern(parts: Column) -> Column:
    """Dominant character class and length range of a list of strings."""
    joined = F.array_join(parts, "")

    def with_counts(j: Column) -> Column:
        known = [F.regexp_count(j, F.lit(p)) for p, _ in CLASSES]
        counts = F.array(*known, F.length(j) - reduce(lambda a, b: a + b, known))
        best = F.when(F.length(j) == 0, 5).otherwise(F.array_position(counts, F.array_max(counts)))
        return F.get(F.lit([p for _, p in CLASSES] + ["."]), (best - 1).cast("int"))

    lengths = F.transform(parts, lambda p: F.length(p))
    low, high = F.array_min(lengths), F.array_max(lengths)
    count = F.when(low == high, F.concat(F.lit("{"), low, F.lit("}"))).otherwise(
        F.concat(F.lit("{"), low, F.lit(","), high, F.lit("}"))
    )
    return F.concat(let(joined, with_counts), count)


def infer_rules(examples: DataFrame, keep: int | None = MAX_EXAMPLES) -> DataFrame:
    """Propose one pattern per rule_id from (rule_id, example, ord, is_positive).

    The first ``keep`` positive examples of a rule count (None: all); they are chosen
    by rank before anything is gathered.
    """
    trimmed = examples.withColumn("example", trim_ws(F.col("example"))).filter("example <> ''")
    by_rule = Window.partitionBy("rule_id").orderBy("ord")
    positive = (
        trimmed.filter("is_positive").withColumn("_n", F.row_number().over(by_rule))
        .filter("true" if keep is None else f"_n <= {keep}")
        .groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("ord", "example"))).alias("_s"))
        .select("rule_id", F.transform("_s", lambda x: x["example"]).alias("ex"))
    )
    need = F.ceil(F.size("ex") * F.lit(0.6))
    reversed_ex = F.transform("ex", lambda e: F.reverse(e))
    base = pinned(
        positive,
        prefix=_common_prefix(F.col("ex"), need),
        suffix=F.reverse(_common_prefix(reversed_ex, need)),
    )
    base = pinned(
        base, bodies=F.transform("ex", lambda e: _strip(e, F.col("prefix"), F.col("suffix")))
    )

    def holders(separator: str) -> Column:
        return F.size(F.filter("bodies", lambda b: b.contains(separator)))

    sep = F.coalesce(*[F.when(holders(s) >= need, s) for s in SEPARATORS])
    base = pinned(base, sep=sep)
    quoted = F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E"))
    pieces = F.transform("bodies", lambda b: F.split(b, quoted, -1))

    def body(p: Column) -> Column:
        width = F.array_max(F.transform(p, lambda x: F.size(x)))
        columns = F.transform(
            F.sequence(F.lit(0), width - 1),
            lambda i: F.filter(
                F.transform(p, lambda x: F.coalesce(F.get(x, i), F.lit(""))), lambda v: v != ""
            ),
        )
        used = F.filter(columns, lambda c: F.size(c) > 0)
        escape = F.when(F.col("sep").isin("-", "."), "\\").otherwise("")
        glue = F.concat(escape, F.col("sep"))
        return F.call_function("array_join", F.transform(used, _token_pattern), glue)

    base = pinned(
        base,
        core=F.concat(
            _generalize(F.col("prefix")),
            F.when(F.col("sep").isNotNull(), let(pieces, body)).otherwise(_token_pattern(F.col("bodies"))),
            _generalize(F.col("suffix")),
        ),
    ).withColumn("pattern", F.concat(F.lit("\\b"), "core", F.lit("\\b")))
    runnable = F.concat(F.lit("(?i)" + WB), "core", F.lit(WB))
    base = pinned(base, _re=F.when(safe_regex(F.col("pattern"), F.lit("gi")), runnable))
    hits = F.size(F.filter("ex", lambda e: F.rlike(e, F.col("_re"))))
    scored = base.withColumn("matched", F.when(F.col("_re").isNotNull(), hits).otherwise(0))
    negatives = (
        trimmed.filter("NOT is_positive").select("rule_id", F.col("example").alias("_neg"))
        .join(scored.select("rule_id", "_re"), "rule_id")
        .filter(F.col("_re").isNotNull() & F.rlike(F.col("_neg"), F.col("_re")))
        .select("rule_id").distinct().withColumn("_bad", F.lit(True))
    )
    n = F.size("ex")
    limitations = F.filter(
        F.array(
            F.when(
                F.col("matched") < n,
                F.concat(F.lit("The proposed pattern matched "), "matched", F.lit(" of "), n,
                         F.lit(" examples. Review unmatched examples and adjust.")),
            ),
            F.when(F.col("_bad"), LIMIT_NEGATIVE),
            F.when(n < 5, LIMIT_FEW),
            F.when((F.col("prefix") == "") & F.col("sep").isNull(), LIMIT_LOOSE),
            F.lit(LIMIT_PROPOSED),
        ),
        lambda x: x.isNotNull(),
    )
    proposed = scored.join(negatives, "rule_id", "left").select(
        "rule_id", "pattern", F.lit("gi").alias("flags"),
        (F.col("matched") / n).alias("quality"), limitations.alias("limitations"),
    )
    # A rule without one usable example still gets an answer.
    empty = (
        examples.select("rule_id").distinct().join(proposed.select("rule_id"), "rule_id", "left_anti")
        .select("rule_id", F.lit(".+").alias("pattern"), F.lit("g").alias("flags"),
                F.lit(0.0).alias("quality"),
                F.array(F.lit("No valid examples provided.")).alias("limitations"))
    )
    return proposed.unionByName(empty)


# ---- testing and acceptance ------------------------------------------------------
def collect_rule_list(rules: DataFrame, limit: int | None = None) -> list[Row]:
    rows = rules.withColumn("safe", safe_regex(F.col("pattern"), F.col("flags"))).orderBy(
        "rule_id").collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"more than {limit} rules in one run; split the rule table")
    return rows


def count_matches(
    cases: DataFrame, rules: list[Row], text: str = "text", most: int | None = None, hits_only: bool = True
) -> DataFrame:
    """Match count of every rule on every case (``most`` at most).

    Unsafe rules match nothing.  A rule is run on the texts that hold its required literal.
    With ``hits_only`` only counts above zero leave the row; else every pair has a row, with a
    null count where the text is null.
    """
    keep = [c for c in cases.columns if c != text]
    if not rules:
        return cases.select(*keep, F.lit(None).cast("bigint").alias("rule_id"), F.lit(None).cast("bigint").alias("match_count")).limit(0)

    def counted(rule: Column) -> Column:
        n = F.regexp_count(F.col(text), rule["pattern"])
        return F.struct(
            rule["rule_id"].alias("rule_id"), (n if most is None else F.least(n, F.lit(most))).cast("bigint").alias("match_count")
        )

    if not hits_only:
        def every(low: Column) -> Column:
            none = F.when(low.isNotNull(), F.lit(0).cast("bigint"))

            def pair(rule: Column) -> Column:
                run = rule["safe"] & may_match(low, rule)
                return F.struct(
                    rule["rule_id"].alias("rule_id"),
                    F.when(run, counted(rule)["match_count"]).otherwise(none).alias("match_count"),
                )

            return F.transform(rule_table(rules, "rule_id"), pair)

        pairs = spread(cases).select(*keep, F.explode(let(F.lower(F.col(text)), every)).alias("r"))
        return pairs.select(*keep, "r.*")
    hits = let(F.lower(F.col(text)), lambda low: F.transform(
        F.filter(rule_table(rules, "rule_id"), lambda r: r["safe"] & may_match(low, r)), counted
    ))
    found = F.filter(hits, lambda h: h["match_count"] > 0)
    return spread(cases).select(*keep, F.explode_outer(found).alias("r")).filter("r IS NOT NULL").select(*keep, "r.*")


# Acceptance thresholds and constructs refused outright.
MIN_PRECISION = 0.98
MAX_BENIGN_PER_20K = 1.0
MAX_BENIGN_PER_20K_SECRETS = 0.1
MIN_DISTINCT_EXAMPLES = 25
PROHIBITED = [
    ("lookbehind", r"\(\?<[=!]"),
    ("backreference", r"\\[1-9]"),
    ("nested quantifier", r"\((?:[^()]*[+*][^()]*)\)[+*]"),
]


def compiles(pattern: str | None) -> bool:
    """Whether a pattern of the rule dialect can be compiled at all."""
    if pattern is None or re.search(r"\(\?[P(]", pattern):
        return False
    try:
        re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern))
    except (re.error, OverflowError, RecursionError):
        return False
    return True


def gate_rules(corpus: DataFrame, rules: DataFrame) -> DataFrame:
    """Acceptance verdict per rule over a labelled corpus (kind, text).

    ``kind`` is positive, negative or benign.  Static checks come first: a pattern with a
    prohibited construct, one that does not compile and one that some string makes slow
    (``pattern_check``) is reported and never run.  Every text is read once by the rules whose
    literal it holds; hits are summed per rule on the map side, so only rule counts are
    shuffled.  Without a corpus every rule is still reported.
    """
    rows = rules.orderBy("rule_id").collect()
    refused = {r["rule_id"] for r in rows if any(re.search(p, r["pattern"] or "") for _, p in PROHIBITED)}
    broken = [r["rule_id"] for r in rows if r["rule_id"] not in refused and not compiles(r["pattern"])]
    hostile = [
        r["rule_id"] for r in rows
        if r["rule_id"] not in refused and r["rule_id"] not in broken and slow(r["pattern"], r["flags"])
    ]
    runnable = [r for r in rows if r["rule_id"] not in {*refused, *broken, *hostile}]
    hits = let(F.lower("text"), lambda low: F.transform(
        F.filter(rule_table(runnable, "rule_id"), lambda r: may_match(low, r) & F.rlike(F.col("text"), r["pattern"])),
        lambda r: r["rule_id"],
    ))
    k = F.col("kind")
    spread_out = spread(corpus).select("kind", F.explode_outer(hits).alias("rule_id")).filter("rule_id IS NOT NULL")
    facts = spread_out.groupBy("rule_id").agg(*[
        F.count_if(k == kind).alias(name) for kind, name in (("positive", "hit_pos"), ("negative", "hit_neg"), ("benign", "hit_ben"))
    ])
    # texts are counted once, not once a rule
    sizes = corpus.agg(F.count_if(k == "positive").alias("n_pos"), F.count_if(k == "benign").alias("n_ben"))
    one = F.lit(1)
    c = F.col
    budget = F.when(c("category") == "secrets", MAX_BENIGN_PER_20K_SECRETS).otherwise(MAX_BENIGN_PER_20K)
    checks = [
        (c("rule_id").isin(broken) if broken else F.lit(False), "does not compile"),
        *[(c("pattern").rlike(p), f"prohibited construct: {n}") for n, p in PROHIBITED],
        (c("rule_id").isin(hostile) if hostile else F.lit(False), "slow on hostile input"),
        (~F.coalesce(c("confidence").between(0, 1), F.lit(False)), "confidence"),
        (c("n_pos") == 0, "no positives"),
        ((c("n_pos") == 0) | (c("hit_pos") / F.greatest(c("n_pos"), one) < MIN_PRECISION), "precision"),
        (c("hit_neg") > 0, "matches negatives"),
        (c("n_ben") == 0, "no benign corpus"),
        ((c("n_ben") > 0) & (c("hit_ben") / F.greatest(c("n_ben"), one) > budget / 20_000), "benign rate"),
        (c("distinct_examples") < MIN_DISTINCT_EXAMPLES, "distinct examples"),
        (c("reported"), "reported"),
    ]
    failures = F.filter(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for bad, name in checks]),
        lambda x: x.isNotNull(),
    )
    n_pos, n_ben = sizes.first()
    joined = rules.join(facts, "rule_id", "left").withColumns({
        "n_pos": F.lit(n_pos).cast("bigint"), "n_ben": F.lit(n_ben).cast("bigint"),
    }).na.fill(0, ["hit_pos", "hit_neg", "hit_ben"])
    return joined.select(
        "rule_id", "n_pos", "hit_pos", "hit_neg", "n_ben", "hit_ben", failures.alias("failures"),
        (F.size(failures) == 0).alias("accepted"),
    )
