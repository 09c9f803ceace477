"""From raw documents to a training mix: five stages, each written and read again.

1. ``language``: documents without letters or without a leading language go.
2. ``lines``: lines that stand earlier, up to one word edit, are cut from the texts;
   documents left without a line go.
3. ``near_duplicates``: one document of each SimHash group stays.
4. ``decontamination``: documents that hold a benchmark item go.
5. ``mix``: sources are brought to their target weights; the result has the documents
   taken and how many copies of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanveil.llm.common import stored
from spanveil.llm.decontamination import without_contaminated
from spanveil.llm.language_id import with_known_language
from spanveil.llm.line_dedup import without_duplicate_lines
from spanveil.llm.simhash import one_of_each
from spanveil.llm.source_mixing import mixture


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a leading language.  Null, empty and letterless texts go; repeated rows
    stay or go together; every column stays."""
    return with_known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier.  Null texts, texts without words and rows without
    an id stay as they are; of equal lines the one at the smallest (document, line) stays."""
    return without_duplicate_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each group.  Empty texts are one group; rows without an id
    stay; of rows of one id one stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.  Null and empty texts hold none and stay; repeated
    rows stay or go together."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken, with ``copies``.  Null sources are a source of their own; empty and null
    texts are taken once; rows of one id share their copies evenly."""
    return mixture(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
]

#: Language mixtures and LSH have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
