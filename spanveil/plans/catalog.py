"""All query modules, imported for their registrations, and the flagship query."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.operators.scan import explode_spans, scan_documents
from spanveil.plans import (  # noqa: F401
    detection,
    findings,
    governance,
    page_jobs,
    segmentation,
    streams,
)
from spanveil.plans.registry import query, table
from spanveil.plans.sql_text import raw_all, resolved

_DOCS = "SELECT 'doc' AS src, doc_id AS id, text FROM documents"


@query("flagship", f"""
SELECT source, lang, category, count(*) AS n FROM ({resolved(raw_all(_DOCS))}) r
JOIN documents ON doc_id = r.id GROUP BY source, lang, category""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitive values per source, language and category of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    found = explode_spans(scan_documents(docs), "spans", "source", "lang")
    return found.groupBy("source", "lang", "category").agg(F.count("*").alias("n"))
