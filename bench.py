"""Headline timings as one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is planned, run and fully consumed; building its columns counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from spanveil.functions.masking import redact_placeholder
from spanveil.operators.scan import explode_spans, scan_documents
from spanveil.plans import catalog  # noqa: F401
from spanveil.plans.registry import QUERIES, table
from spanveil.session import SCAN_PARTITIONS, build_session


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def detect_documents(spark, sf_dir):
    return explode_spans(scan_documents(table(spark, sf_dir, "documents")), "spans", "doc_id")


def redact_documents(spark, sf_dir):
    docs = scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", redact_placeholder(F.col("text"), F.col("spans")).alias("text"))


def count_documents(spark, sf_dir):
    return detect_documents(spark, sf_dir).groupBy("category").count()


BENCH = {
    "detect_documents": detect_documents,
    "redact_documents": redact_documents,
    "count_by_category": count_documents,
    **{name: QUERIES[name] for name in (
        "flagship", "detect_secrets", "detect_payment_card", "detect_email", "segment_budget",
        "scan_text", "map_range", "page_segments", "ocr_token_spans", "finding_build_doc",
        "rule_test", "audit_ring",
    )},
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus, SCAN_PARTITIONS: str(2 * int(cpus)), "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    size = table(spark, sf_dir, "documents").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")
    ).first()
    times = {}
    for name, build in BENCH.items():
        started = time.perf_counter()
        drain(build(spark, sf_dir))
        times[name] = round(time.perf_counter() - started, 3)
    started = time.perf_counter()
    drain(redact_documents(spark, sf_dir))
    warm = time.perf_counter() - started
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "redact_warm_sec": round(warm, 3),
        "redact_docs_per_sec": round(size["n"] / warm, 1),
        "redact_mb_per_sec": round(size["bytes"] / warm / 1e6, 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
