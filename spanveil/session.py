"""Session defaults and small plan helpers shared by the jobs."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "spanveil", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs are written for.

    On a cluster the caller's submit configuration wins; only unset keys are
    filled in here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # The per-call stack capture of the Python API more than doubles the
        # time it takes to assemble large column expressions.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, taken from the session.

    Where none is named, a local folder is used in local mode only (unit tests, a laptop);
    a cluster must name one, as its machines share no other.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    require_local(spark)
    return os.path.join(tempfile.mkdtemp(prefix="spark-"), "checkpoints")


def stored(df: DataFrame) -> DataFrame:
    """Write a costly table that is read several times to the shared folder, and read it back."""
    folder = os.path.join(checkpoint_root(df.sparkSession), f"spanveil-{uuid.uuid4().hex}")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def require_local(spark: SparkSession) -> None:
    """Refuse a machine-local folder where tasks run on other machines."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def ship_package(spark: SparkSession) -> None:
    """Let every executor import this package; done once per application.

    The sources go out through Spark's own file service, as ``--py-files`` does, so
    executors need neither an installation nor a folder in common with the driver.
    """
    context = spark.sparkContext
    if getattr(context, "_spanveil_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "spanveil.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(archive)
    context._spanveil_shipped = True


#: Session setting: partitions that scans are dealt to before CPU-heavy work.
SCAN_PARTITIONS = "spark.spanveil.scanPartitions"
#: Unset, partitions for every core.
SCAN_PARTITIONS_PER_CORE = 4


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan to enough partitions for all cores, before CPU-heavy work.

    A row group is read by one task, so a table in one file may be one task however many
    splits it has.  The number is ``SCAN_PARTITIONS`` or follows from the cores; an input
    of as many files stays as it is read, as does a stream.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    given = spark.conf.get(SCAN_PARTITIONS, None)
    wanted = int(given or SCAN_PARTITIONS_PER_CORE * spark.sparkContext.defaultParallelism)
    return df if not given and len(df.inputFiles()) >= wanted else df.repartition(wanted)


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator, so that each is computed once per row.

    Catalyst merges plain projections and pushes filters through them, and either
    repeats a costly expression wherever its column is used.
    """
    row = F.struct(*[e.alias(n) for n, e in columns.items()])
    return df.withColumn("_p", F.explode(F.array(row))).select("*", "_p.*").drop("_p")
