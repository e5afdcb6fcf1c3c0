"""Session settings and tables staged in the shared folder."""

from __future__ import annotations

import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

STAGING = "panelmill"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "panelmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and skewed joins split."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not spark.sparkContext.master.startswith("local["):
        ship(spark)
    return spark


def ship(spark: SparkSession) -> str:
    """Send the package to the executors, whose workers import it; returns the archive."""
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{spark.sparkContext._temp_dir}/{package.name}", "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    return archive


def _leaves_reduced(plan) -> bool:
    """Every table that the plan scans has passed an aggregation, or was staged before."""
    if plan.nodeName() in ("Aggregate", "Distinct", "Deduplicate", "LocalRelation", "OneRowRelation"):
        return True
    children = plan.children()
    if children.size() == 0:
        return f"/{STAGING}/" in str(plan.toString())
    return all(_leaves_reduced(children.apply(i)) for i in range(children.size()))


def _aggregates(plan) -> bool:
    children = plan.children()
    return plan.nodeName() in ("Aggregate", "Distinct", "Deduplicate") or any(_aggregates(children.apply(i)) for i in range(children.size()))


def reused(df: DataFrame, label: str = "reused") -> DataFrame:
    """For a frame about to be read more than once.

    When it is an aggregate of what it reads, it is staged, whatever its size: the input is read once and all readers see
    the very same numbers. A frame that is no reduction of its input is read again.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    return staged(df, label) if _aggregates(plan) and _leaves_reduced(plan) else df


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else the context's checkpoint directory.

    A local session without either uses its warehouse folder; on a cluster one of them must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        if found.isDefined():
            folder = found.get()
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            folder = spark.conf.get("spark.sql.warehouse.dir")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{STAGING}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    Losing executors afterwards costs only a re-read of the table. So the shuffle files of the write, which nothing reads again,
    are removed when it ends.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, label), spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames as ``staged`` returned them, once all that reads them is staged itself."""
    for df in frames:
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if f"/{STAGING}/" not in folder:
                raise ValueError(f"{folder} is no staged table")
            _delete(df.sparkSession, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_staged(spark: SparkSession) -> None:
    """Delete what this application has staged; frames that read it must not be used any more."""
    _delete(spark, f"{shared_folder(spark)}/{STAGING}/{spark.sparkContext.applicationId}")
