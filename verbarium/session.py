"""Session settings and the shared scratch area."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH_SETTING = "spark.checkpoint.dir"


def build_session(
    app: str, master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """A session with the settings this package relies on.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset, so that the submit
    command decides; adaptive execution then coalesces or splits the shuffles.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the Python line of every expression costs more than building it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as the cluster names it."""
    shared = spark.conf.get(SCRATCH_SETTING, None)
    if not shared:
        raise RuntimeError(f"set {SCRATCH_SETTING} to a folder that all executors share")
    return f"{shared.rstrip('/')}/verbarium"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch area; no two calls share one."""
    return f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def work_folder(spark: SparkSession, owner: str) -> str:
    """The folder in the scratch area that belongs to ``owner``, the same for every session.

    Work that uses it over and over replaces its own intermediate tables, so that they do not
    pile up.
    """
    return f"{scratch_dir(spark)}/{hashlib.sha256(owner.encode()).hexdigest()[:32]}"


def stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to ``path`` in the scratch area and read it back.

    It cuts the lineage: what follows neither repeats the work nor depends on an executor
    that held it.
    """
    df.write.mode("overwrite").parquet(path, partitionBy=partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)
