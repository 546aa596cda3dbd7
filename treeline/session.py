"""Session construction and the few session-dependent helpers operators need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "treeline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here is written for.

    AQE does the run-time work (coalescing, skew splitting, turning a sort-merge
    join into a broadcast join only once the measured size allows it), so no plan
    needs to guess sizes up front.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Static estimates miss what an explode multiplies, so only sizes measured
        # at run time may turn a join into a broadcast join.
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Large column expressions are built call by call; call-site capture would dominate.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


FEW_PARTITIONS = 64


def spread(df: DataFrame) -> DataFrame:
    """Spread an input of few partitions (a small, unsplittable file) over the executors.

    At most 64 input partitions are ever reshuffled, so a large text table is
    always read as it lies.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() <= min(FEW_PARTITIONS, wanted // 2) else df


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder for tables that a query builds and reads, where driver and executors see it."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names; a fresh one only on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="treeline-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder
