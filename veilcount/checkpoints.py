"""Where checkpoints go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(spark: SparkSession) -> None:
    """The cluster's shared folder; where spark.checkpoint.dir is unset, one of our own, on one machine only."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="spark-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of checkpoints, which all executors share."""
    checkpointed(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/veilcount-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: worked out once, whatever reads it, and kept if executors go."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_stored(df: DataFrame) -> bool:
    """Whether df is read from files as it is, but for a choice of columns and rows."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.child()
    return plan.nodeName().startswith(("Relation", "LogicalRelation"))
