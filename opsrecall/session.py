"""Lineage cutting that survives the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is chosen only when none is set and the master is
    local; on a cluster a machine-local folder would not be readable by the
    other executors, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="opsrecall-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back."""
    ensure_checkpoint_dir(df.sparkSession)
    return _unmeasured(df.checkpoint(eager=True))


def _unmeasured(kept: DataFrame) -> DataFrame:
    """A checkpoint without the size that Spark guessed for the plan behind it.

    A join's guess is the product of its sides, and a checkpoint hands its own on to whatever is
    planned on it, so guesses of tables that are cut again and again double their digits until the
    driver does nothing but multiply them. Of unknown size, joins go by what is measured as they run.
    """
    spark, plan = kept.sparkSession, kept._jdf.queryExecution().logical()
    jvm = spark.sparkContext._jvm
    none = jvm.scala.Option.empty()
    bare = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(),
        spark._jsparkSession, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, bare), spark)
