"""Session set-up and the one place where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "loomtext", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    defaults = {
        "spark.master": f"local[{cores}]",
        "spark.app.name": app,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.config(map=defaults | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back from there.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a session that names
    none (tests, a laptop) gets a temporary one, and only in local mode: on a cluster a folder of
    one machine would not survive the loss of an executor.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="loomtext-checkpoint-")
        context.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it comes in fewer than half as many.

    For costly work on rows of a table that comes in few pieces, such as one file of one row group, which no setting
    of the scan can split. A table in enough pieces to keep half of the cores busy, or one that a shuffle has spread
    already, is not touched.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if 2 * df.rdd.getNumPartitions() > wanted else df.repartition(wanted)
