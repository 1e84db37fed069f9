"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "foldwise") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A folder of our own is made only where the session names none and runs on one machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="foldwise-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small per-iteration state table."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Largest state table that may come back to the driver between two rounds of an iteration.
SETTLED_ROWS = 100_000


def settled(df: DataFrame, max_rows: int | None) -> DataFrame:
    """A state table computed now, so that the next round starts from its rows and not from its plan.

    With a proven bound the few rows return to the driver, which costs one job; without
    one the table is checkpointed.
    """
    if max_rows is None or max_rows > SETTLED_ROWS:
        return cut_lineage(df)
    # By Arrow the rows become a local relation; as Python rows every use would be a stage of Python workers.
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)
