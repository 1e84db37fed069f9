"""Parquet readers and writers."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A Parquet table; with a schema, only its columns are read and a missing one is an error."""
    df = spark.read.parquet(path)
    if schema is None:
        return df
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    absent = [f.name for f in fields if f.name not in df.columns]
    if absent:
        raise ValueError(f"columns missing in {path}: {absent}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def spread(df: DataFrame) -> DataFrame:
    """A freshly read table over all cores, when its files give fewer partitions than there are cores.

    For work that is heavy per row. A large table has more partitions than cores and
    comes back as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a Parquet table."""
    writer = df.write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_tables(tables: dict[str, dict[str, DataFrame]]) -> dict[str, str]:
    """Write named tables below their folders; a failing table is logged and the rest go on.

    Returns the error text per failed path.
    """
    failed = {}
    for folder, named in tables.items():
        for name, df in named.items():
            path = f"{folder.rstrip('/')}/{name}.parquet"
            try:
                write_table(df, path)
            except Exception as error:  # noqa: BLE001 - one bad table must not stop the others
                log.error("could not write %s: %s", path, error)
                failed[path] = str(error)
    return failed


def list_tables(spark: SparkSession, folder: str) -> dict[str, str]:
    """Name to path of every Parquet file or folder, on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise FileNotFoundError(folder)
    paths = [str(s.getPath()) for s in fs.listStatus(root)]
    return {p.rsplit("/", 1)[1][: -len(".parquet")]: p for p in sorted(paths) if p.endswith(".parquet")}


def load_tables(spark: SparkSession, folder: str, views: bool = False) -> dict[str, DataFrame]:
    """Every Parquet table of a folder by name; a missing folder is an error, an empty one a message."""
    found = list_tables(spark, folder)
    if not found:
        log.warning("no Parquet tables in %s", folder)
    tables = {}
    for name, path in found.items():
        try:
            tables[name] = spark.read.parquet(path)
        except AnalysisException as error:
            # A write that failed leaves a folder without data files.
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            log.warning("no data in %s", path)
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def fold_registry(spark: SparkSession, spec: dict[str, str], variant: str = "A",
                  schema: str | T.StructType | None = None) -> DataFrame:
    """Comma-separated path lists per split as one table; the position in a list is the fold."""
    out = None
    for split, paths in spec.items():
        for fold, path in enumerate(p.strip() for p in paths.split(",")):
            one = read_table(spark, path, schema).withColumns(
                {"variant": F.lit(variant), "split": F.lit(split), "fold": F.lit(fold)}
            )
            out = one if out is None else out.unionByName(one)
    return out


def write_folds(df: DataFrame, path: str) -> None:
    """Partitioned by variant, split and fold, so a job on one fold reads only that fold."""
    write_table(df, path, ["variant", "split", "fold"])


def write_predictions(df: DataFrame, path: str) -> None:
    write_table(df, path, ["model", "fold"])
