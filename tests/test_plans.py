"""Plan shapes that must hold at any size."""

import re

import pytest
from pyspark.sql import functions as F

from foldwise.operators import metrics
from foldwise.operators.joins import BROADCAST_ROWS, join_small
from foldwise.operators.weights import row_weights
from foldwise.plans.catalog import QUERIES
from foldwise.plans.fixtures import points

# Results of driver-side rounds hold no plan of the data any more.
LAZY = [
    "naive_mean_metrics", "fold_roles", "bin_counts", "bin_weights", "row_weights", "training_weights", "sqrt_weight_features",
    "scale_standard", "scale_minmax", "histogram", "density_histogram", "network_metrics", "network_report", "best_params",
    "fold_grid", "grid_json", "grid_linear", "gradient_summary", "null_profile", "sample_n", "parse_source", "kde_curve",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_single_partition_sort(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_only_the_needed_columns_are_read(spark, sf_dir):
    text = plan(QUERIES["bin_counts"](spark, sf_dir))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_orderkey", "l_quantity", "l_extendedprice"}


def test_label_filters_reach_the_scan(spark, tmp_path):
    from foldwise.operators.sampling import filter_label

    spark.createDataFrame([(0.5,), (0.05,)], "y double").write.parquet(str(tmp_path / "t"))
    assert "GreaterThanOrEqual(y,0.1)" in plan(filter_label(spark.read.parquet(str(tmp_path / "t")), "y", 0.1, 0.9))


def test_metrics_shuffle_bins_not_rows(spark, sf_dir):
    df = points(spark, sf_dir).withColumn("p", F.col("x1") / 50)
    text = plan(metrics.score(df, ["bucket"], "y", "p"))
    # Partial aggregation stands right above the scan, below the first exchange.
    assert "partial_count" in text.split("Exchange")[-1]
    assert "Join" not in text


def test_broadcast_needs_a_bound(spark, sf_dir):
    small = spark.range(5).withColumnRenamed("id", "bucket")
    df = points(spark, sf_dir)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(join_small(df, small, ["bucket"], max_rows=5))
        assert "BroadcastHashJoin" not in plan(join_small(df, small, ["bucket"]))
        assert "BroadcastHashJoin" not in plan(join_small(df, small, ["bucket"], max_rows=BROADCAST_ROWS + 1))
        assert "BroadcastHashJoin" in plan(row_weights(df, "y", ["bucket"], groups=5))
        assert "BroadcastHashJoin" not in plan(row_weights(df, "y", ["bucket"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_dedup_below_the_weights_runs_once(spark, sf_dir):
    df = QUERIES["training_weights"](spark, sf_dir)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    # The order lines and the parts, each read once.
    assert final.count("FileScan") == 2 and "ReusedExchange" in final


def test_global_metrics_read_the_rows_once(spark):
    df = spark.range(100).select(F.lit("m").alias("model"), (F.col("id") / 100).alias("y"), F.lit(0.5).alias("p"))
    assert plan(metrics.global_metrics(df, ["model"], "y", "p")).count("Range (") == 1
