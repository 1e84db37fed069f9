"""Metrics, per-bin reports, histograms and density curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.scalar import flatten_pairs
from foldwise.operators import distribution, metrics
from foldwise.operators.linear import naive_report, residuals
from foldwise.operators.weights import inverse_count_weights
from foldwise.plans.catalog.registry import query
from foldwise.plans.fixtures import (
    EDGES, FOLDS, LINE_FITS, PTS, REPORT_EDGES, ROLES, binned, metrics_sql, points, preds, report_binned, scored_rows, scored_sql, table,
)


def _round(df: DataFrame, cols: list[str], digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


_NAIVE = f"""{PTS}, {ROLES}, {EDGES}, means AS (SELECT fold, avg(y) AS p FROM pts JOIN roles USING (bucket) WHERE role = 'train' GROUP BY fold),
scored AS (SELECT fold, role, y, p FROM pts JOIN roles USING (bucket) JOIN means USING (fold)), {binned("scored", "b")},
{metrics_sql("b", "fold, role")}"""


@query("naive_mean_metrics", f"""
WITH {_NAIVE} SELECT fold, role, n, round(p, 8) AS naive_mean, round(mse, 8) AS mse, round(r2, 8) AS r2, round(mae, 8) AS mae,
  round(weighted_mse, 8) AS weighted_mse, round(weighted_r2, 8) AS weighted_r2 FROM m JOIN means USING (fold)""")
def naive_mean_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = naive_report(points(spark, d).select("bucket", "y"), "y", "bucket", FOLDS)
    return _round(out.drop("bad"), ["naive_mean", *metrics.METRICS])


_SCORED = f"{PTS}, {ROLES}, {LINE_FITS}, {EDGES}"


@query("fold_metrics", f"""
WITH {_SCORED}, {scored_sql("'train', 'val', 'train_val', 'test'")}, {binned("scored", "b")}, {metrics_sql("b", "model, fold, role")}
SELECT model, fold, role, n, round(mse, 8) AS mse, round(r2, 8) AS r2, round(mae, 8) AS mae,
  round(weighted_mse, 8) AS weighted_mse, round(weighted_r2, 8) AS weighted_r2 FROM m""")
def _fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    df, line, mean = preds(spark, d)
    table = metrics.sweep_moments(df, "y", {"line": line, "naive": mean}, "bucket").withColumnRenamed("param_key", "model")
    return _round(metrics.metrics(table, ["model", "fold", "role"]).drop("bad"), metrics.METRICS)


@query("fold_stats", f"""
WITH {_SCORED}, {scored_sql("'train', 'val'")}, {binned("scored", "b")}, {metrics_sql("b", "model, fold, role")}
SELECT t.model, t.fold, round(t.weighted_mse, 8) AS weighted_train_mse, round(t.weighted_r2, 8) AS weighted_train_r2,
  round(t.mse, 8) AS train_mse, round(t.r2, 8) AS train_r2, round(v.weighted_mse, 8) AS weighted_val_mse,
  round(v.weighted_r2, 8) AS weighted_val_r2, round(v.mse, 8) AS val_mse, round(v.r2, 8) AS val_r2
FROM m t JOIN m v ON t.model = v.model AND t.fold = v.fold AND t.role = 'train' AND v.role = 'val'""")
def fold_stats(spark: SparkSession, d: str) -> DataFrame:
    df, line, mean = preds(spark, d)
    table = metrics.sweep_moments(df, "y", {"line": line, "naive": mean}, "bucket", roles=["train", "val"])
    scored = metrics.metrics(table.withColumnRenamed("param_key", "model"), ["model", "fold", "role"])
    both = metrics.fold_stats(scored, ["model", "fold"])
    return _round(both, [c for c in both.columns if c not in ("model", "fold")])


@query("score_long_table", f"""
WITH {_SCORED}, {scored_sql("'val', 'test'")}, {binned("scored", "b")}, {metrics_sql("b", "model, fold, role")}
SELECT model, fold, role, n, round(mse, 8) AS mse, round(r2, 8) AS r2, round(mae, 8) AS mae,
  round(weighted_mse, 8) AS weighted_mse, round(weighted_r2, 8) AS weighted_r2 FROM m""")
def _score_long(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.score(scored_rows(spark, d, ["val", "test"]), ["model", "fold", "role"], "y", "p")
    return _round(out.drop("bad"), metrics.METRICS)


_POOLED_FROM = f"""{_SCORED}, {scored_sql("'test'")}"""


@query("pooled_metrics", f"""
WITH {_POOLED_FROM}, {binned("scored", "b")}, {metrics_sql("b", "model")}
SELECT model, n, round(mse, 8) AS mse, round(r2, 8) AS r2, round(mae, 8) AS mae,
  round(weighted_mse, 8) AS weighted_mse, round(weighted_r2, 8) AS weighted_r2 FROM m""")
def _pooled(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.bin_moments(scored_rows(spark, d, ["test"]), ["model", "fold"], "y", "p")
    return _round(metrics.pooled_metrics(m, ["model"]).drop("bad"), metrics.METRICS)


@query("per_bin_metrics", f"""
WITH {_POOLED_FROM}, {REPORT_EDGES}, {report_binned("scored", "b")},
mu AS (SELECT model, bin, avg(y) AS m FROM b GROUP BY ALL)
SELECT b.model, b.bin, round(CASE WHEN b.bin = 0 THEN 0 WHEN b.bin = 101 THEN 1 ELSE ((b.bin - 1) / 1e2 + b.bin / 1e2) / 2 END, 6) AS centre,
  count(*) AS count, round(sum((y - p) ** 2) / count(*), 8) AS mse,
  CASE WHEN count(*) > 2 THEN round(1 - sum((y - p) ** 2) / sum((y - m) ** 2), 5) END AS r2
FROM b JOIN mu USING (model, bin) GROUP BY b.model, b.bin""")
def _per_bin(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.per_bin_metrics(scored_rows(spark, d, ["test"]), ["model"], "y", "p")
    return out.select("model", "bin", F.round("centre", 6).alias("centre"), "count", F.round("mse", 8).alias("mse"), F.round("r2", 5).alias("r2"))


@query("global_metrics", f"""
WITH {_POOLED_FROM}, {REPORT_EDGES}, {report_binned("scored", "b")},
c AS (SELECT model, bin, 1e0 / count(*) AS w FROM b GROUP BY ALL), j AS (SELECT b.*, w FROM b JOIN c USING (model, bin)),
mu AS (SELECT model, avg(y) AS m, sum(w * y) / sum(w) AS mw FROM j GROUP BY model)
SELECT j.model, count(*) AS n, round(avg((y - p) ** 2), 8) AS mse, round(1 - sum((y - p) ** 2) / sum((y - m) ** 2), 8) AS r2,
  round(sum(w * (y - p) ** 2) / sum(w), 8) AS weighted_mse,
  round(1 - sum(w * (y - p) ** 2) / sum(w * (y - mw) ** 2), 8) AS weighted_r2
FROM j JOIN mu USING (model) GROUP BY j.model""")
def _global(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.global_metrics(scored_rows(spark, d, ["test"]), ["model"], "y", "p")
    return _round(out, ["mse", "r2", "weighted_mse", "weighted_r2"])


@query("attach_inverse_count", f"""
WITH {PTS}, {REPORT_EDGES}, {report_binned("pts", "b", "edge_score")}, c AS (SELECT bin, 1e0 / count(*) AS w FROM b GROUP BY bin)
SELECT row_key, round(w, 12) AS weight FROM b JOIN c USING (bin)""")
def _inverse(spark: SparkSession, d: str) -> DataFrame:
    df = inverse_count_weights(points(spark, d).select("row_key", "edge_score"), "edge_score")
    return df.select("row_key", F.round("weight", 12).alias("weight"))


_GUARD = f"""{PTS}, s AS (SELECT bucket, annotation_score, y, CASE WHEN annotation_score = 1 AND bucket = 0 THEN 'NaN'::DOUBLE
  WHEN annotation_score = 2 AND bucket = 1 THEN 1e151 WHEN annotation_score = 3 AND bucket = 2 THEN 'Infinity'::DOUBLE ELSE x1 / 50 END AS p FROM pts)"""


def _broken(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("annotation_score"), F.col("bucket")
    p = (
        F.when((a == 1) & (b == 0), F.lit(float("nan"))).when((a == 2) & (b == 1), F.lit(1e151))
        .when((a == 3) & (b == 2), F.lit(float("inf"))).otherwise(F.col("x1") / 50)
    )
    return points(spark, d).select("bucket", "annotation_score", "y", p.alias("p"))


@query("guard_predictions", f"""
WITH {_GUARD}, f AS (SELECT bucket, annotation_score, bool_or(isnan(p) OR isinf(p) OR abs(p) > 1e150) AS bad, count(*) AS n,
  sum(CASE WHEN isnan(p) OR isinf(p) OR abs(p) > 1e150 THEN 0 ELSE (y - p) ** 2 END) / count(*) AS e FROM s GROUP BY ALL)
SELECT bucket, annotation_score, n, CASE WHEN bad THEN 'NaN'::DOUBLE ELSE round(e, 8) END AS mse FROM f""")
def _guard(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.score(_broken(spark, d), ["bucket", "annotation_score"], "y", "p")
    return out.select("bucket", "annotation_score", "n", F.round("mse", 8).alias("mse"))


@query("na_count", f"""
WITH {_GUARD} SELECT bucket, count(*) FILTER (isnan(p)) AS na_count FROM s GROUP BY bucket""")
def _na(spark: SparkSession, d: str) -> DataFrame:
    return metrics.na_count(_broken(spark, d), ["bucket"], "p")


@query("extents", f"""
WITH {_POOLED_FROM} SELECT model, round(min(y), 8) AS real_min, round(max(y), 8) AS real_max, round(min(p), 8) AS pred_min,
  round(max(p), 8) AS pred_max FROM scored GROUP BY model""")
def _extents(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.extents(scored_rows(spark, d, ["test"]), ["model"], "y", "p")
    return _round(out, ["real_min", "real_max", "pred_min", "pred_max"])


@query("constant_prediction", f"""
WITH {_POOLED_FROM} SELECT model, fold, count(DISTINCT p) = 1 AS is_constant FROM scored GROUP BY model, fold""")
def _constant(spark: SparkSession, d: str) -> DataFrame:
    return metrics.constant_prediction(scored_rows(spark, d, ["test"]), ["model", "fold"], "p")


@query("all_close", f"""
WITH {_SCORED}, t AS (SELECT r.fold, a + b * x1 AS p, a + b * x1 + CASE WHEN r.fold = 2 THEN 1e-3 ELSE 1e-9 END AS q
  FROM pts JOIN roles r USING (bucket) JOIN fits f ON r.fold = f.fold WHERE r.role = 'val')
SELECT fold, bool_and(abs(p - q) <= 1e-6 + 1e-5 * abs(q)) AS all_close,
  count(*) FILTER (NOT abs(p - q) <= 1e-6 + 1e-5 * abs(q)) AS n_different FROM t GROUP BY fold""")
def _close(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_rows(spark, d, ["val"]).filter("model = 'line'")
    shifted = rows.withColumn("q", F.col("p") + F.when(F.col("fold") == 2, 1e-3).otherwise(1e-9))
    return metrics.all_close(shifted, ["fold"], "p", "q")


@query("residuals", f"""
WITH {_SCORED} SELECT row_key, round(y - (a + b * x1), 7) AS residual FROM pts JOIN roles r USING (bucket)
  JOIN fits f ON r.fold = f.fold WHERE r.role = 'val'""")
def _residuals(spark: SparkSession, d: str) -> DataFrame:
    rows = scored_rows(spark, d, ["val"]).filter("model = 'line'")
    return residuals(rows, "y", F.col("p")).select("row_key", F.round("residual", 7).alias("residual"))


@query("flatten_predictions", """
WITH t AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings)
SELECT label, count(*) AS n, round(sum(v), 4) AS real_sum, round(sum(v / 2), 4) AS pred_sum FROM t GROUP BY label""")
def _flatten(spark: SparkSession, d: str) -> DataFrame:
    # Lists of lists, as stored next to a model: nested once and flattened back to pairs.
    v = F.transform("embedding", lambda x: x.cast("double"))
    nested = table(spark, d, "embeddings").select(
        "label", flatten_pairs(F.array(v), F.array(F.transform(v, lambda x: x / 2))).alias("pairs")
    )
    return nested.select("label", F.inline("pairs")).groupBy("label").agg(
        F.count("*").alias("n"), F.round(F.sum("real"), 4).alias("real_sum"), F.round(F.sum("pred"), 4).alias("pred_sum")
    )


_HIST_EDGES = "hedges AS (SELECT i, i * (1e0 / 50) AS lo FROM range(51) t(i))"
_HIST = f"""{PTS}, {_HIST_EDGES}, h AS (SELECT bucket, CAST(least(i, 49) AS INT) AS bin FROM pts ASOF JOIN hedges ON y >= lo WHERE y BETWEEN 0 AND 1),
counts AS (SELECT bucket, bin, count(*) AS n FROM h GROUP BY ALL),
hist AS (SELECT CAST(b AS INT) AS bucket, CAST(i AS INT) AS bin, coalesce(n, 0) AS count
  FROM range(5) t(b) CROSS JOIN range(50) u(i) LEFT JOIN counts c ON c.bucket = b AND c.bin = i)"""


@query("histogram", f"""
WITH {_HIST} SELECT bucket, bin, round((bin * 2e-2 + (bin + 1) * 2e-2) / 2, 6) AS centre, count FROM hist""")
def _histogram(spark: SparkSession, d: str) -> DataFrame:
    h = distribution.histogram(points(spark, d), ["bucket"], "y", 50)
    return h.withColumn("centre", F.round("centre", 6))


@query("density_histogram", f"""
WITH {_HIST} SELECT bucket, bin, round(count / sum(count) OVER (PARTITION BY bucket) / 2e-2, 8) AS density FROM hist""")
def _density(spark: SparkSession, d: str) -> DataFrame:
    h = distribution.density_histogram(points(spark, d), ["bucket"], "y", 50)
    return h.select("bucket", "bin", F.round("density", 8).alias("density"))


@query("kde_curve", f"""
WITH {PTS}, s AS (SELECT count(*) AS n, stddev_samp(y) * count(*) ** (-2e-1) AS h, min(y) AS lo, max(y) AS hi FROM pts),
g AS (SELECT CAST(i AS INT) AS point, n, h, lo - 3 * h + i * (hi + 3 * h - (lo - 3 * h)) / 199 AS x FROM s, range(200) t(i))
SELECT point, round(any_value(x), 8) AS x, round(sum(exp(-((x - y) ** 2) / (2 * h * h))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density
FROM g, pts GROUP BY point""")
def kde_curve(spark: SparkSession, d: str) -> DataFrame:
    return _round(distribution.kde(points(spark, d, heavy=True).select("y"), [], "y"), ["x", "density"])
