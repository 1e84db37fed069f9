"""Sources, cleaning, folds, sampling and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.bins import bin_text, label_bin, report_bin, report_bin_centre
from foldwise.operators import cleaning, folds, sampling, weights
from foldwise.operators.joins import pair_roles
from foldwise.operators.linear import naive_mean
from foldwise.plans.catalog.registry import query
from foldwise.plans.fixtures import EDGES, FOLDS, PTS, PTS_PART, REPORT_EDGES, ROLES, binned, points, report_binned, table
from foldwise.sources.tables import fold_registry, load_tables, read_table

POINT_SCHEMA = "l_orderkey long, l_quantity double, l_extendedprice double, l_linestatus string"


@query("read_table", """
SELECT l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_linestatus""")
def _read(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, f"{d}/lineitem.parquet", POINT_SCHEMA)
    return t.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("load_tables", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()))
def _load(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, t in load_tables(spark, d).items():
        one = t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("register_folds", """
SELECT 'A' AS variant, s AS split, CAST(f AS INT) AS fold, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem, range(2) t(f), (VALUES ('train'), ('test')) v(s) GROUP BY f, s""")
def _register(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/lineitem.parquet"
    spec = {"train": f"{path},{path}", "test": f"{path},{path}"}
    t = fold_registry(spark, spec, variant="A", schema=POINT_SCHEMA)
    return t.groupBy("variant", "split", "fold").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("passthrough", f"""
WITH {PTS}, {ROLES} SELECT fold, row_key, round(y, 10) AS y FROM pts JOIN roles USING (bucket) WHERE role = 'test'""")
def _pass(spark: SparkSession, d: str) -> DataFrame:
    rows = folds.assign_roles(points(spark, d).select("row_key", "bucket", "y"), "bucket", FOLDS, ["val", "test"])
    return folds.passthrough(rows, "test", "role").select("fold", "row_key", F.round("y", 10).alias("y"))


@query("fold_roles", f"""
WITH {PTS}, {ROLES} SELECT fold, role, count(*) AS n, round(sum(y), 6) AS label_sum
FROM pts JOIN roles USING (bucket) GROUP BY fold, role""")
def _roles(spark: SparkSession, d: str) -> DataFrame:
    # Bucket sums first; the roles are attached to five rows.
    per = points(spark, d).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    return folds.assign_roles(per, "bucket", FOLDS).groupBy("fold", "role").agg(
        F.sum("n").alias("n"), F.round(F.sum("s"), 6).alias("label_sum")
    )


@query("assign_roles", f"""
WITH {PTS}, {ROLES} SELECT fold, role, row_key FROM pts JOIN roles USING (bucket)""")
def _assign(spark: SparkSession, d: str) -> DataFrame:
    return folds.assign_roles(points(spark, d).select("row_key", "bucket"), "bucket", FOLDS).select("fold", "role", "row_key")


@query("pair_folds", f"""
WITH {PTS}, {ROLES}, t AS (SELECT fold, role, count(*) AS n, avg(y) AS m FROM pts JOIN roles USING (bucket) GROUP BY ALL)
SELECT a.fold, a.n AS train_n, b.n AS val_n, round(a.m, 8) AS train_m, round(b.m, 8) AS val_m
FROM t a JOIN t b ON a.fold = b.fold AND a.role = 'train' AND b.role = 'val'""")
def _pair(spark: SparkSession, d: str) -> DataFrame:
    per = points(spark, d).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    t = folds.assign_roles(per, "bucket", FOLDS).groupBy("fold", "role").agg(
        F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 8).alias("m")
    )
    return pair_roles(t, ["fold"], "role", ["n", "m"])


@query("fold_of_row", """
SELECT user_id, CAST(user_id // 4 AS INT) AS fold, count(*) AS n FROM events GROUP BY 1, 2""")
def _fold_of_row(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn(
        "fold", folds.fold_of_position(F.col("user_id"), 4)
    )


@query("label_bands", f"""
WITH {PTS} SELECT bucket, count(*) FILTER (y < 0.1) AS low, count(*) FILTER (y > 0.9) AS high,
  count(*) FILTER (y >= 0.1) AS kept FROM pts GROUP BY bucket""")
def _bands(spark: SparkSession, d: str) -> DataFrame:
    y = F.col("y")
    return points(spark, d).groupBy("bucket").agg(
        F.count_if(y < 0.1).alias("low"), F.count_if(y > 0.9).alias("high"), F.count_if(y >= 0.1).alias("kept")
    )


@query("filter_label", f"""
WITH {PTS} SELECT row_key, round(y, 10) AS y FROM pts WHERE y >= 0.1 AND y < 0.9""")
def _filter(spark: SparkSession, d: str) -> DataFrame:
    return sampling.filter_label(points(spark, d).select("row_key", "y"), "y", 0.1, 0.9).withColumn("y", F.round("y", 10))


_DOWN = f"""{PTS}, take AS (SELECT bucket, count(*) AS n FROM pts WHERE y > 0.9 GROUP BY bucket),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('42|' || row_key)) AS rn FROM pts WHERE y < 0.1),
small AS (SELECT bucket, row_key, y FROM pts WHERE y >= 0.1
  UNION ALL SELECT r.bucket, row_key, y FROM ranked r JOIN take USING (bucket) WHERE rn <= n)"""


@query("downsample_b", f"WITH {_DOWN} SELECT bucket, row_key, round(y, 10) AS y FROM small")
def _down(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d).select("bucket", "row_key", "y")
    return sampling.downsample(df, ["bucket"], "y", ["row_key"], 42, max_groups=FOLDS).withColumn("y", F.round("y", 10))


@query("variant_counts", f"""
WITH {_DOWN} SELECT 'A' AS variant, bucket, count(*) AS n, round(sum(y), 6) AS label_sum FROM pts GROUP BY bucket
UNION ALL SELECT 'B', bucket, count(*), round(sum(y), 6) FROM small GROUP BY bucket""")
def _variants(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d).select("bucket", "row_key", "y")
    both = sampling.make_variants(df, ["bucket"], "y", ["row_key"], 42, FOLDS)
    return both.groupBy("variant", "bucket").agg(F.count("*").alias("n"), F.round(F.sum("y"), 6).alias("label_sum"))


@query("union_variants", f"""
WITH {_DOWN} SELECT 'A' AS variant, row_key, round(y, 10) AS y FROM pts UNION ALL SELECT 'B', row_key, round(y, 10) FROM small""")
def _union(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d).select("bucket", "row_key", "y")
    return sampling.make_variants(df, ["bucket"], "y", ["row_key"], 42, FOLDS).select(
        "variant", "row_key", F.round("y", 10).alias("y")
    )


@query("sample_n", f"""
WITH {PTS} SELECT row_key, round(y, 10) AS y FROM pts ORDER BY md5('7|' || row_key), row_key, y LIMIT 1024""")
def _sample_n(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_n(points(spark, d).select("row_key", "y"), 1024, ["row_key"], 7).withColumn("y", F.round("y", 10))


@query("sample_fraction")
def _sample_fraction(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_fraction(points(spark, d).select("row_key", "y"), 0.25, 42)


@query("sample_aligned", f"""
WITH {PTS}, s AS (SELECT * FROM pts WHERE CAST(('0x' || substr(md5('42|' || row_key), 1, 13)) AS BIGINT) / 4503599627370496e0 < 0.25)
SELECT row_key, x1, round(y, 10) AS y FROM s""")
def _sample_aligned(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d)
    x, y = sampling.sample_aligned(df.select("row_key", "x1"), df.select("row_key", F.round("y", 10).alias("y")), ["row_key"], 0.25, 42)
    return x.join(y, "row_key")


@query("drop_and_split", f"""
WITH {PTS} SELECT row_key, x1, x2, x3, rank, annotation_score, ontology_f, ontology_p, protein_existence, round(y, 10) AS label FROM pts""")
def _split(spark: SparkSession, d: str) -> DataFrame:
    df = cleaning.drop_ids(points(spark, d), ["name", "bucket"]).withColumn("y", F.round("y", 10))
    return cleaning.split_xy(df, "y", ["edge_score"], ["row_key"])


@query("feature_columns", f"""
WITH {PTS} SELECT 'x1' AS feature, round(sum(x1), 2) AS total FROM pts UNION ALL SELECT 'x2', round(sum(x2), 2) FROM pts
UNION ALL SELECT 'x3', round(sum(x3), 2) FROM pts UNION ALL SELECT 'rank', round(sum(rank)::DOUBLE, 2) FROM pts""")
def _features(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d)
    cols = cleaning.feature_columns(df, ["name", "row_key", "bucket", "y", "edge_score", "annotation_score", "ontology_f", "ontology_p", "protein_existence"])
    wide = df.agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in cols])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(c, 2).alias("total")) for c in cols])))


@query("harmonise_types", f"""
WITH {PTS} SELECT row_key, x1, CAST(rank AS DOUBLE) AS rank, annotation_score, CAST(ontology_f AS INT) AS ontology_f,
  CAST(ontology_p AS INT) AS ontology_p, CAST(protein_existence AS DOUBLE) AS protein_existence,
  CAST(split_part(name, '-', 2) AS DOUBLE) AS text_number FROM pts""")
def _types(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d).withColumn("text_number", F.substring_index("name", "-", -1)).select(
        "row_key", "x1", "rank", "annotation_score", "ontology_f", "ontology_p", "protein_existence", "text_number"
    )
    return cleaning.harmonise_types(df, ["row_key", "annotation_score"])


@query("force_double", f"WITH {PTS} SELECT row_key, CAST(rank AS DOUBLE) AS rank FROM pts")
def _force(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.force_double(points(spark, d).select("row_key", "rank"), ["rank"])


def _holes(df: DataFrame) -> DataFrame:
    return df.select(
        "row_key",
        F.when(F.col("rank") == 3, F.lit(None)).otherwise(F.col("x1")).alias("x1"),
        F.when(F.col("rank") == 4, F.lit(float("nan"))).otherwise(F.col("x2")).alias("x2"),
        F.when(F.col("rank") == 5, F.lit(None)).otherwise(F.col("rank")).cast("int").alias("rank"),
    )


_HOLES = f"""{PTS}, holes AS (SELECT row_key, CASE WHEN rank = 3 THEN NULL ELSE x1 END AS x1,
  CASE WHEN rank = 4 THEN 'NaN'::DOUBLE ELSE x2 END AS x2, CASE WHEN rank = 5 THEN NULL ELSE rank END AS rank FROM pts)"""


@query("fill_zero", f"""
WITH {_HOLES} SELECT row_key, coalesce(x1, 0) AS x1, CASE WHEN isnan(x2) THEN 0 ELSE x2 END AS x2, coalesce(rank, 0) AS rank FROM holes""")
def _fill(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.fill_zero(_holes(points(spark, d)))


@query("null_profile", f"""
WITH {_HOLES}, t AS (SELECT count(*) AS rows, count(*) FILTER (x1 IS NULL OR isnan(x1)) AS a,
  count(*) FILTER (x2 IS NULL OR isnan(x2)) AS b, count(*) FILTER (rank IS NULL) AS c FROM holes)
SELECT rows, 'x1' AS "column", a AS missing FROM t UNION ALL SELECT rows, 'x2', b FROM t UNION ALL SELECT rows, 'rank', c FROM t""")
def _profile(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.null_profile(_holes(points(spark, d)), ["x1", "x2", "rank"])


@query("align_schema", f"WITH {PTS} SELECT CAST(rank AS DOUBLE) AS rank, CAST(x1 AS INT) AS x1, row_key FROM pts")
def _align(spark: SparkSession, d: str) -> DataFrame:
    ref = T.StructType([T.StructField("rank", T.DoubleType()), T.StructField("x1", T.IntegerType()), T.StructField("row_key", T.StringType())])
    return cleaning.align_schema(points(spark, d), ref)


@query("add_intercept", f"WITH {PTS} SELECT 1e0 AS const, row_key, x1 FROM pts")
def _intercept(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.add_intercept(points(spark, d).select("row_key", "x1"))


@query("tag_constants", f"""
WITH {PTS} SELECT bucket, count(*) AS n, 'weighted' AS weight_status, 'B' AS variant, 'grid' AS tuning_type FROM pts GROUP BY bucket""")
def _tag(spark: SparkSession, d: str) -> DataFrame:
    df = cleaning.tag(points(spark, d), weight_status="weighted", variant="B", tuning_type="grid")
    return df.groupBy("bucket", "weight_status", "variant", "tuning_type").agg(F.count("*").alias("n"))


@query("parse_source", """
SELECT CAST(l_orderkey % 5 AS INT) AS fold, CASE WHEN l_linenumber % 2 = 0 THEN 'train' ELSE 'train_val' END AS split,
  CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'B' END AS variant, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def _parse(spark: SparkSession, d: str) -> DataFrame:
    path = F.format_string(
        "/data/folds/CV%d_%s_df_%s.parquet", (F.col("l_orderkey") % 5).cast("int"),
        F.when(F.col("l_linenumber") % 2 == 0, "train").otherwise("train_val"),
        F.when(F.col("l_linestatus") == "F", "A").otherwise("B"),
    )
    t = cleaning.parse_source(table(spark, d, "lineitem").select(path.alias("path")))
    return t.groupBy("fold", "split", "variant").agg(F.count("*").alias("n"))


@query("tidy_results", """
SELECT replace(trim(p_name), ' ', '_') AS model, p_partkey FROM part""")
def _tidy(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").select(F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("part_name"), "p_partkey")
    trimmed = cleaning.tidy_results(df, strip=["part_name"])
    return cleaning.tidy_results(trimmed, {"part_name": "model"}, replace={"part_name": (" ", "_")})


@query("reorder_columns", f"WITH {PTS} SELECT row_key, x2, x1 FROM pts")
def _reorder(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.reorder(points(spark, d), ["row_key", "x2"], ["x1"])


@query("table_shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def _shape(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.shape(table(spark, d, "lineitem"))


@query("distinct_rows", f"""
WITH {PTS_PART}, u AS (SELECT DISTINCT bucket, depth, edge_score FROM pts) SELECT bucket, depth, edge_score FROM u""")
def _distinct(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d, part=True).select("bucket", "depth", "edge_score").dropDuplicates()


@query("distinct_label_weight", f"""
WITH {PTS}, {EDGES}, {binned("pts", "b", "edge_score")}, c AS (SELECT bucket, bin, count(*) AS n FROM b GROUP BY ALL),
w AS (SELECT bucket, bin, (1 / (n + 1e-6)) / sum(1 / (n + 1e-6)) OVER (PARTITION BY bucket) AS w FROM c)
SELECT DISTINCT b.bucket, edge_score, round(w, 10) AS weight FROM b JOIN w USING (bucket, bin)""")
def _label_weight(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d).select("bucket", "edge_score")
    w = weights.row_weights(df, "edge_score", ["bucket"], groups=FOLDS)
    return w.select("bucket", "edge_score", F.round("weight", 10).alias("weight")).distinct()


_COUNTS = f"{PTS}, {EDGES}, {binned('pts', 'b')}, c AS (SELECT bucket, bin, count(*) AS n FROM b GROUP BY ALL)"
_WEIGHTS = f"""{_COUNTS}, w AS (SELECT bucket, bin, n AS count, 1 / (n + 1e-6) AS inverse_count,
  (1 / (n + 1e-6)) / sum(1 / (n + 1e-6)) OVER (PARTITION BY bucket) AS weight FROM c)"""


@query("bin_counts", f"WITH {_COUNTS} SELECT bucket, bin, n AS count FROM c")
def _bin_counts(spark: SparkSession, d: str) -> DataFrame:
    return weights.bin_counts(points(spark, d), "y", ["bucket"])


@query("bin_counts_on_edges", f"""
WITH {PTS}, {EDGES}, {binned("pts", "b", "edge_score")} SELECT bucket, bin, count(*) AS count FROM b GROUP BY ALL""")
def _bin_counts_edges(spark: SparkSession, d: str) -> DataFrame:
    return weights.bin_counts(points(spark, d), "edge_score", ["bucket"])


@query("bin_weights", f"""
WITH {_WEIGHTS} SELECT bucket, bin, count, round(inverse_count, 10) AS inverse_count, round(weight, 10) AS weight FROM w""")
def _bin_weights(spark: SparkSession, d: str) -> DataFrame:
    w = weights.bin_weights(weights.bin_counts(points(spark, d), "y", ["bucket"]), ["bucket"])
    return w.select("bucket", "bin", "count", F.round("inverse_count", 10).alias("inverse_count"), F.round("weight", 10).alias("weight"))


@query("row_weights", f"""
WITH {_WEIGHTS} SELECT row_key, bucket, round(y, 10) AS y, printf('[%.2f, %.2f)', bin * 1e-2, (bin + 1) * 1e-2) AS bin_range, count,
  round(inverse_count, 10) AS inverse_count, round(weight, 10) AS weight FROM b JOIN w USING (bucket, bin)""")
def _row_weights(spark: SparkSession, d: str) -> DataFrame:
    w = weights.row_weights(points(spark, d).select("row_key", "bucket", "y"), "y", ["bucket"], groups=FOLDS)
    return w.select(
        "row_key", "bucket", F.round("y", 10).alias("y"), "bin_range", "count",
        F.round("inverse_count", 10).alias("inverse_count"), F.round("weight", 10).alias("weight"),
    )


@query("training_weights", f"""
WITH {PTS_PART}, {EDGES}, u AS (SELECT DISTINCT bucket, depth, edge_score FROM pts), {binned("u", "b", "edge_score")},
c AS (SELECT bucket, bin, count(*) AS n FROM b GROUP BY ALL),
w AS (SELECT bucket, bin, n AS count, (1 / (n + 1e-6)) / sum(1 / (n + 1e-6)) OVER (PARTITION BY bucket) AS weight FROM c)
SELECT bucket, depth, edge_score, count, round(weight, 10) AS weight FROM b JOIN w USING (bucket, bin)""")
def _training_weights(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d, part=True).select("bucket", "depth", "edge_score")
    w = weights.training_weights(df, "edge_score", ["bucket"], groups=FOLDS)
    return w.select("bucket", "depth", "edge_score", "count", F.round("weight", 10).alias("weight"))


@query("bin_label_text", f"""
WITH {PTS}, {EDGES}, {binned("pts", "b", "edge_score")}
SELECT bin, printf('[%.2f, %.2f)', bin * 1e-2, (bin + 1) * 1e-2) AS bin_range, count(*) AS n FROM b GROUP BY bin""")
def _text(spark: SparkSession, d: str) -> DataFrame:
    b = points(spark, d).groupBy(label_bin(F.col("edge_score")).alias("bin")).agg(F.count("*").alias("n"))
    return b.withColumn("bin_range", bin_text(F.col("bin")))


@query("report_bins", f"""
WITH {PTS}, {REPORT_EDGES}, {report_binned("pts", "b", "edge_score")}
SELECT bin, CASE WHEN bin = 0 THEN 0 WHEN bin = 101 THEN 1 ELSE round(((bin - 1) / 1e2 + bin / 1e2) / 2, 6) END AS centre,
  count(*) AS n FROM b GROUP BY bin""")
def _report_bins(spark: SparkSession, d: str) -> DataFrame:
    b = points(spark, d).groupBy(report_bin(F.col("edge_score")).alias("bin")).agg(F.count("*").alias("n"))
    return b.withColumn("centre", F.round(report_bin_centre(F.col("bin")), 6))


@query("sqrt_weight_features", f"""
WITH {_WEIGHTS} SELECT row_key, round(x1 * sqrt(weight), 8) AS x1, round(x2 * sqrt(weight), 4) AS x2,
  round(y * sqrt(weight), 8) AS y, annotation_score FROM b JOIN w USING (bucket, bin)""")
def _sqrt(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d).select("row_key", "bucket", "x1", "x2", "y", "annotation_score")
    w = weights.row_weights(df, "y", ["bucket"], groups=FOLDS)
    out = cleaning.weight_features(w, ["x1", "x2", "y"])
    return out.select("row_key", F.round("x1", 8).alias("x1"), F.round("x2", 4).alias("x2"), F.round("y", 8).alias("y"), "annotation_score")


@query("naive_mean", f"""
WITH {_DOWN} SELECT 'A' AS variant, bucket, round(avg(y), 8) AS naive_mean, count(*) AS n FROM pts GROUP BY bucket
UNION ALL SELECT 'B', bucket, round(avg(y), 8), count(*) FROM small GROUP BY bucket""")
def _naive_mean(spark: SparkSession, d: str) -> DataFrame:
    df = points(spark, d).select("bucket", "row_key", "y")
    both = sampling.make_variants(df, ["bucket"], "y", ["row_key"], 42, FOLDS)
    return naive_mean(both, "y", ["variant", "bucket"]).withColumn("naive_mean", F.round("naive_mean", 8))
