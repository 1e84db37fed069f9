"""Labelled points, predictions, run statistics and histories derived from the given tables.

Each view has a SQL text with the same meaning for the side-by-side check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators.folds import assign_roles, fold_bucket
from foldwise.sources.tables import spread

FOLDS = 5
FEATURES = ["x1", "x2", "x3", "x4"]
LINE_FEATURES = ["x1", "x2", "x3"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, part: bool = False, heavy: bool = False) -> DataFrame:
    """One labelled point per order line; ``part`` adds the columns that need the part table.

    ``heavy`` spreads a small file over all cores for work that is heavy per row.
    """
    lines = table(spark, sf_dir, "lineitem")
    if heavy:
        lines = spread(lines.drop("l_shipdate"))
    q, price = F.col("l_quantity"), F.col("l_extendedprice")
    cols: list[Column] = [
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name"),
        F.concat_ws(
            "|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.round(price * 100).cast("long"), q.cast("long"),
        ).alias("row_key"),
        fold_bucket(F.col("l_orderkey"), FOLDS).alias("bucket"),
        ((q / 50.0) * (price / 105000.0)).alias("y"),
        F.round((q - 1) / 49, 2).alias("edge_score"),
        q.alias("x1"),
        price.alias("x2"),
        (F.col("l_discount") + 0.0).alias("x3"),
        F.col("l_linenumber").alias("rank"),
        F.round(F.col("l_tax") * 100).cast("int").alias("annotation_score"),
        (F.col("l_returnflag") == "A").alias("ontology_f"),
        (F.col("l_returnflag") == "R").alias("ontology_p"),
        (F.col("l_linestatus") == "F").cast("int").alias("protein_existence"),
    ]
    if part:
        parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
        lines = lines.join(parts, lines.l_partkey == parts.p_partkey)
        cols += [F.col("p_retailprice").alias("x4"), F.col("p_size").alias("depth")]
    return lines.select(*cols)


_POINT_COLS = """
    concat_ws('-', l_orderkey, l_linenumber) AS name,
    concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
              CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_quantity AS BIGINT)) AS row_key,
    CAST(l_orderkey % 5 AS INT) AS bucket,
    (l_quantity / 5e1) * (l_extendedprice / 1.05e5) AS y,
    round((l_quantity - 1) / 49, 2) AS edge_score,
    l_quantity AS x1, l_extendedprice AS x2, l_discount + 0e0 AS x3,
    l_linenumber AS rank, CAST(round(l_tax * 100) AS INT) AS annotation_score,
    l_returnflag = 'A' AS ontology_f, l_returnflag = 'R' AS ontology_p,
    CAST(l_linestatus = 'F' AS INT) AS protein_existence
"""
PTS = f"pts AS (SELECT {_POINT_COLS} FROM lineitem)"
PTS_PART = (
    f"pts AS (SELECT {_POINT_COLS}, p_retailprice AS x4, p_size AS depth "
    "FROM lineitem JOIN part ON l_partkey = p_partkey)"
)
EDGES = "edges AS (SELECT i, i * 1e-2 AS lo FROM range(101) t(i))"
REPORT_EDGES = "redges AS (SELECT i, i / 1e2 AS lo FROM range(100) t(i))"
ROLES = """roles AS (
    SELECT CAST(b AS INT) AS bucket, CAST(f AS INT) AS fold, r AS role
    FROM range(5) t(b), range(5) u(f), (VALUES ('train'), ('val'), ('train_val'), ('test')) v(r)
    WHERE (r = 'test' AND b = f) OR (r = 'val' AND b = (f + 1) % 5)
       OR (r = 'train' AND b <> f AND b <> (f + 1) % 5) OR (r = 'train_val' AND b <> f))"""


def binned(src: str, out: str, y: str = "y") -> str:
    """SQL: left-closed bins by comparison with the edges."""
    return f"{out} AS (SELECT s.*, CAST(least(e.i, 99) AS INT) AS bin FROM {src} s ASOF JOIN edges e ON s.{y} >= e.lo)"


def report_binned(src: str, out: str, y: str = "y") -> str:
    """SQL: right-closed bins with exact 0 and 1 apart."""
    return (
        f"{out} AS (SELECT s.*, CAST(CASE WHEN s.{y} = 0 THEN 0 WHEN s.{y} = 1 THEN 101 ELSE e.i + 1 END AS INT) AS bin "
        f"FROM {src} s ASOF LEFT JOIN redges e ON s.{y} > e.lo)"
    )


def metrics_sql(src: str, by: str, prefix: str = "", y: str = "y", p: str = "p") -> str:
    """SQL: CTEs ending in ``{prefix}m`` with row-level metrics of a binned, scored source."""
    keys = [k.strip() for k in by.split(",")]
    on = " AND ".join(f"a.{k} = c.{k}" for k in keys)
    sel = ", ".join(f"a.{k}" for k in keys)
    return f"""
{prefix}c AS (SELECT {by}, bin, 1 / (count(*) + 1e-6) AS inv FROM {src} GROUP BY {by}, bin),
{prefix}w AS (SELECT {by}, bin, inv / sum(inv) OVER (PARTITION BY {by}) AS w FROM {prefix}c),
{prefix}j AS (SELECT a.*, c.w FROM {src} a JOIN {prefix}w c ON {on} AND a.bin = c.bin),
{prefix}mu AS (SELECT {by}, avg({y}) AS m, sum(w * {y}) / sum(w) AS mw FROM {prefix}j GROUP BY {by}),
{prefix}m AS (SELECT {sel}, count(*) AS n,
    sum(({y} - {p}) ** 2) / count(*) AS mse,
    1 - sum(({y} - {p}) ** 2) / sum(({y} - m) ** 2) AS r2,
    sum(abs({y} - {p})) / count(*) AS mae,
    sum(w * ({y} - {p}) ** 2) / sum(w) AS weighted_mse,
    1 - sum(w * ({y} - {p}) ** 2) / sum(w * ({y} - mw) ** 2) AS weighted_r2
  FROM {prefix}j a JOIN {prefix}mu c ON {on} GROUP BY {sel})"""


def preds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[Column], list[Column]]:
    """Points with two fold models: a line on the quantity, and the naive mean.

    The line's slope and intercept come from bucket moments merged to training rows.
    """
    from foldwise.operators.linear import fold_fits, predict
    from foldwise.operators.moments import fold_sums

    df = points(spark, sf_dir)
    sums = fold_sums(df, ["x1"], "y", "bucket", FOLDS)
    line = fold_fits(sums, "train")
    mean = [sums.table[(f, "train")].plain[0, -1] / sums.table[(f, "train")].plain[0, 0] + sums.label_shift for f in range(FOLDS)]
    return df, [predict(f, ["x1"]) for f in line], [F.lit(float(m)) for m in mean]


def scored_rows(spark: SparkSession, sf_dir: str, roles: list[str]) -> DataFrame:
    """Long score table (model, fold, role, row_key, y, p) of both fold models."""
    df, line, mean = preds(spark, sf_dir)
    roled = assign_roles(df.select("row_key", "bucket", "y", "x1"), "bucket", FOLDS, roles)
    at = F.col("fold") + 1
    both = F.array(
        F.struct(F.lit("line").alias("model"), F.element_at(F.array(*line), at).alias("p")),
        F.struct(F.lit("naive").alias("model"), F.element_at(F.array(*mean), at).alias("p")),
    )
    return roled.select("fold", "role", "row_key", "y", F.inline(both))


# Line per fold on the training rows, and the naive mean, as SQL.
LINE_FITS = """fits AS (SELECT fold, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a, avg(y) AS m
    FROM pts JOIN roles USING (bucket) WHERE role = 'train' GROUP BY fold)"""


def scored_sql(roles: str) -> str:
    return f"""scored AS (
    SELECT r.fold, r.role, row_key, y, 'line' AS model, a + b * x1 AS p
    FROM pts JOIN roles r USING (bucket) JOIN fits f ON r.fold = f.fold WHERE r.role IN ({roles})
    UNION ALL
    SELECT r.fold, r.role, row_key, y, 'naive' AS model, m AS p
    FROM pts JOIN roles r USING (bucket) JOIN fits f ON r.fold = f.fold WHERE r.role IN ({roles}))"""


# Whole cents add up the same in any order and engine, so means of event values are exact.
def _cents() -> Column:
    return F.sum(F.round(F.col("value") * 100).cast("long"))


_CENTS_SQL = "CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT)"


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run statistics per (model, fold, parameter key) from events, with ties and failed runs."""
    e = table(spark, sf_dir, "events")
    i = (F.col("event_id") % 7).cast("int")
    base = e.groupBy(
        F.col("event_type").alias("model"), fold_bucket(F.col("user_id"), FOLDS).alias("fold"), i.alias("i")
    ).agg(_cents().alias("cents"), F.count("*").alias("n"))
    wr2 = F.when(F.col("i") == 6, F.lit(float("nan"))).otherwise(F.floor(F.col("cents") / (F.col("n") * 500.0)) / 100.0)
    r2 = F.when(F.col("i") == 6, F.lit(float("nan"))).otherwise(F.floor(F.col("cents") / (F.col("n") * 5000.0)) / 10.0)
    return base.select(
        "model", "fold", "i", F.concat("model", F.lit("_hp_"), "i").alias("param_key"),
        wr2.alias("weighted_val_r2"), (1 - wr2).alias("weighted_val_mse"),
        r2.alias("val_r2"), (1 - r2).alias("val_mse"),
    )


STATS = f"""stats AS (
    SELECT model, fold, i, model || '_hp_' || i AS param_key, wr2 AS weighted_val_r2, 1 - wr2 AS weighted_val_mse,
           r2 AS val_r2, 1 - r2 AS val_mse
    FROM (SELECT event_type AS model, CAST(user_id % 5 AS INT) AS fold, CAST(event_id % 7 AS INT) AS i,
                 CASE WHEN event_id % 7 = 6 THEN 'NaN'::DOUBLE ELSE floor({_CENTS_SQL} / (count(*) * 5e2)) / 1e2 END AS wr2,
                 CASE WHEN event_id % 7 = 6 THEN 'NaN'::DOUBLE ELSE floor({_CENTS_SQL} / (count(*) * 5e3)) / 1e1 END AS r2
          FROM events GROUP BY event_type, user_id % 5, event_id % 7))"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation loss per (fold, layers, optimizer, epoch): the mean event value of each day."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(
        fold_bucket(F.col("user_id"), FOLDS).alias("fold"),
        (F.col("user_id") % 3 + 1).cast("int").alias("layers"),
        F.col("event_type").alias("optimizer"),
        F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).alias("epoch"),
    ).agg((_cents() / (F.count("*") * 50000.0)).alias("val_loss"), (F.min("value") / 500).alias("loss"))


HISTORY = f"""history AS (
    SELECT CAST(user_id % 5 AS INT) AS fold, CAST(user_id % 3 + 1 AS INT) AS layers, event_type AS optimizer,
           CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS epoch,
           {_CENTS_SQL} / (count(*) * 5e4) AS val_loss, min(value) / 500 AS loss
    FROM events GROUP BY 1, 2, 3, 4)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search trials per (fold, trial) from events."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(fold_bucket(F.col("user_id"), FOLDS).alias("fold"), F.col("user_id").alias("trial")).agg(
        (1 - _cents() / (F.count("*") * 50000.0)).alias("weighted_test_r2"), (_cents() / (F.count("*") * 50000.0)).alias("val_loss")
    )


TRIALS = f"""trials AS (
    SELECT CAST(user_id % 5 AS INT) AS fold, user_id AS trial, 1 - {_CENTS_SQL} / (count(*) * 5e4) AS weighted_test_r2,
           {_CENTS_SQL} / (count(*) * 5e4) AS val_loss
    FROM events GROUP BY 1, 2)"""
