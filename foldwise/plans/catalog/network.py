"""Network search analytics on histories, predictions and gradients derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.scalar import hidden_widths, linear_funnel, log_funnel
from foldwise.operators import distribution, metrics, network
from foldwise.operators.folds import fold_bucket
from foldwise.operators.grid import network_space
from foldwise.operators.selection import best_per_fold
from foldwise.plans.catalog.registry import query
from foldwise.plans.fixtures import EDGES, FOLDS, HISTORY, binned, history, metrics_sql, table

KEYS = ["fold", "layers", "optimizer"]


@query("history_long", f"""
WITH {HISTORY}, l AS (SELECT fold, layers, optimizer, epoch, 'loss' AS metric, loss AS value FROM history
  UNION ALL SELECT fold, layers, optimizer, epoch, 'val_loss', val_loss FROM history)
SELECT fold, layers, optimizer, metric, CAST(row_number() OVER (PARTITION BY fold, layers, optimizer, metric ORDER BY epoch) - 1 AS INT) AS epoch, value FROM l""")
def _history(spark: SparkSession, d: str) -> DataFrame:
    wide = history(spark, d)
    long = wide.select(*KEYS, "epoch", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("loss", "val_loss")])))
    return network.history_long(network.history_map(long, KEYS))


@query("best_epoch", f"""
WITH {HISTORY} SELECT fold, layers, optimizer, arg_min(epoch, (val_loss, epoch)) AS best_epoch, min(val_loss) AS best_loss
FROM history GROUP BY ALL""")
def _best_epoch(spark: SparkSession, d: str) -> DataFrame:
    return network.best_epoch(history(spark, d), KEYS)


_ORDERED = f"""{HISTORY}, o AS (SELECT *, row_number() OVER (PARTITION BY fold, layers, optimizer ORDER BY epoch) AS rn FROM history)"""


@query("early_stop", f"""
WITH RECURSIVE {_ORDERED}, s AS (
  SELECT fold, layers, optimizer, rn, val_loss AS best, CAST(epoch AS BIGINT) AS best_epoch, 0 AS wait, CAST(NULL AS BIGINT) AS stop FROM o WHERE rn = 1
  UNION ALL
  SELECT o.fold, o.layers, o.optimizer, o.rn, CASE WHEN val_loss < best - 1e-6 THEN val_loss ELSE best END,
    CASE WHEN val_loss < best - 1e-6 THEN CAST(epoch AS BIGINT) ELSE best_epoch END,
    CASE WHEN val_loss < best - 1e-6 THEN 0 ELSE wait + 1 END,
    CASE WHEN NOT val_loss < best - 1e-6 AND wait + 1 >= 10 THEN CAST(epoch AS BIGINT) END
  FROM s JOIN o ON s.fold = o.fold AND s.layers = o.layers AND s.optimizer = o.optimizer AND o.rn = s.rn + 1 WHERE stop IS NULL)
SELECT fold, layers, optimizer, arg_max(best_epoch, rn) AS best_epoch, arg_max(best, rn) AS best_loss, max(stop) AS stop_epoch FROM s GROUP BY ALL""")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    return network.early_stop(history(spark, d), KEYS)


@query("lr_plateau", f"""
WITH RECURSIVE {_ORDERED}, s AS (
  SELECT fold, layers, optimizer, rn, val_loss AS best, 0 AS wait, 1e-3 AS rate, 0 AS cuts, CAST(NULL AS BIGINT) AS last_cut FROM o WHERE rn = 1
  UNION ALL
  SELECT o.fold, o.layers, o.optimizer, o.rn, CASE WHEN val_loss < best - 1e-4 THEN val_loss ELSE best END,
    CASE WHEN val_loss < best - 1e-4 OR (wait + 1 >= 10 AND rate > 1e-6) THEN 0 ELSE wait + 1 END,
    CASE WHEN NOT val_loss < best - 1e-4 AND wait + 1 >= 10 AND rate > 1e-6 THEN greatest(rate * 5e-1, 1e-6) ELSE rate END,
    cuts + CASE WHEN NOT val_loss < best - 1e-4 AND wait + 1 >= 10 AND rate > 1e-6 THEN 1 ELSE 0 END,
    CASE WHEN NOT val_loss < best - 1e-4 AND wait + 1 >= 10 AND rate > 1e-6 THEN CAST(epoch AS BIGINT) ELSE last_cut END
  FROM s JOIN o ON s.fold = o.fold AND s.layers = o.layers AND s.optimizer = o.optimizer AND o.rn = s.rn + 1)
SELECT fold, layers, optimizer, arg_max(rate, rn) AS final_rate, arg_max(cuts, rn) AS cuts, max(last_cut) AS last_cut FROM s GROUP BY ALL""")
def _plateau(spark: SparkSession, d: str) -> DataFrame:
    return network.lr_plateau(history(spark, d), KEYS)


def _network_preds(spark: SparkSession, d: str) -> DataFrame:
    """Test rows per (fold, layers, optimizer): an event's value as label, its share of a hundred as prediction."""
    e = table(spark, d, "events")
    return e.select(
        fold_bucket(F.col("user_id"), FOLDS).alias("fold"), (F.col("user_id") % 3 + 1).cast("int").alias("layers"),
        F.col("event_type").alias("optimizer"), (F.col("value") / 500).alias("y"),
        (F.get_json_object("props", "$.k").cast("double") / 100 * 0.2).alias("p"),
    )


_NET = f"""{EDGES}, scored AS (SELECT CAST(user_id % 5 AS INT) AS fold, CAST(user_id % 3 + 1 AS INT) AS layers, event_type AS optimizer,
  value / 5e2 AS y, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 1e2 * 2e-1 AS p FROM events), {binned("scored", "b")}"""
_NET_COLS = "round(mse, 8) AS mse, round(r2, 8) AS r2, round(weighted_mse, 8) AS weighted_mse, round(weighted_r2, 8) AS weighted_r2"


@query("network_metrics", f"""
WITH {_NET}, {metrics_sql("b", "fold, layers, optimizer")} SELECT fold, layers, optimizer, n, {_NET_COLS} FROM m""")
def _network_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.score(_network_preds(spark, d), KEYS, "y", "p").drop("bad", "mae")
    return out.withColumns({c: F.round(c, 8) for c in metrics.METRICS if c != "mae"})


@query("best_per_fold", f"""
WITH {_NET}, {metrics_sql("b", "fold, layers, optimizer")},
r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY weighted_r2 DESC, layers, optimizer) AS rn FROM m)
SELECT fold, layers, optimizer, n, {_NET_COLS} FROM r WHERE rn = 1""")
def _best(spark: SparkSession, d: str) -> DataFrame:
    all_ = metrics.score(_network_preds(spark, d), KEYS, "y", "p").drop("bad", "mae")
    out = best_per_fold(all_, ["fold"], "weighted_r2", ["layers", "optimizer"])
    return out.withColumns({c: F.round(c, 8) for c in metrics.METRICS if c != "mae"})


@query("network_report", f"""
WITH {_NET}, {metrics_sql("b", "fold, layers, optimizer")},
r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY weighted_r2 DESC, layers, optimizer) AS rn FROM m),
win AS (SELECT fold, layers, optimizer FROM r WHERE rn = 1),
pool AS (SELECT 1 AS one, b.* FROM b JOIN win USING (fold, layers, optimizer)), {metrics_sql("pool", "one", "p_")}
SELECT m.fold, m.layers, m.optimizer, n,
  round(m.mse, 8) AS mse, round(m.r2, 8) AS r2, round(m.weighted_mse, 8) AS weighted_mse, round(m.weighted_r2, 8) AS weighted_r2,
  t.total_mse, t.total_r2, t.total_wmse, t.total_wr2
FROM m LEFT JOIN (SELECT win.*, round(mse, 8) AS total_mse, round(r2, 8) AS total_r2, round(weighted_mse, 8) AS total_wmse,
  round(weighted_r2, 8) AS total_wr2 FROM win, p_m) t ON m.fold = t.fold AND m.layers = t.layers AND m.optimizer = t.optimizer""")
def network_report(spark: SparkSession, d: str) -> DataFrame:
    moments = metrics.bin_moments(_network_preds(spark, d), KEYS, "y", "p")
    _, _, joined = network.network_report(moments, "fold", ["layers", "optimizer"])
    cols = ["mse", "r2", "weighted_mse", "weighted_r2", "total_mse", "total_r2", "total_wmse", "total_wr2"]
    return joined.drop("bad", "mae").withColumns({c: F.round(c, 8) for c in cols})


@query("gradient_summary", """
WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, count(*) AS n, round(avg(abs(x)), 6) AS mean_abs, round(sqrt(sum(x * x)), 6) AS l2_norm, min(x) AS low, max(x) AS high
FROM v GROUP BY label""")
def _gradients(spark: SparkSession, d: str) -> DataFrame:
    out = network.gradient_summary(table(spark, d, "embeddings"), ["label"], "embedding")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_abs", "l2_norm")})


@query("gradient_histogram", """
WITH v AS (SELECT label, abs(unnest(embedding)::DOUBLE) AS x FROM embeddings), e AS (SELECT i, i * (1e0 / 30) AS lo FROM range(31) t(i)),
c AS (SELECT label, CAST(least(i, 29) AS INT) AS bin, count(*) AS n FROM v ASOF JOIN e ON x >= lo WHERE x <= 1 GROUP BY ALL)
SELECT g.label, CAST(i AS INT) AS bin, coalesce(n, 0) AS count FROM (SELECT DISTINCT label FROM embeddings) g CROSS JOIN range(30) t(i)
LEFT JOIN c ON c.label = g.label AND c.bin = i""")
def _gradient_histogram(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select("label", F.explode("embedding").alias("x"))
    h = distribution.histogram(v.withColumn("x", F.abs(F.col("x").cast("double"))), ["label"], "x", 30)
    return h.drop("centre")


@query("funnel_widths", """
WITH p AS (SELECT p_partkey, p_size AS n FROM part),
r AS (SELECT p_partkey, n, i, CASE WHEN i = n - 1 AND n > 1 THEN 8e0 ELSE i * ((8e0 - 256e0) / greatest(n - 1, 1)) + 256e0 END AS lin,
  256e0 * ((8e0 / 256e0) ** (1e0 / greatest(n - 1, 1))) ** i AS lg FROM p, LATERAL (SELECT unnest(range(n)) AS i))
SELECT p_partkey, n AS layers, CAST(i AS INT) AS position, CAST(greatest(round_even(lin / 8, 0) * 8, 8) AS INT) AS linear_width,
  CAST(round_even(lg / 8, 0) * 8 AS INT) AS log_width FROM r""")
def _funnel(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    widths = F.arrays_zip(linear_funnel(n).alias("linear_width"), log_funnel(n).alias("log_width"))
    return table(spark, d, "part").select("p_partkey", n.alias("layers"), F.posexplode(widths).alias("position", "w")).select(
        "p_partkey", "layers", "position", "w.linear_width", "w.log_width"
    )


@query("network_space", """
WITH cfg AS (SELECT DISTINCT CAST(user_id % 14 + 1 AS INT) AS layers, event_type AS optimizer FROM events),
w AS (SELECT layers, optimizer, i, CASE WHEN layers <= 3 THEN 64 // (2 ** i)
  ELSE greatest(round_even((CASE WHEN i = layers - 1 THEN 8e0 ELSE i * ((8e0 - 256e0) / (layers - 1)) + 256e0 END) / 8, 0) * 8, 8) END AS width
  FROM cfg, LATERAL (SELECT unnest(range(layers)) AS i))
SELECT layers, optimizer, CAST(f AS INT) AS fold, CAST(i AS INT) AS position, CAST(width AS INT) AS width FROM w, range(5) t(f)""")
def _space(spark: SparkSession, d: str) -> DataFrame:
    cfg = table(spark, d, "events").select((F.col("user_id") % 14 + 1).cast("int").alias("layers"), F.col("event_type").alias("optimizer")).distinct()
    explicit = F.create_map(*[x for n in (1, 2, 3) for x in (F.lit(n), F.array(*[F.lit(64 // 2**i) for i in range(n)]))])
    space = network_space(cfg, list(range(FOLDS)), hidden_widths(F.col("layers"), explicit))
    return space.select("layers", "optimizer", "fold", F.posexplode("widths").alias("position", "width"))


@query("layer_listing", """
WITH p AS (SELECT p_partkey, p_size AS n FROM part),
r AS (SELECT p_partkey, n, i + 2 AS position, CASE WHEN i = n - 1 AND n > 1 THEN 8e0 ELSE i * ((8e0 - 256e0) / greatest(n - 1, 1)) + 256e0 END AS lin
  FROM p, LATERAL (SELECT unnest(range(n)) AS i))
SELECT p_partkey, CAST(position AS INT) AS position, CAST(greatest(round_even(lin / 8, 0) * 8, 8) AS INT) AS neurons, 'Hidden' AS role FROM r
UNION ALL SELECT p_partkey, 1, 512, 'Input' FROM p UNION ALL SELECT p_partkey, n + 2, 1, 'Output' FROM p""")
def _layers(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").select("p_partkey", linear_funnel(F.col("p_size")).alias("widths"))
    return network.layer_listing(df)
