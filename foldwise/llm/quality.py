"""Quality by a sparse rule ensemble.

Text statistics are Spark columns over whole texts. A random forest on the labelled training rows proposes conjunctive rules
(every path from a root to a node); a lasso logistic regression keeps the few that matter; those are compiled into one Spark column
expression, so scoring runs inside generated code.

Defined results: null and empty texts have all statistics 0 and are scored like any other; repeated rows each keep their row; conflicting
labels of an id count as the higher; null ids match no label; with labels of one kind only, or none, the score is the
smoothed share of good labels; an empty table gives no rows; only id and text of a document are read.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import kept, remainder, table
from foldwise.llm.registry import query
from foldwise.llm.toxicity import labelled

TREES, DEPTH = 16, 4
# Labelled rows the forest and the lasso see at most: those of smallest hash, whatever the table's order.
FIT_ROWS = 200_000
LASSO = 0.001
THRESHOLD = 0.3

Rule = tuple[tuple[str, str, float], ...]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, one column per statistic)."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def chars(pattern: str) -> Column:
        """Characters that the pattern's complement class leaves."""
        return F.length(F.regexp_replace(F.col("_t"), pattern, ""))

    def share(part: Column, whole: str) -> Column:
        return F.coalesce(part / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0)).cast("double")

    rows = docs.select("doc_id", text.alias("_t")).withColumns({
        "_w": F.filter(F.split(F.lower("_t"), r"\s+"), lambda w: w != ""), "_l": F.filter(F.split("_t", r"\n+"), lambda w: w != "")})
    rows = rows.withColumns({
        "n_chars": F.length("_t").cast("double"), "n_words": F.size("_w").cast("double"), "n_lines": F.size("_l").cast("double"),
        "_dw": F.size(F.array_distinct("_w")), "_dl": F.size(F.array_distinct("_l")),
        "_letters": chars(r"[^\p{L}]+"), "_upper": chars(r"[^\p{Lu}]+"), "_digits": chars("[^0-9]+"),
        "_symbols": chars(r"[^#$%&*@|<>{}=+~^_\\/\[\]-]+"), "_loud": chars("[^!?]+"), "_stops": chars("[^.,;:]+"),
    })
    return rows.select(
        "doc_id", "n_chars", "n_words", "n_lines",
        share(F.col("_dw"), "n_words").alias("distinct_words"), share(F.col("_dl"), "n_lines").alias("distinct_lines"),
        share(F.col("_letters"), "n_chars").alias("letters"), share(F.col("_upper"), "_letters").alias("upper"),
        share(F.col("_digits"), "n_chars").alias("digits"), share(F.col("_symbols"), "n_chars").alias("symbols"),
        share(F.col("_loud"), "n_words").alias("loud"), share(F.col("_stops"), "n_words").alias("stops"),
        share(F.col("_letters"), "n_words").alias("word_length"), share(F.col("n_words"), "n_lines").alias("line_words"),
        share(F.col("n_words"), "_dw").alias("repeats"))


def rules_of(debug: str, names: list[str]) -> list[Rule]:
    """The conjunctions on all paths of a printed forest, each once; conditions in a fixed order."""
    found: set[Rule] = set()
    path: list[tuple[str, str, float]] = []
    for line in debug.splitlines():
        indent = len(line) - len(line.lstrip())
        if m := re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            # Two spaces a level below the two headers; an Else stands where its If stood.
            depth = (indent - first) if path else 0
            if not path:
                first = indent
            del path[depth:]
            path.append((names[int(m[1])], m[2], float(m[3])))
            found.add(tuple(sorted(path)))
        elif line.lstrip().startswith("Tree"):
            path = []
    return sorted(found)


def as_column(rule: Rule) -> Column:
    condition = F.lit(True)
    for name, sign, value in rule:
        condition = condition & (F.col(name) <= value if sign == "<=" else F.col(name) > value)
    return condition


def fit(train: DataFrame, names: list[str]) -> tuple[float, list[tuple[Rule, float]]]:
    """(constant, [(rule, weight)]) from rows with the statistics and a 0/1 ``label``."""
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    if len(counts) < 2:
        return math.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)), []
    label = F.col("label").cast("double")
    rows = train.select(label.alias("label"), array_to_vector(F.array(*names)).alias("features"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="0.5", maxMemoryInMB=64).fit(rows)
    rules = rules_of(forest.toDebugString, names)
    if not rules:
        return math.log((counts[1] + 0.5) / (counts[0] + 0.5)), []
    fired = train.select(label.alias("label"), array_to_vector(F.array(*[as_column(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=100).fit(fired)
    return lasso.intercept, [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w != 0.0]


def compiled(constant: float, rules: list[tuple[Rule, float]]) -> Column:
    total = F.lit(constant)
    for rule, weight in rules:
        total = total + F.when(as_column(rule), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, statistics, score) for every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, label)."""
    stats = kept(statistics(docs))
    names = stats.columns[1:]
    train = labelled(stats, labels).orderBy(F.md5(F.col("doc_id").cast("string"))).limit(FIT_ROWS)
    constant, rules = fit(kept(train), names)
    return stats.withColumn("score", compiled(constant, rules))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = score(table(spark, sf_dir, "documents"), labels)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
