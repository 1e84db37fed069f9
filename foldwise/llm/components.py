"""Connected components by repeated contraction, as joins and aggregations.

Each round every linked node hooks to its smallest linked node if that is smaller; edges are rewritten to the hooks and
made distinct, so they shrink to nothing. Only linked nodes take part. Tables are written to the shared
folder between rounds; nothing but a row count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of the component.

    Loops, repeated and reversed edges do no harm; nulls are dropped; no edges give no rows.
    """
    def clean(e: DataFrame) -> DataFrame:
        return kept(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") < F.col("b")).distinct())

    edges = clean(edges)
    roots = None
    while not edges.isEmpty():
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("to")).union(edges.select(F.col("a").alias("node"), F.col("b").alias("to")))
        hooks = kept(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")))
        if roots is None:
            roots = hooks.withColumnRenamed("to", "root")
        else:
            h = hooks.select(F.col("node").alias("_node"), F.col("to").alias("_to"))
            roots = roots.join(h, roots["root"] == h["_node"], "left").select("node", F.coalesce("_to", "root").alias("root"))
            # A node that joins only now cannot exist: later edges connect roots of the first round's nodes.
        roots = kept(roots)
        left = edges.join(hooks.select(F.col("node").alias("a"), F.col("to").alias("_a")), "a")
        edges = clean(left.join(hooks.select(F.col("node").alias("b"), F.col("to").alias("_b")), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
