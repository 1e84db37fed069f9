"""Benchmark decontamination as a prefix-filtered set join, DataFrame functions only.

A benchmark item is cut into windows of ten consecutive words (an item of fewer words is one window). All words
of a window must occur in a document that contains it, so a prefix of one word is enough to find every
container: each window is keyed by its rarest word, rarity counted over all documents. Document words that
equal a key yield candidate starts; length and position bounds drop starts outside the text, and the rest is
compared word by word. Documents are handled by the hash of their text, so copies are matched once.

Defined results: null or wordless texts have no words, no hits; items without words are no windows; repeated
rows each keep their row; items with equal windows all count; empty tables give zeros or no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import kept, lower_ascii, table
from foldwise.llm.registry import query

WINDOW = 10
# Everything that is not 0-9, a-z or beyond ASCII separates words (A-Z are lower-cased before).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = "array<struct<start:int,stop:int>>"
# Windows that go to every executor at most: at about 200 bytes a window this stays below 40 MB. Above it the joins shuffle.
BROADCAST_WINDOWS = 200_000


def word_list(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), GAP), lambda w: w != "")


def small(df: DataFrame, fits: bool) -> DataFrame:
    """``df`` hinted for broadcast where its measured rows stay below the bound, else joined by shuffle."""
    return F.broadcast(df) if fits else df


def windows(benchmark: DataFrame, width: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows with the items that hold them: (window, items)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), word_list(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - width + 1))
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items"))


def find(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, text_col: str = "text") -> DataFrame:
    """One row per distinct text that holds a window: (digest, spans sorted by start, items sorted as strings)."""
    wanted = kept(windows(benchmark, width))
    fits = wanted.count() <= BROADCAST_WINDOWS
    texts = docs.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"), word_list(F.col(text_col)).alias("words"))
    # Rarity over all documents, of the benchmark's words only.
    used = wanted.select(F.explode("window").alias("word")).distinct()
    counts = texts.select(F.explode("words").alias("word")).join(small(used, fits), "word", "left_semi").groupBy("word").count()
    ranked = wanted.select("window", F.posexplode("window").alias("at", "word")).join(small(counts, fits), "word", "left")
    keys = ranked.groupBy("window").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word", "at")).alias("key"))
    # A window with a word no document holds occurs nowhere.
    keys = keys.filter(F.col("key.n") > 0).select("window", F.col("key.word").alias("word"), F.col("key.at").alias("at"))
    keys = kept(keys.join(small(wanted, fits), "window").select("word", "at", "window", "items"))
    places = texts.select("digest", "words", F.posexplode("words").alias("place", "word"))
    start = F.col("place") - F.col("at")
    found = places.join(small(keys, fits), "word").filter(
        (start >= 0) & (start + F.size("window") <= F.size("words"))
    ).filter(F.slice("words", start + 1, F.size("window")) == F.col("window"))
    found = found.select("digest", start.alias("start"), (start + F.size("window")).alias("stop"), "items")
    return found.groupBy("digest").agg(
        F.sort_array(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def covered(spans: Column) -> Column:
    """Words inside any of the spans, which are sorted by start."""
    begin = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    return F.aggregate(spans, begin, lambda a, s: F.struct(
        F.greatest(a["to"], s["stop"]).alias("to"),
        (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["to"], s["start"]))).alias("n"),
    ), lambda a: a["n"].cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans, contaminated), one row per document."""
    found = find(docs, benchmark, width, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"),
                       F.size(word_list(F.col(text_col))).cast("long").alias("n_words"))
    none, no_items = F.array().cast(SPAN), F.array().cast("array<string>")
    rows = rows.join(found, "digest", "left").withColumns({"spans": F.coalesce("spans", none), "items": F.coalesce("items", no_items)})
    rows = rows.withColumn("n_hit", covered(F.col("spans")))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents that hold no window; same columns."""
    found = find(docs, benchmark, width).select(F.col("digest").alias("_digest"))
    return docs.join(found, F.sha2(F.coalesce(docs["text"], F.lit("")), 256) == F.col("_digest"), "left_anti")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
x AS (SELECT item, len(w) AS n, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item, least(n, 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM x),
l AS (SELECT DISTINCT n FROM q),
p AS (SELECT k, l.n, w, unnest(range(1, len(w) - l.n + 2)) AS i FROM d, l WHERE len(w) >= l.n),
h AS (SELECT k, i, q.n, item FROM (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM p) p JOIN q ON p.s = q.s AND p.n = q.n),
c AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS j FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN t USING (k)
"""


@query("op5_decontaminate", SQL)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
