"""Incremental secret scans over content-addressed blobs, DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. A ledger holds one row per (blob, rule,
rule version) ever scanned, with the spans found, even if none. A scan takes the pairs the ledger
lacks, reads each such blob once however many paths carry it, and joins all findings back to all paths.

Defined results: a null text is an empty blob; repeated rows each keep their row; an empty table gives no rows;
only the named id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foldwise.llm.common import kept, measured, table
from foldwise.llm.registry import query


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count when the group has ``shortest`` characters. A changed rule takes a new version."""

    kind: str
    pattern: str
    group: int
    shortest: int
    version: int = 1


# The base rules. A run too short for `access` or `hex` hides no longer one inside it, so the shortest length
# stands in their patterns; a failing `assign` match does use up text, so it is matched first and judged after.
RULES = (
    Rule("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
LEDGER = "blob string, rule string, version int, spans array<struct<start:int,stop:int>>"


def blob_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _candidates(rule: Rule) -> Column:
    """Structs (rule, version, place, gap, length) of one rule: the text before each match and the match itself,
    as lengths; failing matches stay, since they too move what follows. Texts without a valid match get one empty mark."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), 1, F.size(found))
    made = F.transform(F.arrays_zip(gaps.alias("gap"), found.alias("found"), groups.alias("part")), lambda x, i: F.struct(
        F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), i.alias("place"),
        F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("size"),
        (F.length(x["part"]) >= rule.shortest).alias("valid")))
    mark = F.array(F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), F.lit(0).alias("place"),
                            F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(False).alias("valid")))
    return F.when(text.rlike(rule.pattern), made).otherwise(mark)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for (blob, text, todo): every rule named in ``todo`` over every blob, whole."""
    per_rule = [F.when(F.array_contains("todo", r.kind), _candidates(r)).otherwise(F.array()) for r in rules]
    found = blobs.select("blob", F.inline(F.concat(*per_rule)))
    order = W.partitionBy("blob", "rule", "version").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    found = found.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(order).cast("int"))
    span = F.struct((F.col("stop") - F.col("size")).cast("int").alias("start"), "stop")
    # collect_list leaves nulls out, so failing matches and marks vanish while their ledger row stays.
    return found.groupBy("blob", "rule", "version").agg(F.sort_array(F.collect_list(F.when(F.col("valid"), span))).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
         id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths with findings, new ledger rows).

    The first has one row per input row: id, blob, spans as array of (start, place of the kind, stop, kind) in order.
    Append the second to the ledger; the next run then reads only new blobs, and old ones under rules whose version changed.
    """
    spark = docs.sparkSession
    versions = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    versions = versions.withColumn("blob", blob_address(F.col("text")))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        # Partial aggregation drops most copies before the shuffle; one text per blob is left after it.
        todo = versions.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
        known = spark.createDataFrame([], LEDGER)
    else:
        known = ledger.join(spark.createDataFrame([(r.kind, r.version) for r in rules], "rule string, version int"), ["rule", "version"], "left_semi")
        known = known.select("blob", "rule", "version", "spans")
        # Ids and addresses decide; texts are fetched for one path of each unseen blob only.
        addresses = versions.groupBy("blob").agg(F.min("doc_id").alias("path"))
        pairs = addresses.select("blob", "path", F.inline(wanted)).join(known, ["blob", "rule", "version"], "left_anti")
        fresh = pairs.groupBy("blob", "path").agg(F.collect_set("rule").alias("todo")).alias("f")
        todo = versions.alias("v").join(fresh, (F.col("v.blob") == F.col("f.blob")) & F.col("v.doc_id").eqNullSafe(F.col("f.path")))
        todo = todo.groupBy("v.blob").agg(F.first("v.text").alias("text"), F.first("f.todo").alias("todo"))
    new = kept(scan_blobs(todo, rules))
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    spans = known.unionByName(new).select("blob", "rule", F.explode("spans").alias("span"))
    spans = spans.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct(
        F.col("span.start").alias("start"), F.element_at(place, F.col("rule")).alias("place"), F.col("span.stop").alias("stop"), F.col("rule").alias("kind")))).alias("spans"))
    paths = versions.select("doc_id", "blob").join(spans, "blob", "left")
    empty = F.array().cast("array<struct<start:int,place:int,stop:int,kind:string>>")
    return paths.select("doc_id", "blob", F.coalesce("spans", empty).alias("spans")), new


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, found: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of its text replaced by a mask; overlapping spans share one. Same columns.

    Findings are joined by blob, one row each, so ids may repeat or be null.
    """
    by_blob = measured(found.filter(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("_spans")).withColumnRenamed("blob", "_blob"))
    joined = docs.withColumn("_address", blob_address(F.col("text"))).join(by_blob, F.col("_address") == F.col("_blob"), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        return F.struct(F.concat(acc["out"], gap, F.when(s["stop"] > acc["at"], F.when(s["start"] >= acc["at"], F.lit(mask)).otherwise("")).otherwise("")).alias("out"),
                        F.greatest(acc["at"], s["stop"]).alias("at"))

    clean = F.aggregate("_spans", start, add, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return joined.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(clean)).select(*docs.columns)


def _sql(rule: Rule, place: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, k, '{rule.kind}' AS kind, {place} AS place, i, part,
  list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start, length(found[i]) AS size
 FROM (SELECT doc_id, k, string_split_regex(t, '{pattern}') AS gaps, found, parts, unnest(range(1, len(found) + 1)) AS i, parts[i] AS part
  FROM (SELECT doc_id, k, t, regexp_extract_all(t, '{pattern}', 0) AS found, regexp_extract_all(t, '{pattern}', {rule.group}) AS parts FROM d))
 WHERE length(part) >= {rule.shortest}"""


SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_sql(r, i) for i, r in enumerate(RULES))}),
g AS (SELECT k, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
 string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, place) AS s FROM m GROUP BY k)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
 sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans FROM d LEFT JOIN g USING (k)
"""


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest and text of a scan's paths; the method adds no spans to the base rules', so one text serves both."""
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    text = span_text(F.col("spans"))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))


@query("op1_secret_scan", SQL)
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = scan(table(spark, sf_dir, "documents"))
    return digest(found)
