"""Near-duplicates by MinHash with sequential Bayesian verification.

1. Every whole text becomes its set of distinct five-word shingles (64-bit hashes), a fingerprint of that set and a MinHash
   signature. Equal sets fall together first, so copies are compared once.
2. Signatures are cut into bands; sets that agree in a band share a bucket. In each bucket the member that shares
   most buckets with others is the hub, and every member is paired with it: links grow with the members, not their square.
3. Pairs are judged by batches of hashes: after each batch the posterior of the similarity (uniform prior) given the
   agreements so far is compared with the threshold, and a pair is dropped once the chance that it reaches
   the threshold falls below ``MISS``. Survivors are confirmed on the full sets.
4. Members that are still in another component than their bucket's hub are compared with the whole bucket, in blocks
   of bounded size, under the same rule. Pairs inside a component change nothing and are not made.

At the threshold a pair misses all 24 bands of 5 with chance 7.7e-7 at 0.85 and 7.3e-5 at 0.8; batches add at most ``MISS`` each.

Defined results: null, empty or wordless texts have no shingles, are linked with nothing and keep themselves; fewer than five
words are one shingle; repeated rows are copies; the smallest id of a component is kept (every row that carries it); a null id
ranks last; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import WordHashes, gram_hashes, kept, mixed, table, words
from foldwise.llm.components import components
from foldwise.llm.registry import query

SHINGLE = 5
THRESHOLD = (85, 100)
BANDS, ROWS = 24, 5
BATCH = 30
MISS = 1e-4
BLOCK = 512
_SEEDS = np.random.default_rng(20).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), seed=len(tokens))], np.uint64)
    return np.unique(gram_hashes(hashes.array(tokens), SHINGLE))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each; the set is taken in pieces so that a very long text needs no more memory."""
    low = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        scrambled = part[None, :] * _SEEDS[:, None]
        scrambled ^= scrambled >> np.uint64(32)
        np.minimum(low, (scrambled * np.uint64(0x94D049BB133111EB)).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


@functools.cache
def least_agreements(threshold: float, miss: float = MISS) -> tuple[tuple[int, int], ...]:
    """(hashes compared, agreements below which a pair is dropped) per batch.

    With a uniform prior the posterior after m agreements of n is Beta(m + 1, n - m + 1), and its mass above t is
    the chance that a binomial of n + 1 draws with rate t gives m or fewer.
    """
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        below, m = 0.0, 0
        while m <= n:
            below += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
            if below >= miss:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the signature pairs (rows of a and b) no batch drops."""
    alive = np.arange(len(a))
    for n, least in least_agreements(threshold):
        if not len(alive):
            break
        alive = alive[(a[alive, :n] == b[alive, :n]).sum(axis=1) >= least]
    return alive


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        digests = batch.column("digest")
        ids, sizes, prints, signs = [], [], [], []
        for i, text in zip(batch.column("doc_id"), batch.column("text")):
            s = shingle_set(text.as_py(), hashes)
            ids.append(i.as_py())
            sizes.append(len(s))
            prints.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
            signs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), digests, pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary())],
            names=["doc_id", "digest", "n_shingles", "print", "sign"])


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_shingles, print, sign): set size, fingerprint of the set, MinHash signature; a missing digest stays null."""
    digest = F.col("digest") if "digest" in docs.columns else F.lit(None).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_sketch, "doc_id long, digest binary, n_shingles long, print binary, sign binary")


def _bands(sign: Column) -> Column:
    """(band, bucket): the hash of each band's values. A clash of two buckets only adds candidates."""
    return F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.substring(sign, b * ROWS * 4 + 1, ROWS * 4)).alias("bucket")) for b in range(BANDS)])


def _hub_pairs(threshold: float):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sign", "hub_sign"))
                chosen = pa.array(survivors(a, b, threshold))
                yield pa.RecordBatch.from_arrays([batch.column("print").take(chosen), batch.column("hub").take(chosen)], names=["a", "b"])
    return judge


def _block_pairs(threshold: float):
    """Strays of one block against the members of another; a pair counts in the first band it shares.

    One row per member that is still in question, with the candidates of each stray as a list.
    """
    def judge(key: tuple, rows: pa.Table) -> pa.Table:
        side = np.array(rows.column("side").to_pylist())
        sign = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint32).reshape(rows.num_rows, -1)
        prints, roots = np.array(rows.column("print").to_pylist(), object), np.array(rows.column("root").to_pylist(), object)
        right = np.flatnonzero(side == 1)
        band = key[0].as_py()
        partners: dict[bytes, set[bytes]] = {}
        root_of: dict[bytes, bytes] = {}
        for i in np.flatnonzero(side == 0):
            js = right[roots[right] != roots[i]]
            js = js[survivors(np.broadcast_to(sign[i], (len(js), sign.shape[1])), sign[js], threshold)]
            if band and len(js):
                js = js[~(sign[js, : band * ROWS] == sign[i, : band * ROWS]).reshape(len(js), band, ROWS).all(axis=2).any(axis=1)]
            for j in js:
                root_of[prints[i]], root_of[prints[j]] = roots[i], roots[j]
                # Two strays meet twice in a block; one meeting is enough.
                if prints[i] not in partners.get(prints[j], ()):
                    partners.setdefault(prints[i], set()).add(prints[j])
        names = list(root_of)
        columns = {k: pa.array([v.as_py()] * len(names), t) for (k, t), v in zip(_BLOCK_KEY, key)}
        return pa.table(columns | {
            "print": pa.array(names, pa.binary()), "root": pa.array([root_of[p] for p in names], pa.binary()),
            "partners": pa.array([list(partners.get(p, ())) for p in names], pa.list_(pa.binary()))})
    return judge


_BLOCK_KEY = (("band", pa.int32()), ("bucket", pa.int64()), ("x", pa.int32()), ("y", pa.int32()))


def _similar(x: np.ndarray, y: np.ndarray, numerator: int, denominator: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return denominator * both >= numerator * (len(x) + len(y) - both)


def _block_links(numerator: int, denominator: int):
    """Links of one block, confirmed on the full sets; one link of a stray to each other component joins the two."""
    def confirm(rows: pa.Table) -> pa.Table:
        prints = rows.column("print").to_pylist()
        root_of = dict(zip(prints, rows.column("root").to_pylist()))
        sets = {p: np.frombuffer(s, np.uint64) for p, s in zip(prints, rows.column("shingles").to_pylist())}
        out = []
        for p, partners in zip(prints, rows.column("partners").to_pylist()):
            joined = set()
            for q in partners:
                if root_of[q] not in joined and _similar(sets[p], sets[q], numerator, denominator):
                    joined.add(root_of[q])
                    out.append((p, q))
        return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})
    return confirm


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full set of each text that has the fingerprint it was fetched for; another text under the same id is left out."""
    hashes = WordHashes()
    for batch in batches:
        prints, sets = [], []
        for p, text in zip(batch.column("print").to_pylist(), batch.column("text").to_pylist()):
            shingles = shingle_set(text, hashes).tobytes()
            if xxhash.xxh128_digest(shingles) == p:
                prints.append(p)
                sets.append(shingles)
        yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(sets, pa.binary())], names=["print", "shingles"])


def _confirmed(numerator: int, denominator: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"))):
                if _similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), numerator, denominator):
                    good.append(i)
            chosen = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(chosen), batch.column("b").take(chosen)], names=["a", "b"])
    return confirm


def _sets(involved: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(print, shingles): the full sets made again, for the distinct fingerprints in ``involved`` only."""
    chosen = classes.select("print", F.col("doc_id").alias("_id")).join(involved, "print", "left_semi")
    texts = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id"))).select("print", "text")
    return kept(texts.mapInArrow(_full_sets, "print binary, shingles binary").groupBy("print").agg(F.first("shingles").alias("shingles")))


def _confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs of fingerprints whose full sets are similar enough."""
    pairs = kept(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("print")), docs, classes)
    joined = pairs.join(sets.select(F.col("print").alias("a"), F.col("shingles").alias("set_a")), "a")
    joined = joined.join(sets.select(F.col("print").alias("b"), F.col("shingles").alias("set_b")), "b")
    return kept(joined.mapInArrow(_confirmed(*threshold), "a binary, b binary"))


def placed_rows(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc_id, digest, n_shingles, print, least), one row per input row (doc_id, digest, text).

    ``least`` is the lowest (no_id, doc_id, digest) of the row's component; null, as ``print``, without shingles.
    """
    rate = threshold[0] / threshold[1]
    sketched = kept(sketches(docs))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    classes = sketched.filter(F.col("print").isNotNull()).groupBy("print").agg(
        F.min("doc_id").alias("doc_id"), F.first("sign").alias("sign"), F.min(rank).alias("own"))
    classes = kept(classes)
    signs = classes.select("print", "sign")

    placed = signs.select("print", F.inline(_bands(F.col("sign"))))
    sizes = placed.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    # The widest table stays on the executors' disks: made again from ``classes`` if lost, and given up once the rows are rooted.
    members = placed.join(sizes, ["band", "bucket"]).persist(StorageLevel.DISK_ONLY)
    score = members.groupBy("print").agg(F.sum(F.col("n") - 1).alias("score"))
    hubs = members.join(score, "print").groupBy("band", "bucket").agg(F.max(F.struct("score", "print")).alias("top"))
    hubs = kept(hubs.select("band", "bucket", F.col("top.print").alias("hub")))
    near = members.join(hubs, ["band", "bucket"]).filter(F.col("print") != F.col("hub")).select("print", "hub").distinct()
    near = near.join(signs, "print").join(signs.select(F.col("print").alias("hub"), F.col("sign").alias("hub_sign")), "hub")
    links = _confirm(near.mapInArrow(_hub_pairs(rate), "a binary, b binary"), docs, classes, threshold)
    roots = components(links)

    rooted = members.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    hub_roots = hubs.join(roots, hubs["hub"] == roots["node"], "left").select("band", "bucket", F.coalesce("root", "hub").alias("hub_root"))
    rooted = kept(rooted.join(hub_roots, ["band", "bucket"]).withColumn("stray", F.col("root") != F.col("hub_root")))
    members.unpersist()
    split = rooted.groupBy("band", "bucket").agg(F.sum(F.col("stray").cast("int")).alias("strays")).filter(F.col("strays") > 0)
    rooted = rooted.join(split, ["band", "bucket"])

    def block(rows: str) -> Column:
        return F.ceil(F.col(rows) / BLOCK).cast("int")

    own = F.abs(F.xxhash64("print"))
    left = rooted.filter("stray").withColumns({"side": F.lit(0), "x": (own % block("strays")).cast("int"), "y": F.explode(F.sequence(F.lit(0), block("n") - 1))})
    right = rooted.withColumns({"side": F.lit(1), "y": (own % block("n")).cast("int"), "x": F.explode(F.sequence(F.lit(0), block("strays") - 1))})
    sides = left.unionByName(right).select("band", "bucket", "x", "y", "side", "print", "root").join(signs, "print")
    key = ["band", "bucket", "x", "y"]
    open_rows = kept(sides.groupBy(*key).applyInArrow(
        _block_pairs(rate), "band int, bucket long, x int, y int, print binary, root binary, partners array<binary>"))
    open_rows = open_rows.join(_sets(open_rows, docs, classes), "print")
    more = kept(open_rows.groupBy(*key).applyInArrow(_block_links(*threshold), "a binary, b binary"))
    if not more.isEmpty():
        roots = components(links.union(more))

    labels = classes.select("print", "own").join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = labels.groupBy("root").agg(F.min("own").alias("least"))
    labels = labels.join(least, "root").select("print", "least")
    return sketched.select("doc_id", "digest", "n_shingles", "print").join(labels, "print", "left")


def cluster(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = placed_rows(docs, threshold)
    component = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


@query("op2_near_duplicates", SQL)
def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))
