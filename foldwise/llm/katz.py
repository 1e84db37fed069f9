"""Language-model scores by Katz backoff.

Tokens are ASCII-lower-cased words and one end per text. The lowest order is add-one over the training vocabulary and one unknown
word. Above it the counts up to ``TURING`` are discounted by Good-Turing, and what a context saves goes to the words it was never
followed by, in the proportions of the next lower order: alpha = (1 - sum of the discounted shares) / (1 - sum of the lower order's
probabilities of the words seen), so every context sums to one exactly. A context in which nothing was discounted counts one token more.

Texts are cut into blocks of a few million tokens, written once. A block asks for the counts of its distinct n-grams: sorted 64-bit
hashes, packed per range of hash values, so that a frequent word or context costs a block one key and no range fills up. A range adds the
blocks' counts, keeps them as the model's rows and answers each block in the order it asked. The first training block that
asked for an n-gram adds it to its context's sums, which ranges of contexts add up and answer in the same way. With counts and sums at hand
a block evaluates its tokens recursively: a token not seen in the highest order takes the context's alpha and goes on to the next lower one.

A model is a set of tables in the shared folder, partitioned by kind: ``counts`` of every order and, per order from 2 up, ``contexts``.
Scoring other texts puts their questions to those stored rows.

Defined results: null or empty texts consist of the end alone; repeated rows each keep their row; an empty training set leaves add-one over the unknown
word; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import WordHashes, kept, mixed, remainder, table, words
from foldwise.llm.registry import query
from foldwise.session import checkpoint_dir

ORDER = 2
TURING = 5
# Characters of text in a block and tokens in a range of hashes; both bound the memory of a task and change no result.
BLOCK_CHARS = 8 << 20
RANGE_TOKENS = 4 << 20
# Tokens that no word can be: words hold no space.
END, START = b" ", b"  "
_STEP = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "block long, trains boolean, tokens long, ids array<long>, lengths binary, vocabulary binary, codes binary"
COUNTS = "kind string, k int, range long, block long, keys binary, n binary, own binary, distinct long, total long, numbers array<long>"
CONTEXTS = "kind string, range long, block long, keys binary, total binary, held binary, low binary, alpha binary"


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them, byte by byte, compressed."""
    values = values.astype(np.min_scalar_type(int(values.max(initial=0))))
    return zstandard.compress(values.dtype.char.encode() + values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    data = zstandard.decompress(data)
    kind = np.dtype(data[:1].decode())
    return np.frombuffer(data, np.uint8)[1:].reshape(kind.itemsize, -1).T.copy().view(kind).reshape(-1)


def packed_keys(keys: np.ndarray) -> bytes:
    """64-bit keys by their differences, which are short where keys ascend."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data).astype(np.uint64), dtype=np.uint64)


def packed_reals(values: np.ndarray) -> bytes:
    return packed(values.astype(np.float64).view(np.uint64))


def unpacked_reals(data: bytes) -> np.ndarray:
    return unpacked(data).astype(np.uint64).view(np.float64)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in ddl.split(", "))])


def _cuts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``BLOCK_CHARS`` together; a longer text is a run of its own."""
    start = held = 0
    for at, size in enumerate(sizes):
        if held and held + size > BLOCK_CHARS:
            yield start, at
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, number = WordHashes(), TaskContext.get().partitionId() << 32
    schema = _arrow(BLOCKS)
    for batch in batches:
        for trains in (True, False):
            part = batch.filter(pc.equal(batch.column("trains"), trains))
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            for lo, hi in _cuts([len(t or "") for t in texts]):
                split = [hashes.array([*words(t), END]) for t in texts[lo:hi]]
                values, codes, counts = np.unique(np.concatenate(split), return_inverse=True, return_counts=True)
                # Frequent words get small codes; words equally frequent ascend.
                order = np.lexsort((values, -counts))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                lengths = np.array([len(t) for t in split])
                yield _rows([(number, trains, len(codes), ids[lo:hi], packed(lengths), packed_keys(values[order]), packed(rank[codes]))], schema)
                number += 1


def encode(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs`` (doc_id, text, trains), written once, so that a block's number and content stay what they are."""
    return kept(docs.select("doc_id", "text", "trains").mapInArrow(_encode, BLOCKS))


class Block:
    """The tokens of a block and, per order, its distinct n-grams and contexts; the same on every call."""

    def __init__(self, row: dict, order: int):
        self.row, self.order = row, order
        self.lengths = unpacked(row["lengths"]).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        tokens = unpacked_keys(row["vocabulary"])[unpacked(row["codes"])]
        place = (np.arange(len(tokens)) - np.repeat(self.starts, self.lengths)).astype(np.int32)
        start = np.uint64(WordHashes()[START])
        self.keys, self.inverse, self.counts = [None], [None], [None]
        self.context, self.context_at = [None, None], [None, None]
        self.first = [None]
        history = np.zeros(len(tokens), np.uint64)
        for k in range(1, order + 1):
            if k > 1:
                # The (k-1)-th word back joins the context; before the text there is padding.
                back = np.full(len(tokens), start)
                back[k - 1 :] = tokens[: max(0, len(tokens) - k + 1)]
                back[place < k - 1] = start
                history = mixed(history * _STEP + back)
                del back
            grams = tokens if k == 1 else mixed(history * _STEP + tokens)
            keys, first, inverse, counts = np.unique(grams, return_index=True, return_inverse=True, return_counts=True)
            self.keys.append(keys)
            self.first.append(first.astype(np.int32))
            self.inverse.append(inverse.astype(np.int32))
            self.counts.append(counts.astype(np.int32))
            if k > 1:
                # Contexts belong to distinct n-grams: context_at leads from an n-gram to its context.
                found, at = np.unique(history[first], return_inverse=True)
                self.context.append(found)
                self.context_at.append(at.astype(np.int32))

    def below(self, k: int, values: np.ndarray) -> np.ndarray:
        """Values of the next lower order's n-grams, for each n-gram of order ``k``."""
        return values[self.inverse[k - 1][self.first[k]]]


def _ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of ascending keys by their leading bits."""
    tops = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(tops, prepend=-1)) if len(tops) else []
    for lo, hi in zip(edges, [*edges[1:], len(keys)]):
        yield int(tops[lo]), int(lo), int(hi)


def _each(batches: Iterator[pa.RecordBatch], work: Callable[[dict], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``work`` on one block after the other; nothing of a block stays while the next is read."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield from work(batch.slice(at, 1).to_pylist()[0])


def _ask(order: int, bits: int):
    schema = _arrow(COUNTS)

    def ask(row: dict) -> Iterator[pa.RecordBatch]:
        block = Block(row, order)
        for k in range(1, order + 1):
            counts = block.counts[k] if row["trains"] else np.zeros(len(block.keys[k]), np.int64)
            yield _rows([("asked", k, r, row["block"], packed_keys(block.keys[k][lo:hi]), packed(counts[lo:hi]), None, None, None, None)
                         for r, lo, hi in _ranges(block.keys[k], bits)], schema)
    return lambda batches: _each(batches, ask)


def _together(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each key of each part is among them, and where parts end."""
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    return keys, at, np.cumsum([len(p) for p in parts])


def _count(rows: pa.Table) -> pa.Table:
    rows = sorted(rows.to_pylist(), key=lambda r: (r["block"] is not None, r["block"] or 0))
    asked = [unpacked_keys(r["keys"]) for r in rows]
    given = np.concatenate([unpacked(r["n"]).astype(np.int64) for r in rows])
    keys, at, ends = _together(asked)
    n = np.bincount(at, given, len(keys)).astype(np.int64)
    # The first row that counts a key owns it.
    counting = np.flatnonzero(given)
    own = np.zeros(len(at), np.uint8)
    own[counting[np.unique(at[counting], return_index=True)[1]]] = 1
    seen = n > 0
    low = np.bincount(n[seen & (n <= TURING + 1)], minlength=TURING + 2)[1:]
    k, r = rows[0]["k"], rows[0]["range"]
    out = [("model", k, r, None, packed_keys(keys[seen]), packed(n[seen]), None, int(seen.sum()), int(n.sum()), low.tolist())]
    for row, lo, hi in zip(rows, [0, *ends[:-1]], ends):
        if row["block"] is not None:
            out.append(("answer", k, r, row["block"], None, packed(n[at[lo:hi]]), packed(own[lo:hi]), None, None, None))
    return pa.Table.from_batches([_rows(out, _arrow(COUNTS))])


def _add(rows: pa.Table) -> pa.Table:
    """Sums of contexts from blocks or from a stored model, answered to the blocks that named them."""
    rows = sorted(rows.to_pylist(), key=lambda r: (r["block"] is not None, r["block"] or 0))
    keys, at, ends = _together([unpacked_keys(r["keys"]) for r in rows])
    total, held, low = (np.bincount(at, np.concatenate([unpacked_reals(r[c]) for r in rows]), len(keys)) for c in ("total", "held", "low"))
    seen, r = total > 0, rows[0]["range"]
    full = np.where(held < total, total, total + 1)
    alpha = np.divide(1 - held / full, 1 - low, out=np.ones(len(total)), where=seen)
    full = np.where(seen, full, 0).astype(np.int64)
    out = [("model", r, None, packed_keys(keys[seen]), *[packed_reals(x[seen]) for x in (total, held, low)], None)]
    for row, lo, hi in zip(rows, [0, *ends[:-1]], ends):
        if row["block"] is not None:
            # A block needs what follows from the sums, not the sums.
            out.append(("answer", r, row["block"], None, packed(full[at[lo:hi]]), None, None, packed_reals(alpha[at[lo:hi]])))
    return pa.Table.from_batches([_rows(out, _arrow(CONTEXTS))])


@dataclass(frozen=True)
class Model:
    """Where the tables are and the numbers that belong to them."""

    path: str
    order: int
    bits: int
    tokens: int
    vocabulary: int
    shares: dict[int, list[float]]

    def counts(self, spark: SparkSession) -> DataFrame:
        return _stored(spark, f"{self.path}/counts", COUNTS, "model")

    def contexts(self, spark: SparkSession, k: int) -> DataFrame:
        return _stored(spark, f"{self.path}/contexts{k}", CONTEXTS, "model")


def discounts(numbers: dict[int, int]) -> list[float]:
    """Good-Turing factors for counts 1 to TURING from the numbers of n-grams by count; 1 where the data give none between 0 and 1."""
    out = []
    common = (TURING + 1) * numbers.get(TURING + 1, 0) / max(1, numbers.get(1, 0))
    for r in range(1, TURING + 1):
        star = (r + 1) * numbers.get(r + 1, 0) / (r * max(1, numbers.get(r, 0)))
        d = (star - common) / (1 - common) if common < 1 else 1.0
        out.append(d if 0 < d <= 1 else 1.0)
    return out


def _stored(spark: SparkSession, path: str, schema: str, kind: str) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]
    return spark.read.schema(schema).parquet(path).filter(F.col("kind") == kind).select(*names)


class Evaluated:
    """A block with the answers to its questions."""

    def __init__(self, block: Block, model: Model):
        self.block, self.model = block, model
        answers = sorted(block.row["answers"] or [], key=lambda a: (a["k"], a["range"]))
        self.n, self.own = [None], [None]
        for k in range(1, block.order + 1):
            mine = [a for a in answers if a["k"] == k]
            self.n.append(np.concatenate([unpacked(a["n"]).astype(np.int64) for a in mine]))
            self.own.append(np.concatenate([unpacked(a["own"]) for a in mine]).astype(bool))

    def held(self, k: int) -> np.ndarray:
        """Discounted counts of the n-grams of order ``k``."""
        share = np.array([1.0, *self.model.shares[k], 1.0])
        return self.n[k] * share[np.minimum(self.n[k], TURING + 1)]

    def ones(self) -> np.ndarray:
        return (self.n[1] + 1) / (self.model.tokens + self.model.vocabulary + 1)

    def context(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Total and alpha of the context of each n-gram of order ``k``; contexts never seen have total 0 and alpha 1."""
        answers = sorted(self.block.row[f"contexts{k}"] or [], key=lambda a: a["range"])
        total = np.concatenate([unpacked(a["total"]).astype(np.float64) for a in answers])
        alpha = np.concatenate([unpacked_reals(a["alpha"]) for a in answers])
        at = self.block.context_at[k]
        return total[at], alpha[at]

    def seen(self, k: int) -> np.ndarray:
        """Probabilities of the n-grams of order ``k`` that were seen in training; for the others no value of meaning."""
        return self.ones() if k == 1 else self.held(k) / np.maximum(self.context(k)[0], 1.0)

    def log_p(self) -> np.ndarray:
        """log10 probability of each n-gram of the highest order."""
        p = np.log10(self.ones())
        for k in range(2, self.block.order + 1):
            _, alpha = self.context(k)
            backed = self.block.below(k, p) + np.log10(alpha)
            known = self.n[k] > 0
            p = np.where(known, np.log10(np.where(known, self.seen(k), 1.0)), backed)
        return p


def _sum(model: Model, k: int):
    schema = _arrow(CONTEXTS)

    def sums(row: dict) -> Iterator[pa.RecordBatch]:
        block = Block(row, model.order)
        x = Evaluated(block, model)
        mine = x.own[k] & row["trains"]
        at, many = block.context_at[k], len(block.context[k])
        low = block.below(k, x.seen(k - 1))
        found = [np.bincount(at, np.where(mine, v, 0.0), many) for v in (x.n[k], x.held(k), low)]
        yield _rows([("asked", r, row["block"], packed_keys(block.context[k][lo:hi]), *[packed_reals(v[lo:hi]) for v in found], None)
                     for r, lo, hi in _ranges(block.context[k], model.bits)], schema)
    return lambda batches: _each(batches, sums)


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(model: Model):
    schema = _arrow(SCORES)

    def scores(row: dict) -> Iterator[pa.RecordBatch]:
        block = Block(row, model.order)
        x = Evaluated(block, model)
        one, top = block.inverse[1], block.inverse[model.order]
        per_gram = [((x.n[1] > 0).astype(np.int64), one), (np.log10(x.ones()), one), (x.log_p(), top)]
        known, base, score = (np.add.reduceat(v[at], block.starts) for v, at in per_gram)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([row["ids"], block.lengths, known, base, score], schema.types)], schema=schema)
    return lambda batches: _each(batches, scores)


def _answered(blocks: DataFrame, answers: DataFrame, name: str, fields: list[str]) -> DataFrame:
    lists = answers.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias(name))
    return blocks.join(lists, "block")


def _written(df: DataFrame, path: str) -> None:
    df.write.partitionBy("kind").mode("overwrite").parquet(path)


def evaluate(blocks: DataFrame, order: int, model: Model | None = None, path: str | None = None) -> tuple[Model, DataFrame]:
    """The model, learnt from the training blocks if none is given, and the blocks with all answers that scoring needs."""
    spark = blocks.sparkSession
    path = path or f"{checkpoint_dir(spark)}/katz-{uuid.uuid4().hex}"
    if model is None:
        size = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        bits = max(4, math.ceil(math.log2(max(1, size / RANGE_TOKENS))))
    else:
        bits = model.bits
    asked = blocks.mapInArrow(_ask(order, bits), COUNTS)
    if model is not None:
        asked = asked.unionByName(model.counts(spark))
    _written(asked.groupBy("k", "range").applyInArrow(_count, COUNTS), f"{path}/counts")
    stored = model
    if model is None:
        found = _stored(spark, f"{path}/counts", COUNTS, "model")
        sums = [F.sum(F.col("numbers")[i]).alias(f"n{i + 1}") for i in range(TURING + 1)]
        by_order = {r["k"]: r.asDict() for r in found.groupBy("k").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct"), *sums).collect()}
        shares = {k: discounts({i: by_order.get(k, {}).get(f"n{i}") or 0 for i in range(1, TURING + 2)}) for k in range(2, order + 1)}
        ones = by_order.get(1, {"total": 0, "distinct": 0})
        model = Model(path, order, bits, ones["total"], ones["distinct"], shares)
    full = _answered(blocks, _stored(spark, f"{path}/counts", COUNTS, "answer"), "answers", ["k", "range", "n", "own"])
    for k in range(2, order + 1):
        rows = full.mapInArrow(_sum(model, k), CONTEXTS)
        if stored is not None:
            # Questions bring no sums of their own, the stored rows bring them all.
            rows = rows.unionByName(stored.contexts(spark, k))
        _written(rows.groupBy("range").applyInArrow(_add, CONTEXTS), f"{path}/contexts{k}")
        full = _answered(full, _stored(spark, f"{path}/contexts{k}", CONTEXTS, "answer"), f"contexts{k}", ["range", "total", "alpha"])
    return model, full


def train(docs: DataFrame, order: int = ORDER, path: str | None = None) -> Model:
    """A model of all whole texts of ``docs`` (text)."""
    blocks = encode(docs.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("trains")))
    return evaluate(blocks, order, path=path)[0]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score), one row per row of ``docs`` (doc_id, text)."""
    blocks = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("trains")))
    return evaluate(blocks, model.order, model)[1].mapInArrow(_score(model), SCORES)


def train_and_score(docs: DataFrame, order: int = ORDER) -> tuple[Model, DataFrame]:
    """As ``train`` on the rows with ``trains`` and ``score`` on all rows of ``docs`` (doc_id, text, trains), with each question asked once."""
    model, full = evaluate(encode(docs), order)
    return model, full.mapInArrow(_score(model), SCORES)


@query("op4_katz_scores")
def op4_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, scored = train_and_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder("doc_id", 7) != 2).alias("trains")))
    return scored.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known",
                         F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
