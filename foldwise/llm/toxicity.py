"""Toxic passages by maximum-scoring segments.

1. Each labelled training text counts once, however often it is repeated. Over all of them the documents that hold a word, or a word
   beginning (``STEM`` bytes, so that inflected and compound forms count together), are counted per label. A score is the log-odds ratio
   between toxic and clean documents under a Dirichlet prior proportional to the pooled counts, ``PRIOR`` pseudo-documents per labelled one.
   An entry belongs to the lexicon if its log-odds stay above ``EFFECT`` on its side after ``Z`` standard errors are taken off: the bound
   asks for a size of effect, so more labels sharpen the lexicon and do not let in ever weaker entries. A word scores the higher of its two
   entries' signed log-odds, any other word ``DRIFT``.
2. Every whole text is scanned once: the disjoint maximal-scoring segments are found in linear time.
3. Segment scores become comparable across lengths by extreme-value (Karlin-Altschul) normalisation: lambda solves the
   moment equation of the scores of all words of the clean training texts, K is the likeliest for the maximal scores of clean texts
   the lexicon was not learnt from, and a segment of score S in n words has significance lambda * S - ln(K * n).
4. The best significance and the share of words in significant segments are mapped to a probability by a logistic
   curve. It is fitted crosswise: the training texts are dealt to two halves by their digest, and each half is scored by the lexicon of the other.

Defined results: null, empty or wordless texts have no segment and get the curve's value at zero; repeated rows each keep
their row; without labels of both kinds, or with too few for an entry to qualify in either half, the score is the smoothed share of toxic
labels; conflicting labels of an id or a text count as toxic; null ids match no label; an empty table gives no rows; only id and text of a document are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import kept, remainder, table
from foldwise.llm.registry import query

# Prior mass of each class for each labelled document; chosen by threefold cross-validation on training labels only.
PRIOR = 0.1
# Chosen by the crosswise recall on training labels, together.
Z = 2.0
EFFECT = 0.75
STEM = 5
DRIFT = -0.2
# Labels that go to every executor at most (some 60 bytes each); more are joined by shuffle.
BROADCAST_LABELS = 1_000_000
# Significance beyond this changes no decision; keeps the table of counts small.
CEILING = 60.0
_CELLS = ("clean0", "toxic0", "clean1", "toxic1")
_TO_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split() if text else []


def entries(words: set[bytes]) -> set[bytes]:
    """The words and the beginnings of the longer ones; the star keeps the two apart."""
    return words | {w[:STEM] + b"*" for w in words if len(w) > STEM}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # By 2 * half + label.
        held, seen = [Counter() for _ in range(4)], [0] * 4
        for text, label, half in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "half"))):
            held[2 * half + label].update(entries(set(tokens(text))))
            seen[2 * half + label] += 1
        names = list(held[0] | held[1] | held[2] | held[3])
        # The empty word carries the numbers of documents.
        yield pa.RecordBatch.from_arrays([pa.array(names + [b""], pa.binary()), *[pa.array([h[w] for w in names] + [n], pa.int64()) for h, n in zip(held, seen)]],
                                         names=["word", *_CELLS])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the documents that ``labels`` (doc_id, label) names."""
    labels = labels.filter(F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    if labels.count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    return docs.join(labels, "doc_id")


def teaching(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label, half), every labelled text once under its smallest id; a digit of its digest deals it to a half."""
    mark = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    rows = labelled(docs.select("doc_id", mark.alias("mark")), labels).groupBy("mark").agg(F.min("doc_id").alias("_id"), F.max("label").cast("int").alias("label"))
    rows = kept(rows.select("_id", F.col("mark").alias("_mark"), "label", (F.crc32("mark") % 2).cast("int").alias("half")))
    if rows.count() <= BROADCAST_LABELS:
        rows = F.broadcast(rows)
    # Repeated rows of the smallest id are the same text; they teach as often as they stand there.
    return docs.join(rows, (F.col("doc_id") == F.col("_id")) & (mark == F.col("_mark"))).select("doc_id", "text", "label", "half")


def value_of(word: bytes, lexicon: dict[bytes, float]) -> float:
    """The higher of a word's entries (the word, its beginning); ``DRIFT`` without any."""
    own, stem = lexicon.get(word), lexicon.get(word[:STEM] + b"*")
    if own is None or stem is None:
        return DRIFT if own is stem else stem if own is None else own
    return max(own, stem)


def _strongest(text: str | None, lexicon: dict[bytes, float]) -> tuple[int, list[tuple[float, int, int]]]:
    """The number of words of a text and its maximal-scoring segments."""
    found = tokens(text)
    value = {w: value_of(w, lexicon) for w in set(found)}
    places = [i for i, w in enumerate(found) if value[w] != DRIFT]
    return len(found), segments(places, [value[found[i]] for i in places])


_VALUES = "model int, best boolean, value double, n long, words long"


def _values(models: list[dict]):
    """Word scores of clean texts under the lexicon of all (2) and of their own half, and their best segments under that of the other half."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, words = Counter(), Counter()
            for text, half in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist()):
                for word, n in Counter(tokens(text)).items():
                    for m in (half, 2):
                        total[m, False, value_of(word, models[m]["lexicon"])] += n
                n, found = _strongest(text, models[1 - half]["lexicon"])
                key = (1 - half, True, round(max((x[0] for x in found), default=0.0), 1))
                total[key] += 1
                words[key] += n
            columns = [*zip(*total)] if total else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.float64()),
                                              pa.array(list(total.values()), pa.int64()), pa.array([words[k] for k in total], pa.int64())],
                                             names=["model", "best", "value", "n", "words"])
    return count


def _lexicon(counts: DataFrame, clean: Column, toxic: Column, n0: int, n1: int) -> dict[bytes, float]:
    if not n0 or not n1:
        return {}
    mass = PRIOR * (n0 + n1)
    alpha = PRIOR * (clean + toxic)
    one, zero = toxic + alpha, clean + alpha
    delta = F.log(one / (n1 + mass - one)) - F.log(zero / (n0 + mass - zero))
    known = (F.length("word") > 1) & (one > 0) & (zero > 0) & (one < n1 + mass) & (zero < n0 + mass)
    rows = counts.filter(known).select("word", delta.alias("score"), F.sqrt(1 / one + 1 / zero).alias("error"))
    # An entry of a few documents does not qualify, so the lexicon is far smaller than the vocabulary.
    return {bytes(r["word"]): r["score"] for r in rows.filter(F.abs("score") - Z * F.col("error") > EFFECT).collect()}


def _rate(lexicon: dict[bytes, float], found: dict[float, int]) -> float:
    """Lambda: the positive root of sum(share * exp(lambda * score)) = 1."""
    # Half a word for every entry, so that those the clean texts lack count too.
    weight = Counter({v: 0.5 * n for v, n in Counter(lexicon.values()).items()})
    for value, n in found.items():
        weight[value] += n
    scores, share = np.array(list(weight)), np.array(list(weight.values()), float)
    share /= share.sum()
    low, high = 1e-6, 1.0
    while (share * np.exp(np.minimum(high * scores, 700))).sum() < 1 and high < 1e3:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (share * np.exp(np.minimum(middle * scores, 700))).sum() < 1 else (low, middle)
    return low


def fit_k(cells: list[tuple[float, float, int, int]]) -> float:
    """K from cells (lambda * maximal score, the least such score above 0, texts, their words).

    P(maximum < S) = exp(-K n exp(-lambda S)); texts without a segment are known only to lie below the least score. The likeliest K
    is the number of texts with one over the sum of n exp(-lambda S); half a text more keeps it above 0.
    """
    above = sum(n for s, _, n, _ in cells if s > 0)
    mass = sum(words * math.exp(-max(s, least)) for s, least, _, words in cells)
    return (above + 0.5) / (mass + 0.5)


def learn(train: DataFrame) -> dict:
    """The lexicon, lambda, K and the numbers of documents from (text, label, half); under ``halves`` the same learnt from each half alone."""
    counts = kept(train.select("text", "label", "half").mapInArrow(_count, "word binary, " + ", ".join(f"{c} long" for c in _CELLS))
                  .groupBy("word").agg(*[F.sum(c).alias(c) for c in _CELLS]))
    seen = counts.filter(F.length("word") == 0).first() or dict.fromkeys(_CELLS, 0)
    models = []
    for halves in ((0,), (1,), (0, 1)):
        clean, toxic = ([f"{kind}{h}" for h in halves] for kind in ("clean", "toxic"))
        n0, n1 = (sum(seen[c] for c in names) for names in (clean, toxic))
        models.append({"lexicon": _lexicon(counts, sum(map(F.col, clean)), sum(map(F.col, toxic)), n0, n1), "lambda": 1.0, "k": 1.0, "clean": n0, "toxic": n1})
    if models[2]["lexicon"]:
        found = train.filter(F.col("label") == 0).select("text", "half").mapInArrow(_values(models), _VALUES)
        rows = found.groupBy("model", "best", "value").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()
        for m, model in enumerate(models):
            if model["lexicon"]:
                model["lambda"] = _rate(model["lexicon"], {r["value"]: r["n"] for r in rows if r["model"] == m and not r["best"]})
        least = [min((v for v in m["lexicon"].values() if v > 0), default=1.0) for m in models]
        k = fit_k([(models[r["model"]]["lambda"] * r["value"], models[r["model"]]["lambda"] * least[r["model"]], r["n"], r["words"])
                   for r in rows if r["best"] and models[r["model"]]["lexicon"]])
        for model in models:
            model["k"] = k
    return models[2] | {"halves": models[:2]}


def segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, stop) of a sequence that scores ``drift`` except at ``places``.

    Only positive scores are candidates. Candidates are kept with the running total before and after them; a new one swallows those on its left whose start lies
    lower while their end lies no higher. Each is pushed and removed once.
    """
    stack: list[list] = []  # [total before, total after, start, stop, index of the last candidate with a lower start, or -1]
    total, last = 0.0, -1
    for place, score in zip(places, scores):
        total += drift * (place - last - 1)
        if score <= 0:
            total, last = total + score, place
            continue
        new = [total, total + score, place, place + 1, -1]
        total, last = total + score, place
        at = len(stack) - 1
        while True:
            while at >= 0 and stack[at][0] >= new[0]:
                at = stack[at][4]
            if at < 0 or stack[at][1] >= new[1]:
                break
            new[0], new[2] = stack[at][0], stack[at][2]
            del stack[at:]
            at = len(stack) - 1
        new[4] = at
        stack.append(new)
    return [(s[1] - s[0], s[2], s[3]) for s in stack]


def measure(text: str | None, model: dict) -> tuple[float, float, list[tuple[float, int, int]]]:
    """The best significance of a text, the share of its words in significant segments, and these segments."""
    n, found = _strongest(text, model["lexicon"])
    offset = math.log(max(model["k"] * n, 1.0))
    strong = [(model["lambda"] * s - offset, a, b) for s, a, b in found]
    strong = [x for x in strong if x[0] > 0]
    return min(CEILING, max((x[0] for x in strong), default=0.0)), sum(b - a for _, a, b in strong) / max(1, n), strong


def _scan(model: dict):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("significance", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(text, model) for text in batch.column("text").to_pylist()]
            passages = [[{"start": a, "stop": b, "significance": s} for s, a, b in strong] for _, _, strong in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64()),
                 pa.array(passages, kind)], names=["doc_id", "digest", "best", "share", "passages"])
    return scan


def _crosswise(halves: list[dict]):
    """Counted cells of training texts, each measured by the lexicon of the other half; where that is empty a text tells nothing."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = Counter()
            for text, label, half in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "half"))):
                if halves[1 - half]["lexicon"]:
                    best, share, _ = measure(text, halves[1 - half])
                    cells[round(best, 1), round(share, 2), label] += 1
            columns = [*zip(*cells)] if cells else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.int32()),
                                              pa.array(list(cells.values()), pa.int64())], names=["best", "share", "label", "n"])
    return count


def scan(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, digest, best significance, share of words in significant segments, passages in words); a missing digest stays null."""
    digest = F.col("digest") if "digest" in docs.columns else F.lit(None).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), "text").mapInArrow(
        _scan(model), "doc_id long, digest binary, best double, share double, passages array<struct<start:int,stop:int,significance:double>>")


def fit_curve(cells: list[tuple[float, float, int, int]], prior: tuple[float, float]) -> tuple[float, float, float]:
    """Logistic weights (constant, best, share) from counted cells (best, share, label, n), by damped Newton steps with a small ridge.

    More toxic words never lower the score: a feature whose weight falls below 0 leaves, and the others are fitted again.
    """
    weights = np.array([math.log((prior[1] + 0.5) / (prior[0] + 0.5)), 0.0, 0.0])
    if not cells or prior[0] == 0 or prior[1] == 0:
        return tuple(weights)
    x = np.array([(1.0, c[0] / 10, c[1]) for c in cells])
    y, n = np.array([c[2] for c in cells], float), np.array([c[3] for c in cells], float)
    live = np.array([True, True, True])
    while True:
        weights[1:] = 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            slope = x[:, live].T @ (n * (y - p)) - 0.05 * weights[live]
            bend = (x[:, live] * (n * p * (1 - p))[:, None]).T @ x[:, live] + 0.05 * np.eye(live.sum())
            step = np.linalg.solve(bend, slope)
            weights[live] += step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-9:
                break
        if (weights[1:] >= 0).all():
            return weights[0], weights[1] / 10, weights[2]
        live[1 + weights[1:].argmin()] = False


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, digest, score, best, share, passages) for every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, label).

    A column ``digest`` of the documents names their texts in the result.
    """
    docs = docs.select("doc_id", "text", *(["digest"] if "digest" in docs.columns else []))
    train = teaching(docs.select("doc_id", "text"), labels)
    model = learn(train)
    cells = train.select("text", "label", "half").mapInArrow(_crosswise(model["halves"]), "best double, share double, label int, n long")
    cells = [tuple(r) for r in cells.groupBy("best", "share", "label").agg(F.sum("n")).collect()]
    constant, a, b = fit_curve(cells, (model["clean"], model["toxic"]))
    return scan(docs, model).withColumn("score", 1 / (1 + F.exp(-(F.lit(float(constant)) + a * F.col("best") + b * F.col("share")))))


def toxic_labels(labels: DataFrame) -> DataFrame:
    """Labels to learn from: ids whose remainder is not 1."""
    return labels.filter(remainder("doc_id", 3) != 1).select("doc_id", F.col("toxic").alias("label"))


THRESHOLD = 0.7


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), toxic_labels(table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
