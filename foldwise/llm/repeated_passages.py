"""Passages repeated across documents by a sparse suffix array.

1. A suffix is retained where its first ``GRAM`` words are the minimiser of some window of ``LENGTH`` words. Content alone selects
   it, so every passage of ``LENGTH`` words holds a retained suffix, the same one wherever the passage occurs.
   Equal texts fall together first; their whole text is a repeated passage.
2. Suffixes whose first words occur once cannot match and go. The others carry ``LENGTH`` words to the right and to the left.
3. They are range-sorted by what follows, so that the longest common continuations are neighbours, and each is compared with the
   nearest suffix of another text on either side and extended left and right; then once more sorted by what precedes. A match of
   ``LENGTH`` words or more is a passage; overlapping ones are merged. Ranges are balanced, since text and place end the sort key; a task
   reads its range batch by batch. The rows at the borders of ranges are compared in one more step (two a range and direction).

The two orders find for each suffix the longest continuation on either side. A passage cut by edits on both sides of every suffix
it holds can lie behind neighbours that share one side only; the tests measure recall against brute force.

Defined results: words are ASCII-lower-cased runs between the six ASCII spaces; null or short texts have no passage; repeated rows are
copies of one text; repeats within one text alone do not count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import WordHashes, gram_hashes, kept, released, signed, table, words
from foldwise.llm.registry import query

LENGTH = 50
GRAM = 8


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest gram (the last of equals) of every run of ``window`` grams, each once."""
    if len(grams) < window:
        return np.empty(0, np.int64)
    # The smallest of a run is the smaller of two overlapping doubled-up runs.
    order = np.arange(len(grams))
    size = 1
    while size * 2 <= window:
        a, b = order[: len(order) - size], order[size:]
        order = np.where(grams[b] <= grams[a], b, a)
        size *= 2
    if size < window:
        a, b = order[: len(grams) - window + 1], order[window - size : len(grams) - size + 1]
        order = np.where(grams[b] <= grams[a], b, a)
    return np.unique(order)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        prints, sizes, chosen = [], [], []
        for text in batch.column("text").to_pylist():
            h = hashes.array(words(text))
            grams = gram_hashes(h, GRAM)
            prints.append(xxhash.xxh128_digest(h.tobytes()) if len(h) >= LENGTH else None)
            sizes.append(len(h))
            chosen.append(np.unique(signed(grams[minimisers(grams, LENGTH - GRAM + 1)])).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(chosen, pa.list_(pa.int64()))],
                                         names=["doc_id", "n_words", "print", "grams"])
    hashes.clear()
    released()


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Retained suffixes with their context, 32 bits a word, nearest word first; a word beyond the text differs from every other."""
    hashes = WordHashes()
    for batch in batches:
        for p, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("print", "text", "grams"))):
            h = hashes.array(words(text))
            if xxhash.xxh128_digest(h.tobytes()) != p:
                continue
            grams = gram_hashes(h, GRAM)
            places = minimisers(grams, LENGTH - GRAM + 1)
            places = places[np.isin(signed(grams[places]), np.array(wanted, np.int64))]
            for at in range(0, len(places), 2000):
                some = places[at : at + 2000]
                short = np.concatenate([np.full(LENGTH, 0, np.uint32), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1), np.full(LENGTH, 0, np.uint32)])
                after = short[some[:, None] + LENGTH + np.arange(LENGTH)]
                before = short[some[:, None] + LENGTH - 1 - np.arange(LENGTH)]
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(grams[some])), pa.array([x.tobytes() for x in after], pa.binary()), pa.array([x.tobytes() for x in before], pa.binary()),
                     pa.array([p] * n, pa.binary()), pa.array(some, pa.int64())], names=["gram", "after", "before", "print", "place"])
    hashes.clear()
    released()


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Leading words that rows of x and y share; zero stands for the end of a text and matches nothing."""
    differ = (x != y) | (x == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])


_SUFFIX = "gram long, after binary, before binary, print binary, place long"
_SPAN = "print binary, start long, stop long, partner binary"
_FOUND = f"{_SPAN}, border struct<range:int,side:int,gram:bigint,after:binary,before:binary,print:binary,place:bigint>"
_BORDER = pa.struct([("range", pa.int32()), ("side", pa.int32()), ("gram", pa.int64()), ("after", pa.binary()), ("before", pa.binary()), ("print", pa.binary()), ("place", pa.int64())])
# Suffixes of a range on average; a row takes some 470 bytes.
RANGE_ROWS = 50_000


def _spans(rows: pa.Table, old: int = 0, lead: int = 0) -> pa.Table:
    """Matches of each suffix with the nearest ones of other texts before and after it in sorted rows, each once.

    The first ``old`` rows come from the batch before and have met what lies before them, the first ``lead`` of these also what lies after.
    """
    n = rows.num_rows
    gram = rows.column("gram").to_numpy()
    prints = np.array(rows.column("print").to_pylist(), object)
    place = rows.column("place").to_numpy()
    after, before = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint32).reshape(n, LENGTH) for c in ("after", "before"))
    index = np.arange(n)
    change = np.ones(n, bool)
    change[1:] = prints[1:] != prints[:-1]
    first = np.maximum.accumulate(np.where(change, index, 0))
    last = np.minimum.accumulate(np.where(np.append(change[1:], True), index, n)[::-1])[::-1]
    out = []
    for other, start in ((first - 1, old), (last + 1, lead)):
        i = index[(other >= 0) & (other < n) & (index >= start)]
        j = other[i]
        i, j = i[gram[i] == gram[j]], j[gram[i] == gram[j]]
        right, left = _common(after[i], after[j]), _common(before[i], before[j])
        good = right + left >= LENGTH
        i, j, right, left = i[good], j[good], right[good], left[good]
        out.append((prints[i], place[i] - left, place[i] + right, prints[j]))
        # The neighbour sees this match too; it need not be its own nearest.
        out.append((prints[j], place[j] - left, place[j] + right, prints[i]))
    p, a, b, q = (np.concatenate(x) for x in zip(*out))
    found = pa.table({"print": pa.array(list(p), pa.binary()), "start": pa.array(a.astype(np.int64)), "stop": pa.array(b.astype(np.int64)), "partner": pa.array(list(q), pa.binary())})
    return found.group_by(found.column_names).aggregate([])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = [b for b in batches if b.num_rows]
    if batches:
        yield from _spans(pa.Table.from_batches(batches)).to_batches()


def _carried(rows: pa.Table) -> tuple[pa.Table, int]:
    """The rows that later ones may still meet, the last run of one text and gram, and before them the row in front of it; how many rows that is, one or none."""
    gram, prints = rows.column("gram").to_numpy(), rows.column("print").to_pylist()
    start = rows.num_rows - 1
    while start > 0 and prints[start - 1] == prints[-1] and gram[start - 1] == gram[-1]:
        start -= 1
    lead = min(start, 1)
    # Taken, not sliced: a slice would hold the whole batch.
    return rows.take(pa.array(range(start - lead, rows.num_rows))), lead


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches inside a sorted range, batch by batch, and its rows at either end: the first and the last one, and the next ones of another text."""
    ends: dict[int, pa.Table] = {}
    first = second = other = None
    carried, lead, seen = None, 0, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        new = pa.Table.from_batches([batch])
        prints = new.column("print").to_pylist()
        if first is None:
            first = prints[0]
            ends[0] = new.take(pa.array([0]))
        if second is None:
            second = next((seen + i for i, p in enumerate(prints) if p != first), None)
            if second is not None:
                ends[second] = new.take(pa.array([second - seen]))
        # The last row so far of another text than the last one lies in this batch, or it is one of the last two kept.
        at = next((i for i in range(len(prints) - 1, -1, -1) if prints[i] != prints[-1]), None)
        if at is not None:
            other = seen + at, new.take(pa.array([at]))
        elif seen and last[1].column("print")[0].as_py() != prints[-1]:
            other = last
        last = seen + len(prints) - 1, new.take(pa.array([len(prints) - 1]))
        seen += len(prints)
        rows = new if carried is None else pa.concat_tables([carried, new])
        found = _spans(rows, 0 if carried is None else carried.num_rows, lead)
        for part in found.select(["print", "start", "stop", "partner"]).combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([*part.columns, pa.nulls(part.num_rows, _BORDER)], names=[*part.schema.names, "border"])
        carried, lead = _carried(rows)
    if seen:
        ends |= dict([last] if other is None else [other, last])
        some = pa.concat_tables([ends[i] for i in sorted(ends)]).combine_chunks()
        n = some.num_rows
        parts = {"range": pa.array([TaskContext.get().partitionId()] * n, pa.int32()), "side": pa.array(range(n), pa.int32())}
        for c in _BORDER.names[2:]:
            parts[c] = some.column(c).combine_chunks()
        border = pa.StructArray.from_arrays([parts[c] for c in _BORDER.names], fields=list(_BORDER))
        nothing = [pa.nulls(n, t) for t in (pa.binary(), pa.int64(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*nothing, border], names=["print", "start", "stop", "partner", "border"])
    released()


def _matches(suffixes: DataFrame, context: str, ranges: int) -> DataFrame:
    """Spans found by sorting on one side's context. Matches and borders come from one sort, since another one would draw other borders."""
    order = ["gram", context, "print", "place"]
    # A given number of ranges stays as it is; else ranges of many equal passages, small as they are when compressed, would be put together.
    found = kept(suffixes.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(_ranged, _FOUND))
    borders = found.filter(F.col("border").isNotNull()).select("border.*")
    meeting = borders.coalesce(1).sortWithinPartitions("range", "side").select(*[c.split()[0] for c in _SUFFIX.split(", ")])
    return found.filter(F.col("border").isNull()).drop("border").union(meeting.mapInArrow(_neighbours, _SPAN))


def _merged(spans: Column) -> Column:
    """Sorted spans with overlapping ones joined and their partners pooled."""
    kind = "array<struct<start:bigint,stop:bigint,partners:array<bigint>>>"

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.array(s["partner"]).alias("partners")))
        joined = F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"),
                                  F.array_union(last["partners"], F.array(s["partner"])).alias("partners")))
        meets = (F.size(acc) > 0) & (s["start"] <= last["stop"])
        return F.when(meets, F.concat(F.slice(acc, 1, F.size(acc) - 1), joined)).otherwise(F.concat(acc, one)).cast(kind)

    return F.aggregate(spans, F.array().cast(kind), add)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, stop, n_words, partners), one row per repeated passage of a document, in words; partners are
    the smallest ids of the other texts it was matched with (for a copied text: the smallest other id with that text)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sampled = kept(docs.mapInArrow(_sample, "doc_id long, n_words long, print binary, grams array<long>").filter(F.col("print").isNotNull()))
    classes = kept(sampled.groupBy("print").agg(
        F.min("doc_id").alias("id"), F.max("doc_id").alias("other"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("grams").alias("grams")))
    exploded = classes.select("print", F.explode("grams").alias("gram"))
    shared = exploded.groupBy("gram").count().filter(F.col("count") > 1)
    wanted = exploded.join(shared, "gram", "left_semi").groupBy("print").agg(F.collect_list("gram").alias("grams"))
    wanted = classes.select("print", F.col("id").alias("_id")).join(wanted, "print")
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("print", "text", "grams")
    suffixes = kept(texts.mapInArrow(_suffixes, _SUFFIX))
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-suffixes.count() // RANGE_ROWS))
    found = _matches(suffixes, "after", ranges).union(_matches(suffixes, "before", ranges)).distinct()
    named = found.join(classes.select(F.col("print").alias("partner"), F.col("id").alias("partner_id")), "partner")
    own = named.groupBy("print").agg(F.sort_array(F.collect_set(F.struct("start", "stop", F.col("partner_id").alias("partner")))).alias("spans"))
    own = own.select("print", F.explode(_merged(F.col("spans"))).alias("p")).select("print", "p.*")
    copied = F.col("copies") > 1
    single = classes.filter(~copied).select("print", "id").join(own, "print").select(F.col("id").alias("doc_id"), "start", "stop", "partners")
    whole = sampled.select("doc_id", "print").join(classes.filter(copied).select("print", "id", "other", "n_words"), "print").select(
        "doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop"),
        F.array(F.when(F.col("doc_id") == F.col("id"), F.col("other")).otherwise(F.col("id"))).alias("partners"))
    every = single.unionByName(whole)
    return every.select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), F.sort_array("partners").alias("partners"))


@query("op10_repeated_passages")
def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
