"""Phrase collocations by Toivonen's mining: a sample proposes, full passes count exactly.

A sample of the rows names the words and shorter phrases that are frequent there at a lowered threshold. A full pass then counts, in
every occurrence, each phrase whose parts (first and last words but one) were named: these are the proposed phrases and their negative
border. A counted phrase that is frequent in all texts without having been named is a border failure; it is named now, and a further pass counts
exactly what that adds. The passes end when a full pass leaves no failure, after at most as many passes as a phrase may have words. A part of
a frequent phrase is at least as frequent, hence named, hence all its extensions counted: none is missed.

These passes add up 48-bit fingerprints, which is lean; two phrases of one fingerprint only make a count too high. A last pass
counts every phrase whose fingerprint reached the threshold again, under its own text, and only those counts are used: they are exact.

Named and frequent phrases are bits of two-bit Bloom tables of at most ``MOST_BITS`` bits, the only thing broadcast; a falsely set bit lets a phrase be
counted that need not be, never the reverse. Tasks count ``CHUNK`` bytes of text at a time, so a word or phrase of a third of all texts leaves
a chunk as one row.

Defined results: null texts have no words, a null language is ``und`` and one with any real ``und``; a language without candidates
gives no rows; ties end with the phrase in byte order; repeated rows count as often as they occur; an empty table gives no rows; other
columns are ignored. Counts must stay below 10^15, for which the products fit decimals of 38 digits. Phrases have eight words at most.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm.common import kept, mixed, released, table
from foldwise.llm.registry import query

# The alphabet that is lower-cased, and what ends a piece (each becomes a token of its own, a full stop).
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz.........")
LEAST, LONGEST, COVER, TOP = 10, 3, (50, 100), 2000
SHARE, EASE = 0.25, 0.8
# Bytes of text counted at a time, and hashed at a time.
CHUNK, SLICE = 6_000_000, 1 << 20
# Characters of text to a range of fingerprints.
RANGE_CHARS = 8_000_000
MOST_BITS = 1 << 27
SEGMENT_BITS = 1 << 19
STEP = 200_000
COUNTS = "lang string, size int, phrase string, n long"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BREAK = re.compile(rb"[ \t.]")


def _lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER)


def _tokens(lowered: bytes) -> list[bytes]:
    """Words, with a full stop wherever a piece ends."""
    return lowered.replace(b".", b" . ").split()


class Named:
    """A bit table of fingerprints."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        """Two bits per fingerprint; ``bits`` is a power of two."""
        mask, spread = np.uint64(bits - 1), mixed(keys * _MULTIPLIER)
        return np.stack([spread & mask, (spread >> np.uint64(32)) & mask]).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys, len(self.table) * 8)
        return ((self.table[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)

    def held(self, keys: np.ndarray, where: np.ndarray) -> np.ndarray:
        """``where`` less the places whose fingerprint is not in the table."""
        out = np.zeros(len(where), bool)
        at = np.flatnonzero(where)
        out[at] = self.holds(keys[at])
        return out


def _key(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of a phrase: 45 bits of its hash and the number of words less one."""
    return ((hashes >> np.uint64(16)) & ~np.uint64(7)) | np.uint64(size - 1)


class _Numbers(dict):
    """word -> number in order of first use; the full stop is 0."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Run:
    """One language's words of a chunk: per size the fingerprints that begin at each place; ``real`` is false where a piece ends."""

    def __init__(self, lang: str, hashes: np.ndarray, longest: int, ids: np.ndarray | None = None) -> None:
        self.lang, self.ids = lang, ids
        own = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 1))
        self.real = hashes > 0
        words = mixed(hashes ^ own)
        self.keys = []
        hashes = words
        for size in range(1, longest + 1):
            if size > 1:
                hashes = mixed(hashes[:-1] * _MULTIPLIER + words[size - 1 :])
            self.keys.append(_key(hashes, size))

    def counted(self, named: list[Named]) -> Iterator[np.ndarray]:
        """Per size, the places of the phrases whose parts all tables of ``named`` hold; with none, of all phrases."""
        ok = self.real
        yield ok
        for size in range(2, len(self.keys) + 1):
            part = self.keys[size - 2]
            for table in named:
                ok = table.held(part[: len(ok)], ok)
            ok = ok[:-1] & ok[1:]
            yield ok


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value per byte, and the powers of an odd number and of its inverse modulo 2^64."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
    inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
    return values, *(np.cumprod(np.r_[np.uint64(1), np.full(size, m, np.uint64)], dtype=np.uint64) for m in (_MULTIPLIER, inverse))


def hashed(lowered: bytes) -> np.ndarray:
    """A hash per word and 0 per full stop, in order, without making the words: sums of byte values times powers, shifted back to the word's start."""
    out = []
    while lowered:
        cut = SLICE
        if len(lowered) > cut:
            # A slice ends behind a break, wherever the next one is.
            found = _BREAK.search(lowered, cut)
            cut = found.end() if found else len(lowered)
        text, lowered = np.frombuffer(lowered[:cut], np.uint8), lowered[cut:]
        values, power, back = _powers(1 << max(SLICE, len(text) - 1).bit_length())
        stop = text == 0x2E
        inside = ~(stop | (text == 0x20) | (text == 0x09))
        edge = np.diff(np.r_[False, inside, False].astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.cumsum(np.r_[np.uint64(0), values[text] * power[: len(text)]], dtype=np.uint64)
        words = mixed((sums[ends] - sums[starts]) * back[starts])
        hashes = np.zeros(len(text) + 1, np.uint64)
        hashes[starts] = np.maximum(words, np.uint64(1))
        stop[starts] = True
        out.append(hashes[:-1][stop])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _runs(docs: Iterator[pa.RecordBatch], longest: int, chunk: int, texts: bool = False) -> Iterator[tuple[list[bytes], list[_Run]]]:
    """Chunks of whole texts, one run per language; with ``texts`` also the distinct words and every word's number among them."""
    number, parts, bits, held = _Numbers(), {}, {}, 0

    def done() -> tuple[list[bytes], list[_Run]]:
        # A full stop after each text; texts of one language are hashed together.
        return list(number), [_Run(lang, hashed(b"".join(p)), longest, np.concatenate(bits[lang]) if texts else None) for lang, p in parts.items()]

    for batch in docs:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            text = text.as_py()
            if text:
                text = _lowered(text) + b"."
                parts.setdefault(lang, []).append(text)
                held += len(text)
                if texts:
                    found = _tokens(text)
                    bits.setdefault(lang, []).append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
                if held >= chunk:
                    yield done()
                    number, parts, bits, held = _Numbers(), {}, {}, 0
    if held:
        yield done()


def _packed(keys: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending fingerprints as gaps, and their counts."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return squeeze(np.diff(keys, prepend=np.uint64(0)).tobytes()), squeeze(n.astype("<u4" if n.max() < 1 << 32 else "<u8").tobytes())


def _unpacked(keys: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    expand = zstandard.ZstdDecompressor().decompress
    keys, n = np.cumsum(np.frombuffer(expand(keys), np.uint64), dtype=np.uint64), expand(n)
    return keys, np.frombuffer(n, f"<u{len(n) // max(len(keys), 1) or 4}").astype(np.int64)


def _distinct(runs: list[_Run], named: list[Named], before: list[Named]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending fingerprints that a chunk counts, and how often each occurs; the runs are used up."""
    found = []
    while runs:
        run = runs.pop()
        then = run.counted(before) if before else None
        for keys, now in zip(run.keys, run.counted(named)):
            found.append(keys[now & ~next(then) if then else now])
        del run, then, keys, now
    keys = np.concatenate(found)
    del found
    keys.sort()
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.r_[starts, len(keys)])


def count_fingerprints(docs: DataFrame, longest: int, least: int, ranges: int, named=None, before=None, chunk: int = CHUNK) -> DataFrame:
    """(key, n) of the phrases with n >= ``least`` over all of ``docs`` (lang, text), by fingerprint. With a broadcast table ``named``, of those whose parts
    it holds; with ``before`` too, of those only that are not counted by that table. Chunks send their counts packed by ranges of fingerprints."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = ([b.value] if b is not None else [] for b in (named, before))
        for _, runs in _runs(batches, longest, chunk):
            keys, n = _distinct(runs, new, old)
            # Sorted by value, so each range is a slice.
            number = _range_of(keys, ranges)
            cuts = np.flatnonzero(np.r_[True, np.diff(number) != 0]) if len(keys) else []
            rows = [(int(number[a]), *_packed(keys[a:z], n[a:z])) for a, z in zip(cuts, [*cuts[1:], len(keys)])]
            for at in range(0, len(rows), 1000):
                part = list(zip(*rows[at : at + 1000]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.binary()), pa.array(part[2], pa.binary())], names=["range", "keys", "n"])
            # Nothing of a chunk stays while the next one is read.
            del keys, n, number, rows
            released()

    def add(rows: pa.Table) -> pa.Table:
        parts = [_unpacked(k.as_py(), n.as_py()) for k, n in zip(rows.column("keys"), rows.column("n"))]
        keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, n = keys[starts], np.add.reduceat(n, starts)
        enough = n >= least
        return pa.table({"key": keys[enough].view(np.int64), "n": n[enough]})

    return docs.mapInArrow(count, "range long, keys binary, n binary").groupBy("range").applyInArrow(add, "key long, n long")


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Range of a fingerprint by its upper bits; ascending with the fingerprint."""
    return ((keys >> np.uint64(16)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def count_texts(docs: DataFrame, longest: int, least: int, ranges: int, frequent, chunk: int = CHUNK) -> DataFrame:
    """(lang, size, phrase, n) of the phrases whose fingerprint the broadcast table holds, counted under their text, with n >= ``least``; size 0
    holds all words. Chunks send sorted texts packed by ranges of fingerprints."""
    squeeze, expand = (lambda b: zstandard.ZstdCompressor(level=3).compress(b)), (lambda b: zstandard.ZstdDecompressor().decompress(b))

    def rows(run: _Run, text: pa.Array, size: int) -> Iterator[tuple]:
        at = np.flatnonzero(frequent.value.held(run.keys[size - 1], _unbroken(run.real, size)))
        # Phrases by the numbers of their words: the number of the phrase so far, then the next word.
        phrase, place = text, run.ids[at]
        for k in range(1, size):
            codes, place = np.unique(place * len(text) + run.ids[at + k], return_inverse=True)
            phrase = pc.binary_join_element_wise(phrase.take(pa.array(codes // len(text))), text.take(pa.array(codes % len(text))), b" ")
        n = np.bincount(place, minlength=len(phrase))
        number = np.zeros(len(phrase), np.int64)
        number[place] = _range_of(run.keys[size - 1][at], ranges)
        some = np.flatnonzero(n)
        found = pa.table({"range": number[some], "phrase": phrase.take(pa.array(some)), "n": n[some]}).sort_by([("range", "ascending"), ("phrase", "ascending")])
        number, n = found["range"].to_numpy(), found["n"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, np.diff(number) != 0]) if len(n) else []
        for start, end in zip(cuts, [*cuts[1:], len(n)]):
            yield run.lang, size, int(number[start]), squeeze(b"\n".join(found["phrase"].slice(start, end - start).to_pylist())), squeeze(n[start:end].astype("<i8").tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, runs in _runs(batches, longest, chunk, True):
            text = pa.array(words, pa.binary())
            for run in runs:
                whole = [(run.lang, 0, 0, squeeze(b""), squeeze(np.array([run.real.sum()], "<i8").tobytes()))]
                for part in (whole, *(rows(run, text, size) for size in range(1, longest + 1))):
                    columns = list(zip(*part))
                    if columns:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                                         names=["lang", "size", "range", "phrases", "n"])
            runs.clear()
            words = text = run = whole = part = columns = None
            released()

    def add(packed: pa.Table) -> pa.Table:
        # No phrase holds a line feed: it would have ended the piece.
        phrases = pa.concat_arrays([pa.array(expand(p.as_py()).split(b"\n"), pa.binary()) for p in packed.column("phrases")])
        n = np.concatenate([np.frombuffer(expand(c.as_py()), "<i8") for c in packed.column("n")])
        found = pa.table({"phrase": phrases, "n": n}).group_by("phrase").aggregate([("n", "sum")])
        size = packed.column("size")[0].as_py()
        found = found.filter(pc.greater_equal(found["n_sum"], least)) if size else found
        return _rows(packed.column("lang")[0].as_py(), size, found["phrase"].combine_chunks(), found["n_sum"].to_numpy())

    packed = docs.mapInArrow(count, "lang string, size int, range long, phrases binary, n binary")
    return packed.groupBy("lang", "size", "range").applyInArrow(add, COUNTS)


def _unbroken(real: np.ndarray, size: int) -> np.ndarray:
    """Places where ``size`` words follow each other without a break."""
    for _ in range(size - 1):
        real = real[:-1] & real[1:]
    return real


def _rows(lang: str, size: int, phrases: pa.Array, n: np.ndarray) -> pa.Table:
    langs = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(n), np.int32)))
    return pa.Table.from_arrays([langs, pa.array(np.full(len(n), size, np.int32)), phrases.cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "size", "phrase", "n"])


def bit_table(keys: DataFrame, bits: int) -> Named:
    """The table of fingerprints (``key``), built in tasks by segments; the driver gets its bytes, ``bits`` / 8 at most."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(Named.places(batch.column("key").to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at // SEGMENT_BITS), pa.array(at % SEGMENT_BITS)], names=["segment", "at"])

    def fill(rows: pa.Table) -> pa.Table:
        segment = np.zeros(min(SEGMENT_BITS, bits), bool)
        segment[rows.column("at").to_numpy()] = True
        packed = np.packbits(segment, bitorder="little").tobytes()
        return pa.table({"segment": rows.column("segment").slice(0, 1), "packed": pa.array([packed], pa.binary())})

    placed = keys.select("key").mapInArrow(place, "segment long, at long").distinct()
    out = np.zeros(bits // 8, np.uint8)
    for r in placed.groupBy("segment").applyInArrow(fill, "segment long, packed binary").collect():
        start = r.segment * SEGMENT_BITS // 8
        out[start : start + len(r.packed)] = np.frombuffer(r.packed, np.uint8)
    return Named(out)


def _not_named(counts: DataFrame, shared) -> DataFrame:
    """Border failures: frequent phrases whose bits are not set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~shared.value.holds(batch.column("key").to_numpy().view(np.uint64))))

    return counts.mapInArrow(task, "key long, n long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: float = SHARE, ease: float = EASE,
                     most_bits: int = MOST_BITS, chunk: int = CHUNK, lang: str = "lang", text: str = "text", seed: int = 7) -> tuple[DataFrame, DataFrame, list[int]]:
    """Exact counts (lang, size, phrase, n) of every phrase of at most ``longest`` words with n >= ``least``; words per language; phrases each pass found frequent."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    may_grow = F.col("key").bitwiseAND(7) < longest - 1
    lowered = max(1, int(share * least * ease))
    ranges = -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 1) // RANGE_CHARS)
    sample = kept(count_fingerprints(docs.sample(fraction=share, seed=seed), longest - 1, lowered, ranges, chunk=chunk))

    def bits(rows: int) -> int:
        return min(most_bits, max(SEGMENT_BITS, 1 << (16 * max(rows, 1) - 1).bit_length()))

    size = bits(sample.count())
    named, before, found, passes = bit_table(sample, size), None, None, []
    while True:
        shared = spark.sparkContext.broadcast(named)
        counts = kept(count_fingerprints(docs, longest, least, ranges, shared, before, chunk))
        found = counts if found is None else found.unionByName(counts)
        passes.append(counts.count())
        failed = kept(_not_named(counts.filter(may_grow), shared))
        if failed.isEmpty():
            break
        before, named = shared, Named(named.table | bit_table(failed, size).table)
    frequent = spark.sparkContext.broadcast(bit_table(found, bits(sum(passes))))
    exact = kept(count_texts(docs, longest, least, ranges, frequent, chunk))
    words = exact.filter(F.col("size") == 0).select("lang", F.col("n").alias("words"))
    return exact.filter(F.col("size") > 0), words, passes


def _first_words(phrase: Column, k: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), F.lit(1), k), " ")


def _rest(phrase: Column, k: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), k + 1, size - k), " ")


def exact_score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """The whole part of 1,000,000 a a / (l r), in decimals of 38 digits."""
    wide = "CAST({} AS DECIMAL(15, 0))".format
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({wide(a)} * {wide(a)})) DIV ({wide(l)} * {wide(r)})")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: tuple[int, int] = COVER, top: int = TOP, **mining) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by the score of their weakest cut."""
    every, words, _ = frequent_phrases(docs, least, longest, **mining)
    candidates = every.filter(F.col("size") >= 2).withColumnRenamed("n", "a")
    # Parts of longer candidates, with the largest count of a candidate around them.
    parts = candidates.filter(F.col("size") >= 3).select("lang", "a", "size", F.split("phrase", " ").alias("_w"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("_k"))
    parts = parts.select("lang", "a", "_w", "_k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_k") + 1)).alias("_at"))
    around = parts.groupBy("lang", F.array_join(F.slice("_w", F.col("_at"), F.col("_k")), " ").alias("phrase")).agg(F.max("a").alias("_around"))
    stays = F.col("_around").isNull() | (F.col("_around") * cover[1] < F.col("a") * cover[0])
    candidates = candidates.join(around, ["lang", "phrase"], "left").filter(stays)
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "size", "a", k).withColumn("_first", _first_words(F.col("phrase"), F.col("k")))
    cuts = cuts.withColumn("_rest", _rest(F.col("phrase"), F.col("k"), F.col("size")))
    known = every.select("lang", F.col("phrase").alias("_p"), "n")
    cuts = cuts.join(known.withColumnsRenamed({"_p": "_first", "n": "l"}), ["lang", "_first"]).join(known.withColumnsRenamed({"_p": "_rest", "n": "r"}), ["lang", "_rest"])
    weakest = cuts.withColumn("score", exact_score("a", "l", "r")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    scored = weakest.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    first = scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return first.join(words.withColumnRenamed("words", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), places AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM pieces WHERE len(ws) > 0
), f AS MATERIALIZED (
  SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, k AS size, count(*) AS a
  FROM places, (VALUES (1), (2), (3)) v(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 10
), candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 2
), around AS (
  SELECT lang, phrase, max(a) AS around FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE size = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE size = 3) GROUP BY ALL
), cuts AS (
  SELECT lang, phrase, a, size, w, unnest(range(1, size)) AS k FROM candidates LEFT JOIN around USING (lang, phrase)
  WHERE around IS NULL OR 100 * around < 50 * a
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r,
         CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1
), totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored JOIN totals USING (lang) QUALIFY rank <= 2000
"""


@query("op13_collocations", SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of two or three words of each language."""
    return collocations(table(spark, sf_dir, "documents"))
