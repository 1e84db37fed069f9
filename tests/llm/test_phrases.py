"""Mined phrases against a plain count of every contiguous run of words."""

import collections
import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldwise.llm import phrases as P
from foldwise.llm.catalog import ORACLES, QUERIES
from tests.compare import check

SCHEMA = "doc_id long, text string, lang string, n long, phrase string, size int"


def counts(rows, longest):
    found, words = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            run = re.findall(r"[^\x20\x09]+", piece)
            words[lang or "und"] += len(run)
            for size in range(1, longest + 1):
                found.update((lang or "und", *run[i : i + size]) for i in range(len(run) - size + 1))
    return found, words


def plain(rows, least, longest=3, top=2000):
    f, words = counts(rows, longest)
    candidates = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    scored = collections.defaultdict(list)
    for (lang, *w), a in candidates.items():
        around = [b for (other, *v), b in candidates.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * b >= 50 * a for b in around):
            continue
        cuts = [(1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        scored[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i, p.decode(), -a, l, r, words[lang], -s) for lang, found in scored.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


@pytest.fixture(scope="module")
def rows():
    dice = random.Random(3)
    vocabulary = ["The", "the", "cat", "sat", "on", "mat", "é", "日本", "\x00", "x-y", "don't", "zzz"]
    made = [(" ".join(dice.choices(vocabulary, [9, 9, 5, 5, 4, 3, 2, 2, 1, 1, 1, 1], k=dice.randint(0, 40))) + dice.choice(["", ".", "!? ", "\n", "\t"]), dice.choice(["en", "de", None, "und"])) for _ in range(300)]
    made += [("new york city. new york, new york city\x0bnew york city", "en")] * 5 + [(None, "en"), ("", None), (" \t ", "fr"), ("...", "fr"), ("once only", "fr")]
    return made + [("long " * 30_000, "de"), ("a b c a b c", "en")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "p", 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(4)


@pytest.mark.parametrize("limits", [{}, {"share": 0.0}, {"share": 1.0, "most_bits": 64}, {"share": 0.05, "chunk": 50}, {"share": 0.3, "least": 3, "chunk": 7}])
def test_phrases_equal_a_plain_count(spark, rows, limits):
    got = P.collocations(frame(spark, rows), **limits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, limits.get("least", 10))


def test_longer_phrases_and_short_lists(spark, rows):
    got = P.collocations(frame(spark, rows), least=6, longest=4, top=7, share=0.1)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 6, 4, 7)


def test_counts_are_exact_and_border_failures_expand(spark, rows):
    every, _, passes = P.frequent_phrases(frame(spark, rows), share=0.0)
    assert {(r.lang, *r.phrase.split(" ")): r.n for r in every.collect()} == {k: v for k, v in counts(rows, 3)[0].items() if v >= 10}
    # Nothing was proposed: words fail first, then pairs of them, then nothing is left.
    assert len(passes) == 3 and all(passes)
    _, _, once = P.frequent_phrases(frame(spark, rows), share=1.0, ease=0.1)
    assert len(once) == 1


def test_empty_table(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_scores_beyond_64_bits(spark):
    pairs = [(10**14 - 1, 10**14 + 7, 3 * 10**14 + 1), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (10, 3_000_000_019, 7)]
    df = spark.createDataFrame(pairs, "a long, l long, r long")
    got = [r.score for r in df.select(P.exact_score("a", "l", "r").alias("score")).collect()]
    assert got == [1_000_000 * a * a // (l * r) for a, l, r in pairs]


def test_sql(spark, sf_dir):
    assert check(spark, sf_dir, QUERIES["op13_collocations"], ORACLES["op13_collocations"])[0] == "ok"


def test_a_chunk_is_gone_before_the_next_is_counted():
    """Memory of a counting task, over chunks of the size that the query takes."""
    class Taken:
        def mapInArrow(self, task, schema):
            self.task = task
            return self

        def groupBy(self, *_):
            return self

        applyInArrow = groupBy

    docs = Taken()
    P.count_fingerprints(docs, 3, 10, 64)
    text = " ".join(f"w{i * i % 99991}" for i in range(100_000))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
    tracemalloc.start()
    rows = sum(b.num_rows for b in docs.task(iter([batch] * (30_000_000 // len(text)))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 150_000_000
