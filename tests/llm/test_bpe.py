"""Word-table BPE against the tokenizer run on whole texts."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from foldwise.llm import bpe
from foldwise.llm.catalog import QUERIES

TEXTS = [
    None, "", " \t\n\r\x0b\x0c ", "It's the <|endoftext|>end<|startoftext|>", "Café Café x ́y", "Σας ΟΔΟΣ İstanbul", "a b c d　e",
    "日本語 12345 !!! ... 're we'll", "\x00 \x07 zero", "z" * 50_000, "word " * 20_000, "it's", "it's", "😀😀 ok",
]


def whole(text):
    tokenizer = bpe.loaded(bpe.vocabulary_file())
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return ids, tokenizer.decode(ids, skip_special_tokens=False)


def test_placing_a_block_takes_little_beside_its_ids():
    """Ids are laid out a step at a time: no 64-bit column of the block's words or tokens is made."""
    many, words = 200, 3_000_000
    places = np.random.default_rng(1).integers(0, many, words, dtype=np.uint32)
    counts = np.full(words // 1000, 1000, np.uint32)
    sink = pa.BufferOutputStream()
    keys = pa.table({"doc_id": pa.array(range(len(counts)), pa.int64())})
    with pa.ipc.new_stream(sink, keys.schema) as out:
        out.write_table(keys)
    block = pa.table({"block": [0], "n_words": [many], "keys": [sink.getvalue().to_pybytes()], "counts": [bpe._pack(counts)], "places": [bpe._pack(places)]})
    lengths, ids = np.arange(many) % 3, np.arange(3 * many, dtype=np.uint32)[: int((np.arange(many) % 3).sum())]
    answers = pa.table({"block": [0], "at": [bpe._pack(np.diff(np.arange(many), prepend=0))], "lengths": [bpe._pack(lengths)], "ids": [bpe._pack_ids(ids)]})
    place = bpe._placed(pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))
    tracemalloc.start()
    found = place(block, answers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    starts = np.cumsum(lengths) - lengths
    want = [i for p in places[5000:6000] for i in ids[starts[p] : starts[p] + lengths[p]]]
    assert found["ids"][5].as_py() == want and found.num_rows == len(counts)
    # Places packed, in planes and side by side, the ids of two bytes each word, and the step.
    assert peak < 16 * words


@pytest.mark.parametrize("limits", [{}, {"block_chars": 40, "range_words": 3}, {"block_chars": 100_000, "range_words": 1}])
def test_round_trip_on_edge_rows(spark, limits):
    rows = [(None if i == 5 else i, t, "e", "t") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string").repartition(3)
    found = bpe.decode(bpe.encode(docs, ["doc_id", "lang"], **limits)).collect()
    assert len(found) == len(TEXTS) and {r.lang for r in found} == {"e"}
    by_id = {r.doc_id: r for r in found}
    for i, text in enumerate(TEXTS):
        row = by_id[None if i == 5 else i]
        assert (row.ids, row.decoded) == whole(text)


def test_empty_table_and_odd_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, ["doc_id"])).collect() == []
    odd = spark.createDataFrame([(1, None), (2, []), (3, [585, 10_000_000, -1, None, 49407, 518])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in bpe.decode(odd).collect()} == {1: None, 2: "", 3: "it</w> <|endoftext|> the</w>"}
    assert {r.k: r.decoded for r in bpe.decode(odd, skip_special=True).collect()}[3] == "it</w> the</w>"


def test_unfit_vocabulary(spark):
    with pytest.raises(ValueError):
        bpe.checked(bpe.vocabulary_file("byte_bpe_50k.json"))


def test_each_distinct_word_is_asked_once_a_block(spark):
    docs = spark.createDataFrame([(i, "the same words again and again the same") for i in range(500)], "doc_id long, text string").coalesce(1)
    row = bpe.blocks(docs, ["doc_id"]).first()
    assert row.n_words == 5 and bpe._split(row.words) == [b"the", b"same", b"again", b"words", b"and"]


def test_query_on_whole_tables(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op11_bpe_round_trip"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        ids, decoded = whole(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
