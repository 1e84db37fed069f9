"""BPE encoding and decoding with a distinct-word table.

Texts are split at ASCII white space in tasks that pack their rows into blocks: the key columns, the distinct words of the block, frequent
ones first, and every document as places in that list. The blocks are written once. Each block then asks the ranges of a 64-bit word hash
for the ids of its distinct words, so a word costs a block one question however often it occurs; a range holds all askers of its words, so each
distinct word of the corpus is encoded once. The answers meet the blocks by block number, and ids follow by position: a gather of runs.
Decoding joins ids with the pieces of the vocabulary (bounded by its size) and joins the pieces of each row in order.

Why white space may cut: the tokenizer must turn any white space into a border that no piece and no normalisation crosses; ``checked`` tries it
on the file. Special tokens' strings inside a text become their ids, as the library has it by default.

At scale: the number of ranges follows from the counted questions (``RANGE_WORDS`` each), blocks hold ``BLOCK_CHARS`` characters, so neither grows with
the input; a word of a third of all documents is one question of each block. A block asks at most as many ranges as it has words.

Defined results: a null or empty text and one of white space only has no ids; null ids decode to null, no ids to the empty text; ids outside the
vocabulary are left out, as the library does; repeated rows and null keys are rows like others; an empty table gives none; only the
key columns are carried, whatever others are called.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foldwise.llm.common import kept, released, table
from foldwise.llm.registry import query

BLOCK_CHARS = 32_000_000
RANGE_WORDS = 500_000
# Tokens handled at a time while ids or pieces of a block are laid out.
STEP_TOKENS = 400_000
LEVEL = 9
BLOCK = "block long, n_words long, keys binary, words binary, counts binary, places binary"
ASK = "range long, block long, at binary, words binary"
ANSWER = "block long, at binary, lengths binary, ids binary"


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file; any other path will do as well, if every executor has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def loaded(path: str):
    """The tokenizer, read once per Python worker."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work out, a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def checked(path: str) -> None:
    """Stops with an error unless words can be encoded apart from each other and pieces are joined without a decoder."""
    tokenizer = loaded(path)
    parts = ["it's", "Café", "́x", "12a", "Σας,", "(b)"]

    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    if tokenizer.decoder is not None or any(ids(s.join(parts)) != [i for p in parts for i in ids(p)] for s in (" ", "\n", "\t \r")):
        raise ValueError(f"{path}: words cannot be encoded one by one, or pieces have a decoder")


@functools.cache
def pieces(path: str, skip_special: bool = False) -> pa.Array:
    """Piece of every id; null for ids without one."""
    # The pieces are all that is needed from here on; the tokenizer itself is not kept beside them.
    tokenizer = loaded.__wrapped__(path)
    special = {i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special} if skip_special else set()
    by_id = {i: p for p, i in tokenizer.get_vocab().items() if i not in special}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string())


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32, byte plane by byte plane, which suits the compressor better than one number after the other."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=LEVEL).compress(planes.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_ids(ids: np.ndarray) -> bytes:
    """Ids in two bytes each where they fit; their pairs repeat, so they stay side by side."""
    narrow = not len(ids) or ids.max() < 1 << 16
    return (b"2" if narrow else b"4") + zstandard.ZstdCompressor(level=LEVEL).compress(ids.astype("<u2" if narrow else "<u4").tobytes())


def _unpack_ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), f"<u{packed[:1].decode()}")


def _join(items: list[bytes]) -> bytes:
    # A word holds no white space, so a line feed parts them.
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"\n".join(items))


def _split(packed: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed).split()


class _Block:
    """Rows gathered by a task until they hold enough characters."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.keys: list[pa.RecordBatch] = []
        self.counts: list[int] = []
        self.places: list[np.ndarray] = []
        self.chars = 0

    def add(self, keys: pa.RecordBatch, texts: list[str | None]) -> None:
        """Takes rows whole."""
        self.keys.append(keys)
        number = self.words
        for text in texts:
            found = text.encode("utf-8", "surrogatepass").split() if text else []
            for word in found:
                if word not in number:
                    number[word] = len(number)
            self.counts.append(len(found))
            self.places.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
            self.chars += len(text) if text else 0

    def row(self, block: int) -> pa.RecordBatch:
        keys = pa.Table.from_batches(self.keys)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, keys.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(keys)
        places = np.concatenate(self.places) if self.places else np.zeros(0, np.uint32)
        # Frequent words get the small numbers, which take less room.
        order = np.argsort(-np.bincount(places, minlength=len(self.words)), kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        words = list(self.words)
        places = number[places]
        values = [block, len(words), sink.getvalue().to_pybytes(), _join([words[i] for i in order]), _pack(np.array(self.counts, np.uint32)), _pack(places)]
        names = ["block", "n_words", "keys", "words", "counts", "places"]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 2 else pa.binary()) for i, v in enumerate(values)], names=names)


def blocks(docs: DataFrame, keys: list[str], text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block: its key columns, distinct words, words per document and the documents as places in the word list; written once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        block = _Block()
        for batch in batches:
            texts, rest = batch.column(0), batch.select(range(1, batch.num_columns))
            lengths = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                # As many rows as still fit, at least one.
                room = block_chars - block.chars + (lengths[at - 1] if at else 0)
                upto = max(at + 1, int(np.searchsorted(lengths, room, "right")))
                block.add(rest.slice(at, upto - at), texts.slice(at, upto - at).to_pylist())
                at = upto
                if block.chars >= block_chars or at < batch.num_rows:
                    yield block.row(number)
                    number, block = number + 1, _Block()
                    released()
        if block.counts:
            yield block.row(number)
        del block
        released()

    return kept(docs.select(F.col(text).alias("_text"), *[F.col(k) for k in keys]).mapInArrow(gather, BLOCK))


def _asked(ranges: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist()):
                found = _split(packed)
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
                # The upper half of the hash, scaled to the number of ranges.
                number = ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(number, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(number[order]) != 0]) if len(order) else []
                for at, upto in zip(starts, [*starts[1:], len(order)]):
                    mine = order[at:upto]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number[mine[0]]]), pa.array([block]), pa.array([_pack(np.diff(mine, prepend=0))], pa.binary()), pa.array([_join([found[i] for i in mine])], pa.binary())],
                        names=["range", "block", "at", "words"],
                    )

    return ask


def _encoded(path: str):
    def answer(asked: pa.Table) -> pa.Table:
        tokenizer = loaded(path)
        number: dict[bytes, int] = {}
        wanted = []
        for packed in asked.column("words").to_pylist():
            found = _split(packed)
            for word in found:
                if word not in number:
                    number[word] = len(number)
            wanted.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        distinct = list(number)
        lengths, flat = np.zeros(len(distinct), np.int64), []
        del number
        for at in range(0, len(distinct), 10_000):
            part = [w.decode("utf-8", "surrogatepass") for w in distinct[at : at + 10_000]]
            runs = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            lengths[at : at + len(runs)] = [len(r) for r in runs]
            flat.append(np.fromiter(itertools.chain.from_iterable(runs), np.uint32))
        ids, starts = np.concatenate(flat), np.cumsum(lengths) - lengths
        del distinct, flat, part, runs
        released()
        rows = {"block": asked.column("block").to_pylist(), "at": asked.column("at").to_pylist(), "lengths": [], "ids": []}
        for mine in wanted:
            rows["lengths"].append(_pack(lengths[mine]))
            rows["ids"].append(_pack_ids(_gathered(starts, lengths, ids, mine)))
        return pa.table(rows, pa.schema([("block", pa.int64()), ("at", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())]))

    return answer


def _gathered(starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Ids of a run of words, one after the other."""
    size = lengths[places]
    ends = np.cumsum(size)
    return ids[np.repeat(starts[places] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _tokens_before(ends: np.ndarray, lengths: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Tokens before each of the ascending positions ``ends`` of a run of words, a step of words at a time."""
    out, base = np.zeros(len(ends), np.int64), 0
    for start in range(0, len(places), STEP_TOKENS):
        run = np.cumsum(lengths[places[start : start + STEP_TOKENS]])
        lo, hi = np.searchsorted(ends, [start, start + len(run)], "right")
        out[lo:hi] = base + run[ends[lo:hi] - start - 1]
        base += int(run[-1])
    return out


def _placed(schema: pa.Schema):
    def place(block: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in block.to_pylist():
            keys = pa.ipc.open_stream(row["keys"]).read_all()
            n = row["n_words"]
            starts, lengths = np.zeros(n, np.int64), np.zeros(n, np.int64)
            runs, base = [], 0
            for at, size, ids in zip(*(answers.column(c).to_pylist() for c in ("at", "lengths", "ids"))):
                at, size = np.cumsum(_unpack(at), dtype=np.int64), _unpack(size).astype(np.int64)
                starts[at] = base + np.cumsum(size) - size
                lengths[at] = size
                runs.append(_unpack_ids(ids).astype(np.int32))
                base += len(runs[-1])
            ids = np.concatenate(runs) if runs else np.zeros(0, np.int32)
            places, counts = _unpack(row["places"]), _unpack(row["counts"]).astype(np.int64)
            ends = np.r_[0, np.cumsum(counts)]
            tokens = _tokens_before(ends, lengths, places)
            at, chunks = 0, []
            while at < len(counts):
                upto = max(at + 1, int(np.searchsorted(tokens, tokens[at] + STEP_TOKENS, "right")) - 1)
                flat = _gathered(starts, lengths, ids, places[ends[at] : ends[upto]])
                chunks.append(pa.ListArray.from_arrays(pa.array(tokens[at : upto + 1] - tokens[at], pa.int32()), pa.array(flat)))
                at = upto
            columns = [*keys.columns, pa.chunked_array(chunks, pa.list_(pa.int32()))]
            out.append(pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema))
        released()
        return pa.concat_tables(out) if out else schema.empty_table()

    return place


def encode(docs: DataFrame, keys: list[str], text: str = "text", path: str | None = None,
           block_chars: int = BLOCK_CHARS, range_words: int = RANGE_WORDS) -> DataFrame:
    """The key columns of every row and ``ids``, the ids of its whole text without special tokens added."""
    path = path or vocabulary_file()
    checked(path)
    written = blocks(docs, keys, text, block_chars)
    ranges = -(-(written.agg(F.sum("n_words")).first()[0] or 1) // range_words)
    asked = written.select("block", "words").mapInArrow(_asked(ranges), ASK)
    answers = asked.groupBy("range").applyInArrow(_encoded(path), ANSWER)
    schema = T.StructType([*docs.select(*keys).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return written.drop("words").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_placed(to_arrow_schema(schema)), schema)


def decode(encoded: DataFrame, ids: str = "ids", path: str | None = None, skip_special: bool = False) -> DataFrame:
    """All columns and ``decoded``: the pieces of ``ids`` in order, parted by spaces."""
    path = path or vocabulary_file()
    checked(path)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pieces(path, skip_special)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(ids))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_TOKENS, "right")))
                part, at = batch.slice(at, upto - at), upto
                lists = part.column(batch.schema.get_field_index(ids))
                flat = lists.flatten()
                known = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(piece))), flat, None)
                found = piece.take(known)
                # Ids without a piece are left out: the lists are cut anew around those that have one.
                offsets = np.r_[0, np.cumsum(found.is_valid().to_numpy(zero_copy_only=False))]
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                offsets = offsets[np.r_[0, np.cumsum(size)]]
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found.drop_null()), " ")
                texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return encoded.mapInArrow(join, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


@query("op11_bpe_round_trip")
def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document, and of the text they decode to."""
    found = decode(encode(table(spark, sf_dir, "documents"), ["doc_id"]))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
