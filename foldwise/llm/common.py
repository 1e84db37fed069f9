"""What several corpus operators share: tables, written intermediate results, ASCII-rule words, word hashes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.session import cut_lineage

# Words are runs of anything but these six characters, the ones `bytes.split()` splits at.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """The table written once to the shared checkpoint folder, so that neither a second use nor a lost executor computes it again."""
    return cut_lineage(df)


# Rows of a small side that go to every executor at most; at some tens of bytes a row this stays below 100 MB.
BROADCAST_ROWS = 1_000_000


def measured(df: DataFrame) -> DataFrame:
    """The table written out and counted; hinted for broadcast only if its rows stay below the bound, else joined by shuffle."""
    df = kept(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def released() -> None:
    """Gives freed memory back to the system: a Python worker outlives its task and would wait with it beside those of the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, everything else untouched; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[bytes]:
    """ASCII-lower-cased words of a whole text."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when full, which changes no value."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = values ^ (values >> np.uint64(29))
    values = values * _MIX
    return values ^ (values >> np.uint64(32))


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order of position; empty where there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return hashes[:0]
    total = hashes[:n].copy()
    for k in range(1, width):
        total = total * _MULTIPLIER + hashes[k : k + n]
    return mixed(total)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
