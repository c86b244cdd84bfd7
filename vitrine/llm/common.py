"""What the training-data operators share: word rules, staged tables and Arrow text batches."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import shared_dir

#: The six ASCII white space characters, as a regular expression class and as plain characters.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

def posix_path(uri: str) -> str:
    """The plain path of a ``file:`` URI; memory-mapped stores need a shared folder that is mounted as one."""
    parts = urlsplit(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"a memory-mapped store needs a mounted shared folder, not {uri}")
    return unquote(parts.path)


def staged(df: DataFrame, name: str = "staged") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the words of a text, white space being ASCII's; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words, without building them one by one; null gives 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, f"{SPACE}+"))).cast("long")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 documents, so that a Python worker's memory does not follow the longest texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def doc_slices(batches: Iterator[pa.RecordBatch], max_bytes: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts hold about ``max_bytes``; one longer text is a slice of its own."""
    for batch in batches:
        start, size = 0, 0
        column = batch.column(batch.schema.get_field_index(text))
        for i in range(batch.num_rows):
            n = len(column[i].as_buffer()) if column[i].is_valid else 0
            if i > start and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


# ---- words of a stretch of text, hashed without a loop over words --------------------------------

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_VALUES = np.random.Generator(np.random.PCG64(2021)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]  # A-Z count as a-z
_VALUES[_IS_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_ROW = 4096


def _powers(base: np.uint64, step: int, n: int) -> np.ndarray:
    """base^0, base^step, ... of 64 bits."""
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, pow(int(base), step, 1 << 64), dtype=np.uint64)]), dtype=np.uint64)


_WITHIN, _BACK = _powers(_BASE, 1, _ROW), _powers(np.uint64(pow(int(_BASE), -1, 1 << 64)), 1, _ROW)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one line of bytes, a line end after each, and where every word of it starts and ends."""
    line = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    edges = np.diff(_IS_SPACE[line].astype(np.int8), prepend=np.int8(1))
    return line, np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased), one text after another, and the number of words of each text."""
    line = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _IS_SPACE[line]
    begins = ~space
    begins[1:] &= space[:-1]
    starts = np.flatnonzero(begins)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, offsets))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    # a byte at place i counts BASE^i in the line, and a word's sum is divided by BASE^start; powers are products of one within a row and the row's
    rows = -(-len(line) // _ROW)
    values = np.zeros((rows, _ROW), dtype=np.uint64)
    np.take(_VALUES, line, out=values.reshape(-1)[: len(line)])
    values *= _WITHIN
    values *= _powers(_BASE, _ROW, rows)[:, None]
    sums = np.add.reduceat(values.reshape(-1), starts) * _BACK[starts % _ROW] * _powers(_BACK[1], _ROW, rows)[starts // _ROW]
    return mixed_bits(sums), counts
