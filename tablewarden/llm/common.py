"""Shared helpers: the cluster's shared folder, written intermediate tables, words of texts as numpy arrays."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only on a local master that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read from there: it cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id's decimal text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


_BASE, _LONG = 0x9E3779B97F4A7C15, 4096
_POWERS = np.ones(_LONG, dtype=np.uint64)
with np.errstate(over="ignore"):
    _POWERS[1:] = np.cumprod(np.full(_LONG - 1, _BASE, dtype=np.uint64))


def word_hashes(texts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts, in order: 64-bit hash, text number, first byte and end byte in the text.

    ``separators`` says for each byte value whether it separates words.  Words over 4,096 bytes are hashed by blake2b.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = ~separators[data]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts, ends
    lengths = ends - starts
    at = np.flatnonzero(inside)                                   # bytes of words, word after word
    firsts = np.zeros(len(starts), dtype=np.int64)
    np.cumsum(lengths[:-1], out=firsts[1:])
    offset = np.arange(len(at)) - np.repeat(firsts, lengths)
    with np.errstate(over="ignore"):
        hashes = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(offset, _LONG - 1)], firsts)
    for k in np.flatnonzero(lengths >= _LONG):
        hashes[k] = int.from_bytes(hashlib.blake2b(data[starts[k]:ends[k]].tobytes(), digest_size=8).digest(), "little")
    begins = np.zeros(len(texts), dtype=np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts[:-1]), dtype=np.int64, count=len(texts) - 1), out=begins[1:])
    owner = np.searchsorted(begins, starts, side="right") - 1
    return mix(hashes), owner, starts - begins[owner], ends - begins[owner]


def released() -> None:
    """Give back to the system what Arrow's allocator keeps for later: Python workers outlive their tasks, and those of a stage share an executor's memory."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def slices(batches, limit: int = 4 << 20, text: str = "text"):
    """Record batches cut into tables of about ``limit`` bytes of text, one row at least."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        table = pa.Table.from_batches([batch])
        sizes = np.cumsum(pc.fill_null(pc.binary_length(table[text]), 0).to_numpy().astype(np.int64))
        start = 0
        while start < table.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
            yield table.slice(start, end - start)
            start = end
        del batch, table
        released()
