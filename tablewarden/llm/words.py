"""Texts as sequences of the pieces that a tokenizer's pattern cuts, with every different piece of a task's documents once.

A task reads its documents in chunks and keeps a dictionary of the pieces it has met.  For each chunk it streams one row for each piece that is new to the
dictionary, and then one row for each document with the dictionary slots of its pieces.  What is computed per piece (by expressions, or by a
later Python step of the same stage) is computed once, without a shuffle, and rows stay in order.  A dictionary that has grown past ``KNOWN`` pieces
starts anew, so memory is bounded for any input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.common import released

CHUNK = 1_000_000             # pieces in a chunk, about
KNOWN = 400_000               # pieces in a dictionary, about
BATCH = 1_000                 # documents in an Arrow batch: their pieces are many times as many
#: Fixed value: the byte-level pattern of the public tokenizers, with Unicode white space spelled out for Java.  Words, the most frequent pieces, come
#: first: no other alternative before them could match where a word begins.
PIECES = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\t-\r\x{85}\p{Z}\p{L}\p{N}]+|[\t-\r\x{85}\p{Z}]+(?![^\t-\r\x{85}\p{Z}])|[\t-\r\x{85}\p{Z}]+"


def pieces(text: Column) -> Column:
    """The pieces of a text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), F.lit(0))


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH`` rows if it is higher (it is read when a query runs, so it stays lowered)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, BATCH)


def piece_rows(docs: DataFrame, keys: list[str], text: str = "text", chunk: int = CHUNK, known: int = KNOWN, derived: tuple[str, str, Callable] | None = None) -> DataFrame:
    """Rows (bytes of a new piece, its slot) and then (``keys`` and codes of a document), chunk after chunk, in the order of ``docs``.

    ``derived`` (name, SQL type, function of an Arrow array of pieces) takes the place of the pieces' bytes by what is computed from them.
    """
    small_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    piece = f"{derived[0]} {derived[1]}" if derived else "piece binary"
    schema = ", ".join([piece, "slot int", *(f"`{k}` {kinds[k]}" for k in keys), "codes binary"])
    return docs.select(*[F.col(f"`{k}`") for k in keys], pieces(F.col(f"`{text}`").cast("string")).alias("_pieces")).mapInArrow(
        _coded(len(keys), chunk, known, derived), schema)


def _coded(n_keys: int, limit: int, bound: int, derived):
    import pyarrow as pa
    import pyarrow.compute as pc

    def flush(held, known):
        table = pa.Table.from_batches(held)
        held.clear()
        lists = table["_pieces"].combine_chunks()
        coded = pc.dictionary_encode(lists.flatten())
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        table = table.drop_columns(["_pieces"])
        del lists
        words = coded.dictionary
        place = pc.index_in(words, value_set=known)
        fresh = words.filter(pc.is_null(place))
        slots = place.to_numpy(zero_copy_only=False).copy()
        slots[np.isnan(slots)] = np.arange(len(known), len(known) + len(fresh))
        codes = slots.astype(np.int32)[coded.indices.to_numpy(zero_copy_only=False)]
        del coded
        raw, names = fresh.cast(pa.binary()), [derived[0] if derived else "piece", "slot", *table.column_names, "codes"]
        kinds = [table.schema.field(k).type for k in range(n_keys)]
        blank = (derived[2](raw.slice(0, 0)) if derived else raw).type
        for lo in range(0, len(raw), 20_000):
            part = raw.slice(lo, 20_000)
            n = len(part)
            slot = pa.array(np.arange(len(known) + lo, len(known) + lo + n, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([derived[2](part) if derived else part, slot, *(pa.nulls(n, k) for k in kinds), pa.nulls(n, pa.binary())], names=names)
        for lo in range(0, table.num_rows, 1_000):
            rows = table.slice(lo, 1_000)
            n = rows.num_rows
            spans = [codes[(ends[i - 1] if i else 0):ends[i]].tobytes() for i in range(lo, lo + n)]
            yield pa.RecordBatch.from_arrays([pa.nulls(n, blank), pa.nulls(n, pa.int32()), *(rows[k].combine_chunks() for k in range(n_keys)), pa.array(spans, type=pa.binary())], names=names)
        return pa.concat_arrays([known, fresh])

    def run(batches) -> Iterator:
        held, count, known = [], 0, pa.array([], type=pa.string())
        for batch in batches:
            for lo in range(0, len(batch), 1_000):
                part = batch.slice(lo, 1_000)
                held.append(part)
                count += len(part.column(n_keys).flatten())
                if count >= limit:
                    known = yield from flush(held, known if len(known) <= bound else known.slice(0, 0))
                    held, count, part = [], 0, None
                    released()
        if any(len(b) for b in held):
            yield from flush(held, known if len(known) <= bound else known.slice(0, 0))
        released()

    return run


def streamed(batches, value: str) -> Iterator:
    """Runs of rows of one kind: (first slot, values of new pieces), or (None, batch of documents), for rows of ``piece_rows`` with the column ``value``.

    First slot 0 means that the dictionary starts anew.
    """
    import pyarrow.compute as pc

    for batch in batches:
        piece = pc.is_valid(batch["slot"]).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(piece.astype(np.int8))) + 1
        cuts = {0, len(piece), *edges.tolist(), *np.flatnonzero(pc.fill_null(batch["slot"], -1).to_numpy(zero_copy_only=False) == 0).tolist()}
        cuts = sorted(cuts)
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            yield (part["slot"][0].as_py(), part[value]) if piece[lo] else (None, part)


class Lists:
    """The values of a dictionary's pieces (arrays of integers), grown run by run."""

    def __init__(self):
        self.flat, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def add(self, first: int, flat: np.ndarray, lengths: np.ndarray) -> None:
        if first == 0:
            self.__init__()
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.lengths = np.concatenate([self.lengths, lengths.astype(np.int64)])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def of(self, codes: list[np.ndarray]):
        """A list array: for each document the values of its pieces, one after another."""
        import pyarrow as pa

        each = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        n = self.lengths[each]
        ends = np.cumsum(n)
        places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - self.starts[each], n) if len(each) else np.zeros(0, np.int64)
        sizes = np.zeros(len(codes) + 1, dtype=np.int32)
        sizes[1:] = np.concatenate([[0], ends])[np.cumsum([len(c) for c in codes])] if codes else []
        return pa.ListArray.from_arrays(pa.array(sizes), pa.array(self.flat[places]))
