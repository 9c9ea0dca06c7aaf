"""Token ids as Parquet files.

Rows lie in ascending doc_id order over the files (``part`` numbers them): doc_id, part, start_in_part, n_tokens and the list of ids.  Numbers that rise or
repeat are delta encoded, ids are dictionary encoded (fewer than 2^16 different ones take two bytes or less), row groups and pages have set
sizes, and page indexes let a reader skip to the pages of a doc_id.  ``metadata`` reads no ids, ``tokens_of`` reads the pages it needs.
"""

from __future__ import annotations

import json
import os
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tablewarden.llm.common import released, shared_folder, slices
from tablewarden.llm.words import BATCH, small_batches

ROW_GROUP, PAGE = 32 << 20, 256 << 10
END = 2                       # the id appended to each document
CHUNK = 6 << 20               # bytes of text that a task cuts at once, about
KEPT = 400_000                # pieces whose ids a Python worker keeps from task to task
JOINED = 500                  # pieces that go to the library as one text
LAYOUT = {"parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.writer.version": "PARQUET_2_0", "compression": "zstd",
          **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "start_in_part", "n_tokens")}}


def added_tokens(model: bytes, specials: bool) -> list[str]:
    """The strings that the library finds in a text before it cuts pieces; without ``specials`` those of special tokens are ordinary text."""
    found = [t for t in json.loads(model).get("added_tokens") or [] if specials or not t["special"]]
    if odd := [t["content"] for t in found if t["single_word"] or t["lstrip"] or t["rstrip"]]:
        raise ValueError(f"added tokens that depend on what stands beside them: {odd}")
    return [t["content"] for t in found]


class PieceIds:
    """Ids of pieces by the tokenizers library, as bytes of 32-bit numbers; the first ``KEPT`` different pieces are kept.

    Pieces go to the library joined.  Words behind one space follow each other as in a text: where a token begins with a space, the next word begins.  Other
    pieces are joined by the added token, where the library cuts texts anyway, if there is one such token and it cannot overlap with itself.
    """

    def __init__(self, model: bytes, specials: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # the task is the unit of work
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_buffer(model), {}
        self.tokenizer.encode_special_tokens = not specials      # True: their strings in a text are ordinary text
        added = added_tokens(model, specials)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)        # tokens that begin with a space (its byte is written so)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.cut = added[0] if len(added) == 1 and not any(added[0].startswith(added[0][k:]) for k in range(1, len(added[0]))) else None

    @staticmethod
    def of_worker(model: bytes, specials: bool) -> PieceIds:
        """The one of this Python worker: workers outlive tasks, functions that travel by value do not."""
        held = sys.modules.setdefault("_tablewarden_piece_ids", types.ModuleType("_tablewarden_piece_ids")).__dict__
        if held.get("key") != (model, specials):
            held.update(key=(model, specials), ids=PieceIds(model, specials))
        return held["ids"]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        is_word = [t[:1] == " " and t[1:].isalpha() for t in texts]
        words = self._joined([t for t, w in zip(texts, is_word) if w], "", lambda ids: np.flatnonzero(self.spaced[ids]), 0)
        others = [t for t, w in zip(texts, is_word) if not w]
        if self.cut is None or self.cut in others or not all(others):
            others = iter([self._ids(t).tobytes() for t in others])
        else:
            mark = self.tokenizer.token_to_id(self.cut)
            others = self._joined(others, self.cut, lambda ids: np.append(-1, np.flatnonzero(ids == mark)), 1)
        return [next(words if w else others) for w in is_word]

    def _joined(self, texts: list[str], by: str, begins, skip: int) -> Iterator[bytes]:
        """Ids of the texts, ``JOINED`` encoded at once; each begins ``skip`` ids behind one of ``begins(ids)`` and ends before the next."""
        for lo in range(0, len(texts), JOINED):
            some = texts[lo:lo + JOINED]
            ids = self._ids(by.join(some))
            at = begins(ids)
            if len(at) != len(some):
                yield from (self._ids(t).tobytes() for t in some)
                continue
            ends, raw = [*(4 * at).tolist(), 4 * len(ids)], ids.tobytes()
            yield from (raw[a + 4 * skip:b] for a, b in zip(ends, ends[1:]))

    def __call__(self, texts: list[str]) -> list[bytes]:
        found = list(map(self.known.get, texts))
        new = [k for k, ids in enumerate(found) if ids is None]
        unknown = [texts[k] for k in new]
        fresh = self._encoded(unknown)
        for k, ids in zip(new, fresh):
            found[k] = ids
        self.known.update(zip(unknown[:max(0, KEPT - len(self.known))], fresh))
        return found


def _cut_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds of bytes, and for (kind, next kind): whether a piece ends between them, and whether white space precedes something else."""
    kinds = np.full(256, MAYBE, dtype=np.uint8)
    kinds[:128] = MARK
    for some, kind in ((b"\t\n\x0b\f\r", BREAK), (b" ", SPACE), (b"'", QUOTE), (b"0123456789", DIGIT)):
        kinds[list(some)] = kind
    kinds[[*range(65, 91), *range(97, 123)]] = LETTER
    blank, solid = (BREAK, SPACE), (LETTER, DIGIT, MARK, QUOTE, OTHER)
    ends, before = np.zeros(64, dtype=bool), np.zeros(64, dtype=bool)
    for x, y in [*((x, y) for x in solid for y in blank), *((BREAK, y) for y in solid), (LETTER, DIGIT), (LETTER, MARK), (LETTER, QUOTE), (DIGIT, LETTER), (DIGIT, MARK),
                 (DIGIT, QUOTE), (MARK, LETTER), (MARK, DIGIT), (QUOTE, DIGIT)]:
        ends[x << 3 | y] = True
    for x in blank:
        before[[x << 3 | y for y in solid]] = True
    return kinds, ends, before


#: Kinds of bytes: those of MAYBE belong to characters that may be white space, those of OTHER to characters beyond ASCII that are not.
MAYBE, LETTER, DIGIT, BREAK, SPACE, MARK, QUOTE, OTHER = range(8)
KINDS, ENDS, BEFORE = _cut_table()


def stretches(data: np.ndarray, starts: np.ndarray, added: list[bytes]) -> np.ndarray:
    """Where stretches of UTF-8 texts begin that have the same ids alone as in their text; ``starts``: where texts that are not empty begin.

    A stretch is one piece of the byte-level pattern (``words.PIECES``) wherever bytes tell: words of Latin letters, digits, marks.  Elsewhere it may be several: no
    stretch ends behind a character that may be white space or beside letters that are not Latin-1.  Of several white spaces before something else the
    last stands apart; letters stay with an apostrophe before them; the strings ``added`` are not cut, nor is the white space before them.
    """
    kinds = KINDS[data]
    high = np.flatnonzero(data >= 128)
    if len(high):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        first = data[high] >= 192
        lead = high[first]
        one, two, three = padded[lead], padded[lead + 1], padded[lead + 2]
        latin = (one == 0xC3) & (two != 0x97) & (two != 0xB7)
        blank = (one == 0xC2) & ((two == 0x85) | (two == 0xA0)) | (one == 0xE1) | (one == 0xE3)
        blank |= (one == 0xE2) & ((two == 0x81) | (two == 0x80) & ((three < 0x90) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF)))
        kinds[high] = np.where(latin, LETTER, np.where(blank, MAYBE, OTHER)).astype(np.uint8)[np.cumsum(first) - 1]
    pairs = kinds[:-1] << 3 | kinds[1:]
    pairs[starts[1:] - 1] = 0                              # the next text does not count
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = ENDS[pairs]
    cut[:-1] |= BEFORE[pairs]
    raw = data.tobytes() if added else b""
    for token in added:
        at = raw.find(token)
        while at >= 0:
            cut[max(0, at - 1)] = False
            cut[at + 1:at + len(token)] = False
            at = raw.find(token, at + 1)
    cut[starts] = True
    return np.flatnonzero(cut)


def _chunks(batches, limit: int):
    """The rows in tables of about ``limit`` bytes of text."""
    import pyarrow as pa

    held, size = [], 0
    for table in slices(batches, limit):
        if held and size >= limit:
            yield pa.concat_tables(held)
            held, size = [], 0
        held.append(table)
        size += table["text"].nbytes
    if held:
        yield pa.concat_tables(held)


def _tokenized(model: bytes, end: int, specials: bool, limit: int = CHUNK):
    import pyarrow as pa
    import pyarrow.compute as pc

    def ids_of_texts(texts, ids_of, added):
        """The ids of all texts, one after another, and the number of each text's ids; ``end`` follows each text."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
        lo, hi = int(offsets[0]), int(offsets[-1])
        if lo == hi:
            return np.full(len(texts), end, dtype=np.int32), np.ones(len(texts), dtype=np.int64)
        starts = (offsets[:-1] - lo)[np.diff(offsets) > 0]
        begins = stretches(np.frombuffer(texts.buffers()[2], dtype=np.uint8)[lo:hi], starts, added)
        bounds = np.append(begins, hi - lo).astype(np.int32) + np.int32(lo)
        coded = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(bounds), texts.buffers()[2]]).dictionary_encode()
        found = ids_of(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, found), np.int32, len(found)) >> 2
        flat, each = np.frombuffer(b"".join(found), dtype=np.int32), coded.indices.to_numpy(zero_copy_only=False)
        n = lengths[each]
        ends = np.cumsum(n, dtype=np.int64)
        shift = (np.cumsum(lengths, dtype=np.int64) - lengths)[each] - (ends - n)
        ids = flat[np.arange(ends[-1]) + np.repeat(shift, n)]
        text_ends = np.append(0, ends)[np.searchsorted(begins, offsets[1:] - lo)]
        return np.insert(ids, text_ends, np.int32(end)), np.diff(text_ends, prepend=0) + 1

    def run(batches):
        from pyspark import TaskContext

        ids_of, added = PieceIds.of_worker(model, specials), [t.encode() for t in added_tokens(model, specials)]
        part, start = TaskContext.get().partitionId(), 0
        for table in _chunks(batches, limit):
            ids, n = ids_of_texts(pc.fill_null(table["text"].combine_chunks().cast(pa.string()), ""), ids_of, added)
            ends = np.append(0, np.cumsum(n))
            for lo in range(0, len(n), BATCH):
                some = ends[lo:lo + BATCH + 1]
                lists = pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), pa.array(ids[some[0]:some[-1]]))
                yield pa.RecordBatch.from_arrays([table["doc_id"][lo:lo + BATCH].combine_chunks(), pa.array(np.full(len(lists), part, dtype=np.int32)), pa.array(start + some[:-1]),
                                                  pa.array(n[lo:lo + BATCH]), lists], names=["doc_id", "part", "start_in_part", "n_tokens", "ids"])
            start += len(ids)
            del table, ids
            released()

    return run


def write(docs: DataFrame, tokenizer_path: str, path: str, end: int = END, specials: bool = False) -> None:
    """Encode the whole text of every row (null: empty), append ``end`` and write the files.

    With ``specials`` the ids are those of the library's ``encode(text, add_special_tokens=False)``, where the string of a special token in a text becomes
    its id; without, as with the library's ``encode_special_tokens`` set, such a string is ordinary text.

    Null doc_ids come first; rows of one doc_id lie together, ordered by text.  An empty table writes files without rows.
    """
    with open(tokenizer_path, "rb") as file:
        model = file.read()
    kind = dict(docs.dtypes)["doc_id"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", F.col("text").cast("string").alias("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    schema = f"doc_id {kind}, part int, start_in_part bigint, n_tokens bigint, ids array<int>"
    small_batches(docs.sparkSession)
    ordered.mapInArrow(_tokenized(model, end, specials), schema).write.options(**LAYOUT).parquet(path)


def _placed(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds ``start``: the sums of the files, one row for each, are added up in order."""
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("_before") + F.col("start_in_part"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens; no ids are read."""
    stored = spark.read.parquet(path)
    return _placed(stored.select("doc_id", "part", "start_in_part", "n_tokens"), stored).select("doc_id", "start", "n_tokens")


def tokens_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of some documents; the filter reaches row groups and pages."""
    return spark.read.parquet(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def _checked(batches):
    import pyarrow as pa

    for batch in batches:
        ids = batch["ids"]
        flat, offsets = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "part", "start_in_part")), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, type=pa.int64())],
                                         names=["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian 32-bit numbers), read from the files."""
    stored = spark.read.parquet(path)
    kind = dict(stored.dtypes)["doc_id"]
    read = stored.select("doc_id", "part", "start_in_part", "ids").mapInArrow(_checked, f"doc_id {kind}, part int, start_in_part bigint, n_tokens bigint, ids_crc32 bigint")
    return _placed(read, stored).select("doc_id", "start", "n_tokens", "ids_crc32")


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
