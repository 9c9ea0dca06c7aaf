"""Byte-level BPE by ranks: encoding and decoding.

The pattern cuts a text into pieces.  Each different piece of a chunk of documents is a string with one character a byte, beside an array of the tokens
that occur in it, by rank; a higher-order fold over that array merges: it replaces the pair that a token is made of by the token's character, all
occurrences at once, from the left.  Pairs and characters are literals.  Documents are put together from their pieces.  Decoding concatenates
the binary pieces of the ids.

Why ascending ranks give what always merging the lowest pair gives: ``Ranks`` makes sure that every token, alone, arises by merges of ranks that never
fall.  If a text's merge of rank r gave rise to a pair of a token of lower rank s, all merges inside that pair would be those of the token
alone (none crossed its borders), and r would come before s there.  For the same reason a token always arises from the same pair.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import released
from tablewarden.llm.line_rules import let
from tablewarden.llm.words import Lists, piece_rows, streamed

FIRST = 0x100                 # code point of id 0; the surrogates are left out
SURROGATES = 0xD800, 0x800    # where they begin, and how many
START = "struct<text:string,ranks:array<int>>"
CHUNK = 300_000               # pieces in a chunk, about: a stage has two Python workers for each core, and every chunk is whole in memory


def _characters(ids: np.ndarray) -> np.ndarray:
    """Code points that stand for ids."""
    points = ids.astype(np.uint32) + FIRST
    return np.where(points >= SURROGATES[0], points + SURROGATES[1], points).astype("<u4")


def _ids(texts) -> tuple[np.ndarray, np.ndarray]:
    """The ids that the characters of an Arrow array of strings stand for, one after another, and their number in each string."""
    import pyarrow as pa
    import pyarrow.compute as pc

    at = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[at[0]:at[-1]]
    points = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), dtype="<u4")
    ids = np.where(points >= SURROGATES[0], points - SURROGATES[1], points) - FIRST
    return ids.astype(np.int32), pc.utf8_length(texts).cast(pa.int64()).to_numpy(zero_copy_only=False)


class Ranks:
    """A rank file (base64 of a token's bytes, its rank); every single byte must be a token, and every token the merge of two."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int32)

    def pair_ranks(self) -> dict[tuple[int, int], int]:
        """For each pair of tokens whose bytes together are a token: that token's rank, which is its id."""
        halves = ((self.ids.get(t[:k]), self.ids.get(t[k:]), r) for t, r in self.ids.items() for k in range(1, len(t)))
        return {(a, b): r for a, b, r in halves if a is not None and b is not None}

    def halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two tokens that a token arises from; raises if its merges, alone, do not lead to it by ranks that never fall."""
        parts, last = [token[i:i + 1] for i in range(len(token))], -1
        while len(parts) > 2:
            low, i = min((self.ids.get(a + b, len(self.tokens)), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if not last <= low < self.ids[token]:
                break
            parts[i:i + 2], last = [parts[i] + parts[i + 1]], low
        if len(parts) != 2:
            raise ValueError(f"token {self.ids[token]} does not arise from merges of ascending ranks")
        return parts[0], parts[1]

    def literal(self) -> tuple[Column, Column]:
        """For each rank the characters of the pair that it merges, and that of its token, as two literals."""
        letters = _characters(np.arange(len(self.tokens))).tobytes().decode("utf-32-le")
        pairs = ["".join(letters[self.ids[h]] for h in self.halves(t)) if len(t) > 1 else "" for t in self.tokens]
        return F.split(F.lit(",".join(pairs)), ","), F.split(F.lit(",".join(letters)), ",")

    def trie(self) -> tuple[np.ndarray, np.ndarray]:
        """Beginnings of tokens as numbered states: the sorted keys (state * 256 + next byte) of those of three bytes and more, and each state's rank or -1.

        A beginning of two bytes is the state of its value, the k-th key leads to state 65,536 + k.
        """
        keys, ranks = [], np.full(65_536, -1, dtype=np.int32)
        for t in self.ids:
            if len(t) == 2:
                ranks[t[0] * 256 + t[1]] = self.ids[t]
        more, states, size = [], {}, 3
        while level := sorted({t[:size] for t in self.ids if len(t) >= size}):
            before, states = states, {}
            for t in level:
                states[t] = 65_536 + len(keys)
                keys.append((before[t[:-1]] if size > 3 else t[0] * 256 + t[1]) * 256 + t[-1])
                more.append(self.ids.get(t, -1))
            size += 1
        return np.array(keys, dtype=np.int64), np.concatenate([ranks, np.array(more, dtype=np.int32)])


def encoded(start: Column, tables: tuple[Column, Column]) -> Column:
    """The tokens of one piece (``START``: a character for each byte, the ranks of the tokens in it), a character each."""
    return F.aggregate(start["ranks"], start["text"], lambda text, rank: F.replace(text, F.get(tables[0], rank), F.get(tables[1], rank)))


def _starts(byte_ids: np.ndarray, keys: np.ndarray, ranks: np.ndarray):
    """Pieces (an Arrow array of bytes) as what ``encoded`` starts from."""
    points = _characters(byte_ids)
    widths = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    ends_of = np.append(keys, -1)                           # so that a search past the last key finds none

    def inside(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and ranks of the tokens that begin at each byte and end before ``ends``."""
        at = np.flatnonzero(np.arange(len(data)) + 1 < ends)
        state, size, places, found = data[at].astype(np.int64) * 256 + data[at + 1], 2, [], []
        while len(at):
            hit = ranks[state] >= 0
            places.append(at[hit])
            found.append(ranks[state[hit]])
            on = at + size < ends[at]
            at, state = at[on], state[on]
            key = state * 256 + data[at + size]
            k = np.searchsorted(keys, key)
            on = ends_of[k] == key
            at, state, size = at[on], k[on] + 65_536, size + 1
        return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int32), *found])

    def make(pieces):
        import pyarrow as pa

        at = np.frombuffer(pieces.buffers()[1], dtype=np.int32)[pieces.offset:pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int32)
        data = np.frombuffer(pieces.buffers()[2] or b"", dtype=np.uint8)[at[0]:at[-1]]
        owner = np.repeat(np.arange(len(pieces)), np.diff(at))
        places, found = inside(data, (at[1:] - at[0])[owner])
        each = np.unique((owner[places] << 32) | found)      # by piece, then by rank, once
        counts = np.bincount(each >> 32, minlength=len(pieces))
        wide = np.concatenate([[0], np.cumsum(widths[data])])[at - at[0]].astype(np.int32)
        spelled = points[data].tobytes().decode("utf-32-le").encode()
        text = pa.StringArray.from_buffers(len(pieces), pa.py_buffer(wide.tobytes()), pa.py_buffer(spelled))
        listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array((each & 0xFFFFFFFF).astype(np.int32)))
        return pa.StructArray.from_arrays([text, listed], names=["text", "ranks"])

    return make


def _documents(keys: list[str], tokens: list[bytes], digests: bool):
    """Documents put together from the ids of their pieces; as digests, also decoded again."""
    import pyarrow as pa

    def run(batches):
        lists, spelled, decoded = Lists(), [], []
        for first, part in streamed(batches, "ids"):
            if first is not None:
                flat, lengths = _ids(part)
                if digests:
                    listed, ends = flat.tolist(), [0, *np.cumsum(lengths).tolist()]
                    if first == 0:
                        spelled, decoded = [], []
                    spelled += [",".join(map(str, listed[a:b])) for a, b in zip(ends, ends[1:])]
                    decoded += [b"".join([tokens[t] for t in listed[a:b]]) for a, b in zip(ends, ends[1:])]
                lists.add(first, flat if not digests else np.zeros(0), lengths)
                continue
            head = [part[k] for k in keys]
            codes = [np.frombuffer(c, dtype=np.int32) for c in part["codes"].to_pylist()]
            if digests:
                counts = [int(lists.lengths[c].sum()) for c in codes]
                listed_codes = [c.tolist() for c in codes]
                ids_sha = [hashlib.sha256(",".join([spelled[k] for k in c]).encode()).hexdigest() for c in listed_codes]
                text_sha = [hashlib.sha256(b"".join([decoded[k] for k in c])).hexdigest() for c in listed_codes]
                yield pa.RecordBatch.from_arrays([*head, pa.array(counts, type=pa.int64()), pa.array(ids_sha, type=pa.string()), pa.array(text_sha, type=pa.string())],
                                                 names=[*keys, "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                yield pa.RecordBatch.from_arrays([*head, lists.of(codes)], names=[*keys, "ids"])
            del head, part
            released()

    return run


def _with_ids(docs: DataFrame, keys: list[str], ranks: Ranks, **sizes: int) -> DataFrame:
    rows = piece_rows(docs, keys, **{"chunk": CHUNK} | sizes, derived=("start", START, _starts(ranks.byte_ids, *ranks.trie())))
    return rows.select("slot", *[F.col(f"`{k}`") for k in keys], "codes", F.when(F.col("codes").isNull(), encoded(F.col("start"), ranks.literal())).alias("ids"))


def encode(docs: DataFrame, ranks: Ranks, keys: list[str], **sizes: int) -> DataFrame:
    """``keys`` and ``ids`` (array<int>) of every row's whole ``text``; a null or empty text has no ids.  ``sizes``: chunk, known (see ``words``)."""
    kinds = dict(docs.dtypes)
    return _with_ids(docs, keys, ranks, **sizes).mapInArrow(_documents(keys, [], False), ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "ids array<int>"]))


def decode(ids: Column, ranks: Ranks) -> Column:
    """The bytes of an array of ids: their binary pieces, one after another."""
    pieces = F.split(F.lit(",".join(t.hex() for t in ranks.tokens)), ",")
    return let(pieces, lambda p: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(p, i)), "")))


def round_trip(docs: DataFrame, ranks: Ranks) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the bytes that the ids decode to), once per row."""
    kind = dict(docs.dtypes)["doc_id"]
    return _with_ids(docs, ["doc_id"], ranks).mapInArrow(_documents(["doc_id"], ranks.tokens, True), f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
