"""Benchmark decontamination under edit distance.

A passage leaks where some window of a document turns into it by at most ``PERCENT`` of its words inserted, deleted or replaced.  The CGK random walk
embeds a sequence so that edit distance becomes Hamming distance: step j of the walk copies the current word and moves on only if a random function
of (j, word) says so, and after an edit two walks fall into step again.  Keys sample positions of that embedding (bit-sampling LSH); every
repetition has a walk of its own.  Walks start at every word of an item and of a document, so a key that meets gives the offset of an item-sized
window, and the window is then aligned exactly.

With k edits an item of n words holds an untouched run of at least (n-k)/(k+1) words; the walks that start in it and stay inside meet.  Measured recall
is in the tests.  Items are searched in blocks of ``BLOCK``, so what goes to the tasks is bounded however many there are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import mix, slices, word_hashes

PERCENT = 20                  # edited words per hundred words of an item
STEPS = 6                     # of a walk
REPEATS = 4                   # independent walks
SAMPLED = 4                   # positions of an embedding in a key, first and last among them
SPAN = 3                      # words that a walk must see at least to make a key of an item
BLOCK = 5_000                 # items searched at once

_SPACE = np.zeros(256, dtype=bool)
_SPACE[32] = True
#: ASCII letters in lower case and digits stay, other ASCII separates, bytes above stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_RNG = np.random.default_rng(77)
_SEED = _RNG.integers(1, 1 << 62, REPEATS, dtype=np.uint64)
_AT = [sorted({0, STEPS, *(_RNG.choice(np.arange(1, STEPS), SAMPLED - 2, replace=False))}) for _ in range(REPEATS)]


def walks(words: np.ndarray, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and last position of the walk from each word; past the end lie zeros."""
    n = len(words)
    padded = np.concatenate([words, np.zeros(STEPS + 1, np.uint64)])
    moves = (mix(padded ^ _SEED[repeat]) & np.uint64(0xFF)).astype(np.uint8)
    at = np.arange(n, dtype=np.int64)
    key = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(STEPS + 1):
            if j in _AT[repeat]:
                key = key * np.uint64(0x9E3779B97F4A7C15) + padded[at]
            if j < STEPS:
                at += (moves[at] >> np.uint8(j)) & np.uint8(1)
        return mix(key + np.uint64(repeat)), at


class Items:
    """Words of the items and the sorted keys of their walks; items too short for a walk have their whole sequence as key."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        hashes, owner, _, _ = word_hashes([t.translate(_PLAIN) for _, t in rows], _SPACE)
        self.ids = [i for i, _ in rows]
        self.words = np.split(hashes, np.cumsum(np.bincount(owner, minlength=len(rows)))[:-1]) if rows else []
        self.walks, self.short = [], {}
        for r in range(REPEATS):
            keys, item, offset = [], [], []
            for i, w in enumerate(self.words):
                key, at = walks(w, r)
                good = np.flatnonzero((at < len(w)) & (at - np.arange(len(w)) >= SPAN - 1))
                keys.append(key[good])
                item.append(np.full(len(good), i))
                offset.append(good)
            self.walks.append(self._table(keys, item, offset))
        for i, w in enumerate(self.words):
            if 0 < len(w) <= STEPS:
                self.short.setdefault(len(w), []).append(i)
        self.short = {n: self._table([run_keys(self.words[i], n) for i in of], [np.array([i]) for i in of], [np.array([0])] * len(of)) for n, of in self.short.items()}

    @staticmethod
    def _table(keys, item, offset):
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        seen = np.zeros(1 << 20, dtype=bool)
        seen[keys >> np.uint64(44)] = True
        cat = lambda x: (np.concatenate(x) if x else np.zeros(0, np.int64)).astype(np.int64)[order]
        return keys[order], cat(item), cat(offset), seen


def run_keys(words: np.ndarray, n: int) -> np.ndarray:
    """Key of each run of n words."""
    m = max(0, len(words) - n + 1)
    key = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            key = key * np.uint64(0x9E3779B97F4A7C15) + words[k:k + m]
    return mix(key + np.uint64(n))


def _met(keys: np.ndarray, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in keys, item, offset in the item) of every key that an item has."""
    known, item, offset, seen = table
    maybe = np.flatnonzero(seen[keys >> np.uint64(44)])
    lo, hi = np.searchsorted(known, keys[maybe], "left"), np.searchsorted(known, keys[maybe], "right")
    many = hi - lo
    at = np.repeat(maybe, many)
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    return at, item[inside], offset[inside]


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of the item to any stretch of each window, and where the first such stretch ends (rows are windows)."""
    count, width = windows.shape
    steps = np.arange(width + 1)
    row = np.zeros((count, width + 1), dtype=np.int64)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (windows != word), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row.min(axis=1), row.argmin(axis=1)


def search(items: Items, texts: list[bytes], percent: int = PERCENT) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, first byte, end byte): the best stretch of each item in each text it leaks into."""
    words, owner, begin, end = word_hashes([t.translate(_PLAIN) for t in texts], _SPACE)
    if not len(words) or not items.ids:
        return []
    found = [_met(walks(words, r)[0], items.walks[r]) for r in range(REPEATS)] + [_met(run_keys(words, n), t) for n, t in items.short.items()]
    at, item, offset = (np.concatenate([f[k] for f in found]) for k in range(3))
    first = np.searchsorted(owner, np.arange(len(texts)), "left")
    last = np.searchsorted(owner, np.arange(len(texts)), "right")
    pad = max((len(w) for w in items.words), default=0) * 2 + 2
    padded = np.concatenate([np.zeros(pad, np.uint64), words, np.zeros(pad, np.uint64)])
    whose = np.concatenate([np.full(pad, -1), owner, np.full(pad, -1)])
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i in np.unique(item):
        w = items.words[i]
        n, allowed = len(w), len(w) * percent // 100
        mine = item == i
        starts, text = np.divmod(np.unique((at[mine] - offset[mine]) * len(texts) + owner[at[mine]]), len(texts))
        if allowed > 1:                                   # windows whose starts nearly agree align alike: take one of each stretch of ``allowed``
            _, pick = np.unique(np.stack([text, starts // allowed]), axis=1, return_index=True)
            starts, text = starts[pick], text[pick]
        width = n + 4 * allowed
        for lo in range(0, len(starts), 4096):
            s, t = starts[lo:lo + 4096], text[lo:lo + 4096]
            cells = (s - 2 * allowed)[:, None] + np.arange(width) + pad
            inside = (cells >= 0) & (cells < len(padded))
            cells = np.clip(cells, 0, len(padded) - 1)
            windows = np.where(inside & (whose[cells] == t[:, None]), padded[cells], np.uint64(0))
            likely = np.isin(windows, w).sum(axis=1) >= n - allowed
            s, t, windows = s[likely], t[likely], windows[likely]
            if not len(s):
                continue
            distance, stop = align(w, windows)
            for k in np.flatnonzero(distance <= allowed):
                _, back = align(w[::-1], windows[k:k + 1, :stop[k]][:, ::-1])
                a, b = s[k] - 2 * allowed + stop[k] - back[0], s[k] - 2 * allowed + stop[k] - 1
                a, b = max(a, first[t[k]]), min(b, last[t[k]] - 1)
                hit = (int(distance[k]), int(begin[a]), int(end[b]))
                key = (int(t[k]), int(i))
                out[key] = min(out.get(key, hit), hit)
    return [(t, i, *hit) for (t, i), hit in sorted(out.items())]


def _leaks(items: Items, percent: int):
    import pyarrow as pa

    def run(batches):
        for t in slices(batches, 2 << 20):
            hits = search(items, [x or b"" for x in t["text"].cast(pa.large_binary()).to_pylist()], percent)
            if hits:
                text, item, distance, begin, end = zip(*hits)
                yield pa.RecordBatch.from_arrays([t["doc_id"].take(pa.array(text)).combine_chunks(), pa.array([items.ids[i] for i in item], type=pa.int64()), pa.array(
                    [len(items.words[i]) for i in item], type=pa.int64()), *(pa.array(x, type=pa.int64()) for x in (distance, begin, end))],
                    names=["doc_id", "item_id", "n_words", "distance", "begin", "end"])

    return run


def _blocks(benchmark: DataFrame, block: int) -> list[Items]:
    """The different items with an id and a text, in blocks of about ``block``."""
    wanted = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n = max(1, -(-wanted.count() // block))
    for b in range(n):
        part = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        yield Items([(r["item_id"], r["text"].encode()) for r in part])


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_words, distance, begin, end): the best stretch, in UTF-8 bytes of the text, of each item in each document it leaks into.

    Words are ASCII-lower-cased runs of letters, digits and non-ASCII characters.  Null texts, items without words and items with a null id or text
    match nothing; an item leaks if distance <= percent x n_words / 100, so items below five words must occur as they are.  Documents with
    a null or repeated doc_id are searched like others.  Empty tables give an empty result.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id bigint, n_words bigint, distance bigint, begin bigint, end bigint"
    return reduce(DataFrame.unionByName, [rows.mapInArrow(_leaks(items, percent), schema) for items in _blocks(benchmark, block)])


def _clean(items: Items, percent: int):
    import pyarrow as pa

    def run(batches):
        for t in slices(batches, 2 << 20, "_text"):
            hits = search(items, [x or b"" for x in t["_text"].cast(pa.large_binary()).to_pylist()], percent)
            free = np.ones(t.num_rows, dtype=bool)
            free[[h[0] for h in hits]] = False
            yield from t.filter(pa.array(free)).to_batches()

    return run


def keep(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("_text"))
    for items in _blocks(benchmark, block):
        rows = rows.mapInArrow(_clean(items, percent), rows.schema)
    return rows.select("_row.*")
