"""Phrase collocations: counts of frequent phrases from tries, and the phrases whose words keep together.

Texts are cut once into numbers, one for each word of a language, with a break between pieces; these codes are written and read by every later pass.  Phrases grow
level by level.  A phrase can reach ``least`` only if both phrases made by taking off an end word do (Apriori), and only if the
hash bucket it falls into does.  The first is looked up in a bitmap of fixed size, the second in bucket sums that Spark groups; neither can lose a frequent phrase.
The phrases seen that pass both are the candidates.  They are dealt by hash into tries of at most ``shard`` phrases; each is a double array over the bytes of its
own word numbers, broadcast for one pass: all text positions start at the root, every level moves the positions that still match, and
the states that accept are counted by bincount.  Tasks emit their counts, a grouping adds them up.

Passes read codes, not texts; a trie and a bitmap have a set size whatever the table's, more candidates make more passes.

* Null texts are empty, a null language is ``und``; texts without a word count nothing.  Very long texts are read in windows.
* Repeated rows count again; ties are ordered by phrase, so the result is the same on every run.  An empty table gives no phrases.
* Two words with one 64-bit code would mix their counts: codes that stand for different words in different tasks are found, and all codes are made anew by another seed.
* Columns other than ``text`` and the language are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tablewarden.llm.common import mix, slices, word_hashes, written
from tablewarden.llm.words import small_batches

LEAST, LONGEST, COVERED = 10, 3, 50        # occurrences of a phrase, words in it, per cent that a longer phrase must hold to replace it
SHARD = 1 << 20                            # phrases in a trie
BITS = 27                                  # a bitmap has 2 ** BITS bits (16 MB)
BUCKETS = 40                               # bits of a bucket number
WINDOW = 1 << 18                           # codes looked at together
HELD = 2 << 20                             # phrase keys held before a task emits them; of words and phrases a quarter
DEAL = 2 << 20                             # words of the table for each part that bucket sums are dealt into
SALTS, FINALS = 8, 16                      # tasks that a frequent word is dealt over, and that rank a language's phrases first
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ENDS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\x0b\x0c\r", dtype=np.uint8))
_SEPARATES = _ENDS | np.isin(np.arange(256), np.frombuffer(b" \t", dtype=np.uint8))
ALONE = "und"


def _lang_code(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8, key=seed.to_bytes(4, "little")).digest(), "little")


def _words(blob: bytes, limit: int = 4 << 20):
    """Hash, first byte and end byte of all words, in runs of about ``limit`` bytes that end at a separator."""
    data = np.frombuffer(blob, dtype=np.uint8)
    gaps = np.flatnonzero(_SEPARATES[data])
    found, lo = [], 0
    while lo < len(blob):
        k = int(np.searchsorted(gaps, lo + limit))
        hi = int(gaps[k]) + 1 if k < len(gaps) else len(blob)
        hashes, _, starts, ends = word_hashes([blob[lo:hi]], _SEPARATES)
        found.append((hashes, starts + lo, ends + lo))
        lo = hi
    return [np.concatenate(x) for x in zip(*found)] if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _coded(seed: int):
    """Rows (lang, word, code, n) of the words that a task meets, and rows (codes) of its texts, a zero before every piece."""
    import pyarrow as pa

    names = ["lang", "word", "code", "n", "codes"]

    def emitted(langs, words, codes, counts):
        n = len(codes)
        return pa.RecordBatch.from_arrays([langs, words, pa.array(codes.view(np.int64)), pa.array(counts), pa.nulls(n, pa.binary())], names=names)

    def merged(held):
        codes = np.concatenate([h[2] for h in held])
        unique, first, where = np.unique(codes, return_index=True, return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([h[3] for h in held])).astype(np.int64)
        take = pa.array(first)
        return [pa.concat_arrays([h[k] for h in held]).take(take) for k in (0, 1)] + [unique, counts]

    def run(batches):
        held, size, seeds = [], 0, {}
        for table in slices(batches, 1 << 20):
            langs = table["lang"].to_pylist()
            texts = [(t or "").encode().lower() for t in table["text"].to_pylist()]
            blob = b"\n".join(texts)
            begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
            hashes, starts, ends = _words(blob)
            if not len(starts):
                continue
            owner = np.searchsorted(begins, starts, side="right") - 1
            for lang in set(langs) - set(seeds):
                seeds[lang] = _lang_code(lang, seed)
            with np.errstate(over="ignore"):
                codes = np.maximum(mix(hashes + np.array([seeds[x] for x in langs], dtype=np.uint64)[owner]), np.uint64(1))
            piece = np.searchsorted(np.flatnonzero(_ENDS[np.frombuffer(blob, dtype=np.uint8)]), starts)
            fresh = np.diff(piece, prepend=-1) > 0
            places = np.arange(len(codes)) + np.cumsum(fresh)
            line = np.zeros(len(codes) + int(fresh.sum()), dtype=np.uint64)
            line[places] = codes
            first = np.flatnonzero(np.diff(owner, prepend=-1))                   # each document's first word, with the zero before it
            offsets = np.append(places[first] - 1, len(line)).astype(np.int32) * 8
            rows = len(first)
            yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.string()), pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()),
                                              pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(line)])], names=names)
            unique, at, counts = np.unique(codes, return_index=True, return_counts=True)
            words = pa.array([blob[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())], type=pa.binary()).cast(pa.string())
            held.append([pa.array([langs[k] for k in owner[at].tolist()], type=pa.string()), words, unique, counts.astype(np.int64)])
            size += len(unique)
            if size > HELD // 4:
                held = [merged(held)]
                size = len(held[0][2])
                if size > HELD // 8:
                    yield emitted(*held[0])
                    held, size = [], 0
        if held:
            yield emitted(*merged(held))

    return run


def codes_of(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """The written codes of all texts, and the words (code, lang, word, f), one row each."""
    small_batches(docs.sparkSession)
    read = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(ALONE)).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    for seed in range(4):
        coded = written(read.mapInArrow(_coded(seed), "lang string, word string, code bigint, n bigint, codes binary"), "phrase-codes", compression="zstd")
        words = written(coded.where(F.col("code").isNotNull()).groupBy("code", "lang", "word").agg(F.sum("n").alias("f")), "phrase-words", compression="zstd")
        if words.groupBy("code").count().where("count > 1").isEmpty():
            return coded.where(F.col("codes").isNotNull()).select("codes"), words
    raise ValueError("different words keep one code under four seeds")


def bitmap(keys: DataFrame, name: str) -> np.ndarray:
    """A bitmap of 2 ** BITS bits with the bits of all values of a column; at most 2 ** (BITS - 6) numbers come to the driver."""
    bit = F.col(name).bitwiseAND(F.lit((1 << BITS) - 1))
    word = keys.select(F.shiftright(bit, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, CAST(`{name}` & 63 AS INT))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    out[word["at"].to_numpy()] = word["bits"].to_numpy()
    return out.view(np.uint64)


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64((1 << BITS) - 1)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def joined_key(key: np.ndarray, code: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(key * _ODD + code)


def _windows(batches, length: int):
    """The codes of the batches in windows; each but the last repeats its last ``length`` - 1 codes at the start of the next."""
    for batch in batches:
        held = batch["codes"]
        at = np.frombuffer(held.buffers()[1], dtype=np.int32)[held.offset:held.offset + len(held) + 1]
        codes = np.frombuffer(held.buffers()[2], dtype=np.uint64)[at[0] // 8:at[-1] // 8] if len(held) and at[-1] > at[0] else np.zeros(0, np.uint64)
        for lo in range(0, len(codes), WINDOW):
            yield codes[lo:lo + WINDOW + length - 1]


def _alive(codes: np.ndarray, length: int, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of phrases of ``length`` words whose two parts of one word less have their bit, and the phrases' keys."""
    key, whole = codes, codes != 0
    for j in range(1, length - 1):
        key, whole = joined_key(key[:-1], codes[j:]), whole[:-1] & (codes[j:] != 0)
    alive = np.flatnonzero(whole)
    alive = alive[_has(shorter, key[alive])]
    mark = np.zeros(len(key) + 1, dtype=bool)
    mark[alive] = True
    at = alive[mark[alive + 1]]
    return at, joined_key(key[at], codes[at + length - 1])


def bucket_sums(coded: DataFrame, length: int, shorter, least: int, parts: int) -> DataFrame:
    """The hash buckets in which phrases with frequent parts fall ``least`` times or more.

    Tasks emit sorted runs of buckets and counts as bytes, cut into ``parts`` (a power of two) equal ranges of the hash; each range is added up by itself.
    """
    edges = np.arange(1, parts, dtype=np.uint64) << np.uint64(BUCKETS - (parts.bit_length() - 1))

    def run(batches):
        import pyarrow as pa

        def emitted(held):
            buckets, counts = np.unique(np.concatenate(held), return_counts=True)
            counts = counts.astype(np.uint32)
            cuts = [0, *np.searchsorted(buckets, edges).tolist(), len(buckets)]
            rows = [(k, buckets[a:b].tobytes(), counts[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int32()), *(pa.array([r[k] for r in rows], type=pa.binary()) for k in (1, 2))], names=["part", "buckets", "counts"])

        held, size = [], 0
        for codes in _windows(batches, length):
            held.append(_alive(codes, length, shorter.value)[1] >> np.uint64(64 - BUCKETS))
            size += len(held[-1])
            if size > HELD:
                yield from emitted(held)
                held, size = [], 0
        if held:
            yield from emitted(held)

    def added(table):
        import pyarrow as pa

        read = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), dtype=kind) for x in table[name]])
        buckets, counts = read("buckets", np.uint64), read("counts", np.uint32)
        order = np.argsort(buckets, kind="stable")
        buckets = buckets[order]
        first = np.flatnonzero(np.diff(buckets, prepend=~buckets[:1]))
        sums = np.add.reduceat(counts[order].astype(np.int64), first)
        return pa.table({"bucket": buckets[first[sums >= least]].view(np.int64)})

    return coded.mapInArrow(run, "part int, buckets binary, counts binary").groupBy("part").applyInArrow(added, "bucket bigint")


def _different(rows: np.ndarray) -> np.ndarray:
    """The different rows of a matrix."""
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[fresh]


def candidates(coded: DataFrame, length: int, shorter, buckets: DataFrame, parts: int) -> DataFrame:
    """The different phrases w1, w2 … (codes) with frequent parts that fall into one of the buckets.

    Tasks emit their different phrases as bytes, cut into ``parts`` (a power of two) ranges of the bucket number, and each range is made different by itself.
    """
    spark = coded.sparkSession
    bits = spark.sparkContext.broadcast(bitmap(buckets, "bucket"))
    names = ["bucket", *(f"w{k + 1}" for k in range(length))]
    shift = np.uint64(BUCKETS - (parts.bit_length() - 1))

    def run(batches):
        import pyarrow as pa

        def emitted(held):
            rows = _different(np.concatenate(held))
            part = (rows[:, 0] >> shift).astype(np.int64)                 # rows are sorted by bucket
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(starts[1:], len(rows))
            return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array([rows[a:b].tobytes() for a, b in zip(starts, ends)], type=pa.binary())], names=["part", "rows"])

        held, size = [], 0
        for codes in _windows(batches, length):
            at, keys = _alive(codes, length, shorter.value)
            bucket = keys >> np.uint64(64 - BUCKETS)
            kept = _has(bits.value, bucket)
            at = at[kept]
            held.append(_different(np.stack([bucket[kept], *(codes[at + k] for k in range(length))], axis=1)))
            size += len(held[-1])
            if size > HELD // 4:
                held = [_different(np.concatenate(held))]
                size = len(held[0])
                if size > HELD // 8:
                    yield emitted(held)
                    held, size = [], 0
        if size:
            yield emitted(held)

    def whole(table):
        import pyarrow as pa

        rows = _different(np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64).reshape(-1, length + 1) for x in table["rows"]]))
        return pa.table([pa.array(np.ascontiguousarray(rows[:, k]).view(np.int64)) for k in range(length + 1)], names=names)

    seen = coded.mapInArrow(run, "part int, rows binary").groupBy("part").applyInArrow(whole, ", ".join(f"{n} bigint" for n in names))
    return seen.join(buckets, "bucket", "left_semi").drop("bucket")


class Trie:
    """A double array over the bytes of word numbers: from state s, byte b leads to state base[s] + b if check of that is s."""

    WIDE, ROUNDS = 24, 12

    def __init__(self, phrases: np.ndarray):
        """``phrases``: different rows of word codes."""
        self.words = np.unique(phrases)
        numbers = np.searchsorted(self.words, phrases)
        self.bytes = max(1, (max(len(self.words) - 1, 1).bit_length() + 7) // 8)
        order = np.lexsort(numbers.T[::-1])
        self.phrases, numbers = phrases[order], numbers[order]
        digits = np.stack([(numbers[:, k] >> (8 * d)) & 255 for k in range(numbers.shape[1]) for d in reversed(range(self.bytes))], axis=1)
        n = len(digits)
        self._rng = np.random.default_rng(0)
        self._used = np.zeros(2 * n + 1024, dtype=bool)
        self._used[:256] = True
        self.base, self.check = np.zeros(len(self._used), np.int32), np.full(len(self._used), -1, np.int32)
        node, slots, change = np.zeros(n, dtype=np.int64), np.zeros(1, dtype=np.int64), np.zeros(n, dtype=bool)
        change[0] = True
        for level in range(digits.shape[1]):
            change[1:] |= digits[1:, level] != digits[:-1, level]
            first = np.flatnonzero(change)
            parent, byte = node[first], digits[first, level]
            counts = np.bincount(parent, minlength=len(slots))
            base = self._placed(counts, byte)
            where = base[parent] + byte
            self.base[slots] = base
            self.check[where] = slots[parent]
            node, slots = np.cumsum(change) - 1, where
        self.accepts = slots                                     # of the phrases, in order
        top = int(slots.max()) + 1
        top = max(top, int(np.flatnonzero(self.check >= 0).max()) + 1)
        self.base, self.check = self.base[:top], np.append(self.check[:top], np.full(int(self.base.max()) + 256, -1, np.int32))
        del self._used, self._rng

    def _grown(self, size: int) -> None:
        if size > len(self._used):
            more = max(size, len(self._used) * 5 // 4) - len(self._used)
            self._used = np.append(self._used, np.zeros(more, dtype=bool))
            self.base, self.check = np.append(self.base, np.zeros(more, np.int32)), np.append(self.check, np.full(more, -1, np.int32))

    def _beside(self, which: np.ndarray, base: np.ndarray, firsts: np.ndarray, counts: np.ndarray, byte: np.ndarray) -> None:
        """Rows of states one beside the other behind all that is used."""
        if not len(which):
            return
        low, high = byte[firsts[which]], byte[firsts[which] + counts[which] - 1]
        span = high - low + 1
        end = int(np.flatnonzero(self._used).max()) + 1
        starts = end + np.cumsum(span) - span
        self._grown(end + int(span.sum()) + 512)
        base[which] = starts - low
        child = _ranges(firsts[which], counts[which])
        self._used[np.repeat(base[which], counts[which]) + byte[child]] = True

    def _placed(self, counts: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """A base for every parent, so that no two children share a state; ``byte`` lists the children parent by parent, ascending."""
        firsts, base = np.cumsum(counts) - counts, np.zeros(len(counts), dtype=np.int64)
        self._beside(np.flatnonzero(counts >= self.WIDE), base, firsts, counts, byte)
        self._grown(int(self._used.sum() + len(byte)) * 2 + 1024)
        pending = np.flatnonzero((counts > 0) & (counts < self.WIDE))
        owner = np.zeros(len(self._used), dtype=np.int32)
        for _ in range(self.ROUNDS):
            if not len(pending):
                break
            tried = self._rng.integers(0, len(self._used) - 256, len(pending))
            n, child = counts[pending], _ranges(firsts[pending], counts[pending])
            mine = np.repeat(np.arange(len(pending), dtype=np.int32), n)
            where = np.repeat(tried, n) + byte[child]
            owner[where] = mine
            free = np.logical_and.reduceat(~self._used[where] & (owner[where] == mine), np.cumsum(n) - n)
            base[pending[free]] = tried[free]
            self._used[where[np.repeat(free, n)]] = True
            pending = pending[~free]
        self._beside(pending, base, firsts, counts, byte)
        return base

    def arrays(self) -> dict:
        """What tasks need: plain arrays, so that they unpickle without this module."""
        return {k: getattr(self, k) for k in ("words", "bytes", "base", "check", "accepts", "phrases")}


def accepting(trie: dict, codes: np.ndarray) -> np.ndarray:
    """The accepting states of all positions at which a phrase of the trie begins."""
    words, base, check, length = trie["words"], trie["base"], trie["check"], trie["phrases"].shape[1]
    number = np.minimum(np.searchsorted(words, codes), len(words) - 1)
    known = words[number] == codes
    whole = known[:max(len(codes) - length + 1, 0)].copy()
    for j in range(1, length):
        whole &= known[j:j + len(whole)]
    at = np.flatnonzero(whole)
    state = np.zeros(len(at), dtype=np.int64)
    for j in range(length):
        for d in reversed(range(trie["bytes"])):
            to = base[state] + ((number[at + j] >> (8 * d)) & 255)
            fits = check[to] == state
            at, state = at[fits], to[fits]
    return state


def _ranges(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1 … (``counts`` numbers) for each of ``firsts``."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(firsts - (ends - counts), counts)


def _whole(trie, length: int):
    """Adds up the counts of one range of a trie's phrases and gives them with their words."""
    names = [f"w{k + 1}" for k in range(length)] + ["a"]

    def whole(table):
        import pyarrow as pa

        read = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), dtype=kind) for x in table[name]])
        at, n = read("at", np.uint32), read("n", np.int64)
        low = int(at.min())
        sums = np.zeros(int(at.max()) - low + 1, dtype=np.int64)
        np.add.at(sums, at - np.uint32(low), n)
        some = np.flatnonzero(sums)
        rows = trie.value["phrases"][some + low]
        return pa.table([*(pa.array(np.ascontiguousarray(rows[:, j]).view(np.int64)) for j in range(length)), pa.array(sums[some])], names=names)

    return whole


def trie_counts(coded: DataFrame, length: int, phrases: DataFrame, shard: int, parts: int) -> DataFrame:
    """Occurrences (w1, w2 …, a) of the candidate phrases: one broadcast trie and one pass for each ``shard`` of them.

    Tasks emit the counts of their texts as bytes, cut into ``parts`` ranges of the trie's phrases; each range is added up by itself.
    """
    spark = coded.sparkSession
    names = [f"w{k + 1}" for k in range(length)]
    schema = ", ".join([*(f"{n} bigint" for n in names), "a bigint"])
    tries = max(1, -(-phrases.count() * 9 // 8 // shard))
    counted = []
    for k in range(tries):
        mine = phrases.where(F.pmod(F.xxhash64(*names), F.lit(tries)) == k).toArrow()
        if not mine.num_rows:
            continue
        trie = spark.sparkContext.broadcast(Trie(np.stack([mine[n].to_numpy().view(np.uint64) for n in names], axis=1)).arrays())
        wide = -(-mine.num_rows // parts)

        def run(batches, trie=trie, wide=wide):
            import pyarrow as pa

            known, sums, held, size = trie.value, None, [], 0

            def added(sums):
                more = np.bincount(np.concatenate(held), minlength=len(known["base"]))
                return more if sums is None else sums + more

            for codes in _windows(batches, length):
                held.append(accepting(known, codes))
                size += len(held[-1])
                if size > HELD:
                    sums, held, size = added(sums), [], 0
            if held:
                sums = added(sums)
            if sums is not None:
                each = sums[known["accepts"]]
                at = np.flatnonzero(each).astype(np.uint32)
                cuts = np.append(0, np.searchsorted(at, np.arange(wide, len(each) + wide, wide))).tolist()
                rows = [(p, at[a:b].tobytes(), each[at[a:b]].tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=pa.int32()), *(pa.array([r[j] for r in rows], type=pa.binary()) for j in (1, 2))], names=["part", "at", "n"])

        counted.append(written(coded.mapInArrow(run, "part int, at binary, n binary").groupBy("part").applyInArrow(_whole(trie, length), schema), f"phrase-counts-{length}"))
        trie.destroy()
    return reduce(DataFrame.unionByName, counted) if counted else spark.createDataFrame([], schema)


def frequent_phrases(coded: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST, shard: int = SHARD) -> dict[int, DataFrame]:
    """By length from 2 on: the phrases (w1, w2 …, a) that occur ``least`` times or more."""
    sc = coded.sparkSession.sparkContext
    out: dict[int, DataFrame] = {}
    shorter = words.where(F.col("f") >= least).select(F.col("code").alias("key"))
    total = words.agg(F.sum("f")).first()[0] or 0
    parts = 1 << max(4, (total // DEAL).bit_length())
    for length in range(2, longest + 1):
        bits = sc.broadcast(bitmap(shorter, "key"))
        buckets = written(bucket_sums(coded, length, bits, least, parts), f"phrase-buckets-{length}")
        phrases = written(candidates(coded, length, bits, buckets, parts), f"phrase-candidates-{length}")
        out[length] = trie_counts(coded, length, phrases, shard, parts).where(F.col("a") >= least)
        shorter = out[length].mapInArrow(_keys(length), "key bigint")
    return out


def _keys(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            codes = [batch[f"w{k + 1}"].to_numpy().view(np.uint64) for k in range(length)]
            yield pa.RecordBatch.from_arrays([pa.array(reduce(joined_key, codes).view(np.int64))], names=["key"])

    return run


def _counted(phrases: DataFrame, first: int, last: int, words: DataFrame, found: dict[int, DataFrame], name: str) -> DataFrame:
    """Adds the count ``name`` of the part from the ``first`` to the ``last`` word; of single words also the word itself, as ``name`` + "_word"."""
    names = [f"w{k}" for k in range(first, last + 1)]
    if len(names) > 1:
        part = found[len(names)].select(*[F.col(f"w{k + 1}").alias(n) for k, n in enumerate(names)], F.col("a").alias(name))
        return phrases.join(part, names)
    # a frequent word stands in many phrases: it is dealt over several tasks
    salted = words.select(F.col("code").alias(names[0]), F.col("f").alias(name), F.col("word").alias(f"{name}_word"), F.col("lang").alias(f"{name}_lang"),
                          F.explode(F.array(*[F.lit(k) for k in range(SALTS)])).alias("_salt"))
    codes = [c for c in phrases.columns if c[0] == "w" and c[1:].isdigit()]
    return phrases.withColumn("_salt", F.pmod(F.xxhash64(*codes), F.lit(SALTS)).cast("int")).join(salted, [names[0], "_salt"]).drop("_salt")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)), exact: the products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right)).cast("bigint")


def scored(words: DataFrame, found: dict[int, DataFrame], least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """lang, phrase, a, l, r, score of all frequent phrases that no longer one replaces, by their lowest-scoring cut (of equals the first)."""
    often = words.where(F.col("f") >= least)
    out = []
    for length, phrases in found.items():
        rows = phrases
        for k in range(1, length + 1):
            rows = _counted(rows, k, k, often, found, f"f{k}")
        cuts = []
        for k in range(1, length):
            left, right = F.col("f1"), F.col(f"f{length}")
            if k > 1:
                rows, left = _counted(rows, 1, k, often, found, f"left{k}"), F.col(f"left{k}")
            if k < length - 1:
                rows, right = _counted(rows, k + 1, length, often, found, f"right{k}"), F.col(f"right{k}")
            cuts.append(F.struct(_score(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
        lowest = cuts[0] if len(cuts) == 1 else F.array_min(F.array(*cuts))
        names = [f"w{k + 1}" for k in range(length)]
        inside = [longer.select(*[F.col(f"w{i + k + 1}").alias(f"w{k + 1}") for k in range(length)], F.col("a").alias("_longer"))
                  for m, longer in found.items() if m > length for i in range(m - length + 1)]
        if inside:
            most = reduce(DataFrame.unionByName, inside).groupBy(*names).agg(F.max("_longer").alias("_longer"))
            rows = rows.join(most, names, "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < covered * F.col("a")))
        out.append(rows.select(F.col("f1_lang").alias("lang"), F.concat_ws(" ", *[f"f{k}_word" for k in range(1, length + 1)]).alias("phrase"), "a", lowest.alias("_cut"))
                   .select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score"))
    return reduce(DataFrame.unionByName, out)


def collocations(docs: DataFrame, top: int, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, shard: int = SHARD) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a (its occurrences), l and r (those of its two parts), n (words of the language), score."""
    coded, words = codes_of(docs, text, lang)
    found = frequent_phrases(coded, words, least, longest, shard)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(FINALS))).orderBy(*order))
    some = scored(words, found, least, covered).withColumn("rank", first).where(F.col("rank") <= top)      # so a language's last task reads few rows
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
