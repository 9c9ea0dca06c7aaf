"""Quality classifier by supervised subword embeddings.

A document is the average of learned vectors of its hashed words (with a marker where a word repeats the one before) and character n-grams; a softmax
over two classes reads the average.  Vectors and output weights are learned together by stochastic gradient descent in numpy on at most ``SAMPLE``
labelled documents, whose features are made on the executors, as counts of buckets: at most ``BUCKETS`` numbers a document whatever its length.

For scoring, the average of vectors times the output weights is the average of one number per bucket, so a task needs one small array.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from tablewarden.llm.common import held_out, mix, slices, word_hashes

SAMPLE = 3_000                # labelled documents learned from: those with the smallest hash of their id
BUCKETS = 1 << 15
DIM = 8
EPOCHS, RATE, BATCH = 12, 2.0, 32
NGRAMS = (2, 3, 4)            # lengths in bytes
REPEAT = BUCKETS              # the bucket of a word that repeats the one before it
EMPTY = BUCKETS + 1           # the one feature of a text without words

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each feature and the number of the text it belongs to, in any order."""
    words, owner, _, _ = word_hashes(texts, _SPACE)
    buckets, owners = [(words % np.uint64(BUCKETS)).astype(np.int32)], [owner.astype(np.int32)]
    if len(words) > 1:
        again = np.flatnonzero((words[1:] == words[:-1]) & (owner[1:] == owner[:-1])) + 1
        for _ in range(8):                               # weighs like the character features of a word
            buckets.append(np.full(len(again), REPEAT, np.int32))
            owners.append(owner[again].astype(np.int32))
    none = np.flatnonzero(np.bincount(owner, minlength=len(texts)) == 0)
    buckets.append(np.full(len(none), EMPTY, np.int32))
    owners.append(none.astype(np.int32))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint32)
    of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    code = data.copy()
    for n in range(2, max(NGRAMS) + 1):
        if len(data) < n:
            break
        code = (code[:-1] << np.uint32(8)) | data[n - 1:]
        if n in NGRAMS:
            h = (code * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            inside = of[n - 1:] == of[:len(of) - n + 1]
            buckets.append((h >> np.uint32(17)).astype(np.int32)[inside])
            owners.append(of[:len(of) - n + 1][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def _counted(batches):
    import pyarrow as pa

    for t in slices(batches, 1 << 20):
        texts = [x or b"" for x in t["text"].cast(pa.large_binary()).to_pylist()]
        buckets, owner = features(texts)
        order = np.argsort(owner, kind="stable")
        parts = np.split(buckets[order], np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])
        found = [np.unique(p, return_counts=True) for p in parts]
        yield pa.RecordBatch.from_arrays([t["label"].combine_chunks(), pa.array([k.astype(np.int32).tobytes() for k, _ in found], type=pa.binary()),
                                          pa.array([n.astype(np.float32).tobytes() for _, n in found], type=pa.binary())], names=["label", "buckets", "counts"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """One number per bucket and a bias: their average over a document plus the bias is the log-odds of label 1.

    Without a labelled document, or with labels of one kind, the score is constant.
    """
    named = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    chosen = named.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("label", F.col("text").cast("string").alias("text")).mapInArrow(
        _counted, "label int, buckets binary, counts binary").collect()
    scores = np.zeros(BUCKETS + 2)
    if len({r["label"] for r in rows}) < 2:
        return scores, (5.0 if rows and rows[0]["label"] == 1 else -5.0 if rows else 0.0)
    examples = []
    for r in sorted(rows, key=lambda r: (r["label"], bytes(r["buckets"]), bytes(r["counts"]))):    # any order of tasks learns the same
        counts = np.frombuffer(r["counts"], dtype=np.float32)
        examples.append((np.frombuffer(r["buckets"], dtype=np.int32), counts / counts.sum(), r["label"]))
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 2, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    out[:] = rng.uniform(-0.5, 0.5, (DIM, 2))
    counts = np.bincount([y for _, _, y in examples], minlength=2)
    weight = len(examples) / (2 * counts)                                       # both labels weigh alike
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            idx, share, label = examples[i]
            rate = RATE * (1 - done / steps)
            hidden = share @ vectors[idx]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[label] -= 1
            error *= min(weight[label], 3.0)
            grad = out @ error
            out -= (rate * 0.1) * np.outer(hidden, error)
            bias -= rate * 0.01 * error
            vectors[idx] -= (rate * 20) * share[:, None] * grad
            done += 1
    scores = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64)
    return scores, float(bias[1] - bias[0])


def _scored(weights: np.ndarray, bias: float):
    import pyarrow as pa

    def run(batches):
        for t in slices(batches, 1 << 20, "_text"):
            texts = [x or b"" for x in t["_text"].cast(pa.large_binary()).to_pylist()]
            buckets, owner = features(texts)
            total = np.bincount(owner, weights=weights[buckets], minlength=len(texts))
            mean = total / np.maximum(np.bincount(owner, minlength=len(texts)), 1)
            score = 1 / (1 + np.exp(-np.clip(mean + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([t["_row"].combine_chunks(), pa.array(score)], names=["_row", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float], columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: doc_id) in the struct ``_row``, score (0 to 1, higher: better) and predicted (1 from 0.5 on) of every whole text.

    A null text is scored as an empty one; ids play no part, so null or repeated ones are scored like others.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or ["doc_id"]]).alias("_row"), F.col("text").cast("string").alias("_text"))
    scored = rows.mapInArrow(_scored(*model), T.StructType([rows.schema["_row"], T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that a classifier learned from the labelled ones among them predicts to be good, with all their columns."""
    return score(docs, train(docs, labels), docs.columns).where("predicted = 1").select("_row.*")
