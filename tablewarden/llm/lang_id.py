"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts is the number of n-grams (all lengths in ``NGRAMS``, hashed) that occur in both, divided by the
geometric mean of how many each has.  ``LANDMARKS`` sampled texts a language span a Nyström feature space; kernel ridge regression
in that space gives one scorer for each language against the rest.  A batch of texts is scored by two matrix products.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import held_out, slices

NGRAMS = (1, 2, 3)            # in bytes
WIDTH = 1 << 13               # buckets of n-grams
SAMPLE = 300                  # documents learned from for each language: those with the smallest hash of their id
LANDMARKS = 24                # of these, landmarks
RIDGE = 0.1
SAMPLES, ROWS = 16_000, 1_600  # documents and landmarks of all languages together: with over 53 languages each has fewer, none is left out

_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def presence(texts: list[bytes]) -> np.ndarray:
    """One row of 0 and 1 a text: which buckets of n-grams occur in it, scaled to unit length."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    data = np.frombuffer(b"".join(texts).translate(_LOW), dtype=np.uint8).astype(np.uint32)
    of = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
    code = data
    flat = out.reshape(-1)
    for n in range(1, max(NGRAMS) + 1):
        if len(data) < n:
            break
        if n > 1:
            code = (code[:-1] << np.uint32(8)) | data[n - 1:]
        h = (code + np.uint32(n << 24)) * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        inside = of[n - 1:] == of[:len(of) - n + 1]
        flat[(of[:len(of) - n + 1] * WIDTH + (h >> np.uint32(19)))[inside]] = 1
    size = np.sqrt(out.sum(axis=1, keepdims=True))
    return out / np.maximum(size, 1)


def train(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS):
    """(languages, landmark rows, weights): learned from at most ``sample`` documents of each language, whole texts, never from held-out rows."""
    named = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    # an even draw by hash keeps what is sorted near the sample's size; exact counts make the rate
    sizes = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, WIDTH), np.float32), np.zeros((0, 0), np.float32)
    sample, landmarks = max(1, min(sample, SAMPLES // len(sizes))), max(1, min(landmarks, ROWS // len(sizes)))
    rate = F.element_at(F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * sample / n + 50 / n)))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    text = F.col("text").cast("string")
    # of rows with one id the one of least digest
    drawn = named.where(draw < rate).groupBy("doc_id").agg(F.min(F.struct(F.sha2(text.cast("binary"), 256).alias("digest"), "lang", text.alias("text"))).alias("r"))
    rows = drawn.select("r.lang", "doc_id", "r.text").mapInArrow(_present, "lang string, doc_id string, row binary").collect()
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], bytes(r["row"]))):
        by.setdefault(r["lang"], []).append(np.unpackbits(np.frombuffer(r["row"], dtype=np.uint8)).astype(np.float32))
    languages = sorted(by)
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)
    for k in languages:
        rows_of = np.array(by[k])
        by[k] = unit(rows_of[rng.permutation(len(rows_of))[:sample]])
    marks = np.concatenate([by[k][:landmarks] for k in languages])
    x = np.concatenate([by[k] for k in languages])
    y = np.concatenate([np.full(len(by[k]), i) for i, k in enumerate(languages)])
    values, basis = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    half = basis[:, good] / np.sqrt(values[good])                               # kernel row -> Nyström features
    z = (x @ marks.T).astype(np.float64) @ half
    z = np.hstack([z, np.ones((len(z), 1))])
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weigh = (1 / np.bincount(y))[y][:, None] * len(y) / len(languages)          # every language weighs alike
    solved = np.linalg.solve(z.T @ (weigh * z) + RIDGE * np.eye(z.shape[1]), z.T @ (weigh * target))
    weights = np.vstack([half @ solved[:-1], solved[-1:]])                      # on kernel rows, with the bias below
    return languages, marks.astype(np.float32), weights.astype(np.float32)


def _present(batches):
    import pyarrow as pa

    for t in slices(batches, 1 << 20):
        rows = presence([x or b"" for x in t["text"].cast(pa.large_binary()).to_pylist()])
        yield pa.RecordBatch.from_arrays([t["lang"].combine_chunks(), t["doc_id"].cast(pa.string()).combine_chunks(), pa.array(
            [np.packbits(r > 0).tobytes() for r in rows], type=pa.binary())], names=["lang", "doc_id", "row"])


def _predicted(languages, marks, weights):
    import pyarrow as pa

    def run(batches):
        for t in slices(batches, 1 << 20):
            texts = [x or b"" for x in t["text"].cast(pa.large_binary()).to_pylist()]
            for lo in range(0, len(texts), 512):
                part = texts[lo:lo + 512]
                z = (presence(part) @ marks.T) @ weights[:-1] + weights[-1]
                p = np.exp(3 * (z - z.max(axis=1, keepdims=True)))
                best = z.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([t["doc_id"].slice(lo, len(part)).combine_chunks(), t["letter"].slice(lo, len(part)).combine_chunks(),
                                                  pa.array([languages[b] for b in best]), pa.array((p.max(axis=1) / p.sum(axis=1)).astype(np.float64))],
                                                 names=["doc_id", "letter", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every whole text; ``und`` with score 0 where the text is null or has no letter, or nothing was learned."""
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), letter)
    if not model[0]:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    out = rows.mapInArrow(_predicted(*model), f"doc_id {dict(docs.dtypes)['doc_id']}, letter boolean, lang_pred string, score double")
    return out.select("doc_id", F.when(F.col("letter"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letter"), F.col("score")).otherwise(0.0).alias("score"))
