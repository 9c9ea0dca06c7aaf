"""Held-out accuracy of the two learned operators, odd rows, and leaks planted under edits."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tablewarden.llm import decontaminate, lang_id, quality_model
from tablewarden.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality_model.score(docs, quality_model.train(docs, labels)).select("_row.doc_id", "score", "predicted").join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    right = {q: [r["predicted"] == q for r in scored if r["quality"] == q] for q in (0, 1)}
    assert min(np.mean(right[0]), np.mean(right[1])) > 0.9 and all(0 <= r["score"] <= 1 for r in scored)


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (9, 1, 0), (None, 1, 0), (8, None, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.train(odd, labels)
    assert quality_model.score(odd, model).count() == 13 and quality_model.score(none, model).count() == 0
    constant = quality_model.train(odd, labels.limit(0))
    assert {r["score"] for r in quality_model.score(odd, constant).collect()} == {0.5}
    assert quality_model.keep(odd, labels.limit(0)).columns == odd.columns and quality_model.keep(none, labels).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_model.train(docs, labels), quality_model.train(docs, flipped)
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lang_id.predict(docs, lang_id.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_rows(spark, odd, none):
    got = lang_id.predict(odd, lang_id.train(odd)).collect()
    assert len(got) == 13 and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"} and all(r["lang_pred"] != "und" for r in got if r["doc_id"] == 7)
    assert lang_id.predict(odd, lang_id.train(none)).where("lang_pred <> 'und'").count() == 0 and lang_id.predict(none, lang_id.train(odd)).count() == 0


def distance(a, b):
    """Least edit distance of a to any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_leaks_under_edits(spark):
    rng = random.Random(4)
    vocabulary = ["w%d" % k for k in range(50)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(n))) for k, n in enumerate([1, 3, 6, 9, 15, 20, 30, 40, 40, 60])]
    docs = []
    for d in range(120):
        words = rng.choice(items)[1].split()
        for _ in range(rng.randrange(1 + len(words) * 3 // 10)):
            at = rng.randrange(len(words))
            words[at:at + rng.randrange(2)] = [rng.choice(vocabulary)]
        around = [[rng.choice(vocabulary) for _ in range(rng.randrange(25))] for _ in range(2)]
        docs.append((d, " ".join(around[0] + words + around[1]).title()))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=4).collect()}
    want = {}
    for d, t in docs:
        for k, item in items:
            a = item.split()
            far = distance(a, t.lower().split())
            if far <= len(a) * decontaminate.PERCENT // 100:
                want[d, k] = far
    assert got.keys() <= want.keys() and len(got) >= 0.98 * len(want)
    assert np.mean([got[k] == want[k] for k in got]) > 0.98


def test_leak_spans_and_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "Same words STAND in this row"), (2, None), (None, "river"), (3, ""), (4, "!!"), (1, "Same words STAND in this row")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.leaks(odd, items).collect())
    assert got == [(9, 1, 6, 0, 4, 32), (10, 1, 6, 0, 4, 32)]
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.leaks(odd, items.limit(0)).count() == 0
    kept = decontaminate.keep(odd, items)
    assert kept.columns == odd.columns and kept.count() == 11


def test_many_languages(spark):
    """Every language is learned, however many there are; rows that share an id do not make the model depend on their order."""
    rows = [(10 * i + k, f"{chr(0x4e00 + i)}{chr(0x5e00 + i)} " * (k + 2), f"l{i:03d}") for i in range(250) for k in range(6)] + [(0, "another text", "l001"), (0, "zzz", "l002")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = lang_id.train(docs)
    learned = {lang for d, _, lang in rows if zlib.crc32(str(d).encode()) % 3 != 1}
    assert set(model[0]) == learned and len(learned) > 240 and len(model[1]) <= lang_id.ROWS
    got = {r["doc_id"]: r["lang_pred"] for r in lang_id.predict(docs, model).collect()}
    want = {d: lang for d, _, lang in rows if d and lang in learned}
    assert sum(got[d] == lang for d, lang in want.items()) > 0.9 * len(want)
    again = lang_id.train(spark.createDataFrame(rows[::-1], docs.schema).repartition(7))
    assert (again[1] == model[1]).all() and again[0] == model[0]
