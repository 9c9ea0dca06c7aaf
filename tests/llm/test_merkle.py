"""The Merkle manifest against a plain tree, block by block, and odd rows."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewarden.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(level, arity):
    """Root, and for each leaf its siblings (left, right), lowest level first."""
    path, spot = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, p in enumerate(spot):
            run = p // arity * arity
            path[i].append(("".join(level[run:p]), "".join(level[p + 1:run + arity])))
        spot = [p // arity for p in spot]
        level = [sha("".join(level[k:k + arity])) for k in range(0, len(level), arity)]
    return level[0], path


def brute(rows, arity):
    parts = {}
    for doc_id, lang, text in rows:
        parts.setdefault(lang, []).append((doc_id is not None, doc_id or 0, sha(field(doc_id) + field(text))))
    names = sorted(parts, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([leaf for *_, leaf in sorted(parts[k])], arity) for k in names}
    root, tops = tree([trees[k][0] for k in names], arity)
    return Counter((d if known else None, leaf, trees[k][0], root, sha("".join(a + b for a, b in path + top)))
                   for k, top in zip(names, tops) for (known, d, leaf), path in zip(sorted(parts[k]), trees[k][1]))


@pytest.mark.parametrize("arity,levels", [(2, 2), (2, 8), (3, 2)])
def test_manifest(spark, arity, levels):
    rows = [(i, "big", f"t{i}") for i in range(150)] + [(i, "né", "x") for i in range(17)] + [(7, "one", None)] + [(3, None, "y")] * 5 + [(None, "big", "z"), (4, "", "")]
    rows += [(500 + i, f"l{i}", "few") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("path", F.lit("clash")).withColumn("_n", F.lit("clash")).repartition(6)
    leaf = merkle.digest(merkle.field(F.col("doc_id")), merkle.field(F.col("text")))
    got = merkle.manifest(docs, "lang", ["doc_id"], leaf, {"size": F.length("text")}, arity, levels)
    assert got.columns == ["doc_id", "size", "leaf", "subroot", "root", "path"]
    found = got.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("p"), merkle.fold(F.col("leaf"), F.col("path")).alias("f")).collect()
    assert Counter(tuple(r)[:5] for r in found) == brute(rows, arity) and all(r["f"] == r["root"] for r in found)
    wrong = got.select((merkle.fold(F.sha2("leaf", 256), F.col("path")) == F.col("root")).alias("same"))
    assert not wrong.where("same").count()


def test_odd_rows(spark, odd, none):
    leaf = merkle.digest(merkle.field(F.col("doc_id")), merkle.field(F.col("text")))
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in odd.collect()]
    found = merkle.manifest(odd, "lang", ["doc_id"], leaf).select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("p")).collect()
    assert Counter(map(tuple, found)) == brute(rows, 2)
    assert merkle.manifest(none, "lang", ["doc_id"], leaf).count() == 0
