"""One-to-one matching and difference classes against brute force; nearest vectors in blocks."""

import random

import numpy as np
from pyspark.sql import functions as F

from tablewarden.operators import evaluate as E
from tablewarden.operators import matching as N

GOLD = "doc_id long, gid long, start int, end int, entity_type string, grade string, value string"
PRED = "doc_id long, pid long, start int, end int, entity_type string, score double, value string"


def corpus(seed, docs=30):
    rnd = random.Random(seed)
    gold, pred = [], []
    for d in range(docs):
        for i in range(rnd.randrange(1, 8)):
            a = rnd.randrange(0, 80)
            gold.append((d, i, a, a + rnd.randrange(2, 12), rnd.choice("AB"), "strict", rnd.choice("xyz")))
        for i in range(rnd.randrange(0, 8)):
            a = rnd.randrange(0, 80)
            pred.append((d, i, a, a + rnd.randrange(2, 12), rnd.choice("AB"), 0.5, rnd.choice("xyz")))
    return gold, pred


def iou(g, p):
    o = max(0, min(g[3], p[3]) - max(g[2], p[2]))
    return o / (max(g[3], p[3]) - min(g[2], p[2])) if o else 0.0


def greedy(cands):
    ug, up, out = set(), set(), []
    for _, g, p in sorted(cands):
        if g not in ug and p not in up:
            ug.add(g), up.add(p), out.append((g, p))
    return out


def per_doc(gold, pred, fn):
    return sorted((d, g, p) for d in {x[0] for x in gold} for g, p in fn([x for x in gold if x[0] == d], [x for x in pred if x[0] == d]))


def test_overlap_and_value_matching(spark):
    gold, pred = corpus(5)
    g, p = spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, PRED)

    def overlap(gs, ps):
        return greedy([(-iou(a, b), a[1], b[1]) for a in gs for b in ps if a[4] == b[4] and iou(a, b) >= 0.3])

    def value(gs, ps):
        return greedy([(-(1.0 if (a[2], a[3]) == (b[2], b[3]) else 0.5 + 0.5 * iou(a, b)), a[1], b[1]) for a in gs for b in ps if a[4] == b[4] and a[6] == b[6]])
    assert sorted(tuple(r) for r in E.match(g, p, "overlap", 0.3).select("doc_id", "gid", "pid").collect()) == per_doc(gold, pred, overlap)
    assert sorted(tuple(r) for r in E.match(g, p, "value").select("doc_id", "gid", "pid").collect()) == per_doc(gold, pred, value)


def test_every_span_gets_one_class(spark):
    gold, pred = corpus(9)
    out = E.classify(spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, PRED)).collect()
    golds = [(r["doc_id"], r["gid"]) for r in out if r["gid"] is not None]
    assert sorted(golds) == sorted((g[0], g[1]) for g in gold)
    spurious = {(r["doc_id"], r["pid"]) for r in out if r["class"] == "spurious"}
    paired = {(r["doc_id"], r["pid"]) for r in out if r["gid"] is not None and r["pid"] is not None}
    assert not spurious & paired and spurious | paired <= {(p[0], p[1]) for p in pred}


def test_classes_one_by_one(spark):
    gold = [(1, 0, 0, 5, "A", "strict", "a"), (1, 1, 10, 15, "A", "strict", "b"), (1, 2, 20, 30, "A", "strict", "c"), (1, 3, 40, 44, "A", "strict", "d"), (1, 4, 46, 50, "A", "strict", "e"),
            (1, 5, 60, 80, "A", "strict", "f"), (1, 6, 90, 95, "A", "strict", "g"), (1, 7, 100, 110, "A", "strict", "h")]
    pred = [(1, 0, 0, 5, "A", 1.0, "a"), (1, 1, 10, 15, "B", 1.0, "b"), (1, 2, 19, 31, "A", 1.0, "zz"), (1, 3, 40, 50, "A", 1.0, "y"), (1, 4, 60, 70, "A", 1.0, "u"), (1, 5, 70, 80, "A", 1.0, "v"),
            (1, 6, 102, 106, "A", 1.0, "w"), (1, 7, 200, 205, "A", 1.0, "q")]
    rows = E.classify(spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, PRED)).collect()
    by_gold = {r["gid"]: r["class"] for r in rows if r["gid"] is not None}
    assert by_gold == {0: "exact", 1: "type_mismatch", 2: "superset", 3: "merged", 4: "merged", 5: "split", 6: "missed", 7: "subset"}
    assert [r["pid"] for r in rows if r["class"] == "spurious"] == [7]


def test_nearest_in_several_blocks(spark):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(300, 8)))                       # many equal distances, and rows without length
    v[7] = v[150] = 0
    groups = [None if i % 11 == 0 else "ab"[i % 2] for i in range(300)]
    base = spark.createDataFrame([(i, [float(x) for x in r], g) for i, (r, g) in enumerate(zip(v, groups))], "bid long, vector array<double>, group string").repartition(5)
    queries = base.where("bid < 40").withColumnRenamed("bid", "qid")
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
    for grouped in (False, True):
        got = {}
        q, b = (queries, base) if grouped else (queries.drop("group"), base.drop("group"))
        for r in N.knn(q, b, 3, exclude_self=True, query_block=15, base_block=70).collect():
            got.setdefault(r["qid"], []).append((r["rank"], round(r["distance"], 9)))
        for i in range(40):
            d = 1 - u @ u[i]
            near = sorted(round(d[j], 9) for j in range(300) if j != i and norm[j] > 0 and (not grouped or groups[j] == groups[i]))[:3]
            assert [x for _, x in sorted(got[i])] == near
    assert N.knn(queries.limit(0), base, 3).count() == 0 and N.knn(queries, base.limit(0), 3).count() == 0


def test_nearest_ties_go_to_the_least_id(spark):
    base = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(200)], "bid long, vector array<double>").repartition(4)
    got = sorted((r["rank"], r["bid"]) for r in N.knn(base.where("bid = 100").withColumnRenamed("bid", "qid"), base, 4, base_block=60).collect())
    assert [b for _, b in got] == [1, 4, 7, 10]


def test_values_are_the_least_hashes(spark):
    from tablewarden.operators import sampling as M
    df = spark.range(4000).select((F.col("id") % 3).cast("string").alias("few"), F.concat(F.lit("é"), (F.col("id") % 700).cast("string")).alias("many"),
                                  F.when(F.col("id") % 2 == 0, F.col("id")).alias("holes"), F.lit(None).cast("string").alias("none")).repartition(7)
    got = M.values(df, 20, 5).collect()
    hashed = lambda c: df.where(F.col(c).isNotNull()).select(F.xxhash64(F.col(c).cast("string"), F.lit(5)).alias("h"), F.col(c).cast("string").alias("v")).distinct().orderBy("h", "v").limit(20)
    for c, n in (("few", 3), ("many", 20), ("holes", 20)):
        mine = [v for _, v in sorted((r["rank"], r["value"]) for r in got if r["column"] == c)]
        assert len(mine) == n and mine == [r["v"] for r in hashed(c).collect()]
    assert {r["column"] for r in got} == {"few", "many", "holes"}


def test_numeric_profile_of_extreme_values(spark):
    df = spark.createDataFrame([("1e300",), ("0.00125",), ("Infinity",), ("-3",), ("2.5",)], "v string")
    from tablewarden.operators import profile as P
    row = P.numeric(df, ["v"]).first()
    assert row["parsed_count"] == 4 and row["max"] == 1e300 and row["decimal_places_median"] == 0.5
    small = P.summarize(spark.createDataFrame([(9,), (10,), (200,), (None,)], "n int"), ["n"]).first()
    assert (small["min"], small["max"], small["count"]) == ("9", "200", 3)


def test_pairs_are_dealt_by_their_number(spark, monkeypatch):
    gold, pred = corpus(9)
    g, p = spark.createDataFrame(gold, GOLD), spark.createDataFrame(pred, PRED)
    whole = sorted(map(str, E.classify(g, p).collect()))
    pairs = E.overlap_pairs(g, p, same_type=False)
    monkeypatch.setattr(E, "PAIRS_IN_TASK", 5)
    dealt = E._dealt_by_document(pairs)
    assert dealt.rdd.getNumPartitions() == -(-pairs.count() // 5) > 1 and dealt.exceptAll(pairs).isEmpty() and dealt.count() == pairs.count()
    assert sorted(map(str, E.classify(g, p).collect())) == whole


def test_nearest_holds_few_distances_at_once():
    """A task of full blocks: what it holds beside its rows does not grow with the blocks; the nearest are those of the whole matrix."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tablewarden.operators import matching as N

    rng, n_q, n_b = np.random.default_rng(5), 200, 20_000
    table = lambda n, key, m: pa.table({key: pa.array(np.arange(n)), "vector": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 4, pa.int32()), pa.array(m.ravel())), "group": pa.array([str(i % 3) for i in range(n)])})
    q, b = rng.normal(size=(n_q, 4)), rng.normal(size=(n_b, 4))
    tracemalloc.start()
    got = N._nearest(2, "l2", False)(table(n_q, "qid", q), table(n_b, "bid", b))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20, peak
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(0, 2 - 2 * unit(q) @ unit(b).T))
    d[np.arange(n_q)[:, None] % 3 != np.arange(n_b)[None, :] % 3] = np.inf
    assert got["bid"].to_numpy().reshape(n_q, 2).tolist() == np.argsort(d, axis=1)[:, :2].tolist()


def test_outcomes_lie_in_tasks_of_a_set_size(spark, monkeypatch):
    """A task's rows do not grow with the table, and what falls into several tasks is counted as a plain reading of the spans counts it."""
    monkeypatch.setattr(E, "SPANS_IN_TASK", 40)
    rnd, grades = random.Random(7), ["strict", "advisory", "structure_only", None]
    place = lambda: (s := rnd.choice([None, *range(0, 90)]), None if s is None else s + rnd.choice([0, 1, 3, 70]))
    doc = lambda: rnd.choice([None, "hot", "hot", *"abcdefgh"])
    gold = [(doc(), g, *place(), rnd.choice("AB"), rnd.choice(grades)) for g in range(300)]
    pred = [(d, 1000 + k, s, e, t) if rnd.random() < 0.5 else (doc(), 1000 + k, *place(), "A") for k, (d, _, s, e, t, _) in enumerate(gold)]
    g = spark.createDataFrame(gold, "doc_id string, gid long, start int, end int, entity_type string, grade string")
    p = spark.createDataFrame(pred, "doc_id string, pid long, start int, end int, entity_type string")
    want, left = set(), {}
    for d, k, s, e, t in sorted(pred, key=lambda r: r[1]):
        left.setdefault((d, t, s, e), []).append(k)
    for d, k, s, e, t, _ in gold:
        if None not in (d, s) and left.get((d, t, s, e)):
            want.add((d, k, left[d, t, s, e].pop(0)))
    m = E.match(g, p)
    assert set(map(tuple, m.collect())) == want
    rows = E.outcomes(g, p, m)
    assert rows.rdd.getNumPartitions() == -(-(600 + 2 * len(want)) // 40)
    hits = {k for _, k, _ in want}, {k for _, _, k in want}
    kinds = [(d, t, "tp" if k in hits[0] else "fn") for d, k, _, _, t, grade in gold if grade in ("strict", None)]
    soft = [r for r in gold if r[5] == "advisory" and None not in (r[0], r[2])]
    kinds += [(d, t, "advisory" if s is not None and any(d == a[0] and a[2] < e and s < a[3] for a in soft) else "fp") for d, k, s, e, t in pred if k not in hits[1]]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, rows.collect()), key=key) == sorted(kinds, key=key)
    tags = spark.createDataFrame([("hot", ["x", "y"]), ("a", ["x"]), ("none", ["x"])], "doc_id string, tags array<string>")
    sets = {("micro", ""): lambda r: True, ("tag", "x"): lambda r: r[0] in ("hot", "a"), ("tag", "y"): lambda r: r[0] == "hot"}
    sets |= {("entity", v): lambda r, v=v: r[1] == v for v in "AB"} | {("case", v): lambda r, v=v: r[0] == v for v in {r[0] for r in kinds}}
    got = {(r["level"], r["key"]): (r["tp"], r["fp"], r["fn"]) for r in E.aggregate(rows, tags).collect()}
    assert got == {n: tuple(sum(f(r) and r[2] == k for r in kinds) for k in ("tp", "fp", "fn")) for n, f in sets.items()}
