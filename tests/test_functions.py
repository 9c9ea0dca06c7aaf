"""Helpers against plain Python: exact order, spans, crypto, identity numbers."""

import hashlib
import hmac
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.functions import checks as C
from tablewarden.functions import crypto as K
from tablewarden.functions import ordered
from tablewarden.functions.ordered import exact_quantiles, order_steps, ranked_rows
from tablewarden.functions.spans import CHUNK, find_spans, interval_join, spliced, sums_before
from tablewarden.operators import mask as M


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=2000), 2)
    x[:700] = 1.25           # a third of the rows are one value
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = exact_quantiles(df, [], "x", [0.0, 0.05, 0.5, 0.9, 1.0]).first()["quantiles"]
    assert got == pytest.approx(list(np.quantile(x, [0.0, 0.05, 0.5, 0.9, 1.0])))


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_grouped_quantiles_with_a_coarse_sketch(spark, method):
    rng = np.random.default_rng(5)
    rows = [(g, float(v)) for g, n in (("a", 30_000), (None, 7), ("b", 1)) for v in np.where(rng.random(n) < 0.3, 4.0, rng.normal(size=n) * 1e6)] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    probs = [0.0, 0.001, 0.25, 0.25, 0.5, 0.999, 1.0]
    for accuracy in (100, 10_000):
        got = {r["g"]: (r["quantiles"], r["n"]) for r in exact_quantiles(df, ["g"], "x", probs, method, accuracy).collect()}
        assert set(got) == {"a", None, "b"}
        for g, (q, n) in got.items():
            x = np.sort([v for k, v in rows if k == g and v is not None])
            want = np.quantile(x, probs) if method == "linear" else [x[max(int(np.ceil(len(x) * p)) - 1, 0)] for p in probs]
            assert n == len(x) and q == pytest.approx(list(want), rel=1e-12)


def test_quantiles_of_odd_columns(spark):
    big = spark.range(1000).select((F.col("id") + F.lit(2 ** 60)).alias("x"))
    assert exact_quantiles(big, [], "x", [0.5], "nearest").first()["quantiles"] == [float(2 ** 60 + 499)]
    ends = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (1.0,)], "x double")
    q = exact_quantiles(ends, [], "x", [0.0, 0.5, 0.75, 1.0], "nearest").first()["quantiles"]
    assert q[:3] == [float("-inf"), 1.0, float("inf")] and np.isnan(q[3])
    assert exact_quantiles(big.limit(0), [], "x", [0.5]).first()["n"] is None


def test_no_job_before_the_result_is_read(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("x"))
    spark.sparkContext.setJobGroup("lazy", "lazy")
    try:
        exact_quantiles(df, [], "x", [0.5]), order_steps(df, [], "id", "x"), ranked_rows(df, ["id", "x"])
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("kind", ["string", "double", "date", "boolean", "decimal(9,2)"])
def test_order_steps(spark, kind):
    rng = np.random.default_rng(8)
    values = {"string": lambda v: f"é{v}", "double": float, "date": lambda v: __import__("datetime").date(2020, 1, 1 + v), "boolean": lambda v: v > 3, "decimal(9,2)": lambda v: __import__("decimal").Decimal(v)}
    rows = [(g, int(o) if o else None, None if v == 7 else values[kind](int(v))) for g, o, v in zip(rng.choice(["a", "b", None], 900, p=[.7, .2, .1]), rng.integers(0, 60, 900) * (rng.random(900) > .3), rng.integers(0, 8, 900))]
    df = spark.createDataFrame(rows, f"g string, o long, v {kind}").repartition(9)
    for groups in ([], ["g"]):
        got = {r["g"] if groups else 0: tuple(r)[-4:] for r in order_steps(df, groups, "o", "v").collect()}
        want = {}
        for key in ({r[0] for r in rows} if groups else {0}):
            mine = [v for _, v in sorted((((r[1] is not None, r[1] or 0), r[2]) for r in rows if r[2] is not None and (not groups or r[0] == key)))]
            pairs = list(zip(mine, mine[1:]))
            want[key] = (len(mine), sum(a < b for a, b in pairs), sum(a > b for a, b in pairs), sum(a == b for a, b in pairs))
        assert got == want
    assert order_steps(df.limit(0), ["g"], "o", "v").count() == 0


def test_ranked_rows(spark):
    rng = np.random.default_rng(9)
    cols = [rng.integers(0, 5, 400).astype(float), rng.normal(size=400), np.where(rng.random(400) < .5, 0.0, rng.integers(-3, 3, 400)), np.full(400, 2.0)]
    rows = [tuple(None if i % 17 == k else float(c[i]) for k, c in enumerate(cols)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")          # runs of one value cross borders
    try:
        got = sorted(tuple(-1 if x is None else x for x in r) for r in ranked_rows(df, ["a", "b", "c", "d"]).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    def ranks(k):
        known = [r[k] for r in rows if r[k] is not None]
        return [-1 if r[k] is None else sum(x < r[k] for x in known) + (sum(x == r[k] for x in known) + 1) / 2 for r in rows]
    assert got == sorted(zip(*(ranks(k) for k in range(4))))
    assert ranked_rows(df.limit(0), ["a", "b"]).count() == 0


def test_spans_match_python(spark):
    texts = ["mail a.b@c.de, x@y.org.", "none", "", "ünï@x.com é@b.co 😀 q@w.io end", "q@w.io"]
    rx = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", find_spans(F.col("t"), rx).alias("s")).collect()
    for r in rows:
        want = [(m.start(), m.end(), m.group()) for m in re.finditer(rx, r["t"])]
        assert [(s["start"], s["end"], s["surface"]) for s in (r["s"] or [])] == want


def test_hmac(spark):
    key = hashlib.sha256(b"k").digest()
    rows = spark.createDataFrame([("x",), ("é",), ("",)], "v string").select("v", K.hmac_sha256(F.col("v"), key).alias("h")).collect()
    assert all(r["h"] == hmac.new(key, r["v"].encode(), hashlib.sha256).hexdigest() for r in rows)


@pytest.mark.parametrize("narrow", [True, False])
def test_ff3_published_vector(spark, narrow):
    key, tweak = bytes.fromhex("2DE79D232DF5585D68CE47882AE256D6"), bytes.fromhex("CBD09280979564")
    df = spark.createDataFrame([("3992520240",)], "v string")
    c = df.select(K.ff3(F.col("v"), key, tweak, narrow=narrow).alias("c"))
    assert c.first()["c"] == "8901801106"
    assert c.select(K.ff3(F.col("c"), key, tweak, reverse=True, narrow=narrow).alias("p")).first()["p"] == "3992520240"


def test_fpe_short_and_long(spark):
    key = hashlib.sha256(b"k").digest()
    values = ["12-34", "4111 1111 1111 1111", "9" * 40, "no digits"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    c = df.select("v", K.fpe(F.col("v"), key, short="keystream").alias("c"))
    back = c.select("v", "c", K.fpe(F.col("c"), key, short="keystream", reverse=True).alias("b")).collect()
    assert all(r["v"] == r["b"] and len(r["v"]) == len(r["c"]) for r in back)
    assert [re.sub(r"\d", "#", r["c"]) for r in back] == [re.sub(r"\d", "#", v) for v in values]
    with pytest.raises(Exception, match="too short"):
        df.select(K.fpe(F.col("v"), key).alias("c")).collect()


def test_encrypt_round_trip(spark):
    key = hashlib.sha256(b"k").digest()
    df = spark.createDataFrame([("héllo",), (None,)], "v string").select("v", K.encrypt(F.col("v"), key).alias("c"))
    rows = df.select("v", "c", K.decrypt(F.col("c"), key).alias("b")).collect()
    assert rows[0]["b"] == "héllo" and rows[0]["c"].startswith("g1:") and rows[1]["b"] is None


@pytest.mark.parametrize("kind,good,bad", [
    ("luhn", ["4111111111111111", "79927398713"], ["4111111111111112", "", "abc"]),
    ("iban", ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"], ["GB82WEST12345698765433", "XX00", "DE8937040044053201300"]),
    ("swift", ["DEUTDEFF", "NBEGEGCX001"], ["DEUTXXFF", "DEUT", "12345678"]),
    ("mac", ["00:1a:2b:3c:4d:5e"], ["01:1a:2b:3c:4d:5e", "00:00:00:00:00:00", "ff:ff:ff:ff:ff:ff", "zz"]),
    ("eth", ["0x" + "aB" * 20], ["0x" + "a" * 39, "aB" * 20]),
    ("btc", ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"], ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNb", "0OIl", ""]),
    ("jwt", ["eyJhbGciOiJIUzI1NiJ9.e30.x"], ["eyJ0eXAiOiJKV1QifQ.e30.x", "a.b", "eyJhbGciOiJIUzI1NiJ9..x"]),
    ("nir", ["255081416802538"], ["255081416802537", "25508141680253"]),
    ("imei", ["490154203237518", "49-015420-323751-8"], ["490154203237517", "77" + "0" * 13, "49015420323751", "49015420323751A"]),
    ("egypt_nid", ["29001010123456", "٢٩٠٠١٠١٠١٢٣٤٥٦", "30002290112345"], ["29013010123456", "29002310123456", "19001010123456", "29001010523456", "39901010123456", "290010101234"]),
    ("msisdn", ["01012345678", "+201112345678", "00201212345678", "201512345678", "1012345678", "'01012345678", "1012345678.0", "010 1234-5678"], ["01712345678", "0101234567", "x"]),
])
def test_identity_numbers(spark, kind, good, bad):
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, want boolean")
    rows = df.select("v", "want", C.VALIDATORS[kind](F.col("v")).alias("got")).collect()
    assert [(r["v"], r["got"]) for r in rows] == [(r["v"], r["want"]) for r in rows]


def test_national_id_parts(spark):
    r = spark.createDataFrame([("29001010123456",)], "v string").select(C.egypt_nid(F.col("v")).alias("r")).first()["r"]
    assert (str(r["birth_date"]), r["governorate"], r["gender"]) == ("1990-01-01", "Cairo", "male")


def test_phone_plans(spark):
    df = spark.createDataFrame([("+201012345678", "EG"), ("01012345678", "EG"), ("+966512345678", "SA"), ("+15551234567", "US"), ("2024-01-02", None), ("+999123", None)], "v string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", C.phone(F.col("v"))["region"].alias("got")).collect())


def test_sums_before(spark):
    rng = np.random.default_rng(2)
    lists = [[], [5], [1, 2, 3], *[rng.integers(0, 9, n).tolist() for n in (4, 16, 17, 1000)]]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    for row in df.select("x", sums_before(F.col("x"), F.lit(7)).alias("s")).collect():
        assert row["s"] == [7 + sum(row["x"][:i]) for i in range(len(row["x"]))]


def test_spans_of_a_long_text(spark):
    """Ten thousand times the text takes not much more than ten thousand times as long; offsets stay right to the end."""
    text = "é pay 12 to 345, ok. " * 60_000
    row = spark.createDataFrame([(text,)], "t string").select(find_spans(F.col("t"), r"\d+").alias("s")).selectExpr("size(s) AS n", "s[119999] AS last").first()
    assert row["n"] == 120_000 and text[row["last"]["start"]:row["last"]["end"]] == "345" == row["last"]["surface"] and row["last"]["start"] == text.rindex("345")


def test_splice(spark):
    rng = np.random.default_rng(6)
    for size, count in ((0, 0), (5, 1), (CHUNK, 3), (40 * CHUNK + 7, 400)):
        text = "".join(rng.choice(list("aé😀 b\n"), size))
        cuts = sorted(rng.choice(size + 1, 2 * count, replace=False).tolist()) if count else []
        edits = [(a, b, f"<{i}>") for i, (a, b) in enumerate(zip(cuts[::2], cuts[1::2]))] + ([(size, size, "end")] if count and cuts[-1] < size else [])
        want, at = "", 0
        for a, b, new in edits:
            want, at = want + text[at:a] + new, b
        df = spark.createDataFrame([(text, edits)], "t string, e array<struct<start:int,end:int,new:string>>")
        if edits:
            assert df.select(spliced(F.col("t"), F.col("e")).alias("x")).first()["x"] == want + text[at:]


def test_interval_join(spark):
    rng = np.random.default_rng(4)
    rows = [[(int(rng.integers(0, 3)), s, s + int(rng.choice([0, 1, 3, 64, 70, 500])), i) for i, s in enumerate(rng.integers(0, 400, 150).tolist())] for _ in range(2)]
    rows[0] += [(0, 64, 128, 900), (0, 128, 192, 901), (0, 128, 192, 902), (1, None, 5, 903)]
    rows[1] += [(0, 0, 64, 900), (0, 128, 192, 901), (0, 192, 193, 902), (1, 2, None, 903)]
    a = spark.createDataFrame(rows[0], "k int, ls int, le int, l int")
    b = spark.createDataFrame(rows[1], "k int, rs int, re int, r int")
    got = sorted((r["l"], r["r"]) for r in interval_join(a, b, ["k"], "ls", "le", "rs", "re").collect())
    assert got == sorted((x[3], y[3]) for x in rows[0] for y in rows[1] if x[0] == y[0] and None not in x + y and x[1] < y[2] and y[1] < x[2])


def test_interval_join_of_a_long_document_is_linear(spark):
    """10^5 touching spans on each side of one document: each meets its own partner and nothing else."""
    side = lambda s, e, i: spark.range(100_000).select(F.lit(1).alias("d"), (F.col("id") * 10).cast("int").alias(s), (F.col("id") * 10 + 10).cast("int").alias(e), F.col("id").alias(i))
    got = interval_join(side("ls", "le", "l"), side("rs", "re", "r"), ["d"], "ls", "le", "rs", "re")
    assert got.count() == 100_000 and got.where("l <> r").isEmpty()


def test_ff3_wide_halves_of_every_length(spark):
    """Halves of more than one bigint piece: there and back at every length, all greatest and all least characters included."""
    key, alpha = hashlib.sha256(b"k").digest(), K.ALPHABETS["alnum"]
    _, least, longest = K.domain_limits("alnum")
    df = spark.createDataFrame([(c,) for n in range(least, longest + 1) for c in ("0" * n, "Z" * n, (alpha * 2)[n:2 * n])], "v string")
    c = df.select("v", K.fpe(F.col("v"), key, "alnum").alias("c"))
    rows = c.select("v", "c", K.fpe(F.col("c"), key, "alnum", reverse=True).alias("b")).collect()
    assert all(r["v"] == r["b"] and len(r["v"]) == len(r["c"]) and r["v"] != r["c"] for r in rows)


@pytest.mark.parametrize("rule", [M.MaskRule("v", "fpe", {"alphabet": "alnum"}), M.MaskRule("v", "fake", {"kind": "regex", "regex_pattern": "[a-z]{30}"})])
def test_costly_rules_leave_the_one_split_of_a_small_file(spark, rule):
    df = spark.range(100).select(F.concat(F.lit("user"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("v")).coalesce(1)
    tasks = M.apply(df, [rule], hashlib.sha256(b"m").digest()).select("v", F.spark_partition_id().alias("p"))
    assert tasks.select("p").distinct().count() > 1 and tasks.select("v").distinct().count() == 100


def test_ranking_tasks_follow_the_rows(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 7).alias("a"), (F.col("id") * 37 % 101).alias("b"))
    whole = sorted(map(tuple, ranked_rows(df, ["a", "b"]).collect()))
    monkeypatch.setattr(ordered, "ENTRIES_IN_TASK", 10)
    many = ranked_rows(df, ["a", "b"])
    assert many.rdd.getNumPartitions() == 60 and sorted(map(tuple, many.collect())) == whole
