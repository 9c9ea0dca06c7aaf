"""Chat rotation, line rules, URL rules and shards: SQL or brute force, and odd rows."""

import re
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "scripts"))

from check import connect, rows_of  # noqa: E402

from tablewarden.llm import chat, line_rules, queries, sharding, url_rules  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    cur = connect(SF).execute(queries.ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns) and rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


def test_rotation(spark):
    turns = spark.createDataFrame([(1, 2, "ann", "see you"), (1, 0, "system", "be <|kind|>"), (1, 1, "bob", None), (None, None, None, "lost"), (2, 0, "system", "alone"),
                                   (1, 3, "bob", "x"), (1, 3, "bob", "x")], "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    ann = got[1, "ann"]
    assert ann["text"] == ("<|im_start|>system\nbe < |kind|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nsee you<|im_end|>\n"
                           + "<|im_start|>user name=bob\nx<|im_end|>\n" * 2)
    assert [ann["text"][s["begin"]:s["end"]] for s in ann["mask"]] == ["see you"]
    assert [got[1, "bob"]["text"][s["begin"]:s["end"]] for s in got[1, "bob"]["mask"]] == ["", "x", "x"]
    assert got[None, "unknown"]["n_turns"] == 1 and chat.rotate(turns.limit(0)).count() == 0


def test_long_conversations(spark):
    """Turn values may be sparse or equal: stretches are counted in order, whole up to the limit, and later ones begin with the opening system turns."""
    sent = [(1, None, "system", "be kind")] + [(1, -5, "system", "be brief")] + [(1, 1000 * i if i > 100 else 7, "ab"[i % 2], f"t{i:03d}") for i in range(300)] + [(1, 10 ** 9, "system", "late"), (2, 5, "a", "x")]
    turns = spark.createDataFrame(sent, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash")).withColumn("_rank", F.lit("clash")).repartition(5)
    whole = {(r["conv_id"], r["perspective"]): r for r in chat.rotate(turns).collect()}
    assert set(whole) == {(1, "a"), (1, "b"), (2, "a")} and whole[1, "a"]["n_turns"] == 303 and whole[1, "a"]["carried"] == 0
    assert [whole[1, "a"]["text"][s["begin"]:s["end"]] for s in whole[1, "a"]["mask"]][-1] == "t298" and len(whole[1, "b"]["mask"]) == 150
    cut = chat.rotate(turns, 64).where("conv_id = 1 AND perspective = 'b'").orderBy("segment").collect()
    assert [(r["segment"], r["n_turns"], r["carried"]) for r in cut] == [(0, 64, 0), (1, 64, 2), (2, 64, 2), (3, 64, 2), (4, 47, 2)]
    head = "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>system\nbe brief<|im_end|>\n"
    assert all(r["text"].startswith(head) for r in cut) and cut[0]["text"] + "".join(r["text"][len(head):] for r in cut[1:]) == whole[1, "b"]["text"]
    for r in cut:
        assert all(r["text"][s["begin"]:s["end"]].startswith("t") for s in r["mask"])
    assert sum(len(r["mask"]) for r in cut) == 150
    long = spark.createDataFrame([(3, 0, "a", "é " * 400_000), (3, 0, "a", "é " * 400_000), (3, 1, None, None)], "conv_id long, turn long, role string, text string")
    got = {r["perspective"]: r for r in chat.rotate(long).collect()}
    assert set(got) == {"a", "unknown"} and [s["end"] - s["begin"] for s in got["a"]["mask"]] == [800_000] * 2


def brute_measures(text):
    words = [w for w in (text or "").translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set(windows)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\x0b\f\r")]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len({i + k for i, w in enumerate(windows) if w in many for k in range(3)}))


def test_line_measures(spark, odd, none):
    rng = random.Random(2)
    texts = ["\n".join(" ".join(rng.choice(["a", "b", "ü#", "<c>", "dd"]) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(6))) for _ in range(150)] + ["a b c a b c a", "q\u00a0r s", "a a a a"]
    docs = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in line_rules.judge(docs).collect():
        assert tuple(r)[1:6] == brute_measures(texts[r["doc_id"]]), texts[r["doc_id"]]
    got = line_rules.judge(odd).collect()
    assert len(got) == 13 and all(r["base_failed"] and not r["kept"] for r in got) and line_rules.judge(none).count() == 0
    assert {r["doc_id"]: r["n_repeat_words"] for r in got}[6] == 30_000
    assert line_rules.keep(odd).columns == odd.columns


def test_frequent_lines(spark):
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(k, f"All  rights Reserved\n{own(k)}", "h") for k in range(30)] + [(100 + k, "\n".join([" ".join(f"nav{j}" for j in range(90)), f"t{k}"]), "h") for k in range(30)]
    rows += [(200 + k, own("same"), "h") for k in range(40)] + [(300, "\n".join([" ".join(f"nav{j}" for j in range(90)), "t"]), "other"), (301, own("s"), None)]
    got = {r["doc_id"]: r for r in line_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k]["kept"] and got[k]["removed_words"] == 3 for k in range(30))           # a license line goes, the document stays
    assert not any(got[100 + k]["kept"] for k in range(30)) and got[100]["removed_words"] == 90
    assert all(got[200 + k]["kept"] for k in range(40)) and got[300]["kept"] and got[301]["kept"]  # copies are one document; other hosts count apart


def test_frequent_lines_leave_the_text(spark):
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(k, f"\n  All  rights Reserved\t\n{own(k)}\n \nALL RIGHTS RESERVED\r\nend {k}\n", "h", "clash") for k in range(30)] + [(100, f"all rights reserved\n{own(100)}", "other", None)]
    rows += [(200 + k, f"all rights reserved\nt{k}", "h", None) for k in range(3)] + [(300, None, "h", None), (301, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _frequent string")
    got = {r["doc_id"]: r for r in line_rules.keep(docs).collect()}
    assert set(got) == {*range(30), 100} and got[5]["_frequent"] == "clash"
    assert all(got[k]["text"] == f"\n{own(k)}\n \nend {k}\n" for k in range(30)) and got[100]["text"] == rows[30][1]
    every = {r["doc_id"]: r for r in line_rules.clean(docs).collect()}
    assert len(every) == len(rows) and every[201]["text"] == "t1" and every[300]["text"] is None and every[301]["text"] == ""
    for r in line_rules.judge(docs).collect():
        assert len((every[r["doc_id"]]["text"] or "").split()) == r["n_words"] - r["removed_words"], r["doc_id"]
    assert line_rules.clean(docs.limit(0)).columns == docs.columns


def test_url_rules(spark):
    rules = queries.URL_RULES
    urls = [None, "", "no scheme", "http://", "https://NET", "http://net/", "http://x.net/a?b", "http://a.example.net/en/1", "http://example.net/en", "http://example.net?x=/en/", "http://badexample.net/en/q",
            "ftp://www.Example.COM/de/x#y", "http://example.com/DE/", "http://q.org/fr/", "http://org/fr/", "http://org.net/fr/", "http://a..net/z", "http://.net/z", "a://b://c.net/d", "http://example.com:80/de/", "http://x.net/a\nb"] * 3
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string").repartition(4)

    def one(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [(len(h + p), h + p, v) for v, h, p in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    got = url_rules.judge(pages, rules).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == one(urls[r["page_id"]]), urls[r["page_id"]]
    assert url_rules.judge(pages.limit(0), rules).count() == 0 and {r["verdict"] for r in url_rules.judge(pages, []).collect()} == {"allow"}


@pytest.mark.parametrize("rows", [0, 1, 30, 3_000])
def test_shards(spark, rows):
    rng = random.Random(rows)
    data = [(i if i % 9 else None, rng.choice([16, 20, 300, 4_000, None]), "t") for i in range(rows)] + [(5, 7, "same")] * min(rows, 200)
    rng.shuffle(data)
    got = sharding.assign(spark.createDataFrame(data, "doc_id long, size long, slot string").repartition(5), 8).collect()
    assert len(got) == len(data) and sorted((str(r["doc_id"]), str(r["size"])) for r in got) == sorted((str(d[0]), str(d[1])) for d in data)
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    if rows == 3_000:
        sizes = [sum(r["size"] or 0 for r in got if r["shard"] == s) for s in range(8)]
        assert max(sizes) - min(sizes) <= 2 * 4_000


def test_no_character_maps_over_whole_texts(spark):
    """``translate`` costs tens of nanoseconds a character; only lines that are not plain ASCII go through it, with the same results."""
    texts = ["A b\tC", "ÉA İ Z", "Kelvin K", "    ", "", " \t\x0b", "a#b $ \U0001f600 *"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert "translate" not in df.select(*line_rules.measures(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    lowered = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in texts]
    want = [re.sub("[ \t-\r]+", " ", t).strip(" ") for t in lowered]
    assert [r[0] for r in df.select(line_rules.normal(F.col("text"))).collect()] == want
    assert [r[0] for r in df.select(F.size(line_rules.lines_of(F.col("text")))).collect()] == [1, 1, 1, 1, 0, 0, 1]
