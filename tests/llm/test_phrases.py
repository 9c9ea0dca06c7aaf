"""Collocations against a plain count, tries against a dictionary, and odd rows."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tablewarden.llm import phrases


def brute(rows, top, least=10, longest=3, covered=50):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                counts.setdefault((lang, m), Counter()).update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang in n:
        f = {p: c for m in range(1, longest + 1) for p, c in counts.get((lang, m), {}).items()}
        often = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        hidden = {p[i:i + m] for p, c in often.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * c >= covered * f[p[i:i + m]]}
        rows = []
        for p, a in often.items():
            if p not in hidden:
                s, k = min((int(Fraction(1_000_000 * a * a, f[p[:k]] * f[p[k:]])), k) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def drawn(rng, count):
    words = ["the", "The", "river", "bank", "of", "Zoë's", "a.b", "x,y", "new", "york", "city\tline", " ", "end.\n", "stop\r", "naïve"]
    return [(rng.choice(["en", "de", None]), " ".join(rng.choice(words[:rng.choice([4, 15])]) for _ in range(rng.randrange(60)))) for _ in range(count)]


@pytest.mark.parametrize("shard", [phrases.SHARD, 3])
def test_collocations(spark, shard):
    rows = drawn(random.Random(4), 120) + [("en", None), ("en", ""), (None, " \n ")] + [("fr", "same row here again")] * 12
    docs = spark.createDataFrame([(lang, text, "clash", "clash") for lang, text in rows], "lang string, text string, code string, w1 string").repartition(5)
    for top in (2_000, 4):
        got = phrases.collocations(docs, top, shard=shard)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute(rows, top)
        if shard != 3:
            break


def test_longer_phrases(spark):
    rows = drawn(random.Random(9), 60)
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), 50, least=6, longest=4, covered=80).collect()
    assert sorted(map(tuple, got)) == brute(rows, 50, 6, 4, 80)


def test_long_texts_and_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(phrases, "WINDOW", 50)
    assert sorted(map(tuple, phrases.collocations(odd, 100).collect())) == brute([(r["lang"], r["text"]) for r in odd.collect()], 100)
    assert phrases.collocations(none, 10).count() == 0
    assert phrases.collocations(odd.where("lang = 'de'"), 10).count() == 0
    blob = b"ab cd,ef  gh" * 50 + b"x" * 300 + b" end"
    whole, parts = phrases._words(blob), phrases._words(blob, 7)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_trie():
    rng = np.random.default_rng(3)
    for n, vocabulary, length in [(1, 1, 2), (40, 7, 2), (900, 40, 3), (6_000, 700, 2), (3_000, 70_000, 3)]:
        words = np.unique(rng.integers(1, 2 ** 63, vocabulary).astype(np.uint64))
        listed = np.unique(words[np.minimum((rng.pareto(0.8, (n, length)) * 2).astype(int), len(words) - 1)], axis=0)
        trie = phrases.Trie(listed).arrays()
        codes = np.concatenate([words[np.minimum((rng.pareto(0.8, 5_000) * 2).astype(int), len(words) - 1)], listed.ravel(), np.zeros(2, np.uint64)])
        seen = Counter(tuple(codes[i:i + length].tolist()) for i in range(len(codes) - length + 1))
        counts = np.bincount(phrases.accepting(trie, codes), minlength=len(trie["base"]))[trie["accepts"]]
        assert counts.tolist() == [seen[tuple(p)] for p in trie["phrases"].tolist()]
        assert len(phrases.accepting(trie, codes[:length - 1])) == 0
