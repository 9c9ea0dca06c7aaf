"""Near-duplicates against all pairs, with limits low enough that nodes branch and groups are dealt in blocks."""

import itertools
import math
import random

import pytest

from tablewarden.llm import near_dup


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(seed):
    rng, out = random.Random(seed), []
    vocabulary = ["w%d" % k for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 40, 150]))]
        for _ in range(rng.choice([1, 2, 25])):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
    out += [" ".join(passage + [rng.choice(vocabulary) for _ in range(n)]) for n in (0, 5, 12, 16, 40, 80)]
    out += [out[0]] * 7 + ["", "  \n", out[3].upper(), out[3].replace(" ", "\n\t")]
    rng.shuffle(out)
    return list(enumerate(out, start=100))


@pytest.mark.parametrize("percent,leaf,block", [(80, 4_000, 1_000), (85, 5, 4)])
def test_against_all_pairs(spark, percent, leaf, block):
    rows = corpus(percent)
    got = near_dup.resolve(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), percent, leaf, block).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute(rows, percent) and len(got) == len(rows)


@pytest.mark.parametrize("template,shared", [(60, 24), (44, 40)])
def test_recall_in_large_nodes(spark, template, shared):
    """Different texts with a long template: nodes of its tokens are large. Every text has one partner, of similarity 0.8 exactly."""
    rng, rows = random.Random(3), []
    head = ["t%d" % k for k in range(template)]
    for pair in range(1_500):
        own = [f"p{rng.random()}" for _ in range(shared)]
        rows += [(2 * pair + k, " ".join(head + own + [f"u{rng.random()}" for _ in range(10)])) for k in range(2)]
    got = near_dup.resolve(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 80, leaf=60).collect()
    lost = sorted(r["doc_id"] for r in got if r["component_id"] != r["doc_id"] - r["doc_id"] % 2)
    assert len(got) == 3_000 and len(lost) <= 1, lost


def test_branching_has_tokens_for_every_tree():
    assert near_dup.PATH == near_dup.TREES * (1 + near_dup.FAN * near_dup.DEPTH) <= near_dup.TOKENS
    lost = 1 - (1 - 0.2 ** near_dup.FAN) ** near_dup.DEPTH
    assert (0.2 + 0.8 * lost) ** near_dup.TREES < 3e-6


def test_the_estimate_drops_few_pairs_at_the_threshold():
    n = near_dup.TOKENS
    for s in (0.8, 0.85):
        assert sum(math.comb(n, k) * s ** k * (1 - s) ** (n - k) for k in range(n) if k < (s - near_dup.MARGIN) * n) < 2e-6


def test_odd_rows(spark, odd, none):
    got = sorted((tuple(r) for r in near_dup.resolve(odd).collect()), key=str)
    by = {r[0]: r[1:] for r in got}
    assert len(got) == 13 and by[1] == by[2][:0] + (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True)
    assert by[4] == (1, 4, True) and by[5] == (1, 4, False) and by[7] == (1, 7, True) and by[10][1:] == (9, False)
    assert by[None] == (4, None, True) and by[6][0] == 2
    assert near_dup.resolve(none).count() == 0 and near_dup.keep(none).columns == odd.columns
    kept = near_dup.keep(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 7, 8, 9, 11, None]))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 40)] + [(7, 7), (200, 201), (201, 200)]
    random.Random(1).shuffle(edges)
    got = {r["id"]: r["root"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 40)}, 201: 200}
