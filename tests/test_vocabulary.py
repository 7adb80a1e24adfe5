"""The vocabulary of n-grams and its vectors against plain counting."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from scrivenry.operators import classify, vocabulary


def grams(text, low, high):
    return Counter(text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1))


def code(gram):
    return int(vocabulary.codes(gram, len(gram), len(gram))[0])


def texts():
    rng = random.Random(9)
    letters = "eeeeettttaaooiinnshrdlu \n😀é漢"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(150)] + ["", "a", None, "zz" * 400]


@pytest.mark.parametrize(("low", "high", "size", "least", "capacity"), [(2, 3, 200, 3, None), (2, 3, 50, 1, 60), (1, 2, 10_000, 2, 40), (2, 4, 300, 3, 500)])
def test_the_vocabulary_is_exact(spark, monkeypatch, low, high, size, least, capacity):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartition(40)
    made, plain = [], vocabulary.summary
    monkeypatch.setattr(vocabulary, "summary", lambda *a: made.append(a[-1]) or plain(*a))
    found, docs, n = vocabulary.most_frequent(df, "text", low, high, size, least, capacity)
    times, held = Counter(), Counter()
    for t in rows:
        own = grams(t or "", low, high)
        times.update(own)
        held.update(own.keys())
    want = sorted((-c, code(g), held[g]) for g, c in times.items() if held[g] >= least)[:size]
    assert list(zip(found.tolist(), docs.tolist(), strict=True)) == [w[1:] for w in want] and n == len(rows)
    assert capacity is None or len(made) > 1  # the first summary was too small


def test_a_summary_says_what_it_lost():
    rng = np.random.default_rng(1)
    parts = [rng.zipf(1.3, 3000).astype(np.uint64) for _ in range(20)]
    own = vocabulary.Summary(100)
    for half in (parts[:10], parts[10:]):
        other = vocabulary.Summary(100)
        for p in half:
            other.add(*np.unique(p, return_counts=True))
        own.add(other.codes, other.counts, other.lost)
    true = Counter(np.concatenate(parts).tolist())
    kept = dict(zip(own.codes.tolist(), own.counts.tolist(), strict=True))
    assert len(kept) <= 100 and own.lost > 0
    assert all(kept.get(c, 0) <= n <= kept.get(c, 0) + own.lost for c, n in true.items())


def test_vectors(spark):
    rows = texts()
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartition(3)
    made = {r.id: r for r in classify.tfidf(df, "text", "v", classify.Vectors(features=120, least_docs=2)).collect()}
    held = Counter(g for t in rows for g in grams(t or "", 2, 3))
    kept = sorted((-sum(grams(t or "", 2, 3)[g] for t in rows), code(g), g) for g, n in held.items() if n >= 2)[:120]
    number = {g: i for i, (_, _, g) in enumerate(kept)}
    assert len(made) == len(rows)
    for i, t in enumerate(rows):
        w = {number[g]: (1 + math.log(c)) * (math.log((1 + len(rows)) / (1 + held[g])) + 1) for g, c in grams(t or "", 2, 3).items() if g in number}
        length = math.sqrt(sum(x * x for x in w.values())) or 1.0
        v = made[i].v
        assert made[i].text == t and v.size == 120 and list(v.indices) == sorted(w)
        assert np.allclose(v.values, [w[k] / length for k in sorted(w)])
