"""Registered queries against plain versions over whole tables."""

import random
from collections import Counter

import pytest
from scrivenry.operators import classify
from scrivenry.plans.registry import QUERIES


def test_gram_jaccard_takes_whole_texts(spark, tmp_path):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gam ma", "delta\n"]) + str(rng.randint(0, 99)) for _ in range(n))
    head, tail = words(60), words(90)
    texts = {0: head + words(90), 20: head + words(90), 1: words(60) + tail, 21: words(60) + tail, 2: "ab c", 22: "a bc", 3: "", 23: " \n", 4: "short text one", 24: "short text two", 5: words(9), 45: words(9), 6: "a😀b😀c d\n😀e", 26: "a😀b😀c d😀f"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def grams(text):
        t = "".join(text.split())
        return {t[i : i + 5] for i in range(len(t) - 4)} or {t} - {""}

    plain = {(a, a + 20): (len(x & y) / len(x | y) if x | y else 1.0) for a in texts if a + 20 in texts for x, y in [(grams(texts[a]), grams(texts[a + 20]))]}
    found = {(r.doc_id, r.other): r.jaccard for r in QUERIES["gram_jaccard"](spark, str(tmp_path)).collect()}
    assert found == pytest.approx(plain, abs=1e-6)
    assert found[0, 20] < 0.9 and found[1, 21] > 0.1 and found[2, 22] == 1.0


def test_missing_ids_compares_whole_tables(spark, tmp_path):
    spark.range(0, 300).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(0, 300, 3).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/labels.parquet")
    found = sorted(r.doc_id for r in QUERIES["missing_ids"](spark, str(tmp_path)).collect())
    assert found == [i for i in range(300) if i % 3]


def test_tfidf_classifier_has_the_whole_vocabulary_and_five_folds(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghijklmno \n😀") for _ in range(900)) for _ in range(30)] + ["", "a"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(32)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    monkeypatch.setattr(classify, "evaluate", lambda df, *_, k=3, **__: [seen.update(k=k, size=df.first()["features"].size)])
    QUERIES["tfidf_classifier"](spark, str(tmp_path))
    docs = Counter(g for t in texts for g in {t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)})
    plain = sum(n >= 3 for n in docs.values())
    assert plain > 2000 and seen == {"k": 5, "size": plain}
