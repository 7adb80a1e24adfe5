"""Fill-in-middle, line deduplication and collocations against plain versions and their SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from scrivenry.llm import collocations, fim, linedup, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_collocations", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, want.fetchall()))


# Fill-in-middle


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab <>PSM\ńé"), max_size=30), st.integers(0, 500), st.sampled_from([*fim.UNITS, r"\d+"]))
def test_cut_and_rebuilt(text, doc_id, unit):
    n, form, prefix, middle, output = fim.cut(text, doc_id, unit=unit)
    found = fim.ends(text, unit)
    assert len(found) == n and list(found) == sorted(set(found)) and (not text or found[-1] == len(text))
    assert fim.rebuilt(output, form) == text
    if form != "plain":
        assert {prefix, prefix + middle} <= {0, *found} and len(output) == len(text) + 9


def test_fill_in_middle_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a<M>b"), (4, "é" * 50), (None, "null id"), (7, "same"), (7, "same"), (8, "x" * 300_000), (9, "\U0001f600 smile")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("form", F.lit("clash")).withColumn("n", F.lit(0))
    found = fim.transformed(docs).collect()
    assert len(found) == len(rows)
    by = {(r.doc_id, r.n): r for r in found}
    for i, t in rows:
        r, n = by[i, len(t or "")], len(t or "")
        want = fim.cut(t or "", i)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
        assert r.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and r.output_sha256 == hashlib.sha256(want[4].encode()).hexdigest()
        assert n or r.form == "plain"
    back = fim.transformed(docs).select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text"))
    assert Counter(map(tuple, back.collect())) == Counter((i, t or "") for i, t in rows)
    assert fim.transformed(docs.where("false")).collect() == []
    for marks in (("<P>", "<P>", "<M>"), ("<P>", "P>x", "<M>"), ("aba", "<S>", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.rearranged(F.col("doc_id"), F.col("text"), marks=marks)
    with pytest.raises(ValueError):
        fim.ends("abc", "x*")


# Lines


def test_cuckoo_filter_adds_and_removes():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys[1::2] = keys[::2] ^ np.uint64(1 << 40)  # equal prints and buckets
    keys = np.unique(keys)
    f = linedup.Cuckoo.of_size(len(keys))
    assert f.add(keys) and f.has(keys).all()
    f = linedup.Cuckoo.of_bytes(f.tobytes())
    other = rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert f.has(other).mean() < 0.001
    f.remove(keys[::3])
    left = np.delete(keys, np.arange(0, len(keys), 3))
    assert f.has(left).all() and np.count_nonzero(f.table) == len(left)
    f.remove(left)
    assert not f.table.any()
    with pytest.raises(ValueError):
        f.remove(keys[:1])
    assert not linedup.Cuckoo.of_size(100).add(keys)


def plain_lines(rows, known=None, chars=20, copies=3):
    """{(doc_id, text): Counter of (left, n_lines, n_dropped)} by dictionaries."""
    key = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t.strip(" \t\n\v\f\r"))
    held = defaultdict(set)
    for i, t in known if known is not None else rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                held[key(line)].add(i)
    newest = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= copies}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if key(x) not in newest or newest[key(x)] == i]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return Counter(out)


def random_docs(rng, ids):
    lines = [f"{c * 19}{k}" for k in range(8) for c in "aBé"] + ["short", "", "  "]
    some = lambda: "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str.lower])(rng.choice(lines)) + rng.choice(["", "\r"]) for _ in range(rng.randint(0, 9)))
    return [(i, some()) for i in ids]


def answers(df):
    return Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect())


def test_line_index_is_reversible(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linedup, "SHARD_KEYS", 8)  # several shards
    rng = random.Random(5)
    index = linedup.LineIndex(spark, f"file://{tmp_path}/lines")
    first, second = random_docs(rng, range(30)), random_docs(rng, [*range(40, 60), None, None])
    frame = lambda rows: spark.createDataFrame(rows, DOCS)
    index.add(frame(first))
    assert answers(index.cleaned(frame(first), indexed=True)) == plain_lines(first)
    before = sorted(index.counts().collect())
    index.add(frame(second))
    index.add(frame(second[:5]))  # nothing new
    assert answers(index.cleaned(frame(first + second))) == plain_lines(first + second)
    assert index.state()["shards"] > 1
    fresh = random_docs(rng, [7, 100, 101])  # not in the index, or there with another text
    assert answers(index.cleaned(frame(fresh))) == plain_lines(fresh, first + second)
    index.remove(frame(second).select("doc_id").union(spark.createDataFrame([(999,), (40,), (None,)], "doc_id long")))
    left = first + [r for r in second if r[0] is None]
    assert answers(index.cleaned(frame(left))) == plain_lines(left)
    index.remove(frame(first[20:]).select("doc_id"))
    left = first[:20] + [r for r in second if r[0] is None]
    assert answers(index.cleaned(frame(left))) == plain_lines(left)
    index.add(frame(first[20:]))
    again = linedup.LineIndex(spark, f"file://{tmp_path}/other")
    again.add(frame(first))
    assert sorted(again.counts().collect()) == before
    assert answers(index.cleaned(frame(first + second[-2:]))) == plain_lines(first + second[-2:])


def test_a_change_that_stops_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    index = linedup.LineIndex(spark, f"file://{tmp_path}/lines")
    rows = random_docs(random.Random(6), range(20))
    index.add(spark.createDataFrame(rows, DOCS))
    monkeypatch.setattr(index, "_commit", lambda state: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.remove(spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert answers(index.cleaned(spark.createDataFrame(rows, DOCS))) == plain_lines(rows)


def test_line_dedup_of_odd_rows(spark):
    common = "This very common line is in all of them"
    rows = [(i, f"{common}\nown line {i}") for i in range(400)] + [(5, common), (5, f" {common.upper()}\t\n{common}"), (399, common), (None, common), (None, None), (500, None), (501, ""), (502, "\n\n"), (503, "y" * 500_000 + "\n" + common + "\n" + common)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("hi", F.lit("clash")).withColumn("n_lines", F.lit(0))
    assert answers(linedup.deduplicated(docs)) == plain_lines(rows)
    assert linedup.deduplicated(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        linedup.LineIndex(spark, "/nowhere", copies=1)


# Phrases


def plain_collocations(rows, longest, least, within, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f[lang].update(" ".join(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, count in f.items():
        frequent = {p: a for p, a in count.items() if a >= least and " " in p}
        found = []
        for p, a in frequent.items():
            w = p.split(" ")
            if any(100 * b >= within * a for q, b in frequent.items() if q != p and f" {p} " in f" {q} " and len(q.split(" ")) > len(w)):
                continue
            score, _, left, right = min((1_000_000 * a * a // (count[" ".join(w[:k])] * count[" ".join(w[k:])]), k, count[" ".join(w[:k])], count[" ".join(w[k:])]) for k in range(1, len(w)))
            found.append((-score, -a, p.encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("longest", "least", "within", "top"), [(3, 10, 50, 2000), (4, 3, 80, 7), (2, 2, 50, 100), (3, 300, 50, 10)])
def test_collocations_equal_a_plain_version(spark, monkeypatch, longest, least, within, top):
    monkeypatch.setattr(collocations, "SLOTS", 100)  # several shards
    rng = random.Random(longest)
    words = ["the", "The", "of", "new", "york", "city", "été", "Été", "x y", "12", "-"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r"]) for _ in range(rng.randint(0, 60)))
    rows = [(rng.choice(["en", "en", "fr", None, "und"]), text()) for _ in range(300)] + [("de", None), ("de", ""), (None, None), ("en", "new york " * 5000), ("es", ".,;"), ("fr", "a b.c d " * 700_000)]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit("clash")).withColumn("doc_id", F.lit(1)).repartition(5)
    found = sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(docs, longest, least, within, top).collect())
    assert found == plain_collocations(rows, longest, least, within, top)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([("en", "one two"), (None, None)], "lang string, text string")
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(docs.where("false")).collect() == []


@settings(max_examples=20, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3)), max_size=3000))
def test_perfect_hash_is_minimal(keys):
    hi, lo = (np.array([k[i] for k in sorted(keys)], np.uint64) for i in (0, 1))
    made = collocations.PerfectHash.build(hi, lo)
    assert sorted(made.slots(hi, lo).tolist()) == list(range(len(keys)))
    assert (made.slots(hi, lo + np.uint64(9)) < max(len(keys), 1)).all()


def test_scores_are_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(9_000_000_000_000, 9_000_000_000_001, 9_000_000_000_007)], "a long, l long, r long").select(F.expr(collocations.SCORE).alias("score")).first()
    assert row.score == 1_000_000 * 9_000_000_000_000**2 // (9_000_000_000_001 * 9_000_000_000_007)
