"""Every registered query of the training-data operators, over whole tables, against its contract."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from scrivenry.llm import decontam, queries
from test_text_matching import base_spans, brute_components, distance, plain_order_minhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return sorted((r["doc_id"], r["text"] or "") for r in rows)


def result(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def encoded(name, docs, end):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer(name))
    return {i: np.array([*library.encode(t, add_special_tokens=False).ids, end], "<u4") for i, t in docs}


def test_op1(spark, docs):
    ids, at = encoded("word_bpe_49k.json", docs, 2), 0
    found = sorted(result(spark, "op1_token_files"), key=lambda r: r.doc_id)
    for r, (i, _) in zip(found, docs, strict=True):
        assert tuple(r)[:4] == (i, at, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        at += len(ids[i])


def test_op2(spark, docs):
    from scrivenry.llm.encoding import Encoder

    encoder, texts = Encoder.of(queries.tokenizer("byte_bpe_50k.json")), dict(docs)
    found = result(spark, "op2_edit_counts")
    assert len(found) == len(docs)
    for r in found:
        t = texts[r.doc_id]
        assert r.n_tokens == len(encoder.ids([t])[0])
        for begin, end, new in standard(t):
            t = t[: min(begin, len(t))] + new + t[min(max(begin, end), len(t)) :]
        assert (r.n_tokens_edited, r.n_chars_edited, r.n_edits) == (len(encoder.ids([t])[0]), len(t), 3)


def standard(t):
    n = len(t)
    last = max(0, n - 40)
    return [(n // 2, n // 2 + n // 50, ""), (n // 3, n // 3, t[:100]), (last, last + 20, t[last : last + 20].upper())]


def test_op3(spark, docs):
    found = defaultdict(dict)
    for r in result(spark, "op3_decontamination"):
        found[r.doc_id][r.item_id] = (r.distance, r.begin, r.end)
    items = [(r["item_id"], decontam.normal(r["text"]).strip()) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist() if r["text"]]
    for i, t in docs[::4]:
        t = decontam.normal(t)
        near = {n: decontam.myers(x, t)[0] for n, x in items if x}
        assert {n: d for n, (d, _, _) in found[i].items()} == {n: d for n, d in near.items() if d <= int(0.1 * len(dict(items)[n]))}
    for i in found:
        for n, (d, begin, end) in found[i].items():
            assert distance(dict(items)[n], decontam.normal(dict(docs)[i])[begin:end])[0] == d


def test_op4(spark, docs):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in result(spark, "op4_near_duplicates")} == brute_components(docs, 3, 85)


def test_op5(spark, docs):
    ids, pieces, sequences = encoded("byte_bpe_50k.json", docs, 0), defaultdict(list), defaultdict(list)
    for r in result(spark, "op5_packing"):
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, own in ids.items():
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(own)
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024 and ends[-1] & (ends[-1] - 1) == 0


def test_op6(spark, docs):
    plain = {}
    sketch = lambda t: plain.setdefault(t, plain_order_minhash(t))
    found = sorted(result(spark, "op6_fingerprints"), key=lambda r: r.doc_id)
    for k, (r, (i, t)) in enumerate(zip(found, docs, strict=True)):
        following, half = docs[(k + 1) % len(docs)][1], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (i, len(t), hashlib.sha256(edited.encode()).hexdigest())
        if t.isascii() and following.isascii() and len(t) < 3000:
            assert r.fingerprint == "".join(f"{v:08X}" for v in sketch(t)) and r.edited_fingerprint == "".join(f"{v:08X}" for v in sketch(edited))
            if sketch(t) and sketch(following):
                assert r.near_next == sum(x == y for x, y in zip(sketch(t), sketch(following), strict=True)) / 64


def test_op7(spark, docs):
    langs = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    found = result(spark, "op7_language")
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in dict(docs)[r.doc_id]))
    held = [r for r in found if r.held_out and langs[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held) > 20


def test_op8(spark, docs):
    texts = dict(docs)
    for r in result(spark, "op8_secrets"):
        base = base_spans(texts[r.doc_id])
        kinds = [s.split(":")[0] for s in base.split(",") if s]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_op9_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op9_warc"]).fetchall())
    assert sorted(map(tuple, result(spark, "op9_warc"))) == want and len(want) > 20


def test_op10(spark, docs):
    texts, sizes, slots = dict(docs), defaultdict(int), defaultdict(list)
    found = result(spark, "op10_sharding")
    assert sorted(r.doc_id for r in found) == [i for i, _ in docs]
    for r in found:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean, largest = sum(sizes.values()) / 24, max(len(t.encode()) + 8 for _, t in docs)
    assert set(sizes) == set(range(24)) and max(abs(s - mean) for s in sizes.values()) <= max(0.02 * mean, 2 * largest)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline_runs_over_whole_tables(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, SF).collect()
    assert len({r.doc_id for r in found}) > 50 and len({(r.sequence_id, r.offset) for r in found}) == len(found)
