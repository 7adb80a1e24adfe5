"""WARC archives, sharding, and the pipeline."""

import gzip
import io
import random

import pytest
from scrivenry.llm import histsort, warc

PAGES = "page_id long, url string, html string, payload string, sha1 string"


def test_warc_round_trip(spark):
    big = "".join(chr(random.Random(1).randint(32, 0x2FF)) for _ in range(200_000))
    html = [None, "", "a", "a", "b", big, "é\r\n\r\nx", big, "\x1f\x8b\x08 magic"]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\n", h, "", "") for i, h in enumerate(html)] + [(30, None, "a", "", "")], PAGES)
    manifest = warc.write_warc(pages)
    rows = {r.page_id: r for r in warc.read_warc(manifest, split_bytes=97).collect()}
    html = dict(enumerate(html)) | {30: "a"}
    assert rows.keys() == html.keys()
    for i, h in html.items():
        data = (h or "").encode()
        newest = max(k for k, v in html.items() if (v or "") == (h or ""))
        assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(data), warc.payload_digest(data))
        assert (rows[i].record_type, rows[i].refers_to) == (("response", None) if newest == i else ("revisit", newest))
        assert rows[i].payload == (bytearray(data) if newest == i else None)
    kinds = {r.page_id: r.record_type for r in warc.read_warc(warc.write_warc(pages, least_bytes=2)).collect()}
    assert kinds[2] == kinds[3] == kinds[0] == "response" and kinds[5] == "revisit"


@pytest.mark.parametrize("step", [1, 7, 1000, 10**9])
def test_each_record_has_one_owner(tmp_path, step):
    data = b"".join(warc._record(i, "u", (b"\x1f\x8b\x08" * i + b"text"), "d", None) for i in range(30))
    data = b"junk" + data[:400] + data[400:] + gzip.compress(b"not a record") + warc._record(99, "u", b"z", "d", None)[:-9]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    step = max(step, len(data) // 300)
    found = [(f.get("WARC-Record-ID"), at) for a in range(0, len(data), step) for f, _, at in warc.read_range(str(path), a, min(a + step, len(data)))]
    assert [i for i, _ in found if i] == [f"<urn:page:{i}>" for i in range(30)]
    # What can't be read is reported once each: before the first record, the other member, the record cut off.
    odd = data.index(gzip.compress(b"not a record")[10:]) - 10
    assert [at for i, at in found if i is None] == [0, odd, data.index(warc._record(99, "u", b"z", "d", None)[:-9])]


def test_broken_members_are_counted(spark, tmp_path):
    good = [warc._record(i, "u", b"text %d" % i, warc.payload_digest(b"text %d" % i), None) for i in range(6)]
    bad = bytearray(good[2])
    bad[-12] ^= 0xFF
    data = good[0] + good[1] + bytes(bad) + good[3] + b"??" + good[4] + good[5][: len(good[5]) // 2]
    path = tmp_path / "y.warc.gz"
    path.write_bytes(data)
    manifest = spark.createDataFrame([(str(path), len(data))], "path string, size long")
    for split in (50, 10**6):
        rows = warc.read_warc(manifest, split_bytes=split, broken="keep").collect()
        assert sorted(r.page_id for r in rows if r.record_type != "broken") == [0, 1, 3, 4]
        places = sorted(r.offset for r in rows if r.record_type == "broken")
        assert len(places) == 3 and places[0] == len(good[0] + good[1]) and places[1] == len(good[0] + good[1] + good[2] + good[3])
    with pytest.raises(Exception, match="at byte"):
        warc.read_warc(manifest).collect()


def test_records_of_other_writers(spark, tmp_path):
    def record(kind, block, **fields):
        head = "WARC/1.0\r\nWARC-Type: " + kind + "".join(f"\r\n{k.replace('_', '-')}: {v}" for k, v in fields.items()) + f"\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"
    records = [record("warcinfo", b"software: x"), record("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"), record("response", http, Content_Type="application/http", WARC_Record_ID="<urn:uuid:1>"), record("metadata", b"")]
    with_name = io.BytesIO()
    with gzip.GzipFile(filename="n" * 3000, mode="wb", fileobj=with_name) as f:  # a gzip header of 3,000 bytes
        f.write(record("response", http, Content_Type="application/http", WARC_Payload_Digest="md5:00"))
    data = b"".join(map(gzip.compress, records)) + with_name.getvalue()
    path = tmp_path / "z.warc.gz"
    path.write_bytes(data)
    manifest = spark.createDataFrame([(str(path), len(data)), (None, 5)], "path string, size long")
    rows = sorted(warc.read_warc(manifest, split_bytes=64).collect(), key=lambda r: r.offset)
    assert [r.record_type for r in rows] == ["warcinfo", "request", "response", "metadata", "response"]
    assert [bytes(r.payload) for r in rows] == [b"software: x", b"", b"body", b"", b"body"] and {r.page_id for r in rows} == {None}
    assert rows[4].payload_digest == warc.payload_digest(b"body")


def test_pages_with_nulls_repeats_and_other_columns(spark):
    pages = spark.createDataFrame([(None, None, "same", 1), (1, "u", "same", 2), (1, "u", "same", 2), (2, "é u", None, 3), (None, "v", "own", 4)], "page_id long, url string, html string, refers_to long")
    rows = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(warc.write_warc(pages)).collect()), key=str)
    assert rows == sorted([(0, "revisit", 1, 4), (1, "response", None, 4), (1, "response", None, 4), (2, "response", None, 0), (0, "response", None, 3)], key=str)


def test_warc_of_nothing(spark):
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], PAGES))).count() == 0


def check_shards(found, shards, slack):
    sizes, slots = [0] * shards, [[] for _ in range(shards)]
    for r in found:
        sizes[r.shard] += r.shard_size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    mean = sum(sizes) / shards
    assert all(abs(s - mean) <= slack for s in sizes), sizes


def test_shards_are_near_equal(spark):
    rng = random.Random(2)
    texts = ["w" * rng.randint(0, 300) + str(i) for i in range(3000)] + ["copy" * 20] * 1500 + [None, ""]
    rows = [(i, t, 0, "keep") for i, t in enumerate(texts)] + [(None, "null id", 0, "keep")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int, extra string")
    found = histsort.shard(docs, shards=8)
    assert set(found.columns) == {"doc_id", "text", "extra", "shard_size", "shard", "slot"}
    rows_found = found.collect()
    assert len(rows_found) == len(rows)
    mean = sum(r.shard_size for r in rows_found) / 8
    check_shards(rows_found, 8, 2 * 0.01 * mean)  # each splitter is within 1 % of a share
    assert sum(r.shard_size for r in rows_found) == sum(len((t or "").encode()) + 8 for _, t, _, _ in rows)


def test_small_groups_of_equal_texts_share_a_shard(spark):
    docs = spark.createDataFrame([(i, f"text number {i // 3}") for i in range(3000)], "doc_id long, text string")
    homes = {}
    for r in histsort.shard(docs, shards=6).collect():
        homes.setdefault(r.text, set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


@pytest.mark.parametrize("rows", [[], [(1, "a")], [(5, "same")] * 40])
def test_shards_of_little(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = histsort.shard(docs, shards=5).collect()
    assert len(found) == len(rows)
    for s in {r.shard for r in found}:
        own = sorted(r.slot for r in found if r.shard == s)
        assert own == list(range(len(own)))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(8)
    vocabulary = ["stone", "river", "house", "green", "walks", "under", "light", "moves", "seven", "horse", "winter", "glass"]
    text = lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))
    item = text(25, 777)
    rows = [(i, text(60 + i, i), "aa", "s", 0) for i in range(30)]
    rows += [(100 + i, text(60, 5000), "aa", "s", 0) for i in range(4)]  # copies
    rows += [(200, text(10, 1) + " " + item, "aa", "s", 0), (201, "123 456 !!", "aa", "s", 0), (202, None, None, None, None)]
    rows += [(203, "password=abcdefgh " + text(40, 9), None, "s", 0)]
    rng.shuffle(rows)
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.collect()})
    every = {r[0] for r in rows}
    assert kept[0] == every - {201, 202}
    assert kept[1] == kept[0] - {101, 102, 103}
    assert kept[2] == kept[1] - {200}
    assert kept[3] == kept[2]
    hidden = docs.where("doc_id = 203").first()
    assert hidden.text.startswith("[secret] ") and hidden.n_chars == len(hidden.text)
    assert {r.doc_id for r in pipeline.run(spark, sf).collect()} == kept[3]
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "secret_scan", "packing"] and pipeline.ORACLE_SQL is None


def test_sharding_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50}", "KEEP", "p", i) for i in range(500)] + [(None, None, None, None, None)] * 3, "doc_id long, text string, __key string, __part string, __row long")
    found = histsort.shard(docs, shards=5).collect()
    assert sorted(((r.doc_id, r["__key"], r["__part"], r["__row"]) for r in found), key=str) == sorted(((r.doc_id, r["__key"], r["__part"], r["__row"]) for r in docs.collect()), key=str)
    check_shards(found, 5, 10**9)


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, __key string, spans string"
    one = " ".join(f"river{i % 7} stone{i % 11}" for i in range(60))
    many = [(1, one, "aa", "s", 1, "k", "x")] * 3 + [(None, one, "aa", "s", 1, "k", None), (4, None, None, None, None, None, None), (5, "other words entirely here", "aa", "s", 0, "q", "y")]
    for name, rows in (("none", []), ("odd", many)):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        for _, stage in pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        kept = sorted(((r.doc_id or 0, r["__key"], r.spans) for r in docs.collect()), key=str)
        assert kept == ([] if name == "none" else sorted([(0, "k", None), (1, "k", "x"), (5, "q", "y")], key=str))
        assert {r.doc_id for r in pipeline.run(spark, sf).collect()} == (set() if name == "none" else {None, 1, 5})


def test_scratch_tables_go(spark):
    import os

    from scrivenry.llm import common

    root = common.shared_dir(spark).removeprefix("file://")
    with common.Scratch(spark) as tables:
        a, b = common.stored(spark.range(3).toDF("n"), "gone"), common.stored(spark.range(3).toDF("n"), "kept")
        tables.keep(b)
    assert b.count() == 3 and not [d for d in os.listdir(root) if d.startswith("scrivenry-gone")] and a.columns == ["n"]
