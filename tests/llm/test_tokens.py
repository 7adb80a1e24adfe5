"""Token files, counts and packing against the library itself."""

import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from scrivenry.llm import packing, simple8b, tokencount
from scrivenry.llm.encoding import Encoder, kind_of
from scrivenry.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, start string, shard string"
TEXTS = [None, "", " ", "Hello, world! don't", "a  b\n\n c\t", "é ́x İX ² ſ", "日本語 のテキスト", "x\x1cy z", "hi <|endoftext|>  there", "12 345 6!!", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def ids_of(library, name, text):
    return library[name].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(library, name):
    random.seed(3)
    texts = TEXTS + ["".join(random.choice(" \t\nabÉ'sd1,.²ªſIK̇\u0085́日<|") for _ in range(random.randint(0, 40))) for _ in range(800)]
    found = Encoder.of(tokenizer(name)).ids(texts)
    assert [x.tolist() for x in found] == [ids_of(library, name, t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**32 - 1)), max_size=400), st.integers(0, 200))
def test_block_round_trip(ids, run):
    ids = np.array(ids + [7] * run, np.uint32)
    data = simple8b.encode_block(ids)
    assert simple8b.decode_block(b"xx" + data, 2).tolist() == ids.tolist()


def test_files_round_trip(spark, library):
    rows = [(i, t, "a", "b") for i, t in enumerate(TEXTS)] + [(3, "again", "", ""), (None, "no id", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = [tuple(r) for r in simple8b.read_tokens(simple8b.write_tokens(docs, tokenizer("word_bpe_49k.json"), 2)).collect()]
    want, at = [], 0
    for doc_id, text, _, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*ids_of(library, "word_bpe_49k.json", text), 2]
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((d, n, c) for d, _, n, c in found if d is not None) == sorted(w for w in want if w[0] is not None)
    starts = sorted((s, n) for _, s, n, _ in found)
    assert [s for s, _ in starts] == [0, *np.cumsum([n for _, n in starts])[:-1].tolist()]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simple8b.read_tokens(simple8b.write_tokens(docs, tokenizer("word_bpe_49k.json"))).count() == 0
    assert packing.pack(docs, tokenizer("byte_bpe_50k.json")).count() == 0


def test_broken_file_is_refused(tmp_path):
    path = tmp_path / "x.s8b"
    with path.open("wb") as out:
        f = simple8b.TokenFile(out)
        f.add(1, np.arange(5, dtype=np.uint32))
        f.close()
    data = bytearray(path.read_bytes())
    data[-simple8b._TRAILER.size - 3] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError, match="whole"):
        list(simple8b.read_documents(str(path)))


def test_counts_follow_random_edits(library):
    encoder = Encoder.of(tokenizer("byte_bpe_50k.json"))
    random.seed(5)
    for text in TEXTS[:-1] + ["".join(random.choice("ab  c'\n.É<|") for _ in range(700)) for _ in range(12)]:
        tree, plain = tokencount.Counts(encoder, text), text or ""
        for _ in range(12):
            a, b = random.randint(0, len(plain) + 3), random.randint(0, len(plain) + 3)
            new = random.choice(["", " ", "x", " yz", "\n\n", "word " * 90, "<|endoftext|>"])
            tree.edit(a, b, new)
            low = min(a, len(plain))
            plain = plain[:low] + new + plain[min(max(low, b), len(plain)) :]
            assert tree.text() == plain
            assert tree.tokens == len(ids_of(library, "byte_bpe_50k.json", plain))


def test_edits_encode_little():
    tree = tokencount.Counts(Encoder.of(tokenizer("byte_bpe_50k.json")), "some words here " * 5000)
    tree.encoded = 0
    tree.edit(40_000, 40_005, "other")
    assert tree.encoded < 2500


def test_edit_columns_with_nulls(spark, library):
    rows = [(1, "one two three", [(0, 3, "four")]), (2, None, None), (3, "abc", [None, (None, None, None), (1, 2, None)]), (1, "one two three", [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<begin:long,end:long,text:string>>")
    found = sorted(tuple(r)[:5] for r in tokencount.count_edits(docs, tokenizer("byte_bpe_50k.json")).collect())
    n = lambda t: len(ids_of(library, "byte_bpe_50k.json", t))
    assert found == [(1, n("one two three"), n("one two three"), 0, 13), (1, n("one two three"), n("four two three"), 1, 14), (2, 0, 0, 0, 0), (3, n("abc"), n("ac"), 2, 2)]


def test_packing_covers_every_id_without_padding(spark, library):
    random.seed(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    texts = TEXTS + [" ".join(random.choices(words, k=random.randint(1, 1500))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    rows = packing.pack(docs, tokenizer("byte_bpe_50k.json"), shard_docs=20).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids, at = np.array([*ids_of(library, "byte_bpe_50k.json", text), 0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at & (at - 1) == 0 and at <= 1024


def test_neighbours_share_terms():
    terms = [np.array(t) for t in ([1, 2, 3], [7, 8, 9], [1, 2, 4], [7, 8, 5])]
    index = packing.Index(terms + [np.array([20 + i]) for i in range(6)], [np.ones(len(t)) for t in terms] + [np.ones(1)] * 6)
    scores = index.scores(0)
    assert scores[2] > 0 and scores[1] == 0
    assert packing.fill(index, [4, 4, 4, 4] + [0] * 6, 8) == [[(0, 0, 4), (2, 0, 4)], [(1, 0, 4), (3, 0, 4)]]


def plain_bm25(docs, query, corpus_docs):
    """BM25 of each document against the distinct terms of one, by dictionaries."""
    n, mean = len(corpus_docs), sum(sum(d.values()) for d in corpus_docs) / len(corpus_docs)
    df = Counter(t for d in corpus_docs for t in d)
    out = []
    for d in docs:
        total = 0.0
        for t in docs[query]:
            if t in d:
                weight = max(0.0, np.log((n - df[t] + 0.5) / (df[t] + 0.5)))
                total += weight * d[t] * (packing.K1 + 1) / (d[t] + packing.K1 * (1 - packing.B + packing.B * sum(d.values()) / mean))
        out.append(total)
    return out


def test_scores_equal_plain_bm25_over_the_corpus(spark):
    random.seed(4)
    corpus_docs = [{t: random.randint(1, 5) for t in random.sample(range(60 if i % 2 else 70000), 12)} for i in range(80)]
    corpus_docs[1][3] = 200_000  # more than two bytes hold
    parts = [Counter(t for d in corpus_docs[i::4] for t in d) | Counter({-2: 20, -1: sum(sum(d.values()) for d in corpus_docs[i::4])}) for i in range(4)]
    corpus = packing.statistics(spark.createDataFrame([r for p in parts for r in p.items()], "term long, n long"))
    own = corpus_docs[1::2]
    index = packing.Index([np.array(sorted(d)) for d in own], [np.array([d[t] for t in sorted(d)]) for d in own], corpus)
    for i in range(len(own)):
        assert index.scores(i) == pytest.approx(plain_bm25(own, i, corpus_docs))


def test_documents_of_a_subject_share_a_shard():
    idf = np.array([0.0, 1.0, 2.0, 3.0, 4.0, 5.0], np.float32)
    at = lambda *t: packing.place(np.array(sorted(t)), np.ones(len(t)), idf)
    assert at(0, 5, 1) >> 48 == at(5, 2) >> 48 != at(4, 1) >> 48 and at(0, 1, 2, 3, 4, 5) >> 16 == at(1, 2, 3, 4, 5) >> 16
    assert packing.place(np.array([0]), np.ones(1), idf) >= -(1 << 63)


def test_packing_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, f"words of row {i}", 1) for i in range(300)] + [(5, "again", 2)] * 4 + [(6, None, 3), (7, "a " * 300_000, 4)], "doc_id long, text string, place long")
    rows = packing.pack(docs, tokenizer("byte_bpe_50k.json"), shard_docs=20).collect()
    assert len({r.sequence_id for r in rows if r.doc_id is None}) > 1
    assert sum(r.start == 0 for r in rows if r.doc_id == 5) == 4 and sum(r.length for r in rows if r.doc_id == 7) == rows[[r.doc_id for r in rows].index(7)].doc_tokens
    assert [r.length for r in rows if r.doc_id == 6] == [1]
    assert packing.pack(docs.where("false"), tokenizer("byte_bpe_50k.json")).count() == 0


def test_token_files_of_odd_tables(spark, library):
    rows = [(None, "no number", 1), (-(1 << 63), "least", 2), (3, "b", 3), (3, "a", 4), (3, "a", 4), (9, None, 5), (4, "long " * 100_000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tie long")
    found = sorted((r for r in simple8b.read_tokens(simple8b.write_tokens(docs, tokenizer("word_bpe_49k.json"), shards=3)).collect()), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, -(1 << 63), 3, 3, 3, 4, 9]
    assert found[5].n_tokens == len(ids_of(library, "word_bpe_49k.json", rows[6][1])) + 1 and found[6].n_tokens == 1
    assert simple8b.read_tokens(simple8b.write_tokens(docs.where("false"), tokenizer("word_bpe_49k.json"))).count() == 0


def test_other_tokenizers_get_whole_texts(tmp_path, library):
    with open(tokenizer("byte_bpe_50k.json")) as f, open(tokenizer("word_bpe_49k.json")) as g:
        own, words = json.load(f), json.load(g)
    assert kind_of(own) == "byte" and kind_of(words) == "word"
    own["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(own))
    from tokenizers import Tokenizer

    whole, texts = Tokenizer.from_file(str(path)), ["one two", "  three\n", "", None, "日本"]
    encoder = Encoder.of(str(path))
    assert encoder.kind is None
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in encoder.ids(texts)] == want == [i.tolist() for i in encoder.column(pa.array(texts))]


def test_a_column_equals_the_library(library):
    rng = random.Random(11)
    bits = ["a", "Word", " ", " ", "  ", "\n", "\n\n", "'s", "'", "\t", "é", "İ", "1", "23", ".", ",", "!?", "...", "<|", "|>", "<|endoftext|>", "中", "。", "\r\n", "\x1c", "\x00", "\x01", "ŉ", "²"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + [None, "", "word " * 50_000]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        for t, found in zip(texts, Encoder.of(tokenizer(name)).column(pa.array(texts)), strict=True):
            assert found.tolist() == list(ids_of(library, name, t)), repr(t)


def test_bad_texts_leave_collection_on():
    import gc

    encoder = Encoder.of(tokenizer("byte_bpe_50k.json"))
    with pytest.raises(TypeError):
        encoder.raw(["fine", 5])
    assert gc.isenabled()


def test_edits_of_texts_without_spaces_stay_near(library):
    encoder = Encoder.of(tokenizer("byte_bpe_50k.json"))
    for text in ("這是一個句子。" * 4000, "aB3/x9Z+" * 4000, "a <| b " * 4000):
        tree = tokencount.Counts(encoder, text)
        tree.encoded = 0
        tree.edit(9000, 9003, "new")
        assert tree.encoded < 2000 and tree.tokens == len(ids_of(library, "byte_bpe_50k.json", text[:9000] + "new" + text[9003:]))
    joined = tokencount.Counts(encoder, "word " * 200 + "<|endo" + "ftext|> more")
    joined.edit(1006, 1006, "")
    assert joined.tokens == len(ids_of(library, "byte_bpe_50k.json", joined.text()))


def test_equal_input_gives_equal_trees():
    encoder, shape = Encoder.of(tokenizer("byte_bpe_50k.json")), lambda n: n and (n.text, n.priority, shape(n.left), shape(n.right))
    a, b = (tokencount.Counts(encoder, "some words here " * 300) for _ in range(2))
    for tree in (a, b):
        tree.edit(100, 120, "x")
    assert shape(a.root) == shape(b.root)


def test_edit_counts_of_nothing_and_odd_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_tokens string, edits array<struct<begin:long,end:long,text:string>>")
    assert tokencount.count_edits(docs, tokenizer("byte_bpe_50k.json")).count() == 0


def test_shards_do_not_depend_on_the_session(spark):
    rng = random.Random(21)
    words = ["river", "stone", "ciel", "haus", "code", "lamp", "mer", "baum"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))) for i in range(130)]
    rows += rows[:9] + [(500, None)]
    docs, kept = spark.createDataFrame(rows, "doc_id long, text string"), spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "4", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            made = packing.pack(docs.repartition(int(n) + 1), tokenizer("byte_bpe_50k.json"), window=64, shard_docs=20).collect()
            found.append(sorted((r.sequence_id, r.offset, r.length, r.ids_crc32, r.doc_tokens) for r in made))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert found[0] == found[1] == found[2]
    lengths = {}
    for s, _, n, *_ in found[0]:
        lengths[s] = lengths.get(s, 0) + n
    # At most one window of each of the seven shards is cut short.
    assert sum(n < 64 for n in lengths.values()) <= 7 * 6 and sum(lengths.values()) == sum({(s, o): n for s, o, n, *_ in found[0]}.values())


def test_every_shard_but_the_last_is_full(spark):
    keys = spark.createDataFrame([(i * 7 % 50, i) for i in range(103)], "place long, row long").repartition(6)
    cuts = packing.order_cuts(keys, 20)
    order = sorted((i * 7 % 50, i) for i in range(103))
    assert cuts == order[20::20] and packing.order_cuts(keys.where("row < 0"), 20) == []
