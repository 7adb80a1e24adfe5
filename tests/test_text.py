"""Text, metadata and prompt functions on literals."""

import html
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from scrivenry.functions import meta, prompts
from scrivenry.functions import text as T


def values(spark, rows, column, schema="t string"):
    df = spark.createDataFrame([(r,) for r in rows], schema).withColumn("i", F.monotonically_increasing_id())
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_blank_predicates(spark):
    rows = [None, "", "  ", "　", "\t", "\x1c", "a "]
    assert values(spark, rows, T.is_empty_ascii("t")) == [True, True, True, False, False, False, False]
    assert values(spark, rows, T.is_blank("t")) == [True] * 6 + [False]


def test_encoding_faults(spark):
    assert values(spark, ["ok\t\r\n", "x�", "\x07", "�\x00", None], T.encoding_faults("t")) == [[], ["replacement_char"], ["control_char"], ["replacement_char", "control_char"], []]


def test_body_of_paragraphs(spark):
    body = '<p id="L1">　一</p>\r\n<P>a<!-- x\ny --><ruby>b</rb> \n c</P><p></p><p></p><p></p><p>&lt;b&gt;&amp;&nbsp;&hearts;</p>'
    (n,) = values(spark, [body], T.normalise_body("t"))
    assert n.text == "　一\nabc\n\n<b>& ♥"
    assert (n.raw_char_count, n.normalized_char_count) == (len(body), len(n.text))


@pytest.mark.parametrize(("raw", "want"), [("a\r\nb\rc", "a\nb\nc"), ("a\n\n\nb", "a\n\n\nb"), ("a\n\n\n\nb", "a\n\nb"), ("\n\n\n\nx\n\n\n", "\nx\n"), ("", ""), (None, "")])
def test_body_of_lines(spark, raw, want):
    assert values(spark, [raw], T.normalise_body("t"))[0].text == want


def plain_blank_runs(lines):
    out = []
    for empty, run in __import__("itertools").groupby(lines, lambda x: x == ""):
        run = list(run)
        out += [""] if empty and len(run) >= 3 else run
    return "\n".join(out)


def test_blank_runs_equal_the_plain_rule(spark):
    import itertools

    cases = [list(c) for n in range(1, 8) for c in itertools.product(["", "a"], repeat=n)]
    found = values(spark, cases, T.compact_blank_runs(F.col("t")), "t array<string>")
    assert found == [plain_blank_runs(c) for c in cases]


def plain_style(text):
    sentences = [s for s in re.findall(r"[^。！？…」』]*[。！？…」』]+|[^。！？…」』]+$", text) if s.strip()]
    n = len(text)
    return (n, len(sentences), len([p for p in re.split(r"\n\s*\n", text) if p.strip()]), n / len(sentences) if sentences else 0.0, sum(map(len, re.findall("「[^」]*」|『[^』]*』", text))) / n if n else 0.0)


@settings(max_examples=25, deadline=None)
@given(texts=st.lists(st.text("あア漢。！？…「」『』\n 　aA.-—", max_size=60), min_size=1, max_size=25))
def test_style_equals_the_plain_measures(spark, texts):
    m = values(spark, texts, T.style_metrics("t"))
    for x, t in zip(m, texts):
        want = plain_style(t)
        assert (x.char_count, x.sentence_count, x.paragraph_count) == want[:3]
        assert x.avg_sentence_length == pytest.approx(want[3]) and x.dialogue_ratio == pytest.approx(want[4])


def test_style_of_a_literal(spark):
    (m,) = values(spark, ["彼は言った。「なぜ？」カタカナ――！\n\n終わり…"], T.style_metrics("t", F.lit(9)))
    assert m.token_count == 9 and m.sentence_count == 4 and m.paragraph_count == 2
    assert m.question_sentence_ratio == 0.25 and m.exclamation_sentence_ratio == 0.25
    assert m.dash_frequency == pytest.approx(1000 / m.char_count) and m.metrics_version == T.VERSION


def test_titles(spark):
    rows = ["第107話 旅立ち", "第107話", "12", "ep3 start", "第3話　a", None, " はじまり "]
    assert values(spark, rows, T.informative_title("t")) == ["第107話 旅立ち", None, None, "ep3 start", None, None, "はじまり"]


def test_numbers(spark):
    rows = ["10", "2", "x", "12a", None, " 7"]
    assert values(spark, rows, T.leading_int("t")) == [10, 2, 0, 12, 0, 7]
    assert values(spark, rows, T.lenient_int("t"))[:4] == [10, 2, -1, -1]


def test_entities_and_folding(spark):
    rows = ["&lt;&eacute;&#x41;", None, "plain", "Ｗａｒ ﬃ ß"]
    assert values(spark, rows, T.decode_entities("t")) == [None if r is None else html.unescape(r) for r in rows]
    assert values(spark, rows, T.fold("t")) == [None if r is None else unicodedata.normalize("NFKC", r).casefold() for r in rows]


@settings(max_examples=20, deadline=None)
@given(pairs=st.lists(st.tuples(st.text("ab", max_size=50), st.text("ab", max_size=50)), min_size=1, max_size=20))
def test_overlap_equals_the_plain_rule(spark, pairs):
    df = spark.createDataFrame([(i, a + b[:30], b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    found = [r.v for r in df.select("i", T.overlap_length(F.col("a"), F.col("b"), 5, 40).alias("v")).orderBy("i").collect()]
    for v, (a, b) in zip(found, pairs):
        a = a + b[:30]
        assert v == max((n for n in range(5, min(len(a), len(b), 40) + 1) if a[-n:] == b[:n]), default=0)


def test_thoughts_and_quotes(spark):
    assert values(spark, ["<think>a</think> b", "<think>open", "c"], T.without_thought("t")) == ["b", "<think>open", "c"]
    assert values(spark, ["x「a「b」c」y"], T.strip_nested("t")) == ["xy"]
    assert values(spark, ["aaaa bb"], T.occurrences("t", ["aa", "b"])) == [4]


def test_keywords_and_flags(spark):
    df = spark.createDataFrame([("Ｒ１５　BL  Military", "百合 オリジナルタグ r15"), (None, None)], "a string, b string")
    df = meta.normalise_keywords(df.withColumn("k", meta.source_keywords("a", "b")), "k", "tags")
    one, none = df.select("tags", meta.flags("tags").alias("f")).collect()
    assert one.tags == ["R15", "ボーイズラブ", "ミリタリー", "ガールズラブ", "オリジナルタグ"] and none.tags == []
    assert len(one.f) == 23 and one.f["ガールズラブ"] and not one.f["SF"] and not any(none.f.values())


def test_control_tags(spark):
    c = "struct<genre:array<string>,setting:struct<world:string,era:string>,protagonist:struct<gender:string>,narrative:struct<viewpoint:string>,tone:array<string>>"
    rows = [({"学園": True, "男主人公": True}, (["war", "school"], ("isekai", "unknown"), ("female",), ("first_person",), ["dark"])), ({"男主人公": True, "女主人公": True}, None), ({}, ([], (None, "edo"), ("female",), (None,), None))]
    found = [r.t for r in spark.createDataFrame(rows, f"f map<string,boolean>, c {c}").select(meta.control_tags(F.col("f"), F.col("c")).alias("t")).collect()]
    assert found[0].genre == ["school", "war"] and found[0].setting == ["school", "isekai"] and found[0].protagonist_gender == "male" and found[0].viewpoint == "first_person" and found[0].tone == ["dark"]
    assert found[1].protagonist_gender == "unknown" and found[1].tone == []
    assert found[2].setting == ["edo"] and found[2].protagonist_gender == "female" and found[2].viewpoint == "unknown"


def test_works_are_classified(spark):
    f = "ncode string, ok boolean, features struct<protagonist_gender:string,world_transfer:string>"
    works = spark.createDataFrame([("a", {}), ("b", {"異世界転生": True}), ("c", None)], "ncode string, control_flags map<string,boolean>")
    features = spark.createDataFrame([("a", True, ("multiple", "transfer")), ("b", True, ("male", "transfer")), ("c", False, ("male", "transfer"))], f)
    found = {r.ncode: r for r in meta.classify_works(works, features, spark.createDataFrame([("a", "first_person")], "ncode string, viewpoint string")).collect()}
    assert (found["a"].setting.world, found["a"].protagonist.gender, found["a"].narrative.viewpoint) == ("isekai", "multiple", "first_person")
    assert found["b"].setting.world is None and found["c"].protagonist.gender == "unknown"


def test_prompts(spark):
    df = spark.createDataFrame([(["b", "a"], "題", None, ["x", "y"], "前"), ([], None, "", [], "")], "g array<string>, t string, e string, k array<string>, c string")
    p = prompts.sample_prompt({"genre": F.col("g"), "r18": F.lit("no")}, F.col("t"), F.col("e"), F.col("k"), F.col("c"))
    one, two = [r.p for r in df.select(p.alias("p")).collect()]
    line = "[viewpoint=unknown][protagonist_gender=unknown][setting=none][genre={}][r18=no][dialogue=unknown][sentence=unknown]\n"
    assert one == line.format("a,b") + "【作品】題\n【話】unknown\n【語】x、y\n【ここまで】\n前\n【続き】\n"
    assert two == line.format("none") + "【作品】unknown\n【話】unknown\n【語】none\n【ここまで】\n\n【続き】\n"
    read = spark.createDataFrame([(one,), (two,)], "p string").select(prompts.header_terms(F.col("p")).alias("k"), prompts.context_of(F.col("p")).alias("c"), prompts.with_terms(F.col("p"), F.array(F.lit("z"))).alias("w")).collect()
    assert [r.k for r in read] == [["x", "y"], []] and [r.c for r in read] == ["前", ""]
    assert read[0].w == one.replace("x、y", "z") and read[1].w == two.replace("【語】none", "【語】z")
