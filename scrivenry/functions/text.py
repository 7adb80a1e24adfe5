"""Text functions as column expressions: cleaning, predicates, and style measures.

White space is Python's: Java's ``(?U)\\s`` and the four separators U+001C to U+001F.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WHITE = r"[\s\x1c-\x1f]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- cleaning ------------------------------------------------------------------------------------


def unify_newlines(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "\r\n?", "\n")


def collapse_space(c: Column | str) -> Column:
    """Runs of white space as one space, none at the ends; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), f"(?U){WHITE}+", " "))


def strip_space(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), rf"(?U)\A{WHITE}+|{WHITE}+\z", "")


def without_space(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"(?U){WHITE}+", "")


def without_tags(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), "<[^>]+>", "")


def blocks(c: Column | str) -> Column:
    """Contents of the <p> elements of a body, or its lines if it has none."""
    body = unify_newlines(c)
    found = F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.split(body, "\n", -1))


def clean_block(c: Column) -> Column:
    """One block without comments, tags and line breaks of the markup.  Entities are decoded after this."""
    bare = without_tags(F.regexp_replace(c, "(?s)<!--.*?-->", ""))
    return F.regexp_replace(bare, r"[ \t]*\n[ \t]*", "")


@F.pandas_udf(StringType())
def decode_entities(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """HTML entities decoded (the whole HTML5 table; Spark has no such function)."""
    import html

    for t in texts:
        yield t.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)


@F.pandas_udf(StringType())
def decode_closed_entities(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``decode_entities`` for those that end in a semicolon; an open ``&amp`` stays as it is written."""
    import html
    import re
    from html.entities import html5

    closed = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[0-9a-zA-Z]+;)")
    plain = lambda m: html.unescape(m[0]) if m[1][0] == "#" else html5.get(m[1], m[0])
    for t in texts:
        yield t.map(lambda x: closed.sub(plain, x) if x is not None and "&" in x else x)


@F.pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import unicodedata

    for t in texts:
        yield t.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def fold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC and case folding: the key under which spellings of a tag meet."""
    import unicodedata

    for t in texts:
        yield t.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def compact_blank_runs(lines: Column) -> Column:
    """Three or more empty lines in a row become one; one or two stay.

    Joined by line breaks, an inner run of n empty lines is a run of n + 1 breaks, one at an end a run of n.
    """
    joined = F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))
    short = F.regexp_replace(joined, "\n{4,}", "\n\n")
    return short.substr(F.lit(2), F.length(short) - 2)


def normalise_body(c: Column | str, open_entities: bool = True) -> Column:
    """struct<text, raw_char_count, normalized_char_count, raw_sha256, normalized_sha256> of an episode's body.

    open_entities: whether an entity counts that HTML5 knows without its semicolon.
    Entities are decoded on the lines joined by a mark that no text holds, so one call serves all blocks.
    """
    raw = F.coalesce(_col(c), F.lit(""))
    mark = "\x00"
    lines = F.transform(blocks(F.translate(raw, mark, "")), clean_block)
    decode = decode_entities if open_entities else decode_closed_entities
    decoded = F.translate(decode(F.array_join(lines, mark)), " ", " ")
    text = compact_blank_runs(F.split(decoded, mark, -1))
    return F.struct(
        text.alias("text"), F.length(raw).alias("raw_char_count"), F.length(text).alias("normalized_char_count"),
        F.sha2(raw, 256).alias("raw_sha256"), F.sha2(text, 256).alias("normalized_sha256"),
    )


def legacy_clean(c: Column | str) -> Column:
    """Tags out, wide and no-break spaces plain, at most two breaks in a row, ends stripped."""
    plain = F.translate(without_tags(c), "　 ", "  ")
    return strip_space(F.regexp_replace(plain, "\n{3,}", "\n\n"))


# -- predicates ----------------------------------------------------------------------------------


def is_empty_ascii(c: Column | str) -> Column:
    """Null or nothing but ASCII spaces."""
    return _col(c).isNull() | (F.trim(_col(c)) == "")


def is_blank(c: Column | str) -> Column:
    """Null or nothing but white space of any kind."""
    return _col(c).isNull() | (without_space(c) == "")


def encoding_faults(c: Column | str) -> Column:
    """Reasons, as an array: replacement character; control character other than tab and line ends.  Unpaired
    surrogates can't be in a Spark string; ``sources.files.surrogate_faults`` tells at the source."""
    t = _col(c)
    return F.array_compact(
        F.array(
            F.when(t.contains("�"), F.lit("replacement_char")),
            F.when(t.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), F.lit("control_char")),
        )
    )


def markup_ratio(c: Column | str, least: int = 200) -> Column:
    """Share of a text that is left without its tags, to four places; null below ``least`` characters."""
    t = _col(c)
    return F.when(F.length(t) >= least, F.bround(F.length(without_tags(t)) / F.length(t), 4))


def lenient_int(c: Column | str, default: int = -1) -> Column:
    return F.coalesce(_col(c).try_cast("int"), F.lit(default))


def leading_int(c: Column | str) -> Column:
    """The number a text begins with, 0 if none: the order that a prefix cast gives."""
    return F.coalesce(F.regexp_extract(_col(c).cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0))


# Fixed value: what numbering looks like at the start of an episode's title.
NUMBERING = r"(?U)^[\s　]*(?:第?\s*[0-9０-９]+\s*(?:話|章|節|回|部)?|[Ee][Pp]\.?\s*[0-9]+|[0-9０-９]+)[\s　.、\-—–]*"


def informative_title(c: Column | str, numbering: str = NUMBERING) -> Column:
    """The stripped title, or null if at most one character is left without its numbering."""
    title = F.coalesce(_col(c), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(title, numbering, ""), r"\A[　 .\-—–]+|[　 .\-—–]+\z", "")
    return F.when(F.length(rest) > 1, strip_space(title))


def occurrences(text: Column | str, terms: list[str]) -> Column:
    """Occurrences, without overlap, of each term in a text, summed."""
    t, total = _col(text), F.lit(0)
    for term in terms:
        if term:
            total = total + ((F.length(t) - F.length(F.replace(t, F.lit(term), F.lit("")))) / len(term)).cast("int")
    return total


def strip_nested(c: Column | str, opening: str = "「", closing: str = "」", levels: int = 4) -> Column:
    """A text without its quotations, from the innermost out, however deep they are nested.

    opening, closing: characters, several of a kind side by side.  A few levels go at once; a text that still has a
    quotation is gone over once for each mark that is left in it, which no nesting exceeds.
    """
    inner, marks = f"[{opening}][^{opening}{closing}]*[{closing}]", f"[{opening}]"
    out = _col(c)
    for _ in range(levels):
        out = F.regexp_replace(out, inner, "")
    deeper = lambda t: F.aggregate(F.sequence(F.lit(1), F.regexp_count(t, F.lit(marks))), t, lambda s, _: F.regexp_replace(s, inner, ""))
    return F.transform(F.array(out), lambda t: F.when(t.rlike(inner), deeper(t)).otherwise(t))[0]


def is_afterword(c: Column | str, pattern: str | None = None) -> Column:
    """Whether an author speaks to readers; words that stories use too aren't among the pattern's."""
    return F.coalesce(_col(c).rlike(pattern or AFTERWORD), F.lit(False))


def is_refusal(c: Column | str, pattern: str | None = None) -> Column:
    """Whether a model's answer declines, in any letter case."""
    return F.coalesce(_col(c).rlike("(?iu)" + (pattern or REFUSAL)), F.lit(False))


# What afterwords and refusals are told by.
AFTERWORD = "あとがき|活動報告|お読みいただき|読んでいただき|ご感想|感想をお待ち|感想をいただ|評価をいただ|評価してくださ|次回予告|誤字報告|誤字脱字|ブックマーク|投稿します|更新が遅れ"
REFUSAL = "申し訳|お答えでき|できません|不適切|ポリシー|I can'?t|I'm sorry|cannot assist|as an AI"


def space_digest(c: Column | str) -> Column:
    """MD5 of a text whose runs of white space are one space, ends stripped."""
    return F.md5(collapse_space(c).cast("binary"))


def only_script(c: Column | str, script: str) -> Column:
    """Whether a term is written in one script alone."""
    return F.coalesce(_col(c).rlike(f"\\A[{script}]+\\z"), F.lit(False))


def without_thought(c: Column | str) -> Column:
    """What follows a closed <think> block."""
    t = _col(c)
    return F.when(t.contains("<think>") & t.contains("</think>"), F.trim(F.regexp_replace(t, "(?s)^.*</think>", ""))).otherwise(t)


def overlap_length(left: Column, right: Column, least: int = 20, most: int = 1200) -> Column:
    """Characters of the longest suffix of ``left`` that begins ``right``, from ``least`` to ``most``; else 0.

    A suffix must begin where the first ``least`` characters of ``right`` occur in the tail; only those places
    are compared.
    """
    def of(tail: Column) -> Column:
        head = F.left(right, F.lit(least))
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(tail) - least + 1, F.lit(1))), lambda i: F.substr(tail, i, F.lit(least)) == head)
        whole = F.filter(places, lambda i: F.substr(tail, i) == F.left(right, F.length(tail) - i + 1))
        size = F.length(tail) - F.array_min(whole) + 1
        return F.when((F.length(tail) >= least) & (F.length(right) >= least) & F.contains(tail, head), F.coalesce(size, F.lit(0))).otherwise(F.lit(0))

    # As an element of an array the tail is made once, and not again for each place.
    return F.element_at(F.transform(F.array(F.right(left, F.lit(most))), of), 1)


# -- style ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Marks:
    """The characters style measures look for; the defaults are Japanese, Latin ones serve Latin texts."""

    # Terminals, quotations, scripts, punctuation, ellipses and dashes of the measures.
    terminals: str = "。！？…」』"
    question: str = r"？」?』?\z"
    exclamation: str = r"！」?』?\z"
    dialogue: str = "「[^」]*」|『[^』]*』"
    bracket_dialogue: str = "「[^」]*」"
    kanji: str = "[一-鿿]"
    hiragana: str = "[぀-ゟ]"
    katakana: str = "[゠-ヿ]"
    punctuation: str = "[。、,.！？!?]"
    ellipsis: str = r"…|\.{3,}"
    dash: str = "――|—|‐{2,}"


LATIN = Marks(terminals=".!?", question=r"\?\z", exclamation=r"!\z", dialogue='"[^"]*"', bracket_dialogue='"[^"]*"', kanji="[A-Z]", hiragana="[a-z]", katakana="[0-9]", punctuation="[,.!?;:]", ellipsis=r"\.{3,}", dash="--")
VERSION = "1"


def sentences(c: Column | str, marks: Marks = Marks()) -> Column:
    t = marks.terminals
    return F.filter(F.regexp_extract_all(_col(c), F.lit(rf"[^{t}]*[{t}]+|[^{t}]+\z"), F.lit(0)), lambda s: ~is_blank(s))


def paragraphs(c: Column | str) -> Column:
    return F.filter(F.split(_col(c), rf"(?U)\n{WHITE}*\n", -1), lambda p: ~is_blank(p))


def style_metrics(c: Column | str, token_count: Column | None = None, marks: Marks = Marks()) -> Column:
    """struct of the sixteen style measures and their version; every ratio of an empty text is 0."""
    t = _col(c)
    n, own = F.length(t), sentences(t, marks)
    n_sentences, n_paragraphs = F.size(own), F.size(paragraphs(t))
    over = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    count = lambda p: F.regexp_count(t, F.lit(p))
    chars = lambda p: F.aggregate(F.regexp_extract_all(t, F.lit(p), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    ending = lambda p: F.size(F.filter(own, lambda s: strip_space(s).rlike(p)))
    return F.struct(
        n.alias("char_count"), (token_count if token_count is not None else F.lit(None).cast("int")).alias("token_count"),
        n_sentences.alias("sentence_count"), n_paragraphs.alias("paragraph_count"),
        over(n, n_sentences).alias("avg_sentence_length"), over(n, n_paragraphs).alias("avg_paragraph_length"),
        over(chars(marks.dialogue), n).alias("dialogue_ratio"), over(count(marks.kanji), n).alias("kanji_ratio"),
        over(count(marks.hiragana), n).alias("hiragana_ratio"), over(count(marks.katakana), n).alias("katakana_ratio"),
        over(count(marks.punctuation), n).alias("punctuation_ratio"),
        over(ending(marks.question), n_sentences).alias("question_sentence_ratio"), over(ending(marks.exclamation), n_sentences).alias("exclamation_sentence_ratio"),
        over(count(marks.ellipsis), n / 1000).alias("ellipsis_frequency"), over(count(marks.dash), n / 1000).alias("dash_frequency"),
        over(count(marks.bracket_dialogue), n / 1000).alias("bracket_dialogue_frequency"), F.lit(VERSION).alias("metrics_version"),
    )


def bucket(value: Column | str, low: Column, high: Column, labels: tuple[str, str, str] = ("low", "mid", "high")) -> Column:
    v = _col(value)
    return F.when(v.isNull(), "unknown").when(v < low, labels[0]).when(v < high, labels[1]).otherwise(labels[2])
