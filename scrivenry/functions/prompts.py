"""Condition lines, plan headers, and the texts a model is trained on and prompted with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of a condition line in their order, its lists, and the marks of the parts.
FIELDS = ("viewpoint", "protagonist_gender", "setting", "genre", "r18", "dialogue", "sentence")
LISTS = ("setting", "genre")
EMPTY, UNKNOWN = "none", "unknown"
TITLE, EPISODE, TERMS, CONTEXT, CONTINUATION = "【作品】", "【話】", "【語】", "【ここまで】", "【続き】"


def condition_line(fields: dict[str, Column]) -> Column:
    """[field=value] for every field and a line break; lists sorted, empty ones ``none``, others ``unknown``."""
    parts = []
    for name in FIELDS:
        value = fields.get(name)
        if name in LISTS:
            shown = F.lit(EMPTY) if value is None else F.coalesce(F.nullif(F.array_join(F.array_sort(value), ","), F.lit("")), F.lit(EMPTY))
        else:
            shown = F.lit(UNKNOWN) if value is None else F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(UNKNOWN))
        parts += [F.lit(f"[{name}="), shown, F.lit("]")]
    return F.concat(*parts, F.lit("\n"))


def plan_header(title: Column, episode: Column, terms: Column) -> Column:
    named = lambda c: F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit(UNKNOWN)))
    listed = F.coalesce(F.nullif(F.array_join(terms, "、"), F.lit("")), F.lit(EMPTY))
    return F.concat(F.lit(TITLE), named(title), F.lit("\n" + EPISODE), named(episode), F.lit("\n" + TERMS), listed, F.lit("\n"))


def sample_prompt(fields: dict[str, Column], title: Column, episode: Column, terms: Column, context: Column) -> Column:
    return F.concat(condition_line(fields), plan_header(title, episode, terms), F.lit(CONTEXT + "\n"), context, F.lit("\n" + CONTINUATION + "\n"))


def training_text(tags: Column, is_r18: Column, text: Column) -> Column:
    """Condition line and text of a chunk; the style fields are unknown in this form."""
    fields = {n: tags[n] for n in ("viewpoint", "protagonist_gender", "setting", "genre")}
    fields["r18"] = F.when(F.coalesce(is_r18, F.lit(False)), "yes").otherwise("no")
    return F.concat(condition_line(fields), F.coalesce(text, F.lit("")))


def header_terms(prompt: Column) -> Column:
    """The terms a prompt's header names; none for the word ``none``."""
    line = F.regexp_extract(prompt, f"(?m)^{TERMS}(.*)$", 1)
    return F.filter(F.split(line, "、", -1), lambda t: ~t.isin("", EMPTY))


def with_terms(prompt: Column, terms: Column) -> Column:
    """The prompt with its first header line of terms replaced."""
    shown = F.coalesce(F.nullif(F.array_join(terms, "、"), F.lit("")), F.lit(EMPTY))
    head = F.regexp_extract(prompt, rf"(?s)\A(.*?{TERMS})[^\n]*", 1)
    tail = F.regexp_extract(prompt, rf"(?s)\A.*?{TERMS}[^\n]*(.*)\z", 1)
    return F.when(prompt.contains(TERMS), F.concat(head, shown, tail)).otherwise(prompt)


def context_of(prompt: Column) -> Column:
    """The context part of a prompt, without the marks around it."""
    return F.regexp_extract(prompt, rf"(?s){CONTEXT}\n(.*)\n{CONTINUATION}", 1)
