"""Fill-in-middle transformation: documents cut in three and put in another order, by a pandas UDF.

The unit's pattern is searched with the regex library's ``finditer`` and the units' ends are kept as four-byte
numbers; two of them slice the text.  Seeds come from a hash of the row's id, so the cut doesn't depend on
partitions or attempts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cache
from operator import methodcaller

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivenry.llm.common import small_batches

#: What a text may be cut between.  What no pattern covers belongs to the unit after it, or is the last unit.
UNITS = {"char": r"(?s:.)", "grapheme": r"\X", "word": r"\s*\S+", "line": r"[^\n]*\n|[^\n]+"}
#: Before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


@cache
def _pattern(unit: str):
    import regex

    found = regex.compile(UNITS.get(unit, unit))
    if found.match(""):
        raise ValueError(f"the unit {unit!r} matches the empty text")
    return found


def ends(text: str, unit: str = "char") -> array:
    """Where each unit of a text ends; the last one ends the text."""
    found = array("I", map(methodcaller("end"), _pattern(unit).finditer(text)))
    if text and (not found or found[-1] < len(text)):
        found.append(len(text))
    return found


def draws(seed: str, doc_id) -> tuple[int, ...]:
    """h1 to h4: the first four groups of eight hexadecimal digits of a hash of seed and id."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[8 * i : 8 * i + 8], 16) for i in range(4))


def cut(text: str, doc_id, seed: str = "1", unit: str = "char", rate: int = 90, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    found = ends(text, unit)
    n = len(found)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (found[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    pre, suf, mid = marks
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{suf}{suffix}{pre}{prefix}{mid}{middle}"
    return n, "psm", a, b - a, f"{pre}{prefix}{suf}{suffix}{mid}{middle}"


def rebuilt(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    pre, suf, mid = marks
    first, second = (pre, suf) if form == "psm" else (suf, pre)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(mid, 1)
    return one + middle + two if form == "psm" else two + middle + one


def _safe(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def rearranged(doc_id: Column, text: Column, seed: str = "1", unit: str = "char", rate: int = 90, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> Column:
    """A struct column for each row: n (units), form (plain, psm or spm), prefix_chars and middle_chars (null where
    plain), output, and the hashes of the output and of the text rebuilt from it.

    rate: per cent of texts that are cut; spm: per cent of those with the suffix first.  Plain stay empty texts and
    those that hold a mark.  Null text: empty.  Null doc_id: seeded by nothing but ``seed``; rows with equal ids are
    cut at the same share of their own length.  An empty table gives an empty one.  The marks must differ, and none
    may overlap itself or another.
    """
    if len(set(marks)) < 3 or any(a[-i:] == b[:i] for a in marks for b in marks for i in range(1, min(len(a), len(b)) + (a != b))) or "" in marks:
        raise ValueError("marks must differ and must not overlap")

    @F.pandas_udf(SCHEMA)
    def make(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for ids, texts in columns:
            rows = []
            for i, t in zip(ids.tolist(), texts.tolist(), strict=True):
                row = cut(t if isinstance(t, str) else "", i if isinstance(i, str) else None, seed, unit, rate, spm, marks)
                back = rebuilt(row[4], row[1], marks)
                rows.append((*row, hashlib.sha256(_safe(row[4])).hexdigest(), hashlib.sha256(_safe(back)).hexdigest()))
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return make(doc_id.cast("string"), text)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The texts that outputs were made from; null where the output or the form is null."""

    @F.pandas_udf("string")
    def make(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([rebuilt(o, f, marks) if isinstance(o, str) and isinstance(f, str) else None for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return make(output, form)


def transformed(docs: DataFrame, **settings) -> DataFrame:
    """doc_id and the fields of ``rearranged`` for each row of ``docs`` (doc_id, text); other columns are not read."""
    small_batches(docs.sparkSession)
    made = docs.select("doc_id", rearranged(F.col("doc_id"), F.col("text"), **settings).alias("made"))
    return made.select("doc_id", "made.*")
