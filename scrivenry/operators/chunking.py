"""Chunks of episodes: whole paragraphs first, then sentences, then tokens, within a token budget."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivenry.sources.batches import small_batches

# What separates paragraphs, what ends a sentence, and the join of paragraphs.
PARAGRAPH = re.compile(r"\n[ \t　]*\n[\n \t　]*")
SENTENCE = re.compile(r"[。!?！？♪]+[」』】”’\"')\]]*")
JOIN, MARGIN, SHORT_TAIL = "\n\n", 8, 0.2

#: Offsets of a text's tokens.
Tokenizer = Callable[[str], list[tuple[int, int]]]
_TOKEN = re.compile(r"\w+|[^\w\s]")


def regex_tokens(text: str) -> list[tuple[int, int]]:
    """Words and single marks: a tokenizer that needs no file."""
    return [m.span() for m in _TOKEN.finditer(text)]


@dataclass(frozen=True)
class FileTokens:
    """The tokens of a tokenizer's file, which each worker loads once (``path`` is a parameter, on a folder they all
    see): offsets in characters, without special tokens; those that stand for no character are left out."""

    path: str

    def __call__(self, text: str) -> list[tuple[int, int]]:
        return [(a, b) for a, b in _library(self.path).encode(text, add_special_tokens=False).offsets if b > a]


@cache
def _library(path: str):
    from tokenizers import Tokenizer as Library

    return Library.from_file(path)


def _sentences(paragraph: str) -> list[str]:
    ends = [m.end() for m in SENTENCE.finditer(paragraph)]
    cuts = [0, *ends] + ([len(paragraph)] if not ends or ends[-1] < len(paragraph) else [])
    return [paragraph[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def units(text: str, tokens: Tokenizer, most: int) -> list[tuple[str, str, int]]:
    """(kind, text, tokens) of the least parts a chunk may hold; kind: what lies before the part."""
    out = []
    for paragraph in filter(None, PARAGRAPH.split(text.strip("\n"))):
        kind = "paragraph"
        for sentence in _sentences(paragraph):
            spans = tokens(sentence)
            if len(spans) <= most:
                out.append((kind, sentence, len(spans)))
            else:
                step = max(1, most - MARGIN)
                for i in range(0, len(spans), step):
                    part = sentence[spans[i][0] : spans[min(i + step, len(spans)) - 1][1]]
                    out.append((kind if i == 0 else "token", part, len(tokens(part))))
            kind = "sentence"
    return out


def _end(ends: list[int], totals: list[int], start: int, last: int, target: int) -> int | None:
    """The first of the allowed ends in (start, last] with the target's tokens, or else the one with most."""
    low, high = bisect_right(ends, start), bisect_right(ends, last)
    if low == high:
        return None
    own = ends[low:high]
    at = bisect_left(own, target, key=lambda e: totals[e] - totals[start])
    if at == len(own):
        at = bisect_left(own, totals[own[-1]], key=lambda e: totals[e])
    return own[at]


def chunk(text: str | None, tokens: Tokenizer = regex_tokens, target: int = 1536, most: int = 2048, overlap: int = 128) -> list[tuple[int, str, int]]:
    """(index, text, tokens) of the chunks of an episode.

    A chunk ends at a paragraph if any is in reach, even one far below the target, then at a sentence, then
    anywhere.  The next one begins ``overlap`` tokens back, in whole units.  A last chunk below a fifth of the
    target is joined to the one before, which may then exceed ``most``.
    """
    if not 0 < target <= most or not 0 <= overlap < target:
        raise ValueError("0 < target <= most and 0 <= overlap < target are required")
    own = units(text, tokens, most) if text and text.strip() else []
    n, totals = len(own), [0, *accumulate(u[2] for u in own)]
    paragraphs = [i for i in range(1, n + 1) if i == n or own[i][0] == "paragraph"]
    sentences = [i for i in range(1, n) if own[i][0] == "sentence"]
    show = lambda a, b: "".join((JOIN if i > a and own[i][0] == "paragraph" else "") + own[i][1] for i in range(a, b))
    spans, start = [], 0
    while start < n:
        last = max(start + 1, bisect_right(totals, totals[start] + most) - 1)
        end = _end(paragraphs, totals, start, last, target) or _end(sentences, totals, start, last, target) or last
        spans.append((start, end))
        if end == n:
            break
        back = max(0, bisect_right(totals, totals[end] - overlap, 0, end) - 1) if overlap else end
        start = back if back > start else start + 1
    if len(spans) > 1 and len(tokens(show(*spans[-1]))) < target * SHORT_TAIL:
        spans[-2:] = [(spans[-2][0], spans[-1][1])]
    texts = [show(*s) for s in spans]
    return [(i, t, len(tokens(t))) for i, t in enumerate(texts)]


def chunk_episodes(df: DataFrame, keys: list[str], text: str, target: int = 1536, most: int = 2048, overlap: int = 128, tokens: Tokenizer = regex_tokens) -> DataFrame:
    """Rows (keys, chunk_index, text, token_count, chunk_count_in_episode) of each episode's chunks.

    Null and blank texts have none.  A batch of episodes is in memory at a time.
    """
    own = df.select(*keys).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", chunk_index int, text string, token_count int, chunk_count_in_episode int"

    small_batches(df.sparkSession)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for row in zip(*(pdf[k] for k in keys), pdf[text], strict=True):
                found = chunk(row[-1] if isinstance(row[-1], str) else None, tokens, target, most, overlap)
                rows += [(*row[:-1], *c, len(found)) for c in found]
            yield pd.DataFrame(rows, columns=[*keys, "chunk_index", "text", "token_count", "chunk_count_in_episode"])

    return df.select(*keys, text).mapInPandas(run, schema)


def chunk_id(ncode: str = "ncode", episode: str = "episode_no", index: str = "chunk_index"):
    return F.format_string("%s:e%d:c%d", F.col(ncode).cast("string"), F.col(episode), F.col(index))
