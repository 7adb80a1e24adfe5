"""Token counts that follow edits: a balanced tree of pre-token leaves for each document.

A leaf is a run of pre-tokens of about ``LEAF`` characters that begins where the tokenizer can't merge across:
at a space between two characters that aren't space, or where letters, digits and punctuation meet.  Each node of
the tree holds the characters and tokens below it.  An edit takes out the leaves that it touches, and a neighbour
where it comes near the boundary; only these are cut and encoded again, and the sums on the path to the root are
updated.  A pre-token is never cut: a run of one kind of character that is longer than a leaf is a leaf.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivenry.llm.common import parts, small_batches
from scrivenry.llm.encoding import Encoder

LEAF = 256
# Characters whose kind no two versions of the Unicode tables disagree on.
_LETTER = "A-Za-zÀ-ÖØ-öø-ſぁ-ゖァ-ヺ一-鿋가-힣"
_DIGIT, _MARK = "0-9", r"!-&(-/:-@\[-`{-~、。「」『』！？…—"
_BOUNDARY = re.compile(
    rf"(?<=[^\s\x1c-\x1f])(?= [^\s\x1c-\x1f])|(?<=[{_LETTER}])(?=[{_DIGIT}{_MARK}'])|(?<=[{_DIGIT}])(?=[{_LETTER}{_MARK}'])|(?<=[{_MARK}])(?=[{_LETTER}{_DIGIT}])"
)


class Node:
    """A treap by place: priorities come from a hash of the node's number in its tree, so a text and its edits
    give the same tree in every process."""

    __slots__ = ("text", "own", "left", "right", "chars", "tokens", "priority")

    def __init__(self, text: str, tokens: int, number: int):
        self.text, self.own, self.left, self.right = text, tokens, None, None
        self.chars, self.tokens, self.priority = len(text), tokens, number * 0x9E3779B97F4A7C15 & (1 << 64) - 1

    def update(self) -> Node:
        self.chars, self.tokens = len(self.text), self.own
        for side in (self.left, self.right):
            if side:
                self.chars += side.chars
                self.tokens += side.tokens
        return self


def merge(a: Node | None, b: Node | None) -> Node | None:
    if not a or not b:
        return a or b
    if a.priority > b.priority:
        a.right = merge(a.right, b)
        return a.update()
    b.left = merge(a, b.left)
    return b.update()


def split(node: Node | None, chars: int) -> tuple[Node | None, Node | None]:
    """Leaves that end at or before place ``chars``, and the others."""
    if not node:
        return None, None
    here = (node.left.chars if node.left else 0) + len(node.text)
    if here <= chars:
        low, high = split(node.right, chars - here)
        node.right = low
        return node.update(), high
    low, high = split(node.left, chars)
    node.left = high
    return low, node.update()


def leaves(node: Node | None) -> list[str]:
    out, stack = [], []
    while node or stack:
        while node:
            stack.append(node)
            node = node.left
        node = stack.pop()
        out.append(node.text)
        node = node.right
    return out


def cut(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        found = _BOUNDARY.search(text, at + LEAF)
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


class Counts:
    """The tree of one document."""

    def __init__(self, encoder: Encoder, text: str | None):
        self.encoder, self.encoded, self.made = encoder, 0, 0
        self.longest = max(map(len, encoder.added), default=0)
        self.root = self._tree(text or "")

    def _special(self, text: str) -> bool:
        return any(a in text for a in self.encoder.added)

    def _tree(self, text: str) -> Node | None:
        # A text with an added token's string, or of a tokenizer whose cutting isn't known, is one leaf.
        parts = cut(text) if self.encoder.kind == "byte" and not self._special(text) else [text] if text else []
        self.encoded += len(text)
        root = None
        for part, raw in zip(parts, self.encoder.raw(parts), strict=True):
            self.made += 1
            root = merge(root, Node(part, len(raw) // 4, self.made))
        return root

    def _near(self, node: Node | None, chars: int, last: bool) -> str:
        """The last (or first) characters below a node, ``chars`` of them if there are as many."""
        out, stack, size = [], [], 0
        while (node or stack) and size < chars:
            while node:
                stack.append(node)
                node = node.right if last else node.left
            node = stack.pop()
            out.append(node.text)
            size += len(node.text)
            node = node.left if last else node.right
        return "".join(reversed(out))[-chars:] if last else "".join(out)[:chars]

    @property
    def tokens(self) -> int:
        return self.root.tokens if self.root else 0

    @property
    def chars(self) -> int:
        return self.root.chars if self.root else 0

    def text(self) -> str:
        return "".join(leaves(self.root))

    def edit(self, begin: int, end: int, new: str) -> None:
        """Put ``new`` in place of characters [begin, end); places beyond the text are its end."""
        begin = min(max(0, begin), self.chars)
        end = min(max(begin, end), self.chars)
        # Boundary context: a leaf's first two characters and the one before them make it a boundary.
        low, rest = split(self.root, max(0, begin - 2))
        base = low.chars if low else 0
        middle, high = split(rest, end + 2 - base)
        if high and (middle.chars if middle else 0) < end + 2 - base:
            first = high
            while first.left:
                first = first.left
            more, high = split(high, len(first.text))
            middle = merge(middle, more)
        old = "".join(leaves(middle))
        text = old[: begin - base] + new + old[end - base :]
        around = max(0, self.longest - 1)
        if self.longest and self._special((self._near(low, around, True) if around else "") + text + (self._near(high, around, False) if around else "")):
            # An added token's string is seen in the whole text.
            text = "".join(leaves(low)) + text + "".join(leaves(high))
            low = high = None
        self.root = merge(merge(low, self._tree(text)), high)


def count_edits(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, edits array<struct<begin, end, text>>): doc_id, n_tokens before the
    edits, n_tokens_edited after them, n_edits, n_chars_edited, n_chars_encoded (that the edits cost).

    Edits apply in order, each to the text the former ones left; places are code points.  Null text: empty.
    Null edits, or a null edit: none; null begin or end: 0; null new text: a deletion.  Repeated rows are
    repeated; other columns aren't read; an empty table gives an empty one.  A tree is in memory for one document
    at a time.  A text with an added token's own string is encoded whole after each edit.
    """

    def run(batches):
        import pyarrow as pa

        encoder = Encoder.of(tokenizer)
        for b in parts(batches):
            rows = []
            for doc_id, text, edits in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tree = Counts(encoder, text)
                before, tree.encoded, n = tree.tokens, 0, 0
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["begin"] or 0, e["end"] or 0, e["text"] or "")
                        n += 1
                rows.append((doc_id, before, tree.tokens, n, tree.chars, tree.encoded))
            if rows:
                names = ["doc_id", "n_tokens", "n_tokens_edited", "n_edits", "n_chars_edited", "n_chars_encoded"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    small_batches(docs.sparkSession)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("edits").cast("array<struct<begin:long,end:long,text:string>>").alias("edits"))
    return read.mapInArrow(run, "doc_id long, n_tokens long, n_tokens_edited long, n_edits long, n_chars_edited long, n_chars_encoded long")


def standard_edits(text: str = "text"):
    """Three edits from a text itself: its middle fiftieth goes, its first 100 characters are put in after a
    third, and a stretch of 20 before its end is set in capitals."""
    t, n = F.coalesce(F.col(text), F.lit("")), F.length(F.coalesce(F.col(text), F.lit("")))
    edit = lambda begin, end, new: F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end"), new.alias("text"))
    half, third = F.floor(n / 2), F.floor(n / 3)
    last = F.greatest(F.lit(0), n - 40)
    return F.array(edit(half, half + F.floor(n / 50), F.lit("")), edit(third, third, F.substring(t, 1, 100)), edit(last, last + 20, F.upper(t.substr(last + 1, F.lit(20)))))
