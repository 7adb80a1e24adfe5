"""Benchmark passages in documents: pigeonhole pieces, then Myers' bit-parallel distance.

An item of m characters may differ by k = floor(rate * m) edits.  It is split into k + 1 pieces; a copy within
the budget leaves one piece as it is, and all pieces of all items are found in one pass over a text.  The
pieces stand in groups of at most 64 characters, and of the groups one with c pieces has at most c - 1 edits
and a piece without any; so a hit is first held against its group, 64-bit words of many hits at a time.  What
is left is confirmed by the whole item's distance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivenry.llm.common import claim, parts, slices, small_batches

#: Characters of items in one pass over the documents; more items take more passes.
PASS_CHARS = 4_000_000
#: Characters whose bits stand in a dense table for each group; the rarer ones' are looked up.
DENSE = 128
_PAD = 512
_ONE, _TOP = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACES = {c: " " for c in (9, 10, 11, 12, 13, 0x85, 0xA0, 0x2028, 0x2029)}


def normal(text: str) -> str:
    """Lower case and plain spaces, character by character: places stay as they are."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.translate(_SPACES)


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least distance of ``pattern`` to a stretch of ``text``, the first end of such a stretch)."""
    m, masks = len(pattern), {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(across | up) & full, up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | ~(vertical | plus) & full, plus & vertical
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds items in texts.  items: (item_id, text); shorter ones than ``least_chars`` match nothing."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least_chars: int = 1):
        import ahocorasick

        self.items = [(i, t, int(rate * len(t))) for i, t in ((i, normal(t).strip()) for i, t in items if t) if len(t) >= max(1, least_chars)]
        self.automaton, found = ahocorasick.Automaton(), {}
        self.codes = np.zeros(0x110000, np.uint32)
        alphabet = [c for c, _ in Counter(c for _, t, _ in self.items for c in t).most_common()]
        self.codes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.groups: list[tuple[int, int, int, int]] = []  # item, begin, length, edits
        self.pieces: list[tuple[int, int, int]] = []  # item, begin, group
        masks: list[dict[int, int]] = []
        for n, (_, text, k) in enumerate(self.items):
            edges = [len(text) * j // (k + 1) for j in range(k + 2)]
            j = 0
            while j <= k:
                last = j + 1
                while last <= k and edges[last + 1] - edges[j] <= 64:
                    last += 1
                begin, length = edges[j], min(64, edges[last] - edges[j])
                mask: dict[int, int] = {}
                for i, c in enumerate(self.codes[np.frombuffer(text[begin : begin + length].encode("utf-32-le"), np.uint32)].tolist()):
                    mask[c] = mask.get(c, 0) | 1 << i
                masks.append(mask)
                for p in range(j, last):
                    found.setdefault(text[edges[p] : edges[p + 1]], []).append(len(self.pieces))
                    self.pieces.append((n, edges[p], len(self.groups)))
                self.groups.append((n, begin, length, last - j - 1))
                j = last
        self.dense, self.size = np.zeros((len(masks), DENSE), np.uint64), len(alphabet) + 1
        rare = []
        for g, mask in enumerate(masks):
            for c, bits in mask.items():
                if c < DENSE:
                    self.dense[g, c] = bits
                else:
                    rare.append((g * self.size + c, bits))
        rare.sort()
        self.rare, self.rare_bits = (np.array([r[i] for r in rare], t) for i, t in ((0, np.int64), (1, np.uint64)))
        self.group = np.array(self.groups, np.int64).reshape(-1, 4)
        self.piece = np.array(self.pieces, np.int64).reshape(-1, 3)
        for piece, numbers in found.items():
            self.automaton.add_word(piece, (len(piece), numbers))
        if found:
            self.automaton.make_automaton()

    def _bits(self, group: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Where in its group each character stands."""
        odd = code >= DENSE
        out = self.dense[group, np.where(odd, 0, code)]
        if odd.any():
            key = group[odd] * self.size + code[odd]
            at = np.minimum(np.searchsorted(self.rare, key), max(0, len(self.rare) - 1))
            out[odd] = np.where(self.rare[at] == key, self.rare_bits[at], np.uint64(0)) if len(self.rare) else 0
        return out

    def _near(self, codes: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which hits have their group within its edits.  at: where the group would begin in ``codes``."""
        _, _, length, edits = self.group[group].T
        begin, steps = at - edits, length + 2 * edits
        last = (length - 1).astype(np.uint64)
        up, down, score = np.full(len(at), _TOP), np.zeros(len(at), np.uint64), length.copy()
        best = score.copy()
        for j in range(int(steps.max())):
            code = np.where(j < steps, codes[begin + j], 0).astype(np.int64)
            eq = self._bits(group, code)
            vertical = eq | down
            across = (((eq & up) + up) ^ up) | eq
            plus, minus = down | ~(across | up), up & across
            score += ((plus >> last) & _ONE).astype(np.int64) - ((minus >> last) & _ONE).astype(np.int64)
            plus, minus = plus << _ONE, minus << _ONE
            up, down = minus | ~(vertical | plus), plus & vertical
            np.minimum(best, score, out=best)
        return best <= edits

    def find(self, texts: list[str | None]) -> Iterator[list[tuple[int, int, int, int]]]:
        """For each text (item_id, distance, begin, end) of every item in it: its nearest stretch, the first
        of several."""
        for own in self.found(texts):
            yield [(self.items[n][0], *f) for n, *f in own]

    def found(self, texts: list[str | None]) -> Iterator[list[tuple[int, int, int, int]]]:
        """As ``find``, with the item's number in ``items``."""
        texts = [normal(t) if t else "" for t in texts]
        for low, high in slices(texts):
            yield from self._find(texts[low:high])

    def _find(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        doc, place, piece, chunks, bases, at = [], [], [], [], [], _PAD
        for d, text in enumerate(texts):
            n = len(piece)
            if self.items:
                for end, (size, numbers) in self.automaton.iter(text):
                    for p in numbers:
                        piece.append(p)
                        place.append(end + 1 - size)
            doc += [d] * (len(piece) - n)
            bases.append(at)
            if len(piece) > n:
                chunks += [np.zeros(_PAD, np.uint32), self.codes[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]]
                at += len(text) + _PAD
        out: list[list] = [[] for _ in texts]
        if not piece:
            return out
        codes = np.concatenate([*chunks, np.zeros(_PAD, np.uint32)])
        own = self.piece[np.array(piece)]
        begin = np.array(place) - own[:, 1]  # where the item would begin
        ok = np.zeros(len(piece), bool)
        bases, doc = np.array(bases), np.array(doc)
        for i in range(0, len(piece), 16384):
            part = slice(i, i + 16384)
            group = own[part, 2]
            ok[part] = self._near(codes, np.clip(begin[part] + self.group[group, 1] + bases[doc[part]], 64, len(codes) - 256), group)
        left: dict[tuple[int, int], list[int]] = {}
        for d, n, b in zip(doc[ok].tolist(), own[ok, 0].tolist(), begin[ok].tolist(), strict=True):
            left.setdefault((d, n), []).append(b)
        for (d, n), begins in left.items():
            _, pattern, k = self.items[n]
            text, m, best = texts[d], len(pattern), None
            begins.sort()
            i = 0
            while i < len(begins):
                j = i
                while j + 1 < len(begins) and begins[j + 1] - begins[j] <= k:
                    j += 1
                low, high = max(0, begins[i] - k), begins[j] + m + k
                distance, end = myers(pattern, text[low:high])
                if distance <= k and (best is None or distance < best[0]):
                    stretch = text[max(0, low + end - m - k) : low + end]
                    best = (distance, low + end - myers(pattern[::-1], stretch[::-1])[1], low + end)
                i = j + 1
            if best:
                out[d].append((n, *best))
        for found in out:
            found.sort()
        return out


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Distinct (item_id, text) in blocks of at most ``PASS_CHARS`` characters (or one item), by item_id."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r.text) > PASS_CHARS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.1, least_chars: int = 1) -> DataFrame:
    """Rows (doc_id, item_id, distance, begin, end, item_chars), one for each document and item in it.

    Letters are compared without case and any white space as a space; an item matches where at most
    floor(rate * its characters) insertions, deletions or exchanges remain.  begin and end are code points of
    the text, of the nearest stretch (the first, of several).  Null or empty texts and items, and items of
    nothing but white space or fewer than ``least_chars`` characters, match nothing; by default every other item
    is looked for, and one of fewer than 10 characters, with no edit to spare, as it is.  Null doc_id or item_id:
    shown as null.  Repeated documents are repeated, repeated items are not, and texts under one item_id are items
    each.  Other columns aren't read.  Items are sent to the tasks in blocks of a bounded size, one pass over the
    documents for each.  An empty table on either side gives an empty one.
    """
    spark, schema = docs.sparkSession, "doc_id long, item_id long, distance long, begin long, end long, item_chars long"
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in item_blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def find(batches, sent=sent):
            import pyarrow as pa

            matcher = _matcher(sent, rate, least_chars)
            names = ["doc_id", "item_id", "distance", "begin", "end", "item_chars"]
            for b in parts(batches):
                rows = [(doc_id, matcher.items[n][0], *f, len(matcher.items[n][1])) for doc_id, own in zip(b.column(0).to_pylist(), matcher.found(b.column(1).to_pylist()), strict=True) for n, *f in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        found = texts.mapInArrow(find, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, rate: float = 0.1, least_chars: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text holds no item; see ``matches``.  Null and
    empty texts hold none and stay, and so does everything where there are no items."""
    small_batches(docs.sparkSession)
    for block in item_blocks(items):
        sent, column = docs.sparkSession.sparkContext.broadcast(block), docs.columns.index("text")

        def keep(batches, sent=sent, column=column):
            import pyarrow as pa

            matcher = _matcher(sent, rate, least_chars)
            for b in parts(batches):
                yield b.filter(pa.array([not f for f in matcher.found(b.column(column).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


_made: dict = {}


def _matcher(sent, rate: float, least_chars: int) -> Matcher:
    """The worker's matcher for a broadcast block; the last one is kept."""
    key = (sent._jbroadcast_id if hasattr(sent, "_jbroadcast_id") else id(sent.value), rate, least_chars)
    claim("items", _made.clear)
    if key not in _made:
        _made.clear()
        _made[key] = Matcher(sent.value, rate, least_chars)
    return _made[key]
