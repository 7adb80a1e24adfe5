"""The tokenizers library behind a cache of pre-tokens.

The two kinds of tokenizer whose settings are listed below cut a text by a pattern, and merge inside a pre-token
only.  Texts of printable Latin characters, for which Python's patterns and the library's agree, are cut at white
space in Arrow, a column at a time; each distinct word is cut by the same pattern, and each distinct pre-token is
merged once by the library's model.  Other texts are cut at spaces and each distinct stretch goes to the library;
texts that hold an added token's string, or a control character that only one of the dialects takes for a space,
go there whole, and so do all texts of a tokenizer with any other settings.
"""

from __future__ import annotations

import gc
import json
import re

import numpy as np

from scrivenry.llm.common import claim, slices

#: Entries in each of a cache's two generations, of Python objects and of Arrow arrays, and bytes of text that are
#: cut at a time: bounds on memory, not on what is encoded.
CACHE_ENTRIES, CACHE_WORDS, SLICE = 250_000, 300_000, 1 << 22
# Of the Latin characters İ alone becomes two in lower case.
_LATIN = "\t-\r -~\u00a1-\u012f\u0131-\u017f"
_PLAIN = re.compile(f"[{_LATIN}]*")
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
# Letters and numbers among the plain characters, and the patterns the two tokenizers cut by.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
_CUT_WORD = re.compile(f"[{_L}]+|[{_N}]|'s|'t|'re|'ve|'m|'ll|'d|[^\\s{_L}{_N}]+")
_CUT_BYTE = re.compile(f" ?[{_L}]+| ?[{_N}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\\s{_L}{_N}]+|\\s+(?!\\S)|\\s+")
#: For RE2: white space that isn't a pre-token for each character (shorter runs are), and a boundary inside words.
_RUNS, _EDGE = r"[ \n]{3}|[ \n]{2}\z|[\t\r\v\f]", f"([{_L}{_N}])([^\\s{_L}{_N}])"
# The settings of the tokenizers whose cutting is known here.
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
_BYTE = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "suffix": None}
_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "suffix": "</w>",
}
# How the byte level shows a byte; printable Latin as itself, the others from U+0100 on.
_SELF = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _SELF)}
_SPACE = chr(_SHOWN[0x20])
_WORKER: dict[str, Encoder] = {}


def kind_of(settings: dict) -> str | None:
    """byte or word for a tokenizer file whose cutting is known here, None for any other."""
    model = {k: settings["model"].get(k) for k in _MODEL}
    added = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in settings.get("added_tokens", []))
    own = {"normalizer": settings.get("normalizer"), "pre_tokenizer": settings.get("pre_tokenizer"), "suffix": settings["model"].get("end_of_word_suffix")}
    if model != _MODEL or not added or settings.get("truncation") or settings.get("padding"):
        return None
    return next((name for name, known in (("byte", _BYTE), ("word", _WORD)) if own == known), None)


class _Cache(dict):
    """Values made on demand, in two generations: what is used again is kept, the rest goes when the younger one
    is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        return self.put(key, self.make(key) if value is None else value)

    def put(self, key, value):
        if len(self) >= CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _gather(table: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Stretches of a table, one after another."""
    end = np.cumsum(n)
    at = np.repeat((begin - end + n).astype(np.int64 if len(table) > 1 << 30 else np.int32), n)
    at += np.arange(len(at), dtype=at.dtype)
    return table[at]


class _Words:
    """Words and their ids as Arrow and numpy arrays."""

    def __init__(self):
        import pyarrow as pa

        self.words, self.ids = pa.array([], pa.large_string()), np.zeros(0, "<u4")
        self.begin = self.size = np.zeros(0, np.int64)

    def find(self, words) -> np.ndarray:
        """The place of each word, -1 if it isn't there."""
        import pyarrow.compute as pc

        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of words that are there."""
        return _gather(self.ids, self.begin[places], self.size[places]), self.size[places]

    def add(self, words, ids: np.ndarray, size: np.ndarray) -> None:
        import pyarrow as pa

        self.words = pa.concat_arrays([self.words, words])
        self.ids, self.size = np.append(self.ids, ids), np.append(self.size, size)
        self.begin = np.cumsum(self.size) - self.size


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.kind = kind_of(settings)
        self.added = [t["content"] for t in settings.get("added_tokens", [])]
        self.odd = re.compile("|".join([*map(re.escape, self.added), "[\x1c-\x1f]"]))
        self.model = self.library.model
        self.number = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.words, self.old = _Words(), _Words()
        self.tokens, self.stretches = _Cache(self._merge), _Cache(lambda t: self._whole([t])[0])

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each worker process."""
        claim("encoder", _WORKER.clear)
        if path not in _WORKER:
            _WORKER[path] = cls(path)
        return _WORKER[path]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, token: str) -> bytes:
        """Ids of one pre-token, by the library's model."""
        if not token.isascii() or token.isspace():  # the byte level shows spaces and other bytes by other characters
            token = token.encode().decode("latin-1").translate(_SHOWN)
        elif token[0] == " ":
            token = _SPACE + token[1:]
        return b"".join([self.number[t.id] for t in self.model.tokenize(token)])

    def _word(self, word: str) -> bytes:
        """Ids of what ``_words`` cuts.  Where white space is part of tokens a word has a space before it, unless
        it begins with a line break, with U+0001 (a cut inside a word) or with NUL (the text's beginning)."""
        if word.isalpha():
            return self._merge(word if self.kind == "word" else " " + word)
        if self.kind == "byte":
            word = word if word[:1] == "\n" else word[1:] if word[:1] in ("\0", "\1") else " " + word
        return b"".join(map(self._merge, (_CUT_BYTE if self.kind == "byte" else _CUT_WORD).findall(word)))

    def _plain(self, text: str) -> bytes:
        found = _CUT_WORD.findall(text.lower()) if self.kind == "word" else _CUT_BYTE.findall(text)
        return b"".join(map(self.tokens.__getitem__, found))

    def _other(self, texts: list[str]) -> list[bytes]:
        cut = [[t] if self.odd.search(t) else _SPACED.findall(t) for t in texts]
        held = self.stretches
        missing = [k for k in set().union(*cut) if k not in held and k not in held.old]
        made = dict(zip(missing, self._whole(missing), strict=True))
        out = [b"".join([made[k] if k in made else held[k] for k in p]) for p in cut]
        for k, v in made.items():
            if len(k) < 64:  # a long stretch hardly comes again
                held.put(k, v)
        return out

    def raw(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: empty), as bytes."""
        texts = [t or "" for t in texts]
        if self.kind is None:
            return [b for low, high in slices(texts) for b in self._whole(texts[low:high])]
        out: list[bytes] = []
        on = gc.isenabled()
        gc.disable()  # millions of strings and no cycle among them
        try:
            for low, high in slices(texts):
                part = texts[low:high]
                plain = [bool(_PLAIN.fullmatch(t)) and not any(a in t for a in self.added) for t in part]
                other = iter(self._other([t for t, p in zip(part, plain, strict=True) if not p]))
                out += [self._plain(t) if p else next(other) for t, p in zip(part, plain, strict=True)]
        finally:
            if on:
                gc.enable()
        return out

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(b, "<u4") for b in self.raw(texts)]

    def _words(self, texts) -> list[np.ndarray]:
        """Ids of plain texts, an Arrow array without nulls or long runs of white space.  Texts are cut at spaces,
        and where a letter or digit stands before neither, a boundary of pre-tokens in any text; each distinct
        word is looked up once and the ids are put together by numpy."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.kind == "byte":
            nul, none = (pa.scalar(x, texts.type) for x in ("\0", ""))
            marked = pc.replace_substring(pc.binary_join_element_wise(nul, texts, none), "\n", " \n")
            cut = pc.split_pattern(pc.replace_substring_regex(marked, _EDGE, "\\1 \1\\2"), " ")
        else:
            cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _EDGE, "\\1 \\2"))
        per_text = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
        found = cut.flatten().dictionary_encode()
        del cut
        at, which = self._known(found.dictionary), found.indices.to_numpy(zero_copy_only=False)
        del found
        begin, size = self.words.begin[at], self.words.size[at]
        n = size[which]
        out, ends = _gather(self.words.ids, begin[which], n), np.append(0, np.cumsum(n))
        edges = ends[np.append(0, np.cumsum(per_text))]
        return [out[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def _known(self, words) -> np.ndarray:
        """The place of each of some distinct words among the known ones, the unknown ones added."""
        import pyarrow as pa

        at = self.words.find(words)
        if (at < 0).any() and len(self.words.words) + int((at < 0).sum()) > CACHE_WORDS:
            self.old, self.words = self.words, _Words()
            at[:] = -1
        absent = np.flatnonzero(at < 0)
        if len(absent):
            former = self.old.find(words.take(pa.array(absent)))
            again, new = absent[former >= 0], absent[former < 0]
            ids, size = self.old.take(former[former >= 0])
            fresh = words.take(pa.array(new))
            raw = list(map(self._word, fresh.to_pylist()))
            at[again] = len(self.words.words) + np.arange(len(again))
            at[new] = len(self.words.words) + len(again) + np.arange(len(new))
            made = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            self.words.add(pa.concat_arrays([words.take(pa.array(again)), fresh]), np.append(ids, np.frombuffer(b"".join(raw), "<u4")), np.append(size, made))
        return at

    def column(self, texts) -> list[np.ndarray]:
        """Ids of each text of an Arrow array (null: empty)."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, f"[^{_LATIN}]")
        for a in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, a))
        if self.kind == "byte":
            odd = pc.or_(odd, pc.match_substring_regex(texts, _RUNS))
        if self.kind is None:
            odd = pc.or_(odd, True)
        plain, other, out = texts.filter(pc.invert(odd)), iter(self.ids(texts.filter(odd).to_pylist())), []
        for low, high in slices(pc.binary_length(plain).to_pylist(), SLICE, size=int):
            out += self._words(plain.slice(low, high - low))
        own = iter(out)
        return [next(other) if o else next(own) for o in odd.to_pylist()]
