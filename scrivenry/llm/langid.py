"""Language identification: known words by their log frequency in each language, unseen words by the
longest character n-grams that are known, and no further."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from scrivenry.llm.common import claim, parts, slices, small_batches

#: Labelled documents taken for each language (the only bound: all their words and n-grams are kept), and the
#: longest n-grams.
SAMPLE, LONGEST = 5_000, 5
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Words that are remembered, and words whose n-grams are looked up together.
_MEMO, _TOGETHER = 100_000, 4096


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def keys_of(entries: list[str]) -> np.ndarray:
    """64-bit hashes, which stand for words and n-grams in a model."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(e.encode("utf-8", "surrogatepass")) for e in entries), np.uint64, len(entries))


class Table:
    """Log frequencies of entries by hash: for each language that of an entry it hasn't got, and for each entry the
    languages it was seen in, with its log frequency there."""

    def __init__(self, entries: list[str], rows: np.ndarray, columns: np.ndarray, counts: np.ndarray, languages: int):
        """counts: of entry ``rows[i]`` in language ``columns[i]``."""
        keys = keys_of(entries)
        order = np.argsort(keys)
        self.keys = keys[order]
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        total = np.bincount(columns, counts, minlength=languages) + 0.5 * max(1, len(keys))
        self.base = np.log(0.5 / total).astype(np.float32)
        at = np.lexsort((columns, place[rows]))
        self.begin = np.append(0, np.cumsum(np.bincount(place[rows], minlength=len(keys))))
        self.columns = columns[at].astype(np.int32)
        self.values = np.log((counts[at] + 0.5) / total[columns[at]]).astype(np.float32)

    def places(self, entries: list[str]) -> np.ndarray:
        """The row of each entry, -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(entries), -1)
        keys = keys_of(entries)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _spans(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, n = self.begin[places], self.begin[places + 1] - self.begin[places]
        return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum()), n

    def sums(self, places: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        """Log frequencies, by language, of entries that are there, summed by the row each belongs to."""
        at, n = self._spans(places)
        more = self.values[at] - self.base[self.columns[at]]
        found = np.bincount(np.repeat(rows, n) * len(self.base) + self.columns[at], more, minlength=n_rows * len(self.base))
        return found.reshape(n_rows, -1) + np.bincount(rows, minlength=n_rows)[:, None] * self.base

    def logs(self, places: np.ndarray) -> np.ndarray:
        """The log frequencies, by language, of entries that are there."""
        out = np.tile(self.base, (len(places), 1))
        at, n = self._spans(places)
        out[np.repeat(np.arange(len(places)), n), self.columns[at]] = self.values[at]
        return out


class Model:
    """words and grams: (language, entry, n) rows; n-grams of all lengths together."""

    def __init__(self, words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]]):
        self.languages = sorted({r[0] for r in (*words, *grams)})
        column = {lang: i for i, lang in enumerate(self.languages)}

        def table(rows: list[tuple[str, str, int]]) -> Table:
            entries: dict[str, int] = {}
            which = np.fromiter((entries.setdefault(e, len(entries)) for _, e, _ in rows), np.int64, len(rows))
            langs = np.fromiter((column[lang] for lang, _, _ in rows), np.int64, len(rows))
            return Table(list(entries), which, langs, np.fromiter((n for _, _, n in rows), np.float32, len(rows)), len(self.languages))

        self.words = table(words)
        self.grams = {n: table([r for r in grams if len(r[1]) == n]) for n in range(1, LONGEST + 1)}
        self.memo: dict[str, np.ndarray | None] = {}

    def unseen(self, words: list[str]) -> list[np.ndarray | None]:
        """Of each word the mean log frequency over its longest n-grams that are known; None if none is."""
        out: list[np.ndarray | None] = [None] * len(words)
        left = list(range(len(words)))
        for n in range(LONGEST, 0, -1):
            grams = [grams_of(words[i], n) for i in left]
            place = self.grams[n].places([g for own in grams for g in own])
            row, known = np.repeat(np.arange(len(left)), [len(own) for own in grams]), place >= 0
            times = np.bincount(row[known], minlength=len(left))
            if times.any():
                mean = (self.grams[n].sums(place[known], row[known], len(left)) / np.maximum(times, 1)[:, None]).astype(np.float32)
                for k in np.flatnonzero(times).tolist():
                    out[left[k]] = mean[k]
            left = [i for i, t in zip(left, times.tolist(), strict=True) if not t]
            if not left:
                break
        return out

    def scores(self, word: str) -> np.ndarray:
        return self._table([word])[0][0]

    def _table(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's log frequencies (0 where nothing is known of it), and whether something is."""
        out, seen = np.zeros((len(words), len(self.languages)), np.float32), np.ones(len(words), bool)
        place = self.words.places(words)
        out[place >= 0] = self.words.logs(place[place >= 0])
        if len(self.memo) > _MEMO:
            self.memo.clear()
        missing = np.flatnonzero(place < 0).tolist()
        new = [w for w in (words[i] for i in missing) if w not in self.memo]
        for k in range(0, len(new), _TOGETHER):
            self.memo.update(zip(new[k : k + _TOGETHER], self.unseen(new[k : k + _TOGETHER]), strict=True))
        for i in missing:
            own = self.memo[words[i]]
            if own is None:
                seen[i] = False
            else:
                out[i] = own
        return out, seen

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, whether any word or n-gram of the text is known) of each text."""
        out: list[tuple[str, float, bool]] = []
        for low, high in slices([t or "" for t in texts]):
            cut = [words_of(t) for t in texts[low:high]]
            new = sorted(set().union(*cut))
            number, (table, seen) = {w: i for i, w in enumerate(new)}, self._table(new)
            for text, own in zip(texts[low:high], cut, strict=True):
                # Words may be made of characters that are neither digits nor letters, such as superscripts.
                if not own or not self.languages or not any(map(str.isalpha, text)):
                    out.append((UNKNOWN, 0.0, False))
                    continue
                which = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
                logs = table[which].sum(0, dtype=np.float64)
                share = np.exp((logs - logs.max()) / math.sqrt(len(own)))
                best = int(logs.argmax())  # of equal ones the first by name
                out.append((self.languages[best], float(share[best] / share.sum()), bool(seen[which].any())))
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [(lang, score) for lang, score, _ in self.judge(texts)]


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows (doc_id, text, lang) with lang and text.  Of each language about ``sample`` documents are
    taken, by a hash of doc_id and the text's length (repeated rows together); that bounds the model's input,
    whatever the table's size.  Null lang or text: not learned from.  Counts are summed by the cluster; those of
    all words and n-grams of the sample come to the driver.  An empty table gives a model without languages."""
    known = labelled.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model({}, {})
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / float(1 << 30)

    def count(batches):
        import pyarrow as pa
        from collections import Counter

        claim("language counts", lambda: None)
        found: dict[str, Counter] = {}
        for b in parts(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text))
        for lang, own in found.items():
            grams: Counter = Counter()
            for w, c in own.items():
                for n in range(1, LONGEST + 1):
                    for g in grams_of(w, n):
                        grams[g] += c
            for kind, counted in ((0, own), (1, grams)):
                if counted:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counted)), pa.array([kind] * len(counted), pa.int32()), pa.array(list(counted)), pa.array(list(counted.values()), pa.int64())], names=["lang", "kind", "gram", "n"])

    small_batches(labelled.sparkSession)
    taken = known.where(draw < share).select("text", "lang").mapInArrow(count, "lang string, kind int, gram string, n long")
    counts = taken.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n")).toArrow()
    rows: list[list[tuple]] = [[], []]
    for b in counts.to_batches(1 << 16):
        for lang, kind, gram, n in sorted(zip(*(c.to_pylist() for c in b.columns), strict=True)):
            rows[kind].append((lang, gram, n))
    return Model(*rows)


def identify(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The named columns of ``docs`` plus lang_pred and score, for every row, from its text alone.

    A text that is null or has no letter: ``und`` and 0.  Equal likelihoods: the first language by name.
    Columns named lang_pred or score are replaced; others pass as they are.  Repeated rows are repeated.
    score: the share of the best language, of likelihoods tempered by the root of the number of words.  An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    columns = [c for c in columns if c not in ("lang_pred", "score")]
    read = docs.select(*columns, F.col("text").alias("__text"))

    def predict(batches):
        import pyarrow as pa

        claim("language", lambda: sent.__dict__.pop("_value", None))
        for b in parts(batches):
            if b.num_rows:
                lang, score = zip(*sent.value.predict(b.column(len(columns)).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*columns, "lang_pred", "score"])

    schema = StructType([*read.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return read.mapInArrow(predict, schema)


def known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a letter and a word or n-gram that the model
    knows; see ``identify``."""
    small_batches(docs.sparkSession)
    sent, column = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        claim("language", lambda: sent.__dict__.pop("_value", None))
        for b in parts(batches):
            yield b.filter(pa.array([seen for _, _, seen in sent.value.judge(b.column(column).to_pylist())], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
