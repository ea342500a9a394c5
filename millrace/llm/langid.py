"""Language identification by one bit-sliced Bloom filter over character n-grams.

Every position of the filter holds a bit for each language. The three positions of an n-gram, combined by
"and", name all languages that contain it at once. For each text the bits are counted per language;
a share of hits that is no more than the filter's false positives is taken off, and the largest corrected
count decides.

N-grams are 3 and 4 characters of lower-case letters, with one space at either end at most; all that is no letter
is a space. A language stores its most frequent n-grams, at most ``GRAMS``, unless they are over ``CONTRAST`` times as
frequent in another language. They are learned from a sample of at most about ``SAMPLE_ROWS`` rows a language, drawn
by a hash of the text. So what the driver and the tasks hold depends on the number of languages only.

Defined cases: a NULL text and one without letters are ``und`` with score 0. Without any labelled row everything is
``und``. A text that no language knows gets the language with most labelled rows, with score 0. Texts are read
whole; a very long one in pieces that end at white space where there is any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

SAMPLE_ROWS = 2000
GRAMS = 16384
CONTRAST = 4
LEAST_COUNT = 3
SIZES = (3, 4)
HASHES = 3
PIECE = 1 << 20
BATCH_CHARS = 1 << 18
UNKNOWN = "und"

_KEYS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class Grams:
    """N-gram hashes of texts."""

    def __init__(self) -> None:
        self.kind = np.zeros(0x110000, np.uint8)  # 1: letter, 2: not

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.kind[codes]
        if not kinds.all():
            new = np.unique(codes[kinds == 0])
            self.kind[new] = [1 if chr(c).isalpha() else 2 for c in new.tolist()]
            kinds = self.kind[codes]
        return kinds == 1

    def of(self, pieces: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The letters of each piece, and for each n-gram size the hashes and where each piece's begin."""
        lengths = np.array([len(p) + 1 for p in pieces])
        codes = np.frombuffer(("\n" + "\n".join(pieces) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self._letters(codes)
        keep = letter.copy()
        keep[0] = True
        keep[1:] |= letter[:-1]
        at = np.flatnonzero(keep)
        text = np.where(letter[at], codes[at], 32).astype(np.uint64)
        bounds = np.concatenate([[1], 1 + np.cumsum(lengths)])
        first = np.searchsorted(at, bounds)
        sums = np.concatenate([[0], np.cumsum(letter)])
        out = []
        for n in SIZES:
            count = max(0, len(text) - n + 1)
            h = np.full(count, np.uint64(n))
            inner = np.ones(count, bool)
            for i in range(n):
                part = text[i : i + count]
                h += part * _KEYS[i]
                if 0 < i < n - 1:
                    inner &= part != 32
            h = (h ^ (h >> np.uint64(31))) * _KEYS[4]
            h ^= h >> np.uint64(29)
            # An n-gram belongs to the piece of its second character, which is a letter.
            starts = np.concatenate([[0], np.cumsum(inner)])[np.clip(first - 1, 0, count)]
            out.append((h[inner], starts))
        return np.diff(sums[bounds]), out


def pieces_of(texts: list[str | None]) -> tuple[list[str], list[int]]:
    """Lower-case pieces of at most ``PIECE`` characters, and the row of each."""
    pieces, rows = [], []
    for row, text in enumerate(texts):
        text = (text or "").lower()
        low = 0
        while True:
            high = low + PIECE
            if high < len(text):
                cut = max(text.rfind(" ", low, high), text.rfind("\n", low, high))
                high = cut if cut > low else high
            pieces.append(text[low:high])
            rows.append(row)
            low = high
            if low >= len(text):
                break
    return pieces, rows


def _batches(pieces: list[str]) -> Iterator[tuple[int, int]]:
    low = 0
    while low < len(pieces):
        high, size = low, 0
        while high < len(pieces) and (high == low or size + len(pieces[high]) <= BATCH_CHARS):
            size += len(pieces[high])
            high += 1
        yield low, high
        low = high


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # positions x words of 64 languages
    false_rate: np.ndarray
    fallback: int

    def masks(self, hashes: np.ndarray, word: int) -> np.ndarray:
        """For each n-gram, a bit for each language that contains it."""
        column, last, shift = self.table[:, word], np.uint64(len(self.table) - 1), 64 // HASHES
        out = column[(hashes & last).astype(np.int64)]
        for i in range(1, HASHES):
            out = out & column[((hashes >> np.uint64(i * shift)) & last).astype(np.int64)]
        return out

    def counts(self, grams: Grams, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Letters, n-grams, and hits of each language, for each piece."""
        letters, found = grams.of(pieces)
        total = sum(np.diff(starts) for _, starts in found)
        hits = np.zeros((len(pieces), len(self.languages)), np.int64)
        for hashes, starts in found:
            for word in range(self.table.shape[1]):
                masks = self.masks(hashes, word)
                for bit in range(min(64, len(self.languages) - 64 * word)):
                    ones = np.concatenate([[0], np.cumsum((masks >> np.uint64(bit)) & np.uint64(1))])
                    hits[:, 64 * word + bit] += np.diff(ones[starts].astype(np.int64))
        return letters, total, hits

    def decide(self, letters: np.ndarray, total: np.ndarray, hits: np.ndarray) -> tuple[list[str], np.ndarray]:
        corrected = np.maximum((hits - total[:, None] * self.false_rate) / (1 - self.false_rate), 0)
        best = corrected.argmax(axis=1) if len(self.languages) else np.zeros(len(total), int)
        top = corrected[np.arange(len(total)), best] if len(self.languages) else np.zeros(len(total))
        best = np.where(top > 0, best, self.fallback)
        some = (letters > 0) & bool(self.languages)
        names = [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
        return names, np.where(some, np.clip(top / np.maximum(total, 1), 0, 1), 0.0)


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, grams: int = GRAMS) -> Model:
    """A model from rows ``text, lang``; rows without either are ignored."""
    labelled = labelled.select("text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1, 1), np.uint64), np.zeros(0), 0)
    # A row is drawn with odds that give sample_rows rows in each language.
    odds = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_rows / counts[lang]))])
    lot = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.filter(lot < odds[F.col("lang")])
    order = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams_ = Grams()
        for batch in batches:
            langs = np.array([order[x] for x in batch.column(1).to_pylist()])
            pieces, rows = pieces_of(batch.column(0).to_pylist())
            for low, high in _batches(pieces):
                lang = langs[rows[low:high]]
                for hashes, starts in grams_.of(pieces[low:high])[1]:
                    of = np.repeat(lang, np.diff(starts))
                    for i in np.unique(lang):
                        values, n = np.unique(hashes[starts[0] : starts[-1]][of == i], return_counts=True)
                        yield pa.RecordBatch.from_pydict({"l": np.full(len(values), i, np.int32), "g": values.view(np.int64), "n": n})

    summed = sample.mapInArrow(count, "l int, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("l"))
    rated = summed.withColumn("rate", rate).withColumn("top", F.max("rate").over(Window.partitionBy("g")))
    rated = rated.filter((F.col("n") >= LEAST_COUNT) & (F.col("rate") * CONTRAST >= F.col("top")))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))
    kept: pd.DataFrame = rated.withColumn("place", place).filter(F.col("place") <= grams).select("l", "g").toPandas()
    size = 1 << max(10, int(grams * 16 - 1).bit_length())
    table = np.zeros((size, -(-len(languages) // 64)), np.uint64)
    for i in range(len(languages)):
        hashes = kept["g"][kept["l"] == i].to_numpy().view(np.uint64)
        for j in range(HASHES):
            at = (hashes >> np.uint64(j * (64 // HASHES))) & np.uint64(size - 1)
            np.bitwise_or.at(table[:, i // 64], at.astype(np.int64), np.uint64(1 << (i % 64)))
    filled = [((table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** HASHES for i in range(len(languages))]
    return Model(languages, table, np.array(filled), languages.index(max(languages, key=counts.get)))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the share of the text's n-grams that the language knows."""
    shared = docs.sparkSession.sparkContext.broadcast([model.languages, model.table.tobytes(), model.table.shape, model.false_rate.tolist(), model.fallback])
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, raw, shape, rates, fallback = shared.value
        own = Model(languages, np.frombuffer(raw, np.uint64).reshape(shape), np.array(rates), fallback)
        grams_ = Grams()
        for whole in batches:
            for low_row in range(0, whole.num_rows, 1024):
                batch = whole.slice(low_row, 1024)
                pieces, rows = pieces_of(batch.column("text").to_pylist())
                letters, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                hits = np.zeros((batch.num_rows, len(languages)), np.int64)
                for low, high in _batches(pieces):
                    a, b, c = own.counts(grams_, pieces[low:high])
                    at = rows[low:high]
                    np.add.at(letters, at, a)
                    np.add.at(total, at, b)
                    np.add.at(hits, at, c)
                names, scores = own.decide(letters, total, hits)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*rest, "lang_pred", "score"])

    made = docs.select(*rest)
    return made.mapInArrow(predict, StructType([*made.schema, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def in_training(doc_id: Column) -> Column:
    """Whether a row may be learned from: a third of the ids is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3, F.lit(0)) != 1
