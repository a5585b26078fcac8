"""Language identification by error-correcting output codes.

Every learned language has a codeword of bits. A binary classifier per bit says
which half of the languages a text belongs to: a naive Bayes log-odds over the hashed
byte n-grams of the text (lengths 2, 3 and 4 of its lower-cased letters, everything
else one space), each half being the pool of its languages. Decoding is
loss-weighted: a language's loss is the sum over the bits of
weight * log(1 + exp(-sign * margin)), the margin being the log-odds per n-gram and the
weight the bit's accuracy beyond chance on training rows; the language with the
smallest loss is chosen. The score is its share among exp(-loss); a text is
``ambiguous`` where the two smallest losses lie closer than ``AMBIGUOUS``.

Up to ``EXHAUSTIVE`` languages have all distinct halvings as bits; beyond, each has a
random codeword of ``BITS_PER_DOUBLING * log2(languages)`` bits from a fixed seed.

Training counts n-grams of a sample of about ``ROWS_PER_LANGUAGE`` labelled rows
of every language (by id hash) in one Spark aggregate; languages x 2**16 counts
reach the driver. Scoring is one pass over all documents, without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0; without
any labelled row every text is ``und``; equal losses go to the first language in
alphabetical order; repeated rows are predicted each on their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from kpilane.llm.common import slices, texts_of, utf8_buffer

FEATURES = 1 << 16
LENGTHS = (2, 3, 4)
ROWS_PER_LANGUAGE = 2_000
EXHAUSTIVE = 6
BITS_PER_DOUBLING = 12
SMOOTHING = 0.5
AMBIGUOUS = 0.05
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
# bytes as n-grams see them: letters in lower case, other ASCII a space
_FOLDED = np.arange(256, dtype=np.uint32)
_FOLDED[65:91] += 32
_FOLDED[[b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]] = 32
_PRIME = np.uint32(2654435761)


def _ngrams(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: the hashed n-grams, and whether one lies within its text and has a letter."""
    folded = _FOLDED[raw]
    n = len(raw)
    row_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    code, blank = folded.copy(), folded == 32
    for length in range(2, max(LENGTHS) + 1):
        if n < length:
            return
        code = (code[:-1] << np.uint32(8)) | folded[length - 1:]
        blank = blank[:-1] & (folded[length - 1:] == 32)
        if length in LENGTHS:
            whole = (row_of[:n - length + 1] == row_of[length - 1:]) & ~blank
            with np.errstate(over="ignore"):
                hashed = ((code + np.uint32(length * 0x9E3779B)) * _PRIME) >> np.uint32(16)
            yield hashed.astype(np.int64), whole


def _count(batches: Iterator[pa.RecordBatch], languages: list[str]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of a task's rows, languages x FEATURES (sparse)."""
    totals = np.zeros(len(languages) * FEATURES, np.int64)
    place = {lang: i for i, lang in enumerate(languages)}
    for batch in slices(batches):
        raw, offsets = utf8_buffer(batch.column(0))
        base = np.array([place[lang] for lang in batch.column(1).to_pylist()], np.int64) * FEATURES
        per_byte = np.repeat(base, np.diff(offsets))
        for hashed, whole in _ngrams(raw, offsets):
            totals += np.bincount((hashed + per_byte[:len(hashed)])[whole], minlength=len(totals))
    seen = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(totals[seen], pa.int64())],
                                     names=["cell", "n"])


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """languages x bits of -1 and 1: different rows, no constant bit."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= EXHAUSTIVE:  # every halving once: the first language is always on the side of 1
        bits = [[1] + [1 - 2 * (k >> i & 1) for i in range(languages - 1)] for k in range(1, 1 << (languages - 1))]
        return np.array(bits, float).T
    n_bits = int(np.ceil(BITS_PER_DOUBLING * np.log2(languages)))
    random = np.random.default_rng(seed)
    while True:
        code = np.stack([random.permutation(np.where(np.arange(languages) < languages // 2, 1.0, -1.0))
                         for _ in range(n_bits)], axis=1)
        if len(np.unique(code, axis=0)) == languages:
            return code


class Identifier:
    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        self.code = codewords(len(languages))
        # each language weighs the same in its half, however many rows it has
        share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
        odds = np.zeros((FEATURES, self.code.shape[1]), np.float32)
        for bit in range(self.code.shape[1]):
            one, other = self.code[:, bit] > 0, self.code[:, bit] < 0
            if one.any() and other.any():
                odds[:, bit] = np.log(share[one].mean(axis=0)) - np.log(share[other].mean(axis=0))
        self.odds = odds
        # the expected margin of each language for each bit scales the margins and weighs the bits
        expected = (share @ odds) * self.code
        self.scale = 4.0 / np.maximum(np.abs(expected).mean(axis=0), 1e-3)
        self.weights = np.clip(expected.min(axis=0) / np.maximum(expected.mean(axis=0), 1e-9), 0.1, 1.0)

    def margins(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean log-odds per n-gram of every text, for every bit."""
        rows = len(offsets) - 1
        total = np.zeros((rows, self.odds.shape[1]))
        number = np.zeros(rows)
        for hashed, whole in _ngrams(raw, offsets):
            values = self.odds[hashed]
            values[~whole] = 0
            starts = np.minimum(offsets[:-1], len(hashed) - 1)
            filled = np.flatnonzero(offsets[1:] > offsets[:-1])
            filled = filled[offsets[filled] < len(hashed)]
            if len(filled):
                total[filled] += np.add.reduceat(values, starts[filled], axis=0, dtype=np.float64)
                number[filled] += np.add.reduceat(whole, starts[filled], dtype=np.int64)
        return total / np.maximum(number, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, ambiguous) of every row."""
        signed = self.code[None] * (margins * self.scale)[:, None]
        loss = (np.logaddexp(0, -signed) * self.weights).sum(axis=2)
        best = loss.argmin(axis=1)
        closeness = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        score = closeness.max(axis=1) / closeness.sum(axis=1)
        ordered = np.sort(loss, axis=1)
        gap = ordered[:, 1] - ordered[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, score, gap < AMBIGUOUS


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows_per_language: int = ROWS_PER_LANGUAGE) -> Identifier | None:
    """Learn from the rows of ``docs`` with a non-null language; None without any."""
    labelled = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"),
                           F.col(lang_col).cast("string").alias("lang")).filter("lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, rows_per_language / sizes[lang]))])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    counted = (labelled.filter((place < share[F.col("lang")]) & F.col("text").isNotNull()).select("text", "lang")
               .mapInArrow(lambda batches: _count(batches, languages), "cell long, n long")
               .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())
    counts = np.zeros(len(languages) * FEATURES)
    counts[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    return Identifier(languages, counts.reshape(len(languages), FEATURES))


def identify(docs: DataFrame, identifier: Identifier | None, text_col: str = "text",
             into: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_ambiguous")) -> DataFrame:
    """``docs`` with the predicted language, its score and whether it is ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(identifier)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, 256):
            texts = batch.column(place)
            written = np.array([bool(LETTER.search(t)) for t in texts_of(texts)], bool)
            names, score, close = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            if known is not None and written.any():
                best, found, close = known.decode(known.margins(*utf8_buffer(texts)))
                names = [known.languages[b] if w else UNKNOWN for b, w in zip(best, written)]
                score, close = np.where(written, found, 0.0), close & written
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())],
                names=[*batch.schema.names, *into])

    fields = [StructField(c, t()) for c, t in zip(into, (StringType, DoubleType, BooleanType))]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *fields]))
