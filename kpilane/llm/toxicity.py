"""Toxicity by class-conditional Kneser-Ney models.

Whole texts are read, as words: runs of letters, runs of digits, single signs. Two models, one for toxic and one for
ordinary documents, give the probability of a word character by character, to its end. In class k, after the
history h, with absolute discount D:

    P_k(c | h) = (max(n_k(hc) - D, 0) + D * followers_k(h) * P(c | h)) / n_k(h)
    P(c | h)   = kinds(hc) / kinds(h)

The history is the word's beginning, and slides from the character after ``BEGINNING`` on: it then holds the
``BEGINNING`` - 1 characters before. ``n_k`` counts occurrences, ``followers_k`` the different characters seen after h,
and P is the backoff shared by both classes: Kneser-Ney continuation counts, the
number of places in different words with hc. Where a class has not seen h, P_k is P, so
a rare expression moves the comparison only through the histories that it
shares with others. A word's evidence is the difference of its two
log-likelihoods.

The same formula over words gives expressions of two: h is the word before, c the word, and kinds counts different
words before c. Their order counts.

A document's log-likelihoods are compared length-normalised: the mean evidence
over all its words, and the mean over the few words with the most evidence, of single words and of pairs,
since a short insult in a long text is toxic too. A logistic regression on these
means and the logarithm of the number of words (the largest of many values is
large by chance), fitted on labelled rows that the models have not counted, turns them
into a score.

Both models are fitted on at most ``TRAIN_ROWS`` labelled rows, those with the smallest
id hashes; the counts are Spark aggregates, and what the tasks get is the table
of histories and pairs that those rows hold ``MIN_COUNT`` times or more; the evidence of others is nought. Scoring is
one pass over all documents.

Defined results: null and empty texts have no evidence and get the score of
none; labels other than 0 and 1 (null too) are not learned from, nor are ids with both; a row is
scored each time it appears; without both labels every score is 0.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpilane.llm.common import mix, slices, stored, texts_of

TRAIN_ROWS = 16_000
HELD_BACK = 4  # every fourth training row fits the regression instead of the counts
DISCOUNT = 0.75
BEGINNING = 8  # characters; from there on the history slides
MIN_COUNT = 2  # histories and pairs seen once in the training rows are left to the backoff
STRONGEST = (1, 2, 4)
FEATURES = 3 + 2 * len(STRONGEST)
MEMO = 300_000  # words whose evidence a task keeps
BATCH_CHARS = 1 << 18  # characters of the texts that are scored together; a longer text is alone
SLICE = 1 << 16  # rows whose evidence is computed at once on the driver
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
END = "\n"
INNER = "\t"  # before the histories that slide


def _words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(before, word, ordinary, toxic) counts of each Arrow batch; nothing stands before a text's first word."""
    for batch in slices(batches):
        counts: dict[tuple[str, str], list[int]] = {}
        for text, toxic in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
            words = _words(text)
            for pair in zip(["", *words], words):
                counts.setdefault(pair, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([p[i] for p in counts], pa.string()) for i in (0, 1)),
             *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))],
            names=["before", "word", "ordinary", "toxic"])


def count_pairs(labelled: DataFrame, text_col: str, toxic_col: str) -> DataFrame:
    """Per class how often each word follows each other."""
    return (labelled.select(F.col(text_col).cast("string"), F.col(toxic_col).cast("int"))
            .mapInArrow(_pairs, "before string, word string, ordinary long, toxic long")
            .groupBy("before", "word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")))


def count_histories(pairs: DataFrame) -> DataFrame:
    """Counts of every history with and without the character after it: per class, and of different words' places."""
    words = (pairs.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
             .withColumn("s", F.concat("word", F.lit(END))))
    beginnings = F.expr(f"transform(sequence(0, least(length(s), {BEGINNING})), i -> left(s, i))")
    sliding = F.expr(f"""flatten(transform(sequence({BEGINNING + 1}, greatest(length(s), {BEGINNING + 1})), i -> array(
        concat('{INNER}', substring(s, i - {BEGINNING - 1}, {BEGINNING - 1})),
        concat('{INNER}', substring(s, i - {BEGINNING - 1}, {BEGINNING})))))""")
    none = F.array().cast("array<string>")
    parts = (words.select(F.explode(F.concat(beginnings, F.when(F.length("s") > BEGINNING, sliding).otherwise(none)))
                          .alias("part"), "ordinary", "toxic")
             .groupBy("part").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"),
                                  F.count("*").alias("kinds")))
    # a sliding history alone has BEGINNING characters with its mark, and follows nothing
    follows = F.when(F.col("part").startswith(INNER), F.length("part") > BEGINNING).otherwise(F.col("part") != "")
    followers = (parts.filter(follows).groupBy(F.expr("left(part, length(part) - 1)").alias("part"))
                 .agg(F.count_if(F.col("ordinary") > 0).alias("after_ordinary"),
                      F.count_if(F.col("toxic") > 0).alias("after_toxic")))
    return parts.join(followers, "part", "left")


def count_befores(pairs: DataFrame) -> DataFrame:
    """Per word before: counts and different followers in each class."""
    return pairs.groupBy("before").agg(
        F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"),
        F.count_if(F.col("ordinary") > 0).alias("after_ordinary"), F.count_if(F.col("toxic") > 0).alias("after_toxic"))


def _evidence(counts: np.ndarray, totals: np.ndarray, followers: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """log P_1(c | h) - log P_0(c | h) from n_k(hc), n_k(h) and followers_k(h), a row for each class, and P(c | h)."""
    seen = totals > 0
    kept = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * followers * shared) / np.where(seen, totals, 1)
    logs = np.log(np.where(seen, kept, shared))
    return logs[1] - logs[0]


def _columns(table: pa.Table, *columns: str) -> list[np.ndarray]:
    return [pc.fill_null(table[c].combine_chunks(), 0).to_numpy() for c in columns]


def _all_evidence(counts: list[np.ndarray], totals: list[np.ndarray], followers: list[np.ndarray], shared: np.ndarray,
                  at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The evidence of rows ``at`` after the histories in rows ``before``, ``SLICE`` rows at a time."""
    out = np.empty(len(at))
    for start in range(0, len(at), SLICE):
        own = slice(start, start + SLICE)
        n, total, after = (np.stack([c[rows] for c in columns]).astype(np.float64) for columns, rows in (
            (counts, at[own]), (totals, before[own]), (followers, before[own])))
        out[own] = _evidence(n, total, after, shared[own])
    return out


def _history_evidence(histories: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Histories and their evidence: of a beginning that of all of it, of a sliding history that of its last character."""
    parts = histories["part"].combine_chunks()
    inner = pc.starts_with(parts, INNER).to_numpy(zero_copy_only=False)
    length = pc.utf8_length(parts).to_numpy()
    ends = np.flatnonzero(np.where(inner, length > BEGINNING, length > 0))
    before = pc.index_in(pc.utf8_slice_codeunits(parts.take(pa.array(ends)), 0, -1), parts).to_numpy()
    n, followers = _columns(histories, "ordinary", "toxic"), _columns(histories, "after_ordinary", "after_toxic")
    kinds, = _columns(histories, "kinds")
    values = np.zeros(len(parts))
    values[ends] = _all_evidence(n, n, followers, kinds[ends] / kinds[before], ends, before)
    for size in range(1, BEGINNING + 1):
        own = ~inner[ends] & (length[ends] == size)
        values[ends[own]] += values[before[own]]
    whole = ~inner
    whole[ends] = True
    return parts.filter(pa.array(whole)), values[whole]


def _pair_evidence(pairs: pa.Table, befores: pa.Table, all_kinds: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of the pairs, each pair's code by its words' places, and its evidence; ``all_kinds``: of different pairs."""
    words = pa.chunked_array([*pairs["before"].chunks, *pairs["word"].chunks], pa.string()).unique()
    at, after = (pc.index_in(pairs[c], words).to_numpy().astype(np.int64) for c in ("before", "word"))
    known = pc.index_in(pairs["before"], befores["before"].combine_chunks()).to_numpy()
    kinds, = _columns(pairs, "kinds")
    evidence = _all_evidence(_columns(pairs, "ordinary", "toxic"), _columns(befores, "ordinary", "toxic"),
                             _columns(befores, "after_ordinary", "after_toxic"), kinds / all_kinds,
                             np.arange(len(at)), known)
    return words, at * (len(words) + 1) + after, evidence


class _Seen(dict):
    """Word -> its place in columns of evidence and number; a word not met before is added on lookup."""

    def __init__(self, models: Models) -> None:
        self.models, self.evidence, self.numbers = models, array("d"), array("q")

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.evidence.append(self.models.of_word(word))
        self.numbers.append(self.models.number.get(word, len(self.models.number)))
        return place


class Models:
    """Evidence of words and of pairs.

    What is kept and broadcast are columns; the tables to look words up in are made of them where texts are
    scored, so the driver holds no Python object per history or word.
    """

    TABLES = ("evidence", "number", "slots", "seen")

    def __init__(self, histories: tuple[pa.Array, np.ndarray], pairs: tuple[pa.Array, np.ndarray, np.ndarray]) -> None:
        self.parts, self.part_evidence = histories
        self.words, self.codes, self.pairs = pairs

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in self.TABLES}

    @cached_property
    def evidence(self) -> dict[str, float]:
        return {"": 0.0} | dict(zip(self.parts.to_pylist(), self.part_evidence.tolist()))

    @cached_property
    def number(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words.to_pylist())}

    @cached_property
    def seen(self) -> _Seen:
        return _Seen(self)

    @cached_property
    def slots(self) -> np.ndarray:
        """A hash table of the codes: the place of each stands in its slot or in the next free one (-1: free)."""
        size = 1 << (2 * len(self.codes)).bit_length()
        slots = np.full(size, -1, np.int32)
        waiting = np.arange(len(self.codes))
        at = self._slot(self.codes, size)
        while len(waiting):
            free = slots[at] < 0
            slots[at[free]] = waiting[free]  # of several for one slot the last gets it
            left = slots[at] != waiting
            waiting, at = waiting[left], (at[left] + 1) & (size - 1)
        return slots

    @staticmethod
    def _slot(codes: np.ndarray, size: int) -> np.ndarray:
        return (mix(codes) & np.uint64(size - 1)).astype(np.int64)

    def of_word(self, word: str) -> float:
        """The evidence of the longest beginning that is known, and of all known histories that slide after it."""
        full = word + END
        known = self.evidence
        for size in range(min(len(full), BEGINNING), -1, -1):
            if (found := known.get(full[:size])) is not None:
                break
        for end in range(BEGINNING + 1, len(full) + 1):
            found += known.get(INNER + full[end - BEGINNING:end], 0.0)
        return found

    def of_pairs(self, numbers: np.ndarray, starts: np.ndarray | int = 0) -> np.ndarray:
        """The evidence of every word after the one before it, by their numbers; texts begin at ``starts``."""
        before = np.roll(numbers, 1)
        before[starts] = self.number.get("", len(self.number))
        code = before * (len(self.number) + 1) + numbers
        out = np.zeros(len(code))
        if not len(self.codes):
            return out
        rest = np.arange(len(code))
        at = self._slot(code, len(self.slots))
        while len(rest):
            place = self.slots[at]
            taken = place >= 0
            hit = taken & (self.codes[place] == code[rest])
            out[rest[hit]] = self.pairs[place[hit]]
            on = taken & ~hit
            rest, at = rest[on], (at[on] + 1) & (len(self.slots) - 1)
        return out

    def features(self, text: str) -> list[float]:
        return self.features_of([text])[0]

    def features_of(self, texts: list[str]) -> list[list[float]]:
        """Per text its features; words and pairs of texts of ``BATCH_CHARS`` characters are looked up together."""
        out, batch, chars = [], [], 0
        for text in texts:
            if batch and chars + len(text) > BATCH_CHARS:
                out += self._features(batch)
                batch, chars = [], 0
            batch.append(text)
            chars += len(text)
        return out + self._features(batch) if batch else out

    def _features(self, texts: list[str]) -> list[list[float]]:
        if len(self.seen) >= MEMO:
            del self.seen
        words, bounds = [], [0]
        for text in texts:
            words += _words(text)
            bounds.append(len(words))
        if not words:
            return [[0.0] * FEATURES for _ in texts]
        seen = self.seen
        places = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        starts = [at for at, end in zip(bounds, bounds[1:]) if at < end]
        values = np.frombuffer(seen.evidence)[places]
        of_pairs = self.of_pairs(np.frombuffer(seen.numbers, np.int64)[places], np.array(starts))
        out = []
        for at, end in zip(bounds, bounds[1:]):
            if at == end:
                out.append([0.0] * FEATURES)
                continue
            row = []
            for of in (values[at:end], of_pairs[at:end]):
                most = min(max(STRONGEST), len(of))
                strongest = np.sort(np.partition(of, -most)[-most:])[::-1].tolist()
                row += [float(of.mean()), *(sum(strongest[:n]) / n for n in STRONGEST)]
            out.append([*row, math.log(end - at)])
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def models_of(pairs: DataFrame) -> Models | None:
    """The models of counted pairs; None without any word."""
    often = F.col("ordinary") + F.col("toxic") >= MIN_COUNT
    # one after the other: the driver holds the counts of one kind at a time, those of different ones in 4 bytes
    narrow = ("kinds", "after_ordinary", "after_toxic")

    def fetched(counts: DataFrame) -> pa.Table:
        return counts.withColumns({c: F.col(c).cast("int") for c in narrow if c in counts.columns}).toArrow()

    histories = _history_evidence(fetched(count_histories(pairs).filter(often)))
    if not len(histories[0]):
        return None
    kinds = pairs.groupBy("word").agg(F.count("*").alias("kinds"))
    known = pairs.filter(often).join(kinds, "word")
    befores = count_befores(pairs).join(pairs.filter(often).select("before").distinct(), "before", "left_semi")
    return Models(histories, _pair_evidence(fetched(known), fetched(befores), pairs.count()))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> tuple[Models, np.ndarray] | None:
    """The two models and the regression; None where a class is missing.

    ``docs`` and ``labels`` hold the rows that may be learned from. The chosen
    labels, at most ``train_rows`` pairs of numbers, are broadcast.
    """
    chosen = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic_label"))
              .filter("toxic_label in (0, 1) and id is not null").groupBy("id")
              .agg(F.min("toxic_label").alias("toxic_label"), F.max("toxic_label").alias("other"))
              .filter("toxic_label = other").drop("other")
              .withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(train_rows)
              .withColumn("held_back", F.pmod("place", F.lit(HELD_BACK)) == 0))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    pairs = stored(count_pairs(rows.filter("not held_back"), "text", "toxic_label"), "pairs")
    models = models_of(pairs)
    if models is None:
        return None
    features = [f"f{i}" for i in range(FEATURES)]
    shared = rows.sparkSession.sparkContext.broadcast(models)
    fitted_on = _apply(rows.filter("held_back").select("text", "toxic_label"), shared, features).toArrow()
    shared.destroy()  # the scoring pass has its own, with the regression
    y = fitted_on["toxic_label"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    return models, _logistic(np.column_stack([fitted_on[f].to_numpy() for f in features]), y)


def _apply(rows: DataFrame, shared: Broadcast, features: list[str]) -> DataFrame:
    """The features of (text, label) rows by broadcast models; the text is not returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.features_of
        for batch in slices(batches):
            values = list(zip(*of(texts_of(batch.column(0))))) or [[]] * len(features)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(v, pa.float64()) for v in values)],
                                             names=["toxic_label", *features])

    return rows.mapInArrow(run, "toxic_label int, " + ", ".join(f"{f} double" for f in features))


def score(docs: DataFrame, fitted: tuple[Models, np.ndarray] | None, text_col: str = "text",
          into: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``into``: the probability that the text is toxic."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    if fitted is None:
        return docs.withColumn(into, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, weights = shared.value
        for batch in slices(batches):
            x = np.array(models.features_of(texts_of(batch.column(place)))).reshape(batch.num_rows, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())],
                                             names=[*batch.schema.names, into])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, DoubleType())]))
