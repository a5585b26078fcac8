"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

The probability of a token after its history is P(class | history) * P(token | class).
The first factor is a softmax over ``CLASSES`` classes whose weights belong to hashed
features of the history: the word before, the two words before as a pair, and, skipping,
the second and the third word before. In the second factor a token's only feature is itself,
for which the maximum-entropy solution is its relative frequency in the class.

Classes: the end of a text, the ``HEAD`` most frequent words at most of those seen twice or
more (by descending count, cut into classes of equal mass), and all other words. The words
that the training texts lack have together the mass of the words seen once (Good and
Turing: words seen once over all tokens). They belong to the last class, as the words seen once always
do, so their mass does not depend on ``HEAD``: the last class counts them as so many
tokens more, in its frequency and in the gradients.

Training: every training text is counted. The class weights start at the class
frequencies and take ``UPDATES`` gradient updates; each sums the gradient over its own
1 / ``UPDATES`` of the training rows (by hash of id and text) in the tasks, so the updates
together take every training row once, and copies of one text under different ids are
spread over the updates. An update divides the gradient by the feature's
expected class counts, the diagonal of the curvature.

Scoring: head words, classes and weights are broadcast (their sizes are parameters); a text is
scored with sparse numpy batches in one pass. The rest of the vocabulary grows with the
corpus, so its counts meet the texts in a join of their own.

Counts are by 64-bit word hash.

Defined results: null and empty texts are the end token alone; without a training text
all counts are 0; repeated rows are scored each on their own; null ids are held out (fold 0).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpilane.llm.common import fold, mix, require_checkpoint_dir, slices, utf8_buffer, word_hashes

HEAD = 1 << 18
CLASSES = 32
FEATURES = 1 << 13  # hashed features of each of the four kinds
KINDS = 4
UPDATES = 4  # and as many parts of the training rows
TOP_WORDS = 8  # most frequent words that are a class of their own
PRIOR = 4.0  # expected count added to a feature's class counts
SMOOTHING = 0.1  # of the base score
MERGE_AT = 1 << 21
TASK_TOKENS = 1 << 24  # training tokens, over all updates, to a gradient task; each hands on a row per feature, whatever it read
BATCH = 128  # texts; their class scores stay in the processor's cache
_SALTS = [np.uint64(s) for s in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1)]


def _tally(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(hashes), 1), bool), hashes[1:] != hashes[:-1]]))
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def _run_lengths(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.sort(hashes)
    first = np.flatnonzero(np.concatenate([np.ones(min(len(hashes), 1), bool), hashes[1:] != hashes[:-1]]))
    return hashes[first], np.diff(np.append(first, len(hashes)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task, merged up to ``MERGE_AT`` words at a time."""
    kept, size = [], 0

    def merged() -> pa.RecordBatch:
        hashes, counts = _tally(np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept]))
        return pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(counts, pa.int64())],
                                          names=["word", "n"])

    for batch in slices(batches):
        words, _ = word_hashes(*utf8_buffer(batch.column(0)))
        kept.append(_run_lengths(words))
        size += len(kept[-1][0])
        if size > MERGE_AT:
            out = merged()
            if out.num_rows > MERGE_AT // 2:
                yield out
                kept, size = [], 0
            else:
                kept = [(out.column(0).to_numpy().astype(np.uint64), out.column(1).to_numpy())]
                size = out.num_rows
    if kept:
        yield merged()


class Tokens:
    """The tokens of a batch: words by hash, each text closed by an end token; and the features of their histories."""

    END = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, column: pa.Array) -> None:
        words, bounds = word_hashes(*utf8_buffer(column))
        rows = len(bounds) - 1
        self.bounds = bounds + np.arange(rows + 1)
        self.row_of = np.repeat(np.arange(rows), np.diff(self.bounds))
        self.is_end = np.zeros(self.bounds[-1], bool)
        self.is_end[self.bounds[1:] - 1] = True
        self.hashes = np.full(len(self.is_end), self.END)
        self.hashes[~self.is_end] = words

    def features(self) -> list[np.ndarray]:
        """For each kind, the hashed feature of every token's history."""
        place = np.arange(len(self.hashes)) - self.bounds[self.row_of]
        before = []
        for back in (1, 2, 3):
            h = np.zeros(len(self.hashes), np.uint64)  # 0 before the text
            h[back:] = self.hashes[:-back] if back <= len(self.hashes) else h[back:]
            h[place < back] = 0
            before.append(h)
        with np.errstate(over="ignore"):
            raw = [before[0] ^ _SALTS[0], before[0] * _SALTS[1] + before[1], before[1] ^ _SALTS[2], before[2] ^ _SALTS[3]]
        return [(mix(r) >> np.uint64(65 - FEATURES.bit_length())).astype(np.int64) + kind * FEATURES for kind, r in enumerate(raw)]


class Model:
    def __init__(self, hashes: np.ndarray, counts: np.ndarray, totals: dict[str, int]) -> None:
        """``hashes`` and ``counts`` of the head words; ``totals``: texts, words, kinds, once, tail words."""
        self.__dict__.update(totals)
        order = np.lexsort((hashes, -counts))
        hashes, counts = hashes[order], counts[order].astype(np.float64)
        # classes 0: end, 1 to CLASSES - 2: head words, CLASSES - 1: all others
        middle = CLASSES - 2
        classes = np.minimum(np.arange(len(counts)), TOP_WORDS)
        if len(counts) > TOP_WORDS:
            mass = np.cumsum(counts[TOP_WORDS:])
            classes[TOP_WORDS:] += ((mass - counts[TOP_WORDS:]) / mass[-1] * (middle - TOP_WORDS)).astype(int)
        classes += 1
        per_class = np.bincount(classes, counts, minlength=CLASSES)
        within = np.log10(counts / np.maximum(per_class[classes], 1)) if len(counts) else counts
        by_hash = np.argsort(hashes)
        self.hashes, self.counts = hashes[by_hash], counts[by_hash]
        self.classes, self.within = classes[by_hash].astype(np.int8), within[by_hash]
        self.novel = max(self.once, 0.5)  # tokens that stand for the unseen words
        per_class[0], per_class[-1] = self.texts, self.tail + self.novel
        self.last_weight = 1 + self.novel / self.tail if self.tail else 1.0  # of a token of the last class, with its share of them
        self.share = ((per_class + 0.5) / (per_class + 0.5).sum())
        self.weights = np.zeros((KINDS * FEATURES, CLASSES), np.float32)
        self.tokens = self.words + self.texts
        self.unseen = self.novel / (self.tail + self.novel)
        self.base_total = self.tokens + SMOOTHING * (self.kinds + (self.texts > 0) + 1)

    def find(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(place among the head words or -1, class) of every token."""
        place = np.minimum(np.searchsorted(self.hashes, tokens.hashes), max(len(self.hashes) - 1, 0))
        known = (self.hashes[place] == tokens.hashes) & ~tokens.is_end if len(self.hashes) else np.zeros(len(place), bool)
        place = np.where(known, place, -1)
        classes = np.where(tokens.is_end, 0, CLASSES - 1).astype(np.int64)
        classes[known] = self.classes[place[known]]
        return place, classes

    def logits(self, features: list[np.ndarray]) -> np.ndarray:
        """Of every class after every history, up to a term that all classes share; 0 at most."""
        logits = self.weights[features[0]]
        for f in features[1:]:
            logits += self.weights[f]
        logits += np.log(self.share).astype(np.float32)
        logits -= logits.max(axis=1, keepdims=True)
        return logits

    def log_softmax(self, features: list[np.ndarray]) -> np.ndarray:
        logits = self.logits(features)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))

    def log_likelihood(self, features: list[np.ndarray], classes: np.ndarray) -> np.ndarray:
        """log P of each token's class after its history."""
        logits = self.logits(features)
        own = logits[np.arange(len(classes)), classes]
        return own - np.log(np.exp(logits, out=logits).sum(axis=1))

    def gradient(self, tokens: Tokens, total: np.ndarray, seen: np.ndarray) -> None:
        """Add a batch's gradient of the log-likelihood to ``total`` (class by class) and its feature counts to ``seen``."""
        features = tokens.features()
        _, classes = self.find(tokens)
        error = self.logits(features)
        np.exp(error, out=error)
        error /= -error.sum(axis=1, keepdims=True)
        error[np.arange(len(classes)), classes] += 1
        last = classes == CLASSES - 1
        weight = np.where(last, self.last_weight, 1.0)
        error[last] *= np.float32(self.last_weight)
        by_class = np.ascontiguousarray(error.T)
        for kind, f in enumerate(features):
            own = slice(kind * FEATURES, (kind + 1) * FEATURES)
            local = f - kind * FEATURES
            for k in range(CLASSES):
                total[k, own] += np.bincount(local, by_class[k], FEATURES)
            seen[own] += np.bincount(local, weight, FEATURES)

    def update(self, gradient: np.ndarray, seen: np.ndarray) -> None:
        expected = seen[:, None] * self.share[None] + PRIOR
        self.weights += np.clip(gradient / expected / KINDS, -1, 1).astype(np.float32)


def part_of(id_col: str, text_col: str) -> Column:
    """The update, from 0, that takes a row."""
    return F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")), F.lit(UPDATES))


def gradient_tasks(tokens: int, cores: int) -> int:
    """The most tasks that an update's gradient is summed in: many small input splits share one, so that what they
    shuffle follows the tokens and not the number of splits; every core has one."""
    return max(cores, -(-tokens // TASK_TOKENS), 1)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of all texts of ``docs``, and the counts (word, n) of their whole vocabulary."""
    spark = docs.sparkSession
    require_checkpoint_dir(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"), part_of(id_col, text_col).alias("part"))
    counts = (texts.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))).checkpoint()
    steps = sorted({max(int(1.2 ** k), 2) for k in range(120)})  # words seen once are never head words
    found = counts.agg(F.sum("n").alias("words"), F.count("*").alias("kinds"),
                       *[F.count_if(F.col("n") >= s).alias(f"from_{s}") for s in steps]).first()
    least = next(s for s in steps if found[f"from_{s}"] <= HEAD)
    head = counts.filter(F.col("n") >= least).toArrow()  # at most HEAD rows
    rest = counts.filter(F.col("n") < least).agg(F.sum("n"), F.count_if(F.col("n") == 1)).first()  # holds all words seen once
    model = Model(head["word"].to_numpy().astype(np.uint64), head["n"].to_numpy(), {
        "texts": texts.count(), "words": found["words"] or 0, "kinds": found["kinds"], "tail": rest[0] or 0,
        "once": rest[1] or 0, "least": least})
    columns = [f"g{k}" for k in range(CLASSES)]
    tasks = gradient_tasks(model.tokens, spark.sparkContext.defaultParallelism)
    for step in range(UPDATES):
        shared = spark.sparkContext.broadcast(model)

        def gradients(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros((CLASSES, KINDS * FEATURES))
            seen = np.zeros(KINDS * FEATURES)
            for batch in slices(batches, BATCH):
                shared.value.gradient(Tokens(batch.column(0)), total, seen)
            rows = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(seen[rows]), *(pa.array(total[k, rows]) for k in range(CLASSES))],
                names=["feature", "seen", *columns])

        summed = (texts.filter(F.col("part") == step).select("text").coalesce(tasks).mapInArrow(
            gradients, "feature long, seen double, " + ", ".join(f"{c} double" for c in columns))
            .groupBy("feature").agg(F.sum("seen").alias("seen"), *[F.sum(c).alias(c) for c in columns]).toArrow())
        gradient, seen = np.zeros((KINDS * FEATURES, CLASSES)), np.zeros(KINDS * FEATURES)
        rows = summed["feature"].to_numpy()
        gradient[rows] = np.column_stack([summed[c].to_numpy() for c in columns])
        seen[rows] = summed["seen"].to_numpy()
        model.update(gradient, seen)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, numbers of tokens and known tokens, the base score and the model's log10 probability."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        context = TaskContext.get()
        key = (context.partitionId() if context else 0) << 40
        for batch in slices(batches, BATCH):
            tokens = Tokens(batch.column(1))
            place, classes = known.find(tokens)
            rows = batch.num_rows
            logs = known.log_likelihood(tokens.features(), classes) / np.log(10)
            head = place >= 0
            logs[head] += known.within[place[head]]
            n = np.where(tokens.is_end, known.texts, 0).astype(np.float64)
            n[head] = known.counts[place[head]]
            settled = head | tokens.is_end
            base = np.where(settled, np.log10((n + SMOOTHING) / known.base_total), 0)
            tail = np.flatnonzero(~settled)
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(tail, tokens.bounds).astype(np.int32)),
                pa.array(tokens.hashes[tail].astype(np.int64)))

            def per_row(values: np.ndarray) -> np.ndarray:
                return np.bincount(tokens.row_of, values, minlength=rows)

            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(key, key + rows)), batch.column(0), pa.array(np.diff(tokens.bounds)),
                 pa.array(per_row(settled & (n > 0)).astype(np.int64)), pa.array(per_row(base)), pa.array(per_row(logs)), lists],
                names=["key", "doc_id", "n_tokens", "known", "base", "model", "tail"])
            key += rows

    scored = (docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
              .mapInArrow(run, "key long, doc_id long, n_tokens long, known long, base double, model double, "
                               "tail array<long>").checkpoint())
    n = F.coalesce("n", F.lit(0))
    spread = -float(np.log10(model.tail + model.novel))
    tails = (scored.select("key", F.explode("tail").alias("word")).groupBy("key", "word").agg(F.count("*").alias("times"))
             .join(counts.filter(F.col("n") < model.least), "word", "left")
             .groupBy("key").agg(
                 F.sum(F.when(n > 0, F.col("times"))).alias("tail_known"),
                 F.sum(F.col("times") * F.log10((n + SMOOTHING) / model.base_total)).alias("tail_base"),
                 F.sum(F.col("times") * F.when(n > 0, F.log10(n) + spread).otherwise(float(np.log10(model.unseen))))
                 .alias("tail_model")))
    zero = F.lit(0.0)
    return scored.drop("tail").join(tails, "key", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("tail_model", zero)).alias("score"))


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Scores of all rows by the model of the rows outside fold 0."""
    model, counts = train(docs.filter(fold(id_col, folds) != 0), id_col, text_col)
    scored = score(docs, model, counts, id_col, text_col)
    return scored.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")
