"""Phrase collocations of a corpus by prefix-free parsing.

*Parsing.* A text's pieces (between marks of punctuation) are word sequences. A window of ``WINDOW`` words
whose hash is 0 modulo ``PERIOD`` triggers a cut, wherever it stands; a chunk runs from one trigger
window to the end of the next, or of the piece, so neighbours overlap by the window, and
equal passages are cut alike in every document. The different chunks with their frequencies are the
dictionary: copies and shared passages are in it once.

*Counting.* n-grams are counted in the different chunks, weighted with the chunk's frequency. A chunk counts the
n-grams that start before its closing window; those that start in it are the next chunk's. As a window has
``LONGEST - 1`` words, every n-gram lies whole in the chunk that counts it, and is counted once.

*Levels.* A phrase of n words is counted only where both its phrases of n - 1 words occur often enough (a table of
2**``FILTER_BITS`` bits per level says so by hash; a set bit may be of another phrase, a frequent phrase's
bit is always set, so a full table costs time and changes nothing). Phrases are counted under two independent
64-bit hashes of their bytes, which tasks sum before the shuffle, with the number of a
block that holds the phrase; that block gives the text of each frequent phrase, once.

Scores are quotients of 38-digit decimals.

Defined results: a null text is empty, a null language ``und``; repeated rows count each;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpilane.llm.common import mix, run_hashes, slices, stored, texts_of

LONGEST = 5
WINDOW = LONGEST - 1
PERIOD = 16
MIN_COUNT = 100
TOP = 2000
UNKNOWN = "und"
FILTER_BITS = 25
CHUNKS = 1 << 18  # different chunks that a task gathers before it hands them on
FLUSH = 1 << 21  # the same of n-grams
OUTPUT = 1 << 16  # rows of an Arrow batch that a task hands on
PARSED = 256  # texts that are parsed at once

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_CLASS = np.zeros(256, np.uint8)  # 0: in a word, 1: blank, 2: ends a piece
_CLASS[list(b" \t")] = 1
_CLASS[list(_BREAKS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _word_runs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    inside = np.concatenate(([False], _CLASS[raw] == 0, [False]))
    return np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1


def parse(text: bytes, period: int = PERIOD) -> list[bytes]:
    """The chunks of lower-cased text, words joined by blanks; one that a trigger window closes ends with a blank."""
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    starts, ends = _word_runs(raw)
    n = len(starts)
    if not n:
        return []
    breaks = np.cumsum(_CLASS[raw] == 2)[starts]
    head = np.concatenate(([True], breaks[1:] != breaks[:-1]))
    heads = np.flatnonzero(head)
    piece_end = np.append(heads[1:], n)[np.cumsum(head) - 1]
    # a compact text: every word and one blank
    offsets = np.concatenate(([0], np.cumsum(ends - starts + 1)))
    keep = np.append(_CLASS[raw] == 0, False)
    keep[ends] = True
    compact = np.append(raw, np.uint8(32))[keep]
    compact[offsets[1:] - 1] = 32
    hashes = run_hashes(raw, starts, ends)
    with np.errstate(over="ignore"):
        window = hashes[:max(n - WINDOW + 1, 0)].copy()
        for k in range(1, WINDOW):
            window = window * _STEP + hashes[k:k + len(window)]
    trigger = np.zeros(n, bool)
    trigger[:len(window)] = mix(window) % np.uint64(period) == 0
    first = np.flatnonzero(head | (trigger & (np.arange(n) + WINDOW <= piece_end)))
    after = np.append(first[1:], n)
    closed = after < piece_end[first]
    last = np.where(closed, after + WINDOW, after)
    joined = compact.tobytes()
    return [joined[a:b] for a, b in zip(offsets[first].tolist(), (offsets[last] - ~closed).tolist())]


def _rows(found: dict[str, Counter]) -> pa.RecordBatch:
    langs = [lang for lang, own in found.items() for _ in own]
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array([c for own in found.values() for c in own], pa.binary()),
         pa.array([n for own in found.values() for n in own.values()], pa.int64())], names=["lang", "chunk", "times"])


def dictionary(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", period: int = PERIOD) -> DataFrame:
    """lang, chunk, times: the different chunks and how often the parse meets them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for batch in slices(batches, PARSED):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                found.setdefault(lang, Counter()).update(parse("\n".join(texts).encode(), period))
            if sum(map(len, found.values())) > CHUNKS:
                yield _rows(found)
                found = {}
        yield _rows(found)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    return (docs.select(lang, F.col(text_col).cast("string")).mapInArrow(run, "lang string, chunk binary, times long")
            .groupBy("lang", "chunk").agg(F.sum("times").alias("times")))


def pack_chunks(chunks: DataFrame) -> DataFrame:
    """The dictionary in numbered blocks of one language: chunks line by line, their frequencies, the words they count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            times, texts = batch.column(2).to_numpy(), np.array(batch.column(1).to_pylist(), object)
            rows = []
            for own in dict.fromkeys(lang.tolist()):
                here = np.flatnonzero(lang == own)
                block = Block(number, own, b"\n".join(texts[here]), times[here].astype("<i8").tobytes())
                rows.append((number, own, block.text, block.times, int(block.weight[block.owned].sum())))
                number += 1
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)],
                                             names=["block", "lang", "text", "times", "words"])

    return chunks.mapInArrow(run, "block long, lang string, text binary, times binary, words long")


class Block:
    """Some chunks of one language, word by word."""

    def __init__(self, number: int, lang: str, text: bytes, times: bytes) -> None:
        self.number, self.lang, self.text, self.times = number, lang, text, times
        raw = np.frombuffer(text, np.uint8)
        self.starts, self.ends = _word_runs(raw)
        lines = np.concatenate(([0], np.cumsum(raw == 10)))
        chunk = lines[self.starts]
        n = len(chunk)
        self.hashes = run_hashes(raw, self.starts, self.ends)
        self.others = run_hashes(raw, self.starts, self.ends, other=True)
        last = np.flatnonzero(np.append(chunk[1:] != chunk[:-1], True)) if n else np.zeros(0, int)
        self.chunk_end = np.repeat(last + 1, np.diff(np.concatenate(([-1], last)))) if n else last
        after = np.append(raw, np.uint8(10))[self.ends[last]] if n else raw[:0]  # a blank follows the last word of a closed chunk
        closing = np.repeat(np.where(after == 32, WINDOW, 0), np.diff(np.concatenate(([-1], last)))) if n else last
        self.owned = np.arange(n) < self.chunk_end - closing
        self.weight = np.frombuffer(times, "<i8")[chunk]
        self.salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))

    def sweep(self, upto: int, tables: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per size up to ``upto`` where phrases start that the tables allow, with their hash."""
        total = self.hashes.copy()
        at = np.arange(len(total))
        passed = np.ones(len(total) + 1, bool)
        passed[-1] = False
        for size in range(1, upto + 1):
            with np.errstate(over="ignore"):
                if size > 1:
                    at = at[passed[at + 1] & (self.chunk_end[at] - at >= size)]
                    total[at] = total[at] * _STEP + self.hashes[at + size - 1]
                key = mix(total[at] + self.salt)
            if size <= len(tables):
                cell = key & np.uint64((1 << FILTER_BITS) - 1)
                hit = (tables[size - 1][(cell >> np.uint64(5)).astype(np.int64)]
                       >> (cell & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
                at, key = at[hit], key[hit]
                passed[:] = False
                passed[at] = True
            mine = self.owned[at]
            yield size, at[mine], key[mine].astype(np.int64)

    def second_hash(self, at: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            total = self.others[at]
            for k in range(1, size):
                total = total * _STEP + self.others[at + k]
            return mix(total + self.salt).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for place in range(batch.num_rows):  # one block's bytes at a time
            yield Block(*(c[place].as_py() for c in batch.columns[:4]))


def _summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns (hash, second hash, count, block): equal hashes summed, with the least block. Empties ``parts``.

    Made column by column, so that beside the parts there is one column more at a time and not the rows twice.
    """
    columns = [[p[i] for p in parts] for i in range(4)]
    parts.clear()
    key = np.concatenate(columns[0])
    columns[0] = []
    order = np.argsort(key)
    key = key[order]

    def ordered(i: int) -> np.ndarray:
        column = np.concatenate(columns[i])
        columns[i] = []
        return column[order]

    other = ordered(1)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (other[1:] != other[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return [key, other, ordered(2), ordered(3)]
    key, other = key[first], other[first]
    return [key, other, np.add.reduceat(ordered(2), first), np.minimum.reduceat(ordered(3), first)]


def _batches(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The columns as short Arrow batches."""
    for start in range(0, max(len(rows[0]), 1), OUTPUT):
        yield pa.RecordBatch.from_arrays([pa.array(c[start:start + OUTPUT]) for c in rows], names=["key", "other", "n", "block"])


def level_counts(packed: DataFrame, level: int, tables: Broadcast) -> DataFrame:
    """key, other, n, block of the phrases of ``level`` words that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = [np.zeros(0, np.int64)] * 4
        parts, size = [nothing], 0
        for block in _blocks(batches):
            for _, at, key in block.sweep(level, tables.value):
                pass  # the last size is the level's
            parts.append([key, block.second_hash(at, level), block.weight[at], np.full(len(at), block.number)])
            size += len(at)
            if size > FLUSH:
                rows = _summed(parts)
                parts, size = [rows], len(rows[0])
                if size > FLUSH // 2:
                    parts, size = [nothing], 0
                    yield from _batches(rows)
                del rows
        yield from _batches(_summed(parts))

    return (packed.select("block", "lang", "text", "times").mapInArrow(run, "key long, other long, n long, block long")
            .groupBy("key", "other").agg(F.sum("n").alias("n"), F.min("block").alias("block")))


def bit_table(keys: DataFrame) -> np.ndarray:
    """2**FILTER_BITS bits, set where a key falls."""
    cell = F.col("key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = (keys.select(F.shiftright(cell, 5).cast("int").alias("word"), cell.bitwiseAND(F.lit(31)).cast("int").alias("at"))
             .selectExpr("word", "shiftleft(1L, at) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))
             .toArrow())  # at most 2**(FILTER_BITS - 5) rows
    table = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return table


def phrase_counts(packed: DataFrame, frequent: DataFrame, tables: Broadcast) -> DataFrame:
    """lang, phrase, size, f of the frequent hashes (size, key, other, n, block), by the text in their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, wanted in zip(_blocks([batch]), batch.column(4)):
                sizes, keys, others, counts = (np.asarray(wanted.values.field(c)) for c in ("size", "key", "other", "n"))
                phrases, lengths, numbers = [], [], []
                for size, at, key in block.sweep(LONGEST, tables.value):
                    mine = np.flatnonzero(sizes == size)
                    pairs = dict(zip(zip(keys[mine].tolist(), others[mine].tolist()), counts[mine].tolist()))
                    hit = np.isin(key, keys[mine])
                    at, key = at[hit], key[hit]
                    other = block.second_hash(at, size)
                    starts, ends = block.starts[at].tolist(), block.ends[at + size - 1].tolist()
                    for k, o, x, y in zip(key.tolist(), other.tolist(), starts, ends):
                        n = pairs.pop((k, o), None)
                        if n is not None:
                            phrases.append(block.text[x:y].decode())
                            lengths.append(size)
                            numbers.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()),
                     pa.array(lengths, pa.int32()), pa.array(numbers, pa.int64())], names=["lang", "phrase", "size", "f"])

    named = frequent.groupBy("block").agg(F.collect_list(F.struct("size", "key", "other", "n")).alias("wanted"))
    return (packed.select("block", "lang", "text", "times").join(named, "block")
            .select("block", "lang", "text", "times", "wanted")
            .mapInArrow(run, "lang string, phrase string, size int, f long"))


def score_cuts(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the lowest-scoring cut of every phrase of two words or more."""
    words = F.split("phrase", " ")
    cut = (counts.filter("size > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
           .select("lang", "phrase", F.col("f").alias("a"), "k",
                   F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"),
                   F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right")))
    parts = counts.select("lang", "phrase", "f")
    scored = (cut.join(parts.toDF("lang", "left", "l"), ["lang", "left"])
              .join(parts.toDF("lang", "right", "r"), ["lang", "right"])
              .join(totals, "lang")
              .withColumn("score", F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)))"
                                          " div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def without_parts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """The candidates that no longer phrase holds in all their places.

    A longer phrase occurs no more often than a part of it, and what lies between them in length lies between
    them in count, so the phrases of one word more decide.
    """
    words = F.split("phrase", " ")
    parts = F.array(F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "),
                    F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " "))
    held = (counts.filter("size > 2").select("lang", F.explode(parts).alias("phrase"), "f")
            .groupBy("lang", "phrase").agg(F.max("f").alias("held")))
    return candidates.join(held, ["lang", "phrase"], "left").filter("held IS NULL OR held < a").drop("held")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT,
                 top: int = TOP, period: int = PERIOD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of every language."""
    context = docs.sparkSession.sparkContext
    packed = stored(pack_chunks(dictionary(docs, lang_col, text_col, period)), "chunks")
    tables: list[np.ndarray] = []
    frequent = []
    for level in range(1, LONGEST + 1):
        counted = level_counts(packed, level, context.broadcast(tables)).filter(F.col("n") >= min_count)
        frequent.append(stored(counted.select(F.lit(level).alias("size"), "key", "other", "n", "block"), f"level{level}"))
        tables = [*tables, bit_table(frequent[-1])]
    counts = stored(phrase_counts(packed, reduce(DataFrame.unionAll, frequent), context.broadcast(tables)), "phrases")
    totals = packed.groupBy("lang").agg(F.sum("words").alias("n"))
    kept = without_parts(score_cuts(counts, totals), counts)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def oracle_sql(min_count: int = MIN_COUNT, top: int = TOP) -> str:
    """The same for DuckDB, from every n-gram of every piece."""
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
          FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE i + size - 1 <= len(w)),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY lang, size, phrase HAVING count(*) >= {min_count}),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
cuts AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k FROM counts),
scored AS (
  SELECT c.lang, c.size, c.phrase, c.a, c.k, l.f AS l, r.f AS r, t.n,
    CAST((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts c JOIN totals t ON t.lang = c.lang
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM counts o WHERE o.lang = b.lang AND o.size > b.size AND 100 * o.f >= 100 * b.a
      AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}"""
