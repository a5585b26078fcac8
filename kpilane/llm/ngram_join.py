"""Near duplicates: an exact Jaccard join of word n-gram sets by partitions of the universe.

A document's set holds its distinct shingles of ``SHINGLE`` words as 54-bit hashes;
equal sets are one node from the start. Two sets of sizes a and b with a Jaccard
similarity of at least ``SIMILARITY`` percent differ in at most
H = (100 - SIMILARITY) * (a + b) / (100 + SIMILARITY) shingles.

*Size bands.* Sizes are cut into bands; a set belongs to its own band, and to the next
one if a partner of it can lie there, so partners always share a band.

*Universe partition.* In a band the space of hashes is cut into H + 1 + SLACK segments.
Partners differ in at most H of them, so at least 1 + SLACK segments are equal. The
index holds a hash of every non-empty segment's subset.

*Cost-based allocation.* Sets under the same subset hash are candidates. Few of them
are paired at once. Of many, each is first tried against one pivot, which
finds large groups of copies in linear time; then only pairs from different components are left. A
subset for which even those are many is too costly (a passage that many documents
share) and is left out, as empty segments are. A set may lose up to SLACK segments
this way: its partners still share another one with it. Sets that lost more are gathered
along the costly subsets they share, dealt to blocks by size, and block meets
block: one matrix product counts the common shingles of all their pairs, of which only a
spanning forest of the links leaves the task.

*One-deletion neighbourhoods.* Two sets whose equal segments are all empty have more
than SLACK empty ones each, and no more others than the shingles in which they differ. Of such sets every segment is indexed in full and with each
one shingle left out, and a subset meets the neighbourhoods it equals: if fewer than
H / 2 segments are empty, one of the others differs in at most one shingle. Sets
with more empty ones are paired by every segment in full.

Partners share more than SLACK segments, so a pair that shares fewer (empty segments and those in subsets
that make no pairs taken into account) is no candidate. Every candidate pair is verified on the whole
sets, and verified links give the
components. Candidates travel as pairs of set ids and
as the sets that some pair needs; these are picked by a bit table of fixed size.

A set's id is 64 bits: 46 of a hash of its shingles, 18 of its size.

Defined results: null and empty texts, and texts without a word, have no shingle and
are linked with nothing; a text with fewer words than a shingle is one shingle;
repeated rows are kept, each with the component of its set; a null id is never the
smallest of a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpilane.llm.common import (distinct, mix, require_checkpoint_dir, shuffle_partitions, slices, stored, utf8_buffer,
                                word_hashes)
from kpilane.llm.components import components

SHINGLE = 4
SIMILARITY = 85
BAND_GROWTH = 1.4
PAIRED = 4  # sets under one subset hash that are all paired at once
PIVOT_SHARED = 3  # subset hashes that a set must share with a pivot to be tried against it
CROSS_PAIRS = 4  # pairs from different components, per set under the hash, beyond which a subset is costly
BLOCK_SETS = 1024
BLOCK_SHINGLES = 1_000_000
DENSE = 8  # sets of a block pair that share a shingle from which it is a column of the matrix product
SIZE_BITS = 18
FILTER_BITS = 26
UNBANDED = 1 << 30  # slack of a set that no band holds
TOKEN_BITS = 54
_SIZE_MASK = (1 << SIZE_BITS) - 1
_FACTORS = np.random.default_rng(97).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class Bands:
    """Size bands for one similarity: first sizes, number of segments, slack, largest difference."""

    def __init__(self, similarity: int = SIMILARITY) -> None:
        self.similarity = similarity
        # the smallest set that can have a partner other than its equal
        least = next(s for s in range(1, 200) if 100 * s >= similarity * (s + 1))
        first = [least]
        while first[-1] < 1 << 40:
            first.append(max(first[-1] + 1, int(first[-1] * BAND_GROWTH)))
        self.first = np.array(first)
        largest = self.first[1:] - 1
        self.difference = (100 - similarity) * 2 * largest // (100 + similarity)
        self.slack = 3 + self.difference // 12
        self.segments = self.difference + 1 + self.slack

    def memberships(self, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places of sets, their band), for own bands and for the next ones."""
        own = np.searchsorted(self.first, sizes, side="right") - 1
        here = np.flatnonzero(own >= 0)
        after = np.searchsorted(self.first, np.ceil(sizes * 100 / self.similarity), side="right") - 1
        above = np.flatnonzero((after > own) & (after >= 0))
        # a partner is at most 100 / SIMILARITY times as large, less than a band: the next band holds it
        return [(here, own[here]), *((above[after[above] >= own[above] + step], own[above][after[above] >= own[above] + step] + step)
                                     for step in range(1, int((after - own).max(initial=0)) + 1))]


def token_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after the other, n + 1 offsets)."""
    raw, offsets = utf8_buffer(column)
    words, bounds = word_hashes(raw, offsets)
    rows = len(bounds) - 1
    if rows > 1 << (64 - TOKEN_BITS):
        raise ValueError("too many texts at once")
    number = np.diff(bounds)
    row_of = np.repeat(np.arange(rows), number)
    starts = np.flatnonzero(np.arange(len(words)) + shingle <= np.repeat(bounds[1:], number))
    with np.errstate(over="ignore"):
        value = np.zeros(len(starts), np.uint64)
        for k in range(shingle):
            value += words[starts + k] * _FACTORS[k]
        short = np.flatnonzero((number > 0) & (number < shingle))
        whole = np.array([sum((int(words[bounds[r] + k]) * int(_FACTORS[k]) for k in range(number[r])), int(number[r]))
                          % (1 << 64) for r in short], np.uint64)
    owner = np.concatenate([row_of[starts], short]).astype(np.uint64)
    hashed = mix(np.concatenate([value, whole])) >> np.uint64(64 - TOKEN_BITS)
    key = distinct((owner << np.uint64(TOKEN_BITS)) | hashed)
    tokens = key & np.uint64((1 << TOKEN_BITS) - 1)
    return tokens, np.searchsorted(key >> np.uint64(TOKEN_BITS), np.arange(rows + 1).astype(np.uint64))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]


def set_ids(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sizes = np.diff(offsets).astype(np.uint64)
    with np.errstate(over="ignore"):
        hashed = mix(_sums(mix(tokens), offsets) + sizes * _FACTORS[5])
    return ((hashed >> np.uint64(SIZE_BITS) << np.uint64(SIZE_BITS))
            | np.minimum(sizes, np.uint64(_SIZE_MASK))).astype(np.int64)


def _segments(tokens: np.ndarray, offsets: np.ndarray, places: np.ndarray, band: np.ndarray, bands: Bands
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The non-empty segments of some sets: (place of the set, band, segment, offsets into their tokens), and tokens."""
    sizes = np.diff(offsets)[places]
    ends = np.cumsum(sizes)
    index = np.repeat(offsets[:-1][places] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    own = tokens[index]
    which = np.repeat(np.arange(len(places)), sizes)
    count = bands.segments[band].astype(np.uint64)
    segment = ((own >> np.uint64(TOKEN_BITS - 32)) * count[which]) >> np.uint64(32)
    edge = np.ones(len(own) + 1, bool)
    if len(own):
        edge[1:-1] = (which[1:] != which[:-1]) | (segment[1:] != segment[:-1])
    starts = np.flatnonzero(edge)
    heads = starts[:-1] if len(own) else starts[:0]
    bounds = starts if len(own) else np.zeros(1, np.int64)
    return which[heads], segment[heads], bounds, own


def _space(band: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """A number for every segment of every band."""
    return mix((band.astype(np.uint64) << np.uint64(40)) + segment.astype(np.uint64) + np.uint64(1))


def subset_hashes(tokens: np.ndarray, offsets: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place of the set) of every non-empty segment, and the slack each set has left."""
    left = np.full(len(offsets) - 1, UNBANDED)
    hashes, owners = [], []
    for places, band in bands.memberships(np.diff(offsets)):
        which, segment, bounds, own = _segments(tokens, offsets, places, band, bands)
        with np.errstate(over="ignore"):
            hashes.append(mix(_sums(mix(own), bounds) + _space(band[which], segment)))
        owners.append(places[which])
        empty = bands.segments[band] - np.bincount(which, minlength=len(places))
        left[places] = np.minimum(left[places], bands.slack[band] - empty)
    return np.concatenate(hashes), np.concatenate(owners), left


def _similar_sizes(a: np.ndarray, b: np.ndarray, similarity: int) -> np.ndarray:
    m, n = a & _SIZE_MASK, b & _SIZE_MASK
    return (np.minimum(m, n) * 100 >= np.maximum(m, n) * similarity) | (m == _SIZE_MASK) | (n == _SIZE_MASK)


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _gather(batches: Iterator[pa.RecordBatch], n: int) -> list[np.ndarray]:
    found = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(n)] for b in batches]
    return [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(n)]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes) of the runs of a sorted key, and each row's run."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(key)))
    return starts, sizes, np.cumsum(new) - 1


_ROW = ["kind", "a", "b", "times", "need_a", "need_b"]


def _counted(kind: int, a: np.ndarray, b: np.ndarray, need_a: np.ndarray, need_b: np.ndarray) -> pa.RecordBatch:
    """Different pairs of a partition with how often they occur, and what each side needs of its partners."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(a)))
    return _batch(_ROW, np.full(len(at), kind), a[at], b[at], times, need_a[order][at], need_b[order][at])


PAIR, PIVOT, SHARED = 0, 1, 2


def _allocate(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """A partition of (subset hash, set, need): pairs of small groups, pivot pairs and rows of larger ones."""
    key, ids, need = _gather(batches, 3)
    order = np.lexsort((ids, key))
    key, ids, need = key[order], ids[order], need[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
    key, ids, need = key[once], ids[once], need[once]
    starts, sizes, run = _runs(key)
    small = sizes[run] <= PAIRED
    left, right = [], []
    for gap in range(1, PAIRED):
        at = np.flatnonzero(small[:-gap] & (key[:-gap] == key[gap:])) if len(key) > gap else np.zeros(0, int)
        at = at[_similar_sizes(ids[at], ids[at + gap], similarity)]
        left.append(at)
        right.append(at + gap)
    left, right = np.concatenate(left), np.concatenate(right)
    yield _counted(PAIR, ids[left], ids[right], need[left], need[right])
    large = np.flatnonzero(~small)
    pivots = starts[run[large]]
    tried = (pivots != large) & _similar_sizes(ids[pivots], ids[large], similarity)
    yield _counted(PIVOT, ids[pivots[tried]], ids[large[tried]], need[pivots[tried]], need[large[tried]])
    yield _batch(_ROW, np.full(len(large), SHARED), key[large], ids[large], np.ones(len(large), int), need[large], need[large])


def _cross(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """A partition of (subset hash, set, component, need): pairs from different components, and rows of costly subsets."""
    key, ids, component, need = _gather(batches, 4)
    order = np.lexsort((ids, component, key))
    key, ids, component, need = key[order], ids[order], component[order], need[order]
    starts, sizes, _ = _runs(key)
    left, right, costly = [np.zeros(0, int)], [np.zeros(0, int)], np.zeros(len(key), bool)
    for start, size in zip(starts.tolist(), sizes.tolist()):
        if component[start] == component[start + size - 1]:
            continue
        _, part_sizes, part = _runs(component[start:start + size])
        if (size * size - int((part_sizes ** 2).sum())) // 2 > CROSS_PAIRS * size:
            costly[start:start + size] = True
            continue
        ends = np.cumsum(part_sizes)[part]
        for row in range(size):  # with the rows of the components after its own
            left.append(np.full(size - ends[row], start + row))
            right.append(np.arange(start + ends[row], start + size))
    left, right = np.concatenate(left), np.concatenate(right)
    near = _similar_sizes(ids[left], ids[right], similarity)
    left, right = left[near], right[near]
    swap = ids[left] > ids[right]
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    yield _counted(PAIR, ids[left], ids[right], need[left], need[right])
    lost = np.flatnonzero(costly)
    yield _batch(_ROW, np.full(len(lost), SHARED), key[lost], ids[lost], np.ones(len(lost), int), need[lost], need[lost])


def _meet(batches: Iterator[pa.RecordBatch], similarity: int) -> Iterator[pa.RecordBatch]:
    """A partition of (hash, set, kind): pairs of a full segment and a neighbourhood, or of two rows of kind BOTH."""
    key, ids, kind = _gather(batches, 3)
    order = np.lexsort((kind, key))
    key, ids, kind = key[order], ids[order], kind[order]
    starts, sizes, _ = _runs(key)
    a, b = [], []
    for start, size in zip(starts.tolist(), sizes.tolist()):
        mine, kinds = ids[start:start + size], kind[start:start + size]
        full = int((kinds == FULL).sum())
        for row in range(size if kinds[0] == BOTH else full):
            others = mine[row + 1:] if kinds[0] == BOTH else mine[full:]
            a.append(np.full(len(others), mine[row]))
            b.append(others)
    if a:
        a, b = np.concatenate(a), np.concatenate(b)
        near = _similar_sizes(a, b, similarity) & (a != b)
        none = np.zeros(int(near.sum()), int)
        yield _counted(PAIR, np.minimum(a, b)[near], np.maximum(a, b)[near], none, none)


FULL, DELETED, BOTH = 0, 1, 2


def _neighbourhoods(tokens: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(hash, kind) of every segment of one set, full and with each one shingle left out.

    Of the bands only those where all segments can differ: more than SLACK are empty, and the others no more than the
    shingles in which a partner of a set of this size can differ. Elsewhere some equal segment is not empty.
    """
    hashes, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, int)]
    offsets = np.array([0, len(tokens)])
    most = (100 - bands.similarity) * (len(tokens) + len(tokens) * 100 // bands.similarity) // (100 + bands.similarity)
    with np.errstate(over="ignore"):
        for places, band in bands.memberships(np.diff(offsets)):
            if not len(places):
                continue
            count = int(bands.segments[band[0]])
            _, segment, bounds, own = _segments(tokens, offsets, places, band, bands)
            if count - len(segment) <= bands.slack[band[0]] or len(segment) > most:
                continue
            space = _space(np.full(count, band[0]), np.arange(count))
            sums = np.zeros(count, np.uint64)
            sums[segment] = _sums(mix(own), bounds)
            full = mix(mix(sums + space))  # another space than the first index
            owner = np.repeat(segment, np.diff(bounds)).astype(np.int64)
            deleted = mix(mix(sums[owner] - mix(own) + space[owner]))
            hashes += [full, deleted]
            kinds += [np.full(len(full), FULL), np.full(len(deleted), DELETED)]
            if 2 * len(segment) <= bands.difference[band[0]]:
                hashes.append(mix(full))
                kinds.append(np.full(len(full), BOTH))
    return np.concatenate(hashes), np.concatenate(kinds)


class Join:
    """One run of the join over a table of texts."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: int) -> None:
        self.spark = docs.sparkSession
        require_checkpoint_dir(self.spark)
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.shingle, self.similarity, self.bands = shingle, similarity, Bands(similarity)
        self.parts = shuffle_partitions(self.spark)

    def documents(self) -> DataFrame:
        """doc_id, size and set id of every row, and the slack its set has left by its empty segments."""
        shingle, bands = self.shingle, self.bands

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                tokens, offsets = token_sets(batch.column(1), shingle)
                sizes = np.diff(offsets)
                left = np.full(len(sizes), UNBANDED)
                for places, band in bands.memberships(sizes):
                    which, _, _, _ = _segments(tokens, offsets, places, band, bands)
                    empty = bands.segments[band] - np.bincount(which, minlength=len(places))
                    left[places] = np.minimum(left[places], bands.slack[band] - empty)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, set_ids(tokens, offsets), left))],
                    names=["doc_id", "n_shingles", "set", "left"])

        return self.texts.mapInArrow(run, "doc_id long, n_shingles long, set long, left long")

    def index(self) -> DataFrame:
        """Subset hash, set id and the set's need (:meth:`possible`) of every non-empty segment."""
        shingle, bands = self.shingle, self.bands

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                tokens, offsets = token_sets(batch.column(0), shingle)
                ids = set_ids(tokens, offsets)
                hashes, owners, left = subset_hashes(tokens, offsets, bands)
                first = np.zeros(len(ids), bool)  # equal sets of a batch are indexed once
                first[np.unique(ids, return_index=True)[1]] = True
                keep = first[owners]
                yield _batch(["key", "set", "need"], hashes[keep].astype(np.int64), ids[owners[keep]],
                             left[owners[keep]] + 1)

        return self.texts.select("text").mapInArrow(run, "key long, set long, need long")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(set, payload) of the sets whose ids are in the column ``set`` of ``wanted``; some more may come along."""
        place = F.col("set").bitwiseXOR(F.shiftrightunsigned("set", 29))
        cell = F.pmod(place, F.lit(1 << FILTER_BITS))
        words = (wanted.select(cell.alias("cell"))
                 .selectExpr("cast(cell div 32 as int) as word", "shiftleft(1L, cast(pmod(cell, 32) as int)) as bit")
                 .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())  # at most 2**(FILTER_BITS - 5) rows
        table = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
        table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
        shared = self.spark.sparkContext.broadcast(table)
        shingle = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                tokens, offsets = token_sets(batch.column(0), shingle)
                ids = set_ids(tokens, offsets)
                unsigned = ids.astype(np.uint64)
                cells = ((unsigned ^ (unsigned >> np.uint64(29))) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                rows = np.flatnonzero((shared.value[cells >> 5] >> (cells & 31).astype(np.uint32)) & 1)
                rows = rows[np.sort(np.unique(ids[rows], return_index=True)[1])] if len(rows) else rows
                narrow = tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]
                payloads = [narrow[offsets[r]:offsets[r + 1]].tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), pa.array(payloads, pa.binary())],
                                                 names=["set", "payload"])

        return self.texts.select("text").mapInArrow(run, "set long, payload binary").dropDuplicates(["set"])

    def possible(self, pairs: DataFrame, unseen: DataFrame) -> DataFrame:
        """The pairs (a, b, times, need_a, need_b) that can be links.

        Partners share more than SLACK segments. Those that are empty, and those in subsets that make no pairs (a set has
        ``unseen`` many), may be among them; the others make the pair once each. A pair that was made less often than
        one of its sets needs is no link. The pairs are dealt by a, counted and met by what a lacks in one
        shuffle of ids; what is left meets what b lacks.
        """
        lacks = unseen.groupBy("set").agg(F.count("*").alias("lacks"))
        of_a = lacks.toDF("a", "lacks_a")
        of_b = lacks.toDF("b", "lacks_b")
        counted = (pairs.repartition(self.parts, "a").groupBy("a", "b")
                   .agg(F.sum("times").alias("times"), F.max("need_a").alias("need_a"), F.max("need_b").alias("need_b")))
        return (counted.join(of_a, "a", "left").filter(F.col("times") >= F.col("need_a") - F.coalesce("lacks_a", F.lit(0)))
                .join(of_b, "b", "left").filter(F.col("times") >= F.col("need_b") - F.coalesce("lacks_b", F.lit(0)))
                .select("a", "b"))

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar, as links (u, v)."""
        similarity = self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [similar(unpack(x), unpack(y), similarity)
                        for x, y in zip(batch.column(2), batch.column(3))]
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)],
                                                 names=["u", "v"])

        return (pairs.join(sets.select(F.col("set").alias("a"), F.col("payload").alias("set_a")), "a")
                .join(sets.select(F.col("set").alias("b"), F.col("payload").alias("set_b")), "b")
                .select("a", "b", "set_a", "set_b").mapInArrow(run, "u long, v long"))

    def links(self, documents: DataFrame) -> DataFrame:
        similarity, parts = self.similarity, self.parts
        row = ", ".join(f"{c} long" for c in _ROW)
        allocated = stored(self.index().repartition(parts, "key").mapInArrow(lambda b: _allocate(b, similarity), row), "allocated")
        shared = allocated.filter(F.col("kind") == SHARED).select(F.col("a").alias("key"), F.col("b").alias("set"),
                                                                  F.col("need_b").alias("need"))
        made = allocated.filter(F.col("kind") == PAIR)
        often = (allocated.filter(F.col("kind") == PIVOT).groupBy("a", "b").agg(F.sum("times").alias("times"))
                 .filter(F.col("times") >= PIVOT_SHARED).select("a", "b"))
        pairs = stored(self.possible(made, shared).union(often).distinct(), "pairs")
        sets = self.sets(pairs.select(F.col("a").alias("set")).union(pairs.select("b")))
        links = stored(self.verify(pairs, sets), "links")

        # subsets that many sets share: what the links so far leave open
        crossed = stored(self._with_components(shared, links).repartition(parts, "key")
                         .mapInArrow(lambda b: _cross(b, similarity), row), "crossed")
        costly = crossed.filter(F.col("kind") == SHARED).select(F.col("a").alias("key"), F.col("b").alias("set"))
        # new pairs, with the times that small subsets made them
        new = crossed.filter(F.col("kind") == PAIR)
        again = made.join(new.select("a", "b").distinct(), ["a", "b"], "left_semi")
        more = (self.possible(new.select(_ROW).union(again.select(_ROW)), costly).join(pairs, ["a", "b"], "left_anti"))
        # sets that lost more segments than their slack, by costly subsets or by empty segments alone
        left = documents.filter(F.col("left") < UNBANDED).groupBy("set").agg(F.min("left").alias("left"))
        poor = (costly.groupBy("set").agg(F.count("*").alias("lost")).join(left, "set")
                .filter(F.col("lost") > F.col("left")).select("set"))
        costly = stored(costly.join(poor, "set", "left_semi").select("key", "set"), "costly")
        bare = documents.filter("left < 0").select("set").distinct()
        more = stored(more, "more")
        sets = stored(self.sets(more.select(F.col("a").alias("set")).union(more.select("b")).union(costly.select("set"))
                                .union(bare)), "sets")
        more = more.union(self._neighbours(bare, sets)).distinct()
        # each written by a job of its own: the driver holds one short plan at a time
        more = stored(self.verify(more, sets), "more_links")
        return links.union(more).union(stored(self._block_links(costly, sets), "block_links"))

    def _with_components(self, rows: DataFrame, links: DataFrame) -> DataFrame:
        known = components(links).withColumnRenamed("node", "set")
        return rows.join(known, "set", "left").select("key", "set", F.coalesce("component", "set").alias("component"), "need")

    def _neighbours(self, bare: DataFrame, sets: DataFrame) -> DataFrame:
        """Candidate pairs of the sets with many empty segments."""
        bands, similarity = self.bands, self.similarity

        def neighbourhoods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own_id, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                    hashes, kinds = _neighbourhoods(unpack(payload), bands)
                    yield _batch(["key", "set", "kind"], hashes.astype(np.int64), np.full(len(hashes), own_id), kinds)

        return (sets.join(bare, "set", "left_semi").select("set", "payload")
                .mapInArrow(neighbourhoods, "key long, set long, kind long").repartition(self.parts, "key")
                .mapInArrow(lambda b: _meet(b, similarity), ", ".join(f"{c} long" for c in _ROW))
                .select("a", "b"))

    def _block_links(self, rows: DataFrame, sets: DataFrame) -> DataFrame:
        """Links among the sets of (key, set) rows that share a key.

        Sets are gathered by the least set of each of their keys; keys of one group of texts mostly have the
        same few least sets.
        """
        similarity, first = self.similarity, self.bands.first
        gathered = (rows.groupBy("key").agg(F.min("set").alias("cluster")).join(rows, "key")
                    .select("cluster", "set").distinct())
        band = F.size(F.filter(F.array(*[F.lit(int(f)) for f in first if f < _SIZE_MASK]),
                               lambda f: f <= F.col("size")))
        members = stored(gathered.withColumn("size", F.col("set").bitwiseAND(F.lit(_SIZE_MASK))).withColumn("band", band),
                         "members")
        sizes = stored(members.groupBy("cluster", "band").agg(F.ceil(F.greatest(
            F.count("*") / BLOCK_SETS, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "sizes")
        blocks = (members.join(sizes, ["cluster", "band"])
                  .withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
                  .join(sets, "set").select("cluster", "band", "block", "set", "payload")
                  .groupBy("cluster", "band", "block").applyInArrow(_pack_block, "cluster long, band int, block int, "
                                                                                 "packed binary"))
        blocks = stored(blocks, "blocks")
        numbered = sizes.select("cluster", "band", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "blocks")
        same = numbered.select("cluster", "band", "block", F.col("band").alias("band_b"),
                               F.explode(F.expr("sequence(block, blocks - 1)")).alias("block_b"))
        after = sizes.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("blocks_b"))
        next_band = (numbered.join(after, ["cluster", "band"])
                     .select("cluster", "band", "block", (F.col("band") + 1).alias("band_b"),
                             F.explode(F.expr("sequence(0, blocks_b - 1)")).alias("block_b")))
        met = (same.union(next_band).join(blocks, ["cluster", "band", "block"])
               .join(blocks.toDF("cluster", "band_b", "block_b", "packed_b"), ["cluster", "band_b", "block_b"])
               .select("packed", "packed_b"))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x, y in zip(batch.column(0), batch.column(1)):
                    u, v = block_forest(x.as_buffer(), y.as_buffer(), similarity)
                    yield _batch(["u", "v"], u, v)

        return met.mapInArrow(compare, "u long, v long")


def _pack_block(table: pa.Table) -> pa.Table:
    """The sets of a block as one row: their number, ids, sizes and shingles."""
    payloads = table["payload"].to_pylist()
    sizes = np.array([len(p) // 7 for p in payloads], "<i8")
    packed = len(payloads).to_bytes(8, "little") + table["set"].to_numpy().astype("<i8").tobytes() + sizes.tobytes() \
        + b"".join(payloads)
    return pa.table({c: table[c].slice(0, 1) for c in ("cluster", "band", "block")} | {"packed": pa.array([packed])})


def _unpack_block(data: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(memoryview(data)[:8], "little")
    ids, sizes = np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i8", n, 8 + 8 * n)
    return ids, sizes, _widen(np.frombuffer(data, np.uint8, offset=8 + 16 * n))


def block_forest(x: pa.Buffer, y: pa.Buffer, similarity: int = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (u, v) of the similar pairs between two blocks (or within one)."""
    (ids_x, sizes_x, tokens_x), (ids_y, sizes_y, tokens_y) = _unpack_block(x), _unpack_block(y)
    nx, ny = len(ids_x), len(ids_y)
    tokens = np.concatenate((tokens_x, tokens_y))
    owner = np.repeat(np.arange(nx + ny), np.concatenate((sizes_x, sizes_y)))
    order = np.argsort(tokens, kind="stable")
    owner = owner[order]
    starts, counts, run = _runs(tokens[order])
    common = np.zeros((nx, ny), np.float32)
    # shingles of few sets: every pair of an owner in x and one in y
    rare = counts[run] < DENSE
    for gap in range(1, DENSE):
        at = np.flatnonzero(rare[gap:] & (run[gap:] == run[:-gap])) if len(run) > gap else np.zeros(0, int)
        left, right = owner[at], owner[at + gap] - nx
        between = (left < nx) & (right >= 0)
        common += np.bincount(left[between] * ny + right[between], minlength=nx * ny).reshape(nx, ny)
    # the others: columns of a matrix product
    many = np.flatnonzero(counts >= DENSE)
    for at in range(0, len(many), 4096):
        part = many[at:at + 4096]
        index = np.repeat(starts[part] - (np.cumsum(counts[part]) - counts[part]), counts[part]) \
            + np.arange(counts[part].sum())
        matrix = np.zeros((nx + ny, len(part)), np.float32)
        matrix[owner[index], np.repeat(np.arange(len(part)), counts[part])] = 1
        common += matrix[:nx] @ matrix[nx:].T
    linked = 100 * common >= similarity * (sizes_x[:, None] + sizes_y - common)
    linked &= ids_x[:, None] != ids_y
    u, v = [], []
    fresh_x, fresh_y = linked.any(axis=1), linked.any(axis=0)
    for root in np.flatnonzero(fresh_x):
        if not fresh_x[root]:
            continue
        fresh_x[root] = False
        waiting = [(int(root), True)]
        while waiting:
            node, in_x = waiting.pop()
            found = np.flatnonzero(linked[node] & fresh_y) if in_x else np.flatnonzero(linked[:, node] & fresh_x)
            (fresh_y if in_x else fresh_x)[found] = False
            u += [(ids_x if in_x else ids_y)[node]] * len(found)
            v += (ids_y if in_x else ids_x)[found].tolist()
            waiting += [(int(f), not in_x) for f in found]
    return np.array(u, np.int64), np.array(v, np.int64)


def _widen(narrow: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(narrow) // 7, 8), np.uint8)
    wide[:, :7] = narrow.reshape(-1, 7)
    return wide.view("<u8").ravel()


def unpack(payload: pa.BinaryScalar) -> np.ndarray:
    return _widen(np.frombuffer(payload.as_buffer(), np.uint8))


def similar(x: np.ndarray, y: np.ndarray, similarity: int = SIMILARITY) -> bool:
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= similarity * (len(both) - common)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row."""
    join = Join(docs, id_col, text_col, shingle, similarity)
    documents = stored(join.documents(), "documents")
    known = components(join.links(documents)).withColumnRenamed("node", "set")
    filled = stored(documents.filter("n_shingles > 0").join(known, "set", "left")
                    .select("doc_id", "n_shingles", F.coalesce("component", "set").alias("component")), "filled")
    least = filled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (filled.join(least, "component").select("doc_id", "n_shingles", "component_id")
            .union(documents.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))
