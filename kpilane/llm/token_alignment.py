"""Alignment of two tokenizers over the same bytes, by galloping intersection of their token ends.

Tokenizer A is a byte-level BPE file, B a SentencePiece file that puts a space before a text; both
run over space+text. The byte offsets where tokens of both end cut a text into groups. In a group every A
token is linked with the B tokens whose bytes it overlaps.

*Galloping.* Of two lists of ends the shorter drives: each of its ends is looked up in the longer one by probes at
1, 2, 4, ... places and a binary search in the last doubling. Equal ends are the common
indices, which slice the groups; the difference between the ranks of two neighbouring ends is the
range of tokens that the one between them overlaps. All lists of a batch advance together.

*Units.* Neither tokenizer has a token across a space that follows a non-space: A splits there before it merges, and
B has no piece with a space after another character (checked when the file is loaded; a file that has
one gets whole texts as units). So a text is cut there into units, each different unit of a task is aligned once,
and a text's numbers are sums over its units. A task keeps at most ``UNITS`` units.

*Corpus counts.* Linked id pairs are counted per task and summed by Spark. The ``HEAD`` most frequent pairs at
most are broadcast; the links of rarer pairs join the table of counts. Both ways give the same
numbers, so ``HEAD`` changes the cost only.

Defined results: texts that are null or empty, or whose tokens of A or B don't give back
space+text, have no tokens: zeros and an empty digest; repeated rows and null ids are rows like others; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpilane.llm.common import slices, stored, texts_of
from kpilane.llm.packing import encoder

HEAD = 1 << 20
UNITS = 1 << 18  # a task starts anew with an empty table beyond that
UNIT_BYTES = 1 << 26
FLUSH = 1 << 20  # different pairs that a task gathers before it hands them on
SPACE_MARK = "▁"
_UNIT = re.compile(r"(?<=\S)(?= )")
_ODD_SPACE = re.compile(r"\s ")
_TOKENIZERS: dict[tuple[str, str], "Tokenizers"] = {}


class Tokenizers:
    """Both vocabularies: ids of a unit, and the bytes of every id."""

    def __init__(self, file_a: str, file_b: str) -> None:
        import sentencepiece

        self.a = encoder(file_a).fast
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        self.bytes_a = {i: token for token, i in self.a._mergeable_ranks.items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                        for i, p in enumerate(pieces)}
        self.length_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        self.length_a[list(self.bytes_a)] = [len(t) for t in self.bytes_a.values()]
        self.length_b = np.array([len(self.bytes_b[i]) for i in range(len(pieces))], np.int64)
        self.cuts = not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)
        self.space = self.b.piece_to_id(SPACE_MARK)
        self.base = len(pieces)  # a pair's code is a * base + b

    def units(self, text: str) -> list[str]:
        """The units of space+text, each without its first space."""
        if not self.cuts:
            return [text]
        if text[0] == " " or text[-1] == " " or _ODD_SPACE.search(text):
            return [u[1:] for u in _UNIT.split(" " + text)]
        return text.split(" ")

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B per unit; both empty where the bytes are not the unit's."""
        of_a = [self.a.encode_ordinary(" " + u) for u in units]
        of_b = [ids if u else [self.space] for u, ids in zip(units, self.b.encode(units, num_threads=1))]
        for i, unit in enumerate(units):
            wanted = b" " + unit.encode()
            if b"".join(map(self.bytes_a.__getitem__, of_a[i])) != wanted \
                    or b"".join(map(self.bytes_b.__getitem__, of_b[i])) != wanted:
                of_a[i], of_b[i] = [], []
        return of_a, of_b


def tokenizers(file_a: str, file_b: str) -> Tokenizers:
    if (file_a, file_b) not in _TOKENIZERS:
        _TOKENIZERS[file_a, file_b] = Tokenizers(file_a, file_b)
    return _TOKENIZERS[file_a, file_b]


def gallop(wanted: np.ndarray, first: np.ndarray, last: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per wanted end the first place in ``ends[first:last]`` whose end isn't smaller; the last one never is."""
    low, step = first - 1, np.ones(len(wanted), np.int64)  # ends[low] is smaller
    high = np.minimum(first, last - 1)
    going = np.flatnonzero(ends[high] < wanted)
    while len(going):  # exponential probes
        low[going] = high[going]
        step[going] *= 2
        high[going] = np.minimum(high[going] + step[going], last[going] - 1)
        going = going[ends[high[going]] < wanted[going]]
    going = np.flatnonzero(high - low > 1)
    while len(going):  # binary search
        middle = (low[going] + high[going]) >> 1
        smaller = ends[middle] < wanted[going]
        low[going[smaller]] = middle[smaller]
        high[going[~smaller]] = middle[~smaller]
        going = going[high[going] - low[going] > 1]
    return high


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (as many as the size) of every entry."""
    at = np.cumsum(sizes) - sizes
    return np.repeat(first - at, sizes) + np.arange(int(sizes.sum()))


def _driven(a_ends: np.ndarray, a_offsets: np.ndarray, b_ends: np.ndarray, b_offsets: np.ndarray,
            lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the lists that A drives: A's places, the first and last B place each overlaps, whether both end there."""
    sizes = np.diff(a_offsets)[lists]
    places = _ranges(a_offsets[:-1][lists], sizes)
    first, last = np.repeat(b_offsets[:-1][lists], sizes), np.repeat(b_offsets[1:][lists], sizes)
    upto = gallop(a_ends[places], first, last, b_ends)
    common = b_ends[upto] == a_ends[places]
    begin = np.empty(len(places), np.int64)
    begin[1:] = upto[:-1] + common[:-1]
    heads = (np.cumsum(sizes) - sizes)[sizes > 0]
    begin[heads] = first[heads]
    return places, begin, upto, common


class Alignment:
    """Lists of ids of A and B, list by list over the same bytes."""

    def __init__(self, tok: Tokenizers, of_a: list[list[int]], of_b: list[list[int]]) -> None:
        self.n_a = np.fromiter(map(len, of_a), np.int64, len(of_a))
        self.n_b = np.fromiter(map(len, of_b), np.int64, len(of_b))
        self.a = np.fromiter((i for ids in of_a for i in ids), np.int64, int(self.n_a.sum()))
        self.b = np.fromiter((i for ids in of_b for i in ids), np.int64, int(self.n_b.sum()))
        ends_a, ends_b = np.cumsum(tok.length_a[self.a]), np.cumsum(tok.length_b[self.b])
        offsets_a = np.concatenate(([0], np.cumsum(self.n_a)))
        offsets_b = np.concatenate(([0], np.cumsum(self.n_b)))
        few_a = self.n_a <= self.n_b
        at_a, begin_a, upto_a, common_a = _driven(ends_a, offsets_a, ends_b, offsets_b, np.flatnonzero(few_a))
        at_b, begin_b, upto_b, common_b = _driven(ends_b, offsets_b, ends_a, offsets_a, np.flatnonzero(~few_a))
        # links, in the order of the lists' numbers
        sizes_a, sizes_b = upto_a - begin_a + 1, upto_b - begin_b + 1
        links_a = np.concatenate((np.repeat(at_a, sizes_a), _ranges(begin_b, sizes_b)))
        links_b = np.concatenate((_ranges(begin_a, sizes_a), np.repeat(at_b, sizes_b)))
        owner = np.repeat(np.arange(len(of_a)), self.n_a)[links_a]
        order = np.argsort(owner, kind="stable")
        self.links = (self.a[links_a] * tok.base + self.b[links_b])[order]
        self.n_links = np.bincount(owner, minlength=len(of_a))
        # groups end where both end
        self.last_a, self.last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        self.last_a[np.concatenate((at_a[common_a], upto_b[common_b]))] = True
        self.last_b[np.concatenate((upto_a[common_a], at_b[common_b]))] = True
        self.n_groups = np.diff(np.concatenate(([0], np.cumsum(self.last_a)))[offsets_a])

    def groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every list."""
        count = int(self.last_a.sum())
        of_a, of_b = (np.cumsum(x) - x for x in (self.last_a, self.last_b))  # group numbers
        before_a = np.concatenate(([0], np.cumsum(np.bincount(of_a, minlength=count))))
        before_b = np.concatenate(([0], np.cumsum(np.bincount(of_b, minlength=count))))
        ids, marks = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        for place, own, last, mark in ((np.arange(len(self.a)) + before_b[of_a], self.a, self.last_a, b"|"),
                                       (np.arange(len(self.b)) + before_a[of_b + 1], self.b, self.last_b, b";")):
            ids[place] = own
            marks[place] = np.where(last, mark[0], b","[0])
        width = len(str(int(ids.max(initial=0))))
        written = np.zeros((len(ids), width + 1), np.uint8)
        written[:, width] = marks
        left = ids.copy()
        for column in reversed(range(width)):
            written[:, column] = np.where((left > 0) | (column == width - 1), 48 + left % 10, 0)
            left //= 10
        shown = written != 0
        ends = np.concatenate(([0], np.cumsum(shown.sum(axis=1))))[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))]
        text = written[shown].tobytes()
        return [text[x:y - 1] if y > x else b"" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


class Units:
    """The different units of a task by number, with what is known of each."""

    def __init__(self, tok: Tokenizers) -> None:
        self.tok = tok
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.parts: list[Alignment] = []
        self.size = 0

    def full(self) -> bool:
        return len(self.number) > UNITS or self.size > UNIT_BYTES

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Alignment]:
        """The unit numbers of the texts, one after the other, the n + 1 offsets, and the units met for the first time."""
        cut = [self.tok.units(t) if t else [] for t in texts]
        new: dict[str, int] = {}
        flat = np.empty(sum(map(len, cut)), np.int64)
        at, known, start = 0, self.number, len(self.number)
        for units in cut:
            for u in units:
                i = known.get(u)
                if i is None:
                    i = known[u] = start + len(new)
                    new[u] = i
                flat[at] = i
                at += 1
        units = list(new)
        self.size += sum(map(len, units))
        return flat, np.concatenate(([0], np.cumsum([len(c) for c in cut]))).astype(np.int64), \
            Alignment(self.tok, *self.tok.encode(units))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[offsets])


def _extend(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.concatenate((old, new))


def _take_lists(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return values[_ranges(offsets[:-1][rows], np.diff(offsets)[rows])]


def link_counts(docs: DataFrame, file_a: str, file_b: str, text_col: str = "text") -> DataFrame:
    """pair (a * pieces of B + b), links: how many links of all texts join the two ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(tokenizers(file_a, file_b))
        nothing = np.zeros(0, np.int64)
        links, n_links, n_a, times = nothing, nothing, nothing, nothing

        def drain() -> pa.RecordBatch:
            codes, inverse = np.unique(links, return_inverse=True)
            weights = np.bincount(inverse, np.repeat(times, n_links), len(codes)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(codes[weights > 0]), pa.array(weights[weights > 0])],
                                              names=["pair", "links"])

        for batch in slices(batches):
            flat, offsets, new = units.of(texts_of(batch.column(0)))
            links, n_links, n_a = _extend(links, new.links), _extend(n_links, new.n_links), _extend(n_a, new.n_a)
            broken = _sums(n_a[flat] == 0, offsets) > 0
            sound = flat[~np.repeat(broken, np.diff(offsets))]
            times = _extend(times, np.zeros(len(new.n_a), np.int64)) + np.bincount(sound, minlength=len(n_a))
            if units.full():
                yield drain()
                units.clear()
                links, n_links, n_a, times = nothing, nothing, nothing, nothing
        yield drain()

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "pair long, links long")
    return counted.groupBy("pair").agg(F.sum("links").alias("links"))


def _head(pairs: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent pairs by whole powers of two of their counts, ``head`` at most: codes, counts, best."""
    power = F.floor(F.log2("links")).cast("int").alias("power")
    levels = {r["power"]: r["n"] for r in pairs.groupBy(power).agg(F.count("*").alias("n")).collect()}  # 63 rows at most
    least, room = 64, head
    while least > 0 and levels.get(least - 1, 0) <= room:
        least -= 1
        room -= levels.get(least, 0)
    table = pairs.filter(F.floor(F.log2("links")) >= least).toArrow().sort_by("pair")
    return tuple(table[c].to_numpy() for c in ("pair", "links", "best"))


_SCHEMA = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string, rare array<long>")


def align(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text",
          head: int = HEAD) -> DataFrame:
    """Per document how its tokens align, and how usual its links are in the whole table."""
    spark = docs.sparkSession
    base = tokenizers(file_a, file_b).base
    counted = link_counts(docs, file_a, file_b, text_col).withColumn("b", F.col("pair") % base)
    most = counted.groupBy("b").agg(F.max("links").alias("most"))  # one row per id of B at most
    pairs = stored(counted.join(F.broadcast(most), "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best")),
                   "links")
    shared = spark.sparkContext.broadcast(_head(pairs, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, bests = shared.value
        units = Units(tokenizers(file_a, file_b))
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        texts_known: list[bytes] = []
        numbers = np.zeros((7, 0), np.int64)  # per unit: a, b, groups, links, best, count sum, rare links
        rare = np.zeros(0, np.int64)
        for batch in slices(batches):
            flat, offsets, new = units.of(texts_of(batch.column(1)))
            place = np.minimum(np.searchsorted(codes, new.links), max(len(codes) - 1, 0))
            known = codes[place] == new.links if len(codes) else np.zeros(len(new.links), bool)
            count, best = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
            count[known], best[known] = counts[place[known]], bests[place[known]]
            own = np.concatenate(([0], np.cumsum(new.n_links)))
            numbers = np.concatenate((numbers, np.array([new.n_a, new.n_b, new.n_groups, new.n_links, _sums(best, own),
                                                         _sums(count, own), _sums(~known, own)])), axis=1)
            rare = _extend(rare, new.links[~known])
            texts_known += new.groups()
            broken = _sums(numbers[0][flat] == 0, offsets) > 0
            flat = flat[~np.repeat(broken, np.diff(offsets))]
            sizes = np.where(broken, 0, np.diff(offsets))
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            sums = [_sums(numbers[k][flat], offsets) for k in range(7)]
            digests = []
            listed = list(map(texts_known.__getitem__, flat.tolist()))
            for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                digests.append(hashlib.sha256(b";".join(listed[x:y])).hexdigest() if y > x else "")
            rare_offsets = np.concatenate(([0], np.cumsum(numbers[6])))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sums[6]))).astype(np.int32)),
                                             pa.array(_take_lists(rare, rare_offsets, flat)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(sizes))), batch.column(0), *(pa.array(s) for s in sums[:6]),
                 pa.array(digests, pa.string()), lists],
                names=[c.split()[0] for c in _SCHEMA.split(", ")])
            row += len(sizes)
            if units.full():
                units.clear()
                texts_known, numbers, rare = [], np.zeros((7, 0), np.int64), np.zeros(0, np.int64)

    aligned = stored(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _SCHEMA),
                     "aligned")
    times = aligned.select("row", F.explode("rare").alias("pair")).groupBy("row", "pair").agg(F.count("*").alias("times"))
    more = (times.join(pairs, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                 F.sum(F.col("links") * F.col("times")).alias("more_sum")))
    return aligned.join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
