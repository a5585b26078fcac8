"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

A text gets a leading word mark, spaces become word marks, and it is cut before
every run of marks; no piece of the model crosses such a cut, so the best
segmentation of a text is the sequence of its words' best segmentations. The
different words of a batch are segmented once each: words of equal length advance
together, character by character. At each place the hashes of all substrings that end there
(at most the longest piece) probe the sorted hashes of the pieces, and a
vectorised maximum over score so far plus piece score stores the back pointer.
Of equal totals the longest last piece wins. A character that no piece holds
scores the least piece score minus ``UNKNOWN_PENALTY`` and becomes its UTF-8 byte
pieces, so decoding gives the text back.

The objective is the sum of the scores that the model file lists, SentencePiece's
unigram search. The given file holds the pieces of a model of merge type; for such a file
the library itself would replay merges, whose result can differ from the best sum. The
encoding here equals the library's on the same file read as a unigram model
(tests/llm/test_sentencepiece_viterbi.py), and decoding is the library's for either.

Piece hashes are 64-bit sums; the pieces' own hashes are checked to be distinct when
the model is read. Memory is bounded by the batch; there is no shuffle.

Defined results: null and empty texts have no ids and decode to ""; a word mark in a
text decodes to a space; repeated rows are encoded each on their own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpilane.llm.common import _powers, mix, slices, texts_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0
BATCH = 2048
LONGEST_WORD_MATRIX = 1 << 22  # cells of one equal-length group that advance together
SCHEMA = ("doc_id long, n_chars long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
_MODELS: dict[str, Model] = {}


def _code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    """The pieces of a model file, as arrays."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = processor.get_piece_size()
        pieces = [processor.id_to_piece(i) for i in range(size)]
        skipped = [processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i)
                   or processor.is_unused(i) for i in range(size)]
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(size):
            if processor.is_byte(i):
                self.byte_ids[int(pieces[i][3:-1], 16)] = i
        usable = [i for i in range(size) if not skipped[i]]
        if any(MARK in pieces[i].lstrip(MARK) for i in usable):
            raise ValueError("a piece holds a word mark after its beginning")
        lengths = np.array([len(pieces[i]) for i in usable])
        self.longest = int(lengths.max())
        codes = _code_points([pieces[i] for i in usable])
        ends = np.cumsum(lengths)
        values = self.sums(codes)
        keys = self.substring(values, ends - lengths, ends)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(usable)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.key_scores = np.array([processor.get_score(i) for i in usable])[order]
        self.unknown_score = float(self.key_scores.min()) - UNKNOWN_PENALTY
        self.filter = np.zeros(1 << 20, bool)  # which hashes are worth a search
        self.filter[self.keys >> np.uint64(44)] = True
        # what every id decodes to
        decoded = [bytes([int(p[3:-1], 16)]) if processor.is_byte(i) else b"" if skipped[i]
                   else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.decoded = np.frombuffer(b"".join(decoded), np.uint8)
        self.decoded_size = np.array([len(d) for d in decoded])
        self.decoded_start = np.cumsum(self.decoded_size) - self.decoded_size

    @staticmethod
    def sums(codes: np.ndarray) -> np.ndarray:
        """Running sums over the code points, from which any substring's hash follows."""
        up, _ = _powers(len(codes) + 1)
        out = np.zeros(len(codes) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:len(codes)], out=out[1:])
        return out

    @staticmethod
    def substring(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = _powers(len(sums))
        with np.errstate(over="ignore"):
            return mix((sums[ends] - sums[starts]) * down[starts])

    def search(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of the pieces with these hashes; -inf and -1 where there is none."""
        scores, ids = np.full(len(hashes), -np.inf), np.full(len(hashes), -1, np.int32)
        likely = np.flatnonzero(self.filter[hashes >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.keys, hashes[likely]), len(self.keys) - 1)
        same = self.keys[place] == hashes[likely]
        scores[likely[same]], ids[likely[same]] = self.key_scores[place[same]], self.key_ids[place[same]]
        return scores, ids

    def _segment(self, codes: np.ndarray, sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Words of one length: the id of the piece that ends at each character, -1 unknown, -2 none."""
        n = len(starts)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((length + 1, n), np.int32)
        piece = np.zeros((length + 1, n), np.int32)
        for end in range(1, length + 1):
            first = max(0, end - self.longest)
            begins = np.arange(first, end)[:, None]  # ascending, so that the first maximum is the longest piece
            hashes = self.substring(sums, (starts + begins).ravel(), np.broadcast_to(starts + end, (end - first, n)).ravel())
            scores, ids = self.search(hashes)
            scores, ids = scores.reshape(-1, n), ids.reshape(-1, n)
            scores[-1][ids[-1] < 0] = self.unknown_score
            totals = best[first:end] + scores
            choice = totals.argmax(axis=0)
            each = np.arange(n)
            best[end], back[end], piece[end] = totals[choice, each], first + choice, ids[choice, each]
        out = np.full((n, length), -2, np.int32)
        at, alive = np.full(n, length), np.arange(n)
        while len(alive):
            out[alive, at - 1] = piece[at, alive]
            at = back[at, alive]
            alive, at = alive[at > 0], at[at > 0]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, n + 1 offsets)."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        sizes = np.array([len(t) for t in marked], np.int64)
        codes = _code_points(marked)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        is_mark = codes == ord(MARK)
        cut = is_mark.copy()
        cut[1:] &= ~is_mark[:-1]
        cut[bounds[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(codes))
        sums = self.sums(codes)
        _, first, which = np.unique(self.substring(sums, starts, ends), return_index=True, return_inverse=True)
        word_starts, word_sizes = starts[first], (ends - starts)[first]
        by_size = np.argsort(word_sizes, kind="stable")
        groups = np.split(by_size, np.flatnonzero(np.diff(word_sizes[by_size])) + 1)
        flat: list[np.ndarray] = []  # ids of the words, in the order of ``order``
        counts = np.zeros(len(first), np.int64)
        order: list[np.ndarray] = []
        for group in groups:
            length = int(word_sizes[group[0]])
            step = max(1, LONGEST_WORD_MATRIX // (length + 1))
            for at in range(0, len(group), step):
                part = group[at:at + step]
                found = self._segment(codes, sums, word_starts[part], length)
                row, place = np.nonzero(found != -2)
                ids, code = found[row, place].astype(np.int64), codes[word_starts[part][row] + place]
                if (ids < 0).any():
                    ids, row = self._bytes(ids, code, row)
                flat.append(ids)
                counts[part] = np.bincount(row, minlength=len(part))
                order.append(part)
        words = np.concatenate(order)
        word_at = np.zeros(len(first), np.int64)
        word_at[words] = np.cumsum(counts[words]) - counts[words]
        pool = np.concatenate(flat)
        ids = pool[ragged(word_at[which], counts[which])]
        per_word = np.concatenate([[0], np.cumsum(counts[which])])
        return ids, per_word[np.searchsorted(starts, bounds)]

    def _bytes(self, ids: np.ndarray, code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters replaced by their byte pieces."""
        unknown = np.flatnonzero(ids < 0)
        encoded = [chr(c).encode("utf-8", "surrogatepass") for c in code[unknown]]
        repeat = np.ones(len(ids), np.int64)
        repeat[unknown] = [len(e) for e in encoded]
        out = np.repeat(ids, repeat)
        out[np.repeat(ids < 0, repeat)] = self.byte_ids[np.frombuffer(b"".join(encoded), np.uint8)]
        return out, np.repeat(row, repeat)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 text of every run of ids, without the leading space that stands for the first word mark."""
        sizes = self.decoded_size[ids]
        raw = self.decoded[ragged(self.decoded_start[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
        return [raw[a:b].removeprefix(b" ") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0] + 1, ... of every run, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text",
                     into: str = "ids") -> DataFrame:
    """doc_id and the array of its text's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH):
            ids, offsets = model(model_file).encode(texts_of(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", into])

    return (docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
            .mapInArrow(run, f"doc_id long, {into} array<int>"))


def decode_ids(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that the ids decode to; a null array decodes to ""."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH):
            lists = [i or [] for i in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in lists], dtype=np.int64)])
            ids = np.array([i for each in lists for i in each], np.int64)
            texts = [t.decode("utf-8", "replace") for t in model(model_file).decode(ids, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return (encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>"))
            .mapInArrow(run, "doc_id long, text string"))


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text encoded and decoded again: counts and digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH):
            texts, known = texts_of(batch.column(1)), model(model_file)
            ids, offsets = known.encode(texts)
            decoded = known.decode(ids, offsets)
            raw = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(np.diff(offsets), pa.int64()),
                 pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])], pa.int64()),
                 pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string()),
                 pa.array([d == t.encode() for d, t in zip(decoded, texts)], pa.bool_())],
                names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
