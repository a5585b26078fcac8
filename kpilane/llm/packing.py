"""Bounded-space online packing of token ids into sequences of a fixed window.

Every partition keeps at most ``OPEN_WINDOWS`` windows open. A document's ids
(with a closing id) fill whole windows first; what is left over goes to the
open window with the least room that still takes it. When none takes it and no
further window may be opened, the fullest window is topped up with the head of
the piece and emitted, and the rest of the piece is placed again. At the end of
the partition the windows still open are merged: their pieces fill windows one
after the other, and the last, shorter rest is cut into sequences whose lengths
are powers of two, which need no padding.

The work is one pass over the scan: no shuffle, and memory for the open windows
and one Arrow batch. A task that is run again reads the same split and returns
the same rows.

Ids come from the vocabulary file of a byte-level BPE tokenizer. The ranks in
that file are run by ``tiktoken`` (about five times as fast as ``tokenizers``
on these texts); a text that contains one of the file's special tokens goes
through ``tokenizers``, which maps it to its own id. Both give the same ids
(tests/llm/test_packing.py).

Defined results: null and empty texts are the closing id alone; repeated rows
are packed each on their own; null ids stay null; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpilane.llm.common import slices, texts_of

WINDOW = 1024
OPEN_WINDOWS = 32
END_ID = 0
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
_ENCODERS: dict[str, object] = {}


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files write for bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Text to ids for a byte-level BPE file of ``tokenizers``."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        chars = _byte_of_char()
        ranks = {bytes(chars[c] for c in piece): i for piece, i in spec["model"]["vocab"].items()
                 if piece not in self.special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens={})
        self.exact = Tokenizer.from_file(path)

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """The windows of one partition. ``rows`` collects finished pieces."""

    def __init__(self, sequence: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> None:
        self.sequence, self.window, self.limit = sequence, window, open_windows
        self.open: list[list] = []  # each: [room, [(doc_id, start, ids, doc_tokens), ...]]
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total,
                              self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.window:
            self.emit([(doc_id, at, ids[at:at + self.window], total)])
            at += self.window
        while at < total:
            size = total - at
            fits = [w for w in self.open if w[0] >= size]
            if fits:
                best = min(fits, key=lambda w: w[0])
            elif len(self.open) < self.limit:
                best = [self.window, []]
                self.open.append(best)
            else:
                best = min(self.open, key=lambda w: w[0])
            take = min(size, best[0])
            best[0] -= take
            best[1].append((doc_id, at, ids[at:at + take], total))
            at += take
            if not best[0]:
                self.emit(best[1])
                self.open = [w for w in self.open if w is not best]

    def close(self) -> None:
        """Merge the windows still open, the fullest first."""
        pieces = [p for w in sorted(self.open, key=lambda w: w[0]) for p in w[1]]
        left = sum(len(p[2]) for p in pieces)
        sizes = [self.window] * (left // self.window)
        sizes += [1 << b for b in reversed(range(self.window.bit_length())) if (left % self.window) >> b & 1]
        self.open = []
        at = iter(pieces)
        piece = None
        for size in sizes:
            sequence: list[tuple] = []
            while size:
                doc_id, start, ids, total = piece or next(at)
                take = min(size, len(ids))
                sequence.append((doc_id, start, ids[:take], total))
                piece = (doc_id, start + take, ids[take:], total) if take < len(ids) else None
                size -= take
            self.emit(sequence)

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_file)
        context = TaskContext.get()
        packer = Packer((context.partitionId() if context else 0) << 40, window, open_windows)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = array("I", encode(text))
                ids.append(end_id)
                packer.add(doc_id, np.frombuffer(ids, dtype=np.uint32))
            yield packer.drain()
        packer.close()
        yield packer.drain()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
