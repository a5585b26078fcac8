"""Lempel-Ziv phrase fingerprints and their likeness.

A text is parsed left to right into phrases: the shortest prefix of what is
left that no earlier phrase equals becomes a new phrase of the dictionary
(Lempel-Ziv 78). A phrase ends with a line end, which is its last character, so that the parses of two texts
that differ in one place meet again on the next line. The fingerprint is the
``SIGNATURE`` smallest 32-bit hashes of the dictionary's phrases; the likeness of two
fingerprints is the share of hashes that both hold among the smallest of their
union, an estimate of the Jaccard similarity of the phrase sets (exact for
small sets).

``edited_neighbours`` also parses each text with its last quarter replaced by
the start of the next document. The parse of the part that both texts share is
reused, and the next document is found by dealing rows to ranges of ids: the
range bounds are ids of the table itself, so a range's first row also goes to
the range before it. The texts are shuffled once.

Defined results: a null text is empty; an empty text has the empty fingerprint,
alike to another empty one (1.0) and to nothing else (0.0); rows with one id
are ordered by text, null ids come first; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpilane.llm.common import distinct, shuffle_partitions, slices

SIGNATURE = 128
RANGES_PER_PARTITION = 4
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def parse(text: str, phrases: set[str], open_phrase: str = "") -> str:
    """Add the phrases of ``text`` to the dictionary; returns the phrase left open at its end."""
    add = phrases.add
    phrase = open_phrase
    for k, line in enumerate(text.split("\n")):
        if k:
            add(phrase + "\n")
            phrase = ""
        for char in line:
            phrase += char
            if phrase not in phrases:
                add(phrase)
                phrase = ""
    return phrase


def hashes(phrases: set[str]) -> np.ndarray:
    """Sorted distinct 32-bit hashes, the ``SIGNATURE`` smallest."""
    if not phrases:
        return np.zeros(0, np.uint32)
    values = pd.util.hash_array(np.array(list(phrases), dtype=object), categorize=False)
    return smallest(distinct((values >> np.uint64(32)).astype(np.uint32)))


def smallest(values: np.ndarray) -> np.ndarray:
    return values[:SIGNATURE]


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return smallest(distinct(np.concatenate((a, b))))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate((a, b))
    both.sort()
    repeated = both[1:] == both[:-1]
    # the place among the distinct hashes of the union; only its smallest count
    place = np.cumsum(~repeated) + 1
    return float(repeated[place <= SIGNATURE].sum() / min(SIGNATURE, place[-1] if len(place) else 1))


def encode(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype("<u4").tobytes()).decode("ascii")


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


def fingerprint(text: str | None) -> str:
    phrases: set[str] = set()
    parse(text or "", phrases)
    return encode(hashes(phrases))


def _edited(text: str, following: str) -> tuple:
    """(n_chars, sha256 of the edited text, signature, signature of the edited text)."""
    quarter = len(text) // 4
    kept, replaced = text[:len(text) - quarter], following[:quarter]
    shared: set[str] = set()
    left_open = parse(kept, shared)
    base = hashes(shared)
    signatures = []
    for tail in (text[len(text) - quarter:], replaced):
        phrases = shared.copy()
        parse(tail, phrases, left_open)
        signatures.append(union(base, hashes(phrases - shared)))
    digest = hashlib.sha256((kept + replaced).encode("utf-8")).hexdigest()
    return len(text), digest, *signatures


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, only_next, id): each row with the row after it."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in (
        "edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()),
        ("near_next", pa.float64())])
    last = None  # (range, doc_id, text) that waits for the row after it
    waiting = None  # the finished row that waits for the next row's signature
    out: list[tuple] = []

    def finish(signature: np.ndarray) -> None:
        doc_id, n, digest, own, edited = waiting
        out.append((doc_id, n, digest, encode(own), encode(edited), likeness(own, edited),
                    likeness(own, signature)))

    def table() -> pa.RecordBatch:
        nonlocal out
        columns, out = list(zip(*out)) or [[]] * len(schema), []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in slices(batches, 256):
        for part, only_next, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if last is not None and last[0] == part:
                n, digest, own, edited = _edited(last[2], text)
                if waiting is not None:
                    finish(own)
                waiting = (last[1], n, digest, own, edited)
            if only_next:
                if waiting is not None:  # the range's last row: its neighbour is parsed for this alone
                    phrases: set[str] = set()
                    parse(text, phrases)
                    finish(hashes(phrases))
                last = waiting = None
            else:
                last = (part, doc_id, text)
        yield table()


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(order.alias("order"), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cuts = parts * RANGES_PER_PARTITION
    # at most ``cuts`` ids of the table, the smallest among them
    least, bounds = rows.agg(
        F.min("order"), F.percentile_approx("order", [i / cuts for i in range(1, cuts)], 10 * cuts)).first()
    bounds = [] if least is None else sorted({least, *bounds})
    known = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    part = F.size(F.filter(known, lambda b: b <= F.col("order")))
    # the first row of a range is also the row after the last of the range before (of the last, for the first)
    before = F.when(part > 1, part - 1).otherwise(F.lit(len(bounds)))
    dealt = (rows.withColumn("part", part)
             .withColumn("to", F.when(F.array_contains(known, F.col("order")), F.array(
                 F.struct(F.col("part"), F.lit(False).alias("only_next")),
                 F.struct(before.alias("part"), F.lit(True).alias("only_next"))))
                 .otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("only_next")))))
             .select("order", "doc_id", "text", F.explode("to").alias("to"))
             .select(F.col("to.part").alias("part"), F.col("to.only_next").alias("only_next"),
                     "order", "doc_id", "text"))
    return (dealt.repartition(parts, "part")
            .sortWithinPartitions("part", "only_next", "order", "text")
            .select("part", "only_next", "doc_id", "text")
            .mapInArrow(_neighbours, SCHEMA))
