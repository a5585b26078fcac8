"""Quality rules as a short-circuit cascade.

Every rule is a test of one text on its own. On a sample of about ``SAMPLE_ROWS`` rows each rule's cost (CPU seconds a
text) and selectivity (share of texts that it rejects) are measured; the cascade tries the rules by
falling rejection per cost, and a text meets no rule after the first that rejects it. The order
changes how long the work takes and which rule is named, never the verdict, which is that no rule
rejects: the sample needs no luck. Nothing but two numbers a rule reaches the driver, and
the texts are read once, row by row, without a shuffle.

Before the cascade come the base counts (:func:`base_counts`): texts of fewer than ten words, and those with more
than a fifth of their words in repeated windows, fail without meeting a rule.

Windows of five words are compared as 64-bit hashes within a text.

Defined results: null and empty texts have no words and fail; repeated rows are judged each on their own, null ids
stay null; an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpilane.llm.common import slices, texts_of

SAMPLE_ROWS = 2000  # expected
REPEATED = 5  # words in a window
_BLANKS = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))
_LETTER = regex.compile(r"\p{L}")
_ELLIPSES = (b"...", "…".encode())
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Text:
    """A text with what several rules need of it, made when first asked for."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # at 0x20 and 0x09-0x0D, as bytes do

    @cached_property
    def lines(self) -> list[bytes]:
        """The lines that hold a word."""
        return [line for line in self.raw.split(b"\n") if line and not line.isspace()]

    def count(self, characters: bytes) -> int:
        """How many of these ASCII characters stand in the text."""
        return len(self.raw) - len(self.raw.translate(None, characters))

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - self.count(_BLANKS)

    @cached_property
    def n_symbols(self) -> int:
        return self.count(_SYMBOLS)

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window which stands twice or more in the text."""
        n = len(self.words)
        if n <= REPEATED:
            return 0
        h = np.fromiter(map(hash, self.words), np.int64, n).astype(np.uint64)
        size = n - REPEATED + 1
        window = h[:size].copy()
        with np.errstate(over="ignore"):
            for k in range(1, REPEATED):
                window = window * _STEP + h[k:k + size]
        order = np.argsort(window)
        same = window[order[1:]] == window[order[:-1]]
        if not same.any():
            return 0
        twice = np.zeros(size, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = np.flatnonzero(twice)
        edges = np.bincount(at, minlength=n + 1) - np.bincount(at + REPEATED, minlength=n + 1)
        return int((np.cumsum(edges) > 0).sum())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


def _stutters(t: Text) -> bool:
    return 10 * sum(map(bytes.__eq__, t.words, t.words[1:])) > 3 * len(t.words)


def _shouts(t: Text) -> bool:
    capitals = t.count(_CAPITALS)
    return 10 * capitals > 6 * (capitals + t.count(_SMALL))


def _without_letters(t: Text) -> bool:
    return 2 * sum(not _LETTER.search(w.decode()) for w in t.words) > len(t.words)


def _trails_off(t: Text) -> bool:
    return 10 * sum(line.rstrip().endswith(_ELLIPSES) for line in t.lines) > 3 * len(t.lines)


RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > len(t.words)),
    Rule("word_length", lambda t: not 2 * len(t.words) <= t.word_chars <= 15 * len(t.words)),
    Rule("duplicate_lines", lambda t: 5 * t.n_dup_lines > 2 * len(t.lines)),
    Rule("stutter", _stutters),
    Rule("capitals", _shouts),
    Rule("letters", _without_letters),
    Rule("ellipses", _trails_off),
)


def base_counts(t: Text) -> tuple[int, int, int, int, int]:
    return len(t.words), t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


@dataclass(frozen=True)
class Estimate:
    """Of one rule: sampled texts, how many it rejected, CPU seconds."""

    name: str
    texts: int
    rejected: int
    seconds: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def estimates(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES,
              sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Cost and selectivity of every rule among sampled texts that pass the base counts."""
    share = sample_rows / max(docs.count(), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x for x in texts_of(batch.column(0)) if not base_fails(len((t := Text(x)).words), t.n_repeat_words)]
            rejected, seconds = [], []
            for rule in rules:
                began = time.thread_time()
                rejected.append(sum(rule.rejects(Text(x)) for x in texts))  # without what other rules have made
                seconds.append(time.thread_time() - began)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.name for r in rules]), pa.array([len(texts)] * len(rules), pa.int64()),
                 pa.array(rejected, pa.int64()), pa.array(seconds, pa.float64())],
                names=["name", "texts", "rejected", "seconds"])

    sample = docs.filter(F.rand(12) < share) if share < 1 else docs
    measured = (sample.select(F.col(text_col).cast("string")).mapInArrow(run, "name string, texts long, rejected long, seconds double")
                .groupBy("name").agg(F.sum("texts"), F.sum("rejected"), F.sum("seconds")))
    found = {r[0]: Estimate(*r) for r in measured.collect()}  # a row for each rule
    return [found.get(r.name, Estimate(r.name, 0, 0, 0.0)) for r in rules]


def cascade_order(rules: Sequence[Rule], measured: Sequence[Estimate]) -> list[Rule]:
    """By rejection per cost; among equals the cheaper first, then as given."""
    at = {e.name: e for e in measured}
    return sorted(rules, key=lambda r: (-at[r.name].worth, at[r.name].seconds))


def first_rejecting(t: Text, ordered: Sequence[Rule]) -> tuple[str | None, int]:
    """The rule that stops the cascade, and how many were tried."""
    for tried, rule in enumerate(ordered, 1):
        if rule.rejects(t):
            return rule.name, tried
    return None, len(ordered)


_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, stopped_by string, rules_tried int")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES,
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base counts and verdict of every row, the rule that rejected it, and how many rules it met."""
    rules = tuple(rules)
    ordered = cascade_order(rules, estimates(docs, text_col, rules, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in texts_of(batch.column(1)):
                t = Text(text)
                counts = base_counts(t)
                failed = base_fails(counts[0], counts[4])
                stopped, tried = (None, 0) if failed else first_rejecting(t, ordered)
                rows.append((*counts, failed, not failed and stopped is None, stopped, tried))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, _SCHEMA)


def oracle_sql() -> str:
    """The contract's columns for DuckDB: all rules on all texts."""
    blank = r"\x20\x09-\x0D"
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT row, doc_id, t, list_filter(string_split_regex(t, '[{blank}]+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{blank}]')) AS lines FROM texts),
starts AS (SELECT row, words, unnest(range(1, len(words) - 3)) AS i FROM parts),
windows AS (SELECT row, i, count(*) OVER (PARTITION BY row, words[i:i + 4]) AS times FROM starts),
repeated AS (
  SELECT row, count(DISTINCT i + k) AS n FROM windows, (SELECT unnest(range(5)) AS k) WHERE times > 1 GROUP BY row),
counts AS (
  SELECT p.row, doc_id, len(words) AS n_words, length(regexp_replace(t, '[{blank}]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS twins,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters,
    len(list_filter(words, lambda w: NOT regexp_matches(w, '\p{{L}}'))) AS bare,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[{blank}]*$'))) AS trail_lines
  FROM parts p LEFT JOIN repeated r ON r.row = p.row),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
       OR 5 * n_dup_lines > 2 * n_lines OR 10 * twins > 3 * n_words OR 10 * capitals > 6 * letters
       OR 2 * bare > n_words OR 10 * trail_lines > 3 * n_lines) AS kept
FROM based"""
