"""Quality rules: repeated passages inside a document, found with a suffix array over its words.

The texts of a block are laid side by side as word numbers, a separator after each. A suffix array is sorted by prefix
doubling; only suffixes that still share their prefix with another of the same text are sorted again, so clean text
costs two or three passes. The longest common prefix with the neighbours in the array is the depth of the deepest
longest-common-prefix interval of a place: the longest substring that starts there and occurs elsewhere in the text. Those
that can't be extended to the left are the maximal repeated substrings; their spans are joined, and the rules limit the
covered share of the words and the longest repeat.

A text is judged on its own, so nothing is shuffled and a hot source or a group of copies weighs no more than its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from aligngrid.llm.common import blocks, python_map, table, texts_of, words_of

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
           ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
           ("n_repeats", pa.int64()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64())]
RULE_COLUMNS = [name for name, _ in _FIELDS]


def suffix_array(symbols: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of `symbols` within each text and the common prefix of neighbours in it.

    The last symbol of each text must occur nowhere else. Suffixes of different texts share nothing (0).
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = text_of * (int(symbols.max()) + 1) + symbols
    sa = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[sa], prepend=key[sa[0]] - 1))
    size = np.diff(first, append=n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(first, size)
    levels = [(1, rank)]
    open_at = np.flatnonzero(np.repeat(size > 1, size))  # places of the array whose suffixes are still tied
    h = 1
    while len(open_at):
        at = sa[open_at]
        key = rank[at] * (n + 1) + rank[at + h]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[open_at] = at
        first = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
        size = np.diff(first, append=len(at))
        rank = rank.copy()
        rank[at] = np.repeat(open_at[first], size)
        h *= 2
        levels.append((h, rank))
        open_at = open_at[np.repeat(size > 1, size)]
    lcp = np.zeros(n, np.int64)
    near = 1 + np.flatnonzero(levels[0][1][sa[1:]] == levels[0][1][sa[:-1]])
    a, b, common = sa[near - 1], sa[near], np.zeros(len(near), np.int64)
    for h, rank in reversed(levels):
        same = rank[np.minimum(a + common, n - 1)] == rank[np.minimum(b + common, n - 1)]
        common += h * same
    lcp[near] = common
    return sa, lcp


def longest_repeats(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word: the length of the longest repeat that starts there, and the text it is in."""
    texts = len(counts)
    text_of = np.repeat(np.arange(texts), counts + 1)
    ends = np.cumsum(counts + 1) - 1
    symbols = np.zeros(len(text_of), np.int64)
    inner = np.ones(len(text_of), bool)
    inner[ends] = False
    symbols[inner] = codes + 1  # 0 is the separator, one in each text
    sa, lcp = suffix_array(symbols, text_of)
    longest = np.zeros(len(symbols), np.int64)
    if len(sa):
        longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return longest[inner], text_of[inner]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the spans."""
    delta = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(delta)[:n] > 0


def measure(texts: list[bytes], min_repeat: int, max_covered: float, max_longest: int) -> list[np.ndarray]:
    """The values of RULE_COLUMNS for each text."""
    _, codes, n_words = words_of(texts)
    longest, text_of = longest_repeats(codes, n_words)
    n, m = len(codes), len(texts)
    per_text = lambda mask: np.bincount(text_of[mask], minlength=m)
    windows = np.flatnonzero(longest >= WINDOW)
    n_repeat = per_text(covered(windows, np.full(len(windows), WINDOW), n))
    text_start = np.diff(text_of, prepend=-1) != 0
    before = np.append(0, longest[:-1])[:n] if n else longest
    maximal = np.flatnonzero((longest >= min_repeat) & (text_start | (before != longest + 1)))
    n_covered = per_text(covered(maximal, longest[maximal], n))
    longest_in = np.zeros(m, np.int64)
    np.maximum.at(longest_in, text_of[maximal], longest[maximal])
    chars = np.array([len(t.translate(None, _SPACE + _CONTINUATION)) for t in texts], np.int64)
    symbols = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    dup_lines = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    kept = ~failed & (n_covered <= max_covered * n_words) & (longest_in <= max_longest)
    return [n_words, chars, symbols, dup_lines, n_repeat, failed, kept, per_text_counts(maximal, text_of, m), n_covered,
            longest_in]


def per_text_counts(places: np.ndarray, text_of: np.ndarray, m: int) -> np.ndarray:
    return np.bincount(text_of[places], minlength=m)


def repetition_rules(df: DataFrame, text: str = "text", *, min_repeat: int = 8, max_covered: float = 0.2,
                     max_longest: int = 60) -> DataFrame:
    """Every row of `df` with RULE_COLUMNS beside its own columns.

    A repeat counts for the rules from `min_repeat` words; `kept` is false if a base rule fails, more than the share
    `max_covered` of the words lies in repeats, or a repeat is longer than `max_longest` words.

    Null and empty texts have no words and fail; equal rows are judged alike; an empty table gives an empty result;
    columns of `df` that bear a name of RULE_COLUMNS are replaced.
    """
    own = df.drop(*RULE_COLUMNS)
    fields = list(own.schema.fields)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + [f"{n} {'boolean' if t == pa.bool_() else 'bigint'}" for n, t in _FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            values = measure(texts_of(block, text), min_repeat, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays(
                [*block.columns, *(pa.array(v, t) for v, (_, t) in zip(values, _FIELDS))],
                names=[*block.schema.names, *RULE_COLUMNS])

    return python_map(own, run, schema)


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    out = repetition_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *RULE_COLUMNS)


QUERIES = {"op5_repetition": op5_repetition}
