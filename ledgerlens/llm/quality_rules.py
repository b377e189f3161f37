"""Quality rules on one document's text, with repetition found by a suffix array over its words.

The suffix array comes from prefix doubling, for all documents of a batch at once: suffixes are
ranked by their first 1, 2, 4, ... words, and only those that still share a rank are sorted again.
Neighbours in the array with the longest common prefixes span the LCP intervals; an
interval of at least ``min_repeat`` words is a maximal repeated substring.  A suffix lies in the
deepest interval given by the longer of its two neighbour prefixes, so the union of all repeats'
spans is the union of those.  A document is kept when that union covers a small
enough part of it and no repeat is too long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import words as W

MIN_REPEAT, MAX_COVERED_PERCENT, MAX_LONGEST = 8, 30, 100
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def suffix_array(symbols: np.ndarray, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions in the order of (row, symbols from there to the row's end); rows are ascending, ends give each position's row end."""
    n = len(symbols)
    order = np.lexsort((symbols, rows))
    new = np.ones(n, dtype=bool)
    new[1:] = (symbols[order][1:] != symbols[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if n else 0
    shared = np.zeros(n, dtype=bool)
    shared[:-1] |= ~new[1:]
    shared[1:] |= ~new[1:]
    active, h = order[shared], 1
    while len(active):
        after = active + h
        second = np.where(after < ends[active], rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        old = rank[active]
        group = np.ones(len(active), dtype=bool)
        group[1:] = old[1:] != old[:-1]
        new = group.copy()
        new[1:] |= second[1:] != second[:-1]
        index = np.arange(len(active))
        offset = index - np.flatnonzero(group)[np.cumsum(group) - 1]
        rank[active] = old + offset[np.flatnonzero(new)[np.cumsum(new) - 1]]
        alone = new.copy()
        alone[:-1] &= new[1:]
        active, h = active[~alone], 2 * h
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def repeats(words: W.Words, min_repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word position, the length of the longest repeat of at least min_repeat words that starts there (or 0); whether a repeat covers it."""
    n, rows = len(words.hashes), words.rows()
    length, covered = np.zeros(n, np.int64), np.zeros(n, dtype=bool)
    if n < 2:
        return length, covered
    ends = words.first[1:][rows]
    order = suffix_array(words.hashes, rows, ends)
    gram, inside = W.grams(words, min_repeat)
    a, b = order[:-1], order[1:]
    near = (rows[a] == rows[b]) & inside[a] & inside[b] & (gram[a] == gram[b])
    a, b = a[near], b[near]
    if not len(a):
        return length, covered
    base = W._BASE
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hashes * W.powers(base, n), out=sums[1:])
    inverse = W.powers(W._BASE_INVERSE, n + 1)
    low, high = np.full(len(a), min_repeat), ends[a] - np.maximum(a, b)  # the shorter suffix
    high = np.maximum(np.minimum(ends[a] - a, ends[b] - b), low)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = (sums[a + mid] - sums[a]) * inverse[a] == (sums[b + mid] - sums[b]) * inverse[b]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    np.maximum.at(length, a, low)
    np.maximum.at(length, b, low)
    at = np.flatnonzero(length)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length[at], -1)
    return length, np.cumsum(step[:-1]) > 0


def repeated_windows(words: W.Words, n: int) -> np.ndarray:
    """Whether a window of n words that its row holds twice or more covers each word."""
    gram, inside = W.grams(words, n)
    at, rows = np.flatnonzero(inside), words.rows()
    order = at[np.lexsort((gram[at], rows[at]))]
    same = (gram[order][1:] == gram[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    step = np.zeros(len(gram) + 1, np.int64)
    np.add.at(step, order[twice], 1)
    np.add.at(step, order[twice] + n, -1)
    return np.cumsum(step[:-1]) > 0


def _duplicate_lines(data: np.ndarray, at: np.ndarray, words: W.Words) -> np.ndarray:
    lines = W.line_spans(data, at)
    full = np.searchsorted(words.starts, lines.begin) < np.searchsorted(words.starts, lines.end)
    row = np.repeat(np.arange(len(at) - 1), np.diff(lines.first))[full]
    h = W.hash_spans(data, W.PLAIN[1], lines.begin[full], lines.end[full])
    order = np.lexsort((h, row))
    again = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][1:][again], minlength=len(at) - 1)


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]
_OUT = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in _COUNTS)])


def _measure(min_repeat: int):
    def measure(batches):
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                data, at = W.buffers(piece.column("text"))
                words = W.split(piece.column("text"))
                chars = W.code_points_before(data)
                length, covered = repeats(words, min_repeat)
                longest = np.zeros(len(at) - 1, np.int64)
                np.maximum.at(longest, words.rows(), length)
                columns = [
                    np.diff(words.first),
                    W.sums_by_row(chars[words.ends] - chars[words.starts], words.first),
                    W.sums_by_row(_IS_SYMBOL[data], at),
                    _duplicate_lines(data, at, words),
                    W.sums_by_row(repeated_windows(words, 3), words.first),
                    W.sums_by_row(covered, words.first),
                    longest,
                ]
                yield pa.record_batch([piece.column("id"), *(pa.array(c, pa.int64()) for c in columns)], schema=_OUT)

    return measure


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT, max_covered_percent: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST) -> DataFrame:
    """id_col, the counts of _COUNTS, base_failed and kept for each input row.

    base_failed: fewer than 50 words, or more than half of them in three-word windows that the text holds twice or more.
    kept: not base_failed, at most max_covered_percent of the words in repeats of at least min_repeat words, and no repeat longer
    than max_longest words.

    A null or empty text has no words: all counts are 0 and it is not kept.  Rows are judged one by one, so repeated rows, null ids
    and further columns make no difference.
    """
    scratch.tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(_measure(min_repeat), ", ".join(f"{f.name} long" for f in _OUT))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~failed & (100 * F.col("n_covered_words") <= max_covered_percent * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return out.withColumnRenamed("id", id_col).withColumns({"base_failed": failed, "kept": kept})
