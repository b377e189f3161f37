"""Token counts under a unigram model, with the forward scores of shared prefixes computed once.

A text is split into pre-tokens at white space; each gets the mark of a word's beginning.  The
distinct pre-tokens of a batch go into a trie, and each trie node gets the best score of any
segmentation of its prefix: the maximum, over the pieces that end there, of the score of the
node before the piece plus the piece's score.  A node at which a pre-token ends stores its number of tokens.
All nodes of a level are computed together.

The scores are logarithms of probabilities that add up to one.  :func:`rank_scores` makes them for a vocabulary that is ordered by
frequency, as BPE vocabularies are: the probability of a piece falls with its rank by Zipf's law.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import words as W

MARK, UNITS, ZIPF_SHIFT = "▁", 1 << 16, 2.7
_BASE = W._BASE


class Unigram:
    """Pieces with log-probabilities, kept as whole numbers of 1 / UNITS.

    A code point that is no piece itself is as many tokens as UTF-8 needs bytes for it, each less likely than all pieces by a factor of
    exp(10).  Of segmentations with equal scores the one with fewer tokens counts.
    """

    def __init__(self, scores: dict[str, float]):
        if not scores:
            raise ValueError("the vocabulary is empty")
        self.scores, self.longest = {p: round(UNITS * s) for p, s in scores.items()}, max(map(len, scores))
        self.byte = min(self.scores.values()) - 10 * UNITS
        sizes = np.array([len(p) for p in scores])
        first = np.concatenate([[0], np.cumsum(sizes)])
        hashes = self._spans(self._sums(_points("".join(scores))), first[:-1], sizes)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], np.array(list(self.scores.values()), np.int64)[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    @staticmethod
    def _sums(points: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(points.astype(np.uint64)) * W.powers(_BASE, len(points)), dtype=np.uint64)])

    @staticmethod
    def _spans(sums: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A hash of the code points of each span."""
        return W.mix((sums[start + size] - sums[start]) * W.powers(W._BASE_INVERSE, len(sums))[start])

    def count(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The number of tokens of each word: code points, and the first of each word (one more at the end)."""
        sizes = np.diff(first)
        out = np.zeros(len(sizes), np.int64)
        if not len(points):
            return out
        sums = self._sums(points)
        word = np.repeat(np.arange(len(sizes)), sizes)
        start = first[:-1][word]
        level = np.arange(len(points)) - start + 1
        # the trie's nodes are the distinct prefixes, ordered by level; node 0 is the root
        _, at, node = np.unique(self._spans(sums, start, level), return_index=True, return_inverse=True)
        order = np.argsort(level[at], kind="stable")
        at, place = at[order], np.empty(len(at), np.int64)
        place[order] = np.arange(1, len(at) + 1)
        node = place[node]
        # an edge for each piece that ends at a node
        ends = [np.arange(len(at))]
        begins = [np.where(level[at] > 1, node[at - 1], 0)]
        n = np.array([1, 2, 3, 4])[np.searchsorted(np.array([0x80, 0x800, 0x10000]), points[at], side="right")]
        values, tokens = [n * self.byte], [n]
        here = np.arange(len(at))
        for size in range(1, self.longest + 1):
            here = here[level[at[here]] >= size]
            h = self._spans(sums, at[here] - size + 1, np.int64(size))
            maybe = np.flatnonzero(self.bits[(h >> np.uint64(44)).astype(np.int64)])
            found = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            same = self.hashes[found] == h[maybe]
            end = here[maybe[same]]
            ends.append(end)
            begins.append(np.where(level[at[end]] > size, node[at[end] - size], 0))
            values.append(self.values[found[same]])
            tokens.append(np.ones(len(end), np.int64))
        end, begin, value, token = map(np.concatenate, (ends, begins, values, tokens))
        order = np.argsort(end, kind="stable")
        end, begin, value, token = end[order], begin[order], value[order], token[order]
        edge = np.searchsorted(end, np.arange(len(at) + 1))  # the first edge of each node
        deep = level[at]
        cuts = np.searchsorted(deep, np.arange(1, int(deep[-1]) + 2))
        best, fewest = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            x, y = edge[a], edge[b]
            score = best[begin[x:y]] + value[x:y]
            if b == a + 1:  # the tail of a long word
                best[b] = top = score.max()
                fewest[b] = (fewest[begin[x:y]] + token[x:y])[score == top].min()
                continue
            from_first = edge[a:b] - x
            top = np.maximum.reduceat(score, from_first)
            best[a + 1 : b + 1] = top
            less = np.where(score == np.repeat(top, np.diff(np.append(from_first, y - x))), fewest[begin[x:y]] + token[x:y], np.iinfo(np.int64).max)
            fewest[a + 1 : b + 1] = np.minimum.reduceat(less, from_first)
        some = np.flatnonzero(sizes)
        out[some] = fewest[node[first[1:][some] - 1]]
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def rank_scores(pieces: list[str], shift: float = ZIPF_SHIFT) -> dict[str, float]:
    """Log-probabilities of pieces that are ordered by frequency: by the law of Zipf and Mandelbrot, 1 / (rank + shift), adding up to one."""
    weight = 1 / (np.arange(1, len(pieces) + 1) + shift)
    return dict(zip(pieces, np.log(weight / weight.sum()).tolist(), strict=True))


def load_pieces(path: str) -> list[str]:
    """Pieces of a SentencePiece model file, those with the highest score first, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return [model.id_to_piece(i) for i in sorted(every, key=lambda i: (-model.get_score(i), i))]


_OUT = pa.schema([("id", pa.int64()), ("n_pre_tokens", pa.int64()), ("n_tokens", pa.int64())])


def counts_of(column: pa.Array, model: Unigram) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens and tokens of each row."""
    words = W.split(column)
    _, at, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    starts, ends = words.starts[at], words.ends[at]
    sizes = ends - starts
    inside = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else starts, sizes) + np.arange(sizes.sum())
    raw = words.data[inside]
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    chars = W.code_points_before(raw)
    first = chars[np.concatenate([[0], np.cumsum(sizes)])]
    marked = np.insert(points, first[:-1], ord(MARK)) if len(sizes) else points
    first = first + np.arange(len(first))
    tokens = model.count(marked, first)
    return np.diff(words.first), W.sums_by_row(tokens[inverse], words.first)


def count_tokens(docs: DataFrame, scores: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_pre_tokens and n_tokens for each input row.

    scores are log-probabilities of pieces.  They go to every executor; there must be at most a million.  A null or empty text has no tokens.  Rows are
    counted one by one, so repeated rows, null ids and further columns make no difference.
    """
    if len(scores) > 1_000_000:
        raise ValueError("the vocabulary has more than a million pieces")
    spark = docs.sparkSession
    scratch.tune(spark)
    shared = spark.sparkContext.broadcast(Unigram(scores))

    def count(batches):
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                n, tokens = counts_of(piece.column("text"), shared.value)
                yield pa.record_batch([piece.column("id"), pa.array(n, pa.int64()), pa.array(tokens, pa.int64())], schema=_OUT)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "id long, n_pre_tokens long, n_tokens long").withColumnRenamed("id", id_col)
