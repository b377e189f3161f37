"""Benchmark decontamination by spaced-seed hashing.

Texts are compared as words: lower case, split at everything in ASCII that is no letter or digit.  A
mask picks the word positions of a window that count; the others are ignored, so a hash of the
picked words survives substitutions at the ignored ones.  The masks are chosen so that every stretch of
13 words or more, 80 % of them in common, has a window that one of them picks in common words only, and
shorter items have masks that do the same for the whole item.  Test hashes are joined with the hashes of
all windows of all documents.  Around each hit, document and test item are laid over
each other, and the longest stretch with few enough substitutions is the overlap.

The test side goes to every executor in parts of bounded size: a test set beyond
``PART_BYTES`` is searched part by part, each over all documents, and each part's results are
written before the next one goes out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import words as W

#: 1: the word counts; 0: it is ignored.
MASKS = ("1111111", "11011011011", "1010110011101", "1110010111", "110100110101", "1100010100111", "11101100011", "111011011")
MIN_OVERLAP, MIN_SHARE = 13, 0.8
PART_BYTES, FILTER_BITS = 8 << 20, 22
CLASSES = W.byte_classes(bytes(b for b in range(128) if not chr(b).isalnum()), lower=True)


def normal_words(column: pa.Array) -> W.Words:
    return W.split(pc.utf8_lower(column), CLASSES)


def own_masks(n: int) -> list[str]:
    """Masks for the whole of an item of n < MIN_OVERLAP words.

    MIN_SHARE allows k = n // 5 substitutions, none at the ends: of k + 2 groups of the inner words at least two have none, so one of the masks
    that leave out k groups picks common words only.
    """
    k = n // 5
    groups = np.array_split(np.arange(1, n - 1), k + 2)
    return ["".join("0" if any(j in groups[g] for g in out) else "1" for j in range(n)) for out in combinations(range(k + 2), k)]


def masked(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window's picked words; windows are as long as the mask."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(n, 0), W.mix(np.array([len(mask)], np.uint64))[0])
    for j, c in enumerate(mask):
        if c == "1":
            out = out * W._MIX1 + hashes[j : j + len(out)]
    return W.mix(out)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0 .. len(counts) - 1, each as often as counts says, and the number of each copy among its equals."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


class Seeds:
    """The hashes of one mask's windows of items: sorted, with the word of each, and grouped by hash and item."""

    def __init__(self, mask: str, hashes: np.ndarray, word: np.ndarray, item: np.ndarray):
        order = np.lexsort((word, hashes))
        self.mask, hashes, self.word = mask, hashes[order], word[order].astype(np.int32)
        owner = item[self.word]
        first = np.ones(len(hashes), dtype=bool)
        first[1:] = hashes[1:] != hashes[:-1]
        group = first.copy()
        group[1:] |= owner[1:] != owner[:-1]
        self.group = np.flatnonzero(group).astype(np.int32)  # the first seed of each (hash, item); one more at the end
        self.item = owner[self.group]
        self.hashes = hashes[first]
        self.first = np.append(np.searchsorted(self.group, np.flatnonzero(first)), len(self.group)).astype(np.int32)  # the first group of each hash
        self.group = np.append(self.group, np.int32(len(hashes)))
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        bits[self._low(hashes)] = True
        self.bits = np.packbits(bits)

    @staticmethod
    def _low(hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)

    def find(self, words: W.Words, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted (row, hash) groups of windows that seeds share: the windows, the first of each group (one more at the end), and the place of its hash."""
        h = masked(words.hashes, self.mask)
        low = self._low(h)
        at = np.flatnonzero(self.bits[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1)
        at = at[at + len(self.mask) <= words.first[1:][rows[at]]]
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        known = self.hashes[place] == h[at]
        at, place = at[known], place[known]
        order = np.lexsort((at, place, rows[at]))
        at, place = at[order], place[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | (rows[at[1:]] != rows[at[:-1]])
        begin = np.flatnonzero(new)
        return at, np.append(begin, len(at)), place[begin]


class Items:
    """Test items' words, and for each mask the seeds of their windows.

    An item shorter than MIN_OVERLAP words must be found whole and has masks of its own length; one of fewer than least_words words is
    never found.
    """

    def __init__(self, ids: list, words: W.Words, least_words: int = 1):
        self.ids, self.hashes, self.first = ids, words.hashes, words.first
        self.sizes = sizes = np.diff(words.first)
        item, self.seeds = words.rows().astype(np.int32), []
        own = [(m, np.flatnonzero(sizes == n)) for n in range(max(1, least_words), MIN_OVERLAP) for m in own_masks(n)]
        for mask, items in [(m, np.flatnonzero(sizes >= max(MIN_OVERLAP, least_words))) for m in MASKS] + own:
            if len(items):
                which, position = _spread(sizes[items] - len(mask) + 1)
                word = self.first[items][which] + position
                self.seeds.append(Seeds(mask, masked(self.hashes, mask)[word], word, item))

    def hits(self, words: W.Words) -> np.ndarray:
        """Distinct (row, item, shift) of the seeds that a window of the row shares with the item; shift: the row's position less the item's.

        Where a row and an item share so many pairs of windows that the shifts between them are fewer (a word repeated in both), all shifts are
        hits, and the pairs are not gone through.
        """
        found, rows, sizes = [np.zeros((0, 3), np.int64)], words.rows(), np.diff(words.first)
        for seeds in self.seeds:
            if len(words.hashes) < len(seeds.mask):
                continue
            at, begin, place = seeds.find(words, rows)
            if not len(at):
                continue
            which, k = _spread(seeds.first[place + 1] - seeds.first[place])  # groups of windows with items
            group = seeds.first[place[which]] + k
            row, item = rows[at[begin[which]]], seeds.item[group].astype(np.int64)
            left, right = np.diff(begin)[which], seeds.group[group + 1] - seeds.group[group]
            key, pair = np.unique(row * len(self.sizes) + item, return_inverse=True)
            many = np.bincount(pair, left * right.astype(np.float64)) > sizes[key // len(self.sizes)] + self.sizes[key % len(self.sizes)]
            d, i = key[many] // len(self.sizes), key[many] % len(self.sizes)
            one, shift = _spread(sizes[d] + self.sizes[i] - 1)
            found.append(np.stack([d[one], i[one], shift - self.sizes[i[one]] + 1], axis=1))
            few = np.flatnonzero(~many[pair])
            one, j = _spread(left[few] * right[few])
            one, a, b = few[one], j // right[few][one], j % right[few][one]
            window, seed = at[begin[which[one]] + a], seeds.word[seeds.group[group[one]] + b]
            found.append(np.stack([row[one], item[one], window - words.first[row[one]] - (seed - self.first[item[one]])], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def likely(self, words: W.Words, hits: np.ndarray, min_overlap: int, percent: int) -> np.ndarray:
        """The hits whose whole alignment has as many matches as the shortest overlap needs, with these matches: by row and item, most matches first."""
        if not len(hits):
            return np.zeros((0, 4), np.int64)
        row, item, shift = hits.T
        sizes = self.sizes[item]
        a, b = np.maximum(0, -shift), np.minimum(sizes, np.diff(words.first)[row] - shift)
        need = np.minimum(min_overlap, sizes)
        ends, matches = np.cumsum(b - a), np.zeros(len(hits), np.int64)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], 1 << 20)))  # about a million words at a time
        for x, y in zip(cuts, [*cuts[1:], len(hits)], strict=True):
            n = (b - a)[x:y]
            k = np.arange(n.sum()) + np.repeat(a[x:y] - np.cumsum(n) + n, n)
            same = words.hashes[k + np.repeat((words.first[row] + shift)[x:y], n)] == self.hashes[k + np.repeat(self.first[item][x:y], n)]
            matches[x:y] = np.add.reduceat(same, np.cumsum(n) - n, dtype=np.int64)
        out = np.column_stack([hits, matches])[100 * matches >= percent * need]
        return out[np.lexsort((out[:, 2], -out[:, 3], out[:, 1], out[:, 0]))]

    def common(self, doc: np.ndarray, item: int, shift: int) -> tuple[np.ndarray, int]:
        """Which words of the alignment are common, and where it begins in the item."""
        other = self.hashes[self.first[item] : self.first[item + 1]]
        a, b = max(0, -shift), min(len(other), len(doc) - shift)
        return doc[a + shift : b + shift] == other[a:b], a

    @staticmethod
    def overlap(same: np.ndarray, percent: int) -> tuple[int, int, int]:
        """Matches, length and start of the longest stretch that begins and ends with a match and has percent matches."""
        total = np.concatenate([[0], np.cumsum(np.where(same, 100 - percent, -percent))])
        lowest = np.minimum.accumulate(np.where(same, total[:-1], np.iinfo(np.int64).max))
        ends = np.flatnonzero(same) + 1
        starts = np.searchsorted(-lowest, -total[ends])  # the first place that is no higher than the end
        best = int(np.argmax(ends - starts))
        start, end = int(starts[best]), int(ends[best])
        return int(same[start:end].sum()), end - start, start


_OUT = pa.schema([("id", pa.int64()), ("item", pa.int64()), *((c, pa.int64()) for c in ("n_match", "n_overlap", "doc_start", "item_start"))])
_OUT_DDL = "id long, item long, n_match long, n_overlap long, doc_start long, item_start long"


def overlaps(items: Items, column: pa.Array, min_overlap: int, min_share: float) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """(row, item) -> matches, length, and the negative starts, of the overlap with most matches."""
    words, best, percent = normal_words(column), {}, round(100 * min_share)
    pair, seen = None, set()
    for row, item, shift, matches in items.likely(words, items.hits(words), min_overlap, percent).tolist():
        if (row, item) != pair:
            pair, seen = (row, item), set()
        if matches < best.get(pair, (0,))[0]:
            continue  # it can't have more matches than those found
        same, a = items.common(words.hashes[words.first[row] : words.first[row + 1]], item, shift)
        if (pattern := same.tobytes()) in seen:
            continue  # the same stretch, further on
        seen.add(pattern)
        n_match, length, start = items.overlap(same, percent)
        if length >= min(min_overlap, items.sizes[item]):
            best[pair] = max(best.get(pair, (0,)), (n_match, length, -(a + start + shift), -(a + start)))
    return best


def _search(shared, min_overlap: int, min_share: float):
    def search(batches):
        items: Items = shared.value
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                best = overlaps(items, piece.column("text"), min_overlap, min_share)
                if best:
                    ids = piece.column("id")
                    rows = [(ids[r].as_py(), items.ids[i], n, length, -at, -start) for (r, i), (n, length, at, start) in best.items()]
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_OUT)

    return search


def _parts(benchmark: DataFrame, item_col: str, item_text_col: str, least_words: int):
    """The number of parts of about PART_BYTES, and the parts of the test items, each as a broadcast that is made when it is asked for."""
    spark = benchmark.sparkSession
    tests = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    parts = -(-(tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)

    def shared():
        for part in range(parts):
            held = tests.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).orderBy("item", "text").collect()  # about PART_BYTES
            yield spark.sparkContext.broadcast(Items([r.item for r in held], normal_words(pa.array([r.text for r in held], pa.string())), least_words))

    return parts, shared()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_overlap: int = MIN_OVERLAP, min_share: float = MIN_SHARE, least_words: int = 1) -> DataFrame:
    """A row for each document and test item that overlap: id_col, item_col, n_match, n_overlap, doc_start, item_start (in words).

    They overlap when a stretch of at least min_overlap words (or the whole item, if shorter) begins and ends with a common word and
    has min_share (in whole percent) of its words in common.  The stretch with most matches is returned; of equals the longest, then the first.
    None is missed with a min_overlap of MIN_OVERLAP or more and a min_share of MIN_SHARE or more, which the masks are made for.  Items of a few words, which any
    text may hold by chance, are found too, unless least_words leaves out items of fewer words.

    Null and empty texts, and items without words, overlap with nothing.  Rows that repeat an id give one row for each item, as do items that repeat an id; a null
    id is kept as null.  Further columns are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch.tune(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], _OUT_DDL)
    parts, every = _parts(benchmark, item_col, item_text_col, least_words)
    for shared in every:
        found = rows.mapInArrow(_search(shared, min_overlap, min_share), _OUT_DDL)
        if parts > 1:  # so that one part at a time is held
            found = scratch.keep(found, "overlaps")
            shared.unpersist()
        out = out.unionAll(found)
    best = F.max(F.struct("n_match", "n_overlap", (-F.col("doc_start")).alias("a"), (-F.col("item_start")).alias("b"))).alias("best")
    out = out.groupBy("id", "item").agg(best)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.n_match", "best.n_overlap", (-F.col("best.a")).alias("doc_start"), (-F.col("best.b")).alias("item_start"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_overlap: int = MIN_OVERLAP, min_share: float = MIN_SHARE, least_words: int = 1) -> DataFrame:
    """The rows of docs, with all columns, that overlap with no test item, as contaminated() has it.

    Rows are judged by their text alone, so repeated and null ids make no difference; null and empty texts stay.  With one part of test items no row
    moves between executors.  With more, the digests of the texts that a part hits are written, and rows with one of them are left out.
    """
    scratch.tune(docs.sparkSession)
    text, gone = F.col(text_col).cast("string"), None
    parts, every = _parts(benchmark, item_col, item_text_col, least_words)
    for shared in every:
        hit = _hit(shared, min_overlap, min_share)(text)
        if parts == 1:
            return docs.filter(~hit)
        found = scratch.keep(docs.filter(hit).select(F.sha2(text, 256).alias("_digest")).distinct(), "hits")
        shared.unpersist()
        gone = found if gone is None else gone.unionAll(found)
    return docs if gone is None else docs.join(gone, F.sha2(text, 256) == F.col("_digest"), "left_anti")


def _hit(shared, min_overlap: int, min_share: float):
    @F.arrow_udf("boolean")
    def hit(texts: pa.Array) -> pa.Array:
        found = [np.zeros(0, dtype=bool)]
        for piece in W.pieces(pa.record_batch([texts], names=["text"]), "text"):
            flags = np.zeros(piece.num_rows, dtype=bool)
            flags[[r for r, _ in overlaps(shared.value, piece.column("text"), min_overlap, min_share)]] = True
            found.append(flags)
        return pa.array(np.concatenate(found))

    return hit
