"""Substring dedup by seed and extend.

A passage of ``min_words`` words that also starts in a document with a smaller
id is removed.  Every passage of that length contains exactly one *anchor*: the
``seed_words``-word seed with the smallest hash in it (winnowing).  Equal passages
have equal anchors, so

1. documents are joined on anchors: an anchor held by one document only can be
   ruled out with everything around it;
2. around each shared anchor the match is extended to both sides, to every
   passage whose anchor it is; passages are joined on their 80-bit hash, which
   gives the smallest document that holds each;
3. overlapping and adjacent matches are united, which gives the maximal repeats;
   their words are removed.

No pair of documents is ever formed.  Documents are packed into blocks of about
1 MB of text; a block asks each key once however many of its documents hold it,
and sends sorted keys to shards of hash space.  A shard answers with an array
aligned with the question (one bit an anchor, one id a passage), so a passage
held by a third of all documents costs one key per block.  Shards grow in number
with the input and each holds a bounded number of keys.  Blocks are shuffled once:
both joins of blocks with answers reuse that exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, scratch
from . import words as W

MIN_WORDS, SEED_WORDS = 13, 5
SHARD_BYTES = 16 << 20
_LOW40 = np.uint64((1 << 40) - 1)
_SECOND = np.uint64(0xD6E8FEB86659FD93)


class Block:
    """A block's documents, words and passages."""

    def __init__(self, payload: bytes, n: int, k: int):
        self.rows = blocks.unpack(payload)
        self.ids, self.text = self.rows.column("id"), self.rows.column("text")
        self.words = W.split(self.text)
        known = np.asarray(self.ids.is_valid(), dtype=bool)
        self.doc = np.asarray(self.ids.fill_null(0), dtype=np.int64)
        self.n, rows = n, self.words.rows()
        seed, _ = W.grams(self.words, k)
        _, inside = W.grams(self.words, n)
        self.at = np.flatnonzero(inside & known[rows])
        self.owner = self.doc[rows[self.at]]
        if len(self.at):
            near = np.lib.stride_tricks.sliding_window_view(seed, n - k + 1)
            self.anchor = seed[near[self.at].argmin(axis=1) + self.at]
        else:
            self.anchor = np.zeros(0, np.uint64)

    def anchors(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys (shard, 40 bits), whether two documents of the block hold each, and each passage's key."""
        key = ((self.anchor >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32) << np.uint64(40)) | (self.anchor & _LOW40)
        keys, inverse = np.unique(key, return_inverse=True)
        low, high = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, self.owner)
        np.maximum.at(high, inverse, self.owner)
        return keys, low != high, inverse

    def passages(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct passages of the chosen ones (64 and 64 bits), the smallest document of each, and each chosen one's place."""
        at, h = self.at[chosen], self.words.hashes
        one, two = h[at].copy(), h[at].copy()
        for j in range(1, self.n):
            one = one * W._MIX1 + h[at + j]
            two = two * _SECOND + (h[at + j] >> np.uint64(7))
        one, two, owner = W.mix(one), W.mix(two), self.owner[chosen]
        order = np.lexsort((owner, two, one))
        one, two, owner = one[order], two[order], owner[order]
        new = np.ones(len(one), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        place = np.empty(len(one), np.int64)
        place[order] = np.cumsum(new) - 1
        return one[new], two[new], owner[new], place


def _shared(answers: list[bytes], keys: np.ndarray) -> np.ndarray:
    """One bit for each key, from the shards' bitmaps."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    _, counts = np.unique(keys >> np.uint64(40), return_counts=True)
    return np.concatenate([np.unpackbits(np.frombuffer(a, np.uint8), count=c) for a, c in zip(answers, counts, strict=True)]).astype(bool)


def _ask_anchors(n: int, k: int, shards: int):
    def ask(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                keys, several, _ = Block(payload.as_py(), n, k).anchors(shards)
                shard, at = np.unique(keys >> np.uint64(40), return_index=True)
                raw = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :5]
                spans = list(zip(at, np.append(at, len(keys))[1:], strict=True))
                yield blocks.table(blocks.ASK, [[block] * len(spans), shard, [raw[a:b].tobytes() for a, b in spans], [np.packbits(several[a:b]).tobytes() for a, b in spans]])

    return ask


def _answer_anchors(table: pa.Table) -> pa.Table:
    """Which anchors of each question at least two documents hold."""
    raw = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, 5) for x in table.column("keys")]
    sizes = [len(x) for x in raw]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :5] = np.concatenate(raw)
    keys = wide.view(np.uint64).ravel()
    several = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=c) for x, c in zip(table.column("extra"), sizes, strict=True)])
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    begin = np.flatnonzero(new)
    shared = (np.diff([*begin, len(keys)]) > 1) | (np.add.reduceat(several[order], begin) > 0)
    out = np.empty(len(keys), dtype=bool)
    out[order] = shared[np.cumsum(new) - 1]
    answers = [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]
    m = table.num_rows
    return pa.Table.from_batches([blocks.table(blocks.ANSWER, [table.column("block").to_pylist(), [0] * m, table.column("shard").to_pylist(), answers])])


def _ask_passages(n: int, k: int, shards: int):
    def ask(batches):
        for batch in batches:
            for block, payload, rows in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("answers"), strict=True):
                found = Block(payload.as_py(), n, k)
                keys, _, inverse = found.anchors(shards)
                one, two, owner, _ = found.passages(_shared(blocks.answers(rows.as_py(), 0), keys)[inverse])
                shard, at = np.unique((one >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), return_index=True)
                spans = list(zip(at, np.append(at, len(one))[1:], strict=True))
                keys = [one[a:b].tobytes() + two[a:b].tobytes() for a, b in spans]
                yield blocks.table(blocks.ASK, [[block] * len(spans), shard, keys, [blocks.zipped(owner[a:b]) for a, b in spans]])

    return ask


def _answer_passages(table: pa.Table) -> pa.Table:
    """The smallest document that holds each passage of each question."""
    one, two, owner, sizes = [], [], [], []
    for keys, extra in zip(table.column("keys"), table.column("extra"), strict=True):
        raw = keys.as_py()
        c = len(raw) // 16
        sizes.append(c)
        one.append(np.frombuffer(raw, np.uint64, c))
        two.append(np.frombuffer(raw, np.uint64, c, 8 * c))
        owner.append(blocks.unzip([extra.as_py()]))
    one, two, owner = np.concatenate(one), np.concatenate(two), np.concatenate(owner)
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = np.minimum.reduceat(owner[order], np.flatnonzero(new))
    out = np.empty(len(a), np.int64)
    out[order] = least[np.cumsum(new) - 1]
    answers = [blocks.zipped(x) for x in np.split(out, np.cumsum(sizes)[:-1])]
    m = table.num_rows
    return pa.Table.from_batches([blocks.table(blocks.ANSWER, [table.column("block").to_pylist(), [1] * m, table.column("shard").to_pylist(), answers])])


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))


def _remove(n: int, k: int, shards: int):
    def remove(batches):
        for batch in batches:
            for payload, rows in zip(batch.column("payload"), batch.column("answers"), strict=True):
                found, rows = Block(payload.as_py(), n, k), rows.as_py()
                keys, _, inverse = found.anchors(shards)
                chosen = _shared(blocks.answers(rows, 0), keys)[inverse]
                _, _, _, place = found.passages(chosen)
                earlier = blocks.unzip(blocks.answers(rows, 1))[place] < found.owner[chosen]
                starts = found.at[chosen][earlier]
                step = np.zeros(len(found.words.hashes) + 1, np.int64)
                np.add.at(step, starts, 1)
                np.add.at(step, starts + n, -1)
                covered = np.cumsum(step[:-1]) > 0
                yield from _results(found, covered)

    return remove


def _results(found: Block, covered: np.ndarray) -> Iterator[pa.RecordBatch]:
    first = found.words.first
    sums = np.concatenate([[0], np.cumsum(covered)])
    removed = sums[first[1:]] - sums[first[:-1]]
    texts, spans = [], []
    for r, text in enumerate(found.text.to_pylist()):
        parts, gone = (text or "").encode().split(), []
        if removed[r]:
            here = covered[first[r] : first[r + 1]]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], here.astype(np.int8), [0]])))
            gone = [{"start": int(a), "length": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            parts = [parts[i] for i in np.flatnonzero(~here)]
        texts.append(b" ".join(parts).decode())
        spans.append(gone)
    yield pa.record_batch({"id": found.ids, "rest": found.rows.column("rest"), "n_words": pa.array(np.diff(first), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "removed": pa.array(spans, _SPAN), "kept_text": pa.array(texts, pa.string())})


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS) -> DataFrame:
    """Remove from each document every word of a passage of min_words words that also starts in a document with a smaller id.

    Returns a row for each input row: id_col, rest (its other columns), n_words, n_removed, removed (the maximal repeats, as word
    spans) and kept_text (the other words, joined by one space).  Words are what white space separates, unchanged.

    A null or empty text has no words.  Rows of one id count as one document, so they never remove from each other.
    A row with a null id keeps all its words and is no source for others.
    """
    if not 1 <= seed_words <= min_words:
        raise ValueError("seed_words must lie between 1 and min_words")
    spark = docs.sparkSession
    scratch.tune(spark)
    packed = scratch.keep(blocks.pack(docs, id_col, text_col), "blocks")
    total = packed.agg(F.sum("bytes")).first()[0] or 0
    shards, n, k = scratch.shards(total, SHARD_BYTES), min_words, seed_words
    payload = packed.select("block", "payload")
    shared = payload.mapInArrow(_ask_anchors(n, k, shards), blocks.ASK_DDL).groupBy("shard").applyInArrow(_answer_anchors, blocks.ANSWER_DDL)
    least = blocks.answered(payload, shared).mapInArrow(_ask_passages(n, k, shards), blocks.ASK_DDL).groupBy("shard").applyInArrow(_answer_passages, blocks.ANSWER_DDL)
    out = blocks.answered(payload, shared.unionAll(least)).mapInArrow(_remove(n, k, shards), f"id long, rest {blocks.rest_type(docs, id_col, text_col)}, n_words long, n_removed long, removed array<struct<start: int, length: int>>, kept_text string")
    return out.withColumnRenamed("id", id_col)
