"""Line dedup with sharded cuckoo filters over exact reference-count tables.

A line's key is its text without white space at the ends and with A-Z lower-cased,
known by 128 bits.  Blocks of documents report their distinct keys to shards of
hash space, each with the number of documents that hold it and the smallest one.  A shard keeps

* a cuckoo filter of the keys it has seen, and
* a reference table: for each key the blocks that hold it, with the exact number of documents and the smallest one of each block.

A key that the filter rules out is new and goes straight into both; only the others
are looked up in the table.  Removing documents takes their block's entries back and puts those of the documents that are left in their place; a
key without entries leaves the table and the filter, so a deletion undoes an insertion, and its work grows with the blocks that it
touches and not with the corpus.  A line is dropped where the smallest holder of its key is another, smaller document.

:class:`LineIndex` keeps the shards between batches.  :func:`dedup_lines` is one batch
on an empty index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, scratch
from . import words as W
from .cuckoo import CuckooFilter

MIN_CHARS, SHARD_BYTES = 10, 16 << 20
_SECOND = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND[65:91] = _SECOND[97:123]
_KEY = np.dtype([("a", "<u8"), ("b", "<u8")])


class Lines:
    """The lines of a block's documents; chosen: those with a key, which keys, holders and inverse are about."""

    def __init__(self, payload: bytes, min_chars: int):
        self.rows = blocks.unpack(payload)
        self.ids, self.text = self.rows.column("id"), self.rows.column("text")
        self.data, at = W.buffers(self.text)
        lines = W.line_spans(self.data, at)
        self.begin, self.end, self.first, self.n_lines = lines.begin, lines.end, lines.first, np.diff(lines.first)
        words = W.split(self.text, W.LOWER)
        a, b = np.searchsorted(words.starts, self.begin), np.searchsorted(words.starts, self.end) - 1
        full = a <= b
        chars = W.code_points_before(self.data)
        known = np.repeat(np.asarray(self.ids.is_valid(), dtype=bool), self.n_lines)
        at = np.flatnonzero(full & known)
        s, e = words.starts[a[at]], words.ends[b[at]]
        long = chars[e] - chars[s] >= min_chars
        self.chosen, s, e = at[long], s[long], e[long]
        self.owner = np.repeat(np.asarray(self.ids.fill_null(0), dtype=np.int64), self.n_lines)[self.chosen]
        self.hash = np.empty(len(s), _KEY)
        self.hash["a"], self.hash["b"] = W.hash_spans(self.data, W.LOWER[1], s, e), W.hash_spans(self.data, _SECOND, s, e)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys, the number of documents and the smallest document that hold each, and the key of each chosen line."""
        order = np.lexsort((self.owner, self.hash["b"], self.hash["a"]))
        h, owner = self.hash[order], self.owner[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        other = new.copy()
        other[1:] |= owner[1:] != owner[:-1]
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(new) - 1
        return h[new], np.add.reduceat(other, np.flatnonzero(new)).astype(np.int64) if len(h) else np.zeros(0, np.int64), owner[new], inverse


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys["a"] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _report(min_chars: int, shards: int):
    """Blocks' questions: 16-byte keys; extra: the counts, then the smallest holders."""

    def report(batches):
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                keys, counts, least, _ = Lines(payload.as_py(), min_chars).keys()
                shard, at = np.unique(_shard(keys, shards), return_index=True)
                spans = list(zip(at, np.append(at, len(keys))[1:], strict=True))
                extra = [blocks.zipped(np.concatenate([counts[a:b], least[a:b]])) for a, b in spans]
                yield blocks.table(blocks.ASK, [[block] * len(spans), shard, [keys[a:b].tobytes() for a, b in spans], extra])

    return report


class Entries:
    """Keys with a block, the number of its documents that hold the key, and the smallest of them; sorted by key and block."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        order = np.lexsort((numbers[0], keys["b"], keys["a"]))
        self.keys, self.numbers = keys[order], numbers[:, order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (self.keys["a"][1:] != self.keys["a"][:-1]) | (self.keys["b"][1:] != self.keys["b"][:-1])
        self.first = np.flatnonzero(new)

    def distinct(self) -> np.ndarray:
        return self.keys[self.first]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among the distinct ones; -1 if it isn't there."""
        a, b = self.keys["a"][self.first], self.keys["b"][self.first]
        if not len(a):
            return np.full(len(keys), -1)
        at = np.searchsorted(a, keys["a"])
        inside = lambda at: np.minimum(at, len(a) - 1)
        while len(on := np.flatnonzero((at < len(a)) & (a[inside(at)] == keys["a"]) & (b[inside(at)] < keys["b"]))):
            at[on] += 1  # two keys with equal first halves
        return np.where((at < len(a)) & (a[inside(at)] == keys["a"]) & (b[inside(at)] == keys["b"]), at, -1)


class Shard:
    """A shard's filter and reference table.  The filter works on the second halves of keys: the first choose the shard."""

    def __init__(self, capacity: int):
        self.filter, self.table = CuckooFilter(capacity), Entries(np.zeros(0, _KEY), np.zeros((3, 0), np.int64))

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """New entries; numbers: blocks, counts and smallest holders."""
        distinct = Entries(keys, numbers).distinct()
        known = self.filter.contains(distinct["b"])
        known[known] = self.table.places(distinct[known]) >= 0  # only these are looked up
        size = len(self.table.first) + int((~known).sum())
        if size > self.filter.slots.size * 0.9:  # too small by now
            self.filter = CuckooFilter(2 * size)
            self.filter.insert(self.table.distinct()["b"])
        self.filter.insert(distinct["b"][~known])
        self.table = Entries(np.concatenate([self.table.keys, keys]), np.concatenate([self.table.numbers, numbers], axis=1))

    def remove(self, keys: np.ndarray, block: np.ndarray) -> None:
        """Take back the entries of these keys and blocks.  Keys without any left go."""
        old, place = self.table, np.repeat(np.arange(len(self.table.first)), np.diff(np.append(self.table.first, len(self.table.keys))))
        gone = self.table.places(keys)
        numbers, n = np.unique(np.concatenate([old.numbers[0], block]), return_inverse=True)
        stay = ~np.isin(place * len(numbers) + n[: len(place)], (gone * len(numbers) + n[len(place) :])[gone >= 0])
        self.table = Entries(old.keys[stay], old.numbers[:, stay])
        before = old.distinct()
        self.filter.delete(before["b"][self.table.places(before) < 0])

    def least(self, keys: np.ndarray) -> np.ndarray:
        """The smallest holder of each key, all of which are in the table."""
        each = np.minimum.reduceat(self.table.numbers[2], self.table.first) if len(self.table.first) else np.zeros(0, np.int64)
        return each[self.table.places(keys)]

    def to_row(self, shard: int) -> dict:
        return {"shard": shard, "filter": self.filter.to_bytes(), "keys": self.table.keys.tobytes(), "numbers": blocks.zipped(self.table.numbers.ravel())}

    @classmethod
    def from_row(cls, row: dict) -> Shard:
        out = cls(0)
        out.filter, out.table = CuckooFilter.from_bytes(row["filter"]), Entries(np.frombuffer(row["keys"], _KEY), blocks.unzip([row["numbers"]]).reshape(3, -1))
        return out


def _questions(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """The keys of each question, and the numbers of all: blocks, counts and smallest holders."""
    keys = [np.frombuffer(x.as_py(), _KEY) for x in table.column("keys")]
    numbers = [np.stack([np.full(len(k), b), *np.split(blocks.unzip([x.as_py()]), 2)]) for k, b, x in zip(keys, table.column("block").to_pylist(), table.column("extra"), strict=True)]
    return keys, np.concatenate([np.zeros((3, 0), np.int64), *numbers], axis=1)


def _all(keys: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, _KEY), *keys])


def _answers(shard: Shard, table: pa.Table, keys: list[np.ndarray]) -> pa.Table:
    m, least = table.num_rows, shard.least(_all(keys))
    parts = np.split(least, np.cumsum([len(k) for k in keys])[:-1]) if keys else []
    return pa.Table.from_batches([blocks.table(blocks.ANSWER, [table.column("block").to_pylist(), [0] * m, table.column("shard").to_pylist(), [blocks.zipped(x) for x in parts]])])


def _answer(table: pa.Table) -> pa.Table:
    """The smallest holder of each key of each question, from a shard that is filled with all of them."""
    keys, numbers = _questions(table)
    shard = Shard(numbers.shape[1])
    shard.add(_all(keys), numbers)
    return _answers(shard, table, keys)


def _out(rest: str) -> str:
    return f"id long, rest {rest}, n_lines long, n_dropped long, dropped array<int>, kept_text string"


def _drop(min_chars: int):
    def drop(batches):
        for batch in batches:
            for payload, rows in zip(batch.column("payload"), batch.column("answers"), strict=True):
                found = Lines(payload.as_py(), min_chars)
                least = blocks.unzip(blocks.answers(rows.as_py(), 0))
                gone = np.zeros(found.first[-1], dtype=bool)
                gone[found.chosen] = least[found.keys()[3]] < found.owner
                dropped = W.sums_by_row(gone, found.first)
                texts, lines = [], []
                for r, text in enumerate(found.text.to_pylist()):
                    a, b, which = found.first[r], found.first[r + 1], []
                    if dropped[r]:
                        which = np.flatnonzero(gone[a:b]).tolist()
                        text = b"\n".join(found.data[found.begin[i] : found.end[i]].tobytes() for i in (a + np.flatnonzero(~gone[a:b])).tolist()).decode()
                    texts.append(text or "")
                    lines.append(which)
                yield pa.record_batch({"id": found.ids, "rest": found.rows.column("rest"), "n_lines": pa.array(found.n_lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "dropped": pa.array(lines, pa.list_(pa.int32())), "kept_text": pa.array(texts, pa.string())})

    return drop


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """Drop each line whose key, of at least min_chars code points, a document with a smaller id holds too.

    Returns a row for each input row: id_col, rest (its other columns), n_lines (before), n_dropped, dropped (line numbers
    from 0) and kept_text (the other lines, joined by a line feed).

    A null or empty text is one empty line, which stays.  Rows of one id count as one document: they never drop
    each other's lines, and neither do equal lines within a document.  A row with a null id keeps its lines and holds none.
    """
    scratch.tune(docs.sparkSession)
    packed = scratch.keep(blocks.pack(docs, id_col, text_col), "blocks")
    shards = scratch.shards(packed.agg(F.sum("bytes")).first()[0] or 0, SHARD_BYTES)
    payload = packed.select("block", "payload")
    asked = payload.mapInArrow(_report(min_chars, shards), blocks.ASK_DDL)
    return blocks.answered(payload, asked.groupBy("shard").applyInArrow(_answer, blocks.ANSWER_DDL)).mapInArrow(_drop(min_chars), _out(blocks.rest_type(docs, id_col, text_col))).withColumnRenamed("id", id_col)


_STATE = pa.schema([("shard", pa.int32()), ("filter", pa.binary()), ("keys", pa.binary()), ("numbers", pa.binary())])
_STATE_DDL = "shard int, filter binary, keys binary, numbers binary"
_BLOCK_DDL = "block long, bytes long, payload binary"


def _state(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_STATE)


def _changed(state: pa.Table, changes: pa.Table) -> pa.Table:
    """A shard after the questions of blocks that are taken back (sign -1) and of those that come in (sign 1)."""
    row = state.to_pylist()[0] if state.num_rows else None
    if not changes.num_rows:
        return _state([row])
    sign = np.asarray(changes.column("sign"))
    keys, numbers = _questions(changes.filter(pa.array(sign > 0)))
    shard = Shard.from_row(row) if row else Shard(numbers.shape[1])
    gone, old = _questions(changes.filter(pa.array(sign < 0)))
    shard.remove(_all(gone), old[0])
    shard.add(_all(keys), numbers)
    return _state([shard.to_row(row["shard"] if row else changes.column("shard")[0].as_py())] if len(shard.table.keys) else [])


def _split(shards: int):
    """States, dealt to more shards."""

    def split(batches):
        for batch in batches:
            for row in batch.to_pylist():
                table = Shard.from_row(row).table
                number = _shard(table.keys, shards)
                for s in np.unique(number).tolist():
                    own = Shard(int((number == s).sum()))
                    own.add(table.keys[number == s], table.numbers[:, number == s])
                    yield from _state([own.to_row(s)]).to_batches()

    return split


def _only(batches, wanted: bool):
    """Blocks with only those documents that are (or aren't) listed in column gone."""
    for batch in batches:
        for block, payload, gone in zip(batch.column("block").to_pylist(), batch.column("payload"), batch.column("gone").to_pylist(), strict=True):
            rows = blocks.unpack(payload.as_py())
            ids = rows.column("id")
            keep = np.isin(np.asarray(ids.fill_null(0)), np.array(gone or [], np.int64)) & np.asarray(ids.is_valid(), dtype=bool)
            yield blocks.packed(block, [rows.filter(pa.array(keep if wanted else ~keep))])


class LineIndex:
    """Lines of the documents inserted so far.  Each change writes new tables below the shared scratch folder: of the blocks and shards that it
    touches, and of everything at each COMPACT_EVERY-th change.

    Shards are split as the corpus grows, so that each is for at most about twice shard_bytes of text.  All batches have the columns of the first.  An id may be
    inserted once: insert() raises ValueError for a batch with an id that the index holds.  Rows of a batch that repeat an id are one document.  delete() of
    ids that the index doesn't hold changes nothing.  An index without documents has no decisions.
    """

    COMPACT_EVERY, FEW = 32, 1_000

    def __init__(self, spark, shards: int = 1, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES):
        self.spark, self.shards, self.min_chars, self.id_col, self.text_col, self.shard_bytes = spark, shards, min_chars, id_col, text_col, shard_bytes
        scratch.tune(spark)
        self.rest, self.bytes, self.next, self.changes = "struct<none: int>", 0, 0, 0
        self.blocks, self.state, self.members = (spark.createDataFrame([], ddl) for ddl in (_BLOCK_DDL, _STATE_DDL, "block long, id long"))

    def _asked(self, packed: DataFrame) -> DataFrame:
        return packed.select("block", "payload").mapInArrow(_report(self.min_chars, self.shards), blocks.ASK_DDL)

    def _change(self, changes: DataFrame) -> None:
        changes = scratch.keep(changes, "changes")
        touched = changes.select("shard").distinct()
        new = self.state.join(touched, "shard", "left_semi").groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_changed, _STATE_DDL)
        self.state = self.state.join(touched, "shard", "left_anti").unionAll(scratch.keep(new, "line-shards"))
        self.changes += 1
        if not self.changes % self.COMPACT_EVERY:
            self.state, self.blocks, self.members = scratch.keep(self.state, "line-shards"), scratch.keep(self.blocks, "blocks"), scratch.keep(self.members, "members")

    def insert(self, docs: DataFrame) -> None:
        ids = docs.select(F.col(self.id_col).cast("long").alias("id")).distinct()
        if not self.members.join(ids, "id", "left_semi").isEmpty():
            raise ValueError("the index holds a document of this batch already")
        self.rest = blocks.rest_type(docs, self.id_col, self.text_col)
        more = scratch.keep(blocks.pack(docs, self.id_col, self.text_col), "blocks")
        task, number = F.shiftright("block", 32), F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
        size = more.agg(F.max(task), F.max(number), F.sum("bytes")).first()
        if size[0] is None:
            return
        more = more.withColumn("block", self.next + task * (size[1] + 1) + number)  # few numbers are left out
        self.next, self.bytes = self.next + (size[0] + 1) * (size[1] + 1), self.bytes + size[2]
        while self.bytes > 2 * self.shards * self.shard_bytes:
            self.shards *= 2
            self.state = scratch.keep(self.state.mapInArrow(_split(self.shards), _STATE_DDL), "line-shards") if self.changes else self.state
        self.members = self.members.unionAll(scratch.keep(more.select("block", "payload").mapInArrow(_members, "block long, id long"), "members"))
        self.blocks = self.blocks.unionAll(more)
        self._change(self._asked(more).withColumn("sign", F.lit(1)))

    def delete(self, ids: DataFrame) -> None:
        """Remove the documents whose ids are in the first column of ids."""
        ids = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct()
        gone = scratch.keep(self.members.join(ids, "id", "left_semi").groupBy("block").agg(F.collect_set("id").alias("gone")), "gone")
        few = [r.block for r in gone.select("block").limit(self.FEW + 1).collect()]
        if not few:
            return
        here = self.blocks.filter(F.col("block").isin(few)) if len(few) <= self.FEW else self.blocks  # files skip what they need not read
        hit = scratch.keep(here.join(gone, "block"), "changed")
        left = scratch.keep(hit.mapInArrow(lambda it: _only(it, False), _BLOCK_DDL), "blocks")
        self.blocks = self.blocks.join(gone, "block", "left_anti").unionAll(left)
        self.members = self.members.join(ids, "id", "left_anti")
        self.bytes -= (hit.agg(F.sum("bytes")).first()[0] or 0) - (left.agg(F.sum("bytes")).first()[0] or 0)
        self._change(self._asked(hit).withColumn("sign", F.lit(-1)).unionAll(self._asked(left).withColumn("sign", F.lit(1))))

    def decisions(self) -> DataFrame:
        """What dedup_lines() returns, for the documents that the index holds."""
        asked = self._asked(self.blocks)
        answers = self.state.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_looked_up, blocks.ANSWER_DDL)
        return blocks.answered(self.blocks.select("block", "payload"), answers).mapInArrow(_drop(self.min_chars), _out(self.rest)).withColumnRenamed("id", self.id_col)


def _members(batches):
    """The distinct ids of each block, null left out."""
    for batch in batches:
        for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
            ids = blocks.unpack(payload.as_py()).column("id").drop_null().unique()
            yield pa.record_batch({"block": pa.array([block] * len(ids), pa.int64()), "id": ids})


def _looked_up(state: pa.Table, asked: pa.Table) -> pa.Table:
    if not asked.num_rows:
        return pa.Table.from_pylist([], schema=blocks.ANSWER)
    return _answers(Shard.from_row(state.to_pylist()[0]), asked, _questions(asked)[0])
