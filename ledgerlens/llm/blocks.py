"""Blocks of documents that ask shards of hash space, and the answers they get back.

Documents are packed into compressed blocks of about 1 MB of text.  Each block sends a shard
one sorted array of distinct keys (a question), however many of its documents hold
a key; the shard sees the questions of all blocks and returns an array aligned
with each question.  A key held by a third of all rows therefore costs one entry
for each block, and no shard or block grows with a key's frequency.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

BLOCK_BYTES = 1 << 20
ASK = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
ANSWER = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("answer", pa.binary())])
ASK_DDL = "block long, shard int, keys binary, extra binary"
ANSWER_DDL = "block long, kind int, shard int, answer binary"


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, bytes, payload): documents with all their columns in compressed blocks, which keep their identity once they are written."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, waiting, held = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for piece in W.pieces(batch, "text", BLOCK_BYTES):
                waiting.append(piece)
                held += piece.nbytes
                if held >= BLOCK_BYTES:
                    yield packed(block, waiting)
                    block, waiting, held = block + 1, [], 0
        if waiting:
            yield packed(block, waiting)

    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    row = F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("none"))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), row.alias("rest")).mapInArrow(blocks, "block long, bytes long, payload binary")


def rest_type(docs: DataFrame, id_col: str, text_col: str) -> str:
    """The type of a packed row's other columns, for the schema of results that carry them."""
    fields = [f for f in docs.schema.fields if f.name not in (id_col, text_col)]
    return "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in fields) + ">" if fields else "struct<none: int>"


def packed(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.Table.from_batches(parts).combine_chunks())
    return pa.record_batch({"block": pa.array([block], pa.int64()), "bytes": pa.array([sum(p.nbytes for p in parts)], pa.int64()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def unpack(payload: bytes) -> pa.RecordBatch:
    """A block's rows: id, text and rest.  What earlier blocks have used goes back to the system first."""
    W.release()
    with pa.ipc.open_stream(payload) as rows:
        table = rows.read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def table(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def zipped(values: np.ndarray) -> bytes:
    """64-bit integers, compressed."""
    raw = np.ascontiguousarray(values, dtype=np.int64).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unzip(parts: list[bytes]) -> np.ndarray:
    """What zipped() made, one after the other."""
    each = [np.frombuffer(pa.decompress(a[8:], int.from_bytes(a[:8], "little"), codec="zstd"), np.int64) for a in parts]
    return np.concatenate(each) if each else np.zeros(0, np.int64)


def answers(rows: list[dict] | None, kind: int) -> list[bytes]:
    """A block's answers of one kind, by shard."""
    return [x["answer"] for x in sorted((x for x in rows or [] if x["kind"] == kind), key=lambda x: x["shard"])]


def answered(payload: DataFrame, rows: DataFrame) -> DataFrame:
    """Blocks with their answers; a block that asked nothing has none."""
    return payload.join(rows.groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "answer")).alias("answers")), "block", "left")
