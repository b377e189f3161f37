"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks that overlap by the filters' width less one, so every window of
bytes of the whole text lies in a chunk.  Bytes are embedded; learned filters slide over each chunk, and the
maximum of each filter over the chunk goes through a small hidden layer to the chunk's logit.  The mean of the
chunks' logits gives the text's probability.  Gradients reach a filter only through the window that
was its maximum, so training touches few windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import words as W
from .samples import held_out, training_rows

WIDTH, EMBED, FILTERS, HIDDEN, CHUNK = 8, 4, 24, 16, 256
MOST_ROWS, STEPS, BATCH, RATE, THRESHOLD = 3_000, 700, 32, 5e-3, 0.7
STRIDE = CHUNK - WIDTH + 1


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        make = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls(make(256, EMBED, scale=0.5), make(WIDTH * EMBED, FILTERS, scale=0.3), np.zeros(FILTERS, np.float32), make(FILTERS, HIDDEN, scale=0.3), np.zeros(HIDDEN, np.float32), make(HIDDEN, scale=0.3), np.zeros(1, np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def pooled(self, chunks: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The maximum of each filter over each chunk (rows of CHUNK bytes), and the window that has it."""
        most, at = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64) if where else None
        for a in range(0, len(chunks), 16):  # stays in the cache
            part = self.embed[chunks[a : a + 16]]
            windows = np.lib.stride_tricks.sliding_window_view(part.reshape(len(part), -1), WIDTH * EMBED, axis=1)[:, ::EMBED]
            r = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED) @ self.filters
            r = r.reshape(len(part), -1, FILTERS)
            most[a : a + 16] = r.max(axis=1)
            if where:
                at[a : a + 16] = r.argmax(axis=1)
        return most + self.bias, at

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(np.tanh(pooled) @ self.hidden + self.hidden_bias) @ self.out + self.out_bias[0]


def chunked(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of all rows, padded with zero bytes, and the first chunk of each row (one more at the end); an empty row has one chunk."""
    sizes = np.diff(at)
    counts = np.maximum(1, -(-np.maximum(sizes - WIDTH + 1, 1) // STRIDE))
    first = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(sizes)), counts)
    begin = at[row] + (np.arange(first[-1]) - first[row]) * STRIDE
    index = begin[:, None] + np.arange(CHUNK)
    inside = index < at[1:][row][:, None]
    out = np.zeros(index.shape, np.uint8)
    out[inside] = data[index[inside]]
    return out, first


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def probabilities(net: Network, column: pa.Array) -> np.ndarray:
    """Of each row's whole text."""
    data, at = W.buffers(column)
    chunks, first = chunked(data, at)
    logits = net.logits(net.pooled(chunks)[0]).astype(np.float64)
    return _sigmoid(np.add.reduceat(logits, first[:-1]) / np.diff(first)) if len(at) > 1 else np.zeros(0)


def fit(chunks: np.ndarray, row: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on the log loss of the rows' probabilities; row: each chunk's row, ascending."""
    net, r = Network.new(seed), np.random.default_rng(seed)
    p = net.parameters()
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    first, step = np.searchsorted(row, np.arange(len(y) + 1)), 0
    while step < steps:
        order = r.permutation(len(y))
        for b in range(0, len(order), BATCH):
            docs = order[b : b + BATCH]
            sizes = first[docs + 1] - first[docs]
            x = chunks[np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])]
            own = np.repeat(np.arange(len(docs)), sizes)
            pooled, at = net.pooled(x, where=True)
            t = np.tanh(pooled)
            h = np.tanh(t @ net.hidden + net.hidden_bias)
            z = np.bincount(own, h @ net.out + net.out_bias[0]) / sizes
            dz = ((_sigmoid(z) - y[docs]) / len(docs) / sizes)[own].astype(np.float32)
            dh = (dz[:, None] * net.out) * (1 - h**2)
            dt = (dh @ net.hidden.T) * (1 - t**2)
            where = at[:, :, None] + np.arange(WIDTH)
            seen = np.take_along_axis(x[:, None, :], where, axis=2) if len(x) else where
            windows = net.embed[seen].reshape(len(x), FILTERS, -1)
            d_filters = np.einsum("cf,cfw->wf", dt, windows)
            d_window = (dt[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            flat = seen.reshape(-1)
            d_embed = np.column_stack([np.bincount(flat, d_window[:, e], 256) for e in range(EMBED)])
            grads = [d_embed, d_filters, dt.sum(0), t.T @ dh, dh.sum(0), h.T @ dz, np.array([dz.sum()])]
            step += 1
            rate = RATE * max(0.02, min(1.0, 2 * (1 - step / steps)))
            for k, g in enumerate(grads):
                g = g + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g**2
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net


_CHUNKS = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("chunks", pa.binary())])


def _whole(batches):
    """All chunks of each row."""
    for batch in batches:
        for piece in W.pieces(batch, "text"):
            chunks, first = chunked(*W.buffers(piece.column("text")))
            held = [chunks[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.record_batch([piece.column("id"), piece.column("label"), pa.array(held, pa.binary())], schema=_CHUNKS)


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> Network | None:
    """A network fitted on the whole texts of at most most_rows labelled rows, none of them held out; the driver holds these texts.

    None if there are no such rows: nothing is known then, and every text's probability is 0.5.
    """
    scratch.tune(docs.sparkSession)
    rows = training_rows(docs, labels, [label], id_col, text_col, most_rows).select("id", F.col(label).cast("int").alias("label"), "text")
    held = rows.mapInArrow(_whole, "id long, label int, chunks binary").orderBy("id").toArrow()  # at most most_rows rows
    if not held.num_rows:
        return None
    parts = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, CHUNK) for x in held.column("chunks")]
    return fit(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts]), np.asarray(held.column("label"), dtype=float))


def quality_score(net: Network | None):
    """A function of a text column that gives each whole text's probability; a null or empty text counts as one chunk of zero bytes."""
    if net is None:
        return lambda text: F.lit(0.5)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        batch = pa.record_batch([texts], names=["text"])
        return pa.array(np.concatenate([probabilities(net, p.column("text")) for p in W.pieces(batch, "text")] or [np.zeros(0)]))

    return lambda text: score(text.cast("string"))


def score_quality(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score and predicted (1 if score reaches threshold) for each input row.

    Whole texts are scored.  A null or empty text is scored as one chunk of zero bytes.  Rows are scored one by one, so repeated
    rows and further columns make no difference; a null id is not held out.  Without a network all scores are 0.5.  An empty table gives an empty result.
    """
    scratch.tune(docs.sparkSession)
    out = docs.select(F.col(id_col), quality_score(net)(F.col(text_col)).alias("score"))
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
