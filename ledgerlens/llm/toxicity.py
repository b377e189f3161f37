"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other.  Each classifier is a logistic regression over
the words that a text holds (hashed, a fixed number of them chosen by their chi-squared
statistic) and over the logits of all earlier categories.  While training, the earlier categories' logits
are out-of-fold predictions, so a later model sees them as good as they will be on new
documents, not as good as on the rows they were fitted to.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import words as W
from .decontaminate import normal_words
from .samples import training_rows

DIMENSIONS, FEATURES, FOLDS, MOST_ROWS = 1 << 18, 1024, 4, 12_000
ROUNDS, PENALTY, RATE = 150, 2e-4, 0.2


def categories() -> dict[str, Column]:
    """Abuse in ordinary prose, abuse in junk, and any; from the two labels of a document.  One without a quality label counts as ordinary prose."""
    toxic, good = F.col("toxic") == 1, F.coalesce(F.col("quality") == 1, F.lit(True))
    return {"abusive_prose": toxic & good, "abusive_junk": toxic & ~good, "toxic": toxic}


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words of each row, and the first of each row (one more at the end)."""
    words = normal_words(column)
    key = np.unique((words.rows().astype(np.uint64) << np.uint64(18)) | (words.hashes >> np.uint64(46)))
    return (key & np.uint64(DIMENSIONS - 1)).astype(np.int64), np.searchsorted(key >> np.uint64(18), np.arange(len(words.first), dtype=np.uint64))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(at: np.ndarray, row: np.ndarray, n: int, width: int, dense: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of width binary columns (entries (row, at)), the dense columns and a constant; by Adam on the penalised log loss."""
    w = np.zeros(width + dense.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(row, w[at], n) + dense @ w[width:-1] + w[-1]
        error = (_sigmoid(z) - y) / max(n, 1)
        grad = np.concatenate([np.bincount(at, error[row], width), dense.T @ error, [error.sum()]])
        grad[:-1] += PENALTY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass
class Chain:
    """Chosen columns and, for each category, the weights of columns, earlier logits and a constant."""

    names: list[str]
    column: np.ndarray
    weights: list[np.ndarray]

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row of probabilities for each document."""
        n = len(first) - 1
        row = np.repeat(np.arange(n), np.diff(first))
        at = self.column[ids]
        row, at = row[at >= 0], at[at >= 0]
        width, logits = int(self.column.max()) + 1, np.zeros((n, 0))
        for w in self.weights:
            z = np.bincount(row, w[at], n) + logits @ w[width:-1] + w[-1]
            logits = np.column_stack([logits, np.clip(z, -8, 8)])
        return _sigmoid(logits)


def fit_chain(ids: np.ndarray, first: np.ndarray, targets: dict[str, np.ndarray], chosen: int = FEATURES) -> Chain:
    """Fit on rows given as distinct hashed words; targets are 0 or 1, in the order of the chain."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    held = np.bincount(ids, minlength=DIMENSIONS)
    best = np.zeros(DIMENSIONS)
    for y in targets.values():
        both, share = np.bincount(ids, y[row], DIMENSIONS), y.mean()
        expected = held * share
        best = np.maximum(best, (both - expected) ** 2 / np.maximum(expected * (1 - share) * (1 - held / n), 1e-9) * (held >= 3))
    top = np.argsort(-best, kind="stable")[: min(chosen, max(1, int((best > 0).sum())))]
    column = np.full(DIMENSIONS, -1)
    column[top] = np.arange(len(top))
    at = column[ids]
    row, at = row[at >= 0], at[at >= 0]
    fold = W.mix(np.arange(n, dtype=np.uint64)) % np.uint64(FOLDS)
    logits, weights, width = np.zeros((n, 0)), [], len(top)
    for y in targets.values():
        out = np.zeros(n)
        for f in range(FOLDS):
            rest, mine = fold != f, fold == f
            number = np.cumsum(rest) - 1
            take = rest[row]
            w = fit_logistic(at[take], number[row[take]], int(rest.sum()), width, logits[rest], y[rest])
            out[mine] = (np.bincount(row, w[at], n) + logits @ w[width:-1] + w[-1])[mine]
        weights.append(fit_logistic(at, row, n, width, logits, y))
        logits = np.column_stack([logits, np.clip(out, -8, 8)])
    return Chain(list(targets), column, weights)


def _featured(targets: list[str]):
    schema = pa.schema([("id", pa.int64()), *((t, pa.int32()) for t in targets), ("words", pa.list_(pa.int32()))])

    def featured(batches):
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                ids, first = features(piece.column("text"))
                yield pa.record_batch([*(piece.column(c) for c in schema.names[:-1]), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))], schema=schema)

    return featured


def train_toxicity(docs: DataFrame, labels: DataFrame, wanted: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> Chain:
    """A chain fitted on at most most_rows labelled rows, none of them held out.

    The driver holds the distinct words of these rows, DIMENSIONS at most for each, as numbers.  Without such rows the chain knows nothing: all its probabilities are 0.5,
    which score_toxicity() doesn't flag.
    """
    scratch.tune(docs.sparkSession)
    wanted = wanted or categories()
    marked = labels.select(id_col, *(c.cast("int").alias(name) for name, c in wanted.items()))
    rows = training_rows(docs, marked, list(wanted), id_col, text_col, most_rows).select("id", *wanted, "text")
    held = rows.mapInArrow(_featured(list(wanted)), "id long, " + "".join(f"{t} int, " for t in wanted) + "words array<int>").orderBy("id").toArrow()  # at most most_rows rows
    if not held.num_rows:
        return Chain(list(wanted), np.zeros(DIMENSIONS, np.int64), [np.zeros(2 + i) for i in range(len(wanted))])
    lists = held.column("words").combine_chunks()
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return fit_chain(np.asarray(lists.flatten(), dtype=np.int64), first, {c: np.asarray(held.column(c), dtype=float) for c in wanted})


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, p_<category> for each category and flagged (1 if the last one's probability is above threshold) for each input row.

    Whole texts are scored.  Null and empty texts have no words and get the model's constant.  Rows are scored one by one, so repeated rows, null ids
    and further columns make no difference.
    """
    spark = docs.sparkSession
    scratch.tune(spark)
    shared = spark.sparkContext.broadcast(chain)  # DIMENSIONS numbers
    names = [f"p_{c}" for c in chain.names]
    schema = pa.schema([("id", pa.int64()), *((c, pa.float64()) for c in names)])

    def score(batches):
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                p = shared.value.scores(*features(piece.column("text")))
                yield pa.record_batch([piece.column("id"), *(pa.array(x) for x in p.T)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(score, ", ".join(["id long", *(f"{c} double" for c in names)])).withColumnRenamed("id", id_col)
    return out.withColumn("flagged", (F.col(names[-1]) > threshold).cast("int"))
