import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quality_classifier as Q
from ledgerlens.llm import toxicity as T
from ledgerlens.llm.samples import held_out, training_rows
from ledgerlens.llm.words import buffers

from .helpers import EDGES, frame

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 4000")  # a small fixture
    return docs, spark.read.parquet(f"{DATA}/labels.parquet")


def test_held_out_split(spark):
    df = spark.createDataFrame([(i,) for i in [*range(200), None]], "doc_id long")
    for r in df.select("doc_id", held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_no_held_out_row_is_learned_from(spark, tables):
    docs, labels = tables
    rows = training_rows(docs, labels.unionAll(labels), ["quality"], "doc_id", "text", 300).collect()
    assert len(rows) <= 300 and len({r.id for r in rows}) == len(rows)
    assert all(zlib.crc32(str(r.id).encode()) % 4 != 2 for r in rows)


def test_quality_on_held_out_rows(spark, tables):
    docs, labels = tables
    net = Q.train_quality(docs, labels)
    rows = Q.score_quality(docs, net).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.97
    out = Q.score_quality(frame(spark, EDGES), net).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 for r in out)
    assert Q.score_quality(frame(spark, []), net).count() == 0


def test_whole_texts_are_learned_from(spark, monkeypatch):
    texts = {i: "".join(f"{i}:{k} " for k in range(40 * i)) for i in range(12)}
    held = []
    monkeypatch.setattr(Q, "fit", lambda chunks, row, y: held.append((chunks, row)))
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    Q.train_quality(frame(spark, list(texts.items())), labels)
    chunks, row = held[0]
    learned = [i for i in sorted(texts) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(set(row)) == list(range(len(learned)))
    for n, i in enumerate(learned):
        wanted, _ = Q.chunked(*buffers(pa.array([texts[i]])))
        assert np.array_equal(chunks[row == n], wanted)


def test_without_labelled_rows_nothing_is_known(spark, tables):
    for docs, labels in ((frame(spark, []), tables[1]), (frame(spark, EDGES), tables[1].filter("false")), (frame(spark, EDGES), tables[1].withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")}))):
        net, chain = Q.train_quality(docs, labels), T.train_toxicity(docs, labels)
        assert {(r.score, r.predicted) for r in Q.score_quality(frame(spark, EDGES), net).collect()} == {(0.5, 0)}
        assert {(r.p_toxic, r.flagged) for r in T.score_toxicity(frame(spark, EDGES), chain).collect()} == {(0.5, 0)}


def test_toxic_rows_without_a_quality_label_are_learned_from(spark):
    labels = spark.createDataFrame([(i, None if i % 2 else 1, i % 3 == 0) for i in range(40)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    marked = labels.select("doc_id", *(c.cast("int").alias(n) for n, c in T.categories().items()))
    rows = training_rows(frame(spark, [(i, "text") for i in range(40)]), marked, list(T.categories()), "doc_id", "text", 100).collect()
    assert {r.id: r.toxic for r in rows} == {i: int(i % 3 == 0) for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2}


def test_repeated_ids_are_learned_from_in_the_same_way_each_time(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (4, "c")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 0), (1, 1), (4, 0)], "doc_id long, quality int")
    rows = training_rows(docs, labels, ["quality"], "doc_id", "text", 100).collect()
    assert {tuple(r) for r in rows} == {(i, t, q) for i, t, q in ((1, "a", 1), (4, "c", 0)) if zlib.crc32(str(i).encode()) % 4 != 2}


def brute_probability(net, text):
    """The forward pass by loops over chunks, filters and bytes."""
    data, logits = (text or "").encode(), []
    for begin in range(0, max(1, len(data) - Q.WIDTH + 1), Q.STRIDE):
        chunk = data[begin : begin + Q.CHUNK].ljust(Q.CHUNK, bytes(1))
        pooled = []
        for f in range(Q.FILTERS):
            values = [sum(float(net.embed[chunk[p + k]][e]) * float(net.filters[k * Q.EMBED + e][f]) for k in range(Q.WIDTH) for e in range(Q.EMBED)) for p in range(Q.CHUNK - Q.WIDTH + 1)]
            pooled.append(math.tanh(max(values) + float(net.bias[f])))
        hidden = [math.tanh(sum(v * float(net.hidden[f][j]) for f, v in enumerate(pooled)) + float(net.hidden_bias[j])) for j in range(Q.HIDDEN)]
        logits.append(sum(v * float(net.out[j]) for j, v in enumerate(hidden)) + float(net.out_bias[0]))
    return 1 / (1 + math.exp(-sum(logits) / len(logits)))


def test_network_by_brute_force():
    net, r = Q.Network.new(3), np.random.default_rng(3)
    net.bias, net.hidden_bias, net.out_bias = (r.standard_normal(x.shape).astype(np.float32) for x in (net.bias, net.hidden_bias, net.out_bias))
    texts = ["", None, "short", "é" * 130, "word and words " * 40]
    wanted = [brute_probability(net, t) for t in texts]
    assert np.allclose(Q.probabilities(net, pa.array(texts)), wanted, atol=1e-4)


def brute_chain(chain, text):
    """Category by category, word by word."""
    words = T.normal_words(pa.array([text]))
    known = {int(chain.column[int(h) >> 46]) for h in words.hashes} - {-1}
    width, logits = int(chain.column.max()) + 1, []
    for w in chain.weights:
        z = w[-1] + sum(w[c] for c in known) + sum(a * b for a, b in zip(logits, w[width:-1], strict=True))
        logits.append(min(8.0, max(-8.0, z)))
    return [1 / (1 + math.exp(-z)) for z in logits]


def test_chain_by_brute_force():
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in r.integers(0, 60, r.integers(0, 30))) for _ in range(300)]
    y = np.array([("w7" in t.split()) * 1.0 for t in texts])
    ids, first = T.features(pa.array(texts))
    chain = T.fit_chain(ids, first, {"a": y, "b": np.array([("w9" in t.split()) * 1.0 for t in texts]), "c": 1 - y}, chosen=20)
    assert np.allclose(chain.scores(ids, first), [brute_chain(chain, t) for t in texts], atol=1e-9)


def test_chunks_cover_every_window():
    texts = ["", "a", "abc" * 83, "x" * 256, "y" * 257, "z" * 1000]
    data, at = buffers(pa.array(texts))
    chunks, first = Q.chunked(data, at)
    for i, t in enumerate(texts):
        windows = {t[a : a + Q.WIDTH] for a in range(len(t) - Q.WIDTH + 1)}
        seen = {bytes(c[a : a + Q.WIDTH]).decode() for c in chunks[first[i] : first[i + 1]] for a in range(Q.CHUNK - Q.WIDTH + 1)}
        assert windows <= seen


def test_gradient_step_lowers_loss():
    r = np.random.default_rng(0)
    chunks = r.integers(97, 123, (80, Q.CHUNK)).astype(np.uint8)
    chunks[:40, 10:16] = np.frombuffer(b"#####!", np.uint8)
    y = np.repeat([0.0, 1.0], 40)
    net = Q.fit(chunks, np.arange(80), y, steps=80)
    p = Q._sigmoid(net.logits(net.pooled(chunks)[0]))
    assert ((p > 0.5) == (y == 1)).mean() > 0.95


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    chain = T.train_toxicity(docs, labels)
    assert chain.names == ["abusive_prose", "abusive_junk", "toxic"]
    rows = T.score_toxicity(docs, chain).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    assert np.mean([r.flagged == r.toxic for r in rows]) > 0.95
    assert np.mean([r.flagged for r in rows if r.toxic == 0]) < 0.02
    out = T.score_toxicity(frame(spark, EDGES), chain).collect()
    assert len(out) == len(EDGES) and all(0 <= r.p_toxic <= 1 for r in out)
    assert T.score_toxicity(frame(spark, []), chain).count() == 0


def test_later_models_see_earlier_predictions():
    texts = pa.array([f"common{i % 3} bad good" if i % 2 else f"common{i % 3} good" for i in range(200)])
    ids, first = T.features(texts)
    y = np.arange(200) % 2 * 1.0
    chain = T.fit_chain(ids, first, {"a": y, "b": 1 - y})
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    s = chain.scores(ids, first)
    assert ((s[:, 0] > 0.5) == (y == 1)).all() and ((s[:, 1] > 0.5) == (y == 0)).all()
