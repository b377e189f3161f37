import re

import numpy as np
import pytest

from ledgerlens.llm import blocks, line_dedup, near_dedup
from ledgerlens.llm.cuckoo import CuckooFilter
from ledgerlens.llm.line_dedup import LineIndex, dedup_lines
from ledgerlens.llm.near_dedup import near_duplicates, shingle_sets, sketches
from ledgerlens.llm.substring_dedup import dedup_substrings
from ledgerlens.llm.words import LOWER, mix, split

from .helpers import EDGES, empty, frame, near_docs, random_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    least = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                least[key(line)] = min(least.get(key(line), i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or least.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("rows", [EDGES, random_docs(80), empty])
def test_lines(spark, rows):
    assert got(dedup_lines(frame(spark, rows)), "doc_id", "n_lines", "n_dropped", "kept_text") == brute_lines(rows)


def test_other_columns_come_along(spark):
    out = dedup_lines(frame(spark, [(1, "a"), (2, None)]))
    assert got(out, "doc_id", "rest.kept_text", "rest.rest") == [(1, "x", "x"), (2, "x", "x")]


def test_line_index_is_reversible(spark):
    rows = random_docs(60, seed=3)
    first, second = rows[:30], rows[30:]
    index = LineIndex(spark, shards=3)
    index.insert(frame(spark, first))
    alone = got(index.decisions(), "doc_id", "n_dropped", "kept_text")
    assert alone == [(i, d, t) for i, _, d, t in brute_lines(first)]
    index.insert(frame(spark, second))
    assert got(index.decisions(), "doc_id", "n_dropped", "kept_text") == [(i, d, t) for i, _, d, t in brute_lines(rows)]
    index.delete(spark.createDataFrame([(i,) for i, _ in second] + [(-5,)], "gone long"))
    assert got(index.decisions(), "doc_id", "n_dropped", "kept_text") == alone
    index.delete(spark.createDataFrame([(i,) for i, _ in first[:10]], "gone long"))
    assert got(index.decisions(), "doc_id", "n_dropped", "kept_text") == [(i, d, t) for i, _, d, t in brute_lines(first[10:])]


def test_index_grows_and_changes_only_what_it_touches(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 600)
    monkeypatch.setattr(LineIndex, "COMPACT_EVERY", 3)
    rows = list({i: t for i, t in random_docs(90, seed=6)}.items())
    index = LineIndex(spark, shard_bytes=2_000)
    assert index.decisions().count() == 0
    index.insert(frame(spark, []))
    for batch in (rows[:10], rows[10:40], rows[40:]):
        index.insert(frame(spark, batch))
    assert index.shards >= 4 and index.blocks.count() > 6
    assert got(index.decisions(), "doc_id", "n_dropped", "kept_text") == [(i, d, t) for i, _, d, t in brute_lines(rows)]
    with pytest.raises(ValueError, match="holds a document"):
        index.insert(frame(spark, rows[5:6]))
    asked = []
    monkeypatch.setattr(LineIndex, "_asked", lambda self, packed, f=LineIndex._asked: asked.append(packed.select("block").distinct().count()) or f(self, packed))
    gone = sorted(rows)[:1]
    index.delete(spark.createDataFrame([(i,) for i, _ in gone], "id long"))
    assert asked == [1, 1]  # the document's block before and after
    monkeypatch.undo()
    left = [r for r in rows if r not in gone]
    assert got(index.decisions(), "doc_id", "n_dropped", "kept_text") == [(i, d, t) for i, _, d, t in brute_lines(left)]
    index.delete(spark.createDataFrame([(i,) for i, _ in rows], "id long"))
    assert index.decisions().count() == 0 and index.state.count() == 0
    index.insert(frame(spark, rows[:20]))
    assert got(index.decisions(), "doc_id", "n_dropped", "kept_text") == [(i, d, t) for i, _, d, t in brute_lines(rows[:20])]


@pytest.mark.parametrize("shards", [1, 64, 4_096, 65_536])
def test_filter_tells_new_keys_however_many_shards(shards):
    r = np.random.default_rng(shards)
    keys = np.empty(40_000, line_dedup._KEY)
    keys["a"] = (r.integers(0, (1 << 32) // shards, 40_000, dtype=np.uint64) << np.uint64(32)) | r.integers(0, 1 << 32, 40_000, dtype=np.uint64)  # all of one shard
    keys["b"] = r.integers(0, 1 << 63, 40_000, dtype=np.uint64) * np.uint64(2)
    assert (line_dedup._shard(keys, shards) == 0).all()
    shard = line_dedup.Shard(0)
    numbers = np.stack([np.arange(20_000), np.ones(20_000, np.int64), np.arange(20_000)])
    shard.add(keys[:20_000], numbers)
    assert shard.filter.contains(keys["b"][:20_000]).all() and shard.filter.contains(keys["b"][20_000:]).mean() < 0.001
    shard.remove(keys[:5_000], numbers[0, :5_000])
    assert shard.filter.contains(keys["b"][:5_000]).mean() < 0.001 and shard.table.places(keys[:5_000]).max() == -1
    assert (shard.least(keys[5_000:20_000]) == numbers[2, 5_000:]).all()


def test_cuckoo_filter():
    h = mix(np.arange(20_000, dtype=np.uint64))
    f = CuckooFilter(10_000)
    f.insert(h[:10_000])
    assert f.contains(h[:10_000]).all() and f.contains(h[10_000:]).mean() < 0.001
    f.delete(h[:5_000])
    f = CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(h[5_000:10_000]).all() and f.contains(h[:5_000]).mean() < 0.001
    tight = CuckooFilter(4)
    tight.insert(h[:100])
    assert tight.contains(h[:100]).all() and len(tight.overflow)
    tight.delete(h[:100])
    assert not tight.contains(h[:100]).any()
    with pytest.raises(KeyError):
        tight.delete(h[:1])


def brute_passages(rows, n):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for a in range(len(w) - n + 1):
            if i is not None:
                k = tuple(w[a : a + n])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, w in words:
        gone = {a + j for a in range(len(w) - n + 1) if i is not None and least[tuple(w[a : a + n])] < i for j in range(n)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("rows", "n", "k"), [(EDGES, 13, 5), (random_docs(80), 13, 5), (random_docs(60, 1), 4, 2), (random_docs(40, 2), 3, 3), ([], 13, 5)])
def test_passages(spark, rows, n, k):
    out = dedup_substrings(frame(spark, rows), min_words=n, seed_words=k)
    assert got(out, "doc_id", "n_words", "n_removed", "kept_text") == brute_passages(rows, n)
    for r in out.collect():
        assert sum(s.length for s in r.removed) == r.n_removed


def brute_near(rows, threshold=0.75):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = [i for i in sets if i is not None]
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 100 * threshold * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                label[max(a, b)] = min(a, b)
    return sorted(((i, len(sets[i]) if i is not None else None, root(i) if i is not None else None) for i, _ in rows), key=repr)


@pytest.mark.parametrize("rows", [EDGES, near_docs(25), near_docs(25, 1), empty])
def test_near(spark, rows):
    out = [(i, n if i is not None else None, c) for i, n, c in got(near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id")]
    assert sorted(out, key=repr) == brute_near(rows)


def test_near_in_small_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HUB_MEMBERS", 2)
    monkeypatch.setattr(near_dedup, "TILE", 3)
    rows = near_docs(15, 2)
    assert got(near_duplicates(frame(spark, rows)), "doc_id", "n_shingles", "component_id") == brute_near(rows)


def test_only_some_documents(spark):
    rows = near_docs(12, 4)
    some = rows[::2]
    out = near_duplicates(frame(spark, rows), only=frame(spark, some + some[:1] + [(None, "x"), (-1, "y")]))
    assert got(out, "doc_id", "n_shingles", "component_id") == brute_near(some)


def test_few_similar_pairs_are_lost():
    """Generated pairs of similarity 0.75 to 0.8, sets of 3 to 500: they share a bucket and pass the estimate."""
    import pyarrow as pa

    r, texts = np.random.default_rng(2), []
    for _ in range(3_000):
        both = int(r.choice([3, 4, 6, 9, 20, 60, 150, 375]))
        own = r.multinomial(both // 3 - r.integers(0, 1 + both // 60), [0.5, 0.5])
        common = r.integers(0, 1 << 60, both)
        texts += [" ".join(map(str, [*common, *r.integers(0, 1 << 60, n)])) for n in own]
    sets = split(pa.array(texts))
    values, first = shingle_sets(sets, 1)
    bins = sketches(values, first, 128)
    a, b, sizes = bins[::2], bins[1::2], np.diff(first)
    same = a == b
    jaccard = np.array([len(np.intersect1d(values[first[i] : first[i + 1]], values[first[i + 1] : first[i + 2]])) for i in range(0, len(sizes), 2)])
    jaccard = jaccard / (sizes[::2] + sizes[1::2] - jaccard)
    near = jaccard >= 0.75
    assert near.sum() == 3_000 and (jaccard[near] <= 0.81).all()
    banded = same.reshape(-1, 32, 4).all(axis=2).any(axis=1)
    for found in (banded, same.mean(axis=1) >= 0.75 - near_dedup.MARGIN):
        assert found[near].mean() > 0.9985


def test_every_coordinate_fills_and_estimates():
    import pyarrow as pa

    base = [f"a{i}" for i in range(400)]
    texts = [" ".join(base), " ".join(base[:300]), "", "one", "one two three four five six"]
    values, first = shingle_sets(split(pa.array(texts), LOWER))
    bins = sketches(values, first, 128)
    filled = (bins != np.uint64(0xFFFFFFFFFFFFFFFF)).all(axis=1)
    assert filled.tolist() == [True, True, False, True, True]
    assert abs((bins[0] == bins[1]).mean() - 296 / 396) < 0.15
