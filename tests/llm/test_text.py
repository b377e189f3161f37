import math
import random
import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import decontaminate, queries
from ledgerlens.llm.decontaminate import contaminated, decontaminated
from ledgerlens.llm.quality_rules import quality_rules, suffix_array
from ledgerlens.llm.token_counts import MARK, Unigram, count_tokens, counts_of, load_pieces, rank_scores

from .helpers import EDGES, empty, frame, random_docs

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(rows, m=8):
    out = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)

        def repeated(n, w=w):
            c = Counter(tuple(w[a : a + n]) for a in range(len(w) - n + 1))
            return {a + j for a in range(len(w) - n + 1) if c[tuple(w[a : a + n])] > 1 for j in range(n)}

        longest = m
        while repeated(longest):
            longest += 1
        longest = longest - 1 if longest > m else 0
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r3, rm = len(repeated(3)), len(repeated(m))
        failed = len(w) < 50 or 100 * r3 > 50 * len(w)
        kept = not failed and 100 * rm <= 30 * len(w) and longest <= 100
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), r3, rm, longest, failed, kept))
    return sorted(out, key=repr)


REPEATS = [(20, "a b c d e f g h i j " * 5), (21, " ".join(f"u{i}" for i in range(200)) + " # $ |<>"), (22, " ".join(f"u{i % 90}" for i in range(200)))]


@pytest.mark.parametrize("rows", [[r for r in EDGES if r[0] != 8] + REPEATS, random_docs(40, 5), empty])
def test_rules(spark, rows):
    out = quality_rules(frame(spark, rows))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute_rules(rows)


def test_one_word_many_times(spark):
    row = quality_rules(frame(spark, [(8, "word " * 3000)])).first()
    assert (row.n_words, row.longest_repeat, row.n_covered_words, row.kept) == (3000, 2999, 3000, False)


def test_suffix_array():
    r = np.random.default_rng(0)
    symbols = r.integers(0, 3, 300).astype(np.uint64)
    rows = np.sort(r.integers(0, 5, 300))
    ends = np.searchsorted(rows, rows, side="right")
    order = sorted(range(300), key=lambda i: (rows[i], symbols[i : ends[i]].tolist()))
    assert suffix_array(symbols, rows, ends).tolist() == order


def brute_tokens(model, word):
    """The number of tokens of one pre-token, without a trie and without hashes."""
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * model.byte, best[end - 1][1] - n)]
        options += [(best[end - size][0] + model.scores[p], best[end - size][1] - 1) for size in range(1, min(end, model.longest) + 1) if (p := word[end - size : end]) in model.scores]
        best.append(max(options))
    return -best[-1][1]


def test_tokens_by_trie_and_alone():
    r = random.Random(4)
    scores = {MARK: -9.0, **{c: -8.0 for c in "abcé"}}
    scores |= {"".join(r.choice("abcé" + MARK) for _ in range(r.randrange(2, 6))): -r.randrange(1, 12) / 2 for _ in range(60)}
    model = Unigram(scores)
    words = ["".join(r.choice("abcéz漢😀") for _ in range(r.randrange(1, 9))) for _ in range(60)]
    long = "".join(r.choice("abcéz") for _ in range(3_000))
    n, tokens = counts_of(pa.array([" ".join(words), None, "", words[0], "abc" * 100, long, long[:1500] + " " + long]), model)
    assert n.tolist() == [60, 0, 0, 1, 1, 1, 2]
    alone = [brute_tokens(model, MARK + w) for w in ("abc" * 100, long, long[:1500])]
    assert tokens.tolist() == [sum(brute_tokens(model, MARK + w) for w in words), 0, 0, brute_tokens(model, MARK + words[0]), alone[0], alone[1], alone[1] + alone[2]]


VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def pieces():
    return rank_scores(load_pieces(VOCABULARY))


def test_scores_are_log_probabilities(pieces):
    assert abs(sum(map(math.exp, pieces.values())) - 1) < 1e-9 and len(pieces) > 31_000
    assert list(pieces.values()) == sorted(pieces.values(), reverse=True) and max(pieces.values()) < 0


@pytest.mark.parametrize("rows", [EDGES, empty])
def test_count_tokens(spark, rows, pieces):
    model = Unigram(pieces)
    out = sorted((tuple(r) for r in count_tokens(frame(spark, rows), pieces).collect()), key=repr)
    wanted = [(i, len(WORD.findall(t or "")), sum(brute_tokens(model, MARK + w) for w in WORD.findall(t or ""))) for i, t in rows]
    assert out == sorted(wanted, key=repr)


def test_whole_query_by_brute_force(spark, pieces):
    model, known = Unigram(pieces), {}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    alone = lambda w: known.setdefault(w, None) or known.update({w: brute_tokens(model, MARK + w)}) or known[w]
    wanted = {(r.doc_id, len(w), sum(map(alone, w))) for r in rows for w in [WORD.findall(r.text or "")]}
    assert {tuple(r) for r in queries.op8_token_counts(spark, SF).collect()} == wanted


ENGLISH = """The quick brown fox jumps over the lazy dog. It was the best of times, it was the worst of times; unbelievable representations of tokenization
notwithstanding, most readers understand ordinary prose without difficulty, because frequent words are written as single pieces and rare ones are not."""


def test_counts_are_near_those_of_the_vocabulary_s_own_encoding(spark, pieces):
    import sentencepiece

    own, model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY), Unigram(pieces)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    for some, each in (([ENGLISH], 0.02), (texts, 0.25)):
        counts = counts_of(pa.array(some), model)[1]
        encoded = np.array([sum(len(own.encode(w)) for w in WORD.findall(t)) for t in some])
        assert abs(counts.sum() / encoded.sum() - 1) < 0.05
        assert (np.abs(counts / np.maximum(encoded, 1) - 1)[encoded > 0] <= each).all()


def test_broken_vocabularies():
    with pytest.raises(ValueError, match="empty"):
        Unigram({})


ITEM = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon."
ITEMS = [(1, ITEM), (2, "short item of seven or eight words only"), (3, "tiny one"), (4, None), (5, ""), (6, " ".join(f"item{i}" for i in range(40)))]


def brute_overlaps(rows, items, least=13, share=0.8):
    """All stretches of all alignments."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower(), re.UNICODE)
    out = set()
    for i, t in rows:
        d = words(t)
        for j, s in items:
            q = words(s)
            if not q:
                continue
            need = min(least, len(q))
            for shift in range(-len(q) + 1, len(d)):
                a, b = max(0, -shift), min(len(q), len(d) - shift)
                same = [d[k + shift] == q[k] for k in range(a, b)]
                if any(same[x] and same[y - 1] and sum(same[x:y]) >= share * (y - x) for x in range(len(same)) for y in range(x + need, len(same) + 1)):
                    out.add((i, j))
    return out


def planted():
    w = ITEM.split()
    changed = lambda *at: " ".join("zzz" if k in at else x for k, x in enumerate(w))
    clean = " ".join(f"c{i}" for i in range(60))
    return [
        (1, clean),
        (2, f"{clean} {ITEM} {clean}"),
        (3, f"{clean} {ITEM.upper().replace(',', ' ;')}"),
        (4, f"{clean} {changed(4, 11)} {clean}"),
        (5, f"{changed(9, 16)} {clean}"),
        (6, " ".join(w[:12]) + " " + clean),
        (7, " ".join(w[3:17])),
        (8, "now a short item of seven or eight words only here"),
        (9, "a tiny one"),
        (10, "gamma beta alpha " * 20),
        (11, " ".join(f"item{i}" for i in range(40))),
    ]


@pytest.mark.parametrize("part", [1 << 24, 60])
def test_overlaps(spark, monkeypatch, part):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part)
    rows, tests = planted() + EDGES_PLUS, spark.createDataFrame(ITEMS, "item_id long, text string")
    found = contaminated(frame(spark, rows), tests).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute_overlaps(rows, ITEMS) == {(2, 1), (3, 1), (4, 1), (5, 1), (7, 1), (8, 2), (9, 3), (11, 6)}
    assert len(found) == 8
    kept = decontaminated(frame(spark, rows), tests)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted((i, t) for i, t in rows if i in (1, 6, 10) or i > 100)
    assert kept.columns == frame(spark, []).columns


EDGES_PLUS = [(101, ""), (102, "\n"), (103, "item1 " * 500)]


def test_overlaps_of_nothing(spark):
    tests = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(frame(spark, EDGES), tests).count() == 0
    assert decontaminated(frame(spark, EDGES), tests).count() == len(EDGES)
    assert contaminated(frame(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert contaminated(frame(spark, EDGES), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert decontaminated(frame(spark, EDGES), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == len(EDGES)


def test_items_of_few_words_can_be_left_out(spark):
    tests = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = contaminated(frame(spark, planted()), tests, least_words=8).collect()
    assert {r.item_id for r in found} == {1, 2, 6}
    assert {r.doc_id for r in decontaminated(frame(spark, planted()), tests, least_words=9).collect()} == {1, 6, 8, 9, 10}


def test_repeated_words_take_linear_room():
    """A word repeated in a text and in an item: all alignments, in a few seconds and once for each pattern."""
    items = decontaminate.Items([1, 2], decontaminate.normal_words(pa.array(["again " * 2_000, "once more and " * 20])))
    began = time.time()
    found = decontaminate.overlaps(items, pa.array(["again " * 20_000, "more and once " * 3_000]), 13, 0.8)
    assert found == {(0, 0): (2_000, 2_000, 0, 0), (1, 1): (60, 60, -2, 0)}
    assert time.time() - began < 10


def test_best_of_all_alignments():
    """The same result as going through all alignments one by one, on texts full of repeats."""
    r = random.Random(8)
    for _ in range(40):
        item, text = (["ab"[r.random() < 0.3] if r.random() < 0.9 else f"c{r.randrange(5)}" for _ in range(n)] for n in (r.randrange(1, 40), r.randrange(1, 120)))
        need, best = min(13, len(item)), (0,)
        for shift in range(-len(item) + 1, len(text)):
            a, b = max(0, -shift), min(len(item), len(text) - shift)
            same = [text[k + shift] == item[k] for k in range(a, b)]
            spans = [(y - x, -x, sum(same[x:y])) for x in range(len(same)) for y in range(x + 1, len(same) + 1) if same[x] and same[y - 1] and 5 * sum(same[x:y]) >= 4 * (y - x)]
            if spans and (longest := max(spans))[0] >= need:
                best = max(best, (longest[2], longest[0], longest[1] - a - shift, longest[1] - a))
        items = decontaminate.Items([1], decontaminate.normal_words(pa.array([" ".join(item)])))
        assert decontaminate.overlaps(items, pa.array([" ".join(text)]), 13, 0.8) == ({(0, 0): best} if len(best) > 1 else {})


@pytest.mark.parametrize("n", [*range(1, 21)])
def test_every_pattern_of_substitutions_is_found(n):
    words = [f"item{i}" for i in range(n)]
    items = decontaminate.Items([1], decontaminate.normal_words(pa.array([" ".join(words)])))
    patterns = list(combinations(range(1, n - 1), n // 5))
    texts = ["before " + " ".join("zzz" if i in out else w for i, w in enumerate(words)) + " after" for out in patterns]
    texts.append(" ".join(words[:-1]) if n < 13 else " ".join(words[:12]))  # too short
    found = decontaminate.overlaps(items, pa.array(texts), 13, 0.8)
    assert found == {(r, 0): (n - n // 5, n, -1, 0) for r in range(len(patterns))}


def test_masks_leave_no_long_stretch():
    """The best sum of 1 for a match and -4 for a substitution, over all stretches without a window that a mask picks whole: an overlap has 0 or more."""
    widest = max(map(len, decontaminate.MASKS))
    state = np.arange(1 << widest)  # the last places, the latest in the lowest bit
    picked = [int(m, 2) for m in decontaminate.MASKS]
    free = ~np.any([state & m == m for m in picked], axis=0)
    step = np.where(state & 1, 1.0, -4.0)

    def longer(best):
        before = np.maximum(best[state >> 1], best[(state >> 1) | (1 << (widest - 1))])
        return np.where(free, before + step, -np.inf)

    best, anywhere = np.full(len(state), -np.inf), np.zeros(len(state))
    best[0] = 0  # nothing matches before the stretch
    for length in range(1, 401):
        best, anywhere = longer(best), longer(anywhere)
        if length >= 13:
            assert best[state & 1 == 1].max() < 0
        if length == 100:
            assert anywhere.max() < -widest  # a hundred places more always cost more than a start can gain, so longer stretches fail too
