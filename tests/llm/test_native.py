import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.chat_format import Template, escaped, format_chats, loss_text, parsed, unescaped
from ledgerlens.llm.source_mix import mix_sources, schedule

NASTY = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\", "[INST]", "[\\INST]", "[", "<", "x<", "x [", " [/ANS]", "a\n[ANS] b", "<s><s></s>", "[/INST", "\\[INST]", "é漢😀\\", " lead and trail ", "[TURN] a [AS] b [/TURN]", "[/\\TURN]", "$1 \\1"]


def test_escaping_is_reversible(spark):
    r = random.Random(1)
    texts = NASTY + ["".join(r.choice(NASTY) for _ in range(4)) for _ in range(200)]
    t = Template()
    df = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("e", escaped(F.col("t"), t))
    for row in df.select("t", "e", unescaped(F.col("e"), t).alias("u")).collect():
        assert row.u == row.t
        assert not any(c in row.e for c in t.controls())


def chats():
    r = random.Random(2)
    rows = []
    for c in range(60):
        for turn in range(r.randrange(1, 7)):
            rows.append((c, r.randrange(5) if c % 5 == 0 else turn, r.choice(["user", "assistant", "system", "tool", None, "a [AS] b", ""]), r.choice([*NASTY, None])))
    return rows + [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (77, 0, "user", "x" * 100_000), (77, 1, "assistant", "y" * 100_000)]


def test_round_trip(spark):
    rows = chats()
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], "conv_id long, turn long, role string, text string, segments string, n int")
    out = format_chats(df).withColumn("turns", parsed(F.col("formatted"))).withColumn("loss_text", loss_text(F.col("segments")))
    got = {r.conv_id: r for r in out.collect()}
    low = lambda x: (x is not None, x if x is not None else 0)
    wanted = {}
    for c, turns in itertools.groupby(sorted(rows, key=lambda x: low(x[0])), key=lambda x: x[0]):
        wanted[c] = [(role or "", text or "") for _, _, role, text in sorted(turns, key=lambda x: (low(x[1]), x[2] or "", x[3] or ""))]
    assert set(got) == set(wanted)
    for c, turns in wanted.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].loss_text == "".join(t for r, t in turns if r == "assistant")
        assert got[c].formatted == "".join(s.text for s in got[c].segments)


@pytest.mark.parametrize(
    ("roles", "valid", "bad"),
    [("ua", True, None), ("sua", True, None), ("uaua", True, None), ("u", False, None), ("su", False, None), ("a", False, 0), ("uu", False, 1), ("usa", False, 1), ("ss", False, 1), ("uaa", False, 2), ("ut", False, 1)],
)
def test_order_of_roles(spark, roles, valid, bad):
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    df = spark.createDataFrame([(1, i, names[r], "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    row = format_chats(df).first()
    assert (row.valid, row.bad_turn) == (valid, bad)


def test_own_template(spark):
    t = Template(roles={"q": ("Q", False), "r": ("R", True)}, follows={"": ("q",), "q": ("r",), "r": ("q",)}, ends=("r",))
    df = spark.createDataFrame([(1, 0, "q", "why [R]"), (1, 1, "r", "so [Q]")], "conv_id long, turn long, role string, text string")
    row = format_chats(df, t).withColumn("turns", parsed(F.col("formatted"), t)).first()
    assert row.valid and row.formatted == "<s>[Q] why [\\R] [/Q][R] so [\\Q] [/R]</s>"
    assert [tuple(x) for x in row.turns] == [("q", "why [R]"), ("r", "so [Q]")]
    assert [s.text for s in row.segments if s.loss] == ["so [\\Q]"]


def test_tags_and_escapes_of_any_characters(spark):
    t = Template(roles={"q": ("A+B", False), "r": ("(R|", True)}, follows={"": ("q",), "q": ("r",), "r": ("q",)}, ends=("r",), escape="^")
    turns = [("q", "why [A+B] ^ [/A+B]"), ("r", "so (R| ^^[(R|] \\ $1"), ("x", "a.b [TURN] ^")]
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate(turns)], "conv_id long, turn long, role string, text string")
    row = format_chats(df, t).withColumn("turns", parsed(F.col("formatted"), t)).withColumn("loss", loss_text(F.col("segments"), t)).first()
    assert [tuple(x) for x in row.turns] == turns and row.loss == turns[1][1] and (row.valid, row.bad_turn) == (False, 2)


def test_the_query_runs_the_machine(spark):
    from ledgerlens.llm.queries import op10_chat_format

    plan = op10_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(turns" in plan and "user>assistant" in plan


def test_no_conversations(spark):
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def documents(sizes):
    return [(i * 31 + k, name, f"t{i}", "x") for k, (name, n) in enumerate(sizes.items()) for i in range(n)]


SIZES = {"a": 400, "b": 90, "c": 33, None: 64, "d": 5}
MIX_WEIGHTS = {"a": 5, "b": 3, "c": 1}


def test_every_prefix_keeps_its_shares(spark):
    block = 4
    rows = documents(SIZES)
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, weight string")
    out = mix_sources(df, MIX_WEIGHTS, block_docs=block)
    assert out.columns[:4] == df.columns
    got = sorted(out.collect(), key=lambda r: r.mix_position)
    assert sorted((r.doc_id, r.source, r.text) for r in got) == sorted((i, s, t) for i, s, t, _ in rows) if None not in SIZES else len(got) == len(rows)
    assert len({r.mix_position for r in got}) == len(rows)
    weights = {s: MIX_WEIGHTS.get(s, 1) for s in SIZES}
    q = sum(weights.values())
    slots = {}
    for r in got:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
        assert slots.setdefault(r.mix_slot, r.source) == r.source
    exact = [s for s in sorted(slots) if any(r.mix_exact for r in got if r.mix_slot == s)]
    assert exact == list(range(len(exact))) and len(exact) >= q
    done = dict.fromkeys(weights, 0)
    for t, slot in enumerate(exact, 1):
        done[slots[slot]] += 1
        for s, w in weights.items():
            assert abs(done[s] - t * w / q) < 1


def test_mix_of_repeated_and_missing_ids(spark):
    rows = [(None, None, None), (None, None, None), (1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (2, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string")
    out = mix_sources(df, {}, block_docs=2)
    assert out.count() == 6 and out.select("mix_position").distinct().count() == 6
    assert mix_sources(df.filter("false"), {}).count() == 0


def test_weights_are_checked(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, source string")
    with pytest.raises(ValueError, match="positive"):
        mix_sources(df, {"a": 0})


def brute_schedule(weights):
    """Slot by slot: of the released blocks the one with the earliest deadline, ties by name."""
    q, names = sum(weights.values()), sorted(weights)
    done, out = dict.fromkeys(names, 0), set()
    for t in range(q):
        _, s = min((-(-(done[s] + 1) * q // weights[s]), s) for s in names if done[s] < weights[s] and done[s] * q // weights[s] <= t)
        out.add((s, done[s], t))
        done[s] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_schedule_by_brute_force(spark, seed):
    r = random.Random(seed)
    weights = {f"s{i:02}": r.choice([1, 1, 2, 3, r.randrange(1, 60)]) for i in range(r.choice([1, 2, 9, 30]))}
    targets = spark.createDataFrame(list(weights.items()), "source string, weight long")
    assert {(x.source, x.nth, x.slot) for x in schedule(targets).collect()} == brute_schedule(weights)


def test_any_number_of_sources_and_any_weights(spark):
    n, big = 20_000, {"=s0": 30_011, "=s1": 7}
    targets = spark.range(n).selectExpr("concat('=s', id) AS source").withColumn("weight", F.when(F.col("source") == "=s0", 30_011).when(F.col("source") == "=s1", 7).otherwise(1).cast("long"))
    q = n - 2 + sum(big.values())
    rows = schedule(targets).toPandas()
    assert sorted(rows.slot) == list(range(q))
    for name in ("=s0", "=s1", "=s19999"):
        own, w = rows[rows.source == name].sort_values("nth"), big.get(name, 1)
        assert own.nth.tolist() == list(range(w))
        assert all(j * q // w <= slot < -(-(j + 1) * q // w) for j, slot in zip(own.nth.tolist(), own.slot.tolist(), strict=True))
    df = spark.range(30_000).selectExpr("id AS doc_id", "concat('s', id % 20000) AS source")
    assert mix_sources(df, {"s0": 30_011, "s1": 7}).agg(F.count("*"), F.count_distinct("mix_position")).first()[:] == (30_000, 30_000)
