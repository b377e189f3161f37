"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's documents, in an order shuffled by hash, are cut into blocks.  With weights
that add up to Q, block j (from 0) of a source of weight w is released at slot floor(j * Q / w) and
due by slot ceil((j + 1) * Q / w).  In every slot the released block with the earliest
deadline runs (ties: by source name).  The shares add up to one, so each block runs within its window, and after
any number of slots every source is less than one block away from its target share.

The schedule repeats after Q slots, so one period is simulated, and a document's slot follows from its rank in its source by
arithmetic.  Sources of equal weight have equal windows and run by name, so the state is one number for each distinct weight, and a run of blocks
of one weight is one step, up to the next release.  A step for each slot is needed only where blocks of different weights are due
at the same time; there are at most Q steps.
Ranks come from counts of (source, hash range) groups of about 5,000 rows, so no
source, however large, is sorted or counted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from . import scratch

BLOCK_DOCS, GROUP_ROWS, GROUPS_AT_ONCE, STEPS_AT_ONCE = 32, 5_000, 4_096, 1_000


def target_weights(sources: DataFrame, weights: dict[str, int], default_weight: int) -> DataFrame:
    """(source, weight) for each distinct source."""
    if default_weight < 1 or any(int(w) < 1 for w in weights.values()):
        raise ValueError("weights are positive integers")
    known = F.create_map(*(F.lit(x) for name, w in weights.items() for x in (f"={name}", int(w)))) if weights else None
    weight = F.coalesce(known[F.col("source")], F.lit(default_weight)) if weights else F.lit(default_weight)
    return sources.select("source").distinct().withColumn("weight", weight.cast("long"))


_RUN = "struct<w: bigint, m: bigint, done: bigint, n: bigint, t: bigint>"
#: For each weight: when its next block is due and by which source, which weight it is, how many blocks share that window, and when they are released.
_NEXT = """transform(c, (x, i) -> named_struct('due', ((a.done[i] div x.m + 1) * q + x.w - 1) div x.w, 'place', x.places[int(a.done[i] % x.m)], 'i', i,
    'left', x.m - a.done[i] % x.m, 'released', (a.done[i] div x.m) * q div x.w, 'over', a.done[i] >= x.m * x.w))"""
#: The weight with the earliest deadline runs until its window's blocks are done or another weight's are released; one block, if another is due at the same time.
_STEP = f"""transform(array({_NEXT}), s -> transform(array(array_min(filter(s, y -> y.released <= a.t AND NOT y.over))), p -> transform(array(
    IF(exists(s, y -> y.i <> p.i AND y.due = p.due AND y.released <= a.t AND NOT y.over), 1L,
       least(p.left, coalesce(array_min(transform(filter(s, y -> y.released > a.t AND NOT y.over), y -> y.released)), q) - a.t))),
    n -> named_struct('t', a.t + n, 'done', transform(a.done, (d, i) -> IF(i = p.i, d + n, d)),
        'ran', array_append(a.ran, named_struct('w', c[p.i].w, 'm', c[p.i].m, 'done', a.done[p.i], 'n', n, 't', a.t))))[0])[0])[0]"""
_STEPS = f"aggregate(sequence(1, {STEPS_AT_ONCE}), named_struct('t', o.t, 'done', o.done, 'ran', cast(array() AS array<{_RUN}>)), (a, _) -> IF(a.t >= q, a, {_STEP}))"
#: Lists of runs; what has been appended to is copied, so it is kept short.
_RUNS = f"""aggregate(sequence(1, int((q - 1) div {STEPS_AT_ONCE} + 1)), named_struct('t', 0L, 'done', transform(c, x -> 0L), 'ran', cast(array() AS array<array<{_RUN}>>)),
    (o, _) -> IF(o.t >= q, o, transform(array({_STEPS}), r -> named_struct('t', r.t, 'done', r.done, 'ran', array_append(o.ran, r.ran)))[0])).ran"""


def schedule(targets: DataFrame) -> DataFrame:
    """(source, nth, slot): where in a period the nth block of each source runs."""
    named = targets.withColumns({"place": F.row_number().over(Win.orderBy("source")), "n": F.row_number().over(Win.partitionBy("weight").orderBy("source")) - 1})
    each = named.groupBy("weight").agg(F.count("*").alias("m"), F.sort_array(F.collect_list("place")).alias("places"))
    one = each.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("weight").alias("w"), "m", "places"))).alias("c"), F.sum(F.col("weight") * F.col("m")).alias("q"))
    runs = one.filter("q > 0").select(F.explode(F.expr(_RUNS)).alias("runs")).select(F.explode("runs").alias("run")).select("run.*")
    blocks = runs.select("w", "m", "t", "done", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    blocks = blocks.select(F.col("w").alias("weight"), F.pmod(F.col("done") + F.col("k"), "m").alias("n"), F.floor((F.col("done") + F.col("k")) / F.col("m")).alias("nth"), (F.col("t") + F.col("k")).alias("slot"))
    return blocks.join(named, ["weight", "n"]).select("source", "nth", "slot")


def counts_before(counts: DataFrame) -> DataFrame:
    """(source, _group, _before): the rows of a source in earlier groups; no window holds more than GROUPS_AT_ONCE groups, or totals of so many."""
    far = F.floor(F.col("_group") / GROUPS_AT_ONCE)
    earlier = lambda n, over: F.coalesce(F.sum(n).over(over.rowsBetween(Win.unboundedPreceding, -1)), F.lit(0))
    totals = counts.groupBy("source", far.alias("_far")).agg(F.sum("_n").alias("_n")).select("source", "_far", earlier("_n", Win.partitionBy("source").orderBy("_far")).alias("_more"))
    near = counts.withColumn("_far", far).withColumn("_before", earlier("_n", Win.partitionBy("source", "_far").orderBy("_group")))
    return near.join(totals, ["source", "_far"]).select("source", "_group", (F.col("_before") + F.col("_more")).alias("_before"))


def mix_sources(docs: DataFrame, weights: dict[str, int], default_weight: int = 1, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns of docs with mix_block, mix_release, mix_deadline, mix_slot, mix_position and mix_exact.

    Reading by mix_position gives the mix; positions are unique, and have gaps where a source has run out.  mix_exact tells that the
    slot comes before the first slot that a source can no longer fill with a whole block: up to there the deviation
    is below one block.  All rows are returned, once.

    weights maps sources to positive integers; others get default_weight.  There may be any number of sources; one task holds the names' ranks and
    simulates a period.  A null source is a source of its own.  Within a source rows are ordered by the MD5 of their id, or of the whole row if
    that is null, then by a hash of the whole row, so repeated rows get positions of their own.  An empty table gives an empty result.  Columns of
    docs named mix_* are replaced.
    """
    new = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position", "mix_exact"]
    row = docs.select([c for c in docs.columns if c not in new])
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))  # never null
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.to_json(F.struct(*row.columns))))
    groups = max(1, -(-docs.count() // GROUP_ROWS))
    group = F.floor(F.conv(F.substring(F.col("_order"), 1, 8), 16, 10).cast("long") * groups / (1 << 32))
    keyed = row.select(F.struct(*row.columns).alias("_row"), source.alias("source"), order.alias("_order")).withColumn("_group", group)
    counts = scratch.keep(keyed.groupBy("source", "_group").agg(F.count("*").alias("_n")), "counts")
    targets = scratch.keep(target_weights(counts, weights, default_weight), "targets")
    period = targets.agg(F.sum("weight")).first()[0] or 1
    slots = scratch.keep(schedule(targets), "slots", period)

    def placed(df: DataFrame, block: str) -> DataFrame:
        here = (F.col("d.source") == F.col("s.source")) & (F.pmod(F.col(f"d.{block}"), F.col("d.weight")) == F.col("s.nth"))
        return df.alias("d").join(slots.alias("s"), here).select("d.*", (F.floor(F.col(f"d.{block}") / F.col("d.weight")) * period + F.col("s.slot")).alias("mix_slot"))

    about = scratch.keep(counts_before(counts).join(targets, "source"), "before").select(F.col("source").alias("_s"), F.col("_group").alias("_g"), "_before", "weight")
    ranked = keyed.withColumn("_in", F.row_number().over(Win.partitionBy("source", "_group").orderBy("_order", F.xxhash64(F.to_json("_row")))) - 1)
    ranked = ranked.join(about, (F.col("source") == F.col("_s")) & (F.col("_group") == F.col("_g"))).withColumn("_rank", F.col("_before") + F.col("_in"))
    out = placed(ranked.withColumn("mix_block", F.floor(F.col("_rank") / block_docs)), "mix_block")
    short = placed(counts.groupBy("source").agg(F.floor(F.sum("_n") / block_docs).alias("whole")).join(targets, "source"), "whole").agg(F.min("mix_slot")).first()[0]
    return out.select(
        "_row.*",
        "mix_block",
        F.floor(F.col("mix_block") * period / F.col("weight")).alias("mix_release"),
        F.ceil((F.col("mix_block") + 1) * period / F.col("weight")).alias("mix_deadline"),
        "mix_slot",
        (F.col("mix_slot") * block_docs + F.pmod("_rank", F.lit(block_docs))).alias("mix_position"),
        (F.col("mix_slot") < F.lit(short or 0)).alias("mix_exact"),
    )
