import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import queries, scratch
from ledgerlens.llm.quality_classifier import probabilities, train_quality
from ledgerlens.llm.source_mix import mix_sources

from .helpers import EDGES
from .test_dedup import WORD, brute_lines, brute_near

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    import pyarrow as pa

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    net = train_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = [(i, rows[i].text) for i in rows if probabilities(net, pa.array([rows[i].text]))[0] >= 0.7]
    cut = [(i, t) for i, _, _, t in brute_lines(good)]
    cut = [(i, t) for i, t in cut if t == (rows[i].text or "") or WORD.search(t)]
    own = {j for j, _, c in brute_near([(i, rows[i].text) for i, _ in cut]) if j == c}
    single = [(i, t) for i, t in cut if i in own]
    own = {j for j, _, c in brute_near(single) if j == c}
    single = [(i, t) for i, t in single if i in own]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, SF).collect()
    got = {r.doc_id: r.text for r in out}
    assert len(got) == len(out)
    # all passages of the benchmark in these tables are exact
    words = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    grams = {tuple(w[a : a + 13]) for _, t in items for w in [words(t)] for a in range(len(w) - 12)}
    hit = {i for i, t in single for w in [words(t)] if any(tuple(w[a : a + 13]) in grams for a in range(len(w) - 12))}
    wanted = {i: t for i, t in single if i not in hit}
    assert got == wanted
    assert all(r.n_chars == len(r.text) and r.source == rows[r.doc_id].source and r.lang == rows[r.doc_id].lang for r in out)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, SF)
        assert sorted(docs.columns) == sorted(corpus_pipeline.COLUMNS)
    assert {"doc_id", "text", "mix_position"} <= set(mix_sources(docs, queries.WEIGHTS).columns)


def test_one_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


STRANGE = [*[(i, t, "en", "src1", 3) for i, t in EDGES], (20, "once again\n" * 3, None, None, None), (21, "the same line of some words here", "en", None, 1)]


@pytest.fixture(scope="module")
def strange(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('strange')}"
    spark.createDataFrame(STRANGE, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{folder}/{table}.parquet")
    return folder


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_strange_rows(spark, strange, stage):
    """Null and empty texts, repeated rows, rows without an id, further columns with clashing names, and no rows at all."""
    docs = spark.read.parquet(f"{strange}/documents.parquet").withColumns({c: F.lit("x") for c in ("id", "kept_text", "rest", "n_dropped", "score", "mix_slot", "_row", "key", "block")})
    out = stage(spark, docs, strange).collect()
    ids = sorted(repr(r.doc_id) for r in out)
    if stage is corpus_pipeline.lines:
        assert {(r.doc_id, r.text, r.n_chars) for r in out if r.doc_id in (1, 2, 4, 6)} == {(1, "", 0), (2, "", 0), (4, "one", 3), (6, "other", 5)}
        assert 21 not in {r.doc_id for r in out}
    elif stage is corpus_pipeline.near:
        assert {r.doc_id for r in out} == {r[0] for r in STRANGE} - {21}  # three of the four shingles of 6
    elif stage is not corpus_pipeline.quality:
        assert ids == sorted(repr(r[0]) for r in STRANGE)
    assert stage(spark, docs.filter("false"), strange).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_collect_the_garbage_of_earlier_ones(spark, strange, stage):
    whole = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    stage(spark, spark.read.parquet(f"{strange}/documents.parquet").filter("false"), strange)
    assert whole() > before


def test_near_copies_go_whatever_line_dedup_has_left(spark, tmp_path):
    lines = [f"line {k} of a text with some more words in it" for k in range(30)]
    copy = [x if k != 7 else "a line of its own that no other text holds" for k, x in enumerate(lines)]
    texts = [(1, "\n".join(lines)), (2, "\n".join(copy)), (3, "\n".join(lines)), (4, "something else\n" + lines[3])]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = corpus_pipeline.lines(spark, spark.read.parquet(f"file://{tmp_path}/documents.parquet"), f"file://{tmp_path}")
    assert {r.doc_id: r.text for r in docs.collect()} == {1: texts[0][1], 2: copy[7], 4: "something else"}
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, f"file://{tmp_path}").collect()} == {1, 4}


def test_run_leaves_only_what_its_result_reads(spark):
    before = scratch.kept()
    corpus_pipeline.run(spark, SF)
    new = [p for p in scratch.kept() if p not in before]
    assert not [p for p in new if "sketches" in p or "blocks" in p or "quality_classifier" in p] and any("benchmark_decontamination" in p for p in new)


def test_the_drivers_garbage_is_collected_when_its_heap_has_grown(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if any(x in b.getName() for x in ("Old", "MarkSweep")))
    monkeypatch.setattr(scratch, "SWOLLEN", 0.0)
    before = full()
    assert scratch.keep(spark.range(3), "few").count() == 3
    assert full() > before
    monkeypatch.setattr(scratch, "SWOLLEN", 1.0)
    before = full()
    scratch.keep(spark.range(3), "few")
    assert full() == before


def test_tables_of_long_rows_are_written_and_read_in_small_parts(spark, tmp_path):
    import os

    import pyarrow.parquet as pq

    def blocks(batches):
        import pyarrow as pa

        for _ in batches:
            for _ in range(48):
                yield pa.record_batch({"payload": pa.array([os.urandom(1 << 20)], pa.binary())})

    scratch.keep(spark.range(0, 1, 1, 1).mapInArrow(blocks, "payload binary"), "long")
    groups = [f.metadata.row_group(k) for f in map(pq.ParquetFile, spark.read.parquet(scratch.kept()[-1]).inputFiles()[0].removeprefix("file://").split()) for k in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 48 and max(g.total_byte_size for g in groups) <= 20 << 20
    spark.range(0, 2000, 1, 1).write.parquet(f"file://{tmp_path}/many")
    scratch.tune(spark)
    scan = spark.read.parquet(f"file://{tmp_path}/many")._jdf.queryExecution().sparkPlan()
    assert scan.executeColumnar().count() >= 7
