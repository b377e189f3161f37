import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
CORE = [k for k in QUERIES if k != "pipeline" and not k.startswith("op")]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", [k for k in CORE if k in ORACLES])
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", [k for k in CORE if k not in ORACLES])
def test_queries_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_model_scores_are_of_the_whole_procedure(spark, monkeypatch):
    from ledgerlens.operators import models

    calls = []

    def fit(train, val, columns, **options):
        calls.append((train, val, columns, options))
        raise InterruptedError

    monkeypatch.setattr(models, "fit_ensemble", fit)
    with pytest.raises(InterruptedError):
        QUERIES["model_scores"](spark, SF)
    train, val, columns, options = calls[0]
    assert options == {}  # the defaults: three seeds, rounds and depth of the procedure
    assert len(columns) > 390 and {"tx_count_lifetime", "amount_mean_7d", "event_desc"} <= set(columns)
    assert {tuple(r) for r in train.select("split", "is_train").distinct().collect()} == {("train", 1)}
    assert {tuple(r) for r in val.select("split", "is_train", "is_labeled").distinct().collect()} == {("val", 1, 1)}


def test_all_buckets_of_the_whole_feature_table_come_back(spark):
    df = QUERIES["bucketed_roundtrip"](spark, SF)
    assert set(QUERIES["feature_build"](spark, SF).columns) <= set(df.columns)
    wanted = spark.read.parquet(f"{SF}/events.parquet").filter("ts >= '2024-01-08'").select("event_id")
    assert sorted(df.select("event_id").collect()) == sorted(wanted.collect())
    assert df.columns[:2] == ["event_id", "bucket"]
    assert {r.bucket for r in df.select("bucket").distinct().collect()} == {0, 1, 2, 3}
    one = df.filter("bucket = 1")
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_matrix_tells_missing_values_from_infinities(spark):
    from pyspark.ml.functions import vector_to_array

    from ledgerlens.operators import dataset

    df = spark.createDataFrame([(1, None, 7), (2, math.nan, None), (3, math.inf, 1), (4, -math.inf, 2), (5, -999.0, 3), (6, 0.5, 4)], "event_id long, x double, y int")
    rows = dataset.assemble(df, ["x", "y"], indicators=True).select("event_id", vector_to_array("features").alias("v")).collect()
    assert {r.event_id: r.v for r in rows} == {1: [-999, 7, 1, 0], 2: [-999, -999, 1, 1], 3: [-999, 1, 0, 0], 4: [-999, 2, 0, 0], 5: [-999, 3, 0, 0], 6: [0.5, 4, 0, 0]}
    rows = dataset.assemble(df, ["x", "y"]).select(vector_to_array("features").alias("v")).collect()
    assert all(len(r.v) == 2 for r in rows)


def test_a_result_stays_readable_when_its_query_runs_again(spark):
    first = QUERIES["score_output"](spark, SF)
    QUERIES["score_output"](spark, "/root/testdata/sf0.01")
    assert 0 < first.count() < 1000


def test_statistics_of_earlier_queries_are_not_kept(spark):
    QUERIES["freq_tables"](spark, SF)
    QUERIES["amount_stats_by_key"](spark, SF)
    from ledgerlens.plans import queries

    assert len(queries._held) == 1 and len(queries._held[0].kept) == 1


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 391 and df.count() > 0


def test_nothing_else_imports_the_llm_operators():
    root = Path(entry.__file__).parent
    for p in (root / "ledgerlens").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text()


def test_digest_of_a_wide_matrix_is_compiled(spark):
    """As many columns as the feature build has; with the fallback off, generated code that can't be compiled is an error."""
    from pyspark.sql import functions as F

    from ledgerlens.plans.queries import matrix_digest

    names = [f"c{i:03}" for i in range(401)]
    df = spark.range(4).select(F.col("id").alias("event_id"), *(F.when(F.col("id") != i % 5, (F.col("id") + 1) * (i + 0.125)).alias(c) for i, c in enumerate(names)))
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        rows = matrix_digest(df, names).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    shown = lambda x: math.floor((x + 1.37e-5) * 1e4 + 0.5) / 1e4
    wanted = {k: sum((1 + i % 97) * shown((k + 1) * (i + 0.125) if k != i % 5 else -999.0) for i in range(401)) for k in range(4)}
    assert {r.event_id: (r.width, r.digest) for r in rows} == {k: (802, v) for k, v in wanted.items()}
