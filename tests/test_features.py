import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import expr as X
from ledgerlens.operators import rolling, transaction
from ledgerlens.operators.stats import Stats, compute_stats
from ledgerlens.plans.features import build_features, engineered
from ledgerlens.sources import adapters

from .helpers import by_id, tx

DAY = 24 * 60


@pytest.fixture(scope="module")
def sample(spark):
    raw = adapters.events(spark, "/root/testdata/sf0.001").persist()
    return adapters.transactions(raw), adapters.event_labels(raw)


def test_390_columns(sample):
    built = build_features(sample[0])
    assert len(engineered(sample[0], built)) == 390
    assert built.columns[: len(sample[0].columns)] == sample[0].columns
    assert not [c for c in built.columns if c.startswith("_")]


def test_single_event(spark):
    row = by_id(build_features(tx(spark, [{"customer_id": 1, "event_id": 1}])))[1]
    assert (row.tx_count_lifetime, row.time_since_last_tx_minutes, row.session_tx_count) == (0, 0, 0)
    assert (row.merchant_last_seen_days, row.mcc_last_seen_days, row.event_desc_last_seen_days) == (999, 999, 999)
    assert [getattr(row, f"prev_{n}_op_type") for n in range(1, 6)] == [-1] * 5
    assert (row.event_desc_amount_mean_user, row.event_desc_amount_std_user, row.operaton_amt_max_prev) == (0, 0, 0)
    assert row.amount_mean_1h is None and row.cumulative_spend_1h == 0 and row.tx_count_90d == 0 and row.channel_diversity_1d == 0
    assert math.isnan(row.mcc_transaction_share_user) and row.mcc_is_new_for_user == 1 and row.time_since_last_3_tx_mean is None
    assert row.amount_zscore_given_event_desc == pytest.approx(10 / 1e-9)
    assert row.event_desc_target_enc == 0.5 and row.amount_zscore_pos_global == 0


def test_window_bounds_and_ties(spark):
    rows = [{"customer_id": 1, "event_id": i, "minutes": m, "operaton_amt": float(i)} for i, m in [(1, 0), (2, 15), (3, 15), (4, 16), (5, 75)]]
    out = by_id(build_features(tx(spark, rows)))
    assert [out[i].tx_count_15m for i in range(1, 6)] == [0, 1, 1, 2, 0]  # the row exactly 15 minutes before counts, ties don't
    assert [out[i].cumulative_spend_1h for i in range(1, 6)] == [0, 1, 1, 6, 9]
    assert [out[i].tx_count_lifetime for i in range(1, 6)] == [0, 1, 2, 3, 4]
    assert out[4].amount_median_15m == 2.5 and out[4].amount_std_15m == pytest.approx(math.sqrt(0.5))
    assert out[5].time_since_last_3_tx_mean == pytest.approx((0 + 1 + 59) / 3)


def test_customers_are_apart(spark):
    rows = [{"customer_id": i % 2, "event_id": i, "minutes": 30 * i, "operaton_amt": 10.0 * i} for i in range(8)]
    both, alone = (by_id(build_features(tx(spark, [dict(r) for r in rows if keep(r)]))) for keep in (lambda r: True, lambda r: r["customer_id"] == 1))
    assert all(same(both[i], alone[i]) for i in alone)
    assert both[3].circadian_deviation_score == pytest.approx(abs(13 - 12))


def same(a, b):
    return all(x == y or (x is not None and y is not None and (x != x and y != y or x == pytest.approx(y, rel=1e-9, abs=1e-9))) for x, y in zip(a, b, strict=True))


def test_nulls(spark):
    rows = [
        {"customer_id": 1, "event_id": 1, "mcc_code": None, "operaton_amt": None, "event_type_nm": None, "channel_indicator_type": None, "session_id": None, "timezone": None, "battery": None, "screen_size": None},
        {"customer_id": 1, "event_id": 2, "minutes": 1, "mcc_code": "", "channel_indicator_type": None, "session_id": None, "battery": "12.5 %", "screen_size": "720x1280"},
        {"customer_id": 1, "event_id": 3, "minutes": 2, "mcc_code": "51", "channel_indicator_type": 6, "battery": "unknown", "developer_tools": "true", "web_rdp_connection": 1},
        {"customer_id": 1, "event_id": 4, "minutes": None},
    ]
    out = by_id(build_features(tx(spark, rows)))
    assert [out[i].tx_type_group for i in (1, 2, 3)] == [0, 2, 1]
    assert [out[i].model_group for i in (1, 2, 3)] == [3, 3, 2]
    assert out[1].amount_missing_flag == 1 and out[1].amount_abs == 0
    assert out[3].channel_diversity_1h == 1 and out[3].merchant_diversity_1h == 2  # null is one value
    assert (out[1].mcc_is_new_for_user, out[2].mcc_is_new_for_user) == (0, 1)
    assert (out[2].session_tx_count, out[3].session_tx_count) == (1, 1)  # nulls are one session; the event without a time comes first
    assert [out[i].low_battery_flag for i in (1, 2, 3)] == [0, 1, 0]
    assert (out[1].screen_w, out[2].screen_w, out[2].screen_h) == (0, 720, 1280)
    assert out[3].device_risk_score == 5 and out[3].suspicious_env_flag == 1
    assert out[1].is_high_risk_channel is None and out[3].is_high_risk_channel == 1
    assert out[4].tx_count_1d == 0 and out[4].amount_mean_1d is None and out[4].hour is None


def test_log_of_negative_amounts(spark):
    rows = [{"customer_id": 1, "event_id": i, "operaton_amt": a} for i, a in enumerate([-1.0, -2.0, 0.0])]
    out = by_id(transaction.transaction_features(tx(spark, rows)))
    assert out[0].log_amount == -math.inf and math.isnan(out[1].log_amount) and out[2].log_amount == 0


def test_lag_over_null_and_flags(spark):
    rows = [{"customer_id": 1, "event_id": i, "minutes": i * DAY, "pos_cd": p} for i, p in enumerate([None, None, 3, 3, 4])]
    out = by_id(build_features(tx(spark, rows)))
    assert [out[i].pos_cd_prev for i in range(5)] == [0, 0, 0, 1, 0]
    assert [out[i].pos_last_seen_days for i in range(5)] == [999, 1, 999, 1, 999]
    assert [out[i].pos_cd_is_new for i in range(5)] == [0, 0, 1, 0, 1]


def test_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (6.0, 3.0), (float("nan"), 0.0)], "a double, b double")
    got = [r[0] for r in df.select(X.fdiv("a", "b")).collect()]
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and got[3:6] == [None, None, 2.0] and math.isnan(got[6])


def test_later_events_change_nothing(spark, sample):
    cut = "2024-01-15"
    early = sample[0].filter(F.col("event_dttm") < F.lit(cut).cast("timestamp_ntz"))
    whole, part = by_id(build_features(sample[0])), by_id(build_features(early))
    assert len(part) > 50 and all(same(whole[i], part[i]) for i in part)


def test_partitioning_changes_nothing(sample):
    one, many = (by_id(build_features(sample[0], partitions=n)) for n in (1, 7))
    assert all(same(one[i], many[i]) for i in one)


def test_windows_are_nested(sample):
    rows = rolling.with_windows(transaction.transaction_features(sample[0])).collect()
    periods = list(X.PERIODS)
    for r in rows:
        counts = [r[f"tx_count_{p}"] for p in periods]
        assert counts == sorted(counts)
        for p in periods:
            assert r[f"cumulative_spend_{p}"] == pytest.approx(r[f"card_spend_{p}"] + r[f"p2p_spend_{p}"])


def test_one_shuffle_by_customer(spark, sample):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = build_features(sample[0])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_stats_survive_a_round_trip(spark, sample, tmp_path):
    found = compute_stats(*sample)
    assert len(found.tables) == 25
    found.save(str(tmp_path))
    again = Stats.load(spark, str(tmp_path))
    a, b = (by_id(build_features(sample[0], s)) for s in (found, again))
    assert all(same(a[i], b[i]) for i in a)
    found.release()


def test_stats_up_to_a_time(sample):
    late = compute_stats(*sample, as_of="2024-01-10")["evtype_global"]
    assert late.agg(F.sum("global_event_type_freq")).first()[0] == sample[0].filter("event_dttm < timestamp_ntz'2024-01-10'").count()


def test_text_times(spark, sample):
    text = sample[0].withColumn("event_dttm", F.when(F.col("event_id") % 9 == 0, "no time").otherwise(F.col("event_dttm").cast("string")))
    rows = transaction.transaction_features(text)
    assert rows.filter("event_dttm IS NULL").count() == rows.filter("event_id % 9 = 0").count()


def test_empty_table(sample):
    assert build_features(sample[0].filter("false"), compute_stats(sample[0].filter("false"), sample[1])).count() == 0


def test_parts_follow_the_size_of_the_tables(spark, tmp_path, monkeypatch):
    from ledgerlens.plans import features

    local = tx(spark, [{"customer_id": 1, "event_id": 1}])
    parts = lambda df: features.by_customer(df).rdd.getNumPartitions()
    assert features.bytes_read(local) == 0 and parts(local) == 4  # spark.sql.shuffle.partitions
    spark.range(100_000).selectExpr("id AS customer_id", "id % 7 AS x").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    size = features.bytes_read(table)
    assert size > 100_000 and features.bytes_read(table.join(table.withColumnRenamed("x", "y"), "customer_id")) == 2 * size
    assert features.bytes_read(table.unionByName(local.select("customer_id"), allowMissingColumns=True)) == size
    monkeypatch.setattr(features, "PART_BYTES", size)
    assert parts(table) == features.GROWTH
