import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import dataset, materialize, metrics, models, profile
from ledgerlens.sources import files

from .helpers import tx


def scored(spark, rows):
    return spark.createDataFrame(rows, "target int, score double")


def test_average_precision_by_hand(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.1), (0, None), (1, float("nan"))]
    # thresholds .9: P 1, R 1/3; .8: P 2/3, R 2/3; .3: no new recall; .1: P 3/5, R 1
    assert metrics.average_precision(scored(spark, rows)).first()[0] == pytest.approx(1 / 3 * (1 + 2 / 3 + 3 / 5))
    assert metrics.average_precision(scored(spark, [(0, 0.5)])).first()[0] == 0
    assert metrics.average_precision(scored(spark, [])).first()[0] == 0


def test_max_f1_and_report(spark):
    rows = scored(spark, [(1, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (0, 0.2)])
    best = metrics.max_f1(rows)
    assert best.first().asDict() == pytest.approx({"threshold": 0.6, "precision": 0.75, "recall": 1.0, "f1": 6 / 7})
    report = {r["class"]: r for r in metrics.classification_report(rows, best).collect()}
    assert (report["1"].precision, report["1"].recall, report["1"].support) == (0.75, 1.0, 3)
    assert (report["0"].precision, report["0"].recall, report["0"].support) == (1.0, 0.5, 2)
    assert report["macro"].f1 == pytest.approx((6 / 7 + 2 / 3) / 2) and report["weighted"].support == 5
    assert report["weighted"].recall == pytest.approx(0.8)
    assert metrics.max_f1(scored(spark, [])).count() == 0


def test_percentiles_interpolate(spark):
    got = {r.pct: r.score for r in metrics.score_percentiles(scored(spark, [(0, float(i)) for i in range(5)])).collect()}
    assert got == pytest.approx({0: 0, 25: 1, 50: 2, 75: 3, 90: 3.6, 95: 3.8, 99: 3.96, 100: 4})


def test_duplicates_count_null_once(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,), (None,)], "event_id long")
    assert tuple(metrics.duplicate_check(df).first()) == (5, 3, 2)


@pytest.mark.parametrize(("n_neg", "n_pos", "ratio", "kept"), [(200, 3, 0.05, 10), (200, 30, 0.05, 30), (5, 9, 0.05, 5), (200, 3, None, 200), (0, 3, 0.05, 0)])
def test_undersampling(spark, n_neg, n_pos, ratio, kept):
    rows = [(i, int(i < n_pos)) for i in range(n_neg + n_pos)]
    df = spark.createDataFrame(rows, "event_id long, target int")
    out = dataset.undersample(df, ratio)
    assert out.columns == df.columns
    got = {r.event_id: r.target for r in out.collect()}
    assert sum(got.values()) == n_pos and len(got) - n_pos == kept == out.filter("target = 0").count()
    assert got == {r.event_id: r.target for r in dataset.undersample(df.repartition(3), ratio).collect()}


def test_splits(spark):
    rows = tx(spark, [{"customer_id": 1, "event_id": i, "minutes": m} for i, m in [(1, 0), (2, 24 * 60), (3, 48 * 60), (4, None)]])
    got = {r.event_id: r.s for r in rows.select("event_id", dataset.split_of("2024-01-02 12:00:00", "2024-01-03 12:00:00").alias("s")).collect()}
    assert got == {1: "train", 2: "val", 3: "test", 4: None}


def test_labels_once_for_each_event(spark):
    rows = tx(spark, [{"customer_id": 1, "event_id": i} for i in (1, 2, 3)])
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 3, 0), (2, 2, 1)], "customer_id long, event_id long, target int")
    got = sorted((r.event_id, r.target, r.is_labeled) for r in dataset.with_labels(rows, labels).collect())
    assert got == [(1, 1, 1), (2, 0, 0), (3, 0, 1)]


def test_guards(spark):
    counts = lambda *rows: spark.createDataFrame(rows, "split string, model_group int, n_rows long, n_labeled long, n_positive long")
    dataset.check_splits(counts(("train", 0, 5, 1, 1), ("val", 0, 5, 1, 1), ("test", 0, 5, 0, 0)))
    with pytest.raises(ValueError, match="test part has no rows"):
        dataset.check_splits(counts(("train", 0, 5, 1, 1), ("val", 0, 5, 1, 1)))
    with pytest.raises(ValueError, match="no positives"):
        dataset.check_splits(counts(("train", 0, 5, 1, 1), ("val", 0, 5, 1, 0), ("test", 0, 5, 0, 0)))


@pytest.mark.parametrize("n", [1, 3, 7, 50])
def test_buckets_are_contiguous_chunks(spark, n):
    ids = [5, -3, 12, 2_000_001, 2_000_000, 7, 999_999_999_999]
    df = tx(spark, [{"customer_id": c, "event_id": e} for c in ids for e in (1, 2)])
    got = {r.customer_id: r.bucket for r in materialize.customer_buckets(df, n).collect()}
    size = -(-len(ids) // n)
    assert got == {c: i // size for i, c in enumerate(sorted(ids))}
    assert materialize.customer_buckets(df.filter("false"), n).count() == 0


def test_written_features(spark, tmp_path):
    rows = tx(spark, [{"customer_id": c, "event_id": 10 * c + e, "minutes": 60 * e, "is_train": e % 2} for c in range(5) for e in range(4)])
    materialize.write_features(rows, str(tmp_path / "f"), 2, train_only=True)
    back = files.read_parquet(spark, str(tmp_path / "f"))
    assert back.count() == 10 and back.filter("bucket = 0").select("customer_id").distinct().count() == 3
    kinds = dict(back.dtypes)
    assert kinds["customer_id"] == "bigint" and kinds["amount_mean_1d"] == "float" and kinds["tx_count_1d"] == "int"
    assert {r.tx_count_lifetime for r in back.collect()} == {1, 3}  # history has the other rows


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, 0.25)], "event_id long, predict double")
    files.write_csv(df, str(tmp_path / "s"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "s"), "event_id long, predict double").collect())) == [(1, 0.5), (2, 0.25)]


def test_routing(spark):
    df = spark.createDataFrame([(g, 0.1 * (g or 0)) for g in (0, 1, 2, 3, None)], "model_group int, s double")
    for unrouted in (0.0, None):
        got = [r[0] for r in df.select(models.route({1: F.col("s"), 2: F.col("s") * 2}, unrouted)).collect()]
        assert got == [unrouted, pytest.approx(0.1), pytest.approx(0.4), unrouted, unrouted]


def test_models(spark, tmp_path):
    rows = [(i, i % 3 if i % 3 < 2 else None, float(i % 10), int(i % 10 > 6), float("nan") if i % 7 == 0 else 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, model_group int, x double, target int, y double")
    one_class = df.withColumn("target", F.when(F.col("model_group") == 1, 0).otherwise(F.col("target")))
    fitted = models.fit_routed(one_class, df, ["x", "y"], seeds=(1, 2), rounds=3, depth=2, ratio=None)
    assert sorted(fitted.ensembles) == [0] and fitted.skipped == {1: "one class only", 2: "no rows", 3: "no rows"}
    out = fitted.score(df)
    assert out.count() == 300
    for r in out.collect():
        assert r.score == 0 if r.model_group != 0 else (r.score > 0.5) == (r.target == 1)
    ensemble = fitted.ensembles[0]
    assert ensemble.importance()[0][0] == "x"
    ensemble.save(str(tmp_path))
    again = models.Ensemble.load(str(tmp_path), ["x", "y"], seeds=2)
    assert [r.score for r in again.score(df).orderBy("event_id").collect()] == [r.score for r in ensemble.score(df).orderBy("event_id").collect()]


def test_profiles(spark):
    rows = tx(spark, [{"customer_id": 1, "event_id": i, "event_desc": d, "operaton_amt": a, "mcc_code": m} for i, (d, a, m) in enumerate([(1, None, None), (1, 5.0, None), (2, 5.0, "9"), (2, 5.0, "9"), (None, 1.0, "9")])])
    from ledgerlens.operators.stats import labelled
    from ledgerlens.operators.transaction import tx_type_group

    rows = rows.withColumn("tx_type_group", tx_type_group())
    known = labelled(rows, spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 1)], "customer_id long, event_id long, target int"))
    got = [(r.event_desc, r.total_count, r.tx_type_group_mode, r.fraud_rate_pct) for r in profile.value_counts(rows, known, "event_desc").collect()]
    assert got == [(1, 2, 0, 50.0), (2, 2, 1, 100.0), (None, 1, None, None)]
    shares = {r.event_desc: (r.nonpayment, r.card, r.p2p) for r in profile.crosstab(rows, "event_desc").collect()}
    assert shares == {1: (0.5, 0.0, 0.5), 2: (0.0, 1.0, 0.0), None: (0.0, 1.0, 0.0)}
    top = profile.top_rates(profile.pair_stats(rows, known), 1, 1, by="tx_type_group").collect()
    assert sorted((r.tx_type_group, r.event_desc) for r in top) == [(0, 1), (1, 2), (2, 1)]


def test_training_from_end_to_end(spark):
    from ledgerlens.plans.training import train_baseline
    from ledgerlens.sources import adapters

    raw = adapters.events(spark, "/root/testdata/sf0.01")
    from ledgerlens.operators.transaction import transaction_features

    features = transaction_features(adapters.transactions(raw)).drop("_us", "amount_clean")
    out = train_baseline(features, adapters.event_labels(raw), adapters.CUTOFF, adapters.END, seeds=(42,), rounds=3, depth=4)
    assert sorted(out.routed.ensembles) == [0, 1, 2, 3] and all(0 < p <= 1 for p in out.precision.values())
    assert out.precision[None] > 0.35  # the share of positives is 0.2
    assert tuple(metrics.duplicate_check(out.submission).first()) == (1661, 1661, 0)
    with pytest.raises(ValueError, match="has no rows"):
        train_baseline(features, adapters.event_labels(raw), "2023-01-01", "2023-01-02")


def test_archive_and_cache(spark, tmp_path):
    folder = tmp_path / "models"
    assert files.archive(spark, str(folder)) is None
    for n in (1, 2):
        folder.mkdir()
        assert files.archive(spark, str(folder)) == f"{folder}_ver_{n}"
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    assert [files.cached(spark, str(tmp_path / "c"), meta, build).count() for meta in ("a", "a", "b")] == [1, 1, 2]


def test_durations():
    from ledgerlens.session import fmt_seconds

    assert [fmt_seconds(s) for s in (0, 61, 3599.6, 7325)] == ["0:00", "1:01", "1:00:00", "2:02:05"]


@pytest.mark.parametrize("scores", [[], [0.5], [0.25, 0.25, 0.75], [i / 7 for i in range(50)], [1e-9 * i for i in range(60)] + [-3.5, 2e12, -2e12, 0.0, -0.0]])
def test_running_sums_by_levels(spark, scores):
    """Scores that pile up near 0, lie outside 0 to 1, or repeat."""
    import numpy as np

    df = spark.createDataFrame([(i % 2, s) for i, s in enumerate(scores)] + [(1, None), (0, math.nan)], "target int, score double")
    rows = {r.score + 0.0: (r.tp, r.fp, r.positives) for r in metrics.thresholds(df).collect()}
    both = list(enumerate(scores))
    assert rows == {s + 0.0: (sum(i % 2 for i, x in both if x >= s), sum(1 - i % 2 for i, x in both if x >= s), sum(i % 2 for i, _ in both)) for s in scores}
    found = {r.pct: r.score for r in metrics.score_percentiles(df).collect()}
    assert len(found) == 8
    for pct, score in found.items():
        assert score is None if not scores else math.isclose(score, float(np.percentile(scores, pct)), rel_tol=1e-9, abs_tol=1e-12)


def test_buckets_of_sparse_ids(spark):
    ids = [-(2**62), -5, 0, 1, 2, 3, 2**20, 2**20 + 1, 2**40, 2**41 + 7, 2**62]
    df = spark.createDataFrame([(i,) for i in ids * 2] + [(None,)], "customer_id long")
    assert {r.customer_id: r.bucket for r in materialize.customer_buckets(df, 4).collect()} == {i: k // 3 for k, i in enumerate(ids)}


def test_seeds_and_segments_are_fitted_at_the_same_time(spark, monkeypatch):
    """Two segments of two seeds each: their four fits have all begun before any of them goes on."""
    import threading

    met, fit = threading.Barrier(4), models.GBTClassifier.fit

    def meeting(self, rows):
        met.wait(120)
        return fit(self, rows)

    monkeypatch.setattr(models.GBTClassifier, "fit", meeting)
    df = spark.createDataFrame([(i, i % 2, float(i % 10), int(i % 10 > 6)) for i in range(200)], "event_id long, model_group int, x double, target int")
    fitted = models.fit_routed(df, df, ["x"], seeds=(1, 2), rounds=2, depth=2)
    assert sorted(fitted.ensembles) == [0, 1] and all(len(e.boosted) == 2 for e in fitted.ensembles.values())
    assert all((r.score > 0.5) == (r.target == 1) for r in fitted.score(df).collect())


@pytest.mark.parametrize(("n_neg", "n_pos", "ratio"), [(400, 7, 0.05), (30, 40, 0.05), (300, 0, 0.1), (5, 0, 0.1), (50, 3, None)])
def test_samples_of_all_seeds_in_one_pass(spark, n_neg, n_pos, ratio):
    df = spark.createDataFrame([(i * 37, int(i >= n_neg)) for i in range(n_neg + n_pos)], "event_id long, target int").repartition(3)
    for seed, condition in zip((42, 7), dataset.undersampling(df, ratio, (42, 7)), strict=True):
        assert sorted(df.filter(condition).collect()) == sorted(dataset.undersample(df, ratio, seed).collect())


def test_a_segment_is_assembled_once_for_all_learners(spark, monkeypatch):
    """Training and validation rows once each, whatever the number of seeds; rows that have their vectors are taken as they are."""
    calls, plain = [], models.assemble
    monkeypatch.setattr(models, "assemble", lambda *a, **k: calls.append(1) or plain(*a, **k))
    df = spark.createDataFrame([(i, 0, float(i % 10), int(i % 10 > 6)) for i in range(200)], "event_id long, model_group int, x double, target int")
    for rows, most in ((df, 2), (plain(df, ["x"]), 0)):
        calls.clear()
        ensemble = models.fit_ensemble(rows, rows, ["x"], seeds=(1, 2), rounds=2, depth=2)
        assert len(calls) == most
        assert all((r.score > 0.5) == (r.target == 1) for r in ensemble.score(rows).collect())
        assert models.Routed({0: ensemble}).score(rows).count() == 200  # with or without vectors of their own
