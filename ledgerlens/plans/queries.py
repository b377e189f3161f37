"""Registered queries over the driver's tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions import expr as X
from ledgerlens.operators import behavior, category, dataset, device, materialize, metrics, models, profile, rolling, stats, temporal, transaction, zscore
from ledgerlens.operators.history import with_history
from ledgerlens.plans import oracle as O
from ledgerlens.plans.features import build_features, by_customer, engineered
from ledgerlens.sources import adapters, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CUTOFF, END = adapters.CUTOFF, adapters.END


def _add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


def _query(sql: str | None = None):
    def add(f):
        _add(f.__name__, f, sql)
        return f

    return add


def _with(sql: str) -> str:
    return f"WITH {O.TX}, {sql}" if sql.lstrip()[:1] != "S" else f"WITH {O.TX} {sql}"


class Data:
    """The frames that queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.raw = adapters.events(spark, sf_dir)
        self.tx = adapters.transactions(self.raw)
        self.labels = adapters.event_labels(self.raw)

    def grouped(self) -> DataFrame:
        return self.tx.withColumn("tx_type_group", transaction.tx_type_group())

    def labelled(self) -> DataFrame:
        return stats.labelled(self.grouped(), self.labels)

    def base(self) -> DataFrame:
        return transaction.transaction_features(self.tx)

    def split(self) -> DataFrame:
        return dataset.with_labels(self.base(), self.labels).withColumn("split", dataset.split_of(CUTOFF, END))

    def scored(self) -> DataFrame:
        """Labelled validation events with the pseudo score."""
        rows = self.split().filter("split = 'val' AND is_labeled = 1").select("event_id", "target", "model_group")
        return rows.join(adapters.pseudo_score(self.raw), "event_id")


def _shown(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("event_id", *(X.finite(c).alias(c) for c in columns))


_held: list[stats.Stats] = []


def _stats(data: Data, only: list[str] | None = None, **options) -> stats.Stats:
    """Statistics, kept in memory until the next query's."""
    found = stats.compute_stats(data.tx, data.labels, only=only, **options)
    before, _held[:] = _held[:], [found]
    for one in before:
        one.release()
    return found


def _features(name: str, columns: list[str], upto: str, tables: list[str] | None = None, source: str | None = None) -> None:
    """A query of some columns of the feature sections up to one; only the windows that they need are evaluated, and only the named tables of statistics are made and joined."""
    steps = [("B", behavior.behavior_features), ("D", rolling.rolling_features), ("E", device.device_features), ("F", temporal.temporal_features), ("G", zscore.zscore_features), ("H", category.category_features)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = Data(spark, sf_dir)
        found = _stats(data, tables) if tables else None
        df = by_customer(data.base())
        for letter, step in steps:
            if letter <= upto:
                df = step(df, found) if letter in "FGH" else step(df)
        return _shown(transaction.risk_features(df) if upto >= "J" else df, columns)

    _add(name, run, O.features_sql(columns, source or ("features" if tables else "two")))


# ---- scans, predicates and scalar columns

_add("scan_events", lambda s, d: files.read_parquet(s, f"{d}/events.parquet", columns=["event_id", "user_id", "event_type", "value"]), "SELECT event_id, user_id, event_type, value FROM events")
_CALENDAR = ["hour", "day_of_week", "day_of_month", "week_of_year", "hour_of_day", "is_weekend", "is_night", "is_working_hour", "minutes_from_midnight", "is_month_start", "is_month_end", "is_payday", "is_holiday"]
_AMOUNT = ["log_amount", "amount_abs", "amount_round_100", "amount_round_1000", "amount_is_integer", "amount_missing_flag", "amount_currency_mismatch_flag", "amount_usd_normalized", "amount_card", "amount_p2p"]
for _name, _columns in {"calendar_flags": _CALENDAR, "amount_flags": _AMOUNT, "tx_type_group": ["tx_type_group"], "model_group": ["tx_type_group", "model_group"]}.items():
    _add(_name, lambda s, d, c=_columns: _shown(Data(s, d).base(), c), O.features_sql(_columns, "a"))
_RISK = list(O.RISK)
_add("risk_flags", lambda s, d: _shown(transaction.risk_features(Data(s, d).base()), _RISK), O.features_sql(_RISK, "features"))

# ---- history features

_features("prior_counts", ["tx_count_lifetime", "event_type_user_freq", "event_desc_user_freq"], "B")
_features("prior_value_counts", [c for c in O.ONE if c.endswith("_log_count")] + ["mcc_freq_user_cum", "pos_freq_user_cum", "mcc_frequency_user", "mcc_is_new_for_user", "pos_cd_is_new", "event_desc_is_new_for_user", "event_type_is_new_for_user", "mcc_transaction_share_user", "pos_cd_transaction_share_user", "event_desc_share_user"], "B")
_features("prior_max", [c for c in O.ONE if c.endswith("_max_prev")], "B")
_features("lag_sequence", [c for c in O.ONE if c.startswith("prev_")], "B")
_features("time_gaps", ["time_since_last_tx_minutes", "prev_1_op_timediff", "time_since_last_3_tx_mean"], "B")
_features("change_flags", ["merchant_switch_flag", "pos_cd_prev", "currency_iso_cd_prev", "channel_shift_score", "language_change_flag", "os_change_flag", "timezone_change_flag", "geo_jump_proxy"], "G")
_features("lag_diff_ratio", ["amount_diff_from_prev", "amount_ratio_prev"], "D")
_features("rolling_ratios", [c for c in O.TWO if "_ratio_" in c or "_fraction_" in c or "percentile" in c or "velocity_" in c or c.startswith(("burst", "amount_top", "amount_above", "avg_tx"))] + ["channel_usage_share", "spend_in_channel_lifetime", "tx_count_in_channel_lifetime"], "F")
_features("device_flags", ["compromised_flag", "web_rdp_connection_flag", "developer_tools_flag", "phone_voip_call_flag", "low_battery_flag", "operating_system_is_new", "os_version_is_new", "screen_size_is_new", "timezone_is_new", "accept_language_is_new", "device_risk_score", "screen_w", "screen_h", "compromised_x_amount_ratio"], "E")
_features("session_features", ["session_tx_count", "session_amount_sum", "session_channel_diversity", "session_length_estimate", "session_mcc_switch", "session_duration_minutes", "pause_ses", "session_avg_amount", "rdp_x_session_depth"], "E")
_features("language_mismatch", ["language_mismatch", "browser_language_mismatch", "timezone_mismatch"], "G")
_features("row_rolling", ["time_gap_variance_30d", "time_gap_mean_30d", "time_gap_min_10tx", "tx_time_zscore_given_user"], "F")
_features("circadian", ["circadian_deviation_score"], "F")
_features("last_seen_days", [c for c in O.ONE if c.endswith("_last_seen_days")], "H")
_features("prior_spend", [v[0] for v in O._CAT.values()] + [c for c in O.TWO if c.endswith(("_spend_share_user", "_spend_vs_90d", "type_spend_share"))], "H")
_features("prior_mean", [v[1] for v in O._CAT.values()] + ["amount_zscore_given_channel", "amount_zscore_given_mcc", "amount_zscore_given_device"], "H")
_features("prior_std", [v[2] for v in O._CAT.values()] + [f"amount_zscore_given_{s}" for s in ("event_desc", "event_type", "subchannel", "pos", "tx_type")], "H")
_features("category_novelty", [c for c in O.ONE if c.endswith("_combo")] + ["is_new_subchannel_for_user", "tx_count_in_subchannel_lifetime", "subchannel_usage_share", "tx_count_in_tx_type_lifetime", "tx_type_usage_share", "channel_indicator_sub_type_log_count"], "H")
_features("composite_flags", ["device_change_and_large_amount_flag", "voip_and_new_mcc_flag", "compromised_and_high_amount_flag", "session_first_tx_flag", "session_first_tx_large_flag", "rapid_sequence_flag", "device_entropy_ratio", "new_device_and_night_flag", "rdp_and_large_amount_flag", "velocity_change_flag", "new_device_flag", "new_mcc_flag", "new_channel_flag", "merchant_entropy_user"], "G")
_features("global_freq_lookup", [o for _, o in O._FREQ.values()] + ["mcc_rare_global_flag"], "G", list(temporal.FREQUENCIES))
_features("zscore_global", ["amount_zscore_channel", "amount_zscore_mcc", "suspicious_env_flag", "time_gap_cv_30d"], "G", ["channel_stats_global", "mcc_stats_global"])
_features("combination_freq", ["global_combination_freq", "rare_combination_flag"], "G", ["combination_global"])
_SCORES = [*(f"amount_zscore_{s}_global" for s in ("event_desc", "event_type", "subchannel", "pos")), "global_subchannel_freq"]
_add("category_global_zscore", lambda s, d: _shown(category.global_scores((x := Data(s, d)).base(), _stats(x, [*category.GLOBAL_SCORES.values(), "subchannel_global"])), _SCORES), O.features_sql(_SCORES, "features"))
_add("target_encoding_apply", lambda s, d: _shown(category.target_encodings((x := Data(s, d)).base(), _stats(x, [*stats.ENCODINGS, "global_fraud_rate"])), list(O._ENC)), O.features_sql(list(O._ENC), "features"))
for _period in X.PERIODS:
    _columns = list(O.window(_period))
    _add(f"rolling_{_period}", lambda s, d, p=_period, c=_columns: _shown(rolling.with_windows(Data(s, d).base(), [p]), c), O.features_sql(_columns, "one"))


@_query(O.features_sql(O.FEATURES))
def feature_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = Data(spark, sf_dir)
    built = build_features(data.tx, _stats(data))
    return _shown(built, engineered(data.tx, built))


_ORDER_WINDOWS = ["tx_count", "amount_mean", "amount_max", "cumulative_spend"]


@_query(
    "WITH o AS (SELECT o_custkey AS customer_id, o_orderkey AS event_id, epoch_us(o_orderdate) AS us, o_totalprice AS amount_clean FROM orders) SELECT event_id, "
    + ", ".join(
        f"{O.finite(e)} AS {n}_{p}"
        for p in ("7d", "30d", "90d")
        for n, e in ((n, f"{f} OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN {O.SECONDS[p] * 1000000} PRECEDING AND 1 PRECEDING)") for n, f in (("tx_count", "count(*)"), ("amount_mean", "avg(amount_clean)"), ("amount_max", "max(amount_clean)")))
    )
    + ", "
    + ", ".join(f"{O.finite(f'coalesce(sum(amount_clean) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN {O.SECONDS[p] * 1000000} PRECEDING AND 1 PRECEDING), 0)')} AS cumulative_spend_{p}" for p in ("7d", "30d", "90d"))
    + f", {O.finite(O.n())} AS tx_count_lifetime, {O.finite(O.days())} AS last_seen_days FROM o"
)
def order_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of history with ties in time: tied orders are outside each other's time windows, and ordered by id in row windows."""
    orders = adapters.order_transactions(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    df = transaction.parsed_time(orders).withColumn("amount_clean", X.nz("operaton_amt", 0.0))
    wanted = {f"{m}_{p}": c for p in ("7d", "30d", "90d") for m, c in ((m, rolling.amount_window(p)[m]) for m in _ORDER_WINDOWS)}
    df = with_history(df, [("n",), ("days",)]).withColumns(wanted).withColumnsRenamed({"_n": "tx_count_lifetime", "_days": "last_seen_days"})
    return _shown(df, [*wanted, "tx_count_lifetime", "last_seen_days"])


# ---- statistics

_SINGLE = [t for t, (k, _) in stats.COUNTS.items() if len(k) == 1]
_FREQ_SQL = " UNION ALL ".join(f"SELECT '{t}' AS name, {k[0]}::VARCHAR AS key, count(*) AS n FROM grouped GROUP BY 2" for t, (k, _) in stats.COUNTS.items() if len(k) == 1)


def _stacked(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        df = df.select(F.lit(name).alias("name"), *df.columns)
        out = df if out is None else out.unionByName(df)
    return out


@_query(_with(f"SELECT * FROM ({_FREQ_SQL})"))
def freq_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequencies(_stats(Data(spark, sf_dir), _SINGLE))


def _frequencies(found: stats.Stats) -> DataFrame:
    return _stacked({t: found[t].select(F.col(stats.COUNTS[t][0][0]).cast("string").alias("key"), F.col(stats.COUNTS[t][1]).alias("n")) for t in _SINGLE})


@_query(_with(f"SELECT * FROM ({_FREQ_SQL})"))
def stats_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies as they were saved and loaded again."""
    path = _shared(spark, "stats")
    _stats(Data(spark, sf_dir), _SINGLE).save(path)
    return _frequencies(stats.Stats.load(spark, path, only=_SINGLE))


@_query(_with("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS name, {k}::VARCHAR AS key, {O.finite('avg(amount_clean)')} AS mean, {O.finite('stddev_samp(amount_clean)')} AS std FROM grouped GROUP BY 2" for t, (k, _) in stats.AMOUNTS.items()) + ")"))
def amount_stats_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _stats(Data(spark, sf_dir), list(stats.AMOUNTS))
    return _stacked({t: found[t].select(F.col(k).cast("string").alias("key"), X.finite(f"{o}_mean").alias("mean"), X.finite(f"{o}_std").alias("std")) for t, (k, o) in stats.AMOUNTS.items()})


@_query(_with("SELECT channel_indicator_type, operating_system_type, count(*) AS global_combination_freq FROM grouped GROUP BY 1, 2"))
def combination_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(Data(spark, sf_dir), ["combination_global"])["combination_global"]


def _encoding(name: str, tables: list[str]) -> None:
    rate = "rate AS (SELECT sum(target)::DOUBLE / count(*) AS r FROM labelled)"

    def key(ks) -> str:
        return " || '|' || ".join(f"coalesce({k}::VARCHAR, '')" for k in ks)

    sql = " UNION ALL ".join(f"SELECT '{t}' AS name, {key(stats.ENCODINGS[t][0])} AS key, {O.finite('(sum(target) + 20 * any_value(r)) / (count(*) + 20)')} AS enc FROM labelled, rate GROUP BY {', '.join(stats.ENCODINGS[t][0])}" for t in tables)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = Data(spark, sf_dir)
        found = _stats(data, tables)
        return _stacked({t: found[t].select(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in stats.ENCODINGS[t][0])).alias("key"), X.finite(stats.ENCODINGS[t][1]).alias("enc")) for t in tables})

    _add(name, run, f"WITH {O.TX}, {rate} SELECT * FROM ({sql})")


_encoding("target_enc_single", [t for t, (k, _) in stats.ENCODINGS.items() if len(k) == 1])
_encoding("target_enc_pair", ["type_desc_target_enc"])
_encoding("target_enc_within_group", ["channel_type_within_group_te", "channel_subtype_within_group_te"])


@_query(_with(f"SELECT {O.finite('sum(target)::DOUBLE / count(*)')} AS global_fraud_rate FROM labelled"))
def global_fraud_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(Data(spark, sf_dir), ["global_fraud_rate"])["global_fraud_rate"].select(X.finite("global_fraud_rate").alias("global_fraud_rate"))


# ---- label joins, splits, sampling

_SPLIT = f"CASE WHEN event_dttm < TIMESTAMP '{CUTOFF}' THEN 'train' WHEN event_dttm < TIMESTAMP '{END}' THEN 'val' ELSE 'test' END"
_BASE = f"base AS (SELECT g.*, coalesce(lab.target, 0) AS target, (lab.target IS NOT NULL)::INT AS is_labeled, {O.A['model_group']} AS model_group, {_SPLIT} AS split FROM grouped g LEFT JOIN lab USING (customer_id, event_id))"
_add("labeled_inner", lambda s, d: Data(s, d).labelled().select("event_id", "tx_type_group", "target"), _with("SELECT event_id, tx_type_group, target FROM labelled"))
_add("label_left", lambda s, d: Data(s, d).split().select("event_id", "target"), _with(f"{_BASE} SELECT event_id, target FROM base"))
_add("is_labeled_flag", lambda s, d: Data(s, d).split().select("event_id", "is_labeled"), _with(f"{_BASE} SELECT event_id, is_labeled FROM base"))
_add("time_split", lambda s, d: Data(s, d).split().filter("is_train = 1").select("event_id", "split"), _with(f"{_BASE} SELECT event_id, split FROM base WHERE is_train = 1"))
_add("split_counts", lambda s, d: dataset.split_counts(Data(s, d).split().filter("is_train = 1")), _with(f"{_BASE} SELECT split, model_group, count(*) AS n_rows, sum(is_labeled)::BIGINT AS n_labeled, sum(target)::BIGINT AS n_positive FROM base WHERE is_train = 1 GROUP BY 1, 2"))
_add(
    "undersample",
    lambda s, d: dataset.undersample(Data(s, d).split().filter("split = 'train' AND is_train = 1")).select("event_id", "target"),
    _with(
        f"""{_BASE}, tr AS (SELECT event_id, target, row_number() OVER (PARTITION BY target ORDER BY md5(event_id::VARCHAR || ':42'), event_id) AS r,
  sum(target) OVER () AS p, sum(1 - target) OVER () AS q FROM base WHERE split = 'train' AND is_train = 1)
SELECT event_id, target FROM tr WHERE target = 1 OR r <= greatest(floor(q * 0.05), p)"""
    ),
)


@_query(_with(f"one_day AS (SELECT *, count(*) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS tx_count_1d FROM grouped) SELECT event_id, tx_count_1d FROM one_day WHERE is_train = 1"))
def train_only_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes after the window: earlier events stay history."""
    return rolling.with_windows(Data(spark, sf_dir).base(), ["1d"]).filter("is_train = 1").select("event_id", "tx_count_1d")


@_query("SELECT event_id, (event_id % 3 = 0)::INT AS is_train, user_id * 7 AS session_id FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 0, user_id * 7 FROM events WHERE event_id % 3 <> 0")
def union_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = adapters.events(spark, sf_dir).select("event_id", (F.col("user_id") * 7).cast("string").alias("session_id"))
    parts = [(raw.filter("event_id % 3 = 0"), 1), (raw.filter("event_id % 3 <> 0").withColumn("session_id", F.col("session_id").cast("int")), 0)]
    return files.union_history(parts).select("event_id", "is_train", "session_id")


# ---- buckets and types

_BUCKETS = "ids AS (SELECT customer_id, row_number() OVER (ORDER BY customer_id) - 1 AS r, count(*) OVER () AS c FROM (SELECT DISTINCT customer_id FROM tx)), buckets AS (SELECT customer_id, floor(r / ceil(c / 7.0))::INT AS bucket FROM ids)"
_add("customer_buckets", lambda s, d: materialize.customer_buckets(Data(s, d).tx, 7), _with(f"{_BUCKETS} SELECT customer_id, bucket FROM buckets"))


@_query(_with(f"{_BUCKETS} SELECT event_id, customer_id FROM tx JOIN buckets USING (customer_id) WHERE bucket = 3"))
def bucket_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = Data(spark, sf_dir).tx
    return materialize.in_bucket(tx, materialize.customer_buckets(tx, 7), 3).select("event_id", "customer_id")


@_query("SELECT o_orderkey::INT AS o_orderkey, o_custkey::INT AS o_custkey, o_totalprice::FLOAT AS o_totalprice, o_orderstatus FROM orders")
def downcast_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize.downcast(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))


_FEATURE_COLUMNS = ["session_id", "event_type_nm", "event_desc", "channel_indicator_type", "channel_indicator_sub_type", "operaton_amt", "currency_iso_cd", "pos_cd", "timezone", "operating_system_type", "web_rdp_connection", "phone_voip_call_state"]


@_query("SELECT unnest([" + ", ".join(f"'{c}'" for c in _FEATURE_COLUMNS) + "]) AS feature")
def feature_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in dataset.feature_columns(Data(spark, sf_dir).tx.schema)], "feature string")


_WRITTEN = ", ".join(f"{O.finite(f'{c}::FLOAT')} AS {c}" for c in O.FEATURES)
_FOUR = _BUCKETS.replace("7.0", "4.0")


@_query(f"WITH {O.CHAIN}, {_FOUR} SELECT event_id, bucket, {_WRITTEN} FROM features JOIN buckets USING (customer_id) WHERE is_train = 1")
def bucketed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table in narrow types, with what comes from statistics, as it was written, from all buckets."""
    data, path = Data(spark, sf_dir), _shared(spark, "features")
    materialize.write_features(data.tx, path, 4, _stats(data), train_only=True)
    df = files.read_parquet(spark, path)
    return df.select("event_id", "bucket", *(X.finite(c).alias(c) for c in O.FEATURES))


def _shared(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the driver and all executors share; in local mode without one, of a folder of the driver."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/ledgerlens-tables"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


_MATRIX = sorted({*_FEATURE_COLUMNS, *O.FEATURES} - dataset.NOT_FEATURES)
_DIGEST = " + ".join(f"{1 + i % 97} * coalesce({O.finite(c)}, -999)" for i, c in enumerate(_MATRIX))


@_query(f"WITH {O.CHAIN} SELECT event_id, {2 * len(_MATRIX)} AS width, {_DIGEST} AS digest FROM features")
def assemble_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the feature build with its missing-value indicators: the width, and a weighted sum of all features' cells."""
    data = Data(spark, sf_dir)
    built = build_features(data.tx, _stats(data))
    return matrix_digest(built, sorted(dataset.feature_columns(built.schema)))


def matrix_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """event_id, the width of the assembled vector, and the sum of its value cells, each as finite() shows it times 1 + its place modulo 97.

    The sum runs over the array from left to right: as one expression over hundreds of cells, the generated code is too large to be compiled.
    """
    from pyspark.ml.functions import vector_to_array

    cells = dataset.assemble(df, columns, indicators=True).select("event_id", vector_to_array("features").alias("cells"))
    weights = ", ".join(f"{1 + i % 97}D" for i in range(len(columns)))
    terms = f"zip_with(slice(cells, 1, {len(columns)}), array({weights}), (x, w) -> w * {X.finite_sql('x')})"
    return cells.select("event_id", F.size("cells").alias("width"), F.expr(f"aggregate({terms}, 0D, (s, x) -> s + x)").alias("digest"))


@_query("SELECT event_id, value FROM events")
def cached_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is built once, and found the second time by the text that describes it."""
    path, calls = _shared(spark, "matrix"), []
    build = lambda: calls.append(1) or files.read_parquet(spark, f"{sf_dir}/events.parquet", columns=["event_id", "value"])
    for meta in ("other columns", "event_id, value", "event_id, value"):
        df = files.cached(spark, path, meta, build)
    if len(calls) != 2:
        raise ValueError("a cached table was built again")
    return df


@_query("SELECT unnest(['model', 'model_ver_1', 'model_ver_2']) AS folder")
def archived_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What saving three times under one name leaves: the last result, and the earlier ones under numbered names."""
    folder, names = f"{_shared(spark, 'models')}/model", ["model"]
    for n in range(3):
        if (old := files.archive(spark, folder)) is not None:
            names.append(old.rpartition("/")[2])
        files.write_parquet(spark.range(n), folder)
    return spark.createDataFrame([(x,) for x in names], "folder string")


# ---- more scans

_add("multi_file_scan", lambda s, d: files.read_parquet(s, f"{d}/nation.parquet", f"{d}/nation.parquet", columns=["n_nationkey", "n_name"]), "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation")
_add("file_discovery", lambda s, d: files.read_parquet(s, d, pattern="reg*.parquet", columns=["r_regionkey", "r_name"]), "SELECT r_regionkey, r_name FROM region")
_add(
    "split_problems",
    lambda s, d: dataset.split_problems(dataset.split_counts(Data(s, d).split().filter("split <> 'test' AND NOT (split = 'val' AND target = 1)"))),
    "SELECT * FROM (VALUES ('test', 'the test part has no rows'), ('val', 'the val part has no positives')) AS t(split, problem)",
)


# ---- profiles

_RATE = "sum(target)::DOUBLE / count(*) * 100"


def _labels(keys: str) -> str:
    return f"l AS (SELECT {keys}, sum(target)::BIGINT AS fraud_count, count(*) AS labeled_count FROM labelled GROUP BY ALL)"


_VALUES = ["event_desc", "event_type_nm", "channel_indicator_type", "channel_indicator_sub_type", "pos_cd", "mcc_code"]


@_query(
    _with(
        f"""{_labels('event_desc')}, c AS (SELECT event_desc, count(*) AS total_count FROM grouped GROUP BY 1),
m AS (SELECT event_desc, arg_max(tx_type_group, n * 10 - tx_type_group) AS tx_type_group_mode FROM (SELECT event_desc, tx_type_group, count(*) AS n FROM grouped GROUP BY 1, 2) GROUP BY 1)
SELECT c.event_desc, total_count, fraud_count, labeled_count, tx_type_group_mode, {O.finite('total_count * 100.0::DOUBLE / (SELECT count(*) FROM grouped)')} AS pct_of_all, {O.finite('fraud_count * 100.0::DOUBLE / labeled_count')} AS fraud_rate_pct
FROM c LEFT JOIN l USING (event_desc) LEFT JOIN m USING (event_desc) ORDER BY total_count DESC, event_desc NULLS FIRST LIMIT 40"""
    )
)
def value_counts_with_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = Data(spark, sf_dir)
    df = profile.value_counts(data.grouped(), data.labelled(), "event_desc")
    return df.withColumns({c: X.finite(c) for c in ("pct_of_all", "fraud_rate_pct")})


@_query(_with("SELECT channel_indicator_type, arg_max(tx_type_group, n * 10 - tx_type_group) AS tx_type_group_mode FROM (SELECT channel_indicator_type, tx_type_group, count(*) AS n FROM grouped GROUP BY 1, 2) GROUP BY 1"))
def dominant_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.dominant_group(Data(spark, sf_dir).grouped(), "channel_indicator_type")


def _rates(keys: str, on: str) -> str:
    group = ", ".join(k.strip() for k in keys.split(","))
    match = " AND ".join(f"v.{k.strip()} = l.{k.strip()}" for k in on.split(","))
    return _with(f"{_labels(on)}, v AS (SELECT {group}, count(*) AS volume FROM grouped GROUP BY ALL), r AS (SELECT v.*, fraud_count, labeled_count, {O.finite('fraud_count * 100.0::DOUBLE / labeled_count')} AS fraud_rate_pct FROM v LEFT JOIN l ON {match}) SELECT * FROM r")


@_query(ORACLES["value_counts_with_rate"])
def profile_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile that was written as CSV over an earlier one, and read back."""
    data, folder = Data(spark, sf_dir), _shared(spark, "profiles")
    found = value_counts_with_rate(spark, sf_dir)
    for table in (profile.dominant_group(data.grouped(), "event_desc"), found):
        profile.export({"event_desc": table}, folder)
    return files.read_csv(spark, f"{folder}/event_desc", ", ".join(f"{c} {t}" for c, t in found.dtypes))


@_query(_rates("tx_type_group, event_type_nm", "tx_type_group, event_type_nm").replace("SELECT * FROM r", "SELECT tx_type_group, event_type_nm, volume, row_number() OVER (ORDER BY tx_type_group, volume DESC, event_type_nm NULLS FIRST)::INT AS place FROM r"))
def within_group_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places in which rows come out."""
    data = Data(spark, sf_dir)
    rows = profile.within_group_stats(data.grouped(), data.labelled(), "event_type_nm").withColumn("_at", F.monotonically_increasing_id())
    return rows.select("tx_type_group", "event_type_nm", "volume", F.row_number().over(W.orderBy("_at")).alias("place"))  # a profile of few rows


@_query(_with("SELECT g.tx_type_group, g.group_name, (SELECT count(*) FROM grouped x WHERE x.tx_type_group = g.tx_type_group) AS total_volume FROM (VALUES (0, 'nonpayment'), (1, 'card'), (2, 'p2p')) AS g(tx_type_group, group_name)"))
def group_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = Data(spark, sf_dir)
    return profile.group_volumes(profile.within_group_stats(data.grouped(), data.labelled(), "event_desc"))


_add("within_group_stats", lambda s, d: _rate_shown(profile.within_group_stats((x := Data(s, d)).grouped(), x.labelled(), "event_type_nm")), _rates("tx_type_group, event_type_nm", "tx_type_group, event_type_nm"))
_add("pair_stats", lambda s, d: _rate_shown(profile.pair_stats((x := Data(s, d)).grouped(), x.labelled())), _rates("event_type_nm, event_desc, tx_type_group", "event_type_nm, event_desc"))
_CHANNELS = _rates("channel_indicator_type, channel_indicator_sub_type", "channel_indicator_type, channel_indicator_sub_type")
_add("channel_pair_stats", lambda s, d: _rate_shown(profile.channel_pair_stats((x := Data(s, d)).grouped(), x.labelled())), _CHANNELS)
_add(
    "high_risk_channel_pairs",
    lambda s, d: profile.top_rates(_rate_shown(profile.channel_pair_stats((x := Data(s, d)).grouped(), x.labelled())), 10, 30),
    _CHANNELS + " WHERE labeled_count >= 10 ORDER BY fraud_rate_pct DESC, volume DESC, channel_indicator_type NULLS FIRST, channel_indicator_sub_type NULLS FIRST LIMIT 30",
)
_add(
    "topn_per_group",
    lambda s, d: profile.top_rates(_rate_shown(profile.pair_stats((x := Data(s, d)).grouped(), x.labelled())), 5, 20, by="tx_type_group"),
    _rates("event_type_nm, event_desc, tx_type_group", "event_type_nm, event_desc").replace("SELECT * FROM r", "SELECT *, row_number() OVER (PARTITION BY tx_type_group ORDER BY fraud_rate_pct DESC, volume DESC, event_type_nm, event_desc, tx_type_group)::INT AS rank FROM r WHERE labeled_count >= 5 QUALIFY rank <= 20"),
)


def _rate_shown(df: DataFrame) -> DataFrame:
    return df.withColumn("fraud_rate_pct", X.finite("fraud_rate_pct"))


_SHARES = ", ".join(f"{O.finite(f'count(*) FILTER (WHERE tx_type_group = {g})::DOUBLE / count(*)')} AS {name}" for g, name in profile.GROUPS.items())


@_query(_with(f"SELECT event_desc, {_SHARES} FROM grouped GROUP BY 1 ORDER BY count(*) DESC, event_desc NULLS FIRST LIMIT 30"))
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile.crosstab(Data(spark, sf_dir).grouped(), "event_desc")
    return df.select("event_desc", *(X.finite(c).alias(c) for c in profile.GROUPS.values()))


@_query(_with("SELECT channel_indicator_type, " + ", ".join(f"count(*) FILTER (WHERE channel_indicator_sub_type = {k}) AS c_{k}" for k in range(12)) + " FROM grouped WHERE channel_indicator_type IS NOT NULL GROUP BY 1"))
def channel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.channel_pivot(Data(spark, sf_dir).grouped(), list(range(12)))


@_query(_with("SELECT mcc_code, count(*) AS n FROM grouped GROUP BY 1 ORDER BY n DESC, mcc_code NULLS FIRST LIMIT 10"))
def topk_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Data(spark, sf_dir).tx.groupBy("mcc_code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "mcc_code").limit(10)


# ---- scores and metrics

_PSEUDO = "p AS (SELECT event_id, score, score * score AS s2, round(1 - score, 3) AS s3, sqrt(score) AS other FROM scored)"
_VAL = f"{_BASE}, val AS (SELECT b.event_id, b.target, b.model_group, s.score FROM base b JOIN scored s USING (event_id) WHERE split = 'val' AND is_labeled = 1)"
_POINTS = "pts AS (SELECT score, sum(target) AS pos, count(*) AS n FROM val GROUP BY 1), cum AS (SELECT *, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER () AS positives FROM pts WINDOW w AS (ORDER BY score DESC)), pr AS (SELECT *, tp / (tp + fp) AS prec, tp / positives AS rec FROM cum)"


def _pseudo(data: Data) -> DataFrame:
    s = F.col("score")
    return adapters.pseudo_score(data.raw).select("event_id", "score", (s * s).alias("s2"), F.round(1 - s, 3).alias("s3"), F.sqrt(s).alias("other"))


_add("seed_average", lambda s, d: _pseudo(Data(s, d)).select("event_id", X.finite(models.seed_average(["score", "s2", "s3"])).alias("score")), _with(f"{_PSEUDO} SELECT event_id, {O.finite('(score + s2 + s3) / 3')} AS score FROM p"))
_add("blend_scores", lambda s, d: _pseudo(Data(s, d)).select("event_id", X.finite(models.blend("score", "other")).alias("score")), _with(f"{_PSEUDO} SELECT event_id, {O.finite('0.75 * score + 0.25 * other')} AS score FROM p"))


@_query(_with(f"{_BASE}, {_PSEUDO} SELECT event_id, {O.finite('CASE model_group WHEN 0 THEN score WHEN 1 THEN s2 WHEN 2 THEN s3 ELSE 0 END')} AS score FROM base JOIN p USING (event_id) WHERE split = 'test'"))
def route_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = Data(spark, sf_dir)
    rows = data.split().filter("split = 'test'").join(_pseudo(data), "event_id")
    return rows.select("event_id", X.finite(models.route({0: F.col("score"), 1: F.col("s2"), 2: F.col("s3")}, 0.0)).alias("score"))


@_query(_with(f"{_VAL}, {_POINTS} SELECT {O.finite('coalesce(sum(pos / positives * prec), 0)')} AS average_precision FROM pr"))
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(Data(spark, sf_dir).scored()).select(X.finite("average_precision").alias("average_precision"))


_BEST = "f AS (SELECT score AS threshold, prec AS precision, rec AS recall, CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec + 1e-9) END AS f1 FROM pr), best AS (SELECT * FROM f ORDER BY round(f1, 12) DESC, threshold LIMIT 1)"


@_query(_with(f"{_VAL}, {_POINTS}, {_BEST} SELECT " + ", ".join(f"{O.finite(c)} AS {c}" for c in ("threshold", "precision", "recall", "f1")) + " FROM best"))
def max_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = metrics.max_f1(Data(spark, sf_dir).scored())
    return best.select(*(X.finite(c).alias(c) for c in best.columns))


@_query(
    _with(
        f"""{_VAL}, {_POINTS}, {_BEST}, q AS (SELECT target, (score >= threshold)::INT AS p FROM val, best),
k AS (SELECT c::VARCHAR AS class, count(*) FILTER (WHERE target = c AND p = c) AS hit, count(*) FILTER (WHERE p = c) AS said, count(*) FILTER (WHERE target = c) AS support FROM q, (SELECT unnest([0, 1]) AS c) GROUP BY 1),
m AS (SELECT class, CASE WHEN said = 0 THEN 0 ELSE hit::DOUBLE / said END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit::DOUBLE / support END AS recall, support, 2.0::DOUBLE * hit / (said + support) AS f1 FROM k),
every AS (SELECT * FROM m UNION ALL SELECT 'macro', avg(precision), avg(recall), sum(support)::BIGINT, avg(f1) FROM m UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(support)::BIGINT, sum(f1 * support) / sum(support) FROM m)
SELECT class, {O.finite('precision')} AS precision, {O.finite('recall')} AS recall, {O.finite('f1')} AS f1, support FROM every"""
    )
)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = Data(spark, sf_dir).scored()
    out = metrics.classification_report(scored, metrics.max_f1(scored))
    return out.select("class", *(X.finite(c).alias(c) for c in ("precision", "recall", "f1")), "support")


@_query(_with(f"{_VAL} SELECT pct::INT AS pct, {O.finite('q')} AS score FROM (SELECT unnest([0, 25, 50, 75, 90, 95, 99, 100]) AS pct, unnest(quantile_cont(score, [0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1])) AS q FROM val)"))
def score_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score_percentiles(Data(spark, sf_dir).scored()).select("pct", X.finite("score").alias("score"))


@_query("SELECT count(*) AS n_rows, count(DISTINCT i) AS n_ids, count(*) - count(DISTINCT i) AS n_repeated FROM (SELECT event_id AS i FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 10 = 0)")
def duplicate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = adapters.events(spark, sf_dir).select("event_id")
    return metrics.duplicate_check(ids.unionAll(ids.filter("event_id % 10 = 0")))


@_query(_with(f"{_BASE} SELECT event_id, {O.finite('score')} AS predict FROM base JOIN scored USING (event_id) WHERE split = 'test'"))
def score_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The submission, written as CSV and read back."""
    data, path = Data(spark, sf_dir), _shared(spark, "submission")
    rows = data.split().filter("split = 'test'").join(adapters.pseudo_score(data.raw), "event_id").select("event_id", F.col("score").alias("predict"))
    files.write_csv(rows, path)
    return files.read_csv(spark, path, "event_id long, predict double").select("event_id", X.finite("predict").alias("predict"))


@_query()
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensembles by segment, fitted on the features of the training part and stopped early on labelled validation rows, and their scores of the test part.

    Statistics and target encodings are those of events before the test part.  The features are written as vectors with their labels, by segment and part, and
    read back: training reads them many times, each time those of one segment and part, and plans over hundreds of columns take longer than small fits.
    """
    data, path = Data(spark, sf_dir), _shared(spark, "model_features")
    built = dataset.with_labels(build_features(data.tx, _stats(data, as_of=END)), data.labels).withColumn("split", dataset.split_of(CUTOFF, END))
    columns = dataset.feature_columns(built.schema)
    built = dataset.assemble(built, columns).select("event_id", "is_train", "is_labeled", "target", "features", "model_group", "split")
    files.write_parquet(built.hint("rebalance", "model_group", "split"), path, by=["model_group", "split"])
    df = spark.read.schema(built.schema).parquet(path)  # stated, as folder names don't tell types and an empty table has no file
    known = df.filter("is_train = 1")
    fitted = models.fit_routed(known.filter("split = 'train'"), known.filter("split = 'val' AND is_labeled = 1"), columns)
    return fitted.score(df.filter("split = 'test'")).select("event_id", "model_group", "score")
