import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import markets, metrics, model, samples, scaling, sequences
from ledgerloom.sources import sinks
from ledgerloom.sources import trades as A
from ledgerloom.streaming import features as J

SCORED = "trade_uid string, split string, logit double, y int, price double, edge double, outcome_index int, log_usdc_size double"


def scored(spark, n=200, seed=0):
    rng = random.Random(seed)
    rows = [(str(i), rng.choice(["train", "test"]), rng.choice([-1.0, -0.2, 0.0, 0.3, 2.0]), rng.randrange(2), rng.choice([0.2, 0.5, 0.8]), None, rng.randrange(2), 1.0) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCORED)


def test_auc_by_pairs(spark):
    rows, df = scored(spark)
    pos, neg = [r[2] for r in rows if r[3]], [r[2] for r in rows if not r[3]]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(metrics.auc(df).first()["auc"], want)
    assert math.isclose(metrics.auc(df.withColumn("logit", -F.col("logit"))).first()["auc"], 1 - want)
    assert metrics.auc(df.where("y = 1")).first()["auc"] is None


def test_core_metrics_with_gaps(spark):
    rows = [("a", "t", 1.0, 1, 0.4, None, 1, 0.0), ("b", "t", -1.0, None, 0.4, 0.2, 1, 0.0), ("c", "t", -2.0, 1, 0.9, None, 0, 0.0)]
    r = metrics.core_metrics(spark.createDataFrame(rows, SCORED)).first()
    assert r["n_samples"] == 3 and r["bce_n_samples"] == 2 and r["misclass"] == 0.5
    p = 1 / (1 + math.exp(-1))
    assert math.isclose(r["bce"], (-math.log(p) - math.log(1 / (1 + math.exp(2)))) / 2)
    assert r["n_take"] == 1 and math.isclose(r["pnl"], 0.6)


def test_profit(spark):
    rows, df = scored(spark)
    got = {r["tau"]: r for r in metrics.profit(df, [0.0, 0.3]).collect()}
    for tau, r in got.items():
        taken = [x for x in rows if 1 / (1 + math.exp(-x[2])) - x[4] > tau]
        assert r["n_take"] == len(taken) and math.isclose(r["pnl"], sum(x[3] - x[4] for x in taken), abs_tol=1e-9)


def test_scaler_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (float("nan"), None)], "a double, b double")
    stats = scaling.norm_stats(df, ["a", "b"])
    got = {r["column"]: r for r in stats.collect()}
    assert (got["a"]["mean"], got["a"]["std"], got["a"]["count"]) == (2.0, 1.0, 2) and got["b"]["std"] == 1.0
    sinks.write_scaler(stats, str(tmp_path / "scaler"))
    back = sinks.read_scaler(spark, str(tmp_path / "scaler"))
    assert [r["a"] for r in scaling.standardised(df.limit(2), back, ["a", "b"]).collect()] == [-1.0, 1.0]


def test_column_roles():
    from ledgerloom.plans.feature_table import COLUMNS

    assert len(scaling.feature_columns([*COLUMNS, "label_y"])) == 41 and len(scaling.scaled_columns([*COLUMNS, "label_y"])) == 37
    with pytest.raises(ValueError):
        scaling.feature_columns(["price"])


def test_splits_are_by_time(spark):
    df = spark.createDataFrame([(f"m{i}", None if i == 0 else i) for i in range(20)], "market_id string, end_ts long")
    got = {r["market_id"]: r["split"] for r in markets.temporal_split(df).collect()}
    assert [sum(x == s for x in got.values()) for s in ("train", "val", "test")] == [14, 3, 3] and got["m0"] == "test"


def test_scalar_edges(spark):
    row = spark.sql("SELECT 'C:\\\\x\\\\Ledger/a/b' AS p, CAST(NULL AS DOUBLE) AS n, CAST('NaN' AS DOUBLE) AS nan, 0.7D AS y").select(
        S.project_path("p", "ledger").alias("path"), S.binary_label("n").alias("a"), S.binary_label("nan").alias("b"), S.binary_label("y").alias("c"), S.log_loss(F.lit(-800.0), F.lit(1)).alias("loss"), S.signal(F.lit(0.9), 0.1).alias("s")
    ).first()
    assert (row["path"], row["a"], row["b"], row["c"], row["loss"], row["s"]) == ("a/b", 0, 0, 1, 800.0, "YES")


def test_scans(spark):
    rows = [("a", "u", "m", 5, 0.1, 1.0, None, 1, None), ("b", "u", "m", 5, 0.1, 1.0, None, 1, None), ("c", "u", "m", 9, None, 1.0, None, 1, None)]
    df = spark.createDataFrame(rows, "trade_uid string, proxy_wallet string, condition_id string, timestamp long, price double, size double, usdc_size double, outcome_index int, pnl_raw double")
    assert [r[0] for r in A.scan(df, 0, after=(5, "a")).orderBy("trade_uid").collect()] == ["b", "c"]
    assert A.valid(df).count() == 2
    old = spark.createDataFrame([("m", 1, 2)], "condition_id string, start_time int, end_time int")
    assert tuple(A.market_times(old).first()) == ("m", 1, 2)
    assert tuple(A.market_times(old.select("condition_id")).first()) == ("m", None, None)


def tokens(spark, n):
    rows = [("train", 0, "m", i, f"t{i}", float(i), 1) for i in range(n)]
    df = spark.createDataFrame(rows, "split string, shard int, market_id string, timestamp long, trade_uid string, price double, y int")
    return df


def test_windows_pad_and_mask(spark):
    got = samples.market_windows(tokens(spark, 3), 5, ["price"], min_length=1).first()
    assert got["market_mask"] == [False, False, True, True, True] and [x[0] for x in got["market_x"]] == [0, 0, 0, 1, 2] and got["market_y"] == [0.5, 0.5, 1, 1, 1]
    assert samples.market_windows(tokens(spark, 3), 5, ["price"]).count() == 0
    cut = samples.market_windows(tokens(spark, 40), 5, ["price"], mode="hash", epoch=3).first()
    assert 9 <= cut["target_ts"] <= 39


def test_index_starts(spark):
    df = tokens(spark, 3).unionByName(tokens(spark, 2).withColumn("market_id", F.lit("n")))
    got = {r["market_id"]: (r["start"], r["length"]) for r in sequences.index(df, "market_id", "y").collect()}
    assert got == {"m": (0, 3), "n": (3, 2)}


def test_sinks(spark, tmp_path):
    sinks.write_sequences(tokens(spark, 10), str(tmp_path / "seq"), "market_id", 2)
    assert [r["timestamp"] for r in sinks.read_key(spark, str(tmp_path / "seq"), "market_id", "m").collect()] == list(range(10))
    f = tokens(spark, 4).withColumns({"label_y": F.lit(1.0), "edge": F.lit(0.5)})
    sinks.write_by_split(f.withColumn("split", F.when(F.col("timestamp") > 0, F.col("split"))), str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by")).count() == 3
    sinks.write_features(f, str(tmp_path / "f"), 2)
    assert spark.read.parquet(str(tmp_path / "f")).count() == 4 and sinks.preview(f).first()["mean_edge"] == 0.5
    sinks.write_report(f.agg(F.count("*").alias("n")), str(tmp_path / "r"), {"model": "a"})
    assert spark.read.json(str(tmp_path / "r")).first()["model"] == "a"


def test_batches(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("trade_uid"))
    got = scaling.shuffled_batches(df, 1, 64).groupBy("task", "batch_id").count()
    assert got.agg(F.max("count")).first()[0] == 64 and got.agg(F.sum("count")).first()[0] == 1000


def test_baseline_learns(spark):
    rng = random.Random(1)
    rows = [(str(i), x := rng.uniform(-1, 1), float(x > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "trade_uid string, x double, label_y double")
    out = model.score_baseline(model.fit_baseline(df, ["x"]), df)
    assert out.where((F.col("logit") > 0) == (F.col("label_y") > 0.5)).count() > 380


def test_stream_resumes(spark, tmp_path):
    schema = "trade_uid string, user_id string, market_id string, timestamp long, price double, outcome_index int, usdc double, pnl_raw double, end_ts long"
    rows = [(f"{i:03d}", f"u{i % 3}", f"m{i % 2}", 1000 + 500 * i, 0.5, i % 2, 2.0, float(i % 5 - 2), 1000 + 900 * i) for i in range(60)]

    def take(part, name):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        return J.run_to_table(J.keyed_features(stream, "user_id"), str(tmp_path / name), str(tmp_path / f"{name}-state"))

    for k in (0, 20, 40):
        twice = take(rows[k : k + 20], "steps")
    batch = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    once = J.run_to_table(J.keyed_features(batch, "user_id"), str(tmp_path / "once"), str(tmp_path / "once-state"))
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(twice) == order(once) and len(order(once)) == 60


def test_windows_of_streams_and_batches(spark):
    df = spark.createDataFrame([("m", "u", 0, 1.0), ("m", "u", 3600, 1.0), ("m", "u", 7201, 1.0)], "market_id string, user_id string, timestamp long, usdc double")
    assert sorted(r["n_trades"] for r in J.user_sessions(df).collect()) == [1, 2]
    assert J.sliding_hours(df).agg(F.sum("n_trades")).first()[0] == 18


def test_places_in_dual_samples():
    """Models read the samples by position."""
    from ledgerloom.operators import samples

    assert [samples.DUAL_COLUMNS.index(c) for c in ("price", "p_yes", "outcome_index", "dp_yes_clip")] == [0, 1, 2, 3] and len(samples.DUAL_COLUMNS) == 12
    assert samples.USER_COLUMNS == ["price", "p_yes", "outcome_index"]


def test_job_paths(tmp_path):
    import json

    from ledgerloom.config import load_paths

    (tmp_path / "config.json").write_text(json.dumps({"dataset_root": "d", "scaler_path": "/s.json", "runs_dir": "s3a://b/r", "checkpoints_dir": "c"}))
    (tmp_path / "a" / "b").mkdir(parents=True)
    got = load_paths(str(tmp_path / "a" / "b"))
    assert (got.dataset_root, got.scaler_path, got.runs_dir) == (str(tmp_path / "d"), "/s.json", "s3a://b/r")
    deep = tmp_path / "a" / "b" / "c" / "d"
    deep.mkdir(parents=True)
    assert load_paths(str(deep.parent)).root == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        load_paths(str(deep))


def test_column_roles_without_label():
    from ledgerloom.operators import scaling

    assert scaling.scaled_columns(["price", "edge", "a", "a_missing"]) == ["a"] and scaling.feature_columns(["price", "edge", "a", "a_missing"]) == ["price", "a", "a_missing"]
