"""Runs with carried rows, and the streamed table, against the plain batch build."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import carried as C
from ledgerloom.operators import trade_features as T
from ledgerloom.plans import feature_table
from ledgerloom.sources.trades import COLUMNS
from ledgerloom.streaming import incremental as I

RAW = "trade_uid string, proxy_wallet string, condition_id string, timestamp long, price double, size double, usdc_size double, outcome_index int, pnl_raw double"


def trades(spark, n=600, seed=1, users=12, markets=6, whale=0.4):
    rng, rows, at = random.Random(seed), [], 1_700_000_000
    for i in range(n):
        at += rng.choice([0, 0, 1, 30, 400, 1500, 5000])
        user = "whale" if rng.random() < whale else f"u{rng.randrange(users)}"
        size = rng.choice([0.0, None]) if rng.random() < 0.05 else rng.choice([-1, 1]) * rng.randrange(1, 500) / 4
        rows.append((f"t{rng.randrange(10**9):09d}{i:05d}", user, f"m{rng.randrange(markets)}", at, rng.randrange(1, 100) / 100, size, None if rng.random() < 0.1 else rng.randrange(1, 900) / 8, rng.randrange(2), None if rng.random() < 0.1 else rng.randrange(-400, 400) / 8))
    return spark.createDataFrame(rows, RAW), rows


def markets(spark, rows):
    first, last = rows[0][3], rows[-1][3]
    ends = [first + (last - first) * x // 10 for x in (3, 5, 8, 12)]
    return spark.createDataFrame([(f"m{i}", first - 500 if i else None, ends[i] if i < 4 else None) for i in range(6)], "condition_id string, start_time long, end_time long")


def same(got, want, key="trade_uid"):
    assert sorted(got.columns) == sorted(want.columns)
    a, b = ({r[key]: r.asDict() for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys()
    for k, x in a.items():
        for c, v in x.items():
            w = b[k][c]
            assert (v == w) if not isinstance(w, float) else math.isclose(v, w, rel_tol=1e-7, abs_tol=1e-7), (k, c, v, w)


@pytest.fixture(scope="module")
def data(spark):
    df, rows = trades(spark)
    df, ends = df.repartition(3).cache(), markets(spark, rows).cache()
    return df, rows, ends, feature_table.build(df, ends, end_mode="announced").cache()


@pytest.mark.parametrize(("std_mode", "width"), [("rms", 3000), ("centered", 86_400)])
def test_whales_in_blocks(data, width, std_mode):
    df, _, ends, _ = data
    rows = T.trade_local(T.base(df, ends))
    same(C.user_in_blocks(rows, width, 50, std_mode), T.realised_pnl(T.user_lifetime(rows), std_mode))


def test_all_options_of_the_build(data):
    df, _, ends, want = data
    same(feature_table.build(df, ends, end_mode="announced", strategy="sweep", block=7200, large=50, user_block=20_000), want)


def test_no_task_holds_a_whale(spark, data):
    """Every window and grouping that orders rows of a user has the block among its keys."""
    df, _, ends, _ = data
    rows = T.trade_local(T.base(df, ends))
    plan = C.user_in_blocks(rows, 20_000, 100)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x]
    heavy = [x for x in windows if "_b#" not in x.split("], [")[-2]]
    # Windows over blocks (a row a block) are the only others.
    assert windows and all("_b#" in x.rsplit("[", 1)[-1] for x in heavy)


def streamed(spark, rows, folder, per_file, names="trades"):
    """The rows as files of per_file rows, in this order, and a stream that takes them one by one."""
    at = f"{folder}/{names}"
    for k in range(0, len(rows), per_file):
        spark.createDataFrame(rows[k : k + per_file], RAW).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(at)


def test_stream_equals_batch(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "COMPACT", 2)
    df, rows, ends, want = data
    build = I.Build(spark, f"{tmp_path}/table", ends)
    ordered = sorted(rows, key=lambda r: (r[3], r[0]))
    got = build.run(streamed(spark, ordered, tmp_path, 160), f"{tmp_path}/check")
    same(got, want)
    commits = build.commits().orderBy("version").collect()
    assert len(commits) == 5 and commits[-1]["base"] == 4 and sum(r["rows"] for r in commits) == want.count()
    assert sum(r["late"] for r in commits) == 0 and commits[-1]["waiting"] == 0


def test_batch_hands_over_to_stream(spark, data, tmp_path):
    df, rows, ends, want = data
    ordered = sorted(rows, key=lambda r: (r[3], r[0]))
    cut = next(k for k in range(300, len(rows)) if ordered[k][3] > ordered[k - 1][3])
    build = I.Build(spark, f"{tmp_path}/table", ends)
    build.begin_with(spark.createDataFrame(ordered[:cut], RAW))
    build.begin_with(spark.createDataFrame(ordered[:5], RAW))  # is there already
    # Two starts of one stream: the second takes only what is new.
    stream = streamed(spark, ordered[cut : cut + 150], tmp_path, 150)
    build.run(stream, f"{tmp_path}/check", finish=False)
    waiting = build.commits().orderBy(F.desc("version")).first()["waiting"]
    assert waiting > 0
    streamed(spark, ordered[cut + 150 :], tmp_path, 150)
    same(build.run(stream, f"{tmp_path}/check"), want)


def test_a_repeated_batch_counts_once(spark, data, tmp_path):
    _, rows, ends, _ = data
    ordered = sorted(rows, key=lambda r: (r[3], r[0]))[:150]
    want = feature_table.build(spark.createDataFrame(ordered, RAW), ends, end_mode="announced")
    build = I.Build(spark, f"{tmp_path}/table", ends)
    part = [spark.createDataFrame(ordered[k : k + 50], RAW) for k in (0, 50, 100)]
    build.step(part[0], 0)
    build.step(part[1], 1)
    build._delete(build._at("commits", 1))  # as if the job was lost before it committed
    build.step(part[1], 1)
    build.step(part[1], 1)
    build.step(part[2], 2, finish=True)
    same(build.features(), want)


def test_shuffled_within_the_delay(spark, data, tmp_path):
    _, rows, ends, want = data
    rng = random.Random(4)
    shuffled = sorted(rows, key=lambda r: r[3] + rng.randrange(6000))
    build = I.Build(spark, f"{tmp_path}/table", ends, delay=6000)
    same(build.run(streamed(spark, shuffled, tmp_path, 300), f"{tmp_path}/check"), want)
    assert build.late().count() == 0


def test_late_trades_are_kept_and_repaired(spark, data, tmp_path):
    df, rows, ends, want = data
    ordered = sorted(rows, key=lambda r: (r[3], r[0]))
    late = [r for r in ordered[50:300] if r[5]][::47]
    moved = [r for r in ordered if r not in late]
    moved[450:450] = late
    build = I.Build(spark, f"{tmp_path}/table", ends)
    got = build.run(streamed(spark, moved, tmp_path, 300), f"{tmp_path}/check")
    commits = build.commits().agg(F.sum("late"), F.sum("rows")).first()
    assert commits[0] == len(late) == build.late().count() and commits[1] + len(late) == want.count()
    assert {r["trade_uid"] for r in got.collect()}.isdisjoint({r[0] for r in late})
    same(build.repaired(df), want)


def test_a_stream_of_nothing(spark, data, tmp_path):
    _, _, ends, want = data
    build = I.Build(spark, f"{tmp_path}/table", ends)
    build.step(spark.createDataFrame([], RAW), 0)
    build.step(spark.createDataFrame([], RAW), 1, finish=True)
    assert build.features().count() == 0 and build.features().columns == list(want.columns) and list(COLUMNS) == [x.split()[0] for x in RAW.split(", ")]
