"""Sliding hours and sessions on streams against the batch, with rows that come too late."""

import random

from pyspark.sql import functions as F

from ledgerloom.streaming import features as J

ROWS = "market_id string, user_id string, timestamp long, usdc double"


def made():
    rng, at, rows = random.Random(3), 1_700_000_000 // 3600 * 3600, []
    for _ in range(240):
        at += rng.choice([0, 60, 400, 2000, 8000])
        rows.append((f"m{rng.randrange(2)}", f"u{rng.randrange(3)}", at, float(rng.randrange(1, 50))))
    return rows


def streamed(spark, rows, folder, per_file):
    at = f"{folder}/rows"
    for k in range(0, len(rows), per_file):
        spark.createDataFrame(rows[k : k + per_file], ROWS).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(at)


def check(spark, tmp_path, windows, late, columns):
    rows = made()
    last = rows[-1][2]
    # A row far ahead closes all windows; two far behind come too late and are left out.
    ahead, behind = ("end", "end", last + 10**6, 0.0), [("m0", "u0", rows[0][2] - 50_000, 5.0)] * 2
    stream = windows(streamed(spark, [*rows, ahead, *behind], tmp_path, 80), late)
    got = J.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    want = windows(spark.createDataFrame(rows, ROWS), late)
    ask = lambda df: sorted(map(tuple, df.where("market_id <> 'end'").select(*columns).collect()))
    assert ask(got) == ask(want) and got.count() >= want.count() > 50


def test_sliding_hours(spark, tmp_path):
    check(spark, tmp_path, J.sliding_hours, "3 hours", ["market_id", "window_start", "n_trades", "volume"])


def test_sessions(spark, tmp_path):
    check(spark, tmp_path, J.user_sessions, "3 hours", ["market_id", "user_id", "n_trades", "first_ts", "last_ts"])
