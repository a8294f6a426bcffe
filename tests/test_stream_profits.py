"""Profits with timers against the batch, their state, restarts and a batch before them."""

import json

from pyspark.sql import functions as F

from ledgerloom.operators import trade_features as T
from ledgerloom.streaming import features as J
from ledgerloom.streaming import profits as P
from tests.test_incremental import RAW, markets, same, streamed, trades

COLUMNS = [x.split()[0] for x in P.OUT.split(", ")]


def wanted(df, ends):
    return T.realised_pnl(T.base(df, ends)).select(*COLUMNS)


def ordered(spark):
    df, rows = trades(spark, 400, seed=5)
    return df, sorted(rows, key=lambda r: (r[3], r[0]))


def test_equals_batch_over_restarts(spark, tmp_path):
    df, rows = ordered(spark)
    ends = markets(spark, rows)
    stream = P.realised_stream(T.base(streamed(spark, rows[:260], tmp_path, 130), ends))
    J.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    streamed(spark, rows[260:], tmp_path, 130)
    same(J.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/state"), wanted(df, ends))


def test_state_leaves_when_markets_end(spark, tmp_path):
    _, rows = ordered(spark)
    first, last = rows[0][3], rows[-1][3]
    middle = (first + last) // 2
    ends = spark.createDataFrame([(f"m{i}", middle) for i in range(6)], "condition_id string, end_time long")
    # After the middle only one user trades; the others' open profits leave by their timers.
    rows = [r for r in rows if r[3] < middle] + [(*r[:1], "alone", *r[2:]) for r in rows if r[3] >= middle]
    stream = P.realised_stream(T.base(streamed(spark, rows, tmp_path, 100), ends))
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    open_rows = spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/state")
    held = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p.numInputRows]
    assert open_rows.count() == 0 and max(held) > held[-1]


def test_goes_on_from_a_batch(spark, tmp_path):
    df, rows = ordered(spark)
    ends = markets(spark, rows)
    cut = next(k for k in range(200, len(rows)) if rows[k][3] > rows[k - 1][3])
    until = rows[cut][3]
    initial = P.initial_state(T.base(spark.createDataFrame(rows[:cut], RAW), ends), until)
    stream = P.realised_stream(T.base(streamed(spark, rows[cut:], tmp_path, 120), ends), initial)
    same(J.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/state"), wanted(df, ends).where(F.col("timestamp") >= until))
