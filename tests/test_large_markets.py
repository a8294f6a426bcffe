"""Markets, streams and users of any size: what keeps a task's memory and a row's work bounded."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import carried as C
from ledgerloom.operators import samples as P
from ledgerloom.operators import trade_features as T
from ledgerloom.plans import feature_table
from ledgerloom.streaming import features as J


def test_markets_are_cut_by_default(spark):
    rows = spark.range(0, 1000).selectExpr("'m' AS market_id", "id * 3600 AS timestamp")
    halo = T.with_halo(rows, feature_table.BLOCK)
    tasks = halo.select(F.spark_partition_id().alias("t")).distinct().count()
    assert tasks > 1 and T.own(halo).count() == 1000
    assert feature_table.build.__defaults__[3] == feature_table.BLOCK


def test_places_of_tokens_in_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [("train", f"m{rng.integers(3)}", int(t), f"{i:04}") for i, t in enumerate(rng.integers(0, 900_000, 400))]
    tokens = spark.createDataFrame(rows, "split string, market_id string, timestamp long, trade_uid string")
    got = P.numbered(tokens)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_b#" in plan  # no window over all tokens of a key
    have = {r["trade_uid"]: (r["pos"], r["n"]) for r in got.collect()}
    for m in ("m0", "m1", "m2"):
        mine = sorted((x for x in rows if x[1] == m), key=lambda x: x[2:])
        assert [have[x[3]] for x in mine] == [(i, len(mine)) for i in range(len(mine))]


def test_gaps_of_a_short_run_need_no_loop(spark):
    """The variance of the last 20 gaps over a run's begin, exact, from sums."""
    rng = np.random.default_rng(2)
    times = np.sort(rng.integers(0, 3_000_000, 120)).tolist()
    rows = [("u", int(i >= 60) + int(i >= 70), t, f"{i:04}", 1.0, 1.0) for i, t in enumerate(times)]
    rows = spark.createDataFrame(rows, "user_id string, _b long, timestamp long, trade_uid string, size double, usdc double")
    keys = ["user_id", "_b"]
    out = C.user_after(C.carry(rows, C.user_prefix(C.user_sums(rows, keys)), keys, C.USER_STATE), keys)
    assert "zip_with" not in out._jdf.queryExecution().analyzed().toString()
    for r in out.collect():
        i = int(r["trade_uid"])
        gaps = np.diff(times[:i])[-20:] if i else []
        assert r["user_activity_burstiness"] == pytest.approx(np.var(gaps) if len(gaps) >= 2 else 0.0, rel=1e-12)


class State:
    exists, get = False, None

    def update(self, x):
        self.exists, self.get = True, x


def test_market_stream_is_not_quadratic_in_the_hour():
    """200,000 trades of little more than an hour, in two micro-batches."""
    rng, n = np.random.default_rng(3), 200_000
    rows = pd.DataFrame({"market_id": "m", "trade_uid": [f"{i:07}" for i in range(n)], "timestamp": np.sort(rng.integers(0, 4000, n)), "usdc": rng.integers(0, 9999, n) / 100, "price": rng.random(n), "outcome_index": rng.integers(0, 2, n)})
    state = State()
    got = pd.concat([next(J._market(("m",), iter([part]), state)) for part in (rows[: n // 3], rows[n // 3 :])]).reset_index(drop=True)
    assert list(got["market_total_trades_before"]) == list(range(n))
    for i in (0, 1, 2, n // 3 - 1, n // 3, n // 3 + 1, n - 1):
        past = rows[:i]
        hour = past[past["timestamp"] >= rows["timestamp"][i] - 3600]
        assert got["market_volume_last_1h"][i] == pytest.approx(hour["usdc"].sum(), abs=1e-6)
        assert got["market_total_volume_before"][i] == pytest.approx(past["usdc"].sum())
        assert got["time_since_last_market_trade"][i] == (rows["timestamp"][i] - rows["timestamp"][i - 1] if i else -1)
        yes = past[past["outcome_index"] == 1]["price"]
        assert got["last_price_yes"][i] == (yes.iloc[-1] if len(yes) else 0.0)


def test_the_hour_copies_no_rows(spark):
    """Running sums give the sweep and the distinct traders, exact beside huge values, and
    the rows are read once: no branch of leaving rows computes them again."""
    rng = np.random.default_rng(5)
    rows = [("m", f"u{rng.integers(9)}", int(t), f"{i:04}", 1e17 if i == 50 else float(rng.integers(1, 10**6)) / 1000) for i, t in enumerate(np.sort(rng.integers(0, 40_000, 300)))]
    df = spark.createDataFrame(rows, "market_id string, user_id string, timestamp long, trade_uid string, usdc double").withColumns({"price": F.lit(0.33), "size": F.col("usdc")})
    out = T.market_traders(T.pair_hour(T.market_hour(df, "sweep"), "sweep"))
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    have = {r["trade_uid"]: r for r in out.collect()}
    for i, (_, user, at, uid, _) in enumerate(rows):
        hour = [x for x in rows[:i] if x[2] >= at - 3600]
        mine = [x[4] for x in hour if x[1] == user]
        r = have[uid]
        assert r["market_volume_last_1h"] == pytest.approx(sum(x[4] for x in hour), rel=1e-12, abs=1e-9) and r["market_volatility_1h"] == pytest.approx(0, abs=1e-7)
        assert (r["num_unique_traders_last_1h"], r["user_trades_last_1h_in_market"]) == (len({x[1] for x in hour}), len(mine))
        assert r["user_usdc_last_1h_in_market"] == pytest.approx(sum(mine), rel=1e-12, abs=1e-9)


def test_a_later_run_of_markets_is_cut_too(spark):
    """The blocks of a micro-batch go on from what earlier runs add up to, as one pass does."""
    rng, n = np.random.default_rng(6), 300
    rows = [(f"m{rng.integers(3)}", int(t), f"{i:04}", float(rng.integers(1, 99)) / 100, float(rng.integers(1, 999)) / 8, int(rng.integers(2))) for i, t in enumerate(np.sort(rng.integers(0, 90_000, n)))]
    df = spark.createDataFrame(rows, "market_id string, timestamp long, trade_uid string, price double, usdc double, outcome_index int")
    first, later = df.where(f"timestamp < {rows[120][1]}"), df.where(f"timestamp >= {rows[120][1]}")
    nothing = F.lit(None).cast("struct<n:long,v:double,first:long,last:long,yes:double,no:double>")
    old = C.market_merged(C.market_sums(first, ["market_id"]).withColumn("_c", nothing))
    whole = {r["trade_uid"]: r.asDict() for r in T.market_prices(T.market_lifetime(df)).collect()}
    got = [r.asDict() for r in T.market_in_blocks(later, 7200, old).collect()]
    assert len(got) == later.count() < n
    for r in got:
        want = whole[r["trade_uid"]]
        assert r.keys() == want.keys() and r["market_id"] == want["market_id"]
        assert [r[c] for c in r if not isinstance(r[c], str)] == pytest.approx([want[c] for c in r if not isinstance(r[c], str)], rel=1e-12)
