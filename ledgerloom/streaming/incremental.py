"""The whole feature table, built incrementally from a stream of trades.

Each micro-batch is a run of trades: Spark's windows over the run and one carried row of
each key that it touches (see operators.carried) give all columns of the table. Trades
may come in any order within `delay` seconds: a trade waits until one that is `delay`
seconds newer has come, so that runs follow each other in time; what comes later than
that is put aside and counted, and repair() computes the rows anew that it touches.

Everything is a table below one folder that all executors share, in versions named after
the micro-batch. A version counts once its row in commits/ is there: a batch that is
repeated after a failure reads the version before it and writes its own again, so each
trade counts exactly once. States are kept as changes, a full copy every COMPACT versions.
Ends are those announced by the markets table, as a stream cannot know the last trade.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import carried as C
from ledgerloom.operators import trade_features as T
from ledgerloom.plans import feature_table
from ledgerloom.sources.trades import COLUMNS, market_times, scan, valid

COMPACT = 8
RAW = "trade_uid string, proxy_wallet string, condition_id string, timestamp long, price double, size double, usdc_size double, outcome_index int, pnl_raw double"
COMMIT = "version long, base long, top long, frontier long, rows long, late long, waiting long"
EVENT = "user_id string, pnl double, _k long, _ph int, _ku string, _end long, timestamp long, trade_uid string"
HALO = "market_id string, user_id string, timestamp long, trade_uid string, price double, size double, usdc double"


@dataclass(frozen=True)
class State:
    """A carried state: its keys, its columns, and how it is summed and merged."""

    name: str
    keys: tuple[str, ...]
    columns: str
    merged: Callable[[DataFrame], DataFrame]

    @property
    def schema(self) -> str:
        return ", ".join([*(f"{k} string" for k in self.keys), self.columns, "version long"])


MARKETS = State("markets", ("market_id",), C.MARKET_STATE, C.market_merged)
USERS = State("users", ("user_id",), C.USER_STATE, C.user_merged)
PAIRS = State("pairs", ("market_id", "user_id"), C.PAIR_STATE, C.pair_merged)
PROFITS = State("profits", ("user_id",), C.PNL_STATE, C.pnl_merged)


class Build:
    """A feature table that grows. path: its folder; delay: seconds that trades may come
    out of order."""

    def __init__(self, spark: SparkSession, path: str, markets: DataFrame, delay: int = 0, std_mode: str = "rms"):
        self.spark, self.path, self.delay, self.std_mode = spark, path.rstrip("/"), delay, std_mode
        self.times = market_times(markets)

    # ---- tables in versions

    def _at(self, name: str, version: int) -> str:
        return f"{self.path}/{name}/v={version}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _write(self, df: DataFrame, name: str, version: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._at(name, version))
        return self.spark.read.schema(df.schema).parquet(self._at(name, version))

    def _read(self, name: str, schema: str, versions) -> DataFrame:
        paths = [p for v in versions if self._exists(p := self._at(name, v))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """A row for each version: the newest trade's time, the frontier that runs have
        come to, and how many trades it built, came too late, and wait."""
        return self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits/*") if self._exists(f"{self.path}/commits") else self.spark.createDataFrame([], COMMIT)

    def _before(self, version: int) -> dict:
        last = self.commits().where(F.col("version") < version).orderBy(F.desc("version")).first()
        return last.asDict() if last else {"version": -1, "base": 0, "top": None, "frontier": None}

    def features(self) -> DataFrame:
        """The rows of all versions that count."""
        done = [r["version"] for r in self.commits().select("version").collect()]
        return self._read("features", feature_schema(), sorted(done))

    def late(self) -> DataFrame:
        """Trades that came after their place had been built."""
        return self._read("late", RAW, [r["version"] for r in self.commits().select("version").collect()])

    def state(self, kind: State, last: dict | None = None) -> DataFrame:
        """The newest row of each key."""
        last = last or self._before(1 << 62)
        rows = self._read(kind.name, kind.schema, range(last["base"], last["version"] + 1))
        newest = rows.groupBy(*kind.keys).agg(F.max_by(F.struct(*rows.columns), "version").alias("_r"))
        return newest.select("_r.*")

    # ---- one version

    def _carry_on(self, kind: State, sums: DataFrame, old: DataFrame, version: int, whole: bool) -> None:
        """Writes the state after this run: of the touched keys, or of all of them."""
        new = kind.merged(C.carry(sums, old, kind.keys, kind.columns)).withColumn("version", F.lit(version).cast("long"))
        names = [x.split()[0] for x in kind.schema.split(", ")]
        new = new.select(*names)
        if whole:
            new = new.unionByName(old.join(sums.select(*kind.keys), list(kind.keys), "left_anti").select(*names))
        self._write(new, kind.name, version)

    def step(self, trades: DataFrame, version: int, finish: bool = False) -> None:
        """Takes a micro-batch of trades (with the nine columns of scan()) as this version.
        finish: whatever waits is built as well. A version that counts already is left as it is."""
        last = self._before(version)
        if self._exists(self._at("commits", version)):
            return
        arrived = self._write(scan(trades).select(*[F.col(c).cast(t) for c, t in (x.split() for x in RAW.split(", "))]), "arrived", version)
        newest = arrived.agg(F.max("timestamp")).first()[0]
        top = max((x for x in (newest, last["top"]) if x is not None), default=None)
        frontier = last["frontier"]
        if top is not None:
            frontier = max((x for x in (frontier, top + 1 if finish else top - self.delay) if x is not None), default=None)
        in_time = F.lit(True) if last["frontier"] is None else F.col("timestamp") >= last["frontier"]
        late = self._write(arrived.where(~in_time), "late", version)
        known = self._read("waiting", RAW, [last["version"]]).unionAll(arrived.where(in_time))
        due = F.lit(False) if frontier is None else F.col("timestamp") < frontier
        waiting = self._write(known.where(~due), "waiting", version)
        run = self._write(T.trade_local(T.base_of(known.where(due), self.times)), "run", version)
        base = version if version - last["base"] >= COMPACT or last["version"] < 0 else last["base"]
        built = self._build(run, last, version, frontier, base == version)
        row = (version, base, top, frontier, built.count(), valid(late).count(), valid(waiting).count())
        self.spark.createDataFrame([row], COMMIT).write.mode("overwrite").parquet(self._at("commits", version))
        for name in ("arrived", "run"):
            self._delete(self._at(name, version))
        self._delete(self._at("waiting", version - 2))

    def _build(self, run: DataFrame, last: dict, version: int, frontier: int | None, whole: bool) -> DataFrame:
        old = {kind.name: self._write(self.state(kind, last), f"old-{kind.name}", version) for kind in (MARKETS, USERS, PAIRS, PROFITS)}
        # Markets in time blocks, so that no task orders all of a market's rows of this run.
        rows = T.market_in_blocks(run, feature_table.BLOCK, old["markets"])
        rows = C.pair_after(C.carry(rows, old["pairs"], PAIRS.keys, C.PAIR_STATE), PAIRS.keys)
        # The hour before the run: trades of a market's last version within an hour of its end.
        halo = self._read("hours", f"{HALO}, version long", range(last["base"], last["version"] + 1))
        halo = halo.join(old["markets"].select("market_id", "version"), ["market_id", "version"], "left_semi").drop("version")
        touched = run.select("market_id").distinct()
        near = halo.join(touched, "market_id", "left_semi")
        rows = rows.withColumn("_new", F.lit(True)).unionByName(near.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        rows = T.with_halo(rows, feature_table.BLOCK)
        rows = T.own(T.market_traders(T.pair_hour(T.market_hour(rows, "sweep"), "sweep")).where("_new")).drop("_new")
        rows = C.user_after(C.carry(rows, old["users"], ["user_id"], C.USER_STATE), ["user_id"])
        # Profits that are known by the frontier: of this run's trades, or kept from before.
        events = C.pnl_events(run)
        passed = F.lit(False) if frontier is None else F.col("_k") < frontier
        pending = self._read("pending", EVENT, range(last["base"], last["version"] + 1))
        if last["frontier"] is not None:
            pending = pending.where(F.col("_k") >= last["frontier"])
        due = self._write(pending.where(passed).unionByName(events.where(passed)), "due", version)
        later = events.where(~passed)
        self._write(later.unionByName(pending.where(~passed)) if whole else later, "pending", version)
        rows = C.carry(rows, old["profits"], ["user_id"], C.PNL_STATE)
        rows = C.pnl_after(rows, C.carry(due, old["profits"], ["user_id"], C.PNL_STATE), ["user_id"], self.std_mode)
        built = self._write(rows.select(*feature_table.COLUMNS), "features", version)
        self._carry_on(USERS, C.user_sums(run, ["user_id"]), old["users"], version, whole)
        self._carry_on(PAIRS, C.pair_sums(run, PAIRS.keys), old["pairs"], version, whole)
        self._carry_on(PROFITS, C.pnl_sums(due, ["user_id"]), old["profits"], version, whole)
        sums = C.market_sums(run, ["market_id"])
        self._carry_on(MARKETS, sums, old["markets"], version, whole)
        halo = halo if whole else near
        ends = sums.select("market_id", F.col("last").alias("_last"))
        hour = run.select(*near.columns).unionByName(halo).join(ends, "market_id", "left").where(F.coalesce(F.col("timestamp") >= F.col("_last") - T.HOUR, F.lit(True)))
        # A market that this run did not touch keeps the version that its state has.
        of = hour.join(old["markets"].select("market_id", F.col("version").alias("_old")), "market_id", "left")
        at = F.when(F.col("_last").isNotNull(), F.lit(version)).otherwise(F.col("_old")).cast("long")
        self._write(of.withColumn("version", at).drop("_last", "_old"), "hours", version)
        for kind in (MARKETS, USERS, PAIRS, PROFITS):
            self._delete(self._at(f"old-{kind.name}", version))
        self._delete(self._at("due", version))
        return built

    # ---- whole runs

    def run(self, stream: DataFrame, checkpoint: str, finish: bool = True) -> DataFrame:
        """Takes all that the stream has, a version for each micro-batch, and gives the
        table. A later call with the same checkpoint goes on where this one ended. finish:
        what waits for newer trades is built at the end."""
        done = self._before(1 << 62)["version"]
        # A table that was begun by a batch, or finished, has versions the stream does not know.
        shift = self._shift(checkpoint, done + 1)
        query = stream.writeStream.foreachBatch(lambda df, i: self.step(df, i + shift)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if finish:
            self.step(self.spark.createDataFrame([], RAW), self._before(1 << 62)["version"] + 1, finish=True)
        return self.features()

    def _shift(self, checkpoint: str, free: int) -> int:
        """How far versions are ahead of the stream's batch numbers: noted for each start
        of the stream, by the first batch that is not committed to its checkpoint."""
        at = f"{self.path}/starts"
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(checkpoint).getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = self.spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
        ids = [int(f.getPath().getName()) for f in fs.listStatus(found) if f.getPath().getName().isdigit()] if fs.exists(found) else []
        following = max(ids, default=-1) + 1
        starts = self.spark.read.schema("batch long, shift long").parquet(at) if self._exists(at) else self.spark.createDataFrame([], "batch long, shift long")
        known = starts.where(F.col("batch") == following).agg(F.min("shift")).first()[0]
        if known is None:
            known = free - following
            self.spark.createDataFrame([(following, known)], "batch long, shift long").write.mode("append").parquet(at)
        return known

    def begin_with(self, trades: DataFrame) -> None:
        """Hands a batch over: version 0 is the batch build of these trades, with the
        carried rows of all keys, so that a stream of later trades can go on from it."""
        if self._exists(self._at("commits", 0)):
            return
        rows = valid(scan(trades))
        end = trades.agg(F.max("timestamp")).first()[0]
        run = self._write(T.trade_local(T.base_of(rows, self.times)), "run", 0)
        events, frontier = C.pnl_events(run), None if end is None else end + 1
        passed = F.lit(False) if frontier is None else F.col("_k") < frontier
        at = F.lit(0).cast("long")
        put = lambda kind, sums: self._write(kind.merged(sums.withColumn("_c", F.lit(None).cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in kind.columns.split(', '))}>"))).withColumn("version", at).select(*[x.split()[0] for x in kind.schema.split(", ")]), kind.name, 0)
        put(MARKETS, C.market_sums(run, ["market_id"]))
        put(PAIRS, C.pair_sums(run, PAIRS.keys))
        put(USERS, C.user_sums(run, ["user_id"]))
        put(PROFITS, C.pnl_sums(events.where(passed), ["user_id"]))
        self._write(events.where(~passed), "pending", 0)
        last = run.groupBy("market_id").agg(F.max("timestamp").alias("_last"))
        hour = run.join(last, "market_id").where(F.col("timestamp") >= F.col("_last") - T.HOUR)
        self._write(hour.select(*[x.split()[0] for x in HALO.split(", ")]).withColumn("version", at), "hours", 0)
        built = self._write(feature_table.of(run, "sweep", self.std_mode), "features", 0)
        row = (0, 0, end, frontier, built.count(), 0, 0)
        self.spark.createDataFrame([row], COMMIT).write.mode("overwrite").parquet(self._at("commits", 0))
        self._delete(self._at("run", 0))

    def repaired(self, trades: DataFrame) -> DataFrame:
        """The table with the trades that came too late in their places. trades: all
        trades that were streamed, the late ones among them. Only markets and users with
        a late trade are computed anew: the columns of a market's rows, and those of a
        user's. All other columns stay as they were built. The result's later use as a
        table (and a new begin) is the caller's."""
        late = valid(self.late()).select(F.col("condition_id").alias("market_id"), F.col("proxy_wallet").alias("user_id"), "trade_uid")
        rows = T.trade_local(T.base_of(scan(trades), self.times))
        market = rows.join(late.select("market_id").distinct(), "market_id", "left_semi")
        user = rows.join(late.select("user_id").distinct(), "user_id", "left_semi")
        by_market = feature_table.market_part(market).select(*_MARKET_PART)
        by_user = feature_table.user_part(user, self.std_mode).select("trade_uid", *[c for c in feature_table.COLUMNS if c not in _MARKET_PART])
        missing = by_user.join(by_market, "trade_uid").join(late.select("trade_uid"), "trade_uid", "left_semi")
        kept = self.features()
        for part in (by_market, by_user):
            new = part.select("trade_uid", F.struct(*[c for c in part.columns if c != "trade_uid"]).alias("_new"))
            mine = [c for c in part.columns if c != "trade_uid"]
            kept = kept.join(new, "trade_uid", "left").withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in mine}).drop("_new")
        return kept.select(*feature_table.COLUMNS).unionByName(missing.select(*feature_table.COLUMNS))


_MARKET_PART = [
    "trade_uid", "dp_yes", "dt_trade", "market_time_since_first_trade", "market_total_trades_before", "market_total_volume_before", "market_volume_last_1h",
    "num_unique_traders_last_1h", "market_volatility_1h", "mean_trade_size_1h", "size_ratio_market", "last_price_yes", "last_price_no", "mid_price", "price_deviation",
    "signed_price_deviation", "time_since_last_market_trade", "user_usdc_last_1h_in_market", "user_trades_last_1h_in_market", "user_share_of_volume_1h_in_market",
    "user_total_usdc_in_market", "user_trade_count_in_market", "user_share_of_volume_in_market", "time_since_user_last_trade_in_market",
]
_LONGS = {
    "timestamp", "dt_trade", "seconds_since_market_open", "user_time_since_first_trade", "market_time_since_first_trade", "user_total_trades_before", "user_days_active_before",
    "time_since_user_last_trade", "market_total_trades_before", "num_unique_traders_last_1h", "time_since_last_market_trade", "user_trades_last_1h_in_market",
    "user_trade_count_in_market", "time_since_user_last_trade_in_market",
}


def feature_schema() -> str:
    kind = lambda c: "string" if c in ("trade_uid", "user_id", "market_id") else "int" if c == "outcome_index" else "long" if c in _LONGS else "double"
    return ", ".join(f"{c} {kind(c)}" for c in feature_table.COLUMNS)
