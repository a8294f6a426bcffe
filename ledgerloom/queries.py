"""The registered queries over trades, each with SQL for another engine beside it.

Doubles are rounded to six places (from a million on to one), floats to four, and
whole numbers are longs, so that both engines give equal rows. A little is added
before rounding, as means of decimals often lie just between two roundings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import scalars as S
from ledgerloom.operators import markets as M
from ledgerloom.operators import metrics as X
from ledgerloom.operators import model as K
from ledgerloom.operators import ranking as R
from ledgerloom.operators import samples as P
from ledgerloom.operators import scaling as N
from ledgerloom.operators import sequences as Q
from ledgerloom.operators import trade_features as E
from ledgerloom.plans import feature_table
from ledgerloom.sources import fixture, sinks, trades as A
from ledgerloom.sources.shared import scratch, written
from ledgerloom.sql import ORACLE_SQL
from ledgerloom.streaming import features as J
from ledgerloom.streaming import incremental as I
from ledgerloom.streaming import profits as V

WINDOW, USER_WINDOW = 32, 16
TAUS = (0.0, 0.05, 0.1, 0.2)
#: The shuffle of epoch_batches, and into how many micro-batches and files a table is cut
#: that a query streams.
SHUFFLE_SEED, EPOCH, BATCH = 7, 3, 512
MICRO_BATCHES, FILES, DELAY = 3, 8, 50_000


def _rounded(x: Column) -> Column:
    """x with its little more, rounded to six places, or to one from a million on."""
    by = lambda more, unit: F.rint((x + more) * unit) / unit
    # Beyond that, units are too large for whole numbers of doubles.
    return F.when(F.abs(x) < 1e6, by(3.7e-8, 1e6)).when(F.abs(x) < 1e14, by(0.0137, 10.0)).otherwise(F.round(x + 0.0137, 1)) + 0.0


def tidy(df: DataFrame) -> DataFrame:
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            out[f.name] = _rounded(F.col(f.name))
        elif isinstance(f.dataType, T.FloatType):
            out[f.name] = F.round(F.col(f.name).cast("double"), 4) + 0.0
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out[f.name] = F.col(f.name).cast("long")
    return df.withColumns(out)


def _base(s: SparkSession, d: str) -> DataFrame:
    trades = fixture.trades(s, d)
    return E.base(trades, A.effective_ends(trades, fixture.markets(s, d)))


def _features(s: SparkSession, d: str) -> DataFrame:
    return feature_table.build(fixture.trades(s, d), fixture.markets(s, d))


def _splits(s: SparkSession, d: str) -> DataFrame:
    ends = A.effective_ends(fixture.trades(s, d), fixture.markets(s, d))
    return M.temporal_split(A.market_times(ends).select("market_id", "end_ts"))


def _meta(s: SparkSession, d: str) -> DataFrame:
    return M.market_meta(_splits(s, d), fixture.labels(s, d))


def _split_features(s: SparkSession, d: str) -> DataFrame:
    return M.with_split(_features(s, d), _meta(s, d))


def _tokens(s: SparkSession, d: str) -> DataFrame:
    return Q.market_tokens(_features(s, d), _meta(s, d))


def _both_tokens(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Market and user tokens from one feature table, computed once."""
    features = written(_features(s, d), "features")
    tokens = written(Q.market_tokens(features, _meta(s, d)), "market-tokens")
    return tokens, Q.user_tokens(features, Q.index(tokens, "market_id", "y"))


def _user_tokens(s: SparkSession, d: str) -> DataFrame:
    return _both_tokens(s, d)[1]


def _history(s: SparkSession, d: str) -> DataFrame:
    return Q.user_history(_split_features(s, d).where("split IS NOT NULL"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    rows = E.trade_local(_base(s, d)).join(_meta(s, d), "market_id")
    logit = 4 * (F.col("price") - 0.5) + 0.1 * (F.col("trade_uid").cast("long") % 7)
    return rows.select("trade_uid", "split", logit.alias("logit"), "y", "price", F.when(F.col("pnl_raw").isNotNull(), F.col("edge")).alias("edge"), "outcome_index", "log_usdc_size")


def _standard(s: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    # Read for the statistics, for each round of a fit, and for the rows.
    rows = written(_split_features(s, d), "split-features")
    columns = N.scaled_columns(rows.columns)
    stats = N.norm_stats(rows.where("split = 'train'"), columns)
    return N.standardised(rows, stats, columns), columns



def trades_valid(s, d):
    return A.valid(A.scan(fixture.trades(s, d))).select("trade_uid", "condition_id", "timestamp", "price", "size")


def trades_resume_after(s, d):
    return A.scan(fixture.trades(s, d), after=(1_705_000_000, "0000000500")).select("trade_uid", "timestamp")


def market_effective_end(s, d):
    return A.effective_ends(fixture.trades(s, d), fixture.markets(s, d)).select("condition_id", "effective_end_ts")


def iso_times(s, d):
    return A.market_times(fixture.markets(s, d)).select("market_id", "start_ts", "end_ts")


def trade_local_features(s, d):
    return E.trade_local(_base(s, d)).select("trade_uid", "edge", "log_usdc_size", "p_yes", "seconds_since_market_open", "time_of_day_sin", "time_of_day_cos")


def user_lifetime(s, d):
    return E.user_lifetime(_base(s, d)).select("trade_uid", "user_total_trades_before", "user_total_volume_before", "user_days_active_before", "user_time_since_first_trade")


def user_size_stats(s, d):
    return E.user_lifetime(_base(s, d)).select("trade_uid", "user_avg_size_before", "user_std_size_before")


def user_burstiness(s, d):
    return E.user_lifetime(_base(s, d)).select("trade_uid", "user_activity_burstiness", "time_since_user_last_trade")


def user_realized_pnl(s, d):
    return E.realised_pnl(_base(s, d)).select("trade_uid", "user_historical_pnl_before", "user_historical_winrate_before", "user_recent_pnl_last20", "user_pnl_std_before")


def market_lifetime(s, d):
    return E.market_lifetime(_base(s, d)).select("trade_uid", "market_total_trades_before", "market_total_volume_before", "market_time_since_first_trade", "dt_trade")


def market_price_moves(s, d):
    return E.market_prices(_base(s, d)).select("trade_uid", "last_price_yes", "last_price_no", "mid_price", "dp_yes")


def market_hour_stats(s, d):
    return E.market_hour(_base(s, d)).select("trade_uid", "market_volume_last_1h", "mean_trade_size_1h", "market_volatility_1h", "size_ratio_market")


def market_hour_sweep(s, d):
    return E.market_hour(_base(s, d), "sweep").select("trade_uid", "market_volume_last_1h", "mean_trade_size_1h", "market_volatility_1h", "size_ratio_market")


def market_hour_traders(s, d):
    return E.market_traders(_base(s, d)).select("trade_uid", "num_unique_traders_last_1h")


def pair_hour(s, d):
    return E.pair_hour(E.market_hour(_base(s, d))).select("trade_uid", "user_usdc_last_1h_in_market", "user_trades_last_1h_in_market", "user_share_of_volume_1h_in_market")


def pair_lifetime(s, d):
    return E.pair_lifetime(E.market_lifetime(_base(s, d))).select("trade_uid", "user_total_usdc_in_market", "user_trade_count_in_market", "user_share_of_volume_in_market", "time_since_user_last_trade_in_market")


def feature_vectors(s, d):
    """The vectors, a row for each place."""
    rows, columns = _standard(s, d)
    return N.vectors(rows, columns).select("trade_uid", F.posexplode("x").alias("slot", "value"))


def baseline_model_scores(s, d):
    rows, columns = _standard(s, d)
    model = K.fit_baseline(rows.where("split = 'train'"), columns)
    return K.score_baseline(model, rows.where("split IS NOT NULL")).select("trade_uid", "split", "logit")


def model_report(s, d):
    """A caller's own function as the model, by split."""
    rows = written(_scored(s, d), "scored")
    logits = K.score_with(rows, ["price", "log_usdc_size"], lambda x: 4 * (x["price"] - 0.5) + 0.01 * x["log_usdc_size"])
    return X.report(written(rows.drop("logit").join(logits, "trade_uid"), "scores"), "price_rule")


def market_index(s, d):
    return Q.index(_tokens(s, d), "market_id", "y")


def user_index(s, d):
    return Q.index(_user_tokens(s, d), "user_id")


def market_windows(s, d):
    rows = P.market_windows(written(_tokens(s, d), "market-tokens"), WINDOW)
    rows = rows.select("split", "market_id", F.posexplode(F.arrays_zip("market_x", "market_mask", "market_y")).alias("slot", "t"))
    x = [F.round(F.col("t.market_x")[i].cast("double"), 4).alias(c) for i, c in enumerate(P.MARKET_COLUMNS)]
    return rows.select("split", "market_id", "slot", F.col("t.market_mask").alias("mask"), F.col("t.market_y").alias("y"), *x)


def _dual(s: SparkSession, d: str, mode: str = "last", mask_mode: str = "own_time", epoch: int = 0) -> DataFrame:
    """Both sides of the dual samples, a row for each slot, values by their place
    (x0, x1, ...; null beyond the user side's)."""
    rows = P.dual_samples(*_both_tokens(s, d), WINDOW, USER_WINDOW, mask_mode=mask_mode, mode=mode, epoch=epoch)
    side = lambda x: F.transform(F.arrays_zip(F.col(f"{x}_x").alias("x"), F.col(f"{x}_mask").alias("mask"), F.col(f"{x}_y").alias("y"), F.sequence(F.lit(0), F.size(f"{x}_x") - 1).alias("slot")), lambda t: F.struct(F.lit(x).alias("side"), t["slot"].alias("slot"), t["x"].alias("x"), t["mask"].alias("mask"), t["y"].alias("y")))
    rows = rows.select("split", "market_id", F.explode(F.concat(side("market"), side("user"))).alias("t"))
    x = [F.round(F.get(F.col("t.x"), i).cast("double"), 4).alias(f"x{i}") for i in range(len(P.DUAL_COLUMNS))]
    return rows.select("split", "market_id", "t.side", "t.slot", "t.mask", F.col("t.y").alias("y"), *x)


def dual_samples(s, d):
    return _dual(s, d)


def dual_samples_asof(s, d):
    return _dual(s, d, mask_mode="asof").where("side = 'user'").select("split", "market_id", "slot", "mask", "y", "x0", "x1", "x2", "x3")


def market_cutoffs(s, d):
    """Where the sample of each market ends when the cutoff is drawn by a hash."""
    rows = P.numbered(written(_tokens(s, d), "market-tokens")).where("n >= 10").select("split", "market_id", "n").distinct()
    return rows.select("split", "market_id", "n", P.cutoff(F.col("n"), F.col("market_id"), 10, "hash", 3).alias("cut"))


def target_tokens(s, d):
    return P.targets(P.market_windows(written(_tokens(s, d), "market-tokens"), WINDOW, P.DUAL_COLUMNS))


def auc(s, d):
    return X.auc(_scored(s, d))


def _paths(s: SparkSession, d: str) -> DataFrame:
    """Paths of several makes: the marker first, within, in a longer name, twice, not at all."""
    heads = ["C:\\work\\LedgerLoom/data\\", "ledgerloom/data/", "E:/my-LEDGERLOOM\\d/", "/x/ledgerloom/a/ledgerloom/b/", "data\\only/"]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("trade_uid").cast("long") % len(heads) + 1).cast("int"))
    return fixture.trades(s, d).select("trade_uid", F.concat(head, "condition_id", F.lit("/part_"), "trade_uid").alias("path"))


def path_normalize(s, d):
    return _paths(s, d).select("trade_uid", S.project_path("path", "ledgerloom").alias("path"))


def path_report(s, d):
    return M.path_report(_paths(s, d), "ledgerloom")


def hash_buckets(s, d):
    return fixture.trades(s, d).select("proxy_wallet", S.bucket("proxy_wallet", S.USER_BUCKETS).alias("user_hash"), S.bucket("condition_id", 256).alias("shard")).distinct()


def core_metrics(s, d):
    return X.core_metrics(X.known(_scored(s, d)))


def metrics_by_split(s, d):
    rows = written(_scored(s, d), "scored")
    return X.core_metrics(X.known(rows), ["split"]).join(X.auc(rows, ["split"]).select("split", "auc"), "split")


def profit_threshold(s, d):
    return X.profit(_scored(s, d).where("y IS NOT NULL"), [0.1], use_size=True)


def profit_sweep(s, d):
    return X.profit(_scored(s, d).where("y IS NOT NULL"), TAUS, by=["split"])


def confidence_metrics(s, d):
    return X.confidence(_scored(s, d).where("y IS NOT NULL"), TAUS)


def confidence_signals(s, d):
    rows = _scored(s, d)
    return rows.select("trade_uid", S.signal(S.sigmoid("logit"), 0.1).alias("signal"), S.log_loss("logit", "y").alias("loss"))


def first_batch(s, d):
    return N.first_rows(_scored(s, d), 100).select("trade_uid", "price")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    events = s.readStream.schema(fixture.events(s, d).schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return E.base(fixture.trades_of(events), fixture.markets(s, d))


def stream_features(s, d):
    at = scratch(s, "stream")
    user = J.run_to_table(J.keyed_features(_streamed(s, d), "user_id"), f"{at}/user", f"{at}/user-state")
    market = J.run_to_table(J.keyed_features(_streamed(s, d), "market_id"), f"{at}/market", f"{at}/market-state")
    return user.drop("user_id", "timestamp").join(market.drop("market_id"), "trade_uid")


def _parts(trades: DataFrame, order) -> list[DataFrame]:
    """The trades in MICRO_BATCHES ranges of the order, of about equal size."""
    placed = trades.withColumn("_order", order)
    cuts = placed.agg(F.percentile_approx("_order", [k / MICRO_BATCHES for k in range(1, MICRO_BATCHES)])).first()[0]
    part = sum(((F.col("_order") > c).cast("int") for c in cuts), F.lit(0))
    return [placed.where(part == k).drop("_order") for k in range(MICRO_BATCHES)]


def _stream_of(s: SparkSession, parts: list[DataFrame], at: str) -> DataFrame:
    """A stream that takes one of these tables after the other."""
    for part in parts:
        part.repartition(FILES).write.mode("append").parquet(at)
    return s.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", FILES).parquet(at)


def stream_realized_pnl(s, d):
    """Profits by state and timers, over several micro-batches."""
    at = scratch(s, "stream")
    rows = E.base(_stream_of(s, _parts(fixture.trades(s, d), F.col("timestamp")), f"{at}/trades"), fixture.markets(s, d))
    return J.run_to_table(V.realised_stream(rows), f"{at}/table", f"{at}/state").drop("user_id", "timestamp")


def stream_feature_table(s, d):
    """All columns, over several micro-batches."""
    at = scratch(s, "stream")
    build = I.Build(s, f"{at}/table", fixture.markets(s, d))
    return build.run(_stream_of(s, _parts(fixture.trades(s, d), F.col("timestamp")), f"{at}/trades"), f"{at}/state")


def stream_after_batch(s, d):
    """The oldest third by a batch, which hands over to a stream of the rest."""
    at, parts = scratch(s, "stream"), _parts(fixture.trades(s, d), F.col("timestamp"))
    build = I.Build(s, f"{at}/table", fixture.markets(s, d))
    build.begin_with(parts[0])
    return build.run(_stream_of(s, parts[1:], f"{at}/trades"), f"{at}/state")


def stream_unordered(s, d):
    """Trades out of order by up to DELAY seconds, and a fiftieth of them a third of the
    time too late, which are put aside and repaired."""
    at, trades = scratch(s, "stream"), fixture.trades(s, d)
    span = trades.agg((F.max("timestamp") - F.min("timestamp")).alias("x")).first()[0]
    mixed = F.pmod(F.xxhash64("trade_uid"), F.lit(DELAY // 2))
    late = F.when(F.pmod(F.xxhash64("trade_uid", F.lit(1)), F.lit(50)) == 0, F.lit(span // 3)).otherwise(F.lit(0))
    build = I.Build(s, f"{at}/table", fixture.markets(s, d), delay=DELAY)
    build.run(_stream_of(s, _parts(trades, F.col("timestamp") + mixed + late), f"{at}/trades"), f"{at}/state")
    return build.repaired(trades)


def norm_stats_merged(s, d):
    """K2: statistics of each day, kept as a table, and merged into those of all days."""
    rows = _split_features(s, d).where("split = 'train'").withColumn("day", F.expr("timestamp DIV 86400"))
    columns = N.scaled_columns(feature_table.COLUMNS)
    return N.stats_of(written(N.norm_partials(rows, columns, "day"), "day-statistics"), columns)


def epoch_batches(s, d):
    """A batch and a slot for each trade of an epoch's shuffle of the whole table."""
    rows, n = R.numbered(A.valid(A.scan(fixture.trades(s, d))).select("trade_uid", "price"), ["trade_uid"])
    return R.epoch_batches(rows, n, SHUFFLE_SEED, EPOCH, BATCH)


def market_ranges(s, d):
    """The runs of the markets of the longest index entries, read by the index."""
    at, tokens = scratch(s, "store"), written(_tokens(s, d), "market-tokens")
    index = Q.index(tokens, "market_id", "y")
    sinks.write_sequences(tokens, f"{at}/sequences", "market_id", files=FILES)
    sinks.write_index(index, f"{at}/index", "market_id")
    longest = [r["market_id"] for r in index.orderBy(F.desc("length"), "market_id").select("market_id").limit(3).collect()]
    return sinks.read_range(s, f"{at}/sequences", f"{at}/index", "market_id", *longest).select("market_id", "split", "shard", "place", "timestamp", "trade_uid", "price", "y")


def market_store(s, d):
    """The sharded store of market tokens, each row with its place in its file."""
    at = f"{scratch(s, 'store')}/sequences"
    sinks.write_sequences(_tokens(s, d), at, "market_id")
    return s.read.parquet(at).select("split", "shard", "market_id", "trade_uid", F.col("_metadata.row_index").alias("row"))


def user_store(s, d):
    """The same by user."""
    at = f"{scratch(s, 'store')}/sequences"
    sinks.write_sequences(_user_tokens(s, d), at, "user_id")
    return s.read.parquet(at).select("split", "shard", "user_id", "trade_uid", F.col("_metadata.row_index").alias("row"))


def flat_store(s, d):
    """The flat history, written in ranges of the hash and read back."""
    at = f"{scratch(s, 'store')}/history"
    sinks.write_user_history(_history(s, d), at)
    return s.read.parquet(at)


def split_store(s, d):
    """Features by split with the markets' metadata in the same folder."""
    at = f"{scratch(s, 'store')}/features"
    meta = written(_meta(s, d), "meta")
    sinks.write_by_split(M.with_split(_features(s, d), meta), at, meta)
    copy = s.read.parquet(f"{at}/{sinks.META}").select("market_id", F.col("y").alias("meta_y"), F.col("split").alias("meta_split"))
    return s.read.parquet(at).select("trade_uid", "market_id", "split", "label_y").join(copy, "market_id")


def feature_files(s, d):
    """The feature table in files of at most a thousand rows, and how full they are."""
    at = f"{scratch(s, 'store')}/features"
    sinks.write_features(_features(s, d), at, rows_per_file=1000)
    w = Window.partitionBy("file")
    return s.read.parquet(at).select("trade_uid", "price", F.col("_metadata.file_path").alias("file")).withColumn("fits", F.count(F.lit(1)).over(w) <= 1000).drop("file")


def split_export(s, d):
    """A5: the table of splits as a file of its own."""
    at = f"{scratch(s, 'store')}/splits"
    ends = A.effective_ends(fixture.trades(s, d), fixture.markets(s, d))
    splits = _splits(s, d).select(F.col("market_id").alias("condition_id"), "split")
    A.split_table(ends.join(splits, "condition_id")).write.parquet(at)
    return s.read.parquet(at)


def scaler_file(s, d):
    """The scaler written as JSON and read back."""
    at = f"{scratch(s, 'store')}/scaler"
    sinks.write_scaler(N.norm_stats(_split_features(s, d).where("split = 'train'"), N.scaled_columns(feature_table.COLUMNS)), at)
    return sinks.read_scaler(s, at)


def report_file(s, d):
    """A report with its run's columns as JSON."""
    at = f"{scratch(s, 'store')}/report"
    sinks.write_report(core_metrics(s, d), at, {"model": "price_rule", "run": "1"})
    return s.read.json(at)


def binary_labels(s, d):
    """Labels as 0 or 1, 0 where there is none."""
    return _split_features(s, d).select("trade_uid", S.binary_label("label_y").alias("y"))


def hour_sliding(s, d):
    return J.sliding_hours(_base(s, d))


def user_sessions(s, d):
    return J.user_sessions(_base(s, d))


_PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        trades_valid, trades_resume_after, market_effective_end, iso_times, trade_local_features, user_lifetime, user_size_stats,
        user_burstiness, user_realized_pnl, market_lifetime, market_price_moves, market_hour_stats, market_hour_sweep, market_hour_traders,
        pair_hour, pair_lifetime, feature_vectors, baseline_model_scores, model_report, market_index, user_index, market_windows, dual_samples,
        dual_samples_asof, market_cutoffs, target_tokens, auc, path_normalize, path_report, hash_buckets, metrics_by_split, profit_threshold, profit_sweep, confidence_metrics,
        confidence_signals, first_batch, stream_features, hour_sliding, user_sessions,
        stream_realized_pnl, stream_feature_table, stream_after_batch, stream_unordered, norm_stats_merged, epoch_batches, market_ranges,
        market_store, user_store, flat_store, split_store, feature_files, split_export, scaler_file, report_file, binary_labels,
    )
} | {
    "feature_table": _features,
    "feature_table_blocks": lambda s, d: feature_table.build(fixture.trades(s, d), fixture.markets(s, d), strategy="sweep", block=86_400),
    "feature_table_whales": lambda s, d: feature_table.build(fixture.trades(s, d), fixture.markets(s, d), large=60),
    "temporal_split": _splits,
    "market_meta": _meta,
    "split_features": lambda s, d: _split_features(s, d).select("trade_uid", "market_id", "split", "label_y"),
    "unknown_markets": lambda s, d: M.unknown_markets(_base(s, d), _meta(s, d)),
    "split_counts": lambda s, d: M.split_counts(_split_features(s, d)),
    "norm_stats": lambda s, d: N.norm_stats(_split_features(s, d).where("split = 'train'"), N.scaled_columns([*feature_table.COLUMNS, "label_y"])),
    "standardized": lambda s, d: _standard(s, d)[0].select("trade_uid", "split", "dt_trade", "user_total_volume_before", "market_volatility_1h", "price"),
    "market_tokens": lambda s, d: _tokens(s, d),
    "user_tokens": lambda s, d: _user_tokens(s, d),
    "user_history_flat": lambda s, d: _history(s, d),
    "user_flat_index": lambda s, d: Q.flat_index(_history(s, d)),
    "baseline_metrics": core_metrics,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: (lambda s, d, f=f: tidy(f(s, d))) for k, f in _PLANS.items()}
__all__ = ["ORACLE_SQL", "QUERIES"]
