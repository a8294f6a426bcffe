"""Causal features of a run of trades, given what is carried over from the trades before.

A key's history is cut into runs: time blocks of a batch, or the micro-batches of a
stream. What a run adds to its key's totals is one row (`*_sums`), and `*_after` computes
the columns of a run's own rows by windows within the run and one carried row of its key.
`*_prefix` makes the carried rows of all runs of a batch, `*_merged` the one after a run.
Carried rows hold counts, sums, moments (merged as by Chan), first and last times and
prices, and short tails: the last 20 gaps and profits, whatever time they lie back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import trade_features as T

#: Gaps and profits that the last-20 columns look back on; a gap needs the time before it.
RECENT = 20
MARKET_STATE = "n long, v double, first long, last long, yes double, no double"
USER_STATE = "n long, v double, first long, last long, day long, changes long, mean double, m2 double, tail array<long>"
PAIR_STATE = "n long, v double, last long"
PNL_STATE = "s double, ss double, n long, won long, lost long, tail array<double>"


def fields(state: str) -> list[str]:
    return [x.split()[0] for x in state.split(", ")]


def _last(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def _past(key: Sequence[str]):
    return Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def carry(rows: DataFrame, carried: DataFrame, keys: Sequence[str], state: str) -> DataFrame:
    """rows with their key's carried row as the struct _c; null where nothing came before."""
    more = [_squares().alias("squares")] if state == USER_STATE else []
    return rows.join(carried.select(*keys, F.struct(*fields(state), *more).alias("_c")), list(keys), "left")


def _squares() -> Column:
    """Sums of the squares of the tail's last 0, 1, 2, ... gaps: once for a key, so that its
    rows need no loop."""
    places = F.when(F.size("tail") > 1, F.sequence(F.lit(1), F.size("tail") - 1)).otherwise(F.array().cast("array<int>"))
    gap = lambda i: F.element_at("tail", -i) - F.element_at("tail", -i - 1)
    return F.aggregate(places, F.array(F.lit(0).cast("long")), lambda sums, i: F.concat(sums, F.array(F.element_at(sums, -1) + gap(i) * gap(i))))


def _or(name: str, other) -> Column:
    return F.coalesce(F.col(f"_c.{name}"), other if isinstance(other, Column) else F.lit(other))


# ---- markets and users in markets


def market_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    place = F.struct(*T.ORDER)
    price = lambda test: F.max_by("price", F.when(test & F.col("price").isNotNull(), place))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("usdc").alias("v"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        price(F.col("outcome_index") == 1).alias("yes"), price(F.col("outcome_index") != 1).alias("no"),
    )


def _plus(*sums: str) -> dict[str, Column]:
    return {x: F.coalesce(f"_c.{x}", F.lit(0)) + F.col(x) for x in sums}


def market_merged(sums: DataFrame) -> DataFrame:
    """sums with _c become the totals after the run."""
    return sums.withColumns(_plus("n", "v") | {"first": _or("first", F.col("first")), "yes": F.coalesce("yes", "_c.yes"), "no": F.coalesce("no", "_c.no")}).drop("_c")


def market_after(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """market_lifetime() and market_prices() of the run's rows, which have _c."""
    w = Window.partitionBy(*keys).orderBy(*T.ORDER)
    past = T.before(w)
    last = lambda test: F.last(F.when(test, F.col("price")), ignorenulls=True).over(past)
    rows = rows.withColumn("p_yes", S.p_yes("price", "outcome_index")).withColumns({
        "_yes": F.coalesce(last(F.col("outcome_index") == 1), F.col("_c.yes")), "_no": F.coalesce(last(F.col("outcome_index") != 1), F.col("_c.no")),
        "_gap": F.col("timestamp") - F.coalesce(F.lag("timestamp").over(w), F.col("_c.last")),
        "market_total_trades_before": F.count(F.lit(1)).over(past) + _or("n", 0),
        "market_total_volume_before": F.coalesce(F.sum("usdc").over(past), F.lit(0.0)) + _or("v", 0.0),
        "market_time_since_first_trade": F.col("timestamp") - _or("first", F.min("timestamp").over(w)),
    })
    gap, mid = F.coalesce("_gap", F.lit(-1)), F.coalesce("_yes", "p_yes")
    move = F.col("p_yes") - mid
    out = {
        "dt_trade": gap, "time_since_last_market_trade": gap, "last_price_yes": F.coalesce("_yes", F.lit(0.0)), "last_price_no": F.coalesce("_no", F.lit(0.0)),
        "mid_price": mid, "dp_yes": move, "price_deviation": move, "signed_price_deviation": move,
    }
    return rows.withColumns(out).drop("_yes", "_no", "_gap", "_c")


def pair_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("usdc").alias("v"), F.max("timestamp").alias("last"))


def pair_merged(sums: DataFrame) -> DataFrame:
    return sums.withColumns(_plus("n", "v")).drop("_c")


def pair_after(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """pair_lifetime() of the run's rows, which have _c and market_total_volume_before."""
    w = Window.partitionBy(*keys).orderBy(*T.ORDER)
    gap = F.col("timestamp") - F.coalesce(F.lag("timestamp").over(w), F.col("_c.last"))
    rows = rows.withColumns({
        "user_total_usdc_in_market": F.coalesce(F.sum("usdc").over(T.before(w)), F.lit(0.0)) + _or("v", 0.0),
        "user_trade_count_in_market": F.count(F.lit(1)).over(T.before(w)) + _or("n", 0),
        "time_since_user_last_trade_in_market": F.when(gap.isNull(), F.lit(-1)).otherwise(F.greatest(gap, F.lit(1))),
    })
    return rows.withColumn("user_share_of_volume_in_market", S.share("user_total_usdc_in_market", "market_total_volume_before")).drop("_c")


# ---- users


_DAY = "timestamp DIV 86400"


def user_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """changes: how often the day changes within the run; tail: the last times."""
    w = Window.partitionBy(*keys).orderBy(*T.ORDER)
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("timestamp"), F.desc("trade_uid")))
    day, size = F.expr(_DAY), F.abs("size")
    rows = rows.withColumns({"_change": day != F.lag(day).over(w), "_newest": newest})
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("usdc").alias("v"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.min(day).alias("day0"), F.max(day).alias("day"), F.count_if("_change").alias("changes"), F.avg(size).alias("mean"), (F.var_pop(size) * F.count(size)).alias("m2"),
        F.array_sort(F.collect_list(F.when(F.col("_newest") <= RECENT + 1, F.col("timestamp")))).alias("tail"),
    )


def _chan(n0: Column, mean0: Column, m20: Column, n: Column, mean: Column, m2: Column) -> tuple[Column, Column]:
    """Mean and sum of squared deviations of two parts together."""
    both, apart = F.when(n0 + n > 0, n0 + n), mean - mean0
    return F.coalesce(mean0 + apart * n / both, F.lit(0.0)), F.coalesce(m20 + m2 + apart * apart * n0 * n / both, F.lit(0.0))


def user_merged(sums: DataFrame) -> DataFrame:
    mean, m2 = _chan(_or("n", 0), _or("mean", 0.0), _or("m2", 0.0), F.col("n"), F.col("mean"), F.col("m2"))
    none = F.array().cast("array<long>")
    changed = F.coalesce((F.col("day0") != F.col("_c.day")).cast("long"), F.lit(0))
    more = {"first": _or("first", F.col("first")), "changes": _or("changes", 0) + F.col("changes") + changed, "mean": mean, "m2": m2, "tail": _last(F.concat(_or("tail", none), F.col("tail")), RECENT + 1)}
    return sums.withColumns(_plus("n", "v") | more).drop("_c", "day0")


def user_prefix(sums: DataFrame, key: Sequence[str] = ("user_id",)) -> DataFrame:
    """The carried row of each block _b, from the sums of its key's blocks."""
    past = _past(key)
    changed = F.col("changes") + F.coalesce((F.col("day0") != F.lag("day").over(Window.partitionBy(*key).orderBy("_b"))).cast("long"), F.lit(0))
    sums = sums.withColumns({"changes": changed, "_x": F.col("n") * F.col("mean"), "_xx": F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")})
    tails = F.flatten(F.collect_list("tail").over(Window.partitionBy(*key).orderBy("_b").rowsBetween(-RECENT - 1, -1)))
    sums = sums.select(
        *key, "_b", F.sum("n").over(past).alias("n"), F.sum("v").over(past).alias("v"), F.min("first").over(past).alias("first"), F.max("last").over(past).alias("last"),
        F.max("day").over(past).alias("day"), F.sum("changes").over(past).alias("changes"), F.sum("_x").over(past).alias("_x"), F.sum("_xx").over(past).alias("_xx"), _last(tails, RECENT + 1).alias("tail"),
    )
    mean = F.col("_x") / F.col("n")
    return sums.withColumns({"mean": mean, "m2": F.greatest(F.col("_xx") - mean * F.col("_x"), F.lit(0.0))}).where("n IS NOT NULL").drop("_x", "_xx")


def user_after(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """user_lifetime() of the run's rows, which have _c."""
    w = Window.partitionBy(*keys).orderBy(*T.ORDER)
    past, day, size = T.before(w), F.expr(_DAY), F.abs("size")
    rows = rows.withColumns({
        "_new_day": (day != F.coalesce(F.lag(day).over(w), F.col("_c.day"))).cast("long"),
        "_gap": F.col("timestamp") - F.coalesce(F.lag("timestamp").over(w), F.col("_c.last")),
        "_n": F.count(F.lit(1)).over(past), "_mean": F.coalesce(F.avg(size).over(past), F.lit(0.0)), "_m2": F.coalesce(F.var_pop(size).over(past) * F.count(size).over(past), F.lit(0.0)),
    })
    mean, m2 = _chan(_or("n", 0), _or("mean", 0.0), _or("m2", 0.0), F.col("_n"), F.col("_mean"), F.col("_m2"))
    last20 = w.rowsBetween(-RECENT, -1)
    gap = F.col("_gap")
    rows = rows.withColumns({"_g": F.count(gap).over(last20), "_gs": F.coalesce(F.sum(gap).over(last20), F.lit(0)), "_gq": F.coalesce(F.sum(gap * gap).over(last20), F.lit(0)), "_gv": F.var_pop(gap).over(last20)})
    # Within the run the frame is enough; at its beginning gaps of the tail stand before,
    # whose sum is the time from first to last. Whole numbers, so the variance is exact.
    rows = rows.withColumn("_old", F.least(F.lit(RECENT) - F.col("_g"), F.size("_c.tail") - 1).cast("int"))
    many = F.col("_g") + F.col("_old")
    total = F.col("_gs") + F.element_at("_c.tail", -1) - F.element_at("_c.tail", -1 - F.col("_old"))
    squares = F.col("_gq") + F.element_at("_c.squares", F.col("_old") + 1)
    spread = (many.cast("decimal(5,0)") * squares.cast("decimal(20,0)") - total.cast("decimal(15,0)") * total.cast("decimal(15,0)")).cast("double") / (many * many)
    n = F.col("_n") + _or("n", 0)
    short = (F.col("_n") < RECENT) & F.col("_c").isNotNull()
    burst = F.when(short, F.when(many >= 2, spread).otherwise(0.0)).otherwise(F.when(F.col("_g") >= 2, F.col("_gv")).otherwise(0.0))
    return rows.withColumns({
        "user_total_trades_before": n,
        "user_total_volume_before": F.coalesce(F.sum("usdc").over(past), F.lit(0.0)) + _or("v", 0.0),
        "user_days_active_before": F.coalesce(F.sum("_new_day").over(past), F.lit(0)) + _or("changes", 0) + 1,
        "user_time_since_first_trade": F.col("timestamp") - _or("first", F.min("timestamp").over(w)),
        "user_avg_size_before": mean,
        "user_std_size_before": F.when(n > 0, F.sqrt(F.greatest(m2, F.lit(0.0)) / n)).otherwise(F.lit(0.0)),
        "time_since_user_last_trade": F.coalesce("_gap", F.lit(-1)),
        "user_activity_burstiness": burst,
    }).drop("_new_day", "_gap", "_n", "_mean", "_m2", "_c", "_g", "_gs", "_gq", "_gv", "_old")


# ---- profits


_PLACE = ["_k", "_ph", "_ku", "_end", *T.ORDER]


def pnl_events(rows: DataFrame) -> DataFrame:
    """A trade's profit and its place: before all trades of its market's end's second, or
    right after its own trade if the market had ended."""
    late = F.col("end_ts") <= F.col("timestamp")
    return rows.where("end_ts IS NOT NULL AND pnl_raw IS NOT NULL").select(
        "user_id", F.col("pnl_raw").alias("pnl"), F.when(late, F.col("timestamp")).otherwise(F.col("end_ts")).alias("_k"), late.cast("int").alias("_ph"),
        F.when(late, F.col("trade_uid")).otherwise(F.lit("")).alias("_ku"), F.col("end_ts").alias("_end"), *T.ORDER,
    )


def pnl_sums(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in _PLACE]))
    pnl = F.col("pnl")
    tail = F.array_sort(F.collect_list(F.when(F.col("_newest") <= RECENT, F.struct((-F.col("_newest")).alias("at"), "pnl"))))
    return events.withColumn("_newest", newest).groupBy(*keys).agg(
        F.sum(pnl).alias("s"), F.sum(pnl * pnl).alias("ss"), F.count(pnl).alias("n"), F.count_if(pnl > 0).alias("won"), F.count_if(pnl < 0).alias("lost"),
        F.transform(tail, lambda x: x["pnl"]).alias("tail"),
    )


def pnl_merged(sums: DataFrame) -> DataFrame:
    none = F.array().cast("array<double>")
    return sums.withColumns(_plus("s", "ss", "n", "won", "lost") | {"tail": _last(F.concat(_or("tail", none), F.col("tail")), RECENT)}).drop("_c")


def pnl_prefix(sums: DataFrame, blocks: DataFrame, key: Sequence[str] = ("user_id",)) -> DataFrame:
    """The carried row of each block of `blocks` (key, _b): profits of earlier blocks, which
    may have none or no trades themselves."""
    w = Window.partitionBy(*key).orderBy("_b")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    tails = F.flatten(F.collect_list("tail").over(w.rowsBetween(-RECENT + 1, 0)))
    total = [F.sum(c).over(upto).alias(c) for c in ("s", "ss", "n", "won", "lost")]
    known = sums.select(*key, "_b", F.struct(*total, _last(tails, RECENT).alias("tail")).alias("_known"))
    all_of = blocks.select(*key, "_b").distinct().join(known, [*key, "_b"], "full")
    return all_of.withColumn("_known", F.last("_known", ignorenulls=True).over(_past(key))).where("_known IS NOT NULL").select(*key, "_b", "_known.*")


def pnl_after(rows: DataFrame, events: DataFrame, keys: Sequence[str], std_mode: str = "rms") -> DataFrame:
    """realised_pnl() of the run's rows. rows and events (those of the run) have _c."""
    none = F.array().cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    w = Window.partitionBy(*keys).orderBy(*_PLACE)
    nth = F.row_number().over(w)
    # The sum of the last 20 at an event: those of the run, and of the tail before them.
    missing = F.greatest(F.lit(RECENT) - F.col("_nth"), F.lit(0))
    events = events.withColumns({"_nth": nth, "_r20": F.sum("pnl").over(w.rowsBetween(-RECENT + 1, 0))})
    tail = _or("tail", none)
    older = F.when((missing > 0) & (F.size(tail) > 0), total(F.slice(tail, F.greatest(F.size(tail) - missing + 1, F.lit(1)), missing))).otherwise(F.lit(0.0))
    events = events.withColumn("_r20", F.col("_r20") + older).drop("_c", "_nth").withColumn("_after", F.lit(1))
    placed = rows.withColumns({"_k": F.col("timestamp"), "_ph": F.lit(1), "_ku": F.col("trade_uid"), "_after": F.lit(0), "_end": F.lit(None).cast("long")})
    t = T.before(Window.partitionBy(*keys).orderBy("_k", "_ph", "_ku", "_after", "_end", *T.ORDER))
    pnl = F.col("pnl")
    sums = {"_s": F.sum(pnl), "_ss": F.sum(pnl * pnl), "_n": F.count(pnl), "_won": F.count_if(pnl > 0), "_lost": F.count_if(pnl < 0), "_last": F.last("_r20", ignorenulls=True)}
    both = placed.unionByName(events, allowMissingColumns=True).withColumns({k: x.over(t) for k, x in sums.items()}).where("_after = 0")
    own = {k: F.coalesce(k, F.lit(0)) + _or(k[1:], 0) for k in ("_s", "_ss", "_n", "_won", "_lost")}
    n, mean = own["_n"], own["_s"] / own["_n"]
    var = own["_ss"] / n - (mean * mean if std_mode == "centered" else F.lit(0.0))
    out = {
        "user_historical_pnl_before": own["_s"],
        "user_historical_winrate_before": S.share(own["_won"], own["_won"] + own["_lost"]),
        "user_recent_pnl_last20": F.coalesce(F.col("_last"), total(tail)),
        "user_pnl_std_before": F.when(n >= 2, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(F.lit(0.0)),
    }
    return both.withColumns(out).drop("_k", "_ph", "_ku", "_after", "_end", "pnl", "_r20", "_c", *sums)


# ---- whales of a batch


def user_in_blocks(rows: DataFrame, width: int, large: int, std_mode: str = "rms") -> DataFrame:
    """user_lifetime() and realised_pnl() where users with over `large` rows are cut into
    time blocks of `width` seconds, so that no task orders all of their rows. All others
    are one block each and carry nothing."""
    whales = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > large).select("user_id", F.lit(True).alias("_whale"))
    block = lambda at: F.when(F.col("_whale"), F.floor(F.col(at) / width)).otherwise(F.lit(0)).cast("long")
    rows = rows.join(whales, "user_id", "left").withColumn("_b", block("timestamp"))
    keys = ["user_id", "_b"]
    whole = rows.where("_whale")
    carried = user_prefix(user_sums(whole, keys))
    events = pnl_events(rows.select("user_id", "pnl_raw", "end_ts", *T.ORDER)).join(whales, "user_id", "left").withColumn("_b", block("_k"))
    known = pnl_prefix(pnl_sums(events.where("_whale"), keys), whole)
    rows = user_after(carry(rows.drop("_whale"), carried, keys, USER_STATE), keys)
    rows, events = carry(rows, known, keys, PNL_STATE), carry(events.drop("_whale"), known, keys, PNL_STATE)
    return pnl_after(rows, events, keys, std_mode).drop("_b")
