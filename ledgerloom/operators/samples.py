"""Padded, masked sequence samples of markets, with the as-of history of a user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S

#: The token columns of a market window and of the dual sample's two
#: sides. Models read them by their place, so the order counts.
MARKET_COLUMNS = ["p_yes", "dp_yes_clip", "log_dt", "log_usdc_size", "user_recent_pnl_asinh", "user_avg_size_log", "user_days_active_log", "user_hist_pnl_asinh", "user_hist_winrate", "user_pnl_std_log"]
DUAL_COLUMNS = ["price", "p_yes", "outcome_index", "dp_yes_clip", "log_dt", "log_usdc_size", "user_recent_pnl_asinh", "user_avg_size_log", "user_days_active_log", "user_hist_pnl_asinh", "user_hist_winrate", "user_pnl_std_log"]
USER_COLUMNS = ["price", "p_yes", "outcome_index"]
UNKNOWN = 0.5


def numbered(tokens: DataFrame, key: str = "market_id", block: int = 86_400) -> DataFrame:
    """Tokens with their place from 0 and the number of tokens of their key: places within
    time blocks of `block` seconds, and one row a block for what comes before it, so that
    no task orders all tokens of a large key. Tokens without a split or key are left out."""
    keys, place = ["split", key], F.floor(F.col("timestamp") / block)
    rows = tokens.withColumn("_b", place)
    w, whole = Window.partitionBy(*keys, "_b").orderBy("timestamp", "trade_uid"), Window.partitionBy(*keys)
    sums = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.select(*keys, "_b", (F.sum("_n").over(whole.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("n"))
    rows = rows.withColumn("_in", F.row_number().over(w) - 1).join(sums, [*keys, "_b"])
    return rows.select(*tokens.columns, (F.col("_in") + F.col("_before")).alias("pos"), "n")


def cutoff(n: Column, key: Column, min_prefix: int, mode: str, epoch: int) -> Column:
    """The last place of a sample: the key's last token ("last"), or uniform from
    min_prefix - 1 on by a hash of key and epoch ("hash"), one that any engine can
    compute."""
    last = n - 1
    if mode == "last":
        return last
    low = F.least(F.lit(min_prefix - 1).cast("long"), last)
    return low + S.bucket(F.concat(key, F.lit(f":{epoch}")), last - low + 1)


def _padded(seq: Column, zero: Column, length: int) -> Column:
    return F.concat(F.array_repeat(zero, F.lit(length) - F.size(seq)), seq)


def _window(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    values = F.array(*[F.col(c).cast("float") for c in columns])
    tokens = F.array_sort(F.collect_list(F.struct("pos", values.alias("v"), F.col("y").cast("float").alias("y"), "timestamp", "trade_uid")))
    return rows.groupBy(*keys).agg(tokens.alias("tokens"))


def market_windows(tokens: DataFrame, length: int, columns: Sequence[str] = MARKET_COLUMNS, min_length: int = 10, min_prefix: int = 10, mode: str = "last", epoch: int = 0) -> DataFrame:
    """A sample for each market with min_length tokens: the last `length` tokens up to
    its cutoff, zeros before them, a mask, and the label. A group holds no more than
    `length` rows, as those outside the window are filtered before."""
    rows = numbered(tokens).where(F.col("n") >= min_length)
    end = cutoff(F.col("n"), F.col("market_id"), min_prefix, mode, epoch)
    rows = rows.withColumn("end", end).where((F.col("pos") <= F.col("end")) & (F.col("pos") > F.col("end") - length))
    out = _window(rows, ["split", "market_id"], columns)
    zero = F.array_repeat(F.lit(0.0).cast("float"), len(columns))
    last = F.element_at("tokens", -1)
    return out.select(
        "split", "market_id",
        _padded(F.transform("tokens", lambda t: t["v"]), zero, length).alias("market_x"),
        _padded(F.transform("tokens", lambda t: F.lit(True)), F.lit(False), length).alias("market_mask"),
        _padded(F.transform("tokens", lambda t: t["y"]), F.lit(UNKNOWN).cast("float"), length).alias("market_y"),
        last["timestamp"].alias("target_ts"), last["trade_uid"].alias("target_uid"),
    )


def last_before(targets: DataFrame, past: DataFrame, keys: Sequence[str], length: int, block: int = 7 * 86_400) -> DataFrame:
    """Each target (keys, target_ts) with the last `length` rows of `past` (keys, uts,
    trade_uid) of its keys strictly before its time, and their _rank (1: the last).

    Past rows and targets stand in one sorted stream, which numbers the past rows of a key
    and tells each target how many came before it; it then joins just the rows of those
    numbers. Numbers are counted within time blocks of `block` seconds, with the earlier
    blocks' sums (a row a block) added, so that no task orders all rows of a large key."""
    cut = lambda c: F.floor(F.col(c) / block)
    mine = past.withColumns({"_at": F.col("uts"), "_b": cut("uts"), "_past": F.lit(1)})
    asked = targets.withColumns({"_at": F.col("target_ts"), "_b": cut("target_ts"), "_past": F.lit(0)})
    sums = mine.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    # Blocks that only targets have are counted too, as empty ones.
    blocks = sums.unionByName(asked.select(*keys, "_b", F.lit(0).cast("long").alias("_n"))).groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(*keys, "_b", earlier.alias("_before"))
    # A target stands before the past rows of its own second.
    w = Window.partitionBy(*keys, "_b").orderBy("_at", "_past", "trade_uid").rowsBetween(Window.unboundedPreceding, 0)
    stream = mine.unionByName(asked.select(*keys, "_b", "_at", "_past").distinct(), allowMissingColumns=True)
    stream = stream.withColumn("_seen", F.sum("_past").over(w)).join(blocks, [*keys, "_b"]).withColumn("_nth", F.col("_seen") + F.col("_before"))
    known = stream.where("_past = 1").select(*past.columns, "_nth")
    upto = stream.where("_past = 0").select(*keys, F.col("_at").alias("target_ts"), F.col("_nth").alias("_upto"))
    want = targets.join(upto, [*keys, "target_ts"]).where("_upto > 0")
    want = want.withColumn("_nth", F.explode(F.sequence(F.greatest(F.col("_upto") - length + 1, F.lit(1)), F.col("_upto"))))
    return want.join(known, [*keys, "_nth"]).withColumn("_rank", F.col("_upto") - F.col("_nth") + 1).drop("_upto", "_nth")


def dual_samples(tokens: DataFrame, user_tokens: DataFrame, market_length: int, user_length: int, mask_mode: str = "own_time", mode: str = "last", epoch: int = 0) -> DataFrame:
    """Market windows with the history of the target trade's user: the last
    user_length tokens of the same split strictly before the target's second.

    A history label is UNKNOWN where the history trade itself came before its market
    resolved ("own_time"), or where the market resolves after the target ("asof").
    The label stands as a fourth column of user_x as well. A user without history
    has zeros, an empty mask and UNKNOWN labels. Rows met grow with targets times
    user_length, not with the users' pasts.
    """
    samples = market_windows(tokens, market_length, DUAL_COLUMNS, mode=mode, epoch=epoch)
    who = user_tokens.select(F.col("trade_uid").alias("target_uid"), "user_id")
    targets = samples.select("split", "market_id", "target_ts", "target_uid").join(who, "target_uid")
    past = user_tokens.select("split", "user_id", *USER_COLUMNS, F.col("timestamp").alias("uts"), "trade_uid", F.col("y").cast("float").alias("uy"), "market_resolve_time")
    met = last_before(targets, past, ["split", "user_id"], user_length)
    hidden = F.col("uts") < F.col("market_resolve_time") if mask_mode == "own_time" else F.col("market_resolve_time") > F.col("target_ts")
    label = F.when(hidden, F.lit(UNKNOWN)).otherwise(F.col("uy")).cast("float")
    values = F.array(*[F.col(c).cast("float") for c in USER_COLUMNS], label)
    seq = F.array_sort(F.collect_list(F.struct((-F.col("_rank")).alias("r"), values.alias("v"), label.alias("y"))))
    history = met.groupBy("split", "market_id").agg(seq.alias("h"))
    none = F.array().cast("array<struct<r:int,v:array<float>,y:float>>")
    out = samples.join(history, ["split", "market_id"], "left").withColumn("h", F.coalesce("h", none))
    zero = F.concat(F.array_repeat(F.lit(0.0).cast("float"), len(USER_COLUMNS)), F.array(F.lit(UNKNOWN).cast("float")))
    return out.select(
        *samples.columns,
        _padded(F.transform("h", lambda t: t["v"]), zero, user_length).alias("user_x"),
        _padded(F.transform("h", lambda t: F.lit(True)), F.lit(False), user_length).alias("user_mask"),
        _padded(F.transform("h", lambda t: t["y"]), F.lit(UNKNOWN).cast("float"), user_length).alias("user_y"),
    )


def last_real(values: str, mask: str) -> Column:
    """The last value whose mask is true; null if none is."""
    kept = F.filter(F.arrays_zip(F.col(values).alias("v"), F.col(mask).alias("m")), lambda x: x["m"])
    return F.get(kept, F.size(kept) - 1)["v"]


def targets(samples: DataFrame) -> DataFrame:
    """Label, price and outcome of each dual sample's target token, labels known only."""
    x = last_real("market_x", "market_mask")
    rows = samples.select("split", "market_id", last_real("market_y", "market_mask").alias("y"), x[0].alias("price"), x[DUAL_COLUMNS.index("outcome_index")].cast("int").alias("outcome_index"))
    return rows.where(F.col("y") != UNKNOWN)
