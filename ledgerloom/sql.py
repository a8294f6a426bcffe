"""SQL of the registered queries for an engine of another make (DuckDB).

Where there is a choice it is written in another form than the plans: self-joins
for the hour before a trade and for profits known, distinct counts in windows.
"""

from __future__ import annotations

NUMBER = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 20"
PRICE = "(CAST(round(value * 100) AS BIGINT) % 99 + 1) / 100e0"
ISO = "CAST(epoch(CAST({} AS TIMESTAMPTZ)) AS BIGINT)"


def r(x: str) -> str:
    d = f"CAST({x} AS DOUBLE)"
    return f"CASE WHEN abs({d}) >= 1e6 THEN round({d} + 0.0137, 1) ELSE round({d} + 3.7e-8, 6) END + 0.0"


def real(x: str) -> str:
    return f"round(CAST(CAST({x} AS REAL) AS DOUBLE), 4) + 0.0"


def bucket(key: str, n: str | int) -> str:
    return f"(CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % {n})"


def share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0e0 END"


VIEWS = f"""
WITH trades AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 10, '0') AS trade_uid, concat('u', CAST(user_id AS VARCHAR)) AS user_id,
    concat('m', CAST({NUMBER} AS VARCHAR)) AS market_id, CAST(floor(epoch(ts) / 600) * 600 AS BIGINT) AS ts, {PRICE} AS price,
    CASE WHEN event_id % 23 = 0 THEN 0e0 WHEN event_type = 'signup' THEN -value ELSE value END AS size,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE value * ({PRICE}) END AS usdc_size,
    CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS oi,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE round(value, 2) - 40e0 END AS pnl
  FROM events
), x AS (
  SELECT DISTINCT {NUMBER} AS i FROM events UNION ALL SELECT 20
), markets AS (
  SELECT concat('m', CAST(i AS VARCHAR)) AS market_id,
    CASE WHEN i % 7 = 3 THEN NULL ELSE concat('2023-12-', CAST(10 + i AS VARCHAR), 'T00:00:00Z') END AS start_date,
    CASE WHEN i % 4 = 1 THEN NULL ELSE '2024-02-01T02:00:00+02:00' END AS end_date,
    CASE WHEN i % 5 = 0 AND i < 20 THEN CAST(1704067200 + 86400 * (10 + i) AS BIGINT) END AS effective_end_ts
  FROM x WHERE i <> 18
), marks AS (
  SELECT concat('m', CAST(i AS VARCHAR)) AS market_id, CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END AS y FROM x WHERE i < 19
), last_trades AS (
  SELECT market_id, max(ts) AS last_ts FROM trades GROUP BY market_id
), times AS (
  SELECT m.market_id, {ISO.format("start_date")} AS start_ts, coalesce(effective_end_ts, {ISO.format("end_date")}) AS announced,
    coalesce(effective_end_ts, last_ts) AS effective, coalesce(effective_end_ts, last_ts, {ISO.format("end_date")}) AS end_ts
  FROM markets m LEFT JOIN last_trades l ON l.market_id = m.market_id
), v AS (
  SELECT t.*, abs(coalesce(usdc_size, 0)) AS usdc, CASE WHEN oi = 1 THEN price ELSE 1 - price END AS p_yes, start_ts, end_ts, announced,
    ts - lag(ts) OVER (PARTITION BY t.user_id ORDER BY ts, trade_uid) AS user_gap
  FROM trades t LEFT JOIN times m ON m.market_id = t.market_id
  WHERE size IS NOT NULL AND size <> 0 AND price IS NOT NULL AND ts >= 1672531200
), splits AS (
  SELECT market_id, end_ts, CASE WHEN n <= 0.7 THEN 'train' WHEN n <= 0.85 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, CAST(row_number() OVER (ORDER BY end_ts NULLS LAST, market_id) AS DOUBLE) / count(*) OVER () AS n FROM times)
), meta AS (
  SELECT s.market_id, split, CAST(y AS BIGINT) AS y FROM splits s JOIN marks USING (market_id)
), hour_stats AS (
  SELECT a.trade_uid, count(b.trade_uid) AS n, coalesce(sum(b.usdc), 0) AS usdc, sum(abs(b.size)) AS sizes, avg(b.price) AS p, avg(b.price * b.price) AS pp,
    count(DISTINCT b.user_id) AS traders, count(b.trade_uid) FILTER (WHERE b.user_id = a.user_id) AS own_n, coalesce(sum(b.usdc) FILTER (WHERE b.user_id = a.user_id), 0) AS own_usdc
  FROM v a LEFT JOIN v b ON a.market_id = b.market_id AND b.ts >= a.ts - 3600 AND (b.ts < a.ts OR b.ts = a.ts AND b.trade_uid < a.trade_uid)
  GROUP BY a.trade_uid
), placed AS (
  SELECT user_id, pnl, end_ts, ts, trade_uid, end_ts <= ts AS late, CASE WHEN end_ts <= ts THEN ts ELSE end_ts END AS k, CASE WHEN end_ts <= ts THEN 1 ELSE 0 END AS ph,
    CASE WHEN end_ts <= ts THEN trade_uid ELSE '' END AS ku
  FROM v WHERE end_ts IS NOT NULL AND pnl IS NOT NULL
), known AS (
  SELECT a.trade_uid, coalesce(sum(q.pnl), 0) AS s, coalesce(sum(q.pnl * q.pnl), 0) AS ss, count(q.pnl) AS n, count(q.pnl) FILTER (WHERE q.pnl > 0) AS won,
    count(q.pnl) FILTER (WHERE q.pnl < 0) AS lost,
    coalesce(list_sum(list_slice(list(q.pnl ORDER BY q.k DESC, q.ph DESC, q.ku DESC, q.end_ts DESC, q.ts DESC, q.trade_uid DESC) FILTER (WHERE q.pnl IS NOT NULL), 1, 20)), 0) AS recent
  FROM v a LEFT JOIN placed q ON q.user_id = a.user_id AND CASE WHEN q.late THEN q.ts < a.ts OR q.ts = a.ts AND q.trade_uid < a.trade_uid ELSE q.end_ts <= a.ts END
  GROUP BY a.trade_uid
), f AS (
  SELECT v.trade_uid, v.user_id, v.market_id, ts AS timestamp,
    CASE WHEN pnl IS NULL THEN 0e0 ELSE pnl / size END AS edge, price, v.p_yes,
    ln(1 + coalesce(abs(usdc_size), 0)) AS log_usdc_size, oi AS outcome_index, coalesce(greatest(ts - start_ts, 0), 0) AS seconds_since_market_open,
    sin(2 * pi() * (ts % 86400) / 86400) AS time_of_day_sin, cos(2 * pi() * (ts % 86400) / 86400) AS time_of_day_cos,
    ts - min(ts) OVER u AS user_time_since_first_trade, ts - min(ts) OVER m AS market_time_since_first_trade,
    count(*) OVER ub AS user_total_trades_before, coalesce(sum(v.usdc) OVER ub, 0) AS user_total_volume_before,
    greatest(count(DISTINCT ts // 86400) OVER ub, 1) AS user_days_active_before,
    coalesce(avg(abs(size)) OVER ub, 0) AS user_avg_size_before, coalesce(stddev_pop(abs(size)) OVER ub, 0) AS user_std_size_before,
    known.s AS user_historical_pnl_before, {share("CAST(known.won AS DOUBLE)", "(known.won + known.lost)")} AS user_historical_winrate_before, known.recent AS user_recent_pnl_last20,
    CASE WHEN count(user_gap) OVER u20 >= 2 THEN var_pop(user_gap) OVER u20 ELSE 0 END AS user_activity_burstiness,
    CASE WHEN known.n >= 2 THEN sqrt(known.ss / known.n) ELSE 0 END AS user_pnl_std_before, coalesce(user_gap, -1) AS time_since_user_last_trade,
    count(*) OVER mb AS market_total_trades_before, coalesce(sum(v.usdc) OVER mb, 0) AS market_total_volume_before,
    h.usdc AS market_volume_last_1h, h.traders AS num_unique_traders_last_1h, CASE WHEN h.n >= 2 THEN sqrt(greatest(h.pp - h.p * h.p, 0)) ELSE 0 END AS market_volatility_1h,
    {share("h.sizes", "h.n")} AS mean_trade_size_1h, {share("abs(size)", "(h.sizes / h.n)")} AS size_ratio_market,
    last_value(CASE WHEN oi = 1 THEN price END IGNORE NULLS) OVER mb AS yes, last_value(CASE WHEN oi <> 1 THEN price END IGNORE NULLS) OVER mb AS no,
    coalesce(ts - lag(ts) OVER m, -1) AS dt_trade,
    h.own_usdc AS user_usdc_last_1h_in_market, h.own_n AS user_trades_last_1h_in_market, {share("h.own_usdc", "h.usdc")} AS user_share_of_volume_1h_in_market,
    coalesce(sum(v.usdc) OVER pb, 0) AS user_total_usdc_in_market, count(*) OVER pb AS user_trade_count_in_market,
    coalesce(greatest(ts - lag(ts) OVER p, CASE WHEN lag(ts) OVER p IS NOT NULL THEN 1 END), -1) AS time_since_user_last_trade_in_market
  FROM v JOIN hour_stats h ON h.trade_uid = v.trade_uid JOIN known ON known.trade_uid = v.trade_uid
  WINDOW u AS (PARTITION BY v.user_id ORDER BY ts, v.trade_uid), m AS (PARTITION BY v.market_id ORDER BY ts, v.trade_uid), p AS (PARTITION BY v.market_id, v.user_id ORDER BY ts, v.trade_uid),
    ub AS (PARTITION BY v.user_id ORDER BY ts, v.trade_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    u20 AS (PARTITION BY v.user_id ORDER BY ts, v.trade_uid ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
    mb AS (PARTITION BY v.market_id ORDER BY ts, v.trade_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    pb AS (PARTITION BY v.market_id, v.user_id ORDER BY ts, v.trade_uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, coalesce(yes, 0) AS last_price_yes, coalesce(no, 0) AS last_price_no, coalesce(yes, p_yes) AS mid_price, p_yes - coalesce(yes, p_yes) AS dp_yes,
    p_yes - coalesce(yes, p_yes) AS price_deviation, p_yes - coalesce(yes, p_yes) AS signed_price_deviation, dt_trade AS time_since_last_market_trade,
    {share("user_total_usdc_in_market", "market_total_volume_before")} AS user_share_of_volume_in_market
  FROM f
)"""

#: Ends as announced, which is all that a stream can know.
ANNOUNCED = VIEWS.replace(f"coalesce(effective_end_ts, last_ts, {ISO.format('end_date')}) AS end_ts", f"coalesce(effective_end_ts, {ISO.format('end_date')}) AS end_ts")

#: The whole numbers among the feature columns; the rest are doubles.
LONGS = (
    "timestamp",
    "dt_trade",
    "outcome_index",
    "seconds_since_market_open",
    "user_time_since_first_trade",
    "market_time_since_first_trade",
    "user_total_trades_before",
    "user_days_active_before",
    "time_since_user_last_trade",
    "market_total_trades_before",
    "num_unique_traders_last_1h",
    "time_since_last_market_trade",
    "user_trades_last_1h_in_market",
    "user_trade_count_in_market",
    "time_since_user_last_trade_in_market",
)


def column(c: str) -> str:
    if c in ("trade_uid", "user_id", "market_id"):
        return c
    return f"CAST({c} AS BIGINT) AS {c}" if c in LONGS else f"{r(c)} AS {c}"


def features(*columns: str, views: str = VIEWS) -> str:
    return views + " SELECT " + ", ".join(map(column, columns)) + " FROM g"


SHARDS = "CASE split WHEN 'train' THEN 256 ELSE 64 END"
TOKENS = f"""{VIEWS}, tokens AS (
  SELECT g.market_id, timestamp, {real("p_yes")} AS p_yes, {real("price")} AS price, CAST(outcome_index AS BIGINT) AS outcome_index,
    {real("greatest(least(dp_yes, 0.2), -0.2)")} AS dp_yes_clip, {real("ln(1 + greatest(dt_trade, 0))")} AS log_dt, {real("log_usdc_size")} AS log_usdc_size,
    {bucket("user_id", 2_000_000)} AS user_hash, {real("asinh(user_recent_pnl_last20 / 50)")} AS user_recent_pnl_asinh,
    {real("ln(1 + greatest(user_avg_size_before, 0))")} AS user_avg_size_log, {real("ln(1 + greatest(user_days_active_before, 0))")} AS user_days_active_log,
    {real("asinh(user_historical_pnl_before / 50)")} AS user_hist_pnl_asinh, {real("greatest(least(user_historical_winrate_before, 1), 0)")} AS user_hist_winrate,
    {real("ln(1 + greatest(user_pnl_std_before, 0))")} AS user_pnl_std_log, y, split, {bucket("g.market_id", SHARDS)} AS shard, trade_uid
  FROM g JOIN meta ON meta.market_id = g.market_id
), market_index AS (
  SELECT split, shard, market_id, count(*) AS length, min(timestamp) AS min_ts, max(timestamp) AS max_ts, max(y) AS y FROM tokens GROUP BY ALL
), user_tokens AS (
  SELECT user_id, timestamp, g.market_id, {real("price")} AS price, {real("p_yes")} AS p_yes, CAST(outcome_index AS BIGINT) AS outcome_index, y, max_ts AS market_resolve_time,
    coalesce(timestamp - lag(timestamp) OVER (PARTITION BY split, user_id ORDER BY timestamp, trade_uid), 0) AS dt_user, split, {bucket("user_id", SHARDS)} AS shard, trade_uid
  FROM g JOIN market_index i ON i.market_id = g.market_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY split, market_id ORDER BY timestamp DESC, trade_uid DESC) AS back, count(*) OVER (PARTITION BY split, market_id) AS n FROM tokens
)"""
INDEX = "CAST(sum(length) OVER (PARTITION BY split, shard ORDER BY {0}) - length AS BIGINT) AS start"
HISTORY = f"""{VIEWS}, history AS (
  SELECT {bucket("user_id", 2_000_000)} AS user_hash, timestamp, g.market_id, {real("price")} AS price, {real("log_usdc_size")} AS log_usdc_size, y AS outcome, {real("edge")} AS edge, trade_uid
  FROM g JOIN meta ON meta.market_id = g.market_id
)"""
SCORED = f"""{VIEWS}, scored AS (
  SELECT trade_uid, split, 4 * (price - 0.5) + 0.1e0 * (CAST(trade_uid AS BIGINT) % 7) AS logit, y, price, CASE WHEN pnl IS NOT NULL THEN pnl / size END AS edge, oi,
    ln(1 + coalesce(abs(usdc_size), 0)) AS log_usdc_size
  FROM v JOIN meta ON meta.market_id = v.market_id
), e AS (
  SELECT *, 1 / (1 + exp(-logit)) AS prob, 1 / (1 + exp(-logit)) - price AS pred, coalesce(edge, CASE WHEN oi = 1 THEN y ELSE 1 - y END - price) AS true_edge FROM scored
)"""
CORE = f"""{r("avg(CASE WHEN (prob > 0.5) <> (y > 0.5) THEN 1e0 ELSE 0e0 END)")} AS misclass, count(*) AS n_samples,
  {r("avg(-(y * ln(prob) + (1 - y) * ln(1 - prob)))")} AS bce, count(*) AS bce_n_samples, 1e0 AS bce_coverage, {r("avg(abs(pred - true_edge))")} AS mae_edge, 1e0 AS mae_edge_coverage,
  {r("avg(CASE WHEN (price > 0.5) <> (y > 0.5) THEN 1e0 ELSE 0e0 END)")} AS baseline_misclass, {r("coalesce(sum(true_edge) FILTER (WHERE pred > 0), 0)")} AS pnl,
  {r("coalesce(avg(true_edge) FILTER (WHERE pred > 0), 0)")} AS pnl_norm, {r("count(*) FILTER (WHERE pred > 0) / CAST(count(*) AS DOUBLE)")} AS take_rate,
  {r("coalesce(avg(CASE WHEN true_edge > 0 THEN 1e0 ELSE 0e0 END) FILTER (WHERE pred > 0), 0)")} AS hit_rate, count(*) FILTER (WHERE pred > 0) AS n_take"""
RANKS = """SELECT {0} (sum(rk) FILTER (WHERE y = 1) - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) AS auc, n_pos, n_neg
  FROM (SELECT *, rank() OVER ({1} ORDER BY logit) + (count(*) OVER (PARTITION BY {2} logit) - 1) / 2e0 AS rk,
    count(*) FILTER (WHERE y = 1) OVER ({1}) AS n_pos, count(*) FILTER (WHERE y = 0) OVER ({1}) AS n_neg FROM scored) GROUP BY {0} n_pos, n_neg"""
PROFIT = f"""SELECT {{0}} CAST(tau AS DOUBLE) AS tau, {r("coalesce(sum((y - price) * w) FILTER (WHERE pred > tau), 0)")} AS pnl, {r("coalesce(sum(price * w) FILTER (WHERE pred > tau), 0)")} AS cost,
  {r("coalesce(sum((y - price) * w) FILTER (WHERE pred > tau) / sum(price * w) FILTER (WHERE pred > tau), 0)")} AS roi,
  {r("coalesce(avg(CASE WHEN y > 0.5 THEN 1e0 ELSE 0e0 END) FILTER (WHERE pred > tau), 0)")} AS hit_rate, {r("count(*) FILTER (WHERE pred > tau) / CAST(count(*) AS DOUBLE)")} AS take_rate,
  {r("coalesce(avg(w * (y - price)) FILTER (WHERE pred > tau), 0)")} AS avg_pnl, count(*) FILTER (WHERE pred > tau) AS n_take
  FROM (SELECT *, {{1}} AS w FROM e), (SELECT unnest([{{2}}]) AS tau) GROUP BY {{0}} tau"""
TAUS = "0.0, 0.05, 0.1, 0.2"


def _feature_names() -> tuple[str, ...]:
    from ledgerloom.plans.feature_table import COLUMNS

    return COLUMNS


def _stats() -> str:
    from ledgerloom.operators.scaling import scaled_columns

    one = "SELECT '{0}' AS \"column\", {1} AS mean, CASE WHEN stddev_pop(CAST({0} AS DOUBLE)) > 0 THEN {2} ELSE 1e0 END AS std, count({0}) AS count FROM t"
    rows = [one.format(c, r(f"avg(CAST({c} AS DOUBLE))"), r(f"stddev_pop(CAST({c} AS DOUBLE))")) for c in scaled_columns([*_feature_names(), "label_y"])]
    return VIEWS + ", t AS (SELECT g.* FROM g JOIN meta ON meta.market_id = g.market_id WHERE split = 'train') " + " UNION ALL ".join(rows)


#: The dual sample's market side by place, as models read it.
DUAL_WINDOW = ("price", "p_yes", "outcome_index", "dp_yes_clip", "log_dt", "log_usdc_size", "user_recent_pnl_asinh", "user_avg_size_log", "user_days_active_log", "user_hist_pnl_asinh", "user_hist_winrate", "user_pnl_std_log")
DUAL = f"""{TOKENS}, target AS (SELECT r.split, r.market_id, r.timestamp AS tts, u.user_id FROM ranked r JOIN user_tokens u USING (trade_uid) WHERE back = 1 AND n >= 10),
  past AS (SELECT a.split, a.market_id, a.tts, u.*EXCLUDE (split, market_id), row_number() OVER (PARTITION BY a.split, a.market_id ORDER BY u.timestamp DESC, u.trade_uid DESC) AS back
    FROM target a JOIN user_tokens u ON u.split = a.split AND u.user_id = a.user_id AND u.timestamp < a.tts),
  user_side AS (SELECT t.split, t.market_id, s.slot, h.back IS NOT NULL AS mask, h.price, h.p_yes, h.outcome_index,
      CASE WHEN h.timestamp >= h.market_resolve_time THEN CAST(h.y AS DOUBLE) ELSE 0.5e0 END AS y, CASE WHEN h.market_resolve_time <= h.tts THEN CAST(h.y AS DOUBLE) ELSE 0.5e0 END AS y_asof
    FROM target t CROSS JOIN (SELECT CAST(unnest(range(16)) AS BIGINT) AS slot) s LEFT JOIN past h ON h.split = t.split AND h.market_id = t.market_id AND h.back = 16 - s.slot),
  market_side AS (SELECT t.split, t.market_id, s.slot, r.back IS NOT NULL AS mask, coalesce(CAST(r.y AS DOUBLE), 0.5e0) AS y, r.* EXCLUDE (split, market_id, y)
    FROM target t CROSS JOIN (SELECT CAST(unnest(range(32)) AS BIGINT) AS slot) s LEFT JOIN ranked r ON r.split = t.split AND r.market_id = t.market_id AND r.back = 32 - s.slot)"""

PATHS = f"""{VIEWS}, made AS (
  SELECT trade_uid, concat(['C:\\work\\LedgerLoom/data\\', 'ledgerloom/data/', 'E:/my-LEDGERLOOM\\d/', '/x/ledgerloom/a/ledgerloom/b/', 'data\\only/'][CAST(trade_uid AS BIGINT) % 5 + 1], market_id, '/part_', trade_uid) AS old FROM trades
), cut AS (SELECT *, replace(old, chr(92), '/') AS p, position('ledgerloom/' IN lower(replace(old, chr(92), '/'))) AS place FROM made),
fixed AS (SELECT *, CASE WHEN place > 0 THEN substr(p, place + 11) ELSE p END AS new FROM cut)"""
#: The market window's columns by place, as models read them.
WINDOW_COLUMNS = ("p_yes", "dp_yes_clip", "log_dt", "log_usdc_size", "user_recent_pnl_asinh", "user_avg_size_log", "user_days_active_log", "user_hist_pnl_asinh", "user_hist_winrate", "user_pnl_std_log")
PNL_COLUMNS = ("trade_uid", "user_historical_pnl_before", "user_historical_winrate_before", "user_recent_pnl_last20", "user_pnl_std_before")


def _vectors() -> str:
    """Standardised features by place, as real numbers."""
    from ledgerloom.operators.scaling import scaled_columns

    names = scaled_columns(_feature_names())
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m{i}, stddev_pop(CAST({c} AS DOUBLE)) AS d{i}" for i, c in enumerate(names))
    values = ", ".join(f"(CAST({c} AS DOUBLE) - m{i}) / CASE WHEN d{i} > 0 THEN d{i} ELSE 1 END" for i, c in enumerate(names))
    return f"""{VIEWS}, t AS (SELECT g.*, split FROM g LEFT JOIN meta ON meta.market_id = g.market_id), s AS (SELECT {stats} FROM t WHERE split = 'train'),
      l AS (SELECT trade_uid, unnest([{values}]) AS value, CAST(unnest(range({len(names)})) AS BIGINT) AS slot FROM t, s)
      SELECT trade_uid, slot, {real("value")} AS value FROM l"""


def _shuffled(seed: int, epoch: int, size: int, rounds: int = 24) -> str:
    """The shuffle of numbered rows, a step for each round. The keys are those of the
    plan's rounds; the number of rows is the table's own, so they are taken modulo it here."""
    import hashlib

    steps, prime = [], 2_147_483_647
    for k in range(rounds):
        h = hashlib.sha256(f"{seed}:{epoch}:{k}".encode()).digest()
        x = [int.from_bytes(h[i : i + 8], "big") for i in (0, 8, 16, 24)]
        a, b, c = (1 + y % (prime - 1) for y in x[1:])
        mirror = f"(CAST(CAST({x[0]} AS UBIGINT) % CAST(n AS UBIGINT) AS BIGINT) - x + n) % n"
        coin = f"((m % {prime}) * {a} + (m // {prime}) * {b} + {c}) % {prime} % 2"
        steps.append(f"a{k} AS (SELECT *, {mirror} AS w FROM s{k}), b{k} AS (SELECT *, greatest(x, w) AS m FROM a{k}), s{k + 1} AS (SELECT trade_uid, price, row, n, CASE WHEN {coin} = 1 THEN w ELSE x END AS x FROM b{k})")
    first = "s0 AS (SELECT trade_uid, price, row_number() OVER (ORDER BY trade_uid) - 1 AS row, count(*) OVER () AS n, row_number() OVER (ORDER BY trade_uid) - 1 AS x FROM v)"
    return f"{VIEWS}, {first}, {', '.join(steps)} SELECT trade_uid, {r('price')} AS price, row, x // {size} AS batch_id, x % {size} AS slot FROM s{rounds}"

ORACLE_SQL: dict[str, str] = {
    "trades_valid": f"{VIEWS} SELECT trade_uid, market_id AS condition_id, ts AS timestamp, {r('price')} AS price, {r('size')} AS size FROM v",
    "trades_resume_after": f"{VIEWS} SELECT trade_uid, ts AS timestamp FROM trades WHERE ts >= 1672531200 AND (ts, trade_uid) > (1705000000, '0000000500')",
    "market_effective_end": f"{VIEWS} SELECT market_id AS condition_id, effective AS effective_end_ts FROM times",
    "iso_times": f"{VIEWS} SELECT market_id, start_ts, announced AS end_ts FROM times",
    "trade_local_features": features("trade_uid", "edge", "log_usdc_size", "p_yes", "seconds_since_market_open", "time_of_day_sin", "time_of_day_cos"),
    "user_lifetime": features("trade_uid", "user_total_trades_before", "user_total_volume_before", "user_days_active_before", "user_time_since_first_trade"),
    "user_size_stats": features("trade_uid", "user_avg_size_before", "user_std_size_before"),
    "user_burstiness": features("trade_uid", "user_activity_burstiness", "time_since_user_last_trade"),
    "user_realized_pnl": features("trade_uid", "user_historical_pnl_before", "user_historical_winrate_before", "user_recent_pnl_last20", "user_pnl_std_before"),
    "market_lifetime": features("trade_uid", "market_total_trades_before", "market_total_volume_before", "market_time_since_first_trade", "dt_trade"),
    "market_price_moves": features("trade_uid", "last_price_yes", "last_price_no", "mid_price", "dp_yes"),
    "market_hour_stats": features("trade_uid", "market_volume_last_1h", "mean_trade_size_1h", "market_volatility_1h", "size_ratio_market"),
    "market_hour_sweep": features("trade_uid", "market_volume_last_1h", "mean_trade_size_1h", "market_volatility_1h", "size_ratio_market"),
    "market_hour_traders": features("trade_uid", "num_unique_traders_last_1h"),
    "pair_hour": features("trade_uid", "user_usdc_last_1h_in_market", "user_trades_last_1h_in_market", "user_share_of_volume_1h_in_market"),
    "pair_lifetime": features("trade_uid", "user_total_usdc_in_market", "user_trade_count_in_market", "user_share_of_volume_in_market", "time_since_user_last_trade_in_market"),
    "feature_table": features(*_feature_names()),
    "feature_table_blocks": features(*_feature_names()),
    "feature_table_whales": features(*_feature_names()),
    "stream_feature_table": features(*_feature_names(), views=ANNOUNCED),
    "stream_after_batch": features(*_feature_names(), views=ANNOUNCED),
    "stream_unordered": features(*_feature_names(), views=ANNOUNCED),
    "stream_realized_pnl": features(*PNL_COLUMNS, views=ANNOUNCED),
    "norm_stats_merged": _stats(),
    "scaler_file": _stats(),
    "feature_vectors": _vectors(),
    "model_report": f"""{SCORED.replace("4 * (price - 0.5) + 0.1e0 * (CAST(trade_uid AS BIGINT) % 7) AS logit", "4 * (price - 0.5) + 0.01e0 * ln(1 + coalesce(abs(usdc_size), 0)) AS logit")},
      a AS ({RANKS.format('split,', 'PARTITION BY split', 'split,')}) SELECT e.split, {CORE}, {r('any_value(a.auc)')} AS auc, any_value(a.n_pos) AS n_pos, any_value(a.n_neg) AS n_neg, 'price_rule' AS model
      FROM e JOIN a ON a.split = e.split GROUP BY e.split""",
    "market_store": f"{TOKENS} SELECT split, shard, market_id, trade_uid, row_number() OVER (PARTITION BY split, shard ORDER BY market_id, timestamp, trade_uid) - 1 AS row FROM tokens",
    "user_store": f"{TOKENS} SELECT split, shard, user_id, trade_uid, row_number() OVER (PARTITION BY split, shard ORDER BY user_id, timestamp, trade_uid) - 1 AS row FROM user_tokens",
    "flat_store": f"{HISTORY} SELECT * FROM history",
    "split_store": f"{VIEWS} SELECT v.market_id, trade_uid, split, CAST(y AS DOUBLE) AS label_y, y AS meta_y, split AS meta_split FROM v JOIN meta ON meta.market_id = v.market_id",
    "feature_files": f"{VIEWS} SELECT trade_uid, {r('price')} AS price, true AS fits FROM v",
    "split_export": f"{VIEWS} SELECT s.market_id, effective AS effective_end_ts, split FROM splits s JOIN times USING (market_id)",
    "report_file": f"{SCORED} SELECT {CORE}, 'price_rule' AS model, '1' AS run FROM e",
    "binary_labels": f"{VIEWS} SELECT trade_uid, coalesce(y, 0) AS y FROM v LEFT JOIN meta ON meta.market_id = v.market_id",
    "epoch_batches": _shuffled(7, 3, 512),
    "market_ranges": f"""{TOKENS}, longest AS (SELECT market_id FROM market_index ORDER BY length DESC, market_id LIMIT 3)
      SELECT market_id, split, shard, row_number() OVER (PARTITION BY split, market_id ORDER BY timestamp, trade_uid) - 1 AS place, timestamp, trade_uid, price, y FROM tokens SEMI JOIN longest USING (market_id)""",
    "temporal_split": f"{VIEWS} SELECT market_id, end_ts, split FROM splits",
    "market_meta": f"{VIEWS} SELECT market_id, split, y FROM meta",
    "split_features": f"{VIEWS} SELECT trade_uid, v.market_id, split, CAST(y AS DOUBLE) AS label_y FROM v LEFT JOIN meta ON meta.market_id = v.market_id",
    "unknown_markets": f"{VIEWS} SELECT DISTINCT market_id FROM v WHERE market_id NOT IN (SELECT market_id FROM meta)",
    "split_counts": f"{VIEWS} SELECT split, count(*) AS n_rows FROM v JOIN meta ON meta.market_id = v.market_id GROUP BY ROLLUP (split)",
    "norm_stats": _stats(),
    "standardized": f"""{VIEWS}, j AS (SELECT g.*, split FROM g LEFT JOIN meta ON meta.market_id = g.market_id), s AS (
      SELECT avg(dt_trade) AS am, stddev_pop(dt_trade) AS asd, avg(user_total_volume_before) AS bm, stddev_pop(user_total_volume_before) AS bsd,
        avg(market_volatility_1h) AS cm, stddev_pop(market_volatility_1h) AS csd FROM j WHERE split = 'train')
      SELECT trade_uid, split, {r('(dt_trade - am) / CASE WHEN asd > 0 THEN asd ELSE 1 END')} AS dt_trade, {r('(user_total_volume_before - bm) / CASE WHEN bsd > 0 THEN bsd ELSE 1 END')} AS user_total_volume_before,
        {r('(market_volatility_1h - cm) / CASE WHEN csd > 0 THEN csd ELSE 1 END')} AS market_volatility_1h, {r('price')} AS price FROM j, s""",
    "market_tokens": f"{TOKENS} SELECT * FROM tokens",
    "market_index": f"{TOKENS} SELECT *, {INDEX.format('market_id')} FROM market_index",
    "user_tokens": f"{TOKENS} SELECT * FROM user_tokens",
    "user_index": f"""{TOKENS} SELECT *, {INDEX.format('user_id')} FROM (
      SELECT split, shard, user_id, count(*) AS length, min(timestamp) AS min_ts, max(timestamp) AS max_ts FROM user_tokens GROUP BY ALL)""",
    "user_history_flat": f"{HISTORY} SELECT * FROM history",
    "user_flat_index": f"{HISTORY} SELECT user_hash, CAST(sum(count(*)) OVER (ORDER BY user_hash) - count(*) AS BIGINT) AS start_row, count(*) AS num_trades FROM history GROUP BY user_hash",
    "market_windows": f"""{TOKENS}, long AS (SELECT split, market_id, max(y) AS y FROM ranked WHERE n >= 10 GROUP BY ALL)
      SELECT l.split, l.market_id, s.slot, t.back IS NOT NULL AS mask, coalesce(CAST(t.y AS DOUBLE), 0.5) AS y, {', '.join(f'coalesce(t.{c}, 0) AS {c}' for c in WINDOW_COLUMNS)}
      FROM long l CROSS JOIN (SELECT CAST(unnest(range(32)) AS BIGINT) AS slot) s LEFT JOIN ranked t ON t.split = l.split AND t.market_id = l.market_id AND t.back = 32 - s.slot""",
    "dual_samples": f"""{DUAL} SELECT split, market_id, 'market' AS side, slot, mask, y, {', '.join(f'coalesce({c}, 0) AS x{i}' for i, c in enumerate(DUAL_WINDOW))} FROM market_side
      UNION ALL SELECT split, market_id, 'user', slot, mask, y, coalesce(price, 0), coalesce(p_yes, 0), coalesce(outcome_index, 0), y, {', '.join(['NULL'] * 8)} FROM user_side""",
    "dual_samples_asof": f"""{DUAL} SELECT split, market_id, slot, mask, y_asof AS y, coalesce(price, 0) AS x0, coalesce(p_yes, 0) AS x1, CAST(coalesce(outcome_index, 0) AS DOUBLE) AS x2, y_asof AS x3 FROM user_side""",
    "market_cutoffs": f"""{TOKENS}, long AS (SELECT split, market_id, count(*) AS n FROM tokens GROUP BY ALL HAVING count(*) >= 10)
      SELECT split, market_id, n, 9 + {bucket("concat(market_id, ':3')", "(n - 9)")} AS cut FROM long""",
    "target_tokens": f"{TOKENS} SELECT split, market_id, CAST(y AS DOUBLE) AS y, price, outcome_index FROM ranked WHERE back = 1 AND n >= 10",
    "baseline_metrics": f"{SCORED} SELECT {CORE} FROM e",
    "metrics_by_split": f"{SCORED}, a AS ({RANKS.format('split,', 'PARTITION BY split', 'split,')}) SELECT e.split, {CORE}, {r('any_value(a.auc)')} AS auc FROM e JOIN a ON a.split = e.split GROUP BY e.split",
    "auc": f"{SCORED}, a AS ({RANKS.format('', '', '')}) SELECT {r('auc')} AS auc, n_pos, n_neg FROM a",
    "profit_threshold": f"{SCORED} {PROFIT.format('', 'greatest(exp(log_usdc_size) - 1, 0)', '0.1')}",
    "profit_sweep": f"{SCORED} {PROFIT.format('split,', '1e0', TAUS)}",
    "confidence_metrics": f"""{SCORED} SELECT CAST(tau AS DOUBLE) AS tau, {r("count(*) FILTER (WHERE abs(prob - 0.5) > tau) / CAST(count(*) AS DOUBLE)")} AS take_rate,
      {r("coalesce(avg(CASE WHEN prob > 0.5 THEN y ELSE 1 - y END) FILTER (WHERE abs(prob - 0.5) > tau), 0)")} AS hit_rate,
      {r("coalesce(sum(CASE WHEN prob > 0.5 THEN y - price ELSE price - y END) FILTER (WHERE abs(prob - 0.5) > tau), 0)")} AS pnl,
      count(*) FILTER (WHERE prob > 0.5 + tau) AS n_yes, count(*) FILTER (WHERE prob < 0.5 - tau) AS n_no FROM e, (SELECT unnest([{TAUS}]) AS tau) GROUP BY tau""",
    "confidence_signals": f"{SCORED} SELECT trade_uid, CASE WHEN prob > 0.6 THEN 'YES' WHEN prob < 0.4 THEN 'NO' ELSE 'NONE' END AS signal, {r('-(y * ln(prob) + (1 - y) * ln(1 - prob))')} AS loss FROM e",
    "first_batch": f"{SCORED} SELECT trade_uid, {r('price')} AS price FROM scored ORDER BY md5(concat('0:', trade_uid)), trade_uid LIMIT 100",
    "path_normalize": f"{PATHS} SELECT trade_uid, new AS path FROM fixed",
    "path_report": f"{PATHS} SELECT count(*) AS n_rows, count(DISTINCT old) AS n_paths, count(DISTINCT new) AS n_new_paths, count(*) FILTER (WHERE old <> new) AS n_changed, count(*) FILTER (WHERE place = 0) AS n_without_marker FROM fixed",
    "hash_buckets": f"{VIEWS} SELECT DISTINCT user_id AS proxy_wallet, {bucket('user_id', 2_000_000)} AS user_hash, {bucket('market_id', 256)} AS shard FROM trades",
    "stream_features": f"""{VIEWS}, due AS (
        SELECT a.trade_uid, coalesce(sum(q.pnl), 0) AS s, count(q.pnl) FILTER (WHERE q.pnl > 0) AS won, count(q.pnl) FILTER (WHERE q.pnl < 0) AS lost
        FROM v a LEFT JOIN v q ON q.user_id = a.user_id AND q.pnl IS NOT NULL AND q.announced <= a.ts AND (q.ts < a.ts OR q.ts = a.ts AND q.trade_uid < a.trade_uid) GROUP BY a.trade_uid)
      SELECT g.trade_uid, user_total_trades_before, {r('user_total_volume_before')} AS user_total_volume_before, time_since_user_last_trade, {r('s')} AS user_historical_pnl_before,
        {r(share('CAST(won AS DOUBLE)', '(won + lost)'))} AS user_historical_winrate_before, market_total_trades_before, {r('market_total_volume_before')} AS market_total_volume_before,
        time_since_last_market_trade, {r('last_price_yes')} AS last_price_yes, {r('last_price_no')} AS last_price_no, {r('market_volume_last_1h')} AS market_volume_last_1h
      FROM g JOIN due ON due.trade_uid = g.trade_uid""",
    "hour_sliding": f"{VIEWS} SELECT market_id, ts - 600 * k AS window_start, count(*) AS n_trades, {r('sum(usdc)')} AS volume FROM v, (SELECT CAST(unnest(range(6)) AS BIGINT) AS k) GROUP BY 1, 2",
    "user_sessions": f"""{VIEWS}, o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= 3600 THEN 0 ELSE 1 END AS fresh FROM v WINDOW w AS (PARTITION BY market_id, user_id ORDER BY ts, trade_uid)),
      n AS (SELECT *, sum(fresh) OVER (PARTITION BY market_id, user_id ORDER BY ts, trade_uid) AS stay FROM o)
      SELECT market_id, user_id, count(*) AS n_trades, min(ts) AS first_ts, max(ts) AS last_ts FROM n GROUP BY market_id, user_id, stay""",
}
