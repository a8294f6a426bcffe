"""Profits that become known at their market's end, as a stateful operator with timers.

State of a user: totals, the last 20 profits, and the open profits by their market's end.
A timer at each end moves what ended into the totals, so that state leaves when markets
end, whether or not the user trades again. Within a micro-batch trades and the profits
that fall due are taken in the order of their places from a heap: no trade looks through
the open profits. Ends are those announced by the markets table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.operators import carried as C

OUT = "trade_uid string, user_id string, timestamp long, user_historical_pnl_before double, user_historical_winrate_before double, user_recent_pnl_last20 double, user_pnl_std_before double"
TOTALS = "s double, ss double, n long, won long, lost long, tail array<double>"
OPEN = "ts array<long>, uid array<string>, pnl array<double>"
_ROW = Row(*(x.split()[0] for x in OUT.split(", ")))
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Totals:
    def __init__(self, s=0.0, ss=0.0, n=0, won=0, lost=0, tail=()):
        self.s, self.ss, self.n, self.won, self.lost, self.tail = s, ss, n, won, lost, list(tail)

    def add(self, pnl: float) -> None:
        self.s, self.ss, self.n = self.s + pnl, self.ss + pnl * pnl, self.n + 1
        self.won, self.lost = self.won + (pnl > 0), self.lost + (pnl < 0)
        self.tail = [*self.tail[-C.RECENT + 1 :], pnl]

    def row(self) -> tuple:
        return float(self.s), float(self.ss), self.n, self.won, self.lost, [float(x) for x in self.tail]

    def seen(self) -> tuple[float, float, float, float]:
        games = self.won + self.lost
        return float(self.s), self.won / games if games else 0.0, float(sum(self.tail)), (max(self.ss, 0.0) / self.n) ** 0.5 if self.n >= 2 else 0.0


class RealisedProfits(StatefulProcessor):
    """Keyed by user_id; rows have trade_uid, timestamp, end_ts and pnl_raw."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)
        self.open = handle.getMapState("open", "end long", OPEN)

    def _totals(self) -> _Totals:
        return _Totals(*self.totals.get()) if self.totals.exists() else _Totals()

    def _keep(self, end: int, entries: list[tuple[int, str, float]]) -> None:
        """Adds open profits of one end, in the order of their trades."""
        if self.open.containsKey((end,)):
            ts, uid, pnl = self.open.getValue((end,))
            entries = sorted([*zip(ts, uid, pnl, strict=True), *entries])
        else:
            # Fires once no earlier trade can come any more.
            self.handle.registerTimer(end * 1000)
        self.open.updateValue((end,), tuple(list(x) for x in zip(*entries, strict=True)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: (r.timestamp, r.trade_uid))
        totals, due, later = self._totals(), [], {}
        newest = rows[-1].timestamp
        for (end,) in list(self.open.keys()):
            if end <= newest:
                due += [(end, 0, "", end, *x) for x in zip(*self.open.getValue((end,)), strict=True)]
                self.open.removeKey((end,))
                self.handle.deleteTimer(end * 1000)
        heapq.heapify(due)
        for r in rows:
            while due and due[0][:3] < (r.timestamp, 1, r.trade_uid):
                totals.add(heapq.heappop(due)[-1])
            yield _ROW(r.trade_uid, key[0], r.timestamp, *totals.seen())
            if r.end_ts is None or r.pnl_raw is None:
                continue
            end, own = int(r.end_ts), (r.timestamp, r.trade_uid, float(r.pnl_raw))
            if end <= r.timestamp:
                heapq.heappush(due, (r.timestamp, 1, r.trade_uid, end, *own))
            elif end <= newest:
                heapq.heappush(due, (end, 0, "", end, *own))
            else:
                later.setdefault(end, []).append(own)
        while due:
            totals.add(heapq.heappop(due)[-1])
        for end, entries in later.items():
            self._keep(end, entries)
        self.totals.update(totals.row())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs() // 1000
        if self.open.containsKey((end,)):
            totals = self._totals()
            for pnl in self.open.getValue((end,))[2]:
                totals.add(pnl)
            self.totals.update(totals.row())
            self.open.removeKey((end,))
        return iter([])

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """initial_state()'s rows of a user: one with the totals, one for each open end."""
        if initialState.end is None:
            self.totals.update((initialState.s, initialState.ss, initialState.n, initialState.won, initialState.lost, list(initialState.tail)))
        else:
            self._keep(initialState.end, [(initialState.at, initialState.uid, initialState.pnl)])

    def close(self) -> None:
        pass


def initial_state(rows: DataFrame, until: int) -> DataFrame:
    """What a stream that begins at `until` carries over from a batch of base() rows before
    it: a row for each user with the totals, and one for each profit that is open then."""
    events = C.pnl_events(rows.where(F.col("timestamp") < until))
    totals = C.pnl_sums(events.where(F.col("_k") < until), ["user_id"])
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    totals = totals.select("user_id", "s", "ss", "n", "won", "lost", "tail", null("end", "long"), null("at", "long"), null("uid", "string"), null("pnl", "double"))
    names = [null(c, t) for c, t in (x.split() for x in TOTALS.split(", "))]
    waiting = events.where(F.col("_k") >= until).select("user_id", *names, F.col("_end").alias("end"), F.col("timestamp").alias("at"), F.col("trade_uid").alias("uid"), "pnl")
    return totals.unionByName(waiting)


def realised_stream(rows: DataFrame, initial: DataFrame | None = None, delay: str = "1 second") -> DataFrame:
    """realised_pnl()'s columns for a stream of base() rows that comes in the order of time,
    up to `delay`. initial: initial_state(). Needs the RocksDB state store, which is set
    for the session here."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = rows.select("user_id", "trade_uid", "timestamp", "end_ts", "pnl_raw", F.timestamp_seconds("timestamp").alias("ts")).withWatermark("ts", delay)
    begun = None if initial is None else initial.groupBy("user_id")
    return timed.groupBy("user_id").transformWithState(RealisedProfits(), OUT, "Append", "EventTime", begun)
