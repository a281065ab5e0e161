"""Live input by Structured Streaming: the same nodes over lanes as they arrive.

Stamping at ingest makes every buffered prefix complete, so nothing is late: state is bounded by what a node holds (an
open bar, a sum, a book), not by a watermark.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from threading import Lock

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewheel.operators.shadow import DELTA, ShadowBook, fold
from tidewheel.sources.lanes import Catalog

BAR = "sym int, ts_close long, open long, high long, low long, close long, vol long, flow long, emit_seq long"
_BAR = [f.split()[0] for f in BAR.split(", ")]


def bars(trades: DataFrame, tf: int) -> DataFrame:
    """Bars that close when the next period's first trade arrives, not when a watermark passes.

    ``trades``: sym, seq, ts, side, price_raw, qty_raw. The open bar is a symbol's only state.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, ts, side, price, qty in rows[["seq", "ts", "side", "price_raw", "qty_raw"]].itertuples(index=False):
            close, flow = int(ts - ts % tf + tf), int((1 - 2 * side) * price * qty)
            if now is not None and now[0] == close:
                now = [close, now[1], max(now[2], price), min(now[3], price), price, now[5] + qty, now[6] + flow]
            else:
                if now is not None:
                    out.append((key[0], *map(int, now), int(seq)))
                now = [close, price, price, price, price, qty, flow]
        state.update(tuple(map(int, now)))
        yield pd.DataFrame(out, columns=_BAR)

    held = "close_ts long, open long, high long, low long, close long, vol long, flow long"
    return trades.groupBy("sym").applyInPandasWithState(run, BAR, held, "append", GroupStateTimeout.NoTimeout)


def running_sum(rows: DataFrame, value: str) -> DataFrame:
    """sym, seq, total: the running sum of a column by ``seq``."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(batches)).sort_values("seq")
        total = part[value].cumsum() + (state.get[0] if state.exists else 0)
        state.update((int(total.iloc[-1]),))
        yield pd.DataFrame({"sym": key[0], "seq": part["seq"], "total": total})

    return rows.groupBy("sym").applyInPandasWithState(run, "sym int, seq long, total long", "total long", "append", GroupStateTimeout.NoTimeout)


def shadow(messages: DataFrame) -> DataFrame:
    """Shadow books over a stream of messages; a book's levels are a symbol's state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = ShadowBook()
        if state.exists:
            seq, sides, prices, qtys = state.get
            book = ShadowBook(list(zip(sides, prices, qtys, strict=True)), seq)
        out = fold(int(key[0]), pd.concat(list(batches)).sort_values("recv"), book)
        levels = [(s, p, q) for (s, p), q in book.book.levels().items()]
        state.update((book.seq, *([int(x[i]) for x in levels] for i in range(3))))
        yield out

    held = "seq long, sides array<int>, prices array<long>, qtys array<long>"
    return messages.groupBy("sym").applyInPandasWithState(run, DELTA, held, "append", GroupStateTimeout.NoTimeout)


def window_bars(trades: DataFrame, tf: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """The approximate fast path: bars that close when the watermark passes, in generated code only.

    ``trades`` has an ``event_time`` timestamp besides the lane's columns.
    """
    w = F.window("event_time", tf)
    order = F.struct("ts", "seq")
    return trades.withWatermark("event_time", late).groupBy("sym", w).agg(F.min_by("price_raw", order).alias("open"), F.max("price_raw").alias("high"), F.min("price_raw").alias("low"), F.max_by("price_raw", order).alias("close"), F.sum("qty_raw").alias("vol"))


def sampled(driver: DataFrame, value: str) -> DataFrame:
    """The last value that stood when each driver's element came, live: sym, seq, value.

    ``driver``: sym, seq and ``value``, present in elements of the sampled series and null in the driver's own, which
    alone are emitted. The state is one value for each symbol.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(batches)).sort_values("seq", kind="stable")
        held = part[value].ffill()
        if state.exists:
            held = held.fillna(state.get[0])
        if held.notna().any():
            state.update((float(held[held.last_valid_index()]),))
        out = part[value].isna()
        yield pd.DataFrame({"sym": key[0], "seq": part.loc[out, "seq"], value: held[out]})

    return driver.groupBy("sym").applyInPandasWithState(run, f"sym int, seq long, {value} double", "held double", "append", GroupStateTimeout.NoTimeout)


def trailing_sum(rows: DataFrame, value: str, n: int) -> DataFrame:
    """sym, seq, total: the sum of the last n elements, null until there are n. The state is n - 1 elements."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(batches)).sort_values("seq")
        before = list(state.get[0]) if state.exists else []
        whole = pd.Series([*before, *part[value].tolist()])
        state.update(([int(x) for x in whole.tolist()[-(n - 1) :]] if n > 1 else [],))
        total = whole.rolling(n).sum().iloc[len(before) :]
        yield pd.DataFrame({"sym": key[0], "seq": part["seq"].to_numpy(), "total": pd.array([None if t != t else int(t) for t in total], dtype="Int64")})

    return rows.groupBy("sym").applyInPandasWithState(run, "sym int, seq long, total long", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def latch(ticks: DataFrame, length: int) -> DataFrame:
    """``control.latch`` live: the state is whether it is armed, whether an end pends, and the step."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        armed, pending, n = state.get if state.exists else (False, False, 0)
        out = []
        for seq, trigger in pd.concat(list(batches)).sort_values("seq")[["seq", "trigger"]].itertuples(index=False):
            if pending:
                armed, pending, n = False, False, 0
            armed = bool(armed or trigger)
            n += armed
            pending = bool(armed and n >= length)
            out.append((key[0], seq, armed, n, pending))
        state.update((armed, pending, n))
        yield pd.DataFrame(out, columns=["sym", "seq", "armed", "n", "done"])

    return ticks.groupBy("sym").applyInPandasWithState(run, "sym int, seq long, armed boolean, n long, done boolean", "armed boolean, pending boolean, n long", "append", GroupStateTimeout.NoTimeout)


class Stamps:
    """Receptions that rise strictly over all lanes of a catalog, also over restarts: the last one is in the manifest."""

    def __init__(self, catalog: Catalog | None = None, clock: Callable[[], int] = time.time_ns) -> None:
        self.clock, self.last, self.lock = clock, catalog.last_reception() if catalog else 0, Lock()

    def take(self, n: int) -> int:
        """The first of ``n`` stamps that no one else gets."""
        with self.lock:
            base = max(self.clock(), self.last + 1)
            self.last = base + n - 1
            return base


class Live:
    """Stamps what arrives with strictly increasing receptions and records it, batch by batch.

    ``sink`` gets each stamped batch; with a catalog, each batch is recorded first, in one job and under its own number, so
    what live recorded is what a replay reads back. A batch that Spark repeats, in this run or after a restart, is not
    recorded or stamped again: the sink gets what was recorded. Lanes that share ``stamps`` never tie.
    """

    def __init__(self, lane: str, catalog: Catalog | None = None, sink: Callable[[DataFrame], None] | None = None, clock: Callable[[], int] = time.time_ns, precision: dict[str, int] | None = None, stamps: Stamps | None = None, name: str = "live") -> None:
        self.lane, self.catalog, self.sink, self.precision, self.name = lane, catalog, sink, precision, name
        self.stamps = stamps or Stamps(catalog, clock)

    def _recorded(self, batch: str) -> DataFrame | None:
        if self.catalog is None:
            return None
        found = self.catalog.manifest().where((F.col("lane") == self.lane) & (F.col("batch") == batch)).collect()
        rows = None
        for r in found:
            own = self.catalog.read(self.lane, r["sym"], r["ts_min"], r["ts_max"], batch)
            rows = own if rows is None else rows.unionByName(own)
        return rows

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        name = f"{self.name}-{batch_id:012d}"
        rows = self._recorded(name)
        if rows is None:
            batch = batch.persist()
            try:
                # a symbol's stamps start after those of the symbols before it, so no stamp comes twice and no task sorts all
                sizes = batch.groupBy("sym").count().orderBy("sym").collect()
                if not sizes:
                    return
                base, starts = self.stamps.take(sum(r["count"] for r in sizes)), []
                for r in sizes:
                    starts.append((r["sym"], base))
                    base += r["count"]
                at = batch.sparkSession.createDataFrame(starts, batch.select("sym", F.lit(0).cast("long").alias("tw_start")).schema)
                n = F.row_number().over(Window.partitionBy("sym").orderBy("monotonic_seq")) - 1
                rows = batch.withColumn("tw_n", n).join(F.broadcast(at), "sym").withColumn("ts_local_recv", F.col("tw_start") + F.col("tw_n")).drop("tw_n", "tw_start")
                if self.catalog:
                    self.catalog.write_batch(self.lane, rows, name, self.precision)
                if self.sink:
                    self.sink(rows)
            finally:
                batch.unpersist()
        elif self.sink:
            self.sink(rows)
