"""Series over trades: period bars and the nodes that read windows of them.

A node is a function from DataFrames to a DataFrame with ``sym``, ``ts_close`` (or ``seq``) and its slots. Prices are
at precision ``PRICE`` (2), quantities at 0; sums are taken on raw integers and decoded last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.plans.reach import by, elems, over, trailing

PRICE = 100.0


def bucket(ts: str | Column, tf: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts - F.pmod(ts, F.lit(tf))


def signed(side: str = "side") -> Column:
    return F.when(F.col(side) == 0, 1).otherwise(-1)


def bars(trades: DataFrame, tf: int) -> DataFrame:
    """Closed bars: sym, ts_close, open, high, low, close (raw), vol, flow (signed raw notional), emit_seq.

    One partial aggregation by (sym, period); a bar is closed by the first trade of a later period, whose ``seq`` is the
    bar's ``emit_seq``. The period still open is left out; empty periods have no bar. Trades must be time-sorted by
    ``seq`` within a symbol; ``bars_by_arrival`` serves others.
    """
    grouped = trades.groupBy("sym", (bucket("ts", tf) + tf).alias("ts_close")).agg(
        F.min_by("price_raw", "seq").alias("open"), F.max("price_raw").alias("high"), F.min("price_raw").alias("low"), F.max_by("price_raw", "seq").alias("close"),
        F.sum("qty_raw").alias("vol"), F.sum(signed() * F.col("price_raw") * F.col("qty_raw")).alias("flow"), F.min("seq").alias("first_seq"),
    )
    return grouped.withColumn("emit_seq", F.lead("first_seq").over(by("ts_close"))).where("emit_seq IS NOT NULL").drop("first_seq")


def bars_by_arrival(trades: DataFrame, tf: int) -> DataFrame:
    """Bars of trades in any time order: a period ends where the next trade by ``seq`` has another one.

    An out-of-order trade closes the current period and reopens an old one, so a period may come twice.
    """
    w = by("seq")
    at = trades.withColumn("b", bucket("ts", tf))
    isle = F.sum((~F.col("b").eqNullSafe(F.lag("b").over(w))).cast("int")).over(w)
    grouped = at.withColumn("isle", isle).groupBy("sym", "isle").agg(
        (F.first("b") + tf).alias("ts_close"), F.min_by("price_raw", "seq").alias("open"), F.max("price_raw").alias("high"), F.min("price_raw").alias("low"), F.max_by("price_raw", "seq").alias("close"),
        F.sum("qty_raw").alias("vol"), F.min("seq").alias("first_seq"),
    )
    return grouped.withColumn("emit_seq", F.lead("first_seq").over(by("isle"))).where("emit_seq IS NOT NULL").drop("first_seq", "isle")


def flows(b: DataFrame) -> DataFrame:
    return b.select("sym", "ts_close", "close", "flow")


def running(rows: DataFrame, values: dict[str, tuple[Column, str]], block: Column, order: str | tuple[str, ...] = "seq") -> DataFrame:
    """``rows`` with running aggregates by ``order`` within ``sym``, in blocks, so that one symbol is not one task.

    ``values``: name -> (column, sum, max, or last: the last present). What blocks end with (partial aggregates, one row
    each) is carried over blocks first; each block then needs only its own rows and its carry. ``block`` must not fall
    as ``order`` rises. A null symbol or block is one as any other: they are joined as a struct, which is never null.
    """
    order = (order,) if isinstance(order, str) else order
    last = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    rows = rows.withColumn("tw_block", F.struct("sym", block.alias("block"))).withColumns({f"tw_{k}": v for k, (v, _) in values.items()})
    whole = {"sum": lambda c: F.sum(c), "max": lambda c: F.max(c), "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), last))}
    over = {"sum": lambda c, w: F.sum(c).over(w), "max": lambda c, w: F.max(c).over(w), "last": lambda c, w: F.last(c, ignorenulls=True).over(w)}
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b), "last": lambda a, b: F.coalesce(b, a)}
    totals = rows.groupBy("tw_block").agg(*[whole[how](f"tw_{k}").alias(f"tw_{k}") for k, (_, how) in values.items()])
    before = Window.partitionBy("tw_block.sym").orderBy("tw_block.block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("tw_block", *[over[how](f"tw_{k}", before).alias(f"tw_carry_{k}") for k, (_, how) in values.items()])
    w = Window.partitionBy("tw_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"tw_{k}": over[how](f"tw_{k}", w) for k, (_, how) in values.items()}).join(carry, "tw_block")
    out = out.withColumns({k: join[how](F.col(f"tw_carry_{k}"), F.col(f"tw_{k}")) for k, (_, how) in values.items()})
    return out.drop("tw_block", *[f"tw_{k}" for k in values], *[f"tw_carry_{k}" for k in values])


def running_sum(rows: DataFrame, value: Column, block: Column, out: str) -> DataFrame:
    return running(rows, {out: (value, "sum")}, block)


def cvd(trades: DataFrame, block: int) -> DataFrame:
    """sym, seq, cvd: the running sum of signed raw notional, after each trade."""
    return running_sum(trades, signed() * F.col("price_raw") * F.col("qty_raw"), bucket("ts", block), "cvd").select("sym", "seq", "cvd")


def book_flow(deltas: DataFrame, block: int) -> DataFrame:
    """The running sum of signed quantities over updates (not corrections); deletions add 0 but still emit."""
    return running_sum(deltas.where("kind = 0"), signed() * F.col("qty_raw"), bucket("ts", block), "book_flow").select("sym", "seq", "book_flow")


def vol_usd(b: DataFrame) -> DataFrame:
    return b.select("sym", "ts_close", "emit_seq", (F.col("vol") * F.col("close") / PRICE).alias("vol_usd"))


def rsi_delta(b: DataFrame) -> DataFrame:
    """close - the close before (raw); null for the first."""
    return b.select("sym", "ts_close", (F.col("close") - F.lag("close").over(by("ts_close"))).alias("delta"))


def change(b: DataFrame, back: int) -> DataFrame:
    """Per cent from the open of the oldest bar in (t - back, t] to the close; null if incomplete or not over 0."""
    w, whole = trailing(over(back))
    base = F.first("open").over(w)
    return b.select("sym", "ts_close", "emit_seq", F.when(whole & (base > 0), (F.col("close") - base) / base * 100.0).alias("change"))


def change_back(clock: DataFrame, refs: DataFrame, back: int, reach: int) -> DataFrame:
    """Per cent from the first reference close after t - back, if one at or before that is still retained.

    Both series are read in one pass over their union; there is no range join.
    """
    both = clock.select("sym", "ts_close", "close", F.lit(None).cast("long").alias("ref")).unionByName(refs.select("sym", "ts_close", F.lit(None).cast("long").alias("close"), F.col("close").alias("ref")))
    base = F.first("ref", ignorenulls=True).over(by("ts_close").rangeBetween(-(back - 1), 0))
    older = F.count("ref").over(by("ts_close").rangeBetween(-(reach - 1), -back))
    value = F.when((older > 0) & (base != 0), (F.col("close") - base) / base * 100.0)
    return both.withColumn("change_back", value).where("close IS NOT NULL").select("sym", "ts_close", "change_back")


def rolling_vol(b: DataFrame, n: int) -> DataFrame:
    w, whole = trailing(elems(n))
    return b.select("sym", "ts_close", "emit_seq", F.when(whole, F.sum(F.col("vol") * F.col("close")).over(w) / PRICE).alias("rolling_vol"))


def momentum(b: DataFrame, n: int, risk_free: float = 0.04) -> DataFrame:
    """(mean return * 365 - risk free) / (population deviation * root of n - 1) over n closes; null if flat."""
    r = b.withColumn("r", F.col("close") / F.lag("close").over(by("ts_close")) - 1.0)
    w, whole = trailing(elems(n - 1))
    full = F.count("r").over(w) == n - 1
    deviation = F.stddev_pop("r").over(w) * float((n - 1) ** 0.5)
    return r.select("sym", "ts_close", "emit_seq", F.when(whole & full & (deviation > 0), (F.avg("r").over(w) * 365.0 - risk_free) / deviation).alias("momentum"))


def kyle_lambda(b: DataFrame, n: int) -> DataFrame:
    """Regression of price moves on flows over n periods, the first of which only gives a price; 0 if nothing flowed."""
    x = b.select("sym", "ts_close", "emit_seq", (F.col("close") / PRICE - F.lag("close").over(by("ts_close")) / PRICE).alias("d"), (F.col("flow") / PRICE).alias("f"))
    w = by("ts_close").rowsBetween(-(n - 2), 0)
    _, whole = trailing(elems(n))
    top, bottom = F.sum(F.col("d") * F.col("f")).over(w), F.sum(F.col("f") * F.col("f")).over(w)
    return x.select("sym", "ts_close", "emit_seq", F.when(whole, F.when(bottom == 0, 0.0).otherwise(top / bottom)).alias("kyle_lambda"))


def by_number(order: str = "seq", most: int = 1 << 16) -> Column:
    """Blocks of at most ``most`` whole numbers ``order``, whatever their times are."""
    return F.floor(F.col(order) / most)


def numbered(rows: DataFrame, block: Column, out: str, order: str = "seq") -> DataFrame:
    """``rows`` with their number from 0 by ``order`` within ``sym``, in blocks as ``running``."""
    return running(rows, {out: (F.lit(1).cast("long"), "sum")}, block, order).withColumn(out, F.col(out) - 1)


def mock_ohlc(trades: DataFrame, step: int, block: int | None = None) -> DataFrame:
    """Candles of ``step`` trades each; the last may have fewer. ``block``: ns of ``ts`` that one task numbers."""
    if block:
        rows = numbered(trades, bucket("ts", block), "tw_n").withColumn("chunk", F.floor(F.col("tw_n") / step))
    else:
        rows = trades.withColumn("chunk", F.floor((F.row_number().over(by("seq")) - 1) / step))
    return rows.groupBy("sym", "chunk").agg(F.min_by("price_raw", "seq").alias("open"), F.max("price_raw").alias("high"), F.min("price_raw").alias("low"), F.max_by("price_raw", "seq").alias("close"))
