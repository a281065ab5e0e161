"""The engine's queries over lanes made of ``events``, each with DuckDB SQL where SQL can express it.

Periods are 1 h, 4 h and 1 d where a strategy would use 1 m, 5 m and 1 h: the table has about 14 trades an hour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions import expr as E
from tidewheel.functions.precision import pair, raw, symbol, ticker
from tidewheel.operators import book, control, recurrences, sampling, series, shadow, strategy
from tidewheel.operators.series import bars
from tidewheel.plans import observe
from tidewheel.plans import weave as W
from tidewheel.plans.graph import Graph, buffering, folding, gating, node
from tidewheel.plans.graph import sampling as sampling_of
from tidewheel.plans.reach import UNBOUNDED, by, elems, fresh, lagged, over, past
from tidewheel.plans.replay import Replay, chained
from tidewheel.sources import lanes
from tidewheel.sources.lanes import DAY, HOUR, SQL, Catalog
from tidewheel.streaming import live

H4 = 4 * HOUR
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


def r6(c):
    return F.round(c, 6)


def _t(name: str) -> str:
    return f"{name} AS ({SQL[name]})"


def _bars(name: str, tf: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT sym, p + {tf} AS ts_close, arg_min(price_raw, seq) AS open, max(price_raw) AS high, min(price_raw) AS low, arg_max(price_raw, seq) AS close,
 CAST(sum(qty_raw) AS BIGINT) AS vol, CAST(sum((1 - 2*side)*price_raw*qty_raw) AS BIGINT) AS flow, lead(min(seq)) OVER (PARTITION BY sym ORDER BY p) AS emit_seq
 FROM (SELECT *, ts - ts % {tf} AS p FROM trades) GROUP BY sym, p) WHERE emit_seq IS NOT NULL)"""


def _momentum(name: str, src: str, n: int) -> str:
    return f"""{name}r AS (SELECT *, CAST(close AS DOUBLE) / lag(close) OVER (PARTITION BY sym ORDER BY ts_close) - 1.0 AS r, count(*) OVER (PARTITION BY sym ORDER BY ts_close) AS k FROM {src}),
{name} AS (SELECT sym, ts_close, emit_seq, CASE WHEN k >= {n} AND stddev_pop(r) OVER w > 0 THEN (avg(r) OVER w * 365.0 - 0.04) / (stddev_pop(r) OVER w * sqrt({n - 1}.0)) END AS momentum
 FROM {name}r WINDOW w AS (PARTITION BY sym ORDER BY ts_close ROWS BETWEEN {n - 2} PRECEDING AND CURRENT ROW))"""


def _b(spark, sf_dir, tf=HOUR) -> DataFrame:
    return bars(lanes.trades(spark, sf_dir), tf)


_BAR_COLUMNS = ("sym", "ts_close", "open", "high", "low", "close", "vol", "emit_seq")
for _name, _tf in (("bars_1h", HOUR), ("bars_4h", H4), ("bars_1d", DAY)):
    query(f"WITH {_t('trades')}, {_bars('b', _tf)} SELECT {', '.join(_BAR_COLUMNS)} FROM b", _name)(lambda s, d, tf=_tf: _b(s, d, tf).select(*_BAR_COLUMNS))


@query(f"""WITH {_t('trades')}, x AS (SELECT sym, seq, price_raw, qty_raw, ts - CASE WHEN seq % 7 = 0 THEN {2 * HOUR} ELSE 0 END AS ts FROM trades), p AS (SELECT *, ts - ts % {HOUR} AS p FROM x),
m AS (SELECT *, CASE WHEN p IS DISTINCT FROM lag(p) OVER (PARTITION BY sym ORDER BY seq) THEN 1 ELSE 0 END AS new FROM p), i AS (SELECT *, sum(new) OVER (PARTITION BY sym ORDER BY seq) AS isle FROM m),
g AS (SELECT sym, isle, any_value(p) + {HOUR} AS ts_close, arg_min(price_raw, seq) AS open, max(price_raw) AS high, min(price_raw) AS low, arg_max(price_raw, seq) AS close, CAST(sum(qty_raw) AS BIGINT) AS vol, lead(min(seq)) OVER (PARTITION BY sym ORDER BY isle) AS emit_seq FROM i GROUP BY sym, isle)
SELECT sym, ts_close, open, high, low, close, vol, emit_seq FROM g WHERE emit_seq IS NOT NULL""")
def bars_by_arrival(spark, sf_dir):
    """Each seventh trade is two hours late, so periods are closed by it and opened again."""
    t = lanes.trades(spark, sf_dir)
    return series.bars_by_arrival(t.withColumn("ts", F.col("ts") - F.when(F.col("seq") % 7 == 0, 2 * HOUR).otherwise(0)), HOUR).select(*_BAR_COLUMNS)


@query(f"WITH {_t('trades')}, {_bars('b', HOUR)} SELECT sym, ts_close, close, flow FROM b")
def flows_1h(spark, sf_dir):
    return series.flows(_b(spark, sf_dir))


@query(f"WITH {_t('trades')} SELECT sym, seq, CAST(sum((1 - 2*side)*price_raw*qty_raw) OVER (PARTITION BY sym ORDER BY seq) AS BIGINT) AS cvd FROM trades")
def cvd(spark, sf_dir):
    return series.cvd(lanes.trades(spark, sf_dir), DAY)


@query(f"WITH {_t('trades')}, {_bars('b', HOUR)} SELECT sym, ts_close, close - lag(close) OVER (PARTITION BY sym ORDER BY ts_close) AS delta FROM b")
def rsi_delta(spark, sf_dir):
    return series.rsi_delta(_b(spark, sf_dir))


_CHANGE = f"""c AS (SELECT sym, ts_close, emit_seq, CASE WHEN ts_close - {DAY} >= min(ts_close) OVER (PARTITION BY sym) AND first_value(open) OVER w > 0
 THEN CAST(close - first_value(open) OVER w AS DOUBLE) / first_value(open) OVER w * 100.0 END AS change FROM b
 WINDOW w AS (PARTITION BY sym ORDER BY ts_close RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_t('trades')}, {_bars('b', HOUR)}, {_CHANGE} SELECT sym, ts_close, round(change, 6) AS change FROM c")
def change_over(spark, sf_dir):
    return series.change(_b(spark, sf_dir), DAY).select("sym", "ts_close", r6("change").alias("change"))


@query(f"""WITH {_t('trades')}, {_bars('b', HOUR)}, {_bars('f', H4)},
x AS (SELECT b.sym, b.ts_close, any_value(b.close) AS close, arg_min(f.close, f.ts_close) FILTER (f.ts_close > b.ts_close - {DAY}) AS base, count(*) FILTER (f.ts_close <= b.ts_close - {DAY}) AS older
 FROM b LEFT JOIN f ON f.sym = b.sym AND f.ts_close <= b.ts_close AND f.ts_close > b.ts_close - {2 * DAY} GROUP BY ALL)
SELECT sym, ts_close, CASE WHEN older > 0 AND base <> 0 THEN round(CAST(close - base AS DOUBLE) / base * 100.0, 6) END AS change_back FROM x""")  # fmt: skip
def change_back(spark, sf_dir):
    t = lanes.trades(spark, sf_dir)
    return series.change_back(bars(t, HOUR), bars(t, H4), DAY, 2 * DAY).select("sym", "ts_close", r6("change_back").alias("change_back"))


_ROLLING = """v AS (SELECT sym, ts_close, emit_seq, CASE WHEN count(*) OVER w = 24 THEN CAST(sum(vol*close) OVER w AS DOUBLE) / 100.0 END AS rolling_vol
 FROM b WINDOW w AS (PARTITION BY sym ORDER BY ts_close ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_t('trades')}, {_bars('b', HOUR)}, {_ROLLING} SELECT sym, ts_close, round(rolling_vol, 4) AS rolling_vol FROM v")
def rolling_vol(spark, sf_dir):
    return series.rolling_vol(_b(spark, sf_dir), 24).select("sym", "ts_close", F.round("rolling_vol", 4).alias("rolling_vol"))


@query(f"WITH {_t('trades')}, {_bars('b', HOUR)}, {_momentum('m', 'b', 25)} SELECT sym, ts_close, round(momentum, 6) AS momentum FROM m")
def momentum(spark, sf_dir):
    return series.momentum(_b(spark, sf_dir), 25).select("sym", "ts_close", r6("momentum").alias("momentum"))


_LAMBDA = """x AS (SELECT sym, ts_close, emit_seq, close/100.0 - lag(close) OVER (PARTITION BY sym ORDER BY ts_close)/100.0 AS d, CAST(flow AS DOUBLE)/100.0 AS f, count(*) OVER (PARTITION BY sym ORDER BY ts_close) AS k FROM b),
l AS (SELECT sym, ts_close, emit_seq, CASE WHEN k >= 24 THEN CASE WHEN sum(f*f) OVER w = 0 THEN 0.0 ELSE sum(d*f) OVER w / sum(f*f) OVER w END END AS kyle_lambda
 FROM x WINDOW w AS (PARTITION BY sym ORDER BY ts_close ROWS BETWEEN 22 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_t('trades')}, {_bars('b', HOUR)}, {_LAMBDA} SELECT sym, ts_close, round(kyle_lambda, 9) AS kyle_lambda FROM l")
def kyle_lambda(spark, sf_dir):
    return series.kyle_lambda(_b(spark, sf_dir), 24).select("sym", "ts_close", F.round("kyle_lambda", 9).alias("kyle_lambda"))


@query(f"WITH {_t('trades')}, {_bars('b', HOUR)} SELECT sym, ts_close, round(vol*close/100.0, 4) AS vol_usd FROM b")
def vol_usd(spark, sf_dir):
    return series.vol_usd(_b(spark, sf_dir)).select("sym", "ts_close", F.round("vol_usd", 4).alias("vol_usd"))


_N = "n AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY ts_close) AS i, lag(close) OVER (PARTITION BY sym ORDER BY ts_close) AS pc FROM b)"


def _wilder_cte(name: str, x: str, first: int) -> str:
    """A recursive Wilder average over 14 of expression ``x`` from row ``first`` on."""
    return f"""{name} AS (SELECT sym, i, CAST({x} AS DOUBLE) AS v FROM n WHERE i = {first} UNION ALL
 SELECT n.sym, n.i, CASE WHEN n.i < {first + 13} THEN w.v + {x} WHEN n.i = {first + 13} THEN (w.v + {x}) / 14 ELSE (w.v * 13 + {x}) / 14 END FROM {name} w JOIN n ON n.sym = w.sym AND n.i = w.i + 1)"""


def _moves_sql(x: str, out: str) -> str:
    return f"WITH RECURSIVE {_t('trades')}, {_bars('b', H4)}, {_N}, {_wilder_cte('w', x, 2)} SELECT n.sym, n.ts_close, CASE WHEN n.i >= 15 THEN round(w.v, 6) END AS {out} FROM n LEFT JOIN w ON n.sym = w.sym AND n.i = w.i"


@query(_moves_sql("greatest(n.close - n.pc, 0)", "avg_gain"))
def wilder_gain(spark, sf_dir):
    return recurrences.average_moves(_b(spark, sf_dir, H4)).select("sym", "ts_close", r6("avg_gain").alias("avg_gain"))


@query(_moves_sql("greatest(n.pc - n.close, 0)", "avg_loss"))
def wilder_loss(spark, sf_dir):
    return recurrences.average_moves(_b(spark, sf_dir, H4)).select("sym", "ts_close", r6("avg_loss").alias("avg_loss"))


_RSI = f"""{_wilder_cte('g', 'greatest(n.close - n.pc, 0)', 2)}, {_wilder_cte('l', 'greatest(n.pc - n.close, 0)', 2)},
q AS (SELECT n.sym, n.ts_close, n.emit_seq, n.i, CASE WHEN l.v > 0 THEN 100 - 100/(1 + g.v/l.v) ELSE 100.0 END AS r FROM n JOIN g ON n.sym = g.sym AND n.i = g.i JOIN l ON n.sym = l.sym AND n.i = l.i WHERE n.i >= 15),
s AS (SELECT sym, i, r AS v FROM q WHERE i = 15 UNION ALL SELECT q.sym, q.i, (2.0/15)*q.r + (1 - 2.0/15)*s.v FROM s JOIN q ON q.sym = s.sym AND q.i = s.i + 1)"""


@query(f"WITH RECURSIVE {_t('trades')}, {_bars('b', H4)}, {_N}, {_RSI} SELECT n.sym, n.ts_close, CASE WHEN n.i >= 28 THEN round(q.r, 6) END AS rsi, CASE WHEN n.i >= 28 THEN round(s.v, 6) END AS smoothed FROM n LEFT JOIN q ON n.sym = q.sym AND n.i = q.i LEFT JOIN s ON n.sym = s.sym AND n.i = s.i")
def rsi(spark, sf_dir):
    return recurrences.rsi(_b(spark, sf_dir, H4)).select("sym", "ts_close", r6("rsi").alias("rsi"), r6("smoothed").alias("smoothed"))


_TR = "CASE WHEN n.pc IS NULL THEN n.high - n.low ELSE greatest(n.high - n.low, abs(n.high - n.pc), abs(n.low - n.pc)) END"


@query(f"WITH RECURSIVE {_t('trades')}, {_bars('b', H4)}, {_N}, {_wilder_cte('w', _TR, 1)} SELECT n.sym, n.ts_close, CASE WHEN n.i >= 14 THEN round(w.v, 6) END AS atr FROM n LEFT JOIN w ON n.sym = w.sym AND n.i = w.i")
def atr(spark, sf_dir):
    return recurrences.atr(_b(spark, sf_dir, H4)).select("sym", "ts_close", r6("atr").alias("atr"))


def _sampled(spark, sf_dir) -> DataFrame:
    t = lanes.trades(spark, sf_dir)
    m = series.momentum(bars(t, H4), 13)
    return sampling.sample(bars(t, HOUR), "emit_seq", {"momentum": (m, "emit_seq", "momentum")})


_SAMPLED = f"""{_bars('b', HOUR)}, {_bars('f', H4)}, {_momentum('m', 'f', 13)},
mm AS (SELECT sym, emit_seq AS at, momentum FROM m WHERE momentum IS NOT NULL),
y AS (SELECT b.*, mm.momentum FROM b ASOF LEFT JOIN mm ON b.sym = mm.sym AND b.emit_seq >= mm.at)"""


@query(f"WITH {_t('trades')}, {_SAMPLED} SELECT sym, ts_close, round(momentum, 6) AS momentum FROM y")
def sampled_momentum_on_bars(spark, sf_dir):
    return _sampled(spark, sf_dir).select("sym", "ts_close", r6("momentum").alias("momentum"))


@query(f"WITH {_t('trades')}, {_SAMPLED} SELECT sym, ts_close, coalesce(momentum > 5.0, FALSE) AS passes FROM y")
def std_screener(spark, sf_dir):
    return _sampled(spark, sf_dir).select("sym", "ts_close", control.decides(F.col("momentum") > 5.0).alias("passes"))


@query(f"WITH {_t('trades')}, {_SAMPLED} SELECT sym, ts_close, round(vol*close/100.0, 4) AS vol_usd FROM y WHERE momentum > 5.0")
def gated_vol(spark, sf_dir):
    rows = control.gated(_sampled(spark, sf_dir), F.col("momentum") > 5.0)
    return rows.select("sym", "ts_close", F.round(F.col("vol") * F.col("close") / 100.0, 4).alias("vol_usd"))


@query(f"""WITH RECURSIVE {_t('trades')}, {_bars('b', H4)}, {_bars('h', HOUR)}, {_N}, {_RSI}, c AS (SELECT sym, ts_close, emit_seq, CASE WHEN ts_close - {DAY} >= min(ts_close) OVER (PARTITION BY sym) AND first_value(open) OVER w > 0
 THEN CAST(close - first_value(open) OVER w AS DOUBLE) / first_value(open) OVER w * 100.0 END AS change FROM h WINDOW w AS (PARTITION BY sym ORDER BY ts_close RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW)),
rr AS (SELECT sym, emit_seq AS at, r FROM q WHERE i >= 28)
SELECT c.sym, c.ts_close, coalesce(rr.r > 50 AND c.change > 1.0, FALSE) AS passes FROM c ASOF LEFT JOIN rr ON c.sym = rr.sym AND c.emit_seq >= rr.at""")  # fmt: skip
def rsi_screener(spark, sf_dir):
    t = lanes.trades(spark, sf_dir)
    moves = series.change(bars(t, HOUR), DAY)
    both = sampling.sample(moves, "emit_seq", {"rsi": (recurrences.rsi(bars(t, H4)), "emit_seq", "rsi")})
    return both.select("sym", "ts_close", control.decides((F.col("rsi") > 50) & (F.col("change") > 1.0)).alias("passes"))


@query(f"""WITH {_t('trades')}, {_bars('b', HOUR)}, {_LAMBDA}, {_ROLLING},
k AS (SELECT sym, emit_seq AS at, kyle_lambda FROM l WHERE kyle_lambda IS NOT NULL), z AS (SELECT sym, emit_seq AS at, rolling_vol FROM v WHERE rolling_vol IS NOT NULL),
c AS (SELECT sym, seq, CAST(sum((1 - 2*side)*price_raw*qty_raw) OVER (PARTITION BY sym ORDER BY seq) AS DOUBLE) / 100.0 AS cvd FROM trades),
j AS (SELECT c.*, k.kyle_lambda FROM c ASOF LEFT JOIN k ON c.sym = k.sym AND c.seq >= k.at), o AS (SELECT j.*, z.rolling_vol FROM j ASOF LEFT JOIN z ON j.sym = z.sym AND j.seq >= z.at)
SELECT sym, seq, round(1e6*kyle_lambda + 1e-6*(cvd - rolling_vol), 3) AS signal FROM o""")  # fmt: skip
def signal(spark, sf_dir):
    t = lanes.trades(spark, sf_dir)
    b = bars(t, HOUR)
    levels = {"lam": (series.kyle_lambda(b, 24), "emit_seq", "kyle_lambda"), "vol": (series.rolling_vol(b, 24), "emit_seq", "rolling_vol")}
    levels = {k: (df.withColumnRenamed(v, k), at, k) for k, (df, at, v) in levels.items()}
    rows = sampling.sample(series.cvd(t, DAY).withColumn("cvd", F.col("cvd") / 100.0), "seq", levels)
    body = 1e6 * E.var(0) + 1e-6 * (E.var(1) - E.var(2))
    return rows.select("sym", "seq", F.round(E.to_column(body, [F.col("lam"), F.col("cvd"), F.col("vol")]), 3).alias("signal"))


@query(f"""WITH {_t('trades')}, x AS (SELECT sym, seq, CASE WHEN price_raw >= 1000 THEN CAST(price_raw // 2000 AS BIGINT) END AS level FROM trades)
SELECT sym, seq, level, level IS DISTINCT FROM lag(level) OVER (PARTITION BY sym ORDER BY seq) AS moved FROM x""")  # fmt: skip
def moved_levels(spark, sf_dir):
    rows = lanes.trades(spark, sf_dir).select("sym", "seq", F.when(F.col("price_raw") >= 1000, F.expr("price_raw div 2000")).alias("level"))
    return control.moved(rows, "level")


@query(f"""WITH {_t('trades')}, x AS (SELECT *, ts // {HOUR} AS p FROM trades WHERE side = 0)
SELECT sym, seq, ts FROM (SELECT *, lag(p) OVER (PARTITION BY sym ORDER BY seq) AS b FROM x) WHERE p IS DISTINCT FROM b""")  # fmt: skip
def clocked_ticks(spark, sf_dir):
    return control.clocked(lanes.trades(spark, sf_dir), HOUR, gate=F.col("side") == 0).select("sym", "seq", "ts")


def _woven(spark, sf_dir, step) -> DataFrame:
    mc = lanes.market_cap(spark, sf_dir).withColumn("seq", F.col("ts"))
    return W.weave([W.arrivals(lanes.trades(spark, sf_dir), "trades", "recv"), W.arrivals(lanes.deltas(spark, sf_dir), "deltas", None), W.arrivals(lanes.open_interest(spark, sf_dir), "oi", None), W.arrivals(mc, "mc", None)], step)


def _weave_sql(step: int) -> str:
    cell = "arrival" if step == W.EVENT else f"arrival - arrival % {step}"
    return f"""WITH {_t('trades')}, {_t('deltas')}, {_t('oi')}, {_t('mc')},
a AS (SELECT sym, 'trades' AS lane, 0 AS lane_ix, seq, ts, max(recv) OVER (PARTITION BY sym ORDER BY seq) AS arrival FROM trades UNION ALL SELECT sym, 'deltas', 1, seq, ts, ts FROM deltas
 UNION ALL SELECT sym, 'oi', 3, seq, ts, ts FROM oi UNION ALL SELECT sym, 'mc', 4, ts, ts, ts FROM mc),
c AS (SELECT *, {cell} AS cell, row_number() OVER w AS ord FROM a WINDOW w AS (PARTITION BY sym ORDER BY arrival, lane_ix, seq)),
d AS (SELECT *, CASE WHEN lane_ix = lag(lane_ix) OVER w AND cell = lag(cell) OVER w THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY sym ORDER BY ord)),
w AS (SELECT sym, lane, lane_ix, seq, ts, arrival, ord, CAST(sum(new) OVER (PARTITION BY sym ORDER BY ord) AS BIGINT) AS step_id FROM d),
s AS (SELECT sym, step_id, any_value(lane) AS lane, count(*) AS n, arg_max(ts, ord) AS ts FROM w GROUP BY sym, step_id)"""


@query(_weave_sql(W.EVENT) + " SELECT * FROM w")
def weave_order(spark, sf_dir):
    return _woven(spark, sf_dir, W.EVENT)


@query(_weave_sql(W.EVENT) + " SELECT * FROM s")
def weave_steps_event(spark, sf_dir):
    return W.steps(_woven(spark, sf_dir, W.EVENT))


@query(_weave_sql(HOUR) + " SELECT * FROM s")
def weave_steps_1h(spark, sf_dir):
    return W.steps(_woven(spark, sf_dir, HOUR))


@query(_weave_sql(HOUR) + " SELECT sym, lane, count(*) AS steps, CAST(sum(n) AS BIGINT) AS n_rows FROM s GROUP BY sym, lane")
def step_census(spark, sf_dir):
    return W.census(_woven(spark, sf_dir, HOUR))


_START = 1_704_067_200_000_000_000 + 10 * DAY  # a range inside the table's month


SYMBOLS = range(4)


def _catalog(spark, sf_dir, *names: str) -> Catalog:
    """A catalog of the lanes of all symbols, written as one batch each."""
    catalog = Catalog(spark, lanes.scratch(spark, "catalog"))
    recorded = lambda df, recv: df.select("sym", F.col("ts").alias("ts_venue_exec"), F.lit(None).cast("long").alias("ts_venue_send"), F.col(recv).alias("ts_local_recv"), F.col("seq").alias("monotonic_seq"), *[c for c in df.columns if c in ("kind", "side", "price_raw", "qty_raw", "oi") or c.startswith(("bid_", "ask_"))])
    make = {
        "trades": lambda: recorded(lanes.trades(spark, sf_dir), "recv"),
        "deltas": lambda: recorded(lanes.deltas(spark, sf_dir), "ts"),
        "anchors": lambda: recorded(book.checkpoint_shapes(lanes.deltas(spark, sf_dir), DAY), "ts"),
        "oi": lambda: recorded(lanes.open_interest(spark, sf_dir), "ts"),
        "mc": lambda: lanes.market_cap(spark, sf_dir).select("sym", F.col("ts").alias("ts_local_exec"), "market_cap", F.lit(None).cast("long").alias("rank")),
    }
    for name in names:
        catalog.write_batch(name, make[name](), "whole", {"price": 2, "qty": 0}, apart=True)
    return catalog


def _all(read) -> DataFrame:
    rows = [read(str(s)) for s in SYMBOLS]
    for r in rows[1:]:
        rows[0] = rows[0].unionByName(r)
    return rows[0].withColumn("sym", F.col("sym").cast("int"))


@query(f"WITH {_t('trades')} SELECT sym, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(price_raw*qty_raw) AS BIGINT) AS notional FROM trades WHERE ts BETWEEN {_START} AND {_START + DAY} GROUP BY sym")
def required_rows_in_range(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "trades")
    rows = _all(lambda s: catalog.read("trades", s, _START, _START + DAY))
    return rows.groupBy("sym").agg(F.count(F.lit(1)).alias("n"), F.min("monotonic_seq").alias("first_seq"), F.max("monotonic_seq").alias("last_seq"), F.sum(F.col("price_raw") * F.col("qty_raw")).alias("notional"))


_LANE_SQL = {"deltas": "seq, price_raw, qty_raw FROM deltas", "oi": "ts AS seq, CAST(round(oi) AS BIGINT) AS price_raw, 0 AS qty_raw FROM oi", "mc": "ts AS seq, CAST(round(market_cap) AS BIGINT) AS price_raw, 0 AS qty_raw FROM mc"}


def _lane_query(name: str) -> None:
    def read(spark, sf_dir):
        catalog = _catalog(spark, sf_dir, name)
        rows = _all(lambda s: catalog.read(name, s, _START, _START + 2 * DAY))
        slots = {"deltas": ("monotonic_seq", "price_raw", "qty_raw"), "oi": ("ts_venue_exec", "oi", None), "mc": ("ts_local_exec", "market_cap", None)}[name]
        value = lambda c: F.lit(0).cast("long") if c is None else F.round(c).cast("long") if c in ("oi", "market_cap") else F.col(c).cast("long")
        return rows.select("sym", *[value(c).alias(n) for c, n in zip(slots, ("seq", "price_raw", "qty_raw"), strict=True)])

    query(f"WITH {_t(name)}, a AS (SELECT sym, ts, {_LANE_SQL[name].replace(' FROM', ' FROM', 1)}) SELECT sym, seq, CAST(price_raw AS BIGINT) AS price_raw, CAST(qty_raw AS BIGINT) AS qty_raw FROM a WHERE ts BETWEEN {_START} AND {_START + 2 * DAY}", f"read_{name}")(read)


for _name in _LANE_SQL:
    _lane_query(_name)


@query(f"WITH {_t('trades')} SELECT sym, ts - ts % {10 * DAY} AS period, min(ts) AS ts_min, max(ts) AS ts_max, count(*) AS n FROM trades GROUP BY 1, 2")
def catalog_listing(spark, sf_dir):
    catalog, t = Catalog(spark, lanes.scratch(spark, "catalog")), lanes.trades(spark, sf_dir)
    rows = t.select("sym", F.col("ts").alias("ts_venue_exec"), F.lit(None).cast("long").alias("ts_venue_send"), F.col("recv").alias("ts_local_recv"), F.col("seq").alias("monotonic_seq"), "side", "price_raw", "qty_raw")
    batch = F.concat(F.lit("from-"), series.bucket("ts_venue_exec", 10 * DAY).cast("string"))
    catalog.write_batches("trades", rows.withColumn("batch", batch), apart=True, max_bytes=4000)
    listed = catalog.manifest().select(F.col("sym").cast("int").alias("sym"), series.bucket("ts_min", 10 * DAY).alias("period"), "ts_min", "ts_max", "n")
    return listed


#: Lines that a CSV file of ``csv_ingest`` holds, about.
CSV_LINES = 1 << 18


@query(f"WITH {_t('trades')} SELECT seq - min(seq) OVER () AS line, ts AS ts_venue_exec, side, price_raw, qty_raw FROM trades")
def csv_ingest(spark, sf_dir):
    at, t = lanes.scratch(spark, "csv"), lanes.trades(spark, sf_dir)
    # files follow one another by ``seq``, as their names do, so no task writes or reads the whole
    ordered = t.repartitionByRange(max(1, -(-t.count() // CSV_LINES)), "seq").sortWithinPartitions("seq")
    text = ordered.select(F.concat((F.expr("ts div 1000000000")).cast("string"), F.lit("."), F.lpad((F.col("ts") % 1_000_000_000).cast("string"), 9, "0")).alias("timestamp"), F.lit("X-USDT").alias("symbol"), F.when(F.col("side") == 0, "Buy").otherwise("Sell").alias("side"), F.col("qty_raw").cast("string").alias("size"), (F.col("price_raw") / 100).cast("decimal(18,2)").cast("string").alias("price"))
    text.write.option("header", True).option("compression", "gzip").csv(at)
    rows = lanes.read_csv_trades(spark, at, 2, 0, numbered=True)
    return rows.select(F.col("line").cast("long").alias("line"), "ts_venue_exec", F.col("side").cast("int").alias("side"), F.col("price_raw").cast("long").alias("price_raw"), "qty_raw")


@query(f"WITH {_t('deltas')}, c AS (SELECT sym, ts - ts % {DAY} AS period, min(seq) AS seq, arg_min(ts, seq) AS ts FROM deltas GROUP BY 1, 2) SELECT sym, max(ts) AS ts, arg_max(seq, ts) AS seq FROM c WHERE ts BETWEEN {_START - DAY} AND {_START} GROUP BY sym")
def anchor_pick(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "anchors")
    return _all(lambda s: catalog.anchor(s, _START, DAY)).select("sym", F.col("ts_venue_exec").alias("ts"), F.col("monotonic_seq").alias("seq"))


@query(f"""WITH {_t('deltas')}, c AS (SELECT sym, max(seq) AS upto FROM (SELECT sym, min(seq) AS seq, arg_min(ts, seq) AS ts FROM deltas GROUP BY sym, ts - ts % {DAY}) WHERE ts BETWEEN {_START - DAY} AND {_START} GROUP BY sym),
l AS (SELECT d.sym, side, price_raw, arg_max(qty_raw, seq) AS q FROM deltas d JOIN c ON c.sym = d.sym AND seq <= upto GROUP BY ALL HAVING q > 0)
SELECT sym, count(*) FILTER (side = 0) AS n_bids, count(*) FILTER (side = 1) AS n_asks, CAST(sum(q) FILTER (side = 0) AS BIGINT) AS bid_qty, CAST(max(price_raw) FILTER (side = 0) AS BIGINT) AS bid FROM l GROUP BY sym""")  # fmt: skip
def anchor_shape(spark, sf_dir):
    catalog = _catalog(spark, sf_dir, "anchors")
    shapes = lanes.shape_of(_all(lambda s: catalog.anchor(s, _START, DAY)))
    qty = F.aggregate(F.map_values("bids"), F.lit(0).cast("long"), lambda a, x: a + x)
    return shapes.select("sym", F.size("bids").cast("long").alias("n_bids"), F.size("asks").cast("long").alias("n_asks"), qty.alias("bid_qty"), F.array_max(F.map_keys("bids")).cast("long").alias("bid"))


_UPTO = _START + 5 * HOUR


@query(f"WITH {_t('deltas')} SELECT sym, side, price_raw, arg_max(qty_raw, seq) AS qty_raw FROM deltas WHERE ts <= {_UPTO} GROUP BY ALL HAVING arg_max(qty_raw, seq) > 0")
def book_from_anchor(spark, sf_dir):
    d = lanes.deltas(spark, sf_dir)
    return book.from_anchor(d, book.checkpoint_shapes(d, DAY), _UPTO)


_RANKED = "r AS (SELECT sym, ts, side, price_raw, qty_raw, row_number() OVER (PARTITION BY sym ORDER BY seq) AS seq FROM deltas)"


@query(f"""WITH {_t('deltas')}, {_RANKED}, s AS (SELECT sym, ts - ts % {DAY} AS period, min(seq) AS a, max(seq) AS z, max(seq) - min(seq) + 1 = count(*) AS whole FROM r GROUP BY 1, 2),
j AS (SELECT n.sym, n.period, coalesce(o.whole AND n.whole AND o.z + 1 = n.a, FALSE) AS prev FROM s n LEFT JOIN s o ON o.sym = n.sym AND o.period = n.period - {DAY}),
u AS (SELECT j.sym, j.period, r.side, r.price_raw, r.qty_raw, r.seq, j.prev FROM j JOIN r ON r.sym = j.sym AND (r.ts - r.ts % {DAY} = j.period OR (j.prev AND r.ts - r.ts % {DAY} = j.period - {DAY})))
SELECT sym, period, side, price_raw, arg_max(qty_raw, seq) AS qty_raw, any_value(prev) AS prev FROM u GROUP BY sym, period, side, price_raw""")  # fmt: skip
def book_chunk_joined(spark, sf_dir):
    d = lanes.deltas(spark, sf_dir)
    return book.joined(d.withColumn("seq", F.row_number().over(by("seq")).cast("long")), DAY)


@query(f"""WITH {_t('deltas')}, {_t('mc')}, c AS (SELECT sym, min(seq) AS seq, arg_min(ts, seq) AS ts FROM deltas GROUP BY sym, ts - ts % {HOUR}),
a AS (SELECT sym, 'anchors' AS lane, 2 AS lane_ix, seq, ts, ts AS arrival FROM c UNION ALL SELECT sym, 'mc', 4, ts, ts, ts FROM mc),
o AS (SELECT *, arrival - arrival % {DAY} AS cell, row_number() OVER (PARTITION BY sym ORDER BY arrival, lane_ix, seq) AS ord FROM a),
d AS (SELECT *, CASE WHEN lane_ix = lag(lane_ix) OVER w AND cell = lag(cell) OVER w THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY sym ORDER BY ord)),
w AS (SELECT *, sum(new) OVER (PARTITION BY sym ORDER BY ord) AS step_id FROM d)
SELECT sym, lane, CAST(step_id AS BIGINT) AS step_id, max(seq) AS seq, max(ts) AS ts FROM w GROUP BY ALL""")  # fmt: skip
def weave_anchors(spark, sf_dir):
    due = W.anchors(book.checkpoints(lanes.deltas(spark, sf_dir), HOUR))
    mc = W.arrivals(lanes.market_cap(spark, sf_dir).withColumn("seq", F.col("ts")), "mc", None)
    return W.newest(W.weave([due, mc], DAY)).select("sym", "lane", "step_id", "seq", "ts")


def _range_sql() -> str:
    return _weave_sql(HOUR).replace("FROM trades UNION ALL", f"FROM trades WHERE ts BETWEEN {_START} AND {_START + DAY} UNION ALL").replace("ts FROM deltas\n", f"ts FROM deltas WHERE ts BETWEEN {_START} AND {_START + DAY}\n").replace("SELECT sym, 'oi', 3, seq, ts, ts FROM oi", f"SELECT sym, 'oi', 3, ts, ts, ts FROM oi WHERE ts BETWEEN {_START} AND {_START + DAY}").replace(" UNION ALL SELECT sym, 'mc', 4, ts, ts, ts FROM mc", "")


@query(_range_sql() + " SELECT * FROM s")
def replay_day(spark, sf_dir):
    woven = Replay(_catalog(spark, sf_dir, "trades", "deltas", "oi"), SYMBOLS, _START, _START + DAY, HOUR).woven(("trades", "deltas", "oi"))
    return W.steps(woven).withColumn("sym", F.col("sym").cast("int"))


@query(_range_sql() + f", x AS (SELECT sym, ts, seq FROM trades WHERE ts BETWEEN {_START} AND {_START + DAY}) SELECT sym, seq, CAST(count(*) OVER (PARTITION BY sym, ts - ts % {HOUR}) AS BIGINT) AS n_in_period, w.step_id FROM x JOIN w USING (sym, seq) WHERE w.lane = 'trades'".replace("SELECT sym, seq, CAST(count(*) OVER (PARTITION BY sym, ts", "SELECT sym, seq, CAST(count(*) OVER (PARTITION BY sym, x.ts").replace("x.ts - ts %", "x.ts - x.ts %"))
def replay_graph(spark, sf_dir):
    @node("trades")
    def counted(t):
        return t.withColumn("n_in_period", F.count(F.lit(1)).over(Window.partitionBy("sym", series.bucket("ts", HOUR))))

    graph = Graph(roots=("trades", "deltas", "anchors", "oi", "mc"), nodes=(counted,), outputs=("counted",))
    replay = Replay(_catalog(spark, sf_dir, "trades", "deltas", "oi"), SYMBOLS, _START, _START + DAY, HOUR)
    whole = replay.woven(("trades", "deltas", "oi")).where("lane = 'trades'").select("sym", "seq", "step_id")  # the weave of all lanes
    out = replay.run(graph)["counted"].drop("step_id").join(whole, ["sym", "seq"])
    return out.select(F.col("sym").cast("int").alias("sym"), "seq", "n_in_period", "step_id")


@query(ORACLE_SQL["cvd"])
def chained_cvd(spark, sf_dir):
    """Ten days at a time, each from the sums of those before."""
    t = lanes.trades(spark, sf_dir)
    first = 1_704_067_200_000_000_000

    def run(start: int, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        own = series.cvd(t.where(F.col("ts").between(start, start + 10 * DAY - 1)), DAY)
        if state is not None:
            own = own.join(state, "sym", "left").withColumn("cvd", F.col("cvd") + F.coalesce("total", F.lit(0))).drop("total")
        after = own.groupBy("sym").agg(F.max_by("cvd", "seq").alias("total"))
        if state is not None:
            after = state.join(after.withColumnRenamed("total", "now"), "sym", "full_outer").select("sym", F.coalesce("now", "total").alias("total"))
        return own, after

    return chained([first + i * 10 * DAY for i in range(4)], run, Catalog(spark, lanes.scratch(spark, "catalog")))


@query(f"WITH {_t('deltas')} SELECT sym, ts - ts % {HOUR} AS period, side, price_raw, arg_max(qty_raw, seq) AS qty_raw, count(*) AS n FROM deltas GROUP BY ALL")
def book_net(spark, sf_dir):
    return book.net(lanes.deltas(spark, sf_dir), HOUR)


@query(f"WITH {_t('deltas')} SELECT sym, ts - ts % {HOUR} AS period, max(seq) - min(seq) + 1 = count(*) AS whole, min(seq) AS first_seq, max(seq) AS last_seq FROM deltas GROUP BY ALL")
def book_contiguity(spark, sf_dir):
    return book.contiguity(lanes.deltas(spark, sf_dir), HOUR)


_TOP = f"""WITH {_t('deltas')}, lv AS (SELECT DISTINCT sym, side, price_raw AS p FROM deltas),
dense AS (SELECT d.sym, d.seq, d.ts, lv.side, lv.p, CASE WHEN lv.side = d.side AND lv.p = d.price_raw THEN d.qty_raw END AS q FROM deltas d JOIN lv ON d.sym = lv.sym),
held AS (SELECT sym, seq, ts, side, p, last_value(q IGNORE NULLS) OVER (PARTITION BY sym, side, p ORDER BY seq) AS q FROM dense),
live AS (SELECT *, row_number() OVER (PARTITION BY sym, seq, side ORDER BY CASE WHEN side = 0 THEN -p ELSE p END) AS k FROM held WHERE q > 0),
g AS (SELECT sym, seq, max(p) FILTER (side = 0) AS bid, min(p) FILTER (side = 1) AS ask, CAST(sum(p*q) FILTER (side = 0 AND k <= 20) AS BIGINT) AS bid_depth, CAST(sum(p*q) FILTER (side = 1 AND k <= 20) AS BIGINT) AS ask_depth FROM live GROUP BY sym, seq),
top AS (SELECT d.sym, d.seq, d.ts, CASE WHEN both_ THEN bid END AS bid, CASE WHEN both_ THEN ask END AS ask, CASE WHEN both_ THEN bid_depth END AS bid_depth, CASE WHEN both_ THEN ask_depth END AS ask_depth
 FROM deltas d LEFT JOIN (SELECT *, bid IS NOT NULL AND ask IS NOT NULL AS both_ FROM g) g ON d.sym = g.sym AND d.seq = g.seq)"""


def _top(spark, sf_dir) -> DataFrame:
    return book.top(lanes.deltas(spark, sf_dir), DAY)


@query(_TOP + " SELECT * FROM top")
def book_top(spark, sf_dir):
    return _top(spark, sf_dir)


@query(_TOP + " SELECT sym, seq, ts, round(CAST(ask - bid AS DOUBLE)/bid*100.0, 6) AS spread FROM top")
def spread(spark, sf_dir):
    return book.spread(_top(spark, sf_dir)).withColumn("spread", r6("spread"))


@query(_TOP + " SELECT sym, seq, ts, CASE WHEN bid_depth + ask_depth = 0 THEN 0.0 ELSE round(CAST(bid_depth - ask_depth AS DOUBLE)/(bid_depth + ask_depth), 6) END AS imbalance FROM top")
def imbalance(spark, sf_dir):
    return book.imbalance(_top(spark, sf_dir)).withColumn("imbalance", r6("imbalance"))


@query(_TOP + """, v AS (SELECT sym, seq, side, p, q FROM live WHERE k <= 20), o AS (SELECT sym, seq, ts, lag(seq) OVER (PARTITION BY sym ORDER BY seq) AS before FROM deltas),
n AS (SELECT v.sym, v.seq, v.side, v.p, v.q FROM v), e AS (SELECT o.sym, o.seq, v.side, v.p, v.q FROM o JOIN v ON v.sym = o.sym AND v.seq = o.before),
x AS (SELECT coalesce(n.sym, e.sym) AS sym, coalesce(n.seq, e.seq) AS seq, coalesce(n.side, e.side) AS side, coalesce(n.p, e.p) AS price_raw, coalesce(n.q, 0) AS qty_raw, coalesce(e.q, 0) AS was
 FROM n FULL JOIN e ON n.sym = e.sym AND n.seq = e.seq AND n.side = e.side AND n.p = e.p)
SELECT x.sym, x.seq, o.ts, x.side, x.price_raw, x.qty_raw FROM x JOIN o ON o.sym = x.sym AND o.seq = x.seq WHERE qty_raw <> was""")
def book_view_changes(spark, sf_dir):
    return book.view_changes(lanes.deltas(spark, sf_dir), DAY)


@query(f"WITH {_t('deltas')} SELECT sym, seq, CAST(sum((1 - 2*side)*qty_raw) OVER (PARTITION BY sym ORDER BY seq) AS BIGINT) AS book_flow FROM deltas WHERE kind = 0")
def book_flow(spark, sf_dir):
    return series.book_flow(lanes.deltas(spark, sf_dir), DAY)


@query(f"""WITH {_t('deltas')}, m AS (SELECT max(seq) // 2 AS cut FROM deltas),
a AS (SELECT sym, side, price_raw, arg_max(qty_raw, seq) AS q FROM deltas, m WHERE seq <= cut GROUP BY ALL HAVING q > 0), b AS (SELECT sym, side, price_raw, arg_max(qty_raw, seq) AS q FROM deltas GROUP BY ALL HAVING q > 0)
SELECT sym, side, price_raw, coalesce(b.q, 0) AS qty_raw FROM a FULL JOIN b USING (sym, side, price_raw) WHERE coalesce(a.q, 0) <> coalesce(b.q, 0)""")  # fmt: skip
def book_diff(spark, sf_dir):
    d = lanes.deltas(spark, sf_dir)
    cut = d.agg(F.max("seq")).first()[0] // 2
    return book.diff(book.state(d, cut), book.state(d))


@query(f"WITH {_t('deltas')} SELECT sym, ts - ts % {DAY} AS period, min(seq) AS seq, arg_min(ts, seq) AS ts FROM deltas GROUP BY 1, 2")
def checkpoints_1d(spark, sf_dir):
    return book.checkpoints(lanes.deltas(spark, sf_dir), DAY)


@query(f"WITH {_t('trades')}, {_bars('b', HOUR)}, {_bars('f', H4)} SELECT b.sym, b.ts_close, f.close AS slow_close FROM b ASOF LEFT JOIN f ON b.sym = f.sym AND b.ts_close >= f.ts_close")
def closed_by(spark, sf_dir):
    t = lanes.trades(spark, sf_dir)
    return sampling.closed_by(bars(t, HOUR).select("sym", "ts_close"), {"slow_close": (bars(t, H4), "close")})


@query("SELECT event_id, upper(event_type) || '-USDT' || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '.P' ELSE '.M' END AS ticker, CASE event_id % 3 WHEN 0 THEN 'Spot' WHEN 1 THEN 'Perp' ELSE 'Margin' END AS instrument FROM events")
def symbol_parse(spark, sf_dir):
    text = F.concat("event_type", F.lit("usdt"), F.element_at(F.array(F.lit(""), F.lit(".p"), F.lit(".M")), (F.col("event_id") % 3 + 1).cast("int")))
    base, quote, kind = symbol(text)
    rows = lanes.events(spark, sf_dir).select("event_id", base.alias("b"), quote.alias("q"), kind.alias("instrument"))
    return rows.select("event_id", ticker(F.col("b"), F.col("q"), F.col("instrument")).alias("ticker"), "instrument")


def _situation(spark, sf_dir) -> DataFrame:
    """What the traits read, sampled on hourly bars."""
    tops = book.measures(_top(spark, sf_dir))
    t = lanes.trades(spark, sf_dir)
    b = bars(t, HOUR)
    b = b.withColumn("vol_1m", F.col("vol") * F.col("close") / 100.0)
    oi = lanes.open_interest(spark, sf_dir).withColumn("oi_value", F.col("oi") * 1000.0)
    mc = lanes.market_cap(spark, sf_dir).join(t.groupBy("sym", series.bucket("ts", DAY).alias("ts")).agg(F.min("seq").alias("at")), ["sym", "ts"])
    levels = {
        "momentum": (series.momentum(bars(t, H4), 13), "emit_seq", "momentum"),
        "market_cap": (mc, "at", "market_cap"),
        "oi_value": (oi, "seq", "oi_value"),
        "change_3m": (series.change(b, H4).withColumnRenamed("change", "change_3m"), "emit_seq", "change_3m"),
        "change_1d": (series.change(b, DAY).withColumnRenamed("change", "change_1d"), "emit_seq", "change_1d"),
        "vol_1h": (series.vol_usd(bars(t, DAY)).withColumnRenamed("vol_usd", "vol_1h"), "emit_seq", "vol_1h"),
        "spread": (tops, "seq", "spread"),
        "imbalance": (tops, "seq", "imbalance"),
    }
    return sampling.sample(b.select("sym", "ts_close", "emit_seq", "vol_1m"), "emit_seq", levels)


def _change_sql(name: str, back: int, col: str) -> str:
    return f"""{name} AS (SELECT sym, emit_seq AS at, v AS {col} FROM (SELECT sym, emit_seq, CASE WHEN ts_close - {back} >= min(ts_close) OVER (PARTITION BY sym) AND first_value(open) OVER w > 0
 THEN CAST(close - first_value(open) OVER w AS DOUBLE) / first_value(open) OVER w * 100.0 END AS v FROM b WINDOW w AS (PARTITION BY sym ORDER BY ts_close RANGE BETWEEN {back - 1} PRECEDING AND CURRENT ROW)) WHERE v IS NOT NULL)"""


_SITUATION = f"""{_TOP}, {_t('trades')}, {_t('oi')}, {_t('mc')}, {_bars('b', HOUR)}, {_bars('f', H4)}, {_bars('dd', DAY)}, {_momentum('m', 'f', 13)},
s1 AS (SELECT sym, emit_seq AS at, momentum FROM m WHERE momentum IS NOT NULL), s2 AS (SELECT mc.sym, x.at, mc.market_cap FROM mc JOIN (SELECT sym, ts - ts % {DAY} AS ts, min(seq) AS at FROM trades GROUP BY 1, 2) x ON mc.sym = x.sym AND mc.ts = x.ts),
s3 AS (SELECT sym, seq AS at, oi*1000.0 AS oi_value FROM oi), {_change_sql('s4', H4, 'change_3m')}, {_change_sql('s5', DAY, 'change_1d')}, s6 AS (SELECT sym, emit_seq AS at, vol*close/100.0 AS vol_1h FROM dd),
s7 AS (SELECT sym, seq AS at, CAST(ask - bid AS DOUBLE)/bid*100.0 AS spread FROM top WHERE bid IS NOT NULL), s8 AS (SELECT sym, seq AS at, CASE WHEN bid_depth + ask_depth = 0 THEN 0.0 ELSE CAST(bid_depth - ask_depth AS DOUBLE)/(bid_depth + ask_depth) END AS imbalance FROM top WHERE bid IS NOT NULL),
z0 AS (SELECT sym, ts_close, emit_seq, vol*close/100.0 AS vol_1m FROM b),
""" + ",\n".join(f"z{i} AS (SELECT l.*, r.{c} FROM z{i - 1} l ASOF LEFT JOIN s{i} r ON l.sym = r.sym AND l.emit_seq >= r.at)" for i, c in enumerate(("momentum", "market_cap", "oi_value", "change_3m", "change_1d", "vol_1h", "spread", "imbalance"), 1))  # fmt: skip


# Written out, not made of the operator's table: a wrong value there must not be wrong here as well.
_VOTES = f"""{_SITUATION}, hits AS (SELECT *, coalesce(abs(momentum) > 3, FALSE)::INT AS h1, coalesce(abs(momentum) > 2 AND abs(momentum) <= 3, FALSE)::INT AS h2, coalesce(abs(momentum) <= 2, FALSE)::INT AS h3,
 coalesce(market_cap > 500e6, FALSE)::INT AS h4, coalesce(oi_value > market_cap, FALSE)::INT AS h5, coalesce(oi_value > market_cap / 3 AND change_3m < -7, FALSE)::INT AS h6, coalesce(abs(change_1d) > 20, FALSE)::INT AS h7,
 coalesce(spread > 0.1 AND abs(imbalance) > 0.5, FALSE)::INT AS h8, coalesce(vol_1h > 0 AND vol_1m > vol_1h / 60 * 3, FALSE)::INT AS h9 FROM z8),
votes AS (SELECT *, 0.0 AS w_indeterminate, greatest(h2 + 2*h6 + h7 - 2*h4, 0)::DOUBLE AS w_liquidations, greatest(h3 - 2*h4, 0)::DOUBLE AS w_mmclosing, greatest(h1 + 2*h5 + 2*h8 - 2*h4, 0)::DOUBLE AS w_manipulation, (2*h4 + 2*h9)::DOUBLE AS w_momentum FROM hits),
sums AS (SELECT *, w_liquidations + w_mmclosing + w_manipulation + w_momentum AS total FROM votes), scaled AS (SELECT *, greatest(sqrt(14.0), total) AS bottom FROM sums),
p AS (SELECT *, greatest(1.0 - total / bottom, 0.0) AS p_indeterminate, w_liquidations / bottom AS p_liquidations, w_mmclosing / bottom AS p_mmclosing, w_manipulation / bottom AS p_manipulation, w_momentum / bottom AS p_momentum FROM scaled)"""


def _votes_sql() -> str:
    return _VOTES


_P = [f"p_{c.lower()}" for c in strategy.CATEGORIES]


@query(_votes_sql() + f" SELECT sym, ts_close, {', '.join(f'round({p}, 6) AS {p}' for p in _P)} FROM p")
def classify_votes(spark, sf_dir):
    return strategy.classify(_situation(spark, sf_dir)).select("sym", "ts_close", *[r6(p).alias(p) for p in _P])


_BEST = "CASE " + " ".join(f"WHEN {p} >= greatest({', '.join(_P)}) THEN '{c}'" for p, c in reversed(list(zip(_P, strategy.CATEGORIES, strict=True)))) + " END"


@query(_votes_sql() + f", o AS (SELECT sym, ts_close, {_BEST} AS category, greatest({', '.join(_P)}) AS certainty FROM p) SELECT sym, ts_close, category, CASE WHEN category IN ('Liquidations', 'Manipulation') THEN 'Short' WHEN category = 'Momentum' THEN 'Long' ELSE 'Flat' END AS direction, round(20000.0*certainty*certainty, 4) AS size FROM o")
def decision(spark, sf_dir):
    rows = strategy.decide(strategy.modal(strategy.classify(_situation(spark, sf_dir))))
    return rows.select("sym", "ts_close", "category", "direction", F.round("size", 4).alias("size"))


@query(f"""WITH {_t('trades')}, x AS (SELECT sym, seq, price_raw/100.0 AS p, max(price_raw/100.0) OVER (PARTITION BY sym ORDER BY seq) AS e FROM trades),
c AS (SELECT *, max(least(greatest((e - p)/10.0, 0.0), 1.0)) OVER (PARTITION BY sym ORDER BY seq) AS c FROM x)
SELECT sym, seq, round(1 - 0.33*c, 6) AS multiplier, round(1 - c, 6) AS fraction, CASE WHEN c < 1 THEN round(e - 10.0, 6) END AS stop FROM c""")  # fmt: skip
def trailing_stop(spark, sf_dir):
    prices = lanes.trades(spark, sf_dir).select("sym", "seq", (F.col("price_raw") / 100.0).alias("price"))
    return strategy.trailing_stop(prices, 10.0, 0.33).select("sym", "seq", *[r6(c).alias(c) for c in ("multiplier", "fraction", "stop")])


@query(f"WITH {_t('trades')}, x AS (SELECT *, (row_number() OVER (PARTITION BY sym ORDER BY seq) - 1) // 26 AS chunk FROM trades) SELECT sym, chunk, arg_min(price_raw, seq) AS open, max(price_raw) AS high, min(price_raw) AS low, arg_max(price_raw, seq) AS close FROM x GROUP BY sym, chunk")
def mock_ohlc_26(spark, sf_dir):
    return series.mock_ohlc(lanes.trades(spark, sf_dir), 26)


_X = ("a", "b")
_KERNEL = E.square(E.var(0) + E.var(1)) + E.abs_(E.var(0) - 1.0) / E.select(E.gt(E.var(1), 3.0), E.var(1), E.absent) + E.max_(E.var(0), E.or_(E.sqrt(E.var(1) - 2.0), 0.0))
#: Values are compared in sevenths: a decimal would often lie on the edge that rounding cuts at.
_AB = "SELECT seq, price_raw/100.0 AS a, CAST(qty_raw AS DOUBLE) AS b FROM trades"


def _ab(spark, sf_dir) -> DataFrame:
    return lanes.trades(spark, sf_dir).select("seq", (F.col("price_raw") / 100.0).alias("a"), F.col("qty_raw").cast("double").alias("b"))


@query(f"WITH {_t('trades')}, x AS ({_AB}) SELECT seq, round(((a+b)*(a+b) + abs(a-1)/CASE WHEN b > 3 THEN b END + greatest(a, coalesce(CASE WHEN b >= 2 THEN sqrt(b-2) END, 0)))/7.0, 6) AS value FROM x")
def expr_eval(spark, sf_dir):
    return _ab(spark, sf_dir).select("seq", r6(E.to_column(_KERNEL, [F.col(c) for c in _X]) / 7.0).alias("value"))


@query(f"""WITH {_t('trades')}, x AS ({_AB}), y AS (SELECT *, CASE WHEN b >= 2 THEN sqrt(b-2) END AS s FROM x)
SELECT seq, round((2*(a+b) + CASE WHEN a > 1 THEN 1.0 WHEN a < 1 THEN -1.0 END / CASE WHEN b > 3 THEN b END + CASE WHEN coalesce(s, 0) < a THEN 1.0 ELSE 0.0 END)/7.0, 6) AS d_a,
 round((2*(a+b) - abs(a-1)/(CASE WHEN b > 3 THEN b*b END) + CASE WHEN coalesce(s, 0) < a THEN 0.0 WHEN s IS NULL THEN 0.0 WHEN s = 0 THEN NULL ELSE 1/(2*s) END)/7.0, 6) AS d_b FROM y""")  # fmt: skip
def expr_grad(spark, sf_dir):
    d = [E.to_column(E.simplify(E.diff(_KERNEL, i)), [F.col(c) for c in _X]) for i in (0, 1)]
    return _ab(spark, sf_dir).select("seq", r6(d[0] / 7.0).alias("d_a"), r6(d[1] / 7.0).alias("d_b"))


@query("SELECT event_id, CAST(CAST(round(value, 2) AS DECIMAL(18,2)) * 10000 AS BIGINT) AS raw FROM events")
def precision_parse(spark, sf_dir):
    text = F.round("value", 2).cast("decimal(18,2)").cast("string")
    return lanes.events(spark, sf_dir).select("event_id", raw(text, 4).alias("raw"))


@query("SELECT event_id, upper(event_type) AS base, CASE WHEN event_id % 2 = 0 THEN 'USDT' ELSE 'USD' END AS quote FROM events")
def pair_parse(spark, sf_dir):
    text = F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit(" - usdt"))).otherwise(F.concat("event_type", F.lit("_USD")))
    base, quote = pair(text)
    return lanes.events(spark, sf_dir).select("event_id", base.alias("base"), quote.alias("quote"))


_LATCH = f"""{_t('trades')}, t AS (SELECT sym, seq, price_raw > 9000 AS trigger, row_number() OVER (PARTITION BY sym ORDER BY seq) AS i FROM trades),
w AS (SELECT sym, i, seq, CASE WHEN trigger THEN 1 ELSE 0 END AS n FROM t WHERE i = 1 UNION ALL
 SELECT t.sym, t.i, t.seq, CASE WHEN w.n BETWEEN 1 AND 4 THEN w.n + 1 WHEN t.trigger THEN 1 ELSE 0 END FROM w JOIN t ON t.sym = w.sym AND t.i = w.i + 1)"""


@query(f"WITH RECURSIVE {_LATCH} SELECT sym, seq, n > 0 AS armed, CAST(n AS BIGINT) AS n, n >= 5 AS done FROM w")
def latch(spark, sf_dir):
    return control.latch(lanes.trades(spark, sf_dir).select("sym", "seq", (F.col("price_raw") > 9000).alias("trigger")), 5)


_CHANGE_OF_4 = E.select(E.gt(E.abs_(E.var(0)), 0.0), (E.var(3) - E.var(0)) / E.var(0) * 100.0, E.absent)


@query(f"""WITH {_t('trades')}, {_bars('b', HOUR)}, x AS (SELECT sym, ts_close, CAST(close AS DOUBLE) AS z, CAST(lag(close, 3) OVER (PARTITION BY sym ORDER BY ts_close) AS DOUBLE) AS a, lag(close, 2) OVER (PARTITION BY sym ORDER BY ts_close) AS k FROM b)
SELECT sym, ts_close, round((z - a)/a*100.0, 6) AS value, round(-z/(a*a)*100.0*1000.0, 6) AS d_oldest, round(100.0/a*1000.0, 6) AS d_newest FROM x""")  # fmt: skip
def jacobian_block(spark, sf_dir):
    rows = observe.block(_b(spark, sf_dir).withColumn("close", F.col("close").cast("double")), _CHANGE_OF_4, "close", 4)
    at = lambda i: F.round(F.get("jac", F.lit(i)) * 1000.0, 6)
    return rows.select("sym", "ts_close", r6("value").alias("value"), at(0).alias("d_oldest"), at(3).alias("d_newest"))


@query(f"""WITH {_t('trades')}, {_bars('b', HOUR)}, {_momentum('m', 'b', 25)}, {_ROLLING}
SELECT 'momentum' AS node, count(momentum) AS fires, count(*) - count(momentum) AS skips FROM m UNION ALL SELECT 'rolling_vol', count(rolling_vol), count(*) - count(rolling_vol) FROM v""")  # fmt: skip
def fires_census(spark, sf_dir):
    b = _b(spark, sf_dir)
    return observe.census({"momentum": (series.momentum(b, 25), "momentum"), "rolling_vol": (series.rolling_vol(b, 24), "rolling_vol")})


def messages(deltas: DataFrame) -> DataFrame:
    """Venue messages of five changes each; each twentieth is a snapshot, each seventh follows a gap."""
    rows = series.numbered(deltas, series.by_number(), "n").withColumn("m", F.floor(F.col("n") / 5))
    level = F.struct("seq", "side", "price_raw", "qty_raw")
    got = rows.groupBy("sym", "m").agg(F.max("ts").alias("ts"), F.max("ts").alias("recv"), F.sort_array(F.collect_list(level)).alias("levels"))
    return got.select("sym", "m", "ts", "recv", (F.col("m") % 20 == 0).alias("snapshot"), (F.col("m") % 7 == 0).alias("gapped"), F.transform("levels", lambda x: F.struct(x["side"].alias("side"), x["price_raw"].alias("price_raw"), x["qty_raw"].alias("qty_raw"))).alias("levels"))


@query()
def shadow_book(spark, sf_dir):
    return shadow.reconcile(messages(lanes.deltas(spark, sf_dir)), DAY, ties=("m",))


def strategy_graph() -> Graph:
    """A small strategy as a declared graph: what it builds is what its outputs need."""

    @node("trades")
    def bars_1h(t):
        return bars(t, HOUR)

    @node("trades")
    def bars_4h(t):
        return bars(t, H4)

    @node(buffering("bars_4h", elems(13)))
    def sharpe(b):
        return series.momentum(b, 13)

    @node(buffering("bars_1h", elems(24)))
    def volume(b):
        return series.rolling_vol(b, 24)

    @node("bars_1h", sampling_of("sharpe"))
    def screener(b, m):
        return sampling.sample(b, "emit_seq", {"momentum": (m, "emit_seq", "momentum")}).withColumn("passes", control.decides(F.col("momentum") > 5.0))

    @node(gating("screener"), "volume")
    def hot_volume(gate, v):
        return v.join(gate.where("passes").select("sym", "ts_close"), ["sym", "ts_close"], "left_semi")

    return Graph(roots=("trades", "deltas"), nodes=(bars_1h, bars_4h, sharpe, volume, screener, hot_volume), outputs=("hot_volume",))


@query(f"WITH {_t('trades')}, {_SAMPLED}, {_ROLLING} SELECT v.sym, v.ts_close, round(v.rolling_vol, 4) AS rolling_vol FROM v JOIN y ON v.sym = y.sym AND v.ts_close = y.ts_close WHERE y.momentum > 5.0")
def graph_hot_volume(spark, sf_dir):
    out = strategy_graph().build({"trades": lambda: lanes.trades(spark, sf_dir), "deltas": lambda: lanes.deltas(spark, sf_dir)})["hot_volume"]
    return out.select("sym", "ts_close", F.round("rolling_vol", 4).alias("rolling_vol"))


_LEVELS = "SELECT seq, price_raw/1000.0 AS a, CAST(qty_raw AS DOUBLE)/10.0 AS b, CASE WHEN qty_raw > 50 THEN price_raw/1000.0 END AS c FROM trades"
_FUNCTIONS = {
    "mul": (E.var(0) * E.var(1), "a*b"),
    "neg": (-E.var(0), "-a"),
    "exp": (E.exp(-E.var(1)), "exp(-b)"),
    "present": (E.present(E.var(2)), "CASE WHEN c IS NULL THEN 0.0 ELSE 1.0 END"),
    "powi": (E.powi(E.var(0), 3), "a*a*a"),
    "powi_negative": (E.powi(E.var(1), -2), "CASE WHEN b <> 0 THEN 1.0/(b*b) END"),
    "min": (E.min_(E.var(0), E.var(2)), "least(a, c)"),
    "max": (E.max_(E.var(1), E.var(2)), "greatest(b, c)"),
    "lt": (E.lt(E.var(0), E.var(1)), "CASE WHEN a < b THEN 1.0 ELSE 0.0 END"),
    "sum": (E.sum_(E.var(0), E.var(1), 2.5, E.var(2)), "a + b + 2.5 + c"),
    "or": (E.or_(E.var(2), -1.0), "coalesce(c, -1.0)"),
    "absent": (E.var(0) + E.absent, "CAST(NULL AS DOUBLE)"),
    "diff_mul": (E.simplify(E.diff(E.var(0) * E.square(E.var(1)), 1)), "2*a*b"),
    "diff_exp": (E.simplify(E.diff(E.exp(2.0 * E.var(1) / 10.0), 1)), "exp(2.0*b/10.0)*0.2"),
    "diff_powi": (E.simplify(E.diff(E.powi(E.var(0), 3), 0)), "3*a*a"),
    "diff_min": (E.simplify(E.diff(E.min_(E.var(0), E.var(1)), 0)), "CASE WHEN a < b THEN 1.0 ELSE 0.0 END"),
}


@query(f"WITH {_t('trades')}, x AS ({_LEVELS}) SELECT seq, {', '.join(f'round(({sql})/7.0, 6) AS {name}_' for name, (_, sql) in _FUNCTIONS.items())} FROM x")
def expr_functions(spark, sf_dir):
    """Each function of the algebra, as slots of one struct."""
    t = lanes.trades(spark, sf_dir)
    env = [(F.col("price_raw") / 1000.0), F.col("qty_raw").cast("double") / 10.0, F.when(F.col("qty_raw") > 50, F.col("price_raw") / 1000.0)]
    slots = t.select("seq", E.to_struct({name: e for name, (e, _) in _FUNCTIONS.items()}, env).alias("x"))
    return slots.select("seq", *[r6(F.col("x")[name] / 7.0).alias(f"{name}_") for name in _FUNCTIONS])


@query(f"""WITH {_t('trades')}, s AS (SELECT sym, seq, price_raw/1000.0 AS x, sum(price_raw/1000.0*price_raw/1000.0) OVER (PARTITION BY sym ORDER BY seq) AS s FROM trades)
SELECT sym, seq, round(sqrt(s)/7.0, 6) AS value, round(x/sqrt(s)/7.0, 6) AS slope FROM s""")  # fmt: skip
def fold_jacobian(spark, sf_dir):
    """The slope of a fold's value, the root of a running sum of squares, by its input: through the stepped state."""
    x = F.col("price_raw") / 1000.0
    rows = series.running_sum(lanes.trades(spark, sf_dir).select("sym", "seq", "ts", "price_raw"), x * x, series.bucket("ts", DAY), "s")
    value, step = E.sqrt(E.var(1)), E.var(1) + E.square(E.var(0))
    slope = observe.fold_jacobian(E.diff(value, 0), [E.diff(value, 1)], [E.diff(step, 0)])
    env = [x, F.col("s")]
    return rows.select("sym", "seq", r6(E.to_column(value, env) / 7.0).alias("value"), r6(E.to_column(slope, env) / 7.0).alias("slope"))


@query(_weave_sql(HOUR) + " SELECT sym, seq, count(*) OVER (PARTITION BY sym, step_id) AS fresh, count(*) OVER (PARTITION BY sym ORDER BY step_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM w WHERE lane = 'trades'")
def hist_fresh_past(spark, sf_dir):
    rows = _woven(spark, sf_dir, HOUR).where("lane = 'trades'")
    return rows.select("sym", "seq", F.count(F.lit(1)).over(fresh()).alias("fresh"), F.count(F.lit(1)).over(past()).alias("past"))


@query(f"WITH {_t('trades')}, {_bars('b', HOUR)} SELECT sym, ts_close, lag(close, 3) OVER (PARTITION BY sym ORDER BY ts_close) AS close_3 FROM b")
def lagged_close(spark, sf_dir):
    return _b(spark, sf_dir).select("sym", "ts_close", lagged("close", 3).alias("close_3"))


@query(_weave_sql(HOUR) + ", x AS (SELECT w.sym, w.step_id, t.price_raw > 9000 AS ends FROM w JOIN trades t ON w.sym = t.sym AND w.seq = t.seq WHERE w.lane = 'trades') SELECT sym, step_id, bool_or(ends) AS ended FROM x GROUP BY sym, step_id")
def episode_terminal(spark, sf_dir):
    rows = _woven(spark, sf_dir, HOUR).where("lane = 'trades'").join(lanes.trades(spark, sf_dir).select("sym", "seq", "price_raw"), ["sym", "seq"])
    return control.terminal(rows, F.col("price_raw") > 9000)


@query(f"WITH {_t('trades')}, x AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY seq) AS i FROM trades) SELECT sym, seq, CASE WHEN i >= 4 THEN CAST(sum(price_raw) OVER (PARTITION BY sym ORDER BY seq ROWS 3 PRECEDING) AS BIGINT) END AS total FROM x")
def trailing_in_blocks(spark, sf_dir):
    """A window of four trades, by differences of running sums that are taken in blocks."""
    t = series.numbered(lanes.trades(spark, sf_dir).select("sym", "seq", "ts", "price_raw"), series.bucket("ts", DAY), "i")
    t = series.running_sum(t, F.col("price_raw"), series.bucket("ts", DAY), "s")
    return t.select("sym", "seq", F.when(F.col("i") >= 3, F.col("s") - F.lag("s", 4, 0).over(by("seq"))).alias("total"))


def clocked_graph() -> Graph:
    """Buys, at most one an hour: the gate is applied first, so a sale consumes no period."""

    @node("trades")
    def buys(t):
        return t.select("sym", "seq", (F.col("side") == 0).alias("passes"))

    @node(gating("buys", on=("sym", "seq")), buffering("trades", elems(1)), clock=HOUR)
    def first_buys(t):
        return t

    return Graph(roots=("trades", "deltas"), nodes=(buys, first_buys), outputs=("first_buys",))


@query(ORACLE_SQL["clocked_ticks"])
def graph_clocked(spark, sf_dir):
    out = clocked_graph().build({"trades": lambda: lanes.trades(spark, sf_dir), "deltas": lambda: 1 / 0})["first_buys"]
    return out.select("sym", "seq", "ts")


def latched_graph() -> Graph:
    """Trades while a latch stands that a high price arms and its own fifth step ends."""

    @node("trades")
    def high(t):
        return t.select("sym", "seq", (F.col("price_raw") > 9000).alias("trigger"))

    @node("high", latch=True, cut="five")
    def armed(h):
        return control.latch(h, 5)

    @node(gating("armed", on=("sym", "seq"), passes="armed"), "trades")
    def five(t):
        return t

    return Graph(roots=("trades",), nodes=(high, armed, five), outputs=("five",))


@query(f"WITH RECURSIVE {_LATCH} SELECT w.sym, w.seq, trades.price_raw FROM w JOIN trades USING (sym, seq) WHERE n > 0")
def graph_latched(spark, sf_dir):
    out = latched_graph().build({"trades": lambda: lanes.trades(spark, sf_dir)})["five"]
    return out.select("sym", "seq", "price_raw")


def simple_graph() -> Graph:
    """Running volume, the slope of prices by flows, rolling volume and a signal over their last values."""

    @node("trades")
    def bars_1h(t):
        return bars(t, HOUR)

    @node(folding("trades", UNBOUNDED))
    def volume_delta(t):
        return series.cvd(t, DAY).withColumn("cvd", F.col("cvd") / 100.0)

    @node(buffering("bars_1h", elems(24)))
    def slope(b):
        return series.kyle_lambda(b, 24).withColumnRenamed("kyle_lambda", "lam")

    @node(buffering("bars_1h", elems(24)))
    def volume(b):
        return series.rolling_vol(b, 24).withColumnRenamed("rolling_vol", "vol")

    @node("volume_delta", sampling_of("slope"), sampling_of("volume"))
    def signal_(c, lam, vol):
        rows = sampling.sample(c, "seq", {"lam": (lam, "emit_seq", "lam"), "vol": (vol, "emit_seq", "vol")}, block=4096)
        body = 1e6 * E.var(0) + 1e-6 * (E.var(1) - E.var(2))
        return rows.select("sym", "seq", E.to_column(body, [F.col("lam"), F.col("cvd"), F.col("vol")]).alias("signal"))

    return Graph(roots=("trades", "deltas", "anchors", "oi", "mc"), nodes=(bars_1h, volume_delta, slope, volume, signal_), outputs=("signal_", "bars_1h"))


@query(ORACLE_SQL["signal"])
def graph_simple_signal(spark, sf_dir):
    out = simple_graph().build({"trades": lambda: lanes.trades(spark, sf_dir)})["signal_"]
    return out.select("sym", "seq", F.round("signal", 3).alias("signal"))


def live_graph() -> Graph:
    """What a live view shows: running sums of trades and of book changes, the book's top, and bars."""

    @node(folding("trades", UNBOUNDED))
    def volume_delta(t):
        return series.cvd(t, DAY)

    @node(folding("deltas", UNBOUNDED))
    def flow(d):
        return series.book_flow(d, DAY)

    @node("deltas", anchored=True, fidelity="opaque")
    def tops(d):
        return book.top(d, DAY)

    @node("trades")
    def bars_1h(t):
        return bars(t, HOUR)

    return Graph(roots=("trades", "deltas", "anchors", "oi", "mc"), nodes=(volume_delta, flow, tops, bars_1h), outputs=("volume_delta", "flow", "tops", "bars_1h"))


@query(f"WITH {_t('trades')}, {_t('deltas')}, {_bars('b', HOUR)} SELECT 'volume_delta' AS node, count(*) AS fires, 0 AS skips FROM trades UNION ALL SELECT 'flow', count(*), 0 FROM deltas WHERE kind = 0 UNION ALL SELECT 'bars_1h', count(*), 0 FROM b")
def graph_live_census(spark, sf_dir):
    feed = {"trades": lambda: lanes.trades(spark, sf_dir), "deltas": lambda: lanes.deltas(spark, sf_dir)}
    return live_graph().census(feed, {"volume_delta": "cvd", "flow": "book_flow", "bars_1h": "close"})


def spl_graph() -> Graph:
    """The whole strategy over five lanes: bars, the relative strength index, and the intents of decided episodes."""

    @node("trades")
    def bars_1h(t):
        return bars(t, HOUR)

    @node("trades")
    def bars_4h(t):
        return bars(t, H4)

    @node("trades")
    def bars_1d(t):
        return bars(t, DAY)

    @node("deltas", anchored=True, fidelity="opaque")
    def tops(d):
        return book.top(d, DAY)

    @node(folding("bars_4h", UNBOUNDED))
    def strength(b):
        return recurrences.rsi(b)

    @node(folding("bars_1h", UNBOUNDED))
    def range_(b):
        return recurrences.atr(b).withColumn("atr", F.col("atr") / 100.0)

    @node(buffering("bars_4h", elems(13)))
    def sharpe(b):
        return series.momentum(b, 13)

    @node(buffering("bars_1h", over(H4)))
    def change_3m(b):
        return series.change(b, H4).withColumnRenamed("change", "change_3m")

    @node(buffering("bars_1h", over(DAY)))
    def change_1d(b):
        return series.change(b, DAY).withColumnRenamed("change", "change_1d")

    @node("bars_1d")
    def vol_1h(b):
        return series.vol_usd(b).withColumnRenamed("vol_usd", "vol_1h")

    @node("tops")
    def book_state(t):
        return book.measures(t)

    @node("bars_1h", *[sampling_of(x) for x in ("sharpe", "mc", "oi", "change_3m", "change_1d", "vol_1h", "book_state")], fidelity="partial")
    def decision_(b, m, mc, oi, c3, c1, v, s):
        b = b.withColumn("vol_1m", F.col("vol") * F.col("close") / 100.0).select("sym", "ts_close", "emit_seq", "vol_1m")
        oi = oi.withColumn("oi_value", F.col("oi") * 1000.0)
        levels = {"momentum": (m, "emit_seq", "momentum"), "market_cap": (mc, "at", "market_cap"), "oi_value": (oi, "seq", "oi_value"), "change_3m": (c3, "emit_seq", "change_3m"), "change_1d": (c1, "emit_seq", "change_1d"), "vol_1h": (v, "emit_seq", "vol_1h"), "spread": (s, "seq", "spread"), "imbalance": (s, "seq", "imbalance")}
        return strategy.decide(strategy.modal(strategy.classify(sampling.sample(b, "emit_seq", levels))))

    @node("tops", "decision_", sampling_of("range_"), "trades", fidelity="opaque")
    def intents_(t, d, a, trades):
        return strategy.intents(ticks_of(t, d, a, trades))

    return Graph(
        roots=("trades", "deltas", "anchors", "oi", "mc"), outputs=("bars_1h", "intents_", "strength"),
        nodes=(bars_1h, bars_4h, bars_1d, tops, strength, range_, sharpe, change_3m, change_1d, vol_1h, book_state, decision_, intents_),
    )


def ticks_of(tops: DataFrame, decided: DataFrame, ranges: DataFrame, trades: DataFrame) -> DataFrame:
    """Ticks of the strategy: book mids, decisions where hourly bars close, and the sampled range."""
    rows = decided.select("sym", F.col("emit_seq").alias("seq"), "direction", "size")
    ticks = book.mid(tops).join(rows, ["sym", "seq"], "full_outer")
    ts = trades.select("sym", "seq", F.col("ts").alias("at"))
    ticks = ticks.join(ts, ["sym", "seq"], "left").withColumn("ts", F.coalesce("ts", "at")).drop("at")
    return sampling.sample(ticks, "seq", {"atr": (ranges, "emit_seq", "atr")})


def _spl_feed(spark, sf_dir) -> dict:
    t = lanes.trades(spark, sf_dir)
    days = t.groupBy("sym", series.bucket("ts", DAY).alias("ts")).agg(F.min("seq").alias("at"))
    return {"trades": lambda: t, "deltas": lambda: lanes.deltas(spark, sf_dir), "oi": lambda: lanes.open_interest(spark, sf_dir), "mc": lambda: lanes.market_cap(spark, sf_dir).join(days, ["sym", "ts"]), "anchors": lambda: None}


def _written_once(spark):
    """Book tops are folded once for all that read them, and bars and decisions with them."""

    def share(name: str, df: DataFrame) -> DataFrame:
        if name not in ("tops",):
            return df
        at = lanes.scratch(spark, name)
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    return share


@query(ORACLE_SQL["rsi"])
def graph_spl_rsi(spark, sf_dir):
    out = spl_graph().build(_spl_feed(spark, sf_dir))["strength"]
    return out.select("sym", "ts_close", r6("rsi").alias("rsi"), r6("smoothed").alias("smoothed"))


@query()
def intents(spark, sf_dir):
    return spl_graph().build(_spl_feed(spark, sf_dir), share=_written_once(spark))["intents_"]


@query()
def episodes(spark, sf_dir):
    return strategy.digest(intents(spark, sf_dir))


@query("""SELECT * FROM (VALUES ('trades', 0, 'pin:flow'), ('bars_1h', 1, 'pin:output'), ('deltas', 2, 'pin:flow'), ('tops', 3, 'pin:flow'), ('bars_4h', 4, 'pin:retention'), ('sharpe', 5, 'pin:retention'), ('mc', 6, 'pin:retention'), ('oi', 7, 'pin:retention'),
 ('change_3m', 8, 'pin:retention'), ('change_1d', 9, 'pin:retention'), ('bars_1d', 10, 'pin:flow'), ('vol_1h', 11, 'pin:retention'), ('book_state', 12, 'pin:retention'), ('decision_', 13, 'pin:flow'), ('range_', 14, 'pin:fold'), ('intents_', 15, 'pin:output'), ('strength', 16, 'pin:output')) AS t(node, place, need)""")
def graph_demand(spark, sf_dir):
    """The strategy's nodes in order, and why each must run."""
    g = spl_graph()
    return spark.createDataFrame([(n, i, str(g.demand[n])) for i, n in enumerate(g.order)], "node string, place int, need string")


#: Rows that a file of a feed holds, about.
FEED_ROWS = 2_000_000


def _streamed(spark, rows: DataFrame, run, order: str = "seq", files: int = 3) -> DataFrame:
    """``run`` of ``rows`` as a stream of files that come in order, as the table that it leaves.

    A file has about ``FEED_ROWS`` rows at most, so what comes at once doesn't grow with the table. Rows are cut by ranges
    of ``order`` in one pass; each file is then moved into the feed by a task that reads it alone.
    """
    staged, at, out, ck = (lanes.scratch(spark, n) for n in ("staged", "feed", "live", "checkpoint"))
    files = max(files, -(-rows.count() // FEED_ROWS))
    rows.repartitionByRange(files, order, "sym").write.mode("append").parquet(staged)
    for part in sorted(spark.read.schema(rows.schema).parquet(staged).inputFiles()):  # named by their range's number
        spark.read.schema(rows.schema).parquet(part).coalesce(1).write.mode("append").parquet(at)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(at)
    made = run(stream)
    if isinstance(made, DataFrame):
        q = made.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(made.schema).parquet(out)
    q = stream.writeStream.foreachBatch(made).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows


_LANE = ("sym", "seq", "ts", "side", "price_raw", "qty_raw")


@query(f"WITH {_t('trades')}, {_bars('b', HOUR)} SELECT {', '.join(_BAR_COLUMNS)} FROM b")
def live_bars(spark, sf_dir):
    return _streamed(spark, lanes.trades(spark, sf_dir).select(*_LANE), lambda s: live.bars(s, HOUR)).select(*_BAR_COLUMNS)


@query(f"WITH RECURSIVE {_LATCH} SELECT sym, seq, n > 0 AS armed, CAST(n AS BIGINT) AS n, n >= 5 AS done FROM w")
def live_latch(spark, sf_dir):
    return _streamed(spark, lanes.trades(spark, sf_dir).select("sym", "seq", (F.col("price_raw") > 9000).alias("trigger")), lambda s: live.latch(s, 5))


@query(ORACLE_SQL["trailing_in_blocks"])
def live_trailing(spark, sf_dir):
    return _streamed(spark, lanes.trades(spark, sf_dir).select("sym", "seq", "price_raw"), lambda s: live.trailing_sum(s, "price_raw", 4))


@query(f"WITH {_t('trades')}, x AS (SELECT *, lag(seq) OVER (ORDER BY seq) AS b FROM trades) SELECT sym, count(*) AS n, count(DISTINCT seq) AS stamps, CAST(sum(price_raw) AS BIGINT) AS prices FROM x GROUP BY sym")
def live_recorded(spark, sf_dir):
    """What live input records is what a replay reads, each row with a stamp of its own."""
    catalog, t = Catalog(spark, lanes.scratch(spark, "catalog")), lanes.trades(spark, sf_dir)
    rows = t.select("sym", F.col("ts").alias("ts_venue_exec"), F.lit(None).cast("long").alias("ts_venue_send"), F.lit(None).cast("long").alias("ts_local_recv"), F.col("seq").alias("monotonic_seq"), "side", "price_raw", "qty_raw")
    _streamed(spark, rows, lambda s: live.Live("trades", catalog, clock=lambda: 1), order="monotonic_seq")
    back = _all(lambda s: catalog.read("trades", s, 0, 1 << 62))
    stamps = back.groupBy("sym", "ts_local_recv").agg(F.count(F.lit(1)).alias("n"), F.sum("price_raw").alias("prices"))
    return stamps.groupBy("sym").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("stamps"), F.sum("prices").alias("prices"))
