import gzip

import numpy as np
import pandas as pd
import pytest

from tidewheel.functions.precision import decoded, pair, parse_pair, raw, realigned, usd
from tidewheel.operators import book, control, recurrences, series, shadow, strategy
from tidewheel.plans import graph, reach, weave
from tidewheel.plans.graph import Graph, buffering, folding, gating, node, sampling
from tidewheel.sources import lanes
from tidewheel.sources.lanes import Catalog, CatalogError

S = 1_000_000_000

# Closes and RSI-14 of a published worked example.
CLOSES = [44.3389, 44.0902, 44.1497, 43.6124, 44.3278, 44.8264, 45.0955, 45.4245, 45.8433, 46.0826, 45.8931, 46.0328, 45.6140, 46.2820, 46.2820, 46.0028, 46.0328, 46.4116, 46.2222, 45.6439, 46.2122, 46.2521, 45.7137, 46.4515, 45.7835, 45.3548, 44.0288, 44.1783, 44.2181, 44.5672, 43.4205, 42.6628, 43.1314]


def test_rsi_of_the_worked_example():
    r = recurrences.relative_strength(*recurrences.gains_losses(np.array(CLOSES), 14))
    r = r[~np.isnan(r)]
    assert len(r) == 19 and abs(r[0] - 70.5328) < 5e-4 and abs(r[-1] - 37.7730) < 5e-4


def test_warm_up():
    close = 100 + 5 * np.sin(0.7 * np.arange(12))
    gain, _ = recurrences.gains_losses(close, 3)
    r = recurrences.relative_strength(gain, _)
    assert np.flatnonzero(~np.isnan(gain))[0] == 3
    assert np.flatnonzero(~np.isnan(recurrences.ema(r, 2)))[0] == 4


def test_windows(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, i, t * S, float(t)) for i, t in enumerate((0, 3, 6, 12, 40))], "sym int, i long, ts_close long, v double")
    w, whole = reach.trailing(reach.over(10 * S))
    got = rows.select("i", F.when(whole, F.collect_list("v").over(w)).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in got] == [None, None, None, [3, 6, 12], [40]]
    w, whole = reach.trailing(reach.elems(3))
    assert [r["x"] for r in rows.select("i", F.when(whole, F.sum("v").over(w)).alias("x")).orderBy("i").collect()] == [None, None, 9, 21, 58]
    assert reach.over(5).serves(reach.elems(9)) and not reach.elems(2).serves(reach.elems(3)) and reach.elems(2).join(reach.UNBOUNDED) == reach.UNBOUNDED


def test_moved_and_clock(spark):
    from pyspark.sql import functions as F

    ticks = [None, 1.2, 1.7, 2.3, None, -5.0, -6.0, 2.0]
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(ticks)], "sym int, seq long, v double")
    rows = rows.withColumn("fired", F.col("v").isNotNull()).withColumn("level", F.when(F.col("v") >= 0, F.floor("v")))
    got = control.moved(control.standing(rows, "level", "fired"), "level").orderBy("seq").collect()
    assert [(r["level"], r["moved"]) for r in got] == [(None, False), (1, True), (1, False), (2, True), (2, False), (None, True), (None, False), (2, True)]
    times = spark.createDataFrame([(0, i, (55 + i * 10) * S) for i in range(13)], "sym int, seq long, ts long")
    assert [r["ts"] // S for r in control.clocked(times, 60 * S).orderBy("seq").collect()] == [55, 65, 125]
    assert [r["ts"] // S for r in control.clocked(times.where("ts <> 65000000000"), 60 * S).orderBy("seq").collect()] == [55, 75, 125]


def test_latch(spark):
    pulses = [False, True, False, True, False, True]
    rows = spark.createDataFrame([(0, i, p) for i, p in enumerate(pulses)], "sym int, seq long, trigger boolean")
    got = control.latch(rows, 3).orderBy("seq").collect()
    assert [(r["n"], r["done"]) for r in got] == [(0, False), (1, False), (2, False), (3, True), (0, False), (1, False)]


def test_trailing_stop(spark):
    from pyspark.sql import functions as F

    for buy, prices in ((True, [100, 95, 100, 110, 100, 50]), (False, [100, 105, 100, 90, 100, 150])):
        rows = spark.createDataFrame([(0, i, float(p)) for i, p in enumerate(prices)], "sym int, seq long, price double")
        got = [r["multiplier"] for r in strategy.trailing_stop(rows, 10.0, 0.33, buy).orderBy("seq").collect()]
        assert np.allclose(got, [1, 0.835, 0.835, 0.835, 0.67, 0.67])
        cut = [r["multiplier"] for r in strategy.trailing_stop(rows, 10.0, 0.33, buy, block=F.floor(F.col("seq") / 2)).orderBy("seq").collect()]
        assert np.allclose(cut, got)
        position = strategy.Position(strategy.Knobs(trail_pct=0.1, sl_x=1e9, tp_x=1e9))
        position.want("Long" if buy else "Short", 1.0)
        assert np.allclose([position.tick(0, float(p), 1.0)[3] for p in prices], got)


def test_episode_invariants():
    r = np.random.default_rng(1)
    n = 400
    ticks = pd.DataFrame({"sym": 0, "seq": range(n), "ts": np.arange(n) * 20 * S, "direction": [["Long", "Short", "Flat", None][i] for i in r.integers(0, 4, n)], "size": 100.0, "mid": 100 + r.normal(0, 1, n).cumsum(), "atr": 1.0})
    out = pd.DataFrame(strategy.walk(ticks), columns=strategy._COLUMNS)
    assert len(out) > 50 and out["ts"].is_monotonic_increasing and out["terminal"].any()
    assert ((out["target_q"] >= 0) & (out["target_q"] <= out["base_q"])).all() and (out.loc[out["draining"], "target_q"] == 0).all()
    episode = out["terminal"].shift(fill_value=False).cumsum()
    assert (out.groupby(episode)["trail_fraction"].diff().dropna() <= 0).all()


def test_votes(spark):
    schema = "momentum double, market_cap double, oi_value double, change_3m double, change_1d double, spread double, imbalance double, vol_1m double, vol_1h double"
    rows = spark.createDataFrame([(None,) * 9, (4.0, 1e6, 2e6, None, None, 0.2, 0.6, None, None), (1.0, 1e9, None, None, None, None, None, 100.0, 60.0)], schema)
    got = strategy.decide(strategy.modal(strategy.classify(rows))).collect()
    assert [(r["category"], r["direction"]) for r in got] == [("Indeterminate", "Flat"), ("Manipulation", "Short"), ("Momentum", "Long")]
    assert got[0]["certainty"] == 1.0 and got[1]["certainty"] == 1.0
    for r in got:
        assert abs(sum(r[f"p_{c.lower()}"] for c in strategy.CATEGORIES) - 1) < 1e-12


def _deltas(seed, n, tick=S):
    r = np.random.default_rng(seed)
    return [(0, i, i * tick, int(r.integers(0, 2)), int(p), 0 if r.random() < 0.25 else int(r.integers(1, 99))) for i, p in enumerate(r.integers(90, 110, n), 1)]


def test_book_nets_equal_rows(spark):
    from pyspark.sql import functions as F

    rows = _deltas(7, 400)
    df = spark.createDataFrame(rows, "sym int, seq long, ts long, side int, price_raw long, qty_raw long")
    whole = {(r["side"], r["price_raw"]): r["qty_raw"] for r in book.state(df).collect()}
    by_net = book.net(df, 60 * S).withColumn("seq", F.col("period"))
    assert whole == {(r["side"], r["price_raw"]): r["qty_raw"] for r in book.state(by_net).collect()}
    folded = book.Sides()
    tops = {}
    for _, seq, _, *level in rows:
        folded.set(*level)
        b, a = folded.best(0), folded.best(1)
        tops[seq] = (b[0], a[0], folded.depth(0), folded.depth(1)) if b and a else (None,) * 4
    assert folded.levels() == whole
    for block in (37 * S, 10_000 * S):  # blocks with a carried book, and one block
        assert {r["seq"]: (r["bid"], r["ask"], r["bid_depth"], r["ask_depth"]) for r in book.top(df, block).collect()} == tops
    half, full = book.state(df, 200), book.state(df)
    carried = {(r["side"], r["price_raw"]): r["qty_raw"] for r in half.collect()}
    carried |= {(r["side"], r["price_raw"]): r["qty_raw"] for r in book.diff(half, full).collect()}
    assert {k: q for k, q in carried.items() if q} == whole
    shape = book.shape(full).first()
    assert shape["bid_prices"] == sorted(shape["bid_prices"], reverse=True) and shape["ask_prices"] == sorted(shape["ask_prices"])


def test_shadow_book():
    b = shadow.ShadowBook()
    assert b.ingest(True, False, [(0, 99, 5), (1, 101, 6)]) == []
    assert b.ingest(True, False, [(0, 99, 5), (1, 101, 6)]) == []
    assert b.ingest(False, False, [(0, 98, 1)]) == [(1, 0, 0, 98, 1)]
    assert b.ingest(False, True, [(0, 99, 0)]) == [(2, 1, 0, 99, 0)]
    assert b.ingest(True, False, [(0, 98, 2)]) == [(3, 1, 0, 98, 2), (4, 1, 1, 101, 0)]
    assert [b.checkpoint_due(t) for t in (0, 5, 60 * S, 61 * S)] == [True, False, True, False]


def test_weave_groups_runs(spark):
    lane = lambda name, rows: spark.createDataFrame([(0, s, t) for s, t in rows], "sym int, seq long, ts long").transform(lambda d: weave.arrivals(d, name, None))
    a, b = lane("trades", [(1, 1), (2, 2), (3, 12), (4, 30)]), lane("deltas", [(1, 2), (2, 13), (3, 14)])
    got = weave.weave([a, b]).orderBy("ord").collect()
    assert [(r["lane"], r["arrival"]) for r in got] == [("trades", 1), ("trades", 2), ("deltas", 2), ("trades", 12), ("deltas", 13), ("deltas", 14), ("trades", 30)]
    assert weave.steps(weave.weave([a, b], weave.ALL)).count() == 5
    assert weave.steps(weave.weave([a, b], 10)).orderBy("step_id").select("n").collect()[0]["n"] == 2
    from pyspark.sql import functions as F

    sim = spark.range(2000).select(weave.latency(F.col("id"), 3).alias("x")).toPandas()["x"]
    assert sim.min() >= 0 and abs((sim <= 25_000_000).mean() - 0.68) < 0.04


def test_out_of_order_trades_reopen_a_bar(spark):
    rows = [(0, i, t * S, 0, 10 + i, 1) for i, t in enumerate((1, 2, 61, 5, 62, 121))]
    t = spark.createDataFrame(rows, "sym int, seq long, ts long, side int, price_raw long, qty_raw long")
    assert [r["ts_close"] // S for r in series.bars_by_arrival(t, 60 * S).orderBy("emit_seq").collect()] == [60, 120, 60, 120]
    assert series.bars(t.where("seq <> 3"), 60 * S).count() == 2


def test_candles():
    assert recurrences.candles([], 60) == []
    assert recurrences.candles([(1.0, 5), (3.0, 50), (2.0, 66), (2.5, 100), (1.0, 130)], 60) == [(1, 3, 1, 3), (2, 2.5, 2, 2.5), (1, 1, 1, 1)]
    assert recurrences.candles([(1.0, 5), (1.0, 66)], 60) == [(1, 1, 1, 1)]


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    rows = spark.createDataFrame([(i * lanes.HOUR, None, None, i, 0, 100 + i, 5) for i in range(48)], lanes.LANES["trades"])
    assert c.listing("trades", "a") == [] and c.read("trades", "a", 0, 9).count() == 0
    assert c.write("trades", "a", rows.where("monotonic_seq < 30"), {"price": 2, "qty": 0})
    with pytest.raises(CatalogError):
        c.write("trades", "a", rows.where("monotonic_seq >= 29"))
    assert c.write("trades", "a", rows.where("monotonic_seq >= 30"), {"price": 2, "qty": 0}) and not c.write("trades", "a", rows.where("false"))
    got = c.read("trades", "a", 10 * lanes.HOUR, 40 * lanes.HOUR)
    assert got.count() == 31 and c.precision("trades", "a", 0, 48 * lanes.HOUR) == {"price": 2, "qty": 0}
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan
    c.write("trades", "b", rows.where("monotonic_seq < 5"), {"price": 3})
    c.write("trades", "b", rows.where("monotonic_seq > 5"), {"price": 2})
    with pytest.raises(CatalogError):
        c.read("trades", "b", 0, 48 * lanes.HOUR)
    anchors = spark.createDataFrame([(t, t, i, [99], [1], [101], [2]) for i, t in enumerate((0, 5 * lanes.MINUTE, 40 * lanes.MINUTE))], lanes.LANES["anchors"])
    c.write("anchors", "a", anchors)
    assert c.anchor("a", 10 * lanes.MINUTE).first()["monotonic_seq"] == 1 and c.anchor("a", 30 * lanes.MINUTE).count() == 0


def test_csv_and_parsers(spark, tmp_path):
    from pyspark.sql import functions as F

    p = tmp_path / "t.csv.gz"
    p.write_bytes(gzip.compress(b"timestamp,symbol,side,size,price\n1700000000.123456789,BTC-USDT,Buy,1.500,42000.10\n1700000001,BTC-USDT,Sell,2,42000.2\n"))
    got = lanes.read_csv_trades(spark, str(p), 2, 3).orderBy("ts_venue_exec").collect()
    assert (got[0]["ts_venue_exec"], got[0]["side"], got[0]["price_raw"], got[0]["qty_raw"]) == (1700000000123456789, 0, 4200010, 1500)
    with pytest.raises(Exception, match="digits lost"):
        lanes.read_csv_trades(spark, str(p), 0, 3).collect()
    texts = spark.createDataFrame([(x,) for x in ("BTC-USD", "ETH,USD", "SOL_USDT", "XRP/USDC", "btc - usd", "DOGEUSDT", "something", "", "BTC", "BTC-", "-USD")], "t string")
    base, quote = pair(F.col("t"))
    got = [(r["b"], r["q"]) if r["b"] else None for r in texts.select(base.alias("b"), quote.alias("q")).collect()]
    assert got == [("BTC", "USD"), ("ETH", "USD"), ("SOL", "USDT"), ("XRP", "USDC"), ("BTC", "USD"), ("DOGE", "USDT"), *[None] * 5]
    assert parse_pair("DOGEUSDT") == ("DOGE", "USDT")
    with pytest.raises(ValueError):
        parse_pair("BTC-")
    amounts = spark.createDataFrame([("$1,234.5",), ("7",), ("x",)], "t string")
    assert [r[0] for r in amounts.select(usd(F.col("t"))).collect()] == [1234.5, 7.0, None]
    one = spark.range(1)
    assert one.select(raw(F.lit("1.2300"), 2), realigned(F.lit(120), 2, 1), realigned(F.lit(12), 1, 3), decoded(F.lit(5), 2)).first()[:] == (123, 12, 1200, 0.05)


def _graph(**change):
    @node("src")
    def one(s):
        return s

    @node("one")
    def gate(s):
        return s

    @node(gating("gate"), "dear")
    def out(g, d):
        return d

    @node("one")
    def dear(s):
        return s

    @node(buffering("one", reach.elems(3)))
    def unused(s):
        return s

    return Graph(**{"roots": ("src", "other"), "nodes": (one, gate, out, dear, unused), "outputs": ("out",)} | change)


def test_graph():
    g = _graph()
    assert g.order == ["src", "one", "gate", "dear", "out"] and g.required_lanes == ["src"]
    assert g.demand["dear"] == frozenset({frozenset({"gate"})}) and g.demand["gate"] == "pin:gate" and g.demand["one"] == "pin:flow"
    assert "dear <- one  [gate]  asleep" in g.explain(set()) and "asleep" not in g.explain({"gate"})
    assert _graph(outputs=("unused",)).reaches == {"one": reach.elems(3)} and g.fidelity["exact"] == 4
    assert _graph(alias={"dear": "unused"}).order[-2] == "unused"
    called = []
    assert g.build({"src": lambda: called.append("src") or "rows", "other": lambda: called.append("other")}) == {"out": "rows"} and called == ["src"]
    for bad in ({"roots": ()}, {"outputs": ()}, {"outputs": ("nothing",)}, {"alias": {"one": "gate"}}):
        with pytest.raises(graph.GraphError):
            _graph(**bad)
    with pytest.raises(graph.GraphError):
        _graph(nodes=(node(gating("src"), folding("src", reach.UNIT))(lambda *a: a),), outputs=("<lambda>",))
    with pytest.raises(graph.GraphError):
        _graph(nodes=(node("src", gating("src"))(lambda *a: a),), outputs=("<lambda>",))
    assert str(sampling("x")) == "sampling(x)"


def test_clock(spark):
    from pyspark.sql import functions as F

    from tidewheel.functions import clock

    one = spark.range(1)
    at = lambda x, step: one.select(clock.cell_end(F.lit(x), step)).first()[0]
    assert [at(x, 10) for x in (0, 9, 10, -1, -10)] == [9, 9, 19, -1, -1] and at(5, 0) == 5
    assert at(clock.MAX - 3, 10) == clock.MAX and at(5, clock.MAX) == clock.MAX - 1
    assert at(clock.MIN, 10) == clock.MIN + 9
    assert one.select(clock.floor(F.lit(-1), 10)).first()[0] == -10
    assert clock.actor("ts_local_recv") == "local"
    with pytest.raises(ValueError):
        clock.between("ts_local_recv", "ts_venue_exec")


def test_days_are_ingested_once(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    day = spark.createDataFrame([(i * 5 * lanes.MINUTE, None, None, float(i)) for i in range(288)], lanes.LANES["oi"])
    assert c.ensure_day("oi", "a", 0, lambda: day, expected=288) and not c.ensure_day("oi", "a", 0, lambda: 1 / 0)
    with pytest.raises(CatalogError):
        c.ensure_day("oi", "b", 0, lambda: day.limit(3), expected=288)


def test_batches_are_whole_or_not_there(spark, tmp_path):
    from pyspark.sql import functions as F

    c = Catalog(spark, str(tmp_path / "cat"))
    rows = spark.createDataFrame([(i * lanes.HOUR, None, i, i, 0, 100 + i, 5) for i in range(60)], lanes.LANES["trades"]).withColumn("sym", (F.col("monotonic_seq") % 2).cast("string"))
    assert c.write_batch("trades", rows, "b1", max_bytes=400) == 2 and c.last_reception() == 59
    files = list((tmp_path / "cat" / "trades").rglob("*.parquet"))
    assert all(spark.read.parquet(str(f)).count() <= 10 for f in files) and len({f.parent for f in files}) >= 6  # ten rows of 40 bytes; a day each
    rows.write.parquet(str(tmp_path / "cat" / "trades" / "batch=lost" / "sym=0" / "day=0" / "slot=0"))  # written, but not listed
    assert c.read("trades", "0", 0, 60 * lanes.HOUR).count() == 30
    c.write_batch("trades", rows.where("monotonic_seq < 10"), "b1")  # tried again
    assert c.read("trades", "0", 0, 60 * lanes.HOUR).count() == 5
    with pytest.raises(CatalogError):
        c.precision("trades", "nothing", 0, 9)
    with pytest.raises(CatalogError):
        c.write_batch("trades", rows, "b2", apart=True)


def test_csv_out_of_order(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("timestamp,symbol,side,size,price\n2,X,Buy,1,1\n1,X,Buy,1,1\n")
    with pytest.raises(Exception, match="out of order"):
        lanes.read_csv_trades(spark, str(p), 0, 0).collect()


def test_quotes_in_their_order():
    assert [parse_pair(x) for x in ("BTCFDUSD", "BTCTRY", "BTCBUSD", "XUSD1", "ABCEURI")] == [("BTC", "FDUSD"), ("BTC", "TRY"), ("BTCB", "USD"), ("X", "USD1"), ("ABC", "EURI")]


def test_epochs():
    """A book that sleeps over less than the net covers catches up; over more, it waits for a checkpoint."""
    rows = _deltas(99, 300)
    whole = book.Sides()
    after = {}
    for _, seq, _, *level in rows:
        whole.set(*level)
        after[seq] = dict(whole.levels())
    change = lambda a, b: [(r[1], *r[3:]) for r in rows[a - 1 : b]]
    net = lambda a, b: (a, b, list({r[3:5]: tuple(r[3:]) for r in rows[a - 1 : b]}.values()))
    e = book.Epochs()
    assert not e.step(None, change(1, 9)) and e.epoch == 0  # unseeded
    shape = [(s, p, q) for (s, p), q in after[50].items()]
    assert e.step(shape, change(41, 60), net(41, 60)) and e.book.levels() == after[60] and e.epoch == 1
    assert e.step(shape, change(61, 70)) and e.epoch == 1 and e.book.levels() == after[70]  # a checkpoint is no event while synced
    assert e.step(None, change(95, 100), net(60, 100)) and e.book.levels() == after[100] and e.epoch == 1  # asleep, but covered
    assert not e.step(None, change(190, 200), net(150, 200)) and not e.synced
    shape = [(s, p, q) for (s, p), q in after[220].items()]
    assert e.step(shape, change(221, 230)) and e.epoch == 2 and e.book.levels() == after[230]
    r = book.Epochs()
    r.rewind([(s, p, q) for (s, p), q in after[100].items()], change(101, 300))
    assert r.book.levels() == after[300] and r.epoch == 0


def test_graphs_that_cannot_be():
    one = node("src")(lambda s: s)
    with pytest.raises(graph.GraphError, match="never arm"):
        _deadlocked(one)
    with pytest.raises(graph.GraphError, match="isn't gated"):
        Graph(roots=("src",), nodes=(graph.Node("latch_", (graph.Read("src"),), one.body, latch=True, cut="src"),), outputs=("latch_",))


def _deadlocked(one):
    g = Graph(roots=("src",), nodes=(graph.Node("free", (graph.Read("src"),), one.body),), outputs=("free",))
    g.by_name = {"arm": graph.Node("arm", (gating("latch_"),), one.body), "latch_": graph.Node("latch_", (graph.Read("arm"),), one.body, latch=True)}
    g.order = ["arm", "latch_"]
    g._check()


def test_blocks_change_nothing(spark):
    from pyspark.sql import functions as F

    from tidewheel.operators import sampling as S_

    r = np.random.default_rng(2)
    rows = spark.createDataFrame([(int(i % 2), i, int(r.integers(0, 4)) if r.random() < 0.8 else None) for i in range(400)], "sym int, seq long, v long")
    other = spark.createDataFrame([(int(i % 2), i, float(i)) for i in range(3, 400, 37)], "sym int, at long, x double")
    told = lambda df: sorted(map(tuple, df.collect()), key=str)
    whole, cut = (S_.sample(rows, "seq", {"x": (other, "at", "x")}, block=b) for b in (None, 50))
    assert told(whole.select("sym", "seq", "x")) == told(cut.select("sym", "seq", "x"))
    assert told(control.moved(rows, "v")) == told(control.moved(rows, "v", block=F.floor(F.col("seq") / 30)).select("sym", "seq", "v", "moved"))
    t = rows.withColumns({"ts": F.col("seq") * S, "price_raw": F.col("seq") % 13})
    assert told(series.mock_ohlc(t, 7)) == told(series.mock_ohlc(t, 7, block=60 * S))
    lane = t.withColumn("recv", (F.col("ts") - (F.col("seq") % 5) * 3 * S))
    assert told(weave.arrivals(lane, "trades", "recv")) == told(weave.arrivals(lane, "trades", "recv", block=60 * S).select("sym", "lane", "lane_ix", "seq", "ts", "arrival"))


def test_delays_differ_by_lane_and_symbol(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(s, i, i * lanes.DAY, None) for s in (0, 1) for i in range(20)], "sym int, seq long, ts long, recv long")
    late = lambda name: [r["d"] for r in weave.arrivals(rows, name, "recv").select("sym", "seq", (F.col("arrival") - F.col("ts")).alias("d")).orderBy("sym", "seq").collect()]
    a, b = late("trades"), late("deltas")
    assert a[:20] != a[20:] and a != b and late("trades") == a
