from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewheel.operators import series, shadow
from tidewheel.queries import messages
from tidewheel.sources import lanes
from tidewheel.sources.lanes import HOUR, Catalog
from tidewheel.streaming import live

SF = "/root/testdata/sf0.001"


def _stream(spark, rows, tmp_path, files=3):
    """``rows`` as a stream of files, in the order of ``seq`` or ``recv``."""
    order = "seq" if "seq" in rows.columns else "recv"
    path = tmp_path / "in"
    n = rows.count()
    rank = F.row_number().over(Window.orderBy(order, "sym")) - 1
    ranked = rows.withColumn("part", F.floor(rank * files / n)).cache()
    for i in range(files):
        ranked.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(path))
    ranked.unpersist()
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def _run(spark, stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_bars_stream_as_batch(spark, tmp_path):
    t = lanes.trades(spark, SF).select("sym", "seq", "ts", "side", "price_raw", "qty_raw")
    got = _run(spark, live.bars(_stream(spark, t, tmp_path), HOUR), tmp_path, "live_bars")
    want = series.bars(t, HOUR)
    cols = ["sym", "ts_close", "open", "high", "low", "close", "vol", "flow", "emit_seq"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_shadow_stream_as_batch(spark, tmp_path):
    m = messages(lanes.deltas(spark, SF))
    got = _run(spark, live.shadow(_stream(spark, m, tmp_path)), tmp_path, "live_shadow")
    want = shadow.reconcile(m)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_recorded_is_replayed(spark, tmp_path):
    t = lanes.trades(spark, SF)
    rows = t.select("sym", F.col("ts").alias("ts_venue_exec"), F.lit(None).cast("long").alias("ts_venue_send"), F.lit(None).cast("long").alias("ts_local_recv"), F.col("seq").alias("monotonic_seq"), "side", "price_raw", "qty_raw").withColumn("seq", F.col("monotonic_seq"))
    catalog = Catalog(spark, str(tmp_path / "cat"))
    seen = []
    sink = live.Live("trades", catalog, lambda b: seen.extend(b.select("sym", "monotonic_seq", "ts_local_recv").collect()), clock=lambda: 10)
    q = _stream(spark, rows, tmp_path).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    back = [r for s in range(4) for r in catalog.read("trades", str(s), 0, 1 << 62).select(F.col("sym").cast("int"), "monotonic_seq", "ts_local_recv").collect()]
    assert sorted(map(tuple, back)) == sorted(map(tuple, seen)) and len(seen) == t.count()
    stamps = {}
    for r in sorted(seen, key=lambda r: (r["sym"], r["monotonic_seq"])):
        assert r["ts_local_recv"] > stamps.get(r["sym"], 0)
        stamps[r["sym"]] = r["ts_local_recv"]


def test_live_over_restarts_and_ties(spark, tmp_path):
    """Batches that share a venue time, one that comes again, a restart, and two lanes of one clock."""
    catalog = Catalog(spark, str(tmp_path / "cat"))
    rows = lambda a, b: spark.createDataFrame([(s, 7, None, None, i, 0, 5, 1) for i in range(a, b) for s in (0, 1)], "sym int, ts_venue_exec long, ts_venue_send long, ts_local_recv long, monotonic_seq long, side int, price_raw int, qty_raw long")
    seen = []
    sink = lambda b: seen.append(sorted(r["ts_local_recv"] for r in b.collect()))
    stamps = live.Stamps(catalog, clock=lambda: 100)
    first, other = live.Live("trades", catalog, sink, stamps=stamps), live.Live("deltas", None, sink, stamps=stamps)
    first(rows(0, 3), 0)
    other(rows(0, 2), 0)
    first(rows(3, 5), 1)
    assert seen == [list(range(100, 106)), list(range(106, 110)), list(range(110, 114))]
    again = live.Live("trades", catalog, sink, clock=lambda: 1)  # a new driver, its clock set back
    again(rows(3, 5), 1)  # repeated: what was recorded
    again(rows(5, 6), 2)
    assert seen[3:] == [list(range(110, 114)), [114, 115]]
    back = [r["ts_local_recv"] for s in "01" for r in catalog.read("trades", s, 0, 9).collect()]
    assert sorted(back) == [*range(100, 106), *range(110, 116)]


def test_sampled_stream_as_batch(spark, tmp_path):
    from tidewheel.operators import sampling

    t = lanes.trades(spark, SF)
    rows = t.select("sym", "seq", F.when(F.col("side") == 0, F.col("price_raw").cast("double")).alias("v"))
    got = _run(spark, live.sampled(_stream(spark, rows, tmp_path), "v"), tmp_path, "live_sampled")
    buys = rows.where("v IS NOT NULL").withColumnRenamed("v", "x")
    want = sampling.sample(rows.where("v IS NULL").select("sym", "seq"), "seq", {"v": (buys, "seq", "x")})
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select("sym", "seq", "v").collect()), key=str)
