"""Source lanes: schemas, the catalog of Parquet tables, and lanes made of the ``events`` table.

A lane is a table of exact integers: prices and quantities are scaled by a precision kept beside the table, times are
nanoseconds in ``BIGINT``. ``sym`` and ``day`` are partition columns, so a range read prunes folders before files.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "7"
NS = 1_000_000_000
MINUTE, HOUR, DAY = 60 * NS, 3600 * NS, 86400 * NS
#: How far back a checkpoint may lie from the start of a range.
ANCHOR_REACH = 15 * MINUTE


def _lane(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


_LONG, _INT, _SHORT, _DOUBLE = T.LongType(), T.IntegerType(), T.ShortType(), T.DoubleType()
LANES = {
    "trades": _lane(("ts_venue_exec", _LONG, False), ("ts_venue_send", _LONG, True), ("ts_local_recv", _LONG, True), ("monotonic_seq", _LONG, False), ("side", _SHORT, False), ("price_raw", _INT, False), ("qty_raw", _LONG, False)),
    "deltas": _lane(("ts_venue_exec", _LONG, False), ("ts_local_recv", _LONG, False), ("monotonic_seq", _LONG, False), ("kind", _SHORT, False), ("side", _SHORT, False), ("price_raw", _INT, False), ("qty_raw", _LONG, False)),
    "anchors": _lane(("ts_venue_exec", _LONG, False), ("ts_local_recv", _LONG, False), ("monotonic_seq", _LONG, False), *((n, T.ArrayType(t), False) for n, t in (("bid_prices", _INT), ("bid_qtys", _LONG), ("ask_prices", _INT), ("ask_qtys", _LONG)))),
    "oi": _lane(("ts_venue_exec", _LONG, False), ("ts_venue_send", _LONG, True), ("ts_local_recv", _LONG, True), ("oi", _DOUBLE, False)),
    "mc": _lane(("ts_local_exec", _LONG, False), ("market_cap", _DOUBLE, False), ("rank", _LONG, True)),
}
#: Ties between lanes go to the one named first.
ORDER = ("trades", "deltas", "anchors", "oi", "mc")


def axis(lane: str) -> str:
    return "ts_local_exec" if lane == "mc" else "ts_venue_exec"


class CatalogError(ValueError):
    pass


#: How much a file of a lane may hold, in bytes and in ns of its axis.
ROTATION = {"trades": (50 << 20, DAY), "deltas": (256 << 20, HOUR), "anchors": (64 << 20, 6 * HOUR), "oi": (64 << 20, 7 * DAY), "mc": (64 << 20, 7 * DAY)}
#: Bytes that a row takes, about; a checkpoint's lists are taken to hold 200 levels.
ROW_BYTES = {"trades": 40, "deltas": 40, "anchors": 2500, "oi": 32, "mc": 24}
MANIFEST = "lane string, sym string, ts_min long, ts_max long, n long, version string, precision string, recv_max long, batch string"


class Catalog:
    """Lane tables under one root, with a manifest of the ranges written.

    Rows of a batch stand in folders of their own, by batch, symbol and day, and are read only if the manifest lists the
    batch. Its entry is written last, as one file of the batch's name: a write that fails leaves nothing that a reader
    sees, and a batch that is written again takes the place of its first try.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def manifest(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{self.root}/manifest")

    def listing(self, lane: str, sym: str, start: int | None = None, end: int | None = None) -> list:
        """Ranges written for a lane, oldest first; those that meet [start, end]."""
        m = self.manifest().where((F.col("lane") == lane) & (F.col("sym") == str(sym)))
        if start is not None:
            m = m.where((F.col("ts_max") >= start) & (F.col("ts_min") <= end))
        return m.orderBy("ts_min", "batch").collect()

    def write(self, lane: str, sym: str, rows: DataFrame, precision: dict[str, int] | None = None, max_bytes: int | None = None) -> bool:
        """Appends ``rows`` (the lane's columns) of one symbol; refuses a range that overlaps one written before.

        False if there was nothing to write.
        """
        return bool(self.write_batch(lane, rows.withColumn("sym", F.lit(str(sym))), uuid.uuid4().hex, precision, max_bytes, apart=True))

    def write_batch(self, lane: str, rows: DataFrame, batch: str, precision: dict[str, int] | None = None, max_bytes: int | None = None, apart: bool = False) -> int:
        """Writes ``rows`` (the lane's columns and ``sym``) of any symbols as one batch, in one job; the number of ranges.

        A batch of the same name is replaced. ``apart`` refuses ranges that overlap those of other batches: times may
        tie or step back between batches of live input, whose order is that of reception. Files hold no more than the
        lane's ``ROTATION`` in bytes (or ``max_bytes``) and in time.
        """
        return self.write_batches(lane, rows.withColumn("batch", F.lit(batch)), precision, max_bytes, apart)

    def write_batches(self, lane: str, rows: DataFrame, precision: dict[str, int] | None = None, max_bytes: int | None = None, apart: bool = False) -> int:
        """As ``write_batch`` for each of the batches that the column ``batch`` names, all in one job; the number of ranges.

        With ``apart`` the batches must lie apart from one another as well; if any does not, none is written.
        """
        at, (most, age) = axis(lane), ROTATION[lane]
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LANES[lane].fields], F.col("sym").cast("string").alias("sym"), "batch")
        recv = F.max("ts_local_recv") if "ts_local_recv" in rows.columns else F.max(at)
        ranges = rows.groupBy("batch", "sym").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count(F.lit(1)).alias("n"), recv.alias("recv")).collect()
        if apart:
            self._apart(lane, ranges)
        if not ranges:
            return 0
        out = rows.withColumn("day", F.floor(F.col(at) / DAY).cast("int")).withColumn("slot", F.floor(F.col(at) / age).cast("int"))
        spread = out.repartition("batch", "sym", "day", "slot").sortWithinPartitions("batch", "sym", "day", "slot", at)
        # written aside and moved into place whole, batch by batch: tasks commit their own files, and no reader sees a part
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        write = spread.write.partitionBy("batch", "sym", "day", "slot").option("compression", "zstd").option("maxRecordsPerFile", max(1, (max_bytes or most) // ROW_BYTES[lane]))
        write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{aside}/rows")
        said = json.dumps(precision or {}, sort_keys=True)
        entries = [(lane, r["sym"], r["lo"], r["hi"], r["n"], SCHEMA_VERSION, said, r["recv"], r["batch"], r["batch"]) for r in ranges]
        listed = self.spark.createDataFrame(entries, MANIFEST + ", of string")
        listed.repartition("of").write.partitionBy("of").parquet(f"{aside}/manifest")
        for batch in sorted({r["batch"] for r in ranges}):
            self._move(f"{aside}/rows", "batch", batch, f"{self.root}/{lane}", f"batch={batch}")
            self._move(f"{aside}/manifest", "of", batch, f"{self.root}/manifest", f"{lane}-{batch}")
        path = self._path(aside)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return len(ranges)

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(*parts)

    def _move(self, frm: str, key: str, batch: str, to: str, name: str) -> None:
        """Puts a batch's folder in the place of ``to``/``name``, whatever stood there."""
        escaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch)
        here, there = self._path(frm, f"{key}={escaped}"), self._path(to, name)
        fs = there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(there, True)
        fs.mkdirs(self._path(to))
        if not fs.rename(here, there):
            raise CatalogError(f"{here} could not be moved to {there}")

    def _apart(self, lane: str, ranges: list) -> None:
        """Fails if one of ``ranges`` meets another of its symbol, or one in the manifest: neighbours, by their starts."""
        held = self.manifest().where(F.col("lane") == lane).select("sym", "ts_min", "ts_max").collect()
        spans = sorted([(str(r["sym"]), r["ts_min"], r["ts_max"], 0) for r in held] + [(str(r["sym"]), r["lo"], r["hi"], 1) for r in ranges])
        ends: dict[tuple[str, int], tuple[int, int]] = {}  # by symbol, and old or new: the range that reaches furthest
        for sym, lo, hi, new in spans:
            for other in (0, 1) if new else (1,):
                if (far := ends.get((sym, other))) and far[1] >= lo:
                    mine, old = ((lo, hi), far) if new else (far, (lo, hi))
                    raise CatalogError(f"{lane}/{sym}: [{mine[0]}, {mine[1]}] overlaps [{old[0]}, {old[1]}]")
            if (sym, new) not in ends or ends[sym, new][1] < hi:
                ends[sym, new] = (lo, hi)

    def ensure_day(self, lane: str, sym: str, day: int, load, precision: dict[str, int] | None = None, expected: int | None = None) -> bool:
        """Ingests one day by ``load()`` unless it is there; False if it was. ``expected`` rows or none at all.

        288 five-minute buckets, say, make a day of open interest.
        """
        if self.listing(lane, sym, day * DAY, (day + 1) * DAY - 1):
            return False
        rows = load()
        if expected is not None and (n := rows.count()) != expected:
            raise CatalogError(f"{lane}/{sym}: day {day} has {n} rows, not {expected}")
        return self.write(lane, sym, rows, precision)

    def read(self, lane: str, sym: str, start: int, end: int, batch: str | None = None) -> DataFrame:
        """Rows whose axis is in [start, end], of all batches or one; folders and row groups outside are not read."""
        found = [r for r in self.listing(lane, sym, start, end) if batch in (None, r["batch"])]
        s = T.StructType([*LANES[lane].fields, T.StructField("batch", T.StringType()), T.StructField("sym", T.StringType()), T.StructField("day", _INT), T.StructField("slot", _INT)])
        if not found:
            return self.spark.createDataFrame([], s).drop("batch", "slot")
        self._agree(lane, sym, found)
        at = axis(lane)
        rows = self.spark.read.schema(s).option("basePath", f"{self.root}/{lane}").parquet(*sorted({f"{self.root}/{lane}/batch={r['batch']}" for r in found}))
        return rows.where((F.col("sym") == str(sym)) & F.col("day").between(start // DAY, end // DAY) & F.col(at).between(start, end)).drop("batch", "slot")

    def _agree(self, lane: str, sym: str, found: list) -> dict[str, int]:
        if bad := [r for r in found if r["version"] != SCHEMA_VERSION]:
            raise CatalogError(f"{lane}/{sym}: schema version {bad[0]['version']}, not {SCHEMA_VERSION}")
        if len(kinds := {r["precision"] for r in found}) > 1:
            raise CatalogError(f"{lane}/{sym}: precisions differ: {sorted(kinds)}")
        return json.loads(kinds.pop())

    def precision(self, lane: str, sym: str, start: int, end: int) -> dict[str, int]:
        """The precision that all ranges read agree on; fails on another schema version, a mixture, or if there is no file."""
        found = self.listing(lane, sym, start, end)
        if not found:
            raise CatalogError(f"{lane}/{sym}: nothing in [{start}, {end}], so no precision")
        return self._agree(lane, sym, found)

    def anchor(self, sym: str, start: int, reach: int = ANCHOR_REACH) -> DataFrame:
        """The newest checkpoint at or before ``start`` and within ``reach``: one row or none."""
        return pick_anchor(self.read("anchors", sym, start - reach, start), start, reach)

    def last_reception(self) -> int:
        """The latest reception recorded in any lane; 0 if there is none."""
        return self.manifest().agg(F.max("recv_max")).first()[0] or 0


def scratch(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share: below ``spark.checkpoint.dir``, or of this machine in a purely local session."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix=f"{name}-")


def shape_of(anchor: DataFrame) -> DataFrame:
    """A checkpoint as two maps of price to quantity."""
    both = [F.map_from_arrays(f"{s}_prices", f"{s}_qtys").alias(f"{s}s") for s in ("bid", "ask")]
    return anchor.select(*[c for c in anchor.columns if not c.startswith(("bid_", "ask_"))], *both)


def pick_anchor(anchors: DataFrame, start: int, reach: int = ANCHOR_REACH) -> DataFrame:
    near = anchors.where(F.col("ts_venue_exec").between(start - reach, start))
    newest = F.max_by(F.struct("*"), F.struct("ts_venue_exec", "monotonic_seq"))
    return near.agg(newest.alias("a")).where("a IS NOT NULL").select("a.*")


def read_csv_trades(spark: SparkSession, path: str, price_precision: int, qty_precision: int, numbered: bool = False) -> DataFrame:
    """Historic trades: gzipped CSV with header ``timestamp,symbol,side,size,price``, exact to the last digit.

    Fails on a line that is earlier than the one before it in its file. ``numbered`` adds ``line``: the number of the row,
    from 0, over all files in order of their names. A file is one task; no task holds more than its files.
    """
    from tidewheel.functions.precision import ns_from_seconds, raw

    rows = spark.read.option("header", True).schema("timestamp string, symbol string, side string, size string, price string").csv(path)
    # each time must be at or after that of the line before: lines are compared as Spark read them, file by file
    line = F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    w = Window.partitionBy("line.file").orderBy("line.line")
    rows = rows.withColumn("line", line)
    sizes = rows.groupBy(F.col("line.file").alias("tw_file")).agg(F.count(F.lit(1)).alias("tw_start"))
    rows = rows.withColumn("before", F.lag(ns_from_seconds(F.col("timestamp"))).over(w))
    if numbered:  # one row for each file is all that meets in one task
        ahead = F.coalesce(F.sum("tw_start").over(Window.orderBy("tw_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("tw_n", F.row_number().over(w)).withColumn("tw_file", F.col("line.file")).join(sizes.withColumn("tw_start", ahead), "tw_file")
    side = F.when(F.lower("side") == "buy", 0).when(F.lower("side") == "sell", 1).otherwise(F.raise_error(F.concat(F.lit("side: "), F.coalesce("side", F.lit("null")))).cast("int"))
    told = ns_from_seconds(F.col("timestamp"))
    ts = F.when(F.col("before").isNull() | (F.col("before") <= told), told).otherwise(F.raise_error(F.concat(F.lit("out of order at "), F.col("timestamp"))).cast("long"))
    return rows.select("symbol", ts.alias("ts_venue_exec"), F.lit(None).cast("long").alias("ts_venue_send"), F.lit(None).cast("long").alias("ts_local_recv"), side.cast("short").alias("side"), raw(F.col("price"), price_precision).cast("int").alias("price_raw"), raw(F.col("size"), qty_precision).alias("qty_raw"), *([(F.col("tw_start") + F.col("tw_n") - 1).alias("line")] if numbered else []))


# Lanes made of the events table, the same in Spark and in DuckDB.


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _us() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _bid() -> Column:
    return F.col("event_type").isin("click", "purchase")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(_bid(), 0).otherwise(1)
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), (_us() * 1000).alias("ts"), (_us() * 1000 + ((F.col("event_id") * 7919) % 50) * 1_000_000).alias("recv"),
        (F.col("user_id") % 4).cast("int").alias("sym"), side.alias("side"), F.round(F.col("value") * 100).cast("long").alias("price_raw"), F.get_json_object("props", "$.k").cast("long").alias("qty_raw"),
    )


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), (_us() * 1000).alias("ts"), (F.col("user_id") % 4).cast("int").alias("sym"), F.when(F.col("event_id") % 10 == 0, 1).otherwise(0).alias("kind"), F.when(_bid(), 0).otherwise(1).alias("side"),
        F.when(_bid(), 9999 - k % 40).otherwise(10001 + k % 40).alias("price_raw"), F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.round(F.col("value") * 100).cast("long")).alias("qty_raw"),
    )


def open_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("seq"), (_us() * 1000).alias("ts"), (F.col("user_id") % 4).cast("int").alias("sym"), (F.col("value") * 1000).alias("oi"))


def market_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = (_us() - F.pmod(_us(), F.lit(86_400_000_000))) * 1000
    return events(spark, sf_dir).groupBy((F.col("user_id") % 4).cast("int").alias("sym"), day.alias("ts")).agg((F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") * 10000).alias("market_cap"))


SQL = {
    "trades": """SELECT event_id AS seq, epoch_us(ts)*1000 AS ts, epoch_us(ts)*1000 + ((event_id*7919)%50)*1000000 AS recv, CAST(user_id%4 AS INT) AS sym,
 CASE WHEN event_type IN ('click','purchase') THEN 0 ELSE 1 END AS side, CAST(round(value*100) AS BIGINT) AS price_raw, CAST(json_extract_string(props,'$.k') AS BIGINT) AS qty_raw FROM events""",
    "deltas": """SELECT event_id AS seq, epoch_us(ts)*1000 AS ts, CAST(user_id%4 AS INT) AS sym, CASE WHEN event_id%10=0 THEN 1 ELSE 0 END AS kind, CASE WHEN event_type IN ('click','purchase') THEN 0 ELSE 1 END AS side,
 CASE WHEN event_type IN ('click','purchase') THEN 9999-CAST(json_extract_string(props,'$.k') AS BIGINT)%40 ELSE 10001+CAST(json_extract_string(props,'$.k') AS BIGINT)%40 END AS price_raw,
 CASE WHEN event_id%4=0 THEN 0 ELSE CAST(round(value*100) AS BIGINT) END AS qty_raw FROM events""",
    "oi": "SELECT event_id AS seq, epoch_us(ts)*1000 AS ts, CAST(user_id%4 AS INT) AS sym, value*1000 AS oi FROM events WHERE event_type='purchase'",
    "mc": "SELECT CAST(user_id%4 AS INT) AS sym, (epoch_us(ts) - epoch_us(ts)%86400000000)*1000 AS ts, CAST(sum(CAST(round(value*100) AS BIGINT)) AS DOUBLE)*10000 AS market_cap FROM events GROUP BY 1, 2",
}
