"""The weave: lanes merged into one reception-ordered stream of steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.series import bucket, by_number, running
from tidewheel.sources.lanes import DAY, ORDER

#: Cells of the read clock: each arrival its own, or all in one.
EVENT, ALL = 0, (1 << 63) - 1


def cell(arrival: Column, step: int) -> Column:
    """The absolute cell of an arrival: cells start at multiples of ``step``."""
    if step == EVENT:
        return arrival
    return F.lit(0).cast("long") if step == ALL else arrival - F.pmod(arrival, F.lit(step))


def latency(seq: Column, seed: int | str, p68: int = 25_000_000, p95: int = 60_000_000, p997: int = 150_000_000) -> Column:
    """A simulated delay in ns, fixed by the row's number and the seed (of lane and symbol, say): straight lines between three quantiles."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    u = F.pmod(F.xxhash64(seq, seed), F.lit(1_000_000)) / 1_000_000.0
    line = lambda lo, hi, a, b: a + (u - lo) / (hi - lo) * (b - a)
    return F.when(u < 0.68, line(0.0, 0.68, 0, p68)).when(u < 0.95, line(0.68, 0.95, p68, p95)).otherwise(line(0.95, 0.997, p95, p997)).cast("long")


def arrivals(lane: DataFrame, name: str, recv: str | None, ts: str = "ts", seq: str = "seq", seed: int = 0, block: int | None = None) -> DataFrame:
    """sym, lane, lane_ix, seq, ts, arrival: recorded reception if there is one, else simulated; never falling by ``seq``.

    The running maximum is taken in blocks, each a task of its own: of numbers ``seq``, or with ``block`` of that many ns of
    ``ts``, which then must not fall.
    """
    tag = F.concat_ws(":", F.lit(name), F.col("sym").cast("string"), F.lit(str(seed)))
    at = F.coalesce(F.col(recv), F.col(ts) + latency(F.col(seq), tag)) if recv else F.col(ts)
    rows = lane.select("sym", F.lit(name).alias("lane"), F.lit(ORDER.index(name)).alias("lane_ix"), F.col(seq).alias("seq"), F.col(ts).alias("ts"), at.alias("arrival"))
    return running(rows, {"arrival": (F.col("arrival"), "max")}, bucket("ts", block) if block else by_number()).select(*rows.columns)


def weave(lanes: list[DataFrame], step: int = EVENT, block: int = DAY) -> DataFrame:
    """Rows of all lanes with ``ord`` and ``step_id`` by symbol, in order of (arrival, lane, seq).

    A step is a run of one lane within one cell. Exact ties between lanes are trusted at ``EVENT`` only; under coarser
    cells give each message an arrival of its own. Rows are put in order in blocks of ``block`` ns of arrival, each a task
    of its own; how many rows and steps came before, and whether a block's first run goes on with the last one before it,
    is carried over one row for each block.
    """
    rows = lanes[0]
    for other in lanes[1:]:
        rows = rows.unionByName(other)
    out = rows.columns
    w = Window.partitionBy("tw_block").orderBy("arrival", "lane_ix", "seq")
    rows = rows.withColumn("tw_cell", cell(F.col("arrival"), step)).withColumn("tw_block", F.struct("sym", bucket("arrival", block).alias("block")))
    new = ~(F.col("lane_ix").eqNullSafe(F.lag("lane_ix").over(w)) & F.col("tw_cell").eqNullSafe(F.lag("tw_cell").over(w)))
    rows = rows.withColumn("tw_new", new.cast("long")).withColumn("ord", F.row_number().over(w).cast("long"))
    rows = rows.withColumn("step_id", F.sum("tw_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = [how(c, "ord").alias(f"tw_{n}_{c}") for n, how in (("first", F.min_by), ("last", F.max_by)) for c in ("lane_ix", "tw_cell")]
    blocks = rows.groupBy("tw_block").agg(F.count(F.lit(1)).alias("tw_rows"), F.max("step_id").alias("tw_steps"), *ends)
    b = Window.partitionBy("tw_block.sym").orderBy("tw_block.block")
    goes_on = [F.col(f"tw_first_{c}").eqNullSafe(F.lag(f"tw_last_{c}").over(b)) for c in ("lane_ix", "tw_cell")]
    blocks = blocks.withColumn("tw_on", ((F.row_number().over(b) > 1) & goes_on[0] & goes_on[1]).cast("long"))
    before = lambda c: F.coalesce(F.sum(c).over(b.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = blocks.select("tw_block", before(F.col("tw_rows")).alias("tw_rows"), (before(F.col("tw_steps") - F.col("tw_on")) - F.col("tw_on")).alias("tw_steps"))
    return rows.join(carry, "tw_block").select(*out, (F.col("ord") + F.col("tw_rows")).alias("ord"), (F.col("step_id") + F.col("tw_steps")).alias("step_id"))


def anchors(checkpoints: DataFrame) -> DataFrame:
    """The anchors lane of checkpoints (sym, seq, ts): arrivals on their own axis, weighed between deltas and open interest."""
    return arrivals(checkpoints, "anchors", None)


def newest(woven: DataFrame, lane: str = "anchors") -> DataFrame:
    """``woven`` with each step's run of ``lane`` collapsed to its last element: of several checkpoints only the newest counts."""
    runs = woven.where(F.col("lane") == lane).groupBy("sym", "step_id").agg(F.max_by(F.struct("*"), "ord").alias("x")).select("x.*")
    return woven.where(F.col("lane") != lane).unionByName(runs)


def steps(woven: DataFrame) -> DataFrame:
    """sym, step_id, lane, n, ts: the venue time of a step is its last element's."""
    # a step is of one lane, whose number (not its name) can be aggregated without a sort
    lane = F.element_at(F.array(*[F.lit(n) for n in ORDER]), F.col("lane_ix") + 1)
    found = woven.groupBy("sym", "step_id").agg(F.min("lane_ix").alias("lane_ix"), F.count(F.lit(1)).alias("n"), F.max_by("ts", "ord").alias("ts"))
    return found.select("sym", "step_id", lane.alias("lane"), "n", "ts")


def census(woven: DataFrame) -> DataFrame:
    return steps(woven).groupBy("sym", "lane").agg(F.count(F.lit(1)).alias("steps"), F.sum("n").alias("n_rows"))
