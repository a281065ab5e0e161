"""Times the headline queries, warm, and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidewheel.queries import QUERIES  # noqa: E402

#: With BENCH_TIMES=n the events are repeated n times, each over users and a month of its own, below BENCH_TMP; rows a second are reported.
LARGE = ("bars_1h", "cvd", "graph_simple_signal", "book_net", "book_top", "trailing_in_blocks", "graph_clocked", "intents")

HEADLINE = (
    "bars_1h", "bars_4h", "flows_1h", "cvd", "change_over", "change_back", "rolling_vol", "momentum", "kyle_lambda", "rsi", "atr", "sampled_momentum_on_bars",
    "signal", "weave_steps_1h", "step_census", "book_net", "book_top", "book_flow", "trailing_stop", "decision", "intents", "expr_grad",
)


def larger(spark: SparkSession, sf_dir: str, times: int) -> str:
    """A folder whose events are those of ``sf_dir``, ``times`` over; ids and times go on from copy to copy."""
    at = os.path.join(os.environ.get("BENCH_TMP", "/tmp/tidewheel-bench"), f"x{times}")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    n, month = rows.count(), 31 * 86400
    copies = rows.crossJoin(F.broadcast(spark.range(times).withColumnRenamed("id", "copy")))  # a test's input: a few copies of a small table
    copies.select((F.col("event_id") + F.col("copy") * n).alias("event_id"), (F.col("ts") + F.make_dt_interval(secs=F.col("copy") * month)).alias("ts"), "user_id", "event_type", "value", "props").write.mode("overwrite").parquet(f"{at}/events.parquet")
    return at


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = int(os.environ.get("BENCH_TIMES", "1"))
    if times > 1:
        sf_dir = larger(spark, sf_dir, times)
    took = {}
    for name in HEADLINE if times == 1 else LARGE:
        run(name)  # compiles code and starts Python workers
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    more = {"rows_per_second": {k: round(n / v) for k, v in took.items()}} if times > 1 else {}
    print(json.dumps(more | {"metric": "warm seconds of all headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf"), "events": n}))


if __name__ == "__main__":
    main()
