"""Sampling: the last value that another series had emitted when a driver's element came.

Order is that of emission (``emit_seq``), not of event time: a slow bar that the same trade closes is seen. Series are
sorted once as a union, so a sample costs one shuffle by symbol and no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.series import running


def sample(driver: DataFrame, order: str, series: dict[str, tuple[DataFrame, str, str]], before: bool = True, block: int | None = None) -> DataFrame:
    """``driver`` with a column for each of ``series``: name -> (DataFrame, its emission order, its value column).

    Where both stand at one order the sampled series comes first (``before``). With ``block`` the order is cut in blocks
    of that many; the last values of blocks are carried over blocks, so that one symbol is many tasks.
    """
    cols = driver.columns
    rows = driver.select("sym", F.col(order).alias("tw_at"), F.lit(1).alias("tw_driver"), F.struct(*cols).alias("tw_row"))
    together: dict[tuple[int, str], tuple[DataFrame, list[tuple[str, str]]]] = {}
    for name, (df, at, value) in series.items():  # columns of one series come by one branch of the union
        together.setdefault((id(df), at), (df, []))[1].append((name, value))
    for (_, at), (df, values) in together.items():
        some = df.where(F.coalesce(*[F.col(v).cast("string") for _, v in values]).isNotNull())
        rows = rows.unionByName(some.select("sym", F.col(at).alias("tw_at"), F.lit(0 if before else 2).alias("tw_driver"), *[F.col(v).alias(n) for n, v in values]), allowMissingColumns=True)
    if block:
        at = F.struct("tw_at", "tw_driver").alias("tw_order")
        out = running(rows.withColumn("tw_order", at), {n: (F.col(n), "last") for n in series}, F.floor(F.col("tw_at") / block), "tw_order")
        return out.where("tw_driver = 1").select("tw_row.*", *series)
    w = Window.partitionBy("sym").orderBy("tw_at", "tw_driver").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("tw_driver", "tw_row", *[F.last(n, ignorenulls=True).over(w).alias(n) for n in series])
    return out.where("tw_driver = 1").select("tw_row.*", *series)


def closed_by(driver: DataFrame, series: dict[str, tuple[DataFrame, str]], deadline: str = "ts_close") -> DataFrame:
    """The last value of slower series that closed at or before each of the driver's deadlines: cut by closing time."""
    return sample(driver, deadline, {name: (df, "ts_close", value) for name, (df, value) in series.items()})
