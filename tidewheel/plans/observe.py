"""Observation: values with their exact derivatives, blocks over lags, and a census of what fired.

Observations are plans of their own over the same series, so observing changes no output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.expr import Expr, diff, simplify, to_column
from tidewheel.plans.reach import by


def jacobian(rows: DataFrame, body: Expr, env: list[str], out: str = "value") -> DataFrame:
    """``rows`` with ``out`` and an array ``jac`` of its exact partials by the columns ``env``."""
    cols = [F.col(c) for c in env]
    return rows.withColumns({out: to_column(body, cols), "jac": F.array(*[to_column(simplify(diff(body, i)), cols) for i in range(len(env))])})


def lags(rows: DataFrame, column: str, n: int, order: str = "ts_close") -> list[Column]:
    """The last n elements of a series as columns, oldest first."""
    return [F.lag(column, n - 1 - i).over(by(order)) if i < n - 1 else F.col(column) for i in range(n)]


def block(rows: DataFrame, body: Expr, column: str, n: int, order: str = "ts_close") -> DataFrame:
    """``rows`` with ``value`` and ``jac``: partials by each of the last n elements of ``column``, oldest first."""
    names = [f"tw_lag{i}" for i in range(n)]
    wide = rows.select("*", *[c.alias(k) for c, k in zip(lags(rows, column, n, order), names, strict=True)])
    return jacobian(wide, body, names).drop(*names)


def fold_jacobian(dv: Expr, by_state: list[Expr], state_by_input: list[Expr]) -> Expr:
    """dv/dx of a fold's value: its own part, and through each state slot by the stepped state."""
    out = dv
    for a, b in zip(by_state, state_by_input, strict=True):
        out = out + a * b
    return simplify(out)


def census(series: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """node, fires, skips: how many elements of each series are present and absent. One partial aggregation each."""
    rows = None
    for name, (df, value) in series.items():
        own = df.agg(F.count(value).alias("fires"), (F.count(F.lit(1)) - F.count(value)).alias("skips")).select(F.lit(name).alias("node"), "fires", "skips")
        rows = own if rows is None else rows.unionByName(own)
    return rows


def finite_difference(f: Callable[[list[float]], float | None], at: list[float]) -> list[float | None]:
    """Central differences on the driver, for tests: steps of 1e-6 of a value, 1e-9 at least."""
    out = []
    for i, x in enumerate(at):
        h = max(abs(x) * 1e-6, 1e-9)
        hi, lo = x + h, x - h
        a, b = f([*at[:i], hi, *at[i + 1 :]]), f([*at[:i], lo, *at[i + 1 :]])
        out.append(None if a is None or b is None else (a - b) / (hi - lo))
    return out
