"""Replays: a recorded range of the catalog, woven in the order of reception and fed to a graph."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.plans import weave as W
from tidewheel.plans.graph import Graph
from tidewheel.sources.lanes import ORDER, Catalog, axis, scratch

#: What a lane carries besides its times and numbers.
SLOTS = {"trades": ("side", "price_raw", "qty_raw"), "deltas": ("kind", "side", "price_raw", "qty_raw"), "anchors": ("bid_prices", "bid_qtys", "ask_prices", "ask_qtys"), "oi": ("oi",), "mc": ("market_cap", "rank")}


class Replay:
    """The lanes of symbols over [start, end] under one read clock. Lanes are read only when they are asked for.

    A checkpoint that lies up to the anchors' reach before the range comes with it, at its start.
    """

    def __init__(self, catalog: Catalog, symbols: Iterable[str], start: int, end: int, step: int = W.EVENT, seed: int = 0, reach: int | None = None) -> None:
        self.catalog, self.symbols, self.start, self.end, self.step, self.seed = catalog, [str(s) for s in symbols], start, end, step, seed
        self.reach = {} if reach is None else {"reach": reach}

    def lane(self, name: str) -> DataFrame:
        """sym, seq, ts, recv (null where nothing was recorded) and the lane's slots."""
        rows = None
        for s in self.symbols:
            own = self.catalog.read(name, s, self.start, self.end)
            if name == "anchors":
                own = self.catalog.anchor(s, self.start - 1, **self.reach).unionByName(own)
            rows = own if rows is None else rows.unionByName(own)
        seq = F.col("monotonic_seq") if "monotonic_seq" in rows.columns else F.col(axis(name))
        recv = F.col("ts_local_recv") if "ts_local_recv" in rows.columns else F.col(axis(name))
        return rows.select("sym", seq.alias("seq"), F.col(axis(name)).alias("ts"), recv.alias("recv"), *SLOTS[name])

    def woven(self, lanes: Iterable[str]) -> DataFrame:
        """The merged stream of ``lanes``; of several checkpoints of one step the newest stays."""
        rows = [W.arrivals(self.lane(n), n, "recv", seed=self.seed) for n in sorted(set(lanes), key=ORDER.index)]
        return W.newest(W.weave(rows, self.step))

    def run(self, graph: Graph, **how) -> dict[str, DataFrame]:
        """The graph's outputs over the lanes that they need. Each lane's rows carry ``ord`` and ``step_id`` of the weave."""
        woven = self.woven(graph.required_lanes)

        def fed(name: str) -> DataFrame:
            places = woven.where(F.col("lane") == name).select("sym", "seq", "ord", "step_id", "arrival")
            return self.lane(name).drop("recv").join(places, ["sym", "seq"])

        return graph.build({n: (lambda n=n: fed(n)) for n in graph.required_lanes}, **how)


def chained(ranges: Iterable, run: Callable[[object, DataFrame | None], tuple[DataFrame, DataFrame]], catalog: Catalog) -> DataFrame:
    """Successive ranges over one state: ``run(range, state)`` gives the range's rows and the state after it.

    State is a table (null before the first range), written after each range, so a later range starts from files and
    not from a plan of all before it, and a chain can be taken up where it stopped. The rows of all ranges are returned.
    """
    spark, root, state, parts = catalog.spark, scratch(catalog.spark, "chain"), None, []
    for i, r in enumerate(ranges):
        rows, after = run(r, state)
        rows.write.parquet(f"{root}/rows-{i}")
        after.write.parquet(f"{root}/state-{i}")
        parts.append(spark.read.parquet(f"{root}/rows-{i}"))
        state = spark.read.parquet(f"{root}/state-{i}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
