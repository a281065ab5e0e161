"""Order books: levels are absolute (side, price) -> qty, 0 deletes, the last by ``seq`` wins."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.operators.series import PRICE, bucket

DEPTH = 20


def net(deltas: DataFrame, period: int) -> DataFrame:
    """sym, period, side, price_raw, qty_raw, n: the last quantity of each level touched in a period. Map-side combined."""
    return deltas.groupBy("sym", bucket("ts", period).alias("period"), "side", "price_raw").agg(F.max_by("qty_raw", "seq").alias("qty_raw"), F.count(F.lit(1)).alias("n"))


def contiguity(deltas: DataFrame, period: int) -> DataFrame:
    """sym, period, whole: whether each change of the symbol's period follows the one before it by number."""
    numbered = deltas.withColumn("n", F.row_number().over(Window.partitionBy("sym", bucket("ts", period)).orderBy("seq")))
    return numbered.groupBy("sym", bucket("ts", period).alias("period")).agg((F.max("seq") - F.min("seq") + 1 == F.count(F.lit(1))).alias("whole"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def state(deltas: DataFrame, upto: int | None = None) -> DataFrame:
    """The book's levels after all changes (with ``seq`` up to ``upto``)."""
    rows = deltas if upto is None else deltas.where(F.col("seq") <= upto)
    return rows.groupBy("sym", "side", "price_raw").agg(F.max_by("qty_raw", "seq").alias("qty_raw")).where("qty_raw > 0")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """The changes that carry book ``a`` onto ``b``: absolute quantities, 0 where a level goes."""
    keys = ["sym", "side", "price_raw"]
    both = a.withColumnRenamed("qty_raw", "was").join(b.withColumnRenamed("qty_raw", "now"), keys, "full_outer")
    return both.where("coalesce(was, 0) <> coalesce(now, 0)").select(*keys, F.coalesce("now", F.lit(0)).alias("qty_raw"))


def shape(levels: DataFrame) -> DataFrame:
    """One row for each symbol: its levels as arrays, best first."""
    pick = lambda side, best: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct((F.col("price_raw") * best).alias("k"), "price_raw", "qty_raw"))))
    both = levels.groupBy("sym").agg(pick(0, -1).alias("b"), pick(1, 1).alias("a"))
    return both.select("sym", *[F.col(f"{s}.{c}").alias(n) for s, c, n in (("b", "price_raw", "bid_prices"), ("b", "qty_raw", "bid_qtys"), ("a", "price_raw", "ask_prices"), ("a", "qty_raw", "ask_qtys"))])


class Sides:
    """A book in memory: sorted prices and quantities of both sides."""

    def __init__(self, levels: Iterable[tuple[int, int, int]] = ()) -> None:
        self.prices: tuple[list[int], list[int]] = ([], [])
        self.qty: tuple[dict[int, int], dict[int, int]] = ({}, {})
        for level in levels:
            self.set(*level)

    def set(self, side: int, price: int, qty: int) -> None:
        own, prices = self.qty[side], self.prices[side]
        if qty > 0:
            if price not in own:
                insort(prices, price)
            own[price] = qty
        elif own.pop(price, None) is not None:
            del prices[bisect_left(prices, price)]

    def best(self, side: int, n: int = 1) -> list[int]:
        return self.prices[0][: -n - 1 : -1] if side == 0 else self.prices[1][:n]

    def depth(self, side: int, n: int = DEPTH) -> int:
        own = self.qty[side]
        return sum([p * own[p] for p in self.best(side, n)])

    def levels(self) -> dict[tuple[int, int], int]:
        return {(s, p): q for s in (0, 1) for p, q in self.qty[s].items()}


def with_carry(deltas: DataFrame, block: int) -> DataFrame:
    """``deltas`` with a column ``tw_block`` and, ahead of each block's rows (``carry`` = 1), the book as it stood.

    Blocks are netted first (small), and a level's last quantity is carried over them, so any block of one symbol's
    changes can be folded by its own task.
    """
    rows = deltas.withColumn("tw_block", bucket("ts", block)).withColumn("carry", F.lit(0))
    nets = rows.groupBy("sym", "tw_block", "side", "price_raw").agg(F.max_by("qty_raw", "seq").alias("qty_raw"))
    later = nets.groupBy("sym").agg(F.sort_array(F.collect_set("tw_block")).alias("blocks"))
    until = F.lead("tw_block").over(Window.partitionBy("sym", "side", "price_raw").orderBy("tw_block"))
    held = nets.withColumn("until", until).where("qty_raw > 0").join(later, "sym")
    held = held.select("sym", "side", "price_raw", "qty_raw", F.explode(F.filter("blocks", lambda x: (x > F.col("tw_block")) & F.coalesce(x <= F.col("until"), F.lit(True)))).alias("tw_block"))
    held = held.withColumns({"carry": F.lit(1), "seq": F.lit(-1).cast("long"), "ts": F.lit(0).cast("long")})  # no nulls: they would make doubles of nanoseconds
    return rows.unionByName(held, allowMissingColumns=True)


def top(deltas: DataFrame, block: int, depth: int = DEPTH) -> DataFrame:
    """sym, seq, ts, bid, ask (raw), bid_depth, ask_depth (raw price * qty over the best levels), after each change.

    Rows where a side is empty have nulls in all four.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["carry", "seq"], ascending=[False, True])
        start = part[part["carry"] == 1]
        book, out = Sides(zip(*(start[c].tolist() for c in ("side", "price_raw", "qty_raw")), strict=True)), []
        own = [(book.best(s), book.depth(s, depth)) for s in (0, 1)]
        rest = part[part["carry"] == 0]
        for seq, ts, side, price, qty in zip(*(rest[c].tolist() for c in ("seq", "ts", "side", "price_raw", "qty_raw")), strict=True):
            book.set(side, price, qty)
            own[side] = (book.best(side), book.depth(side, depth))  # the other side stands
            (bid, b), (ask, a) = own
            out.append((seq, ts, bid[0], ask[0], b, a) if bid and ask else (seq, ts, None, None, None, None))
        names = ["seq", "ts", "bid", "ask", "bid_depth", "ask_depth"]  # each an integer array of its own: nanoseconds don't fit a double
        frame = pd.DataFrame({k: pd.array([r[i] for r in out], dtype="Int64") for i, k in enumerate(names)})
        frame.insert(0, "sym", part["sym"].iloc[0])
        return frame

    rows = with_carry(deltas.select("sym", "seq", "ts", "side", "price_raw", "qty_raw"), block)
    return rows.groupBy("sym", "tw_block").applyInPandas(fold, "sym int, seq long, ts long, bid long, ask long, bid_depth long, ask_depth long")


def view_changes(deltas: DataFrame, block: int, depth: int = DEPTH) -> DataFrame:
    """sym, seq, ts, side, price_raw, qty_raw: what each change does to the view of the best ``depth`` levels of a side.

    A level that leaves the view is deleted (quantity 0) though the book may still hold it; one that enters is set.
    """

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["carry", "seq"], ascending=[False, True])
        start = part[part["carry"] == 1]
        book = Sides(zip(*(start[c].astype(int) for c in ("side", "price_raw", "qty_raw")), strict=True))
        look = lambda s: {p: book.qty[s][p] for p in book.best(s, depth)}
        seen, out = [look(0), look(1)], []
        for seq, ts, s, price, qty in part.loc[part["carry"] == 0, ["seq", "ts", "side", "price_raw", "qty_raw"]].itertuples(index=False):
            book.set(int(s), int(price), int(qty))
            view = look(s)
            out += [(seq, ts, s, p, view.get(p, 0)) for p in sorted(seen[s].keys() | view.keys()) if seen[s].get(p, 0) != view.get(p, 0)]
            seen[s] = view
        frame = pd.DataFrame(out, columns=["seq", "ts", "side", "price_raw", "qty_raw"])
        frame.insert(0, "sym", part["sym"].iloc[0])
        return frame

    rows = with_carry(deltas.select("sym", "seq", "ts", "side", "price_raw", "qty_raw"), block)
    return rows.groupBy("sym", "tw_block").applyInPandas(fold, "sym int, seq long, ts long, side int, price_raw long, qty_raw long")


def joined(deltas: DataFrame, period: int) -> DataFrame:
    """Each period's net with the net of the period before: sym, period, side, price_raw, qty_raw (the later value of a level
    that both touch), prev (whether the period before meets this one and both ran unbroken).

    A net is a level's last quantity, so it can be folded over any book that stands within the two periods.
    """
    nets = net(deltas, period).select("sym", "period", "side", "price_raw", "qty_raw")
    w = Window.partitionBy("sym").orderBy("period")
    spans = contiguity(deltas, period)
    able = F.col("whole") & F.lag("whole").over(w) & (F.lag("period").over(w) == F.col("period") - period) & (F.lag("last_seq").over(w) + 1 == F.col("first_seq"))
    spans = spans.select("sym", "period", F.coalesce(able, F.lit(False)).alias("prev"))
    before = nets.withColumn("period", F.col("period") + period).withColumn("late", F.lit(0))
    both = before.join(spans.where("prev").select("sym", "period"), ["sym", "period"], "left_semi").unionByName(nets.withColumn("late", F.lit(1)))
    return both.groupBy("sym", "period", "side", "price_raw").agg(F.max_by("qty_raw", "late").alias("qty_raw")).join(spans, ["sym", "period"])


def levels_of(anchors: DataFrame) -> DataFrame:
    """A row for each level of checkpoints (sym, seq, ts, bid_prices, bid_qtys, ask_prices, ask_qtys)."""

    def side(i: int, name: str) -> Column:
        both = F.arrays_zip(F.col(f"{name}_prices").alias("p"), F.col(f"{name}_qtys").alias("q"))
        return F.transform(both, lambda x: F.struct(F.lit(i).alias("side"), x["p"].cast("long").alias("price_raw"), x["q"].cast("long").alias("qty_raw")))

    sides = [side(0, "bid"), side(1, "ask")]
    return anchors.select("sym", "seq", "ts", F.explode(F.concat(*sides)).alias("x")).select("sym", "seq", "ts", "x.*")


def checkpoint_shapes(deltas: DataFrame, cadence: int) -> DataFrame:
    """Checkpoints of a gapless stream: the book after the first change of each period, as sym, seq, ts and four lists."""
    due = checkpoints(deltas, cadence).select("sym", F.col("seq").alias("at"), F.col("ts").alias("at_ts"), F.col("period").alias("p"))
    cut = deltas.withColumn("p", bucket("ts", cadence))
    # nets of whole periods, and of the part of each up to its own checkpoint
    part = cut.join(due, ["sym", "p"]).where("seq <= at").groupBy("sym", "p", "side", "price_raw").agg(F.max_by("qty_raw", "seq").alias("qty_raw")).withColumn("part", F.lit(1))
    carried = with_carry(deltas.select("sym", "seq", "ts", "side", "price_raw", "qty_raw"), cadence).where("carry = 1").select("sym", F.col("tw_block").alias("p"), "side", "price_raw", "qty_raw").withColumn("part", F.lit(0))
    held = part.unionByName(carried).groupBy("sym", "p", "side", "price_raw").agg(F.max_by("qty_raw", "part").alias("qty_raw")).where("qty_raw > 0").join(due, ["sym", "p"])
    keyed = held.withColumn("id", F.struct("sym", "at", "at_ts"))
    shapes = shape(keyed.select(F.col("id").alias("sym"), "side", "price_raw", "qty_raw"))
    return shapes.select("sym.sym", F.col("sym.at").alias("seq"), F.col("sym.at_ts").alias("ts"), *shapes.columns[1:])


def from_anchor(deltas: DataFrame, anchors: DataFrame, upto: int) -> DataFrame:
    """The book at time ``upto`` from the newest checkpoint at or before it and the changes after that: sym, side, price_raw, qty_raw.

    Equal to the fold from the first change, at the cost of what came since the checkpoint. Symbols without a checkpoint
    have no book yet.
    """
    newest = anchors.where(F.col("ts") <= upto).groupBy("sym").agg(F.max_by(F.struct(*[c for c in anchors.columns if c != "sym"]), F.struct("ts", "seq")).alias("a")).select("sym", "a.*")
    later = deltas.where(F.col("ts") <= upto).join(newest.select("sym", F.col("seq").alias("from")), "sym").where("seq > from").drop("from")
    return state(levels_of(newest).unionByName(later.select("sym", "seq", "ts", "side", F.col("price_raw").cast("long").alias("price_raw"), "qty_raw")))


class Epochs:
    """A book that may lose its place: checkpoints seed it, and count only while it has no place in the stream.

    ``step`` takes a tick's checkpoint (levels, or None), its changes [(seq, side, price, qty)] in order, and what the
    retained net speaks for: (first seq, last seq, levels), or None where the net has a hole.
    """

    def __init__(self) -> None:
        self.book, self.seq, self.epoch, self.synced = Sides(), None, 0, False

    def step(self, anchor: list | None, changes: list, net_: tuple[int, int, list] | None = None) -> bool:
        if self.synced:
            follows = not changes or self.seq is None or changes[0][0] == self.seq + 1
            covered = net_ is not None and self.seq is not None and net_[0] <= self.seq + 1 and self.seq <= net_[1]
            if follows:
                self._apply(changes)
                return True
            if covered:
                self._absorb(net_)
                return True
            self.synced = False
        if anchor is not None:
            self.book, self.seq, self.synced = Sides(anchor), None, True
            self.epoch += 1
            if net_ is not None:
                self._absorb(net_)
            else:
                self._apply(changes)
        return self.synced

    def rewind(self, anchor: list | None, changes: list) -> None:
        """Rebuilds the book from a checkpoint and rows, or rows alone, within the same epoch."""
        if anchor is not None:
            self.book, self.seq = Sides(anchor), None
        self._apply(changes)
        self.synced = True

    def _apply(self, changes: list) -> None:
        for seq, *level in changes:
            self.book.set(*level)
            self.seq = seq

    def _absorb(self, net_: tuple[int, int, list]) -> None:
        for level in net_[2]:
            self.book.set(*level)
        self.seq = net_[1]


def measures(tops: DataFrame) -> DataFrame:
    """sym, seq, ts, spread (per cent of the bid), imbalance (of depths; 0 where there is none)."""
    total = F.col("bid_depth") + F.col("ask_depth")
    share = F.when(total == 0, 0.0).otherwise((F.col("bid_depth") - F.col("ask_depth")) / F.nullif(total, F.lit(0)))
    return tops.select("sym", "seq", "ts", ((F.col("ask") - F.col("bid")) / F.nullif(F.col("bid"), F.lit(0)) * 100.0).alias("spread"), share.alias("imbalance"))


def spread(tops: DataFrame) -> DataFrame:
    return measures(tops).drop("imbalance")


def imbalance(tops: DataFrame) -> DataFrame:
    return measures(tops).drop("spread")


def checkpoints(deltas: DataFrame, cadence: int) -> DataFrame:
    """The first change of each period of ``cadence``: where a checkpoint of the synced book is due."""
    return deltas.groupBy("sym", bucket("ts", cadence).alias("period")).agg(F.min("seq").alias("seq"), F.min_by("ts", "seq").alias("ts"))


def mid(tops: DataFrame) -> DataFrame:
    return tops.where("bid IS NOT NULL").select("sym", "seq", "ts", ((F.col("bid") + F.col("ask")) / 2.0 / PRICE).alias("mid"))
