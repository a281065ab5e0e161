"""Shadow books: a venue's snapshots and changes reconciled into a gapless stream of our own.

An unseeded book takes the first message as its start and emits nothing. A snapshot emits the difference to what we
hold, as corrections, and nothing if it agrees; a change after a gap is a correction, any other an update.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.operators.book import Sides
from tidewheel.operators.series import bucket, by_number, running

DELTA = "sym int, ts long, recv long, seq long, kind int, side int, price_raw long, qty_raw long"
_COLUMNS = [f.split()[0] for f in DELTA.split(", ")]
CADENCE = 60_000_000_000


class ShadowBook:
    def __init__(self, levels: list[tuple[int, int, int]] | None = None, seq: int = 0, last_checkpoint: int | None = None) -> None:
        self.book, self.seq, self.last_checkpoint = None if levels is None else Sides(levels), seq, last_checkpoint

    def ingest(self, snapshot: bool, gapped: bool, levels: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """(seq, kind, side, price, qty) of the changes that one message makes."""
        if self.book is None:
            self.book = Sides(levels)
            return []
        if snapshot:
            held, said = self.book.levels(), {(s, p): q for s, p, q in levels if q > 0}
            changes = [(s, p, said.get((s, p), 0)) for s, p in sorted(held.keys() | said.keys()) if held.get((s, p), 0) != said.get((s, p), 0)]
        else:
            changes = levels
        out = []
        for level in changes:
            self.seq += 1
            self.book.set(*level)
            out.append((self.seq, int(snapshot or gapped), *level))
        return out

    def checkpoint_due(self, recv: int, cadence: int = CADENCE) -> bool:
        """True once in each period of ``cadence`` in which a seeded book is asked."""
        period = recv - recv % cadence
        if self.book is None or period == self.last_checkpoint:
            return False
        self.last_checkpoint = period
        return True


def fold(sym: int, messages: pd.DataFrame, book: ShadowBook) -> pd.DataFrame:
    """The changes of ``messages`` (recv, ts, snapshot, gapped, levels), which come in order of ``recv``."""
    out = []
    for ts, recv, snapshot, gapped, levels in messages[["ts", "recv", "snapshot", "gapped", "levels"]].itertuples(index=False):
        flat = [(int(x["side"]), int(x["price_raw"]), int(x["qty_raw"])) for x in levels]
        out += [(sym, ts, recv, *change) for change in book.ingest(bool(snapshot), bool(gapped), flat)]
    return pd.DataFrame(out, columns=_COLUMNS)


def reconcile(messages: DataFrame, block: int = CADENCE, ties: tuple[str, ...] = ()) -> DataFrame:
    """The stream of all symbols' messages (sym, ts, recv, snapshot, gapped, levels array<struct<side, price_raw, qty_raw>>).

    What ``ShadowBook`` says message by message, in generated code: after a snapshot the book is what it says, so an
    epoch from one snapshot to the next needs only the epoch before it. Running numbers are taken in blocks of ``block``
    ns of ``recv``, so one symbol is many tasks. Messages of one reception come by the columns ``ties``, then by venue
    time, snapshots last.
    """
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).alias(c)
    m = messages.select("sym", "ts", "recv", flag("snapshot"), flag("gapped"), "levels", *ties)
    # the whole row is the order: no two evaluations number ties differently
    m = running(m, {"n": (F.lit(1).cast("long"), "sum"), "epoch": (F.col("snapshot").cast("long"), "sum")}, bucket("recv", block), ("recv", *ties, "ts", "snapshot", "gapped", "levels"))
    # the first message seeds the book, whatever it is, and emits nothing
    m = m.withColumn("resets", F.col("snapshot") & (F.col("n") > 1)).withColumn("at", F.shiftleft("n", 24))
    level = ["side", "price_raw", "qty_raw"]
    lines = m.select("sym", "ts", "recv", "n", "at", "epoch", "resets", "gapped", F.posexplode("levels").alias("pos", "x")).select("*", *[F.col(f"x.{c}").cast("long" if c != "side" else "int").alias(c) for c in level])
    sent = lines.where(~F.col("resets") & (F.col("n") > 1)).select("sym", "ts", "recv", "n", F.col("pos").alias("first"), F.lit(0).cast("long").alias("then"), F.col("gapped").cast("int").alias("kind"), *level)
    # of each level: what the snapshot at the start of its epoch said, and what was held at the epoch's end
    own = lines.where(~F.col("resets") | (F.col("qty_raw") > 0)).withColumn("at", F.col("at") + F.col("pos"))
    ends = own.groupBy("sym", "epoch", "side", "price_raw").agg(F.max_by("qty_raw", "at").alias("held"), F.max_by("qty_raw", F.when(F.col("resets"), F.col("at"))).alias("said"))
    none = F.lit(None).cast("long")
    sides = ends.select("sym", "side", "price_raw", F.explode(F.array(F.struct("epoch", none.alias("was"), F.col("said").alias("now")), F.struct((F.col("epoch") + 1).alias("epoch"), F.when(F.col("held") > 0, F.col("held")).alias("was"), none.alias("now")))).alias("x"))
    both = sides.groupBy("sym", "x.epoch", "side", "price_raw").agg(F.max("x.was").alias("was"), F.max("x.now").alias("qty_raw"))
    moved = both.withColumn("qty_raw", F.coalesce("qty_raw", F.lit(0).cast("long"))).where("coalesce(was, 0) <> qty_raw")
    starts = m.where("resets").select("sym", "epoch", "ts", "recv", "n")
    righted = moved.join(starts, ["sym", "epoch"]).select("sym", "ts", "recv", "n", F.col("side").alias("first"), F.col("price_raw").alias("then"), F.lit(1).alias("kind"), *level)
    out = running(sent.unionByName(righted), {"seq": (F.lit(1).cast("long"), "sum")}, by_number("n", 1 << 14), ("n", "first", "then"))
    return out.select(*[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in DELTA.split(", ")])
