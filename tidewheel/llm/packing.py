"""Packing into optimal length buckets.

Dynamic programming over the global histogram of lengths chooses the bucket boundaries that pad least. Batches of a
token budget form inside each bucket, over slices of bounded size, so that no bucket is sorted in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import n_words, table, write_shared

MAX_LEN, BUCKETS, BUDGET = 2048, 12, 65536
#: Documents of one slice of a bucket, which one task sorts.
SLICE = 16384


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Upper bounds of at most ``buckets`` buckets over ``lengths`` (rising) that pad least, and that padding.

    best[j] after k rounds is the least padding of the first j lengths in k buckets; a bucket is padded to its longest.
    """
    m = len(lengths)
    if not m:
        return [], 0
    c = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    t = np.concatenate([[0], np.cumsum(counts.astype(np.int64) * lengths.astype(np.int64))])
    best, back = [np.full(m + 1, np.iinfo(np.int64).max // 4)], []
    best[0][0] = 0
    for _ in range(min(buckets, m)):
        now, cut = np.full(m + 1, np.iinfo(np.int64).max // 4), np.zeros(m + 1, dtype=np.int64)
        now[0] = 0
        for j in range(1, m + 1):
            cost = best[-1][:j] + lengths[j - 1] * (c[j] - c[:j]) - (t[j] - t[:j])
            cut[j] = int(np.argmin(cost))
            now[j] = cost[cut[j]]
        best.append(now)
        back.append(cut)
    out, j = [], m
    for cut in reversed(back):
        if j:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return out[::-1], int(best[-1][m])


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, bucket_len, batch_id, slot: a row for each piece of each row of ``docs``.

    Lengths are in words. A document longer than ``max_len`` is cut into whole pieces, none dropped; ``start`` is the
    first word's place. Pieces of a batch are padded to ``bucket_len`` and together stay within ``budget``. Rows
    without words (null or blank) have one piece of length 0 with null bucket and batch. Repeated rows are packed one
    by one. Only the histogram, of at most ``max_len`` rows, comes to the driver. ``budget`` must be ``max_len`` at least.
    """
    if budget < max_len:
        raise ValueError("budget is smaller than max_len")
    sized = docs.select(F.col(doc_id).alias("doc_id"), n_words(F.col(text)).alias("n"), F.monotonically_increasing_id().alias("row"))
    last = F.greatest(F.floor((F.col("n") - 1) / max_len), F.lit(0)).cast("int")
    pieces = sized.select("doc_id", "n", "row", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = (F.col("piece") * max_len).cast("long")
    pieces = write_shared(pieces.select("doc_id", "row", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(max_len)).alias("length")), "pieces")
    histogram = pieces.where("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("length")
    bounds, _ = boundaries(histogram["length"].to_numpy(), histogram["n"].to_numpy(), buckets)
    none = pieces.where("length = 0").drop("row").select("*", F.lit(None).cast("int").alias("bucket_len"), F.lit(None).cast("string").alias("batch_id"), F.lit(None).cast("int").alias("slot"))
    if not bounds:
        return none
    in_bucket = histogram.groupby(np.searchsorted(bounds, histogram["length"]))["n"].sum()
    slices = [int(-(-in_bucket.get(b, 0) // SLICE)) or 1 for b in range(len(bounds))]
    at = F.lit(len(bounds) - 1)
    for b in reversed(range(len(bounds) - 1)):
        at = F.when(F.col("length") <= bounds[b], b).otherwise(at)
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i)
    rows = pieces.where("length > 0").withColumn("b", at).withColumn("bucket_len", pick(bounds, F.col("b")))
    # dealt by the row's number, written with it, so that null ids and copies of one row are dealt out too
    rows = rows.withColumn("s", F.pmod(F.xxhash64("row", "piece"), pick(slices, F.col("b")).cast("long")))
    seat = F.row_number().over(Window.partitionBy("b", "s").orderBy("doc_id", "piece", "row")) - 1
    room = F.floor(F.lit(budget) / F.col("bucket_len")).cast("int")
    rows = rows.withColumn("seat", seat)
    batch = F.concat_ws("-", "bucket_len", "s", F.floor(F.col("seat") / room))
    rows = rows.select("doc_id", "piece", "start", "length", "bucket_len", batch.alias("batch_id"), (F.col("seat") % room).cast("int").alias("slot"))
    return rows.unionByName(none)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
