"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at three or fewer differing bits are found without comparing pairs of all, and without listing the
pairs of a crowded bucket:

1. *Puncture and emit.* The 64 bits are cut in three blocks. With one block masked, two linked fingerprints differ in
   at most two of the other bits for at least one choice of the block (or all their differences lie in that block), so
   if each emits every variant within half that radius (one bit) they meet at a common variant. Rows are shuffled on
   the variant. A fingerprint that meets no other is done; this is nearly all of them.
2. *Verify.* In buckets of up to ``FEW`` fingerprints duplicates are dropped and differing bits counted; of the links
   found only a spanning forest is emitted. Fingerprints of larger buckets take an exact way that compares none: they
   emit whole balls over all 64 bits, one bit around each, and two bits around those of odd parity. Sharing a point proves a link: one plus one, or one plus two. Linked
   fingerprints of odd distance differ in parity, so the wider ball is needed on one side only.
3. *Connect.* Classes are the connected components over links, by rounds of large-star and small-star.

Cost per distinct fingerprint is bounded (about 130 rows in step 1, at most 2,081 more in step 2), whatever the size
of a group of copies; exact copies of a fingerprint are one from the start. Buckets are counted by partial sums, and keys
of many rows are dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import dealt, free_name, small_or_shuffled, table, write_shared
from tidewheel.llm.components import connected_components

SEED, WIDTH, RADIUS = 42, 3, 3
#: Colliding pairs are verified in buckets of at most so many fingerprints; larger ones take the way by whole balls.
FEW = 1024
#: Blocks of the 64 bits, (first bit, end).
BLOCKS = ((0, 22), (22, 43), (43, 64))
CHUNK = 1 << 16
#: Rows of keys that a task spells out.
SPREAD = 1_000_000


def hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Hashes of the shingles, repeats included. No word: none; fewer words than ``width``: one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    parts = [words[i:] for i in range(width)] if len(words) >= width else [[b" ".join(words)]]
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*parts, strict=False)), dtype=np.uint64)


def majority(found: np.ndarray) -> int:
    """Bit i is set if it is in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(found), CHUNK):
        part = found[at : at + CHUNK].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found)).view(">u8")[0])


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Bit i is set if it is in over half the shingles' hashes. No word: 0; fewer words than ``width``: one shingle."""
    return majority(hashes(text, width))


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``th`` (a hash of the text) and ``fp`` (the 64 bits as a signed long), a row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(2)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "th", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _longs(values: list[int]):
    return F.array(*[F.lit(_signed(v)).cast("long") for v in values])


def _punctured(fps: DataFrame) -> DataFrame:
    """(key, fp) of step 1. The masked block holds the block's number, so that keys of different blocks differ."""
    every = (1 << 64) - 1
    keys = []
    for b, (lo, hi) in enumerate(BLOCKS):
        mask = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        rest = F.col("fp").bitwiseAND(F.lit(_signed(every ^ mask)).cast("long")).bitwiseOR(F.lit(_signed((b + 1) << lo)).cast("long"))
        flips = _longs([0] + [1 << i for i in range(64) if not lo <= i < hi])
        keys.append(F.transform(flips, rest.bitwiseXOR))
    return fps.select(F.explode(F.concat(*keys)).alias("key"), "fp")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, dst) of links that connect, in each list of colliding fingerprints, all that are linked in it."""
    for b in batches:
        src, dst = [], []
        for fps in b.column(0):
            left = np.unique(np.asarray(fps.values, dtype=np.int64))
            while len(left) > 1:  # grows one tree at a time, so that no pair is kept that isn't needed
                edge, left = [left[0]], left[1:]
                while edge and len(left):
                    at = edge.pop()
                    near = np.bitwise_count((left ^ at).view(np.uint64)) <= RADIUS
                    src += [at] * int(near.sum())
                    dst += left[near].tolist()
                    edge += left[near].tolist()
                    left = left[~near]
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def links(fps: DataFrame) -> DataFrame:
    """(src, dst) pairs of fingerprints at ``RADIUS`` or fewer bits that connect all that are linked.

    ``fps`` has distinct values in column ``fp``.
    """
    # each row becomes 132, so a small table is dealt out first
    keyed = _punctured(fps.repartition(max(2, 132 * fps.count() // SPREAD), "fp"))
    busy = write_shared(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "busy")
    met = write_shared(keyed.join(small_or_shuffled(busy), "key"), "met")
    few = met.where(F.col("n") <= FEW).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_verified, "src long, dst long").distinct()
    crowd = met.where(F.col("n") > FEW).select("fp").distinct()
    # the points of whole balls: kind 0, one bit around all; kind 1, where an even one (one bit) meets odd ones (two bits)
    ones = [1 << i for i in range(64)]
    twos = [a | b for i, a in enumerate(ones) for b in ones[:i]]
    odd = F.bit_count("fp") % 2 == 1
    wide = fps.sparkSession.createDataFrame([(_signed(x),) for x in twos], "m long").agg(F.collect_list("m").alias("m"))
    around = crowd.select("fp", F.lit(0).alias("kind"), F.explode(F.transform(_longs([0, *ones]), lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    even = crowd.where(~odd).select("fp", F.lit(1).alias("kind"), F.explode(F.transform(_longs(ones), lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    far = crowd.where(odd).crossJoin(F.broadcast(wide)).select("fp", F.lit(1).alias("kind"), F.explode(F.transform("m", lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    by_point = Window.partitionBy("kind", "point")
    hub = F.when(F.col("kind") == 0, F.min("fp").over(by_point)).otherwise(F.min(F.when(~odd, F.col("fp"))).over(by_point))
    balls = around.unionByName(even).unionByName(far).select("fp", hub.alias("hub")).where("hub <> fp").select(F.col("hub").alias("src"), F.col("fp").alias("dst")).distinct()
    return few.unionByName(balls)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``th``, ``fp``, ``root`` and ``component_id``: the smallest doc_id reachable over links, itself included.

    ``root`` is the class's least fingerprint, ``th`` a hash of the text (which tells rows of one id apart).
    One row for each row of ``docs``. Null and empty texts have fingerprint zero and are linked like any other; rows
    with a null id keep it, and take part in links (their class is null only if no row in it has an id). Repeated rows
    are classed alike. An empty table gives an empty result.
    """
    prints = write_shared(with_fingerprints(docs, doc_id, text), "prints")
    distinct = write_shared(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    edges = write_shared(links(distinct.select("fp")), "links")
    comps = connected_components(edges)  # node, root: only fingerprints that have a link
    named = write_shared(comps.join(distinct, comps["node"] == distinct["fp"]).select("root", "fp", "rep"), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = dealt(named, least, "root", ["fp"]).select("fp", "root", "component_id")
    classes = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "rep").alias("component_id"))
    return dealt(prints, write_shared(classes, "classes"), "fp", ["doc_id", "th"]).select("doc_id", "th", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, classes: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: the one of least id (null last), then text hash.

    ``classes`` gives doc_id, ``th`` and ``root`` of each row. Texts are shuffled only if the rows that go are many.
    """
    found = write_shared(classes(docs), "classes")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th"))
    first = found.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.doc_id").alias("id1"), F.col("first.th").alias("th1"))
    told = dealt(found, first, "root", ["doc_id", "th"]).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("id1")) & (F.col("th") == F.col("th1")))
    id_, th = free_name(docs, "tw_id"), free_name(docs, "tw_th")
    rows = told.groupBy(F.col("doc_id").alias(id_), F.col("th").alias(th)).agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("times"))
    odd = write_shared(rows.where("NOT stays OR times > 1"), "odd")  # the rows that go, and those that stay once of several
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(th))
    plain = docs.join(small_or_shuffled(odd.select(id_, th)), same, "left_anti")
    several = docs.join(small_or_shuffled(odd.where("stays").select(id_, th)), same, "left_semi")
    # of rows equal in id and text, the one of least hash of all columns
    one = several.groupBy("doc_id", F.xxhash64("text").alias(th)).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("tw_row"))
    return plain.unionByName(one.select("tw_row.*"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
