"""Near-copies by SimHash over five-word shingles, each verified by the resemblance (Jaccard) of their sets.

Texts of equal sets are one. Candidates are verified exactly, without listing the pairs of a crowd:

1. *Fingerprint.* Texts have SimHash fingerprints of their five-word shingles, repeats included, and the balls of
   ``simhash.links`` find all that differ in ``simhash.RADIUS`` or fewer bits: their sets are candidates.
2. *Band.* At a resemblance of 0.8 fingerprints differ in about ten of 64 bits, too many for a ball around each. For
   pairs beyond the balls every set also has ``BANDS`` MinHash keys of ``ROWS`` minima; sets that share a key are
   candidates too. A pair at exactly 0.8 shares none with probability (1 - 0.8**5)**20 = 0.0004, and less above it.
   Sets that candidates connect, directly or over others, form a crowd; each set is in one.
3. *Compare with a core.* A crowd's core is what most of a bounded sample of it holds. Each set is its difference to the
   core from here on, for two sets differ by no more than their differences to it together. With w = 9 |difference| -
   |set|, two sets that have no difference in common are near-copies if and only if their w add up to 0 or less. So every
   set that is a near-copy of any other by that rule is one of the crowd's least w, and one row for each set tells it.
4. *Look for common differences.* Other pairs must share part of their differences: at least (w + w') / 18 of them. Sets
   are joined on those, rarest first, by prefixes that leave out what can't matter, and only pairs that can still reach
   the number are intersected.
5. *Connect.* Classes are the connected components over links, as for fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import dealt, forget, small_or_shuffled, write_shared
from tidewheel.llm.components import connected_components
from tidewheel.llm.simhash import hashes, links, majority

SEED, WIDTH = 42, 5
#: Near-copies have a resemblance of 4/5: twice the common part, times 9, is at least the sum of both sizes times 8.
BANDS, ROWS = 20, 5
#: Sets of a crowd that its core is drawn from, about; sets of a crowd in one task.
SAMPLE, SALT = 64, 2000
CHUNK = 4096
_ODD = np.random.default_rng(7).integers(0, 1 << 63, (BANDS * ROWS + ROWS + BANDS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MINIMA, _MIX, _BAND = _ODD[: BANDS * ROWS], _ODD[BANDS * ROWS : -BANDS, 0], _ODD[-BANDS:, 0]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Rising hashes of the different shingles. No word: none; fewer words than ``width``: one shingle."""
    return np.unique(hashes(text, width))


def bands(found: np.ndarray) -> np.ndarray:
    """One key for each band of minima; no key for no shingle."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), CHUNK):
        least = np.minimum(least, (_MINIMA * found[at : at + CHUNK]).min(axis=1))
    least ^= least >> np.uint64(31)
    return (((least.reshape(BANDS, ROWS) * _MIX).sum(axis=1) ^ _BAND) * _BAND).view(np.int64)


def _signatures(docs: DataFrame) -> DataFrame:
    """doc_id, th, ``sk`` (a hash of the set), its size and keys, and ``fp`` (the fingerprint as a signed long; null without
    a word), a row for each row of ``docs`` (doc_id, th, text).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sks, n, keys, fps = [], [], [], []
            for t in b.column(2):
                every = hashes(t.as_py(), WIDTH)
                found = np.unique(every)
                fps.append(majority(every))
                sks.append(xxhash.xxh64_intdigest(found.tobytes()))
                n.append(len(found))
                keys.append(bands(found))
            sk = pa.array(np.array(sks, np.uint64).view(np.int64))
            fp = pa.array(np.array(fps, np.uint64).view(np.int64), mask=np.array(n) == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sk, pa.array(n, pa.int32()), pa.array(keys, pa.list_(pa.int64())), fp], names=["doc_id", "th", "sk", "size", "keys", "fp"])

    return docs.mapInArrow(run, "doc_id long, th long, sk long, size int, keys array<long>, fp long")


def _sets(texts: DataFrame) -> DataFrame:
    """sk and shingles, of ``texts`` (sk, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["sk", "found"])

    return texts.mapInArrow(run, "sk long, found binary")


def resemble(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (src, dst) of ``pairs`` that are near-copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = ([np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(i)] for i in (2, 3))
            keep = pa.array([resemble(x, y) for x, y in zip(a, c, strict=True)], pa.bool_())
            yield b.select(["src", "dst"]).filter(keep)

    one = pairs.join(sets.withColumnsRenamed({"sk": "dst", "found": "b"}), "dst")
    both = one.join(sets.withColumnsRenamed({"sk": "src", "found": "a"}), "src")
    return both.select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def _cores(sample: DataFrame) -> DataFrame:
    """crowd and core: shingles that several sets of the ``sample`` (crowd, found) hold, rarest first, and how many do.

    ``half`` is the first of them that is part of the core: more than half of the sample hold it.
    """

    def run(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group["found"]]
        found, n = np.unique(np.concatenate(sets), return_counts=True)
        found, n = found[n > 1], n[n > 1]
        order = np.lexsort([found, n])
        found, n = found[order], n[order]
        return pa.table({"crowd": group["crowd"][:1], "common": pa.array([found.tobytes()], pa.binary()), "half": pa.array([int(np.searchsorted(2 * n, len(sets), "right"))], pa.int32())})

    return sample.groupBy("crowd").applyInArrow(run, "crowd long, common binary, half int")


def difference(found: np.ndarray, common: np.ndarray, half: int) -> np.ndarray:
    """What a set and the core do not both hold, rarest first: what the sample held once or never, then as ``common`` is ordered."""
    by_value = np.argsort(common)
    at = np.minimum(np.searchsorted(common[by_value], found), max(len(common) - 1, 0))
    known = common[by_value[at]] == found if len(common) else np.zeros(len(found), bool)
    ranks = by_value[at[known]]
    missing = np.setdiff1d(np.arange(half, len(common)), ranks, assume_unique=True)
    return np.concatenate([found[~known], common[np.sort(np.concatenate([ranks[ranks < half], missing]))]])


def _differences(sets: DataFrame) -> DataFrame:
    """crowd, sk, size, w and the difference to the core, of ``sets`` (crowd, sk, found, common, half)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, w, out = [], [], []
            for f, c, half in zip(b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
                found, common = (np.frombuffer(x.as_buffer(), np.uint64) if x.is_valid else np.zeros(0, np.uint64) for x in (f, c))
                d = difference(found, common, half or 0)
                size.append(len(found))
                w.append(9 * len(d) - len(found))
                out.append(d.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(w, pa.int64()), pa.array(out, pa.binary())], names=["crowd", "sk", "size", "w", "d"])

    return sets.select("crowd", "sk", "found", "common", "half").mapInArrow(run, "crowd long, sk long, size long, w long, d binary")


def _prefixes(sets: DataFrame) -> DataFrame:
    """crowd, tok, sk, size, w, rest, apart: the differences of each set by which a near-copy must be found.

    ``sets``: crowd, sk, size, w, d, low (the least w of any set that it may be paired with), apart. ``rest`` is how
    many differences there are from this one on: no pair that meets here first has more in common.
    """
    names = ["crowd", "tok", "sk", "size", "w", "rest", "apart"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crowd, sk, size, w, low = (b.column(i).to_numpy() for i in (0, 1, 2, 3, 5))
            apart = b.column(6).to_numpy(zero_copy_only=False)
            d = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(4)]
            least = np.maximum(-(-(w + low) // 18), 1)
            n = np.maximum([len(x) for x in d] - least + 1, 0)
            for at in range(0, len(d), 256):
                own = slice(at, at + 256)
                again = lambda x: pa.array(np.repeat(x[own], n[own]))  # noqa: B023, E731
                toks = np.concatenate([x[:k] for x, k in zip(d[own], n[own], strict=True)])
                rest = np.concatenate([np.arange(len(x), len(x) - k, -1) for x, k in zip(d[own], n[own], strict=True)])
                yield pa.RecordBatch.from_arrays([again(crowd), pa.array(toks), again(sk), again(size), again(w), pa.array(rest.astype(np.int64)), again(apart)], names=names)

    return sets.select("crowd", "sk", "size", "w", "d", "low", "apart").mapInArrow(run, "crowd long, tok long, sk long, size long, w long, rest long, apart boolean")


def _salted(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with ``salt``, so that a crowd of many sets is many tasks. ``sizes``: crowd, salts."""
    return rows.join(small_or_shuffled(sizes.where("salts > 1")), "crowd", "left").withColumn("salt", F.pmod(F.xxhash64("sk"), F.coalesce("salts", F.lit(1)).cast("long"))).drop("salts")


def _to_all(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows``, one for each crowd, once for each ``salt`` of it."""
    return rows.join(sizes, "crowd").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))).drop("salts")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``th`` and ``root``: a row for each row of ``docs``, with a hash of its text and of its class's least set.

    Texts without a word are one class. Null ids are kept, and take part in links. An empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("string").alias("text"))
    prints = write_shared(_signatures(rows), "signatures")
    distinct = prints.groupBy("sk").agg(F.min_by(F.struct("size", "keys"), F.struct("doc_id", "th")).alias("x"), F.min(F.struct("doc_id", "th")).alias("first"))
    distinct = write_shared(distinct.select("sk", "x.keys", F.col("first.doc_id").alias("id1"), F.col("first.th").alias("th1")), "distinct")
    # texts of one set may repeat its shingles unlike, so a set can have several fingerprints
    fps = write_shared(prints.where("fp IS NOT NULL").select("fp", "sk").distinct(), "fingerprints")
    reps = write_shared(fps.groupBy("fp").agg(F.min("sk").alias("rep")), "reps")
    balls = write_shared(links(reps.select("fp")), "balls")
    near = balls.join(reps.withColumnsRenamed({"fp": "src", "rep": "a"}), "src").join(reps.withColumnsRenamed({"fp": "dst", "rep": "b"}), "dst").where("a <> b")
    near = near.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    # sets of one fingerprint, or of one key of minima
    keyed = fps.select("sk", F.col("fp").alias("key")).unionByName(distinct.select("sk", F.explode("keys").alias("key")))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("sk").alias("lo")).where("n > 1")
    met = keyed.join(buckets, "key").where("sk <> lo").select(F.col("lo").alias("src"), F.col("sk").alias("dst"))
    met = write_shared(met.unionByName(near).distinct(), "met")
    crowds = connected_components(met).withColumnsRenamed({"node": "sk", "root": "crowd"})
    crowds = write_shared(crowds, "crowds")
    sizes = crowds.groupBy("crowd").agg(F.count(F.lit(1)).alias("n"))
    sizes = write_shared(sizes.select("crowd", "n", F.ceil(F.col("n") / SALT).cast("int").alias("salts")), "sizes")

    carriers = write_shared(distinct.drop("keys").join(crowds.select("sk"), "sk", "left_semi"), "carriers")
    same = F.col("doc_id").eqNullSafe(F.col("id1")) & (F.col("th") == F.col("th1"))
    texts = rows.join(small_or_shuffled(carriers, 1_000_000), same).select("sk", "text")
    sets = write_shared(_sets(texts).dropDuplicates(["sk"]).join(crowds, "sk"), "sets")

    # all sets of a small crowd are its sample; of a large one, about SAMPLE
    large = sizes.where(F.col("n") > SAMPLE).select("crowd", "n")
    share = F.pmod(F.xxhash64("sk", F.lit(SEED)), F.lit(1 << 30)) * F.coalesce("n", F.lit(0)) < F.lit(SAMPLE << 30)
    sample = sets.join(small_or_shuffled(large), "crowd", "left").where(share).select("crowd", "found")
    cores = write_shared(_cores(sample), "cores")
    salts = sizes.select("crowd", "salts")
    with_core = _salted(sets, salts).join(_to_all(cores, salts), ["crowd", "salt"], "left")
    parts = write_shared(_differences(with_core), "differences")

    hubs = parts.groupBy("crowd").agg(F.min(F.struct("w", "sk")).alias("x")).select("crowd", F.col("x.w").alias("least"), F.col("x.sk").alias("hub"))
    told = _salted(parts, salts).join(_to_all(hubs, salts), ["crowd", "salt"]).withColumn("apart", F.col("w") + F.col("least") > 0)
    told = write_shared(told.drop("salt"), "told")
    edges = told.where(~F.col("apart") & (F.col("sk") != F.col("hub"))).select(F.col("hub").alias("src"), F.col("sk").alias("dst"))
    # the rest: at least one of two is apart, so a set that isn't is paired with one that is
    opened = told.where("apart").groupBy("crowd").agg(F.min("w").alias("low1"))
    lows = _to_all(opened, salts)
    asked = _salted(told, salts).join(lows, ["crowd", "salt"]).withColumn("low", F.when(F.col("apart"), F.col("least")).otherwise(F.col("low1")))
    prefixes = write_shared(_prefixes(asked), "prefixes")
    left = prefixes.where("apart").drop("apart")
    right = prefixes.withColumnsRenamed({c: f"{c}2" for c in ("sk", "size", "w", "rest", "apart")})
    able = (F.col("sk") != F.col("sk2")) & (~F.col("apart2") | (F.col("sk") < F.col("sk2")))
    able &= (18 * F.least("rest", "rest2") >= F.col("w") + F.col("w2")) & (5 * F.least("size", "size2") >= 4 * F.greatest("size", "size2"))
    pairs = left.join(right, (left["crowd"] == right["crowd"]) & (left["tok"] == right["tok"]) & able).select(F.least("sk", "sk2").alias("src"), F.greatest("sk", "sk2").alias("dst")).distinct()
    more = write_shared(_verified(write_shared(pairs, "pairs"), sets.select("sk", "found")), "edges")
    comps = connected_components(write_shared(edges.unionByName(more), "links"))
    forget(distinct, fps, reps, balls, met, carriers, sets, cores, parts, prefixes)
    roots = write_shared(comps.select(F.col("node").alias("sk"), "root"), "roots")
    return dealt(prints, roots, "sk", ["doc_id", "th"], "left").select("doc_id", "th", F.coalesce("root", "sk").alias("root"))
