"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of several tables hashes a vector by quantised Gaussian projections. A query visits its own bucket and perturbed
ones, in the order of their estimated success; what the tables find is merged, and distances are computed on the
original vectors. How many buckets to probe is fitted: for a bounded sample of queries the true neighbours are found by
a full scan, and the least number of probes is taken that reaches the recall aimed at. All rows are indexed.

Buckets are dealt to groups of bounded size, and a bucket too large for one (copies of a vector) over several, all of
which its probes visit. Rows are placed once in each table; queries stream past the group's rows, so a task holds one
group and no list of queries. A group that very many queries visit is placed once for each ``BLOCK`` of them. Each group
returns its nearest few for each query, so no list of candidates is ever shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import small_or_shuffled, table, write_shared

TABLES, HASHES, WIDTH, MOST_PROBES, RECALL, SEED = 4, 8, 1.8, 3000, 0.97, 3
#: Queries whose true neighbours are found to fit the probes; rows of the index in a group; queries that one copy of a group serves.
SAMPLE, GROUP, BLOCK = 48, 8000, 20000
#: Queries whose probes are spelled out at a time; factor by which buckets widen while no number of probes does.
CHUNK, WIDER = 64, 1.5


class Index:
    """Projections, and perturbations of a bucket in the order in which they are expected to succeed."""

    def __init__(self, dim: int, width: float, tables: int = TABLES, hashes: int = HASHES, most: int = MOST_PROBES, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.a = r.normal(size=(tables, dim, hashes))
        self.b = r.uniform(0, 1, (tables, hashes)) * width
        self.factors = r.integers(1, 1 << 62, (tables, hashes)) * 2 + 1
        self.width, self.tables, self.hashes = width, tables, hashes
        self.steps = self._order(most)
        self.probes = len(self.steps)
        self.hot: dict[int, int] = {}
        self.groups = 1

    def _order(self, most: int) -> np.ndarray:
        """Rows of 0 and 1 over the 2 * hashes borders of a bucket, nearest border first: which to step over.

        Scores are the expected squared distances of the j-th nearest border; sets grow from the best by shifting or
        extending the last step, and none steps over both borders of one projection.
        """
        m = self.hashes
        near = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
        far = [1 - j / (m + 1) + j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m, 0, -1)]
        score = near + far
        rows, heap = [np.zeros(2 * m)], [(score[0], (0,))]
        while heap and len(rows) < most:
            s, own = heapq.heappop(heap)
            if all(2 * m - 1 - j not in own for j in own):
                row = np.zeros(2 * m)
                row[list(own)] = 1
                rows.append(row)
            last = own[-1]
            if last + 1 < 2 * m:
                heapq.heappush(heap, (s - score[last] + score[last + 1], (*own[:-1], last + 1)))
                heapq.heappush(heap, (s + score[last + 1], (*own, last + 1)))
        return np.array(rows, dtype=np.int64)

    def codes(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Bucket codes of table ``t`` and places within the bucket."""
        h = x @ self.a[t] + self.b[t]
        cell = np.floor(h / self.width)
        with np.errstate(over="ignore"):
            return (cell.astype(np.int64) * self.factors[t]).sum(axis=1) + t, h - cell * self.width

    def visited(self, q: np.ndarray, t: int, probes: int) -> np.ndarray:
        """The codes that one query visits in table ``t``, in order."""
        code, place = self.codes(q[None], t)
        borders = np.concatenate([place[0], self.width - place[0]])
        order = np.argsort(borders, kind="stable")
        with np.errstate(over="ignore"):
            step = np.concatenate([-self.factors[t], self.factors[t]])[order]
            return code[0] + self.steps[:probes] @ step

    def group(self, code: np.ndarray, salt: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((code + salt * 0x1F3D5B79) * 0x5851F42D4C957F2D).view(np.uint64) >> np.uint64(33)).astype(np.int64) % self.groups


def vectors(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part, repeated rows once."""
    v = F.col(embedding).cast("array<double>")
    fit = F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(fit).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).dropDuplicates()


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(-1, dim)


def _nearest(q: np.ndarray, own: int, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the k nearest rows but the query's own, nearest first, ties to the smaller id."""
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    d[ids == own] = np.inf
    if len(d) > 4 * k:
        some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    else:
        some = np.arange(len(d))
    best = some[np.lexsort((ids[some], d[some]))][:k]
    best = best[np.isfinite(d[best])]
    return best, d[best]


def scan(rows: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """query_id, vec_id, score, v: the true neighbours of a few queries, by a pass over all rows."""
    dim = len(queries[0][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = _matrix(b.column(1), dim), np.asarray(b.column(0))
            out = [(q, int(ids[i]), float(s), x[i]) for q, v in queries for i, s in zip(*_nearest(v, q, x, ids, k), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())))], names=["query_id", "vec_id", "score", "v"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double, v array<double>")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)


def fit(rows: DataFrame, dim: int, every: int, k: int, recall: float = RECALL) -> Index | None:
    """An index whose probes reach ``recall`` on a sample of the queries; None if no query has a neighbour.

    Buckets are widened until some number of probes does; in the end one bucket holds all.
    """
    picked = rows.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE).collect()
    queries = [(r["vec_id"], np.array(r["v"])) for r in picked]
    if not queries:
        return None
    true = scan(rows, queries, k).collect()
    farthest = [max(r["score"] for r in true if r["query_id"] == q) for q in {r["query_id"] for r in true}]
    if not farthest:
        return None
    width, by_id = WIDTH * (float(np.median(farthest)) or 1.0), dict(queries)
    near = {q: np.array([r["v"] for r in true if r["query_id"] == q]) for q in by_id}
    while True:
        index, first = Index(dim, width), []
        for q, v in by_id.items():
            if len(near[q]):
                at = np.full(len(near[q]), MOST_PROBES + 1)
                for t in range(index.tables):
                    where = {c: i for i, c in reversed(list(enumerate(index.visited(v, t, index.probes).tolist())))}
                    at = np.minimum(at, [where.get(c, MOST_PROBES + 1) for c in index.codes(near[q], t)[0].tolist()])
                first += at.tolist()
        need = int(np.sort(first)[min(len(first) - 1, int(np.ceil(recall * len(first))) - 1)]) + 1
        if need <= index.probes:
            index.probes = need
            return index
        width *= WIDER


def search(rows: DataFrame, every: int = 100, k: int = 10, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by ``every`` the ``k`` nearest found.

    Nearest first by Euclidean distance in double precision, ties to the smaller id; all candidates if there are fewer
    than ``k``. Rows whose id or vector is null, whose vector is zero, empty or holds null or non-finite numbers take no
    part, nor do vectors of another length than the most common. Rows equal in id and vector count once; a query's own
    id is no candidate. A query that the probes give fewer than ``k`` is compared with all rows. An empty table gives
    an empty result; other columns are left out.
    """
    all_rows = write_shared(vectors(rows, vec_id, embedding), "vectors")
    lengths = all_rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    dim, n = lengths["dim"], lengths["count"]
    own = all_rows.where(F.size("v") == dim)
    index = fit(own, dim, every, k, recall)
    n_queries = own.where(F.col("vec_id") % every == 0).count()
    if not n_queries:
        return empty
    found = write_shared(_probe(own, index, every, k, n, dim), "found") if index else None
    if found is not None:
        counts = own.where(F.col("vec_id") % every == 0).select("vec_id").distinct().join(found.groupBy(F.col("query_id").alias("vec_id")).count(), "vec_id", "left")
        short = write_shared(counts.where(F.coalesce("count", F.lit(0)) < min(k, n - 1)).select("vec_id"), "short")
        if short.isEmpty():
            return found
        rest = own.join(short, "vec_id", "left_semi")
        done = found.join(short, found["query_id"] == short["vec_id"], "left_anti")
        return done.unionByName(_probe(own, None, every, k, n, dim, rest))
    return _probe(own, None, every, k, n, dim)


def _probe(rows: DataFrame, index: Index | None, every: int, k: int, n: int, dim: int, queries: DataFrame | None = None) -> DataFrame:
    """The search itself. Without an index every group is visited as a whole."""
    if index is None:
        index, whole = Index(dim, 1.0, tables=1, hashes=2), True
    else:
        whole = False
    most = max(GROUP // 4, index.tables * n // 256)  # no more than 256 buckets are larger
    if not whole:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(0), dim)
                code, times = np.unique(np.concatenate([index.codes(x, t)[0] for t in range(index.tables)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(times)], names=["code", "n"])

        large = rows.select("v").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") > most).collect()
        index.hot = {r["code"]: -(-r["n"] // most) for r in large}
    index.groups = max(1, -(-index.tables * n // GROUP))

    names = ["grp", "kind", "id", "v", "codes"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = _matrix(b.column(1), dim), np.asarray(b.column(0))
            for t in range(index.tables):
                code = index.codes(x, t)[0]
                salt = np.zeros(len(code), np.int64)
                own = ((ids * 0x5DEECE66D) >> 7) & 0xFFFFFF
                if whole:
                    code, salt = np.zeros(len(code), np.int64), own
                elif index.hot:
                    salt = np.array([s % index.hot.get(c, 1) for c, s in zip(code.tolist(), own.tolist(), strict=True)], dtype=np.int64)
                grp = index.group(code, salt)
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(np.zeros(len(grp), np.int32)), b.column(0), b.column(1), pa.array(code[:, None].tolist(), pa.list_(pa.int64()))], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
        for full in batches:
            for begin in range(0, full.num_rows, CHUNK):
                b, out = full.slice(begin, CHUNK), []
                for q, v in zip(np.asarray(b.column(0)).tolist(), _matrix(b.column(1), dim), strict=True):
                    if whole:
                        parts = {g: None for g in range(index.groups)}
                    else:
                        codes = np.concatenate([index.visited(v, t, index.probes) for t in range(index.tables)])
                        pairs = [(index.group(codes, np.zeros(len(codes), np.int64)), codes)]
                        for c in codes.tolist() if index.hot else ():
                            if c in index.hot:
                                salts = np.arange(1, index.hot[c])
                                pairs.append((index.group(np.full(len(salts), c), salts), np.full(len(salts), c)))
                        grp, codes = (np.concatenate([p[j] for p in pairs]) for j in (0, 1))
                        order = np.argsort(grp, kind="stable")
                        cuts = np.flatnonzero(np.diff(grp[order])) + 1
                        parts = {int(grp[o[0]]): np.unique(codes[o]) for o in np.split(order, cuts)}
                    out += [(g, 1, q, v, c) for g, c in parts.items()]
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)], names=names)

    def answer(code: np.ndarray, ids: np.ndarray, x: np.ndarray, part: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for q, v, codes in zip(part["id"].to_pylist(), _matrix(part["v"], dim), part["codes"], strict=True):
            if not codes.is_valid:
                some = np.arange(len(code))
            else:
                codes = np.asarray(codes.values)
                edge = np.zeros(len(code) + 1, np.int64)
                np.add.at(edge, np.searchsorted(code, codes, "left"), 1)
                np.add.at(edge, np.searchsorted(code, codes, "right"), -1)
                some = np.flatnonzero(np.cumsum(edge[:-1]))
            if len(some):
                best, d = _nearest(v, q, x[some], ids[some], k * index.tables)  # a row may come once from each table
                once = np.sort(np.unique(ids[some[best]], return_index=True)[1])[:k]
                yield q, ids[some[best]][once], d[once]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group: first those of the index, which are kept, then its queries."""
        now, held, sorted_ = None, [], None
        for b in batches:
            marks = np.stack([b[c].to_numpy() for c in ("grp", "salt", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            for at, to in pairwise(cuts):
                if at == to:
                    continue
                part, own = b.slice(at, to - at), (marks[at, 0], marks[at, 1])
                if own != now:
                    now, held, sorted_ = own, [], None
                if marks[at, 2] == 0:
                    held.append((np.asarray(part["codes"].flatten()), part["id"].to_numpy(), _matrix(part["v"], dim)))
                elif held:
                    if sorted_ is None:
                        code, ids, x = (np.concatenate([h[i] for h in held]) for i in range(3))
                        order = np.argsort(code, kind="stable")
                        sorted_, held = (code[order], ids[order], x[order]), [None]
                    out += answer(*sorted_, part)
            q = np.concatenate([np.full(len(o[1]), o[0]) for o in out] or [np.zeros(0, np.int64)])
            flat = [np.concatenate([o[i] for o in out] or [np.zeros(0)]) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(flat[0].astype(np.int64)), pa.array(flat[1].astype(np.float64))], names=["query_id", "vec_id", "score"])

    form = "grp long, kind int, id long, v array<double>, codes array<long>"
    asked = rows.where(F.col("vec_id") % every == 0) if queries is None else queries
    placed = rows.select("vec_id", "v").mapInArrow(place, form)
    probes = write_shared(asked.select("vec_id", "v").mapInArrow(ask, form), "probes")
    crowded = probes.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts")).where("salts > 1")
    crowded = small_or_shuffled(write_shared(crowded, "crowded"))
    salts = F.coalesce("salts", F.lit(1))
    copies = placed.join(crowded, "grp", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    dealt = probes.join(crowded, "grp", "left").withColumn("salt", F.pmod(F.xxhash64("id"), salts.cast("long")).cast("int"))
    both = copies.unionByName(dealt).drop("salts").repartition("grp", "salt").sortWithinPartitions("grp", "salt", "kind")
    near = both.mapInArrow(meet, "query_id long, vec_id long, score double")
    merged = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op3_ann(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
