"""Toxicity by class-conditional Kneser-Ney models of characters.

Each class has a model of the next sign given all signs of the word so far, with the word's end as a sign of its own.
Counts are over the different words of each document, so a burst within one says no more than one use. Absolute discounts go to a distribution that both classes share: Kneser-Ney counts of the same signs
over both classes, which back off to the number of different word beginnings that a sign ends. So a rare expression has
nearly the same probability in both classes. A document's score is the difference of the two log-likelihoods of all its
different words, normalised by the number of their signs, and calibrated by pooling adjacent
violators over scores of each fold under the other's counts. Each sign's difference is shrunken towards 0 by ``MARGIN``
nats, on both sides: smaller ones are differences of style or language that add up over a long text.

Counts are rows of a distributed table and grow with the corpus. Signs whose models agree are dropped from it; what is
left is broadcast up to ``MOST`` rows, and beyond that joined to the signs of the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import forget, held_out, isotonic, labelled, write_shared
from tidewheel.llm.common import table as read

#: Discount of the class counts and of the shared ones; documents that the shared distribution weighs as.
DISCOUNT, SHARED_DISCOUNT, SHARED = 1.0, 0.75, 50.0
#: Nats by which each sign's log ratio is shrunken; signs that a text must have besides its own before its mean counts in full.
MARGIN, PRIOR = 0.5, 1500
CUT = 0.7
#: Rows of the table of ratios that may be broadcast (of 32 bytes each).
MOST = 1_500_000
#: Texts, and words, that a task takes at a time; words whose totals it remembers.
CHUNK, WORDS, REMEMBERED = 256, 32768, 100_000
_BINS, _SPAN = 8000, 1.0
VIEWS = ("whole", "without0", "without2")


def _signs() -> bytes:
    """Letters in lower case, digits and all bytes outside ASCII are signs; anything else ends a word."""
    signs = bytearray(b" " * 256)
    for b in (*range(48, 58), *range(97, 123), *range(128, 256)):
        signs[b] = b
    for b in range(65, 91):
        signs[b] = b + 32
    return bytes(signs)


_SIGNS = _signs()
_TERMS = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").translate(_SIGNS).split())


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each sign of each word, its end included: the key of the word up to it, and up to the sign before; the sign; the word's number.

    A key is a 64-bit polynomial of the signs; 0 is the empty beginning.
    """
    n = np.fromiter(map(len, words), np.int64, len(words)) + 1
    c = np.frombuffer(b" ".join([*words, b""]), np.uint8) if words else np.zeros(0, np.uint8)
    start = np.repeat(np.cumsum(n) - n, n)
    deep = np.arange(len(c)) - start
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(n.max(initial=1)), _BASE)]), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TERMS[c] * powers[deep], dtype=np.uint64)])
    own, above = sums[1:] - sums[start], np.where(deep > 0, sums[:-1] - sums[start], np.uint64(0))
    return own.view(np.int64), above.view(np.int64), c, np.repeat(np.arange(len(words)), n)


def count_nodes(rows: DataFrame) -> DataFrame:
    """key, above, sign, n00, n01, n20, n21: how often each word beginning stands in the different words of each text of ``rows``
    (text, fold, label), by fold and label.

    Words are counted first, in and over partitions, so each different one is spelled out once.
    """
    counts = [f"n{f}{y}" for f in (0, 2) for y in (0, 1)]
    numbers = ", ".join(f"{c} long" for c in counts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                held: tuple[Counter, ...] = tuple(Counter() for _ in range(4))
                for text, fold, label in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    held[(fold == 2) * 2 + label].update(words_of(text.as_py()))
                words = list(set().union(*held))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array(map(h.__getitem__, words), pa.int64()) for h in held)], names=["word", *counts])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, WORDS):
                b = whole.slice(at, WORDS)
                own, above, sign, of = spelled(b.column(0).to_pylist())
                keys, first, where = np.unique(own, return_index=True, return_inverse=True)
                n = [np.bincount(where, weights=b.column(i).to_numpy()[of], minlength=len(keys)).astype(np.int64) for i in range(1, 5)]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(above[first]), pa.array(sign[first].astype(np.int32)), *map(pa.array, n)], names=["key", "above", "sign", *counts])

    words = rows.select("text", "fold", "label").mapInArrow(count, f"word binary, {numbers}").groupBy("word").agg(*[F.sum(c).alias(c) for c in counts])
    found = words.mapInArrow(spell, f"key long, above long, sign int, {numbers}")
    return found.groupBy("key").agg(F.min("above").alias("above"), F.min("sign").alias("sign"), *[F.sum(c).alias(c) for c in counts])


def _of(view: str, label: int) -> Column:
    folds = {"whole": (0, 2), "without0": (2,), "without2": (0,)}[view]
    return sum((F.col(f"n{f}{label}") for f in folds[1:]), F.col(f"n{folds[0]}{label}"))


def _shrunk(ratio: Column) -> Column:
    return (F.signum(ratio) * F.greatest(F.abs(ratio) - MARGIN, F.lit(0.0))).cast("float")


def ratios(counts: DataFrame) -> DataFrame:
    """key, and for each of ``VIEWS`` r_ and u_: the shrunken log ratio of the key's last sign, and that of a sign never seen after it.

    ``counts`` is written already. Keys all of whose numbers are 0 are left out.
    """
    pairs = [(v, y) for v in VIEWS for y in (0, 1)]
    pooled = _of("whole", 0) + _of("whole", 1)
    sums = [F.sum(_of(v, y)).alias(f"t_{v}{y}") for v, y in pairs] + [F.sum(F.least(_of(v, y).cast("double"), F.lit(DISCOUNT))).alias(f"c_{v}{y}") for v, y in pairs]
    above = counts.groupBy("above").agg(F.sum(pooled).alias("t_all"), F.count(F.lit(1)).alias("kinds"), *sums)
    ends = {r["sign"]: r["n"] for r in counts.groupBy("sign").agg(F.count(F.lit(1)).alias("n")).collect()}  # 256 signs at most
    total = sum(ends.values()) + 0.5 * 256
    low = F.element_at(F.array(*[F.lit((ends.get(s, 0) + 0.5) / total) for s in range(256)]), F.col("sign") + 1)
    shared = (pooled - SHARED_DISCOUNT + (SHARED_DISCOUNT * F.col("kinds") + 1.0) * low) / (F.col("t_all") + 1.0)

    def left(v: str, y: int) -> Column:
        return (F.col(f"c_{v}{y}") + SHARED) / (F.col(f"t_{v}{y}") + SHARED)

    def p(v: str, y: int) -> Column:
        return F.greatest(_of(v, y) - DISCOUNT, F.lit(0.0)) / (F.col(f"t_{v}{y}") + SHARED) + left(v, y) * F.col("shared")

    unseen = above.select("above", "t_all", "kinds", *sums_of(pairs), *[_shrunk(F.log(left(v, 1)) - F.log(left(v, 0))).alias(f"u_{v}") for v in VIEWS])
    seen = counts.join(unseen, "above").withColumn("shared", shared)
    seen = seen.select("key", *[_shrunk(F.log(p(v, 1)) - F.log(p(v, 0))).alias(f"r_{v}") for v in VIEWS], F.expr(" OR ".join(f"u_{v} <> 0" for v in VIEWS)).alias("told"))
    both = seen.join(unseen.select(F.col("above").alias("key"), *[f"u_{v}" for v in VIEWS]), "key", "full_outer")
    numbers = [f"{k}_{v}" for v in VIEWS for k in "ru"]
    return both.where("told OR " + " OR ".join(f"{c} <> 0" for c in numbers)).select("key", *[F.coalesce(c, F.lit(0.0).cast("float")).alias(c) for c in numbers])


def sums_of(pairs: list[tuple[str, int]]) -> list[str]:
    return [f"{k}_{v}{y}" for v, y in pairs for k in "tc"]


class Ratios:
    """The table of ratios in memory, for tasks."""

    def __init__(self, rows: DataFrame) -> None:
        got = rows.toArrow().sort_by("key")
        self.keys = got["key"].to_numpy()
        self.of = {c: got[c].to_numpy() for c in got.column_names[1:]}

    def totals(self, words: list[bytes], view: str) -> np.ndarray:
        """The summed log ratios of words."""
        own, above, _, of = spelled(words)
        if not len(self.keys) or not words:
            return np.zeros(len(words))
        at, up = (np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1) for x in (own, above))
        unseen = np.where(self.keys[up] == above, self.of[f"u_{view}"][up], 0)
        return np.bincount(of, weights=np.where(self.keys[at] == own, self.of[f"r_{view}"][at], unseen), minlength=len(words))


class _Known:
    """Totals of words under one view; a task remembers so many, then starts afresh."""

    def __init__(self, ratio: Ratios, view: str) -> None:
        self.ratio, self.view, self.of = ratio, view, {}

    def learn(self, words: set[bytes]) -> None:
        if len(self.of) > REMEMBERED:
            self.of = {}
        new = [w for w in words if w not in self.of]
        for at in range(0, len(new), WORDS):
            some = new[at : at + WORDS]
            self.of.update(zip(some, self.ratio.totals(some, self.view).tolist(), strict=True))


def scores(rows: DataFrame, table: DataFrame, most: int = MOST) -> DataFrame:
    """``rows`` with ``s``, the normalised difference of log-likelihoods of ``text``, which is left out, under ``view``.

    A table of up to ``most`` rows goes to the tasks. A larger one is joined to the signs of the texts' words, which are
    shuffled then; common signs are told apart by the join's handling of skew.
    """
    keep = [c for c in rows.columns if c not in ("text", "view")]
    form = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    ordered = rows.select(*keep, "view", "text")
    normal = lambda words: sum(map(len, words)) + len(words) + PRIOR
    if table.count() <= most:
        ratio = Ratios(table)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = {v: _Known(ratio, v) for v in VIEWS}
            for whole in batches:
                for at in range(0, whole.num_rows, CHUNK):
                    b = whole.slice(at, CHUNK)
                    words = [words_of(t.as_py()) for t in b.column(len(keep) + 1)]
                    views = b.column(len(keep)).to_pylist()
                    for v in set(views):
                        known[v].learn(set().union(*(w for w, x in zip(words, views, strict=True) if x == v)))
                    out = [sum(map(known[v].of.__getitem__, sorted(w))) / normal(w) for w, v in zip(words, views, strict=True)]
                    yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(out, pa.float64())], names=[*keep, "s"])

        return ordered.mapInArrow(run, f"{form}, s double")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                found = [spelled(list(words_of(t.as_py()))) for t in b.column(len(keep) + 1)]
                lists = [pa.array([x[i] for x in found], pa.list_(pa.int64())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep) + 1], *lists], names=[*keep, "view", "keys", "above"])

    texts = write_shared(ordered.mapInArrow(spell, f"{form}, view string, keys array<long>, above array<long>").withColumn("tw_row", F.monotonically_increasing_id()), "spelled")
    pick = lambda k: F.coalesce(*[F.when(F.col("view") == v, F.col(f"{k}_{v}")) for v in VIEWS])
    signs = texts.select("tw_row", "view", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("above").alias("above"))).alias("x")).select("tw_row", "view", "x.*")
    own = signs.join(table.select("key", *[f"r_{v}" for v in VIEWS]), "key", "left").select("tw_row", "view", "above", pick("r").alias("r"))
    up = table.select(F.col("key").alias("above"), *[f"u_{v}" for v in VIEWS])
    sums = own.join(up, "above", "left").groupBy("tw_row").agg(F.sum(F.coalesce("r", pick("u"), F.lit(0.0)).cast("double")).alias("total"))
    return texts.join(sums, "tw_row", "left").select(*keep, (F.coalesce("total", F.lit(0.0)) / (F.size("keys") + PRIOR)).alias("s"))


def fit(rows: DataFrame) -> tuple[DataFrame | None, tuple[np.ndarray, np.ndarray]]:
    """The table of ratios, and scores and probabilities between which scores are calibrated.

    The calibration uses scores of each fold under counts of the other, so that no text is scored by counts of its
    own; scores are gathered as a histogram. With one fold only, or one label only, there is no table and scores are
    flat at the share of label 1 (a half where nothing is labelled).
    """
    rows = write_shared(rows, "labelled")
    have = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    if any((f, y) not in have for f in (0, 2) for y in (0, 1)):
        n = sum(have.values())
        share = min(max(sum(c for (_, y), c in have.items() if y) / n, 0.01), 0.99) if n else 0.5
        return None, (np.array([0.0]), np.array([share]))
    counts = write_shared(count_nodes(rows), "counts")
    table = write_shared(ratios(counts), "ratios")
    crossed = scores(rows.select("text", "label", F.concat(F.lit("without"), F.col("fold")).alias("view")), table)
    place = F.least(F.greatest(F.floor((F.col("s") + _SPAN) * (_BINS / (2 * _SPAN))), F.lit(0)), F.lit(_BINS - 1)).cast("int")
    h = crossed.groupBy(place.alias("bin")).agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).orderBy("bin").toPandas()
    forget(rows, counts)
    x = (h["bin"].to_numpy() + 0.5) * (2 * _SPAN / _BINS) - _SPAN
    return table, isotonic(x, h["ones"].to_numpy(dtype=np.float64), h["n"].to_numpy(dtype=np.float64))


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = CUT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of ``docs``.

    Learns only from rows of ``labels`` (doc_id, toxic) whose id's remainder is not 1. Null and empty texts are scored
    as texts of no sign. Repeated rows score alike; null ids are scored but not learned from; an empty table gives an
    empty result; without labels every score is a half. Other columns are left out.
    """
    table, (x, y) = fit(labelled(docs, labels, "toxic", doc_id, text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"))
    if table is None:
        return rows.withColumn("score", F.lit(float(y[0]))).withColumn("predicted", (F.col("score") >= cut).cast("int"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.lit("whole").alias("view"), F.col(text).alias("text"))

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.interp(b.column(2).to_numpy(zero_copy_only=False), x, y).clip(0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return scores(rows, table).mapInArrow(calibrate, "doc_id long, held_out boolean, score double, predicted int")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
