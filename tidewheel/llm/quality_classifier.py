"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Features approximate a Gaussian kernel. Normal equations are summed inside each partition, then over partitions; the
driver solves a system of fixed size. Calibration pools adjacent violators over a histogram of scores that each fold
got from the other's equations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import held_out, isotonic, labelled, learnable, remainder, table, write_shared
from tidewheel.llm.quality_rules import STOP_WORDS

COMPONENTS, BANDWIDTH, RIDGE, SEED = 192, 3.0, 1.0, 23
BINS, CUT = 1000, 0.5
#: Sums of partitions are dealt to so many tasks before they meet in one.
ROUND = 64
STATISTICS = (
    "log_words", "mean_word", "log_longest", "distinct_words", "distinct_triples", "repeated_lines", "log_words_per_line",
    "digits", "capitals", "symbols", "punctuation", "not_ascii", "stop_words", "ends_per_word",
)
_STOP = frozenset(STOP_WORDS)
_DIGITS, _CAPITALS = np.arange(48, 58), np.arange(65, 91)
_SYMBOLS = np.frombuffer(b"#*$%&|<>{}[]\\^~_=+@/", np.uint8)
_PUNCTUATION = np.frombuffer(b".,;:!?'\"()-", np.uint8)
_ENDS = np.frombuffer(b".!?", np.uint8)


def statistics(text: str | None) -> list[float]:
    """The ``STATISTICS`` of a whole text. A null text is taken as empty."""
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words = text.split()
    n, size = len(words), max(int(raw.sum()), 1)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    lengths = [len(w) for w in words] or [0]
    per = max(n, 1)
    share = lambda which: float(raw[which].sum()) / size
    return [
        np.log1p(n), np.log1p(sum(lengths) / per), np.log1p(max(lengths)), len(set(words)) / per,
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(n - 2, 1), 1 - len(set(lines)) / max(len(lines), 1),
        np.log1p(n / max(len(lines), 1)), share(_DIGITS), share(_CAPITALS), share(_SYMBOLS), share(_PUNCTUATION),
        float(raw[128:].sum()) / size, sum(w.lower() in _STOP for w in words) / per, float(raw[_ENDS].sum()) / per,
    ]


def with_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), x], names=["doc_id", "x"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


class Model:
    """Standardised statistics to random features to a calibrated score."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, components: int = COMPONENTS, bandwidth: float = BANDWIDTH, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = r.normal(0, 1 / bandwidth, (len(mean), components))
        self.b = r.uniform(0, 2 * np.pi, components)
        self.beta: np.ndarray | None = None
        self.knots = (np.array([0.0]), np.array([0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.beta, *self.knots), 0, 1) if len(x) else np.zeros(0)


def solve(a: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients from a[:, :-1] (sum of z z') and a[:, -1] (sum of z y); the intercept isn't penalised."""
    penalty = np.eye(len(a)) * ridge
    penalty[-1, -1] = 1e-9
    return np.linalg.solve(a[:, :-1] + penalty, a[:, -1])


def normal_equations(rows: DataFrame, model: Model) -> dict[int, np.ndarray]:
    """For each fold of ``rows`` (x, fold, label) the matrix that ``solve`` takes, summed in and over partitions.

    Sums of partitions are added in two rounds, so that no task takes a row of every partition.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in batches:
            for fold, own in part.groupby("fold"):
                z = model.features(np.stack(own["x"].to_numpy()))
                sums[int(fold)] = sums.get(int(fold), 0) + z.T @ np.hstack([z, own["label"].to_numpy(dtype=np.float64)[:, None]])
        for fold, a in sums.items():
            yield pd.DataFrame({"fold": fold, "i": np.arange(len(a)), "v": list(a)})

    def total(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": part["fold"].iloc[:1], "i": part["i"].iloc[:1], "v": [np.stack(part["v"].to_numpy()).sum(0)]})

    form = "fold int, i int, v array<double>"
    out: dict[int, np.ndarray] = {}
    own = rows.select("x", "fold", "label").mapInPandas(local, form).withColumn("some", F.spark_partition_id() % ROUND)
    summed = own.groupBy("fold", "i", "some").applyInPandas(total, form).groupBy("fold", "i").applyInPandas(total, form)
    for r in summed.collect():
        a = out.setdefault(r["fold"], np.zeros((len(model.b) + 1, len(model.b) + 2)))
        a[r["i"]] = r["v"]
    return out


def fit(rows: DataFrame) -> Model | None:
    """A model from ``rows`` (x, fold, label); None if nothing is labelled."""
    n = len(STATISTICS)
    sums = rows.agg(F.count(F.lit(1)), *[F.avg(F.get("x", F.lit(i))) for i in range(n)], *[F.stddev_pop(F.get("x", F.lit(i))) for i in range(n)]).first()
    if not sums[0]:
        return None
    model = Model(np.array(sums[1 : n + 1], dtype=np.float64), np.array(sums[n + 1 :], dtype=np.float64))
    folds = normal_equations(rows, model)
    model.beta = solve(sum(folds.values()), RIDGE)
    crossed = {f: solve(sum(a for g, a in folds.items() if g != f), RIDGE) if len(folds) > 1 else model.beta for f in folds}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for fold, own in part.groupby("fold"):
                s = model.features(np.stack(own["x"].to_numpy())) @ crossed[int(fold)]
                yield pd.DataFrame({"bin": np.clip((s + 1) * (BINS / 3), 0, BINS - 1).astype(np.int32), "label": own["label"].to_numpy()})

    h = rows.select("x", "fold", "label").mapInPandas(score, "bin int, label int").groupBy("bin").agg(F.sum("label").alias("ones"), F.count(F.lit(1)).alias("n")).toPandas().sort_values("bin")
    model.knots = isotonic((h["bin"].to_numpy() + 0.5) * (3 / BINS) - 1, h["ones"].to_numpy(dtype=np.float64), h["n"].to_numpy(dtype=np.float64))
    return model


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of ``docs``.

    Learns only from rows of ``labels`` (doc_id, quality) whose id's remainder is not 1; repeated labels are averaged.
    Null and empty texts are scored by the statistics of an empty text. Repeated rows score alike; null ids are scored,
    not learned from; an empty table gives an empty result; without labels every score is a half. Texts are read once:
    their statistics are kept in the shared folder.
    """
    rows = write_shared(with_statistics(docs, doc_id, text), "statistics")
    return scored(rows, labels, cut)


def scored(rows: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    known = labels.where(F.col("quality").isNotNull() & learnable("doc_id")).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    learned = rows.where(learnable("doc_id")).join(known, "doc_id").select("x", remainder("doc_id").cast("int").alias("fold"), "label")
    model = fit(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(2).flatten()).reshape(-1, len(STATISTICS))
            p = np.full(b.num_rows, 0.5) if model is None else model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", held_out().alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that the classifier rejects. Reads labelled texts to fit, then all; no shuffle of text
    but to find the labelled ones if labels are too many to broadcast. Without labels all rows stay."""
    rows = labelled(docs, labels, "quality")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([statistics(t.as_py()) for t in b.column(0)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, b.column(1), b.column(2)], names=["x", "fold", "label"])

    model = fit(write_shared(rows.mapInArrow(measure, "x array<double>, fold int, label int"), "labelled"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(at)], dtype=np.float64).reshape(-1, len(STATISTICS))
            yield b.filter(pa.array(model.score(x) >= cut))

    return docs if model is None else docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
