"""What the corpus operators share: reading tables, the learning split, and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``.

    Only a purely local session (driver and executors in one process) may go without the setting; it then gets a
    temporary folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = tempfile.mkdtemp(prefix="tidewheel-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: ``df`` as a Parquet table in the shared folder, read again.

    The table survives lost executors and is removed when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewheel-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    fs, folder = _folder(spark, path)
    fs.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.tw_path = path
    return out


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def forget(*written: DataFrame) -> None:
    """Deletes tables of ``write_shared`` that no later plan reads; other frames are left alone."""
    for df in written:
        if path := getattr(df, "tw_path", None):
            fs, folder = _folder(df.sparkSession, path)
            fs.delete(folder, True)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def held_out(doc_id: str = "doc_id") -> Column:
    """True where the remainder is 1. Null ids are not held out, and never learned from either."""
    return F.coalesce(remainder(doc_id) == 1, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    return F.coalesce(remainder(doc_id) != 1, F.lit(False))


def n_words(text: Column) -> Column:
    """Number of words, without a Python function; null text has none."""
    single = F.regexp_replace(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES)), SPACE_CLASS + "+", " ")
    gaps = F.length(single) - F.length(F.replace(single, F.lit(" "), F.lit("")))
    return F.when(single == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def labelled(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """text, fold (the id's remainder) and label of the rows that may be learned from. Repeated labels are averaged."""
    known = labels.where(F.col(label).isNotNull() & learnable("doc_id")).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(learnable("doc_id"))
    return rows.join(small_or_shuffled(known), "doc_id").select("text", remainder("doc_id").cast("int").alias("fold"), "label")


def isotonic(scores: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function that fits best: adjacent violators are pooled. ``scores`` rise."""
    blocks: list[list[float]] = []  # ones, count, sum of score * count
    for s, y, n in zip(scores, ones, counts, strict=True):
        blocks.append([y, n, s * n])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def small_or_shuffled(side: DataFrame, most: int = 2_000_000) -> DataFrame:
    """A hint to broadcast ``side`` if it has at most ``most`` rows (of a few numbers each); else it is shuffled.

    All rows are counted, in parallel: a limit would gather its rows in one task.
    """
    return F.broadcast(side) if side.count() <= most else side


def dealt(rows: DataFrame, one: DataFrame, key: str, by: list[str], how: str = "inner", most: int = 2000) -> DataFrame:
    """``rows`` joined to ``one``, which has a row for each ``key``.

    Rows of a key that has more than ``most`` are dealt over several tasks by a hash of the columns ``by``, and the row
    of ``one`` goes to each. Rows of a key are counted first, summed before they are shuffled.
    """
    hot = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).cast("long").alias("tw_salts")).where("tw_salts > 1")
    hot = small_or_shuffled(write_shared(hot, "hot"))
    salt = F.pmod(F.xxhash64(*by), F.coalesce("tw_salts", F.lit(1).cast("long")))
    left = rows.join(hot, key, "left").withColumn("tw_salt", salt).drop("tw_salts")
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce("tw_salts", F.lit(1).cast("long")) - 1)
    right = one.join(hot, key, "left").withColumn("tw_salt", F.explode(salts)).drop("tw_salts")
    return left.join(right, [key, "tw_salt"], how).drop("tw_salt")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
