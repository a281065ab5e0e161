"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets are found by water filling over the table of sources. Each document draws an exponential key, divided by its
quality weight; a source's remainder after complete epochs is filled in order of the keys. The running sum that this
needs is never taken over a whole source in one task: keys are dealt into 1,024 bins whose sizes are summed, then the
one bin where the budget ends into 1,024 more, and only documents of that last bin (a millionth of a source) are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import n_words, small_or_shuffled, table, write_shared
from tidewheel.llm.quality_rules import SYMBOLS

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BINS = 1024


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by the id, the text and the seed: 48 bits of an MD5. Rows without an id, or of one, differ by text."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def quality_weight(text: Column) -> Column:
    """1 for plain prose, towards 0.1 as symbols take over."""
    n = F.length(F.coalesce(text, F.lit("")))
    symbols = n - F.length(F.translate(F.coalesce(text, F.lit("")), SYMBOLS, ""))
    return 1.0 / (1.0 + 9.0 * symbols.cast("double") / F.greatest(n, F.lit(1)).cast("double"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target. ``sizes`` has a row for each source.

    Sources are ranked by code point, null last, and weigh ``weights``, repeating. ``share`` of all words is divided by
    weight; no target is over ``most`` times its source, and the excess goes to the others by weight until none is.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights)).cast("int"))
    ranked = ranked.withColumn("w", w)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    level = (share * F.sum("source_size").over(all_rows) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(rest)
    # the first source, by rising size per weight, that its share would not fill: from there on the level is even
    levels = ranked.withColumn("level", level).withColumn("even", F.col("level") * F.col("w") <= most * F.col("source_size"))
    held = F.min(F.when(F.col("even"), F.struct(F.col("source_size") / F.col("w"), "rank", "level"))).over(all_rows)["level"]
    full = most * F.col("source_size")
    return levels.select("source", "source_size", F.coalesce(F.least(held * F.col("w"), full), full).cast("double").alias("target"))


def _cut(bins: DataFrame, prior: str | None) -> DataFrame:
    """source and the bin where the budget ends: its number and what comes before it. ``bins``: source, bin, n, rest."""
    run = Window.partitionBy("source").orderBy("bin")
    summed = bins.withColumn("upto", F.sum("n").over(run) + (F.col(prior) if prior else F.lit(0)))
    return summed.where((F.col("upto") - F.col("n") < F.col("rest")) & (F.col("rest") < F.col("upto"))).select("source", "bin", (F.col("upto") - F.col("n")).alias("before"))


def mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share: float = SHARE, most: float = MOST, doc_id: str = "doc_id", text: str = "text", source: str = "source", whole_rows: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: a row for each row of ``docs``.

    ``taken`` is the words that the mix takes of a document: whole epochs, and once more if it is drawn for the
    fraction that is left; of a source they differ from the target by half a document at most. A null text has no
    words; null sources are a source; rows of one id, or none, draw by their texts; repeated rows are taken one by one,
    ties in keys by id and size. A source without words has target 0. An empty table gives an empty result. With ``whole_rows`` a
    struct ``row`` of all columns of ``docs`` comes along; else other columns are left out.
    """
    key = -F.log(uniform(F.col(doc_id), F.col(text), seed)) / quality_weight(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), key.alias("key"), *([F.struct("*").alias("row")] if whole_rows else []))
    place = F.least(F.floor((1.0 - F.exp(-F.col("key"))) * float(BINS * BINS)), F.lit(BINS * BINS - 1))
    rows = rows.withColumn("bin1", F.floor(place / BINS).cast("int")).withColumn("bin2", (place % BINS).cast("int"))
    rows = write_shared(rows, "sized")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = write_shared(goals.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")

    def by_source(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        b = small_or_shuffled(b.withColumnRenamed("source", "of"))
        return a.join(b, a["source"].eqNullSafe(b["of"]), how).drop("of")

    first = by_source(rows.groupBy("source", F.col("bin1").alias("bin")).agg(F.sum("size").alias("n")), goals.select("source", "rest"))
    first = write_shared(_cut(first, None).withColumnsRenamed({"bin": "cut1", "before": "before1"}), "cut1")
    inside = by_source(rows, first).where("bin1 = cut1").groupBy("source", F.col("bin2").alias("bin"), "before1").agg(F.sum("size").alias("n"))
    inside = write_shared(inside, "inside")
    second = write_shared(_cut(by_source(inside, goals.select("source", "rest")), "before1").withColumnsRenamed({"bin": "cut2", "before": "before2"}), "cut2")
    ends = write_shared(by_source(by_source(goals, first, "left"), second, "left"), "ends")

    told = by_source(rows, ends)
    # no bin holds the end: it falls between two, or there is nothing left to fill
    last = F.coalesce((F.col("bin1") == F.col("cut1")) & (F.col("bin2") == F.col("cut2")), F.lit(False))
    run = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ordered = told.where(last).withColumn("more", F.col("before2") + F.sum("size").over(run) - F.col("size") / 2 <= F.col("rest"))
    bins = by_source(rows.groupBy("source", "bin1").agg(F.sum("size").alias("n")), goals.select("source", "rest"))
    bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bin1"))).where("upto <= rest").groupBy("source").agg(F.max("bin1").alias("whole"))
    inner = by_source(inside, goals.select("source", "rest")).withColumn("upto", F.col("before1") + F.sum("n").over(Window.partitionBy("source").orderBy("bin"))).where("upto <= rest").groupBy("source").agg(F.max("bin").alias("whole2"))
    other = by_source(by_source(told.where(~last), write_shared(bins, "whole"), "left"), write_shared(inner, "whole2"), "left")
    other = other.withColumn("more", F.coalesce(F.col("bin1") <= F.col("whole"), F.lit(False)) | F.coalesce((F.col("bin1") == F.col("cut1")) & (F.col("bin2") <= F.col("whole2")), F.lit(False))).drop("whole", "whole2")
    taken = F.col("size") * (F.col("epochs") + F.col("more").cast("long"))
    return ordered.unionByName(other).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *(["row"] if whole_rows else []))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken. Rows without words are not."""
    taken = mix(docs, whole_rows=True, **how).where("taken > 0")
    times = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return taken.select("row", F.explode(times).alias("time")).select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
z AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
        -ln((CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(t)), 1, 12)) AS BIGINT) + 0.5) / 281474976710656.0)
        / (1.0 / (1.0 + 9.0 * CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS DOUBLE) / greatest(length(t), 1))) AS k FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((rank - 1) % 3 + 1 AS INT)]::DOUBLE AS w FROM r),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY source_size / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
h AS (SELECT level AS held FROM l WHERE level * w <= 2.0 * source_size ORDER BY source_size / w, rank LIMIT 1),
g AS (SELECT source, source_size, coalesce(least((SELECT held FROM h) * w, 2.0 * source_size), 2.0 * source_size) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM g),
c AS (SELECT z.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        sum(size) OVER (PARTITION BY z.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM z JOIN e ON z.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
