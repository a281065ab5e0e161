"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import SPACE_CLASS, SPACES, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Frequent function words of the languages expected; a parameter.
STOP_WORDS = (
    "the of and to in is that it for on with as be this are was at by have from what which"
    " der die das und ist nicht ein eine zu mit von auf für dem den"
    " le la les de des et un une que qui dans pour pas est sur"
    " el los las que y en un una por con para se del"
).split()


class Rule(NamedTuple):
    """A document fails if ``top / bottom`` is under ``low`` or over ``high``. A ratio over nothing passes."""

    name: str
    top: str
    bottom: str
    low: float | None
    high: float | None


#: name, ratio, least, most
RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.05, None),
    Rule("dup_line_ratio", "n_dup_lines", "n_lines", None, 0.3),
    Rule("shouted_word_ratio", "n_shouted", "n_words", None, 0.3),
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text, the first included.

    Windows are hashed, sorted and compared with their neighbours; linear but for the sort.
    """

    def covered(by_hash: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(by_hash, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(by_hash, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def windows(w: Column) -> Column:
        at = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), at))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(windows(words), covered)).cast("long")


def measures(text: Column, stop_words: list[str]) -> Column:
    """A struct of the counts that rules refer to, of a whole text."""

    def of(words: Column, full: Column, t: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(full).cast("long").alias("n_lines"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(stop_words))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1))).cast("long").alias("n_shouted"),
        )

    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")

    def words(t: Column) -> Column:
        return F.filter(F.split(t, SPACE_CLASS + "+"), lambda w: w != "")

    return bind(F.coalesce(text, F.lit("")), lambda t: bind(words(t), lambda w: bind(lines(t), lambda full: of(w, full, t))))


def failed(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that the measures ``m`` break."""

    def breaks(r: Rule) -> Column:
        ratio = F.when(m[r.bottom] > 0, m[r.top] / m[r.bottom])
        parts = [c for c in (r.low is not None and ratio < r.low, r.high is not None and ratio > r.high) if c is not False]
        return F.coalesce(parts[0] if len(parts) == 1 else parts[0] | parts[1], F.lit(False))

    return F.array_compact(F.array(*[F.when(breaks(r), F.lit(r.name)) for r in rules]))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: list[str] = STOP_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts, ``base_failed``, ``kept`` and ``failed_rules``, a row for each row of ``docs``.

    A null or blank text has no words and is not kept. Other columns of ``docs`` are left out, so clashing names do no
    harm; repeated rows are judged one by one; an empty table gives an empty result. No shuffle.
    """
    m = F.col("m")
    rows = docs.select(F.col(doc_id).alias("doc_id"), measures(F.col(text), stop_words).alias("m"))
    base = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    names = failed(m, rules)
    kept = ~base & (F.size(names) == 0)
    counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select("doc_id", *counts, base.alias("base_failed"), kept.alias("kept"), F.array_join(names, ",").alias("failed_rules"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


def _rule_sql(r: Rule) -> str:
    ratio = f"(CAST({r.top} AS DOUBLE) / {r.bottom})"
    parts = [f"{ratio} < {r.low}"] * (r.low is not None) + [f"{ratio} > {r.high}"] * (r.high is not None)
    return f"CASE WHEN {r.bottom} > 0 AND ({' OR '.join(parts)}) THEN '{r.name}' END"


OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM d),
u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM s),
g AS (SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS tri FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
k AS (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM g WHERE tri IS NOT NULL),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
             len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(full_lines) AS n_lines,
             len(list_filter(w, lambda x: lower(x) IN ({", ".join(repr(x) for x in sorted(set(STOP_WORDS)))}))) AS n_stop_words,
             len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 1)) AS n_shouted
      FROM s LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
             concat_ws(',', {", ".join(_rule_sql(r) for r in RULES)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f
"""
