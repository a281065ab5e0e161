"""Secret scans: multipart credential linking, by DataFrame operations only.

A credential has parts: an access identifier, a secret, an endpoint. Strong parts are reported wherever they stand.
Weak ones (a user name, a bare 40-character key, an address) are common in clean text, and are reported only when
complementary parts stand in the same scope: a strong part of another role, or parts of both other roles.

Scopes are joined as intervals: two parts are in one scope if they start within ``scope`` characters of each other.
Starts are binned by that length; of each bin and role the first and last start are kept, which is all that a part in
the same or a neighbouring bin needs to be compared with. So the join carries one row for each bin and role, and no
pairs of parts, however many a text has.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import free_name, small_or_shuffled, table, write_shared
from tidewheel.llm.quality_rules import bind

SCOPE = 240


class Kind(NamedTuple):
    """A pattern, with the least length of a match (of its last group, if ``group``); ``hint``: the text must hold it."""

    name: str
    pattern: str
    role: str
    strong: bool
    least: int
    group: int = 0
    exact: bool = False
    hint: str | None = None


#: In the order that breaks ties between spans of one start. Runs of one class are matched from the least length on,
#: which finds the same runs as matching all of them and dropping the short ones.
KINDS = (
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", True, 6, group=1),
    Kind("access", r"AKIA[A-Z0-9]{16,}", "id", True, 20, hint="AKIA"),
    Kind("hex", r"[0-9a-f]{24,}", "secret", True, 24),
    Kind("user", r"""(?i:username|user|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", "id", False, 3, group=1),
    Kind("key", r"[A-Za-z0-9+/]{40,}", "secret", False, 40, exact=True),
    Kind("endpoint", r"(?:(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"'<>]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]+)?)", "endpoint", False, 7),
)
ROLES = ("id", "secret", "endpoint")
SPAN = "struct<start:int,kind:int,end:int>"


def spans_of(text: Column, index: int) -> Column:
    """The spans of one kind, in code points: gaps and matches of one scan are laid end to end."""
    k = KINDS[index]

    def lay(found: Column, values: Column) -> Column:
        gaps = F.split(text, k.pattern, -1)
        sizes = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g")), lambda z: F.length(z["g"]) + F.length(z["m"]))
        return bind(running(sizes), lambda end: F.transform(F.filter(F.transform(F.arrays_zip(end.alias("e"), found.alias("m"), values.alias("v")), lambda z: F.struct((z["e"] - F.length(z["m"])).alias("start"), z["e"].alias("end"), F.length(z["m"]).alias("len"), F.length(z["v"]).alias("val"))), lambda x: (x["len"] == k.least) if k.exact else (x["val"] >= k.least)), lambda x: F.struct(x["start"].alias("start"), F.lit(index).alias("kind"), x["end"].alias("end"))))

    empty = F.array().cast(f"array<{SPAN}>")
    whole = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(k.group)) if k.group else None
    found = bind(whole, lambda m: F.when(F.size(m) == 0, empty).otherwise(lay(m, m if value is None else value)))
    return F.when(F.contains(text, F.lit(k.hint)), found).otherwise(empty) if k.hint else found


def _scan(values: Column, join, block: int = 256) -> Column:
    """Running results of ``join`` over an array of integers not below 0, which starts from 0.

    An array is grown step by step within blocks of 256 only, then over blocks, so a long one costs little more than its length.
    """

    def steps(own: Column) -> Column:
        grow = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(join(acc["at"], x))).alias("out"))
        return F.aggregate(own, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), grow, lambda acc: acc["out"])

    def blocks(whole: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / block).cast("int")), lambda i: steps(F.slice(whole, i * block + 1, block)))

    def joined(parts: Column) -> Column:
        before = steps(F.transform(parts, lambda p: F.element_at(p, -1)))
        return bind(before, lambda t: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: join(F.coalesce(F.get(t, i - 1), F.lit(0)), x)))))

    return F.when(F.size(values) <= block, steps(values)).otherwise(bind(blocks(values), joined))


def running(sizes: Column) -> Column:
    return _scan(sizes, lambda a, b: a + b)


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def linked(parts: DataFrame, scope: int) -> DataFrame:
    """The weak parts of ``parts`` (key, start, kind, end) that complementary parts in their scope support."""
    parts = parts.withColumn("role", _pick([k.role for k in KINDS], F.col("kind"))).withColumn("strong", _pick([k.strong for k in KINDS], F.col("kind")))
    parts = parts.withColumn("bin", F.floor(F.col("start") / scope).cast("int"))
    ends = [F.min("start").alias("lo"), F.max("start").alias("hi"), F.min(F.when(F.col("strong"), F.col("start"))).alias("strong_lo"), F.max(F.when(F.col("strong"), F.col("start"))).alias("strong_hi")]
    binned = parts.groupBy("key", "bin", F.col("role").alias("other")).agg(*ends)
    weak = parts.where(~F.col("strong")).select("key", "start", "kind", "end", "role", "bin", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("side"))
    near = weak.withColumn("bin", F.col("bin") + F.col("side")).join(binned, ["key", "bin"]).where("role <> other")

    def within(lo: str, hi: str) -> Column:
        return F.when(F.col("side") == 0, F.col(lo).isNotNull()).when(F.col("side") < 0, F.col("start") - F.col(hi) <= scope).otherwise(F.col(lo) - F.col("start") <= scope)

    met = near.groupBy("key", "start", "kind", "end").agg(F.max(F.coalesce(within("strong_lo", "strong_hi"), F.lit(False))).alias("by_strong"), F.size(F.collect_set(F.when(within("lo", "hi"), F.col("other")))).alias("roles"))
    return met.where("by_strong OR roles = 2").select("key", "start", "kind", "end")


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))


def scan(docs: DataFrame, scope: int = SCOPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``key``, ``base`` and ``found``: arrays of (start, kind, end), by start and kind, for each row of ``docs``.

    Offsets are code points of the whole text, ends exclusive; ``kind`` indexes ``KINDS``. A null or empty text has no
    span. Rows are told apart by id and text, so repeated rows get equal results; null ids are kept. An empty table
    gives an empty result. Other columns are left out.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = [spans_of(F.col("t"), i).alias(f"k{i}") for i in range(len(KINDS))]
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), t.alias("t"))
    rows = rows.select("doc_id", "key", *kinds)
    strong = F.flatten(F.array(*[F.col(f"k{i}") for i, k in enumerate(KINDS) if k.strong]))
    weak = F.flatten(F.array(*[F.col(f"k{i}") for i, k in enumerate(KINDS) if not k.strong]))
    rows = write_shared(rows.select("doc_id", "key", strong.alias("strong"), weak.alias("weak")), "parts")
    # one row of each text that has a weak part beside others
    several = rows.where((F.size("weak") > 0) & (F.size("weak") + F.size("strong") > 1)).groupBy("key").agg(F.first("strong").alias("strong"), F.first("weak").alias("weak"))
    parts = several.select("key", F.explode(F.concat("strong", "weak")).alias("p")).select("key", "p.*")
    more = linked(parts, scope).groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    # rows with no weak part need no join; those that have are few
    able = (F.size("weak") > 0) & (F.size("weak") + F.size("strong") > 1)
    plain = rows.where(~able).withColumn("more", F.array().cast(f"array<{SPAN}>"))
    joined = rows.where(able).join(more, "key", "left").withColumn("more", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))
    both = plain.unionByName(joined)
    return both.select("doc_id", "key", F.sort_array("strong").alias("base"), F.sort_array(F.concat("strong", "more")).alias("found"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _pick([k.name for k in KINDS], s["kind"]), s["start"], s["end"])), ",")


def merged(spans: Column) -> Column:
    """Spans, by start, as (start, end) with those that overlap or lie within others joined."""
    ends = F.transform(spans, lambda s: s["end"])
    # a span begins a group if none before it ends after its start
    return bind(_scan(ends, F.greatest), lambda most: bind(F.filter(F.transform(F.arrays_zip(spans.alias("s"), most.alias("e")), lambda z, i: F.struct(z["s"]["start"].alias("start"), i.alias("i"), (F.coalesce(F.get(most, i - 1), F.lit(0)) <= z["s"]["start"]).alias("new"))), lambda x: x["new"]), lambda heads: F.transform(heads, lambda h, j: F.struct(h["start"].alias("start"), F.get(most, F.coalesce(F.get(heads, j + 1)["i"], F.size(most)) - 1).alias("end")))))


def redact(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """``text`` with every span replaced; overlapping spans go together. The pieces between are joined once."""

    def built(groups: Column) -> Column:
        pieces = F.transform(groups, lambda g, i: bind(F.coalesce(F.get(groups, i - 1)["end"], F.lit(0)), lambda at: F.substring(text, at + 1, g["start"] - at)))
        rest = F.substring(text, F.element_at(groups, -1)["end"] + 1, F.length(text))
        return F.array_join(F.concat(pieces, F.array(rest)), by)

    return F.when(F.size(spans) == 0, text).otherwise(bind(merged(spans), built))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span found in ``text`` replaced. Texts are shuffled only if those with spans are many."""
    key, id_, mark = (free_name(docs, n) for n in ("tw_key", "tw_id", "tw_found"))
    found = scan(docs).where(F.size("found") > 0).select("doc_id", "key", "found").dropDuplicates(["doc_id", "key"]).toDF(id_, key, mark)
    found = write_shared(found, "found")
    same = (row_key(F.col("doc_id"), F.col("text")) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(id_))
    marked = docs.join(small_or_shuffled(found, 200_000), same, "left")
    text = F.when(F.col(mark).isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col(mark)))
    return marked.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def _kind_sql(i: int) -> str:
    k = KINDS[i]
    quoted = k.pattern.replace("'", "''")
    keep = f"length(v) = {k.least}" if k.exact else f"length(v) >= {k.least}"
    return f"""
k{i} AS (SELECT r, unnest(regexp_extract_all(t, '{quoted}', 0)) AS m, unnest(regexp_extract_all(t, '{quoted}', {k.group})) AS v,
       generate_subscripts(regexp_extract_all(t, '{quoted}', 0), 1) AS i,
       regexp_split_to_array(t, '{quoted}') AS g FROM d WHERE regexp_matches(t, '{quoted}')),
p{i} AS (SELECT r, {i} AS kind, m, v, sum(length(g[i]) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM k{i}),
s{i} AS (SELECT r, kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM p{i} WHERE {keep})"""


_NAMES = "CASE kind " + " ".join(f"WHEN {i} THEN '{k.name}'" for i, k in enumerate(KINDS)) + " END"
_ROLE = "CASE kind " + " ".join(f"WHEN {i} THEN '{k.role}'" for i, k in enumerate(KINDS)) + " END"
_N_STRONG = sum(k.strong for k in KINDS)
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),{",".join(_kind_sql(i) for i in range(len(KINDS)))},
a AS ({" UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(KINDS)))}),
n AS (SELECT *, {_NAMES} || ':' || s || ':' || e AS span, {_ROLE} AS role, kind < {_N_STRONG} AS strong FROM a),
w AS (SELECT x.r, x.kind, x.s, x.span FROM n x JOIN n y ON x.r = y.r AND x.role <> y.role AND abs(x.s - y.s) <= {SCOPE}
      WHERE NOT x.strong GROUP BY ALL HAVING bool_or(y.strong) OR count(DISTINCT y.role) = 2),
f AS (SELECT r, kind, s, span, TRUE AS base FROM n WHERE strong UNION ALL SELECT r, kind, s, span, FALSE FROM w),
o AS (SELECT r, count(*) FILTER (base AND kind = 0) AS n_assign, count(*) FILTER (base AND kind = 1) AS n_access,
             count(*) FILTER (base AND kind = 2) AS n_hex, string_agg(span, ',' ORDER BY s, kind) FILTER (base) AS b,
             string_agg(span, ',' ORDER BY s, kind) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (r)
"""
