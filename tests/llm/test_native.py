"""Secret scans, quality rules, mixing and packing: against DuckDB, and on small odd tables."""

import random
import re
from hashlib import sha256
from itertools import pairwise

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import mixing, packing, quality_rules, secret_scan
from tidewheel.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t string, m string, key string"
LONG = "word " * 40_000


def table(spark, rows, odd=True):
    """Documents of (id, text) or (id, text, source), with columns whose names operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", "y", "z") for r in rows]
    df = spark.createDataFrame(full, DOCS)
    return df if odd else df.drop("t", "m", "key")


ODD = [(1, None), (None, "null id"), (2, ""), (3, " \t\n"), (4, LONG), (5, "twice"), (5, "twice"), (6, "naïve 😀 text")]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    res = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    tidy = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert tidy(df.select(names).collect()) == tidy(res.fetchall())


def plain_base(text):
    """The base of the contract, by the letter."""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_secret_base_by_the_letter(spark):
    r = random.Random(2)
    bits = ["token", "TOKEN", "api_key", "apikey", "password", "=", ":", " ", " ", '"', "'", "abc", "abcdef0", "é", "😀", "AKIA", "AKIA" + "Z9" * 8, "0123456789abcdef" * 2, "\n", "=", "-", "x"]
    rows = [(i, "".join(r.choices(bits, k=r.randint(0, 60)))) for i in range(300)]
    got = {x["doc_id"]: x["b"] for x in secret_scan.scan(table(spark, rows)).select("doc_id", secret_scan.written(F.col("base")).alias("b")).collect()}
    for i, t in rows:
        assert got[i] == plain_base(t), t


def test_secret_links(spark):
    rows = [
        (1, "user=alice sent to https://example.org/a"),  # no secret: weak parts alone
        (2, "login: alice password=hunter22 at https://db.example.org/x"),
        (3, "login: alice " + "w " * 400 + "password=hunter22"),  # too far
        (4, "user=bob key " + "aB3/" * 10 + " host postgres://db/x"),  # all three weak parts
        (5, "visit 10.1.2.3 now AKIA" + "X" * 16),
        (6, "host 10.1.2.3 " + "p" * (secret_scan.SCOPE * 2) + " AKIA" + "X" * 16),
    ]
    got = {r["doc_id"]: r["s"].split(",") if r["s"] else [] for r in secret_scan.scan(table(spark, rows)).select("doc_id", secret_scan.written(F.col("found")).alias("s")).collect()}
    kinds = {k: [x.split(":")[0] for x in v] for k, v in got.items()}
    assert kinds == {1: [], 2: ["user", "assign", "endpoint"], 3: ["assign"], 4: ["user", "key", "endpoint"], 5: ["endpoint", "access"], 6: ["access"]}
    out = {r["doc_id"]: r["text"] for r in secret_scan.redacted(table(spark, [*rows, (7, None), (8, "clean 😀 text")])).collect()}
    assert out[2] == "[SECRET] [SECRET] at [SECRET]" and out[7] is None and out[8] == "clean 😀 text" and "hunter22" not in out[3]


def test_odd_rows(spark):
    docs = table(spark, ODD)
    empty = docs.where("false")
    spans = secret_scan.scan(docs)
    assert spans.count() == len(ODD) and spans.where("size(found) > 0").count() == 0 and secret_scan.scan(empty).count() == 0
    assert secret_scan.redacted(docs).columns == docs.columns and secret_scan.redacted(empty).count() == 0
    rules = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    assert rules[1]["n_words"] == rules[2]["n_words"] == rules[3]["n_words"] == 0 and rules[1]["base_failed"] and not rules[1]["kept"]
    assert rules[4]["n_words"] == 40_000 == rules[4]["n_repeat_words"] and quality_rules.apply_rules(empty).count() == 0
    assert mixing.mix(docs).count() == len(ODD) and mixing.mix(empty).count() == 0 and mixing.mixed(docs).columns == docs.columns
    packed = packing.pack(docs).collect()
    assert sum(r["length"] for r in packed) == 40_000 + 2 + 2 + 3 and packing.pack(empty).count() == 0
    assert packing.pack(docs.where("doc_id IN (1, 2)")).count() == 2
    assert sha256(b"").hexdigest() == spans.select(F.sha2(secret_scan.written(F.col("base")), 256)).first()[0]


def test_mix_comes_near_its_targets(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 50), r.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"])) for i in range(3000)]
    got = mixing.mix(table(spark, rows)).toPandas()
    per = got.groupby("source", dropna=False).agg(size=("size", "sum"), total=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per["total"]).all() and (abs(per["taken"] - per["target"]) <= 50).all() and (per["target"] <= 2 * per["size"]).all()
    assert abs(per["target"].sum() - 1.5 * per["size"].sum()) < 1e-6 and (got["taken"] <= 2 * got["size"]).all()
    again = mixing.mix(table(spark, rows[::-1])).toPandas()
    key = lambda d: sorted(zip(d["doc_id"], d["taken"], strict=True))
    assert key(got) == key(again)
    few = mixing.mix(table(spark, rows[:40]), share=1.9).toPandas().groupby("source", dropna=False)[["size", "target"]].agg({"size": "sum", "target": "first"})
    assert (few["target"] <= 2 * few["size"] + 1e-9).all()


def brute(lengths, counts, k):
    from itertools import combinations

    best = None
    for cut in combinations(range(len(lengths) - 1), min(k, len(lengths)) - 1):
        ends = [*cut, len(lengths) - 1]
        cost, lo = 0, 0
        for e in ends:
            cost += sum(c * (lengths[e] - n) for n, c in zip(lengths[lo : e + 1], counts[lo : e + 1], strict=True))
            lo = e + 1
        best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_boundaries_pad_least(seed):
    r = np.random.default_rng(seed)
    lengths = np.sort(r.choice(np.arange(1, 60), 9, replace=False))
    counts = r.integers(1, 20, 9)
    bounds, cost = packing.boundaries(lengths, counts, 4)
    where = np.searchsorted(bounds, lengths)
    assert cost == brute(lengths.tolist(), counts.tolist(), 4) == int((counts * (np.array(bounds)[where] - lengths)).sum())


def test_packing_keeps_every_word(spark):
    r = random.Random(6)
    rows = [(i, "w " * r.choice([1, 5, 30, 31, 200, 950])) for i in range(500)]
    got = packing.pack(table(spark, rows), max_len=100, buckets=4, budget=400).toPandas()
    assert got["length"].sum() == sum(len(t.split()) for _, t in rows) and (got["length"] <= got["bucket_len"]).all() and got["bucket_len"].nunique() <= 4
    per = got.groupby("batch_id")
    assert (per["bucket_len"].nunique() == 1).all() and (per.size() * per["bucket_len"].first() <= 400).all() and not got.duplicated(["batch_id", "slot"]).any()
    for _, g in got.sort_values("start").groupby("doc_id"):
        ends = list(zip(g["start"], g["start"] + g["length"], strict=True))
        assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in pairwise(ends))
