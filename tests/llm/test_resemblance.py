"""The pipeline's near-duplicate stage against all pairs."""

import random

import pytest
import xxhash

import corpus_pipeline
from tests.llm.test_models import ODD, table
from tidewheel.llm import resemblance


def _words(text, width=5):
    w = text.lower().split()
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))}


@pytest.mark.parametrize("sample, salt", [(resemblance.SAMPLE, resemblance.SALT), (8, 16)])
def test_stage_finds_planted_edits(spark, monkeypatch, sample, salt):
    monkeypatch.setattr(resemblance, "SAMPLE", sample)
    monkeypatch.setattr(resemblance, "SALT", salt)
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(120):
        base = r.choices(vocabulary, k=r.randint(60, 400))
        rows.append((len(rows), " ".join(base)))
        for _ in range(2):
            copy = list(base)
            for at in r.sample(range(len(copy)), r.randint(1, max(1, len(copy) // 40))):
                copy[at] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    crowd = r.choices(vocabulary, k=200)  # many near-copies of one text
    for i in range(150):
        copy = list(crowd)
        for k in range(r.randint(1, 9)):  # from close to all others to far from most
            copy[r.randrange(200)] = f"x{r.randrange(40)}"
        rows.append((len(rows), " ".join(copy)))
    sets = {i: _words(t) for i, t in rows}
    root, n = {i: i for i in sets}, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
                n += 1
    docs = table(spark, rows)
    left = {x["doc_id"] for x in corpus_pipeline.simhash(spark, docs, "").collect()}
    want = {i for i in sets if find(i) == i}
    assert n > 150 and len(want) < len(rows) / 2
    assert want <= left and len(left - want) <= 1  # a pair at 0.8 is missed with probability 0.0004


def test_pairs_that_both_ends_of_a_bucket_miss(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "bands", lambda found: __import__("numpy").zeros(1, "int64"))  # one bucket of all
    r = random.Random(6)
    rows = []
    for i in range(6):
        base = [f"v{r.randrange(3000)}" for _ in range(100)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:-1], "other"]))]
    got = {x["doc_id"]: x["root"] for x in resemblance.near_copies(table(spark, rows)).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(6)) and len(set(got.values())) == 6


def _print(text, width=5):
    w = text.lower().encode().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(len(w) - width + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_balls_find_near_copies_without_minima(spark, monkeypatch):
    """Texts whose SimHash fingerprints differ in up to three bits meet with no MinHash key at all, and are then verified."""
    monkeypatch.setattr(resemblance, "bands", lambda found: __import__("numpy").zeros(0, "int64"))
    r = random.Random(8)
    texts = []
    for _ in range(40):
        base = [f"v{r.randrange(3000)}" for _ in range(r.randint(150, 500))]
        texts += [" ".join(base), " ".join([*base[:-1], "other"]), " ".join([*base[:90], "other", *base[91:]])]
    said = " ".join(f"s{i}" for i in range(7)) + " "
    texts += [said * 60 + " ".join(f"{c}{i}" for i in range(40)) for c in "xy"]  # like fingerprints, unlike sets
    texts += [" ".join(["twice told"] * n) for n in (10, 400, 401)]  # one set
    sets, prints = [_words(t) for t in texts], [_print(t) for t in texts]
    crowd, root = list(range(len(texts))), list(range(len(texts)))
    near = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    merge = lambda c, i, j: [min(c[i], c[j]) if x in (c[i], c[j]) else x for x in c]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
    for i, j in pairs:
        if (prints[i] ^ prints[j]).bit_count() <= 3 or sets[i] == sets[j]:
            crowd = merge(crowd, i, j)
    for i, j in pairs:
        if crowd[i] == crowd[j] and near(i, j):
            root = merge(root, i, j)
    got = {x["doc_id"]: x["root"] for x in resemblance.near_copies(table(spark, list(enumerate(texts)))).collect()}
    assert all((got[i] == got[j]) == (root[i] == root[j]) for i, j in pairs)
    assert sum(root[i] != i for i in range(120)) >= 20 and crowd[120] == crowd[121] and got[120] != got[121]


def test_odd_rows(spark):
    docs = table(spark, [*ODD, (9, "twice told tale"), (10, None)])
    left = corpus_pipeline.simhash(spark, docs, "")
    assert sorted((x["doc_id"] or 0) for x in left.collect()) == [0, 1, 4, 5, 6] and left.columns == docs.columns
    assert resemblance.near_copies(docs.where("false")).count() == 0
