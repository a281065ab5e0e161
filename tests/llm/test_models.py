"""SimHash, neighbours, substring dedup and the learned operators, against brute force or held-out rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import ann, common, components, language_id, quality_classifier, simhash, toxicity
from tidewheel.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, th string, x string"
ODD = [(1, None), (None, "null id"), (2, ""), (3, " \t\n"), (4, "word " * 30_000), (5, "twice told tale"), (5, "twice told tale"), (6, "naïve 😀 text")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y", "z") for i, t in rows], DOCS)


def _labels(spark, rows, column):
    return spark.createDataFrame(rows, f"doc_id long, {column} int")


def test_fingerprint_by_the_letter():
    import xxhash

    text = "One two\tTHREE four É"
    words = [w.encode() for w in ("one", "two", "three", "four", "É")]
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.fingerprint(text) == want and simhash.fingerprint(None) == 0 == simhash.fingerprint(" ")
    assert simhash.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)


@pytest.mark.parametrize("few", [simhash.FEW, 2])  # the second sends nearly all through whole balls
def test_links_against_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "FEW", few)
    r = random.Random(3)
    fps = set()
    for _ in range(25):
        base = r.getrandbits(64)
        for _ in range(8):
            x = base
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
            fps.add(simhash._signed(x))
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    root = {n: n for n in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    got = {x["node"]: x["root"] for x in components.connected_components(common.write_shared(simhash.links(df), "links")).collect()}
    assert {n: got.get(n, n) for n in fps} == {n: find(n) for n in fps}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)}


def test_keys_of_many_rows_are_dealt(spark):
    rows = spark.createDataFrame([(i, i % 3 if i > 50 else 7) for i in range(90)], "id long, k long")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k long, v string")
    want = sorted((i, {0: "a", 1: "b", 7: "c"}.get(i % 3 if i > 50 else 7)) for i in range(90))
    for most in (4, 1000):
        got = common.dealt(rows, one, "k", ["id"], "left", most)
        assert sorted(((r["id"], r["v"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_sides_too_large_to_broadcast(spark, monkeypatch):
    """All joins shuffled: the results are those of the broadcast ones."""
    from tidewheel.llm import mixing, resemblance, secret_scan

    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    told = lambda: [sorted(map(str, df.collect())) for df in (secret_scan.redacted(docs), simhash.near_duplicates(docs), simhash.one_of_each(docs, resemblance.near_copies), mixing.mix(docs))]
    want = told()
    for m in (common, mixing, resemblance, secret_scan, simhash):
        monkeypatch.setattr(m, "small_or_shuffled", lambda side, most=0: side)
    assert told() == want


def test_near_duplicates_and_odd_rows(spark):
    docs = table(spark, [*ODD, (9, "twice told tale"), (10, None)])
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (10, 1), (None, None), (4, 4), (5, 5), (9, 5), (6, 6)}
    left = simhash.one_of_each(docs)
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 1, 4, 5, 6] and left.columns == docs.columns
    assert simhash.near_duplicates(docs.where("false")).count() == 0 and simhash.one_of_each(docs.where("false")).count() == 0


@pytest.mark.parametrize("block", [ann.BLOCK, 3])  # 3: nearly every group serves several blocks of queries
def test_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "GROUP", 8000 if block > 3 else 700)
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(1500, 16)), np.repeat(r.normal(size=(1, 16)), 600, axis=0)])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(10_000, None, 0), (10_100, [0.0] * 16, 0), (10_200, [float("nan")] * 16, 0), (None, [1.0] * 16, 0), (10_300, [1.0] * 3, 0), (10_400, [1.0, None] * 8, 0), (7, x[7].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int")
    got = ann.search(df).toPandas()
    assert set(got["query_id"]) == set(range(0, 2100, 100)) and (got.groupby("query_id").size() == 10).all()
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        g = g.sort_values("rank")
        assert np.allclose(g["score"], d[g["vec_id"]]) and g["score"].is_monotonic_increasing
        hits += len(set(best) & set(g["vec_id"]))
        if q >= 1500:
            assert list(g["vec_id"]) == list(best)  # ties among copies
    assert hits / (10 * got["query_id"].nunique()) >= 0.9
    assert ann.search(df.where("embedding IS NULL")).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in ann.search(few).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert ann.search(few.where("false")).count() == 0 and ann.search(few.where("vec_id > 0")).count() == 0


def test_probe_order_is_by_rising_score():
    index = ann.Index(4, 1.0, hashes=4, most=81)
    assert len(index.steps) == 81 and len({tuple(s) for s in index.steps}) == 81 and not index.steps[0].any()
    assert all(not (s[:4] & s[:3:-1]).any() for s in index.steps)


def test_gradients_of_the_network():
    net = language_id.Network(["a", "b"], units=3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, y = np.array([[97, 98, 99], [100, 97, 98]], dtype=np.uint8), np.array([0, 1])
    loss = lambda: -np.log(net.label(x)[0][np.arange(2), :, y]).mean()
    for k, g in net.gradients(x, y).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        was = net.p[k][at]
        net.p[k][at] = was + 1e-4
        hi = loss()
        net.p[k][at] = was - 1e-4
        lo = loss()
        net.p[k][at] = was
        assert abs((hi - lo) / 2e-4 - g[at]) < 1e-3, k


def plain_labels(net, text):
    """Probabilities at each byte, by one gated step after another."""
    x, u, f = language_id.bytes_of(text), net.units, lambda a: 1 / (1 + np.exp(-a))
    states = []
    for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        h, out = np.zeros(u), np.zeros((len(x), u))
        for t in order:
            a, g = net.p["E" + d][x[t]].astype(float), h @ net.p["U" + d].astype(float)
            z, r = f(a[:u] + g[:u]), f(a[u : 2 * u] + g[u : 2 * u])
            new = np.tanh(a[2 * u :] + r * g[2 * u :])
            h = (1 - z) * new + z * h
            out[t] = h
        states.append(out)
    s = np.exp(np.hstack(states) @ net.p["V"] + net.p["c"])
    return s / s.sum(axis=1, keepdims=True)


def test_pooled_labels_by_the_letter(spark, monkeypatch):
    net = language_id.train([("a", "aa ab ba cab"), ("b", "xx xy yx zyx")], steps=40)
    texts = ["ab", "aa ba xy", "Xx YY zé 12", "xyz " * 30, "ab\n" * 41 + "x"]
    for window, context in ((512, 24), (8, 1000)):  # one window, and windows that see all the text
        monkeypatch.setattr(language_id, "WINDOW", window)
        monkeypatch.setattr(language_id, "CONTEXT", context)
        got = {r["doc_id"]: r for r in language_id.identify(table(spark, list(enumerate(texts))), net).collect()}
        for i, t in enumerate(texts):
            want = plain_labels(net, t).mean(axis=0)
            assert abs(got[i]["score"] - want.max()) < 1e-4 and got[i]["lang_pred"] == "ab"[want.argmax()]
    cut = [w for w in language_id.windows_of(language_id.bytes_of("x" * 1300))]
    assert [w[1:] for w in cut] and sum(e - b for _, b, e in cut) == 1300


def test_windows_side_by_side_cost_less_than_the_training_pass():
    """Sums over windows of unlike length are those of ``label``, at well under its cost."""
    import time

    r, net = np.random.default_rng(2), language_id.Network(["a", "b", "c"])
    windows = [(r.integers(0, 256, n, dtype=np.uint8), int(n) // 9, int(n) - int(n) // 7) for n in [1, 2, 31, 32, 33, *r.integers(40, 560, 60)]]
    want = [net.label(x[None])[0][0, begin:end].sum(axis=0) for x, begin, end in windows]
    assert np.allclose(net.sums(windows), want, rtol=1e-4, atol=1e-5)
    x = r.integers(0, 256, (language_id.SIDE, 200), dtype=np.uint8)

    def cost(run):
        took = []
        for _ in range(5):
            began = time.process_time()
            run()
            took.append(time.process_time() - began)
        return min(took)

    assert cost(lambda: net.sums([(w, 0, 200) for w in x])) < 0.8 * cost(lambda: net.label(x))


def test_languages_held_out(spark):
    got = QUERIES["op2_language_id"](spark, SF).join(common.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got["lang"] == got["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()
    net = language_id.train([("a", "aa ab"), ("b", "xx xy")], steps=60)
    out = {r["doc_id"]: r for r in language_id.identify(table(spark, [*ODD, (7, "12 34"), (8, "xx xy xx")]), net).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3, 7, 8)] == ["und"] * 4 + ["b"] and out[1]["score"] == 0
    assert language_id.train([]) is None and language_id.sample(table(spark, ODD).where("false")) == []
    assert language_id.identify(table(spark, ODD), None).where("lang_pred <> 'und'").count() == 0


def test_quality_held_out(spark):
    got = QUERIES["op8_quality_classifier"](spark, SF).join(common.table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got["quality"] == got["predicted"]).mean() > 0.95 and got["score"].between(0, 1).all()
    docs = table(spark, ODD)
    none = _labels(spark, [], "quality")
    assert {r["score"] for r in quality_classifier.classify(docs, none).collect()} == {0.5} and quality_classifier.classify(docs.where("false"), none).count() == 0
    assert quality_classifier.accepted(docs, none).count() == len(ODD)
    one = _labels(spark, [(i, 1) for i in range(1, 9)], "quality")
    assert quality_classifier.classify(docs, one).where("score >= 0.5").count() == len(ODD) and quality_classifier.accepted(docs, one).columns == docs.columns


def test_isotonic_and_ridge():
    x, y = quality_classifier.isotonic(np.arange(6.0), np.array([0, 1, 0, 1, 1, 1.0]), np.ones(6))
    assert np.all(np.diff(y) >= 0) and np.allclose(y, [0, 0.5, 1]) and np.all(np.diff(x) > 0)
    r = np.random.default_rng(0)
    z = np.hstack([r.normal(size=(50, 3)), np.ones((50, 1))])
    beta = np.array([1.0, -2, 0.5, 3])
    assert np.allclose(quality_classifier.solve(z.T @ np.hstack([z, (z @ beta)[:, None]]), 1e-9), beta, atol=1e-6)


def test_toxicity_held_out(spark):
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 6))) for _ in range(300)]
    bad = ["zqvile", "xwrot", "kvfoul"]
    rows, labels = [], []
    for i in range(600):
        text, toxic = r.choices(words, k=120), i % 5 == 0
        for w in r.choices(bad, k=4) if toxic else ():
            text.insert(r.randint(0, len(text)), w)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    docs, known = table(spark, [*rows, (1000, None), (None, "x"), (1001, "")]), _labels(spark, labels, "toxic")
    got = {x["doc_id"]: x for x in toxicity.toxicity(docs, known).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in held) and got[1000]["held_out"] == (zlib.crc32(b"1000") % 3 == 1)
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.97 and 0 <= got[1000]["score"] <= 1 and got[1000]["predicted"] == 0
    none = _labels(spark, [], "toxic")
    assert {x["score"] for x in toxicity.toxicity(docs, none).collect()} == {0.5} and toxicity.toxicity(docs.where("false"), none).count() == 0


def plain_ratios(docs, view):
    """Word beginnings of (text, fold, label) to shrunken log ratios, and those of signs unseen after them, by dictionaries."""
    from collections import Counter
    from math import copysign, log

    def beginnings(text):
        signs = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in text.lower().encode())
        return [w[: k + 1] for w in {x + b" " for x in signs.split()} for k in range(len(w))]

    n = {y: Counter(b for t, f, label in docs if label == y and f != view for b in beginnings(t)) for y in (0, 1)}
    pooled = Counter(b for t, _, _ in docs for b in beginnings(t))
    ends = Counter(b[-1] for b in pooled)
    low = {s: (c + 0.5) / (len(pooled) + 128) for s, c in ends.items()}
    below = lambda c, h: [v for b, v in c.items() if b[:-1] == h]
    shrunk = lambda x: copysign(max(abs(x) - toxicity.MARGIN, 0), x)
    mu, d = toxicity.SHARED, toxicity.DISCOUNT
    seen, unseen = {}, {}
    for h in {b[:-1] for b in pooled}:
        left = {y: (sum(min(v, d) for v in below(n[y], h)) + mu) / (sum(below(n[y], h)) + mu) for y in (0, 1)}
        unseen[h] = shrunk(log(left[1] / left[0]))
        for b in (b for b in pooled if b[:-1] == h):
            share = (pooled[b] - 0.75 + (0.75 * len(below(pooled, h)) + 1) * low[b[-1]]) / (sum(below(pooled, h)) + 1)
            p = [max(n[y][b] - d, 0) / (sum(below(n[y], h)) + mu) + left[y] * share for y in (0, 1)]
            seen[b] = shrunk(log(p[1] / p[0]))
    return lambda text: sum(seen.get(b, unseen.get(b[:-1], 0)) for b in beginnings(text)) / (len(beginnings(text)) + toxicity.PRIOR)


@pytest.mark.parametrize("most", [toxicity.MOST, 0])  # 0: no table is sent to tasks, texts are joined to it
def test_toxicity_by_the_letter(spark, monkeypatch, most):
    monkeypatch.setattr(toxicity, "SHARED", 2.0)
    monkeypatch.setattr(toxicity, "MARGIN", 0.05)
    r = random.Random(3)
    words = ["aab", "aac", "abcdefghij", "abcdefghix", "Straße", "7up", "b"]
    docs = [(" ".join(r.choices(words, k=8)) + "!", (0, 2)[i % 2], int(i % 4 > 1)) for i in range(20)]
    rows = spark.createDataFrame(docs, "text string, fold int, label int")
    table_ = common.write_shared(toxicity.ratios(common.write_shared(toxicity.count_nodes(rows), "counts")), "ratios")
    texts = [t for t, _, _ in docs] + ["", "new words abcdefghiz", "abcdefghix abcdefghix"]
    for view, fold in (("whole", None), ("without0", 0), ("without2", 2)):
        score = plain_ratios([d for d in docs], fold)
        asked = spark.createDataFrame([(i, t, view) for i, t in enumerate(texts)], "i long, text string, view string")
        got = {x["i"]: x["s"] for x in toxicity.scores(asked, table_, most).collect()}
        assert len(got) == len(texts) and all(abs(got[i] - score(t)) < 1e-7 for i, t in enumerate(texts)), view


def test_words_that_differ_late(spark):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        text = r.choices(["aa", "bb", "cc", "dd"], k=40)
        text[5] = text[20] = "abcdefghijkbad" if i % 4 == 0 else "abcdefghijkfine"
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    odd = [(900, None), (None, "abcdefghijkbad"), (901, ""), (902, "abcdefghijkbad " * 20_000), (3, rows[3][1])]
    got = [(x["doc_id"], x["predicted"]) for x in toxicity.toxicity(table(spark, rows + odd), _labels(spark, labels, "toxic")).collect()]
    assert len(got) == 405 and np.mean([p == (i % 4 == 0) for i, p in got if i is not None and i < 400]) > 0.97


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.write_shared(stage(spark, docs, "/root/testdata/sf0.001"), name)
        if name != "packing":
            assert docs.columns == columns
        if name in ("quality_classifier", "simhash", "secret_scan"):
            assert 0 < docs.count() <= n
            n = docs.count()
    assert docs.where(F.col("length") > 0).count() > 0
    odd = table(spark, ODD)
    for name, stage in corpus_pipeline.STAGES:
        for rows in (odd, odd.where("false")):
            out = common.write_shared(stage(spark, rows, "/root/testdata/sf0.001"), name)
            assert out.count() >= 0 and (name == "packing" or out.columns == odd.columns)


def test_pipeline_stages_by_brute_force(spark):
    """Each stage's rows follow from its own input, told by plain Python."""
    import corpus_pipeline
    from tidewheel.llm import quality_classifier as qc
    from tidewheel.llm import resemblance, secret_scan

    sf, docs = "/root/testdata/sf0.001", common.table(spark, "/root/testdata/sf0.001", "documents")
    labels = common.table(spark, sf, "labels")
    stage = dict(corpus_pipeline.STAGES)
    rows = docs.collect()
    passed = common.write_shared(stage["quality_classifier"](spark, docs, sf), "q")
    scores = {r["doc_id"]: r["score"] for r in qc.classify(docs, labels).collect()}
    assert sorted(r["doc_id"] for r in passed.collect()) == sorted(i for i, s in scores.items() if s >= qc.CUT)
    one = common.write_shared(stage["simhash"](spark, passed, sf), "s")
    sets = {r["doc_id"]: resemblance.shingles(r["text"]) for r in rows}
    ids, root = sorted(r["doc_id"] for r in passed.collect()), {}
    for i in ids:  # a class is named by its least id
        near = [root[j] for j in root if resemblance.resemble(sets[i], sets[j]) or not len(sets[i]) and not len(sets[j])]
        root = {j: min([i, *near]) if r in near else r for j, r in {**root, i: i}.items()}
        root[i] = min([i, *near])
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(root.values()))
    clean = common.write_shared(stage["secret_scan"](spark, one, sf), "c")
    text = {r["doc_id"]: r["text"] for r in one.collect()}
    spans = {r["doc_id"]: r["found"] for r in secret_scan.scan(one).collect()}
    for r in clean.collect():
        want, at = "", 0
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                want += text[r["doc_id"]][at : s["start"]] + "[SECRET]"
            at = max(at, s["end"])
        assert r["text"] == (want + text[r["doc_id"]][at:] if spans[r["doc_id"]] else text[r["doc_id"]])
    mixed = common.write_shared(stage["mixing"](spark, clean, sf), "m")
    n = {}
    for r in mixed.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    sizes = {r["doc_id"]: len((r["text"] or "").split()) for r in clean.collect()}
    assert max(n.values()) <= 2 and abs(sum(sizes[i] * k for i, k in n.items()) - 1.5 * sum(sizes.values())) <= 3 * max(sizes.values())
    packed = stage["packing"](spark, mixed, sf).where("length > 0").toPandas()
    assert packed["length"].sum() == sum(sizes[i] * k for i, k in n.items()) and (packed.groupby("batch_id")["bucket_len"].sum() <= 65536).all()


def test_long_lists_of_secrets(spark):
    """Thousands of spans in one text, over several blocks of the running sums."""
    import re

    from tidewheel.llm import secret_scan

    text = " ".join(f"token={i:06d}abc x{i}" for i in range(3000))
    docs = table(spark, [(1, text), (None, text), (None, None)])
    got = {r["doc_id"]: r["base"] for r in secret_scan.scan(docs.where("doc_id = 1")).collect()}
    assert [(s["start"], s["end"]) for s in got[1]] == [m.span() for m in re.finditer(r"token=\w+", text)]
    out = [r["text"] for r in secret_scan.redacted(docs).collect()]
    assert sorted(map(str, out)) == sorted(["None", *[re.sub(r"token=\w+", "[SECRET]", text)] * 2])
    clash = docs.withColumns({"tw_key": F.lit(1), "tw_found": F.lit("x"), "tw_id": F.lit(2), "tw_th": F.lit("y")})
    assert secret_scan.redacted(clash).columns == clash.columns and simhash.one_of_each(clash).columns == clash.columns
    assert simhash.one_of_each(clash).count() == 2
