"""Repeated passages of fifty words, against plain windows of words and not against the operator's own units."""

import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.test_models import ODD, table
from tidewheel.llm import substring_dedup


def test_fifty_words_lose_some_wherever_they_stand(spark):
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(200):
        ends = (1e9, 30, 12, 6)[i % 4]  # mean words of a sentence; the first has no stops
        words = lambda n: [w + "." if r.random() < 1 / ends else w for w in r.choices(vocabulary, k=n)]  # noqa: E731, B023
        passage = words(50)
        if i % 10 == 9:
            passage = [r.choice(vocabulary)] * 50
        elif i % 10 == 8:
            passage = r.choices(vocabulary, k=2) * 25
        for j in range(2):
            rows.append((2 * i + j, " ".join([*words(r.randint(5, 80)), *passage, *words(r.randint(5, 80))])))
    got = {x["doc_id"]: x["n_removed"] for x in substring_dedup.dedup(table(spark, rows)).collect()}
    windows, repeats = set(), set()
    for i, t in rows:
        w = t.lower().split()
        own = {tuple(w[k : k + 50]) for k in range(len(w) - 49)}
        repeats |= {i} if own & windows else set()
        windows |= own
    assert len(repeats) == 200 and all(got[i] > 0 for i in repeats)
    assert sum(got[i] > 0 for i, _ in rows if i not in repeats and i // 2 % 10 < 8) == 0


def plain_units(text):
    """Units as lists of words, by the letter of the definition."""
    out, k = [], substring_dedup.WINDOW
    for sentence in re.split(r"(?<=[.!?])\s+|\n\s*", text.lower()):
        w = sentence.split()
        h = [xxhash.xxh64_intdigest(x.encode()) for x in w]
        stops = {len(w)}
        if len(w) > substring_dedup.LONG:
            stops |= {min(range(i, i + k), key=lambda j: (h[j], -j)) + 1 for i in range(len(w) - k + 1)}  # noqa: B023
        before = 0
        for at in sorted(stops) if w else ():
            out.append(w[before:at])
            before = at
    return out


def brute_dedup(rows):
    """Removed units of each (id, text) by comparing words, with no hash of runs."""
    seen, gone = {}, {}
    for i, t in sorted(rows):
        units = plain_units(t)
        gone[i] = set()
        for at in range(len(units)):
            end = at + substring_dedup.RUN
            while end <= len(units) and sum(map(len, units[at:end])) < substring_dedup.RUN_WORDS:
                end += 1
            if end > len(units):
                if at or not units:
                    break
                end = len(units)
            words = tuple(x for u in units[at:end] for x in u)
            if seen.setdefault(words, (i, at)) != (i, at):
                gone[i] |= set(range(at, end))
    return {i: (len(plain_units(t)), len(gone[i]), " ".join(x for k, u in enumerate(plain_units(t)) if k not in gone[i] for x in u)) for i, t in rows}


def test_units_are_whole_and_cut_alike():
    r = random.Random(5)
    text = "\n ".join(" ".join(r.choices([f"w{i}" for i in range(500)], k=n)) for n in (4000, 3, 11, 10, 1))
    units = substring_dedup.units(text)
    assert "".join(text[s:e] for s, e in units) == text
    assert [text[s:e].split() for s, e in units] == plain_units(text)
    assert max(len(u) for u in plain_units(text)[:1000]) <= substring_dedup.WINDOW


def test_places_that_were_sent():
    """Whatever is forgotten, each hash's first place is sent and all others are known as later, here or in the bucket."""
    r = np.random.default_rng(3)
    for room in (0, 5, 40, 1000):
        sent, everything, out, told = substring_dedup._Sent(room), [], [], []
        for _ in range(30):
            places = np.zeros(50, substring_dedup._PLACE)
            places["h"], places["doc_id"], places["at"] = r.zipf(1.5, 50) % 200, r.integers(0, 40, 50), r.integers(0, 3, 50)
            everything.append(places.copy())
            fresh, later = sent.fresh(*substring_dedup._firsts(places))
            assert len(sent.places) <= room and (np.diff(sent.places["h"].astype(int)) > 0).all()
            out.append(fresh)
            told.append(later)
        _, later = substring_dedup._firsts(np.concatenate(out))
        got = {x.item() for x in np.concatenate([later, *told])}
        least = {}
        for x in sorted(x.item() for x in np.concatenate(everything)):
            least.setdefault(x[0], x)
        assert got == {x.item() for x in np.concatenate(everything)} - set(least.values())
        assert room < 1000 or sum(map(len, out)) < 600


def test_texts_without_ids_are_told_apart(spark):
    """Texts of null ids are known by their hash alone; each keeps its own ranges."""
    texts = [" ".join(f"n{i}x{k}" for k in range(20 + i % 7)) for i in range(300)]
    rows = [(None, t) for t in texts] + [(1, texts[7] + " and more of it")]
    got = substring_dedup.dedup(table(spark, rows)).collect()
    assert sorted(x["text"] for x in got if x["doc_id"] is None) == sorted(texts)
    assert [x["n_removed"] > 0 for x in got if x["doc_id"] == 1] == [True]


@pytest.mark.parametrize(("batch", "size", "remembered"), [(1000, 1 << 20, 1 << 20), (7, 1 << 20, 60), (1000, 3000, 0)])
def test_against_words(spark, monkeypatch, batch, size, remembered):
    """Few texts to a batch and few buckets, so that firsts are settled between batches; little is remembered."""
    monkeypatch.setattr(substring_dedup, "CHUNK", batch)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", size)
    monkeypatch.setattr(substring_dedup, "SENT", remembered)
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    sentence = lambda: " ".join(r.choices(words, k=r.randint(3, 30))) + "."
    shared = [" ".join(sentence() for _ in range(6)) for _ in range(3)]
    rows = []
    for i in range(80):
        parts = [sentence() for _ in range(12)]
        if i % 3 == 0:
            parts.insert(r.randint(0, 12), shared[i % 9 // 3])
        rows.append((i, "\n".join(parts)))
    rows += [(100, rows[0][1]), (101, "Only this."), (102, "Only this."), (103, " \n ")]
    got = {x["doc_id"]: x for x in substring_dedup.dedup(table(spark, rows)).collect()}
    assert {i: (x["n_sentences"], x["n_removed"], " ".join(x["text"].lower().split())) for i, x in got.items()} == brute_dedup(rows)
    assert got[100]["text"] == "" == got[102]["text"] and got[101]["text"] == "Only this." and got[103]["text"] == " \n "
    for i, t in rows:
        for s, e in (map(int, x.split(":")) for x in got[i]["removed"].split(",") if x):
            t = t[:s] + "\0" * (e - s) + t[e:]
        assert t.replace("\0", "") == got[i]["text"]


def test_odd_rows_and_hot_passages(spark):
    odd = {x["doc_id"]: x["text"] for x in substring_dedup.dedup(table(spark, ODD)).collect()}
    assert odd[1] is None and odd[5] == "twice told tale" and substring_dedup.dedup(table(spark, ODD).where("false")).count() == 0
    blank = substring_dedup.dedup(table(spark, [(None, None), (1, ""), (1, ""), (2, " \n "), (None, None)])).collect()
    assert sorted(x["text"] or "-" if x["text"] != "" else "" for x in blank) == sorted(["-", "-", "", "", " \n "]) and all(x["n_sentences"] == x["n_removed"] == 0 for x in blank)
    hot = [(i, f"own{i} words here. " + " ".join(f"h{k}" for k in range(60))) for i in range(400)] + [(None, " ".join(f"h{k}" for k in range(60)))]
    got = {x["doc_id"]: x["n_removed"] for x in substring_dedup.dedup(table(spark, hot)).collect()}
    assert got[None] == 0 and all(got[i] > 0 for i in range(400))
