"""Substring dedup over sliding sentence spans.

A text is cut into sentences, and sentences of many words further, by winnowing: after each word whose hash is the least
of some ``WINDOW`` consecutive words of the sentence. The cuts at a word depend on the words within ``WINDOW`` of it
only, and no part is longer, so any 50 words hold three whole units, cut alike wherever they stand; equal words are
units of one word each, which need no alignment. Every run of several consecutive units is hashed, and a sentence is
removed if a run that is not the first of its hash, over all texts, covers it.

Runs are joined globally in one shuffle. Each batch of texts sends the first place of each of its hashes, packed, to the
hash's bucket, and knows of its other places at once that they are not the first. A task remembers hashes that it has
sent, those that come again for longest, and knows likewise of what comes after a place it has sent. So a bucket holds
few places of a hash from each task, however often a passage stands; there the first of all is found, and the others
are sent back to their texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import table

#: Sentences of a run; words that a run must have (it takes in more sentences until it does).
RUN, RUN_WORDS = 3, 12
#: Sentences of more words are cut; of so many consecutive words of one, the word of least hash (the last such) ends a unit.
LONG, WINDOW = 10, 6
#: Buckets that hashes are dealt to, for each partition of the texts, and at least.
BUCKETS, LEAST_BUCKETS = 8, 64
#: Texts, and bytes of them, of which runs are gathered before they are sent.
CHUNK, CHUNK_BYTES = 1024, 8 << 20
#: Words whose hashes a task remembers before it starts afresh; places that it remembers to have sent.
REMEMBERED, SENT = 200_000, 400_000
_END = re.compile(r"(?<=[.!?])\s+|\n\s*")
_WORD = re.compile(r"\S+\s*")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = np.dtype([("h", "<u8"), ("has", "i1"), ("doc_id", "<i8"), ("th", "<i8"), ("at", "<i4")])
_ORDER = ["has", "doc_id", "th", "at"]


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def _words(text: str) -> tuple[list[str], np.ndarray]:
    """Words in lower case, and how many each sentence that holds any has."""
    sentences = [s.split() for s in _END.split(text.lower())]
    return list(chain.from_iterable(sentences)), np.array([len(s) for s in sentences if s], dtype=np.int64)


def ends(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Numbers of words up to the end of each unit of a text with words of ``hashes`` in sentences of ``sizes``."""
    stops = np.cumsum(sizes)
    n = len(hashes) - WINDOW + 1
    if n < 1 or not (sizes > LONG).any():
        return stops
    first = np.arange(n)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    whole = (sentence[:n] == sentence[WINDOW - 1 :]) & (sizes > LONG)[sentence[:n]]
    least, at = hashes[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, WINDOW):  # ties are the later word's
        later = hashes[k : n + k]
        better = later <= least
        at[better] = k
        np.minimum(least, later, out=least)
    return np.union1d(stops, (first + at)[whole] + 1)


def cut(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``text``, and the words up to the end of each unit."""
    words, sizes = _words(text or "")
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    return hashes, ends(hashes, sizes)


def spans(stops: np.ndarray) -> np.ndarray:
    """The unit after each run, by the run's first unit. A text that is too short for a run is one run as a whole."""
    if not len(stops):
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], stops])
    after = np.maximum(np.searchsorted(total, total[:-1] + RUN_WORDS), np.arange(len(stops)) + RUN)
    after = after[after <= len(stops)]
    return after if len(after) else np.array([len(stops)])


def runs(text: str | None) -> np.ndarray:
    """Hashes of all runs by their first unit: polynomials of the hashes of their words."""
    hashes, stops = cut(text)
    if not len(hashes):
        return hashes
    total, after = np.concatenate([[0], stops]), spans(stops)
    one = np.ones(1, np.uint64)
    powers, back = (np.cumprod(np.concatenate([one, np.full(len(hashes), b)]), dtype=np.uint64) for b in (_BASE, _BACK))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[:-1], dtype=np.uint64)])
    start, stop = total[np.arange(len(after))], total[after]
    h = (sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h * _BASE


def units(text: str, stops: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences, or parts of long ones, that make up ``text``, in code points.

    Ends take in the white space that follows; the first unit begins with the text.
    """
    stops = cut(text)[1] if stops is None else stops
    upto = np.array([m.end() for m in _WORD.finditer(text)], dtype=np.int64)
    if not len(stops):
        return []
    bounds = upto[stops - 1].tolist()
    bounds[-1] = len(text)
    return list(zip([0, *bounds[:-1]], bounds, strict=True))


def row_key(doc_id: str, text: Column) -> tuple[Column, Column, Column]:
    """has, doc_id and th: what tells texts apart and orders them. Null ids come first."""
    return F.col(doc_id).isNotNull().cast("byte").alias("has"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64(text).alias("th")


def later_places(rows: DataFrame, buckets: int) -> DataFrame:
    """has, doc_id, th, at: the first units of runs of ``rows`` (has, doc_id, th, text) that are not the first of their hash.

    The first is the least by doc_id (null before all), text hash, place.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = _Sent(SENT)
        for b in chain.from_iterable(_chunks(whole, CHUNK, CHUNK_BYTES) for whole in batches):
            found = [runs(t.as_py()) for t in b.column(3)]
            n = [len(h) for h in found]
            places = np.zeros(sum(n), _PLACE)
            places["h"] = np.concatenate(found)
            for i, k in enumerate(("has", "doc_id", "th")):
                places[k] = np.repeat(b.column(i).to_numpy(zero_copy_only=False), n)
            places["at"] = np.concatenate([np.arange(k) for k in n])
            places, later = sent.fresh(*_firsts(places))
            at = ((places["h"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # rises with h
            cuts = np.flatnonzero(np.diff(at)) + 1
            out = [(int(k), True, x.tobytes()) for k, x in zip(at[np.concatenate([[0], cuts])], np.split(places, cuts), strict=True)] if len(at) else []
            if len(later):  # settled already: dealt by what differs between copies too
                out.append(((int(later["doc_id"][0]) + int(later["th"][0])) % buckets, False, later.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.bool_(), pa.binary()))], names=["bucket", "open", "places"])

    def settle(group: pa.Table) -> pa.Table:
        told = group["open"].to_pylist()
        parts = [np.frombuffer(p.as_buffer(), _PLACE) for p in group["places"]]
        _, later = _firsts(np.concatenate([p for p, o in zip(parts, told, strict=True) if o] or [np.zeros(0, _PLACE)]))
        out = np.concatenate([later, *(p for p, o in zip(parts, told, strict=True) if not o)])
        return pa.table({k: pa.array(np.ascontiguousarray(out[k])) for k in _ORDER})

    sent = rows.select("has", "doc_id", "th", "text").mapInArrow(send, "bucket long, open boolean, places binary")
    return sent.groupBy("bucket").applyInArrow(settle, "has byte, doc_id long, th long, at int")


def _chunks(batch: pa.RecordBatch, texts: int, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of up to so many ``texts``, and of ``most`` bytes besides one more text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy().astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        full = int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most)) + 1
        stop = min(batch.num_rows, begin + texts, full)
        yield batch.slice(begin, stop - begin)
        begin = stop


def _firsts(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each hash, by hash, and those that come after them. Rows equal in id and text fare alike."""
    places = places[np.argsort(places["h"], kind="stable")]
    first = np.ones(len(places), bool)
    first[1:] = places["h"][1:] != places["h"][:-1]
    tied = ~first
    tied[:-1] |= tied[1:]
    some = places[tied]
    some = some[np.lexsort([*(some[k] for k in reversed(_ORDER)), some["h"]])]
    new = first[tied]
    lead = some[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(some) else some
    places[tied] = some
    return places[first], some[~new & (some != lead)]


class _Sent:
    """Places that a task has sent, the least of each hash, up to ``most``. What is forgotten is only sent once more."""

    def __init__(self, most: int) -> None:
        self.most, self.places, self.hits = most, np.zeros(0, _PLACE), np.zeros(0, np.int32)

    def fresh(self, places: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ``places`` (one of each hash, by hash) those to send; ``later`` with those that come after a sent one."""
        at = np.searchsorted(self.places["h"], places["h"])
        again = np.zeros(len(places), bool)
        inside = at < len(self.places)
        again[inside] = self.places["h"][at[inside]] == places["h"][inside]
        new, old, at = places[again], self.places[at[again]], at[again]
        self.hits[at] += 1
        before, same = np.zeros(len(new), bool), np.ones(len(new), bool)
        for k in _ORDER:
            before |= same & (new[k] < old[k])
            same &= new[k] == old[k]
        self.places[at[before]] = new[before]
        after = np.zeros(len(places), bool)
        after[again] = ~before
        later = np.concatenate([later, new[~before & ~same]])
        if len(self.places) + len(places) > self.most:
            keep = self.hits > 0
            if 2 * keep.sum() > self.most:
                keep = self.hits > np.median(self.hits[keep])
            self.places, self.hits = self.places[keep], self.hits[keep] // 2
        add, room = places[~again], self.most - len(self.places)
        add = add[:: -(-len(add) // room) or 1] if room > 0 else add[:0]
        to = np.searchsorted(self.places["h"], add["h"])
        self.places, self.hits = np.insert(self.places, to, add), np.insert(self.hits, to, 0)
        return places[~after], later


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, n_sentences, n_removed, removed: a row for each row of ``docs``.

    ``text`` is what is left; ``removed`` has the removed spans as start:end in code points of the original, comma-
    joined. Later copies of a text lose all of it. Rows equal in id and text count as one text and fare alike, rows
    with a null id come before all others, null texts stay null and have no sentence. An empty table gives an empty
    result; other columns are left out. Texts are shuffled once, to meet their ranges.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), *row_key(doc_id, F.col(text)), F.col(text).alias("text"))
    buckets = max(LEAST_BUCKETS, BUCKETS * rows.rdd.getNumPartitions())
    ranges = later_places(rows, buckets).groupBy("has", "doc_id", "th").agg(F.collect_set("at").alias("at"))
    marked = rows.join(ranges.hint("shuffle_hash"), ["has", "doc_id", "th"], "left").select("id", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t, at in zip((x.as_py() for x in b.column(1)), b.column(2), strict=True):
                _, stops = cut(t)
                if not at.is_valid:
                    out.append((t, len(stops), 0, ""))
                    continue
                own, n = np.asarray(at.values), len(stops) + 1
                edge = np.bincount(own, minlength=n) - np.bincount(spans(stops)[own], minlength=n)
                gone = np.cumsum(edge[:-1]) > 0
                left, removed = [], []
                for (s, e), g in zip(units(t, stops), gone.tolist(), strict=True):
                    if not g:
                        left.append(t[s:e])
                    elif removed and removed[-1][1] == s:
                        removed[-1][1] = e
                    else:
                        removed.append([s, e])
                out.append(("".join(left), len(stops), int(gone.sum()), ",".join(f"{s}:{e}" for s, e in removed)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=["doc_id", "text", "n_sentences", "n_removed", "removed"])

    return marked.mapInArrow(run, "doc_id long, text string, n_sentences long, n_removed long, removed string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
