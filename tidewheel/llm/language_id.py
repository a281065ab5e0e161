"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy.

The network runs over a text's bytes forwards and backwards, across words, and labels every position; a document's
probabilities are the mean over all its positions. Texts are run in windows of ``WINDOW`` bytes, each with ``CONTEXT``
bytes before and after it from which the states come in, so that windows of all texts of a batch run side by side and
memory does not grow with a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import held_out, learnable, table

UNITS, STEPS, BATCH, SPAN, RATE, SEED = 12, 400, 128, 64, 0.01, 5
#: Bytes that a window labels, and bytes before and after it that only bring the states in; windows that run side by side.
WINDOW, CONTEXT, SIDE = 512, 24, 512
#: Positions of those windows that are labelled at once.
PART = 32
#: Bounds of the training sample: documents of each language, and characters of each (from a hashed offset on).
SAMPLE_DOCS, SAMPLE_CHARS = 150, 3000


def bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Two gated recurrent layers, one for each direction, and a softmax over languages at each byte."""

    def __init__(self, langs: list[str], units: int = UNITS, seed: int = SEED) -> None:
        r = np.random.default_rng(seed)
        self.langs, self.units = langs, units
        f = np.float32
        self.p = {"V": r.normal(0, 0.3, (2 * units, len(langs))).astype(f), "c": np.zeros(len(langs), f)}
        for d in "fb":
            self.p["E" + d] = r.normal(0, 0.3, (256, 3 * units)).astype(f)
            self.p["U" + d] = r.normal(0, 1 / np.sqrt(units), (units, 3 * units)).astype(f)

    def _run(self, x: np.ndarray, d: str, tape: list | None) -> np.ndarray:
        """States after each position of ``x`` (windows, positions), in the order of positions."""
        u, (e, w) = self.units, (self.p["E" + d], self.p["U" + d])
        h, out = np.zeros((len(x), u), np.float32), np.empty((*x.shape, u), np.float32)
        for t in range(x.shape[1]) if d == "f" else reversed(range(x.shape[1])):
            a, g = e[x[:, t]], h @ w
            zr = _sigmoid(a[:, : 2 * u] + g[:, : 2 * u])
            z, r = zr[:, :u], zr[:, u:]
            n = np.tanh(a[:, 2 * u :] + r * g[:, 2 * u :])
            if tape is not None:
                tape.append((t, h, z, r, n, g[:, 2 * u :]))
            h = n + z * (h - n)
            out[:, t] = h
        return out

    def label(self, x: np.ndarray, tapes: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (windows, positions, languages), and the states they come from."""
        h = np.concatenate([self._run(x, d, tapes[d] if tapes else None) for d in "fb"], axis=2)
        s = h @ self.p["V"] + self.p["c"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        return s / s.sum(axis=2, keepdims=True), h

    def _gates(self) -> tuple[np.ndarray, np.ndarray]:
        """The tables of bytes (gates, directions and bytes, units) and of states (gates, directions, units, units).

        What only enters a sigmoid's tanh, or the new state times one of them, is halved here and not at every position.
        """
        e = np.concatenate([self.p["E" + d].reshape(256, 3, -1).transpose(1, 0, 2) for d in "fb"], axis=1)
        w = np.stack([self.p["U" + d].reshape(-1, 3, self.units).transpose(1, 0, 2) for d in "fb"], axis=1)
        half = np.array([0.5, 0.5, 1], np.float32)[:, None, None]
        return np.ascontiguousarray(e * half, np.float32), np.ascontiguousarray(w * np.float32(0.5), np.float32)

    def _states(self, x: np.ndarray, there: np.ndarray | None) -> np.ndarray:
        """``_run`` in both directions at once, over ``x`` (positions, windows): states (positions, windows, units of both).

        Gates lie one after another and every step writes into the same arrays. Backwards, states are 0 where nothing is
        ``there``.
        """
        (e, w), u, (n, side) = self._gates(), self.units, x.shape
        h, out = np.zeros((2, side, u), np.float32), np.empty((n, side, 2 * u), np.float32)
        a, g = np.empty((3, 2, side, u), np.float32), np.empty((3, 2, side, u), np.float32)
        at = np.empty((2, side), np.intp)
        z, r, new = g
        for t in range(n):
            back = n - 1 - t
            at[0] = x[t]
            np.add(x[back], 256, out=at[1], dtype=np.intp)
            np.take(e, at, axis=1, out=a, mode="clip")
            np.matmul(h, w, out=g)
            zr = g[:2]
            zr += a[:2]
            np.tanh(zr, out=zr)
            zr += 1
            new *= r
            new += a[2]
            np.tanh(new, out=new)
            h -= new
            h *= z
            h *= 0.5
            h += new
            if there is not None:
                h[1] *= there[back, :, None]
            out[t, :, :u], out[back, :, u:] = h[0], h[1]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy at all positions: backpropagation through time."""
        u, tapes = self.units, {"f": [], "b": []}
        p, h = self.label(x, tapes)
        ds = p.copy()
        ds[np.arange(len(x)), :, y] -= 1
        ds /= x.size
        out = {"V": np.tensordot(h, ds, ((0, 1), (0, 1))), "c": ds.sum((0, 1))}
        dh_all = ds @ self.p["V"].T
        for i, d in enumerate("fb"):
            w, de, dw = self.p["U" + d], np.zeros_like(self.p["E" + d]), np.zeros_like(self.p["U" + d])
            dh = np.zeros((len(x), u), np.float32)
            for t, h0, z, r, n, gn in reversed(tapes[d]):
                dh = dh + dh_all[:, t, i * u : (i + 1) * u]
                dan = dh * (1 - z) * (1 - n * n)
                daz = dh * (h0 - n) * z * (1 - z)
                dar = dan * gn * r * (1 - r)
                dg = np.concatenate([daz, dar, dan * r], axis=1)
                hot = np.zeros((len(x), 256), np.float32)
                hot[np.arange(len(x)), x[:, t]] = 1
                de += hot.T @ np.concatenate([daz, dar, dan], axis=1)
                dw += h0.T @ dg
                dh = dh * z + dg @ w.T
            out["E" + d], out["U" + d] = de, dw
        return out

    def sums(self, windows: list[tuple[np.ndarray, int, int]]) -> np.ndarray:
        """For each window (bytes, begin, end) its probabilities summed over the positions from begin to end."""
        out, v, c = np.zeros((len(windows), len(self.langs))), self.p["V"].T, self.p["c"][:, None]
        order = sorted(range(len(windows)), key=lambda i: len(windows[i][0]))  # windows of like length run side by side
        for at in range(0, len(order), SIDE):
            some = order[at : at + SIDE]
            x = np.zeros((len(windows[some[-1]][0]), len(some)), np.uint8)
            there, core = np.zeros(x.shape, np.float32), np.zeros(x.shape, np.float32)
            for row, i in enumerate(some):
                own, begin, end = windows[i]
                x[: len(own), row], there[: len(own), row], core[begin:end, row] = own, 1, 1
            h = self._states(x, None if there.all() else there)
            for t in range(0, len(x), PART):
                part = h[t : t + PART]
                s = (v @ part.reshape(-1, 2 * self.units).T + c).reshape(-1, *part.shape[:2])
                s -= s.max(axis=0)
                np.exp(s, out=s)
                s *= core[t : t + PART] / s.sum(axis=0)
                out[some] += s.sum(axis=1).T
        return out


def windows_of(text: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """A text's windows with their contexts, and where in each the window begins and ends."""
    for at in range(0, len(text), WINDOW):
        start, end = max(0, at - CONTEXT), min(len(text), at + WINDOW)
        yield text[start : end + CONTEXT], at - start, end - start


def train(texts: list[tuple[str, str]], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Network | None:
    """A network from (lang, text), by Adam on stretches of ``SPAN`` bytes; None without a word."""
    langs = sorted({lang for lang, _ in texts})
    streams = [np.concatenate([bytes_of(t + "\n") for k, t in texts if k == lang]) for lang in langs]
    if not any(t.strip() for _, t in texts):
        return None
    streams = [np.resize(x, max(len(x), SPAN + 1)) for x in streams]
    share = np.array([len(x) for x in streams], dtype=np.float64)
    net, r = Network(langs, seed=seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = r.choice(len(langs), batch, p=share / share.sum())
        starts = [int(r.integers(0, len(streams[k]) - SPAN)) for k in y]
        x = np.stack([streams[k][i : i + SPAN] for k, i in zip(y, starts, strict=True)])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in net.gradients(x, y).items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.p[k] -= (now * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def sample(docs: DataFrame, per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(lang, text): a bounded sample of the rows that may be learned from, fixed by a hash of the id."""
    h = F.xxhash64(F.col(doc_id), F.lit(SEED))
    rows = docs.where(learnable(doc_id) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), h.alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    per_lang = max(1, min(per_lang, 100_000 // len(counts)))
    most = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * per_lang / n))])
    start = F.pmod("h", F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    drawn = rows.where(F.pmod("h", F.lit(1 << 30)) < most[F.col("lang")] * (1 << 30)).select("lang", "h", F.substring("text", start, F.lit(chars)).alias("part"))
    got = sorted((r["lang"], r["h"], r["part"]) for r in drawn.collect())
    seen: Counter = Counter()
    out = []
    for name, _, part in got:
        seen[name] += 1
        if seen[name] <= per_lang:
            out.append((name, part))
    return out


def identify(docs: DataFrame, net: Network | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row for each row of ``docs``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Repeated rows are labelled
    alike, null ids kept, an empty table gives an empty result, other columns are left out.
    """
    n = len(net.langs) if net else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SIDE):
                b = whole.slice(at, SIDE)
                able = np.array([bool(x) and n > 0 for x in b.column(3).to_pylist()], dtype=bool)
                pooled, size = np.zeros((b.num_rows, n)), np.ones(b.num_rows)
                held: list[tuple[np.ndarray, int, int]] = []
                of: list[int] = []

                def settle(held=held, of=of, pooled=pooled) -> None:
                    np.add.at(pooled, of, net.sums(held))
                    held.clear()
                    of.clear()

                for i in np.flatnonzero(able):
                    text = bytes_of(b.column(2)[int(i)].as_py())
                    size[i] = len(text)
                    for window in windows_of(text):
                        held.append(window)
                        of.append(int(i))
                        if len(held) >= 8 * SIDE:
                            settle()
                if held:
                    settle()
                pooled /= size[:, None]
                best = pooled.argmax(axis=1) if n else np.zeros(b.num_rows, dtype=int)
                score = np.where(able, pooled.max(axis=1) if n else 0.0, 0.0).clip(0, 1)
                pred = [net.langs[j] if ok else "und" for j, ok in zip(best, able, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    letter = F.coalesce(F.regexp_like(F.col(text), F.lit("\\p{L}")), F.lit(False))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"), letter.alias("letter"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(sample(docs)))
