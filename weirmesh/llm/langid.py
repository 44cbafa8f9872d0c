"""Language by a convolutional network over bytes.

Every window of 256 bytes passes an embedding, filters of widths 2, 3 and 4, max pooling over
positions and a softmax; a text's probabilities are the mean over all of its windows. The network
is trained in numpy. To apply it, embedding and filters are folded into tables by byte pair, so a
filter's value at a position is the sum of one or two table rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmesh.llm import text as tx

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 8, 8
SAMPLE_TEXTS, SAMPLE_CHARS = 400, 2048  # labelled texts for each language, and characters of each, that training sees
UNKNOWN = "und"


def windows(data: np.ndarray, off: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Rows of size bytes that cover all texts, zero-padded, and each row's text number."""
    n = np.diff(off)
    count = -(-n // size)
    of = np.repeat(np.arange(len(n)), count)
    first = np.repeat(off[:-1], count) + (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * size
    at = first[:, None] + np.arange(size)
    inside = at < off[of + 1][:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0).astype(np.uint8), of


class Network:
    def __init__(self, classes: list[str], seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"e": r.normal(0, 0.5, (256, EMBED)), "v": r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes))), "c": np.zeros(len(classes))}
        for w in WIDTHS:
            self.p[f"f{w}"], self.p[f"b{w}"] = r.normal(0, 0.3, (w * EMBED, FILTERS)), np.zeros(FILTERS)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 2) -> None:
        """Adam on cross-entropy; x are windows, y class numbers."""
        r, p = np.random.default_rng(seed), self.p
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            i = r.integers(0, len(x), batch)
            g = self._gradient(x[i], y[i])
            for k, d in g.items():
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] -= rate * (1 - t / steps) * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, e = self.p, self.p["e"][x]
        pooled, kept = [], []
        for w in WIDTHS:
            cols = np.concatenate([e[:, j : WINDOW - w + 1 + j] for j in range(w)], axis=2)
            z = cols @ p[f"f{w}"] + p[f"b{w}"]
            top = z.argmax(axis=1)
            pooled.append(np.maximum(np.take_along_axis(z, top[:, None], 1)[:, 0], 0))
            kept.append((cols, top))
        h = np.concatenate(pooled, axis=1)
        z = h @ p["v"] + p["c"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(len(y)), y] -= 1
        q /= len(y)
        g = {"v": h.T @ q, "c": q.sum(axis=0), "e": np.zeros_like(p["e"])}
        dh = (q @ p["v"].T) * (h > 0)
        row = np.arange(len(x))
        for k, w in enumerate(WIDTHS):
            cols, top = kept[k]
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"] = d.sum(axis=0)
            picked = cols[row[:, None], top]  # batch, filter, w * EMBED
            g[f"f{w}"] = np.einsum("bf,bfc->cf", d, picked)
            back = (d[:, :, None] * p[f"f{w}"].T[None]).reshape(len(x), FILTERS, w, EMBED)
            at = x[row[:, None, None], top[:, :, None] + np.arange(w)]
            np.add.at(g["e"], at, back)
        return g

    def tables(self) -> dict[str, np.ndarray]:
        """Filter values by byte pair; an odd last byte has a table of its own."""
        e, out = self.p["e"], {}
        for w in WIDTHS:
            f = self.p[f"f{w}"].reshape(w, EMBED, FILTERS)
            one = [e @ f[j] for j in range(w)]
            for j in range(0, w - 1, 2):
                out[f"{w}.{j}"] = (one[j][:, None] + one[j + 1][None]).reshape(65536, FILTERS).astype(np.float32)
            if w % 2:
                out[f"{w}.{w - 1}"] = one[w - 1].astype(np.float32)
        return out | {f"b{w}": self.p[f"b{w}"].astype(np.float32) for w in WIDTHS} | {"v": self.p["v"].astype(np.float32), "c": self.p["c"].astype(np.float32)}


def probabilities(t: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    out = []
    for i in range(0, len(x), 512):
        rows = x[i : i + 512].astype(np.int32)
        pair = rows[:, :-1] * 256 + rows[:, 1:]
        pooled = []
        for w in WIDTHS:
            n = WINDOW - w + 1
            z = t[f"{w}.0"][pair[:, :n]]
            for j in range(2, w, 2):
                z += t[f"{w}.{j}"][pair[:, j : j + n] if j + 1 < w else rows[:, j : j + n]]
            pooled.append(np.maximum(z.max(axis=1) + t[f"b{w}"], 0))
        z = np.concatenate(pooled, axis=1) @ t["v"] + t["c"]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        out.append(q / q.sum(axis=1, keepdims=True))
    return np.concatenate(out) if out else np.zeros((0, len(t["c"])))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS, steps: int = 400) -> Network | None:
    """A network for the languages of docs(doc_id, text, lang) that aren't held out.

    It is fitted on a sample: about texts documents of each language, chosen by a hash, and a run of
    chars characters at a hashed place of each. None if no row is labelled.
    """
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("doc_id", "lang", "text")
    count = F.broadcast(rows.groupBy("lang").agg(F.count("*").alias("n")))  # a row for each class of the network, which the driver holds; texts aren't shuffled
    h = F.xxhash64("doc_id", F.lit(5))
    rate = F.pmod(h, F.lit(1 << 20)) < F.lit((1 << 20) * texts) / F.col("n")
    start = F.lit(1) + F.pmod(F.shiftright(h, 20), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int")
    found = sorted(tuple(r) for r in rows.join(count, "lang").filter(rate).select("lang", h.alias("h"), F.substr("text", start, F.lit(chars)).alias("t")).collect())  # about texts rows for each language
    if not found:
        return None
    classes = sorted({r[0] for r in found})
    x, of = windows(*tx.buffers(pa.array([r[2] for r in found])))
    y = np.array([classes.index(r[0]) for r in found])[of]
    full = (x != 0).sum(axis=1) >= 40
    x, y = (x[full], y[full]) if full.any() else (x, y)
    pick = np.random.default_rng(3)
    by = [np.flatnonzero(y == c) for c in range(len(classes))]
    most = max(map(len, by))
    even = np.concatenate([pick.choice(b, most) for b in by if len(b)])  # languages weigh the same
    net = Network(classes)
    net.train(x[even], y[even], steps)
    return net


def _predict(tables: dict[str, np.ndarray] | None, classes: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.pieces(batches, "row.text", 1_000_000):
            n = b.num_rows
            best, score = np.zeros(n, np.int64), np.zeros(n)
            if tables:
                x, of = windows(*tx.buffers(tx.field(b, "row.text")))
                total = np.zeros((n, len(classes)))
                q = probabilities(tables, x)
                if len(q):
                    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                    total[of[first]] = np.add.reduceat(q, first, axis=0)
                total /= np.maximum(np.bincount(of, minlength=n), 1)[:, None]
                best, score = total.argmax(axis=1), total.max(axis=1)
            letter = np.asarray(b.column("letter").fill_null(False)) & bool(tables)
            lang = pa.array([classes[k] if ok else UNKNOWN for k, ok in zip(best, letter, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("row"), lang, pa.array(np.where(letter, np.clip(score, 0, 1), 0.0))], ["row", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """row (all columns of docs as a struct), lang_pred and score for every row of docs(text, ..).

    und with score 0 where the text is null or has no letter, or nothing was learned. Ties between
    languages go to the first by name. Texts of any length are read whole, in windows.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").rlike(r"\p{L}").alias("letter"))
    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(_predict(net.tables() if net else None, net.classes if net else []), schema)
