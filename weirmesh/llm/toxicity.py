"""Toxicity from a learned lexicon, misspellings included, and the context of each hit.

Terms are learned from labelled texts: words, and stems that many different words begin with, that
occur in toxic texts in various contexts and hardly elsewhere. They form a trie. Every distinct
word is intersected with it through a Levenshtein automaton, so misspelled terms are caught. The
context of a hit tells quotation (quotation marks, verbs of speech) from abuse. A logistic model
over the counts of hits gives the score.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmesh.llm import text as tx
from weirmesh.llm.decontaminate import _Fold

SAMPLE, SAMPLE_CHARS = 2000, 12000  # toxic texts, half as many as others, and characters of each, that training sees
CONTEXTS = 5  # least number of different neighbourhoods of a term in toxic texts
FUZZY_LENGTH = 5  # letters a term needs to be matched with one edit
WINDOW = 8  # words on either side that make up a hit's context
#: Verbs that introduce a quotation, and forms of address.
SPEECH = frozenset("said says quoted quote quotes wrote writes called reported according sagte schrieb zitiert laut dit selon cite dijo escribió cita según".split())
ADDRESS = frozenset("you your yourself du dich dir dein ihr euch tu toi te ton vous votre tú ti tus usted ustedes vosotros".split())


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


class Trie:
    """Terms and stems; a stem stands for every word that begins with it."""

    def __init__(self, terms: list[str], stems: list[str]) -> None:
        self.root: dict = {}
        for words, mark in ((terms, "$"), (stems, "*")):
            for w in words:
                node = self.root
                for c in w:
                    node = node.setdefault(c, {})
                node[mark] = w

    def match(self, word: str, edits: int = 1) -> tuple[int, str] | None:
        """Fewest edits to a term (or from a stem to the word's beginning), and that term.

        Walks trie and automaton together: a state is the row of edit distances between the term so
        far and every prefix of the word; a branch ends where all of them pass the limit. Only
        terms of FUZZY_LENGTH letters and more may differ; neighbouring letters may swap.
        """
        node = self.root
        for i, c in enumerate(word):  # exact first
            if "*" in node:
                return 0, node["*"]
            if c not in node:
                break
            node = node[c]
            if i == len(word) - 1 and ("$" in node or "*" in node):
                return 0, node.get("$") or node["*"]
        if len(word) < FUZZY_LENGTH - edits:
            return None
        best, width, n = None, 2 * edits + 1, len(word)
        far = edits + 1
        # a row holds the distances to the word's first depth - edits .. depth + edits letters
        stack = [(self.root, 0, [k - edits if k >= edits else far for k in range(width)], None, "")]
        while stack:
            node, depth, row, older, last = stack.pop()
            for mark in ("$", "*"):
                term = node.get(mark)
                if term and len(term) >= FUZZY_LENGTH + (mark == "*"):
                    k = n - depth + edits
                    d = min(row) if mark == "*" else row[k] if 0 <= k < width else far
                    if d <= edits and (best is None or d < best[0]):
                        best = (d, term)
            for c, child in node.items():
                if c == "$" or c == "*":
                    continue
                new = [far] * width
                for k in range(width):
                    j = depth + 1 - edits + k
                    if j < 0 or j > n:
                        continue
                    d = row[k + 1] + 1 if k + 1 < width else far
                    if k and new[k - 1] + 1 < d:
                        d = new[k - 1] + 1
                    if j:
                        d = min(d, row[k] + (word[j - 1] != c))
                        if older and j > 1 and word[j - 2] == c and word[j - 1] == last:
                            d = min(d, older[k] + 1)  # neighbours swapped
                    new[k] = d
                if min(new) <= edits:
                    stack.append((child, depth + 1, new, row, c))
        return best


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [-3.0, 4.0, 2.0, 0.5, 1.0])


class Matcher:
    """Verdicts on distinct words, kept from batch to batch: 2 a term, 1 a misspelling, 3 speech, 4 address."""

    def __init__(self, model: Model, keep: int = 2_000_000) -> None:
        self.trie, self.keep = Trie(model.terms, model.stems), keep
        self.hash, self.verdict = np.zeros(0, np.uint64), np.zeros(0, np.int8)
        # an edit in one half of a term leaves the other half: its first two or its last two letters,
        # and about its length; bit n of an entry allows n bytes
        heads, tails = np.zeros(65536, np.uint64), np.zeros(65536, np.uint64)
        for w in [*model.terms, *SPEECH, *ADDRESS]:
            b = w.encode()
            bits = np.uint64(sum(1 << n for n in range(max(len(b) - 2, 0), len(b) + 4)))
            if len(b) > 1:
                heads[b[0] * 256 + b[1]] |= bits
                if len(w) >= FUZZY_LENGTH:
                    tails[b[-2] * 256 + b[-1]] |= bits
        # a stem's last two bytes may be found where they are in the stem, give or take a letter's bytes
        ends = np.zeros(65536, np.uint64)
        for w in model.stems:
            b = w.encode()
            heads[b[0] * 256 + b[1]] = np.uint64(2**64 - 1)
            if len(w) > FUZZY_LENGTH:
                ends[b[-2] * 256 + b[-1]] |= np.uint64(sum(1 << n for n in range(max(len(b) - 6, 0), min(len(b) + 3, 64))))
        self.heads, self.tails, self.ends = heads, tails, ends
        self.deepest = int(np.bitwise_or.reduce(ends)).bit_length()

    def __call__(self, w: _Fold) -> np.ndarray:
        word, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        out = np.zeros(len(word), np.int8)
        if len(self.hash):
            i = np.minimum(np.searchsorted(self.hash, word), len(self.hash) - 1)
            known = self.hash[i] == word
            out[known] = self.verdict[i[known]]
        else:
            known = np.zeros(len(word), bool)
        fresh = np.flatnonzero(~known)
        s, e = w.starts[at[fresh]], w.ends[at[fresh]]
        n = e - s
        d = w.data.astype(np.int32)
        end = max(len(d) - 1, 0)
        head = d[s] * 256 + d[np.minimum(s + 1, end)] if len(fresh) else np.zeros(0, np.int32)
        tail = d[np.maximum(e - 2, 0)] * 256 + d[e - 1] if len(fresh) else head
        size = np.minimum(n, 63).astype(np.uint64)
        may = (((self.heads[head] | self.tails[tail]) >> size) & np.uint64(1)) > 0
        for k in range(self.deepest if len(fresh) else 0):
            pair = d[np.minimum(s + k, end)] * 256 + d[np.minimum(s + k + 1, end)]
            may |= (n >= k + 2) & (((self.ends[pair] >> np.uint64(k)) & np.uint64(1)) > 0)
        try_ = fresh[(n >= 2) & may]
        raw = w.data.tobytes()
        for i in try_:
            x = raw[w.starts[at[i]] : w.ends[at[i]]].decode("utf-8", "replace").lower()
            found = self.trie.match(x)
            out[i] = (2 if found[0] == 0 else 1) if found else 3 if x in SPEECH else 4 if x in ADDRESS else 0
        if len(self.hash) + len(fresh) > self.keep:
            self.hash, self.verdict = word, out
        else:
            self.hash, self.verdict = np.concatenate([self.hash, word[fresh]]), np.concatenate([self.verdict, out[fresh]])
            order = np.argsort(self.hash)
            self.hash, self.verdict = self.hash[order], self.verdict[order]
        return out[back]


def _quoted(raw: np.ndarray, off: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a position lies between quotation marks of its text."""
    straight = np.concatenate([[0], np.cumsum(raw == 34)])
    inside = (straight[starts] - straight[off[doc]]) % 2 == 1
    inside &= straight[off[doc + 1]] - straight[starts] > 0  # a mark without its pair encloses nothing
    for opening, closing in ((b"\xe2\x80\x9c", b"\xe2\x80\x9d"), (b"\xe2\x80\x9e", b"\xe2\x80\x9c"), (b"\xc2\xab", b"\xc2\xbb")):
        depth = np.zeros(len(raw) + 1, np.int64)
        for mark, v in ((opening, 1), (closing, -1)):
            hit = np.ones(max(len(raw) - len(mark) + 1, 0), bool)
            for j, c in enumerate(mark):
                hit &= raw[j : len(raw) - len(mark) + 1 + j] == c
            depth[1:][np.flatnonzero(hit)] += v
        total = np.cumsum(depth)
        inside |= total[starts] - total[off[doc]] > 0
    return inside


def features(column: pa.Array, matcher: Matcher) -> np.ndarray:
    """For each text: 1, log counts of terms, misspellings and quoted hits, and the densest abuse."""
    w = _Fold(column)
    n = len(w.n)
    verdict = matcher(w) if len(w.hash) else np.zeros(0, np.int8)
    doc = np.repeat(np.arange(n), w.n)
    hit = np.flatnonzero((verdict == 1) | (verdict == 2))
    near = lambda kind: np.concatenate([[0], np.cumsum(verdict == kind)])
    lo, hi = np.maximum(hit - WINDOW, w.at[doc[hit]]), np.minimum(hit + WINDOW + 1, w.at[doc[hit] + 1])
    raw, _ = tx.buffers(column)
    quoted = _quoted(raw, w.off, w.starts[hit], doc[hit]) if len(hit) else np.zeros(0, bool)
    speech, address = near(3), near(4)
    spoken, addressed = speech[hi] > speech[lo], address[hi] > address[lo]
    quoted &= spoken | ~addressed  # marks around an insult to the reader don't excuse it
    exact, abuse = verdict[hit] == 2, ~quoted
    count = lambda mask: np.bincount(doc[hit[mask]], minlength=n)
    total = np.concatenate([[0], np.cumsum(np.bincount(hit[abuse], minlength=len(verdict)))]) if len(verdict) else np.zeros(1)
    dense = np.zeros(n)
    np.maximum.at(dense, doc[hit[abuse]], (total[hi] - total[lo])[abuse])
    return np.stack([np.ones(n), np.log1p(count(abuse & exact)), np.log1p(count(abuse & ~exact)), np.log1p(count(quoted)), np.log1p(dense)], axis=1)


def learn_terms(texts: list[str], toxic: np.ndarray, contexts: int = CONTEXTS) -> tuple[list[str], list[str]]:
    """Terms and stems: in at least contexts different neighbourhoods in toxic texts, at most a
    twentieth as many other texts, and no neighbourhood that makes up a third: copies of one text
    share their neighbourhoods."""
    bad: dict[str, Counter] = defaultdict(Counter)
    clean: Counter = Counter()
    clean_stems: Counter = Counter()
    table = _Fold.table.tobytes()
    split = lambda t: [x.decode("utf-8", "replace").lower() for x in t.encode().translate(table).split()]
    for t, y in zip(texts, toxic, strict=True):
        words = split(t)
        if y:
            for i, w in enumerate(words):
                if len(w) > 3:
                    bad[w][words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""] += 1
        else:
            mine = set(words)
            clean.update(mine)
            clean_stems.update({w[:k] for w in mine for k in (4, 5, 6) if len(w) > k})
    # copies show a word over and over in the same place
    bad = {w: c for w, c in bad.items() if 3 * max(c.values()) <= sum(c.values()) or sum(c.values()) < contexts}
    # so many that not one of all words would get there in toxic texts alone by chance
    ours = sum(len(t) for t, y in zip(texts, toxic, strict=True) if y) / max(sum(map(len, texts)), 1)
    least = max(contexts, math.ceil(math.log(0.01 / (len(bad) + len(clean) + 1)) / math.log(min(max(ours, 1e-6), 0.999999))))
    terms = [w for w, c in bad.items() if len(c) >= least and 20 * clean[w] <= len(c)]
    begin: dict[str, dict[str, int]] = defaultdict(dict)
    for w, c in bad.items():
        if 20 * clean[w] <= len(c):
            for k in (4, 5, 6):
                if len(w) > k:
                    begin[w[:k]][w] = len(c)
    often = {s: sum(ws.values()) for s, ws in begin.items() if len(ws) >= 4}
    stems = {s for s, n in often.items() if n >= 2 * least and 20 * (clean_stems[s] + clean[s]) <= n and 2 * max(begin[s].values()) <= n}
    stems = {s for s in stems if not any(s[:k] in stems for k in range(4, len(s)))}
    return sorted(terms), sorted(stems)  # a term under a stem stays, for its misspellings


def fit(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-3) -> list[float]:
    """Logistic regression by Newton steps; classes weigh as they come."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) / len(y) - ridge * w)
    return [float(v) for v in w]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, toxic) that aren't held out.

    Fitted on a sample: about sample toxic and twice as many other texts, chosen by a hash of doc_id, and at most chars
    characters of each from a hashed place. Without labelled rows the model knows no term.
    """
    marked = labels.filter("toxic is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = {r[0]: r[1] for r in marked.groupBy((F.col("toxic") == 1).alias("t")).count().collect()}  # two rows
    h = F.xxhash64("doc_id", F.lit(13))
    rate = F.when(F.col("toxic") == 1, sample / max(count.get(True, 0), 1)).otherwise(2 * sample / max(count.get(False, 0), 1))
    chosen = marked.filter(F.pmod(h, F.lit(1 << 20)) < rate * (1 << 20)).limit(30 * sample)  # about 3 * sample rows; the limit only proves the bound
    start = F.lit(1) + F.pmod(F.shiftright(h, 20), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int")
    rows = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select((F.col("toxic") == 1).alias("y"), h.alias("h"), F.substr("text", start, F.lit(chars)).alias("t"))
    rows = rows.orderBy("h", F.xxhash64("t")).limit(30 * sample)  # an id may stand in many rows
    rows = sorted((bool(r["y"]), r["h"], r["t"]) for r in rows.collect())  # about 3 * sample rows
    model = Model()
    if not rows:
        return model
    y = np.array([r[0] for r in rows])
    texts = [r[2] for r in rows]
    model.terms, model.stems = learn_terms(texts, y)
    matcher = Matcher(model)
    x = np.concatenate([features(pa.array(texts[i : i + 250], pa.string()), matcher) for i in range(0, len(texts), 250)])
    if 0 < y.mean() < 1:
        model.weights = fit(x, y.astype(float))
    return model


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, w = Matcher(model), np.array(model.weights)
        for b in tx.pieces(batches, "row.text"):
            p = 1 / (1 + np.exp(-np.clip(features(tx.field(b, "row.text"), matcher) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(p)], ["row", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row (all columns of docs as a struct) and score (0 to 1) for every row of docs(text, ..).

    Null and empty texts have the score of a text without hits. Texts are read whole.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.mapInArrow(_score(model), rows.select("row").schema.add("score", "double"))
