"""Interpolated modified Kneser-Ney trigram model, counted in Spark, scored from mapped files.

Words are hashed. Every task counts the triples of its texts; the counts are dealt by the middle
word, so that all triples around it meet: those that share a context, and those that end in the same
pair. A middle word with very many triples is dealt further by the word before it, and only its
pairs are counted once more. Each part of the model is a file of sorted hash arrays in the shared
folder: a directory by the first bits of the hash, 32 bits more for each entry, counts of one byte,
and lists of the few that are larger. Scoring tasks map those files into memory, so a worker holds no
table of its own, whatever the model's size.
"""

from __future__ import annotations

import mmap
import os
import urllib.parse
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmesh.llm import text as tx
from weirmesh.plans.staging import new_path, stage_table, unstage

START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)  # not words
PIECE = 6_000_000  # bytes of text counted at once
PART_BYTES = 8_000_000  # of text, for each part of the model
HOT = 1_000_000  # occurrences of a word, above which its triples are dealt further
LOW = np.uint64((1 << 40) - 1)  # bits that tell a middle word's neighbours apart
KEPT = 256  # files that a worker keeps open


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return tx.combine([v, w & LOW])


def context_key(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tx.combine([v, u & LOW, v])


def triple_key(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return tx.combine([v, u & LOW, w & LOW, v])


@dataclass
class Hot:
    """Frequent words in order, and over how many parts each is dealt."""

    words: np.ndarray
    splits: np.ndarray

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is frequent, and its place."""
        if not len(self.words):
            return np.zeros(len(v), bool), np.zeros(len(v), np.int64)
        at = np.minimum(np.searchsorted(self.words, v), len(self.words) - 1)
        return self.words[at] == v, at

    def route(self, u: np.ndarray, v: np.ndarray, parts: int) -> np.ndarray:
        """The part of a triple, by its middle word and, where that is frequent, the word before it."""
        is_hot, at = self.find(v)
        key = v.copy()
        if is_hot.any():
            salt = tx.mix(u[is_hot] & LOW) % self.splits[at[is_hot]]
            key[is_hot] = tx.combine([v[is_hot], salt])
        return part_of(key, parts)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' words, each text followed by END; of the two tokens before each, the
    farther first; token counts."""
    w = tx.Words(column)
    ends = w.at[1:] + np.arange(1, len(w.n) + 1) - 1
    t = np.full(len(w.hash) + len(w.n), END, np.uint64)
    inner = np.ones(len(t), bool)
    inner[ends] = False
    t[inner] = w.hash
    first = np.concatenate([[0], ends[:-1] + 1])[: len(w.n)]
    before, second = np.empty_like(t), np.empty_like(t)
    before[1:], second[2:] = t[:-1], t[:-2]
    before[first] = second[first] = START
    second[(first + 1)[first < ends]] = START
    return second, before, t, w.n + 1


def save(path: str, data: bytes) -> None:
    """Writes a file so that it is there whole or not at all; a repeated task writes the same."""
    where = urllib.parse.urlparse(path)
    if where.scheme in ("", "file"):
        os.makedirs(os.path.dirname(where.path), exist_ok=True)
        part = f"{where.path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, where.path)
        return
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(path)
    with store.open_output_stream(p) as f:
        f.write(data)


def pack(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
    """Sorted 64-bit keys with counts as one block of bytes."""
    n = len(keys)
    bits = min(max(n.bit_length() - 4, 1), 24)
    ends = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    out = [np.array([n, bits], np.uint64).tobytes(), ends.astype(np.uint32).tobytes(), (keys >> np.uint64(32 - bits)).astype(np.uint32).tobytes()]
    for c in columns:
        large = np.flatnonzero(c > 254)
        out += [np.minimum(c, 255).astype(np.uint8).tobytes(), np.array([len(large)], np.uint64).tobytes(), large.astype(np.uint32).tobytes(), c[large].astype(np.uint64).tobytes()]
    return b"".join(out)


class Packed:
    """What pack made, read in place."""

    def __init__(self, raw: memoryview | mmap.mmap, at: int, width: int) -> None:
        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            a = np.ndarray(n, kind, raw, at)
            at += a.nbytes
            return a

        n, self.bits = map(int, take(np.uint64, 2))
        self.ends, self.rest = take(np.uint32, (1 << self.bits) + 1), take(np.uint32, n)
        self.columns = []
        for _ in range(width):
            small = take(np.uint8, n)
            m = int(take(np.uint64, 1)[0])
            self.columns.append((small, take(np.uint32, m), take(np.uint64, m)))
        self.end = at

    def __call__(self, keys: np.ndarray) -> list[np.ndarray]:
        """Counts at keys, 0 where absent."""
        top = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        rest = (keys >> np.uint64(32 - self.bits)).astype(np.uint32)
        lo, hi = self.ends[top].astype(np.int64), self.ends[top + 1].astype(np.int64)
        stop = hi.copy()
        while (open_ := lo < hi).any():
            mid = np.where(open_, (lo + hi) // 2, 0)
            low = open_ & (self.rest[mid] < rest)
            lo, hi = np.where(low, mid + 1, lo), np.where(open_ & ~low, mid, hi)
        found = np.flatnonzero(lo < stop)
        found = found[self.rest[lo[found]] == rest[found]]
        at, out = lo[found], []
        for small, large, values in self.columns:
            c = small[at].astype(np.float64)
            over = np.flatnonzero(c == 255)
            if len(over):
                c[over] = values[np.searchsorted(large, at[over])]
            full = np.zeros(len(keys))
            full[found] = c
            out.append(full)
        return out


#: Tables of each kind of file, with their numbers of columns.
FILES = {"part": {"triple": 1, "context": 4, "pair": 1, "before": 4}, "hot": {"pair": 1}, "word": {"word": 1}, "last": {"continuation": 1}, "hot_before": {"before": 4}}
_open: OrderedDict[str, dict[str, Packed]] = OrderedDict()


def load(path: str, tables: dict[str, int]) -> dict[str, Packed]:
    """A file's tables: mapped, or read where the store can't be mapped; the files used least lately are let go."""
    if path in _open:
        _open.move_to_end(path)
        return _open[path]
    where = urllib.parse.urlparse(path)
    if where.scheme in ("", "file"):
        with open(where.path, "rb") as f:
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        from pyarrow import fs

        store, p = fs.FileSystem.from_uri(path)
        with store.open_input_file(p) as f:
            raw = f.read()
    out, at = {}, 0
    for name, width in tables.items():
        out[name] = Packed(raw, at, width)
        at = out[name].end
    _open[path] = out
    while len(_open) > KEPT:
        _open.popitem(last=False)
    return out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts keys, and where each new one begins in it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)


def _kinds(n: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Sum, and how many are 1, 2 and more, of each group of counts."""
    return [_sum(n, first), *[_sum(x, first) for x in (n == 1, n == 2, n > 2)]]


def _four(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _deal(to: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that has rows, and which."""
    to = to.astype(np.uint16) if parts <= 1 << 16 else to  # short numbers sort in one pass
    order = np.argsort(to, kind="stable")
    ends = np.append(0, np.cumsum(np.bincount(to, minlength=parts)))
    for p in np.flatnonzero(np.diff(ends)):
        yield int(p), order[ends[p] : ends[p + 1]]


_WORDS = pa.schema([("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])
_TRIPLES = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("v", "run", "u", "w", "c")]])
_META = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("n", pa.list_(pa.int64())), ("a", pa.binary()), ("b", pa.binary()), ("k", pa.binary())])
_WORDS_SQL = "part int, words binary, counts binary"
_TRIPLES_SQL = "part int, v binary, run binary, u binary, w binary, c binary"
_META_SQL = "part int, kind string, n array<long>, a binary, b binary, k binary"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict[str, bytes]]]]:
    """Rows that come sorted by part, in groups, with their binary columns."""
    last, held = None, []
    for b in batches:
        names = [f.name for f in b.schema if pa.types.is_binary(f.type)]
        columns = [b.column(c).to_pylist() for c in names]
        for i, p in enumerate(b.column("part").to_pylist()):
            if p != last and held:
                yield last, held
                held = []
            last = p
            held.append({k: c[i] or b"" for k, c in zip(names, columns, strict=True)})
    if held:
        yield last, held


def _joined(rows: list[dict[str, bytes]], column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


def _count_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.pieces(batches, "text", PIECE):
            word, n = np.unique(tokens(b.column("text"))[2], return_counts=True)
            yield _batch([(p, word[i].tobytes(), n[i].astype(np.uint32).tobytes()) for p, i in _deal(part_of(word, parts), parts)], _WORDS)

    return run


def _write_words(folder: str):
    """A file for each part; its sums, and its frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _by_part(batches):
            h, n = _joined(rows, "words", np.uint64), _joined(rows, "counts", np.uint32)
            order, first = _groups(h)
            h, n = h[order][first], _sum(n[order], first)
            save(f"{folder}/word-{p}", pack(h, [n]))
            often = n > HOT
            yield _batch([(p, "words", [int(n.sum()), len(h)], h[often].tobytes(), None, n[often].tobytes())], _META)

    return run


def _short(a: np.ndarray) -> bytes:
    """The low bits of hashes, in five bytes each."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_short(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").ravel()


def _count_triples(parts: int, hot: Hot):
    """For each piece of text and part: middle words, how many triples each has, and their u, w and c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.pieces(batches, "text", PIECE):
            u, v, w, _ = tokens(b.column("text"))
            _, at, c = np.unique(triple_key(u, v, w), return_index=True, return_counts=True)
            u, v, w = u[at], v[at], w[at]
            order = np.lexsort((u & LOW, v))
            u, v, w, c = u[order], v[order], w[order], c[order]
            rows = []
            for p, i in _deal(hot.route(u, v, parts), parts):
                first = np.flatnonzero(np.append(True, v[i][1:] != v[i][:-1]))
                rows.append((p, v[i][first].tobytes(), np.diff(np.append(first, len(i))).astype(np.uint32).tobytes(), _short(u[i]), _short(w[i]), c[i].astype(np.uint32).tobytes()))
            yield _batch(rows, _TRIPLES)

    return run


def _continuations(w: np.ndarray, parts: int) -> list[tuple]:
    """Rows that tell how many of these distinct pairs end in each word (its low bits)."""
    word, k = np.unique(w & LOW, return_counts=True)
    return [(p, "continuation", None, _short(word[i]), None, k[i].astype(np.uint32).tobytes()) for p, i in _deal(part_of(tx.mix(word), parts), parts)]


def _write_part(parts: int, folder: str, hot: Hot):
    """Merges a part's triples and writes its file. Out come how many triples and pairs have the counts
    1 to 4, the pairs of frequent words, and the other pairs' continuations.

    A context that occurs once is left out: that its pair of words was seen says as much.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _by_part(batches):
            v = np.repeat(_joined(rows, "v", np.uint64), _joined(rows, "run", np.uint32))
            u, w = (_from_short(_joined(rows, x, np.uint8)) for x in ("u", "w"))
            c = _joined(rows, "c", np.uint32)
            key = triple_key(u, v, w)
            order, first = _groups(key)
            n = _sum(c[order], first)
            key, u, v, w = (x[order][first] for x in (key, u, v, w))
            blob = pack(key, [n])
            ctx = context_key(u, v)
            order, first = _groups(ctx)
            kinds = _kinds(n[order], first)
            keep = (kinds[0] > 1) | (v[order][first] == START)
            blob += pack(ctx[order][first][keep], [k[keep] for k in kinds])
            pair = pair_key(v, w)
            order, first = _groups(pair)
            many = np.diff(np.append(first, len(order))).astype(np.uint64)
            pair, v, w = pair[order][first], v[order][first], w[order][first]
            is_hot, _ = hot.find(v)
            own = ~is_hot
            blob += pack(pair[own], [many[own]])
            order, first = _groups(v[own])
            blob += pack(v[own][order][first], _kinds(many[own][order], first))
            save(f"{folder}/part-{p}", blob)
            out = [(p, "triples", _four(n), None, None, None), (p, "pairs", [*_four(many[own]), int(own.sum())], None, None, None)]
            out += [(q, "hot", None, v[is_hot][i].tobytes(), _short(w[is_hot][i]), many[is_hot][i].astype(np.uint32).tobytes()) for q, i in _deal(part_of(pair[is_hot], parts), parts)]
            yield _batch(out + _continuations(w[own], parts), _META)

    return run


def _write_hot(parts: int, folder: str):
    """Adds up the pairs of frequent words; out come their continuations and sums by first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _by_part(batches):
            v, w = _joined(rows, "a", np.uint64), _from_short(_joined(rows, "b", np.uint8))
            pair = pair_key(v, w)
            order, first = _groups(pair)
            n = _sum(_joined(rows, "k", np.uint32)[order], first)
            pair, v, w = (x[order][first] for x in (pair, v, w))
            save(f"{folder}/hot-{p}", pack(pair, [n]))
            order, first = _groups(v)
            each = np.stack([v[order][first], *_kinds(n[order], first)], axis=1)
            out = [(p, "pairs", [*_four(n), len(n)], None, None, None)]
            out += [(q, "before", None, each[i].tobytes(), None, None) for q, i in _deal(part_of(each[:, 0], parts), parts)]
            yield _batch(out + _continuations(w, parts), _META)

    return run


def _write_before(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _by_part(batches):
            each = _joined(rows, "a", np.uint64).reshape(-1, 5)
            order, first = _groups(each[:, 0])
            save(f"{folder}/hot_before-{p}", pack(each[order][first, 0], [_sum(each[order, k], first) for k in range(1, 5)]))
            yield _batch([(p, "done", None, None, None, None)], _META)

    return run


def _write_continuations(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _by_part(batches):
            h = tx.mix(_from_short(_joined(rows, "a", np.uint8)))  # spread over all bits, as the directory goes by the first
            order, first = _groups(h)
            n = _sum(_joined(rows, "k", np.uint32)[order], first)
            save(f"{folder}/last-{p}", pack(h[order][first], [n]))
            yield _batch([(p, "last", [*_four(n), int((n > 2).sum()), int(n.sum())], None, None, None)], _META)

    return run


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from how many entries have the counts 1 to 4; 0.5, 1 and 1.5 where undefined."""
    if min(n[:3], default=0) <= 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]


@dataclass
class Model:
    folder: str
    parts: int
    present: dict[str, np.ndarray]  # by kind of file, whether each part has one
    hot: Hot
    total: int  # N
    words: int  # V
    d: list[list[float]]  # discounts of triples, of pairs and of words
    pairs: int
    spare: float  # mass that the words' discounts leave for unseen words


def build(texts: DataFrame, parts: int | None = None) -> Model:
    """Counts all of texts(text). Null texts count as empty; each text ends in one end token.

    parts follows from the texts' size. Frequent words are at most one for every HOT tokens; the
    driver holds these and a few numbers for each part.
    """
    spark = texts.sparkSession
    texts = texts.select("text")
    if parts is None:
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        parts = max(1, -(-size // PART_BYTES))
    folder = new_path(spark, "model")
    meet = lambda df, f: df.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(f, _META_SQL)
    counted = stage_table(meet(texts.mapInArrow(_count_words(parts), _WORDS_SQL), _write_words(folder)), "words")
    rows = counted.collect()  # a row for each part, with its frequent words: at most one for every HOT tokens
    seen, often = (np.concatenate([np.frombuffer(r[c], np.uint64) for r in rows]) if rows else np.zeros(0, np.uint64) for c in ("a", "k"))
    order = np.argsort(seen)
    hot = Hot(seen[order], often[order] // np.uint64(HOT) + np.uint64(2))
    first = stage_table(meet(texts.mapInArrow(_count_triples(parts, hot), _TRIPLES_SQL), _write_part(parts, folder, hot)), "counts")
    second = stage_table(meet(first.filter("kind = 'hot'"), _write_hot(parts, folder)), "hot_counts")
    third = stage_table(meet(second.filter("kind = 'before'"), _write_before(folder)), "hot_before")
    both = first.filter("kind = 'continuation'").unionByName(second.filter("kind = 'continuation'"))
    last = stage_table(meet(both, _write_continuations(folder)), "continuations")
    sums = [(name, r["part"], r["kind"], r["n"]) for name, df in (("word", counted), ("part", first), ("hot", second), ("hot_before", third), ("last", last))
            for r in df.filter("kind in ('triples', 'pairs', 'done', 'last', 'words')").select("part", "kind", "n").collect()]  # a few rows for each part
    for df in (counted, first, second, third, last):
        unstage(df)
    add = lambda kind, n: [sum(x[3][k] for x in sums if x[2] == kind) for k in range(n)]
    triples, pairs, single, (total, words) = add("triples", 4), add("pairs", 4), add("last", 6), add("words", 2)
    d = [discounts(triples), discounts(pairs), discounts(single[:4])]
    spare = (d[2][0] * single[0] + d[2][1] * single[1] + d[2][2] * single[4]) / single[5] if single[5] else 1.0
    present = {name: np.isin(np.arange(parts), [x[1] for x in sums if x[0] == name]) for name in FILES}
    return Model(folder, parts, present, hot, total, words, d, single[5], spare)


def _look(model: Model, kind: str, table: str, keys: np.ndarray, routes: np.ndarray) -> list[np.ndarray]:
    """Counts at keys out of the files they are routed to, 0 where absent."""
    out = [np.zeros(len(keys)) for _ in range(FILES[kind][table])]
    for p, i in _deal(routes, model.parts):
        if model.present[kind][p]:
            for o, x in zip(out, load(f"{model.folder}/{kind}-{p}", FILES[kind])[table](keys[i]), strict=True):
                o[i] = x
    return out


def _mixed(model: Model, order: int, count: np.ndarray, context: list[np.ndarray], below: np.ndarray) -> np.ndarray:
    """Interpolated probabilities: the discounted count of its context, and the rest of it as the lower order has it."""
    d = model.d[order]
    own = np.select([count == 0, count == 1, count == 2], [0.0, 1 - d[0], 2 - d[1]], count - d[2])
    total, n1, n2, n3 = context
    there = np.maximum(total, 1)
    return own / there + np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / there, 1.0) * below


def log_probabilities(model: Model, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of w, and log10 of its probability after u, v."""
    word, w_of = np.unique(w, return_inverse=True)
    (count,) = _look(model, "word", "word", word, part_of(word, model.parts))
    low = tx.mix(word & LOW)
    (cont,) = _look(model, "last", "continuation", low, part_of(low, model.parts))
    d = model.d[2]
    p1 = np.select([cont == 0, cont == 1, cont == 2], [0.0, 1 - d[0], 2 - d[1]], cont - d[2]) / max(model.pairs, 1) + model.spare / (model.words + 1)

    pair = pair_key(v, w)
    to, (is_hot, _) = part_of(v, model.parts), model.hot.find(v)
    (many,) = _look(model, "part", "pair", pair, to)
    before = _look(model, "part", "before", v, to)
    if is_hot.any():
        (many[is_hot],) = _look(model, "hot", "pair", pair[is_hot], part_of(pair[is_hot], model.parts))
        for x, y in zip(before, _look(model, "hot_before", "before", v[is_hot], to[is_hot]), strict=True):
            x[is_hot] = y
    p2 = _mixed(model, 1, many, before, p1[w_of])

    to = model.hot.route(u, v, model.parts)
    (n,) = _look(model, "part", "triple", triple_key(u, v, w), to)
    context = _look(model, "part", "context", context_key(u, v), to)
    # a context that isn't there was seen once if its pair of words was seen: mostly that of the token before
    once = np.zeros(len(w), bool)
    once[1:] = (u[1:] == v[:-1]) & (v[1:] == w[:-1]) & (many[:-1] > 0)
    rest = np.flatnonzero((context[0] == 0) & ~once & (v != START))
    rest = rest[~((u[rest] == v[rest - 1]) & (v[rest] == w[rest - 1]) & (rest > 0))]
    if len(rest):
        once[rest] = _seen(model, u[rest], v[rest])
    once &= context[0] == 0
    context[0][once] = context[1][once] = 1
    return count[w_of], np.log10(_mixed(model, 0, n, context, p2))


def _seen(model: Model, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Whether pairs occur in the training texts."""
    pair, (is_hot, _) = pair_key(v, w), model.hot.find(v)
    (many,) = _look(model, "part", "pair", pair, part_of(v, model.parts))
    if is_hot.any():
        (many[is_hot],) = _look(model, "hot", "pair", pair[is_hot], part_of(pair[is_hot], model.parts))
    return many > 0


def _score(model: Model):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.pieces(batches, "text", PIECE):
            u, v, w, n = tokens(b.column("text"))
            count, p = log_probabilities(model, u, v, w)
            first = np.cumsum(n) - n
            base = np.log10((count + 0.5) / (model.total + 0.5 * (model.words + 1)))
            known, base, p = (np.add.reduceat(x, first) for x in ((count > 0).astype(np.int64), base, p))
            with np.errstate(over="ignore"):
                cols = [b.column("doc_id"), b.column("held_out"), *map(pa.array, (n.astype(np.int64), known, np.full(len(n), model.total, np.int64), base, p, 10.0 ** (-p / n)))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, token counts, log10 probabilities and perplexity for every row of docs(doc_id, text, ..).

    A null or empty text is one end token. Repeated rows get equal scores. A model of no text gives
    every token probability 1 / (V + 1) = 1. Perplexity is 10 ** (-score / n_tokens).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
