"""Benchmark passages in training text, found by spaced seeds.

A seed is a fixed mask over consecutive tokens; the tokens at its zeros are ignored, so a hit
survives substitutions there. Hashes of the benchmark under all masks meet those of every
document; each hit fixes an alignment, along which a window tolerant of substitutions is verified.
Items shorter than the window get masks made for their length, one of which fits any substitutions
that the share allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from weirmesh.llm import text as tx
from weirmesh.plans.staging import stage_table

#: Fixed masks over token positions.
MASKS = ("111111", "11101011", "110110101", "11001010011")
WINDOW, SHARE = 13, 0.8  # tokens of the verified window, and the share of them that must agree
BLOCK_BYTES = 8_000_000  # benchmark text up to which its seeds go to every task; those of more are a table that is joined
HITS = 2_000_000  # seed hits, and tokens of alignments, looked at together
SIEVE_BITS = 27  # of a bitmap of seed hashes (16 MB), which keeps most seeds of documents out of that join


class _Fold(tx.Words):
    """Words of lower-cased ASCII letters, digits and all bytes beyond ASCII; the rest separates."""

    table = np.array([(b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256)], np.uint8)

    def __init__(self, column: pa.Array) -> None:
        raw, self.off = tx.buffers(column)
        self.data = self.table[raw]
        self.starts, self.ends = tx.word_spans(self.data, self.off)
        self.hash = tx.span_hashes(self.data, self.starts, self.ends)
        self.at = np.searchsorted(self.starts, self.off)
        self.n = np.diff(self.at)


def short_masks(n: int, share: float) -> list[str]:
    """Masks over all of n tokens; whichever tokens may differ at that share, one ignores them all.

    So many tokens lie in as many of the blocks at most, and every choice of that many is ignored.
    """
    differ = sum(n - m >= share * n for m in range(1, n))
    blocks = np.array_split(np.arange(n), min(differ + 2, n))
    masks = []
    for ignored in combinations(blocks, differ):
        zero = {int(i) for b in ignored for i in b}
        masks.append("".join("0" if i in zero else "1" for i in range(n)))
    return masks


def _seeds(w: tx.Words, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes under a mask and the word positions they start at; none crosses a text."""
    at = [i for i, c in enumerate(mask) if c == "1"]
    n = len(w.hash) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = tx.combine([w.hash[i : n + i] for i in at]) ^ np.uint64(number)
    end = np.repeat(w.at[1:], w.n)[:n]
    ok = np.flatnonzero(np.arange(n) + len(mask) <= end)
    return h[ok], ok


def all_masks(window: int, share: float) -> list[str]:
    """MASKS for items of window tokens and more, then those of each shorter length; a mask's place is part of its seeds."""
    return [*MASKS, *(m for k in range(1, window) for m in short_masks(k, share))]


class Benchmark:
    """Sorted seed hashes of some items, with their positions, and the masks they were made with."""

    def __init__(self, ids: list[int], texts: list[str], window: int, share: float) -> None:
        self.words = _Fold(pa.array(texts, pa.string()))
        self.ids = ids
        n = np.repeat(self.words.n, self.words.n)  # tokens of the item that a token is in
        self.masks = [(m, window, True) for m in MASKS] + [(m, len(m), False) for m in all_masks(window, share)[len(MASKS) :]]
        parts = []
        for k, (m, size, more) in enumerate(self.masks):
            if not (more or (n == size).any()):
                parts.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                continue
            h, pos = _seeds(self.words, m, k)
            own = n[pos] >= size if more else n[pos] == size
            parts.append((h[own], pos[own]))
        self.used = [k for k, x in enumerate(parts) if len(x[0])]
        h, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        self.hash, self.pos = h[order], pos[order]
        self.item = np.repeat(np.arange(len(ids)), self.words.n)


_ITEMS = pa.list_(pa.struct([("item_id", pa.int64()), ("tokens", pa.int64())]))
_ITEMS_TYPE = ArrayType(StructType([StructField("item_id", LongType()), StructField("tokens", LongType())]))


def _hits(bench: Benchmark, w: _Fold) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Alignments that share a seed: document, item and shift, distinct within each lot of at most about HITS."""
    doc = np.repeat(np.arange(len(w.n)), w.n)
    for k in bench.used:
        h, pos = _seeds(w, bench.masks[k][0], k)
        lo = np.searchsorted(bench.hash, h, side="left")
        n = np.searchsorted(bench.hash, h, side="right") - lo
        some = np.flatnonzero(n)
        lo, n, pos = lo[some], n[some], pos[some]
        ends = np.cumsum(n)
        i = 0
        while i < len(n):
            j = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HITS, side="right")), i + 1)
            c = n[i:j]
            at = np.repeat(lo[i:j], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            mine = np.repeat(pos[i:j], c)
            d, t, shift = doc[mine], bench.item[bench.pos[at]], mine - bench.pos[at]
            order = np.lexsort((shift, t, d))
            d, t, shift = d[order], t[order], shift[order]
            new = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (shift[1:] != shift[:-1]))
            yield d[new], t[new], shift[new]
            i = j


def _verified(b: _Fold, w: _Fold, d: np.ndarray, t: np.ndarray, shift: np.ndarray, window: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document, item and agreeing tokens of the alignments with a window (a shorter item's whole
    length) in which tokens agree in at least that share."""
    lo, hi = np.maximum(b.at[t], w.at[d] - shift), np.minimum(b.at[t + 1], w.at[d + 1] - shift)
    need = np.minimum(window, b.n[t])
    fits = np.flatnonzero(hi - lo >= need)
    d, t, shift, lo, need, size = d[fits], t[fits], shift[fits], lo[fits], need[fits], (hi - lo)[fits]
    ends, i = np.cumsum(size), 0
    while i < len(size):
        j = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + HITS, side="right")), i + 1)
        n, first = size[i:j], np.cumsum(size[i:j]) - size[i:j]
        pos = np.repeat(lo[i:j] - first, n) + np.arange(n.sum())
        total = np.concatenate([[0], np.cumsum(w.hash[pos + np.repeat(shift[i:j], n)] == b.hash[pos])])
        starts = n - need[i:j] + 1
        begin = np.cumsum(starts) - starts
        at = np.repeat(first - begin, starts) + np.arange(starts.sum())
        best = np.maximum.reduceat(total[at + np.repeat(need[i:j], starts)] - total[at], begin)
        good = best >= share * need[i:j]
        yield d[i:j][good], t[i:j][good], (total[first + n] - total[first])[good]
        i = j


def _found(bench: Benchmark, w: _Fold, window: int, share: float) -> list[dict[int | None, int]]:
    """For each text the most tokens that agree with each item it holds."""
    out: list[dict[int | None, int]] = [{} for _ in w.n]
    for hits in _hits(bench, w):
        for d, t, n in _verified(bench.words, w, *hits, window, share):
            for i, k, tokens in zip(d.tolist(), t.tolist(), n.tolist(), strict=True):
                name = bench.ids[k]
                out[i][name] = max(out[i].get(name, 0), tokens)
    return out


def _search(bench: Benchmark, window: int, share: float):
    """Items of each text, all of the benchmark being in every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.pieces(batches, "row.text"):
            found = _found(bench, _Fold(tx.field(batch, "row.text")), window, share)
            items = [[{"item_id": i, "tokens": n} for i, n in f.items()] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(items, _ITEMS)], ["row", "items"])

    return run


def _item_seeds(window: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.pieces(batches, "text"):
            bench = Benchmark(batch.column("k").to_pylist(), batch.column("text").to_pylist(), window, share)
            k = np.asarray(batch.column("k"))[bench.item[bench.pos]]
            yield pa.RecordBatch.from_arrays([pa.array(bench.hash.view(np.int64)), pa.array(k)], ["h", "k"])

    return run


def _text_seeds(masks: list[str], sieve: np.ndarray):
    """Distinct seeds of each text that the sieve lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.pieces(batches, "text"):
            w = _Fold(batch.column("text"))
            doc = np.repeat(np.arange(len(w.n)), w.n)
            hs, ds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for k, m in enumerate(masks):
                h, pos = _seeds(w, m, k)
                low = h & np.uint64((1 << SIEVE_BITS) - 1)
                ok = (sieve[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) > 0
                hs.append(h[ok])
                ds.append(doc[pos[ok]])
            h, d = np.concatenate(hs), np.concatenate(ds)
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
            new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
            h, d = h[new], d[new]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(np.asarray(batch.column(c))[d]) for c in ("t1", "t2"))], ["h", "t1", "t2"])

    return run


def _check_pairs(window: int, share: float):
    """Rows (t1, t2, text, item_id, item) sorted by text: those that hold the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, w = None, None
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                t1, t2 = (batch.column(c)[r].as_py() for c in ("t1", "t2"))
                if (t1, t2) != last:
                    last, w = (t1, t2), _Fold(batch.column("text").slice(r, 1))
                item = batch.column("item_id")[r].as_py()
                n = _found(Benchmark([item], [batch.column("item")[r].as_py()], window, share), w, window, share)[0]
                rows += [(t1, t2, item, n[item])] if n else []
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["t1", "t2", "item_id", "tokens"])

    return run


def _joined(docs: DataFrame, items: DataFrame, window: int, share: float) -> DataFrame:
    """row and items, by a join of the seeds of all items with those of all texts."""
    t = F.coalesce(F.col("text"), F.lit(""))
    key = [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(7), t).alias("t2")]
    items = stage_table(items.select(F.xxhash64("item_id", "text").alias("k"), "item_id", "text").dropDuplicates(["k"]), "items")
    seeds = stage_table(items.mapInArrow(_item_seeds(window, share), "h long, k long").distinct(), "seeds")
    low = F.col("h").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    words = seeds.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most 2 ** (SIEVE_BITS - 6) rows
    sieve = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    sieve[np.asarray(words["at"].combine_chunks()).astype(np.int64)] = np.asarray(words["bits"].combine_chunks()).view(np.uint64)
    texts = docs.select(*key, "text").filter("text is not null")
    hits = texts.mapInArrow(_text_seeds(all_masks(window, share), sieve), "h long, t1 long, t2 long")
    pairs = stage_table(hits.join(seeds, "h").select("t1", "t2", "k").distinct(), "candidates")
    wanted = texts.join(pairs.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])
    both = pairs.join(items.select("k", "item_id", F.col("text").alias("item")), "k").join(wanted, ["t1", "t2"])
    found = both.sortWithinPartitions("t1", "t2").select("t1", "t2", "text", "item_id", "item").mapInArrow(_check_pairs(window, share), "t1 long, t2 long, item_id long, tokens long")
    found = found.groupBy("t1", "t2", "item_id").agg(F.max("tokens").alias("tokens")).groupBy("t1", "t2").agg(F.collect_list(F.struct("item_id", "tokens")).alias("items"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), *key)
    return rows.join(found, ["t1", "t2"], "left").select("row", F.coalesce("items", F.array().cast(_ITEMS_TYPE)).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (all columns of docs as a struct), item_id, tokens and items for every row of docs(text, ..).

    items has (item_id, tokens) of every benchmark item where window consecutive tokens (the whole
    item if it has fewer) agree in a share of at least share along one alignment; tokens is how many
    agree along the best alignment. item_id and tokens are those of the item with most tokens, ties
    going to the smallest id, a null id last; null without one. Repeated rows get equal results; null
    or empty texts and items match nothing. A benchmark of up to block_bytes goes to every task; the
    seeds of a larger one are joined with those of the texts, with equal results.
    """
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size <= block_bytes:
        rows = items.orderBy("item_id", "text").collect()  # at most block_bytes
        out = docs.select(F.struct(*docs.columns).alias("row"))
        out = out.mapInArrow(_search(Benchmark([r[0] for r in rows], [r[1] for r in rows], window, share), window, share), StructType([*out.schema.fields, StructField("items", _ITEMS_TYPE)]))
    else:
        out = _joined(docs, items, window, share)
    rank = F.transform("items", lambda x: F.struct(x["item_id"].isNull().alias("none"), (-x["tokens"]).alias("n"), x["item_id"].alias("id")))
    ordered = F.transform(F.array_sort(rank), lambda x: F.struct(x["id"].alias("item_id"), (-x["n"]).alias("tokens")))
    out = out.select("row", ordered.alias("items"))
    best = F.get("items", F.lit(0))
    return out.select("row", best["item_id"].alias("item_id"), best["tokens"].alias("tokens"), "items")
