"""Removal of byte strings that occur more than once, by suffix arrays of shards.

Indexing every suffix of the corpus isn't needed: each window of the length in question is
represented by the smallest hash among its 64-byte runs, its anchor, so equal windows have equal
anchors. Windows of one text that share an anchor lie side by side and form a snippet. Snippets
whose anchor occurs nowhere else hold no repeat and stop here; equal snippets are repeats as a
whole. The distinct snippets of a repeated anchor meet in one shard, where a suffix array
(Larsson-Sadakane refinement) and common prefixes (Kasai) find the repeated windows. An anchor
with very many snippets is dealt to several shards; their sorted lists of distinct windows are
then merged by binary search in ranges of the window hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmesh.llm import text as tx
from weirmesh.plans.staging import stage_table

LENGTH, RUN = 200, 64
SHARD_SNIPPETS = 1500  # of one anchor, above which it is dealt to several shards
SHARD_BYTES = 250_000  # of small anchors that share a suffix array; some twenty arrays of that length are alive at once
SPAN = 250_000  # window starts looked at together; some ten arrays of that length are alive at once
_POS = np.uint64((1 << 22) - 1)


def text_key() -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(7), t).alias("h2")]


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = tx.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tx._TABLE[data] * p[:-1], out=total[1:])
    return total, q


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, from running minima of blocks forwards and backwards."""
    n = len(v)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = v
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def snippets(data: np.ndarray, off: np.ndarray, length: int = LENGTH, run: int = RUN) -> tuple[np.ndarray, ...]:
    """text number, first and last window start, anchor hash and snippet hash of every snippet.

    The snippet's bytes are first : last + length.
    """
    found: list[tuple[np.ndarray, ...]] = []
    run = min(run, length)
    base, n, span = 0, len(data), max(SPAN, 4 * length)
    while base + length <= n:
        part = data[base : base + span + length - 1]
        total, q = _sums(part)
        m = len(part) - run + 1
        h = tx.mix((total[run:] - total[:-run]) * q[:m])
        low = _sliding_min((h & ~_POS) | np.arange(m, dtype=np.uint64), length - run + 1)
        anchor = (low & _POS).astype(np.int64)
        start = np.arange(len(anchor))
        doc = np.searchsorted(off, start + base, side="right") - 1
        ok = start + base + length <= off[doc + 1]
        start, doc, anchor = start[ok], doc[ok], anchor[ok]
        if len(start):
            # a block's edge may split a snippet; the pieces are joined below
            new = np.ones(len(start), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(start)) - 1
            found.append((doc[first], start[first] + base, start[last] + base, h[anchor[first]], anchor[first] + base))
        base += len(low)
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    doc, a, b, h, at = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:
        new = np.ones(len(doc), bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1]) | (a[1:] != b[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        doc, a, b, h, at = doc[first], a[first], b[last], h[first], at[first]
    digest, i = np.empty(len(a), np.uint64), 0
    while i < len(a):
        j = max(int(np.searchsorted(b, a[i] + span, side="right")), i + 1)
        lo, hi = int(a[i]), int(b[j - 1]) + length
        total, q = _sums(data[lo:hi])
        digest[i:j] = (total[b[i:j] + length - lo] - total[a[i:j] - lo]) * q[a[i:j] - lo]
        i = j
    digest = tx.combine([digest, (b - a).astype(np.uint64), (at - a).astype(np.uint64)])
    return doc, a, b, h, digest


#: What is known of an occurrence where it was found: it is the first of its snippet there, and
#: stands for one or for several; it follows one of the latter; its anchor has many snippets there,
#: so it is dealt by snippet instead (again for one or several); or it only tells of such an anchor.
ONE, TWICE, KNOWN, SPREAD, SPREAD_TWICE, TELLS = range(6)
SPREAD_SNIPPETS = 8  # of one anchor in one piece of text, from which it is dealt by snippet
REMEMBERED = 500_000  # snippets and anchors a task remembers; when full it starts anew, at the cost of rows only
_FIRST = np.int64(-(1 << 63))  # sorts before any snippet


class _Known:
    """Values that a task has already told of."""

    def __init__(self) -> None:
        self.values = np.zeros(0, np.int64)

    def has(self, v: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.values, v), max(len(self.values) - 1, 0))
        return self.values[at] == v if len(self.values) else np.zeros(len(v), bool)

    def add(self, v: np.ndarray) -> None:
        """Sorted values that aren't there yet."""
        full = len(self.values) + len(v) > REMEMBERED
        self.values = v.copy() if full else np.insert(self.values, np.searchsorted(self.values, v), v)


def _occurrences(length: int):
    """A row for each snippet. Those whose fate is clear within a task are marked so, so that a
    frequent snippet or anchor sends about one row from each task to where its rows meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, crowded = _Known(), _Known()
        for b in tx.pieces(batches, "text"):
            data, off = tx.buffers(b.column("text"))
            doc, _, _, h, digest = snippets(data, off, length)
            i = np.arange(len(doc)) - np.searchsorted(doc, doc)
            h1, h2 = (np.asarray(b.column(c)) for c in ("h1", "h2"))
            anchor, digest = h.view(np.int64), digest.view(np.int64)
            each, at, n = np.unique(digest, return_index=True, return_counts=True)
            kind = np.full(len(digest), KNOWN, np.int8)
            new = ~copies.has(each)
            at, n = at[new], n[new]
            copies.add(each[new][n > 1])
            names, which, many = np.unique(anchor[at], return_inverse=True, return_counts=True)
            told = crowded.has(names)
            tell = (many >= SPREAD_SNIPPETS) & ~told
            crowded.add(names[tell])
            kind[at] = np.where(n > 1, TWICE, ONE) + np.where((told | tell)[which], SPREAD, 0)
            t = int(tell.sum())
            zero = np.zeros(t, np.int64)
            cols = [(h1[doc], zero), (h2[doc], zero), (i.astype(np.int32), zero.astype(np.int32)), (anchor, names[tell]), (digest, np.full(t, _FIRST)), (kind, np.full(t, TELLS, np.int8))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], _ROW)

    return run


_ROW = ["h1", "h2", "i", "anchor", "digest", "kind"]
_ROW_SQL = "h1 long, h2 long, i int, anchor long, digest long, kind byte"
_FLAGS_SQL = f"{_ROW_SQL}, whole boolean, first boolean, open boolean"


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, digest; out come those of repeated anchors with whole (its snippet
    occurs again), first (of a digest, where the anchor has several) and open (its anchor is dealt
    by snippet, so whole and first are found later). Holds three rows of an anchor at most."""

    def decide(t: pa.RecordBatch, old: np.ndarray, end: bool) -> tuple[pa.RecordBatch, pa.RecordBatch, np.ndarray]:
        """Rows that can be told, then those to go on with and which of these were told."""
        a, d, kind = (np.asarray(t.column(c)) for c in ("anchor", "digest", "kind"))
        new_a = np.append(True, a[1:] != a[:-1])
        new_d = new_a | np.append(True, d[1:] != d[:-1])
        ga, gd = np.cumsum(new_a) - 1, np.cumsum(new_d) - 1
        is_open = np.bincount(ga, kind == TELLS)[ga] > 0
        whole = np.bincount(gd, 1 + (kind == TWICE))[gd] > 1
        several = np.bincount(ga, new_d)[ga] > 1
        keep = (whole | several | is_open) & (kind != TELLS) & ~old
        go = np.zeros(0, np.int64)
        if not end:
            tail = int(np.flatnonzero(new_d)[-1])  # of the last digest, which may go on
            go = np.unique([int(np.flatnonzero(new_a)[-1]), tail, min(tail + 1, len(a) - 1)])
            if not is_open[-1] and not (whole[-1] and several[-1]):
                keep[tail] = False
                told = ~np.isin(go, tail) | old[go]
            else:
                told = np.ones(len(go), bool)
        else:
            told = np.zeros(0, bool)
        at = np.flatnonzero(keep)
        return _with(t.take(pa.array(at)), (whole & ~is_open)[at], (new_d & several & ~is_open)[at], is_open[at]), t.take(pa.array(go)), told

    carry, told = None, np.zeros(0, bool)
    for batch in batches:
        kind = np.asarray(batch.column("kind"))
        for mask, whole in ((kind == KNOWN, True), ((kind == SPREAD) | (kind == SPREAD_TWICE), False)):
            if mask.any():
                n = int(mask.sum())
                yield _with(batch.filter(pa.array(mask)), np.full(n, whole), np.zeros(n, bool), np.full(n, not whole))
        rest = batch.filter(pa.array((kind < KNOWN) | (kind == TELLS)))
        if rest.num_rows:
            t = rest if carry is None else pa.concat_batches([carry, rest])
            out, carry, told = decide(t, np.append(told, np.zeros(rest.num_rows, bool)), False)
            yield out
    if carry is not None:
        yield decide(carry, told, True)[0]


def _with(t: pa.RecordBatch, *flags: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*t.columns, *(pa.array(f) for f in flags)], [*_ROW, "whole", "first", "open"])


def _flags(texts: DataFrame, length: int) -> DataFrame:
    """(h1, h2, i, anchor, digest, whole, first) of snippets whose anchor occurs more than once."""
    rows = texts.mapInArrow(_occurrences(length), _ROW_SQL)
    kind = F.col("kind")
    to = F.when(kind == KNOWN, F.xxhash64("h1", "i")).when(kind.isin(SPREAD, SPREAD_TWICE), F.col("digest")).otherwise(F.col("anchor"))
    flags = stage_table(rows.repartition(to).sortWithinPartitions("anchor", "digest").mapInArrow(_flag, _FLAGS_SQL), "flags")
    cols = ["h1", "h2", "i", "anchor", "digest", "whole", "first"]
    left = flags.filter("open").select("h1", "h2", "i", "anchor", "digest", kind.isin(TWICE, SPREAD_TWICE).alias("twice"))
    by = left.groupBy("anchor", "digest").agg((F.count("*") + F.count_if("twice") > 1).alias("whole"), F.min(F.struct("h1", "h2", "i")).alias("f"))
    late = left.join(by, ["anchor", "digest"]).withColumn("first", F.col("f") == F.struct("h1", "h2", "i"))
    return flags.filter("not open").select(cols).unionByName(stage_table(late.select(cols), "spread"))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes in order, by Larsson and Sadakane's refinement: a first order by seven bytes, then
    only groups not yet sorted are sorted on, by the rank of the suffix h bytes further."""
    n = len(t)
    pad = np.concatenate([t.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])  # the end sorts before any byte
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = (key << np.uint64(9)) | pad[j : n + j]
    sa = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.full(n + 1, -1, np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[sa] = group
    h = 7
    while True:
        at = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(at):
            return sa
        own = sa[at]
        both = group[at] * (n + 2) + rank[np.minimum(own + h, n)] + 1
        order = np.argsort(both, kind="stable")
        sa[at] = own[order]
        both = both[order]
        new[at[1:]] |= both[1:] != both[:-1]
        group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[sa] = group
        h *= 2


def common_prefixes(t: np.ndarray, sa: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position the length that it shares with the suffix before it in sa.

    Kasai's rule, that the next position shares at least one byte less, walks all texts at once.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    lcp, live, shared = np.zeros(n, np.int64), np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for step in range(int((ends - starts).max(initial=0))):
        live = live[starts[live] + step < ends[live]]
        p = starts[live] + step
        q, l = before[p], np.maximum(shared[live] - 1, 0)
        l[q < 0] = 0
        go = np.flatnonzero(q >= 0)
        while len(go):
            go = go[np.maximum(p[go], q[go]) + l[go] < n]
            go = go[t[p[go] + l[go]] == t[q[go] + l[go]]]
            l[go] += 1
        shared[live] = l
        lcp[p] = l
    return lcp


def repeated_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and start of all windows, and a class that equal windows share."""
    size = np.array([len(x) for x in texts])
    t = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(size) - size
    sa = suffix_array(t)
    lcp = common_prefixes(t, sa, starts, starts + size)
    of = np.repeat(np.arange(len(texts)), size)
    kind = np.cumsum(lcp[sa] < length)  # equal first bytes stand together
    real = sa + length <= (starts + size)[of[sa]]  # the rest would run into the next text
    order = sa[real]
    return of[order], order - starts[of[order]], kind[real]


def _window_hashes(texts: list[bytes], of: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in texts])
    at = (np.cumsum(size) - size)[of] + start
    data = np.frombuffer(b"".join(texts), np.uint8)
    both = []
    for flip in (0, 255):
        total, q = _sums(data ^ np.uint8(flip))
        both.append(tx.mix((total[at + length] - total[at]) * q[at] + np.uint64(flip)))
    return both[0], both[1]


def _ranges(mask_of: np.ndarray, start: np.ndarray) -> dict[int, list[int]]:
    """Text number -> flat list of first, last of runs of starts."""
    order = np.lexsort((start, mask_of))
    o, s = mask_of[order], start[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(o)) - 1
    out: dict[int, list[int]] = {}
    for i, j in zip(first, last, strict=True) if len(o) else ():
        out.setdefault(int(o[i]), []).extend((int(s[i]), int(s[j])))
    return out


_FOUND = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("ranges", pa.list_(pa.int32())), ("bucket", pa.int64()), ("windows", pa.binary())])
_FOUND_SQL = "anchor long, digest long, ranges array<int>, bucket long, windows binary"
_WINDOW = np.dtype([("h", "<u8"), ("l", "<u8"), ("anchor", "<i8"), ("digest", "<i8"), ("start", "<i4")])


def _shard(length: int, buckets: int):
    """Rows sorted by anchor, salt: repeats within each shard; of dealt anchors also the distinct windows."""

    def one(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        texts = [r[2] for r in rows]
        of, start, kind = repeated_windows(texts, length)
        again = np.bincount(kind)[kind] > 1 if len(kind) else np.zeros(0, bool)
        out = [(rows[i][0], rows[i][1], r, None, None) for i, r in _ranges(of[again], start[again]).items()]
        dealt = np.array([r[3] for r in rows])[of]
        if dealt.any():
            # every window goes on: one that is alone here may have its like in another shard
            o, s = of[dealt], start[dealt]
            h, l = _window_hashes(texts, o, s, length)
            w = np.empty(len(o), _WINDOW)
            w["h"], w["l"], w["start"] = h, l, s
            w["anchor"], w["digest"] = (np.array([r[c] for r in rows])[o] for c in (0, 1))
            w = np.sort(w, order=["h", "l"])
            to = (w["h"] >> np.uint64(33)).astype(np.int64) % buckets
            out += [(None, None, None, int(k), w[to == k].tobytes()) for k in np.unique(to)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("anchor", "digest", "snippet", "dealt", "salt")), strict=True):
                if (r[0], r[4]) != last:
                    if size >= SHARD_BYTES:
                        yield from one(held)
                        held, size = [], 0
                    last = (r[0], r[4])
                held.append(r)
                size += len(r[2])
        if held:
            yield from one(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of dealt anchors, sorted by bucket: those that lists of several shards hold."""

    def one(lists: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = [w["h"] for w in lists]
        hits = []
        every = np.sort(np.concatenate(hashes))
        for w in lists:
            n = np.searchsorted(every, w["h"], side="right") - np.searchsorted(every, w["h"], side="left")
            hits.append(w[n > 1])
        w = np.sort(np.concatenate(hits), order=["h", "l"])
        if not len(w):
            return
        same = (w["h"][1:] == w["h"][:-1]) & (w["l"][1:] == w["l"][:-1])
        w = w[np.append(same, False) | np.append(False, same)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w[c])) for c in ("anchor", "digest", "start")], ["anchor", "digest", "start"])

    last, held = None, []
    for b in batches:
        for k, blob in zip(b.column("bucket").to_pylist(), b.column("windows").to_pylist(), strict=True):
            if k != last and held:
                yield from one(held)
                held = []
            last = k
            held.append(np.frombuffer(blob, _WINDOW))
    if held:
        yield from one(held)


def _cut_snippets(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.pieces(batches, "text"):
            data, off = tx.buffers(b.column("text"))
            doc, lo, hi, h, digest = snippets(data, off, length)
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            pick = [at[k] + np.array(x, np.int64) for k, x in enumerate(b.column("firsts").to_pylist()) if x]
            pick = np.concatenate(pick) if pick else np.zeros(0, np.int64)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)[pick]), pa.array(digest.view(np.int64)[pick]), tx.binary_column([raw[lo[i] : hi[i] + length] for i in pick])], ["anchor", "digest", "snippet"])

    return run


def _apply(length: int, whole_chars: bool):
    """Spans and the kept bytes of each text from its whole and part flags; with whole_chars a
    character goes if any of its bytes does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.pieces(batches, "text"):
            data, off = tx.buffers(b.column("text"))
            doc, lo, hi, _, _ = snippets(data, off, length)
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            out = []
            wholes, parts = b.column("wholes").to_pylist(), b.column("parts").to_pylist()
            for k, (h1, h2) in enumerate(zip(b.column("h1").to_pylist(), b.column("h2").to_pylist(), strict=True)):
                own = data[off[k] : off[k + 1]]
                i = at[k] + np.array(wholes[k] or [], np.int64)
                first, last = [lo[i]], [hi[i]]
                for p in parts[k] or ():
                    r = np.array(p["ranges"], np.int64).reshape(-1, 2)
                    first.append(lo[at[k] + p["i"]] + r[:, 0])
                    last.append(lo[at[k] + p["i"]] + r[:, 1])
                first, last = (np.concatenate(x) - off[k] for x in (first, last))
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, last + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                if not gone.any():
                    continue
                if whole_chars:
                    begin = np.union1d(0, np.flatnonzero((own & 0xC0) != 0x80))
                    gone = np.repeat(np.logical_or.reduceat(gone, begin), np.diff(np.append(begin, len(own))))
                turn = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                spans = np.stack([np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)], axis=1)
                out.append((h1, h2, [{"start": int(s), "end": int(e)} for s, e in spans], own[~gone].tobytes()))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], kind), pa.array(cols[3], pa.binary())], ["h1", "h2", "spans", "kept"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, whole_chars: bool = False) -> DataFrame:
    """(h1, h2, spans, kept) of every distinct text that holds a repeat: byte spans to remove, and
    the bytes that stay. A byte goes if a string of length bytes over it also starts anywhere else,
    in another row or the same text. Texts are UTF-8 bytes; matches never cross rows. whole_chars
    widens the spans to whole characters."""
    texts = docs.select(*text_key(), "text").filter(F.octet_length("text") >= length)
    flags = _flags(texts, length)
    by = flags.groupBy("h1", "h2").agg(F.collect_set(F.when(F.col("whole"), F.col("i"))).alias("wholes"), F.collect_set(F.when(F.col("first"), F.col("i"))).alias("firsts"))
    found = stage_table(texts.join(by, ["h1", "h2"]).dropDuplicates(["h1", "h2"]), "repeats")

    cut = stage_table(found.filter(F.size("firsts") > 0).mapInArrow(_cut_snippets(length), "anchor long, digest long, snippet binary").dropDuplicates(["anchor", "digest"]), "snippets")
    hot = cut.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD_SNIPPETS)
    hot = stage_table(hot, "hot")
    total = hot.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cut = cut.join(hot, "anchor", "left").withColumn("dealt", F.col("n").isNotNull())
    cut = cut.withColumn("salt", F.when(F.col("dealt"), F.pmod("digest", F.ceil(F.col("n") / SHARD_SNIPPETS))).otherwise(F.lit(0)).cast("long")).drop("n")
    shards = cut.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_shard(length, max(64, total // 4000)), _FOUND_SQL)
    shards = stage_table(shards, "shards")
    parts = shards.filter("anchor is not null").select("anchor", "digest", "ranges")
    if total:
        across = shards.filter("bucket is not null").select("bucket", "windows").repartition("bucket").sortWithinPartitions("bucket")
        across = stage_table(across.mapInArrow(_merge, "anchor long, digest long, start int"), "across")
        parts = parts.unionByName(_spread(across))
    parts = flags.filter("not whole").select("h1", "h2", "i", "anchor", "digest").join(parts, ["anchor", "digest"])
    parts = parts.groupBy("h1", "h2").agg(F.collect_list(F.struct("i", "ranges")).alias("parts"))
    marked = found.select("h1", "h2", "text", "wholes").join(parts, ["h1", "h2"], "left").filter("size(wholes) > 0 or parts is not null")
    return marked.mapInArrow(_apply(length, whole_chars), "h1 long, h2 long, spans array<struct<start: long, end: long>>, kept binary")


def _spread(across: DataFrame) -> DataFrame:
    """Ranges of dealt snippets out of single windows found in several shards."""
    return across.groupBy("anchor", "digest").agg(F.flatten(F.collect_list(F.array("start", "start"))).alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All rows and columns of docs, with the repeated bytes cut out of text.

    A character that loses some of its bytes is dropped whole. Null texts stay null.
    """
    spans = repeated_spans(docs, length, whole_chars=True).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("kept").cast("string").alias("_kept"))
    h1, h2 = text_key()
    out = docs.withColumns({"_h1": h1, "_h2": h2}).join(spans, ["_h1", "_h2"], "left")
    return out.withColumn("text", F.coalesce("_kept", "text")).select(*docs.columns)


def removal_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of docs(doc_id, text, ..).

    Null and empty texts have 0 bytes. Repeated rows are repeats of each other, whatever their
    doc_id, null included; texts shorter than length never lose anything.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *text_key(), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t.cast("binary"), 256).alias("sha"))
    gone = repeated_spans(docs, length).select(
        "h1", "h2", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("r"),
        F.size("spans").cast("long").alias("s"), F.sha2("kept", 256).alias("k"))
    out = rows.join(gone, ["h1", "h2"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("r", zero).alias("n_removed"), F.coalesce("s", zero).alias("n_spans"), F.coalesce("k", "sha").alias("kept_sha256"))
