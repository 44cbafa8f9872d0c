"""Near-duplicate groups from bottom-k sketches of word shingles.

One hash function gives every shingle a value; a document retains its k smallest. Documents with
equal shingle sets collapse into one class first. Inverted lists of retained values that several
classes share, taken rarest first, propose pairs; the sketch of the union estimates their Jaccard
similarity and drops the hopeless ones; the rest is verified on the full shingle sets.

Only groups matter, so a list is never expanded into all its pairs: its members meet a hub, those
that are linked fall into one component, and only members of different components meet again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmesh.llm import text as tx
from weirmesh.operators.components import connected_components
from weirmesh.plans.staging import stage_table, unstage

K, K_FINE = 64, 256
K_LONG = 2 * K_FINE  # of the documents left: sets of up to 435 values are compared exactly
MISS = 1e-9  # bound on the chance that sketches of a linked pair share too little


def least_overlap(k: int, threshold: float, miss: float = MISS) -> int:
    """The largest o such that a binomial(k, threshold) falls below o with probability < miss."""
    total, o = 0.0, 0
    while o < k:
        total += math.comb(k, o) * threshold**o * (1 - threshold) ** (k - o)
        if total >= miss:
            return o
        o += 1
    return k


def overlap_steps(k: int, threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """Rising (n, o): a linked pair shares fewer than o retained values with probability < miss if one
    of its sets holds at most n values. Larger sets: least_overlap.

    The k smallest of a union of u values are a draw without replacement, so the number of them that are
    common is hypergeometric, narrower than binomial unless u is large; u is at most n / threshold.
    """
    u = np.arange(k + 1, 16 * k)
    good = np.ceil(u * threshold - 1e-9).astype(np.int64)
    fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 16 * k)))])
    choose = lambda a, b: fact[a] - fact[b] - fact[a - b]
    total, o, at = np.zeros(len(u)), np.full(len(u), k), np.ones(len(u), bool)
    for j in range(k + 1):  # the probability of at most j common ones
        can = (k - j <= u - good) & at
        total[can] += np.exp(choose(good[can], j) + choose((u - good)[can], k - j) - choose(u[can], k))
        over = at & (total >= miss)
        o[over], at = j, at & ~over
    o = np.minimum.accumulate(o)  # of all unions up to u
    last = np.flatnonzero(np.diff(o, append=-1))
    return [(int(math.floor((u[i] + 1) * threshold - 1e-9)), int(o[i])) for i in last]


def _overlap(n: Column, k: int, t: float) -> Column:
    """The least number of retained values that a set of n values, not all retained, shares with a linked one."""
    step = None
    for limit, o in overlap_steps(k, t):
        step = F.when(n <= limit, o) if step is None else step.when(n <= limit, o)
    return F.lit(least_overlap(k, t)) if step is None else step.otherwise(least_overlap(k, t))


def _sketches(k: int, width: int):
    """The columns beside text, how many shingles there are, a digest of them all and the k smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.pieces(batches, "text"):
            w = tx.Words(b.column("text"))
            n, digest, sketch = [], [], []
            for i in range(b.num_rows):
                s = tx.shingles(w.text(i), width)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sketch.append(s[:k].view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sketch)]), pa.int32()), pa.array(np.concatenate(sketch), pa.int64()))
            own = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(b.column, own), pa.array(n, pa.int64()), tx.binary_column(digest), lists], [*own, "n", "digest", "sketch"])

    return run


def jaccard_estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """From the k smallest values of the union of two sets, each given sorted."""
    union = np.union1d(a[:k], b[:k])[:k]
    return float(np.isin(union, np.intersect1d(a[:k], b[:k], assume_unique=True)).mean()) if len(union) else 0.0


def _verify(width: int, percent: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = least_overlap(k, percent / 100) / k
        last_a, sa = None, None
        for b in tx.pieces(batches, "tb"):
            left = b.column("a").to_pylist()
            ids = b.column("b").to_pylist()
            w = tx.Words(b.column("tb"))
            keep_a, keep_b = [], []
            for i in range(b.num_rows):
                if last_a != left[i]:
                    last_a, sa = left[i], tx.shingles(tx.Words(b.column("ta").slice(i, 1)).text(0), width)
                sb = tx.shingles(w.text(i), width)
                if not len(sa) or not len(sb) or (len(sa) + len(sb) > 8 * k and jaccard_estimate(sa, sb, k) < floor):
                    continue
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                if 100 * both >= percent * (len(sa) + len(sb) - both):
                    keep_a.append(left[i])
                    keep_b.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], ["a", "b"])

    return run


def _lists(sketches: DataFrame, t: float, k: int) -> DataFrame:
    """Inverted lists (id, n, c, value, pos): of each document the rarest values that some other retains.

    A linked pair shares o retained values, so one of the |sketch| - o + 1 rarest of either; values
    that no other document retains come first and are of no use. pos is the value's place among the
    document's, rare ones first, in an order that all documents share. Where neither it nor a
    partner can outgrow a sketch, c counts all shingles that some other document has; it bounds every overlap.
    """
    entries = sketches.select(F.col("doc_id").alias("id"), "n", F.explode("sketch").alias("value"))
    shared = entries.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    exact = F.col("n") <= F.lit(math.floor(k * t))
    s = F.least("n", F.lit(k))
    o = F.when(exact, F.ceil(s * t)).otherwise(F.least(_overlap(F.col("n"), k, t), F.ceil(s * t)))
    # shared values grow with the input; a plan that broadcasts them fills the driver first
    own = entries.join(shared.hint("merge"), "value").groupBy("id", "n").agg(F.collect_set(F.struct("df", "value")).alias("l"))
    alone = s - F.size("l")
    c = F.when(exact, F.size("l")).otherwise(F.col("n")).cast("long")
    rare = own.withColumns({"alone": alone, "m": (s - o + 1 - alone).cast("int"), "c": c}).filter("m > 0")
    rare = rare.select("id", "n", "c", "alone", F.posexplode(F.slice(F.array_sort("l"), F.lit(1), F.col("m"))).alias("i", "value"))
    return rare.select("id", "n", "c", F.col("value.value").alias("value"), (F.col("alone") + F.col("i") + 1).alias("pos"))


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, k: int = K, k_fine: int = K_LONG, hub_rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id, text, ..).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of
    width-word shingles (lower-cased A-Z; a shorter text is one shingle). component_id is the
    smallest doc_id that links reach; kept marks the document it names. Null, empty and blank
    texts have an empty set and are linked with nothing. Rows with the same doc_id and different
    texts are linked each by its own text; alike or not, those that reach no smaller doc_id are
    kept. A null doc_id is linked with nothing: component_id is null and kept true. Other columns of docs are ignored.
    """
    out = groups(docs, percent, width, k, k_fine, hub_rounds)
    cid = F.when(F.col("doc_id").isNotNull(), F.coalesce("leader.doc_id", "doc_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept"))


def _likely(rows: DataFrame, key: Column, ids: DataFrame, n: int) -> DataFrame:
    """The rows whose key, a hash, is among n ids(id), and at most a sixteenth of the others.

    For what an exact join follows, so that it need not deal out all texts. One bit for each id in pages of
    4 kB, 8 MB of them at most; beyond 4 million ids more of the others stay.
    """
    size = 1 << min(26, max(15, (16 * n - 1).bit_length()))
    page, bit = (lambda c: F.shiftright(F.pmod(c, F.lit(size)), 15)), (lambda c: F.pmod(c, F.lit(1 << 15)))
    pages = ids.groupBy(page(F.col("id")).alias("_page")).agg(F.bitmap_construct_agg(bit(F.col("id"))).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit(key), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.call_function("getbit", byte, F.pmod(key, F.lit(8)).cast("int")) == 1
    return rows.join(F.broadcast(pages), page(key) == F.col("_page")).filter(marked).select(*rows.columns)


def _slim(staged: DataFrame, *columns: str) -> DataFrame:
    """A staged table without columns that nothing reads any more; the wide one's files go."""
    slim = stage_table(staged.drop(*columns), "slim")
    unstage(staged)
    return slim


def groups(docs: DataFrame, percent: int = 85, width: int = 5, k: int = K, k_fine: int = K_LONG, hub_rounds: int = 3) -> DataFrame:
    """doc_id, h, n_shingles and leader for every row of docs(doc_id, text, ..), linked as in near_duplicates.

    h is a hash of the text, so that (doc_id, h) tells texts with one doc_id apart. leader is the
    smallest (doc_id, h) of all rows that links reach; null for an empty set of shingles.
    """
    t = percent / 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    s1 = stage_table(docs.mapInArrow(_sketches(k, width), "doc_id long, h long, n long, digest binary, sketch array<long>"), "sketch")
    # rows of one class have equal sketches, so any of them will do and none is joined back
    own = F.min(F.struct("doc_id", "h")).alias("rep")
    classes = s1.filter("n > 0 and doc_id is not null").groupBy("digest").agg(own, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sketched = stage_table(classes.select("digest", "rep.doc_id", "rep.h", F.xxhash64("rep.doc_id", "rep.h").alias("id"), "n", "sketch"), "sketched")
    s1 = _slim(s1, "sketch")
    reps = sketched.select(F.col("id").alias("doc_id"), "n", "sketch")
    few = stage_table(sketched.join(_lists(reps, t, k).select("id").distinct(), "id").select("id", "doc_id", "h"), "few")
    classes = _slim(sketched, "n", "sketch")
    wanted = _likely(docs, F.xxhash64("doc_id", "h"), few.select("id"), few.count())
    texts = wanted.join(few, ["doc_id", "h"]).dropDuplicates(["id"]).select(F.col("id").alias("doc_id"), "text")
    texts = stage_table(texts, "texts")
    # the survivors, mostly apart from shared passages, are told apart by longer sketches
    fine = texts.mapInArrow(_sketches(k_fine, width), "doc_id long, n long, digest binary, sketch array<long>")
    lists = stage_table(_lists(fine.filter("n > 0"), t, k_fine), "lists")
    comp = _links(lists, texts, percent, width, k_fine, hub_rounds)
    unstage(lists)
    unstage(texts)
    own = F.struct("doc_id", "h")
    of = classes.select("digest", own.alias("leader"))
    if comp is not None:
        first = comp.join(classes, "id").groupBy("component").agg(F.min(own).alias("first"))
        of = classes.join(comp.join(first, "component").select("id", "first"), "id", "left").select("digest", F.coalesce("first", own).alias("leader"))
    out = s1.select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    return out.join(of, "digest", "left").select("doc_id", "h", "n_shingles", "leader")


def _links(lists: DataFrame, texts: DataFrame, percent: int, width: int, k: int, hub_rounds: int) -> DataFrame | None:
    """Components (id, component) of all verified links; None if there are none."""
    # similar sizes, and enough shared shingles on either side for the overlap that a link needs
    size = (F.col("n") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n") * percent)
    size &= F.least("c", "c2") * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    # of two whole sets, the first value they share leaves that overlap behind it in both
    o = F.ceil((F.col("n") + F.col("n2")) * percent / (100 + percent) - 1e-6)
    size &= (F.greatest("n", "n2") > k) | ((F.col("pos") <= F.col("n") - o + 1) & (F.col("pos2") <= F.col("n2") - o + 1))
    pair = [F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")]
    comp, edges, tested = None, None, None
    for turn in range(hub_rounds + 1):
        at = lists.withColumn("g", F.col("id")) if comp is None else lists.join(comp, "id", "left").withColumn("g", F.coalesce("component", "id")).drop("component")
        if turn:
            at = members = stage_table(at, "members")
        by = at.groupBy("value", "g").agg(F.count("*").alias("m")).groupBy("value").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same"))
        left = by.agg(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2).alias("pairs"), F.sum("all").alias("rows")).first()
        if not left["pairs"]:
            break
        last = turn == hub_rounds or left["pairs"] <= max(2 * left["rows"], 10_000)
        if last:  # what is left: members of different components, a pair at the first value they share
            mixed = by.filter(F.col("all") * F.col("all") > F.col("same")).select("value")
            at = at.join(mixed, "value", "left_semi")
            own = at.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "value")))["value"].alias("own"))
            at = stage_table(at.join(own, "id"), "mixed")
            if turn:
                unstage(members)
            other = at.select("value", *[F.col(x).alias(f"{x}2") for x in ("id", "n", "c", "g", "pos", "own")])
            pairs = at.join(other.hint("merge"), "value").filter("g < g2").filter(size).filter(F.get(F.array_intersect("own", "own2"), F.lit(0)) == F.col("value"))
        else:
            # first the member with the fewest values of its own, as the text that others were made from has
            order = F.struct((F.col("n") - F.col("c")).alias("o"), "id") if turn == 0 else F.struct(F.xxhash64("id", F.lit(turn)).alias("o"), "id")
            hubs = at.groupBy("value").agg(F.min(F.struct(order.alias("o"), "n", "c", "g", "pos")).alias("h"))
            hubs = hubs.select("value", F.col("h.o.id").alias("id2"), *[F.col(f"h.{x}").alias(f"{x}2") for x in ("n", "c", "g", "pos")])
            pairs = at.join(hubs, "value").filter("g <> g2")
        pairs = pairs.filter(size).select(*pair).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage_table(pairs, "pairs")
        if last or turn:
            unstage(at)
        tested = pairs if tested is None else tested.unionByName(pairs)
        n = pairs.count()
        if n:
            ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
            named = _likely(texts, F.col("doc_id"), ids, 2 * n)
            both = pairs.join(named.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            both = both.join(named.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
            found = stage_table(both.select("a", "b", "ta", "tb").mapInArrow(_verify(width, percent, k), "a long, b long"), "links")
            edges = found if edges is None else edges.unionByName(found)
            comp = connected_components(edges)
        if last:
            break
    return comp
