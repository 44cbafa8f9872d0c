"""The text operators against brute force, and on nulls, empty and odd input."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weirmesh.llm import catalogue, decontaminate, html_extract, langid, language_model, license_scan, mixing, near_dedup, pipeline, quality, suffix_dedup, toxicity
from weirmesh.llm import text as tx
from weirmesh.llm.labelled_pages import filled

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, kept string, h1 string"
LONG = " ".join(f"w{i % 97}x{i}" for i in range(60000))


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def odd(spark, extra=()):
    """Null in every column, empty, blank, very long and repeated rows, clashing columns."""
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, " \t\n", "en", "a"), (4, LONG, "en", "b"), (4, LONG, "en", "b"), (None, "alpha beta gamma delta epsilon zeta", "en", "a"), (5, "12 34 !!", "de", "b"), *extra]
    return spark.createDataFrame([(*r, None, "x", "y", "z", "q") for r in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_words_and_hashes():
    texts = ["A bc\tde", None, "", "x" * 3_000_000 + " A", " é  bc "]
    w = tx.Words(pa.array(texts, pa.string()))
    assert w.n.tolist() == [3, 0, 0, 2, 2]
    assert w.text(0)[0] == w.text(3)[1] and w.text(0)[1] == w.text(4)[1] and w.text(0)[0] != w.text(0)[1]


def test_quality(spark, docs, texts):
    got = {r.doc_id: r for r in catalogue.op1_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.base_failed and r.kept)
    known = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    assert np.mean([got[i].kept == bool(q) for i, q in known.items() if i in got and not got[i].base_failed]) > 0.95
    got = quality.judge(odd(spark)).collect()
    assert len(got) == 7 and sum(r.base_failed for r in got) == 5
    assert quality.judge(odd(spark).limit(0)).count() == 0


def kneser_ney(train):
    """log10 probability of a word after two others, by the formulas and plain dictionaries."""
    triples = Counter(t for ws in train for t in zip(["<s>", "<s>", *ws], ["<s>", *ws], ws, strict=False))
    pairs = Counter((b, c) for _, b, c in triples)
    single = Counter(c for _, c in pairs)
    four = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    d = [[0.0, *language_model.discounts(four(c))] for c in (triples, pairs, single)]
    v = len({w for ws in train for w in ws})
    sums = [{}, {}]
    for table, counts in zip(sums, (triples, pairs), strict=True):
        for key, c in counts.items():
            x = table.setdefault(key[:-1], [0, 0, 0, 0])
            x[0] += c
            x[min(c, 3)] += 1

    def mixed(order, c, ctx, low):
        if ctx is None:
            return low
        return ((c - d[order][min(c, 3)]) + sum(x * y for x, y in zip(d[order][1:], ctx[1:], strict=True)) * low) / ctx[0]

    spare = sum(d[2][min(c, 3)] for c in single.values()) / max(len(pairs), 1) if pairs else 1.0

    def p(a, b, c):
        one = (single[c] - d[2][min(single[c], 3)]) / max(len(pairs), 1) + spare / (v + 1)
        two = mixed(1, pairs[b, c], sums[1].get((b,)), one)
        return math.log10(mixed(0, triples[a, b, c], sums[0].get((a, b)), two))

    return p


@pytest.mark.parametrize(("parts", "hot"), [(None, language_model.HOT), (7, 50), (3, 5)])
def test_language_model(spark, docs, texts, monkeypatch, parts, hot):
    """Also with frequent words dealt over several parts."""
    monkeypatch.setattr(language_model, "HOT", hot)
    tokens = {i: [*WORD.findall(lower(t)), "</s>"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    train = [ws for i, ws in tokens.items() if not held[i]]
    count = Counter(w for ws in train for w in ws)
    n, v, p = sum(count.values()), len(count), kneser_ney(train)
    model = language_model.build(docs.filter(~language_model.held_out()), parts)
    assert (len(model.hot.words) > 0) == (hot < 1000)
    rows = language_model.score(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ws = tokens[r.doc_id]
        score = sum(p(*t) for t in zip(["<s>", "<s>", *ws], ["<s>", *ws], ws, strict=False))
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(count[w] > 0 for w in ws), n, held[r.doc_id])
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=1e-6) and r.perplexity == pytest.approx(10 ** (-score / len(ws)), rel=1e-6)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_packed_counts():
    rng = np.random.default_rng(4)
    for size in (0, 1, 7, 100_000):
        keys = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        n, m = (rng.integers(1, 2000, len(keys)).astype(np.uint64) ** k for k in (1, 3))
        t = language_model.Packed(memoryview(language_model.pack(keys, [n, m])), 0, 2)
        got = t(np.concatenate([keys, keys + np.uint64(1 << 40)]))
        for x, want in zip(got, (n, m), strict=True):
            assert (x[: len(keys)] == want).all() and not x[len(keys) :].any()


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b d", "b c a", "", "d d d a"]
    model = language_model.build(spark.createDataFrame([(x,) for x in texts], "text string"), 2)
    words = [w for w in tx.Words(pa.array(["a b c d"], pa.string())).hash] + [language_model.END]
    for u, v in ((words[0], words[1]), (language_model.START, language_model.START), (words[3], words[3]), (words[2], np.uint64(77))):
        k = len(words)
        _, p = language_model.log_probabilities(model, np.full(k, u), np.full(k, v), np.array(words))
        # the rest is for words that were never seen, each as likely as one
        _, none = language_model.log_probabilities(model, np.array([u]), np.array([v]), np.array([np.uint64(99)]))
        assert sum(10**p) + 10 ** none[0] == pytest.approx(1, abs=1e-9)


def test_language_model_on_odd_rows(spark):
    d = odd(spark)
    for train in (d, d.limit(0)):
        got = language_model.score(d, language_model.build(train)).collect()
        assert len(got) == 7 and all(math.isfinite(r.score) for r in got)
        assert sorted(r.n_tokens for r in got)[:3] == [1, 1, 1]
    assert language_model.score(d.limit(0), language_model.build(d)).count() == 0


def shingle_groups(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(spark, texts):
    got = {r.doc_id: r for r in catalogue.op3_minhash_near_dedup(spark, "/root/testdata/sf0.001").collect()}
    for i, (n, c) in shingle_groups(texts).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, i == c)


def test_near_duplicates_in_a_large_group(spark):
    r = random.Random(4)
    base = [f"t{r.randrange(10**6)}" for _ in range(150)]
    made = {}
    for i in range(140):
        w = base[:]
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        made[i] = " ".join(w)
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df, hub_rounds=2).collect()}
    assert got == {i: c for i, (_, c) in shingle_groups(made).items()}


def test_a_link_that_its_union_sketch_underrates(spark):
    words = sorted((f"t{i}" for i in range(1000)), key=lambda w: tx.shingles(tx.Words(pa.array([w])).text(0), 1)[0])
    only = {i * 256 // 68 for i in range(68)} | set(range(918, 1000))  # 68 of the union's 256 smallest, 38 by chance
    few = [w for i, w in enumerate(words) if i not in only]
    a, b = (tx.shingles(tx.Words(pa.array([" ".join(x)])).text(0), 1) for x in (words, few))
    assert len(few) == 850 and near_dedup.jaccard_estimate(a, b, near_dedup.K_FINE) == 188 / 256
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(few))], "doc_id long, text string")
    assert [x.component_id for x in near_dedup.near_duplicates(df, width=1).collect()] == [1, 1]
    for k in (near_dedup.K, near_dedup.K_FINE):
        o = near_dedup.least_overlap(k, 0.85)
        assert sum(math.comb(k, i) * 0.85**i * 0.15 ** (k - i) for i in range(o)) < near_dedup.MISS


def test_sketch_bounds_of_sets_that_nearly_fit(spark):
    def tail(u, good, k, o):
        return sum(math.comb(good, j) * math.comb(u - good, k - j) for j in range(o) if k - j <= u - good) / math.comb(u, k)

    k, steps = near_dedup.K, near_dedup.overlap_steps(near_dedup.K, 0.85)
    for n in [*range(55, 140), 400, 600, 868]:
        o = next(o for limit, o in steps if n <= limit)
        unions = range(max(k + 1, n), 100 * n // 85 + 1)
        assert all(tail(u, -(-85 * u // 100), k, o) < near_dedup.MISS for u in unions) and o >= near_dedup.least_overlap(k, 0.85)
    # a fifth of either text is its own: no such set has a link, so none is listed or verified
    r = random.Random(6)
    base = [f"t{i}" for i in range(400)]
    texts = [" ".join(f"n{i}-{j}" if j % 20 == i else w for j, w in enumerate(base)) for i in range(12)]
    rows = [(i, np.unique(tx.shingles(tx.Words(pa.array([t])).text(0), 5))) for i, t in enumerate(texts)]
    sketches = [(i, len(s), s[: near_dedup.K_LONG].view(np.int64).tolist()) for i, s in r.sample(rows, len(rows))]
    df = spark.createDataFrame(sketches, "doc_id long, n long, sketch array<long>")
    assert near_dedup._lists(df, 0.85, near_dedup.K_LONG).count() == 0
    near = spark.createDataFrame([(0, texts[0]), (1, texts[1]), (2, texts[0].replace("t7 ", "x "))], "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in near_dedup.near_duplicates(near).collect()} == {0: 0, 1: 1, 2: 0}


def test_rows_by_a_bitmap_of_their_ids(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("k"), "id", F.lit("t").alias("text"))
    ids = rows.filter("id % 40 = 0").select(F.col("k").alias("id"))
    got = near_dedup._likely(rows, F.col("k"), ids.unionByName(ids), 500)
    assert got.columns == rows.columns
    got = {r.id for r in got.collect()}
    assert got >= set(range(0, 20000, 40)) and len(got) < 500 + 20000 / 16
    assert near_dedup._likely(rows, F.col("k"), ids.limit(0), 0).count() == 0


def test_near_duplicates_on_odd_rows(spark):
    got = near_dedup.near_duplicates(odd(spark, [(9, "a b c", "en", "a"), (8, "A B C", "en", "a"), (7, "a b", "en", "a")])).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == 10 and {r.component_id for r in by[4]} == {4} and all(r.kept for r in by[4])
    assert (by[9][0].component_id, by[9][0].kept, by[8][0].kept, by[7][0].component_id) == (8, False, True, 7)
    assert by[None][0].component_id is None and by[None][0].kept and [by[i][0].n_shingles for i in (1, 2, 3)] == [0, 0, 0]
    assert near_dedup.near_duplicates(odd(spark).limit(0)).count() == 0


def removed(texts, n=200):
    seen = Counter()
    for b in texts:
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [suffix_dedup.SHARD_SNIPPETS, 3])
def test_repeated_bytes(spark, texts, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_SNIPPETS", most)
    got = {r.doc_id: r for r in catalogue.op8_suffix_array_dedup(spark, "/root/testdata/sf0.001").collect()}
    for i, want in zip(texts, removed([(t or "").encode() for t in texts.values()]), strict=True):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want


def test_repeats_inside_a_text_and_on_odd_rows(spark):
    r = random.Random(8)
    part = "".join(r.choice("abcé ") for _ in range(230))
    own = ["ab" * 300, part + "X" + part, part[:199], "a" * 199, "a" * 201, "Z" + part]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    got = [tuple(x)[1:] for x in suffix_dedup.removal_digest(df).orderBy("doc_id").collect()]
    assert got == removed([t.encode() for t in own])
    got = suffix_dedup.removal_digest(odd(spark)).collect()
    assert len(got) == 7 and [x.n_removed == x.n_bytes for x in got if x.doc_id == 4] == [True, True]
    cut = suffix_dedup.remove_repeats(odd(spark))
    assert cut.columns == odd(spark).columns and {x.text for x in cut.collect() if x.doc_id == 4} == {""}
    assert suffix_dedup.removal_digest(odd(spark).limit(0)).count() == 0


def test_a_frequent_line_in_many_contexts(spark):
    r = random.Random(9)
    words = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    line, passage, twin = words(120), words(400), words(700)
    own = [words(150) + line + words(150) for _ in range(60)] + [words(90) + passage + words(90) for _ in range(30)]
    own += [twin] * 25 + [own[3], own[3][40:], words(300) + line, (line + "|") * 9]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(5, "doc_id")
    got = [tuple(x)[1:] for x in suffix_dedup.removal_digest(df).orderBy("doc_id").collect()]
    assert got == removed([t.encode() for t in own])


def test_whole_characters_go(spark):
    own = ["é" * 150 + "x", "y" + "é" * 99 + "e" + "é" * 99 + "e", "z" + "é" * 99 + "e" + "é" * 99 + "ö"]
    got = [x.text for x in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert all(set(g) <= set(o) and "\ufffd" not in g for g, o in zip(got, own, strict=True)) and got[0] == "x"


@pytest.mark.parametrize("size", [1, 3, 50])
def test_flags_of_a_stream(size):
    r = random.Random(size)
    for _ in range(60):
        rows = []
        for a in range(r.randint(1, 8)):
            rows += [(k, 0, 0, a, 10 * a + r.randint(0, r.choice([0, 1, 4])), r.choice([0, 0, 0, 1])) for k in range(r.randint(1, 9))]
            rows += [(0, 0, 0, a, -(1 << 63), suffix_dedup.TELLS)] * r.choice([0, 0, 0, 1, 2])
        rows.sort(key=lambda x: (x[3], x[4]))
        batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int8()], strict=True)], suffix_dedup._ROW)
        out = suffix_dedup._flag(batch(rows[k : k + size]) for k in range(0, len(rows), size))
        got = sorted((x["h1"], x["anchor"], x["digest"], x["whole"], x["open"]) for b in out for x in b.to_pylist())
        told = {x[3] for x in rows if x[5] == suffix_dedup.TELLS}
        n, kinds = Counter(), {}
        for x in rows:
            n[x[4]] += 1 + (x[5] == suffix_dedup.TWICE)
            kinds.setdefault(x[3], set()).add(x[4])
        real = [x for x in rows if x[5] != suffix_dedup.TELLS]
        want = [(x[0], x[3], x[4], n[x[4]] > 1 and x[3] not in told, x[3] in told) for x in real if x[3] in told or n[x[4]] > 1 or len(kinds[x[3]]) > 1]
        assert got == sorted(want)
        out = suffix_dedup._flag(batch(rows[k : k + size]) for k in range(0, len(rows), size))
        firsts = sorted(x["digest"] for b in out for x in b.to_pylist() if x["first"])
        assert firsts == sorted({x[4] for x in real if x[3] not in told and len(kinds[x[3]]) > 1})


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(2)
    for t in (r.integers(0, 2, 200), r.integers(0, 255, 300), np.zeros(50), np.zeros(1), np.tile([1, 2, 0], 40)):
        t = t.astype(np.uint8)
        b = t.tobytes()
        sa = suffix_dedup.suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        lcp = suffix_dedup.common_prefixes(t, sa, np.array([0]), np.array([len(t)]))
        for p, q in zip(sa[1:], sa[:-1], strict=True):
            n = next((k for k in range(len(b)) if b[p : p + k + 1] != b[q : q + k + 1] or max(p, q) + k >= len(b)), 0)
            assert lcp[p] == n


def test_main_text():
    tree = html_extract.labelled_tree()
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; line</h1><p>One  <b>two</b>&nbsp;three<br>four<p>Short.</p><!-- <p>no</p> --><script>var x="</p>";</script><div class=ad>Buy now</div><p>&lt;tag&gt; é</p></article>
    <section id="comments"><p>I like this very much, thanks for the article</p></section><aside>More</aside><footer>&copy; me</footer>"""
    assert html_extract.main_text(page, tree) == "Head & line\nOne two three four\nShort.\n<tag> é"
    assert html_extract.main_text(None, tree) == "" and html_extract.main_text("<nav>a b c</nav>", tree) == ""


def test_main_text_on_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 2), (None, "u", "<article><p>a b</p></article>", 3), (2, "u", "<article>" + "<p>x y z</p>" * 50000, 4)], "page_id long, url string, html string, text int")
    got = html_extract.extract(pages).select("row.page_id", F.length("text").alias("n")).collect()
    assert [r.n for r in got] == [0, 0, 3, 50000 * 6 - 1]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_language(spark, docs):
    sf = "/root/testdata/sf0.01"
    out = catalogue.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    r = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a > 0.97 and r.lo >= 0 and r.hi <= 1
    d = odd(spark)
    got = langid.identify(d, langid.train(d, steps=5)).select("row.doc_id", "lang_pred", "score").collect()
    assert len(got) == 7 and {x.lang_pred for x in got if x.doc_id in (1, 2, 3, 5)} == {"und"}
    assert {x.lang_pred for x in langid.identify(d, langid.train(d.limit(0))).collect()} == {"und"}
    assert langid.identify(d.limit(0), None).count() == 0


def test_network_tables_equal_the_network():
    net = langid.Network(["a", "b"])
    x = np.random.default_rng(1).integers(0, 256, (3, langid.WINDOW)).astype(np.uint8)
    e, h = net.p["e"][x], []
    for w in langid.WIDTHS:
        cols = np.concatenate([e[:, j : langid.WINDOW - w + 1 + j] for j in range(w)], axis=2)
        h.append(np.maximum((cols @ net.p[f"f{w}"] + net.p[f"b{w}"]).max(axis=1), 0))
    z = np.exp(np.concatenate(h, axis=1) @ net.p["v"] + net.p["c"])
    assert np.allclose(langid.probabilities(net.tables(), x), z / z.sum(axis=1, keepdims=True), atol=1e-4)


def edit_distance(a, b):
    d = {(i, j): i or j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_edit_distance():
    r, terms = random.Random(6), ["idiot", "worthless", "pathetic"]
    trie = toxicity.Trie(terms, [])
    for _ in range(400):
        w = list(r.choice(terms))
        for _ in range(r.randrange(3)):
            k = r.randrange(len(w))
            w[k : k + r.randrange(2)] = r.choice(["", "x", "i", "t"])
        w = "".join(w)
        best = min(edit_distance(w, t) for t in terms)
        found = trie.match(w)
        assert (found[0] if found else None) == (best if best <= 1 else None), w


def test_misspelled_terms_under_a_stem():
    r, forms = random.Random(3), ["idiot", "idiots", "idiotic", "idiotically"]
    noise = lambda: "".join(r.choice("klmnopqrstuvw") for _ in range(7))
    texts = [f"{noise()} {noise()} {w} {noise()}" for w in forms for _ in range(40)]
    toxic = np.array([True] * len(texts) + [False] * 600)
    terms, stems = toxicity.learn_terms(texts + [" ".join(noise() for _ in range(4)) for _ in range(600)], toxic)
    assert stems == ["idio"] and terms == sorted(forms)
    words = ["idiot", "idiotisch", "idoit", "ediot", "1diot", "idoitic", "ediotically", "edition", "idol"]
    got = toxicity.Matcher(toxicity.Model(terms, stems))(toxicity._Fold(pa.array([" ".join(words)], pa.string())))
    assert got.tolist() == [2, 2, 1, 1, 1, 1, 1, 0, 0]


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = catalogue.op6_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    assert r[r.toxic == 0].predicted.mean() < 0.02 and r[r.toxic == 1].predicted.mean() >= 0.6
    m = toxicity.Model(terms=["idiot"])
    x = toxicity.features(pa.array(['he said "you idiot" to him', "you idoit", "fine", None]), toxicity.Matcher(m))
    assert x[0, 3] > 0 and x[0, 1] == 0 and x[1, 2] > 0 and not x[2:, 1:].any()
    d = odd(spark)
    got = toxicity.score(d, toxicity.train(d, labels.limit(0))).select("score").collect()
    assert len(got) == 7 and all(0 <= g.score < 0.5 for g in got)


def test_mixing_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    df = catalogue.op7_mixing(spark, sf)
    want = con.execute(mixing.SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())


def test_mixing_on_odd_rows(spark):
    r = mixing.mix(odd(spark)).collect()
    assert len(r) == 7 and all(x.taken <= 2 * x.size for x in r)
    for s in {x.source for x in r}:
        own = [x for x in r if x.source == s]
        assert sum(x.taken for x in own) == round(own[0].target) and own[0].target <= 2 * own[0].source_size
    assert sorted(map(tuple, r), key=str) == sorted(map(tuple, mixing.mix(odd(spark)).collect()), key=str)
    assert mixing.mix(odd(spark).limit(0)).count() == 0


def test_licences(spark, sf):
    mit = license_scan.KNOWN["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,")), (2, mit.replace("conditions", "terms")), (3, None), (4, mit.replace("sublicense", "sublicence")), (4, mit)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, digest string, license string")
    assert [r.license for r in license_scan.scan(df).orderBy("doc_id").collect()] == ["MIT", None, None, "MIT", "MIT"]
    assert license_scan.scan(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.execute("select doc_id, digest, license from (" + license_scan.sql() + ")").fetchall()
    key = lambda x: (x[0], x[1])
    assert sorted(map(tuple, catalogue.op9_license_scan(spark, sf).collect()), key=key) == sorted(want, key=key)


def test_licence_files_as_they_are_found(spark, sf):
    isc, mit = license_scan.KNOWN["ISC"], license_scan.KNOWN["MIT"]
    wrapped = isc.replace("that the above copyright", "that the above\ncopyright")
    rows = [("ISC", f"ISC License\n\nCopyright (c) 2020, Someone\n\n{wrapped}"), ("MIT", f"MIT License\n\nCopyright Jane Doe\nCopyright 2020 Others\n\n{mit}"), (None, mit.replace("and this", "land or this")), (None, "land or\nband or band"), (None, ""), (None, None), ("MIT", mit + " \n" * 200_000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, license string, text string")
    assert [r.license for r in license_scan.scan(df).orderBy("doc_id").collect()] == [r[0] for r in rows]
    canon = [r[0] for r in df.orderBy("doc_id").select(license_scan.canonical(F.col("text"))).collect()]
    assert canon[3] == "land or band or band"
    known = license_scan.held_texts()
    assert len(known) >= 25
    rows = spark.createDataFrame(list(known.items()), "license string, text string")
    assert rows.select(license_scan.canonical(F.col("text"))).distinct().count() == len(known)
    two = license_scan.known_digests(spark, {"b": mit, "a": mit.upper()})
    assert [r.license for r in two.collect()] == ["a"]
    names = spark.createDataFrame([(i, f"Name {i}") for i in range(4 * len(known))], "key long, name string")
    got = {r.doc_id: r.license for r in license_scan.scan(license_scan.wrapped_files(names)).collect()}
    assert got == {i: list(known)[i % len(known)] for i in range(4 * len(known))}


def test_licence_passages(spark, sf):
    texts = license_scan.held_texts()
    wrap = lambda t: "\n".join("# " + t[i : i + 90] for i in range(0, len(t), 90))
    assert {"BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= set(texts)
    rows = [(k, f"The {k} License\n\nCopyright (c) 2020 Someone\n\n{v}\n\nand more") for k, v in texts.items()]
    rows += [("flat", " ".join(texts["GPL-3.0"].split())), ("two", f"a\n{texts['MIT notice']}\nb\n" + wrap(texts["CC-BY-NC-4.0 notice"])), ("no", texts["MIT"].replace("conditions", "terms")), ("none", None), ("none", "")]
    # a wrapped line of the terms that begins with the word copyright is no copyright line
    rows.append(("wrapped", texts["BSD-2-Clause"].replace("SHALL THE COPYRIGHT", "SHALL THE\nCOPYRIGHT")))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id string, text string, licenses string")
    got = {r.doc_id: r.licenses for r in license_scan.passages(df).collect()}
    more = {"flat": "GPL-3.0", "two": "CC-BY-NC-4.0 notice, MIT notice", "no": None, "none": None, "wrapped": "BSD-2-Clause"}
    assert all(k in got[k].split(", ") for k in texts) and {k: got[k] for k in more} == more and license_scan.passages(df).count() == len(rows)
    assert license_scan.passages(df.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    out = catalogue.op9_license_passages(spark, sf).collect()
    want = con.execute("select doc_id, n_licenses, licenses from (" + license_scan.passages_sql() + ")").fetchall()
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    held = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if set((r.text or "").split("\n")) & set(license_scan.KNOWN.values())]
    assert held and set(held) <= {r.doc_id for r in out if r.n_licenses}


def test_decontamination(spark):
    r = random.Random(9)
    item = [f"b{r.randrange(10**6)}" for _ in range(30)]
    noise = lambda n: [f"z{r.randrange(10**6)}" for _ in range(n)]
    few = [w if i % 7 != 3 else "other" for i, w in enumerate(item)]
    half = [w if i % 2 else "other" for i, w in enumerate(item)]
    texts = [noise(40) + item + noise(9), noise(5) + few + noise(50), noise(20) + half, noise(60) + item[:9] + noise(30), [w.upper() + "," for w in item], noise(70)]
    rows = [(i, " ".join(t), "k") for i, t in enumerate(texts)] + [(None, None, "k"), (7, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(3, " ".join(item)), (4, None), (5, ""), (6, "one two"), (3, " ".join(noise(25)))], "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 100):
        got = {x.doc_id: x for x in decontaminate.contamination(df, bench, block_bytes=block).select("row.doc_id", "item_id", "tokens").collect()}
        assert {i for i, x in got.items() if x.item_id == 3} == {0, 1, 4} and got[0].tokens == 30 and len(got) == 8
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).filter("item_id is not null").count() == 0


def test_all_items_of_a_document(spark):
    r = random.Random(5)
    items = {i: [f"b{r.randrange(10**6)}" for _ in range(n)] for i, n in ((2, 20), (5, 30), (9, 30))}
    noise = " ".join(f"z{r.randrange(10**6)}" for _ in range(40))
    whole = f" {noise} ".join(" ".join(items[i]) for i in (9, 2, 5))
    df = spark.createDataFrame([(1, f"{whole} {noise} {' '.join(items[9][:15])}"), (2, noise), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 100):
        got = {x[0]: tuple(x)[1:] for x in decontaminate.contamination(df, bench, block_bytes=block).select("row.doc_id", "item_id", "tokens", "items").collect()}
        assert got == {1: (5, 30, [(5, 30), (9, 30), (2, 20)]), 2: (None, None, []), 3: (None, None, [])}


def test_short_items_with_every_substitution(spark):
    r = random.Random(7)
    items = {n: [f"s{r.randrange(10**6)}" for _ in range(n)] for n in range(1, 14)}
    rows, want = [(0, " ".join(f"z{i}" for i in range(30)))], {0: []}
    for n, item in items.items():
        for m in range(4):
            for out in itertools.combinations(range(n), m):
                w = ["other" if i in out else x for i, x in enumerate(item)]
                want[len(rows)] = [(n, n - m)] if n - m >= decontaminate.SHARE * n else []
                rows.append((len(rows), " ".join(["a", "b", *w, "c"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    got = {x.doc_id: list(map(tuple, x["items"])) for x in decontaminate.contamination(df, bench).select("row.doc_id", "items").collect()}
    assert got == want


def test_pipeline_stages(spark, sf, docs, texts):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "repeated_passages", "benchmark_leaks", "mixture"]
    df, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, sf).cache()
        assert df.columns == docs.columns
        seen.append({r.doc_id: r.text for r in df.collect()})
    groups = shingle_groups(seen[0])
    assert set(seen[1]) == {i for i, (_, c) in groups.items() if i == c}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in seen[2].items()}
    for i, (_, _, _, sha) in zip(seen[1], removed([(t or "").encode() for t in seen[1].values()]), strict=True):
        assert want[i] == sha or "�" not in seen[2][i]
    assert set(seen[3]) <= set(seen[2])
    last = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in last.collect()} <= set(seen[3])


def test_texts_that_share_an_id(spark, sf):
    r = random.Random(12)
    a, b, c, d = ([f"t{r.randrange(10**6)}" for _ in range(100)] for _ in range(4))
    near = lambda w: [*w[:-1], "other"]
    rows = [(5, a), (5, b), (5, b), (5, near(b)), (3, near(c)), (5, c), (7, a), (8, near(b)), (7, d), (6, d), (5, []), (9, [])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(4)
    got = sorted((x.doc_id, x.text) for x in pipeline.near_copies(spark, df, sf).collect())
    twin = [x for x in got if x in ((5, " ".join(b)), (5, " ".join(near(b))))]
    assert len(twin) == 1 and sorted(set(got) - set(twin)) == sorted((i, " ".join(w)) for i, w in ((3, near(c)), (5, a), (5, []), (6, d), (9, []))) and len(got) == 6
    by = {}
    for x in near_dedup.near_duplicates(df).collect():
        by.setdefault(x.doc_id, []).append((x.component_id, x.kept))
    assert by[7] == [(5, False), (6, False)] or by[7] == [(6, False), (5, False)]
    assert by[8] == [(5, False)] and by[3] == [(3, True)] and sorted(by[5]) == [(3, False)] + [(5, True)] * 5


def test_pipeline_on_odd_rows(spark, sf):
    df = odd(spark)
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, sf)
        df.collect()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd(spark).limit(0), sf).count() == 0


#: Shapes that the tree wasn't trained on; [[..]] marks what is main text.
UNSEEN = {
    "magazine": """<body><div id="masthead"><a href=/>{2}</a><span>{6}</span></div><div role="navigation"><a href=/a>{1}</a><a href=/b>{2}</a></div><div itemprop="articleBody"><h1>[[{7}]]</h1><p>[[{48}]]</p><div class="promo-box"><p>{16}</p></div><p>[[{33}]]</p><h3>[[{4}]]</h3><p>[[{61}]]</p></div><div class="recommended"><a href=/1>{6}</a><p>{12}</p></div><div id="disqus_thread"><p>{30}</p></div><div class="page-footer">{10}</div></body>""",
    "intranet": """<body><form id="mainForm"><table><tr><td class="leftMenu"><a href=/a>{2}</a><br><a href=/b>{2}</a></td><td><p>[[{52}]]</p><p>[[{11}]]</p><p>[[{44}]]</p></td></tr></table><div class="siteFooter">{9}</div></form></body>""",
    "recipe": """<body><nav><a href=/>{2}</a></nav><main><h1>[[{4}]]</h1><ul><li>[[{3}]]</li><li>[[{4}]]</li></ul><ol><li>[[{16}]]</li><li>[[{21}]]</li></ol><aside><p>{20}</p></aside></main><section id="user-comments"><h2>{2}</h2><div><p>{22}</p></div><div><p>{31}</p></div></section><footer><p>{7}</p></footer></body>""",
    "press release": """<body><div class="cookieBanner"><span>{25}</span><button>OK</button></div><div class="wrapper"><p>[[{9}]]</p><p>[[{70}]]</p><p>[[{40} <a href=/c>{4}</a> {5}]]</p><p>[[{8}]]</p></div><div class="socialShare"><a href=/f>{1}</a><a href=/t>{1}</a></div></body>""",
    "wiki": """<body><div class="sidebar"><ul><li><a href=/1>{3}</a></li><li><a href=/2>{3}</a></li></ul></div><div id="bodyContent"><h1>[[{2}]]</h1><p>[[{14} <a href=/a>{2}</a> {9} <a href=/b>{1}</a>]]</p><p>[[{25} <a href=/c>{3}</a>]]</p><h2>[[{1}]]</h2><p>[[{40}]]</p></div><footer>{11}</footer></body>""",
    "unclosed": """<body><div class=menu><a href=/>{2}</a><a href=/x>{1}</div><article><h1>[[{5}]]</h1><p>[[{30}]]<p>[[{28}]]<p>[[{6}]]<ul><li>[[{5}]]<li>[[{7}]]</ul></article><div class=advertisement>{13}</div>""",
    "search policy page": """<body><header><a href=/>{2}</a><form><input><button>Search</button></form></header><div class="legal search-notice-text"><h1>[[{3}]]</h1><p>[[{60}]]</p><p>[[{80}]]</p></div><div class="copyright">{6}</div></body>""",
    "plain letter": """<body><p>[[{3}]]</p><p>[[{18}]]</p><p>[[{24}]]</p><p>[[{4}]]</p></body>""",
}


def test_pages_of_shapes_not_trained_on():
    tree = html_extract.labelled_tree()
    hit = extra = missed = 0
    for page in UNSEEN.values():
        want = Counter(" ".join(re.sub("<[^>]*>", "", filled(x)).split()) for x in re.findall(r"\[\[(.*?)\]\]", page))
        got = Counter(html_extract.main_text(filled(page.replace("[[", "").replace("]]", "")), tree).split("\n"))
        hit, extra, missed = hit + sum((want & got).values()), extra + sum((got - want).values()), missed + sum((want - got).values())
    assert hit / (hit + extra) >= 0.95 and hit / (hit + missed) >= 0.95


def test_names_and_forms_are_no_veto():
    tree, w = html_extract.labelled_tree(), filled("{80}")
    for page in (f'<div class="social-policy"><p>{w}</p></div>', f'<div class="legal-news"><p>{w}</p></div>', f'<form id="aspnetForm"><p>{w}</p></form>', f"<div>{w}</div>"):
        assert html_extract.main_text(f"<body><nav><a href=/>Home</a></nav>{page}</body>", tree) == w
    assert html_extract.main_text(f"<article><p>{w}</p><p><a href=/>one two three four</a> five</p><p>{w}</p><ul><li>a <a href=/>b c</a></li></ul></article>", tree) == f"{w}\none two three four five\n{w}\na b c"
    assert html_extract.main_text("<p>Two short words.</p><p>And three more words.</p>", tree) == "Two short words.\nAnd three more words."


@pytest.mark.parametrize("bad", ['<div x="', "<div x='a", "<svg><p>x", "<b>", "<!-- ", "</div>", "<p><i>", "<a b", "<", "<div>x", "<script>", "<span>x <div>", "&lt;x &#"])
def test_malformed_pages_take_time_in_proportion(bad):
    t = time.perf_counter()
    html_extract.main_text("<p>Some words here.</p>" + bad * (1_000_000 // len(bad)), html_extract.labelled_tree())
    assert time.perf_counter() - t < 20


def test_attributes_and_breaks():
    tree = html_extract.labelled_tree()
    page = "<article><p title='a > b' class=x>One <br/>two&nbsp;three<p data-x=\"</p>\">Four &amp; five</p><textarea>no</textarea><svg><text>no</text></svg></article>"
    assert html_extract.main_text(page, tree) == "One two three\nFour & five"


def test_estimation_outgrows_a_wrong_guess():
    rng = random.Random(5)
    right = [0.95, 0.9, 0.9, 0.55]
    seen = Counter()
    for _ in range(20000):
        good = rng.random() < 0.7
        seen[tuple(0 if rng.random() < 0.2 else (1 if good == (rng.random() < a) else -1) for a in right)] += 1
    guess = quality.Estimate([0.5, 0.5], [[0.4, 0.4, 0.4, 0.03], [0.6, 0.6, 0.6, 0.97]])
    e = quality.estimate(list(seen.items()), guess)
    assert abs(e.shares[0] - 0.7) < 0.03
    assert all(abs(a - x) < 0.04 for pair, a in zip(e.accuracies(), right, strict=True) for x in pair)
    assert quality.estimate([], guess) == guess


def test_estimation_tells_rare_faults_apart():
    """Two faults that different rules find: neither passes for good."""
    rules = {f"r{k}": ("false", "false", "a" if k < 2 else "b") for k in range(4)}
    seen = [((1, 1, 1, 1), 9000), ((-1, -1, 1, 1), 700), ((1, 1, -1, -1), 300), ((1, 1, 1, -1), 20), ((0, 0, 0, 0), 5)]
    e = quality.estimate(seen, quality.first_guess(rules))
    good = {v: e.kinds(v)[0] for v, _ in seen}
    assert good[1, 1, 1, 1] > 0.99 and good[-1, -1, 1, 1] < 0.01 and good[1, 1, -1, -1] < 0.01 and abs(good[0, 0, 0, 0] - e.shares[0]) < 1e-9


def test_quality_verdict_equals_the_formula(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = quality.judge(docs).collect()
    names = [f"vote_{k}" for k in quality.RULES]
    seen = Counter(tuple(r[n] for n in names) for r in rows)
    e = quality.estimate(sorted(seen.items()), quality.first_guess())
    for r in rows:
        p = e.kinds(tuple(r[n] for n in names))[0]
        assert abs(p - r.probability) < 1e-6 and r.kept == (not r.base_failed and r.probability >= 0.5)


def test_no_edit_escapes_the_prefilter():
    """Every word that the automaton takes is asked for, stems and letters of several bytes included."""
    rng = random.Random(3)
    model = toxicity.Model(terms=["worthless", "idiot", "dégoûtant", "straße"], stems=["worthl", "élévate", "stupid"])
    letters = "abdeiglorstuwéûß"
    words = set()
    for w in [*model.terms, *(x + y for x in model.stems for y in ("", "ess", "ing"))]:
        for i in range(len(w) + 1):
            words |= {w[:i] + w[i + 1 :], w[: max(i - 1, 0)] + w[i : i + 1] + w[max(i - 1, 0) : i] + w[i + 1 :]}
            words |= {w[:i] + c + w[i:] for c in letters} | {w[:i] + c + w[i + 1 :] for c in letters}
    words |= {"".join(rng.choices(letters, k=rng.randint(2, 12))) for _ in range(2000)}
    words = sorted(w for w in words if len(w.encode()) > 1)
    got = toxicity.Matcher(model)(tx_fold(words))
    trie = toxicity.Trie(model.terms, model.stems)
    missed = [w for w, v in zip(words, got, strict=True) if (trie.match(w) is not None) != (v in (1, 2))]
    assert not missed


def tx_fold(words):
    return decontaminate._Fold(pa.array([" ".join(words)], pa.string()))


def test_toxicity_ties_and_repeated_labels(spark):
    docs = spark.createDataFrame([(i, t) for i in range(40) for t in ([f"you are a worthless {w} idiot number {i}" if i % 2 else f"the {w} river is calm number {i}" for w in ("big", "small")])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert model.terms == toxicity.train(docs.orderBy(F.desc("text")), labels.union(labels)).terms
    one, two = (sorted((r.row.doc_id, r.row.text, round(r.score, 9)) for r in toxicity.score(docs, model).collect()) for _ in range(2))
    assert one == two


def leaks(texts, items, window=13, share=0.8):
    """Every alignment of every item with every text, token by token."""
    fold = lambda t: "".join(c.lower() if c.isascii() else c for c in (t or "") if True)
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", fold(t))
    out = []
    for t in texts:
        w, found = split(t), {}
        for i, item in items:
            b = split(item)
            need = min(window, len(b))
            for shift in range(-len(b), len(w)) if need else ():
                lo, hi = max(0, -shift), min(len(b), len(w) - shift)
                same = [w[k + shift] == b[k] for k in range(lo, hi)]
                if any(sum(same[k : k + need]) >= share * need for k in range(len(same) - need + 1)):
                    found[i] = max(found.get(i, 0), sum(same))
        out.append(found)
    return out


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 10])
def test_decontamination_equals_brute_force(spark, block):
    """Both ways, with repeated rows and items, shared prompts, short items, ties and common words."""
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "Ünit", "x1"]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    prompt = words(9)
    items = [(k, " ".join(prompt + words(r.randint(4, 14)))) for k in range(12)] + [(20 + k, " ".join(words(k + 1))) for k in range(13)] + [(3, " ".join(words(20))), (50, None), (51, ""), (None, " ".join(words(15)))]
    texts = [" ".join(words(60)) for _ in range(12)]
    for k in range(24):
        item = (r.choice(items)[1] or "a b").split()
        cut = [w if r.random() > 0.15 else "other" for w in item]
        texts.append(" ".join(words(r.randint(0, 20)) + cut + words(r.randint(0, 20))))
    texts += [texts[-1], texts[-2].upper(), None, "", " ".join(prompt * 30)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, items string")
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    got = {x.doc_id: x for x in got.select("row.doc_id", "item_id", "tokens", "items").collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(leaks(texts, items)):
        assert {x.item_id: x.tokens for x in got[i]["items"]} == want, texts[i]
        best = min(want.items(), key=lambda x: (x[0] is None, -x[1], x[0] or 0), default=(None, None))
        assert (got[i].item_id, got[i].tokens) == best
