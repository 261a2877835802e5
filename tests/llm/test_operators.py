"""Operators against brute force and definitions on small fixtures, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from ledgerlens.llm import decontaminate as D
from ledgerlens.llm import html_tree as T
from ledgerlens.llm import html_wrapper as H
from ledgerlens.llm import lm_score as L
from ledgerlens.llm import packing as P
from ledgerlens.llm import quality_model as Q
from ledgerlens.llm import simhash as S
from ledgerlens.llm import substring_dedup as B
from ledgerlens.llm.chat import render
from ledgerlens.llm.graph import components
from ledgerlens.llm.queries import QUERIES
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
# columns that an operator uses inside, as extra columns of its input
CLASH = ["fp", "h", "_k1", "anchor", "chunk", "stats", "bucket", "kept", "gone", "_row", "score", "hash"]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank, short and very long texts, ties, repeated rows,
    and extra columns with clashing names."""
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(70))
    long = " ".join(str(rng.randrange(10 ** 6)) for _ in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t\x0b "), (4, "One"), (4, "One"), (5, f"a b {passage} c d"),
            (6, f"{passage} x"), (7, long), (8, f"Q {long}"), (None, f"z {passage} z"), (None, None),
            (9, "é ß 😀     x" * 30), (10, "same " * 500), (11, passage.upper())]
    rows = [(i, t, None if i == 9 else "src", None if i == 10 else "en") for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    return df.withColumns({c: F.lit("x") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(a, b):
    def key(x):
        return [str(y) for y in x]
    return sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


# --- SimHash -------------------------------------------------------------------------------

def simhash(t):
    w = WORD.findall(lower(t))
    s = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_groups(docs):
    fps = [simhash(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for g, (i, _) in zip(group, docs):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return [(i, f"{f:016x}", least[g]) for (i, _), f, g in zip(docs, fps, group)]


def test_simhash_query_and_odd_rows(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert same(QUERIES["op4_simhash_near_dedup"](spark, SMALL).collect(), simhash_groups(pairs(docs)))
    assert same(S.near_duplicates(odd).collect(), simhash_groups(pairs(odd)))
    assert S.near_duplicates(none).count() == 0 and S.keep_one(none).count() == 0
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == sorted(
        {c for _, _, c in simhash_groups(pairs(odd)) if c})


def test_keep_one_decides_by_row(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (3, b), (5, b), (None, c), (None, c), (None, c + " "), (7, a), (7, c), (7, c)]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id or 0, r.text.strip()) for r in kept) == [(0, c), (3, b), (5, a), (7, c)]


def clustered(n, seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 40))]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def component_of(fps, links):
    group = {f: f for f in fps}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        group[max(a, b)] = min(a, b)
    return [root(f) for f in fps]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 300])
def test_bit_sliced_links_equal_all_pairs(n):
    fps = clustered(n, n)
    brute = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    got = S.spanning_links([np.array(fps, np.uint64)], 4)
    assert component_of(fps, got) == component_of(fps, brute)
    assert len(got) < n and all((a, b) != (b, a) for a, b in got)


@pytest.mark.parametrize("bucket_rows", [4096, 40, 4])
def test_hot_buckets_are_dealt_again(spark, bucket_rows):
    """Small bucket limits send the crowd through the finer tables and the chunk pairs."""
    fps = [f - (1 << 64) if f >> 63 else f for f in clustered(400, 9)]
    edges = S.links(spark.createDataFrame([(f,) for f in fps], "fp long"), len(fps), bucket_rows=bucket_rows)
    u = lambda x: x & (1 << 64) - 1
    brute = [(a, b) for a in fps for b in fps if a < b and (u(a) ^ u(b)).bit_count() <= 4]
    assert component_of(fps, [tuple(r) for r in edges.collect()]) == component_of(fps, brute)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(1, 2), (2, 1), (5, 5)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(200, 260)}, 7: 7, 1: 1, 2: 1}


# --- substring de-duplication ----------------------------------------------------------------

def without_repeats(docs, window=35):
    words = [WORD.findall(t or "") for _, t in docs]
    n = Counter(tuple(w[a:a + window]) for w in words for a in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(docs, words):
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if n[tuple(w[a:a + window])] > 1:
                gone[a:a + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_query_and_odd_rows(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert same(QUERIES["op9_substring_dedup"](spark, SMALL).collect(), without_repeats(pairs(docs)))
    assert same(B.removal_report(odd).collect(), without_repeats(pairs(odd)))
    assert B.removal_report(none).count() == 0 and B.remove_repeats(none).count() == 0
    cut = B.remove_repeats(odd)
    assert cut.columns == odd.columns
    shas = [(r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in cut.collect()]
    assert same(shas, [(i, s) for i, _, _, s in without_repeats(pairs(odd))])


@pytest.mark.parametrize("limits", [{}, {"anchor_words": 8, "shard_words": 20}])
def test_repeats_in_few_words(spark, limits):
    """Texts over a tiny vocabulary repeat windows everywhere, also inside themselves."""
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(60)]
    docs += [(100 + i, "c " * i) for i in range(0, 40, 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = B.removal_report(df, window=7, gram=3, **limits).collect()
    assert same(got, without_repeats(docs, 7))


def test_suffix_automaton_counts(spark):
    rng = random.Random(2)
    seqs = [([rng.randrange(3) for _ in range(rng.randrange(1, 30))], rng.randrange(1, 4)) for _ in range(40)]
    auto = B.SuffixAutomaton()
    for s, times in seqs:
        auto.add(s, times)
    auto.settle()
    n = Counter()
    for s, times in seqs:
        for a in range(len(s) - 4):
            n[tuple(s[a:a + 5])] += times
    for s, _ in seqs:
        assert auto.repeated(s, 5) == [n[tuple(s[a:a + 5])] > 1 for a in range(len(s) - 4)]


# --- decontamination -----------------------------------------------------------------------

def shingles(t):
    w = WORD.findall(lower(t))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_items_in_odd_documents(spark, odd, none):
    passage = " ".join(f"p{i}" for i in range(70))
    items = [(1, passage), (2, passage + " " + " ".join(f"q{i}" for i in range(15))), (3, passage + " e" * 30), (4, None),
             (5, ""), (6, "one"), (7, "same same"), (8, "p3 p4 p5 p6 p7"), (8, "p3 p4 p5 p6 p7"), (None, "x y")]
    df = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    want = []
    for i, t in pairs(odd):
        for j, x in items:
            n, got = len(shingles(x)), len(shingles(x) & shingles(t))
            if n and 5 * got >= 4 * n:
                want.append((i, j, got, n, got / n))
    got = D.contamination(odd, df).distinct().collect()
    assert same(got, set(want)) and want
    assert D.contamination(none, df).count() == 0 and D.contamination(odd, df.limit(0)).count() == 0
    kept = D.remove_contaminated(odd, df)
    assert kept.columns == odd.columns and kept.count() == odd.count() - len({(i, t) for i, t in pairs(odd) if any(
        shingles(x) and 5 * len(shingles(x) & shingles(t)) >= 4 * len(shingles(x)) for _, x in items)}) - 1
    # (4, "One") is there twice and goes twice


def test_sketches_never_miss(spark):
    """Any fifth of an item's shingles may be missing, whatever its size."""
    rng = random.Random(4)
    items, docs = [], []
    for i in range(60):
        w = [f"w{i}_{k}" for k in range(rng.randrange(1, 90))]
        items.append((i, " ".join(w)))
        cut = list(w)
        for _ in range(rng.randrange(1, 4)):
            cut[rng.randrange(len(cut))] = "other"
        docs.append((i, " ".join([f"x{rng.randrange(99)}" for _ in range(50)] + cut + ["tail"] * 9)))
    got = {(r.doc_id, r.item_id) for r in D.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, j) for i, t in docs for j, x in items
                   if 5 * len(shingles(x) & shingles(t)) >= 4 * len(shingles(x))}


# --- language model ------------------------------------------------------------------------

def test_lattice_sums_all_segmentations():
    log_p = {L.END: math.log(0.1), **{p: math.log(x) for p, x in
                                     {"▁": 0.1, "▁a": 0.2, "a": 0.15, "b": 0.1, "ab": 0.05, "▁ab": 0.2}.items()}}
    model = L.Lattice(log_p, [math.log(0.1 / 256)] * 256)

    def total(s):
        if not s:
            return 1.0
        out = sum(math.exp(w) * total(s[len(p):]) for p, w in log_p.items() if p != L.END and s.startswith(p))
        if s[0] not in log_p:
            out += math.exp(sum(model.bytes_p[b] for b in s[0].encode())) * total(s[1:])
        return out

    for word in ("a", "ab", "abab", "b", "", "aéb", "😀", "abba"):
        assert math.isclose(model.log10(word), math.log10(total("▁" + word)), abs_tol=1e-9)
        into, at_byte = Counter(), [0.0] * 256
        model.expect(word, 2.0, into, at_byte)
        # every segmentation covers every character once
        chars = sum(len(p) * n for p, n in into.items())
        unknown = sum(c not in log_p for c in word)
        assert math.isclose(chars, 2.0 * (1 + len(word) - unknown), abs_tol=1e-9)


def base_scores(docs):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    n, ends = Counter(), 0
    for i, t in docs:
        if i is not None and not held[i]:
            n.update(WORD.findall(lower(t)))
            ends += 1
    total, v = sum(n.values()) + ends, len(n) + (ends > 0)
    p = lambda c: math.log10((c + 0.5) / (total + 0.5 * (v + 1)))
    return [(i, held[i], len(w) + 1, sum(n[x] > 0 for x in w) + (ends > 0), total,
             round(math.fsum(p(n[x]) for x in w) + p(ends), 6))
            for i, t in docs for w in [WORD.findall(lower(t))]]


def lm_rows(df):
    rows = df.collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]


def test_lm_query_and_odd_rows(spark, odd, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    query = QUERIES["op2_lm_scoring"](spark, SMALL)
    assert same(lm_rows(query), base_scores(pairs(docs)))
    assert same(lm_rows(L.lm_scores(odd)), base_scores(pairs(odd)))
    assert L.lm_scores(none).count() == 0


def plain_scores(docs, rounds=1):
    """Scores by the definition: each word's forward recursion on its own, after one
    expectation step over the training words."""
    log_p, bytes_p = L.read_vocabulary()
    held = {i: i is None or zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    split = [(i, [w.decode() for w in L._split(t)]) for i, t in docs]
    taught = Counter(w for i, ws in split if not held[i] for w in ws)
    for _ in range(rounds if taught else 0):
        into, at_byte = Counter(), [0.0] * 256
        for w, c in taught.items():
            model_of(log_p, bytes_p).expect(w, c, into, at_byte)
        weight = {p: into[p] + L.SMOOTHING for p in log_p}
        weight[L.END] = sum(not held[i] for i, _ in docs) + L.SMOOTHING
        log_p, bytes_p = L._normal(weight, [x + L.SMOOTHING for x in at_byte])
    model = model_of(log_p, bytes_p)
    cache = {}
    return sorted((i or 0, math.fsum([model.end / L.LN10, *(
        cache[w] if w in cache else cache.setdefault(w, model.log10(w)) for w in ws)])) for i, ws in split)


MODELS = {}


def model_of(log_p, bytes_p):
    if id(log_p) not in MODELS:
        MODELS[id(log_p)] = (log_p, L.Lattice(log_p, bytes_p))
    return MODELS[id(log_p)][1]


def test_scores_against_one_word_at_a_time(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted((r.doc_id, r.score) for r in QUERIES["op2_lm_scoring"](spark, SMALL).collect())
    want = plain_scores(pairs(docs))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(math.isclose(a, b, rel_tol=1e-9) for (_, a), (_, b) in zip(got, want))


def test_many_rows_without_id_or_with_one_text(spark):
    """Large chunks are cut by text, and the copies of one text spread over parts."""
    texts = [f"row {i} of {i % 7}" for i in range(6000)] + ["one and the same text"] * 4000
    rows = [(None if i % 2 else 7, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    cut, large, _ = L._chunked(docs, "doc_id", "text", 5000)
    assert cut.select("chunk").distinct().count() > 20 and large.count() >= 2
    assert same(lm_rows(L.lm_scores(docs, chunk_chars=5000)), base_scores(rows))


def test_walk_equals_single_words():
    log_p, bytes_p = L.read_vocabulary()
    one = L.Lattice(log_p, bytes_p)
    walk = L.Walk(one, log_p)
    rng = random.Random(2)
    words = ["", "a", "the", "information", "😀é", "</s>", "x" * 63, "y" * 64, "z" * 200, "▁▁"] + [
        "".join(rng.choice("etaoinshré中") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    raw = [w.encode() for w in words]
    assert np.allclose(walk.log10(raw), [one.log10(w) for w in words], rtol=0, atol=1e-9)
    times = np.arange(1, len(words) + 1)
    into, at_byte, want, bytes_want = np.zeros(len(walk.pieces)), [0.0] * 256, Counter(), [0.0] * 256
    walk.expect(raw, times, into, at_byte)
    for w, c in zip(words, times.tolist()):
        one.expect(w, c, want, bytes_want)
    assert np.allclose(into, [want[p] for p in walk.pieces], atol=1e-6) and np.allclose(at_byte, bytes_want, atol=1e-6)


def test_learning_raises_held_out_likelihood(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    score = lambda rounds: L.lm_scores(docs, rounds=rounds).where("held_out").agg(F.sum("score")).head()[0]
    assert score(1) > score(0)


# --- quality classifier ----------------------------------------------------------------------

def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = QUERIES["op3_quality_classifier"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in got if r.quality == 1]
    bad = [r.score for r in got if r.quality == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.97 and np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(Q.quality_scores(docs, x).collect()) for x in (labels, flipped))
    assert all(math.isclose(x.score, y.score, abs_tol=1e-9) for x, y in zip(a, b))


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, None), (7, 1), (None, 1), (99, 0), (2, 0), (2, 1)], "doc_id long, quality int")
    got = Q.quality_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert [r.score for r in Q.quality_scores(odd, labels.limit(0)).collect()] == [0.5] * odd.count()
    assert Q.quality_scores(none, labels).count() == 0


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(1)
    y, w = rng.random(9), rng.integers(1, 4, 9).astype(float)
    at, level = Q.isotonic(np.arange(9.0), y, w)
    assert (np.diff(level) > 0).all() and (np.diff(at) > 0).all()
    # max-min formula of isotonic regression
    mean = lambda a, b: np.average(y[a:b + 1], weights=w[a:b + 1])
    fit = [max(min(mean(a, b) for b in range(i, 9)) for a in range(i + 1)) for i in range(9)]
    assert np.allclose(sorted(set(np.round(fit, 9))), np.round(level, 9))


def test_fourier_features_approximate_the_kernel():
    model = Q.Model(np.zeros(13), np.ones(13), features=20_000)
    x = np.random.default_rng(0).normal(size=(6, 13))
    z = model.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * Q.WIDTH ** 2))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_repeated_ids_train_in_any_order(spark):
    """Rows that share an id but not a text: the model does not depend on which comes first."""
    rng = random.Random(9)
    docs = [(i % 60, " ".join(rng.choices(["good", "words", "###", "x", "of", "prose."], k=rng.randrange(5, 60))))
            for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    table = lambda rows, n: spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
    one, two = (sorted((r.doc_id, round(r.score, 9)) for r in Q.quality_scores(d, labels).collect())
                for d in (table(docs, 1), table(docs[::-1], 7)))
    assert one == two


# --- HTML ------------------------------------------------------------------------------------

ODD_PAGE = """<html><body class="home"><header><h1>Site</h1></header><div id="main-menu"><a href=x>Home</a></div>
<div class='cookie-notice'>We use cookies</div><main><article><h2>Title &amp; more</h2><p>One  two<br>three
<span class="ad">BUY</span> four.<div class="advert">AD</div><p>Five<!-- c --> six &lt;b&gt; &#x41;<script>if(a<b)"</p>"</script></p>
<ul><li>x<li>y</ul><form><input>Name</form><aside>side</aside></article><section id="comments"><p>nice!</p></section></main>
<footer>f</footer><script>unclosed"""


def alone(page):
    return H.extract(page, H.article_slots(H.skeleton(T.tree(page))))


def test_odd_pages():
    assert alone(ODD_PAGE) == "Title & more\nOne two three four.\nFive six <b> A\nx\ny"
    for page, want in {None: "", "": "", "plain": "plain", "<p": "", "a<b": "a", "<p>x</p": "x", "&nbsp;a&nbsp;b": "a b",
                       "<div>" * 3000 + "deep": "deep", "<p>a<p>b": "a\nb", "1 < 2 > 0": "1 < 2 > 0",
                       "<title>t</title><p>x": "x", "<nav><a>m</a></nav><p>y</p>": "y", "<p>a</p>tail": "a\ntail",
                       "<ul><li><a>m</a></li><li><a>n</a></li></ul><p>text</p>": "text",
                       "<table><tr><td>a<td>b</tr><tr><td>c</table>": "a b\nc", "<p title='a>b'>q</p>": "q"}.items():
        assert alone(page) == want, page


def test_wrapper_of_a_host_is_union_free():
    pages = ["<body><nav>m</nav><article><h1>t</h1><p>a</p></article></body>",
             "<body><nav>m</nav><div class=ad>x</div><article><h1>t</h1><p>a</p><p>b</p></article></body>",
             "<body><nav>m</nav><article><h1>t</h1><dl><dt>k<dd>v<dt>k<dd>v</dl></article></body>"]
    w = H.skeleton(T.tree(pages[0]))
    for p in pages[1:]:
        w = H.merge(w, H.skeleton(T.tree(p)))
    assert H.expression(w) == ("<#page><body><nav>#</nav>(<div.ad>#</div>)?<article><h1>#</h1>(<p>#</p>)*"
                               "(<dl>(<dt>#</dt><dd>#</dd>)+</dl>)?</article></body></#page>")


def of_host(*pages):
    """The texts of the pages of one host, read through its wrapper."""
    w = None
    for p in pages:
        k = H.skeleton(T.tree(p))
        w = k if w is None else H.merge(w, k)
    slots = H.loads(H.dumps(H.article_slots(H.loads(H.dumps(w)))))
    return [H.extract(p, slots) for p in pages]


def test_text_that_a_host_repeats_is_its_template():
    page = "<body><p>Join our club</p><div><p>story {0} goes on</p><p>and {0} ends</p><p>All rights reserved</p></div></body>"
    assert of_host(*(page.format(i) for i in range(3))) == [f"story {i} goes on\nand {i} ends" for i in range(3)]
    # what stands inside every article belongs to it, on any number of pages
    in_article = "<p>Join</p><article><h1>t{0}</h1><h2>Abstract</h2><div>{0} words</div></article><p>(c)</p>"
    for n in (1, 2, 3, 8, 9, 30):
        assert of_host(*(in_article.format(i) for i in range(n))) == [f"t{i}\nAbstract\n{i} words" for i in range(n)]
    # copies of one page, which differ in an advert or the last words, are no template
    body = "<body><div class=ad>x{0}</div><p>" + "word " * 50 + "</p><p>end {1}</p></body>"
    assert all(t.startswith("word word") for t in of_host(body.format(1, 1), body.format(2, 1), body.format(3, 2)))
    # a part that few pages have is no template either
    some = ["<body><p>one</p></body>", "<body><p>two</p><dl><dt>k</dl></body>", "<body><p>six</p><dl><dt>k</dl></body>"]
    assert of_host(*some) == ["one", "two\nk", "six\nk"]


@pytest.mark.parametrize("n", [1, 3, 7, 8, 12, 100])
def test_near_copies_keep_their_article(n):
    """Pages of one article that differ in a block only; with and without an article element."""
    blocks = "".join(f"<p>paragraph {i} of the story</p>" for i in range(20))
    for outer in ("article", "div"):
        page = (f"<body><nav><a href=x>Home</a></nav><div class=cookie-notice>cookies {{0}}</div><{outer}><h1>Title</h1>"
                f"{blocks}<p>copy {{0}}</p></{outer}><footer>(c)</footer></body>")
        want = "\n".join(["Title", *(f"paragraph {i} of the story" for i in range(20))])
        assert of_host(*(page.format(i) for i in range(n))) == [f"{want}\ncopy {i}" for i in range(n)]


@pytest.mark.parametrize("shared", [7, 8, 20])
def test_a_quotation_on_some_pages_of_a_host(shared):
    for outer in ("article", "div"):
        pages = [f"<body><p>Join our club</p><{outer}><p>story {i} goes on and on, at length and by turns</p>"
                 + ("<blockquote>to be or not to be</blockquote>" if i < shared else "") + f"</{outer}></body>"
                 for i in range(100 + shared)]
        for i, t in enumerate(of_host(*pages)):
            assert t == f"story {i} goes on and on, at length and by turns" + "\nto be or not to be" * (i < shared)


def steps_by_table(x, y):
    n, m = len(x), len(y)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and x[i] == y[j]:
            yield 0
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            yield -1
            i += 1
        else:
            yield 1
            j += 1


@pytest.mark.parametrize("kept", [1, 3, 512])
def test_alignment_equals_the_table(monkeypatch, kept):
    monkeypatch.setattr(H, "KEPT_ROWS", kept)
    rng = random.Random(kept)
    for _ in range(300):
        x, y = (rng.choices("abcd"[:rng.randrange(1, 5)], k=rng.randrange(12)) for _ in range(2))
        assert list(H.alignment(x, y)) == list(steps_by_table(x, y)), (x, y)


def test_long_mixed_pages_take_little_memory():
    import tracemalloc
    rng = random.Random(4)
    pages = ["<article>" + "".join(f"<{t}>{i} x</{t}>" for i, t in enumerate(rng.choices(
        ["p", "pre", "h2", "blockquote", "dl", "div"], k=20_000))) + "</article>" for _ in range(2)]
    tracemalloc.start()
    texts = of_host(*pages)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert [t.count("\n") for t in texts] == [19_999, 19_999]


def test_marks_on_layout_and_nested_articles():
    for name in ("layout no-sidebar", "content has-sidebar", "page with-sidebar", "section-header", "tabs",
                 "discussion", "social-sciences", "sidebar-left"):
        for inner in ("<article><p>the story {0}</p></article>", "<main><p>the story {0}</p></main>", "<p>the story {0}</p>"):
            page = f'<body><div class="{name}">{inner}</div></body>'
            assert alone(page.format(1)) == "the story 1", (name, inner)
            page = page.replace("</body>", "<p>(c)</p></body>")
            if name in ("discussion", "sidebar-left") and inner.startswith("<p>"):
                continue  # beside unmarked text this could be comments or cards
            assert of_host(*(page.format(i) for i in range(3))) == [f"the story {i}" for i in range(3)], (name, inner)
    # some pages of a host mark the layout, others do not
    assert of_host("<div class=tabs><article>one</article></div><p>x</p>", "<article>two</article>") == ["one", "two"]
    for name in ("comment", "related-card", "advert"):
        aside = f'<article class="{name}"><p>not this, it is longer</p></article>'
        for page in (f"<main><article><p>story</p>{aside}{aside}</article></main>", f"<main><p>story</p>{aside}{aside}</main>",
                     f"<article><p>story</p></article>{aside}", f"<article><p>story</p></article><div>{aside}</div>"):
            assert alone(page) == "story", page
    assert alone('<main><h1>T</h1><article class="post comments-open"><p>story</p></article></main>') == "story"
    assert alone('<body><p>story</p><div class="related"><article>a long card</article><article>a long card</article></div>') == "story"


def test_links_end():
    for a in ('<a name="top"/>', "<a name=top>", '<a id="top">', '<a href="x"/>', "<p><a href=x>open</p>", "<p><a href=x>open<p>shut", "<div><a href=x>open</div>",
              "<a name=x><a href=y>open</a>", '<a href="x">one <a href="y">two</a>'):
        page = f"<body>{a}<div>the story goes on</div><p>and on</p></body>"
        assert alone(page).endswith("the story goes on\nand on"), a
    # a link is one still if it has blocks inside, or ends with a slash
    for a in ('<a href="x"><h2>more</h2><p>of it</p></a>', "<a href=/x/>more</a>", '<a class="b" href = "/x/" >more</a>'):
        assert alone(f"<body><div>{a}</div><p>the story</p></body>") == "the story", a


def test_deep_pages():
    for deep in (200, 20_000):
        opened, closed = "<div>" * deep, "</div>" * deep
        page = (f"<body><div><article><p>a</p>{opened}<p>b</p><div>c</div><div>d</div><nav>no</nav><aside>no</aside>"
                f"<div class=ad>no</div>e{closed}<p>f</p></article></div><p>no</p></body>")
        assert alone(page) == "a\nb\nc\nd\ne\nf"
        assert of_host(page, page.replace("<p>b<", "<p>x<")) == ["a\nb\nc\nd\ne\nf", "a\nx\nc\nd\ne\nf"]
        w = H.skeleton(T.tree(page))
        assert H.expression(w).count("<div>") == deep + 2


def test_html_query(spark):
    """The pages' articles, read with plain patterns that fit these pages only."""
    import html

    def simple(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
        parts = [html.unescape(re.sub(r"</?b>|<br>", " ", x)) for x in re.split(r"</?(?:p|h1)>", inner)]
        return "\n".join(t for t in (" ".join(x.split()) for x in parts) if t)

    got = {r.page_id: r for r in QUERIES["op5_html_extraction"](spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert (r.url, r.text, r.n_chars) == (p.url, simple(p.html), len(r.text))


def test_html_of_odd_rows(spark):
    rows = [(1, None, ODD_PAGE, "h"), (1, None, ODD_PAGE, "h"), (2, "http://a/x", None, None), (3, "http://a/y", "", "h"),
            (None, "http://a/z", "<article><p>q</p></article><p>no</p>", "h"), (4, "http://a/z", "<p>only</p>", "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, _host string")
    got = [tuple(r) for r in H.main_text(df).collect()]
    whole = "Title & more\nOne two three four.\nFive six <b> A\nx\ny"
    assert same(got, [(1, None, whole, len(whole))] * 2 + [(2, "http://a/x", "", 0), (3, "http://a/y", "", 0),
                                                           (None, "http://a/z", "q", 1), (4, "http://a/z", "only", 4)])
    assert H.main_text(df.limit(0)).count() == 0


# --- chat ------------------------------------------------------------------------------------

def test_snapshots_collapse(spark):
    a, b, c = ("user", "hi"), ("assistant", "yo"), ("user", None)
    convs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, b, c], 5: [b], 6: [a, c], 7: [(None, "x")], None: [a, b, ("user", "")]}
    rows = [(k, n, *t, "z") for k, turns in convs.items() for n, t in enumerate(turns)]
    rows += [(8, 0, "user", "twice", "z")] * 2 + [(9, None, "user", "first", "z"), (9, 1, "user", "then", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n string")
    got = {r.conv_id: r for r in render(df).collect()}
    # 1 and 2 begin 3; 4 has the turns of 3, as has the null id (a null text hashes like an empty one)
    assert set(got) == {3, 5, 6, 7, 8, 9}
    assert got[3].n_copies == 3 and got[3].n_turns == 3 and got[8].n_turns == 2
    assert got[3].rendered == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyo\n<|end|>\n<|user|>\n\n<|end|>"
    assert got[7].rendered == "<|unknown|>\nx\n<|end|>" and got[9].rendered.startswith("<|user|>\nfirst")
    assert render(df.limit(0)).count() == 0


# --- packing ---------------------------------------------------------------------------------

def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))


def test_long_turns_and_clashing_columns(spark):
    """Texts of a million characters; extra columns named as those inside; ties of turns."""
    long = "x y " * 250_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", "b"), (2, 0, "user", long), (3, 0, None, None), (3, 0, "a", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({c: F.lit("z") for c in ("n", "h1", "h2", "a", "b", "t", "_c", "w", "seen", "n_turns", "rendered")})
    got = {r.conv_id: (r.n_turns, r.n_copies, r.rendered) for r in render(df).collect()}
    assert got == {1: (2, 1, f"<|user|>\n{long}\n<|end|>\n<|assistant|>\nb\n<|end|>"),
                   3: (2, 1, "<|unknown|>\n\n<|end|>\n<|a|>\nt\n<|end|>")}


def test_packing_keeps_clear_of_clashing_columns(spark, odd):
    """Filled extra columns named like the results and like those inside."""
    got = P.pack(odd.withColumns({c: F.lit(7) for c in ("n_tokens", "bucket", "slot", "_part", "_at", "_before")}))
    want = P.pack(odd.select("doc_id", "text"))
    sizes = lambda df: sorted((str(r.doc_id), r.n_tokens, r.bucket_tokens) for r in df.collect())
    assert got.columns == want.columns and sizes(got) == sizes(want)


def test_boundaries_are_optimal():
    from itertools import combinations
    rng = random.Random(8)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 10)))
        counts = [rng.randrange(1, 20) for _ in lengths]
        k = rng.randrange(1, 5)
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for m in range(min(k, len(lengths)))
                   for c in combinations(lengths[:-1], m))
        ends = P.best_boundaries(np.array(lengths), np.array(counts), k)
        assert len(ends) <= k and padding(lengths, counts, ends) == best


def test_boundaries_are_exact_for_any_number_of_lengths(spark):
    rng = random.Random(8)
    docs = [(i, "a b " * rng.randrange(300)) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    many, few = (P.pack(df, buckets=5, max_lengths=m).collect() for m in (10 ** 6, 8))
    assert len({r.n_tokens for r in few}) > 100
    for rows in (many, few):
        longest = Counter()
        for r in rows:
            longest[r.bucket] = max(longest[r.bucket], r.n_tokens)
        assert {(r.bucket, r.bucket_tokens) for r in rows} == set(longest.items())
    hist = Counter(r.n_tokens for r in many)
    ends = P.best_boundaries(np.array(sorted(hist)), np.array([hist[n] for n in sorted(hist)]), 5)
    assert sorted({r.bucket_tokens for r in few}) == sorted({r.bucket_tokens for r in many}) == ends


def test_packing_of_odd_rows(spark, odd, none):
    import tiktoken
    encode = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=P._read_ranks(P.TOKENIZER), special_tokens={}).encode_ordinary
    many = odd.select("doc_id", "text").unionByName(spark.range(500).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text")))
    rows = P.pack(many.repartition(5), buckets=4, batch_tokens=64, max_lengths=8).collect()
    want = sorted(len(encode(t or "")) + 1 for _, t in pairs(many))
    assert sorted(r.n_tokens for r in rows) == want and all(r.n_tokens <= r.bucket_tokens for r in rows)
    batches = Counter((r.bucket, r.batch) for r in rows)
    for (b, k), n in batches.items():
        size = next(r.bucket_tokens for r in rows if r.bucket == b)
        full = max(1, 64 // size)
        last = max(x for y, x in batches if y == b)
        assert n == full if k < last else n <= full
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows)
    assert P.pack(none).count() == 0
