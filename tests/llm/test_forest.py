"""LSH-forest near-duplicates against all pairs, on the given tables, crowds and odd rows."""

import random
import re

import numpy as np
import pytest
from ledgerlens.llm import lsh_forest as L
from ledgerlens.llm.queries import QUERIES
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i:i + 3]) for i in range(max(len(w) - 2, 1))) if w else frozenset()


def plain(docs):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and group[i] != group[j]:
                shared = len(sets[i] & sets[j])
                if 100 * shared >= 85 * (len(sets[i]) + len(sets[j]) - shared):
                    a, b = group[i], group[j]
                    group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for g, (i, _) in zip(group, docs):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return sorted(((i, len(s), least[g], i == least[g]) for (i, _), s, g in zip(docs, sets, group)), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_query_against_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain(docs)
    assert got(QUERIES["op11_lsh_forest_near_dedup"](spark, SMALL)) == want
    assert any(not w[3] for w in want)


def test_odd_rows(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.randrange(10 ** 6)) for _ in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t\x0b "), (4, "One"), (4, "one"), (5, "one two"), (6, "ONE\x0ctwo"),
            (7, long), (8, f"Q {long}"), (None, f"{long} z"), (None, None), (None, "solo words here now"),
            (None, "solo words here now"), (9, "é ß 😀     x" * 30), (10, "same " * 500), (11, "same same same"),
            (12, "one two three"), (4, "other text of the same id")]
    docs = frame(spark, rows)
    extra = docs.withColumns({c: F.lit("x") for c in ("node", "sig", "n", "_k1", "comp", "t", "key", "s1", "kept")})
    assert got(L.near_copies(extra)) == plain(rows)
    assert L.near_copies(docs.limit(0)).count() == 0


def crowd(rng, n, words, changes):
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(words)] = f"x{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("region_rows,chunk", [(L.REGION_ROWS, L.CHUNK_SHINGLES), (16, 3000)])
def test_crowds_of_near_copies(spark, region_rows, chunk):
    """Texts around the threshold, most of a crowd's pairs on one side of it; with small
    regions and chunks the deep orders and the pairs of chunks are taken as well."""
    rng = random.Random(region_rows)
    texts = crowd(rng, 250, 120, 9) + crowd(rng, 60, 200, 30) + crowd(rng, 40, 30, 3)
    rows = list(enumerate(rng.sample(texts, len(texts)), 1))
    assert got(L.near_copies(frame(spark, rows).repartition(5), region_rows=region_rows, chunk_shingles=chunk)) == plain(rows)


def test_pairs_at_the_threshold_are_found(spark):
    """300 pairs of similarity 0.85 to 0.86, and 300 just below it."""
    rng = random.Random(8)
    rows, linked = [], 0
    for i in range(600):
        w = [f"{i}_{k}" for k in range(202)]  # 200 shingles
        v = list(w)
        gone = (15 if i % 2 else 17) + (i % 3 == 0)  # a changed tail word costs one shingle a side
        for k in range(1, gone + 1):
            v[-k] = f"{i}_new{k}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        linked += 100 * (200 - gone) >= 85 * (200 + gone)
    out = {r.doc_id: r.component_id for r in L.near_copies(frame(spark, rng.sample(rows, len(rows)))).collect()}
    assert sum(out[2 * i + 1] == 2 * i for i in range(600)) == linked == 300
    assert all(out[2 * i + 1] in (2 * i, 2 * i + 1) and out[2 * i] == 2 * i for i in range(600))


def test_signature_estimates_the_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000, np.uint64))
    for share in (0.2, 0.5, 0.9):
        b = np.unique(np.concatenate([a[:int(share * len(a))], rng.integers(0, 1 << 63, 500, np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((L.signature(a) == L.signature(b)).mean() - true) < 0.15


def test_set_is_order_and_case_free_but_not_place_free():
    cache = L._WordHashes()
    assert len(L.shingle_set("a b c a b c", cache, 3)) == 3
    assert np.array_equal(L.shingle_set("A b\tC", cache, 3), L.shingle_set("a b c", cache, 3))
    assert not np.array_equal(L.shingle_set("a b", cache, 3), L.shingle_set("b a", cache, 3))
