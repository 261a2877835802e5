"""The Merkle manifest against a plain version, on the given tables and on odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from ledgerlens.llm import merkle as M
from ledgerlens.llm.queries import QUERIES
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    values = [row[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels_of(digests, k):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][i:i + k]) for i in range(0, len(out[-1]), k)])
    return out


def siblings(levels, i, k):
    for level in levels[:-1]:
        s = i // k * k
        yield level[s:i], level[i + 1:s + k]
        i //= k


def plain(rows, k=16):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[s] = levels_of([leaf_of(r) for r in by[s]], k)
    top = levels_of([trees[s][-1][0] for s in order], k)
    out = []
    for j, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = [*siblings(trees[s], i, k), *siblings(top, j, k)]
            seen = dict(r)
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            if hit and r["text"] is not None:
                seen["text"] = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])
            d = leaf_of(seen)
            for a, b in path:
                d = digest([*a, d, *b])
            root = top[-1][0]
            out.append((r["doc_id"], leaf_of(r), trees[s][-1][0], root,
                        digest(x for a, b in path for x in a + b), d, d == root))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_against_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = plain([r.asDict() for r in docs.collect()])
    assert got(QUERIES["op12_merkle_manifest"](spark, SMALL)) == want
    assert {w[-1] for w in want} == {True, False}


def test_hot_source_over_many_partitions(spark):
    rows = [(i, f"Text {i}", "en", "hot" if i % 3 else f"s{i}", i) for i in range(700)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(13)
    want = plain([r.asDict() for r in docs.collect()])
    assert got(M.verified_manifest(docs)) == want


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "A", None, None, None), (1, "", "en", "", 0),
            (2, "é 😀 X", None, "é", 3), (2, "é 😀 X", None, "é", 3), (2, "other", "de", "é", None),
            (3, "B" * 300_000, "en", "z", 300_000), (-5, "C", "en", "z", 1), (10, "D:1-", "1:1", "z", -1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = plain([r.asDict() for r in docs.collect()])
    extra = docs.withColumns({c: F.lit("x") for c in ("tree", "n", "idx", "leaf", "path", "digest", "_mid")})
    assert got(M.verified_manifest(extra)) == want
    assert M.verified_manifest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 257])
def test_one_source_of_n_rows(spark, n):
    rows = [(i, f"T{i}", "en", "only", 1) for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = got(M.verified_manifest(docs))
    assert out == plain([r.asDict() for r in docs.collect()])
    assert all(subroot == root for _, _, subroot, root, *_ in out)


def test_binary_tree_by_xor(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 3}", i) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    rows = M.manifest(docs, fanout=2).select(
        "doc_id", "leaf", "subroot", "root", M.proof(F.col("path")), M.fold(F.col("leaf"), F.col("path")))
    want = [(*w[:5], w[3]) for w in plain([r.asDict() for r in docs.collect()], 2)]
    assert got(rows) == sorted(want, key=str)


def test_any_change_breaks_the_fold(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 4}", i) for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    seen = (F.col("doc_id") == 42, {"n_chars": F.lit(43)})
    folded = M.manifest(docs, seen=seen).where(M.fold(F.col("seen_leaf"), F.col("path")) != F.col("root"))
    assert [r.doc_id for r in folded.collect()] == [42]
