"""Quality rules and the URL filter against their definitions, and odd rows."""

import math
import re
from collections import Counter

import pytest
from ledgerlens.llm import quality_rules as Q
from ledgerlens.llm import url_filter as U
from ledgerlens.llm.queries import ORACLES, QUERIES
from ledgerlens.plans.verify import compare, duck_connection

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    assert compare(QUERIES[name](spark, SMALL), duck_connection(SMALL), ORACLES[name]) == []


def rules(t):
    w = re.findall("[^\x20\x09-\x0D]+", t or "")
    wins = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(wins)
    lines = [x for x in (t or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)),
            len({p for i, x in enumerate(wins) if n[x] > 1 for p in (i, i + 1, i + 2)}))


TEXTS = [None, "", " \n\x0b", "a", "a b", "a a a a", " a  b\tc\n a b c ", "x\n \nx\nx ", "é\u00a0è 😀 # $|",
         "a b c " * 400, " ".join(f"{i % 17} {i}" for i in range(3000)), "p q r s " * 2 + "p q r"]


def test_counts_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in enumerate(TEXTS)],
                               "doc_id long, text string, source string, kept int")
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    for i, t in enumerate(TEXTS):
        r, want = got[i], rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_host_rates_are_shrunk_and_joined_back(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 else "short", "good") for i in range(200)]
    rows += [(1000 + i, "short" if i % 10 else good, "bad") for i in range(200)]
    rows += [(2000, "short", "tiny"), (2001, good, None), (2002, good, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    assert len(got) == len(rows)
    assert not any(got[1000 + i].kept for i in range(200))          # the whole bad host goes
    assert sum(got[i].kept for i in range(200)) == 180
    assert got[2001].kept and got[2002].kept                        # the null host is a host
    by = [(200, 20), (200, 180), (1, 1), (2, 0)]
    m = sum(f / n for n, f in by) / 4
    v = sum((f / n - m) ** 2 for n, f in by) / 4
    s = min(1000, max(1, m * (1 - m) / v - 1))
    hosts = {r._host: r.host_rate for r in Q.host_verdicts(Q._measured(df, "source", "text", ["doc_id"]), "_host").collect()}
    assert math.isclose(hosts["tiny"], (1 + s * m) / (1 + s))
    assert sorted(r.doc_id for r in Q.keep_clean(df).collect()) == sorted(i for i, r in got.items() if r.kept)


def test_rules_on_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert Q.judge(df).count() == 0 and Q.keep_clean(df).count() == 0


URLS = {
    "http://a.net/": ("a.net", "/", "net/"), "http://NET": ("net", "", None), "x": ("", "", None), None: ("", "", None),
    "https://example.net/en/x?q": ("example.net", "/en/x", "example.net/en/"),
    "https://M.Example.Net/en/": ("m.example.net", "/en/", "example.net/en/"),
    "https://notexample.net/en/": ("notexample.net", "/en/", "net/"),
    "https://example.net/EN/": ("example.net", "/EN/", "net/"), "a://b.org/fr/1#z": ("b.org", "/fr/1", "org/fr/"),
    "http://b.org/fr": ("b.org", "/fr", None), "http://example.com/de/": ("example.com", "/de/", "example.com/de/"),
    "http://x.com?u=http://a.net/": ("x.com", "", None), "http://ünet/": ("ünet", "/", None), "://net/": ("net", "/", "net/"),
    "http://a#b://c.net/": ("a", "", None), "": ("", "", None)}


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    verdicts = dict(U.RULES)
    for r, (u, want) in zip(sorted(U.judge_urls(df).collect()), URLS.items()):
        assert (r.host, r.path, r.rule) == want, u
        assert r.verdict == verdicts.get(r.rule, "block" if r.block_score >= 0.5 else "allow")


def grams(host, path, spark_hash):
    for tag, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in U.NGRAMS:
            for i in range(max(len(s) - n + 1, 1)):
                yield spark_hash(tag, s[i:i + n])


def test_model_against_plain_python(spark):
    """The same gradient steps over the same table, written as loops."""
    from pyspark.sql import functions as F
    rows = [("ads.net", "/x"), ("spam.net", "/y"), ("a.org", "/fr/1"), ("good.org", "/fr/2")]
    train = spark.createDataFrame([(h, p, int(h.endswith("net"))) for h, p in rows], "host string, path string, label int")
    dims, steps = 32, 10
    got = U.fit(train, dims=dims, steps=steps)
    known = {}

    def spark_hash(tag, g):
        if (tag, g) not in known:
            known[tag, g] = spark.range(1).select(F.pmod(F.xxhash64(F.lit(tag), F.lit(g)), F.lit(dims))).head()[0]
        return known[tag, g]

    data = [(Counter(grams(h, p, spark_hash)), float(h.endswith("net"))) for h, p in rows]
    w, bias = [0.0] * dims, 0.0
    for _ in range(steps):
        errors = []
        for c, y in data:
            n = sum(c.values())
            errors.append((c, n, 1 / (1 + math.exp(-(bias + sum(k * w[j] for j, k in c.items()) / n))) - y))
        grad = [sum(e * c[j] / n for c, n, e in errors) / len(data) for j in range(dims)]
        bias -= U.BIAS_RATE * sum(e for *_, e in errors) / len(data)
        w = [a * (1 - U.RATE * U.L2) - U.RATE * g for a, g in zip(w, grad)]
    assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for a, b in zip(got, [*w, bias]))


def test_model_learns_the_rule_labelled_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = U.judge_urls(pages).where("rule is not null").select("verdict", "block_score").collect()
    right = sum((r.block_score >= 0.5) == (r.verdict == "block") for r in got)
    assert right / len(got) > 0.95  # most of them were not among the TRAIN_URLS


def test_long_urls(spark):
    """Hosts and paths of a hundred thousand characters are split and judged whole."""
    host, path = "a" * 100_000 + ".net", "/" + "p/" * 50_000
    rows = [(1, f"http://{host}{path}?q=1"), (2, "http://example.com" + path), (3, "x" * 100_000), (4, None)]
    got = {r.page_id: (r.host, r.path, r.rule) for r in U.judge_urls(spark.createDataFrame(
        rows, "page_id long, url string")).select("page_id", "host", "path", "rule").collect()}
    assert got == {1: (host, path, "net/"), 2: ("example.com", path, None), 3: ("", "", None), 4: ("", "", None)}


def test_urls_on_an_empty_table(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
