"""Quality rules per document, and per host from shrunk failure rates.

A document fails a rule on its own words and lines. Rule failures are summed by
host; each host's failure rate is shrunk towards the other hosts by a beta prior
fitted to the hosts' rates by moments, so that a host of few documents is judged by
the prior and a large one by its own count. Host verdicts are joined back.

Everything is built-in expressions: one pass over the texts without a shuffle of
texts, one partial aggregate by host, one join of a narrow row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACE_CHARS, SPACE_CLASS, let, persisted, small, words

#: Rules of one document (fixed values).
MIN_WORDS = 50
REPEAT_PCT = 50         # fails above this share of words in repeated 3-word windows
SYMBOL_PCT = 10         # fails above this many symbols per 100 words
DUP_LINE_PCT = 50       # fails above this share of repeated lines
SYMBOLS = "#*$%&|<>"
#: Up to so many different repeated windows are looked up one by one, more by a sort;
#: both ways count the same.
FEW = 16
RULES = ("short", "repeated", "symbols", "dup_lines")

#: A host is rejected if its shrunk rate of failing documents is above this.
HOST_LIMIT = 0.5


def repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the array ``w``.

    Windows compare by a 64-bit hash of their words; within one text a chance match
    is not to be expected. The cheap distinct count settles most texts.
    """
    def total(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(
            F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def by_sort(hashes: Column) -> Column:
        def flagged(s: Column) -> Column:
            same = lambda x, i: (((i > 0) & (F.get(s, i - 1)["h"] == x["h"]))
                                 | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

        ordered = F.sort_array(F.transform(
            hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(let(ordered, flagged), total)

    def covered(hashes: Column) -> Column:
        twice = let(F.sort_array(hashes), lambda s: F.array_distinct(
            F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))))

        def count(d: Column) -> Column:
            places = F.filter(F.transform(hashes, lambda h, i: F.when(
                F.array_contains(d, h), i)), lambda i: i.isNotNull())
            return F.when(F.size(d) == 0, F.lit(0)).when(
                F.size(d) <= FEW, let(places, total)).otherwise(by_sort(hashes))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(twice, count))

    def windows(a: Column) -> Column:
        hashed = F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + 1), F.get(a, i + 2)))
        return F.slice(hashed, 1, F.greatest(F.size(a) - 2, F.lit(0)))

    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(let(w, windows), covered)).cast("long")


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus the counts and rule failures of each text."""
    t = F.coalesce(F.col(text), F.lit(""))

    def counts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        repeat_words(w).alias("n_repeat_words"))

    def line_counts(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"),
                        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    out = docs.select(
        *(keep or []),
        let(words(t), counts).alias("_w"), let(lines, line_counts).alias("_l"),
        (F.char_length(t) - F.regexp_count(t, F.lit(SPACE_CLASS))).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"))
    out = out.select(*(keep or []), "_w.n_words", "word_chars", "n_symbols",
                     "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words")
    n = F.col("n_words")
    return (out
            .withColumn("short", n < MIN_WORDS)
            .withColumn("repeated", 100 * F.col("n_repeat_words") > REPEAT_PCT * n)
            .withColumn("symbols", 100 * F.col("n_symbols") > SYMBOL_PCT * n)
            .withColumn("dup_lines", 100 * F.col("n_dup_lines") > DUP_LINE_PCT * F.col("n_lines"))
            .withColumn("base_failed", F.col("short") | F.col("repeated"))
            .withColumn("failed", F.col("short") | F.col("repeated") | F.col("symbols")
                        | F.col("dup_lines")))


def host_verdicts(measured: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: documents, failures of each rule, shrunk rate, verdict.

    The beta prior has the mean m and variance v of the hosts' raw rates: strength
    s = m(1-m)/v - 1 (at least 1; hosts that all agree give the largest, 1000). The
    shrunk rate is (failures + s m) / (documents + s).
    """
    by = measured.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("host_docs"),
        *[F.sum(F.col(r).cast("long")).alias(f"host_{r}") for r in RULES],
        F.sum(F.col("failed").cast("long")).alias("host_failed"))
    by = persisted(by)
    rate = F.col("host_failed") / F.col("host_docs")
    m, v = by.agg(F.avg(rate), F.var_pop(rate)).head()
    m = m or 0.0
    s = min(1000.0, max(1.0, m * (1 - m) / v - 1)) if v else 1000.0
    shrunk = (F.col("host_failed") + F.lit(s) * F.lit(m)) / (F.col("host_docs") + F.lit(s))
    return by.withColumn("host_rate", shrunk).withColumn("host_rejected", F.col("host_rate") > limit)


def judge(docs: DataFrame, host: str = "source", text: str = "text",
          limit: float = HOST_LIMIT, keep: list[str] | None = None) -> DataFrame:
    """Counts, rule failures and verdict of every row of ``docs``.

    ``kept`` is false where the row fails a rule of its own or its host is rejected.

    Edge cases: a null or empty text has no words and fails as short; a null host is
    a host of its own; repeated rows are judged (and counted) one by one; an empty
    table gives an empty result; columns named like the results are ignored unless
    asked for in ``keep``.
    """
    m = persisted(_measured(docs, host, text, keep or ["doc_id"]))
    return _joined(m, host_verdicts(m, "_host", limit)).select(
        "_keep.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.col("failed").alias("rule_failed"), "host_rejected")


def _measured(docs: DataFrame, host: str, text: str, keep: list[str]) -> DataFrame:
    inner = docs.select(F.struct(*keep).alias("_keep"), F.col(host).alias("_host"),
                        F.col(text).alias("_text"))
    return measure(inner, "_text", ["_keep", "_host"])


def _joined(m: DataFrame, hosts: DataFrame) -> DataFrame:
    h = small(persisted(hosts.select(F.col("_host").alias("_h"), "host_rejected")))
    out = m.join(h, F.col("_host").eqNullSafe(F.col("_h")), "left")
    return out.withColumn("kept", ~F.col("failed") & ~F.col("host_rejected"))


def keep_clean(docs: DataFrame, host: str = "source", text: str = "text",
               limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` whose verdict is kept, with all their columns.

    The texts are read twice (once for the hosts' rates, once to be filtered) instead
    of being written or shuffled; only the host table is stored and joined.

    Edge cases: null, empty and blank texts fail as short and go; null hosts are one host;
    texts of any length are judged whole; repeated rows are kept or go together; columns of
    any name come back as they are; an empty table gives an empty result.
    """
    hosts = host_verdicts(_measured(docs, host, text, [host]), "_host", limit)
    return _joined(_measured(docs, host, text, docs.columns), hosts).where("kept").select("_keep.*")
