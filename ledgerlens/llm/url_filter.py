"""URL filter: host and path rules first, then a logistic regression on hashed n-grams.

The model's small labelled URL table is made from the rules themselves: the URLs that a
rule decides are labelled by it (1 = block), and a bounded, hash-ordered sample of the
distinct ones is the training table. Features are character n-grams of ``host`` and of
``path``, hashed into ``dims`` weights. The model then judges the URLs no rule fits.

Training is one SQL expression over the one row that holds the bounded sample: full
gradient steps as a fold over the steps, with the n-grams once by URL (for the scores)
and once by weight (for the gradient). Scoring is a sum of weights inside the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import let, lower_ascii, persisted

#: Rules of the contract: (host and path prefix, verdict). Fixed values.
RULES = (("net/", "block"), ("example.net/en/", "allow"),
         ("example.com/de/", "block"), ("org/fr/", "allow"))

TRAIN_URLS = 600        # distinct labelled URLs at most in the training table
DIMS = 1024             # hashed weights
STEPS = 80
RATE = 60.0             # step size of the weights (n-gram shares are small)
BIAS_RATE = 1.0         # step size of the intercept
L2 = 1e-5
NGRAMS = (3, 4)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: host after the first ``://`` up to ``/ ? #``, A-Z lowered;
    path up to ``? #``. Both empty if the URL is null or has no ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substr(u, at + 3, F.char_length(u))).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (host or a subdomain of it, path prefix), else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def features(host: Column, path: Column, dims: int = DIMS, ngrams=NGRAMS) -> Column:
    """Array of hashed weight numbers (0..dims-1), repeats included.

    Host and path n-grams are hashed apart; ``^`` and ``$`` mark the ends.
    """
    def grams(tag: str, s: Column, n: int) -> Column:
        last = F.greatest(F.char_length(s) - n + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.pmod(
            F.xxhash64(F.lit(tag), F.substr(s, i, F.lit(n))), F.lit(dims)).cast("int"))

    marked = [(tag, F.concat(F.lit("^"), v, F.lit("$"))) for tag, v in (("h", host), ("p", path))]
    parts = [grams(tag, s, n) for tag, s in marked for n in ngrams]
    return F.concat(*parts)


def training_table(urls: DataFrame, rules=RULES, limit: int = TRAIN_URLS) -> DataFrame:
    """(host, path, label) of at most ``limit`` distinct rule-labelled URLs, the half of
    them for each label that comes first by hash; label 1 is block."""
    verdicts = dict(rules)
    blocked = F.col("rule").isin([r for r, v in verdicts.items() if v == "block"])
    labelled = (urls.where(F.col("rule").isNotNull())
                .select("host", "path", blocked.cast("int").alias("label")).distinct())
    order = [F.xxhash64("host", "path"), "host", "path"]
    sides = [labelled.where(F.col("label") == y).orderBy(*order).limit(limit // 2) for y in (0, 1)]
    return sides[0].unionByName(sides[1])


def fit(train: DataFrame, dims: int = DIMS, steps: int = STEPS, rate: float = RATE,
        l2: float = L2) -> list[float]:
    """Weights of the hashed n-grams, the last one being the intercept.

    Each URL's n-gram counts are scaled by its number of n-grams. An empty training
    table, or one with a single label, gives weights that are all the intercept's.
    """
    rows = train.select(F.col("label").cast("double").alias("y"),
                        features(F.col("host"), F.col("path"), dims).alias("f"))
    one = rows.agg(F.sort_array(F.collect_list(F.struct("f", "y"))).alias("rows"))
    one = one.select(F.transform("rows", lambda r: r["f"]).alias("f"),
                     F.transform("rows", lambda r: r["y"]).alias("y"))
    cells = one.select(F.posexplode("f").alias("u", "fs")).select(
        "u", (F.lit(1.0) / F.size("fs")).alias("v"), F.explode("fs").alias("j"))
    cells = cells.groupBy("j", "u").agg(F.sum("v").alias("v"))
    # per weight its (URL, share) cells, an empty array for weights without any
    pairs = lambda a, b: F.sort_array(F.collect_list(F.struct(a, b)))
    by_weight = cells.groupBy("j").agg(pairs("u", "v").alias("c"))
    by_weight = by_weight.agg(F.map_from_entries(pairs("j", "c")).alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: F.coalesce(
            F.col("m")[j], F.array().cast("array<struct<u:int,v:double>>"))).alias("m"))
    # per URL its (weight, share) cells
    by_url = cells.groupBy("u").agg(pairs("j", "v").alias("c"))
    by_url = by_url.agg(F.transform(pairs("u", "c"), lambda x: x["c"]).alias("x"))
    # one row of the three; written, so that no step computes them anew
    parts = one.select("y").unionByName(by_weight, True).unionByName(by_url, True)
    model = persisted(parts.agg(*[F.first(c, True).alias(c) for c in ("y", "m", "x")]))
    n = F.greatest(F.size("y"), F.lit(1))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)

    def step(w: Column, _: Column) -> Column:
        def error(x: Column, u: Column) -> Column:
            z = F.aggregate(x, F.get(w, F.lit(dims)), lambda a, c: a + c["v"] * F.get(w, c["j"]))
            return 1 / (1 + F.exp(-z)) - F.get(F.col("y"), u)

        def update(e: Column) -> Column:
            def moved(g: Column, j: Column) -> Column:
                grad = F.aggregate(g, F.lit(0.0), lambda a, c: a + c["v"] * F.get(e, c["u"])) / n
                return F.get(w, j) * (1 - rate * l2) - rate * grad

            bias = F.get(w, F.lit(dims)) - BIAS_RATE * total(e) / n
            return F.concat(F.transform("m", moved), F.array(bias))

        return let(F.transform("x", error), update)

    start = F.array_repeat(F.lit(0.0), dims + 1)
    steps_of = F.sequence(F.lit(1), F.lit(steps))
    fitted = model.select(F.aggregate(steps_of, start, step).alias("w")).head()
    return list(fitted["w"]) if fitted and fitted["w"] else [0.0] * (dims + 1)


def block_score(host: Column, path: Column, weights: list[float]) -> Column:
    """Probability of block under the fitted weights."""
    dims = len(weights) - 1
    w = F.array(*[F.lit(float(x)) for x in weights[:dims]])
    f = features(host, path, dims)
    z = let(f, lambda fs: F.aggregate(fs, F.lit(0.0), lambda a, j: a + F.get(w, j)) / F.size(fs))
    return 1 / (1 + F.exp(-(z + F.lit(float(weights[dims])))))


def judge_urls(pages: DataFrame, url: str = "url", keep: list[str] | None = None,
               rules=RULES) -> DataFrame:
    """host, path, rule, verdict and the model's block score of every row.

    Edge cases: a null URL or one without ``://`` has empty host and path, fits no rule
    and is judged by the model; repeated URLs get the same verdict; an empty table gives
    an empty result; columns of ``pages`` named like the results are ignored unless
    asked for in ``keep``.
    """
    host, path = url_parts(F.col("_url"))
    base = pages.select(F.struct(*(keep or ["page_id"])).alias("_keep"), F.col(url).alias("_url"))
    base = base.select("_keep", host.alias("host"), path.alias("path"))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    weights = fit(training_table(base, rules))
    score = block_score(F.col("host"), F.col("path"), weights)
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    return base.withColumn("block_score", score).withColumn(
        "verdict", F.coalesce(by_rule, F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    ).select("_keep.*", "host", "path", "rule", "verdict", "block_score")
