"""URL filter: rules first, then the likelihood ratio of two character Markov models.

The URLs that a rule allows and those that a rule blocks train one variable-order model each:
distinct URLs, cut into grams of ``ORDER`` characters, counted once for both classes. A gram's
probability is smoothed recursively, from the uniform distribution up to the longest context,

    p_k(c | x1..xk) = (count(x1..xk c) + STRENGTH * p_{k-1}(c | x2..xk)) / (count(x1..xk) + STRENGTH)

so a context that was hardly seen falls back to a shorter one. A URL's score is the sum of
ln p_allow - ln p_block over its characters and its end, divided by their number. A held-out fifth of the
ruled URLs gives the cut between the two means, weighted by the spreads, and the slope.

Only DataFrame functions are used. Every table is keyed by a gram or a URL and pre-aggregated;
the join of URLs with gram scores is a sort-merge join whose hot grams AQE can split.

Defined cases: a null URL counts as the empty one, host and path are empty and the method judges
it by its end alone; equal URLs are judged alike and count once; if one class has no URL to
calibrate with, the cut is 0 and the slope 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillvec.session import durable, stored

#: (verdict, host, path); a rule fits its host and all subdomains below its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 5
STRENGTH = 4.0
ALPHABET = 256
FOLDS = 5
#: Characters of URLs that one task cuts into grams.
TASK_SIGNS = 250_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """``urls`` with one row per character and for the end: ``gram`` has ``order`` characters."""
    pad = F.concat(F.lit("\x02" * (order - 1)), F.col("url"), F.lit("\x03"))
    signs = urls.withColumn("__c", F.split(pad, ""))
    at = F.sequence(F.lit(1), F.size("__c") - (order - 1))
    return signs.withColumn("gram", F.explode(F.transform(at, lambda i: F.array_join(F.slice("__c", i, order), "")))).drop("__c")


def gram_scores(counts: DataFrame, order: int = ORDER, strength: float = STRENGTH) -> DataFrame:
    """``(gram, ratio)`` from ``(gram, a, b)``: the smoothed log ratio of every gram."""
    lower = None
    for k in range(1, order + 1):
        level = counts if k == order else counts.groupBy(F.expr(f"right(gram, {k})").alias("gram")).agg(
            F.sum("a").alias("a"), F.sum("b").alias("b")
        )
        # At most as many rows as there are characters share a context.
        same = Window.partitionBy("context")
        level = level.withColumn("context", F.expr(f"left(gram, {k - 1})"))
        level = level.withColumn("ta", F.sum("a").over(same)).withColumn("tb", F.sum("b").over(same))
        if lower is None:
            level = level.withColumn("qa", F.lit(1.0 / ALPHABET)).withColumn("qb", F.lit(1.0 / ALPHABET))
        else:
            shorter = lower.select(F.col("gram").alias("shorter"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            level = level.withColumn("shorter", F.expr(f"right(gram, {k - 1})")).join(shorter, "shorter")
        lower = level.select(
            "gram",
            ((F.col("a") + strength * F.col("qa")) / (F.col("ta") + strength)).alias("pa"),
            ((F.col("b") + strength * F.col("qb")) / (F.col("tb") + strength)).alias("pb"),
        )
    return lower.select("gram", (F.log("pa") - F.log("pb")).alias("ratio"))


def score_urls(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """``(url, verdict, held, z)`` for distinct ``(url, verdict)``; ``z`` is the normalised ratio.

    The URLs are numbered and stored once; behind that only their numbers go with the grams, so that a
    long URL costs its length and not its square. They are dealt over tasks by their characters.
    """
    held = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    numbered = stored(urls.select(F.monotonically_increasing_id().alias("n"), "url", "verdict", held.alias("held")), "urls")
    signs = numbered.agg(F.sum(F.length("url") + 1)).collect()[0][0] or 0
    dealt = numbered.repartition(-(-signs // TASK_SIGNS) or 1, "n")
    parts = grams(dealt, order).select("n", "gram", F.when(~F.col("held"), F.col("verdict")).alias("learns"))
    per_url = parts.groupBy("n", "learns", "gram").agg(F.count("*").alias("times"))
    counts = per_url.groupBy("gram").agg(
        F.sum(F.when(F.col("learns") == "allow", F.col("times")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("learns") == "block", F.col("times")).otherwise(0)).alias("b"),
    )
    scored = per_url.select("n", "gram", "times").join(gram_scores(counts, order), "gram")
    z = scored.groupBy("n").agg((F.sum(F.col("ratio") * F.col("times")) / F.sum("times")).alias("z"))
    return numbered.join(z, "n").select("url", "verdict", "held", "z")


def calibration(scored: DataFrame) -> tuple[float, float]:
    """(cut, slope) from the held-out URLs of both classes."""
    stats = scored.where("held AND verdict IS NOT NULL").groupBy("verdict").agg(F.avg("z"), F.stddev_pop("z"))
    found = {row[0]: (row[1], max(row[2], 1e-6)) for row in stats.collect()}
    if len(found) < 2:
        return 0.0, 1.0
    (ma, sa), (mb, sb) = found["allow"], found["block"]
    cut = (ma * sb + mb * sa) / (sa + sb)
    slope = (ma - mb) / (sa * sb)
    return (cut, slope) if math.isfinite(slope) and slope > 0 else (0.0, 1.0)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` columns ``page_id, url`` with ``host, path, rule, verdict, score``.

    ``score`` is the calibrated probability of `allow` by the method, for ruled URLs too.
    """
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    keyed = pages.select("page_id", "url", F.coalesce("url", F.lit("")).alias("__u"))
    urls = keyed.select(F.col("__u").alias("url")).distinct()
    urls = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    scored = durable(score_urls(urls.select("url", verdict.alias("verdict"))))
    cut, slope = calibration(scored)
    z = scored.select(F.col("url").alias("__u"), (1 / (1 + F.exp(-(F.col("z") - cut) * slope))).alias("score"))
    judged = keyed.join(z, "__u").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    method = F.when(F.col("score") >= 0.5, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select(
        "page_id", "url", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score"
    )


def query(spark, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "score")
