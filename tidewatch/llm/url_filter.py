"""Allow or block URLs by rules and, where none fits, by logistic regression, in DataFrame functions alone.

The features of a URL are the distinct buckets of hashed character n-grams of its host and path.
The regression is trained on a small labelled table in its dual form: one coefficient per
labelled URL, found by a fixed number of gradient steps on their kernel, which is one row of
arrays. The bucket weights that follow from it score a URL without a shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import stage

BUCKETS = 4096
GRAMS = (3, 4)
MOST_LABELLED = 500
STEPS, RATE, DECAY, OFFSET = 200, 0.2, 0.02, 0.1
LEAST_SCORE = 1.0  # log-odds: what is merely unlike the ordinary hosts is allowed
BLOCK, ALLOW = "block", "allow"

# (verdict, host and path), fixed by the caller's contract.
RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))

# A small labelled table: hosts of advertising, gambling, adult, counterfeit and spam sites, and of
# ordinary ones. Both kinds have the same shapes of address, so that these decide nothing.
BLOCK_HOSTS = """
ads ads-server adserver track-ads clicktrack popunder-ads banner-ads affiliate-track casino online-casino casino-royal
casino-slots win-casino big-win poker-win slots-online bets bets-today free-bets sport-bets betting adult adult-video
adult-dating xxx xxx-cams hot-singles pills pills-online cheap-pills cheap-meds discount-pharmacy spam spam-links
link-farm farm-links free-money get-rich-fast replica-watches cheap-replica lottery-winner payday-loans
""".split()
ALLOW_HOSTS = """
library news docs university gardener museum recipes weather history forum school encyclopedia science travel city
teacher music hospital books maps theatre code health village river theory thought other northern translation nations
station county ministry archive academy bakery cycling orchestra chess astronomy
""".split()
_SHAPES = ("https://{}.test/en/12", "http://www.{}.test/", "https://m.{}.test/fr/page/340.html", "http://{}.test/de/77?page=2",
           "https://blog.{}.test/es/5#top", "https://{}.test/article/2231/")
LABELLED = tuple(
    (_SHAPES[i % len(_SHAPES)].format(host), verdict)
    for verdict, hosts in ((BLOCK, BLOCK_HOSTS), (ALLOW, ALLOW_HOSTS))
    for i, host in enumerate(hosts)
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path; both empty for null and for addresses without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _grams(text: Column, tag: str) -> Column:
    """N-grams of characters of the text between marks."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.length(marked) - (n - 1))
        some = F.transform(at, lambda i: F.concat(F.lit(tag), F.substr(marked, i, F.lit(n))))
        return F.when(F.length(marked) >= n, some).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in GRAMS])


def buckets(host: Column, path: Column) -> Column:
    """The distinct feature buckets of a URL, ascending."""
    grams = F.concat(_grams(host, "h:"), _grams(path, "p:"))
    number = lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 4), 16, 10).cast("int") % BUCKETS
    return F.sort_array(F.array_distinct(F.transform(grams, number)))


def train(labelled: DataFrame) -> tuple[list[float], float]:
    """Weight of every bucket, and offset, from ``labelled`` (url, verdict): block or allow.

    Rows of other verdicts are left out and repeated rows count once; there may be MOST_LABELLED
    rows, which meet in one row of arrays. Without rows all weights are 0.
    """
    host, path = url_parts(F.col("url"))
    rows = labelled.where(F.col("verdict").isin(BLOCK, ALLOW)).select("url", "verdict").distinct()
    rows = rows.select(
        "url", "verdict", buckets(host, path).alias("b"), (F.col("verdict") == BLOCK).cast("double").alias("y")
    )
    if rows.count() > MOST_LABELLED:
        raise ValueError(f"the labelled table may have {MOST_LABELLED} rows")
    row = F.struct("url", "verdict", "b", "y")
    one = rows.agg(F.sort_array(F.collect_list(row)).alias("r"))
    size = lambda r: F.sqrt(F.greatest(F.size(r["b"]), F.lit(1)))
    alike = lambda a, b: F.size(F.array_intersect(a["b"], b["b"])) / (size(a) * size(b)) + OFFSET
    kernel = F.transform("r", lambda a: F.transform("r", lambda b: alike(a, b)))
    # Written out, so that no step computes the kernel anew.
    one = stage(one.select("r", kernel.alias("k")), "kernel")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def step(a, _):
        return F.transform(
            a,
            lambda v, i: v + RATE * (F.get("r", i)["y"] - 1 / (1 + F.exp(-dot(F.get("k", i), a))) - DECAY * v),
        )

    zeros = F.transform("r", lambda _: F.lit(0.0))
    fitted = one.select("r", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), zeros, step).alias("a"))
    each = fitted.select(F.explode(F.arrays_zip("r", "a")).alias("z")).select("z.a", "z.r.b")
    per = F.col("a") / F.sqrt(F.greatest(F.size("b"), F.lit(1)))
    shares = F.concat(F.array(F.struct(F.lit(-1).alias("b"), (F.col("a") * OFFSET).alias("w"))), F.transform("b", lambda b: F.struct(b.alias("b"), per.alias("w"))))
    summed = each.select(F.explode(shares).alias("s")).groupBy("s.b").agg(F.sum("s.w").alias("w"))
    found = {r[0]: r[1] for r in summed.collect()}  # BUCKETS + 1 rows at most
    return [found.get(b, 0.0) for b in range(BUCKETS)], found.get(-1, 0.0)


def _fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, rest = rule.partition("/")
    name = name.lower()
    return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)


def labelled_table(spark: SparkSession) -> DataFrame:
    """The labelled table that is used where no other is given."""
    return spark.createDataFrame(LABELLED, "url string, verdict string")


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    ``rules`` are (verdict, host/path); a rule fits its host and all subdomains where the path starts
    with its path, the longest wins, then the first in code-point order. URLs without a rule are
    blocked if the regression's log-odds are LEAST_SCORE or more. Null URLs and those without ``://`` have an
    empty host and path and are judged by the offset. Rows are judged one by one, repeated ones
    alike; other columns are not read.
    """
    weights, offset = train(labelled_table(pages.sparkSession) if labelled is None else labelled)
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    order = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    none = F.lit(None).cast("string")
    rule = F.coalesce(*[F.when(_fits(r, F.col("host"), F.col("path")), F.lit(r)) for _, r in order], none)
    says = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for v, r in order], none)
    rows = rows.withColumns({"rule": rule, "b": buckets(F.col("host"), F.col("path"))})
    total = F.aggregate("b", F.lit(0.0), lambda s, b: s + F.get(table, b))
    score = F.lit(offset) + total / F.sqrt(F.greatest(F.size("b"), F.lit(1)))
    learned = F.when(F.round(score, 9) >= LEAST_SCORE, BLOCK).otherwise(ALLOW)
    return rows.select("page_id", "host", "path", "rule", F.coalesce(says, learned).alias("verdict"))
