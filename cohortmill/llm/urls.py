"""URL filters: rules by host and path first, gradient-boosted trees on lexical features for the rest.

Native DataFrame and SQL functions throughout; the trees are those of Spark's own DataFrame library.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: (verdict, rule): a host, then a path that the url's path starts with.
RULES = [(ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/")]
#: Words in hosts by which urls are labelled bad where no reviewed labels are at hand.
BAD_WORDS = "pills|pharm|viagra|casino|bets?|poker|adult|porn|xxx|escort|loan|replica|torrent|warez"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMERIC = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "params", "entropy", "host_entropy", "vowels", "longest_label", "secure", "fragment"]
FEATURES = [*NUMERIC, "suffix_rate", "suffix_seen"]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, else null; of equally long ones a blocking one.

    A rule fits its host and all its subdomains where the path starts with the rule's path. Rules are a
    short list held in the expression.
    """
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        same = (host == h) | host.endswith("." + h)
        fits.append(F.when(same & path.startswith("/" + p), F.struct(F.lit(len(rule)).alias("size"), F.lit(verdict == BLOCK).alias("blocks"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not fits:
        return F.lit(None).cast("struct<size:int,blocks:boolean,rule:string,verdict:string>")
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def _entropy(text: Column) -> Column:
    """Bits a character of the whole text."""
    n = F.greatest(F.length(text), F.lit(1))
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(F.filter(each, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def featured(urls: DataFrame, url_col: str) -> DataFrame:
    """urls with host, path, suffix (the last label of the host) and the lexical features; all defined for null."""
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    host, path = F.col("host"), F.col("path")
    count = lambda c, p: F.length(c) - F.length(F.regexp_replace(c, p, ""))
    n = F.greatest(F.length(url), F.lit(1))
    rows = urls.withColumns({"host": host_of(F.col(f"`{url_col}`").cast("string")), "path": path_of(F.col(f"`{url_col}`").cast("string"))})
    made = {
        "length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": count(path, "/"),
        "labels": count(host, r"\."),
        "digit_ratio": count(url, "[0-9]") / n,
        "host_digits": count(host, "[0-9]"),
        "hyphens": count(host, "-"),
        "params": F.when(url.contains("?"), count(F.substring_index(url, "?", -1), "&") + 1).otherwise(0),
        "entropy": _entropy(url),
        "host_entropy": _entropy(host),
        "vowels": count(host, "[aeiou]") / F.greatest(F.length(host), F.lit(1)),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)),
        "secure": F.lower(url).startswith("https").cast("int"),
        "fragment": url.contains("#").cast("int"),
    }
    return rows.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in made.items()} | {"suffix": F.substring_index(host, ".", -1)})


def labelled_urls(pages: DataFrame, sample: int = 5000, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(url, label) of up to `sample` distinct urls, the least by hash: bad (1) if a word of the host is on the fixed list.

    Stands in for reviewed labels; the words are no feature, so the trees learn shapes and suffixes.
    """
    u = pages.select(F.col(f"`{url_col}`").cast("string").alias("url")).where("url is not null").distinct().orderBy(F.xxhash64("url"), "url").limit(sample)
    return u.withColumn("label", host_of(F.col("url")).rlike(rf"(^|[.-])({BAD_WORDS})([.-]|$)").cast("double"))


def train(labelled: DataFrame, trees: int = 20, depth: int = 4, seed: int = 3) -> tuple[PipelineModel | None, DataFrame]:
    """The boosted trees (None without labelled urls) and the suffix statistics of labelled urls (url, label),
    whose number the caller bounds.

    A suffix's rate is its smoothed share of bad urls, that of the whole sample weighing as ten urls.
    """
    rows = featured(labelled.where("label is not null").repartitionByRange(1, "url"), "url")
    mean = rows.agg(F.avg("label")).first()[0]
    rate = (F.sum("label") + F.lit(10.0 * (mean or 0.0))) / (F.count("*") + 10)
    stats = rows.groupBy("suffix").agg(rate.alias("suffix_rate"), F.log1p(F.count("*")).alias("suffix_seen"))
    if mean is None:
        return None, stats
    x = _with_suffixes(rows, stats).select("label", *FEATURES)
    trees_ = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, featuresCol="features", labelCol="label", maxBins=64)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees_]).fit(x), stats


def _with_suffixes(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """stats has at most as many rows as the bounded sample, hence the broadcast."""
    return rows.join(F.broadcast(stats), "suffix", "left").withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(0.5)), "suffix_seen": F.coalesce("suffix_seen", F.lit(0.0))})


def judged(pages: DataFrame, model: tuple[PipelineModel | None, DataFrame], rules: list[tuple[str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Per row: (id_col, host, path, rule, score, verdict); the rule's verdict, else block where the trees' score reaches the threshold.

    Null urls and urls without :// have empty host and path, fit no rule and are scored like others;
    without labelled urls the score is 0; repeated rows are judged alike; columns of pages other than the two are not read.
    """
    trees, stats = model
    rows = featured(pages.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").cast("string").alias("__url")), "__url")
    scored = trees.transform(_with_suffixes(rows, stats)) if trees else rows
    hit = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    score = vector_to_array("probability")[1] if trees else F.lit(0.0)
    return scored.select(F.col(id_col), "host", "path", hit["rule"].alias("rule"), score.alias("score"), F.coalesce(hit["verdict"], F.when(score >= threshold, F.lit(BLOCK)).otherwise(F.lit(ALLOW))).alias("verdict"))
