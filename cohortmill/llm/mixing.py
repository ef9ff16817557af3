"""Mixing sources to target weights: iterative proportional fitting of token weights, then a calibrated draw.

Native DataFrame functions throughout. Documents are summed to cells of (source, language, topic); the
cells are raked until their token weights meet the three target marginals; a document's probability is its
cell's raked weight over its own (the factor) times one scale, at most 1. The scale comes from a token budget or a
share of the tokens to keep, so that a rare cell's large factor decides about that cell alone.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.session import dropped, written

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
#: Default targets: each category's token share to this power, rescaled; under 1 evens the mix out.
TEMPERED = {"source": 0.85, "lang": 0.7, "topic": 0.9}
#: The share of tokens that the registered query and the pipeline keep in expectation.
KEPT_SHARE = 0.5


def tokens_of(text: Column) -> Column:
    """Words of the text, the unit of weight; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A topic by what the whole text holds; first match wins."""
    return (
        F.when(text.rlike(r"(?i)\blicen[sc]e"), "legal")
        .when(text.rlike(r"https?://|[{};]|\w = \""), "technical")
        .when(text.rlike(r"\w@\w+\.|\(\d{3}\) \d{3}-"), "contact")
        .when(text.rlike(r" \| | \* "), "tabular")
        .when(tokens >= 1000, "long form")
        .when(tokens >= 100, "article")
        .otherwise("short form")
    )


def _category(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(NONE))


def _described(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, topic: Column | None) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.withColumn("__tokens", tokens_of(text))
    t = topic if topic is not None else topic_of(text, F.col("__tokens"))
    return rows.withColumns({"__source": _category(F.col(f"`{source_col}`")), "__lang": _category(F.col(f"`{lang_col}`")), "__topic": _category(t)})


def _target(m: str, target: dict[str, float] | float) -> Column:
    """A category's target from its tokens, not yet normalised: a given share, or the token share to a power."""
    if isinstance(target, dict):
        pairs = [x for k, v in target.items() for x in (F.lit(k), F.lit(float(v)))]
        return F.coalesce(F.element_at(F.create_map(*pairs), F.col(m)), F.lit(0.0)) if pairs else F.lit(0.0)
    return F.pow(F.col("tokens").cast("double"), F.lit(float(target)))


def raked(cells: DataFrame, targets: dict | None = None, tolerance: float = 1e-9, rounds: int = 200) -> DataFrame:
    """cells(source, lang, topic, tokens, docs) with factor, raked weight over tokens, and deviation, the largest difference
    of a category's share from its target that the last round met, the same on each row; cells without tokens are left out.

    Iterative proportional fitting: a cell's factor is the product of one multiplier for each of its categories. A
    round sets the multipliers of one margin after the other, so that its categories' shares are their targets under the
    multipliers of the other two, until no share was off by `tolerance` in a whole round, or the largest difference changes
    no more, or after `rounds`, of which a warning tells. Targets of categories that hold no tokens are left out and the
    others rescaled. All categories are raked. However many cells there are, each step is one aggregation of the same written
    cells, summed before they are shuffled, and writes a table of a row a category.
    """
    spark = cells.sparkSession
    targets = {**TEMPERED, **(targets or {})}
    start, start_path = written(cells.where("tokens > 0"), "cells")
    whole = float(start.agg(F.sum("tokens")).first()[0] or 0)
    by, at = {}, {}
    for m in MARGINS:
        margin = start.groupBy(m).agg(F.sum("tokens").alias("tokens")).select(m, _target(m, targets[m]).alias("t"))
        norm = margin.agg(F.sum("t")).first()[0]
        by[m], at[m] = written(margin.select(m, (F.col("t") / F.lit(norm)).alias("t"), F.lit(1.0).alias(f"x_{m}"), F.lit(None).cast("double").alias("off")), "rake")
    done, worst = 0, None
    while done < rounds:
        for m in MARGINS:
            others = [o for o in MARGINS if o != m]
            weights = start
            for o in others:
                weights = weights.join(by[o].select(o, f"x_{o}"), o)
            share = F.sum(F.col("tokens") / F.lit(whole) * F.col(f"x_{others[0]}") * F.col(f"x_{others[1]}")).alias("share")
            step = weights.groupBy(m).agg(share).join(by[m], m)
            x = F.when(F.col("share") > 0, F.col("t") / F.col("share")).otherwise(F.lit(0.0))
            old = at[m]
            by[m], at[m] = written(step.select(m, "t", x.alias(f"x_{m}"), F.abs(F.col("share") * F.col(f"x_{m}") - F.col("t")).alias("off")), "rake")
            dropped(spark, old)
        done += 1
        before, worst = worst, by["source"].select("off").union(by["lang"].select("off")).union(by["topic"].select("off")).agg(F.max("off")).first()[0]
        # targets that contradict each other are never met: rounds come to repeat themselves
        if worst is None or worst < tolerance or (before is not None and abs(before - worst) < tolerance / 1000):
            break
    else:
        warnings.warn(f"after {done} rounds a category's share is still {worst:.3g} from its target", stacklevel=2)
    out = start
    for m in MARGINS:
        out = out.join(by[m].select(m, f"x_{m}"), m)
    factor = F.col("x_source") * F.col("x_lang") * F.col("x_topic")
    out, _ = written(out.select(*MARGINS, "tokens", "docs", (F.col("tokens") / F.lit(whole) * factor).alias("w"), F.lit(worst).cast("double").alias("deviation"), factor.alias("factor")), "raked")
    dropped(spark, start_path, *at.values())
    return out


def _scale(cells: DataFrame, budget: float) -> float:
    """c with which the sum of tokens * least(1, c * factor) is `budget`; infinite if all documents of positive factor hold no more.

    The sum is concave and piecewise linear in c, so Newton's steps from below reach c after finitely many,
    each of which brings one row of sums to the driver.
    """
    weight = F.col("tokens") * F.col("factor")
    tokens, weights = cells.where("factor > 0").agg(F.sum("tokens"), F.sum(weight)).first()
    if tokens is None or tokens <= budget:
        return math.inf
    c = budget / weights
    while True:
        sure = F.col("factor") * F.lit(c) >= 1
        full, rest = cells.agg(F.sum(F.when(sure, F.col("tokens"))), F.sum(F.when(~sure, weight))).first()
        step = (budget - (full or 0)) / rest if rest else c
        if step <= c * (1 + 1e-12):
            return c
        c = step


def mixed(
    docs: DataFrame, targets: dict | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    topic: Column | None = None, seed: int = 1, budget: int | None = None,
    share: float | None = None,
) -> DataFrame:
    """docs with n_tokens, topic, factor, probability and sampled (columns of these names are replaced).

    targets: per margin a dict of shares or a power of the token share. With a budget of tokens, or a share of
    all tokens, probability is least(1, c * factor) with the one c that makes the expected tokens meet it: cells
    under 1 keep their raked proportions, cells at 1 are kept whole and fall short of theirs. With neither,
    probability is the factor over the largest one, so that expected token shares are exactly the raked ones and
    the rarest cell decides how much of the rest stays. The draw is a hash of seed, id and text, so that a lost task
    repeats it. Texts are read whole, however long; columns of docs that begin with two underscores and bear a name used
    here (__tokens, __source, __lang, __topic) must not occur: sampled_documents() renames all. Null categories are the category (none); texts without tokens (null, empty) have
    probability 0; repeated rows share one draw; an empty table gives an empty result.
    """
    rows = _described(docs, id_col, text_col, source_col, lang_col, topic)
    made = ("n_tokens", "topic", "factor", "probability", "sampled")
    cells = rows.groupBy(*[F.col(f"__{m}").alias(m) for m in MARGINS]).agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("docs"))
    factors = raked(cells, targets)
    if budget is None and share is None:
        most = factors.agg(F.max("factor")).first()[0]
        factors = factors.withColumn("probability", F.col("factor") / F.lit(most))
    else:
        tokens = factors.agg(F.sum("tokens")).first()[0] or 0
        c = _scale(factors, min(x for x in (budget, None if share is None else share * tokens) if x is not None))
        factors = factors.withColumn("probability", F.when(F.col("factor") > 0, F.least(F.lit(1.0), F.col("factor") * F.lit(c))).otherwise(F.lit(0.0)))
    factors, _ = written(factors.select(*[F.col(m).alias(f"__c_{m}") for m in MARGINS], F.col("factor").alias("__factor"), F.col("probability").alias("__p")), "factors")
    # few cells are broadcast by Spark itself; many meet the documents in a join whose large keys adaptive execution splits
    hit = rows.join(factors, [F.col(f"__{m}") == F.col(f"__c_{m}") for m in MARGINS], "left")
    p = F.when(F.col("__tokens") > 0, F.coalesce("__p", F.lit(0.0))).otherwise(F.lit(0.0))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), 11) / F.lit(float(1 << 53))
    out = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    return hit.select(*out, F.col("__tokens").alias("n_tokens"), F.col("__topic").alias("topic"), F.col("__factor").alias("factor"), p.alias("probability"), (u < p).alias("sampled"))


def sampled_documents(docs: DataFrame, targets: dict | None = None, **how) -> DataFrame:
    """docs that the calibrated draw keeps, with their own columns."""
    names = {c: f"__in_{k}" for k, c in enumerate(docs.columns)}
    cols = {k: names[how.pop(k, d)] for k, d in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"), ("lang_col", "lang"))}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return mixed(inner, targets, **cols, **how).where("sampled").select(*[F.col(n).alias(c) for c, n in names.items()])
