"""Quality rules from tokeniser fertility: characters per token, byte-fallback share and token entropy.

Text that a public vocabulary takes apart unlike the good text of its language (symbols, capitals,
broken encodings: too few characters a token; one word over and over: too little entropy for its
length) is rejected by bands, which are learned from documents labelled good.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.pieces import REMEMBERED, memo_of, public_model, token_counts
from cohortmill.llm.shingles import in_pieces, mix64, word_hashes
from cohortmill.operators.quantiles import exact_quantiles

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
BASE = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}
FERTILITY = {"n_tokens": "long", "n_byte_tokens": "long", "token_entropy": "double"}
MEASURES = ("chars_per_token", "byte_share", "entropy_ratio")
#: Where no labelled document of a language or script is known.
GENERAL = {"chars_per_token": (0.5, 20.0), "byte_share": (-0.1, 0.6), "entropy_ratio": (0.3, 1.1)}
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Thai", "Hangul", "Hiragana", "Katakana", "Han")


def base_counts(texts: list[str]) -> dict[str, np.ndarray]:
    """Per whole text: words, characters in words, symbols, repeated lines, and words in repeated 3-word windows."""
    words, at = word_hashes(texts, lower=False)
    n = np.diff(at)
    repeat = np.zeros(len(texts), np.int64)
    if len(words) >= 3:
        p = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
        doc = np.repeat(np.arange(len(texts)), n)
        window = words[:-2] * p[0] + words[1:-1] * p[1] + words[2:] * p[2]
        inside = doc[:-2] == doc[2:]
        key = mix64(mix64(window) + doc[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[inside]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        first = np.flatnonzero(inside)[count[back] > 1]
        hit = np.zeros(len(words), bool)
        for j in range(3):
            hit[first + j] = True
        repeat = np.bincount(doc[hit], minlength=len(texts))
    lines = []
    for t in texts:
        with_word = [x for x in t.split("\n") if x.strip(BLANKS)] if "\n" in t else ()
        lines.append(len(with_word) - len(set(with_word)))
    return {
        "n_words": n,
        "word_chars": np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": repeat,
    }


def measured(docs: DataFrame, model_path: str | None = None, text_col: str = "text", keep: list[str] | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """docs (or its columns `keep`) with the base counts and the fertility counts of each whole text.

    One pass in Arrow batches, no shuffle. Null texts count as empty: all counts 0. Columns of docs named
    like a measure are replaced. A worker remembers about `remembered` words.
    """
    with open(model_path or public_model(), "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())
    made = BASE | FERTILITY
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = memo_of(proto.value, remembered)
        for pdf in batches:
            texts = [t or "" for t in pdf["__t"]]
            for a, b in in_pieces(texts, 1_000_000):
                out = pdf.iloc[a:b].drop(columns="__t")
                total, in_bytes, entropy = token_counts(memo, texts[a:b])
                yield out.assign(**base_counts(texts[a:b]), n_tokens=total, n_byte_tokens=in_bytes, token_entropy=entropy)

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{k} {v}" for k, v in made.items()])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__t")).mapInPandas(run, schema)


def base_failed() -> Column:
    """Under 50 words, or more than half of the words in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _group(lang: Column, text: Column | None) -> Column:
    """A language code of two or three letters, else the script that most letters are of."""
    code = F.lower(lang)
    if text is None:
        script = F.lit("script:none")
    else:
        counts = [F.struct(F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")).alias("n"), F.lit(f"script:{s}").alias("s")) for s in SCRIPTS]
        script = F.greatest(*counts)["s"]
    return F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise(F.coalesce(script, F.lit("script:none")))


def _with_measures(counted: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    return counted.withColumns(
        {
            "chars_per_token": (F.col("word_chars") + F.col("n_words")) / n,
            "byte_share": F.col("n_byte_tokens") / n,
            "entropy_ratio": F.col("token_entropy") / F.log2(F.greatest(F.col("n_tokens"), F.lit(2))),
            "__size": F.least(F.floor(F.log2(n)), F.lit(20)).cast("int"),
        }
    )


def learned_bands(good: DataFrame, least: int = 40, spread: float = 1.7) -> DataFrame:
    """(grp, size, <measure>_low, <measure>_high) from counted documents labelled good, size being floor(log2(tokens)), -1 for all.

    A band reaches from the median to `spread` times the distance of the first and last percentile (and at
    least a hundredth of the median), exact ones of all documents, however they are dealt out; groups under `least` documents have none. Groups are language codes of
    at most three letters or a script, sizes at most 21, so that the table stays small on any input.
    """
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES])
    both = good.select("grp", F.explode(F.array("__size", F.lit(-1))).alias("size"), each.alias("m")).select("grp", "size", F.inline("m"))
    t = exact_quantiles(both, ["grp", "size", "measure"], "value", [0.01, 0.5, 0.99]).where(F.col("n") >= least)
    low, mid, high = (F.col("q")[i] for i in range(3))
    some = F.greatest(0.01 * mid, F.lit(0.005))
    t = t.withColumns({"low": mid - spread * F.greatest(mid - low, some), "high": mid + spread * F.greatest(high - mid, some)})
    cols = [F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{m}_{e}") for m in MEASURES for e in ("low", "high")]
    return t.groupBy("grp", "size").agg(*cols)


def judged(counted: DataFrame, labels: DataFrame | None, id_col: str = "doc_id") -> DataFrame:
    """counted (from measured(), with a column grp) plus the measures, base_failed and kept.

    Bands come from the counted documents that labels(doc_id, quality) calls good (quality 1; of repeated
    labels the lowest) and that the base rules pass; a document is held against the band of its language and
    length, else of its language, else the general band. Null ids are judged but teach nothing.
    """
    rows = _with_measures(counted)
    if labels is None:
        labels = counted.sparkSession.createDataFrame([], f"{id_col} long, quality int")
    good = labels.groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("__q")).where("__q = 1")
    taught = rows.where(~base_failed()).select(F.col(id_col).alias("__id"), "grp", "__size", *MEASURES).join(good.hint("merge"), "__id")
    bands = learned_bands(taught)
    exact, loose = bands.where("size >= 0"), bands.where("size < 0").drop("size")
    limits = [f"{m}_{e}" for m in MEASURES for e in ("low", "high")]
    exact = exact.select(F.col("grp"), F.col("size").alias("__size"), *[F.col(c).alias(f"e_{c}") for c in limits])
    loose = loose.select("grp", *[F.col(c).alias(f"l_{c}") for c in limits])
    rows = rows.join(F.broadcast(exact), ["grp", "__size"], "left").join(F.broadcast(loose), "grp", "left")
    fits = F.lit(True)
    for m in MEASURES:
        low, high = (F.coalesce(f"e_{m}_{e}", f"l_{m}_{e}", F.lit(GENERAL[m][k])) for k, e in enumerate(("low", "high")))
        fits = fits & ((F.col(m) <= high) if m == "byte_share" else (F.col(m) >= low) & (F.col(m) <= high))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & fits).drop("__size", *[f"{k}_{c}" for k in "el" for c in limits])


def quality_rules(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model_path: str | None = None) -> DataFrame:
    """Per row of docs: id, base counts, base_failed, fertility measures, kept.

    Null or empty texts have zero counts and fail the base rules; null languages fall back to the script;
    repeated rows are judged alike; extra columns are not read; an empty table gives an empty one.
    """
    from cohortmill.session import written

    text = F.col(f"`{text_col}`")
    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), text.alias(text_col), _group(F.col(f"`{lang_col}`"), text).alias("grp"))
    counted, _ = written(measured(slim, model_path, text_col, [id_col, "grp"]), "quality")
    return judged(counted, labels, id_col).drop("grp")


def kept_documents(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model_path: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """docs without the documents that the rules reject; the measures travel beside the rows, so that nothing is joined by id."""
    from cohortmill.session import written

    names = {c: f"__in_{k}" for k, c in enumerate(docs.columns)}
    text = F.col(f"`{text_col}`")
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], _group(F.col(f"`{lang_col}`"), text).alias("grp"))
    counted, _ = written(measured(rows, model_path, names[text_col], remembered=remembered), "quality")
    out = judged(counted.withColumnRenamed(names[id_col], id_col), labels, id_col).where("kept")
    return out.select(*[F.col(id_col if c == id_col else n).alias(c) for c, n in names.items()])
