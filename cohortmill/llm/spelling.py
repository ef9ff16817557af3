"""Spelling variants: words one edit apart, found by an index of variable-length grams.

A gram begins at every place of a word (with a mark at either end), has two letters, and grows while it is frequent
and shorter than `longest`. Where it ends depends on its own letters alone, so that one edit changes no gram but those
over its place: their greatest number, the word's affected-gram bound, tells how many grams two words one edit apart
must share at least, and so which of a word's rarest grams need be indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.session import dropped, importable, written

#: Marks of a word's begin and end; a word that holds one of them has no near words.
BEGIN, END = "\x02", "\x03"


def gram_dictionary(words: DataFrame, longest: int = 4, share: float = 1 / 20_000) -> dict[str, int]:
    """How often the grams of 2 to `longest` letters occur that make up more than `share` of all grams of their
    length in words(word): at most (longest - 1) / share of them, however many words there are."""
    marked = F.concat(F.lit(BEGIN), "word", F.lit(END))
    sizes = words.select(F.length("word").alias("k"), F.explode(F.sequence(F.lit(2), F.lit(longest))).alias("q"), marked.alias("m"))
    places = F.sequence(F.lit(1), F.col("k") + 3 - F.col("q"))
    grams = sizes.where("k + 2 >= q").select("q", F.explode(F.transform(places, lambda p: F.col("m").substr(p, F.col("q")))).alias("gram"))
    counts, path = written(grams.groupBy("q", "gram").count(), "grams")
    least = counts.groupBy("q").agg((F.sum("count") * share).alias("least"))
    out = {r["gram"]: r["count"] for r in counts.join(F.broadcast(least), "q").where("count > least").select("gram", "count").collect()}
    dropped(words.sparkSession, path)
    return out


def grams_of(word: str, frequent: set[str], longest: int) -> list[str]:
    """The gram at each place of the marked word: the shortest of two letters or more that is not frequent, has
    `longest` letters or reaches the end."""
    m = BEGIN + word + END
    out = []
    for p in range(len(m) - 1):
        e = p + 2
        while e < len(m) and e - p < longest and m[p:e] in frequent:
            e += 1
        out.append(m[p:e])
    return out


def affected(grams: list[str]) -> int:
    """The most grams that lie over one place: so many does one edit change at most."""
    over = [0] * (len(grams) + max(map(len, grams)) + 1)
    for p, g in enumerate(grams):
        over[p] += 1
        over[p + len(g)] -= 1
    most = now = 0
    for x in over:
        now += x
        most = max(most, now)
    return most


def _entries(words: DataFrame, counts: dict[str, int], longest: int, frequent_share: float) -> DataFrame:
    """(gram, len, word, n, pos, after, need): the rarest grams of every word, one more than an edit can change.
    after is how many grams follow in the order of rarity, need how many the word shares with a near one at least."""
    total = sum(c for g, c in counts.items() if len(g) == 2) or 1
    frequent = {g for g, c in counts.items() if len(g) < longest and c > total * frequent_share}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for word, n in zip(pdf["word"], pdf["n"], strict=True):
                grams = grams_of(word, frequent, longest)
                bound = affected(grams)
                order = sorted(range(len(grams)), key=lambda p: (counts.get(grams[p], 0), grams[p], p))
                rows += [(grams[p], len(word), word, n, p, len(grams) - 1 - i, len(grams) - bound) for i, p in enumerate(order[: bound + 1])]
            yield pd.DataFrame(rows, columns=["gram", "len", "word", "n", "pos", "after", "need"])

    return words.mapInPandas(run, "gram string, len int, word string, n long, pos int, after int, need int")


def near_words(words: DataFrame, longest: int = 4, share: float = 1 / 20_000, frequent_share: float = 1 / 2_000) -> tuple[DataFrame, list[str]]:
    """(a, na, b, nb): all pairs of words(word, n) that one inserted, deleted or replaced letter tells apart, each once,
    a the longer or, of one length, the greater; and paths of the tables behind it.

    Pairs meet in the lists of the grams that both index, with lengths and places at most one apart and enough grams
    behind to share what both need; Levenshtein's distance verifies them. Words must be distinct and of `longest`
    letters at least, as shorter ones may share nothing with a near one.
    """
    entries, path = written(_entries(words, gram_dictionary(words, longest, share), longest, frequent_share), "entries")
    side = lambda s: [F.col(c).alias(f"{s}_{c}") for c in ("word", "n", "pos", "after", "need", "len")]
    x = entries.select("gram", *side("x"), F.explode(F.array("len", F.col("len") - 1)).alias("len"))
    y = entries.select("gram", *side("y"), "len")
    near = (F.abs(F.col("x_pos") - F.col("y_pos")) <= 1) & (F.least("x_after", "y_after") + 1 >= F.greatest("x_need", "y_need"))
    near = near & ((F.col("x_len") > F.col("y_len")) | (F.col("x_word") > F.col("y_word"))) & (F.levenshtein("x_word", "y_word", 1) == 1)
    met = x.join(y.hint("merge"), ["gram", "len"]).where(near)
    pairs, pairs_path = written(met.select(F.col("x_word").alias("a"), F.col("x_n").alias("na"), F.col("y_word").alias("b"), F.col("y_n").alias("nb")).distinct(), "near")
    return pairs, [path, pairs_path]


def roots(forms: DataFrame) -> tuple[DataFrame, str]:
    """(word, root) of forms(word, form), no circles: forms are followed to the last. Every round doubles the steps."""
    spark = forms.sparkSession
    at, path = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("__up"))
        further, further_path = written(at.join(up.hint("merge"), "root", "left").select("word", F.coalesce("__up", "root").alias("root"), F.col("__up").isNotNull().alias("moved")), "roots")
        dropped(spark, path)
        at, path = further.select("word", "root"), further_path
        if further.where("moved").isEmpty():
            return at, path


def variant_groups(words: DataFrame, word_col: str = "word", n_col: str = "n", ratio: float = 2, longest: int = 4) -> DataFrame:
    """Per distinct word of words: (word, n, form, root, n_near, form_n).

    Words are near if one inserted, deleted or replaced code point tells them apart. form is the near word of
    largest n (ties: the smallest in code-point order) if its n is at least ratio (over 1) times the word's, else null;
    root is where forms lead to, the word itself if it has none.

    n of repeated rows is summed up; null words and null counts don't count. Words under `longest` code points, or with
    one of the two marks, stay by themselves. Other columns are not read. An empty table gives an empty result.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1, or forms may lead in circles")
    spark = words.sparkSession
    importable(spark)
    own, own_path = written(words.select(F.col(word_col).cast("string").alias("word"), F.col(n_col).cast("long").alias("n")).where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    fit = (F.length("word") >= longest) & ~F.col("word").rlike(f"[{BEGIN}{END}]")
    pairs, paths = near_words(own.where(fit), longest)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")).union(pairs.select("b", "a", "na"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    told = own.join(best.hint("merge"), "word", "left").withColumn("form_n", -F.col("best.k"))
    has = F.col("form_n") >= F.col("n") * ratio
    told, told_path = written(told.select("word", "n", F.when(has, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("form_n")).alias("form_n")), "forms")
    root, _ = roots(told.where("form is not null").select("word", "form"))
    dropped(spark, own_path, *paths)
    return told.join(root.hint("merge"), "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
