"""Language of whole texts by a linear-chain conditional random field over their words.

Words of code-switched text are labelled by features of their own (affixes, character n-grams, membership in
lexicons) and learned transitions between labels; forward-backward gives each word's distribution over
languages, and a text's language is the one with the largest sum over its letters.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.llm.shingles import in_pieces

UND = "und"
SLOTS = 1 << 16
_EDGE = string.punctuation + string.digits + "«»“”„‘’…–—¿¡·•"


def core(word: str) -> str:
    """The word as the features see it: lower case, without digits and common marks at its ends; empty without a letter."""
    c = word.strip(_EDGE).lower()
    return c if c.isalpha() or any(map(str.isalpha, c)) else ""


def _slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of many distinct words, flat, and each word's count of them.

    Affixes of one to three characters and all n-grams of two and three characters of ^word$; a hash of the
    place (start, inside, end) and the characters picks one of SLOTS weights.
    """
    marked = ["^" + w + "$" for w in words]
    n = np.fromiter(map(len, marked), np.int64, len(marked))
    flat = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.cumsum(n) - n
    word = np.repeat(np.arange(len(words)), n)
    pos = np.arange(len(flat)) - at[word]
    left = n[word] - pos
    slots, owner = [], []
    h = np.zeros(len(flat), np.uint64)
    for k in (1, 2, 3, 4):
        h = h * np.uint64(0x100000001B3)
        h[: len(flat) - k + 1] += flat[k - 1 :] * np.uint64(0x9E3779B97F4A7C15)
        whole = left >= k
        edge = np.where(pos == 0, 1, np.where(left == k, 2, 0))
        use = whole & ((edge > 0) if k in (1, 4) else True)  # four with its mark: affixes of three
        key = (h[use] + edge[use].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) * np.uint64(0xBF58476D1CE4E5B9)
        slots.append((key >> np.uint64(48)).astype(np.int64) % SLOTS)
        owner.append(word[use])
    slots, owner = np.concatenate(slots), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return slots[order], np.bincount(owner, minlength=len(words))


class Model:
    """Labels, slot weights, lexicons (word to label shares), lexicon weights, transitions and start scores."""

    def __init__(self, labels: list[str], lexicon: dict[str, np.ndarray]):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights, self.lexicon_weight = np.zeros((SLOTS, n)), np.zeros((n, n))
        self.transition, self.start = np.zeros((n, n)), np.zeros(n)
        self.forget()

    def forget(self) -> None:
        """Empty the table of words met: their scores and letters."""
        self.memo, self.table, self.letters = {}, np.zeros((0, len(self.labels)), np.float32), np.zeros(0, np.float32)

    def __getstate__(self) -> dict:
        n = len(self.labels)
        return self.__dict__ | {"memo": {}, "table": np.zeros((0, n), np.float32), "letters": np.zeros(0, np.float32)}

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of the labels for many distinct words (cores); a word without letters scores nothing."""
        slots, size = _slots(words)
        begin = np.cumsum(size) - size
        out = np.add.reduceat(self.weights[slots], begin) / np.maximum(size, 1)[:, None] if len(words) else np.zeros((0, len(self.labels)))
        known = [k for k, w in enumerate(words) if w in self.lexicon]
        if known:
            out[known] += np.array([self.lexicon[words[k]] for k in known]) @ self.lexicon_weight
        out[[not w for w in words]] = 0.0
        return out

    def rows(self, texts: list[list[str]], most: int = 200_000) -> np.ndarray:
        """Per word of all texts its row in the table of emissions; new words are added, the table is bounded."""
        if len(self.memo) > most:
            self.forget()
        memo = self.memo
        new = [w for w in set().union(*texts) if w not in memo]
        if new:
            base = len(memo)
            cores = [core(w) for w in new]
            kinds: dict[str, int] = {}
            at = [kinds.setdefault(c, len(kinds)) for c in cores]
            self.table = np.concatenate([self.table, self.emissions(list(kinds)).astype(np.float32)[at]])
            count = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in new]
            self.letters = np.concatenate([self.letters, np.array(count, np.float32)])
            memo.update(zip(new, range(base, base + len(new)), strict=True))
        return np.fromiter(map(memo.__getitem__, chain.from_iterable(texts)), np.int64)


def forward_backward(model: Model, scores: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of every word of all sequences (laid end to end), the summed pair marginals, and log partitions.

    Sequences advance together, longest first, a step for all that are long enough; exact for any length.
    """
    n, k = len(length), len(model.labels)
    order = np.argsort(-length, kind="stable")
    at = (np.cumsum(length) - length)[order]
    size = length[order]
    alive = np.searchsorted(-size, -np.arange(size[0] if n else 0), "left")  # sequences longer than t
    kind = scores.dtype
    step = np.exp(model.transition - model.transition.max()).astype(kind)
    begin = np.exp(model.start - model.start.max()).astype(kind)
    emit = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    alpha, beta, norm = np.empty_like(emit), np.empty_like(emit), np.ones(len(emit), kind)
    now = None
    for t, m in enumerate(alive):
        i = at[:m] + t
        now = emit[i] * (begin if t == 0 else now[:m] @ step)
        c = now.sum(1)
        now /= c[:, None]
        alpha[i], norm[i] = now, c
    now = np.ones((0, k), kind)
    for t in range(len(alive) - 1, -1, -1):
        m = alive[t]
        i = at[:m] + t
        fresh = np.ones((m, k), kind)
        if len(now):
            j = i[: len(now)] + 1
            fresh[: len(now)] = (emit[j] * now / norm[j][:, None]) @ step.T
        now = fresh
        beta[i] = now
    pair = np.zeros((k, k))
    follows = np.ones(len(emit), bool)
    follows[np.cumsum(length) - length] = False
    j = np.flatnonzero(follows)
    if len(j):
        pair = (alpha[j - 1].T @ (emit[j] * beta[j] / norm[j][:, None])) * step
    return alpha * beta, pair, norm


Chain = tuple[list[str], list[int]]


def switched(chains: list[Chain], share: float, rng: np.random.Generator) -> list[Chain]:
    """Chains of (words, labels) of which `share`, drawn in pairs, exchange all that follows a drawn word, so that labels
    change within a chain as in code-switched text. Every word stays, once, with its label; no chain becomes empty."""
    out = list(chains)
    order = rng.permutation(len(chains)).tolist()
    for a, b in zip(order[0::2], order[1::2]):
        if rng.random() < share:
            (u, x), (v, y) = chains[a], chains[b]
            i, j = int(rng.integers(1, len(u) + 1)), int(rng.integers(1, len(v) + 1))
            out[a], out[b] = (u[:i] + v[j:], x[:i] + y[j:]), (v[:j] + u[i:], y[:j] + x[i:])
    return out


def fit(
    texts: list[str], langs: list[str], chunk: int = 40, rounds: int = 4, rate: float = 0.5, batch: int = 256, seed: int = 5, lexicon_words: int = 4000,
    switching: float = 0.5,
) -> Model:
    """A field from texts with one language each, all words of a text taking its language as their label.

    Lexicons hold, of each language, the words met most, with their smoothed shares over languages. Texts are cut
    into chains of `chunk` words, whole texts in all; in each round another draw of `switching` of the chains is joined
    with others at a word, so that transitions are learned from chains within which the language changes as well as from
    those in which it lasts. AdaGrad on the log-likelihood's gradient, which forward-backward gives.
    """
    labels = sorted(set(langs))
    where = {x: i for i, x in enumerate(labels)}
    words = [[core(w) for w in t.split()] for t in texts]
    counts: dict[str, np.ndarray] = {}
    for ws, x in zip(words, langs, strict=True):
        for w, c in Counter(ws).items():
            counts.setdefault(w, np.zeros(len(labels)))[where[x]] += c
    total = np.maximum(sum(counts.values(), np.zeros(len(labels))), 1)
    lexicon = {}
    for i in range(len(labels)):
        for w in sorted((w for w in counts if w and counts[w][i] >= 3), key=lambda w: (-counts[w][i], w))[:lexicon_words]:
            share = (counts[w] + 0.01) / total
            lexicon[w] = share / share.sum()
    model = Model(labels, lexicon)
    whole = [(ws[a : a + chunk], [where[x]] * len(ws[a : a + chunk])) for ws, x in zip(words, langs, strict=True) for a in range(0, len(ws), chunk)]
    rng = np.random.default_rng(seed)
    state = {n: np.full_like(getattr(model, n), 1e-3) for n in ("weights", "lexicon_weight", "transition", "start")}
    for _ in range(rounds if len(labels) > 1 else 0):
        chains = switched(whole, switching, rng)
        for idx in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // batch)):
            part = [chains[i] for i in idx]
            length = np.array([len(c) for c, _ in part])
            kinds: dict[str, int] = {}
            row = np.array([kinds.setdefault(w, len(kinds)) for c, _ in part for w in c])
            names = list(kinds)
            marginal, pair, _ = forward_backward(model, model.emissions(names)[row], length)
            label = np.array([y for _, ys in part for y in ys])
            delta = -marginal
            delta[np.arange(len(label)), label] += 1
            delta[[not names[r] for r in row]] = 0
            by_kind = np.zeros((len(names), len(labels)))
            np.add.at(by_kind, row, delta)
            slots, size = _slots(names)
            grad = np.zeros_like(model.weights)
            np.add.at(grad, slots, np.repeat(by_kind / np.maximum(size, 1)[:, None], size, 0))
            held = [k for k, w in enumerate(names) if w in lexicon]
            lex = np.array([lexicon[names[k]] for k in held]).T @ by_kind[held] if held else np.zeros_like(model.lexicon_weight)
            first = np.cumsum(length) - length
            follows = np.setdiff1d(np.arange(len(label)), first)
            truth = np.zeros_like(pair)
            np.add.at(truth, (label[follows - 1], label[follows]), 1)
            start = delta[first].sum(0)
            for name, g in (("weights", grad), ("lexicon_weight", lex), ("transition", truth - pair), ("start", start)):
                state[name] += g * g
                setattr(model, name, getattr(model, name) + rate * g / np.sqrt(state[name]))
    return model


def learned(docs: DataFrame, sample: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = 5) -> Model | None:
    """A field from a bounded sample of labelled rows: of every language about an equal part of `sample` texts but at
    least `least` where it has them, those least by hash of the id; at most the larger of `sample` and `least` times
    the languages. Null languages or texts teach nothing; without rows, None."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("text is not null and lang is not null")
    # ids alone compete for the sample; the chosen texts follow in one more scan
    keys = rows.select("lang", F.xxhash64("id").alias("h"), "id").distinct()
    sizes = [(r["lang"], r["count"]) for r in keys.groupBy("lang").count().collect()]
    part = max(least, sample // max(1, len(sizes)))
    # of a large language only hashes under a bound meet in one task: four times the part and 60 more are expected
    # under it, so that fewer than the part are by chance only (under 1e-20)
    bound = docs.sparkSession.createDataFrame([(x, min(1.0, (4 * part + 60) / n)) for x, n in sizes], "lang string, bound double")
    low = keys.join(F.broadcast(bound), "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("bound"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    picks = [(r["id"], r["lang"]) for r in low.withColumn("k", rank).where(F.col("k") <= part).collect()]
    if not picks:
        return None
    chosen = docs.sparkSession.createDataFrame(picks, rows.select("id", "lang").schema)
    same = rows.join(F.broadcast(chosen), (rows["id"].eqNullSafe(chosen["id"])) & (rows["lang"] == chosen["lang"]))
    got = same.groupBy(rows["id"], rows["lang"]).agg(F.min("text").alias("text")).orderBy(F.xxhash64("id"), "id", "lang").collect()
    texts, langs = [r["text"] for r in got], [r["lang"] for r in got]
    return fit(texts, langs) if texts else None


def identified(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, spans) of every whole text, by its words alone.

    score: the predicted language's share of the letters, each word spread over languages by its marginals.
    spans: runs of words (from, to, lang) whose likeliest label is the same. und with score 0 and no spans if
    the text is null or has no letter. Repeated rows are labelled alike, null ids kept; other columns are not read.
    """
    field = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Model = field.value
        for pdf in batches:
            texts = pdf.pop("t").tolist()
            for a, b in in_pieces(texts, 5_000_000):
                words = [(t or "").split() for t in texts[a:b]]
                length = np.array([len(w) for w in words], np.int64)
                pred, score, spans = [UND] * (b - a), np.zeros(b - a), [[] for _ in words]
                some = np.flatnonzero(length)
                if m is not None and len(some):
                    rows = m.rows(words)
                    letters = m.letters[rows].astype(np.float64)
                    marginal, _, _ = forward_backward(m, m.table[rows], length[some])
                    best = marginal.argmax(1)
                    begin = np.cumsum(length[some]) - length[some]
                    mass = np.add.reduceat(marginal * letters[:, None], begin)
                    change = np.flatnonzero(np.diff(best, prepend=-1))
                    change = np.union1d(change, begin)
                    end = np.append(change[1:], len(best))
                    text_of = np.searchsorted(begin, change, "right") - 1
                    for c, e, k in zip(change.tolist(), end.tolist(), text_of.tolist(), strict=True):
                        spans[some[k]].append((c - int(begin[k]), e - int(begin[k]), m.labels[best[c]]))
                    for k, i in enumerate(some):
                        total = mass[k].sum()
                        if total > 0:
                            y = int(mass[k].argmax())
                            pred[i], score[i] = m.labels[y], min(1.0, float(mass[k, y] / total))
                        else:
                            spans[i] = []
                yield pd.DataFrame({"id": pdf["id"].iloc[a:b].array, "lang_pred": pred, "score": score, "spans": spans})

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("t")).mapInPandas(run, f"id {kind}, lang_pred string, score double, spans array<struct<begin:int,end:int,lang:string>>")
    return out.withColumnRenamed("id", id_col)
