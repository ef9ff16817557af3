"""SentencePiece encoding and decoding for merge-type vocabularies: a score-ordered agenda of adjacent pairs.

A text is cut before each space mark that follows another character, where no piece of the vocabulary can
reach across, and each word between two characters that no piece holds side by side (a word and the comma after it).
Merges never cross such a cut, so a text's ids are those of its parts in order, and parts recur, so that
most are encoded once; each part not met before goes through the agenda.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.shingles import in_pieces

SPACE = "▁"
#: Up to this many characters the agenda is a plain list, which is quicker for a few pairs; beyond that a heap.
SHORT = 32
NEVER = float("inf")
#: Words that a worker remembers (some 200 MB).
REMEMBERED = 1_000_000


class PieceModel:
    """A vocabulary of scored pieces read from a sentencepiece model of kind BPE with byte fallback."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        if lib.normalize(" a  b ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}b{SPACE}":
            raise ValueError("only models that keep spaces, add the leading space mark and change nothing else are served")
        size = lib.vocab_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.rank = {p: -lib.get_score(i) for p, i in self.ids.items()}  # least first
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        if len(self.byte_ids) < 256:
            raise ValueError("the vocabulary has no byte fallback")
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.size = size
        self.raw = [bytes([self.bytes_of[i]]) if i in self.bytes_of else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.whole = any(SPACE in p.lstrip(SPACE) for p in self.ids if len(p) > 1)  # a piece holds an inner space: no cut is safe

    _WORD = re.compile(f"{SPACE}+[^{SPACE}]*")

    def words(self, text: str) -> list[str]:
        """The text's words, each without one leading space mark."""
        if not text:
            return []
        marked = text.replace(" ", SPACE)
        if self.whole:
            return [marked]
        parts = marked.split(SPACE)
        return [w[1:] for w in self._WORD.findall(SPACE + marked)] if "" in parts else parts

    def chunks(self, text: str) -> list[str]:
        return [SPACE + w for w in self.words(text)]

    _RUN = re.compile(r"[^\W_]+|[\W_]+")

    def parts(self, word: str) -> list[str]:
        """The word cut where letters and other characters meet that no piece holds side by side: no merge can cross there."""
        if word.isalnum():
            return [word]
        runs, out, start, at = self._RUN.findall(word), [], 0, 0
        for left, right in zip(runs, runs[1:]):
            at += len(left)
            if left[-1] + right[0] not in self.pairs:
                out.append(word[start:at])
                start = at
        out.append(word[start:])
        return out

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        return [self.agenda(c) for c in chunks]

    def agenda(self, chunk: str) -> list[int]:
        """Ids of one chunk: the best-scored adjacent pair merges first, the leftmost of equals, until none is a piece."""
        symbols = self._merged_short(chunk) if len(chunk) <= SHORT else self._merged(chunk)
        try:
            return [self.ids[x] for x in symbols]
        except KeyError:  # a character that is no piece
            return [i for x in symbols for i in ([self.ids[x]] if x in self.ids else [self.byte_ids[b] for b in x.encode()])]

    def _merged_short(self, chunk: str) -> list[str]:
        """The agenda holds the score of each pair of neighbours, in their order."""
        score, symbols = self.rank.get, list(chunk)
        agenda = [score(p, NEVER) for p in map(add, symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            symbols[i] = both = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = score(symbols[i - 1] + both, NEVER)
            if i < len(agenda):
                agenda[i] = score(both + symbols[i + 1], NEVER)
        return symbols

    def _merged(self, chunk: str) -> list[str]:
        """The agenda is a heap of pairs; those whose symbols have changed meanwhile are passed over."""
        rank, n = self.rank, len(chunk)
        symbols = list(chunk)
        before, after = list(range(-1, n)), list(range(1, n + 1))
        queue = [(rank[p], i, i + 1, p) for i, p in enumerate(map(add, symbols, symbols[1:])) if p in rank]
        heapify(queue)
        while queue:
            _, left, right, both = heappop(queue)
            if after[left] != right or symbols[left] + symbols[right] != both:
                continue  # one of the two has merged with another meanwhile
            symbols[left], symbols[right] = both, ""
            far = after[left] = after[right]
            after[right] = -1
            before[far] = left
            near = before[left]
            if near >= 0 and (p := symbols[near] + both) in rank:
                heappush(queue, (rank[p], near, left, p))
            if far < n and (p := both + symbols[far]) in rank:
                heappush(queue, (rank[p], left, far, p))
        return [x for x in symbols if x]

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.agenda(c)]

    def decode(self, ids: list[int]) -> str:
        """The characters of some ids, space marks as spaces, the leading one dropped; runs of byte pieces as UTF-8."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Memory(dict):
    """Values of keys met lately, others by learn(key). Half of `most` keys are young; when they are so many, they become the
    old ones, and old ones not met since go: what is met again and again is never learned twice. Keys of over `longest`
    characters are not kept."""

    def __init__(self, learn, most: int, longest: int):
        super().__init__()
        self.learn, self.most, self.longest, self.old = learn, most, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.pop(key, None)
        if value is None:
            value = self.learn(key)
        if len(key) <= self.longest:
            if 2 * len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class WordMemo:
    """Ids of recurring words and parts of words, as bytes of uint32, remembered from one call to the next: about `most`
    words (some 200 MB) and `composed` parts of words that are not their first; long ones never."""

    def __init__(self, model: PieceModel, most: int = REMEMBERED, composed: int = 150_000, longest: int = 64):
        self.model, self.longest = model, longest
        self.known = Memory(self._word, most, longest)  # by word, without its leading space mark
        self.inner = Memory(self._part, composed, longest)  # by part of a word that is not its first
        self.fresh: list[tuple[str, bytes]] | None = None  # words learned, while they are noted down

    def _part(self, part: str) -> bytes:
        return array("I", self.model.agenda(part)).tobytes()

    def _word(self, word: str) -> bytes:
        first, *rest = self.model.parts(word)
        if rest:
            ids = self.known[first] + b"".join(map(self.inner.__getitem__, rest))
        else:
            ids = self._part(SPACE + first)
        if self.fresh is not None:
            self.fresh.append((word, ids))
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Per text its ids."""
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, self.model.words(t))), np.uint32) for t in texts]

    def checked(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """encode(), and per text whether the library agrees: it encodes every word that these texts make us learn; ids of
        words known before were the library's when they were learned. A text's ids are those of its words."""
        self.fresh = []
        ids, fresh = self.encode(texts), self.fresh
        self.fresh = None
        library = self.model.library
        theirs = library.encode([w or "a " for w, _ in fresh], num_threads=1)  # the empty word stands after another only
        theirs = [lib if w else lib[len(library.encode("a")) :] for (w, _), lib in zip(fresh, theirs, strict=True)]
        odd = {w for (w, own), lib in zip(fresh, theirs, strict=True) if array("I", lib).tobytes() != own}
        for w in odd:  # it is learned and found odd again wherever it stands
            self.known.pop(w, None)
            self.known.old.pop(w, None)
        return ids, [odd.isdisjoint(self.model.words(t)) for t in texts] if odd else [True] * len(texts)


_MEMOS: dict[bytes, WordMemo] = {}


def memo_of(proto: bytes, most: int = REMEMBERED) -> WordMemo:
    """One model a worker with what it remembers, about `most` words, however many batches it serves."""
    key = hashlib.sha256(proto).digest() + most.to_bytes(8, "big")
    if key not in _MEMOS:
        forget()
        _MEMOS[key] = WordMemo(PieceModel(proto), most)
    return _MEMOS[key]


def forget() -> None:
    """A worker that goes on to other work lets its models and words go: Spark keeps workers from stage to stage."""
    if _MEMOS:
        _MEMOS.clear()
        gc.collect()  # a memo and its memories refer to one another


def token_counts(memo: WordMemo, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: its number of tokens, how many of them are byte pieces, and the entropy of its tokens in bits."""
    model, ids, n = memo.model, memo.encode(texts), len(texts)
    total = np.fromiter(map(len, ids), np.int64, n)
    if not total.sum():
        return np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    token = np.concatenate(ids).astype(np.int64)
    doc = np.repeat(np.arange(n), total)
    is_byte = np.zeros(model.size, bool)
    is_byte[list(model.bytes_of)] = True
    is_byte[model.byte_ids[10]] = False  # the line end has no other piece
    key, count = np.unique(doc * model.size + token, return_counts=True)
    of_doc = key // model.size
    p = count / total[of_doc]
    return total, np.bincount(doc, weights=is_byte[token], minlength=n).astype(np.int64), np.bincount(of_doc, weights=-p * np.log2(p), minlength=n)


def encoded(docs: DataFrame, model_path: str, text_col: str = "text", keep_ids: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """docs' columns but the text, plus n_tokens, ids_sha256, decoded_sha256, agrees and, with keep_ids, ids (array<int>).

    Whole texts, no begin or end ids, no sampling; decoding is ours too. In each Arrow batch the library encodes every
    word that the worker has not met (WordMemo.checked) and decodes every whole text; agrees is false where ids or
    decoded text differ. Null
    texts count as empty: no ids, both digests those of the empty string. Repeated rows give repeated rows; an
    empty table an empty one; columns of docs named like an output are replaced. The model is broadcast from
    the driver (under 1 MB); a worker remembers about `remembered` words, and a text only adds its own size.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())
    made = ["n_tokens", "ids_sha256", "decoded_sha256", "agrees"] + ["ids"] * keep_ids
    rest = [c for c in docs.columns if c not in {*made, text_col}]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = memo_of(proto.value, remembered)
        model, library, number = memo.model, memo.model.library, [str(i) for i in range(memo.model.size)]
        for pdf in batches:
            texts = [t or "" for t in pdf.pop(text_col)]
            for a, b in in_pieces(texts, 1_000_000):
                rows = []
                for found, same in zip(*memo.checked(texts[a:b]), strict=True):
                    ids = found.tolist()
                    text = model.decode(ids)
                    row = [len(ids), hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), same and text == library.decode(ids)]
                    rows.append(row + [ids] * keep_ids)
                yield pdf.iloc[a:b].assign(**{m: [r[k] for r in rows] for k, m in enumerate(made)})

    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "agrees": "boolean", "ids": "array<int>"}
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest] + [f"{m} {kinds[m]}" for m in made])
    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).cast("string").alias(text_col)).mapInPandas(run, schema)


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
