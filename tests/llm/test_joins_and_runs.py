"""Set join, spelling variants and periodic runs against brute force, and on nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, cls string, n long, head int, id long, runs int"


def brute_runs(words, least=24, exponent=3):
    out, n = {}, len(words)
    for p in range(1, n // exponent + 1):
        s = 0
        while s + p < n:
            e = s
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e - s + p >= max(least, exponent * p):
                out.setdefault((s, e + p - s), p)
            s = max(e, s) + 1
    return sorted((s, n, p) for (s, n), p in out.items())


@pytest.mark.parametrize("least,exponent", [(24, 3), (6, 2), (1, 3), (9, 4)])
def test_runs_of_small_sequences(least, exponent):
    from cohortmill.llm.runs import runs_of

    rng = random.Random(least)
    for k in range(400):
        letters = rng.choice([1, 2, 3, 8])
        s = [rng.randrange(letters) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            block = [rng.randrange(letters + 2) for _ in range(rng.randrange(1, 9))]
            s += (block * rng.randrange(2, 12))[: rng.randrange(1, 70)] + [rng.randrange(letters) for _ in range(rng.randrange(5))]
        assert runs_of(np.array(s, np.int64), least, exponent) == brute_runs(s, least, exponent), (k, s)


def test_branching_squares_are_all_squares_that_end():
    from cohortmill.llm.runs import branching_squares

    rng = random.Random(1)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 40))] + [-1]
        place, period, _ = branching_squares(np.array(s))
        want = {(i, p) for p in range(1, len(s)) for i in range(len(s) - 2 * p) if s[i : i + p] == s[i + p : i + 2 * p] and s[i + p] != s[i + 2 * p]}
        assert set(zip(place.tolist(), period.tolist(), strict=True)) == want


def test_runs_query_against_brute_force(spark):
    """The registered query on the whole small table, altered texts included."""
    from cohortmill.llm.catalog import queries

    got = {r.doc_id: r for r in queries()["op13_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    with_runs = 0
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w) if n < 3000 or h % 10 == 0 else None
        r = got[d.doc_id]
        if runs is None:
            continue
        gone = {i for s, m, p in runs for i in range(s + p, s + m)}
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        with_runs += bool(runs)
        assert r.n_runs == len(runs) and r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
        assert (r.start, r.length, r.period, r.exponent_milli) == (*(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
    assert len(got) == len(docs) and with_runs > 10


def test_runs_edges(spark):
    from cohortmill.llm.runs import periodic_runs

    long = "lorem ipsum dolor " * 30_000
    rows = [(1, None, "x", 1, 1, 1, 1), (2, "", "x", 1, 1, 1, 1), (None, "a b " * 30, "x", 1, 1, 1, 1), (3, long, "x", 1, 1, 1, 1), (3, long, "x", 1, 1, 1, 1), (4, " \n ", "x", 1, 1, 1, 1), (5, "no no " * 11 + "no", "x", 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = collections.defaultdict(list)
    for r in periodic_runs(docs).collect():
        got[r.doc_id].append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == got[2] == got[4] == [(0, [], "")] and got[None] == [(30, [(0, 30, 1)], "a b")]
    assert got[3] == 2 * [(90_000, [(0, 90_000, 3)], "lorem ipsum dolor")] and got[5] == [(23, [], " ".join(["no"] * 23))]
    assert periodic_runs(docs.limit(0)).count() == 0


def _apart(a, b):
    """Whether one inserted, deleted or replaced letter tells a from b."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_groups(counts, ratio=2):
    near = {w: [v for v in counts if _apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        top = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top is not None and counts[top] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], form[w], root, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def test_variants_of_made_up_words(spark):
    """Words over few letters, so that grams grow long, repeat within words and all words have many near ones."""
    from cohortmill.llm.spelling import near_words, variant_groups

    rng = random.Random(2)
    for letters, size in (("ab", 4), ("abc", 5), ("aé÷ÿz", 6)):
        words = {"".join(rng.choice(letters) for _ in range(rng.randrange(size, size + 4))) for _ in range(300)}
        counts = {w: rng.choice([1, 1, 2, 3, 5, 9, 40, 200]) for w in words}
        frame = spark.createDataFrame(list(counts.items()), "word string, n long")
        got = {r.word: (r.n, r.form, r.root, r.n_near, r.form_n) for r in variant_groups(frame).collect()}
        assert got == brute_groups(counts)
        pairs = {(r.a, r.b) for r in near_words(frame)[0].collect()}
        assert {frozenset(p) for p in pairs} == {frozenset(p) for p in itertools.combinations(counts, 2) if _apart(*p)} and len(pairs) == len({frozenset(p) for p in pairs})


def test_affected_grams_bound_every_edit():
    from cohortmill.llm.spelling import affected, grams_of

    rng = random.Random(3)
    for _ in range(500):
        frequent = {"".join(rng.choice("ab\x02") for _ in range(rng.choice([2, 3]))) for _ in range(8)}
        w = "".join(rng.choice("ab") for _ in range(rng.randrange(4, 9)))
        g = grams_of(w, frequent, 4)
        i, c = rng.randrange(len(w)), rng.choice("abc")
        for v in (w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c):
            common = sum((collections.Counter(g) & collections.Counter(grams_of(v, frequent, 4))).values())
            assert common >= len(g) - affected(g) >= 1


def test_variants_edges(spark):
    from cohortmill.llm.spelling import variant_groups

    rows = [("house", 3, "x"), ("house", 7, "x"), ("hause", 5, "x"), ("hxuse", 10, "x"), (None, 4, "x"), ("mouse", None, "x"), ("abc", 9, "x"), ("abd", 1, "x"), ("", 3, "x"), ("a" * 20_000, 2, "x"), ("a" * 20_001, 4, "x"), ("ho\x02se", 99, "x")]
    words = spark.createDataFrame(rows, "word string, n int, form string")
    got = {r.word[:9]: (r.n, r.form and r.form[:9], r.root[:9], r.n_near, r.form_n) for r in variant_groups(words).where("length(word) <> 20001").collect()}
    assert got["house"] == (10, None, "house", 2, None) and got["hause"] == (5, "house", "house", 2, 10)  # ties: the smallest
    assert got["hxuse"] == (10, None, "hxuse", 2, None) and got["abc"] == (9, None, "abc", 0, None) and got["ho\x02se"][3] == 0
    assert got["a" * 9] == (2, "a" * 9, "a" * 9, 1, 4) and len(got) == 8
    assert variant_groups(words.limit(0)).count() == 0
    with pytest.raises(ValueError):
        variant_groups(words, ratio=1)


def _sets(texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    return [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()) for w in words]


def brute_components(texts, width, percent):
    sets, root = _sets(texts, width), list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def test_keys_of_similar_sets_meet():
    """Sets over tokens of all frequencies: two similar ones always have a key in common."""
    from cohortmill.llm.setjoin import combination_keys

    rng = np.random.default_rng(5)
    tokens = rng.integers(1, 2**62, 600).astype(np.uint64)
    df = np.concatenate([rng.integers(2, 6, 200), rng.integers(6, 20, 200), rng.integers(20, 90, 200)])
    def keys(s, own, percent):
        order = s[np.lexsort((tokens[s], df[s]))]
        return set(combination_keys(df[order], tokens[order], len(s) + own, percent, 5, 20).tolist())

    met = 0
    for _ in range(3000):
        percent, size = int(rng.choice([50, 60, 80, 90, 100])), int(rng.choice([2, 5, 9, 20, 64, 130, 300]))
        a = rng.choice(600, size, replace=False)
        drop, add = rng.integers(0, max(1, int(size * (1 - percent / 100))) + 1, 2)
        b = np.union1d(a[drop:], rng.choice(600, add, replace=False))
        own = int(rng.integers(0, 3))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= percent * (len(a) + len(b) + own - common):
            met += 1
            small = keys(a, own, percent) & keys(b, 0, percent)
            assert small or (size + own == len(b) == common), (percent, size)
    assert met > 500


@pytest.mark.parametrize("width,percent,frequent", [(3, 90, (32, 1024)), (3, 90, (2, 4)), (2, 60, (4, 30)), (5, 80, (8, 50))])
def test_set_join_of_large_groups(spark, width, percent, frequent):
    """Variants of a text that link in chains, texts of one template that don't link, short texts and copies; tokens are
    indexed by pairs and by triples from low frequencies on."""
    from cohortmill.llm.setjoin import jaccard_components

    rng = random.Random(width)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(40)}"
        texts.append(" ".join(t))
    texts += [" ".join(base[:60] + [f"u{rng.randrange(30)}" for _ in range(20)]) for _ in range(60)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(14))) for _ in range(80)] + texts[:5]
    want = brute_components(texts, width, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=width, percent=percent, pairs_from=frequent[0], triples_from=frequent[1]).collect()}
    assert [got[i] for i in range(len(texts))] == want and len({c for _, c in want}) > 5


def test_set_join_edges(spark):
    from cohortmill.llm.setjoin import jaccard_components

    long, kind = "lorem ipsum dolor sit amet consetetur " * 9000, DOCS
    rows = [(3, "One two THREE four", "x", 1, 1, 1, 1), (2, "one two three four", "x", 1, 1, 1, 1), (2, "one two three four", "x", 1, 1, 1, 1), (2, "something else entirely here", "x", 1, 1, 1, 1), (4, None, "x", 1, 1, 1, 1), (5, "", "x", 1, 1, 1, 1), (6, " \n", "x", 1, 1, 1, 1), (None, "one two three four", "x", 1, 1, 1, 1), (7, "a b", "x", 1, 1, 1, 1), (8, "A b", "x", 1, 1, 1, 1), (9, long, "x", 1, 1, 1, 1), (10, long + "end", "x", 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, kind).repartition(3)
    got = collections.defaultdict(set)
    out = jaccard_components(docs).collect()
    for r in out:
        got[r.doc_id].add((r.n_shingles, r.component_id))
    assert len(out) == len(rows) and got[3] == {(2, 2)} and got[2] == {(2, 2)} and got[None] == {(2, None)}
    assert got[4] == {(0, 4)} and got[5] == {(0, 5)} and got[6] == {(0, 6)} and got[7] == got[8] == {(1, 7)}
    assert got[9] == {(6, 9)} and got[10] == {(7, 10)}
    assert jaccard_components(docs.limit(0)).count() == 0
