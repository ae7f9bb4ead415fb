import random

import numpy as np

from dayloom.llm import ngram_join as j


def words(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()


def sets(t, k):
    w = words(t)
    return {tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set()


def brute(rows, k, num, den):
    s = {i: sets(t, k) for i, t in rows if i is not None}
    up = {i: i for i in s}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b]) and top(a) != top(b):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(s[i]), top(i)) for i in ids}


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = [rng.choice(vocabulary) for _ in range(40)]  # a passage that many documents share
    base = [rng.choice(vocabulary) for _ in range(120)]  # a large group of near copies
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35:
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        elif kind < 0.6 and texts:
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 200]))]
            if rng.random() < 0.5:
                w = w[: len(w) // 2] + common + w[len(w) // 2 :]
        texts.append(" ".join(w))
        rows.append((i, texts[-1]))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "One TWO"), (n + 4, "one two"), (n + 5, "one"), (n + 6, "é x É"), (3, texts[3]), (n + 7, "long words " * 20_000), (None, texts[0])]
    return rows


def check(spark, rows, k, num, den):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    out = j.jaccard_components(df, k, num, den).collect()
    assert len(out) == len(rows)
    truth = brute(rows, k, num, den)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == truth[r.doc_id]


def test_three_words(spark):
    check(spark, corpus(1), 3, 90, 100)


def test_five_words_lower_similarity(spark):
    check(spark, corpus(2), 5, 80, 100)


def test_everything_frequent(spark, monkeypatch):
    monkeypatch.setattr(j, "LEAST_FREQUENT", 2)
    check(spark, corpus(3, 150), 3, 90, 100)


def test_empty(spark):
    assert j.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hashes_and_bounds():
    for t in ("a b c d", "A  B\tc\nD", "x", "", None, "é ß 日本", "w " * 100, " a b c a b c a b c "):
        assert len(j.shingles(t, 3)) == len(sets(t, 3))
    assert np.array_equal(j.shingles("a B c d", 3), j.shingles(" A b\x0bc  D", 3))
    for n in range(1, 400):
        e = j.spare(n, 90, 100)
        assert e == max(x for x in range(n + 1) if 100 * (n - x) >= 90 * n)
        assert j.lead_length(n, 90, 100) >= min(n, e + 1) and 1 <= j.needed(n, 90, 100)


def test_a_doc_id_with_two_texts_links_as_either(spark):
    rng = random.Random(9)
    a, b = (" ".join(f"{k}{rng.randrange(10_000)}" for _ in range(60)) for k in "ab")
    near = lambda t: t.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, b), (5, near(a)), (6, near(b)), (7, "x y z"), (1, a), (3, b)]
    for order in (rows, rows[::-1]):
        out = j.jaccard_components(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert len(out) == 7 and {(r.doc_id, r.component_id) for r in out} == {(1, 1), (5, 1), (6, 1), (7, 7), (3, 1)}


def test_pairs_grow_with_rows_not_with_their_square(spark, monkeypatch):
    """Near copies of one short text, most of which link with nothing, and a passage in all documents."""
    rng = random.Random(21)
    base = [f"b{rng.randrange(5000)}" for _ in range(60)]
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(600):
        w = list(base) if i % 2 else [f"w{rng.randrange(3000)}" for _ in range(25)]
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(100_000)}"
        rows.append((i, " ".join(w + passage)))
    counted, inner = [], j._compare
    monkeypatch.setattr(j, "_compare", lambda pairs, *rest: (counted.append(pairs.count()), inner(pairs, *rest))[1])
    check(spark, rows, 3, 90, 100)
    assert sum(counted) < 6 * len(rows)
