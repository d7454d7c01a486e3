"""The rule of the stage `copies`: five words, similarity of 0.8, against brute force on the sets of shingles."""

import random

import numpy as np

from schemaloom.llm import simhash


def shingles(text, words=5):
    found = text.lower().split()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(rng, text, n):
    found = text.split()
    for i in rng.sample(range(len(found)), n):
        found[i] = f"x{rng.randrange(10**6)}"
    return " ".join(found)


def kept(spark, given):
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    return {r.doc_id for r in simhash.representatives(df).collect()}


def test_close_fingerprints_below_the_similarity_all_stay(spark):
    rng = random.Random(1)
    texts = []
    while len(texts) < 12:
        base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
        other = changed(rng, base, 11)
        if similarity(base, other) < 0.8 and (simhash.fingerprint(base, 5) ^ simhash.fingerprint(other, 5)).bit_count() <= 7:
            texts += [base, other]
    texts += ["a b c d e f a b c d e", "a b c d e f a b c d e f a b c d e f g h i"]
    assert kept(spark, list(enumerate(texts))) == set(range(len(texts)))


def test_one_stays_of_each_component_by_brute_force(spark):
    rng = random.Random(2)
    texts = ["", None, "one two", "one two", "One  TWO\n"]
    for n in (20, 60, 200):
        for _ in range(4):
            base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
            family = [base]
            for _ in range(14):  # of earlier members, so that chains and outliers of a dense group occur
                family.append(changed(rng, rng.choice(family), rng.choice([0, 1, n // 50, n // 40, n // 25])))
            texts += family
    rng.shuffle(texts)
    root = list(range(len(texts)))
    links = 0
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if similarity(a or "", b or "") >= 0.8:
                links += 1
                root = [root[j] if r == root[i] else r for r in root]
    want = {min(i for i, r in enumerate(root) if r == x) for x in set(root)}
    assert links > 200 and 15 < len(want) < len(texts) - 50
    assert kept(spark, list(enumerate(texts))) == want


def test_a_large_group_of_near_copies_makes_no_pairs(spark):
    """Copies that differ from a base at many places: many pairs of copies are under the similarity, all are one group."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    given = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(150)] = f"x{rng.randrange(9000)}"
        given.append((i + 10, " ".join(words)))
    given.append((1, " ".join(f"o{rng.randrange(4000)}" for _ in range(150))))
    df = spark.createDataFrame(given, "doc_id long, text string")
    sets = {d: frozenset(simhash.shingles(t, 5).tolist()) for d, t in given}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert sorted(r.doc_id for r in simhash.representatives(df).collect()) == sorted(d for d in root if root[d] == d)


def roots(given, least=0.8):
    sets = {d: frozenset(simhash.shingles(t, 5).tolist()) for d, t in given}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted(d for d in root if root[d] == d)


def group(n, least, most, seed=4):
    """Copies of a base with so many words changed: they share keys, and most pairs are not similar."""
    rng = random.Random(seed)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150))
    return [(i, changed(rng, base, rng.randrange(least, most))) for i in range(n)]


def test_fingerprints_link_what_shares_no_band(spark):
    """The operator's own candidates: one band of 64 functions is shared by none of the pairs."""
    rng = random.Random(6)
    given = []
    while len(given) < 16:
        base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
        pair = [base, changed(rng, base, 3)]
        prints = [simhash.simhash(np.unique(simhash.shingles(t, 5))) for t in pair]
        if similarity(*pair) >= 0.8 and (prints[0] ^ prints[1]).bit_count() <= 7 and not {*simhash.band_keys(simhash.shingles(pair[0], 5), 1, 64)} & {*simhash.band_keys(simhash.shingles(pair[1], 5), 1, 64)}:
            given += [(len(given) + i, t) for i, t in enumerate(pair)]
    df = spark.createDataFrame(given, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(df, bands=1, rows=64).collect()) == roots(given) == list(range(0, 16, 2))


def test_a_group_that_shares_keys_takes_no_turns(spark, monkeypatch):
    calls, found = [], simhash.connected_components
    monkeypatch.setattr(simhash, "connected_components", lambda links: calls.append(1) or found(links))
    given = group(150, 5, 9)
    df = spark.createDataFrame(given, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(df).collect()) == roots(given) and len(calls) == 1


def test_large_keys_are_split_without_loss(spark):
    for given in (group(120, 2, 6), group(200, 2, 20)):
        df = spark.createDataFrame(given, "doc_id long, text string")
        want = roots(given)
        for block in (2, 25):
            assert sorted(r.doc_id for r in simhash.representatives(df, block=block).collect()) == want


def test_a_search_joins_what_pairs_join():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 40):
        base = rng.integers(-(1 << 62), 1 << 62, 60)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0, 0.05, 0.3]), rng.integers(-(1 << 62), 1 << 62, 60), base)) for _ in range(n)]
        label = rng.integers(0, max(1, n // 2), n)
        alike = [(i, j) for i in range(n) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8]

        def joined(links, label=label):
            of = label.copy()
            for a, b in links:
                of[of == of[a]] = of[b]
            return {frozenset(np.flatnonzero(of == x).tolist()) for x in of}

        got = simhash._similar(label, np.concatenate(sets), np.array([len(s) for s in sets]), 0.8)
        assert {(max(p), min(p)) for p in got} <= set(alike) and len(got) < n and joined(got) == joined(alike)
