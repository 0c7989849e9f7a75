import collections
import random
import re

import pytest

from gleaner.llm import _shingles as S
from gleaner.llm import near_dedup as N
from gleaner.llm._graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())
    return collections.Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else collections.Counter()


def brute_classes(docs, threshold=0.8):
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, t, shingles(t) if t is not None else None) for i, t in docs]
    for n, (i, t, a) in enumerate(sets):
        for j, u, b in sets[:n]:
            if t is None or u is None:
                continue
            total = sum((a | b).values())
            if t == u or (total and sum((a & b).values()) >= threshold * total):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in docs}


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def corpus(seed):
    rng = random.Random(seed)
    docs = []
    for _ in range(12):
        base = words(rng, rng.choice([3, 5, 40, 300]))
        docs.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 12)):
                own[rng.randrange(len(own))] = words(rng, 1)[0]
            docs.append(" ".join(own).upper() if rng.random() < 0.2 else ", ".join(own))
    shared = words(rng, 60)
    docs += [" ".join(words(rng, 30) + shared + words(rng, 30)) for _ in range(15)]
    docs += [" ".join(shared + words(rng, rng.randrange(9, 16))) for _ in range(25)]  # similarity around the threshold
    docs += ["repeat this line again and again " * n for n in (10, 11, 30, 31)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], DOCS)
    rows = N.near_duplicates(df).collect()
    assert {r.id: r.class_id for r in rows} == brute_classes(docs)
    assert all(r.kept == (r.id == r.class_id) for r in rows)


def test_signatures_estimate_weighted_overlap():
    import numpy as np

    rng, errors = random.Random(5), []
    for _ in range(60):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([8, 60, 400]))]
        other = list(base)
        for _ in range(len(other) // 6):
            other[rng.randrange(len(other))] = f"x{rng.random()}"
        texts = [" ".join(base + base[: len(base) // 2]), " ".join(other)]
        hashes, at = S.shingle_hashes(*S.word_hashes(texts), 2)
        sig = N.signatures(hashes, at, 512)
        sets = [S.occurrences(hashes[a:b]) for a, b in zip(at[:-1], at[1:])]
        a, b = (shingles(t, 2) for t in texts)
        assert S.overlap(*sets) == pytest.approx(sum((a & b).values()) / sum((a | b).values()))
        errors.append((sig[0] == sig[1]).mean() - S.overlap(*sets))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_signature_does_not_depend_on_neighbours_in_the_batch():
    rng = random.Random(1)
    texts = [" ".join(words(rng, n)) for n in (1, 5, 900, 30)]
    alone = [N.signatures(*S.shingle_hashes(*S.word_hashes([t]), 5))[0] for t in texts]
    together = N.signatures(*S.shingle_hashes(*S.word_hashes(texts), 5))
    assert all((a == b).all() for a, b in zip(alone, together))


def test_defined_cases(spark):
    long = " ".join(words(random.Random(2), 30_000))
    rows = [
        (3, None), (4, None), (5, ""), (6, ""), (7, "%%% ###"), (8, "%%% ###"), (9, "one two"), (2, "One, two!"), (10, "one two three"), (11, long), (12, long + " tail"), (None, "one two"), (11, long), (None, None),
    ]
    df = spark.createDataFrame([(i, t, "keep", 1, "x") for i, t in rows], "doc_id long, text string, kept string, uid int, signature string")
    got = N.near_duplicates(df).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 8
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r.id].add(r.class_id)
    assert (by_id[3], by_id[4], by_id[6], by_id[8], by_id[9], by_id[10], by_id[12], by_id[11]) == ({3}, {4}, {5}, {7}, {2}, {10}, {11}, {11})
    assert by_id[None] == {2, None}
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 8
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_one_large_family_does_not_list_its_pairs(spark):
    rng = random.Random(4)
    base = words(rng, 120)
    docs = []
    for i in range(400):
        own = list(base)
        for _ in range(rng.randrange(8)):
            own[rng.randrange(len(own))] = words(rng, 1)[0]
        docs.append((i, " ".join(own)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], DOCS)
    assert {r.id: r.class_id for r in N.near_duplicates(df).collect()} == brute_classes(docs)


def test_blocks_of_a_family_below_the_threshold(spark, monkeypatch):
    """A family whose members are not linked to each other but for a few, over many small blocks."""
    monkeypatch.setattr(N, "BLOCK", 7)
    monkeypatch.setattr(N, "TEXT_ROWS", 9)
    monkeypatch.setattr(N, "TEXT_WEIGHT", 1500)
    monkeypatch.setattr(N, "TILE", 4)
    rng = random.Random(11)
    base, docs = words(rng, 110), []
    for i in range(90):
        own = list(base)
        for j in rng.sample(range(110), 3 + i % 4):
            own[j] = words(rng, 1)[0]
        docs.append((i, " ".join(own)))
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], DOCS)
    assert {r.id: r.class_id for r in N.near_duplicates(df).collect()} == brute_classes(docs)


def test_ids_that_are_no_integers_and_clashing_names(spark):
    long = " ".join(words(random.Random(2), 50))
    df = spark.createDataFrame([("7", long, "a", 1), ("x", long, "b", 2), ("3", "other", None, 3), (None, None, "c", 4)], "doc_id string, text string, __uid string, _gone int")
    assert sorted((r.id or -1, r.class_id or -1) for r in N.near_duplicates(df).collect()) == [(-1, -1), (-1, 7), (3, 3), (7, 7)]
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r._gone for r in kept.collect()) == [1, 3, 4]


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[x] == find(x) for x in got) and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
