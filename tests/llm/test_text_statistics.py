"""Importance resampling, line dedup and collocations against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import _bloom, importance, line_dedup, oracles, phrases, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("name", ["op11_importance", "op12_line_dedup", "op13_collocations"])
def test_query_equals_sql(spark, sf_dir, name):
    import oracle

    assert oracle.same(spark, sf_dir, queries.queries()[name], oracles.oracle_sql()[name]) > 0


# ---- importance resampling


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def features(text):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abZ9 \n.éß世 ", max_size=60)), max_size=6), st.integers(1, 40))
def test_buckets_are_those_of_the_strings(texts, limit):
    got = collections.defaultdict(collections.Counter)
    for first, at, left, grams in importance.buckets(texts, limit):
        for row in range(len(at) - 1):
            for i in range(at[row], at[row + 1]):
                for k, g in enumerate(grams):
                    if left[i] > k:
                        got[first + row][int(g[i])] += 1
    for row, text in enumerate(texts):
        assert got[row] == collections.Counter(map(bucket, features(text)))


def test_shifts_of_any_length():
    rng = random.Random(5)
    for n in (0, 1, 31, 32, 63, 64, 65, 127, 1000, 70_001):
        a, b = rng.randbytes(20), rng.randbytes(n)
        crc = importance.shift(np.array([zlib.crc32(a)], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(b))
        assert int(crc[0]) == zlib.crc32(a + b)
    text = "x" * 100_000 + " " + "y" * 33 + " z"
    got = sorted(int(g[i]) for _, _, left, grams in importance.buckets([text]) for k, g in enumerate(grams) for i in range(len(left)) if left[i] > k)
    assert got == sorted(map(bucket, features(text)))


def brute_resample(docs, target, percent, least):
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x)) for texts in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    rows = []
    for i, text in docs:
        weight = sum(gain(bucket(f)) for f in features(text))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words_of(text)), len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    return rows, [(r[0], r[4]) for r in able[: percent * len(able) // 100]]


def test_resample_equals_brute_force(spark):
    rng = random.Random(7)
    vocabulary = ["alpha", "Beta", "gamma", "delta9", "été", "x" * 70]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randrange(30))) for i in range(120)] + [(200, None), (201, ""), (None, text(25)), (None, None), (5, text(25)), (5, text(25)), (300, "word " * 400_000)]
    docs += [docs[3]] * 3
    target = [text(9) for _ in range(10)] + [None, ""]
    df = spark.createDataFrame([(i, t, 1, 2, "r") for i, t in docs], "doc_id long, text string, score int, n_words int, rank string").repartition(5)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = importance.resample(df, goal, percent=30, least_words=10).collect()
    rows, drawn = brute_resample(docs, target, 30, 10)
    assert sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got), key=repr) == sorted(map(tuple, rows), key=repr)
    picked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in picked] == list(range(1, len(drawn) + 1)) and [(r.doc_id, r.score) for r in picked] == drawn
    assert importance.resample(df.limit(0), goal).count() == 0
    bare = importance.resample(df, goal.limit(0), percent=100, least_words=0).collect()
    assert sorted(r["rank"] for r in bare) == list(range(1, len(docs) + 1))


# ---- line dedup


def brute_lines(texts, least_docs, least_length=1, keep_first=False):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = collections.defaultdict(set)
    split = [(t or "").split("\n") for t in texts]
    for i, lines in enumerate(split):
        for line in lines:
            held[key(line)].add(i)
    out = []
    for i, lines in enumerate(split):
        kept, seen = [], set()
        for line in lines:
            k = key(line)
            gone = len(k) >= least_length and len(held[k]) >= least_docs
            if gone and keep_first and i == min(held[k]) and k not in seen:
                gone = False
            seen.add(k)
            if not gone:
                kept.append(line)
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_texts(seed, n):
    rng = random.Random(seed)
    common = ["Home | About", "  home | about\t", "é", "世界", "", " ", "\x0bx\x0c", "A" * 5000, "ÀB", "àb"]
    line = lambda: rng.choice(common) if rng.random() < 0.5 else f"line {rng.randrange(400)}"
    return ["\n".join(line() for _ in range(rng.randrange(12))) for _ in range(n)] + [None, "", "\n", "\n\n", "only\r\nonly\r", "q\n" * 50_000]


@pytest.mark.parametrize("most_sent", [500_000, 0])
@pytest.mark.parametrize("keep_first", [False, True])
def test_lines_equal_brute_force(spark, keep_first, most_sent):
    texts = line_texts(3, 150)
    df = spark.createDataFrame([(i, t, "s", 7) for i, t in enumerate(texts)], "doc_id long, text string, `key` string, N_Lines int").repartition(6)
    for least_docs, least_length in ((10, 1), (2, 2), (1, 1)):
        out = line_dedup.drop_repeated_lines(df, least_docs, least_length, keep_first, most_sent=most_sent)
        assert out.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()}
        assert [got[i] for i in range(len(texts))] == brute_lines(texts, least_docs, least_length, keep_first)


def test_lines_of_repeated_and_null_ids(spark):
    texts = ["same\nown 1", "same\nown 2", "SAME \nown 3", "same"]
    df = spark.createDataFrame(list(zip([1, 1, None, None], texts)), "doc_id long, text string").coalesce(1)
    assert [r.text for r in line_dedup.drop_repeated_lines(df, 4).collect()] == ["own 1", "own 2", "own 3", ""]
    assert [r.text for r in line_dedup.drop_repeated_lines(df, 5).collect()] == texts
    assert [r.n_dropped for r in line_dedup.drop_repeated_lines(df, 4, keep_first=True).collect()] == [0, 1, 1, 1]
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.drop_repeated_lines(df, least_length=0)


def test_filters_miss_no_repeat(spark):
    rng = random.Random(4)
    keys = [rng.getrandbits(64) for _ in range(4000)]
    counts = collections.Counter(keys[rng.randrange(len(keys))] for _ in range(6000))
    rows = [(k - (1 << 63),) for k in counts.elements()]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long").repartition(70)
    of = lambda batch: iter([batch.column(0).to_numpy().view(np.uint64)])
    signed = np.array([k - (1 << 63) for k in counts], np.int64).view(np.uint64)
    n = np.array(list(counts.values()))
    for words in (_bloom.words_for(6000), 1024 * 16):
        twice, once = _bloom.build(df, of, words), _bloom.build(df, of, words, repeats=False)
        assert _bloom.holds(twice, signed)[n > 1].all() and _bloom.holds(once, signed).all()
        assert _bloom.holds(twice, signed)[n == 1].mean() < 0.1
    assert not _bloom.build(df.limit(0), of, 1024 * 16).any()


# ---- collocations


def brute_collocations(docs, least, covered, most):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in cand.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        longer[p[i:j]] = max(longer[p[i:j]], a)
        rows = []
        for p, a in cand.items():
            if 100 * longer[p] >= covered * a:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrase_docs():
    rng = random.Random(11)
    words = ["New", "york", "city", "of", "the", "naïve", "世", "a b", "\x01x", "x", '"q"', "Z"]
    text = lambda: "".join(rng.choice(words[: rng.randrange(2, 13)]) + rng.choice([" ", " ", " ", "\t", ", ", "\n", "  "]) for _ in range(rng.randrange(60)))
    return [(rng.choice(["en", "en", "de", None, "und"]), text()) for _ in range(250)] + [("en", None), ("en", ""), (None, "..."), ("fr", "rare words only"), ("de", "New york " * 3000)]


@pytest.mark.parametrize("block, cut", [(1 << 20, 1 << 20), (50, 17)])
def test_collocations_equal_brute_force(spark, monkeypatch, block, cut):
    docs = phrase_docs()
    df = spark.createDataFrame([(l, t, 1, "k", 2) for l, t in docs], "lang string, text string, n int, `key` string, id int").repartition(5)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", block)
    monkeypatch.setattr(phrases, "SLICE", cut)
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    for least, covered, most in ((5, 80, 40), (2, 101, 10_000)):
        got = sorted(tuple(r[c] for c in names) for r in phrases.collocations(df, least, covered, most).collect())
        assert got == brute_collocations(docs, least, covered, most)


def test_collocations_of_little(spark):
    df = spark.createDataFrame([("en", "a b"), (None, None)], "lang string, text string")
    assert phrases.collocations(df).count() == 0 and phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "a b. " * 40)] * 2, "lang string, text string")).first().asDict() == {"lang": "en", "rank": 1, "phrase": "a b", "a": 80, "l": 80, "r": 80, "n": 160, "score": 1_000_000}


def test_blocks_cut_within_texts_keep_every_run():
    """What goes on in another block is counted once: plain arithmetic over the blocks of one text."""
    import pyarrow as pa

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 3

    import pyspark

    own, size, pyspark.TaskContext = pyspark.TaskContext, phrases.BLOCK_WORDS, Context
    phrases.BLOCK_WORDS, cut, phrases.SLICE = 7, phrases.SLICE, 9
    try:
        text = "a b c d. e f g h i j k l m n o p, q " * 5
        batch = pa.record_batch([pa.array(["en"]), pa.array([text])], ["lang", "text"])
        found, words = collections.Counter(), collections.Counter()
        for b in phrases._blocks([batch]):
            r = b.to_pylist()[0]
            codes = phrases._unpack(r["codes"], "<i4")
            names = [".", *r["vocab"]]
            words.update(dict(zip(r["vocab"], r["counts"])))
            for k in range(2, 5):
                for i in range(max(0, r["carry"] - k + 1), len(codes) - k + 1):
                    if all(codes[i : i + k]):
                        found[" ".join(names[c] for c in codes[i : i + k])] += 1
    finally:
        pyspark.TaskContext, phrases.BLOCK_WORDS, phrases.SLICE = own, size, cut
    want = collections.Counter()
    for piece in re.split("[.,]", text):
        w = piece.split()
        for k in range(2, 5):
            want.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    assert found == want and +words == collections.Counter(re.findall(r"\w+", text))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 2**32 - 1)] * 3), max_size=40))
def test_radix_order_sorts(rows):
    table = np.array(rows, np.uint32).reshape(-1, 3)
    order = phrases.radix_order([table[:, j] for j in range(3)])
    assert [tuple(r) for r in table[order].tolist()] == sorted(rows)


def test_repeated_run_over_batches():
    import pyarrow as pa

    keys = [bytes([i]) * 16 for i in (1, 2, 2, 2, 3)]
    batches = [pa.record_batch([pa.array([k], pa.binary()), pa.array([2])], ["key", "n"]) for k in keys] + [pa.record_batch([pa.array([], pa.binary()), pa.array([], pa.int64())], ["key", "n"])]
    got = [tuple(r.values()) for b in phrases._run_lengths(2)(batches) for r in b.to_pylist()]
    assert got == [(keys[0], 2), (keys[1], 6), (keys[4], 2)]
