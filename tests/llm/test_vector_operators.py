import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from gleaner.llm import queries, topk, vector_dedup, warc

VECTORS = "vec_id long, embedding array<float>, label int"


def unit(rng, n=24):
    v = rng.normal(size=n)
    return v / np.linalg.norm(v)


def near(rng, v, spread):
    w = v + rng.normal(size=len(v)) * spread
    return w / np.linalg.norm(w)


def vectors(seed, n=400):
    rng = np.random.default_rng(seed)
    out = [unit(rng) for _ in range(n)]
    hot = unit(rng)
    out += [near(rng, hot, 0.02) for _ in range(n // 3)]
    for v in out[: n // 8]:
        out.append(near(rng, v, 0.04))
    order = rng.permutation(len(out))
    return [(i, out[j].astype(np.float32).tolist(), 0) for i, j in enumerate(order)]


BROKEN = [(9001, None, 0), (9002, [], 0), (9003, [0.0] * 24, 0), (9004, [1.0] + [None] * 23, 0), (9005, [math.nan] * 24, 0), (9006, [math.inf] + [0.0] * 23, 0)]


def brute_links(rows, threshold=0.95):
    good = [(i, np.array(v, np.float64)) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    ids = [i for i, _ in good]
    label = {i: i for i, _, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(hit)):
            low = min(label[ids[a]], label[ids[b]])
            changed |= label[ids[a]] != low or label[ids[b]] != low
            label[ids[a]] = label[ids[b]] = low
    degree = dict.fromkeys(label, 0) | {i: int(n) for i, n in zip(ids, hit.sum(axis=1))}
    return {i: (degree[i], label[i], label[i] == i) for i in label}


@pytest.mark.parametrize("block, dense", [(2048, 0.1), (60, 0.1), (60, 0.0)])
def test_links_equal_brute_force(spark, monkeypatch, block, dense):
    """In one block a shard; with shards split level by level; with block pairs alone."""
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "DENSE", dense)
    monkeypatch.setattr(vector_dedup, "SEED_ROWS", 16)
    monkeypatch.setattr(vector_dedup, "PER_CENTRE", 64)
    rows = vectors(3) + BROKEN
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, VECTORS).withColumn("links", F.lit("clash"))).collect()
    assert {r.id: (r.n_links, r.component_id, r.kept) for r in got} == brute_links(rows)


def test_links_of_copies_and_odd_rows(spark):
    v = [1.0, 0.0, 0.0]
    rows = [(5, v, 0), (5, v, 0), (3, [2.0, 0.0, 0.0], 0), (7, [0.0, 1.0, 0.0], 0), (8, [1.0, 0.0], 0), (None, v, 0), (9, [1e-30, 0.0, 0.0], 0)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r.id or -1, r.n_links, r.component_id) for r in got) == [(-1, 4, 3), (3, 4, 3), (5, 4, 3), (5, 4, 3), (7, 0, 7), (8, 0, 8), (9, 4, 3)]
    assert vector_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_dedup.near_vectors(spark.createDataFrame(BROKEN, VECTORS)).where("n_links = 0 AND kept").count() == len(BROKEN)


def test_graph_search_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    x = np.stack([unit(rng) for _ in range(300)] + [near(rng, unit(rng), 0.01)] * 3)
    x[300:] = [near(rng, x[0], 0.03) for _ in range(3)]
    graph = vector_dedup.pruned_graph(x)
    assert graph.shape == (303, vector_dedup.DEGREE) and (graph[:, 0] >= 0).all() and not (graph == np.arange(303)[:, None]).any()
    hits = vector_dedup.range_search(x, x, graph, np.arange(303)[:, None], 0.95)
    assert [h.tolist() for h in hits] == [np.flatnonzero(x @ v >= 0.95).tolist() for v in x]


def test_owned_links_are_those_of_the_least_common_shard():
    rng = random.Random(1)
    shards = [sorted(rng.sample(range(9), rng.randint(1, 4))) for _ in range(50)]
    u, v = (np.array([rng.randrange(50) for _ in range(400)]) for _ in range(2))
    for shard in range(9):
        both = np.array([shard in shards[a] and shard in shards[b] for a, b in zip(u, v)])
        got = vector_dedup._owned(u[both], v[both], shards, shard)
        assert got.tolist() == [min(set(shards[a]) & set(shards[b])) == shard for a, b in zip(u[both], v[both])]


def test_graphs_of_a_whole_block_find_what_brute_force_finds():
    rng = np.random.default_rng(7)
    base = [unit(rng, 64) for _ in range(600)]
    x = np.stack(base + [near(rng, base[i % 60], 0.02) for i in range(1500)] + [near(rng, base[0], 0.015) for _ in range(400)])
    graph = vector_dedup.pruned_graph(x)
    entries = np.broadcast_to(vector_dedup.medoids(x), (len(x), vector_dedup.MEDOIDS))
    hits = vector_dedup.range_search(x, x, graph, np.concatenate((entries, np.arange(len(x))[:, None]), axis=1), 0.95)
    share = [len(h) / (x @ v >= 0.95).sum() for h, v in zip(hits, x)]
    assert np.mean(share) > 0.98


def test_a_low_recall_doubles_the_overlap(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(vector_dedup, "PER_CENTRE", 16)
    monkeypatch.setattr(vector_dedup, "audited_recall", lambda *a, **k: seen.append(1) or 0.0)
    with pytest.raises(RuntimeError, match="recall 0.0000"):  # and no incomplete result comes back
        vector_dedup.near_vectors(spark.createDataFrame(vectors(2, 60), VECTORS), overlap=1).count()
    assert len(seen) >= 2


# ---- top k

def brute_topk(rows, k, every):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for at, (i, q) in enumerate(good):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, x)), j) for n, (j, x) in enumerate(good) if n != at and len(x) == len(q))
            out.setdefault(i, []).append([(j, -s) for s, j in scored[:k]])
    return out


@pytest.mark.parametrize("shard, block, chain", [(4096, 4096, 4), (64, 3, 2), (16, 7, 100)])
def test_topk_equals_brute_force(spark, shard, block, chain):
    rng = random.Random(4)
    rows = vectors(5, 200) + [(800 + i, [float(rng.randrange(2)) for _ in range(24)], 0) for i in range(60)] + BROKEN
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash"))
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, shard=shard, query_block=block, chain=chain).collect()
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        mine.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert mine == {q: lists[0] for q, lists in brute_topk(rows, 10, 10).items()}


def test_topk_cases(spark):
    rows = [(0, [1.0, 2.0], 0), (0, [1.0, 2.0], 0), (None, [9.0, 9.0], 0), (1, [1.0, 2.0], 0), (2, [1.0, 2.0, 3.0], 0), (3, [1e5, 1e5], 0), (4, [0.0, 0.0], 0)]
    got = topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0).collect()
    assert len(got) == 8 and [(r.vec_id, r["rank"]) for r in got if r["rank"] == 1] == [(3, 1)] * 2
    huge = topk.top_k(spark.createDataFrame([(0, [2e6, 1.0], 0), (1, [2e6, 1.0], 0)], VECTORS), F.col("vec_id") == 0).first()
    assert huge.score == (2_000_000 * 1024) ** 2 + 1024**2
    doubles = VECTORS.replace("float", "double")
    far = spark.createDataFrame([(0, [1.0, 1.0], 0), (1, [1e300, 0.0], 0), (2, [-1e300, 5.0], 0), (3, [2.0, 0.0], 0), (4, [1e16, 0.0], 0), (5, [8e15, 8e15], 0), (6, [1.7e308, 0.0], 0)], doubles)
    got = [(r.query_id, r.vec_id, r.score) for r in topk.top_k(far.withColumn("_uid", F.lit("clash")), F.col("vec_id") % 5 == 0, shard=2).orderBy("query_id", "rank").collect()]
    most = (1 << 63) - 1
    assert got == [(0, 5, most), (0, 3, 2 * 1024 * 1024), (5, 0, most), (5, 3, most)]
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0
    assert topk.top_k(spark.createDataFrame(BROKEN[:2] + [(0, [1.0], 0)], VECTORS), F.lit(True)).count() == 0


def test_a_floor_from_another_shard_stops_the_walk():
    rng = np.random.default_rng(2)
    x = np.floor(100 * rng.normal(size=(2000, 4)))
    order, q = np.argsort(-x, axis=0, kind="stable").T, np.array([3.0, -1.0, 2.0, 0.0])
    want = sorted((-s, i) for i, s in enumerate((x @ q).tolist()))
    for floor in (want[0][0] * -1 + 1, -want[0][0], -want[3][0], -want[50][0]):
        rows, scores = topk.threshold_search(x, order, np.arange(2000), q, 10, floor=floor)
        assert list(zip(scores.tolist(), rows.tolist())) == [(-s, i) for s, i in want[:10] if -s >= floor]


def test_threshold_search_stops_early():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(4000, 3))) ** 4
    order = np.argsort(-x, axis=0, kind="stable").T
    seen = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                seen.append(len(key))
            return super().__getitem__(key)

    rows, scores = topk.threshold_search(x.view(Counting), order, np.arange(4000), np.array([1.0, 0.5, 0.2]), 5)
    want = np.argsort(-(x @ np.array([1.0, 0.5, 0.2])), kind="stable")[:5]
    assert rows.tolist() == want.tolist() and sum(seen) < 2000


# ---- WARC

PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark, tmp_path):
    big = "x" * 99 + "é"
    rows = [
        (1, "https://www.Example.com/b?x=1", "<p>one</p>"), (2, "https://example.com/a", big), (9, "https://example.com/c", big), (5, "http://org.net", big), (3, None, None), (4, "https://example.com/a", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" + "y" * 100),
        (6, "https://example.com/ü x\ny", "<p>one</p>"), (7, "https://z.org/" + "long/" * 2000, "z" * 300_000), (None, "https://n.org", big), (2, "https://example.com/a", big),
    ]
    df = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")).withColumn("size", F.lit(1))
    archives, index = f"file://{tmp_path}/archives", f"file://{tmp_path}/index"
    warc.write_archives(df, archives, file_records=4)
    warc.build_index(spark, archives, index, block_lines=3)
    look = warc.Index(spark, index)
    assert look.records(df).count() == len(rows) and look.records(df.unionByName(df)).count() == len(rows)
    got = {(r.page_id, r.record_type): r for r in look.records(df).collect()}
    import hashlib

    for i, url, html in rows:
        raw = (html or "").encode()
        revisit = html == big and i != 2
        r = got[i, "revisit" if revisit else "response"]
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), 2 if revisit else None)
        assert r.payload == (None if revisit else raw)
    urls = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    assert sorted(r.page_id for r in look.records(urls("https://example.com/a", "https://none.example")).collect()) == [2, 2, 4]
    assert [r.page_id for r in look.records(urls("https://www.example.com/b?x=1")).collect()] == [1]
    assert look.records(urls("https://none.example", "a")).count() == 0 and look.records(urls(None)).count() == 1
    assert warc.surt("https://www.Example.com/b?x=1") == "com,example,www)/b?x=1" and warc.surt(None) == ")/"
    directory = spark.read.parquet(f"{index}/directory").orderBy("first_key").collect()
    assert sum(r.n for r in directory) == len(rows) and all(r.n <= 3 for r in directory)
    for path in (tmp_path / "archives").glob("part-*"):
        assert path.read_bytes().startswith(b"WARC/1.1\r\n") and path.read_bytes().endswith(b"\r\n\r\n")


def test_a_key_of_many_captures_and_blocks_spans_files(spark, tmp_path):
    rows = [(i, "https://hot.org/" if i % 3 else f"https://h{i % 50}.org/{i}", f"<p>{i}</p>") for i in range(600)]
    df = spark.createDataFrame(rows, PAGES)
    warc.write_archives(df, f"file://{tmp_path}/a")
    warc.build_index(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/i", block_lines=16)
    look = warc.Index(spark, f"file://{tmp_path}/i")
    assert len(look.files) > 1 and sum(r.n for r in look.directory.collect()) == 600
    for url, n in (("https://hot.org/", 400), ("https://h0.org/0", 1), ("https://h1.org/0", 0)):
        assert look.captures(spark.createDataFrame([(url,)], "url string")).count() == n
    assert sorted(r.page_id for r in look.records(df).collect()) == list(range(600))


def test_an_empty_table_has_no_records(spark):
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    oracle.same(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])
