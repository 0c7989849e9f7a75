import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import embedding as E
from gleaner.functions import issues
from gleaner.functions.embedding import HashingAdapter, by_kind, clear, embed, finite, get, names, register
from gleaner.operators import ranking as R
from gleaner.plans import index as I
from gleaner.plans import search as S
from gleaner.plans import sync
from gleaner.plans.search import fuse, merge_text, search
from gleaner.runtime import measured, read
from gleaner.sources import dumps, files, sinks
from gleaner.streaming import incremental

NOW = 1_700_000_000_000


def test_vectors(spark, column):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)]) for i in range(150)] + [(999, None)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    query = rows[7][1]
    got = [r.id for r in R.knn(df, query, 5, "id").collect()]
    want = sorted((sum((a - b) ** 2 for a, b in zip(v, query)), i) for i, v in rows[:-1])[:5]
    assert got[0] == 7 and got == [i for _, i in want]
    assert R.knn(df, query, 1000, "id").count() == 150
    long = [0.0] * 300
    wide = spark.createDataFrame([(1, [1.0] + [0.0] * 299)], "id int, embedding array<float>")
    assert R.knn(wide, long, 1, "id").first().distance == 1.0
    assert column(R.cosine(F.array(F.lit(0.0), F.lit(0.0)), [1.0, 0.0])) == 0.0


def test_cells_give_the_nearest_and_read_fewer(spark):
    rng = random.Random(8)
    middles = [[rng.gauss(0, 5) for _ in range(6)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in middles[i % 12]]) for i in range(6000)] + [(7000, None), (7001, [1.0]), (7002, [float("nan")] * 6), (7003, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(8000 + i, rows[3][1]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>").repartition(3)
    placed, cells = R.celled(df)
    placed, cells = placed.withColumn("part", F.lit(1)).cache(), cells.withColumn("part", F.lit(1)).cache()
    assert placed.count() == len(rows) and {r.id for r in placed.where("cell = -1").collect()} == {7000, 7001, 7002, 7003}
    for query, k in ((rows[3][1], 7), (rows[3][1], 50), (middles[5], 3), ([40.0] * 6, 2), ([1.0], 3), (rows[0][1], 9000)):
        found = R.CellSearch(placed, cells)
        assert found.nearest(query, k).collect() == R.knn(df, query, k, "id").collect()
        if k < 50 and len(query) == 6:
            assert found.cells_read < found.cells and found.rows_read < 3000
    assert R.CellSearch(placed.limit(0), cells.limit(0)).nearest([1.0] * 6, 3).count() == 0


def test_maxsim(spark):
    pages = spark.createDataFrame([("p", [1.0, 0.0, 0.0, 0.0]), ("p", [0.0, 1.0, 0.0, 0.0]), ("q", [0.0, 0.0, 1.0, 0.0]), ("q", None)], "page string, embedding array<float>")
    own = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]]
    assert {r.page: r.score for r in R.maxsim(pages, own, "page").collect()} == {"p": 2.0, "q": 0.0}


def test_bounds_of_pages_give_the_best_and_open_fewer(spark):
    rng = random.Random(6)
    middles = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    rows = [(f"p{p}" if p else None, [x + rng.gauss(0, 0.05) for x in middles[p]]) for p in range(60) for _ in range(20)]
    rows += [("z", [0.0] * 5), ("z", None), ("w", [1.0]), ("p3", [2.0]), ("p1", [float("inf")] * 5)] + [("p4", rows[85][1])] * 400
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page string, embedding array<float>").repartition(4)
    bounds = R.page_bounds(df, "page").cache()
    assert bounds.count() == 63
    for query, k in (([middles[7], middles[9]], 3), ([middles[7]], 1), ([[1.0]], 5), ([middles[0], [0.0] * 5], 70)):
        found = R.PageSearch(df.where("page IS NULL OR page <> 'p1'"), bounds, "page")
        got = [(r.page, round(r.score, 9)) for r in found.top(query, k).collect()]
        want = R.maxsim(df.where("page IS NULL OR page <> 'p1'"), query, "page").orderBy(F.desc("score"), "page").limit(k)
        assert got == [(r.page, round(r.score, 9)) for r in want.collect()] and got
        if k < 4:
            assert found.pages_read < found.pages_known / 2


def test_rows_before_and_large_lanes(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(400), i, rng.choice([None, 1, 2])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, ts int, id int, v int").repartition(5)
    got = {r.id: r.before for r in R.previous(df, ["k"], ["ts", "id"], F.col("v"), "before").collect()}
    last, want = {}, {}
    for k, ts, i, v in sorted(rows, key=lambda r: (r[0] or "", r[0] is None, r[1], r[2])):
        want[i] = last.get(k)
        last[k] = v
    assert got == want
    lanes = df.select(F.coalesce("k", F.lit("c")).alias("lane"), (F.col("id") % 700).alias("id"), F.col("ts").alias("score"))
    one, two = ({r.id: round(r.rrf_score, 12) for r in R.rrf(lanes, large=large).collect()} for large in (False, True))
    assert one == two and R.rrf(lanes.limit(0), large=True).count() == 0


def test_large_queries_take_the_matrix_path(spark):
    rng = random.Random(2)
    rows = [(f"p{i % 7}" if i % 11 else None, i, [rng.gauss(0, 1) for _ in range(300)]) for i in range(200)] + [("p0", 900, None), ("p1", 901, [0.0] * 300), ("p2", 902, [1.0])]
    df = spark.createDataFrame(rows, "page string, id int, embedding array<float>")
    import numpy as np

    x = {i: np.array(v, np.float32).astype(float) for _, i, v in rows if v and len(v) == 300}
    q = rows[5][2]
    want = sorted((float(np.linalg.norm(v - np.array(q))), i) for i, v in x.items())[:9]
    assert [(round(r.distance, 9), r.id) for r in R.knn(df, q, 9, "id").collect()] == [(round(d, 9), i) for d, i in want]
    query = [rows[5][2], rows[6][2], [0.0] * 300]
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) else v * 0
    best = {}
    for page, i, v in rows:
        if i in x:
            best.setdefault(page, []).append([float(unit(x[i]) @ unit(np.array(u))) for u in query])
    got = {r.page: r.score for r in R.maxsim(df, query, "page").collect()}
    assert got == pytest.approx({p: float(np.max(s, axis=0).sum()) for p, s in best.items()})


def test_keywords(spark):
    assert R.query_phrases('foo-bar  "baz" --') == [["foo", "bar"], ["baz"]]
    assert R.fts_query('a "b') == '"a" OR """b"'
    docs = spark.createDataFrame([(1, "foo bar baz"), (2, "bar foo"), (3, "foo, bar! foo bar"), (4, None)], "id int, text string")
    phrase = {r.id for r in R.bm25(docs, "foo-bar", "id", F.col("text")).collect()}
    assert phrase == {1, 3} and R.bm25(docs, "  --  ", "id", F.col("text")).count() == 0
    posts = {(r.term, r.id): r.positions for r in R.postings(docs, "id", F.col("text")).collect()}
    assert posts[("foo", 3)] == [0, 2] and ("foo", 4) not in posts


def test_fusion_adds_repeated_ids(spark):
    lanes = spark.createDataFrame([("a", "x", 2.0), ("a", "x", 1.0), ("b", "y", 1.0)], "lane string, id string, score double")
    got = {r.id: r.rrf_score for r in R.rrf(lanes).collect()}
    assert got["x"] == pytest.approx(1 / 61 + 1 / 62) and got["y"] == pytest.approx(1 / 61)


def test_adapters():
    clear()
    register(HashingAdapter(8))
    assert names() == ["hashing"] and get("hashing").dimensions == 8 and by_kind("vision") == []
    with pytest.raises(KeyError):
        get("none")
    with pytest.raises(ValueError, match="embed_images"):
        register(type("V", (), {"name": "v", "kind": "vision", "dimensions": 1, "embed_query": None})())
    with pytest.raises(TypeError):
        HashingAdapter().embed_images([b""])
    assert finite([float("nan"), 1.0, float("inf")]) == [0.0, 1.0, 0.0]


def test_embedding_in_batches(spark):
    rows = embed(spark.createDataFrame([("a b",), (None,), ("",)], "t string"), "t", HashingAdapter(16), batch=2).collect()
    assert [len(r.embedding) for r in rows] == [16] * 3 and sum(x * x for x in rows[0].embedding) == pytest.approx(1, abs=1e-5)


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "docs"
    (root / "_hidden").mkdir(parents=True)
    (root / "sub").mkdir()
    (root / "_hidden" / "x.md").write_text("never")
    (root / "a.md").write_text("---\ntitle: Alpha\nstatus: open\ndate: 2023-11-01\n---\n# Alpha\n" + "kangaroo marsupial pouch hopping. " * 5)
    (root / "sub" / "b.txt").write_text("# Beta\n" + "submarine periscope torpedo depth. " * 5)
    (root / "c.pdf").write_text("not text")
    return root


def _docs(spark, root):
    return files.guarded(spark, str(root))


def test_walk(spark, corpus):
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.walk_files(spark, str(corpus)).collect()) == ["a.md", "b.txt"]
    assert sorted(r.path.rsplit("/", 1)[1] for r in _docs(spark, corpus).collect()) == ["a.md", "b.txt"]
    with pytest.raises(FileNotFoundError):
        files.guarded(spark, str(corpus / "none"))


def test_index_lives(spark, corpus, tmp_path):
    root, adapter = f"file://{tmp_path}/indexes", HashingAdapter(32)
    index = I.Index(spark, root, "one")
    source = f"file:{corpus}"
    assert I.list_indexes(spark, root) == [] and index.status()["error"]
    assert I.update(index, _docs(spark, corpus), adapter, "t0", source) == {"new": 2}
    assert index.table("chunks").count() == 2 and index.meta()["total_files"] == "2"
    assert I.update(index, _docs(spark, corpus), adapter, "t1", source) == {"unchanged": 2}

    found = search(spark, root, "kangaroo pouch", ["one", "missing"], vector=adapter.embed_query("kangaroo pouch"), now_ms=NOW).collect()
    assert found[0].file_path.endswith("a.md") and found[0].relative_path == "a.md" and found[0].section_context == "Alpha § Alpha" and json.loads(found[0].metadata)["status"] == "open" and len(found) == 2
    assert found[0].semantic_score == pytest.approx(0.6 * found[0].vec_score + 0.4 * found[0].fts_score)
    only = search(spark, root, "submarine", ["one"], vector=adapter.embed_query("submarine"), now_ms=NOW, filters={"status": "OPEN"}).collect()
    assert [r.file_path.rsplit("/", 1)[1] for r in only] == ["a.md"]
    assert search(spark, root, "submarine", ["one"], vector=adapter.embed_query("submarine"), now_ms=NOW, threshold=2.0).count() == 0

    (corpus / "a.md").unlink()
    (corpus / "sub" / "b.txt").write_text("# Beta\n" + "submarine periscope torpedo depth. " * 5 + "\n# More\n" + "another harbour with many lighthouses and ships in it. " * 3)
    assert I.update(index, _docs(spark, corpus), adapter, "t2", source) == {"changed": 1, "pruned": 1}
    assert index.table("files").count() == 1 and index.table("chunks").count() == 2

    (corpus / "sub" / "b.txt").write_text("")
    assert I.update(index, _docs(spark, corpus), adapter, "t3", source) == {"pruned": 1}  # Spark lists no empty files
    assert index.table("chunks").count() == 0
    assert isinstance(I.reindex(spark, root, lambda s: files.guarded(spark, s + "/none"), adapter, "t4")["one"], FileNotFoundError)
    index.delete()
    assert I.list_indexes(spark, root) == []


def test_each_text_is_embedded_once(spark, tmp_path):
    class Once(HashingAdapter):
        def embed_documents(self, texts):
            assert len(set(texts)) == len(texts)
            return super().embed_documents(texts)

    index = I.Index(spark, f"file://{tmp_path}/indexes", "dup")
    body = "the same words all over again, more than eighty characters of them, so that they make a chunk"
    docs = spark.createDataFrame([(f"/d/{i}.md", 9, 1, body) for i in range(4)], "path string, size bigint, mtime_ms bigint, content string")
    I.update(index, docs, Once(8), "t")
    assert index.table("chunks").where("embedding IS NOT NULL").count() == 4


def test_pages_and_hybrid(spark, corpus, tmp_path):
    root, adapter = f"file://{tmp_path}/indexes", HashingAdapter(32)
    index = I.Index(spark, root, "v")
    I.update(index, _docs(spark, corpus), adapter, "t0")
    pages = spark.createDataFrame([("d", 1, "h1", "/x.pdf"), ("d", 2, "h2", "/x.pdf")], "document_id string, page_number int, image_hash string, source_path string")
    vectors = spark.createDataFrame([("d", 1, 0, [1.0, 0.0]), ("d", 2, 0, [0.0, 1.0]), ("d", 2, 1, [1.0, 1.0])], "document_id string, page_number int, vector_index int, embedding array<float>")
    I.update_pages(index, pages, vectors, "vis", "t1")
    I.update_pages(index, pages, vectors, "vis", "t2")
    assert index.meta()["total_page_vectors"] == "3" and {r.indexed_at for r in index.table("page_images").collect()} == {"t1"}
    I.add_page_texts(index, spark.createDataFrame([("/x.pdf", 1, "a word only in the file"), ("/x.pdf", 2, " ")], "path string, page_number int, text string"), "m", "t3")
    assert I.update(index, _docs(spark, corpus), adapter, "t4") == {"unchanged": 2}
    args = dict(vector=adapter.embed_query("kangaroo"), page_query=[[1.0, 0.0]], now_ms=NOW)
    vision = search(spark, root, "kangaroo", ["v"], mode="vision", **args).collect()
    assert [r.page_number for r in vision] == [1, 2] and vision[0].score == pytest.approx(1.0)
    hybrid = search(spark, root, "kangaroo word", ["v"], mode="hybrid", **args).collect()
    assert {r.result_type for r in hybrid} == {"text", "vision"} and all(r.score == r.rrf_score for r in hybrid) and hybrid == sorted(hybrid, key=lambda r: -r.score)
    text = search(spark, root, "word", ["v"], **args).collect()
    assert any(r.file_path.startswith("pdf://") and r.vec_score == 0 for r in text)


def test_merge_keeps_the_best_of_each_chunk(spark):
    rows = spark.createDataFrame([("i", "f", 0, 0.5), ("j", "f", 0, 0.9), ("i", "g", 0, 0.1)], "index_name string, file_path string, chunk_index bigint, score double")
    assert [(r.index_name, r.score) for r in merge_text(rows, 10, 0.2).collect()] == [("j", 0.9)]
    assert callable(fuse)


def test_streams(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "1.json").write_text('{"k":1,"v":"a"}\n{"k":1,"v":"a"}\n{"k":2,"v":"b"}\n')
    run = lambda n: incremental.append_stream(incremental.stream_json(spark, str(source), "k int, v string"), target, ["k"], str(tmp_path / n)).awaitTermination()
    run("c1")
    (source / "2.json").write_text('{"k":2,"v":"b"}\n{"k":3,"v":"c"}\n')
    run("c1")
    run("c2")  # all over again from the start: nothing is repeated
    assert sorted(r.k for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_index_stream_does_not_prune(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    index, adapter = I.Index(spark, f"file://{tmp_path}/indexes", "s"), HashingAdapter(8)
    words = "enough words to make one chunk of a document that is longer than eighty characters, surely"
    line = lambda p, t, c: json.dumps({"path": p, "size": 1, "mtime_ms": t, "content": c}) + "\n"
    run = lambda: incremental.index_stream(incremental.stream_json(spark, str(source), "path string, size bigint, mtime_ms bigint, content string"), index, adapter, lambda: "t", str(tmp_path / "c")).awaitTermination()
    (source / "1.json").write_text(line("/a", 1, words) + line("/b", 1, words + "!"))
    run()
    (source / "2.json").write_text(line("/b", 2, words + "?") + line("/c", 1, words + "."))
    run()
    assert {r.path: r.content[-1] for r in index.table("chunks").collect()} == {"/a": "y", "/b": "?", "/c": "."}


def test_change_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    index = I.Index(spark, f"file://{tmp_path}/indexes", "cdc")
    (source / "1.json").write_text('{"path":"/a","content_hash":"1","op":"put","at":1}\n{"path":"/b","content_hash":"1","op":"put","at":1}\n{"path":"/a","content_hash":"2","op":"delete","at":2}\n')
    log = incremental.stream_json(spark, str(source), "path string, content_hash string, size bigint, mtime_ms bigint, indexed_at string, metadata string, op string, at int")
    incremental.apply_changes_stream(log, index, "files", ["path"], ["at"], str(tmp_path / "c")).awaitTermination()
    assert [r.path for r in index.table("files").collect()] == ["/b"]


def test_windows_close_by_watermark(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"t":"2024-01-01T00:00:10Z","k":"x"}\n{"t":"2024-01-01T00:00:20Z","k":"x"}\n{"t":"2024-01-01T05:00:00Z","k":"x"}\n')
    rows = incremental.stream_json(spark, str(source), "t timestamp, k string")
    q = incremental.windowed_counts(incremental.deduplicated(rows, ["t", "k"]), "t", "1 minute", ["k"]).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.k, r.n) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("x", 2)]


class _Source:
    def __init__(self, name, fail=False):
        self.name, self.fail, self.modes = name, fail, []

    def sync(self, mode, state):
        self.modes.append(mode)
        state["cursors"]["at"] = len(self.modes)
        if self.fail:
            raise RuntimeError("down")
        return {"written": 2}


def test_syncs_are_apart_and_save_only_what_ended_well(tmp_path):
    path = str(tmp_path / "state.json")
    good, bad = _Source("good"), _Source("bad", fail=True)
    done = []
    for _ in range(2):
        results = sync.sync_all([bad, good], sinks.SyncState(path), "now", then=done.append)
        assert [(r.adapter, r.error) for r in results] == [("bad", "down"), ("good", None)]
    assert good.modes == ["full", "incremental"] and bad.modes == ["full", "full"] and [r.counts for r in done] == [{"written": 2}] * 2
    assert sinks.SyncState(path).adapter("good")["lastSyncAt"] == "now" and sinks.SyncState(path).adapter("bad")["lastSyncAt"] is None
    assert [sync.retry_delay(n, jitter=lambda: 0.0) for n in (0, 1, 5)] == [1.0, 2.0, 30.0]


def test_rate_limits():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    limit = sync.RateLimit(delay=1.0, requests=3, window=10.0, units=6, unit_window=4.0, clock=lambda: now[0], sleep=sleep)
    at = []
    for cost in (5, 1, 5, 1):
        limit.acquire(cost)
        at.append(now[0])
    assert at == [0.0, 1.0, 4.0, 10.0]
    limit.back_off(7.0)
    limit.acquire()
    assert now[0] == 17.0


def test_dumps_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dumps, "RANGE_BYTES", 37)
    (tmp_path / "sub").mkdir()
    rows = [json.dumps({"id": str(i), "n": "x" * (i % 50)}) for i in range(200)]
    (tmp_path / "a.jsonl").write_text("\n".join(rows[:150]) + "\n")
    (tmp_path / "sub" / "b.jsonl").write_text("no json\n" + "\n".join(rows[150:]))
    (tmp_path / "_skip").write_text(rows[0])
    parts = dumps._Reader({"path": f"file://{tmp_path}"}, ["id", "n"]).partitions()
    assert len(parts) > 20
    found = [r for p in parts for r in dumps._rows(p, ["id", "n"])]
    assert sorted(found) == sorted((str(i), "x" * (i % 50)) for i in range(200))
    assert dumps._last_line_end(str(tmp_path / "sub" / "b.jsonl"), 11, step=2) == 8


def test_page_images_are_embedded_again_where_vectors_are_not_finite(spark):
    class Once:
        kind, name, asked = "vision", "once", 0

        def embed_images(self, images):
            self.asked += 1
            return [[[float("nan") if self.asked == 1 else 1.0, float("inf")]] for _ in images]

    pages = spark.createDataFrame([(1, b"x")], "page int, image binary").coalesce(1)
    row = E.embed_images(pages, "image", Once()).first()
    assert (row.page, row.vector_index, row.embedding) == (1, 0, [1.0, 0.0])


def test_crashes_between_pointers_lose_nothing(spark, tmp_path):
    index = I.Index(spark, f"file://{tmp_path}", "p")
    rows = spark.createDataFrame([("a", "h", 1, 1, "t", None)], I.FILES)
    index.replace({"x": 1}, files=rows)
    before = index.table("files")
    index.replace(files=rows.unionByName(rows))
    (tmp_path / "p" / "pointers" / ".half.tmp").write_text("{")
    assert before.count() == 1 and index.table("files").count() == 2 and index.meta() == {"x": "1"}
    index.replace(files=rows)
    assert index.table("files").count() == 1 and len(index._pointers()) == 3 and before.count() == 1
    index.vacuum(0)
    assert index.table("files").count() == 1 and len(index._pointers()) == 2


def test_packed_names_do_not_go_through_the_driver(spark, tmp_path):
    """A file far below the broadcast threshold whose rows are above it is joined by a shuffle."""
    names = spark.range(250_000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("id"), F.format_string("Customer#%09d", "id").alias("displayName"))
    names.coalesce(1).write.parquet(str(tmp_path / "names.parquet"))
    dimension = read(spark, str(tmp_path), "names")
    stored = sum(f.stat().st_size for f in (tmp_path / "names.parquet").glob("*.parquet"))
    assert stored < 10 << 20 < measured(dimension)[1]
    rows = spark.range(250_000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("assigneeId"), F.repeat(F.lit("x"), 100).alias("title"))
    joined = issues._named(rows, "assigneeId", dimension, F.col("displayName"), "assignee")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()


def test_ties_at_the_cut_of_candidates_go_to_the_newer(spark, tmp_path, monkeypatch):
    """250 equal documents, of which 200 become candidates by word and 20 by vector; the newest have the largest paths."""
    index = I.Index(spark, str(tmp_path), "ties")
    rows = [(f"/d/{i:03}.md", 60, NOW + i, "the very same words about one kangaroo in a pouch, repeated until they are long enough to be a chunk") for i in range(250)]
    adapter = HashingAdapter()
    I.update(index, spark.createDataFrame(rows, "path string, size bigint, mtime_ms bigint, content string"), adapter, "2024-01-01", "/d")
    vector = adapter.embed_query("kangaroo pouch")
    find = lambda: [r.relative_path for r in search(spark, str(tmp_path), "kangaroo", ["ties"], vector=vector, now_ms=NOW, top_k=1).collect()]
    ids = lambda: sorted(r.file_path for r in S._lane(index.snapshot(), "kangaroo", vector, 100, NOW + 10**12, 0.15, 90.0, None, False).collect())
    want = [f"/d/{i:03}.md" for i in range(50, 250)]
    assert ids() == want and len(find()) == 1
    monkeypatch.setattr(S, "MANY_POSTINGS", 0)
    monkeypatch.setattr(S, "MANY_VECTORS", 0)
    assert ids() == want
