import json
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions.embedding import HashingAdapter
from gleaner.operators import ranking as R
from gleaner.plans import index as I
from gleaner.plans.search import search
from gleaner.plans.segments import Conflict
from gleaner.streaming import incremental

DOCS = "path string, size bigint, mtime_ms bigint, content string"
WORDS = "harbour lighthouse submarine torpedo kangaroo pouch periscope marsupial depth hopping".split()


def documents(rng, paths, at):
    return [(p, 9, at, " ".join(rng.choice(WORDS) for _ in range(30)) + f" {p}") for p in paths]


def contents(index):
    key = lambda rows: sorted(map(repr, rows))
    posts = index.table("postings").select("term", "path", "chunk_index", "tf", "positions").collect()
    chunks = index.table("chunks").select("path", "chunk_index", "content", "embedding", "content_hash").collect()
    files = index.table("files").select("path", "content_hash", "mtime_ms").collect()
    return key(posts), key(chunks), key(files), key(index.table("lengths").collect())


def test_segments_equal_a_rebuild_and_write_what_changed(spark, tmp_path):
    rng, adapter = random.Random(1), HashingAdapter(8)
    index = I.Index(spark, f"file://{tmp_path}/i", "a", most_segments=3)
    have = {r[0]: r for r in documents(rng, [f"/d/{i}.md" for i in range(200)], 1)}
    frame = lambda: spark.createDataFrame(list(have.values()), DOCS)
    I.update(index, frame(), adapter, "t")
    first = index.snapshot()
    for step in range(2, 8):
        changed = rng.sample(sorted(have), 2)
        for r in documents(rng, changed[:1] + [f"/d/new{step}.md"], step):
            have[r[0]] = r
        gone = have.pop(changed[1])
        touched = rng.choice(sorted(have))
        have[touched] = (*have[touched][:2], 100 + step, have[touched][3])
        if step > 5:
            have[gone[0]] = (*gone[:2], step, gone[3])  # goes and comes back with the same text
        before = {n: {p["at"] for p in index.snapshot().parts(n)} for n in ("files", "chunks", "postings", "lengths")}
        I.update(index, frame(), adapter, "t")
        snap = index.snapshot()
        if step == 2:
            new = {n: [p for p in snap.parts(n) if p["at"] not in before[n]] for n in before}
            assert [sum(p["rows"] for p in new[n]) for n in ("files", "chunks", "lengths")] == [3 if touched not in changed[:1] + ["/d/new2.md"] else 2, 2, 2]
            assert sum(p["rows"] for p in new["postings"]) * 20 < snap.rows("postings") and all(before[n] < {p["at"] for p in snap.parts(n)} for n in before)
        assert len(index.segments()) <= 3 and int(snap.meta["total_files"]) == len(have)
    fresh = I.Index(spark, f"file://{tmp_path}/i", "b")
    I.update(fresh, frame(), adapter, "t")
    assert contents(index) == contents(fresh) and index.meta()["total_chunks"] == fresh.meta()["total_chunks"]
    ask = lambda n: [(r.file_path, round(r.score, 9)) for r in search(spark, f"file://{tmp_path}/i", "kangaroo depth", [n], vector=adapter.embed_query("kangaroo depth"), now_ms=5).collect()]
    assert ask("a") == ask("b") and len(ask("a")) == 10
    before = contents(index)
    index.compact(full=True)
    assert contents(index) == before and len(index.segments()) == 1 and not any(index.snapshot().state["gone"].values())
    assert first.table("files").count() == 200  # a reader that began before all of it


def test_blocks_of_postings_give_the_best_rows(spark, tmp_path):
    """Against scores of all rows, over segments with dead rows and after a merge."""
    rng, adapter = random.Random(5), HashingAdapter(4)
    index = I.Index(spark, f"file://{tmp_path}", "b")
    common = lambda i: " ".join(rng.choice(WORDS[:6]) for _ in range(20 + i % 25)) + (" rare depth" if 100 <= i < 112 else "")
    rows = [(f"/d/{i:04d}", 9, 1, common(i)) for i in range(700)]
    I.update(index, spark.createDataFrame(rows, DOCS), adapter, "t")
    rows = [r for i, r in enumerate(rows) if i % 50] + [(f"/e/{i}", 9, 2, common(i)) for i in range(8)]
    rows = [(p, n, 2, c + " submarine rare") if i % 60 == 7 else (p, n, m, c) for i, (p, n, m, c) in enumerate(rows)]
    I.update(index, spark.createDataFrame(rows, DOCS), adapter, "t")
    queries = [("rare", 5), ("rare harbour", 5), ("rare-depth lighthouse", 3), ("harbour submarine kangaroo", 200), ("nothing here", 4), ("--", 3)]
    for asked in (queries, queries[1:3]):
        snap = index.snapshot()
        key = F.struct("path", "chunk_index").alias("id")
        read = 0
        for query, k in asked:
            whole = R.bm25_stored(snap.table("postings").select("term", key, "tf", "positions"), snap.table("lengths").select(key, "dl"), query)
            want = [(tuple(r.id), round(r.score, 9)) for r in whole.orderBy(F.desc("score"), "id").limit(k).collect()]
            found = snap.keyword_search()
            got = [(tuple(r.id), round(r.score, 9)) for r in found.top(query, k, pilot=1).orderBy(F.desc("score"), "id").collect()]
            assert [s for _, s in got] == [s for _, s in want] and set(got[:-1]) == set(want[:-1]) or got == want
            if query == "rare harbour":
                assert 0 < found.blocks_read < found.blocks
            read += found.blocks_read
        assert read
        if asked is queries:
            for v in ([0.5, -0.5, 0.5, 0.5], [0.0] * 4, [9.0, 0.0, 0.0, 1.0]):
                near, all_of = snap.vector_search(), snap.table("chunks").select(key, "embedding")
                assert near.nearest(v, 9).collect() == R.knn(all_of, v, 9, "id").collect()
        index.compact(full=True)


def test_partial_merges_keep_what_tombstones_say(spark, tmp_path):
    """Random commits and merges of random suffixes, against a dictionary."""
    rng, index = random.Random(9), I.Index(spark, f"file://{tmp_path}", "m")
    row = lambda p, v: (p, v, 1, 1, "t", None)
    have, dims = {}, {}
    for step in range(14):
        gone = [rng.choice("abcdefg") for _ in range(rng.randrange(3))]
        puts = {rng.choice("abcdefg") for _ in range(rng.randrange(3))}
        puts = {p for p in puts if p in gone or p not in have}
        for p in gone:
            have.pop(p, None)
            dims.pop(p, None)
        have |= {p: str(step) for p in puts}
        sizes = {p for p in puts if rng.random() < 0.5}
        dims |= {p: step for p in sizes}
        index.commit(
            index.snapshot(), append={"chunks": spark.createDataFrame([(p, 0, str(step), None, "h", None, None, None, None) for p in puts], index.empty("chunks").schema), "lengths": spark.createDataFrame([(p, 0, step) for p in sizes], index.empty("lengths").schema)},
            gone={"content": spark.createDataFrame([(p,) for p in gone], "path string")},
        )
        if rng.random() < 0.5:
            index.compact(most=rng.randrange(1, 4))
        if step % 6 == 5 or step > 12:
            assert {r.path: r.content for r in index.table("chunks").collect()} == have and {r.path: r.dl for r in index.table("lengths").collect()} == dims


def test_writers_both_survive_or_one_is_told(spark, tmp_path):
    index, adapter = I.Index(spark, f"file://{tmp_path}", "w"), HashingAdapter(8)
    rng = random.Random(2)
    frame = lambda paths: spark.createDataFrame(documents(rng, paths, 1), DOCS)
    I.update(index, frame(["/a", "/b"]), adapter, "t")
    slow = index.snapshot()
    I.update(index, frame(["/a", "/b", "/c"]), adapter, "t")
    rows = spark.createDataFrame([("/x", "h", 1, 1, "t", None)], I.FILES)
    with pytest.raises(Conflict, match="files"):
        index.commit(slow, append={"files": rows})
    with pytest.raises(Conflict):
        index.replace(base=slow, files=rows)
    with pytest.raises(Conflict, match="chunks"):
        index.commit(slow, append={"page_vectors": spark.createDataFrame([("d", 1, 0, [1.0])], index.empty("page_vectors").schema)}, reads=("chunks",))
    # Other tables: both stay.
    index.commit(slow, append={"page_vectors": spark.createDataFrame([("d", 1, 0, [1.0])], index.empty("page_vectors").schema)}, meta={"k": 1})
    assert index.table("page_vectors").count() == 1 and index.table("files").count() == 3 and index.meta()["k"] == "1"
    folders = {p.name for p in (tmp_path / "w" / "files").iterdir()}
    assert folders == {p["at"] for p in index.snapshot().parts("files")}  # what was refused is not left behind


def test_a_merge_meets_an_update(spark, tmp_path, monkeypatch):
    index = I.Index(spark, f"file://{tmp_path}", "c")
    put = lambda p, v: index.commit(index.snapshot(), append={"files": spark.createDataFrame([(p, v, 1, 1, "t", None)], I.FILES)}, gone={"files": spark.createDataFrame([(p,)], "path string")})
    for i in range(3):
        put(f"/{i}", "old")
    write = index._write
    monkeypatch.setattr(index, "_write", lambda *a: (monkeypatch.undo(), put("/1", "new"), write(*a))[2])
    assert index.compact(full=True)
    assert {r.path: r.content_hash for r in index.table("files").collect()} == {"/0": "old", "/1": "new", "/2": "old"}
    assert [p["rows"] for p in index.snapshot().parts("files")] == [3, 1]


def test_retention(spark, tmp_path):
    index = I.Index(spark, f"file://{tmp_path}", "r")
    rows = lambda n: spark.createDataFrame([(str(i), "h", 1, 1, "t", None) for i in range(n)], I.FILES)
    for n in range(1, 5):
        index.replace(files=rows(n))
    assert len(index._pointers()) == 4 and len(list((tmp_path / "r" / "files").iterdir())) == 4
    index.vacuum(0)
    assert index._pointers() == [3, 4] and len(list((tmp_path / "r" / "files").iterdir())) == 2
    old = index.snapshot()
    index.delete()
    with pytest.raises(Conflict):
        index.commit(old, append={"files": rows(1)})


def test_index_stream_leaves_page_texts_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    index, adapter = I.Index(spark, f"file://{tmp_path}/indexes", "s"), HashingAdapter(8)
    I.add_page_texts(index, spark.createDataFrame([("/data/doc.pdf", 1, "words of a page")], "path string, page_number int, text string"), "m", "t")
    line = lambda p, c: json.dumps({"path": p, "size": 1, "mtime_ms": 1, "content": c * 20}) + "\n"
    for n in range(2):
        (source / f"{n}.json").write_text(line(f"/{n}", "some words "))
        rows = incremental.stream_json(spark, str(source), DOCS)
        incremental.index_stream(rows, index, adapter, lambda: "t", str(tmp_path / "c")).awaitTermination()
    assert sorted(r.path for r in index.table("files").collect()) == ["/0", "/1", "pdf:///data/doc.pdf"] == sorted(r.path for r in index.table("chunks").collect())
    assert index.meta()["total_files"] == "3" and index.meta()["total_chunks"] == "3"
    I.add_page_texts(index, spark.createDataFrame([("/data/doc.pdf", 1, "other words"), ("/data/doc.pdf", 2, "more")], "path string, page_number int, text string"), "m", "t")
    assert index.table("chunks").where(F.col("path").startswith("pdf")).count() == 2 and index.meta()["total_files"] == "3" and index.meta()["total_chunks"] == "4"


def test_postings_move_rows_only(spark):
    """A row's words meet where the row is, as a shuffle of all words would bring them together."""
    rng = random.Random(3)
    text = lambda i: "" if i % 9 == 0 else None if i % 13 == 0 else " ".join(rng.choice(WORDS + ["Été", "x1"]) for _ in range(i % 40)) + " -- été."
    docs = spark.createDataFrame([(i if i != 7 else None, text(i)) for i in range(300)], "id int, text string").repartition(3)
    found = R.block_postings(docs, ["id"], F.col("text"), size=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == plan.count("Exchange ") - plan.count("Exchange RoundRobin") == 1 and "Generate" not in plan
    rows = found.collect()
    want = {(r.term, r.id): (r.tf, r.positions) for r in R.postings(docs.where("id IS NOT NULL"), "id", F.col("text")).collect()}
    assert len(rows) == len(want) and {(r.term, r.id): (r.tf, r.positions) for r in rows} == want
    assert {r.id: r.dl for r in rows} == {r.id: r.dl for r in R.term_counts(docs.where("id IS NOT NULL"), "id", F.col("text"), []).where("dl > 0").collect()}
    held = {b: sorted({r.id for r in rows if r.block == b}) for b in {r.block for r in rows}}
    assert max(map(len, held.values())) <= 8 and all(a[-1] < b[0] for a, b in zip(sorted(held.values()), sorted(held.values())[1:]))
    assert R.block_postings(docs.limit(0), ["id"], F.col("text")).count() == 0


def test_new_postings_are_not_joined_to_lengths(spark, tmp_path, monkeypatch):
    index = I.Index(spark, f"file://{tmp_path}", "p")
    with monkeypatch.context() as patched:
        patched.setattr(R, "blocked", lambda *a: pytest.fail("postings in blocks are placed once more"))
        I.update(index, spark.createDataFrame(documents(random.Random(2), ["/d/a.md", "/d/b.md"], 1), DOCS), HashingAdapter(4), "t")
    index.commit(index.snapshot(), append={n: index.table(n).drop("block", "dl") if n == "postings" else index.table(n) for n in ("postings", "lengths")})
    first, second = index.snapshot().parts("impacts")
    assert first["rows"] == second["rows"] > 0


def test_few_large_partitions_are_chunked_on_all_cores(spark, tmp_path, monkeypatch):
    chunked, seen = I.chunked, []
    monkeypatch.setattr(I, "chunked", lambda docs: seen.append(docs.rdd.getNumPartitions()) or chunked(docs))
    rows = spark.createDataFrame(documents(random.Random(2), [f"/d/{i}.md" for i in range(20)], 1), DOCS).coalesce(1)
    I.update(I.Index(spark, f"file://{tmp_path}", "s"), rows, HashingAdapter(4), "t")
    assert seen == [spark.sparkContext.defaultParallelism]
