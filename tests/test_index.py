from pyspark.sql import functions as F

from scriptorium.operators import bm25, documents, manifest
from scriptorium.operators.vectors import embed, hashing_encoder
from scriptorium.sources import files, index_store
from scriptorium.streaming import ingest


def test_load_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello\r\nworld")
    (tmp_path / "sub" / "b.MD").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.py").write_text("no")
    (tmp_path / ".hidden.txt").write_text("no")
    rows = {r["filename"]: r for r in files.load_documents(spark, str(tmp_path)).collect()}
    assert {k: r["content"] for k, r in rows.items()} == {"a.txt": "hello\nworld", "b.MD": "café"}
    assert rows["b.MD"]["extension"] == ".md" and rows["a.txt"]["size_bytes"] == 12
    assert files.load_documents(spark, str(tmp_path / "missing")).count() == 0
    for folder in ("_drafts", ".dot"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.txt").write_text(folder)
    (tmp_path / "_notes.md").write_text("noted")
    (tmp_path / "_drafts" / "_y.txt").write_text("y")
    again = {r["content"] for r in files.load_documents(spark, str(tmp_path)).collect()}
    assert again == {"hello\nworld", "café", "_drafts", ".dot", "noted", "y"}


def test_requests(spark):
    requests = spark.createDataFrame([(1, "inline", None), (2, "x", "f"), (3, "", None), (4, None, "gone")], "request_id long, content string, file_path string")
    texts = spark.createDataFrame([("f", "from file")], "source string, content string")
    good, bad = files.inline_or_file(requests, texts)
    assert {r["request_id"]: r["content"] for r in good.collect()} == {1: "inline", 2: "from file"}
    assert {r["request_id"] for r in bad.collect()} == {3, 4}


def test_index_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, "one two"), ("b", 0, "two three")], "source string, chunk_index int, content string")
    vecs = embed(chunks, "content", hashing_encoder(8)).drop("content")
    path = str(tmp_path / "index")
    index_store.write_index(chunks, vecs, path)
    stored = index_store.read_index(spark, path)
    assert stored["terms"].where("term = 'two'").first()["df"] == 2 and stored["collection"].first()["n"] == 2
    more = spark.createDataFrame([("b", 0, "two"), ("b", 1, "four"), ("c", 0, "five")], "source string, chunk_index int, content string")
    other = str(tmp_path / "index2")
    index_store.replace_sources(more, embed(more, "content", hashing_encoder(8)).drop("content"), path, other)
    swapped = index_store.read_index(spark, other)
    assert sorted(r["content"] for r in swapped["chunks"].collect()) == ["five", "four", "one two", "two"]
    assert {r["term"] for r in swapped["terms"].collect()} == {"one", "two", "four", "five"} and swapped["vectors"].count() == 4
    extra = spark.createDataFrame([("d", 0, "six")], "source string, chunk_index int, content string")
    index_store.append_index(extra, embed(extra, "content", hashing_encoder(8)).drop("content"), other)
    grown = index_store.read_index(spark, other)
    asked = spark.createDataFrame([(1, "four")], "query_id long, query string")
    assert grown["collection"].first()["n"] == 5 and bm25.bm25_topk(asked, grown, 1).collect() == bm25.bm25_topk(asked, grown["chunks"], 1).collect()
    assert bm25.bm25_topk(asked, grown, 1).first()["source"] == "b"
    index_store.append_points(chunks, vecs, str(tmp_path / "points"))
    index_store.append_points(chunks, vecs, str(tmp_path / "points"))
    assert spark.read.parquet(str(tmp_path / "points")).count() == 2
    index_store.reset_index(spark, path)
    assert index_store.read_index(spark, path)["chunks"].count() == 0


def test_manifest(spark):
    old = spark.createDataFrame([("a", "1", 2), ("b", "1", 3)], "path string, hash string, chunks_count int")
    now = spark.createDataFrame([("a", "1", 9), ("b", "2", 4), ("c", "1", 1)], "path string, hash string, chunks_count int")
    changed = manifest.changed_files(now, old)
    assert {r["path"] for r in changed.collect()} == {"b", "c"} and manifest.skipped_count(now, old).first()[0] == 1
    merged = manifest.mark_indexed(old, changed)
    assert {(r["path"], r["hash"], r["chunks_count"]) for r in merged.collect()} == {("a", "1", 2), ("b", "2", 4), ("c", "1", 1)}
    again = manifest.read_manifest(manifest.manifest_json(merged))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))
    assert manifest.remove_indexed(merged, spark.createDataFrame([("c",), ("zz",)], "path string")).count() == 2


def test_sessions(spark):
    m = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "x" * 40), (2, 0, "assistant", "hi")], "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r["title"] for r in documents.session_summary(m).collect()}
    assert got == {1: "x" * 30 + "...", 2: "New chat"}
    f = spark.createDataFrame([(1, "m", 2, "c"), (1, "m", 0, "a"), (1, "m", 1, "b")], "conv_id long, message_id string, seq int, text string")
    assert documents.assemble_messages(f).first()["text"] == "abc"
    frames = spark.createDataFrame([(1, "m", 0, "[1]", "references"), (1, "m", 1, "hi", "text"), (1, "m", 2, None, "done"), (1, "n", 0, "x", "text")], "conv_id long, message_id string, seq int, text string, kind string")
    got = {r["message_id"]: (r["text"], r["references"], r["done"], r["n_fragments"]) for r in documents.assemble_messages(frames).collect()}
    assert got == {"m": ("hi", "[1]", True, 1), "n": ("x", None, False, 1)}


def test_places_in_lists(spark):
    rows = [(str(k), f"f{k}", k, 1, k % 7, "u" if k % 3 else "v") for k in range(60)]
    catalog = spark.createDataFrame(rows, "id string, filename string, filesize int, chunk_count int, created_at int, user_id string")
    got = documents.list_documents(catalog).collect()
    for user in "uv":
        mine = sorted((r for r in got if r["user_id"] == user), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["id"] for r in mine] == [r["id"] for r in sorted(mine, key=lambda r: (-r["created_at"], r["id"]))]


def test_changed_files_replace_their_chunks(spark, tmp_path):
    inbox, index = tmp_path / "in", str(tmp_path / "index")
    inbox.mkdir()
    shown = lambda: sorted(r["content"] for r in ingest.current_chunks(spark, index).collect())
    for text in ("one", "two", "one", "one"):
        (inbox / "a.txt").write_text(text)
        (inbox / "b.txt").write_text("same")
        ingest.index_files(spark, str(inbox), index)
        assert shown() == sorted([text, "same"])
    assert ingest.current_manifest(spark, index).count() == 2
    again = manifest.read_manifest(manifest.manifest_lines(spark.createDataFrame([("p", "h", 3)], "path string, hash string, chunks_count int")))
    assert [tuple(r) for r in again.collect()] == [("p", "h", 3)]


def test_deletes(spark):
    catalog = spark.createDataFrame([("1", "f1", "u"), ("2", "f2", "v")], "id string, filename string, user_id string")
    wanted = spark.createDataFrame([("1", "u"), ("2", "u")], "id string, user_id string")
    assert [r["id"] for r in documents.delete_documents(catalog, wanted).collect()] == ["2"]
    rows = spark.createDataFrame([("u", "f1", 0), ("v", "f2", 0)], "user_id string, source string, chunk_index int")
    assert documents.delete_index_rows(rows, documents.deleted_sources(catalog, wanted)).first()["source"] == "f2"


def test_stream_index(spark, tmp_path):
    inbox, index = tmp_path / "in", str(tmp_path / "index")
    inbox.mkdir()
    (inbox / "a.txt").write_text("first text")
    run = lambda: ingest.stream_index(spark, str(inbox), index, str(tmp_path / "ckpt")).awaitTermination()
    run()
    (inbox / "b.txt").write_text("second text")
    run()
    run()
    chunks = spark.read.parquet(f"{index}/chunks")
    assert sorted(r[0] for r in chunks.select(F.col("content")).collect()) == ["first text", "second text"]
    assert spark.read.parquet(f"{index}/manifest").count() == 2


def test_stream_rereads_changed_files(spark, tmp_path):
    inbox, index = tmp_path / "in", str(tmp_path / "index")
    (inbox / "_sub").mkdir(parents=True)
    run = lambda: ingest.stream_index(spark, str(inbox), index, str(tmp_path / "ckpt"), settle=0.0).awaitTermination()
    shown = lambda: sorted(r["content"] for r in ingest.current_chunks(spark, index).collect())
    (inbox / "a.txt").write_text("one")
    (inbox / "_sub" / "b.md").write_text("same")
    (inbox / "c.py").write_text("no")
    run()
    assert shown() == ["one", "same"]
    (inbox / "a.txt").write_text("two, longer")
    (inbox / "_sub" / "b.md").write_text("same")  # written again, not changed
    run()
    run()
    assert shown() == ["same", "two, longer"] and spark.read.parquet(f"{index}/manifest").count() == 3


def test_stream_dedupe(spark):
    rows = spark.createDataFrame([("a", "1", 0), ("a", "1", 1), ("a", "2", 2), ("b", "1", 3)], "source string, hash string, n int")
    assert sorted(map(tuple, ingest.stream_dedupe(rows).select("source", "hash").collect())) == [("a", "1"), ("a", "2"), ("b", "1")]


def test_many_files_in_many_folders(spark, tmp_path):
    for k in range(10_000):
        folder = tmp_path / f"f{k % 20}" / f"_g{k % 7}"
        if k < 140:
            folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{k}.txt").write_text(f"text {k}")
    (tmp_path / "f0" / "skip.bin").write_text("no")
    listed = files.list_files(spark, f"file:{tmp_path}")
    assert listed.count() == 10_001
    got = files.load_documents(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == 5
    assert got.select(F.count("*"), F.countDistinct("source"), F.sum(F.substring("content", 6, 9).cast("long"))).first() == (10_000, 10_000, 10_000 * 9_999 // 2)


CHUNK = "user_id string, source string, chunk_index int, content string"


def indexed(spark, rows):
    chunks = spark.createDataFrame(rows, CHUNK)
    return chunks, embed(chunks, "content", hashing_encoder(8)).drop("content")


def same_as_rebuilt(spark, path, rows, folder):
    """Whether the index at path answers, and counts, as one built of these rows."""
    asked = spark.createDataFrame([(1, "red", None), (2, "red green", "u"), (3, "blue blue sky", None), (4, "grey", "v")], "query_id long, query string, user_id string")
    index_store.write_index(*indexed(spark, rows), folder)
    one, two = index_store.read_index(spark, path), index_store.read_index(spark, folder)
    for table, columns in (("terms", ["term", "df", "idf"]), ("collection", ["n", "avgdl"]), ("chunks", ["user_id", "source", "chunk_index", "content"]), ("vectors", ["user_id", "source", "chunk_index"])):
        assert sorted(map(str, one[table].select(*columns).collect())) == sorted(map(str, two[table].select(*columns).collect())), table
    assert sorted(bm25.bm25_topk(asked, one, 3).collect()) == sorted(bm25.bm25_topk(asked, two, 3).collect())


ROWS = [("u", "a", 0, "red sky"), ("u", "a", 1, "green"), ("v", "a", 0, "red red grey"), (None, "b", 0, "blue sky blue"), ("u", "c", 0, "green red blue"), ("v", "d", 0, ""), ("v", "e", 0, "red grey sky")]


def test_append_delete_replace_equal_a_rebuilt_index(spark, tmp_path):
    path, folder = str(tmp_path / "index"), lambda n: str(tmp_path / f"again{n}")
    index_store.write_index(*indexed(spark, ROWS[:4]), path)
    index_store.append_index(*indexed(spark, ROWS[4:]), path)
    same_as_rebuilt(spark, path, ROWS, folder(0))
    gone = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "zz"), ("u", "a")], "user_id string, source string")
    index_store.delete_sources(gone, path)  # not v's a, and not b, which is nobody's
    left = [r for r in ROWS if r[:2] != ("u", "a")]
    same_as_rebuilt(spark, path, left, folder(1))
    index_store.delete_sources(gone, path)  # once more changes nothing
    same_as_rebuilt(spark, path, left, folder(2))
    back = [("u", "a", 0, "sky"), (None, "b", 0, "blue"), (None, "b", 1, "green")]
    index_store.replace_sources(*indexed(spark, back), path)
    now = [r for r in left if r[1] != "b"] + back
    same_as_rebuilt(spark, path, now, folder(3))
    index_store.compact_index(spark, path)
    same_as_rebuilt(spark, path, now, folder(4))
    assert index_store.versions(spark, path) == [1, 2, 3, 4, 5, 6]
    assert index_store.read_index(spark, path, 2)["chunks"].count() == len(ROWS)


def test_a_run_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index_store.write_index(*indexed(spark, ROWS[:2]), path)
    pinned = index_store.read_index(spark, path)

    def dies(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(index_store, "_commit", dies)
        try:
            index_store.append_index(*indexed(spark, ROWS[2:]), path)
        except KeyboardInterrupt:
            pass
    assert index_store.versions(spark, path) == [1] and index_store.read_index(spark, path)["chunks"].count() == 2
    (tmp_path / "index" / "versions" / "00000002").write_text('{"parts": ["da')  # a file that was not written to its end
    assert index_store.versions(spark, path) == [1]
    assert index_store.append_index(*indexed(spark, ROWS[2:]), path) == 3
    assert pinned["chunks"].count() == 2 and index_store.read_index(spark, path)["chunks"].count() == len(ROWS)
    assert len(list((tmp_path / "index" / "data").iterdir())) == 3
    assert index_store.expire_versions(spark, path, 1, orphan_seconds=0) == [3]
    assert len(list((tmp_path / "index" / "data").iterdir())) == 2 and index_store.read_index(spark, path)["chunks"].count() == len(ROWS)


def test_of_two_writers_the_second_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index_store.write_index(*indexed(spark, ROWS[:2]), path)
    monkeypatch.setattr(index_store, "_next", lambda *args: 1)
    try:
        index_store.append_index(*indexed(spark, ROWS[2:]), path)
        raise AssertionError("no conflict")
    except index_store.VersionConflict:
        pass
    assert index_store.read_index(spark, path)["chunks"].count() == 2


def test_an_append_counts_the_new_chunks_only(spark, tmp_path):
    path = str(tmp_path / "index")
    index_store.write_index(*indexed(spark, ROWS[:4]), path)
    index_store.append_index(*indexed(spark, [("u", "z", 0, "red violet")]), path)
    newest = max((tmp_path / "index" / "data").iterdir(), key=lambda p: p.name)
    assert {r["term"] for r in spark.read.parquet(str(newest / "counts")).collect()} == {"red", "violet"}
    index_store.reset_index(spark, path)
    empty = index_store.read_index(spark, path)
    assert all(empty[t].count() == 0 for t in ("chunks", "vectors", "postings", "terms")) and empty["collection"].first()["n"] == 0
    asked = spark.createDataFrame([(1, "red")], "query_id long, query string")
    assert bm25.bm25_topk(asked, empty, 1).collect() == []
