"""Keyword search as one pass over the chunks' rows."""

import random

import pytest

from scriptorium import catalogue
from scriptorium.operators import bm25
from scriptorium.sources import index_store

CHUNK = "source string, chunk_index int, content string, user_id string"
ASKED = "query_id long, query string, user_id string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_task_hands_on_k_hits_a_query(spark):
    """Equal chunks cannot be told apart by bounds; before, all of them were handed on."""
    chunks = spark.createDataFrame([(f"s{n:04d}", 0, "red sky", None) for n in range(600)] + [(f"t{n}", 0, "blue", None) for n in range(900)], CHUNK)
    asked = spark.createDataFrame([(1, "red", None), (2, "red sky", None), (3, "none", None)], ASKED)
    index = bm25.keyword_index(chunks)
    found = bm25.pruned_scores(asked, index, 2)
    assert found.count() <= 2 * 2 * index["postings"].rdd.getNumPartitions()
    assert [(r["query_id"], r["rank"], r["source"]) for r in bm25.bm25_topk(asked, index, 2).orderBy("query_id", "rank").collect()] == [(q, n + 1, f"s000{n}") for q in (1, 2) for n in (0, 1)]


def test_pairs_are_scored_without_a_shuffle(spark):
    chunks = spark.createDataFrame([("a", 0, "red sky", "u"), ("b", 0, "red", None)], CHUNK)
    scores = bm25.bm25_scores(spark.createDataFrame([(1, "red", None), (2, "red", "u")], ASKED), bm25.keyword_index(chunks))
    assert "Exchange" not in plan(scores)
    assert sorted((r["query_id"], r["source"]) for r in scores.collect()) == [(1, "a"), (1, "b"), (2, "a")]


@pytest.mark.parametrize("cells, seeds", [(1, 0), (40, 1), (1 << 20, 100)])
def test_blocks_of_any_size_give_the_same_hits(cells, seeds, monkeypatch):
    """Against plain Python: ties, owners, frequent and missing terms, chunks without tokens."""
    import pyarrow as pa

    monkeypatch.setattr(bm25, "BLOCK_CELLS", cells)
    monkeypatch.setattr(bm25, "SEED_POSTINGS", seeds)
    rng = random.Random(cells)
    rows = [(f"s{rng.randrange(40):02d}", n, rng.choice(["u", "v", None]), sorted(rng.choice("aabbcdefxyz") for _ in range(rng.randrange(7)))) for n in range(300)]
    queries = {(7, None): "aab", (8, "u"): "bcd", (9, "nobody"): "a", (10, None): "fff", (11, None): "q"}
    idf = {t: 1 + n / 3 for n, t in enumerate("abcdefq")}
    wanted = [(q, u, t, s.count(t), idf[t], 3.0) for (q, u), s in queries.items() for t in sorted(set(s))]
    rng.shuffle(wanted)
    asked = bm25._Asked(pa.table([pa.array(c, t) for c, t in zip(zip(*wanted), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64()))], names=["query_id", "asking", "term", "times", "idf", "avgdl"]))
    post = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())))], names=["source", "chunk_index", "user_id", "tokens"])
    want = {}
    for (q, user), s in queries.items():
        for source, n, owner, tokens in rows:
            if set(tokens) & set(s) and (user is None or user == owner):
                want[q, source, n] = sum(s.count(t) * idf[t] * tokens.count(t) * 2.5 / (tokens.count(t) + 1.5 * (0.25 + 0.75 * len(tokens) / 3)) for t in set(s))
    got = {(r["query_id"], r["source"], r["chunk_index"]): r["score"] for b in bm25._all_hits(iter(post.to_batches(70)), asked) for r in b.to_pylist()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    for k in (1, 6, 1000):
        best = [(r["query_id"], r["source"], r["chunk_index"]) for b in bm25._best_hits(iter(post.to_batches(70)), asked, k, 6) for r in b.to_pylist()]
        order = {q: sorted((x for x in want if x[0] == q), key=lambda x: (-round(want[x], 6), *x[1:]))[:k] for q in (7, 8, 9, 10, 11)}
        assert sorted(best) == sorted(x for hits in order.values() for x in hits)


def test_blocks_without_a_shared_term_have_the_schema_of_others():
    """A block that shares no term with any query gave integer scores, at which the task failed."""
    import pyarrow as pa

    asked = bm25._Asked(pa.table({"query_id": [7], "asking": pa.array([None], pa.string()), "term": ["a"], "times": [1], "idf": [1.0], "avgdl": [1.0]}))
    post = pa.table({"source": ["s", "t"], "chunk_index": pa.array([0, 0], pa.int32()), "user_id": pa.array([None, None], pa.string()), "tokens": [["a"], ["b"]]})
    assert [str(b.schema.field("score").type) for b in bm25._all_hits(iter(post.to_batches(1)), asked)] == ["double", "double"]


def test_scores_are_rounded_as_by_round(spark):
    """Ties, neighbours of ties, negative and large values, with and without candidates."""
    import numpy as np

    rng = random.Random(5)
    values = [0.0, -0.0, 5e-7, -5e-7, 1.0000005, 2.5e-6, 0.1234565, 4e-7, -4e-7, 123456789.1234565, 1e15 + 0.5, 3e17, -2.0000015] + [rng.uniform(-40, 40) for _ in range(3000)]
    values += [float(np.nextafter(n / 1e6 + 5e-7, way)) for n in range(300) for way in (-1e9, 1e9)] + [n / 1e6 + 5e-7 for n in range(300)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").selectExpr("v", "round(v, 6) AS want").collect()
    got = bm25._half_up(np.array([r["v"] for r in frame]), 6).tolist()
    assert [(r["v"], repr(r["want"])) for r in frame] == [(r["v"], repr(g)) for r, g in zip(frame, got)]
    chunks = spark.createDataFrame([("a", 0, "red sky", "u"), ("b", 0, "red", None), ("c", 1, "blue", None)], CHUNK)
    asked, index = spark.createDataFrame([(1, "red", None), (2, "red blue", None)], ASKED), bm25.keyword_index(chunks)
    for pairs in (None, spark.createDataFrame([(1, "a", 0), (2, "c", 1)], "query_id long, source string, chunk_index int")):
        whole = bm25.bm25_scores(asked, index, pairs).selectExpr("query_id", "source", "chunk_index", "round(score, 3) AS score")
        assert sorted(bm25.bm25_scores(asked, index, pairs, digits=3).collect()) == sorted(whole.collect())


def test_pairs_of_plain_chunks_write_no_postings(spark, monkeypatch):
    """Only counts are written for a single search of plain chunks; the pairs are those of a written index."""
    written, store = [], bm25.stored
    chunks = spark.createDataFrame([("a", 0, "red sky", "u"), ("b", 0, "red", None), ("c", 0, "blue", None), ("c", 1, "", None)], CHUNK)
    asked = spark.createDataFrame([(1, "red", None), (2, "red", "u"), (3, "blue sky", None)], ASKED)
    want = bm25.bm25_scores(asked, bm25.keyword_index(chunks))
    monkeypatch.setattr(bm25, "stored", lambda df, name: (written.append(name), store(df, name))[1])
    got = bm25.bm25_scores(asked, chunks)
    assert "Exchange" not in plan(got) and sorted(got.collect()) == sorted(want.collect()) and got.count() == 5
    assert set(written) == {"counts", "collection", "wanted"}


def test_an_index_part_holds_no_second_copy_of_its_postings(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, "red sky", "u"), ("b", 0, "", "u")], CHUNK)
    path = str(tmp_path / "index")
    index_store.write_index(chunks, chunks.selectExpr("user_id", "source", "chunk_index", "array(1f) AS embedding"), path)
    (part,) = (tmp_path / "index" / "data").iterdir()
    assert {p.name for p in part.iterdir()} == {"chunks", "vectors", "postings", "counts", "totals", "deleted"}
    assert spark.read.parquet(f"{part}/postings").count() == 2 and spark.read.parquet(f"{part}/totals").first().asDict() == {"n": 2, "tokens": 2}


def test_few_hits_go_to_the_chunks(spark, monkeypatch):
    """The chunks are not shuffled to look up the content of a few hits."""
    monkeypatch.setattr(bm25, "MOST_BROADCAST_TERMS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = spark.range(100).selectExpr("cast(id AS string) AS source", "0 AS chunk_index", "'x' AS content")
        joined = catalogue._with_content(spark.createDataFrame([(1, "3", 0)], "query_id long, source string, chunk_index int"), chunks)
        assert "SortMergeJoin" not in plan(joined) and [r["source"] for r in joined.collect()] == ["3"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_chunks_leave_a_task_in_bounded_batches(monkeypatch):
    """Many chunks are handed on a few at a time, whatever the number of texts in a batch; a source may be a struct."""
    import pyarrow as pa

    from scriptorium.operators import chunking

    monkeypatch.setattr(chunking, "CHUNKS_AT_ONCE", 5)
    names = ["source", "chunk_index", "start_char", "end_char", "content"]
    owned = pa.struct([("source", pa.string()), ("owner", pa.string())])
    shape = pa.schema(list(zip(names, (owned, pa.int32(), pa.int32(), pa.int32(), pa.string()))))
    texts = ["word " * n for n in range(60)] + [None, " "]
    batch = pa.RecordBatch.from_arrays([pa.array([{"source": str(n), "owner": "u"} for n in range(62)], owned), pa.array(texts)], names=["source", "content"])
    out = list(chunking._cut_in_batches(iter([batch, batch]), 40, 5, "burst", shape))
    most = max(len(chunking.chunk_rows(t, 40, 5)) for t in texts)
    assert len(out) > 2 and all(b.num_rows < 5 + most for b in out)
    got = [(r["source"]["source"], r["chunk_index"], r["content"]) for b in out for r in b.to_pylist()]
    assert got == 2 * [(str(n), c["chunk_index"], c["content"]) for n, t in enumerate(texts) for c in chunking.chunk_rows(t, 40, 5)]


def test_semantic_parts_are_read_as_they_are_needed(monkeypatch):
    from scriptorium.operators import chunking

    monkeypatch.setattr(chunking, "SENTENCES_AT_ONCE", 3)
    read = []
    texts = ((read.append(n), (str(n), "x", ["x"] * (n % 2)))[1] for n in range(9))
    first = next(chunking._parts(texts))
    assert [d[0] for d in first] == ["0", "1", "2"] and read == [0, 1, 2]


def test_owners_travel_without_a_join(spark, monkeypatch):
    """The chunks that are indexed are not shuffled to learn their owner."""
    seen = []
    monkeypatch.setattr(catalogue, "stored", lambda df, name: (seen.append(plan(df)), df)[1])
    catalogue._index_in_steps(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and "Join" not in seen[0]


def test_texts_are_encoded_some_at_a_time(spark, monkeypatch):
    """A call to an encoder is bounded by characters, not by the rows of a batch."""
    import pandas as pd

    from scriptorium.operators import vectors

    monkeypatch.setattr(vectors, "CHARACTERS_AT_ONCE", 10)
    parts = list(vectors._encoded_at_once(pd.Series(["abc", None, "x" * 30, "defg", "hijklm", "n"])))
    assert parts == [["abc", ""], ["x" * 30], ["defg", "hijklm"], ["n"]] and list(vectors._encoded_at_once(pd.Series([], dtype=object))) == []
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(["a b", None, "", "c"])], "n long, text string")
    got = [r["embedding"] for r in vectors.embed(rows, "text", vectors.hashing_encoder(4)).orderBy("n").collect()]
    assert got[1] == got[2] == [0.0] * 4 and all(abs(sum(x * x for x in got[k]) - 1) < 1e-6 for k in (0, 3))


def test_texts_are_normalised_some_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from scriptorium.functions import text

    monkeypatch.setattr(text, "TEXTS_AT_ONCE", 2)
    assert text._nfkc(pa.array(["①", None, "é", "a", "ﬁ"])).to_pylist() == ["1", None, "é", "a", "fi"] and text._nfkc(pa.array([], pa.string())).to_pylist() == []
    rows = spark.createDataFrame([(0, "Ａ①"), (1, None), (2, "plain")], "n long, text string")
    assert [r["t"] for r in rows.select("n", text.normalize_unicode(rows["text"]).alias("t")).orderBy("n").collect()] == ["A1", None, "plain"]


def test_chunks_that_are_read_once_are_not_stored(spark, monkeypatch):
    """The keyword index reads its chunks once, so only its own tables are written."""
    names, write = [], bm25.stored
    for module in (catalogue, bm25):
        monkeypatch.setattr(module, "stored", lambda df, name: (names.append(name), write(df, name))[1])
    assert catalogue.k1_bm25_index(spark, "/root/testdata/sf0.001").limit(1).count() == 1 and sorted(names) == ["collection", "counts", "postings"]


def test_terms_and_the_collection_are_counted_in_one_pass(spark):
    """Tasks hand on a row for each term, not for each posting; chunks without tokens count, missing tokens are no terms."""
    rows = [(["a", "a", "b"],), ([],), (["b"],), (["b", None],), (["a", "c"],)]
    counts = bm25.counted(spark.createDataFrame(rows, "tokens array<string>").coalesce(1))
    assert "Generate" not in plan(counts)
    assert {r["term"]: (r["df"], r["tokens"]) for r in counts.collect()} == {None: (5, 8), "a": (2, None), "b": (3, None), "c": (1, None)}
    empty = bm25.keyword_index(spark.createDataFrame([], CHUNK))
    assert empty["collection"].first().asDict() == {"n": 0, "avgdl": None} and empty["terms"].count() == 0


def test_texts_are_not_shuffled_for_their_labels(spark, monkeypatch):
    """Labels go to the documents, whatever Spark thinks of the size of the vectors; too many are joined, with the same rows."""
    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = catalogue._whole(spark, sf)
        assert "BroadcastHashJoin" in plan(sent) and "SortMergeJoin" not in plan(sent)
        monkeypatch.setattr(catalogue, "MOST_LABELS", 1)
        dealt = catalogue._whole(spark, sf)
        assert "SortMergeJoin" in plan(dealt)
        assert sorted(sent.collect(), key=repr) == sorted(dealt.collect(), key=repr)
        assert sent.where("user_id IS NOT NULL").count() == spark.read.parquet(f"{sf}/embeddings.parquet").join(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS vec_id"), "vec_id").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
