import math
from collections import Counter

import pytest

from scriptorium.operators import bm25, fusion, vectors
from scriptorium.plans import answers

TEXTS = ["the cat sat", "the dog", "the bird sang the song", "", "the"]


def chunk_frame(spark):
    return spark.createDataFrame([(f"s{k}", 0, t, "u1" if k % 2 else "u2") for k, t in enumerate(TEXTS)], "source string, chunk_index int, content string, user_id string")


def expected(query):
    docs = [t.split() for t in TEXTS]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query.split()) for d in docs]


def test_bm25_with_floor(spark):
    queries = spark.createDataFrame([(1, "the cat cat"), (2, "absent")], "query_id long, query string")
    got = {r["source"]: r["score"] for r in bm25.bm25_scores(queries, chunk_frame(spark)).collect()}
    for k, want in enumerate(expected("the cat cat")):
        assert got.get(f"s{k}", 0.0) == pytest.approx(want)
    top = bm25.bm25_topk(queries, chunk_frame(spark), 2).collect()
    assert [(r["query_id"], r["rank"], r["source"]) for r in top] == [(1, 1, "s0"), (1, 2, top[1]["source"])]


def test_vectors(spark):
    vecs = spark.createDataFrame([("a", 0, [1.0, 0.0], "u1"), ("b", 0, [0.6, 0.8], "u2"), ("c", 0, [0.0, 1.0], "u1")], "source string, chunk_index int, embedding array<float>, user_id string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], None), (2, [0.6, 0.8], "u1"), (3, None, None)], "query_id long, query_vec array<float>, user_id string")
    got = {(r["query_id"], r["rank"]): r["source"] for r in vectors.vector_topk(asked, vecs, 2).collect()}
    assert got == {(1, 1): "a", (1, 2): "b", (2, 1): "c", (2, 2): "a"}
    chunks = vecs.select("source", "chunk_index")
    vectors.require_valid(chunks, vecs, 2)
    with pytest.raises(ValueError):
        vectors.require_valid(chunks, vecs, 3)


def test_fusion_and_answers(spark):
    chunks = chunk_frame(spark)
    vecs = vectors.embed(chunks, "content", vectors.hashing_encoder(16)).drop("content")
    queries = vectors.embed(spark.createDataFrame([(1, "cat sat"), (2, "zzz")], "query_id long, query string"), "query", vectors.hashing_encoder(16), "query_vec")
    best = {r["query_id"]: r["source"] for r in fusion.hybrid_search(queries, chunks, vecs, 2).where("rank = 1").collect()}
    assert best[1] == "s0"
    assert fusion.hybrid_search(queries, chunks, vecs, 2, "rrf").where("query_id = 1 and rank = 1").first()["source"] == "s0"
    assert fusion.candidate_depth(5) == (10, 30) and fusion.candidate_depth(5, True) == (15, 45)
    hits = bm25.bm25_topk(queries, chunks, 2).join(chunks, ["source", "chunk_index"])
    out = {r["query_id"]: r for r in answers.answer_requests(queries, hits).collect()}
    assert "--- [Chunk 1] (Source: s0) ---\nthe cat sat" in out[1]["prompt"] and out[1]["note"] is None
    assert out[2]["references"] == [] and out[2]["note"]


def test_merging(spark):
    hits = spark.createDataFrame([(1, 0, 1, "a", 0, 0.5, "same"), (1, 1, 1, "a", 0, 0.9, "same"), (1, 1, 2, "b", 0, 0.7, "other")], "request_id long, variant_no int, rank int, source string, chunk_index int, score double, content string")
    first = {r["source"]: (r["rank"], r["score"]) for r in fusion.dedupe_first(hits).collect()}
    assert first == {"b": (1, 0.7), "a": (2, 0.5)}
    top = {r["source"]: (r["rank"], r["score"]) for r in fusion.merge_max(hits, 5).collect()}
    assert top == {"a": (1, 0.9), "b": (2, 0.7)}


def words(rng, n):
    return " ".join(f"w{int(40 * rng.random() ** 3)}" if rng.random() < 0.7 else f"r{rng.randrange(400)}" for _ in range(n))


@pytest.mark.parametrize("k, few", [(1, 500_000), (4, 500_000), (4, 3), (1000, 500_000)])
def test_pruned_search_is_the_whole_search(spark, k, few, monkeypatch):
    """Frequent and rare words, owners, repeated chunks and ties, with and without broadcasts; with a deep k nothing can be skipped."""
    import random

    rng = random.Random(k)
    monkeypatch.setattr(bm25, "BLOCK_CHUNKS", 2)
    monkeypatch.setattr(bm25, "SEED_POSTINGS", 20)
    monkeypatch.setattr(bm25, "MOST_BROADCAST_TERMS", few)
    rows = [(f"s{k}", j, words(rng, rng.randint(0, 30)), f"u{k % 3}") for k in range(60) for j in range(rng.randint(1, 5))]
    rows += [(f"t{k}", 0, rows[5][2], None) for k in range(10)]
    chunks = spark.createDataFrame(rows, "source string, chunk_index int, content string, user_id string")
    asked = spark.createDataFrame([(f"q/{n}", words(rng, 8) + " absent", [None, "", "u1"][n % 3]) for n in range(9)] + [("none", "absent", None)], "query_id string, query string, user_id string")
    index = bm25.keyword_index(chunks)
    scores = bm25.bm25_scores(asked, index).selectExpr("query_id", "source", "chunk_index", "round(score, 6) AS score")
    want = bm25.rank_hits(scores, k).where("score > 0").select("query_id", "rank", "source", "chunk_index", "score")
    assert sorted(bm25.bm25_topk(asked, index, k).collect()) == sorted(want.collect())


def test_spread(spark):
    """Few splits become as many as there are cores, many stay, and no row is lost or doubled."""
    from scriptorium.storage import spread

    cores = spark.sparkContext.defaultParallelism
    one, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, cores + 1)
    assert spread(one).rdd.getNumPartitions() == cores
    assert spread(many).rdd.getNumPartitions() == cores + 1
    assert sorted(r.id for r in spread(one).collect()) == list(range(100))
    assert spread(one.where("false")).count() == 0


def test_most_pairs_are_not_scored(spark):
    """Of the pairs that share a term under a tenth is scored, and the hits are the same."""
    from scriptorium import catalogue

    sf = "/root/testdata/sf0.01"
    index = bm25.keyword_index(catalogue.chunk_table(spark, sf))
    asked = catalogue.benchmark_queries(spark, sf)
    scores = bm25.bm25_scores(asked, index).selectExpr("query_id", "source", "chunk_index", "round(score, 6) AS score").cache()
    assert 10 * bm25.pruned_scores(asked, index, 5).count() < scores.count()
    want = bm25.rank_hits(scores, 5).where("score > 0").select("query_id", "rank", "source", "chunk_index", "score")
    assert sorted(bm25.bm25_topk(asked, index, 5).collect()) == sorted(want.collect())


def test_vectors_over_many_cells(spark, monkeypatch):
    """Ids of text, owners, ties, rows without a value or of another length, against numpy."""
    import numpy as np

    monkeypatch.setattr(vectors, "QUERIES_PER_CELL", 7)
    monkeypatch.setattr(vectors, "VECTORS_PER_CELL", 50)
    monkeypatch.setattr(vectors, "QUERIES_PER_TILE", 4)
    monkeypatch.setattr(vectors, "VECTORS_PER_TILE", 9)
    rng = np.random.default_rng(3)
    held = [(f"s{n % 40}", n // 40, rng.integers(-1, 2, 4).astype(float).tolist(), f"u{n % 2}") for n in range(230)]
    odd = [("x", 0, None, "u0"), ("x", 1, [1.0], "u0"), ("x", 2, [None, 1.0, 1.0, 1.0], "u0")]
    asked = [(f"r{n}/{n % 3}", rng.integers(-2, 3, 4).astype(float).tolist(), [None, "", "u1", "none"][n % 4]) for n in range(30)] + [("null", None, None)]
    got = vectors.vector_topk(spark.createDataFrame(asked, "query_id string, query_vec array<float>, user_id string"), spark.createDataFrame(held + odd, "source string, chunk_index int, embedding array<float>, user_id string"), 6)
    want = []
    for q, v, user in asked[:-1]:
        near = sorted((-float(np.dot(v, w)), s, c) for s, c, w, owner in held if not user or user == owner)
        want += [(q, rank, s, c, -score) for rank, (score, s, c) in enumerate(near[:6], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    nothing = spark.createDataFrame([], "source string, chunk_index int, embedding array<float>, user_id string")
    assert vectors.vector_topk(spark.createDataFrame(asked, "query_id string, query_vec array<float>, user_id string"), nothing, 6).count() == 0


def test_equal_vectors_leave_a_task_k_at_a_time():
    import pyarrow as pa

    one = pa.list_(pa.float32())
    held = pa.table([pa.array([f"{n:05d}" for n in range(20_000)]), pa.array([0] * 20_000, pa.int32()), pa.array([[1.0, 0.0]] * 20_000, one), pa.array([None] * 20_000, pa.string())], names=["source", "chunk_index", "vec", "user_id"])
    asked = pa.table([pa.array(["a", "b"]), pa.array([[1.0, 2.0], [0.0, 1.0]], one), pa.array([None, None], pa.string())], names=["query_id", "vec", "user_id"])
    best = vectors._best_in_cell(asked, held, 5, 6)
    assert best.column("source").to_pylist() == [f"{n:05d}" for n in range(5)] * 2


def test_ask(spark):
    chunks = chunk_frame(spark).drop("user_id")
    vecs = vectors.embed(chunks, "content", vectors.hashing_encoder(16)).drop("content")
    requests = spark.createDataFrame([(1, "cat", '["bird song", "dog"]'), (2, "", None), (3, "dog", "no list")], "request_id long, query string, response string")
    embedded = lambda rows: vectors.embed(rows, "query", vectors.hashing_encoder(16), "query_vec")
    for merge in ("first", "max"):
        out = {r["query_id"]: r for r in answers.ask(requests, chunks, vecs, embedded, 3, reranked=True, merge=merge).collect()}
        assert [r["source"] for r in out[1]["references"]][0] == "s0" and len(out[1]["references"]) == 3 and out[3]["references"][0]["source"] == "s1"
        plain = {r["query_id"]: r for r in answers.ask(requests, chunks, vecs, embedded, 2, rewrites=0, merge=merge).collect()}
        assert plain.keys() == {1, 2, 3} and len(plain[1]["references"]) == 2 and plain[1]["references"][0]["source"] == "s0"
