"""Hybrid search: keyword and vector hits fused, merged over query variants, reranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import rrf_score

from .bm25 import KEY, bm25_scores, bm25_topk, keyword_index, rank_hits
from .vectors import vector_topk


def min_max(score: Column, by: Window) -> Column:
    """(x - min) / (max - min) within a window; all equal gives 0."""
    low, high = F.min(score).over(by), F.max(score).over(by)
    return F.when(high > low, (score - low) / (high - low)).otherwise(F.lit(0.0))


def candidate_depth(k: int, rerank: bool = False) -> tuple[int, int]:
    """Hits fetched for each query variant, and vector candidates behind them."""
    fetch = k * (3 if rerank else 2)
    return fetch, 3 * fetch


def _of_source(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits from the source that the query asks for, if it does."""
    if "source_filter" not in queries.columns:
        return hits
    wanted = queries.select("query_id", "source_filter")
    return hits.join(wanted, "query_id").where("source_filter IS NULL OR source_filter = '' OR source_filter = source").drop("source_filter")


def search_rrf(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 5, rrf_k: int = 60, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """Reciprocal-rank fusion of the 2k best by keyword and by vector; ranks precede the source filter."""
    words = bm25_topk(queries, index or chunks, 2 * k).select("query_id", "rank", *KEY)
    near = vector_topk(queries, vectors, 2 * k).select("query_id", "rank", *KEY)
    fused = _of_source(words.unionByName(near), queries).groupBy("query_id", *KEY).agg(F.round(F.sum(rrf_score(F.col("rank"), rrf_k)), 6).alias("score"))
    return rank_hits(fused, k).select("query_id", "rank", *KEY, "score")


def search_weighted(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 5, alpha: float = 0.7, threshold: float = 0.0, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """alpha * vector score + (1 - alpha) * normalised keyword score over the 3k nearest vectors.

    Queries without any vector candidate fall back to keyword search; queries whose
    candidates the source filter empties stay empty. index is a keyword index of the chunks;
    without one it is made once for both uses.
    """
    index = index or keyword_index(chunks)
    found = vector_topk(queries, vectors, 3 * k).select("query_id", *KEY, F.col("score").alias("near"))
    kept = _of_source(found, queries)
    words = bm25_scores(queries, index, kept).select("query_id", *KEY, F.col("score").alias("words"))
    by = Window.partitionBy("query_id")
    mixed = kept.join(words, ["query_id", *KEY], "left").withColumn("words", F.coalesce("words", F.lit(0.0)))
    mixed = mixed.withColumn("words", F.when(F.max("words").over(by) > 0, min_max(F.col("words"), by)).otherwise(F.lit(0.0)))
    scored = mixed.select("query_id", *KEY, F.round(alpha * F.col("near") + (1 - alpha) * F.col("words"), 6).alias("score")).where(F.col("score") >= threshold)
    best = rank_hits(scored, k).select("query_id", "rank", *KEY, "score")
    return best.unionByName(bm25_fallback(queries, chunks, found, k, index))


def bm25_fallback(queries: DataFrame, chunks: DataFrame, found: DataFrame, k: int, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """Keyword hits of the queries that have no row in found."""
    return bm25_topk(queries.join(found.select("query_id").distinct(), "query_id", "left_anti"), index or chunks, k)


def hybrid_search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 5, fusion_type: str = "weighted", alpha: float = 0.7, rrf_k: int = 60, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """Weighted fusion, or reciprocal-rank fusion for fusion_type="rrf"."""
    if fusion_type == "rrf":
        return search_rrf(queries, chunks, vectors, k, rrf_k, index)
    return search_weighted(queries, chunks, vectors, k, alpha, index=index)


def dedupe_first(hits: DataFrame) -> DataFrame:
    """(request_id, variant_no, rank, source, chunk_index, score): the first hit of each chunk over the variants, then by score."""
    first = Window.partitionBy("request_id", *KEY).orderBy("variant_no", "rank")
    kept = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "rank")
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), *KEY)
    return kept.withColumn("rank", F.row_number().over(order))


def merge_max(hits: DataFrame, k: int) -> DataFrame:
    """Hits with content: the best score of each 100-character opening, k of each request."""
    best = Window.partitionBy("request_id", F.substring("content", 1, 100)).orderBy(F.desc("score"), "variant_no", "rank")
    kept = hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "rank")
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), *KEY)
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def token_overlap(query: Column, content: Column) -> Column:
    """A stand-in pair scorer: the share of the query's words that the content has."""
    from scriptorium.functions.text import tokenize

    words = F.array_distinct(tokenize(query))
    return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(words, tokenize(content))) / F.size(words))


def rerank(hits: DataFrame, k: int, scorer=token_overlap) -> DataFrame:
    """Hits with query and content, scored anew by a pair scorer against the original query; the k best."""
    scored = hits.drop("rank").withColumn("score", F.round(scorer(F.col("query"), F.col("content")), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *KEY)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


__all__ = ["bm25_topk", "candidate_depth", "dedupe_first", "hybrid_search", "merge_max", "min_max", "rerank", "search_rrf", "search_weighted", "token_overlap"]
