"""From queries to cited prompts: expansion, merging, references, prompt texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import parse_query_list, references
from scriptorium.operators.bm25 import KEY, keyword_index, small
from scriptorium.operators.fusion import candidate_depth, dedupe_first, hybrid_search, merge_max, rerank, token_overlap
from scriptorium.storage import stored

#: Our own instruction text; a caller may pass another.
SYSTEM_TEXT = "Answer from the context below, completely and in a clear order. Name the chunks you rely on. Say so if the context holds no answer."
NOTHING_FOUND = "No matching passage was found."


def expand_queries(requests: DataFrame, n: int = 3) -> DataFrame:
    """(request_id, query, response) to (request_id, variant_no, query): the original first, then up to n rewrites parsed from a model's response."""
    rewrites = F.slice(F.coalesce(parse_query_list(F.col("response")), F.array().cast("array<string>")), 1, n)
    return requests.select("request_id", F.posexplode(F.concat(F.array("query"), rewrites)).alias("variant_no", "query"))


def context_part(rank: Column, source: Column, content: Column) -> Column:
    return F.concat(F.lit("--- [Chunk "), rank.cast("string"), F.lit("] (Source: "), F.coalesce(source, F.lit("unknown")), F.lit(") ---\n"), content, F.lit("\n"))


def build_prompts(queries: DataFrame, hits: DataFrame, system: str = SYSTEM_TEXT) -> DataFrame:
    """(query_id, prompt) for every query; hits(query_id, rank, source, content) are bounded by top k."""
    parts = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", context_part(F.col("rank"), F.col("source"), F.col("content")).alias("part")))).alias("parts"))
    context = F.array_join(F.transform(F.coalesce("parts", F.array().cast("array<struct<rank:int,part:string>>")), lambda p: p["part"]), "\n")
    prompt = F.concat(F.lit(system + "\n\n[Context]\n"), context, F.lit("\n\n[Question]\n"), "query", F.lit("\n\n[Answer]\n"))
    return queries.join(parts, "query_id", "left").select("query_id", prompt.alias("prompt"))


def answer_requests(queries: DataFrame, hits: DataFrame, system: str = SYSTEM_TEXT) -> DataFrame:
    """(query_id, prompt, references, note); queries without hits have no references and a note."""
    cited = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", references(F.col("content"), F.col("source"), F.col("score")).alias("r")))).alias("c"))
    listed = F.coalesce(F.transform("c", lambda x: x["r"]), F.array().cast("array<struct<content:string,source:string,score:double>>"))
    return build_prompts(queries, hits, system).join(cited, "query_id", "left").select("query_id", "prompt", listed.alias("references"), F.when(F.col("c").isNull(), NOTHING_FOUND).alias("note"))


def ask(
    requests: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    embedded: Callable[[DataFrame], DataFrame],
    k: int = 5,
    rewrites: int = 3,
    reranked: bool = False,
    scorer=token_overlap,
    merge: str = "first",
    fusion_type: str = "weighted",
    alpha: float = 0.7,
    index: dict[str, DataFrame] | None = None,
    system: str = SYSTEM_TEXT,
) -> DataFrame:
    """(query_id, prompt, references, note): one row for each of requests (request_id, query, response).

    Each request's query and the rewrites parsed from its response are searched together, at
    the depth that candidate_depth gives for k; user_id and source_filter of a request hold
    for all of them. embedded adds query_vec to rows (query_id, request_id, variant_no,
    query). The hits of a request are merged, by their first variant (merge="first") or by the
    best score of an opening (merge="max"), reranked against the request's own query if
    wanted, and cut to k. query_id of the result is the request_id; requests are unique by it.
    A response that holds no list leaves the query alone; no hits give a note.
    """
    fetch, _ = candidate_depth(k, reranked)
    wanted = [c for c in ("user_id", "source_filter") if c in requests.columns]
    variants = expand_queries(requests, rewrites).join(requests.select("request_id", *wanted), "request_id")
    named = variants.withColumn("query_id", F.concat_ws("/", F.col("request_id").cast("string"), F.col("variant_no").cast("string")))
    asked = stored(embedded(named), "variants")
    found = hybrid_search(asked, chunks, vectors, fetch, fusion_type, alpha, index=index or keyword_index(chunks))
    hits = stored(found.join(asked.select("query_id", "request_id", "variant_no"), "query_id").drop("query_id"), "hits")
    held = chunks.select(*KEY, "content")  # few hits go to where the chunks are
    if merge == "max":
        merged = merge_max(held.join(small(hits), KEY), fetch * (rewrites + 1))
    else:
        merged = held.join(small(stored(dedupe_first(hits), "hits")), KEY)
    merged = merged.withColumnRenamed("request_id", "query_id")
    own = requests.select(F.col("request_id").alias("query_id"), "query")
    best = rerank(merged.join(own, "query_id"), k, scorer) if reranked else merged.where(F.col("rank") <= k)
    return answer_requests(own, stored(best.select("query_id", "rank", *KEY, "content", "score"), "hits"), system)
