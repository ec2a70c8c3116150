"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Equal vectors are one node. Nodes are dealt into shards by hash; a task builds the graph of a
shard layer by layer from the top and writes it as one row of flat arrays. Queries visit every
shard in blocks; each cell of shard and block gives its best nodes, measured exactly, and these
are merged by query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Nodes of a shard, and queries that meet one copy of a shard's graph.
SHARD_NODES, BLOCK_QUERIES = 8192, 4096
#: Links of a node in an upper layer (twice that in the lowest), and nodes kept in view while building and searching.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 64, 160
#: Tasks that build shards, at most.
MOST_TASKS = 10_000
#: Rows inserted or searched at once, and nodes opened in one step of a search.
AT_ONCE, OPENED = 256, 4
#: Rows that equal vectors show at most, and so one more than the most neighbours that a query can ask for.
MEMBERS = 101

_GRAPH = "dim int, shard int, nodes array<long>, vectors array<double>, layers array<int>, links array<int>"


def _distances(vectors: np.ndarray, squares: np.ndarray, at: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Squared distances, less the square of the asked one: smaller is nearer."""
    return squares[at] - 2 * np.matmul(vectors[at], asked[:, :, None])[:, :, 0]


def beam(vectors: np.ndarray, squares: np.ndarray, links: np.ndarray, asked: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row asked the `width` nearest nodes found from its entry nodes, nearest first, with their distances (-1 and inf: none)."""
    n, rows = len(vectors), np.arange(len(asked))
    seen = np.zeros((len(asked), n), dtype=bool)
    ids = np.full((len(asked), width), -1, dtype=np.int64)
    far = np.full((len(asked), width), np.inf, dtype=np.float32)
    closed = np.ones((len(asked), width), dtype=bool)
    ids[:, 0], far[:, 0], closed[:, 0] = entry, _distances(vectors, squares, entry[:, None], asked)[:, 0], False
    seen[rows, entry] = True
    active = rows
    while len(active):
        waiting = np.where(closed[active], np.inf, far[active])
        best = np.argsort(waiting, axis=1, kind="stable")[:, :OPENED]
        going = np.isfinite(np.take_along_axis(waiting, best, axis=1))
        some = going[:, 0]
        active, best, going = active[some], best[some], going[some]
        if not len(active):
            break
        node = np.where(going, ids[active[:, None], best], -1)
        closed[active[:, None], best] |= going
        near = np.where(node[:, :, None] >= 0, links[np.maximum(node, 0)], -1).reshape(len(active), -1)
        key = np.where(near >= 0, active[:, None] * n + near, -1).ravel()
        _, first = np.unique(key, return_index=True)
        fresh = np.zeros(len(key), dtype=bool)
        fresh[first] = True
        fresh = fresh.reshape(near.shape) & (near >= 0)
        fresh &= ~seen[active[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        found = np.full(near.shape, np.inf, dtype=np.float32)
        found[r, c] = squares[near[r, c]] - 2 * np.einsum("ij,ij->i", vectors[near[r, c]], asked[active[r]])
        all_ids, all_far, all_closed = np.concatenate([ids[active], near], axis=1), np.concatenate([far[active], found], axis=1), np.concatenate([closed[active], ~fresh], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        far[active] = np.take_along_axis(all_far, order, axis=1)
        ids[active] = np.where(np.isfinite(far[active]), np.take_along_axis(all_ids, order, axis=1), -1)
        closed[active] = np.take_along_axis(all_closed, order, axis=1)
    return ids, far


def choose(vectors: np.ndarray, ids: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first, -1: none) at most `most`: those nearer to the row than to any one chosen before, then the nearest of the rest."""
    width = ids.shape[1]
    if width <= most:
        return np.pad(ids, ((0, 0), (0, most - width)), constant_values=-1)
    here = vectors[np.maximum(ids, 0)]
    square = np.einsum("bcd,bcd->bc", here, here)
    between = square[:, None, :] + square[:, :, None] - 2 * np.matmul(here, here.transpose(0, 2, 1))
    shadows = between <= far[:, None, :]  # whether the first, once chosen, is nearer to the second than the row is
    free, taken, room = ids >= 0, np.zeros(ids.shape, dtype=bool), np.full(len(ids), most)
    for c in range(width):
        new = free[:, c] & (room > 0)
        taken[:, c] = new
        room -= new
        free &= ~(shadows[:, c] & new[:, None])
    rank = np.where(ids < 0, 2 * width, np.where(taken, 0, width)) + np.arange(width)
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, axis=1)


def _link_back(vectors: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
    """Adds the reverse of the new nodes' links; a node with too many chooses anew."""
    most = links.shape[1]
    source, target = np.repeat(new, most), links[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    if not len(target):
        return
    old, slot = np.nonzero(links[np.unique(target)] >= 0)
    touched = np.unique(target)
    a, b = np.concatenate([touched[old], target]), np.concatenate([links[touched[old], slot], source])
    a, b = np.unique(a * len(links) + b) // len(links), np.unique(a * len(links) + b) % len(links)
    gap = ((vectors[a] - vectors[b]) ** 2).sum(axis=1)
    order = np.lexsort((gap, a))
    a, b, gap = a[order], b[order], gap[order]
    begin = np.searchsorted(a, touched)
    place = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
    near = place < 3 * most  # a hub chooses among its nearest
    row = np.searchsorted(touched, a)
    wide = int(place[near].max()) + 1
    ids, far = np.full((len(touched), wide), -1, dtype=np.int64), np.full((len(touched), wide), np.inf, dtype=np.float32)
    ids[row[near], place[near]], far[row[near], place[near]] = b[near], gap[near]
    for lo in range(0, len(touched), AT_ONCE):
        links[touched[lo : lo + AT_ONCE]] = choose(vectors, ids[lo : lo + AT_ONCE], far[lo : lo + AT_ONCE], most)


@dataclass
class Graph:
    """Nodes in order of their highest layer; links[l] has the flat rows of the first sizes[l] nodes."""

    vectors: np.ndarray
    links: list[np.ndarray]

    def __post_init__(self):
        self.squares = np.einsum("ij,ij->i", self.vectors, self.vectors)

    def enter(self, asked: np.ndarray, layer: int) -> np.ndarray:
        """An entry node of a layer for each row asked: the nearest found in the layers above."""
        entry = np.zeros(len(asked), dtype=np.int64)
        for upper in reversed(range(layer + 1, len(self.links))):
            n = len(self.links[upper])
            entry = beam(self.vectors[:n], self.squares[:n], self.links[upper], asked, entry, 8)[0][:, 0]
        return entry

    def search(self, asked: np.ndarray, width: int) -> np.ndarray:
        parts = [asked[lo : lo + AT_ONCE] for lo in range(0, len(asked), AT_ONCE)]
        return np.concatenate([np.zeros((0, width), dtype=np.int64), *(beam(self.vectors, self.squares, self.links[0], p, self.enter(p, 0), width)[0] for p in parts)])


def scaled(vectors: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Vectors moved and scaled as the vectors `like` need it, so that single precision serves to find the way."""
    centre = like.mean(axis=0)
    return ((vectors - centre) / (np.abs(like - centre).max() or 1.0)).astype(np.float32)


def build(vectors: np.ndarray, highest: np.ndarray) -> Graph:
    """The graph of vectors that lie in order of their highest layer, topmost first."""
    graph = Graph(vectors, [np.full(((highest >= layer).sum(), LINKS * (2 if layer == 0 else 1)), -1, dtype=np.int64) for layer in range(int(highest.max(initial=0)) + 1)])
    for layer in reversed(range(len(graph.links))):
        links = graph.links[layer]
        done = 0
        while done < len(links):
            new = np.arange(done, min(len(links), done + min(AT_ONCE, max(32, done))))
            asked = vectors[new]
            between = graph.squares[new][None, :] - 2 * asked @ asked.T
            np.fill_diagonal(between, np.inf)
            inside = np.argsort(between, axis=1, kind="stable")[:, : min(LINKS, len(new) - 1)]
            ids, far = new[inside], np.take_along_axis(between, inside, axis=1)
            if done:
                entry = np.minimum(graph.enter(asked, layer), done - 1)
                found, gap = beam(vectors[:done], graph.squares[:done], links[:done], asked, entry, BUILD_WIDTH)
                ids, far = np.concatenate([ids, found], axis=1), np.concatenate([far, gap], axis=1)
                order = np.argsort(far, axis=1, kind="stable")
                ids, far = np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)
            links[new, :LINKS] = choose(vectors, ids, far + graph.squares[new][:, None], LINKS)
            _link_back(vectors, links, new)
            done = int(new[-1]) + 1
    return graph


def _built(table: pa.Table) -> pa.Table:
    dim, shard = table.column("dim")[0].as_py(), table.column("shard")[0].as_py()
    nodes = table.column("node").to_numpy()
    order = np.argsort(nodes, kind="stable")
    draw = np.random.default_rng([dim, shard]).random(len(nodes))
    highest = np.floor(-np.log(1 - draw) / np.log(LINKS)).astype(np.int64)
    order = order[np.argsort(-highest, kind="stable")]
    vectors = table.column("vec").combine_chunks().flatten().to_numpy().reshape(len(nodes), dim)[order]
    graph = build(scaled(vectors, vectors), np.sort(highest)[::-1])
    row = {"dim": dim, "shard": shard, "nodes": nodes[order], "vectors": vectors.ravel(), "layers": [len(x) for x in graph.links], "links": np.concatenate([x.ravel() for x in graph.links])}
    kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.table([pa.array([v], t) for v, t in zip(row.values(), kinds)], names=list(row))


def _searched(graphs: pa.Table, asked: pa.Table, keep: int, width: int) -> pa.Table:
    """The best nodes of one shard for a block of queries, with exact distances."""
    out: list[list[np.ndarray]] = [[], [], []]
    if asked.num_rows:
        queries = asked.column("node").to_numpy()
        wanted = asked.column("vec").combine_chunks().flatten().to_numpy().reshape(len(queries), -1)
        for row in range(graphs.num_rows):
            nodes, vectors, layers, flat = (graphs.column(c)[row].values.to_numpy() for c in ("nodes", "vectors", "layers", "links"))
            vectors = vectors.reshape(len(nodes), -1)
            links, at = [], 0
            for layer, n in enumerate(layers.tolist()):
                many = LINKS * (2 if layer == 0 else 1)
                links.append(flat[at : at + n * many].reshape(n, many))
                at += n * many
            found = Graph(scaled(vectors, vectors), links).search(scaled(wanted, vectors), min(width, len(nodes)))
            for lo in range(0, len(queries), AT_ONCE):
                near = found[lo : lo + AT_ONCE]
                gap = np.sqrt(((vectors[np.maximum(near, 0)] - wanted[lo : lo + AT_ONCE, None, :]) ** 2).sum(axis=2))
                gap[near < 0] = np.inf
                ids = nodes[np.maximum(near, 0)]
                best = np.lexsort((ids, gap), axis=1)[:, :keep]
                ok = np.take_along_axis(near, best, axis=1) >= 0
                for k, x in enumerate((np.repeat(queries[lo : lo + AT_ONCE, None], best.shape[1], axis=1), np.take_along_axis(ids, best, axis=1), np.take_along_axis(gap, best, axis=1))):
                    out[k].append(x[ok])
    columns = [np.concatenate([np.zeros(0, dtype=t), *x]) for x, t in zip(out, (np.int64, np.int64, np.float64))]
    return pa.table([pa.array(c) for c in columns], names=["query", "node", "score"])


def _valid(rows: DataFrame) -> DataFrame:
    """(vec_id, vec, dim) of the rows that take part."""
    vec = F.transform("vec", lambda x: x.cast("double"))
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
    bad: Column = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return plain.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0)).withColumn("dim", F.size("vec"))


def build_index(rows: DataFrame, shard_nodes: int = SHARD_NODES) -> dict[str, DataFrame]:
    """The stored index of rows (vec_id, vec): nodes (node, vec, dim, members) and graphs, a row for each shard.

    A node is named by the smallest vec_id of its equal vectors; members has the smallest
    MEMBERS of them, more than a query can return. Rows with a null id, and null, zero or
    empty vectors or such with null or non-finite components, are left out. Vectors of
    different lengths lie in different shards. Repeated rows count once. Other columns are
    not read; an empty table gives an empty index. A shard is one task's work and memory:
    shard_nodes vectors and their links; more rows make more shards.
    """
    first = Window.partitionBy("vec").orderBy("vec_id")
    shown = _valid(rows).dropDuplicates(["vec", "vec_id"]).withColumn("place", F.row_number().over(first)).where(F.col("place") <= MEMBERS)
    nodes = shown.groupBy("vec", "dim").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("members"))
    nodes = materialise(nodes, "nodes")
    shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard_nodes).alias("shards"))
    dealt = nodes.join(shards, "dim").select("dim", F.pmod(F.xxhash64("node", F.lit(11)), "shards").cast("int").alias("shard"), "node", "vec")
    tasks = min(MOST_TASKS, max(1, -(-nodes.count() // shard_nodes)))  # small rows, long work: a shard a task
    dealt = dealt.repartition(tasks, "dim", "shard")
    return {"nodes": nodes, "graphs": materialise(dealt.groupBy("dim", "shard").applyInArrow(_built, _GRAPH), "graphs")}


def search(index: dict[str, DataFrame], queries: DataFrame, k: int = 10, width: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row of queries (vec_id, vec).

    A query does not find its own vec_id; equal distances go to the smaller vec_id; fewer rows
    come back if there are fewer. Queries that _valid leaves out, or without a vector of their
    length in the index, give no row. Equal query vectors are searched once. Distances are
    Euclidean in double precision, on the vectors as given.
    """
    if k >= MEMBERS:
        raise ValueError(f"k must be below {MEMBERS}")
    asked = _valid(queries).dropDuplicates(["vec_id", "vec"])
    wanted = materialise(asked.groupBy("vec", "dim").agg(F.min("vec_id").alias("node")), "asked")
    blocks = max(1, -(-wanted.count() // BLOCK_QUERIES))
    graphs = index["graphs"].withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    shards = index["graphs"].select("dim", "shard").toDF("dim", "shard")
    dealt = wanted.join(shards, "dim").select("dim", "shard", F.pmod(F.xxhash64("node", F.lit(7)), F.lit(blocks)).cast("int").alias("block"), "node", "vec")
    by = ["dim", "shard", "block"]
    found = dealt.groupBy(*by).cogroup(graphs.groupBy(*by)).applyInArrow(lambda a, g: _searched(g, a, k + 1, max(width, k + 1)), "query long, node long, score double")
    order = Window.partitionBy("query").orderBy("score", "node")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    rows = best.join(index["nodes"].select("node", "members"), "node").select("query", F.explode(F.slice("members", 1, k + 1)).alias("vec_id"), "score")
    near = rows.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, (k + 1) ** 2).alias("near"))
    near = materialise(near.join(wanted.select(F.col("node").alias("query"), F.col("vec").alias("of")), "query"), "near")
    each = asked.join(near, asked["vec"] == near["of"]).select(F.col("vec_id").alias("query_id"), "near")
    own = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    return each.select("query_id", F.posexplode(F.slice(own, 1, k)).alias("place", "hit")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
