"""Approximate nearest neighbours by learned partitions (after Neural LSH: Dong, Indyk, Razenshteyn and Wagner, 2020).

On a sample of bounded size a neighbour graph is cut into balanced parts, by bisection along the widest direction with
exchanges that keep more edges inside. A small neural classifier learns the parts from the vectors. It then puts every
vector into its likeliest part and routes each query to several, enough for the recall wanted on the sample. Within
parts distances are exact, in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored

#: Sample vectors for each part, parts at most (they grow with the square root of the table up to 16 million vectors; beyond,
#: parts grow), neighbours in the graph, hidden units and epochs of the classifier.
SAMPLE_PER_PART, MAX_PARTS, GRAPH_NEIGHBOURS, HIDDEN, EPOCHS = 64, 2048, 10, 128, 40
#: Components beyond this size count as this size for the classifier; distances are taken of the vectors as they are.
TAME = 1e100
#: Recall wanted on the sample, whose vectors the classifier knows: higher than what is promised for the table.
WANTED_RECALL = 0.985
#: Vectors, and queries, that one task compares at once.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 1024


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances to one query. Differences are scaled by powers of two, which changes no digit, so that the
    squares of large or small ones stay numbers."""
    shift = 0
    with np.errstate(over="ignore"):
        apart = vectors - query
        if not np.isfinite(apart).all():
            apart, shift = vectors * 0.25 - query * 0.25, 2
        _, power = np.frexp(np.abs(apart).max(axis=1))
        apart = np.ldexp(apart, -power[:, None])
        return np.ldexp(np.sqrt((apart * apart).sum(axis=1)), power + shift)


def nearest(queries: np.ndarray, vectors: np.ndarray, k: int, query_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, vector position, Euclidean distance) of each query's k nearest with another id; ties to the
    smaller id. A matrix product finds all that could be among them; their distances are then taken exactly."""
    out: tuple[list, list, list] = ([], [], [])
    if not len(vectors):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    _, power = np.frexp(max(np.abs(vectors).max(), np.abs(queries).max(initial=0)))
    scaled = np.ldexp(vectors, -power)
    square = (scaled * scaled).sum(axis=1)
    for low in range(0, len(queries), 256):
        q = np.ldexp(queries[low : low + 256], -power)
        rough = square[None, :] + (q * q).sum(axis=1)[:, None] - 2 * q @ scaled.T
        rough[query_ids[low : low + 256, None] == ids[None, :]] = np.inf
        edge = np.partition(rough, min(k, len(vectors)) - 1, axis=1)[:, min(k, len(vectors)) - 1]
        slack = 1e-9 * (square.max() + (q * q).sum(axis=1))
        for i in range(len(q)):
            at = np.flatnonzero((rough[i] <= edge[i] + slack[i]) & np.isfinite(rough[i]))
            distance = distances(vectors[at], queries[low + i])
            best = np.lexsort((ids[at], distance))[:k]
            out[0].append(np.full(len(best), low + i))
            out[1].append(at[best])
            out[2].append(distance[best])
    return tuple(np.concatenate(x) for x in out)


def balanced_parts(graph: np.ndarray, vectors: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part, 0 to parts - 1 (a power of two), for each node of graph (n, neighbours), of sizes that differ by 1 at most."""
    part = np.zeros(len(vectors), np.int64)
    back = np.full(len(vectors), -1)
    for _ in range(int(math.log2(parts))):
        halves = np.zeros(len(vectors), np.int64)
        for p in range(part.max() + 1):
            nodes = np.flatnonzero(part == p)
            if len(nodes) < 2:
                continue
            own = np.clip(vectors[nodes], -TAME, TAME)
            centred = own - own.mean(axis=0)
            axis = np.linalg.svd(centred.T @ centred)[0][:, 0]
            side = np.zeros(len(nodes), np.int64)
            side[np.argsort(centred @ axis, kind="stable")[len(nodes) // 2 :]] = 1
            back[nodes] = np.arange(len(nodes))
            links = back[graph[nodes]]
            source, target = np.nonzero(links >= 0)
            source, target = np.concatenate((source, links[source, target])), np.concatenate((links[source, target], source))
            back[nodes] = -1
            best, best_cut = side, (side[source] != side[target]).sum()
            for _ in range(rounds):
                other = np.bincount(source, weights=(side[source] != side[target]) * 2.0 - 1, minlength=len(nodes))  # edges saved by moving
                zero, one = (np.flatnonzero(side == s) for s in (0, 1))
                zero, one = zero[np.argsort(-other[zero], kind="stable")], one[np.argsort(-other[one], kind="stable")]
                m = min(len(zero), len(one))
                swaps = int((other[zero[:m]] + other[one[:m]] > 0).sum()) // 2
                if not swaps:
                    break
                side = side.copy()
                side[zero[:swaps]], side[one[:swaps]] = 1, 0
                cut = (side[source] != side[target]).sum()
                if cut < best_cut:
                    best, best_cut = side, cut
            halves[nodes] = best
        part = 2 * part + halves
    return part


class Router:
    """A classifier with one hidden layer, trained by Adam on (vectors, part)."""

    def __init__(self, vectors: np.ndarray, part: np.ndarray, parts: int, seed: int = 5):
        rng, vectors = np.random.default_rng(seed), np.clip(vectors, -TAME, TAME)
        self.mean, self.scale = vectors.mean(axis=0), vectors.std() + 1e-12
        sizes = (vectors.shape[1], HIDDEN, parts)
        self.weights = [rng.normal(0, math.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:], strict=False)] + [np.zeros(b) for b in sizes[1:]]
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights]
        x, step = (vectors - self.mean) / self.scale, 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                step += 1
                w1, w2, b1, b2 = self.weights
                hidden = np.maximum(x[rows] @ w1 + b1, 0)
                share = self._softmax(hidden @ w2 + b2)
                share[np.arange(len(rows)), part[rows]] -= 1
                share /= len(rows)
                below = (share @ w2.T) * (hidden > 0)
                for k, grad in enumerate((x[rows].T @ below, hidden.T @ share, below.sum(axis=0), share.sum(axis=0))):
                    m, v = moments[k]
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    self.weights[k] = self.weights[k] - 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """(vectors, parts): the parts of each vector, likeliest first."""
        w1, w2, b1, b2 = self.weights
        vectors = np.clip(vectors, -TAME, TAME)
        return np.argsort(-(np.maximum((vectors - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2), axis=1, kind="stable")


def fit(ids: np.ndarray, vectors: np.ndarray, parts: int, k: int, share: float = 1.0) -> tuple[Router, int]:
    """(router, parts to probe) for a sample that is ``share`` of the table: probes are the fewest that find WANTED_RECALL of the
    sample's own nearest, as many of each as lie in the sample on average of the k nearest of the table, one at least. More of them
    would be farther off than any that is asked for."""
    asked = max(1, math.ceil(k * share))
    _, first = np.unique(vectors, axis=0, return_index=True)
    first = np.sort(first)
    ids, vectors = ids[first], vectors[first]
    if len(vectors) < 2 * parts:
        return Router(vectors, np.zeros(len(vectors), np.int64), parts), parts
    k = min(max(k, GRAPH_NEIGHBOURS), len(vectors) - 1)
    query, target, _ = nearest(vectors, vectors, k, ids, ids)
    graph = np.full((len(vectors), k), -1)
    graph[query, np.arange(len(query)) - np.searchsorted(query, query)] = target
    part = balanced_parts(np.where(graph < 0, np.arange(len(vectors))[:, None], graph), vectors, parts)
    router = Router(vectors, part, parts)
    order = router.order(vectors)
    home = order[:, 0]
    close = np.arange(len(query)) - np.searchsorted(query, query) < asked
    place = np.argsort(order, axis=1)[query[close], home[target[close]]]  # how many parts are probed before the neighbour's
    recall = np.cumsum(np.bincount(place, minlength=parts)) / len(place)
    return router, int(np.searchsorted(recall, WANTED_RECALL) + 1)


def nearest_neighbours(table: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``, k near ones of all other rows: (query_id, rank, id_col, score).

    ``score`` is the Euclidean distance in double precision; ties go to the smaller id. The index holds every row; the
    sample it is fitted on has SAMPLE_PER_PART vectors for each part.

    Vectors that are null, zero, empty or hold a null or non-finite component take no part, nor does a null id or a
    vector of another length than the commonest. Rows with the query's own id are not candidates. A query probes so many
    parts that they hold more than k vectors, all parts if need be, so with k candidates or fewer all are returned. Other
    columns are not read; an empty table gives an empty one.
    """
    spark = table.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    good = table.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where(
        "id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)"
    )
    sizes = good.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    fields = "part int, block int, id long, v array<double>"
    result = f"query_id long, rank int, `{id_col}` long, score double"
    if sizes is None:
        return spark.createDataFrame([], result)
    good, n = good.where(F.size("v") == sizes["size"]), sizes["count"]
    parts = 1 << min(int(math.log2(MAX_PARTS)), max(3, round(math.log2(math.sqrt(n) / 2))))
    share = min(1.0, SAMPLE_PER_PART * parts / n)
    sample = good.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40)) < F.lit(math.ceil(share * (1 << 40)))).orderBy("id").toPandas()
    router, probes = fit(sample["id"].to_numpy(), np.stack(sample["v"].to_numpy()), parts, k, share)
    shared = spark.sparkContext.broadcast(router)

    def routed(least: int, held: np.ndarray | None = None):
        """Gives each vector its likeliest parts: ``least`` of them, and more until they hold over k vectors by ``held``."""

        def work(batches):
            for batch in batches:
                if batch.num_rows:
                    order = shared.value.order(np.stack(batch["v"].to_numpy(zero_copy_only=False)))
                    take = np.full(len(order), least)
                    if held is not None:
                        enough = np.cumsum(held[order], axis=1) > k
                        take = np.maximum(take, np.where(enough[:, -1], enough.argmax(axis=1) + 1, parts))
                    chosen = order[np.arange(parts)[None, :] < take[:, None]].astype(np.int32)
                    at = np.concatenate(([0], np.cumsum(take))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch["id"], batch["v"], pa.ListArray.from_arrays(at, chosen)], names=["id", "v", "parts"])

        return work

    kept = stored(good.mapInArrow(routed(1), "id long, v array<double>, parts array<int>").select("id", "v", F.col("parts")[0].alias("part")), "index")
    held = np.zeros(parts, np.int64)
    for r in kept.groupBy("part").count().collect():  # MAX_PARTS rows at most
        held[r["part"]] = r["count"]
    asked = good.where(F.col("id") % every == 0).mapInArrow(routed(probes, held), "id long, v array<double>, parts array<int>")
    asked = stored(asked.select("id", "v", F.explode("parts").alias("part")), "asked")

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("part").agg(F.ceil(F.count("*") / size).cast("int").alias(name))  # a row for each part

    counted = blocks(kept, BLOCK_VECTORS, "blocks").join(blocks(asked, BLOCK_QUERIES, "query_blocks"), "part")

    def dealt(df: DataFrame, own: str, other: str, own_name: str, other_name: str, is_query: bool) -> DataFrame:
        own_block = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own_name)
        joined = df.join(F.broadcast(counted), "part")
        return joined.select("part", "id", "v", own_block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_name), F.lit(is_query).alias("is_query"))

    both = dealt(kept, "blocks", "query_blocks", "block", "query_block", False).unionByName(dealt(asked, "query_blocks", "blocks", "query_block", "block", True))

    def search(group: pa.Table) -> pa.Table:
        ids, is_query = group["id"].to_numpy(), group["is_query"].to_numpy()
        vectors = group["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        q, v, score = nearest(vectors[is_query], vectors[~is_query], k, ids[is_query], ids[~is_query])
        return pa.table({"query_id": ids[is_query][q], "id": ids[~is_query][v], "score": score})

    found = both.groupBy("part", "block", "query_block").applyInArrow(search, "query_id long, id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
