"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Equal vectors are one node, which keeps the smallest ``COPIES`` of their ids (a
search for k neighbours never needs more than k + 1 of them). Nodes are dealt to
shards of about ``SHARD_ROWS`` by a hash, so a shard's graph fits in a task and the
number of shards grows with the data; every node is indexed.

A graph grows by batches. A greedy beam search in the graph so far proposes
neighbours for all points of a batch at once; pruning keeps a neighbour only if
no kept one is closer to it, ``ALPHA`` times, than the point is; links are added
back and pruned again where a node has more than ``DEGREE``. A search runs a beam
in every shard and merges the shards' best, with distances taken anew from the
original vectors in double precision.

Graphs work on vectors moved to the shard's median and scaled to its usual spread,
so offsets and units do not matter, and one vector far off does not shrink the
others. A query far off the shard, or whose beam finds too few nodes, is compared
with every node of the shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import settle

K = 10
SHARD_ROWS = 4000
QUERY_ROWS = 10_000
DEGREE = 32
ALPHA = 1.2
BUILD_BEAM = 64
SEARCH_BEAM = 128
#: Beam entries that are expanded in one step.
EXPANDED = 4
BATCH = 256
STARTS = 8
#: Scaled components beyond this are cut, so that squares stay finite.
FAR = 1e120
#: Scaled components of a query beyond which differences drown in its square.
LOST = 1e5


def takes_part(vector: Column) -> Column:
    """True for vectors that are not null, empty or zero and have finite components only."""
    number = vector.cast("array<double>")
    finite = F.forall(number, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(number, lambda x: x != 0), F.lit(False))


def _squares(points: np.ndarray, near: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``to`` to its own row of point numbers."""
    found = points[near]
    return np.maximum(
        np.einsum("brd,brd->br", found, found)
        - 2 * np.einsum("brd,bd->br", found, to)
        + np.einsum("bd,bd->b", to, to)[:, None],
        0,
    )


class Frame:
    """The middle and usual spread of a shard's vectors."""

    def __init__(self, points: np.ndarray):
        sizes = np.abs(points).max(axis=1)
        self.unit = np.median(sizes) or sizes.max() or 1.0
        with np.errstate(over="ignore"):
            scaled = points / self.unit
        self.middle = np.median(scaled, axis=0)
        spread = np.abs(scaled - self.middle).max(axis=1)
        self.spread = np.median(spread) or min(spread.max(), FAR) or 1.0

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            moved = (vectors / self.unit - self.middle) / self.spread
        return np.clip(moved, -FAR, FAR)


def distances(points: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, also where squares leave its range."""
    with np.errstate(over="ignore", under="ignore"):
        apart = points - vector
        squares = (apart**2).sum(axis=1)
        odd = ~np.isfinite(squares) | (squares < 1e-280)
        out = np.sqrt(squares)
        if odd.any():
            some, own = points[odd], np.zeros(int(odd.sum()))
            unit = np.maximum(np.abs(some).max(axis=1), np.abs(vector).max())
            parts = some / unit[:, None] - vector / unit[:, None]
            most = np.abs(parts).max(axis=1)
            far = most > 0
            scaled = parts[far] / most[far][:, None]
            own[far] = np.sqrt((scaled**2).sum(axis=1)) * most[far] * unit[far]
            out[odd] = own
    return out


def _numbers(n: int) -> Column:
    """One row for each of 0 .. n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


class Graph:
    """Points and, by rows, the numbers of their out-neighbours (-1: none)."""

    def __init__(self, points: np.ndarray, links: np.ndarray | None = None):
        self.points = np.ascontiguousarray(points, np.float64)
        n = len(points)
        rng = np.random.default_rng(n)
        self.starts = np.sort(rng.permutation(n)[:STARTS])
        self.links = np.full((n, DEGREE), -1, np.int32) if links is None else links

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step: point numbers (-1: none) by distance, squares."""
        queries = np.ascontiguousarray(queries, np.float64)
        n_queries, rows = len(queries), np.arange(len(queries))[:, None]
        seen = np.zeros((n_queries, len(self.points) + 1), bool)
        seen[:, -1] = True  # number -1
        ids = np.full((n_queries, beam), -1, np.int64)
        squares = np.full((n_queries, beam), np.inf)
        done = np.ones((n_queries, beam), bool)
        new = np.broadcast_to(self.starts, (n_queries, len(self.starts))).astype(np.int64)
        while True:
            fresh = ~seen[rows, new]
            seen[rows, new] = True
            found = np.where(fresh, _squares(self.points, new, queries), np.inf)
            ids = np.concatenate([ids, np.where(fresh, new, -1)], axis=1)
            squares = np.concatenate([squares, found], axis=1)
            done = np.concatenate([done, ~fresh], axis=1)
            order = np.argsort(squares, axis=1, kind="stable")[:, :beam]
            ids, squares, done = (np.take_along_axis(x, order, 1) for x in (ids, squares, done))
            open_ = np.where(done, np.inf, squares)
            chosen = np.argsort(open_, axis=1, kind="stable")[:, :EXPANDED]
            usable = np.isfinite(np.take_along_axis(open_, chosen, 1))
            if not usable.any():
                return ids, squares
            np.put_along_axis(done, chosen, True, 1)
            at = np.where(usable, np.take_along_axis(ids, chosen, 1), -1)
            new = np.where(at[:, :, None] >= 0, self.links[at], -1).reshape(n_queries, -1)
            new = new.astype(np.int64)
            # A point that two expanded ones link to counts once.
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1

    def prune(self, at: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Robust pruning: diverse out-neighbours of the points ``at`` among their candidates."""
        own = self.points[at]
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        candidates[candidates == at[:, None]] = -1
        squares = np.where(candidates >= 0, _squares(self.points, candidates, own), np.inf)
        order = np.argsort(squares, axis=1, kind="stable")
        candidates = np.take_along_axis(candidates, order, 1)
        squares = np.take_along_axis(squares, order, 1)
        vectors = self.points[candidates]
        norms = np.einsum("bcd,bcd->bc", vectors, vectors)
        between = norms[:, :, None] + norms[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
        alive = np.isfinite(squares)
        out = np.full((len(at), DEGREE), -1, np.int32)
        rows = np.arange(len(at))
        for place in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            first = alive.argmax(axis=1)
            out[some, place] = candidates[rows, first][some]
            covered = ALPHA * ALPHA * between[rows, first] <= squares
            alive &= ~covered
            alive[rows, first] = False
        return out

    def insert(self, at: np.ndarray, candidates: np.ndarray) -> None:
        """Set the out-links of the points ``at`` and link back to them."""
        self.links[at] = self.prune(at, candidates)
        source = np.repeat(at, DEGREE)
        target = self.links[at].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        by_count = np.argsort(count, kind="stable")
        for part in np.array_split(by_count, max(1, len(by_count) // BATCH)):
            if not len(part):
                continue
            width = count[part].max()
            place = first[part][:, None] + np.arange(width)
            added = np.where(
                np.arange(width) < count[part][:, None],
                source[np.minimum(place, len(source) - 1)],
                -1,
            )
            own = nodes[part].astype(np.int64)
            both = np.concatenate([self.links[own].astype(np.int64), added], axis=1)
            self.links[own] = self.prune(own, both)


def build_graph(points: np.ndarray) -> Graph:
    graph = Graph(points)
    n = len(points)
    order = np.concatenate(
        [graph.starts, np.setdiff1d(np.random.default_rng(n + 1).permutation(n), graph.starts)]
    )
    order[len(graph.starts) :] = np.random.default_rng(n + 2).permutation(order[len(graph.starts) :])
    first = order[:BATCH]
    graph.insert(first, np.broadcast_to(first, (len(first), len(first))).astype(np.int64))
    for start in range(BATCH, n, BATCH):
        batch = order[start : start + BATCH]
        found, _ = graph.search(graph.points[batch], BUILD_BEAM)
        graph.insert(batch, found)
    return graph


def index(vectors: DataFrame, k: int = K) -> DataFrame:
    """(shard, dims, embedding, ids, links) of ``vectors`` (vec_id, embedding), kept as a table.

    Rows with a null vec_id or a vector that takes no part are left out; repeated
    rows count once. Vectors of different length never meet. Links are places in
    the shard's order of embeddings.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).filter(takes_part(F.col("embedding")) & F.col("vec_id").isNotNull())
    # Rows beyond the first k + 1 copies of a vector can be in no result.
    copy = Window.partitionBy("embedding").orderBy("vec_id")
    nodes = (
        rows.distinct()
        .withColumn("copy", F.row_number().over(copy))
        .filter(F.col("copy") <= k + 1)
        .groupBy("embedding")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        .withColumn("dims", F.size("embedding"))
    )
    nodes = settle(nodes)
    shards = max(1, -(-nodes.count() // SHARD_ROWS))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(rows["embedding"].to_list())
        order = np.lexsort(points.T[::-1])
        rows, points = rows.iloc[order].reset_index(drop=True), points[order]
        return rows.assign(place=np.arange(len(rows)), links=list(build_graph(Frame(points)(points)).links))

    schema = "shard long, dims int, place int, embedding array<double>, ids array<long>, links array<int>"
    columns = [part.split()[0] for part in schema.split(", ")]
    return settle(
        dealt.groupBy("shard", "dims").applyInPandas(lambda rows: build(rows)[columns], schema)
    )


def search(indexed: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest other ids found, ties to smaller ids.

    ``queries`` has query_id and embedding; those that take no part give no rows.
    """
    asked = queries.select(
        F.col("query_id").cast("long").alias("query_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).filter(takes_part(F.col("embedding")))
    asked = settle(asked.distinct().withColumn("dims", F.size("embedding")))
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    shards = (indexed.agg(F.max("shard")).first()[0] or 0) + 1
    to_shards = asked.withColumn("shard", _numbers(shards))
    to_blocks = indexed.withColumn("block", _numbers(blocks))

    def find(nodes: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(nodes) or not len(wanted):
            return out
        nodes = nodes.sort_values("place")
        points = np.stack(nodes["embedding"].to_list())
        frame = Frame(points)
        graph = Graph(frame(points), np.stack(nodes["links"].to_list()).astype(np.int32))
        enough = min(k + 1, len(points))
        ids = nodes["ids"].to_list()
        least = np.array([own[0] for own in ids])
        frames = []
        for start in range(0, len(wanted), BATCH):
            part = wanted.iloc[start : start + BATCH]
            vectors = np.stack(part["embedding"].to_list())
            if len(points) <= SEARCH_BEAM:
                found = np.broadcast_to(np.arange(len(points)), (len(part), len(points)))
            else:
                found, _ = graph.search(frame(vectors), SEARCH_BEAM)
            for query, vector, near in zip(part["query_id"], vectors, found):
                near = near[near >= 0]
                if len(near) < enough or np.abs(frame(vector)).max() > LOST:
                    near = np.arange(len(points))
                score = distances(points[near], vector)
                # The nodes of the smallest ids among equal scores hold the smallest ids.
                best = np.lexsort((least[near], score))[: k + 1]
                counts = [len(ids[i]) for i in near[best]]
                frames.append(
                    pd.DataFrame(
                        {
                            "query_id": query,
                            "vec_id": np.concatenate([ids[i] for i in near[best]]),
                            "score": np.repeat(score[best], counts),
                        }
                    )
                )
        out = pd.concat(frames)
        out = out[out["vec_id"] != out["query_id"]].sort_values(["query_id", "score", "vec_id"])
        return out.groupby("query_id").head(k)

    found = (
        to_blocks.groupBy("shard", "dims", "block")
        .cogroup(to_shards.groupBy("shard", "dims", "block"))
        .applyInPandas(lambda a, b: find(a, b), "query_id long, vec_id long, score double")
    )
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def neighbour_query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    queries = vectors.filter(F.col("vec_id") % 100 == 0)
    return search(index(vectors), queries.withColumnRenamed("vec_id", "query_id"))
