"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard (operator 2).

Distinct vectors are dealt over shards by hash. Each shard builds its graph in one
task: every layer is one flat array of neighbour positions, -1 where there is none.
Vectors join in batches; a batch searches the graph built so far in lockstep, in
numpy, sees its own members by brute force, and keeps diverse neighbours. Every shard then
answers all queries with its k best, and these are cut to k in groups of shards before the last merge.
Shards are as large as a task's memory takes, so that there are few of them: the queries
are sent to each.

Nearness is the inner product on the original vectors in double precision. Graphs are
navigated by the inner product of vectors that got one more component, which makes
all lengths equal, so that the nearest by angle are those with the largest inner product.

Cases: vectors that are null, zero, or hold null or non-finite components take no
part, neither do rows with a null id; vectors of another length than the most
common one take no part (an inner product with them is undefined); equal vectors are one node that
lists its smallest ids, k + 1 of them, which is as many as one result can hold; an id with several vectors is one
candidate with the best of them, and asks with the smallest; with fewer than k
candidates all are returned; ties go to the smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from takemark.llm.common import Scratch


class Graph:
    """A small-world graph over the rows of x (unit length)."""

    def __init__(self, x: np.ndarray, links: int = 16, breadth: int = 96, batch: int = 256, seed: int = 5):
        self.x, self.links, self.breadth = x, links, breadth
        n = len(x)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
        self.layers: list[np.ndarray] = [np.full((n, links * 2 if k == 0 else links), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        order = np.argsort(-level, kind="stable")  # higher nodes first: their layers are complete when the rest searches them
        self.entry = int(order[0]) if n else -1
        done = 1
        while done < n:
            new = order[done : done + min(batch, max(1, done))]
            self._insert(new, level)
            done += len(new)

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        start = np.full((len(new), 1), self.entry)
        for k in range(len(self.layers) - 1, -1, -1):
            on = level[new] >= k
            found, score = self._search(self.x[new], start, k, self.breadth if on.any() else 1)
            start = found[:, :4]
            if on.any():
                self._connect(new[on], found[on], score[on], k)

    def _search(self, q: np.ndarray, start: np.ndarray, k: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries in lockstep: (ids, scores), best first, -1 where nothing was found."""
        adj, rows = self.layers[k], np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(self.x) + 1), bool)
        seen[:, -1] = True  # position -1: no neighbour
        ids = np.where(seen[rows, start], -1, start) if start.shape[1] > 1 else start
        seen[rows, start] = True
        score = np.where(ids < 0, -np.inf, np.einsum("qd,qcd->qc", q, self.x[ids]))
        open_ = ids >= 0
        while True:
            best = np.where(open_, score, -np.inf).argmax(1)
            live = np.flatnonzero(open_[np.arange(len(q)), best])
            if not len(live):
                return ids, score
            open_[live, best[live]] = False
            near = adj[ids[live, best[live]]]
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            near = np.where(fresh, near, -1)
            s = np.where(fresh, np.einsum("qd,qcd->qc", q[live], self.x[near]), -np.inf)
            if score.shape[1] < breadth:
                pad = min(breadth, score.shape[1] + near.shape[1]) - score.shape[1]
                ids, score, open_ = (np.pad(v, ((0, 0), (0, pad)), constant_values=c) for v, c in ((ids, -1), (score, -np.inf), (open_, False)))
            all_ids = np.concatenate([ids[live], near], 1)
            all_score = np.concatenate([score[live], s], 1)
            all_open = np.concatenate([open_[live], fresh], 1)
            top = np.argsort(-all_score, axis=1, kind="stable")[:, : ids.shape[1]]
            r = np.arange(len(live))[:, None]
            ids[live], score[live], open_[live] = all_ids[r, top], all_score[r, top], all_open[r, top]

    def _diverse(self, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Per row, up to most candidates (best first), each nearer to the row's node than to any taken before; then the best of the rest."""
        vectors = self.x[ids]
        between = np.einsum("qad,qbd->qab", vectors, vectors)
        valid = ids >= 0
        taken = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            blocked = (taken & (between[:, :, c] > score[:, c : c + 1])).any(1)
            taken[:, c] = valid[:, c] & ~blocked & (taken.sum(1) < most)
        rank = np.where(taken, 0, np.where(valid, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        pick = np.argsort(rank, axis=1)[:, :most]
        r = np.arange(len(ids))[:, None]
        return np.where(valid[r, pick], ids[r, pick], -1)

    def _connect(self, new: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> None:
        own = self.x[new] @ self.x[new].T
        np.fill_diagonal(own, -np.inf)
        peers = np.argsort(-own, axis=1)[:, : min(self.links, len(new) - 1)]
        ids = np.concatenate([ids, new[peers]], 1)
        score = np.concatenate([score, own[np.arange(len(new))[:, None], peers]], 1)
        order = np.argsort(-score, axis=1, kind="stable")[:, : self.breadth]
        r = np.arange(len(new))[:, None]
        ids, score = ids[r, order], score[r, order]
        chosen = self._diverse(ids, score, self.links)
        adj = self.layers[k]
        adj[new, : chosen.shape[1]] = chosen
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        width = int(count.max(initial=0))
        back = np.full((len(nodes), width), -1, np.int64)
        back[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        merged = np.concatenate([adj[nodes], back], 1)
        merged = np.sort(merged, axis=1)
        merged[:, 1:][merged[:, 1:] == merged[:, :-1]] = -1
        s = np.where(merged < 0, -np.inf, np.einsum("nd,ncd->nc", self.x[nodes], self.x[merged]))
        order = np.argsort(-s, axis=1, kind="stable")[:, : adj.shape[1] + self.links]
        r = np.arange(len(nodes))[:, None]
        merged, s = merged[r, order], s[r, order]
        fits = (merged >= 0).sum(1) <= adj.shape[1]
        keep = np.full(adj[nodes].shape, -1, np.int64)
        w = min(adj.shape[1], merged.shape[1])
        keep[fits, :w] = merged[fits, :w]
        if (~fits).any():
            keep[~fits] = self._diverse(merged[~fits], s[~fits], adj.shape[1])
        adj[nodes] = keep

    def nearest(self, q: np.ndarray, breadth: int) -> np.ndarray:
        """Positions of about the breadth nearest rows for each query."""
        start = np.full((len(q), 1), self.entry)
        for k in range(len(self.layers) - 1, 0, -1):
            start = self._search(q, start, k, 4)[0][:, :4]
        return self._search(q, start, 0, breadth)[0]


def _usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def _least_ids(rows: DataFrame, most: int) -> DataFrame:
    """(v, ids): distinct vectors, each with its smallest ids. The limit on the rank is applied before the shuffle too, so copies of a vector never gather."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return rows.select("v", "vec_id").withColumn("place", place).where(F.col("place") <= most).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _seats(s: Scratch, n: int) -> DataFrame:
    """(shard, seat): for each of n shards a number that repartition(n, seat) puts in a partition of its own."""
    at = F.pmod(F.hash("id"), F.lit(n))
    return s.saved(s.spark.range(64 * n).select(at.cast("long").alias("shard"), "id").groupBy("shard").agg(F.min("id").alias("seat")), "seats")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector: str = "embedding", shard_rows: int = 32_768, breadth: int = 128, queries_at_once: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row whose id is divisible by ``every``."""
    with Scratch(vectors.sparkSession) as s:
        return s.keep(_nearest(vectors, k, every, id_col, vector, shard_rows, breadth, queries_at_once, s), "nearest")


def _nearest(vectors: DataFrame, k: int, every: int, id_col: str, vector: str, shard_rows: int, breadth: int, queries_at_once: int, s: Scratch) -> DataFrame:
    rows = s.saved(_usable(vectors, id_col, vector).withColumn("d", F.size("v")), "vectors")
    usual = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if usual is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    rows = rows.where(F.col("d") == usual["d"])
    nodes = s.saved(_least_ids(rows.distinct(), k + 1), "nodes")
    facts = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).first()
    shards, longest = max(1, -(-facts["n"] // shard_rows)), float(facts["longest"])
    queries = s.saved(rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "queries")
    seats = F.broadcast(_seats(s, shards))  # one row a shard
    tagged = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards))).join(seats, "shard", "left").select("seat", "shard", F.lit(None).cast("long").alias("query_id"), "v", "ids")
    spread = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")).alias("shard"), "query_id", "v", F.lit(None).cast("array<long>").alias("ids"))
    spread = spread.join(seats, "shard", "left").select("seat", "shard", "query_id", "v", "ids")
    dealt = tagged.unionByName(spread).repartition(shards, "seat").sortWithinPartitions("shard", F.col("query_id").asc_nulls_first(), F.xxhash64("v")).drop("seat")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, xs, ids, graph = None, [], [], None
        waiting: list = []

        def answers() -> pa.RecordBatch:
            nonlocal graph, xs
            if graph is None:
                xs = np.array(xs, np.float64).reshape(len(xs), -1)
                room = np.sqrt(np.maximum(longest - (xs * xs).sum(1), 0.0))
                unit = np.concatenate([xs, room[:, None]], 1) / np.sqrt(longest)
                graph = Graph(unit.astype(np.float32))
            q = np.array([v for _, v in waiting], np.float64)
            lifted = np.concatenate([q, np.zeros((len(q), 1))], 1)
            lifted /= np.maximum(np.sqrt((lifted * lifted).sum(1, keepdims=True)), 1e-300)
            at = graph.nearest(lifted.astype(np.float32), max(breadth, 4 * k))
            out: list[list] = [[], [], []]
            for i, (qid, _) in enumerate(waiting):
                found = at[i][at[i] >= 0]
                exact = xs[found] @ q[i]
                # All ids of all nodes found, nearest first and smaller ids first among equals; an id counts once.
                own = [ids[p] for p in found]
                score, name = np.repeat(exact, [len(x) for x in own]), np.concatenate(own)
                taken: dict[int, float] = {}
                for p in np.lexsort((name, -score)):
                    if name[p] != qid and name[p] not in taken:
                        taken[int(name[p])] = float(score[p])
                        if len(taken) == k:
                            break
                out[0] += [qid] * len(taken)
                out[1] += taken.keys()
                out[2] += taken.values()
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([shard] * len(out[0]), pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["shard", "query_id", "vec_id", "score"])

        for batch in batches:
            for at, qid, v, own in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if at != shard:
                    if waiting and len(xs):
                        yield answers()
                    shard, xs, ids, graph = at, [], [], None
                    waiting.clear()
                if qid is None:
                    xs.append(v)
                    ids.append(own)
                else:
                    waiting.append((qid, v))
                    if len(waiting) == queries_at_once and len(xs):
                        yield answers()
        if waiting and len(xs):
            yield answers()

    found = s.saved(dealt.mapInArrow(searched, "shard long, query_id long, vec_id long, score double"), "found")
    group = max(1, round(shards**0.5))
    part = _best(found.withColumn("part", F.floor(F.col("shard") / group)), ["query_id", "part"], k)
    best = _best(part, ["query_id"], k)
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.far")).alias("score"))


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k nearest per group: (by, best) from rows with vec_id and score, or from (by, best) of smaller groups."""
    if "best" in found.columns:
        found = found.select(*by, F.explode("best").alias("b")).select(*by, "b.vec_id", (-F.col("b.far")).alias("score"))
    once = found.groupBy(*by, "vec_id").agg(F.max("score").alias("score"))
    order = F.struct((-F.col("score")).alias("far"), F.col("vec_id").alias("vec_id"))
    return once.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("best"))
