"""Approximate nearest neighbours by inner product over robust-pruned directed graphs.

Equal vectors form a class, indexed once. Classes are dealt into shards by hash; each shard gets a graph: points are
inserted in batches of doubling size, a greedy search of the graph so far proposes neighbours, and relaxed pruning keeps
a proposal only where no kept one is nearer to it by the factor ALPHA. Inner products become distances by one added
coordinate that gives all vectors of a shard the same norm. A query visits every shard by beam search from the shard's
entry point; the best of all shards, expanded to the classes' members, are ranked by exact double-precision products.

Cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors meet only those of
their own length; with fewer candidates than k all found are returned; ties go to the smaller id; rows that repeat one
id count once; rows without an id take no part; vectors of any finite size are searched alike (a product may overflow
to infinity; in a shard, vectors 10**38 times smaller than its largest are searched as zeros); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written

DEGREE, ALPHA = 32, 1.2
BUILD_BEAM, SEARCH_BEAM = 64, 128
SHARD_ROWS = 8192
QUERY_ROWS = 16_384  # queries that meet a shard in one task
LOCKSTEP = 256  # queries searched side by side
SEED = 11


def valid(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def beam_search(points: np.ndarray, links: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, products) of the beam for each query, best first; -1 fills up. All queries of a block take each step together.

    The last row of points stands for "no link".
    """
    found, scores = np.full((len(queries), beam), -1, np.int64), np.full((len(queries), beam), -np.inf, np.float32)
    for a in range(0, len(queries), LOCKSTEP):
        q = queries[a : a + LOCKSTEP]
        m, width = len(q), links.shape[1]
        ids, got = np.full((m, beam), -1, np.int64), np.full((m, beam), -np.inf, np.float32)
        done, seen = np.ones((m, beam), bool), np.zeros((m, len(points)), bool)
        ids[:, 0], got[:, 0], done[:, 0] = entry, q @ points[entry], False
        seen[:, entry] = seen[:, -1] = True
        live = np.arange(m)
        while len(live):
            waiting = np.where(done[live], -np.inf, got[live])
            at = waiting.argmax(1)
            more = np.isfinite(waiting[np.arange(len(live)), at])
            live, at = live[more], at[more]
            if not len(live):
                break
            done[live, at] = True
            near = links[ids[live, at]]
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            product = np.where(fresh, np.einsum("mrd,md->mr", points[near], q[live]), -np.inf).astype(np.float32)
            all_ids, all_got = np.hstack([ids[live], near]), np.hstack([got[live], product])
            all_done = np.hstack([done[live], ~fresh])
            best = np.argpartition(-all_got, beam - 1, 1)[:, :beam]
            rows = np.arange(len(live))[:, None]
            ids[live], got[live] = all_ids[rows, best], all_got[rows, best]
            done[live] = all_done[rows, best] | ~np.isfinite(got[live])
        order = np.argsort(-got, 1, kind="stable")
        rows = np.arange(m)[:, None]
        ids, got = ids[rows, order], got[rows, order]
        found[a : a + m], scores[a : a + m] = np.where(np.isfinite(got), ids, -1), got
    return found, scores


def robust_prune(points: np.ndarray, own: np.ndarray, proposed: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """(points, degree) of kept neighbours, nearest first; -1 fills up. proposed: candidates of each point, -1 for none."""
    m, c = proposed.shape
    out = np.full((m, degree), -1, np.int64)
    for a in range(0, m, LOCKSTEP):
        p, ids = own[a : a + LOCKSTEP], np.sort(proposed[a : a + LOCKSTEP], 1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        ids[ids == p[:, None]] = -1
        x = points[ids]
        norm = (x * x).sum(2)
        far = norm + (points[p] ** 2).sum(1)[:, None] - 2 * np.einsum("mcd,md->mc", x, points[p])
        far = np.where(ids < 0, np.inf, np.maximum(far, 0))
        between = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1)), 0)
        rows, left = np.arange(len(p)), far.copy()
        for k in range(degree):
            pick = left.argmin(1)
            ok = np.isfinite(left[rows, pick])
            if not ok.any():
                break
            out[a : a + len(p)][ok, k] = ids[rows, pick][ok]
            covered = alpha * alpha * between[rows, pick] <= far
            covered[rows, pick] = True
            left[covered & ok[:, None]] = np.inf
    return out


def build_graph(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(points with the added coordinate, links, entry). A row of links names the point after the last for "none"."""
    vectors = vectors / np.abs(vectors).max()  # whatever their size, single precision holds them
    square = (vectors * vectors).sum(1)
    points = np.hstack([vectors, np.sqrt(np.maximum(square.max() - square, 0))[:, None]]).astype(np.float32)
    n = len(points)
    entry = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    links = np.full((n, DEGREE), n, np.int64)
    padded = np.vstack([points, np.zeros((1, points.shape[1]), np.float32)])
    order = np.random.default_rng(SEED).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        near, _ = beam_search(padded, links, entry, 2 * points[batch], BUILD_BEAM)
        # the batch's own members aren't in the graph yet: its nearest pairs are proposed too
        among = points[batch] @ points[batch].T
        np.fill_diagonal(among, -np.inf)
        own = batch[np.argpartition(-among, min(15, len(batch) - 1), 1)[:, :16]]
        kept = robust_prune(points, batch, np.hstack([near, own, np.where(links[batch] == n, -1, links[batch])]))
        links[batch] = np.where(kept < 0, n, kept)
        _link_back(points, links, batch, kept)
        at += len(batch)
        size = min(2 * size, max(64, n // 8), 1024)
    return padded, links, entry


def _link_back(points: np.ndarray, links: np.ndarray, batch: np.ndarray, kept: np.ndarray) -> None:
    """Adds the reverse of new links; where a row is full it is pruned anew."""
    n = len(points)
    source, target = np.repeat(batch, kept.shape[1])[kept.ravel() >= 0], kept.ravel()[kept.ravel() >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    by_size = np.argsort(count, kind="stable")
    for part in np.array_split(by_size, max(1, math.ceil(len(by_size) / LOCKSTEP))):
        if not len(part):
            continue
        most = int(count[part].max())
        cell = first[part][:, None] + np.arange(most)
        new = np.where(np.arange(most) < count[part][:, None], source[np.minimum(cell, len(source) - 1)], -1)
        old = np.where(links[nodes[part]] == n, -1, links[nodes[part]])
        both = -np.sort(-np.hstack([old, new]), 1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1  # a link that is there already
        both = -np.sort(-both, 1)
        room = (both >= 0).sum(1) <= links.shape[1]
        kept_now = np.full((len(part), links.shape[1]), -1, np.int64)
        simple = both[:, : links.shape[1]]
        kept_now[:, : simple.shape[1]] = simple
        if (~room).any():
            kept_now[~room] = robust_prune(points, nodes[part][~room], both[~room])
        links[nodes[part]] = np.where(kept_now < 0, n, kept_now)


def build_index(classes: DataFrame) -> DataFrame:
    """(dim, shard, node, ids, vector, links, entry) of classes (dim, shard, ids, vector): one graph for each shard."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep", ignore_index=True)
        vectors = np.array(part["vector"].tolist(), np.float64)
        _, links, entry = build_graph(vectors)
        own = [row[row < len(part)].astype(np.int32).tolist() for row in links]
        return pd.DataFrame({"dim": part["dim"], "shard": part["shard"], "node": np.arange(len(part)), "ids": part["ids"], "vector": part["vector"], "links": own, "entry": np.arange(len(part)) == entry})

    schema = "dim int, shard int, node int, ids array<long>, vector array<double>, links array<int>, entry boolean"
    return classes.groupBy("dim", "shard").applyInPandas(build, schema)


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """(rep, vec_id, score): the best k members of each shard for each query (dim, shard, part, rep, query)."""

    def search(shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"rep": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(shard) or not len(asked):
            return empty
        shard = shard.sort_values("node", ignore_index=True)
        vectors, n = np.array(shard["vector"].tolist(), np.float64), len(shard)
        links = np.full((n, DEGREE), n, np.int64)
        for i, own in enumerate(shard["links"]):
            links[i, : len(own)] = own
        # scaling all points, or a query, alike changes no order; single precision then holds them
        points = np.vstack([vectors / np.abs(vectors).max(), np.zeros((1, vectors.shape[1]))]).astype(np.float32)
        asked_for = np.array(asked["query"].tolist(), np.float64)
        scaled = (asked_for / np.abs(asked_for).max(1, keepdims=True)).astype(np.float32)
        near, _ = beam_search(points, links, int(np.flatnonzero(shard["entry"])[0]), scaled, max(beam, k))
        members = [np.asarray(x, np.int64) for x in shard["ids"]]
        reps, ids, scores = [], [], []
        for rep, q, row in zip(asked["rep"], asked_for, near, strict=True):
            row = np.unique(row[row >= 0])
            if not len(row):
                continue
            product = (vectors[row] * q).sum(1)
            best = np.argsort(-product, kind="stable")
            if len(best) > k:  # ties with the last one stay
                best = best[product[best] >= product[best[k - 1]]]
            them = np.concatenate([members[i] for i in row[best]])
            value = np.repeat(product[best], [len(members[i]) for i in row[best]])
            order = np.lexsort((them, -value))[:k]
            reps += [rep] * len(order)
            ids.append(them[order])
            scores.append(value[order])
        if not ids:
            return empty
        return pd.DataFrame({"rep": reps, "vec_id": np.concatenate(ids), "score": np.concatenate(scores)})

    keys = ["dim", "shard", "part"]  # a shard meets each part of the queries; there is one part for each QUERY_ROWS of them
    return index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(search, "rep long, vec_id long, score double")


def nearest(spark: SparkSession, rows: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds the k nearest other rows."""
    keep = Written(spark, "ann")
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asked"))
    own = own.filter(F.col("id").isNotNull() & valid("vector")).withColumn("dim", F.size("vector"))
    # k + 1 members of a class are enough: its smallest ids, without the query's own
    first = Window.partitionBy("vector").orderBy("id")
    few = own.select("id", "vector", "dim").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1)
    classes = keep(few.groupBy("vector", "dim").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "classes")
    shards = max(1, math.ceil(classes.count() / shard_rows))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    asking = keep(own.filter("asked").select(F.col("id").alias("query_id"), "vector").distinct().join(classes.select("vector", "rep"), "vector").select("query_id", "rep"), "asking")
    asked = asking.select("rep").distinct().join(classes.select("rep", "dim", F.col("vector").alias("query")), "rep")
    parts = max(1, math.ceil(asking.count() / QUERY_ROWS))
    part = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(parts)).cast("int")
    queries = asked.withColumn("part", part).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    index = keep(build_index(dealt), "index").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    found = search_index(index, queries, k + 1, beam).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k + 1).drop("_r")
    ranked = asking.join(found, "rep").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
