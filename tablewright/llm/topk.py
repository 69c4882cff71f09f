"""Exact top-k search by tiles.

Vectors become integers, floor(scale * x) of each component.  Query tiles meet candidate shards in
one matrix product each; the product is cut to k entries a query at once (partial selection), lists
of one task merge in pairs as they come, and the tasks' lists merge as a tree, FAN of them at a time.  Scores are
exact: products run in doubles only while every partial sum is below 2**53, else in Python integers.

Vectors that are null, or hold a null or a component that is not finite, take no part; neither do
rows without an id.  Vectors of different length never meet.  Equal scores rank by the smaller id.
Repeated rows are candidates of their own, except that no row with the query's id is one; a repeated
query id is searched once for each distinct vector and keeps the best of both.  Scores beyond 64 bits are cut to the bounds,
and a component whose product with the scale is beyond doubles counts as the largest (or least) of them.
Empty tables give empty results.  Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, scratch, stored

SHARD = 4096
TILE = 1024
#: Bytes of query tiles that one pass over the shards sends to every executor.
PASS_BYTES = 16 << 20
TILES = "dim int, n int, ids binary, data binary"
LISTS = "query_id long, vec_id long, score long"
#: Lists that one step of the tree merges into one.
FAN = 64
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
LARGEST = np.finfo(np.float64).max


def usable(column: str) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(column).isNotNull() & F.forall(F.col(column), lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))


def tiles(vectors: DataFrame, rows: int, scale: int) -> DataFrame:
    """(vec_id, v) packed into binary tiles of up to so many rows of one length, each sorted by id."""

    def pack(batches):
        held: dict[int, tuple[list, list]] = {}

        def out(dim):
            ids, data = held.pop(dim)
            ids, data = np.concatenate(ids), np.concatenate(data)
            order = np.argsort(ids, kind="stable")
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [ids[order].tobytes()], "data": [data[order].tobytes()]})

        for b in batches:
            lists = b.column("v")
            ids, sizes = np.asarray(b.column("vec_id"), np.int64), np.asarray(pa.compute.list_value_length(lists))
            with np.errstate(over="ignore"):
                flat = np.clip(np.floor(np.asarray(pa.compute.list_flatten(lists), np.float64) * scale), -LARGEST, LARGEST)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == dim)
                data = flat[(ends[of][:, None] + np.arange(dim)).ravel()].reshape(len(of), dim)
                for at in range(0, len(of), rows):
                    i, d = held.setdefault(dim, ([], []))
                    i.append(ids[of[at : at + rows]])
                    d.append(data[at : at + rows])
                    if sum(map(len, i)) >= rows:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return bounded(vectors).select("vec_id", "v").mapInArrow(pack, TILES)


def products(queries: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, bool]:
    """Inner products, and whether they are machine integers (else Python's)."""
    most = lambda x: float(np.abs(x).max(initial=0))
    if most(queries) * most(shard) * max(1, queries.shape[1]) < 2**50:
        return (queries @ shard.T).astype(np.int64), True
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    out = whole(queries) @ whole(shard).T
    return np.array([[min(max(int(v), LEAST + 1), MOST) for v in row] for row in out], np.int64).reshape(len(queries), len(shard)), False


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first of each row by falling score, then rising id; empty places hold LEAST and MOST."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def select(scores: np.ndarray, small: bool, query_ids: np.ndarray, shard_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each query's k best of a shard that is sorted by id; a query's own id is left out."""
    n = len(shard_ids)
    ids = np.broadcast_to(shard_ids, scores.shape)
    scores = np.where(ids == query_ids[:, None], LEAST, scores)
    if n > k and small and n <= SHARD:  # one number orders by score, then place
        key = np.where(scores == LEAST, LEAST, scores * SHARD + (SHARD - 1 - np.arange(n)))
        at = np.argpartition(key, n - k, axis=1)[:, n - k :]
        scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    ids = np.where(scores == LEAST, MOST, ids)
    return best(np.maximum(scores, LEAST + 1) * (scores != LEAST) + LEAST * (scores == LEAST), ids, k)


def search_pass(shards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The shards' best lists for a bounded set of query tiles, one list a task and query."""
    pairs = shards.join(F.broadcast(queries.select(*[F.col(c).alias(f"q_{c}") for c in ("dim", "n", "ids", "data")])), F.col("dim") == F.col("q_dim"))

    def run(batches):
        lists: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r in b.to_pylist():
                q_ids, s_ids = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q = np.frombuffer(r["q_data"]).reshape(len(q_ids), r["dim"])
                s = np.frombuffer(r["data"]).reshape(len(s_ids), r["dim"])
                found = select(*products(q, s), q_ids, s_ids, k)
                key = (r["q_ids"], r["q_data"])
                if key in lists:
                    found = best(np.concatenate([lists[key][0], found[0]], 1), np.concatenate([lists[key][1], found[1]], 1), k)
                lists[key] = found
        for (q_ids, _), (scores, ids) in lists.items():
            row = np.repeat(np.frombuffer(q_ids, np.int64), scores.shape[1])
            full = scores.ravel() != LEAST
            yield pa.RecordBatch.from_pydict({"query_id": row[full], "vec_id": ids.ravel()[full], "score": scores.ravel()[full]})

    return pairs.mapInArrow(run, LISTS)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products among all vectors but those of its own id."""
    spark = vectors.sparkSession
    clean = lambda df: df.filter(F.col(id_column).isNotNull() & usable(vector_column)).select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    asked = clean(queries).distinct()
    shards_at, tiles_at, lists_at = scratch(spark, "shards"), scratch(spark, "tiles"), scratch(spark, "lists")
    tiles(clean(vectors), SHARD, scale).write.parquet(shards_at)
    tiles(asked.repartition(max(1, -(-asked.count() // TILE)), "vec_id", "v"), TILE, scale).withColumn("part", F.spark_partition_id()).write.parquet(tiles_at)
    shards = spark.read.schema(TILES).parquet(shards_at)
    packed = spark.read.schema(f"{TILES}, part int").parquet(tiles_at)
    # The pass of a tile follows from its part, so that a pass stays near PASS_BYTES however many queries there are.
    total, parts = packed.agg(F.sum(F.length("data") + F.length("ids")), F.max("part")).first()
    passes = max(1, -(-(total or 0) // PASS_BYTES))
    per = max(1, -(-((parts or 0) + 1) // passes))
    for p in range(-(-((parts or 0) + 1) // per)):
        found = search_pass(shards, packed.filter(F.col("part").between(p * per, (p + 1) * per - 1)), k)
        found.withColumn("part", F.spark_partition_id()).write.mode("append").parquet(lists_at)
    return merged(spark.read.schema(f"{LISTS}, part int").parquet(lists_at), k)


def merged(lists: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of its parts' lists, merged FAN at a time until one is left."""
    left = (lists.agg(F.max("part")).first()[0] or 0) + 1
    by = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
    while True:
        left = -(-left // FAN)
        lists = lists.withColumn("part", F.expr(f"part div {FAN}").cast("int")).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        if left <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = stored(lists.drop("rank"), "lists")
