"""Exact top-k search by inner product, as tiled matrix products.

Vectors are turned into whole numbers, floor(scale * x), so that scores are exact. Queries are cut into blocks and all vectors
into shards of bounded numbers of components. A task gets one block and one shard, multiplies them in tiles, and keeps
the k best of every query in each tile. The lists are merged in a tree: groups of neighbouring shards first, then groups of these
groups, so that no task ever sees more than ``FAN`` lists of a query.

Scores are worked out in float64 where every partial sum is below 2**53, and so exact, and in Python's whole
numbers otherwise; scores beyond the range of a long stay at its ends.

Defined cases: vectors that are null or hold a null, NaN or infinite component take no part, neither as queries nor as candidates. Vectors of
unlike length are multiplied over their common length (an empty one scores 0). Equal scores go to the smaller
id. An id is a vector's identity: a row is no candidate for its own id, a row that repeats id and vector counts once; rows
that share an id with unlike vectors are candidates of their own, and as queries they share one list. Rows with a null id take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 10
SCALE = 1024
CELLS = 1 << 20  # components of a shard or block, at most
TILE = 1 << 22  # scores held at once
FAN = 8  # lists merged at once
LONG = 2**63


def matrix(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """Rows floor(scale * x) as float64, short rows filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy())
    width = int(lengths.max(initial=0))
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def best(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of the k best rows of each query, ties to the smaller id. ``row_ids`` ascend."""
    width = min(queries.shape[1], rows.shape[1])
    queries, rows = queries[:, :width], rows[:, :width]
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, width)
    if most >= 2**53:
        return _best_whole(queries, ids, rows, row_ids, k)
    out = []
    step = max(1, TILE // max(1, len(rows)))
    for at in range(0, len(queries), step):
        part = ids[at:at + step]
        scores = queries[at:at + step] @ rows.T
        scores[part[:, None] == row_ids[None, :]] = -np.inf
        there = min(k, scores.shape[1])
        floor = np.partition(scores, scores.shape[1] - there, axis=1)[:, scores.shape[1] - there]
        q, r = np.nonzero((scores >= floor[:, None]) & np.isfinite(scores))
        value = scores[q, r]
        order = np.lexsort((r, -value, q))
        q, r, value = q[order], r[order], value[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        out += zip(part[q[keep]].tolist(), row_ids[r[keep]].tolist(), value[keep].astype(np.int64).tolist())
    return out


def _best_whole(queries, ids, rows, row_ids, k):
    exact = [[int(x) for x in row] for row in rows.tolist()]
    out = []
    for query, own in zip(queries.tolist(), ids.tolist()):
        numbers = [int(x) for x in query]
        scored = ((sum(a * b for a, b in zip(numbers, row)), i) for row, i in zip(exact, row_ids.tolist()) if i != own)
        clipped = ((max(-LONG, min(LONG - 1, s)), i) for s, i in scored)
        out += [(own, i, s) for s, i in sorted(clipped, key=lambda x: (-x[0], x[1]))[:k]]
    return out


def _distinct(table: pa.Table) -> pa.Table:
    """Rows by ascending id, repeated rows (same id and hash of the vector) once."""
    table = table.sort_by([("id", "ascending"), ("same", "ascending")])
    ids, same = table["id"].to_numpy(), table["same"].to_numpy()
    fresh = np.r_[True, (ids[1:] != ids[:-1]) | (same[1:] != same[:-1])] if len(ids) else np.zeros(0, bool)
    return table.filter(pa.array(fresh))


def search(vectors: DataFrame, is_query: Column, k: int = K, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
           cells: int = CELLS, fan: int = FAN) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row that ``is_query`` names."""
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id).isNotNull() & sound).select(
        F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.xxhash64(vector).alias("same"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    size = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), F.max(F.size("v"))).first()
    per_part = max(1, cells // max(1, size[2] or 1))
    shards, blocks = max(1, -(-size[0] // per_part)), max(1, -(-size[1] // per_part))
    dealt = F.xxhash64("id", "same")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt_to = lambda n: F.pmod(dealt, F.lit(n)).cast("int")
    sides = []
    for side, shard, block in ((rows, dealt_to(shards), every(blocks)), (rows.where("asks"), every(shards), dealt_to(blocks))):
        # Columns are renamed on each side: both come from one table, and a cogroup needs them apart.
        sides.append(side.select(F.col("id").alias(f"id{len(sides)}"), F.col("v").alias(f"v{len(sides)}"), F.col("same").alias(f"same{len(sides)}"), shard.alias(f"shard{len(sides)}"), block.alias(f"block{len(sides)}")))
    candidates, asking = sides

    def tile(asks: pa.Table, there: pa.Table) -> pa.Table:
        names = ["query_id", "shard", "vec_id", "score"]
        if not asks.num_rows or not there.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names=names)
        shard = there[3][0].as_py()
        asks, there = (_distinct(t.select([0, 1, 2]).rename_columns(["id", "v", "same"])) for t in (asks, there))
        found = best(matrix(asks["v"], scale), asks["id"].to_numpy(), matrix(there["v"], scale), there["id"].to_numpy(), k)
        q, r, s = zip(*found) if found else ((), (), ())
        return pa.Table.from_arrays([pa.array(q, pa.int64()), pa.array([shard] * len(q), pa.int32()), pa.array(r, pa.int64()), pa.array(s, pa.int64())], names=names)

    lists = asking.groupBy("block1", "shard1").cogroup(candidates.groupBy("block0", "shard0")).applyInArrow(
        tile, "query_id long, shard int, vec_id long, score long")
    merged = lists.select("query_id", F.col("shard").alias("part"), F.struct(F.col("score"), F.col("vec_id")).alias("hit"))
    order = lambda a, b: F.when(a.score != b.score, F.when(a.score > b.score, -1).otherwise(1)).otherwise(F.when(a.vec_id < b.vec_id, -1).when(a.vec_id > b.vec_id, 1).otherwise(0))
    width = shards
    while True:
        width = -(-width // fan)
        gathered = merged.groupBy("query_id", (F.col("part") / fan).cast("int").alias("part")).agg(
            F.slice(F.array_sort(F.collect_list("hit"), order), 1, k).alias("hits"))
        merged = gathered.select("query_id", "part", F.explode("hits").alias("hit"))
        if width <= 1:
            break
    return gathered.select("query_id", F.posexplode("hits").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
