"""Nearest neighbours by a block matrix join.

Vectors are scaled to length one and rounded to int8.  Query blocks meet
candidate blocks in tiles; one product of a tile's int8 matrices gives all its
cosines, each with a bound on the rounding error.  Pairs whose upper bound
reaches the best lower bounds are computed again from the original vectors, in
double precision, and the nearest are merged in heaps.  So the result is exact,
and no tile, heap or shuffled block grows with the table.

Vectors that are null, zero, empty, or hold null or non-finite components take
no part; vectors of different lengths don't meet.  Rows with the query's own
id are no candidates.  Of several rows with one query id the smallest vector
asks; repeated candidate rows count as often as they stand there.  Ties go to
the smaller vec_id.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Vectors of a query block and of a candidate block.
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 4096
#: Candidate blocks that one copy of a query block meets, at most.
BLOCKS_PER_COPY = 8

_BLOCK = "dim int, ids binary, vectors binary, codes binary, scales binary, errors binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _pack(ids: np.ndarray, x: np.ndarray) -> tuple:
    """Vectors, their int8 codes, scales, and the lengths of the rounding errors (a little more, for the float arithmetic).

    Vectors are kept scaled by a power of two of their own, which leaves their
    cosines the same to the last bit and their squares within range.
    """
    top = np.abs(x).max(1, keepdims=True)
    powers = np.frexp(top)[1]
    x, top = np.ldexp(x, -powers), np.ldexp(top, -powers)
    unit = x / top
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(1)) + 1e-6
    return x.shape[1], ids.tobytes(), x.tobytes(), codes.tobytes(), scale.tobytes(), error.tobytes()


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v) packed into blocks, partition by partition."""

    def run(batches):
        held: dict[int, list] = {}

        def out(dim):
            ids, vs = zip(*held.pop(dim), strict=True)
            made = _pack(np.array(ids, np.int64), np.array(vs, np.float64))
            return pa.RecordBatch.from_arrays([pa.array([made[0]], pa.int32()), *(pa.array([m], pa.binary()) for m in made[1:])], ["dim", "ids", "vectors", "codes", "scales", "errors"])

        for batch in batches:
            flat = batch.column(1)
            ends, values = flat.offsets.to_numpy(), flat.values.to_numpy()
            for i, k in enumerate(batch.column(0).to_numpy()):
                v = values[ends[i] : ends[i + 1]]
                held.setdefault(len(v), []).append((k, v))
                if len(held[len(v)]) >= size:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return rows.select("id", "v").mapInArrow(run, _BLOCK)


def _tile(q, c, k: int, heaps: dict) -> None:
    """All of a tile's pairs that can be among the k nearest go into the heaps of their queries."""
    qi, qv, q8, qs, qe = q
    ci, cv, c8, cs, ce = c
    # Products of int8 codes are whole numbers; float32 holds them exactly in strips of 1024 components.
    near = np.zeros((len(qi), len(ci)), np.float32)
    for a in range(0, q8.shape[1], 1024):
        near += q8[:, a : a + 1024].astype(np.float32) @ c8[:, a : a + 1024].astype(np.float32).T
    near *= qs[:, None].astype(np.float32)
    near *= cs[None, :].astype(np.float32)
    slack = (qe[:, None] * (1 + ce[None, :]) + ce[None, :]).astype(np.float32) + np.float32(1e-5)
    near[qi[:, None] == ci[None, :]] = -4  # a row with the query's own id
    low = near - slack
    at_least = np.partition(low, len(ci) - k, axis=1)[:, len(ci) - k] if len(ci) > k else np.full(len(qi), -3.0)
    known = np.array([heaps[i][0][0] if len(heaps.get(i, ())) >= k else -3.0 for i in qi.tolist()])
    near += slack
    row, column = np.nonzero((near >= np.maximum(at_least, known - 1e-9)[:, None]) & (near > -3))
    x, y = qv[row], cv[column]
    dot, xx, yy = (np.zeros(len(row)) for _ in range(3))
    for d in range(x.shape[1]):
        dot += x[:, d] * y[:, d]
        xx += x[:, d] * x[:, d]
        yy += y[:, d] * y[:, d]
    score = dot / (np.sqrt(xx) * np.sqrt(yy))
    for query, candidate, s in zip(qi[row].tolist(), ci[column].tolist(), score.tolist(), strict=True):
        push(heaps.setdefault(query, []), (s, -candidate), k)


def push(heap: list, item: tuple, k: int) -> None:
    if len(heap) < k:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def _unpack(row: dict, prefix: str):
    dim = row["dim"]
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    return (ids, np.frombuffer(row[f"{prefix}vectors"], np.float64).reshape(-1, dim), np.frombuffer(row[f"{prefix}codes"], np.int8).reshape(-1, dim), np.frombuffer(row[f"{prefix}scales"], np.float64), np.frombuffer(row[f"{prefix}errors"], np.float64))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, blocks_per_copy: int = BLOCKS_PER_COPY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors with the largest cosine to each row of queries."""
    # Both sides are packed once; what is counted after are blocks.
    work = Workspace(vectors.sparkSession, "neighbours")
    c = work.table(_blocks(usable(vectors, id_col, vector_col), candidate_block), "candidates")
    asked = work.table(usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")), "asked")
    n_query_blocks = max(1, -(-asked.count() // query_block))
    n_blocks = c.count()
    n_copies = max(1, -(-n_blocks // blocks_per_copy), min(n_blocks, vectors.sparkSession.sparkContext.defaultParallelism))
    dealt = asked.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(n_query_blocks))).repartition(n_query_blocks, "p")
    q = _blocks(dealt, query_block)
    q = q.select("dim", *[F.col(name).alias(f"q_{name}") for name in ("ids", "vectors", "codes", "scales", "errors")])
    # The grid of tiles is laid out by an equi-join: a candidate block goes to one share of the copies, a query block to all shares.
    q = q.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(n_copies - 1))))
    c = c.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(n_copies)).cast("int"))
    tiles = c.join(q, ["dim", "share"])

    def meet(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _tile(_unpack(row, "q_"), _unpack(row, ""), k, heaps)
                if len(heaps) > 16 * query_block:
                    yield _rows(heaps)
                    heaps = {}
        if heaps:
            yield _rows(heaps)

    def merge(batches):
        heaps: dict[int, list] = {}
        for batch in batches:
            for query, candidate, s in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                push(heaps.setdefault(query, []), (s, -candidate), k)
        found = [(query, r + 1, -c, s) for query, heap in heaps.items() for r, (s, c) in enumerate(sorted(heap, reverse=True))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)], ["query_id", "rank", "vec_id", "score"])

    found = tiles.mapInArrow(meet, "query_id long, vec_id long, score double")
    return found.repartition("query_id").mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def _rows(heaps: dict) -> pa.RecordBatch:
    rows = [(query, -c, s) for query, heap in heaps.items() for s, c in heap]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])
