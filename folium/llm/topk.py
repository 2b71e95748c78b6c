"""Exact top-k inner products over norm-sorted vectors (operator 4).

Vectors become integers and are dealt in blocks by descending length. A block is rotated by the right singular vectors of the
longest block, so that the first coordinates hold most of a product; a partial sum over them plus the Cauchy-Schwarz bound of
the two residuals (each residual's length) is an upper bound of the whole product. The longest block gives each query its
first k-th best score, and with it the length below which no vector can reach that. Queries are dealt in blocks by that
length, and a block of vectors meets only the query blocks that its longest vector could serve. In a block a query
stops at the first vector whose length times its own is below its score, and only vectors whose bound reaches it are
multiplied out, in exact integers. Query blocks of a counted size are broadcast, so that vectors are not moved again; beyond, both
are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.shared import keep

#: Vectors of a block; queries of a block; coordinates of the partial sum.
ROWS, QUERIES, HEAD = 4_096, 2_048, 16
#: Longest vectors that are looked at first, by the driver.
LONGEST = 1_024
#: Bytes of all queries that are broadcast at most.
BROADCAST_BYTES = 48_000_000
_EXACT = float(2**53)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, or as Python's integers if a product could pass 2**53."""
    x = np.floor(x * float(scale))
    if x.size and float(np.abs(x).max()) ** 2 * x.shape[1] >= _EXACT:
        return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return x.astype(np.int64)


def packed(dim: int, rows: int):
    """mapInPandas function: vec_id, x, length (squared) -> blocks of at most `rows` vectors, numbered by partition and place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get().partitionId(), 0
        for pdf in frames:
            for a in range(0, len(pdf), rows):
                part = pdf.iloc[a : a + rows]
                x = np.zeros((len(part), dim))
                for i, v in enumerate(part["x"]):
                    x[i, : len(v)] = v
                yield pd.DataFrame({"block": [task * 1_000_000 + n], "longest": [float(np.sqrt(part["length"].max()))], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "data": [x.tobytes()]})
                n += 1

    return run


def best(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, floor: np.ndarray, basis: np.ndarray) -> list[tuple[int, int, int]]:
    """(query, vector, score) that may be among a query's k best; floor: the score that a query has k times already."""
    if q.dtype == object or v.dtype == object:  # beyond exact doubles: every product, in Python's integers
        scores = q.astype(object) @ v.T.astype(object)
        rows = ((a, sorted(((-s, b) for s, b in zip(r, vid, strict=True) if b != a))[:k]) for a, r in zip(qid, scores, strict=True))
        return [(a, b, max(-(2**63), min(2**63 - 1, -s))) for a, r in rows for s, b in r]
    order = np.argsort(-np.linalg.norm(v.astype(float), axis=1), kind="stable")
    vid, v = vid[order], v[order]
    length = np.linalg.norm(v.astype(float), axis=1)
    vr, qr = v @ basis, q @ basis
    head = min(HEAD, vr.shape[1])
    v_rest, q_rest = np.linalg.norm(vr[:, head:], axis=1), np.linalg.norm(qr[:, head:], axis=1)
    q_length = np.linalg.norm(q.astype(float), axis=1)
    slack = 1e-6 * (q_length * length.max() + 1)
    out = []
    step = 2_048
    for i in range(len(qid)):
        need, found = float(floor[i]), []
        for a in range(0, len(vid), step):
            if q_length[i] * length[a] + slack[i] < need:
                break  # all that follow are shorter
            at = slice(a, a + step)
            bound = vr[at, :head] @ qr[i, :head] + v_rest[at] * q_rest[i] + slack[i]
            who = np.flatnonzero(bound >= need) + a
            who = who[vid[who] != qid[i]]
            if not len(who):
                continue
            score = v[who] @ q[i]
            found += zip((-score).tolist(), vid[who].tolist(), strict=True)
            if len(found) > k:
                found = sorted(found)[:k]
                need = max(need, float(-found[-1][0]))
        out += [(int(qid[i]), b, -s) for s, b in sorted(found)[:k]]
    return out


def unpacked(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(data, np.float64).reshape(len(ids), -1)


def floors(k: int, scale: int, dim: int, longest: tuple[np.ndarray, np.ndarray]):
    """mapInPandas function: vec_id, x -> these with floor (a score that k vectors reach) and need (length below which none can reach it)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            q = np.zeros((len(pdf), dim))
            for i, v in enumerate(pdf["x"]):
                q[i, : len(v)] = v
            q, ids = whole(q, scale), pdf["vec_id"].to_numpy(np.int64)
            lowest = np.full(len(pdf), -np.inf)
            if q.dtype != object and longest[1].dtype != object and len(pdf):
                scores = (q @ longest[1].T).astype(float)
                scores[ids[:, None] == longest[0][None, :]] = -np.inf
                if scores.shape[1] >= k:
                    lowest = np.partition(scores, -k, axis=1)[:, -k]
            length = np.linalg.norm(q.astype(float), axis=1)
            # One part in a million less, for rounding; a score of zero or less needs no length.
            need = np.where((lowest > 0) & (length > 0), lowest / np.maximum(length, 1e-9) * (1 - 1e-6), 0.0)
            yield pdf.assign(floor=lowest, need=need)

    return run


def packed_queries(dim: int, rows: int):
    """mapInPandas function: vec_id, x, floor, need in order of need -> blocks with their least need."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, n = TaskContext.get().partitionId(), 0
        for pdf in frames:
            for a in range(0, len(pdf), rows):
                part = pdf.iloc[a : a + rows]
                x = np.zeros((len(part), dim))
                for i, v in enumerate(part["x"]):
                    x[i, : len(v)] = v
                yield pd.DataFrame({"asked": [task * 1_000_000 + n], "least": [part["need"].min()], "q_ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "q_data": [x.tobytes()], "q_floor": [part["floor"].to_numpy(float).tobytes()]})
                n += 1

    return run


_SCORES = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def searched(k: int, scale: int, basis: np.ndarray):
    """mapInArrow function: a block of queries, a block of vectors -> query_id, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            qid, q = unpacked(row["q_ids"], row["q_data"])
            vid, v = unpacked(row["ids"], row["data"])
            out = best(qid, whole(q, scale), vid, whole(v, scale), k, np.frombuffer(row["q_floor"]), basis)
            yield pa.RecordBatch.from_pydict({"query_id": [x[0] for x in out], "vec_id": [x[1] for x in out], "score": [x[2] for x in out]}, _SCORES)

    return run


def top_k(vectors: DataFrame, k: int = 10, modulus: int = 100, scale: int = 1024, rows: int = ROWS, queries: int = QUERIES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the k best others of each row whose vec_id is divisible by modulus.

    vectors: vec_id, embedding. Components become floor(scale * x). Rows with a null id or vector, or a null or non-finite
    component, take no part; shorter vectors are padded with zeros. Ties go to the smaller vec_id. Rows with a query's id
    are not its candidates; other repeated rows are candidates each, and a repeated query is asked once. Scores beyond 64
    bits are held at the end of the range. No vectors or no queries: no rows.
    """
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
    length = F.aggregate("x", F.lit(0.0), lambda s, c: s + F.floor(c * float(scale)).cast("double") * F.floor(c * float(scale)).cast("double"))
    base = keep(base.select("vec_id", "x", length.alias("length")), "vectors")
    n, dim = base.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    # The longest vectors give the rotation, and each query a score that k vectors reach.
    top = base.orderBy(F.desc("length"), "vec_id").limit(LONGEST).select("vec_id", "x").collect()
    data = np.zeros((len(top), dim))
    for i, r in enumerate(top):
        data[i, : len(r.x)] = r.x
    longest = (np.array([r.vec_id for r in top], np.int64), whole(data, scale))
    basis = np.linalg.svd(np.floor(data * scale), full_matrices=len(top) < dim)[2].T if len(top) and dim else np.zeros((dim, dim))
    ranged = base.repartitionByRange(max(1, -(-n // rows)), F.desc("length"), "vec_id").select("vec_id", "x", "length")
    blocks = keep(ranged.mapInPandas(packed(dim, rows), "block long, longest double, ids binary, data binary"), "blocks")
    asked = base.where(F.col("vec_id") % modulus == 0).groupBy("vec_id").agg(F.min("x").alias("x")).mapInPandas(floors(k, scale, dim, longest), "vec_id long, x array<double>, floor double, need double")
    asked = asked.repartitionByRange(max(1, -(-n // (modulus * queries))), "need", "vec_id").sortWithinPartitions("need", "vec_id")
    asked = keep(asked.mapInPandas(packed_queries(dim, queries), "asked long, least double, q_ids binary, q_data binary, q_floor binary"), "queries")
    could = F.col("longest") >= F.col("least")
    if asked.agg(F.coalesce(F.sum(F.length("q_data")), F.lit(0))).first()[0] <= broadcast_bytes:
        pairs = blocks.join(F.broadcast(asked), could)
    else:  # first which blocks meet, then what they hold
        met = blocks.select("block", "longest").join(F.broadcast(asked.select("asked", "least")), could).select("block", "asked")
        pairs = met.join(asked, "asked").join(blocks, "block")
    found = pairs.select("q_ids", "q_data", "q_floor", "ids", "data").mapInArrow(searched(k, scale, basis), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
