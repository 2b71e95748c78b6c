"""Mixing sources to target weights by the cube method (operator 3).

Each source has a target of words; target / size is the expected number of copies of each of its documents. Whole copies are
taken, and the fraction is left to a balanced sample: the flight phase moves the fractional inclusion probabilities of three
documents at a time along the null space of the two constraints (number of documents, number of words) until one of them is
0 or 1. It runs in blocks of a source; the one or two documents that a block leaves undecided meet in blocks of the next
level, and the last one or two of a source are the landing problem, solved by trying every outcome. What that misses by is made
up by a few exchanges within the last block, which keep the number of documents.
"""

from __future__ import annotations

import zlib
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.shared import keep, n_words

#: Weights of the sources in turn; words asked for, times the words there are; most copies.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Documents of a block; most sources that are broadcast.
BLOCK, BROADCAST_SOURCES = 1024, 50_000
#: Exchanges of documents that a source's last block may make.
MOVES = 64
_EPS = 1e-9


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sources: source, source_size; adds target: shares by weight, none above cap times its size, the excess shared again by weight.

    One row a source, so the windows over all of them stay small. The shares end at one level: a source gets weight * level
    words, or its cap if that is less; sorted by cap / weight, those below the level come first.
    """
    ordered = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    ordered = ordered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    ordered = ordered.withColumn("most", cap * F.col("source_size").cast("double")).withColumn("full_at", F.col("most") / F.col("weight"))
    every, before = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = share * F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ordered = ordered.withColumn("level", level)
    ordered = ordered.withColumn("first", F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "rank", "level"))).over(every))
    target = F.when(F.col("first").isNull() | (F.col("full_at") < F.col("first.level")), F.col("most")).otherwise(F.col("weight") * F.col("first.level"))
    return ordered.select("source", "source_size", target.alias("target"))


def flight(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """p moved to 0 or 1 with the sums of p and p * size kept; at most two stay between."""
    p, size, draws = p.tolist(), size.tolist(), iter(draw.tolist())
    held: list[int] = []
    for i in range(len(p)):
        if p[i] <= _EPS or p[i] >= 1 - _EPS:
            p[i] = round(p[i])
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        u = u if any(u) else (1, -1, 0)
        up = min(((1 - p[k]) / x if x > 0 else -p[k] / x) for k, x in zip(held, u, strict=True) if x)
        down = min((p[k] / x if x > 0 else (p[k] - 1) / x) for k, x in zip(held, u, strict=True) if x)
        step = up if next(draws) * (up + down) < down else -down
        for k, x in zip(held, u, strict=True):
            p[k] += step * x
            if p[k] <= _EPS or p[k] >= 1 - _EPS:
                p[k] = float(round(p[k]))
        held = [k for k in held if 0 < p[k] < 1]
    if len(held) == 2 and size[held[0]] == size[held[1]]:
        a, b = held
        up, down = min(1 - p[a], p[b]), min(p[a], 1 - p[b])
        step = up if next(draws) * (up + down) < down else -down
        for k, x in ((a, step), (b, -step)):
            p[k] = float(round(p[k] + x)) if min(p[k] + x, 1 - p[k] - x) <= _EPS else p[k] + x
    return np.array(p, float)


def settle(size: np.ndarray, p: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """p with long documents decided first, each against all open documents at once; in threes they would stay to the end."""
    p = p.copy()
    long = np.argsort(-size, kind="stable")
    for i, chance in zip(long[size[long] > 2 * size.mean()], draw, strict=False):
        rest = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
        if len(rest) < 4 or not _EPS < p[i] < 1 - _EPS:
            continue
        rest = rest[rest != i]
        x = size[rest].astype(float)
        sums = np.array([[len(x), x.sum()], [x.sum(), (x * x).sum()]])
        if abs(np.linalg.det(sums)) < 1e-6 * sums[0, 0] * sums[1, 1]:
            continue
        a, b = np.linalg.solve(sums, [-1.0, -float(size[i])])
        who, u = np.append(rest, i), np.append(a + b * x, 1.0)
        moves = np.abs(u) > 1e-12
        room = np.where(u > 0, 1 - p[who], p[who])[moves] / np.abs(u[moves])
        back = np.where(u > 0, p[who], 1 - p[who])[moves] / np.abs(u[moves])
        up, down = room.min(), back.min()
        p[who] += (up if chance * (up + down) < down else -down) * u
        near = (p <= _EPS) | (p >= 1 - _EPS)
        p[near] = np.round(p[near])
    return p


def landing(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The outcome of the few undecided whose words, then number, are nearest to what is expected."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if not len(open_):
        return p
    want = (p[open_] * size[open_]).sum(), p[open_].sum()
    best = min(product((0.0, 1.0), repeat=len(open_)), key=lambda s: (abs(np.dot(s, size[open_]) - want[0]), abs(sum(s) - want[1]), s))
    out = p.copy()
    out[open_] = best
    return out


def polished(size: np.ndarray, p: np.ndarray, want: float, moves: int = MOVES) -> np.ndarray:
    """p after up to so many exchanges of a taken document for another, each the one that brings the taken words nearest to want."""
    p = p.copy()
    for _ in range(moves):
        short = want - float(np.dot(p, size))
        taken, left = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        if abs(short) < 0.5 or not len(taken) or not len(left):
            return p
        left = left[np.argsort(size[left], kind="stable")]
        at = np.searchsorted(size[left], size[taken] + short)
        near = np.stack([np.clip(at - 1, 0, len(left) - 1), np.clip(at, 0, len(left) - 1)])
        miss = np.abs(short - (size[left][near] - size[taken]))
        side, i = np.unravel_index(int(miss.argmin()), miss.shape)
        if miss[side, i] >= abs(short):
            return p
        p[taken[i]], p[left[near[side, i]]] = 0.0, 1.0
    return p


def fly(level: int, seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "turn", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(zlib.crc32(f"{seed}|{level}|{pdf['source'].iloc[0]}|{pdf['block'].iloc[0]}".encode()))
        size = pdf["size"].to_numpy()
        p = flight(size, settle(size, pdf["p"].to_numpy(), rng.random(len(pdf))), rng.random(len(pdf) + 1))
        return pdf.assign(p=polished(size, landing(size, p), float(np.dot(pdf["p"], size))) if last else p)

    return run


def mixed(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs (doc_id, source; size: its words).

    Null sources are one source, last in order. Documents without words take part (their copies cost nothing); a source
    without words has target 0 and no copies. Repeated rows are drawn each by itself. Equal input gives equal output.
    """
    base = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "sizes")
    sources = keep(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).drop("n"), weights, share, cap), "targets")
    counts = base.groupBy("source").agg(F.count("*").alias("n"))
    facts = keep(sources.withColumnRenamed("source", "s").join(counts, F.col("s").eqNullSafe(F.col("source"))).drop("source"), "sources")
    many, largest = facts.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    facts = F.broadcast(facts) if many <= BROADCAST_SOURCES else facts
    pi = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    turn = F.xxhash64("doc_id", F.lit(seed))
    units = (
        base.join(facts, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "source", "size", "source_size", "target", F.floor(pi + _EPS).cast("long").alias("whole"), F.greatest(pi - F.floor(pi + _EPS), F.lit(0.0)).alias("p"), turn.alias("turn"), F.pmod(turn, F.ceil(F.col("n") / block)).alias("block"))
    )
    schema, blocks, level, decided = units.schema, -(-largest // block), 0, []
    while True:
        last = blocks <= 1
        units = keep(units.groupBy("source", "block").applyInPandas(fly(level, seed, last), schema), f"flight{level}")
        decided.append(units if last else units.where("p = 0 or p = 1"))
        if last:
            break
        units = units.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / (block // 2)))
        blocks, level = -(-blocks // (block // 2)), level + 1
    out = decided[0]
    for x in decided[1:]:
        out = out.union(x)
    copies = F.col("whole") + F.round("p").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """mixed() with the number of words of text as size."""
    return mixed(docs, n_words(F.col("text")), **settings)
