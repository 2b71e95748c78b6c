"""Substring dedup by seed and extend (operator 2).

Seeds: of every window of `length` words, the k-gram of least hash is its anchor (winnowing). The choice depends on the
window's words alone, so two equal windows have equal anchors at equal places. Anchors that occur once seed nothing and go
after one count. Extension: an anchor occurrence carries the stretch of words that its consecutive windows cover, as a
hash; occurrences with the same stretch match over all of it, both ways. Only where an anchor stands in different
stretches are the first occurrence of each stretch read again and its windows compared one by one. Matched windows that
touch or overlap are merged into maximal repeats, and their words go.

Both steps keep just the earliest occurrence of a key, by partial aggregation, so a passage that a third of all
documents share meets as one row of each task. No pairs of occurrences are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.shared import forget, keep
from folium.llm.words import Words, grams, signed, slices, spans

#: Words of a window; words of an anchor.
LENGTH, ANCHOR = 20, 5


def anchors_of(words: Words, length: int = LENGTH, k: int = ANCHOR):
    """(text index, anchor hash, stretch hash, first window, windows) of each run of windows with one anchor."""
    h = words.hashes()
    size = words.n - length + 1
    has = np.flatnonzero(size > 0)
    if not len(has):
        return (np.zeros(0, np.int64),) * 5
    g, span = grams(h, k), length - k + 1
    least, reach = np.arange(len(g)), 1
    while reach < span:  # least[i]: first place of the least hash among reach places from i
        step = min(reach, span - reach)
        near, far = least[: len(least) - step], least[step:]
        least, reach = np.where(g[far] < g[near], far, near), reach + step
    doc = np.repeat(has, size[has])
    ends = np.cumsum(size[has])
    place = np.arange(ends[-1]) + np.repeat(words.first[has] - np.concatenate([[0], ends[:-1]]), size[has])
    chosen = least[place]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])])
    begin = np.flatnonzero(new)
    n = np.diff(np.concatenate([begin, [len(place)]]))
    lo, at = place[begin], chosen[begin]
    stretch = spans(h, lo, lo + n + length - 1) ^ (at - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return doc[begin], g[at], stretch, lo - words.first[doc[begin]], n


def seeds(length: int, k: int, full: bool):
    """mapInArrow function: doc_id, text -> anchor, and where it stands if full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, anchor, stretch, start, n = anchors_of(Words(batch.column("text")), length, k)
            cols, names = [pa.array(signed(anchor))], ["anchor"]
            if full:
                cols += [batch.column("doc_id").take(pa.array(doc)), pa.array(signed(stretch)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))]
                names += ["doc_id", "stretch", "start", "n"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def windows(length: int):
    """mapInArrow function: doc_id, text, unclear -> doc_id, n_words, kept_sha256 if nothing can go; else text, and its unclear windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"))
            h = words.hashes()
            touched = batch.column("touched").to_pylist()
            unclear = batch.column("unclear").to_pylist()
            shas = [None if x else hashlib.sha256(y).hexdigest() for x, y in zip(touched, words.joined(), strict=True)]
            own = [np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in some]) if some else np.zeros(0, np.int64) for some in unclear]
            at = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            start = np.concatenate(own)
            begin = start + np.repeat(words.first[:-1], np.diff(at))
            hi, lo = (signed(spans(h, begin, begin + length, seed)) for seed in (0, 1))
            items = pa.StructArray.from_arrays([pa.array(hi), pa.array(lo), pa.array(start.astype(np.int32))], ["hi", "lo", "start"])
            # Texts travel once more, for their words to be cut: compressed.
            pack = zstandard.ZstdCompressor(level=6).compress
            text = pa.array([pack((t or "").encode()) if x else None for t, x in zip(batch.column("text").to_pylist(), touched, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.n.astype(np.int64)), pa.array(shas, pa.string()), text, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), items)], ["doc_id", "n_words", "kept_sha256", "text", "windows"])

    return run


def removal(length: int):
    """mapInArrow function: doc_id, n_words, text, repeats -> the text without the words that repeats cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            unpack = zstandard.ZstdDecompressor().decompress
            words = Words(pa.array([unpack(t).decode() for t in batch.column("text").to_pylist()], pa.large_string()))
            removed, n_spans, stays = [], [], np.ones(len(words.starts), bool)
            for i, some in enumerate(batch.column("repeats").to_pylist()):
                delta = np.zeros(words.n[i] + 1, np.int64)
                for x in some or ():
                    delta[x["start"]] += 1
                    delta[x["start"] + x["n"] + length - 1] -= 1
                gone = np.cumsum(delta[:-1]) > 0
                removed.append(int(gone.sum()))
                n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                stays[words.first[i] : words.first[i + 1]] = ~gone
            kept = [x.decode() for x in words.joined(stays)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "n_repeats", "kept"])

    return run


def substring_dedup(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, n_repeats (maximal repeats), kept_text (null: the text as it is), kept_sha256 for each row of docs.

    Null and empty texts have no words; documents under `length` words lose none. Repeated rows of a doc_id are one
    document when order is asked: each such row gets the same answer. A null doc_id sorts before all others.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common = texts.mapInArrow(seeds(length, k, False), "anchor long").groupBy("anchor").agg(F.count("*").alias("f")).where("f > 1").select("anchor")
    found = texts.mapInArrow(seeds(length, k, True), "anchor long, doc_id long, stretch long, start int, n int")
    found = keep(found.join(common, "anchor"), "anchors")
    firsts = keep(found.groupBy("anchor", "stretch").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.first("n").alias("n")), "stretches")
    several = firsts.groupBy("anchor").agg(F.min("stretch").alias("x"), F.max("stretch").alias("y")).where("x <> y").select("anchor")
    known = (
        found.join(firsts.select("anchor", "stretch", "first"), ["anchor", "stretch"])
        .where(~F.struct("doc_id", "start").eqNullSafe(F.col("first"))).select("doc_id", "start", "n")
    )
    known = keep(known, "known")
    unclear = firsts.join(several, "anchor").select("first.*", "n").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("unclear"))
    touched = found.select("doc_id").distinct().join(unclear.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d")), "left").select(F.col("doc_id").alias("d"), "unclear", F.lit(True).alias("touched"))
    touched = keep(touched, "touched")
    # Anchors go before texts are dealt out, so that the two never lie on disk together.
    forget(found), forget(firsts)
    read = texts.join(touched, F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "text", "unclear", F.coalesce("touched", F.lit(False)).alias("touched"))
    schema = "doc_id long, n_words long, kept_sha256 string, text binary, windows array<struct<hi: long, lo: long, start: int>>"
    read = keep(read.mapInArrow(windows(length), schema), "windows")
    each = read.where(F.size("windows") > 0).select("doc_id", F.explode("windows").alias("w")).select("doc_id", "w.*")
    least = each.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("f")).where("f > 1").drop("f")
    single = each.join(least, ["hi", "lo"]).where(~F.struct("doc_id", "start").eqNullSafe(F.col("first"))).select("doc_id", "start", F.lit(1).alias("n"))
    repeats = known.union(single).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("repeats")).withColumnRenamed("doc_id", "d")
    repeats = keep(repeats, "repeats")
    forget(known), forget(touched)
    plain = read.where("kept_sha256 is not null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_repeats"), F.lit(None).cast("string").alias("kept_text"), "kept_sha256")
    cut = read.where("kept_sha256 is null").select("doc_id", "n_words", "text").join(repeats, F.col("doc_id").eqNullSafe(F.col("d")), "left").select("doc_id", "n_words", "text", "repeats")
    cut = cut.mapInArrow(removal(length), "doc_id long, n_words long, n_removed long, n_repeats long, kept string")
    return plain.union(cut.select("doc_id", "n_words", "n_removed", "n_repeats", F.col("kept").alias("kept_text"), F.sha2("kept", 256).alias("kept_sha256")))
