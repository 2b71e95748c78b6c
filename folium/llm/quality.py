"""Quality classifier: interpolated modified Kneser-Ney bigrams of trusted text (operator 10).

All words and bigrams of trusted text are counted, by language, in partial sums that Spark adds up by key. The chance of a word w
after v is

    p(w|v) = (c(v,w) - D) / c(v) + rest(v) * p(w),    p(w) = max(n(w) - D, 0) / n + rest / (words + 1),

n(w) being the number of words seen before w. The first term stands for every bigram that was seen (least: or only for those seen so often; rarer ones then count in c(v)
and n(w), and their share is in rest(v)). Without that term the chance is a product, so a text's log-probability is
the sum of log rest(v) and log p(w) over all its words, plus log p(w|v) - log rest(v) - log p(w) over such bigrams. Each of
these is one entry of a table of weights by key: contexts, words and bigrams. A text asks for its keys; the SHARD_ROWS most
frequent entries are one shard that is broadcast and looked up in place, and the other keys are joined to the rest of the table,
unless a Bloom filter of these, of at most BLOOM_BITS bits, tells that they have no entry. Weights and look-ups go through their
joins in a few passes, each for its share of keys, so that less is on disk at once. Neither where an entry is looked up, nor the
filter, nor the number of passes changes a result.

One in HELD_OUT trusted documents is left out of the counts, and on these the quantiles are taken: a document is rejected if its
perplexity, drawn towards its language's mean by PRIOR words, is above the language's quantile over held-out trusted documents
times MARGIN. A language without held-out documents takes the bar of all languages together. A document of unknown language is
scored by every model and judged by the one that fits best.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.llm.shared import forget, keep, n_words, trim
from folium.llm.words import Words, mix, signed, slices

U = np.uint64
#: Most weights of the shard that is broadcast; most labelled rows that are broadcast.
SHARD_ROWS, BROADCAST_ROWS = 3_000_000, 2_000_000
#: The quantile of trusted documents, what is allowed beyond it, and the words that the mean counts for.
QUANTILE, MARGIN, PRIOR, HELD_OUT = 0.99, 1.3, 30, 5
#: Times that a bigram with a weight of its own is seen at least: all have one.
LEAST = 1
#: Most bits of the filter, bits that an entry sets, and parts of the filter, told by a key's highest bits.
BLOOM_BITS, BLOOM_SET, REGIONS = 1 << 29, 3, 64
#: Words that a task gathers before it passes them on; passes over trusted text, each for its share of bigrams; bytes of text behind a task that adds up.
GATHER, PASSES, REDUCE_BYTES = 400_000, 2, 6_000_000
#: Passes over a share's bigrams for their weights; most passes over documents for their look-ups, and over these.
WEIGH, SCORE, LOOK = 2, 2, 4
#: Bytes of text worked on at once.
SLICE = 400_000


def keys(words: Words, rows: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the rows: its place among all words, the key of what stands before it (a text's start is a word too), and its own."""
    h = words.hashes()
    salt = mix(np.array([zlib.crc32(lang.encode()), len(lang)], U)).sum()
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[words.first[:-1][words.n > 0]] = U(1)
    at = np.flatnonzero(np.repeat(rows, words.n))
    with np.errstate(over="ignore"):
        return at, mix((before[at] ^ salt) + U(0x5851F42D4C957F2D)), mix((h[at] ^ salt) + U(0x14057B7EF767814F))


def joint(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Key of a bigram; joint_column() is the same in Spark."""
    return v ^ ((w << U(17)) | (w >> U(47)))


def joint_column(v: str, w: str) -> Column:
    return F.col(v).bitwiseXOR(F.shiftleft(w, 17).bitwiseOR(F.shiftrightunsigned(w, 47)))


def summed(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = joint(v, w)
    order = np.argsort(both, kind="stable")
    both, v, w, n = both[order], v[order], w[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    return v[at], w[at], np.add.reduceat(n, at)


def counted(codes: dict[str, int], part: int, passes: int):
    """mapInArrow function: lang, text -> lang (its code), v, w, n: a pass's share of bigrams, summed over what a task gathers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}

        def out(lang: str) -> pa.RecordBatch:
            v, w = (np.concatenate(x) for x in zip(*held.pop(lang), strict=True))
            v, w, n = summed(v, w, np.ones(len(v), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(v), codes[lang], np.int32)), pa.array(signed(v)), pa.array(signed(w)), pa.array(n)], ["lang", "v", "w", "n"])

        for batch in slices(batches, size=SLICE):
            words, langs = Words(batch.column("text")), np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs):
                _, v, w = keys(words, langs == lang, lang)
                mine = (v ^ w) % U(passes) == U(part)
                held.setdefault(lang, []).append((v[mine], w[mine]))
                if sum(len(x) for x, _ in held[lang]) > GATHER:
                    yield out(lang)
        for lang in list(held):
            yield out(lang)

    return run


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: lang, v, w, n of whole bigrams -> lang, v, w, c: each bigram once, in order of contexts."""
    parts = [(b.column("lang").to_numpy(), b.column("v").to_numpy().view(U), b.column("w").to_numpy().view(U), b.column("n").to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    lang, v, w, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    both = joint(v, w)
    order = np.argsort(both, kind="stable")
    both, n = both[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    c, first = np.add.reduceat(n, at), order[at]
    order = np.argsort(v[first], kind="stable")
    c, first = c[order], first[order]
    yield pa.RecordBatch.from_arrays([pa.array(lang[first]), pa.array(signed(v[first])), pa.array(signed(w[first])), pa.array(c)], ["lang", "v", "w", "c"])


def discounts(n1: Column, n2: Column, n3: Column, n4: Column) -> list[Column]:
    """D1, D2, D3+ from counts of counts; where those are missing, 1/2, 3/4, 1 of what could be taken."""
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [F.least(F.greatest(F.coalesce(d, F.lit(other)), F.lit(0.05)), F.lit(top)) for d, other, top in zip(raw, (0.5, 1.0, 1.5), (0.95, 1.95, 2.95), strict=True)]


def by_language(t: DataFrame, counts: list[Column]) -> DataFrame:
    """lang, d1, d2, d3 from t's numbers of things seen 1, 2, 3 and 4 times: a row a language."""
    n = t.groupBy("lang").agg(*(F.nullif(F.sum(c), F.lit(0)).cast("double").alias(f"n{i}") for i, c in enumerate(counts, 1)))
    return n.select("lang", *(x.alias(f"d{i}") for i, x in enumerate(discounts(*map(F.col, ("n1", "n2", "n3", "n4"))), 1)))


def fit(trusted: DataFrame, least: int = LEAST) -> tuple[DataFrame, dict[str, float]]:
    """Weights (key, f: how often it stands in trusted text, weight), and by language the log chance of a word never seen.

    trusted: lang (not null), text. The driver gets one row a language.
    """
    langs = sorted(r.lang for r in trusted.select("lang").distinct().collect())
    if not langs:
        return trusted.sparkSession.createDataFrame([], "key long, f long, weight float"), {}
    size = trusted.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(1, int(size / REDUCE_BYTES / PASSES) + 1)
    shares = []
    for part in range(PASSES):
        # A context's bigrams are dealt out by their words too, so that a frequent one is in many tasks.
        pairs = trusted.mapInArrow(counted({x: i for i, x in enumerate(langs)}, part, PASSES), "lang int, v long, w long, n long")
        shares.append(keep(pairs.repartition(tasks, "v", F.col("w").bitwiseAND(F.lit(7))).mapInArrow(added, "lang int, v long, w long, c long"), "share"))
    every = shares[0]
    for x in shares[1:]:
        every = every.union(x)
    words = keep(every.groupBy("lang", "w").agg(F.sum("c").alias("f"), F.count("*").alias("n")), "words")
    seen = [F.sum((F.col("c") == i).cast("long")).alias(f"c{i}") for i in (1, 2, 3, 4)]
    weak = [F.sum(F.when(F.col("c") < least, F.col("c")).otherwise(0)).alias("weak"), F.sum((F.col("c") < least).cast("long")).alias("n_weak")]
    contexts = keep(every.groupBy("lang", "v").agg(F.sum("c").alias("all"), F.count("*").alias("types"), *seen, *weak), "contexts")
    made = [words, contexts]
    d = by_language(words, [(F.col("n") == i).cast("long") for i in (1, 2, 3, 4)])
    taken = lambda c: F.when(F.col(c) == 1, F.col("d1")).when(F.col(c) == 2, F.col("d2")).otherwise(F.col("d3"))
    words = words.join(F.broadcast(d), "lang").select("lang", "w", "f", "n", taken("n").alias("off"))
    total = words.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("off").alias("taken"), F.count("*").alias("types"))
    total = keep(total.select("lang", "all", (F.col("taken") / F.col("all") / (F.col("types") + 1)).alias("unseen")), "totals")
    words = words.join(F.broadcast(total), "lang").select("lang", "w", "f", (F.greatest(F.col("n") - F.col("off"), F.lit(0)) / F.col("all") + F.col("unseen")).alias("p"), "unseen")
    d = keep(by_language(contexts, [F.col(f"c{i}") for i in (1, 2, 3, 4)]), "discounts")
    # What the kept bigrams of a context give up, and all of the others.
    kept = [F.col("c1") if least <= 1 else F.lit(0), F.col("c2") if least <= 2 else F.lit(0)]
    off = F.col("weak") + kept[0] * F.col("d1") + kept[1] * F.col("d2") + (F.col("types") - F.col("n_weak") - kept[0] - kept[1]) * F.col("d3")
    contexts = contexts.join(F.broadcast(d), "lang").select("lang", "v", "all", off.alias("off"))
    table = words.select(F.col("w").alias("key"), "f", F.log(F.col("p") / F.col("unseen")).cast("float").alias("weight"))
    # A context all of whose bigrams are rare keeps nothing for them: its rest is 1, whose weight of 0 needs no entry.
    table = keep(table.union(contexts.where("off <> all").select("v", "all", F.log(F.col("off") / F.col("all")).cast("float"))), "weights")
    # What a bigram keeps by what its context gives up, then by its word's chance: log(((c - D) / c(v) + rest(v) p(w)) / rest(v) / p(w)).
    high = (F.greatest(F.col("c") - taken("c"), F.lit(0)) / F.col("off")).alias("high")
    for x in shares:
        for part in range(WEIGH):
            some = x.where((F.col("c") >= least) & (F.pmod(F.shiftright("w", 8), F.lit(WEIGH)) == part))
            some = some.join(contexts.hint("shuffle_hash"), ["lang", "v"]).join(F.broadcast(d), "lang").select("lang", "w", joint_column("v", "w").alias("key"), "c", high)
            some = some.join(words.select("lang", "w", "p").hint("shuffle_hash"), ["lang", "w"])
            table = table.union(keep(some.select("key", "c", F.log1p(F.col("high") / F.col("p")).cast("float")), "weights"))
        forget(x)
    unseen = {langs[r.lang]: float(np.log(r.unseen)) for r in total.collect()}
    for x in (*made, total, d):
        forget(x)
    return table, unseen


def marked(bits: int):
    """mapInArrow function: key -> region, bits: a part of the filter, for each part that has one of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            key = batch.column("key").to_numpy().view(U)
            region = key >> U(58)
            for r in np.unique(region):
                marks, mine = own.setdefault(int(r), np.zeros(bits // REGIONS, bool)), key[region == r]
                for i in range(BLOOM_SET):
                    marks[(mine >> U(7 * i)) & U(bits // REGIONS - 1)] = True
        for r, marks in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()])], ["region", "bits"])

    return run


def n_bits(n: int, most: int) -> int:
    """12 bits a key or more, up to most."""
    return min(most, max(64 * REGIONS, 1 << (12 * n).bit_length()))


def bloom(rare: DataFrame, n: int, most: int = BLOOM_BITS) -> np.ndarray:
    """Bits set by the n keys of rare, as 64-bit words; a task makes whole parts of it."""
    bits = n_bits(n, most)
    size, out = bits // REGIONS // 8, np.zeros(bits // 8, np.uint8)
    parts = keep(rare.select("key").repartition(REGIONS, F.shiftrightunsigned("key", 58)).mapInArrow(marked(bits), "region int, bits binary"), "filter")
    found = parts.toArrow()
    for r, part in zip(found.column("region").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[r * size : (r + 1) * size] = np.frombuffer(part, np.uint8)
    forget(parts)
    return out.view(U)


def spots(key: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th bit that each key sets."""
    return (key >> U(58)) * U(bits // REGIONS) + ((key >> U(7 * i)) & U(bits // REGIONS - 1))


def filtered(known: np.ndarray) -> np.ndarray:
    """The filter of keys at hand."""
    bits = n_bits(len(known), BLOOM_BITS)
    marks = np.zeros(bits, bool)
    for i in range(BLOOM_SET):
        marks[spots(known, i, bits)] = True
    return np.packbits(marks, bitorder="little").view(U)


def perhaps(filter_: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the keys may be in the filter."""
    left = None
    for i in range(BLOOM_SET):  # only keys that pass are looked at again
        at = spots(key if left is None else key[left], i, len(filter_) * 64)
        good = (filter_[at >> U(6)] >> (at & U(63))) & U(1) == 1
        left = np.flatnonzero(good) if left is None else left[good]
    out = np.zeros(len(key), bool)
    out[left] = True
    return out


def directory(known: np.ndarray) -> tuple[np.ndarray, np.uint64]:
    """Where in the sorted keys those begin that share their highest bits, for all values of these, and how far these are shifted."""
    bits = max(1, len(known).bit_length() - 1)
    return np.concatenate([[0], np.cumsum(np.bincount((known >> U(64 - bits)).astype(np.int64), minlength=1 << bits))]).astype(np.int32), U(64 - bits)


def looked_up(known: np.ndarray, begin: np.ndarray, shift: np.uint64, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys are known, and their places there."""
    top = (key >> shift).astype(np.int64)
    at, end, left, which, place = begin[top], begin[top + 1], np.arange(len(key)), [], []
    while len(left):
        open_ = at < end
        at, end, left = at[open_], end[open_], left[open_]
        hit = known[at] == key[left]
        which.append(left[hit])
        place.append(at[hit])
        at, end, left = at[~hit] + 1, end[~hit], left[~hit]
    return (np.concatenate(which), np.concatenate(place)) if which else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def frequent(table: DataFrame, most: int) -> int:
    """The least frequency of which at most so many entries are that frequent."""
    steps = table.groupBy(F.floor(F.log2("f") * 4).alias("step")).agg(F.min("f").alias("f"), F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    bar, total = None, 0
    for r in steps:
        total += r.n
        if total > most:
            break
        bar = r.f
    return bar if bar is not None else 1 << 62


def shard(entries: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Their keys in ascending order, weights, and filter; the driver keeps nothing else of them."""
    sent = entries.select("key", "weight").toArrow()
    key = sent.column("key").to_numpy().view(U)
    order = np.argsort(key)
    return key[order], sent.column("weight").to_numpy()[order], filtered(key)


def asked(shared, unseen: dict[str, float]):
    """mapInArrow function: row, doc_id, lang, text -> row, doc_id, lang, model, n_words, logp (of what is found in place), keys of the others, as often as they stand there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight, here_, away_ = shared.value
        others, (begin, shift) = bool(away_.any()), directory(known)
        for batch in slices(batches, size=SLICE):
            words = Words(batch.column("text"))
            doc, n = np.repeat(np.arange(len(words.n)), words.n), len(words.n)
            langs = batch.column("lang").to_pylist()
            for model, low in unseen.items():
                rows = np.array([x is None or x == model for x in langs], bool)
                if not rows.any():
                    continue
                at, v, w = keys(words, rows, model)
                logp, which = np.bincount(doc[at], minlength=n) * low, np.flatnonzero(rows)
                open_keys, open_docs = [], []
                for key in (v, w, joint(v, w)):
                    near = np.flatnonzero(perhaps(here_, key))
                    own, place = looked_up(known, begin, shift, key[near])
                    near = near[own]
                    logp += np.bincount(doc[at[near]], weight[place], n) if len(near) else 0.0
                    if others:
                        far = np.ones(len(key), bool)
                        far[near] = False
                        far = np.flatnonzero(far)
                        far = far[perhaps(away_, key[far])]
                        open_keys.append(key[far])
                        open_docs.append(doc[at[far]])
                ask, of = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (open_keys, open_docs))
                order = np.argsort(of, kind="stable")
                ask, of = ask[order], of[order]
                ends = np.searchsorted(of, which, side="right").astype(np.int32)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(pa.array(which)), batch.column("doc_id").take(pa.array(which)), batch.column("lang").take(pa.array(which)), pa.array([model] * len(which), pa.string()),
                        pa.array(words.n[which].astype(np.int64)), pa.array(logp[which]), pa.ListArray.from_arrays(offsets, pa.array(signed(ask))),
                    ],
                    ["row", "doc_id", "lang", "model", "n_words", "logp", "keys"],
                )

    return run


def nats(texts: DataFrame, shared, unseen: dict[str, float], rare: DataFrame, looks: int, last: bool) -> DataFrame:
    """doc_id, lang, model, n_words, nats: each text by its language's model, or by the one that fits best; looks: passes over look-ups; last: nothing asks shared any more."""
    schema = "row long, doc_id long, lang string, model string, n_words long, logp double, keys array<long>"
    parts = keep(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "text").where(F.col("lang").isNull() | F.col("lang").isin(list(unseen))).mapInArrow(asked(shared, unseen), schema), "asked")
    # The driver's copy too, if it can: joins follow that need none.
    (shared.destroy if last else shared.unpersist)(True)
    # A row's number for each model.
    parts_ = parts.withColumn("place", F.col("row") * max(1, len(unseen)) + F.array_position(F.array(*map(F.lit, unseen)).cast("array<string>"), F.col("model")))
    wanted = parts_.select("place", F.explode("keys").alias("key"))
    sums = []
    for part in range(looks):
        own = F.pmod(F.shiftright("key", 16), F.lit(looks)) == part
        found = wanted.where(own).join(rare.where(own).hint("shuffle_hash"), "key")
        sums.append(keep(found.groupBy("place").agg(F.sum(F.col("weight").cast("double")).alias("more")), "more"))
    each = parts_.drop("keys").withColumn("more", F.lit(0.0))
    if sums:
        more = sums[0]
        for x in sums[1:]:
            more = more.union(x)
        each = each.drop("more").join(more.groupBy("place").agg(F.sum("more").alias("more")), "place", "left")
    each = each.withColumn("nats", -(F.col("logp") + F.coalesce("more", F.lit(0.0))))
    best = F.min_by(F.struct("doc_id", "lang", "model", "n_words", "nats"), F.struct("nats", "model"))
    single = each.where("lang is not null").select("doc_id", "lang", "model", "n_words", "nats")
    each = keep(single.union(each.where("lang is null and n_words > 0").groupBy("row").agg(best.alias("x")).select("x.*")), "nats")
    for x in (parts, *sums):
        forget(x)
    return each


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, prior: float = PRIOR, held_out: int = HELD_OUT, least: int = LEAST, shard_rows: int = SHARD_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, rejected, model_lang for each row of docs (doc_id, text, lang; other columns are left alone).

    Trusted are documents with quality 1 that labels (doc_id, quality, toxic) do not call toxic, of a non-null language.
    A document whose language has no trusted text has no perplexity and is kept; one of null language is judged by the model
    of the highest chance (ties: first by name), and kept if there is none. One without words has the perplexity of its
    language's mean, or none without a language, and is kept. Repeated rows are scored each by itself. Empty tables give no rows, or rows without a judgement.
    Texts are taken whole, whatever their length; a long one is a slice of its own.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("doc_id")
    good = F.broadcast(good) if labels.count() <= broadcast_rows else good
    trusted = texts.where("lang is not null").join(good, "doc_id", "left_semi")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(held_out)) == 0
    table, unseen = fit(trusted.where(~held).select("lang", "text"), least)
    bar = frequent(table, shard_rows)
    rare = table.where(F.col("f") < bar).select("key", "weight")
    n_rare = rare.count()
    shared = docs.sparkSession.sparkContext.broadcast((*shard(table.where(F.col("f") >= bar)), bloom(rare, n_rare)))
    looks = min(LOOK, -(-n_rare // shard_rows))
    scored = [texts] if looks < 2 else [texts.where(F.pmod(F.shiftright(F.xxhash64("doc_id"), 24), F.lit(SCORE)) == i) for i in range(SCORE)]
    each = None
    trim(docs.sparkSession)
    for i, some in enumerate(scored, 1):
        own = nats(some, shared, unseen, rare, looks, i == len(scored))
        each = own if each is None else each.union(own)
    wordless = F.col("lang").isNull() & (n_words(F.col("text")) == 0)
    others = texts.where(wordless | F.col("lang").isNotNull() & ~F.col("lang").isin(list(unseen))) if unseen else texts
    forget(table)
    trim(docs.sparkSession)
    ours = each.where(F.col("lang").isNotNull() & held).join(good, "doc_id", "left_semi")
    entropy = (F.col("nats") + prior * F.col("mean")) / (F.col("n_words") + prior)
    mean = (F.sum("nats") / F.greatest(F.sum("n_words"), F.lit(1))).alias("mean")
    threshold = (F.exp(F.percentile_approx(entropy, quantile, 10_000)) * margin).alias("threshold")
    bars = ours.join(F.broadcast(ours.groupBy("model").agg(mean)), "model").groupBy("model").agg(F.first("mean").alias("mean"), threshold)
    pooled = ours.crossJoin(F.broadcast(ours.agg(mean))).agg(F.first("mean").alias("mean"), threshold)  # one row
    bars = keep(bars.union(pooled.select(F.lit("").alias("model"), "mean", "threshold")), "bars").collect()
    own = {r.model: r for r in bars if r.threshold is not None}
    fixed = [(k, *((own.get(k) or own[""])[1:])) for k in unseen] if "" in own else []
    # From Arrow: rows of Python objects would go through a second set of Python workers beside those of mapInArrow.
    bars = docs.sparkSession.createDataFrame(pa.table([pa.array([x[i] for x in fixed], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))], ["model", "mean", "threshold"]))
    out = each.join(F.broadcast(bars), "model", "left").withColumn("perplexity", F.exp(entropy))
    out = out.select("doc_id", "lang", "n_words", "perplexity", "threshold", F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False)).alias("rejected"), F.col("model").alias("model_lang"))
    none = F.lit(None)
    return out.union(others.select("doc_id", "lang", n_words(F.col("text")), none.cast("double"), none.cast("double"), F.lit(False), none.cast("string")))
