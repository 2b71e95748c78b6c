"""MinHash near-duplicates by a signature-coordinate inverted join (operator 9).

Documents are posted under each (coordinate, value) of their MinHash signature. Values that occur once cannot collide and
go first. The rest of a document's postings, rarest first, form its list; two documents with at least `least` collisions
must meet in the first len - least + 1 of it, so only that prefix is joined, and frequent postings stay out of the join
(the skip part of a merge-skip). What meets has its collisions counted, and pairs above the match threshold are confirmed
on the full shingle sets.

Groups are never expanded into pairs: each posting is first joined to its smallest document alone. Confirmed links
give components, and what then stands beside the main component of a posting (a stray) is compared with the others there
through the posting's pivot, a document of the main component. Two sets share at most the smaller of their parts
within the pivot's set, and outside it only shingles that both have. So documents of one size and one share of the pivot are
one class, and a stray meets classes: where these parts alone could suffice, their members are compared; where they cannot, the
two must share as many other shingles as are lacking, which an inverted join on these finds. Neither drops a pair
that could be similar, and a group of thousands of copies costs thousands of comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.llm.components import components
from folium.llm.shared import keep
from folium.llm.words import LOWER, Words, grams, mix, signed, slices

U = np.uint64
#: Words of a shingle; similarity as a fraction NUM / DEN.
SHINGLE, NUM, DEN = 5, 75, 100
#: Coordinates, and collisions that keep a pair: a pair at 0.75 has 36 on average, and under 23 with a chance of about 1e-5.
COORDINATES, LEAST = 48, 23
#: Parts that a class of equal sets is dealt out in.
PARTS = 64


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles (repeats included), and where each text's begin; under k words, all as one."""
    words = Words(texts, fold=LOWER)
    h, n = words.hashes(), words.n
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(at[-1], U)
    doc = np.repeat(np.arange(len(n)), counts)
    place = words.first[:-1][doc] + np.arange(at[-1]) - at[:-1][doc]
    if len(h):
        full = n[doc] >= k
        g = grams(h, k)
        out[full] = g[place[full]]
        for i in np.flatnonzero(~full):
            own = h[words.first[doc[i]] : words.first[doc[i] + 1]]
            out[i] = grams(own, len(own), 1)[0]
    return out, at


def distinct_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    out, at = shingle_sets(texts, k)
    return [np.unique(out[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def signatures(k: int = SHINGLE, m: int = COORDINATES):
    """mapInArrow function: doc_id, text -> doc_id, n_shingles, set_hi, set_lo (hashes of the set), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, 2 * m + 1, dtype=U) * U(0xD1B54A32D192ED03))
        for batch in slices(batches):
            out, at = shingle_sets(batch.column("text"), k)
            n = len(at) - 1
            sizes, hi, lo = np.zeros(n, np.int64), np.zeros(n, U), np.zeros(n, U)
            sig = np.zeros((n, m), U)
            has = np.flatnonzero(np.diff(at))
            with np.errstate(over="ignore"):
                for i in has:
                    own = np.unique(out[at[i] : at[i + 1]])
                    sizes[i], hi[i], lo[i] = len(own), mix(own).sum(), mix(own ^ U(0x5851F42D4C957F2D)).sum()
                if len(has):
                    for j in range(m):
                        sig[has, j] = np.minimum.reduceat((out ^ seeds[j]) * (seeds[m + j] | U(1)), at[:-1][has])
            values = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(signed(sig.ravel())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(signed(hi)), pa.array(signed(lo)), values], ["doc_id", "n_shingles", "set_hi", "set_lo", "signature"])

    return run


def confirm(k: int, num: int, den: int):
    """mapInArrow function: a, b, text_a, text_b -> a, b whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (y for x in slices(batches, "text_a") for y in slices(iter([x]), "text_b")):
            left, right = distinct_sets(batch.column("text_a"), k), distinct_sets(batch.column("text_b"), k)
            good = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(bool(len(x)) and den * both >= num * (len(x) + len(y) - both))
            kept = batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
            if kept.num_rows:
                yield kept

    return run


def exploded_sets(k: int):
    """mapInArrow function: doc_id, text -> doc_id, shingle for each distinct shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = distinct_sets(batch.column("text"), k)
            doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(signed(np.concatenate(sets)))], ["doc_id", "shingle"])

    return run


def stray_pairs(named: DataFrame, of: DataFrame, num: int, den: int) -> DataFrame:
    """a < b: pairs of one posting, of different components, whose sets could be similar by their parts in and outside a pivot.

    named: posting, doc_id, n_shingles, label, main; of: doc_id, shingle.
    """
    first = F.min(F.struct((F.col("label") != F.col("main")).alias("away"), F.col("doc_id").alias("pivot"), F.col("label").alias("home")))
    pivots = named.groupBy("posting").agg(first.alias("p")).select("posting", "p.pivot", "p.home")
    beside = named.join(pivots, "posting").select("pivot", "home", "doc_id", "n_shingles", "label").distinct()
    # A pivot whose documents are all of one component has no stray.
    mixed = beside.groupBy("pivot").agg(F.max(F.col("label") != F.col("home")).alias("mixed")).where("mixed").select("pivot")
    beside = keep(beside.join(mixed, "pivot", "left_semi"), "beside")
    core = beside.select("pivot").distinct().join(of.select(F.col("doc_id").alias("pivot"), "shingle"), "pivot").withColumn("core", F.lit(True))
    each = keep(beside.select("pivot", "doc_id", "label").join(of.select("doc_id", "shingle"), "doc_id").join(core, ["pivot", "shingle"], "left"), "parts")
    outside = each.where("core is null")
    counted = outside.groupBy("pivot", "shingle").agg(F.count("*").alias("f"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("pivot", "shingle", "f")
    extras = outside.join(counted, ["pivot", "shingle"]).groupBy("pivot", "doc_id").agg(F.sort_array(F.collect_list(F.struct("f", "shingle")))["shingle"].alias("extras"))
    inside = each.where("core").groupBy("pivot", "doc_id").agg(F.count("*").alias("inside"))
    facts = beside.join(inside, ["pivot", "doc_id"], "left").join(extras, ["pivot", "doc_id"], "left")
    own = F.ceil(F.col("n_shingles") * num / den)  # what a similar set shares with this one at least
    facts = facts.select(
        "pivot", "doc_id", "label", (F.col("label") == F.col("home")).alias("home"), F.col("n_shingles").alias("n"), F.coalesce("inside", F.lit(0)).alias("inside"),
        F.coalesce("extras", F.array().cast("array<bigint>")).alias("extras"), own.alias("own"),
    )
    facts = keep(facts.where(F.col("inside") + F.size("extras") >= F.col("own")), "facts")
    lacking = F.ceil((F.col("x_n") + F.col("y_n")) * num / (num + den)) - F.least("x_inside", "y_inside")
    fits = F.least("x_n", "y_n") * den >= F.greatest("x_n", "y_n") * num

    def side(df: DataFrame, mark: str, *keys: str) -> DataFrame:
        return df.select(*(F.col(c).alias(c if c in keys else f"{mark}_{c}") for c in df.columns))

    # Classes whose parts within the pivot could suffice; the members of such two are compared.
    full = facts.where(F.col("inside") >= F.col("own")).select("pivot", "home", "n", "inside", "doc_id", "label")
    kinds = full.select("pivot", "home", "n", "inside").distinct()
    met = side(kinds.where("not home"), "x", "pivot").join(side(kinds, "y", "pivot"), "pivot").where((lacking <= 0) & fits)
    some = met.join(side(full.where("not home"), "x", "pivot"), ["pivot", "x_home", "x_n", "x_inside"])
    some = some.join(side(full, "y", "pivot"), ["pivot", "y_home", "y_n", "y_inside"]).where((F.col("x_label") != F.col("y_label")) & (F.col("y_home") | (F.col("x_doc_id") < F.col("y_doc_id"))))
    # Others share as many shingles outside it as are lacking; each pair leaves at its first one, rare ones first.
    need = F.greatest(F.col("own") - F.col("inside"), F.lit(1))
    rare = facts.where(F.size("extras") >= need).withColumn("shingle", F.explode(F.slice("extras", F.lit(1), (F.size("extras") - need + 1).cast("int")))).drop("own")
    both = F.array_intersect("x_extras", "y_extras")
    enough = (lacking > 0) & (F.size(both) >= lacking) & (F.try_element_at(both, F.lit(1)) == F.col("shingle"))
    once = F.col("y_home") | (F.col("x_doc_id") < F.col("y_doc_id"))
    other = side(rare.where("not home"), "x", "pivot", "shingle").join(side(rare, "y", "pivot", "shingle"), ["pivot", "shingle"]).where((F.col("x_label") != F.col("y_label")) & fits & once & enough)
    pairs = some.select("x_doc_id", "y_doc_id").union(other.select("x_doc_id", "y_doc_id"))
    return pairs.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN, m: int = COORDINATES, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; other columns are left alone).

    Null or empty texts have no shingles and stand alone. A null doc_id takes no part: its component is null, and it is
    kept. Repeated rows of a doc_id are one document: each gets a row with the same component.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, set_hi long, set_lo long, signature array<long>"
    signed_docs = keep(texts.mapInArrow(signatures(k, m), schema), "signatures")
    key = ["n_shingles", "set_hi", "set_lo"]
    # Equal sets are one class, and its smallest document stands for it.
    # A class may hold a third of all rows, so it is dealt out in PARTS and only its parts meet.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")
    parts = signed_docs.where("n_shingles > 0").groupBy(*key, part).agg(F.min("doc_id").alias("least"))
    classes = parts.select(*key, "part", F.min("least").over(Window.partitionBy(*key)).alias("rep"))
    members = keep(signed_docs.select("doc_id", *key, part).join(classes, [*key, "part"], "left").drop("part"), "members")
    reps = members.where("doc_id = rep").select("rep").distinct()
    sigs = signed_docs.join(reps, F.col("doc_id") == F.col("rep"), "left_semi").dropDuplicates(["doc_id"])

    posted = sigs.select("doc_id", F.posexplode("signature").alias("i", "v")).select("doc_id", F.xxhash64("i", "v").alias("posting"))
    common = posted.groupBy("posting").agg(F.count("*").alias("f")).where("f > 1")
    lists = (
        posted.join(common, "posting").groupBy("doc_id").agg(F.collect_list(F.struct("f", "posting")).alias("list"))
        .where(F.size("list") >= least)
        .select("doc_id", F.sort_array("list").alias("list"))
        .select("doc_id", F.col("list.posting").alias("list"), F.slice(F.col("list.posting"), F.lit(1), F.size("list") - least + 1).alias("prefix"))
    )
    sizes = members.where("doc_id = rep").select("doc_id", "n_shingles").distinct()
    lists = keep(lists.join(sizes, "doc_id"), "lists")
    met = keep(lists.select("doc_id", "n_shingles", F.explode("prefix").alias("posting")), "postings")
    wanted = keep(texts.join(lists.select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs a < b with enough collisions and similar full sets."""
        x = lists.select(F.col("doc_id").alias("a"), F.col("list").alias("list_a"))
        y = lists.select(F.col("doc_id").alias("b"), F.col("list").alias("list_b"))
        above = pairs.join(x, "a").join(y, "b").where(F.size(F.array_intersect("list_a", "list_b")) >= least).select("a", "b")
        t = wanted.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
        u = wanted.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        return keep(above.join(t, "a").join(u, "b").mapInArrow(confirm(k, num, den), "a long, b long"), name)

    def fits(x: str, y: str) -> F.Column:
        """Sets of such sizes can be similar enough."""
        return F.least(x, y) * den >= F.greatest(x, y) * num

    hubs = met.groupBy("posting").agg(F.min(F.struct(F.col("doc_id").alias("hub"), F.col("n_shingles").alias("hub_n"))).alias("h")).select("posting", "h.*")
    stars = met.join(hubs, "posting").where((F.col("hub") < F.col("doc_id")) & fits("n_shingles", "hub_n"))
    links = confirmed(stars.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "stars")
    # A posting may hold documents beside its main component: those are compared with the others that could be similar.
    found = components(links).select(F.col("node").alias("doc_id"), "label")
    named = keep(met.join(found, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "named")
    counts = named.groupBy("posting", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("posting").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("labels")).where("labels > 1")
    named = named.join(main.drop("labels"), "posting")
    # A set shares no more outside its component than its shingles that occur there, which rules most strays out unpaired.
    each = wanted.join(named.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(exploded_sets(k), "doc_id long, shingle long")
    of = keep(each.join(named.select("doc_id", "label").distinct(), "doc_id"), "shingles")
    seen = of.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("shingle")
    shared = of.join(seen, "shingle").groupBy("doc_id").agg(F.count("*").alias("shared"))
    named = keep(named.join(shared, "doc_id").where(F.col("shared") * den >= F.col("n_shingles") * num), "strays")
    pairs = stray_pairs(named, of, num, den)
    links = links.union(confirmed(pairs, "links"))
    labels = components(links).select(F.col("node").alias("rep"), "label")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("label", "rep", "doc_id"))
    return members.join(labels, "rep", "left").select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
