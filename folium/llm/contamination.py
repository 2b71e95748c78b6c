"""Benchmark decontamination by template canonicalisation, in DataFrame functions only (operator 8).

Numbers, units and names become typed placeholders, case and trailing punctuation go. Templates of WINDOW words are
hash-joined: every window of a benchmark item with every window of a document; a shorter item is one window as long as itself.
What a document shares with an item on one alignment counts as a leak if it covers enough of the item and the slots are
consistent: equal values of the item's slots stand for equal values in the document, so a question with other numbers is
found, and a chance mix of slots is not. A short item of nothing but slots is found by its values only. An item's first word
may read as a name within a document, so its first window has that reading too, with the word itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window.
WINDOW = 6
#: Item words that a leak covers: so many, or this fraction of a shorter item.
COVER, FRACTION = 10, 0.6
#: Windows of benchmark items that are broadcast at most; beyond, both sides are shuffled.
BROADCAST_WINDOWS = 300_000
#: Units that may follow a number.
UNITS = "mm cm m km in ft yd mi miles mile mg g kg lb lbs oz ml l gal s sec seconds min minutes h hr hours days day weeks months years mph kmh w kw v a hz khz mhz ghz kb mb gb tb usd eur dollars cents euros meters metres grams liters litres percent degrees"
_SPACES = r"[\x20\x09-\x0D]+"


def canonical(text: Column) -> Column:
    """The text's words with placeholders; as many words as the text has."""
    t = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N},;:] )\p{Lu}[\p{L}'-]*", "<name>")
    t = F.regexp_replace(t, r"[+-]?[0-9]+(?:[.,:/][0-9]+)*%?", "<num>")
    t = F.regexp_replace(t, rf"<num>(\x20?)(?i:{'|'.join(sorted(UNITS.split(), key=len, reverse=True))})(?![\p{{L}}\p{{N}}])", "<num>$1<unit>")
    t = F.regexp_replace(t, r"(?<=[^\x20\x09-\x0D])[.,;:!?)\"'\]]+(?=[\x20\x09-\x0D]|$)", "")
    return split(F.lower(t))


def split(text: Column) -> Column:
    """Words of the text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACES), lambda x: x != "")


def windows(table: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """key, at, size, template (hash), slots: an array of the values of placeholders, null if the text has none."""
    words = table.select(key, split(F.col("text")).alias("raw"), canonical(F.col("text")).alias("words"))
    held = words.select(
        key, F.size("words").alias("n"), F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"),
        F.when(F.exists("words", lambda x: x.contains("<")), F.transform("words", lambda x, i: F.when(x.contains("<"), F.get("raw", i)))).alias("marks"),
    )
    at = lambda c, p, size: [F.get(c, p + i) for i in range(size)]
    one = lambda p, size: F.struct(
        p.alias("at"), F.lit(size).alias("size"), F.when(p + size <= F.col("n"), F.xxhash64(*at("hashes", p, size))).alias("template"),
        F.when(F.col("marks").isNotNull(), F.filter(F.array(*at("marks", p, size)), lambda x: x.isNotNull())).alias("slots"),
    )
    places = F.when(F.col("n") >= min(sizes), F.sequence(F.lit(0), F.col("n") - min(sizes))).otherwise(F.array().cast("array<int>"))
    all_at = lambda p: one(p, sizes[0]) if len(sizes) == 1 else F.array(*(one(p, k) for k in sizes))
    every = F.transform(places, all_at)
    return held.select(key, F.explode(every if len(sizes) == 1 else F.flatten(every)).alias("x")).select(key, "x.*").where("template is not null")


def bare(text: Column) -> Column:
    """Whether the text's template has no letter or digit beside its placeholders."""
    return ~F.exists(canonical(text), lambda x: F.rlike(F.regexp_replace(x, "<(?:num|unit|name)>", ""), F.lit(r"[\p{L}\p{N}]")))


def value(slot: Column) -> Column:
    """What a slot says, whatever its case and the marks after it."""
    return F.lower(F.regexp_replace(slot, r"(?<=.)[.,;:!?)\"'\]]+$", ""))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: int = COVER, fraction: float = FRACTION, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, covered, n_item, reparameterised) of each document and item that it leaks.

    docs: doc_id, text; benchmark: item_id, text. Null and empty texts share nothing. Repeated rows of a doc_id count as one
    document.
    """
    items = benchmark.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = items.withColumn("n", F.size(split(F.col("text")))).where("n > 0")
    short = sorted(r.n for r in items.where(F.col("n") < window).select("n").distinct().collect())
    inside = F.concat(F.lit("x "), F.regexp_replace("text", f"^{_SPACES}", ""))
    of = []
    for size in [*short, window]:
        own = items.where(F.col("n") == size if size < window else F.col("n") >= window)
        of.append(windows(own, "item_id", [size]).withColumn("by_first", F.lit(False)))
        of.append(windows(own.withColumn("text", inside), "item_id", [size]).where("at = 1").withColumn("at", F.lit(0)).withColumn("by_first", F.lit(True)))
    wanted = of[0]
    for x in of[1:]:
        wanted = wanted.union(x)
    # A first word that is no name reads the same both ways: one of the two windows is left.
    wanted = wanted.groupBy("item_id", "size", F.col("at").alias("item_at"), "template", F.col("slots").alias("item_slots")).agg(F.min("by_first").alias("by_first"))
    sizes = items.groupBy("item_id").agg(F.max("n").alias("n_item"), F.max((F.col("n") < window) & bare(F.col("text"))).alias("by_value"))
    if wanted.count() <= broadcast_windows:
        wanted, sizes = F.broadcast(wanted), F.broadcast(sizes)
    found = windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", [*short, window])
    met = found.join(wanted, ["template", "size"]).where(~F.col("by_first") | (value(F.get("slots", F.lit(0))) == value(F.get("item_slots", F.lit(0))))).select(
        "doc_id", "item_id", "size", (F.col("at") - F.col("item_at")).alias("shift"), "item_at",
        F.arrays_zip(F.coalesce("item_slots", F.array().cast("array<string>")).alias("item"), F.coalesce("slots", F.array().cast("array<string>")).alias("doc")).alias("slots"),
    )
    # One alignment of a document and an item: no more places than the item has.
    each = met.groupBy("doc_id", "item_id", "size", "shift").agg(F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    each = each.select(
        "doc_id", "item_id", "size", F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1))))).alias("covered"),
        (F.size("slots") == F.size(F.array_distinct(F.col("slots.item")))).alias("consistent"),
        F.exists("slots", lambda s: s["item"] != s["doc"]).alias("other"), F.exists("slots", lambda s: value(s["item"]) != value(s["doc"])).alias("other_value"),
    )
    each = each.where("consistent").join(sizes, "item_id").where(((F.col("covered") >= cover) | (F.col("covered") >= fraction * F.col("n_item"))) & ~(F.col("by_value") & (F.col("size") < window) & F.col("other_value")))
    return each.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), F.max("n_item").alias("n_item"), F.min("other").alias("reparameterised"))


def contamination(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """doc_id, n_items, item_ids (ascending), covered (most words of one item), reparameterised, contaminated for each row of docs."""
    by_doc = leaks(docs, benchmark, **settings).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("covered").alias("covered"), F.min("reparameterised").alias("reparameterised"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(by_doc, "doc_id", "left")
    none = F.array().cast(by_doc.schema["item_ids"].dataType)
    return out.select("doc_id", F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("covered", F.lit(0)).cast("long").alias("covered"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"), F.col("item_ids").isNotNull().alias("contaminated"))
