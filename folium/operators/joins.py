"""Keyed lookups of document engines, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_fallback(items: DataFrame, dim: DataFrame, key: str, value: str, fallback: str) -> DataFrame:
    """Left join on key; rows without a partner get the fallback."""
    return items.join(dim.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(fallback)))


def changed_only(edits: DataFrame, originals: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Edits whose text differs from the original cell's (a missing cell counts as empty)."""
    was = originals.select(*keys, F.col(text).alias("_was"))
    return edits.join(was, keys, "left").where(~F.col(text).eqNullSafe(F.coalesce("_was", F.lit("")))).drop("_was")


def patched(originals: DataFrame, edits: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Originals with edited text where there is an edit; edits of unknown keys are ignored."""
    new = edits.select(*keys, F.col(text).alias("_new"))
    return originals.join(new, keys, "left").withColumn(text, F.coalesce("_new", text)).drop("_new")


def uncovered(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """Cells but those that a merge (r1, c1, r2, c2) covers beside its anchor; cells have row, col."""
    rows = merges.select(*keys, "r1", "c1", "c2", F.explode(F.sequence("r1", "r2")).alias("row"))
    under = rows.select(*keys, "r1", "c1", "row", F.explode(F.sequence("c1", "c2")).alias("col")).where((F.col("row") != F.col("r1")) | (F.col("col") != F.col("c1")))
    return cells.join(under.select(*keys, "row", "col").distinct(), [*keys, "row", "col"], "left_anti")


def interval_of(points: DataFrame, starts: DataFrame, keys: list[str], at: str, start: str, value: str) -> DataFrame:
    """Each point with the value of the interval it lies in; an interval ends where the next of its keys begins."""
    points = points.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_point"), F.lit(None).cast(starts.schema[value].dataType).alias(value), F.struct(*[c for c in points.columns if c not in keys]).alias("_row"))
    marks = starts.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_point"), F.col(value))
    w = Window.partitionBy(*keys).orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, 0)
    return points.unionByName(marks, allowMissingColumns=True).withColumn(value, F.last(value, ignorenulls=True).over(w)).where("_point = 1").select(*keys, "_row.*", value)


def shifted(positions: DataFrame, patches: DataFrame, keys: list[str], at: str, start: str, delta: str) -> DataFrame:
    """shift: sum of the deltas of patches that start before a position: a prefix sum over both, not a theta join."""
    p = positions.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_patch"), F.lit(0).cast("long").alias("_delta"), F.struct(*[c for c in positions.columns if c not in keys]).alias("_row"))
    q = patches.select(*keys, F.col(start).alias("_at"), F.lit(1).alias("_patch"), F.col(delta).cast("long").alias("_delta"))
    w = Window.partitionBy(*keys).orderBy("_at", "_patch").rowsBetween(Window.unboundedPreceding, -1)
    both = p.unionByName(q, allowMissingColumns=True).withColumn("shift", F.coalesce(F.sum("_delta").over(w), F.lit(0)))
    return both.where("_patch = 0").select(*keys, "_row.*", "shift")


def table_forms(cells: DataFrame, keys: list[str]) -> DataFrame:
    """header_form of each table: two rows or more, the first all filled, some later cell blank; cells have row, col, text."""
    blank = F.btrim("text") == ""
    return cells.groupBy(*keys).agg((F.max("row") >= 1).alias("_rows"), F.min(F.when(F.col("row") == 0, ~blank)).alias("_top"), F.max(F.when(F.col("row") > 0, blank)).alias("_gap")).select(
        *keys, F.coalesce(F.col("_rows") & F.col("_top") & F.col("_gap"), F.lit(False)).alias("header_form"))


def labelled(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with label and is_label: by the first row in header form, else odd columns by the cell before them."""
    cells = cells.join(table_forms(cells, keys), keys)
    top = cells.where("row = 0").select(*keys, "col", F.btrim("text").alias("_top")).groupBy(*keys, "col").agg(F.max("_top").alias("_top"))
    before = F.lag(F.btrim("text")).over(Window.partitionBy(*keys, "row").orderBy("col"))
    out = cells.withColumn("_before", F.coalesce(before, F.lit(""))).join(top, [*keys, "col"], "left")
    is_label = F.when(F.col("header_form"), F.col("row") == 0).otherwise(F.col("col") % 2 == 0)
    label = F.when(is_label, F.btrim("text")).otherwise(F.when(F.col("header_form"), F.coalesce("_top", F.lit(""))).otherwise(F.col("_before")))
    return out.select(*keys, "row", "col", "text", label.alias("label"), is_label.alias("is_label"))


def extended_rows(template: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of values (row, col, text) laid over a template row (col, style): missing cells are empty, the style is kept."""
    rows = values.groupBy(*keys).agg(F.max("row").alias("_last"))
    every = template.join(rows, keys).select(*keys, F.explode(F.sequence(F.lit(0), "_last")).alias("row"), "col", "style")
    return every.join(values, [*keys, "row", "col"], "left").select(*keys, "row", "col", "style", F.coalesce("text", F.lit("")).alias("text"))


def inherited(spark: SparkSession, styles: DataFrame, fields: list[str], depth: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """style_id with each field from the nearest style up the based_on chain that sets it.

    Chains of any length are followed, as far as a sheet has styles (or `depth`), so one that comes back on itself ends. keys name a
    sheet: its styles are held together as one map, which each of them walks.
    """
    one = F.struct("based_on", *fields)
    sheets = styles.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("style_id", one))).alias("_sheet"))
    each = styles.join(F.broadcast(sheets) if not keys else sheets, list(keys)) if keys else styles.crossJoin(F.broadcast(sheets))

    def step(s: Column, _: Column) -> Column:
        up = F.get(F.transform(F.array(F.try_element_at("_sheet", s["based_on"])), lambda x: x), F.lit(0))
        return F.struct(up["based_on"].alias("based_on"), *(F.coalesce(s[f], up[f]).alias(f) for f in fields))

    steps = F.sequence(F.lit(1), F.lit(depth) if depth is not None else F.size("_sheet"))
    found = F.aggregate(steps, one, step)
    return each.select(*keys, "style_id", found.alias("_x")).select(*keys, "style_id", *(F.col("_x")[f].alias(f) for f in fields))


def relation_targets(parts: DataFrame, rels: DataFrame, doc: str) -> DataFrame:
    """Parts that relationships lead to: rels (doc, source, rel_id, target) joined to parts (doc, path, content)."""
    return rels.join(parts.withColumnRenamed("path", "target"), [doc, "target"])


def probe_missing(probes: DataFrame, texts: DataFrame, doc: str) -> DataFrame:
    """Probes whose text does not stand in their document's rendered text."""
    return probes.join(texts.select(F.col(doc).alias("_doc"), "rendered"), (F.col(doc) == F.col("_doc")) & F.contains("rendered", "probe"), "left_anti")


def dense_grid(rows: DataFrame, cols: DataFrame, cells: DataFrame, keys: list[str], fill: Column) -> DataFrame:
    """Every (row, col) of each table's used range, with the cell's text or fill; rows and cols give the range (n_rows, n_cols)."""
    grid = rows.join(cols, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"), "n_cols").select(*keys, "row", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))
    return grid.join(cells, [*keys, "row", "col"], "left").withColumn("text", F.coalesce("text", fill))
