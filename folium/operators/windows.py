"""Order-dependent operators, as windows within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(items: DataFrame, doc: str, order: str, same: list[str], least: int = 1) -> DataFrame:
    """Maximal runs of consecutive items with equal `same` columns: doc, group (g0, g1, ..), first, last, n and these columns.

    Runs under `least` items are left out before groups are numbered.
    """
    w = Window.partitionBy(doc).orderBy(order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = items.withColumn("_new", (F.row_number().over(w) == 1) | changed)
    runs = marked.withColumn("_run", F.sum(F.col("_new").cast("int")).over(w))
    out = runs.groupBy(doc, "_run", *same).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least)
    at = F.row_number().over(Window.partitionBy(doc).orderBy("first")) - 1
    return out.select(doc, F.concat(F.lit("g"), at.cast("string")).alias("group"), "first", "last", "n", *same)


def asof(log: DataFrame, doc: str, order: list[str], marker: Column, value: Column, name: str) -> DataFrame:
    """Each row with the value of the last row, at or before it, where marker holds."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn(name, F.last(F.when(marker, value), ignorenulls=True).over(w))


def running_start(items: DataFrame, keys: list[str], order: str, span: str, name: str) -> DataFrame:
    """name: sum of the spans before an item, such as the grid column of a table cell."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn(name, F.coalesce(F.sum(span).over(w), F.lit(0)).cast("long"))


def vertical_spans(cells: DataFrame, table: str, row: str, col: str, continues: Column) -> DataFrame:
    """Cells that start a vertical merge, with rowspan: one plus the cells that continue them in their column."""
    w = Window.partitionBy(table, col).orderBy(row)
    runs = cells.withColumn("_run", F.sum(F.when(continues, 0).otherwise(1)).over(w))
    return runs.groupBy(table, col, "_run").agg(F.min(row).alias(row), F.count("*").alias("rowspan")).drop("_run")


def list_numbers(items: DataFrame, keys: list[str], order: str, level: str) -> DataFrame:
    """Numbers of two-level lists: level 0 counts on, level 1 starts again after each level 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = items.withColumn("major", F.sum(F.when(F.col(level) == 0, 1).otherwise(0)).over(w))
    inner = Window.partitionBy(*keys, "major").orderBy(order)
    out = out.withColumn("minor", F.sum(F.when(F.col(level) > 0, 1).otherwise(0)).over(inner))
    return out.withColumn("label", F.when(F.col(level) == 0, F.concat(F.col("major").cast("string"), F.lit("."))).otherwise(F.concat_ws(".", F.col("major").cast("string"), F.col("minor").cast("string"))))


def page_breaks(items: DataFrame, doc: str, order: str, page: str) -> DataFrame:
    """breaks: whether an item's page is past all pages before it."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("breaks", F.coalesce(F.col(page) > F.max(page).over(w), F.lit(False)))


def tokens(items: DataFrame, doc: str, order: str, prefix: str, name: str) -> DataFrame:
    """Tokens prefix-0, prefix-1, .. in document order."""
    at = F.row_number().over(Window.partitionBy(doc).orderBy(order)) - 1
    return items.withColumn(name, F.concat(F.lit(f"{prefix}-"), at.cast("string")))
