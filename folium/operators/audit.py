"""Corpus audits: what a rendering lost, scores, and boards compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.text import symbols

#: Weights of a finding's severity, and the most that a finding counts.
WEIGHTS, MOST = {"high": 100, "med": 10, "low": 1}, 50


def characters(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, ch, n): counts of non-blank characters."""
    return texts.select(doc, F.explode(F.split(F.regexp_replace(text, r"\s+", ""), "")).alias("ch")).where("ch <> ''").groupBy(doc, "ch").agg(F.count("*").alias("n"))


def coverage(truth: DataFrame, seen: DataFrame, doc: str) -> DataFrame:
    """coverage: the part of each document's characters, repeats counted, that its rendering has; 1 for an empty text."""
    a, b = characters(truth, doc, "text"), characters(seen, doc, "text").withColumnRenamed("n", "m")
    both = a.join(b, [doc, "ch"], "left").groupBy(doc).agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("kept"), F.sum("n").alias("n_chars"))
    out = truth.select(doc).join(both, doc, "left")
    return out.select(doc, F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce(F.col("kept") / F.col("n_chars"), F.lit(1.0)).alias("coverage"))


def symbol_counts(texts: DataFrame, doc: str, text: str) -> DataFrame:
    return texts.select(doc, F.explode(symbols(F.col(text))).alias("symbol")).groupBy(doc, "symbol").agg(F.count("*").alias("n"))


def dropped_symbols(truth: DataFrame, seen: DataFrame, doc: str) -> DataFrame:
    """Symbols of the truth that the rendering has none of."""
    return symbol_counts(truth, doc, "text").join(symbol_counts(seen, doc, "text").select(doc, "symbol"), [doc, "symbol"], "left_anti")


def scores(findings: DataFrame) -> DataFrame:
    """score by name: weight of severity times count, at most MOST each; findings: name, severity, count."""
    weight = F.coalesce(*(F.when(F.col("severity") == k, v) for k, v in WEIGHTS.items()), F.lit(1))
    return findings.groupBy("name").agg(F.sum(weight * F.least("count", F.lit(MOST))).cast("long").alias("score"))


def board_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Boards (name, score) compared: state is gone, new, fixed, improved, regressed or same."""
    a, b = before.withColumnRenamed("score", "was"), after.withColumnRenamed("score", "now")
    state = (
        F.when(F.col("now").isNull(), "gone").when(F.col("was").isNull(), F.when(F.col("now") > 0, "new").otherwise("same"))
        .when((F.col("now") < F.col("was")) & (F.col("now") == 0), "fixed").when(F.col("now") < F.col("was"), "improved").when(F.col("now") > F.col("was"), "regressed").otherwise("same")
    )
    return a.join(b, "name", "full_outer").withColumn("state", state)


def visual_summary(pages: DataFrame, doc: str, least: float = 0.85) -> DataFrame:
    """Upper median, mean and worst page score, and pages under the pass mark."""
    sorted_ = F.array_sort(F.collect_list("ssim"))
    return pages.groupBy(doc).agg(
        F.round(F.get(sorted_, F.floor(F.count("*") / 2).cast("int")), 3).alias("median"), F.round(F.avg("ssim"), 3).alias("mean"),
        F.round(F.min("ssim"), 3).alias("worst"), F.sum((F.col("ssim") < least).cast("int")).alias("failed"),
    )


# What documents hold in truth, and what a rendering shows of it.


def text_coverage(documents: DataFrame, previews: DataFrame, doc: str) -> DataFrame:
    """coverage() of a document's text by the short preview text that its file carries."""
    return coverage(documents, previews, doc)


def page_pictures(controls: DataFrame) -> DataFrame:
    """doc, page, n: pictures of a page, each by its place (section, para, control) once; controls without a whole place do not count."""
    whole = (F.col("type") == "image") & F.col("section").isNotNull() & F.col("para").isNotNull() & F.col("control").isNotNull()
    return controls.groupBy("doc", "page").agg(F.count_distinct(F.when(whole, F.struct("section", "para", "control"))).alias("n"))


def header_blocks(blocks: DataFrame) -> DataFrame:
    """Headers and footers (doc, kind, para, control, applies, text), each place once, the first that applies; those under two characters go."""
    first = blocks.groupBy("doc", "kind", F.coalesce("para", F.lit(-1)).alias("para"), F.coalesce("control", F.lit(-1)).alias("control")).agg(F.min_by("text", "applies").alias("text"))
    return first.where(F.length(F.regexp_replace("text", r"\s+", "")) >= 2)


def truth(paragraphs: DataFrame, cells: DataFrame, controls: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc, n_chars, n_probes, n_pictures, n_headers: what a document holds.

    paragraphs: doc, text; cells: doc, table, cell, text; the others as above. A table's probe is the start of its longest cell text.
    """
    size = lambda t, name: t.groupBy("doc").agg(F.sum(F.length("text")).alias(name))
    probes = cells.groupBy("doc", "table").agg(F.max_by("text", F.struct(F.length("text"), -F.col("cell"))).alias("probe")).where(F.length("probe") >= 4).groupBy("doc").agg(F.count("*").alias("n_probes"))
    seen = page_pictures(controls).groupBy("doc").agg(F.sum("n").alias("n_pictures"))
    heads = header_blocks(blocks).groupBy("doc").agg(F.count("*").alias("n_headers"))
    out = size(paragraphs, "a").join(size(cells, "b"), "doc", "full_outer").join(probes, "doc", "left").join(seen, "doc", "left").join(heads, "doc", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc", (F.coalesce("a", zero) + F.coalesce("b", zero)).alias("n_chars"), *(F.coalesce(c, zero).alias(c) for c in ("n_probes", "n_pictures", "n_headers")))


def missing_headers(blocks: DataFrame, texts: DataFrame, doc: str) -> DataFrame:
    """Header and footer texts (doc, text) that stand nowhere in the rendered text (doc, rendered), blanks aside."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    seen = texts.select(F.col(doc).alias("_doc"), bare("rendered").alias("_seen"))
    return blocks.join(seen, (F.col(doc) == F.col("_doc")) & F.contains("_seen", bare("text")), "left_anti")


def table_count(parts: DataFrame) -> DataFrame:
    """doc_id, n: tables that the section parts of a document's zip hold, counted in their markup."""
    own = parts.where(F.rlike("part", F.lit(r"(?i)section[0-9]*\.xml$")))
    return own.groupBy("doc_id").agg(F.sum(F.regexp_count(F.col("content").cast("string"), F.lit(r"<hp:tbl\b"))).cast("long").alias("n"))


def glyph_soup(pages: DataFrame, doc: str, order: str, svg: str) -> DataFrame:
    """The text elements of a document's drawings, in order, entities read and blanks gone."""
    texts = F.regexp_extract_all(svg, F.lit(r"<text\b[^>]*>([^<]*)</text>"), F.lit(1))
    plain = F.array_join(texts, "")
    for a, b in (("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return pages.groupBy(doc).agg(F.regexp_replace(F.array_join(F.array_sort(F.collect_list(F.struct(order, plain.alias("t"))))["t"], ""), r"\s+", "").alias("soup"))


def content_overflow(html: Column) -> Column:
    """Pixels by which what is placed on a page reaches below it; 0 if its height is not told."""
    height = F.regexp_extract(html, r'class="hwp-page"[^>]*?height:([0-9.]+)px', 1).try_cast("double")
    numbers = lambda p, g: F.transform(F.regexp_extract_all(html, F.lit(p), F.lit(g)), lambda x: x.try_cast("double"))
    boxed = r'top:([0-9.]+)px;[^"]*?height:([0-9.]+)px'
    bottoms = F.concat(F.zip_with(numbers(boxed, 1), numbers(boxed, 2), lambda a, b: a + b), numbers(r"top:([0-9.]+)px", 1), F.array(F.lit(0.0)))
    return F.when(F.coalesce(height, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.array_max(bottoms) - height)


def box_of(points: Column) -> Column:
    """(x0, y0, x1, y1) around an array of structs x, y; null if it is empty."""
    side = lambda f, k: f(F.transform(points, lambda p: p[k]))
    return F.when(F.size(points) > 0, F.struct(side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1")))


# Boards and reports.


def all_names(*boards: DataFrame) -> DataFrame:
    out = boards[0].select("name")
    for b in boards[1:]:
        out = out.union(b.select("name"))
    return out.distinct()


def with_visual(rows: DataFrame, visual: DataFrame) -> DataFrame:
    """Report rows (name, ..) with what was measured of their pages, null where nothing was."""
    return rows.join(visual, "name", "left")


def reported(rows: DataFrame) -> DataFrame:
    """Rows in the order of a report: worst score first, then by name."""
    return rows.orderBy(F.desc("score"), "name")


def truth_files(files: DataFrame, known: DataFrame, root: str = "_truth") -> DataFrame:
    """files (path) with truth: themselves if PDF, else the PDF of the same place under root, else that of the same name right in it; known: path."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    mirrored, flat = F.concat(F.lit(f"{root}/"), stem, F.lit(".pdf")), F.concat(F.lit(f"{root}/"), F.regexp_extract(stem, r"([^/]*)$", 1), F.lit(".pdf"))
    base = files.select("path", mirrored.alias("_mirrored"), flat.alias("_flat"))
    a, b = known.select(F.col("path").alias("_mirrored"), F.col("path").alias("_a")), known.select(F.col("path").alias("_flat"), F.col("path").alias("_b"))
    out = base.join(a.distinct(), "_mirrored", "left").join(b.distinct(), "_flat", "left")
    return out.select("path", F.when(F.lower("path").endswith(".pdf"), F.col("path")).otherwise(F.coalesce("_a", "_b")).alias("truth"))


def corpus(files: DataFrame, contains: str = "", limit: int = 0, most_mb: float = 40.0) -> DataFrame:
    """Files (path, bytes) to audit: in order of path, those that contain a text, the first few if limited; larger ones are skipped after that."""
    own = files.where(F.contains("path", F.lit(contains))) if contains else files
    own = own.orderBy("path").limit(limit) if limit > 0 else own
    return own.where(F.round(F.col("bytes") / 1048576, 1) <= most_mb)


def by_number(parts: DataFrame, path: str = "part") -> DataFrame:
    """Parts with place: their order within a document by the number that ends their name."""
    n = F.coalesce(F.regexp_extract(path, r"([0-9]+)\.[^./]*$", 1).try_cast("long"), F.lit(0))
    return parts.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(n, path)) - 1)
