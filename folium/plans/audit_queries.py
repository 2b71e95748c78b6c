"""Queries over audits, boards, windows and bits, and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import grid as G
from folium.operators import audit
from folium.plans.grid_queries import _FINDINGS, _SCORE, _findings
from folium.sources import korean, pdf, slides
from folium.sources.sheets import shaded, theme_colours
from folium.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Events stand for controls of pages, headers, pages.

_CONTROLS = "c AS (SELECT user_id AS doc, event_id % 3 AS page, CASE WHEN event_type = 'click' THEN 'image' ELSE event_type END AS type, event_id % 2 AS section, CASE WHEN event_id % 11 <> 0 THEN event_id % 5 END AS para, (event_id // 7) % 4 AS control, event_id, event_type || ' ' || (event_id % 13) AS text FROM events)"


def _controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc"), (e % 3).alias("page"), F.when(F.col("event_type") == "click", "image").otherwise(F.col("event_type")).alias("type"), (e % 2).alias("section"),
        F.when(e % 11 != 0, e % 5).alias("para"), (F.floor(e / 7) % 4).alias("control"), "event_id", F.concat("event_type", F.lit(" "), (e % 13).cast("string")).alias("text"),
    )


@query(f"WITH {_CONTROLS} SELECT doc, page, count(DISTINCT CASE WHEN type = 'image' AND para IS NOT NULL THEN section || ',' || para || ',' || control END)::BIGINT AS n FROM c GROUP BY doc, page")
def page_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.page_pictures(_controls(spark, sf_dir))


_HEADERS = f"{_CONTROLS}, h AS (SELECT doc, type AS kind, coalesce(para, -1) AS para, control, arg_min(text, event_id) AS text FROM c GROUP BY ALL)"


@query(f"WITH {_HEADERS} SELECT doc, kind, para::BIGINT AS para, control::BIGINT AS control, text FROM h WHERE len(replace(text, ' ', '')) >= 2")
def header_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _controls(spark, sf_dir).select("doc", F.col("type").alias("kind"), "para", "control", F.col("event_id").alias("applies"), "text")
    return audit.header_blocks(blocks).select("doc", "kind", F.col("para").cast("long").alias("para"), F.col("control").cast("long").alias("control"), "text")


@query(f"""
    WITH {_CONTROLS}, h AS (SELECT DISTINCT doc, text FROM c WHERE event_id % 4 = 0), s AS (SELECT doc, string_agg(replace(text, ' ', '') || '.', '' ORDER BY event_id) AS seen FROM c WHERE event_id % 3 = 0 GROUP BY doc)
    SELECT doc, text FROM h WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc = h.doc AND contains(seen, replace(h.text, ' ', '')))""")
def missing_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _controls(spark, sf_dir)
    seen = c.where("event_id % 3 = 0").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "text")))["text"], lambda x: F.concat(x, F.lit("."))), " ").alias("rendered"))
    return audit.missing_headers(c.where("event_id % 4 = 0").select("doc", "text").distinct(), seen, "doc")


@query(f"""
    WITH {_CONTROLS}, p AS (SELECT doc, sum(len(text)) AS n FROM c WHERE type <> 'image' GROUP BY doc), t AS (SELECT doc, sum(len(text)) AS n FROM c WHERE type = 'image' GROUP BY doc),
    q AS (SELECT doc, count(*) AS n FROM (SELECT doc, control, max(len(text)) AS m FROM c WHERE type = 'image' GROUP BY doc, control) WHERE m >= 4 GROUP BY doc),
    i AS (SELECT doc, sum(n) AS n FROM (SELECT doc, page, count(DISTINCT CASE WHEN type = 'image' AND para IS NOT NULL THEN section || ',' || para || ',' || control END) AS n FROM c GROUP BY doc, page) GROUP BY doc),
    h AS (SELECT doc, count(*) AS n FROM (SELECT DISTINCT doc, type, coalesce(para, -1), control FROM c) GROUP BY doc), d AS (SELECT DISTINCT doc FROM c)
    SELECT d.doc, (coalesce(p.n, 0) + coalesce(t.n, 0))::BIGINT AS n_chars, coalesce(q.n, 0)::BIGINT AS n_probes, coalesce(i.n, 0)::BIGINT AS n_pictures, coalesce(h.n, 0)::BIGINT AS n_headers
    FROM d LEFT JOIN p USING (doc) LEFT JOIN t USING (doc) LEFT JOIN q USING (doc) LEFT JOIN i USING (doc) LEFT JOIN h USING (doc)""")
def document_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _controls(spark, sf_dir)
    cells = c.where("type = 'image'").select("doc", F.col("control").alias("table"), F.col("event_id").alias("cell"), "text")
    blocks = c.select("doc", F.col("type").alias("kind"), "para", "control", F.col("event_id").alias("applies"), "text")
    return audit.truth(c.where("type <> 'image'"), cells, c, blocks)


@query("SELECT page_id, page_id % 5 + 1 AS n_sections, (page_id % 5 + 1) * (page_id % 3) AS n FROM pages")
def zip_table_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables counted over the section parts of each document."""
    k = F.col("page_id")
    sections = table(spark, sf_dir, "pages").select(k.cast("string").alias("doc_id"), F.explode(F.sequence(F.lit(0).cast("long"), k % 5)).alias("s"), (k % 3).cast("int").alias("n"))
    parts = sections.select("doc_id", F.concat(F.lit("Contents/section"), F.col("s").cast("string"), F.lit(".xml")).alias("part"), F.encode(F.repeat(F.lit("<hp:tbl a='1'></hp:tbl><hp:tblx/>"), F.col("n")), "UTF-8").alias("content"))
    counts = audit.table_count(parts).join(sections.groupBy("doc_id").agg(F.count("*").alias("n_sections")), "doc_id")
    return counts.select(F.col("doc_id").cast("long").alias("page_id"), "n_sections", "n")


@query("SELECT conv_id, string_agg(replace(role || turn || '<a&b', ' ', ''), '' ORDER BY turn) AS soup FROM conversations GROUP BY conv_id")
def glyph_soup(spark: SparkSession, sf_dir: str) -> DataFrame:
    svg = F.concat(F.lit('<svg><text x="1">'), "role", F.lit("</text><g/><text>"), F.col("turn").cast("string"), F.lit(" &lt;a</text><text>&amp;b</text></svg>"))
    return audit.glyph_soup(table(spark, sf_dir, "conversations").select("conv_id", "turn", svg.alias("svg")), "conv_id", "turn", "svg")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE greatest(o_orderkey % 700 + o_custkey % 300, o_custkey % 1500) - 800 END::DOUBLE AS overflow FROM orders")
def content_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    html = F.concat(
        F.when(o % 9 == 0, "<div>").otherwise('<div class="hwp-page" style="width:600px;height:800px">'), F.lit('<p style="top:'), (o % 700).cast("string"), F.lit("px;left:0;height:"), (c % 300).cast("string"),
        F.lit('px"></p><i style="top:'), (c % 1500).cast("string"), F.lit('px"></i></div>'),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", audit.content_overflow(html).alias("overflow"))


@query("SELECT l_orderkey, min(l_quantity) AS x0, min(l_extendedprice) AS y0, max(l_quantity) AS x1, max(l_extendedprice) AS y1 FROM lineitem GROUP BY l_orderkey")
def point_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))).alias("p"))
    return points.select("l_orderkey", audit.box_of(F.col("p")).alias("b")).select("l_orderkey", "b.*")


# Boards.


@query(f"""
    WITH {_FINDINGS}, a AS (SELECT name, {_SCORE} AS was FROM f WHERE event_id % 2 = 0 GROUP BY name), b AS (SELECT name, {_SCORE} AS now FROM f WHERE event_id % 2 = 1 GROUP BY name)
    SELECT name, was, now, CASE WHEN now IS NULL THEN 'gone' WHEN was IS NULL THEN CASE WHEN now > 0 THEN 'new' ELSE 'same' END WHEN now < was AND now = 0 THEN 'fixed' WHEN now < was THEN 'improved' WHEN now > was THEN 'regressed' ELSE 'same' END AS state
    FROM a FULL JOIN b USING (name)""")
def board_diff_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of all findings: those of even events against those of odd ones."""
    f = _findings(spark, sf_dir)
    return audit.board_diff(audit.scores(f.where("event_id % 2 = 0")), audit.scores(f.where("event_id % 2 = 1")))


@query(f"WITH {_FINDINGS} SELECT DISTINCT name FROM f")
def board_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    return audit.all_names(audit.scores(f.where("severity = 'high'")), audit.scores(f.where("severity <> 'high'")))


@query(f"""
    WITH {_FINDINGS}, s AS (SELECT name, {_SCORE} AS score FROM f GROUP BY name), v AS (SELECT user_id AS name, round(avg(value), 3) AS mean FROM events WHERE event_type = 'view' GROUP BY user_id)
    SELECT name, score, mean, row_number() OVER (ORDER BY score DESC, name) AS place FROM s LEFT JOIN v USING (name)""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows with what was measured, worst first."""
    visual = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.col("user_id").alias("name")).agg(F.round(F.avg("value"), 3).alias("mean"))
    rows = audit.reported(audit.with_visual(audit.scores(_findings(spark, sf_dir)), visual))
    return rows.select("name", "score", "mean", (F.row_number().over(audit.Window.orderBy(F.desc("score"), "name"))).alias("place"))


@query("""
    WITH f AS (SELECT 'd' || (p_partkey % 7) || '/' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' ELSE '.hwp' END AS path, p_partkey AS k FROM part)
    SELECT path, CASE WHEN k % 3 = 0 THEN path WHEN k % 4 = 1 THEN '_truth/d' || (k % 7) || '/' || k || '.pdf' WHEN k % 4 = 2 THEN '_truth/' || k || '.pdf' END AS truth FROM f""")
def truth_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's true PDF: itself, the one of the same place, or the one of the same name."""
    k = F.col("p_partkey")
    n, under = k.cast("string"), F.concat(F.lit("d"), (k % 7).cast("string"), F.lit("/"))
    parts = table(spark, sf_dir, "part")
    files = parts.select(F.concat(under, n, F.when(k % 3 == 0, ".pdf").when(k % 3 == 1, ".docx").otherwise(".hwp")).alias("path"))
    known = parts.where("p_partkey % 4 = 1").select(F.concat(F.lit("_truth/"), under, n, F.lit(".pdf")).alias("path"))
    known = known.union(parts.where("p_partkey % 4 in (1, 2)").select(F.concat(F.lit("_truth/"), n, F.lit(".pdf"))))
    return audit.truth_files(files, known)


@query("SELECT 'f' || p_partkey AS path, p_size * 1000000 AS bytes FROM part WHERE contains('f' || p_partkey, '1') AND round(p_size * 1000000 / 1048576, 1) <= 40")
def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") * 1000000).alias("bytes"))
    return audit.corpus(files, "1")


@query("SELECT l_orderkey::VARCHAR AS doc_id, 'xl/worksheets/sheet' || l_partkey || '.xml' AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS place FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def parts_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.concat(F.lit("xl/worksheets/sheet"), F.col("l_partkey").cast("string"), F.lit(".xml")).alias("part")).distinct()
    return audit.by_number(own)


# Slides, records, numbers.


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber - 2 >= 0 THEN (l_linenumber - 2) % 2 END AS band FROM lineitem")
def banded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") - 1).alias("row"))
    return slides.banded(cells, F.lit(True)).drop("row")


@query("""
    WITH p AS (SELECT conv_id, turn, role = 'user' AS auto, turn % 2 AS level FROM conversations)
    SELECT conv_id, turn, CASE WHEN auto THEN sum(auto::INT) OVER (PARTITION BY conv_id, level ORDER BY turn ROWS UNBOUNDED PRECEDING) END::BIGINT AS number FROM p""")
def auto_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.lit(0).alias("slide_no"), F.lit("0").alias("shape"), F.col("turn").alias("para"), (F.col("turn") % 2).alias("level"), (F.col("role") == "user").alias("auto"))
    return slides.numbered(own).select(F.col("doc_id").alias("conv_id"), F.col("para").alias("turn"), "number")


@query("""
    WITH r AS (SELECT conv_id, turn AS n, turn * 7 % 4 AS level FROM conversations)
    SELECT conv_id::VARCHAR AS doc_id, n, level, (SELECT max(b.n) FROM r b WHERE b.conv_id = r.conv_id AND b.n < r.n AND b.level < r.level) AS parent FROM r""")
def record_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a forest by their levels."""
    own = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("turn").alias("n"), (F.col("turn") * 7 % 4).alias("level"))
    return korean.record_parents(own)


@query("""
    WITH RECURSIVE c AS (SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n, l_linenumber % 3 + 1 AS span FROM lineitem),
    r AS (SELECT d, n, span, 0 AS row, span AS sum FROM c WHERE n = 1 UNION ALL SELECT c.d, c.n, c.span, CASE WHEN r.sum >= 4 THEN r.row + 1 ELSE r.row END, CASE WHEN r.sum >= 4 THEN c.span ELSE r.sum + c.span END FROM r JOIN c ON c.d = r.d AND c.n = r.n + 1)
    SELECT d::VARCHAR AS doc_id, n, span::INT AS span, row FROM r""")
def rows_by_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells dealt out in rows of width four; a sum that starts again."""
    at = F.row_number().over(audit.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).cast("long")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), at.alias("n"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("span"), F.lit(4).alias("w"))
    return korean.rows_by_width(cells, "w").drop("w")


@query("""
    SELECT o_orderkey, list_filter([CASE WHEN p & 1 <> 0 THEN 'italic' END, CASE WHEN p & 2 <> 0 THEN 'bold' END, CASE WHEN (p >> 2) & 3 <> 0 THEN 'underline' END, CASE WHEN (p >> 18) & 7 <> 0 THEN 'strike' END], lambda x: x IS NOT NULL) AS marks
    FROM (SELECT o_orderkey, (o_orderkey * 65551 % 2097152)::INT AS p FROM orders)""")
def shape_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    prop = (F.col("o_orderkey") * 65551 % 2097152).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", korean.shape_marks_column(prop).alias("marks"))


@query("""
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN v WHEN 1 THEN v / 100 WHEN 2 THEN v * 256 WHEN 3 THEN v * 256 / 100 END AS value FROM (SELECT o_orderkey, (o_orderkey % 1000 - 500)::DOUBLE AS v FROM orders)""")
def rk_numbers_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed numbers of all four forms: integers and the upper half of doubles, each plain and in hundredths."""
    import struct

    from pyspark.sql.types import LongType

    @F.pandas_udf(LongType())
    def upper(v):
        return v.map(lambda x: struct.unpack("<Q", struct.pack("<d", x))[0] >> 32 & 0xFFFFFFFC)

    k, v = F.col("o_orderkey") % 4, (F.col("o_orderkey") % 1000 - 500).cast("double")
    whole = F.pmod(v.cast("long") * 4, F.lit(2**32)) + 2
    rk = F.when(k == 0, whole).when(k == 1, whole + 1).when(k == 2, upper(v * 256)).otherwise(upper(v * 256) + 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", G.rk_number(rk).alias("value"))


@query("""
    SELECT p_partkey, [m[1], m[2]] AS parts FROM (SELECT p_partkey, regexp_extract_all(CASE WHEN p_partkey % 2 = 0 THEN p_name || ' 가나' ELSE '가' || p_name END, '([ -~]+|[^ -~]+)') AS m FROM part)""")
def script_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in stretches of ASCII and of all else."""
    from pyspark.sql.types import ArrayType, StringType

    @F.pandas_udf(ArrayType(StringType()))
    def parted(x):
        return x.map(lambda t: pdf.script_parts(t)[:2])

    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" 가나"))).otherwise(F.concat(F.lit("가"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", parted(name).alias("parts"))


@query("SELECT n_nationkey, 'dk1' AS name, upper(printf('%06x', n_nationkey * 99991 % 16777216)) AS colour FROM nation")
def theme_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    colour = F.lower(F.lpad(F.hex(F.col("n_nationkey").cast("long") * 99991 % 16777216), 6, "0"))
    xml = F.concat(F.lit('<a:theme><a:clrScheme name="x"><a:dk1>\n<a:sysClr val="windowText" lastClr="'), colour, F.lit('"/></a:dk1></a:clrScheme></a:theme>'))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(theme_colours(xml)).alias("name", "colour"))


@query("""
    WITH t AS (SELECT n_nationkey, (n_nationkey - 12) / 20.0 AS tint, [n_nationkey * 9, n_nationkey * 3, 255 - n_nationkey] AS c FROM nation)
    SELECT n_nationkey, upper(array_to_string(list_transform(c, lambda v: printf('%02x', floor(CASE WHEN tint < 0 THEN v * (1 + tint) ELSE v * (1 - tint) + 255 * tint END + 0.5)::INT)), '')) AS colour FROM t""")
def shaded_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def mixed(k):
        return k.map(lambda n: shaded(f"{n * 9:02X}{n * 3:02X}{255 - n:02X}", (n - 12) / 20.0))

    return table(spark, sf_dir, "nation").select("n_nationkey", mixed("n_nationkey").alias("colour"))


@query("SELECT o_orderkey, coalesce(o_orderkey % 5 NOT IN (0, 1, 2, 3), true) AS on_ FROM orders")
def toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatting toggles by their value: four words turn one off, whatever their case."""
    k = F.col("o_orderkey") % 5
    value = F.when(k == 0, "0").when(k == 1, "False").when(k == 2, "OFF").when(k == 3, "none").otherwise("1")
    return table(spark, sf_dir, "orders").select("o_orderkey", (~F.lower(value).isin("0", "false", "off", "none")).alias("on_"))
