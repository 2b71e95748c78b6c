"""Queries over files of office formats made from the tables, and the SQL that states what they must give back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import codecs as C
from folium.functions.grid import number_text
from folium.operators.palette import DEFAULT
from folium.plans import makers, registry
from folium.sources import archives, biff, cfb, korean, olddoc, oldslides, pdf, rtf, sheets, slides, textdocs, word
from folium.sources.markup import html_nodes
from folium.sources.tables import by_row, spread, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By conversation, a: turn and role, b: the text's first line, printable."""
    line = F.regexp_replace(F.regexp_extract("text", r"^[^\n\r]*", 0), r"[^ -~]", "?")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.col("turn").cast("string"), F.lit(" <"), "role", F.lit("> & é 가")).alias("a"), F.concat(F.lit("t"), line).alias("b"))
    return makers.by_doc(rows, "conv_id", ["turn"], ["a", "b"])


_T = "t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n, turn || ' <' || role || '> & é 가' AS a, 't' || regexp_replace(regexp_extract(text, '^[^\\n\\r]*'), '[^ -~]', '?', 'g') AS b FROM conversations)"
_E = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _esc(c: str) -> str:
    return _E.format(c)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By order, a: a text of each line, b: its price."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), (F.col("l_partkey") % 50).cast("string"), F.when(F.col("l_partkey") % 7 == 0, "가").otherwise(""), F.lit(" <&")).alias("a"), F.col("l_extendedprice").alias("b"))
    return makers.by_doc(rows, "l_orderkey", ["l_linenumber"], ["a", "b"])


_L = "l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, a, b) - 1 AS i, a, b FROM (SELECT l_orderkey, l_linenumber, 'p' || (l_partkey % 50) || CASE WHEN l_partkey % 7 = 0 THEN '가' ELSE '' END || ' <&' AS a, l_extendedprice AS b FROM lineitem))"
_N = "CASE WHEN b = floor(b) THEN printf('%.0f', b) ELSE regexp_replace(printf('%.10f', floor(b * 1e10 + 0.5) / 1e10), '0+$', '') END"


# Word.

_DOCX = f"""
    {_T}, r AS (SELECT conv_id, turn, i, '<p class="s-body" data-pp="pp-' || i || '"><strong>' || {_esc('a')} || '</strong><span data-rp="rp-' || i || '"> ' || {_esc('b')} || '</span></p>' AS p,
      '<tr><td class="s-body" data-cell="tbl-0:' || i || ':0">' || {_esc('a')} || '</td><td class="s-body" data-cell="tbl-0:' || i || ':1">' || {_esc('b')} || '</td></tr>' AS tr FROM t)"""


@query(f"""
    WITH {_DOCX}
    SELECT conv_id::VARCHAR AS doc_id, '<div class="folium-doc" data-palette="default-v0">' || chr(10) || '<h1 class="s-title">List</h1>' || chr(10) || string_agg(p, chr(10) ORDER BY i) || chr(10)
      || '<table class="s-body" data-table="tbl-0"><tbody>' || string_agg(tr, '' ORDER BY i) || '</tbody></table>' || chr(10) || '<div class="s-frozen" data-frozen="frozen-0" contenteditable="false">[w:bookmarkStart]</div>' || chr(10) || '</div>' AS html
    FROM r GROUP BY conv_id""")
def docx_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word.encoded(archives.parts_of(makers.files(_turns(spark, sf_dir), makers.docx)), DEFAULT)


@query(f"""
    WITH {_T}, e AS (SELECT conv_id, string_agg('<w:p><w:pPr><w:pStyle w:val="Normal"/><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">' || {_esc('upper(a)')}
        || '</w:t></w:r><w:r><w:rPr><w:color w:val="FF0000"/></w:rPr><w:t xml:space="preserve"> ' || {_esc('b')} || '</w:t></w:r></w:p>', '' ORDER BY i) AS paras,
      string_agg('<w:tr><w:tc><w:p><w:r><w:t xml:space="preserve">' || {_esc('upper(a)')} || '</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t xml:space="preserve">' || {_esc('b')} || '</w:t></w:r></w:p></w:tc></w:tr>', '' ORDER BY i) AS trs FROM t GROUP BY conv_id)
    SELECT conv_id::VARCHAR AS doc_id, '<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t xml:space="preserve">List</w:t></w:r></w:p>' || paras || '<w:tbl>' || trs || '</w:tbl><w:bookmarkStart w:id="1"/><w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr>' AS body FROM e""")
def docx_edited_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited markup (roles in capitals) written back: formatting, the kept element and the section stay."""
    parts = archives.parts_of(makers.files(_turns(spark, sf_dir), makers.docx)).where("error is null")
    html = word.encoded(parts, DEFAULT)
    up = F.col("html")
    for role in ("user", "assistant", "system"):
        up = F.replace(up, F.lit(f"&lt;{role}&gt; &amp; é"), F.lit(f"&lt;{role.upper()}&gt; &amp; É"))
    made = word.decoded(parts, html.select("doc_id", up.alias("html")), DEFAULT)
    again = archives.parts_of(archives.zipped(archives.with_edits(parts, made.where("error is null").select("doc_id", "part", "content"))))
    body = F.regexp_extract(F.col("content").cast("string"), r"(?s)<w:body>(.*)</w:body>", 1)
    return again.where(F.col("part") == word.DOCUMENT).select("doc_id", body.alias("body"))


# Spreadsheets.


@query(f"WITH {_L} SELECT l_orderkey::VARCHAR AS doc_id, 'Lines' AS sheet, i::BIGINT AS row, 0::BIGINT AS col, 1 AS style, a AS text FROM l UNION ALL SELECT l_orderkey::VARCHAR, 'Lines', i, 1, NULL, b::VARCHAR FROM l")
def xlsx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.cells_of(makers.files(_lines(spark, sf_dir), makers.xlsx)).select("doc_id", "sheet", "row", "col", "style", "text")


@query(f"""
    WITH {_L}, r AS (SELECT l_orderkey, i, '<tr><td data-cell="Lines!A' || (i + 1) || '">' || {_esc('a')} || '</td><td data-cell="Lines!B' || (i + 1) || '">' || b || '</td><td data-cell="Lines!C' || (i + 1) || '"></td></tr>' AS tr FROM l)
    SELECT l_orderkey::VARCHAR AS doc_id, '<div class="xlsx-doc">' || chr(10) || '<section class="xlsx-sheet" data-sheet="Lines"><h2>Lines</h2><table class="xlsx-edit"><tbody>' || string_agg(tr, '' ORDER BY i) || '</tbody></table></section>' || chr(10) || '</div>' AS html FROM r GROUP BY l_orderkey""")
def xlsx_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of the used range, which the sheet's dimension makes a column wider."""
    return sheets.encoded_of(makers.files(_lines(spark, sf_dir), makers.xlsx))


@query(f"WITH {_L} SELECT l_orderkey::VARCHAR AS doc_id, i::BIGINT AS row, CASE WHEN i % 2 = 0 THEN 'new ' || i ELSE a END AS text FROM l")
def xlsx_edited_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other text changed in the markup, written back and read again."""
    files = makers.files(_lines(spark, sf_dir), makers.xlsx)
    a = registry.adapter("xlsx")
    html = a.encode(files)
    cells = F.regexp_replace("html", r'(<td data-cell="Lines!A([0-9]*[13579])">)[^<]*', "$1new @$2@")
    fixed = F.array_join(F.transform(F.split(cells, "@"), lambda x, i: F.when(i % 2 == 1, (x.cast("int") - 1).cast("string")).otherwise(x)), "")
    back = a.decode(files, html.select("doc_id", fixed.alias("html"))).where("error is null")
    return sheets.cells_of(back.select("doc_id", "content")).where("col = 0").select("doc_id", "row", "text")


@query(f"""WITH {_L} SELECT l_orderkey::VARCHAR AS doc_id, count(*)::BIGINT AS n_rows, sum(len({_esc('a')}))::BIGINT AS n_text FROM l GROUP BY l_orderkey""")
def xlsx_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and texts of the previewed grid: cells of the second column span two in the first row, styled ones are bold."""
    made = sheets.previews(archives.parts_of(makers.files(_lines(spark, sf_dir), makers.xlsx)))
    rows = F.regexp_count("html", F.lit('<th class="xlsx-rowh">'))
    texts = F.regexp_extract_all("html", F.lit('<td style="font-weight:bold;font-size:11pt;text-align:center">([^<]*)</td>'), F.lit(1))
    return made.select("doc_id", rows.cast("long").alias("n_rows"), F.length(F.array_join(texts, "")).cast("long").alias("n_text"))


@query(f"""
    WITH {_L} SELECT l_orderkey::VARCHAR AS doc_id, 0 AS sheet_no, 'Lines' AS sheet, i::INT AS row, 0 AS col, 'A' || (i + 1) AS ref, 'text' AS type, a AS text FROM l
    UNION ALL SELECT l_orderkey::VARCHAR, 0, 'Lines', i, 1, 'B' || (i + 1), 'number', {_N} FROM l UNION ALL SELECT l_orderkey::VARCHAR, 1, 'Again', i, 2, 'C' || (i + 1), 'text', a FROM l""")
def xls_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of old spreadsheets within compound files."""
    return biff.cells(biff.books_of(makers.files(_lines(spark, sf_dir), makers.xls)))


@query(f"WITH {_L} SELECT l_orderkey::VARCHAR AS doc_id, s::INT AS sheet_no, i::INT AS row, CASE WHEN i % 2 = 0 AND s = 0 THEN 'longer than it was: ' || i ELSE a END AS text FROM l, range(0, 2) t(s)")
def xls_edited_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other text of the first sheet changed; the second sheet's offset moves."""
    files = makers.files(_lines(spark, sf_dir), makers.xls)
    streams, books = cfb.streams_of(files), biff.books_of(files)
    own = biff.cells(books).where("sheet_no = 0 and col = 0 and row % 2 = 0")
    edits = own.select("doc_id", "sheet_no", "row", "col", F.concat(F.lit("longer than it was: "), F.col("row").cast("string")).alias("text"))
    new = biff.edited_books(books, edits).select("doc_id", F.lit("Workbook").alias("part"), "content")
    return biff.cells(biff.books_of(cfb.compound(archives.with_edits(streams, new)))).where("type = 'text'").select("doc_id", "sheet_no", "row", "text")


# Presentations.

_RUNS = f"""{_T}, r AS (SELECT conv_id, (n - 1 - i)::INT AS slide_no, 'ppt/slides/slide' || (i + 1) || '.xml' AS part, a, b FROM t),
    x AS (SELECT conv_id, slide_no, part || '|1|p0|r0' AS run_id, a AS text FROM r UNION ALL SELECT conv_id, slide_no, part || '|1|p0|r1', b FROM r UNION ALL SELECT conv_id, slide_no, part || '|2.tc0.0|p0|r0', a FROM r UNION ALL SELECT conv_id, slide_no, part || '|2.tc0.0|p0|r1', b FROM r)"""


@query(f"WITH {_RUNS} SELECT conv_id::VARCHAR AS doc_id, slide_no, run_id, text FROM x")
def pptx_run_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of shapes and table cells, slides in the order of the list, which is the reverse of their numbers."""
    return slides.run_texts(archives.parts_of(makers.files(_turns(spark, sf_dir), makers.pptx)))


@query(f"WITH {_RUNS} SELECT conv_id::VARCHAR AS doc_id, run_id, CASE WHEN run_id LIKE '%|1|p0|r1' THEN ' ' || upper(text) ELSE text END AS text FROM x")
def pptx_edited_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = archives.parts_of(makers.files(_turns(spark, sf_dir), makers.pptx)).where("error is null")
    nodes = html_nodes(slides.encoded(parts))
    edits = slides.edited_runs(nodes).select("doc_id", "run_id", F.when(F.col("run_id").endswith("|1|p0|r1"), F.concat(F.lit(" "), F.upper("text"))).otherwise(F.col("text")).alias("text"))
    again = archives.parts_of(archives.zipped(archives.with_edits(parts, slides.decoded(parts, edits))))
    return slides.run_texts(again).select("doc_id", "run_id", "text")


@query(f"WITH {_T} SELECT conv_id::VARCHAR AS doc_id, 'ppt/slides/slide' || (i + 1) || '.xml' AS part, '1' AS shape, 1::BIGINT AS x, 2::BIGINT AS y, 100::BIGINT AS w, 10::BIGINT AS h FROM t")
def pptx_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slides.placed(archives.parts_of(makers.files(_turns(spark, sf_dir), makers.pptx))).where("kind = 'sp'").select("doc_id", "part", "shape", *(F.col(c).cast("long").alias(c) for c in "xywh"))


@query(f"WITH {_T} SELECT conv_id::VARCHAR AS doc_id, i::INT AS slide, (2 * i + k)::INT AS ord, CASE k WHEN 0 THEN a ELSE b END AS text FROM t, range(0, 2) g(k)")
def ppt_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of old presentations, wide and narrow, with the slide they are on."""
    found = oldslides.atoms(cfb.streams_of(makers.files(_turns(spark, sf_dir), makers.ppt)))
    return found.select("doc_id", F.col("slide").cast("int").alias("slide"), F.col("order").alias("ord"), "text")


@query(f"WITH {_T} SELECT conv_id::VARCHAR AS doc_id, (2 * i + k)::INT AS ord, CASE k WHEN 0 THEN a || ' and more' ELSE b END AS text FROM t, range(0, 2) g(k)")
def ppt_edited_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer texts laid out again; lengths of what holds them are right, or the walk would end."""
    streams = cfb.streams_of(makers.files(_turns(spark, sf_dir), makers.ppt))
    own = oldslides.atoms(streams).where("kind = 4000")
    made = oldslides.decoded(streams, own.select("doc_id", "atom_id", F.concat("text", F.lit(" and more")).alias("text")), grow=True).where("error is null")
    again = cfb.streams_of(cfb.compound(archives.with_edits(streams, made.select("doc_id", "part", "content"))))
    return oldslides.atoms(again).select("doc_id", F.col("order").alias("ord"), "text")


# Old Word and Hangul documents.

_PLAIN = "CASE WHEN i % 2 = 1 THEN regexp_replace(a, '가', '') ELSE a END"


def _plain_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose narrow pieces hold no wide characters."""
    own = F.transform("rows", lambda r, i: F.struct(r["turn"].alias("turn"), F.when(i % 2 == 1, F.replace(r["a"], F.lit("가"), F.lit(""))).otherwise(r["a"]).alias("a"), r["b"].alias("b")))
    return _turns(spark, sf_dir).select("doc_id", own.alias("rows"))


@query(f"WITH {_T} SELECT conv_id::VARCHAR AS doc_id, i || ':' || k AS para_id, CASE k WHEN 0 THEN {_PLAIN} ELSE b END AS text FROM t, range(0, 2) g(k)")
def doc_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = cfb.streams_of(makers.files(_plain_turns(spark, sf_dir), makers.doc))
    return olddoc.paragraphs(olddoc.pieces(streams)).select("doc_id", "para_id", "text")


@query(f"WITH {_T} SELECT conv_id::VARCHAR AS doc_id, string_agg(CASE WHEN i % 3 = 0 THEN 'new 나 ' || {_PLAIN} ELSE {_PLAIN} END || chr(13) || b || chr(13), '' ORDER BY i) AS text FROM t GROUP BY conv_id")
def doc_edited_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of another size: their pieces are split and the new characters put at the end."""
    streams = cfb.streams_of(makers.files(_plain_turns(spark, sf_dir), makers.doc))
    own = olddoc.paragraphs(olddoc.pieces(streams)).where("piece % 3 = 0 and para = 0")
    made = olddoc.decoded(streams, own.select("doc_id", "para_id", F.concat(F.lit("new 나 "), "text").alias("text")), grow=True).where("error is null")
    again = cfb.streams_of(cfb.compound(archives.with_edits(streams, made.select("doc_id", "part", "content"))))
    return olddoc.pieces(again).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("piece", "text")))["text"], "").alias("text"))


_HWP = f"""{_T}, p AS (SELECT conv_id, i, '<p class="s-body" data-pp="pp-' || i || '"><strong>' || {_esc('a')} || '</strong></p>' AS p FROM t)"""


@query(f"""WITH {_HWP} SELECT conv_id::VARCHAR AS doc_id, '<div class="folium-doc" data-palette="hwp">' || chr(10) || string_agg(p, chr(10) ORDER BY i) || chr(10) || '</div>' AS html FROM p GROUP BY conv_id""")
def hwp_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = cfb.streams_of(makers.files(_turns(spark, sf_dir), makers.hwp))
    return korean.hwp_encoded(streams, korean.palette_of([("0", "바탕글"), ("1", "개요 1")], "hwp"))


@query(f"WITH {_T} SELECT conv_id::VARCHAR AS doc_id, i::INT AS block, CASE WHEN i % 2 = 0 THEN replace(a, 'é', 'edited') ELSE a END AS text FROM t")
def hwp_edited_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = cfb.streams_of(makers.files(_turns(spark, sf_dir), makers.hwp))
    looks = korean.palette_of([("0", "바탕글"), ("1", "개요 1")], "hwp")
    html = korean.hwp_encoded(streams, looks)
    changed = F.array_join(F.transform(F.split("html", "\n"), lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit("é"), F.lit("edited"))).otherwise(x)), "\n")
    made = korean.hwp_decoded(streams, html.select("doc_id", changed.alias("html")), looks).where("error is null")
    again = cfb.streams_of(cfb.compound(archives.with_edits(streams, made.select("doc_id", "part", "content"))))
    return korean.hwp_pieces(again).select("doc_id", "block", "text")


_HWPX_LOOKS = korean.palette_of([("0", "바탕글")], "hwpx")


@query(f"""
    WITH {_T}, r AS (SELECT conv_id, i, '<p class="s-body" data-pp="pp-' || i || '"><span data-rp="rp-' || (2 * i) || '"><strong>' || {_esc('a')} || '</strong></span><span data-rp="rp-' || (2 * i + 1) || '"> ' || {_esc('b')} || '</span></p>' AS p,
      '<tr><td class="s-body" data-cell="htbl-0:' || i || ':0">' || {_esc('a')} || '</td><td class="s-body" data-cell="htbl-0:' || i || ':1">' || {_esc('b')} || '</td></tr>' AS tr FROM t)
    SELECT conv_id::VARCHAR AS doc_id, '<div class="folium-doc" data-palette="hwpx">' || chr(10) || string_agg(p, chr(10) ORDER BY i) || chr(10) || '<div class="s-frozen" data-frozen="secbound-1" contenteditable="false">[section]</div>' || chr(10)
      || '<table class="s-body" data-table="htbl-0"><tbody>' || string_agg(tr, '' ORDER BY i) || '</tbody></table>' || chr(10) || '</div>' AS html FROM r GROUP BY conv_id""")
def hwpx_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return korean.hwpx_encoded(archives.parts_of(makers.files(_turns(spark, sf_dir), makers.hwpx)), _HWPX_LOOKS)


@query(f"WITH {_T} SELECT conv_id::VARCHAR AS doc_id, s::INT AS section, string_agg(replace(a, 'é', 'edited') || CASE s WHEN 0 THEN ' ' ELSE '' END || b, '' ORDER BY i) AS text FROM t, range(0, 2) g(s) GROUP BY ALL")
def hwpx_edited_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and table cells edited; each goes back to its section."""
    parts = archives.parts_of(makers.files(_turns(spark, sf_dir), makers.hwpx)).where("error is null")
    html = korean.hwpx_encoded(parts, _HWPX_LOOKS)
    made = korean.hwpx_decoded(parts, html.select("doc_id", F.replace("html", F.lit("é"), F.lit("edited")).alias("html")), _HWPX_LOOKS).where("error is null")
    again = archives.parts_of(archives.zipped(archives.with_edits(parts, made.select("doc_id", "part", "content"))))
    from folium.sources.markup import TEXT, xml_nodes

    own = again.where(F.rlike("part", F.lit(korean.SECTION))).select(F.concat_ws("|", "doc_id", F.regexp_extract("part", korean.SECTION, 1)).alias("doc_id"), F.col("content").cast("string").alias("xml"))
    texts = xml_nodes(own).where(F.col("tag") == TEXT).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("node", "text")))["text"], "").alias("text"))
    return texts.select(F.split("doc_id", r"\|")[0].alias("doc_id"), F.split("doc_id", r"\|")[1].cast("int").alias("section"), "text")


# PDF.


def _pdf_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.transform("rows", lambda r: F.struct(r["turn"].alias("turn"), F.regexp_replace(r["a"], " & é 가", "(&)").alias("a"), F.left(r["b"], F.lit(40)).alias("b")))
    return _turns(spark, sf_dir).select("doc_id", own.alias("rows"))


@query(f"WITH {_T} SELECT conv_id::VARCHAR AS doc_id, i::INT AS page, k::INT AS item, CASE k WHEN 0 THEN trim(left(b, 40)) ELSE replace(a, ' & é 가', '(&)') END AS text, (40 + 40 * k)::DOUBLE AS y, k = 1 AS bold FROM t, range(0, 2) g(k)")
def pdf_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of written pages, read back in painting order."""
    found = pdf.items(makers.files(_pdf_rows(spark, sf_dir), makers.pdf_file))
    return found.select("doc_id", "page", "item", F.trim("text").alias("text"), "y", "bold")


@query(f"WITH {_T} SELECT conv_id::VARCHAR AS doc_id, i::INT AS page, 300.0::DOUBLE AS w, 100.0::DOUBLE AS h, 1::BIGINT AS n_paths FROM t")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = makers.files(_pdf_rows(spark, sf_dir), makers.pdf_file)
    drawn = pdf.paths(files).groupBy("doc_id", "page").agg(F.count("*").alias("n_paths"))
    return pdf.pages(files).join(drawn, ["doc_id", "page"], "left").select("doc_id", "page", "w", "h", "n_paths")


@query(f"WITH {_T} SELECT conv_id::VARCHAR AS doc_id, i::INT AS page, k::INT AS item, CASE k WHEN 0 THEN 'bold new' ELSE replace(a, ' & é 가', '(&)') END AS text FROM t, range(0, 2) g(k)")
def pdf_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every first run of a page replaced through its slot, and the file written again."""
    files = makers.files(_pdf_rows(spark, sf_dir), makers.pdf_file)
    own = pdf.slots(files).where("item = 0").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("slot_id", F.lit("<b>bold</b> new")))).alias("slots"))
    return pdf.items(pdf.filled(files, own).where("error is null").select("doc_id", "content")).select("doc_id", "page", "item", F.trim("text").alias("text"))


# Texts.


def _ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with characters beyond ASCII in RTF's way."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _rtf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = by_row(spread(_ascii(spark, sf_dir)), lambda doc, text: ((doc, rtf.escaped(text)),), "doc_id string, text string")
    body = F.replace("text", F.lit("\\line "), F.lit("\\par "))
    return t.select("doc_id", F.encode(F.concat(F.lit("{\\rtf1\\ansi\\ansicpg1252{\\fonttbl{\\f0 Arial;}}\\uc1 "), body, F.lit("}")), "ISO-8859-1").alias("content"))


@query("SELECT doc_id::VARCHAR AS doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def rtf_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents written as RTF and read back."""
    return rtf.rtf_text(_rtf_files(spark, sf_dir)).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
    SELECT doc_id::VARCHAR AS doc_id, sha256(string_agg(CASE WHEN i = 0 AND line <> '' THEN 'Ω {new} ' || line ELSE line END, chr(10) ORDER BY i)) AS digest FROM l GROUP BY doc_id""")
def rtf_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each document changed in the markup and written back as a group of its own."""
    files = _rtf_files(spark, sf_dir)
    edits = rtf.edited_runs(html_nodes(rtf.rtf_html(rtf.rtf_runs(files)))).join(rtf.rtf_runs(files).where("para = 0 and place = 0 and rid is not null").select("doc_id", "rid"), ["doc_id", "rid"])
    again = rtf.rtf_edited(files, edits.select("doc_id", "rid", F.concat(F.lit("Ω {new} "), "text").alias("text")))
    return rtf.rtf_text(again).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("""SELECT n_nationkey::VARCHAR AS doc_id, chr(65279) || 'key;name' || chr(13) || chr(10) || n_nationkey || ';"' || n_name || ';""x""' || chr(10) || 'y"' AS text FROM nation""")
def csv_roundtrip_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mark, delimiter and line ends of a file kept through markup; quoted fields with line ends and quotes."""
    text = F.concat(F.lit("﻿key;name\r\n"), F.col("n_nationkey").cast("string"), F.lit(';"'), "n_name", F.lit(';""x""\ny"'))
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), text.alias("text"))
    return textdocs.csv_decoded(textdocs.csv_encoded(docs)).select("doc_id", "text")


@query("""SELECT n_nationkey::VARCHAR AS doc_id, '<table class="csv-grid"><tr><th>1</th><th>a</th><th>b</th></tr><tr><th>2</th><td>' || n_name || '</td><td></td></tr></table>' AS grid FROM nation""")
def csv_preview_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), F.concat(F.lit("a,b\n"), "n_name").alias("text"))
    return textdocs.csv_preview(docs).select("doc_id", F.regexp_extract("html", "(?s)<table.*</table>", 0).alias("grid"))


@query("""SELECT n_nationkey::VARCHAR AS doc_id, '<h2>' || n_name || ' <strong>b</strong></h2>' || chr(10) || '<ul><li>one <code>x&lt;y</code></li><li>two</li></ul>' || chr(10) || '<p><a href="http://x/' || n_nationkey || '">l</a></p>' AS html FROM nation""")
def markdown_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("## "), "n_name", F.lit(" **b**\n\n- one `x<y`\n- two\n\n[l](http://x/"), F.col("n_nationkey").cast("string"), F.lit(")\n"))
    return textdocs.markdown_encoded(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id"), text.alias("text")))


@query("""SELECT n_nationkey::VARCHAR AS doc_id, '## ' || n_name || ' **b**' || chr(10) || chr(10) || '- one `x<y`' || chr(10) || '- two' || chr(10) || chr(10) || '[l](http://x/' || n_nationkey || ')' || chr(10) AS text FROM nation""")
def markdown_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textdocs.markdown_decoded(markdown_encoded(spark, sf_dir))


# Containers and codecs.


@query("SELECT doc_id::VARCHAR AS doc_id, p.part AS part, sha256(CASE p.part WHEN 'a/Text' THEN coalesce(text, '') ELSE coalesce(left(text, 100), '') || doc_id END) AS digest FROM documents, (VALUES ('a/Text'), ('Short')) p(part)")
def cfb_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts and short ones as streams of compound files, written and read."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("t"))
    parts = d.select("doc_id", F.lit("a/Text").alias("part"), F.encode("t", "UTF-8").alias("content")).union(d.select("doc_id", F.lit("Short"), F.encode(F.concat(F.left("t", F.lit(100)), "doc_id"), "UTF-8")))
    return cfb.streams_of(cfb.compound(parts)).select("doc_id", "part", F.sha2("content", 256).alias("digest"))


@query("""SELECT doc_id, md5(coalesce(text, '')) AS md5, sha256(coalesce(text, '')) AS sha256, to_base64(encode(coalesce(text, ''))) AS base64, true AS same FROM documents""")
def codec_roundtrips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through LZW, ASCII85, base64, deflate and AES and back, with their digests."""
    import base64
    import zlib

    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b")))
    key = bytes(range(16))
    there = (
        lambda x: C.lzw(C.to_lzw(x)), lambda x: C.ascii85(base64.a85encode(x) + b"~>"), lambda x: C.inflate(zlib.compress(x)) if x else b"",
        lambda x: C.aes_cbc_decrypt(key, C.aes_cbc_encrypt(key, key, x + bytes((16 - len(x) % 16,)) * (16 - len(x) % 16)), key),
    )
    back = by_row(d, lambda doc, x: ((doc, x, all(f(x) == x for f in there)),), "doc_id long, b binary, same boolean")
    same = F.col("same") & (F.col("b") == C.base64_bytes(F.concat(F.lit("-\n"), C.base64_text(F.col("b")))))
    return back.select("doc_id", F.lower(F.hex(C.digest(F.col("b"), 128))).alias("md5"), F.lower(F.hex(C.digest(F.col("b"), 256))).alias("sha256"), C.base64_text(F.col("b")).alias("base64"), same.alias("same"))


# Any format.


@query(f"""
    WITH {_T}, c AS (SELECT DISTINCT conv_id FROM t)
    SELECT conv_id || '.' || f AS doc_id, f AS format FROM c, (VALUES ('docx'), ('xlsx'), ('pptx'), ('hwpx'), ('xls'), ('ppt'), ('doc'), ('hwp'), ('pdf')) v(f)""")
def routed_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of nine formats routed by what they hold."""
    turns, plain = _turns(spark, sf_dir), _plain_turns(spark, sf_dir)
    numbers = turns.select("doc_id", F.transform("rows", lambda r: F.struct(r["turn"].alias("l_linenumber"), r["a"].alias("a"), r["turn"].cast("double").alias("b"))).alias("rows"))
    out = None
    for name, grouped, make in (
        ("docx", turns, makers.docx), ("xlsx", numbers, makers.xlsx), ("pptx", turns, makers.pptx), ("hwpx", turns, makers.hwpx), ("xls", numbers, makers.xls),
        ("ppt", turns, makers.ppt), ("doc", plain, makers.doc), ("hwp", turns, makers.hwp), ("pdf", _pdf_rows(spark, sf_dir), makers.pdf_file),
    ):
        own = makers.files(grouped, make).select(F.concat("doc_id", F.lit(f".{name}")).alias("doc_id"), "content")
        out = own if out is None else out.union(own)
    return registry.opened(out)


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_retailprice ELSE p_size END::DOUBLE AS value, CASE WHEN v = floor(v) THEN printf('%.0f', v) ELSE regexp_replace(printf('%.10f', floor(v * 1e10 + 0.5) / 1e10), '0+$', '') END AS text FROM (SELECT *, CASE WHEN p_size % 4 = 0 THEN p_retailprice ELSE p_size END::DOUBLE AS v FROM part)")
def biff_number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of old spreadsheets as texts."""
    v = F.when(F.col("p_size") % 4 == 0, F.col("p_retailprice")).otherwise(F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("value"), number_text(v).alias("text"))
