"""Files made from the tables, for queries that read them back."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.text import escape, escape_attribute
from folium.sources import biff, cfb, korean, olddoc, oldslides, pdf
from folium.sources.tables import by_row, spread


def by_doc(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """doc_id, rows: each key's rows as an array of structs, in order."""
    own = F.array_sort(F.collect_list(F.struct(*order, *(c for c in columns if c not in order))))
    return spread(rows.withColumn("doc_id", F.col(key).cast("string"))).groupBy("doc_id").agg(own.alias("rows"))


def files(grouped: DataFrame, make) -> DataFrame:
    """doc_id, content of by_doc(); make(rows) gives bytes."""
    return by_row(grouped.select("doc_id", "rows"), lambda doc, rows: ((doc, make(rows)),), "doc_id string, content binary")


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(zipfile.ZipInfo(k, (1980, 1, 1, 0, 0, 0)), v)
    return out.getvalue()


def _x(text) -> str:
    return str(text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def docx(rows: list) -> bytes:
    """A title, a paragraph for each row (a in bold, b plain), a table of all rows, a kept element, a section."""
    run = lambda t, look="": f'<w:r>{f"<w:rPr>{look}</w:rPr>" if look else ""}<w:t xml:space="preserve">{_x(t)}</w:t></w:r>'
    paras = "".join(f'<w:p><w:pPr><w:pStyle w:val="Normal"/><w:jc w:val="center"/></w:pPr>{run(r["a"], "<w:b/>")}{run(" " + r["b"], "<w:color w:val=&quot;FF0000&quot;/>".replace("&quot;", chr(34)))}</w:p>' for r in rows)
    table = "<w:tbl>" + "".join(f"<w:tr><w:tc><w:p>{run(r['a'])}</w:p></w:tc><w:tc><w:p>{run(r['b'])}</w:p></w:tc></w:tr>" for r in rows) + "</w:tbl>"
    body = f'<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr>{run("List")}</w:p>{paras}{table}<w:bookmarkStart w:id="1"/><w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr>'
    return zipped({"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}/>"})


S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def xlsx(rows: list) -> bytes:
    """One sheet: column A shared texts, column B numbers."""
    texts = list(dict.fromkeys(r["a"] for r in rows))
    at = {t: i for i, t in enumerate(texts)}
    data = "".join(f'<row r="{i}"><c r="A{i}" t="s" s="1"><v>{at[r["a"]]}</v></c><c r="B{i}"><v>{r["b"]}</v></c></row>' for i, r in enumerate(rows, 1))
    return zipped({
        "[Content_Types].xml": "<Types/>", "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Lines"/></sheets></workbook>',
        "xl/sharedStrings.xml": f"<sst {S}>{''.join(f'<si><t>{_x(t)}</t></si>' for t in texts)}</sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><dimension ref="A1:C{len(rows)}"/><sheetData>{data}</sheetData><mergeCells><mergeCell ref="B1:C1"/></mergeCells></worksheet>',
        "xl/styles.xml": f'<styleSheet {S}><fonts><font/><font><b/><sz val="11"/></font></fonts><cellXfs><xf fontId="0"/><xf fontId="1"><alignment horizontal="center"/></xf></cellXfs></styleSheet>',
    })


A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def pptx(rows: list) -> bytes:
    """A slide for each row: a shape of two runs, and a table cell; listed from last to first."""
    parts: dict[str, str] = {"[Content_Types].xml": "<Types/>"}
    for i, r in enumerate(rows, 1):
        para = f"<a:p><a:r><a:t>{_x(r['a'])}</a:t></a:r><a:br/><a:r><a:t>{_x(r['b'])}</a:t></a:r></a:p>"
        table = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody>{para}</a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
        parts[f"ppt/slides/slide{i}.xml"] = f'<p:sld {A}><p:cSld><p:spTree><p:nvGrpSpPr/><p:sp><p:spPr><a:xfrm><a:off x="9525" y="19050"/><a:ext cx="952500" cy="95250"/></a:xfrm></p:spPr><p:txBody>{para}</p:txBody></p:sp>{table}</p:spTree></p:cSld></p:sld>'
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="r{i}"/>' for i in range(len(rows), 0, -1))
    parts["ppt/presentation.xml"] = f"<p:presentation {A}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>"
    rels = "".join(f'<Relationship Id="r{i}" Type="{_REL}/slide" Target="slides/slide{i}.xml"/>' for i in range(1, len(rows) + 1))
    parts["ppt/_rels/presentation.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>'
    return zipped(parts)


def hwpx(rows: list) -> bytes:
    """Two sections: a paragraph for each row in the first, a table of all rows in the second."""
    ns = 'xmlns:hs="http://www.hancom.co.kr/hwpml/2011/section" xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph"'
    run = lambda t, c: f'<hp:run charPrIDRef="{c}"><hp:t>{_x(t)}</hp:t></hp:run>'
    first = "".join(f'<hp:p paraPrIDRef="3" styleIDRef="0">{run(r["a"], 1)}{run(" " + r["b"], 0)}</hp:p>' for r in rows)
    table = "".join(f"<hp:tr><hp:tc><hp:subList><hp:p>{run(r['a'], 0)}</hp:p></hp:subList></hp:tc><hp:tc><hp:subList><hp:p>{run(r['b'], 0)}</hp:p></hp:subList></hp:tc></hp:tr>" for r in rows)
    header = '<hh:head xmlns:hh="http://www.hancom.co.kr/hwpml/2011/head"><hh:charPr id="0"/><hh:charPr id="1"><hh:bold/></hh:charPr><hh:style id="0" type="PARA" name="바탕글"/></hh:head>'
    return zipped({"mimetype": "application/hwp+zip", "Contents/header.xml": header, "Contents/section0.xml": f"<hs:sec {ns}>{first}</hs:sec>", "Contents/section1.xml": f'<hs:sec {ns}><hp:p styleIDRef="0"><hp:run charPrIDRef="0"><hp:tbl>{table}</hp:tbl></hp:run></hp:p></hs:sec>'})


def xls(rows: list) -> bytes:
    """Two sheets: texts and numbers; the texts again as labels."""
    first = [x for i, r in enumerate(rows) for x in ((i, 0, r["a"]), (i, 1, float(r["b"])))]
    return cfb.written({"Workbook": biff.book_bytes([("Lines", first), ("Again", [(i, 2, r["a"]) for i, r in enumerate(rows)])])})


def ppt(rows: list) -> bytes:
    """A slide for each row, with a wide and a one-byte text."""
    record, data = oldslides.record, b""
    for r in rows:
        narrow = record(oldslides.BYTES, r["b"].encode("latin-1", "replace"))
        data += record(oldslides.SLIDE, record(oldslides.CHARS, r["a"].encode("utf-16-le")) + record(0x0F9F, narrow, True), True)
    return cfb.written({oldslides.STREAM: data, oldslides.USER: bytes(24)})


def doc(rows: list) -> bytes:
    """A piece for each row, wide and narrow in turn, ending its paragraph."""
    return cfb.written(olddoc.made([(f"{r['a']}\r{r['b']}\r", i % 2 == 1) for i, r in enumerate(rows)]))


def hwp(rows: list) -> bytes:
    return cfb.written(korean.made([r["a"] for r in rows], tuple(i for i, r in enumerate(rows) if r["b"])))


def pdf_file(rows: list) -> bytes:
    """A page for each row: two lines of text and a rectangle."""
    pages = []
    for r in rows:
        run = lambda y, t: {"seq": int(y), "x": 20.0, "y": y, "size": 10.0, "text": t, "bold": y > 50, "color": [0, 0, 0], "turn": None, "w": None}
        box = [("M", (1, 1)), ("L", (9, 1)), ("L", (9, 9)), ("Z", ())]
        pages.append(pdf.Page(w=300.0, h=100.0, items=[run(80.0, r["a"]), run(40.0, r["b"])], paths=[{"seq": 1, "d": box, "fill": (0, 0, 255), "stroke": None, "line": 1}]))
    return pdf.written(pages)


def xml_order(attributes: dict[str, Column], lines: Column) -> Column:
    """<order ..><line n=".."><part>..</part><qty>..</qty></line>..</order> from an array of structs n, part, qty."""
    pairs = [F.concat(F.lit(f' {k}="'), escape_attribute(v), F.lit('"')) for k, v in attributes.items()]
    one = lambda x: F.concat(F.lit('<line n="'), x["n"].cast("string"), F.lit('"><part>'), escape(x["part"]), F.lit("</part><qty>"), x["qty"].cast("string"), F.lit("</qty></line>"))
    return F.concat(F.lit("<order"), *pairs, F.lit(">"), F.array_join(F.transform(lines, one), ""), F.lit("</order>"))
