import io
import zipfile

from pyspark.sql import functions as F

from folium.sources import archives, office, rtf
from folium.streaming import ingest

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = {"word/document.xml": f'<w:document {NS}><w:body><w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Hi</w:t></w:r><w:r><w:t> you</w:t><w:br/><w:t>x</w:t></w:r></w:p><w:sectPr/></w:body></w:document>', "word/styles.xml": "<s/>"}
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
XLSX = {
    "xl/workbook.xml": f'<workbook {X}><sheets><sheet name="One"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {X}><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {X}><sheetData><row r="1"><c r="A1" t="s" s="3"><v>1</v></c><c r="B1"><v>5</v></c></row></sheetData></worksheet>',
}


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return bytearray(out.getvalue())


def test_docx_round_trip(spark):
    files = spark.createDataFrame([("d", packed(DOCX)), ("bad", bytearray(b"PK nothing"))], "doc_id string, content binary")
    parts = archives.parts_of(files)
    assert parts.where("error is not null").select("doc_id").first().doc_id == "bad"
    runs = office.docx_runs(parts.where("error is null")).orderBy("run").collect()
    assert [(r.block, r.kind, r.style, r.text, r.marks) for r in runs] == [(0, "paragraph", "Title", "Hi", ["bold"]), (0, "paragraph", "Title", " you\nx", [])]
    edits = spark.createDataFrame([("d", 0, 1, " all\ny")], "doc_id string, block int, run int, text string")
    good = parts.where("error is null")
    again = archives.parts_of(archives.zipped(archives.with_edits(good, office.docx_edited(good, edits))))
    assert office.docx_blocks(again).first().text == "Hi all\ny"
    assert bytes(again.where("part = 'word/styles.xml'").first().content) == b"<s/>"


def test_xlsx_round_trip(spark):
    parts = archives.parts_of(spark.createDataFrame([("d", packed(XLSX))], "doc_id string, content binary"))
    cells = {r.ref: (r.sheet, r.style, r.text) for r in office.xlsx_cells(parts).collect()}
    assert cells == {"A1": ("One", 3, "bc"), "B1": ("One", 0, "5")}
    edits = spark.createDataFrame([("d", "One", "A1", "new"), ("d", "One", "Z9", "no")], "doc_id string, sheet string, ref string, text string")
    again = archives.with_edits(parts, office.xlsx_edited(parts, edits))
    assert {r.ref: (r.style, r.text) for r in office.xlsx_cells(again).collect()} == {"A1": (3, "new"), "B1": (0, "5")}


def test_rtf(spark):
    source = r"{\rtf1\ansi\ansicpg949{\fonttbl{\f0 Arial;}}\b Bold\b0  \'b0\'a1\u44032?!\par next\{x\}}"
    assert "".join(raw for _, raw in rtf.tokenized(source)) == source
    assert rtf.plain(source) == "Bold 가가!\nnext{x}"
    files = spark.createDataFrame([("d", bytearray(source.encode()))], "doc_id string, content binary")
    assert rtf.rtf_text(files).first().text.endswith("next{x}")


def test_stream(spark, tmp_path, sf_dir):
    (tmp_path / "a.txt").write_text("plain words")
    (tmp_path / "b.bin").write_bytes(bytes(packed(DOCX)))
    q = ingest.routed(spark, f"file://{tmp_path}").select("container", "format").writeStream.format("memory").queryName("routed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.container, r.format) for r in spark.table("routed").collect()) == [("text", "txt"), ("zip", None)]
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert ingest.event_counts(events).agg(F.sum("n")).first()[0] == events.count()
