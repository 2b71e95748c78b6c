"""Faults found in the third round."""

from compare import same
from folium.plans import catalog
from folium.sources.tables import arrow_schema, batched


def test_an_empty_text_is_a_row_of_one_field(spark, tmp_path):
    texts = ["", "a|b\n\nc", "x", "|", None, "end\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    same(catalog.queries()["csv_ragged_width"](spark, str(tmp_path)), catalog.ORACLES["csv_ragged_width"], str(tmp_path))


def test_batches_are_bounded_by_rows_and_bytes(spark):
    rows = [(i, "x" * 1000 * (i % 3)) for i in range(100)]
    made = list(batched(iter(rows), arrow_schema("i int, t string"), 10, 5000))
    assert [r for b in made for r in zip(*b.to_pydict().values(), strict=True)] == rows
    assert all(b.num_rows <= 10 and sum(map(len, b.column("t").to_pylist())) < 7000 for b in made) and len(made) > 15


def test_python_steps_take_rows_one_at_a_time(spark, sf_dir):
    """No frame of a whole batch, and no frame for each document, is made."""
    for name in ("rtf_texts", "pptx_edited_runs", "docx_encoded", "ppt_edited_atoms", "hwpx_edited_text", "pdf_pages", "pdf_items", "docx_edited_body", "cfb_streams"):
        plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
        assert "MapInPandas" not in plan and "FlatMapGroupsInPandas" not in plan and "ArrowEvalPython" not in plan, name


def test_rtf_text_of_every_byte():
    from folium.functions.codecs import decoded

    data = bytes(range(256)) * 2
    assert decoded(data, 1252) == "".join(b.to_bytes(1).decode("cp1252", "ignore") or chr(b) for b in data)
    assert decoded(b"\xb0\xa1", 949) == "가"


def test_codecs_take_whole_texts(spark, tmp_path, monkeypatch):
    """A text is not the same unless AES gives back its last block too; the reader is given one that spoils what lies beyond 1024 bytes."""
    from folium.functions import codecs as C

    text = "".join(chr(32 + i * 7 % 90) for i in range(5000))
    spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.queries()["codec_roundtrips"]
    assert [r.same for r in found(spark, str(tmp_path)).collect()] == [True] * 3
    sent = C.aes_cbc_decrypt
    monkeypatch.setattr(C, "aes_cbc_decrypt", lambda *x, **y: (out := sent(*x, **y))[:1024] + bytes(len(out[1024:])))
    make = []
    monkeypatch.setattr("folium.plans.office_queries.by_row", lambda frame, f, schema: make.append(f) or frame.selectExpr("doc_id", "b", "true AS same"))
    found(spark, str(tmp_path))
    assert [x[2] for x in make[0](1, text.encode())] == [False] and [x[2] for x in make[0](1, b"short")] == [True]


def test_ciphers_and_ascii85_on_odd_lengths():
    import base64
    import random

    from folium.functions import codecs as C

    r = random.Random(3)
    for n in range(60):
        key, iv, data = r.randbytes((16, 24, 32)[n % 3]), r.randbytes(16), r.randbytes(16 * n)
        assert C.aes_cbc_decrypt(key, C.aes_cbc_encrypt(key, iv, data), iv, padded=False) == data
        assert C.ascii85(base64.a85encode(data[:n]) + b"~>") == data[:n]
    assert C.ascii85(b"!!zA\nBCDE F") == C.ascii85(b"!!ABC" + b"DEF") != b""


def test_spreadsheets_in_one_pass(spark, sf_dir):
    """Each file is made in one step and read in one, without joins of its cells; markup of another shape is read tolerantly."""
    for name, most in (("xlsx_cells", 2), ("xlsx_encoded", 2)):
        plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("MapInArrow") <= most and "Join" not in plan and "Window" not in plan, name
    from folium.sources import sheets

    xml = b'<worksheet><dimension ref="A1:B2"/><c r="B2" t="s" s="3"><v> 1</v><v>0</v></c><c r="A1" t="inlineStr"><v>9</v><is><t>in<x>ner</x></t></is></c><c r="a2"><v>5</v></c><c r="A2"/><c r="?" t="s"><v>7</v></c></worksheet>'
    parts = {"xl/worksheets/sheet2.xml": xml, "xl/worksheets/sheet10.xml": b"<broken", "xl/sharedStrings.xml": f"<sst {X}><si><t>a</t></si><si><r><t>b</t></r><r><t>&lt;c</t></r></si></sst>".encode()}
    assert [(i, s, d, c) for i, _, s, d, c in sheets.book_of(parts)] == [(0, "Sheet1", ["A1:B2"], {(1, 1): (3, "b<c"), (0, 0): (None, ""), (1, 0): (None, "")}), (1, "Sheet2", [], {})]
    html = sheets._editable(parts)
    assert sheets._AS_WRITTEN.fullmatch(html) and list(sheets._texts(html)) == [("Sheet1!A1", ""), ("Sheet1!B1", ""), ("Sheet1!A2", ""), ("Sheet1!B2", "b<c"), ("Sheet2!A1", "")]
    assert dict(sheets._texts(html.replace("b&lt;c", "b&lt;c<br>d"))) == dict(sheets._texts(html)) | {"Sheet1!B2": "b<c\nd"}


X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_old_spreadsheets_in_one_pass(spark, sf_dir):
    from folium.sources import biff

    book = biff.book_bytes([("One", [(0, 0, "a"), (0, 1, 2.5), (0, 0, "last")]), ("One", [(0, 0, "가")])])
    assert biff.cells_in(book) == {(0, "One", 0, 0): ("text", None, "last"), (0, "One", 0, 1): ("number", 2.5, ""), (1, "One", 0, 0): ("text", None, "가")}
    plan = catalog.queries()["xls_cells"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 3 and "Join" not in plan and "Window" not in plan


def test_xml_is_read_once(spark, sf_dir):
    for name in ("xml_roundtrip", "xml_deep_text"):
        plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan, name
