import hashlib
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from folium.functions import codecs as C
from folium.plans import makers, registry
from folium.sources import archives, biff, cfb, korean, pdf, pdfobjects, rtf, slides, textdocs, word, wordview

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_ciphers_by_published_vectors():
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        assert C.aes_cbc_encrypt(bytes(range(n)), bytes(16), plain).hex() == want
        assert C.aes_cbc_decrypt(bytes(range(n)), bytes.fromhex(want), bytes(16), padded=False) == plain
    assert C.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"


def test_streams():
    assert C.lzw(bytes.fromhex("800B6050220C0C8501")).hex() == "2d2d2d2d2d412d2d2d42"
    for size in (0, 1, 300, 9000):
        data = os.urandom(size) + bytes(i * i % 7 for i in range(size))
        assert C.lzw(C.to_lzw(data)) == data and C.lzw(C.to_lzw(data, 0), 0) == data
    text = b"some text " * 50
    assert C.inflate(zlib.compress(text)) == C.inflate(zlib.compress(text)[2:-4]) == text
    assert C.packbits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")).hex() == "aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa"
    assert C.ascii_hex(b"4 8656C6c6F7>zz") == b"Hellop"


def test_predictors():
    rows = [bytes((i * j) % 256 for j in range(12)) for i in range(5)]
    made, above = b"", bytes(12)
    for i, row in enumerate(rows):
        left = bytes(3) + row[:-3]
        corner = bytes(3) + above[:-3]

        def paeth(a, b, c):
            p = a + b - c
            return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]

        guess = [bytes(12), left, above, bytes((a + b) // 2 for a, b in zip(left, above)), bytes(paeth(a, b, c) for a, b, c in zip(left, above, corner))][i]
        made += bytes((i,)) + bytes((x - y) % 256 for x, y in zip(row, guess))
        above = row
    assert C.unpredicted(made, 15, 3, 8, 4) == b"".join(rows)


def test_fax_and_tiff():
    # One white line of 16, then a line of 4 white, 4 black, 8 white, in the one-dimensional code.
    bits = "101010" + "1011" + "011" + "10011"
    assert C.fax(int(bits.ljust(24, "0"), 2).to_bytes(3), 16, 2, 0) == bytes((255, 255, 0xF0, 0xFF))
    # In two dimensions: a white line (vertical 0), then a horizontal run and the rest as above.
    two = "1" + "001" + "1011" + "011" + "1"
    assert C.fax(int(two.ljust(16, "0"), 2).to_bytes(2), 16, 2, -1) == bytes((255, 255, 0xF0, 0xFF))
    pixels = bytes(range(12))
    head = struct.pack("<2sHI", b"II", 42, 8 + len(pixels))
    tags = [(256, 3, 1, 2), (257, 3, 1, 2), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 8), (277, 3, 1, 3), (278, 3, 1, 2), (279, 4, 1, 12)]
    data = head + pixels + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)
    assert C.tiff_pixels(data) == (2, 2, 3, pixels) and C.tiff_uri(data).startswith("data:image/png;base64,iVBOR")
    assert C.tiff_uri(data.replace(struct.pack("<HHII", 258, 3, 1, 8), struct.pack("<HHII", 258, 3, 1, 16))) is None


def test_png_is_read_by_its_parts():
    image = C.png(2, 1, bytes(6))
    assert image[12:16] == b"IHDR" and zlib.decompress(image[41 : 41 + struct.unpack(">I", image[33:37])[0]]) == bytes(7)


@pytest.mark.parametrize("n", [0, 1, 7, 300])
def test_compound_files(n):
    streams = {f"s{i}/x{i % 5}" if i % 2 else f"top{i}": os.urandom(i * 977 % 9000) for i in range(n)}
    assert cfb.Reader(cfb.written(streams)).paths == streams


def test_compound_file_of_many_sectors_and_broken_ones(spark):
    streams = {"Workbook": os.urandom(9_000_000), "small": b"x"}
    data = cfb.written(streams)
    assert cfb.Reader(data).paths == streams
    files = spark.createDataFrame([("a", bytearray(b"no")), ("b", bytearray(data[:600])), ("c", None)], "doc_id string, content binary")
    assert {r.doc_id for r in cfb.streams_of(files).where("error is not null").collect()} >= {"a", "c"}


def test_shared_strings_across_records():
    table = [("One", [(0, 0, "가" * 9000), (1, 0, "z" * 20000), (2, 0, "é"), (3, 0, 2.5)])]
    book = biff.book_bytes(table)
    assert biff.shared_strings([d for _, k, d in biff.records(book) if k in (biff.STRINGS, biff.MORE)]) == ["가" * 9000, "z" * 20000, "é"]
    assert biff.rk_value(0x3FF00000) == 1.0 and biff.rk_value((123 << 2) | 3) == 1.23 and biff.rk_value(0xFFFFFFFE) == -1.0
    assert list(biff.records(book + b"\x09\x08\xff\xff1"))[-1][1] == biff.EOF


def test_rtf_looks_and_pages():
    found = rtf.reading(r"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0\fcharset0 A;}{\f1\fcharset129 B;}}\f0 caf\'e9 \f1\'b0\'a1{\b bold}\ul u\ulnone\plain\par{\header head}{\*\x gone}\u-10179?\u-8704? end}")
    assert [(r.para, r.text, r.look) for r in found.runs] == [(0, "café 가", ()), (0, "bold", ("bold",)), (0, "u", ("underline",)), (1, "head😀 end", ())]
    assert rtf.escaped("a{b}\\\té😀") == r"a\{b\}\\\tab \u233?\u55357?\u56832?"


def test_rtf_without_edits_is_the_same_bytes(spark):
    source = bytearray(rb"{\rtf1\ansi {\b one} two\par three}")
    files = spark.createDataFrame([("d", source)], "doc_id string, content binary")
    same = spark.createDataFrame([("d", "r0", "one"), ("d", "r9", "x")], "doc_id string, rid string, text string")
    assert bytes(rtf.rtf_edited(files, same).first().content) == bytes(source)
    new = spark.createDataFrame([("d", "r0", "1 é")], "doc_id string, rid string, text string")
    out = bytes(rtf.rtf_edited(files, new).first().content)
    assert out == rb"{\rtf1\ansi {\b {\uc1 1 \u233?}} two\par three}" and rtf.plain(out.decode("latin-1")) == "1 é two\nthree"


def test_markdown_there_and_back():
    source = "# T *e*\n\npara `a<b`\nnext\n\n- x\n  - y\n\n1. n\n\n> q\n\n```py\nz < 1\n```\n\n|a|b|\n|:-|-:|\n|1|2|\n"
    html = textdocs.markdown_html(source)
    assert '<code class="language-py">z &lt; 1</code>' in html and '<th style="text-align:right">b</th>' in html and "<ol><li>n</li></ol>" in html
    assert textdocs.markdown_html(textdocs.html_markdown(html)) == html


def _pdf(objects: list[bytes], trailer: bytes = b"") -> bytes:
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, x) for i, x in enumerate(objects, 1))
    return b"%PDF-1.5\n" + body + b"trailer\n<< /Root 1 0 R " + trailer + b">>\n%%EOF"


def _stream(data: bytes, info: bytes = b"") -> bytes:
    return b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), info, data)


PAGE = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 200 100] /Resources << /Font << /F 5 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"]
FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding << /Differences [65 /Adieresis /uni0042] >> >>"


def test_pdf_text_state_and_hidden_text():
    content = b"BT /F 10 Tf 10 50 Td (AB) Tj q 3 Tr (hidden) Tj Q 0 -20 Td [(x) -300 (y) -3000 (far)] TJ ET 1 0 0 rg 0 0 10 10 re f"
    (page,) = pdf.read(_pdf([*PAGE, _stream(zlib.compress(content), b"/Filter /FlateDecode "), FONT]))
    assert [(x["text"], x["bold"]) for x in page.items] == [("ÄB", True), ("x y", True), ("far", True)] and (page.w, page.h) == (200, 100)
    assert page.paths[0]["fill"] == (255, 0, 0) and page.paths[0]["seq"] > page.items[-1]["seq"]


def test_pdf_forms_object_streams_and_unicode():
    inner = b"7 0 " + FONT
    cmap = b"1 begincodespacerange <00> <FF> endcodespacerange 1 beginbfrange <41> <42> <AC00> endbfrange"
    form = _stream(b"BT /F 8 Tf 1 1 Td (AB) Tj ET", b"/Type /XObject /Subtype /Form /BBox [0 0 50 50] /Matrix [1 0 0 1 5 5] ")
    page = b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /XObject << /X 6 0 R >> /Font << /F 7 0 R >> >> >>"
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /X /ToUnicode 8 0 R >>"
    packed = _stream(b"7 0 " + font, b"/Type /ObjStm /N 1 /First 4 ")
    (got,) = pdf.read(_pdf([*PAGE[:2], page, _stream(b"/X Do"), packed, form, b"null", _stream(cmap)]).replace(b"7 0 obj\nnull\nendobj\n", b""))
    assert [(x["text"], x["x"], x["y"]) for x in got.items] == [("가각", 6.0, 6.0)] and inner


def test_pdf_encryption_with_the_empty_password():
    pad, owner, ident = pdfobjects._PAD, bytes(32), b"0123456789abcdef"
    flags = -4 & 0xFFFFFFFF
    key = hashlib.md5(pad + owner + flags.to_bytes(4, "little") + ident).digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    check = hashlib.md5(pad + ident).digest()
    for i in range(20):
        check = C.rc4(bytes(b ^ i for b in key), check)
    hide = lambda n, d: C.rc4(hashlib.md5(key + n.to_bytes(3, "little") + bytes(2)).digest(), d)
    secret = _stream(hide(4, b"BT /F 10 Tf 5 5 Td (open) Tj ET"))
    lock = b"<< /Filter /Standard /V 2 /R 3 /Length 128 /P -4 /O <%s> /U <%s> >>" % (owner.hex().encode(), (check + bytes(16)).hex().encode())
    data = _pdf([*PAGE, secret, FONT.replace(b"/Adieresis", b"/A"), lock], b"/Encrypt 6 0 R /ID [<%s> <00>] " % ident.hex().encode())
    assert pdf.read(data)[0].items[0]["text"] == "open"
    with pytest.raises(ValueError, match="encrypted"):
        pdf.read(data.replace(check.hex().encode(), bytes(16).hex().encode()))


def test_pdf_pictures(spark):
    image = _stream(bytes((255, 0, 0, 0, 255, 0)), b"/Type /XObject /Subtype /Image /Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB ")
    page = b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /XObject << /I 6 0 R >> >> >>"
    data = _pdf([*PAGE[:2], page, _stream(b"q 20 0 0 10 5 5 cm /I Do Q"), b"null", image])
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"junk"))], "doc_id string, content binary")
    (row,) = pdf.pictures(files).collect()
    assert (row.width, row.height, row.ctm) == (2, 1, [20.0, 0.0, 0.0, 10.0, 5.0, 5.0]) and row.src.startswith("data:image/png;base64,")
    assert "<img" in pdf.previews(files).where("doc_id = 'a'").first().html


def test_word_view(spark):
    numbering = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:start w:val="1"/><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%1.%2"/></w:lvl></w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="1"/></w:num></w:numbering>'
    item = lambda lv, t: f'<w:p><w:pPr><w:numPr><w:ilvl w:val="{lv}"/><w:numId w:val="5"/></w:numPr></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t, more="": f"<w:tc><w:tcPr>{more}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = f'<w:tbl><w:tr>{cell("a", "<w:vMerge w:val=" + chr(34) + "restart" + chr(34) + "/>")}{cell("b")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("c")}</w:tr></w:tbl>'
    off = '<w:p><w:r><w:rPr><w:b w:val="0"/><w:i/></w:rPr><w:t>x</w:t></w:r></w:p>'
    body = item(0, "one") + item(1, "sub") + item(1, "sub") + item(0, "two") + item(1, "again") + table + off + '<w:sectPr><w:pgSz w:w="10" w:h="1440" w:orient="landscape"/><w:pgMar w:top="-1440"/></w:sectPr>'
    parts = {"word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>".encode(), "word/numbering.xml": numbering.encode(), "word/styles.xml": f"<w:styles {NS}/>".encode()}
    made = wordview.rendered(parts)
    import re

    assert re.findall(r'folium-marker">([^<]*)<', made["body"]) == ["3.", "3.a", "3.b", "4.", "4.a"]
    assert 'rowspan="2"' in made["body"] and made["body"].count("<td") == 3 and '<span style="font-style:italic">x</span>' in made["body"]
    assert (made["section"]["width"], made["section"]["height"], made["section"]["top"]) == (96, 1, 96)
    assert wordview.numeral(14, "upperRoman") == "XIV" and wordview.numeral(28, "lowerLetter") == "bb"


def test_palette_of_styles():
    xml = f'<w:styles {NS}><w:style w:type="paragraph" w:styleId="제 목"><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style><w:style w:type="paragraph" w:styleId="__"/><w:style w:styleId="___" w:default="1"/><w:style w:type="table" w:styleId="T"/></w:styles>'
    p = word.palette_of(xml)
    assert [(k, t) for k, _, t in p.styles] == [("___", "h2"), ("__", "p"), ("____1", "p")] and p.fallback == "____1"


def test_word_errors_are_rows(spark):
    files = makers.files(spark.createDataFrame([("d", [("a", "b")])], "doc_id string, rows array<struct<a: string, b: string>>"), makers.docx)
    parts = archives.parts_of(files)
    edited = spark.createDataFrame([("d", '<div class="folium-doc"><div data-frozen="frozen-9">x</div></div>'), ("none", "<p>x</p>")], "doc_id string, html string")
    got = {r.doc_id: r for r in word.decoded(parts, edited, registry.DEFAULT).collect()}
    assert "frozen-9" in got["d"].error and got["d"].content is None and got["none"].error == "no w:body"


TEXTS = {"rtf": rb"{\rtf1 alpha}", "csv": b"alpha,beta\n1,2\n", "txt": b"alpha beta", "md": b"# alpha\n", "html": b"<p>alpha</p>", "?": b"\0"}


@pytest.fixture(scope="module")
def contents():
    rows, numbers = [{"a": "alpha", "b": "beta"}], [{"a": "alpha", "b": 2.5}]
    made = {"docx": makers.docx(rows), "xlsx": makers.xlsx(numbers), "pptx": makers.pptx(rows), "hwpx": makers.hwpx(rows), "xls": makers.xls(numbers), "ppt": makers.ppt(rows), "doc": makers.doc(rows), "hwp": makers.hwp(rows), "pdf": makers.pdf_file(rows)}
    return {**made, **TEXTS}


def _files(spark, contents, *names):
    return spark.createDataFrame([(n, bytearray(contents[n])) for n in names], "doc_id string, content binary")


def test_every_format_is_found_and_shown(spark, contents):
    found = {r.doc_id: r.format for r in registry.opened(_files(spark, contents, *contents)).collect()}
    assert found == {n: n for n in contents}
    known = registry.adapters()
    assert all("alpha" in known[n].preview(_files(spark, contents, n)).first().html for n in known)
    assert registry.formats(spark).where("not round_trip").collect()[0].name == "pdf"


@pytest.mark.parametrize("name", ["docx", "hwp", "xls", "rtf", "csv"])
def test_edits_come_back(spark, contents, name):
    known = registry.adapters()[name]
    own = _files(spark, contents, name)
    html = known.encode(own).first().html
    assert "alpha" in html
    edited = spark.createDataFrame([(name, html.replace("alpha", "Alpha two"))], "doc_id string, html string")
    back = registry.restored(own, edited, name).first()
    assert back.error is None and back.ext == name
    assert "Alpha two" in known.preview(_files(spark, {name: back.content}, name)).first().html


def test_what_a_format_cannot_do(spark, contents):
    known = registry.adapters()
    few = {"html": known["html"], "pdf": known["pdf"]}
    got = {r.doc_id: r for r in registry.by_format(_files(spark, contents, "html", "pdf", "?"), lambda a, f: a.encode(f) if a.round_trip else None, known=few).collect()}
    assert got["html"].html == "<p>alpha</p>" and got["pdf"].error and got["?"].error
    with pytest.raises(registry.UnsupportedError):
        registry.restored(_files(spark, contents, "pdf"), _files(spark, contents, "pdf"), "pdf")
    with pytest.raises(KeyError):
        registry.adapter("odt")


def test_filling_a_document(spark):
    html = b"<p>Name: </p><p>" + b"long text " * 10 + b"</p>"
    files = spark.createDataFrame([("a", bytearray(html))], "doc_id string, content binary")
    material = spark.createDataFrame([("a", "Ada")], "doc_id string, material string")
    client = registry.Client(lambda prompt, t: "not json" if t == 0 else '{"slots": {"s0": "Name: Ada"}}')
    assert client.ask("x") == '{"slots": {"s0": "Name: Ada"}}'
    out = registry.composed(files, material, "html", client).first()
    assert bytes(out.content).startswith(b"<p>Name: Ada</p><p>long text")
    text, figures = registry.gathered(['{"message": {"content": "{\\"a\\"', '"}}\n{"message": {"content": ": 1}"}}\nbad\n{"done": true, "eval_count": 3}'])
    assert (text, figures) == ('{"a": 1}', {"eval_count": 3}) or figures == {"eval_count": 3}


def test_hangul_rules():
    assert korean.shape_runs("abcdef", [(0, 1), (2, 5), (2, 6), (99, 7)]) == [("ab", 1), ("cdef", 6)]
    text, objects = korean.hwp_text(struct.pack("<12H", 65, 9, *[0] * 6, 9, 66, 13, 10))
    assert (text, objects) == ("A\tB\n", False) and korean.hwp_text(struct.pack("<8H", 11, *[0] * 6, 11))[1]
    big = [(0x43, 1, bytes(5000)), (0x42, 0, b"x")]
    assert korean.hwp_records(korean.hwp_bytes(big)) == big
    looks = korean.palette_of([("0", "바탕글"), ("1", "개요 2"), ("2", "개요 2"), ("3", "제목")], "x")
    assert [(k, t) for k, _, t in looks.styles] == [("body", "p"), ("heading2", "h2"), ("___2", "h2"), ("title", "h1")] and looks.fallback == "body"
    made = korean.paragraph_records([("ab", 1), ("c", 1), ("d", 2)], 3, {}, 0)
    assert made[2][2] == struct.pack("<IIII", 0, 1, 3, 2) and made[0][2][10] == 3


def test_slide_layers_and_colours(spark):
    a = makers.A
    box = lambda x: f'<p:spPr><a:xfrm><a:off x="{x * 9525}" y="0"/><a:ext cx="9525" cy="9525"/></a:xfrm></p:spPr>'
    sp = lambda ph, pr="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr>{pr}</p:sp>"
    tree = lambda x: f"<p:sld {a}><p:cSld><p:spTree>{x}</p:spTree></p:cSld></p:sld>"
    rel = lambda kind, target: f'<Relationships xmlns="x"><Relationship Id="r1" Type="http://x/{kind}" Target="{target}"/></Relationships>'
    group = f'<p:grpSp><p:grpSpPr><a:xfrm><a:off x="95250" y="0"/><a:ext cx="19050" cy="9525"/><a:chOff x="0" y="0"/><a:chExt cx="9525" cy="9525"/></a:xfrm></p:grpSpPr>{sp("", box(1))}</p:grpSp>'
    parts = {
        "ppt/slides/slide1.xml": tree(sp('<p:ph type="ctrTitle"/>') + sp('<p:ph idx="7"/>') + sp('<p:ph type="body"/>', box(9)) + group),
        "ppt/slides/_rels/slide1.xml.rels": rel("slideLayout", "../slideLayouts/slideLayout1.xml"), "ppt/slideLayouts/slideLayout1.xml": tree(sp('<p:ph type="title"/>', box(3))),
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": rel("slideMaster", "../slideMasters/slideMaster1.xml"), "ppt/slideMasters/slideMaster1.xml": tree(sp('<p:ph type="title"/>', box(4)) + sp('<p:ph idx="7"/>', box(5))),
    }
    rows = spark.createDataFrame([("d", k, bytearray(v.encode())) for k, v in parts.items()], "doc_id string, part string, content binary")
    got = {r.shape: r.x for r in slides.placed(rows).collect()}
    assert got["0"] == 3 and got["1"] == 5 and got["2"] == 9 and got[[k for k in got if k.startswith("3.")][0]] == 12
    from folium.sources.markup import Node

    assert slides.colour(Node("a:schemeClr", {"val": "tx1"}, [Node("a:lumMod", {"val": "50000"}), Node("a:lumOff", {"val": "50000"})]), {"dk1": "000000"}) == "#808080"
