from pyspark.sql import functions as F

from folium.functions import detect as D
from folium.functions import grid as G
from folium.functions import text as T
from folium.sources.csvfile import parsed


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_text_formats(spark):
    cases = {"<!doctype html><p>": "html", "  <DIV class=x>": "html", "# Title": "md", "- item": "md", "a,b\n1,2": "csv", "Hello, all. No table, here,\nor there": "txt", "": "txt", 'x;"a;b"\ny;c': "csv"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", D.text_format(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_containers(spark):
    b = lambda x: F.lit(bytearray(x))
    assert list(one(spark, D.container(b(b"PK\3\4")), D.container(b(b"x%PDF-1.4")), D.container(b(b"abc")), D.container(b(b"a\0b")), D.container(b(b"")), D.is_rtf(b(b"\xef\xbb\xbf {\\rtf1")))) == ["zip", "pdf", "text", "unknown", "unknown", True]


def test_zip_and_cfb_formats(spark):
    m = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    got = one(spark, D.zip_format(m({"mimetype": "application/hwp+zip"})), D.zip_format(m({"[Content_Types].xml": "x spreadsheetml.sheet.main"})), D.zip_format(m({"ppt/a": ""})), D.cfb_format(F.array(F.lit("Workbook"))))
    assert list(got) == ["hwpx", "xlsx", "pptx", "xls"]


def test_entities_and_symbols(spark):
    got = one(spark, T.visible(F.lit("<p>a&amp;lt;b &#65;&#x1F600; &nope; &#0;</p><script>x</script>")), T.symbols(F.lit("a①é×漢★")), T.sanitize_inline(F.lit("a<b>\n<strong>x</strong><br>")))
    assert got[0].split() == ["a&lt;b", "A😀", "&nope;"]
    assert got[1] == ["①", "×", "★"]
    assert got[2] == "a&lt;b&gt;<br/><strong>x</strong><br/>"


def test_txt_round_trip(spark):
    for text in ("a\nb", "a\n\nb\n", "﻿a\r\nb", " x  y "):
        t = F.lit(text)
        eol = F.when(T.crlf(t), "\r\n").otherwise("\n")
        assert one(spark, T.txt_decode(T.txt_encode(t), eol, t.startswith(T.BOM)))[0] == text


def test_edited_txt(spark):
    cases = {
        '<p class="txt-line" style="x">a &amp; b</p>\n<p id="k" class="new txt-line">c<br>\nd</p>': "a & b\nc\nd", "<p>a</p><div>b&nbsp;<b>c</b></div>": "a\nb\xa0c",
        "<div>x<div>y</div></div>": "xy\ny", "just <b>text</b> &lt;here&gt;": "just text <here>", '<p class="txt-line">in</p><p>out</p>': "in", '<p class="txt-line"></p>': "", "": "",
    }
    got = spark.createDataFrame([(k,) for k in cases], "h string").select("h", T.txt_decode(F.col("h"), F.lit("\n"), F.lit(False))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_html_encode(spark):
    got = one(spark, T.html_encode(F.lit("\ufeff<html><body class=x>\n<p>a</p></body></html>")), T.html_encode(F.lit("<p>b</p>")), T.html_encode(F.lit("<html><body> \n</body></html>")))
    assert list(got) == ["\n<p>a</p>", "<p>b</p>", ""]


def test_csv():
    assert parsed('a,"b,""c\nd"e,\r\nx\n', ",") == [["a", 'b,"c\nde', ""], ["x"]]
    assert parsed("", ",") == [] and parsed(None, ",") == [] and parsed('""', ",") == []
    assert parsed("a;b\r\rc", ";") == [["a", "b"], [""], ["c"]]


def test_csv_expressions(spark):
    got = one(spark, T.sniff_delimiter(F.lit('a;"b,c,d"\nx,y,z,q')), T.csv_text(F.array(F.array(F.lit('a"b'), F.lit("c")))), T.csv_grid_html(F.array(F.array(F.lit("<x>\ny")))))
    assert list(got) == [",", '"a""b",c', '<table class="csv-grid"><tr><td>&lt;x&gt;<br>y</td></tr></table>']


def test_grid(spark):
    got = one(spark, G.a1(F.lit(0), F.lit(702)), G.a1_col(F.lit("AAA10")), G.a1_row(F.lit("AAA10")), G.a1_col(F.lit("??")), G.number_text(F.lit(0.1) + F.lit(0.2)), G.number_text(F.lit(float("nan"))), G.tint(F.lit("000000"), F.lit(0.5)), G.resolve_path(F.lit("ppt/slides/slide1.xml"), F.lit("../media/x.png")), G.rk_number(F.lit(0x3FF00000)))
    assert list(got) == ["AAA1", 702, 9, 0, "0.3", "", "808080", "ppt/media/x.png", 1.0]
