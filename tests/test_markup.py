import pytest
from pyspark.sql import functions as F

from folium.operators import forms, palette
from folium.sources import markup


def test_tolerant_html():
    root = markup.parse_html("<ul><li>a<li>b <b>c</ul><p>x<p>y<table><tr><td>1<td>2<tr><td>3</table></span>z&amp;&nbsp;")
    assert markup.write(root) == "<ul><li>a</li><li>b <b>c</b></li></ul><p>x</p><p>y</p><table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>z&amp;\xa0"


@pytest.mark.parametrize(
    ("html", "want", "removed", "stripped"),
    [
        ('<p style="color:red">a</p>', '<p class="s-body">a</p>', [], 1),
        ("<p>a<script>x</script></p>", '<p class="s-body">a</p>', ["script"], 0),
        ("<p>a <b>b</b> <i>i</i> <strike>s</strike></p>", '<p class="s-body">a <strong>b</strong> <em>i</em> <s>s</s></p>', [], 0),
        ("<ul><li>one</li><li>two</li></ul>", '<li class="s-listItem">one</li>\n<li class="s-listItem">two</li>', [], 0),
        ("<p>open <strong>never closed", '<p class="s-body">open <strong>never closed</strong></p>', [], 0),
        ("<section><section><h2>in</h2></section></section>", '<h2 class="s-heading2">in</h2>', [], 0),
        ("<script>kept text</script>", '<p class="s-body">kept text</p>', ["script"], 0),
        ("", "", [], 0),
    ],
)
def test_normalise(html, want, removed, stripped):
    out = palette.normalise(html)
    assert out == (f'<div class="folium-doc" data-palette="default-v0">\n{want}\n</div>', removed, stripped, [])


def test_normalise_keeps_its_own_output():
    once = palette.normalise('<h1 class="s-title" data-pp="pp-1">T</h1><p>a<br>b</p><table data-table="t"><tr><td data-cell="t:0:0">x</td></tr></table>')[0]
    assert palette.normalise(once)[0] == once


def test_broken_xml_is_a_row(spark):
    docs = spark.createDataFrame([("a", "<x><y>1</y></x>"), ("b", "<x>"), ("c", None)], "doc_id string, xml string")
    rows = markup.xml_nodes(docs).collect()
    assert [r.tag for r in rows if r.doc_id == "a"] == ["x", "y", "#text"] and [r.error is not None for r in rows if r.doc_id == "b"] == [True]
    assert markup.written(markup.xml_nodes(docs)).where("doc_id = 'a'").first().markup == "<x><y>1</y></x>"


def test_groups_shrink_and_partial_fills(spark):
    html = "<ul><li>a</li><li>b</li><li>c</li><li>d</li></ul><p>keep</p><p>go</p>"
    docs = spark.createDataFrame([("a", html)], "doc_id string, html string")
    own = forms.slots(markup.html_nodes(docs))
    reply = spark.createDataFrame([("a", '{"slots": {"s0": "not used", "s5": "<em>new</em> <x>"}, "groups": {"g0": ["1", "2"]}}')], "doc_id string, reply string")
    out = forms.filled(docs, "html", own, forms.answers(reply)).first().markup
    assert out == "<ul><li>1</li><li>2</li><li/><li/></ul><p>keep</p><p><em>new</em> &lt;x&gt;</p>"
    bad = spark.createDataFrame([("a", "no json"), ("b", None)], "doc_id string, reply string")
    assert forms.answers(bad).count() == 0
    with pytest.raises(Exception, match="schema"):
        forms.answers(bad, strict=True).collect()


def test_inherited_follows_long_chains(spark):
    from folium.operators import joins

    styles = spark.createDataFrame([(i, i + 1 if i < 59 else 0, 12 if i == 59 else None) for i in range(60)], "style_id int, based_on int, size int")
    assert joins.inherited(spark, styles, ["size"]).where(F.col("size") == 12).count() == 60
