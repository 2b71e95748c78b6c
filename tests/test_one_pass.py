"""What is found in one pass over a document, against the same stated another way, on odd documents."""

import random

from pyspark.sql import functions as F

from folium.operators import forms
from folium.sources import markup

TABLES = '<table data-table="t0"><tr><td>Name</td><td colspan="x">Seg<b>ment</b></td></tr><tr><td>a</td><td> 　</td></tr><tr><td><table><tr><th>in</th><td>:</td></tr></table></td><td data-cell="c" data-ro>z</td></tr></table>'
ODD = [
    "", "plain", "<li>a</li><li>b</li><li>c</li>", "<ul><li>a<li>b<p>in</p><li>c<li>d<li>e</ul><ol><li>x<li>y</ol><ul><li>1<li>2<li>3<br>4</ul>", TABLES,
    '<p><span data-frozen-run="f">x</span></p><div data-frozen="d"><p data-run="r">k</p></div><p data-run="r"><i data-run="q">two</i>: </p><h3>Label： </h3>',
]


def made(seed):
    r = random.Random(seed)
    tags = ["p", "li", "ul", "table", "tr", "td", "th", "div", "b", "br"]
    marks = ["", "", "", ' data-cell="c"', ' data-cell="c" data-ro', ' data-run="r"', ' data-frozen="f"', ' colspan="3"', ' data-table="t"']
    return "".join(r.choice((f"<{r.choice(tags)}{r.choice(marks)}>", f"</{r.choice(tags)}>", r.choice(("a", "", " ", "b:")))) for _ in range(60))


def test_slots_are_those_of_the_relation(spark):
    docs = spark.createDataFrame(list(enumerate([*ODD, *map(made, range(60))])), "doc_id long, html string")
    columns = ["doc_id", "slot", "slot_id", "node", "parent", "path", "tag", "kind", "role", "text"]
    of = lambda frame: sorted((tuple(map(str, r)) for r in frame.select(*columns).collect()))
    form, nodes = forms.read(docs), markup.html_nodes(docs)
    assert of(forms.slots_in(form)) == of(forms.slots(nodes))
    groups = lambda frame: sorted((tuple(map(str, r)) for r in frame.select("doc_id", "group_id", "members", "texts").collect()))
    assert groups(forms.groups_in(form)) == groups(forms.groups(forms.slots(nodes))) != []


def test_labels_and_tables(spark):
    form = forms.read(spark.createDataFrame([(0, TABLES)], "doc_id long, html string"))
    assert [tuple(r) for r in forms.repeat_tables(form).select("ref", "heads").collect()] == [("t0", ["Name", "Segment"])]
    told = [(r.text, r.label, r.is_label, r.in_table, r.send) for r in forms.fields(form).orderBy("slot").collect()]
    assert told == [("Name", "Name", True, False, False), ("a", "Name", False, True, False), (" 　", "Segment", False, True, False), ("in", "in", True, True, False), (":", "in", False, True, False), ("z", "Segment", False, True, False)]


def test_filled_as_planned_by_joins(spark):
    docs = spark.createDataFrame(list(enumerate([*ODD, *map(made, range(30))])), "doc_id long, html string").select(F.col("doc_id").cast("string").alias("doc_id"), "html")
    reply = '{"slots": {"s0": "<em>n</em> & <x>\\nq", "s2": "two", "s77": "no"}, "groups": {"g0": ["1", null, "<b>3"], "g1": ["a", "b", "c", "d", "e"], "g9": ["z"]}, "tables": {"t": [["r"], ["s", "t"]], "t0": [["x"]]}}'
    given = forms.answers(docs.where("doc_id <> '3'").select("doc_id", F.lit(reply).alias("reply")))
    of = lambda frame: sorted(map(tuple, frame.select("doc_id", "markup").collect()))
    assert of(forms.filled_in(docs, "html", given)) == of(forms.filled(docs, "html", forms.slots(markup.html_nodes(docs)), given))


def test_forms_are_read_once(spark, sf_dir):
    from folium.plans import catalog

    for name in ("form_slots", "form_fields", "form_groups", "form_tables", "form_filled", "form_prompts", "form_counts"):
        assert catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1, name
