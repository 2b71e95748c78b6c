"""Forms: the slots of a document's markup, what they are called, and filling them.

A slot is a node that may take a new text: an element that carries an edit id, a table cell of nothing but text, or a paragraph,
heading or list item that holds neither a frozen element nor another slot. The walk from the root goes no further at the first such
node, nor into a frozen one, so a slot is a stop without a stop above it. Slots are numbered in document order; ids are s0, s1, ...
and of repeat groups g0, g1, ...

read() finds slots, labels, groups and tables of a document in one pass over its tree; a document's rows never leave its task. slots()
states the same over a relation of nodes.
"""

from __future__ import annotations

import copy
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.detect import SPACE
from folium.functions.text import is_fill_field, sanitize_inline, self_label
from folium.sources.markup import TEXT, Node, parse_html, parse_xml, rewritten, write
from folium.sources.tables import by_row

#: The tags of blocks and cells, and the attributes that name a text to edit.
BLOCK_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li")
CELL_TAGS = ("td", "th")
EDIT_IDS = ("data-run", "data-atom", "data-piece")
FROZEN = ("data-frozen-run", "data-frozen")
#: Fixed value: list items in a row that make a group.
GROUP = 3


def has(name: str) -> Column:
    return F.map_contains_key("attrs", F.lit(name))


def any_of(tests: list[Column]) -> Column:
    out = tests[0]
    for x in tests[1:]:
        out = out | x
    return out


def edit_leaf() -> Column:
    """A cell with an id that is not read-only, or an element with another edit id."""
    return F.when(has("data-cell"), ~has("data-ro")).otherwise(any_of([has(x) for x in EDIT_IDS]))


def frozen_self() -> Column:
    return any_of([has(x) for x in FROZEN])


def role() -> Column:
    """Of a block by its tag; of a leaf by whether it is a cell."""
    block = F.when(F.rlike("tag", F.lit("^h[1-6]$")), "heading").when(F.col("tag") == "li", "listItem").otherwise("body")
    return F.when(F.col("kind") == "block", block).when(has("data-cell") | F.col("tag").isin(*CELL_TAGS), "cell").otherwise("body")


def marked(nodes: DataFrame) -> DataFrame:
    """Elements with leaf, frozen, cell (a cell without elements), holds_frozen and holds_slot (something below that is or could be one)."""
    elements = nodes.where((F.col("tag") != TEXT) & F.col("error").isNull())
    parents = elements.where("parent is not null").select("doc_id", F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    base = elements.join(parents, ["doc_id", "node"], "left").withColumn("leaf", edit_leaf()).withColumn("frozen", frozen_self())
    base = base.withColumn("cell", F.col("tag").isin(*CELL_TAGS) & F.col("inner").isNull()).drop("inner")
    stops = F.col("leaf") | F.col("cell") | F.col("tag").isin(*BLOCK_TAGS)
    above = base.where(F.col("frozen") | stops).select("doc_id", "frozen", stops.alias("stops"), F.explode("path").alias("node"))
    above = above.groupBy("doc_id", "node").agg(F.max("frozen").alias("holds_frozen"), F.max("stops").alias("holds_slot"))
    no = F.lit(False)
    return base.join(above, ["doc_id", "node"], "left").withColumns({"holds_frozen": F.coalesce("holds_frozen", no), "holds_slot": F.coalesce("holds_slot", no)})


def slots(nodes: DataFrame) -> DataFrame:
    """doc_id, slot (from 0), slot_id, node, parent, path, tag, attrs, kind (leaf or block), role, text."""
    all_ = marked(nodes)
    block = F.col("tag").isin(*BLOCK_TAGS) & ~F.col("frozen") & ~F.col("holds_frozen") & ~F.col("holds_slot")
    kind = F.when(F.col("frozen"), F.lit("frozen")).when(F.col("leaf") | F.col("cell"), F.lit("leaf")).when(block, F.lit("block"))
    stops = all_.withColumn("kind", kind).where("kind is not null")
    over = stops.select("doc_id", F.col("node").alias("owner"))
    hidden = stops.select("doc_id", "node", F.explode("path").alias("owner")).join(over, ["doc_id", "owner"], "left_semi").select("doc_id", "node").distinct()
    found = stops.where("kind <> 'frozen'").join(hidden, ["doc_id", "node"], "left_anti")
    order = Window.partitionBy("doc_id").orderBy("node")
    found = found.withColumn("slot", F.row_number().over(order) - 1).withColumn("role", role())
    text = slot_text(nodes, found)
    found = found.drop("text").join(text, ["doc_id", "node"])
    return found.select("doc_id", "slot", F.concat(F.lit("s"), F.col("slot").cast("string")).alias("slot_id"), "node", "parent", "path", "tag", "attrs", "kind", "role", "text")


def slot_text(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, node, text: all text of a leaf; of a block, with line breaks. (A block that is a slot holds nothing frozen.)"""
    below = nodes.where((F.col("tag") == TEXT) | (F.col("tag") == "br")).withColumn("owner", F.explode("path"))
    below = below.join(found.select("doc_id", F.col("node").alias("owner"), "kind"), ["doc_id", "owner"])
    piece = F.when(F.col("tag") == TEXT, F.col("text")).when(F.col("kind") == "block", F.lit("\n")).otherwise("")
    parts = below.groupBy("doc_id", F.col("owner").alias("node")).agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("at"), piece.alias("t")))).alias("x"))
    return found.select("doc_id", "node").join(parts, ["doc_id", "node"], "left").select("doc_id", "node", F.coalesce(F.array_join("x.t", ""), F.lit("")).alias("text"))


def groups(found: DataFrame) -> DataFrame:
    """Repeat groups: runs of GROUP or more list items that follow each other as slots of one parent.

    found: slots(); gives doc_id, group_id, members (slot numbers, ascending), texts.
    """
    order = Window.partitionBy("doc_id").orderBy("slot")
    item = (F.col("kind") == "block") & (F.col("role") == "listItem")
    before = lambda c: F.lag(c).over(order)
    new = ~F.coalesce(item & before(item) & (F.col("parent") == before("parent")) & (F.col("tag") == before("tag")), F.lit(False))
    runs = found.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(order)).where(item)
    runs = runs.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("slot", "text"))).alias("m")).where(F.size("m") >= GROUP)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("run")) - 1
    return runs.select("doc_id", F.concat(F.lit("g"), place.cast("string")).alias("group_id"), F.col("m.slot").alias("members"), F.col("m.text").alias("texts"))


# One pass over a document's tree.

_BLANKS = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{SPACE}]", c))
SLOT = "slot int, slot_id string, node int, parent int, path array<int>, tag string, attrs map<string, string>, kind string, role string, text string, label string, is_label boolean, in_table boolean, group_id string"
TABLE = "table int, ref string, heads array<string>"
_READ = f"doc_id string, slots array<struct<{SLOT}>>, tables array<struct<{TABLE}>>"


def _span(text: str | None) -> int:
    """A colspan as a number; 1 for none, 0 and what is no whole number."""
    own = (text or "").strip("".join(map(chr, range(33))))
    n = int(own) if re.fullmatch(r"[+-]?[0-9]+", own) else 1
    return n if n and -(2**31) <= n < 2**31 else 1


def form_of(root: Node) -> tuple[list[dict], list[dict]]:
    """Slots and repeat tables of a document, as dicts of SLOT and TABLE."""
    nodes, parent, path = [], [], []
    waiting = [(x, None, ()) for x in reversed(root.children)]
    while waiting:
        x, up, above = waiting.pop()
        at = len(nodes)
        nodes.append(x)
        parent.append(up)
        path.append(above)
        if x.children:
            below = (*above, at)
            waiting.extend((c, at, below) for c in reversed(x.children))
    held = [0] * len(nodes)  # 1: something frozen below, 2: something that is or could be a slot, 4: an element
    looks = [0] * len(nodes)  # the same of the node itself, 8: an edit leaf or a cell of nothing but text
    for at in range(len(nodes) - 1, -1, -1):
        x = nodes[at]
        if x.tag == TEXT:
            continue
        leaf = "data-ro" not in x.attrs if "data-cell" in x.attrs else any(k in x.attrs for k in EDIT_IDS)
        cell = x.tag in CELL_TAGS and not held[at] & 4
        looks[at] = (1 if any(k in x.attrs for k in FROZEN) else 0) | (8 if leaf or cell else 0) | (2 if leaf or cell or x.tag in BLOCK_TAGS else 0)
        if parent[at] is not None:
            held[parent[at]] |= held[at] | looks[at] & 3 | 4
    labels, again, tables = _tables(nodes, parent, path)
    out: list[dict] = []
    over = -1  # the last node below a stop: a node's descendants follow it
    ends = list(range(len(nodes)))
    for at in range(len(nodes) - 1, -1, -1):
        if parent[at] is not None:
            ends[parent[at]] = max(ends[parent[at]], ends[at])
    for at, x in enumerate(nodes):
        if at <= over or x.tag == TEXT:
            continue
        block = x.tag in BLOCK_TAGS and not held[at] & 3
        kind = "frozen" if looks[at] & 1 else "leaf" if looks[at] & 8 else "block" if block else None
        if kind is None:
            continue
        over = ends[at]
        if kind == "frozen":
            continue
        if kind == "block":
            role_ = "heading" if x.tag[0] == "h" else "listItem" if x.tag == "li" else "body"
        else:
            role_ = "cell" if "data-cell" in x.attrs or x.tag in CELL_TAGS else "body"
        text = "".join(y.text if y.tag == TEXT else "\n" for y in nodes[at + 1 : ends[at] + 1] if y.tag == TEXT or y.tag == "br" and kind == "block")
        label, is_label = labels.get(at, (None, None))
        n = len(out)
        out.append({"slot": n, "slot_id": f"s{n}", "node": at, "parent": parent[at], "path": list(path[at]), "tag": x.tag, "attrs": list(x.attrs.items()), "kind": kind, "role": role_, "text": text, "label": label, "is_label": is_label, "in_table": at in again, "group_id": None})
    place, run = 0, []
    for x in [*out, None]:
        item = x is not None and x["kind"] == "block" and x["role"] == "listItem"
        if not (run and item and x["parent"] is not None and x["parent"] == run[-1]["parent"]):
            if len(run) >= GROUP:
                for y in run:
                    y["group_id"] = f"g{place}"
                place += 1
            run = []
        if item:
            run.append(x)
    return out, tables


def _tables(nodes: list[Node], parent: list, path: list[tuple]) -> tuple[dict, set, list[dict]]:
    """Labels of cells by node, the cells below the head of a repeat table, and these tables.

    A cell of an inner table belongs to every table around it, as its rows do; its label is that of the innermost. A table has a
    header if it has two rows or more, a first row without blanks and a blank below it.
    """
    rows: dict[int, list[int]] = {}
    cells: dict[int, list[int]] = {}
    for at, x in enumerate(nodes):
        if x.tag == "table":
            rows[at] = []
        elif x.tag == "tr":
            for up in path[at]:
                if up in rows:
                    rows[up].append(at)
        elif x.tag in CELL_TAGS and parent[at] is not None and nodes[parent[at]].tag == "tr":
            cells.setdefault(parent[at], []).append(at)
    texts = {at: nodes[at].deep().strip(_BLANKS) for own in cells.values() for at in own}
    labels: dict[int, tuple[str, bool]] = {}
    again: set[int] = set()
    tables = []
    for table, trs in rows.items():  # inner tables come after outer ones
        own = [[(at, texts[at]) for at in cells.get(tr, ())] for tr in trs]
        first = own[0] if own else []
        # The last row that holds a cell must come after the first.
        header = bool(first) and all(t for _, t in first) and any(not t for row in own[1:] for _, t in row)
        heads: dict[int, str] = {}
        for n, row in enumerate(own):
            col, before = 0, ""
            for at, t in row:
                if header:
                    if n == 0:
                        heads[col] = t
                    labels[at] = (t if n == 0 else heads.get(col, ""), n == 0)
                else:
                    labels[at] = (t if col % 2 == 0 else before, col % 2 == 0)
                before, col = t, col + _span(nodes[at].attrs.get("colspan"))
        if header and nodes[table].attrs.get("data-table") is not None:
            again.update(at for row in own[1:] for at, _ in row)
            tables.append({"table": table, "ref": nodes[table].attrs["data-table"], "heads": [t for _, t in first]})
    return labels, again, tables


def read(docs: DataFrame, html: str = "html") -> DataFrame:
    """doc_id, slots, tables of docs (doc_id, the column of markup): a row for each, with arrays of SLOT and TABLE."""
    make = lambda doc, text: ((doc, *form_of(parse_html(text or ""))),)
    return by_row(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(html).cast("string").alias("text")), make, _READ)


def slots_in(form: DataFrame) -> DataFrame:
    """slots() of read()."""
    return form.select("doc_id", F.inline("slots")).drop("label", "is_label", "in_table", "group_id")


def groups_in(form: DataFrame) -> DataFrame:
    """groups() of read()."""
    member = F.filter("slots", lambda x: x["group_id"].isNotNull())
    one = form.select("doc_id", member.alias("m")).select("doc_id", "m", F.explode(F.array_distinct("m.group_id")).alias("group_id"))
    one = one.select("doc_id", "group_id", F.filter("m", lambda x: x["group_id"] == F.col("group_id")).alias("m"))
    return one.select("doc_id", "group_id", F.col("m.slot").alias("members"), F.col("m.text").alias("texts"))


def repeat_tables(form: DataFrame) -> DataFrame:
    """doc_id, table, ref, heads of the tables with an id whose rows may be repeated: those with a header. form: read()."""
    return form.select("doc_id", F.inline("tables"))


def fields(form: DataFrame) -> DataFrame:
    """slots() with label, is_label, group_id, in_table (a data row of a repeat table) and send: whether a filler is asked for it. form: read()."""
    out = form.select("doc_id", F.inline("slots"))
    out = out.withColumns({"label": F.coalesce(F.nullif("label", F.lit("")), self_label(F.col("text"))), "is_label": F.coalesce("is_label", F.lit(False))})
    ask = is_fill_field(F.col("text"), F.col("label"))
    return out.withColumn("send", ~F.col("is_label") & F.col("group_id").isNull() & ~F.col("in_table") & ask)


def prompt(form: DataFrame, material: DataFrame, labelled: bool = True) -> DataFrame:
    """doc_id, prompt: what a filler is told, as JSON: the slots asked for, the groups, the repeat tables and the material.

    form: read(); material: doc_id, material. Plainly (not labelled), all slots outside groups are told, without labels.
    """
    label = lambda x: F.coalesce(F.nullif(x["label"], F.lit("")), self_label(x["text"]))
    send = lambda x: ~F.coalesce(x["is_label"], F.lit(False)) & x["group_id"].isNull() & ~x["in_table"] & is_fill_field(x["text"], label(x))
    form = form.select("doc_id", F.col("slots").alias("_s"), F.col("tables").alias("_t"))
    told = F.filter("_s", send if labelled else lambda x: x["group_id"].isNull())
    ask = F.transform(told, lambda x: F.struct(x["slot_id"].alias("id"), *([label(x).alias("label")] if labelled else []), x["role"].alias("role"), x["text"].alias("current")))
    member = F.filter("_s", lambda x: x["group_id"].isNotNull())
    names = F.array_sort(F.array_distinct(F.transform(member, lambda x: x["group_id"])))
    repeat = F.transform(names, lambda g: F.struct(g.alias("group_id"), F.transform(F.filter(member, lambda x: x["group_id"] == g), lambda x: x["text"]).alias("examples")))
    tables = F.transform("_t", lambda t: F.struct(t["ref"].alias("id"), t["heads"].alias("columns")))
    some = lambda x: F.when(F.size(x) > 0, x)
    every = form.select("doc_id", some(ask).alias("slots"), some(repeat).alias("groups"), some(tables).alias("tables"))
    return material.join(every, "doc_id", "left").select("doc_id", F.to_json(F.struct("slots", "groups", *(["tables"] if labelled else []), "material")).alias("prompt"))


ANSWER = "slots map<string, string>, groups map<string, array<string>>, tables map<string, array<array<string>>>"


def answers(replies: DataFrame, strict: bool = False) -> DataFrame:
    """doc_id, slots, groups, tables of replies (doc_id, reply: JSON). A reply of another shape is nothing, or with strict an error."""
    read = F.from_json("reply", ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = replies.select("doc_id", "reply", read.alias("a"))
    good = F.col("a.slots").isNotNull()
    if strict:
        good = good | F.raise_error(F.concat(F.lit("reply does not fit the schema: "), F.coalesce("reply", F.lit("null")))).isNotNull()
    return out.where(good).select("doc_id", "a.*")


def salvaged(reply: Column) -> Column:
    """Map of the complete "sN": "text" pairs of a reply that was cut off; the last of a repeated id counts; null if there is none."""
    pattern = r'"(s[0-9]+)"[ \t\r\n]*:[ \t\r\n]*("(?:[^"\\]|\\.)*")'
    names, values = (F.regexp_extract_all(reply, F.lit(pattern), F.lit(g)) for g in (1, 2))
    plain = F.transform(values, lambda v: F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v"), F.substring(v, F.lit(2), F.length(v) - 2)))
    last = F.transform(names, lambda n: F.element_at(F.filter(F.arrays_zip(names.alias("n"), plain.alias("v")), lambda z: z["n"] == n), -1))
    return F.when(F.size(names) > 0, F.map_from_entries(F.array_distinct(F.transform(last, lambda z: F.struct(z["n"].alias("key"), z["v"].alias("value"))))))


def planned(own: DataFrame, filled: DataFrame) -> DataFrame:
    """doc_id, edits: for each document an array of (at, node, kind, op, text) that apply() carries out.

    own: slots(); filled: answers(). Groups come first: their members take the values in turn, those left over become
    empty, and what goes beyond is cloned from the last member. Other slots are set unless a group has taken them.
    """
    runs = groups(own).select("doc_id", "group_id", "members")
    values = filled.select("doc_id", F.explode("groups").alias("group_id", "values"))
    used = runs.join(values, ["doc_id", "group_id"])
    places = F.sequence(F.lit(0), F.greatest(F.size("members"), F.size("values")) - 1)
    each = used.select("doc_id", "members", "values", F.explode(places).alias("i"))
    beyond = F.col("i") >= F.size("members")
    slot = F.when(beyond, F.element_at("members", -1)).otherwise(F.get("members", F.col("i")))
    each = each.select("doc_id", slot.alias("slot"), F.when(beyond, F.lit("clone")).otherwise("set").alias("op"), F.coalesce(F.get("values", F.col("i")), F.lit("")).alias("new"), "i")
    taken = used.select("doc_id", F.explode("members").alias("slot"))
    fixed = filled.select("doc_id", F.explode("slots").alias("slot_id", "new"))
    fixed = fixed.join(own.select("doc_id", "slot_id", "slot"), ["doc_id", "slot_id"]).join(taken, ["doc_id", "slot"], "left_anti")
    every = each.union(fixed.select("doc_id", "slot", F.lit("set").alias("op"), "new", F.lit(0).alias("i")))
    every = every.join(own.select("doc_id", "slot", "node", "kind"), ["doc_id", "slot"])
    text = F.when(F.col("kind") == "block", sanitize_inline(F.col("new"))).otherwise(F.col("new"))
    edit = F.struct(F.col("slot").alias("at"), F.col("i"), "node", "kind", "op", text.alias("text"), F.col("new").alias("plain"))
    return every.groupBy("doc_id").agg(F.array_sort(F.collect_list(edit)).alias("edits"))


def _set(node: Node, kind: str, text: str, plain: str) -> None:
    """A leaf takes plain text; a block the sanitised markup, within the run format that its content had."""
    if kind == "leaf":
        node.children = [Node(TEXT, text=plain)]
        return
    look = next((x.attrs["data-rp"] for x in node.walk() if x is not node and "data-rp" in x.attrs), None)
    try:
        inner = parse_xml(f"<x>{text}</x>").children[0].children
    except Exception:  # unbalanced inline tags
        inner = [Node(TEXT, text=plain)]
    node.children = inner if look is None else [Node("span", {"data-rp": look}, inner)]


def apply(root: Node, edits: list[dict]) -> None:
    every = [x for x in root.walk() if x is not root]
    parent = {id(c): x for x in root.walk() for c in x.children}
    after: dict[int, Node] = {}
    for e in edits:
        node = every[e["node"]]
        if e["op"] == "set":
            _set(node, e["kind"], e["text"], e["plain"])
            continue
        new, last = copy.deepcopy(node), after.get(e["node"], node)
        _set(new, e["kind"], e["text"], e["plain"])
        into = parent[id(node)].children
        at = next(i for i, x in enumerate(into) if x is last)
        into[at + 1 : at + 1] = [Node(TEXT, text="\n"), new]
        after[e["node"]] = new


def grow(root: Node, tables: list[dict]) -> None:
    """Each table with new rows (ref, rows) keeps its first row; its last is the pattern of all others."""
    new = {t["ref"]: t["rows"] for t in tables}
    for table in root.find("table"):
        rows = new.get(table.attrs.get("data-table"))
        body = table.child("tbody") or table
        own = [x for x in body.children if x.tag == "tr"]
        if not rows or len(own) < 2:
            continue
        out = [own[0]]
        for values in rows:
            row = copy.deepcopy(own[-1])
            for i, cell in enumerate(x for x in row.children if x.tag in CELL_TAGS):
                cell.children = [Node(TEXT, text=values[i] if i < len(values) and values[i] is not None else "")]
            out.append(row)
        body.children = out


def filled(docs: DataFrame, html: str, own: DataFrame, given: DataFrame) -> DataFrame:
    """doc_id, markup of docs (doc_id, html) with the answers filled in; unknown ids are ignored, slots not named stay. own: slots()."""
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(html).alias("markup"))
    first_ = rewritten(docs.join(planned(own, given), "doc_id", "left"), "markup", apply)
    rows = given.select("doc_id", _table_rows().alias("edits"))
    return rewritten(first_.join(rows, "doc_id", "left"), "markup", grow)


def _table_rows() -> Column:
    none = F.expr("map()").cast("map<string, array<array<string>>>")
    return F.transform(F.map_entries(F.coalesce("tables", none)), lambda t: F.struct(t["key"].alias("ref"), t["value"].alias("rows")))


def _edits(found: list[dict], given: dict) -> list[dict]:
    """planned() of one document. given: slots and groups, lists of structs of a key and its values, plain and sanitised."""
    groups_: dict[str, list[dict]] = {}
    for x in found:
        if x["group_id"] is not None:
            groups_.setdefault(x["group_id"], []).append(x)
    by_id = {x["slot_id"]: x for x in found}
    out, taken = [], set()
    put = lambda x, i, op, v: out.append((x["slot"], i, {"node": x["node"], "kind": x["kind"], "op": op, "text": v["text"] if x["kind"] == "block" else v["plain"], "plain": v["plain"]}))
    for g in given["groups"] or ():
        members = groups_.get(g["key"])
        if members is None:
            continue
        values = g["values"] or []
        taken.update(x["slot"] for x in members)
        for i in range(max(len(members), len(values))):
            put(members[min(i, len(members) - 1)], i, "clone" if i >= len(members) else "set", values[i] if i < len(values) else {"plain": "", "text": ""})
    for s in given["slots"] or ():
        x = by_id.get(s["key"])
        if x is not None and x["slot"] not in taken and s["value"]["plain"] is not None:
            put(x, 0, "set", s["value"])
    return [e for *_, e in sorted(out, key=lambda e: e[:2])]


def filled_in(docs: DataFrame, html: str, given: DataFrame) -> DataFrame:
    """filled() of the documents' own slots, found as each is read."""
    value = lambda v, plain: F.struct(plain.alias("plain"), sanitize_inline(plain).alias("text"))
    slots_ = F.transform(F.map_entries("slots"), lambda x: F.struct(x["key"].alias("key"), value(x, x["value"]).alias("value")))
    groups_ = F.transform(F.map_entries("groups"), lambda x: F.struct(x["key"].alias("key"), F.transform(x["value"], lambda v: value(v, F.coalesce(v, F.lit("")))).alias("values")))
    told = given.select("doc_id", F.struct(slots_.alias("slots"), groups_.alias("groups"), _table_rows().alias("tables")).alias("edits"))
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(html).alias("markup")).join(told, "doc_id", "left")

    def change(root: Node, edits: dict) -> None:
        if edits:
            apply(root, _edits(form_of(root)[0], edits))
        root.children = parse_html(write(root)).children  # tables are found in the markup as filled
        if edits:
            grow(root, edits["tables"] or [])

    return rewritten(docs, "markup", change)


def fill_counts(own: DataFrame, given: DataFrame) -> DataFrame:
    """doc_id, n_slots, n_asked, n_filled, n_groups. own: fields(); given: answers()."""
    counts = own.groupBy("doc_id").agg(F.count("*").alias("n_slots"), F.count_if("send").alias("n_asked"))
    sizes = given.select("doc_id", F.size("slots").alias("f"), F.coalesce(F.size("groups"), F.lit(0)).alias("g"))
    return counts.join(sizes, "doc_id", "left").select("doc_id", "n_slots", "n_asked", F.greatest(F.coalesce("f", F.lit(0)), F.lit(0)).cast("long").alias("n_filled"), F.greatest(F.coalesce("g", F.lit(0)), F.lit(0)).cast("long").alias("n_groups"))

