"""HTML and XML as a relation of nodes, and back.

A document becomes one row a node, numbered in document order: node, parent, last (its last descendant), depth, path (its
ancestors from the root), tag ("#text" for text), attrs and text. Children, descendants and deep texts are then joins on parent or on
the exploded path, and markup is written again by sorting what opens and closes. HTML is read tolerantly by the standard
library's parser under the rules below; XML must be well-formed, else the document has one row with an error.
"""

from __future__ import annotations

import html as entities
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.parsers import expat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folium.functions.detect import SPACE
from folium.functions.text import escape, escape_attribute
from folium.sources.tables import by_row

TEXT = "#text"
#: Elements without content; elements whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style")
#: What a start tag closes if it is open: a paragraph ends at the next block, a list item, cell or row at the next of its kind.
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
#: Elements that a start tag does not look beyond for what it closes.
FENCES = frozenset("table ul ol div section article body html".split())
NODES = "doc_id string, node int, parent int, last int, depth int, path array<int>, tag string, attrs map<string, string>, text string, error string"


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node] = field(default_factory=list)
    text: str = ""

    def walk(self) -> Iterator[Node]:
        """This node and all below, in document order, without recursion."""
        waiting = [self]
        while waiting:
            node = waiting.pop()
            yield node
            waiting.extend(reversed(node.children))

    def find(self, *tags: str) -> Iterator[Node]:
        return (x for x in self.walk() if x is not self and x.tag in tags)

    def child(self, tag: str) -> Node | None:
        return next((x for x in self.children if x.tag == tag), None)

    def deep(self) -> str:
        return "".join(x.text for x in self.walk() if x.tag == TEXT)


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.root = Node("#root")
        self.open = [self.root]

    def _close(self, tags: tuple[str, ...]) -> None:
        """Ends the innermost open element of these tags, unless a fence is nearer."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in FENCES:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close(("p",))
        for one in CLOSES.get(tag, ()):
            self._close((one,))
        node = Node(tag, {k: v if v is not None else "" for k, v in reversed(attrs)})
        node.attrs = dict(reversed(node.attrs.items()))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        into = self.open[-1].children
        if into and into[-1].tag == TEXT:
            into[-1].text += data
        else:
            into.append(Node(TEXT, text=data))

    def handle_entityref(self, name):
        self.handle_data(entities.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(entities.unescape(f"&#{name};"))


def parse_html(text: str) -> Node:
    reader = _Html()
    reader.feed(text)
    reader.close()
    return reader.root


def parse_xml(text: str | bytes) -> Node:
    """The document's nodes with names as written; white space is kept. Raises expat.ExpatError."""
    root = Node("#root")
    open_ = [root]
    reader = expat.ParserCreate()
    reader.buffer_text = True
    reader.ordered_attributes = True

    def start(tag, pairs):
        node = Node(tag, dict(zip(pairs[::2], pairs[1::2], strict=True)))
        open_[-1].children.append(node)
        open_.append(node)

    def data(x):
        open_[-1].children.append(Node(TEXT, text=x))

    reader.StartElementHandler, reader.CharacterDataHandler = start, data
    reader.EndElementHandler = lambda _: open_.pop()
    reader.Parse(text, True)
    return root


def parsed(text: str | bytes | None) -> Node | None:
    """parse_xml(), or nothing for a document that is not well-formed."""
    try:
        return parse_xml(text or "")
    except (expat.ExpatError, ValueError):
        return None


def esc(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def esc_attr(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


def start_tag(node: Node, closed: bool = False) -> str:
    return f"<{node.tag}{''.join(f' {k}="{esc_attr(v)}"' for k, v in node.attrs.items())}{'/' if closed else ''}>"


def write(node: Node) -> str:
    """Markup of a node; of the root, of all within. Elements without children are closed at once."""
    out: list[str] = []
    waiting: list[Node | str] = [node]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == TEXT:
            out.append(esc(x.text))
        elif x.tag == "#root":
            waiting.extend(reversed(x.children))
        elif x.children:
            out.append(start_tag(x))
            waiting.append(f"</{x.tag}>")
            waiting.extend(reversed(x.children))
        else:
            out.append(start_tag(x, True))
    return "".join(out)


def numbered(root: Node) -> list[tuple]:
    """(node, parent, last, depth, path, tag, attrs, text) of all nodes under the root, from 0."""
    rows: list[list] = []
    waiting: list[tuple[Node, tuple[int, ...]] | int] = [(x, ()) for x in reversed(root.children)]
    while waiting:
        x = waiting.pop()
        if isinstance(x, int):  # all of this node's descendants are numbered
            rows[x][2] = len(rows) - 1
            continue
        node, path = x
        n = len(rows)
        rows.append([n, path[-1] if path else None, n, len(path), list(path), node.tag, list(node.attrs.items()), node.text if node.tag == TEXT else None])
        waiting.append(n)
        waiting.extend((c, (*path, n)) for c in reversed(node.children))
    return [tuple(r) for r in rows]


def _read(parse: Callable[[str], Node]):
    def make(doc: str, text: str | None) -> list[tuple]:
        try:
            return [(doc, *r, None) for r in numbered(parse(text or ""))]
        except (expat.ExpatError, ValueError) as e:
            return [(doc, *[None] * 8, str(e))]

    return make


def html_nodes(docs: DataFrame, text: str = "html") -> DataFrame:
    """docs: doc_id and the column of markup. A null text has no nodes."""
    return by_row(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text")), _read(parse_html), NODES)


def xml_nodes(docs: DataFrame, text: str = "xml") -> DataFrame:
    """As html_nodes; a document that is not well-formed has one row, with its error."""
    return by_row(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text")), _read(parse_xml), NODES)


# The relation's operators. Each keeps one document's rows together: all joins are on doc_id and a node.


def attribute(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def blank(text: Column) -> Column:
    """Nothing but white space."""
    return F.rlike(text, F.lit(rf"^[{SPACE}]*\z"))


def children(nodes: DataFrame, of: DataFrame, tag: str | None = None) -> DataFrame:
    """Nodes whose parent is in of (doc_id, node), with it as owner; only those of the tag, if given."""
    own = of.select("doc_id", F.col("node").alias("owner"))
    found = nodes.join(own, (nodes["doc_id"] == own["doc_id"]) & (nodes["parent"] == own["owner"])).drop(own["doc_id"])
    return found if tag is None else found.where(F.col("tag") == tag)


def descendants(nodes: DataFrame, of: DataFrame, tag: str | None = None) -> DataFrame:
    """Nodes below those in of, with the ancestor as owner, by an equi-join on the exploded path."""
    own = of.select("doc_id", F.col("node").alias("owner"))
    below = (nodes if tag is None else nodes.where(F.col("tag") == tag)).withColumn("owner", F.explode("path"))
    return below.join(own, ["doc_id", "owner"])


def first(found: DataFrame) -> DataFrame:
    """Of each owner's nodes the first in document order."""
    columns = [c for c in found.columns if c not in ("doc_id", "owner")]
    return found.groupBy("doc_id", "owner").agg(F.min_by(F.struct(*columns), "node").alias("x")).select("doc_id", "owner", "x.*")


def deep_text(nodes: DataFrame, of: DataFrame, glue: str = "") -> DataFrame:
    """doc_id, node, text: all text below each node of of, in order; empty if there is none."""
    parts = descendants(nodes, of, TEXT).groupBy("doc_id", F.col("owner").alias("node")).agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("at"), "text"))).alias("t"))
    return of.select("doc_id", "node").join(parts, ["doc_id", "node"], "left").select("doc_id", "node", F.coalesce(F.array_join("t.text", glue), F.lit("")).alias("text"))


def written(nodes: DataFrame) -> DataFrame:
    """doc_id, markup: the inverse of xml_nodes, by sorting what each node opens and closes."""
    pairs = F.array_join(F.transform(F.map_entries("attrs"), lambda x: F.concat(F.lit(" "), x["key"], F.lit('="'), escape_attribute(x["value"]), F.lit('"'))), "")
    text, empty = F.col("tag") == TEXT, F.col("last") == F.col("node")
    opens = F.struct(F.col("node").alias("at"), F.lit(0).alias("closes"), F.lit(0).alias("level"), F.when(text, escape("text")).otherwise(F.concat(F.lit("<"), "tag", pairs, F.when(empty, F.lit("/>")).otherwise(F.lit(">")))).alias("x"))
    # At one place inner elements close before outer ones.
    shuts = F.struct(F.col("last").alias("at"), F.lit(1).alias("closes"), (-F.col("depth")).alias("level"), F.concat(F.lit("</"), "tag", F.lit(">")).alias("x"))
    events = nodes.where("error is null").select("doc_id", F.explode(F.when(text | empty, F.array(opens)).otherwise(F.array(opens, shuts))).alias("e"))
    return events.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("e"))["x"], "").alias("markup"))


def rewritten(docs: DataFrame, text: str, change: Callable[[Node, list], None], parse: Callable[[str], Node] = parse_html, shape: Callable[[Node], str] = write) -> DataFrame:
    """doc_id, markup of docs (doc_id, the column of markup, edits: an array of structs); change(root, edits) works on the tree."""

    def make(doc: str, markup: str | None, edits) -> Iterator[tuple]:
        root = parse(markup or "")
        change(root, edits or [])
        yield doc, shape(root)

    return by_row(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"), "edits"), make, "doc_id string, markup string")
