"""Word documents: markup for editing made from word/document.xml, and edited markup written back.

The body is read once into a relation of pieces: a row for each run of a paragraph, each cell of a table, each element kept whole.
Tokens that stand for kept XML (pp: paragraph formatting, rp: run formatting, frun: frozen runs, frozen: frozen blocks, tbl: tables)
are numbered by windows in document order; markup and XML are then put together by sorted aggregates. What a token stands for
is a relation too, so decoding is a join, and a token without XML is an error of its document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import codecs as C
from folium.functions.grid import emu_px, half_up, resolve_path
from folium.functions.text import escape, escape_attribute
from folium.operators.palette import Palette, class_key, key_native, key_tag, native_key, normalise
from folium.sources.markup import TEXT, Node, parse_html, parse_xml, write
from folium.sources.tables import by_row

DOCUMENT = "word/document.xml"
#: Marks by element, elements that make a run frozen, image types by extension.
MARKS = {"w:b": "bold", "w:i": "italic", "w:u": "underline", "w:strike": "strike"}
EMBEDDED = ("w:drawing", "w:pict", "w:object")
IMAGES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "svg": "image/svg+xml"}
HTML_MARKS = {"strong": "bold", "em": "italic", "u": "underline", "s": "strike"}
_MARK_TAG = {v: k for k, v in MARKS.items()}
_TAG_OF_MARK = {v: k for k, v in HTML_MARKS.items()}
PIECES = (
    "doc_id string, block int, type string, xml string, style string, pp string, pp_rest string, piece int, text string, marks array<string>, "
    "rp string, rp_marks array<string>, rp_rest string, frozen string, label string, row int, col int, span int, down int"
)




def blank(node: Node) -> bool:
    return node.tag == TEXT and not node.text.strip()


def body_of(xml: str | bytes) -> Node:
    root = parse_xml(xml)
    document = root.child("w:document")
    body = document.child("w:body") if document else None
    if body is None:
        raise ValueError("no w:body")
    return body


def run_text(run: Node) -> str:
    return "".join(x.deep() if x.tag == "w:t" else "\n" if x.tag in ("w:br", "w:cr") else "" for x in run.children)


def run_pieces(paragraph: Node) -> Iterator[dict]:
    """Runs of a paragraph: frozen ones whole, others with marks by presence; empty ones go."""
    n = 0
    for run in (x for x in paragraph.children if x.tag == "w:r"):
        odd = next((x for x in run.children if x.tag in EMBEDDED), None)
        if odd is not None:
            yield {"piece": n, "text": "", "marks": [], "frozen": write(run), "label": "[object]" if odd.tag == "w:object" else "[picture]"}
            n += 1
            continue
        text, look = run_text(run), run.child("w:rPr")
        if not text:
            continue
        own = look.children if look else []
        marks, rest = [MARKS[x.tag] for x in own if x.tag in MARKS], [x for x in own if x.tag not in MARKS]
        kept = {"rp": write(look), "rp_marks": marks, "rp_rest": "".join(map(write, rest))} if rest else {}
        yield {"piece": n, "text": text, "marks": marks, **kept}
        n += 1


def cell_text(cell: Node) -> str:
    return "\n".join("".join(p["text"] for p in run_pieces(x)) for x in cell.children if x.tag == "w:p")


def body_pieces(body: Node) -> Iterator[dict]:
    blocks = [x for x in body.children if not blank(x)]
    for node in blocks:
        if node.tag == "w:sectPr":
            yield {"block": None, "type": "section", "xml": write(node)}
    for i, node in enumerate(x for x in blocks if x.tag != "w:sectPr"):
        if node.tag == "w:p":
            look = node.child("w:pPr")
            own = look.children if look else []
            rest = [x for x in own if x.tag != "w:pStyle"]
            style = next((x.attrs.get("w:val") for x in own if x.tag == "w:pStyle"), None)
            base = {"block": i, "type": "paragraph", "style": style, "pp": write(look) if rest else None, "pp_rest": "".join(map(write, rest)) if rest else None}
            pieces = list(run_pieces(node))
            yield from ({**base, **p} for p in pieces)
            if not pieces:
                yield base
        elif node.tag == "w:tbl":
            yield {"block": i, "type": "table", "xml": write(node)}
            for r, tr in enumerate(x for x in node.children if x.tag == "w:tr"):
                for c, tc in enumerate(x for x in tr.children if x.tag == "w:tc"):
                    grid = tc.child("w:tcPr").child("w:gridSpan") if tc.child("w:tcPr") else None
                    span = grid.attrs.get("w:val", "") if grid else ""
                    yield {"block": i, "type": "cell", "row": r, "col": c, "span": int(span) if span.isdigit() and int(span) > 1 else None, "text": cell_text(tc)}
        else:
            yield {"block": i, "type": "frozen", "xml": write(node), "label": "[table]" if node.tag == "w:tbl" else f"[{node.tag}]"}


def rows_of(frame: DataFrame, make, schema: str, *columns: str) -> DataFrame:
    """make(*values) gives dicts of the schema beside doc_id; one that raises gives a row with error, if the schema has that."""
    names = [x.split()[0] for x in re.sub(r"<[^>]*>", "", schema).split(", ")]

    def run(doc: str, *given) -> list[tuple]:
        try:
            rows = [{"doc_id": doc, **r} for r in make(*given)]
        except Exception as e:  # broken files are rows, not failures
            if "error" not in names:
                return []
            rows = [{"doc_id": doc, "error": f"{type(e).__name__}: {e}"}]
        return [tuple(r.get(n) for n in names) for r in rows]

    return by_row(frame.select(F.col("doc_id").cast("string").alias("doc_id"), *columns), run, schema)


def pieces(parts: DataFrame) -> DataFrame:
    """The body's pieces of each document of archives.parts_of(); documents that cannot be read have none."""
    return rows_of(parts.where(F.col("part") == DOCUMENT), lambda c: body_pieces(body_of(bytes(c))), PIECES, "content")


# Palettes.


def style_rows(xml: str | bytes) -> Iterator[dict]:
    """Paragraph styles with a key fit for a class name; the fallback is the default style, else Normal, else the first, else one made up."""
    root = parse_xml(xml).child("w:styles")
    found, used, default = [], set(), None
    for s in (x for x in (root.children if root else []) if x.tag == "w:style" and x.attrs.get("w:type", "paragraph") == "paragraph" and x.attrs.get("w:styleId")):
        native = s.attrs["w:styleId"]
        base = re.sub(r"[^A-Za-z0-9_-]", "_", native) or "s"
        key = next(k for k in (base, *(f"{base}_{i}" for i in range(1, len(used) + 2))) if k not in used)
        used.add(key)
        look = s.child("w:pPr").child("w:outlineLvl") if s.child("w:pPr") else None
        level = look.attrs.get("w:val", "") if look else ""
        found.append((key, native, f"h{min(6, max(1, int(level) + 1))}" if re.fullmatch(r"-?\d+", level) else "p"))
        if s.attrs.get("w:default") == "1":
            default = key
    if not found:
        found = [("body", "Normal", "p")]
    default = default or next((k for k, n, _ in found if n.lower() == "normal"), found[0][0])
    return ({"place": i, "key": k, "native": n, "tag": t, "fallback": k == default} for i, (k, n, t) in enumerate(found))


def palettes(parts: DataFrame) -> DataFrame:
    """doc_id, place, key, native, tag, fallback of each document's own styles."""
    return rows_of(parts.where("part = 'word/styles.xml'"), lambda c: style_rows(bytes(c)), "doc_id string, place int, key string, native string, tag string, fallback boolean", "content")


def palette_of(xml: str | bytes, name: str = "doc") -> Palette:
    rows = list(style_rows(xml))
    return Palette(name, tuple((r["key"], r["native"], r["tag"]) for r in rows), next(r["key"] for r in rows if r["fallback"]))


# Encode.


def tokens(found: DataFrame, table_mark: str = "tbl-") -> DataFrame:
    """pieces() with token columns: pp_token, rp_token, frozen_token."""
    order = Window.partitionBy("doc_id").orderBy("block", "row", "col", "piece")
    n = lambda test: F.sum(test.cast("int")).over(order) - 1
    name = lambda test, mark: F.when(test, F.concat(F.lit(mark), n(test).cast("string")))
    first = F.coalesce(F.col("piece"), F.lit(0)) == 0
    pp = (F.col("type") == "paragraph") & F.col("pp").isNotNull() & first
    base = found.where("type <> 'section'").withColumn("pp_token", name(pp, "pp-")).withColumn("rp_token", name(F.col("rp").isNotNull(), "rp-"))
    base = base.withColumn("frozen_token", F.coalesce(name(F.col("frozen").isNotNull(), "frun-"), name(F.col("type") == "frozen", "frozen-"), name(F.col("type") == "table", table_mark)))
    return base


def store(named: DataFrame) -> DataFrame:
    """doc_id, token, xml, marks, rest: what each token stands for. named: tokens()."""
    none = F.array().cast("array<string>")
    pp = named.where("pp_token is not null").select("doc_id", F.col("pp_token").alias("token"), F.col("pp").alias("xml"), none.alias("marks"), F.col("pp_rest").alias("rest"))
    rp = named.where("rp_token is not null").select("doc_id", "rp_token", "rp", "rp_marks", "rp_rest")
    kept = named.where("frozen_token is not null").select("doc_id", "frozen_token", F.coalesce("frozen", "xml"), none, F.lit(None).cast("string"))
    return pp.union(rp).union(kept)


def images(parts: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, token, img: the picture of each frozen element that has one in the file, by its relationship."""
    rid = F.coalesce(*(F.nullif(F.regexp_extract("xml", f'r:{a}="([^"]+)"', 1), F.lit("")) for a in ("embed", "link", "id")))
    wanted = kept.select("doc_id", "token", "xml", rid.alias("rid")).where("rid is not null")
    found = wanted.join(relations(parts, DOCUMENT).where("not external").select("doc_id", F.col("id").alias("rid"), F.col("path").alias("part")), ["doc_id", "rid"])
    found = found.join(parts.select("doc_id", "part", "content").where("length(content) > 0"), ["doc_id", "part"])
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in IMAGES.items() for x in kv)), F.lower(F.regexp_extract("part", r"\.([^./]*)$", 1)))
    cx, cy = (F.regexp_extract("xml", r'<wp:extent\b[^>]*\bcx="(\d+)"[^>]*\bcy="(\d+)"', i).try_cast("double") for i in (1, 2))
    w, h = (F.regexp_extract("xml", rf"[^-]{side}:\s*([\d.]+)pt", 1).try_cast("double") for side in ("width", "height"))
    px = lambda c: c.cast("long").cast("string")
    size = lambda a, b: F.concat(F.lit("width:"), px(a), F.lit("px;height:"), px(b), F.lit("px;"))
    dim = F.coalesce(size(emu_px(cx), emu_px(cy)), size(half_up(w * 4 / 3), half_up(h * 4 / 3)), F.lit(""))
    src = F.concat(F.lit("data:"), kind, F.lit(";base64,"), C.base64_text(F.col("content")))
    img = F.concat(F.lit('<img alt="" style="'), dim, F.lit('max-width:100%;vertical-align:top" src="'), src, F.lit('"/>'))
    return found.where(kind.isNotNull()).select("doc_id", "token", img.alias("img"))


def relations(parts: DataFrame, of: str | None = None) -> DataFrame:
    """doc_id, source (the part), id, type, target, path (resolved), external of all .rels parts, or of one part's."""

    def make(part: str, content: bytes):
        root = parse_xml(bytes(content))
        for x in root.find("Relationship"):
            yield {"part": part, "id": x.attrs.get("Id"), "type": x.attrs.get("Type", ""), "target": x.attrs.get("Target", ""), "external": x.attrs.get("TargetMode") == "External" or bool(re.match(r"https?:", x.attrs.get("Target", ""), re.I))}

    rels = rows_of(parts.where(F.col("part").endswith(".rels")), make, "doc_id string, part string, id string, type string, target string, external boolean", "part", "content")
    source = F.regexp_replace("part", r"(^|/)_rels/([^/]*)\.rels$", "$1$2")
    out = rels.withColumn("source", source).where("id is not null")
    out = out.select("doc_id", "source", "id", "type", "target", resolve_path(F.col("source"), F.col("target")).alias("path"), "external")
    return out if of is None else out.where(F.col("source") == of)


def attr(name: str, value: Column) -> Column:
    """name="value", or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), value, F.lit('"')), F.lit(""))


def marked_html(text: Column, marks: Column) -> Column:
    """The text with its marks around it, the first innermost."""
    tag = F.create_map(*(F.lit(x) for kv in _TAG_OF_MARK.items() for x in kv))
    return F.aggregate(marks, text, lambda s, m: F.concat(F.lit("<"), tag[m], F.lit(">"), s, F.lit("</"), tag[m], F.lit(">")))


def encoded(parts: DataFrame, palette: Palette, tables: str = "editable") -> DataFrame:
    """doc_id, html of each document. tables: editable (cells with ids) or frozen."""
    named = tokens(pieces(parts))
    return markup(named, palette, images(parts, store(named)), tables)


def markup(named: DataFrame, palette: Palette, seen: DataFrame, tables: str = "editable") -> DataFrame:
    """doc_id, html of tokens(); seen: images()."""
    named = named.join(seen.withColumnRenamed("token", "frozen_token"), ["doc_id", "frozen_token"], "left")
    named = named.withColumn("key", native_key(palette, F.col("style"))).withColumn("tag", key_tag(palette, F.col("key")))
    shown = F.coalesce("img", escape(F.coalesce("label", F.lit("[object]"))))
    text = F.replace(escape("text"), F.lit("\n"), F.lit("<br/>"))
    run = marked_html(text, F.col("marks"))
    run = F.when(F.col("rp_token").isNotNull(), F.concat(F.lit('<span data-rp="'), "rp_token", F.lit('">'), run, F.lit("</span>"))).otherwise(run)
    run = F.when(F.col("frozen").isNotNull(), F.concat(F.lit('<span data-frozen-run="'), "frozen_token", F.lit('" contenteditable="false">'), shown, F.lit("</span>"))).otherwise(F.coalesce(run, F.lit("")))
    paras = named.where("type = 'paragraph'").groupBy("doc_id", "block", "key", "tag").agg(F.max("pp_token").alias("pp_token"), F.array_join(F.array_sort(F.collect_list(F.struct("piece", run.alias("x"))))["x"], "").alias("x"))
    paras = paras.select("doc_id", "block", F.concat(F.lit("<"), "tag", F.lit(' class="s-'), "key", F.lit('"'), attr("data-pp", F.col("pp_token")), F.lit(">"), "x", F.lit("</"), "tag", F.lit(">")).alias("x"))
    whole = F.concat(F.lit('<div class="s-frozen" data-frozen="'), "frozen_token", F.lit('" contenteditable="false">'), shown, F.lit("</div>"))
    frozen = named.where("type = 'frozen'").select("doc_id", "block", whole.alias("x"))
    grid = named.where("type = 'table'").select("doc_id", "block", F.col("frozen_token").alias("ref"))
    style = F.lit(f"s-{palette.fallback}")
    if tables == "frozen":
        made = grid.select("doc_id", "block", F.concat(F.lit('<div class="s-frozen" data-frozen="'), "ref", F.lit('" contenteditable="false">[table]</div>')).alias("x"))
    else:
        cell = F.concat(F.lit('<td class="'), style, F.lit('" data-cell="'), "ref", F.lit(":"), F.col("row").cast("string"), F.lit(":"), F.col("col").cast("string"), F.lit('"'), attr("colspan", F.col("span").cast("string")), attr("rowspan", F.col("down").cast("string")), F.lit(">"), text, F.lit("</td>"))
        cells = named.where("type = 'cell'").drop("frozen_token").join(grid, ["doc_id", "block"])
        rows = cells.groupBy("doc_id", "block", "ref", "row").agg(F.array_join(F.array_sort(F.collect_list(F.struct("col", cell.alias("x"))))["x"], "").alias("x"))
        made = rows.groupBy("doc_id", "block", "ref").agg(F.array_join(F.array_sort(F.collect_list(F.struct("row", F.concat(F.lit("<tr>"), "x", F.lit("</tr>")).alias("x"))))["x"], "").alias("x"))
        made = grid.join(made, ["doc_id", "block", "ref"], "left").select("doc_id", "block", F.concat(F.lit('<table class="'), style, F.lit('" data-table="'), "ref", F.lit('"><tbody>'), F.coalesce("x", F.lit("")), F.lit("</tbody></table>")).alias("x"))
    body = paras.union(frozen).union(made).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "x")))["x"], "\n").alias("x"))
    return body.select("doc_id", F.concat(F.lit(f'<div class="folium-doc" data-palette="{palette.name}">\n'), "x", F.lit("\n</div>")).alias("html"))


# Decode.

EDITED = (
    "doc_id string, block int, type string, key string, pp_token string, piece int, text string, marks array<string>, rp_token string, frozen_token string, row int, col int, n_rows int, error string"
)


def html_runs(node: Node) -> Iterator[dict]:
    """Texts below a node with the marks and run token around them."""
    waiting: list[tuple[Node, tuple[str, ...], str | None]] = [(x, (), None) for x in reversed(node.children)]
    while waiting:
        x, marks, look = waiting.pop()
        if x.tag == TEXT:
            if x.text:
                yield {"text": x.text, "marks": list(marks), "rp_token": look}
        elif x.tag == "br":
            yield {"text": "\n", "marks": list(marks), "rp_token": look}
        elif x.attrs.get("data-frozen-run"):
            yield {"text": "", "marks": [], "frozen_token": x.attrs["data-frozen-run"]}
        else:
            inner = (*marks, HTML_MARKS[x.tag]) if x.tag in HTML_MARKS else marks
            waiting.extend((c, inner, x.attrs.get("data-rp", look)) for c in reversed(x.children))


def html_pieces(html: str, palette: Palette, trusted: bool = False) -> Iterator[dict]:
    """Pieces of edited markup, normalised first unless it is trusted."""
    root = parse_html(html if trusted else normalise(html, palette)[0])
    inner = next((x for x in root.find("div")), None)
    if inner is None:
        raise ValueError("no document element")
    for i, node in enumerate(x for x in inner.children if x.tag != TEXT):
        if node.tag == "div" and "data-frozen" in node.attrs:
            yield {"block": i, "type": "frozen", "frozen_token": node.attrs["data-frozen"]}
        elif node.tag == "table":
            rows = [x for x in (node.child("tbody") or node).children if x.tag == "tr"]
            if not node.attrs.get("data-table"):
                raise ValueError("a table without a source cannot be written")
            yield {"block": i, "type": "table", "frozen_token": node.attrs["data-table"], "n_rows": len(rows)}
            for r, tr in enumerate(rows):
                for c, td in enumerate(x for x in tr.children if x.tag in ("td", "th")):
                    if "data-cell" in td.attrs:
                        yield {"block": i, "type": "cell", "row": r, "col": c, "text": "".join(x["text"] for x in html_runs(td))}
        else:
            base = {"block": i, "type": "paragraph", "key": palette.key_of_class(node.attrs.get("class")) or palette.fallback, "pp_token": node.attrs.get("data-pp")}
            found = list(html_runs(node))
            yield from ({**base, "piece": n, **x} for n, x in enumerate(found))
            if not found:
                yield base


def patched_table(xml: str, edits: list[dict], n_rows: int) -> str:
    """A table with changed cells (row, col, text); rows beyond its own are copies of its last. Cells that say the same stay whole."""
    from copy import deepcopy

    table = parse_xml(xml).children[0]
    rows = [x for x in table.children if x.tag == "w:tr"]
    if rows and n_rows > len(rows):
        at = next(i for i, x in enumerate(table.children) if x is rows[-1]) + 1
        more = [deepcopy(rows[-1]) for _ in range(n_rows - len(rows))]
        table.children[at:at] = more
        rows += more
    for e in edits:
        cells = [x for x in rows[e["row"]].children if x.tag == "w:tc"] if e["row"] < len(rows) else []
        if e["col"] >= len(cells) or cell_text(cells[e["col"]]) == e["text"]:
            continue
        cell = cells[e["col"]]
        para = cell.child("w:p")
        kept = [x for x in (cell.child("w:tcPr"),) if x is not None]
        look = [x for x in (para.child("w:pPr") if para else None,) if x is not None]
        text = Node("w:t", {"xml:space": "preserve"}, [Node(TEXT, text=e["text"])])
        cell.children = [*kept, Node("w:p", {}, [*look, Node("w:r", {}, [text])])]
    return write(table)


def decoded(parts: DataFrame, edited: DataFrame, palette: Palette, trusted: bool = False) -> DataFrame:
    """doc_id, part, content, error: word/document.xml of each document of edited (doc_id, html), for archives.with_edits().

    The section of the body and all other parts stay. A token that stands for nothing, or markup that cannot be read, is an
    error, and its content null.
    """
    found = pieces(parts)
    kept = store(tokens(found))
    new = rows_of(edited, lambda h: html_pieces(h or "", palette, trusted), EDITED, "html")
    bad = new.where("error is not null").select("doc_id", "error")
    new = new.where("error is null")
    pp, rp, whole = (kept.select("doc_id", F.col("token").alias(f"{k}_token"), F.col("xml").alias(f"{k}_xml"), F.col("marks").alias(f"{k}_marks"), F.col("rest").alias(f"{k}_rest")) for k in ("pp", "rp", "frozen"))
    new = new.join(pp, ["doc_id", "pp_token"], "left").join(rp, ["doc_id", "rp_token"], "left").join(whole, ["doc_id", "frozen_token"], "left")
    lost = new.where("frozen_token is not null and frozen_xml is null").groupBy("doc_id").agg(F.concat(F.lit("nothing is kept for "), F.min("frozen_token")).alias("error"))
    element = F.create_map(*(F.lit(x) for kv in _MARK_TAG.items() for x in kv))
    of_marks = F.array_join(F.transform(F.coalesce("marks", F.array().cast("array<string>")), lambda m: F.concat(F.lit("<"), element[m], F.lit("/>"))), "")
    same = F.array_sort(F.array_distinct("marks")) == F.array_sort(F.array_distinct("rp_marks"))
    inner = F.concat(of_marks, F.coalesce("rp_rest", F.lit("")))
    look = F.when(F.col("rp_xml").isNotNull() & same, F.col("rp_xml")).when(inner != "", F.concat(F.lit("<w:rPr>"), inner, F.lit("</w:rPr>"))).otherwise("")
    run = F.when(F.col("frozen_xml").isNotNull(), F.col("frozen_xml")).when(F.col("text").isNotNull(), F.concat(F.lit("<w:r>"), look, F.lit('<w:t xml:space="preserve">'), escape("text"), F.lit("</w:t></w:r>"))).otherwise("")
    paras = new.where("type = 'paragraph'").groupBy("doc_id", "block", "key").agg(F.max("pp_rest").alias("rest"), F.array_join(F.array_sort(F.collect_list(F.struct("piece", run.alias("x"))))["x"], "").alias("x"))
    style = F.concat(F.lit('<w:pPr><w:pStyle w:val="'), escape_attribute(key_native(palette, F.col("key"))), F.lit('"/>'), F.coalesce("rest", F.lit("")), F.lit("</w:pPr>"))
    paras = paras.select("doc_id", "block", F.concat(F.lit("<w:p>"), style, "x", F.lit("</w:p>")).alias("x"))
    frozen = new.where("type = 'frozen'").select("doc_id", "block", F.col("frozen_xml").alias("x"))
    cells = new.where("type = 'cell'").groupBy("doc_id", "block").agg(F.collect_list(F.struct("row", "col", "text")).alias("edits"))
    grid = new.where("type = 'table' and frozen_xml is not null").select("doc_id", "block", "frozen_xml", "n_rows").join(cells, ["doc_id", "block"], "left")
    patch = lambda block, xml, n, edits: [{"block": block, "x": patched_table(xml, list(edits) if edits is not None else [], n)}]
    made = rows_of(grid, patch, "doc_id string, block int, x string", "block", "frozen_xml", "n_rows", "edits")
    body = paras.union(frozen).union(made).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "x")))["x"], "").alias("x"))
    section = found.where("type = 'section'").groupBy("doc_id").agg(F.last("xml").alias("section"))
    source = parts.where(F.col("part") == DOCUMENT).select("doc_id", F.col("content").cast("string").alias("xml"))
    base = edited.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(source, "doc_id", "left").join(body, "doc_id", "left").join(section, "doc_id", "left")
    base = base.join(lost, "doc_id", "left").join(bad.withColumnRenamed("error", "unread"), "doc_id", "left")
    frame = lambda i: F.regexp_extract("xml", r"(?s)\A(.*?<w:body\b[^>]*(?<!/)>)(.*)(</w:body>.*)\z", i)
    none = F.when(F.col("xml").isNull() | (frame(1) == ""), F.lit("no w:body"))
    error = F.coalesce("unread", "error", none)
    text = F.concat(frame(1), F.coalesce("x", F.lit("")), F.coalesce("section", F.lit("")), frame(3))
    return base.select("doc_id", F.lit(DOCUMENT).alias("part"), F.when(error.isNull(), F.encode(text, "UTF-8")).alias("content"), error.alias("error"))


def class_of(palette: Palette, classes: Column) -> Column:
    return F.coalesce(class_key(palette, classes), F.lit(palette.fallback))
