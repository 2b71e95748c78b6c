"""Formats by name: what each can do, how a file finds its own, and one way in for previews, editing and filling.

A file's route is a column; an adapter is a row of a table on the driver, whose functions take and give DataFrames of files
(doc_id, content). What a format cannot do is an error of the row, or UnsupportedError where a whole call asks for it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import detect as D
from folium.functions import text as T
from folium.operators import forms
from folium.operators.palette import DEFAULT, Palette
from folium.sources import archives, biff, cfb, korean, olddoc, oldslides, pdf, rtf, sheets, slides, textdocs, word, wordview
from folium.sources.markup import html_nodes


class UnsupportedError(NotImplementedError):
    """What a format does not do."""


@dataclass(frozen=True)
class Adapter:
    """preview: files -> (doc_id, html); encode: files -> (doc_id, html, ..); decode: (files, edited) -> (doc_id, content, error)."""

    name: str
    container: str
    round_trip: bool
    preview: Callable[[DataFrame], DataFrame] | None = None
    encode: Callable[[DataFrame], DataFrame] | None = None
    decode: Callable[[DataFrame, DataFrame], DataFrame] | None = None


def _texts(files: DataFrame) -> DataFrame:
    return files.select(F.col("doc_id").cast("string").alias("doc_id"), textdocs.text_of(F.col("content")).alias("text"))


def _bytes(texts: DataFrame) -> DataFrame:
    error = F.col("error") if "error" in texts.columns else F.lit(None).cast("string")
    return texts.select("doc_id", F.encode("text", "UTF-8").alias("content"), error.alias("error"))


def _zipped(parts: DataFrame, changed: DataFrame) -> DataFrame:
    """Files of parts with those of changed put in; an error leaves its file out."""
    bad = changed.where("error is not null").select("doc_id", "error") if "error" in changed.columns else changed.select("doc_id", F.lit("").alias("error")).where("false")
    new = changed.where("content is not null").select("doc_id", "part", "content")
    good = archives.zipped(archives.with_edits(parts.where("error is null"), new).join(bad.select("doc_id"), "doc_id", "left_anti"))
    return good.select("doc_id", "content", F.lit(None).cast("string").alias("error")).union(bad.select("doc_id", F.lit(None).cast("binary"), "error"))


def _compound(streams: DataFrame, changed: DataFrame) -> DataFrame:
    bad = changed.where("error is not null").select("doc_id", "error")
    new = changed.where("content is not null").select("doc_id", "part", "content")
    good = cfb.compound(archives.with_edits(streams.where("error is null"), new).join(bad.select("doc_id"), "doc_id", "left_anti"))
    return good.select("doc_id", "content", F.lit(None).cast("string").alias("error")).union(bad.select("doc_id", F.lit(None).cast("binary"), "error"))


def _ids(edited: DataFrame, name: str, to: str) -> DataFrame:
    """doc_id, the ids of an attribute, text of edited (doc_id, html): deep texts, line breaks as line ends."""
    nodes = html_nodes(edited)
    own = nodes.where(F.map_contains_key("attrs", F.lit(name))).select("doc_id", "node", F.try_element_at("attrs", F.lit(name)).alias(to))
    below = nodes.where("tag in ('#text', 'br')").select("doc_id", F.explode("path").alias("node"), F.col("node").alias("at"), F.when(F.col("tag") == "br", "\n").otherwise(F.col("text")).alias("t"))
    text = below.groupBy("doc_id", "node").agg(F.array_join(F.array_sort(F.collect_list(F.struct("at", "t")))["t"], "").alias("text"))
    found = own.join(text, ["doc_id", "node"], "left").select("doc_id", to, "node", F.coalesce("text", F.lit("")).alias("text"))
    return found.groupBy("doc_id", to).agg(F.max_by("text", "node").alias("text"))


def _xls_decode(files: DataFrame, edited: DataFrame) -> DataFrame:
    streams = cfb.streams_of(files)
    at = F.split("id", ":")
    edits = _ids(edited, "data-cell", "id").select("doc_id", at[0].cast("int").alias("sheet_no"), at[1].cast("int").alias("row"), at[2].cast("int").alias("col"), "text")
    new = biff.edited_books(biff.workbook(streams), edits).withColumn("part", F.lit("Workbook")).withColumn("error", F.lit(None).cast("string"))
    return _compound(streams, new.select("doc_id", "part", "content", "error"))


def xls_encoded(files: DataFrame) -> DataFrame:
    """doc_id, html: text cells may be edited, others are read-only; a cell's id is sheet:row:col by number."""
    own = biff.cells(biff.books_of(files))
    size = own.groupBy("doc_id", "sheet_no", "sheet").agg((F.max("row") + 1).cast("long").alias("rows"), (F.max("col") + 1).cast("long").alias("cols"))
    every = sheets.grid(size).join(own.drop("sheet", "ref"), ["doc_id", "sheet_no", "row", "col"], "left")
    name = F.concat_ws(":", F.col("sheet_no").cast("string"), F.col("row").cast("string"), F.col("col").cast("string"))
    fixed = F.when(F.coalesce(F.col("type"), F.lit("")) == "text", F.lit("")).otherwise(F.lit(' data-ro="1"'))
    td = F.concat(F.lit('<td data-cell="'), name, F.lit('"'), fixed, F.lit(">"), T.escape(F.coalesce("text", F.lit(""))), F.lit("</td>"))
    rows = every.groupBy("doc_id", "sheet_no", "sheet", "row").agg(F.array_join(F.array_sort(F.collect_list(F.struct("col", td.alias("x"))))["x"], "").alias("x"))
    body = rows.groupBy("doc_id", "sheet_no", "sheet").agg(F.array_join(F.array_sort(F.collect_list(F.struct("row", F.concat(F.lit("<tr>"), "x", F.lit("</tr>")).alias("x"))))["x"], "").alias("x"))
    section = F.concat(F.lit('<section class="xls-sheet"><h2>'), T.escape("sheet"), F.lit("</h2><table><tbody>"), "x", F.lit("</tbody></table></section>"))
    out = body.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("sheet_no", section.alias("x"))))["x"], "\n").alias("x"))
    return out.select("doc_id", F.concat(F.lit('<div class="xls-doc">\n'), "x", F.lit("\n</div>")).alias("html"))


def xls_previews(files: DataFrame) -> DataFrame:
    books = biff.books_of(files)
    own = biff.cells(books).select("doc_id", "sheet_no", "sheet", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.lit(None).cast("int").alias("style"), "text")
    places = own.where("false").select("doc_id", "sheet_no", "sheet", F.lit("").alias("kind"), *(F.lit(0).cast("long").alias(c) for c in ("r1", "c1", "r2", "c2")), F.lit(0).alias("px"))
    return sheets.drawn(biff.sheets(books).select("doc_id", "sheet_no", "sheet"), own, places, None, None, "spreadsheet")


def adapters(palette: Palette = DEFAULT) -> dict[str, Adapter]:
    """Formats by name. palette: that of Word documents."""
    parts, streams = archives.parts_of, cfb.streams_of
    good = lambda f: parts(f).where("error is null")
    hangul = korean.palette_of([], "hwpx")
    rows = (
        Adapter("docx", "zip", True, lambda f: wordview.previews(good(f)), lambda f: word.encoded(good(f), palette), lambda f, e: _zipped(parts(f), word.decoded(good(f), e, palette))),
        Adapter("xlsx", "zip", True, lambda f: sheets.previews(good(f)), sheets.encoded_of, sheets.decoded_of),
        Adapter("pptx", "zip", True, lambda f: slides.previews(good(f)), lambda f: slides.encoded(good(f)), lambda f, e: _zipped(parts(f), slides.decoded(good(f), _ids(e, "data-run", "run_id")))),
        Adapter("hwpx", "zip", True, lambda f: korean.previews(korean.hwpx_encoded(good(f), hangul)), lambda f: korean.hwpx_encoded(good(f), hangul), lambda f, e: _zipped(parts(f), korean.hwpx_decoded(good(f), e, hangul))),
        Adapter("hwp", "cfb", True, lambda f: korean.previews(korean.hwp_encoded(streams(f), hangul)), lambda f: korean.hwp_encoded(streams(f), hangul), lambda f, e: _compound(streams(f), korean.hwp_decoded(streams(f), e, hangul))),
        Adapter("xls", "cfb", True, xls_previews, xls_encoded, _xls_decode),
        Adapter("ppt", "cfb", True, lambda f: oldslides.previews(streams(f)), lambda f: oldslides.encoded(streams(f)), lambda f, e: _compound(streams(f), oldslides.decoded(streams(f), _ids(e, "data-atom", "atom_id"), grow=True))),
        Adapter("doc", "cfb", True, lambda f: olddoc.previews(streams(f)), lambda f: olddoc.encoded(streams(f)), lambda f, e: _compound(streams(f), olddoc.decoded(streams(f), _ids(e, "data-piece", "para_id"), grow=True))),
        Adapter("pdf", "pdf", False, pdf.previews),
        Adapter("rtf", "text", True, lambda f: rtf.rtf_html(rtf.rtf_runs(f), False).select("doc_id", T.page(F.lit("rtf"), F.col("html"), textdocs.CSS["rtf"]).alias("html")), lambda f: rtf.rtf_html(rtf.rtf_runs(f)), lambda f, e: rtf.rtf_edited(f, rtf.edited_runs(html_nodes(e))).select("doc_id", "content", F.lit(None).cast("string").alias("error"))),
        Adapter("csv", "text", True, lambda f: textdocs.csv_preview(_texts(f)), lambda f: textdocs.csv_encoded(_texts(f)), lambda f, e: _bytes(textdocs.csv_decoded(_with_native(f, e, textdocs.csv_encoded)))),
        Adapter("txt", "text", True, lambda f: textdocs.txt_preview(_texts(f)), lambda f: textdocs.txt_encoded(_texts(f)), lambda f, e: _bytes(textdocs.txt_decoded(_with_native(f, e, textdocs.txt_encoded)))),
        Adapter("md", "text", True, lambda f: textdocs.markdown_encoded(_texts(f)).select("doc_id", T.page(F.lit("md"), F.col("html")).alias("html")), lambda f: textdocs.markdown_encoded(_texts(f)), lambda f, e: _bytes(textdocs.markdown_decoded(e))),
        Adapter("html", "text", True, lambda f: textdocs.html_preview(_texts(f)), lambda f: _texts(f).select("doc_id", T.html_encode(F.col("text")).alias("html")), lambda f, e: _bytes(_texts(f).join(e.select("doc_id", F.col("html").alias("new")), "doc_id").select("doc_id", T.html_decode(F.col("text"), F.col("new")).alias("text")))),
    )
    return {a.name: a for a in rows}


def _with_native(files: DataFrame, edited: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return edited.select("doc_id", "html").join(encode(_texts(files)).select("doc_id", "native"), "doc_id")


def adapter(name: str, known: dict[str, Adapter] | None = None) -> Adapter:
    found = (known or adapters()).get(name)
    if found is None:
        raise KeyError(f"no adapter for {name}")
    return found


def formats(spark: SparkSession) -> DataFrame:
    """name, container, round_trip of all formats."""
    return spark.createDataFrame([(a.name, a.container, a.round_trip) for a in adapters().values()], "name string, container string, round_trip boolean")


def routed(files: DataFrame, hint: Column | None = None) -> DataFrame:
    """files (doc_id, content) with container, format and route_error; a name or format may be given as a hint for texts.

    Containers are opened for what they hold: parts of zips, streams of compound files.
    """
    doc = files.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("container", D.container(F.col("content")))
    zips = archives.parts_of(doc.where("container = 'zip'").select("doc_id", "content"))
    small = F.when(F.col("part").isin("mimetype", "[Content_Types].xml"), F.col("content").cast("string"))
    told = zips.where("error is null").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("part"), F.coalesce(small, F.lit(""))))).alias("parts")).select("doc_id", _zip_name(F.col("parts")).alias("zip"))
    inner = cfb.streams_of(doc.where("container = 'cfb'").select("doc_id", "content")).where("error is null")
    paths = inner.groupBy("doc_id").agg(F.collect_list("part").alias("paths"))
    old = paths.select("doc_id", F.when(F.array_contains("paths", "FileHeader"), "hwp").otherwise(D.cfb_format(F.col("paths"))).alias("cfb"))
    text = textdocs.text_of(F.col("content"))
    asked = D.name_format(hint) if hint is not None else F.lit(None).cast("string")
    texts = F.when(D.is_rtf(F.col("content")), "rtf").otherwise(F.when(asked.isin("txt", "md", "html", "csv"), asked).otherwise(D.text_format(text)))
    out = doc.join(told, "doc_id", "left").join(old, "doc_id", "left")
    kind = F.when(F.col("container") == "zip", F.col("zip")).when(F.col("container") == "cfb", F.col("cfb")).when(F.col("container") == "pdf", "pdf").when(F.col("container") == "text", texts)
    out = out.withColumn("format", kind).drop("zip", "cfb")
    return out.withColumn("route_error", F.when(F.col("format").isNull(), F.concat(F.lit("no format for a file of container "), "container")))


def _zip_name(parts: Column) -> Column:
    return D.zip_format(parts)


def opened(files: DataFrame, hint: Column | None = None) -> DataFrame:
    """doc_id, format of files; ? where there is none, never an error."""
    return routed(files, hint).select("doc_id", F.coalesce("format", F.lit("?")).alias("format"))


def by_format(files: DataFrame, work: Callable[[Adapter, DataFrame], DataFrame | None], hint: Column | None = None, known: dict[str, Adapter] | None = None) -> DataFrame:
    """The union of work(adapter, its files) over all formats; other files are rows with an error. One pass over the files for each format."""
    known = known or adapters()
    kept = routed(files, hint).select("doc_id", "content", "format", "route_error")
    out = kept.where(~F.coalesce(F.col("format").isin(list(known)), F.lit(False))).select("doc_id", F.lit(None).cast("string").alias("html"), F.coalesce("route_error", F.lit("no adapter")).alias("error"))
    for name, a in known.items():
        own = kept.where(F.col("format") == name).select("doc_id", "content")
        made = work(a, own)
        if made is None:
            made = own.select("doc_id", F.lit(None).cast("string").alias("html"), F.lit(f"{name} cannot do this").alias("error"))
        error = F.col("error") if "error" in made.columns else F.lit(None).cast("string")
        out = out.union(made.select("doc_id", "html", error.alias("error")))
    return out


def previews(files: DataFrame, hint: Column | None = None) -> DataFrame:
    """doc_id, html, error of files of any format."""
    return by_format(files, lambda a, f: a.preview(f) if a.preview else None, hint)


def editable(files: DataFrame, hint: Column | None = None) -> DataFrame:
    """doc_id, html, error: markup to edit; formats that cannot be written back are refused."""
    return by_format(files, lambda a, f: a.encode(f) if a.round_trip and a.encode else None, hint)


def previewed_again(edited: DataFrame, title: str = "edited") -> DataFrame:
    """doc_id, html: edited markup as a page."""
    return edited.select("doc_id", T.page(F.lit(title), F.col("html")).alias("html"))


def restored(files: DataFrame, edited: DataFrame, name: str) -> DataFrame:
    """doc_id, content, error, ext of edited documents of one format."""
    a = adapter(name)
    if not a.round_trip or a.decode is None:
        raise UnsupportedError(f"{name} cannot be written back")
    return a.decode(files, edited).withColumn("ext", F.lit(name))


# Filling forms.

#: A filler takes prompts (doc_id, prompt) and gives replies (doc_id, reply).
Filler = Callable[[DataFrame], DataFrame]


class Client:
    """A chat service that answers in JSON: asked at temperature 0, once more at 0.4 if the answer cannot be read.

    send(prompt, temperature) gives the answer's text; it is called in the workers, a row at a time, as services are.
    """

    def __init__(self, send: Callable[[str, float], str], attempts: int = 2, again: float = 0.4):
        self.send, self.attempts, self.again = send, attempts, again

    def ask(self, prompt: str) -> str | None:
        for i in range(self.attempts):
            text = self.send(prompt, 0.0 if i == 0 else self.again)
            try:
                if isinstance(json.loads(text), dict):
                    return text
            except ValueError:
                continue
        return text

    def __call__(self, prompts: DataFrame) -> DataFrame:
        ask = self.ask

        def run(frames: Iterator) -> Iterator:
            for pdf in frames:
                yield pdf[["doc_id"]].assign(reply=[ask(p) for p in pdf["prompt"]])

        return prompts.select("doc_id", "prompt").mapInPandas(run, "doc_id string, reply string")


def gathered(chunks: Iterable[str]) -> tuple[str, dict]:
    """(answer, figures) of a streamed reply: one JSON object a line, parts of lines joined, lines that cannot be read left out."""
    held, text, figures = "", "", {}
    for chunk in [*chunks, "\n"]:
        *lines, held = (held + chunk).split("\n")
        for line in lines:
            try:
                x = json.loads(line)
            except ValueError:
                continue
            text += x.get("message", {}).get("content", "") if isinstance(x, dict) else ""
            if isinstance(x, dict) and x.get("done"):
                figures = {k: v for k, v in x.items() if isinstance(v, int | float) and not isinstance(v, bool)}
    return text.strip(), figures


def composed(files: DataFrame, material: DataFrame, name: str, filler: Filler, labelled: bool = True) -> DataFrame:
    """doc_id, content, error of files of one format filled from material (doc_id, material): encode, ask, fill, decode.

    labelled: slots are told with their labels and only those that want a value; else all of them, plainly. PDF pages are
    filled run by run.
    """
    if name == "pdf":
        own = pdf.slots(files)
        ask = own.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("slot_id").alias("id"), "role", "text")).alias("slots"))
        prompts = ask.join(material, "doc_id").select("doc_id", F.to_json(F.struct("slots", "material")).alias("prompt"))
        return pdf.filled(files, forms.answers(filler(prompts)))
    a = adapter(name)
    if a.encode is None or a.decode is None:
        raise UnsupportedError(f"{name} cannot be written back")
    html = a.encode(files).select("doc_id", "html")
    given = forms.answers(filler(forms.prompt(forms.read(html), material, labelled)))
    edited = forms.filled_in(html, "html", given).select("doc_id", F.col("markup").alias("html"))
    return a.decode(files, edited)
