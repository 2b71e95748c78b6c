"""Format detection as column expressions, all JVM-side: containers by magic bytes, text formats by content, names by extension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the text rules, as a character class body.
SPACE = r"\t\n\x0B\f\r    -     　﻿"
#: File extensions and their formats.
EXTENSIONS = {
    "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "doc": "doc", "ppt": "ppt", "xls": "xls", "hwpx": "hwpx", "hwp": "hwp",
    "pdf": "pdf", "csv": "csv", "htm": "html", "html": "html", "xhtml": "html", "md": "md", "markdown": "md", "mdown": "md",
    "mkd": "md", "txt": "txt", "text": "txt", "log": "txt", "rtf": "rtf",
}
#: Any of these makes a text Markdown.
MARKDOWN = (
    rf"(?m)^#{{1,6}}[{SPACE}]+[^{SPACE}]",
    r"(?m)^(```|~~~)",
    rf"(?m)^[{SPACE}]*[-*+][{SPACE}]+[^{SPACE}]",
    rf"(?m)^[{SPACE}]*[0-9]+\.[{SPACE}]+[^{SPACE}]",
    rf"(?m)^>[{SPACE}]+[^{SPACE}]",
    rf"\[[^\]]+\]\([^){SPACE}]+\)",
    rf"\*\*[^{SPACE}][^*_]*\*\*|__[^{SPACE}][^*_]*__",
    rf"(?m)^[{SPACE}]*\|?[{SPACE}]*:?-{{3,}}:?[{SPACE}]*\|",
)
#: Delimiters in order of preference, and tags that open an HTML fragment.
DELIMITERS = (",", ";", "\t", "|")
HTML_TAGS = "html|head|body|div|p|table|section|article|main|nav|header|footer|ul|ol|h[1-6]|meta|title|link|style|script"
SAMPLE, LINES = 65536, 20


def latin1(content: Column, n: int) -> Column:
    return F.decode(F.substring(content, 1, n), "ISO-8859-1")


def is_zip(content: Column) -> Column:
    return F.substring(content, 1, 2) == F.lit(b"PK")


def is_cfb(content: Column) -> Column:
    return F.substring(content, 1, 8) == F.lit(bytes.fromhex("D0CF11E0A1B11AE1"))


def is_pdf(content: Column) -> Column:
    return F.instr(latin1(content, 1028), "%PDF") > 0


def is_text(content: Column) -> Column:
    """Not empty and no NUL in the first 4096 bytes."""
    return (F.length(content) > 0) & (F.instr(latin1(content, 4096), "\0") == 0)


def is_rtf(content: Column) -> Column:
    return F.rlike(latin1(content, 4096), F.lit("^(\xef\xbb\xbf)?[ \\t\\r\\n]*\\{\\\\rtf"))


def container(content: Column) -> Column:
    """zip, cfb, pdf, text or unknown, in this order."""
    return F.when(is_zip(content), "zip").when(is_cfb(content), "cfb").when(is_pdf(content), "pdf").when(is_text(content), "text").otherwise("unknown")


def strip_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^﻿", "")


def is_markdown(text: Column) -> Column:
    out = F.rlike(text, F.lit(MARKDOWN[0]))
    for p in MARKDOWN[1:]:
        out = out | F.rlike(text, F.lit(p))
    return out


def outside_quotes(line: Column, delimiter: str) -> Column:
    """Number of delimiters outside double quotes."""
    pieces = F.filter(F.split(line, '"', -1), lambda x, i: i % 2 == 0)
    return F.aggregate(pieces, F.lit(0), lambda n, x: n + F.length(x) - F.length(F.replace(x, F.lit(delimiter), F.lit(""))))


def _once(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _all_counts(line: Column) -> Column:
    """Numbers of all delimiters outside double quotes, counted together; only a line with quotes is taken apart."""
    outside = F.when(line.contains('"'), F.array_join(F.filter(F.split(line, '"', -1), lambda x, i: i % 2 == 0), "")).otherwise(line)
    return _once(outside, lambda x: F.array(*(F.length(x) - F.length(F.replace(x, F.lit(d), F.lit(""))) for d in DELIMITERS)))


def is_csv(text: Column) -> Column:
    """Some delimiter stands equally often, at least once, on each of the first lines that are not blank."""
    lines = F.slice(F.filter(F.split(text, "\r\n|\r|\n", -1), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]"))), 1, LINES)

    def steady(counts: Column) -> Column:
        first = F.get(counts, F.lit(0))

        def of(i: int) -> Column:
            return (F.get(first, F.lit(i)) >= 1) & F.forall(counts, lambda c: F.get(c, F.lit(i)) == F.get(first, F.lit(i)))

        out = of(0)
        for i in range(1, len(DELIMITERS)):
            out = out | of(i)
        return out

    # A text without any delimiter is not taken apart.
    return F.rlike(text, F.lit("[,;\t|]")) & F.coalesce(_once(F.transform(lines, _all_counts), steady), F.lit(False))


def text_format(text: Column) -> Column:
    """html, md, csv or txt by the first 64 K bytes; a character that is cut there reads as unknown."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, SAMPLE).cast("string"))
    # Few texts are that long: the others are not encoded.
    sample = strip_bom(F.when(F.octet_length(text) > SAMPLE, cut).otherwise(text))

    def kind(sample: Column) -> Column:
        trimmed = F.regexp_replace(F.substring(sample, 1, 4096), f"^[{SPACE}]+", "")
        trimmed = F.when(F.length(trimmed) > 64, trimmed).otherwise(F.regexp_replace(sample, f"^[{SPACE}]+", ""))
        lower = F.lower(F.substring(trimmed, 1, 64))
        html = lower.startswith("<!doctype html") | lower.startswith("<html") | lower.startswith("<?xml")
        html = sample.contains("<") & (html | F.rlike(trimmed, F.lit(rf"(?i)^<({HTML_TAGS})[{SPACE}>/]")))
        return F.when(html, "html").when(is_markdown(sample), "md").when(is_csv(sample), "csv").otherwise("txt")

    return _once(sample, kind)


def name_format(name: Column) -> Column:
    """Format by extension; null if unknown."""
    ext = F.lower(F.regexp_extract(name, rf"(?i)\.([a-z0-9]+)[{SPACE}]*\z", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv)), ext)


def zip_format(parts: Column) -> Column:
    """hwpx, docx, pptx or xlsx; parts: map of path to text of the small parts, with every path as a key."""
    paths, types = F.map_keys(parts), F.coalesce(F.try_element_at(parts, F.lit("[Content_Types].xml")), F.lit(""))
    under = lambda p: F.exists(paths, lambda x: x.startswith(p))
    hwpx = (F.btrim(F.coalesce(F.try_element_at(parts, F.lit("mimetype")), F.lit(""))) == "application/hwp+zip") | F.array_contains(paths, "Contents/section0.xml") | F.array_contains(paths, "Contents/header.xml")
    return (
        F.when(hwpx, "hwpx").when(types.contains("wordprocessingml.document.main"), "docx").when(types.contains("presentationml.presentation.main"), "pptx")
        .when(types.contains("spreadsheetml.sheet.main"), "xlsx").when(under("word/"), "docx").when(under("ppt/"), "pptx").when(under("xl/"), "xlsx")
    )


def cfb_format(paths: Column) -> Column:
    """hwp, xls, ppt or doc by the names of streams (array of paths)."""
    has = lambda *names: F.exists(paths, lambda p: p.isin(*names))
    return F.when(has("FileHeader"), "hwp").when(has("Workbook", "Book"), "xls").when(has("PowerPoint Document"), "ppt").when(has("WordDocument"), "doc")


def route(content: Column, text: Column, hint: Column) -> Column:
    """Format of a text or pdf file: RTF by its magic, then a hint that names a text format, then content; null otherwise."""
    kind = container(content)
    trusted = F.when(hint.isin("csv", "html", "md", "txt"), hint)
    return F.when(kind == "pdf", "pdf").when((kind == "text") & is_rtf(content), "rtf").when(kind == "text", F.coalesce(trusted, text_format(text)))
