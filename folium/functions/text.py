"""Text, HTML and CSV as column expressions."""

from __future__ import annotations

import html as entities
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folium.functions.detect import DELIMITERS, SPACE

BOM = "﻿"
NEWLINE = "\r\n|\r|\n"
#: Named entities of visible text.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
#: Characters that are body text and not symbols, as a character class body.
PLAIN = (
    r"\x{0}-\x{A0}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{1100}-\x{11FF}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}"
    r"\x{3000}\x{3130}-\x{318F}\x{3400}-\x{9FFF}\x{A960}-\x{A97F}\x{AC00}-\x{D7A3}\x{D7B0}-\x{D7FF}\x{F900}-\x{FAFF}\x{FEFF}"
    r"\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{20000}-\x{2FFFF}"
)
#: Inline tags that the sanitiser allows again.
INLINE = ("strong", "em", "u", "s")


def swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def escape(text: Column) -> Column:
    return swap(text, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def escape_attribute(text: Column) -> Column:
    return swap(text, ("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;"))


def unescape(text: Column) -> Column:
    """Five entities, &amp; last."""
    return swap(text, ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def character(code: Column) -> Column:
    """Character of a code point; empty outside Unicode and for surrogates."""
    good = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(F.lit(32))), 8, "0")), "UTF-32")).otherwise("")


def numeric_entities(text: Column) -> Column:
    """&#x..; and &#..; as characters; texts without any are left as they are."""
    def one(t: Column, pattern: str, base: int) -> Column:
        pieces, found = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
        safe = lambda d: F.when(F.length(F.regexp_replace(d, "^0+", "")) > 7, F.lit(0)).otherwise(F.conv(F.when(F.length(F.regexp_replace(d, "^0+", "")) > 7, F.lit("0")).otherwise(d), base, 10).cast("bigint"))
        joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(character(safe(F.get(found, i))), F.lit("")))), "")
        return F.when(F.rlike(t, F.lit(pattern)), joined).otherwise(t)

    both = lambda t: let(one(t, "&#[xX]([0-9a-fA-F]+);", 16), lambda x: one(x, "&#([0-9]+);", 10))
    return let(text, lambda t: F.when(t.contains("&#"), both(t)).otherwise(t))


def visible(html: Column) -> Column:
    """Text of HTML: no styles and scripts, tags as a space, entities decoded."""
    t = F.regexp_replace(html, r"(?is)<style\b[^>]*>.*?</style>|<script\b[^>]*>.*?</script>", " ")
    t = numeric_entities(F.regexp_replace(t, r"<[^>]+>", " "))
    # One pass over names, so that what an entity yields is not read again.
    pattern = f"(?i)&({'|'.join(ENTITIES)});"
    value = F.create_map(*(F.lit(x) for kv in ENTITIES.items() for x in kv))

    def named(x: Column) -> Column:
        names = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
        pieces = F.transform(F.arrays_zip(F.split(x, pattern, -1).alias("p"), names.alias("n")), lambda z: F.concat(z["p"], F.coalesce(F.try_element_at(value, F.lower(z["n"])), F.lit(""))))
        return F.when(x.contains("&"), F.array_join(pieces, "")).otherwise(x)

    return let(t, named)


def sanitize_inline(text: Column) -> Column:
    """Escaped, with line ends as <br/> and the inline tags allowed again."""
    t = F.regexp_replace(escape(text), "\r?\n", "<br/>")
    for tag in INLINE:
        t = swap(t, (f"&lt;{tag}&gt;", f"<{tag}>"), (f"&lt;/{tag}&gt;", f"</{tag}>"))
    return F.regexp_replace(t, rf"&lt;br[{SPACE}]*/?&gt;", "<br/>")


def symbols(text: Column) -> Column:
    """Array of the special symbols of a text, in order."""
    return F.filter(F.split(F.regexp_replace(text, f"[{PLAIN}]", ""), ""), lambda c: c != "")


def squeeze(text: Column) -> Column:
    """No-break spaces and line ends as spaces, trimmed."""
    return F.regexp_replace(F.regexp_replace(text, "[ \r\n]+", " "), f"^[{SPACE}]+|[{SPACE}]+\\z", "")


# Plain text.


def lines(text: Column) -> Column:
    return F.split(text, NEWLINE, -1)


def crlf(text: Column) -> Column:
    """Whether the first line feed follows a carriage return."""
    at = F.instr(text, "\n")
    return (at > 1) & (F.substring(text, at - 1, F.lit(1)) == "\r")


def txt_encode(text: Column) -> Column:
    """A paragraph for each line."""
    body = escape(F.regexp_replace(text, f"^{BOM}", ""))
    # Line ends become the seams between paragraphs, over the whole text at once.
    joined = F.regexp_replace(body, NEWLINE, "</p>\n<p class=\"txt-line\">")
    return F.concat(F.lit('<p class="txt-line">'), joined, F.lit("</p>"))


class _Blocks(HTMLParser):
    """Texts of the paragraphs and divisions in the order in which they open, a nested one also in those around it; and the whole text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.lines, self.blocks, self.open, self.whole = [], [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "div"):
            if self.open and self.open[-1][0] == "p":
                self.open.pop()
            block = (tag, [])
            self.blocks.append(block[1])
            if tag == "p" and "txt-line" in (dict(attrs).get("class") or "").split():
                self.lines.append(block[1])
            self.open.append(block)
        elif tag == "br":
            self.handle_data("\n")

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        for x in (self.whole, *(x for _, x in self.open)):
            x.append(data)

    def handle_entityref(self, name):
        self.handle_data(entities.unescape(f"&{name};"))

    def handle_charref(self, name):
        self.handle_data(entities.unescape(f"&#{name};"))


def edited_text(html: str) -> str:
    """Lines of edited HTML: its p.txt-line, else its p and div blocks, else all its text."""
    def read(x: str) -> _Blocks:
        out = _Blocks()
        out.feed(x)
        out.close()
        return out

    found = read(re.sub(r"(?i)<br\s*/?>(?:\r?\n)?", "<br>", html))
    blocks = found.lines or found.blocks
    return "\n".join("".join(x) for x in blocks) if blocks else "".join(read(html).whole)


@F.pandas_udf(StringType())
def _edited_text(html: pd.Series) -> pd.Series:
    return html.map(edited_text, na_action="ignore")


#: HTML as txt_encode writes it: nothing but lines.
_ENCODED = r'(?s)\A<p class="txt-line">[^<>]*</p>(?:\n<p class="txt-line">[^<>]*+</p>)*+\z'


def txt_decode(html: Column, eol: Column, bom: Column) -> Column:
    """The lines' text, joined by eol; edited HTML is parsed."""
    as_made = F.rlike(html, F.lit(_ENCODED))
    seam = '</p>\n<p class="txt-line">'
    inner = F.replace(F.substring(html, F.lit(len(seam) - 4), F.length(html) - (len(seam) - 1)), F.lit(seam), F.lit("\n"))
    text = F.when(as_made, unescape(inner)).otherwise(_edited_text(F.when(~as_made, html)))
    pieces = F.array_join(F.split(text, NEWLINE, -1), "\n")
    return F.concat(F.when(bom, BOM).otherwise(""), F.replace(pieces, F.lit("\n"), eol))


# HTML shells.

_SHELL = r"(?is)\A(.*<body\b[^>]*>)(.*)(</body>.*)\z"


def shell(html: Column) -> Column:
    """(prefix, body, suffix, full) of a document; all is body if there is none."""
    has = F.rlike(html, F.lit(_SHELL))
    part = lambda i: F.regexp_extract(html, _SHELL, i)
    return F.struct(
        F.when(has, part(1)).otherwise("").alias("prefix"), F.when(has, part(2)).otherwise(html).alias("body"),
        F.when(has, part(3)).otherwise("").alias("suffix"), (has | F.rlike(html, F.lit(rf"(?i)<html[{SPACE}>]"))).alias("full"),
    )


def html_encode(html: Column) -> Column:
    body = shell(F.regexp_replace(html, f"^{BOM}", ""))["body"]
    return F.when(F.rlike(body, F.lit(f"[^{SPACE}]")), body).otherwise("")


def html_decode(source: Column, edited: Column) -> Column:
    """The source with its body replaced."""
    plain = F.regexp_replace(source, f"^{BOM}", "")
    s = shell(plain)
    return F.concat(F.when(source.startswith(BOM), BOM).otherwise(""), F.when(s["full"], F.concat(s["prefix"], edited, s["suffix"])).otherwise(edited))


def page(title: Column, body: Column, css: str = "") -> Column:
    """A self-contained HTML page."""
    return F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), escape(title), F.lit(f"</title><style>{css}</style></head><body>\n"), body, F.lit("\n</body></html>"))


# CSV.


def first_record(text: Column) -> Column:
    """Up to the first line end outside quotes."""
    def of(pieces: Column) -> Column:
        at = F.array_position(F.transform(pieces, lambda p, i: (i % 2 == 0) & F.rlike(p, F.lit("[\r\n]"))), True).cast("int")
        cut = F.concat(F.slice(pieces, F.lit(1), F.greatest(at - 1, F.lit(0))), F.array(F.regexp_extract(F.get(pieces, at - 1), r"^[^\r\n]*", 0)))
        return F.array_join(F.when(at > 0, cut).otherwise(pieces), '"')

    return let(F.split(text, '"', -1), of)


def sniff_delimiter(text: Column) -> Column:
    """The most frequent delimiter of the first record; ties to the earlier one."""
    record = first_record(text)
    counts = F.array(*(F.struct((F.length(record) - F.length(F.replace(record, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("turn"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)))
    return F.array_max(counts)["d"]


def quote_field(value: Column, delimiter: Column) -> Column:
    needed = value.contains('"') | F.contains(value, delimiter) | value.contains("\n") | value.contains("\r")
    return F.when(needed, F.concat(F.lit('"'), swap(value, ('"', '""')), F.lit('"'))).otherwise(value)


def csv_text(rows: Column, delimiter: str = ",", eol: str = "\r\n") -> Column:
    """Rows (array of arrays) as CSV, without a line end after the last."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda v: quote_field(v, F.lit(delimiter))), delimiter)), eol)


def csv_cell_html(value: Column) -> Column:
    return F.regexp_replace(escape(value), NEWLINE, "<br>")


def csv_grid_html(rows: Column) -> Column:
    """An editable table."""
    cell = lambda v: F.concat(F.lit("<td>"), csv_cell_html(v), F.lit("</td>"))
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))), "")
    return F.concat(F.lit('<table class="csv-grid">'), body, F.lit("</table>"))


# Fill targets.


def is_fill_target(text: Column) -> Column:
    return ~F.rlike(text, F.lit(f"[^{SPACE}]")) | F.rlike(text, F.lit(f"[:：][{SPACE}]*\\z"))


def self_label(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, f"\\A([^\\n\\r\\u2028\\u2029]{{1,40}}?)[{SPACE}]*[:：][{SPACE}]*\\z", 1), f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def is_fill_field(text: Column, label: Column) -> Column:
    return is_fill_target(text) | ((label != "") & (F.length(text) <= 40))
