"""Old Word documents (WordDocument and table streams of a compound file): pieces and paragraphs as a relation, and edits.

Text lies in pieces that a table lists, each in one byte or two a character. An edit that keeps a piece's size is written in place. One
that does not splits the piece at what differs, puts the new characters at the stream's end and writes a new piece table; character
positions behind it move.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.functions.codecs import common_ends
from folium.functions.text import escape, page
from folium.sources.word import rows_of

STREAM = "WordDocument"
#: Offsets within the file information block.
MAGIC, FLAGS, TEXT_MIN, TEXT_MAX, TEXT_CHARS, CLX = 0xA5EC, 0x0A, 0x18, 0x1C, 0x4C, 0x1A2
#: Tables of character positions that move with the text (offset of their place, bytes of an entry beside its position).
PLEXES = {"sections": (0xCA, 12), "headers": (0xF2, 0), "shapes": (0x1DA, 26)}
#: Other places kept by the block, by name.
PLACES = {"styles": 0xA2, "paragraph_formats": 0x102, "character_formats": 0xFA, "fonts": 0x11A, "lists": 0x2E2, "list_overrides": 0x2EA, "drawings": 0x22A, **{k: v for k, (v, _) in PLEXES.items()}, "pieces": CLX}


@dataclass
class Piece:
    first: int
    last: int
    narrow: bool
    at: int
    raw: bytes

    @property
    def size(self) -> int:
        return (self.last - self.first) * (1 if self.narrow else 2)


def block(main: bytes) -> dict:
    """The file information block: table (stream name), text_min, text_chars, and (offset, size) of each place."""
    if len(main) < CLX + 8 or struct.unpack_from("<H", main)[0] != MAGIC:
        raise ValueError("not a Word document")
    long = lambda at: struct.unpack_from("<I", main, at)[0] if at + 4 <= len(main) else 0
    return {"version": struct.unpack_from("<H", main, 2)[0], "table": "1Table" if struct.unpack_from("<H", main, FLAGS)[0] & 0x200 else "0Table", "text_min": long(TEXT_MIN), "text_chars": long(TEXT_CHARS), **{k: (long(v), long(v + 4)) for k, v in PLACES.items()}}


def piece_table(table: bytes, at: int, size: int) -> tuple[bytes, list[Piece]]:
    """(what stands before the table, pieces)."""
    end = at + size
    if end > len(table):
        raise ValueError("the piece table lies outside its stream")
    p = at
    while p + 3 <= end and table[p] == 1:
        p += 3 + struct.unpack_from("<H", table, p + 1)[0]
    if p + 5 > end or table[p] != 2:
        raise ValueError("no piece table")
    length = struct.unpack_from("<I", table, p + 1)[0]
    if p + 5 + length > len(table) or length % 12 != 4:
        raise ValueError("a broken piece table")
    n = length // 12
    places = struct.unpack_from(f"<{n + 1}I", table, p + 5)
    out = []
    for i in range(n):
        raw = table[p + 5 + 4 * (n + 1) + 8 * i :][:8]
        fc = struct.unpack_from("<I", raw, 2)[0]
        narrow = bool(fc & 0x40000000)
        out.append(Piece(places[i], places[i + 1], narrow, (fc & 0x3FFFFFFF) // (2 if narrow else 1), raw))
    return table[at:p], out


_HIGH = {bytes((b,)).decode("cp1252", "ignore") or chr(b): b for b in range(0x80, 0xA0)}


def piece_text(main: bytes, x: Piece) -> str:
    if x.at + x.size > len(main):
        raise ValueError("a piece lies outside its stream")
    data = main[x.at : x.at + x.size]
    if not x.narrow:
        return data.decode("utf-16-le", "surrogatepass")
    back = {b: c for c, b in _HIGH.items()}
    return "".join(back.get(b, chr(b)) for b in data)


def piece_bytes(text: str, narrow: bool) -> bytes | None:
    """None if a character does not fit one byte."""
    if not narrow:
        return text.encode("utf-16-le", "surrogatepass")
    codes = [_HIGH.get(c, ord(c)) for c in text]
    return bytes(codes) if all(c < 256 and (c < 0x80 or c >= 0xA0 or t in _HIGH) for c, t in zip(codes, text, strict=True)) else None


def documents(streams: DataFrame) -> DataFrame:
    """doc_id, parts: the main and table streams of cfb.streams_of()."""
    own = streams.where(F.col("part").isin(STREAM, "0Table", "1Table"))
    return own.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("part", "content"))).alias("parts"))


def _opened(parts) -> tuple[bytes, bytes, dict, bytes, list[Piece]]:
    parts = dict(parts)
    main = bytes(parts.get(STREAM) or b"")
    info = block(main)
    table = bytes(parts.get(info["table"]) or b"")
    before, found = piece_table(table, *info["pieces"])
    return main, table, info, before, found


def pieces(streams: DataFrame) -> DataFrame:
    """doc_id, piece, first, last (character positions), narrow, text; a document that cannot be read has one row, with its error."""

    def make(parts) -> list[dict]:
        main, _, _, _, found = _opened(parts)
        return [{"piece": i, "first": x.first, "last": x.last, "narrow": x.narrow, "text": piece_text(main, x)} for i, x in enumerate(found)]

    return rows_of(documents(streams), make, "doc_id string, piece int, first long, last long, narrow boolean, text string, error string", "parts")


def paragraphs(found: DataFrame) -> DataFrame:
    """doc_id, para_id (piece:place), piece, para, text of pieces(): split at paragraph ends, manual breaks as line ends; what follows a piece's last end is none if empty."""
    parts = F.split("text", "\r", -1)
    shown = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    each = found.where("error is null").select("doc_id", "piece", F.posexplode(shown).alias("para", "raw"))
    text = F.replace(F.replace("raw", F.lit("\x0b"), F.lit("\n")), F.lit("\0"), F.lit(""))
    return each.select("doc_id", F.concat_ws(":", F.col("piece").cast("string"), F.col("para").cast("string")).alias("para_id"), "piece", "para", text.alias("text"))


def _html(found: DataFrame, ids: bool) -> DataFrame:
    mark = F.concat(F.lit(' data-piece="'), "para_id", F.lit('"')) if ids else F.lit("")
    p = F.concat(F.lit("<p"), mark, F.lit(">"), F.replace(escape("text"), F.lit("\n"), F.lit("<br/>")), F.lit("</p>"))
    return found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("piece", "para", p.alias("x"))))["x"], "\n").alias("x"))


def encoded(streams: DataFrame) -> DataFrame:
    """doc_id, html: a paragraph for each, with its id."""
    return _html(paragraphs(pieces(streams)), True).select("doc_id", F.concat(F.lit('<div class="doc-doc">\n'), "x", F.lit("\n</div>")).alias("html"))


def previews(streams: DataFrame) -> DataFrame:
    """doc_id, html: the paragraphs as a page; without fields, cell ends and other marks."""
    clean = paragraphs(pieces(streams)).withColumn("text", F.regexp_replace("text", r"\x13[^\x14\x15]*\x14?|[\x00-\x08\x0c\x0e-\x1f]", ""))
    return _html(clean, False).select("doc_id", page(F.lit("document"), F.col("x"), "p{margin:0 0 .5em}").alias("html"))


def laid_out(main: bytes, table: bytes, info: dict, before: bytes, found: list[Piece], new: dict[int, str]) -> tuple[bytes, bytes]:
    """(main stream, table stream) with new texts for pieces, of any size."""
    added, rows, moves = b"", [], []
    raw = lambda x, at, narrow: x.raw[:2] + struct.pack("<I", (at * 2 | 0x40000000) if narrow else at) + x.raw[6:8]
    for i, x in enumerate(found):
        old = piece_text(main, x)
        if new.get(i, old) == old:
            rows.append((x.last - x.first, x.raw))
            continue
        start, old_end, new_end = common_ends(old, new[i])
        middle, unit = new[i][start:new_end], 1 if x.narrow else 2
        if start:
            rows.append((start, raw(x, x.at, x.narrow)))
        if middle:
            rows.append((len(middle), raw(x, len(main) + len(added), False)))
            added += middle.encode("utf-16-le", "surrogatepass")
        if old_end < len(old):
            rows.append((len(old) - old_end, raw(x, x.at + old_end * unit, x.narrow)))
        moves.append((x.first + start, len(new[i]) - len(old)))
    places = [0]
    for n, _ in rows:
        places.append(places[-1] + n)
    body = struct.pack(f"<{len(places)}I", *places) + b"".join(r for _, r in rows)
    clx = before + b"\x02" + struct.pack("<I", len(body)) + body
    out_main, out_table = bytearray(main + added), bytearray(table + clx)
    chars = info["text_chars"] + sum(d for _, d in moves)
    struct.pack_into("<i", out_main, TEXT_MAX, info["text_min"] + chars)
    struct.pack_into("<I", out_main, TEXT_CHARS, chars)
    struct.pack_into("<II", out_main, CLX, len(table), len(clx))
    for name, (_, entry) in PLEXES.items():
        at, size = info[name]
        n, rest = divmod(size - 4, 4 + entry)
        if at and size >= 8 and not rest and at + size <= len(table):
            for k in range(n + 1):
                was = struct.unpack_from("<I", out_table, at + 4 * k)[0]
                struct.pack_into("<I", out_table, at + 4 * k, was + sum(d for p, d in moves if p < was))
    return bytes(out_main), bytes(out_table)


def decoded(streams: DataFrame, edits: DataFrame, grow: bool = False) -> DataFrame:
    """doc_id, part, content, error of the streams of documents whose paragraphs change. edits: doc_id, para_id, text; others stay.

    Without grow an edit that changes a piece's size, or needs characters that its bytes cannot hold, is an error.
    """
    known = paragraphs(pieces(streams)).select("doc_id", "para_id", "piece", "para", F.col("text").alias("was"))
    change = known.join(edits.select("doc_id", "para_id", "text"), ["doc_id", "para_id"]).where(F.col("text") != F.col("was"))
    wanted = change.groupBy("doc_id").agg(F.collect_list(F.struct("piece", "para", "text")).alias("edits"))

    def make(parts, own) -> list[dict]:
        main, table, info, before, found = _opened(parts)
        texts: dict[int, list[str]] = {}
        for e in own:
            lines = texts.setdefault(e["piece"], piece_text(main, found[e["piece"]]).split("\r"))
            lines[e["para"]] = e["text"].replace("\n", "\x0b")
        new, placed = {}, bytearray(main)
        for i, lines in texts.items():
            text, x = "\r".join(lines), found[i]
            data = piece_bytes(text, x.narrow)
            if data is not None and len(data) == x.size:
                placed[x.at : x.at + x.size] = data
            elif grow:
                new[i] = text
            else:
                raise ValueError("text of another size; allow it to be laid out again")
        out_main, out_table = bytes(placed), table
        if new:
            out_main, out_table = laid_out(bytes(placed), table, info, before, found, new)
        return [{"part": STREAM, "content": out_main}, {"part": info["table"], "content": out_table}]

    return rows_of(documents(streams).join(wanted, "doc_id"), make, "doc_id string, part string, content binary, error string", "parts", "edits")


def made(texts: list[tuple[str, bool]]) -> dict[str, bytes]:
    """Streams of a document of pieces (text, narrow)."""
    head = bytearray(0x400)
    struct.pack_into("<HH", head, 0, MAGIC, 0xC1)
    struct.pack_into("<H", head, FLAGS, 0x200)
    main, rows, places = bytes(head), [], [0]
    for text, narrow in texts:
        rows.append(bytes(2) + struct.pack("<I", (len(main) * 2 | 0x40000000) if narrow else len(main)) + bytes(2))
        main += piece_bytes(text, narrow) or b""
        places.append(places[-1] + len(text))
    body = struct.pack(f"<{len(places)}I", *places) + b"".join(rows)
    table = b"\x02" + struct.pack("<I", len(body)) + body
    out = bytearray(main)
    struct.pack_into("<II", out, TEXT_MIN, 0x400, len(main))
    struct.pack_into("<I", out, TEXT_CHARS, places[-1])
    struct.pack_into("<II", out, CLX, 0, len(table))
    return {STREAM: bytes(out), "1Table": table}
