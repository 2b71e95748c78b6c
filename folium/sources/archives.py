"""Zip containers as relations of parts, and back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.sources.tables import batched, by_row

#: A file is read whole in one task; larger ones are reported, not opened.
MOST_BYTES = 40 * 1024 * 1024
_PARTS = "doc_id string, part string, content binary, error string"


def unzipped_upto(most: int | None):
    """unzipped() with another limit, or none."""
    return lambda batches: unzipped(batches, most)


def unzipped(batches: Iterator[pa.RecordBatch], most: int | None = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """doc_id, content -> a row for each part; a broken file gives one row with its error."""
    schema = pa.schema([("doc_id", pa.string()), ("part", pa.string()), ("content", pa.binary()), ("error", pa.string())])
    yield from batched((r for batch in batches for doc, content in zip(batch.column("doc_id"), batch.column("content"), strict=True) for r in rows_of_file(doc.as_py(), content.as_py(), most)), schema)


def rows_of_file(doc: str, content: bytes | None, most: int | None = MOST_BYTES) -> list[tuple]:
    """doc_id, part, content, error of a file's parts."""
    data = content or b""
    try:
        if most is not None and len(data) > most:
            raise ValueError("file too large")
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return [(doc, i.filename, z.read(i), None) for i in z.infolist() if not i.is_dir()]
    except (zipfile.BadZipFile, ValueError, RuntimeError, NotImplementedError, OSError) as e:
        return [(doc, None, None, str(e))]


def parts_of(files: DataFrame, most: int | None = MOST_BYTES) -> DataFrame:
    """files: doc_id, content. Files of more than `most` bytes are rows with an error; with None all are opened."""
    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(unzipped_upto(most), _PARTS)


def zipped(parts: DataFrame) -> DataFrame:
    """doc_id, content of each document's parts (doc_id, part, content): mimetype first and stored, the others in order."""

    return by_row(gathered(parts), lambda doc, own: ((doc, file_of((x["part"], x["content"]) for x in own)),), "doc_id string, content binary")


def gathered(parts: DataFrame) -> DataFrame:
    """doc_id, parts: each document's parts (doc_id, part, content) as an array of structs."""
    return parts.groupBy("doc_id").agg(F.collect_list(F.struct("part", "content")).alias("parts"))


def file_of(parts: Iterable[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in sorted(parts, key=lambda x: (x[0] != "mimetype", x[0])):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, content)
    return out.getvalue()


def with_edits(parts: DataFrame, edits: DataFrame) -> DataFrame:
    """Parts with new content where edits (doc_id, part, content) have some; all others untouched."""
    new = edits.select("doc_id", "part", F.col("content").alias("_new"))
    return parts.join(new, ["doc_id", "part"], "left").select("doc_id", "part", F.coalesce("_new", "content").alias("content"))
