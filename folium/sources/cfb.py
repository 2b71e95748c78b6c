"""Compound files (CFB): streams as a relation, and back.

A compound file is a small file system of sectors: allocation tables chain the sectors of a stream, streams under 4096 bytes live
in the mini stream, and the directory is a tree of entries. Reading follows chains as far as they are sound and never twice
through a sector. Writing always gives version 3 with sectors of 512 bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.sources.archives import MOST_BYTES, gathered
from folium.sources.tables import by_row

#: Fixed values of the format.
MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END, FAT, DIFAT, NONE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC, 0xFFFFFFFF
SMALL, MINI, SECTOR, ENTRY = 4096, 64, 512, 128
STORAGE, STREAM, ROOT = 1, 2, 5
_HEAD_LINKS = 109


def is_cfb(data: bytes) -> bool:
    return data[:8] == MAGIC


class Reader:
    """paths: stream path -> bytes, in directory order. Raises ValueError if there is no sound header."""

    def __init__(self, data: bytes):
        if not is_cfb(data) or len(data) < SECTOR:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if not 7 <= shift <= 16 or not 4 <= mini_shift < shift:
            raise ValueError("sector size")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        directory, self.limit, first_mini, n_difat, difat = *struct.unpack_from("<I", data, 48), struct.unpack_from("<I", data, 56)[0], struct.unpack_from("<I", data, 60)[0], struct.unpack_from("<I", data, 72)[0], struct.unpack_from("<I", data, 68)[0]
        links = list(struct.unpack_from(f"<{_HEAD_LINKS}I", data, 76))
        seen: set[int] = set()
        while difat < DIFAT and difat not in seen and n_difat:
            seen.add(difat)
            block = self._words(self.sector(difat))
            if len(block) == 0:
                break
            links += block[:-1].tolist()
            difat = int(block[-1])
        parts = [self._words(self.sector(x)) for x in links if x < DIFAT]
        self.fat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        self.mini_fat = self._words(self.chain(first_mini))
        self.entries = self._directory(self.chain(directory))
        root = next((e for e in self.entries if e["kind"] == ROOT), None)
        self.mini = self.chain(root["start"]) if root else b""
        self.paths = dict(self._paths())

    @staticmethod
    def _words(data: bytes) -> np.ndarray:
        return np.frombuffer(data[: len(data) // 4 * 4], "<u4")

    def sector(self, i: int) -> bytes:
        return self.data[(i + 1) * self.size : (i + 2) * self.size]

    def chain(self, start: int) -> bytes:
        return b"".join(self.sector(i) for i in self._links(start, self.fat))

    @staticmethod
    def _links(start: int, table: np.ndarray) -> Iterator[int]:
        seen: set[int] = set()
        while start < DIFAT and start < len(table) and start not in seen:
            seen.add(start)
            yield start
            start = int(table[start])

    def _directory(self, data: bytes) -> list[dict]:
        out = []
        for a in range(0, len(data) - ENTRY + 1, ENTRY):
            n, kind = struct.unpack_from("<HB", data, a + 64)
            left, right, child = struct.unpack_from("<III", data, a + 68)
            start, size = struct.unpack_from("<IQ", data, a + 116)
            if self.size == SECTOR:
                size &= 0xFFFFFFFF
            name = data[a : a + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace")
            out.append({"name": name, "kind": kind, "left": left, "right": right, "child": child, "start": start, "size": size})
        return out

    def _paths(self) -> Iterator[tuple[str, bytes]]:
        if not self.entries:
            return
        seen: set[int] = set()
        waiting: list[tuple[int, str, bool]] = [(self.entries[0]["child"], "", False)]
        while waiting:
            i, under, own = waiting.pop()
            if i >= len(self.entries) or (not own and i in seen):
                continue
            e = self.entries[i]
            if not own:  # left side, then this entry, then right side: the tree's order
                seen.add(i)
                waiting += [(e["right"], under, False), (i, under, True), (e["left"], under, False)]
                continue
            path = f"{under}/{e['name']}" if under else e["name"]
            if e["kind"] == STREAM:
                yield path, self.stream(e)
            elif e["kind"] == STORAGE:
                waiting.append((e["child"], path, False))

    def stream(self, e: dict) -> bytes:
        if e["size"] < self.limit:
            parts = (self.mini[i * self.mini_size : (i + 1) * self.mini_size] for i in self._links(e["start"], self.mini_fat))
            return b"".join(parts)[: e["size"]]
        return self.chain(e["start"])[: e["size"]]


def name_order(name: str) -> tuple[int, str]:
    """Shorter names first, then by upper case."""
    return len(name.encode("utf-16-le")), name.upper()


def _tree(members: list[int]) -> tuple[int, dict[int, tuple[int, int]]]:
    """Root and (left, right) of a balanced tree over members in order."""
    links: dict[int, tuple[int, int]] = {}

    def root(a: int, b: int) -> int:
        if a >= b:
            return NONE
        m = (a + b) // 2
        links[members[m]] = (root(a, m), root(m + 1, b))
        return members[m]

    return root(0, len(members)), links


def written(streams: dict[str, bytes]) -> bytes:
    """A compound file of streams by path; storages are made as paths need them."""
    entries: list[dict] = [{"name": "Root Entry", "kind": ROOT, "data": b"", "inside": []}]
    at: dict[str, int] = {"": 0}

    def storage(path: str) -> int:
        if path not in at:
            up, _, name = path.rpartition("/")
            above = storage(up)
            at[path] = len(entries)
            entries.append({"name": name, "kind": STORAGE, "data": b"", "inside": []})
            entries[above]["inside"].append(at[path])
        return at[path]

    for path, data in streams.items():
        up, _, name = path.rpartition("/")
        above = storage(up)
        entries[above]["inside"].append(len(entries))
        entries.append({"name": name, "kind": STREAM, "data": bytes(data), "inside": []})
    for e in entries:
        inside = sorted(e["inside"], key=lambda i: name_order(entries[i]["name"]))
        e["child"], links = _tree(inside)
        for i, (left, right) in links.items():
            entries[i]["left"], entries[i]["right"] = left, right

    mini, mini_fat = bytearray(), []
    for e in entries:
        if e["kind"] == STREAM and 0 < len(e["data"]) < SMALL:
            n = -(-len(e["data"]) // MINI)
            e["start"] = len(mini_fat)
            mini_fat += [*range(len(mini_fat) + 1, len(mini_fat) + n), END]
            mini += e["data"].ljust(n * MINI, b"\0")
    entries[0]["data"] = bytes(mini)

    blocks: list[bytes] = []
    fat: list[int] = []

    def put(data: bytes) -> int:
        """First sector of data, chained; END if there is none."""
        n = -(-len(data) // SECTOR)
        if not n:
            return END
        start = len(fat)
        fat.extend([*range(start + 1, start + n), END])
        blocks.append(data.ljust(n * SECTOR, b"\0"))
        return start

    for e in entries:
        if e["kind"] == ROOT or len(e["data"]) >= SMALL:
            e["start"] = put(e["data"])
    mini_start = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-len(mini_fat) * 4 // SECTOR) * SECTOR, b"\xff"))
    rows = b""
    for e in entries:
        name = e["name"].encode("utf-16-le")[:62]
        rows += name.ljust(64, b"\0") + struct.pack("<HBBIII", len(name) + 2, e["kind"], 1, e.get("left", NONE), e.get("right", NONE), e["child"])
        rows += bytes(36) + struct.pack("<IQ", e.get("start", END if e["kind"] == STREAM else 0), len(e["data"]))
    empty = bytes(64) + struct.pack("<HBBIII", 0, 0, 1, NONE, NONE, NONE) + bytes(48)
    rows += empty * (-len(entries) % (SECTOR // ENTRY))
    directory = put(rows)

    # Sectors of the tables, which the tables list too: grown until they hold themselves.
    per, n_fat, n_difat = SECTOR // 4, 0, 0
    while True:
        need = -(-(len(fat) + n_fat + n_difat) // per)
        more = max(0, -(-(need - _HEAD_LINKS) // (per - 1)))
        if (need, more) == (n_fat, n_difat):
            break
        n_fat, n_difat = need, more
    links = list(range(len(fat), len(fat) + n_fat))
    difat_at = len(fat) + n_fat
    fat += [FAT] * n_fat + [DIFAT] * n_difat
    blocks.append(struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * SECTOR, b"\xff"))
    rest = links[_HEAD_LINKS:]
    for k in range(n_difat):
        part = rest[k * (per - 1) : (k + 1) * (per - 1)]
        part += [FREE] * (per - 1 - len(part))
        blocks.append(struct.pack(f"<{per}I", *part, difat_at + k + 1 if k + 1 < n_difat else END))
    head = MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIII", 0, n_fat, directory, 0)
    head += struct.pack("<IIIII", SMALL, mini_start, -(-len(mini_fat) * 4 // SECTOR), difat_at if n_difat else END, n_difat)
    head += struct.pack(f"<{_HEAD_LINKS}I", *(links + [FREE] * _HEAD_LINKS)[:_HEAD_LINKS])
    return head + b"".join(blocks)


def rows_of_file(doc: str, content: bytes | None) -> list[tuple]:
    """doc_id, part, content, error of a file's streams."""
    data = content or b""
    try:
        if len(data) > MOST_BYTES:
            raise ValueError("file too large")
        return [(doc, p, x, None) for p, x in Reader(data).paths.items()]
    except (ValueError, struct.error) as e:
        return [(doc, None, None, str(e))]


def streams_of(files: DataFrame) -> DataFrame:
    """doc_id, part, content, error for each stream of files (doc_id, content); a broken file gives one row with its error."""
    return by_row(files.select(F.col("doc_id").cast("string").alias("doc_id"), "content"), rows_of_file, "doc_id string, part string, content binary, error string")


def compound(parts: DataFrame) -> DataFrame:
    """doc_id, content: a compound file of each document's streams (doc_id, part, content)."""

    make = lambda doc, own: ((doc, written(dict(sorted((x["part"], x["content"]) for x in own)))),)
    return by_row(gathered(parts), make, "doc_id string, content binary")
