"""Token ids in directly addressable code files (operator 6).

An id is cut into chunks of `bits` bits. Level 0 holds the low chunk of every id and a bitmap of those that continue; level 1
holds the next chunk of these, and so on. A rank directory counts the continuing ids before each 512-bit block of a bitmap, so
any token is found by one look at each level, without decoding a block of others.

File: b"DAC1", bits (u8), levels (u8), two zero bytes, then little-endian u64: number of documents, number of ids; the
documents' ids (i64) and first positions with a closing one (u64); for each level its length (u64), chunks, bitmap (padded
to 8 bytes) and rank directory (u64 each). A shard is one row of a Parquet table, written by Spark's committer, so
a task that is run again leaves one copy.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folium.llm.shared import keep, place
from folium.llm.words import LOWER, NOT_SPACE, Words, byte_set, slices

#: Bits of a chunk; bits of a bitmap between two entries of its rank directory; most ids of a shard; words kept encoded by a worker.
BITS, RANK, SHARD_IDS, CACHE = 8, 512, 2_000_000, 500_000
END = 1
#: Starts of shards that are broadcast at most; beyond, they are shuffled.
BROADCAST_SHARDS = 500_000
#: Bytes of text looked up at once: of a larger slice more words are met again.
SLICE = 2_500_000
#: Words encoded as one text; texts encoded at once.
LINE, MANY = 512, 4096
#: Marks that make a piece of their own after a letter: ASCII punctuation, but for the apostrophe (contractions) and <, >, | (special tokens); most of them cut.
MARK, MARKS = byte_set((0x21, 0x26), (0x28, 0x2F), (0x3A, 0x3B), (0x3D, 0x3D), (0x3F, 0x40), (0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7E)), 8
LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A))


class Codes:
    """Random access to an encoded shard."""

    def __init__(self, data: bytes):
        if data[:4] != b"DAC1":
            raise ValueError("not a token file")
        self.bits, levels = data[4], data[5]
        docs, self.n = (int(x) for x in np.frombuffer(data, "<u8", 2, 8))
        at = 24
        self.doc_id = np.frombuffer(data, "<i8", docs, at)
        self.first = np.frombuffer(data, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        at += 16 * docs + 8
        self.chunks, self.more, self.rank = [], [], []
        for _ in range(levels):
            n = int(np.frombuffer(data, "<u8", 1, at)[0])
            at += 8
            size, words = (n * self.bits // 8, -(-n // 64) * 8)
            self.chunks.append(np.frombuffer(data, np.dtype(f"<u{self.bits // 8}"), n, at))
            at += size
            self.more.append(np.frombuffer(data, np.uint8, words, at))
            at += words
            self.rank.append(np.frombuffer(data, "<u8", n // RANK + 1, at))
            at += 8 * (n // RANK + 1)

    def __getitem__(self, i: int) -> int:
        """One id: a chunk and a rank for each level that it has."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(len(self.chunks)):
            out |= int(self.chunks[level][i]) << (level * self.bits)
            if not self.more[level][i >> 3] >> (i & 7) & 1:
                return out
            a = i // RANK * (RANK // 8)
            bits = np.unpackbits(self.more[level][a : (i >> 3) + 1], bitorder="little")[: i - 8 * a]
            i = int(self.rank[level][i // RANK]) + int(bits.sum())
        return out

    def all(self) -> np.ndarray:
        out, at = np.zeros(self.n, np.uint32), np.arange(self.n, dtype=np.uint32 if self.n < 1 << 32 else np.int64)
        for level, chunk in enumerate(self.chunks):
            out[at] |= chunk.astype(np.uint32) << np.uint32(level * self.bits)
            at = at[np.unpackbits(self.more[level], bitorder="little")[: len(chunk)].astype(bool)]
        return out


def encoded(doc_id: np.ndarray, sizes: np.ndarray, ids: np.ndarray, bits: int = BITS) -> bytes:
    levels, body, now = 0, [], ids.astype(np.uint32)
    while levels == 0 or len(now):
        further = now >> np.uint32(bits)
        more = further > 0
        flags = np.packbits(more, bitorder="little").tobytes()
        blocks = more[: len(now) // RANK * RANK].reshape(-1, RANK).sum(axis=1, dtype=np.int64)
        counts = np.concatenate([[0], np.cumsum(blocks)]).astype("<u8")
        body += [np.array([len(now)], "<u8").tobytes(), (now & np.uint32((1 << bits) - 1)).astype(f"<u{bits // 8}").tobytes(), flags, bytes(-len(flags) % 8), counts.tobytes()]
        now, levels = further[more], levels + 1
    head = b"DAC1" + bytes([bits, levels, 0, 0]) + np.array([len(doc_id), len(ids)], "<u8").tobytes()
    return head + doc_id.astype("<i8").tobytes() + np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes() + b"".join(body)


class Known:
    """Words with their ids in one array; place 0 is END."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.ids, self.first, self.met = np.array([END], np.uint32), np.array([0, 1]), np.zeros(1, np.int32)

    def thin(self) -> None:
        """Forgets the words met in one slice only; all, if that leaves more than half."""
        stays = np.flatnonzero(self.met > 1)
        stays = np.append(0, stays[stays > 0] if len(stays) <= len(self.met) // 2 else stays[:0])
        sizes = np.diff(self.first)[stays]
        place = np.full(len(self.met), -1)
        place[stays] = np.arange(len(stays))
        stop = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(self.first[stays] - (stop - sizes), sizes) + np.arange(stop[-1])]
        self.first, self.met = np.concatenate([[0], stop]), np.ones(len(stays), np.int32)
        self.at = {w: j for w, i in self.at.items() if (j := int(place[i])) > 0}

    def add(self, tokenizer, words: list[str], last: np.ndarray | None) -> None:
        """last: which ids end a piece; words of letters alone are one piece each, so many are encoded as one text."""
        alone = [last is not None and w.isascii() and w.isalpha() for w in words]
        lines = [w for w, x in zip(words, alone, strict=True) if x]
        self.put(lines, *encode(tokenizer, [" ".join(lines[i : i + LINE]) for i in range(0, len(lines), LINE)], last))
        others = [w for w, x in zip(words, alone, strict=True) if not x]
        for i in range(0, len(others), MANY):
            self.put(others[i : i + MANY], *encode(tokenizer, others[i : i + MANY]))

    def put(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(sizes) != len(words):
            raise ValueError("words and pieces differ")
        n = len(self.first) - 1
        self.at.update(zip(words, range(n, n + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.int32)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])


def encode(tokenizer, texts: list[str], last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the texts, sizes of each text's ids; of each piece's, if last tells which ids end one)."""
    new = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    sizes = np.fromiter(map(len, new), np.int64, len(new))
    ids = np.fromiter(chain.from_iterable(new), np.uint32, int(sizes.sum()))
    return ids, sizes if last is None else np.diff(np.flatnonzero(last[ids]), prepend=-1)


def by_words(tokenizer) -> bool:
    """Whether the tokenizer lower-cases, takes any white space alike, drops it and parts letters from marks, as Encoder counts on."""
    settings = json.loads(tokenizer.to_str())

    def steps(x: dict | None, inner: str) -> list[dict]:
        return [] if x is None else x[inner] if x["type"] == "Sequence" else [x]

    folds = steps(settings["normalizer"], "normalizers")
    parts = steps(settings["pre_tokenizer"], "pretokenizers")
    first = parts[0] if parts else {}
    return (
        {x["type"] for x in folds} <= {"NFC", "Replace", "Lowercase"}
        and any(x["type"] == "Lowercase" for x in folds)
        and all(x["pattern"].get("Regex") == r"\s+" and x["content"] == " " for x in folds if x["type"] == "Replace")
        and first.get("type") == "Split"
        and first["behavior"] == "Removed"
        and first["invert"]
        and first["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in parts[1:])
    )


_known: dict[str, tuple] = {}


class Encoder:
    """Ids of texts by a tokenizer, with the ids of frequent words kept if its words do not reach across white space.

    That is read from the tokenizer's settings (by_words); any other tokenizer gets whole texts. ASCII words are looked up in
    lower case, as the tokenizer lower-cases; up to MARKS punctuation marks that end a word after a letter are cut off it, as
    the tokenizer does. Any other word goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path not in _known:
            tokenizer = Tokenizer.from_file(path)
            suffix, last = getattr(tokenizer.model, "end_of_word_suffix", None), None
            if suffix:
                vocab = tokenizer.get_vocab()
                last = np.zeros(max(vocab.values()) + 1, bool)
                last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
            _known[path] = (tokenizer, Known(), last, by_words(tokenizer))
        self.tokenizer, self.known, self.last, self.by_words = _known[path]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with END after each, number of each text's ids)."""
        if not self.by_words:
            ids, sizes = encode(self.tokenizer, pc.fill_null(texts, "").to_pylist())
            return np.insert(ids, np.cumsum(sizes), np.uint32(END)), sizes + 1
        words = Words(texts, NOT_SPACE)
        buf = words.buf
        ends = words.ends.copy()
        at = np.flatnonzero(MARK[buf[ends - 1]]) if len(ends) else np.zeros(0, np.int64)
        for _ in range(MARKS):
            ends[at] -= 1
            at = at[ends[at] > words.starts[at]]
            at = at[MARK[buf[ends[at] - 1]]]
        cut = np.flatnonzero(ends < words.ends)
        cut = cut[(ends[cut] > words.starts[cut]) & LETTER[buf[np.maximum(ends[cut] - 1, 0)]]]
        long = words.ends[cut] - ends[cut]
        key = np.zeros(len(cut), np.uint64)
        for j in range(MARKS):
            some = long > j
            key[some] |= buf[ends[cut[some]] + j].astype(np.uint64) << np.uint64(8 * j)
        parted, ends = ends[cut], words.ends.copy()
        ends[cut] = parted
        high = np.concatenate([[0], np.cumsum(buf >= 0x80, dtype=np.int32)])
        plain = high[ends] == high[words.starts]
        folded = np.where(words.covered(words.starts[plain], ends[plain]), LOWER[buf], buf)
        coded, marks = pc.dictionary_encode(words.column(ends, folded)), pc.dictionary_encode(pa.array(key))
        distinct = coded.dictionary.to_pylist()
        n_words = len(distinct)
        distinct += [x.to_bytes(MARKS, "little").rstrip(b"\0").decode() for x in marks.dictionary.to_pylist()]
        own = self.known
        if len(own.at) > CACHE:
            own.thin()
        own.add(self.tokenizer, [w for w in dict.fromkeys(distinct) if w not in own.at], self.last)
        which = np.append(np.fromiter(map(own.at.__getitem__, distinct), np.int64, len(distinct)), 0)
        own.met[which] += 1
        # The sequence of parts: each word, then the marks cut from it, and END after each text.
        n, texts_n = len(ends), len(words.n)
        extra = np.zeros(n + 1, np.int64)
        extra[cut + 1] = 1
        np.cumsum(extra, out=extra)
        seq = np.empty(n + extra[-1] + texts_n, np.int64)
        spot = np.arange(n) + extra[:-1] + np.repeat(np.arange(texts_n), words.n)
        seq[spot] = coded.indices.to_numpy()
        seq[spot[cut] + 1] = n_words + marks.indices.to_numpy()
        ends_at = words.first[1:] + extra[words.first[1:]] + np.arange(texts_n)
        seq[ends_at] = len(distinct)
        begin, lens = own.first[:-1][which][seq], np.diff(own.first)[which][seq]
        stop = np.cumsum(lens)
        ids = own.ids[np.repeat(begin - (stop - lens), lens) + np.arange(stop[-1])] if len(seq) else np.zeros(0, np.uint32)
        per_doc = np.diff(np.concatenate([[0], stop[ends_at]])) if texts_n else np.zeros(0, np.int64)
        return ids, per_doc


def shards(path: str, bits: int, most: int):
    """mapInArrow function: doc_id, text in order -> shard (partition and place), n_docs, n_ids, data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, n = Encoder(path), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            nonlocal n, held
            doc, sizes, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], n + 1
            row = {"shard": [(task << 32) + n], "n_docs": [len(doc)], "n_ids": [len(ids)], "data": [encoded(doc, sizes, ids, bits)]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())]))

        for batch in slices(batches, size=SLICE):
            ids, sizes = encoder(batch.column("text"))
            held.append((batch.column("doc_id").to_numpy(zero_copy_only=False), sizes, ids))
            if sum(len(x[2]) for x in held) >= most:
                yield out()
        if held:
            yield out()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, bits: int = BITS, most: int = SHARD_IDS) -> None:
    """Writes the ids of docs (doc_id, text), END after each document, in ascending doc_id order, under path.

    Null texts are empty. Rows without doc_id have no place in the order and are left out; rows of one doc_id follow each
    other in the order of their texts. A text's ids stay in one shard.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    # Ranges of doc_id follow its distribution; what they hold is sorted in each task.
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shards(tokenizer, bits, most), "shard long, n_docs long, n_ids long, data binary").write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, broadcast_shards: int = BROADCAST_SHARDS) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""
    files = spark.read.schema("shard long, n_docs long, n_ids long, data binary").parquet(path)
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = keep(files.select("shard", "n_ids").select(F.col("shard").alias("own"), before.alias("before")), "starts")
    starts = F.broadcast(starts) if starts.count() <= broadcast_shards else starts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            codes = Codes(row["data"])
            ids, at = codes.all().astype("<u4"), codes.first
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(codes.doc_id), pa.array(at[:-1] + row["before"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.join(starts, F.col("shard") == F.col("own")).select("before", "data")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, **settings) -> DataFrame:
    """Writes docs to a new place in the shared folder and reads them back."""
    write_tokens(docs, tokenizer, path := place(docs.sparkSession, "tokens"), **settings)
    return read_tokens(docs.sparkSession, path)
