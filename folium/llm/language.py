"""Language ID by segmentation-marginalised unigrams (operator 1).

The vocabulary is that of a public subword tokenizer and is not trained. Each language has a probability for every piece. A
word's likelihood is the sum over all its segmentations into pieces, found by the forward algorithm; pieces do not
reach across white space, so a text's log-likelihood is the sum over its words. Piece probabilities come from
expectation-maximisation over the words of a bounded sample of labelled texts: the words are counted and the expected counts
summed by Spark, and the driver holds a table of pieces by languages. Words of any length are taken whole, in batches of
bounded size.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.llm.shared import keep
from folium.llm.words import LOWER, NOT_SPACE, Words, slices

#: Texts of the training sample by language, at most, and over all languages; steps of expectation-maximisation.
PER_LANGUAGE, IN_ALL, ROUNDS = 800, 8_000, 2
#: Chance of a character that no piece has; counts added to each piece.
UNKNOWN, ADDED = 1e-7, 0.05
#: Characters of a batch of words, padding included; a word longer than LONG is worked on by itself, in steps of LONG characters.
BATCH, LONG = 60_000, 2_000
#: Bits of a hash that are tested first.
LOW_BITS = 20
#: Words whose likelihoods a worker keeps.
CACHE = 300_000
#: What SentencePiece writes for a word's start.
START = "▁"


def vocabulary(path: str) -> list[str]:
    """The pieces of a SentencePiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    # Pieces that go on past a word's start mark (runs of marks) stand in no word.
    return sorted({p for p in pieces if p and START not in p[1:]})


def batches_of(words: list[str]) -> Iterator[np.ndarray]:
    """Places of the words, short ones first, in batches of at most BATCH characters with padding; a long word by itself."""
    size = np.array([len(w) + 1 for w in words], np.int64)
    order = np.argsort(size, kind="stable")
    a = 0
    while a < len(order):
        # Sizes ascend, so a batch's area is its number of words times its last size.
        fits = (np.arange(1, len(order) - a + 1) * size[order[a:]] <= BATCH) & (size[order[a:]] <= LONG)
        b = a + max(1, int(fits.sum()))
        yield order[a:b]
        a = b


def points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words with a start mark, padded with 0, and their lengths."""
    size = np.array([len(w) + 1 for w in words])
    out = np.zeros((len(words), int(size.max(initial=1))), np.uint64)
    flat = np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


@dataclass
class Pieces:
    """Pieces by hash; place maps a sorted hash to its piece; longest: characters of the longest; low: whether a piece's hash ends in these bits."""

    hashes: np.ndarray
    place: np.ndarray
    n: int
    longest: int
    low: np.ndarray

    @staticmethod
    def of(pieces: list[str]) -> Pieces:
        h = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            x = 0
            for c in p:
                x = (x * 0x9E3779B97F4A7C15 + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            h[i] = x
        order = np.argsort(h)
        low = np.zeros(1 << LOW_BITS, bool)
        low[h & np.uint64((1 << LOW_BITS) - 1)] = True
        return Pieces(h[order], order, len(pieces), max(map(len, pieces), default=1), low)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, or n; few hashes pass the first test."""
        out = np.full(len(h), self.n)
        some = np.flatnonzero(self.low[h & np.uint64((1 << LOW_BITS) - 1)])
        i = np.minimum(np.searchsorted(self.hashes, h[some]), self.n - 1)
        out[some] = np.where(self.hashes[i] == h[some], self.place[i], self.n)
        return out

    def at(self, words: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(end, length, piece of each word or n) for all pieces of the words, by end."""
        n, most = words.shape
        running = [np.zeros(n, np.uint64)]
        with np.errstate(over="ignore"):
            for end in range(1, most + 1):
                running.append(running[-1] * np.uint64(0x9E3779B97F4A7C15) + words[:, end - 1] + np.uint64(1))
                running = running[-self.longest - 1 :]
                power = np.uint64(1)
                for length in range(1, min(self.longest, end) + 1):
                    power = power * np.uint64(0x9E3779B97F4A7C15)
                    found = self.find(running[-1] - running[-1 - length] * power)
                    yield end, length, np.where(size >= end, found, self.n)

    def along(self, word: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        """For each end in one word: (length, piece) of the pieces that end there; looked up for LONG characters at once."""
        with np.errstate(over="ignore"):
            for a in range(0, len(word), LONG):
                lead = min(a, self.longest - 1)
                part = word[a - lead : a + LONG]
                running, h = [], np.zeros(len(part), np.uint64)
                power = np.uint64(1)
                for length in range(1, self.longest + 1):  # hash of the length characters up to each place
                    if length > len(part):
                        break
                    added = part[: len(part) - length + 1] + np.uint64(1)
                    h = np.concatenate([np.zeros(length - 1, np.uint64), added * power + (h[length - 1 :] if length > 1 else np.uint64(0))])
                    power = power * np.uint64(0x9E3779B97F4A7C15)
                    running.append(self.find(h))
                for i in range(lead, len(part)):
                    yield [(k, int(found[i])) for k, found in enumerate(running, 1) if k <= i + 1 and found[i] < self.n]


def forward(words: list[str], pieces: Pieces, chance: np.ndarray) -> np.ndarray:
    """Log-likelihood of each word in each language. chance: pieces + 1 rows (the last 0), languages."""
    out = np.zeros((len(words), chance.shape[1]))
    for who in batches_of(words):
        x, size = points([words[i] for i in who])
        if len(who) == 1 and len(x[0]) > LONG:
            out[who[0]] = long_forward(x[0], pieces, chance)
            continue
        scale = np.zeros((len(who), chance.shape[1]))
        alpha = [np.ones_like(scale)]
        now = None
        for end, length, piece in pieces.at(x, size):
            if length == 1:
                now = alpha[-1] * np.where((piece == pieces.n) & (size >= end), UNKNOWN, 0.0)[:, None]
                recent = alpha[-pieces.longest :]
            hit = np.flatnonzero(piece < pieces.n)
            if len(hit):
                now[hit] += recent[-length][hit] * chance[piece[hit]]
            if length == min(pieces.longest, end):
                live = size >= end
                by = np.where(live[:, None], now, 1.0)
                scale += np.log(by)
                # All that later ends look back at is scaled, so that no chance runs out of range.
                alpha = [y / by for y in alpha[-pieces.longest + 1 :]] + [np.where(live[:, None], 1.0, alpha[-1] / by)]
        out[who] = scale
    return out


def long_forward(word: np.ndarray, pieces: Pieces, chance: np.ndarray) -> np.ndarray:
    """forward() of one word, end by end: memory does not grow with its length."""
    total, alpha = np.zeros(chance.shape[1]), [np.ones(chance.shape[1])]
    for found in pieces.along(word):
        now = sum(alpha[-k] * chance[p] for k, p in found)
        if not any(k == 1 for k, _ in found):
            now = now + alpha[-1] * UNKNOWN
        total += np.log(now)
        alpha = [y / now for y in alpha[-pieces.longest + 1 :]] + [np.ones_like(now)]
    return total


def expected(words: list[str], counts: np.ndarray, pieces: Pieces, chance: np.ndarray) -> np.ndarray:
    """Expected number of each piece in the words (counts: words, languages) under chance.

    With S the log-likelihood of a word's beginnings, the last piece of a beginning is (length k) of chance q = p * exp(S[e-k] - S[e]);
    going back from the word's end, a place is an end of a piece with the summed chance of the pieces that begin there.
    """
    total = np.zeros(chance.shape)
    for who in batches_of(words):
        x, size = points([words[i] for i in who])
        n, most = x.shape
        # Chances are floored far below any that could count, so that no language runs out of logarithms.
        given = np.maximum(chance, 1e-30)
        s, arcs = np.zeros((most + 1, n, chance.shape[1])), []
        now = None
        for e, k, p in pieces.at(x, size):
            p = p.astype(np.int32)
            if k == 1:
                now = np.where(((p == pieces.n) & (size >= e))[:, None], UNKNOWN, np.where((p < pieces.n)[:, None], given[p], 0.0))
            else:
                now = now + np.where((p < pieces.n)[:, None], given[p] * np.exp(s[e - k] - s[e - 1]), 0.0)
            arcs.append((e, k, p))
            if k == min(pieces.longest, e):
                s[e] = s[e - 1] + np.log(np.where((size >= e)[:, None], now, 1.0))
        ends = np.zeros_like(s)
        ends[size, np.arange(n)] = counts[who]
        for e, k, p in reversed(arcs):
            live = (size >= e) & ((p < pieces.n) | (k == 1))
            if not live.any():
                continue
            chance_of = np.where((p < pieces.n)[:, None], given[p], UNKNOWN)
            share = np.where(live[:, None], ends[e] * chance_of * np.exp(s[e - k] - s[e]), 0.0)
            ends[e - k] += share
            np.add.at(total, p, share)
    return total[:-1]


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    chance: np.ndarray


def word_counts(column: dict[str, int]):
    """mapInArrow function: lang, text -> word, lang (its place), n of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column("text"), NOT_SPACE, LOWER)
            spelled = words.column(words.ends, words.buf)
            lang = np.repeat(np.array([column[x] for x in batch.column("lang").to_pylist()], np.int32), words.n)
            counts = pa.table({"word": spelled, "lang": pa.array(lang)}).group_by(["word", "lang"]).aggregate([([], "count_all")])
            for part in counts.select(["word", "lang", "count_all"]).rename_columns(["word", "lang", "n"]).to_batches():
                yield part.cast(pa.schema([("word", pa.string()), ("lang", pa.int32()), ("n", pa.int64())]))

    return run


def expectations(shared, languages: int):
    """mapInArrow function: word, langs, ns -> piece, lang, n: expected counts of a task's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, chance = shared.value
        total = np.zeros((pieces.n, languages))
        for batch in slices(batches, "word"):
            words, counts = [], []
            for word, ls, ns in zip(*(batch.column(c).to_pylist() for c in ("word", "langs", "ns")), strict=True):
                row = np.zeros(languages)
                row[ls] = ns
                # All of a long word teaches, in steps: only the pieces across their ends are lost.
                steps = [word[i : i + LONG - 1] for i in range(0, len(word), LONG - 1)]
                words += steps
                counts += [row] * len(steps)
            if words:
                total += expected(words, np.array(counts), pieces, chance)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["piece", "lang", "n"])

    return run


def fit(rows: DataFrame, languages: list[str], path: str, rounds: int = ROUNDS) -> Model:
    """rows: lang, text. The driver holds a table of pieces by languages, never words."""
    spark, pieces = rows.sparkSession, Pieces.of(vocabulary(path))
    each = rows.mapInArrow(word_counts({x: i for i, x in enumerate(languages)}), "word string, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    words = keep(each.groupBy("word").agg(F.collect_list("lang").alias("langs"), F.collect_list("n").alias("ns")), "words")
    chance = np.full((pieces.n + 1, len(languages)), 1 / pieces.n)
    chance[-1] = 0
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, chance))
        sums = words.repartition("word").mapInArrow(expectations(shared, len(languages)), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n"))
        got = np.full((pieces.n, len(languages)), ADDED)
        found = sums.toArrow()
        got[found.column("piece").to_numpy(), found.column("lang").to_numpy()] += found.column("n").to_numpy().round(9)
        chance = np.concatenate([got / got.sum(axis=0), np.zeros((1, len(languages)))])
    return Model(languages, pieces, chance)


class Known:
    """Likelihoods of words that a worker has met, for one model."""

    def __init__(self, key: str, languages: int):
        self.key, self.at, self.rows = key, {}, np.zeros((1024, languages))

    def of(self, words: list[str], model: Model) -> np.ndarray:
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > CACHE:
            self.at, new = {}, words
        if new:
            a, b = len(self.at), len(self.at) + len(new)
            if b > len(self.rows):
                self.rows = np.concatenate([self.rows[:a], np.zeros((2 * b - a, self.rows.shape[1]))])
            self.rows[a:b] = forward(new, model.pieces, model.chance)
            self.at.update(zip(new, range(a, b), strict=True))
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


_met: list[Known] = []
_LETTER = regex.compile(r"\p{L}")


def predicted(shared, prior: bool = False):
    """mapInArrow function: doc_id, text, held_out -> these with lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, key = shared.value
        if not _met or _met[0].key != key:
            _met[:] = [Known(key, len(model.languages))]
        for batch in slices(batches):
            words = Words(batch.column("text"), NOT_SPACE, LOWER)
            coded = pc.dictionary_encode(words.column(words.ends, words.buf))
            table = _met[0].of(coded.dictionary.to_pylist(), model)
            n = len(words.n)
            doc = np.repeat(np.arange(n), words.n)
            each = table[coded.indices.to_numpy()] if len(doc) else np.zeros((0, len(model.languages)))
            total = np.stack([np.bincount(doc, each[:, k], n) for k in range(len(model.languages))], axis=1)
            top = total.argmax(axis=1)
            score = 1 / np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -700)).sum(axis=1)
            letter = np.array([bool(t and _LETTER.search(t)) for t in batch.column("text").to_pylist()], bool)
            langs = [model.languages[i] if x else "und" for i, x in zip(top, letter, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(np.where(letter, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, path: str, per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the language's posterior at equal priors) for each row of docs (doc_id, text, lang).

    Learned from texts with a language whose crc32(doc_id) mod 4 is not 2: of each language those of least hash, about
    per_language (fewer if in_all is shared by many languages). A null text, or one without a letter, is `und` with score 0,
    as are all texts if nothing is labelled. Repeated rows are predicted each; other columns are left alone; no rows give no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    labelled = texts.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held)
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    most = min(per_language, max(1, in_all // max(1, len(counts))))
    part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000.0
    bar = F.coalesce(*(F.when(F.col("lang") == k, F.lit(most / n)) for k, n in counts.items()), F.lit(0.0))
    result = texts.select("doc_id", "text", held.alias("held_out"))
    if not counts:
        return result.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    model = fit(labelled.where(part < bar).select("lang", "text"), sorted(counts), path)
    shared = spark.sparkContext.broadcast((model, uuid.uuid4().hex))
    return result.mapInArrow(predicted(shared), "doc_id long, held_out boolean, lang_pred string, score double")
