"""Secret scans by character Markov models, in DataFrame functions only (operator 7).

Two first-order character models are trained from labelled strings: random ones and ordinary identifiers. A candidate's score
is the log-likelihood ratio of the two by character. Rules find assignments, access keys and long hex runs; the models add
other long runs of key characters that look random, and of a run that does not as a whole (a value glued to a key name or
path) every stretch that does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Shorter matches of these two would fail and hide nothing: their matches are whole runs.
ACCESS, HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
#: A run that the models judge: its characters, and log-likelihood ratio in nats a step from which it is a secret.
CANDIDATE, THRESHOLD = r"[A-Za-z0-9+/_=-]{16,}", 0.6
#: Nats that a run or stretch needs in all: what tells little by character must be longer.
LEAST_NATS = 12.0
#: Least characters of a stretch, and nats below its best end at which a stretch is closed.
STRETCH, DROP = 16, 6.0
#: Matches whose offsets are added up in one list.
BLOCK = 256
#: Other characters share the last place.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Words of ordinary identifiers.
IDENTIFIERS = (
    "get set user name account id list item value key index count total page file path data table column row cache buffer reader writer "
    "config option default client server request response header body token parser message event handler queue task worker status error "
    "result query filter order group update delete insert create build start stop open close read write load save next previous first last "
    "time date hour minute second year month number string array object class method function return public private static final internal "
    "image width height color style text title label button window panel view model controller service manager factory provider adapter "
    "address street city country phone email password login session access secret license version document word language source target"
)


def spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as an array of (start, stop, kind, value), in code points; those with a shorter value go."""
    empty = F.array().cast("array<struct<start: int, stop: int, kind: int, value: string>>")
    let = lambda x, body: F.get(F.transform(F.array(x), body), F.lit(0))

    def step(s: Column, m: Column) -> Column:
        a = s["at"] + m["gap"]
        b = a + m["size"]
        return F.struct(b.alias("at"), F.concat(s["found"], F.array(F.struct(a.alias("start"), b.alias("stop"), F.lit(KINDS.index(kind)).alias("kind"), m["value"].alias("value")))).alias("found"))

    def placed(m: Column) -> Column:
        # Sums of BLOCK matches, then of blocks: a list is copied at each step, so one over all matches would cost their square.
        pieces = F.transform(m["whole"], lambda w, i: F.struct(F.length(F.get(m["between"], i)).alias("gap"), F.length(w).alias("size"), F.get(m["value"], i).alias("value")))
        start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
        blocks = let(pieces, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(x, k * BLOCK + 1, F.lit(BLOCK)), start, step)))
        begins = lambda x: F.aggregate(x, F.array(F.lit(0)), lambda s, y: F.concat(s, F.array(F.element_at(s, -1) + y["at"])))
        moved = lambda y, by: F.transform(y["found"], lambda f: F.struct((f["start"] + by).alias("start"), (f["stop"] + by).alias("stop"), f["kind"].alias("kind"), f["value"].alias("value")))
        return let(blocks, lambda x: let(begins(x), lambda at: F.flatten(F.transform(x, lambda y, i: moved(y, F.get(at, i))))))

    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    found = let(F.struct(F.split(text, pattern, -1).alias("between"), every(0).alias("whole"), every(group).alias("value")), placed)
    # Few texts have any; the others are not split.
    return F.when(F.rlike(text, F.lit(pattern)), F.filter(found, lambda x: F.length(x["value"]) >= least)).otherwise(empty)


def masked(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """The text with as many spaces for each match that spans() gives."""
    between = F.split(text, pattern, -1)
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    let = lambda x, body: F.get(F.transform(F.array(x), body), F.lit(0))
    put = lambda m, i: F.when(F.length(F.get(m["value"], i)) >= least, F.repeat(F.lit(" "), F.length(F.get(m["whole"], i)))).otherwise(F.get(m["whole"], i))
    pieces = let(F.struct(between.alias("between"), whole.alias("whole"), value.alias("value")), lambda m: F.transform(m["between"], lambda b, i: F.concat(b, F.coalesce(put(m, i), F.lit("")))))
    return F.when(F.rlike(text, F.lit(pattern)), F.array_join(pieces, "")).otherwise(text)


def samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled strings (value, random): digests in three alphabets, and identifiers of two to four words in three styles."""
    words = F.split(F.lit(IDENTIFIERS), " ")
    pick = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.size(words)).cast("int"))
    parts = F.slice(F.array(*(pick(k) for k in range(4))), F.lit(1), (F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3)) + 2).cast("int"))
    style = F.col("id") % 3
    snake, upper = F.array_join(parts, "_"), F.upper(F.array_join(parts, "_"))
    camel = F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.initcap(x))), "")
    plain = F.when(style == 0, snake).when(style == 1, camel).otherwise(upper)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    odd = F.when(style == 0, base64).when(style == 1, digest).otherwise(F.translate(base64, "+/=", "-_"))
    ids = spark.range(n)
    return ids.select(plain.alias("value"), F.lit(0).alias("random")).union(ids.select(odd.alias("value"), F.lit(1).alias("random")))


def place(c: Column) -> Column:
    """Of a character in the alphabet, from 0."""
    at = F.instr(F.lit(ALPHABET), c)
    return F.when(at > 0, at - 1).otherwise(SIZE - 1)


def steps(value: Column) -> Column:
    """Number of each pair of neighbouring characters."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: place(F.substring(value, i, F.lit(1))) * SIZE + place(F.substring(value, i + 1, F.lit(1))))
    return F.when(F.length(value) > 1, pairs).otherwise(F.array().cast("array<int>"))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters, counts raised by one half; labelled: value, random (0 or 1).

    At most SIZE**2 counts reach the driver.
    """
    pairs = labelled.where("value is not null").select("random", F.explode(steps(F.col("value"))).alias("pair"))
    counts = {(r.pair, r.random): r.n for r in pairs.groupBy("pair", "random").agg(F.count("*").alias("n")).collect()}
    from math import log

    out = []
    for a in range(SIZE):
        totals = [sum(counts.get((a * SIZE + b, k), 0) + 0.5 for b in range(SIZE)) for k in (0, 1)]
        for b in range(SIZE):
            plain, odd = ((counts.get((a * SIZE + b, k), 0) + 0.5) / totals[k] for k in (0, 1))
            out.append(log(odd / plain))
    return out


def nats(value: Column, model: list[float]) -> Column:
    """Log-likelihood ratio by which a value looks random rather than an identifier."""
    table = F.lit(model)
    return F.aggregate(steps(value), F.lit(0.0), lambda s, p: s + F.get(table, p))


def score(value: Column, model: list[float]) -> Column:
    """Nats a step."""
    return nats(value, model) / F.greatest(F.length(value) - 1, F.lit(1))


def stretches(value: Column, model: list[float], threshold: float) -> Column:
    """(start, stop) of stretches of a value, STRETCH characters at least, that look random: the best sums of nats above the threshold."""
    table, least = F.lit(model), STRETCH - 1
    pair = "array<struct<start: int, stop: int>>"
    start = F.struct(
        F.lit(0).alias("origin"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("lag"), F.lit(None).cast("double").alias("low"), F.lit(0).alias("low_at"),
        F.lit(None).cast("double").alias("best"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.array().cast(pair).alias("found"),
    )
    let = lambda x, body: F.get(F.transform(F.array(x), body), F.lit(0))
    closed = lambda s: F.concat(s["found"], F.array(F.struct(s["a"].alias("start"), s["b"].alias("stop"))))

    def over(gains: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            at = i - least + 1  # the last place where a stretch that ends here may begin
            there = at >= s["origin"]
            lag = F.when(at > s["origin"], s["lag"] + F.get(gains, at - 1)).otherwise(F.lit(0.0))
            one = let(F.struct((s["sum"] + F.get(gains, i)).alias("sum"), lag.alias("lag")), lambda x: let((there & (s["low"].isNull() | (x["lag"] < s["low"]))), lambda new: F.struct(
                x["sum"].alias("sum"), x["lag"].alias("lag"), F.when(new, x["lag"]).otherwise(s["low"]).alias("low"), F.when(new, at).otherwise(s["low_at"]).alias("low_at"))))

            def after(x: Column) -> Column:
                now = x["sum"] - x["low"]
                better = F.coalesce((now >= 0) & (s["best"].isNull() | (now > s["best"])), F.lit(False))
                end = F.coalesce((now < 0) | (now < s["best"] - DROP), F.lit(False)) & s["best"].isNotNull()
                none = F.lit(None).cast("double")
                return F.when(end, F.struct((i + 1).alias("origin"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("lag"), none.alias("low"), F.lit(0).alias("low_at"), none.alias("best"), F.lit(0).alias("a"), F.lit(0).alias("b"), closed(s).alias("found"))).otherwise(
                    F.struct(s["origin"].alias("origin"), x["sum"].alias("sum"), x["lag"].alias("lag"), x["low"].alias("low"), x["low_at"].alias("low_at"), F.when(better, now).otherwise(s["best"]).alias("best"),
                             F.when(better, x["low_at"]).otherwise(s["a"]).alias("a"), F.when(better, i + 2).otherwise(s["b"]).alias("b"), s["found"].alias("found")))

            return let(one, after)

        return F.aggregate(F.sequence(F.lit(0), F.size(gains) - 1), start, step, lambda s: F.when(s["best"].isNotNull(), closed(s)).otherwise(s["found"]))

    return let(F.transform(steps(value), lambda p: F.get(table, p) - threshold), lambda g: F.when(F.size(g) >= least, over(g)).otherwise(F.array().cast(pair)))


def secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, found: an array of (start, stop, kind, value) by start, then kind, for each row of docs (doc_id, text).

    Offsets are code points, stop exclusive. A null text is empty. The models judge what the rules' spans leave. Repeated rows are scanned each, whole texts of any length; other columns are left alone,
    and no rows give no rows.
    """
    model = train(samples(docs.sparkSession) if labelled is None else labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rules = F.concat(spans(F.col("text"), "assign", ASSIGN, 1, 12), spans(F.col("text"), "access", ACCESS), spans(F.col("text"), "hex", HEX))
    # What the rules' spans leave of the text is judged by the models.
    rest = texts.select("doc_id", "text", rules.alias("rules"), masked(F.col("text"), ASSIGN, 1, 12).alias("rest"))
    rest = rest.withColumn("rest", masked(F.col("rest"), ACCESS)).withColumn("rest", masked(F.col("rest"), HEX))
    both = rest.select("doc_id", "rules", spans(F.col("rest"), "random", CANDIDATE).alias("runs"))
    part = lambda r: F.transform(stretches(r["value"], model, threshold), lambda t: F.struct(
        (r["start"] + t["start"]).alias("start"), (r["start"] + t["stop"]).alias("stop"), r["kind"].alias("kind"), F.substring(r["value"], t["start"] + 1, t["stop"] - t["start"]).alias("value")))
    judged = F.transform("runs", lambda r: F.when(score(r["value"], model) >= threshold, F.array(r)).otherwise(part(r)))
    clear = F.filter(F.flatten(judged), lambda r: nats(r["value"], model) >= LEAST_NATS)
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    return both.select("doc_id", F.array_sort("rules", order).alias("rules"), clear.alias("extra")).select("doc_id", "rules", F.array_sort(F.concat("rules", "extra"), order).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:stop, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def secret_digest(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of secrets()."""
    count = lambda k: F.size(F.filter("rules", lambda x: x["kind"] == k)).cast("long")
    return secrets(docs, **settings).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("rules")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
