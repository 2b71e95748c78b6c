"""Queries over cells, slots, styles and boards, and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import grid as G
from folium.functions import text as T
from folium.operators import audit, joins, windows
from folium.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
    WITH c AS (SELECT l_orderkey, l_linenumber, (l_partkey * 7 % 16384)::BIGINT AS col, l_linenumber::BIGINT - 1 AS row FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN col >= 702 THEN chr((65 + (col - 702) // 676 % 26)::INT) ELSE '' END || CASE WHEN col >= 26 THEN chr((65 + (col - 26) // 26 % 26)::INT) ELSE '' END || chr((65 + col % 26)::INT) || (row + 1) AS ref, row, col FROM c""")
def a1_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell addresses written and read back."""
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", G.a1(F.col("l_linenumber").cast("long") - 1, F.col("l_partkey") * 7 % 16384).alias("ref"))
    return c.select("l_orderkey", "l_linenumber", "ref", G.a1_row(F.col("ref")).alias("row"), G.a1_col(F.col("ref")).alias("col"))


@query("""
    SELECT p_partkey, CASE WHEN v = floor(v) THEN printf('%.0f', v) ELSE regexp_replace(printf('%.10f', floor(v * 1e10 + 0.5) / 1e10), '0+$', '') END AS price
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN floor(p_retailprice) ELSE p_retailprice END AS v FROM part)""")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("p_partkey") % 3 == 0, F.floor("p_retailprice").cast("double")).otherwise(F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", G.number_text(v).alias("price"))


@query("SELECT p_partkey, floor(p_size * 1440 / 7 * 96 / 1440 + 0.5)::BIGINT AS px, floor(p_partkey * 4321 / 9525 + 0.5)::BIGINT AS emu_px FROM part")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", G.twips_px(F.col("p_size") * 1440 / 7).alias("px"), G.emu_px(F.col("p_partkey") * 4321).alias("emu_px"))


@query("""
    WITH e AS (SELECT event_id, user_id, ts, event_type FROM events)
    SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sheet FROM e""")
def asof_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of a log with the last sheet start before it (sign-ups stand for sheet starts)."""
    log = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return windows.asof(log, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "sheet").select("event_id", "user_id", "sheet")


@query("""
    WITH n AS (SELECT l_orderkey AS t, (l_linenumber - 1)::INT AS row, (l_suppkey % 3)::INT AS col FROM lineitem WHERE l_orderkey % 10 = 1),
    cells AS (SELECT DISTINCT t, row, c::INT AS col FROM n, range(0, 4) g(c)),
    m AS (SELECT DISTINCT t, row AS r1, col AS c1, row + 1 AS r2, col + 1 AS c2 FROM n WHERE row % 2 = 0)
    SELECT t, row, col FROM cells WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.t = cells.t AND row BETWEEN r1 AND r2 AND col BETWEEN c1 AND c2 AND NOT (row = r1 AND col = c1))""")
def merge_cover_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of every tenth order's table that no merged block covers beside its anchor."""
    return _uncovered_cells(table(spark, sf_dir, "lineitem").where("l_orderkey % 10 = 1"))


@query("""
    WITH n AS (SELECT l_orderkey AS t, (l_linenumber - 1)::INT AS row, (l_suppkey % 3)::INT AS col FROM lineitem),
    cells AS (SELECT DISTINCT t, row, c::INT AS col FROM n, range(0, 4) g(c)),
    m AS (SELECT DISTINCT t, row AS r1, col AS c1, row + 1 AS r2, col + 1 AS c2 FROM n WHERE row % 2 = 0)
    SELECT t, row, col FROM cells WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.t = cells.t AND row BETWEEN r1 AND r2 AND col BETWEEN c1 AND c2 AND NOT (row = r1 AND col = c1))""")
def merge_cover_anti_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of all order tables that no merged block covers beside its anchor."""
    return _uncovered_cells(table(spark, sf_dir, "lineitem"))


def _uncovered_cells(items: DataFrame) -> DataFrame:
    n = items.select(F.col("l_orderkey").alias("t"), (F.col("l_linenumber") - 1).cast("int").alias("row"), (F.col("l_suppkey") % 3).cast("int").alias("col"))
    cells = n.select("t", "row", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("col")).distinct()
    merges = n.where("row % 2 = 0").select("t", F.col("row").alias("r1"), F.col("col").alias("c1"), (F.col("row") + 1).alias("r2"), (F.col("col") + 1).alias("c2")).distinct()
    return joins.uncovered(cells, merges, ["t"])


@query("""
    SELECT r_regionkey::INT AS row, c::INT AS col, coalesce(n_name, '') AS text
    FROM (SELECT r_regionkey, g.c FROM region, range(0, 25) g(c)) LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey = c""")
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by nations: every cell of the used range."""
    one = F.lit(1).alias("t")
    cells = table(spark, sf_dir, "nation").select(one, F.col("n_regionkey").cast("int").alias("row"), F.col("n_nationkey").cast("int").alias("col"), F.col("n_name").alias("text"))
    rows = table(spark, sf_dir, "region").agg((F.max("r_regionkey") + 1).cast("int").alias("n_rows")).select(one, "n_rows")
    cols = cells.groupBy("t").agg((F.max("col") + 1).alias("n_cols"))
    return joins.dense_grid(rows, cols, cells, ["t"], F.lit("")).select("row", "col", "text")


@query("""
    WITH s AS (SELECT o_custkey AS k, o_orderkey AS start, o_orderpriority AS shape FROM orders),
    p AS (SELECT o_custkey AS k, o_orderkey + 3 AS pos FROM orders)
    SELECT k, pos, (SELECT shape FROM s WHERE s.k = p.k AND s.start <= p.pos ORDER BY start DESC LIMIT 1) AS shape FROM p""")
def char_run_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with the run they lie in; a run ends where the next begins."""
    o = table(spark, sf_dir, "orders")
    starts = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("start"), F.col("o_orderpriority").alias("shape"))
    return joins.interval_of(o.select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") + 3).alias("pos")), starts, ["k"], "pos", "start", "shape")


@query("""
    WITH q AS (SELECT o_custkey AS k, o_orderkey AS start, (o_orderkey % 7 - 3)::BIGINT AS delta FROM orders WHERE o_orderkey % 2 = 0), p AS (SELECT o_custkey AS k, o_orderkey AS pos FROM orders)
    SELECT p.k, p.pos, coalesce((SELECT sum(delta) FROM q WHERE q.k = p.k AND q.start < p.pos), 0)::BIGINT AS shift FROM p""")
def cp_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift of each position by the patches that start before it."""
    o = table(spark, sf_dir, "orders")
    patches = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") % 7 - 3).alias("delta"))
    return joins.shifted(o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("pos")), patches, ["k"], "pos", "start", "delta")


@query("SELECT l_orderkey, l_linenumber, coalesce(sum(span) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS col FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) % 3 + 1 AS span FROM lineitem GROUP BY ALL)")
def colspan_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_suppkey") % 3 + 1).alias("span"))
    return windows.running_start(cells, ["l_orderkey"], "l_linenumber", "span", "col").select("l_orderkey", "l_linenumber", "col")


@query("""
    WITH c AS (SELECT DISTINCT l_orderkey AS t, l_linenumber AS row, (l_orderkey % 2)::INT AS col, l_linenumber > 1 AND l_returnflag = 'N' AS goes_on FROM lineitem),
    r AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY t, col ORDER BY row) AS run FROM c)
    SELECT t, col, min(row) AS row, count(*) AS rowspan FROM r GROUP BY t, col, run""")
def vmerge_rowspan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("row"), (F.col("l_orderkey") % 2).cast("int").alias("col"), ((F.col("l_linenumber") > 1) & (F.col("l_returnflag") == "N")).alias("goes_on")).distinct()
    return windows.vertical_spans(cells, "t", "row", "col", F.col("goes_on"))


@query("""
    WITH i AS (SELECT l_orderkey AS d, l_linenumber AS i, CASE WHEN l_linenumber = 1 OR l_returnflag = 'R' THEN 0 ELSE 1 END AS level FROM lineitem),
    m AS (SELECT *, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY i) AS major FROM i),
    n AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY d, major ORDER BY i) AS minor FROM m)
    SELECT d, i, CASE WHEN level = 0 THEN major || '.' ELSE major || '.' || minor END AS label FROM n""")
def list_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("i"), F.when((F.col("l_linenumber") == 1) | (F.col("l_returnflag") == "R"), 0).otherwise(1).alias("level"))
    return windows.list_numbers(items, ["d"], "i", "level").select("d", "i", "label")


_CELLS = """cells AS (SELECT o_custkey % 200 AS t, ((row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) - 1) // 4)::INT AS row, ((row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) - 1) % 4)::INT AS col,
      CASE WHEN o_custkey % 200 % 2 = 0 AND o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS raw FROM orders),
    c AS (SELECT t, row, col, CASE WHEN row = 0 AND raw = '' THEN 'head' ELSE raw END AS text FROM cells)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    t = F.col("o_custkey") % 200
    n = F.row_number().over(Window.partitionBy("t").orderBy("o_orderkey")) - 1
    o = table(spark, sf_dir, "orders").select(t.alias("t"), "o_orderkey", F.when((t % 2 == 0) & (F.col("o_orderkey") % 5 == 0), "").otherwise(F.col("o_orderpriority")).alias("raw"))
    o = o.withColumn("n", n).select("t", F.floor(F.col("n") / 4).cast("int").alias("row"), (F.col("n") % 4).cast("int").alias("col"), "raw")
    return o.select("t", "row", "col", F.when((F.col("row") == 0) & (F.col("raw") == ""), "head").otherwise(F.col("raw")).alias("text"))


@query(f"""
    WITH {_CELLS}, f AS (SELECT t, max(row) >= 1 AND bool_and(row > 0 OR text <> '') AND bool_or(row > 0 AND text = '') AS header FROM c GROUP BY t),
    l AS (SELECT c.*, f.header, lag(text) OVER (PARTITION BY c.t, row ORDER BY col) AS before FROM c JOIN f USING (t))
    SELECT l.t, l.row, l.col, l.text, CASE WHEN header THEN CASE WHEN l.row = 0 THEN l.text ELSE coalesce(h.text, '') END WHEN l.col % 2 = 0 THEN l.text ELSE coalesce(before, '') END AS label,
           CASE WHEN header THEN l.row = 0 ELSE l.col % 2 = 0 END AS is_label
    FROM l LEFT JOIN c h ON h.t = l.t AND h.row = 0 AND h.col = l.col""")
def table_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of cells, in header form and in pair form."""
    return joins.labelled(_cells(spark, sf_dir), ["t"])


@query(f"""
    WITH {_CELLS}, e AS (SELECT t, row, col, CASE WHEN row % 2 = 0 THEN text || '!' ELSE text END AS text FROM c WHERE col < 3)
    SELECT e.t, e.row, e.col, e.text FROM e JOIN c USING (t, row, col) WHERE e.text <> c.text""")
def apply_edits_changed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    edits = cells.where("col < 3").withColumn("text", F.when(F.col("row") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return joins.changed_only(edits, cells, ["t", "row", "col"])


@query(f"""
    WITH {_CELLS}, e AS (SELECT t, row, col, 'new' AS text FROM c WHERE row = 1)
    SELECT c.t, c.row, c.col, coalesce(e.text, c.text) AS text FROM c LEFT JOIN e USING (t, row, col)""")
def patch_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    return joins.patched(cells, cells.where("row = 1").withColumn("text", F.lit("new")), ["t", "row", "col"])


@query("""
    SELECT n_nationkey AS k, r::INT AS row, c::INT AS col, 's' || c AS style, CASE WHEN (r + c) % 2 = 0 THEN n_name ELSE '' END AS text FROM nation, range(0, 3) a(r), range(0, 3) b(c)""")
def row_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template row laid under three rows of values."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    template = n.select("k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("col")).withColumn("style", F.concat(F.lit("s"), F.col("col").cast("string")))
    values = n.select("k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("row"), "n_name").select("k", "row", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("col"), F.col("n_name").alias("text")).where("(row + col) % 2 = 0")
    return joins.extended_rows(template, values, ["k"])


@query("SELECT n_nationkey, n_name, coalesce(r_name, 'BODY') AS style FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def palette_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("style"))
    return joins.with_fallback(table(spark, sf_dir, "nation"), dim, "n_regionkey", "style", "BODY").select("n_nationkey", "n_name", "style")


@query("""
    WITH RECURSIVE s AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 0 THEN 24 WHEN n_nationkey % 5 = 0 AND n_nationkey <> 20 THEN NULL ELSE n_nationkey // 2 END AS up, CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey + 10 END AS size, CASE WHEN n_nationkey % 7 = 0 THEN n_name END AS font FROM nation),
    r AS (SELECT id, up, size, font, 0 AS n FROM s UNION ALL SELECT r.id, s.up, coalesce(r.size, s.size), coalesce(r.font, s.font), n + 1 FROM r LEFT JOIN s ON r.up = s.id WHERE n < 8)
    SELECT id AS style_id, size, font FROM r WHERE n = 8""")
def style_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles with what they inherit; the chain has a cycle."""
    k = F.col("n_nationkey")
    up = F.when(k == 0, 24).when((k % 5 == 0) & (k != 20), None).otherwise(F.floor(k / 2).cast("int"))
    styles = table(spark, sf_dir, "nation").select(k.alias("style_id"), up.alias("based_on"), F.when(k % 5 == 0, k + 10).alias("size"), F.when(k % 7 == 0, F.col("n_name")).alias("font"))
    return joins.inherited(spark, styles, ["size", "font"], 8)


_FINDINGS = "f AS (SELECT user_id AS name, CASE event_type WHEN 'error' THEN 'high' WHEN 'click' THEN 'med' WHEN 'view' THEN 'low' ELSE 'other' END AS severity, event_type AS dim, (event_id % 80)::INT AS count, event_id FROM events)"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    severity = F.when(kind == "error", "high").when(kind == "click", "med").when(kind == "view", "low").otherwise("other")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), severity.alias("severity"), kind.alias("dim"), (F.col("event_id") % 80).cast("int").alias("count"), "event_id")


_SCORE = "sum(CASE severity WHEN 'high' THEN 100 WHEN 'med' THEN 10 ELSE 1 END * least(count, 50))::BIGINT"


@query(f"WITH {_FINDINGS} SELECT name, {_SCORE} AS score FROM f GROUP BY name")
def score_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.scores(_findings(spark, sf_dir))


@query(f"""
    WITH {_FINDINGS}, a AS (SELECT name, {_SCORE} AS was FROM f WHERE event_id % 3 = 0 AND name % 5 <> 0 GROUP BY name), b AS (SELECT name, {_SCORE} AS now FROM f WHERE event_id % 3 = 1 AND name % 7 <> 0 GROUP BY name)
    SELECT name, was, now, CASE WHEN now IS NULL THEN 'gone' WHEN was IS NULL THEN CASE WHEN now > 0 THEN 'new' ELSE 'same' END WHEN now < was AND now = 0 THEN 'fixed' WHEN now < was THEN 'improved' WHEN now > was THEN 'regressed' ELSE 'same' END AS state
    FROM a FULL JOIN b USING (name)""")
def board_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir)
    return audit.board_diff(audit.scores(f.where("event_id % 3 = 0 and name % 5 <> 0")), audit.scores(f.where("event_id % 3 = 1 and name % 7 <> 0")))


@query(f"WITH {_FINDINGS} SELECT dim, severity, count(*) AS n, sum(count)::BIGINT AS total FROM f GROUP BY ROLLUP (dim, severity)")
def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).rollup("dim", "severity").agg(F.count("*").alias("n"), F.sum("count").alias("total"))


@query("""
    WITH p AS (SELECT user_id, round(value / 100, 4) AS s FROM events WHERE value IS NOT NULL), o AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM p)
    SELECT user_id, round(max(CASE WHEN i = n // 2 + 1 THEN s END), 3) AS median, round(avg(s), 3) AS mean, round(min(s), 3) AS worst, sum((s < 0.85)::INT)::BIGINT AS failed FROM o GROUP BY user_id""")
def visual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page scores summed up by document (event values stand for scores)."""
    pages = table(spark, sf_dir, "events").where("value is not null").select("user_id", F.round(F.col("value") / 100, 4).alias("ssim"))
    return audit.visual_summary(pages, "user_id")


_CHARS = "SELECT {id}, ch, count(*) AS n FROM (SELECT {id}, unnest(string_split(regexp_replace({text}, '\\s+', '', 'g'), '')) AS ch FROM {t}) WHERE ch <> '' GROUP BY ALL"


@query(f"""
    WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1) AS text, regexp_extract(html, '(?is)<article>(.*)</article>', 1) AS seen FROM pages WHERE html IS NOT NULL),
    a AS ({_CHARS.format(id='page_id', text='text', t='p')}), b AS ({_CHARS.format(id='page_id', text='seen', t='p')}),
    j AS (SELECT a.page_id, sum(least(a.n, coalesce(b.n, 0))) AS kept, sum(a.n) AS n FROM a LEFT JOIN b USING (page_id, ch) GROUP BY a.page_id)
    SELECT p.page_id, coalesce(j.n, 0)::BIGINT AS n_chars, coalesce(j.kept / j.n, 1.0)::DOUBLE AS coverage FROM p LEFT JOIN j USING (page_id)""")
def multiset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of a page body's characters that its article has."""
    p = table(spark, sf_dir, "pages").where("html is not null")
    body, article = F.regexp_extract("html", r"(?is)<body[^>]*>(.*)</body>", 1), F.regexp_extract("html", r"(?is)<article>(.*)</article>", 1)
    return audit.coverage(p.select("page_id", body.alias("text")), p.select("page_id", article.alias("text")), "page_id")


@query("""
    SELECT page_id, symbol, count(*) AS n FROM (SELECT page_id, unnest(string_split(regexp_replace(text, '[^©·→★]', '', 'g'), '')) AS symbol, article FROM
      (SELECT page_id, replace(replace(html, '&copy;', '©'), '&middot;', '·') || CASE WHEN page_id % 2 = 0 THEN '→★' ELSE '→' END AS text, html || '→' AS article FROM pages WHERE html IS NOT NULL))
    WHERE symbol <> '' AND NOT contains(article, symbol) GROUP BY page_id, symbol""")
def dropped_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the decoded page that the page as it is written lacks."""
    p = table(spark, sf_dir, "pages").where("html is not null")
    text = F.concat(T.swap(F.col("html"), ("&copy;", "©"), ("&middot;", "·")), F.when(F.col("page_id") % 2 == 0, "→★").otherwise("→"))
    return audit.dropped_symbols(p.select("page_id", text.alias("text")), p.select("page_id", F.concat("html", F.lit("→")).alias("text")), "page_id")


@query("""
    WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<p>([^<]*)', 1)) AS text, generate_subscripts(regexp_extract_all(html, '(?is)<p>([^<]*)', 1), 1) AS i FROM pages),
    r AS (SELECT page_id, left(text, 28) AS probe, row_number() OVER (PARTITION BY page_id ORDER BY len(text) DESC, i) AS n FROM p WHERE len(text) >= 4)
    SELECT page_id, probe FROM r WHERE n = 1""")
def longest_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 28 characters of each page's longest paragraph."""
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<p>([^<]*)"), F.lit(1))).alias("i", "text")).where(F.length("text") >= 4)
    return p.groupBy("page_id").agg(F.left(F.max_by("text", F.struct(F.length("text"), -F.col("i"))), F.lit(28)).alias("probe"))


@query("""
    WITH s AS (SELECT conv_id, turn, 's' || turn AS slot_id, text FROM conversations), f AS (SELECT conv_id, turn FROM s WHERE turn % 3 = 1)
    SELECT conv_id, slot_id, len(text)::INT AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.conv_id = s.conv_id AND f.turn = s.turn)""")
def slot_fill_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots that no group has taken."""
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("s"), F.col("turn").cast("string")).alias("slot_id"), "text")
    return s.join(s.where("turn % 3 = 1").select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").select("conv_id", "slot_id", F.length("text").alias("n"))


@query("""SELECT conv_id, 'rp-' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS token, turn, coalesce(turn > max(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS breaks FROM conversations""")
def token_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return windows.page_breaks(windows.tokens(c, "conv_id", "turn", "rp", "token"), "conv_id", "turn", "turn").select("conv_id", "token", "turn", "breaks")


@query("""
    SELECT o_orderkey, CASE WHEN i THEN CASE WHEN h THEN v / 100 ELSE v END ELSE NULL END AS value FROM
      (SELECT o_orderkey, (o_orderkey % 1000 - 500)::DOUBLE AS v, o_orderkey % 2 = 0 AS h, true AS i FROM orders)""")
def rk_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed 30-bit integers, every other one in hundredths."""
    v = F.col("o_orderkey") % 1000 - 500
    rk = F.pmod(v * 4 + 2 + F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(0), F.lit(2**32))
    return table(spark, sf_dir, "orders").select("o_orderkey", G.rk_number(rk).alias("value"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ppt/media/image' || page_id || '.png' WHEN 1 THEN 'x/y.xml' WHEN 2 THEN 'ppt/slides/a/b.xml' ELSE 'z' END AS path, 'ppt/slides/_rels/slide' || page_id || '.xml.rels' AS rels FROM pages""")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    base = F.concat(F.lit("ppt/slides/slide"), n, F.lit(".xml"))
    target = F.when(k == 0, F.concat(F.lit("../media/image"), n, F.lit(".png"))).when(k == 1, "/x/y.xml").when(k == 2, "./a/b.xml").otherwise("../../../z")
    return table(spark, sf_dir, "pages").select("page_id", G.resolve_path(base, target).alias("path"), G.rels_path(base).alias("rels"))
