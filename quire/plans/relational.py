"""Queries that apply the relational operators and column functions to the star-schema tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blend as blends
from ..functions import colour, dates, flags, geometry, labels, programs, typefaces
from ..operators import forms, hierarchy, layout, lookup, policy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r4(x):
    """Rounded to four places, without a negative zero."""
    return F.round(x, 4) + 0.0


_ROMAN = """
    repeat('M', (n // 1000)::INT) || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[(n // 100 % 10 + 1)::INT]
    || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[(n // 10 % 10 + 1)::INT] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[(n % 10 + 1)::INT]
"""


@query(
    f"""
WITH pages AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page, o_orderpriority FROM orders),
marks AS (SELECT o_custkey, page AS start, (['D', 'R', 'r', 'A', 'a'])[(o_orderkey % 5 + 1)::INT] AS style FROM pages WHERE o_orderpriority = '1-URGENT'),
found AS (SELECT p.o_custkey, p.page, m.style, CASE WHEN m.start IS NULL THEN p.page + 1 ELSE p.page - m.start + 1 END AS n FROM pages p ASOF LEFT JOIN marks m ON p.o_custkey = m.o_custkey AND p.page >= m.start)
SELECT o_custkey, page::BIGINT AS page, CASE coalesce(style, 'D') WHEN 'D' THEN n::VARCHAR WHEN 'R' THEN {_ROMAN} WHEN 'r' THEN lower({_ROMAN})
  WHEN 'A' THEN repeat(chr((65 + (n - 1) % 26)::INT), ((n - 1) // 26 + 1)::INT) ELSE repeat(chr((97 + (n - 1) % 26)::INT), ((n - 1) // 26 + 1)::INT) END AS label FROM found
"""
)
def label_asof(spark, sf_dir):
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    pages = orders.withColumn("page", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long") - 1)
    marks = pages.where("o_orderpriority = '1-URGENT'").select("o_custkey", "page", F.col("page").alias("start"), F.get(F.array(*map(F.lit, "DRrAa")), (F.col("o_orderkey") % 5).cast("int")).alias("style"))
    found = lookup.as_of(pages.select("o_custkey", "page"), marks, ["o_custkey"], "page", ["start", "style"])
    n = F.col("page") - F.coalesce("start", F.lit(0)) + 1
    return found.select("o_custkey", "page", labels.page_label(F.lit(""), F.coalesce("style", F.lit("D")), n).alias("label"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1")
def revision_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    newest = lookup.first_by(rows, ["l_orderkey", "l_linenumber"], -F.unix_micros(F.col("l_shipdate").cast("timestamp")), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.col("l_extendedprice"))
    return newest.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("SELECT l_orderkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey")
def repair_last_wins(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_linenumber", F.struct("l_linenumber", "l_partkey")).alias("l_linenumber"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <= 30 AND l_quantity + 5 >= 10 AND l_tax * 1000 <= 60 AND l_tax * 1000 + 10 >= 20")
def area_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    box = geometry.rectangle(F.col("l_quantity"), F.col("l_tax") * 1000, F.col("l_quantity") + 5, F.col("l_tax") * 1000 + 10)
    return rows.where(geometry.intersects(box, geometry.rectangle(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(60.0)))).select("l_orderkey", "l_linenumber")


@query(
    """
WITH areas AS (SELECT s_suppkey, floor(s_acctbal) AS low, floor(s_acctbal) + 25 AS high FROM supplier),
hit AS (SELECT c.c_custkey, a.* FROM customer c JOIN areas a ON c.c_acctbal BETWEEN a.low AND a.high)
SELECT c.c_custkey, max(s_suppkey)::DOUBLE AS s_suppkey FROM customer c LEFT JOIN hit USING (c_custkey) GROUP BY c.c_custkey
"""
)
def area_join(spark, sf_dir):
    areas = table(spark, sf_dir, "supplier").select("s_suppkey", F.floor("s_acctbal").alias("low"), (F.floor("s_acctbal") + 25).alias("high"))
    return lookup.range_lookup(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), areas, "c_acctbal", "low", "high", 100, "s_suppkey").select("c_custkey", F.col("s_suppkey").cast("double").alias("s_suppkey"))


def _lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))


_LINES = "WITH lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS seq, unnest(string_split(text, chr(10))) AS text FROM documents)"


@query(f"{_LINES} SELECT doc_id, seq::INT AS seq FROM lines WHERE contains(text, 'License')")
def text_search(spark, sf_dir):
    return layout.search(_lines(spark, sf_dir), "License").select("doc_id", "seq")


@query(f"{_LINES} SELECT doc_id, seq::INT AS seq FROM lines WHERE contains(lower(text), 'license')")
def text_search_ignore_case(spark, sf_dir):
    return layout.search(_lines(spark, sf_dir), "LICENSE", ignore_case=True).select("doc_id", "seq")


def _grid(spark, sf_dir) -> DataFrame:
    """Runs of all words of a document's turns, eight to a line, on a grid that leaves no doubt; lines go on below zero."""
    turns = table(spark, sf_dir, "conversations")
    words = turns.select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("page"), F.posexplode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), 0)).alias("seq", "text"))
    x, y = (F.col("seq") % 8) * 60.0, 700.0 - F.floor(F.col("seq") / 8) * 20
    return words.select("doc", "page", (F.lit(1000) - F.col("seq")).alias("seq"), "text", x.alias("left"), y.cast("double").alias("bottom"), (x + 20).alias("right"), (y + 10).cast("double").alias("top"), F.lit(10.0).alias("font_size"), F.lit(False).alias("space_after"), F.lit(False).alias("rtl"), F.lit(False).alias("vertical"))


_GRID = "WITH w AS (SELECT conv_id AS doc, turn::INT AS page, unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS word, unnest(range(len(regexp_extract_all(text, '[a-zA-Z]+')))) AS i FROM conversations), g AS (SELECT * FROM w)"


@query(f"{_GRID}, lines AS (SELECT doc, page, i // 8 AS line, string_agg(word, ' ' ORDER BY i) AS text FROM g GROUP BY ALL) SELECT doc, page, string_agg(text, chr(10) ORDER BY line) AS text FROM lines GROUP BY ALL")
def layout_join(spark, sf_dir):
    return layout.page_text(_grid(spark, sf_dir), ["doc", "page"], "physical")


@query(f"{_GRID} SELECT doc, page, string_agg(word, '' ORDER BY i DESC) AS text FROM g GROUP BY ALL")
def layout_raw(spark, sf_dir):
    return layout.page_text(_grid(spark, sf_dir), ["doc", "page"], "raw")


@query(f"{_GRID}, lines AS (SELECT doc, page, i // 8 AS line, string_agg(word, ' ' ORDER BY i) AS text FROM g WHERE i % 8 BETWEEN 1 AND 3 GROUP BY ALL), pages AS (SELECT DISTINCT doc, page FROM g) SELECT doc, page, coalesce(string_agg(text, chr(10) ORDER BY line), '') AS text FROM pages LEFT JOIN lines USING (doc, page) GROUP BY ALL")
def layout_area(spark, sf_dir):
    return layout.page_text(_grid(spark, sf_dir), ["doc", "page"], "physical", (50.0, float("-inf"), 190.0, 800.0))


@query(
    f"""{_GRID}, sized AS (SELECT doc, page, max(i) AS top FROM g GROUP BY ALL),
placed AS (SELECT g.*, i // 8 AS line, CASE WHEN i % 8 < 3 THEN 0 ELSE 1 END AS side FROM g WHERE i % 8 IN (0, 1, 2, 5, 6, 7)),
lines AS (SELECT doc, page, side, line, string_agg(word, ' ' ORDER BY i) AS text FROM placed GROUP BY ALL)
SELECT doc, page, string_agg(text, chr(10) ORDER BY side, line) AS text FROM lines JOIN sized USING (doc, page) WHERE top >= 15 GROUP BY ALL"""
)
def layout_columns(spark, sf_dir):
    """Two columns of three words with a wide gap between them, read one after the other."""
    runs = _grid(spark, sf_dir).where(((F.lit(1000) - F.col("seq")) % 8).isin(0, 1, 2, 5, 6, 7))
    full = _grid(spark, sf_dir).groupBy("doc", "page").agg(F.min("seq").alias("low")).where("low <= 985").select("doc", "page")
    return layout.page_text(runs.join(full, ["doc", "page"], "left_semi"), ["doc", "page"], "reading")


@query(
    """
WITH RECURSIVE runs AS (SELECT l_orderkey AS doc, l_linenumber AS seq, 700 - l_linenumber * 2.0 - l_tax * 20 AS bottom, 8.0 + l_linenumber % 3 AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY 700 - l_linenumber * 2.0 - l_tax * 20 DESC, l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
fold AS (SELECT doc, k, [bottom] AS firsts, [size] AS sizes FROM runs WHERE k = 1
 UNION ALL SELECT r.doc, r.k, CASE WHEN len(near) > 0 THEN firsts ELSE list_append(firsts, r.bottom) END, CASE WHEN len(near) > 0 THEN sizes ELSE list_append(sizes, r.size) END
 FROM (SELECT f.*, r2.bottom AS b2, r2.size AS s2, r2.k AS k2, list_filter(range(1, len(f.firsts) + 1), lambda i: abs(f.firsts[i] - r2.bottom) <= greatest(1.5, 0.35 * greatest(f.sizes[i], r2.size))) AS near FROM fold f JOIN runs r2 ON r2.doc = f.doc AND r2.k = f.k + 1) x JOIN runs r ON r.doc = x.doc AND r.k = x.k2)
SELECT doc, max(len(firsts))::BIGINT AS n_lines FROM fold GROUP BY doc
"""
)
def line_cluster(spark, sf_dir):
    """Greedy lines of jittered runs of every order; the rule is order-dependent."""
    from pyspark.sql import Window

    items = table(spark, sf_dir, "lineitem")
    bottom = F.lit(700) - F.col("l_linenumber") * F.lit(2.0) - F.col("l_tax") * 20
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    runs = items.select(F.col("l_orderkey").alias("doc"), nth.alias("seq"), F.lit("x").alias("text"), F.lit(0.0).alias("left"), bottom.alias("bottom"), F.lit(1.0).alias("right"), bottom.alias("top"), (8.0 + F.col("l_linenumber") % 3).alias("font_size"), F.lit(False).alias("space_after"), F.lit(False).alias("rtl"), F.lit(False).alias("vertical"))
    pages = runs.groupBy("doc").agg(F.collect_list(F.struct(*layout.RUN)).alias("runs"))
    return pages.select("doc", F.size(layout.lines_of(layout.by_seq(F.col("runs")))).cast("long").alias("n_lines"))


@query(
    """
WITH s AS (SELECT user_id, list(value > 50 ORDER BY event_id) AS states, (['AnyOn', 'AllOn', 'AnyOff', 'AllOff', 'Odd'])[(user_id % 5 + 1)::INT] AS policy FROM events GROUP BY user_id)
SELECT user_id, policy, CASE policy WHEN 'AllOn' THEN list_bool_and(states) WHEN 'AnyOff' THEN NOT list_bool_and(states) WHEN 'AllOff' THEN NOT list_bool_or(states) ELSE list_bool_or(states) END AS visible FROM s
"""
)
def policy_visibility(spark, sf_dir):
    sets = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.col("value") > 50).alias("states"))
    sets = sets.withColumn("policy", F.get(F.array(*map(F.lit, (*policy.POLICIES, "Odd"))), (F.col("user_id") % 5).cast("int")))
    return sets.select("user_id", "policy", policy.membership_visible(F.col("policy"), F.col("states")).alias("visible"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN value > 60 WHEN event_id % 3 = 0 THEN false WHEN event_id % 2 = 0 THEN true ELSE event_id % 5 <> 1 END AS visible FROM events")
def layer_state(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(e % 5 == 1, "OFF").when(e % 5 == 2, "Unchanged").otherwise("ON").alias("base"), (e % 2 == 0).alias("is_on"), (e % 3 == 0).alias("is_off"), F.when(e % 7 == 0, F.col("value") > 60).alias("view_state"))
    return policy.layer_states(rows).select("event_id", "visible")


@query("SELECT event_id, ((event_id % 2 = 0) OR NOT (event_id % 3 = 0)) AND (event_id % 5 <> 0) AS visible FROM events")
def layer_expression(spark, sf_dir):
    e = F.col("event_id")
    states = {"a": e % 2 == 0, "b": e % 3 == 0, "c": e % 5 != 0}
    return table(spark, sf_dir, "events").select("event_id", policy.expression_visible(["And", ["Or", "a", ["Not", "b"]], "c", ["Not", "a", "b"]], states).alias("visible"))


@query(
    """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey * 37 + l_suppkey) % 4096 AS p, 2 + l_linenumber % 3 AS rev, l_quantity > 45 AS own, l_quantity < 4 AS locked FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, sum((NOT locked AND (own OR p & 4 <> 0))::INT) AS print, sum((NOT locked AND (own OR p & 8 <> 0))::INT) AS modify, sum((NOT locked AND (own OR p & 16 <> 0))::INT) AS copy, sum((NOT locked AND (own OR p & 32 <> 0))::INT) AS annotate,
 sum((NOT locked AND (own OR p & 256 <> 0))::INT) AS fill_forms, sum((NOT locked AND (own OR p & 512 <> 0))::INT) AS accessibility, sum((NOT locked AND (own OR p & 1024 <> 0))::INT) AS assemble, sum((NOT locked AND (own OR (p & 4 <> 0 AND (rev = 2 OR p & 2048 <> 0))))::INT) AS print_high_res FROM p GROUP BY ALL
""".replace("sum((", "sum(CAST((").replace(")::INT)", ") AS BIGINT))")
)
def permission_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    p = (F.col("l_partkey") * 37 + F.col("l_suppkey")) % 4096
    own = flags.permissions(p, 2 + F.col("l_linenumber") % 3, F.col("l_quantity") > 45, F.col("l_quantity") < 4)
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", own.alias("p"))
    names = [*flags.PERMISSION_BITS, "print_high_res"]
    return rows.groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(*[F.sum(F.col(f"p.{x}").cast("long")).cast("decimal(38,0)").cast("double").alias(x) for x in names])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (CASE WHEN (l_partkey % 64) & 35 <> 0 THEN false WHEN l_linenumber = 1 AND l_quantity < 25 THEN false ELSE l_suppkey % 5 <> 0 END) AS visible FROM lineitem")
def annotation_visibility(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    shown = flags.annotation_visible(F.col("l_partkey") % 64, F.col("l_linenumber") == 1, F.col("l_quantity") >= 25, F.col("l_suppkey") % 5 != 0)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shown.alias("visible"))


@query("SELECT user_id, count(*) FILTER (event_type IN ('click', 'view')) AS n_gradients, count(*) FILTER (event_type = 'purchase') AS n_paths FROM events GROUP BY user_id")
def element_counts(spark, sf_dir):
    return policy.count_kinds(table(spark, sf_dir, "events"), ["user_id"], "event_type", {"n_gradients": ["click", "view"], "n_paths": ["purchase"]})


_TREE = """WITH t AS (SELECT 'r' || r_regionkey AS node, NULL AS parent, r_regionkey::BIGINT AS nth FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey FROM customer)"""


def _tree(spark, sf_dir) -> DataFrame:
    pick = lambda t, mark, key, up, up_mark: table(spark, sf_dir, t).select(F.concat(F.lit(mark), key).alias("node"), (F.concat(F.lit(up_mark), up) if up else F.lit(None).cast("string")).alias("parent"), F.col(key).cast("long").alias("nth"))
    return pick("region", "r", "r_regionkey", None, None).union(pick("nation", "n", "n_nationkey", "n_regionkey", "r")).union(pick("customer", "c", "c_custkey", "c_nationkey", "n"))


@query(f"{_TREE}, a AS (SELECT t.node, t.nth AS n0, NULL::BIGINT AS n1, NULL::BIGINT AS n2, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.node, u.nth, t.nth, NULL, 1 FROM t JOIN t u ON t.parent = u.node WHERE u.parent IS NULL UNION ALL SELECT t.node, v.nth, u.nth, t.nth, 2 FROM t JOIN t u ON t.parent = u.node JOIN t v ON u.parent = v.node) SELECT node, depth, row_number() OVER (ORDER BY n0, n1 NULLS FIRST, n2 NULLS FIRST) - 1 AS preorder FROM a")
def outline_flatten(spark, sf_dir):
    one = _tree(spark, sf_dir).withColumn("doc", F.lit(0))
    return hierarchy.flatten_tree(one, ["doc"], 3).select("node", "depth", F.col("preorder").cast("long").alias("preorder"))


@query(
    """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'own' || c_custkey WHEN n_nationkey % 2 = 0 THEN 'n' || n_nationkey ELSE 'r' || n_regionkey END AS da, CASE WHEN c_custkey % 5 = 0 THEN 'own' || c_custkey WHEN n_nationkey % 3 = 0 THEN 'n' || n_nationkey END AS q
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
)
def form_inherit(spark, sf_dir):
    tree = _tree(spark, sf_dir).withColumn("doc", F.lit(0))
    number, mark = F.col("nth"), F.substring("node", 1, 1)
    da = F.when(mark == "r", F.col("node")).when((mark == "n") & (number % 2 == 0), F.col("node")).when((mark == "c") & (number % 2 == 0), F.concat(F.lit("own"), number.cast("string")))
    q = F.when((mark == "n") & (number % 3 == 0), F.col("node")).when((mark == "c") & (number % 5 == 0), F.concat(F.lit("own"), number.cast("string")))
    full = hierarchy.inherit(tree.withColumn("da", da).withColumn("q", q), ["doc"], ["da", "q"], 3)
    return full.where(F.col("node").startswith("c")).select(F.substring("node", 2, 20).cast("long").alias("c_custkey"), "da", "q")


@query("SELECT a.conv_id, a.turn, a.role, b.role AS parent_role, coalesce(length(b.text), -1)::INT AS parent_chars FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def thread_join(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"), F.col("turn").alias("id"), (F.col("turn") - 1).alias("parent"))
    found = lookup.linked(turns, ["conv_id"], "id", {"parent": ["role", "chars"]})
    return found.select("conv_id", "turn", "role", "parent_role", F.coalesce("parent_chars", F.lit(-1)).alias("parent_chars"))


@query("SELECT coalesce(s.s_nationkey, c.c_nationkey) AS nation, CASE WHEN s.s_nationkey IS NOT NULL THEN s.v ELSE c.v END AS v FROM (SELECT s_nationkey, 'supplier ' || min(s_suppkey) AS v FROM supplier GROUP BY ALL) s FULL JOIN (SELECT c_nationkey, 'customer ' || min(c_custkey) AS v FROM customer GROUP BY ALL) c ON s.s_nationkey = c.c_nationkey")
def destination_override(spark, sf_dir):
    first = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.concat(F.lit("customer "), F.min("c_custkey").cast("string")).alias("v"))
    second = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.concat(F.lit("supplier "), F.min("s_suppkey").cast("string")).alias("v"))
    return lookup.override([first, second], ["nation"])


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def widget_semi(spark, sf_dir):
    return lookup.having(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def layer_anti(spark, sf_dir):
    return lookup.unknown(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query(
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 11 = 0 THEN -1 ELSE epoch(date_trunc('second', l_shipdate))::BIGINT + l_linenumber * 3661 END AS utc_seconds, CASE WHEN l_partkey % 11 = 0 THEN -1 ELSE (CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE -1 END * ((l_suppkey % 12) * 60 + 30))::INT END AS offset_min FROM lineitem
"""
)
def pdf_date(spark, sf_dir):
    """Dates written in local time with an offset and read again; a month of 13 is no date."""
    rows = table(spark, sf_dir, "lineitem")
    minutes = F.when(F.col("l_suppkey") % 2 == 0, 1).otherwise(-1) * ((F.col("l_suppkey") % 12) * 60 + 30)
    utc = F.unix_timestamp(F.date_trunc("second", F.col("l_shipdate").cast("timestamp"))) + F.col("l_linenumber") * 3661
    local = F.timestamp_seconds(utc + minutes * 60)
    sign = F.when(minutes < 0, "-").otherwise("+")
    text = F.concat(F.lit("D:"), F.date_format(local, "yyyy"), F.when(F.col("l_partkey") % 11 == 0, "13").otherwise(F.date_format(local, "MM")), F.date_format(local, "ddHHmmss"), sign, F.lpad(F.floor(F.abs(minutes) / 60).cast("string"), 2, "0"), F.lit("'30'"))
    found = dates.pdf_date(text)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(F.unix_timestamp(found["ts"]), F.lit(-1)).alias("utc_seconds"), F.coalesce(found["offset_min"], F.lit(-1)).alias("offset_min"))


_KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_KEY_SQL = ", ".join(_KEYS)


def _numbers(spark, sf_dir) -> tuple[DataFrame, list]:
    rows = table(spark, sf_dir, "lineitem")
    return rows, [F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12, F.col("l_linenumber") / 8]


@query(f"SELECT {_KEY_SQL}, " + ", ".join(f"round(1 - least(1.0, {x} * (1 - l_linenumber / 8) + l_linenumber / 8), 4) + 0.0 AS {n}" for n, x in (("red", "l_quantity / 50"), ("green", "l_discount * 10"), ("blue", "l_tax * 12"))) + " FROM lineitem")
def cmyk_rgb(spark, sf_dir):
    rows, x = _numbers(spark, sf_dir)
    return rows.select(*_KEYS, *[r4(c).alias(n) for c, n in zip(colour.cmyk_to_rgb(*x), ("red", "green", "blue"))])


def _gamma(x: str) -> str:
    x = f"least(greatest({x}, 0), 1)"
    return f"CASE WHEN {x} <= 0.0031308 THEN 12.92 * {x} ELSE 1.055 * pow({x}, 1 / 2.4) - 0.055 END"


def _linear(m, names) -> list[str]:
    return ["(" + " + ".join(f"({c}) * {n}" for c, n in zip(r, names)) + ")" for r in m]


_WHITE = (0.9642, 1.0, 0.8249)
_HAVE = [sum(a * b for a, b in zip(r, _WHITE)) for r in colour.BRADFORD]
_WANT = [sum(a * b for a, b in zip(r, colour.D65)) for r in colour.BRADFORD]


def _xyz_sql(source: str) -> str:
    cone = ", ".join(f"{x} * {w / h!r} AS k{i}" for i, (x, w, h) in enumerate(zip(_linear(colour.BRADFORD, "xyz"), _WANT, _HAVE)))
    back = ", ".join(f"{x} AS d{i}" for i, x in enumerate(_linear(colour.BRADFORD_BACK, ("k0", "k1", "k2"))))
    rgb = ", ".join(f"round({_gamma(x)}, 4) + 0.0 AS {n}" for x, n in zip(_linear(colour.XYZ_TO_RGB, ("d0", "d1", "d2")), ("red", "green", "blue")))
    return f"WITH v AS ({source}), cone AS (SELECT *, {cone} FROM v), back AS (SELECT *, {back} FROM cone) SELECT {_KEY_SQL}, {rgb} FROM back"


@query(_xyz_sql(f"SELECT {_KEY_SQL}, l_quantity / 50 AS x, l_discount * 10 AS y, l_tax * 12 AS z FROM lineitem"))
def xyz_bradford(spark, sf_dir):
    rows, x = _numbers(spark, sf_dir)
    return rows.select(*_KEYS, *[r4(c).alias(n) for c, n in zip(colour.xyz_to_srgb(tuple(x[:3]), _WHITE), ("red", "green", "blue"))])


@query(_xyz_sql(f"SELECT {_KEY_SQL}, 0.9642 * (CASE WHEN fx >= 6 / 29 THEN fx ** 3 ELSE 108 / 841 * (fx - 4 / 29) END) AS x, (CASE WHEN fy >= 6 / 29 THEN fy ** 3 ELSE 108 / 841 * (fy - 4 / 29) END) AS y, 0.8249 * (CASE WHEN fz >= 6 / 29 THEN fz ** 3 ELSE 108 / 841 * (fz - 4 / 29) END) AS z FROM (SELECT *, (l_quantity * 2 + 16) / 116 AS fy, (l_quantity * 2 + 16) / 116 + (l_discount * 1000 - 50) / 500 AS fx, (l_quantity * 2 + 16) / 116 - (l_tax * 1000 - 40) / 200 AS fz FROM lineitem)"))
def lab_srgb(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    found = colour.lab_to_srgb(F.col("l_quantity") * 2, F.col("l_discount") * 1000 - 50, F.col("l_tax") * 1000 - 40, _WHITE)
    return rows.select(*_KEYS, *[r4(c).alias(n) for c, n in zip(found, ("red", "green", "blue"))])


_B, _S = ("b0", "b1", "b2"), ("s0", "s1", "s2")
_PAIR = f"SELECT {_KEY_SQL}, l_quantity / 50 AS b0, l_discount * 10 AS b1, l_tax * 12 AS b2, l_linenumber / 8 AS s0, (l_partkey % 101) / 100 AS s1, (l_suppkey % 11) / 10 AS s2 FROM lineitem"
_HARD = "CASE WHEN {s} <= 0.5 THEN 2 * {b} * {s} ELSE {b} + (2 * {s} - 1) - {b} * (2 * {s} - 1) END"
_SEPARABLE_SQL = {
    "Normal": "{s}", "Multiply": "{b} * {s}", "Screen": "1 - (1 - {b}) * (1 - {s})", "Overlay": _HARD.replace("{s}", "{t}").replace("{b}", "{s}").replace("{t}", "{b}"), "Darken": "least({b}, {s})", "Lighten": "greatest({b}, {s})",
    "ColorDodge": "CASE WHEN {b} = 0 THEN 0 WHEN {s} >= 1 THEN 1 ELSE least(1, {b} / (1 - {s})) END", "ColorBurn": "CASE WHEN {b} >= 1 THEN 1 WHEN {s} <= 0 THEN 0 ELSE 1 - least(1, (1 - {b}) / {s}) END", "HardLight": _HARD,
    "SoftLight": "CASE WHEN {s} <= 0.5 THEN {b} - (1 - 2 * {s}) * {b} * (1 - {b}) ELSE {b} + (2 * {s} - 1) * ((CASE WHEN {b} <= 0.25 THEN ((16 * {b} - 12) * {b} + 4) * {b} ELSE sqrt({b}) END) - {b}) END",
    "Difference": "abs({b} - {s})", "Exclusion": "{b} + {s} - 2 * {b} * {s}",
}


def _lum_sql(p: str) -> str:
    return f"(0.3 * {p}0 + 0.59 * {p}1 + 0.11 * {p}2)"


def _sat_sql(p: str) -> str:
    return f"(greatest({p}0, {p}1, {p}2) - least({p}0, {p}1, {p}2))"


def _non_separable_sql(mode: str) -> str:
    keep, lum = {"Hue": ("s", "b"), "Saturation": ("b", "b"), "Color": ("s", "b"), "Luminosity": ("b", "s")}[mode]
    if mode in ("Hue", "Saturation"):
        other = "b" if mode == "Hue" else "s"
        first = ", ".join(f"CASE WHEN {_sat_sql(keep)} = 0 THEN 0 ELSE ({keep}{i} - least({keep}0, {keep}1, {keep}2)) * {_sat_sql(other)} / {_sat_sql(keep)} END AS e{i}" for i in range(3))
    else:
        first = ", ".join(f"{keep}{i} AS e{i}" for i in range(3))
    shift = ", ".join(f"e{i} + {_lum_sql(lum)} - {_lum_sql('e')} AS f{i}" for i in range(3))
    low = ", ".join(f"CASE WHEN least(f0, f1, f2) < 0 THEN {_lum_sql('f')} + (f{i} - {_lum_sql('f')}) * {_lum_sql('f')} / ({_lum_sql('f')} - least(f0, f1, f2)) ELSE f{i} END AS g{i}" for i in range(3))
    high = ", ".join(f"round(CASE WHEN greatest(f0, f1, f2) > 1 THEN {_lum_sql('f')} + (g{i} - {_lum_sql('f')}) * (1 - {_lum_sql('f')}) / (greatest(f0, f1, f2) - {_lum_sql('f')}) ELSE g{i} END + 1e-7, 4) + 0.0 AS {n}" for i, n in enumerate(("red", "green", "blue")))
    return f"WITH p AS ({_PAIR}), e AS (SELECT *, {first} FROM p), f AS (SELECT *, {shift} FROM e), g AS (SELECT *, {low} FROM f) SELECT {_KEY_SQL}, {high} FROM g"


def _add_blend(mode: str) -> None:
    name = f"blend_{mode.lower()}"

    def run(spark, sf_dir):
        rows, x = _numbers(spark, sf_dir)
        source = (x[3], (F.col("l_partkey") % 101) / 100, (F.col("l_suppkey") % 11) / 10)
        nudge = 0.0 if mode in _SEPARABLE_SQL else 1e-7  # off the halves, where the order of sums decides
        return rows.select(*_KEYS, *[r4(c + nudge).alias(n) for c, n in zip(blends.blend(mode, tuple(x[:3]), source), ("red", "green", "blue"))])

    run.__name__ = name
    if mode in _SEPARABLE_SQL:
        cells = ", ".join(f"round({_SEPARABLE_SQL[mode].format(b=b, s=s)}, 4) + 0.0 AS {n}" for b, s, n in zip(_B, _S, ("red", "green", "blue")))
        sql = f"WITH p AS ({_PAIR}) SELECT {_KEY_SQL}, {cells} FROM p"
    else:
        sql = _non_separable_sql(mode)
    query(sql)(run)


for _mode in (*blends.SEPARABLE, *blends.NON_SEPARABLE):
    _add_blend(_mode)


@query(f"WITH p AS ({_PAIR}) SELECT {_KEY_SQL}, round((0.3 + 0.5 - 0.3 * 0.5)::DOUBLE, 4) AS alpha, round(((1 - 0.5) * 0.3 * b0 + 0.5 * ((1 - 0.3) * s0 + 0.3 * b0 * s0)) / (0.3 + 0.5 - 0.3 * 0.5), 4) + 0.0 AS red FROM p")
def alpha_composite(spark, sf_dir):
    rows, x = _numbers(spark, sf_dir)
    red, _, _, alpha = blends.composite("Multiply", tuple(x[:3]), F.lit(0.3), (x[3], x[3], x[3]), F.lit(0.5))
    return rows.select(*_KEYS, r4(alpha).alias("alpha"), r4(red).alias("red"))


@query(f"SELECT {_KEY_SQL}, round(least(greatest(0.1 + pow(least(greatest(l_quantity / 40, 0), 1), 2.2) * 0.7, 0.15), 0.75), 4) AS y FROM lineitem")
def fn_exponential(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*_KEYS, r4(programs.exponential(F.col("l_quantity") / 40, 2.2, (0.1,), (0.8,), bounds=[(0.15, 0.75)])[0]).alias("y"))


@query(f"WITH p AS (SELECT *, least(greatest(l_quantity / 50, 0), 1) AS x FROM lineitem) SELECT {_KEY_SQL}, round(CASE WHEN x < 0.3 THEN pow(x / 0.3, 2) WHEN x < 0.6 THEN 1 - (x - 0.3) / 0.3 ELSE 0.5 + 0.5 * pow((x - 0.6) / 0.4, 3) END, 4) + 0.0 AS y FROM p")
def fn_stitching(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    parts = [lambda x: programs.exponential(x, 2), lambda x: programs.exponential(x, 1), lambda x: programs.exponential(x, 3, (0.5,), (1.0,))]
    return rows.select(*_KEYS, r4(programs.stitching(F.col("l_quantity") / 50, parts, [0.3, 0.6], [(0, 1), (1, 0), (0, 1)])[0]).alias("y"))


@query(f"WITH p AS (SELECT *, least(greatest(l_quantity / 50, 0), 1) * 4 AS x, [0, 40, 90, 200, 255] AS t FROM lineitem), q AS (SELECT *, floor(x)::INT AS k FROM p) SELECT {_KEY_SQL}, round((t[k + 1] + (x - k) * (t[least(k + 2, 5)] - t[k + 1])) / 255, 4) AS y FROM q")
def fn_sampled(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*_KEYS, r4(programs.sampled(F.col("l_quantity") / 50, [0, 40, 90, 200, 255])).alias("y"))


@query(f"WITH p AS (SELECT *, least(greatest(l_quantity / 50, 0), 1) AS x, least(greatest(l_discount * 10, 0), 1) AS z FROM lineitem) SELECT {_KEY_SQL}, round(least(greatest(CASE WHEN x > z THEN sqrt(x * z) ELSE abs(x - z) + (sin(radians(x * 90)) / 2) END, 0), 1), 4) + 0.0 AS u, round(least(greatest((1 - x) * (1 - z), 0), 1), 4) + 0.0 AS v FROM p")
def fn_calculator(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    text = "{ 2 copy 1 exch sub exch 1 exch sub mul 3 1 roll 2 copy gt { mul sqrt } { 2 copy sub abs 3 1 roll pop 90 mul sin 2 div add } ifelse exch }"
    u, v = programs.calculator(text, [F.col("l_quantity") / 50, F.col("l_discount") * 10], [(0, 1), (0, 1)], [(0, 1), (0, 1)])
    return rows.select(*_KEYS, r4(u).alias("u"), r4(v).alias("v"))


@query(f"SELECT {_KEY_SQL}, round(l_quantity * 2 + l_tax * 100 * 0.5 + 7, 4) + 0.0 AS x, round(l_quantity * -1 + l_tax * 100 * 3 - 2, 4) + 0.0 AS y, round(l_quantity, 4) + 0.0 AS back FROM lineitem")
def matrix_apply(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    m = geometry.matrix(*map(F.lit, (2.0, -1.0, 0.5, 3.0, 7.0, -2.0)))
    x, y = geometry.apply_matrix(m, F.col("l_quantity"), F.col("l_tax") * 100)
    back, _ = geometry.apply_matrix(geometry.invert(m), x, y)
    return rows.select(*_KEYS, r4(x).alias("x"), r4(y).alias("y"), r4(back).alias("back"))


@query(
    f"""
WITH p AS (SELECT *, greatest(least(l_quantity * 20, l_partkey % 700), 0) AS a, greatest(least(l_tax * 9000, l_suppkey % 800), 0) AS b, least(greatest(l_quantity * 20, l_partkey % 700), 612) AS c, least(greatest(l_tax * 9000, l_suppkey % 800), 792) AS d FROM lineitem)
SELECT {_KEY_SQL}, round(CASE WHEN a < c AND b < d THEN a ELSE 0 END, 4) AS l, round(CASE WHEN a < c AND b < d THEN b ELSE 0 END, 4) AS b, round(CASE WHEN a < c AND b < d THEN c ELSE 612 END, 4) AS r, round(CASE WHEN a < c AND b < d THEN d ELSE 792 END, 4) AS t FROM p
"""
)
def box_normalise(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    box = geometry.rectangle(F.col("l_quantity") * 20, F.col("l_tax") * 9000, (F.col("l_partkey") % 700).cast("double"), (F.col("l_suppkey") % 800).cast("double"))
    found = geometry.normalised_box(box, geometry.rectangle(*map(F.lit, (0.0, 0.0, 612.0, 792.0))))
    return rows.select(*_KEYS, *[r4(found[c]).alias(c) for c in "lbrt"])


@query(f"SELECT {_KEY_SQL}, ((round_even(degrees(atan2(l_tax * 100 - 4, l_quantity - 25)), 0)::INT % 360 + 360) % 360)::INT AS turned, CASE ((l_linenumber * 90 - 180) % 360 + 360) % 360 WHEN 90 THEN 'Landscape' WHEN 180 THEN 'UpsideDown' WHEN 270 THEN 'Seascape' ELSE 'Portrait' END AS orientation FROM lineitem")
def rotation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    turned = geometry.rotation(F.col("l_quantity") - 25, F.col("l_tax") * 100 - 4)
    return rows.select(*_KEYS, turned.alias("turned"), geometry.orientation(geometry.page_rotation(F.col("l_linenumber") * 90 - 180)).alias("orientation"))


@query("WITH s AS (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity) AS q, count(*) FILTER (l_returnflag = 'R') > count(*) // 2 AS most FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, q[len(q) // 2 + 1] AS median, most FROM s")
def upper_median(spark, sf_dir):
    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("font_size"))).alias("runs"), (F.count_if(F.col("l_returnflag") == "R") > F.floor(F.count(F.lit(1)) / 2)).alias("most"))
    return groups.select("l_orderkey", layout.median_size(F.col("runs")).alias("median"), "most")


@query("SELECT event_id, regexp_replace(lower(regexp_replace(n, '^[A-Z]{6}[+]', '')), '[-_ ]', '', 'g') AS plain, regexp_matches(n, '^[A-Z]{6}[+].') AS is_subset FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ABCDEF+' ELSE '' END || upper(event_type[1]) || event_type[2:] || '-Bold_' || user_id AS n FROM events)")
def font_names(spark, sf_dir):
    name = F.concat(F.when(F.col("event_id") % 2 == 0, "ABCDEF+").otherwise(""), F.upper(F.substring("event_type", 1, 1)), F.expr("substring(event_type, 2)"), F.lit("-Bold_"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", typefaces.plain_name(name).alias("plain"), typefaces.is_subset(name).alias("is_subset"))


@query("WITH f AS (SELECT event_id, user_id, event_type || '.bin' AS name, row_number() OVER (PARTITION BY user_id, lower(event_type) ORDER BY event_id) AS n FROM events) SELECT event_id, CASE WHEN n = 1 THEN name ELSE replace(name, '.bin', '-' || n || '.bin') END AS file_name FROM f")
def unique_file_names(spark, sf_dir):
    files = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat("event_type", F.lit(".bin")).alias("name"))
    return policy.unique_names(files, ["user_id"], "name", ["event_id"]).select("event_id", "file_name")


@query("WITH d AS (SELECT user_id, event_type AS code, min_by(value, event_id) AS value, min(event_id) AS seq FROM events GROUP BY ALL) SELECT user_id, code, seq, round(value, 4) AS value FROM d")
def diagnostics_once(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("code"), F.col("event_id").alias("seq"), F.round("value", 4).alias("value"))
    return lookup.first_by(rows, ["user_id", "code"], F.col("seq")).select("user_id", "code", "seq", "value")


@query("SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS text FROM events GROUP BY user_id")
def glyph_concat(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["event_type"]), "").alias("text"))


@query("WITH u AS (SELECT user_id, list(event_type ORDER BY event_id) AS types FROM events GROUP BY user_id), o AS (SELECT user_id, unnest(['click', 'view', 'purchase']) AS export, unnest(range(3)) AS i, types FROM u) SELECT user_id, export, CASE WHEN user_id % 3 = 0 THEN i = user_id % 2 ELSE list_contains(types, export) END AS selected FROM o")
def choice_options(spark, sf_dir):
    options = F.array(*[F.struct(F.lit(x).alias("export"), F.lit(x).alias("display")) for x in ("click", "view", "purchase")])
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("types"))
    chosen = F.when(F.col("user_id") % 3 == 0, F.array((F.col("user_id") % 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    found = users.select("user_id", F.explode(forms.choice_options(options, F.col("types"), chosen)).alias("o"))
    return found.select("user_id", "o.export", "o.selected")


@query("WITH e AS (SELECT event_id, 'S' || event_id % 4 AS v, 'S' || event_id % 5 AS cur, event_id % 2 = 0 AS toggle, CASE WHEN event_id % 3 = 0 THEN ['Off', 'S1', 'S2'] ELSE ['S0', 'S3'] END AS states FROM events) SELECT event_id, CASE WHEN toggle AND list_contains(states, v) THEN v WHEN list_contains(states, cur) THEN cur WHEN list_contains(states, v) THEN v WHEN list_contains(states, 'Off') THEN 'Off' ELSE states[1] END AS state FROM e")
def appearance_state(spark, sf_dir):
    e = F.col("event_id")
    states = F.when(e % 3 == 0, F.array(*map(F.lit, ("Off", "S1", "S2")))).otherwise(F.array(*map(F.lit, ("S0", "S3"))))
    state = forms.appearance_state(states, F.concat(F.lit("S"), (e % 4).cast("string")), F.concat(F.lit("S"), (e % 5).cast("string")), e % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", state.alias("state"))


@query("SELECT o_orderkey, coalesce(c.c_nationkey, s.s_nationkey, -1)::INT AS page FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON o.o_custkey = c.c_custkey LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 = 0) s ON o.o_custkey = s.s_suppkey")
def destination_page(spark, sf_dir):
    first = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").withColumnRenamed("c_nationkey", "page")
    second = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").withColumnRenamed("s_nationkey", "page")
    found = forms.first_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), [(first, "c_custkey"), (second, "s_suppkey")], "o_custkey", "page")
    return found.select("o_orderkey", F.coalesce("page", F.lit(-1)).alias("page"))


@query(f"SELECT {_KEY_SQL}, round(CASE WHEN x < 0.1 THEN 0.2 WHEN x < 0.5 THEN 0.2 + (x - 0.1) * 2 WHEN x < 0.9 THEN 1 - (x - 0.5) * 2.5 ELSE 0 END, 4) + 0.0 AS y FROM (SELECT *, l_quantity / 50 AS x FROM lineitem)")
def gradient_stops(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(*_KEYS, r4(forms.gradient(F.col("l_quantity") / 50, [(0.1, 0.2), (0.5, 1.0), (0.9, 0.0)])).alias("y"))


@query("SELECT l_orderkey, min(l_quantity) AS l, min(l_linenumber) AS b, max(l_quantity) AS r, max(l_linenumber) AS t, (3 * count(*))::INT AS points FROM lineitem GROUP BY l_orderkey")
def bounding_box(spark, sf_dir):
    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("xs"), F.collect_list("l_linenumber").alias("ys"))
    box = forms.bounds(F.col("xs"), F.col("ys"))
    return groups.select("l_orderkey", box["l"].alias("l"), box["b"].alias("b"), box["r"].alias("r"), box["t"].alias("t"), forms.point_count([F.col("xs")], F.array("xs", "xs")).alias("points"))
