"""Queries that apply lookups of pages, layers and annotations, fonts and texts for display to the star-schema tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import flags, geometry, texts, typefaces
from ..operators import lookup, policy
from .relational import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


_PAGES = "pages AS (SELECT o_custkey AS doc, o_orderpriority AS label, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS page FROM orders)"


def _pages(spark, sf_dir) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("label"), nth.cast("int").alias("page"))


@query(f"WITH {_PAGES} SELECT c_custkey AS doc, (['1-URGENT', '5-LOW', '3-MEDIUM'])[(c_custkey % 3 + 1)::INT] AS label, coalesce(min(page), -1)::INT AS page FROM customer LEFT JOIN pages ON doc = c_custkey AND label = (['1-URGENT', '5-LOW', '3-MEDIUM'])[(c_custkey % 3 + 1)::INT] GROUP BY c_custkey")
def page_by_label(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.get(F.array(*map(F.lit, ("1-URGENT", "5-LOW", "3-MEDIUM"))), (F.col("c_custkey") % 3).cast("int")).alias("label"))
    return lookup.page_of_label(wanted, _pages(spark, sf_dir), ["doc"], "label", "page").withColumn("page", F.coalesce("page", F.lit(-1)))


@query(f"WITH {_PAGES} SELECT doc, label, page FROM pages QUALIFY page = (doc % count(*) OVER (PARTITION BY doc))::INT")
def page_filter(spark, sf_dir):
    """A page of every document by a number that it has."""
    pages = _pages(spark, sf_dir).withColumn("pages", F.count(F.lit(1)).over(Window.partitionBy("doc")))
    return lookup.page_rows(pages, F.col("pages"), (F.col("doc") % F.col("pages") + 1).cast("int"), "page").select("doc", "label", "page")


@query("SELECT o_custkey AS doc, o_orderkey AS layer FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unknown_overrides(spark, sf_dir):
    """Overrides (orders) of layers that no group (line) has."""
    overrides = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("layer"))
    return lookup.unknown(overrides, table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "layer"), ["layer"])


@query("SELECT o_custkey AS doc, o_orderkey AS layer FROM orders")
def known_overrides(spark, sf_dir):
    """Overrides whose layers are all known pass the check."""
    overrides = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("layer"))
    return lookup.all_known(overrides, overrides, ["layer"])


@query("SELECT DISTINCT o_orderkey AS field FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 3")
def fields_on_page(spark, sf_dir):
    """Fields (orders) with any widget (line) on page 3."""
    fields, widgets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("field")), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "field")
    return lookup.having(fields, widgets, ["field"], F.col("l_linenumber") == 3)


@query("SELECT a.conv_id, a.turn, p.turn::INT AS parent_turn, length(q.text)::INT AS popup_chars FROM conversations a LEFT JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn // 2 AND a.turn > 0 LEFT JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = a.turn + 2")
def annotation_links(spark, sf_dir):
    """Each annotation with its parent and its popup, found by their ids."""
    name = lambda n: F.concat(F.lit("0:"), n.cast("string"))
    turn = F.col("turn")
    notes = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("chars"), name(turn).alias("id"), F.when(turn > 0, name(F.floor(turn / 2))).alias("parent"), name(turn + 2).alias("popup"))
    return lookup.linked(notes, ["conv_id"], "id", {"parent": ["turn"], "popup": ["chars"]}).select("conv_id", "turn", "parent_turn", "popup_chars")


@query("WITH a AS (SELECT o_custkey AS doc, 0 AS part, o_orderkey AS seq, 'content' AS kind FROM orders UNION ALL SELECT c_custkey, 1, c_nationkey, 'annotation' FROM customer) SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY part, seq) - 1)::INT AS seq, kind FROM a")
def elements_in_order(spark, sf_dir):
    content = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("seq"), F.lit("content").alias("kind"))
    notes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_nationkey").cast("long").alias("seq"), F.lit("annotation").alias("kind"))
    return lookup.in_order([content, notes], ["doc"], "seq")


@query("SELECT event_id, event_id % 64 & 35 = 0 AND event_id % 3 <> 0 AND user_id % 4 <> 0 AND event_id % 7 <> 3 AS painted FROM events")
def paint_visibility(spark, sf_dir):
    e = F.col("event_id")
    box = geometry.rectangle(F.lit(0.0), F.lit(5.0), F.when(e % 3 == 0, 0.0).otherwise(9.0), F.when(F.col("user_id") % 4 == 0, 2.0).otherwise(8.0))
    return table(spark, sf_dir, "events").select("event_id", flags.annotation_painted((e % 64).cast("int"), box, F.when(e % 7 == 3, False)).alias("painted"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1 WHEN 2 THEN CASE WHEN user_id % 2 = 0 THEN 3 ELSE 2 END WHEN 3 THEN CASE WHEN user_id % 3 = 0 THEN 4 ELSE 2 END WHEN 4 THEN CASE WHEN user_id % 5 = 0 THEN 5 ELSE 2 END ELSE 2 END::DOUBLE AS l FROM events")
def page_boxes(spark, sf_dir):
    """The left edges of the boxes asked for; those that are not there are the crop box."""
    e, user = F.col("event_id"), F.col("user_id")
    box = lambda n: geometry.rectangle(*[F.lit(float(n))] * 2, *[F.lit(100.0)] * 2)
    which = F.get(F.array(*map(F.lit, ("MediaBox", "CropBox", "BleedBox", "TrimBox", "ArtBox", "Other"))), (e % 6).cast("int"))
    found = geometry.page_box(which, box(1), box(2), F.when(user % 2 == 0, box(3)), F.when(user % 3 == 0, box(4)), F.when(user % 5 == 0, box(5)))
    return table(spark, sf_dir, "events").select("event_id", found["l"].alias("l"))


@query("SELECT event_id, CASE d WHEN 'Type0' THEN CASE e WHEN 'CIDFontType0' THEN 'CidType0' WHEN 'CIDFontType2' THEN 'CidType2' ELSE 'Unknown' END WHEN 'Type3' THEN 'Type3' ELSE CASE WHEN f = 'OpenType' THEN 'OpenType' WHEN f = 'CFF' THEN 'Type1C' WHEN d IN ('Type1', 'MMType1') THEN 'Type1' WHEN d = 'TrueType' THEN 'TrueType' ELSE 'Unknown' END END AS type FROM (SELECT event_id, (['Type0', 'Type1', 'MMType1', 'TrueType', 'Type3', 'Odd'])[event_id % 6 + 1] AS d, (['CIDFontType0', 'CIDFontType2', 'TrueType'])[user_id % 3 + 1] AS e, (['OpenType', 'CFF', 'TrueType', NULL])[user_id % 4 + 1] AS f FROM events)")
def font_types(spark, sf_dir):
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (n % len(names)).cast("int"))
    declared, effective = pick(("Type0", "Type1", "MMType1", "TrueType", "Type3", "Odd"), F.col("event_id")), pick(("CIDFontType0", "CIDFontType2", "TrueType"), F.col("user_id"))
    return table(spark, sf_dir, "events").select("event_id", typefaces.font_type(declared, effective, pick(("OpenType", "CFF", "TrueType", None), F.col("user_id"))).alias("type"))


_WANTED = ["timesbold", "helvetica", "couriernewoblique", "arialnarrow", "georgiaserifitalic", "widesans"]
_FILES = ["DejaVu-Sans", "LiberationSerif-Bold", "Nimbus_Mono-Oblique", "ArialNarrow", "Times-Roman", "Georgia", "Helvetica-BoldOblique", "Courier", "OpenSans-Condensed", "Wide_Latin"]


def _score_sql() -> str:
    some = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
    family = f"CASE WHEN {some('wanted', ['mono', 'courier'])} THEN {some('have', ['mono', 'courier'])} WHEN {some('wanted', ['times', 'serif', 'roman'])} THEN {some('have', ['times', 'serif', 'roman'])} ELSE {some('have', ['sans', 'arial', 'helvetica'])} END"
    same = [(["bold"], 20, -10), (["italic", "oblique"], 20, -10), (["narrow", "condensed", "compressed"], 35, -25), (["expanded", "extended", "wide"], 35, -25)]
    terms = [f"CASE WHEN {family} THEN 100 ELSE 0 END", *[f"CASE WHEN {some('have', w)} = {some('wanted', w)} THEN {yes} ELSE {no} END" for w, yes, no in same], "CASE WHEN contains(have, wanted) OR contains(wanted, have) THEN 50 ELSE 0 END"]
    terms += [f"CASE WHEN {some('have', ['dejavu', 'liberation', 'nimbus'])} THEN 5 ELSE 0 END", "CASE WHEN configured THEN 1000 ELSE 0 END"]
    listed = lambda x: "[" + ", ".join(f"'{w}'" for w in x) + "]"
    source = f"SELECT p_partkey, name, lower(replace(replace(name, '-', ''), '_', '')) AS have, ({listed(_WANTED)})[p_size % {len(_WANTED)} + 1] AS wanted, p_brand LIKE '%21' AS configured FROM (SELECT *, ({listed(_FILES)})[p_partkey % {len(_FILES)} + 1] AS name FROM part)"
    return f"SELECT p_partkey, name, wanted, ({' + '.join(terms)})::INT AS score FROM ({source})"


def _fonts(spark, sf_dir) -> DataFrame:
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (n % len(names)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", pick(_FILES, F.col("p_partkey")).alias("name"), pick(_WANTED, F.col("p_size")).alias("wanted"), F.col("p_brand").like("%21").alias("configured"))


_SCORE = typefaces.font_score


@query(_score_sql())
def font_scores(spark, sf_dir):
    return _fonts(spark, sf_dir).select("p_partkey", "name", "wanted", _SCORE(F.col("name"), F.col("wanted"), F.col("configured")).alias("score"))


@query(f"SELECT p_partkey, name, score FROM ({_score_sql()}) ORDER BY score DESC, name, p_partkey LIMIT 64")
def font_top_k(spark, sf_dir):
    """The 64 fonts that stand in best."""
    return policy.top_k(_fonts(spark, sf_dir), _SCORE(F.col("name"), F.col("wanted"), F.col("configured")), 64, "name", "p_partkey").select("p_partkey", "name", "score")


@query("SELECT conv_id, turn, replace(replace(text, chr(13), ' '), chr(10), ' ') AS line, CASE WHEN length(text) <= 60 THEN text ELSE text[:59] || '…' END AS head FROM conversations")
def display_texts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.single_line(F.col("text")).alias("line"), texts.truncate(F.col("text"), 60).alias("head"))


@query(
    r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, 0 AS line, '' AS part, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS rest FROM conversations
UNION ALL SELECT conv_id, turn, line + 1, rest[:cut], regexp_replace(rest[cut + 1:], '^\s+', '') FROM (SELECT *, CASE WHEN length(rest) <= 28 THEN 28 WHEN strpos(reverse(rest[:29]), ' ') IN (0, 29) THEN 28 ELSE 29 - strpos(reverse(rest[:29]), ' ') END AS cut FROM t WHERE rest <> ''))
SELECT conv_id, turn, line::INT - 1 AS line, part FROM t WHERE line > 0
"""
)
def annotation_wrap(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(texts.wrap(F.col("text"), 28)).alias("line", "part"))
    return lines.select("conv_id", "turn", "line", "part")


@query("WITH n AS (SELECT event_id, ([event_id::DOUBLE, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 2.5 END, user_id::DOUBLE, CASE WHEN event_id % 5 = 0 THEN 'inf'::DOUBLE ELSE 1.5 END, 7.0])[1:event_id % 6] AS x, event_id % 6 AS size FROM events) SELECT event_id, len(list_filter(x, lambda v: v IS NOT NULL AND NOT isinf(v)))::INT AS kept, size > 0 AND len(list_filter(x, lambda v: v IS NULL OR isinf(v))) = 0 AS whole, (CASE WHEN size >= 2 AND event_id % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN size >= 4 AND event_id % 5 <> 0 THEN 1 ELSE 0 END)::INT AS points FROM n")
def number_arrays(spark, sf_dir):
    """Entries kept, whether all are good, and points of arrays with nulls and infinities."""
    e = F.col("event_id")
    x = F.slice(F.array(e.cast("double"), F.when(e % 3 != 0, 2.5), F.col("user_id").cast("double"), F.when(e % 5 == 0, float("inf")).otherwise(1.5), F.lit(7.0)), F.lit(1), (e % 6).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.size(texts.kept_numbers(x)).alias("kept"), texts.all_numbers(x).isNotNull().alias("whole"), F.size(texts.point_pairs(x)).alias("points"))


@query("SELECT event_id, ((user_id % 4 // 2 > 0)::INT + (event_id % 3 > 1)::INT)::INT AS paths, (user_id % 4 // 2 + event_id % 3 // 2)::INT AS points FROM events")
def ink_paths(spark, sf_dir):
    """Paths and points of arrays of arrays, without paths that have no point."""
    path = lambda n: F.array_repeat(F.lit(1.0), n.cast("int"))
    found = texts.ink_paths(F.array(path(F.col("user_id") % 4), path(F.lit(0)), path(F.col("event_id") % 3)))
    return table(spark, sf_dir, "events").select("event_id", F.size(found).alias("paths"), F.size(F.flatten(found)).alias("points"))
