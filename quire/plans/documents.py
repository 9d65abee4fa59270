"""Queries over PDF files made of the driver's tables: written, parsed, and put through the views."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import synth
from ..functions import flags, labels, texts
from ..operators import hierarchy, layout, lookup, policy
from ..sources import pdf

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


def dealt(rows: DataFrame) -> DataFrame:
    """rows of a table; where one part holds over twice a core's share, as when a file is one row group, they are dealt out. The count of rows by part reads no column."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    return rows.repartition(4 * cores) if max(sizes, default=0) * cores > 2 * sum(sizes) else rows


def made(rows: DataFrame, key: str, make: Callable[[dict], bytes]) -> DataFrame:
    """doc_id and content, a file for each row. Input that comes in fewer parts than there are cores is dealt out first."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(4 * cores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([r[key] for r in part], pa.int64()), pa.array([make(r) for r in part], pa.binary())], ["doc_id", "content"])

    return rows.mapInArrow(run, "doc_id long, content binary")


def page_label(marks: Column, page: Column) -> Column:
    """Label of a page: the last range that begins at or before it names it; without one its number does."""
    own = lookup.last_before(marks, "start_page", page)
    named = lambda m: labels.page_label(m["prefix"], m["style"], page - m["start_page"] + m["first"])
    return layout.let(own, lambda m: F.when(m.isNull(), (page + 1).cast("string")).otherwise(named(m)))


_WORDS = "list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_PAGES = f"""w AS (SELECT doc_id, {_WORDS} AS words FROM documents), p AS (SELECT doc_id, words, unnest(range(greatest((len(words) + 319) // 320, 1))) AS page FROM w),
l AS (SELECT doc_id, page, [array_to_string(words[page * 320 + i * 8 + 1:least(page * 320 + i * 8 + 8, page * 320 + 320)], ' ') FOR i IN range(40) IF page * 320 + i * 8 < len(words)] AS lines FROM p)"""


@query(f"WITH {_PAGES} SELECT doc_id, page::INT AS page, CASE WHEN page < 2 THEN (['i', 'ii'])[(page + 1)::INT] ELSE 'A-' || (page - 1) END AS label, coalesce(array_to_string(lines, chr(10)), '') AS text FROM l")
def pdf_page_text(spark, sf_dir):
    """Text of every page in physical order, with its label."""
    files = made(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", lambda r: synth.text_pdf(r["text"] or "", labels=b"0 << /S /r >> 2 << /S /D /P (A-) >>"))
    parsed = pdf.parse(files, ["labels", "page_runs"], ["doc_id"])
    pages = parsed.select("doc_id", "labels", F.explode("page_runs").alias("p")).select("doc_id", "p.page", page_label(F.col("labels"), F.col("p.page")).alias("label"), F.col("p.runs").alias("runs"))
    return pages.select("doc_id", "page", "label", layout.nested_text(F.col("runs")).alias("text"))


@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents) SELECT doc_id, greatest((len(words) + 319) // 320, 1)::INT AS pages, '1.7' AS version, false AS xref_repaired FROM w")
def pdf_page_count(spark, sf_dir):
    files = made(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", lambda r: synth.text_pdf(r["text"] or ""))
    return pdf.table(pdf.parse(files, ["document"], ["doc_id"]), "document", ["doc_id"]).select("doc_id", "pages", "version", "xref_repaired")


@query("SELECT page_id AS doc_id, (['Flate', 'Hex', 'A85', 'RunLength'])[(page_id % 4 + 1)::INT] AS filter, md5(coalesce(html, '')) AS payload_md5, 'text/plain' AS mime, strlen(coalesce(html, ''))::BIGINT AS declared_size FROM pages")
def pdf_filters_md5(spark, sf_dir):
    names = ["Flate", "Hex", "A85", "RunLength"]
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    files = made(pages, "page_id", lambda r: synth.text_pdf("", attachments=[(names[r["page_id"] % 4] + ".txt", (r["html"] or "").encode(), names[r["page_id"] % 4])]))
    found = pdf.table(pdf.parse(files, ["attachments"], ["doc_id"]), "attachments", ["doc_id"])
    return found.select("doc_id", F.replace("name", F.lit(".txt"), F.lit("")).alias("filter"), F.md5("data").alias("payload_md5"), F.replace("mime", F.lit("#"), F.lit("/")).alias("mime"), "declared_size")


@query("SELECT page_id AS doc_id, md5(rpad(html, ((strlen(html) + 15) // 16 * 16)::INT, ' ')) AS payload_md5 FROM (SELECT page_id, regexp_replace(coalesce(html, ''), '[^ -~]', '', 'g') AS html FROM pages) WHERE html <> ''")
def pdf_predictor_md5(spark, sf_dir):
    """ASCII-hex over deflate with PNG rows; the writer pads to whole rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.coalesce("html", F.lit("")), "[^ -~]", "").alias("html")).where("html <> ''")
    files = made(pages, "page_id", lambda r: synth.text_pdf("", attachments=[("x", r["html"].encode(), "FlatePng")]))
    return pdf.table(pdf.parse(files, ["attachments"], ["doc_id"]), "attachments", ["doc_id"]).select("doc_id", F.md5("data").alias("payload_md5"))


@query("SELECT page_id AS doc_id, 'Title' AS key, url AS value FROM pages UNION ALL SELECT page_id, 'Author', 'page ' || page_id FROM pages")
def pdf_info(spark, sf_dir):
    files = made(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", lambda r: synth.text_pdf("", info={"Title": r["url"], "Author": f"page {r['page_id']}"}))
    return pdf.table(pdf.parse(files, ["info"], ["doc_id"]), "info", ["doc_id"])


@query("""
WITH t AS (SELECT conv_id, turn, role, text AS title, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
r AS (SELECT *, max(CASE WHEN role = 'user' THEN i END) OVER (PARTITION BY conv_id ORDER BY i) AS root FROM t)
SELECT conv_id AS doc_id, title, (CASE WHEN root IS NULL OR root = i THEN 0 ELSE 1 END)::INT AS depth, i::BIGINT AS preorder, 0::INT AS page FROM r
""")
def pdf_outline(spark, sf_dir):
    """Items of a conversation: users' turns at the top, what follows each one below it."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def make(r: dict) -> bytes:
        items, root = [], None
        for i, t in enumerate(r["turns"]):
            parent = None if t["role"] == "user" else root
            items.append((t["text"], parent, 0))
            root = i if t["role"] == "user" else root
        return synth.text_pdf("", outline=items)

    parsed = pdf.parse(made(turns, "conv_id", make), ["outline"], ["doc_id"])
    rows = pdf.table(parsed, "outline", ["doc_id"])
    order = hierarchy.flatten_tree(rows.select("doc_id", "node", "parent", "nth"), ["doc_id"], 3)
    return order.join(rows.select("doc_id", "node", "title", "page"), ["doc_id", "node"]).select("doc_id", "title", "depth", F.col("preorder").cast("long").alias("preorder"), "page")


@query("SELECT c_nationkey::BIGINT AS doc_id, 'form.c' || c_custkey AS name, c_name AS value, 'Tx' AS type, '/F0 9 Tf' AS appearance FROM customer")
def pdf_form_values(spark, sf_dir):
    """Fields of a form for each nation, with the type and appearance that they inherit."""
    own = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))).alias("customers"))
    files = made(own, "nation", lambda r: synth.text_pdf("", fields=[(f"c{c['c_custkey']}", c["c_name"]) for c in r["customers"]]))
    rows = pdf.table(pdf.parse(files, ["fields"], ["doc_id"]), "fields", ["doc_id"]).withColumnRenamed("field", "node")
    full = hierarchy.inherit(rows.select("doc_id", "node", "parent", "type", "appearance"), ["doc_id"], ["type", "appearance"], 3)
    leaves = rows.where("is_terminal").select("doc_id", "node", "name", F.col("values")[0].alias("value"))
    return leaves.join(full, ["doc_id", "node"]).select("doc_id", "name", "value", "type", "appearance")


@query("SELECT item_id AS doc_id, md5(text) AS payload_md5, (2 + item_id % 2)::INT AS revision, false AS is_locked, item_id % 3 = 0 AS is_owner FROM benchmark")
def pdf_encrypted_md5(spark, sf_dir):
    files = made(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", lambda r: synth.text_pdf("", attachments=[("x", r["text"].encode(), "Flate")], revision=2 + r["item_id"] % 2, user=b"secret"))
    files = files.withColumn("owner_password", F.when(F.col("doc_id") % 3 == 0, "owner")).withColumn("user_password", F.when(F.col("doc_id") % 3 != 0, "secret"))
    parsed = pdf.parse(files, ["attachments", "encryption"], ["doc_id"])
    return parsed.select("doc_id", F.md5(F.col("attachments")[0]["data"]).alias("payload_md5"), F.col("encryption")[0]["revision"].alias("revision"), F.col("encryption")[0]["is_locked"].alias("is_locked"), F.col("encryption")[0]["is_owner"].alias("is_owner"))


@query("SELECT item_id AS doc_id, 0 AS pages, true AS locked FROM benchmark")
def pdf_locked(spark, sf_dir):
    """Files whose password is not given are rows without pages, not errors."""
    files = made(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", lambda r: synth.text_pdf(r["text"], revision=3, user=b"secret"))
    return pdf.table(pdf.parse(files, ["document"], ["doc_id"]), "document", ["doc_id"]).select("doc_id", "pages", "locked")


@query("SELECT item_id AS doc_id, (CASE WHEN item_id % 2 = 0 THEN 'red' || item_id || ' ' ELSE '' END) || 'blue' || item_id AS text, item_id % 2 = 0 AS red_visible FROM benchmark")
def pdf_layers_text(spark, sf_dir):
    """Text of hidden layers is not read; the layers' states come from the view."""
    files = made(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", lambda r: synth.text_pdf("", layers=[("Red", r["item_id"] % 2 == 0, f"red{r['item_id']} "), ("Blue", True, f"blue{r['item_id']}")]))
    parsed = pdf.parse(files, ["runs", "layers"], ["doc_id"])
    text = layout.page_text(pdf.table(parsed, "runs", ["doc_id"]), ["doc_id", "page"], "raw").select("doc_id", "text")
    red = policy.layer_states(pdf.table(parsed, "layers", ["doc_id"])).where("name = 'Red'").select("doc_id", F.col("visible").alias("red_visible"))
    return text.join(red, "doc_id")


@query(f"WITH w AS (SELECT conv_id, turn, {_WORDS} AS words FROM conversations), d AS (SELECT conv_id * 100 + turn AS doc_id, len(words) AS n, turn FROM w), p AS (SELECT *, unnest(range(greatest((n + 319) // 320, 1))) AS page FROM d) SELECT doc_id, page::INT AS page, least((n - 320 * page + 7) // 8, 40)::BIGINT AS n_text, CASE WHEN page = 0 THEN turn % 4 ELSE 0 END::BIGINT AS n_paths, 0::BIGINT AS n_images FROM p WHERE n > 0 OR turn % 4 > 0")
def pdf_element_counts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "turn", "text")
    files = made(turns, "id", lambda r: synth.text_pdf(r["text"], links=["u"] * (r["turn"] % 4)))
    rows = pdf.table(pdf.parse(files, ["elements"], ["doc_id"]), "elements", ["doc_id"]).where("parent is null")
    return policy.count_kinds(rows, ["doc_id", "page"], "kind", {"n_text": ["text"], "n_paths": ["path"], "n_images": ["image"]})


@query("SELECT page_id AS doc_id, i::INT AS idx, 'Link' AS subtype, url || '#' || i AS uri, i % 2 = 1 AS visible FROM pages, unnest(range(page_id % 3 + 1)) AS r(i)")
def pdf_annotations(spark, sf_dir):
    files = made(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id", lambda r: synth.text_pdf("", links=[f"{r['url']}#{i}" for i in range(r["page_id"] % 3 + 1)]))
    rows = pdf.table(pdf.parse(files, ["annotations"], ["doc_id"]), "annotations", ["doc_id"])
    shown = flags.annotation_visible(F.col("flags"), F.col("subtype") == "Popup", F.col("is_open"), F.col("layer_visible"))
    return rows.select("doc_id", "idx", "subtype", "uri", shown.alias("visible"))


@query("SELECT item_id AS doc_id, true AS xref_repaired, ['header.prefix', 'xref.repair'] AS codes, md5(text) AS payload_md5 FROM benchmark".replace("['header.prefix', 'xref.repair'] AS codes", "'header.prefix,xref.repair' AS codes"))
def pdf_repair(spark, sf_dir):
    """Files with bytes before the header and a wrong cross-reference offset are read by scanning, and say so."""
    files = made(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", lambda r: synth.text_pdf("", attachments=[("x", r["text"].encode(), "A85")], broken=True, lead=b"junk\n"))
    parsed = pdf.parse(files, ["document", "attachments", "diagnostics"], ["doc_id"])
    return parsed.select("doc_id", F.col("document")[0]["xref_repaired"].alias("xref_repaired"), F.array_join(F.transform("diagnostics", lambda d: d["code"]), ",").alias("codes"), F.md5(F.col("attachments")[0]["data"]).alias("payload_md5"))


@query("SELECT item_id AS doc_id, 'format' AS kind FROM benchmark WHERE item_id % 2 = 1")
def pdf_errors(spark, sf_dir):
    """Files that are none give a row with an error."""
    files = made(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", lambda r: r["text"].encode() if r["item_id"] % 2 else synth.text_pdf(r["text"]))
    return pdf.parse(files, ["document"], ["doc_id"]).where("error is not null").select("doc_id", F.col("error.kind").alias("kind"))


@query(f"WITH {_PAGES}, r AS (SELECT doc_id, page, unnest(lines) AS line FROM l) SELECT doc_id, page::INT AS page, count(*) AS hits FROM r WHERE contains(line, 'the ') GROUP BY ALL")
def pdf_search(spark, sf_dir):
    files = made(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", lambda r: synth.text_pdf(r["text"] or ""))
    runs = pdf.table(pdf.parse(files, ["runs"], ["doc_id"]), "runs", ["doc_id"])
    return layout.search(runs, "the ").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("hits"))


@query(f"SELECT item_id AS doc_id, 1::BIGINT AS catalogs, greatest((len({_WORDS}) + 319) // 320, 1)::BIGINT AS pages, 0::BIGINT AS missing FROM benchmark")
def pdf_objects(spark, sf_dir):
    """Objects by type, and references to objects that are not there, by a join of references with objects."""
    files = made(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", lambda r: synth.text_pdf(r["text"]))
    rows = pdf.table(pdf.parse(files, ["objects"], ["doc_id"]), "objects", ["doc_id"])
    refs = rows.select("doc_id", F.explode("refs").alias("obj"))
    missing = lookup.unknown(refs, rows, ["doc_id", "obj"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("missing"))
    found = policy.count_kinds(rows, ["doc_id"], "type", {"catalogs": ["Catalog"], "pages": ["Page"]})
    return found.join(missing, "doc_id", "left").withColumn("missing", F.coalesce("missing", F.lit(0)).cast("long"))


_INK = b"/Subtype /Ink /Rect [0 0 9 9] /NM (n%d) /Subj (s%d) /RT /Group /CA 0.5 /C [0.25 %d 1] /Border [1 2 %d [3 %d]] /InkList [[1 2 3 4] [] [5 %d 7]] /QuadPoints [0 0 1 (x) 0 1 1 1 9] /LE [/None /OpenArrow]"


@query("SELECT page_id AS doc_id, 'n' || page_id AS name, 's' || page_id % 7 AS subject, 'Group' AS reply_type, 0.5::DOUBLE AS opacity, 1.25 + (page_id % 2)::DOUBLE AS color, (page_id % 5)::DOUBLE AS width, 'Dashed' AS style, 3 + (page_id % 3)::DOUBLE AS dash, 2::INT AS paths, page_id::DOUBLE AS last_y, 3::INT AS quad_points, 'None,OpenArrow' AS line_ends FROM pages")
def pdf_markup(spark, sf_dir):
    """Ink annotations with colours, borders, paths and points."""
    files = made(table(spark, sf_dir, "pages").select("page_id"), "page_id", lambda r: synth.text_pdf("", notes=[_INK % (r["page_id"], r["page_id"] % 7, r["page_id"] % 2, r["page_id"] % 5, r["page_id"] % 3, r["page_id"])]))
    rows = pdf.table(pdf.parse(files, ["markup"], ["doc_id"]), "markup", ["doc_id"]).withColumn("paths", texts.ink_paths(F.col("ink")))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    return rows.select("doc_id", "name", "subject", "reply_type", "opacity", total("color").alias("color"), F.col("border.width").alias("width"), F.col("border.style").alias("style"), total("border.dash").alias("dash"), F.size("paths").alias("paths"), F.col("paths")[1][0]["y"].alias("last_y"), F.size(texts.point_pairs(F.col("quads"))).alias("quad_points"), F.array_join("line_ends", ",").alias("line_ends"))


@query("SELECT item_id AS doc_id, g::INT AS radio_group, nth::INT AS nth, name FROM benchmark, (VALUES (0, 0, 'Red'), (0, 1, 'Blue'), (1, 0, 'Blue')) AS r(g, nth, name)")
def pdf_radio_groups(spark, sf_dir):
    """Layers of radio groups by name; a layer that a group lists twice counts once, and groups without layers are none."""
    files = made(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", lambda r: synth.text_pdf("", layers=[("Red", True, "a"), ("Blue", False, "b")], radio=[[0, 1, 0], [], [1]]))
    parsed = pdf.parse(files, ["layers", "radio_groups"], ["doc_id"])
    groups = pdf.table(parsed, "radio_groups", ["doc_id"]).withColumnRenamed("group", "radio_group")
    return groups.join(pdf.table(parsed, "layers", ["doc_id"]).select("doc_id", "id", "name"), ["doc_id", "id"]).select("doc_id", "radio_group", "nth", "name")
