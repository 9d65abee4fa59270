"""pdf_page_text in one pass: documents by row, short ways beside the long ones."""

import random

import duckdb
from pyspark.sql import functions as F

from quire import synth
from quire.operators import layout
from quire.plans import documents
from quire.sources import content, pdf


def test_rows_of_one_id_stay_apart_and_nothing_is_shuffled(spark, tmp_path):
    rows = [(1, " ".join(f"w{i}" for i in range(900))), (1, "other words, Ünïcödé"), (None, "no id"), (2, None), (3, "中文 字")] + [(i, "x y") for i in range(10, 40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    got = documents.pdf_page_text(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("hashpartitioning", "MergeJoin", "HashJoin", "InMemoryTableScan"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, page, label, text FROM ({documents.ORACLES['pdf_page_text']})").fetchall()
    assert sorted(map(repr, map(tuple, got.select("doc_id", "page", "label", "text").collect()))) == sorted(map(repr, want))


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path):
    spark.range(4000).selectExpr("id AS doc_id", "repeat(sha2(cast(id AS string), 512), 150) AS text").coalesce(1).write.option("compression", "none").option("parquet.block.size", 1 << 30).parquet(str(tmp_path / "documents.parquet"))
    rows = documents.table(spark, str(tmp_path), "documents")
    cores = spark.sparkContext.defaultParallelism
    assert rows.rdd.getNumPartitions() >= cores
    sizes = [r["count"] for r in documents.dealt(rows).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= cores and sum(sizes) == 4000 and max(sizes) < 1000
    even = spark.range(4000).repartition(cores)
    assert documents.dealt(even) is even


def test_files_share_batches(spark):
    files = spark.createDataFrame([(i, synth.text_pdf(f"file {i}")) for i in range(150)], "id int, content binary").coalesce(1)
    parsed = pdf.parse(files, ["page_runs"], ["id"])
    sizes = parsed.mapInArrow(lambda batches: batches, parsed.schema)
    assert sizes.count() == 150 and {r.id: r.page_runs[0].runs[0].text for r in parsed.collect()} == {i: f"file {i}" for i in range(150)}
    assert pdf.BATCH_FILES > 1


def test_short_ways_read_what_the_long_one_reads():
    parts = [b"BT /F0 10 Tf 1 0 0 1 36 742 Tm <00410042> Tj ET", b"q 1 0 0 -1.5 .5 5. cm", b"BT /F#30 1 Tf <4 1> Tj T* (a) ' [(b) -20 <43>] TJ ET", b"true null /X gs", b"BI /W 1 /H 1 /CS /G /BPC 8 ID \x00 EI", b"+1 -2 m 3 4 l S", b"1e5 --3 12345678901234567890 Td", b"BT /F0 10 Tf 1 0 0 1 36 742 Tm <0> Tj ET", b"0.5 g f* /OC /L0 BDC EMC"]
    plain = b"\n".join(parts)
    commented = b"\n".join(b"%\n".join(p.split(b" ")) if not p.startswith(b"BI") else b"%\n" + p for p in parts)  # a comment before each word: no short way
    seen = lambda data, whole=False: [(op, v if op != "BI" else len(v[0].data)) for op, v in content.operations(data, 1000, whole)]
    parts_of = {"text": lambda v: [("BT", []), ("Tf", [v[0], v[1]]), ("Tm", v[2]), ("Tj", [v[3]]), ("ET", [])]}
    opened = [x for op, v in seen(plain, True) for x in parts_of.get(op, lambda v: [(op, v)])(v)]  # noqa: B023
    assert seen(plain) == opened and len(seen(plain)) > 25
    assert seen(plain) == seen(commented)


def _lines(runs):
    lines = []
    for r in sorted(runs, key=lambda r: -r[1]):
        near = [x for x in lines if abs(x[0][1] - r[1]) <= max(1.5, 0.35 * max(x[0][2], r[2]))]
        near[0].append(r) if near else lines.append([r])
    return [[r[0] for r in x] for x in lines]


def test_lines_equal_a_plain_fold(spark):
    draw = random.Random(5)
    pages = [[(i, draw.choice([draw.uniform(0, 60), float(draw.randrange(60))]), draw.choice([1.0, 8.0, 10.0, 30.0])) for i in range(draw.randrange(1, 30))] for _ in range(60)]
    rows = [(k, [(i, str(i), float(i), b, float(i + 1), b + 5, size, False, False, False) for i, b, size in page]) for k, page in enumerate(pages)]
    run = "seq int, text string, left double, bottom double, right double, top double, font_size double, space_after boolean, rtl boolean, vertical boolean"
    nested = spark.createDataFrame(rows, f"page int, runs array<struct<{run}>>")
    got = nested.select("page", F.transform(layout.lines_of(F.col("runs")), lambda x: F.transform(x, lambda r: r["seq"])).alias("lines"), F.transform(layout.physical_order(F.col("runs")), lambda r: r["seq"]).alias("flat"), layout.nested_text(F.col("runs")).alias("text"))
    whole = {r.page: r.text for r in layout.page_text(nested.select("page", F.explode("runs").alias("r")).select("page", "r.*"), ["page"]).collect()}
    for r in got.collect():
        assert r.lines == _lines(pages[r.page]) and r.flat == [i for line in r.lines for i in sorted(line)] and r.text == whole[r.page]
