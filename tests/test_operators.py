import pytest
from pyspark.sql import functions as F

from quire.functions import blend, colour, dates, geometry, labels, programs
from quire.operators import layout, lookup, policy


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def run(seq, text, left, bottom, width=40.0, size=10.0, space=False, rtl=False, vertical=False):
    return (0, seq, text, float(left), float(bottom), float(left) + width, float(bottom) + size, size, space, rtl, vertical)


def pages(spark, rows):
    return spark.createDataFrame(rows, "doc long, seq int, text string, left double, bottom double, right double, top double, font_size double, space_after boolean, rtl boolean, vertical boolean")


def text(spark, rows, how, **more):
    return layout.page_text(pages(spark, rows), ["doc"], how, **more).first().text


def test_layouts(spark):
    rows = [run(0, "Oats and rye", 50, 700), run(1, "Plums, pears", 300, 700), run(2, "Barley too", 50, 680), run(3, "Figs at last", 300, 680)]
    assert text(spark, rows, "raw") == "Oats and ryePlums, pearsBarley tooFigs at last"
    assert text(spark, rows, "physical") == "Oats and rye Plums, pears\nBarley too Figs at last"
    assert text(spark, rows, "reading") == "Oats and rye\nBarley too\nPlums, pears\nFigs at last"
    assert text(spark, rows, "physical", area=(0.0, 691.0, 100.0, 720.0)) == "Oats and rye"
    hebrew = [run(0, "ש", 50, 700, rtl=True), run(1, "ל", 90, 700, rtl=True)]
    assert text(spark, hebrew, "raw") == "של" and text(spark, hebrew, "physical") == "לש"
    mixed = [run(0, "down", 500, 600, 10.0, 90.0, vertical=True), run(1, "flat ", 10, 700)]
    assert text(spark, mixed, "physical") == "flat\ndown"


def test_lines_follow_their_first_run(spark):
    rows = [run(i, c, 50 * i, b) for i, (c, b) in enumerate(zip("abc", (700.0, 697.0, 694.0)))]
    runs = pages(spark, rows).groupBy("doc").agg(F.collect_list(F.struct(*layout.RUN)).alias("runs"))
    lines = runs.select(layout.lines_of(layout.by_seq(F.col("runs"))).alias("lines")).first().lines
    assert ["".join(r.text for r in line) for line in lines] == ["ab", "c"]
    assert text(spark, rows, "physical") == "a b c"  # neighbours are too near for a line feed


def test_columns_part_at_the_widest_gap_that_has_rows_at_both_sides(spark):
    rows = [run(0, "t0", 50, 700), run(1, "t1", 200, 700), run(2, "t2", 50, 680), run(3, "t3", 500, 680), run(4, "t4", 200, 680)]
    assert text(spark, rows, "reading") == "t0\nt2\nt1\nt4 t3"
    assert text(spark, rows[:3], "reading") == "t0 t1\nt2"


def test_equal_lefts_keep_falling_bottoms(spark):
    rows = [run(0, "a", 50, 700, 10.0), run(1, "b", 70, 700, 10.0), run(2, "c", 50, 701, 10.0), run(3, "d", 70, 701, 10.0)]
    assert text(spark, rows, "physical") == "ca db"


def test_spaces_go_by_the_run_at_hand(spark):
    rows = [run(0, "abc", 50, 700, 40.0), run(1, "אב", 120, 700, 40.0, rtl=True)]
    assert text(spark, rows, "physical") == "abcאב"
    assert text(spark, [run(0, "x", 50, 700), run(1, "y\t\u2003", 95, 700)], "physical") == "x y"


def test_labels(spark):
    n = [F.lit(x) for x in (0, 1, 4, 9, 14, 40, 90, 400, 1994, 3999)]
    assert one(spark, *map(labels.roman, n)) == ("", "I", "IV", "IX", "XIV", "XL", "XC", "CD", "MCMXCIV", "MMMCMXCIX")
    assert one(spark, *[labels.letters(F.lit(x)) for x in (0, 1, 26, 27, 53)]) == ("", "A", "Z", "AA", "AAA")
    assert one(spark, labels.page_label(F.lit("A-"), F.lit("D"), F.lit(1)), labels.page_label(F.lit("x"), F.lit("?"), F.lit(1))) == ("A-1", "x")


@pytest.mark.parametrize(("value", "seconds", "offset"), [("D:20260726010000+02'00'", 1785020400, 120), ("D:2026", 1767225600, 0), ("202601", 1767225600, 0), ("D:20261301", None, None), ("x", None, None), ("D:20260101000000Z", 1767225600, 0), (None, None, None)])
def test_dates(spark, value, seconds, offset):
    found = dates.pdf_date(F.lit(value))
    assert one(spark, F.unix_timestamp(found["ts"]), found["offset_min"]) == (seconds, offset)


def test_geometry(spark):
    assert one(spark, *[geometry.rotation(F.lit(x), F.lit(y)) for x, y in ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0), (1.0, -0.001))]) == (0, 90, 180, 270, 0)
    m = geometry.matrix(*map(F.lit, (2.0, 0.0, 0.0, 4.0, 1.0, 1.0)))
    assert one(spark, geometry.multiply(m, geometry.invert(m))["a"], geometry.invert(geometry.matrix(*[F.lit(0.0)] * 6))) == (1.0, None)
    box = geometry.rectangle(*map(F.lit, (0.0, 0.0, 10.0, 20.0)))
    fit = geometry.appearance_matrix(box, geometry.matrix(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))), geometry.rectangle(*map(F.lit, (100.0, 100.0, 120.0, 120.0))))
    assert one(spark, *geometry.apply_matrix(fit, F.lit(10.0), F.lit(20.0))) == (120.0, 120.0)
    bad = geometry.normalised_box(geometry.rectangle(*map(F.lit, (float("nan"), 0.0, 1.0, 1.0))), box)
    assert one(spark, bad["r"], geometry.contains(box, F.lit(10.0), F.lit(0.0))) == (10.0, True)


def test_colours(spark):
    assert one(spark, *colour.cmyk_to_rgb(*map(F.lit, (0.0, 1.0, 0.5, 0.5)))) == (0.5, 0.0, 0.25)
    white = one(spark, *colour.lab_to_srgb(F.lit(100.0), F.lit(0.0), F.lit(0.0), (0.9642, 1.0, 0.8249)))
    assert white == pytest.approx((1, 1, 1), abs=2e-3)
    grey = one(spark, *colour.cal_gray_to_srgb(F.lit(0.5), 2.2, colour.D65))
    assert max(grey) - min(grey) < 1e-3 and 0.4 < grey[0] < 0.6
    table = F.lit(bytearray([0, 0, 0, 255, 128, 0]))
    assert one(spark, *colour.indexed(F.lit(7.0), 1, table, 3)) == pytest.approx((1.0, 128 / 255, 0.0))


def test_blend_limits(spark):
    half, zero, full = F.lit(0.5), F.lit(0.0), F.lit(1.0)
    for mode in (*blend.SEPARABLE, *blend.NON_SEPARABLE, "Nope"):
        for b, s in ((zero, full), (full, zero), (half, half), (zero, zero), (full, full)):
            assert all(-1e-9 <= x <= 1 + 1e-9 for x in one(spark, *blend.blend(mode, (b, half, s), (s, half, b))))


def test_calculator(spark):
    run_ = lambda text, *x: one(spark, *programs.calculator(text, [F.lit(float(v)) for v in x], [(-100, 100)] * len(x), [(-1000, 1000)]))[0]
    for program, inputs, want in [("{ 3 1 roll pop pop }", (1, 2, 3), 3), ("{ 2 index }", (7, 8, 9), 7), ("{ dup mul }", (5,), 25), ("{ -7 3 mod exch pop }", (0,), -1), ("{ 1 0 div add }", (4,), 4), ("{ 2.5 round add }", (0,), 3), ("{ 90 sin add }", (0,), 1), ("{ 0 gt { 5 } { 6 } ifelse }", (-1,), 6), ("{ dup 0 lt { neg } if }", (-3,), 3), ("{ 1 atan }", (1,), 45), ("{ 6 3 and add }", (0,), 2), ("{ true false xor { 1 } { 2 } ifelse add }", (0,), 1), ("{ -1 sqrt add }", (2,), 2), ("{ -2.7 truncate add }", (0,), -2)]:
        assert run_(program, *inputs) == pytest.approx(want), program
    for bad in ("{ nope }", "{ { }", "1 2"):
        with pytest.raises(ValueError):
            programs.calculator(bad, [F.lit(1.0)], [(0, 1)], [(0, 1)])


def test_policies(spark):
    states = {"a": F.lit(True), "b": F.lit(False)}
    seen = one(spark, policy.expression_visible(["And", "a", ["Not", "b"]], states), policy.expression_visible(["Not", "a", "b"], states), policy.expression_visible(["Odd"], states), policy.membership_visible(F.lit("AllOn"), F.array(F.lit(True), F.lit(False))), policy.membership_visible(F.lit("AllOff"), F.array().cast("array<boolean>")))
    assert seen == (True, True, True, False, True)


def test_lookups(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 5), ("b", 1)], "k string, at int")
    marks = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y")], "k string, at int, v string")
    assert {(r.k, r.at): r.v for r in lookup.as_of(rows, marks, ["k"], "at", ["v"]).collect()} == {("a", 0): None, ("a", 5): "y", ("b", 1): None}
    ranges = spark.createDataFrame([(0, 10, 1, "old"), (5, 250, 2, "new")], "low int, high int, nth int, name string")
    got = lookup.range_lookup(rows.select("at"), ranges, "at", "low", "high", 100, "nth").collect()
    assert {r.at: r.name for r in got} == {0: "old", 5: "new", 1: "old"}


def test_blank_needles_are_refused(spark):
    with pytest.raises(ValueError):
        layout.search(pages(spark, [run(0, "x", 0, 0)]), " ")


def test_stream_of_files(spark, tmp_path):
    from quire import synth
    from quire.sources import pdf

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(synth.text_pdf("one two"))
    files = pdf.read_files(spark, str(tmp_path / "in"), stream=True)
    parsed = pdf.table(pdf.parse(files, ["runs"], ["path"]), "runs", ["path"])
    q = parsed.writeStream.format("memory").queryName("runs").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.text for r in spark.table("runs").collect()] == ["one two"]
    assert pdf.table(pdf.parse(pdf.read_files(spark, str(tmp_path / "in")), ["runs"], ["path"]), "runs", ["path"]).count() == 1
