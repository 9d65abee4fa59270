"""Lookups, shadings and texts at their edges, against values worked out by hand or by plain code."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import blend, geometry, programs, shading, texts, typefaces
from quire.operators import forms, lookup


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


def test_gradients_without_extent(spark):
    assert one(spark, shading.axial(*lit(3, 3, 3, 3, 8, 9)), shading.axial(*lit(0, 0, 4, 0, 6, 1))) == (0.0, 1.5)
    circle = lambda *c: tuple(lit(*c))
    same, none, line = shading.radial(circle(0, 0, 1), circle(0, 0, 1), *lit(0.5, 0)), shading.radial(circle(0, 0, 1), circle(9, 0, 1), *lit(4, 5)), shading.radial(circle(0, 0, 0), circle(3, 4, 5), *lit(3, 4))
    assert one(spark, same, none, line) == (0.0, None, 0.5)


def test_triangles(spark):
    p = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    inside, edge, flat = shading.barycentric(p(0, 0), p(4, 0), p(0, 4), *lit(1, 1)), shading.barycentric(p(0, 0), p(4, 0), p(0, 4), *lit(2, 2)), shading.barycentric(p(0, 0), p(1, 1), p(2, 2), *lit(1, 1))
    got = one(spark, inside, edge, flat)
    assert tuple(got[0]) == (0.5, 0.25, 0.25, True) and got[1].inside and got[2] is None


def test_straight_patch(spark):
    points = F.array(*[F.struct(F.lit(float(j)).alias("x"), F.lit(float(i)).alias("y")) for i in range(4) for j in range(4)])
    colours = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b")) for r in (0.0, 1.0, 1.0, 0.0)])
    got = one(spark, shading.patch_triangles(points, colours, 2))[0]
    want = []
    for i, j in itertools.product(range(2), repeat=2):
        cell = lambda a, b: (1.5 * (j + b), 1.5 * (i + a), (j + b) / 2)  # noqa: B023, E731
        want += [[cell(0, 0), cell(0, 1), cell(1, 0)], [cell(0, 1), cell(1, 0), cell(1, 1)]]
    assert [[(round(v.x, 9), round(v.y, 9), round(v.r, 9)) for v in t] for t in got] == want
    assert tuple(one(spark, shading.mesh_bounds(shading.patch_triangles(points, colours, 3)))[0]) == pytest.approx((0, 0, 3, 3))


@pytest.mark.parametrize("sizes", [[5], [3, 4], [2, 3, 2, 2], [1, 3]])
def test_sampled_grid_is_multilinear(spark, sizes):
    n, outputs = len(sizes), 2
    samples = np.random.default_rng(n).integers(0, 256, math.prod(sizes) * outputs).astype(float)
    xs = [0.13 + 0.71 * d / n for d in range(n)]
    got = one(spark, *programs.sampled_grid(lit(*xs), samples, sizes, outputs))
    table = samples.reshape(*reversed(sizes), outputs)
    for o in range(outputs):
        at, total = [x * (s - 1) for x, s in zip(xs, sizes)], 0.0
        for corner in itertools.product((0, 1), repeat=n):
            weight = math.prod(a - int(a) if c else 1 - a + int(a) for a, c in zip(at, corner))
            place = tuple(min(int(a) + c, s - 1) for a, c, s in zip(at, corner, sizes))
            total += weight * table[(*reversed(place), o)]
        assert got[o] == pytest.approx(total / 255)


def test_sampled_grid_of_many_inputs_takes_the_lower_corner(spark):
    samples = list(range(2**17))
    got = one(spark, *programs.sampled_grid(lit(*[1] * 16, 0.9), samples, [2] * 17, high=1.0))
    assert got == (2.0**16 - 1,)


def test_overprint_keeps_what_the_source_lacks(spark):
    got = one(spark, *blend.process_overprint(tuple(lit(1, 0, 1)), tuple(lit(0.25, 0, 0, 0))), *blend.process_overprint(tuple(lit(0, 0, 0)), tuple(lit(0.5, 0, 0, 0))))
    assert got == pytest.approx((0.75, 0, 1, 0, 0, 0))


def wrapped(text, width):
    out, rest = [], text.strip()
    while len(rest) > width:
        at = rest.rfind(" ", 0, width + 1)
        at = width if at <= 0 else at
        out.append(rest[:at])
        rest = rest[at:].lstrip()
    return out + [rest] * bool(rest)


@pytest.mark.parametrize("text", ["", "  ", "short", "exactly ten", "two  blanks   here and more", "averylongwordwithoutspaces and\nlines\n of text ", "é漢字 " * 9, " \t lead and trail \n", "x" * 1000, "a b" * 4000])
def test_wrap(spark, text):
    assert one(spark, texts.wrap(F.lit(text), 10))[0] == wrapped(text, 10)


def test_texts_and_numbers(spark):
    assert one(spark, texts.wrap(F.lit(None).cast("string"), 5), texts.truncate(F.lit("abcd"), 4), texts.truncate(F.lit("abcde"), 4), texts.single_line(F.lit("a\r\nb"))) == (None, "abcd", "abc…", "a  b")
    bad, none = F.array(*lit(1, "nan", 3, 4, 5)), F.array().cast("array<double>")
    got = one(spark, texts.kept_numbers(bad), texts.all_numbers(bad), texts.all_numbers(none), texts.point_pairs(bad), texts.point_pairs(none), texts.point_pairs(F.lit(None).cast("array<double>")), texts.ink_paths(F.array(bad, none)))
    assert got[0] == [1, 3, 4, 5] and got[1] is None and got[2] is None
    assert [tuple(p) for p in got[3]] == [(3, 4)] and got[4] == [] and got[5] == [] and [[tuple(p) for p in path] for path in got[6]] == [[(3, 4)]]


def test_fonts(spark):
    assert one(spark, typefaces.plain_name(F.lit("ABCDEF+Some_Font-Bold")), typefaces.plain_name(F.lit("ABCDE+Font")), typefaces.is_subset(F.lit("ABCDEF+"))) == ("somefontbold", "abcde+font", False)
    score = lambda name, wanted, own=False: typefaces.font_score(F.lit(name), F.lit(wanted), F.lit(own))
    assert one(spark, score("Times-Bold", "timesbold"), score("DejaVuSans", "courier"), score("Odd", "odd", True)) == (100 + 110 + 50, 110 + 5, 110 + 50 + 1000)


def test_labels_of_pages(spark):
    pages = spark.createDataFrame([(1, "a", 2), (1, "a", 1), (1, "b", 3), (2, "a", 0)], "doc int, label string, page int")
    wanted = spark.createDataFrame([(1, "a"), (1, "c"), (2, "a"), (3, None)], "doc int, label string")
    got = lookup.page_of_label(wanted, pages, ["doc"], "label", "page")
    assert {(r.doc, r.label): r.page for r in got.collect()} == {(1, "a"): 1, (1, "c"): None, (2, "a"): 0, (3, None): None}
    with pytest.raises(Exception, match="no page has label c"):
        lookup.page_of_label(wanted.where("label = 'c'"), pages, ["doc"], "label", "page", strict=True).collect()


def test_pages_that_are_not_there_are_errors(spark):
    pages = spark.range(3).select(F.col("id").cast("int").alias("page"))
    assert [r.page for r in lookup.page_rows(pages, F.lit(3), F.lit(2), "page").collect()] == [1]
    with pytest.raises(Exception, match="no page 4"):
        lookup.page_rows(pages, F.lit(3), F.lit(4), "page").collect()


def test_known_links_and_order(spark):
    layers = spark.createDataFrame([("x",), ("x",), ("y",)], "id string")
    asked = spark.createDataFrame([("x", 1), ("z", 2), (None, 3)], "id string, n int")
    assert sorted(r.n for r in lookup.unknown(asked, layers, ["id"]).collect()) == [2, 3]
    assert [r.n for r in lookup.all_known(asked.where("id = 'x'"), layers, ["id"]).collect()] == [1]
    with pytest.raises(Exception, match="unknown identifier z"):
        lookup.all_known(asked.where("id = 'z'"), layers, ["id"]).collect()
    notes = spark.createDataFrame([(1, "a", None), (2, "b", "a"), (3, "b", "q"), (4, None, "b")], "n int, id string, up string")
    got = {r.n: r.up_n for r in lookup.linked(notes.withColumn("doc", F.lit(0)), ["doc"], "id", {"up": ["n"]}).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 2}
    first, second = (spark.createDataFrame(rows, "doc int, seq int, kind string") for rows in ([(0, 5, "a"), (0, 2, "b")], [(0, 0, "c"), (1, 7, "d")]))
    assert sorted(map(tuple, lookup.in_order([first, second], ["doc"], "seq").collect())) == [(0, 0, "b"), (0, 1, "a"), (0, 2, "c"), (1, 0, "d")]


def test_lookups_do_not_multiply_rows(spark):
    rows = spark.createDataFrame([("a", 1.5), ("a", 1.5), ("b", 40.0), (None, None)], "name string, v double")
    table = spark.createDataFrame([("a", 7), ("a", 4)], "key string, page int")
    assert sorted(str(r.page) for r in forms.first_page(rows, [(table, "key")], "name", "page").collect()) == ["4", "4", "None", "None"]
    ranges = spark.createDataFrame([(1.0, 9.0, 1), (0.0, 30.0, 2)], "low double, high double, nth int")
    assert sorted(str(r.nth) for r in lookup.range_lookup(rows, ranges, "v", "low", "high", 10, "nth").collect()) == ["2", "2", "None", "None"]


def test_page_box_falls_back_to_crop(spark):
    box = lambda n: geometry.rectangle(*lit(n, 0, 9, 9))
    none = F.when(F.lit(False), box(0))
    of = lambda which: geometry.page_box(F.lit(which), box(1), box(2), none, box(4), none)["l"]
    assert one(spark, of("MediaBox"), of("BleedBox"), of("TrimBox"), of("ArtBox"), of("Other")) == (1, 2, 4, 2, 2)
