"""Queries that apply shadings, patches, functions of several inputs and overprint to the star-schema tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blend, programs, shading
from .relational import _KEY_SQL, _KEYS, _PAIR, _numbers, r4, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT {_KEY_SQL}, round(((l_quantity - 2) * 7 + (l_tax * 100 - 1) * 3) / 58, 4) + 0.0 AS t, 0.0::DOUBLE AS flat FROM lineitem")
def axial_gradient(spark, sf_dir):
    x, y, at = F.col("l_quantity"), F.col("l_tax") * 100, [F.lit(float(v)) for v in (2, 1, 9, 4)]
    return table(spark, sf_dir, "lineitem").select(*_KEYS, r4(shading.axial(*at, x, y)).alias("t"), shading.axial(at[0], at[0], at[0], at[0], x, y).alias("flat"))


def _radial_sql(x0, y0, r0, x1, y1, r1) -> str:
    dx, dy, dr = x1 - x0, y1 - y0, r1 - r0
    a = dx * dx + dy * dy - dr * dr
    return f"""p AS (SELECT {_KEY_SQL}, l_quantity / 7 - {x0} AS px, l_tax * 90 - {y0} AS py FROM lineitem),
q AS (SELECT *, -2 * (px * {dx} + py * {dy} + {r0 * dr}) AS b, px * px + py * py - {r0 * r0} AS c FROM p), d AS (SELECT *, b * b - 4 * {a} * c AS square FROM q),
e AS (SELECT *, CASE WHEN square >= 0 THEN (-b - sqrt(square)) / (2 * {a}) END AS s, CASE WHEN square >= 0 THEN (-b + sqrt(square)) / (2 * {a}) END AS t FROM d),
f AS (SELECT *, {r0} + s * {dr} >= 0 AS real_s, {r0} + t * {dr} >= 0 AS real_t, s BETWEEN 0 AND 1 AS in_s, t BETWEEN 0 AND 1 AS in_t FROM e),
found AS (SELECT *, CASE WHEN real_s AND real_t THEN CASE WHEN in_s AND NOT in_t THEN s WHEN in_t AND NOT in_s THEN t WHEN abs(s - 0.5) <= abs(t - 0.5) THEN s ELSE t END WHEN real_s THEN s WHEN real_t THEN t END AS place FROM f)"""


@query(f"WITH {_radial_sql(0, 0, 1, 5, 3, 2)} SELECT {_KEY_SQL}, coalesce(round(place, 4) + 0.0, -99.0) AS t FROM found")
def radial_gradient(spark, sf_dir):
    at = tuple(F.lit(float(v)) for v in (0, 0, 1)), tuple(F.lit(float(v)) for v in (5, 3, 2))
    return table(spark, sf_dir, "lineitem").select(*_KEYS, F.coalesce(r4(shading.radial(*at, F.col("l_quantity") / 7, F.col("l_tax") * 90)), F.lit(-99.0)).alias("t"))


@query(f"WITH {_radial_sql(1, 2, 4, 2, 1, 1)} SELECT {_KEY_SQL}, coalesce(round(place, 4) + 0.0, -99.0) AS t FROM found")
def radial_inside(spark, sf_dir):
    """The last circle lies in the first one."""
    at = tuple(F.lit(float(v)) for v in (1, 2, 4)), tuple(F.lit(float(v)) for v in (2, 1, 1))
    return table(spark, sf_dir, "lineitem").select(*_KEYS, F.coalesce(r4(shading.radial(*at, F.col("l_quantity") / 7, F.col("l_tax") * 90)), F.lit(-99.0)).alias("t"))


@query(f"SELECT {_KEY_SQL}, round((1 - u) * ((1 - v) * 0.2 + v * 0.9) + u * ((1 - v) * 0.7 + v * 0.4), 4) + 0.0 AS shade FROM (SELECT *, l_quantity / 51 AS u, l_linenumber / 7 AS v FROM lineitem)")
def patch_shade(spark, sf_dir):
    shade = shading.bilinear(*[F.lit(v) for v in (0.2, 0.9, 0.4, 0.7)], F.col("l_quantity") / 51, F.col("l_linenumber") / 7)
    return table(spark, sf_dir, "lineitem").select(*_KEYS, r4(shade).alias("shade"))


@query(f"WITH w AS (SELECT *, (-6 * (l_quantity - 7) - 43 * (l_tax * 100 - 9)) / 429 AS a, (9 * (l_quantity - 7) - 7 * (l_tax * 100 - 9)) / 429 AS b FROM lineitem) SELECT {_KEY_SQL}, round(a, 4) + 0.0 AS wa, round(b, 4) + 0.0 AS wb, round(1 - a - b, 4) + 0.0 AS wc, a >= -1e-9 AND b >= -1e-9 AND 1 - a - b >= -1e-9 AS inside FROM w")
def triangle_weights(spark, sf_dir):
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    w = shading.barycentric(point(0, 0), point(50, 3), point(7, 9), F.col("l_quantity"), F.col("l_tax") * 100)
    return table(spark, sf_dir, "lineitem").select(*_KEYS, w.alias("w")).select(*_KEYS, *[r4(F.col(f"w.{n}")).alias(n) for n in ("wa", "wb", "wc")], "w.inside")


_WEIGHTS = {v: [f"(1 - {v}) ** 3", f"3 * {v} * (1 - {v}) ** 2", f"3 * {v} ** 2 * (1 - {v})", f"{v} ** 3"] for v in "uv"}
_PATCH_X, _PATCH_Y = (" + ".join(f"({value(i, j)}) * ({_WEIGHTS['u'][i]}) * ({_WEIGHTS['v'][j]})" for i in range(4) for j in range(4)) for value in (lambda i, j: f"{10 * j} + (k + {3 * i}) % 7", lambda i, j: f"{10 * i} + (k * {j + 1}) % 5"))
_SHADE = "(1 - u) * ((1 - v) * 0.1 + v * (k % 3) / 3.0) + u * ((1 - v) * 0.8 + v * 0.5)"
_GRID = f"g AS (SELECT k, a, b, {_PATCH_X} AS x, {_PATCH_Y} AS y, {_SHADE} AS red FROM (SELECT n_nationkey AS k, a, b, a / 12 AS u, b / 12 AS v FROM nation, unnest(range(13)) AS r(a), unnest(range(13)) AS s(b)))"


def _patches(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    points = F.array(*[F.struct((10.0 * j + (k + 3 * i) % 7).alias("x"), (10.0 * i + (k * (j + 1)) % 5).alias("y")) for i in range(4) for j in range(4)])
    corner = lambda red: F.struct(red.alias("r"), F.lit(0.0).alias("g"), F.lit(1.0).alias("b"))
    colours = F.array(corner(F.lit(0.1)), corner(k % 3 / 3.0), corner(F.lit(0.5)), corner(F.lit(0.8)))
    return table(spark, sf_dir, "nation").select(k.alias("nation"), shading.patch_triangles(points, colours).alias("triangles"))


@query(f"WITH {_GRID}, t AS (SELECT k, 2 * (12 * a + b) AS n, a, b, false AS up FROM g WHERE a < 12 AND b < 12 UNION ALL SELECT k, 2 * (12 * a + b) + 1, a, b, true FROM g WHERE a < 12 AND b < 12), c AS (SELECT t.k, t.n, unnest(CASE WHEN up THEN [0, 1, 2] ELSE [0, 1, 2] END) AS corner, t.a + unnest(CASE WHEN up THEN [0, 1, 1] ELSE [0, 0, 1] END) AS a, t.b + unnest(CASE WHEN up THEN [1, 0, 1] ELSE [0, 1, 0] END) AS b FROM t) SELECT c.k AS nation, n::INT AS triangle, corner::INT AS corner, round(x + 1e-7, 4) + 0.0 AS x, round(y + 1e-7, 4) + 0.0 AS y, round(red + 1e-7, 4) + 0.0 AS red FROM c JOIN g USING (k, a, b)")
def mesh_triangles(spark, sf_dir):
    """Every vertex of every triangle of a patch for each nation; values are moved off the halves, where the order of sums decides."""
    corners = _patches(spark, sf_dir).select("nation", F.posexplode("triangles").alias("triangle", "at")).select("nation", "triangle", F.posexplode("at").alias("corner", "p"))
    return corners.select("nation", "triangle", "corner", *[r4(F.col(f"p.{n}") + 1e-7).alias(name) for n, name in (("x", "x"), ("y", "y"), ("r", "red"))])


@query(f"WITH {_GRID} SELECT k AS nation, round(min(x) + 1e-7, 4) + 0.0 AS l, round(min(y) + 1e-7, 4) + 0.0 AS b, round(max(x) + 1e-7, 4) + 0.0 AS r, round(max(y) + 1e-7, 4) + 0.0 AS t FROM g GROUP BY k")
def mesh_bounds(spark, sf_dir):
    found = _patches(spark, sf_dir).select("nation", shading.mesh_bounds(F.col("triangles")).alias("box"))
    return found.select("nation", *[r4(F.col(f"box.{n}") + 1e-7).alias(n) for n in "lbrt"])


@query("SELECT event_id, event_id % 9 BETWEEN 4 AND 7 AND user_id % 34 BETWEEN 1 AND 32 AND event_id % 11 > 0 AND event_id % 5 <> 2 AND n >= 1 AND CASE WHEN event_id % 2 = 0 THEN n = 1 ELSE n = 3 END AS valid FROM (SELECT *, event_id % 4 AS n FROM events)")
def mesh_gate(spark, sf_dir):
    e, n = F.col("event_id"), F.col("event_id") % 4
    size = 4 + 2 * n + F.when(e % 5 == 2, 1).otherwise(0)
    valid = shading.mesh_valid(e % 9, F.col("user_id") % 34, e % 11, F.array_repeat(F.lit(1.0), size.cast("int")), F.lit(3), e % 2 == 0)
    return table(spark, sf_dir, "events").select("event_id", valid.alias("valid"))


_INK = {c: f"CASE WHEN black >= 1 - 1e-12 THEN 0 ELSE least(greatest((1 - {b} - black) / (1 - black), 0), 1) END" for c, b in (("c", "b0"), ("m", "b1"), ("y", "b2"))}
_SOURCE = {"c": "CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE s0 END", "m": "CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE s1 END", "y": "s2", "k": "CASE WHEN l_suppkey % 5 = 0 THEN 0.3 ELSE 0 END"}


@query(
    f"""
WITH p AS (SELECT *, 1 - greatest(b0, b1, b2) AS black FROM ({_PAIR})),
q AS (SELECT *, {", ".join(f"CASE WHEN {_SOURCE[c]} > 1e-12 THEN {_SOURCE[c]} ELSE {_INK[c]} END AS {c}" for c in "cmy")}, CASE WHEN {_SOURCE["k"]} > 1e-12 THEN {_SOURCE["k"]} ELSE least(greatest(black, 0), 1) END AS k FROM p)
SELECT {_KEY_SQL}, {", ".join(f"round(1 - least(1.0, {c} * (1 - k) + k) + 1e-7, 4) + 0.0 AS {n}" for c, n in (("c", "red"), ("m", "green"), ("y", "blue")))} FROM q
"""
)
def process_overprint(spark, sf_dir):
    """Values are moved off the halves, where the order of sums decides."""
    rows, x = _numbers(spark, sf_dir)
    supplier, zero = F.col("l_suppkey"), F.lit(0.0)
    source = (F.when(supplier % 2 == 0, zero).otherwise(x[3]), F.when(supplier % 3 == 0, zero).otherwise((F.col("l_partkey") % 101) / 100), (supplier % 11) / 10, F.when(supplier % 5 == 0, 0.3).otherwise(zero))
    return rows.select(*_KEYS, *[r4(c + 1e-7).alias(n) for c, n in zip(blend.process_overprint(tuple(x[:3]), source), ("red", "green", "blue"))])


_SAMPLES = [(i * 37 + i * i * 11) % 256 for i in range(4 * 3 * 2)]


def _sample(i: str, j: str, o: int) -> str:
    return f"t[(({i}) + 4 * ({j})) * 2 + {o + 1}]"


def _mixed(o: int) -> str:
    i, j = ("k", "least(k + 1, 3)"), ("m", "least(m + 1, 2)")
    return " + ".join(f"{'(x - k)' if a else '(1 - x + k)'} * {'(z - m)' if b else '(1 - z + m)'} * {_sample(i[a], j[b], o)}" for a in (0, 1) for b in (0, 1))


@query(f"WITH p AS (SELECT *, least(greatest(l_quantity / 51, 0), 1) * 3 AS x, 2 - least(greatest(l_linenumber / 6.5, 0), 1) * 2 AS z, {_SAMPLES} AS t FROM lineitem), q AS (SELECT *, floor(x)::INT AS k, floor(z)::INT AS m FROM p) SELECT {_KEY_SQL}, round(({_mixed(0)}) / 255 + 1e-7, 4) + 0.0 AS u, round(least(greatest(-1 + ({_mixed(1)}) * 3 / 255, -0.5), 1.5) + 1e-7, 4) + 0.0 AS v FROM q")
def fn_sampled_grid(spark, sf_dir):
    """Two inputs and two outputs, the second input falling; values are moved off the halves."""
    u, v = programs.sampled_grid([F.col("l_quantity") / 51, F.col("l_linenumber") / 6.5], _SAMPLES, [4, 3], 2, encode=[(0.0, 3.0), (2.0, 0.0)], decode=[(0.0, 1.0), (-1.0, 2.0)], bounds=[(0.0, 1.0), (-0.5, 1.5)])
    return table(spark, sf_dir, "lineitem").select(*_KEYS, r4(u + 1e-7).alias("u"), r4(v + 1e-7).alias("v"))
