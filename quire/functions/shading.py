"""Gradients, patches and triangles of shadings as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells of a patch in each direction; a triangle's and an axis's least extent; how far outside a triangle still counts as inside.
DIVISIONS, NO_EXTENT, EDGE = 12, 1e-20, -1e-9


def _bind(value: Column, use) -> Column:
    """use(value) with value evaluated once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def axial(x0: Column, y0: Column, x1: Column, y1: Column, x: Column, y: Column) -> Column:
    """The parameter of a point along an axis: 0 at its start, 1 at its end, 0 everywhere if it has no length."""
    dx, dy = x1 - x0, y1 - y0
    length = dx * dx + dy * dy
    return F.when(length <= NO_EXTENT, F.lit(0.0)).otherwise(F.try_divide((x - x0) * dx + (y - y0) * dy, length))


def radial(first: tuple[Column, Column, Column], last: tuple[Column, Column, Column], x: Column, y: Column) -> Column:
    """The parameter of the circle through a point among those from `first` to `last` (x, y, radius); null where none with a radius of 0 or more goes through it.

    Of two such circles the one between both ends counts, and if both or neither are, the
    one whose parameter is nearer to a half (the lesser one if they are as near).
    """
    (x0, y0, r0), (x1, y1, r1) = first, last
    dx, dy, dr, px, py = x1 - x0, y1 - y0, r1 - r0, x - x0, y - y0
    quadratic = F.struct((dx * dx + dy * dy - dr * dr).alias("a"), (-2 * (px * dx + py * dy + r0 * dr)).alias("b"), (px * px + py * py - r0 * r0).alias("c"))

    def choose(q: Column) -> Column:
        a, b = q["a"], q["b"]
        linear = F.when(F.abs(b) <= 1e-15, F.lit(0.0)).otherwise(F.try_divide(-q["c"], b))
        square = b * b - 4 * a * q["c"]
        root = F.sqrt(F.greatest(square, F.lit(0.0)))
        roots = F.struct(F.try_divide(-b - root, 2 * a).alias("s"), F.try_divide(-b + root, 2 * a).alias("t"))
        return F.when(F.abs(a) <= 1e-15, linear).when(square >= 0, _bind(roots, between))

    def between(r: Column) -> Column:
        s, t = r["s"], r["t"]
        real_s, real_t = r0 + s * dr >= 0, r0 + t * dr >= 0
        in_s, in_t = s.between(0, 1), t.between(0, 1)
        nearer = F.when(F.abs(s - 0.5) <= F.abs(t - 0.5), s).otherwise(t)
        both = F.when(in_s & ~in_t, s).when(in_t & ~in_s, t).otherwise(nearer)
        return F.when(real_s & real_t, both).when(real_s, s).when(real_t, t)

    return _bind(quadratic, choose)


def bernstein(t: Column) -> list[Column]:
    """The four cubic weights at t."""
    s = 1 - t
    return [s * s * s, 3 * t * s * s, 3 * t * t * s, t * t * t]


def bilinear(c00: Column, c01: Column, c11: Column, c10: Column, u: Column, v: Column) -> Column:
    """Between four corners in the order of a patch's colours; u leads from the first side to the opposite one."""
    return (1 - u) * ((1 - v) * c00 + v * c01) + u * ((1 - v) * c10 + v * c11)


def barycentric(a: Column, b: Column, c: Column, x: Column, y: Column) -> Column:
    """struct wa, wb, wc, inside of a point in a triangle of points (x, y); null where the triangle has no area."""
    area = (b["y"] - c["y"]) * (a["x"] - c["x"]) + (c["x"] - b["x"]) * (a["y"] - c["y"])
    wa = F.try_divide((b["y"] - c["y"]) * (x - c["x"]) + (c["x"] - b["x"]) * (y - c["y"]), area)
    wb = F.try_divide((c["y"] - a["y"]) * (x - c["x"]) + (a["x"] - c["x"]) * (y - c["y"]), area)

    def told(w: Column) -> Column:
        wc = 1 - w["wa"] - w["wb"]
        return F.struct(w["wa"].alias("wa"), w["wb"].alias("wb"), wc.alias("wc"), ((w["wa"] >= EDGE) & (w["wb"] >= EDGE) & (wc >= EDGE)).alias("inside"))

    return F.when(F.abs(area) > NO_EXTENT, _bind(F.struct(wa.alias("wa"), wb.alias("wb")), told))


def patch_point(points: Column, u: Column, v: Column) -> Column:
    """The point (x, y) of a tensor patch; points are its 16, row by row, and u leads from row to row."""
    rows, columns = bernstein(u), bernstein(v)
    total = lambda n: sum((F.get(points, F.lit(4 * i + j))[n] * (rows[i] * columns[j]) for i in range(4) for j in range(4)), F.lit(0.0))
    return F.struct(total("x").alias("x"), total("y").alias("y"))


def patch_triangles(points: Column, colours: Column, divisions: int = DIVISIONS) -> Column:
    """array of triangles, each an array of three vertices (x, y, r, g, b), of a patch dealt into a grid of cells, two triangles each.

    Its size is fixed by `divisions`, so a row makes 2 * divisions ** 2 triangles.
    """
    across = divisions + 1

    def vertex(k: Column) -> Column:
        u, v = F.floor(k / across) / divisions, (k % across) / divisions
        at = patch_point(points, u, v)
        corner = lambda i, n: F.get(colours, F.lit(i))[n]
        shade = [bilinear(*[corner(i, n) for i in range(4)], u, v).alias(n) for n in "rgb"]
        return _bind(at, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), *shade))

    def triangles(grid: Column) -> Column:
        def triangle(k: Column) -> Column:
            cell = F.floor(k / 2)
            first = (F.floor(cell / divisions) * across + cell % divisions).cast("int")
            upper = k % 2
            places = [first + upper, first + 1 + upper * (across - 1), first + across + upper]
            return F.array(*[F.get(grid, p.cast("int")) for p in places])

        return F.transform(F.sequence(F.lit(0), F.lit(2 * divisions * divisions - 1)), triangle)

    return _bind(F.transform(F.sequence(F.lit(0), F.lit(across * across - 1)), vertex), triangles)


def mesh_bounds(triangles: Column) -> Column:
    """The box l, b, r, t of all vertices; null bounds for no triangles."""
    of = lambda n: F.transform(F.flatten(triangles), lambda p: p[n])
    return F.struct(F.array_min(of("x")).alias("l"), F.array_min(of("y")).alias("b"), F.array_max(of("x")).alias("r"), F.array_max(of("y")).alias("t"))


def mesh_valid(kind: Column, coordinate_bits: Column, component_bits: Column, decode: Column, components: Column, has_function: Column) -> Column:
    """Whether a mesh shading can be read: types 4 to 7, 1 to 32 bits, pairs of decode numbers for the place and for each component, which is the only one before a function."""
    data = F.floor((F.size(decode) - 4) / 2)
    whole = (F.size(decode) >= 6) & (F.size(decode) % 2 == 0)
    good = kind.between(4, 7) & coordinate_bits.between(1, 32) & component_bits.between(1, 32) & whole & F.when(has_function, data == 1).otherwise(data == components)
    return F.coalesce(good, F.lit(False))
