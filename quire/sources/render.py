"""Pages as SVG and as pixels.

Paths, images and, in SVG only, text are painted; glyph outlines, patterns, shadings and
soft masks are not.
"""

from __future__ import annotations

import math
from xml.sax.saxutils import escape

import numpy as np

from .images import png, rgba
from .objects import PdfError

#: A curve is halved until its controls are this near to its chord, in pixels, or so often.
FLATNESS, HALVINGS = 0.1, 16


def rgb(color) -> tuple[float, float, float]:
    """Device colours of one, three or four parts."""
    c = [min(1.0, max(0.0, float(x))) for x in color]
    if len(c) == 4:
        return tuple(1 - min(1.0, x * (1 - c[3]) + c[3]) for x in c[:3])
    return tuple(c[:3]) if len(c) == 3 else (c[0],) * 3 if c else (0.0,) * 3


def cubic(a, b, c, d, flatness: float = FLATNESS, depth: int = 0) -> list[tuple[float, float]]:
    """Points after a of a curve, by halving."""
    span = math.hypot(d[0] - a[0], d[1] - a[1])

    def off(p):
        return abs((d[0] - a[0]) * (a[1] - p[1]) - (a[0] - p[0]) * (d[1] - a[1])) / span if span > 1e-12 else math.hypot(p[0] - a[0], p[1] - a[1])

    if depth >= HALVINGS or max(off(b), off(c)) <= flatness:
        return [d]
    half = lambda p, q: ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)
    ab, bc, cd = half(a, b), half(b, c), half(c, d)
    abc, bcd = half(ab, bc), half(bc, cd)
    middle = half(abc, bcd)
    return cubic(a, ab, abc, middle, flatness, depth + 1) + cubic(middle, bcd, cd, d, flatness, depth + 1)


def polygons(path, place) -> list[tuple[list[tuple[float, float]], bool]]:
    """Subpaths as points, and whether each is closed; place maps a point of the page to a pixel."""
    out: list[tuple[list, bool]] = []
    now: list[tuple[float, float]] = []
    for op, *points in path:
        points = [place(*p) for p in points]
        if op in ("m", "re"):
            if len(now) > 1:
                out.append((now, False))
            now = points[:1]
            if op == "re":
                out.append((points, True))
        elif op == "h":
            if len(now) > 1:
                out.append((now, True))
            now = now[:1]
        elif now:
            if op == "l":
                now = now + points
            else:
                b, c, d = {"c": points, "v": [now[-1], *points], "y": [points[0], points[-1], points[-1]]}[op][:3]
                now = now + cubic(now[-1], b, c, d)
    if len(now) > 1:
        out.append((now, False))
    return out


def winding(loops, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winding numbers and crossings of sample points (x, y)."""
    turns, crossed = np.zeros(x.shape, np.int32), np.zeros(x.shape, np.int32)
    for points in loops:
        for (x0, y0), (x1, y1) in zip(points, [*points[1:], points[0]]):
            if y0 == y1:
                continue
            between = (y >= min(y0, y1)) & (y < max(y0, y1))
            right = between & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
            turns[right] += 1 if y1 > y0 else -1
            crossed[right] += 1
    return turns, crossed


def dashed(points, closed: bool, dash, scale: float):
    """Pieces of a line that a dash pattern leaves; the line itself without one."""
    pattern = [x * scale for x in dash[0]]
    if not pattern or sum(pattern) <= 1e-9 or min(pattern) < 0:
        return [(points, closed)]
    points = [*points, points[0]] if closed else points
    k, left = 0, dash[1] * scale
    while left >= pattern[k % len(pattern)]:
        left -= pattern[k % len(pattern)]
        k += 1
    left, out, now = pattern[k % len(pattern)] - left, [], [points[0]]
    for a, b in zip(points, points[1:]):
        length, at = math.hypot(b[0] - a[0], b[1] - a[1]), 0.0
        while length - at > left:
            at += left
            p = (a[0] + (b[0] - a[0]) * at / length, a[1] + (b[1] - a[1]) * at / length)
            if k % 2 == 0:
                out.append(([*now, p], False))
            now, k = [p], k + 1
            left = pattern[k % len(pattern)]
        left -= length - at
        now.append(b)
    if k % 2 == 0 and len(now) > 1:
        out.append((now, False))
    return out


def outline(points, closed: bool, radius: float, cap: int, join: int):
    """Loops that together cover a stroked line: a box for each segment, and joins and caps; round ones as discs."""
    loops = []
    points = [p for i, p in enumerate(points) if i == 0 or p != points[i - 1]]
    ring = [*points, points[0]] if closed and points[0] != points[-1] else points
    disc = lambda p: [(p[0] + radius * math.cos(t * math.pi / 8), p[1] + radius * math.sin(t * math.pi / 8)) for t in range(16)]
    if len(ring) < 2:
        return [disc(points[0])] if cap == 1 else []
    for i, (a, b) in enumerate(zip(ring, ring[1:])):
        length = math.hypot(b[0] - a[0], b[1] - a[1])
        ux, uy = (b[0] - a[0]) / length * radius, (b[1] - a[1]) / length * radius
        if cap == 2 and not closed:
            a = (a[0] - ux, a[1] - uy) if i == 0 else a
            b = (b[0] + ux, b[1] + uy) if i == len(ring) - 2 else b
        loops.append([(a[0] - uy, a[1] + ux), (a[0] + uy, a[1] - ux), (b[0] + uy, b[1] - ux), (b[0] - uy, b[1] + ux)])
    corners = ring[1:-1] + ([ring[0]] if closed else [])
    loops += [disc(p) for p in corners] if join == 1 or radius > 1 and join == 0 else []
    loops += [disc(ring[0]), disc(ring[-1])] if cap == 1 and not closed else []
    return loops


BLENDS = {
    "Multiply": lambda b, s: b * s, "Screen": lambda b, s: b + s - b * s, "Darken": np.minimum, "Lighten": np.maximum, "Difference": lambda b, s: np.abs(b - s), "Exclusion": lambda b, s: b + s - 2 * b * s,
    "HardLight": lambda b, s: np.where(s <= 0.5, 2 * b * s, b + (2 * s - 1) - b * (2 * s - 1)), "Overlay": lambda b, s: np.where(b <= 0.5, 2 * b * s, s + (2 * b - 1) - s * (2 * b - 1)),
    "ColorDodge": lambda b, s: np.where(b == 0, 0, np.where(s >= 1, 1, np.minimum(1, b / np.maximum(1 - s, 1e-9)))), "ColorBurn": lambda b, s: np.where(b >= 1, 1, np.where(s <= 0, 0, 1 - np.minimum(1, (1 - b) / np.maximum(s, 1e-9)))),
    "SoftLight": lambda b, s: np.where(s <= 0.5, b - (1 - 2 * s) * b * (1 - b), b + (2 * s - 1) * (np.where(b <= 0.25, ((16 * b - 12) * b + 4) * b, np.sqrt(b)) - b)),
}


class Surface:
    """Straight-alpha pixels of a page."""

    def __init__(self, width: int, height: int, samples: int, background):
        self.samples = samples
        self.pixels = np.zeros((height, width, 4))
        if background is not None:
            self.pixels[..., :3], self.pixels[..., 3] = background, 1

    def coverage(self, loops, rule: str, clips) -> tuple[slice, slice, np.ndarray] | None:
        """Pixel rows and columns, and the share of each pixel's samples inside the loops and all clips."""
        flat = [p for loop in loops for p in loop]
        if not flat:
            return None
        height, width, _ = self.pixels.shape
        x0, x1 = max(0, math.floor(min(p[0] for p in flat))), min(width, math.ceil(max(p[0] for p in flat)))
        y0, y1 = max(0, math.floor(min(p[1] for p in flat))), min(height, math.ceil(max(p[1] for p in flat)))
        if x0 >= x1 or y0 >= y1:
            return None
        n = self.samples
        y, x = np.meshgrid(y0 + (np.arange((y1 - y0) * n) + 0.5) / n, x0 + (np.arange((x1 - x0) * n) + 0.5) / n, indexing="ij")
        inside = np.ones(x.shape, bool)
        for own, how in [(loops, rule), *clips]:
            turns, crossed = winding(own, x, y)
            inside &= crossed % 2 == 1 if how == "evenodd" else turns != 0
        return slice(y0, y1), slice(x0, x1), inside.reshape(y1 - y0, n, x1 - x0, n).mean(axis=(1, 3))

    def paint(self, where, color, alpha, mode: str) -> None:
        """Composites a colour, or an array of colours, under a coverage."""
        if where is None:
            return
        rows, columns, share = where
        back = self.pixels[rows, columns]
        source, a = np.broadcast_to(color, (*share.shape, 3)), (share * alpha)[..., None]
        b, ab = back[..., :3], back[..., 3:]
        mixed = BLENDS[mode](b, source) if mode in BLENDS else source
        out = ab + a - ab * a
        shade = ((1 - a) * ab * b + a * ((1 - ab) * source + ab * mixed)) / np.maximum(out, 1e-12)
        self.pixels[rows, columns] = np.concatenate([np.where(out > 0, shade, 0), out], axis=-1)


def raster(document, index: int, dpi: float = 72.0, samples: int = 4, background=(1.0, 1.0, 1.0)) -> np.ndarray:
    """Bytes (height, width, 4) of a page's crop box; background null is transparent."""
    if not 1 <= dpi <= 2400 or samples not in (1, 2, 4, 8):
        raise PdfError("limit", "dpi is 1 to 2400, samples are 1, 2, 4 or 8")
    info = document.pages[index]
    box = document.box(info["CropBox"]) or document.box(info["MediaBox"]) or {"l": 0, "b": 0, "r": 612, "t": 792}
    scale = dpi / 72
    width, height = max(1, round(abs(box["r"] - box["l"]) * scale)), max(1, round(abs(box["t"] - box["b"]) * scale))
    if width * height > 1 << 27:
        raise PdfError("limit", "too many pixels")
    left, top = min(box["l"], box["r"]), max(box["b"], box["t"])
    place = lambda x, y: ((x - left) * scale, (top - y) * scale)
    surface = Surface(width, height, samples, background)
    for e in document.page(index).elements:
        clips = [([p for p, _ in polygons(path, place)], rule) for path, rule in e.get("clips", ())]
        if e["kind"] == "path":
            lines = polygons(e["path"], place)
            if e["paint"] in ("fill", "both"):
                surface.paint(surface.coverage([p for p, _ in lines], e["rule"], clips), rgb(e["color"]), e["alpha"], e["mode"])
            if e["paint"] in ("stroke", "both"):
                m = e["ctm"]
                grow = math.sqrt(abs(m[0] * m[3] - m[1] * m[2])) * scale
                radius = max(e["width"] * grow / 2, 0.5)
                loops = [x for p, closed in lines for q, shut in dashed(p, closed or e["closed"], e["dash"], grow) for x in outline(q, shut, radius, e["cap"], e["join"])]
                loops = [x if _area(x) > 0 else x[::-1] for x in loops]
                surface.paint(surface.coverage(loops, "nonzero", clips), rgb(e["stroke"]), e["stroke_alpha"], e["mode"])
        elif e["kind"] == "image":
            _image(document, surface, e, place, clips)
    return np.rint(surface.pixels * 255).astype(np.uint8)


def _area(points) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, [*points[1:], points[0]]))


def _image(document, surface: Surface, e: dict, place, clips) -> None:
    try:
        pixels = rgba(document, e["image"], e["resources"]) / 255
    except (PdfError, ValueError, TypeError, IndexError):
        return
    m = e["matrix"]
    corner = lambda x, y: place(x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5])
    where = surface.coverage([[corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)]], "nonzero", clips)
    if where is None:
        return
    o, u, v = corner(0, 0), corner(1, 0), corner(0, 1)
    a, b, c, d = u[0] - o[0], v[0] - o[0], u[1] - o[1], v[1] - o[1]
    det = a * d - b * c
    if abs(det) < 1e-12:
        return
    rows, columns, share = where
    y, x = np.meshgrid(np.arange(rows.start, rows.stop) + 0.5 - o[1], np.arange(columns.start, columns.stop) + 0.5 - o[0], indexing="ij")
    s, t = (d * x - b * y) / det, (a * y - c * x) / det
    h, w, _ = pixels.shape
    found = pixels[np.clip(((1 - t) * h).astype(int), 0, h - 1), np.clip((s * w).astype(int), 0, w - 1)]
    surface.paint((rows, columns, share * found[..., 3]), found[..., :3], e["alpha"], e["mode"])


def page_png(document, index: int, **options) -> bytes:
    return png(raster(document, index, **options))


def number(x: float) -> str:
    return f"{x:.4f}".rstrip("0").rstrip(".") if x == x and abs(x) != math.inf else "0"


def _data(path) -> str:
    out, last = [], (0.0, 0.0)
    for op, *points in path:
        text = [f"{number(x)} {number(y)}" for x, y in points]
        if op == "re":
            out.append("M" + " L".join(text) + " Z")
        elif op == "h":
            out.append("Z")
        elif op in "ml":
            out.append(op.upper() + text[0])
        else:
            start = f"{number(last[0])} {number(last[1])}"
            out.append("C" + " ".join({"c": text, "v": [start, *text], "y": [*text, text[-1]]}[op][:3]))
        last = points[-1] if points else last
    return " ".join(out)


def svg(document, index: int) -> str:
    """A page's paths, texts and images in page space, turned upright by one transform."""
    import base64

    info = document.pages[index]
    box = document.box(info["CropBox"]) or document.box(info["MediaBox"]) or {"l": 0, "b": 0, "r": 612, "t": 792}
    w, h = abs(box["r"] - box["l"]), abs(box["t"] - box["b"])
    shade = lambda c: "rgb(" + ",".join(str(round(x * 255)) for x in rgb(c)) + ")"
    body, clips = [], []
    for e in document.page(index).elements:
        clip = ""
        if e.get("clips"):
            clips.append(f'<clipPath id="c{len(clips)}">' + "".join(f'<path d="{_data(p)}" clip-rule="{rule}"/>' for p, rule in e["clips"][-1:]) + "</clipPath>")
            clip = f' clip-path="url(#c{len(clips) - 1})"'
        if e["kind"] == "path":
            fill = f'fill="{shade(e["color"])}" fill-opacity="{number(e["alpha"])}" fill-rule="{e["rule"]}"' if e["paint"] != "stroke" else 'fill="none"'
            line = f' stroke="{shade(e["stroke"])}" stroke-width="{number(e["width"])}"' if e["paint"] != "fill" else ""
            body.append(f'<path d="{_data(e["path"])}" {fill}{line}{clip}/>')
        elif e["kind"] == "text" and e["text"]:
            m = e["matrix"]
            body.append(f'<text transform="matrix({" ".join(map(number, (m[0], m[1], -m[2], -m[3], m[4], m[5])))})" font-size="{number(e["size"])}" fill="{shade(e["color"])}"{clip}>{escape(e["text"])}</text>')
        elif e["kind"] == "image":
            try:
                data = base64.b64encode(png(rgba(document, e["image"], e["resources"]))).decode()
            except (PdfError, ValueError, TypeError, IndexError):
                continue
            m = e["matrix"]
            body.append(f'<image width="1" height="1" preserveAspectRatio="none" transform="matrix({" ".join(map(number, (m[0], m[1], -m[2], -m[3], m[4] + m[2], m[5] + m[3])))})" href="data:image/png;base64,{data}"{clip}/>')
    defs = f"<defs>{''.join(clips)}</defs>" if clips else ""
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {number(w)} {number(h)}">{defs}<g transform="matrix(1 0 0 -1 {number(-min(box["l"], box["r"]))} {number(max(box["b"], box["t"]))})">{"".join(body)}</g></svg>'
