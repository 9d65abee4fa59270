"""Content streams: operations, text runs and painted elements of a page."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from .filters import decode
from .fonts import Font
from .objects import HELD, SPACE, Keyword, Lexer, Name, PdfError, Ref, Stream

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
PAINT = {b"S": "stroke", b"s": "stroke", b"f": "fill", b"F": "fill", b"f*": "fill", b"B": "both", b"B*": "both", b"b": "both", b"b*": "both"}


def multiply(p, q):
    """First p, then q."""
    return (p[0] * q[0] + p[1] * q[2], p[0] * q[1] + p[1] * q[3], p[2] * q[0] + p[3] * q[2], p[2] * q[1] + p[3] * q[3], p[4] * q[0] + p[5] * q[2] + q[4], p[4] * q[1] + p[5] * q[3] + q[5])


def apply(m, x, y):
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


# An operation of plain numbers, names and hex strings, which is read at once; any other is read object by object.
_PLAIN = re.compile(rb"[\0\t\n\x0c\r ]*((?:(?:[+-]?(?:\d{1,15}(?:\.\d{0,15})?|\.\d{1,15})|/[A-Za-z0-9_.+*-]+)[\0\t\n\x0c\r ]+|<[0-9A-Fa-f]*>[\0\t\n\x0c\r ]*)*+)([A-Za-z'\"][A-Za-z0-9*'\"]*)(?![^\0\t\n\x0c\r ()<>\[\]{}/%])")
_NO_OPERATOR = {b"BI", b"true", b"false", b"null"}
_SPLIT = re.compile(rb"[^\0\t\n\x0c\r <>]+|<[0-9A-Fa-f]*")


# A text object of one string at a place of its own, in plain numbers.
_N = rb"[+-]?(?:\d{1,15}(?:\.\d{0,15})?|\.\d{1,15})"
_S = rb"[\0\t\n\x0c\r ]"
_TEXT = re.compile(_S + rb"*BT" + _S + rb"+/([A-Za-z0-9_.+*-]+)" + _S + rb"+(" + _N + rb")" + _S + rb"+Tf" + _S + rb"+((?:" + _N + _S + rb"+){6})Tm" + _S + rb"*<((?:[0-9A-Fa-f]{2})*)>" + _S + rb"*Tj" + _S + rb"+ET(?![^\0\t\n\x0c\r ()<>\[\]{}/%])")
# Short operands that were met, each a list that nobody changes; emptied when full.
OPERANDS: dict[bytes, list] = {}


def _operand(w: bytes):
    return bytes.fromhex((w[1:] + b"0" * (len(w) % 2 == 0)).decode()) if w[0] == 0x3C else Name(w[1:].decode("latin-1")) if w[0] == 0x2F else float(w) if b"." in w else int(w)


def _operands(words: bytes) -> list:
    if words in OPERANDS:
        return OPERANDS[words]
    if words[:1] == b"<" and words.find(b">") == len(words.rstrip(SPACE)) - 1:
        return [_operand(words[: words.find(b">")])]
    own = [_operand(w) for w in _SPLIT.findall(words)]
    if len(words) <= 48:
        if len(OPERANDS) >= 2 * HELD:
            OPERANDS.clear()
        OPERANDS[words] = own
    return own


def operations(data: bytes, limit: int, whole: bool = False) -> Iterator[tuple[str, list]]:
    """(operator, operands); the first syntax error ends the stream without a word. whole: BT, Tf, Tm, Tj and ET come as one, called "text", where there are just these."""
    lexer, operands, n = Lexer(data), [], 0
    while True:
        if whole and not operands and n + 5 <= limit and (m := _TEXT.match(data, lexer.at)):
            lexer.at = m.end()
            n += 5
            yield "text", [m[1].decode(), *_operands(m[2]), _operands(m[3]), bytes.fromhex(m[4].decode())]
            continue
        if not operands and (m := _PLAIN.match(data, lexer.at)) and m[2] not in _NO_OPERATOR:
            lexer.at = m.end()
            n += 1
            if n > limit:
                raise PdfError("limit", "too many operations")
            yield m[2].decode(), _operands(m[1]) if m[1] else []
            continue
        try:
            lexer.skip()
            if lexer.at >= len(data):
                return
            got = lexer.read()
        except (PdfError, ValueError):
            return
        if not isinstance(got, Keyword):
            operands.append(got)
            continue
        n += 1
        if n > limit:
            raise PdfError("limit", "too many operations")
        if got == b"BI":
            image = _inline(lexer)
            if image is None:
                return
            yield "BI", [image]
        else:
            yield got.decode("latin-1"), operands
        operands = []


def _inline(lexer: Lexer) -> Stream | None:
    head: dict = {}
    try:
        while True:
            key = lexer.read()
            if isinstance(key, Keyword):
                break
            head[str(key)] = lexer._item(1)
    except PdfError:
        return None
    if key != b"ID":
        return None
    start = lexer.at + 1
    names, size = head.get("F", head.get("Filter")), None
    if names is None:
        w, h = head.get("W", head.get("Width", 0)), head.get("H", head.get("Height", 0))
        bits = 1 if head.get("IM", head.get("ImageMask")) else head.get("BPC", head.get("BitsPerComponent", 8))
        space = head.get("CS", head.get("ColorSpace"))
        parts = {"RGB": 3, "DeviceRGB": 3, "CMYK": 4, "DeviceCMYK": 4}.get(str(space), 1)
        size = (w * bits * parts + 7) // 8 * h
    m = re.compile(rb"[\0\t\n\x0c\r ]?EI(?=[\0\t\n\x0c\r ]|$)").search(lexer.data, start + (size or 0))
    if not m:
        return None
    lexer.at = m.end()
    return Stream(head, lexer.data[start : start + size if size is not None else m.start()])


def page_content(objects, page: dict) -> bytes:
    """Contents joined by line feeds; a part that does not decode is left out if another does."""
    got = objects.get(page, "Contents")
    parts = got if isinstance(got, list) else [page.get("Contents")]
    out, bad = [], None
    for x in parts:
        try:
            x = objects.resolve(x)
            if isinstance(x, Stream):
                out.append(decode(x, objects, objects.limits["decoded_bytes"]))
        except PdfError as e:
            if e.kind == "limit":
                raise
            bad = e
    if bad and not out:
        raise bad
    if bad:
        objects.note("content.repaired", str(bad))
    return b"\n".join(out)


#: Code points that are taken for right-to-left.
RTL = ((0x590, 0x8FF), (0xFB1D, 0xFDFF), (0xFE70, 0xFEFF), (0x10800, 0x10FFF))


def is_rtl(text: str) -> bool:
    """Whether a character of the right-to-left blocks comes before any other letter."""
    if text.isascii() or max(text) < "\u0590":
        return False
    for c in text:
        if any(low <= ord(c) <= high for low, high in RTL):
            return True
        if c.isalpha():
            return False
    return False


class State:
    def __init__(self):
        self.ctm, self.font, self.size, self.spacing, self.word, self.scale, self.leading, self.rise = IDENTITY, None, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0
        self.font_name, self.fill, self.stroke, self.width, self.blend, self.alpha = "", (0.0,), (0.0,), 1.0, "Normal", 1.0
        self.cap, self.join, self.miter, self.dash, self.clips, self.stroke_alpha = 0, 0, 10.0, ([], 0.0), (), 1.0

    def copy(self):
        new = State.__new__(State)
        new.__dict__ = dict(self.__dict__)
        return new


class Page:
    """Interprets one page: `runs`, `elements` and `operators` in the order of the content."""

    def __init__(self, document, page: dict, resources: dict, wanted: set[str] | None = None):
        """wanted: of elements, images and operators, those to list; all if null."""
        self.document, self.objects = document, document.objects
        self.painted, self.listed = wanted is None or bool(wanted & {"elements", "images"}), wanted is None or "operators" in wanted
        self.runs: list[dict] = []
        self.elements: list[dict] = []
        self.operators: list[tuple[str, int]] = []
        self.fonts: dict[str, Font] = {}
        self.active: set[int] = set()
        self.run(page_content(self.objects, page), resources, State(), None, True)

    def font(self, resources: dict, name: str) -> Font:
        """The font of a name; one that is an object by itself is read once for the document."""
        holder = self.objects.get(resources, "Font", dict) or {}
        to = holder.get(name)
        fonts, key = (self.document.fonts, to) if isinstance(to, Ref) else (self.fonts, f"{id(holder)}/{name}")
        if key not in fonts:
            fonts[key] = Font(self.objects, self.objects.get(holder, name, dict), self.objects.limits["decoded_bytes"])
        return fonts[key]

    def add(self, kind: str, parent: int | None, **more) -> int:
        self.elements.append({"seq": len(self.elements), "parent": parent, "kind": kind, **more})
        return len(self.elements) - 1

    def run(self, data: bytes, resources: dict, s: State, parent: int | None, top: bool) -> None:
        stack: list[State] = []
        shown: list[bool] = []
        tm = lm = IDENTITY
        path: list[tuple] = []
        clip = None
        get = self.objects.get
        for op, v in operations(data, self.objects.limits["operations"], not self.painted and not self.listed):
            if top and self.listed:
                self.operators.append((op, len(v)))
            try:
                if op == "text":
                    try:
                        s.font, s.font_name, s.size = self.font(resources, v[0]), v[0], float(v[1])
                    except (IndexError, TypeError, ValueError, AttributeError):
                        pass
                    lm = tuple(map(float, v[2]))
                    tm = lm
                    tm = self.show(v[3], s, tm, resources, all(shown) and top)
                elif op == "ET":
                    pass
                elif op in ("Tj", "TJ", "'", '"'):
                    if op in "'\"":
                        if op == '"':
                            s.word, s.spacing = float(v[0]), float(v[1])
                        tm = lm = multiply((1, 0, 0, 1, 0, -s.leading), lm)
                    parts = v[-1] if op == "TJ" else [v[-1]]
                    first, at = len(self.runs), tm
                    for x in parts:
                        if type(x) in (int, float):
                            move = -x / 1000 * s.size
                            tm = multiply((1, 0, 0, 1, 0, move) if s.font and s.font.vertical else (1, 0, 0, 1, move * s.scale, 0), tm)
                        elif isinstance(x, bytes):
                            tm = self.show(x, s, tm, resources, all(shown) and top)
                    if self.painted and all(shown):
                        self.add("text", parent, text="".join(r["text"] for r in self.runs[first:]) if top else "", points=[apply(multiply(at, s.ctm), 0, 0)], size=s.size, matrix=multiply(at, s.ctm), font=s.font.base if s.font else "", color=s.fill, mode=s.blend, alpha=s.alpha, clips=s.clips)
                elif op == "BT":
                    tm = lm = IDENTITY
                elif op == "Tf":
                    s.font, s.font_name, s.size = self.font(resources, str(v[0])), str(v[0]), float(v[1])
                elif op == "Tm":
                    tm = lm = tuple(map(float, v[:6]))
                elif op in ("BMC", "BDC"):
                    shown.append(self.document.marked_visible(resources, v) if op == "BDC" else True)
                elif op == "EMC":
                    shown and shown.pop()
                elif op == "q":
                    stack.append(s.copy())
                elif op == "Q":
                    s = stack.pop() if stack else s
                elif op == "cm":
                    s.ctm = multiply(tuple(map(float, v[:6])), s.ctm)
                elif op in ("Td", "TD"):
                    s.leading = -float(v[1]) if op == "TD" else s.leading
                    tm = lm = multiply((1, 0, 0, 1, float(v[0]), float(v[1])), lm)
                elif op == "T*":
                    tm = lm = multiply((1, 0, 0, 1, 0, -s.leading), lm)
                elif op == "Tc":
                    s.spacing = float(v[0])
                elif op == "Tw":
                    s.word = float(v[0])
                elif op == "Tz":
                    s.scale = float(v[0]) / 100
                elif op == "TL":
                    s.leading = float(v[0])
                elif op == "Ts":
                    s.rise = float(v[0])
                elif op in ("m", "l", "c", "v", "y", "re", "h"):
                    path.append((op, *(_corners(s.ctm, *map(float, v[:4])) if op == "re" else [apply(s.ctm, float(a), float(b)) for a, b in zip(v[::2], v[1::2])])))
                elif op in ("W", "W*"):
                    clip = "evenodd" if op == "W*" else "nonzero"
                elif op == "J":
                    s.cap = int(v[0])
                elif op == "j":
                    s.join = int(v[0])
                elif op == "M":
                    s.miter = float(v[0])
                elif op == "d":
                    s.dash = ([float(x) for x in v[0]], float(v[1]))
                elif op.encode() in PAINT or op == "n":
                    if op != "n" and all(shown) and path:
                        self.add("path", parent, paint=PAINT[op.encode()], rule="evenodd" if "*" in op else "nonzero", path=path, closed=op in ("s", "b", "b*"), color=s.fill, stroke=s.stroke, width=s.width, ctm=s.ctm, cap=s.cap, join=s.join, dash=s.dash, clips=s.clips, mode=s.blend, alpha=s.alpha, stroke_alpha=s.stroke_alpha)
                    if clip and path:
                        s.clips = (*s.clips, (tuple(path), clip))
                    path, clip = [], None
                elif op in ("g", "rg", "k", "sc", "scn"):
                    s.fill = tuple(float(x) for x in v if type(x) in (int, float)) or s.fill
                elif op in ("G", "RG", "K", "SC", "SCN"):
                    s.stroke = tuple(float(x) for x in v if type(x) in (int, float)) or s.stroke
                elif op == "w":
                    s.width = float(v[0])
                elif op == "gs":
                    own = get(get(resources, "ExtGState", dict) or {}, str(v[0]), dict) or {}
                    mode = get(own, "BM")
                    s.blend = str(mode[0] if isinstance(mode, list) and mode else mode or s.blend)
                    alpha = get(own, "ca", float)
                    s.alpha = s.alpha if alpha is None else min(1.0, max(0.0, alpha))
                    alpha = get(own, "CA", float)
                    s.stroke_alpha = s.stroke_alpha if alpha is None else min(1.0, max(0.0, alpha))
                    width = get(own, "LW", float)
                    s.width = s.width if width is None else width
                elif op == "sh" and all(shown):
                    shading = get(get(resources, "Shading", dict) or {}, str(v[0]))
                    kind = get(shading, "ShadingType", int) or 0
                    self.add("mesh" if kind >= 4 else "gradient", parent, points=[])
                elif op == "BI" and all(shown):
                    self.add("image", parent, image=v[0], inline=True, matrix=s.ctm, clips=s.clips, alpha=s.alpha, mode=s.blend, resources=resources, points=[apply(s.ctm, x, y) for x, y in ((0, 0), (1, 1))])
                elif op == "Do" and all(shown):
                    self.xobject(resources, str(v[0]), s, parent)
            except (IndexError, TypeError, ValueError, AttributeError):
                continue

    def xobject(self, resources: dict, name: str, s: State, parent: int | None) -> None:
        get = self.objects.get
        got = get(get(resources, "XObject", dict) or {}, name, Stream)
        if got is None or not self.document.layer_visible(got.dict.get("OC")):
            return
        if get(got, "Subtype") == "Image":
            self.add("image", parent, image=got, inline=False, matrix=s.ctm, clips=s.clips, alpha=s.alpha, mode=s.blend, resources=resources, points=[apply(s.ctm, x, y) for x, y in ((0, 0), (1, 1))])
        elif get(got, "Subtype") == "Form":
            if id(got) in self.active or len(self.active) > 64:
                self.objects.note("graphics.form.recursive", f"form {name} contains itself")
                return
            matrix = [float(self.objects.resolve(x)) for x in get(got, "Matrix", list) or IDENTITY]
            inner = s.copy()
            inner.ctm = multiply(tuple(matrix), s.ctm)
            group = self.add("group", parent, points=[]) if get(got, "Group", dict) is not None else parent
            self.active.add(id(got))
            self.run(decode(got, self.objects, self.objects.limits["decoded_bytes"]), get(got, "Resources", dict) or resources, inner, group, False)
            self.active.discard(id(got))

    def show(self, data: bytes, s: State, tm, resources: dict, visible: bool):
        """A run of the shown string, and the matrix after it."""
        font = s.font or self.font(resources, "")
        text, n, advance, spaces = font.measure(data)
        spacing = s.spacing * n + (s.word * spaces if s.word else 0.0)
        if font.vertical:
            x, y = 0.0, advance * s.size - spacing
        else:
            x, y = (advance * s.size + spacing) * s.scale, 0.0
        seen = text.rstrip() if visible else ""
        if seen:
            m = multiply(tm, s.ctm)
            if font.vertical:
                half = s.size * 0.5 * s.scale
                box = (-half, min(0.0, y) + s.rise, half, max(0.0, y) + s.rise)
            else:
                box = (min(0.0, x), font.descent * s.size + s.rise, max(0.0, x), font.ascent * s.size + s.rise)
            if m[1] == m[2] == 0:
                xs, ys = (box[0] * m[0] + m[4], box[2] * m[0] + m[4]), (box[1] * m[3] + m[5], box[3] * m[3] + m[5])
            else:
                corners = [apply(m, a, b) for a in box[::2] for b in box[1::2]]
                xs, ys = [c[0] for c in corners], [c[1] for c in corners]
            (from_x, from_y), (to_x, to_y) = apply(m, 0.0, 0.0), apply(m, x, y)
            turned = 0 if to_y == from_y and to_x > from_x else round(math.degrees(math.atan2(to_y - from_y, to_x - from_x))) % 360
            self.runs.append({
                "seq": len(self.runs), "text": seen, "left": min(xs), "bottom": min(ys), "right": max(xs), "top": max(ys), "rotation": turned,
                "space_after": text[-1].isspace(), "font_name": font.base, "font_size": s.size, "vertical": font.vertical, "rtl": is_rtl(seen),
            })
        return multiply((1, 0, 0, 1, x, y), tm)


def _corners(m, x: float, y: float, w: float, h: float) -> list:
    return [apply(m, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
