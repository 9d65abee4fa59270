"""Fonts: codes to text and advances."""

from __future__ import annotations

import re
from codecs import charmap_decode
from functools import cache

from .filters import decode
from .objects import Lexer, Keyword, Name, PdfError, Stream

# Public Core-14 advance widths of the characters from space to tilde.
HELVETICA = "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
HELVETICA_BOLD = "278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611 975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556 333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584"
TIMES = "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"
TIMES_BOLD = "250 333 555 500 500 1000 833 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 930 722 667 722 722 667 611 778 778 389 500 778 667 944 722 778 611 778 722 556 667 722 722 1000 722 722 667 333 278 333 581 500 333 500 556 444 556 444 333 500 556 278 333 556 278 833 556 500 556 556 444 389 333 556 500 722 500 500 444 394 220 394 520"
TIMES_ITALIC = "250 333 420 500 500 833 778 214 333 333 500 675 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 675 675 675 500 920 611 611 667 722 611 611 722 722 333 444 667 556 833 667 722 611 722 611 500 556 722 611 833 611 556 556 389 278 389 422 500 333 500 500 444 500 444 278 500 500 278 278 444 278 722 500 500 500 500 389 389 278 500 444 667 444 444 389 400 275 400 541"
TIMES_BOLD_ITALIC = "250 389 555 500 500 833 778 278 333 333 500 570 250 333 250 278 500 500 500 500 500 500 500 500 500 500 333 333 570 570 570 500 832 667 667 667 722 667 667 722 778 389 500 667 611 889 722 722 611 722 667 556 611 722 667 889 667 611 611 333 278 333 570 500 333 500 500 444 500 444 333 500 556 278 278 500 278 778 556 500 500 500 389 389 278 556 444 667 500 444 389 348 220 348 570"
# What the standard encoding has other than ASCII in its lower half, and glyph names that say no letter.
GLYPHS = {"space": " ", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "hyphen": "-", "period": ".", "comma": ",", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "quotedblleft": "“", "quotedblright": "”", "bullet": "•", "endash": "–", "emdash": "—", "Euro": "€", "colon": ":", "semicolon": ";", "exclam": "!", "question": "?", "parenleft": "(", "parenright": ")", "slash": "/", "germandbls": "ß", "adieresis": "ä", "odieresis": "ö", "udieresis": "ü", "eacute": "é", "egrave": "è", "agrave": "à", "ccedilla": "ç", "ntilde": "ñ", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", ".notdef": ""}


@cache
def core_widths(base: str) -> list[float] | None:
    """Advance widths of the codes 32 to 126 of a standard font, or null."""
    plain = re.sub(r"^[A-Z]{6}\+", "", base)
    if "Courier" in plain:
        return [600.0] * 95
    bold, slanted = "Bold" in plain, "Italic" in plain or "Oblique" in plain
    times = {(False, False): TIMES, (True, False): TIMES_BOLD, (False, True): TIMES_ITALIC, (True, True): TIMES_BOLD_ITALIC}
    table = (HELVETICA_BOLD if bold else HELVETICA) if plain.startswith(("Helvetica", "Arial")) else times[bold, slanted] if plain.startswith("Times") else None
    return [float(x) for x in table.split()] if table else None


def glyph_text(name: str) -> str:
    """Unicode of a glyph name: its part before a dot, each part between underlines."""
    out = ""
    for part in name.split(".")[0].split("_") if not name.startswith(".") else [name]:
        if part in GLYPHS:
            out += GLYPHS[part]
        elif len(part) == 1:
            out += part
        elif m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", part):
            out += bytes.fromhex(m[1]).decode("utf-16-be", "replace")
        elif m := re.fullmatch(r"u([0-9A-F]{4,6})", part):
            out += chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else "�"
        else:
            out += "�"
    return out


# Strings of whole bytes, one after another.
_HEXES = re.compile(rb"(?:[\0\t\n\x0c\r ]*<(?:[0-9A-Fa-f]{2})*>)+")


class CMap:
    """Codespaces and mappings; a later range wins, a single code before any range, an inherited map comes last."""

    def __init__(self):
        self.spaces: list[tuple[bytes, bytes]] = []
        self.text: dict[bytes, str] = {}
        self.text_ranges: list[tuple[bytes, bytes, object]] = []
        self.cids: dict[bytes, int] = {}
        self.cid_ranges: list[tuple[bytes, bytes, int]] = []
        self.vertical, self.name, self.base = False, "", None

    @classmethod
    def parse(cls, data: bytes) -> CMap:
        own, lexer, stack = cls(), Lexer(data), []
        while True:
            if m := _HEXES.match(data, lexer.at):
                stack += map(bytes.fromhex, m[0].decode().replace("\0", " ").replace("<", " ").split(">")[:-1])
                lexer.at = m.end()
            try:
                got = lexer.read()
            except PdfError:
                return own
            if not isinstance(got, Keyword):
                stack.append(got)
                continue
            if got == b"endcodespacerange":
                own.spaces += [(a, b) for a, b in zip(stack[::2], stack[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)]
            elif got == b"endbfchar":
                own.text |= {a: own.decoded(b) for a, b in zip(stack[::2], stack[1::2]) if isinstance(a, bytes)}
            elif got == b"endbfrange":
                own.text_ranges += [x for x in zip(stack[::3], stack[1::3], stack[2::3]) if isinstance(x[0], bytes)]
            elif got == b"endcidchar":
                own.cids |= {a: b for a, b in zip(stack[::2], stack[1::2]) if isinstance(a, bytes)}
            elif got == b"endcidrange":
                own.cid_ranges += [x for x in zip(stack[::3], stack[1::3], stack[2::3]) if isinstance(x[0], bytes)]
            elif got == b"def" and len(stack) >= 2 and stack[-2] == "WMode":
                own.vertical = stack[-1] == 1
            elif got == b"def" and len(stack) >= 2 and stack[-2] == "CMapName":
                own.name = str(stack[-1])
            stack = []

    @staticmethod
    def decoded(value) -> str:
        return value.decode("utf-16-be", "replace") if isinstance(value, bytes) else glyph_text(value) if isinstance(value, Name) else ""

    def next_code(self, data: bytes, at: int) -> bytes:
        if self.spaces == [(b"\0\0", b"\xff\xff")]:
            return data[at : at + 2]
        for n in (1, 2, 3, 4):
            code = data[at : at + n]
            if any(len(a) == n and len(code) == n and all(x <= c <= y for x, c, y in zip(a, code, b)) for a, b in self.spaces):
                return code
        return data[at : at + (2 if not self.spaces else len(self.spaces[0][0]))]

    def unicode(self, code: bytes) -> str | None:
        if code in self.text:
            return self.text[code]
        for low, high, to in reversed(self.text_ranges):
            if len(low) == len(code) and low <= code <= high:
                step = int.from_bytes(code, "big") - int.from_bytes(low, "big")
                if isinstance(to, list):
                    return self.decoded(to[step]) if step < len(to) else None
                if isinstance(to, bytes) and to:
                    return (to[:-2] + ((int.from_bytes(to[-2:], "big") + step) & 0xFFFF).to_bytes(2, "big")).decode("utf-16-be", "replace")
        return None

    def cid(self, code: bytes) -> int:
        if code in self.cids:
            return self.cids[code]
        for low, high, to in reversed(self.cid_ranges):
            if len(low) == len(code) and low <= code <= high:
                return to + int.from_bytes(code, "big") - int.from_bytes(low, "big")
        return int.from_bytes(code, "big") if not self.cid_ranges and not self.cids else 0


class Font:
    """One font resource; `glyphs(data)` gives (text, advance over 1000, vertical advance, is a space) of each code."""

    def __init__(self, objects, spec: dict | None, limit: int):
        get = lambda holder, k, kind=None: objects.get(holder, k, kind)
        spec = spec or {"Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}
        self.subtype, self.base = str(get(spec, "Subtype") or ""), str(get(spec, "BaseFont") or get(spec, "Name") or "")
        self.is_subset = bool(re.match(r"[A-Z]{6}\+.", self.base))
        self.composite, self.vertical, self.scale = self.subtype == "Type0", False, 0.001
        self.seen: dict = {}
        # of the codes under 256 that were met: the bytes, texts, advances, the texts as a decoding table if each is one character, sums of n equal advances
        self.known, self.texts, self.advances, self.table, self.sums = b"", [""] * 256, [0.0] * 256, "\ufffe" * 256, {}
        unicode = get(spec, "ToUnicode", Stream)
        self.to_unicode = CMap.parse(decode(unicode, objects, limit)) if unicode else None
        encoding = get(spec, "Encoding")
        self.encoding = str(encoding) if isinstance(encoding, Name) else ""
        down = get(spec, "DescendantFonts", list) or []
        self.inner = objects.resolve(down[0]) if down else {}
        self.inner = self.inner if isinstance(self.inner, dict) else {}
        described = get(self.inner if self.composite else spec, "FontDescriptor", dict) or {}
        metric = lambda k, other: other if (got := get(described, k, float)) is None else got / 1000
        self.ascent, self.descent = metric("Ascent", 0.8), metric("Descent", -0.2)
        self.embedded = next((k for k in ("FontFile", "FontFile2", "FontFile3") if get(described, k, Stream)), None)
        if self.composite:
            self.map = CMap.parse(decode(encoding, objects, limit)) if isinstance(encoding, Stream) else CMap()
            if isinstance(encoding, Stream):
                self.encoding = self.map.name or str(get(encoding, "CMapName") or "")
            if not self.map.spaces:
                self.map.spaces = [(b"\0\0", b"\xff\xff")]
            self.vertical = self.map.vertical or self.encoding.endswith("-V")
            self.default = get(self.inner, "DW", float)
            self.default = 1000.0 if self.default is None else self.default
            self.widths = self._ranges(objects, get(self.inner, "W", list) or [], 1)
            self.upright = self._ranges(objects, get(self.inner, "W2", list) or [], 3)
            both = get(self.inner, "DW2", list) or [880, -1000]
            self.default_upright = float(objects.resolve(both[1])) if len(both) > 1 else -1000.0
            return
        base = str(get(encoding, "BaseEncoding") or "") if isinstance(encoding, dict) else self.encoding
        codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        self.chars = {i: bytes([i]).decode(codec, "replace") for i in range(32, 256)}
        if isinstance(encoding, dict):
            at = 0
            for x in get(encoding, "Differences", list) or []:
                x = objects.resolve(x)
                if type(x) is int:
                    at = x
                elif isinstance(x, Name):
                    self.chars[at] = glyph_text(x)
                    at += 1
        first = get(spec, "FirstChar", int) or 0
        found = [objects.resolve(x) for x in get(spec, "Widths", list) or []]
        self.widths = {first + i: float(w) for i, w in enumerate(found) if type(w) in (int, float)}
        core = core_widths(self.base) if not self.widths else None
        if core:
            self.widths = {32 + i: w for i, w in enumerate(core)}
        missing = get(described, "MissingWidth", float)
        self.default = (600.0 if "Courier" in self.base else 500.0) if missing is None else missing
        if self.subtype == "Type3":
            matrix = [objects.resolve(x) for x in get(spec, "FontMatrix", list) or []]
            self.scale = float(matrix[0]) if matrix else 0.001

    @staticmethod
    def _ranges(objects, items: list, each: int) -> list[tuple[int, int, list[float]]]:
        """(first, last, numbers) of /W and /W2; the first that holds a CID counts."""
        items, out, i = [objects.resolve(x) for x in items], [], 0
        while i + 1 < len(items):
            if isinstance(items[i + 1], list):
                own = [float(objects.resolve(x)) for x in items[i + 1]]
                out += [(items[i] + k, items[i] + k, own[k * each : k * each + each]) for k in range(len(own) // each)]
                i += 2
            else:
                out.append((items[i], items[i + 1], [float(x) for x in items[i + 2 : i + 2 + each]]))
                i += 2 + each
        return out

    def glyphs(self, data: bytes) -> list[tuple[str, float, float, bool]]:
        out = []
        if not self.composite:
            for c in data:
                if c in self.seen:
                    out.append(self.seen[c])
                    continue
                text = (self.to_unicode.unicode(bytes([c])) if self.to_unicode else None) or self.chars.get(c, "�")
                out.append((text, self.widths.get(c, self.default) * self.scale, 0.0, c == 32))
                self.seen[c] = out[-1]
            return out
        at = 0
        while at < len(data):
            code = self.map.next_code(data, at)
            at += max(1, len(code))
            if code in self.seen:
                out.append(self.seen[code])
                continue
            cid = self.map.cid(code)
            text = self.to_unicode.unicode(code) if self.to_unicode else None
            width = next((v[0] for a, b, v in self.widths if a <= cid <= b and v), self.default)
            tall = next((v[0] for a, b, v in self.upright if a <= cid <= b and v), self.default_upright)
            out.append((text if text is not None else "�", width * 0.001, tall * 0.001, code == b" "))
            self.seen[code] = out[-1]
        return out

    def measure(self, data: bytes) -> tuple[str, int, float, int]:
        """Text, number of codes, sum of advances (vertical ones of a vertical font) and number of spaces of a shown string."""
        if not self.composite:
            low = data
        elif len(data) % 2 == 0 and self.map.spaces == [(b"\0\0", b"\xff\xff")] and data[::2] == bytes(len(data) // 2):
            low = data[1::2]
        else:
            glyphs = self.glyphs(data)
            return "".join([g[0] for g in glyphs]), len(glyphs), sum([g[2 if self.vertical else 1] for g in glyphs]), sum([g[3] for g in glyphs])
        if more := set(low.translate(None, self.known)):
            if not self.known and self.composite and self.to_unicode:
                more |= {c[1] for c in self.to_unicode.text if len(c) == 2 and c[0] == 0}
            more = bytes(more)
            for c, (text, across, down, _) in zip(more, self.glyphs(b"".join([b"\0%c" % c for c in more]) if self.composite else more)):
                self.texts[c], self.advances[c] = text, down if self.vertical else across
            self.known += more
            met = [self.texts[c] for c in self.known]
            self.table = "".join([x or "\ufffe" for x in self.texts]) if all(len(x) == 1 and x != "\ufffe" for x in met) else ""
            self.sums = {} if len({self.advances[c] for c in self.known}) == 1 else None
        text = charmap_decode(low, "strict", self.table)[0] if self.table else "".join([self.texts[c] for c in low])
        n = len(low)
        if self.sums is None:
            advance = sum([self.advances[c] for c in low])
        elif n in self.sums:
            advance = self.sums[n]
        else:
            advance = self.sums[n] = sum([self.advances[c] for c in low])
        return text, n, advance, 0 if self.composite else data.count(b" ")
