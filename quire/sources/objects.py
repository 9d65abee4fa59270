"""PDF objects: lexer, cross-reference sections, object streams and repair."""

from __future__ import annotations

import re
from typing import NamedTuple


class PdfError(Exception):
    """kind: format, limit, unsupported or encrypted."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class Name(str):
    """A name object."""


class Ref(NamedTuple):
    obj: int
    gen: int


class Keyword(bytes):
    """An operator or another bare word."""


class Stream:
    def __init__(self, dict_: dict, data: bytes):
        self.dict, self.data = dict_, data


SPACE, DELIMITERS = b"\0\t\n\x0c\r ", b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]*")
_SKIP = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*")
_TOKEN = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*([^\0\t\n\x0c\r ()<>\[\]{}/%]*)")
_REFERENCE = re.compile(rb"[\0\t\n\x0c\r ]*(\d{1,15})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+R(?![^\0\t\n\x0c\r ()<>\[\]{}/%])")
_REST = re.compile(rb"[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+R(?![^\0\t\n\x0c\r ()<>\[\]{}/%])")
_ENTRY = re.compile(rb"[\0\t\n\x0c\r ]*(\d{1,15})[\0\t\n\x0c\r ]+(\d{1,15})[\0\t\n\x0c\r ]+([nf])(?![^\0\t\n\x0c\r ()<>\[\]{}/%])")
_INTEGER, _REAL, _PARTS = re.compile(rb"[+-]*\d+"), re.compile(rb"[+-]*(?:\d+\.?\d*|\.\d+)(?:-\d*)?"), re.compile(rb"([+-]*)([\d.]+)")
_CODE = re.compile(rb"#([0-9A-Fa-f]{2})")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
#: Defaults of the limits; exceeding one is an error, never a cut.
LIMITS = {"file_bytes": 1 << 30, "depth": 128, "objects": 5_000_000, "decoded_bytes": 1 << 28, "pages": 1_000_000, "operations": 20_000_000, "outline_items": 100_000, "revisions": 1_024}


def _any_word(w: bytes):
    if _INTEGER.fullmatch(w):
        return int(w.lstrip(b"+-")) * (-1 if w.startswith(b"-") else 1)
    if _REAL.fullmatch(w):
        number = _PARTS.match(w)
        return float(number[2]) * (-1 if b"-" in number[1] else 1)
    return {b"true": True, b"false": False, b"null": None}.get(w, Keyword(w))


# Short words and names that were met, with their objects; emptied when full.
WORDS: dict[bytes, object] = {}
NAMES: dict[bytes, Name] = {}
HELD = 1 << 13


def _name(w: bytes) -> Name:
    if w in NAMES:
        return NAMES[w]
    own = Name((_CODE.sub(lambda m: bytes([int(m[1], 16)]), w) if b"#" in w else w).decode("latin-1"))
    if len(w) <= 32:
        if len(NAMES) >= HELD:
            NAMES.clear()
        NAMES[w] = own
    return own


class Lexer:
    """Reads objects from bytes; `length_of` resolves a stream's indirect length."""

    def __init__(self, data: bytes, at: int = 0, length_of=None, depth: int = LIMITS["depth"]):
        self.data, self.at, self.length_of, self.depth = data, at, length_of, depth

    def skip(self) -> None:
        self.at = _SKIP.match(self.data, self.at).end()

    def peek(self) -> int:
        return self.data[self.at] if self.at < len(self.data) else -1

    def word(self) -> bytes:
        m = _REGULAR.match(self.data, self.at)
        self.at = m.end()
        return m[0]

    def read(self, depth: int = 0):
        """The next object, or a Keyword; raises PdfError at the end."""
        if depth > self.depth:
            raise PdfError("limit", "objects are nested too deeply")
        m = _TOKEN.match(self.data, self.at)
        self.at = m.end()
        if word := m[1]:
            return self._word(word)
        c = self.peek()
        if c < 0:
            raise PdfError("format", "unexpected end")
        if c == 0x2F:
            self.at += 1
            return _name(self.word())
        if c == 0x28:
            return self._literal()
        if c == 0x3C:
            return self._dictionary(depth) if self.data[self.at + 1 : self.at + 2] == b"<" else self._hex()
        if c == 0x5B:
            self.at += 1
            out = []
            while True:
                self.skip()
                if self.peek() == 0x5D:
                    self.at += 1
                    return out
                out.append(self._item(depth + 1))
                if isinstance(out[-1], Keyword):
                    raise PdfError("format", "bare word in an array")
        if c in b")]>{}":
            if c in b"{}":
                self.at += 1
                return Keyword(bytes([c]))
            raise PdfError("format", "unexpected delimiter")
        raise AssertionError(c)

    @staticmethod
    def _word(w: bytes):
        if w in WORDS:
            return WORDS[w]
        own = _any_word(w)
        if len(w) <= 32:
            if len(WORDS) >= HELD:
                WORDS.clear()
            WORDS[w] = own
        return own

    def _item(self, depth: int):
        """An object, or a reference made of two integers and R."""
        if depth <= self.depth and (m := _REFERENCE.match(self.data, self.at)):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        got = self.read(depth)
        if type(got) is int and got >= 0:
            m = _REST.match(self.data, self.at)
            if m:
                self.at = m.end()
                return Ref(got, int(m[1]))
        return got

    def _literal(self) -> bytes:
        out, level, i, data = bytearray(), 1, self.at + 1, self.data
        while level:
            if i >= len(data):
                raise PdfError("format", "unterminated string")
            c = data[i]
            i += 1
            if c == 0x5C:
                if i >= len(data):
                    break
                c = data[i]
                i += 1
                if c in _ESCAPES:
                    out.append(_ESCAPES[c])
                elif 48 <= c <= 55:
                    m = re.compile(rb"[0-7]{1,3}").match(data, i - 1)
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                elif c == 13:
                    i += data[i : i + 1] == b"\n"
                elif c != 10:
                    out.append(c)
                continue
            if c == 13:
                i += data[i : i + 1] == b"\n"
                c = 10
            level += (c == 0x28) - (c == 0x29)
            if level:
                out.append(c)
        self.at = i
        return bytes(out)

    def _hex(self) -> bytes:
        end = self.data.find(b">", self.at)
        if end < 0:
            raise PdfError("format", "unterminated hex string")
        digits = self.data[self.at + 1 : end]
        self.at = end + 1
        try:
            return bytes.fromhex(digits.decode())
        except ValueError:
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", digits)
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def _dictionary(self, depth: int):
        self.at += 2
        out: dict = {}
        while True:
            self.skip()
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                break
            key = self.read(depth + 1)
            if not isinstance(key, Name):
                raise PdfError("format", "dictionary key is no name")
            value = self._item(depth + 1)
            if isinstance(value, Keyword):
                raise PdfError("format", "bare word in a dictionary")
            out[str(key)] = value
        return out

    def object(self):
        """An object at top level: references and streams too."""
        got = self._item(0)
        if isinstance(got, dict):
            at = self.at
            self.skip()
            if self.data[self.at : self.at + 6] == b"stream":
                return self._stream(got)
            self.at = at
        return got

    def _stream(self, head: dict) -> Stream:
        start = self.at + 6
        start += 2 if self.data[start : start + 2] == b"\r\n" else self.data[start : start + 1] in (b"\n", b"\r")
        length = head.get("Length")
        if isinstance(length, Ref):
            length = self.length_of(length) if self.length_of else None
        if type(length) is int and 0 <= length and start + length <= len(self.data) and re.match(rb"\s*endstream", self.data[start + length : start + length + 20]):
            self.at = start + length
            return Stream(head, self.data[start : start + length])
        end = self.data.find(b"endstream", start)
        if end < 0:
            raise PdfError("format", "stream without an end")
        self.at = end
        cut = end
        if self.data[cut - 2 : cut] == b"\r\n":
            cut -= 2
        elif self.data[cut - 1 : cut] in (b"\n", b"\r"):
            cut -= 1
        return Stream(head, self.data[start:cut])


class Entry(NamedTuple):
    """kind f, n (offset, generation) or c (object stream, index)."""

    kind: str
    a: int
    b: int


class Objects:
    """The objects of one file. Problems that were repaired are in `diagnostics`."""

    decode = None  # set by filters, which needs this module

    def __init__(self, data: bytes, repair: bool = True, limits: dict | None = None):
        self.limits = LIMITS | (limits or {})
        if len(data) > self.limits["file_bytes"]:
            raise PdfError("limit", "the file is too large")
        self.diagnostics: list[tuple[str, str, str, int | None]] = []
        head = data[:1024].find(b"%PDF-")
        if head < 0:
            raise PdfError("format", "no PDF header")
        if head:
            self.note("header.prefix", f"{head} bytes before the header", 0)
        self.data = data[head:]
        self.version = re.match(rb"%PDF-(\d+\.\d+)?", self.data)[1] or b""
        if b"%%EOF" not in self.data[-4096:]:
            self.note("eof.missing", "no end-of-file mark", len(self.data))
        self.entries: dict[int, Entry] = {}
        self.trailer: dict = {}
        self.repaired = False
        self.decrypt = None
        self.cache: dict[int, object] = {}
        self.busy: set[int] = set()
        self.members: dict[int, dict[int, object]] = {}
        self.sections: list[tuple[int, int]] = []  # (object, section) as read, newest section first
        try:
            self._chain()
            if not isinstance(self.resolve(self.trailer.get("Root")), dict):
                raise PdfError("format", "no catalog")
        except (PdfError, ValueError, IndexError, RecursionError) as e:
            if not repair or isinstance(e, PdfError) and e.kind == "limit":
                raise
            self._repair(str(e))

    def note(self, code: str, message: str, at: int | None = None, severity: str = "warning") -> None:
        if all(x[1] != code for x in self.diagnostics):
            self.diagnostics.append((severity, code, message, at))

    def _chain(self) -> None:
        tail = self.data[-(1 << 20) :]
        last = tail.rfind(b"startxref")
        if last < 0:
            raise PdfError("format", "no startxref")
        m = re.match(rb"startxref\s+(\d+)", tail[last : last + 64])
        if not m:
            raise PdfError("format", "startxref without a number")
        todo, seen = [int(m[1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                if at in seen:
                    continue
                raise PdfError("format", "cross-reference offset outside the file")
            seen.add(at)
            if len(seen) > self.limits["revisions"]:
                raise PdfError("limit", "too many revisions")
            trailer = self._section(at, len(seen) - 1)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            todo = [x for x in (trailer.get("XRefStm"), trailer.get("Prev")) if type(x) is int] + todo

    def _add(self, number: int, entry: Entry, section: int) -> None:
        self.sections.append((number, section))
        self.entries.setdefault(number, entry)
        if len(self.entries) > self.limits["objects"]:
            raise PdfError("limit", "too many objects")

    def _section(self, at: int, nth: int) -> dict:
        lexer = Lexer(self.data, at)
        lexer.skip()
        if self.data[lexer.at : lexer.at + 4] == b"xref":
            lexer.at += 4
            while True:
                lexer.skip()
                if self.data[lexer.at : lexer.at + 7] == b"trailer":
                    lexer.at += 7
                    got = lexer.read()
                    if not isinstance(got, dict):
                        raise PdfError("format", "trailer is no dictionary")
                    return got
                first, count = lexer.read(), lexer.read()
                if type(first) is not int or type(count) is not int:
                    raise PdfError("format", "bad cross-reference subsection")
                for i in range(count):
                    if m := _ENTRY.match(lexer.data, lexer.at):
                        lexer.at, a, b, kind = m.end(), int(m[1]), int(m[2]), m[3]
                    else:
                        a, b, kind = lexer.read(), lexer.read(), lexer.read()
                    if kind not in (b"n", b"f"):
                        raise PdfError("format", "bad cross-reference entry")
                    self._add(first + i, Entry(kind.decode(), a, b), nth)
        if not re.match(rb"\d+\s+\d+\s+obj", self.data[lexer.at : lexer.at + 40]):
            raise PdfError("format", "no cross-reference section")
        lexer.read(), lexer.read(), lexer.read()
        stream = lexer.object()
        if not isinstance(stream, Stream):
            raise PdfError("format", "cross-reference stream expected")
        self._packed(stream, nth)
        return stream.dict

    def _packed(self, stream: Stream, nth: int) -> None:
        w = stream.dict.get("W")
        if not isinstance(w, list) or len(w) < 3 or not all(type(x) is int and 0 <= x <= 8 for x in w):
            raise PdfError("format", "bad /W")
        raw = self.decode(stream, None, self.limits["decoded_bytes"])
        index = stream.dict.get("Index") or [0, stream.dict.get("Size", 0)]
        at, size = 0, sum(w[:3])
        for first, count in zip(index[::2], index[1::2]):
            for number in range(first, first + count):
                if at + size > len(raw):
                    return
                cut = [raw[at + sum(w[:i]) : at + sum(w[: i + 1])] for i in range(3)]
                at += size
                kind = int.from_bytes(cut[0], "big") if w[0] else 1
                a, b = int.from_bytes(cut[1], "big"), int.from_bytes(cut[2], "big")
                if kind in (0, 1, 2):
                    self._add(number, Entry("fnc"[kind], a, b), nth)

    def _repair(self, why: str) -> None:
        """Finds objects by scanning; the last of a number wins."""
        self.note("xref.repair", why)
        self.repaired = True
        self.entries, self.cache, self.members, trailers = {}, {}, {}, [self.trailer]
        for m in re.finditer(rb"(?<![0-9])(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+obj(?![a-zA-Z])", self.data):
            self.entries[int(m[1])] = Entry("n", m.start(), int(m[2]))
        for m in re.finditer(rb"trailer", self.data):
            try:
                got = Lexer(self.data, m.end()).read()
                if isinstance(got, dict):
                    trailers.append(got)
            except PdfError:
                continue
        packed = []
        for number, entry in sorted(self.entries.items(), key=lambda x: x[1].a):
            try:
                got = self.resolve(Ref(number, entry.b))
            except PdfError:
                continue
            if isinstance(got, Stream) and got.dict.get("Type") == "XRef":
                trailers.append(got.dict)
            if isinstance(got, Stream) and got.dict.get("Type") == "ObjStm":
                packed.append(number)
        for number in packed:
            try:
                for i, member in enumerate(self._unpack(number)):
                    if member not in self.entries:
                        self.entries[member] = Entry("c", number, i)
            except PdfError:
                continue
        self.trailer = {}
        for t in trailers:
            self.trailer.update(t)
        if not isinstance(self.resolve(self.trailer.get("Root")), dict):
            for number, entry in list(self.entries.items()):
                try:
                    got = self.resolve(Ref(number, 0 if entry.kind == "c" else entry.b))
                except PdfError:
                    continue
                if isinstance(got, dict) and got.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(number, 0 if entry.kind == "c" else entry.b)
                    self.note("catalog.recovered", "catalog found by scanning")
                    return
            raise PdfError("format", "no catalog")

    def _length(self, ref: Ref) -> int | None:
        try:
            got = self.resolve(ref)
        except PdfError:
            return None
        return got if type(got) is int else None

    def _unpack(self, number: int) -> dict[int, object]:
        if number not in self.members:
            holder = self.resolve(Ref(number, self.entries[number].b if number in self.entries else 0))
            if not isinstance(holder, Stream):
                raise PdfError("format", "object stream expected")
            raw, n, first = self.decode(holder, self, self.limits["decoded_bytes"]), self.resolve(holder.dict.get("N")), self.resolve(holder.dict.get("First"))
            lexer, out = Lexer(raw), {}
            pairs = [(lexer.read(), lexer.read()) for _ in range(n)]
            for member, at in pairs:
                out[member] = Lexer(raw, first + at, depth=self.limits["depth"])._item(0)
            self.members[number] = out
        return self.members[number]

    def resolve(self, value, hops: int = 0):
        """What a reference leads to; null for what is free or missing."""
        while isinstance(value, Ref):
            if hops > 32 or value.obj in self.busy:
                raise PdfError("format", "circular reference")
            hops += 1
            entry = self.entries.get(value.obj)
            if entry is None or entry.kind == "f":
                return None
            if value.obj not in self.cache:
                self.busy.add(value.obj)
                try:
                    self.cache[value.obj] = self._load(value, entry)
                finally:
                    self.busy.discard(value.obj)
            if entry.kind == "n" and entry.b != value.gen:
                raise PdfError("format", f"generation of object {value.obj} differs")
            value = self.cache[value.obj]
        return value

    def _load(self, ref: Ref, entry: Entry):
        if entry.kind == "c":
            return self._unpack(entry.a).get(ref.obj)
        lexer = Lexer(self.data, entry.a, self._length, self.limits["depth"])
        number, gen, word = lexer.read(), lexer.read(), lexer.read()
        if number != ref.obj or word != b"obj" or gen != entry.b:
            raise PdfError("format", f"object {ref.obj} is not at its offset")
        got = lexer.object()
        return self.decrypt(got, ref) if self.decrypt else got

    def get(self, holder, key: str, kind=None):
        """holder[key], resolved; null if it is of another kind or not to be had."""
        if isinstance(holder, Stream):
            holder = holder.dict
        if not isinstance(holder, dict):
            return None
        got = self.resolve(holder.get(key))
        if kind is float:
            return float(got) if type(got) in (int, float) else None
        return got if kind is None or (type(got) is int if kind is int else isinstance(got, kind)) else None


def text(value) -> str:
    """A text string: UTF-16 by its mark, else Windows-1252 with Latin-1 where that has nothing."""
    if not isinstance(value, bytes):
        return str(value) if isinstance(value, Name) else ""
    if value[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return value[2:].decode("utf-16-be" if value[0] == 0xFE else "utf-16-le", "replace")
    return value.decode("cp1252", "replace")
