"""A deterministic writer of small PDF files, for queries and tests. It shares no code with the reader."""

from __future__ import annotations

import base64
import hashlib
import zlib

PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")
LINES, WORDS = 40, 8


def literal(text: str) -> bytes:
    """A UTF-16 text string in hex."""
    return b"<feff" + text.encode("utf-16-be").hex().encode() + b">"


def _rc4(data: bytes, key: bytes) -> bytes:
    box = list(range(256))
    j = 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) % 256
        box[i], box[j] = box[j], box[i]
    out, a, b = [], 0, 0
    for byte in data:
        a = (a + 1) % 256
        b = (b + box[a]) % 256
        box[a], box[b] = box[b], box[a]
        out.append(byte ^ box[(box[a] + box[b]) % 256])
    return bytes(out)


def encoded(data: bytes, name: str) -> tuple[bytes, bytes]:
    """Data under a filter, and the dictionary entries that say so."""
    if name == "Flate":
        return zlib.compress(data, 6), b"/Filter /FlateDecode"
    if name == "Hex":
        return data.hex().encode() + b">", b"/Filter /ASCIIHexDecode"
    if name == "A85":
        return base64.a85encode(data) + b"~>", b"/Filter [/ASCII85Decode]"
    if name == "RunLength":
        return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x80", b"/Filter /RL"
    if name == "FlatePng":
        row = 16
        padded = data + b" " * (-len(data) % row)
        lines = [padded[i : i + row] for i in range(0, len(padded), row)]
        up = b"".join(b"\x02" + bytes((x - y) % 256 for x, y in zip(line, above)) for line, above in zip(lines, [bytes(row), *lines]))
        return zlib.compress(up), b"/Filter [/ASCIIHexDecode /FlateDecode] /DecodeParms [null << /Predictor 12 /Columns 16 >>]"
    return data, b""


class Writer:
    """Collects numbered objects and writes a file with a classic cross-reference table."""

    def __init__(self, revision: int = 0, user: bytes = b"", owner: bytes = b"owner", permissions: int = -4):
        self.objects: list[bytes | None] = []
        self.revision, self.key, self.extra = revision, b"", b""
        self.id = hashlib.md5(b"quire").digest()
        if revision:
            n = 5 if revision == 2 else 16
            key = hashlib.md5((owner + PAD)[:32]).digest()
            for _ in range(50 if revision == 3 else 0):
                key = hashlib.md5(key[:n]).digest()
            o = (user + PAD)[:32]
            for i in range(20 if revision == 3 else 1):
                o = _rc4(o, bytes(x ^ i for x in key[:n]))
            own = hashlib.md5((user + PAD)[:32] + o + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + self.id).digest()
            for _ in range(50 if revision == 3 else 0):
                own = hashlib.md5(own[:n]).digest()
            self.key = own[:n]
            if revision == 2:
                u = _rc4(PAD, self.key)
            else:
                u = hashlib.md5(PAD + self.id).digest()
                for i in range(20):
                    u = _rc4(u, bytes(x ^ i for x in self.key))
                u += bytes(16)
            self.extra = b"<< /Filter /Standard /V %d /R %d /Length %d /P %d /O <%s> /U <%s> >>" % (revision - 1, revision, n * 8, permissions, o.hex().encode(), u.hex().encode())

    def _secret(self, number: int, data: bytes) -> bytes:
        if not self.key:
            return data
        return _rc4(data, hashlib.md5(self.key + number.to_bytes(3, "little") + b"\0\0").digest()[: min(16, len(self.key) + 5)])

    def reserve(self) -> int:
        self.objects.append(None)
        return len(self.objects)

    def put(self, body: bytes, number: int | None = None) -> int:
        number = number or self.reserve()
        self.objects[number - 1] = body
        return number

    def text(self, number: int, value: str) -> bytes:
        return b"<" + self._secret(number, b"\xfe\xff" + value.encode("utf-16-be")).hex().encode() + b">"

    def stream(self, data: bytes, head: bytes = b"", name: str = "Flate") -> int:
        number = self.reserve()
        data, how = encoded(data, name)
        if name == "FlatePng":
            data = data.hex().encode() + b">"
        data = self._secret(number, data)
        return self.put(b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(data), how, head, data), number)

    def finish(self, root: int, info: int | None = None, broken: bool = False, lead: bytes = b"") -> bytes:
        out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), []
        for i, body in enumerate(self.objects, 1):
            at.append(len(out))
            out += b"%d 0 obj\n%s\nendobj\n" % (i, body or b"null")
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(at) + 1) + b"".join(b"%010d 00000 n \n" % x for x in at)
        more = b" /Info %d 0 R" % info if info else b""
        if self.extra:
            more += b" /Encrypt %s /ID [<%s> <%s>]" % (self.extra, self.id.hex().encode(), self.id.hex().encode())
        out += b"trailer\n<< /Size %d /Root %d 0 R%s >>\nstartxref\n%d\n%%%%EOF\n" % (len(at) + 1, root, more, 7 if broken else start)
        return lead + bytes(out)


def lines_of(text: str) -> list[str]:
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    return [" ".join(words[i : i + WORDS]) for i in range(0, len(words), WORDS)]


def pages_of(text: str) -> list[list[str]]:
    """Lines of eight words, forty to a page; one empty page for a text without words."""
    lines = lines_of(text)
    return [lines[i : i + LINES] for i in range(0, len(lines), LINES)] or [[]]


def unicode_font(w: Writer, chars: list[str]) -> tuple[int, dict[str, int]]:
    """A composite font whose codes are numbers of the characters."""
    codes = {c: i + 1 for i, c in enumerate(chars)}
    items = [b"<%04x> <%s>" % (i, c.encode("utf-16-be").hex().encode()) for c, i in codes.items()]
    blocks = b"\n".join(b"%d beginbfchar\n%s\nendbfchar" % (len(items[i : i + 100]), b"\n".join(items[i : i + 100])) for i in range(0, len(items), 100))
    unicode = w.stream(b"/CIDInit /ProcSet findresource begin\n1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n" + blocks + b"\nend")
    inner = w.put(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /QUIREA+Made /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 >>")
    return w.put(b"<< /Type /Font /Subtype /Type0 /BaseFont /QUIREA+Made /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (inner, unicode)), codes


def text_pdf(text: str, info: dict[str, str] | None = None, attachments: list[tuple[str, bytes, str]] = (), labels: bytes = b"", outline: list[tuple[str, int | None, int]] = (), fields: list[tuple[str, str]] = (), links: list[str] = (), layers: list[tuple[str, bool, str]] = (), revision: int = 0, user: bytes = b"", broken: bool = False, lead: bytes = b"", compress: str = "Flate", notes: list[bytes] = (), radio: list[list[int]] = ()) -> bytes:
    """A file with a text on pages, and what else is asked for.

    outline: (title, parent's place in the list or None, page). layers: (name, on, text),
    each a marked-content section of the first page. fields: (name, value). links: URIs on
    the first page. notes: bodies of more annotations there. radio: groups of places of layers.
    """
    w = Writer(revision, user)
    root, tree = w.reserve(), w.reserve()
    pages = pages_of(text)
    font, codes = unicode_font(w, sorted(set().union(*(x for p in pages for x in p), *(t for _, _, t in layers))))
    table = {ord(c): chr(i) for c, i in codes.items()}
    plain = len(codes) < 0xD800  # beyond, a code is no character
    shown = lambda s: (s.translate(table).encode("utf-16-be").hex() if plain else "".join(f"{codes[c]:04x}" for c in s)).encode()
    groups = [w.put(b"<< /Type /OCG /Name %s >>" % literal(name)) for name, _, _ in layers]
    notes = [w.put(b"<< /Type /Annot %s >>" % x) for x in notes] + [w.put(b"<< /Type /Annot /Subtype /Link /Rect [10 %d 100 %d] /F %d /A << /S /URI /URI %s >> >>" % (700 - 12 * i, 710 - 12 * i, 4 if i % 2 else 2, b"<" + u.encode("utf-16-be").hex().encode().join((b"feff", b"")) + b">")) for i, u in enumerate(links)]
    kids = [w.reserve() for _ in pages]
    for k, (number, lines) in enumerate(zip(kids, pages)):
        body = [b"BT /F0 10 Tf 1 0 0 1 36 %d Tm <%s> Tj ET" % (760 - 18 * i, shown(x)) for i, x in enumerate(lines)]
        if k == 0:
            body += [b"/OC /L%d BDC BT /F0 10 Tf 1 0 0 1 36 %d Tm <%s> Tj ET EMC" % (i, 20 - 2 * i, shown(t)) for i, (_, _, t) in enumerate(layers)]
            body += [b"0.5 g 10 10 %d 5 re f" % (i + 1) for i in range(len(links))]
        content = w.stream(b"\n".join(body), name=compress)
        properties = b"/Properties << " + b" ".join(b"/L%d %d 0 R" % x for x in enumerate(groups)) + b" >>"
        w.put(b"<< /Type /Page /Parent %d 0 R /Contents %d 0 R /Resources << /Font << /F0 %d 0 R >> %s >> %s >>" % (tree, content, font, properties, b"/Annots [" + b" ".join(b"%d 0 R" % n for n in notes) + b"]" if k == 0 and notes else b""), number)
    w.put(b"<< /Type /Pages /Kids [%s] /Count %d /MediaBox [0 0 612 792] >>" % (b" ".join(b"%d 0 R" % x for x in kids), len(kids)), tree)
    more = b""
    if labels:
        more += b" /PageLabels << /Nums [%s] >>" % labels
    if attachments:
        files = []
        for name, data, how in attachments:
            held = w.stream(data, b"/Type /EmbeddedFile /Subtype /text#2Fplain /Params << /Size %d >>" % len(data), how)
            spec = w.reserve()
            w.put(b"<< /Type /Filespec /F %s /EF << /F %d 0 R >> >>" % (w.text(spec, name), held), spec)
            files.append(b"(%s) %d 0 R" % (name.encode("ascii", "replace"), spec) if not revision else b"<> %d 0 R" % spec)
        more += b" /Names << /EmbeddedFiles << /Names [%s] >> >>" % b" ".join(files)
    if outline:
        top, items = w.reserve(), [w.reserve() for _ in outline]
        below: dict[int | None, list[int]] = {}
        for i, (_, parent, _) in enumerate(outline):
            below.setdefault(parent, []).append(i)
        for i, (title, parent, page) in enumerate(outline):
            own, at = below[parent], below[parent].index(i)
            body = b"/Title %s /Parent %d 0 R /Dest [%d 0 R /XYZ 0 700 1.25]" % (literal(title), top if parent is None else items[parent], kids[page])
            body += b" /Prev %d 0 R" % items[own[at - 1]] if at else b""
            body += b" /Next %d 0 R" % items[own[at + 1]] if at + 1 < len(own) else b""
            body += b" /First %d 0 R /Last %d 0 R /Count %d" % (items[below[i][0]], items[below[i][-1]], len(below[i])) if i in below else b""
            w.put(b"<< %s >>" % body, items[i])
        w.put(b"<< /Type /Outlines /First %d 0 R /Last %d 0 R >>" % (items[below[None][0]], items[below[None][-1]]), top)
        more += b" /Outlines %d 0 R" % top
    if fields:
        group, leaves = w.reserve(), []
        for name, value in fields:
            leaves.append(w.put(b"<< /T %s /V %s /Parent %d 0 R >>" % (literal(name), literal(value), group)))
        w.put(b"<< /T %s /FT /Tx /DA (/F0 9 Tf) /Kids [%s] >>" % (literal("form"), b" ".join(b"%d 0 R" % x for x in leaves)), group)
        more += b" /AcroForm << /Fields [%d 0 R] >>" % group
    if layers:
        refs = lambda on: b" ".join(b"%d 0 R" % g for g, (_, x, _) in zip(groups, layers) if x == on)
        more += b" /OCProperties << /OCGs [%s] /D << /BaseState /ON /ON [%s] /OFF [%s] /RBGroups [%s] >> >>" % (b" ".join(b"%d 0 R" % g for g in groups), refs(True), refs(False), b" ".join(b"[%s]" % b" ".join(b"%d 0 R" % groups[i] for i in g) for g in radio))
    w.put(b"<< /Type /Catalog /Pages %d 0 R%s >>" % (tree, more), root)
    own = None
    if info:
        own = w.reserve()
        w.put(b"<< " + b" ".join(b"/%s %s" % (k.encode(), w.text(own, v)) for k, v in sorted(info.items())) + b" >>", own)
    return w.finish(root, own, broken, lead)
