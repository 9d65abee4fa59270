import zlib

import pytest

from quire import synth
from quire.sources import crypto, filters
from quire.sources.document import Document
from quire.sources.fonts import CMap, glyph_text
from quire.sources.images import unpack
from quire.sources.objects import Lexer, Name, Objects, PdfError, Ref, Stream, text
from quire.sources.pdf import facets_of


def build(objects: dict[int, bytes], trailer: bytes = b"/Root 1 0 R", lead: bytes = b"", start: int | None = None) -> bytes:
    out, at = bytearray(b"%PDF-1.7\n"), {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    x, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size + b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 00000 f \n" for n in range(1, size))
    out += b"trailer\n<< /Size %d %s >>\nstartxref\n%d\n%%%%EOF\n" % (size, trailer, x if start is None else start)
    return lead + bytes(out)


def stream(data: bytes, head: bytes = b"") -> bytes:
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), head, data)


def one_page(content: bytes, font: bytes, more: dict[int, bytes] | None = None) -> bytes:
    return build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", 4: stream(content), 5: font, **(more or {})})


def runs(data: bytes) -> list[dict]:
    return Document(data).page(0).runs


def test_lexer():
    got = Lexer(rb"[1 -2.5 (a\(b\)\\\101\n\
c) <48 656> /A#42 true null 3 0 R << /K [ ] >>]").object()
    assert got == [1, -2.5, b"a(b)\\A\nc", bytes.fromhex("486560"), Name("AB"), True, None, Ref(3, 0), {"K": []}]
    with pytest.raises(PdfError):
        Lexer(b"[" * 500).object()


def test_text_strings():
    assert text(b"\xfe\xff\x00A\x20\xac") == "A€" and text(b"\xff\xfeA\x00") == "A" and text(b"\x80\xe9") == "€é"


def test_simple_page_with_base_font():
    r = runs(one_page(b"BT /F1 12 Tf 72 700 Td (A page of words) Tj ET", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"))
    assert [x["text"] for x in r] == ["A page of words"] and (r[0]["left"], r[0]["bottom"], r[0]["top"]) == (72, pytest.approx(697.6), pytest.approx(709.6))


@pytest.mark.parametrize(("base", "units"), [("Courier", 1800), ("Courier-Bold", 1800), ("Helvetica", 1999), ("Helvetica-Bold", 2111), ("Times-Roman", 2000), ("Times-Bold", 2111), ("Times-Italic", 1833), ("Times-BoldItalic", 1945)])
def test_base_font_widths(base, units):
    r = runs(one_page(b"BT /F1 48 Tf <696D57> Tj ET", b"<< /Type /Font /Subtype /Type1 /BaseFont /%s >>" % base.encode()))
    assert r[0]["right"] - r[0]["left"] == pytest.approx(units * 48 / 1000)


def test_differences_and_widths():
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Made /FirstChar 65 /Widths [250 500 600] /Encoding << /Differences [65 /fi /uni20AC /u1F600] >> >>"
    document = Document(one_page(b"BT /F1 10 Tf <414243> Tj ET", font))
    r = document.page(0).runs
    assert r[0]["text"] == "fi€\U0001f600" and r[0]["right"] == pytest.approx(13.5)
    assert document.facet_content({"fonts"})["fonts"][0]["is_subset"] and document.facet_content({"fonts"})["fonts"][0]["embedded"] is None


UNICODE = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0001> <0002> [<0041> <0062>] endbfrange 1 beginbfchar <0003> <0063> endbfchar"


@pytest.mark.parametrize(("encoding", "more", "rotation", "width", "height"), [(b"Identity-H", b"/W [1 [500 600] 3 3 700]", 0, 36, None), (b"Identity-V", b"/W2 [1 [-900 0 0 -1000 0 0] 3 3 -1100 0 0]", 270, None, 60)])
def test_composite_fonts(encoding, more, rotation, width, height):
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /Made /Encoding /%s /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>" % encoding
    r = runs(one_page(b"BT /F1 20 Tf 100 500 Td <000100020003> Tj ET", font, {6: b"<< /Type /Font /Subtype /CIDFontType2 %s >>" % more, 7: stream(UNICODE)}))
    assert r[0]["text"] == "Abc" and r[0]["rotation"] == rotation
    if width:
        assert r[0]["right"] - r[0]["left"] == pytest.approx(width)
    else:
        assert r[0]["top"] - r[0]["bottom"] == pytest.approx(height) and r[0]["vertical"]


def test_custom_cmap():
    cmap = b"/CMapName /Own-Map def 1 begincodespacerange <00> <ff> endcodespacerange 1 begincidrange <20> <22> 100 endcidrange"
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /Made /Encoding 8 0 R /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>"
    unicode = b"1 begincodespacerange <00> <ff> endcodespacerange 1 beginbfrange <20> <22> <0041> endbfrange"
    document = Document(one_page(b"BT /F1 20 Tf <202122> Tj ET", font, {6: b"<< /Subtype /CIDFontType2 /W [100 102 600] >>", 7: stream(unicode), 8: stream(cmap)}))
    r = document.page(0).runs
    assert r[0]["text"] == "ABC" and r[0]["right"] == pytest.approx(36) and document.facet_content({"fonts"})["fonts"][0]["encoding"] == "Own-Map"


def test_type3_matrix():
    font = b"<< /Type /Font /Subtype /Type3 /FontMatrix [0.01 0 0 0.01 0 0] /FirstChar 65 /Widths [50 60] /Encoding << /Differences [65 /A /B] >> >>"
    r = runs(one_page(b"BT /F1 20 Tf (AB) Tj ET", font))
    assert r[0]["text"] == "AB" and r[0]["right"] == pytest.approx(22)


def test_glyph_names_and_cmap_order():
    assert [glyph_text(x) for x in ("A.alt", "f_i", "uni00410042", "u1F600", "nosuchname")] == ["A", "fi", "AB", "\U0001f600", "�"]
    own = CMap.parse(b"begincidrange <00> <09> 5 <05> <06> 50 endcidrange begincidchar <06> 7 endcidchar")
    assert [own.cid(bytes([c])) for c in (1, 5, 6)] == [6, 50, 7]


def test_xref_stream_and_object_stream():
    members = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>")]
    index, body = b"", b""
    for n, x in members:
        index += b"%d %d " % (n, len(body))
        body += x + b" "
    out = bytearray(b"%PDF-1.5\n")
    at3 = len(out)
    out += b"3 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\n"
    at4 = len(out)
    packed = zlib.compress(index + body)
    out += b"4 0 obj\n<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(index), len(packed), packed)
    at5 = len(out)
    rows = b"".join(bytes([k]) + a.to_bytes(2, "big") + bytes([b]) for k, a, b in [(0, 0, 0), (2, 4, 0), (2, 4, 1), (1, at3, 0), (1, at4, 0), (1, at5, 0)])
    out += b"5 0 obj\n<< /Type /XRef /W [1 2 1] /Size 6 /Root 1 0 R /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (len(rows), rows, at5)
    document = Document(bytes(out))
    assert len(document.pages) == 1 and not document.objects.repaired
    broken = bytes(out).replace(b"startxref\n%d" % at5, b"startxref\n1")
    document = Document(broken)
    assert len(document.pages) == 1 and document.objects.repaired and document.objects.diagnostics[0][1] == "xref.repair"
    with pytest.raises(PdfError):
        Document(broken, repair=False)


def test_newest_revision_wins_and_cycles_end():
    first = build({1: b"<< /Type /Catalog /Pages 2 0 R /PageMode /UseOutlines >>", 2: b"<< /Type /Pages /Kids [] /Count 0 >>"})
    at = len(first)
    more = b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R /PageMode /FullScreen >>\nendobj\n"
    x = at + len(more)
    prev = first.rindex(b"xref\n0")
    whole = first + more + b"xref\n1 1\n%010d 00000 n \ntrailer\n<< /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, prev, x)
    objects = Objects(whole)
    assert objects.resolve(Ref(1, 0))["PageMode"] == "FullScreen" and not objects.repaired
    assert {n for n, section in objects.sections if section == 1} >= {1, 2}
    assert not Objects(whole.replace(b"/Prev %d" % prev, b"/Prev %d" % x)).repaired


def test_wrong_generation_is_refused():
    objects = Objects(build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< >>"}))
    with pytest.raises(PdfError):
        objects.resolve(Ref(2, 5))
    assert objects.resolve(Ref(9, 0)) is None


def test_filters():
    data = bytes(range(256)) * 9
    for name in ("Flate", "Hex", "A85", "RunLength"):
        raw, _ = synth.encoded(data, name)
        own = {"Flate": filters.flate, "Hex": filters.ascii_hex, "A85": filters.ascii85, "RunLength": filters.run_length}[name]
        assert own(raw, 1 << 20) == data
    with pytest.raises(PdfError, match="too large"):
        filters.flate(zlib.compress(bytes(10_000)), 100)
    assert filters.flate(zlib.compressobj(6, zlib.DEFLATED, -15).compress(b"") + zlib.compress(data)[2:-4], 1 << 20) == data
    # the example of the specification
    assert filters.lzw(bytes.fromhex("800b6050220c0c8501"), 100) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert filters.predict(bytes([1, 5, 1, 1, 2, 5, 1, 1, 4, 7, 0, 0]), {"Predictor": 15, "Columns": 3}) == bytes([5, 6, 7, 10, 7, 8, 17, 17, 17])
    assert filters.predict(bytes([1, 1, 1, 2, 2, 2]), {"Predictor": 2, "Columns": 3}) == bytes([1, 2, 3, 2, 4, 6])
    assert filters.predict(b"xyz", {"Predictor": 1}) == b"xyz"


def test_ciphers_by_published_vectors():
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypto.aes_cbc(plain, key, bytes(16), encrypt=True).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypto.aes_cbc(plain, bytes(range(32)), bytes(16), encrypt=True).hex() == "8ea2b7ca516745bfeafc49904b496089"
    for key in (bytes(range(16)), bytes(range(32))):
        assert crypto.aes_cbc(crypto.aes_cbc(plain * 3, key, plain, encrypt=True), key, plain) == plain * 3
    assert crypto.rc4(b"Plaintext", b"Key").hex() == "bbf316e8d940af0ad3"


def aes256_file(revision: int) -> bytes:
    """A file of revision 5 or 6 with an attachment, with the published key derivation."""
    import hashlib

    digest = crypto.hash_r6 if revision == 6 else lambda p, s, u=b"": hashlib.sha256(p + s + u).digest()
    key, zero = bytes(range(32)), bytes(16)
    u = digest(b"user", b"validate") + b"validate" + b"saltsalt"
    ue = crypto.aes_cbc(key, digest(b"user", b"saltsalt"), zero, encrypt=True)
    o = digest(b"owner", b"validatO", u) + b"validatO" + b"saltsalO"
    oe = crypto.aes_cbc(key, digest(b"owner", b"saltsalO", u), zero, encrypt=True)
    payload = b"some bytes to keep"
    padded = payload + bytes([16 - len(payload) % 16]) * (16 - len(payload) % 16)
    secret = bytes(range(16)) + crypto.aes_cbc(padded, key, bytes(range(16)), encrypt=True)
    name = b"notes.txt" + bytes([7]) * 7
    name = bytes(16) + crypto.aes_cbc(name, key, bytes(16), encrypt=True)
    spec = b"<< /Filter /Standard /V 5 /R %d /Length 256 /P -4 /U <%s> /UE <%s> /O <%s> /OE <%s> /CF << /StdCF << /CFM /AESV3 >> >> /StmF /StdCF /StrF /StdCF >>" % (revision, u.hex().encode(), ue.hex().encode(), o.hex().encode(), oe.hex().encode())
    return build({1: b"<< /Type /Catalog /Pages 2 0 R /Names << /EmbeddedFiles << /Names [<%s> 3 0 R] >> >> >>" % name.hex().encode(), 2: b"<< /Type /Pages /Kids [] /Count 0 >>", 3: b"<< /F <%s> /EF << /F 4 0 R >> >>" % name.hex().encode(), 4: stream(secret, b"/Type /EmbeddedFile"), 5: spec}, b"/Root 1 0 R /Encrypt 5 0 R /ID [<00> <00>]")


@pytest.mark.parametrize("revision", [5, 6])
def test_aes_256(revision):
    data = aes256_file(revision)
    for owner, user, is_owner in ((None, "user", False), ("owner", None, True)):
        document = Document(data, owner, user)
        assert not document.locked and document.security.owner is is_owner
        assert [(x["name"], x["data"]) for x in document.facet_attachments()] == [("notes.txt", b"some bytes to keep")]
    locked = Document(data, user_password="wrong")
    assert locked.locked and locked.pages == [] and locked.facet_encryption()[0]["revision"] == revision


def test_damaged_page_tree():
    data = build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 9 0 R 4 0 R 2 0 R] /Count 4 >>", 3: b"<< /Type /Page /Contents [5 0 R 6 0 R] >>", 4: b"<< /Type /Page >>", 5: stream(b"BT ET"), 6: stream(b"zz", b"/Filter /Nope")})
    found = facets_of(data, ["pages", "operators", "diagnostics"])
    assert [x["page"] for x in found["pages"]] == [0, 1]
    assert {x["code"] for x in found["diagnostics"]} >= {"page-tree.repaired", "page-tree.count-mismatch", "content.repaired"}
    assert facets_of(data, ["pages"], repair=False)["error"]["kind"] == "format"
    assert facets_of(data, ["pages"], limits={"pages": 1})["error"]["kind"] == "limit"
    assert facets_of(b"no file", ["pages"])["error"]["kind"] == "format"


def test_destinations_and_circles():
    data = build({1: b"<< /Type /Catalog /Pages 2 0 R /Dests << /legacy [3 0 R /Fit] /both [3 0 R /Fit] >> /Names << /Dests << /Names [(both) [3 0 R /FitH 180] (loop-a) (loop-b) (loop-b) (loop-a)] >> >> >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page >>"})
    document = Document(data)
    got = {x["name"]: (x["page"], x["kind"], x["top"]) for x in document.facet_destinations()}
    assert got == {"both": (0, "FitH", 180.0), "legacy": (0, "Fit", None), "loop-a": (None, None, None), "loop-b": (None, None, None)}
    assert any(x[1] == "destination.named.circular" for x in document.objects.diagnostics)


def test_forms_and_recursion():
    form = stream(b"/X Do 1 0 0 RG 0 0 m 1 1 l S BT (inside) Tj ET", b"/Subtype /Form /Group << >>")
    data = build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Contents 4 0 R /Resources << /XObject << /X 6 0 R >> >> >>", 4: stream(b"/X Do 0 0 10 10 re f BI /W 2 /H 1 /CS /G /BPC 8 ID \x00\xff EI"), 6: form})
    found = facets_of(data, ["elements", "images", "runs", "diagnostics"])
    assert [(x["kind"], x["parent"]) for x in found["elements"]] == [("group", None), ("path", 0), ("text", 0), ("path", None), ("image", None)]
    assert found["runs"] == [] and found["images"][0]["width"] == 2 and found["images"][0]["png"][:4] == b"\x89PNG"
    assert found["diagnostics"][0]["code"] == "graphics.form.recursive"


def test_packed_samples():
    assert unpack(bytes([0b10110001, 0b01000000]), 5, 1, 2, 1)[0, :, 0].tolist() == [1, 1, 0, 0, 0]
    assert unpack(bytes([0x12, 0x34]), 1, 1, 1, 16)[0, 0, 0] == 0x1234
    assert unpack(bytes([0b00011011]), 4, 1, 1, 2)[0, :, 0].tolist() == [0, 1, 2, 3]


def test_streams_are_found_without_their_length():
    got = Lexer(b"<< /Length 3 >>\nstream\nabcdef\nendstream").object()
    assert isinstance(got, Stream) and got.data == b"abcdef"
