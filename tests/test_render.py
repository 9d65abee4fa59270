import re
import struct
import zlib

import numpy as np
import pytest
from test_kernel import build, stream

from quire.sources.document import Document
from quire.sources.objects import PdfError
from quire.sources.pdf import facets_of
from quire.sources.render import cubic, dashed, raster, svg


def page(content: bytes, more: dict[int, bytes] | None = None, resources: bytes = b"") -> Document:
    return Document(build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /MediaBox [0 0 20 10] /Contents 4 0 R /Resources << %s >> >>" % resources, 4: stream(content), **(more or {})}))


def ink(document, **options) -> np.ndarray:
    return raster(document, 0, **options)[..., 0]


def test_fill_covers_its_pixels_only():
    got = ink(page(b"0 g 2 1 4 3 re f"))
    want = np.full((10, 20), 255)
    want[6:9, 2:6] = 0
    assert (got == want).all()


def test_partial_coverage_and_transparency():
    pixels = raster(page(b"1 0 0 rg 0 0 0.5 1 re f"), 0, background=None)
    assert pixels[9, 0].tolist() == [255, 0, 0, 128] and pixels[0, 0, 3] == 0


def test_rules_clips_and_alpha():
    ring = b"0 g 0 0 10 10 re 2 2 6 6 re "
    assert ink(page(ring + b"f"))[5, 5] == 0 and ink(page(ring + b"f*"))[5, 5] == 255
    clipped = ink(page(b"0 0 3 10 re W n 0 g 0 0 20 10 re f"))
    assert (clipped[:, :3] == 0).all() and (clipped[:, 3:] == 255).all()
    half = ink(page(b"/G gs 0 g 0 0 20 10 re f", resources=b"/ExtGState << /G << /ca 0.5 /BM /Multiply >> >>"))
    assert abs(int(half[0, 0]) - 128) <= 1


def test_strokes():
    line = ink(page(b"0 G 2 w 0 5 m 20 5 l S"))
    assert (line[4:6] == 0).all() and (line[:4] == 255).all()
    hair = ink(page(b"0 G 0 w 0 5.5 m 20 5.5 l S"))
    assert (hair[4] == 0).all() and (hair[5] == 255).all()
    assert [x for x, _ in dashed([(0, 0), (10, 0)], False, ([3.0, 2.0], 1.0), 1.0)] == [[(0, 0), (2.0, 0.0)], [(4.0, 0.0), (7.0, 0.0)], [(9.0, 0.0), (10, 0)]]


def test_images_stand_upright():
    image = stream(bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 255]), b"/Subtype /Image /Width 2 /Height 2 /ColorSpace /DeviceRGB /BitsPerComponent 8")
    pixels = raster(page(b"20 0 0 10 0 0 cm /I Do", {5: image}, b"/XObject << /I 5 0 R >>"), 0)
    assert [pixels[y, x, :3].tolist() for y, x in ((2, 2), (2, 15), (8, 2), (8, 15))] == [[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255]]


def test_curves_end_at_their_end():
    points = cubic((0, 0), (0, 10), (10, 10), (10, 0))
    assert points[-1] == (10, 0) and len(points) > 4 and max(y for _, y in points) == pytest.approx(7.5, abs=0.2)


def test_options_are_checked():
    with pytest.raises(PdfError):
        raster(page(b""), 0, dpi=0)


def test_svg_and_facets():
    document = page(b"q 1 0 0 RG 0 0 m 5 5 l S Q 0 0 3 3 re W n 0 g 1 1 2 2 re f* BT /F1 5 Tf 1 1 Td (a<b) Tj ET")
    text = svg(document, 0)
    assert 'd="M0 0 L5 5"' in text and 'fill-rule="evenodd"' in text and "a&lt;b" in text and 'clip-path="url(#c0)"' in text
    assert re.search(r'viewBox="0 0 20 10"', text)
    found = facets_of(document.objects.data, ["svg", "bitmaps"])
    assert found["error"] is None and found["svg"][0]["svg"] == text
    data = found["bitmaps"][0]["png"]
    assert struct.unpack(">II", data[16:24]) == (20, 10) and zlib.crc32(data[12:29]) == struct.unpack(">I", data[29:33])[0]


def test_widgets_and_actions():
    data = build({
        1: b"<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [5 0 R 6 0 R] >> /OpenAction << /S /GoTo /D [3 0 R /Fit] /Next << /S /Nonsense >> >> >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        3: b"<< /Type /Page /Annots [7 0 R << /Subtype /Link /Rect [0 0 1 1] /A << /S /URI /URI (u) >> >>] >>", 5: b"<< /T (box) /FT /Btn /V /Yes /Kids [7 0 R 8 0 R] >>", 6: b"<< /T (alone) /FT /Tx /Rect [0 0 5 5] /P 3 0 R >>",
        7: b"<< /Subtype /Widget /Rect [0 0 2 2] /AS /Off /AP << /N << /Yes 9 0 R /Off 9 0 R >> >> >>", 8: b"<< /Subtype /Widget /Rect [0 0 2 2] /AP << /N << /No 9 0 R >> >> >>", 9: b"null",
    })
    found = facets_of(data, ["widgets", "actions", "fields"])
    assert [(w["field"], w["idx"], w["page"], w["state"]) for w in found["widgets"]] == [(0, 0, 0, "Yes"), (0, 1, None, "No"), (1, 0, 0, None)]
    assert [(a["owner"], a["path"], a["kind"], a["uri"], a["page"]) for a in found["actions"]] == [("open", [0], "GoTo", None, 0), ("open", [0, 0], "Unsupported", None, None), ("annotation 0 1", [0], "URI", "u", None)]
    assert [f["name"] for f in found["fields"]] == ["box", "alone"]
