"""What the reader does not convert it says, and outlines are whole."""

import numpy as np

from quire import synth
from quire.sources.document import Document
from quire.sources.images import colors


def test_deep_outlines_are_whole():
    items = [(f"item {i}", i - 1 if i else None, 0) for i in range(200)]
    found = Document(synth.text_pdf("", outline=items)).facet_outline()
    assert [(x["title"], x["parent"]) for x in found] == [(t, p) for t, p, _ in items]


def test_colour_spaces_that_are_not_converted_are_named():
    document = Document(synth.text_pdf("x"))
    samples = np.zeros((1, 1, 1))
    colors(document, "DeviceGray", samples, 255)
    assert not document.objects.diagnostics
    for kind in ("Separation", "Lab", "ICCBased"):
        colors(document, [kind, None, None], samples, 255)
    assert [d["code"] for d in document.facet_diagnostics()] == [f"image.colorspace.{k}" for k in ("Separation", "Lab", "ICCBased")]
