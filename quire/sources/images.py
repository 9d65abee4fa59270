"""Images: packed samples to RGBA, and PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .filters import decode
from .objects import Name, PdfError, Stream

SHORT = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}


def unpack(data: bytes, width: int, height: int, parts: int, bits: int) -> np.ndarray:
    """Samples as (height, width, parts), from 1 to 16 bits each, rows padded to bytes."""
    row = (width * parts * bits + 7) // 8
    raw = np.frombuffer(data[: row * height].ljust(row * height, b"\0"), np.uint8).reshape(height, row)
    if bits == 8:
        cells = raw
    elif bits == 16:
        cells = raw.view(">u2")
    else:
        bit = np.unpackbits(raw, axis=1)[:, : width * parts * bits].reshape(height, width * parts, bits)
        cells = bit @ (1 << np.arange(bits)[::-1])
    return cells[:, : width * parts].reshape(height, width, parts).astype(np.float64)


#: Colour spaces whose tint transforms, profiles or white points are not applied.
UNCONVERTED = ("Separation", "DeviceN", "Lab", "CalGray", "CalRGB", "ICCBased")


def colors(document, space, samples: np.ndarray, high: float) -> np.ndarray:
    """RGB, from 0 to 1, of samples in a colour space; spaces of devices and Indexed. Others are taken by their number of parts, with a diagnostic."""
    get = document.objects.resolve
    space = get(space)
    if isinstance(space, list) and space and str(get(space[0])) in ("Indexed", "I"):
        table = get(space[3])
        table = decode(table, document.objects, 1 << 20) if isinstance(table, Stream) else table
        inner, top = space[1], int(get(space[2]))
        parts = _parts(document, inner)
        palette = np.frombuffer(table[: (top + 1) * parts].ljust((top + 1) * parts, b"\0"), np.uint8).reshape(-1, parts).astype(float)
        return colors(document, inner, palette[np.clip(np.rint(samples[..., 0]).astype(int), 0, top)], 255)
    if isinstance(space, list) and space and (kind := str(get(space[0]))) in UNCONVERTED:
        document.objects.note(f"image.colorspace.{kind}", "the samples are taken as gray, RGB or CMYK by their number of parts")
    x = samples / high
    parts = x.shape[-1]
    if parts == 4:
        return 1 - np.minimum(1, x[..., :3] * (1 - x[..., 3:]) + x[..., 3:])
    return np.repeat(x[..., :1], 3, axis=-1) if parts != 3 else x


def _parts(document, space) -> int:
    get = document.objects.resolve
    space = get(space)
    if isinstance(space, list) and space:
        kind = str(get(space[0]))
        if kind == "ICCBased":
            return document.get(get(space[1]), "N", int) or 3
        if kind == "DeviceN":
            return len(get(space[1]))
        return {"Indexed": 1, "I": 1, "Separation": 1, "CalGray": 1}.get(kind, 3)
    return {"DeviceGray": 1, "DeviceCMYK": 4, "G": 1, "CMYK": 4}.get(str(space), 3)


def rgba(document, stream: Stream, resources: dict) -> np.ndarray:
    """Straight-alpha bytes (height, width, 4). Codecs of photographs and fax are unsupported."""
    get = lambda *keys: next((v for v in (document.objects.resolve(stream.dict.get(k)) for k in keys) if v is not None), None)
    width, height, mask = get("Width", "W"), get("Height", "H"), get("ImageMask", "IM") is True
    if type(width) is not int or type(height) is not int or width < 1 or height < 1 or width * height > 1 << 26:
        raise PdfError("limit", "bad image size")
    data, codec, _ = decode(stream, document.objects, document.objects.limits["decoded_bytes"], image_last=True)
    if codec:
        raise PdfError("unsupported", f"image codec {codec}")
    space, bits = get("ColorSpace", "CS"), 1 if mask else get("BitsPerComponent", "BPC") or 8
    if isinstance(space, Name):
        space = (document.get(resources, "ColorSpace", dict) or {}).get(str(space), SHORT.get(str(space), str(space)))
        space = Name(space) if isinstance(space, str) else space
    parts = 1 if mask else _parts(document, space)
    high = float((1 << bits) - 1)
    samples = unpack(data, width, height, parts, bits)
    ranges = get("Decode", "D")
    indexed = isinstance(document.objects.resolve(space), list) and str(document.objects.resolve(document.objects.resolve(space)[0])) in ("Indexed", "I")
    if isinstance(ranges, list) and len(ranges) >= 2 * parts and not indexed:
        low, top = np.array(ranges[: 2 * parts : 2], float), np.array(ranges[1 : 2 * parts : 2], float)
        samples = np.clip(low + samples / high * (top - low), 0, 1) * high
    out = np.zeros((height, width, 4))
    if mask:
        out[..., 3] = 1 - samples[..., 0]
    else:
        out[..., :3], out[..., 3] = colors(document, space, samples, high), 1
        key = get("Mask")
        if isinstance(key, list) and len(key) >= 2 * parts:
            raw = unpack(data, width, height, parts, bits)
            out[..., 3] = ~np.all((raw >= np.array(key[: 2 * parts : 2])) & (raw <= np.array(key[1 : 2 * parts : 2])), axis=-1)
        soft = get("SMask")
        if isinstance(soft, Stream):
            alpha = rgba(document, soft, resources)[..., 0] / 255
            y, x = np.arange(height) * alpha.shape[0] // height, np.arange(width) * alpha.shape[1] // width
            out[..., 3] = alpha[y][:, x]
    return np.rint(out * 255).astype(np.uint8)


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGBA file."""
    height, width, _ = pixels.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def image_facts(document, stream: Stream, resources: dict) -> dict:
    try:
        pixels = rgba(document, stream, resources)
        return {"width": pixels.shape[1], "height": pixels.shape[0], "error": None, "png": png(pixels)}
    except (PdfError, ValueError, TypeError, IndexError) as e:
        return {"width": None, "height": None, "error": str(e), "png": None}
