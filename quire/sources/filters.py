"""Stream filters, each bounded in what it gives."""

from __future__ import annotations

import re
import zlib

import numpy as np

from .objects import Name, Objects, PdfError, Stream

SHORT = {"Fl": "FlateDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "LZW": "LZWDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode"}
IMAGE = {"DCTDecode", "JPXDecode", "JBIG2Decode", "CCITTFaxDecode"}


def flate(data: bytes, limit: int) -> bytes:
    for wbits in (15, -15):
        unpack, out = zlib.decompressobj(wbits), b""
        try:
            out = unpack.decompress(data, limit + 1)
        except zlib.error:
            if wbits > 0 and data[:1] != b"\x78":
                continue
            out = _partly(data, wbits, limit)
            if not out and wbits > 0:
                continue
        if len(out) > limit:
            raise PdfError("limit", "decoded stream is too large")
        return out
    raise PdfError("format", "bad deflate data")


def _partly(data: bytes, wbits: int, limit: int) -> bytes:
    """What can be had of a damaged stream."""
    unpack, out = zlib.decompressobj(wbits), bytearray()
    try:
        for i in range(0, len(data), 64):
            out += unpack.decompress(data[i : i + 64])
            if len(out) > limit:
                break
    except zlib.error:
        pass
    return bytes(out)


def ascii_hex(data: bytes, limit: int) -> bytes:
    digits = re.sub(rb"\s", b"", data.partition(b">")[0])
    if re.search(rb"[^0-9A-Fa-f]", digits):
        raise PdfError("format", "bad hex data")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes, limit: int) -> bytes:
    data = re.sub(rb"\s", b"", data).removeprefix(b"<~").partition(b"~")[0]
    out, group = bytearray(), []
    for c in data:
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                value = 0
                for d in group:
                    value = value * 85 + d
                if value >> 32:
                    raise PdfError("format", "bad base-85 group")
                out += value.to_bytes(4, "big")
                group = []
        else:
            raise PdfError("format", "bad base-85 data")
    if len(group) == 1:
        raise PdfError("format", "bad base-85 end")
    if group:
        n, value = len(group), 0
        for d in [*group, *[84] * (5 - n)]:
            value = value * 85 + d
        out += (value & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def run_length(data: bytes, limit: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + n + 2]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        if len(out) > limit:
            raise PdfError("limit", "decoded stream is too large")
    return bytes(out)


def lzw(data: bytes, limit: int, early: int = 1) -> bytes:
    table: list[bytes] = []
    out, bits, have, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        code = bits >> have - width & (1 << width) - 1
        have -= width
        bits &= (1 << have) - 1
        if code == 257:
            break
        if code == 256 or not table:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            if code == 256:
                continue
        if code < len(table):
            found = table[code]
        elif code == len(table) and last:
            found = last + last[:1]
        else:
            raise PdfError("format", "bad LZW code")
        out += found
        if len(out) > limit:
            raise PdfError("limit", "decoded stream is too large")
        if last and len(table) < 4096:
            table.append(last + found[:1])
        last = found
        width = 9 + sum(len(table) + early >= x for x in (512, 1024, 2048))
    return bytes(out)


def predict(data: bytes, parms: dict) -> bytes:
    """TIFF (2) and PNG (10 to 15) predictors."""
    kind = parms.get("Predictor", 1)
    if kind in (None, 1):
        return data
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    step, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        if bits != 8:
            raise PdfError("unsupported", "TIFF predictor of other than 8 bits")
        whole = data + b"\0" * (-len(data) % row)
        cells = np.frombuffer(whole, np.uint8).reshape(-1, columns, colors)
        return np.cumsum(cells, axis=1, dtype=np.uint8).tobytes()[: len(data)]
    if not 10 <= kind <= 15:
        raise PdfError("format", "unknown predictor")
    out, above = bytearray(), bytes(row)
    for at in range(0, len(data), row + 1):
        tag, line = data[at], bytearray(data[at + 1 : at + 1 + row].ljust(row, b"\0"))
        if tag == 2:
            line = bytearray((np.frombuffer(bytes(line), np.uint8) + np.frombuffer(above, np.uint8)).astype(np.uint8).tobytes())
        elif tag in (1, 3, 4):
            for i in range(row):
                left, up, corner = line[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                if tag == 1:
                    guess = left
                elif tag == 3:
                    guess = (left + up) // 2
                else:
                    guess = min((left, up, corner), key=lambda x, p=left + up - corner: abs(p - x))
                line[i] = line[i] + guess & 255
        elif tag:
            raise PdfError("format", "unknown PNG row filter")
        out += line
        above = bytes(line)
    return bytes(out)


def chain(stream: Stream, objects) -> list[tuple[str, dict]]:
    """The filters of a stream in order, with their parameters."""
    get = objects.resolve if objects else lambda x: x
    names, parms = get(stream.dict.get("Filter", stream.dict.get("F"))), get(stream.dict.get("DecodeParms", stream.dict.get("DP")))
    names = [] if names is None or isinstance(names, bytes) else [names] if isinstance(names, Name) else [get(x) for x in names]
    parms = parms if isinstance(parms, list) else [parms]
    parms = [p if isinstance(p, dict) else {} for p in map(get, parms)] + [{}] * len(names)
    return [(SHORT.get(n, str(n)), {k: get(v) for k, v in p.items()}) for n, p in zip(names, parms)]


def decode(stream: Stream, objects, limit: int, image_last: bool = False):
    """Decoded bytes; with image_last, (bytes, name of the image codec that is left over or None, its parameters)."""
    data, left = stream.data, (None, {})
    steps = chain(stream, objects)
    for i, (name, parms) in enumerate(steps):
        if name in ("FlateDecode", "LZWDecode"):
            data = predict(flate(data, limit) if name == "FlateDecode" else lzw(data, limit, parms.get("EarlyChange", 1)), parms)
        elif name == "ASCIIHexDecode":
            data = ascii_hex(data, limit)
        elif name == "ASCII85Decode":
            data = ascii85(data, limit)
        elif name == "RunLengthDecode":
            data = run_length(data, limit)
        elif name == "Crypt":
            pass
        elif name in IMAGE and image_last and i == len(steps) - 1:
            left = (name, parms)
        else:
            raise PdfError("unsupported", f"filter {name}")
    return (data, *left) if image_last else data


Objects.decode = staticmethod(decode)
