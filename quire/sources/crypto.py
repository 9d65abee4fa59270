"""The standard security handler, revisions 2 to 6."""

from __future__ import annotations

import hashlib
from functools import cache

from .objects import Name, PdfError, Ref, Stream

# A fixed value: the padding of passwords.
PAD = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


@cache
def _boxes() -> tuple[bytes, bytes]:
    """The AES substitution box and its inverse, from inverses in the field of 256 elements."""
    exp, log, x = [0] * 256, [0] * 256, 1
    for i in range(255):
        exp[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    box = bytearray(256)
    for i in range(256):
        v = exp[(255 - log[i]) % 255] if i else 0
        s = v
        for _ in range(4):
            v = (v << 1 | v >> 7) & 0xFF
            s ^= v
        box[i] = s ^ 0x63
    back = bytearray(256)
    for i, s in enumerate(box):
        back[s] = i
    return bytes(box), bytes(back)


def _mul(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


@cache
def _product(by: int) -> bytes:
    return bytes(_mul(i, by) for i in range(256))


@cache
def _schedule(key: bytes) -> list[bytes]:
    box, n = _boxes()[0], len(key) // 4
    words = [key[4 * i : 4 * i + 4] for i in range(n)]
    turn = 1
    for i in range(n, 4 * (n + 7)):
        w = words[-1]
        if i % n == 0:
            w = bytes(box[b] for b in w[1:] + w[:1])
            w = bytes([w[0] ^ turn]) + w[1:]
            turn = _mul(turn, 2)
        elif n > 6 and i % n == 4:
            w = bytes(box[b] for b in w)
        words.append(bytes(a ^ b for a, b in zip(words[i - n], w)))
    return [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]


_SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]
_BACK = [(i - 4 * (i % 4)) % 16 for i in range(16)]


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(len(a), "big")


def _encrypt_block(block: bytes, keys: list[bytes]) -> bytes:
    box, two, three = _boxes()[0], _product(2), _product(3)
    s = _xor(block, keys[0])
    for k in keys[1:-1]:
        t = [box[s[i]] for i in _SHIFT]
        s = _xor(bytes(two[t[i]] ^ three[t[i - i % 4 + (i + 1) % 4]] ^ t[i - i % 4 + (i + 2) % 4] ^ t[i - i % 4 + (i + 3) % 4] for i in range(16)), k)
    return _xor(bytes(box[s[i]] for i in _SHIFT), keys[-1])


def _decrypt_block(block: bytes, keys: list[bytes]) -> bytes:
    back, m = _boxes()[1], [_product(x) for x in (14, 11, 13, 9)]
    s = _xor(block, keys[-1])
    for k in reversed(keys[1:-1]):
        t = _xor(bytes(back[s[i]] for i in _BACK), k)
        s = bytes(m[0][t[i]] ^ m[1][t[i - i % 4 + (i + 1) % 4]] ^ m[2][t[i - i % 4 + (i + 2) % 4]] ^ m[3][t[i - i % 4 + (i + 3) % 4]] for i in range(16))
    return _xor(bytes(back[s[i]] for i in _BACK), keys[0])


def aes_cbc(data: bytes, key: bytes, iv: bytes, encrypt: bool = False) -> bytes:
    """Whole blocks, no padding."""
    keys, out = _schedule(key), bytearray()
    for at in range(0, len(data) - len(data) % 16, 16):
        block = data[at : at + 16]
        if encrypt:
            iv = _encrypt_block(_xor(block, iv), keys)
            out += iv
        else:
            out += _xor(_decrypt_block(block, keys), iv)
            iv = block
    return bytes(out)


def aes_unwrap(data: bytes, key: bytes) -> bytes:
    """The initial vector comes first, the padding says its length last."""
    out = aes_cbc(data[16:], key, data[:16]) if len(data) >= 32 else b""
    return out[: -out[-1]] if out and 1 <= out[-1] <= 16 else out


def rc4(data: bytes, key: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for byte in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(byte ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def hash_r6(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    k, i = hashlib.sha256(password + salt + user).digest(), 0
    while True:
        e = aes_cbc((password + k + user) * 64, k[:16], k[16:32], encrypt=True)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


class Security:
    """Finds the file key from a password; `owner` says which it was. Wrong passwords leave key null."""

    def __init__(self, objects, spec: dict, passwords: list[bytes]):
        get = lambda k, kind=None: objects.get(spec, k, kind)
        if get("Filter") != "Standard":
            raise PdfError("unsupported", "security handler")
        self.version, self.revision = get("V", int) or 0, get("R", int) or 0
        if (self.version, self.revision) not in ((1, 2), (2, 3), (1, 3), (4, 4), (5, 5), (5, 6)):
            raise PdfError("unsupported", "encryption version")
        self.bits = 256 if self.version == 5 else 40 if self.version == 1 else get("Length", int) or (128 if self.version == 4 else 40)
        self.p = get("P", int) or 0
        self.o, self.u = get("O", bytes) or b"", get("U", bytes) or b""
        self.oe, self.ue = get("OE", bytes) or b"", get("UE", bytes) or b""
        metadata = get("EncryptMetadata")
        self.metadata = metadata is not False
        ids = objects.get(objects.trailer, "ID", list)
        self.id = objects.resolve(ids[0]) if ids else b""
        self.id = self.id if isinstance(self.id, bytes) else b""
        filters = get("CF", dict) or {}

        def method(which: str) -> str:
            if self.version < 4:
                return "RC4"
            name = get(which) or "Identity"
            own = objects.get(filters, name, dict)
            return {"V2": "RC4", "AESV2": "AES", "AESV3": "AES"}.get(objects.get(own, "CFM"), "None") if name != "Identity" else "None"

        self.stream, self.string = method("StmF"), method("StrF")
        self.embedded = method("EFF") if self.version >= 4 and get("EFF") else self.stream
        self.key, self.owner = None, False
        for password in passwords:
            if self._open(password):
                break

    def _legacy_key(self, password: bytes) -> bytes:
        n = self.bits // 8
        data = (password + PAD)[:32] + self.o[:32] + (self.p & 0xFFFFFFFF).to_bytes(4, "little") + self.id
        if self.revision >= 4 and not self.metadata:
            data += b"\xff\xff\xff\xff"
        key = hashlib.md5(data).digest()
        for _ in range(50 if self.revision >= 3 else 0):
            key = hashlib.md5(key[:n]).digest()
        return key[:n]

    def _is_user(self, key: bytes) -> bool:
        if self.revision == 2:
            return rc4(PAD, key) == self.u[:32]
        x = rc4(hashlib.md5(PAD + self.id).digest(), key)
        for i in range(1, 20):
            x = rc4(x, bytes(b ^ i for b in key))
        return x == self.u[:16]

    def _open(self, password: bytes) -> bool:
        if self.version == 5:
            return self._open_aes256(password[:127])
        key = hashlib.md5((password + PAD)[:32]).digest()
        n = self.bits // 8 if self.revision >= 3 else 5
        for _ in range(50 if self.revision >= 3 else 0):
            key = hashlib.md5(key[:n]).digest()
        key, user = key[:n], self.o[:32]
        for i in reversed(range(20 if self.revision >= 3 else 1)):
            user = rc4(user, bytes(b ^ i for b in key))
        for candidate, owner in ((user, True), (password, False)):
            found = self._legacy_key(candidate)
            if self._is_user(found):
                self.key, self.owner = found, owner
                return True
        return False

    def _open_aes256(self, password: bytes) -> bool:
        digest = hash_r6 if self.revision == 6 else lambda p, s, u=b"": hashlib.sha256(p + s + u).digest()
        for own, wrapped, owner, extra in ((self.o, self.oe, True, self.u[:48]), (self.u, self.ue, False, b"")):
            if digest(password, own[32:40], extra) == own[:32]:
                self.key = aes_cbc(wrapped[:32], digest(password, own[40:48], extra), bytes(16))
                self.owner = owner
                return True
        return False

    def _data(self, data: bytes, ref: Ref, method: str) -> bytes:
        if method == "None":
            return data
        if self.version == 5:
            return aes_unwrap(data, self.key)
        salt = self.key + ref.obj.to_bytes(3, "little") + ref.gen.to_bytes(2, "little")
        key = hashlib.md5(salt + (b"sAlT" if method == "AES" else b"")).digest()[: min(16, len(self.key) + 5)]
        return aes_unwrap(data, key) if method == "AES" else rc4(data, key)

    def decrypt(self, value, ref: Ref):
        """An object with its strings and its stream decrypted."""
        if isinstance(value, bytes) and type(value) is bytes:
            return self._data(value, ref, self.string)
        if isinstance(value, list):
            return [self.decrypt(x, ref) for x in value]
        if isinstance(value, dict):
            return {k: self.decrypt(v, ref) for k, v in value.items()}
        if isinstance(value, Stream):
            kind = value.dict.get("Type")
            method = self.embedded if kind == "EmbeddedFile" else self.stream
            names = value.dict.get("Filter")
            if kind == "XRef" or kind == "Metadata" and not self.metadata or names in (Name("Crypt"), [Name("Crypt")]):
                method = "None"
            return Stream(self.decrypt(value.dict, ref), self._data(value.data, ref, method))
        return value
