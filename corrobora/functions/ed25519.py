"""Ed25519 signatures (RFC 8032) in whole numbers, for tasks that have no signing library.

Not hardened against who can time it: keys belong on machines that are trusted.
"""

from __future__ import annotations

from functools import cache, lru_cache
from hashlib import sha512

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)

#: (X, Y, Z, T) with x = X/Z, y = Y/Z, x * y = T/Z.
Point = tuple[int, int, int, int]
NEUTRAL: Point = (0, 1, 1, 0)


def add(p: Point, q: Point) -> Point:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def root_x(y: int, odd: int) -> int | None:
    """The x of a point with this y, of the parity asked for."""
    xx = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(xx, (P + 3) // 8, P)
    x = x if (x * x - xx) % P == 0 else x * ROOT % P
    if (x * x - xx) % P or (x == 0 and odd):
        return None
    return x if x & 1 == odd else P - x


#: A point as what an addition of it needs: y - x, y + x, 2 d x y, with z = 1.
Ready = tuple[int, int, int]


def ready(points: list[Point]) -> list[Ready]:
    """Points in affine form, with one inversion for all."""
    upto = [1]
    for p in points:
        upto.append(upto[-1] * p[2] % P)
    inverse, out = pow(upto[-1], -1, P), []
    for p, before in zip(reversed(points), reversed(upto[:-1]), strict=True):
        z, inverse = inverse * before % P, inverse * p[2] % P
        x, y = p[0] * z % P, p[1] * z % P
        out.append(((y - x) % P, (y + x) % P, 2 * D * x * y % P))
    return out[::-1]


@lru_cache(16)
def windows(point: Point) -> list[list[Ready]]:
    """Multiples 0 to 255 of a point for each eight bits of a number."""
    out = []
    for _ in range(32):
        row = [NEUTRAL]
        for _ in range(256):
            row.append(add(row[-1], point))
        out.append(ready(row[:256]))
        point = row[256]
    return out


@cache
def base() -> Point:
    y = 4 * pow(5, -1, P) % P
    x = root_x(y, 0)
    return x, y, 1, x * y % P


def times(n: int, p: Point, start: Point = NEUTRAL) -> Point:
    """n * p + start for n below 2**256, by the windows of p, which are kept: for points that are used many times."""
    x, y, z, t = start
    for row in windows(p):
        if n & 255:
            minus, plus, both = row[n & 255]
            a, b, c = (y - x) * minus % P, (y + x) * plus % P, t * both % P
            e, f, g, h = b - a, 2 * z - c, 2 * z + c, b + a
            x, y, z, t = e * f % P, g * h % P, f * g % P, e * h % P
        n >>= 8
    return x, y, z, t


def times_base(n: int) -> Point:
    return times(n, base())


def packed(p: Point) -> bytes:
    z = pow(p[2], -1, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def unpacked(b: bytes) -> Point | None:
    n = int.from_bytes(b, "little")
    y = n & ((1 << 255) - 1)
    x = root_x(y, n >> 255) if y < P and len(b) == 32 else None
    return None if x is None else (x, y, 1, x * y % P)


def number(*parts: bytes) -> int:
    return int.from_bytes(sha512(b"".join(parts)).digest(), "little") % ORDER


@cache
def expanded(seed: bytes) -> tuple[int, bytes, bytes]:
    """(secret number, prefix, public key) of a 32-byte seed."""
    h = sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254
    return a, h[32:], packed(times_base(a))


def public_key(seed: bytes) -> bytes:
    return expanded(seed)[2]


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix, public = expanded(seed)
    r = number(prefix, message)
    at = packed(times_base(r))
    return at + ((r + number(at, public, message) * a) % ORDER).to_bytes(32, "little")


@lru_cache(16)
def unpacked_key(b: bytes) -> Point | None:
    return unpacked(b)


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    key, s = unpacked_key(public), int.from_bytes(signature[32:], "little")
    if key is None or len(signature) != 64 or s >= ORDER:
        return False
    # The first half is a point of which there is one form alone, so forms are compared, not points.
    x, y, z, t = key
    return packed(times(number(signature[:32], public, message), (P - x, y, z, P - t), times_base(s))) == signature[:32]
