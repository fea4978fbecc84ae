"""The sealed 64-byte header of containers: the file's own name under TEA, in 8-byte blocks of little-endian words."""

from __future__ import annotations

import struct

# Fixed values of the format: the cipher's key and its step.
KEY = (0x78A3CBE3, 0x49D936A9, 0xB4C570BA, 0x186E7505)
DELTA = 0x9E3779B9
ROUNDS, SIZE, M = 32, 64, 0xFFFFFFFF


def _half(v: int, s: int, k: tuple[int, int]) -> int:
    return ((v << 4) + k[0] & M) ^ (v + s & M) ^ ((v >> 5) + k[1] & M)


def _blocks(data: bytes, sums: list[int], forward: bool) -> bytes:
    if len(data) % 8:
        raise ValueError("blocks are of 8 bytes")
    out = []
    for a, b in struct.iter_unpack("<II", data):
        for s in sums:
            if forward:
                a = a + _half(b, s, KEY[:2]) & M
                b = b + _half(a, s, KEY[2:]) & M
            else:
                b = b - _half(a, s, KEY[2:]) & M
                a = a - _half(b, s, KEY[:2]) & M
        out.append(struct.pack("<II", a, b))
    return b"".join(out)


_SUMS = [DELTA * i & M for i in range(1, ROUNDS + 1)]


def encrypt(data: bytes) -> bytes:
    return _blocks(data, _SUMS, True)


def decrypt(data: bytes) -> bytes:
    return _blocks(data, _SUMS[::-1], False)


def name_of(header: bytes) -> str | None:
    """The sealed name; None where the header is of another size or holds none in printable ASCII."""
    if len(header) != SIZE:
        return None
    name, end, _ = decrypt(header).partition(b"\0")
    return name.decode() if end and name and all(32 <= c < 127 for c in name) else None


def renamed(header: bytes, name: str) -> bytes:
    """The header with another name; what stood after the longer of both names stays."""
    new = name.encode("ascii")
    if len(new) >= SIZE:
        raise ValueError("a name has at most 63 characters")
    old = name_of(header)
    plain = decrypt(header) if old is not None else bytes(SIZE)
    reach = max(len(old or ""), len(new)) + 1
    return encrypt(new.ljust(reach, b"\0")[:reach] + plain[reach:])
