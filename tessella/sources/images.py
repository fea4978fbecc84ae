"""PNG and GIF in plain Python: PNG of all colour types at 8 bits and less (and 16 bits, cut to 8), GIF frames of up to 255 colours."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(data: bytes):
    at = len(_SIGNATURE)
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        yield kind, data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    out = np.zeros((height, stride), np.uint8)
    up = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, row = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1)
        if kind == 0:
            line = row.copy()
        elif kind == 2:
            line = row + up
        elif kind == 1:
            line = row.copy()
            for i in range(step):
                line[i::step] = np.cumsum(row[i::step], dtype=np.uint64).astype(np.uint8)
        else:
            cur, src, above = bytearray(stride), row.tolist(), up.tolist()
            for x in range(stride):
                a = cur[x - step] if x >= step else 0
                b = above[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    c = above[x - step] if x >= step else 0
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if da <= db and da <= dc else b if db <= dc else c
                cur[x] = src[x] + guess & 255
            line = np.frombuffer(bytes(cur), np.uint8)
        out[y] = up = line
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Height by width by 4 of bytes: r, g, b, a."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("not a PNG image")
    head, palette, clear, parts = None, None, None, []
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            parts.append(body)
    w, h, depth, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced images are not read")
    n = _CHANNELS[colour]
    stride = (w * n * depth + 7) // 8
    rows = _unfilter(zlib.decompress(b"".join(parts)), h, stride, max(1, n * depth // 8))
    full = None
    if depth == 16:
        full = rows.reshape(h, w * n, 2)
        v = full[:, :, 0]
        full = full[:, :, 0].astype(int) << 8 | full[:, :, 1]
    elif depth == 8:
        v = rows
    else:
        v = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        v = (v << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2).astype(np.uint8)[:, : w * n]
    raw = (full if full is not None else v).reshape(h, w, n)
    if colour in (0, 2) and depth < 8:
        v = (v.astype(int) * 255 // (2**depth - 1)).astype(np.uint8)
    v = v.reshape(h, w, n)
    out = np.full((h, w, 4), 255, np.uint8)
    if colour == 3:
        out[..., :3] = palette[v[..., 0]]
        if clear:
            alpha = np.full(256, 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            out[..., 3] = alpha[v[..., 0]]
        return out
    out[..., :3] = v[..., :3] if n >= 3 else v[..., :1]
    if n in (2, 4):
        out[..., 3] = v[..., -1]
    elif clear:
        key = np.array(struct.unpack(f">{len(clear) // 2}H", clear))
        out[..., 3] = np.where((raw == key).all(axis=2), 0, 255)
    return out


def encode_png(rgba: np.ndarray) -> bytes:
    h, w = rgba.shape[:2]
    raw = np.zeros((h, 1 + 4 * w), np.uint8)
    raw[:, 1:] = rgba.reshape(h, 4 * w)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 9)) + chunk(b"IEND", b"")


def _lzw(indices: np.ndarray, bits: int) -> bytes:
    clear, out, held, n = 1 << bits, bytearray(), 0, 0
    table, width = {}, bits + 1

    def put(code: int) -> None:
        nonlocal held, n
        held |= code << n
        n += width
        while n >= 8:
            out.append(held & 255)
            held >>= 8
            n -= 8

    put(clear)
    following = clear + 2
    word: int | None = None
    for i in indices.tolist():
        if word is None:
            word = i
            continue
        if (code := table.get((word, i))) is not None:
            word = code
            continue
        put(word)
        if following < 4096:
            table[word, i] = following
            if following == 1 << width and width < 12:
                width += 1
            following += 1
        else:
            put(clear)
            table, width, following = {}, bits + 1, clear + 2
        word = i
    if word is not None:
        put(word)
    put(clear + 1)
    if n:
        out.append(held & 255)
    return bytes(out)


def colour_table(frames: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """The first 255 opaque colours in order."""
    seen: set[tuple[int, int, int]] = set()
    for f in frames:
        seen |= set(map(tuple, f[f[..., 3] >= 128][:, :3].tolist()))
    return sorted(seen)[:255]


def encode_gif(frames: list[np.ndarray], fps: int) -> bytes:
    """A looping animation of equal-sized frames. Index 0 is transparent; a colour beyond the table becomes its first."""
    table = colour_table(frames)
    index = {c: i + 1 for i, c in enumerate(table)}
    h, w = frames[0].shape[:2]
    palette = bytes(3) + b"".join(bytes(c) for c in table)
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF7, 0, 0), palette.ljust(768, b"\0"), b"!\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for f in frames:
        flat = f.reshape(-1, 4)
        idx = np.array([index.get((r, g, b), 1) if a >= 128 else 0 for r, g, b, a in flat.tolist()])
        body = _lzw(idx, 8)
        out += [b"!\xf9\x04\x09", struct.pack("<HB", max(1, round(100 / fps)), 0), b"\0,", struct.pack("<HHHHB", 0, 0, w, h, 0), b"\x08"]
        out += [bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)] + [b"\0"]
    return b"".join([*out, b";"])
