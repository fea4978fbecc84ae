import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.functions import palettes
from tessella.sources import containers, images, seal


def sheet_bytes(name="hero.spr"):
    rng = random.Random(1)
    frames = [containers.Frame(6, 5, np.array([rng.randrange(65536) for _ in range(30)])), containers.Frame(4, 7, np.arange(28)), containers.Frame(-1, -1, np.array([2047])), containers.Frame(5, 5, np.full(25, 2047))]
    return containers.Sheet(containers.header(name), frames).build()


def script_bytes():
    frame = np.array([[0, 1, -1, -1], [3, 1, 3, -1]])
    steps = np.zeros((2, 4, 5), np.int32)
    steps[:, :, 0] = frame
    steps[:, :, 1] = np.arange(8).reshape(2, 4)
    steps[:, :, 4] = 3
    return containers.Script(containers.header("hero.ani"), steps, np.array([1, 2], np.int32)).build()


def test_seal_inverts_and_names():
    data = bytes(range(64))
    assert seal.decrypt(seal.encrypt(data)) == data
    h = seal.renamed(b"", "a.spr")
    assert seal.name_of(h) == "a.spr" and len(h) == 64
    longer = seal.renamed(h, "longer-name.spr")
    assert seal.name_of(longer) == "longer-name.spr"
    junk = seal.encrypt(b"a.spr\0" + bytes(range(1, 59)))
    assert seal.renamed(seal.renamed(junk, "b.spr"), "a.spr") == junk
    assert seal.name_of(b"short") is None
    with pytest.raises(ValueError):
        seal.renamed(b"", "x" * 64)


def test_sheet_round_trip():
    data = sheet_bytes()
    s = containers.Sheet.parse(data)
    assert [f.placeholder for f in s.frames] == [False, False, True, False] and s.build() == data
    assert s.frames[3].guessed_key() == containers.KEY_CYAN and s.frames[2].guessed_key() is None
    assert containers.Sheet.parse(data + b"xx").trailing == 2


@pytest.mark.parametrize("bad", [b"", b"\x89PNG" + bytes(100), b"x" * 100, sheet_bytes()[:-1], sheet_bytes()[:75]])
def test_sheet_rejects(bad):
    with pytest.raises(ValueError):
        containers.Sheet.parse(bad)


def test_script_round_trip():
    data = script_bytes()
    s = containers.Script.parse(data)
    assert s.steps.shape == (2, 4, 5) and s.build() == data
    t = containers.Script.parse(data + b"tail", per=4)
    assert t.tail == b"tail" and t.build() == data + b"tail"
    with pytest.raises(ValueError):
        containers.Script.parse(data[:-4])


def test_archive_round_trip(tmp_path):
    items = [containers.Member("b/x.spr", b"123"), containers.Member("a.ani", b"\0" * 99, compressed=False)]
    out = containers.members(containers.archive(items, deflate={"a.ani"}))
    assert [(m.name, m.content, m.compressed) for m in out] == [("b/x.spr", b"123", True), ("a.ani", b"\0" * 99, True)]
    assert containers.base_name("..\\..\\evil/x.spr") == "x.spr"
    containers.write_archive(str(tmp_path / "a.ark"), items)
    assert len(containers.members((tmp_path / "a.ark").read_bytes())) == 2


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.randoms())
def test_png_round_trip(w, h, rnd):
    im = np.array([rnd.randrange(256) for _ in range(w * h * 4)], np.uint8).reshape(h, w, 4)
    assert (images.decode_png(images.encode_png(im)) == im).all()


def _png(w, h, depth, colour, rows, extra=b""):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_kinds():
    assert images.decode_png(_png(3, 1, 8, 4, b"\0" + bytes([10, 20, 30, 40, 50, 60])))[0].tolist() == [[10, 10, 10, 20], [30, 30, 30, 40], [50, 50, 50, 60]]
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    pal = chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])) + chunk(b"tRNS", bytes([0]))
    assert images.decode_png(_png(2, 1, 1, 3, b"\0\x40", pal))[0].tolist() == [[1, 2, 3, 0], [4, 5, 6, 255]]
    assert images.decode_png(_png(4, 1, 1, 0, b"\0\xa0"))[0, :, 0].tolist() == [255, 0, 255, 0]
    filters = b"\1\x05\x05\x05" + b"\2\x01\x01\x01" + b"\3\x02\x02\x02" + b"\4\x01\x01\x01"
    assert images.decode_png(_png(3, 4, 8, 0, filters))[..., 0].tolist() == [[5, 10, 15], [6, 11, 16], [5, 10, 15], [6, 11, 16]]


def _gif_frame(data):
    """The indices of a GIF's first frame, decoded by the format's rules."""
    at = data.index(b"\0,", data.index(b"!\xf9\x04")) + 2 + 9
    bits, at, body = data[at], at + 1, b""
    while data[at]:
        body += data[at + 1 : at + 1 + data[at]]
        at += 1 + data[at]
    clear, out, pos, width, table, prev = 1 << bits, [], 0, bits + 1, {}, None
    acc = int.from_bytes(body, "little")
    while True:
        code = acc >> pos & (1 << width) - 1
        pos += width
        if code == clear:
            table, width, prev = {i: [i] for i in range(clear)}, bits + 1, None
            nxt = clear + 2
            continue
        if code == clear + 1:
            return out
        entry = table[code] if code in table else prev + prev[:1]
        out += entry
        if prev is not None and nxt < 4096:
            table[nxt] = prev + entry[:1]
            nxt += 1
            if nxt == 1 << width and width < 12:
                width += 1
        prev = entry


def test_gif_decodes():
    rng = np.random.default_rng(0)
    im = np.zeros((70, 70, 4), np.uint8)
    im[..., 0], im[..., 3] = rng.integers(0, 200, (70, 70)), 255
    im[0, 0, 3] = 0
    data = images.encode_gif([im, im], 10)
    table = {c: i + 1 for i, c in enumerate(images.colour_table([im]))}
    want = [table[tuple(p[:3])] if p[3] else 0 for p in im.reshape(-1, 4).tolist()]
    assert _gif_frame(data) == want


def test_palettes():
    assert len(palettes.parse("pico8")) == 16
    assert palettes.parse("#ff0000, 00ff00") == [(255, 0, 0), (0, 255, 0)]
    assert palettes.parse("GIMP Palette\nName: x\n# c\n 1 2 3 a\n255 0 9 b\n") == [(1, 2, 3), (255, 0, 9)]
    assert palettes.parse("010203", round_16=True) == [palettes.canonical((1, 2, 3))]
    for w in range(65536):
        c = ((w >> 11 & 31) << 3, (w >> 5 & 63) << 2, (w & 31) << 3)
        assert palettes.canonical(palettes.canonical(c)) == palettes.canonical(c)
    assert palettes.pick_background([(255, 0, 255)]) == "green"
    assert palettes.to_hex([(1, 2, 255)]) == "0102ff"


def test_median_cut():
    counts = [((i * 20, i * 7 % 256, i), i + 1) for i in range(12)]
    assert palettes.median_cut(counts, 20) == sorted(c for c, _ in counts)
    assert 1 <= len(palettes.median_cut(counts, 3)) <= 3
