"""Binary sheets, animation scripts and archives, as plain Python values and bytes. All numbers are little-endian.

Sheet: 64-byte sealed header, u32 1958, u32 count, then per frame i32 width, i32 height and their product of u16 words.
Dimensions are signed: a frame of -1 by -1 is a placeholder and still holds one word.
Script: header, i32 1909, i32 A, then A*F frames, A last steps, 3*A*F offsets (x, y, z), A*F flags; F follows from the size.
Archive: a ZIP file."""

from __future__ import annotations

import io
import os
import struct
import zipfile
from dataclasses import dataclass, field

import numpy as np

from . import seal

# Fixed values of the formats.
SHEET_MAGIC, SCRIPT_MAGIC, HEADER, MOST_WORDS = 1958, 1909, 64, 4096 * 4096
KEY_BLACK, KEY_CYAN = 0x0000, 0x07FF
FOREIGN = {b"\x89PNG": "PNG", b"GIF8": "GIF", b"\xff\xd8\xff": "JPEG", b"BM": "BMP"}


@dataclass
class Frame:
    width: int
    height: int
    words: np.ndarray

    @property
    def placeholder(self) -> bool:
        return self.width < 0 or self.height < 0

    def guessed_key(self) -> int | None:
        """Cyan if the border has more of it than black, else black if it has any. Corners count twice, and so does the
        row or column of a frame that is one high or wide."""
        if self.placeholder or not len(self.words):
            return None
        g = self.words.reshape(self.height, self.width)
        border = np.concatenate([g[0], g[-1], g[:, 0], g[:, -1]])
        black, cyan = int((border == KEY_BLACK).sum()), int((border == KEY_CYAN).sum())
        return KEY_CYAN if cyan > black else KEY_BLACK if black else None


@dataclass
class Sheet:
    header: bytes
    frames: list[Frame]
    trailing: int = 0

    @classmethod
    def parse(cls, data: bytes) -> Sheet:
        for magic, kind in FOREIGN.items():
            if data.startswith(magic):
                raise ValueError(f"this is a {kind} image, not a sheet")
        if len(data) < HEADER + 8:
            raise ValueError("too short for a sheet")
        magic, count = struct.unpack_from("<II", data, HEADER)
        if magic != SHEET_MAGIC:
            raise ValueError(f"magic {magic} is not {SHEET_MAGIC}")
        at, frames = HEADER + 8, []
        for i in range(count):
            if at + 8 > len(data):
                raise ValueError(f"cut off at frame {i}")
            w, h = struct.unpack_from("<ii", data, at)
            n = w * h
            if not 0 <= n <= MOST_WORDS:
                raise ValueError(f"frame {i} of {w} by {h}")
            at += 8
            if at + 2 * n > len(data):
                raise ValueError(f"cut off in frame {i}")
            frames.append(Frame(w, h, np.frombuffer(data, "<u2", n, at)))
            at += 2 * n
        return cls(data[:HEADER], frames, len(data) - at)

    def build(self) -> bytes:
        out = [self.header, struct.pack("<II", SHEET_MAGIC, len(self.frames))]
        for f in self.frames:
            if len(f.words) != f.width * f.height:
                raise ValueError(f"{len(f.words)} words for {f.width} by {f.height}")
            out += [struct.pack("<ii", f.width, f.height), np.asarray(f.words, "<u2").tobytes()]
        return b"".join(out)


@dataclass
class Script:
    """``steps``: array of animations by steps by (frame, x, y, z, flag); ``last``: the last played step of each animation."""

    header: bytes
    steps: np.ndarray
    last: np.ndarray
    tail: bytes = b""

    @classmethod
    def parse(cls, data: bytes, per: int | None = None) -> Script:
        """With ``per``, bytes after the script are kept; without, steps per animation follow from the size."""
        if len(data) < HEADER + 8:
            raise ValueError("too short for a script")
        v = np.frombuffer(data, "<i4", (len(data) - HEADER) // 4, HEADER)
        if v[0] != SCRIPT_MAGIC or v[1] <= 0:
            raise ValueError("not a script")
        a = int(v[1])
        if per is None:
            per, odd = divmod(len(v) - 2 - a, 5 * a)
            if odd or per <= 0 or (len(data) - HEADER) % 4:
                raise ValueError(f"{a} animations do not divide {len(v)} values")
        n = a * per
        if len(v) < 2 + a + 5 * n:
            raise ValueError("cut off")
        frame, last, xyz, flag = np.split(v[2 : 2 + a + 5 * n], [n, n + a, n + a + 3 * n])
        steps = np.concatenate([frame.reshape(a, per, 1), xyz.reshape(a, per, 3), flag.reshape(a, per, 1)], axis=2)
        return cls(data[:HEADER], steps, last, data[HEADER + 4 * (2 + a + 5 * n) :])

    def build(self) -> bytes:
        a = len(self.steps)
        parts = [np.array([SCRIPT_MAGIC, a]), self.steps[:, :, 0].ravel(), self.last, self.steps[:, :, 1:4].ravel(), self.steps[:, :, 4].ravel()]
        return self.header + np.concatenate(parts).astype("<i4").tobytes() + self.tail


@dataclass
class Member:
    name: str
    content: bytes
    compressed: bool = True
    attributes: int = field(default=0)


def members(data: bytes) -> list[Member]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [Member(i.filename, z.read(i), i.compress_type != zipfile.ZIP_STORED, i.external_attr) for i in z.infolist() if not i.is_dir()]


def base_name(name: str) -> str:
    """A member's file name, safe to write: no folder of it escapes."""
    return os.path.basename(name.replace("\\", "/"))


def archive(items: list[Member], deflate: set[str] | None = None, in_order: bool = True) -> bytes:
    """A ZIP file of the members in the given order (or by name); names in ``deflate`` are compressed whatever they were. Read
    back and compared before it is returned."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for m in items if in_order else sorted(items, key=lambda m: m.name):
            info = zipfile.ZipInfo(m.name, (1980, 1, 1, 0, 0, 0))
            info.external_attr = m.attributes
            info.compress_type = zipfile.ZIP_DEFLATED if m.compressed or m.name in (deflate or ()) else zipfile.ZIP_STORED
            z.writestr(info, m.content)
    data = out.getvalue()
    if sorted((m.name, m.content) for m in members(data)) != sorted((m.name, m.content) for m in items):
        raise ValueError("the archive does not read back")
    return data


def write_archive(path: str, items: list[Member], deflate: set[str] | None = None) -> None:
    """Replaces a file whole: a reader sees the old archive or the new one."""
    part = f"{path}.part"
    with open(part, "wb") as f:
        f.write(archive(items, deflate))
    os.replace(part, path)


def header(name: str) -> bytes:
    return seal.renamed(b"", name)
