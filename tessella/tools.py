"""The studio's jobs as tools for an assistant: JSON-RPC lines on standard input and output, after the public Model Context Protocol.

``python -m tessella tools`` serves them with the configured image service; :func:`answer` is one request's answer, for other transports and tests."""

from __future__ import annotations

import base64
import json
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass
from typing import TextIO

import numpy as np
from pyspark.sql import SparkSession

from . import project, studio
from .functions import palettes
from .sources import images, models

PROTOCOL = "2025-06-18"


def full(path: str) -> str:
    return os.path.abspath(os.path.expanduser(path))


def size(text: str) -> tuple[int, int]:
    """Width and height of ``32x48``, or of one number for both."""
    w, _, h = text.lower().partition("x")
    return int(w), int(h or w)


def preview(path: str, side: int = 768) -> bytes:
    """A picture enlarged by the whole factor that brings it nearest under ``side``, so that every pixel stays square."""
    im = project.picture(path)
    k = max(1, side // max(im.shape[:2]))
    return images.encode_png(np.ascontiguousarray(im.repeat(k, 0).repeat(k, 1)))


@dataclass
class Workshop:
    spark: SparkSession
    model: Callable[[], models.ImageModel]

    def create(self, outdir: str, prompt: str, size: str = "32x32", variants: int = 1, palette: str = "", colors: int = 16, name: str = "sprite") -> tuple[str, list[str]]:
        """Draw a sprite, or variants of it."""
        made = studio.create(self.spark, self.model(), prompt, full(outdir), _size(size), variants, palette or None, colors, name)
        return f"{len(made)} sprite(s)", [os.path.join(full(outdir), n) for n in made]

    def create_set(self, outdir: str, items: str, size: str = "32x32", palette: str = "", colors: int = 16, theme: str = "") -> tuple[str, list[str]]:
        """Draw sprites that match: name=description, separated by |."""
        made = studio.create_set(self.spark, self.model(), items, full(outdir), _size(size), palette or None, colors, theme)
        return f"{len(made)} sprites", [os.path.join(full(outdir), f"{n}.png") for n in made]

    def animate(self, sprite: str, outdir: str, prompt: str, frames: int = 4, pad: str = "0", palette: str = "", fps: int = 8) -> tuple[str, list[str]]:
        """Make a loop of a sprite."""
        info = studio.animate(self.spark, self.model(), full(sprite), full(outdir), prompt, frames, None, pad, palette or None, fps)
        return json.dumps(info), [os.path.join(full(outdir), n) for n in ("sheet.png", "anim.gif", "sheet.json")]

    def edit(self, sprite: str, outdir: str, prompt: str, palette: str = "") -> tuple[str, list[str]]:
        """Redraw a sprite."""
        return "redrawn", [studio.edit(self.spark, self.model(), full(sprite), full(outdir), prompt, palette or None)]

    def pixelize(self, source: str, outdir: str, size: str = "32x32", colors: int = 16, palette: str = "") -> tuple[str, list[str]]:
        """Fit art to a canvas and a palette."""
        n = project.pixelize(self.spark, full(source), full(outdir), *_size(size), colors, palette or None)
        return f"{n} picture(s)", [os.path.join(full(outdir), f) for f in project.Folder(self.spark, full(source)).names]

    def bundle(self, folder: str, outdir: str, fps: int = 8, zoom: int = 1) -> tuple[str, list[str]]:
        """Put a folder's frames into a strip, a GIF and a description."""
        info = project.bundle(self.spark, full(folder), full(outdir), fps, zoom)
        return json.dumps(info), [os.path.join(full(outdir), n) for n in ("sheet.png", "anim.gif", "sheet.json")]

    def look(self, path: str) -> tuple[str, list[str]]:
        """Show a picture enlarged."""
        h, w = project.picture(full(path)).shape[:2]
        return f"{w} by {h}", [full(path)]

    def palettes(self) -> tuple[str, list[str]]:
        """List the named palettes."""
        return "\n".join(f"{n}: {len(c)} colours" for n, c in sorted(palettes.PRESETS.items())), []


_size = size
NAMES = ("create", "create_set", "animate", "edit", "pixelize", "bundle", "look", "palettes")


def listing() -> list[dict]:
    """The tools with the schemas of their arguments, from their signatures."""
    import inspect

    kinds = {"str": "string", "int": "integer"}
    out = []
    for n in NAMES:
        f = getattr(Workshop, n)
        given = [p for p in inspect.signature(f).parameters.values() if p.name != "self"]
        out.append({"name": n, "description": f.__doc__, "inputSchema": {"type": "object", "properties": {p.name: {"type": kinds[p.annotation]} for p in given}, "required": [p.name for p in given if p.default is p.empty]}})
    return out


def _called(shop: Workshop, name: str, arguments: dict) -> dict:
    if name not in NAMES:
        raise KeyError(f"no tool {name}")
    try:
        log, files = getattr(shop, name)(**arguments)
        shown = next((f for f in files if f.endswith(".png") and os.path.exists(f)), None)
        content = [{"type": "text", "text": log + ("\n\nfiles:\n" + "\n".join(files) if files else "")}]
        if shown:
            content.append({"type": "image", "data": base64.b64encode(preview(shown)).decode(), "mimeType": "image/png"})
        return {"content": content, "isError": False}
    except (OSError, ValueError, TypeError, KeyError, models.Refused, models.Exhausted) as e:
        return {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"}], "isError": True}


def answer(shop: Workshop, request: dict) -> dict | None:
    """The answer to a request; None to a notification."""
    if "id" not in request:
        return None
    method, args = request.get("method"), request.get("params") or {}
    out = {"jsonrpc": "2.0", "id": request["id"]}
    try:
        if method == "initialize":
            result = {"protocolVersion": args.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "tessella", "version": "1"}}
        elif method == "tools/list":
            result = {"tools": listing()}
        elif method == "tools/call":
            result = _called(shop, args.get("name", ""), args.get("arguments") or {})
        elif method == "ping":
            result = {}
        else:
            return out | {"error": {"code": -32601, "message": f"no method {method}"}}
    except KeyError as e:
        return out | {"error": {"code": -32602, "message": str(e)}}
    return out | {"result": result}


def serve(shop: Workshop, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    """Answers requests, a line each, until the input ends."""
    for line in lines:
        if not line.strip():
            continue
        try:
            reply = answer(shop, json.loads(line))
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            print(json.dumps(reply), file=out, flush=True)
