"""Image models behind a small protocol, the extraction of pictures from their answers, and the resumable run of frames through one.

A model is a remote service; none is bundled. ``Recolouring`` is a deterministic stand-in for tests."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import animations
from . import images

STATE = "run string, rep bigint, status string, retries int, reason string"
_RUN = re.compile(r"[A-Za-z0-9+/=\s]{200,}")


class Refused(Exception):
    """The model will not draw this; it is never asked again."""


class Exhausted(Exception):
    """The quota is used up; the run stops and can be resumed."""


class ImageModel(Protocol):
    def edit(self, image: bytes, prompt: str, refs: tuple[bytes, ...] = ()) -> bytes: ...

    def generate(self, prompt: str) -> bytes: ...


class Recolouring:
    """Swaps red and blue, and refuses prompts that hold "refuse"."""

    def edit(self, image: bytes, prompt: str, refs: tuple[bytes, ...] = ()) -> bytes:
        if "refuse" in prompt:
            raise Refused(prompt)
        return images.encode_png(images.decode_png(image)[..., [2, 1, 0, 3]])

    def generate(self, prompt: str) -> bytes:
        n = sum(prompt.encode()) % 256
        return images.encode_png(np.full((16, 16, 4), (n, 255 - n, 128, 255), np.uint8))


def find_image(answer: object) -> bytes | None:
    """The first picture in base64, alone or as a data address, anywhere in a JSON answer."""
    if isinstance(answer, str):
        text = answer.split("base64,", 1)[-1] if answer.startswith("data:image") else answer
        if len(text) > 60 and re.fullmatch(r"[A-Za-z0-9+/=\s]+", text):
            data = base64.b64decode(text + "=" * (-len(text.strip()) % 4))
            if data[:4] in (b"\x89PNG", b"GIF8", b"RIFF") or data[:3] == b"\xff\xd8\xff":
                return data
        return None
    parts = answer.values() if isinstance(answer, dict) else answer if isinstance(answer, list) else ()
    return next((x for x in map(find_image, parts) if x is not None), None)


def stripped(answer: str) -> str:
    """An answer without its long base64 runs, for logs."""
    return _RUN.sub("...", answer)


def sheet_prompt(task: str, frames: int, rows: int, scale: int, background: str) -> str:
    return f"This picture holds {frames} frames of one sprite in {rows} row(s), each pixel drawn as {scale} by {scale} on {background}. {task} Keep every frame's place and size, keep pixels square, keep the background."


def items(spec: str) -> list[tuple[str, str]]:
    """(name, description) of ``name=description|name=description``; without a name, item1, item2, ..."""
    out = []
    for k, part in enumerate((p.strip() for p in spec.split("|") if p.strip()), 1):
        name, eq, text = part.partition("=")
        out.append((name.strip(), text.strip()) if eq else (f"item{k}", part))
    return out


def edited(model: ImageModel, image: bytes, prompt: str, tries: int = 3) -> tuple[bytes | None, str, int, str | None]:
    """(picture, status, retries, reason): ok, refused (not asked again), or failed after ``tries``; an exhausted quota is raised."""
    reason = None
    for k in range(tries):
        try:
            return model.edit(image, prompt), "ok", k, None
        except Refused as e:
            return None, "refused", k, str(e)
        except Exhausted:
            raise
        except (OSError, ValueError, json.JSONDecodeError) as e:
            reason = f"{type(e).__name__}: {e}"
    return None, "failed", tries, reason


def run(spark: SparkSession, name: str, frames: DataFrame, prompt: str, model: ImageModel, state: DataFrame | None = None, finished: DataFrame | None = None, tries: int = 3, after: Callable[[int, bytes], bytes] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pictures, state): the frames (frame, content) that no earlier run finished and no state row settles are sent one by one; the service bounds the pace, so this
    is the driver's loop. An exhausted quota ends it, and the rows so far make it resumable."""
    todo = frames
    if state is not None:
        todo = todo.join(state.where((F.col("run") == name) & F.col("status").isin("ok", "refused")).select(F.col("rep").alias("frame")), "frame", "left_anti")
    if finished is not None:
        todo = todo.join(finished.select("frame"), "frame", "left_anti")
    pictures, rows = [], []
    for r in todo.orderBy("frame").toLocalIterator():
        try:
            data, status, retries, reason = edited(model, bytes(r["content"]), prompt, tries)
        except Exhausted:
            break
        if data is not None:
            pictures.append((r["frame"], bytearray(after(r["frame"], data) if after else data)))
        rows.append((name, r["frame"], status, retries, reason))
    new = spark.createDataFrame(rows, STATE)
    return spark.createDataFrame(pictures, "frame bigint, content binary"), animations.upserted(state, new) if state is not None else new


def requeued(state: DataFrame, name: str, statuses: tuple[str, ...] = ("failed",)) -> DataFrame:
    """The state without a run's rows of these statuses, so that they are asked again."""
    return state.where(~((F.col("run") == name) & F.col("status").isin(*statuses)))
