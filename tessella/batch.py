"""Runs of a prepared project's frames through an image model, resumable at any point.

A project folder is what :func:`tessella.project.prepare` makes: ``stock`` pictures, ``crops.json`` and ``anim.json``. A run has a folder ``runs/NAME`` with the
answers (``answers``), the finished pictures (``bake``) and ``state.json``: the groups of twins, of which the first is drawn, and a row for each frame that was
sent. The service bounds the pace, so frames are sent one by one from the driver; what is done with the answers are the library's operators."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import project
from .functions import palettes
from .operators import animations, layout, masks, palette_ops, pipelines
from .operators.common import C, RGBA
from .sources import models, readers, sinks

BOX = "frame bigint, cx int, cy int, cw int, ch int"


@dataclass
class Options:
    prompt: str = ""
    scale: int = 5
    gap: int = 8
    background: str = "808080"
    palette: str | None = None
    tolerance: int = 24
    tries: int = 3
    most_leftover: int = 28
    canvas: int = 1024
    #: functions (pixels, frame) -> pixels, after an answer is put into its frame
    hooks: list[Callable[[DataFrame, int], DataFrame]] = field(default_factory=list)


class Run:
    def __init__(self, spark: SparkSession, folder: str, name: str, options: Options | None = None) -> None:
        self.spark, self.folder, self.name, self.options = spark, folder, name, options or Options()
        self.root = os.path.join(folder, "runs", name)
        self.stock = project.Folder(spark, os.path.join(folder, "stock"))
        with open(os.path.join(folder, "crops.json"), encoding="utf-8") as f:
            self.crops = spark.createDataFrame([(int(k), *v) for k, v in json.load(f).items()], BOX)

    # State ----------------------------------------------------------------------------------------------------------------
    @property
    def _path(self) -> str:
        return os.path.join(self.root, "state.json")

    def state(self) -> dict:
        if not os.path.exists(self._path):
            return {}
        with open(self._path, encoding="utf-8") as f:
            return json.load(f)

    def _save(self, state: dict) -> None:
        os.makedirs(self.root, exist_ok=True)
        with open(self._path + ".new", "w", encoding="utf-8") as f:
            json.dump(state, f, indent=1)
        os.replace(self._path + ".new", self._path)  # a run that is cut off leaves the state before it

    def finished(self) -> set[int]:
        """Frames that any run but a smoothing one has finished."""
        runs = os.path.join(self.folder, "runs")
        found = [os.path.join(runs, r, "bake") for r in (os.listdir(runs) if os.path.isdir(runs) else ()) if r != "smooth"]
        return {self.stock.names.index(n) for d in found if os.path.isdir(d) for n in os.listdir(d) if n in self.stock.names}

    def begun(self, spec: str) -> dict:
        """The state, made at the first call: which frames are wanted, which are left out, and the groups of twins."""
        state = self.state()
        if "groups" not in state:
            steps = project.steps_of(self.spark, os.path.join(self.folder, "anim.json"))
            asked = [r["frame"] for r in animations.wanted(self.crops, steps, spec).where("has_crop").select("frame").distinct().orderBy("frame").collect()]
            done = self.finished()
            todo = [f for f in asked if f not in done]
            groups: dict[int, list[int]] = {}
            for r in palette_ops.twins(self.stock.px.where(C("frame").isin(todo)), crops=self.crops).orderBy("frame").collect() if todo else ():
                groups.setdefault(r["rep"], []).append(r["frame"])
            state = {"spec": spec, "groups": {str(k): v for k, v in groups.items()}, "already": sorted(done & set(asked)), "frames": {}}
            self._save(state)
        return state

    # One frame ------------------------------------------------------------------------------------------------------------
    def _sheet(self, frame: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The frame's crop, its manifest, and its sheet."""
        crop = layout.crop(self.stock.px.where(C("frame") == frame), self.crops)
        size = layout.sizes(crop).select(F.lit(0).cast("bigint").alias("sheet"), C("frame").alias("ord"), C("width").alias("w"), C("height").alias("h"))
        m = layout.sheet_manifest(size, self.options.scale, self.options.gap, 1, (self.options.canvas, self.options.canvas))
        return crop, m, layout.sheet(crop, m, self.options.scale, palettes.parse_hex(self.options.background))

    def finish(self, frame: int, group: list[int], answer: bytes) -> dict:
        """An answer as finished pictures of a frame and its twins: voted down, placed, mixed into the stock inside its box, hooks, recolouring. No request is made."""
        o = self.options
        crop, m, _ = self._sheet(frame)
        back = palettes.parse_hex(o.background)
        pal = palettes.table(self.spark, [c for c in (palettes.parse(o.palette) if o.palette else pipelines.palette_of(crop)) if c != back])
        drawn = readers.pixels(self.spark.createDataFrame([(0, bytearray(answer))], "frame bigint, content binary"))
        width = layout.sizes(drawn).first()["width"] / o.canvas
        down = pipelines.downscale(drawn, m, o.scale, pal, back, tol=o.tolerance, resolve=True, grain=True, register=width != 1, k0=width, reference=crop if width != 1 else None)
        stock = self.stock.px.where(C("frame") == frame)
        mask = masks.box_masks(stock, self.crops)
        done = masks.remix(layout.place(down, stock, self.crops), stock, mask, True).select("frame", "x", "y", *RGBA)
        for hook in o.hooks:
            done = hook(done, frame)
        score = masks.leftover(done, stock, mask).first()
        project.write(done, self.stock.names, os.path.join(self.root, "bake"), self.stock.sizes.where(C("frame") == frame))
        for twin in group:
            if twin != frame:
                to, fixed = palette_ops.twin_map(self.stock.px, frame, twin)
                other = palette_ops.recoloured(done.withColumn("frame", F.lit(twin).cast("bigint")), to, fixed)
                project.write(other, self.stock.names, os.path.join(self.root, "bake"), self.stock.sizes.where(C("frame") == twin))
        return {"leftover": score["leftover"] if score else 0}

    def _kept(self, frame: int) -> str:
        return os.path.join(self.root, "answers", self.stock.names[frame])

    def _drawn(self, frame: int, group: list[int], model: models.ImageModel) -> dict:
        """Asks until an answer leaves little of the stock, and keeps the best."""
        image = bytes(sinks.png_bytes(self._sheet(frame)[2]).first()["content"])
        best, retries, reason = None, 0, None
        for k in range(self.options.tries):
            data, status, more, reason = models.edited(model, image, self.options.prompt, self.options.tries)
            retries += more
            if data is None:
                if best is None:
                    return {"status": status, "reason": reason, "retries": retries, "twins": group}
                break
            score = self.finish(frame, group, data)["leftover"]
            if best is None or score < best[0]:
                best = (score, k, data)
            if score < self.options.most_leftover:
                break
        score, kept, data = best
        if kept != k:
            self.finish(frame, group, data)
        os.makedirs(os.path.dirname(self._kept(frame)), exist_ok=True)
        with open(self._kept(frame), "wb") as f:
            f.write(data)
        return {"status": "ok", "retries": retries, "leftover": score, "kept_try": kept, "twins": group}

    # Jobs -----------------------------------------------------------------------------------------------------------------
    def run(self, spec: str, model: models.ImageModel) -> dict:
        """Sends what is not settled: frames never sent, and those that failed. An exhausted quota ends the run; the next call goes on."""
        state = self.begun(spec)
        for frame, group in sorted((int(k), v) for k, v in state["groups"].items()):
            if state["frames"].get(str(frame), {}).get("status", "failed") != "failed":
                continue
            try:
                state["frames"][str(frame)] = self._drawn(frame, group, model)
            except models.Exhausted as e:
                state["frames"][str(frame)] = {"status": "failed", "reason": f"quota: {e}"[:300], "twins": group}
                self._save(state)
                break
            self._save(state)
        return self.status()

    def redo(self) -> int:
        """Finishes all kept answers again, as after a change of options."""
        state = self.state()
        again = [(int(k), v) for k, v in state.get("frames", {}).items() if v["status"] == "ok"]
        for frame, row in again:
            with open(self._kept(frame), "rb") as f:
                row |= self.finish(frame, row["twins"], f.read())
        self._save(state)
        return len(again)

    def requeue(self, frames: list[int]) -> list[int]:
        """Frames, or the drawn ones of their groups, to be sent again; their rows are put aside."""
        state = self.state()
        drawn = {g: k for k, group in state.get("groups", {}).items() for g in group}
        keys = sorted({drawn[f] for f in frames if drawn.get(f) in state["frames"]}, key=int)
        for k in keys:
            state.setdefault("requeued", {})[k] = state["frames"].pop(k)
        self._save(state)
        return [int(k) for k in keys]

    def status(self) -> dict[str, int]:
        state = self.state()
        out = {"todo": len(state.get("groups", {})) - len(state.get("frames", {}))}
        for row in state.get("frames", {}).values():
            out[row["status"]] = out.get(row["status"], 0) + 1
        return out

    def left(self) -> list[int]:
        """Frames never sent, or sent while the quota was out."""
        state = self.state()
        row = lambda k: state["frames"].get(k)
        return [int(k) for k in state.get("groups", {}) if row(k) is None or row(k)["status"] == "failed" and (row(k).get("reason") or "").startswith("quota")]


def autorun(run: Run, spec: str, model: models.ImageModel, available: Callable[[], bool], pause: float = 1800, after: Callable[[], None] | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
    """Goes on with a run whenever the service is available, until no frame is left. Returns how often it was found unavailable."""
    out = 0
    run.begun(spec)
    while run.left():
        if available():
            run.run(spec, model)
            if after:
                after()
        else:
            out += 1
            sleep(pause)
    return out
