"""Sinks: frames as PNG files, sheets, scripts and archives as bytes, GIF and strip bundles, contact sheets, reports.

Files are encoded in the tasks that hold their frames, one frame or one sheet per group; only a container's bytes, which are one file, come together in
one place."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..operators import animations, layout
from ..operators.common import C, RGB, RGBA
from . import containers, images, seal


def canvas(pdf: pd.DataFrame, width: int | None = None, height: int | None = None) -> np.ndarray:
    """Height by width by 4 of bytes of one frame's pixels; places without a pixel are clear."""
    w = int(width or pdf["x"].max() + 1)
    h = int(height or pdf["y"].max() + 1)
    out = np.zeros((h, w, 4), np.uint8)
    ok = (pdf["x"] >= 0) & (pdf["x"] < w) & (pdf["y"] >= 0) & (pdf["y"] < h)
    p = pdf[ok]
    out[p["y"], p["x"]] = p[list(RGBA)]
    return out


def png_bytes(px: DataFrame) -> DataFrame:
    """frame, content: a PNG per frame."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"frame": [pdf["frame"].iat[0]], "content": [images.encode_png(canvas(pdf))]})

    return px.groupBy("frame").applyInPandas(one, "frame bigint, content binary")


def write_pngs(px: DataFrame, folder: str, name: str = "frame_%03d.png") -> DataFrame:
    """Writes each frame to a folder all executors share, whole files at a time. Returns frame, path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            paths = [os.path.join(folder, name % f) for f in b["frame"]]
            for path, content in zip(paths, b["content"]):
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, path)
            yield pd.DataFrame({"frame": b["frame"], "path": paths})

    return png_bytes(px).mapInPandas(run, "frame bigint, path string")


def sheet_bytes(frames: DataFrame, name: str | None = None) -> DataFrame:
    """sheet, content: the sheet file of frames (sheet, idx, width, height, words, header); ``name`` seals another name."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("idx")
        header = bytes(p["header"].iat[0]) if p["header"].iat[0] is not None else b""
        header = seal.renamed(header, name) if name else header
        fs = [containers.Frame(int(w), int(h), np.asarray(x, np.uint16)) for w, h, x in zip(p["width"], p["height"], p["words"])]
        return pd.DataFrame({"sheet": [p["sheet"].iat[0]], "content": [containers.Sheet(header, fs).build()]})

    return frames.select("sheet", "idx", "width", "height", "words", "header").groupBy("sheet").applyInPandas(one, "sheet string, content binary")


def encoded_frames(px: DataFrame, frames: DataFrame, key: int, guarded: bool = False) -> DataFrame:
    """Sheet frames with words from pixels (sheet, frame, x, y, ...), sizes checked: a frame whose pixels do not fill its size fails; placeholders become one key
    word. ``frames`` has sheet, idx, width, height, header."""
    w = P.encode_word_guarded(key) if guarded else P.encode_word(key)
    cells = px.select("sheet", C("frame").cast("int").alias("idx"), "x", "y", w.alias("w"))
    per = cells.groupBy("sheet", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "w"))), lambda s: s["w"]).alias("words"), (F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    j = frames.select("sheet", "idx", "width", "height", "header").join(per, ["sheet", "idx"], "left")
    hollow = (C("width") < 0) | (C("height") < 0)
    fits = hollow | ((C("_w") == C("width")) & (C("_h") == C("height")) & (F.size("words") == C("width") * C("height")))
    checked = F.when(F.coalesce(fits, F.lit(False)), F.when(hollow, F.array(F.lit(key))).otherwise(C("words"))).otherwise(F.raise_error(F.format_string("frame %d of %s has another size", C("idx"), C("sheet"))))
    return j.select("sheet", "idx", "width", "height", checked.alias("words"), "header")


def script_bytes(steps: DataFrame, header: bytes) -> DataFrame:
    """ani, content: the script file of steps (ani, anim, step, frame, x, y, z, flag, last)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["anim", "step"])
        a, f = p["anim"].nunique(), p["step"].nunique()
        if len(p) != a * f:
            raise ValueError("animations of one script have as many steps each")
        flat = p[["frame", "x", "y", "z", "flag"]].to_numpy(np.int32).reshape(a, f, 5)
        return pd.DataFrame({"ani": [p["ani"].iat[0]], "content": [containers.Script(header, flat, p["last"].to_numpy().reshape(a, f)[:, 0]).build()]})

    return steps.groupBy("ani").applyInPandas(one, "ani string, content binary")


def round_trips(binary: DataFrame, kind: str) -> DataFrame:
    """path, status (ok, differs, skipped), names (whether the header holds the file's own name) of sheets or scripts in (path, content)."""
    parse = containers.Sheet.parse if kind == "sheet" else containers.Script.parse

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    v = parse(bytes(content))
                    same = v.build() == bytes(content)
                    rows.append((path, "ok" if same else "differs", seal.name_of(v.header) == os.path.basename(path)))
                except ValueError:
                    rows.append((path, "skipped", False))
            yield pd.DataFrame(rows, columns=["path", "status", "names"])

    return binary.select("path", "content").mapInPandas(run, "path string, status string, names boolean")


def bundle(px: DataFrame, folder: str, fps: int = 8, zoom: int = 1) -> dict:
    """A strip (sheet.png), its description (sheet.json) and an animation (anim.gif) of one animation's frames, on a shared canvas, bottoms aligned and
    centred. One animation is a few frames, so it is put together in one place."""
    places = animations.strip(layout.sizes(px))
    rows = places.orderBy("frame").collect()
    if not rows:
        raise ValueError("no frames")
    pdf = layout.upscale(px, zoom).toPandas()
    cw, ch = rows[0]["canvas_w"] // len(rows) * zoom, rows[0]["canvas_h"] * zoom
    frames = []
    for k, r in enumerate(rows):
        f = pdf[pdf["frame"] == r["frame"]].assign(x=lambda d: d["x"] + (r["x"] * zoom - k * cw), y=lambda d: d["y"] + r["y"] * zoom)  # noqa: B023
        frames.append(canvas(f, cw, ch))
    os.makedirs(folder, exist_ok=True)
    info = {"frames": len(rows), "frame": [cw, ch], "sheet": [cw * len(rows), ch], "fps": fps}
    for name, data in (("sheet.png", images.encode_png(np.concatenate(frames, axis=1))), ("anim.gif", images.encode_gif(frames, fps)), ("sheet.json", json.dumps(info).encode())):
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)
    return info


def contact_sheet(px: DataFrame, zoom: int = 4, gap: int = 4, per_row: int = 8, bg: tuple[int, int, int] = (64, 64, 64)) -> DataFrame:
    """Pixels (frame 0) of all frames enlarged side by side, ``per_row`` a row."""
    n = layout.sizes(px)
    k = n.count()
    m = layout.sheet_manifest(n.select(F.lit(0).cast("bigint").alias("sheet"), C("frame").alias("ord"), C("width").alias("w"), C("height").alias("h")), zoom, gap, max(1, -(-k // per_row)))
    return layout.sheet(px, m, zoom, bg)


def review_sheet(stock: DataFrame, result: DataFrame, zoom: int = 4, gap: int = 4) -> DataFrame:
    """Pixels (frame 0): a row of stock frames over a row of their results, for frames that have one."""
    both = result.select("frame").distinct()
    top = stock.join(both, "frame", "left_semi")
    n = layout.sizes(top).join(layout.sizes(result).select("frame", C("width").alias("w2"), C("height").alias("h2")), "frame")
    n = n.select("frame", F.greatest("width", "w2").alias("w"), F.greatest("height", "h2").alias("h"))
    beyond = (both.agg(F.max("frame")).first()[0] or 0) + 1  # results are numbered after all stock frames
    one = F.lit(0).cast("bigint").alias("sheet")
    frames = n.select(one, C("frame").alias("ord"), "w", "h").unionByName(n.select(one, (C("frame") + beyond).alias("ord"), "w", "h"))
    px = top.select("frame", "x", "y", *RGBA).unionByName(result.select((C("frame") + beyond).alias("frame"), "x", "y", *RGBA))
    return layout.sheet(px, layout.sheet_manifest(frames, zoom, gap, 2), zoom, (64, 64, 64))


#: Digits of three by five, rows as octal digits from the top.
_GLYPHS = [0o75557, 0o26227, 0o71747, 0o71717, 0o55711, 0o74717, 0o74757, 0o71111, 0o75757, 0o75717]


def review_sheets(stock: DataFrame, result: DataFrame, steps: DataFrame, zoom: int = 4, per_row: int = 8, bg: tuple[int, int, int] = (60, 60, 60)) -> DataFrame:
    """Pixels of a sheet per animation (frame is the animation): every frame that it plays and that has a result, in order, its stock over its result and its
    number above both, ``per_row`` a row. All sheets come from one plan; an animation is a few frames."""
    order = Window.partitionBy("anim")
    seq = animations.played(steps).groupBy("anim", C("frame").cast("bigint").alias("frame")).agg(F.min("step").alias("step")).join(result.select("frame").distinct(), "frame").join(layout.sizes(stock), "frame")
    cells = seq.select("anim", "frame", C("height").alias("_h"), (F.row_number().over(order.orderBy("step")) - 1).alias("k"), (F.max("width").over(order) * zoom + 8).alias("cw"), ((F.max("height").over(order) * 2 + 2) * zoom + 22).alias("ch"), F.count("*").over(order).alias("n"))
    cells = cells.withColumns({"ox": C("k") % per_row * C("cw") + 4, "oy": F.floor(C("k") / per_row).cast("int") * C("ch") + 20})
    drawn = stock.select("frame", "x", "y", *RGBA).withColumn("_low", F.lit(0)).unionByName(result.select("frame", "x", "y", *RGBA).withColumn("_low", F.lit(1))).where("a > 0")
    spread = F.explode(F.sequence(F.lit(0), F.lit(zoom - 1)))
    drawn = drawn.join(cells, "frame").withColumn("y", C("y") + C("_low") * (C("_h") + 2)).withColumn("dx", spread).withColumn("dy", spread)
    drawn = drawn.select("anim", (C("ox") + C("x") * zoom + C("dx")).cast("int").alias("x"), (C("oy") + C("y") * zoom + C("dy")).cast("int").alias("y"), *[P.over(C(c), F.lit(v), C("a")).cast("int").alias(c) for c, v in zip(RGB, bg)])
    letters = cells.select("anim", "ox", "oy", F.posexplode(F.split(C("frame").cast("string"), "")).alias("i", "d")).where("d <> ''")
    bits = letters.select("anim", "ox", "oy", "i", F.element_at(F.array(*[F.lit(g) for g in _GLYPHS]), C("d").cast("int") + 1).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(14))).alias("bit")).where((F.call_function("shiftright", C("g"), 14 - C("bit")) % 2) == 1)
    label = bits.select("anim", (C("ox") + (C("i") * 4 + C("bit") % 3) * 2).cast("int").alias("x"), (C("oy") - 14 + F.floor(C("bit") / 3) * 2).cast("int").alias("y"))
    label = label.withColumn("x", F.explode(F.array("x", C("x") + 1))).withColumn("y", F.explode(F.array("y", C("y") + 1))).select("anim", "x", "y", *[F.lit(255).alias(c) for c in RGB])
    area = cells.groupBy("anim").agg((F.max("cw") * F.least(F.max("n"), F.lit(per_row))).cast("int").alias("w"), (F.max("ch") * F.ceil(F.max("n") / per_row)).cast("int").alias("h"))
    area = area.withColumn("x", F.explode(F.sequence(F.lit(0), C("w") - 1))).withColumn("y", F.explode(F.sequence(F.lit(0), C("h") - 1))).select("anim", "x", "y")
    out = area.join(drawn.unionByName(label), ["anim", "x", "y"], "left")
    return out.select(C("anim").cast("bigint").alias("frame"), "x", "y", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in zip(RGB, bg)], F.lit(255).alias("a"))


def editor_layers(px: DataFrame, box: tuple[int, int]) -> DataFrame:
    """frame, x, y, r, g, b, a, and per pixel ``outside`` and ``partial``: ordered layers (frame, layer, x, y, r, g, b, a; hidden and reference layers left out by the
    caller) laid over each other, those off the frame's box and those neither clear nor opaque marked. Layers are few, and fold in order per place."""
    items = F.array_sort(F.collect_list(F.struct("layer", *RGBA)))
    s = px.groupBy("frame", "x", "y").agg(items.alias("l"))
    zero = F.struct(*[F.lit(0).alias(c) for c in RGBA])

    def lay(acc, q):
        a = q["a"]
        return F.struct(*[F.when(acc["a"] == 0, q[c]).otherwise(P.over(q[c], acc[c], a)).alias(c) for c in "rgb"], (a + P.div(acc["a"] * (255 - a) + 127, 255)).alias("a"))

    top = F.aggregate(F.filter("l", lambda q: q["a"] > 0), zero, lay)
    s = s.withColumn("t", top).select("frame", "x", "y", *[C(f"t.{c}").alias(c) for c in RGBA])
    return s.withColumn("outside", (C("x") < 0) | (C("y") < 0) | (C("x") >= box[0]) | (C("y") >= box[1])).withColumn("partial", (C("a") > 0) & (C("a") < 255))
