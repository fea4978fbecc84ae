"""Sprites through an image model: creating one or a set, redrawing frames of an animation, cleaning what comes back.

The model is any object of the :class:`tessella.sources.models.ImageModel` protocol. One sprite is a handful of frames, so each step's files
are few; pixels go through the same operators as whole corpora do."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import project
from .functions import palettes, pixels as P
from .operators import components, layout, masks, palette_ops, pipelines
from .operators.common import C, RGBA
from .sources import images, models, sinks

CANVAS = 1024


def _pixels(spark: SparkSession, data: bytes, frame: int = 0) -> DataFrame:
    from .sources import readers

    return readers.pixels(spark.createDataFrame([(frame, bytearray(data))], "frame bigint, content binary"))


def _palette(spark: SparkSession, spec: str | None, extra: list[tuple[int, int, int]] = ()) -> DataFrame | None:
    return palettes.table(spark, [*palettes.parse(spec), *extra]) if spec else None


def cleaned(px: DataFrame, width: int, height: int, colours: int, palette: DataFrame | None, bg: tuple[int, int, int]) -> DataFrame:
    """A model's drawing as a sprite: background keyed out, fitted to the canvas, on the palette or in so many colours."""
    px = px.select("frame", "x", "y", *P.keyed_out(bg))
    return pipelines.pixelize(px, width, height, colours, palette)


def create(spark: SparkSession, model: models.ImageModel, prompt: str, out: str, size: tuple[int, int] = (32, 32), variants: int = 1, palette: str | None = None, colours: int = 16, name: str = "sprite") -> list[str]:
    """Variants of a sprite as files."""
    pal = _palette(spark, palette)
    back = palettes.pick_background(palettes.parse(palette) if palette else [])
    made = []
    for k in range(variants):
        data = model.generate(f"{prompt} One sprite, alone, in flat pixel art on plain {back}.")
        file = f"{name}.png" if variants == 1 else f"{name}_{k + 1}.png"
        px = cleaned(_pixels(spark, data), *size, colours, pal, palettes.BACKGROUNDS[back])
        full = spark.createDataFrame([(0, *size)], "frame bigint, width int, height int")
        project.write(px, [file], out, full)
        made.append(file)
    return made


def create_set(spark: SparkSession, model: models.ImageModel, spec: str, out: str, size: tuple[int, int] = (32, 32), palette: str | None = None, colours: int = 16, theme: str = "") -> list[str]:
    """A sprite per ``name=description`` item, drawn as one picture so that they match, then cut into cells; colours are chosen once for the whole set."""
    items = models.items(spec)
    cols = math.ceil(math.sqrt(len(items)))
    rows = -(-len(items) // cols)
    back = palettes.pick_background(palettes.parse(palette) if palette else [])
    listing = "; ".join(f"{i + 1}. {text}" for i, (_, text) in enumerate(items))
    data = model.generate(f"{theme} A set of {len(items)} sprites in {rows} rows and {cols} columns on plain {back}, in reading order: {listing}".strip())
    px = _pixels(spark, data).select("frame", "x", "y", *P.keyed_out(palettes.BACKGROUNDS[back]))
    px = palette_ops.nearest(px, _palette(spark, palette)) if palette else palette_ops.reduce_colours(px, colours)
    h, w = images.decode_png(data).shape[:2]
    cells = components.split_cells(px, w, h, rows, cols).where(C("cell") < len(items)).select(C("cell").cast("bigint").alias("frame"), "x", "y", *RGBA)
    sizes = spark.createDataFrame([(i, *size) for i in range(len(items))], "frame bigint, width int, height int")
    project.write(layout.fit(cells, *size), [f"{n}.png" for n, _ in items], out, sizes)
    return [n for n, _ in items]


def redrawn(spark: SparkSession, model: models.ImageModel, frames: DataFrame, task: str, palette: DataFrame, rows: int = 1, min_region: int = 8, locked: list[tuple[int, int, int, int]] = (), first: bool = True, gap: int = 6) -> DataFrame:
    """Frames redrawn by a model as one sheet and brought back to pixels: voted down, keyed out, small differences from the given frame put back, locked boxes
    restored; with ``first``, frame 0 stays as it was."""
    pal = palettes.listed(palette)
    back = palettes.BACKGROUNDS[palettes.pick_background(pal)]
    f = layout.sizes(frames)
    one = F.lit(0).cast("bigint").alias("sheet")
    at = f.select(one, C("frame").alias("ord"), C("width").alias("w"), C("height").alias("h"))
    strip = layout.sheet_manifest(at, 1, gap, rows).agg(F.max("canvas_w"), F.max("canvas_h")).first()
    scale = max(1, CANVAS // max(strip))
    m = layout.sheet_manifest(at, scale, gap, rows)
    data = bytes(sinks.png_bytes(layout.sheet(frames, m, scale, back)).first()["content"])
    answer = model.edit(data, models.sheet_prompt(task, f.count(), rows, scale, palettes.to_hex([back])))
    k0 = images.decode_png(answer).shape[1] / images.decode_png(data).shape[1]
    v = pipelines.downscale(_pixels(spark, answer), m, scale, palette, back, tol=24, metric="redmean", resolve=True, grain=True, register=k0 != 1, k0=k0, reference=frames if k0 != 1 else None)
    v = v.select("frame", "x", "y", *P.keyed_out(back))
    v = components.stabilize(v, frames, min_region).drop("reverted")
    if locked:
        v = masks.lock(v, frames, list(locked))
    return frames.where("frame = 0").unionByName(v.where("frame > 0")) if first else v


def animate(spark: SparkSession, model: models.ImageModel, path: str, out: str, prompt: str, frames: int = 4, rows: int | None = None, pad: str = "0", palette: str | None = None, fps: int = 8, min_region: int = 8, locked: list[tuple[int, int, int, int]] = (), redraw_first: bool = False) -> dict:
    """A loop from one sprite: padded, repeated, redrawn, bundled as a strip, a GIF and a description."""
    f = project.Folder(spark, path)
    left, top, right, bottom = layout.parse_pad(pad)
    s = f.sizes.first()
    base = layout.pad(f.px.where("frame = 0"), pad)
    corner = spark.createDataFrame([(0, 0, 0, 0, 0, 0, 0), (0, s["width"] + left + right - 1, s["height"] + top + bottom - 1, 0, 0, 0, 0)], "frame bigint, x int, y int, r int, g int, b int, a int")
    base = base.unionByName(corner.join(base.select("x", "y"), ["x", "y"], "left_anti").select("frame", "x", "y", *RGBA))
    copies = base.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))).withColumn("frame", C("frame").cast("bigint"))
    own = pipelines.palette_of(f.px)
    pal = palettes.table(spark, list(dict.fromkeys([*own, *(palettes.parse(palette) if palette else [])])))
    done = redrawn(spark, model, copies.select("frame", "x", "y", *RGBA), prompt, pal, rows or max(1, round(math.sqrt(frames))), min_region, locked, not redraw_first)
    return sinks.bundle(done, out, fps)


def edit(spark: SparkSession, model: models.ImageModel, path: str, out: str, prompt: str, palette: str | None = None) -> str:
    """One sprite redrawn."""
    f = project.Folder(spark, path)
    own = pipelines.palette_of(f.px)
    pal = palettes.table(spark, list(dict.fromkeys([*own, *(palettes.parse(palette) if palette else [])])))
    done = redrawn(spark, model, f.px.where("frame = 0"), prompt, pal, first=False)
    project.write(done, [f.names[0]], out, f.sizes.where("frame = 0"))
    return os.path.join(out, f.names[0])
