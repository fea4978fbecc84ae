"""Whole jobs on folders: what the command line offers, as functions from paths and options to files.

Pictures pair up by name. A folder's pictures are numbered in order of their names for the operators and get their names back when written."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import palettes, pixels as P
from .operators import animations, components, layout, masks, palette_ops, pipelines, votes
from .operators.common import C, RGB, RGBA
from .sources import containers, images, readers, sinks


class Folder:
    """The pictures of a folder (or one file): names in order, and their pixels by number."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        p = readers.pngs(spark, path)
        self.names = [r["file"] for r in p.select("file").orderBy("path").collect()]
        number = F.create_map(*[x for i, n in enumerate(self.names) for x in (F.lit(n), F.lit(i))])
        self.px = readers.pixels(p.withColumn("frame", number[C("file")]))
        self.sizes = layout.sizes(self.px)

    def matched(self, names: list[str]) -> DataFrame:
        """Pixels numbered as in another list of names; pictures that it lacks are left out."""
        pairs = [(i, names.index(n)) for i, n in enumerate(self.names) if n in names]
        m = self.px.sparkSession.createDataFrame(pairs, "frame bigint, _to bigint")
        return self.px.join(m, "frame").select(C("_to").alias("frame"), "x", "y", *RGBA)


def write(px: DataFrame, names: list[str], folder: str, sizes: DataFrame | None = None) -> int:
    """Pictures under their names; places that lost their pixel are clear, up to the size given."""
    if sizes is not None:
        corner = sizes.select("frame", (C("width") - 1).alias("x"), (C("height") - 1).alias("y"), *[F.lit(0).alias(c) for c in RGBA])
        px = px.select("frame", "x", "y", *RGBA).unionByName(corner.join(px.select("frame", "x", "y"), ["frame", "x", "y"], "left_anti").select("frame", "x", "y", *RGBA))
    os.makedirs(folder, exist_ok=True)
    n = 0
    for r in sinks.png_bytes(px).toLocalIterator():
        with open(os.path.join(folder, names[r["frame"]]), "wb") as f:
            f.write(bytes(r["content"]))
        n += 1
    return n


def report(df: DataFrame, names: list[str], path: str | None) -> list[dict]:
    """Rows with their file names, also as a JSON file where a path is given."""
    rows = [{"file": names[r["frame"]], **{k: v for k, v in r.asDict(True).items() if k != "frame"}} for r in df.orderBy("frame").collect()]
    if path:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(rows, f, indent=1)
    return rows


def palette_from(spark: SparkSession, ref: str | None = None, spec: str | None = None, key: tuple[int, int, int] | None = None) -> DataFrame:
    """A palette of reference pictures, or of a preset, hex colours, or a palette file; without the key colour."""
    if ref:
        colours = pipelines.palette_of(Folder(spark, ref).px)
    elif spec and os.path.isfile(spec):
        with open(spec, encoding="utf-8") as f:
            colours = palettes.parse(f.read(), round_16=True)
    elif spec:
        colours = palettes.parse(spec, round_16=True)
    else:
        raise ValueError("a palette or reference pictures are needed")
    colours = [c for c in colours if c != key]
    if not colours:
        raise ValueError("the palette is empty")
    return palettes.table(spark, colours)


KEYS = {"cyan": containers.KEY_CYAN, "black": containers.KEY_BLACK, "none": None, "auto": "auto"}


def parse_key(text: str) -> int | str | None:
    """auto, none, cyan, black, 0xHHHH or a number."""
    return KEYS[text] if text in KEYS else int(text, 0)


def key_colour(text: str) -> tuple[int, int, int] | None:
    k = parse_key(text)
    return None if not isinstance(k, int) else palettes.canonical(((k >> 11) << 3, (k >> 5 & 63) << 2, (k & 31) << 3))


def info(path: str) -> dict:
    """What a sheet or an archive holds."""
    with open(path, "rb") as f:
        data = f.read()
    if path.endswith(".ark"):
        return {"members": [{"name": m.name, "size": len(m.content), "compressed": m.compressed} for m in containers.members(data)]}
    s = containers.Sheet.parse(data)
    sizes: dict[str, int] = {}
    for f_ in s.frames:
        sizes[f"{f_.width}x{f_.height}"] = sizes.get(f"{f_.width}x{f_.height}", 0) + 1
    return {"name": readers.seal.name_of(s.header), "frames": len(s.frames), "sizes": sizes, "keys": [f_.guessed_key() for f_ in s.frames[:4]], "trailing": s.trailing}


def import_sheet(spark: SparkSession, path: str, out: str, key: str = "cyan") -> dict:
    """A sheet as frame_NNN.png files and manifest.json."""
    s = readers.sheets(spark.read.format("binaryFile").load(path))
    rows = s.select("idx", "width", "height", "placeholder", "guessed_key", "header", "error").orderBy("idx").collect()
    if rows and rows[0]["error"]:
        raise ValueError(rows[0]["error"])
    names = {r["idx"]: f"frame_{r['idx']:03d}.png" for r in rows}
    write(readers.sheet_pixels(s, parse_key(key)).drop("sheet"), [names.get(i, "") for i in range(max(names, default=-1) + 1)], out)
    m = {"source": os.path.basename(path), "header_hex": bytes(rows[0]["header"]).hex() if rows else "", "colorkey": key, "frames": [{"index": r["idx"], "file": None if r["placeholder"] else names[r["idx"]], "width": r["width"], "height": r["height"], "placeholder": r["placeholder"], "guessed_key": r["guessed_key"], "anchors": []} for r in rows]}
    with open(os.path.join(out, "manifest.json"), "w", encoding="utf-8") as f:
        json.dump(m, f, indent=1)
    return m


def export_sheet(spark: SparkSession, folder: str, out: str, keep_header: bool = False) -> int:
    """The sheet of a folder written by :func:`import_sheet`; a picture of another size than its frame fails."""
    with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
        m = json.load(f)
    k = parse_key(m["colorkey"])
    frames, header = [], bytes.fromhex(m["header_hex"])
    for e in m["frames"]:
        key = e["guessed_key"] if k == "auto" else k
        if e["placeholder"]:
            frames.append((os.path.basename(out), e["index"], e["width"], e["height"], [key or 0], bytearray(header)))
    f = Folder(spark, folder)
    at = {e["file"]: e for e in m["frames"] if e["file"]}
    px = f.px.select(F.lit(os.path.basename(out)).alias("sheet"), F.create_map(*[x for i, n in enumerate(f.names) if n in at for x in (F.lit(i), F.lit(at[n]["index"]))])[C("frame").cast("int")].alias("frame"), "x", "y", *RGBA).where("frame is not null")
    size = spark.createDataFrame([(os.path.basename(out), e["index"], e["width"], e["height"], bytearray(header)) for e in m["frames"]], "sheet string, idx int, width int, height int, header binary")
    enc = sinks.encoded_frames(px, size, k if isinstance(k, int) else 0)
    if k is None or k == "auto":  # without one key for all, each frame's own word for clear pixels
        guess = spark.createDataFrame([(e["index"], e["guessed_key"]) for e in m["frames"]], "idx int, _k int")
        cells = px.join(guess, C("frame") == C("idx")).withColumn("w", F.when((C("a") == 0) & C("_k").isNotNull(), C("_k")).otherwise(P.to_565(C("r"), C("g"), C("b"))))
        per = cells.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "w"))), lambda s: s["w"]).alias("_words"))
        enc = enc.join(per, "idx", "left").withColumn("words", F.coalesce("_words", "words")).drop("_words")
    name = None if keep_header else os.path.basename(out)
    data = bytes(sinks.sheet_bytes(enc, name).first()["content"])
    with open(out, "wb") as g:
        g.write(data)
    return len(m["frames"])


def sheet(spark: SparkSession, folder: str, out: str, scale: int = 3, gap: int = 6, rows: int = 1, bg: str = "808080", canvas: tuple[int, int] | None = None) -> dict:
    """One picture of all pictures of a folder, enlarged, and its manifest."""
    f = Folder(spark, folder)
    if not 1 <= rows <= len(f.names):
        raise ValueError(f"rows from 1 to {len(f.names)}")
    m = layout.sheet_manifest(f.sizes.select(F.lit(0).cast("bigint").alias("sheet"), C("frame").alias("ord"), C("width").alias("w"), C("height").alias("h")), scale, gap, rows, canvas)
    places = m.orderBy("ord").collect()
    if canvas and (min(p["x"] for p in places) < 0 or min(p["y"] for p in places) < 0):
        raise ValueError("the canvas is smaller than the frames")
    write(layout.sheet(f.px, m, scale, palettes.parse_hex(bg)), [os.path.basename(out)], os.path.dirname(out) or ".")
    d = {"scale": scale, "gap": gap, "background": bg, "canvas": [places[0]["canvas_w"], places[0]["canvas_h"]], "frames": [{"file": f.names[p["ord"]], **{k: p[k] for k in "xywh"}} for p in places]}
    with open(os.path.splitext(out)[0] + ".json", "w", encoding="utf-8") as g:
        json.dump(d, g, indent=1)
    return d


def _manifest(spark: SparkSession, path: str) -> tuple[dict, DataFrame, list[str]]:
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    return d, spark.createDataFrame([(0, i, e["x"], e["y"], e["w"], e["h"]) for i, e in enumerate(d["frames"])], "sheet bigint, ord int, x int, y int, w int, h int"), [e["file"] for e in d["frames"]]


def unsheet(spark: SparkSession, path: str, out: str, manifest: str | None = None) -> int:
    d, m, names = _manifest(spark, manifest or os.path.splitext(path)[0] + ".json")
    f = Folder(spark, path)
    s = f.sizes.first()
    if [s["width"], s["height"]] != d["canvas"]:
        raise ValueError(f"the sheet is {s['width']} by {s['height']}, its manifest says {d['canvas']}")
    return write(layout.unsheet(f.px, m, d["scale"]), names, out)


def downscale(spark: SparkSession, path: str, out: str, manifest: str | None = None, *, ref: str | None = None, palette: str | None = None, bg: str | None = None, colorkey: str = "cyan", weak: float = 0.6, tol: int = 0, metric: str = "rgb", resolve: bool = False, grain: bool = False, register: bool = False, despeckle: bool = False, confidence: str | None = None, report_path: str | None = None) -> list[dict]:
    """Frames of a sheet picture back at one pixel per block, with a report per frame."""
    d, m, names = _manifest(spark, manifest or os.path.splitext(path)[0] + ".json")
    f = Folder(spark, path)
    s = f.sizes.first()
    kx, ky = s["width"] / d["canvas"][0], s["height"] / d["canvas"][1]
    if abs(kx - ky) > 0.01 * max(kx, ky):
        raise ValueError(f"the sheet was resized by {kx:.3f} across and {ky:.3f} down")
    back, keyed = palettes.parse_hex(bg or d["background"]), key_colour(colorkey)
    pal = palettes.without(palette_from(spark, ref, palette, keyed), back)
    px = f.px
    reference = Folder(spark, ref).matched(names) if ref and os.path.isdir(ref) else None
    args = dict(keyed=keyed, tol=tol, metric=metric)
    v = votes.vote(px, m, d["scale"], pal, back, *args.values()) if kx == 1 else None
    frames = pipelines.downscale(px, m, d["scale"], pal, back, **args, weak=weak, resolve=resolve, grain=grain, despeckle=despeckle, register=register, k0=kx, reference=reference)
    sizes = m.select(C("ord").alias("frame"), C("w").alias("width"), C("h").alias("height"))
    write(frames, names, out, sizes)
    if v is None:
        return []
    if confidence:
        c = votes.to_px(v).select("frame", "x", "y").join(v.select("frame", C("i").alias("x"), C("j").alias("y"), "share"), ["frame", "x", "y"])
        write(c.select("frame", "x", "y", *[k.alias(n) for k, n in zip(P.confidence_colour(C("share"), weak), RGBA)]), names, confidence, sizes)
    r = votes.counters(v, weak).join(votes.histogram(v), "frame", "left")
    if reference is not None:
        r = r.join(votes.silhouette(frames, reference), "frame", "left")
    return report(r, names, report_path)


def conform(spark: SparkSession, folder: str, out: str, *, ref: str | None = None, palette: str | None = None, canvas: tuple[int, int] | None = None, colorkey: str = "cyan", key: str | None = None, threshold: int = 128, report_path: str | None = None) -> list[dict]:
    f = Folder(spark, folder)
    done = palette_ops.conform(f.px, palette_from(spark, ref, palette), threshold, key_colour(colorkey), palettes.parse_hex(key) if key else None)
    px = done.select("frame", "x", "y", *RGBA)
    if canvas:
        px = layout.refit(px, *canvas, frames=f.sizes)
    size = f.sizes.select("frame", *[F.lit(c).alias(n) for c, n in zip(canvas, ("width", "height"))]) if canvas else f.sizes
    write(px, f.names, out, size)
    return report(palette_ops.conform_report(done), f.names, report_path)


def _regions(f: Folder, spec: dict) -> dict[int, list[dict]]:
    stems = {os.path.splitext(n)[0]: i for i, n in enumerate(f.names)}
    return {stems[k]: v if isinstance(v, list) else [v] for k, v in spec.items() if k in stems}


def _masks(spark: SparkSession, f: Folder, spec: dict[int, list[dict]], px: DataFrame) -> DataFrame:
    polys, lines = masks.edges(spec)
    s = f.sizes.agg(F.max("width"), F.max("height")).first()
    return masks.rasterised(px, spark.createDataFrame(polys, masks.SPEC), spark.createDataFrame(lines, masks.LINES), s[0], s[1])


def mask(spark: SparkSession, folder: str, out: str, spec: dict, overlay: str | None = None) -> int:
    """White on black mask pictures of a polygon spec by file stem."""
    f = Folder(spark, folder)
    m = _masks(spark, f, _regions(f, spec), f.px).select("frame", "x", "y", F.lit(1).alias("_m")).distinct()
    if m.limit(1).count() == 0:
        raise ValueError("all masks are empty")
    j = f.px.join(m, ["frame", "x", "y"], "left")
    on = C("_m").isNotNull()
    if overlay:
        write(j.select("frame", "x", "y", *[F.when(on, v).otherwise(C(c)).alias(c) for c, v in zip(RGBA, (255, 60, 60, 255))]), f.names, overlay)
    return write(j.select("frame", "x", "y", *[F.when(on, 255).otherwise(0).alias(c) for c in RGB], F.lit(255).alias("a")), f.names, out)


def remix(spark: SparkSession, edited: str, out: str, orig: str, mask_dir: str, alpha: bool = False, report_path: str | None = None) -> list[dict]:
    o = Folder(spark, orig)
    e, m = Folder(spark, edited), Folder(spark, mask_dir)
    ids = [i for i, n in enumerate(o.names) if n in e.names]
    op = o.px.where(C("frame").isin(ids))
    bad = layout.sizes(e.matched(o.names)).join(o.sizes.select("frame", C("width").alias("w"), C("height").alias("h")), "frame").where("width <> w or height <> h")
    if bad.limit(1).count():
        raise ValueError("an edit has another size than its original")
    done = masks.remix(e.matched(o.names), op, m.matched(o.names).where("r >= 128").select("frame", "x", "y"), alpha)
    write(done.select("frame", "x", "y", *RGBA), o.names, out)
    r = done.groupBy("frame").agg(F.sum(C("inside").cast("int")).alias("mask_px"), F.sum(C("taken").cast("int")).alias("taken_px")).join(masks.seam(done, op), "frame", "left")
    return report(r, o.names, report_path)


def recolour(spark: SparkSession, folder: str, out: str, spec: dict) -> int:
    """Regions of a spec by file stem (add, sub, sub_lines, ramp, thresholds) painted in order."""
    f = Folder(spark, folder)
    px, rules = f.px, _regions(f, spec)
    for k in range(max((len(v) for v in rules.values()), default=0)):
        for frame, regions in rules.items():
            if k < len(regions):
                r = regions[k]
                m = _masks(spark, f, {frame: [r]}, px)
                px = masks.recolour_region(px, m, [palettes.parse_hex(c) for c in r["ramp"]], r.get("thresholds")).drop("bin")
    return write(px, f.names, out)


def compose(spark: SparkSession, folder: str, out: str, ops: list[dict], base: str = ".") -> int:
    """An op list over every picture; sources are folders (by number) and single pictures, relative to ``base``."""
    f = Folder(spark, folder)
    src: dict[str, DataFrame] = {}
    for op in ops:
        for k in ("from", "png"):
            if op.get(k) and op[k] not in src:
                px = Folder(spark, os.path.join(base, op[k])).px
                src[op[k]] = px.drop("frame") if k == "png" else px
    return write(layout.compose(f.px, ops, src), f.names, out)


def lift(spark: SparkSession, out: str, over: str, under: str, control: str, min_alpha: float = 0.08, passes: int = 2) -> int:
    """The layer that ``over`` has over ``under``, as one picture."""
    from .operators.neighbourhood import lift_noise

    o = Folder(spark, over)
    layer = layout.lift(o.px, Folder(spark, under).matched(o.names), Folder(spark, control).matched(o.names), min_alpha)
    layer = lift_noise(layer.select(F.lit(0).cast("bigint").alias("frame"), "x", "y", *RGBA), passes)
    s = o.sizes.agg(F.max("width").alias("width"), F.max("height").alias("height")).select(F.lit(0).cast("bigint").alias("frame"), "width", "height")
    return write(layer, [os.path.basename(out)], os.path.dirname(out) or ".", s)


def snap(spark: SparkSession, folder: str, out: str, *, ref: str | None = None, palette: str | None = None, colours: int = 16, pixel_size: float | None = None, flatten: str = "auto", force: bool = False) -> int:
    f = Folder(spark, folder)
    if ref or palette:
        pal = palette_from(spark, ref, palette)
    else:
        counts = f.px.where(P.opaque()).groupBy(*[P.shl(P.shr(C(c), 3), 3).alias(c) for c in RGB]).count().collect()
        pal = palettes.table(spark, palettes.median_cut(sorted(((r["r"], r["g"], r["b"]), r["count"]) for r in counts), colours))
    bg = palettes.furthest(palettes.listed(pal)) if flatten == "auto" else palettes.parse_hex(flatten)
    return write(pipelines.snap(f.px, pal, bg, pixel_size, force=force), f.names, out)


def pixelize(spark: SparkSession, path: str, out: str, width: int = 32, height: int = 32, colours: int = 16, palette: str | None = None) -> int:
    f = Folder(spark, path)
    px = pipelines.pixelize(f.px, width, height, colours, palette_from(spark, None, palette) if palette else None)
    return write(px, f.names, out, f.sizes.select("frame", F.lit(width).alias("width"), F.lit(height).alias("height")))


def split(spark: SparkSession, path: str, rows: int, cols: int, out: str) -> int:
    """One picture per cell of a set."""
    f = Folder(spark, path)
    s = f.sizes.first()
    cells = components.split_cells(f.px, s["width"], s["height"], rows, cols).select(C("cell").cast("bigint").alias("frame"), "x", "y", *RGBA)
    return write(layout.trim(cells), [f"cell_{k:02d}.png" for k in range(rows * cols)], out)


def verify(spark: SparkSession, folder: str) -> dict:
    """Counts of sheets and scripts by whether they parse and rebuild to the same bytes."""
    out: dict[str, dict] = {}
    for kind, glob in (("sheet", "*.spr"), ("script", "*.ani")):
        b = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
        t = sinks.round_trips(b, kind)
        out[kind] = {r["status"]: r["n"] for r in t.groupBy("status").agg(F.count("*").alias("n")).collect()} | {"misnamed": t.where("status = 'ok' and not names").count()}
    return out


def show_script(path: str) -> dict:
    """A script as JSON: per, anims of last and steps."""
    with open(path, "rb") as f:
        s = containers.Script.parse(f.read())
    keys = ("frame", "x", "y", "z", "flag")
    return {"header_hex": s.header.hex(), "per": s.steps.shape[1], "anims": [{"last": int(k), "steps": [dict(zip(keys, map(int, v))) for v in a]} for k, a in zip(s.last, s.steps)]}


def build_script(d: dict, out: str, keep_header: bool = False) -> None:
    import numpy as np

    steps = np.array([[[s[k] for k in ("frame", "x", "y", "z", "flag")] for s in a["steps"]] for a in d["anims"]], np.int32)
    header = bytes.fromhex(d.get("header_hex", ""))
    header = header if keep_header and len(header) == 64 else readers.seal.renamed(header, os.path.basename(out))
    with open(out, "wb") as f:
        f.write(containers.Script(header, steps, np.array([a["last"] for a in d["anims"]], np.int32)).build())


def pack(folder: str, out: str, store: bool = False) -> int:
    """An archive of a folder's files, by name."""
    items = []
    for n in sorted(os.listdir(folder)):
        with open(os.path.join(folder, n), "rb") as f:
            items.append(containers.Member(n, f.read(), compressed=not store))
    containers.write_archive(out, items)
    return len(items)


def prepare(spark: SparkSession, folder: str, out: str) -> dict:
    """Stock pictures, crop boxes, names and the animation table of a folder of PNGs; what is there already is kept."""
    p = readers.project(spark, folder)
    rows = p.select("anim", "step", "frame", "rel_path").orderBy("frame").collect()
    px = readers.pixels(p)
    os.makedirs(out, exist_ok=True)
    size = {r["frame"]: r for r in layout.sizes(px).collect()}
    box = {str(r["frame"]): [r["cx"], r["cy"], r["cw"], r["ch"]] for r in layout.boxes(px).collect()}
    anims: dict[int, list[dict]] = {}
    for r in rows:
        s = size[r["frame"]]
        anims.setdefault(r["anim"], []).append({"frame": r["frame"], "x": s["width"] // 2, "y": s["width"] - s["width"] // 2, "z": s["height"], "flag": 3})
    per = max((len(a) for a in anims.values()), default=0)
    blank = {"frame": -1, "x": 0, "y": 0, "z": 0, "flag": 3}
    table = {"per": per, "anims": [{"last": len(a) - 1, "steps": a + [blank] * (per - len(a))} for a in anims.values()]}
    for name, d in (("anim.json", table), ("crops.json", box), ("frames.json", {str(r["frame"]): r["rel_path"] for r in rows})):
        path = os.path.join(out, name)
        if not os.path.exists(path):
            with open(path, "w", encoding="utf-8") as f:
                json.dump(d, f, indent=1)
    stock = os.path.join(out, "stock")
    if not os.path.isdir(stock):
        write(px, [f"frame_{i:03d}.png" for i in range(len(rows))], stock)
    return table


def steps_of(spark: SparkSession, path: str) -> DataFrame:
    """The steps of an animation table, with each animation's last."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    return spark.createDataFrame([(a, k, s["frame"], s["x"], s["y"], s["z"], s.get("flag", 3), x["last"]) for a, x in enumerate(d["anims"]) for k, s in enumerate(x["steps"])], "anim int, step int, frame int, x int, y int, z int, flag int, last int")


def smooth(spark: SparkSession, project: str, done: str, out: str) -> int:
    """Finished pictures of a prepared project carried along its animations."""
    stock, drawn = Folder(spark, os.path.join(project, "stock")), Folder(spark, done)
    px = pipelines.smooth(stock.px, drawn.matched(stock.names), layout.boxes(stock.px), steps_of(spark, os.path.join(project, "anim.json")))
    return write(px, stock.names, out)


def review(spark: SparkSession, project: str, done: str, out: str, zoom: int = 4) -> int:
    """A sheet per animation of a prepared project: stock over finished pictures, with frame numbers."""
    stock, finished = Folder(spark, os.path.join(project, "stock")), Folder(spark, done)
    steps = steps_of(spark, os.path.join(project, "anim.json"))
    sheets = sinks.review_sheets(stock.px, finished.matched(stock.names), steps, zoom)
    n = steps.agg(F.max("anim")).first()[0]
    return write(sheets, [f"anim_{k:02d}.png" for k in range((n if n is not None else -1) + 1)], out)


def bundle(spark: SparkSession, folder: str, out: str, fps: int = 8, zoom: int = 1) -> dict:
    return sinks.bundle(Folder(spark, folder).px, out, fps, zoom)


def picture(path: str):
    with open(path, "rb") as f:
        return images.decode_png(f.read())


def summary(spark: SparkSession, path: str) -> list[dict]:
    """Steps, frames and offsets of each animation of a script."""
    s = readers.scripts(spark.read.format("binaryFile").load(path))
    return [r.asDict() for r in animations.summary(s).orderBy("anim").collect()]
