"""Composite operators: downscaling a sheet, snapping to a grid, pixelising, smoothing animations, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import palettes, pixels as P
from . import alignment, animations, layout, masks, neighbourhood, palette_ops, votes
from .common import C, RGB, RGBA


def downscale(sheet: DataFrame, manifest: DataFrame, scale: int, palette: DataFrame, bg: tuple[int, int, int], *, keyed: tuple[int, int, int] | None = None, tol: int = 0, metric: str = "rgb", weak: float = votes.WEAK, resolve: bool = False, grain: bool = False, despeckle: bool = False, register: bool = False, k0: float = 1.0, reference: DataFrame | None = None) -> DataFrame:
    """Frames of a sheet voted back to one pixel per block, then cleaned as asked: orphans, grain, specks.

    With ``register``, the grid is looked for on each sheet (period within 4 % and phase), frames move to it, and with a reference by whole blocks to
    its silhouette; a frame goes back to its nominal grid where that agrees better by over one point."""
    if grain and tol <= 0:
        raise ValueError("grain needs a tolerance")
    nominal = votes.vote(sheet, manifest, scale, palette, bg, keyed, tol, metric) if k0 == 1.0 else None
    v = nominal
    if register or v is None:
        edges = votes.edge_positions(sheet)
        found = votes.scale_search(edges, scale * k0)
        grids = votes.snapped_origins(edges, found, manifest, k0, scale)
        v = votes.vote_fractional(sheet, grids, scale, palette, bg, keyed, tol, metric)
        if reference is not None:
            solid = v.where("win is not null").select("frame", "i", "j")
            move = votes.shift_search(solid, reference).select(C("frame").alias("ord"), "sx", "sy")
            g = grids.join(move, "ord", "left").withColumns({"gx": C("gx") + F.coalesce("sx", F.lit(0)) * C("block"), "gy": C("gy") + F.coalesce("sy", F.lit(0)) * C("block")})
            v = votes.vote_fractional(sheet, g.select("sheet", "ord", "gx", "gy", "w", "h", "block"), scale, palette, bg, keyed, tol, metric)
            if nominal is not None:
                a, b = (votes.silhouette(votes.to_px(x), reference).withColumnRenamed("agreement", n) for x, n in ((v, "new"), (nominal, "old")))
                keep = a.join(b, "frame").select("frame", (C("new") >= C("old") - 1).alias("_keep"))
                pick = lambda x, want: x.join(keep.where(C("_keep") == want).select("frame"), "frame", "left_semi")
                v = pick(v, True).unionByName(pick(nominal, False))
    if resolve:
        v = votes.resolve_orphans(v, weak, tol)
    if grain:
        v = votes.smooth_grain(v, tol)
    px = votes.to_px(v)
    return neighbourhood.despeckle(px).drop("kind") if despeckle else px


def snap(px: DataFrame, palette: DataFrame, bg: tuple[int, int, int], pixel_size: float | None = None, largest: int = 64, force: bool = False) -> DataFrame:
    """Pictures of enlarged pixels, of unknown pixel size, to one pixel per block: the period from 2 to ``largest`` with the largest mean phase concentration,
    refined in thousandths, or ``pixel_size``. A concentration grows towards periods that divide the true one, so the longest within a tenth of
    the best is taken. Pictures whose larger side is under 128 are refused unless forced."""
    size = layout.sizes(px)
    if not force and size.where("greatest(width, height) < 128").limit(1).count():
        raise ValueError("a side of 128 pixels and more is needed to find a grid")
    spark, edges = px.sparkSession, votes.edge_positions(px)
    if pixel_size is None:
        tried = spark.range(8, largest * 4 + 1).select(C("id").cast("int").alias("k"), (C("id") / 4).alias("period"))
        c = votes.concentration(edges, tried).groupBy("frame", "k", "period").agg((F.sum("conc") / 2).alias("conc"))
        best = c.withColumn("top", F.max("conc").over(Window.partitionBy("frame"))).where(C("conc") >= C("top") * 0.9)
        period = best.groupBy("frame").agg(F.max(F.struct("period", "conc")).alias("m")).select("frame", C("m.period").alias("period"))
    else:
        period = size.select("frame", F.lit(float(pixel_size)).alias("period"))
    ph = edges.join(period, "frame").groupBy("frame", "axis", "period").agg(F.sum(F.sin(2 * F.pi() * C("at") / C("period"))).alias("sn"), F.sum(F.cos(2 * F.pi() * C("at") / C("period"))).alias("cs"))
    ph = ph.groupBy("frame", "period").agg(*[F.max(F.when(C("axis") == a, F.pmod(F.atan2("sn", "cs") / (2 * F.pi()) * C("period"), C("period")))).alias(f"o{a}") for a in "xy"])
    origin = lambda a: F.when(F.coalesce(C(f"o{a}"), F.lit(0.0)) > C("period") / 2, C(f"o{a}") - C("period")).otherwise(F.coalesce(C(f"o{a}"), F.lit(0.0)))
    g = size.join(ph, "frame").withColumns({"gx": origin("x"), "gy": origin("y")})
    g = g.select(C("frame").alias("sheet"), C("frame").alias("ord"), "gx", "gy", F.greatest(F.lit(1), F.round((C("width") - C("gx")) / C("period")).cast("int")).alias("w"), F.greatest(F.lit(1), F.round((C("height") - C("gy")) / C("period")).cast("int")).alias("h"), C("period").alias("block"))
    return votes.to_px(votes.vote_fractional(px, g, 4, palette, bg))


def pixelize(px: DataFrame, width: int, height: int, colours: int, palette: DataFrame | None = None) -> DataFrame:
    """Art fitted to a canvas, in a palette or in at most so many colours."""
    small = layout.fit(px, width, height)
    if palette is not None:
        return palette_ops.nearest(small, palette)
    return palette_ops.reduce_colours(small, colours)


def walk(sequences: dict[int, list[int]], settled: set[int], keys: dict[int, int]) -> dict[int, tuple[int | None, int]]:
    """{frame: (the frame it is carried from, or None; its level)} of frames not settled yet, animations in order: a frame follows the one before it in its
    animation. An animation without a settled frame is walked as a loop from its key. Settled frames are level 0."""
    level, out = dict.fromkeys(settled, 0), {}
    for a in sorted(sequences):
        fs = sequences[a]
        if a in keys and not level.keys() & set(fs):
            at = fs.index(keys[a])
            fs = fs[at:] + fs[:at]
        last = None
        for f in fs:
            if f not in level:
                level[f] = 0 if last is None else level[last] + 1
                out[f] = (last, level[f])
            last = f
    return out


def turns(drawn: DataFrame, steps: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """anim, step, frame, fixed: what a walk has to know of the animations' drawn frames, at their first played step: those that their animation is the first to
    play and that are not settled (fixed) before, with the ones next to them. Three rows per frame at most, however many steps and animations there are; an
    animation without a new frame has none."""
    seq = animations.sequence(steps).join(drawn.select("frame").distinct(), "frame", "left_semi")
    done = settled.select("frame").distinct() if settled is not None else drawn.select("frame").limit(0)
    new = seq.groupBy("frame").agg(F.min("anim").alias("anim")).join(done, "frame", "left_anti").withColumn("_new", F.lit(True))
    w = Window.partitionBy("anim").orderBy("step", "frame")
    near = seq.join(new, ["anim", "frame"], "left").withColumn("_near", F.coalesce("_new", F.lag("_new").over(w), F.lead("_new").over(w)))
    fixed = done.withColumn("fixed", F.lit(True))
    return near.where("_near").join(fixed, "frame", "left").select("anim", "step", "frame", F.coalesce("fixed", F.lit(False)).alias("fixed"))


def smooth(stock: DataFrame, drawn: DataFrame, crops: DataFrame, steps: DataFrame, settled: DataFrame | None = None, most: int | None = 10) -> DataFrame:
    """Finished frames: within each animation, in play order, a frame takes over what the one before it settled wherever the stock did not change.

    An animation that has no settled frame starts at its medoid (of ``most`` evenly spread frames; None: of all), which is taken as drawn; frames settled before stay. Animations are walked in order, as one
    settles frames for the next. The walk is made on the driver from ``turns`` (three rows per frame at most). Shifts between neighbours hang on the stock
    alone, so all are found at once, and with their sums every frame gets the coordinates of the first frame of its chain: what a pixel may take over
    stands at its own place there. So the fold over the frames needs one shuffle, by chain and row of pixels; a task holds one row of a chain's frames."""
    seq: dict[int, list[int]] = {}
    fixed = set()
    for r in turns(drawn, steps, settled).orderBy("anim", "step", "frame").collect():
        seq.setdefault(r["anim"], []).append(r["frame"])
        if r["fixed"]:
            fixed.add(r["frame"])
    spark, px_of_drawn = stock.sparkSession, drawn.select("frame", "x", "y", *RGBA)
    known, unkeyed = set(fixed), []
    for a in sorted(seq):
        if seq[a] and not known & set(seq[a]):
            unkeyed.append(a)
        known |= set(seq[a])
    keys = {}
    if unkeyed:
        order = spark.createDataFrame([(a, i, f) for a in unkeyed for i, f in enumerate(seq[a])], "anim int, step int, frame bigint")
        keys = {r["anim"]: r["frame"] for r in alignment.medoids(px_of_drawn, order, crops, most, 3).collect()}
    todo = walk(seq, fixed, keys)
    done = settled.select("frame", "x", "y", *RGBA) if settled is not None else px_of_drawn.limit(0)
    pairs = [(f, g) for f, (g, _) in todo.items() if g is not None]
    shifts = spark.createDataFrame(pairs, "f bigint, g bigint")
    if pairs:
        begin = alignment.starts(shifts, crops)
        best = alignment.best_shift(stock, stock, begin, 3).select("f", C("dx").alias("bx"), C("dy").alias("by"))
        shifts = shifts.join(begin.select("f", "sx", "sy"), "f", "left").join(best, "f", "left").select("f", "g", *[F.coalesce(f"b{k}", f"s{k}", F.lit(0)).alias(f"d{k}") for k in "xy"])
    rows = {r["f"]: r for r in shifts.collect()}  # a row per frame
    root: dict[int, tuple[int, int, int]] = {}
    for f, (g, _) in sorted(todo.items(), key=lambda t: t[1][1]):
        r = rows.get(f)
        at = root.get(g, (g, 0, 0)) if r else (f, 0, 0)
        root[f] = (at[0], at[1] + r["dx"], at[2] + r["dy"]) if r else at
    heads = {g for g, _ in todo.values() if g is not None and g not in root}
    plan = [(f, *root[f], level, g) for f, (g, level) in todo.items()] + [(g, g, 0, 0, 0, None) for g in heads]
    plan = spark.createDataFrame(plan, "frame bigint, chain bigint, ox int, oy int, level int, before bigint")
    known = spark.createDataFrame([(f, r["g"], r["dx"], r["dy"]) for f, r in rows.items()], "f bigint, g bigint, dx int, dy int")
    asked = alignment.carried(stock, px_of_drawn, masks.box_masks(stock, crops), known).select("frame", "x", "y", "may", "sure")
    pixels = px_of_drawn.join(spark.createDataFrame([(f,) for f in todo], "frame bigint"), "frame").unionByName(done.join(spark.createDataFrame([(f,) for f in heads], "frame bigint"), "frame"))
    pixels = pixels.join(asked, ["frame", "x", "y"], "left").join(plan, "frame").withColumns({"may": F.coalesce("may", F.lit(False)), "sure": F.coalesce("sure", F.lit(False)), "cx": C("x") - C("ox"), "cy": C("y") - C("oy")})
    folded = pixels.groupBy("chain", "cy").applyInPandas(lambda pdf: alignment.fold_rows(pdf), "frame bigint, x int, y int, r int, g int, b int, a int")
    return done.unionByName(folded.join(spark.createDataFrame([(f,) for f in todo], "frame bigint"), "frame", "left_semi"))


def upper_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """The element at place n div 2 of each group's sorted values."""
    w = Window.partitionBy(by)
    k = df.select(by, value, (F.row_number().over(w.orderBy(value)) - 1).alias("k"), F.count("*").over(w).alias("n"))
    return k.where(C("k") == F.call_function("div", C("n"), F.lit(2))).select(by, C(value).alias("median"))


def gif_indices(px: DataFrame) -> DataFrame:
    """frame, x, y, idx: 0 where not opaque, else the place from 1 of the colour among all opaque colours in order, 1 for those beyond 255. The table is at most 255
    rows, so it is broadcast."""
    first = px.where(P.opaque()).select(*RGB).distinct().orderBy(*RGB).limit(255)
    table = first.withColumn("k", F.row_number().over(Window.orderBy(*RGB)))
    t = table.select(*[C(c).alias(f"_{c}") for c in RGB], "k")
    on = (C("r") == C("_r")) & (C("g") == C("_g")) & (C("b") == C("_b")) & P.opaque()
    return px.join(F.broadcast(t), on, "left").select("frame", "x", "y", F.when(~P.opaque(), 0).otherwise(F.coalesce("k", F.lit(1))).alias("idx"))


def colour_census(px: DataFrame, most: int = 256) -> DataFrame:
    """r, g, b, n of the ``most`` commonest opaque colours; of equals the smaller colour."""
    return px.where(P.opaque()).groupBy(*RGB).agg(F.count("*").alias("n")).orderBy(C("n").desc(), *RGB).limit(most)


def guessed_keys(words: DataFrame) -> DataFrame:
    """frame, key of (frame, x, y, w): cyan if the border has more of it than of black, else black if it has any, else null. Corners count twice, and so does the
    single row or column of a frame that is one high or wide."""
    w = Window.partitionBy("frame")
    t = words.withColumns({"mx": F.max("x").over(w), "my": F.max("y").over(w)})
    times = (C("x") == 0).cast("int") + (C("x") == C("mx")).cast("int") + (C("y") == 0).cast("int") + (C("y") == C("my")).cast("int")
    n = t.withColumn("t", times).groupBy("frame").agg(F.sum(F.when(C("w") == 0x0000, C("t")).otherwise(0)).alias("black"), F.sum(F.when(C("w") == 0x07FF, C("t")).otherwise(0)).alias("cyan"))
    return n.select("frame", F.when(C("cyan") > C("black"), 0x07FF).when(C("black") > 0, 0).alias("key"))


def palette_of(px: DataFrame) -> list[tuple[int, int, int]]:
    """The distinct 16-bit colours of opaque pixels in order, on the driver (65536 at most)."""
    rows = palettes.of_pixels(px).limit(palettes.MOST).collect()
    return sorted((r["pr"], r["pg"], r["pb"]) for r in rows)
