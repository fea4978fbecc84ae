"""Operators that read a pixel's neighbours: despeckling, morphology, contours, distances, hole filling, textured patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as P
from .common import C, NB4, NB8, RGB, RGBA, by_frame, neighbours


def _mode(values: Column, order: Column | None = None) -> Column:
    """The most common element of an array; the smallest of equals."""
    d = F.array_distinct(values)
    best = F.array_sort(F.transform(d, lambda v: F.struct((-F.size(F.filter(values, lambda q: q == v))).alias("n"), v.alias("v"))))
    return F.try_element_at(best, F.lit(1))["v"]


def _surrounded(px: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """px with ``nb``: an array of structs (k, r, g, b, a) of its opaque neighbours."""
    n = neighbours(px, offsets, list(RGBA))
    return n.withColumn("nb", F.filter("nb", lambda q: q["a"] >= 128))


def despeckle(px: DataFrame) -> DataFrame:
    """Opaque pixels without an opaque neighbour of four become clear black; pixels that are not opaque but whose four neighbours all are take
    their commonest colour, of equals the one that comes last among left, right, up, down. ``kind`` is speck, hole or null."""
    n = _surrounded(px, NB4)
    colours = F.transform("nb", lambda q: F.struct(*[q[c].alias(c) for c in RGB]))
    counted = F.transform(F.array_distinct(colours), lambda v, k: F.struct(F.size(F.filter(colours, lambda q: q == v)).alias("n"), k.alias("k"), v.alias("v")))
    win = F.array_max(counted)["v"]
    kind = F.when(P.opaque() & (F.size("nb") == 0), "speck").when(~P.opaque() & (F.size("nb") == 4), "hole")
    n = n.withColumn("kind", kind)
    pick = lambda c: F.when(C("kind") == "speck", 0).when(C("kind") == "hole", win[c]).otherwise(C(c))
    return n.select("frame", "x", "y", *[pick(c).alias(c) for c in RGB], F.when(C("kind") == "speck", 0).when(C("kind") == "hole", 255).otherwise(C("a")).alias("a"), "kind")


def despeckle_report(px: DataFrame) -> DataFrame:
    return despeckle(px).groupBy("frame").agg(F.count(F.when(C("kind") == "speck", 1)).alias("specks"), F.count(F.when(C("kind") == "hole", 1)).alias("holes"))


def lift_noise(px: DataFrame, passes: int = 2, alpha: int = 200, least: int = 4) -> DataFrame:
    """Pixels with some alpha under ``alpha`` and fewer than ``least`` neighbours of eight with any become clear, ``passes`` times."""
    for _ in range(passes):
        n = neighbours(px, NB8, list(RGBA))
        faint = (C("a") > 0) & (C("a") < alpha) & (F.size(F.filter("nb", lambda q: q["a"] > 0)) < least)
        px = n.select("frame", "x", "y", *[F.when(faint, 0).otherwise(C(c)).alias(c) for c in RGBA])
    return px


def specks(px: DataFrame, crowd: int = 6, reach: int = 24) -> DataFrame:
    """Opaque pixels with ``crowd`` and more opaque neighbours of eight, none within ``reach``, take the commonest colour (smallest of equals)."""
    n = _surrounded(px, NB8)
    colours = F.transform("nb", lambda q: F.struct(*[q[c].alias(c) for c in RGB]))
    near = F.exists("nb", lambda q: P.dist2((C("r"), C("g"), C("b")), (q["r"], q["g"], q["b"])) <= reach * reach)
    # columns of their own: beside an alias r, a lambda's r would mean that alias
    n = n.withColumn("changed", P.opaque() & (F.size("nb") >= crowd) & ~near).withColumn("_m", _mode(colours))
    return n.select("frame", "x", "y", *[F.when(C("changed"), C(f"_m.{c}")).otherwise(C(c)).alias(c) for c in RGB], "a", "changed")


def moved(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """frame, x, y of all places that an offset leads to."""
    return mask.select("frame", F.explode(F.array(*[F.struct((C("x") + dx).alias("x"), (C("y") + dy).alias("y")) for dx, dy in offsets])).alias("p")).select("frame", "p.x", "p.y")


def dilate(mask: DataFrame, radius: int = 1, shape: str = "square") -> DataFrame:
    """A mask (frame, x, y) grown by a radius; ``shape`` is square or diamond. Places are not clipped to a canvas."""
    offs = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if shape == "square" or abs(dx) + abs(dy) <= radius]
    return moved(by_frame(mask.select("frame", "x", "y")), offs).distinct()


def erode(mask: DataFrame, radius: int = 1, shape: str = "square") -> DataFrame:
    """Places of the mask all of whose surroundings are in it."""
    offs = [(dx, dy) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if shape == "square" or abs(dx) + abs(dy) <= radius]
    n = moved(by_frame(mask.select("frame", "x", "y").distinct()), offs).groupBy("frame", "x", "y").count()
    return n.where(C("count") == len(offs)).select("frame", "x", "y")


def opened(mask: DataFrame, radius: int = 1) -> DataFrame:
    return dilate(erode(mask, radius), radius)


def closed(mask: DataFrame, radius: int = 1) -> DataFrame:
    return erode(dilate(mask, radius), radius)


def contour(mask: DataFrame, offsets: list[tuple[int, int]] = NB4) -> DataFrame:
    """Places of the mask with a neighbour outside it."""
    m = mask.select("frame", "x", "y").distinct()
    p = by_frame(m).select("frame", F.explode(F.array(F.struct(C("x"), C("y"), F.lit(1).alias("own")), *[F.struct((C("x") + dx).alias("x"), (C("y") + dy).alias("y"), F.lit(0).alias("own")) for dx, dy in offsets])).alias("p"))
    n = p.select("frame", "p.x", "p.y", "p.own").groupBy("frame", "x", "y").agg(F.max("own").alias("own"), F.count("*").alias("n"))
    return n.where((C("own") == 1) & (C("n") <= len(offsets))).select("frame", "x", "y")


def rim(mask: DataFrame, offsets: list[tuple[int, int]] = NB4) -> DataFrame:
    """Places outside the mask next to it."""
    return moved(mask, offsets).distinct().join(mask.select("frame", "x", "y"), ["frame", "x", "y"], "left_anti")


def distance_map(mask: DataFrame, area: DataFrame, limit: int) -> DataFrame:
    """frame, x, y, d: places of the area within ``limit`` of the mask, counting diagonals as 1. One bounded fan-out and a minimum."""
    offs = [(dx, dy, max(abs(dx), abs(dy))) for dx in range(-limit, limit + 1) for dy in range(-limit, limit + 1)]
    s = by_frame(mask.select("frame", "x", "y")).select("frame", F.explode(F.array(*[F.struct((C("x") + dx).alias("x"), (C("y") + dy).alias("y"), F.lit(d).alias("d")) for dx, dy, d in offs])).alias("p"))
    d = s.select("frame", "p.x", "p.y", "p.d").groupBy("frame", "x", "y").agg(F.min("d").alias("d"))
    return area.select("frame", "x", "y").join(d, ["frame", "x", "y"])


def fill_holes(px: DataFrame, stock: DataFrame, mask: DataFrame, rounds: int = 40, least: int = 3) -> DataFrame:
    """Holes (not opaque now, opaque in stock) filled from three and more effect neighbours of eight (opaque, outside the mask) with their
    commonest pixel, the first in order of columns then rows of equals; a round reads the one before it, filled pixels count as effect. A
    frame is filled in one task, as dense arrays, since rounds follow each other."""
    j = px.join(stock.select("frame", "x", "y", C("a").alias("_s")), ["frame", "x", "y"], "left").join(mask.select("frame", "x", "y", F.lit(1).alias("_m")).distinct(), ["frame", "x", "y"], "left")
    j = j.select("frame", "x", "y", *RGBA, F.coalesce("_s", F.lit(0)).alias("_s"), F.coalesce("_m", F.lit(0)).alias("_m"))
    return j.groupBy("frame").applyInPandas(lambda pdf: _filled(pdf, rounds, least), "frame bigint, x int, y int, r int, g int, b int, a int")


def _filled(pdf, rounds: int, least: int):
    """One frame: a plane of packed pixels with a margin, -1 where nothing may be copied from."""
    import numpy as np

    x, y = (pdf[c].to_numpy() - pdf[c].min() + 1 for c in "xy")
    packed = pdf[list(RGBA)].to_numpy(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
    solid = pdf["a"].to_numpy() >= 128
    source = np.full((x.max() + 2, y.max() + 2), -1, np.int64)
    source[x, y] = np.where(solid & (pdf["_m"].to_numpy() == 0), packed, -1)
    open_ = np.flatnonzero(~solid & (pdf["_s"].to_numpy() >= 128))
    steps = np.array([(i, k) for i in (-1, 0, 1) for k in (-1, 0, 1) if i or k])
    for _ in range(rounds):
        around = source[x[open_, None] + steps[:, 0], y[open_, None] + steps[:, 1]]
        there = around >= 0
        votes = ((around[:, :, None] == around[:, None, :]) & there[:, None, :]).sum(axis=2) * there
        ready = there.sum(axis=1) >= least
        if not ready.any():
            break
        won, now = around[np.arange(len(open_)), votes.argmax(axis=1)][ready], open_[ready]
        packed[now] = source[x[now], y[now]] = won
        open_ = open_[~ready]
    out = pdf[["frame", "x", "y"]].copy()
    for k, c in enumerate(RGBA):
        out[c] = (packed >> (24 - 8 * k)) & 255
    return out


def textured(a: DataFrame, b: DataFrame, dx: int = 0, dy: int = 0) -> DataFrame:
    """frame, x, y of places whose 3 by 3 patch in ``a`` equals that of ``b`` moved by (dx, dy) and holds three colours and more; places off a
    canvas are clear black."""
    pix = lambda p: F.struct(*[C(c).alias(c) for c in RGBA])
    m = a.select("frame", "x", "y", pix(a).alias("p")).join(b.select("frame", (C("x") + dx).alias("x"), (C("y") + dy).alias("y"), pix(b).alias("q")), ["frame", "x", "y"], "full")
    clear = F.struct(*[F.lit(0).alias(c) for c in RGBA])
    m = m.withColumn("here", C("p").isNotNull()).withColumns({"p": F.coalesce("p", clear), "q": F.coalesce("q", clear)})
    n = neighbours(m, NB8, ["p", "q", "here"]).where("here")
    # places that neither canvas has are clear in both and count as one colour
    colours = F.array_distinct(F.concat(F.array("p"), F.transform("nb", lambda s: s["p"]), F.when(F.size("nb") < 8, F.array(clear)).otherwise(F.array().cast("array<struct<r:int,g:int,b:int,a:int>>"))))
    same = (C("p") == C("q")) & ~F.exists("nb", lambda s: s["p"] != s["q"])
    return n.where(same & (F.size(colours) >= 3)).select("frame", "x", "y")


def runs(mask: DataFrame, along: str = "x") -> DataFrame:
    """Runs of neighbouring places along an axis: frame, the other axis, start, n, with a number per line from 1."""
    across = "y" if along == "x" else "x"
    w = Window.partitionBy("frame", across).orderBy(along)
    k = by_frame(mask.select("frame", "x", "y").distinct()).withColumn("k", C(along) - F.row_number().over(w))
    r = k.groupBy("frame", across, "k").agg(F.min(along).alias("start"), F.count("*").cast("int").alias("n"))
    return r.select("frame", across, "start", "n", F.row_number().over(Window.partitionBy("frame", across).orderBy("start")).alias("run"))


def cylinder_shade(mask: DataFrame, ramp: list[tuple[int, int, int]]) -> DataFrame:
    """frame, x, y, r, g, b: each horizontal run shaded from one end to the other over the ramp, darkest at the ends as on a round limb: the place
    in the run picks a colour by its distance from the nearer end."""
    w = Window.partitionBy("frame", "y").orderBy("x")
    k = by_frame(mask.select("frame", "x", "y").distinct()).withColumn("k", C("x") - F.row_number().over(w))
    run = Window.partitionBy("frame", "y", "k")
    k = k.select("frame", "x", "y", (F.row_number().over(run.orderBy("x")) - 1).alias("at"), F.count("*").over(run).alias("n"))
    near = F.least(C("at"), C("n") - 1 - C("at"))
    pick = F.least(P.div(near * 2 * len(ramp), F.greatest(C("n"), F.lit(1))), F.lit(len(ramp) - 1))
    entry = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(e, RGB)]) for e in ramp]), (pick + 1).cast("int"))
    return k.select("frame", "x", "y", *[entry[c].alias(c) for c in RGB])


def edge_colour(px: DataFrame) -> DataFrame:
    """Per frame: the commonest colour of the border (corners twice), the smallest of equals."""
    box = by_frame(px.select("frame", "x", "y", *RGB)).select("*", *[f(c).over(Window.partitionBy("frame")).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"])
    times = sum(((C(c) == C(f"{n}{c}")).cast("int") for n in ("lo", "hi") for c in "xy"), F.lit(0))
    n = box.withColumn("t", times).where("t > 0").groupBy("frame", *RGB).agg(F.sum("t").alias("n"))
    best = n.groupBy("frame").agg(F.max(F.struct("n", *[(-C(c)).alias(c) for c in RGB])).alias("m"))
    return best.select("frame", *[(-C(f"m.{c}")).alias(c) for c in RGB], C("m.n").alias("n"))
