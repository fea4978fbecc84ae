"""Masks from polygons, lines and boxes, and what is done through masks: remixing, seams, recolouring, leftover scores.

A polygon's pixels are those whose centres lie between the first and second, third and fourth ... crossing of its edges with their row, ends
included; an edge crosses a row if exactly one of its ends is at or above the row's centre. Polygons are few points; rows are found per
polygon, not per pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as P
from .common import C, NB4, RGB, RGBA, by_frame

SPEC = "frame bigint, region int, kind string, poly int, edge int, x0 double, y0 double, x1 double, y1 double"
LINES = "frame bigint, region int, ax double, ay double, bx double, by double, width double"


def edges(spec: dict[int, list[dict]]) -> tuple[list[tuple], list[tuple]]:
    """Rows of SPEC and LINES from {frame: [region: {add, sub: polygons, sub_lines: (a, b, width)}]}. Polygons of under three points are dropped."""
    polys, lines = [], []
    for frame, regions in spec.items():
        for i, r in enumerate(regions):
            for kind in ("add", "sub"):
                for p, poly in enumerate(r.get(kind, [])):
                    if len(poly) > 2:
                        polys += [(frame, i, kind, p, k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(zip(poly, [*poly[1:], poly[0]]))]
            lines += [(frame, i, *map(float, a), *map(float, b), float(w)) for a, b, w in r.get("sub_lines", [])]
    return polys, lines


def filled(polygons: DataFrame, height: int, width: int) -> DataFrame:
    """frame, region, kind, poly, x, y: pixels of each polygon on a canvas."""
    top = F.greatest(F.floor(F.least("y0", "y1") - 0.5).cast("int"), F.lit(0))
    end = F.least(F.ceil(F.greatest("y0", "y1") + 0.5).cast("int"), F.lit(height - 1))
    rows = polygons.where(top <= end).withColumn("y", F.explode(F.sequence(top, end)))
    cy = C("y") + 0.5
    cross = rows.where((C("y0") <= cy) != (C("y1") <= cy)).withColumn("cx", C("x0") + (cy - C("y0")) / (C("y1") - C("y0")) * (C("x1") - C("x0")))
    w = Window.partitionBy("frame", "region", "kind", "poly", "y").orderBy("cx")
    pairs = cross.withColumn("k", F.row_number().over(w)).withColumn("to", F.lead("cx").over(w)).where("k % 2 = 1 and to is not null")
    a, b = F.greatest(F.ceil(C("cx") - 0.5).cast("int"), F.lit(0)), F.least(F.floor(C("to") - 0.5).cast("int"), F.lit(width - 1))
    return pairs.where(a <= b).select("frame", "region", "kind", "poly", F.explode(F.sequence(a, b)).alias("x"), "y").distinct()


def on_line(x: str = "x", y: str = "y"):
    """Whether a pixel's centre is within half the width of the segment (ax, ay) to (bx, by)."""
    px, py = C(x) + 0.5 - C("ax"), C(y) + 0.5 - C("ay")
    vx, vy = C("bx") - C("ax"), C("by") - C("ay")
    n = vx * vx + vy * vy
    t = F.when(n > 0, F.least(F.greatest((px * vx + py * vy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    dx, dy = px - t * vx, py - t * vy
    return dx * dx + dy * dy <= (C("width") / 2) * (C("width") / 2)


def rasterised(px: DataFrame, polygons: DataFrame, lines: DataFrame, width: int, height: int) -> DataFrame:
    """frame, region, x, y: opaque pixels of the union of a region's ``add`` polygons, without its ``sub`` polygons and thick lines. A polygon's
    fill of a pixel is decided on its own; whatever adds comes before whatever subtracts."""
    f = filled(polygons, height, width)
    on = f.where("kind = 'add'").select("frame", "region", "x", "y").distinct()
    on = on.join(f.where("kind = 'sub'").select("frame", "region", "x", "y"), ["frame", "region", "x", "y"], "left_anti")
    cut = on.alias("m").join(lines.alias("l"), (C("m.frame") == C("l.frame")) & (C("m.region") == C("l.region"))).select("m.*", *[C(f"l.{c}") for c in ("ax", "ay", "bx", "by", "width")]).where(on_line())
    on = on.join(cut.select("frame", "region", "x", "y"), ["frame", "region", "x", "y"], "left_anti")
    return on.join(px.where(P.opaque()).select("frame", "x", "y"), ["frame", "x", "y"], "left_semi").select("frame", "region", "x", "y")


def box_masks(px: DataFrame, crops: DataFrame) -> DataFrame:
    """frame, x, y of opaque pixels inside the frame's crop box (frame, cx, cy, cw, ch). Frames without a box have no mask."""
    j = px.where(P.opaque()).join(crops, "frame")
    return j.where((C("x") >= C("cx")) & (C("x") < C("cx") + C("cw")) & (C("y") >= C("cy")) & (C("y") < C("cy") + C("ch"))).select("frame", "x", "y")


def remix(edit: DataFrame, orig: DataFrame, mask: DataFrame, alpha: bool = False) -> DataFrame:
    """Outside the mask the original; inside, the edit where it is opaque, else clear black with ``alpha`` and the original without. ``inside``
    and ``taken`` mark mask pixels and those that come from the edit."""
    e = edit.select("frame", "x", "y", *[C(c).alias(f"e{c}") for c in RGBA])
    j = orig.join(e, ["frame", "x", "y"], "left").join(mask.select("frame", "x", "y", F.lit(True).alias("inside")).distinct(), ["frame", "x", "y"], "left")
    inside = F.coalesce("inside", F.lit(False))
    taken = inside & F.coalesce(P.opaque("ea"), F.lit(False))
    pick = lambda c: F.when(taken, C(f"e{c}")).when(inside & F.lit(alpha), 0).otherwise(C(c))
    return j.select("frame", "x", "y", *[pick(c).alias(c) for c in RGBA], inside.alias("inside"), taken.alias("taken"))


def seam(remixed: DataFrame, orig: DataFrame) -> DataFrame:
    """Per frame: seam_pairs and seam_error, the mean squared colour difference between opaque mask pixels of the result and the opaque original pixels
    beside them outside the mask. Each mask pixel asks for its four neighbours, one equi-join."""
    ins = by_frame(remixed.where(C("inside") & P.opaque())).select("frame", *RGB, F.explode(F.array(*[F.struct((C("x") + dx).alias("x"), (C("y") + dy).alias("y")) for dx, dy in NB4])).alias("p")).select("frame", "p.x", "p.y", *RGB)
    out = orig.where(P.opaque()).select("frame", "x", "y", *[C(c).alias(f"o{c}") for c in RGB]).join(remixed.where("inside").select("frame", "x", "y"), ["frame", "x", "y"], "left_anti")
    d = P.dist2((C("r"), C("g"), C("b")), (C("or"), C("og"), C("ob")))
    return ins.join(out, ["frame", "x", "y"]).groupBy("frame").agg(F.count("*").alias("seam_pairs"), (F.sum(d.cast("bigint")) / F.count("*")).alias("seam_error"))


def quantile_cuts(picked: DataFrame, tones: int) -> DataFrame:
    """frame, cuts: for a ramp of so many tones, the luminances at places ``i * n div tones`` of each frame's sorted pixels, i from 1."""
    w = Window.partitionBy("frame")
    k = picked.select("frame", "l", (F.row_number().over(w.orderBy("l")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    at = F.array(*[F.least(F.call_function("div", C("n") * i, F.lit(tones)), C("n") - 1) for i in range(1, tones)]) if tones > 1 else F.array().cast("array<bigint>")
    hit = k.select("frame", "l", F.posexplode(at).alias("i", "at"), "k").where("k = at")
    return hit.groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "l"))), lambda s: s["l"]).alias("cuts"))


def recolour_region(px: DataFrame, mask: DataFrame, ramp: list[tuple[int, int, int]], thresholds: list[float] | None = None) -> DataFrame:
    """px with mask pixels (frame, x, y) painted in the ramp, dark to light: the tone is the number of leading cuts that the pixel's luminance is over.
    Cuts are given, or each frame's quantiles. Alpha stays; ramp colours are rounded to 16 bits. ``bin`` is null where nothing was painted."""
    from ..functions import palettes

    if not ramp or thresholds is not None and len(thresholds) != len(ramp) - 1:
        raise ValueError("a ramp needs colours, and one threshold fewer than those")
    tones = [palettes.canonical(c) for c in ramp]
    lum = P.luminance(C("r"), C("g"), C("b"))
    m = px.join(mask.select("frame", "x", "y", F.lit(1).alias("_m")).distinct(), ["frame", "x", "y"], "left")
    m = m.withColumn("l", F.when(C("_m") == 1, lum))
    if thresholds is None:
        m = m.join(quantile_cuts(m.where("_m = 1").select("frame", "l"), len(ramp)), "frame", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    else:
        m = m.withColumn("cuts", F.array(*[F.lit(float(t)) for t in thresholds]).cast("array<double>"))
    tone = F.when(C("_m") == 1, F.least(P.level(C("l"), C("cuts")), F.lit(len(ramp) - 1)))
    m = m.withColumn("bin", tone)
    entry = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(t, RGB)]) for t in tones]), C("bin") + 1)
    return m.select("frame", "x", "y", *[F.coalesce(F.when(C("bin").isNotNull(), entry[c]), C(c)).alias(c) for c in RGB], "a", "bin")


def recolour(px: DataFrame, regions: list[tuple[DataFrame, list[tuple[int, int, int]], list[float] | None]]) -> DataFrame:
    """Regions (mask, ramp, thresholds) painted one after the other: a later one sees what an earlier one painted."""
    for mask, ramp, thresholds in regions:
        px = recolour_region(px, mask, ramp, thresholds).drop("bin")
    return px


def bin_counts(painted: DataFrame, tones: int) -> DataFrame:
    return painted.where("bin is not null").groupBy("frame").agg(F.count("*").alias("painted_px"), *[F.sum((C("bin") == k).cast("int")).alias(f"bin{k}") for k in range(tones)])


def leftover(done: DataFrame, stock: DataFrame, mask: DataFrame, top: float = 0.3) -> DataFrame:
    """Per frame: percent, rounded half to even, of mask pixels below the upper ``top`` of the mask's box that still equal the stock. Null without such
    pixels."""
    box = mask.groupBy("frame").agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    m = mask.join(box, "frame").where(C("y") >= C("y0") + F.floor((C("y1") - C("y0") + 1) * top)).select("frame", "x", "y")
    s = stock.select("frame", "x", "y", *[C(c).alias(f"s{c}") for c in RGBA])
    j = m.join(done, ["frame", "x", "y"]).join(s, ["frame", "x", "y"])
    same = P.same_stock((C("r"), C("g"), C("b")), C("a"), (C("sr"), C("sg"), C("sb")), C("sa"))
    return j.groupBy("frame").agg(F.bround(F.sum(same.cast("int")) * 100 / F.count("*")).cast("int").alias("leftover"))


def lock(px: DataFrame, base: DataFrame, boxes: list[tuple[int, int, int, int]]) -> DataFrame:
    """px with base pixels inside any box (x, y, w, h)."""
    hit = F.lit(False)
    for x, y, w, h in boxes:
        hit = hit | ((C("x") >= x) & (C("x") < x + w) & (C("y") >= y) & (C("y") < y + h))
    b = base.where(hit).select("frame", "x", "y", *[C(c).alias(f"b{c}") for c in RGBA])
    return px.join(b, ["frame", "x", "y"], "left").select("frame", "x", "y", *[F.coalesce(f"b{c}", c).alias(c) for c in RGBA])


def diff_mask(a: DataFrame, b: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """frame, x, y of pixels of a that differ from b's, moved by the frame's anchor difference (frame, dx, dy); a missing pixel differs."""
    if anchors is not None:
        b = b.join(anchors, "frame").withColumns({"x": C("x") + C("dx"), "y": C("y") + C("dy")})
    q = b.select("frame", "x", "y", *[C(c).alias(f"q{c}") for c in RGBA])
    j = a.join(q, ["frame", "x", "y"], "left")
    same = F.coalesce((C("a") == C("qa")) & (C("r") == C("qr")) & (C("g") == C("qg")) & (C("b") == C("qb")), F.lit(False))
    return j.where(~same).select("frame", "x", "y")
