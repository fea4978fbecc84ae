"""Nearest colours, background decisions, conforming to a palette, twins of frames."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import palettes, pixels as P
from .common import C, RGB, RGBA, rgb

#: Squared distance from the background up to which a pixel is background whatever the palette.
NEAR_BG = 144


def _metric(name: str):
    return P.redmean2 if name == "redmean" else P.dist2


#: Palette entries up to which the nearest is found by a projection over a literal array, without a join.
INLINE = 64


def with_nearest(px: DataFrame, palette: DataFrame, name: str = "_m", metric: str = "rgb", banned: tuple[int, int, int] | None = None) -> DataFrame:
    """px with ``name``: struct (d, ord, pr, pg, pb) of the palette colour nearest to r, g, b (other than ``banned``), the first in order of equals, null without
    one. A short palette is a literal array in the projection, so pixels are not shuffled. A long one is one array value that
    every distinct colour is held against, however many pixels have it, and the results join back; in a stream, every pixel is."""
    entries = [e for e in entries_of(palette) if e[1:] != banned]
    if len(entries) <= INLINE:
        return px.withColumn(name, nearest_struct(entries, metric))
    text = json.dumps([dict(zip(("ord", "pr", "pg", "pb"), e)) for e in entries])
    all_ = F.from_json(F.lit(text), "array<struct<ord:int,pr:int,pg:int,pb:int>>")
    d = _metric(metric)
    found = F.array_min(F.transform(all_, lambda e: F.struct(d(rgb(), (e["pr"], e["pg"], e["pb"])).cast("bigint").alias("d"), e["ord"].alias("ord"), e["pr"].alias("pr"), e["pg"].alias("pg"), e["pb"].alias("pb"))))
    if px.isStreaming:
        return px.withColumn(name, found)
    near = px.select(*RGB).distinct().withColumn(name, found)
    return px.join(near, list(RGB), "left").select(*px.columns, name)


def nearest(px: DataFrame, palette: DataFrame, metric: str = "rgb") -> DataFrame:
    """Opaque pixels with r, g, b replaced by the nearest palette colour; ties go to the entry first in order."""
    on = with_nearest(px.where(P.opaque()), palette, "_m", metric).where("_m is not null")
    return on.select("frame", "x", "y", C("_m.pr").alias("r"), C("_m.pg").alias("g"), C("_m.pb").alias("b"), "a")


def entries_of(palette: DataFrame) -> list[tuple[int, int, int, int]]:
    """(ord, r, g, b) on the driver, bounded by the number of 16-bit colours."""
    rows = palette.orderBy("ord").limit(palettes.MOST + 1).collect()
    if len(rows) > palettes.MOST:
        raise ValueError(f"over {palettes.MOST} colours")
    return [(r["ord"], r["pr"], r["pg"], r["pb"]) for r in rows]


def nearest_struct(entries: list[tuple[int, int, int, int]], metric: str = "rgb", banned: tuple[int, int, int] | None = None, of: tuple | None = None) -> Column:
    """struct (d, ord, pr, pg, pb) of the nearest entry to a colour; null without entries."""
    d = _metric(metric)
    items = [F.struct(d(of or rgb(), e[1:]).cast("bigint").alias("d"), F.lit(e[0]).alias("ord"), *[F.lit(v).alias(n) for v, n in zip(e[1:], ("pr", "pg", "pb"))]) for e in entries if e[1:] != banned]
    return F.array_min(F.array(*items)) if items else F.lit(None).cast("struct<d:bigint,ord:int,pr:int,pg:int,pb:int>")


def second_nearest(px: DataFrame, palette: DataFrame, banned: tuple[int, int, int]) -> DataFrame:
    """Opaque pixels with the nearest palette colour other than ``banned``; their own colour where there is none."""
    on = with_nearest(px.where(P.opaque()), palette, "_m", banned=banned)
    return on.select("frame", "x", "y", *[F.coalesce(f"_m.p{c}", c).alias(c) for c in RGB], "a")


def is_background(bg: tuple[int, int, int], near: Column) -> Column:
    """Transparent, or so near to the background that no palette colour is nearer (within 12 in any case)."""
    d = P.dist2(rgb(), bg)
    pick = (near["pr"], near["pg"], near["pb"])
    return ~P.opaque() | (d <= NEAR_BG) | (d < P.dist2(rgb(), pick))


def decided(px: DataFrame, palette: DataFrame, bg: tuple[int, int, int], metric: str = "rgb") -> DataFrame:
    """frame, x, y, bg (whether background) and pr, pg, pb (null for background) of every pixel."""
    p = with_nearest(px, palette, "_m", metric).withColumn("bg", is_background(bg, C("_m")))
    return p.select("frame", "x", "y", "bg", *[F.when(~C("bg"), C(f"_m.p{c}")).alias(f"p{c}") for c in RGB])


def conform(px: DataFrame, palette: DataFrame, threshold: int = P.OPAQUE, key: tuple[int, int, int] | None = None, input_key: tuple[int, int, int] | None = None) -> DataFrame:
    """Pixels on palette colours: alpha under the threshold, or a pixel nearer to ``input_key`` than to the palette, becomes
    clear black; the rest opaque. A pixel that would take the colour key gets the nearest other colour."""
    p = with_nearest(with_nearest(px, palette, "_m"), palette, "_s", banned=key)
    out = C("a") < threshold
    if input_key is not None:
        d = P.dist2(rgb(), input_key)
        out = out | (d <= NEAR_BG) | (d < P.dist2(rgb(), (C("_m.pr"), C("_m.pg"), C("_m.pb"))))
    taken = F.lit(False) if key is None else (C("_m.pr") == key[0]) & (C("_m.pg") == key[1]) & (C("_m.pb") == key[2])
    p = p.withColumn("_out", out).withColumn("_taken", taken)
    pick = lambda c: F.when(C("_out"), 0).when(C("_taken"), F.coalesce(C(f"_s.p{c}"), C(c))).otherwise(C(f"_m.p{c}"))
    return p.select("frame", "x", "y", *[pick(c).alias(c) for c in RGB], F.when(C("_out"), 0).otherwise(255).alias("a"), *[C(c).alias(f"o{c}") for c in RGBA])


def conform_report(conformed: DataFrame) -> DataFrame:
    """Per frame: colours_in and colours_out of kept pixels, recoloured, semi_alpha_flattened (pixels with some alpha that became
    clear, and kept ones that were not quite opaque)."""
    kept = C("a") == 255
    changed = (C("r") != C("or")) | (C("g") != C("og")) | (C("b") != C("ob"))
    code = lambda p: C(f"{p}r") * 65536 + C(f"{p}g") * 256 + C(f"{p}b")
    return conformed.groupBy("frame").agg(
        F.count_distinct(F.when(kept, code("o"))).alias("colors_in"), F.count_distinct(F.when(kept, code(""))).alias("colors_out"),
        F.sum(F.when(kept & changed, 1).otherwise(0)).alias("recolored"), F.sum(F.when(~kept & (C("oa") != 0), 1).when(kept & (C("oa") != 255), 1).otherwise(0)).alias("semi_alpha_flattened"),
    )


def reduce_colours(px: DataFrame, n: int) -> DataFrame:
    """Opaque pixels in at most n colours by median cut over the counts of 16-bit colours, then the nearest of them; pixels with
    n colours or fewer stay as they are. Counts are gathered per 5-5-5 cell, so the driver gets 32768 rows at most."""
    on = px.where(P.opaque())
    if on.select(*RGB).distinct().limit(n + 1).count() <= n:
        return px
    cells = on.groupBy(*[P.shr(C(c), 3).alias(f"c{c}") for c in RGB]).agg(F.count("*").alias("w"), *[F.sum(c).alias(c) for c in RGB]).collect()
    counts = [(tuple(int(x[c] / x["w"] + 0.5) for c in RGB), x["w"]) for x in cells]
    merged: dict[tuple, int] = {}
    for c, w in counts:
        merged[c] = merged.get(c, 0) + w
    pal = palettes.median_cut(sorted(merged.items()), n)
    m = nearest_struct([(i, *c) for i, c in enumerate(pal)])
    p = px.withColumn("_m", m)
    return p.select("frame", "x", "y", *[F.when(P.opaque(), C(f"_m.p{c}")).otherwise(C(c)).alias(c) for c in RGB], "a")


def colour_maps(px: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (f1, f2) of frames: opaque (pixels of f1), residual (pixels that do not follow the map from each colour of f1 to
    the colour of f2 that it meets most; the smallest of equals), mismatch (pixels of which one frame has none or that are
    opaque in one only), lowest (the lowest row with a pixel that does not follow the map, null without one)."""
    a = pairs.join(px.select(C("frame").alias("f1"), "x", "y", *[C(c).alias(f"{c}1") for c in RGBA]), "f1")
    b = pairs.join(px.select(C("frame").alias("f2"), "x", "y", *[C(c).alias(f"{c}2") for c in RGBA]), "f2")
    both = a.join(b, ["f1", "f2", "x", "y"], "full")
    on1, on2 = F.coalesce(C("a1") >= 128, F.lit(False)), F.coalesce(C("a2") >= 128, F.lit(False))
    both = both.withColumn("miss", C("a1").isNull() | C("a2").isNull() | (on1 != on2)).withColumn("on", on1 & on2)
    cells = both.groupBy("f1", "f2", *[F.when(C("on"), C(f"{c}1")).alias(f"{c}1") for c in RGB], *[F.when(C("on"), C(f"{c}2")).alias(f"{c}2") for c in RGB]).agg(F.count("*").alias("n"), F.sum(C("miss").cast("int")).alias("miss"), F.max("y").alias("low"))
    ranked = cells.withColumn("k", F.row_number().over(Window.partitionBy("f1", "f2", "r1", "g1", "b1").orderBy(C("n").desc(), "r2", "g2", "b2")))
    on = C("r1").isNotNull()
    off = on & (C("k") > 1)
    return ranked.groupBy("f1", "f2").agg(F.sum(F.when(on, C("n")).otherwise(0)).alias("opaque"), F.sum(F.when(off, C("n")).otherwise(0)).alias("residual"), F.sum("miss").alias("mismatch"), F.max(F.when(off, C("low"))).alias("lowest"))


def colour_map(px: DataFrame, f1: int, f2: int) -> DataFrame:
    """The map itself: r1, g1, b1 to r2, g2, b2, the most common target, the smallest of equals."""
    a, b = (px.where((C("frame") == f) & P.opaque()).select("x", "y", *[C(c).alias(f"{c}{i}") for c in RGB]) for i, f in ((1, f1), (2, f2)))
    n = a.join(b, ["x", "y"]).groupBy(*[f"{c}{i}" for i in (1, 2) for c in RGB]).agg(F.count("*").alias("n"))
    w = Window.partitionBy("r1", "g1", "b1").orderBy(C("n").desc(), "r2", "g2", "b2")
    return n.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "n")


def twin_map(px: DataFrame, f1: int, f2: int) -> tuple[DataFrame, DataFrame]:
    """How f1 becomes its twin f2: the colour map, and the pixels (x, y, r, g, b, a) that do not follow it."""
    m = colour_map(px, f1, f2)
    a = px.where((C("frame") == f1) & P.opaque()).select("x", "y", *[C(c).alias(f"{c}1") for c in RGB])
    b = px.where((C("frame") == f2) & P.opaque()).select("x", "y", *RGBA)
    off = a.join(m, [f"{c}1" for c in RGB]).join(b, ["x", "y"]).where(" or ".join(f"{c}2 <> {c}" for c in RGB))
    return m, off.select("x", "y", *RGBA)


def twins(px: DataFrame, share: float = 0.01, crops: DataFrame | None = None, top: float = 0.3) -> DataFrame:
    """(frame, rep): greedy groups in frame order. A frame joins the first earlier representative of its size and opacity of
    which it is a recolouring but for ``share`` of the opaque pixels, all of them in the ``top`` part of its box (its crop box, else
    that of its opaque pixels), else it represents itself. Candidates meet by a hash of size and opacity, so only frames of one
    silhouette are compared."""
    from . import layout

    shape = px.groupBy("frame").agg(F.max("x").alias("w"), F.max("y").alias("h"), F.sum(F.when(P.opaque(), F.xxhash64("x", "y").cast("decimal(38,0)")).otherwise(0)).alias("s"))
    a, b = shape.select(C("frame").alias("f1"), "w", "h", "s"), shape.select(C("frame").alias("f2"), "w", "h", "s")
    line = (layout.boxes(px) if crops is None else crops).select(C("frame").alias("f2"), (C("cy") + F.floor(C("ch") * F.lit(top))).alias("line"))
    m = colour_maps(px, a.join(b, ["w", "h", "s"]).where("f1 < f2").select("f1", "f2")).join(line, "f2", "left")
    like = m.where((C("mismatch") == 0) & (C("residual") <= C("opaque") * share) & (C("lowest").isNull() | F.coalesce(C("lowest") < C("line"), F.lit(False)))).select("f1", "f2")

    def greedy(key, pdf):
        import pandas as pd

        reps: dict[int, int] = {}
        near = set(zip(pdf["f1"], pdf["f2"]))
        for f in sorted({*pdf["f1"], *pdf["f2"]}):
            reps[f] = next((r for r in sorted(set(reps.values())) if (r, f) in near), f)
        return pd.DataFrame({"frame": list(reps), "rep": list(reps.values())})

    linked = like.join(shape.select(C("frame").alias("f1"), "w", "h", "s"), "f1").groupBy("w", "h", "s").applyInPandas(greedy, "frame bigint, rep bigint")
    return shape.select("frame").join(linked, "frame", "left").select("frame", F.coalesce("rep", "frame").alias("rep"))


def recoloured(px: DataFrame, mapping: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """Colours of opaque pixels by the map (r1, g1, b1 to r2, g2, b2), unmapped ones as they are; then fixed pixels (x, y, r, g,
    b, a) in every frame."""
    m = mapping.select(*[C(f"{c}1").alias(f"_{c}1") for c in RGB], *[C(f"{c}2").alias(f"_{c}2") for c in RGB])
    on = P.opaque() & (C("r") == C("_r1")) & (C("g") == C("_g1")) & (C("b") == C("_b1"))
    out = px.join(m, on, "left").select("frame", "x", "y", *[F.coalesce(f"_{c}2", c).alias(c) for c in RGB], "a")
    if fixed is None:
        return out
    f = fixed.select(C("x").alias("_x"), C("y").alias("_y"), *[C(c).alias(f"_{c}") for c in RGBA])
    return out.join(f, (C("x") == C("_x")) & (C("y") == C("_y")), "left").select("frame", "x", "y", *[F.coalesce(f"_{c}", c).alias(c) for c in RGBA])
