"""Sample compositions of the primitives: effects, put-back rules and figure masks as projects define them.

They show how rules are composed and are not part of the library's core; a project passes its own functions ``DataFrame -> DataFrame`` in the same way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as P
from . import components, neighbourhood as nh
from .common import C, RGB, RGBA

FOAM = (235, 248, 255)


def foam_rim(px: DataFrame, mask: DataFrame, colour: tuple[int, int, int] = FOAM) -> DataFrame:
    """Mask pixels at the mask's edge drawn towards a colour, brighter ones further: ``c + (F - c) * (.45 + .35 * max / 255)``, rounded half to even."""
    edge = nh.contour(mask).select("frame", "x", "y", F.lit(True).alias("_e"))
    j = px.join(edge, ["frame", "x", "y"], "left")
    k = 0.45 + 0.35 * F.greatest(*[C(c) for c in RGB]) / 255.0
    return j.select("frame", "x", "y", *[F.when(C("_e") & P.opaque(), F.bround(C(c) + (F.lit(v) - C(c)) * k).cast("int")).otherwise(C(c)).alias(c) for c, v in zip(RGB, colour)], "a")


def droplets(mask: DataFrame, seed: int, chance: float = 0.2, reach: int = 3, colour: tuple[int, int, int] = FOAM) -> DataFrame:
    """Pixels thrown off the mask's edge, by Python's generator seeded with ``seed`` and the frame, edge places in order of row then column. A frame's draws follow
    each other, so a frame is one task's."""
    import random

    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["y", "x"])
        f = int(p["frame"].iat[0])
        rng, inside, out = random.Random(f"{seed}:{f}"), set(zip(pdf["x"], pdf["y"])), {}
        for x, y in zip(p["x"], p["y"]):
            if rng.random() < chance:
                q = (int(x) + rng.randint(-reach, reach), int(y) - rng.randint(1, reach))
                if q not in inside:
                    out[q] = True
        return pd.DataFrame([(f, x, y, *colour, 255) for x, y in out], columns=["frame", "x", "y", *RGBA]).astype({c: "int32" for c in ("x", "y", *RGBA)} | {"frame": "int64"})

    return nh.contour(mask).groupBy("frame").applyInPandas(one, "frame bigint, x int, y int, r int, g int, b int, a int")


def keep_effects(done: DataFrame, stock: DataFrame, effect: Column) -> DataFrame:
    """Stock pixels put back where ``effect`` (on s_r, s_g, s_b, s_a) holds for them and for one of their stock neighbours of four, so that single stray pixels stay as
    drawn."""
    s = stock.select("frame", "x", "y", *[C(c).alias(f"s_{c}") for c in RGBA]).withColumn("hit", effect & (C("s_a") >= 128))
    n = nh.neighbours(s, nh.NB4, [*(f"s_{c}" for c in RGBA), "hit"])
    back = n.where(C("hit") & F.exists("nb", lambda q: q["hit"])).select("frame", "x", "y", *[f"s_{c}" for c in RGBA])
    return done.join(back, ["frame", "x", "y"], "left").select("frame", "x", "y", *[F.coalesce(f"s_{c}", c).alias(c) for c in RGBA])


def backfill(done: DataFrame, stock: DataFrame) -> DataFrame:
    """Places that the drawing left clear and the stock has opaque take the stock's pixel where three and more of eight drawn neighbours are opaque."""
    n = nh.neighbours(done, nh.NB8, list(RGBA))
    hole = ~P.opaque() & (F.size(F.filter("nb", lambda q: q["a"] >= 128)) >= 3)
    j = n.withColumn("hole", hole).join(stock.select("frame", "x", "y", *[C(c).alias(f"s_{c}") for c in RGBA]), ["frame", "x", "y"], "left")
    fill = C("hole") & F.coalesce(C("s_a") >= 128, F.lit(False))
    return j.select("frame", "x", "y", *[F.when(fill, C(f"s_{c}")).otherwise(C(c)).alias(c) for c in RGBA])


def without_scraps(px: DataFrame, colours: list[tuple[int, int, int]], most: int = 12) -> DataFrame:
    """px without components of the given colours of at most ``most`` pixels that do not touch the rest of the figure."""
    hit = F.lit(False)
    for r, g, b in colours:
        hit = hit | ((C("r") == r) & (C("g") == g) & (C("b") == b))
    mine = px.where(P.opaque() & hit)
    lab = components.components(mine)
    t = components.touching(lab, px.where(P.opaque() & ~hit)).where((C("n") <= most) & (C("touches") == 0)).select("frame", "comp")
    gone = lab.join(t, ["frame", "comp"]).select("frame", "x", "y")
    return px.join(gone, ["frame", "x", "y"], "left_anti")


def figure(body: DataFrame, pieces: DataFrame, gap: int) -> DataFrame:
    """The body's places with those of every piece (labelled) near it, near pieces counting as body until none is left: pieces and body are nodes, nearness links
    them, and what the body reaches is the figure. Nearness is found once, then components of a small graph per frame."""
    import pandas as pd

    everything = components.components(body.select("frame", "x", "y").union(pieces.select("frame", "x", "y")))
    b = body.select("frame", "x", "y").distinct().withColumn("_b", F.lit(1))
    lab = everything.join(b, ["frame", "x", "y"], "left")
    grown = lab.select("frame", C("comp").alias("ca"), F.explode(F.array(*[F.struct((C("x") + dx).alias("x"), (C("y") + dy).alias("y")) for dx in range(-gap, gap + 1) for dy in range(-gap, gap + 1)])).alias("_p"))
    links = grown.select("frame", "ca", "_p.x", "_p.y").join(everything, ["frame", "x", "y"]).where("ca <> comp").select("frame", "ca", C("comp").alias("cb")).distinct()
    starts = lab.where("_b = 1").select("frame", C("comp").alias("ca"), F.lit(-1).cast("bigint").alias("cb")).distinct()

    def reach(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, c in zip(pdf["ca"], pdf["cb"]):
            if c >= 0:
                near.setdefault(a, []).append(c)
        got = set(pdf.loc[pdf["cb"] < 0, "ca"])
        todo = list(got)
        while todo:
            new = [c for c in near.get(todo.pop(), []) if c not in got]
            got.update(new)
            todo += new
        return pd.DataFrame({"frame": pdf["frame"].iat[0], "comp": sorted(got)})

    keep = links.union(starts).groupBy("frame").applyInPandas(reach, "frame bigint, comp bigint")
    return everything.join(keep, ["frame", "comp"], "left_semi").select("frame", "x", "y")


def chest_rows(mask: DataFrame, least: int = 3, tolerance: int = 1) -> DataFrame:
    """frame, y0, y1, x0, x1: per frame the longest stretch of rows whose longest run is at least ``least`` wide and differs from the row before by at most
    ``tolerance`` at both ends; the first of equals."""
    r = nh.runs(mask)
    w = Window.partitionBy("frame", "y").orderBy(C("n").desc(), "start")
    top = r.withColumn("k", F.row_number().over(w)).where((C("k") == 1) & (C("n") >= least)).select("frame", "y", "start", (C("start") + C("n") - 1).alias("stop"))
    o = Window.partitionBy("frame").orderBy("y")
    new = (F.lag("y").over(o) == C("y") - 1) & (F.abs(F.lag("start").over(o) - C("start")) <= tolerance) & (F.abs(F.lag("stop").over(o) - C("stop")) <= tolerance)
    top = top.withColumn("cut", F.when(new, 0).otherwise(1)).withColumn("part", F.sum("cut").over(o))
    g = top.groupBy("frame", "part").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("start").alias("x0"), F.max("stop").alias("x1"))
    best = g.groupBy("frame").agg(F.max(F.struct((C("y1") - C("y0")).alias("len"), (-C("y0")).alias("k"), "y0", "y1", "x0", "x1")).alias("m"))
    return best.select("frame", *[C(f"m.{c}").alias(c) for c in ("y0", "y1", "x0", "x1")])


def baked(stock: DataFrame, finished: DataFrame, painted: DataFrame, least: int = 8) -> DataFrame:
    """Every frame of the stock as finished, else as painted by rules where the frame is wider than ``least``, else as it is; frames are taken as a whole."""
    wide = stock.groupBy("frame").agg((F.max("x") + 1 > least).alias("_wide"))
    have = wide.join(finished.select("frame", F.lit(True).alias("_f")).distinct(), "frame", "left").join(painted.select("frame", F.lit(True).alias("_p")).distinct(), "frame", "left")
    source = have.select("frame", F.when(C("_f"), "finished").when(C("_p") & C("_wide"), "painted").otherwise("stock").alias("_of"))
    parts = [d.select("frame", "x", "y", *RGBA, F.lit(n).alias("_of")) for d, n in ((finished, "finished"), (painted, "painted"), (stock, "stock"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).join(source, ["frame", "_of"], "left_semi").drop("_of")


def replaced(archive: DataFrame, done: DataFrame) -> DataFrame:
    """The frames of another archive, those that ``done`` has under the same number and in the same size replaced."""
    size = lambda d: d.groupBy("frame").agg(F.max("x").alias("w"), F.max("y").alias("h"))
    same = size(archive).join(size(done), ["frame", "w", "h"]).select("frame")
    return archive.join(same, "frame", "left_anti").select("frame", "x", "y", *RGBA).unionByName(done.join(same, "frame", "left_semi").select("frame", "x", "y", *RGBA))


def enlarged(px: DataFrame, mask: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Frames k times as large for painting over, and their masks as white on black pictures of that size."""
    from . import layout

    m = px.join(mask.select("frame", "x", "y", F.lit(255).alias("_m")).distinct(), ["frame", "x", "y"], "left")
    return layout.upscale(px, k), layout.upscale(m.select("frame", "x", "y", *[F.coalesce("_m", F.lit(0)).alias(c) for c in RGB], F.lit(255).alias("a")), k)


def swatches(ramps: DataFrame, block: int = 8) -> DataFrame:
    """A reference picture per ramp (frame, ord, r, g, b): its colours side by side in blocks, in order."""
    side = F.explode(F.sequence(F.lit(0), F.lit(block - 1)))
    p = ramps.withColumn("dx", side).withColumn("y", side)
    return p.select("frame", (C("ord") * block + C("dx")).cast("int").alias("x"), C("y").cast("int").alias("y"), *RGB, F.lit(255).alias("a"))


def graft_beside(stock: DataFrame, finished: DataFrame, mask: DataFrame, shifts: DataFrame, effect: str, stamp: bool = False) -> DataFrame:
    """A graft that leaves effects alone: places whose stock is of the colour class ``effect`` stay as they are, and the donor's effects are not brought along."""
    from . import alignment

    glow = P.classes(stock, (effect,)).where(effect).select("frame", "x", "y")
    own = P.classes(finished, (effect,)).where(f"not {effect}").drop(effect)
    done = alignment.graft(stock, own, mask.join(glow, ["frame", "x", "y"], "left_anti"), shifts, stamp)
    back = done.join(glow, ["frame", "x", "y"], "left_semi").select("frame", "x", "y").join(stock, ["frame", "x", "y"]).select("frame", "x", "y", *RGBA, F.lit(False).alias("grafted"))
    return done.join(glow, ["frame", "x", "y"], "left_anti").unionByName(back)


def difference_mask(stock: DataFrame, reference: DataFrame, shifts: DataFrame, least: int = 1, near: int = 30) -> DataFrame:
    """Opaque places of frames f that the reference's frame g, moved by the shift, does not have alike (sum of differences over ``near``), in components of
    ``least`` places and more."""
    from . import alignment

    s = stock.join(shifts.select(C("f").alias("frame")).distinct(), "frame").where(P.opaque())
    was = alignment.moved_to(reference, shifts, "q").withColumnRenamed("f", "frame")
    j = s.join(was, ["frame", "x", "y"], "left").withColumns({f"q{c}": F.coalesce(f"q{c}", F.lit(0)) for c in RGBA})
    differs = ~P.opaque("qa") | (P.l1((C("r"), C("g"), C("b")), (C("qr"), C("qg"), C("qb"))) > near)
    out = j.where(differs).select("frame", "x", "y", *RGBA)
    return (components.drop_small(out, least) if least > 1 else out).select("frame", "x", "y")


def alone(body: DataFrame, pieces: DataFrame, gap: int) -> DataFrame:
    """The places of pieces that are not part of the body's figure: what stands by itself."""
    return pieces.select("frame", "x", "y").join(figure(body, pieces, gap), ["frame", "x", "y"], "left_anti")


def garment(px: DataFrame, wanted: str, band: tuple[float, float] = (0.0, 1.0), least: int = 6) -> DataFrame:
    """The places of a colour class in a band of a frame's opaque height (shares from its top), without lines a pixel wide and components under ``least`` places."""
    box = px.where(P.opaque()).groupBy("frame").agg(F.min("y").alias("y0"), F.max("y").alias("y1"))
    height = C("y1") - C("y0") + 1
    inside = (C("y") >= C("y0") + height * band[0]) & (C("y") < C("y0") + height * band[1])
    hit = P.classes(px, (wanted,)).where(wanted).join(box, "frame").where(inside).select("frame", "x", "y")
    solid = nh.opened(hit)
    return components.drop_small(px.join(solid, ["frame", "x", "y"], "left_semi"), least).select("frame", "x", "y")


def painted(px: DataFrame, mask: DataFrame, ramp: list[tuple[int, int, int]], outline: tuple[int, int, int] | None = None) -> DataFrame:
    """A mask's places painted in a ramp by their lightness among themselves, its edge in a colour of its own where one is given."""
    from . import masks

    out = masks.recolour_region(px, mask, ramp).drop("bin")
    if outline is None:
        return out
    edge = nh.contour(mask).select("frame", "x", "y", F.lit(True).alias("_e"))
    return out.join(edge, ["frame", "x", "y"], "left").select("frame", "x", "y", *[F.when(C("_e"), v).otherwise(C(c)).alias(c) for c, v in zip(RGB, outline)], "a")
