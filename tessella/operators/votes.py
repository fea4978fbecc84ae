"""Block votes: an enlarged sheet back to one pixel per block, with the cleanups that read the votes.

Votes of many sheets run at once. Sheet pixels carry ``frame`` as the sheet's number; a manifest (sheet, ord, x, y, w, h) places
frames on it, x and y in sheet pixels, w and h in source pixels. The result's ``frame`` is ord."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as P
from .common import C, NB8, RGB, neighbours, rgb
from .palette_ops import is_background, with_nearest

COLOUR = "struct<r:int,g:int,b:int>"
MIN_RESOLVE, MIN_GRAIN, WEAK = 0.2, 0.05, 0.6


def _candidates(px: DataFrame, palette: DataFrame, bg: tuple[int, int, int], keyed: tuple[int, int, int] | None, metric: str) -> DataFrame:
    """px with ``c``: the palette colour a pixel votes for, null for background."""
    p = with_nearest(px, palette, "_m", metric)
    pick = F.struct(*[C(f"_m.p{c}").alias(c) for c in RGB])
    if keyed is not None:
        p = with_nearest(p, palette, "_s", banned=keyed)
        hit = (C("_m.pr") == keyed[0]) & (C("_m.pg") == keyed[1]) & (C("_m.pb") == keyed[2])
        pick = F.when(hit, F.struct(*[F.coalesce(f"_s.p{c}", c).alias(c) for c in RGB])).otherwise(pick)
    return p.withColumn("c", F.when(~is_background(bg, C("_m")), pick))


def tally(samples: DataFrame, tol: int = 0) -> DataFrame:
    """Votes from samples (frame, i, j, c, w, at): frame, i, j, win (null for background), contested, share and cands (c, share, ord)
    in the order of first appearance (``at``).

    Background wins with more than half of the weight, or without a colour. Otherwise the heaviest colour wins, of equals the one
    that appeared last; its share counts the colours within ``tol`` of it. Partial sums combine before the one shuffle. Weights are whole numbers
    (long or decimal): sums are exact and rounded once to double, so the order of rows decides nothing."""
    per = samples.groupBy("frame", "i", "j", "c").agg(F.sum("w").alias("w"), F.min("at").alias("at"))
    w = C("w").cast("double").alias("w")
    b = per.groupBy("frame", "i", "j").agg(
        F.sum("w").cast("double").alias("total"), F.sum(F.when(C("c").isNull(), C("w")).otherwise(0)).cast("double").alias("bgw"), F.count("c").alias("n"),
        F.max(F.when(C("c").isNotNull(), F.struct(w, "at", "c"))).alias("m"), F.array_sort(F.collect_list(F.struct("at", "c", w))).alias("l"),
    )
    is_bg = (2 * C("bgw") > C("total")) | (C("n") == 0)
    near = lambda x: F.coalesce(P.dist2((x["c"]["r"], x["c"]["g"], x["c"]["b"]), (C("m.c.r"), C("m.c.g"), C("m.c.b"))) <= tol * tol, F.lit(False))
    agree = F.aggregate("l", F.lit(0.0), lambda acc, x: acc + F.when(near(x), x["w"]).otherwise(0.0))
    share = F.when(is_bg, C("bgw")).otherwise(agree) / C("total")
    cands = F.transform("l", lambda x, k: F.struct(x["c"].alias("c"), (x["w"] / C("total")).alias("share"), k.alias("ord")))
    return b.select("frame", "i", "j", F.when(~is_bg, C("m.c")).alias("win"), ((C("n") > 1) | ((C("bgw") > 0) & (C("n") > 0))).alias("contested"), share.alias("share"), cands.alias("cands"))


def _whole(w: Column) -> Column:
    """A real weight of 1 and more (below 1e11) as a whole number of 2**-52, its last place at most: exact."""
    n = F.floor(w)
    return (n.cast("decimal(11,0)") * F.lit(Decimal(2**52)) + ((w - n) * 2.0**52).cast("bigint").cast("decimal(17,0)")).cast("decimal(28,0)")


def _placed(sheet: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sheet pixels with the frame box they may belong to: fx, fy, fw, fh, ord. Boxes of one sheet are a few hundred at most, a
    fixed bound of the format (a canvas holds no more), so they are folded into one array per sheet and filtered there."""
    boxes = manifest.groupBy(C("sheet").alias("_sheet")).agg(F.collect_list(F.struct(C("ord"), C("x").alias("fx"), C("y").alias("fy"), C("w").alias("fw"), C("h").alias("fh"))).alias("boxes"))
    return sheet.join(boxes, C("frame") == C("_sheet"))


def blank(manifest: DataFrame) -> DataFrame:
    """frame, i, j of every source pixel of the manifest's frames."""
    g = manifest.select(C("ord").alias("frame"), C("w"), F.explode(F.sequence(F.lit(0), C("h") - 1)).alias("j"))
    return g.select("frame", F.explode(F.sequence(F.lit(0), C("w") - 1)).alias("i"), "j")


def vote(sheet: DataFrame, manifest: DataFrame, scale: int, palette: DataFrame, bg: tuple[int, int, int], keyed: tuple[int, int, int] | None = None, tol: int = 0, metric: str = "rgb") -> DataFrame:
    """Votes of blocks of scale by scale pixels, weighted by a triangle per axis; integer weights, so sums are exact. Blocks that lie
    outside the sheet are background with share 1."""
    inside = lambda b: (C("x") >= b["fx"]) & (C("x") < b["fx"] + b["fw"] * scale) & (C("y") >= b["fy"]) & (C("y") < b["fy"] + b["fh"] * scale)
    p = _placed(sheet, manifest).withColumn("_b", F.filter("boxes", inside)).select("x", "y", *RGB, "a", F.explode("_b").alias("_b"))
    p = _candidates(p, palette, bg, keyed, metric)
    dx, dy = C("x") - C("_b.fx"), C("y") - C("_b.fy")
    w = F.array(*[F.lit(v) for v in P.axis_weights(scale)])
    weight = lambda d: F.element_at(w, (d % scale + 1).cast("int"))
    s = p.select(C("_b.ord").alias("frame"), P.div(dx, scale).alias("i"), P.div(dy, scale).alias("j"), "c", (weight(dx) * weight(dy)).cast("bigint").alias("w"), ((dy % scale) * scale + dx % scale).cast("bigint").alias("at"))
    return _complete(tally(s, tol), manifest)


def vote_fractional(sheet: DataFrame, grids: DataFrame, scale: int, palette: DataFrame, bg: tuple[int, int, int], keyed: tuple[int, int, int] | None = None, tol: int = 0, metric: str = "rgb") -> DataFrame:
    """The same on grids (sheet, ord, gx, gy, w, h, block) of real origins and block sizes: a pixel votes in the block that holds its
    centre, with a triangle of its place in the block. The real weights are summed exactly."""
    boxes = grids.groupBy(C("sheet").alias("_sheet")).agg(F.collect_list(F.struct("ord", "gx", "gy", "w", "h", "block")).alias("boxes"))
    cx, cy = C("x") + 0.5, C("y") + 0.5
    inside = lambda b: (cx >= b["gx"]) & (cx < b["gx"] + b["w"] * b["block"]) & (cy >= b["gy"]) & (cy < b["gy"] + b["h"] * b["block"])
    p = sheet.join(boxes, C("frame") == C("_sheet")).select("x", "y", *RGB, "a", F.explode(F.filter("boxes", inside)).alias("_b"))
    p = _candidates(p, palette, bg, keyed, metric)

    def axis(c: Column, origin: Column) -> tuple[Column, Column]:
        k = F.floor((c - origin) / C("_b.block")).cast("int")
        t = (c - (origin + k * C("_b.block"))) / C("_b.block")
        return k, F.greatest(F.lit(1.0), (scale - 1) - F.abs(2 * t - 1) * scale / 2)

    (i, wi), (j, wj) = axis(cx, C("_b.gx")), axis(cy, C("_b.gy"))
    s = p.select(C("_b.ord").alias("frame"), i.alias("i"), j.alias("j"), "c", _whole(wi * wj).alias("w"), (C("y").cast("bigint") * 1_000_000 + C("x")).alias("at"))
    return _complete(tally(s, tol), grids)


def _complete(votes: DataFrame, manifest: DataFrame) -> DataFrame:
    out = blank(manifest).join(votes, ["frame", "i", "j"], "left")
    return out.select("frame", "i", "j", "win", F.coalesce("contested", F.lit(False)).alias("contested"), F.coalesce("share", F.lit(1.0)).alias("share"), F.coalesce("cands", F.array().cast(f"array<struct<c:{COLOUR},share:double,ord:int>>")).alias("cands"))


def _near(a: Column, b: Column, tol: int) -> Column:
    """Both background, or both colours within tol."""
    d = P.dist2((a["r"], a["g"], a["b"]), (b["r"], b["g"], b["b"]))
    return (a.isNull() & b.isNull()) | F.coalesce(d <= tol * tol, F.lit(False))


def _as_px(votes: DataFrame) -> DataFrame:
    return votes.select("frame", C("i").alias("x"), C("j").alias("y"), "win", "share", "cands")


def resolve_orphans(votes: DataFrame, weak: float = WEAK, tol: int = 0) -> DataFrame:
    """Votes with ``win`` replaced where it is weak and no neighbour of eight has the same: by the candidate of a fifth of the block
    and more that most neighbours have, of equals the later; unchanged if none has any. Background counts as a candidate."""
    # structs are boxed, as a null struct and an absent neighbour must differ
    v = votes.select("frame", C("i").alias("x"), C("j").alias("y"), F.struct(C("win").alias("c")).alias("box"), "share", "cands", "contested")
    nb = neighbours(v.select("frame", "x", "y", "box"), NB8, ["box"]).select("frame", "x", "y", "nb")
    v = v.join(nb, ["frame", "x", "y"])
    alone = ~F.exists("nb", lambda q: _near(C("box.c"), q["box"]["c"], tol))
    support = lambda k: F.size(F.filter("nb", lambda q: _near(k, q["box"]["c"], tol)))
    tried = F.transform(F.filter("cands", lambda k: k["share"] >= MIN_RESOLVE), lambda k: F.struct(support(k["c"]).alias("n"), k["ord"].alias("ord"), k["c"].alias("c")))
    best = F.array_max(F.filter(tried, lambda t: t["n"] > 0))
    change = (C("share") < weak) & alone & best.isNotNull()
    return v.select("frame", C("x").alias("i"), C("y").alias("j"), F.when(change, best["c"]).otherwise(C("box.c")).alias("win"), "contested", "share", "cands")


def smooth_grain(votes: DataFrame, tol: int) -> DataFrame:
    """Votes with ``win`` of a coloured pixel replaced where no coloured neighbour is within tol but some are within twice that: by the
    near shade, voted for by a twentieth of the block and more, that most neighbours match; of equals the first in order."""
    if tol <= 0:
        raise ValueError("grain needs a tolerance")
    v = votes.select("frame", C("i").alias("x"), C("j").alias("y"), "win", "share", "cands", "contested")
    on = v.where("win is not null")
    nb = neighbours(on.select("frame", "x", "y", "win"), NB8, ["win"]).select("frame", "x", "y", "nb")
    v = v.join(nb, ["frame", "x", "y"], "left").withColumn("nb", F.when(C("win").isNotNull(), C("nb")))
    lone = C("nb").isNotNull() & ~F.exists("nb", lambda q: _near(C("win"), q["win"], tol))
    shades = F.array_sort(F.array_distinct(F.transform(F.filter("nb", lambda q: _near(C("win"), q["win"], 2 * tol)), lambda q: q["win"])))
    voted = lambda k: F.exists("cands", lambda x: F.coalesce(x["c"] == k, F.lit(False)) & (x["share"] >= MIN_GRAIN))
    tried = F.transform(F.filter(shades, voted), lambda k: F.struct(F.size(F.filter("nb", lambda q: _near(k, q["win"], tol))).alias("n"), (-k["r"]).alias("r"), (-k["g"]).alias("g"), (-k["b"]).alias("b"), k.alias("c")))
    best = F.when(lone, F.array_max(tried))
    return v.select("frame", C("x").alias("i"), C("y").alias("j"), F.coalesce(best["c"], C("win")).alias("win"), "contested", "share", "cands")


def to_px(votes: DataFrame) -> DataFrame:
    """Pixels of votes: background is clear black."""
    return votes.select("frame", C("i").alias("x"), C("j").alias("y"), *[F.coalesce(f"win.{c}", F.lit(0)).alias(c) for c in RGB], F.when(C("win").isNull(), 0).otherwise(255).alias("a"))


def histogram(votes: DataFrame) -> DataFrame:
    """Per frame, blocks by tenth of the share (h0 to h9); blocks of nothing but background are left out."""
    some = votes.where(F.exists("cands", lambda k: k["c"].isNotNull()))
    k = F.least(F.lit(9), F.floor(C("share") * 10).cast("int"))
    return some.groupBy("frame").agg(*[F.sum((k == n).cast("int")).alias(f"h{n}") for n in range(10)])


def counters(votes: DataFrame, weak: float = WEAK) -> DataFrame:
    """Per frame: opaque, contested and weak blocks, and colours."""
    on = C("win").isNotNull()
    code = C("win.r") * 65536 + C("win.g") * 256 + C("win.b")
    return votes.groupBy("frame").agg(F.sum(on.cast("int")).alias("opaque"), F.sum(C("contested").cast("int")).alias("contested"), F.sum((on & (C("share") < weak)).cast("int")).alias("weak"), F.count_distinct(code).alias("colors"))


def grid_fit(px: DataFrame, grids: DataFrame) -> DataFrame:
    """Per grid (frame, gx, gy, w, h, block): the share of strong steps between neighbouring pixels that lie within 15 % of a block
    border; 1 without steps. Steps into the first column or row of the box count only from inside it."""
    p = px.join(grids, "frame").where((C("x") >= F.floor("gx")) & (C("x") < F.ceil(C("gx") + C("w") * C("block"))) & (C("y") >= F.floor("gy")) & (C("y") < F.ceil(C("gy") + C("h") * C("block")))).repartition("frame")

    def steps(along: str, across: str, origin: str) -> DataFrame:
        w = Window.partitionBy("frame", across).orderBy(along)
        prev = [F.lag(c).over(w).alias(f"p{c}") for c in RGB]
        q = p.select("frame", C(along).alias("at"), C(origin).alias("origin"), "block", *RGB, *prev, F.lag(along).over(w).alias("before"))
        q = q.where((C("before") == C("at") - 1) & P.strong_edge(rgb("p"), rgb()))
        return q.select("frame", F.pmod((C("at") - C("origin")) / C("block"), F.lit(1.0)).alias("phase"))

    both = steps("x", "y", "gx").unionByName(steps("y", "x", "gy"))
    near = ((C("phase") <= 0.15) | (C("phase") >= 0.85)).cast("int")
    fit = both.groupBy("frame").agg(F.count("*").alias("n"), F.sum(near).alias("k"))
    return grids.select("frame").join(fit, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("edges"), F.coalesce(C("k") / C("n"), F.lit(1.0)).alias("fit"))


def edge_positions(px: DataFrame) -> DataFrame:
    """frame, axis ('x' or 'y'), at: places of strong steps from the pixel before."""
    p = px.repartition("frame")

    def one(along: str, across: str) -> DataFrame:
        w = Window.partitionBy("frame", across).orderBy(along)
        q = p.select("frame", C(along).alias("at"), *RGB, *[F.lag(c).over(w).alias(f"p{c}") for c in RGB], F.lag(along).over(w).alias("before"))
        return q.where((C("before") == C("at") - 1) & P.strong_edge(rgb("p"), rgb())).select("frame", F.lit(along).alias("axis"), "at")

    return one("x", "y").unionByName(one("y", "x"))


def concentration(edges: DataFrame, periods: DataFrame) -> DataFrame:
    """frame, axis, k, period, conc (mean resultant length of the places on a circle of that period) and phase, for periods (k, period).
    Places are counted first, so the periods meet a row per place and not per pixel."""
    n = edges.groupBy("frame", "axis", "at").agg(F.count("*").alias("n")).crossJoin(F.broadcast(periods))  # a fixed number of periods
    t = 2 * F.pi() * C("at") / C("period")
    s = n.groupBy("frame", "axis", "k", "period").agg(F.sum(C("n") * F.sin(t)).alias("sn"), F.sum(C("n") * F.cos(t)).alias("cs"), F.sum("n").alias("c"))
    return s.select("frame", "axis", "k", "period", (F.sqrt(C("sn") * C("sn") + C("cs") * C("cs")) / C("c")).alias("conc"), (F.atan2("sn", "cs") / (2 * F.pi()) * C("period")).alias("phase"))


def scale_search(edges: DataFrame, scale: float, reach: int = 40) -> DataFrame:
    """Per frame: k, period, conc of the period within reach thousandths of ``scale`` with the largest mean concentration of both axes
    (an axis without steps counts 0); the first of those that agree to 12 digits."""
    spark = edges.sparkSession
    ks = spark.range(-reach, reach + 1).select(C("id").cast("int").alias("k"), (F.lit(float(scale)) * (1 + C("id") / 1000)).alias("period"))
    c = concentration(edges, ks).groupBy("frame", "k", "period").agg((F.sum("conc") / 2).alias("conc"))
    best = c.groupBy("frame").agg(F.max(F.struct(F.round("conc", 12).alias("conc"), (-C("k")).alias("nk"), "period")).alias("m"))
    return best.select("frame", (-C("m.nk")).alias("k"), C("m.period").alias("period"), C("m.conc").alias("conc"))


def snapped_origins(edges: DataFrame, found: DataFrame, manifest: DataFrame, k0: float, scale: int) -> DataFrame:
    """sheet, ord, gx, gy, w, h, block: frame boxes moved to the phase of the grid found on their sheet, nearest to their place."""
    ph = edges.join(found.select("frame", "k", "period"), "frame").groupBy("frame", "axis", "period").agg(F.sum(F.sin(2 * F.pi() * C("at") / C("period"))).alias("sn"), F.sum(F.cos(2 * F.pi() * C("at") / C("period"))).alias("cs"))
    ph = ph.withColumn("phase", F.atan2("sn", "cs") / (2 * F.pi()) * C("period")).groupBy("frame", "period").agg(*[F.max(F.when(C("axis") == a, C("phase"))).alias(f"ph{a}") for a in "xy"])
    snap = lambda at, p: F.coalesce(p, F.lit(0.0)) + F.round((at * C("period") / scale - F.coalesce(p, F.lit(0.0))) / C("period")) * C("period")
    m = manifest.join(ph.withColumnRenamed("frame", "sheet"), "sheet")
    return m.select("sheet", "ord", snap(C("x"), C("phx")).alias("gx"), snap(C("y"), C("phy")).alias("gy"), "w", "h", C("period").alias("block"))


def silhouette(px: DataFrame, reference: DataFrame) -> DataFrame:
    """Per frame: percent of places at which both are opaque or both are not; places of either count."""
    b = reference.select("frame", "x", "y", C("a").alias("ra"))
    j = px.select("frame", "x", "y", "a").join(b, ["frame", "x", "y"], "full")
    on = lambda c: F.coalesce(C(c) >= 128, F.lit(False))
    return j.groupBy("frame").agg((F.sum((on("a") == on("ra")).cast("int")) * 100.0 / F.count("*")).alias("agreement"))


def shift_search(solid: DataFrame, reference: DataFrame, reach: int = 2) -> DataFrame:
    """Per frame: the whole-block shift (sx, sy) of ``solid`` (frame, i, j; blocks that are on) at which it agrees with the reference's
    silhouette (frame, x, y, a; all its places) most; of equals the nearest to none, then the first by row. Each reference place asks
    for its 25 shifted blocks: a bounded fan-out and one equi-join."""
    shifts = [(tx, ty) for ty in range(-reach, reach + 1) for tx in range(-reach, reach + 1)]
    asked = reference.select("frame", "x", "y", (C("a") >= 128).alias("on"), F.explode(F.array(*[F.struct(F.lit(tx).alias("tx"), F.lit(ty).alias("ty"), F.lit(k).alias("k")) for k, (tx, ty) in enumerate(shifts)])).alias("s"))
    asked = asked.select("frame", (C("x") + C("s.tx")).alias("i"), (C("y") + C("s.ty")).alias("j"), "on", "s")
    j = asked.join(solid.select("frame", "i", "j", F.lit(True).alias("solid")), ["frame", "i", "j"], "left")
    n = j.groupBy("frame", "s").agg(F.sum((F.coalesce("solid", F.lit(False)) == C("on")).cast("int")).alias("agree"))
    best = n.groupBy("frame").agg(F.max(F.struct("agree", (-(F.abs("s.tx") + F.abs("s.ty"))).alias("near"), (-C("s.k")).alias("k"), "s")).alias("m"))
    return best.select("frame", C("m.s.tx").alias("sx"), C("m.s.ty").alias("sy"), C("m.agree").alias("agree"))
