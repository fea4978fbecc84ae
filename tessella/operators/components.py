"""Connected components within frames, and what is built on them: stabilising, dropping small parts, growing from seeds, cells.

A component never leaves its frame, and a frame fits in a task, so labels come from one union-find pass per frame in Arrow batches;
frames spread over tasks by one shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pixels as P
from .common import C, NB4, RGB, RGBA, rgb


def label_places(x: np.ndarray, y: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """A component number per place: the index of its first place by row then column."""
    order = np.lexsort((x, y))
    xs, ys = x[order], y[order]
    width = int(xs.max() - xs.min()) + 3
    code = (ys - ys.min()).astype(np.int64) * width + (xs - xs.min()) + 1
    label = np.arange(len(code))
    steps = [1, width] + ([width - 1, width + 1] if diagonal else [])
    links = []
    for s in steps:
        at = np.searchsorted(code, code + s)
        hit = (at < len(code)) & (code[np.minimum(at, len(code) - 1)] == code + s)
        links.append((np.flatnonzero(hit), at[hit]))
    a, b = (np.concatenate(v) for v in zip(*links))
    while True:  # the smallest label spreads over links; labels then point at their label's label
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    out = np.empty(len(code), np.int64)
    out[order] = label
    return out


def components(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """frame, x, y, comp: comp is the code ``y * 65536 + x`` of the component's first place by row then column. An empty mask gives no row."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(np.int64), pdf["y"].to_numpy(np.int64)
        order = np.lexsort((x, y))
        first = order[label_places(x, y, diagonal)]
        return pdf.assign(comp=y[first] * 65536 + x[first])

    return mask.select("frame", "x", "y").distinct().groupBy("frame").applyInPandas(one, "frame bigint, x int, y int, comp bigint")


def component_table(labelled: DataFrame) -> DataFrame:
    """frame, comp, n, x0, y0, x1, y1, cx, cy: size, box and centre of each component."""
    return labelled.groupBy("frame", "comp").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def differing(px: DataFrame, base: DataFrame, tol: float = 48) -> DataFrame:
    """frame, x, y where opacity differs, or both are opaque and over ``tol`` apart by red mean."""
    b = base.select("frame", "x", "y", *[C(c).alias(f"b{c}") for c in RGBA])
    j = px.join(b, ["frame", "x", "y"])
    flip = P.opaque() != P.opaque("ba")
    return j.where(flip | (P.opaque() & (P.redmean(rgb(), rgb("b")) > tol))).select("frame", "x", "y")


def stabilize(px: DataFrame, base: DataFrame, min_region: int = 8, tol: float = 48) -> DataFrame:
    """px with differences from the base put back where they form patches of fewer than ``min_region`` pixels; ``reverted`` marks them."""
    lab = components(differing(px, base, tol))
    small = component_table(lab).where(C("n") < min_region).select("frame", "comp")
    back = lab.join(small, ["frame", "comp"]).select("frame", "x", "y", F.lit(True).alias("reverted"))
    b = base.select("frame", "x", "y", *[C(c).alias(f"b{c}") for c in RGBA])
    j = px.join(back, ["frame", "x", "y"], "left").join(b, ["frame", "x", "y"], "left")
    hit = F.coalesce("reverted", F.lit(False))
    return j.select("frame", "x", "y", *[F.when(hit, C(f"b{c}")).otherwise(C(c)).alias(c) for c in RGBA], hit.alias("reverted"))


def drop_small(px: DataFrame, least: int, diagonal: bool = True) -> DataFrame:
    """px without the opaque components of fewer than ``least`` pixels."""
    lab = components(px.where(P.opaque()), diagonal)
    gone = lab.join(component_table(lab).where(C("n") < least).select("frame", "comp"), ["frame", "comp"]).select("frame", "x", "y")
    return px.join(gone, ["frame", "x", "y"], "left_anti")


def touching(labelled: DataFrame, other: DataFrame, offsets: list[tuple[int, int]] = NB4) -> DataFrame:
    """frame, comp, n, touches: how many of a component's places have a neighbour in the other mask."""
    o = other.select("frame", F.explode(F.array(*[F.struct((C("x") - dx).alias("x"), (C("y") - dy).alias("y")) for dx, dy in offsets])).alias("p")).select("frame", "p.x", "p.y").distinct().withColumn("_t", F.lit(1))
    j = labelled.join(o, ["frame", "x", "y"], "left")
    return j.groupBy("frame", "comp").agg(F.count("*").alias("n"), F.count("_t").alias("touches"))


def border_majority(labelled: DataFrame, px: DataFrame, kind: str = "_kind") -> DataFrame:
    """frame, comp, kind, n: the commonest kind (a column of px) among the neighbours of a component that are not in it; the first of equals."""
    lab = labelled.select("frame", "x", "y", "comp")
    around = lab.select("frame", "comp", F.explode(F.array(*[F.struct((C("x") + dx).alias("x"), (C("y") + dy).alias("y")) for dx, dy in NB4])).alias("p")).select("frame", "comp", "p.x", "p.y").distinct()
    own = lab.select("frame", "comp", "x", "y")
    around = around.join(own, ["frame", "comp", "x", "y"], "left_anti").join(px.select("frame", "x", "y", C(kind).alias("kind")), ["frame", "x", "y"])
    n = around.groupBy("frame", "comp", "kind").agg(F.count("*").alias("n"))
    return n.groupBy("frame", "comp").agg(F.min(F.struct((-C("n")).alias("n"), "kind")).alias("m")).select("frame", "comp", "m.kind", (-C("m.n")).alias("n"))


def grow(seeds: DataFrame, allowed: DataFrame, diagonal: bool = False, radius: int | None = None) -> DataFrame:
    """frame, x, y: allowed places reached from seeds over allowed neighbours; seeds themselves count as allowed. With a radius, only places
    at most so many columns and rows from a seed."""
    s = seeds.select("frame", "x", "y").distinct().withColumn("seed", F.lit(1))
    m = allowed.select("frame", "x", "y", F.lit(0).alias("seed")).union(s).groupBy("frame", "x", "y").agg(F.max("seed").alias("seed"))
    if radius is not None:
        from .neighbourhood import dilate

        m = m.join(dilate(seeds, radius), ["frame", "x", "y"], "left_semi")
    lab = components(m, diagonal)
    hit = lab.join(s.select("frame", "x", "y"), ["frame", "x", "y"]).select("frame", "comp").distinct()
    return lab.join(hit, ["frame", "comp"]).select("frame", "x", "y")


def depth(mask: DataFrame) -> DataFrame:
    """frame, x, y, d: steps over four neighbours to the nearest place outside the mask, 1 at its edge. The city-block distance is found per row and
    column of a frame in two sweeps."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        g = np.zeros((y.max() - y.min() + 3, x.max() - x.min() + 3), np.int64)
        at = (y - y.min() + 1, x - x.min() + 1)
        g[at] = g.size
        for _ in range(2):
            for k in range(1, len(g)):
                g[k] = np.minimum(g[k], g[k - 1] + 1)
            for k in range(1, g.shape[1]):
                g[:, k] = np.minimum(g[:, k], g[:, k - 1] + 1)
            g = g[::-1, ::-1]
        return pdf.assign(d=g[at].astype(np.int32))

    return mask.select("frame", "x", "y").distinct().groupBy("frame").applyInPandas(one, "frame bigint, x int, y int, d int")


def split_cells(px: DataFrame, width: int, height: int, rows: int, cols: int) -> DataFrame:
    """px with ``cell``: opaque blobs go whole to the cell of a rows by cols layout that holds their centre of mass."""
    lab = components(px.where(P.opaque()))
    t = lab.groupBy("frame", "comp").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    cell = F.least(F.floor(C("cy") * rows / height).cast("int"), F.lit(rows - 1)) * cols + F.least(F.floor(C("cx") * cols / width).cast("int"), F.lit(cols - 1))
    return px.join(lab.join(t.select("frame", "comp", cell.alias("cell")), ["frame", "comp"]).select("frame", "x", "y", "cell"), ["frame", "x", "y"])


def near_components(labelled: DataFrame, other: DataFrame, gap: int) -> DataFrame:
    """frame, comp of components with a place within ``gap`` columns and rows of the other mask."""
    from .neighbourhood import dilate

    return labelled.join(dilate(other, gap), ["frame", "x", "y"], "left_semi").select("frame", "comp").distinct()


def body_axis(mask: DataFrame, head: DataFrame, step: float = 22.5) -> DataFrame:
    """frame, hx, hy, cx, cy, angle, snapped, span: the direction in degrees from the head's centre to the mask's, also snapped to a multiple of
    ``step`` (half to even), and their distance."""
    a = mask.groupBy("frame").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    h = head.groupBy("frame").agg(F.avg("x").alias("hx"), F.avg("y").alias("hy"))
    d = F.degrees(F.atan2(C("cy") - C("hy"), C("cx") - C("hx")))
    return a.join(h, "frame").select("frame", "hx", "hy", "cx", "cy", d.alias("angle"), (F.bround(d / step) * step).alias("snapped"), F.sqrt((C("cx") - C("hx")) ** 2 + (C("cy") - C("hy")) ** 2).alias("span"))


def zones(px: DataFrame, axis: DataFrame, cuts: list[float]) -> DataFrame:
    """px with t (place along the body axis, 0 at the head, 1 at the centre), v (across it) and zone: cuts that t has passed."""
    u = [F.cos(F.radians("snapped")), F.sin(F.radians("snapped"))]
    j = px.join(axis.select("frame", "hx", "hy", "snapped", "span"), "frame")
    dx, dy = C("x") - C("hx"), C("y") - C("hy")
    t = (dx * u[0] + dy * u[1]) / F.when(C("span") > 0, C("span"))
    j = j.withColumn("t", t).withColumn("v", dx * u[1] - dy * u[0])
    return j.withColumn("zone", sum(((C("t") >= c).cast("int") for c in cuts), F.lit(0))).drop("hx", "hy", "snapped", "span")
