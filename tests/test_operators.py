"""Small cases with known answers, and properties."""

import numpy as np
import pytest
from conftest import picture, px_of
from pyspark.sql import functions as F

from tessella.functions import palettes, pixels as P
from tessella.operators import alignment, animations, components, layout, masks, neighbourhood as nh, palette_ops, pipelines, samples, votes

RED, GREY, BLUE = (200, 30, 30), (100, 100, 100), (10, 10, 200)
K = {"r": RED, "g": GREY, "b": BLUE}


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def as_text(df, colours=K):
    back = {v: k for k, v in colours.items()}
    p = {(r["x"], r["y"]): "." if r["a"] < 128 else back.get((r["r"], r["g"], r["b"]), "?") for r in df.collect()}
    w, h = max(x for x, _ in p) + 1, max(y for _, y in p) + 1
    return " ".join("".join(p.get((x, y), ".") for x in range(w)) for y in range(h))


def test_words_are_fixed_points(spark):
    w = spark.range(65536).select(F.col("id").cast("int").alias("w"))
    r, g, b = P.from_565(F.col("w"))
    assert w.where(P.to_565(r, g, b) != F.col("w")).count() == 0
    r, g, b = P.from_565_scaled(F.col("w"))
    assert w.where(P.to_565(r, g, b) != F.col("w")).count() == 0


def test_nearest_by_metric(spark):
    pal = palettes.table(spark, [(206, 158, 115), (239, 150, 140)])
    p = px_of(spark, [(0, 0, 0, 224, 131, 114, 255)])
    assert rows(palette_ops.nearest(p, pal), "r") == [(206,)] and rows(palette_ops.nearest(p, pal, "redmean"), "r") == [(239,)]


def test_nearest_long_palette_and_ties(spark):
    pal = [(i, 255 - i, i * 7 % 256) for i in range(90)]
    p = px_of(spark, [(0, i, 0, i * 3 % 256, i * 5 % 256, i * 11 % 256, 255) for i in range(200)])
    want = sorted((i, *min((sum((a - b) ** 2 for a, b in zip(c, (i * 3 % 256, i * 5 % 256, i * 11 % 256))), k, c) for k, c in enumerate(pal))[2]) for i in range(200))
    assert rows(palette_ops.nearest(p, palettes.table(spark, pal)), "x", "r", "g", "b") == want
    tie = palettes.table(spark, [(10, 0, 0), (0, 10, 0)])
    assert rows(palette_ops.nearest(px_of(spark, [(0, 0, 0, 0, 0, 0, 255)]), tie), "r", "g") == [(10, 0)]


def test_weights():
    assert P.axis_weights(3) == [1, 2, 1] and P.axis_weights(1) == [1] and P.axis_weights(5) == P.axis_weights(5)[::-1]


def man(spark, w, h):
    return spark.createDataFrame([(0, 0, 0, 0, w, h)], "sheet bigint, ord bigint, x int, y int, w int, h int")


def test_vote_contested_block(spark):
    sheet = px_of(spark, picture("ggg grg ggg", K))
    pal = palettes.table(spark, [RED, GREY])
    v = votes.vote(sheet, man(spark, 1, 1), 3, pal, (255, 0, 255)).first()
    assert v["win"]["r"] == 100 and v["contested"] and v["share"] == 0.75
    v = votes.vote(sheet, man(spark, 1, 1), 3, pal, GREY).first()
    assert v["win"] is None and v["share"] == 0.75


def test_vote_half_and_outside(spark):
    sheet = px_of(spark, picture("ggrr ggrr ggrr ggrr", K))
    v = votes.vote(sheet, man(spark, 2, 1), 4, palettes.table(spark, [RED, GREY]), (255, 0, 255))
    got = {r["i"]: r for r in v.collect()}
    assert got[0]["share"] <= 0.5 and got[1]["win"] is None and got[1]["share"] == 1.0 and not got[1]["contested"]


def test_fractional_vote_equals_integer_vote(spark):
    rng = np.random.default_rng(3)
    sheet = px_of(spark, [(0, x, y, *K["rgb"[rng.integers(3)]], 255) for x in range(16) for y in range(16)])
    pal = palettes.table(spark, [RED, GREY, BLUE])
    a = votes.vote(sheet, man(spark, 5, 5), 3, pal, (255, 0, 255))
    g = spark.createDataFrame([(0, 0, 0.0, 0.0, 5, 5, 3.0)], "sheet bigint, ord bigint, gx double, gy double, w int, h int, block double")
    b = votes.vote_fractional(sheet, g, 3, pal, (255, 0, 255))
    cut = ["i", "j", "win.r", F.round("share", 9)]
    assert rows(a, *cut) == rows(b, *cut)


#: Blocks of a grid at (1.25, 0.75) of 4.375 whose heaviest colours weigh the same but for rounding, or whose background has half: column and row of the block,
#: its first pixel, its pixels.
TIED = [(7, 11, 32, 49, "aa.b accd dead ad.d"), (4, 11, 19, 49, ".a.b a.a. ..a. aaa."), (5, 10, 23, 44, ".cda bbcd .bfa cfda .cad"), (7, 0, 32, 1, "cc.d cg.g ..fa ddaa")]
INK = {"a": (126, 37, 83), "b": (0, 0, 0), "c": (29, 43, 83), "d": (255, 0, 77), "e": (194, 195, 199), "f": (171, 82, 54), "g": (0, 135, 81)}


def test_fractional_votes_hang_on_no_order(spark):
    """Whatever the order of rows, the vote goes by the sums of the real weights, rounded once."""
    import math

    px = [(f, x + x0, y + y0, *c) for f, (_, _, x0, y0, text) in enumerate(TIED) for _, x, y, *c in picture(text, INK, f)]
    weight = lambda c, o, k: max(1.0, 3 - abs(2 * ((c + 0.5 - (o + k * 4.375)) / 4.375) - 1) * 4 / 2)
    want = {}
    for f, (i, j, *_) in enumerate(TIED):
        by, first = {}, {}
        for _, x, y, *c, a in sorted((p for p in px if p[0] == f), key=lambda p: (p[2], p[1])):
            k = tuple(c) if a else None
            by.setdefault(k, []).append(weight(x, 1.25, i) * weight(y, 0.75, j))
            first.setdefault(k, (y, x))
        bg, total = math.fsum(by.pop(None, [])), math.fsum(weight(p[1], 1.25, i) * weight(p[2], 0.75, j) for p in px if p[0] == f)
        best = max(by, key=lambda k: (math.fsum(by[k]), first[k]))
        want[f] = (None, bg / total) if 2 * bg > total else (best, math.fsum(by[best]) / total)
    pal = palettes.table(spark, list(INK.values()))
    grids = spark.createDataFrame([(f, f, 1.25, 0.75, 14, 14, 4.375) for f in want], "sheet bigint, ord bigint, gx double, gy double, w int, h int, block double")
    for rows_ in (px, px[::-1], sorted(px, key=lambda p: (p[1], p[2]))):
        v = votes.vote_fractional(px_of(spark, rows_).coalesce(1), grids, 4, pal, (255, 0, 255))
        got = {(r["frame"], r["i"], r["j"]): (r["win"] and tuple(r["win"]), r["share"]) for r in v.collect()}
        for f, (i, j, *_) in enumerate(TIED):
            assert got[f, i, j][0] == want[f][0] and abs(got[f, i, j][1] - want[f][1]) < 1e-15


def votes_of(spark, grid):
    """Votes from {(i, j): (win, share, [(colour, share)])}."""
    s = lambda c: None if c is None else dict(zip("rgb", c))
    data = [(0, i, j, s(w), False, sh, [(s(c), x, k) for k, (c, x) in enumerate(cs)]) for (i, j), (w, sh, cs) in grid.items()]
    return spark.createDataFrame(data, f"frame bigint, i int, j int, win {votes.COLOUR}, contested boolean, share double, cands array<struct<c:{votes.COLOUR},share:double,ord:int>>")


@pytest.mark.parametrize("share, line, want", [(0.5, False, GREY), (0.5, True, RED), (0.9, False, RED)])
def test_resolve(spark, share, line, want):
    grid = {(i, j): (GREY, 1.0, [(GREY, 1.0)]) for i in range(3) for j in range(3)}
    if line:
        grid |= {(1, j): (RED, 1.0, [(RED, 1.0)]) for j in range(3)}
    grid[1, 1] = (RED, share, [(RED, share), (GREY, 1 - share)])
    out = votes.resolve_orphans(votes_of(spark, grid)).where("i = 1 and j = 1").first()
    assert out["win"]["r"] == want[0]


@pytest.mark.parametrize("colour, voted, changed", [((130, 120, 110), 0.2, True), ((130, 120, 110), 0.0, False), ((250, 20, 10), 0.2, False)])
def test_grain(spark, colour, voted, changed):
    grid = {(i, j): (GREY, 1.0, [(GREY, 1.0)]) for i in range(3) for j in range(3)}
    grid[1, 1] = (colour, 0.8, [(colour, 1 - voted), (GREY, voted)] if voted else [(colour, 1.0)])
    out = votes.smooth_grain(votes_of(spark, grid), 24).where("i = 1 and j = 1").first()
    assert (out["win"]["r"] == 100) == changed
    with pytest.raises(ValueError):
        votes.smooth_grain(votes_of(spark, grid), 0)


def test_grid_fit(spark):
    text = " ".join("".join("rb"[(x // 4 + y // 4) % 2] for x in range(16)) for y in range(16))
    g = lambda o: spark.createDataFrame([(0, o, o, 4.0, 4.0, 4.0)], "frame bigint, gx double, gy double, w double, h double, block double")
    p = px_of(spark, picture(text, K))
    assert votes.grid_fit(p, g(0.0)).first()["fit"] == 1.0 and votes.grid_fit(p, g(2.0)).first()["fit"] < 0.1
    flat = px_of(spark, picture("rr rr", K))
    assert votes.grid_fit(flat, g(0.0)).first()["fit"] == 1.0


def test_scale_search_finds_period(spark):
    text = " ".join("".join("rb"[(int(x / 5) * 7 + int(y / 5) * 3) % 2] for x in range(40)) for y in range(40))
    p = px_of(spark, picture(text, K))
    assert abs(votes.scale_search(votes.edge_positions(p), 5.1).first()["period"] - 5) < 0.03


def test_snap(spark):
    rng = np.random.default_rng(5)
    small = [["rgb"[rng.integers(3)] for _ in range(18)] for _ in range(17)]
    big = " ".join("".join(small[y // 8][x // 8] for x in range(144)) for y in range(136))
    out = pipelines.snap(px_of(spark, picture(big, K)), palettes.table(spark, [RED, GREY, BLUE]), (255, 0, 255))
    assert as_text(out) == " ".join("".join(r) for r in small)
    with pytest.raises(ValueError):
        pipelines.snap(px_of(spark, picture("rr rr", K)), palettes.table(spark, [RED]), (255, 0, 255))


def test_despeckle(spark):
    p = px_of(spark, picture("ggg.. g.g.r ggg..", K))
    assert as_text(nh.despeckle(p)).split() == ["ggg", "ggg", "ggg"] or as_text(nh.despeckle(p)) == "ggg.. ggg.. ggg.."
    r = nh.despeckle_report(p).first()
    assert (r["specks"], r["holes"]) == (1, 1)


def test_polygons(spark):
    full = px_of(spark, [(0, x, y, 1, 1, 1, 255 if y else 0) for x in range(10) for y in range(10)])
    sq = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]

    def count(spec):
        polys, lines = masks.edges({0: [spec]})
        return masks.rasterised(full, spark.createDataFrame(polys, masks.SPEC), spark.createDataFrame(lines, masks.LINES), 10, 10).count()

    assert count({"add": [sq(2, 8)]}) == 36
    assert count({"add": [sq(0, 10)]}) == 90
    assert count({"add": [sq(0, 10)], "sub": [sq(2, 8)]}) == 90 - 36
    assert count({"add": [sq(0, 10)], "sub_lines": [((0, 5), (10, 5), 3)]}) <= 80
    assert count({"add": [sq(0, 10)], "sub": [[(0, 0), (1, 1)]]}) == 90


def test_recolour_properties(spark):
    p = px_of(spark, [(0, x, 0, x * 60, x * 60, x * 60, 255) for x in range(4)] + [(0, 4, 0, 9, 9, 9, 0)])
    m = p.where("a > 0").select("frame", "x", "y")
    out = {r["x"]: r for r in masks.recolour_region(p, m, [(0, 0, 0), (128, 128, 128), (255, 255, 255)]).collect()}
    bins = [out[x]["bin"] for x in range(4)]
    assert bins == sorted(bins) and bins[0] == 0 and bins[-1] == 2 and out[4]["bin"] is None and out[4]["r"] == 9
    with pytest.raises(ValueError):
        masks.recolour_region(p, m, [])
    with pytest.raises(ValueError):
        masks.recolour_region(p, m, [(0, 0, 0)], [1.0])


def test_remix_outside_is_original(spark):
    a, b = px_of(spark, picture("rrr rrr", K)), px_of(spark, picture("b.b bbb", K))
    m = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "frame bigint, x int, y int")
    assert as_text(masks.remix(b, a, m)) == "brr rrr" and as_text(masks.remix(b, a, m, alpha=True)) == "b.r rrr"


def test_components_and_stabilize(spark):
    base = [(0, x, y, 100, 100, 100, 255) for x in range(16) for y in range(16)]
    edit = [(f, x, y, *(RED if (x, y) == (3, 3) or (8 <= x < 12 and 8 <= y < 12) else (100, 100, 100)), 255) for f, x, y, *_ in base]
    out = {(r["x"], r["y"]): r for r in components.stabilize(px_of(spark, edit), px_of(spark, base)).collect()}
    assert out[3, 3]["r"] == 100 and out[3, 3]["reverted"] and out[9, 9]["r"] == 200
    empty = components.components(px_of(spark, base).where("x > 99"))
    assert empty.count() == 0


def test_component_labels_match_flood_fill():
    rng = np.random.default_rng(2)
    for diagonal in (True, False):
        for _ in range(20):
            y, x = np.nonzero(rng.random((12, 15)) < 0.45)
            if not len(x):
                continue
            got = components.label_places(x, y, diagonal)
            left, want = set(zip(x, y)), {}
            for s in sorted(left, key=lambda p: (p[1], p[0])):
                if s in want:
                    continue
                todo = [s]
                want[s] = s
                while todo:
                    cx, cy = todo.pop()
                    for dx in (-1, 0, 1):
                        for dy in (-1, 0, 1):
                            n = (cx + dx, cy + dy)
                            if (diagonal or not (dx and dy)) and n in left and n not in want:
                                want[n] = s
                                todo.append(n)
            pairs = {(g, want[p]) for g, p in zip(got.tolist(), zip(x, y))}
            assert len(pairs) == len(set(got.tolist())) == len(set(want.values()))


def test_split_cells(spark):
    p = px_of(spark, picture("rr...... rr...... ...bbb.. ...bbb.. ........ ........ ........ ........", K))
    got = components.split_cells(p, 8, 8, 2, 2).groupBy("cell").count()
    assert rows(got, "cell", "count") == [(0, 4), (1, 6)] or rows(got, "cell", "count") == [(0, 10)]


def test_best_shift_known(spark):
    rng = np.random.default_rng(1)
    a = [(0, x, y, *map(int, rng.integers(0, 255, 3)), 255) for x in range(10) for y in range(10)]
    b = [(1, x + 2, y - 1, *c) for _, x, y, *c in a]
    pairs = spark.createDataFrame([(0, 1, 0, 0)], "f bigint, g bigint, sx int, sy int")
    r = alignment.best_shift(px_of(spark, a), px_of(spark, b), pairs).first()
    assert (r["dx"], r["dy"]) == (-2, 1) and r["miss"] == 0


def test_graft_moves_changes(spark):
    def figure(f, x0, colour):
        return [(f, x, y, *(colour if x0 <= x < x0 + 4 and 5 <= y < 15 else BLUE), 255) for x in range(20) for y in range(20)]

    stock = px_of(spark, figure(0, 5, RED) + figure(1, 7, RED))
    done = px_of(spark, figure(1, 7, GREY))
    mask = stock.where("r = 200").select("frame", "x", "y")
    s = spark.createDataFrame([(0, 1, -2, 0)], "f bigint, g bigint, dx int, dy int")
    out = alignment.graft(stock, done, mask, s)
    assert out.where("grafted").count() == 40 and out.where("r = 200").count() == 0
    st = alignment.graft(stock, done, mask, s, stamp=True)
    assert st.where("grafted and r = 100").count() == 40


def test_fill_holes(spark):
    now, stock = picture("rrrr r..r rrrr", K), picture("rrrr rbbr rrrr", K)
    out = nh.fill_holes(px_of(spark, now), px_of(spark, stock), px_of(spark, now).where("x > 99").select("frame", "x", "y"))
    assert as_text(out) == "rrrr rrrr rrrr"


def test_fit_and_shrink(spark):
    p = px_of(spark, [(0, x, y, *RED, 255 if 4 <= x < 16 and 4 <= y < 16 else 0) for x in range(20) for y in range(20)])
    small = layout.fit(p, 8, 8)
    assert rows(small.select("r").distinct(), "r") == [(200,)] and small.count() == 36
    same = layout.fit(p, 32, 32)
    assert same.count() == 144 and same.agg(F.min("x")).first()[0] == 10


def test_reduce_colours(spark):
    p = px_of(spark, [(0, i, 0, i * 30, 255 - i * 30, i * 10, 255) for i in range(8)])
    assert palette_ops.reduce_colours(p, 3).select("r", "g", "b").distinct().count() <= 3
    assert rows(palette_ops.reduce_colours(p, 8), "x", "r") == rows(p, "x", "r")


def test_pad_plan_places():
    assert layout.parse_pad("2") == (2, 2, 2, 2) and layout.parse_pad("1,2,3,4") == (1, 2, 3, 4)
    assert layout.repeat_places(1, 4, 9, 2) == [(4, 2)] and layout.repeat_places(3, 0, 5, 1) == [(0, 1), (3, 1), (5, 1)]
    assert layout.fits([(110, 90)] * 2, 5) == 2 and layout.fits([(300, 300)], 5) is None
    assert layout.plan([(0, 1, 60, 60), (0, 2, 60, 60), (1, 3, 20, 20)], 5) == [([1, 2, 3], 2)] or layout.plan([(0, 1, 60, 60)], 5) == [([1], 1)]


def test_sheet_and_back(spark):
    p = px_of(spark, picture("rb gr bb", K) + picture("ggg brg", K, 1))
    f = layout.sizes(p).select(F.lit(0).cast("bigint").alias("sheet"), F.col("frame").alias("ord"), F.col("width").alias("w"), F.col("height").alias("h"))
    m = layout.sheet_manifest(f, 3, 2, 1)
    s = layout.sheet(p, m, 3, (255, 0, 255))
    out = pipelines.downscale(s, m, 3, palettes.table(spark, [RED, GREY, BLUE]), (255, 0, 255))
    assert rows(out, "frame", "x", "y", "r", "g", "b") == rows(p, "frame", "x", "y", "r", "g", "b")
    reg = pipelines.downscale(s, m, 3, palettes.table(spark, [RED, GREY, BLUE]), (255, 0, 255), register=True, reference=p)
    assert reg.count() == p.count()


def test_sheet_pads_unused_rows(spark):
    f = spark.createDataFrame([(0, k, 2, 2) for k in range(4)], "sheet bigint, ord bigint, w int, h int")
    assert layout.sheet_manifest(f, 1, 3, 3).first()["canvas_h"] == 2 * 2 + 3 * 2


def test_overlay_keeps_alpha(spark):
    p = px_of(spark, [(0, 0, 0, 100, 0, 0, 200)])
    layer = spark.createDataFrame([(0, 0, 200, 0, 0, 128)], "x int, y int, r int, g int, b int, a int")
    r = layout.overlay(p, layer, (0, 0)).first()
    assert (r["r"], r["a"]) == ((200 * 128 + 100 * 127 + 127) // 255, 200)


def test_grow_keeps_screen_place(spark):
    g = spark.createDataFrame([(1, 2, 3, 1, 0)], "frame int, l int, t int, r int, b int")
    s = spark.createDataFrame([(0, 0, 1, 5, 6, 7)], "anim int, step int, frame int, x int, y int, z int")
    r = animations.grow_steps(s, g).first()
    assert (r["x"], r["y"], r["z"]) == (7, 7, 10)


def test_hold_uses_all_steps(spark):
    s = spark.createDataFrame([(0, 5, 1, 9, 0, 9, 0), (1, 0, 2, 3, 0, 4, 0)], "anim int, step int, frame int, x int, y int, z int, last int")
    p = px_of(spark, [(2, 0, 0, *RED, 255)])
    out = alignment.hold(s, p, spark.createDataFrame([(1, 2)], "frame int, src int")).first()
    assert (out["frame"], out["x"], out["y"]) == (1, 6, 5)


def test_smooth_carries_unchanged(spark):
    body = lambda f, c: [(f, x, y, *c, 255) for x in range(6) for y in range(6)]
    stock = px_of(spark, body(1, RED) + body(2, RED))
    drawn = px_of(spark, body(1, (50, 50, 50)) + body(2, (60, 60, 60)))
    steps = spark.createDataFrame([(0, 0, 1, 0, 0, 0, 1), (0, 1, 2, 0, 0, 0, 1)], "anim int, step int, frame int, x int, y int, z int, last int")
    out = pipelines.smooth(stock, drawn, layout.boxes(stock), steps)
    assert {r["r"] for r in out.collect()} == {50} and out.count() == 72


def test_long_palettes_give_what_short_ones_do(spark, monkeypatch):
    """Every operator on palettes, with the palette as literals and as one value."""
    p = px_of(spark, [(f, x, y, (x * 37 + f * 50) % 256, y * 29 % 256, (x * y * 11) % 256, 255 if (x + y) % 5 else 60) for f in (0, 1) for x in range(9) for y in range(8)])
    pal = palettes.table(spark, [(i * 25 % 256, i * 61 % 256, i * 97 % 256) for i in range(20)] + [(0, 0, 0)])

    def all_():
        out = [palette_ops.nearest(p, pal), palette_ops.nearest(p, pal, "redmean"), palette_ops.second_nearest(p, pal, (0, 0, 0)), palette_ops.decided(p, pal, (128, 128, 128)), palette_ops.conform(p, pal, key=(0, 0, 0), input_key=(0, 29, 0))]
        return [sorted(map(tuple, d.collect()), key=str) for d in out]

    short = all_()
    monkeypatch.setattr(palette_ops, "INLINE", 3)
    assert all_() == short


def _slow_smooth(stock, drawn, boxes, seqs):
    """Frames as dicts of places, carried one after the other."""
    zero = (0, 0, 0, 0)
    on = lambda p: p[3] >= 128
    same = lambda p, q: sum(abs(p[i] - q[i]) for i in range(3)) <= 30 if on(p) and on(q) else on(p) == on(q)
    close = lambda p, q: sum((p[i] - q[i]) ** 2 for i in range(3)) <= 64 * 64 if on(p) and on(q) else on(p) == on(q)

    def shift(a, f, b, g):
        foot = lambda k: (boxes[k][0] + boxes[k][2] // 2, boxes[k][1] + boxes[k][3])
        sx, sy = foot(f)[0] - foot(g)[0], foot(f)[1] - foot(g)[1]
        best = None
        for dy in range(sy - 3, sy + 4):
            for dx in range(sx - 3, sx + 4):
                n = bad = 0
                for (x, y), p in a[f].items():
                    q = b[g].get((x - dx, y - dy), zero)
                    if on(p) or on(q):
                        n, bad = n + 1, bad + (not same(p, q))
                if n and (best is None or bad / n < best[0]):
                    best = (bad / n, dx, dy)
        return best

    done = {}
    for seq in seqs:
        if not set(seq) & set(done):
            pick = seq if len(seq) <= 10 else [seq[i * len(seq) // 10] for i in range(10)]
            totals = [(round(sum(shift(drawn, f, drawn, g)[0] for g in pick if g != f), 12), k) for k, f in enumerate(pick)]
            at = seq.index(pick[min(totals)[1]])
            seq = seq[at:] + seq[:at]
        prev = None
        for f in seq:
            if f not in done:
                done[f] = dict(drawn[f])
                if prev is not None:
                    _, dx, dy = shift(stock, f, stock, prev)
                    x0, y0, w, h = boxes[f]
                    for (x, y), p in drawn[f].items():
                        if not (x0 <= x < x0 + w and y0 <= y < y0 + h and on(stock[f][x, y])):
                            continue
                        was = done[prev].get((x - dx, y - dy), zero)
                        around = [(x + i, y + k) for i in (-1, 0, 1) for k in (-1, 0, 1)]
                        patch = [stock[f].get(q, zero) for q in around]
                        sure = len(set(patch)) >= 3 and patch == [stock[prev].get((u - dx, v - dy), zero) for u, v in around]
                        if same(stock[f][x, y], stock[prev].get((x - dx, y - dy), zero)) and (close(p, was) or sure):
                            done[f][x, y] = was
            prev = f
    return done


def test_smooth_matches_a_walk(spark):
    """Forty frames in three animations that share some, each a moved and changed body."""
    import random

    rng = random.Random(8)
    base = {(x, y): (rng.choice([40, 90, 200]), rng.choice([30, 160]), 60, 255) for x in range(2, 6) for y in range(2, 7)}
    stock, drawn = {}, {}
    for f in range(40):
        mx, my = rng.randrange(-1, 2), rng.randrange(-1, 2)
        body = {(x + mx, y + my): c if rng.random() < 0.9 else (250, 0, 0, 255) for (x, y), c in base.items()}
        stock[f] = {(x, y): body.get((x, y), (0, 0, 0, 0)) for x in range(8) for y in range(9)}
        drawn[f] = {k: tuple(min(255, v + rng.choice([0, 10, 45])) for v in c[:3]) + (c[3],) if rng.random() < 0.97 else (9, 9, 9, 255) for k, c in stock[f].items()}
    seqs = [rng.sample(range(25), 14), rng.sample(range(26, 40), 13), [3, *rng.sample(range(20, 40), 8)]]
    table = lambda d: px_of(spark, [(f, x, y, *c) for f, m in d.items() for (x, y), c in m.items()])
    played = sorted({f for q in seqs for f in q})
    s, g = table(stock), table({f: drawn[f] for f in played})
    boxes = {r["frame"]: (r["cx"], r["cy"], r["cw"], r["ch"]) for r in layout.boxes(s).collect()}
    steps = spark.createDataFrame([(a, i, f, 0, 0, 0, len(q) - 1) for a, q in enumerate(seqs) for i, f in enumerate(q)], "anim int, step int, frame int, x int, y int, z int, last int")
    got = {}
    for r in pipelines.smooth(s, g, layout.boxes(s), steps).collect():
        got.setdefault(r["frame"], {})[r["x"], r["y"]] = tuple(r[c] for c in ("r", "g", "b", "a"))
    want = _slow_smooth(stock, drawn, boxes, seqs)
    assert got.keys() == want.keys() and all(got[f] == want[f] for f in want)
    half = {f: want[f] for f in seqs[1][4:6]}  # frames settled before stay
    again = pipelines.smooth(s, g, layout.boxes(s), steps, settled=table(half))
    assert {(r["frame"], r["x"], r["y"]): r["r"] for r in again.where(again.frame.isin(list(half))).collect()} == {(f, *k): c[0] for f, m in half.items() for k, c in m.items()}
    assert again.count() == 72 * len(played)


@pytest.mark.parametrize("most", [10, None])
def test_medoids_are_those_of_best_shifts(spark, most):
    """Sums of the best shifts' misses over all frames, or over those taken, with clear frames, frames that share no place and one alone."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 3, (6, 5)) * 90
    data = []
    for f in range(13):
        mx, my, noise = rng.integers(0, 4), rng.integers(0, 4), rng.random((6, 5)) < 0.1 + 0.05 * (f % 4)
        on = {(x + mx, y + my): int(base[y, x] + 60 * noise[y, x]) for y in range(6) for x in range(5)} if f != 4 else {}
        data += [(f, x, y, c := on.get((x, y), 0), c // 2, 7, 255 if (x, y) in on else 0) for y in range(9) for x in range(8)]
    data += [(20, 90, 90, 5, 5, 5, 255), (21, 0, 0, 5, 5, 5, 255)]
    px = px_of(spark, data)
    seqs = {0: [7, 3, 5, 12, 0, 9, 1, 4, 11, 2, 20, 6, 10, 8], 1: [21], 2: [20, 21], 3: [4, 4 + 9]}
    order = spark.createDataFrame([(a, i, f) for a, q in seqs.items() for i, f in enumerate(q)], "anim int, step int, frame bigint")
    for crops in (layout.boxes(px), None):
        boxed = {r["frame"] for r in crops.collect()} if crops is not None else None
        want = {}
        for a, q in seqs.items():
            pick = q if most is None or len(q) <= most else [q[i * len(q) // most] for i in range(most)]
            todo = spark.createDataFrame([(f, g) for f in pick for g in pick if f != g], "f bigint, g bigint")
            todo = alignment.starts(todo, crops) if crops is not None else todo.withColumns({"sx": F.lit(0), "sy": F.lit(0)})
            cost = {}
            for r in alignment.best_shift(px, px, todo, 3).collect():
                cost.setdefault(r["f"], []).append(r["miss"])
            if cost:
                want[a] = min((round(sum(m), 12), pick.index(f), f) for f, m in cost.items() if boxed is None or f in boxed)
        got = {r["anim"]: (r["frame"], r["total"]) for r in alignment.medoids(px, order, crops, most).collect()}
        assert got == {a: (f, total) for a, (total, _, f) in want.items()}


def test_smooth_query_takes_its_key_from_all_frames(spark, tmp_path):
    """Twelve frames, of which ten evenly spread ones leave out the sixth, the one most like the others: it is the key, so it stays as drawn."""
    from tessella.plans import fixtures as X, registry

    rng = np.random.default_rng(4)
    base = rng.integers(0, 3, (256, 2))
    events, red = [], {v * 37 % 256: v for v in range(256)}
    for f in range(12):
        at = rng.random(256) < (0.2 if f != 5 else 0)
        for i in range(256):
            r, g = base[i] if not at[i] else rng.integers(0, 3, 2)
            events.append((f * 256 + i, red[int(r) * 96], float(g * 96), "view"))
    keys = [40, 41, 42, 43, 44, 85, 86, 87, 88, 89, 130, 131]  # frames 0 to 11 in order; the second half of the steps is not played
    spark.createDataFrame(events, "event_id bigint, user_id bigint, value double, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(k, 50) for k in [*keys, *range(200, 212)]], "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    drawn = {f: rows(X.alt(X.flat(X.px(spark, str(tmp_path)))).where(F.col("frame") == f), "x", "y", "r", "g", "b", "a") for f in range(12)}
    out = registry.queries()["x10_smooth"](spark, str(tmp_path)).collect()
    got = {f: sorted(tuple(r)[1:] for r in out if r["frame"] == f) for f in range(12)}
    assert [f for f in got if got[f] == drawn[f]] == [5]


def test_smooth_brings_few_steps_to_the_driver(spark, monkeypatch):
    """Rows that reach the driver follow the frames, not the steps or the animations."""
    px = px_of(spark, [(f, x, y, 90 * f, 40, 200, 255) for f in range(3) for x in range(4) for y in range(4)])
    steps = spark.range(4000).selectExpr("cast(id % 40 as int) anim", "cast(id div 40 as int) step", "cast((id div 40 + id % 2) % 4 as int) frame", "0 x", "0 y", "0 z", "99 last")
    seen, plain = [], type(px).collect
    monkeypatch.setattr(type(px), "collect", lambda self: (out := plain(self), seen.append(len(out)))[0])
    out = pipelines.smooth(px, px, layout.boxes(px), steps)
    assert seen and max(seen) <= 9
    assert out.count() == 48


def test_turns_walk_like_all_steps(spark):
    """The thinned steps give the walk that all steps give, whatever was settled before and whichever animations are keyed."""
    import random

    rng = random.Random(5)
    for _ in range(6):
        plays = {a: [rng.randrange(-1, 14) for _ in range(rng.choice([1, 3, 8, 15]))] for a in range(rng.choice([2, 9]))}
        drawn, fixed = set(rng.sample(range(14), 11)), set(rng.sample(range(14), rng.choice([0, 3])))
        steps = spark.createDataFrame([(a, i, f, 0, 0, 0, len(q) - 2) for a, q in plays.items() for i, f in enumerate(q)], "anim int, step int, frame int, x int, y int, z int, last int")
        table = lambda fs: px_of(spark, [(f, 0, 0, 1, 2, 3, 255) for f in fs])
        full = {a: list(dict.fromkeys(f for f in q[:-1] if f in drawn)) for a, q in plays.items()}
        thin, met = {}, set()
        for r in pipelines.turns(table(drawn), steps, table(fixed) if fixed else None).orderBy("anim", "step").collect():
            thin.setdefault(r["anim"], []).append(r["frame"])
            met |= {r["frame"]} if r["fixed"] else set()
        keys, known = {}, set(fixed)
        for a, q in full.items():
            if q and not known & set(q):
                keys[a] = rng.choice(q)
                assert thin[a] == q
            known |= set(q)
        assert pipelines.walk(thin, met, keys) == pipelines.walk(full, fixed, keys)


def test_sheet_plan_against_counting():
    """Rows and greedy cuts as counted frame by frame."""
    import random

    rng = random.Random(2)
    for _ in range(60):
        frames = [(rng.randrange(4), f, rng.randrange(5, 90), rng.randrange(5, 90)) for f in range(rng.randrange(1, 25))]
        out = layout.plan(frames, 3, 400, 4)
        size = {f: (w, h) for _, f, w, h in frames}
        assert sorted(f for fs, _ in out for f in fs) == [f for _, f, _, _ in frames]
        for fs, rows_ in out:
            assert fs == sorted(fs)
            good = []
            for r in (1, 2, 3):
                per = -(-len(fs) // r)
                lines = [fs[i : i + per] for i in range(0, len(fs), per)]
                wide = max(sum(size[f][0] for f in x) + 4 * (len(x) - 1) for x in lines)
                high = sum(max(size[f][1] for f in x) for x in lines) + 4 * (len(lines) - 1)
                good += [r] if max(wide, high) * 3 <= 400 and r <= len(fs) else []
            assert rows_ == (good[0] if good else None)


def test_holes_fill_in_rounds(spark):
    """Against a walk over places, with ties, masks and more rounds than one."""
    import random

    rng = random.Random(5)
    for _ in range(3):
        now = {(x, y): (*rng.choice([RED, BLUE, (1, 2, 3)]), 255) if rng.random() < 0.4 else (0, 0, 0, 0) for x in range(9) for y in range(7) if rng.random() < 0.95}
        solid, masked = {k for k in now if rng.random() < 0.8}, {k for k in now if rng.random() < 0.1}
        want = dict(now)
        effect = {k for k, c in now.items() if c[3] and k not in masked}
        holes = {k for k, c in now.items() if not c[3] and k in solid}
        while True:
            fill = {}
            for x, y in holes:
                near = [want[q] for i in (-1, 0, 1) for k in (-1, 0, 1) if (q := (x + i, y + k)) in effect and q != (x, y)]
                if len(near) >= 3:
                    fill[x, y] = max(near, key=lambda c: (near.count(c), -near.index(c)))
            if not fill:
                break
            want |= fill
            effect |= fill.keys()
            holes -= fill.keys()
        rows_ = [(0, x, y, *c) for (x, y), c in now.items()]
        p = px_of(spark, rows_)
        stock = px_of(spark, [(0, x, y, 0, 0, 0, 255 if (x, y) in solid else 0) for x, y in now])
        out = nh.fill_holes(p, stock, px_of(spark, [(0, x, y, 0, 0, 0, 0) for x, y in masked]).select("frame", "x", "y"))
        assert {(r["x"], r["y"]): tuple(r[c] for c in "rgba") for r in out.collect()} == want


def test_empty_tables(spark):
    e = px_of(spark, [])
    pal = palettes.table(spark, [RED])
    assert palette_ops.nearest(e, pal).count() == 0 and nh.despeckle(e).count() == 0 and layout.fit(e, 8, 8).count() == 0
    assert components.components(e).count() == 0 and votes.edge_positions(e).count() == 0


def test_more_samples(spark):
    p = px_of(spark, [(f, x, y, *RED, 255) for f, w in ((0, 4), (1, 12), (2, 12)) for x in range(w) for y in range(3)])
    blue = p.where("frame < 2").withColumns({"r": p.r * 0, "b": p.b * 0 + 9})
    done = p.where("frame = 2").withColumn("g", p.g * 0 + 77)
    out = samples.baked(p, done, blue)
    assert {(r["frame"], r["r"], r["g"], r["b"]) for r in out.collect()} == {(0, *RED), (1, 0, RED[1], 9), (2, RED[0], 77, RED[2])} and out.count() == p.count()
    other = px_of(spark, [(0, x, y, *BLUE, 255) for x in range(9) for y in range(3)] + [(2, x, y, *BLUE, 255) for x in range(12) for y in range(3)])
    assert {(r["frame"], r["g"]) for r in samples.replaced(other, done).collect()} == {(0, BLUE[1]), (2, 77)}
    big, mask = samples.enlarged(p.where("frame = 0"), p.where("frame = 0 and x = 1"), 3)
    assert big.count() == 108 and rows(mask.where("r = 255"), "x") == [(x,) for x in (3, 4, 5) for _ in range(9)]
    sw = samples.swatches(spark.createDataFrame([(0, 0, 1, 2, 3), (0, 1, 4, 5, 6)], "frame bigint, ord int, r int, g int, b int"), 2)
    assert rows(sw, "x", "y", "r") == [(x, y, 1 if x < 2 else 4) for x in range(4) for y in range(2)]
    a = px_of(spark, picture("rrrr rrrr r..r", K))
    b = px_of(spark, picture("rrrr rbbr ....", K))
    shift = spark.createDataFrame([(0, 0, 0, 0)], "f bigint, g bigint, dx int, dy int")
    assert rows(samples.difference_mask(a, b, shift), "x", "y") == [(0, 2), (1, 1), (2, 1), (3, 2)]
    assert rows(samples.difference_mask(a, b, shift, least=5), "x", "y") == []
    lone = samples.alone(a.where("x = 0 and y = 0"), px_of(spark, picture("rr..r ..... r....", K)).where("a > 0"), 1)
    assert rows(lone, "x", "y") == [(0, 2), (4, 0)]
    dark = px_of(spark, [(0, x, y, 30, 20, 30, 255) for x in range(5) for y in range(5)] + [(0, x, 9, 30, 20, 30, 255) for x in range(9)])
    assert rows(samples.garment(dark, "dark", (0.0, 0.6), 4), "x", "y") == [(x, y) for x in range(5) for y in range(5)]
    inked = samples.painted(dark, dark.where("y < 5").select("frame", "x", "y"), [(1, 1, 1), (2, 2, 2)], (9, 9, 9))
    assert {(r["r"], r["y"] == 9) for r in inked.collect()} == {(9, False), (0, False), (30, True)}  # ramps are 16-bit colours
    glow = px_of(spark, [(0, 0, 0, 200, 20, 200, 255), (0, 1, 0, *GREY, 255)])
    donor = px_of(spark, [(0, 0, 0, *BLUE, 255), (0, 1, 0, *BLUE, 255)])
    got = samples.graft_beside(glow, donor, glow.select("frame", "x", "y"), shift, "aura", stamp=True)
    assert rows(got, "x", "r", "grafted") == [(0, 200, False), (1, BLUE[0], True)]


def test_samples(spark):
    p = px_of(spark, picture("rr...b rr...b ...... ..rr.. ..rr.. ......", K))
    red, blue = p.where("r = 200 and a > 0"), p.where("b = 200 and a > 0")
    corner = red.where("x < 2 and y < 2")
    assert samples.figure(corner, red, 2).count() == 8 and samples.figure(corner, red, 1).count() == 4 and samples.figure(corner, blue, 1).count() == 4
    assert samples.figure(corner, red.unionByName(blue), 3).count() == 10
    assert samples.without_scraps(p, [BLUE]).where("a > 0").count() == 8
    r = samples.chest_rows(red, 2, 1).first()
    assert (r["y0"], r["y1"], r["x0"], r["x1"]) == (0, 1, 0, 1)
    a, b = (rows(samples.droplets(red, s), "x", "y") for s in (1, 1))
    assert a == b
