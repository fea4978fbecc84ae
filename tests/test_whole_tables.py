"""Queries over all frames of the larger table, against brute force where SQL alone would be the witness."""

from collections import defaultdict

import pytest

from tessella.plans import fixtures as X
from tessella.plans import registry

SF = "/root/testdata/sf0.01"
QUERIES = registry.queries()
#: Queries with a row and more for nearly every frame, by their column of frames.
EVERY = dict.fromkeys(
    "a16_leftover a17_seam_error a18_quantile_cuts a19_recolour a19_recolour_counts a30_component_centres c02_stabilize c03_drop_small c04_border_majority c04_touching c05_seeded_growth c06_near_components "
    "f04_rasterised_masks g13_split_cells g16_cylinder_shade g16_runs j04_remix j12_transplant j13_graft j14_stamp_figure n07_close n07_dilate n08_contour n08_rim n09_depth_map p16_foam_rim x10_smooth".split(), "frame",
) | {"j07_colour_map_residuals": "f1", "j10_best_shift": "f"}


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def px(spark):
    return rows(X.px(spark, SF))


@pytest.mark.parametrize("name", sorted(EVERY))
def test_all_frames(spark, px, name):
    frames = {p["frame"] for p in px}
    got = {r[0] for r in QUERIES[name](spark, SF).select(EVERY[name]).distinct().collect()}
    assert max(frames) > 30 and got <= frames and len(got) >= len(frames) - 1 and max(got) >= max(frames) - 1


def walked(points, near):
    """Brute force: (frame, x, y) to the smallest y * 65536 + x of what is reached from it."""
    todo, out = set(points), {}
    while todo:
        group = [todo.pop()]
        for f, x, y in group:
            hit = {(f, x + dx, y + dy) for dx, dy in near} & todo
            todo -= hit
            group += hit
        least = min(y * 65536 + x for _, x, y in group)
        out |= dict.fromkeys(group, least)
    return out


FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]


@pytest.mark.parametrize("name,near", [("c01_components_8", [*FOUR, (1, 1), (1, -1), (-1, 1), (-1, -1)]), ("c01_components_4", FOUR)])
def test_components_of_all_frames(spark, px, name, near):
    want = walked([(p["frame"], p["x"], p["y"]) for p in px if p["r"] < 110], near)
    assert {(r["frame"], r["x"], r["y"]): r["comp"] for r in rows(QUERIES[name](spark, SF))} == want


def test_masks_of_all_frames(spark, px):
    """The same region on every frame, where the frame is opaque."""
    got = defaultdict(set)
    for r in rows(QUERIES["f04_rasterised_masks"](spark, SF)):
        got[r["frame"]].add((r["x"], r["y"]))
    shape = set().union(*got.values())
    opaque = defaultdict(set)
    for p in px:
        if p["a"] >= 128:
            opaque[p["frame"]].add((p["x"], p["y"]))
    assert all(got[f] == shape & opaque[f] for f in opaque)


def test_upscaled_and_sheets_of_all_frames(spark, px):
    want = sorted((p["frame"], p["x"] * 3 + i, p["y"] * 3 + j, p["r"], p["g"], p["b"], p["a"]) for p in px for i in range(3) for j in range(3))
    assert sorted(tuple(r.values()) for r in rows(QUERIES["g01_upscale"](spark, SF).select("frame", "x", "y", "r", "g", "b", "a"))) == want
    assert QUERIES["g02_sheet_pixels"](spark, SF).count() == 200 * 220 * len({p["frame"] // 6 for p in px})


@pytest.mark.parametrize("name", ["x08_pixelize", "g15_chest_rows", "g17_foam_droplets", "c06_figures", "x01_downscale"])
def test_composites_take_all_frames(spark, px, name):
    assert max(r["frame"] for r in QUERIES[name](spark, SF).select("frame").distinct().collect()) > 30
