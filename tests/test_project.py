"""Whole jobs on folders, through the command line's entry point."""

import json

import numpy as np
import pytest
from test_codecs import script_bytes, sheet_bytes

from tessella.__main__ import main
from tessella.sources import containers, images


@pytest.fixture
def folder(tmp_path, spark):
    rng = np.random.default_rng(4)
    colours = np.array([[200, 30, 30], [24, 100, 33], [10, 10, 200]], np.uint8)
    for i, (w, h) in enumerate(((9, 12), (7, 10), (8, 8))):
        im = np.full((h, w, 4), 255, np.uint8)
        im[..., :3] = colours[rng.integers(0, 3, (h, w))]
        im[0, 0] = 0
        (tmp_path / "art").mkdir(exist_ok=True)
        (tmp_path / f"art/f{i}.png").write_bytes(images.encode_png(im))
    return tmp_path


def read(path):
    return images.decode_png(path.read_bytes())


def test_sheet_unsheet_downscale(folder):
    t = folder
    main(["sheet", f"{t}/art", f"{t}/s.png", "--scale", "3", "--rows", "2", "--bg", "ff00ff"])
    main(["unsheet", f"{t}/s.png", f"{t}/big"])
    assert read(t / "big/f0.png").shape == (36, 27, 4)
    r = main(["downscale", f"{t}/s.png", f"{t}/out", "--ref", f"{t}/art", "--report", f"{t}/r.json", "--confidence", f"{t}/conf"])
    assert [x["file"] for x in r] == ["f0.png", "f1.png", "f2.png"] == [x["file"] for x in json.loads((t / "r.json").read_text())]
    assert all(x["agreement"] == 100.0 and x["weak"] == 0 for x in r)
    a, b = read(t / "art/f1.png"), read(t / "out/f1.png")
    assert a.shape == b.shape and (a[..., 3] == b[..., 3]).all() and abs(a[..., :3].astype(int) - b[..., :3]).max() < 8
    with pytest.raises(ValueError):
        main(["sheet", f"{t}/art", f"{t}/s.png", "--rows", "9"])
    with pytest.raises(ValueError):
        main(["unsheet", f"{t}/art/f0.png", f"{t}/x", "--manifest", f"{t}/s.json"])


def test_import_export(folder):
    t = folder
    (t / "hero.spr").write_bytes(sheet_bytes())
    m = main(["import", f"{t}/hero.spr", f"{t}/frames"])
    assert [f["placeholder"] for f in m["frames"]] == [False, False, True, False]
    main(["export", f"{t}/frames", f"{t}/hero2.spr", "--keep-header"])
    assert (t / "hero2.spr").read_bytes() == sheet_bytes()
    main(["export", f"{t}/frames", f"{t}/new.spr"])
    assert main(["info", f"{t}/new.spr"])["name"] == "new.spr"
    (t / "hero.ani").write_bytes(script_bytes())
    v = main(["verify-roundtrip", str(t)])
    assert v["sheet"]["ok"] == 3 and v["sheet"]["misnamed"] == 1 and v["script"]["ok"] == 1
    (t / "a.json").write_text(json.dumps(main(["ani", f"{t}/hero.ani", "--json"])))
    main(["ani-build", f"{t}/a.json", f"{t}/hero.ani", "--keep-header"])
    assert (t / "hero.ani").read_bytes() == script_bytes() and main(["ani", f"{t}/hero.ani"])[0]["steps"] == 2
    assert main(["pack", f"{t}/frames", f"{t}/a.ark"]) == 4 and len(containers.members((t / "a.ark").read_bytes())) == 4


def test_masks_remix_recolour(folder):
    t = folder
    (t / "spec.json").write_text(json.dumps({"f0": {"add": [[[0, 0], [5, 0], [5, 5], [0, 5]]], "ramp": ["000000", "ffffff"]}}))
    main(["mask", f"{t}/art", f"{t}/mask", "--spec", f"{t}/spec.json", "--overlay", f"{t}/over"])
    assert int((read(t / "mask/f0.png")[..., 0] == 255).sum()) == 24 and (read(t / "mask/f1.png")[..., 0] == 0).all()
    main(["conform", f"{t}/art", f"{t}/cga", "--palette", "cga", "--colorkey", "none"])
    r = main(["remix", f"{t}/cga", f"{t}/mix", "--orig", f"{t}/art", "--mask", f"{t}/mask"])
    assert r[0]["mask_px"] == 24 and r[0]["seam_pairs"] > 0
    assert (read(t / "mix/f1.png") == read(t / "art/f1.png")).all()
    main(["recolor", f"{t}/art", f"{t}/rec", "--spec", f"{t}/spec.json"])
    a, b = read(t / "art/f0.png"), read(t / "rec/f0.png")
    assert (a[..., 3] == b[..., 3]).all() and (a[6:] == b[6:]).all() and set(map(tuple, b[1:5, :5, :3].reshape(-1, 3).tolist())) <= {(0, 0, 0), (255, 255, 255)}


def test_compose_lift_bundle(folder):
    t = folder
    (t / "ops.json").write_text(json.dumps({"ops": [{"op": "fill", "rect": [0, 0, 2, 2], "rgb": "#102030"}, {"op": "stamp", "from": f"{t}/art", "frame": 0, "rect": [3, 3, 2, 2], "repeat": {"count": 2, "x0": 0, "x1": 4, "y": 5}}]}))
    main(["compose", f"{t}/art", f"{t}/comp", "--spec", f"{t}/ops.json"])
    c, a = read(t / "comp/f1.png"), read(t / "art/f0.png")
    assert (c[:2, :2] == [16, 32, 48, 255]).all() and (c[5:7, 4:6] == a[3:5, 3:5]).all()
    assert main(["bundle", f"{t}/art", f"{t}/b", "--fps", "4"])["frames"] == 3
    main(["pixelize", f"{t}/art", f"{t}/tiny", "--size", "6x6", "--colors", "2"])
    assert read(t / "tiny/f2.png").shape == (6, 6, 4)
    assert len(main(["palette", f"{t}/art"]).split(",")) == 3
    over = t / "ov"
    over.mkdir()
    for i in range(3):
        im = read(t / f"art/f{i}.png")
        im[..., :3] = (im[..., :3].astype(int) + 100) // 2
        (over / f"f{i}.png").write_bytes(images.encode_png(im))
    main(["lift", f"{t}/layer.png", "--over", str(over), "--under", f"{t}/art", "--control", f"{t}/art", "--passes", "0"])
    layer = read(t / "layer.png")
    assert 120 < layer[4, 4, 3] < 135 or layer[4, 4, 3] == 0


def test_prepare_smooth_split(folder):
    t = folder
    table = main(["prepare", f"{t}/art", f"{t}/proj"])
    assert table["per"] == 3 and table["anims"][0]["steps"][0]["x"] == 4
    assert main(["smooth", f"{t}/proj", f"{t}/proj/stock", f"{t}/sm"]) == 3
    im = np.zeros((8, 8, 4), np.uint8)
    im[:2, :2], im[5:, 5:] = 255, 255
    (t / "set.png").write_bytes(images.encode_png(im))
    assert main(["split", f"{t}/set.png", f"{t}/cells", "--rows", "2", "--cols", "2"]) == 2
    assert read(t / "cells/cell_03.png").shape == (3, 3, 4)
