import json

import numpy as np
from conftest import px_of
from pyspark.sql import functions as F
from test_codecs import script_bytes, sheet_bytes

from tessella.functions import palettes
from tessella.operators import animations
from tessella.sources import containers, images, models, readers, sinks
from tessella.streaming import incremental


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def pic(w, h, colour=(255, 0, 0)):
    im = np.zeros((h, w, 4), np.uint8)
    im[1:-1, 1:-1] = (*colour, 255)
    return images.encode_png(im)


def test_project_folder(spark, tmp_path):
    for name, (w, h) in {"idle/a.png": (8, 10), "idle/b.PNG": (8, 11), "run/1.png": (12, 9), "run/2.png": (10, 9), "run/3.png": (11, 9)}.items():
        write(tmp_path / name, pic(w, h))
    p = readers.project(spark, str(tmp_path))
    got = [tuple(r) for r in p.orderBy("frame").select("anim", "step", "frame", "rel_path").collect()]
    assert got == [(0, 0, 0, "idle/a.png"), (0, 1, 1, "idle/b.PNG"), (1, 0, 2, "run/1.png"), (1, 1, 3, "run/2.png"), (1, 2, 4, "run/3.png")]
    px = readers.pixels(p)
    sizes = px.groupBy("frame").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    assert tuple(readers.anchored(sizes.where("frame = 2")).first()) == (2, 6, 6, 9)
    assert px.where("frame = 0 and a = 255").count() == 6 * 8
    out = sinks.write_pngs(px, str(tmp_path / "out")).collect()
    assert len(out) == 5 and (images.decode_png((tmp_path / "out/frame_003.png").read_bytes()) == images.decode_png(pic(10, 9))).all()


def test_sheets_decode_and_encode(spark, tmp_path):
    write(tmp_path / "hero.spr", sheet_bytes())
    write(tmp_path / "bad.spr", b"\x89PNG not a sheet")
    b = readers.files(spark, str(tmp_path), "*.spr")
    s = readers.sheets(b)
    assert s.where("error is not null").count() == 1
    good = s.where("error is null")
    names = good.select(readers.sealed_name("header").alias("n")).distinct().collect()
    assert [r["n"] for r in names] == ["hero.spr"]
    px = readers.sheet_pixels(good, key=2047)
    enc = sinks.encoded_frames(px, good, 2047)
    out = sinks.sheet_bytes(enc).first()["content"]
    assert containers.Sheet.parse(bytes(out)).frames[0].words.tolist() == containers.Sheet.parse(sheet_bytes()).frames[0].words.tolist()
    assert bytes(sinks.sheet_bytes(good).first()["content"]) == sheet_bytes()
    assert readers.sheet_pixels(good, key=2047, clear=True).where("frame = 3 and a = 0 and r = 0").count() == 25
    t = sinks.round_trips(b, "sheet").groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in t} == {"ok": 1, "skipped": 1}


def test_scripts(spark, tmp_path):
    write(tmp_path / "hero.ani", script_bytes())
    b = readers.files(spark, str(tmp_path), "*.ani")
    s = readers.scripts(b)
    assert animations.played(s).count() == 5
    assert bytes(sinks.script_bytes(s, containers.header("hero.ani")).first()["content"]) == script_bytes()


def test_archives(spark, tmp_path):
    write(tmp_path / "a.ark", containers.archive([containers.Member("x/hero.spr", sheet_bytes()), containers.Member("note.txt", b"hi")]))
    a = readers.archives(readers.files(spark, str(tmp_path), "*.ark"))
    assert sorted((r["base"], r["size"]) for r in a.collect()) == [("hero.spr", len(sheet_bytes())), ("note.txt", 2)]
    assert readers.archives(readers.files(spark, str(tmp_path), "*.ark"), r"\.spr$").count() == 1


def test_bundle_and_sheets(spark, tmp_path):
    p = px_of(spark, [(f, x, y, 10 * f, x, y, 255) for f, h in ((0, 16), (1, 14)) for x in range(16) for y in range(h)])
    info = sinks.bundle(p, str(tmp_path), fps=4)
    assert info == {"frames": 2, "frame": [16, 16], "sheet": [32, 16], "fps": 4} == json.loads((tmp_path / "sheet.json").read_text())
    im = images.decode_png((tmp_path / "sheet.png").read_bytes())
    assert im.shape == (16, 32, 4) and im[0, 20, 3] == 0 and im[2, 20, 3] == 255
    assert sinks.contact_sheet(p, 2, 4).count() == (16 * 2 + 4) * 16 * 4
    assert sinks.review_sheet(p, p, 1, 0).count() == 32 * 32


def test_layers(spark):
    d = spark.createDataFrame([(0, 0, 0, 0, 10, 10, 10, 255), (0, 1, 0, 0, 200, 0, 0, 128), (0, 0, 9, 0, 1, 1, 1, 50)], "frame bigint, layer int, x int, y int, r int, g int, b int, a int")
    out = {r["x"]: r for r in sinks.editor_layers(d, (4, 4)).collect()}
    assert out[0]["a"] == 255 and 100 < out[0]["r"] < 110 and out[9]["outside"] and out[9]["partial"]


def test_models(spark):
    assert models.items("a=x | plain") == [("a", "x"), ("item2", "plain")]
    png = pic(4, 4)
    import base64

    text = base64.b64encode(png).decode()
    assert models.find_image({"a": [1, {"b": "data:image/png;base64," + text}]}) == png and models.find_image({"a": "no"}) is None
    assert len(models.stripped("x" + "A" * 500)) < 10
    f = spark.createDataFrame([(1, bytearray(png)), (2, bytearray(png))], "frame bigint, content binary")
    pics, state = models.run(spark, "r", f, "draw", models.Recolouring())
    assert pics.count() == 2 and [r["status"] for r in state.collect()] == ["ok", "ok"]
    none, state = models.run(spark, "r", f, "draw", models.Recolouring(), state=state)
    assert none.count() == 0 and state.count() == 2
    _, s2 = models.run(spark, "q", f, "refuse", models.Recolouring())
    assert {r["status"] for r in s2.collect()} == {"refused"} and models.requeued(s2, "q").count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in/frame_001.png", pic(6, 6))
    args = (spark, str(tmp_path / "in"), palettes.table(spark, [(250, 5, 5)]), str(tmp_path / "out"), str(tmp_path / "cp"))
    incremental.conformed(*args).awaitTermination()
    write(tmp_path / "in/frame_002.png", pic(5, 5))
    incremental.conformed(*args).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["frame"], r["count"]) for r in out.groupBy("frame").count().collect()) == [(1, 16), (2, 9)]
    assert out.select("r").distinct().collect()[0]["r"] == 250


def test_review_sheets(spark):
    """A sheet per animation: stock over result, numbers above, frames without a result left out."""
    stock = px_of(spark, [(f, x, y, 10 * f, 0, 0, 255) for f in (1, 2, 12) for x in range(3) for y in range(2)])
    result = px_of(spark, [(f, x, y, 0, 10 * f, 0, 255) for f in (2, 12) for x in range(3) for y in range(2)])
    steps = spark.createDataFrame([(0, 0, 12, 2), (0, 1, 1, 2), (0, 2, 2, 2), (1, 0, 2, 0)], "anim int, step int, frame int, last int")
    steps = steps.select("anim", "step", "frame", *[F.lit(0).alias(c) for c in "xyz"], "last")
    out = {(r["frame"], r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in sinks.review_sheets(stock, result, steps, zoom=2, per_row=8).collect()}
    cw, ch = 3 * 2 + 8, 6 * 2 + 22
    assert {k[0] for k in out} == {0, 1} and sum(k[0] == 0 for k in out) == 2 * cw * ch and sum(k[0] == 1 for k in out) == cw * ch
    assert out[0, 4, 20] == (120, 0, 0) and out[0, 4, 20 + 8] == (0, 120, 0) and out[0, 4, 20 + 5] == (60, 60, 60)
    assert out[0, cw + 4, 20] == (20, 0, 0) and out[1, 4, 20] == (20, 0, 0)
    white = sum(v == (255, 255, 255) for k, v in out.items() if k[0] == 1)
    assert white == 4 * bin(sinks._GLYPHS[2]).count("1")
