import numpy as np

from tessella import studio
from tessella.sources import images, models


class Painter(models.Recolouring):
    """Returns sheets as they are, with noise specks, or twice as large."""

    def __init__(self, zoom=1):
        self.zoom = zoom

    def edit(self, image, prompt, refs=()):
        im = images.decode_png(image).copy()
        return images.encode_png(im.repeat(self.zoom, 0).repeat(self.zoom, 1))

    def generate(self, prompt):
        im = np.zeros((40, 40, 4), np.uint8)
        im[...] = (255, 0, 255, 255)
        im[4:12, 4:12] = (200, 30, 30, 255)
        im[4:12, 26:34] = (30, 200, 30, 255)
        im[26:34, 4:12] = (30, 30, 200, 255)
        return images.encode_png(im)


def test_create_and_set(spark, tmp_path):
    assert studio.create(spark, Painter(), "hero", str(tmp_path), (16, 16)) == ["sprite.png"]
    im = images.decode_png((tmp_path / "sprite.png").read_bytes())
    assert im.shape == (16, 16, 4) and 0 < (im[..., 3] == 255).sum() < 256
    assert studio.create_set(spark, Painter(), "a=red|b=green|c=blue", str(tmp_path), (12, 12)) == ["a", "b", "c"]
    b = images.decode_png((tmp_path / "b.png").read_bytes())
    assert b.shape == (12, 12, 4) and b[6, 6].tolist() == [30, 200, 30, 255]


def test_animate_and_edit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(studio, "CANVAS", 160)
    im = np.zeros((10, 8, 4), np.uint8)
    im[2:9, 1:7] = (206, 32, 33, 255)
    (tmp_path / "s.png").write_bytes(images.encode_png(im))
    for zoom in (1, 2):
        info = studio.animate(spark, Painter(zoom), f"{tmp_path}/s.png", f"{tmp_path}/out{zoom}", "walk", frames=2, pad="1,0,1,0")
        assert info["frames"] == 2 and info["frame"] == [10, 10]
        strip = images.decode_png((tmp_path / f"out{zoom}/sheet.png").read_bytes())
        assert (strip[:, :10] == strip[:, 10:]).all() and strip[5, 5].tolist() == [206, 32, 33, 255]
    path = studio.edit(spark, Painter(), f"{tmp_path}/s.png", str(tmp_path / "e"), "same")
    assert (images.decode_png(open(path, "rb").read()) == im).all()


def test_tools(spark, tmp_path):
    import io
    import json

    from tessella import tools

    shop = tools.Workshop(spark, Painter)
    ask = lambda method, **params: tools.answer(shop, {"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    assert ask("initialize")["result"]["serverInfo"]["name"] == "tessella" and tools.answer(shop, {"method": "notifications/initialized"}) is None
    listed = {t["name"]: t["inputSchema"] for t in ask("tools/list")["result"]["tools"]}
    assert set(listed) == set(tools.NAMES) and listed["create"]["required"] == ["outdir", "prompt"] and listed["create"]["properties"]["variants"] == {"type": "integer"}
    made = ask("tools/call", name="create", arguments={"outdir": str(tmp_path), "prompt": "hero", "size": "16"})["result"]
    assert not made["isError"] and made["content"][1]["mimeType"] == "image/png" and (tmp_path / "sprite.png").exists()
    seen = ask("tools/call", name="look", arguments={"path": str(tmp_path / "sprite.png")})["result"]
    assert seen["content"][0]["text"].startswith("16 by 16") and images.decode_png(tools.preview(str(tmp_path / "sprite.png"), 100)).shape == (96, 96, 4)
    assert ask("tools/call", name="palettes")["result"]["content"][0]["text"].count("colours") > 1
    assert ask("tools/call", name="look", arguments={"path": "/nowhere.png"})["result"]["isError"] and ask("tools/call", name="x")["error"]["code"] == -32602 and ask("y")["error"]["code"] == -32601
    out = io.StringIO()
    tools.serve(shop, io.StringIO('{"id": 3, "method": "ping"}\n\n{bad\n'), out)
    assert [json.loads(x).get("id") for x in out.getvalue().splitlines()] == [3, None] and tools.size("8x9") == (8, 9)
