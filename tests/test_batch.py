"""Settings, the HTTP service against a local stand-in, and runs of a project's frames."""

import base64
import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from tessella import batch, project, settings
from tessella.operators import palette_ops
from tessella.sources import images, models, service

from conftest import px_of


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# x\nA='one'\nA=two\n B = \"q=1\" \nnothing\nHOME=/no\n")
    monkeypatch.setenv("HOME", "/yes")
    s = settings.Settings([str(tmp_path)])
    assert (s["A"], s["B"], s["HOME"]) == ("one", "q=1", "/yes") and "one" not in repr(s)
    with pytest.raises(KeyError):
        s.needed("TESSELLA_NOT_THERE")
    (tmp_path / "other").write_text("A=named\n")
    monkeypatch.setenv(settings.FILE, str(tmp_path / "other"))
    assert settings.Settings([str(tmp_path)])["A"] == "named"


_NOISE = np.random.default_rng(0).integers(0, 255, (12, 9, 4), np.uint8)
_NOISE[0, 0] = (10, 200, 30, 77)
PICTURE = images.encode_png(_NOISE)


class Stub(BaseHTTPRequestHandler):
    seen: list = []
    answers: list = []

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        Stub.seen.append((self.path, self.headers["Authorization"], self.headers["Content-Type"], body))
        code, answer = Stub.answers.pop(0)
        data = answer if isinstance(answer, bytes) else json.dumps(answer).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        self.send_response(200)
        self.end_headers()
        self.wfile.write(PICTURE)

    def log_message(self, *args):
        pass


@pytest.fixture
def address():
    server = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Stub.seen, Stub.answers = [], []
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_service(address, tmp_path):
    b64 = base64.b64encode(PICTURE).decode()
    link = "data:image/png;base64," + b64
    chat = service.Service(address + "/v1/", "key", "m", "chat", record=str(tmp_path))
    Stub.answers = [(200, {"choices": [{"message": {"images": [{"image_url": {"url": link}}]}}]})]
    out = images.decode_png(chat.edit(PICTURE, "draw", (PICTURE,)))
    path, auth, _, body = Stub.seen[-1]
    sent = json.loads(body)
    assert path == "/v1/chat/completions" and auth == "Bearer key" and sent["modalities"] == ["image", "text"]
    assert [c["type"] for c in sent["messages"][0]["content"]] == ["text", "image_url", "image_url"] and sent["messages"][0]["content"][1]["image_url"]["url"] == link
    assert out.shape == (12, 9, 4) and out[0, 0].tolist() == [10, 200, 30, 255]
    meta = [json.loads((tmp_path / n).read_text()) for n in os.listdir(tmp_path)]
    assert meta[0]["model"] == "m" and b64 not in json.dumps(meta)
    form = service.Service(address, "key", "m")
    Stub.answers = [(200, {"data": [{"b64_json": b64}]}), (200, {"data": [{"url": address + "/x.png"}]}), (200, {"data": [{"b64_json": b64}]})]
    assert form.edit(PICTURE, "draw") == PICTURE
    assert Stub.seen[-1][0] == "/v1/images/edits" and b'name="image"; filename' in Stub.seen[-1][3] and PICTURE in Stub.seen[-1][3]
    assert form.edit(PICTURE, "draw", (PICTURE,), mask=PICTURE) == PICTURE and Stub.seen[-1][3].count(b'name="image[]"') == 2 and b'name="mask"' in Stub.seen[-1][3]
    assert (images.decode_png(form.generate("new")) == images.decode_png(PICTURE)).all()
    Stub.answers = [(200, {"choices": [{"finish_reason": "prohibited_content"}]}), (429, {"error": "x"}), (500, {"error": "RESOURCE_EXHAUSTED"}), (500, {"error": "x"}), (200, {"choices": []})]
    for error in (models.Refused, models.Exhausted, models.Exhausted, OSError, ValueError):
        with pytest.raises(error):
            chat.edit(PICTURE, "draw")
    Stub.answers = [(200, {}), (429, {}), (500, {})]
    assert [form.available() for _ in range(3)] == [True, False, True]
    assert not service.Service("http://127.0.0.1:9", "k", "m", timeout=2).available()
    conf = {settings.BASE: "b", settings.KEY: "k", settings.CHAT_MODEL: "c"}
    assert service.Service.configured("chat", conf=type("S", (), {"needed": staticmethod(conf.__getitem__)})).model == "c"


def test_twins_differ_in_the_top_alone(spark):
    def frame(f, swap, odd):
        cells = [(x, y, (10 + x, 20, 30)) for x in range(12) for y in range(20)]
        return [(f, x, y, *((9, 9, 9) if (x, y) == odd else tuple(reversed(c)) if swap else c), 255) for x, y, c in cells]

    p = px_of(spark, frame(1, False, None) + frame(2, True, (3, 2)) + frame(3, True, (3, 15)) + frame(4, True, None))
    assert {r["frame"]: r["rep"] for r in palette_ops.twins(p).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    m, fixed = palette_ops.twin_map(p, 1, 2)
    assert [tuple(r) for r in fixed.collect()] == [(3, 2, 9, 9, 9, 255)] and m.count() == 12
    low = spark.createDataFrame([(f, 0, 12, 12, 20) for f in (1, 2, 3, 4)], "frame bigint, cx int, cy int, cw int, ch int")
    assert {r["frame"]: r["rep"] for r in palette_ops.twins(p, crops=low).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}


class Painter(models.Recolouring):
    """Gives sheets back with red and green swapped; refuses, fails or is out as told by call."""

    def __init__(self, script=()):
        self.script, self.calls = list(script), 0

    def edit(self, image, prompt, refs=()):
        self.calls += 1
        if self.script and (e := self.script.pop(0)):
            raise e
        return images.encode_png(images.decode_png(image)[..., [1, 0, 2, 3]])


def test_runs_resume(spark, tmp_path):
    os.makedirs(tmp_path / "art")
    for k, shade in enumerate([(206, 32, 33), (206, 32, 33), (32, 130, 33)]):
        im = np.zeros((10, 10 + 2 * (k == 2), 4), np.uint8)
        im[2:9, 2:8] = (*shade, 255)
        im[4:6, 3:5] = (33, 32, 206, 255)
        if k == 1:
            im[im[..., 0] == 206] = (107, 32, 33, 255)
        (tmp_path / f"art/f{k}.png").write_bytes(images.encode_png(im))
    folder = str(tmp_path / "proj")
    project.prepare(spark, str(tmp_path / "art"), folder)
    pal = "ce2021,20ce21,6b2021,206b21,208221,822021,2120ce,2021ce"
    r = batch.Run(spark, folder, "first", batch.Options(prompt="swap", canvas=120, scale=5, palette=pal, tries=2, most_leftover=101))
    stop = Painter([None, models.Exhausted("quota")])
    assert r.run("all", stop) == {"todo": 0, "ok": 1, "failed": 1} and r.left() == [2]
    state = r.state()
    assert state["groups"] == {"0": [0, 1], "2": [2]} and sorted(os.listdir(f"{folder}/runs/first/bake")) == ["frame_000.png", "frame_001.png"]
    first, twin = (images.decode_png(open(f"{folder}/runs/first/bake/frame_00{k}.png", "rb").read()) for k in (0, 1))
    assert first[2, 2].tolist()[:2] == [33, 206] or first[2, 2].tolist()[:2] == [32, 206]
    assert (first[..., 3] == twin[..., 3]).all()
    assert batch.autorun(r, "all", Painter(), iter([False, True]).__next__, sleep=lambda s: None) == 1
    assert r.status() == {"todo": 0, "ok": 2} and r.requeue([1]) == [0] and r.redo() == 1
    assert r.status() == {"todo": 1, "ok": 1} and r.run("all", Painter([models.Refused("no")])) == {"todo": 0, "ok": 1, "refused": 1}
    again = batch.Run(spark, folder, "second", r.options)
    assert again.run("all", Painter()) == {"todo": 0} and again.state()["already"] == [0, 1, 2]
