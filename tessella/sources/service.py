"""Image models behind an HTTP service with the common chat and images routes, as an :class:`~tessella.sources.models.ImageModel`.

Two styles of request: ``chat`` sends a message with the pictures as data addresses and finds the picture in the answer; ``images`` posts a form (edits) or JSON
(new pictures). Answers without a picture raise: Refused where the service declined, Exhausted where the quota is out, else ValueError. With a ``record`` folder,
every answer is kept there as JSON, its pictures cut out. Pictures must be PNG: no other decoder is bundled."""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.error
import urllib.request
import uuid
from dataclasses import dataclass

import numpy as np

from .. import settings
from . import images
from .models import Exhausted, Refused, find_image, stripped

#: Parts of finish reasons and messages by which services decline, and by which they say that the quota is out.
DECLINED = ("safety", "prohibited", "content_filter", "content_policy", "moderation", "blocked")
OUT = ("resource_exhausted", "cooling down", "rate limit", "quota")


def form(fields: dict[str, str], files: list[tuple[str, str, bytes]]) -> tuple[bytes, str]:
    """(body, content type) of a multipart form of fields and PNG files (name, file name, content)."""
    mark = uuid.uuid4().hex
    parts = [f'Content-Disposition: form-data; name="{k}"\r\n\r\n'.encode() + v.encode() for k, v in fields.items()]
    parts += [f'Content-Disposition: form-data; name="{k}"; filename="{n}"\r\nContent-Type: image/png\r\n\r\n'.encode() + data for k, n, data in files]
    edge = f"--{mark}".encode()
    return b"".join(edge + b"\r\n" + p + b"\r\n" for p in parts) + edge + b"--\r\n", f"multipart/form-data; boundary={mark}"


@dataclass
class Service:
    base: str
    key: str
    model: str
    style: str = "images"
    size: str = "1024x1024"
    timeout: float = 600
    record: str | None = None

    @classmethod
    def configured(cls, style: str = "images", model: str | None = None, conf: settings.Settings | None = None, **more) -> Service:
        """From settings: address, key, and the model of the style."""
        conf = conf or settings.Settings()
        return cls(conf.needed(settings.BASE), conf.needed(settings.KEY), model or conf.needed(settings.CHAT_MODEL if style == "chat" else settings.IMAGE_MODEL), style, **more)

    def address(self, route: str) -> str:
        return self.base.rstrip("/").removesuffix("/v1") + "/v1/" + route

    def _post(self, route: str, body: bytes | dict, kind: str = "application/json") -> dict:
        data = json.dumps(body).encode() if isinstance(body, dict) else body
        ask = urllib.request.Request(self.address(route), data, {"Authorization": f"Bearer {self.key}", "Content-Type": kind}, method="POST")
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout) as r:
                raw = r.read()
        except urllib.error.HTTPError as e:
            text = e.read()[:500].decode("utf-8", "replace")
            if e.code == 429 or any(x in text.lower() for x in OUT):
                raise Exhausted(text) from e
            if any(x in text.lower() for x in DECLINED):
                raise Refused(text) from e
            raise OSError(f"HTTP {e.code}: {text}") from e
        answer = json.loads(raw)
        return answer if isinstance(answer, dict) else {"answer": answer}

    def _picture(self, answer: dict, began: float, **about) -> bytes:
        """The picture of an answer, which is kept on record."""
        first = next(iter(answer.get("data") or []), {})
        data = find_image(answer)
        if data is None and isinstance(first, dict) and first.get("url"):
            with urllib.request.urlopen(first["url"], timeout=120) as r:
                data = r.read()
        why = [c.get("finish_reason") for c in answer.get("choices", []) if isinstance(c, dict)]
        if self.record:
            os.makedirs(self.record, exist_ok=True)
            meta = json.loads(stripped(json.dumps(answer))) | about | {"model": self.model, "style": self.style, "seconds": round(time.time() - began, 1)}
            with open(os.path.join(self.record, f"{uuid.uuid4().hex}.{'meta' if data else 'error'}.json"), "w", encoding="utf-8") as f:
                json.dump(meta, f, indent=1)
        if data is None:
            text = f"no picture (finish reason {why}): {stripped(json.dumps(answer))[:400]}"
            low = text.lower()
            raise Exhausted(text) if any(x in low for x in OUT) else Refused(text) if any(x in low for x in DECLINED) else ValueError(text)
        return data

    def _chat(self, prompt: str, pictures: tuple[bytes, ...]) -> dict:
        link = lambda p: {"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(p).decode()}}
        content = [{"type": "text", "text": prompt}, *map(link, pictures)] if pictures else prompt
        return self._post("chat/completions", {"model": self.model, "messages": [{"role": "user", "content": content}], "modalities": ["image", "text"]})

    def edit(self, image: bytes, prompt: str, refs: tuple[bytes, ...] = (), mask: bytes | None = None) -> bytes:
        """The picture redrawn; references follow it. Chat answers come back without transparency."""
        began = time.time()
        if self.style == "chat":
            drawn = images.decode_png(self._picture(self._chat(prompt, (image, *refs)), began, refs=len(refs))).copy()
            drawn[..., 3] = 255
            return images.encode_png(drawn)
        name = "image[]" if refs else "image"
        files = [(name, f"picture{i}.png", p) for i, p in enumerate((image, *refs))] + ([("mask", "mask.png", mask)] if mask else [])
        return self._picture(self._post("images/edits", *form({"model": self.model, "prompt": prompt, "n": "1", "size": self.size}, files)), began, refs=len(refs))

    def generate(self, prompt: str) -> bytes:
        """A new picture, its transparency kept."""
        began = time.time()
        answer = self._chat(prompt, ()) if self.style == "chat" else self._post("images/generations", {"model": self.model, "prompt": prompt, "n": 1, "size": self.size})
        return images.encode_png(np.ascontiguousarray(images.decode_png(self._picture(answer, began, prompt=prompt))))

    def available(self) -> bool:
        """False where the service answers that the quota is out, or cannot be reached; any other answer means it is there."""
        body = {"model": self.model, "max_tokens": 5, "messages": [{"role": "user", "content": "Answer with one word: ok"}]}
        ask = urllib.request.Request(self.address("chat/completions"), json.dumps(body).encode(), {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(ask, timeout=min(self.timeout, 120)):
                return True
        except urllib.error.HTTPError as e:
            return e.code != 429
        except OSError:
            return False
