"""Settings from the environment and from ``.env`` files: lines ``NAME=value``, quotes optional, ``#`` for comments. The environment comes first, then files in
the order given; the first value of a name wins. Values are never printed."""

from __future__ import annotations

import os
from collections import ChainMap
from collections.abc import Iterable

#: Names that the engine reads.
FILE, BASE, KEY, IMAGE_MODEL, CHAT_MODEL = "TESSELLA_ENV_FILE", "TESSELLA_API_BASE", "TESSELLA_API_KEY", "TESSELLA_IMAGE_MODEL", "TESSELLA_CHAT_IMAGE_MODEL"


def parsed(text: str) -> dict[str, str]:
    """The settings of one file's text."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        name, eq, value = (part.strip() for part in line.strip().partition("="))
        if eq and name and not name.startswith("#"):
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            out.setdefault(name, value[1:-1] if quoted else value)
    return out


class Settings(ChainMap):
    """All settings; ``repr`` gives names alone."""

    def __init__(self, folders: Iterable[str] = (".",)) -> None:
        paths = [os.environ.get(FILE), *(os.path.join(f, ".env") for f in folders)]
        layers: list[dict[str, str]] = [dict(os.environ)]
        for p in paths:
            if p and os.path.isfile(p):
                with open(p, encoding="utf-8") as f:
                    layers.append(parsed(f.read()))
        super().__init__(*layers)

    def needed(self, name: str) -> str:
        if not self.get(name):
            raise KeyError(f"{name} is not set")
        return self[name]

    def __repr__(self) -> str:
        return f"Settings({len(self)} names)"
