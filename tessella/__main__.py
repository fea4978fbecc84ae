"""Command line: ``python -m tessella COMMAND ...``."""

from __future__ import annotations

import argparse
import json
import os

from . import batch, project, tools
from .sources import service


def _size(text: str) -> tuple[int, int]:
    w, h = text.lower().split("x")
    return int(w), int(h)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella", description="Pixel-art frames and sprite animations on Spark.")
    sub = p.add_subparsers(dest="command", required=True)

    def cmd(name: str, *pos: str, **opts):
        c = sub.add_parser(name)
        for a in pos:
            c.add_argument(a)
        for k, v in opts.items():
            flag = "--" + k.replace("_", "-")
            if isinstance(v, bool):
                c.add_argument(flag, action="store_true")
            elif callable(v):
                c.add_argument(flag, type=v)
            else:
                c.add_argument(flag, default=v, type=type(v))

    pal = {"ref": str, "palette": str}
    cmd("info", "path")
    cmd("import", "path", "out", colorkey="cyan")
    cmd("export", "folder", "out", keep_header=False)
    cmd("pack", "folder", "out", store=False)
    cmd("ani", "path", json=False)
    cmd("ani-build", "path", "out", keep_header=False)
    cmd("palette", "path")
    cmd("conform", "folder", "out", **pal, canvas=_size, colorkey="cyan", key=str, alpha_threshold=128, report=str)
    cmd("sheet", "folder", "out", scale=3, gap=6, rows=1, bg="808080", canvas=_size)
    cmd("unsheet", "path", "out", manifest=str)
    cmd("downscale", "path", "out", manifest=str, **pal, bg=str, colorkey="cyan", weak=0.6, tol=0, metric="rgb", resolve=False, grain=False, register=False, despeckle=False, confidence=str, report=str)
    cmd("mask", "folder", "out", spec=str, overlay=str)
    cmd("remix", "edited", "out", orig=str, mask=str, alpha=False, report=str)
    cmd("recolor", "folder", "out", spec=str)
    cmd("compose", "folder", "out", spec=str)
    cmd("lift", "out", over=str, under=str, control=str, min_alpha=0.08, passes=2)
    cmd("snap", "folder", "out", **pal, colors=16, pixel_size=float, flatten="auto", force=False)
    cmd("pixelize", "path", "out", size=_size, colors=16, palette=str)
    cmd("split", "path", "out", rows=1, cols=1)
    cmd("bundle", "folder", "out", fps=8, zoom=1)
    cmd("prepare", "folder", "out")
    cmd("smooth", "project", "done", "out")
    cmd("verify-roundtrip", "folder")
    cmd("review", "project", "done", "out", zoom=4)
    cmd("edit-image", "style", "path", "out", prompt_file=str, ref=str, mask=str, model=str)
    cmd("batch", "job", "project", "name", spec="all", prompt_file=str, palette=str, style="images", frames=str)
    cmd("tools", style="images")
    return p


def _read(path: str | None) -> str:
    if not path:
        return ""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _edit_image(a: argparse.Namespace) -> str:
    """One picture through the service; references are separated by commas."""
    load = lambda p: open(p, "rb").read()  # noqa: E731, SIM115
    model = service.Service.configured(a.style, a.model, record=os.path.dirname(a.out) or ".")
    data = model.edit(load(a.path), _read(a.prompt_file), tuple(map(load, a.ref.split(","))) if a.ref else (), load(a.mask) if a.mask else None)
    with open(a.out, "wb") as f:
        f.write(data)
    return f"{a.out}: {len(data)} bytes"


def _batch(s, a: argparse.Namespace):
    """run, redo, requeue, status or autorun of a project's run."""
    r = batch.Run(s, a.project, a.name, batch.Options(prompt=_read(a.prompt_file), palette=a.palette))
    if a.job in ("run", "autorun"):
        model = service.Service.configured(a.style)
        return r.run(a.spec, model) if a.job == "run" else batch.autorun(r, a.spec, model, model.available)
    return {"redo": r.redo, "status": r.status, "requeue": lambda: r.requeue([int(f) for f in a.frames.split(",")])}[a.job]()


def main(argv: list[str] | None = None):
    a = parser().parse_args(argv)
    load = lambda path: json.load(open(path, encoding="utf-8"))  # noqa: E731, SIM115
    plain = {"info": lambda: project.info(a.path), "pack": lambda: project.pack(a.folder, a.out, a.store), "ani-build": lambda: project.build_script(load(a.path), a.out, a.keep_header)}
    if a.command == "edit-image":
        plain["edit-image"] = lambda: _edit_image(a)
    if a.command == "ani" and a.json:
        plain["ani"] = lambda: project.show_script(a.path)
    if a.command in plain:
        out = plain[a.command]()
    else:
        from .session import local

        s = local()
        out = {
            "import": lambda: project.import_sheet(s, a.path, a.out, a.colorkey),
            "export": lambda: project.export_sheet(s, a.folder, a.out, a.keep_header),
            "ani": lambda: project.summary(s, a.path),
            "palette": lambda: project.palettes.to_hex(project.pipelines.palette_of(project.Folder(s, a.path).px)),
            "conform": lambda: project.conform(s, a.folder, a.out, ref=a.ref, palette=a.palette, canvas=a.canvas, colorkey=a.colorkey, key=a.key, threshold=a.alpha_threshold, report_path=a.report),
            "sheet": lambda: project.sheet(s, a.folder, a.out, a.scale, a.gap, a.rows, a.bg, a.canvas),
            "unsheet": lambda: project.unsheet(s, a.path, a.out, a.manifest),
            "downscale": lambda: project.downscale(s, a.path, a.out, a.manifest, ref=a.ref, palette=a.palette, bg=a.bg, colorkey=a.colorkey, weak=a.weak, tol=a.tol, metric=a.metric, resolve=a.resolve, grain=a.grain, register=a.register, despeckle=a.despeckle, confidence=a.confidence, report_path=a.report),
            "mask": lambda: project.mask(s, a.folder, a.out, load(a.spec), a.overlay),
            "remix": lambda: project.remix(s, a.edited, a.out, a.orig, a.mask, a.alpha, a.report),
            "recolor": lambda: project.recolour(s, a.folder, a.out, load(a.spec)),
            "compose": lambda: project.compose(s, a.folder, a.out, load(a.spec)["ops"]),
            "lift": lambda: project.lift(s, a.out, a.over, a.under, a.control, a.min_alpha, a.passes),
            "snap": lambda: project.snap(s, a.folder, a.out, ref=a.ref, palette=a.palette, colours=a.colors, pixel_size=a.pixel_size, flatten=a.flatten, force=a.force),
            "pixelize": lambda: project.pixelize(s, a.path, a.out, *(a.size or (32, 32)), a.colors, a.palette),
            "split": lambda: project.split(s, a.path, a.rows, a.cols, a.out),
            "bundle": lambda: project.bundle(s, a.folder, a.out, a.fps, a.zoom),
            "prepare": lambda: project.prepare(s, a.folder, a.out),
            "smooth": lambda: project.smooth(s, a.project, a.done, a.out),
            "verify-roundtrip": lambda: project.verify(s, a.folder),
            "review": lambda: project.review(s, a.project, a.done, a.out, a.zoom),
            "batch": lambda: _batch(s, a),
            "tools": lambda: tools.serve(tools.Workshop(s, lambda: service.Service.configured(a.style))),
        }[a.command]()
    if out is not None:
        print(json.dumps(out, indent=1) if not isinstance(out, str) else out)
    return out


if __name__ == "__main__":
    main()
