"""Palettes: ordered colour lists from names, hex text, files, images; and the choice of backgrounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pixels as P

# Public palettes by name.
PRESETS = {
    "pico8": "000000 1d2b53 7e2553 008751 ab5236 5f574f c2c3c7 fff1e8 ff004d ffa300 ffec27 00e436 29adff 83769c ff77a8 ffccaa",
    "gameboy": "0f380f 306230 8bac0f 9bbc0f",
    "cga": "000000 55ffff ff55ff ffffff",
}
#: Backgrounds to choose from (fixed values).
BACKGROUNDS = {"magenta": (255, 0, 255), "green": (0, 255, 0), "cyan": (0, 255, 255), "blue": (0, 0, 255)}
SCHEMA = "ord int, pr int, pg int, pb int"
MOST = 65_536


def parse_hex(s: str) -> tuple[int, int, int]:
    s = s.strip().lstrip("#")
    if len(s) != 6:
        raise ValueError(f"a colour is rrggbb, not {s!r}")
    return tuple(int(s[i : i + 2], 16) for i in (0, 2, 4))


def canonical(c: tuple[int, int, int]) -> tuple[int, int, int]:
    """The colour after a round trip through 16 bits."""
    r, g, b = c[0] >> 3, c[1] >> 2, c[2] >> 3
    return r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2


def parse(spec: str, round_16: bool = False) -> list[tuple[int, int, int]]:
    """Colours in order, repeats kept: a preset's name, text of hex colours, or the text of a GIMP palette."""
    if spec in PRESETS:
        out = [parse_hex(x) for x in PRESETS[spec].split()]
    elif spec.lstrip().startswith("GIMP Palette"):
        rows = [x.split() for x in spec.splitlines()[1:] if x[:1].strip().isdigit() or x[:1] == " "]
        out = [tuple(map(int, x[:3])) for x in rows if len(x) >= 3 and all(y.isdigit() for y in x[:3])]
    else:
        out = [parse_hex(x) for x in spec.replace(",", " ").split() if x.strip()]
    return [canonical(c) for c in out] if round_16 else out


def table(spark: SparkSession, colours: list[tuple[int, int, int]]) -> DataFrame:
    """ord, pr, pg, pb."""
    return spark.createDataFrame([(i, *c) for i, c in enumerate(colours)], SCHEMA)


def to_hex(colours: list[tuple[int, int, int]]) -> str:
    return ",".join("%02x%02x%02x" % c for c in colours)


def listed(palette: DataFrame) -> list[tuple[int, int, int]]:
    """The palette on the driver; at most MOST colours, as 16-bit colours have no more."""
    rows = palette.orderBy("ord").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"over {MOST} colours")
    return [(r["pr"], r["pg"], r["pb"]) for r in rows]


def of_pixels(px: DataFrame, threshold: int = P.OPAQUE) -> DataFrame:
    """The distinct 16-bit colours of opaque pixels, in order of r, g, b: pr, pg, pb."""
    r, g, b = P.canonical(F.col("r"), F.col("g"), F.col("b"))
    return px.where(P.opaque(threshold=threshold)).select(r.alias("pr"), g.alias("pg"), b.alias("pb")).distinct().orderBy("pr", "pg", "pb")


def without(palette: DataFrame, colour: tuple[int, int, int]) -> DataFrame:
    return palette.where(~((F.col("pr") == colour[0]) & (F.col("pg") == colour[1]) & (F.col("pb") == colour[2])))


def furthest(palette: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The colour of a 16 by 16 by 16 grid with the largest least squared distance to the palette; the first of equals."""
    best, at = -1, (0, 0, 0)
    for r in range(0, 256, 17):
        for g in range(0, 256, 17):
            for b in range(0, 256, 17):
                d = min(((r - x) ** 2 + (g - y) ** 2 + (b - z) ** 2 for x, y, z in palette), default=0)
                if d > best:
                    best, at = d, (r, g, b)
    return at


def furthest_frame(palette: DataFrame) -> DataFrame:
    """fr, fg, fb, d of the same choice, as a query over a palette table."""
    spark = palette.sparkSession
    axis = [spark.range(16).select((F.col("id") * 17).cast("int").alias(c)) for c in ("fr", "fg", "fb")]
    grid = axis[0].crossJoin(F.broadcast(axis[1])).crossJoin(F.broadcast(axis[2]))  # 4096 fixed rows
    d = P.dist2((F.col("fr"), F.col("fg"), F.col("fb")), (F.col("pr"), F.col("pg"), F.col("pb")))
    near = grid.crossJoin(palette.select("pr", "pg", "pb")).groupBy("fr", "fg", "fb").agg(F.min(d).alias("d"))
    best = near.agg(F.max(F.struct("d", -F.col("fr"), -F.col("fg"), -F.col("fb"))).alias("m"))
    return best.select((-F.col("m.col2")).alias("fr"), (-F.col("m.col3")).alias("fg"), (-F.col("m.col4")).alias("fb"), F.col("m.d").alias("d"))


def redmean(p: tuple[int, int, int], q: tuple[int, int, int]) -> float:
    m = (p[0] + q[0]) / 2
    r, g, b = (x - y for x, y in zip(p, q))
    return ((2 + m / 256) * r * r + 4 * g * g + (2 + (255 - m) / 256) * b * b) ** 0.5


def pick_background(palette: list[tuple[int, int, int]]) -> str:
    """The name of the background whose least red-mean distance to the palette is largest; the first of equals."""
    return max(BACKGROUNDS, key=lambda n: min((redmean(BACKGROUNDS[n], c) for c in palette), default=0.0))


def median_cut(counts: list[tuple[tuple[int, int, int], int]], n: int) -> list[tuple[int, int, int]]:
    """At most n colours: the box with the widest channel (by range, then pixels) is cut at its median pixel until there are n;
    each gives its mean, rounded. With n colours or fewer, they stay as they are."""
    if len(counts) <= n:
        return sorted(c for c, _ in counts)
    boxes = [sorted(counts)]
    while len(boxes) < n:
        widths = [(max(max(c[k] for c, _ in b) - min(c[k] for c, _ in b) for k in range(3)), sum(w for _, w in b), -i) for i, b in enumerate(boxes) if len(b) > 1]
        if not widths:
            break
        i = -max(widths)[2]
        b = boxes.pop(i)
        k = max(range(3), key=lambda k: (max(c[k] for c, _ in b) - min(c[k] for c, _ in b), -k))
        b.sort(key=lambda x: (x[0][k], x[0]))
        half, run, cut = sum(w for _, w in b) / 2, 0, 1
        for j, (_, w) in enumerate(b[:-1]):
            run += w
            cut = j + 1
            if run >= half:
                break
        boxes[i:i] = [b[:cut], b[cut:]]
    out = []
    for b in boxes:
        t = sum(w for _, w in b)
        out.append(tuple(int(sum(c[k] * w for c, w in b) / t + 0.5) for k in range(3)))
    return sorted(set(out))
