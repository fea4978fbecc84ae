"""Column expressions on pixels: colour spaces, distances, blends and predicates.

A pixel has integer channels r, g, b and a from 0 to 255; it is opaque from alpha 128 on. All expressions stay in
generated code; integer arithmetic truncates toward zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
OPAQUE = 128


def lit(x: int | float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def div(a: Column | int, b: Column | int) -> Column:
    """Integer division toward zero."""
    return F.call_function("div", lit(a), lit(b)).cast("int")


def shl(a: Column, n: int) -> Column:
    return F.shiftleft(a, n)


def shr(a: Column, n: int) -> Column:
    return F.shiftright(a, n)


def opaque(a: Column | str = "a", threshold: int = OPAQUE) -> Column:
    return (C(a) if isinstance(a, str) else a) >= threshold


# 16-bit colours -------------------------------------------------------------------------------------------------------
def to_565(r: Column, g: Column, b: Column) -> Column:
    """The 5-6-5 bit word of a colour; low bits are cut."""
    return shl(shr(r, 3), 11).bitwiseOR(shl(shr(g, 2), 5)).bitwiseOR(shr(b, 3))


def from_565(w: Column) -> tuple[Column, Column, Column]:
    """The colour of a word, its high bits repeated in the low ones."""
    r, g, b = shr(w, 11).bitwiseAND(F.lit(31)), shr(w, 5).bitwiseAND(F.lit(63)), w.bitwiseAND(F.lit(31))
    return shl(r, 3).bitwiseOR(shr(r, 2)), shl(g, 2).bitwiseOR(shr(g, 4)), shl(b, 3).bitwiseOR(shr(b, 2))


def from_565_scaled(w: Column) -> tuple[Column, Column, Column]:
    """The colour of a word by scaling, ``v * 255 div 31`` (63 for green): other values than :func:`from_565`."""
    r, g, b = shr(w, 11).bitwiseAND(F.lit(31)), shr(w, 5).bitwiseAND(F.lit(63)), w.bitwiseAND(F.lit(31))
    return div(r * 255, 31), div(g * 255, 63), div(b * 255, 31)


def canonical(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """The colour after a round trip through 16 bits."""
    return from_565(to_565(r, g, b))


def decode_word(w: Column, key: int | None, clear: bool = False) -> list[Column]:
    """r, g, b, a of a word. The key is transparent and keeps its colour, or loses it with ``clear``."""
    rgb = (from_565_scaled if clear else from_565)(w)
    if key is None:
        return [*rgb, F.lit(255)]
    is_key = w == key
    return [*(F.when(is_key, 0).otherwise(c) if clear else c for c in rgb), F.when(is_key, 0).otherwise(255)]


def encode_word(key: int | None) -> Column:
    """The word of a pixel; fully transparent ones are the key. An opaque pixel of the key's colour is not guarded."""
    w = to_565(C("r"), C("g"), C("b"))
    return w if key is None else F.when(C("a") == 0, F.lit(key)).otherwise(w)


def encode_word_guarded(key: int) -> Column:
    """The word of a pixel; those that are not opaque are the key, and an opaque one that equals it moves by its lowest bit."""
    w = to_565(C("r"), C("g"), C("b"))
    return F.when(~opaque(), F.lit(key)).when(w == key, w.bitwiseXOR(F.lit(1))).otherwise(w)


# Distances ------------------------------------------------------------------------------------------------------------
Rgb = tuple


def _d(p: Rgb, q: Rgb) -> tuple[Column, Column, Column]:
    return tuple(lit(a) - lit(b) for a, b in zip(p, q))


def dist2(p: Rgb, q: Rgb) -> Column:
    """Squared distance of two colours."""
    r, g, b = _d(p, q)
    return r * r + g * g + b * b


def redmean2(p: Rgb, q: Rgb) -> Column:
    """Squared red-mean distance times 256, in integers; the mean of the reds is cut."""
    r, g, b = _d(p, q)
    m = div(lit(p[0]) + lit(q[0]), 2)
    return (512 + m) * r * r + 1024 * g * g + (767 - m) * b * b


def redmean(p: Rgb, q: Rgb) -> Column:
    """Red-mean distance as a double."""
    r, g, b = _d(p, q)
    m = (lit(p[0]) + lit(q[0])) / 2
    return F.sqrt((2 + m / 256) * r * r + 4 * g * g + (2 + (255 - m) / 256) * b * b)


def l1(p: Rgb, q: Rgb) -> Column:
    return sum((F.abs(x) for x in _d(p, q)[1:]), F.abs(_d(p, q)[0]))


def strong_edge(p: Rgb, q: Rgb) -> Column:
    return l1(p, q) > 90


def same_stock(p: Rgb, pa: Column, q: Rgb, qa: Column) -> Column:
    """Both transparent, or both opaque and at most 30 apart in sum."""
    return F.when(opaque(pa) & opaque(qa), l1(p, q) <= 30).otherwise(~opaque(pa) & ~opaque(qa))


def close_colour(p: Rgb, pa: Column, q: Rgb, qa: Column, reach: int = 64) -> Column:
    return F.when(opaque(pa) & opaque(qa), dist2(p, q) <= reach * reach).otherwise(~opaque(pa) & ~opaque(qa))


# Light and hue --------------------------------------------------------------------------------------------------------
def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value from 0 to 1."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    c = (hi - lo).cast("double")
    h = F.when(c == 0, 0.0).when(hi == r, F.pmod((g - b) / c, F.lit(6.0))).when(hi == g, (b - r) / c + 2).otherwise((r - g) / c + 4) * 60
    return h, F.when(hi == 0, 0.0).otherwise(c / hi), hi / 255.0


def hls(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, lightness and saturation from 0 to 1."""
    hi, lo = F.greatest(r, g, b) / 255.0, F.least(r, g, b) / 255.0
    l_ = (hi + lo) / 2
    s = F.when(hi == lo, 0.0).when(l_ <= 0.5, (hi - lo) / (hi + lo)).otherwise((hi - lo) / (2.0 - hi - lo))
    return hsv(r, g, b)[0], l_, s


def hue_class() -> Column:
    """A coarse class by hue and lightness, the kind of predicate that masks are made of."""
    h, l_, s = hls(C("r"), C("g"), C("b"))
    return F.when(~opaque(), "none").when(l_ < 0.12, "dark").when(l_ > 0.9, "light").when(s < 0.15, "grey").when((h < 20) | (h >= 340), "red").when(h < 45, "skin").when(h < 70, "gold").when(h < 170, "green").when(h < 255, "blue").otherwise("violet")


# Classes of colours that masks are made of, as conditions on h (hue in degrees), s, l (of hls) and r, g, b. A name in braces is another class.
RULES = {
    "skin": "(h <= 15 OR h >= 345) AND s > 0.25 AND l > 0.35",
    "tan": "h >= 14 AND h <= 42 AND s > 0.35 AND l > 0.30 AND b >= 45",
    "peach": "h >= 10 AND h <= 45 AND s > 0.15 AND l > 0.45",
    "hair": "h >= 140 AND h <= 210 AND s > 0.20",
    "cool_hair": "g > r + 25 AND b > r + 40 AND g > 80",
    "gold": "h >= 16 AND h <= 50 AND s >= 0.45 AND l < 0.85",
    "blue": "h >= 200 AND h <= 250 AND s > 0.30 AND l < 0.75 AND NOT {hair}",
    "dark": "l < 0.40",
    "frill": "s < 0.18 AND l > 0.70",
    "trim": "h >= 35 AND h <= 60 AND s > 0.35",
    "outfit": "NOT {peach} AND NOT {hair} AND ({dark} OR {trim} OR {frill})",
    "cloth": "({outfit} OR {blue} OR {gold}) AND NOT {skin} AND NOT {hair}",
    "effect": "h >= 60 AND h <= 300 AND s >= 0.10 AND l >= 0.35",
    "pale_cloth": "NOT {tan} AND NOT {hair} AND NOT {effect} AND (s < 0.25 AND l > 0.25 OR s < 0.45 AND l > 0.70)",
    "aura": "r > g + 30 AND b > g + 30 OR r > 2 * g + 40 AND r > 2 * b + 20",
}


def rule(name: str) -> str:
    """The condition of a class, with those that it names put in."""
    out = RULES[name]
    for other in RULES:
        if "{" + other + "}" in out:
            out = out.replace("{" + other + "}", f"({rule(other)})")
    return out


def classes(px: DataFrame, names: Sequence[str] = tuple(RULES)) -> DataFrame:
    """px with a boolean column for each class; false where not opaque."""
    h, l_, s = hls(C("r"), C("g"), C("b"))
    p = px.withColumns({"h": h, "l": l_, "s": s})
    return p.select(*px.columns, *[(opaque() & F.expr(rule(n))).alias(n) for n in names])


def sea(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Violet to red hues (255 to 350 degrees, saturation 0.25 and more) become graded blues, very light ones foam; others stay.
    Rounded half to even."""
    h, s, v = hsv(r, g, b)
    hit, foam = (h >= 255) & (h <= 350) & (s >= 0.25), v > 0.92
    shade = lambda lo, hi, top: F.when(foam, top).otherwise(F.bround(lo + (hi - lo) * v).cast("int"))
    return tuple(F.when(hit, x).otherwise(c) for x, c in ((shade(10, 90, 235), r), (shade(60, 190, 248), g), (shade(110, 235, 255), b)))


def level(v: Column, cuts: Column) -> Column:
    """How many leading cuts v is over: an unsorted list stops at the first cut that v is not over."""
    n = F.aggregate(cuts, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, c: F.struct((acc["n"] + F.when(acc["go"] & (v > c), 1).otherwise(0)).alias("n"), (acc["go"] & (v > c)).alias("go")))
    return n["n"]


# Blends ---------------------------------------------------------------------------------------------------------------
def over(p: Column, q: Column, a: Column) -> Column:
    """A channel p laid over q at alpha a, rounded."""
    return div(p * a + q * (255 - a) + 127, 255)


def flattened(p: Column, bg: int, a: Column) -> Column:
    """A channel on a background, cut."""
    return div(p * a + lit(bg) * (255 - a), 255)


def keyed_out(bg: tuple[int, int, int], tolerance: int = 110) -> list[Column]:
    """r, g, b, a: transparent black where the pixel is not opaque or its red-mean distance from bg is under the tolerance, else opaque."""
    out = ~opaque() | (redmean((C("r"), C("g"), C("b")), bg) < tolerance)
    return [*(F.when(out, 0).otherwise(C(c)).alias(c) for c in "rgb"), F.when(out, 0).otherwise(255).alias("a")]


def binarised(threshold: int = OPAQUE) -> list[Column]:
    """r, g, b, a with alpha 0 (and black) under the threshold, else 255."""
    return [*(F.when(C("a") < threshold, 0).otherwise(C(c)).alias(c) for c in "rgb"), F.when(C("a") < threshold, 0).otherwise(255).alias("a")]


def confidence_colour(share: Column, weak: float = 0.6) -> list[Column]:
    """Red, the stronger the lower the share, where it is weak; else clear."""
    w = share < weak
    return [F.when(w, 255).otherwise(0), F.lit(0), F.when(w, 64).otherwise(0), F.when(w, F.least(F.lit(255), ((1 - share) * 408).cast("int"))).otherwise(0)]


# Text forms -----------------------------------------------------------------------------------------------------------
def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("%02x%02x%02x", r, g, b)


def from_hex(s: Column) -> tuple[Column, Column, Column]:
    """Channels of ``rrggbb`` with or without a hash sign."""
    h = F.regexp_replace(s, "^#", "")
    return tuple(F.conv(F.substring(h, i, 2), 16, 10).cast("int") for i in (1, 3, 5))


def axis_weights(scale: int) -> list[int]:
    """Weights of a block's columns: a triangle, at least 1."""
    return [max(1, (scale - 1) - abs(2 * i - (scale - 1)) // 2) for i in range(scale)]
