"""Queries on single pixels, palettes and pixel joins. Each has SQL over the same derived relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import palettes, pixels as P
from ..operators import alignment, layout, masks, palette_ops
from ..operators.common import C, RGB, RGBA, rgb
from . import fixtures as X

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None, *ctes: str):
    """Registers a function; the SQL gets the named derivations in front."""

    def put(f):
        QUERIES[name] = (f, f"WITH RECURSIVE {', '.join(ctes)} {sql}" if sql and ctes else sql)
        return f

    return put


#: SQL of the colour decisions.
D2 = lambda a, b: f"((({a}r)-({b}r))*(({a}r)-({b}r))+(({a}g)-({b}g))*(({a}g)-({b}g))+(({a}b)-({b}b))*(({a}b)-({b}b)))"
PD2 = "((pr-r)*(pr-r)+(pg-g)*(pg-g)+(pb-b)*(pb-b))"
REDMEAN2 = "((512+(r+pr)//2)*(r-pr)*(r-pr)+1024*(g-pg)*(g-pg)+(767-(r+pr)//2)*(b-pb)*(b-pb))"


def near_sql(src: str, d: str = PD2, where: str = "true", name: str = "near") -> str:
    """A derivation ``near``: pixels of src with their nearest palette entry pr, pg, pb, ord, d."""
    return f"""{name} AS (SELECT * FROM (SELECT s.*, p.ord, p.pr, p.pg, p.pb, {d} AS d, row_number() OVER (PARTITION BY frame, x, y ORDER BY {d}, p.ord) AS k
  FROM {src} s CROSS JOIN pal p WHERE {where}) WHERE k = 1)"""


def _px(spark, d):
    return X.px(spark, d)


@query("p00_derive_pixels", "SELECT * FROM px", X.PX_SQL)
def derive(spark, d):
    return _px(spark, d)


@query("p01_canonical", "SELECT frame, x, y, ((r >> 3) << 3) | (r >> 5) AS r, ((g >> 2) << 2) | (g >> 6) AS g, ((b >> 3) << 3) | (b >> 5) AS b FROM px", X.PX_SQL)
def canonical(spark, d):
    return _px(spark, d).select("frame", "x", "y", *[c.alias(n) for c, n in zip(P.canonical(C("r"), C("g"), C("b")), RGB)])


@query("p02_words_both_ways", """SELECT w, ((w >> 11) << 3) | (w >> 13) AS r, (((w >> 5) & 63) << 2) | (((w >> 5) & 63) >> 4) AS g, ((w & 31) << 3) | ((w & 31) >> 2) AS b,
  (w >> 11) * 255 // 31 AS r2, ((w >> 5) & 63) * 255 // 63 AS g2, (w & 31) * 255 // 31 AS b2 FROM (SELECT DISTINCT CAST((user_id * 2897) % 65536 AS INT) AS w FROM events)""")
def words(spark, d):
    w = X.table(spark, d, "events").select((F.col("user_id") * 2897 % 65536).cast("int").alias("w")).distinct()
    return w.select("w", *[c.alias(n) for c, n in zip(P.from_565(C("w")), RGB)], *[c.alias(f"{n}2") for c, n in zip(P.from_565_scaled(C("w")), RGB)])


@query("p03_to_words", "SELECT frame, x, y, ((r >> 3) << 11) | ((g >> 2) << 5) | (b >> 3) AS w FROM px", X.PX_SQL)
def to_words(spark, d):
    return _px(spark, d).select("frame", "x", "y", P.to_565(C("r"), C("g"), C("b")).alias("w"))


_W = "((r >> 3) << 11) | ((g >> 2) << 5) | (b >> 3)"


@query("p04_decode_with_key", f"""SELECT frame, x, y, ((w >> 11) << 3) | (w >> 13) AS r, CASE WHEN w % 5 = 0 THEN 0 ELSE 255 END AS a5, CASE WHEN w = 31 THEN 0 ELSE 255 END AS a FROM (SELECT frame, x, y, {_W} AS w FROM px)""", X.PX_SQL)
def decode(spark, d):
    w = to_words(spark, d)
    r, _, _, a = P.decode_word(C("w"), 31)
    return w.select("frame", "x", "y", r.alias("r"), F.when(C("w") % 5 == 0, 0).otherwise(255).alias("a5"), a.alias("a"))


@query("p05_encode_with_key", f"""SELECT frame, x, y, CASE WHEN a = 0 THEN 2047 ELSE w END AS plain, CASE WHEN a < 128 THEN 2047 WHEN w = 2047 THEN 2046 ELSE w END AS guarded FROM (SELECT *, {_W} AS w FROM px)""", X.PX_SQL)
def encode(spark, d):
    return _px(spark, d).select("frame", "x", "y", P.encode_word(2047).alias("plain"), P.encode_word_guarded(2047).alias("guarded"))


@query("p06_luminance", "SELECT frame, x, y, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM px", X.PX_SQL)
def luminance(spark, d):
    return _px(spark, d).select("frame", "x", "y", P.luminance(C("r"), C("g"), C("b")).alias("l"))


_J = "px JOIN alt q USING (frame, x, y)"


@query("p07_distances", f"""SELECT frame, x, y, {D2('px.', 'q.')} AS d2, (512 + (px.r + q.r) // 2) * (px.r - q.r) * (px.r - q.r) + 1024 * (px.g - q.g) * (px.g - q.g) + (767 - (px.r + q.r) // 2) * (px.b - q.b) * (px.b - q.b) AS rm2,
  sqrt((2 + (px.r + q.r) / 2.0 / 256) * (px.r - q.r) * (px.r - q.r) + 4 * (px.g - q.g) * (px.g - q.g) + (2 + (255 - (px.r + q.r) / 2.0) / 256) * (px.b - q.b) * (px.b - q.b)) AS rm FROM {_J}""", X.PX_SQL, X.ALT_SQL)
def distances(spark, d):
    j = _joined(spark, d)
    return j.select("frame", "x", "y", P.dist2(rgb(), rgb("q")).alias("d2"), P.redmean2(rgb(), rgb("q")).alias("rm2"), P.redmean(rgb(), rgb("q")).alias("rm"))


def _joined(spark, d):
    p = _px(spark, d)
    return p.join(X.alt(p).select("frame", "x", "y", *[C(c).alias(f"q{c}") for c in RGBA]), ["frame", "x", "y"])


@query("p08_strong_steps", "SELECT frame, y, count(*) AS n FROM (SELECT frame, y, abs(r - lag(r) OVER w) + abs(g - lag(g) OVER w) + abs(b - lag(b) OVER w) AS s FROM px WINDOW w AS (PARTITION BY frame, y ORDER BY x)) WHERE s > 90 GROUP BY frame, y", X.PX_SQL)
def steps(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("frame", "y").orderBy("x")
    p = _px(spark, d).select("frame", "y", *RGB, *[F.lag(c).over(w).alias(f"p{c}") for c in RGB])
    return p.where(P.strong_edge(rgb("p"), rgb())).groupBy("frame", "y").agg(F.count("*").alias("n"))


@query("p09_blends", "SELECT frame, x, y, (r * ((x * 17) % 256) + g * (255 - (x * 17) % 256) + 127) // 255 AS laid, (r * ((y * 17) % 256) + 128 * (255 - (y * 17) % 256)) // 255 AS flat FROM px", X.PX_SQL)
def blends(spark, d):
    return _px(spark, d).select("frame", "x", "y", P.over(C("r"), C("g"), C("x") * 17 % 256).alias("laid"), P.flattened(C("r"), 128, C("y") * 17 % 256).alias("flat"))


@query("p10_hex_text", "SELECT frame, x, y, printf('%02x%02x%02x', r, g, b) AS h, r AS r2, g AS g2, b AS b2 FROM px", X.PX_SQL)
def hex_text(spark, d):
    p = _px(spark, d).select("frame", "x", "y", P.hex_of(C("r"), C("g"), C("b")).alias("h"))
    return p.select("*", *[c.alias(f"{n}2") for c, n in zip(P.from_hex(F.concat(F.lit("#"), C("h"))), RGB)])


_RMBG = "sqrt((2 + (r + 255) / 2.0 / 256) * (r - 255) * (r - 255) + 4 * g * g + (2 + (255 - (r + 255) / 2.0) / 256) * (b - 255) * (b - 255))"


@query("p11_key_out", f"SELECT frame, x, y, CASE WHEN o THEN 0 ELSE r END AS r, CASE WHEN o THEN 0 ELSE g END AS g, CASE WHEN o THEN 0 ELSE b END AS b, CASE WHEN o THEN 0 ELSE 255 END AS a FROM (SELECT *, a < 128 OR {_RMBG} < 110 AS o FROM px)", X.PX_SQL)
def key_out(spark, d):
    return _px(spark, d).select("frame", "x", "y", *P.keyed_out((255, 0, 255)))


@query("p12_binarise", "SELECT frame, x, y, CASE WHEN a < 200 THEN 0 ELSE r END AS r, CASE WHEN a < 200 THEN 0 ELSE g END AS g, CASE WHEN a < 200 THEN 0 ELSE b END AS b, CASE WHEN a < 200 THEN 0 ELSE 255 END AS a FROM px", X.PX_SQL)
def binarise(spark, d):
    return _px(spark, d).select("frame", "x", "y", *P.binarised(200))


@query("p13_same_pixels", f"""SELECT frame, x, y, CASE WHEN px.a >= 128 AND q.a >= 128 THEN abs(px.r - q.r) + abs(px.g - q.g) + abs(px.b - q.b) <= 30 ELSE px.a < 128 AND q.a < 128 END AS stock,
  CASE WHEN px.a >= 128 AND q.a >= 128 THEN {D2('px.', 'q.')} <= 4096 ELSE px.a < 128 AND q.a < 128 END AS close FROM {_J}""", X.PX_SQL, X.ALT_SQL)
def same(spark, d):
    j = _joined(spark, d)
    return j.select("frame", "x", "y", P.same_stock(rgb(), C("a"), rgb("q"), C("qa")).alias("stock"), P.close_colour(rgb(), C("a"), rgb("q"), C("qa")).alias("close"))


_HUE = """CASE WHEN hi = lo THEN 0.0::DOUBLE WHEN hi = r THEN (g - b)::DOUBLE / (hi - lo) + CASE WHEN g < b THEN 6 ELSE 0 END WHEN hi = g THEN (b - r)::DOUBLE / (hi - lo) + 2 ELSE (r - g)::DOUBLE / (hi - lo) + 4 END * 60"""
_HLS = f"""hl AS (SELECT *, {_HUE} AS h, (hi / 255.0::DOUBLE + lo / 255.0::DOUBLE) / 2 AS l FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM px)),
hls AS (SELECT *, CASE WHEN hi = lo THEN 0.0 WHEN l <= 0.5 THEN (hi / 255.0::DOUBLE - lo / 255.0::DOUBLE) / (hi / 255.0::DOUBLE + lo / 255.0::DOUBLE) ELSE (hi / 255.0::DOUBLE - lo / 255.0::DOUBLE) / (2.0::DOUBLE - hi / 255.0::DOUBLE - lo / 255.0::DOUBLE) END AS s,
  CASE WHEN hi = 0 THEN 0.0 ELSE (hi - lo)::DOUBLE / hi END AS sv, hi / 255.0::DOUBLE AS v FROM hl)"""


@query("p14_hue_classes", "SELECT frame, CASE WHEN a < 128 THEN 'none' WHEN l < 0.12 THEN 'dark' WHEN l > 0.9 THEN 'light' WHEN s < 0.15 THEN 'grey' WHEN h < 20 OR h >= 340 THEN 'red' WHEN h < 45 THEN 'skin' WHEN h < 70 THEN 'gold' WHEN h < 170 THEN 'green' WHEN h < 255 THEN 'blue' ELSE 'violet' END AS kind, count(*) AS n FROM hls GROUP BY 1, 2", X.PX_SQL, _HLS)
def hue_classes(spark, d):
    return _px(spark, d).select("frame", P.hue_class().alias("kind")).groupBy("frame", "kind").agg(F.count("*").alias("n"))


_RULES = ", ".join(f"a >= 128 AND ({P.rule(n)}) AS {n}" for n in P.RULES)


@query("p14_colour_rules", f"SELECT frame, x, y, {_RULES} FROM hls", X.PX_SQL, _HLS)
def colour_rules(spark, d):
    return P.classes(_px(spark, d)).drop(*"rgba")


@query("p15_sea_colours", """SELECT frame, x, y, CASE WHEN hit THEN CASE WHEN v > 0.92 THEN 235 ELSE round_even(10 + 80 * v, 0)::INT END ELSE r END AS r, CASE WHEN hit THEN CASE WHEN v > 0.92 THEN 248 ELSE round_even(60 + 130 * v, 0)::INT END ELSE g END AS g,
  CASE WHEN hit THEN CASE WHEN v > 0.92 THEN 255 ELSE round_even(110 + 125 * v, 0)::INT END ELSE b END AS b FROM (SELECT *, h >= 255 AND h <= 350 AND sv >= 0.25 AS hit FROM hls)""", X.PX_SQL, _HLS)
def sea(spark, d):
    return _px(spark, d).select("frame", "x", "y", *[c.alias(n) for c, n in zip(P.sea(C("r"), C("g"), C("b")), RGB)])


@query("p16_confidence_colours", "SELECT frame, x, y, CASE WHEN s < 0.6 THEN 255 ELSE 0 END AS r, CASE WHEN s < 0.6 THEN 64 ELSE 0 END AS b, CASE WHEN s < 0.6 THEN least(255, trunc((1 - s) * 408)::INT) ELSE 0 END AS a FROM (SELECT *, g / 255.0::DOUBLE AS s FROM px)", X.PX_SQL)
def confidence(spark, d):
    r, _, b, a = P.confidence_colour(C("g") / 255.0)
    return _px(spark, d).select("frame", "x", "y", r.alias("r"), b.alias("b"), a.alias("a"))


@query("p17_axis_weights", "SELECT s AS scale, i, greatest(1, (s - 1) - abs(2 * i - (s - 1)) // 2) AS w FROM (SELECT CAST(s AS INT) AS s, CAST(unnest(generate_series(0, s - 1)) AS INT) AS i FROM (SELECT unnest(generate_series(1, 12)) AS s))")
def weights(spark, d):
    return spark.createDataFrame([(s, i, w) for s in range(1, 13) for i, w in enumerate(P.axis_weights(s))], "scale int, i int, w int")


@query("p19_ramp_levels", "SELECT frame, x, y, CASE WHEN NOT l > 60 THEN 0 WHEN NOT l > 120 THEN 1 WHEN NOT l > 90 THEN 2 ELSE 3 END AS level FROM (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM px)", X.PX_SQL)
def levels(spark, d):
    return _px(spark, d).select("frame", "x", "y", P.level(P.luminance(C("r"), C("g"), C("b")), F.array(F.lit(60.0), F.lit(120.0), F.lit(90.0))).alias("level"))


# Filters and palettes ---------------------------------------------------------------------------------------------------
@query("f01_opaque", "SELECT frame, count(*) AS n FROM px WHERE a >= 128 GROUP BY frame", X.PX_SQL)
def opaque(spark, d):
    return _px(spark, d).where(P.opaque()).groupBy("frame").agg(F.count("*").alias("n"))


_POLY = [(1.5, 1.0), (14.0, 2.0), (12.5, 14.0), (7.0, 6.0), (2.0, 13.0)]
_SUB = [(4.0, 3.0), (8.0, 3.0), (8.0, 5.0), (4.0, 5.0)]
_LINE = ((2.0, 12.0), (13.0, 3.0), 1.5)


def _mask(spark, d):
    """The pixels and one region's mask on every frame under the bound."""
    p = _px(spark, d)
    polys, lines = masks.edges({0: [{"add": [_POLY], "sub": [_SUB], "sub_lines": [_LINE]}]})
    every = p.select("frame").distinct()
    spread = lambda rows, ddl: every.crossJoin(F.broadcast(spark.createDataFrame(rows, ddl).drop("frame")))
    return p, masks.rasterised(p, spread(polys, masks.SPEC), spread(lines, masks.LINES), 16, 16)


def _inside_sql(poly):
    """Even-odd by counting crossings at or left of the pixel's centre."""
    parts = []
    for (x0, y0), (x1, y1) in zip(poly, [*poly[1:], poly[0]]):
        cross = f"({x0} + (y + 0.5::DOUBLE - {y0}) / ({y1} - {y0}) * ({x1} - {x0}))"
        parts.append(f"CASE WHEN ({y0} <= y + 0.5) <> ({y1} <= y + 0.5) AND {cross} <= x + 0.5 THEN 1 ELSE 0 END" if y0 != y1 else "0")
    return f"(({' + '.join(parts)}) % 2 = 1)"


(_AX, _AY), (_BX, _BY), _LW = _LINE
_T = f"least(greatest(((x + 0.5 - {_AX}) * ({_BX} - {_AX}) + (y + 0.5 - {_AY}) * ({_BY} - {_AY}))::DOUBLE / {(_BX - _AX) ** 2 + (_BY - _AY) ** 2}, 0.0), 1.0)"
_ONLINE = f"((x + 0.5 - {_AX} - {_T} * ({_BX} - {_AX})) ** 2 + (y + 0.5 - {_AY} - {_T} * ({_BY} - {_AY})) ** 2 <= {(_LW / 2) ** 2})"
MASK_SQL = f"mask AS (SELECT frame, x, y FROM px WHERE a >= 128 AND {_inside_sql(_POLY)} AND NOT {_inside_sql(_SUB)} AND NOT {_ONLINE})"


@query("f04_rasterised_masks", "SELECT frame, CAST(0 AS INT) AS region, x, y FROM mask", X.PX_SQL, MASK_SQL)
def rasterised(spark, d):
    return _mask(spark, d)[1]


CROPS_SQL = "crops AS (SELECT frame, CAST(frame % 5 + 1 AS INT) AS cx, CAST(frame % 3 + 2 AS INT) AS cy, CAST(8 AS INT) AS cw, CAST(9 AS INT) AS ch FROM px GROUP BY frame)"


def _crops(p):
    return p.select("frame").distinct().select("frame", (C("frame") % 5 + 1).cast("int").alias("cx"), (C("frame") % 3 + 2).cast("int").alias("cy"), F.lit(8).alias("cw"), F.lit(9).alias("ch"))


@query("f06_box_masks", "SELECT frame, x, y FROM px JOIN crops USING (frame) WHERE a >= 128 AND x >= cx AND x < cx + cw AND y >= cy AND y < cy + ch", X.PX_SQL, CROPS_SQL)
def box_masks(spark, d):
    p = _px(spark, d)
    return masks.box_masks(p, _crops(p))


@query("f08_colour_sets", "SELECT frame, count(*) AS n FROM flat SEMI JOIN (SELECT DISTINCT r, g, b FROM flat WHERE frame = 0) s ON flat.r = s.r AND flat.g = s.g AND flat.b = s.b GROUP BY frame", X.PX_SQL, X.FLAT_SQL)
def colour_sets(spark, d):
    p = X.flat(_px(spark, d))
    return p.join(p.where("frame = 0").select(*RGB).distinct(), list(RGB), "left_semi").groupBy("frame").agg(F.count("*").alias("n"))


@query("a08_union_palette", "SELECT DISTINCT ((r >> 3) << 3) | (r >> 5) AS pr, ((g >> 2) << 2) | (g >> 6) AS pg, ((b >> 3) << 3) | (b >> 5) AS pb FROM px WHERE a >= 128", X.PX_SQL)
def union_palette(spark, d):
    return palettes.of_pixels(_px(spark, d))


@query("a09_palette_minus_key", "SELECT DISTINCT r AS pr, g AS pg, b AS pb FROM flat WHERE a >= 128 AND NOT (r = 0 AND g = 0 AND b = 0)", X.PX_SQL, X.FLAT_SQL)
def palette_minus(spark, d):
    p = X.flat(_px(spark, d)).where(P.opaque()).select(*[C(c).alias(f"p{c}") for c in RGB]).distinct()
    return palettes.without(p, (0, 0, 0))


@query("a12_furthest_colour", """SELECT CAST(fr AS INT) AS fr, CAST(fg AS INT) AS fg, CAST(fb AS INT) AS fb, CAST(d AS INT) AS d FROM (SELECT fr, fg, fb, min((fr - pr) ** 2 + (fg - pg) ** 2 + (fb - pb) ** 2) AS d
  FROM (SELECT unnest(generate_series(0, 255, 17)) AS fr) CROSS JOIN (SELECT unnest(generate_series(0, 255, 17)) AS fg) CROSS JOIN (SELECT unnest(generate_series(0, 255, 17)) AS fb) CROSS JOIN pal GROUP BY fr, fg, fb) ORDER BY d DESC, fr, fg, fb LIMIT 1""", X.PALETTE_SQL)
def furthest(spark, d):
    return palettes.furthest_frame(X.palette(spark))


# Palette joins ----------------------------------------------------------------------------------------------------------
_OPQ = "opq AS (SELECT * FROM px WHERE a >= 128)"


@query("j01_nearest_colour", "SELECT frame, x, y, pr AS r, pg AS g, pb AS b, a FROM near", X.PX_SQL, X.PALETTE_SQL, _OPQ, near_sql("opq"))
def nearest(spark, d):
    return palette_ops.nearest(_px(spark, d), X.palette(spark))


@query("j01_nearest_redmean", "SELECT frame, x, y, pr AS r, pg AS g, pb AS b, a FROM near", X.PX_SQL, X.PALETTE_SQL, _OPQ, near_sql("opq", REDMEAN2))
def nearest_redmean(spark, d):
    return palette_ops.nearest(_px(spark, d), X.palette(spark), "redmean")


@query("j02_second_nearest", "SELECT frame, x, y, pr AS r, pg AS g, pb AS b, a FROM near", X.PX_SQL, X.PALETTE_SQL, _OPQ, near_sql("opq", where="NOT (pr = 126 AND pg = 37 AND pb = 83)"))
def second(spark, d):
    return palette_ops.second_nearest(_px(spark, d), X.palette(spark), (126, 37, 83))


BGD = "((r-255)*(r-255)+g*g+(b-255)*(b-255))"


@query("j03_background_or_palette", f"SELECT frame, x, y, bg, CASE WHEN NOT bg THEN pr END AS pr, CASE WHEN NOT bg THEN pg END AS pg, CASE WHEN NOT bg THEN pb END AS pb FROM (SELECT *, a < 128 OR {BGD} <= 144 OR {BGD} < d AS bg FROM near)", X.PX_SQL, X.PALETTE_SQL, near_sql("px"))
def background(spark, d):
    return palette_ops.decided(_px(spark, d), X.palette(spark), X.BG)


_REMIX = """remixed AS (SELECT px.frame, px.x, px.y, CASE WHEN t THEN q.r ELSE px.r END AS r, CASE WHEN t THEN q.g ELSE px.g END AS g, CASE WHEN t THEN q.b ELSE px.b END AS b, CASE WHEN t THEN q.a ELSE px.a END AS a, i AS inside, t AS taken
  FROM (SELECT p.*, m.frame IS NOT NULL AS i, m.frame IS NOT NULL AND coalesce(q.a >= 128, false) AS t FROM px p LEFT JOIN mask m USING (frame, x, y) LEFT JOIN alt q USING (frame, x, y) ) px LEFT JOIN alt q USING (frame, x, y))"""


@query("j04_remix", "SELECT * FROM remixed", X.PX_SQL, X.ALT_SQL, MASK_SQL, _REMIX)
def remix(spark, d):
    p, m = _mask(spark, d)
    return masks.remix(X.alt(p), p, m)


@query("a17_seam_error", f"""SELECT s.frame, count(*) AS seam_pairs, sum({D2('s.', 'o.')})::DOUBLE / count(*) AS seam_error FROM remixed s JOIN (SELECT px.* FROM px ANTI JOIN mask USING (frame, x, y) WHERE a >= 128) o
  ON s.frame = o.frame AND abs(s.x - o.x) + abs(s.y - o.y) = 1 WHERE s.inside AND s.a >= 128 GROUP BY s.frame""", X.PX_SQL, X.ALT_SQL, MASK_SQL, _REMIX)
def seam(spark, d):
    p, m = _mask(spark, d)
    return masks.seam(masks.remix(X.alt(p), p, m), p)


@query("j06_place_crops", """SELECT p.frame, p.x, p.y, CASE WHEN i THEN coalesce(q.r, 0) ELSE p.r END AS r, CASE WHEN i THEN coalesce(q.g, 0) ELSE p.g END AS g, CASE WHEN i THEN coalesce(q.b, 0) ELSE p.b END AS b, CASE WHEN i THEN coalesce(q.a, 0) ELSE p.a END AS a
  FROM (SELECT px.*, x >= cx AND x < cx + cw AND y >= cy AND y < cy + ch AS i FROM px JOIN crops USING (frame)) p LEFT JOIN alt q ON i AND q.frame = p.frame AND q.x = p.x AND q.y = p.y""", X.PX_SQL, X.ALT_SQL, CROPS_SQL)
def place(spark, d):
    p = _px(spark, d)
    c = _crops(p)
    return layout.place(layout.crop(X.alt(p), c), p, c)


_PAIRS = "pairs AS (SELECT DISTINCT frame AS f1, frame + 1 AS f2 FROM px)"


@query("j07_colour_map_residuals", """SELECT f1, f2, sum(CASE WHEN o THEN n ELSE 0 END)::BIGINT AS opaque, sum(CASE WHEN o AND k > 1 THEN n ELSE 0 END)::BIGINT AS residual, sum(miss)::BIGINT AS mismatch, max(CASE WHEN o AND k > 1 THEN low END) AS lowest FROM (
  SELECT *, row_number() OVER (PARTITION BY f1, f2, o, r1, g1, b1 ORDER BY n DESC, r2, g2, b2) AS k FROM (
    SELECT f1, f2, o, r1, g1, b1, r2, g2, b2, count(*) AS n, sum(CASE WHEN m THEN 1 ELSE 0 END) AS miss, max(y) AS low FROM (
      SELECT f1, f2, y, coalesce(a1 >= 128 AND a2 >= 128, false) AS o, a1 IS NULL OR a2 IS NULL OR (a1 >= 128) <> (a2 >= 128) AS m, CASE WHEN a1 >= 128 AND a2 >= 128 THEN r1 END AS r1, CASE WHEN a1 >= 128 AND a2 >= 128 THEN g1 END AS g1, CASE WHEN a1 >= 128 AND a2 >= 128 THEN b1 END AS b1,
        CASE WHEN a1 >= 128 AND a2 >= 128 THEN r2 END AS r2, CASE WHEN a1 >= 128 AND a2 >= 128 THEN g2 END AS g2, CASE WHEN a1 >= 128 AND a2 >= 128 THEN b2 END AS b2
      FROM (SELECT f1, f2, x, y, r AS r1, g AS g1, b AS b1, a AS a1 FROM pairs JOIN flat ON frame = f1) s FULL JOIN (SELECT f1, f2, x, y, r AS r2, g AS g2, b AS b2, a AS a2 FROM pairs JOIN flat ON frame = f2) t USING (f1, f2, x, y)) GROUP BY ALL)) GROUP BY f1, f2""", X.PX_SQL, X.FLAT_SQL, _PAIRS)
def colour_maps(spark, d):
    p = X.flat(_px(spark, d))
    pairs = p.select(C("frame").alias("f1")).distinct().select("f1", (C("f1") + 1).alias("f2"))
    return palette_ops.colour_maps(p, pairs)


@query("j08_twins", None)
def twins(spark, d):
    p = X.flat(_px(spark, d))
    other = p.select((C("frame") + 100_000).alias("frame"), "x", "y", (255 - C("r")).alias("r"), "g", "b", "a")
    return palette_ops.twins(p.unionByName(other))


@query("j09_recolour_by_map", """SELECT p.frame, p.x, p.y, CASE WHEN m.r2 IS NOT NULL THEN m.r2 ELSE p.r END AS r, CASE WHEN m.r2 IS NOT NULL THEN m.g2 ELSE p.g END AS g, CASE WHEN m.r2 IS NOT NULL THEN m.b2 ELSE p.b END AS b, p.a FROM flat p LEFT JOIN (
  SELECT * FROM (SELECT r1, g1, b1, r2, g2, b2, row_number() OVER (PARTITION BY r1, g1, b1 ORDER BY count(*) DESC, r2, g2, b2) AS k FROM (SELECT r AS r1, g AS g1, b AS b1, x, y FROM flat WHERE frame = 0 AND a >= 128) JOIN (SELECT r AS r2, g AS g2, b AS b2, x, y FROM flat WHERE frame = 1 AND a >= 128) USING (x, y) GROUP BY r1, g1, b1, r2, g2, b2) WHERE k = 1) m
  ON p.a >= 128 AND p.r = m.r1 AND p.g = m.g1 AND p.b = m.b1""", X.PX_SQL, X.FLAT_SQL)
def recolour_by_map(spark, d):
    p = X.flat(_px(spark, d))
    return palette_ops.recoloured(p, palette_ops.colour_map(p, 0, 1))


_SHIFTED = "sh AS (SELECT frame, x + 2 AS x, y - 1 AS y, r, g, b, a FROM px)"
_SAME = "CASE WHEN coalesce(pa, 0) >= 128 AND coalesce(qa, 0) >= 128 THEN abs(pr - coalesce(qr, 0)) + abs(pg - coalesce(qg, 0)) + abs(pb - coalesce(qb, 0)) <= 30 ELSE coalesce(pa, 0) < 128 AND coalesce(qa, 0) < 128 END"
_COSTS = f"""costs AS (SELECT f, dx, dy, sum(CASE WHEN {_SAME} THEN 0 ELSE 1 END)::DOUBLE / count(*) AS miss FROM (
  SELECT p.frame AS f, dx, dy, p.r AS pr, p.g AS pg, p.b AS pb, p.a AS pa, q.r AS qr, q.g AS qg, q.b AS qb, q.a AS qa FROM (SELECT * FROM px) p
  CROSS JOIN (SELECT CAST(unnest(generate_series(-4, 4)) AS INT) AS dx) CROSS JOIN (SELECT CAST(unnest(generate_series(-4, 4)) AS INT) AS dy) LEFT JOIN sh q ON q.frame = p.frame AND q.x = p.x - dx AND q.y = p.y - dy) WHERE pa >= 128 OR coalesce(qa, 0) >= 128 GROUP BY f, dx, dy)"""


@query("j10_best_shift", "SELECT f, f AS g, dx, dy, miss FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY miss, dy, dx) AS k FROM costs) WHERE k = 1", X.PX_SQL, _SHIFTED, _COSTS)
def best_shift(spark, d):
    p = _px(spark, d)
    pairs = p.select(C("frame").alias("f")).distinct().select("f", C("f").alias("g"), F.lit(0).alias("sx"), F.lit(0).alias("sy"))
    return alignment.best_shift(p, p.withColumns({"x": C("x") + 2, "y": C("y") - 1}), pairs)


@query("j11_shift_starts", "SELECT f.frame AS f, g.frame AS g, (f.cx + f.cw // 2) - (g.cx + g.cw // 2) AS sx, (f.cy + f.ch) - (g.cy + g.ch) AS sy FROM crops f JOIN crops g ON g.frame = f.frame + 1", X.PX_SQL, CROPS_SQL)
def starts(spark, d):
    c = _crops(_px(spark, d))
    pairs = c.select(C("frame").alias("f")).join(c.select((C("frame") - 1).alias("f"), C("frame").alias("g")), "f")
    return alignment.starts(pairs, c)


def _shifts(p):
    f = p.select(C("frame").alias("f")).distinct()
    return f.select("f", (C("f") + 1).alias("g"), F.lit(1).alias("dx"), F.lit(-1).alias("dy"))


_TP = """tp AS (SELECT p.frame, p.x, p.y, p.r AS pr, p.g AS pg, p.b AS pb, p.a AS pa, coalesce(s.r, 0) AS qr, coalesce(s.g, 0) AS qg, coalesce(s.b, 0) AS qb, coalesce(s.a, 0) AS qa, coalesce(e.r, 0) AS er, coalesce(e.g, 0) AS eg, coalesce(e.b, 0) AS eb, coalesce(e.a, 0) AS ea, m.frame IS NOT NULL AS i
  FROM flat p LEFT JOIN flat s ON s.frame = p.frame + 1 AND s.x = p.x - 1 AND s.y = p.y + 1 LEFT JOIN alt e ON e.frame = p.frame + 1 AND e.x = p.x - 1 AND e.y = p.y + 1 LEFT JOIN mask m ON m.frame = p.frame AND m.x = p.x AND m.y = p.y)"""


@query("j12_transplant", f"SELECT frame, x, y, CASE WHEN t THEN er ELSE pr END AS r, CASE WHEN t THEN eg ELSE pg END AS g, CASE WHEN t THEN eb ELSE pb END AS b, CASE WHEN t THEN ea ELSE pa END AS a, CASE WHEN t THEN 'taken' WHEN i THEN 'kept' END AS state FROM (SELECT *, i AND {_SAME} AS t FROM tp)", X.PX_SQL, X.ALT_SQL, X.FLAT_SQL, MASK_SQL, _TP)
def transplant(spark, d):
    m = _mask(spark, d)[1]
    p = _px(spark, d)
    return alignment.transplant(X.flat(p), X.alt(p), m, _shifts(p))


_DONOR = "(em.frame IS NOT NULL)"
_GF = """gf AS (SELECT p.frame, p.x, p.y, p.r AS pr, p.g AS pg, p.b AS pb, p.a AS pa, coalesce(s.r, 0) AS qr, coalesce(s.g, 0) AS qg, coalesce(s.b, 0) AS qb, coalesce(s.a, 0) AS qa, e.r AS er, e.g AS eg, e.b AS eb, e.a AS ea, m.frame IS NOT NULL AS i, em.frame IS NOT NULL AND e.frame IS NOT NULL AS has
  FROM flat p LEFT JOIN flat s ON s.frame = p.frame + 1 AND s.x = p.x - 1 AND s.y = p.y + 1 LEFT JOIN alt e ON e.frame = p.frame + 1 AND e.x = p.x - 1 AND e.y = p.y + 1 LEFT JOIN mask em ON em.frame = p.frame + 1 AND em.x = p.x - 1 AND em.y = p.y + 1 LEFT JOIN mask m ON m.frame = p.frame AND m.x = p.x AND m.y = p.y)"""


@query("j13_graft", f"SELECT frame, x, y, CASE WHEN t THEN er ELSE pr END AS r, CASE WHEN t THEN eg ELSE pg END AS g, CASE WHEN t THEN eb ELSE pb END AS b, CASE WHEN t THEN ea ELSE pa END AS a, t AS grafted FROM (SELECT *, has AND i AND {_SAME} AND (er <> qr OR eg <> qg OR eb <> qb OR ea <> qa) AS t FROM gf)", X.PX_SQL, X.ALT_SQL, X.FLAT_SQL, MASK_SQL, _GF)
def graft(spark, d):
    m = _mask(spark, d)[1]
    p = _px(spark, d)
    return alignment.graft(X.flat(p), X.alt(p), m, _shifts(p))


@query("j14_stamp_figure", "SELECT frame, x, y, CASE WHEN has THEN er WHEN i THEN 0 ELSE pr END AS r, CASE WHEN has THEN eg WHEN i THEN 0 ELSE pg END AS g, CASE WHEN has THEN eb WHEN i THEN 0 ELSE pb END AS b, CASE WHEN has THEN ea WHEN i THEN 0 ELSE pa END AS a, has AS grafted FROM gf", X.PX_SQL, X.ALT_SQL, X.FLAT_SQL, MASK_SQL, _GF)
def stamp_figure(spark, d):
    m = _mask(spark, d)[1]
    p = _px(spark, d)
    return alignment.graft(X.flat(p), X.alt(p), m, _shifts(p), stamp=True)


@query("j16_hold", """SELECT h.f AS frame, p.x + h.dx AS x, p.y + h.dy AS y, r, g, b, a FROM px p JOIN (
  SELECT a.frame AS f, b.frame AS src, a.x - b.x AS dx, a.z - b.z AS dy FROM fs a JOIN fs b ON b.frame = a.frame + 1 WHERE a.frame >= 0) h ON p.frame = h.src""", X.PX_SQL, X.STEPS_SQL, "fs AS (SELECT frame, x, z FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY anim, step) AS k FROM steps) WHERE k = 1)")
def hold(spark, d):
    s = X.steps(spark, d)
    return alignment.hold(s, _px(spark, d), s.where("frame >= 0").select("frame", (C("frame") + 1).alias("src")).distinct())


@query("j17_diff_masks", "SELECT p.frame, p.x, p.y FROM px p LEFT JOIN alt q ON q.frame = p.frame AND q.x = p.x - p.frame % 2 AND q.y = p.y WHERE q.frame IS NULL OR p.r <> q.r OR p.g <> q.g OR p.b <> q.b OR p.a <> q.a", X.PX_SQL, X.ALT_SQL)
def diff_masks(spark, d):
    p = _px(spark, d)
    anchors = p.select("frame").distinct().select("frame", (C("frame") % 2).cast("int").alias("dx"), F.lit(0).alias("dy"))
    return masks.diff_mask(p, X.alt(p), anchors)


@query("j20_silhouettes", "SELECT frame, sum(CASE WHEN (coalesce(p.a, 0) >= 128) = (coalesce(q.a, 0) >= 128) THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*) AS agreement FROM px p FULL JOIN alt q USING (frame, x, y) GROUP BY frame", X.PX_SQL, X.ALT_SQL)
def silhouettes(spark, d):
    from ..operators import votes

    p = _px(spark, d)
    return votes.silhouette(p, X.alt(p))


@query("j21_stamp_places", """SELECT p.frame, p.x, p.y, coalesce(t.r, p.r) AS r, coalesce(t.g, p.g) AS g, coalesce(t.b, p.b) AS b, coalesce(t.a, p.a) AS a FROM px p LEFT JOIN (
  SELECT * FROM (SELECT s.x - 2 + q.px AS x, s.y - 3 + q.py AS y, r, g, b, a, row_number() OVER (PARTITION BY s.x - 2 + q.px, s.y - 3 + q.py ORDER BY q.k DESC) AS n FROM (SELECT * FROM px WHERE frame = 0 AND x BETWEEN 2 AND 6 AND y BETWEEN 3 AND 6 AND a > 0) s CROSS JOIN (VALUES (0, 0, 0), (1, 3, 9), (2, 8, 9), (3, 12, 9)) q(k, px, py)) WHERE n = 1) t USING (x, y)""", X.PX_SQL)
def stamp_places(spark, d):
    p = _px(spark, d)
    return layout.stamp(p, p.where("frame = 0").drop("frame"), (2, 3, 5, 4), [(0, 0), *layout.repeat_places(3, 3, 12, 9)])


@query("j22_lock_regions", "SELECT p.frame, p.x, p.y, CASE WHEN k THEN q.r ELSE p.r END AS r, CASE WHEN k THEN q.g ELSE p.g END AS g, CASE WHEN k THEN q.b ELSE p.b END AS b, CASE WHEN k THEN q.a ELSE p.a END AS a FROM (SELECT *, (x BETWEEN 1 AND 4 AND y BETWEEN 2 AND 6) OR (x BETWEEN 9 AND 15 AND y < 3) AS k FROM px) p JOIN alt q USING (frame, x, y)", X.PX_SQL, X.ALT_SQL)
def lock_regions(spark, d):
    p = _px(spark, d)
    return masks.lock(p, X.alt(p), [(1, 2, 4, 5), (9, 0, 7, 3)])
