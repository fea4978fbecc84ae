"""Queries on whole frames: layout, compositing, recolouring, lifting, animations, gathering, and composite pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels as P
from ..operators import alignment, animations, layout, masks, palette_ops, pipelines, samples
from ..operators.common import C, RGB, RGBA
from . import fixtures as X
from .queries_pixels import CROPS_SQL, MASK_SQL, _crops, _mask, near_sql

QUERIES: dict = {}


def query(name, sql, *ctes):
    def put(f):
        QUERIES[name] = (f, f"WITH RECURSIVE {', '.join(ctes)} {sql}" if sql and ctes else sql)
        return f

    return put


# Recolouring ------------------------------------------------------------------------------------------------------------
_LUM = "0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b"
_PICK = f"pick AS (SELECT px.*, {_LUM} AS l FROM px JOIN mask USING (frame, x, y)), sorted AS (SELECT frame, l, row_number() OVER (PARTITION BY frame ORDER BY l) - 1 AS k, count(*) OVER (PARTITION BY frame) AS n FROM pick), cuts AS (SELECT frame, max(l) FILTER (k = least(n // 3, n - 1)) AS c1, max(l) FILTER (k = least(2 * n // 3, n - 1)) AS c2 FROM sorted GROUP BY frame)"
_BIN = "CASE WHEN m.frame IS NULL THEN NULL WHEN NOT l > c1 THEN 0 WHEN NOT l > c2 THEN 1 ELSE 2 END"
_RAMP = [(24, 28, 33), (123, 121, 123), (231, 227, 231)]
_PAINTED = f"painted AS (SELECT p.*, CAST({_BIN} AS INT) AS bin FROM (SELECT *, {_LUM} AS l FROM px) p LEFT JOIN mask m USING (frame, x, y) LEFT JOIN cuts USING (frame))"


def _case(i):
    return " ".join(f"WHEN bin = {k} THEN {c[i]}" for k, c in enumerate(_RAMP))


@query("a18_quantile_cuts", "SELECT frame, [c1, c2] AS cuts FROM cuts", X.PX_SQL, MASK_SQL, _PICK)
def quantile_cuts(spark, d):
    p, m = _mask(spark, d)
    picked = p.join(m.select("frame", "x", "y"), ["frame", "x", "y"]).select("frame", P.luminance(C("r"), C("g"), C("b")).alias("l"))
    return masks.quantile_cuts(picked, 3)


@query("a19_recolour", f"SELECT frame, x, y, CASE {_case(0)} ELSE r END AS r, CASE {_case(1)} ELSE g END AS g, CASE {_case(2)} ELSE b END AS b, a, bin FROM painted", X.PX_SQL, MASK_SQL, _PICK, _PAINTED)
def recolour(spark, d):
    p, m = _mask(spark, d)
    return masks.recolour_region(p, m, _RAMP)


@query("a19_recolour_counts", "SELECT frame, count(*) AS painted_px, count(*) FILTER (bin = 0) AS bin0, count(*) FILTER (bin = 1) AS bin1, count(*) FILTER (bin = 2) AS bin2 FROM painted WHERE bin IS NOT NULL GROUP BY frame", X.PX_SQL, MASK_SQL, _PICK, _PAINTED)
def recolour_counts(spark, d):
    return masks.bin_counts(recolour(spark, d), 3)


@query("a16_leftover", """SELECT frame, CAST(round_even(sum((CASE WHEN p.a >= 128 AND q.a >= 128 THEN abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b) <= 30 ELSE p.a < 128 AND q.a < 128 END)::INT) * 100.0::DOUBLE / count(*), 0) AS INT) AS leftover
  FROM (SELECT m.* FROM mask m JOIN (SELECT frame, min(y) AS y0, max(y) AS y1 FROM mask GROUP BY frame) USING (frame) WHERE m.y >= y0 + floor((y1 - y0 + 1) * 0.3)) m JOIN alt p USING (frame, x, y) JOIN px q USING (frame, x, y) GROUP BY frame""", X.PX_SQL, X.ALT_SQL, MASK_SQL)
def leftover(spark, d):
    p, m = _mask(spark, d)
    return masks.leftover(X.alt(p), p, m.select("frame", "x", "y"))


@query("a20_conform_report", """SELECT frame, count(DISTINCT CASE WHEN NOT o THEN r * 65536 + g * 256 + b END) AS colors_in, count(DISTINCT CASE WHEN NOT o THEN nr * 65536 + ng * 256 + nb END) AS colors_out, sum((NOT o AND (r <> nr OR g <> ng OR b <> nb))::INT)::BIGINT AS recolored, sum(((o AND a <> 0) OR (NOT o AND a <> 255))::INT)::BIGINT AS semi_alpha_flattened
  FROM (SELECT n.*, a < 128 AS o, CASE WHEN n.pr = 0 AND n.pg = 0 AND n.pb = 0 THEN s.pr ELSE n.pr END AS nr, CASE WHEN n.pr = 0 AND n.pg = 0 AND n.pb = 0 THEN s.pg ELSE n.pg END AS ng, CASE WHEN n.pr = 0 AND n.pg = 0 AND n.pb = 0 THEN s.pb ELSE n.pb END AS nb FROM near n JOIN (SELECT frame, x, y, pr, pg, pb FROM second) s USING (frame, x, y)) GROUP BY frame""",
  X.PX_SQL, "soft AS (SELECT frame, x, y, r, g, b, CASE WHEN a = 0 THEN (x * 9) % 140 ELSE 255 - y END AS a FROM px)", X.PALETTE_SQL, near_sql("soft"), near_sql("soft", where="NOT (pr = 0 AND pg = 0 AND pb = 0)", name="second"))
def conform_report(spark, d):
    p = X.px(spark, d).withColumn("a", F.when(C("a") == 0, C("x") * 9 % 140).otherwise(255 - C("y")))
    return palette_ops.conform_report(palette_ops.conform(p, X.palette(spark), key=(0, 0, 0)))


# Geometry ---------------------------------------------------------------------------------------------------------------
_SMALL = "sm AS (SELECT * FROM px)"


@query("g01_upscale", "SELECT frame, x * 3 + dx AS x, y * 3 + dy AS y, r, g, b, a FROM sm CROSS JOIN (SELECT CAST(unnest(generate_series(0, 2)) AS INT) AS dx) CROSS JOIN (SELECT CAST(unnest(generate_series(0, 2)) AS INT) AS dy)", X.PX_SQL, _SMALL)
def upscale(spark, d):
    return layout.upscale(X.px(spark, d), 3)


_FR = "fr AS (SELECT frame // 6 AS sheet, frame AS ord, CAST(10 + frame % 6 AS INT) AS w, CAST(12 + frame * 7 % 5 AS INT) AS h FROM px GROUP BY frame)"
_LAY = """lay AS (SELECT *, least(row_number() OVER (PARTITION BY sheet ORDER BY ord) - 1, 1000000) AS k, count(*) OVER (PARTITION BY sheet) AS n FROM fr),
lay2 AS (SELECT *, k // ceil(n / 2.0)::INT AS row FROM lay),
lay3 AS (SELECT *, coalesce(sum(w + 6) OVER (PARTITION BY sheet, row ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft, max(h) OVER (PARTITION BY sheet, row) AS row_h, sum(w) OVER (PARTITION BY sheet, row) + 6 * (count(*) OVER (PARTITION BY sheet, row) - 1) AS row_w FROM lay2),
rows_ AS (SELECT sheet, row, coalesce(sum(row_h + 6) OVER (PARTITION BY sheet ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top, sum(row_h) OVER (PARTITION BY sheet) AS all_h FROM (SELECT DISTINCT sheet, row, row_h FROM lay3)),
man AS (SELECT sheet, ord, CAST((200 - max(row_w) OVER (PARTITION BY sheet) * 3) // 2 + lft * 3 AS INT) AS x, CAST((220 - (all_h + 6) * 3) // 2 + (top + row_h - h) * 3 AS INT) AS y, w, h, CAST(200 AS INT) AS canvas_w, CAST(220 AS INT) AS canvas_h FROM lay3 JOIN rows_ USING (sheet, row))"""


def _frames(p):
    f = C("frame")
    return p.select("frame").distinct().select(F.floor(f / 6).alias("sheet"), f.alias("ord"), (10 + f % 6).cast("int").alias("w"), (12 + f * 7 % 5).cast("int").alias("h"))


@query("g02_sheet_layout", "SELECT * FROM man", X.PX_SQL, _FR, _LAY)
def sheet_layout(spark, d):
    return layout.sheet_manifest(_frames(X.px(spark, d)), 3, 6, 2, (200, 220))


@query("g02_sheet_pixels", """SELECT g.sheet AS frame, CAST(g.x AS INT) AS x, CAST(g.y AS INT) AS y, CASE WHEN q.a > 0 THEN q.r ELSE 128 END AS r, CASE WHEN q.a > 0 THEN q.g ELSE 128 END AS g, CASE WHEN q.a > 0 THEN q.b ELSE 128 END AS b, coalesce(CASE WHEN q.a > 0 THEN q.a END, 255) AS a
  FROM (SELECT sheet, x, y FROM (SELECT DISTINCT sheet FROM man) CROSS JOIN (SELECT unnest(generate_series(0, 199)) AS x) CROSS JOIN (SELECT unnest(generate_series(0, 219)) AS y)) g
  LEFT JOIN man m ON m.sheet = g.sheet AND g.x >= m.x AND g.x < m.x + m.w * 3 AND g.y >= m.y AND g.y < m.y + m.h * 3 LEFT JOIN px q ON q.frame = m.ord AND q.x = (g.x - m.x) // 3 AND q.y = (g.y - m.y) // 3""", X.PX_SQL, _FR, _LAY)
def sheet_pixels(spark, d):
    p = X.px(spark, d)
    m = layout.sheet_manifest(_frames(X.px(spark, d)), 3, 6, 2, (200, 220))
    inside = p.join(m.select(C("ord").alias("frame"), "w", "h"), "frame").where("x < w and y < h").select("frame", "x", "y", *RGBA)
    return layout.sheet(inside, m, 3, (128, 128, 128))


@query("g03_unsheet", "SELECT s.sheet * 16 + m.ord AS frame, s.x - m.x AS x, s.y - m.y AS y, r, g, b, a FROM (SELECT frame // 16 AS sheet, CAST((frame % 4) * 16 + x AS INT) AS x, CAST((frame % 16 // 4) * 16 + y AS INT) AS y, r, g, b, a FROM px) s JOIN (VALUES (7, 3, 5, 6, 7), (8, 30, 20, 5, 9)) m(ord, x, y, w, h) ON s.x >= m.x AND s.x < m.x + m.w * 2 AND s.y >= m.y AND s.y < m.y + m.h * 2", X.PX_SQL)
def unsheet(spark, d):
    p, k = X.px(spark, d), C("frame") % 16
    s = p.select(F.floor(C("frame") / 16).alias("frame"), (k % 4 * 16 + C("x")).cast("int").alias("x"), (F.floor(k / 4) * 16 + C("y")).cast("int").alias("y"), *RGBA)
    m = spark.createDataFrame([(7, 3, 5, 6, 7), (8, 30, 20, 5, 9)], "ord int, x int, y int, w int, h int")
    m = s.select(C("frame").alias("sheet")).distinct().crossJoin(F.broadcast(m)).withColumn("ord", (C("sheet") * 16 + C("ord")).cast("int"))
    return layout.unsheet(s, m, 2)


@query("g04_refit", "SELECT frame, x + (11 - w) // 2 AS x, y + (21 - h) // 2 AS y, r, g, b, a FROM px JOIN (SELECT frame, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY frame) USING (frame) WHERE x + (11 - w) // 2 BETWEEN 0 AND 10 AND y + (21 - h) // 2 BETWEEN 0 AND 20", X.PX_SQL)
def refit(spark, d):
    return layout.refit(X.px(spark, d), 11, 21)


_CROP = "crop AS (SELECT frame, x - cx AS x, y - cy AS y, r, g, b, a FROM px JOIN crops USING (frame) WHERE x >= cx AND x < cx + cw AND y >= cy AND y < cy + ch)"


@query("g06_pad", "SELECT frame, x + 1 AS x, y + 2 AS y, r, g, b, a FROM px", X.PX_SQL)
def pad(spark, d):
    return layout.pad(X.px(spark, d), "1,2,3,4")


@query("g07_crop", "SELECT * FROM crop", X.PX_SQL, CROPS_SQL, _CROP)
def crop(spark, d):
    p = X.px(spark, d)
    return layout.crop(p, _crops(p))


@query("a15_opaque_boxes", "SELECT frame, min(x) AS cx, min(y) AS cy, max(x) - min(x) + 1 AS cw, max(y) - min(y) + 1 AS ch FROM px WHERE a >= 128 GROUP BY frame", X.PX_SQL)
def opaque_boxes(spark, d):
    return layout.boxes(X.px(spark, d))


_SHRUNK = """shr AS (SELECT frame, tx, ty, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b, CAST(a AS INT) AS a FROM (SELECT t.frame, t.tx, t.ty, total, coalesce(o, 0) AS o, m.r, m.g, m.b, m.a, row_number() OVER (PARTITION BY t.frame, t.tx, t.ty ORDER BY m.n DESC, m.f) AS k
  FROM (SELECT frame, tx, ty, count(*) AS total, count(*) FILTER (a >= 128) AS o FROM und GROUP BY ALL) t LEFT JOIN (SELECT frame, tx, ty, r, g, b, a, count(*) AS n, min(y * 65536 + x) AS f FROM und WHERE a >= 128 GROUP BY frame, tx, ty, r, g, b, a) m USING (frame, tx, ty)) WHERE k = 1 AND 2 * o >= total AND o > 0)"""
_UNDER = "und AS (SELECT f.frame, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, p.* EXCLUDE (frame) FROM (SELECT frame FROM flat GROUP BY frame HAVING count(*) = 256) f CROSS JOIN (SELECT unnest(generate_series(0, 6)) AS tx) CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS ty) JOIN flat p ON p.frame = f.frame AND p.x >= tx * 16 // 7 AND p.x < greatest((tx + 1) * 16 // 7, tx * 16 // 7 + 1) AND p.y >= ty * 16 // 5 AND p.y < greatest((ty + 1) * 16 // 5, ty * 16 // 5 + 1))"


@query("a10_majority_shrink", "SELECT frame, tx AS x, ty AS y, r, g, b, a FROM shr", X.PX_SQL, X.FLAT_SQL, _UNDER, _SHRUNK)
def shrink(spark, d):
    p = X.flat(X.px(spark, d))
    full = p.groupBy("frame").count().where("count = 256").select("frame", F.lit(16).alias("sw"), F.lit(16).alias("sh"), F.lit(7).alias("w"), F.lit(5).alias("h"))
    return layout.shrink(p, full).where("a > 0")


@query("g05_fit", None)
def fit(spark, d):
    return layout.fit(X.flat(X.px(spark, d)), 12, 10)


@query("g08_compose", """SELECT frame, x, y, (q.r * CASE WHEN q.a > 0 THEN la ELSE 0 END + s.r * (255 - CASE WHEN q.a > 0 THEN la ELSE 0 END) + 127) // 255 AS r, s.g, s.b, s.a FROM (
  SELECT p.frame, p.x, p.y, CASE WHEN t.r IS NOT NULL THEN t.r ELSE p.r END AS r, CASE WHEN t.r IS NOT NULL THEN t.g ELSE p.g END AS g, CASE WHEN t.r IS NOT NULL THEN t.b ELSE p.b END AS b, CASE WHEN t.r IS NOT NULL THEN t.a ELSE p.a END AS a FROM (
    SELECT frame, x, y, CASE WHEN x BETWEEN 3 AND 6 AND y BETWEEN 2 AND 10 THEN 18 ELSE r END AS r, CASE WHEN x BETWEEN 3 AND 6 AND y BETWEEN 2 AND 10 THEN 52 ELSE g END AS g, CASE WHEN x BETWEEN 3 AND 6 AND y BETWEEN 2 AND 10 THEN 86 ELSE b END AS b, CASE WHEN x BETWEEN 3 AND 6 AND y BETWEEN 2 AND 10 THEN 255 ELSE a END AS a FROM px) p
  LEFT JOIN (SELECT frame, x + 8 AS x, y + 1 AS y, r, g, b, a FROM px WHERE x < 4 AND y < 4 AND a > 0) t USING (frame, x, y)) s
  LEFT JOIN (SELECT x, y, r, a, 100 AS la FROM px WHERE frame = 1) q USING (x, y)""".replace("(q.r *", "(coalesce(q.r, 0) *").replace("WHEN q.a > 0", "WHEN coalesce(q.a, 0) > 0"), X.PX_SQL)
def compose(spark, d):
    p = X.px(spark, d)
    layer = p.where("frame = 1").select("x", "y", *RGB, F.when(C("a") > 0, 100).otherwise(0).alias("a"))
    ops = [{"op": "fill", "rect": [3, 2, 4, 9], "rgb": "#123456"}, {"op": "stamp", "from": "self", "rect": [0, 0, 4, 4], "at": [[8, 1]]}, {"op": "overlay", "png": "layer", "at": [0, 0]}]
    out = layout.compose(p, ops, {"self": p, "layer": layer})
    before = layout.compose(p, ops[:2], {"self": p})
    # green and blue are compared before the overlay
    return out.select("frame", "x", "y", "r", "a").join(before.select("frame", "x", "y", "g", "b"), ["frame", "x", "y"])


@query("g09_repeat_places", "SELECT CAST(k AS INT) AS k, CAST(round(3 + (40 - 3)::DOUBLE * k / 6) AS INT) AS x, CAST(5 AS INT) AS y FROM (SELECT unnest(generate_series(0, 6)) AS k)")
def repeat_places(spark, d):
    return spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(layout.repeat_places(7, 3, 40, 5))], "k int, x int, y int")


_GR = "gr(frame, l, t, r, b) AS (VALUES (1, 2, 3, 1, 0), (5, 0, 1, 0, 2), (9, 4, 0, 3, 3))"


def _grown(spark):
    return spark.createDataFrame([(1, 2, 3, 1, 0), (5, 0, 1, 0, 2), (9, 4, 0, 3, 3)], "frame int, l int, t int, r int, b int")


@query("g10_grow_frames", "SELECT p.frame, x + coalesce(l, 0) AS x, y + coalesce(t, 0) AS y, p.r, p.g, p.b, p.a FROM px p LEFT JOIN gr USING (frame)", X.PX_SQL, _GR)
def grow_frames(spark, d):
    return animations.grow_frames(X.px(spark, d), _grown(spark))


@query("g10_grow_steps", "SELECT anim, step, frame, x + coalesce(l, 0) AS x, y + coalesce(r, 0) AS y, z + coalesce(t, 0) AS z FROM steps LEFT JOIN gr USING (frame)", X.STEPS_SQL, _GR)
def grow_steps(spark, d):
    return animations.grow_steps(X.steps(spark, d).drop("last"), _grown(spark))


_PLAYED = "played AS (SELECT s.* FROM steps s JOIN lasts USING (anim) WHERE step <= last AND frame >= 0)"


@query("g11_sheet_plan", None)
def plan(spark, d):
    p = X.px(spark, d)
    first = animations.first_anim(X.steps(spark, d))
    rows = _frames(p).join(first, C("ord") == C("frame"), "left").select(F.coalesce("anim", F.lit(-1)).alias("anim"), "ord", "w", "h").collect()
    out = layout.plan([tuple(r) for r in rows], 5, 400)
    return spark.createDataFrame([(i, f, r) for i, (fs, r) in enumerate(out) for f in fs], "sheet int, frame bigint, rows int")


@query("g12_first_animation", "SELECT frame, min(anim) AS anim FROM played GROUP BY frame", X.STEPS_SQL, _PLAYED)
def first_anim(spark, d):
    return animations.first_anim(X.steps(spark, d))


@query("g14_bounce", """SELECT p.frame, p.x, p.y, coalesce(q.r, p.r) AS r, coalesce(q.g, p.g) AS g, coalesce(q.b, p.b) AS b, coalesce(q.a, p.a) AS a FROM (SELECT *, CASE WHEN x BETWEEN 2 AND 9 AND y BETWEEN 3 AND 12 THEN least(greatest(y - CAST(round(3 * sin(2 * pi() * frame / 8)) AS INT), 3), 12) ELSE y END AS sy FROM px) p LEFT JOIN px q ON q.frame = p.frame AND q.x = p.x AND q.y = p.sy""", X.PX_SQL)
def bounce(spark, d):
    return layout.bounce(X.px(spark, d), (2, 3, 8, 10), 3, 8, C("frame"))


_GRAYS = "gp AS (SELECT label, frame, x, y, v FROM gray)"


@query("a11_lift", """SELECT x, y, CAST(least(greatest(round((so - k * su)::DOUBLE / n / (1 - k)), 0), 255) AS INT) AS r, CAST(least(greatest(round((so - k * su)::DOUBLE / n / (1 - k)), 0), 255) AS INT) AS g, CAST(least(greatest(round((so - k * su)::DOUBLE / n / (1 - k)), 0), 255) AS INT) AS b, CAST(round((1 - k) * 255) AS INT) AS a
  FROM (SELECT *, least(greatest((3 * (n * suo - su * so))::DOUBLE / (3 * (n * suu - su * su)), 0), 1) AS k FROM (SELECT x, y, count(*) AS n, sum(o)::BIGINT AS so, sum(v)::BIGINT AS su, sum(v * o)::BIGINT AS suo, sum(v * v)::BIGINT AS suu FROM (SELECT x, y, v, (v * 3 + 200 + (v % 2)) // 4 AS o FROM gray WHERE (frame + x + y) % 9 > 0) GROUP BY x, y) WHERE n >= 2 AND n * suu - su * su > 0) WHERE 1 - k >= 0.08""", X.GRAY_SQL)
def lift(spark, d):
    g = X.gray(spark, d)
    as_px = lambda c: g.select("frame", "x", "y", *[c.alias(k) for k in RGB], F.lit(255).alias("a"))
    hole = (C("frame") + C("x") + C("y")) % 9 == 0
    return layout.lift(as_px(P.div(C("v") * 3 + 200 + C("v") % 2, 4)), as_px(C("v")), as_px(F.when(hole, C("v") + 1).otherwise(C("v"))))


@query("a23_medoid", None)
def medoid(spark, d):
    g = X.gray(spark, d)
    p = g.select("frame", "x", "y", C("v").alias("r"), C("v").alias("g"), C("v").alias("b"), F.lit(255).alias("a"))
    seq = g.select(C("label").alias("anim"), C("frame").alias("step"), "frame").distinct()
    return alignment.medoids(p, seq)


@query("a22_median_edges", "SELECT frame, max(r) FILTER (k = n // 2) AS median FROM (SELECT frame, r, row_number() OVER (PARTITION BY frame ORDER BY r) - 1 AS k, count(*) OVER (PARTITION BY frame) AS n FROM px) GROUP BY frame", X.PX_SQL)
def median_edges(spark, d):
    return pipelines.upper_median(X.px(spark, d), "frame", "r")


# Animations and gathering -----------------------------------------------------------------------------------------------
@query("s09_played_steps", "SELECT anim, step, frame, x, y, z FROM played", X.STEPS_SQL, _PLAYED)
def played(spark, d):
    return animations.played(X.steps(spark, d)).drop("last")


@query("s08_anchors", "SELECT frame, CAST(len(anchors) AS INT) AS n, anchors[1][1] AS x0, anchors[1][2] AS y0, anchors[-1][1] AS x1, anchors[-1][2] AS y1 FROM (SELECT frame, list([x, y] ORDER BY anim, step) AS anchors FROM (SELECT DISTINCT ON (frame, x, y) frame, x, y, anim, step FROM played ORDER BY frame, x, y, anim, step) GROUP BY frame)", X.STEPS_SQL, _PLAYED)
def anchors(spark, d):
    a = animations.anchors(X.steps(spark, d))
    at = lambda i, k: F.element_at(F.element_at("anchors", i), k)
    return a.select("frame", F.size("anchors").alias("n"), at(1, 1).alias("x0"), at(1, 2).alias("y0"), at(-1, 1).alias("x1"), at(-1, 2).alias("y1"))


@query("s11_animation_summary", "SELECT anim, count(*) AS steps, count(DISTINCT frame) AS frames, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM played GROUP BY anim", X.STEPS_SQL, _PLAYED)
def summary(spark, d):
    return animations.summary(X.steps(spark, d))


@query("s18_paired_frames", "SELECT f, g FROM (SELECT a.frame AS f, b.frame AS g, row_number() OVER (PARTITION BY a.frame ORDER BY a.anim, a.step, b.frame) AS k FROM steps a JOIN (SELECT anim, step, (frame + 3) % 40 AS frame FROM steps WHERE frame >= 0) b USING (anim, step) WHERE a.frame >= 0) WHERE k = 1", X.STEPS_SQL)
def paired(spark, d):
    s = X.steps(spark, d)
    return animations.paired(s, s.where("frame >= 0").withColumn("frame", (C("frame") + 3) % 40))


@query("f09_frame_selection", "SELECT f.frame, c.frame IS NOT NULL AS has_crop FROM (SELECT DISTINCT CAST(frame AS BIGINT) AS frame FROM played WHERE anim = 7) f LEFT JOIN crops c USING (frame)", X.PX_SQL, CROPS_SQL, X.STEPS_SQL, _PLAYED)
def selection(spark, d):
    return animations.wanted(_crops(X.px(spark, d)), X.steps(spark, d), "anim:7")


@query("f11_latest_that_differs", "SELECT frame, CASE WHEN frame % 3 = 0 THEN 'b' ELSE 'a' END AS run FROM (SELECT DISTINCT frame FROM px) WHERE frame % 3 = 0 OR frame % 5 <> 0", X.PX_SQL)
def gathered(spark, d):
    p = X.px(spark, d)
    stock = animations.frame_hash(p)
    edited = p.withColumn("r", F.when((C("x") == 0) & (C("y") == 0), C("r") + 1).otherwise(C("r")))
    a = animations.frame_hash(p.where("frame % 5 = 0").unionByName(edited.where("frame % 5 <> 0"))).select("frame", F.lit("a").alias("run"), F.lit(1).alias("rank"), "content")
    b = animations.frame_hash(edited.where("frame % 3 = 0").unionByName(p.where("frame % 3 <> 0"))).select("frame", F.lit("b").alias("run"), F.lit(2).alias("rank"), "content")
    return animations.gathered(a.unionByName(b), stock)


@query("k14_export_with_fallback", "SELECT frame, 'f' || frame AS rel_path, CASE WHEN frame % 2 = 0 THEN 'done' ELSE 'stock' END AS content, frame % 2 = 0 AS finished FROM (SELECT DISTINCT frame FROM px)", X.PX_SQL)
def export(spark, d):
    f = X.px(spark, d).select("frame").distinct()
    return animations.exported(f.select("frame", F.concat(F.lit("f"), "frame").alias("rel_path")), f.where("frame % 2 = 0").select("frame", F.lit("done").alias("content")), f.select("frame", F.lit("stock").alias("content")))


@query("a29_status_counts", "SELECT run, status, n, CAST(len(reps) AS INT) AS reps FROM (SELECT o_orderstatus AS run, CASE WHEN o_orderkey % 5 = 0 THEN 'refused' WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n, list(o_orderkey) AS reps FROM orders GROUP BY ALL)")
def status_counts(spark, d):
    o = X.table(spark, d, "orders")
    s = o.select(C("o_orderstatus").alias("run"), C("o_orderkey").alias("rep"), F.when(C("o_orderkey") % 5 == 0, "refused").when(C("o_orderkey") % 7 == 0, "failed").otherwise("ok").alias("status"))
    return animations.status_counts(s).select("run", "status", "n", F.size("reps").alias("reps"))


@query("k11_gif_indices", "SELECT frame, x, y, CAST(CASE WHEN a < 128 THEN 0 WHEN k <= 255 THEN k ELSE 1 END AS INT) AS idx FROM px JOIN (SELECT r, g, b, row_number() OVER (ORDER BY r, g, b) AS k FROM (SELECT DISTINCT r, g, b FROM px WHERE a >= 128)) USING (r, g, b) UNION ALL SELECT frame, x, y, 0 FROM px ANTI JOIN (SELECT DISTINCT r, g, b FROM px WHERE a >= 128) USING (r, g, b)", X.PX_SQL)
def gif_indices(spark, d):
    return pipelines.gif_indices(X.px(spark, d))


@query("k12_strip_layout", "SELECT frame, (row_number() OVER (ORDER BY frame) - 1) * cw + (cw - w) // 2 AS x, ch - h AS y, cw * count(*) OVER () AS canvas_w, ch AS canvas_h FROM (SELECT frame, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY frame) CROSS JOIN (SELECT max(x) + 1 AS cw, max(y) + 1 AS ch FROM px)", X.PX_SQL)
def strip(spark, d):
    return animations.strip(layout.sizes(X.px(spark, d)))


@query("k17_colour_census", "SELECT r, g, b, n FROM (SELECT r, g, b, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, r, g, b) AS k FROM px WHERE a >= 128 GROUP BY r, g, b) WHERE k <= 256", X.PX_SQL)
def census(spark, d):
    return pipelines.colour_census(X.px(spark, d))


@query("a07_colour_key_guess", """SELECT frame, CASE WHEN cyan > black THEN 2047 WHEN black > 0 THEN 0 END AS key FROM (SELECT frame, sum(CASE WHEN w = 0 THEN t ELSE 0 END) AS black, sum(CASE WHEN w = 2047 THEN t ELSE 0 END) AS cyan FROM (
  SELECT frame, CASE WHEN (x * 5 + y * 3 + frame) % 4 = 0 THEN 0 WHEN (x + y * 7 + frame) % 3 = 0 THEN 2047 ELSE 99 END AS w, (x = 0)::INT + (x = max(x) OVER f)::INT + (y = 0)::INT + (y = max(y) OVER f)::INT AS t FROM px WINDOW f AS (PARTITION BY frame)) GROUP BY frame)""", X.PX_SQL)
def key_guess(spark, d):
    w = F.when((C("x") * 5 + C("y") * 3 + C("frame")) % 4 == 0, 0).when((C("x") + C("y") * 7 + C("frame")) % 3 == 0, 2047).otherwise(99)
    return pipelines.guessed_keys(X.px(spark, d).select("frame", "x", "y", w.alias("w")))


@query("a32_coverage", "SELECT frame, on_, n, on_ * 100.0::DOUBLE / n AS percent FROM (SELECT frame, count(*) FILTER (a >= 128) AS on_, count(*) AS n FROM px GROUP BY frame)", X.PX_SQL)
def coverage(spark, d):
    return X.px(spark, d).groupBy("frame").agg(F.count(F.when(P.opaque(), 1)).alias("on_"), F.count("*").alias("n")).select("frame", "on_", "n", (C("on_") * F.lit(100.0) / C("n")).alias("percent"))


# Pipelines --------------------------------------------------------------------------------------------------------------
@query("x01_downscale", None)
def downscale(spark, d):
    p = X.flat(X.px(spark, d))
    # sheets of twelve frames
    frames = p.groupBy("frame").count().where("count = 256").select(F.floor(C("frame") / 12).alias("sheet"), C("frame").alias("ord"), F.lit(16).alias("w"), F.lit(16).alias("h"))
    full = p.join(frames.select(C("ord").alias("frame")), "frame", "left_semi")
    m = layout.sheet_manifest(frames, 3, 6, 1)
    return pipelines.downscale(layout.sheet(full, m, 3, X.BG), m, 3, X.palette(spark), X.BG, tol=24, resolve=True, grain=True, despeckle=True)


@query("x02_conform", None)
def conform(spark, d):
    return layout.refit(palette_ops.conform(X.px(spark, d), X.palette(spark)).select("frame", "x", "y", *RGBA), 20, 12)


@query("x08_pixelize", None)
def pixelize(spark, d):
    return pipelines.pixelize(X.px(spark, d), 12, 12, 6)


@query("x10_smooth", None)
def smooth(spark, d):
    p = X.flat(X.px(spark, d))
    s = X.steps(spark, d).select("anim", "step", "frame", "x", "y", "z", "last")
    return pipelines.smooth(p, X.alt(p), layout.boxes(p), s, most=None)


# Samples ----------------------------------------------------------------------------------------------------------------
_EDGE = "edge AS (SELECT DISTINCT m.frame, m.x, m.y FROM fg m CROSS JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dx, dy) LEFT JOIN fg q ON q.frame = m.frame AND q.x = m.x + o.dx AND q.y = m.y + o.dy WHERE q.frame IS NULL)"


def _foam(c, v):
    return f"CASE WHEN e.frame IS NOT NULL AND a >= 128 THEN round_even({c} + ({v} - {c}) * (0.45::DOUBLE + 0.35::DOUBLE * greatest(r, g, b) / 255.0::DOUBLE), 0)::INT ELSE {c} END AS {c}"


@query("p16_foam_rim", f"SELECT p.frame, p.x, p.y, {_foam('r', 235)}, {_foam('g', 248)}, {_foam('b', 255)}, a FROM px p LEFT JOIN edge e USING (frame, x, y)", X.PX_SQL, X.FG_SQL, _EDGE)
def foam_rim(spark, d):
    p = X.px(spark, d)
    return samples.foam_rim(p, X.fg(p))


@query("g17_foam_droplets", None)
def droplets(spark, d):
    return samples.droplets(X.fg(X.px(spark, d)), 7)


@query("j19_keep_effects", """SELECT p.frame, p.x, p.y, coalesce(s.r, p.r) AS r, coalesce(s.g, p.g) AS g, coalesce(s.b, p.b) AS b, coalesce(s.a, p.a) AS a FROM alt p LEFT JOIN (
  SELECT DISTINCT h.* FROM hit h JOIN hit q ON q.frame = h.frame AND abs(q.x - h.x) + abs(q.y - h.y) = 1) s USING (frame, x, y)""", X.PX_SQL, X.ALT_SQL, "hit AS (SELECT * FROM px WHERE a >= 128 AND b >= 128)")
def keep_effects(spark, d):
    p = X.px(spark, d)
    return samples.keep_effects(X.alt(p), p, C("s_b") >= 128)


@query("j19_backfill", """SELECT p.frame, p.x, p.y, CASE WHEN h THEN s.r ELSE p.r END AS r, CASE WHEN h THEN s.g ELSE p.g END AS g, CASE WHEN h THEN s.b ELSE p.b END AS b, CASE WHEN h THEN s.a ELSE p.a END AS a FROM (
  SELECT p.*, p.a < 128 AND (SELECT count(*) FROM alt q WHERE q.frame = p.frame AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND (q.x <> p.x OR q.y <> p.y) AND q.a >= 128) >= 3 AND s.a >= 128 AS h FROM alt p JOIN px s USING (frame, x, y)) p JOIN px s USING (frame, x, y)""", X.PX_SQL, X.ALT_SQL)
def backfill(spark, d):
    p = X.px(spark, d)
    return samples.backfill(X.alt(p), p)


@query("k19_bake", "SELECT * FROM alt WHERE frame % 3 = 0 UNION ALL SELECT * FROM flat WHERE frame % 3 = 1 UNION ALL SELECT frame, x, y, r, g, b, a FROM px WHERE frame % 3 = 2", X.PX_SQL, X.ALT_SQL, X.FLAT_SQL)
def bake(spark, d):
    p = X.px(spark, d)
    return samples.baked(p, X.alt(p).where("frame % 3 = 0"), X.flat(p).where("frame % 3 < 2"))


@query("k21_enlarged_masks", "SELECT p.frame, p.x * 2 + dx AS x, p.y * 2 + dy AS y, CASE WHEN m.frame IS NULL THEN 0 ELSE 255 END AS r, CASE WHEN m.frame IS NULL THEN 0 ELSE 255 END AS g, CASE WHEN m.frame IS NULL THEN 0 ELSE 255 END AS b, 255 AS a FROM px p LEFT JOIN fg m USING (frame, x, y) CROSS JOIN (VALUES (0), (1)) i(dx) CROSS JOIN (VALUES (0), (1)) j(dy)", X.PX_SQL, X.FG_SQL)
def enlarged_masks(spark, d):
    p = X.px(spark, d)
    return samples.enlarged(p, X.fg(p), 2)[1]


@query("j18_difference_mask", "SELECT p.frame, p.x, p.y FROM flat p LEFT JOIN alt q ON q.frame = p.frame + 1 AND q.x = p.x - 1 AND q.y = p.y + 1 WHERE p.a >= 128 AND (coalesce(q.a, 0) < 128 OR abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b) > 30)", X.PX_SQL, X.ALT_SQL, X.FLAT_SQL)
def difference_mask(spark, d):
    p = X.px(spark, d)
    shifts = p.select(C("frame").alias("f")).distinct().select("f", (C("f") + 1).alias("g"), F.lit(1).alias("dx"), F.lit(-1).alias("dy"))
    return samples.difference_mask(X.flat(p), X.alt(p), shifts)


@query("c08_garment", None)
def garment(spark, d):
    return samples.garment(X.flat(X.px(spark, d)), "dark", (0.2, 0.9), 4)


@query("c09_painted", None)
def painted(spark, d):
    p = X.px(spark, d)
    return samples.painted(p, X.fg(p), [(20, 10, 40), (90, 60, 120), (220, 200, 240)], (0, 0, 0))


@query("j15_graft_beside_effects", None)
def graft_beside(spark, d):
    p = X.px(spark, d)
    shifts = p.select(C("frame").alias("f")).distinct().select("f", (C("f") + 1).alias("g"), F.lit(0).alias("dx"), F.lit(0).alias("dy"))
    return samples.graft_beside(X.flat(p), X.alt(p), p.where("y >= 4").select("frame", "x", "y"), shifts, "aura")


@query("c07_alone", None)
def alone(spark, d):
    p = X.px(spark, d)
    return samples.alone(p.where("x between 7 and 8 and y between 7 and 8"), p.where("r < 60"), 1)


@query("c07_drop_scraps", None)
def scraps(spark, d):
    return samples.without_scraps(X.flat(X.px(spark, d)), [(0, 0, 0), (192, 96, 128)], 4)


@query("c06_figures", None)
def figures(spark, d):
    p = X.px(spark, d)
    return samples.figure(p.where("x between 7 and 8 and y between 7 and 8"), p.where("r < 60"), 1)


@query("g15_chest_rows", None)
def chest_rows(spark, d):
    return samples.chest_rows(X.fg(X.px(spark, d)), 2, 2)
