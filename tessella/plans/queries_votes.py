"""Queries on block votes, their cleanups, grid measures, neighbourhoods and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pixels as P
from ..operators import components, neighbourhood as nh, votes
from ..operators.common import C, RGB
from . import fixtures as X
from .queries_pixels import BGD, near_sql

QUERIES: dict = {}


def query(name, sql, *ctes):
    def put(f):
        QUERIES[name] = (f, f"WITH RECURSIVE {', '.join(ctes)} {sql}" if sql and ctes else sql)
        return f

    return put


# Sheets: groups of 16 frames of flat pixels laid out 4 by 4 without gaps make a 64 by 64 sheet, read back at scale 4 as
# one 16 by 16 frame.
SHEET_SQL = "sheet AS (SELECT frame // 16 AS frame, CAST((frame % 4) * 16 + x AS INT) AS x, CAST(((frame % 16) // 4) * 16 + y AS INT) AS y, r, g, b, a FROM flat)"
SCALE = 4


def sheet(spark, d):
    p = X.flat(X.px(spark, d))
    return p.select(F.floor(C("frame") / 16).alias("frame"), (C("frame") % 4 * 16 + C("x")).cast("int").alias("x"), (F.floor(C("frame") % 16 / 4) * 16 + C("y")).cast("int").alias("y"), *RGB, "a")


def manifest(s):
    return s.select(C("frame").alias("sheet")).distinct().select("sheet", C("sheet").alias("ord"), F.lit(2).alias("x"), F.lit(1).alias("y"), F.lit(15).alias("w"), F.lit(15).alias("h"))


_WX = "[1, 2, 2, 1]" if P.axis_weights(4) == [1, 2, 2, 1] else str(P.axis_weights(4))
CAND = f"""cand AS (SELECT frame, (x - 2) // 4 AS i, (y - 1) // 4 AS j, ({_WX}[(x - 2) % 4 + 1] * {_WX}[(y - 1) % 4 + 1])::BIGINT AS w, ((y - 1) % 4) * 4 + (x - 2) % 4 AS pos,
  CASE WHEN a < 128 OR {BGD} <= 144 OR {BGD} < d THEN NULL ELSE pr * 65536 + pg * 256 + pb END AS c FROM near WHERE x BETWEEN 2 AND 61 AND y BETWEEN 1 AND 60)"""
PER = "per AS (SELECT frame, i, j, c, sum(w) AS w, min(pos) AS pos FROM cand GROUP BY ALL)"
BLK = """blk AS (SELECT frame, i, j, sum(w) AS total, coalesce(sum(w) FILTER (c IS NULL), 0) AS bgw, count(c) AS n FROM per GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, i, j ORDER BY w DESC, pos DESC) AS k FROM per WHERE c IS NOT NULL) WHERE k = 1),
grid AS (SELECT s.frame, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM (SELECT DISTINCT frame FROM sheet) s CROSS JOIN (SELECT unnest(generate_series(0, 14)) AS i) CROSS JOIN (SELECT unnest(generate_series(0, 14)) AS j)),
vote AS (SELECT g.frame, g.i, g.j, CASE WHEN 2 * bgw > total OR n = 0 THEN NULL ELSE t.c END AS win, coalesce(n > 1 OR (bgw > 0 AND n > 0), false) AS contested,
  coalesce(CASE WHEN 2 * bgw > total OR n = 0 THEN bgw ELSE (SELECT sum(p.w) FROM per p WHERE p.frame = g.frame AND p.i = g.i AND p.j = g.j AND p.c IS NOT NULL AND (p.c // 65536 - t.c // 65536) ** 2 + (p.c // 256 % 256 - t.c // 256 % 256) ** 2 + (p.c % 256 - t.c % 256) ** 2 <= TOL2) END::DOUBLE / total, 1.0) AS share
  FROM grid g LEFT JOIN blk b USING (frame, i, j) LEFT JOIN best t USING (frame, i, j))"""
VOTE = [X.PX_SQL, X.FLAT_SQL, SHEET_SQL, X.PALETTE_SQL, near_sql("sheet"), CAND, PER, BLK.replace("TOL2", "0")]
VOTE_TOL = [*VOTE[:-1], BLK.replace("TOL2", "3600")]
_WIN = "CAST({0} // 65536 AS INT) AS r, CAST({0} // 256 % 256 AS INT) AS g, CAST({0} % 256 AS INT) AS b"


def _votes(spark, d, tol=0):
    s = sheet(spark, d)
    return votes.vote(s, manifest(s), SCALE, X.palette(spark), X.BG, tol=tol)


def _flat(v):
    return v.select("frame", "i", "j", *[C(f"win.{c}").alias(c) for c in RGB], "contested", "share")


@query("a01_block_vote", f"SELECT frame, i, j, {_WIN.format('win')}, contested, share FROM vote", *VOTE)
def block_vote(spark, d):
    return _flat(_votes(spark, d))


@query("a03_tally_with_tolerance", f"SELECT frame, i, j, {_WIN.format('win')}, contested, share FROM vote", *VOTE_TOL)
def tally(spark, d):
    return _flat(_votes(spark, d, 60))


@query("a02_fractional_vote", f"""SELECT g.frame, g.i, g.j, {_WIN.format('CASE WHEN 2 * bgw > total OR n = 0 THEN NULL ELSE t.c END')}, coalesce(n > 1 OR (bgw > 0 AND n > 0), false) AS contested, coalesce(CASE WHEN 2 * bgw > total OR n = 0 THEN bgw ELSE t.w END / total, 1.0) AS share
  FROM (SELECT s.frame, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM (SELECT DISTINCT frame FROM sheet) s CROSS JOIN (SELECT unnest(generate_series(0, 13)) AS i) CROSS JOIN (SELECT unnest(generate_series(0, 13)) AS j)) g
  LEFT JOIN (SELECT frame, i, j, sum(w) AS total, coalesce(sum(w) FILTER (c IS NULL), 0) AS bgw, count(c) AS n FROM fper GROUP BY ALL) b USING (frame, i, j)
  LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, i, j ORDER BY w DESC, pos DESC) AS k FROM fper WHERE c IS NOT NULL) WHERE k = 1) t USING (frame, i, j)""", X.PX_SQL, X.FLAT_SQL, SHEET_SQL, X.PALETTE_SQL, near_sql("sheet"),
  f"""fcand AS (SELECT frame, floor(u)::INT AS i, floor(v)::INT AS j, greatest(1.0, 3 - abs(2 * ((x + 0.5 - (1.25::DOUBLE + floor(u) * 4.375::DOUBLE)) / 4.375::DOUBLE) - 1) * 4 / 2) * greatest(1.0, 3 - abs(2 * ((y + 0.5 - (0.75::DOUBLE + floor(v) * 4.375::DOUBLE)) / 4.375::DOUBLE) - 1) * 4 / 2) AS w, y * 1000000 + x AS pos, CASE WHEN a < 128 OR {BGD} <= 144 OR {BGD} < d THEN NULL ELSE pr * 65536 + pg * 256 + pb END AS c
  FROM (SELECT *, (x + 0.5 - 1.25)::DOUBLE / 4.375::DOUBLE AS u, (y + 0.5 - 0.75)::DOUBLE / 4.375::DOUBLE AS v FROM near) WHERE u >= 0 AND u < 14 AND v >= 0 AND v < 14)""", "fper AS (SELECT frame, i, j, c, sum(w) AS w, min(pos) AS pos FROM fcand GROUP BY ALL)")
def fractional(spark, d):
    s = sheet(spark, d)
    g = s.select(C("frame").alias("sheet")).distinct().select("sheet", C("sheet").alias("ord"), F.lit(1.25).cast("double").alias("gx"), F.lit(0.75).cast("double").alias("gy"), F.lit(14).alias("w"), F.lit(14).alias("h"), F.lit(4.375).cast("double").alias("block"))
    return _flat(votes.vote_fractional(s, g, SCALE, X.palette(spark), X.BG))


@query("a04_share_histogram", f"SELECT frame, {', '.join(f'sum(CASE WHEN least(9, floor(share * 10)) = {k} THEN 1 ELSE 0 END)::BIGINT AS h{k}' for k in range(10))} FROM vote SEMI JOIN best USING (frame, i, j) GROUP BY frame", *VOTE)
def histogram(spark, d):
    return votes.histogram(_votes(spark, d))


@query("a05_vote_counters", "SELECT frame, count(win)::BIGINT AS opaque, sum(contested::INT)::BIGINT AS contested, sum((win IS NOT NULL AND share < 0.6)::INT)::BIGINT AS weak, count(DISTINCT win)::BIGINT AS colors FROM vote GROUP BY frame", *VOTE)
def counters(spark, d):
    return votes.counters(_votes(spark, d))


_EDGES = "edges AS (SELECT frame, 'x' AS axis, x AS pos FROM (SELECT frame, x, abs(r - lag(r) OVER w) + abs(g - lag(g) OVER w) + abs(b - lag(b) OVER w) AS s, x - lag(x) OVER w AS gap FROM sheet WINDOW w AS (PARTITION BY frame, y ORDER BY x)) WHERE s > 90 AND gap = 1 UNION ALL SELECT frame, 'y', y FROM (SELECT frame, y, abs(r - lag(r) OVER w) + abs(g - lag(g) OVER w) + abs(b - lag(b) OVER w) AS s, y - lag(y) OVER w AS gap FROM sheet WINDOW w AS (PARTITION BY frame, x ORDER BY y)) WHERE s > 90 AND gap = 1)"
_SH = [X.PX_SQL, X.FLAT_SQL, SHEET_SQL]


@query("a06_grid_fit", "SELECT frame, count(*) AS edges, sum((p <= 0.15 OR p >= 0.85)::INT)::DOUBLE / count(*) AS fit FROM (SELECT frame, (pos - o)::DOUBLE / 4 - floor((pos - o)::DOUBLE / 4) AS p FROM (SELECT *, 0 AS o FROM edges)) GROUP BY frame", *_SH, _EDGES)
def grid_fit(spark, d):
    s = sheet(spark, d)
    g = s.select("frame").distinct().select("frame", *[F.lit(v).cast("double").alias(n) for n, v in (("gx", 0), ("gy", 0), ("w", 16), ("h", 16), ("block", 4))])
    return votes.grid_fit(s, g)


_CONC = "conc AS (SELECT frame, axis, k, 4.0::DOUBLE * (1 + k / 1000.0::DOUBLE) AS period, sqrt(sum(sin(2 * pi() * pos / (4.0::DOUBLE * (1 + k / 1000.0::DOUBLE)))) ** 2 + sum(cos(2 * pi() * pos / (4.0::DOUBLE * (1 + k / 1000.0::DOUBLE)))) ** 2) / count(*) AS conc FROM edges CROSS JOIN (SELECT CAST(unnest(generate_series(-40, 40)) AS INT) AS k) GROUP BY ALL)"


@query("a24_phase_concentration", "SELECT frame, axis, round(conc, 6) AS conc FROM conc WHERE k = 0", *_SH, _EDGES, _CONC)
def phase(spark, d):
    one = spark.createDataFrame([(0, 4.0)], "k int, period double")
    return votes.concentration(votes.edge_positions(sheet(spark, d)), one).select("frame", "axis", F.round("conc", 6).alias("conc"))


@query("a25_scale_search", "SELECT frame, k, round(c, 6) AS conc FROM (SELECT frame, k, sum(conc) / 2 AS c, row_number() OVER (PARTITION BY frame ORDER BY round(sum(conc) / 2, 12) DESC, k) AS n FROM conc GROUP BY frame, k) WHERE n = 1", *_SH, _EDGES, _CONC)
def scale_search(spark, d):
    return votes.scale_search(votes.edge_positions(sheet(spark, d)), 4.0).select("frame", "k", F.round("conc", 6).alias("conc"))


@query("a26_block_shift_search", """SELECT frame, sx, sy, agree FROM (SELECT frame, tx AS sx, ty AS sy, sum((s.x IS NOT NULL) = (p.a >= 128))::BIGINT AS agree, row_number() OVER (PARTITION BY frame ORDER BY sum(((s.x IS NOT NULL) = (p.a >= 128))::INT) DESC, abs(tx) + abs(ty), ty, tx) AS k
  FROM px p CROSS JOIN (SELECT CAST(unnest(generate_series(-2, 2)) AS INT) AS tx) CROSS JOIN (SELECT CAST(unnest(generate_series(-2, 2)) AS INT) AS ty) LEFT JOIN (SELECT frame AS f, x + 1 AS x, y - 1 AS y FROM px WHERE a >= 128) s ON s.f = p.frame AND s.x = p.x + tx AND s.y = p.y + ty GROUP BY frame, tx, ty) WHERE k = 1""".replace("sum((s.x IS NOT NULL) = (p.a >= 128))", "sum(((s.x IS NOT NULL) = (p.a >= 128))::INT)"), X.PX_SQL)
def shift_search(spark, d):
    p = X.px(spark, d)
    solid = p.where(P.opaque()).select("frame", (C("x") + 1).alias("i"), (C("y") - 1).alias("j"))
    return votes.shift_search(solid, p)


_N8 = "n8 AS (SELECT v.frame, v.i, v.j, q.win FROM vote v JOIN vote q ON q.frame = v.frame AND abs(q.i - v.i) <= 1 AND abs(q.j - v.j) <= 1 AND (q.i <> v.i OR q.j <> v.j))"


@query("n01_resolve_orphans", f"""SELECT v.frame, v.i, v.j, {_WIN.format('CASE WHEN share < 0.6 AND NOT alone_no AND s.n > 0 THEN s.c ELSE v.win END')} FROM (SELECT v.*, EXISTS (SELECT 1 FROM n8 q WHERE q.frame = v.frame AND q.i = v.i AND q.j = v.j AND q.win IS NOT DISTINCT FROM v.win) AS alone_no FROM vote v) v
  LEFT JOIN (SELECT * FROM (SELECT p.frame, p.i, p.j, p.c, (SELECT count(*) FROM n8 q WHERE q.frame = p.frame AND q.i = p.i AND q.j = p.j AND q.win IS NOT DISTINCT FROM p.c) AS n, row_number() OVER (PARTITION BY p.frame, p.i, p.j ORDER BY (SELECT count(*) FROM n8 q WHERE q.frame = p.frame AND q.i = p.i AND q.j = p.j AND q.win IS NOT DISTINCT FROM p.c) DESC, p.pos DESC) AS k
    FROM per p JOIN blk b USING (frame, i, j) WHERE p.w::DOUBLE / b.total >= 0.2) WHERE k = 1) s ON s.frame = v.frame AND s.i = v.i AND s.j = v.j""", *VOTE, _N8)
def resolve(spark, d):
    v = votes.resolve_orphans(_votes(spark, d))
    return v.select("frame", "i", "j", *[C(f"win.{c}").alias(c) for c in RGB])


def _dd(a, b):
    return f"(({a}) // 65536 - ({b}) // 65536) ** 2 + (({a}) // 256 % 256 - ({b}) // 256 % 256) ** 2 + (({a}) % 256 - ({b}) % 256) ** 2"


@query("n02_smooth_grain", f"""SELECT v.frame, v.i, v.j, {_WIN.format('coalesce(s.c, v.win)')} FROM vote v LEFT JOIN (SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY frame, i, j ORDER BY n DESC, c) AS o FROM (
  SELECT v.frame, v.i, v.j, q.win AS c, (SELECT count(*) FROM n8 z WHERE z.frame = v.frame AND z.i = v.i AND z.j = v.j AND z.win IS NOT NULL AND {_dd('z.win', 'q.win')} <= 8100) AS n FROM vote v JOIN (SELECT DISTINCT * FROM n8) q USING (frame, i, j)
  WHERE v.win IS NOT NULL AND q.win IS NOT NULL AND {_dd('v.win', 'q.win')} <= 32400 AND NOT EXISTS (SELECT 1 FROM n8 z WHERE z.frame = v.frame AND z.i = v.i AND z.j = v.j AND z.win IS NOT NULL AND {_dd('z.win', 'v.win')} <= 8100)
    AND EXISTS (SELECT 1 FROM per p JOIN blk b USING (frame, i, j) WHERE p.frame = v.frame AND p.i = v.i AND p.j = v.j AND p.c = q.win AND p.w::DOUBLE / b.total >= 0.05)) k) WHERE o = 1) s ON s.frame = v.frame AND s.i = v.i AND s.j = v.j""", *VOTE, _N8)
def grain(spark, d):
    v = votes.smooth_grain(_votes(spark, d), 90)
    return v.select("frame", "i", "j", *[C(f"win.{c}").alias(c) for c in RGB])


_NB4 = "nb AS (SELECT p.frame, p.x, p.y, q.r, q.g, q.b, o.k FROM flat p CROSS JOIN (VALUES (0, -1, 0), (1, 1, 0), (2, 0, -1), (3, 0, 1)) o(k, dx, dy) JOIN flat q ON q.frame = p.frame AND q.x = p.x + o.dx AND q.y = p.y + o.dy WHERE q.a >= 128)"


@query("n03_despeckle", """SELECT p.frame, p.x, p.y, CASE WHEN kind = 'speck' THEN 0 WHEN kind = 'hole' THEN m.r ELSE p.r END AS r, CASE WHEN kind = 'speck' THEN 0 WHEN kind = 'hole' THEN m.g ELSE p.g END AS g, CASE WHEN kind = 'speck' THEN 0 WHEN kind = 'hole' THEN m.b ELSE p.b END AS b, CASE WHEN kind = 'speck' THEN 0 WHEN kind = 'hole' THEN 255 ELSE p.a END AS a, kind
  FROM (SELECT p.*, CASE WHEN a >= 128 AND coalesce(n, 0) = 0 THEN 'speck' WHEN a < 128 AND n = 4 THEN 'hole' END AS kind FROM flat p LEFT JOIN (SELECT frame, x, y, count(*) AS n FROM nb GROUP BY ALL) USING (frame, x, y)) p
  LEFT JOIN (SELECT * FROM (SELECT frame, x, y, r, g, b, row_number() OVER (PARTITION BY frame, x, y ORDER BY count(*) DESC, min(k) DESC) AS o FROM nb GROUP BY frame, x, y, r, g, b) WHERE o = 1) m USING (frame, x, y)""", X.PX_SQL, X.FLAT_SQL, _NB4)
def despeckle(spark, d):
    return nh.despeckle(X.flat(X.px(spark, d)))


@query("n03_speck_counts", "SELECT frame, count(*) FILTER (a >= 128 AND coalesce(n, 0) = 0) AS specks, count(*) FILTER (a < 128 AND n = 4) AS holes FROM flat LEFT JOIN (SELECT frame, x, y, count(*) AS n FROM nb GROUP BY ALL) USING (frame, x, y) GROUP BY frame", X.PX_SQL, X.FLAT_SQL, _NB4)
def speck_counts(spark, d):
    return nh.despeckle_report(X.flat(X.px(spark, d)))


_FAINT = "faint AS (SELECT frame, x, y, r, g, b, CASE WHEN a = 0 THEN 0 ELSE 60 + (x * y) % 190 END AS a FROM px)"


def _pass(src):
    return f"SELECT p.frame, p.x, p.y, CASE WHEN f THEN 0 ELSE r END AS r, CASE WHEN f THEN 0 ELSE g END AS g, CASE WHEN f THEN 0 ELSE b END AS b, CASE WHEN f THEN 0 ELSE a END AS a FROM (SELECT p.*, a > 0 AND a < 200 AND (SELECT count(*) FROM {src} q WHERE q.frame = p.frame AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND (q.x <> p.x OR q.y <> p.y) AND q.a > 0) < 7 AS f FROM {src} p) p"


@query("n04_lift_noise", _pass("one"), X.PX_SQL, _FAINT, f"one AS ({_pass('faint')})")
def lift_noise(spark, d):
    p = X.px(spark, d)
    return nh.lift_noise(p.withColumn("a", F.when(C("a") == 0, 0).otherwise(60 + C("x") * C("y") % 190)), 2, least=7)


_NB8 = "nb AS (SELECT p.frame, p.x, p.y, q.r, q.g, q.b FROM px p JOIN px q ON q.frame = p.frame AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND (q.x <> p.x OR q.y <> p.y) WHERE q.a >= 128)"


@query("n05_specks_to_mode", """SELECT p.frame, p.x, p.y, CASE WHEN h THEN m.r ELSE p.r END AS r, CASE WHEN h THEN m.g ELSE p.g END AS g, CASE WHEN h THEN m.b ELSE p.b END AS b, p.a, h AS changed FROM (
  SELECT p.*, a >= 128 AND coalesce(n, 0) >= 6 AND NOT coalesce(near, false) AS h FROM px p LEFT JOIN (SELECT q.frame, q.x, q.y, count(*) AS n, bool_or((q.r - p.r) ** 2 + (q.g - p.g) ** 2 + (q.b - p.b) ** 2 <= 576) AS near FROM nb q JOIN px p USING (frame, x, y) GROUP BY ALL) USING (frame, x, y)) p
  LEFT JOIN (SELECT * FROM (SELECT frame, x, y, r, g, b, row_number() OVER (PARTITION BY frame, x, y ORDER BY count(*) DESC, r, g, b) AS o FROM nb GROUP BY ALL) WHERE o = 1) m USING (frame, x, y)""".replace("FROM nb GROUP BY ALL) WHERE o = 1", "FROM nb GROUP BY frame, x, y, r, g, b) WHERE o = 1"), X.PX_SQL, _NB8)
def specks(spark, d):
    return nh.specks(X.px(spark, d))


_DIL = "SELECT DISTINCT m.frame, m.x + dx AS x, m.y + dy AS y FROM {m} m CROSS JOIN (SELECT CAST(unnest(generate_series(-1, 1)) AS INT) AS dx) CROSS JOIN (SELECT CAST(unnest(generate_series(-1, 1)) AS INT) AS dy)"


def _ero(m):
    return f"SELECT frame, x, y FROM (SELECT m.frame, m.x + dx AS x, m.y + dy AS y FROM {m} m CROSS JOIN (SELECT CAST(unnest(generate_series(-1, 1)) AS INT) AS dx) CROSS JOIN (SELECT CAST(unnest(generate_series(-1, 1)) AS INT) AS dy)) GROUP BY frame, x, y HAVING count(*) = 9"


@query("n07_dilate", _DIL.format(m="fg"), X.PX_SQL, X.FG_SQL)
def dilate(spark, d):
    return nh.dilate(X.fg(X.px(spark, d)))


@query("n07_close", _ero("dil"), X.PX_SQL, X.FG_SQL, f"dil AS ({_DIL.format(m='fg')})")
def close(spark, d):
    return nh.closed(X.fg(X.px(spark, d)))


@query("n07_open", _DIL.format(m="ero"), X.PX_SQL, "opq AS (SELECT frame, x, y FROM px WHERE a >= 128 AND x % 5 < 4)", f"ero AS ({_ero('opq')})")
def open_(spark, d):
    return nh.opened(X.px(spark, d).where("a >= 128 and x % 5 < 4"))


_O4 = "(VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dx, dy)"


@query("n08_contour", f"SELECT DISTINCT m.frame, m.x, m.y FROM fg m CROSS JOIN {_O4} LEFT JOIN fg q ON q.frame = m.frame AND q.x = m.x + o.dx AND q.y = m.y + o.dy WHERE q.frame IS NULL", X.PX_SQL, X.FG_SQL)
def contour(spark, d):
    return nh.contour(X.fg(X.px(spark, d)))


@query("n08_rim", f"SELECT DISTINCT m.frame, m.x + o.dx AS x, m.y + o.dy AS y FROM fg m CROSS JOIN {_O4} LEFT JOIN fg q ON q.frame = m.frame AND q.x = m.x + o.dx AND q.y = m.y + o.dy WHERE q.frame IS NULL", X.PX_SQL, X.FG_SQL)
def rim(spark, d):
    return nh.rim(X.fg(X.px(spark, d)))


@query("n09_distance_map", "SELECT p.frame, p.x, p.y, min(greatest(abs(p.x - q.x), abs(p.y - q.y))) AS d FROM px p JOIN fg q ON q.frame = p.frame AND abs(p.x - q.x) <= 3 AND abs(p.y - q.y) <= 3 GROUP BY ALL", X.PX_SQL, "fg AS (SELECT frame, x, y FROM px WHERE r < 20)")
def distance_map(spark, d):
    p = X.px(spark, d)
    return nh.distance_map(p.where("r < 20"), p, 3)


@query("n09_depth_map", """SELECT m.frame, m.x, m.y, CAST(min(abs(m.x - o.x) + abs(m.y - o.y)) AS INT) AS d FROM fg m JOIN (SELECT f.frame, x, y FROM (SELECT DISTINCT frame FROM fg) f CROSS JOIN (SELECT CAST(unnest(generate_series(-1, 16)) AS INT) AS x) CROSS JOIN (SELECT CAST(unnest(generate_series(-1, 16)) AS INT) AS y) ANTI JOIN fg USING (frame, x, y)) o ON o.frame = m.frame GROUP BY m.frame, m.x, m.y""", X.PX_SQL, "fg AS (SELECT frame, x, y FROM px WHERE a >= 128)")
def depth_map(spark, d):
    return components.depth(X.px(spark, d).where("a >= 128"))


@query("n10_textured_patches", """SELECT p.frame, p.x, p.y FROM flat p CROSS JOIN (SELECT CAST(unnest(generate_series(-1, 1)) AS INT) AS dx) CROSS JOIN (SELECT CAST(unnest(generate_series(-1, 1)) AS INT) AS dy)
  LEFT JOIN flat s ON s.frame = p.frame AND s.x = p.x + dx AND s.y = p.y + dy LEFT JOIN near2 t ON t.frame = p.frame AND t.x = p.x + dx AND t.y = p.y + dy GROUP BY p.frame, p.x, p.y
  HAVING bool_and(coalesce(s.r, 0) = coalesce(t.r, 0) AND coalesce(s.g, 0) = coalesce(t.g, 0) AND coalesce(s.b, 0) = coalesce(t.b, 0) AND coalesce(s.a, 0) = coalesce(t.a, 0)) AND count(DISTINCT (coalesce(s.r, 0), coalesce(s.g, 0), coalesce(s.b, 0), coalesce(s.a, 0))) >= 3""", X.PX_SQL, X.FLAT_SQL, "near2 AS (SELECT frame, x, y, CASE WHEN (x + 3 * y + frame) % 17 = 0 THEN 1 ELSE r END AS r, g, b, a FROM flat)")
def textured(spark, d):
    p = X.flat(X.px(spark, d))
    return nh.textured(p, p.withColumn("r", F.when((C("x") + 3 * C("y") + C("frame")) % 17 == 0, 1).otherwise(C("r"))))


@query("g16_runs", "SELECT frame, y, CAST(start AS INT) AS start, n, CAST(row_number() OVER (PARTITION BY frame, y ORDER BY start) AS INT) AS run FROM (SELECT frame, y, min(x) AS start, CAST(count(*) AS INT) AS n FROM (SELECT frame, x, y, x - row_number() OVER (PARTITION BY frame, y ORDER BY x) AS k FROM fg) GROUP BY frame, y, k)", X.PX_SQL, X.FG_SQL)
def runs(spark, d):
    return nh.runs(X.fg(X.px(spark, d)))


@query("g16_cylinder_shade", "SELECT frame, x, y, CASE t WHEN 0 THEN 10 WHEN 1 THEN 60 ELSE 200 END AS r, CASE t WHEN 0 THEN 20 WHEN 1 THEN 70 ELSE 210 END AS g, CASE t WHEN 0 THEN 30 WHEN 1 THEN 80 ELSE 220 END AS b FROM (SELECT frame, x, y, least(least(pos, n - 1 - pos) * 6 // n, 2) AS t FROM (SELECT frame, x, y, row_number() OVER (PARTITION BY frame, y, k ORDER BY x) - 1 AS pos, count(*) OVER (PARTITION BY frame, y, k) AS n FROM (SELECT frame, x, y, x - row_number() OVER (PARTITION BY frame, y ORDER BY x) AS k FROM fg)))", X.PX_SQL, X.FG_SQL)
def cylinder(spark, d):
    return nh.cylinder_shade(X.fg(X.px(spark, d)), [(10, 20, 30), (60, 70, 80), (200, 210, 220)])


@query("a14_edge_colour", "SELECT frame, r, g, b, n FROM (SELECT frame, r, g, b, CAST(sum(t) AS BIGINT) AS n, row_number() OVER (PARTITION BY frame ORDER BY sum(t) DESC, r, g, b) AS k FROM (SELECT *, (x = min(x) OVER f)::INT + (x = max(x) OVER f)::INT + (y = min(y) OVER f)::INT + (y = max(y) OVER f)::INT AS t FROM flat WINDOW f AS (PARTITION BY frame)) WHERE t > 0 GROUP BY frame, r, g, b) WHERE k = 1", X.PX_SQL, X.FLAT_SQL)
def edge_colour(spark, d):
    return nh.edge_colour(X.flat(X.px(spark, d)))


# Components -------------------------------------------------------------------------------------------------------------
def _cc(src, name="cc", reach=1):
    near = "abs(q.x - r.x) <= 1 AND abs(q.y - r.y) <= 1" if reach else "abs(q.x - r.x) + abs(q.y - r.y) <= 1"
    return f"""walk_{name} AS (SELECT frame, x, y, x AS sx, y AS sy FROM {src} UNION SELECT r.frame, q.x, q.y, r.sx, r.sy FROM walk_{name} r JOIN {src} q ON q.frame = r.frame AND {near}),
{name} AS (SELECT frame, x, y, min(sy::BIGINT * 65536 + sx) AS comp FROM walk_{name} GROUP BY frame, x, y)"""


@query("c01_components_8", "SELECT * FROM cc", X.PX_SQL, X.FG_SQL, _cc("fg"))
def components_8(spark, d):
    return components.components(X.fg(X.px(spark, d)))


@query("c01_components_4", "SELECT * FROM cc", X.PX_SQL, X.FG_SQL, _cc("fg", reach=0))
def components_4(spark, d):
    return components.components(X.fg(X.px(spark, d)), diagonal=False)


@query("a30_component_centres", "SELECT frame, comp, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, avg(x) AS cx, avg(y) AS cy FROM cc GROUP BY frame, comp", X.PX_SQL, X.FG_SQL, _cc("fg"))
def centres(spark, d):
    return components.component_table(components.components(X.fg(X.px(spark, d))))


_RMQ = "sqrt((2 + (p.r + q.r) / 2.0 / 256) * (p.r - q.r) * (p.r - q.r) + 4 * (p.g - q.g) * (p.g - q.g) + (2 + (255 - (p.r + q.r) / 2.0) / 256) * (p.b - q.b) * (p.b - q.b))"
_STAB = f"fg AS (SELECT p.frame, p.x, p.y FROM alt p JOIN px q USING (frame, x, y) WHERE ((p.a >= 128) <> (q.a >= 128) OR (p.a >= 128 AND {_RMQ} > 10)))"


@query("c02_stabilize", """SELECT p.frame, p.x, p.y, CASE WHEN k THEN q.r ELSE p.r END AS r, CASE WHEN k THEN q.g ELSE p.g END AS g, CASE WHEN k THEN q.b ELSE p.b END AS b, CASE WHEN k THEN q.a ELSE p.a END AS a, k AS reverted FROM (SELECT p.*, coalesce(n < 3, false) AS k FROM alt p LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY frame, comp) AS n FROM cc) USING (frame, x, y) ) p JOIN px q USING (frame, x, y)""", X.PX_SQL, X.ALT_SQL, _STAB, _cc("fg"))
def stabilize(spark, d):
    p = X.px(spark, d)
    return components.stabilize(X.alt(p), p, min_region=3, tol=10)


_SPARSE = "fg AS (SELECT frame, x, y FROM px WHERE a >= 128 AND r < 110)"


@query("c03_drop_small", "SELECT frame, x, y, r, g, b, a FROM (SELECT p.*, n FROM (SELECT * FROM px WHERE r < 110) p LEFT JOIN (SELECT frame, x, y, count(*) OVER (PARTITION BY frame, comp) AS n FROM cc) USING (frame, x, y)) WHERE n IS NULL OR n >= 6", X.PX_SQL, _SPARSE, _cc("fg"))
def drop_small(spark, d):
    return components.drop_small(X.px(spark, d).where("r < 110"), 6)


@query("c04_touching", f"SELECT frame, comp, count(*) AS n, count(t) AS touches FROM cc LEFT JOIN (SELECT DISTINCT o.frame, o.x - dx AS x, o.y - dy AS y, 1 AS t FROM (SELECT * FROM px WHERE r >= 200) o CROSS JOIN {_O4}) USING (frame, x, y) GROUP BY frame, comp", X.PX_SQL, X.FG_SQL, _cc("fg"))
def touching(spark, d):
    p = X.px(spark, d)
    return components.touching(components.components(X.fg(p)), p.where("r >= 200"))


@query("c04_border_majority", f"""SELECT frame, comp, kind, n FROM (SELECT frame, comp, kind, count(*) AS n, row_number() OVER (PARTITION BY frame, comp ORDER BY count(*) DESC, kind) AS k FROM (
  SELECT DISTINCT c.frame, c.comp, c.x + dx AS x, c.y + dy AS y FROM cc c CROSS JOIN {_O4}) b ANTI JOIN cc USING (frame, comp, x, y) JOIN (SELECT frame, x, y, CAST(b // 64 AS INT) AS kind FROM px) USING (frame, x, y) GROUP BY frame, comp, kind) WHERE k = 1""", X.PX_SQL, X.FG_SQL, _cc("fg"))
def border_majority(spark, d):
    p = X.px(spark, d)
    return components.border_majority(components.components(X.fg(p)), p.withColumn("_kind", F.floor(C("b") / 64).cast("int")))


@query("c05_seeded_growth", "SELECT cc.frame, cc.x, cc.y FROM cc SEMI JOIN (SELECT DISTINCT c.frame, c.comp FROM cc c JOIN seeds USING (frame, x, y)) s ON s.frame = cc.frame AND s.comp = cc.comp", X.PX_SQL, "seeds AS (SELECT frame, x, y FROM px WHERE (frame * 256 + y * 16 + x) % 37 = 0)", "fg AS (SELECT frame, x, y FROM px WHERE r < 110 UNION SELECT * FROM seeds)", _cc("fg", reach=0))
def growth(spark, d):
    p = X.px(spark, d)
    return components.grow(p.where("(frame * 256 + y * 16 + x) % 37 = 0"), X.fg(p))


@query("g13_split_cells", "SELECT p.frame, p.x, p.y, r, g, b, a, cell FROM (SELECT * FROM px WHERE r < 110) p JOIN cc USING (frame, x, y) JOIN (SELECT frame, comp, CAST(least(floor(avg(y) * 2 / 16), 1) * 3 + least(floor(avg(x) * 3 / 16), 2) AS INT) AS cell FROM cc GROUP BY frame, comp) USING (frame, comp)", X.PX_SQL, _SPARSE, _cc("fg"))
def split_cells(spark, d):
    return components.split_cells(X.px(spark, d).where("r < 110"), 16, 16, 2, 3)


@query("c06_near_components", "SELECT DISTINCT c.frame, c.comp FROM cc c JOIN px q ON q.frame = c.frame AND q.b < 30 AND abs(q.x - c.x) <= 2 AND abs(q.y - c.y) <= 2", X.PX_SQL, X.FG_SQL, _cc("fg"))
def near_components(spark, d):
    p = X.px(spark, d)
    return components.near_components(components.components(X.fg(p)), p.where("b < 30"), 2)


_AXIS = "ax AS (SELECT m.frame, hx, hy, cx, cy, degrees(atan2(cy - hy, cx - hx)) AS angle FROM (SELECT frame, avg(x) AS cx, avg(y) AS cy FROM px WHERE a >= 128 GROUP BY frame) m JOIN (SELECT frame, avg(x) AS hx, avg(y) AS hy FROM px WHERE y < 4 AND r < 110 GROUP BY frame) h USING (frame))"


@query("a31_body_axis", "SELECT frame, round(angle, 6) AS angle, round_even(angle / 22.5::DOUBLE, 0) * 22.5::DOUBLE AS snapped, round(sqrt((cx - hx) ** 2 + (cy - hy) ** 2), 6) AS span FROM ax", X.PX_SQL, _AXIS)
def body_axis(spark, d):
    p = X.px(spark, d)
    a = components.body_axis(p.where(P.opaque()), p.where("y < 4 and r < 110"))
    return a.select("frame", F.round("angle", 6).alias("angle"), "snapped", F.round("span", 6).alias("span"))


@query("p18_body_zones", "SELECT frame, count(*) FILTER (t < 0.5) AS z0, count(*) FILTER (t >= 0.5 AND t < 1.25) AS z1, count(*) FILTER (t >= 1.25) AS z2 FROM (SELECT p.frame, ((x - hx) * cos(radians(s)) + (y - hy) * sin(radians(s))) / sqrt((cx - hx) ** 2 + (cy - hy) ** 2) AS t FROM px p JOIN (SELECT *, round_even(angle / 22.5::DOUBLE, 0) * 22.5::DOUBLE AS s FROM ax) USING (frame)) GROUP BY frame", X.PX_SQL, _AXIS)
def body_zones(spark, d):
    p = X.px(spark, d)
    z = components.zones(p, components.body_axis(p.where(P.opaque()), p.where("y < 4 and r < 110")), [0.5, 1.25])
    return z.groupBy("frame").agg(*[F.count(F.when(C("zone") == k, 1)).alias(f"z{k}") for k in range(3)])

