"""Animation scripts as tables: played steps, anchors, summaries, growth, first players, gathered results, run states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixels as P
from .common import C, RGBA


def played(steps: DataFrame) -> DataFrame:
    """Steps up to the animation's last that name a frame."""
    return steps.where("step <= last and frame >= 0")


def anchors(steps: DataFrame) -> DataFrame:
    """frame, anchors: the distinct (x, y) of a frame over played steps, in order of first use."""
    first = played(steps).groupBy("frame", "x", "y").agg(F.min(F.struct("anim", "step")).alias("k"))
    return first.groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "y"))), lambda s: F.array(s["x"], s["y"])).alias("anchors"))


def summary(steps: DataFrame) -> DataFrame:
    """Per animation: steps played, distinct frames, least and largest offsets."""
    return played(steps).groupBy("anim").agg(F.count("*").alias("steps"), F.count_distinct("frame").alias("frames"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])


def first_anim(steps: DataFrame) -> DataFrame:
    """frame, anim: the first animation that plays each frame."""
    return played(steps).groupBy("frame").agg(F.min("anim").alias("anim"))


def sequence(steps: DataFrame) -> DataFrame:
    """anim, step, frame: each animation's distinct frames at their first played step."""
    return played(steps).groupBy("anim", "frame").agg(F.min("step").alias("step")).select("anim", "step", "frame")


def grow_frames(px: DataFrame, grown: DataFrame) -> DataFrame:
    """Pixels of frames in grown (frame, l, t, r, b) moved for a larger canvas; others as they are."""
    j = px.join(grown.select("frame", "l", "t"), "frame", "left")
    return j.select("frame", (C("x") + F.coalesce("l", F.lit(0))).alias("x"), (C("y") + F.coalesce("t", F.lit(0))).alias("y"), *RGBA)


def grow_steps(steps: DataFrame, grown: DataFrame) -> DataFrame:
    """Steps that show a grown frame, moved so that its old pixels stay where they were on screen: x by left, y by right, z by top."""
    j = steps.join(grown.select("frame", "l", "t", C("r").alias("_r")), "frame", "left")
    z = F.lit(0)
    return j.select(*[(C(c) + F.coalesce(d, z)).alias(c) if (d := {"x": C("l"), "y": C("_r"), "z": C("t")}.get(c)) is not None else C(c) for c in steps.columns])


def gathered(versions: DataFrame, stock: DataFrame) -> DataFrame:
    """frame, run: of the versions (frame, run, rank, content) the latest by rank whose content is not the stock's (frame, content); frames of which no version
    differs are left out."""
    s = stock.select("frame", C("content").alias("_stock"))
    v = versions.join(s, "frame", "left").where(~C("content").eqNullSafe(C("_stock")))
    return v.groupBy("frame").agg(F.max(F.struct("rank", "run")).alias("m")).select("frame", "m.run")


def exported(names: DataFrame, finished: DataFrame, stock: DataFrame) -> DataFrame:
    """frame, rel_path, content, finished: original names with the finished picture where there is one, else the stock's."""
    j = names.join(finished.select("frame", C("content").alias("_f")), "frame", "left").join(stock.select("frame", C("content").alias("_s")), "frame", "left")
    return j.select("frame", "rel_path", F.coalesce("_f", "_s").alias("content"), C("_f").isNotNull().alias("finished"))


def frame_hash(px: DataFrame) -> DataFrame:
    """frame, content: a digest of a frame's pixels that does not depend on row order."""
    return px.groupBy("frame").agg(F.concat_ws("-", F.sum(F.xxhash64("x", "y", *RGBA).cast("decimal(38,0)")), F.count("*")).alias("content"))


def status_counts(state: DataFrame) -> DataFrame:
    """run, status, n, reps of a run-state table."""
    return state.groupBy("run", "status").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("rep")).alias("reps"))


def upserted(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state with changed rows in place of those of the same run and rep."""
    return state.join(changes.select("run", "rep"), ["run", "rep"], "left_anti").unionByName(changes, allowMissingColumns=True)


def wanted(crops: DataFrame, steps: DataFrame, spec: str) -> DataFrame:
    """frame, has_crop of a selection: ``all``, ``anim:N`` (frames it plays), or a list of numbers."""
    spark = crops.sparkSession
    if spec == "all":
        return crops.select("frame", F.lit(True).alias("has_crop"))
    if spec.startswith("anim:"):
        f = played(steps).where(C("anim") == int(spec[5:])).select(C("frame").cast("bigint").alias("frame")).distinct()
    else:
        f = spark.createDataFrame([(int(x),) for x in spec.split(",")], "frame bigint").distinct()
    return f.join(crops.select("frame", F.lit(True).alias("_c")).distinct(), "frame", "left").select("frame", C("_c").isNotNull().alias("has_crop"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """f, g: frames of two scripts at equal animation and step, the first for each f."""
    j = a.where("frame >= 0").select("anim", "step", C("frame").alias("f")).join(b.where("frame >= 0").select("anim", "step", C("frame").alias("g")), ["anim", "step"])
    return j.groupBy("f").agg(F.min(F.struct("anim", "step", "g")).alias("m")).select("f", "m.g")


def strip(sizes: DataFrame) -> DataFrame:
    """frame, x, y, canvas_w, canvas_h: places of frames (frame, width, height) side by side on equal cells, bottoms aligned and centred."""
    w = Window.orderBy("frame")
    s = sizes.crossJoin(sizes.agg(F.max("width").alias("cw"), F.max("height").alias("ch")))  # one row
    k = F.row_number().over(w) - 1
    return s.select("frame", (k * C("cw") + P.div(C("cw") - C("width"), 2)).alias("x"), (C("ch") - C("height")).alias("y"), (C("cw") * F.count("*").over(Window.partitionBy())).alias("canvas_w"), C("ch").alias("canvas_h"))
