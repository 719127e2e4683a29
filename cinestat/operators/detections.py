"""Detected boxes: grouping of overlapping ones, and the place they give to an image."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cinestat.functions.geometry import rect_contains
from cinestat.operators.features import nearest_box
from cinestat.session import kept

BOX = ["x", "y", "w", "h"]


def _similar(p: Column, q: Column, eps: float) -> Column:
    most = (F.least(p["w"], q["w"]) + F.least(p["h"], q["h"])) * (eps / 2)
    edges = [p["x"] - q["x"], p["y"] - q["y"], p["x"] + p["w"] - q["x"] - q["w"], p["y"] + p["h"] - q["y"] - q["h"]]
    return reduce(lambda x, y: x & y, [F.abs(e) <= most for e in edges])


def similar_pairs(boxes: DataFrame, key: str, eps: float = 0.2, few: int = 128) -> DataFrame:
    """Pairs ``a < b`` (column ``id``) of boxes of one key whose four edges differ by at most
    ``eps / 2`` times the sum of the smaller width and the smaller height.

    The boxes of a key with at most ``few`` of them all meet; each box is shuffled once.  Those of
    other keys meet on a grid.  Joins are by merging: kept files are far smaller than their
    rows, and none of these tables may be gathered at the driver.
    """
    sized = boxes.where(F.col("w") + F.col("h") > 0)
    busy = kept(sized.groupBy(F.col(key).alias("__busy")).agg(F.count("*").alias("__n")).where(F.col("__n") > few).select("__busy"))
    many = busy.count()
    if not many:
        return _pairs_of_keys(sized, key, eps)
    held = busy.hint("broadcast" if many <= 100_000 else "merge")
    is_busy = F.col(key) == F.col("__busy")
    return _pairs_of_keys(sized.join(held, is_busy, "left_anti"), key, eps).unionByName(_pairs_on_grid(sized.join(held, is_busy, "left_semi"), key, eps))


def _pairs_of_keys(boxes: DataFrame, key: str, eps: float) -> DataFrame:
    """All similar pairs by a join on the key alone."""
    # Both sides are shuffled alike, so that Spark shuffles the boxes once.
    sides = [boxes.select(F.col(key).alias("k"), F.col("id").alias(i), F.struct(*BOX).alias(s)) for i, s in (("a", "p"), ("b", "q"))]
    met = sides[0].join(sides[1].hint("merge"), "k")
    return met.where((F.col("a") < F.col("b")) & _similar(F.col("p"), F.col("q"), eps)).select(F.col("k").alias(key), "a", "b")


def _pairs_on_grid(boxes: DataFrame, key: str, eps: float) -> DataFrame:
    """All similar pairs by an equi-join over a grid: boxes are put on a level by the logarithm
    of their size, and per level on a grid as coarse as their difference can be there.  Similar
    boxes lie on one level or on neighbouring ones, in one cell or in neighbouring ones, so a
    box asks in 2 x 9 cells.
    """
    step = 1 + 2 * eps
    size = F.col("w") + F.col("h")
    placed = boxes.withColumn("level", F.floor(F.log(size) / F.log(F.lit(step))).cast("int"))

    def cell(v: str, level: Column) -> Column:
        return F.floor(F.col(v) / (F.lit(eps / 2) * F.pow(F.lit(step), level + 1))).cast("long")

    home = placed.select(
        F.col(key).alias("k"), F.col("id").alias("a"), F.struct(*BOX).alias("p"), F.col("level"),
        cell("x", F.col("level")).alias("i"), cell("y", F.col("level")).alias("j"), F.col("level").alias("at"))
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    asked = placed.select(F.col(key).alias("k"), F.col("id").alias("b"), *BOX, F.col("level"), F.explode(F.array(F.col("level"), F.col("level") - 1)).alias("at"))
    asked = asked.select("k", "b", F.struct(*BOX).alias("q"), F.col("level").alias("level_b"), "at", cell("x", F.col("at")).alias("i"), cell("y", F.col("at")).alias("j"))
    asked = asked.withColumn("di", F.explode(near)).withColumn("dj", F.explode(near)).select(
        "k", "b", "q", "level_b", "at", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
    met = home.join(asked.hint("merge"), ["k", "at", "i", "j"])
    close = _similar(F.col("p"), F.col("q"), eps)
    # Boxes of one level meet from both sides, those of neighbouring levels once.
    once = (F.col("level_b") > F.col("level")) | (F.col("a") < F.col("b"))
    return met.where(close & once & (F.col("a") != F.col("b"))).select(
        F.col("k").alias(key), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def linked_classes(boxes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``id``, ``class`` (smallest id that can be reached) of every box."""
    return boxes.select("id").join(_classes(pairs).hint("merge"), "id", "left").select("id", F.coalesce("class", "id").alias("class"))


def _classes(pairs: DataFrame) -> DataFrame:
    """``id``, ``class`` (smallest id that can be reached) of the boxes in pairs.

    Each round takes the smallest class around a box, then that class's own class; the number
    of rounds grows with the logarithm of the longest chain.
    """
    ways = kept(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    now = kept(ways.select(F.col("a").alias("id")).distinct().withColumn("class", F.col("id")))
    while True:
        around = ways.join(now.select(F.col("id").alias("b"), "class").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class").alias("around"))
        least = now.join(around.hint("merge"), "id").select("id", F.least("class", "around").alias("class"), (F.col("around") < F.col("class")).alias("moved"))
        held = kept(least)
        if held.where("moved").isEmpty():
            now = held.drop("moved")
            break
        jump = held.select(F.col("id").alias("class"), F.col("class").alias("further"))
        now = kept(held.join(jump.hint("merge"), "class").select("id", F.least("class", "further").alias("class")))
    return now


def group_boxes(boxes: DataFrame, key: str, least: int = 3, eps: float = 0.2) -> DataFrame:
    """``key``, ``n``, ``x``, ``y``, ``w``, ``h``: mean boxes of classes of at least ``least`` similar boxes.

    ``boxes`` has ``id`` (unique), ``key`` and the box.  A class inside another one (widened by
    ``eps`` of its size) goes if it has fewer than 3 boxes, or the other has more than 3 and
    more than itself.  Equal boxes of a key count each; boxes with a null are left out.
    """
    whole = boxes.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("id", key, *BOX)])).select("id", key, *BOX)
    # Equal boxes are one while links are sought: copies would meet all pairs.
    one = kept(whole.groupBy(key, *BOX).agg(F.min("id").alias("id"), F.count("*").alias("times")))
    of = _classes(similar_pairs(one, key, eps))
    means = [(F.sum(F.col(c) * F.col("times")) / F.sum("times")).alias(c) for c in BOX]
    linked = one.join(of.hint("merge"), "id").groupBy(key, "class").agg(F.sum("times").alias("n"), *means).where(F.col("n") >= least)
    # A box without a similar one is a class of its own, large enough only if it is repeated.
    alone = one.where(F.col("times") >= least).join(of.hint("merge"), "id", "left_anti").select(
        key, F.col("id").alias("class"), F.col("times").alias("n"), *[(F.col(c) * F.col("times") / F.col("times")).alias(c) for c in BOX])
    groups = kept(linked.unionByName(alone))
    other = groups.select(key, *[F.col(c).alias(f"{c}_o") for c in ("class", "n", *BOX)])
    dx, dy = F.col("w_o") * eps, F.col("h_o") * eps
    inside = (
        (F.col("class") != F.col("class_o")) & (F.col("x") >= F.col("x_o") - dx) & (F.col("y") >= F.col("y_o") - dy)
        & (F.col("x") + F.col("w") <= F.col("x_o") + F.col("w_o") + dx) & (F.col("y") + F.col("h") <= F.col("y_o") + F.col("h_o") + dy)
        & ((F.col("n_o") > F.greatest(F.lit(3), F.col("n"))) | (F.col("n") < 3)))
    within = groups.join(other.hint("merge"), key).where(inside).select(key, "class").distinct()
    return groups.join(within.hint("merge"), [key, "class"], "left_anti").select(key, "n", *BOX)


def locate(
    images: DataFrame, stored: DataFrame, boxes: DataFrame, key: str, width: float, height: float, least: int = 3,
) -> DataFrame:
    """``key``, ``cx``, ``cy``, ``origin`` of every image: its stored centre, or else a detected one.

    A stored centre (``cx``, ``cy``) counts if it lies inside the image.  Without one, the
    grouped detection nearest to the image's middle does, if within a quarter of the width;
    else the middle of a 20 x 20 box there.  ``stored`` has one row per key at most.
    """
    inside = rect_contains([F.lit(0.0), F.lit(0.0), F.lit(width), F.lit(height)], F.col("sx"), F.col("sy"))
    known = images.select(key).join(stored.select(key, F.col("cx").alias("sx"), F.col("cy").alias("sy")).hint("merge"), key, "left").withColumn(
        "inside", F.coalesce(inside, F.lit(False)))
    order = [F.col(c) for c in BOX]
    found = nearest_box(group_boxes(boxes, key, least), key, F.lit(width / 2), F.lit(height / 2), order, width)
    both = known.join(found.hint("merge"), key, "left")
    hit = F.coalesce(F.col("detected"), F.lit(False))
    return both.select(
        key, F.when(F.col("inside"), F.col("sx")).when(hit, F.col("x") + F.col("w") / 2).otherwise(width / 2).alias("cx"),
        F.when(F.col("inside"), F.col("sy")).when(hit, F.col("y") + F.col("h") / 2).otherwise(height / 2).alias("cy"),
        F.when(F.col("inside"), "stored").when(hit, "detected").otherwise("default").alias("origin"))
