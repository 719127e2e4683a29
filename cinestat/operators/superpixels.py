"""Superpixels as a range join between pixels and cluster centres.

Pixels are placed once by (image, grid cell) and never move again; every round
shuffles only the centres, replicated to the cells their window touches.  Images whose
centres rest leave the working set.  The same plan serves many small images and single
images larger than one executor.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cinestat.functions.bind import let
from cinestat.functions.stencils import gradient_magnitude, map_images
from cinestat.operators.pixels import explode_pixels
from cinestat.session import cut_lineage, kept, settle

Distance = Callable[[Column], Column]

RESTS = "__rests"

# Rounds between two looks for images at rest.
CHECKED = 3


def grid_step(width: int, height: int, superpixels: int) -> int:
    return int(math.sqrt(width * height / superpixels))


def seed_centres(images: DataFrame, id_: str, px: str, width: int, height: int, step: int, radius: int = 5) -> DataFrame:
    """Regular grid of centres, each moved to the smallest gradient of its window.

    The window is clipped to the image and half-open on the far side; the first
    minimum in row order wins.
    """
    grads = map_images(images.select(id_, px), px, gradient_magnitude, width, "grad")
    grid = [
        (x, y)
        for x in range(step, math.ceil(width - step // 2), step)
        for y in range(step, math.ceil(height - step // 2), step)
    ]
    spots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in grid])
    placed = grads.select(id_, px, "grad", F.posexplode(spots).alias("c", "at"))
    x0, y0 = F.greatest(F.col("at.x") - radius, F.lit(0)), F.greatest(F.col("at.y") - radius, F.lit(0))
    x1 = F.least(F.col("at.x") + radius, F.lit(width)) - 1
    y1 = F.least(F.col("at.y") + radius, F.lit(height)) - 1
    rows = F.transform(
        F.sequence(y0, y1),
        lambda y: F.transform(F.sequence(x0, x1), lambda x: F.struct(F.get("grad", y * width + x).alias("g"), (y * width + x).alias("i"))),
    )
    best = placed.select(id_, px, "c", F.array_min(F.flatten(rows))["i"].alias("i"))
    return best.select(
        id_, "c", F.get(px, F.col("i")).cast("double").alias("color"),
        (F.col("i") % width).alias("cx"), F.floor(F.col("i") / width).cast("int").alias("cy"),
    )


def _cells(cell: int) -> list[Column]:
    return [F.floor(F.col("x") / cell).cast("int").alias("gx"), F.floor(F.col("y") / cell).cast("int").alias("gy")]


def place_pixels(pixels: DataFrame, id_: str, cell: int, centres: DataFrame) -> DataFrame:
    """Pixels placed and sorted by (image, cell), with an empty hit."""
    fields = T.StructType([f for f in centres.schema.fields if f.name != id_])
    hit = F.lit(None).cast(fields)
    placed = pixels.select("*", *_cells(cell), hit.alias("hit"))
    return placed.repartition(id_, "gx", "gy").sortWithinPartitions(id_, "gx", "gy")


def _touched(c: str, cell: int, reach: float, size: int | None) -> Column:
    """Numbers of the cells of one axis that a centre's window touches (inside the image, if its size is known)."""
    first = F.greatest(F.floor(F.floor(F.col(c) - reach) / cell), F.lit(0)).cast("int")
    last = F.floor((F.ceil(F.col(c) + reach) - 1) / cell).cast("int")
    return F.sequence(first, last if size is None else F.least(last, F.lit((size - 1) // cell)))


def assign(
    pixels: DataFrame, centres: DataFrame, id_: str, cell: int, reach: float, distance: Distance, size: tuple[int, int] | None = None,
) -> DataFrame:
    """Nearest centre within the square window of half-width ``reach``.

    The centres a cell can see form one short array, so the join is many-to-one: the
    pixels stay placed and sorted by cell, and no candidate pair becomes a row.  Ties
    go to the lowest centre; pixels outside every window keep what they had (``hit``).  A mark
    ``rests`` of an image's centres is passed on to its pixels.
    """
    fields = [c for c in centres.columns if c not in (id_, RESTS)]
    marks = [F.max(RESTS).alias(RESTS)] if RESTS in centres.columns else []
    near = (
        centres.select("*", F.explode(_touched("cx", cell, reach, size and size[0])).alias("gx"))
        .select("*", F.explode(_touched("cy", cell, reach, size and size[1])).alias("gy"))
        .groupBy(id_, "gx", "gy").agg(F.collect_list(F.struct(*fields)).alias("near"), *marks)
    )
    joined = pixels.join(near.hint("shuffle_merge"), [id_, "gx", "gy"], "left")

    def inside(c: Column) -> Column:
        x, y, r = F.col("x"), F.col("y"), F.lit(reach)
        return (
            (x >= F.floor(c["cx"] - r)) & (x < c["cx"] + r) & (y >= F.floor(c["cy"] - r)) & (y < c["cy"] + r)
        )

    ranked = F.transform(
        F.filter("near", inside), lambda c: F.struct(distance(c).alias("d"), c["c"].alias("c"), c.alias("centre"))
    )
    carried = [id_, "gx", "gy", "y", "x", "v"]
    rests = [F.coalesce(RESTS, F.lit(False)).alias(RESTS)] if marks else []
    return joined.select(*carried, F.coalesce(F.array_min(ranked)["centre"], "hit").alias("hit"), *rests)


def update_centres(state: DataFrame, id_: str) -> DataFrame:
    """Mean colour and integer mean position of every non-empty cluster."""
    m = state.where(F.col("hit").isNotNull()).groupBy(id_, F.col("hit.c").alias("c")).agg(
        F.avg("v").alias("color"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.count("*").alias("n")
    )
    return m.select(
        id_, "c", "color", F.floor(F.col("sx") / F.col("n")).cast("int").alias("cx"),
        F.floor(F.col("sy") / F.col("n")).cast("int").alias("cy"),
    )


def _squared(c: Column) -> tuple[Column, Column]:
    color, dx, dy = F.col("v") - c["color"], F.col("x") - c["cx"], F.col("y") - c["cy"]
    return color * color, dx * dx + dy * dy


def slic_distance(nc: float, ns: float) -> Distance:
    def distance(c: Column) -> Column:
        color, plane = _squared(c)
        return F.sqrt(color / F.lit(nc * nc) + plane / F.lit(float(ns * ns)))

    return distance


def _marked(before: DataFrame, after: DataFrame, id_: str) -> DataFrame:
    """``after`` and whether all centres of the image are those of the round before (means of the same pixels may differ in the last digit)."""
    values = [c for c in after.columns if c not in (id_, "c")]
    old = before.select(F.col(id_).alias("id_o"), F.col("c").alias("c_o"), *[F.col(v).alias(f"{v}_o") for v in values])
    met = after.join(old, (F.col(id_) == F.col("id_o")) & (F.col("c") == F.col("c_o")), "full")
    far = [F.coalesce(F.abs(F.col(v) - F.col(f"{v}_o")) > 1e-12, F.lit(True)) for v in values]
    rests = met.groupBy(F.coalesce(id_, "id_o").alias("id_o")).agg((~F.max(reduce(lambda a, b: a | b, far))).alias(RESTS))
    return after.join(rests.hint("merge"), F.col(id_) == F.col("id_o")).drop("id_o")


def _rounds(
    pixels: DataFrame, centres: DataFrame, id_: str, cell: int, reach: float, distance: Distance,
    update: Callable[[DataFrame, str], DataFrame], iterations: int, cut_every: int, size: tuple[int, int],
) -> DataFrame:
    """Alternate assignment and update.

    The pixels of a round are cached and the few centres written: writing them fills
    the cache in the same job and keeps the plan from mentioning a round twice.  The
    pixels themselves are cut every few rounds.  An image whose centres have not moved is
    assigned once more, written and left out of the rounds that follow: all further ones
    would give the same.  An image of few cells is one cell.
    """
    def labelled(df: DataFrame) -> DataFrame:
        return df.select(id_, "y", "x", "v", F.coalesce("hit.c", F.lit(-1)).alias("label"))

    cell = max(size) if max(size) <= 4 * cell else cell
    order = [id_, "gx", "gy"]
    state = held = settle(place_pixels(pixels, id_, cell, centres))
    done: list[DataFrame] = []
    for i in range(iterations - 1):
        before = centres.drop(RESTS)
        nxt = assign(state, centres, id_, cell, reach, distance, size)
        if (i + 1) % cut_every == 0:
            nxt = cut_lineage(nxt).repartition(*order).sortWithinPartitions(*order)
        nxt = nxt.persist()
        state = nxt
        if RESTS in nxt.columns:
            done.append(kept(labelled(nxt.where(RESTS))))
            state = nxt.where(~F.col(RESTS)).drop(RESTS)
        centres = cut_lineage(update(state, id_))
        held.unpersist()
        held = nxt
        if i % CHECKED == CHECKED - 1:
            centres = kept(_marked(before, centres, id_))
            if centres.where(~F.col(RESTS)).isEmpty():
                break
    if iterations:
        state = assign(state, centres.drop(RESTS), id_, cell, reach, distance, size)
    return reduce(DataFrame.unionByName, [*done, labelled(state)])


def slic(
    images: DataFrame, id_: str, px: str, width: int, height: int, *, superpixels: int, nc: float,
    iterations: int = 25, radius: int = 5, cut_every: int = 8,
) -> DataFrame:
    """Cluster every image; returns ``(id, y, x, v, label)`` with the final labels."""
    step = grid_step(width, height, superpixels)
    reach = 1.5 * step
    centres = seed_centres(images, id_, px, width, height, step, radius)
    return _rounds(
        explode_pixels(images, id_, px, width), centres, id_, math.ceil(reach) + 1, reach,
        slic_distance(nc, step), update_centres, iterations, cut_every, (width, height),
    )


def slico(
    images: DataFrame, id_: str, px: str, width: int, height: int, *, region: int,
    iterations: int = 10, cut_every: int = 8,
) -> DataFrame:
    """Adaptive variant: colour distances are scaled by the largest one a cluster has seen.

    Regular centres, window of one region size, squared distances.  ``maxc`` is kept
    per cluster and only grows.
    """
    nx, ny = int(0.5 + width / region), int(0.5 + height / region)
    ex, ey = (width - nx * region) / max(nx, 1), (height - ny * region) / max(ny, 1)
    grid = [
        (min(int(i * (region + ex) + region / 2), width - 1), min(int(j * (region + ey) + region / 2), height - 1))
        for j in range(ny) for i in range(nx)
    ]
    spots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in grid])
    centres = images.select(id_, px, F.posexplode(spots).alias("c", "at")).select(
        id_, "c", F.get(px, F.col("at.y") * width + F.col("at.x")).cast("double").alias("color"),
        F.col("at.x").cast("double").alias("cx"), F.col("at.y").cast("double").alias("cy"),
        F.lit(1.1754944e-38).alias("maxc"),
    )

    def distance(c: Column) -> Column:
        color, plane = _squared(c)
        return color / c["maxc"] + plane / F.lit(float(region * region))

    def update(state: DataFrame, key: str) -> DataFrame:
        color, _ = _squared(F.col("hit"))
        return state.where(F.col("hit").isNotNull()).groupBy(key, F.col("hit.c").alias("c")).agg(
            F.avg("v").alias("color"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
            F.greatest(F.max(color), F.max("hit.maxc")).alias("maxc"),
        )

    pixels = explode_pixels(images, id_, px, width)
    return _rounds(pixels, centres, id_, region + 1, float(region), distance, update, iterations, cut_every, (width, height))


def cluster_means(labelled: DataFrame, id_: str) -> DataFrame:
    """Mean value of every cluster."""
    return labelled.groupBy(id_, "label").agg(F.avg("v").alias("mean"), F.count("*").alias("n"))


def contour_pixels(labelled: DataFrame, id_: str) -> DataFrame:
    """Pixels with at least two of eight neighbours in another cluster (no suppression).

    Every pixel offers its label to its neighbours; the join is an equi-join.
    """
    ring = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
    offers = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ring]))
    sent = labelled.select(id_, "x", "y", F.col("label").alias("other"), offers.alias("o")).select(
        id_, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"), "other"
    )
    met = labelled.select(id_, "x", "y", "label").join(sent, [id_, "x", "y"])
    differing = F.sum((F.col("label") != F.col("other")).cast("int"))
    return met.groupBy(id_, "x", "y").agg(differing.alias("differing")).where(F.col("differing") >= 2)


def block_label(x: Column, y: Column, width: int, height: int, nw: int, nh: int) -> Column:
    """Label of the equal grid of nw x nh blocks; the last row and column absorb the rest."""
    by = F.least(F.floor(y / (height // nh)), F.lit(nh - 1))
    bx = F.least(F.floor(x / (width // nw)), F.lit(nw - 1))
    return (by * nw + bx).cast("int")


def block_histograms(pixels: DataFrame, id_: str, block: Column, bins: Column) -> DataFrame:
    """Histogram of intensity bins per block; merging blocks is a sum over rows."""
    return pixels.groupBy(id_, block.alias("block"), bins.alias("bin")).agg(F.count("*").alias("n"))


def histogram_overlap(a: Column, b: Column) -> Column:
    """Intersection of two normalised histograms held as arrays."""

    def both(t: Column) -> Column:
        sa = F.aggregate(t["a"], F.lit(0.0), lambda s, v: s + v)
        sb = F.aggregate(t["b"], F.lit(0.0), lambda s, v: s + v)
        return let(
            F.struct(sa.alias("sa"), sb.alias("sb")),
            lambda n: F.aggregate(
                F.zip_with(t["a"], t["b"], lambda u, v: F.least(u / n["sa"], v / n["sb"])), F.lit(0.0), lambda s, v: s + v
            ),
        )

    return let(F.struct(a.alias("a"), b.alias("b")), both)
