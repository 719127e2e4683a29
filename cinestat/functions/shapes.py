"""Landmark shapes held as ``ARRAY<STRUCT<x,y>>``: areas, boxes, similarity, contours."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cinestat.functions.bind import let

POINTS = "array<struct<x:double,y:double>>"


def points(flat: Column) -> Column:
    """``x0,y0,x1,y1,...`` to points."""
    n = (F.size(flat) / 2).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(F.get(flat, 2 * i).cast("double").alias("x"), F.get(flat, 2 * i + 1).cast("double").alias("y")),
    )


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def polygon_area(pts: Column) -> Column:
    """Signed shoelace area; 0 below three points."""
    n = F.size(pts)
    terms = F.transform(
        pts,
        lambda p, i: p["x"] * (F.get(pts, F.pmod(i + 1, n))["y"] - F.get(pts, F.pmod(i - 1 + n, n))["y"]),
    )
    return F.when(n < 3, 0.0).otherwise(total(terms) / 2)


def bounding_box(pts: Column) -> Column:
    """``STRUCT<start_x,start_y,width,height,centroid_x,centroid_y>``."""
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    ends = F.struct(
        F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"),
        F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"),
    )
    return let(
        ends,
        lambda e: F.struct(
            e["x0"].alias("start_x"), e["y0"].alias("start_y"),
            (e["x1"] - e["x0"]).alias("width"), (e["y1"] - e["y0"]).alias("height"),
            (e["x0"] + (e["x1"] - e["x0"]) / 2).alias("centroid_x"),
            (e["y0"] + (e["y1"] - e["y0"]) / 2).alias("centroid_y"),
        ),
    )


def project(pts: Column, box: Column) -> Column:
    """Shape in the unit coordinates of a box."""

    def unit(b: Column) -> Column:
        return F.transform(
            pts,
            lambda p: F.struct(
                ((p["x"] - b["centroid_x"]) / (b["width"] / 2)).alias("x"),
                ((p["y"] - b["centroid_y"]) / (b["height"] / 2)).alias("y"),
            ),
        )

    return let(box, unit)


def reproject(pts: Column, box: Column) -> Column:
    """Inverse of :func:`project`."""

    def image(b: Column) -> Column:
        return F.transform(
            pts,
            lambda p: F.struct(
                (p["x"] * b["width"] / 2 + b["centroid_x"]).alias("x"),
                (p["y"] * b["height"] / 2 + b["centroid_y"]).alias("y"),
            ),
        )

    return let(box, image)


def centred(pts: Column) -> Column:
    """Shape moved so that its points average to the origin."""

    def mean(arr: Column, axis: str) -> Column:
        return total(F.transform(arr, lambda p: p[axis])) / F.size(arr)

    def around(b: Column) -> Column:
        return F.transform(
            b["pts"], lambda p: F.struct((p["x"] - b["cx"]).alias("x"), (p["y"] - b["cy"]).alias("y"))
        )

    def with_mean(arr: Column) -> Column:
        return let(F.struct(arr.alias("pts"), mean(arr, "x").alias("cx"), mean(arr, "y").alias("cy")), around)

    return let(pts, with_mean)


def spread(pts: Column) -> Column:
    """Size of a centred shape: root of the norm of its 2x2 scrambled covariance.

    The x and y columns are the two samples there, so the norm is sum (x-y)^2 / 2.
    """
    return F.sqrt(total(F.transform(pts, lambda p: (p["x"] - p["y"]) * (p["x"] - p["y"]))) / 2)


def similarity(a: Column, b: Column) -> Column:
    """Scale and rotation that carry centred ``b`` to centred ``a``."""

    def from_pairs(p: Column) -> Column:
        num = total(F.zip_with(p["a"], p["b"], lambda u, v: u["y"] * v["x"] - u["x"] * v["y"]))
        den = total(F.zip_with(p["a"], p["b"], lambda u, v: u["x"] * v["x"] + u["y"] * v["y"]))
        sums = F.struct(
            num.alias("num"), den.alias("den"), F.try_divide(spread(p["a"]), spread(p["b"])).alias("scale")
        )
        return let(sums, rotation)

    def rotation(s: Column) -> Column:
        norm = F.sqrt(s["num"] * s["num"] + s["den"] * s["den"])
        return F.struct(
            s["scale"].alias("scale"),
            F.try_divide(s["den"], norm).alias("cos"), F.try_divide(s["num"], norm).alias("sin"),
        )

    return let(F.struct(a.alias("a"), b.alias("b")), from_pairs)


def line_points(start: Column, end: Column) -> Column:
    """Bresenham raster of a segment as ``ARRAY<STRUCT<x,y>>`` from start to end.

    After k steps along the long axis the error is e0 - k*d + m*D with the smallest
    m that keeps it non-negative, hence m = max(0, ceil((k*d - e0) / D)) in integers.
    The raster runs from the smaller long-axis coordinate and is reversed if needed.
    """

    def turned(e: Column) -> Column:
        (x1, y1), (x2, y2) = ((e[n]["x"], e[n]["y"]) for n in ("s", "e"))
        steep = F.abs(y2 - y1) > F.abs(x2 - x1)
        return let(
            F.struct(
                steep.alias("steep"),
                F.when(steep, y1).otherwise(x1).alias("a1"), F.when(steep, x1).otherwise(y1).alias("b1"),
                F.when(steep, y2).otherwise(x2).alias("a2"), F.when(steep, x2).otherwise(y2).alias("b2"),
            ),
            ordered,
        )

    def ordered(t: Column) -> Column:
        swapped = t["a1"] > t["a2"]
        lo_b, hi_b = F.when(swapped, t["b2"]).otherwise(t["b1"]), F.when(swapped, t["b1"]).otherwise(t["b2"])
        long_ = F.abs(t["a2"] - t["a1"])
        return let(
            F.struct(
                t["steep"].alias("steep"), swapped.alias("swapped"),
                F.least(t["a1"], t["a2"]).alias("a"), lo_b.alias("b"),
                long_.alias("long"), F.abs(t["b2"] - t["b1"]).alias("short"),
                F.when(lo_b < hi_b, 1).otherwise(-1).alias("rise"), F.floor(long_ / 2).alias("e0"),
            ),
            raster,
        )

    def raster(o: Column) -> Column:
        def at(k: Column) -> Column:
            over = k * o["short"] - o["e0"]
            m = F.ceil(F.greatest(over, F.lit(0)) / F.greatest(o["long"], F.lit(1)))
            return let(F.struct((o["a"] + k).alias("a"), (o["b"] + o["rise"] * m).alias("b")), placed)

        def placed(p: Column) -> Column:
            return F.struct(
                F.when(o["steep"], p["b"]).otherwise(p["a"]).cast("int").alias("x"),
                F.when(o["steep"], p["a"]).otherwise(p["b"]).cast("int").alias("y"),
            )

        points_ = F.transform(F.sequence(F.lit(0), o["long"]), at)
        return let(points_, lambda r: F.when(o["swapped"], F.reverse(r)).otherwise(r))

    return let(F.struct(start.alias("s"), end.alias("e")), turned)


def dense_contour(pts: Column) -> Column:
    """Closed polygon of integer points rasterised segment by segment."""

    def segments(p: Column) -> Column:
        n = F.size(p)
        return F.flatten(F.transform(p, lambda q, i: line_points(q, F.get(p, F.pmod(i + 1, n)))))

    return let(pts, segments)


def circular_section(arr: Column, start: Column, stop: Column) -> Column:
    """Elements start..stop-1, wrapping past the end when stop <= start (0-based)."""
    head = F.slice(arr, start + 1, F.size(arr))
    return F.when(start < stop, F.slice(arr, start + 1, F.greatest(stop - start, F.lit(0)))).otherwise(
        F.concat(head, F.slice(arr, F.lit(1), stop))
    )


def middle(arr: Column) -> Column:
    return let(arr, lambda r: F.get(r, F.floor(F.size(r) / 2).cast("int")))


def first_index(arr: Column, point: Column) -> Column:
    """0-based position of the first equal point."""
    return (F.array_position(arr, point) - 1).cast("int")


def extreme_indices(contour: Column) -> Column:
    """Positions of the middle topmost and the middle bottommost point."""

    def pick(c: Column, end: Column) -> Column:
        return let(end, lambda e: first_index(c, middle(F.filter(c, lambda p: p["y"] == e))))

    def both(c: Column) -> Column:
        ys = F.transform(c, lambda p: p["y"])
        return F.array(pick(c, F.array_min(ys)), pick(c, F.array_max(ys)))

    return let(contour, both)


def double_landmarks(contour: Column, marks: Column) -> Column:
    """Insert the middle contour point between every two neighbouring landmarks."""

    def doubled(b: Column) -> Column:
        c, marks_ = b["c"], b["m"]

        def pair(m: Column, i: Column) -> Column:
            nxt = F.get(marks_, F.pmod(i + 1, F.size(marks_)))
            return let(
                F.struct(m.alias("m"), nxt.alias("n")),
                lambda e: F.array(e["m"], first_index(c, middle(circular_section(c, e["m"], e["n"])))),
            )

        return F.flatten(F.transform(marks_, pair))

    return let(F.struct(contour.alias("c"), marks.alias("m")), doubled)


def contour_landmarks(contour: Column, doublings: int = 3) -> Column:
    """Landmark positions: two extremes, doubled ``doublings`` times."""

    def marks(c: Column) -> Column:
        m = extreme_indices(c)
        for _ in range(doublings):
            m = double_landmarks(c, m)
        return F.transform(m, lambda i: F.get(c, i))

    return let(contour, marks)
