"""Pixel-level operators: images are ``(id, px ARRAY)`` row-major with a known width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cinestat.functions.bind import let


def explode_pixels(df: DataFrame, id_: str, px: str, width: int) -> DataFrame:
    """Long form ``(id, y, x, v)``; a narrow operation."""
    long = df.select(id_, F.posexplode(px).alias("i", "v"))
    return long.select(
        id_, F.floor(F.col("i") / width).cast("int").alias("y"),
        F.pmod(F.col("i"), F.lit(width)).cast("int").alias("x"), F.col("v").cast("double").alias("v"),
    )


def image_moments(pixels: DataFrame, id_: str) -> DataFrame:
    """Zeroth and first moments and the centroid; one row per image is shuffled."""
    m = pixels.groupBy(id_).agg(
        F.sum("v").alias("m00"), F.sum(F.col("x") * F.col("v")).alias("m10"), F.sum(F.col("y") * F.col("v")).alias("m01")
    )
    return m.select("*", F.try_divide("m10", "m00").alias("cx"), F.try_divide("m01", "m00").alias("cy"))


def moment_ellipse(pixels: DataFrame, id_: str, least: int = 5) -> DataFrame:
    """Centre, full axes and angle (degrees) of the ellipse with the same weighted second moments.

    Sums per image, then the eigenvalues of the 2x2 covariance in closed form; images with
    fewer than ``least`` pixels have no row.
    """
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    sums = pixels.groupBy(id_).agg(
        F.count("*").alias("n"), *[
            (F.sum(v * f) / F.sum(v)).alias(c) for c, f in (("cx", x), ("cy", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))
        ],
    ).where(F.col("n") >= least)
    c = sums.select(
        id_, "cx", "cy", (F.col("xx") - F.col("cx") * F.col("cx")).alias("p"), (F.col("yy") - F.col("cy") * F.col("cy")).alias("q"),
        (F.col("xy") - F.col("cx") * F.col("cy")).alias("o"),
    )
    t = (F.col("p") + F.col("q")) / 2
    d = F.sqrt(F.pow((F.col("p") - F.col("q")) / 2, F.lit(2)) + F.col("o") * F.col("o"))
    return c.select(
        id_, "cx", "cy", (4 * F.sqrt(t + d)).alias("width"), (4 * F.sqrt(F.greatest(t - d, F.lit(0.0)))).alias("height"),
        (F.degrees(F.atan2(2 * F.col("o"), F.col("p") - F.col("q"))) / 2).alias("angle"),
    )


def soft_mean(pixels: DataFrame, id_: str, value: str, weight: Column) -> DataFrame:
    """Mean under a soft mask and under its complement."""
    return pixels.groupBy(id_).agg(
        (F.sum(F.col(value) * weight) / F.sum(weight)).alias("inside"),
        (F.sum(F.col(value) * (1 - weight)) / F.sum(1 - weight)).alias("outside"),
    )


def masked_radius(pixels: DataFrame, id_: str, value: str, cx: Column, cy: Column, above: float = 0.5) -> DataFrame:
    """Mean distance to a point over the pixels above a threshold."""
    d = F.sqrt((F.col("x") - cx) ** 2 + (F.col("y") - cy) ** 2)
    return pixels.where(F.col(value) > above).groupBy(id_).agg(F.avg(d).alias("radius"), F.count("*").alias("n"))


def array_mean(px: Column) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda a, v: a + v) / F.size(px)


def rescale_max(px: Column) -> Column:
    return let(F.array_max(px), lambda top: F.transform(px, lambda v: F.try_divide(v, top)))


def rescale_minmax(px: Column) -> Column:
    ends = F.struct(F.array_min(px).alias("lo"), F.array_max(px).alias("hi"))
    return let(ends, lambda e: F.transform(px, lambda v: F.try_divide(v - e["lo"], e["hi"] - e["lo"])))


def centre(px: Column) -> Column:
    return let(array_mean(px), lambda m: F.transform(px, lambda v: v - m))


def square_sum(px: Column) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda a, v: a + v * v)


def standardize(px: Column) -> Column:
    """(x - mean) / population deviation of an image."""

    def scaled(c: Column) -> Column:
        return let(F.sqrt(square_sum(c) / F.size(c)), lambda s: F.transform(c, lambda v: F.try_divide(v, s)))

    return let(centre(px), scaled)


def global_contrast(
    px: Column, *, scale: float = 1.0, subtract_mean: bool = True,
    use_std: bool = False, sqrt_bias: float = 0.0, min_divisor: float = 1e-8,
) -> Column:
    """Subtract the mean and divide by the norm (or the sample deviation) of an image."""

    def divided(c: Column) -> Column:
        energy = square_sum(c)
        if use_std:  # the deviation is around the mean even when it was not subtracted
            energy = square_sum(centre(c)) / F.greatest(F.size(c) - 1, F.lit(1))
        norm = F.sqrt(F.lit(sqrt_bias) + energy) / F.lit(scale)
        floored = let(norm, lambda s: F.when(s < min_divisor, 1.0).otherwise(s))
        return let(floored, lambda s: F.transform(c, lambda v: v / s))

    return let(centre(px) if subtract_mean else px, divided)


def crop(px: Column, width: int, x0: Column | int, y0: Column | int, w: int, h: int) -> Column:
    """Sub-image of fixed size at an offset."""
    x0 = F.lit(x0) if isinstance(x0, int) else x0
    y0 = F.lit(y0) if isinstance(y0, int) else y0
    rows = F.sequence(F.lit(0), F.lit(h - 1))
    return F.flatten(F.transform(rows, lambda r: F.slice(px, (y0 + r) * width + x0 + 1, w)))


def transpose(px: Column, width: int, height: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(width * height - 1)),
        lambda i: F.get(px, (F.pmod(i, F.lit(height)) * width + F.floor(i / height)).cast("int")),
    )


def resize_bilinear(px: Column, width: int, height: int, out_w: int, out_h: int) -> Column:
    """Bilinear resampling with pixel centres at half integers and clamped borders."""

    def axis(i: Column, n: int, n_out: int) -> Column:
        at = F.greatest((i + 0.5) * F.lit(n / n_out) - 0.5, F.lit(0.0))
        return let(
            at,
            lambda a: F.struct(
                F.floor(a).cast("int").alias("p"),
                F.least(F.floor(a) + 1, F.lit(n - 1)).cast("int").alias("q"), (a - F.floor(a)).alias("f"),
            ),
        )

    def sample(img: Column, b: Column) -> Column:
        x, y = b["x"], b["y"]
        top = F.get(img, y["p"] * width + x["p"]) * (1 - x["f"]) + F.get(img, y["p"] * width + x["q"]) * x["f"]
        low = F.get(img, y["q"] * width + x["p"]) * (1 - x["f"]) + F.get(img, y["q"] * width + x["q"]) * x["f"]
        return top * (1 - y["f"]) + low * y["f"]

    def resampled(img: Column) -> Column:
        def one(i: Column) -> Column:
            both = F.struct(
                axis(F.pmod(i, F.lit(out_w)), width, out_w).alias("x"),
                axis(F.floor(i / out_w), height, out_h).alias("y"),
            )
            return let(both, lambda b: sample(img, b))

        return F.transform(F.sequence(F.lit(0), F.lit(out_w * out_h - 1)), one)

    return let(px, resampled)


def warp_affine(px: Column, width: int, height: int, inverse: list[list[Column]], out_w: int, out_h: int) -> Column:
    """Image whose pixel (x, y) is the source at ``inverse (x, y, 1)``, bilinear, zero outside.

    The matrix (2x3) is made of columns: every row of the table is warped in its own way,
    inside the JVM.  A NULL image, or a NULL in the matrix, gives NULL.
    """
    names = [f"m{i}{j}" for i in range(2) for j in range(3)]
    cells = [c.cast("double") for row in inverse for c in row]
    bound = F.struct(px.alias("px"), *[c.alias(n) for c, n in zip(cells, names)])

    def one(t: Column, i: Column) -> Column:
        x, y = F.pmod(i, F.lit(out_w)), F.floor(i / out_w)
        at = F.struct(*[(t[f"m{k}0"] * x + t[f"m{k}1"] * y + t[f"m{k}2"]).alias(n) for k, n in enumerate("xy")])

        def sample(a: Column) -> Column:
            low = {c: F.floor(a[c]).cast("int") for c in "xy"}

            def tap(dx: int, dy: int) -> Column:
                u, v = low["x"] + dx, low["y"] + dy
                inside = (u >= 0) & (u < width) & (v >= 0) & (v < height)
                wx = a["x"] - low["x"] if dx else 1 - (a["x"] - low["x"])
                wy = a["y"] - low["y"] if dy else 1 - (a["y"] - low["y"])
                return F.when(inside, F.get(t["px"], v * width + u) * wx * wy).otherwise(0.0)

            return tap(0, 0) + tap(1, 0) + tap(0, 1) + tap(1, 1)

        return let(at, sample)

    known = cells[0].isNotNull()
    for c in cells[1:]:
        known = known & c.isNotNull()
    return F.when(px.isNotNull() & known, let(bound, lambda t: F.transform(
        F.sequence(F.lit(0), F.lit(out_w * out_h - 1)), lambda i: one(t, i))))


def five_crops(px: Column, width: int, height: int, size: int) -> Column:
    """The four corner crops and the centre crop, as an array of images."""
    right, low = width - size, height - size
    corners = [(0, 0), (right, low), (0, low), (right, 0), (right // 2, low // 2)]
    return F.array(*[crop(px, width, x, y, size, size) for x, y in corners])


def pad_count(px: Column, n: int) -> Column:
    """Repeat an array cyclically (or cut it) to n entries."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(px, F.pmod(i, F.size(px))))
