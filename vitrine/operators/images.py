"""Image statistics over a table of sampled pixels.

Pixels come as (image_id, x, y, r, g, b) rows of a small fixed-size sample (50 x 50). They are
gathered once into one array per image; everything after that is row-local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sample side, border share, subject distance and smallest subject share.
SAMPLE_SIDE = 50
BORDER_FRACTION = 0.10
SUBJECT_DISTANCE = 60.0
MIN_SUBJECT_FRACTION = 0.02
# Color naming limits and the hue of each chromatic name, in tie order.
ACHROMATIC_SATURATION = 0.15
BLACK_LIGHTNESS = 0.20
WHITE_LIGHTNESS = 0.85
HUES = (("red", 0.0), ("orange", 39.0), ("yellow", 60.0), ("green", 120.0), ("blue", 240.0),
        ("purple", 300.0), ("pink", 350.0), ("brown", 25.0))
# Brightness and pixel-count buckets, confidence of image signals.
DARK_MAX, BRIGHT_MIN = 0.35, 0.60
LOW_PIXELS, MEDIUM_PIXELS = 250_000, 1_000_000
IMAGE_CONFIDENCE = 0.7


def pack_pixels(pixels: DataFrame, side: int = SAMPLE_SIDE) -> DataFrame:
    """One row per image with its sampled pixels in row-major order."""
    pixel = F.struct((F.col("y") * side + F.col("x")).alias("at"), "x", "y", "r", "g", "b")
    return pixels.groupBy("image_id").agg(F.array_sort(F.collect_list(pixel)).alias("pixels"))


def background(pixels: Column, side: int) -> Column:
    """Per-channel upper median of the border ring."""
    margin = max(1, round(side * BORDER_FRACTION))
    ring = F.filter(pixels, lambda p: (p["x"] < margin) | (p["y"] < margin)
                    | (p["x"] >= side - margin) | (p["y"] >= side - margin))

    def middle(channel: str) -> Column:
        values = F.array_sort(F.transform(ring, lambda p: p[channel]))
        return F.try_element_at(values, (F.size(values) / 2).cast("int") + 1)

    return F.struct(*[middle(c).alias(c) for c in ("r", "g", "b")])


def subject(pixels: Column, back: Column) -> Column:
    """Pixels far from the background; empty when too few are."""
    def squared(p: Column) -> Column:
        return sum(((p[c] - back[c]) * (p[c] - back[c]) for c in ("r", "g", "b")), F.lit(0))

    far = F.filter(pixels, lambda p: squared(p) > SUBJECT_DISTANCE * SUBJECT_DISTANCE)
    enough = F.size(far) >= F.size(pixels) * MIN_SUBJECT_FRACTION
    return F.when(enough, far).otherwise(F.slice(far, 1, 0))


def dominant_color(pixels: Column) -> Column:
    """Most frequent color, the one seen first on ties: runs over the pixels sorted by color."""
    coded = F.array_sort(F.transform(pixels, lambda p: F.struct(
        (p["r"] * 65536 + p["g"] * 256 + p["b"]).cast("int").alias("code"),
        p["at"].cast("int").alias("at"))))
    start = F.struct(*[F.lit(v).alias(n) for n, v in (
        ("code", -1), ("n", 0), ("at", 0), ("best", -1), ("best_n", 0), ("best_at", 0))])

    def step(s: Column, p: Column) -> Column:
        same = s["code"] == p["code"]
        n = F.when(same, s["n"] + 1).otherwise(1)
        at = F.when(same, s["at"]).otherwise(p["at"])
        wins = (n > s["best_n"]) | ((n == s["best_n"]) & (at < s["best_at"]))
        return F.struct(
            p["code"].alias("code"), n.alias("n"), at.alias("at"),
            F.when(wins, p["code"]).otherwise(s["best"]).alias("best"),
            F.when(wins, n).otherwise(s["best_n"]).alias("best_n"),
            F.when(wins, at).otherwise(s["best_at"]).alias("best_at"))

    code = F.aggregate(coded, start, step, lambda s: s["best"])
    return F.struct(F.shiftright(code, 16).alias("r"), (F.shiftright(code, 8) % 256).alias("g"),
                    (code % 256).alias("b"))


def color_name(rgb: Column) -> Column:
    """Name by lightness when gray, else by the nearest hue on the circle."""
    r, g, b = (rgb[c] / F.lit(255.0) for c in ("r", "g", "b"))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    light, span = (high + low) / 2.0, high - low
    saturation = F.when(span == 0, 0.0).when(light <= 0.5, F.try_divide(span, high + low)).otherwise(
        F.try_divide(span, 2.0 - high - low))
    turn = (
        F.when(span == 0, 0.0)
        .when(r == high, F.try_divide(g - b, span))
        .when(g == high, 2.0 + F.try_divide(b - r, span))
        .otherwise(4.0 + F.try_divide(r - g, span))
    )
    hue = F.pmod(turn / 6.0, F.lit(1.0)) * 360.0

    def distance(degrees: float) -> Column:
        delta = F.abs(hue - degrees)
        return F.round(F.least(delta, 360.0 - delta), 9)

    nearest = F.array_min(F.array(*[
        F.struct(distance(d).alias("distance"), F.lit(i).alias("order"), F.lit(n).alias("name"))
        for i, (n, d) in enumerate(HUES)]))["name"]
    return (
        F.when(light <= BLACK_LIGHTNESS, "black")
        .when((saturation < ACHROMATIC_SATURATION) & (light >= WHITE_LIGHTNESS), "white")
        .when(saturation < ACHROMATIC_SATURATION, "gray")
        .otherwise(nearest)
    )


def brightness(pixels: Column) -> Column:
    """Mean luma in [0, 1]."""
    total = F.aggregate(pixels, F.lit(0.0), lambda s, p: s + (
        p["r"] * 0.299 + p["g"] * 0.587 + p["b"] * 0.114))
    return F.coalesce(F.try_divide(total, F.size(pixels) * F.lit(255.0)), F.lit(0.0))


def brightness_bucket(value: Column) -> Column:
    return F.when(value <= DARK_MAX, "dark").when(value >= BRIGHT_MIN, "bright").otherwise("medium")


def orientation(width: Column, height: Column) -> Column:
    return F.when(height > width, "portrait").when(width > height, "landscape").otherwise("square")


def resolution_bucket(width: Column, height: Column) -> Column:
    n = width.cast("long") * height.cast("long")
    return (F.when(n <= LOW_PIXELS, "low_resolution").when(n <= MEDIUM_PIXELS, "medium_resolution")
            .otherwise("high_resolution"))


def image_statistics(pixels: DataFrame, images: DataFrame, side: int = SAMPLE_SIDE) -> DataFrame:
    """Background, dominant color and its name, brightness and size buckets per image.

    ``images`` is (image_id, width, height).
    """
    packed = pack_pixels(pixels, side).withColumn("background", background(F.col("pixels"), side))
    packed = packed.withColumn("_subject", subject(F.col("pixels"), F.col("background")))
    has_subject = F.size("_subject") > 0
    packed = packed.withColumn("_used", F.when(has_subject, F.col("_subject")).otherwise(
        F.col("pixels")))
    stats = packed.withColumns({
        "subject_pixels": F.size("_subject"),
        "dominant": dominant_color(F.col("_used")),
        "brightness": brightness(F.col("_used")),
    }).withColumn("color_name", color_name(F.col("dominant")))
    width, height = F.col("width"), F.col("height")
    return stats.drop("pixels", "_subject", "_used").join(images, "image_id").withColumns({
        "brightness_bucket": brightness_bucket(F.col("brightness")),
        "orientation": orientation(width, height),
        "resolution": resolution_bucket(width, height),
        "aspect_ratio": width / height,
    })


def image_predictions(stats: DataFrame) -> DataFrame:
    """The color attribute of each image, as enrichment takes it."""
    return stats.select(
        F.col("image_id").alias("product_id"), F.lit("color").alias("attribute"),
        F.initcap("color_name").alias("value"), F.lit(IMAGE_CONFIDENCE).alias("confidence"),
        F.lit("image").alias("source"))


def image_tags(stats: DataFrame, first_position: int = 1000) -> DataFrame:
    """The four tags of each image, placed after all text tags."""
    names = F.array("orientation", "brightness_bucket", "resolution", "color_name")
    return stats.select(
        F.col("image_id").alias("product_id"), F.posexplode(names).alias("at", "tag")).select(
        "product_id", "tag", F.lit(IMAGE_CONFIDENCE).alias("confidence"),
        F.lit("image").alias("source"), (F.col("at") + first_position).alias("position"))


def color_histogram(pixels: DataFrame, bins: int = 8) -> DataFrame:
    """Unit-length joint RGB histogram per image: a default image vector of ``bins``^3 entries."""
    step = 256 // bins
    cell = (F.floor(F.col("r") / step) * bins * bins + F.floor(F.col("g") / step) * bins
            + F.floor(F.col("b") / step)).cast("int")
    counts = pixels.select("image_id", cell.alias("cell")).groupBy("image_id", "cell").agg(
        F.count("*").alias("n"))
    # At most bins^3 entries per image reach the gathering step.
    packed = counts.groupBy("image_id").agg(
        F.map_from_entries(F.collect_list(F.struct("cell", F.col("n").cast("double")))).alias("h"),
        F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(bins ** 3 - 1)), lambda i: (
        F.coalesce(F.try_element_at("h", i), F.lit(0.0)) / F.col("norm")))
    return packed.select("image_id", vector.alias("vector"))


def pixel_arrays(pixels: DataFrame, side: int) -> DataFrame:
    """(image_id, pixels): the channels of the ``side`` x ``side`` pixels of each whole image in rows, for a model."""
    rows = pixels.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "r", "g", "b"))).alias("p"))
    return rows.where(F.size("p") == side * side).select("image_id", F.flatten(F.transform("p", lambda p: F.array(
        p["r"].cast("double"), p["g"].cast("double"), p["b"].cast("double")))).alias("pixels"))
