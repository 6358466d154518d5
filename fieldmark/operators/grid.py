"""Grid and time keys as column arithmetic: points to cells, cell centres, coarsening, tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import small_side

# The grid packs 21 latitude bits and 22 longitude bits under a prefix.
LAT_BITS, LNG_BITS = 21, 22
CELL_PREFIX = (1 << 60) | (21 << 52) | (0xAB << 44)
LAT_MAX, LNG_MAX = (1 << LAT_BITS) - 1, (1 << LNG_BITS) - 1
MERCATOR_LIMIT = 85.0511287798066
# Seconds of a slot by tempo; static has one slot.
TEMPO = {"static": 0, "slow": 365 * 86400, "d16": 16 * 86400, "d8": 8 * 86400, "medium": 30 * 86400, "fast": 86400, "ultra": 3600}
#: The 3 x 3 neighbourhood, row by row from the north-west.
OFFSETS = tuple((dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1))


def unbounded(x: Column) -> Column:
    """Null, NaN and infinite values."""
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def lat_q(lat: Column) -> Column:
    safe = F.when(unbounded(lat), 0.0).otherwise(F.greatest(F.least(lat, F.lit(90.0)), F.lit(-90.0)))
    return F.floor((safe + 90) / 180 * LAT_MAX + 0.5)


def lng_q(lat: Column, lng: Column) -> Column:
    """Longitude bucket: wrapped, the last one joined to the first, 0 at the poles."""
    safe = F.when(unbounded(lng), 0.0).otherwise(F.pmod(lng + 180, F.lit(360.0)) - 180)
    q = F.floor((safe + 180) / 360 * LNG_MAX + 0.5)
    row = lat_q(lat)
    return F.when((row == 0) | (row == LAT_MAX) | (q == LNG_MAX), F.lit(0).cast("bigint")).otherwise(q)


def to_cell(df: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    packed = F.lit(CELL_PREFIX) + F.shiftleft(lat_q(F.col(lat)), LNG_BITS) + lng_q(F.col(lat), F.col(lng))
    return df.withColumn("cell", packed)


def cell_row(cell: Column) -> Column:
    return F.shiftright(cell, LNG_BITS).bitwiseAND(LAT_MAX)


def cell_col(cell: Column) -> Column:
    return cell.bitwiseAND(LNG_MAX)


def with_center(df: DataFrame, cell: str = "cell") -> DataFrame:
    return df.withColumns(
        {
            "lat": cell_row(F.col(cell)) / LAT_MAX * 180 - 90,
            "lng": cell_col(F.col(cell)) / LNG_MAX * 360 - 180,
        }
    )


# Letters of a cell's text form.
CONSONANTS, VOWELS = "bcdfghjklmnpqrstvwxyz", "aeiouAEIOU"
SYLLABLES = (len(CONSONANTS) * len(VOWELS)) ** 2


def _digit_text(d: Column) -> Column:
    """A 16-bit digit as consonant, vowel, consonant, vowel; those beyond as z and four hex digits."""
    pick = lambda letters, i: F.substring(F.lit(letters), (i % len(letters) + 1).cast("int"), F.lit(1))
    v, c = len(VOWELS), len(CONSONANTS)
    word = F.concat(pick(CONSONANTS, F.floor(d / (v * c * v))), pick(VOWELS, F.floor(d / (c * v))), pick(CONSONANTS, F.floor(d / v)), pick(VOWELS, d))
    return F.when(d < SYLLABLES, word).otherwise(F.concat(F.lit("z"), F.lpad(F.lower(F.hex(d)), 4, "0")))


def cell_text(cell: Column) -> Column:
    """Text form of a cell: its four 16-bit digits, highest first, joined by dots."""
    return F.concat_ws(".", *[_digit_text(F.shiftrightunsigned(cell, at).bitwiseAND(0xFFFF)) for at in (48, 32, 16, 0)])


def _text_digit(word: Column) -> Column:
    place = lambda letters, i: F.instr(F.lit(letters), F.substring(word, i, 1)) - 1
    v, c = len(VOWELS), len(CONSONANTS)
    d = ((place(CONSONANTS, 1) * v + place(VOWELS, 2)) * c + place(CONSONANTS, 3)) * v + place(VOWELS, 4)
    spare = F.conv(F.substring(word, 2, 4), 16, 10).cast("int")
    return F.when(word.rlike(f"^([{CONSONANTS}][{VOWELS}]){{2}}$"), d).when(word.rlike("^z[0-9a-f]{4}$") & (spare >= SYLLABLES), spare)


def cell_of_text(text: Column) -> Column:
    """The cell of a text form; null for anything else."""
    words = F.split(text, r"\.")
    digits = [_text_digit(F.get(words, F.lit(i))).cast("bigint") for i in range(4)]
    return F.when(F.size(words) == 4, F.shiftleft(digits[0], 48) + F.shiftleft(digits[1], 32) + F.shiftleft(digits[2], 16) + digits[3])


def cell_dim(facts: DataFrame) -> DataFrame:
    """Distinct cells with centre, box (cut at the poles), text form and counts of facts and bands."""
    dim = with_center(facts.groupBy("cell").agg(F.count("*").alias("n_facts"), F.countDistinct("band").alias("n_bands")))
    half_lat, half_lng = 90 / LAT_MAX, 180 / LNG_MAX
    return dim.withColumns(
        {
            "lat_min": F.greatest(F.col("lat") - half_lat, F.lit(-90.0)), "lat_max": F.least(F.col("lat") + half_lat, F.lit(90.0)),
            "lng_min": F.col("lng") - half_lng, "lng_max": F.col("lng") + half_lng, "text": cell_text(F.col("cell")),
        }
    )


def to_pixel(points: DataFrame, rasters: DataFrame) -> DataFrame:
    """Row and column of every point (id, x, y, raster) on its raster, rounded to the nearest pixel.
    ``rasters``: (raster, x0, y0, dx, dy, width, height, nodata), the header: world place of pixel (0, 0)
    and the steps of a column and a row; one row per raster."""
    j = points.join(rasters, "raster")
    half_up = lambda v: F.floor(v + 0.5)
    return j.withColumns({"row": half_up((F.col("y") - F.col("y0")) / F.col("dy")), "col": half_up((F.col("x") - F.col("x0")) / F.col("dx"))})


def sample_points(points: DataFrame, pixels: DataFrame, rasters: DataFrame, bands: list[str]) -> DataFrame:
    """(id, band, value, kind, reason): every band's value at every point; outside the image and on nodata
    an absence. ``pixels``: (raster, band, row, col, value)."""
    at = to_pixel(points, rasters).withColumn("band", F.explode(F.array(*map(F.lit, bands))))
    inside = F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1)
    found = at.join(pixels, ["raster", "band", "row", "col"], "left")
    reason = F.when(~inside, "outside_image").when(F.col("value").isNull() | (F.col("value") == F.col("nodata")), "nodata")
    j = found.select("id", "band", "value", reason.alias("reason"))
    return j.select("id", "band", F.when(F.col("reason").isNull(), F.col("value")).alias("value"), F.when(F.col("reason").isNull(), "primary").otherwise("absence").alias("kind"), "reason")


def sample_windows(points: DataFrame, pixels: DataFrame, rasters: DataFrame, w: int, h: int) -> DataFrame:
    """(id, window): w x h pixels around every point, row by row; pixels outside the image or without a
    value are 0. ``pixels``: (raster, row, col, value)."""
    steps = F.array(*[F.struct(F.lit(r * w + c).alias("k"), F.lit(r - h // 2).alias("dr"), F.lit(c - w // 2).alias("dc")) for r in range(h) for c in range(w)])
    at = to_pixel(points, rasters).select("id", "raster", "nodata", "row", "col", F.explode(steps).alias("s"))
    at = at.select("id", "raster", "nodata", "s.k", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    value = F.coalesce(F.when(F.col("value") != F.col("nodata"), F.col("value")), F.lit(0.0))
    j = at.join(pixels, ["raster", "row", "col"], "left").select("id", F.struct("k", value.alias("v")).alias("x"))
    return j.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("window"))


def parent_cell(cell: Column, level: Column) -> Column:
    """The coarser cell at a level: so many low bits of row and column are dropped."""
    drop = lambda x: F.call_function("shiftleft", F.call_function("shiftright", x, level), level)
    return F.lit(CELL_PREFIX) + F.shiftleft(drop(cell_row(cell)), LNG_BITS) + drop(cell_col(cell))


def coarsen(df: DataFrame, levels: list[int], value: str = "num") -> DataFrame:
    """n, mean, min and max per parent at every level (bits dropped from row and column)."""
    level = F.explode(F.array(*map(F.lit, levels)))
    leveled = df.select("cell", F.col(value).alias("v"), level.alias("level"))
    return leveled.groupBy("level", parent_cell(F.col("cell"), F.col("level")).alias("parent")).agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")
    )


def to_tslot(df: DataFrame, unix: str, bands: DataFrame) -> DataFrame:
    """Slot and slot start of a unix time under the band's tempo (band, tempo)."""
    step = F.lit(0)
    for name, seconds in TEMPO.items():
        step = F.when(F.col("tempo") == name, seconds).otherwise(step)
    j = df.join(small_side(bands), "band").withColumn("__step", step)
    at = F.greatest(F.col(unix), F.lit(0))
    slot = F.when(F.col("__step") > 0, F.floor(at / F.col("__step"))).otherwise(0).cast("bigint")
    return j.withColumn("tslot", slot).withColumn("slot_start", F.col("tslot") * F.col("__step")).drop("__step")


def neighbours3x3(pixels: DataFrame, value: str = "value", row: str = "row", col: str = "col") -> DataFrame:
    """Nine-slot array of each pixel's neighbourhood, null where there is no pixel: every pixel is sent
    to the nine places that see it, one grouping by place."""
    sent = pixels.select(
        F.col(row).alias("r"),
        F.col(col).alias("c"),
        F.col(value).alias("v"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for i, (dr, dc) in enumerate(OFFSETS)])).alias("o"),
    ).select((F.col("r") - F.col("o.dr")).alias(row), (F.col("c") - F.col("o.dc")).alias(col), F.col("o.i").alias("i"), "v")
    names = [F.max(F.when(F.col("i") == i, F.col("v"))) for i in range(9)]
    return sent.groupBy(row, col).agg(F.array(*names).alias("n9")).where(F.get("n9", F.lit(4)).isNotNull())


def cover_cells(boxes: DataFrame, max_cells: int = 409_600) -> tuple[DataFrame, DataFrame]:
    """(cells of every box, boxes in error): the cells met in steps of half a grid pitch and less from the
    lower left corner, and those of all four corners. ``boxes``: (box_id, lon_min, lat_min, lon_max,
    lat_max); a box is in error if out of range, inverted or over ``max_cells`` cells."""
    dy, dx = 180.0 / (1 << LAT_BITS), 360.0 / (1 << LNG_BITS)

    def steps(lo: str, hi: str, d: float) -> Column:
        return F.floor((F.col(hi) - F.col(lo)) / d)

    bad = (
        F.when((F.abs("lat_min") > 90) | (F.abs("lat_max") > 90) | (F.abs("lon_min") > 180) | (F.abs("lon_max") > 180), "out_of_range")
        .when((F.col("lat_min") > F.col("lat_max")) | (F.col("lon_min") > F.col("lon_max")), "inverted")
        .when((steps("lat_min", "lat_max", dy) + 2) * (steps("lon_min", "lon_max", dx) + 2) > max_cells, "too_many_cells")
    )
    judged = boxes.withColumn("error", bad)
    good = judged.where("error is null")
    lats = good.select("box_id", "lon_min", "lon_max", F.explode(F.sequence(F.lit(0).cast("bigint"), steps("lat_min", "lat_max", dy))).alias("i"), F.col("lat_min").alias("y"))
    met = lats.select("box_id", (F.col("y") + F.col("i") * dy).alias("lat"), "lon_min", F.explode(F.sequence(F.lit(0).cast("bigint"), steps("lon_min", "lon_max", dx))).alias("j"))
    inner = met.select("box_id", "lat", (F.col("lon_min") + F.col("j") * dx).alias("lng"))
    corner = F.array(*[F.struct(F.col(y).alias("lat"), F.col(x).alias("lng")) for y in ("lat_min", "lat_max") for x in ("lon_min", "lon_max")])
    every = inner.unionByName(good.select("box_id", F.inline(corner)))
    return to_cell(every).select("box_id", "cell").distinct(), judged.where("error is not null").select("box_id", "error")


def cover_bbox(boxes: DataFrame, step: float, max_cells: int) -> tuple[DataFrame, DataFrame]:
    """(covering grid rows and columns, boxes in error) for (box_id, lon_min, lat_min, lon_max,
    lat_max); a box is in error if out of range, inverted or over ``max_cells``."""
    r0, r1 = F.floor(F.col("lat_min") / step), F.floor(F.col("lat_max") / step)
    c0, c1 = F.floor(F.col("lon_min") / step), F.floor(F.col("lon_max") / step)
    bad = (
        F.when((F.col("lat_min") > F.col("lat_max")) | (F.col("lon_min") > F.col("lon_max")), "inverted")
        .when((F.abs("lat_min") > 90) | (F.abs("lat_max") > 90) | (F.abs("lon_min") > 180) | (F.abs("lon_max") > 180), "out_of_range")
        .when((r1 - r0 + 1) * (c1 - c0 + 1) > max_cells, "too_many_cells")
    )
    judged = boxes.withColumn("error", bad)
    good = judged.where("error is null").select("box_id", F.explode(F.sequence(r0, r1)).alias("row"), c0.alias("c0"), c1.alias("c1"))
    return good.select("box_id", "row", F.explode(F.sequence("c0", "c1")).alias("col")), judged.where("error is not null").select("box_id", "error")


def tile_key(lat: Column, lng: Column, size: int) -> Column:
    """Name of the size-degree tile by its south-west corner, such as N10E020 or S05W030."""
    south, west = (F.floor(lat / size) * size).cast("int"), (F.floor(lng / size) * size).cast("int")
    return F.concat(
        F.when(south >= 0, "N").otherwise("S"), F.lpad(F.abs(south).cast("string"), 2, "0"),
        F.when(west >= 0, "E").otherwise("W"), F.lpad(F.abs(west).cast("string"), 3, "0"),
    )


def corner_tile(lat: Column, lng: Column, size: int = 10, padded: bool = True) -> Column:
    """Name of the size-degree tile by its north and west edge, such as 50N_100W; ``padded`` fills the
    numbers to two and three digits."""
    north, west = (F.ceil(lat / size) * size).cast("int"), (F.floor(lng / size) * size).cast("int")
    number = lambda x, n: F.lpad(F.abs(x).cast("string"), n, "0") if padded else F.abs(x).cast("string")
    return F.concat(number(north, 2), F.when(north >= 0, "N").otherwise("S"), F.lit("_"), number(west, 3), F.when(west >= 0, "E").otherwise("W"))


def mercator_tile(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """(x, y) of the Web-Mercator tile; null beyond the projection's latitude."""
    n = float(1 << zoom)
    rad = F.radians(lat)
    x = F.floor((lng + 180) / 360 * n)
    y = F.floor((1 - F.ln(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n)
    inside = F.abs(lat) <= MERCATOR_LIMIT
    return F.when(inside, x), F.when(inside, y)


# Digit and next orientation of the Hilbert curve, by orientation and quadrant
# (2 * row bit + column bit).
HILBERT_DIGIT = (0, 1, 3, 2, 0, 3, 1, 2, 2, 3, 1, 0, 2, 1, 3, 0)
HILBERT_NEXT = (1, 0, 3, 0, 0, 2, 1, 1, 2, 1, 2, 3, 3, 3, 0, 2)


def hilbert_key(row: Column, col: Column, order: int) -> Column:
    """Position on the Hilbert curve of the given order: one table step per bit, highest first."""
    digit, turn = F.array(*map(F.lit, HILBERT_DIGIT)), F.array(*map(F.lit, HILBERT_NEXT))

    def bit(x: Column, b: Column) -> Column:
        return F.call_function("shiftright", x, b).bitwiseAND(1).cast("int")

    def step(a: Column, b: Column) -> Column:
        at = a["s"] * 4 + bit(row, b) * 2 + bit(col, b)
        return F.struct((a["d"] * 4 + F.get(digit, at)).alias("d"), F.get(turn, at).alias("s"))

    start = F.struct(F.lit(0).cast("bigint").alias("d"), F.lit(0).alias("s"))
    return F.aggregate(F.array(*map(F.lit, range(order - 1, -1, -1))), start, step)["d"]


def write_clustered(df: DataFrame, path: str, key: str) -> None:
    """Write range-partitioned and sorted by a locality key, so cell ranges prune row groups."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
