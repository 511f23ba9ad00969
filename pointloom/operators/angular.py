"""The angular grid of a sensor: bins, collisions, rasters, display samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .cloud import angles, is_valid_angular, range_of

#: Degrees of a bin and bins of a turn.
STEP_DEG, COLUMNS = 0.2, 1800
#: Lower borders of the range bands in metres; the last is open.
BANDS_M = (0.0, 10.0, 30.0, 50.0, 100.0, 200.0)


def grid(df: DataFrame, step: float = STEP_DEG) -> DataFrame:
    """Valid points with ``row`` and ``col``; rows start at the frame's lowest elevation, floored to the grid.

    Points on the right and the upper edge lie in the last column and row.
    """
    pts = angles(df.where(is_valid_angular())).withColumn("range_m", range_of("x", "y", "z"))
    w = Window.partitionBy("frame_index")
    pts = pts.withColumns({"el_min": F.floor(F.min("elevation_deg").over(w) / step) * step,
        "el_max": F.ceil(F.max("elevation_deg").over(w) / step) * step})
    rows = F.greatest(F.round((F.col("el_max") - F.col("el_min")) / step).cast("int"), F.lit(1))
    row = F.floor((F.col("elevation_deg") - F.col("el_min")) / step).cast("int")
    col = F.floor((F.col("azimuth_deg") + 180.0) / step)
    return pts.withColumns({"col": F.greatest(F.least(col, F.lit(round(360 / step) - 1)), F.lit(0)).cast("int"),
        "row": F.greatest(F.least(row, rows - 1), F.lit(0))}).drop("el_max")


def ring_grid(df: DataFrame, step: float = STEP_DEG) -> DataFrame:
    """Rows are the sensor's rings instead; only rings 0..127 have one."""
    pts = angles(df.where(is_valid_angular())).withColumn("range_m", range_of("x", "y", "z")).where(F.col("ring").between(0, 127))
    return pts.withColumns({"col": F.least(F.floor((F.col("azimuth_deg") + 180.0) / step), F.lit(round(360 / step) - 1)).cast("int"),
        "row": F.col("ring").cast("int")})


def occupancy(gridded: DataFrame, several_m: float = 0.2) -> DataFrame:
    """Bins with two points or more, and those whose ranges are apart, for each frame."""
    b = gridded.groupBy("frame_index", "row", "col").agg(F.count("*").alias("n"), (F.max("range_m") - F.min("range_m")).alias("spread"))
    return b.groupBy("frame_index").agg(F.count("*").alias("bins"), F.sum("n").alias("points"),
        F.count_if(F.col("n") >= 2).alias("collisions"),
        F.count_if((F.col("n") >= 2) & (F.col("spread") > several_m)).alias("multiple_returns"), F.max("n").alias("fullest"))


def bin_centre(row: Column, col: Column, el_min: Column, step: float = STEP_DEG) -> tuple[Column, Column]:
    return (col + 0.5) * step - 180.0, el_min + (row + 0.5) * step


def quantisation(gridded: DataFrame, step: float = STEP_DEG) -> DataFrame:
    """How far points lie from the place at their own range in the direction of their bin's centre."""
    az, el = (F.radians(c) for c in bin_centre(F.col("row"), F.col("col"), F.col("el_min"), step))
    flat = F.col("range_m") * F.cos(el)
    dx, dy, dz = flat * F.cos(az) - F.col("x"), flat * F.sin(az) - F.col("y"), F.col("range_m") * F.sin(el) - F.col("z")
    e = gridded.withColumn("error_m", F.sqrt(dx * dx + dy * dy + dz * dz))
    return e.groupBy("frame_index").agg(F.percentile("error_m", F.lit(0.5)).alias("p50_m"),
        F.percentile("error_m", F.lit(0.95)).alias("p95_m"), F.max("error_m").alias("max_m"))


def audit(df: DataFrame, gridded: DataFrame) -> DataFrame:
    """Records that the grid dropped, and those that it has more than once, by frame."""
    kept = gridded.groupBy("frame_index").agg(F.count("*").alias("rows"), F.count_distinct("source_index").alias("kept"))
    out = df.groupBy("frame_index").agg(F.count("*").alias("records")).join(kept, "frame_index", "left").fillna(0, ["rows", "kept"])
    return out.withColumns({"dropped": F.col("records") - F.col("kept"), "duplicated": F.col("rows") - F.col("kept")}).drop("rows")


def raster(gridded: DataFrame, value: str = "nearest_intensity", flip: bool = False) -> DataFrame:
    """One value for each bin: how many points, the nearest range, or the intensity of the nearest."""
    v = {"count": F.count("*").cast("double"), "min": F.min("range_m"),
        "nearest_intensity": F.min_by("intensity", F.struct("range_m", "source_index"))}[value]
    out = gridded.groupBy("frame_index", "row", "col").agg(v.alias("value"))
    return out.withColumn("row", F.max("row").over(Window.partitionBy("frame_index")) - F.col("row")) if flip else out


def display_cells(df: DataFrame, a: str, b: str, key: str, cell_m: float) -> DataFrame:
    """The row with the smallest ``key`` in each cell of a plane."""
    return df.groupBy("frame_index", F.floor(F.col(a) / cell_m).cast("int").alias("ca"),
        F.floor(F.col(b) / cell_m).cast("int").alias("cb")).agg(F.min_by(F.struct(F.col(a).alias("a"), F.col(b).alias("b"),
                F.col(key).alias("k")), F.struct(F.col(key).alias("k"), F.col(a).alias("a"),
                F.col(b).alias("b"))).alias("p")).select("frame_index", "ca", "cb", F.col("p.a").alias(a), F.col("p.b").alias(b),
        F.col("p.k").alias(key))


def display_sample(df: DataFrame, limit: int, highlight: DataFrame) -> DataFrame:
    """Evenly spaced rows of each frame, ``limit`` at most, and every highlighted one (frame_index, source_index)."""
    rows = df.select("frame_index",
        "source_index").withColumns({"pos": F.row_number().over(Window.partitionBy("frame_index").orderBy("source_index")) - 1,
            "n": F.count("*").over(Window.partitionBy("frame_index"))})
    # position p is one of trunc(k (n-1) / (limit-1)) for a whole k; a limit of one keeps the first row
    if limit > 1:
        k = F.ceil(F.try_divide(F.col("pos") * (limit - 1), F.col("n") - 1))
        on = (F.col("n") <= limit) | F.coalesce(F.floor(k * (F.col("n") - 1) / (limit - 1)) == F.col("pos"), F.lit(False))
    else:
        on = F.col("pos") < limit
    marks = highlight.select("frame_index", "source_index").distinct().withColumn("mark", F.lit(1))
    return rows.join(marks, ["frame_index", "source_index"], "left").where(on | F.col("mark").isNotNull()).select("frame_index",
        "source_index", F.coalesce("mark", F.lit(0)).alias("label"))


def stride_sample(df: DataFrame, step: int) -> DataFrame:
    return df.where(F.col("source_index") % step == 0)


def seeded_sample(df: DataFrame, limit: int, seed: int = 4) -> DataFrame:
    """The ``limit`` rows of each frame with the smallest hashes: random, repeatable, free of partitions."""
    n = F.row_number().over(Window.partitionBy("frame_index").orderBy(F.xxhash64("source_index", F.lit(seed)), "source_index"))
    return df.withColumn("__n", n).where(F.col("__n") <= limit).drop("__n")


#: Colours of range and of intensity, from low to high; fixed values.
RANGE_STOPS = ((30, 60, 140), (40, 160, 180), (80, 180, 80), (230, 190, 40), (200, 50, 40))
INTENSITY_STOPS = ((20, 20, 28), (70, 70, 90), (240, 210, 120))


def colour(value: Column, low: Column, high: Column, stops: tuple[tuple[int, int, int], ...] = RANGE_STOPS) -> Column:
    """red, green and blue of a value on a ramp between two limits; a ramp without length counts as one of length 1."""
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / span)) * (len(stops) - 1)
    k = F.least(F.floor(at), F.lit(len(stops) - 2)).cast("int")
    table = F.array(*[F.array(*[F.lit(float(c)) for c in s]) for s in stops])
    below, above = F.element_at(table, k + 1), F.element_at(table, k + 2)
    part = lambda n: F.rint(F.element_at(below, n) + (at - k) * (F.element_at(above, n) - F.element_at(below, n))).cast("int")
    return F.struct(part(1).alias("red"), part(2).alias("green"), part(3).alias("blue"))


def limits(df: DataFrame, value: str, pad: float = 1.0) -> DataFrame:
    """``low`` and ``high`` of a frame's finite values with a margin; one metre apart at least, and -1 and 1 where there are none."""
    finite = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    out = df.groupBy("frame_index").agg(F.min(finite).alias("low"), F.max(finite).alias("high"))
    high = F.when(F.col("high") <= F.col("low"), F.col("low") + 1.0).otherwise(F.col("high"))
    return out.select("frame_index", F.coalesce(F.col("low") - pad, F.lit(-1.0)).alias("low"), F.coalesce(high + pad, F.lit(1.0)).alias("high"))


def cell_for(span: Column, cell_m: float = 0.25, most: int = 1400) -> Column:
    """The side of display cells: doubled until a span has at most so many."""
    times = F.ceil(F.log2(F.greatest(span / (cell_m * most), F.lit(1.0))))
    return F.lit(cell_m) * F.pow(F.lit(2.0), times)


def band(range_m: Column) -> Column:
    out = F.lit(0)
    for k, lo in enumerate(BANDS_M):
        out = F.when(range_m >= lo, k).otherwise(out)
    return out


def evidence_table(points: DataFrame, kinds: list[str], marks: DataFrame | None = None) -> DataFrame:
    """Every frame x kind x range band, with the points seen there and what was marked by hand."""
    every = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(b).alias("band")) for k in kinds for b in range(len(BANDS_M))])
    dims = points.select("frame_index").distinct().select("frame_index", F.explode(every).alias("d")).select("frame_index", "d.*")
    seen = points.groupBy("frame_index", "kind", band(F.col("range_m")).alias("band")).agg(F.count("*").alias("points"))
    out = dims.join(seen, ["frame_index", "kind", "band"], "left").fillna(0, ["points"])
    if marks is None:
        return out
    m = marks.groupBy("frame_index", "kind", "band").agg(F.bool_or("visible").alias("visible"),
        F.array_join(F.array_sort(F.collect_set("confidence")), ",").alias("confidence"))
    return out.join(m, ["frame_index", "kind", "band"], "left")


def first_cells(df: DataFrame, cells: list[str], order: str) -> DataFrame:
    """The distinct cells of each frame in the order in which its rows first meet them."""
    found = df.groupBy("frame_index", *cells).agg(F.min(order).alias("first"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("frame_index").orderBy("first")))
