"""Points: validity, exact groups, coordinate frames, angles. Rows are keyed by ``frame_index``."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def is_valid(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """All coordinates finite, and not all of them zero."""
    finite = [~F.isnan(c) & F.col(c).isNotNull() & (F.abs(F.col(c)) != float("inf")) for c in (x, y, z)]
    return finite[0] & finite[1] & finite[2] & ~((F.col(x) == 0) & (F.col(y) == 0) & (F.col(z) == 0))


def valid(df: DataFrame) -> DataFrame:
    return df.where(is_valid())


def is_valid_angular(min_range: float = 1e-3) -> Column:
    """The angular variant: ranges under ``min_range`` count as missing."""
    finite = [~F.isnan(c) & F.col(c).isNotNull() & (F.abs(F.col(c)) != float("inf")) for c in ("x", "y", "z")]
    return finite[0] & finite[1] & finite[2] & (range_of("x", "y", "z") >= min_range)


def range_of(a: str, b: str, c: str) -> Column:
    return F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b) + F.col(c) * F.col(c))


def group_exact(df: DataFrame, members: bool = True) -> DataFrame:
    """One row for each distinct (x, y, z) of a frame.

    Spans are of the non-null, non-NaN values; a single record spans 0; a group whose
    values are all missing spans NaN. Zero and minus zero are one coordinate.
    """
    real = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    span = lambda c: F.when(F.count("*") == 1, F.lit(0.0)).otherwise(F.coalesce(F.max(real(c)) - F.min(real(c)), F.lit(float("nan"))))
    aggs = [F.min("source_index").alias("first_index"), F.count("*").alias("size")]
    if "intensity" in df.columns:
        aggs.append(span("intensity").alias("intensity_span"))
    if "timestamp" in df.columns:
        aggs.append(span("timestamp").alias("timestamp_span"))
    aggs.append((F.count_distinct("ring") if "ring" in df.columns else F.lit(-1)).cast("long").alias("ring_nunique"))
    if members:
        aggs.append(F.sort_array(F.collect_list("source_index")).alias("member_index"))
    return df.groupBy("frame_index", "x", "y", "z").agg(*aggs)


def expand_members(groups: DataFrame, flag: str) -> DataFrame:
    """A vote on groups fanned out to the records in them."""
    return groups.select("frame_index", flag, F.explode("member_index").alias("source_index"))


def repeat_summary(df: DataFrame) -> DataFrame:
    """How many groups of a frame have each size."""
    return group_exact(df, members=False).groupBy("frame_index", "size").agg(F.count("*").alias("groups"))


def repeat_lags(df: DataFrame, top: int = 12) -> DataFrame:
    """The most frequent differences between neighbouring record indices of a group."""
    from pyspark.sql import Window

    w = Window.partitionBy("frame_index", "x", "y", "z").orderBy("source_index")
    return df.withColumn("lag",
        F.col("source_index") - F.lag("source_index").over(w)).where("lag is not null").groupBy("lag").agg(F.count("*").alias("n")).orderBy(F.desc("n"),
        "lag").limit(top)


def repeat_at_offset(df: DataFrame, offset: int) -> DataFrame:
    """For each frame the records that equal the one ``offset`` later, exactly."""
    a = df.select("frame_index", "source_index", "x", "y", "z")
    b = df.select("frame_index", (F.col("source_index") - offset).alias("source_index"), F.col("x").alias("x2"), F.col("y").alias("y2"),
        F.col("z").alias("z2"))
    return a.join(b, ["frame_index", "source_index"]).groupBy("frame_index").agg(F.count("*").alias("pairs"),
        F.count_if((F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")) & (F.col("z") == F.col("z2"))).alias("equal"))


def to_working(df: DataFrame) -> DataFrame:
    """Sensor axes to path axes: s ahead, l to the right, h up."""
    return df.withColumns({"s": -F.col("y"), "l": F.col("x"), "h": F.col("z")})


def to_sensor(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.col("l"), "y": -F.col("s"), "z": F.col("h")})


@dataclass(frozen=True)
class Mount:
    """Where the sensor sits; applied only when confirmed, with a known source and a stated basis."""

    tx_m: float = 0.0
    ty_m: float = 0.0
    tz_m: float = 0.0
    roll_rad: float = 0.0
    pitch_rad: float = 0.0
    yaw_rad: float = 0.0
    confirmed: bool = False
    source: str = ""
    basis: str = ""

    @property
    def applied(self) -> bool:
        return self.confirmed and self.source in ("organizer", "manual_estimate", "algorithm_estimate") and bool(self.basis.strip())

    def rotation(self) -> list[list[float]]:
        """Yaw about z after pitch about y after roll about x."""
        cr, sr, cp, sp, cy, sy = math.cos(self.roll_rad), math.sin(self.roll_rad), math.cos(self.pitch_rad), math.sin(self.pitch_rad), math.cos(self.yaw_rad), math.sin(self.yaw_rad)
        return [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
            [-sp, cp * sr, cp * cr]]


def _rotated(r: list[list[float]], cols: tuple[str, str, str], t: tuple[float, float, float]) -> list[Column]:
    return [F.col(cols[0]) * r[i][0] + F.col(cols[1]) * r[i][1] + F.col(cols[2]) * r[i][2] + t[i] for i in range(3)]


def sensor_to_train(df: DataFrame, mount: Mount) -> DataFrame:
    """Rotate and shift (x, y, z) into the train's frame."""
    a, b, c = _rotated(mount.rotation(), ("x", "y", "z"), (mount.tx_m, mount.ty_m, mount.tz_m))
    return df.withColumns({"x": a, "y": b, "z": c})


def train_to_sensor(df: DataFrame, mount: Mount) -> DataFrame:
    r, t = mount.rotation(), (mount.tx_m, mount.ty_m, mount.tz_m)
    back = [[r[j][i] for j in range(3)] for i in range(3)]
    a, b, c = _rotated(back, ("x", "y", "z"), tuple(-sum(back[i][j] * t[j] for j in range(3)) for i in range(3)))
    return df.withColumns({"x": a, "y": b, "z": c})


def working_frame(df: DataFrame, mount: Mount | None = None) -> DataFrame:
    """Path axes, of the train where the mount is applied, with the frame's name and the range from the sensor."""
    used = mount is not None and mount.applied
    out = df.withColumn("range_m", range_of("x", "y", "z"))
    out = to_working(sensor_to_train(out, mount) if used else out)
    return out.withColumn("coordinate_frame", F.lit("train_working" if used else "sensor_working_prior_mount_unconfirmed"))


def angles(df: DataFrame) -> DataFrame:
    """Azimuth in [-180, 180) and elevation, in degrees."""
    az = F.degrees(F.atan2("y", "x"))
    el = F.degrees(F.atan2(F.col("z"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))))
    return df.withColumns({"azimuth_deg": F.when(az >= 180.0, az - 360.0).otherwise(az), "elevation_deg": el})
