"""The library by name in SQL text: scalar functions that Catalyst inlines, and table functions over the points of frames.

    from pointloom.functions import sql
    sql.register(spark)
    spark.sql("SELECT frame_index, count_if(in_profile(s, l, h)) AS inside FROM points GROUP BY frame_index")
    spark.sql("SELECT * FROM volume_candidates(TABLE(marked), variant => 'C')")

Scalars are SQL functions of the session, so a query that calls them stays in generated code. A table function gets the rows of a
frame one after the other and gives back its few candidates; it is there for SQL users, the DataFrame operators pass arrays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from ..config import DETECTOR, PROFILE
from ..sources.settings import Variant

#: Name, arguments, type and body of the scalar functions.
SCALARS = [
    ("lerp", "a DOUBLE, b DOUBLE, t DOUBLE", "DOUBLE", "a + t * (b - a)"),
    ("wrap_degrees", "x DOUBLE", "DOUBLE", "pmod(x + 180.0D, 360.0D) - 180.0D"),
    ("range_m", "x DOUBLE, y DOUBLE, z DOUBLE", "DOUBLE", "sqrt(x * x + y * y + z * z)"),
    ("if_finite", "x DOUBLE", "DOUBLE", "CASE WHEN NOT isnan(x) AND abs(x) <> double('infinity') THEN x END"),
    ("row_identity", "text STRING", "STRING", "substring(sha2(text, 256), 1, 16)"),
    ("link_radius_m", "s DOUBLE, l DOUBLE, h DOUBLE", "DOUBLE", f"CASE WHEN sqrt(s * s + l * l + h * h) >= {DETECTOR.far_range_m}D THEN {max(DETECTOR.link_m, DETECTOR.far_link_m)}D ELSE {DETECTOR.link_m}D END"),
    ("in_profile", "s DOUBLE, l DOUBLE, h DOUBLE", "BOOLEAN", f"s BETWEEN {PROFILE.s_min_m}D AND {PROFILE.s_max_m}D AND abs(l - {PROFILE.center_l_m}D) <= {PROFILE.width_m / 2}D AND h BETWEEN {PROFILE.floor_h_m}D AND {PROFILE.floor_h_m + PROFILE.height_m}D"),
]

#: Variants by name: whether components go by distance, and whether local protrusions are looked for.
VARIANTS = {"B": Variant("B", True, False), "C": Variant("C", True, True)}
FITS = ("baseline", "span_limit", "ransac")
NEEDED = ("frame_index", "point_id", "s", "l", "h", "range_m", "inside", "excluded", "explained", "ambiguous")


class VolumeCandidates:
    """``volume_candidates(TABLE(marked), variant => 'C', fit => 'baseline')``: the candidates of each frame of marked points.

    The table needs the columns NEEDED, in any order and beside any others; it is dealt by frame whatever it was dealt by before.
    """

    def __init__(self):
        self.rows, self.how = [], None

    @staticmethod
    def analyze(points: AnalyzeArgument, variant: AnalyzeArgument | None = None, fit: AnalyzeArgument | None = None) -> AnalyzeResult:
        have = {f.name for f in points.dataType.fields} if isinstance(points.dataType, StructType) else set()
        if missing := [c for c in NEEDED if c not in have]:
            raise ValueError(f"volume_candidates needs the columns {', '.join(missing)}")
        for given, known, name in ((variant, VARIANTS, "variant"), (fit, FITS, "fit")):
            if given is not None and given.value not in known:
                raise ValueError(f"unknown {name} {given.value}; known are {', '.join(known)}")
        out = StructType().add("frame_index", LongType()).add("candidate_id", StringType()).add("kind", StringType()).add("branch", StringType()).add("unique_xyz", LongType())
        for c in ("extent_s_m", "extent_l_m", "extent_h_m", "s_min_m", "range_from_sensor_m"):
            out = out.add(c, DoubleType())
        return AnalyzeResult(out.add("model_id", IntegerType()), partitionBy=[PartitioningColumn("frame_index")], orderBy=[OrderingColumn("point_id")])

    def eval(self, points, variant: str = "C", fit: str = "baseline"):
        self.how = variant, fit
        self.rows.append(tuple(points[c] for c in NEEDED))

    def terminate(self):
        if not self.rows:
            return
        from ..operators.detect import Support, _protrusions
        from ..operators.inferred import _components

        p = {c: np.array(v) for c, v in zip(NEEDED, zip(*self.rows, strict=True), strict=True)}
        free = p["inside"].astype(bool) & ~p["excluded"].astype(bool)
        layer = p["ambiguous"].astype(bool)
        found = _components(p, np.flatnonzero(free & ~p["explained"].astype(bool) & ~layer), None, "volume_or_suspended", "LR", DETECTOR)
        asked = np.flatnonzero(free & layer)
        if VARIANTS[self.how[0]].protrusions and len(asked):
            told = _protrusions(np.column_stack([p[c][asked] for c in "slh"]), Support(np.column_stack([p[c] for c in "slh"]), DETECTOR.anchor_step_m), self.how[1], DETECTOR)
            up = np.array([t[0] for t in told])
            found += _components(p, asked[up], np.array([t[3] for t in told if t[0]]), "local_protrusion", "PQ", DETECTOR)
        for c in found:
            yield (int(p["frame_index"][0]), c["candidate_id"], c["kind"], c["branch"], c["unique_xyz"], c["extent_s_m"], c["extent_l_m"], c["extent_h_m"], c["s_min_m"],
                c["range_from_sensor_m"], c["model_id"])


def register(spark: SparkSession) -> list[str]:
    """Make all of it known to the session; returns the names."""
    from pyspark.sql.functions import udtf

    for name, arguments, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("volume_candidates", udtf(VolumeCandidates))
    return [n for n, *_ in SCALARS] + ["volume_candidates"]
