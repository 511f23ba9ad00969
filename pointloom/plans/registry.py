"""Queries of the engine and their SQL counterparts, by name.

Every query runs its operator over the whole cloud that ``fixtures`` derives from the driver's
tables. Computed doubles are rounded, as sums depend on the order of rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Window, functions as F

from ..config import DETECTOR, SPARSE, Attachment, Axis
from ..functions import scalars
from ..operators import angular, cloud, corridor, detect, evaluate, ground, inferred, pairs, rule, sections, spatial, windows
from ..session import frame_keyed, materialise, scratch_path, table
from ..sources import pointcloud
from ..streaming import replay, stateful
from .fixtures import DUCK_CLOUD, DUCK_POINTS, cloud as records, grouped, points, stored

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# --- stages shared by queries -------------------------------------------------------------


def surface(spark, sf_dir, pts=None):
    """Points, ground surfaces, local lines and the pooled residual. All of it is dealt by frame once."""
    pts = frame_keyed(points(spark, sf_dir) if pts is None else pts, dealt=True)
    tracks = materialise(ground.link_modes(ground.height_modes(ground.in_region(pts), SPARSE), SPARSE), "tracks")
    both = materialise(ground.lines_and_residual(ground.band_rows(pts, tracks, SPARSE)), "lines")
    pooled = {"frame_p50_m": "p50_m", "frame_p95_m": "p95_m", "frame_groups": "groups"}
    residual = both.where("frame_groups > 0").groupBy("frame_index").agg(*[F.first(c).alias(n) for c, n in pooled.items()])
    return pts, tracks, both.drop(*pooled), materialise(residual, "residual")


def cross_sections(spark, sf_dir, pts=None, base=None):
    """``base``: what ``surface`` gave, for queries that need it more than once."""
    pts, tracks, lines, residual = base or surface(spark, sf_dir, pts)
    rows = sections.section_rows(ground.above_ground(ground.in_region(pts), lines, SPARSE), SPARSE)
    return pts, tracks, lines, residual, rows


def on_ground(pts, tracks):
    """Points near the ground's mode of their segment."""
    modes = tracks.where("role = 'ground'").select("frame_index", "segment", F.col("h").alias("h_mode"))
    return pts.withColumn("segment", ground.segment_of("s", SPARSE)).join(modes.hint("shuffle_hash"),
        ["frame_index", "segment"]).where(F.abs(F.col("h") - F.col("h_mode")) <= 2 * SPARSE.height_bin_m)


def paired(spark, sf_dir, pts=None, base=None):
    pts, tracks, lines, residual, rows = cross_sections(spark, sf_dir, pts, base)
    # fragments of two stations are too short for a candidate, yet they pair
    frag = materialise(sections.link_clusters(sections.clusters(rows, SPARSE), "robust", SPARSE, 2), "fragments")
    slopes = ground.slopes_at(frag.select("frame_index", "s_center").distinct(), lines, ground.summary_plane(on_ground(pts, tracks), SPARSE), SPARSE)
    return pts, tracks, lines, residual, frag, materialise(pairs.measure_sections(frag, slopes), "pair-sections")


def marked(spark, sf_dir, pts=None, coarse_m: float | None = None, base=None):
    """Points with the masks of the straight profile, which knows no lines; ``coarse_m``: a least residual, as of a rougher ground.

    The masks are not stored: most uses ask for the few points inside, which are found before lines are looked up.
    """
    pts, tracks, lines, residual = base or surface(spark, sf_dir, pts)
    if coarse_m is not None:
        residual = residual.withColumn("p95_m", F.greatest("p95_m", F.lit(coarse_m)))
    rows = ground.above_ground(pts, lines, SPARSE).withColumns({"inside": detect.in_profile(), "excluded": F.lit(False)})
    return tracks, detect.surface_masks(rows, residual)


def decided(spark, sf_dir, pts=None, base=None):
    """Frames with their decision by the straight profile, and the candidates with their evidence."""
    base = base or surface(spark, sf_dir, pts)
    tracks, marks = marked(spark, sf_dir, base=base)
    judged = materialise(rule.with_evidence(detect.straight_candidates(marks, points=base[0])).drop("label"), "judged")
    have = tracks.where("role = 'ground'").select("frame_index").distinct().withColumn("ground_found", F.lit(True))
    frames = base[0].select("frame_index").distinct().join(have, "frame_index", "left").fillna(False, ["ground_found"])
    frames = frames.withColumns({"status": F.lit("ok"), "corridor_source": F.lit("configured_straight")})
    return marks, judged, frames


# --- points ---------------------------------------------------------------------------


@query(f"""with {DUCK_CLOUD}
select frame_index, count(*) as inside, round(min(range_m), 6) as nearest_m, round(max(s) - min(s), 6) as extent_s_m, round(max(h) - min(h), 6) as extent_h_m from
  cloud where s between 1 and 120 and abs(l) <= 1.05e0 and h between -1.075e0 and -1.075e0 + 3 group by frame_index""")
def configured_volume(spark, sf_dir):
    inside = detect.configured_volume(records(spark, sf_dir))
    return rounded(inside.groupBy("frame_index").agg(F.count("*").alias("inside"), F.min("range_m").alias("nearest_m"),
        (F.max("s") - F.min("s")).alias("extent_s_m"), (F.max("h") - F.min("h")).alias("extent_h_m")))


@query(f"""with {DUCK_CLOUD}
select frame_index, count(*) as points, count(*) filter (s between 1 and 120) as in_s_only, count(*) filter (s between 1 and 120 and abs(l) <= 1.05e0 and h between
  -1.075e0 and -1.075e0 + 3) as inside, round(min(range_m) filter (s between 1 and 120 and abs(l) <= 1.05e0 and h between -1.075e0 and -1.075e0 + 3), 6) as nearest_m
  from cloud group by frame_index""")
def volume_diagnosis(spark, sf_dir):
    return rounded(detect.volume_diagnosis(records(spark, sf_dir)))


@query(f"""with {DUCK_CLOUD},
f as (select frame_index, cast(x as float) x, cast(y as float) y, cast(z as float) z, intensity, ring, source_index from cloud)
select frame_index, round(x::double, 6) as x, round(y::double, 6) as y, round(z::double, 6) as z, min(source_index) as first_index, count(*) as size, round(case when
  count(*) = 1 then 0 else max(intensity) - min(intensity) end, 6) as intensity_span, count(distinct ring) as ring_nunique, list(source_index order by source_index)
  as member_index from f group by f.frame_index, f.x, f.y, f.z""")
def exact_groups(spark, sf_dir):
    f = stored(spark, sf_dir).withColumns({c: F.col(c).cast("float") for c in "xyz"})
    return rounded(cloud.group_exact(cloud.valid(f)).withColumns({c: F.col(c).cast("double") for c in "xyz"}))


@query(f"""with {DUCK_CLOUD},
g as (select frame_index, x, y, z, count(*) as size from (select frame_index, cast(x as float) x, cast(y as float) y, round(cast(z as float) * 2) z from cloud) group
  by all)
select frame_index, size, count(*) as groups from g group by all""")
def repeat_summary(spark, sf_dir):
    f = records(spark, sf_dir).withColumns({"x": F.col("x").cast("float"), "y": F.col("y").cast("float"), "z": F.round(F.col("z").cast("float") * 2)})
    return cloud.repeat_summary(f)


@query(f"""with {DUCK_CLOUD},
g as (select frame_index, cast(floor(s) as bigint) x, cast(floor(l) as bigint) y, cast(floor(h) as bigint) z, source_index from cloud),
d as (select source_index - lag(source_index) over (partition by frame_index, x, y, z order by source_index) as lag from g)
select lag, count(*) as n from d where lag is not null group by lag order by n desc, lag limit 12""")
def repeat_lags(spark, sf_dir):
    f = records(spark, sf_dir).select("frame_index", "source_index", F.floor("s").alias("x"), F.floor("l").alias("y"), F.floor("h").alias("z"))
    return cloud.repeat_lags(f)


@query(f"""with {DUCK_CLOUD},
g as (select frame_index, source_index, floor(s) x, floor(l) y, floor(h) z from cloud)
select a.frame_index, count(*) as pairs, count(*) filter (a.x = b.x and a.y = b.y and a.z = b.z) as equal from g a join g b on a.frame_index = b.frame_index and
  b.source_index = a.source_index + 128 group by a.frame_index""")
def repeat_at_offset(spark, sf_dir):
    f = records(spark, sf_dir).select("frame_index", "source_index", F.floor("s").alias("x"), F.floor("l").alias("y"), F.floor("h").alias("z"))
    return cloud.repeat_at_offset(f, 128)


_MOUNT = cloud.Mount(tx_m=0.3, ty_m=-0.1, tz_m=1.2, roll_rad=0.02, pitch_rad=-0.03, yaw_rad=0.1, confirmed=True, source="organizer", basis="fixture")
_R = [[repr(float(v)) + "e0" for v in row] for row in _MOUNT.rotation()]


@query(f"""with {DUCK_CLOUD},
t as (select frame_index, source_index, x*{_R[0][0]} + y*{_R[0][1]} + z*{_R[0][2]} + 0.3e0 as x, x*{_R[1][0]} + y*{_R[1][1]} + z*{_R[1][2]} - 0.1e0 as y,
  x*{_R[2][0]} + y*{_R[2][1]} + z*{_R[2][2]} + 1.2e0 as z from cloud)
select frame_index, source_index, round(-y, 5) as s, round(x, 5) as l, round(z, 5) as h, 'train_working' as coordinate_frame from t""")
def train_frame(spark, sf_dir):
    out = cloud.working_frame(records(spark, sf_dir).select("frame_index", "source_index", "x", "y", "z"), _MOUNT)
    return rounded(out.select("frame_index", "source_index", "s", "l", "h", "coordinate_frame"), 5)


_BACK = " + ".join(f"abs({' + '.join(f'{_R[j][i]}*t{j}' for j in range(3))} - {c})" for i, c in enumerate("xyz"))


@query(f"""with {DUCK_CLOUD},
t as (select *, x*{_R[0][0]} + y*{_R[0][1]} + z*{_R[0][2]} + 0.3e0 - 0.3e0 as t0, x*{_R[1][0]} + y*{_R[1][1]} + z*{_R[1][2]} - 0.1e0 + 0.1e0 as t1, x*{_R[2][0]} + y*{_R[2][1]} + z*{_R[2][2]} + 1.2e0 - 1.2e0 as t2 from cloud)
select frame_index, round(max({_BACK}), 9) as worst_m, count(*) as points from t group by frame_index""")
def mount_round_trip(spark, sf_dir):
    pts = records(spark, sf_dir).select("frame_index", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"), "x", "y", "z")
    back = cloud.train_to_sensor(cloud.sensor_to_train(pts, _MOUNT), _MOUNT)
    return rounded(back.groupBy("frame_index").agg(F.max(F.abs(F.col("x") - F.col("x0")) + F.abs(F.col("y") - F.col("y0")) + F.abs(F.col("z") - F.col("z0"))).alias("worst_m"),
            F.count("*").alias("points")), 9).withColumn("worst_m", F.col("worst_m") + 0.0)


# --- ground ---------------------------------------------------------------------------

_SEG = "case when s >= 5 and s < 30 then cast(floor((s - 5) / 2) as int) end"
_MODES = DUCK_POINTS + f""",
seg as (select *, {_SEG} as segment from pts where s between 5 and 30),
hb as (select *, floor(min(h) over w / 0.05e0) * 0.05e0 as h0, ceil(max(h) over w / 0.05e0) * 0.05e0 as h1, count(*) over w as n from seg where segment is not
  null window w as (partition by frame_index, segment)),
bn as (select *, least(cast(floor((h - h0) / 0.05e0) as int), greatest(cast(round((h1 - h0) / 0.05e0) as int), 1) - 1) as bin from hb where n >= 12),
cnt as (select frame_index, segment, bin, count(*) as groups, median(h) as h, min(l) as l_min, max(l) as l_max from bn group by all),
pk as (select c.* from cnt c left join cnt a on a.frame_index = c.frame_index and a.segment = c.segment and a.bin = c.bin - 1
  left join cnt b on b.frame_index = c.frame_index and b.segment = c.segment and b.bin = c.bin + 1
  where c.groups >= 12 and c.groups >= coalesce(a.groups, 0) and c.groups >= coalesce(b.groups, 0) and c.l_max - c.l_min >= 1.5e0),
modes as (select *, row_number() over (partition by frame_index, segment order by h) - 1 as mode from pk p
  where not exists (select 1 from pk o where o.frame_index = p.frame_index and o.segment = p.segment and o.h < p.h and p.h - o.h < 3 * 0.05e0))
"""


@query(f"""with {_MODES}
select frame_index, segment, cast(mode as int) as mode, round(h, 6) as h, groups, round(l_min, 6) as l_min, round(l_max, 6) as l_max, 5.0e0 + segment * 2 as s_lo,
  least(7.0e0 + segment * 2, 30) as s_hi from modes""")
def ground_modes(spark, sf_dir):
    return rounded(ground.height_modes(ground.in_region(points(spark, sf_dir)), SPARSE))


_GROUND = _MODES + """,
gm as (select frame_index, segment, h as h_mode from modes where mode = 0),
gr as (select p.*, g.segment, g.h_mode, median(p.h) over (partition by p.frame_index, g.segment) as med, count(*) over (partition by p.frame_index, g.segment)
  as n from (select *, case when s >= 5 and s < 30 then cast(floor((s - 5) / 2) as int) end as seg from pts) p
  join gm g on g.frame_index = p.frame_index and g.segment = p.seg where abs(p.h - g.h_mode) <= 2 * 0.05e0),
tr as (select *, abs(h - med) <= greatest(3.0e0 * 1.4826e0 * median(abs(h - med)) over (partition by frame_index, segment), 0.08e0) as near from gr),
kp as (select *, n >= 8 and (near or count(*) filter (near) over (partition by frame_index, segment) < 8) as keep from tr),
ln as (select frame_index, segment, count(*) as groups, min(l) as l_min, max(l) as l_max, coalesce(regr_intercept(h, l) filter (keep), any_value(med)) as
  intercept, case when regr_intercept(h, l) filter (keep) is null then 0 else regr_slope(h, l) filter (keep) end as slope_dh_dl from kp group by all)
"""


@query(f"with {_MODES} select frame_index, segment, round(h, 6) as h, groups from modes where mode = 0")
def ground_surface(spark, sf_dir):
    _, tracks, _, _ = surface(spark, sf_dir)
    return rounded(tracks.where("role = 'ground'").select("frame_index", "segment", "h", "groups"))


@query(f"""with {_GROUND},
rs as (select k.frame_index, k.segment, quantile_cont(abs(k.h - ln.intercept - ln.slope_dh_dl * k.l), 0.5) as residual_p50_m, quantile_cont(abs(k.h - ln.intercept -
  ln.slope_dh_dl * k.l), 0.95) as residual_p95_m from kp k join ln using (frame_index, segment) group by all)
select frame_index, segment, groups, round(l_min, 6) as l_min, round(l_max, 6) as l_max, round(intercept, 6) as intercept, round(slope_dh_dl, 6) as slope_dh_dl,
  round(residual_p50_m, 6) as residual_p50_m, round(residual_p95_m, 6) as residual_p95_m from ln join rs using (frame_index, segment)""")
def ground_lines(spark, sf_dir):
    _, _, lines, _ = surface(spark, sf_dir)
    return rounded(lines.drop("s_lo", "s_hi"))


_RESIDUAL = _GROUND + """,
fr as (select k.frame_index, quantile_cont(abs(k.h - ln.intercept - ln.slope_dh_dl * k.l), 0.5) as p50_m, quantile_cont(abs(k.h - ln.intercept - ln.slope_dh_dl
  * k.l), 0.95) as p95_m, count(*) as groups from kp k join ln using (frame_index, segment) where keep group by k.frame_index)
"""


@query(f"with {_RESIDUAL} select frame_index, round(p50_m, 6) as p50_m, round(p95_m, 6) as p95_m, groups from fr")
def fitting_residual(spark, sf_dir):
    return rounded(surface(spark, sf_dir)[3])


_DH = _RESIDUAL + """,
dh as materialized (select p.*, p.h - (ln.intercept + ln.slope_dh_dl * p.l) as dh, coalesce(p.l between ln.l_min and ln.l_max, false) as supported from (select *, case when
  s >= 5 and s < 30 then cast(floor((s - 5) / 2) as int) end as segment from pts) p left join ln on ln.frame_index = p.frame_index and ln.segment = p.segment)
"""


@query(f"with {_DH} select frame_index, point_id, round(dh, 6) as dh, supported from dh")
def height_above_ground(spark, sf_dir):
    pts, _, lines, _ = surface(spark, sf_dir)
    return rounded(ground.above_ground(pts, lines, SPARSE).select("frame_index", "point_id", "dh", "supported"))


@query()
def summary_plane(spark, sf_dir):
    pts, tracks, _, _ = surface(spark, sf_dir)
    return rounded(ground.summary_plane(on_ground(pts, tracks), SPARSE))


# --- sections -------------------------------------------------------------------------

_SECTIONS = _DH + """,
sr as (select d.*, c.s_center, abs(d.s - c.s_center) <= 0.5e0 as narrow, count(*) over w as n_wide, count(*) filter (abs(d.s - c.s_center) <= 0.5e0) over w as
  n_narrow from dh d join (values (6.0e0), (10.0e0), (15.0e0), (20.0e0), (25.0e0)) c(s_center) on abs(d.s - c.s_center) <= 1.0e0 where d.s between 5 and 30
  window w as (partition by d.frame_index, c.s_center)),
sec as (select *, n_narrow < 8 as expanded, case when n_narrow < 8 then n_wide else n_narrow end as section_groups, case when (case when n_narrow < 8 then
  n_wide else n_narrow end) >= 8 then 'ok' else 'insufficient' end as status from sr where narrow or n_narrow < 8),
bd as (select *, coalesce(cast(l - lag(l) over (partition by frame_index, s_center order by l, h, s) > 0.15e0 as int), 0) as brk, count(*) over (partition by
  frame_index, s_center) as band_groups from sec where status = 'ok' and dh between 0.04e0 and 0.40e0),
isl as (select *, sum(brk) over (partition by frame_index, s_center order by l, h, s rows unbounded preceding) as island from bd),
cl as (select frame_index, s_center, island::bigint as island, median(l) as l_median, min(l) as l_min, max(l) as l_max, median(dh) as dh_median, median(h) as
  h_median, count(*) as groups, max(l) - min(l) as width_m, case when count(*) < 4 then 'few' when max(l) - min(l) > 0.60e0 then 'wide' else 'kept' end as fate
  from isl where band_groups >= 4 group by frame_index, s_center, island)
"""


@query(f"""with {_SECTIONS}
select frame_index, s_center, any_value(status) as status, any_value(section_groups) as section_groups, bool_or(expanded) as expanded, count(*) as n from sec group
  by all""")
def section_rows(spark, sf_dir):
    rows = cross_sections(spark, sf_dir)[4]
    return rows.groupBy("frame_index", "s_center").agg(F.first("status").alias("status"), F.first("section_groups").alias("section_groups"),
        F.bool_or("expanded").alias("expanded"), F.count("*").alias("n"))


@query(f"""with {_SECTIONS}
select frame_index, s_center, island, round(l_median, 6) as l_median, round(l_min, 6) as l_min, round(l_max, 6) as l_max, round(dh_median, 6) as dh_median,
  round(h_median, 6) as h_median, groups, round(width_m, 6) as width_m, fate from cl""")
def section_clusters(spark, sf_dir):
    return rounded(sections.clusters(cross_sections(spark, sf_dir)[4], SPARSE))


@query(f"""with {_SECTIONS},
b as (select frame_index, s_center, any_value(status) as status, count(*) as section_groups, count(dh) as finite_dh, count(*) filter (dh < 0.04e0) as below_band,
  count(*) filter (dh > 0.40e0) as above_band, count(*) filter (dh between 0.04e0 and 0.40e0) as in_band from sec group by all),
f as (select frame_index, s_center, count(*) filter (fate = 'kept') as kept, count(*) filter (fate = 'few') as few, count(*) filter (fate = 'wide') as wide from cl
  group by all)
select b.*, coalesce(kept, 0) as kept, coalesce(few, 0) as few, coalesce(wide, 0) as wide from b left join f using (frame_index, s_center)""")
def section_rejections(spark, sf_dir):
    return sections.rejections(cross_sections(spark, sf_dir)[4], SPARSE)


@query(f"""with {_SECTIONS},
m as (select i.frame_index, i.s_center, case when i.band_groups < 4 then 'band_below_min_groups' when c.fate = 'kept' then 'kept' else 'rejected_' || c.fate end as
  role from isl i left join cl c using (frame_index, s_center, island)),
o as (select frame_index, s_center, case when status <> 'ok' or dh is null then 'no_dh' when dh < 0.04e0 then 'below_height_band' else 'above_height_band' end as
  role from sec where status <> 'ok' or dh is null or not (dh between 0.04e0 and 0.40e0))
select frame_index, s_center, role, count(*) as n from (select * from m union all select * from o) group by all""")
def section_roles(spark, sf_dir):
    return sections.roles(cross_sections(spark, sf_dir)[4], SPARSE).groupBy("frame_index", "s_center", "role").agg(F.count("*").alias("n"))


def _clusters(spark, sf_dir, base=None):
    _, _, lines, _, rows = cross_sections(spark, sf_dir, base=base)
    return lines, sections.clusters(rows, SPARSE)


@query()
def line_fragments(spark, sf_dir):
    return rounded(sections.link_clusters(_clusters(spark, sf_dir)[1], "robust", SPARSE))


@query()
def line_fragments_spatial(spark, sf_dir):
    return rounded(sections.link_clusters(_clusters(spark, sf_dir)[1], "spatial", SPARSE))


@query()
def line_fragments_fixed(spark, sf_dir):
    return rounded(sections.link_clusters(_clusters(spark, sf_dir)[1], "fixed_dl", SPARSE))


@query()
def line_candidates(spark, sf_dir):
    lines, found = _clusters(spark, sf_dir)
    return rounded(sections.line_candidates(sections.link_clusters(found, "robust", SPARSE, 2), lines, SPARSE).drop("samples"))


@query()
def selection_funnel(spark, sf_dir):
    return sections.selection_funnel(materialise(_clusters(spark, sf_dir)[1], "clusters"), SPARSE)


@query()
def broken_hops(spark, sf_dir):
    return rounded(sections.broken_hops(sections.link_clusters(_clusters(spark, sf_dir)[1], "robust", SPARSE, 2), SPARSE))


@query()
def wide_profiles(spark, sf_dir):
    return rounded(sections.wide_profile(cross_sections(spark, sf_dir)[4], SPARSE))


# --- pairs and corridors ---------------------------------------------------------------


#: The fullest kept cluster left and right of the axis at each station: pairs of lines that SQL can follow, too.
_SIDES = _SECTIONS + """,
sd as materialized (select frame_index, track, s_center, l_median, h_median, dh_median, width_m, groups from (select *, case when l_median < 0 then 0 else 1 end
  as track, row_number() over (partition by frame_index, s_center, l_median < 0 order by groups desc, l_median) as place from cl where fate = 'kept') where
  place = 1),
tw as (select a.frame_index, a.s_center, a.l_median as al, b.l_median as bl, a.h_median as ah, b.h_median as bh, a.dh_median as adh, b.dh_median as bdh,
  a.groups + b.groups as groups, (a.l_median + b.l_median) / 2 as mid_l from sd a join sd b using (frame_index, s_center) where a.track = 0 and b.track = 1),
hd as (select *, (coalesce(lead(mid_l) over w, mid_l) - coalesce(lag(mid_l) over w, mid_l)) / nullif(coalesce(lead(s_center) over w, s_center) -
  coalesce(lag(s_center) over w, s_center), 0) as heading, count(*) over (partition by frame_index) as common from tw window w as (partition by frame_index
  order by s_center)),
ds as (select *, abs((bl - al) * 1.0e0 + (bh - ah) * 0) / sqrt(1 + heading * heading) as distance_m from hd where common >= 2),
ag as materialized (select * from (select *, count(*) over (partition by frame_index) as agree from (select *, median(distance_m) over (partition by
  frame_index) as center from ds) where center between 0.40e0 and 2.80e0 and abs(distance_m - center) <= 0.25e0) where agree >= 2)
"""


def _sides(spark, sf_dir, base=None):
    kept = _clusters(spark, sf_dir, base)[1].where("fate = 'kept'").withColumn("track", F.when(F.col("l_median") < 0, 0).otherwise(1))
    place = F.row_number().over(Window.partitionBy("frame_index", "s_center", "track").orderBy(F.desc("groups"), "l_median"))
    sides = kept.withColumn("place", place).where("place = 1").select("frame_index", "track", "s_center", "l_median", "h_median",
        "dh_median", "width_m", "groups")
    return materialise(sides, "sides")


def _side_sections(spark, sf_dir, base=None):
    sides = _sides(spark, sf_dir, base)
    flat = sides.select("frame_index", "s_center").distinct().withColumns({"slope_s": F.lit(0.0), "slope_l": F.lit(0.0)})
    return sides, pairs.measure_sections(sides, flat)


@query(f"""with {_SIDES}
select frame_index, 0 as a_track, 1 as b_track, s_center, round(mid_l, 6) as mid_l, round((ah + bh) / 2, 6) as mid_h, round(heading, 6) as heading, round(distance_m,
  6) as distance_m from ds where heading is not null""")
def pair_sections(spark, sf_dir):
    return rounded(_side_sections(spark, sf_dir)[1].select("frame_index", "a_track", "b_track", "s_center", "mid_l", "mid_h", "heading",
        "distance_m"))


@query(f"""with {_SIDES},
md as (select *, abs(distance_m - median(distance_m) over (partition by frame_index)) as mad from ag)
select frame_index, 0 as a_track, 1 as b_track, round(median(distance_m), 6) as distance_m, round(median(mad), 6) as distance_mad_m, round(median(al), 6) as
  left_l_m, round(median(bl), 6) as right_l_m, sum(groups)::bigint as support_groups, count(*) as sections, arg_min(s_center, abs(s_center - 15) * 100 + s_center /
  100) as publish_s_m from md group by frame_index having count(*) >= 2""")
def line_pairs(spark, sf_dir):
    return rounded(pairs.pairs(_side_sections(spark, sf_dir)[1]))


@query(f"""with {_SIDES},
k as (select a.frame_index, median((b.mid_l - a.mid_l) / (b.s_center - a.s_center)) as k from ag a join ag b on a.frame_index = b.frame_index and b.s_center >
  a.s_center group by a.frame_index),
b as (select frame_index, k, s_center, mid_l, median(mid_l - k * s_center) over (partition by frame_index) as b from ag join k using (frame_index))
select frame_index, 0 as a_track, 1 as b_track, round(k, 6) as k, round(b, 6) as b, count(*) as n_sections, min(s_center) as s_min, max(s_center) as s_max,
  round(median(abs(mid_l - b - k * s_center)), 6) as residual_p50_m, round(quantile_cont(abs(mid_l - b - k * s_center), 0.95), 6) as residual_p95_m, count(*) >= 3
  and quantile_cont(abs(mid_l - b - k * s_center), 0.95) <= 0.08e0 as straight from b group by frame_index, k, b.b""")
def midpoint_lines(spark, sf_dir):
    rows = pairs.agreeing(_side_sections(spark, sf_dir)[1])
    return rounded(pairs.median_slope_line(rows, ["frame_index", "a_track", "b_track"], "s_center", "mid_l"))


_SCORED = _SIDES + """,
dk as (select *, abs((al - lag(al) over w) / (s_center - lag(s_center) over w) - (bl - lag(bl) over w) / (s_center - lag(s_center) over w)) as dk from ag window
  w as (partition by frame_index order by s_center)),
wd as (select frame_index, s_center, max(width_m) as width from sd group by all),
pp as (select d.frame_index, count(*) as n, median(dk) as dk, max(distance_m) - min(distance_m) as span, median(bdh - adh) as dh, max(width) as width from dk d
  join wd using (frame_index, s_center) group by d.frame_index),
pq as (select frame_index, n, dk, span, least(1, n / 3.0e0) as support, coalesce(1 - least(1, dk / 0.08e0), 1) as direction, 1 - least(1, span / 0.25e0) as
  stability, coalesce(1 - least(1, abs(dh) / greatest(coalesce(p95_m, 0), 0.05e0)), 1) as height, case when width <= 0.6e0 then 1.0e0 else 0.4e0 end as narrow
  from pp left join fr using (frame_index)),
sc as (select *, least(support, direction, stability, height, narrow) as score, coalesce(dk, 0) > 0.02e0 or span > 0.25e0 as inconsistent from pq),
kd as materialized (select *, case when inconsistent or score < 0.35e0 then 'insufficient' when score >= 0.6e0 and support >= 1 and direction >= 0.5e0 and
  stability >= 0.5e0 and height >= 0.5e0 and narrow >= 1 then 'consistent' else 'ambiguous' end as kind from sc)
"""


def _kinds(spark, sf_dir, base=None):
    """Agreeing sections of the two sides, and their scores without assumed sections."""
    base = base or surface(spark, sf_dir)
    sides, sec = _side_sections(spark, sf_dir, base)
    return pairs.agreeing(sec), pairs.scores(sec, base[3], pairs.assumed_sections(sides).where("false"))


@query(f"with {_SCORED} select frame_index, round(score, 6) as score, inconsistent, kind from kd")
def pair_kinds(spark, sf_dir):
    return rounded(_kinds(spark, sf_dir)[1].select("frame_index", "score", "inconsistent", "kind"))


@query()
def pair_scores(spark, sf_dir):
    _, _, _, residual, frag, sec = paired(spark, sf_dir)
    return rounded(pairs.scores(sec, residual, pairs.assumed_sections(frag)))


@query(f"""with {_SIDES},
k as (select a.frame_index, median((b.mid_l - a.mid_l) / (b.s_center - a.s_center)) as k from ag a join ag b on a.frame_index = b.frame_index and b.s_center >
  a.s_center group by a.frame_index),
b as (select frame_index, k, s_center, mid_l, median(mid_l - k * s_center) over (partition by frame_index) as b from ag join k using (frame_index)),
l as (select frame_index, any_value(k) as k, any_value(b.b) as b, count(*) >= 3 and quantile_cont(abs(mid_l - b.b - k * s_center), 0.95) <= 0.08e0 as straight,
  min(s_center) as lo, max(s_center) as hi, arg_min(mid_l, abs(s_center - 15) * 100 + s_center / 100) as near_l, arg_min(s_center, abs(s_center - 15) * 100 +
  s_center / 100) as near_s from b group by frame_index),
g as (select *, greatest(lo - 15, 15 - hi, 0) as outside, near_s = 15 as direct from l)
select frame_index, 0 as a_track, 1 as b_track, case when outside > 0 then 'extrapolation' when direct then 'observed' else 'gap' end as support, round(case
  when direct then near_l end, 6) as direct_l_m, near_s as nearest_s_m, round(near_l, 6) as nearest_l_m,
  round(case when straight and outside <= 5 then b + k * 15 end, 6) as model_l_m, outside as outside_m, straight and outside <= 5 as reliable, case when not
    straight then 'not_straight' when outside > 5 then 'too_far' else 'reliable' end as reason from g""")
def pair_poses(spark, sf_dir):
    keys = ["frame_index", "a_track", "b_track"]
    rows = pairs.agreeing(_side_sections(spark, sf_dir)[1])
    return rounded(pairs.pose_at_reference(rows, pairs.median_slope_line(rows, keys, "s_center", "mid_l"), keys))


#: All kept clusters linked into lines of two stations or more as ``link_clusters`` does it ("robust"), station by station: ``ahead`` has where
#: each line goes on, ``offers`` all continuations in order, ``best`` and ``more`` those taken and branches. A cluster left over starts a line.
_LINES = _SECTIONS + """,
kc as (select * from cl where fate = 'kept'),
hr as (select f.frame_index, k, st[k] as s, coalesce(list(c.l_median order by c.l_median, c.h_median, c.groups) filter (c.l_median is not null), []) as here
  from (select distinct frame_index from kc) f cross join (select [6.0e0, 10, 15, 20, 25] as st, unnest([1, 2, 3, 4, 5]) as k)
  left join kc c on c.frame_index = f.frame_index and c.s_center = st[k] group by all),
lk as (select frame_index, 0 as k, cast([] as struct(k int, s double, l double)[][]) as lines from (select distinct frame_index from kc)
  union all
  select frame_index, k, list_concat(flatten([case when len([o for o in best if o.n = n]) = 0 then [x] else [list_append(x, {'k': k, 's': s, 'l': o.l}) for o in
    list_concat(best, more) if o.n = n] end for x, n in lines]), [[{'k': k, 's': s, 'l': l}] for l, c in here if not list_contains([o.c for o in
    list_concat(best, more)], c)])
  from (select *, list_reduce([[o] for o in offers], lambda a, y: case when list_contains([o.c for o in list_concat(best, a)], y[1].c) or len([o for o in a if
    o.n = y[1].n]) >= least(2, 32 - len(lines)) or len([o for o in best if o.n = y[1].n and (o.young or abs(o.cost - y[1].cost) < 0.10e0)]) = 0 then a else
    list_concat(a, y) end, []) as more
  from (select *, list_reduce([[o] for o in offers], lambda a, y: case when len([o for o in a if o.n = y[1].n or o.c = y[1].c]) > 0 then a else list_concat(a, y)
    end, []) as best
  from (select *, list_sort(flatten([[{'cost': case when f.young then 0 else abs(l - f.at) end, 'x': f.x, 'l': l, 'c': c, 'n': n, 'young': f.young} for l, c in
    here if f.live and case when f.young then abs((l - f.at) / (s - f.x[-1].s)) <= 0.15e0 else abs(l - f.at) <= 0.25e0 end] for f, n in ahead])) as offers
  from (select hr.*, lines, [{'x': x, 'young': len(x) < 3, 'live': hr.k - x[-1].k <= 2, 'at': x[-1].l + case when len(x) < 3 then 0 else
    list_median(flatten([[(b.l - a.l) / (b.s - a.s) for b in x[-4:] if b.k > a.k] for a in x[-4:]])) * (hr.s - x[-1].s) end} for x in lines] as ahead
  from lk join hr on hr.frame_index = lk.frame_index and hr.k = lk.k + 1))))),
tk as (select frame_index, cast(row_number() over (partition by frame_index order by list_median([p.l for p in x]), n) - 1 as int) as track, unnest(x) as p
  from (select frame_index, unnest(lines) as x, generate_subscripts(lines, 1) as n from lk where k = 5) where len(x) >= 2)
"""


@query(f"""with recursive {_LINES},
pr as (select a.frame_index, a.track as a_track, b.track as b_track from (select distinct frame_index, track from tk) a join (select distinct frame_index, track
  from tk) b on a.frame_index = b.frame_index and a.track < b.track),
f as (select p.*, t.p.s as s_center, max(t.p.l) filter (track = a_track) as al, max(t.p.l) filter (track = b_track) as bl from pr p join tk t on t.frame_index =
  p.frame_index and track in (a_track, b_track) group by all),
m as (select *, median(bl - al) over w as sep, count(bl - al) over w as shared, min(s_center) filter (al is not null and bl is not null) over w as lo, max(s_center)
  filter (al is not null and bl is not null) over w as hi from f window w as (partition by frame_index, a_track, b_track))
select frame_index, a_track, b_track, s_center, round(coalesce(al, bl - sep), 6) as a_l_m, round(coalesce(bl, al + sep), 6) as b_l_m, case when al is
  null then 'a' else 'b' end as assumed from m where shared >= 2 and (al is null or bl is null) and s_center between lo and hi""")
def assumed_sections(spark, sf_dir):
    # every line of a frame with every other one, as in ``paired``
    return rounded(pairs.assumed_sections(materialise(sections.link_clusters(_clusters(spark, sf_dir)[1], "robust", SPARSE, 2), "fragments")))


def _midpoints(spark, sf_dir, base=None):
    return pairs.agreeing(_side_sections(spark, sf_dir, base)[1]).select("frame_index", F.lit("H1").alias("hypothesis"),
        F.col("s_center").alias("s"), F.col("mid_l").alias("l"))


@query(f"""with {_SIDES}, w as (select frame_index, arg_min(mid_l, abs(s_center - 6)) as near_l, arg_min(mid_l, s_center) as la, arg_max(mid_l, s_center) as lb, max(s_center) - min(s_center) as ds, count(*) as n from ag where s_center between 5 and 16 group by frame_index),
ok as (select frame_index from w where abs(near_l) <= 0.02e0 and (n < 2 or abs((lb - la) / ds) <= 0.002e0))
select f.frame_index, case when ok.frame_index is null then 0 else 1 end::bigint as matches, case when ok.frame_index is not null then ['H1'] end as hypotheses,
  case when ok.frame_index is null then 'none' else 'one' end as attachment from (select distinct frame_index from ag) f left join ok using (frame_index)""")
def attachment_matches(spark, sf_dir):
    place = Attachment(s_m=6.0, l_m=0.0, support_s_min_m=5.0, support_s_max_m=16.0, lateral_m=0.02, heading=0.0, heading_tolerance=0.002)
    return corridor.attachment_match(_midpoints(spark, sf_dir), place)


_CORRIDOR = _SIDES + """,
ob as (select frame_index, s_center as s, mid_l as l, lag(s_center) over w as ps, lag(mid_l) over w as pl, lead(s_center) over w as ns, lead(mid_l) over w as nl
  from ag window w as (partition by frame_index order by s_center)),
vx as (select frame_index, s, l, 'observed' as role from ob
  union all select frame_index, s - 5, l - (nl - l) / (ns - s) * 5, 'extrapolated' from ob where ps is null
  union all select frame_index, s + 5, l + (l - pl) / (s - ps) * 5, 'extrapolated' from ob where ns is null
  union all select frame_index, c.s, l + (c.s - ob.s) / (ns - ob.s) * (nl - l), 'gap_interpolation' from ob join (values (6.0e0), (10.0e0), (15.0e0), (20.0e0),
    (25.0e0)) c(s) on c.s > ob.s and c.s < ns),
vg as (select v.*, intercept + slope_dh_dl * l as hr, coalesce(slope_dh_dl, 0) as k, coalesce(l between l_min and l_max, false) as ref from vx v left join ln on
  ln.frame_index = v.frame_index and ln.segment = case when s >= 5 and s < 30 then cast(floor((s - 5) / 2) as int) end),
sl as (select *, lead(s) over w as s1, lead(l) over w as l1, lead(hr) over w as h1, lead(k) over w as k1, lead(ref) over w as ref1, lead(role) over w as r1 from
  vg window w as (partition by frame_index order by s)),
sn as (select *, sqrt((s1 - s) ** 2 + (l1 - l) ** 2) as len, row_number() over w as n, lead(s1) over w is null as last, case when 'extrapolated' in (role, r1)
  then 'extrapolated' when 'gap_interpolation' in (role, r1) then 'gap_interpolation' else 'between_samples' end as srole from sl where s1 is not null window w
  as (partition by frame_index order by s)),
sg as materialized (select *, coalesce(sum(len) over (partition by frame_index order by s rows between unbounded preceding and 1 preceding), 0) as arc from sn),
st as (select frame_index, min(arc) filter (role = 'observed') as zero, min(s) as low, max(s1) as far from sg group by all),
ms as (select p.frame_index, p.point_id, p.s as ps, p.l as pl, p.h as ph, g.*, ((p.s - g.s) * (g.s1 - g.s) + (p.l - g.l) * (g.l1 - g.l)) / (len * len) as raw
  from pts p join sg g on g.frame_index = p.frame_index),
mt as (select *, greatest(0, least(1, raw)) as t from ms),
bt as (select * from (select *, row_number() over (partition by frame_index, point_id order by (ps - s - t * (s1 - s)) ** 2 + (pl - l - t * (l1 - l)) ** 2 +
  case srole when 'between_samples' then 1 when 'gap_interpolation' then 2 else 4 end * 1e-12, n) as place from mt) where place = 1),
ft as (select b.*, s + t * (s1 - s) as fs, l + t * (l1 - l) as fl, (n = 1 and raw < 0) or (last and raw > 1) as beyond, hr + t * (h1 - hr) as base, ref and ref1
  and hr is not null and h1 is not null as known_ref, (k + t * (k1 - k)) * (s1 - s) / len as kk from bt b),
sp2 as (select f.*, (-(ps - fs) * (l1 - l) + (pl - fl) * (s1 - s)) / len as across, exists (select 1 from ag o where o.frame_index = f.frame_index and
  abs(o.s_center - fs) <= 0.5e0) as close from ft f),
sp3 as (select *, case when beyond then 'unsupported' when close and srole in ('between_samples', 'gap_interpolation') then 'observed' else srole end as
  support, coalesce((across + kk * (ph - base)) / sqrt(1 + kk * kk), across) as lat, (ph - base - kk * across) / sqrt(1 + kk * kk) as vert from sp2),
sp4 as (select *, support in ('observed', 'between_samples') as placed from sp3),
rl as (select *, case when placed and abs(lat) > 1.05e0 then 'outside' when placed and known_ref and vert is not null then case when vert < 0 or vert > 3 then
  'outside' else 'inside' end else 'uncertain' end as rel from sp4)
"""


@query(f"""with {_CORRIDOR}
select frame_index, 'H1' as hypothesis, point_id, case when off then null else round(arc + t * len - zero, 6) end as path_s_m, case when off then null else
  round(lat, 6) end as lateral_m, case when off then null else round(vert, 6) end as vertical_m, case when off then 'unsupported' else support end as support, case
  when off then 'uncertain' else rel end as relation, case when off then 'outside_applicability' when rel <> 'uncertain' then null when support = 'unsupported' then
  'outside_applicability' when support in ('extrapolated', 'gap_interpolation') then support when not known_ref then 'reference_surface_unsupported' else
  'outside_applicability' end as uncertain_reason from (select r.*, ps < low or ps > far as off, zero from rl r join st using (frame_index))""")
def corridor_relations(spark, sf_dir):
    """All points against the corridor along the middle of the two sides."""
    base = pts, _, lines, _ = surface(spark, sf_dir)
    v = materialise(corridor.vertices(_midpoints(spark, sf_dir, base), lines, cfg=SPARSE), "vertices")
    return rounded(corridor.classify(pts, corridor.segments(v), v))


def along_pairs(spark, sf_dir, place: Attachment | None = None, pts=None):
    """Hypotheses of every frame, what was detected along each, and frames with their status."""
    pts, tracks, lines, residual, frag, sec = paired(spark, sf_dir, pts)
    of = F.format_string("H%d-%d", "a_track", "b_track").alias("hypothesis")
    midpoints = pairs.agreeing(sec).select("frame_index", of, F.col("s_center").alias("s"), F.col("mid_l").alias("l"))
    scored = pairs.scores(sec, residual, pairs.assumed_sections(frag)).withColumn("hypothesis", of)
    return inferred_frames(pts, tracks, lines, residual, frag, midpoints, scored, place)


def inferred_frames(pts, tracks, lines, residual, fragments, midpoints, scored, place: Attachment | None = None):
    """(hypotheses with their counts, detected, frames with their status) along the corridors of ``scored`` hypotheses."""
    midpoints, scored = materialise(midpoints, "midpoints"), materialise(scored, "hypotheses")
    match = None if place is None else corridor.attachment_match(midpoints, place)
    prior = None if place is None else (place.s_m, place.l_m)
    paths, vertex = inferred.paths_of(midpoints, scored, fragments, lines, residual, SPARSE, prior)
    known = materialise(inferred.hypotheses(scored, vertex, match), "known-hypotheses")
    paths = materialise(paths.join(inferred.usable(known), ["frame_index", "hypothesis"], "left_semi"), "paths")
    found = materialise(inferred.detect(ground.above_ground(pts, lines, SPARSE), paths), "detected")
    have = tracks.where("role = 'ground'").select("frame_index").distinct().withColumn("ground_found", F.lit(True))
    frames = pts.select("frame_index").distinct().join(have, "frame_index", "left").fillna(False, ["ground_found"])
    return inferred.counted(known, found), found, inferred.frame_statuses(frames, known, place is not None)


@query()
def inferred_candidates(spark, sf_dir):
    """Candidates in the corridor of each hypothesis, without the volumes of the lines that it was made of."""
    return rounded(inferred.candidates(along_pairs(spark, sf_dir)[1]).drop("label", "members"))


@query()
def inferred_hypotheses(spark, sf_dir):
    """Each hypothesis with its observed span, the points that each mask leaves, and its candidates."""
    return rounded(along_pairs(spark, sf_dir)[0])


@query()
def inferred_decisions(spark, sf_dir):
    """One decision for each frame of the inferred path: a status, and that without an explicit profile evidence is insufficient."""
    _, found, frames = along_pairs(spark, sf_dir)
    return _inferred_card(frames, found)


def _inferred_card(frames, found):
    """Cards of the inferred path."""
    judged = rule.with_evidence(inferred.candidates(found))
    return rounded(rule.decide(frames.withColumn("profile_applicable", F.lit(True)), judged).select("frame_index", "status", "hypotheses", "compatible", "applicable",
        "candidates", "intrusions", "decision", "reason"))


@query(f"""with {_SCORED}, ar as (select frame_index, list(mid_l order by s_center) as m, list(s_center order by s_center) as st, avg(mid_l) as lateral_m, count(*)::int as sections from ag group by frame_index),
sp as (select *, st[sections] - st[1] as span_m, (m[sections] - m[1]) / (st[sections] - st[1]) as direction, greatest(2, sections // 2) as half from ar where
  sections >= 2),
tn as (select *, case when sections >= 3 and span_m >= 4 then abs((m[sections] - m[half]) / (st[sections] - st[half]) - (m[half] - m[1]) / (st[half] - st[1]))
  end as direction_change from sp),
fl as (select t.*, kind, abs(lateral_m) > 1.05e0 as offset_, coalesce(direction_change > 0.15e0, false) as turns, kind <> 'consistent' or sections < 3 or span_m
  < 4 as weak from tn t join kd using (frame_index))
select frame_index, 0 as a_track, 1 as b_track, sections, round(lateral_m, 6) as lateral_m, round(span_m, 6) as span_m, round(direction, 6) as direction,
  round(direction_change, 6) as direction_change, kind, 0::bigint as shared_with, offset_ as "offset", turns, coalesce(abs(direction) > 0.15e0 and not turns,
  false) as constant_heading, weak, false as shared,
  case when weak then 'weak_or_shared' when offset_ then 'offset' when turns then 'turns_of_unknown_owner' when abs(direction) > 0.15e0 then 'constant_heading'
    else 'no_contradiction' end as reason, false as forbids from fl""")
def axis_assessment(spark, sf_dir):
    return rounded(rule.axis_assessment(*_kinds(spark, sf_dir)))


# --- candidates and decisions -----------------------------------------------------------

_MASKS = _DH + """,
bs as (select d.*, f.p95_m, d.s between 1 and 120 and abs(d.l) <= 1.05e0 and d.h between -1.075e0 and -1.075e0 + 3 as inside, 32 * 2.220446049250313e-16 *
  greatest(1, abs(d.h)) as slack from dh d left join fr f using (frame_index)),
mk as materialized (select *, coalesce(inside and supported and dh >= -slack and p95_m < 0.05e0 and dh <= p95_m + slack, false) as explained, coalesce(inside
  and supported and dh >= -slack and p95_m >= 0.05e0 and dh <= greatest(p95_m, 0.10e0), false) as ambiguous from bs)
"""
_POOL = _MASKS + """,
sl as materialized (select *, cast(floor(s/0.15e0) as int) i, cast(floor(l/0.15e0) as int) j, cast(floor(h/0.15e0) as int) k from mk where inside and not
  explained and not ambiguous),
st as (select a.x as di, b.x as dj, c.x as dk from (values (-1), (0), (1)) a(x), (values (-1), (0), (1)) b(x), (values (-1), (0), (1)) c(x)),
vi as (select frame_index, point_id, s, l, h, i + di as i, j + dj as j, k + dk as k from sl, st),
ed as materialized (select v.frame_index, v.point_id as a, w.point_id as b from vi v join sl w using (frame_index, i, j, k) where v.point_id <> w.point_id and
  (v.s-w.s)**2 + (v.l-w.l)**2 + (v.h-w.h)**2 <= 0.15e0 * 0.15e0),
rc as (select frame_index, point_id, point_id as r from sl union select rc.frame_index, ed.b, rc.r from rc join ed on ed.frame_index = rc.frame_index and ed.a =
  rc.point_id),
lb as materialized (select frame_index, point_id, min(r) as label from rc group by all)
"""


def _pool(spark, sf_dir):
    """Points of the straight volume that neither lines nor the surface explain."""
    return detect.object_pool(marked(spark, sf_dir)[1]).withColumn("radius", spatial.link_radius())


@query(f"with recursive {_POOL} select frame_index, point_id, label from lb")
def radius_components(spark, sf_dir):
    return spatial.components(_pool(spark, sf_dir)).select("frame_index", "point_id", "label")


@query(f"with recursive {_POOL} select frame_index, point_id, label from lb")
def radius_components_joined(spark, sf_dir):
    return spatial.components(_pool(spark, sf_dir), by_frame=False).select("frame_index", "point_id", "label")


@query(f"with recursive {_POOL} select frame_index, a, b from ed where a < b")
def radius_links(spark, sf_dir):
    return spatial.radius_links(_pool(spark, sf_dir), DETECTOR.link_m)


_CELLS = _POOL[: _POOL.index(",\nst as")] + """,
st as (select a.x as di, b.x as dj, c.x as dk from (values (-1), (0), (1)) a(x), (values (-1), (0), (1)) b(x), (values (-1), (0), (1)) c(x)),
ce as materialized (select frame_index, i, j, k, min(point_id) as f from sl group by all),
ed as materialized (select a.frame_index, a.f as a, b.f as b from (select frame_index, f, i + di as i, j + dj as j, k + dk as k from ce, st) a join ce b using
  (frame_index, i, j, k) where a.f <> b.f),
rc as (select frame_index, f, f as r from ce union select rc.frame_index, ed.b, rc.r from rc join ed on ed.frame_index = rc.frame_index and ed.a = rc.f),
lb as (select frame_index, f, min(r) as label from rc group by all)
"""


@query(f"""with recursive {_CELLS}
select sl.frame_index, sl.point_id, lb.label from sl join ce using (frame_index, i, j, k) join lb on lb.frame_index = ce.frame_index and lb.f = ce.f""")
def cell_components(spark, sf_dir):
    return spatial.cell_components(_pool(spark, sf_dir)).select("frame_index", "point_id", "label")


_CANDS = _POOL + """,
cd as (select l.frame_index, l.label, count(*) as unique_xyz, max(s)-min(s) as extent_s_m, max(p.l)-min(p.l) as extent_l_m, max(h)-min(h) as extent_h_m, min(s)
  as s_min_m, min(p.l) as l_min_m, min(h) as h_min_m, min(range_m) as range_from_sensor_m, case when count(*) >= 8 then 'large' else 'rare' end as kind from lb
  l join sl p on p.frame_index = l.frame_index and p.point_id = l.point_id group by l.frame_index, l.label),
cn as (select *, (case when kind = 'large' then 'L' else 'R' end) || row_number() over (partition by frame_index, kind order by s_min_m, l_min_m, h_min_m,
  label) as candidate_id from cd)
"""


@query(f"""with recursive {_CANDS}
select frame_index, candidate_id, kind, unique_xyz, round(extent_s_m, 6) as extent_s_m, round(extent_l_m, 6) as extent_l_m, round(extent_h_m, 6) as extent_h_m,
  round(s_min_m, 6) as s_min_m, round(range_from_sensor_m, 6) as range_from_sensor_m from cn""")
def candidates(spark, sf_dir):
    c = detect.candidates(spatial.components(_pool(spark, sf_dir)))
    return rounded(c.select("frame_index", "candidate_id", "kind", "unique_xyz", "extent_s_m", "extent_l_m", "extent_h_m", "s_min_m",
        "range_from_sensor_m"))


_JUDGED = _CANDS + """,
fl as (select *, unique_xyz >= 8 as enough, extent_s_m + 1e-9 >= 0.3e0 or extent_l_m + 1e-9 >= 0.3e0 as horizontal, extent_h_m + 1e-9 >= 0.3e0 as tall,
  extent_h_m + 1e-9 >= 0.1e0 as high, extent_h_m + 1e-9 < 0.05e0 and extent_l_m + 1e-9 >= 1.5e0 as sheet, greatest(extent_s_m, extent_l_m) + 1e-9 >= 0.8e0 as
  long, h_min_m + 1e-9 >= -1.075e0 + 1.0e0 as up from cn),
ev as (select *, case when unique_xyz <= 1 then null when enough and high and horizontal then 'volume' when enough and tall then 'vertical_face' when long and
  unique_xyz >= 10 and up and not sheet then 'thin_fragment' end as evidence from fl),
jd as (select *, case when unique_xyz <= 1 then 'single_point_is_weak' when evidence is not null then null when sheet and unique_xyz >= 10 and long then
  'wide_flat_sheet_not_a_fragment' when unique_xyz < 8 and not (long and unique_xyz >= 10 and up and not sheet) then 'support_below_large_min' else
  'extent_below_object_size' end as reason, case when s_min_m >= 25 then 'assumed_continuation' else 'near_straight_assumption' end as corridor_segment from ev)
"""


@query(f"with recursive {_JUDGED} select frame_index, candidate_id, evidence, reason, corridor_segment from jd")
def intrusion_evidence(spark, sf_dir):
    return decided(spark, sf_dir)[1].select("frame_index", "candidate_id", "evidence", "reason", "corridor_segment")


#: Cards by the straight profile; also what the job that decides frames is held against.
DECIDED = _DECIDED = _JUDGED + """,
gf as (select distinct frame_index from gm),
dc as (select f.frame_index, gf.frame_index is not null as ground, count(j.frame_index) as candidates, count(evidence) as intrusions, min(range_from_sensor_m)
  filter (evidence is not null) as nearest from (select distinct frame_index from pts) f left join gf using (frame_index) left join jd j on j.frame_index =
  f.frame_index group by all)
select frame_index, 'ok' as status, candidates, case when ground then intrusions else 0 end as intrusions, round(case when ground then nearest end, 6) as
  nearest_intrusion_m, case when not ground then 'insufficient_evidence' when intrusions > 0 then 'conditional_intrusion' when candidates > 0 then
  'candidate_only' else 'no_intrusion_detected' end as decision,
  case when not ground then 'no_ground_filter' when intrusions > 0 then 'unexplained_cluster_in_the_volume' when candidates > 0 then 'no_candidate_accepted'
    else 'nothing_in_the_volume' end as reason from dc
"""


def _card(frames, judged):
    return rounded(rule.decide(frames, judged).select("frame_index", "status", "candidates", "intrusions", "nearest_intrusion_m",
        "decision", "reason"))


@query(f"with recursive {_DECIDED}")
def frame_decisions(spark, sf_dir):
    """The flagship: from points to one decision for each frame by the straight profile.

    Only a pair of lines that is known to be the own track can forbid the profile, and none is known here.
    """
    return straight_cards(spark, points(spark, sf_dir))


def straight_cards(spark, pts):
    """One card for each frame of ``pts`` (places dealt by frame, as ``fixtures.grouped`` gives them) by the straight profile."""
    _, judged, frames = decided(spark, None, pts)
    return _card(frames.withColumn("profile_applicable", F.lit(True)), judged)


@query(f"with recursive {_DECIDED}")
def assessed_decisions(spark, sf_dir):
    """The same with every pair of lines held against the straight axis before the rule."""
    base = surface(spark, sf_dir)
    _, judged, frames = decided(spark, sf_dir, base=base)
    _, _, _, residual, frag, sec = paired(spark, sf_dir, base=base)
    axis = rule.axis_assessment(pairs.agreeing(sec), pairs.scores(sec, residual, pairs.assumed_sections(frag)))
    return _card(rule.applicable(frames, axis), judged)


#: A change of heading that counts in ``owned_decisions``: small, as the lines of the cloud hardly turn.
OWN_AXIS = Axis(heading=0.002)
_OWNED = _SCORED + """,
ar as (select frame_index, list(mid_l order by s_center) as m, list(s_center order by s_center) as stn, avg(mid_l) as lateral_m, count(*)::int as sections from ag group by frame_index),
spn as (select *, stn[sections] - stn[1] as span_m, greatest(2, sections // 2) as half from ar where sections >= 2),
tn as (select *, case when sections >= 3 and span_m >= 4 then abs((m[sections] - m[half]) / (stn[sections] - stn[half]) - (m[half] - m[1]) / (stn[half] - stn[1])) end as direction_change from spn),
ag2 as (select t.frame_index from tn t join kd using (frame_index) join supplier on s_suppkey = frame_index where kind = 'consistent' and sections >= 3 and span_m >= 4 and abs(lateral_m) <= 1.05e0
  and direction_change > 0.002e0 and s_acctbal > 0)
""" + _DECIDED[len(_DH) : _DECIDED.index("select frame_index, 'ok' as status")] + """
select d.frame_index, 'ok' as status, candidates, case when ground and a.frame_index is null then intrusions else 0 end as intrusions, round(case when ground and a.frame_index is null then nearest
  end, 6) as nearest_intrusion_m, case when a.frame_index is not null or not ground then 'insufficient_evidence' when intrusions > 0 then 'conditional_intrusion' when candidates > 0 then
  'candidate_only' else 'no_intrusion_detected' end as decision, case when a.frame_index is not null then 'profile_not_applicable' when not ground then 'no_ground_filter' when intrusions > 0 then
  'unexplained_cluster_in_the_volume' when candidates > 0 then 'no_candidate_accepted' else 'nothing_in_the_volume' end as reason from dc d left join ag2 a on a.frame_index = d.frame_index
"""


@query(f"with recursive {_OWNED}")
def owned_decisions(spark, sf_dir):
    """Decisions where some tracks are known to be the own one: those of suppliers with a positive balance. If it turns, the straight profile is refused."""
    base = surface(spark, sf_dir)
    _, judged, frames = decided(spark, sf_dir, base=base)
    sections_, scored = _kinds(spark, sf_dir, base)
    known = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("frame_index"), F.lit(0).alias("a_track"), F.lit(1).alias("b_track"))
    axis = rule.axis_assessment(sections_, scored, known, OWN_AXIS)
    return _card(rule.applicable(frames, axis), judged)


@query(f"with recursive {_DECIDED}")
def packed_decisions(spark, sf_dir):
    """The same from packed messages: decoded, valid records only, exact groups."""
    messages = materialise(pointcloud.packed(records(spark, sf_dir).select("frame_index", "source_index", "x", "y", "z", "intensity",
                "ring")), "messages")
    decoded = cloud.valid(pointcloud.points(messages, "double"))
    return straight_cards(spark, grouped(decoded))


def _along_sides(spark, sf_dir, place: Attachment | None = None):
    """The inferred path along the middle of the two sides, which SQL can follow: hypothesis H1 of a frame."""
    base = pts, tracks, lines, residual = surface(spark, sf_dir)
    sides, sec = _side_sections(spark, sf_dir, base)
    of = F.lit("H1").alias("hypothesis")
    midpoints = pairs.agreeing(sec).select("frame_index", of, F.col("s_center").alias("s"), F.col("mid_l").alias("l"))
    scored = pairs.scores(sec, residual, pairs.assumed_sections(sides).where("false")).withColumn("hypothesis", of)
    return inferred_frames(pts, tracks, lines, residual, sides, midpoints, scored, place)


#: Where a session is attached in the queries: past the sections of its window, so that it adds no vertex.
PLACE = Attachment(s_m=16.0, l_m=0.0, support_s_min_m=5.0, support_s_max_m=16.0, lateral_m=0.02, heading=0.0, heading_tolerance=0.002)
_FITS = """,
win as (select frame_index, arg_min(mid_l, abs(s_center - 16)) as near_l, arg_min(mid_l, s_center) as la, arg_max(mid_l, s_center) as lb, max(s_center) - min(s_center) as ds, count(*) as n
  from ag where s_center between 5 and 16 group by frame_index),
hy as materialized (select f.frame_index, win.frame_index is not null and abs(near_l) <= 0.02e0 and (n < 2 or abs((lb - la) / ds) <= 0.002e0) as fits from (select distinct frame_index from ag) f
  left join win using (frame_index))
"""
_ALL_FIT = """,
hy as materialized (select distinct frame_index, true as fits from ag)
"""
#: Points inside the corridor of a hypothesis that fits, without its lines and what the ground explains; then as along the straight profile.
_ALONG = """,
us as materialized (select frame_index from hy where fits and frame_index in (select frame_index from vg where role = 'observed' and hr is not null)),
sm as (select d.*, coalesce(d.l_median between g.l_min and g.l_max, false) as held from sd d left join ln g on g.frame_index = d.frame_index and g.segment = cast(floor((d.s_center - 5) / 2) as int)),
onl as materialized (select distinct p.frame_index, p.point_id from pts p join sm on sm.frame_index = p.frame_index and abs(p.s - sm.s_center) <= 0.5e0 and abs(p.l - sm.l_median) <= sm.width_m / 2
  where sm.held and abs(p.h - sm.h_median) <= 0.05e0),
ic as materialized (select r.frame_index, r.point_id from rl r join st on st.frame_index = r.frame_index join us on us.frame_index = r.frame_index where r.rel = 'inside' and not (r.ps < low or r.ps > far)),
bs as (select d.*, f.p95_m, ic.point_id is not null as within, ic.point_id is not null and onl.point_id is null as inside, 32 * 2.220446049250313e-16 * greatest(1, abs(d.h)) as slack from dh d
  left join fr f on f.frame_index = d.frame_index left join ic on ic.frame_index = d.frame_index and ic.point_id = d.point_id left join onl on onl.frame_index = d.frame_index and
  onl.point_id = d.point_id),
mk as materialized (select *, coalesce(inside and supported and dh >= -slack and p95_m < 0.05e0 and dh <= p95_m + slack, false) as explained, coalesce(inside
  and supported and dh >= -slack and p95_m >= 0.05e0 and dh <= greatest(p95_m, 0.10e0), false) as ambiguous from bs)
""" + re.sub(r"\bst\b", "steps", re.sub(r"\bsl\b", "pooled", _JUDGED[len(_MASKS) :]))  # the corridor has these names
_SIDE_CARDS = """,
gf as (select distinct frame_index from gm),
cs as (select frame_index, count(*) as candidates from jd group by all),
fs as (select f.frame_index, gf.frame_index is not null as ground, (hy.frame_index is not null)::int as hypotheses, coalesce(hy.fits, false)::int as compatible, (us.frame_index is not null)::int
  as applicable, coalesce(candidates, 0) as candidates from (select distinct frame_index from pts) f left join gf using (frame_index) left join hy using (frame_index) left join us using
  (frame_index) left join cs using (frame_index)),
ss as (select *, case when not ground then 'insufficient_geometry' when hypotheses = 0 then EMPTY when compatible = 0 then 'attachment_conflict' when applicable = 0 then
  'insufficient_geometry' else 'ok' end as status from fs)
select frame_index, status, hypotheses::bigint as hypotheses, compatible::bigint as compatible, applicable::bigint as applicable, candidates, 0::bigint as intrusions,
  case when status = 'insufficient_geometry' then status else 'insufficient_evidence' end as decision, case when status = 'insufficient_geometry' then 'ground_not_built' else
  'no_explicit_profile' end as reason from ss
"""


@query(f"with recursive {_CORRIDOR}" + _ALL_FIT + _ALONG + _SIDE_CARDS.replace("EMPTY", "'no_hypotheses'"))
def side_decisions(spark, sf_dir):
    """One decision for each frame along the middle of its two sides."""
    _, found, frames = _along_sides(spark, sf_dir)
    return _inferred_card(frames, found)


@query(f"with recursive {_CORRIDOR}" + _FITS + _ALONG + _SIDE_CARDS.replace("EMPTY", "'attachment_conflict'"))
def attached_decisions(spark, sf_dir):
    """The same in a session that is attached to a place: hypotheses that miss it are left alone."""
    _, found, frames = _along_sides(spark, sf_dir, PLACE)
    return _inferred_card(frames, found)


@query(f"with recursive {_CORRIDOR}" + _ALL_FIT + _ALONG + """,
ks as (select frame_index, count(*) filter (kind = 'large') as volume_large, count(*) filter (kind = 'rare') as volume_rare from jd group by all),
fu as (select frame_index, count(*) as points, count(*) filter (within) as in_volume, count(*) filter (inside) as off_lines, count(*) filter (inside and not explained) as off_surface,
  count(*) filter (inside and not explained and not ambiguous) as in_pool, count(*) filter (inside and ambiguous) as in_layer from mk group by all)
select 'H1' as hypothesis, fu.*, coalesce(volume_large, 0) as volume_large, coalesce(volume_rare, 0) as volume_rare from us join fu using (frame_index) left join ks using (frame_index)""")
def side_funnel(spark, sf_dir):
    """Points of the hypothesis along the two sides after each mask, and its candidates by kind."""
    names = ("points", "in_volume", "off_lines", "off_surface", "in_pool", "in_layer", "volume_large", "volume_rare")
    return _along_sides(spark, sf_dir)[0].where("detected").select("frame_index", "hypothesis", *names)


@query(f"""with {_MASKS}
select frame_index, count(*) as points, count(*) filter (inside) as in_volume, count(*) filter (inside) as off_lines, count(*) filter (inside and not explained) as
  off_surface, count(*) filter (inside and not explained and not ambiguous) as in_pool from mk group by frame_index""")
def detection_funnel(spark, sf_dir):
    return evaluate.funnel(marked(spark, sf_dir)[1])


@query()
def local_protrusions(spark, sf_dir):
    """Points of the layer that a rough ground leaves ambiguous, against local planes."""
    base = surface(spark, sf_dir)
    marks = marked(spark, sf_dir, coarse_m=0.06, base=base)[1]
    asked = frame_keyed(marks.where("inside and ambiguous").select("frame_index", "point_id", "s", "l", "h"), dealt=True)
    return rounded(detect.local_protrusions(asked, base[0]).groupBy("frame_index", "reason", "accepted", "radius_m").agg(F.count("*").alias("points")))


@query()
def united_candidates(spark, sf_dir):
    """Candidates of the pool and of local protrusions of a rough ground, with their evidence."""
    base = surface(spark, sf_dir)
    judged = rule.with_evidence(detect.straight_candidates(marked(spark, sf_dir, coarse_m=0.06, base=base)[1], points=base[0]))
    return rounded(judged.select("frame_index", "candidate_id", "branch", "kind", "unique_xyz", "extent_s_m", "extent_l_m", "extent_h_m",
        "range_from_sensor_m", "evidence", "reason"))


_INSERTED = _POOL + """,
ins as (select frame_index, point_id, range_m, inside, explained, ambiguous from mk where q > 44),
sz as (select frame_index, label, count(*) as n, min(sl.range_m) as near from lb join sl using (frame_index, point_id) group by all),
ht as (select lb.frame_index, lb.label, count(*) as hits, min(ins.range_m) as true_near from lb join ins using (frame_index, point_id) group by all),
pc as (select ht.*, n, hits / n as share, abs(near - true_near) as err from ht join sz using (frame_index, label)),
fm as (select frame_index, sum(hits)::bigint as hits, count(*) as pieces, bool_or(share > 0.5) as mostly, bool_or(hits < n and share <= 0.5) as merged from pc
  group by all),
tt as (select frame_index, count(*) as inserted, count(*) filter (inside) as inside, count(*) filter (inside and not explained and not ambiguous) as in_pool,
  count(*) filter (inside and ambiguous) as in_layer from ins group by all)
select tt.*, 0::bigint as on_lines, coalesce(hits, 0) as hits, coalesce(pieces, 0) as pieces, case when inside = 0 then 'outside_corridor' when mostly then
  'predominantly_insertion' when merged then 'merged_with_background' when in_layer > 0 and hits is null then 'ambiguous_layer_only' else 'no_candidate' end as
  outcome from tt left join fm using (frame_index)
"""


@query(f"with recursive {_INSERTED}")
def insertion_outcomes(spark, sf_dir):
    """The boxes of the cloud as insertions, which only the evaluation knows of."""
    marks, judged, _ = decided(spark, sf_dir)
    return evaluate.insertion(marks, judged, marks.where("q > 44").select("frame_index", "point_id", "range_m")).drop("candidate_id",
        "share", "range_error_m")


# --- evaluation, grid, windows ------------------------------------------------------------


@query(f"""with {DUCK_POINTS}, g as (select *, cast(floor(s/0.25e0) as int) as bin from pts where s between 1 and 120 and abs(l) <= 1.05e0 and h between -1.075e0 and -1.075e0 + 3),
b as (select frame_index, bin, count(*) as n from g group by all having count(*) >= 40), m as (select frame_index, arg_max(bin, n * 10000 - bin) * 0.25e0 as
  s_lo_m from b group by frame_index),
sb as (select g.*, s_lo_m from g join m using (frame_index) where s >= s_lo_m and s < s_lo_m + 0.40e0), cr as (select *, h >= quantile_cont(h, 0.12) over
  (partition by frame_index) + 0.05e0 as core from sb),
x as (select frame_index, s_lo_m, count(*) as n, max(l) - min(l) as wide, count(*) filter (core) as core, max(h) filter (core) - min(h) filter (core) as core_h,
  quantile_cont(l, 0.04) filter (core) as l4, quantile_cont(l, 0.96) filter (core) as l96, quantile_cont(h, 0.04) filter (core) as h4, quantile_cont(h, 0.96)
  filter (core) as h96 from cr group by all having count(*) >= 40),
r as (select *, case when wide > 3.6e0 then 'spans_the_tunnel' when core < 30 or core_h < 0.45e0 then 'not_apart_from_the_floor' else 'separated' end as reason
  from x)
select frame_index, s_lo_m, n, core, reason, round(case when reason = 'separated' then l4 end, 6) as l_p4, round(case when reason = 'separated' then l96 end, 6)
  as l_p96, round(case when reason = 'separated' then h4 end, 6) as h_p4, round(case when reason = 'separated' then h96 end, 6) as h_p96 from r""")
def face_slabs(spark, sf_dir):
    return rounded(evaluate.faces(points(spark, sf_dir), detect.in_profile()))


_GRID = DUCK_CLOUD + """,
an as (select *, case when degrees(atan2(y, x)) >= 180 then degrees(atan2(y, x)) - 360 else degrees(atan2(y, x)) end as az, degrees(atan2(z, sqrt(x*x + y*y)))
  as el from cloud where range_m >= 1e-3),
gb as (select *, floor(min(el) over (partition by frame_index) / 0.2e0) * 0.2e0 as lo, ceil(max(el) over (partition by frame_index) / 0.2e0) * 0.2e0 as hi from an),
gd as (select *, greatest(least(cast(floor((az + 180) / 0.2e0) as int), 1799), 0) as col, greatest(least(cast(floor((el - lo) / 0.2e0) as int),
  greatest(cast(round((hi - lo) / 0.2e0) as int), 1) - 1), 0) as row from gb)
"""


@query(f"""with {_GRID},
b as (select frame_index, row, col, count(*) as n, max(range_m) - min(range_m) as spread from gd group by all)
select frame_index, count(*) as bins, sum(n)::bigint as points, count(*) filter (n >= 2) as collisions, count(*) filter (n >= 2 and spread > 0.2e0) as
  multiple_returns, max(n) as fullest from b group by frame_index""")
def angular_occupancy(spark, sf_dir):
    return angular.occupancy(angular.grid(stored(spark, sf_dir)))


@query(f"with {_GRID} select frame_index, row, col, round(arg_min(intensity, range_m), 6) as value from gd group by all")
def angular_raster(spark, sf_dir):
    return rounded(angular.raster(angular.grid(stored(spark, sf_dir))))


@query(f"""with {_GRID},
c as (select *, radians((col + 0.5) * 0.2e0 - 180.0) as ca, radians(lo + (row + 0.5) * 0.2e0) as ce from gd),
e as (select frame_index, sqrt(power(range_m * cos(ce) * cos(ca) - x, 2) + power(range_m * cos(ce) * sin(ca) - y, 2) + power(range_m * sin(ce) - z, 2)) as err from
  c)
select frame_index, round(quantile_cont(err, 0.5), 6) as p50_m, round(quantile_cont(err, 0.95), 6) as p95_m, round(max(err), 6) as max_m from e group by frame_index""")
def angular_error(spark, sf_dir):
    return rounded(angular.quantisation(angular.grid(stored(spark, sf_dir))))


@query(f"""with {DUCK_CLOUD}
select frame_index, cast(floor(s/0.5e0) as int) as ca, cast(floor(l/0.5e0) as int) as cb, round(min(range_m), 6) as range_m from cloud group by all""")
def display_cells(spark, sf_dir):
    return rounded(angular.display_cells(records(spark, sf_dir), "s", "l", "range_m", 0.5).select("frame_index", "ca", "cb", "range_m"))


@query(f"""with {DUCK_CLOUD},
n as (select frame_index, count(*) as n from cloud group by all),
k as (select frame_index, cast(floor(i.i * (n - 1) / 99) as bigint) + 1 as source_index from n, range(0, 100) i(i)),
hl as (select frame_index, source_index from cloud where q > 48),
u as (select frame_index, source_index from k union select frame_index, source_index from hl)
select u.frame_index, u.source_index, case when hl.source_index is null then 0 else 1 end as label from u left join hl using (frame_index, source_index)""")
def display_sample(spark, sf_dir):
    pts = records(spark, sf_dir)
    return angular.display_sample(pts, 100, pts.where("q > 48"))


@query(f"""with {DUCK_CLOUD},
k as (select *, case when q <= 34 then 'floor' when q <= 40 then 'rail' else 'wall' end as kind, case when range_m >= 200 then 5 when range_m >= 100 then 4 when
  range_m >= 50 then 3 when range_m >= 30 then 2 when range_m >= 10 then 1 else 0 end as band from cloud),
d as (select f.frame_index, t.kind, b.band from (select distinct frame_index from cloud) f, (values ('rail'), ('floor'), ('wall')) t(kind), (values (0), (1), (2),
  (3), (4), (5)) b(band)),
s as (select frame_index, kind, band, count(*) as points from k group by all)
select d.*, coalesce(points, 0) as points from d left join s using (frame_index, kind, band)""")
def evidence_table(spark, sf_dir):
    kind = F.when(F.col("q") <= 34, "floor").when(F.col("q") <= 40, "rail").otherwise("wall")
    return angular.evidence_table(records(spark, sf_dir).withColumn("kind", kind), ["rail", "floor", "wall"])


@query(f"""with {DUCK_POINTS},
s as (select frame_index, h, h - lag(h) over w as step, row_number() over w - 1 as below, count(*) over (partition by frame_index) as n from pts window w as
  (partition by frame_index order by h))
select frame_index, coalesce(bool_or(step > 0.08e0 and below >= 6 and n - below >= 6), false) as several_levels from s group by frame_index""")
def level_gaps(spark, sf_dir):
    return windows.level_gap(points(spark, sf_dir), ["frame_index"])


@query(f"""with {DUCK_POINTS},
q as (select frame_index, quantile_cont(h, 0.4) as q from pts group by all)
select p.frame_index, count(*) as points, round(max(h), 6) as highest_m from pts p join q on q.frame_index = p.frame_index where p.h <= q.q + 1e-12 group by
  p.frame_index""")
def lower_support(spark, sf_dir):
    low = windows.lower_support(points(spark, sf_dir), ["frame_index"])
    return rounded(low.groupBy("frame_index").agg(F.count("*").alias("points"), F.max("h").alias("highest_m")))


@query("""with e as (select *, case when event_id % 1000 = 0 then ts - interval 1 day else ts end as t from events),
b as (select *, coalesce(cast(t < lag(t) over (partition by user_id order by event_id) as int), 0) as back from e),
s as (select user_id, event_id, sum(back) over (partition by user_id order by event_id rows unbounded preceding) as session_id from b)
select user_id, session_id::bigint as session_id, count(*) as events, min(event_id) as first_event from s group by all""")
def session_resets(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.when(F.col("event_id") % 1000 == 0,
            F.col("ts") - F.expr("interval 1 day")).otherwise(F.col("ts")))
    return windows.sessions(e, "t", "event_id", "user_id").groupBy("user_id", "session_id").agg(F.count("*").alias("events"),
        F.min("event_id").alias("first_event"))


@query("""select user_id, event_id, sum(cast(value > 50 as int)) over (partition by user_id order by event_id rows between 2 preceding and current row) >= 2 as confirmed from
  events""")
def confirmations(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("seen", F.col("value") > 50)
    return windows.confirmed(e, "seen", "event_id", "user_id").select("user_id", "event_id", "confirmed")


@query("""with t as (select user_id, event_id, epoch(ts) as t from events),
w as (select event_id, user_id, count(*) over r as n, max(t) over r - min(t) over r as span from t window r as (partition by user_id order by t range between 5
  preceding and current row))
select event_id, user_id, round(case when span > 0 then (n - 1) / span else 0 end, 6) as rate_hz from w""")
def event_rates(spark, sf_dir):
    return rounded(windows.rates(table(spark, sf_dir, "events"), "ts", "user_id").select("event_id", "user_id", "rate_hz"))


@query("""select user_id, event_id, round(median(value) over (partition by user_id order by event_id rows between 8 preceding and current row), 6) as tail_median from events""")
def tail_medians(spark, sf_dir):
    return rounded(windows.tail_median(table(spark, sf_dir, "events"), "value", "event_id", "user_id").select("user_id", "event_id", "tail_median"))


@query("""with b as (select *, event_id // 50 as slot from events),
n as (select *, row_number() over (partition by slot order by event_id desc) as r, count(*) over (partition by slot) - 1 as dropped from b)
select slot, event_id, dropped from n where r = 1""")
def keep_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("slot", F.expr("event_id div 50"))
    return windows.keep_latest(e, "slot", "event_id").select("slot", "event_id", "dropped")


@query("""with a as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events where event_id % 2 = 0),
b as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events where event_id % 2 = 1)
select a.user_id, a.n::int as n, a.event_id, b.event_id as r_event_id from a join b using (user_id, n)""")
def fifo_pairs(spark, sf_dir):
    """Two queues of each user, the even and the odd events."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return windows.pair_fifo(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "event_id", "user_id").select("user_id", "n",
        "event_id", "r_event_id")


@query("""with j as (select event_id as frame_index, event_type as status, value as range_m from events),
a as (select frame_index, case when frame_index % 97 = 0 then 'changed' else status end as status, range_m + case when frame_index % 89 = 0 then 0.001e0 else 0 end
  as range_m from j where frame_index % 101 <> 0)
select j.frame_index, d.difference from j left join a using (frame_index), lateral (select unnest([case when a.status is null then 'missing_frame' end, case when
  a.status is not null and a.status <> j.status then 'status' end, case when a.status is not null and not abs(a.range_m - j.range_m) <= 1e-5 then 'range_m' end]) as
  difference) d where d.difference is not null""")
def result_comparison(spark, sf_dir):
    want = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_index"), F.col("event_type").alias("status"),
        F.col("value").alias("range_m"))
    n = F.col("frame_index")
    got = want.where(n % 101 != 0).select("frame_index", F.when(n % 97 == 0, "changed").otherwise(F.col("status")).alias("status"),
        (F.col("range_m") + F.when(n % 89 == 0, 0.001).otherwise(0.0)).alias("range_m"))
    return evaluate.compare(want, got, ["status"], ["range_m"])


_STATUS = "case when value < 5 then 'error' when value < 12 then 'no_hypotheses' when value < 30 then 'insufficient_geometry' when value < 33 then 'processing_timeout' else 'ok' end"


def _frames(spark, sf_dir):
    """Events as results of frames, with every status."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_index"), F.col("event_type").alias("run"),
        F.expr(_STATUS).alias("status"), F.col("user_id").alias("support"), F.col("user_id").alias("candidates"),
        F.col("value").alias("seconds"))


@query(f"""with f as (select *, {_STATUS} as status from events)
select event_type as run, count(*) as frames, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'error') as errors, count(*) filter (status in
  ('no_hypotheses', 'insufficient_geometry')) as no_geometry, round(avg(cast(status in ('no_hypotheses', 'insufficient_geometry') as int)), 6) as share_no_geometry,
  min(user_id) as support_min, max(user_id) as support_max, round(quantile_cont(value, 0.5), 6) as p50_s, round(quantile_cont(value, 0.95), 6) as p95_s,
  round(sum(value), 4) as sum_s from f group by event_type""")
def run_summary(spark, sf_dir):
    return rounded(evaluate.run_summary(_frames(spark, sf_dir))).withColumn("sum_s", F.round("sum_s", 4))


@query(f"""with f as (select *, {_STATUS} as status from events),
c as (select status, count(*) as n, min(event_id) as frame_index from f where status in ('error', 'no_hypotheses', 'insufficient_geometry') group by status)
select * from (select 'most_candidates' as why, event_id as frame_index, user_id as n from events order by user_id desc, event_id limit 1) union all select * from
  (select 'commonest_failure', frame_index, n from c order by n desc, frame_index limit 1)""")
def frame_picks(spark, sf_dir):
    return evaluate.pick_frames(_frames(spark, sf_dir))


@query("select user_id, event_id, substring(sha256(concat_ws('|', user_id, event_id, event_type)), 1, 16) as identity from events")
def run_identity(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", scalars.identity("user_id", "event_id", "event_type").alias("identity"))


@query("""with k as (select *, event_id // 200 as sequence, row_number() over (partition by user_id, event_id // 200 order by event_id desc) as r, count(*) over (partition by
  user_id, event_id // 200) - 1 as dropped from events),
b as (select *, coalesce(cast(ts < lag(ts) over (partition by user_id order by event_id) as int), 0) as back from k where r = 1),
s as (select *, sum(back) over (partition by user_id order by event_id rows unbounded preceding) as session_id from b)
select user_id as source, session_id::bigint as session_id, sequence, event_id, dropped from s""")
def stream_journal(spark, sf_dir):
    return replay.journal_of(table(spark, sf_dir, "events"))


@query()
def stream_tracks(spark, sf_dir):
    return replay.tracks_of(table(spark, sf_dir, "events"))



@query()
def stream_pair_histories(spark, sf_dir):
    """Histories of each user's events as widths of one pair."""
    return rounded(replay.histories_of(table(spark, sf_dir, "events")))


# --- streams over what frames really gave -----------------------------------------------------


def _streamed(spark, rows, run, parts: int = 3):
    """``rows`` (with ``frame``) through a stream: written in the order of frames as so many files or more, one part a micro-batch."""
    path, rows = scratch_path(spark, "stream"), materialise(rows, "stream-rows")
    ends = rows.agg(F.min("frame").alias("lo"), F.max("frame").alias("hi")).first()
    if ends.lo is None:
        return run(rows)
    part = F.floor((F.col("frame") - ends.lo) * parts / (ends.hi - ends.lo + 1))
    for k in range(parts):
        rows.where(part == k).write.parquet(f"{path}/in/part={k}")
    with stateful.rocksdb(spark):
        for k in range(parts):  # the checkpoint carries the state from one run to the next
            stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in/part={{{','.join(map(str, range(k + 1)))}}}")
            out = run(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
            out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _recordings(spark, sf_dir):
    """Frames with the recording that they are of, as the key of its session."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame_index"), F.col("s_nationkey").cast("long").alias("session_key"))


def _tracked(spark, sf_dir):
    """Candidates of the flagship, tracked over the frames of their recording: places are the medians of their points."""
    marks, judged, _ = decided(spark, sf_dir)
    members = judged.select("frame_index", "candidate_id", F.explode("members").alias("point_id"))
    places = members.join(marks.select("frame_index", "point_id", "s", "l", "h"), ["frame_index", "point_id"]).groupBy("frame_index", "candidate_id").agg(
        *[F.median(c).alias(c) for c in "slh"])
    rows = places.join(_recordings(spark, sf_dir), "frame_index").select("session_key", F.col("frame_index").alias("frame"), (F.col("frame_index") * 0.1).alias("stamp_s"),
        "candidate_id", F.lit("configured_straight").alias("corridor_key"), "s", "l", "h")
    return _streamed(spark, rows, stateful.track_stream)


@query()
def streamed_tracks(spark, sf_dir):
    return _tracked(spark, sf_dir)


@query(f"""with recursive {_JUDGED} select s_nationkey::bigint as session_key, frame_index as frame, count(*) as published from jd join supplier on s_suppkey = frame_index group by all""")
def published_candidates(spark, sf_dir):
    """Tracking hides nothing: every candidate of every frame comes out once, whatever became of it."""
    return _tracked(spark, sf_dir).where("candidate_id is not null").groupBy("session_key", "frame").agg(F.count(F.lit(1)).alias("published"))


@query()
def streamed_pair_histories(spark, sf_dir):
    """Histories of the pair of sides over the frames of a recording, with slope and place where its line is reliable."""
    base = surface(spark, sf_dir)
    sides, sec = _side_sections(spark, sf_dir, base)
    keys = ["frame_index", "a_track", "b_track"]
    agreed = pairs.agreeing(sec)
    fitted = pairs.median_slope_line(agreed, keys, "s_center", "mid_l")
    pose = pairs.pose_at_reference(agreed, fitted, keys).join(fitted.select(*keys, "k"), keys, "left")
    slope = F.when(F.col("reliable"), F.col("k"))
    pair = F.struct(F.col("left_l_m").alias("left"), F.col("right_l_m").alias("right"), F.col("distance_m").alias("distance"), slope.alias("slope"), F.col("model_l_m").alias("place"))
    measured = pairs.pairs(sec).join(pose.select(*keys, "reliable", "k", "model_l_m"), keys, "left").groupBy("frame_index").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    seen = sides.groupBy("frame_index", "track").agg(F.median("l_median").alias("at")).groupBy("frame_index").agg(F.sort_array(F.collect_list("at")).alias("lines"))
    ground_found = base[1].where("role = 'ground'").select("frame_index").distinct().withColumn("ground_found", F.lit(True))
    frames = points(spark, sf_dir).select("frame_index").distinct()
    for part in (measured, seen, ground_found):
        frames = frames.join(part, "frame_index", "left")
    rows = frames.join(_recordings(spark, sf_dir), "frame_index").select("session_key", F.col("frame_index").alias("frame"), F.coalesce("ground_found", F.lit(False)).alias("ground_found"),
        "pairs", "lines")
    return rounded(_streamed(spark, rows, stateful.history_stream))
