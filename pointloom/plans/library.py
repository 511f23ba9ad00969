"""Further queries: each applies one operator of the library to the whole cloud or to the events, beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SPARSE
from ..operators import angular, cloud, corridor, detect, evaluate, ground, marks, pairs, spatial, windows
from ..session import materialise, scratch_path, table
from ..sources import journal, pointcloud
from ..streaming import live
from .fixtures import DUCK_CLOUD, DUCK_POINTS, cloud as records, points, stored
from .registry import (
    DECIDED, _CORRIDOR, _JUDGED, _MASKS, _POOL, _SIDES, _STATUS, _frames, _midpoints, _pool, _sides, decided, marked, query, rounded, surface,
)

# --- records and frames -----------------------------------------------------------------


@query(f"""with {DUCK_CLOUD} select frame_index, source_index, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, ring,
  round(cast(intensity as float)::double, 5) as intensity, 1::int as absent from cloud""")
def decoded_points(spark, sf_dir):
    """Records packed into messages and decoded again, in the declared type of their coordinates."""
    messages = pointcloud.packed(records(spark, sf_dir).select("frame_index", "source_index", "x", "y", "z", "intensity", "ring"))
    # places in a message start at 0, and messages are in the order of source_index
    p = pointcloud.points(materialise(messages, "messages"), "double")
    p = p.select("frame_index", (F.col("source_index") + 1).alias("source_index"), "x", "y", "z", "ring",
        F.round(F.col("intensity").cast("double"), 5).alias("intensity"), F.size("absent_fields").alias("absent"))
    return rounded(p)


@query(f"""with {DUCK_CLOUD} select frame_index, frame_index * 100000000 as stamp_ns, 'sensor' as frame_id, 1::int as height, count(*)::int as width,
  30::int as point_step, (count(*) * 30)::int as row_step, false as is_bigendian, false as has_return_type, ['x', 'y', 'z', 'intensity', 'ring'] as field_names
  from cloud group by frame_index""")
def message_headers(spark, sf_dir):
    rows = records(spark, sf_dir).select("frame_index", "source_index", "x", "y", "z", "intensity", "ring")
    return pointcloud.headers(pointcloud.packed(rows))


@query(f"""with {DUCK_CLOUD} select frame_index, source_index, round(case when degrees(atan2(y, x)) >= 180 then degrees(atan2(y, x)) - 360 else degrees(atan2(y, x)) end, 6) as azimuth_deg,
  round(degrees(atan2(z, sqrt(x * x + y * y))), 6) as elevation_deg from cloud""")
def point_angles(spark, sf_dir):
    return rounded(cloud.angles(records(spark, sf_dir)).select("frame_index", "source_index", "azimuth_deg", "elevation_deg"))


@query(f"""with {DUCK_CLOUD}, f as (select frame_index, cast(x as float) x, cast(y as float) y, cast(z as float) z, source_index, q from cloud),
g as (select frame_index, x, y, z, min(q) > 44 as box from f group by all) select f.frame_index, f.source_index, box from f join g using (frame_index, x, y, z)""")
def group_votes(spark, sf_dir):
    """A vote on each exact group, fanned out to its records."""
    f = records(spark, sf_dir).withColumns({c: F.col(c).cast("float") for c in "xyz"})
    g = cloud.group_exact(f).join(f.groupBy("frame_index", "x", "y", "z").agg((F.min("q") > 44).alias("box")), ["frame_index", "x", "y", "z"])
    return cloud.expand_members(g, "box")


@query(f"with {DUCK_CLOUD} select frame_index, source_index, round(range_m, 6) as range_m from cloud where source_index % 7 = 0")
def strided_sample(spark, sf_dir):
    return rounded(angular.stride_sample(records(spark, sf_dir), 7).select("frame_index", "source_index", "range_m"))


_RINGS = DUCK_CLOUD + """,
rg as (select *, least(cast(floor((case when degrees(atan2(y, x)) >= 180 then degrees(atan2(y, x)) - 360 else degrees(atan2(y, x)) end + 180) / 0.2e0) as int), 1799) as col
  from cloud where range_m >= 1e-3 and ring between 0 and 127)
"""


@query(f"with {_RINGS} select frame_index, ring as row, col, round(min(range_m), 6) as value from rg group by frame_index, ring, col")
def ring_raster(spark, sf_dir):
    return rounded(angular.raster(angular.ring_grid(stored(spark, sf_dir)), "min"))


@query(f"with {DUCK_CLOUD} select frame_index, count(*) as records, count(*) as kept, 0::bigint as dropped, 0::bigint as duplicated from cloud group by frame_index")
def grid_audit(spark, sf_dir):
    rows = records(spark, sf_dir)
    return angular.audit(rows, angular.grid(rows))


@query(f"""with {DUCK_CLOUD} select frame_index, least(4, floor(greatest(0, least(1, (range_m - 5) / 25.0e0)) * 4))::int as step, count(*) as points from cloud group by all""")
def colour_steps(spark, sf_dir):
    """On which of the ramp's stops each point's colour starts, by the red of the colour."""
    c = angular.colour(F.col("range_m"), F.lit(5.0), F.lit(30.0))
    at = F.least(F.lit(4), F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("range_m") - 5) / 25.0)) * 4)).cast("int")
    rows = stored(spark, sf_dir).withColumns({"c": c, "step": at})
    low = F.element_at(F.array(*[F.lit(s[0]) for s in angular.RANGE_STOPS]), at + 1)
    high = F.element_at(F.array(*[F.lit(s[0]) for s in angular.RANGE_STOPS]), F.least(at + 2, F.lit(5)))
    return rows.where(F.col("c.red").between(F.least(low, high), F.greatest(low, high))).groupBy("frame_index",
        "step").agg(F.count("*").alias("points"))


@query(f"with {DUCK_CLOUD} select frame_index, round(min(s) - 1, 6) as low, round(case when max(s) <= min(s) then min(s) + 1 else max(s) end + 1, 6) as high from cloud group by frame_index")
def display_limits(spark, sf_dir):
    return rounded(angular.limits(records(spark, sf_dir), "s"))


@query(f"""with {DUCK_CLOUD}, c as (select frame_index, cast(floor(s) as int) as i, min(source_index) as first from cloud group by all)
select *, row_number() over (partition by frame_index order by first)::int as place from c""")
def cells_by_first_point(spark, sf_dir):
    rows = records(spark, sf_dir).select("frame_index", F.floor("s").cast("int").alias("i"), "source_index")
    return angular.first_cells(rows, ["i"], "source_index")


@query(f"with {DUCK_POINTS} select frame_index, point_id, row_number() over (partition by frame_index order by s, l, h) % 2 = 0 as held_out from pts")
def held_out_points(spark, sf_dir):
    return windows.alternate(points(spark, sf_dir), ["frame_index"], ["s", "l", "h"]).select("frame_index", "point_id", "held_out")


# --- lines, pairs, corridors ------------------------------------------------------------


@query(f"""with {_SIDES}, o as (select frame_index, track, list(distinct s_center) as at from sd group by all),
b as (select a.frame_index, a.at as x, b.at as y from o a join o b on a.frame_index = b.frame_index and a.track = 0 and b.track = 1),
c as (select *, list_sort(list_intersect(x, y)) as common, greatest(list_min(x), list_min(y)) as lo, least(list_max(x), list_max(y)) as hi from b)
select frame_index, 0 as a_track, 1 as b_track, common, list_sort(list_filter(list_distinct(list_concat(x, y)), lambda s: not list_contains(common, s) and s between lo and hi)) as missing from c""")
def pair_stations(spark, sf_dir):
    return pairs.stations(_sides(spark, sf_dir))


@query(f"""with {_SIDES}, p as (select a.frame_index, a.s_center as s, a.l_median as al, b.l_median as bl, a.h_median as ah, b.h_median as bh
  from sd a join sd b using (frame_index, s_center) where a.track = 0 and b.track = 1),
e as (select frame_index, s, al as l, ah as h from p union all select frame_index, s, bl, bh from p),
v as (select frame_index, covar_pop(s, s) as ss, covar_pop(l, l) as ll, covar_pop(s, l) as sl, covar_pop(s, h) as sh, covar_pop(l, h) as lh from e group by frame_index),
k as (select *, case when ss * ll - sl * sl > 1e-12 * ss * ll then (sh * ll - lh * sl) / (ss * ll - sl * sl) else 0 end as bs, case when ss * ll - sl * sl > 1e-12 * ss * ll then (lh * ss - sh * sl) / (ss * ll - sl * sl) else 0 end as bl_ from v),
m as (select *, (al + bl) / 2 as ml from p),
d as (select m.*, (coalesce(lead(ml) over w, ml) - coalesce(lag(ml) over w, ml)) / nullif(coalesce(lead(s) over w, s) - coalesce(lag(s) over w, s), 0) as g from m window w as (partition by frame_index order by s)),
x as (select d.frame_index, abs(bl - al) as same, (bl - al) as dl, (bh - ah) as dh, g, bs, bl_, bs + bl_ * g as th from d join k using (frame_index)),
y as (select frame_index, same, abs(dl * (1 + bs * th) + dh * (bl_ - bs * g)) / sqrt((-bl_ * th - g) ** 2 + (1 + bs * th) ** 2 + (bl_ - bs * g) ** 2) as dist from x)
select frame_index, round(median(dist), 6) as distance_m, round(median(same), 6) as same_s_delta_l_m, count(*) as points from y group by frame_index""")
def distance_of_lines(spark, sf_dir):
    """Distance of the two sides as corresponding points, on the plane through both."""
    sides = _sides(spark, sf_dir)
    end = lambda t, p: sides.where(F.col("track") == t).select(
        "frame_index", "s_center", F.col("s_center").alias(f"{p}_s"), F.col("l_median").alias(f"{p}_l"), F.col("h_median").alias(f"{p}_h"))
    return rounded(pairs.distance_of_points(end(0, "a").join(end(1, "b"), ["frame_index", "s_center"]), ["frame_index"]))


@query(f"with {_CORRIDOR} select frame_index, 'H1' as hypothesis, round(s, 6) as s, round(l, 6) as l, role, round(hr, 6) as h_ref, ref as reference from vg")
def corridor_vertices(spark, sf_dir):
    base = surface(spark, sf_dir)
    return rounded(corridor.vertices(_midpoints(spark, sf_dir, base), base[2], cfg=SPARSE).drop("slope"))


@query(f"with {_CORRIDOR} select frame_index, 'H1' as hypothesis, n::int as n, round(s, 6) as s0, round(s1, 6) as s1, srole as role, round(len, 6) as length_m, round(arc, 6) as arc, last from sg")
def corridor_segments(spark, sf_dir):
    base = surface(spark, sf_dir)
    seg = corridor.segments(corridor.vertices(_midpoints(spark, sf_dir, base), base[2], cfg=SPARSE))
    return rounded(seg.select("frame_index", "hypothesis", "n", "s0", "s1", "role", "length_m", "arc", "last"))


@query(f"""with {_CORRIDOR} select frame_index, 'H1' as hypothesis, q.s_query, round(l + (q.s_query - s) / (s1 - s) * (l1 - l), 6) as l_axis, round(hr + (q.s_query - s) / (s1 - s) * (h1 - hr), 6) as h_ref
  from sg join (values (8.0e0), (12.0e0), (22.5e0)) q(s_query) on q.s_query >= s and q.s_query < s1""")
def corridor_at(spark, sf_dir):
    base = surface(spark, sf_dir)
    v = materialise(corridor.vertices(_midpoints(spark, sf_dir, base), base[2], cfg=SPARSE), "vertices")
    at = v.select("frame_index").distinct().withColumn("s_query", F.explode(F.array(*map(F.lit, (8.0, 12.0, 22.5)))))
    return rounded(corridor.section_at(v, at))


@query(f"with {_CORRIDOR} select frame_index, 'H1' as hypothesis, min(s) as s_min_m, max(s) as s_max_m from vg where role = 'observed' and hr is not null group by frame_index")
def observed_spans(spark, sf_dir):
    base = surface(spark, sf_dir)
    return corridor.observed_span(corridor.vertices(_midpoints(spark, sf_dir, base), base[2], cfg=SPARSE))


@query(f"with {_SIDES} select frame_index, 5.0e0 + 2 * min(segment) as support_s_min_m, least(7.0e0 + 2 * max(segment), 30) as support_s_max_m from ln group by frame_index")
def ground_support(spark, sf_dir):
    return corridor.support_range(surface(spark, sf_dir)[2])


@query(f"""with {_SIDES}, sm as (select d.*, coalesce(d.l_median between g.l_min and g.l_max, false) as supported from sd d left join ln g on g.frame_index = d.frame_index and g.segment = cast(floor((d.s_center - 5) / 2) as int)),
hit as (select p.frame_index, p.point_id, bool_or(sm.supported and abs(p.h - sm.h_median) <= 0.05e0) as excluded, bool_or(not sm.supported) as maybe
  from pts p join sm on sm.frame_index = p.frame_index and abs(p.s - sm.s_center) <= 0.5e0 and abs(p.l - sm.l_median) <= sm.width_m / 2 group by all),
vol as materialized (select p.frame_index, p.point_id, coalesce(excluded, false) as excluded, coalesce(maybe, false) and not coalesce(excluded, false) as possible
  from pts p left join hit using (frame_index, point_id))
select * from vol""")
def line_volumes(spark, sf_dir):
    """Points in the volumes around the sections of the two sides."""
    base = pts, _, lines, _ = surface(spark, sf_dir)
    sides = _sides(spark, sf_dir, base)
    two = sides.select("frame_index").distinct().select("frame_index", F.lit("H1").alias("hypothesis"), F.lit(0).alias("a_track"),
        F.lit(1).alias("b_track"))
    return detect.line_masks(pts, pairs.line_samples(two, sides, lines, SPARSE)).select("frame_index", "point_id", "excluded", "possible")


# --- candidates and their evaluation ----------------------------------------------------


@query(f"with recursive {_JUDGED} select 'straight' as hypothesis, 'volume_or_suspended' as branch, kind, count(*) as candidates, sum(unique_xyz)::bigint as points from jd group by kind")
def candidate_totals(spark, sf_dir):
    return evaluate.candidate_totals(decided(spark, sf_dir)[1].withColumn("hypothesis", F.lit("straight")))


@query(f"with recursive {_JUDGED} select reason, count(*) as n from jd where reason is not null group by reason")
def refusal_reasons(spark, sf_dir):
    return evaluate.reason_counts(decided(spark, sf_dir)[1])


@query(f"""with recursive {_POOL}, zc as (select frame_index, label, count(*) as n, count(*) filter (q > 44) as hits from lb join sl using (frame_index, point_id) group by all),
b as (select frame_index, max(hits >= 4 and hits / n >= 0.5) as localising from zc where hits > 0 group by frame_index),
h as (select zc.frame_index, max(hits) as hits from zc join b on b.frame_index = zc.frame_index and (hits >= 4 and hits / n >= 0.5) = localising where hits > 0 group by all)
select b.frame_index, hits, localising from b join h using (frame_index)""")
def region_candidates(spark, sf_dir):
    """The candidate that holds most of the box, which only the evaluation knows of."""
    marks_, judged, _ = decided(spark, sf_dir)
    return evaluate.region_hits(judged, marks_.where("q > 44").select("frame_index", "point_id")).select("frame_index", "hits", "localising")


@query(f"with {DUCK_POINTS} select frame_index, round(min(range_m), 6) as min_m, round(max(range_m), 6) as max_m, count(*) as points, round(max(range_m) - min(range_m), 6) as uncertainty_m from pts where q > 44 group by frame_index")
def box_ranges(spark, sf_dir):
    return rounded(evaluate.reference_range(points(spark, sf_dir).where("q > 44")))


@query(f"with recursive {_POOL} select frame_index, point_id, label from lb")
def split_components(spark, sf_dir):
    """Near and far halves apart; all of this cloud is near."""
    return spatial.split_components(_pool(spark, sf_dir).drop("radius")).select("frame_index", "point_id", "label")


@query(f"with {_MASKS} select frame_index, min(point_id) as first, count(*) as n from mk where inside and not explained and not ambiguous group by frame_index")
def pool_sizes(spark, sf_dir):
    return detect.object_pool(marked(spark, sf_dir)[1]).groupBy("frame_index").agg(F.min("point_id").alias("first"), F.count("*").alias("n"))


@query(f"""with recursive {_JUDGED}, c as (select frame_index, row_number() over (partition by frame_index order by candidate_id)::int as place, candidate_id, unique_xyz, range_from_sensor_m as r from jd),
o as (select * from c where not (frame_index % 7 = 0 and place = 3)),
x as (select coalesce(c.frame_index, o.frame_index) as frame_index, coalesce(c.place, o.place) as place, case when o.place is null then 'number'
  when c.frame_index % 5 = 0 and c.place = 2 then 'members' when c.frame_index % 3 = 0 and c.place = 1 then 'range' end as difference from c left join o using (frame_index, place)),
y as (select *, row_number() over (partition by frame_index order by difference <> 'number', place) as k from x where difference is not null)
select frame_index, difference, place from y where k = 1""")
def candidate_differences(spark, sf_dir):
    """A result against itself with a candidate missing, one renamed and a range changed."""
    place = F.row_number().over(windows.Window.partitionBy("frame_index").orderBy("candidate_id"))
    a = decided(spark, sf_dir)[1].withColumns({"hypothesis": F.lit("straight"), "place": place})
    a = materialise(a.select("frame_index", "place", "hypothesis", "candidate_id", "kind", "branch", "members", "range_from_sensor_m"), "result")
    f, p = F.col("frame_index"), F.col("place")
    b = a.where(~((f % 7 == 0) & (p == 3))).withColumns({
        "candidate_id": F.when((f % 5 == 0) & (p == 2), "other").otherwise(F.col("candidate_id")),
        "range_from_sensor_m": F.col("range_from_sensor_m") + F.when((f % 3 == 0) & (p == 1), 0.01).otherwise(0.0),
    })
    return evaluate.compare_candidates(a, b)


# --- journals, runs, pictures -----------------------------------------------------------


@query("""with e as (select event_id % 3000 as frame_index, event_id from events) select frame_index, count(*) as n, min(event_id) as first, max(event_id) as last from e group by frame_index having count(*) > 1""")
def repeated_frames(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 3000).alias("frame_index"), "event_id")
    return evaluate.duplicates(e, "event_id").select("frame_index", "n", "first", "last")


@query("with e as (select event_id % 3000 as frame_index, event_id, count(*) over (partition by event_id % 3000) as times, row_number() over (partition by event_id % 3000 order by event_id) as r from events) select frame_index, event_id, times from e where r = 1")
def first_records(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 3000).alias("frame_index"), "event_id")
    return journal.first_and_duplicates(e, "event_id")


@query("select event_id as frame_index from events where event_type not in (select min(event_type) from events)")
def remaining_frames(spark, sf_dir):
    """What a resumed run has to do."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_index"), "event_type")
    least = e.agg(F.min("event_type").alias("event_type"))
    return journal.remaining(e.select("frame_index"), e.join(F.broadcast(least), "event_type"))


@query("with a as (select event_id from events where event_id % 5 <> 0), b as (select event_id from events where event_id % 7 <> 0) select event_id as frame_index, 'expected' as side from a where event_id not in (select event_id from b) union all select event_id, 'actual' from b where event_id not in (select event_id from a)")
def frames_of_one_result(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_index"))
    return evaluate.frame_difference(e.where("frame_index % 5 <> 0"), e.where("frame_index % 7 <> 0"))


@query("with r as (select distinct event_type as run from events), k as (select run, case when row_number() over (order by run) = 1 then 'development' when row_number() over (order by run) = 2 then 'locked_test' end as role from r) select run, coalesce(role, 'unassigned') as role from k")
def run_roles(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("run")).distinct()
    named = runs.withColumn("k", F.row_number().over(windows.Window.orderBy("run")))  # a handful of runs
    roles = named.where("k <= 2").select("run", F.when(F.col("k") == 1, "development").otherwise("locked_test").alias("role"))
    return journal.with_roles(runs, roles)


@query(f"""with a as (select event_type as run, event_id as sequence, event_id // 2 as stamp_ns, case when value < 3 then 'player_wait_expired' else {_STATUS} end as status from events),
s as (select *, coalesce(stamp_ns = lag(stamp_ns) over (partition by run order by sequence), false) as again from a)
select run, count(*) as played, count(*) filter (status = 'ok') as ok, count(*) filter (status = 'processing_timeout') as timeout, count(*) filter (status = 'player_wait_expired') as expired,
  count(*) filter (status not in ('ok', 'processing_timeout', 'player_wait_expired')) as error, count(*) filter (again) as repeated_stamps from s group by run""")
def playback(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("value") < 3, "player_wait_expired").otherwise(F.expr(_STATUS)))
    return evaluate.playback_counters(e.select(F.col("event_type").alias("run"), F.col("event_id").alias("sequence"),
        F.expr("event_id div 2").alias("stamp_ns"), "status"))


@query(f"""with f as (select {_STATUS} as status from events) select count(*) as received, count(*) filter (status = 'ok') as written, count(*) filter (status = 'processing_timeout') as timeout,
  count(*) filter (status = 'processing_error') as failed, 0::int as dropped, count(*) filter (status in ('ok', 'processing_timeout', 'processing_error')) as accounted,
  count(*) = count(*) filter (status in ('ok', 'processing_timeout', 'processing_error')) as balanced from f""")
def frame_balance(spark, sf_dir):
    return evaluate.balance(live.counters(_frames(spark, sf_dir)))


@query("""with m as (select event_id % 100 as frame_index, case event_id % 5 when 0 then 'rail' when 1 then 'floor' when 2 then 'wall' when 3 then 'tree' end as kind, case event_id % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'sure' end as confidence,
  (event_id % 7)::int as row_lo, (event_id % 9)::int as row_hi, (event_id % 11)::int as col_lo, (event_id % 13)::int as col_hi, event_id from events)
select event_id, case when kind is null or kind not in ('rail', 'floor', 'wall') then 'unknown_kind' when confidence not in ('high', 'medium', 'low') then 'unknown_confidence'
  when row_lo > row_hi or col_lo > col_hi then 'empty_area' when row_hi >= 8 or col_hi >= 12 then 'outside_of_grid' end as problem from m
  where kind is null or kind not in ('rail', 'floor', 'wall') or confidence not in ('high', 'medium', 'low') or row_lo > row_hi or col_lo > col_hi or row_hi >= 8 or col_hi >= 12""")
def mark_problems(spark, sf_dir):
    n = F.col("event_id")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (n % k + 1).cast("int"))
    m = table(spark, sf_dir, "events").select((n % 100).alias("frame_index"),
        pick(("rail", "floor", "wall", "tree", None), 5).alias("kind"), pick(("high", "medium", "low", "sure"), 4).alias("confidence"),
        *[(n % k).cast("int").alias(c) for c, k in (("row_lo", 7), ("row_hi", 9), ("col_lo", 11), ("col_hi", 13))], "event_id")
    return marks.mark_problems(m, 8, 12).select("event_id", "problem")


@query("with p as (select user_id as slot, (event_id // 3000)::int as session_id, event_id as reception, event_id as frame_index, row_number() over (partition by user_id order by event_id // 3000 desc, event_id desc) as r from events) select slot, session_id, reception, frame_index from p where r = 1")
def newest_pictures(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return marks.newest_picture(e.select(F.col("user_id").alias("slot"), F.expr("cast(event_id div 3000 as int)").alias("session_id"),
        F.col("event_id").alias("reception"), F.col("event_id").alias("frame_index")))


@query(f"with f as (select event_id, case when value > 90 then 'processing_timeout' when value < 1 then 'processing_error' else 'ok' end as status from events) select status, count(*) as n from f group by status")
def budget_statuses(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = marks.status_of(F.col("value"), 90.0, F.when(F.col("value") < 1, "late")).alias("status")
    return e.select(s).groupBy("status").agg(F.count("*").alias("n"))


@query("select event_id, round(greatest(0, least(value / 100, 0.8e0) - greatest(value / 200, 0.3e0)), 6) as overlap from events")
def object_overlaps(spark, sf_dir):
    v = F.col("value")
    return rounded(table(spark, sf_dir, "events").select("event_id",
        corridor.object_overlap(v / 200, v / 100, F.lit(0.3), F.lit(0.8)).alias("overlap")))


# --- from messages to a journal --------------------------------------------------------------


@query(f"with recursive {DECIDED}")
def journalled_decisions(spark, sf_dir):
    """Messages of the cloud decided into a journal, the first half in a run of its own and the rest in a resumed one, read back."""
    from . import offline

    messages = materialise(pointcloud.packed(records(spark, sf_dir).select("frame_index", "source_index", "x", "y", "z", "intensity", "ring")), "messages")
    folder, half = scratch_path(spark, "offline"), messages.agg(F.floor(F.median("frame_index")).cast("long")).first()[0]
    if half is not None:
        offline.run(spark, messages, folder, last=half)
        offline.run(spark, messages, folder)
    return rounded(offline.completed(spark, folder)).select("frame_index", "status", "candidates", "intrusions", "nearest_intrusion_m", "decision", "reason")
