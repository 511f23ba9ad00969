"""Cross-sections: which rows they hold, lateral clusters in them, clusters linked along the path."""

from __future__ import annotations

import statistics

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import GROUND, Ground
from .ground import segment_of


def section_rows(df: DataFrame, cfg: Ground = GROUND) -> DataFrame:
    """Rows of each station (a row may lie in several): within the half width, or the wide one where that is too empty."""
    stations = F.array(*[F.lit(float(s)) for s in cfg.section_s_m])
    near = F.filter(stations, lambda c: F.abs(F.col("s") - c) <= cfg.section_half_fallback_m)
    rows = df.withColumn("s_center", F.explode(near)).withColumn("narrow", F.abs(F.col("s") - F.col("s_center")) <= cfg.section_half_m)
    w = Window.partitionBy("frame_index", "s_center")
    rows = rows.withColumns({"n_narrow": F.count_if("narrow").over(w), "n_wide": F.count("*").over(w)})
    rows = rows.withColumn("expanded", F.col("n_narrow") < cfg.section_min_groups)
    n = F.when(F.col("expanded"), F.col("n_wide")).otherwise(F.col("n_narrow"))
    return rows.where("narrow or expanded").withColumns({"section_groups": n,
            "status": F.when(n >= cfg.section_min_groups, "ok").otherwise("insufficient")}).drop("n_narrow", "n_wide", "narrow")


def in_band(cfg: Ground = GROUND) -> Column:
    return F.col("dh").between(cfg.structure_dh_min_m, cfg.structure_dh_max_m)


def islands(rows: DataFrame, cfg: Ground = GROUND) -> DataFrame:
    """Rows of the height band with ``island``, split where neighbours in l are over the gap apart."""
    w = Window.partitionBy("frame_index", "s_center").orderBy("l", "h", "s")
    band = rows.where((F.col("status") == "ok") & in_band(cfg))
    band = band.withColumn("new", F.coalesce((F.col("l") - F.lag("l").over(w) > cfg.structure_l_gap_m).cast("int"), F.lit(0)))
    return band.withColumns({"island": F.sum("new").over(w), "band_groups": F.count("*").over(Window.partitionBy("frame_index",
                "s_center"))}).drop("new")


def clusters(rows: DataFrame, cfg: Ground = GROUND) -> DataFrame:
    """One row for each island of a section with what became of it: kept, few or wide."""
    out = islands(rows, cfg).where(F.col("band_groups") >= cfg.structure_min_groups).groupBy("frame_index", "s_center", "island").agg(
        F.median("l").alias("l_median"), F.min("l").alias("l_min"), F.max("l").alias("l_max"), F.median("dh").alias("dh_median"),
            F.median("h").alias("h_median"), F.count("*").alias("groups")
    )
    width = F.col("l_max") - F.col("l_min")
    fate = F.when(F.col("groups") < cfg.structure_min_groups, "few").when(width > cfg.structure_max_width_m, "wide").otherwise("kept")
    return out.withColumns({"width_m": width, "fate": fate})


def rejections(rows: DataFrame, cfg: Ground = GROUND) -> DataFrame:
    """What each section's rows were lost to."""
    base = rows.groupBy("frame_index", "s_center").agg(
        F.first("status").alias("status"), F.count("*").alias("section_groups"), F.count("dh").alias("finite_dh"),
        F.count_if(F.col("dh") < cfg.structure_dh_min_m).alias("below_band"),
            F.count_if(F.col("dh") > cfg.structure_dh_max_m).alias("above_band"), F.count_if(in_band(cfg)).alias("in_band"),
    )
    fates = clusters(rows, cfg).groupBy("frame_index", "s_center").agg(*[F.count_if(F.col("fate") == f).alias(f) for f in ("kept", "few", "wide")])
    return base.join(fates, ["frame_index", "s_center"], "left").fillna(0, ["kept", "few", "wide"])


def roles(rows: DataFrame, cfg: Ground = GROUND) -> DataFrame:
    """A label for every row of every section."""
    key = ["frame_index", "s_center"]
    marked = islands(rows, cfg)
    of = clusters(rows, cfg).select(*key, "island", "fate")
    marked = marked.join(of, [*key, "island"], "left").withColumn("role",
        F.when(F.col("band_groups") < cfg.structure_min_groups, "band_below_min_groups").when(F.col("fate") == "kept",
            "kept").otherwise(F.concat(F.lit("rejected_"), "fate")))
    other = rows.where((F.col("status") != "ok") | ~in_band(cfg) | F.col("dh").isNull())
    role = F.when((F.col("status") != "ok") | F.col("dh").isNull(), "no_dh").when(F.col("dh") < cfg.structure_dh_min_m,
        "below_height_band").otherwise("above_height_band")
    cols = [*key, "s", "l", "h", "role"]
    return marked.select(*cols).unionByName(other.withColumn("role", role).select(*cols))


WIDE = "frame_index long, s_center double, island long, l_median double, width_m double, groups long, dh_median double, internal_gap_m double, valley long, dh_step_m double, splits boolean, reason string, part_l array<double>, part_h array<double>, part_groups array<long>"
_WIDE_TYPES = (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(),
    pa.float64(), pa.bool_(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()))


def _profile(l: np.ndarray, dh: np.ndarray, h: np.ndarray, cfg: Ground) -> dict:  # noqa: E741
    """Two parts of an island sorted by l, if the counts over l have two inner peaks with a deep valley between them."""
    out = {"splits": False, "reason": "few_rows_for_two_parts", "parts": []}
    if len(l) < 2 * cfg.structure_min_groups:
        return out
    out["internal_gap_m"] = float(np.diff(l).max())
    n = int(np.ceil((l[-1] + cfg.wide_bin_m + 1e-9 - l[0]) / cfg.wide_bin_m)) - 1
    if n < 3:
        return out | {"reason": "profile_too_narrow"}
    edges = l[0] + cfg.wide_bin_m * np.arange(n + 1)
    counts = np.histogram(l, edges)[0]
    inner = np.arange(1, n - 1)
    top = inner[(counts[inner] > 0) & (counts[inner] >= counts[inner - 1]) & (counts[inner] >= counts[inner + 1])]
    if len(top) < 2:
        return out | {"reason": "no_two_peaks"}
    a, b = sorted(top[np.argsort(-counts[top], kind="stable")][:2].tolist())
    smaller = int(min(counts[a], counts[b]))
    valley = int(counts[a + 1 : b].min()) if b > a + 1 else int(counts[a])
    sides = [l <= (edges[a + 1] + edges[b]) / 2]
    sides.append(~sides[0])
    step = abs(float(np.median(dh[sides[0]]) - np.median(dh[sides[1]])))
    full = min(int(m.sum()) for m in sides) >= cfg.structure_min_groups
    apart = step >= cfg.wide_peak_dh_m or out["internal_gap_m"] >= 0.8 * cfg.structure_l_gap_m
    splits = valley <= cfg.wide_valley_ratio * smaller and full and apart
    parts = [(float(np.median(l[m])), float(np.median(h[m])), int(m.sum())) for m in sides] if splits else []
    return out | {"valley": valley, "dh_step_m": step, "splits": splits,
        "reason": "two_peaks" if splits else "valley_or_height_step_too_small", "parts": parts}


def wide_profile(rows: DataFrame, cfg: Ground = GROUND) -> DataFrame:
    """Wide islands, and whether a valley across them splits each into two lines that go on at the next station.

    A part goes on where the next station that has a wide island has a kept cluster, a wide island's median or a
    part of one within reach. The kernel gets a frame's wide islands and the places of its kept clusters.
    """
    key = ["frame_index", "s_center", "island"]
    found = clusters(rows, cfg)
    members = islands(rows, cfg).join(found.where("fate = 'wide'").select(*key), key).select(*key, "l", "dh", "h")
    every = members.unionByName(found.where("fate = 'kept'").select(*key, F.col("l_median").alias("l"),
        F.lit(None).cast("double").alias("dh"), F.lit(None).cast("double").alias("h")))
    names = [c.split()[0] for c in WIDE.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        frame, station, island, l, dh, h = (table.column(c).to_numpy() for c in (*key, "l", "dh", "h"))  # noqa: E741
        kept = np.isnan(dh)
        found: dict[float, list[dict]] = {}
        for s, i in sorted(set(zip(station[~kept].tolist(), island[~kept].tolist(), strict=True))):
            at = np.flatnonzero(~kept & (station == s) & (island == i))
            at = at[np.lexsort((h[at], l[at]))]
            own = _profile(l[at], dh[at], h[at], cfg)
            found.setdefault(s, []).append(own | {"frame_index": frame[0], "s_center": s, "island": i, "l_median": float(np.median(l[at])),
                    "width_m": float(l[at[-1]] - l[at[0]]), "groups": len(at), "dh_median": float(np.median(dh[at]))})
        stations = sorted(found)
        for s, beyond in zip(stations, [*stations, None][1:], strict=True):
            for x in (x for x in found[s] if x["splits"]):
                if beyond is None:
                    x |= {"splits": False, "reason": "seen_at_one_station_only", "parts": []}
                    continue
                places = [*l[kept & (station == beyond)].tolist(), *(y["l_median"] for y in found[beyond]),
                    *(p[0] for y in found[beyond] for p in y["parts"])]
                reach = max(cfg.structure_match_m, (beyond - s) * cfg.init_max_abs_dl_ds)
                if not all(any(abs(p[0] - place) <= reach for place in places) for p in x["parts"]):
                    x |= {"splits": False, "reason": "does_not_go_on", "parts": []}
        out = [x | {"part_l": [p[0] for p in x["parts"]], "part_h": [p[1] for p in x["parts"]],
            "part_groups": [p[2] for p in x["parts"]]} for s in stations for x in found[s]]
        return pa.table({n: pa.array([x.get(n) for x in out], t) for n, t in zip(names, _WIDE_TYPES, strict=True)})

    return every.groupBy("frame_index").applyInArrow(run, WIDE)


FRAGMENTS = "frame_index long, track int, s_center double, l_median double, h_median double, dh_median double, width_m double, groups long, sections int, missed int, alternatives array<double>"
_FRAGMENT_TYPES = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int32(),
    pa.int32(), pa.list_(pa.float64()))


class _Line:
    """Clusters of one line in the order of the stations, and where else it could have gone."""

    def __init__(self, at: list[dict], others: list[float] = ()):
        self.at, self.others = list(at), list(others)

    def step(self, cluster: dict, others: list[float] = ()) -> _Line:
        return _Line([*self.at, cluster], [*self.others, *others])

    def key(self) -> tuple:
        return tuple(sorted((round(p["s_center"], 3), round(p["l_median"], 3)) for p in self.at))

    def ahead(self, s: float, samples: int) -> float:
        """The place at s from the last one by the median slope of the last samples."""
        tail = self.at[-samples:]
        slopes = [(b["l_median"] - a["l_median"]) / (b["s_center"] - a["s_center"]) for i, a in enumerate(tail) for b in tail[i + 1 :]]
        return tail[-1]["l_median"] + (statistics.median(slopes) if slopes else 0.0) * (s - tail[-1]["s_center"])


def _by_line(lines: list[_Line], live: list[bool], here: list[dict], s: float, spatial: bool, cfg: Ground) -> list[_Line]:
    """Each line in turn takes the nearest free cluster; a forecasting one also opens a branch to a nearly as near second."""
    free, out = set(range(len(here))), []
    for line, on in zip(lines, live, strict=True):
        expect = line.ahead(s, 2 if spatial else 1)
        near = sorted((abs(here[c]["l_median"] - expect), c) for c in free) if on else []
        near = [x for x in near if x[0] <= cfg.structure_match_m]
        if spatial and len(near) > 1 and near[1][0] - near[0][0] < cfg.structure_link_ambiguity_m:
            (_, a), (_, b) = near[:2]
            out += [line.step(here[a], [here[b]["l_median"]]), line.step(here[b], [here[a]["l_median"]])]
            free -= {a, b}
        elif near:
            out.append(line.step(here[near[0][1]]))
            free.discard(near[0][1])
        else:
            out.append(line)
    return out + [_Line([here[c]]) for c in sorted(free)]


def _by_cost(lines: list[_Line], live: list[bool], here: list[dict], s: float, cfg: Ground) -> list[_Line]:
    """All proposals of a station by cost: each line and each cluster once, and then branches to what is left.

    A line of enough samples costs the distance from its forecast; a younger one takes any slope in the cone, at no cost.
    """
    offers = []
    for n, line in enumerate(lines):
        young = len(line.at[-cfg.forecast_window :]) < cfg.forecast_min_sections
        for c, cluster in enumerate(here if live[n] else []):
            last = line.at[-1]
            off = abs((cluster["l_median"] - last["l_median"]) / (s - last["s_center"])) if young else abs(cluster["l_median"] - line.ahead(s,
                cfg.forecast_window))
            if off <= (cfg.init_max_abs_dl_ds if young else cfg.structure_match_m):
                offers.append((0.0 if young else off, line.key(), cluster["l_median"], c, n, young))
    offers.sort()
    first: dict[int, tuple] = {}
    taken: set[int] = set()
    for offer in offers:
        if offer[4] not in first and offer[3] not in taken:
            first[offer[4]] = offer
            taken.add(offer[3])
    more: dict[int, list[tuple]] = {n: [] for n in first}
    for offer in offers:
        cost, _, _, c, n, young = offer
        if n in first and c not in taken and (young or abs(cost - first[n][0]) < cfg.structure_link_ambiguity_m) and len(more[n]) < cfg.max_alternatives - 1 and len(lines) + len(more[n]) < cfg.max_live_tracks:
            more[n].append(offer)
            taken.add(c)
    out = []
    for n, line in enumerate(lines):
        chosen = [x[3] for x in (first[n], *more[n])] if n in first else []
        out += [line.step(here[c], [here[o]["l_median"] for o in chosen if o != c]) for c in chosen] or [line]
    return out + [_Line([here[c]]) for c in range(len(here)) if c not in taken]


def link_clusters(found: DataFrame, mode: str = "robust", cfg: Ground = GROUND, min_sections: int | None = None) -> DataFrame:
    """Clusters of successive stations joined into lines along the path.

    ``fixed_dl`` continues where the lateral step is within the match distance; ``spatial`` forecasts
    from the last two samples; ``robust`` from the median slope of the last samples once there are
    three, and before that allows any slope in a cone. A continuation with a rival nearly as good
    goes on as two lines, which name each other's places as alternatives. A kernel for each frame.
    """
    need = cfg.structure_min_sections if min_sections is None else min_sections
    names = [c.split()[0] for c in FRAGMENTS.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        lines: list[_Line] = []
        every = table.to_pylist()
        stations = sorted(cfg.section_s_m)
        place = {s: k for k, s in enumerate(stations)}
        for k, s in enumerate(stations):
            here = sorted((c for c in every if c["s_center"] == s), key=lambda c: (c["l_median"], c["h_median"], c["groups"]))
            live = [k - place[x.at[-1]["s_center"]] - 1 <= cfg.structure_max_missed_sections for x in lines]
            lines = _by_cost(lines, live, here, s, cfg) if mode == "robust" else _by_line(lines, live, here, s, mode == "spatial", cfg)
        done = sorted((x for x in lines if len(x.at) >= need), key=lambda x: statistics.median(p["l_median"] for p in x.at))
        rows = []
        for t, line in enumerate(done):
            span = place[line.at[-1]["s_center"]] - place[line.at[0]["s_center"]] + 1
            rows += [p | {"track": t, "sections": len(line.at), "missed": span - len(line.at), "alternatives": line.others} for p in line.at]
        return pa.table({n: pa.array([r[n] for r in rows], t) for n, t in zip(names, _FRAGMENT_TYPES, strict=True)})

    cols = ["frame_index", "s_center", "l_median", "h_median", "dh_median", "width_m", "groups"]
    return found.where("fate = 'kept'").select(*cols).groupBy("frame_index").applyInArrow(run, FRAGMENTS)


def line_candidates(fragments: DataFrame, lines: DataFrame, cfg: Ground = GROUND) -> DataFrame:
    """One row for each line: a key of its geometry, gaps, widths, alternatives and how its heights are supported.

    ``lines``: the local ground lines with the lateral extent of their rows.
    """
    key = ["frame_index", "track"]
    ground = lines.select("frame_index", "segment", F.col("l_min").alias("g_min"), F.col("l_max").alias("g_max"))
    rows = fragments.withColumn("segment", segment_of("s_center", cfg)).join(ground, ["frame_index", "segment"], "left")
    support = F.when(F.col("g_min").isNull(), "unknown").when(F.col("l_median").between(F.col("g_min"), F.col("g_max")),
        "supported").otherwise("extrapolated")
    sample = F.struct("s_center", "l_median", "h_median", "dh_median", "width_m", "groups", support.alias("height_support"))
    out = rows.groupBy(*key).agg(
        F.sort_array(F.collect_list(sample)).alias("samples"), F.median("l_median").alias("l_median_m"),
            F.median("dh_median").alias("dh_median_m"), F.min("width_m").alias("width_min_m"), F.median("width_m").alias("width_median_m"),
        F.max("width_m").alias("width_max_m"), F.count("*").cast("int").alias("sections"), F.sum("groups").alias("groups"),
            F.first("alternatives").alias("alternatives"),
    )
    stations = F.array(*[F.lit(float(s)) for s in sorted(cfg.section_s_m)])
    seen = F.transform("samples", lambda x: x.s_center)
    gaps = F.filter(stations, lambda s: s.between(F.array_min(seen), F.array_max(seen)) & ~F.array_contains(seen, s))
    text = F.array_join(F.transform("samples", lambda x: F.format_string("%.1f:%.3f", x.s_center, x.l_median)), "|")
    return out.withColumns({"gaps_s_m": gaps, "geometry_key": text, "below_minimum": F.col("sections") < cfg.structure_min_sections})


def selection_funnel(found: DataFrame, cfg: Ground = GROUND) -> DataFrame:
    """For each frame the kept clusters, and the lines and candidates of the three ways of linking."""
    kept = found.groupBy("frame_index").agg(F.count_if(F.col("fate") == "kept").alias("kept"),
        F.count_if(F.col("fate") == "few").alias("few"), F.count_if(F.col("fate") == "wide").alias("wide"))
    for mode in ("fixed_dl", "spatial", "robust"):
        n = link_clusters(found, mode, cfg, min_sections=1).select("frame_index", "track", "sections").distinct()
        n = n.groupBy("frame_index").agg(F.count("*").alias(f"{mode}_lines"),
            F.count_if(F.col("sections") >= cfg.structure_min_sections).alias(f"{mode}_candidates"))
        kept = kept.join(n, "frame_index", "left").fillna(0, [f"{mode}_lines", f"{mode}_candidates"])
    return kept


def broken_hops(fragments: DataFrame, cfg: Ground = GROUND) -> DataFrame:
    """For each line the first step that a forecast from its two samples before doesn't reach, as columns (null: none)."""
    key = ["frame_index", "track"]
    w = Window.partitionBy(*key).orderBy("s_center")
    back = lambda c, k: F.lag(c, k).over(w)
    rows = fragments.select(*key, "s_center", "l_median", *[back(c, k).alias(f"{n}{k}") for c,
            n in (("s_center", "s"), ("l_median", "l")) for k in (1, 2)])
    ds = F.col("s_center") - F.col("s1")
    slope = (F.col("l1") - F.col("l2")) / (F.col("s1") - F.col("s2"))
    rows = rows.withColumns({"slope": slope, "expected_l_m": F.col("l1") + F.coalesce(slope, F.lit(0.0)) * ds,
        "implied": (F.col("l_median") - F.col("l1")) / ds})
    rows = rows.withColumn("off_m", F.abs(F.col("l_median") - F.col("expected_l_m")))
    hop = F.struct(F.col("s_center").alias("at_s_m"), F.col("s1").alias("from_s_m"),
        F.when(F.col("slope").isNull(), "no_slope_yet").otherwise("last_two_samples").alias("mode"), F.col("slope").alias("slope_dl_ds"),
        "expected_l_m", F.col("l_median").alias("observed_l_m"), F.col("off_m").alias("residual_m"),
        F.col("implied").alias("implied_dl_ds"))
    bad = F.col("off_m") > cfg.structure_match_m
    first = rows.groupBy(*key).agg(F.min(F.when(bad, hop)).alias("hop"))
    return first.select(*key, F.col("hop").isNotNull().alias("broke"), "hop.*")
