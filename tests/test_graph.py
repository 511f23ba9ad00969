import math
import random

from pyspark.sql import functions as F

from pointloom.functions import scalars
from pointloom.operators.graph import connected_components, star_edges


def labels(pairs, nodes):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_of_random_and_long_graphs(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 50)] + [(5, 5)]
    nodes = sorted({x for p in pairs for x in p} | {9999})
    df = spark.createDataFrame([(n,) for n in nodes], "id long")
    got = {x.id: x.component_id for x in connected_components(df, "id", spark.createDataFrame([*pairs, *pairs], "a long, b long"), "a", "b").collect()}
    assert got == labels(pairs, nodes)


def test_no_edges_and_null_ends(spark):
    e = spark.createDataFrame([(1, None), (None, 2), (3, 3)], "a long, b long")
    assert star_edges(e, "a", "b").count() == 0
    df = spark.createDataFrame([(1,), (3,)], "id long")
    assert {x.id: x.component_id for x in connected_components(df, "id", e, "a", "b").collect()} == {1: 1, 3: 3}


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.wrap_degrees(F.lit(180.0)).alias("w"), scalars.null_if_not_finite(F.lit(float("inf"))).alias("n"), scalars.hypot(F.lit(3.0), F.lit(4.0)).alias("h"),
        scalars.median_of(F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0), F.lit(9.0))).alias("m"), scalars.lerp(F.lit(1.0), F.lit(3.0), F.lit(0.25)).alias("l"),
    ).first()
    assert (row.w, row.n, row.h, row.m, row.l) == (-180.0, None, 5.0, 2.5, 1.5)
    assert not math.isnan(row.h)
    a, b = (spark.createDataFrame([("x", k)], "r string, v long").select(scalars.identity("r", "v").alias("i")).first().i for k in (1, 2))
    assert len(a) == 16 and a != b


def test_neighbours_of_cells_are_looked_up_without_a_shuffle(spark, monkeypatch):
    """each cell has some sixty places to look at; these rows stay where the frame's cells are."""
    from pointloom.operators import spatial

    plans, kept = {}, spatial.materialise

    def watched(df, name="table"):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(spatial, "materialise", watched)
    rows = [(f, 10 * k + p, 0.1 * k + (0.5 if k > 4 else 0.0), 0.01 * p, 0.0, 0.15) for f in (1, 2) for k in range(9) for p in range(2)]
    df = spark.createDataFrame(rows, "frame_index long, point_id long, s double, l double, h double, radius double")
    got = {(r.frame_index, r.point_id): r.label for r in spatial.components(df, by_frame=False).collect()}
    assert got == {(f, i): 0 if i < 50 else 50 for f, i, *_ in rows}
    assert "Generate explode" in plans["near-cells"] and "Exchange" not in plans["near-cells"]
