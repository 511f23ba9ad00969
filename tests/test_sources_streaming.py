import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import evaluate, windows
from pointloom.sources import bag, journal, pointcloud, settings
from pointloom.streaming import live, replay, stateful, tracker
from pointloom.streaming.tracker import PairHistories, Tracker, moved

KINDS = {"x": 7, "y": 7, "z": 7, "intensity": 7, "ring": 4, "timestamp": 8}


def columns(n):
    r = np.random.default_rng(0)
    return {"x": r.normal(size=n).astype("f4").tolist(), "y": r.normal(size=n).astype("f4").tolist(), "z": r.normal(size=n).astype("f4").tolist(), "intensity": [float(k) for k in range(n)], "ring": [k % 7 for k in range(n)], "timestamp": [0.125 * k for k in range(n)]}


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("pad", [0, 2])
def test_decode_padding_alignment_byte_order(spark, big, pad):
    m = pointcloud.pack(columns(6), KINDS, point_step=30, width=3, pad=pad, bigendian=big, offsets={"timestamp": 19})
    got = pointcloud.decode(m)
    for k, name in enumerate(KINDS):
        assert got[name].tolist() == columns(6)[name], name
    assert [r["timestamp"] for r in pointcloud.decode_records(m, [5, 0])] == [0.625, 0.0]
    m |= {"frame_index": 3, "stamp_ns": 17, "frame_id": "sensor", "fields": [tuple(f.values()) for f in m["fields"]]}
    df = spark.createDataFrame([tuple(m[c.split()[0]] for c in pointcloud.MESSAGE.split(", "))], pointcloud.MESSAGE)
    rows = pointcloud.points(df).orderBy("source_index").collect()
    assert [r.ring for r in rows] == columns(6)["ring"] and rows[0].absent_fields == [] and rows[0].frame_index == 3
    assert pointcloud.headers(df).first().has_return_type is False


def test_bad_layouts_are_refused():
    m = pointcloud.pack({c: v for c, v in columns(2).items() if c in "xyz"}, {c: 7 for c in "xyz"})
    for bad in ({"count": 3}, {"datatype": 8}, {"datatype": 99}):
        with pytest.raises(ValueError):
            pointcloud.decode(m | {"fields": [m["fields"][0] | bad, *m["fields"][1:]]})
    with pytest.raises(ValueError):
        pointcloud.decode(m | {"fields": m["fields"][:2]})


def recording(folder, n=5, topics=("/points",)):
    db = sqlite3.connect(folder / "run_0.db3")
    db.execute("CREATE TABLE topics(id INTEGER PRIMARY KEY, name TEXT, type TEXT)")
    db.execute("CREATE TABLE messages(id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
    for k, t in enumerate((*topics, "/imu")):
        db.execute("INSERT INTO topics VALUES (?, ?, ?)", (k, t, bag.CLOUD_TYPE if t != "/imu" else "other"))
    for k in range(n):
        m = pointcloud.pack({c: [float(k), 1.0] for c in "xyz"}, {c: 7 for c in "xyz"}) | {"stamp_ns": 1_500_000_000 + k, "frame_id": "sensor"}
        for t in range(len(topics)):
            db.execute("INSERT INTO messages(topic_id, timestamp, data) VALUES (?, ?, ?)", (t, k, bag.serialise(m)))
        db.execute("INSERT INTO messages(topic_id, timestamp, data) VALUES (?, ?, ?)", (len(topics), k, b"x"))
    db.commit()
    db.close()


def test_recording_source(spark, tmp_path):
    recording(tmp_path)
    spark.dataSource.register(bag.BagSource)
    df = spark.read.format("bag").option("path", str(tmp_path)).option("messagesPerPartition", 2).load()
    assert [(r.frame_index, r.stamp_ns, r.x) for r in pointcloud.points(df).where("source_index = 0").orderBy("frame_index").select("frame_index", "stamp_ns", "x").collect()] == [(k, 1_500_000_000 + k, float(k)) for k in range(5)]
    assert df.where("frame_index >= 3").count() == 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    few = spark.read.format("bag").option("path", str(tmp_path)).option("pushFilters", "true").load().where("frame_index >= 3")
    assert sorted(r.frame_index for r in few.select("frame_index").collect()) == [3, 4]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_topic_rules(tmp_path):
    t = {"/a": bag.CLOUD_TYPE, "/b": bag.CLOUD_TYPE, "/imu": "other"}
    assert bag.choose_topic({"/a": bag.CLOUD_TYPE}) == "/a"
    assert bag.choose_topic(t, ("/b",)) == "/b" and bag.choose_topic(t, (), "/a") == "/a"
    for call in (lambda: bag.choose_topic(t), lambda: bag.choose_topic_strict(t), lambda: bag.choose_topic(t, (), "/imu"), lambda: bag.choose_topic({})):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(ValueError):
        bag.message_file(str(tmp_path))


def test_journal_torn_tail_and_last_wins(spark, tmp_path):
    f = tmp_path / "j.jsonl"
    f.write_text('{"frame_index": 1, "status": "old"}\n{"frame_index": 2, "status": "ok"}\n{"frame_index": 1, "status": "new"}\n{"frame_index": 3, "status": "torn"}')
    schema = "frame_index long, status string"
    assert sorted((r.frame_index, r.status) for r in journal.read_completed(spark, str(f), schema).collect()) == [(1, "new"), (2, "ok")]
    done = journal.read_completed(spark, str(f), schema)
    assert [r.frame_index for r in journal.remaining(spark.createDataFrame([(k,) for k in range(1, 4)], "frame_index long"), done).collect()] == [3]
    raw = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (1, "c", 2)], "frame_index long, status string, n long")
    assert sorted((r.frame_index, r.status, r.times) for r in journal.first_and_duplicates(raw, "n").collect()) == [(1, "a", 2), (2, "b", 1)]


def test_roles_default_and_gate(spark):
    runs = spark.createDataFrame([("r1",), ("r2",)], "run string")
    roles = spark.createDataFrame([("r1", "development")], "run string, role string")
    got = journal.with_roles(runs, roles)
    assert sorted((r.run, r.role) for r in got.collect()) == [("r1", "development"), ("r2", "unassigned")]
    assert journal.development_only(got).count() == 1


def test_windows(spark):
    df = spark.createDataFrame([(0, k, t, v) for k, (t, v) in enumerate([(1.0, True), (2.0, False), (1.5, True), (3.0, True)])], "g int, n int, t double, v boolean")
    assert [r.session_id for r in windows.sessions(df, "t", "n", "g").orderBy("n").collect()] == [0, 0, 1, 1]
    assert [r.confirmed for r in windows.confirmed(df, "v", "n", "g").orderBy("n").collect()] == [False, False, True, True]
    assert [r.tail_median for r in windows.tail_median(df, "t", "n", "g", 3).orderBy("n").collect()] == [1.0, 1.5, 1.5, 2.0]
    assert windows.level_gap(spark.createDataFrame([(0, h) for h in [0.0] * 15 + [0.3] * 15], "g int, h double"), ["g"]).first().several_levels
    assert not windows.level_gap(spark.createDataFrame([(0, h) for h in [0.0] * 15 + [0.3] * 3], "g int, h double"), ["g"]).first().several_levels


def test_compare(spark):
    a = spark.createDataFrame([(1, "ok", 5.0), (2, "ok", 5.0), (3, "ok", None)], "frame_index long, status string, r double")
    b = spark.createDataFrame([(1, "ok", 5.000001), (3, "bad", 1.0), (4, "ok", 5.0)], "frame_index long, status string, r double")
    assert sorted((x.frame_index, x.difference) for x in evaluate.compare(a, b, ["status"], ["r"]).collect()) == [(2, "missing_frame"), (3, "r"), (3, "status"), (4, "unexpected_frame")]
    assert evaluate.frame_difference(a, b).count() == 2


EYE = [[float(i == j) for j in range(4)] for i in range(4)]


def cand(i, s, key="H"):
    return {"candidate_id": i, "corridor_key": key, "position": (s, 0.0, 0.0)}


def step(t, frame, cands, **k):
    return [(r["track_id"], r["candidate_id"], r["association"], r["confirmed"]) for r in t.step(frame, 0.1 * frame, cands, **({"pose": EYE} | k))]


def test_tracker():
    t = Tracker(link_m=0.5)
    assert step(t, 0, [cand("a", 1.0)]) == [(1, "a", "new", False)]
    assert step(t, 1, [cand("b", 1.2)]) == [(1, "b", "linked", True)]
    assert step(t, 0, [cand("z", 1.2)]) == [(None, "z", "repeated_frame", False)]  # any earlier frame, not only the last
    assert step(t, 2, [cand("c", 1.2), cand("d", 1.3)]) == [(None, "c", "ambiguous", False), (None, "d", "ambiguous", False), (1, None, "missed", True)]
    assert step(t, 3, [cand("e", 1.2, "other")]) == [(2, "e", "new", False)]  # missed twice: gone
    assert step(t, 4, [cand("f", 1.2, None)]) == [(None, "f", "no_corridor", False), (2, None, "missed", False)]
    assert step(t, 5, [cand("g", 1.2)], reference="train") == [(None, "g", "other_coordinates", False)]
    assert step(t, 6, [cand("h", 1.2)]) == [(3, "h", "new", False)]
    assert step(t, 7, [cand("i", 1.2)], pose=None) == [(None, "i", "no_pose", False), (3, None, "missed", False)]
    assert step(t, 8, [cand("j", 1.2)], reliable=False) == [(None, "j", "unreliable", False)]


def test_poses_act_on_sensor_axes():
    ahead = [[1.0, 0, 0, 0], [0, 1, 0, -2.0], [0, 0, 1, 0], [0, 0, 0, 1]]  # the sensor moves two metres along s, that is -y
    assert moved([10.0, 0.5, -1.0], EYE, ahead) == pytest.approx([8.0, 0.5, -1.0])
    aside = [[1.0, 0, 0, 1.0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    assert moved([10.0, 0.5, -1.0], EYE, aside) == pytest.approx([10.0, -0.5, -1.0])
    t = Tracker()
    step(t, 0, [{"candidate_id": "a", "corridor_key": "H", "position": (10.0, 0.5, -1.0)}])
    assert step(t, 1, [{"candidate_id": "b", "corridor_key": "H", "position": (10.0, -0.5, -1.0)}], pose=aside)[0][2:] == ("linked", True)


def pair(d, at=0.0, **k):
    return {"left": at - 0.76, "right": at + 0.76, "distance": d, "slope": 0.01, "place": at} | k


def test_pair_histories():
    h = PairHistories()
    rows = [h.step(k, [pair(1.52)])[0] for k in range(6)]
    assert [r["reason"] for r in rows] == ["admitted"] * 6 and rows[-1]["place"] == 0.0 and rows[-1]["slope"] == 0.01
    out = h.step(6, [pair(2.40)])[0]
    assert (out["update"], out["reason"], out["width"], out["width_age"]) == ("paused", "outlier", 1.52, 1)
    g = PairHistories()
    rows = [g.step(k, [pair(d)])[0] for k, d in enumerate([1.52] * 4 + [1.80] * 3)]
    assert (rows[-1]["update"], rows[-1]["conflict"], rows[-1]["width"]) == ("width_conflict", 1.80, 1.52)
    assert g.histories[0]["widths"] == [1.52] * 4  # a conflict is not adopted


def test_pair_histories_pause_and_assume():
    h = PairHistories()
    h.step(0, [pair(1.52)])
    one = h.step(1, [], [-0.80])[0]
    assert (one["reason"], one["assumed_side"], one["assumed_l"]) == ("one_line_seen", "right", pytest.approx(0.72))
    assert h.step(2, [], [])[0]["reason"] == "not_seen" and h.step(3, [], [], ground_found=False)[0]["reason"] == "no_ground"
    both = h.step(4, [pair(1.52, 0.05), pair(1.50, 0.10)])  # two pairs nearly as near: nothing is updated, nothing is opened
    assert [r["reason"] for r in both] == ["ambiguous", "ambiguous_not_opened", "ambiguous_not_opened"] and len(h.histories) == 1
    far = h.step(5, [pair(1.52, 3.0)])
    assert [(r["pair_id"], r["reason"]) for r in far] == [(1, "not_seen"), (2, "admitted")]


def test_pair_history_rows(spark):
    p = "array<struct<left:double,right:double,distance:double,slope:double,place:double>>"
    rows = [(s, f, True, [(-0.76, 0.76, 1.52, 0.0, 0.0)] if f != 2 else None, [0.7] if f == 2 else None) for s in range(2) for f in (2, 0, 1)]
    got = replay.pair_histories(spark.createDataFrame(rows, f"session_key long, frame long, ground_found boolean, pairs {p}, lines array<double>")).where("session_key = 1").orderBy("frame").collect()
    assert [(r.pair_id, r.reason, r.width, r.assumed_side) for r in got] == [(1, "admitted", 1.52, None)] * 2 + [(1, "one_line_seen", 1.52, "left")]


CANDS = "session_key long, frame long, stamp_s double, candidate_id string, corridor_key string, s double, l double, h double"


def test_track_stream_equals_replay(spark, tmp_path):
    r = np.random.default_rng(2)
    rows = [(k, f, 0.1 * f, f"{f}-{n}", "H", float(5 * n + 0.1 * f + r.normal(0, 0.05)), 0.0, 0.0) for k in range(3) for f in range(8) for n in range(2)]
    for f in range(8):
        spark.createDataFrame([x for x in rows if x[1] == f], CANDS).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{f}"))
    stream = spark.readStream.schema(CANDS).option("maxFilesPerTrigger", 3).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    with stateful.rocksdb(spark):
        q = live.track_stream(stream).writeStream.format("memory").queryName("tracks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("tracks")) == key(replay.track_frames(spark.createDataFrame(rows, CANDS)))


def state_rows(spark, checkpoint):
    """Rows and bytes of each state variable after the last batch."""
    n = {}
    for name in ("tracks", "seen", "due"):
        reader = spark.read.format("statestore").option("stateVarName", name)
        n[name] = reader.load(str(checkpoint)).count()
    return n


def test_track_state_stays_flat(spark, tmp_path):
    """Frame keys expire with the watermark: 40 times as many frames leave as much state, and the rows of the replay."""
    left = {}
    for frames in (50, 2000):
        base = tmp_path / str(frames)
        rows = [(1, f, 0.1 * f, f"{f}", "H", 10.0 + 0.01 * (f % 7), 0.0, 0.0) for f in range(frames)]
        for part in range(4):
            at = [rows[k] for k in range(len(rows)) if k * 4 // len(rows) == part]
            spark.createDataFrame(at, CANDS).coalesce(1).write.parquet(str(base / "in" / f"f{part}"))
        stream = spark.readStream.schema(CANDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(base / "in"))
        with stateful.rocksdb(spark):
            out = live.track_stream(stream, late="2 seconds")
            out.writeStream.format("parquet").option("path", str(base / "out")).option("checkpointLocation", str(base / "c")).trigger(availableNow=True).start().awaitTermination()
        left[frames] = state_rows(spark, base / "c")
        key = lambda df: sorted(map(tuple, df.select(*[c.split()[0] for c in replay.TRACK_ROWS.split(", ")]).collect()))
        assert key(spark.read.parquet(str(base / "out"))) == key(replay.track_frames(spark.createDataFrame(rows, CANDS)))
    assert left[2000]["tracks"] <= left[50]["tracks"] and left[2000]["seen"] <= left[50]["seen"] + 1, left


def test_track_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = [(1, f, 0.1 * f, f"{f}", "H", 10.0, 0.0, 0.0) for f in range(6)]

    def run(part):
        spark.createDataFrame(part, CANDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(CANDS).parquet(str(tmp_path / "in"))
        with stateful.rocksdb(spark):
            live.track_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    run(rows[:3])
    run([*rows[3:], rows[2]])  # a frame comes again
    got = sorted((r.frame, r.track_id, r.association) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.association != "repeated_frame")
    assert got == [(0, 1, "new"), *[(f, 1, "linked") for f in range(1, 6)]]
    assert [r.frame for r in spark.read.parquet(str(tmp_path / "out")).where("association = 'repeated_frame'").collect()] == [2]


def test_history_stream_equals_replay(spark, tmp_path):
    r = np.random.default_rng(4)
    p = "array<struct<left:double,right:double,distance:double,slope:double,place:double>>"
    schema = f"session_key long, frame long, ground_found boolean, pairs {p}, lines array<double>"
    rows = []
    for s in range(3):
        for f in range(40):
            d = float(1.52 + r.normal(0, 0.02) + (0.3 if 20 <= f < 26 else 0.0))
            pairs = None if f % 7 == 3 else [(-d / 2, d / 2, d, 0.01, None if f % 5 == 0 else 0.0)] + ([(2.0, 3.5, 1.5, None, None)] if f % 11 == 0 else [])
            rows.append((s, f, f % 13 != 5, pairs, [0.75] if f % 7 == 3 else None))
    for part in range(4):
        spark.createDataFrame([x for x in rows if x[1] // 10 == part], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    with stateful.rocksdb(spark):
        out = live.history_stream(stream)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((tuple(x) for x in df.select(*[c.split()[0] for c in replay.HISTORY_ROWS.split(", ")]).collect()), key=str)
    want = key(replay.pair_histories(spark.createDataFrame(rows, schema)))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == want
    assert {x[3] for x in want} == {"accepted", "paused", "width_conflict"}


def test_balance_of_a_running_query(spark, tmp_path):
    """Received, written and dropped come from the query itself."""
    schema = "session_id long, sequence long"
    spark.createDataFrame([(1, k % 4) for k in range(10)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    balance = live.Balance()
    spark.streams.addListener(balance)
    try:
        once = live.delivered_once(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["session_id", "sequence"])
        q = once.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert balance.of(q) == {"batches": 1, "received": 10, "written": 4, "failed": 0, "dropped": 6}
    finally:
        spark.streams.removeListener(balance)


@pytest.mark.parametrize("rates", [False, True])
def test_live_view_gives_every_card_once(spark, tmp_path, rates):
    """Card 2 never gets its cloud and appears once, when the watermark has passed; clouds may come before or after their cards."""
    cards, clouds = "sequence long, ts timestamp, status string", "sequence long, ts timestamp, points long"
    at = lambda t: __import__("datetime").datetime.fromtimestamp(1000 + t)
    batches = [([(1, 1, "ok"), (2, 2, "processing_timeout")], [(3, 3, 30)]), ([(3, 3, "ok")], [(1, 1, 10)]), ([(4, 100, "ok")], [(4, 100, 40)]), ([(5, 200, "ok")], [(5, 200, 50)])]
    for c, d in batches:
        spark.createDataFrame([(n, at(t), s) for n, t, s in c], cards).coalesce(1).write.mode("append").parquet(str(tmp_path / "cards"))
        spark.createDataFrame([(n, at(t), p) for n, t, p in d], clouds).coalesce(1).write.mode("append").parquet(str(tmp_path / "clouds"))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    view = live.live_view(read("cards", cards), read("clouds", clouds), "5 seconds")
    view = live.view_rates(view) if rates else view
    q = view.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    if rates:
        first = min(got, key=lambda r: r.start)
        assert (first.rate_hz, first.with_cloud, first.statuses) == (3 / 5, 2, ["ok", "processing_timeout"])
    else:
        told = sorted((r.sequence, r.has_cloud, r.cloud_points) for r in got)
        assert told[:4] == [(1, True, 10), (2, False, None), (3, True, 30), (4, True, 40)] and len({r.sequence for r in got}) == len(got)


def test_journal_stream_is_exactly_once(spark, tmp_path):
    schema = "session_id long, sequence long, reception long, status string"
    for k in range(3):
        spark.createDataFrame([(0, s, s, "ok") for s in (2 * k, 2 * k + 1, 0)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    live.write_journal(stream, str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.json(str(tmp_path / "out"))
    assert sorted(r.sequence for r in got.collect()) == [0, 1, 2, 3, 4, 5]
    batch = spark.createDataFrame([(0, 1, 5, "a"), (0, 2, 9, "b"), (0, 3, 7, "c")], schema)
    assert (lambda r: (r.sequence, r.dropped))(live.shed_load(batch).first()) == (2, 2)


def test_balance(spark):
    c = live.counters(spark.createDataFrame([("ok",), ("processing_timeout",)], "status string"))
    assert evaluate.balance(c.withColumn("dropped", F.lit(0))).first().balanced


def test_packed_messages_round_trip(spark):
    r = np.random.default_rng(1)
    rows = [(f, k, *map(float, r.uniform(-50, 50, 3)), float(k), k % 128) for f in range(3) for k in range(40)]
    df = spark.createDataFrame(rows, "frame_index long, source_index long, x double, y double, z double, intensity double, ring int")
    got = pointcloud.points(pointcloud.packed(df), "double").orderBy("frame_index", "source_index").collect()
    assert [(x.frame_index, x.source_index, x.x, x.y, x.z, x.ring) for x in got] == [(f, k, a, b, c, n) for f, k, a, b, c, _, n in rows]  # float64 as it was declared
    assert pointcloud.points(pointcloud.packed(df)).schema["x"].dataType.simpleString() == "float"


def test_settings(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("""
prior: {rail_head_h_if_z_up_and_angles_zero_m: -1.075}
profile: {width_m: 2.4, height_m: 3.1, center_l_m: 0.1, lower_boundary_above_rail_head_m: 0.05}
longitudinal: {s_min_m: 1.0, s_max_m: 90, far_assumption_from_s_m: 20}
axis_check: {heading_tolerance_dl_ds: 0.2, min_support_span_m: 5}
own_path_assigned: false
match: {support_s_min_m: 6, support_s_max_m: 10, lateral_tolerance_m: 0.3, heading_dl_ds: 0.0, heading_tolerance: 0.1}
default_variant: C
variants: {B: {connectivity: cells}, C: {connectivity: distance, local_protrusions: true}, D: {connectivity: guess}}
mount: {confirmed: true, source: organizer, basis: measured, translation_m: {x: 1, y: 0, z: 2}, rpy_rad: {roll: 0, pitch: 0, yaw: 0.1}}
large_min_unique_xyz: {value: 9}
local_radius_m: [0.5, 1.5]
split: {development: [a, b], locked_test: [c]}
view_frames: [{run: a, message_index: 3}]
""")
    got = settings.load(spark, f"file://{tmp_path}/p.yaml")
    p, axis = settings.profile(got)
    assert (p.width_m, p.s_max_m, p.floor_h_m, axis.heading, axis.min_span_m) == (2.4, 90.0, pytest.approx(-1.025), 0.2, 5.0)
    assert settings.variant(got) == settings.Variant("C", True, True) and not settings.variant(got, "B").by_distance
    for bad in ("D", "E"):
        with pytest.raises(ValueError):
            settings.variant(got, bad)
    d = settings.detector(got)
    assert (d.large_min, d.radii_m, d.link_m) == (9, (0.5, 1.5), 0.15) and settings.mount(got).applied
    session = {**got, "variants": [{"name": "left", "enabled": True, "s_m": 6.0, "l_m": -1.4}, {"name": "off", "enabled": False}]}
    assert settings.attachments(session)["left"].heading_tolerance == 0.1 and len(settings.attachments(session)) == 1
    with pytest.raises(ValueError):
        settings.attachments({**session, "own_path_assigned": True})
    roles = settings.roles(spark, got)
    runs = journal.with_roles(spark.createDataFrame([("a",), ("c",), ("x",)], "run string"), roles)
    assert sorted((r.run, r.role) for r in runs.collect()) == [("a", "development"), ("c", "locked_test"), ("x", "unassigned")]
    with pytest.raises(ValueError):
        journal.require_development(runs)
    frames = spark.createDataFrame([("a", 3), ("a", 4), ("b", 3)], "run string, message_index long")
    assert [tuple(r) for r in journal.view(frames, settings.view_frames(spark, got)).collect()] == [("a", 3)]
    with pytest.raises(ValueError):
        settings.view_frames(spark, {"view_frames": [{"message_index": 3}]})
    assert settings.parameters(spark, p).where("name = 'width_m'").first().value == "2.4"


def test_run_files_are_written_once(spark, tmp_path):
    at = f"file://{tmp_path}"
    journal.own(spark, at, journal.run_id("bag", 17))
    assert (tmp_path / "run.lock").read_text() == "bag-17"
    journal.manifest(spark, at, variant="C")
    journal.machine(spark, at)
    journal.summary(spark.createDataFrame([("r", 0, "ok", 5, 0.1)], "run string, frame_index long, status string, support int, seconds double"), at)
    assert json.loads((tmp_path / "summary.json").read_text())[0]["ok"] == 1
    for again in (lambda: journal.own(spark, at, "other"), lambda: journal.manifest(spark, at)):
        with pytest.raises(Exception, match="exist"):
            again()


def test_recordings_without_topic_and_by_place(spark, tmp_path):
    recording(tmp_path, 4, ("/a", "/b"))
    spark.dataSource.register(bag.BagSource)
    load = lambda **o: spark.read.format("bag").options(path=str(tmp_path), **o).load()
    one = load(topic="/a").count()
    assert load(topic="*").count() == 2 * one and load(topic="*", messagesPerPartition=3, every=2).count() == one
    assert load(topic="/a", atMost=2).count() == 2
    assert bag.message_at(str(tmp_path), 1, "/a")["stamp_ns"] == bag.message_at(str(tmp_path), 1, "/a", bag.message_at(str(tmp_path), 1, "/a")["stamp_ns"])["stamp_ns"]
    for call in (lambda: bag.message_at(str(tmp_path), 99, "/a"), lambda: bag.message_at(str(tmp_path), 0, "/a", 1)):
        with pytest.raises(ValueError):
            call()


def test_budget_cancels_jobs(spark):
    import time

    assert live.within_budget(spark, lambda: spark.range(5).count(), 60) == {"status": "ok", "result": 5, "error": None}
    slow = spark.range(1).select(F.expr("java_method('java.lang.Thread', 'sleep', 20000L)"))
    began = time.time()
    assert live.within_budget(spark, slow.collect, 1.0)["status"] == "processing_timeout" and time.time() - began < 10
    assert live.within_budget(spark, lambda: spark.table("no_such_table").count(), 60)["status"] == "processing_error"


def test_playback_counters_and_ranges(spark):
    rows = [("r", 0, 5, "ok"), ("r", 1, 5, "processing_timeout"), ("r", 2, 6, "player_wait_expired"), ("r", 3, 6, "strange"), ("r", 4, 7, None)]
    c = evaluate.playback_counters(spark.createDataFrame(rows, "run string, sequence long, stamp_ns long, status string")).first()
    assert (c.played, c.ok, c.timeout, c.expired, c.error, c.repeated_stamps) == (5, 1, 1, 1, 2, 2)
    g = evaluate.reference_range(spark.createDataFrame([(0, 5.0), (0, 5.5)], "frame_index long, range_m double")).first()
    assert (g.min_m, g.max_m, g.uncertainty_m) == (5.0, 5.5, 0.5)


def test_a_sensor_that_stands_still_needs_no_inverse(monkeypatch):
    """frames at one place are compared as they are, with the same links as by their poses."""
    def links():
        t, r = tracker.Tracker(), np.random.default_rng(1)
        out = []
        for k in range(60):
            cands = [{"candidate_id": f"L{n}", "corridor_key": "H1", "position": (n + 0.15 * r.integers(0, 3), 0.0, float(r.choice([0.0, 0.1])))} for n in range(4)]
            out += t.step(k, k * 0.1, cands, pose=pose)
        return out

    pose = [[float(i == j) for j in range(4)] for i in range(4)]
    with monkeypatch.context() as m:
        m.setattr(np.linalg, "inv", None)
        got = links()
    with monkeypatch.context() as m:
        m.setattr(tracker, "STILL", None)
        assert got == links() and {r["association"] for r in got} >= {"linked", "new", "missed"}


def test_messages_without_points_among_others(spark):
    """Records of several messages are passed on together; a message without any, or without a stamp, disturbs none of them."""
    kinds = {"x": 8, "y": 8, "z": 8, "ring": 4}
    rows = [(k, None if k == 2 else 10 * k, "sensor", pointcloud.pack({c: [float(k)] * n if c != "ring" else [k] * n for c in kinds}, kinds)) for k, n in enumerate((2, 0, 3, 0, 1))]
    messages = spark.createDataFrame([(k, stamp, name, *[m[c.split()[0]] for c in pointcloud.MESSAGE.split(", ")[3:]]) for k, stamp, name, m in rows], pointcloud.MESSAGE).coalesce(1)
    got = [(r.frame_index, r.stamp_ns, r.source_index, r.x, r.ring, r.absent_fields) for r in pointcloud.points(messages, "double").collect()]
    assert sorted(got, key=lambda r: r[:1] + r[2:3]) == [(k, None if k == 2 else 10 * k, i, float(k), k, ["intensity", "timestamp"]) for k, n in enumerate((2, 0, 3, 0, 1)) for i in range(n)]
