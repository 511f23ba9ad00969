"""From a recording to a journal: bag, decode, decide, card, journal, resume."""

import json
import sqlite3

import numpy as np
import pytest

from pointloom.config import Attachment
from pointloom.operators import evaluate
from pointloom.plans import fixtures, offline, registry
from pointloom.session import materialise
from pointloom.sources import bag, journal, pointcloud

TABLES = "/root/testdata/sf0.001"
NAMES = ["frame_index", "status", "candidates", "intrusions", "nearest_intrusion_m", "decision", "reason"]


@pytest.fixture(scope="module")
def messages(spark):
    """Messages of the driver's smallest cloud."""
    cloud = fixtures.cloud(spark, TABLES).select("frame_index", "source_index", "x", "y", "z", "intensity", "ring")
    return materialise(pointcloud.packed(cloud), "messages")


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*NAMES).collect())


def recorded(folder, messages):
    """The messages as a recording; a record's place takes the place of its frame number."""
    db = sqlite3.connect(folder / "run_0.db3")
    db.execute("CREATE TABLE topics(id INTEGER PRIMARY KEY, name TEXT, type TEXT)")
    db.execute("CREATE TABLE messages(id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
    db.execute("INSERT INTO topics VALUES (1, '/cloud', ?)", (bag.CLOUD_TYPE,))
    for k, m in enumerate(messages):
        db.execute("INSERT INTO messages VALUES (?, 1, ?, ?)", (k + 1, m["stamp_ns"], bag.serialise(m)))
    db.commit()
    db.close()


def test_recording_to_journal_resumed_once(spark, tmp_path, messages):
    own = [r.asDict(recursive=True) for r in messages.orderBy("frame_index").collect()]
    (tmp_path / "bag").mkdir()
    recorded(tmp_path / "bag", own)
    spark.dataSource.register(bag.BagSource)
    read = spark.read.format("bag").options(path=str(tmp_path / "bag")).load()
    out = f"file://{tmp_path}/out"
    first = offline.run(spark, read, out, last=len(own) // 2)
    then = offline.run(spark, read, out)
    again = offline.run(spark, read, out)
    assert (first["processed"] + then["processed"], then["completed_before"], again["processed"], first["errors"]) == (len(own), first["processed"], 0, 0)
    flagship = {r.frame_index: tuple(r)[1:] for r in registry.queries()["frame_decisions"](spark, TABLES).select(*NAMES).collect()}
    told = {own[r[0]]["frame_index"]: r[1:] for r in rows(offline.completed(spark, out))}
    assert told == flagship
    assert {json.loads(x)["identity"] for f in (tmp_path / "out" / "journal").glob("*.json") for x in f.read_text().splitlines()} == {offline.Plan().identity}
    assert (tmp_path / "out" / "manifest.json").exists() and (tmp_path / "out" / "machine.json").exists()


def test_torn_line_is_done_again(spark, tmp_path, messages):
    out = f"file://{tmp_path}"
    offline.run(spark, messages, out)
    whole = rows(offline.completed(spark, out))
    files = sorted(f for f in (tmp_path / "journal").glob("*.json") if f.stat().st_size)
    kept = files[0].read_text().splitlines(keepends=True)
    lost = json.loads(kept[-1])["frame_index"]
    files[0].write_text("".join(kept[:-1]) + kept[-1][:40])  # the writer died in the middle of a line
    (tmp_path / "journal" / f".{files[0].name}.crc").unlink(missing_ok=True)
    assert {r[0] for r in rows(offline.completed(spark, out))} == {r[0] for r in whole} - {lost}
    assert offline.run(spark, messages, out)["processed"] == 1 and rows(offline.completed(spark, out)) == whole


def test_another_configuration_is_not_resumed(spark, tmp_path, messages):
    out = f"file://{tmp_path}"
    offline.run(spark, messages, out, last=3)
    with pytest.raises(ValueError, match="another configuration"):
        offline.run(spark, messages, out, offline.Plan("inferred"))
    with pytest.raises(ValueError, match="corridor source"):
        offline.Plan("guessed")


def test_bad_and_empty_messages_have_records(spark, tmp_path, messages):
    own = [r.asDict(recursive=True) for r in messages.orderBy("frame_index").limit(4).collect()]
    own[1]["payload"] = own[1]["payload"][:50]  # runs over its record
    own[2]["payload"] = np.full(len(own[2]["payload"]) // 4, np.nan, "<f4").tobytes()  # no valid point
    own[3]["fields"][0]["datatype"] = 99
    out = f"file://{tmp_path}"
    told = offline.run(spark, spark.createDataFrame(own, messages.schema), out)
    assert (told["processed"], told["errors"]) == (4, 2)
    found = {r.frame_index: r for r in offline.completed(spark, out).collect()}
    a, b, c, d = (found[m["frame_index"]] for m in own)
    assert a.status == "ok" and a.error is None
    assert (b.status, b.decision, b.candidates) == ("processing_error", "processing_error", None) and "runs over" in b.error
    assert (c.status, c.decision, c.reason) == ("ok", "insufficient_evidence", "no_ground_filter")
    assert d.status == "processing_error" and "unknown type" in d.error
    assert not any("clear" in (r.decision or "") for r in found.values())


def test_inferred_journal_with_an_attachment(spark, tmp_path, messages):
    plain, attached = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    offline.run(spark, messages, plain, offline.Plan("inferred"))
    offline.run(spark, messages, attached, offline.Plan("inferred", Attachment(s_m=16.0, l_m=9.0, support_s_min_m=5.0, support_s_max_m=16.0, lateral_m=0.02)))
    a, b = ({r.frame_index: r for r in offline.completed(spark, x).collect()} for x in (plain, attached))
    assert {r.decision for r in a.values()} <= {"insufficient_evidence", "insufficient_geometry"} and "ok" in {r.status for r in a.values()}
    assert all(b[k].status == "attachment_conflict" or b[k].status == "insufficient_geometry" == a[k].status for k in b) and set(a) == set(b)


def test_two_journals_are_compared(spark, tmp_path, messages):
    """What a user checks after a change: the same frames, the same decisions."""
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    offline.run(spark, messages, a)
    offline.run(spark, messages, b, last=6)
    exact, near = ["status", "decision", "identity"], ["nearest_intrusion_m"]
    half = evaluate.compare(offline.completed(spark, a), offline.completed(spark, b), exact, near)
    assert {r.difference for r in half.collect()} == {"missing_frame"}
    offline.run(spark, messages, b)
    assert evaluate.compare(offline.completed(spark, a), offline.completed(spark, b), exact, near).collect() == []


def test_last_lines_without_an_end(spark, tmp_path):
    """Every way in which a file can end, over files and block borders."""
    at = tmp_path / "j"
    at.mkdir()
    texts = {"a": 'x1\nx2\n', "b": 'y1\ny2', "c": "", "d": "\n", "e": "é漢\nz", "f": "w\r\nw", "g": "v" * 3000 + "\n" + "u" * 3000}
    for name, text in texts.items():
        (at / f"{name}.json").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = sorted((r.file[-6], r.block, r.n, r.ended, r.value) for r in journal.lines(spark, str(at)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text in texts.items():
        parts = text.split("\n")
        want = [(v, True) for v in parts[:-1]] + ([(parts[-1], False)] if parts[-1] else [])
        assert [(v, ended) for f, _, _, ended, v in got if f == name] == want, name
