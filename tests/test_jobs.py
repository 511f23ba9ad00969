"""The jobs over growing input: what is new is taken once, reruns change nothing, killed runs are made up for."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import decide_frames, session_journal
from jobs.common import read_config, settings

TABLES = "/root/testdata/sf0.001"
ROLES = {"role_of_recording": {"NATION_1": "locked_test"}}


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def expected_sessions(messages):
    """Plain counting of (session, sequence, topic, body)."""
    out = {}
    for session, sequence, topic, body in set(messages):
        out.setdefault(session, []).append((sequence, topic, body))
    found = {}
    for session, own in out.items():
        numbers = [n for n, _, _ in own if n is not None]
        missing = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        found[session] = (len(own), missing, len(numbers) - len(set(numbers)), len({t or "" for _, t, _ in own}), sum(len(b or "") for _, _, b in own))
    return found


SCHEMA = "conv_id long, turn long, role string, text string"
FIRST = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 4, "user", None), (None, None, None, "")]
THEN = [(1, 1, "assistant", "b"), (1, 4, "user", "c"), (1, 4, "user", "other"), (3, 0, "system", "é"), (2, 4, "user", None), (2, 4, "user", "")]


def sessions(spark, out):
    own = session_journal.output(spark, out)
    return {r.session_id: (r.messages, r.missing, r.conflicting, r.topics, r.chars_sent) for r in own.collect()}


def test_journal_of_a_growing_folder(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("messages", "out", "mark"))
    spark.createDataFrame(FIRST, SCHEMA).coalesce(1).write.parquet(folder)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    first = session_journal.run(spark, folder, out, mark)
    assert (first["received"], first["written"], first["dropped"], first["failed"]) == (5, 4, 1, 0)
    assert sessions(spark, out) == expected_sessions(FIRST)
    spark.createDataFrame(THEN, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    then = session_journal.run(spark, folder, out, mark)
    assert (then["received"], then["written"], then["dropped"]) == (6, 4, 2)  # only the new file is read
    assert sessions(spark, out) == expected_sessions(FIRST + THEN)
    whole = rows(session_journal.output(spark, out))
    again = session_journal.run(spark, folder, out, mark)
    assert (again["received"], again["sessions"]) == (0, 0) and rows(session_journal.output(spark, out)) == whole
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    fresh = str(tmp_path / "fresh")
    session_journal.run(spark, folder, f"{fresh}/out", f"{fresh}/mark")
    assert rows(session_journal.output(spark, f"{fresh}/out")) == whole  # in one run or in several


def test_journal_makes_up_for_sessions_that_were_not_written(spark, tmp_path, monkeypatch):
    folder, out, mark = (str(tmp_path / x) for x in ("messages", "out", "mark"))
    spark.createDataFrame(FIRST + THEN, SCHEMA).coalesce(2).write.parquet(folder)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(session_journal, "summarise", killed)
        session_journal.run(spark, folder, out, mark, {"files_per_batch": 1})
    session_journal.run(spark, folder, out, mark, {"files_per_batch": 1})
    assert sessions(spark, out) == expected_sessions(FIRST + THEN)


def test_a_repeated_batch_leaves_the_same_records(spark, tmp_path):
    folder, out, mark = (str(tmp_path / x) for x in ("messages", "out", "mark"))
    spark.createDataFrame(FIRST, SCHEMA).coalesce(1).write.parquet(folder)
    session_journal.run(spark, folder, out, mark)
    whole = rows(session_journal.output(spark, out))
    for done in (Path(mark) / "commits").iterdir():  # as if the driver had died between the batch's output and its commit
        done.unlink()
    session_journal.run(spark, folder, out, mark)
    assert rows(session_journal.output(spark, out)) == whole


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """Decisions after two runs over growing points, and after each."""
    base = tmp_path_factory.mktemp("frames")
    lines, out = str(base / "lineitem"), str(base / "out")
    tables = [f"{TABLES}/{t}.parquet" for t in ("supplier", "nation")]
    every = spark.read.parquet(f"{TABLES}/lineitem.parquet")
    every.where("l_suppkey % 2 = 0").coalesce(1).write.parquet(lines)
    first = decide_frames.run(spark, lines, *tables, out, ROLES)
    after_first = rows(decide_frames.output(spark, out))
    every.where("l_suppkey % 2 = 1").coalesce(1).write.mode("append").parquet(lines)
    then = decide_frames.run(spark, lines, *tables, out, ROLES)
    return lines, tables, out, first, after_first, then


def test_frames_are_decided_once(spark, grown):
    lines, tables, out, first, after_first, then = grown
    suppliers = spark.read.parquet(tables[0]).where("s_nationkey <> 1").join(spark.read.parquet(lines).select(F.col("l_suppkey").alias("s_suppkey")).distinct(), "s_suppkey")
    even = suppliers.where("s_suppkey % 2 = 0").count()
    assert first["frames"] == even == len(after_first) and then["frames"] == suppliers.count() - even
    whole = rows(decide_frames.output(spark, out))
    assert len(whole) == suppliers.count()
    assert decide_frames.run(spark, lines, *tables, out, ROLES) == {"frames": 0, "recordings": 0} and rows(decide_frames.output(spark, out)) == whole


def test_decisions_are_those_of_the_flagship(spark, grown):
    from pointloom.plans import registry

    names = ["frame_index", "decision", "reason", "candidates", "intrusions", "nearest_intrusion_m"]
    mine = {r.frame_index: tuple(r) for r in decide_frames.output(spark, grown[2]).select(*names).collect()}
    flagship = {r.frame_index: tuple(r) for r in registry.queries()["frame_decisions"](spark, TABLES).select(*names).collect()}
    assert mine == {k: v for k, v in flagship.items() if k in mine}


def test_summary_follows_the_journal(spark, grown):
    out = grown[2]
    cards = decide_frames.output(spark, out)
    assert not cards.groupBy("recording", "frames").count().where("count <> frames").count()
    # a killed run: cards without their summary
    summary = spark.read.parquet(f"{out}/summary")
    with settings(spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
        lost = summary.limit(1).withColumn("frames", F.lit(0).cast("long"))
        lost.write.partitionBy("recording").parquet(f"{out}/other")
        spark.read.parquet(f"{out}/other").write.mode("overwrite").partitionBy("recording").parquet(f"{out}/summary")
        assert decide_frames.summarise(spark, out) == 1
    assert not decide_frames.output(spark, out).groupBy("recording", "frames").count().where("count <> frames").count()


def test_another_configuration_is_refused(spark, grown):
    lines, tables, out, *_ = grown
    with pytest.raises(ValueError, match="another configuration"):
        decide_frames.run(spark, lines, *tables, out, {"role_of_recording": {"NATION_2": "validation"}})


def test_config_files(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"buckets": 3}))
    assert read_config(spark, str(path), session_journal.DEFAULTS) == session_journal.DEFAULTS | {"buckets": 3}
    assert read_config(spark, None, session_journal.DEFAULTS) == session_journal.DEFAULTS
    path.write_text(json.dumps({"bucket": 3}))
    with pytest.raises(ValueError, match="bucket"):
        read_config(spark, str(path), session_journal.DEFAULTS)
    for job in (decide_frames, session_journal):
        shipped = Path(job.__file__).with_suffix(".json")
        assert set(json.loads(shipped.read_text())) == set(job.DEFAULTS)


def test_settings_are_restored(spark):
    with pytest.raises(ZeroDivisionError), settings(spark, spark__sql__shuffle__partitions="7", spark__pointloom__none="x"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "7"
        raise ZeroDivisionError
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.pointloom.none", None) is None


def test_command_line_tells_what_it_wants():
    for job in ("decide_frames", "session_journal"):
        told = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--help"], capture_output=True, text=True, cwd=Path(__file__).parents[1], timeout=120)
        assert told.returncode == 0 and "--config" in told.stdout
