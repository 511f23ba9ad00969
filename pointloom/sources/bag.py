"""Recordings: a folder with a description and one SQLite file of messages, as a Spark data source.

``spark.read.format("bag").option("path", folder).option("topic", name).load()`` gives
``MESSAGE`` rows, one for each recorded cloud. Partitions are ranges of message ids, so each task
seeks only its part; with the option ``pushFilters`` filters on the frame number narrow that range. The topic
``*`` reads the clouds of all topics in the order of their ids; the option ``every`` keeps every so many-th, and ``atMost``
as many of them, evenly spread. The folder must be mounted where tasks run, as SQLite opens files by path.
"""

from __future__ import annotations

import glob
import os
import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .pointcloud import MESSAGE

CLOUD_TYPE = "sensor_msgs/msg/PointCloud2"


def choose_topic(topics: dict[str, str], known: tuple[str, ...] = (), explicit: str | None = None) -> str:
    """The explicit topic, else the only cloud topic, else the only known one; never several merged."""
    clouds = sorted(n for n, t in topics.items() if t == CLOUD_TYPE)
    if explicit is not None:
        if explicit not in clouds:
            raise ValueError(f"{explicit} is not a cloud topic of {clouds}")
        return explicit
    if len(clouds) == 1:
        return clouds[0]
    mine = [n for n in clouds if n in known]
    if len(mine) == 1:
        return mine[0]
    raise ValueError(f"name one of {clouds}" if clouds else "no cloud topic")


def choose_topic_strict(topics: dict[str, str], explicit: str | None = None) -> str:
    """Several cloud topics always need a name."""
    return choose_topic(topics, (), explicit)


def message_file(folder: str) -> str:
    files = sorted(glob.glob(os.path.join(folder, "*.db3")))
    if len(files) != 1:
        raise ValueError(f"{folder} has {len(files)} message files instead of one")
    return files[0]


def description(folder: str) -> dict:
    """Counts, duration and topics from metadata.yaml."""
    import yaml

    with open(os.path.join(folder, "metadata.yaml"), encoding="utf-8") as f:
        info = yaml.safe_load(f)["rosbag2_bagfile_information"]
    topics = {t["topic_metadata"]["name"]: (t["topic_metadata"]["type"], t["message_count"]) for t in info["topics_with_message_count"]}
    return {"messages": info["message_count"], "duration_s": info["duration"]["nanoseconds"] / 1e9,
        "topics": {n: t for n, (t, _) in topics.items()}, "counts": {n: c for n, (_, c) in topics.items()}}


class Reader:
    """Walks a message in its common serialised form: alignment from the fifth byte on, either byte order."""

    def __init__(self, data: bytes):
        self.data, self.at, self.order = data, 4, "<" if data[1] == 1 else ">"

    def number(self, letter: str):
        n = struct.calcsize("=" + letter)
        self.at += (4 - self.at) % n
        out = struct.unpack_from(self.order + letter, self.data, self.at)[0]
        self.at += n
        return out

    def blob(self) -> bytes:
        n = self.number("I")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def text(self) -> str:
        return self.blob().rstrip(b"\0").decode()


def parse(data: bytes) -> dict:
    """A cloud message: header, layout, fields and payload."""
    r = Reader(data)
    sec, nano, frame = r.number("i"), r.number("I"), r.text()
    out = {"stamp_ns": sec * 1_000_000_000 + nano, "frame_id": frame, "height": r.number("I"), "width": r.number("I")}
    out["fields"] = [{"name": r.text(), "offset": r.number("I"), "datatype": r.number("B"), "count": r.number("I")} for _ in range(r.number("I"))]
    out["is_bigendian"] = bool(r.number("?"))
    out["point_step"], out["row_step"] = r.number("I"), r.number("I")
    out["payload"] = r.blob()
    return out


def serialise(m: dict) -> bytes:
    """The inverse of ``parse``."""
    out = bytearray(b"\0\1\0\0")

    def number(letter: str, x) -> None:
        n = struct.calcsize("=" + letter)
        out.extend(b"\0" * ((4 - len(out)) % n))
        out.extend(struct.pack("<" + letter, x))

    def blob(b: bytes) -> None:
        number("I", len(b))
        out.extend(b)

    number("i", m["stamp_ns"] // 1_000_000_000)
    number("I", m["stamp_ns"] % 1_000_000_000)
    blob(m["frame_id"].encode() + b"\0")
    number("I", m["height"])
    number("I", m["width"])
    number("I", len(m["fields"]))
    for f in m["fields"]:
        blob(f["name"].encode() + b"\0")
        number("I", f["offset"])
        number("B", f["datatype"])
        number("I", f["count"])
    number("?", m["is_bigendian"])
    number("I", m["point_step"])
    number("I", m["row_step"])
    blob(m["payload"])
    return bytes(out)


class IdRange(InputPartition):
    def __init__(self, low: int, high: int, before: int, every: int = 1):
        self.low, self.high, self.before, self.every = low, high, before, every


class BagReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.per = options["path"], int(options.get("messagesperpartition", "64"))
        self.known = tuple(x for x in options.get("known", "").split(",") if x)
        self.topic, self.low, self.high = options.get("topic"), 0, None
        self.every, self.most = int(options.get("every", "1")), options.get("atmost")

    def _open(self) -> tuple[sqlite3.Connection, str]:
        """The file, and the condition on the topics that are read."""
        db = sqlite3.connect(f"file:{message_file(self.folder)}?mode=ro", uri=True)
        topics = {n: (i, t) for i, n, t in db.execute("SELECT id, name, type FROM topics")}
        if self.topic == "*":
            return db, f"topic_id IN ({', '.join(str(i) for i, t in topics.values() if t == CLOUD_TYPE) or 'NULL'})"
        return db, f"topic_id = {topics[choose_topic({n: t for n, (_, t) in topics.items()}, self.known, self.topic)][0]}"

    def partitions(self):
        db, topic = self._open()
        ids = [r[0] for r in db.execute(f"SELECT id FROM messages WHERE {topic} ORDER BY id")]
        db.close()
        every = self.every if self.most is None else max(1, -(-len(ids) // int(self.most)))
        chosen = range(self.low, len(ids) if self.high is None else min(len(ids), self.high + 1))
        return [IdRange(ids[k], ids[min(k + self.per, chosen.stop) - 1], k, every) for k in chosen[:: self.per]] or [IdRange(1, 0, 0)]

    def read(self, part: IdRange) -> Iterator[tuple]:
        db, topic = self._open()
        names = [c.split()[0] for c in MESSAGE.split(", ")]
        for k, (data,) in enumerate(db.execute(f"SELECT data FROM messages WHERE {topic} AND id BETWEEN ? AND ? ORDER BY id", (part.low, part.high))):
            if (part.before + k) % part.every:
                continue
            m = parse(data)
            m["frame_index"] = part.before + k
            m["fields"] = [(f["name"], f["offset"], f["datatype"], f["count"]) for f in m["fields"]]
            yield tuple(m[n] for n in names)
        db.close()


class PushingBagReader(BagReader):
    """The reader where ``spark.sql.python.filterPushdown.enabled`` is on (option ``pushFilters``)."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("frame_index",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if name == ("frame_index",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                top = f.value - isinstance(f, LessThan)
                self.high = top if self.high is None else min(self.high, top)
            yield f  # Spark still applies it; here it only narrows what is read


class BagSource(DataSource):
    """Registered with ``spark.dataSource.register(BagSource)``."""

    @classmethod
    def name(cls) -> str:
        return "bag"

    def schema(self) -> str:
        return MESSAGE

    def reader(self, schema):
        options = {k.lower(): v for k, v in self.options.items()}  # as Spark matches their names
        return PushingBagReader(options) if options.get("pushfilters", "false").lower() == "true" else BagReader(options)


def message_at(folder: str, place: int, topic: str | None = None, stamp_ns: int | None = None) -> dict:
    """One message of a recording by its place among its topic's, for a look at a single frame; an error if its stamp is another."""
    db, which = BagReader({"path": folder} | ({"topic": topic} if topic else {}))._open()
    row = db.execute(f"SELECT data FROM messages WHERE {which} ORDER BY id LIMIT 1 OFFSET ?", (place,)).fetchone()
    db.close()
    if row is None:
        raise ValueError(f"no message {place}")
    m = parse(row[0])
    if stamp_ns is not None and m["stamp_ns"] != stamp_ns:
        raise ValueError(f"message {place} has the stamp {m['stamp_ns']}")
    return m
