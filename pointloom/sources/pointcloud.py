"""Packed point clouds: records of self-described fields in a binary payload, decoded to columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Type codes of fields: NumPy types. Fixed values of the message format.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
#: Letters of the same types for ``struct``.
LETTERS = {1: "b", 2: "B", 3: "h", 4: "H", 5: "i", 6: "I", 7: "f", 8: "d"}
#: Names under which a field tells the number of a return.
RETURN_FIELDS = ("return", "return_type", "return_mode", "echo", "dual_return")
OPTIONAL = ("intensity", "ring", "timestamp")
#: Records of messages that are passed on in one batch.
ROWS_AT_ONCE = 20_000
MESSAGE = "frame_index long, stamp_ns long, frame_id string, height int, width int, point_step int, row_step int, is_bigendian boolean, fields array<struct<name:string,offset:int,datatype:int,count:int>>, payload binary"
POINTS = "frame_index long, stamp_ns long, source_index long, x float, y float, z float, intensity float, ring int, timestamp double, absent_fields array<string>"


def check_fields(fields: list[dict]) -> dict[str, dict]:
    """Fields by name; x, y and z must be there as floats of one type, and no field may be an array."""
    by = {f["name"]: f for f in fields}
    for f in fields:
        if f["count"] != 1:
            raise ValueError(f"field {f['name']} is an array of {f['count']}")
        if f["datatype"] not in TYPES:
            raise ValueError(f"field {f['name']} has the unknown type {f['datatype']}")
    kinds = {by[c]["datatype"] if c in by else None for c in "xyz"}
    if len(kinds) != 1 or not kinds <= {7, 8}:
        raise ValueError("x, y and z must be floats of one type")
    return by


def place(m: dict, name: str) -> tuple[dict, np.dtype]:
    """A field and its type, if it lies inside of the records; the payload may be given by its length."""
    f = {x["name"]: x for x in m["fields"]}[name]
    kind = np.dtype(("<", ">")[bool(m["is_bigendian"])] + TYPES[f["datatype"]])
    have = m["payload"] if isinstance(m["payload"], int) else len(m["payload"])
    if f["offset"] + kind.itemsize > m["point_step"] or m["width"] * m["point_step"] > m["row_step"] or m["height"] * m["row_step"] > have:
        raise ValueError(f"field {name} runs over its record")
    return f, kind


def field(m: dict, name: str) -> np.ndarray:
    """One field of all points, by a strided view over rows that may be padded; any offset and byte order."""
    f, kind = place(m, name)
    h, w, step, row = m["height"], m["width"], m["point_step"], m["row_step"]
    raw = np.frombuffer(m["payload"], dtype=np.uint8)[: h * row]
    rows = raw.reshape(h, row)[:, : w * step].reshape(h * w, step)
    return np.ascontiguousarray(rows[:, f["offset"] : f["offset"] + kind.itemsize]).view(kind)[:, 0].astype(kind.newbyteorder("="))


def decode(m: dict) -> dict[str, np.ndarray]:
    """Columns of a message: x, y, z in the type that the fields declare, and the optional fields that it has."""
    by = check_fields(m["fields"])
    out = {c: field(m, c) for c in "xyz"}
    for name, kind in (("intensity", np.float32), ("ring", np.int32), ("timestamp", np.float64)):
        if name in by:
            out[name] = field(m, name).astype(kind)
    return out


def decode_records(m: dict, chosen: list[int]) -> list[dict]:
    """The same, record by record with ``struct``: an independent reader of chosen points."""
    by, order = check_fields(m["fields"]), "><"[not m["is_bigendian"]]
    out = []
    for i in chosen:
        at = (i // m["width"]) * m["row_step"] + (i % m["width"]) * m["point_step"]
        out.append({n: struct.unpack_from(order + LETTERS[f["datatype"]], m["payload"], at + f["offset"])[0] for n, f in by.items()})
    return out


def pack(columns: dict[str, list], kinds: dict[str, int], point_step: int | None = None, width: int | None = None, pad: int = 0,
    bigendian: bool = False, offsets: dict[str, int] | None = None) -> dict:
    """A message with the given columns, the inverse of ``decode``."""
    order, fields, at = "<>"[bigendian], [], 0
    for name, kind in kinds.items():
        at = (offsets or {}).get(name, at)
        fields.append({"name": name, "offset": at, "datatype": kind, "count": 1})
        at += struct.calcsize("=" + LETTERS[kind])
    step, n = point_step or at, len(next(iter(columns.values())))
    width = width or n
    height = -(-n // width) if n else 0
    payload = bytearray(height * (width * step + pad))
    for i in range(n):
        for f in fields:
            struct.pack_into(order + LETTERS[f["datatype"]], payload,
                (i // width) * (width * step + pad) + (i % width) * step + f["offset"], columns[f["name"]][i])
    return {"height": height, "width": width, "point_step": step, "row_step": width * step + pad, "is_bigendian": bigendian,
        "fields": fields, "payload": bytes(payload)}


#: Fields of the messages that ``packed`` makes: coordinates as float64, offsets as they come.
PACKED = (("x", "f8", 8), ("y", "f8", 8), ("z", "f8", 8), ("intensity", "f4", 7), ("ring", "u2", 4))


def packed(rows: DataFrame) -> DataFrame:
    """One message for each frame of records (frame_index, source_index, x, y, z, intensity, ring), in the order of source_index."""
    names = [c.split()[0] for c in MESSAGE.split(", ")]
    kind = np.dtype([(n, "<" + t) for n, t, _ in PACKED])
    fields = [{"name": n, "offset": kind.fields[n][1], "datatype": code, "count": 1} for n, _, code in PACKED]

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("source_index").to_numpy())
        raw = np.zeros(table.num_rows, dtype=kind)
        for n, _, _ in PACKED:
            raw[n] = table.column(n).to_numpy()[order]
        n, size = table.num_rows, kind.itemsize
        frame = table.column("frame_index")[0].as_py()
        row = [frame, frame * 100_000_000, "sensor", 1, n, size, n * size, False, fields, raw.tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 4, pa.bool_(),
            pa.list_(pa.struct([("name", pa.string()), ("offset", pa.int32()), ("datatype", pa.int32()), ("count", pa.int32())])),
            pa.binary()]
        return pa.table({c: pa.array([v], t) for c, t, v in zip(names, kinds, row, strict=True)})

    return rows.select("frame_index", "source_index", *[n for n, _, _ in PACKED]).groupBy("frame_index").applyInArrow(run, MESSAGE)


def with_errors(messages: DataFrame) -> DataFrame:
    """``messages`` with ``error``: why one can't be decoded (null: it can). Looks at descriptions and sizes, not at points."""
    from pyspark.sql import functions as F

    names = [c.split()[0] for c in MESSAGE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = []
            for m in b.to_pylist():
                try:
                    for name in check_fields(m["fields"] or []):
                        place(m, name)
                    told.append(None)
                except (ValueError, TypeError) as e:
                    told.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(told, pa.string())], names=["frame_index", "error"])

    small = [F.length("payload").alias(n) if n == "payload" else F.col(n) for n in names]
    found = messages.select(*small).mapInArrow(run, "frame_index long, error string").where("error is not null").groupBy("frame_index").agg(F.min("error").alias("error"))
    return messages.join(F.broadcast(found) if found.limit(100_001).count() <= 100_000 else found, "frame_index", "left")


def points(messages: DataFrame, kind: str = "float") -> DataFrame:
    """One row for each record of each message, every record kept, missing fields null and listed.

    ``kind`` is the type of x, y and z: "double" keeps what messages of float64 coordinates say, and is exact for others too.
    """
    xyz = {"float": pa.float32(), "double": pa.float64()}[kind]

    def records(m: dict) -> pa.RecordBatch:
        cols = decode(m)
        n = len(cols["x"])
        same = lambda v, t: pa.repeat(pa.scalar(v, t), max(n, 1)).slice(0, n)  # noqa: E731  none can't be repeated
        data = {"frame_index": pa.array(np.full(n, m["frame_index"]), pa.int64()),
            "stamp_ns": same(m["stamp_ns"], pa.int64()), "source_index": pa.array(np.arange(n), pa.int64())}
        for c, t in (("x", xyz), ("y", xyz), ("z", xyz), ("intensity", pa.float32()), ("ring", pa.int32()), ("timestamp", pa.float64())):
            data[c] = pa.array(cols[c]).cast(t, safe=False) if c in cols else pa.nulls(n, t)
        data["absent_fields"] = same([c for c in OPTIONAL if c not in cols], pa.list_(pa.string()))
        return pa.RecordBatch.from_pydict(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # small messages go on together, as each batch has its price
        held, rows = [], 0
        for m in (m for batch in batches for m in batch.to_pylist()):
            held.append(records(m))
            rows += held[-1].num_rows
            if rows >= ROWS_AT_ONCE or len(held) >= 1_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return messages.select(*[c.split()[0] for c in MESSAGE.split(", ")]).mapInArrow(run,
        POINTS.replace("x float, y float, z float", f"x {kind}, y {kind}, z {kind}"))


def headers(messages: DataFrame) -> DataFrame:
    """What each message says of itself, and whether it tells returns apart."""
    from pyspark.sql import functions as F

    return messages.select("frame_index", "stamp_ns", "frame_id", "height", "width", "point_step", "row_step", "is_bigendian",
        F.exists("fields", lambda f: f["name"].isin(*RETURN_FIELDS)).alias("has_return_type"),
        F.transform("fields", lambda f: f["name"]).alias("field_names"))
