"""Point clouds as they come: packed rows with a description of their fields.

A message is one row: ``fields`` lists name, byte offset, type and count of each field of a
point, ``point_step`` the bytes of a point, ``row_step`` those of a row of ``width`` points
(``height`` rows, each perhaps padded), ``is_bigendian`` their order, ``data`` the bytes.
Only the wanted fields are looked at: an Arrow batch's messages become numpy views of their
data, and no byte of another field is copied.

Cases: rows with a NaN in a wanted field are dropped. A message whose data are null, shorter than
it says, or without one of x, y and z has no points. Optional fields that a message lacks are
zeros. Of a field with a count above one the first value is taken.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MESSAGE = (
    "frame_id long, stamp_us long, height int, width int, is_bigendian boolean, point_step int, row_step int, "
    "fields array<struct<name: string, offset: int, datatype: int, count: int>>, data binary"
)
#: The numbers of the message format's types, in its order, as numpy's.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
MANDATORY = ("x", "y", "z")
#: Points that are put out together.
BLOCK = 200_000


def unpacked(message: dict, wanted: Sequence[str]) -> np.ndarray | None:
    """(points, wanted) numbers of one message, or None where it can't be read."""
    height, width, step, row, data = (message[k] for k in ("height", "width", "point_step", "row_step", "data"))
    known = {f["name"]: f for f in message["fields"] or [] if f["datatype"] in TYPES}
    if data is None or not step or any(n in wanted and n not in known for n in MANDATORY):
        return None
    row = row or width * step
    if height < 0 or width < 0 or row < width * step or len(data) < (height - 1) * row + width * step:
        return None
    order = ">" if message["is_bigendian"] else "<"
    out = np.zeros((height * width, len(wanted)))
    if not len(out):
        return out
    for k, name in enumerate(wanted):
        if name in known:
            f = known[name]
            kind = np.dtype(order + TYPES[f["datatype"]])
            if f["offset"] < 0 or f["offset"] + kind.itemsize > step:
                return None
            view = np.ndarray((height, width), kind, data, f["offset"], (row, step))
            out[:, k] = view.ravel()
    return out


def decoded(messages: DataFrame, fields: dict[str, str] | None = None, keep: Sequence[str] = ("frame_id",)) -> DataFrame:
    """(keep..., point_idx, fields...) a row for each point of the messages; ``fields`` maps names of columns to those of fields."""
    fields = fields or {n: n for n in ("x", "y", "z", "intensity", "doppler")}
    kept = ", ".join(f"{n} {messages.schema[n].dataType.simpleString()}" for n in keep)
    struct = T.StructType.fromDDL(f"{kept}, point_idx int, {', '.join(f'{n} double' for n in fields)}")
    arrow = to_arrow_schema(struct)
    needed = [c for c in ("height", "width", "is_bigendian", "point_step", "row_step", "fields", "data")]

    def run(batches):
        for b in batches:
            yield from _points(b, list(fields.values()), list(keep), arrow)

    return messages.select(*dict.fromkeys([*keep, *needed])).mapInArrow(run, struct)


def blocks(batch: pa.RecordBatch, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of messages with about ``BLOCK`` points each, and one message at least."""
    number = (np.cumsum(counts) - counts) // BLOCK
    ends = [*(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
    for first, end in zip([0, *ends], ends, strict=False):
        yield batch.slice(first, end - first)


def unpacked_together(batch: pa.RecordBatch, wanted: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """In blocks: a slice of the batch, the (points, wanted) numbers of its messages that can be read, the message
    of each point in the slice, and the point's place in it; in order. As ``unpacked`` does one by one."""
    if batch.num_rows:
        height, width = (np.maximum(_whole(batch, n), 0) for n in ("height", "width"))
        for some in blocks(batch, height * width):
            yield some, *_unpacked_block(some, wanted)


def _whole(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _descriptions(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The messages of each description: fields, bytes of a point, order of bytes."""
    fields = batch.column("fields")
    sizes = fields.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    parts = dict(zip([f.name for f in fields.type.value_type], fields.flatten().flatten(), strict=True))
    names = parts["name"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    flat = np.stack([names, *(parts[n].cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) for n in ("offset", "datatype"))], axis=1).astype(np.int64)
    starts, shape = np.cumsum(sizes) - sizes, np.stack([_whole(batch, "point_step"), _whole(batch, "is_bigendian")], axis=1)
    for size in np.unique(sizes):
        which = np.flatnonzero(sizes == size)
        rows = np.concatenate([flat[starts[which][:, None] + np.arange(size)].reshape(len(which), -1), shape[which]], axis=1)
        of = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
        for k in range(of.max() + 1):
            yield which[of == k]


def _unpacked_block(batch: pa.RecordBatch, wanted: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    height, width, step, row = (_whole(batch, n) for n in ("height", "width", "point_step", "row_step"))
    row = np.where(row == 0, width * step, row)
    data = batch.column("data").cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)
    long = np.diff(ends) >= (height - 1) * row + width * step
    fine = data.is_valid().to_numpy(zero_copy_only=False) & (step != 0) & (height >= 0) & (width >= 0) & (row >= width * step) & long
    found = [(np.zeros((0, len(wanted))), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for which in _descriptions(batch):
        known = {f["name"]: f for f in batch.column("fields")[int(which[0])].as_py() or [] if f["datatype"] in TYPES}
        order = ">" if batch.column("is_bigendian")[int(which[0])].as_py() else "<"
        kinds = {n: np.dtype(order + TYPES[known[n]["datatype"]]) for n in wanted if n in known}
        inside = all(0 <= known[n]["offset"] <= step[which[0]] - kind.itemsize for n, kind in kinds.items())
        which = which[fine[which] & ((height[which] * width[which] == 0) | inside)]
        if any(n in wanted and n not in known for n in MANDATORY) or not len(which):
            continue
        counts = height[which] * width[which]
        of = np.repeat(which, counts)
        index = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        line = index // width[of]
        start = ends[of] + line * row[of] + (index - line * width[of]) * step[of]
        out = np.zeros((len(of), len(wanted)))
        for k, name in enumerate(wanted):
            if name in kinds:
                out[:, k] = raw[(start + known[name]["offset"])[:, None] + np.arange(kinds[name].itemsize)].view(kinds[name])[:, 0]
        found.append((out, of, index))
    numbers, of, index = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(of, kind="stable")
    return numbers[order], of[order], index[order]


def _points(batch: pa.RecordBatch, wanted: list[str], keep: list[str], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The points of a batch of messages, in blocks."""
    for some, numbers, of, index in unpacked_together(batch, wanted):
        good = np.flatnonzero(~np.isnan(numbers).any(axis=1))
        if len(good):
            columns = [some.column(n).take(pa.array(of[good])) for n in keep] + [pa.array(index[good])] + [pa.array(numbers[good, k]) for k in range(len(wanted))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def packed(clouds: DataFrame, layout: dict[str, str], is_bigendian: bool = False, point_step: int | None = None, width: int | None = None) -> DataFrame:
    """Messages of clouds (frame_id, stamp_us, points array<struct<...>>): ``layout`` maps fields to numpy types, in
    order; ``width`` points a row, each row padded by 8 bytes, or all in one row."""
    order = ">" if is_bigendian else "<"
    kinds = {n: np.dtype(order + t) for n, t in layout.items()}
    offsets = dict(zip(kinds, np.cumsum([0, *[k.itemsize for k in kinds.values()]]).tolist(), strict=False))
    step = point_step or sum(k.itemsize for k in kinds.values())
    numbers = {t: n for n, t in TYPES.items()}
    described = [{"name": n, "offset": offsets[n], "datatype": numbers[t], "count": 1} for n, t in layout.items()]
    point = np.dtype({"names": list(layout), "formats": list(kinds.values()), "offsets": list(offsets.values()), "itemsize": step})
    arrow = to_arrow_schema(T.StructType.fromDDL(MESSAGE))

    def column(values: pa.Array, kind: np.dtype) -> np.ndarray:
        found = values.to_numpy(zero_copy_only=False)
        if kind.kind in "iu" and (values.null_count or len(found) and not np.iinfo(kind).min <= found.min() <= found.max() <= np.iinfo(kind).max):
            raise OverflowError(f"a null, or a number that {kind} can't hold")
        return found

    def messages(b: pa.RecordBatch) -> pa.RecordBatch:
        """A batch's messages: the bytes of all points are one table, dealt to their places in the lines."""
        sizes = b.column("points").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        parts = b.column("points").flatten()
        table = np.zeros(len(parts), point)
        for name, values in zip([f.name for f in parts.type], parts.flatten(), strict=True):
            if name in layout:
                table[name] = column(values, kinds[name])
        wide = np.where(sizes % width == 0, width, sizes) if width else sizes
        height = np.where(wide > 0, sizes // np.maximum(wide, 1), 1)
        pad = np.where(height > 1, 8, 0)
        ends = np.concatenate([[0], np.cumsum(sizes * step + height * pad)])
        of = np.repeat(np.arange(len(sizes)), sizes)
        index = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = ends[of] + index * step + index // np.maximum(wide[of], 1) * pad[of]
        data = np.full(ends[-1], 0xFF, np.uint8)
        data[place[:, None] + np.arange(step)] = table.view(np.uint8).reshape(len(table), step)
        binary = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
        same = lambda value, kind: pa.array([value], kind).take(pa.array(np.zeros(len(sizes), np.int64)))
        found = {"frame_id": b.column("frame_id"), "stamp_us": b.column("stamp_us"), "height": pa.array(height), "width": pa.array(wide), "is_bigendian": same(is_bigendian, pa.bool_()), "point_step": same(step, pa.int32()), "row_step": pa.array(wide * step + pad), "data": binary}
        return pa.RecordBatch.from_arrays([same(described, f.type) if f.name == "fields" else found[f.name].cast(f.type) for f in arrow], schema=arrow)

    def run(batches):
        for b in batches:
            if b.num_rows:
                for some in blocks(b, b.column("points").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)):
                    yield messages(some)

    return clouds.select("frame_id", "stamp_us", "points").mapInArrow(run, MESSAGE)
