"""WARC archives in the shared folder, with a two-level capture index.

Writing: of records with equal payloads the smallest id's is a response, the rest
are revisits without a payload. Tasks write gzip members through pyarrow's file
systems, so any store that it opens by URI will do. A task's files have names of
their own and are known only by the table of captures that the task returns; files
of failed or repeated attempts are never read.

Index: captures sorted by reversed-host URL key and id are written as compressed
blocks of lines; the directory table keeps a row for each block. A lookup sends the
keys asked for and the directory's rows to common key ranges. In each, every key is
binary-searched in that range's part of the directory; the blocks found are read by
range, each once, and their lines binary-searched for the keys. Blocks are dealt out
anew for that, so a key with a third of all captures, in many blocks, is read by many
tasks. The records found are dealt out by file and offset and read in long runs.

Grouping by digest combines before the shuffle; the join of pages to their group
runs between plain exchanges, so a payload that a third of the pages share is split.

Cases: null html is an empty payload, null url an empty target. A null id is never
the smallest unless all in its group are null. Rows that repeat an id and payload
get the same record type. An empty table makes an archive without captures. Extra
columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm import ranges
from plumbline.llm.batches import mapped, sliced
from plumbline.storage import new_folder, written

#: Captures in an index block; bytes after which a task starts another file; bytes read at once.
BLOCK, FILE_BYTES, READ_BYTES = 1000, 1 << 30, 4 << 20
#: Rows of the directory for which a key range is made, where there are so many.
RANGE_BLOCKS = 1000
DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreservedigest/identical-payload-digest"
_NAMES = ("key", "page_id", "url", "file", "offset", "length")
_CAPTURES = "key string, page_id long, url string, file string, offset long, length long"


@dataclass(frozen=True)
class Archive:
    """An archive's folder and the directory of its index (first_key, last_key, shard, offset, length, n)."""

    folder: str
    directory: DataFrame


def url_key(url: Column) -> Column:
    """Reversed-host key: ``com,example,www)/path?query``; the scheme is dropped, the host lower-cased."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), F.substr(rest, F.length(host) + 1))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, uncompressed."""
    block = _HTTP if revisit else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~|^')}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one uncompressed record; the payload's digest is verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != "sha1:" + payload_digest(payload):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, payload


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _packed(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class _Files:
    """Sequential output files of one task."""

    def __init__(self, folder: str, kind: str, most: int = FILE_BYTES) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.kind, self.most, self.out, self.name, self.at = kind, most, None, None, 0

    def put(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at + len(data) > self.most:
            self.close()
            self.name, self.at = f"{uuid.uuid4().hex}.{self.kind}.gz", 0
            self.out = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None)
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _write_captures(rows: DataFrame, folder: str) -> DataFrame:
    struct = T.StructType.fromDDL(_CAPTURES)
    arrow = to_arrow_schema(struct)

    def run(batches):
        files = _Files(folder, "warc")
        for b in batches:
            places = []
            for page_id, url, html, first, revisit in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "html", "first", "revisit")), strict=True):
                places.append(files.put(_packed(record(page_id, url, html.encode(), first, revisit))))
            cols = [b.column("key"), b.column("page_id"), b.column("url"), *map(list, zip(*places, strict=True))] if places else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(cols, arrow, strict=True)], schema=arrow)
        files.close()

    return rows.mapInArrow(run, struct)


def _write_index(captures: DataFrame, folder: str, block: int) -> DataFrame:
    struct = T.StructType.fromDDL("first_key string, last_key string, shard string, offset long, length long, n int")
    arrow = to_arrow_schema(struct)

    def run(batches):
        files, lines = _Files(folder, "index"), []

        def closed():
            text = "\n".join(json.dumps(x, ensure_ascii=False) for x in lines)
            return lines[0][0], lines[-1][0], *files.put(_packed(text.encode())), len(lines)

        out = []
        for b in batches:
            for x in zip(*(b.column(f).to_pylist() for f in _NAMES), strict=True):
                lines.append(x)
                if len(lines) == block:
                    out.append(closed())
                    lines.clear()
        if lines:
            out.append(closed())
        files.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return captures.mapInArrow(run, struct)


def written_archive(
    pages: DataFrame, min_bytes: int = 0, block: int = BLOCK, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> Archive:
    """Writes a record for each row and the index over them. Payloads under ``min_bytes`` are never revisits."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("html", 256)))  # equal payloads; the records carry SHA-1
    firsts = written(rows.filter(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first")), "payloads")
    revisit = ~F.coalesce(F.col("page_id").eqNullSafe(F.col("first")), F.lit(True)) & (F.octet_length("html") >= min_bytes)
    decided = rows.join(firsts, "sha", "left").select("page_id", "url", "html", url_key(F.col("url")).alias("key"), "first", revisit.alias("revisit"))
    captures = written(_write_captures(decided, folder), "captures")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return Archive(folder, written(_write_index(ordered, folder, block), "directory"))


class _Reader:
    """Ranges of the archive's files; keeps one file open."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.name = self.file = None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            self.file, self.name = self.fs.open_input_file(f"{self.root}/{name}"), name
        self.file.seek(offset)
        return self.file.read(length)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = self.name = None


def _lines(reader: _Reader, shard: str, offset: int, length: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(reader.read(shard, offset, length), 31).decode().split("\n")]


def _as_columns(found: list[list]) -> dict:
    return {n: [x[i] for x in found] for i, n in enumerate(_NAMES)}


def captures_of(archive: Archive) -> DataFrame:
    """Every capture in the index, read block by block."""
    folder = archive.folder

    def per_batch(b):
        reader, found = _Reader(folder), []
        for shard, offset, length in zip(*(b.column(n).to_pylist() for n in ("shard", "offset", "length")), strict=True):
            found += _lines(reader, shard, offset, length)
        reader.close()
        return _as_columns(found)

    return mapped(archive.directory, per_batch, _CAPTURES)


def _searched(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, shard, offset, length): the blocks that may hold each key, by binary search in the sparse directory."""
    spark, rows = directory.sparkSession, directory.count()
    parts = ranges.buckets(spark, rows, RANGE_BLOCKS)
    bounds = ranges.sampled_bounds(directory.select("first_key"), parts, rows)
    low, high = ranges.bucket(bounds, lambda b: b < F.col("first_key")), ranges.bucket(bounds, lambda b: b < F.col("last_key"))
    held = directory.select(F.explode(F.sequence(low, high)).alias("part"), F.lit(0).alias("kind"), F.col("first_key").alias("key"), "last_key", "shard", "offset", "length")
    asked = keys.select(ranges.bucket(bounds, lambda b: b < F.col("key")).alias("part"), F.lit(1).alias("kind"), "key", *[F.lit(None).cast(t).alias(n) for n, t in (("last_key", "string"), ("shard", "string"), ("offset", "long"), ("length", "long"))])
    both = held.unionByName(asked).repartitionById(parts, "part").sortWithinPartitions("part", "kind", "key", "last_key")
    struct = T.StructType.fromDDL("key string, shard string, offset long, length long")
    arrow = to_arrow_schema(struct)

    def run(batches):
        now, firsts, blocks = None, [], []
        for batch in sliced(batches):
            found = []
            for part, kind, key, *block in zip(*(batch.column(n).to_pylist() for n in ("part", "kind", "key", "last_key", "shard", "offset", "length")), strict=True):
                if part != now:
                    now, firsts, blocks = part, [], []
                if kind == 0:  # the range's part of the directory comes first, sorted
                    firsts.append(key)
                    blocks.append(block)
                    continue
                at = bisect.bisect_right(firsts, key) - 1
                while at >= 0 and blocks[at][0] >= key:  # the last block that begins by then, and those before it that end with the key
                    found.append((key, *blocks[at][1:]))
                    at -= 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    return both.mapInArrow(run, struct)


def captures_at(archive: Archive, urls: DataFrame) -> DataFrame:
    """Captures of the urls in the column ``url`` (each once, however often it is asked for)."""
    keys = urls.select(url_key(F.coalesce(F.col("url"), F.lit(""))).alias("key")).distinct()
    places = written(_searched(archive.directory, keys), "places")
    parts, folder = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), archive.folder
    ordered = places.repartition(parts, "shard", "offset").sortWithinPartitions("shard", "offset", "key")

    def per_task():
        held = {"at": None, "lines": []}

        def per_batch(b):
            reader, found = _Reader(folder), []
            for key, *place in zip(*(b.column(n).to_pylist() for n in ("key", "shard", "offset", "length")), strict=True):
                if place != held["at"]:
                    held["at"], held["lines"] = place, _lines(reader, *place)
                lines = held["lines"]
                low = bisect.bisect_left(lines, key, key=lambda x: x[0])
                found += lines[low : bisect.bisect_right(lines, key, lo=low, key=lambda x: x[0])]
            reader.close()
            return _as_columns(found)

        return per_batch

    return mapped(ordered, per_task(), _CAPTURES)


def records(archive: Archive, captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) read from the archive's files."""
    folder = archive.folder
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def runs(places):
        """Adjacent ranges together, up to READ_BYTES."""
        run = []
        for place in places:
            if run and (place[0] != run[-1][0] or place[1] != run[-1][1] + run[-1][2] or place[1] + place[2] - run[0][1] > READ_BYTES):
                yield run
                run = []
            run.append(place)
        if run:
            yield run

    def per_batch(b):
        reader, out = _Reader(folder), {n: [] for n in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")}
        for run in runs(zip(*(b.column(n).to_pylist() for n in ("file", "offset", "length")), strict=True)):
            data = reader.read(run[0][0], run[0][1], sum(x[2] for x in run))
            for _, offset, length in run:
                at = offset - run[0][1]
                fields, payload = parsed(zlib.decompress(data[at : at + length], 31))
                response = fields["WARC-Type"] == "response"
                out["page_id"].append(_number(fields["WARC-Record-ID"]))
                out["payload_bytes"].append(len(payload) if response else int(fields["X-Payload-Length"]))
                out["payload_digest"].append(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                out["record_type"].append(fields["WARC-Type"])
                out["refers_to"].append(_number(fields.get("WARC-Refers-To")))
                out["payload"].append(payload if with_payload and response else None)
        reader.close()
        return out

    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return mapped(ordered, per_batch, out + ", payload binary" * with_payload)
