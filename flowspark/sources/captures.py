"""Capture files (.pcap, .pcapng) as a frame table.

``packet_capture`` is a Spark data source with one input partition per byte range of a file. Record
starts inside a large file are found by :func:`split_points`, exactly: each range reports, for every
offset at which a record could begin, where the chain of records from there leaves the range, and the
chain from the file's first record picks the one that is true.
"""

import json
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from flowspark.contracts import FRAME_SCHEMA
from flowspark.functions.binary import LINK_HEADER_BYTES, decode_frames
from flowspark.session import ship_package

# File magics (with byte order and seconds fraction) and block types.
PCAP_MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1),
    b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000),
}
PCAPNG_MAGIC = b"\x0a\x0d\x0d\x0a"
SECTION, INTERFACE, SIMPLE_PACKET, ENHANCED_PACKET = 0x0A0D0D0A, 1, 3, 6
FILE_HEADER, RECORD_HEADER = 24, 16
LARGEST_RECORD = 262_144
SPLIT_BYTES = 256 << 20
CHAIN_BYTES = 16 << 20
BATCH_FRAMES, READ_BYTES = 20_000, 4 << 20
CAPTURE_SCHEMA = T.StructType([*FRAME_SCHEMA, T.StructField("problem", T.StringType())])


def place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a URI or a plain local path."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")  # Spark writes file:/x as well as file:///x


def _open(path: str) -> BinaryIO:
    filesystem, inner = place(path)
    return filesystem.open_input_file(inner)


def list_captures(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the capture files in a folder, or of the one file named."""
    filesystem, inner = place(path)
    info = filesystem.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = f"{path.split('://')[0]}://" if "://" in path else ""
    if prefix and place(prefix + inner)[1] != inner:  # file systems whose inner paths leave out more than the scheme
        stem = path.rstrip("/")
        if not stem.endswith(inner.rstrip("/")):
            raise ValueError(f"cannot name the files of {path}")
        prefix = stem[: len(stem) - len(inner.rstrip("/"))]
    found = filesystem.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File)


def file_problem(head: bytes) -> str | None:
    """Why a file cannot be read, or None."""
    if head[:4] == PCAPNG_MAGIC:
        return None
    if head[:4] not in PCAP_MAGICS or len(head) < FILE_HEADER:
        return "not a capture file"
    linktype = struct.unpack_from(PCAP_MAGICS[head[:4]][0] + "I", head, 20)[0]
    return None if linktype in LINK_HEADER_BYTES else f"unsupported link type {linktype}"


def capture_name(root: str, path: str) -> str:
    """A capture's id: its path under the folder that was read, so files of the same name stay apart."""
    top, inner = (place(p)[1].rstrip("/") for p in (root, path))
    if inner == top:  # one file was named
        return inner.rsplit("/", 1)[-1]
    if not inner.startswith(top + "/"):
        raise ValueError(f"{path} is not under {root}")
    return inner[len(top) + 1:]


class Broken(Exception):
    """A record that cannot be read; reading its file ends there."""

    def __init__(self, offset: int, problem: str):
        super().__init__(problem)
        self.offset, self.problem = offset, problem


def pcap_records(source: BinaryIO, begin: int, end: int, order: str, fraction: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(offset, time in µs, captured length, data) of the records starting in [begin, end); Broken at a bad one."""
    source.seek(begin)
    offset, pending, header = begin, b"", struct.Struct(order + "IIII")
    while offset < end:
        if len(pending) < RECORD_HEADER + LARGEST_RECORD:
            pending += source.read(READ_BYTES)
        at = 0
        while offset < end and at + RECORD_HEADER <= len(pending):
            seconds, part, caplen, _ = header.unpack_from(pending, at)
            if caplen > LARGEST_RECORD:
                raise Broken(offset, f"record of {caplen} bytes")
            stop = at + RECORD_HEADER + caplen
            if stop > len(pending):
                break
            yield offset, seconds * 1_000_000 + part // fraction, caplen, pending[at + RECORD_HEADER:stop]
            offset, at = offset + RECORD_HEADER + caplen, stop
        if at == 0 and offset < end:
            raise Broken(offset, "record is cut off")
        pending = pending[at:]


def pcapng_records(source: BinaryIO) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(offset, time in µs, link type, captured length, data) of a whole block-structured file; Broken at a bad block."""
    offset, order, interfaces = 0, "<", []
    while True:
        source.seek(offset)
        head = source.read(12)
        if not head:
            return
        if len(head) < 12:
            raise Broken(offset, "block is cut off")
        if head[:4] == PCAPNG_MAGIC:
            order, interfaces = ("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack_from(order + "II", head)
        if size < 12:
            raise Broken(offset, f"block of {size} bytes")
        body = head[8:] + source.read(size - 12)
        if len(body) < size - 8:
            raise Broken(offset, "block is cut off")
        body = body[: size - 12]
        if kind == INTERFACE:
            interfaces.append((struct.unpack_from(order + "H", body)[0], _ticks_per_second(body, order)))
        elif kind == ENHANCED_PACKET:
            which, high, low, caplen = struct.unpack_from(order + "IIII", body)
            linktype, ticks = interfaces[which]
            yield offset, ((high << 32) | low) * 1_000_000 // ticks, linktype, caplen, body[20:20 + caplen]
        elif kind == SIMPLE_PACKET and interfaces:
            caplen = min(struct.unpack_from(order + "I", body)[0], len(body) - 4)
            yield offset, 0, interfaces[0][0], caplen, body[4:4 + caplen]
        offset += size


def _ticks_per_second(body: bytes, order: str) -> int:
    at = 8
    while at + 4 <= len(body):
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 9 and size:
            value = body[at + 4]
            return 2 ** (value & 127) if value & 128 else 10 ** value
        if code == 0:
            break
        at += 4 + size + (-size % 4)
    return 1_000_000


class ByteRange(InputPartition):
    def __init__(self, path: str, begin: int, end: int, name: str):
        super().__init__((path, begin, end))
        self.path, self.begin, self.end, self.name = path, begin, end, name


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.ranges = options["path"], json.loads(options.get("ranges", "null"))

    def partitions(self) -> list[ByteRange]:
        ranges = self.ranges
        if ranges is None:
            ranges = [[path, FILE_HEADER, size] for path, size in list_captures(self.path)]
        return [ByteRange(*r, capture_name(self.path, r[0])) for r in ranges]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        name = partition.name
        with _open(partition.path) as source:
            head = source.read(FILE_HEADER)
            problem = file_problem(head)
            if problem:
                yield _frame_batch(name, [(0, None, None, None, None)], problem)
                return
            if head[:4] == PCAPNG_MAGIC:
                rows = pcapng_records(source)
            else:
                order, fraction = PCAP_MAGICS[head[:4]]
                linktype = struct.unpack_from(order + "I", head, 20)[0]
                records = pcap_records(source, partition.begin, partition.end, order, fraction)
                rows = ((o, t, linktype, n, data) for o, t, n, data in records)
            batch = []
            broken = None
            try:
                for row in rows:
                    batch.append(row)
                    if len(batch) == BATCH_FRAMES:
                        yield _frame_batch(name, batch)
                        batch = []
            except Broken as error:
                broken = error
            if batch:
                yield _frame_batch(name, batch)
            if broken is not None:
                yield _frame_batch(name, [(broken.offset, None, None, None, None)], broken.problem)


def _frame_batch(name: str, rows: list[tuple], problem: str | None = None) -> pa.RecordBatch:
    offsets, times, links, lengths, data = zip(*rows)
    arrays = [
        pa.array([name] * len(rows)), pa.array(offsets, pa.int64()), pa.array(times, pa.int64()),
        pa.array(links, pa.int32()), pa.array(lengths, pa.int32()), pa.array(data, pa.binary()),
        pa.array([problem] * len(rows), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=CAPTURE_SCHEMA.fieldNames())


class CaptureSource(DataSource):
    """``spark.read.format("packet_capture").load(folder)``; ``pkt_no`` is the record's byte offset.

    A row with a ``problem`` stands for what could not be read from its offset on.
    """

    @classmethod
    def name(cls) -> str:
        return "packet_capture"

    def schema(self):
        return CAPTURE_SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(dict(self.options))


def chain_exits(data: bytes, begin: int, end: int, order: str, at_end_of_file: bool) -> dict[int, int]:
    """Where the record chain from each possible start in a range leaves it.

    ``data`` holds the bytes from ``begin`` on. Possible starts reach ``LARGEST_RECORD`` past ``begin``;
    chains that meet an impossible length die, chains that meet join, so only few are followed far.
    """
    span = end - begin
    raw = np.frombuffer(data, dtype=np.uint8)
    reach = min(RECORD_HEADER + LARGEST_RECORD + 1, span, max(len(raw) - RECORD_HEADER + 1, 0))
    shifts = (0, 8, 16, 24) if order == "<" else (24, 16, 8, 0)
    lengths = sum(raw[8 + i: 8 + i + reach].astype(np.int64) << s for i, s in enumerate(shifts))
    header, left = struct.Struct(order + "I"), {}
    for start in np.flatnonzero(lengths <= LARGEST_RECORD).tolist():
        path, at = [], start
        while at < span and at not in left:
            path.append(at)
            if at + RECORD_HEADER > len(data):
                at = span if at_end_of_file else -1
                break
            caplen = header.unpack_from(data, at + 8)[0]
            at = at + RECORD_HEADER + caplen if caplen <= LARGEST_RECORD else -1
            if at < 0:
                break
        result = left.get(at, at if at >= span else -1)
        for p in path:
            left[p] = result
    return {begin + s: begin + e for s, e in left.items() if e >= 0 and s < reach}


def chain_points(data: bytes, begin: int, end: int, order: str, at_end_of_file: bool, start: int,
                 step: int) -> tuple[list[int], int | None]:
    """The first record of the chain from ``start`` in every ``step`` bytes of a range, and where it leaves the range.

    A chain that breaks leaves nowhere; its last point is where its last stretch begins.
    """
    header, span, at, points, beyond = struct.Struct(order + "I"), end - begin, start - begin, [], 0
    while at < span:
        if at >= beyond:
            points.append(begin + at)
            beyond = (at // step + 1) * step
        if at + RECORD_HEADER > len(data):
            return points, end if at_end_of_file else None
        caplen = header.unpack_from(data, at + 8)[0]
        if caplen > LARGEST_RECORD:
            return points, None
        at += RECORD_HEADER + caplen
    return points, begin + at


def _on_ranges(spark: SparkSession, asked: list[tuple], schema: str, tell) -> list:
    """What ``tell(data, begin, end, order, at_end_of_file, starts)`` gives for ranges (path, size, begin, end, starts),
    after their path and begin. Files without such chains give nothing."""
    ship_package(spark)

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            for path, size, begin, end, starts in pdf.itertuples(index=False):
                with _open(path) as source:
                    head = source.read(FILE_HEADER)
                    if head[:4] == PCAPNG_MAGIC or file_problem(head):
                        continue
                    source.seek(begin)
                    data = source.read(end - begin + RECORD_HEADER)
                told = tell(data, begin, end, PCAP_MAGICS[head[:4]][0], end == size, [int(s) for s in starts])
                yield pd.DataFrame([(path, begin, *row) for row in told], columns=["path", "begin", *names])

    rows = spark.createDataFrame(asked, "path string, size bigint, begin bigint, end bigint, starts array<bigint>")
    return rows.repartition(len(asked)).mapInPandas(follow, f"path string, begin bigint, {schema}").collect()


def split_points(spark: SparkSession, files: list[tuple[str, int]], split_bytes: int = SPLIT_BYTES) -> list[list]:
    """[path, begin, end] ranges that start and end at record starts; files up to ``split_bytes`` stay whole.

    Chains are followed over parts of ``CHAIN_BYTES`` at least, at whose ends nearly all of them have joined or died. Only
    the few places where they leave a part pass through the driver, and the split points on the chains from there.
    """
    ranges = [[p, FILE_HEADER, size] for p, size in files if size <= split_bytes]
    part = split_bytes * -(-CHAIN_BYTES // split_bytes)
    parts = {(p, b): (p, size, b, min(b + part, size)) for p, size in files if size > split_bytes
             for b in range(FILE_HEADER, size, part)}
    if not parts:
        return ranges
    starts = {key: {FILE_HEADER} if key[1] == FILE_HEADER else set() for key in parts}
    open_ended = [(*p, []) for p in parts.values() if p[3] < p[1]]
    leaves = lambda data, begin, end, order, last, _: {(x,) for x in chain_exits(data, begin, end, order, last).values()}
    for r in _on_ranges(spark, open_ended, "leave bigint", leaves) if open_ended else []:
        if r["leave"] < parts[(r["path"], r["begin"])][1]:
            starts[(r["path"], FILE_HEADER + (r["leave"] - FILE_HEADER) // part * part)].add(r["leave"])
    points = lambda data, begin, end, order, last, entries: [
        (e, *chain_points(data, begin, end, order, last, e, split_bytes)) for e in entries]
    asked = [(*p, sorted(starts[key])) for key, p in parts.items() if starts[key]]
    chains = {(r["path"], r["begin"], r["entry"]): (r["points"], r["leave"]) for r in _on_ranges(
        spark, asked, "entry bigint, points array<bigint>, leave bigint", points)}
    for path, size in files:
        if size <= split_bytes:
            continue
        at = FILE_HEADER
        if (path, at, at) not in chains:  # no chains in such a file
            ranges.append([path, at, size])
            continue
        for begin in range(FILE_HEADER, size, part):
            if at >= min(begin + part, size):
                continue
            found, leave = chains[(path, begin, at)]
            ranges += [[path, *ends] for ends in zip(found, [*found[1:], size if leave is None else leave])]
            if leave is None:  # the chain breaks in here: what is readable ends with this range
                break
            at = leave
    return ranges


def read_captures(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All frames of a folder of captures, and a row with a ``problem`` for each thing that could not be read.

    ``capture_id`` is the file's path under the folder. Store this table to get frames and rejects from one pass.
    """
    ship_package(spark)
    spark.dataSource.register(CaptureSource)
    ranges = split_points(spark, list_captures(path), split_bytes)
    return spark.read.format("packet_capture").option("ranges", json.dumps(ranges)).load(path)


def frames_of(captures: DataFrame) -> DataFrame:
    return captures.filter("problem is null").drop("problem")


def rejects_of(captures: DataFrame) -> DataFrame:
    """(path, offset, problem); what stands before the offset was read."""
    return captures.filter("problem is not null").select(
        F.col("capture_id").alias("path"), F.col("pkt_no").alias("offset"), "problem")


def read_frames(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All frames of a folder of captures; ``capture_id`` is the file's path under it."""
    return frames_of(read_captures(spark, path, split_bytes))


def read_packets(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    return decode_frames(read_frames(spark, path, split_bytes))


def capture_rejects(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, offset, problem) of files, and ends of files, that cannot be read; the rest is not affected by them."""
    return rejects_of(read_captures(spark, path, split_bytes))
