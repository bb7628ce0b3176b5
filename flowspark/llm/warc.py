"""Web archives (WARC 1.1) compressed with Zstandard, one frame per record.

Reading: an archive may begin with a skippable frame that holds the dictionary for all its frames (itself
compressed or not). Every later frame is one record. Frames are found by walking their block headers, so each is
decompressed on its own; versions, required headers, lengths and digests are checked, and whatever is wrong is
reported in a row's ``problem`` instead of being skipped.

Writing: Spark's text sink writes byte strings as they are, through the cluster's own file system and commit
protocol, so a lost executor leaves no half archive. Its separator is set to an empty skippable frame, which readers
of Zstandard pass over. Each task writes one archive and trains its dictionary on the records it starts with.

Duplicates: among records of equal payload the one with the largest id is a response, the others revisit it.

Defined cases: a null payload counts as empty; a null URL leaves out the target header, and bytes in it that headers
may not hold are percent-encoded; records without an id never become the one that others revisit (a group of
only such records are all responses); rows that repeat the winning id are responses too; ties cannot change a result;
an empty table writes and reads no record; other columns of the input are not archived.
"""

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.tables import stored
from flowspark.session import scratch_folder, ship_package

# Fixed values of the formats: frame magics, the separator (a skippable frame of length 0) and line ends.
FRAME, DICTIONARY_FRAME, DICTIONARY = 0xFD2FB528, 0x184D2A5D, 0xEC30A437
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
SEPARATOR = b"P*M\x18\x00\x00\x00\x00"
END = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 32 << 10, 2 << 20, 3
LARGEST_RECORD = 1 << 31

READ_SCHEMA = ("path string, offset bigint, record_type string, record_id string, target_uri string, "
               "refers_to_id string, payload_digest string, payload_bytes bigint, payload binary, problem string")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value without line ends, blanks or control characters."""
    return "".join(c if " " < c < "\x7f" or c > "\x9f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_bytes(kind: str, record_id: str, uri: str | None, refers_to: str | None, digest: str, size: int,
                 payload: bytes, date: str = DATE) -> bytes:
    """One record. A revisit repeats the payload's length and digest but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + END + block + END + END


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its header and block headers; ValueError if it is cut off."""
    descriptor = data[at + 4]
    single, checksum = descriptor >> 5 & 1, descriptor >> 2 & 1
    content = (1 if single else 0, 2, 4, 8)[descriptor >> 6]
    at += 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + content
    while True:
        if at + 3 > len(data):
            raise ValueError("frame is cut off")
        header = int.from_bytes(data[at:at + 3], "little")
        at += 3 + (1 if header >> 1 & 3 == 1 else header >> 3)
        if header & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise ValueError("frame is cut off")
    return at


def load_dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary of a leading frame, compressed or not."""
    if int.from_bytes(content[:4], "little") == FRAME:
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    if int.from_bytes(content[:4], "little") != DICTIONARY:
        raise ValueError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(content)


def frames(data: memoryview) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, problem) for every frame; what cannot be walked further ends with a problem."""
    at, decompressor = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        try:
            if len(data) - at < 8:
                raise ValueError("bytes after the last frame")
            magic, size = struct.unpack_from("<II", data, at)
            if magic in SKIPPABLE:
                end = at + 8 + size
                if end > len(data):
                    raise ValueError("skippable frame is cut off")
                if at == 0 and magic == DICTIONARY_FRAME:
                    decompressor = zstandard.ZstdDecompressor(dict_data=load_dictionary(bytes(data[8:end])))
                at = end
                continue
            if magic != FRAME:
                raise ValueError("not a Zstandard frame")
            end = frame_end(data, at)
        except (ValueError, IndexError, zstandard.ZstdError) as error:
            yield at, None, str(error) or type(error).__name__
            return
        try:
            yield at, decompressor.decompress(data[at:end], max_output_size=LARGEST_RECORD), None
        except zstandard.ZstdError as error:
            yield at, None, str(error)
        at = end


def parse_record(record: bytes) -> dict:
    """Headers and payload of one record; ``problem`` says what is wrong with it."""
    head, blank, rest = record.partition(END + END)
    lines = head.split(END)
    if not blank or not lines[0].startswith(b"WARC/1."):
        return {"problem": "no version line or end of headers"}
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return {"problem": f"bad header line {line[:40]!r}"}
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode(errors="replace")
    missing = [n for n in ("warc-type", "warc-record-id", "warc-date", "content-length") if not headers.get(n)]
    if missing:
        return {"problem": f"no {missing[0]}"}
    if not headers["content-length"].isdecimal():
        return {"problem": "bad content-length"}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != END + END:
        return {"problem": f"record has {len(rest) - 4} bytes where {size} are stated"}
    block = rest[:size]
    stated = headers.get("warc-block-digest")
    if stated and stated.lower().startswith("sha1:") and stated[5:].upper() != sha1_base32(block):
        return {"problem": "block digest differs"}
    found = {"record_type": headers["warc-type"], "record_id": headers["warc-record-id"].strip("<>"),
             "target_uri": headers.get("warc-target-uri"), "refers_to_id": headers.get("warc-refers-to", "").strip("<>") or None,
             "payload_digest": headers.get("warc-payload-digest", "").partition(":")[2] or None, "problem": None}
    if headers.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(END + END)
        lengths = [line.partition(b":")[2].strip() for line in http.split(END)[1:] if line.lower().startswith(b"content-length:")]
        if not blank:
            return {"problem": "no end of HTTP headers"}
        found["payload_bytes"] = int(lengths[0]) if lengths and lengths[0].isdigit() else len(payload)
    else:
        payload = block
        found["payload_bytes"] = len(block)
    if found["record_type"] == "response":
        found["payload"] = payload
        if found["payload_bytes"] != len(payload):
            return {"problem": f"payload has {len(payload)} bytes where {found['payload_bytes']} are stated"}
        if found["payload_digest"] and found["payload_digest"] != sha1_base32(payload):
            return {"problem": "payload digest differs"}
    elif found["record_type"] == "revisit" and not found["refers_to_id"]:
        return {"problem": "revisit without the record it refers to"}
    return found


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of every archive under ``path``; an archive is handled by one task, record by record."""
    ship_package(spark)
    fields = [f.split()[0] for f in READ_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name = batch.column(0)[row].as_py()
                data = memoryview(batch.column(1)[row].as_buffer() or b"")
                rows, held = [], 0
                for offset, record, problem in frames(data):
                    found = {"problem": problem} if record is None else parse_record(record)
                    if not payloads:
                        found.pop("payload", None)
                    rows.append([name, offset] + [found.get(f) for f in fields[2:]])
                    held += len(found.get("payload") or b"") + 200
                    if held > 4 << 20:
                        yield _rows_batch(rows, fields)
                        rows, held = [], 0
                if rows:
                    yield _rows_batch(rows, fields)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, READ_SCHEMA)


def _rows_batch(rows: list[list], fields: list[str]) -> pa.RecordBatch:
    kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kinds.get(f, pa.string())) for f, column in zip(fields, zip(*rows))], names=fields)


def with_revisits(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``df`` with ``__digest`` (hex SHA-1) and ``__winner``, the id that a record's payload group refers to.

    Ids of groups with more than one record are stored first; joining plain tables lets Spark split a digest that
    very many records share.
    """
    digests = df.select(F.col(f"`{key}`").alias("__key"), F.sha1(F.coalesce(F.col(f"`{payload}`"), F.lit(""))).alias("__digest"))
    groups = digests.groupBy("__digest").agg(F.max("__key").alias("__winner"), F.count("*").alias("__n"))
    shared = stored(groups.where("__n > 1").select("__digest", "__winner"), "payloads")
    hashed = df.withColumn("__digest", F.sha1(F.coalesce(F.col(f"`{payload}`"), F.lit(""))))
    return hashed.join(shared, "__digest", "left")


def write_archives(df: DataFrame, key: str, url: str, payload: str, path: str, id_prefix: str = "urn:x-page:",
                   date: str = DATE, level: int = LEVEL) -> None:
    """Write a record per row as archives ``part-*`` under ``path``, one per task."""
    ship_package(df.sparkSession)
    rows = with_revisits(df.select(f"`{key}`", f"`{url}`", f"`{payload}`"), key, payload)
    rows = rows.select(F.col(f"`{key}`").cast("string"), F.col("__winner").cast("string"), f"`{url}`", f"`{payload}`")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for page, winner, uri, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode()
                revisit = winner is not None and page != winner
                yield record_bytes("revisit" if revisit else "response", f"{id_prefix}{page}", uri,
                                   f"{id_prefix}{winner}" if revisit else None, sha1_base32(data), len(data), data, date)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, sample, held = records(batches), [], 0
        for record in source:
            sample.append(record)
            held += len(record)
            if held >= SAMPLE_BYTES:
                break
        if not sample:
            return
        dictionary = _trained(sample)
        head = []
        if dictionary is not None:
            content = dictionary.as_bytes()
            head = [struct.pack("<II", DICTIONARY_FRAME, len(content)) + content]
        compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True, write_checksum=True)
        chunk, held = [], 0
        for data in chain(head, map(compressor.compress, chain(sample, source))):
            chunk.append(data)
            held += len(data)
            if held > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.binary())], names=["value"])
                chunk, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.binary())], names=["value"])

    written = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    written.write.option("lineSep", SEPARATOR.decode("latin-1")).text(path)


def _trained(sample: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary for one archive, or None where its first records are too few or too alike to train one."""
    if len(sample) < 16:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s[:16 << 10] for s in sample])
    except zstandard.ZstdError:
        return None


def archive_round_trip(df: DataFrame, key: str, url: str, payload: str, payloads: bool = False) -> DataFrame:
    """Write ``df`` as archives in the shared scratch folder and read them back."""
    path = scratch_folder(df.sparkSession, "archives")
    write_archives(df, key, url, payload, path)
    return read_archives(df.sparkSession, path, payloads)
