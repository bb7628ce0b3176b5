"""Capture files, messages, CSV tables and sinks."""

import struct

import pytest
from packets import ACK, SYN

from flowspark.contracts import FEATURE_COUNT, FLOW_COLUMNS
from flowspark.operators.flows import packets_to_flows
from flowspark.sources import sinks
from flowspark.sources.captures import (
    capture_rejects, chain_exits, frames_of, list_captures, read_captures, read_frames, read_packets, rejects_of, split_points,
)
from flowspark.sources.messages import decode_json, read_labelled_csv, read_topic, read_vectors


def ip(proto, body, total, ttl=64, options=0, source=b"\x0a\0\0\1", target=b"\x0a\0\0\2"):
    head = bytes([0x45 + options, 0]) + struct.pack(">HIBBH", total, 0, ttl, proto, 0) + source + target
    return head + b"\0" * 4 * options + body


def tcp(flags=ACK, seq=5, window=100, offset=5, sport=1000, dport=80):
    return struct.pack(">HHIIBBHI", sport, dport, seq, 0, offset << 4, flags, window, 0)


def ethernet(payload, kind=0x0800):
    return b"\0" * 12 + struct.pack(">H", kind) + payload


def pcap(frames, order="<", magic=0xA1B2C3D4, linktype=1):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, linktype)
    for t, part, data in frames:
        out += struct.pack(order + "IIII", t, part, len(data), len(data)) + data
    return out


def pcapng(frames, linktype=1):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        size = struct.pack("<I", 12 + len(body))
        return struct.pack("<I", kind) + size + body + size

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", linktype, 0, 65535))
    for us, data in frames:
        out += block(6, struct.pack("<IIIII", 0, us >> 32, us & 0xFFFFFFFF, len(data), len(data)) + data)
    return out


def test_decode_rules(spark, tmp_path):
    """Options shift the transport header; other protocols, short headers and non-IP frames are dropped."""
    frames = [
        ethernet(ip(6, tcp(SYN, 4_294_967_290), 140)), ethernet(ip(6, tcp(), 48, options=2)),
        ethernet(ip(17, struct.pack(">HHHH", 53, 5353, 8, 0), 10)), ethernet(ip(1, b"", 84)),
        ethernet(ip(47, b"\0" * 20, 40)), ethernet(ip(6, tcp()[:19], 40)), ethernet(ip(6, tcp(), 40), 0x86DD),
        ethernet(b"\x44" + ip(6, tcp(), 40)[1:]), ethernet(ip(6, tcp(offset=3), 60)), b"\0" * 10,
    ]
    (tmp_path / "a.pcap").write_bytes(pcap([(1, i, f) for i, f in enumerate(frames)]))
    rows = read_packets(spark, str(tmp_path)).orderBy("pkt_no").collect()
    got = [(r["ts_us"], r["proto"], r["src_port"], r["tcp_seq"], r["tcp_flags"], r["payload_len"]) for r in rows]
    assert got == [(1_000_000, 6, 1000, 4_294_967_290, SYN, 100), (1_000_001, 6, 1000, 5, ACK, 0),
                   (1_000_002, 17, 53, 0, 0, 0), (1_000_003, 1, 0, 0, 0, 64), (1_000_008, 6, 1000, 5, ACK, 28)]
    assert (rows[0]["src_ip"], rows[0]["dst_ip"], rows[0]["ttl"]) == (0x0A000001, 0x0A000002, 64)


@pytest.mark.parametrize("content, times", [
    (pcap([(1, 2, ethernet(ip(6, tcp(), 40)))], ">"), [1_000_002]),
    (pcap([(1, 2_000, ethernet(ip(6, tcp(), 40)))], "<", 0xA1B23C4D), [1_000_002]),
    (pcap([(1, 2, b"\0" * 14 + b"\x08\0" + ip(6, tcp(), 40))], linktype=113), [1_000_002]),
    (pcapng([(1 << 33, ethernet(ip(6, tcp(), 40))), (7, ethernet(ip(1, b"", 20)))]), [7, 1 << 33]),
    (pcap([(1, 2, ethernet(ip(6, tcp(), 40)))])[:-1], []),
])
def test_file_formats(spark, tmp_path, content, times):
    (tmp_path / "x.cap").write_bytes(content)
    assert sorted(r["ts_us"] for r in read_packets(spark, str(tmp_path)).collect()) == times


def test_bad_files_are_set_aside(spark, tmp_path):
    good = pcap([(1, 2, ethernet(ip(6, tcp(), 40)))])
    (tmp_path / "good.pcap").write_bytes(good)
    (tmp_path / "noise.pcap").write_bytes(b"hello")
    (tmp_path / "wifi.pcap").write_bytes(pcap([], linktype=105))
    assert read_frames(spark, str(tmp_path)).count() == 1
    problems = {r["path"].rsplit("/", 1)[-1]: r["problem"] for r in capture_rejects(spark, str(tmp_path)).collect()}
    assert problems == {"noise.pcap": "not a capture file", "wifi.pcap": "unsupported link type 105"}


def test_same_names_in_two_folders_stay_apart(spark, tmp_path):
    for folder in ("day1", "day2"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "1.pcap").write_bytes(pcap([(i, 2, ethernet(ip(6, tcp(), 40))) for i in range(5)]))
    rows = read_packets(spark, str(tmp_path)).collect()
    assert sorted({r["capture_id"] for r in rows}) == ["day1/1.pcap", "day2/1.pcap"] and len(rows) == 10


def test_broken_ends_are_reported(spark, tmp_path):
    record = ethernet(ip(6, tcp(), 40))
    whole = pcap([(i, 2, record) for i in range(3)])
    second = 24 + 16 + len(record)
    (tmp_path / "cut.pcap").write_bytes(whole[:-1])
    (tmp_path / "long.pcap").write_bytes(whole[:second + 8] + (262_145).to_bytes(4, "little") + whole[second + 12:])
    (tmp_path / "next.pcapng").write_bytes(pcapng([(7, record)])[:-3])
    captures = read_captures(spark, str(tmp_path)).persist()
    rejects = {(r["path"], r["problem"]): r["offset"] for r in rejects_of(captures).collect()}
    assert rejects[("cut.pcap", "record is cut off")] == 24 + 2 * (16 + len(record))
    assert rejects[("long.pcap", "record of 262145 bytes")] == second
    assert [k[1] for k in rejects if k[0] == "next.pcapng"] == ["block is cut off"] and len(rejects) == 3
    counts = {r["capture_id"]: r["count"] for r in frames_of(captures).groupBy("capture_id").count().collect()}
    assert counts == {"cut.pcap": 2, "long.pcap": 1}
    captures.unpersist()


def test_splits_start_at_true_records(spark, tmp_path):
    """A capture that carries another capture as payload cannot fool the split points."""
    nested = pcap([(9, 9, ethernet(ip(6, tcp(), 40))) for _ in range(20)])[24:]
    frames = [(i, 0, ethernet(ip(6, tcp(seq=i), 40) + nested)) for i in range(60)]
    (tmp_path / "big.pcap").write_bytes(pcap(frames))
    files = list_captures(str(tmp_path))
    ranges = split_points(spark, files, 5_000)
    assert len(ranges) > 10 and ranges[0][1] == 24 and ranges[-1][2] == files[0][1]
    assert all(a[2] == b[1] for a, b in zip(ranges, ranges[1:]))
    rows = read_packets(spark, str(tmp_path), 5_000)
    assert sorted(r["tcp_seq"] for r in rows.collect()) == list(range(60))


def test_chain_exits_follow_every_possible_start():
    data = pcap([(1, 1, b"a" * 40), (2, 2, b"b" * 50)])[24:]
    exits = chain_exits(data, 24, 24 + len(data), "<", True)
    assert exits[24] == exits[24 + 56] == 24 + len(data)


def test_captures_stay_apart(spark, tmp_path):
    for name in ("one.pcap", "two.pcap"):
        (tmp_path / name).write_bytes(pcap([(1, 2, ethernet(ip(6, tcp(), 40)))]))
    flows = packets_to_flows(read_packets(spark, str(tmp_path)), hot_rows=None)
    assert {(r["capture_id"], r["emit_no"]) for r in flows.collect()} == {("one.pcap", 0), ("two.pcap", 0)}


def test_json_defaults_and_rejects(spark):
    texts = ['{"a": 1, "b": "x"}', '{"b": "y"}', "{broken", '{"a": "many"}', "[1]", "7", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    good, bad = decode_json(df, "a int, b string", {"a": 0}, "i")
    assert [tuple(r) for r in good.orderBy("i").collect()] == [(0, 1, "x"), (1, 0, "y")]
    assert sorted(r["i"] for r in bad.collect()) == [2, 3, 4, 5, 6, 7]


def test_vectors_of_the_wrong_width_are_left_out(spark, tmp_path):
    lines = ['{"features": [%s]}' % ",".join(["1.5"] * n) for n in (FEATURE_COUNT, 3)] + ["{}", "oops"]
    (tmp_path / "v.jsonl").write_text("\n".join(lines))
    assert read_vectors(spark, str(tmp_path)).count() == 1


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b"\xef\xbb\xbfid,label,proto,dur,spkts\n3,1,tcp,0.5,7\n")
    row = read_labelled_csv(spark, str(path)).first()
    assert (row["id"], row["label"], row["proto"], row["dur"], row["spkts"]) == (3, 1, "tcp", 0.5, 7)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "srcip string, n int")
    out = lambda n: str(tmp_path / n)
    sinks.fan_out(df, [lambda d: sinks.write_json_lines(d, out("lines")),
                       lambda d: sinks.publish(d, "parquet", path=out("topic"))])
    assert spark.read.json(out("lines")).count() == 2
    assert {tuple(r) for r in spark.read.parquet(out("topic")).collect()} == {
        ("a", '{"srcip":"a","n":1}'), ("b", '{"srcip":"b","n":2}')}
    for _ in range(2):
        sinks.append_table(df, out("table"))
    assert spark.read.parquet(out("table")).count() == 4
    audit = spark.createDataFrame([("f", 86_400_000 * 3 + 5)], "flow_id string, ts_ms bigint")
    sinks.write_audit_log(audit, out("audit"))
    assert str(spark.read.json(out("audit")).first()["day"]) == "1970-01-04"
    sinks.write_prepared({"train_full": df, "test_full": df}, out("prepared"), "csv")
    assert spark.read.option("header", True).csv(out("prepared/test_full")).count() == 2
    assert read_topic(spark, "text", streaming=False, path=out("lines")).columns == ["key", "value"]


def test_flow_record_has_the_declared_fields(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap([(1, 2, ethernet(ip(6, tcp(), 40)))]))
    flows = packets_to_flows(read_packets(spark, str(tmp_path)), hot_rows=None)
    assert flows.columns[:44] == FLOW_COLUMNS and len(FLOW_COLUMNS) == 44


def test_threshold_contract(spark, tmp_path):
    sinks.write_contract(spark, str(tmp_path / "c"), 0.42)
    assert sinks.read_threshold(spark, str(tmp_path / "c")) == 0.42
    assert sinks.read_threshold(spark) == 0.69 and sinks.read_threshold(spark, None, 0.5) == 0.5


def test_only_places_where_chains_join_pass_through_the_driver(spark, tmp_path, monkeypatch):
    """Small records leave thousands of possible starts in a range; a few numbers per range are told of them."""
    from flowspark.sources import captures

    frames = [(i, 0, ethernet(ip(6, tcp(seq=i), 40))) for i in range(40_000)]
    (tmp_path / "small.pcap").write_bytes(pcap(frames))
    (tmp_path / "next.pcapng").write_bytes(pcapng([(i, frames[i][2]) for i in range(2_000)]))
    (tmp_path / "noise.pcap").write_bytes(b"x" * 130_000)
    told = []

    def on_ranges(*args):
        told.append(inner(*args))
        return told[-1]

    inner = captures._on_ranges
    monkeypatch.setattr(captures, "_on_ranges", on_ranges)
    monkeypatch.setattr(captures, "CHAIN_BYTES", 1 << 20)
    files = list_captures(str(tmp_path))
    ranges = split_points(spark, files, 100_000)
    assert len(ranges) > 15 and len(told) == 2 and max(map(len, told)) <= 100
    mine = [r for r in ranges if r[0].endswith("small.pcap")]
    assert mine[0][1] == 24 and all(a[2] == b[1] for a, b in zip(mine, mine[1:])) and mine[-1][2] == dict(files)[mine[0][0]]
    assert len([r for r in ranges if not r[0].endswith("small.pcap")]) == 2
    assert sorted(r["tcp_seq"] for r in read_packets(spark, str(tmp_path), 100_000).filter("capture_id = 'small.pcap'").collect()) == list(range(40_000))
