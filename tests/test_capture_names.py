"""Files of the same name in two folders stay apart, however the root is spelled."""

import struct

import pytest

from flowspark.sources.captures import capture_name, list_captures, read_frames


@pytest.mark.parametrize("root", ["{}", "{}/", "file:{}", "file:{}/", "file://{}", "file://{}/"])
def test_same_names_in_two_folders(spark, tmp_path, root):
    for day in ("day1", "day2"):
        (tmp_path / day).mkdir()
        head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 262144, 1)
        (tmp_path / day / "1.pcap").write_bytes(head + struct.pack("<IIII", 1, 0, 20, 20) + bytes(20))
    path = root.format(tmp_path)
    assert sorted(capture_name(path, f) for f, _ in list_captures(path)) == ["day1/1.pcap", "day2/1.pcap"]
    got = read_frames(spark, path).select("capture_id").collect()
    assert sorted(r["capture_id"] for r in got) == ["day1/1.pcap", "day2/1.pcap"]


def test_a_file_elsewhere_is_an_error():
    with pytest.raises(ValueError):
        capture_name("/captures/a", "/captures/b/1.pcap")
