"""Byte ranges: what comes back, and how little is read for it."""

import json
import os

import pytest

from lodestone.sources import byte_ranges as br


def test_ranges_of_files(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    contents = {"a b.bin": bytes(range(256)) * 40, "short": b"xyz", "empty": b""}
    for name, data in contents.items():
        (folder / name).write_bytes(data)
    for start, n in ((0, 4), (5, 300), (-2, 2), (-5, 3), (-400, 10), (2, 0), (10_239, 5), (20_000, 7), (0, 10**9)):
        got = {os.path.basename(r.path): (r.length, r.start, r.bytes) for r in br.read_range(spark, str(folder), start, n).collect()}
        want = {}
        for name, data in contents.items():
            first = min(start, len(data)) if start >= 0 else max(len(data) + start, 0)
            want[name] = (len(data), first, data[first : first + n])
        assert got == want
    blocks = br.read_range(spark, f"{folder}/a*", 10, 1_000, block=300).orderBy("start").collect()
    assert [r.start for r in blocks] == [10, 310, 610, 910] and b"".join(r.bytes for r in blocks) == contents["a b.bin"][10:1_010]
    assert {r.bytes for r in br.footer(spark, f"{folder}/short").collect()} == {b"xyz"}
    with pytest.raises(FileNotFoundError):
        br.read_range(spark, str(tmp_path / "none"), 0, 1)


def test_ten_bytes_of_a_large_file_read_less_than_a_block(tmp_path):
    """A task's own reads, as the kernel counts them."""
    path = tmp_path / "large"
    with open(path, "wb") as f:
        f.truncate(1 << 30)
        f.seek(700_000_000)
        f.write(b"0123456789")
    reader = br.RangeReader({"files": json.dumps([[f"file://{path}", 1 << 30]]), "start": "700000000", "bytes": "10"})
    (part,) = reader.partitions()
    next(reader.read(part))  # what the first use of the file system reads itself

    def taken() -> int:
        with open("/proc/self/io") as f:
            return int(f.readline().split()[1])

    before = taken()
    (batch,) = reader.read(part)
    assert batch.column("bytes")[0].as_py() == b"0123456789" and taken() - before < 65_536
