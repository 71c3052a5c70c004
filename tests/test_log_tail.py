import json

import pytest

from corvane.sources import log_tail as L

SHAPE = "id bigint, text string"


def line(n, text="x"):
    return json.dumps({"id": n, "text": text * (n % 7)}, ensure_ascii=False) + "\n"


def run(spark, tmp_path, part_bytes=L.PART_BYTES):
    L.follow(spark, str(tmp_path / "logs"), SHAPE, f"file://{tmp_path}/out", "app.log", part_bytes).awaitTermination()
    good = [r.id for r in spark.read.parquet(f"{tmp_path}/out/good").collect()]
    return sorted(good), sorted(r.line for r in spark.read.parquet(f"{tmp_path}/out/bad").collect())


def test_each_line_is_read_once_over_restarts_and_rotations(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "other").write_text(line(99))
    app = logs / "app.log"
    app.write_text("".join(line(n, "é") for n in range(40)) + 'not json\n\n[1]\n{"id": 40, ')
    bad = ["[1]", "not json"]
    assert run(spark, tmp_path, 100) == (list(range(40)), bad)
    # The line that was being written ends, the file is rotated, and a new one begins.
    with app.open("a") as file:
        file.write('"text": "t"}\n')
    app.rename(logs / "app.log.1")
    app.write_text(line(41) + line(42))
    assert run(spark, tmp_path) == (list(range(43)), bad)
    app.rename(logs / "app.log.2")
    app.write_bytes(line(43).encode() + b'{"id": 44, "text": "\xff"}\n')
    assert run(spark, tmp_path) == (list(range(45)), bad)
    assert run(spark, tmp_path) == (list(range(45)), bad)


def lines(reader, start, end):
    return [(r["offset"], r["line"]) for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]


@pytest.mark.parametrize("part_bytes", [1, 2, 7, 64, 1000])
def test_ranges_share_lines_without_gaps(tmp_path, monkeypatch, part_bytes):
    monkeypatch.setattr(L, "BLOCK_BYTES", 5)
    text = "first\n\nsecond line\nä third\n" + "w" * 50 + "\nlast\nunfinished"
    (tmp_path / "a").write_text(text)
    reader = L._Reader(str(tmp_path), "", part_bytes)
    want, at = [], 0
    for row in text.encode().split(b"\n")[:-1]:
        if row:
            want.append((at, row.decode()))
        at += len(row) + 1
    end = reader.latestOffset()
    assert list(end.values()) == [at] and lines(reader, {}, end) == want
    cut = dict.fromkeys(end, want[2][0])
    assert lines(reader, {}, cut) + lines(reader, cut, end) == want


def test_absent_empty_and_equal_files(tmp_path):
    assert L._Reader(str(tmp_path / "none"), "", 10).latestOffset() == {}
    reader = L._Reader(str(tmp_path), "", 10)
    (tmp_path / "a").write_text("")
    (tmp_path / "b").write_text("no end")
    assert reader.latestOffset() == {}
    (tmp_path / "a").write_text("same\n1\n")
    planned = reader.partitions({}, reader.latestOffset())
    (tmp_path / "a").rename(tmp_path / "c")
    (tmp_path / "a").write_text("new\n")
    assert [r["line"] for b in reader.read(planned[0]) for r in b.to_pylist()] == ["same", "1"]
    (tmp_path / "b").write_text("same\n2\n")
    with pytest.raises(ValueError, match="same line"):
        reader.latestOffset()
