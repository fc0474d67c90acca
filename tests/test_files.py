"""Sources over real files: byte ranges of logs, logs that grow, and stores in their own layout."""

import hashlib
import pickle
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapweave.sources import files, logfiles, store
from snapweave.streaming import jobs


def lines_of(data: bytes) -> list[tuple[int, int, str]]:
    out, at = [], 0
    for part in data.split(b"\n"):
        end = at + len(part) + (at + len(part) < len(data))
        if end > at:
            out.append((at, end, part.decode()))
        at = end
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, rnd = tmp_path_factory.mktemp("logs"), random.Random(1)
    held = {"empty.log": b"", "nl.log": b"\n\n", "one.log": b"abc", "deep/archive-2024-01-02.003.log": b"a\nb\n"}
    for k in range(3):
        held[f"archive-2024-01-0{k + 1}.000.log"] = b"\n".join(f"{'x' * rnd.choice([0, 1, 5, 60, 3000])}é{i}".encode() for i in range(150)) + b"\n" * (k % 2)
    for name, data in held.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    (root / ".hidden").write_text("no\n")
    return str(root), held


@pytest.mark.parametrize("range_bytes", [97, 4096, 1 << 20])
def test_every_line_once_in_ranges(spark, folder, range_bytes):
    path, held = folder
    got = logfiles.numbered(logfiles.read_log_lines(spark, path, range_bytes)).collect()
    assert sorted((r.file, r.line_no, r.start, r.end, r.line) for r in got) == sorted((f, n, *x) for f, data in held.items() for n, x in enumerate(lines_of(data), 1))
    assert {r.file for r in got if not r.complete} == {f for f, data in held.items() if data and data[-1:] != b"\n"}


def test_ends_and_ranges_of_files(spark, folder):
    path, held = folder
    for n in (1, 3, 100, 5000):
        assert sorted((r.file, r.start, r.line) for r in logfiles.tail_of_files(spark, path, n).collect()) == sorted((f, a, line) for f, data in held.items() for a, _, line in lines_of(data)[-n:])
    for limits, low, high in (({"after": 900, "limit": 5000}, lambda s: 900, lambda s: 5900), ({"before": 7000, "limit": 3000}, lambda s: 4000, lambda s: 7000), ({"limit": 2500}, lambda s: s - 2500, lambda s: s)):
        want = {f: [x for x in lines_of(data) if x[0] >= low(len(data)) and x[1] <= high(len(data))] for f, data in held.items()}
        got = logfiles.range_of_files(spark, path, **limits).collect()
        assert sorted((r.file, r.start) for r in got) == sorted((f, a) for f, rows in want.items() for a, *_ in rows)
        assert all(r.has_more_before == (want[r.file][0][0] > 0) and r.has_more_after == (want[r.file][-1][1] < len(held[r.file])) for r in got)
    with pytest.raises(ValueError):
        logfiles.range_of_files(spark, path, after=1, before=2)


def test_only_what_is_asked_for_is_planned(folder):
    path, held = folder
    size = sum(len(d) for d in held.values())
    read = lambda **o: sum(r.high - r.low for r in logfiles._Reader({"path": path, **o}).partitions())
    assert read() == size and read(tail="2") < size / 10 and read(low="0", high="10") <= 10 * len(held) and read(back="10") <= 10 * len(held)


def test_small_ranges_share_partitions(folder, monkeypatch):
    path, held = folder
    files_held = [f for f, data in held.items() if data]
    assert sorted(r.file for r in logfiles._Reader({"path": path, "range_bytes": "97"}).partitions()) == sorted(files_held)
    monkeypatch.setattr(logfiles, "TASK", 300)
    reader = logfiles._Reader({"path": path, "range_bytes": "97"})
    assert {r.low % 291 for r in reader.partitions()} == {0}
    got = [tuple(row.values()) for own in reader.partitions() for batch in reader.read(own) for row in batch.select(["file", "part", "nth", "start", "line"]).to_pylist()]
    want, last = [], ()
    for name in sorted(files_held):
        for start, _, line in lines_of(held[name]):
            last = (name, start // 97, last[2] + 1 if last[:2] == (name, start // 97) else 0)
            want.append((*last, start, line))
    assert got == want


def test_small_ranges_read_each_byte_about_once(tmp_path, monkeypatch):
    own, read, real = tmp_path / "a.log", [], logfiles.filesystem
    own.write_bytes(b"".join(b"line %d\n" % k for k in range(200_000)))

    class Counted:
        def __init__(self, file):
            self.file, self.seek = file, file.seek

        def read(self, n):
            read.append(len(held := self.file.read(n)))
            return held

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

    class System:
        def __init__(self, system):
            self.get_file_info, self.open_input_file = system.get_file_info, lambda path: Counted(system.open_input_file(path))

    monkeypatch.setattr(logfiles, "filesystem", lambda path: (System(real(path)[0]), real(path)[1]))
    reader = logfiles._Reader({"path": str(own), "range_bytes": "4096"})
    assert sum(batch.num_rows for part in reader.partitions() for batch in reader.read(part)) == 200_000
    assert sum(read) < 1.2 * own.stat().st_size


def test_lines_that_are_not_utf8(tmp_path):
    (tmp_path / "a.log").write_bytes(b"good\n\xff\xfe bad\nlast \xc3")
    reader = logfiles._Reader({"path": str(tmp_path), "range_bytes": "4"})
    got = [tuple(row.values()) for own in reader.partitions() for batch in reader.read(own) for row in batch.select(["start", "end", "line", "complete"]).to_pylist()]
    assert got == [(0, 5, "good", True), (5, 12, "\ufffd\ufffd bad", True), (12, 18, "last \ufffd", False)]


def test_stream_of_files_that_grow(spark, tmp_path):
    logs, root = tmp_path / "logs", str(tmp_path / "root")
    logs.mkdir()
    follow = lambda: sorted((r.file, r.line) for r in jobs.run_available(jobs.stream_log_follow(spark, str(logs)), root).collect())
    (logs / "a.log").write_text("one\ntwo\nhal")
    assert follow() == [("a.log", "one"), ("a.log", "two")]
    (logs / "a.log").write_text("one\ntwo\nhalf\nfour\n")
    (logs / "b.log").write_text("long " * 50 + "\nzz")
    assert follow() == sorted([("a.log", x) for x in ("one", "two", "half", "four")] + [("b.log", "long " * 50)])
    assert len(follow()) == 5
    with (logs / "b.log").open("a") as file:
        file.write("\n\n")
    assert follow()[-2:] == [("b.log", "long " * 50), ("b.log", "zz")] and ("b.log", "") in follow()
    (logs / "a.log").write_text("new\n")  # rotated
    assert len(follow()) == 8


def test_stream_grows_while_it_runs(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("0\n1")
    query = jobs.stream_log_follow(spark, str(logs)).writeStream.format("memory").queryName("grown").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for k in range(1, 6):
            query.processAllAvailable()
            with (logs / "a.log").open("a") as file:
                file.write(f"{k}\n{k}")
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(r.line for r in spark.table("grown").collect()) == ["0", "11", "12", "23", "34", "45"]


def test_resources_named_by_hash(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(b"abc", "css"), (b"abc", "css"), (b"", "js"), (b"x" * 3_000_000, "image"), (None, "font")], "content binary, kind string")
    store.write_resource_files(rows, path)
    name = hashlib.sha256(b"abc").hexdigest()
    own = tmp_path / "store/resources" / name[:2] / name[2:4] / f"{name}.css"
    assert own.read_bytes() == b"abc"
    before = own.stat().st_mtime_ns
    store.write_resource_files(rows, path)
    got = store.read_resources(spark, path).collect()
    assert own.stat().st_mtime_ns == before and sorted(r.length for r in got) == [0, 3, 3_000_000]
    assert all(r.file_hash in r.file_path for r in got) and len(store.read_resources(spark, path, 100).collect()) == 2


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_resource_files(spark.createDataFrame([(b"kept", "js")], "content binary, kind string"), path)
    good = hashlib.sha256(b"good").hexdigest()
    rows = spark.createDataFrame([(f"resources/{good}.js", b"good"), ("resources/not-its-hash.js", b"bad")], "path string, content binary")
    with pytest.raises(Exception, match="has the hash"):
        files.write_files(rows, path, named_by_hash=True)
    assert [p.read_bytes() for p in (tmp_path / "store").rglob("*") if p.is_file()] == [b"kept"]


def test_parts_in_order_and_appended(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = spark.range(40).select(F.lit("x/a.log").alias("path"), (39 - F.col("id")).alias("part"), F.concat((39 - F.col("id")).cast("string"), F.lit("\n")).alias("content")).repartition(7)
    files.write_files(rows, path, existing="append")
    files.write_files(rows.where("part < 2"), path, existing="append")
    assert (tmp_path / "logs/x/a.log").read_text().split() == [*map(str, range(40)), "0", "1"]
    files.write_files(rows.where("part = 5"), path, existing="replace")
    assert (tmp_path / "logs/x/a.log").read_text() == "5\n"


def test_html_store_by_days(spark, tmp_path):
    path = str(tmp_path / "html-store")
    rows = spark.createDataFrame([("u", "2024-01-31 10:00:00", "<p>é"), ("u", "2024-02-01 00:00:00", "b"), ("v", "2024-02-01 00:00:00", "d"), ("u", "2024-03-05 00:00:00", "c")], "url string, at string, html string")
    store.write_html_files(rows.select("url", F.col("at").cast("timestamp_ntz").alias("captured_at"), "html"), path)
    got = store.read_html_files(spark, path, "2024-01-31", "2024-02-28").collect()
    assert sorted(r.html for r in got) == ["<p>é", "b", "d"] and all(r.html_path.startswith(f"html/{r.capture_date:%Y/%m/%d}/") for r in got)
    assert store.read_html_files(spark, path).count() == 4


def test_html_store_passes_no_names_through_the_driver(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "html-store")
    rows = spark.range(300).select(F.concat(F.lit("u"), "id").alias("url"), F.expr("timestamp_ntz'2024-01-31 10:00:00' + make_dt_interval(cast(id % 3 as int))").alias("captured_at"), F.when(F.col("id") > 0, F.col("id").cast("string")).alias("html"))
    store.write_html_files(rows, path)
    (tmp_path / "html-store/html/2024/01/31/_hidden.html").write_text("no")
    (tmp_path / "html-store/html/2024/01/31/other.txt").write_text("no")
    monkeypatch.setattr(files, "SHARE", 30)
    monkeypatch.setattr(files, "ROWS", 7)
    found = store.read_html_files(spark, path, "2024-01-31", "2024-02-01")
    assert found.inputFiles() == [] and found.rdd.getNumPartitions() == 8
    got = found.collect()
    assert sorted(r.html for r in got) == sorted(str(k) if k else "" for k in range(300) if k % 3 < 2)
    assert {(r.capture_date.isoformat(), r.html_path[:16]) for r in got} == {("2024-01-31", "html/2024/01/31/"), ("2024-02-01", "html/2024/02/01/")}
    assert len({r.html_path for r in got}) == 200 and store.read_html_files(spark, path).count() == 300
    assert store.read_html_files(spark, path, "2025-01-01", "2025-02-01").count() == 0 and store.read_html_files(spark, path, start="2024-02-02").count() == 100


def _batch(names):
    return pa.RecordBatch.from_pydict({"path": names, "part": [0] * len(names), "content": [n.encode() for n in names]})


def test_writers_messages_hold_no_names(tmp_path):
    (tmp_path / "kept").write_bytes(b"old")
    sizes = []
    for n in (1, 300):
        writer = files._Writer({"path": str(tmp_path)})
        message = writer.write(iter([_batch([f"{n}/{k}" for k in range(n)])]))
        sizes.append(len(pickle.dumps(message)))
        writer.commit([message])
    assert sizes[1] <= sizes[0] + 8
    assert sorted(p.name for p in tmp_path.iterdir()) == ["1", "300", "kept"] and len(list((tmp_path / "300").iterdir())) == 300


def test_aborted_job_takes_away_what_all_tasks_made(tmp_path):
    (tmp_path / "kept").write_bytes(b"old")
    writer = files._Writer({"path": str(tmp_path)})
    writer.write(iter([_batch(["a/1", "a/é\n", "kept"])]))  # its message is lost
    message = writer.write(iter([_batch(["b/1"])]))
    writer.abort([None, message])
    assert [(p.name, p.read_bytes()) for p in tmp_path.rglob("*") if p.is_file()] == [("kept", b"old")]
    assert not [p for p in tmp_path.iterdir() if p.name.startswith(".made")]
    files._Writer({"path": str(tmp_path)}).abort([])
