"""Publishing, sources and counters: what a target holds whatever writes to it, and in which order."""

import codecs
import io
import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from harrow import queries
from harrow.operators import stats
from harrow.plans import ingest as I
from harrow.plans.publish import Tables
from harrow.sources import archives as A
from harrow.sources.files import DriverFiles
from harrow.streaming import arrivals as S
from harrow.streaming.arrivals import batch_run, ingest_arrivals
from tests.test_ingest import HEAD, put, read

def log(name, text="INFO m x"):
    return (f"var/log/nova/{name}.log", (HEAD + text + "\n").encode())


def names(spark, out, table="os_logs"):
    return sorted(r.report_name for r in read(spark, out, table).collect())


def rows(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("x"))


# -- Publishing ------------------------------------------------------------------------------------------------------


def test_a_rebuild_is_seen_as_a_whole(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    schema = rows(spark, 1).schema
    assert t.read("a", schema).count() == 0
    assert t.write("one", {"a": rows(spark, 5), "b": rows(spark, 1)}) and t.write("two", {"a": rows(spark, 2)})
    reader, before = t.read("a", schema), t.version()  # planned before the rebuild
    assert t.write("three", {"a": rows(spark, 3)}, overwrite=True)
    assert reader.count() == 7 and t.read("a", schema, before).count() == 7
    assert t.read("a", schema).count() == 3 and t.read("b", schema).count() == 0
    assert not t.write("two", {"a": rows(spark, 2)})  # known, though it doesn't count any more
    t.write("four", {"a": rows(spark, 1)})
    assert t.read("a", schema).count() == 4 and not (tmp_path / "t/_runs/one").exists()


def test_a_run_counts_once_and_a_broken_one_not_at_all(spark, tmp_path):
    t = Tables(spark, str(tmp_path / "t"))
    schema = rows(spark, 1).schema
    broken = rows(spark, 5).select(F.when(F.col("x") == "3", F.raise_error(F.lit("broken"))).otherwise(F.col("x")).alias("x"))
    with pytest.raises(Exception):  # noqa: B017
        t.write("r", {"a": rows(spark, 5), "b": broken})
    assert t.read("a", schema).count() == 0
    assert t.write("r", {"a": rows(spark, 5), "b": rows(spark, 2)}) and not t.write("r", {"a": rows(spark, 5)})
    assert t.read("a", schema).count() == 5 and t.read("b", schema).count() == 2
    rows(spark, 1).write.parquet(t.folder("left", "a"))
    assert t.clean() == [] and t.clean(0, lambda: 1e12) == ["left"] and t.read("a", schema).count() == 5


def test_of_two_runs_that_publish_at_once_both_count(spark, tmp_path, monkeypatch):
    t, other = Tables(spark, str(tmp_path / "t")), Tables(spark, str(tmp_path / "t"))
    for run in ("one", "two"):
        rows(spark, 2).write.parquet(t.folder(run, "a"))
    create, raced = DriverFiles.create_new, []

    def slow(self, path, data):
        if not raced:
            raced.append(path)
            other.publish("two", ["a"])
        return create(self, path, data)

    monkeypatch.setattr(DriverFiles, "create_new", slow)
    assert t.publish("one", ["a"])
    assert t.read("a", rows(spark, 1).schema).count() == 4 and t.version()["number"] == 2
    assert not t.files.create_new(raced[0], b"again") and json.loads(t.files.read(raced[0]))["number"] == 1


def test_publishing_takes_the_same_calls_for_any_number_of_files(spark, tmp_path, monkeypatch):
    calls = []
    for name in ("names", "read", "create_new", "delete", "exists", "changed"):
        monkeypatch.setattr(DriverFiles, name, lambda self, *a, f=getattr(DriverFiles, name), n=name: (calls.append(n), f(self, *a))[1])
    seen = []
    for files in (1, 40):
        t = Tables(spark, str(tmp_path / f"t{files}"))
        t.write("one", {"a": rows(spark, 100).repartition(files)})
        t.write("two", {"a": rows(spark, 100).repartition(files)}, overwrite=True)
        seen.append(list(calls))
        calls.clear()
    assert seen[0] == seen[1]


def test_compacting_changes_nothing_but_files(spark, tmp_path):
    t, schema = Tables(spark, str(tmp_path / "t")), rows(spark, 1).schema
    for i in range(4):
        t.write(f"r{i}", {"a": rows(spark, i)})
    t.compact("all", {"a": schema})
    assert t.paths("a") == [t.folder("all", "a")] and t.read("a", schema).count() == 6
    assert not t.write("r2", {"a": rows(spark, 2)}) and t.read("a", schema).count() == 6


# -- The job and the stream ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("stream_first", [True, False])
def test_job_and_stream_share_a_target(spark, tmp_path, stream_first):
    put(tmp_path / "job/a.tar.xz", [log("a")])
    put(tmp_path / "in/my report.tar.xz", [log("b")])
    (tmp_path / "in/broken.tar.xz").write_bytes(b"broken")
    out = str(tmp_path / "out")

    def stream():
        ingest_arrivals(spark, str(tmp_path / "in"), out, str(tmp_path / "c")).awaitTermination()

    def job():
        I.ingest(spark, str(tmp_path / "job"), out)

    for step in (stream, job) if stream_first else (job, stream):
        step()
    assert names(spark, out) == ["a.tar.xz", "my report.tar.xz"] and names(spark, out, "os_quarantine") == ["broken.tar.xz"]
    assert {r.report_name: r.corrupt_archives for r in read(spark, out, "ingest_counters").collect() if r.corrupt_archives} in ({None: 1, "broken.tar.xz": 1},)
    put(tmp_path / "in/x/b.tar.xz", [log("c")])
    stream()
    stream()
    assert names(spark, out) == ["a.tar.xz", "b.tar.xz", "my report.tar.xz"]
    # the batch is repeated, as if the stream had died between publishing and its own commit
    number = max(int(f.name) for f in (tmp_path / "c/commits").iterdir() if f.name.isdigit())
    for f in (tmp_path / "c/commits").iterdir():
        if f.name.lstrip(".").split(".")[0] == str(number):
            f.unlink()
    stream()
    assert names(spark, out) == ["a.tar.xz", "b.tar.xz", "my report.tar.xz"]
    assert batch_run(str(tmp_path / "c"), number) in Tables(spark, out).version()["runs"]
    assert not (tmp_path / "out/_work").exists() or not any((tmp_path / "out/_work").iterdir())


def test_a_batch_of_many_archives_takes_few_tasks(spark, tmp_path, monkeypatch):
    for k in range(20):
        put(tmp_path / f"in/{k}.tar.xz", [log("a")])
    tasks, run = [], S.ingest_archives
    monkeypatch.setattr(S, "ingest_archives", lambda tables, df, *a: tasks.append(df.rdd.getNumPartitions()) or run(tables, df, *a))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # less than a file counts for
    try:
        ingest_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert names(spark, str(tmp_path / "out")) == sorted(f"{k}.tar.xz" for k in range(20)) and max(tasks) <= spark.sparkContext.defaultParallelism


def test_a_failed_job_leaves_nothing_behind(spark, tmp_path):
    put(tmp_path / "in/a.tar.xz", [log("a")])
    (tmp_path / "in/b.tar.xz").write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017
        I.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert read(spark, str(tmp_path / "out"), "os_logs").count() == 0 and not any((tmp_path / "out/_work").iterdir())


def test_what_could_be_read_of_a_cut_archive_is_kept(spark, tmp_path):
    noise = random.Random(1).randbytes(200_000)
    put(tmp_path / "in/a.tar.xz", [log("a"), ("var/log/nova/noise.bin", noise), log("b")])
    whole = (tmp_path / "in/a.tar.xz").read_bytes()
    (tmp_path / "in/a.tar.xz").write_bytes(whole[: len(whole) // 2])
    I.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), on_corrupt="quarantine")
    q = read(spark, str(tmp_path / "out"), "os_quarantine").collect()
    assert names(spark, str(tmp_path / "out")) == ["a.tar.xz"] and len(q) == 1 and q[0].error and "after member" in q[0].message


def test_counters_equal_with_and_without_metrics(spark, tmp_path, monkeypatch):
    put(tmp_path / "in/a.tar.xz", [log("a"), log("b", "INFO m x\nrest\n" + HEAD + "INFO m y"), ("sos_commands/podman/ps", b"x"), ("var/log/nova/blank.log", b"\n")])
    put(tmp_path / "in/x/a.tar.xz", [log("c")])
    put(tmp_path / "in/y/none.tar.xz", [("etc/x", b"y")])
    (tmp_path / "in/y/bad.tar.xz").write_bytes(b"")
    taken = [sorted(map(tuple, I.ingest(spark, str(tmp_path / "in"), str(tmp_path / "o1"), on_corrupt="skip").collect()), key=str)]
    monkeypatch.setattr(stats, "MOST_OBSERVED", 1)
    taken.append(sorted(map(tuple, I.ingest(spark, str(tmp_path / "in"), str(tmp_path / "o2"), on_corrupt="skip").collect()), key=str))
    assert taken[0] == taken[1] == sorted([("a.tar.xz", 2, 4, 4, 1, 1, 0), ("none.tar.xz", 1, 0, 0, 0, 0, 0), ("bad.tar.xz", 1, 0, 0, 0, 0, 1), (None, 4, 4, 4, 1, 1, 1)], key=str)


def test_sql_by_name(spark, tmp_path):
    """One report with three members, and downstream statements as a user writes them."""
    head = "2026-07-09 11:27:{} {}\n"
    trace = 'Traceback (most recent call last):\n  File "/tmp/test.py", line 1, in <module>\n    raise RuntimeError(\'boom\')\nRuntimeError: boom\n'
    first = head.format("48.123 45672", "INFO nova.compute.manager [-] VM spawning failed") + head.format("49.001 45673", "ERROR cinder.volume.manager [-] Volume failed") + head.format("50.002 45674", "WARNING ovn-controller [-] OVN northd updated") + trace
    put(tmp_path / "SOS_REPORTS/sample-report.tar.xz", [
        ("var/log/containers/nova-compute.log", first.encode()), ("var/log/containers/cinder-volume.log", head.format("49.001 45673", "ERROR cinder.volume.manager [-] Volume failed").encode()),
        ("sos_commands/containers/podman_ps", b"CONTAINER ID   IMAGE   COMMAND\nabc123   quay.io/centos/centos:stream9   /bin/bash\n"),
    ])
    run = lambda: I.ingest(spark, str(tmp_path / "SOS_REPORTS"), str(tmp_path / "out dir"), overwrite=True, database="reports")
    try:
        for _ in range(2):  # declared, and pointed to the rebuilt tables
            run()
            sql = lambda q: [tuple(r) for r in spark.sql(q).collect()]
            assert sql("SELECT COUNT(*) FROM reports.os_logs") == [(4,)]
            assert sql("SELECT message FROM reports.os_logs WHERE module = 'nova.compute.manager' ORDER BY timestamp DESC LIMIT 1") == [("VM spawning failed",)]
            message = sql("SELECT message FROM reports.os_logs WHERE module = 'ovn-controller' LIMIT 1")[0][0]
            assert message == "OVN northd updated\n" + trace.rstrip("\n")
            assert [r.col_name for r in spark.sql("DESCRIBE reports.os_logs").collect()] == I.OS_LOGS.names
            assert sql("SELECT service, category, tags, rhosp_version FROM reports.os_logs WHERE module = 'nova.compute.manager' LIMIT 1") == [("nova", "compute", "compute,containerized,nova,openstack,rhosp17", "17.x")]
            assert sql("SELECT COUNT(*) FROM reports.os_commands") == [(1,)]
            assert "CONTAINER ID" in sql("SELECT output FROM reports.os_commands WHERE source LIKE '%podman_ps%' LIMIT 1")[0][0]
            assert sql("SELECT COUNT(*) FROM reports.os_quarantine") == [(0,)]
        I.ingest(spark, str(tmp_path / "SOS_REPORTS"), str(tmp_path / "out dir"), database="reports")
        assert sql("SELECT COUNT(*) FROM reports.os_logs") == [(8,)]
    finally:
        spark.sql("DROP DATABASE IF EXISTS reports CASCADE")


# -- Sources ---------------------------------------------------------------------------------------------------------


def test_data_source(spark, tmp_path):
    A.register(spark)
    put(tmp_path / "in/a.tar.xz", [log("a"), ("sos_commands/podman/ps", b"x"), ("etc/none", b"y")])
    put(tmp_path / "in/x/_b.tar.xz", [log("b")])
    read_ = lambda columns=None, **o: (spark.read.schema(columns) if columns else spark.read).format(A.FORMAT).options(**o).load(str(tmp_path / "in"))
    assert sorted((r.report_name, r.kind, bytes(r.body)) for r in read_().collect()) == [("_b.tar.xz", "log", log("b")[1]), ("a.tar.xz", "command", b"x"), ("a.tar.xz", "log", log("a")[1])]
    assert sorted((r.name, r.kind) for r in read_("name string, kind string", every="true").collect())[0] == ("etc/none", None)
    assert [(r.line_no, r.line) for r in read_(content="lines").filter("kind = 'log' and report_name = 'a.tar.xz'").orderBy("line_no").collect()] == [(-1, None), (0, HEAD + "INFO m x")]
    (tmp_path / "in/bad.tar.xz").write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017
        read_().collect()
    # archives that filters rule out aren't opened, and commands aren't taken out for logs
    assert read_().filter("report_name in ('a.tar.xz', '_b.tar.xz')").count() == 3
    assert [r.kind for r in read_(onCorrupt="quarantine").filter("kind = 'corrupt'").collect()] == ["corrupt"]
    assert read_(onCorrupt="quarantine").filter("kind = 'log'").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        read_("other string").collect()


def test_filters_reach_the_reader(tmp_path):
    put(tmp_path / "in/a.tar.xz", [log("a")])
    put(tmp_path / "in/b.tar.xz", [log("a")])
    reader = A.ArchiveReader(str(tmp_path / "in"), A.Scan(1 << 20))
    left = list(reader.pushFilters([A.EqualTo(("kind",), "log"), A.In(("report_name",), ("b.tar.xz", "c")), A.EqualTo(("size",), 3)]))
    assert [f.attribute for f in left] == [("size",)] and reader.of.kinds == {"log"}
    assert [p.paths for p in reader.partitions()] == [[str(tmp_path / "in/b.tar.xz")]]


def test_listing_by_tasks(spark, tmp_path):
    for path in ("a", "x/b", "x/y/c", "x/y/z/_d", "x/y/z/w/.e", "v w/%20#f"):
        put(tmp_path / f"in/{path}.tar.xz", [log("a")])
    put(tmp_path / "in/x/other.tar", [log("a")])
    (tmp_path / "in/empty").mkdir()
    plain = A.list_archives(str(tmp_path / "in"))
    assert len(plain) == 6
    for deep in (1, 2, 3):
        found = A.listed(spark, str(tmp_path / "in"), deep).collect()
        assert sorted(r.path for r in found) == plain and all(r.bytes > 0 for r in found)


def test_archives_are_copied_by_tasks(spark, tmp_path, monkeypatch):
    bodies = {"a.tar.xz": random.Random(2).randbytes(2 * A.BLOCK + 5), "v w%20#.tar.xz": b"x", "none.tar.xz": b""}
    (tmp_path / "in").mkdir()
    for name, body in bodies.items():
        (tmp_path / "in" / name).write_bytes(body)
    copied = A.copy_archives(A.listed(spark, str(tmp_path / "in")), str(tmp_path / "to/more"), 2).collect()
    assert {r.path: r.bytes for r in copied} == {str(tmp_path / "to/more" / n): len(b) for n, b in bodies.items()}
    assert {f.name: f.read_bytes() for f in (tmp_path / "to/more").iterdir()} == bodies
    # none of a query's archives goes through the driver
    through, read_, create = [], DriverFiles.read, DriverFiles.create_new
    monkeypatch.setattr(DriverFiles, "read", lambda self, path: through.append(path) or read_(self, path))
    monkeypatch.setattr(DriverFiles, "create_new", lambda self, path, data: through.append(path) or create(self, path, data))
    found = {(r.table_name, r.report_name): r.n for r in queries.shared_target(spark, "/root/testdata/sf0.001").collect()}
    assert found["os_quarantine", "broken.tar.xz"] == 1 and any(n % 2 == 0 for (_, r), n in found.items() if r.startswith("docs-"))
    assert [p.rsplit("/", 1)[-1] for p in through if p.endswith(".tar.xz")] == ["broken.tar.xz"]


def test_lines_equal_an_incremental_decoder():
    rng = random.Random(3)
    bits = [b"\n", b"\r\n", b"a", "é".encode(), "日本".encode(), b"\xff", b"\xe2\x82", b"\xf0\x9f", b"", b"\x00", "\x85 ".encode()]
    for _ in range(300):
        data = b"".join(rng.choices(bits, k=rng.randrange(30)))
        expected = [x.rstrip("\r\n") for x in codecs.iterdecode(io.BytesIO(data), "utf-8", "replace")]
        for block in (1, 2, 3, 7, 100):
            found = [x for some in A.decoded_lines(io.BytesIO(data), block) for x in some]
            assert [x.rstrip("\r") for x in found] == expected, data


def test_small_members_share_batches(tmp_path):
    files = [f for k in range(300) for f in (log(k, f"INFO m {k}\nrest"), (f"sos_commands/podman/{k}", b"x\ny"))]
    put(tmp_path / "a.tar.xz", files)
    put(tmp_path / "many.tar.xz", [("var/log/nova/many.log", b"ab\n" * 1_500_000), log("last")])
    batches = list(A.scan(str(tmp_path / "a.tar.xz"), A.Scan(1 << 20, lines=True)))
    found = [(r["name"], r["line_no"], r["line"]) for b in batches for r in b.to_pylist()]
    assert len(batches) == 1 and len(found) == 300 * 5
    assert found[-5:] == [("var/log/nova/299.log", -1, None), ("var/log/nova/299.log", 0, HEAD + "INFO m 299"), ("var/log/nova/299.log", 1, "rest"), ("sos_commands/podman/299", -1, None), ("sos_commands/podman/299", 0, "x\ny")]
    # a large member doesn't wait for its end, and its lines stay in order
    batches = list(A.scan(str(tmp_path / "many.tar.xz"), A.Scan(25 << 20, lines=True)))
    assert max(b.num_rows for b in batches) < A.BLOCK and len(batches) > 2
    assert [n for b in batches for n in b.column("line_no").to_pylist()] == [*range(-1, 1_500_000), -1, 0]


def test_members_far_above_a_block_are_read_as_lines(spark, tmp_path):
    line = HEAD + "INFO m " + "x" * 100 + "\n"
    put(tmp_path / "in/a.tar.xz", [("var/log/nova/big.log", line.encode() * 60_000), ("var/log/nova/cut.log", b"abc\n" + line.encode() + b"\xe2\x82")])
    out = str(tmp_path / "out")
    I.ingest(spark, str(tmp_path / "in"), out, max_mb=65)
    found = {(r.source_file, r.message) for r in read(spark, out, "os_logs").collect()}
    assert found == {("var/log/nova/big.log", "x" * 100), ("var/log/nova/cut.log", "abc"), ("var/log/nova/cut.log", "x" * 100 + "\n�")}
    assert read(spark, out, "os_logs").count() == 60_002
    shutil.rmtree(tmp_path / "in")
