"""Lines, records, routing, archives and the job, on small literal inputs."""

import io
import random
import re
import tarfile

import pytest
from pyspark.sql import functions as F

from harrow.functions import rules
from harrow.functions.text import member_name
from harrow.operators import lines as L
from harrow.operators import members as M
from harrow.operators.records import assembled, record_counts
from harrow.plans.ingest import SCHEMAS, ingest
from harrow.plans.publish import Tables
from harrow.sources.archives import ArchiveError

HEAD = "2026-07-09 11:27:48.123 45672 "


def read(spark, out, name):
    return Tables(spark, out).read(name, SCHEMAS[name])


def put(path, files):
    path.parent.mkdir(parents=True, exist_ok=True)
    with tarfile.open(path, "w:xz") as t:
        for name, body in files:
            m = tarfile.TarInfo(name)
            m.size = len(body)
            t.addfile(m, io.BytesIO(body))


def test_headers_match_pythons_re(spark):
    python = re.compile(r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}[.,]\d{3,6})\s+(\d+)\s+(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|TRACE)\s+(\S+)\s+(?:\[[^\]]*\]\s+)?(.*)$")
    tails = ["INFO mod", "INFO mod ", "INFO mod [-]", "INFO mod [-] ", "INFO mod [-] [x] y", "WARN mod [open", "INFO mod a\rb", "INFO mod a\x85b c", "INFO\xa0mod\x1cm", "TRACE m\x1fx y", "BAD mod x"]
    lines = [HEAD + t for t in tails] + [" " + HEAD + "INFO mod x", "2026-07-09T11:27:48,123456 1 INFO m x", "2026-07-09 11:27:48.12 1 INFO m x", "٢٠٢٦-07-09 11:27:48.123 1 INFO m x"]
    rows = L.parsed(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no long, line string")).orderBy("line_no").collect()
    for line, r in zip(lines, rows):
        m = python.match(line)
        assert r.is_header == bool(m), line
        if m:
            assert (r.ts_text, r.module, r.text) == (m[1], m[4], m[5])


def test_impossible_values_are_null_or_fail(spark):
    bad = ["2026-13-01 00:00:00.000", "2026-02-30 00:00:00.000", "2026-01-01 00:00:60.000", "0000-01-01 00:00:00.000"]
    df = spark.createDataFrame([(i, f"{t} 99999999999 INFO m x") for i, t in enumerate(bad)], "line_no long, line string")
    assert all(r.timestamp is None and r.pid is None and r.is_header for r in L.parsed(df).collect())
    for t in bad:
        with pytest.raises(Exception):  # noqa: B017
            L.parsed(spark.createDataFrame([(0, f"{t} 1 INFO m x")], "line_no long, line string"), fail_fast=True).collect()


def test_routes_agree(spark):
    names = ["./.a/./var/log/nova/x.log", "a\\var\\log\\nova.LOG", "var/log/httpd/nova.log", "var/log/nova_access.log", "sos_commands/podman/ps", "sos_commands/kernel/uname", "sos_commands/x/var/log/cinder.log", "var/log/messages", "x/process_ss_list"]
    rows = [(n, s, r) for n in names for s, r in ((0, True), (1 << 20, True), ((1 << 20) + 1, True), (5, False))]
    df = spark.createDataFrame(rows, "name string, size long, is_reg boolean")
    got = df.withColumn("kind", M.route(member_name(F.col("name")), F.col("size"), F.col("is_reg"), 1 << 20)).collect()
    assert [r.kind for r in got] == [M.route_name(*r, 1 << 20) for r in rows]
    assert {r.kind for r in got} == {"log", "command", None}
    assert (M.size_limit(None), M.size_limit(0), M.size_limit(-1)) == (25 << 20, 1 << 20, 1 << 20)


#: Fixed values, spelled for themselves: a token, and the service and category that it gives.
CLASSES = """nova nova compute
cinder cinder storage
ovn ovn networking
openvswitch ovn networking
ovs ovn networking
neutron neutron networking
keystone keystone identity
glance glance image
placement placement placement
swift swift object-storage
heat heat orchestration
horizon horizon dashboard
ironic ironic baremetal
manila manila shared-filesystems
octavia octavia load-balancing
barbican barbican key-management
ceilometer ceilometer telemetry
gnocchi gnocchi telemetry
aodh aodh telemetry
tripleo tripleo deployment
director tripleo deployment
podman podman container-runtime
container podman container-runtime"""
COMMAND_TOKENS = ["ip_", "ip-", "ip.", "hostname", "systemctl", "ss_", "ss-"]


def test_each_rule_and_token(spark):
    expected = [x.split() for x in CLASSES.split("\n")]
    df = spark.createDataFrame([(f"X.{t.upper()}.y", "z/q") for t, _, _ in expected] + [("else", "q")], "module string, source_file string")
    assert [(r.service, r.category) for r in rules.enrich(df, "module").collect()] == [(s, c) for _, s, c in expected] + [("unknown", "unknown")]
    assert rules.command_tokens() == sorted(t for t, _, _ in expected) + COMMAND_TOKENS
    for token in [t for t, _, _ in expected] + COMMAND_TOKENS:
        assert M.route_name(f"sos_commands/{token}", 1, True, 9) == "command"
    # of several rules the first decides, wherever its token stands
    both = [(a[0], b[0], min(i, j)) for i, a in enumerate(expected) for j, b in enumerate(expected)]
    got = rules.enrich(spark.createDataFrame([x[:2] for x in both], "module string, source_file string"), "module").collect()
    assert [(r.service, r.category) for r in got] == [tuple(expected[k][1:]) for _, _, k in both]


def test_tags(spark):
    rows = [("podman", "x"), ("ovn", "x"), ("networking", "x"), ("compute", "x"), ("storage", "x"), ("tripleo", "x"), ("swift", "x"), ("else", "x")]
    got = [r.tags for r in rules.enrich(spark.createDataFrame(rows, "module string, source_file string"), "module").collect()]
    assert got == [
        "containerized,openstack,podman,rhosp17", "networking,openstack,ovn,rhosp17", "networking,openstack,rhosp17", "compute,openstack,rhosp17",
        "openstack,rhosp17,storage", "openstack,rhosp17,tripleo", "openstack,rhosp17,storage,swift", "openstack,rhosp17",
    ]


@pytest.mark.parametrize("span", [1, 3, 7, 1000])
def test_records_by_ranges_equal_whole_members(spark, span):
    rng, lines = random.Random(span), []
    for member in range(12):
        for n in range(rng.choice([1, 5, 40, 200])):
            text = rng.choice(["trace", "  x", HEAD + "INFO m a", HEAD + "WARN n b"]) if member % 4 else rng.choice(["only", "folded"])
            if rng.random() < 0.9:  # blank lines are gone already
                lines.append((f"p{member // 3}", member, "r", "f", n, f"{text} {n}"))
    parsed = L.parsed(spark.createDataFrame(lines, "path string, member_idx int, report_name string, source_file string, line_no long, line string").repartition(5))
    whole, parts = (sorted(map(tuple, assembled(parsed, span=s).collect()), key=str) for s in (None, span))
    assert whole == parts and len(whole) > 12
    counted = {r.member_idx: r.n_rows for r in record_counts(parsed).collect()}
    assert counted == {m: sum(r[1] == m for r in whole) for m in counted}


def test_a_large_member_is_worked_on_in_ranges(spark):
    lines = spark.range(50_000).select(F.lit("p").alias("path"), F.lit(0).alias("member_idx"), F.lit("r").alias("report_name"), F.lit("f").alias("source_file"), F.col("id").alias("line_no"), F.concat(F.lit(HEAD + "INFO m "), "id").alias("line"))
    records = assembled(L.parsed(lines), span=1000)
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert records.agg(F.countDistinct("message"), F.max("rec")).first() == (50_000, 50_000)
    of_lines = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "line_no" not in x]
    assert of_lines and any("_range" in x for x in of_lines)


def test_ingest_end_to_end(spark, tmp_path):
    trace = b"Traceback (most recent call last):\n  \n  File x\n\nError: end\n"
    put(tmp_path / "in/a.tar.xz", [
        ("./var/log/containers/nova-compute.log", b"orphan\n" + (HEAD + "INFO nova.compute.manager [-] VM spawning failed\n").encode() + (HEAD + "WARN ovn-controller [-] lost\r\n").encode() + trace),
        ("var/log/nova/blank.log", b"\n\n"), ("sos_commands/containers/podman_ps", b"CONTAINER ID\n\xff"), ("var/log/nova/empty.log", b""),
    ])
    put(tmp_path / "in/sub/_b.tar.xz", [("etc/none", b"x")])
    out = str(tmp_path / "out")
    stats = {r.report_name: r for r in ingest(spark, str(tmp_path / "in"), out).collect()}
    assert tuple(stats[None])[1:] == (2, 2, 3, 1, 1, 0) and tuple(stats["_b.tar.xz"])[1:] == (1, 0, 0, 0, 0, 0)
    logs = {r.module: r for r in read(spark, out, "os_logs").collect()}
    assert logs["unknown"].timestamp is None and logs["unknown"].level == "UNKNOWN" and logs["unknown"].message == "orphan"
    w = logs["ovn-controller"]
    assert w.level == "WARNING" and w.message == "lost\nTraceback (most recent call last):\n  \n  File x\nError: end"
    assert (w.service, w.category, w.tags) == ("nova", "compute", "compute,containerized,networking,nova,openstack,rhosp17")
    c = read(spark, out, "os_commands").first()
    assert c.command == "podman_ps" and c.output == "CONTAINER ID\n�" and c.service == "podman"
    first = ingest(spark, str(tmp_path / "in"), out)
    assert read(spark, out, "os_logs").count() == 6
    ingest(spark, str(tmp_path / "in"), out, overwrite=True).collect()
    assert read(spark, out, "os_logs").count() == 3 and read(spark, out, "os_commands").count() == 1
    assert {r.report_name: r for r in first.collect()} == stats  # later runs don't change counters


def test_command_line_and_default_target(spark, tmp_path, capsys, monkeypatch):
    from harrow.plans.ingest import default_out, main

    put(tmp_path / "SOS_REPORTS/my report #1%20.tar.xz", [("var/log/nova/a.log", (HEAD + "INFO m x\n").encode())])
    (tmp_path / "SOS_REPORTS/bad.tar.xz").write_bytes(b"broken")
    monkeypatch.chdir(tmp_path)
    main(["--clear-existing", "--on-corrupt", "quarantine"])
    assert "my report #1%20.tar.xz" in capsys.readouterr().out
    assert read(spark, str(tmp_path / "harrow_tables"), "os_logs").first().report_name == "my report #1%20.tar.xz"
    assert [default_out(x) for x in ("/in", "in", "a/in/", "s3://b/in")] == ["/harrow_tables", "./harrow_tables", "a/harrow_tables", "s3://b/harrow_tables"]
    put(tmp_path / "t/x.tar.xz", [("var/log/nova/a.log", b"2026-13-01 00:00:00.000 1 INFO m x\n")])
    with pytest.raises(Exception):  # noqa: B017
        main(["--reports-dir", "t", "--out", "f", "--fail-fast"])


def test_missing_empty_and_corrupt(spark, tmp_path):
    with pytest.raises(ArchiveError):
        ingest(spark, str(tmp_path / "none"))
    (tmp_path / "e").mkdir()
    with pytest.raises(ArchiveError):
        ingest(spark, str(tmp_path / "e"))
    (tmp_path / "e/x.tar.xz").write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017
        ingest(spark, str(tmp_path / "e"), str(tmp_path / "o"))
    counted = {r.report_name: r for r in ingest(spark, str(tmp_path / "e"), str(tmp_path / "o2"), on_corrupt="skip").collect()}
    assert counted["x.tar.xz"].corrupt_archives == counted[None].corrupt_archives == 1 and counted[None].log_rows == 0
