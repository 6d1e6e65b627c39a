"""Registered queries over the given tables, and the SQL for each, written on its own.

Inputs are derived from events (log lines), documents (members and archives) by expressions that both engines share.
A file's lines are bounded: a file is one of 16 sources of a stretch of 4096 events.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.functions import rules
from harrow.functions.text import member_name
from harrow.operators import lines as L
from harrow.operators import members as M
from harrow.operators.records import assembled, record_counts
from harrow.operators.stats import ingest_stats
from harrow.plans import tables as T
from harrow.plans.ingest import ingest
from harrow.plans.publish import Tables
from harrow.schemas import OS_COMMANDS, OS_LOGS, QUARANTINE
from harrow.sources.archives import FORMAT, LINES, copy_archives, listed, register, write_archives
from harrow.sources.files import DriverFiles
from harrow.streaming.arrivals import ingest_arrivals

LIMIT = M.size_limit(None)
MODULES = "nova.compute.manager cinder.volume.manager ovn-controller keystone.auth neutron.agent oslo.service glance.api placement.wsgi swift.proxy heat.engine horizon.ui ironic.conductor manila.share octavia.worker barbican.api ceilometer.agent gnocchi.metricd aodh.evaluator tripleo.deploy podman.events director.ui openvswitch.db my.module containerd.shim".split()
SOURCES = ["var/log/containers/nova/nova-compute.log", "var/log/neutron/server.log", "var/log/messages.log", "sosreport/var/log/containers/keystone/keystone.log"]
PREFIXES = ["./sosreport-h/", "", "./", "sosreport-nova-0/"]
PATHS = "var/log/containers/nova/nova-compute.log var/log/neutron/server.LOG var/log/containers/httpd/nova_access.log var/log/messages sos_commands/podman/podman_ps sos_commands/networking/ip_addr sos_commands/kernel/uname var/log/containers/keystone/keystone.log sos_commands/openstack/var/log/cinder.log".split()


def _pick(values: list[str], index: str, sql: bool) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"(list_value({listed}))[CAST({index} AS INTEGER) + 1]" if sql else f"element_at(array({listed}), cast({index} as int) + 1)"


def _lines(sql: bool) -> str:
    """The derived log lines, for DuckDB with sql and else for Spark."""
    text = (lambda x: f"CAST({x} AS VARCHAR)") if sql else (lambda x: f"cast({x} as string)")
    stamp = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')" if sql else "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    stamp = f"CASE WHEN event_id % 4 = 1 THEN replace(replace(substr({stamp}, 1, 23), ' ', 'T'), '.', ',') ELSE {stamp} END"
    div = "event_id // 4096" if sql else "event_id div 4096"
    return f"""
    SELECT {text('user_id % 16')} || '-' || {text(div)} AS path, CAST(user_id % 16 AS INTEGER) AS member_idx, 'report-' || {text('user_id % 5')} || '.tar.xz' AS report_name,
      {_pick(SOURCES, 'user_id % 4', sql)} AS source_file, CAST(event_id AS BIGINT) AS line_no,
      CASE WHEN event_type = 'signup' THEN '  File "x.py", line ' || {text('user_id')}
        WHEN event_type = 'view' AND event_id % 7 = 0 THEN ''
        ELSE {stamp} || ' ' || {text('user_id')} || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END || ' '
          || {_pick(MODULES, f'event_id % {len(MODULES)}', sql)} || ' ' || CASE event_id % 3 WHEN 0 THEN '[-] ' WHEN 1 THEN '[req-' || {text('event_id')} || ' a b] ' ELSE '' END || coalesce(props, '') END AS line
    FROM events"""


def _members(sql: bool) -> str:
    text = (lambda x: f"CAST({x} AS VARCHAR)") if sql else (lambda x: f"cast({x} as string)")
    return f"""
    SELECT doc_id, 'report-' || {text('doc_id % 5')} || '.tar.xz' AS report_name, {_pick(PREFIXES, 'doc_id % 4', sql)} || {_pick(PATHS, 'doc_id % 9', sql)} AS name,
      CASE WHEN doc_id % 13 = 0 THEN 0 ELSE n_chars END AS size, doc_id % 17 <> 0 AS is_reg, coalesce(text, '') AS text
    FROM documents"""


def _view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    name = f"harrow_{table}_{uuid.uuid4().hex[:8]}"
    spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql.replace(f"FROM {table}", f"FROM {name}"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", _lines(False))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "documents", _members(False))


def shared(spark: SparkSession) -> str:
    """A new folder that driver and executors share; in local mode alone, a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="harrow-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/harrow-{uuid.uuid4().hex[:12]}"


def _archives(spark: SparkSession, sf_dir: str) -> str:
    """A folder with documents packed into archives of 200 ids each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = docs.select(
        F.concat(F.lit("report-"), F.expr("doc_id div 200").cast("string"), F.lit(".tar.xz")).alias("report_name"),
        F.concat(F.lit("./var/log/nova/doc-"), F.col("doc_id").cast("string"), F.lit(".log")).alias("name"),
        F.col("text").alias("body"),
        F.col("doc_id").alias("rank"),
    )
    out = shared(spark) + "/archives"
    write_archives(files, out).write.parquet(out + "-written")
    return out


def _archived(spark: SparkSession, sf_dir: str, columns: str, **options: str) -> DataFrame:
    """Columns of those archives, read back by the data source."""
    register(spark)
    return spark.read.format(FORMAT).options(**options).schema(columns).load(_archives(spark, sf_dir))


def archive_listing(spark, sf_dir):
    """Bodies aren't asked for, so they stay in the archives."""
    found = _archived(spark, sf_dir, "report_name string, size long", every="true")
    return found.groupBy("report_name").agg(F.count("*").alias("n_members"), F.sum("size").alias("n_bytes"))


def archive_lines(spark, sf_dir):
    found = _archived(spark, sf_dir, "report_name string, name string, kind string, body binary").filter("kind = 'log'")
    n_lines = F.size(F.split(F.make_valid_utf8(F.col("body").cast("string")), "\n")).cast("long")
    return found.select("report_name", member_name(F.col("name")).alias("source_file"), n_lines.alias("n_lines"))


def archive_text_lines(spark, sf_dir):
    """Non-blank lines of the archives' log members, as the reader's decoder gives them."""
    found = L.lines_read(_archived(spark, sf_dir, LINES, content="lines"))
    return found.groupBy("report_name", "source_file").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def _reports(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...] = ("report", "docs")) -> str:
    """A folder with archives of the derived log files (report-...) and of documents as members (docs-...)."""
    where = F.when(F.col("member_idx") % 4 == 0, PREFIXES[0]).when(F.col("member_idx") % 4 == 1, PREFIXES[1]).when(F.col("member_idx") % 4 == 2, PREFIXES[2]).otherwise(PREFIXES[3])
    lines = log_lines(spark, sf_dir).select(
        F.concat(F.replace("report_name", F.lit(".tar.xz"), F.lit("-")), F.split_part("path", F.lit("-"), F.lit(2)), F.lit(".tar.xz")).alias("report_name"),
        F.concat(where, F.lit("m"), F.col("member_idx").cast("string"), F.lit("/"), "source_file").alias("name"), "line_no", "line",
    )
    texts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    logs = lines.groupBy("report_name", "name").agg(F.array_join(texts, "\n").alias("body"), F.min("line_no").alias("rank"))
    docs = members(spark, sf_dir).select(
        F.concat(F.lit("docs-"), F.expr("doc_id div 200").cast("string"), F.lit(".tar.xz")).alias("report_name"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/"), "name").alias("name"), F.col("text").alias("body"), F.col("doc_id").alias("rank"),
    )
    out = shared(spark) + "/reports"
    write_archives(logs.unionByName(docs), out).write.parquet(out + "-written")
    return out


def ingest_job(spark, sf_dir):
    """Counters of the ingest of reports with log files and command captures into tables."""
    folder = _reports(spark, sf_dir)
    return ingest(spark, folder, folder + "-tables")


def _ingested(spark: SparkSession, sf_dir: str, name: str, schema: StructType) -> DataFrame:
    folder = _reports(spark, sf_dir)
    ingest(spark, folder, folder + "-tables")
    return Tables(spark, folder + "-tables").read(name, schema)


def ingested_logs(spark, sf_dir):
    """The log table as that ingest has published it."""
    return _ingested(spark, sf_dir, "os_logs", OS_LOGS)


def ingested_commands(spark, sf_dir):
    return _ingested(spark, sf_dir, "os_commands", OS_COMMANDS)


def shared_target(spark, sf_dir):
    """Rows of one target that the job and two runs of the stream have written, beside a broken archive that the stream puts aside."""
    folder = _reports(spark, sf_dir)
    out = folder + "-tables"
    ingest(spark, folder, out)
    DriverFiles(spark).create_new(f"{folder}-more/broken.tar.xz", b"broken")
    again = listed(spark, folder).filter(F.substring_index("path", "/", -1).startswith("docs-"))
    copy_archives(again, folder + "-more", int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(folder + "-copied")
    for _ in range(2):
        ingest_arrivals(spark, folder + "-more", out, folder + "-checkpoint").awaitTermination()
    tables = Tables(spark, out)
    parts = (("os_logs", OS_LOGS), ("os_commands", OS_COMMANDS), ("os_quarantine", QUARANTINE))
    rows = [tables.read(t, schema).select(F.lit(t).alias("table_name"), "report_name") for t, schema in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("table_name", "report_name").agg(F.count("*").alias("n"))


def member_names(spark, sf_dir):
    return members(spark, sf_dir).select("doc_id", "name", member_name(F.col("name")).alias("source_file"))


def member_routing(spark, sf_dir):
    return M.routed(members(spark, sf_dir), LIMIT).select("doc_id", "report_name", "source_file", "size", "kind")


def _kept(spark, sf_dir):
    return L.nonblank(log_lines(spark, sf_dir))


def nonblank_lines(spark, sf_dir):
    return _kept(spark, sf_dir).select("path", "line_no", "line")


def parsed_lines(spark, sf_dir):
    return L.parsed(_kept(spark, sf_dir)).select("path", "line_no", "is_header", "ts_text", "pid", "module", "text")


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def parsed_timestamps(spark, sf_dir):
    return L.parsed(_kept(spark, sf_dir)).filter("is_header").select("line_no", "ts_text", _stamp("timestamp").alias("stamp"))


def levels(spark, sf_dir):
    return L.parsed(_kept(spark, sf_dir)).filter("is_header").groupBy("level").agg(F.count("*").alias("n"))


def _pairs(spark, sf_dir):
    headers = L.parsed(_kept(spark, sf_dir)).filter("is_header").select("module", "source_file")
    files = members(spark, sf_dir).select(F.substring_index("name", "/", -1).alias("module"), member_name(F.col("name")).alias("source_file"))
    return rules.enrich(headers.union(files).distinct(), "module")


def service_classes(spark, sf_dir):
    return _pairs(spark, sf_dir).select("module", "source_file", "service", "category")


def row_tags(spark, sf_dir):
    return _pairs(spark, sf_dir).select("module", "source_file", "tags")


def _records(spark, sf_dir):
    return assembled(L.parsed(_kept(spark, sf_dir)))


def assembled_records(spark, sf_dir):
    return _records(spark, sf_dir).select("path", "source_file", "rec", "message")


def orphan_records(spark, sf_dir):
    return _records(spark, sf_dir).filter("rec = 0").select("path", _stamp("timestamp").alias("stamp"), "pid", "level", "module", "message")


def os_logs(spark, sf_dir):
    return T.os_logs(_kept(spark, sf_dir))


def os_commands(spark, sf_dir):
    found = M.routed(members(spark, sf_dir), LIMIT).filter("kind = 'command'")
    return T.os_commands(found.withColumn("body", F.col("text").cast("binary")))


def rule_tokens(spark, sf_dir):
    """How often each rule token stands in the member names of documents: each name meets the 30 tokens within one expression."""
    tokens = [r.token for r in rules.rule_table(spark).select(F.explode("tokens").alias("token")).distinct().collect()] + rules.COMMAND_ONLY
    low = members(spark, sf_dir).select(F.lower(F.substring_index("name", "/", -1)).alias("base")).groupBy("base").agg(F.count("*").alias("n"))
    held = F.array_compact(F.array(*(F.when(F.col("base").contains(t), F.lit(t)) for t in tokens)))
    counted = low.select("n", F.explode(held).alias("token")).groupBy("token").agg(F.sum("n").alias("n_members"))
    every = spark.createDataFrame([(t,) for t in tokens], "token string")
    return every.join(counted, "token", "left").select("token", F.coalesce("n_members", F.lit(0)).alias("n_members"))


def ingest_counters(spark, sf_dir):
    every = members(spark, sf_dir)
    routed = M.routed(every, LIMIT)
    return ingest_stats(every.select("report_name").distinct(), routed, record_counts(L.parsed(_kept(spark, sf_dir))), routed.filter("kind = 'command'"))


def latest_per_module(spark, sf_dir):
    logs = os_logs(spark, sf_dir).filter("module = 'nova.compute.manager'")
    return logs.orderBy(F.col("timestamp").desc(), "message").limit(1).select(_stamp("timestamp").alias("stamp"), "message")


def module_counts(spark, sf_dir):
    return os_logs(spark, sf_dir).groupBy("module").agg(F.count("*").alias("n"))


def command_like(spark, sf_dir):
    found = os_commands(spark, sf_dir).filter(F.col("source").like("%podman_ps%"))
    return found.orderBy("source", "report_name", "output").limit(1).select("source", "report_name", F.length("output").cast("long").alias("n_chars"))


def table_columns(spark, sf_dir):
    """Columns of the two tables, with the rows that have a value."""
    logs, commands = os_logs(spark, sf_dir), os_commands(spark, sf_dir)
    counted = [df.agg(*(F.count(c).alias(c) for c in names)).unpivot([], names, "column_name", "n").withColumn("table_name", F.lit(t)) for t, df, names in (("os_logs", logs, OS_LOGS.names), ("os_commands", commands, OS_COMMANDS.names))]
    return counted[0].unionByName(counted[1]).select("table_name", "column_name", "n")


def append_overwrite(spark, sf_dir):
    """Rows of a published log table after a write, an append, a repeated append and a rebuild."""
    logs, tables, counts = os_logs(spark, sf_dir), Tables(spark, shared(spark)), []
    for step, run, overwrite in (("write", "a", False), ("append", "b", False), ("repeat", "b", False), ("rebuild", "c", True)):
        tables.write(run, {"os_logs": logs}, overwrite)
        counts.append(tables.read("os_logs", OS_LOGS).agg(F.lit(step).alias("step"), F.count("*").alias("n")).first())
    return spark.createDataFrame(counts, "step string, n long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        archive_listing, archive_lines, archive_text_lines, ingest_job, ingested_logs, ingested_commands, shared_target,
        member_names, member_routing, nonblank_lines, parsed_lines, parsed_timestamps, levels, service_classes, row_tags,
        assembled_records, orphan_records, os_logs, os_commands, rule_tokens, ingest_counters, latest_per_module, module_counts,
        command_like, table_columns, append_overwrite,
    )
}

# -- The same in SQL -----------------------------------------------------------------------------------------------

#: Fixed value, spelled here for itself.
_HEADER = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}[.,]\d{3,6})\s+(\d+)\s+(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|TRACE)\s+(\S+)\s+(?:\[[^\]]*\]\s+)?(.*)$"


def _any(column: str, tokens: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in tokens) + ")"


def _case(part: int) -> str:
    rows = rules.RULES
    return "CASE " + " ".join(f"WHEN {_any('low', r[2])} THEN '{r[part]}'" for r in rows) + " ELSE 'unknown' END"


_TAGS = f"""array_to_string(list_sort(list_distinct(list_filter(['openstack', 'rhosp17',
  CASE WHEN {_any('all_low', ['container', 'podman'])} THEN 'containerized' END, CASE WHEN {_any('all_low', ['ovn', 'neutron', 'networking'])} THEN 'networking' END,
  CASE WHEN {_any('all_low', ['nova', 'compute'])} THEN 'compute' END, CASE WHEN {_any('all_low', ['cinder', 'storage'])} THEN 'storage' END,
  CASE WHEN contains(all_low, 'tripleo') THEN 'tripleo' END, CASE WHEN service <> 'unknown' THEN service END], lambda x: x IS NOT NULL))), ',')"""
_TOKENS = rules.command_tokens()


def _enriched(source: str, module: str, columns: str) -> str:
    """A query that gives columns, service, category and tags of the rows of source."""
    return f"""(SELECT *, {_TAGS} AS tags FROM (SELECT *, lower(service || ' ' || category || ' ' || {module} || ' ' || source_file) AS all_low
      FROM (SELECT *, {_case(0)} AS service, {_case(1)} AS category FROM (SELECT *, lower({module} || ' ' || source_file) AS low FROM (SELECT {columns} FROM {source})))))"""


_LINES = f"lines AS (SELECT * FROM ({_lines(True)}) WHERE line <> '')"
_PARSE = f"""parsed AS (SELECT *, CASE WHEN is_header THEN regexp_extract(line, '{_HEADER}', 1) END AS ts_text, CASE WHEN is_header THEN CAST(regexp_extract(line, '{_HEADER}', 2) AS INTEGER) END AS pid,
  CASE WHEN is_header THEN replace(regexp_extract(line, '{_HEADER}', 3) || '|', 'WARN|', 'WARNING|') END AS level_bar, CASE WHEN is_header THEN regexp_extract(line, '{_HEADER}', 4) END AS module,
  CASE WHEN is_header THEN regexp_extract(line, '{_HEADER}', 5) ELSE line END AS text FROM (SELECT *, regexp_matches(line, '{_HEADER}') AS is_header FROM lines)),
stamped AS (SELECT *, rtrim(level_bar, '|') AS level, CAST(replace(replace(ts_text, 'T', ' '), ',', '.') AS TIMESTAMP) AS "timestamp" FROM parsed)"""
_RECORD = f"""records AS (SELECT path, member_idx, report_name, source_file, rec, max("timestamp") AS "timestamp", max(pid) AS pid, coalesce(max(level), 'UNKNOWN') AS level, coalesce(max(module), 'unknown') AS module,
  string_agg(text, chr(10) ORDER BY line_no) AS message FROM (SELECT *, CAST(sum(CAST(is_header AS INTEGER)) OVER (PARTITION BY path, member_idx, report_name, source_file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rec FROM stamped)
  GROUP BY path, member_idx, report_name, source_file, rec)"""
_LOG = f"""logs AS (SELECT "timestamp", pid, level, module, message, service, category, source_file, report_name, tags, '17.x' AS rhosp_version FROM {_enriched('records', 'module', '*')})"""
_PARSED = f"{_LINES}, {_PARSE}"
_RECORDS = f"{_PARSED}, {_RECORD}"
_LOGS = f"{_RECORDS}, {_LOG}"
_ROUTE = f"""routed AS (SELECT * FROM (SELECT *, CASE WHEN NOT is_reg OR size <= 0 OR size > {LIMIT} THEN NULL
  WHEN regexp_matches(lower(source_file), '\\.(log|txt|out|err)$') AND contains('/' || lower(source_file), '/var/log/') AND NOT regexp_matches(lower(source_file), '/httpd/|access\\.log|_error\\.log') AND regexp_matches(lower(source_file), 'nova|cinder|ovn|openvswitch|ovs|neutron') THEN 'log'
  WHEN contains(lower(source_file), 'sos_commands/') AND {_any('lower(source_file)', _TOKENS)} THEN 'command' END AS kind FROM named) WHERE kind IS NOT NULL)"""
_ROUTED = f"""named AS (SELECT *, ltrim(replace(name, '\\', '/'), './') AS source_file FROM ({_members(True)})), {_ROUTE}"""
_COMMAND = f"""commands AS (SELECT source_file AS source, command, output, service, category, source_file, report_name, tags, '17.x' AS rhosp_version
  FROM {_enriched("routed WHERE kind = 'command'", 'command', "source_file, report_name, text AS output, regexp_extract(source_file, '[^/]*$') AS command")})"""
_COMMANDS = f"{_ROUTED}, {_COMMAND}"
_PAIRS = f"""{_PARSED}, {_ROUTED}, pairs AS (SELECT DISTINCT module, source_file FROM (SELECT module, source_file FROM parsed WHERE is_header UNION ALL SELECT regexp_extract(name, '[^/]*$'), source_file FROM named))"""
_STAMP = "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S.%f') AS stamp"
_ARCHIVE = "'report-' || CAST(doc_id // 200 AS VARCHAR) || '.tar.xz'"


#: Members of the reports that the ingest queries read, their lines, and the two tables.
_REPORTS = f"""event_files AS (SELECT report_name, name, string_agg(line, chr(10) ORDER BY line_no) AS text FROM (
  SELECT replace(report_name, '.tar.xz', '-') || split_part(path, '-', 2) || '.tar.xz' AS report_name, {_pick(PREFIXES, 'member_idx % 4', True)} || 'm' || CAST(member_idx AS VARCHAR) || '/' || source_file AS name, line_no, line
  FROM ({_lines(True)})) GROUP BY report_name, name),
files AS (SELECT * FROM event_files UNION ALL SELECT 'docs-' || CAST(doc_id // 200 AS VARCHAR) || '.tar.xz', 'd' || CAST(doc_id AS VARCHAR) || '/' || name, text FROM ({_members(True)})),
named AS (SELECT *, report_name || name AS path, ltrim(replace(name, '\\', '/'), './') AS source_file, strlen(text) AS size, true AS is_reg FROM files), {_ROUTE},
lines AS (SELECT path, 0 AS member_idx, report_name, source_file, line_no, line FROM (SELECT path, report_name, source_file, i AS line_no, regexp_replace(list_extract(parts, i), '[\\r\\n]+$', '') AS line
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM routed WHERE kind = 'log'), unnest(range(1, len(parts) + 1)) AS r(i)) WHERE line <> ''),
{_PARSE}, {_RECORD}, {_LOG}, {_COMMAND}"""
_COUNTERS = "CAST(sum(a) AS BIGINT) AS archives, CAST(sum(b) AS BIGINT) AS log_files, CAST(sum(c) AS BIGINT) AS log_rows, CAST(sum(d) AS BIGINT) AS command_files, CAST(sum(e) AS BIGINT) AS command_rows, CAST(0 AS BIGINT) AS corrupt_archives"


def _columns(table: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{n}' AS column_name, count(\"{n}\") AS n FROM {table.removeprefix('os_')}" for n in names)


ORACLE_SQL: dict[str, str] = {
    "archive_listing": f"SELECT {_ARCHIVE} AS report_name, count(*) AS n_members, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents GROUP BY 1",
    "archive_lines": f"SELECT {_ARCHIVE} AS report_name, 'var/log/nova/doc-' || CAST(doc_id AS VARCHAR) || '.log' AS source_file, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents WHERE text <> '' AND strlen(text) <= 26214400",
    "archive_text_lines": f"""SELECT report_name, source_file, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM (
      SELECT {_ARCHIVE} AS report_name, 'var/log/nova/doc-' || CAST(doc_id AS VARCHAR) || '.log' AS source_file, regexp_replace(unnest(string_split(text, chr(10))), '[\\r\\n]+$', '') AS line
      FROM documents WHERE text <> '') WHERE line <> '' GROUP BY report_name, source_file""",
    "ingest_job": f"""WITH {_REPORTS}, rows AS (SELECT DISTINCT report_name, 1 AS a, 0 AS b, 0 AS c, 0 AS d, 0 AS e FROM files UNION ALL SELECT report_name, 0, CAST(kind = 'log' AS INTEGER), 0, CAST(kind = 'command' AS INTEGER), 0 FROM routed
      UNION ALL SELECT report_name, 0, 0, 1, 0, 0 FROM logs UNION ALL SELECT report_name, 0, 0, 0, 0, 1 FROM commands) SELECT report_name, {_COUNTERS} FROM rows GROUP BY ROLLUP (report_name)""",
    "ingested_logs": f"WITH {_REPORTS} SELECT * FROM logs",
    "ingested_commands": f"WITH {_REPORTS} SELECT * FROM commands",
    "shared_target": f"""WITH {_REPORTS} SELECT 'os_logs' AS table_name, report_name, CASE WHEN report_name LIKE 'docs-%' THEN 2 ELSE 1 END * count(*) AS n FROM logs GROUP BY report_name
      UNION ALL SELECT 'os_commands', report_name, CASE WHEN report_name LIKE 'docs-%' THEN 2 ELSE 1 END * count(*) FROM commands GROUP BY report_name UNION ALL SELECT 'os_quarantine', 'broken.tar.xz', 1""",
    "member_names": f"SELECT doc_id, name, ltrim(replace(name, '\\', '/'), './') AS source_file FROM ({_members(True)})",
    "member_routing": f"WITH {_ROUTED} SELECT doc_id, report_name, source_file, size, kind FROM routed",
    "nonblank_lines": f"WITH {_LINES} SELECT path, line_no, line FROM lines",
    "parsed_lines": f"WITH {_PARSED} SELECT path, line_no, is_header, ts_text, pid, module, text FROM parsed",
    "parsed_timestamps": f"WITH {_PARSED} SELECT line_no, ts_text, {_STAMP} FROM stamped WHERE is_header",
    "levels": f"WITH {_PARSED} SELECT level, count(*) AS n FROM stamped WHERE is_header GROUP BY level",
    "service_classes": f"WITH {_PAIRS} SELECT module, source_file, service, category FROM {_enriched('pairs', 'module', '*')}",
    "row_tags": f"WITH {_PAIRS} SELECT module, source_file, tags FROM {_enriched('pairs', 'module', '*')}",
    "assembled_records": f"WITH {_RECORDS} SELECT path, source_file, rec, message FROM records",
    "orphan_records": f"WITH {_RECORDS} SELECT path, {_STAMP}, pid, level, module, message FROM records WHERE rec = 0",
    "os_logs": f"WITH {_LOGS} SELECT * FROM logs",
    "os_commands": f"WITH {_COMMANDS} SELECT * FROM commands",
    "rule_tokens": f"WITH {_ROUTED}, tokens AS (SELECT unnest([{', '.join(repr(t) for t in _TOKENS)}]) AS token), bases AS (SELECT lower(regexp_extract(name, '[^/]*$')) AS base, count(*) AS n FROM named GROUP BY 1) SELECT token, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_members FROM tokens LEFT JOIN bases ON contains(base, token) GROUP BY token",
    "ingest_counters": f"""WITH {_LOGS}, {_COMMANDS}, rows AS (SELECT DISTINCT report_name, 1 AS a, 0 AS b, 0 AS c, 0 AS d, 0 AS e FROM named UNION ALL SELECT report_name, 0, CAST(kind = 'log' AS INTEGER), 0, CAST(kind = 'command' AS INTEGER), 0 FROM routed
      UNION ALL SELECT report_name, 0, 0, 1, 0, 0 FROM logs UNION ALL SELECT report_name, 0, 0, 0, 0, 1 FROM commands)
      SELECT report_name, {_COUNTERS} FROM rows GROUP BY ROLLUP (report_name)""",
    "latest_per_module": f"WITH {_LOGS} SELECT {_STAMP}, message FROM logs WHERE module = 'nova.compute.manager' ORDER BY \"timestamp\" DESC, message LIMIT 1",
    "module_counts": f"WITH {_LOGS} SELECT module, count(*) AS n FROM logs GROUP BY module",
    "command_like": f"WITH {_COMMANDS} SELECT source, report_name, CAST(length(output) AS BIGINT) AS n_chars FROM commands WHERE source LIKE '%podman_ps%' ORDER BY source, report_name, output LIMIT 1",
    "table_columns": f"WITH {_LOGS}, {_COMMANDS} {_columns('os_logs', OS_LOGS.names)} UNION ALL {_columns('os_commands', OS_COMMANDS.names)}",
    "append_overwrite": f"WITH {_LOGS} SELECT 'write' AS step, count(*) AS n FROM logs UNION ALL SELECT 'append', 2 * count(*) FROM logs UNION ALL SELECT 'repeat', 2 * count(*) FROM logs UNION ALL SELECT 'rebuild', count(*) FROM logs",
}
