"""The ingest job: archives to published tables. Run it with spark-submit, or call ingest()."""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow.operators.lines import lines_read
from harrow.operators.members import DEFAULT_MB, size_limit
from harrow.operators.stats import Counts, ingest_stats, stats_of
from harrow.plans.publish import Tables
from harrow.plans.tables import os_commands, os_logs, quarantined
from harrow.schemas import COUNTERS, OS_COMMANDS, OS_LOGS, QUARANTINE
from harrow.sources.archives import LINES, TASK_BYTES, ArchiveError, Scan, listed, read_archives
from harrow.sources.files import absolute

#: Where reports lie if nothing is said, and the largest member in MB if the command line says nothing.
DEFAULT_REPORTS, COMMAND_LINE_MB = "SOS_REPORTS", 10
#: Members of up to so many bytes are assembled whole, in one task each; where larger ones are let in, in ranges of so many lines.
WHOLE_MEMBER, RANGE_LINES = 64 << 20, 1 << 17
#: The tables of a target. Each run adds rows to some of them.
SCHEMAS: dict[str, StructType] = {"os_logs": OS_LOGS, "os_commands": OS_COMMANDS, "os_quarantine": QUARANTINE, "ingest_counters": COUNTERS}


def default_out(reports_dir: str) -> str:
    """Beside the folder of reports."""
    parent, slash, _ = reports_dir.rstrip("/").rpartition("/")
    return f"{parent}/harrow_tables" if slash else "./harrow_tables"


def ingest(
    spark: SparkSession,
    reports_dir: str | None = None,
    out: str | None = None,
    overwrite: bool = False,
    max_mb: int | None = DEFAULT_MB,
    fail_fast: bool = False,
    on_corrupt: str = "fail",
    run: str | None = None,
    database: str | None = None,
) -> DataFrame:
    """Append (or with overwrite rebuild) the tables under out, and return the counters of this run.

    run: the run's identity; one that is published already changes nothing. on_corrupt: "fail", or "quarantine" (also "skip"): unreadable
    archives are listed in os_quarantine and counted, and what could be read of them is kept. database: also declare the
    tables there, in Spark's catalogue.
    """
    reports_dir = absolute(reports_dir or DEFAULT_REPORTS)
    tables = Tables(spark, absolute(out) if out else default_out(reports_dir))
    run = run or uuid.uuid4().hex
    if run not in tables.version()["runs"] and not ingest_archives(tables, listed(spark, reports_dir), run, overwrite, max_mb, fail_fast, on_corrupt):
        raise ArchiveError(f"no archives in {reports_dir}")
    if database:
        tables.declare(SCHEMAS, database)
    return spark.read.schema(COUNTERS).parquet(tables.folder(run, "ingest_counters"))


def ingest_archives(tables: Tables, archives: DataFrame, run: str, overwrite: bool, max_mb: int | None, fail_fast: bool, on_corrupt: str) -> int:
    """ingest() of the archives (path, bytes); returns how many there were, and publishes nothing if there were none.

    Archives are decoded once, into a table of lines that logs and commands are made of and that goes afterwards. All counters are metrics
    taken while rows are written.
    """
    spark, work = tables.spark, f"{tables.out}/_work/{run}"
    try:
        found = Observation()
        archives.select("path", "bytes").observe(found, F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).write.mode("overwrite").parquet(f"{work}/archives")
        n, size = found.get["n"], found.get["bytes"]
        if not n:
            return 0
        paths = spark.read.schema("path string, bytes long").parquet(f"{work}/archives")
        scan = Scan(size_limit(max_mb), lines=True, on_corrupt="fail" if on_corrupt == "fail" else "quarantine")
        read = read_archives(paths, scan, min(n, max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))
        counts = Counts(n)
        is_member = lambda kind: (F.col("line_no") == -1) & (F.col("kind") == kind)
        read = counts.of(read, log_files=is_member("log"), command_files=is_member("command"), corrupt_archives=is_member("corrupt"))
        read.write.mode("overwrite").parquet(f"{work}/lines")
        lines = spark.read.schema(LINES).parquet(f"{work}/lines")
        span = RANGE_LINES if scan.limit > WHOLE_MEMBER else None
        logs = counts.of(os_logs(lines_read(lines), fail_fast, span), log_rows=F.lit(True))
        commands = counts.of(os_commands(lines.filter("kind = 'command' and line_no >= 0"), F.col("line")), command_rows=F.lit(True))
        made = {"os_logs": logs, "os_commands": commands}
        for name, df in made.items():
            df.write.mode("overwrite").parquet(tables.folder(run, name))
        per_archive = counts.per_report()
        if per_archive is None:  # more archives than metrics hold apart: counted from what was written
            members = lines.filter("line_no = -1")
            rows = (spark.read.schema(SCHEMAS[t]).parquet(tables.folder(run, t)).select("report_name") for t in made)
            stats = ingest_stats(paths.select(F.substring_index("path", "/", -1).alias("report_name")), members, *rows)
        else:
            stats = stats_of(paths, per_archive)
        stats.write.mode("overwrite").parquet(tables.folder(run, "ingest_counters"))
        names = [*made, "ingest_counters"]
        if counts.total("corrupt_archives"):
            quarantined(lines).write.mode("overwrite").parquet(tables.folder(run, "os_quarantine"))
            names.append("os_quarantine")
        tables.publish(run, names, overwrite)
        return n
    finally:
        tables.files.delete(work)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Ingest diagnostic archives into published Parquet tables")
    parser.add_argument("--reports-dir", default=DEFAULT_REPORTS, help="folder with .tar.xz archives")
    parser.add_argument("--out", help="target folder; beside the reports if not given")
    parser.add_argument("--clear-existing", action="store_true", help="rebuild the tables from this run alone")
    parser.add_argument("--max-file-size-mb", type=int, default=COMMAND_LINE_MB, help="larger members are skipped")
    parser.add_argument("--fail-fast", action="store_true", help="impossible timestamps and process ids fail the job")
    parser.add_argument("--on-corrupt", choices=["fail", "quarantine"], default="fail", help="what unreadable archives do")
    parser.add_argument("--database", help="declare the tables in this database of Spark's catalogue")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("ingest").getOrCreate()
    ingest(spark, a.reports_dir, a.out, a.clear_existing, a.max_file_size_mb, a.fail_fast, a.on_corrupt, None, a.database).show(100, truncate=False)


if __name__ == "__main__":
    main()
