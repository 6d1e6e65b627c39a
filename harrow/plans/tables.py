"""os_logs and os_commands from lines and members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.rules import enrich
from harrow.functions.text import base_name, decode, member_name
from harrow.operators.lines import parsed
from harrow.operators.records import assembled
from harrow.schemas import OS_COMMANDS, OS_LOGS, VERSION


def os_logs(lines: DataFrame, fail_fast: bool = False, span: int | None = None) -> DataFrame:
    """The log table of non-blank lines (path, member_idx, report_name, source_file, line_no, line); span as in assembled()."""
    records = assembled(parsed(lines, fail_fast), span=span)
    return enrich(records, "module").withColumn("rhosp_version", F.lit(VERSION)).select(OS_LOGS.names)


def os_commands(members: DataFrame, output: Column | None = None) -> DataFrame:
    """The command table of members (report_name, source_file or name, and output or else body)."""
    if "source_file" not in members.columns:
        members = members.withColumn("source_file", member_name(F.col("name")))
    text = decode(F.col("body")) if output is None else output
    source = F.col("source_file")
    named = members.select("report_name", source, source.alias("source"), base_name(source).alias("command"), F.coalesce(text, F.lit("")).alias("output"))
    return enrich(named, "command").withColumn("rhosp_version", F.lit(VERSION)).select(OS_COMMANDS.names)


def quarantined(lines: DataFrame) -> DataFrame:
    """The archives that couldn't be read to their end, and why."""
    return lines.filter("kind = 'corrupt'").select("path", "report_name", F.col("name").alias("error"), F.col("line").alias("message"))
