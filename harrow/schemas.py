"""The output tables: the first two are fixed schemas (column names and order are fixed values)."""

from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType


def _strings(names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names.split()]


OS_LOGS = StructType([StructField("timestamp", TimestampNTZType()), StructField("pid", IntegerType()), *_strings("level module message service category source_file report_name tags rhosp_version")])
OS_COMMANDS = StructType(_strings("source command output service category source_file report_name tags rhosp_version"))
STATS = ("archives", "log_files", "log_rows", "command_files", "command_rows")
VERSION = "17.x"
#: A run's counters (report_name null: all of it), and the archives that couldn't be read to their end.
COUNTERS = StructType([StructField("report_name", StringType()), *(StructField(n, LongType()) for n in (*STATS, "corrupt_archives"))])
QUARANTINE = StructType(_strings("path report_name error message"))
