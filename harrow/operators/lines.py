"""Lines of log members and the fields of header lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.text import decode, member_name, without_line_end

#: White space as a Unicode-aware engine without these four control characters lacks it.
_S, _NOT_S = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"
#: Fixed value: timestamp, pid, level, module, an optional bracketed context, message. (?Ud): Unicode classes, only \n ends lines.
HEADER = rf"(?Ud)^(\d{{4}}-\d{{2}}-\d{{2}}[ T]\d{{2}}:\d{{2}}:\d{{2}}[.,]\d{{3,6}}){_S}+(\d+){_S}+(DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|TRACE){_S}+({_NOT_S}+){_S}+(?:\[[^\]]*\]{_S}+)?(.*)$"


def lines_of(members: DataFrame, body: str = "body", keep: tuple[str, ...] = ("path", "member_idx", "report_name", "source_file")) -> DataFrame:
    """keep, line_no and line: the members' non-blank lines, without their ends."""
    exploded = members.select(*keep, F.posexplode(F.split(decode(F.col(body)), "\n")).alias("line_no", "line"))
    return nonblank(exploded.withColumn("line_no", F.col("line_no").cast("long")))


def lines_read(lines: DataFrame) -> DataFrame:
    """path, member_idx, report_name, source_file, line_no and line of the log members' non-blank lines, as the archive reader gives lines."""
    logs = lines.filter("kind = 'log' and line_no >= 0")
    return nonblank(logs.select("path", "member_idx", "report_name", member_name(F.col("name")).alias("source_file"), "line_no", "line"))


def nonblank(lines: DataFrame) -> DataFrame:
    """Lines that are not empty once their end is cut off; white space alone is kept."""
    return lines.withColumn("line", without_line_end(F.col("line"))).filter("line <> ''")


def timestamp(text: Column, fail_fast: bool = False) -> Column:
    """A header's timestamp; an impossible one is null, or an error with fail_fast."""
    year_zero = text.startswith("0000")
    plain = F.translate(text, ",", ".")
    if fail_fast:
        return F.when(year_zero, F.raise_error(F.concat(F.lit("impossible timestamp: "), text))).otherwise(plain.cast("timestamp_ntz"))
    return F.when(~year_zero, plain.try_cast("timestamp_ntz"))


def level(text: Column) -> Column:
    return F.when(text == "WARN", "WARNING").otherwise(text)


def parsed(lines: DataFrame, fail_fast: bool = False) -> DataFrame:
    """lines (without line feeds) with is_header and, for headers, ts_text, timestamp, pid, level, module, text (others have text = line)."""
    # one scan: a header's parts come back a line each (a line holds no line feed itself), any other line as it was
    found = F.split(F.regexp_replace("line", HEADER, "$1\n$2\n$3\n$4\n$5"), "\n", 5)
    out = lines.withColumn("_part", found).withColumn("is_header", F.size("_part") == 5)
    part = lambda k: F.when(F.col("is_header"), F.col("_part")[k])
    out = out.withColumns({"ts_text": part(0), "pid_text": part(1), "level": level(part(2)), "module": part(3), "text": F.coalesce(part(4), "line")})
    pid = F.col("pid_text").cast("int") if fail_fast else F.col("pid_text").try_cast("int")
    return out.withColumn("timestamp", timestamp(F.col("ts_text"), fail_fast)).withColumn("pid", pid).drop("pid_text", "_part")
