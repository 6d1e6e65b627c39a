"""Routing of archive members by type, size and path, as Columns and as a predicate for the archive reader."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions.rules import any_of, command_tokens
from harrow.functions.text import member_name

#: Fixed values.
LOG_ENDINGS = [".log", ".txt", ".out", ".err"]
LOG_TOKENS = ["nova", "cinder", "ovn", "openvswitch", "ovs", "neutron"]
LOW_VALUE = ["/httpd/", "access.log", "_error.log"]
DEFAULT_MB = 25


def size_limit(mb: int | None) -> int:
    """Bytes; no limit given means DEFAULT_MB, and nothing is below 1 MiB."""
    return (DEFAULT_MB if mb is None else max(1, int(mb))) << 20


def route(name: Column, size: Column, is_reg: Column, limit: int) -> Column:
    """'log', 'command' or null for a normalised name; what is both is a log."""
    low = F.lower(name)
    fits = is_reg & (size > 0) & (size <= limit)
    log = low.rlike("(?:" + "|".join(map(re.escape, LOG_ENDINGS)) + r")\z") & F.concat(F.lit("/"), low).contains("/var/log/") & ~any_of(low, LOW_VALUE) & any_of(low, LOG_TOKENS)
    command = low.contains("sos_commands/") & any_of(low, command_tokens())
    return F.when(fits & log, "log").when(fits & command, "command")


def routed(members: DataFrame, limit: int) -> DataFrame:
    """members (name, size, is_reg, ...) with source_file and kind; unrouted ones are dropped."""
    named = members.withColumn("source_file", member_name(F.col("name")))
    return named.withColumn("kind", route(F.col("source_file"), F.col("size"), F.col("is_reg"), limit)).filter("kind is not null")


def route_name(name: str, size: int, is_reg: bool, limit: int, commands: list[str] = command_tokens()) -> str | None:
    """The same decision for the reader, which has to skip bodies before they reach Spark; tested against route()."""
    low = name.replace("\\", "/").lstrip("./").lower()
    if not is_reg or not 0 < size <= limit:
        return None
    if low.endswith(tuple(LOG_ENDINGS)) and "/var/log/" in "/" + low and not any(x in low for x in LOW_VALUE) and any(x in low for x in LOG_TOKENS):
        return "log"
    return "command" if "sos_commands/" in low and any(x in low for x in commands) else None
