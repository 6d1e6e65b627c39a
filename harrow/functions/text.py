"""Text helpers as Column expressions: decoding, lines, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(body: Column) -> Column:
    """UTF-8 with malformed bytes replaced."""
    return F.make_valid_utf8(body.cast("string"))


def without_line_end(line: Column) -> Column:
    """The line without trailing carriage returns and line feeds; those inside stay."""
    return F.regexp_replace(line, r"[\r\n]+\z", "")


def member_name(name: Column) -> Column:
    """Forward slashes, and no leading run of dots and slashes."""
    return F.regexp_replace(F.replace(name, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
