"""Records from lines: a header starts one, other lines continue it, and lines before the first header are one of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEMBER = ("path", "member_idx", "report_name", "source_file")


def _fields(message: Column) -> list[Column]:
    return [*(F.max(c).alias(c) for c in ("timestamp", "pid", "level", "module")), message.alias("message")]


def _joined(order: str, text: str) -> Column:
    """The texts of a group, in order, a line each."""
    texts = F.sort_array(F.collect_list(F.struct(order, text)))[text]
    return F.array_join(texts, "\n")


def assembled(parsed_lines: DataFrame, member: tuple[str, ...] = MEMBER, span: int | None = None) -> DataFrame:
    """A row a record: member columns, rec (0: before the first header), timestamp, pid, level, module, message.

    Without span, the window and the aggregate share one exchange by member, and a member is a window partition: right for members that a
    size limit bounds. With span, members are split into ranges of so many line numbers, which are worked on apart: headers are
    counted within a range, the counts of earlier ranges (a row a range) are added, and a record that goes on across
    ranges is put together from its pieces.
    """
    rec = F.sum(F.col("is_header").cast("long"))
    if span is None:
        order = Window.partitionBy(*member).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
        records = parsed_lines.withColumn("rec", rec.over(order)).groupBy(*member, "rec").agg(*_fields(_joined("line_no", "text")))
    else:
        part = (*member, "_range")
        lines = parsed_lines.withColumn("_range", F.floor(F.col("line_no") / span))
        before = Window.partitionBy(*member).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        offsets = lines.groupBy(*part).agg(F.count_if("is_header").alias("_n")).select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        order = Window.partitionBy(*part).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
        pieces = lines.withColumn("_rec", rec.over(order)).groupBy(*part, "_rec").agg(*_fields(_joined("line_no", "text")))
        pieces = pieces.join(offsets, [*part]).withColumn("rec", F.col("_before") + F.col("_rec"))
        records = pieces.groupBy(*member, "rec").agg(*_fields(_joined("_range", "message")))
    return records.withColumn("level", F.coalesce("level", F.lit("UNKNOWN"))).withColumn("module", F.coalesce("module", F.lit("unknown")))


def record_counts(parsed_lines: DataFrame, member: tuple[str, ...] = MEMBER) -> DataFrame:
    """member and n_rows: how many records assembled() makes, from header flags alone (one more if the first line is none)."""
    counted = parsed_lines.groupBy(*member).agg(F.count_if("is_header").alias("headers"), F.min_by("is_header", "line_no").alias("begins"))
    return counted.select(*member, (F.col("headers") + (~F.col("begins")).cast("long")).alias("n_rows"))
