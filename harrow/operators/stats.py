"""Ingest counters per archive and in all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from harrow.schemas import COUNTERS, STATS

#: Archives that a run's metrics hold apart; a report's counts are exact as long as no more reports than this are counted.
MOST_OBSERVED = 100_000


class Counts:
    """Counts by report_name that are taken while frames are written, as observed metrics: no job of their own, no second look at rows."""

    def __init__(self, archives: int) -> None:
        self.exact, self.taken = archives <= MOST_OBSERVED, []

    def of(self, df: DataFrame, **which: Column) -> DataFrame:
        """df, whose rows are counted under each name for which its condition holds. The frame has to be written (or run otherwise) once."""
        seen = Observation()
        totals = [F.count_if(c).alias(n) for n, c in which.items()]
        if self.exact:
            # a frequent-items aggregate is exact while it holds all items; null items aren't reports
            marked = df.withColumns({f"_{n}": F.when(c, F.col("report_name")) for n, c in which.items()})
            tops = [F.expr(f"approx_top_k(_{n}, {MOST_OBSERVED}, {10 * MOST_OBSERVED})").alias(f"_{n}") for n in which]
            out = marked.observe(seen, *totals, *tops).drop(*(f"_{n}" for n in which))
        else:
            out = df.observe(seen, *totals)
        self.taken.append((seen, list(which)))
        return out

    def total(self, name: str) -> int:
        return next(seen.get[name] for seen, names in self.taken if name in names)

    def per_report(self) -> dict[str, dict[str, int]] | None:
        """Counts by name and report; None if there are too many archives."""
        if not self.exact:
            return None
        return {n: {x["item"]: x["count"] for x in seen.get[f"_{n}"] or [] if x["item"] is not None} for seen, names in self.taken for n in names}


def stats_of(archives: DataFrame, per_report: dict[str, dict[str, int]]) -> DataFrame:
    """What ingest_stats() gives, from counts that are known; archives has path, one row an archive."""
    spark = archives.sparkSession
    counts = [(r, {name: n}) for name, of in per_report.items() for r, n in of.items()]
    rows = spark.createDataFrame(counts, "report_name string, n map<string, long>")
    known = rows.select("report_name", *(F.coalesce(F.col("n")[s], F.lit(0)).cast("long").alias(s) for s in COUNTERS.names[1:]))
    each = archives.select(F.substring_index("path", "/", -1).alias("report_name"), *(F.lit(int(s == "archives")).cast("long").alias(s) for s in COUNTERS.names[1:]))
    return each.unionByName(known).rollup("report_name").agg(*(F.sum(s).alias(s) for s in COUNTERS.names[1:]))


def ingest_stats(archives: DataFrame, routed_members: DataFrame, log_rows: DataFrame, command_rows: DataFrame) -> DataFrame:
    """report_name (null: total), the five counters and corrupt_archives. Inputs have report_name; archives with nothing routed count
    too, and a member of kind "corrupt" stands for an archive that couldn't be read to its end. A column n_rows in log_rows or
    command_rows says how many rows one stands for."""
    names = (*STATS, "corrupt_archives")

    def part(df: DataFrame, **one: Column) -> DataFrame:
        return df.select("report_name", *((one[s] if s in one else F.lit(0)).cast("long").alias(s) for s in names))

    of_kind = lambda kind: (F.col("kind") == kind).cast("long")
    stands_for = lambda df: F.col("n_rows") if "n_rows" in df.columns else F.lit(1)
    members = part(routed_members, log_files=of_kind("log"), command_files=of_kind("command"), corrupt_archives=of_kind("corrupt"))
    rows = part(archives, archives=F.lit(1)).unionByName(members)
    rows = rows.unionByName(part(log_rows, log_rows=stands_for(log_rows))).unionByName(part(command_rows, command_rows=stands_for(command_rows)))
    return rows.rollup("report_name").agg(*(F.sum(s).alias(s) for s in names))
