"""Archives that keep arriving: new ones are ingested exactly once by a file stream, into the same target as ingest() writes."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from harrow.operators.members import DEFAULT_MB
from harrow.plans.ingest import ingest_archives
from harrow.plans.publish import Tables


def batch_run(checkpoint: str, number: int) -> str:
    """The identity of a stream's batch: the same if the batch is run again."""
    return f"stream-{hashlib.sha256(checkpoint.rstrip('/').encode()).hexdigest()[:16]}-{number:09d}"


def ingest_arrivals(
    spark: SparkSession,
    reports_dir: str,
    out: str,
    checkpoint: str,
    max_mb: int | None = DEFAULT_MB,
    on_corrupt: str = "quarantine",
    fail_fast: bool = False,
    files_at_once: int = 1000,
) -> StreamingQuery:
    """Ingest what is there and new, then stop (available-now trigger), in batches of files_at_once archives.

    A batch is a run of the target's tables, under an identity of its own: batches and ingest() can publish in any order, and a batch that is
    repeated after a failure counts once. Unreadable archives go to os_quarantine, unless on_corrupt is "fail". Archives whose
    names begin with a dot or an underscore are hidden from file streams and left to ingest().
    """
    tables = Tables(spark, out)
    files = (
        spark.readStream.format("binaryFile").option("pathGlobFilter", "*.tar.xz").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_at_once)
        .schema("path string, modificationTime timestamp, length long, content binary").load(reports_dir).selectExpr("path", "length AS bytes")
    )

    def batch(df: DataFrame, number: int) -> None:
        run = batch_run(checkpoint, number)
        if run not in tables.version()["runs"]:
            # paths alone are read, so that a task a core does, where Spark would make one for every few files
            ingest_archives(tables, df.coalesce(spark.sparkContext.defaultParallelism), run, False, max_mb, fail_fast, on_corrupt)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
