"""Tables that are published by runs: a run writes a folder of its own, and one small file then says which runs make up the tables.

    out/_runs/<run>/<table>/part-*.parquet
    out/_versions/000000000012.json

The version with the highest number counts. It is created, never overwritten, so that of two runs that publish at once one has to look
again, and readers see all tables as they were before a run or as they are after it. No file is moved or read for
publishing: the driver makes the same few calls however many files there are.

A run has an identity. One that is published already isn't published again, so a batch that is repeated after a failure counts
once. A run that fails leaves a folder that nothing reads; clean() removes it later.

A rebuild retires the runs before it. Their files stay until the version after the next one, so that whoever reads the tables meanwhile can
finish.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from harrow.sources.files import DriverFiles


class Tables:
    """The tables under out. A snapshot is what version() returns: number, runs ({id: names of its tables}) and retired runs."""

    def __init__(self, spark: SparkSession, out: str) -> None:
        self.spark, self.out, self.files = spark, out.rstrip("/"), DriverFiles(spark)

    def version(self) -> dict:
        found = [n for n in self.files.names(f"{self.out}/_versions") if n.endswith(".json")]
        return json.loads(self.files.read(f"{self.out}/_versions/{found[-1]}")) if found else {"number": 0, "runs": {}, "retired": []}

    def folder(self, run: str, name: str) -> str:
        return f"{self.out}/_runs/{run}/{name}"

    def publish(self, run: str, names: list[str], overwrite: bool = False) -> bool:
        """Make a written run count, with overwrite alone; False if it counts already."""
        while True:
            before = self.version()
            if run in before["runs"]:
                return False
            after = self._after(before, run, names, overwrite)
            if self._create(after):
                break
        self._tidy(before)
        return True

    def _after(self, before: dict, run: str, names: list[str], alone: bool) -> dict:
        """The version that follows. Identities stay known, those of runs that don't count any more without tables."""
        kept = {old: [] for old in before["runs"]} if alone else before["runs"]
        retired = sorted(old for old, of in before["runs"].items() if of) if alone else []
        return {"number": before["number"] + 1, "runs": kept | {run: sorted(names)}, "retired": retired}

    def _create(self, version: dict) -> bool:
        return self.files.create_new(f"{self.out}/_versions/{version['number']:012d}.json", json.dumps(version).encode())

    def _tidy(self, before: dict) -> None:
        """What a version before the last one retired has no readers any more."""
        for old in before["retired"]:
            self.files.delete(f"{self.out}/_runs/{old}")
        for old in [n for n in self.files.names(f"{self.out}/_versions") if n.endswith(".json")][:-8]:
            self.files.delete(f"{self.out}/_versions/{old}")

    def write(self, run: str, tables: dict[str, DataFrame], overwrite: bool = False) -> bool:
        """Write the frames as tables of the run and publish it; False, with nothing written, if it counts already."""
        if run in self.version()["runs"]:
            return False
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self.folder(run, name))  # what an earlier attempt left goes
        return self.publish(run, list(tables), overwrite)

    def paths(self, name: str, version: dict | None = None) -> list[str]:
        return [self.folder(run, name) for run, names in (version or self.version())["runs"].items() if name in names]

    def read(self, name: str, schema: StructType, version: dict | None = None) -> DataFrame:
        """The table as of now, or of a snapshot; without rows if no run has it."""
        paths = self.paths(name, version)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def compact(self, run: str, schemas: dict[str, StructType]) -> None:
        """Draw all runs together into one; readers notice nothing. Raises if another run was published meanwhile."""
        before = self.version()
        names = sorted({n for of in before["runs"].values() for n in of})
        for name in names:
            self.read(name, schemas[name], before).write.mode("overwrite").parquet(self.folder(run, name))
        if not self._create(self._after(before, run, names, True)):
            raise RuntimeError("another run was published meanwhile")
        self._tidy(before)

    def clean(self, hours: float = 24, now: Callable[[], float] = time.time) -> list[str]:
        """Remove the folders of runs that no version counts or has just retired and that are older than hours; returns the runs."""
        version = self.version()
        left = [r for r in self.files.names(f"{self.out}/_runs") if r not in version["runs"] and r not in version["retired"]]
        old = [r for r in left if self.files.changed(f"{self.out}/_runs/{r}") < now() - 3600 * hours]
        for run in old:
            self.files.delete(f"{self.out}/_runs/{run}")
        return old

    def declare(self, schemas: dict[str, StructType], database: str = "default") -> None:
        """Declare the tables in Spark's catalogue, as external tables over the current version, for SQL by name."""
        version = self.version()
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        for name, schema in schemas.items():
            runs = [r for r, names in version["runs"].items() if name in names]
            where = f"{self.out}/_runs/{{{','.join(runs)}}}/{name}" if runs else f"{self.out}/_runs/none/{name}"
            table, place = f"{database}.{name}", where.replace("\\", "\\\\").replace("'", "\\'")
            if not self.spark.catalog.tableExists(table):
                columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
                self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet LOCATION '{place}'")
            else:
                self.spark.sql(f"ALTER TABLE {table} SET LOCATION '{place}'")
                self.spark.catalog.refreshTable(table)
