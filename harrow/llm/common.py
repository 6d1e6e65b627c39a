"""Helpers shared by the operators: shared scratch tables, words, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z, keeps 0-9, a-z and all bytes of non-ASCII characters, and turns every other byte into a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words (ASCII letters and digits and all non-ASCII characters) of UTF-8 text; null has none."""
    return text.translate(WORD_BYTES).split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, in local mode alone, a temporary one of our own."""
    set_already = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_already:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_already = "file://" + tempfile.mkdtemp(prefix="harrow-")
        spark.sparkContext.setCheckpointDir(set_already)
    return set_already.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/harrow-{uuid.uuid4().hex[:12]}/{name}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table() that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_rows(df: DataFrame, f: Callable[..., Iterator[dict]], schema: str, block_bytes: int = 8 << 20) -> DataFrame:
    """Apply f to blocks of df's rows, given as one list per column, and build rows from the column dict it returns.

    A block holds about block_bytes of the last column at most (or one row), so that memory doesn't follow the
    Arrow batch size or the length of neighbours. f is called once a task with no arguments and returns the function
    that handles the blocks, so that tables and memos are made once.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = f()
        for batch in batches:
            start, n = 0, batch.num_rows
            while start < n:
                size = max(1, int(n * block_bytes / max(batch.nbytes, 1)))
                part = batch.slice(start, size)
                start += size
                columns = handle(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def blocks_of(column: pa.Array, block_bytes: int) -> Iterator[list]:
    """The values in lists of about block_bytes (or one value)."""
    start, n = 0, len(column)
    size = max(1, int(n * block_bytes / max(column.nbytes, 1)))
    while start < n:
        yield column.slice(start, size).to_pylist()
        start += size


def filter_rows(df: DataFrame, column: Column, f: Callable[[], Callable[[list], list[bool]]], block_bytes: int = 4 << 20) -> DataFrame:
    """Rows of df for which f's function, given blocks of the column, is true. All columns of df pass unchanged.

    Only that one column goes to Python and only truth values come back; f is called once a task.
    """

    @F.arrow_udf("boolean")
    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        handle = f()
        for batch in batches:
            yield pa.array([x for block in blocks_of(batch, block_bytes) for x in handle(block)], pa.bool_())

    return df.filter(kept(column))


_held: dict = {}


def held(key: tuple, make: Callable):
    """What a worker process keeps from task to task: the model or memo that was asked for last, and no other, so that the memos
    of one job's steps don't add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


class Recent(dict):
    """A dict that keeps between most and 2 most entries: what was used or made since the last turn, and the turn before it.

    make(key) works out what is missing; keys of more than 64 characters aren't kept.
    """

    def __init__(self, make: Callable, most: int) -> None:
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Memo(dict):
    """A dict that forgets everything once its keys and values have come to about most_bytes."""

    #: Bytes of a dict entry, and of the object heads of a key and a value.
    ENTRY = 200

    def __init__(self, most_bytes: int) -> None:
        super().__init__()
        self.most, self.used = most_bytes, 0

    def keep(self, key, value, size: int) -> None:
        self.used += size + self.ENTRY
        if self.used > self.most:
            self.clear()
            self.used = size + self.ENTRY
        self[key] = value


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of edges (u, v: long) reaches.

    Alternating large-star and small-star steps over written tables. The smallest neighbour is a combinable
    aggregate, and it is joined back to the edges by a plain join whose hot keys Spark can split.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            n = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            n = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = table(n.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(F.col("u").alias("k"), "m"), "least")
        joined = n.join(least, F.col("u") == F.col("k"))
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        done = table(out.filter("u <> v").distinct(), "star")
        for old in (least, e):
            drop_table(old)
        return done

    e = table(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        e = star(star(e, True), False)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
