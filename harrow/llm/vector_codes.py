"""Vector codes: vectors cut into four parts, each part named by its nearest entry of a codebook that ball k-means refines.

Components become integers, so all distances are exact and ties are real ties. Every round is one pass over the rows: each row's part
knows the entry that it belonged to (its ball), and the moved codebook says which other entries can be nearer:

- entry j is a neighbour of entry i only if their distance is at most twice the radius of i's ball (the largest distance of its
  parts, which the last pass noted, and the way that the entry has moved since);
- a part that is nearer to its entry than half the way to the nearest neighbour lies in the stable core and stays;
- any other part lies in an annular ring: only entries within twice its own distance come into question, the first so many of its
  ball's neighbours in order of distance.

Bounds hold with equality, so an entry that is just as near, with a lower index, is never left out; results equal a full search.
A pass writes rows with their new entries, and apart from them a sum, a count and a radius for each entry and task; those are
aggregated by Spark. The driver holds codebooks only: ENTRIES entries of one vector's length. A codebook is broadcast, of that size.

Defined results: rows whose vector is null or holds null or non-finite components are dropped, and of the others those whose length
isn't the commonest one (of equally common ones the greatest), as codes of unequal lengths can't be compared. Lengths that four
doesn't divide are cut as evenly as possible. The first codebook takes the smallest ids; equal ids are ordered by their vectors, null ids come last. With fewer rows than
ENTRIES there are as many entries as rows; an empty table gives no rows. Components so large that squared distances leave 64 bits fail
the job. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, new_path

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that a task works on at once, and cells of a distance table.
BLOCK_ROWS, CELLS = 32_768, 4 << 20


def cuts(length: int) -> list[int]:
    return [length * p // PARTS for p in range(PARTS + 1)]


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows (rows, entries)."""
    if not x.shape[1]:
        return np.zeros((len(x), len(c)), "i8")
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] >= 1 << 62:
        raise ValueError("components are too large for exact distances in 64 bits")
    kind = "f8" if 4 * most * most * x.shape[1] < 1 << 53 else "i8"  # in doubles as long as they are exact
    x, c = x.astype(kind), c.astype(kind)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype("i8")


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row by a full search; ties go to the lower index."""
    code, error = np.zeros(len(x), "i8"), np.zeros(len(x), "i8")
    step = max(1, CELLS // max(1, len(c)))
    for a in range(0, len(x), step):
        d = squared(x[a : a + step], c)
        code[a : a + step] = d.argmin(axis=1)
        error[a : a + step] = d.min(axis=1)
    return code, error


class Balls:
    """A codebook part with each entry's neighbours. radii: upper bounds of the balls' radii, from the entries as they are now."""

    def __init__(self, entries: np.ndarray, radii: np.ndarray | None) -> None:
        self.entries = entries
        if radii is None:
            return
        between = squared(entries, entries)
        self.neighbours, self.gaps = [], []
        for i, gaps in enumerate(between):
            near = np.flatnonzero((gaps <= 4 * radii[i] ** 2) & (np.arange(len(gaps)) != i))
            near = near[np.argsort(gaps[near], kind="stable")]
            self.neighbours.append(near)
            self.gaps.append(gaps[near])

    def moved(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """New entries and squared distances of parts that belonged to the balls of code, and how many distances to others that took."""
        own = x - self.entries[code]
        error, out, worked = (own * own).sum(axis=1), code.copy(), 0
        by = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[by], prepend=-1))
        for rows in np.split(by, starts[1:]):
            if not len(rows):
                continue
            i = int(code[rows[0]])
            ring = np.searchsorted(self.gaps[i], 4 * error[rows], side="right")  # so many neighbours are near enough
            rows, ring = rows[ring > 0], ring[ring > 0]  # the others lie in the stable core
            order = np.argsort(ring, kind="stable")
            rows, ring = rows[order], ring[order]
            at = 0
            while at < len(rows):
                # rings up to twice as wide as the narrowest are searched together
                end = int(np.searchsorted(ring, 2 * ring[at], side="right"))
                end = min(end, at + max(1, CELLS // int(ring[end - 1])))
                some, other = rows[at:end], self.neighbours[i][: ring[end - 1]]
                d = squared(x[some], self.entries[other])
                worked += d.size
                best = np.minimum(d.min(axis=1), error[some])
                first = np.where(d == best[:, None], other, len(self.entries)).min(axis=1)
                out[some] = np.where(error[some] == best, np.minimum(first, i), first)
                error[some] = best
                at = end
        return out, error, worked


def _radii(before: np.ndarray, now: np.ndarray, farthest: np.ndarray) -> np.ndarray:
    """Upper bounds, as integers, of the distances of balls' parts to their moved entries."""
    way = now - before
    return np.ceil(np.sqrt(farthest.astype("f8"))).astype("i8") + np.ceil(np.sqrt((way * way).sum(axis=1).astype("f8"))).astype("i8") + 2


def _vectors(column: pa.ListArray, length: int) -> np.ndarray:
    return column.flatten().to_numpy().astype("i8").reshape(len(column), length)


def vector_codes(embeddings: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label, and entries (the four indexes)."""
    spark = embeddings.sparkSession
    numbers = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    sound = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = embeddings.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), numbers.alias("v"))
    label_type = kept.schema["label"].dataType.simpleString()
    lengths = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    out_schema = f"vec_id long, label {label_type}, v array<long>, entries array<int>, error long"
    if lengths is None:
        empty = spark.createDataFrame([], out_schema)
        return empty.select("vec_id", F.lit("").alias("code"), "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"), "label", "entries")
    length = lengths["n"]
    kept = kept.filter(F.size("v") == length)
    first = [r.v for r in kept.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()]
    at = cuts(length)
    books = [np.array(first, "i8").reshape(len(first), length)[:, a:b] for a, b in zip(at, at[1:])]
    rows, radii = kept.withColumns({"entries": F.lit(None).cast("array<int>"), "error": F.lit(0).cast("long")}), [None] * PARTS
    sums_schema = "part int, entry int, n long, farthest long, sums array<long>"

    def assigned(source: DataFrame, books: list[np.ndarray], radii: list) -> tuple[DataFrame, DataFrame]:
        """Written rows with their nearest entries, and what the entries' parts come to."""
        sent = spark.sparkContext.broadcast((books, radii))
        whole = source.schema.fields[1].dataType
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = pa.schema([("sums", pa.bool_()), ("vec_id", pa.int64()), ("label", to_arrow_type(whole)), ("v", pa.list_(pa.int64())), ("entries", pa.list_(pa.int32())), ("error", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("farthest", pa.int64())])
        names = [f.name for f in arrow]

        def batch_of(columns: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            balls = [Balls(b, r) for b, r in zip(*sent.value)]
            n = [np.zeros(len(b.entries), "i8") for b in balls]
            farthest = [np.zeros(len(b.entries), "i8") for b in balls]
            sums = [np.zeros(b.entries.shape, "i8") for b in balls]
            for batch in batches:
                for start in range(0, batch.num_rows, BLOCK_ROWS):
                    block = batch.slice(start, BLOCK_ROWS)
                    v, known = _vectors(block.column(2), length), block.column(3)
                    old = None if known.null_count else known.flatten().to_numpy().astype("i8").reshape(-1, PARTS)
                    entries, error = np.zeros((len(v), PARTS), "i4"), np.zeros(len(v), "i8")
                    for p, ball in enumerate(balls):
                        x = np.ascontiguousarray(v[:, at[p] : at[p + 1]])
                        code, e = nearest(x, ball.entries) if old is None else ball.moved(x, old[:, p])[:2]
                        entries[:, p], error = code, error + e
                        n[p] += np.bincount(code, minlength=len(n[p]))
                        np.maximum.at(farthest[p], code, e)
                        np.add.at(sums[p], code, x)
                    lists = pa.ListArray.from_arrays(np.arange(0, entries.size + 1, PARTS, "i4"), entries.ravel())
                    yield batch_of({"sums": pa.array(np.zeros(len(v), bool)), "vec_id": block.column(0), "label": block.column(1), "v": block.column(2), "entries": lists, "error": pa.array(error)}, len(v))
            for p in range(PARTS):
                used = np.flatnonzero(n[p])
                flat = pa.ListArray.from_arrays(np.arange(len(used) + 1, dtype="i4") * sums[p].shape[1], sums[p][used].ravel())
                yield batch_of({"sums": pa.array(np.ones(len(used), bool)), "part": pa.array(np.full(len(used), p, "i4")), "entry": pa.array(used.astype("i4")), "n": pa.array(n[p][used]), "farthest": pa.array(farthest[p][used]), "v": flat}, len(used))

        schema = f"sums boolean, {out_schema}, part int, entry int, n long, farthest long"
        path = new_path(spark, "codes")
        assert names == [x.strip().split()[0] for x in schema.split(", ")]
        source.select("vec_id", "label", "v", "entries").mapInArrow(work, schema).write.partitionBy("sums").parquet(path)
        read = lambda sums, ddl: spark.read.schema(ddl).parquet(f"{path}/sums={sums}")
        out = read("false", out_schema)
        out.table_path = path
        return out, read("true", "v array<long>, part int, entry int, n long, farthest long")

    for _ in range(rounds):
        before, (rows, partial) = rows, assigned(rows, books, radii)
        if hasattr(before, "table_path"):
            drop_table(before)
        each = partial.select("part", "entry", "n", "farthest", F.posexplode_outer("v").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.max("farthest").alias("farthest"))
        moved, farthest = [b.copy() for b in books], [np.zeros(len(b), "i8") for b in books]
        for r in each.toLocalIterator():  # ENTRIES x length sums, whatever the table's size
            farthest[r.part][r.entry] = r.farthest
            if r.place is not None:
                moved[r.part][r.entry, r.place] = r.x // r.n
        radii = [_radii(b, m, f) for b, m, f in zip(books, moved, farthest)]
        books = moved
    before, (rows, _) = rows, assigned(rows, books, radii)
    if hasattr(before, "table_path"):
        drop_table(before)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    code = F.concat(*(F.lower(F.lpad(F.hex(F.col("entries")[p]), 2, "0")) for p in range(PARTS)))
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label", "entries")
