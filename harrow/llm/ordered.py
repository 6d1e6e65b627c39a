"""SHA-256 of what the rows of a key say in order, however many rows one key has.

Rows are dealt by ranges of key and order, so a hot key spreads over many tasks. Keys that lie within one range are hashed there, as
a stream. What a range's first and last key say may go on in a neighbour: it is handed on, in the row itself or, beyond inline
bytes, as a file in the shared folder, and a key's stretches are then hashed one after the other by one task, which holds a
block at a time (SHA-256 can't be put together from parts).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.sources.files import locate

from .common import new_path, table
from .files import write_once

INLINE, BLOCK = 1 << 20, 4 << 20


class _Stretch:
    """What one key says within a range: its digest, and its bytes for handing on, in a file once they are more than inline."""

    def __init__(self, path: str, separator: bytes, inline: int) -> None:
        self.path, self.separator, self.inline, self.begun = path, separator, inline, False
        self.hash, self.held, self.size, self.file, self.files = hashlib.sha256(), [], 0, None, ExitStack()

    def add(self, x: bytes) -> None:
        x = self.separator + x if self.begun and self.separator else x
        self.begun = True
        self.hash.update(x)
        self.held.append(x)
        self.size += len(x)
        if self.size > self.inline:
            self.file = self.file or self.files.enter_context(write_once(self.path))
            self.file.write(b"".join(self.held))
            self.held, self.size = [], 0

    def close(self) -> dict:
        """What is handed on: data or path."""
        if self.file:
            self.file.write(b"".join(self.held))
        self.files.close()
        return {"_path": self.path} if self.file else {"_data": b"".join(self.held)}


def ordered_digests(df: DataFrame, keys: list[str], order: list[str], payloads: list[str], separator: bytes = b"", inline: int = INLINE) -> DataFrame:
    """keys and, under each payload's name, the lowercase hex SHA-256 of its values in order, with the separator between.

    Keys and order are columns of type long without nulls, payloads binary or string without nulls.
    """
    spark = df.sparkSession
    folder = new_path(spark, "stretches")
    sorted_ = df.select(*keys, *order, *payloads).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).select(*keys, *(F.col(p).cast("binary") for p in payloads))
    data_schema = ", ".join(f"{p} string, {p}_data binary, {p}_path string" for p in payloads)
    key_schema = ", ".join(f"{k} long" for k in keys)
    spanning = pa.schema([*((k, pa.int64()) for k in keys), ("part", pa.int32()), *((f"{p}{e}", t) for p in payloads for e, t in (("", pa.string()), ("_data", pa.binary()), ("_path", pa.string())))])

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, rows, now, open_, names = TaskContext.get().partitionId(), [], None, None, itertools.count()

        def closed(hand_on: bool) -> None:
            out = dict(zip(keys, now)) | {"part": part}
            for p, s in zip(payloads, open_):
                left = s.close()
                out |= {p + k: v for k, v in left.items()} if hand_on else {p: s.hash.hexdigest()}
            rows.append(out)

        first = True
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                key = values[: len(keys)]
                if key != now:
                    if open_ is not None:
                        closed(first)
                        first = False
                    now, open_ = key, [_Stretch(f"{folder}/{part:06d}-{next(names)}", separator, inline) for _ in payloads]
                for s, x in zip(open_, values[len(keys) :]):
                    s.add(x)
            if len(rows) > 4096:
                yield pa.RecordBatch.from_pylist(rows, spanning)
                rows.clear()
        if open_ is not None:
            closed(True)
        yield pa.RecordBatch.from_pylist(rows, spanning)

    def together(key: tuple, stretches_: pa.Table) -> pa.Table:
        """Bounded: a row for each range that the key reaches into, in range order."""
        hashes = [hashlib.sha256() for _ in payloads]
        for i, r in enumerate(stretches_.sort_by("part").to_pylist()):
            for h, p in zip(hashes, payloads):
                if i:
                    h.update(separator)
                if r[f"{p}_path"] is None:
                    h.update(r[f"{p}_data"])
                    continue
                system, where = locate(r[f"{p}_path"])
                with system.open_input_stream(where) as f:
                    while block := f.read(BLOCK):
                        h.update(block)
        return pa.table({k: [x.as_py()] for k, x in zip(keys, key)} | {p: [h.hexdigest()] for p, h in zip(payloads, hashes)}, pa.schema([*((k, pa.int64()) for k in keys), *((p, pa.string()) for p in payloads)]))

    found = table(sorted_.mapInArrow(stretches, f"{key_schema}, part int, {data_schema}"), "digests")
    inner = found.filter(F.col(payloads[0]).isNotNull()).select(*keys, *payloads)
    outer = found.filter(F.col(payloads[0]).isNull()).groupBy(*keys).applyInArrow(together, f"{key_schema}, " + ", ".join(f"{p} string" for p in payloads))
    return inner.unionByName(outer)
