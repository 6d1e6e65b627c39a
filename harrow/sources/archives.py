"""tar.xz archives as tables: of members, or of the lines of routed members.

scan() decodes one archive forward only, in bounded memory, and is what all ways to read share: the data source below
(spark.read.format(FORMAT)), which takes a folder, columns and filters, and read_archives(), which takes a frame of paths.
"""

from __future__ import annotations

import codecs
import io
import lzma
import tarfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from harrow.operators.members import route_name, size_limit
from harrow.sources.files import locate

ENDING = ".tar.xz"
MEMBERS = "path string, report_name string, member_idx int, name string, size long, is_reg boolean, kind string, body binary"
LINES = "path string, report_name string, member_idx int, name string, size long, is_reg boolean, kind string, line_no long, line string"
#: Bytes of archives that one task reads (or one archive), of a block of a member, and of a batch of rows; lines of a batch.
TASK_BYTES, BLOCK, BATCH, BATCH_ROWS = 64 << 20, 1 << 20, 16 << 20, 1 << 16
#: Tasks that the data source makes at least, as long as there are archives for them.
MIN_TASKS = 32
#: Of the xz writer: the fastest.
PRESET = 0


class ArchiveError(RuntimeError):
    """The folder of archives is missing or holds none, or an archive can't be read."""


# -- Decoding --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Scan:
    """What to read of an archive.

    limit: largest routed member in bytes; every: also members that aren't routed; lines: LINES instead of MEMBERS; kinds: only
    members of these kinds; columns: those asked for, others stay out; on_corrupt: "fail", or "quarantine": an unreadable
    archive ends with a row of kind "corrupt", whose name is the kind of error and whose body (or line) its message.
    """

    limit: int
    every: bool = False
    lines: bool = False
    kinds: frozenset[str] | None = None
    columns: tuple[str, ...] | None = None
    on_corrupt: str = "fail"

    def schema(self) -> pa.Schema:
        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
        fields = [f.split() for f in (LINES if self.lines else MEMBERS).split(", ")]
        whole = {n: types[t] for n, t in fields}
        return pa.schema([(n, whole[n]) for n in self.columns or whole])


def decoded_lines(stream: BinaryIO, block: int = BLOCK) -> Iterator[list[str]]:
    """Lines of UTF-8 text, split at line feeds alone, block by block with the decoder's state carried over; malformed bytes are replaced.
    Bytes of a character that the end cuts off are a line of their own."""
    decoder, open_ = codecs.getincrementaldecoder("utf-8")("replace"), []
    while raw := stream.read(block):
        first, *rest = decoder.decode(raw).split("\n")
        open_.append(first)
        if rest:
            yield ["".join(open_), *rest[:-1]]
            open_ = [rest[-1]]
    if last := "".join(open_):
        yield [last]
    if cut := decoder.decode(b"", True):
        yield [cut]


def scan(path: str, of: Scan) -> Iterator[pa.RecordBatch]:
    """The archive's rows, small members together in a batch. If lines are asked for, no more than BATCH and a block (or a command) is held
    at a time; other bodies only if they are asked for."""
    schema, report = of.schema(), path.rsplit("/", 1)[-1]
    of_member = pa.schema([f for f in schema if not of.lines or f.name not in ("line_no", "line")])
    rows, spans, numbers, lines, held = [], [], [], [], 0

    def add(row: dict, some: list[str | None], first: int) -> None:
        """A member's lines, numbered from first on."""
        if not rows or rows[-1] is not row:
            rows.append(row)
            spans.append(0)
        spans[-1] += len(some)
        numbers.extend(range(first, first + len(some)))
        lines.extend(some)

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pylist([{c: r[c] for c in of_member.names} for r in rows], of_member)
        if of.lines:  # each of rows stands for a span of lines
            member = pa.array(np.repeat(np.arange(len(rows)), spans))
            columns = {f.name: out.column(f.name).take(member) for f in of_member} | {"line_no": pa.array(numbers, pa.int64()), "line": pa.array(lines, pa.string())}
            out = pa.RecordBatch.from_arrays([columns[c] for c in schema.names], schema=schema)
        for held_back in (rows, spans, numbers, lines):
            held_back.clear()
        return out

    member_idx = -1
    try:
        system, where = locate(path)
        with system.open_input_stream(where) as raw, tarfile.open(fileobj=raw, mode="r|xz") as archive:
            for member_idx, m in enumerate(archive):
                kind = route_name(m.name, m.size, m.isreg(), of.limit)
                if not (kind or of.every) or (of.kinds is not None and kind not in of.kinds):
                    continue
                row = {"path": path, "report_name": report, "member_idx": member_idx, "name": m.name, "size": m.size, "is_reg": m.isreg(), "kind": kind}
                if not of.lines:
                    body = archive.extractfile(m).read() if kind and "body" in schema.names else None
                    rows.append(row | {"body": body})
                    held += len(body or b"")
                else:
                    add(row, [None], -1)
                    if kind == "command" and "line" in schema.names:
                        text = archive.extractfile(m).read().decode("utf-8", "replace")
                        add(row, [text], 0)
                        held += len(text)
                    elif kind == "log" and "line" in schema.names:
                        first = 0
                        for some in decoded_lines(archive.extractfile(m)):
                            add(row, some, first)
                            first += len(some)
                            held += sum(map(len, some))
                            if held > BATCH or len(lines) >= BATCH_ROWS:
                                yield flushed()
                                held = 0
                if held > BATCH or len(rows) >= 4096 or len(lines) >= BATCH_ROWS:
                    yield flushed()
                    held = 0
    except (tarfile.TarError, EOFError, OSError) as e:
        if of.on_corrupt == "fail":
            raise ArchiveError(f"{path}: {e}") from e
        said = f"after member {member_idx}: {e}" if member_idx >= 0 else str(e)
        row = {"path": path, "report_name": report, "member_idx": -1, "name": type(e).__name__, "size": 0, "is_reg": False, "kind": "corrupt", "body": said.encode()}
        if of.lines:
            add(row, [said], -1)
        else:
            rows.append(row)
    if rows:
        yield flushed()


# -- Listing ---------------------------------------------------------------------------------------------------------


def _folder(uri: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path in it, and what uris begin with before that path."""
    system, root = locate(uri.rstrip("/") or "/")
    return system, root, uri.rstrip("/").removesuffix(root)


def _found(infos: Iterable[fs.FileInfo], prefix: str) -> list[tuple[str, int]]:
    return sorted((prefix + i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.endswith(ENDING))


def _below(uri: str, recursive: bool) -> list[fs.FileInfo]:
    system, root, _ = _folder(uri)
    return system.get_file_info(fs.FileSelector(root, recursive=recursive))


def top_level(folder: str) -> tuple[list[tuple[str, int]], list[str]]:
    """Archives (path, bytes) in the folder itself, and its folders."""
    system, root, prefix = _folder(folder)
    if system.get_file_info(root).type != fs.FileType.Directory:
        raise ArchiveError(f"no folder {folder}")
    infos = _below(folder, False)
    return _found(infos, prefix), sorted(prefix + i.path for i in infos if i.type == fs.FileType.Directory)


def list_archives(folder: str) -> list[str]:
    """Paths, in order: files of the folder that end in .tar.xz, and such files anywhere below its folders."""
    own, folders = top_level(folder)
    found = own + [x for f in folders for x in _found(_below(f, True), _folder(f)[2])]
    if not found:
        raise ArchiveError(f"no {ENDING} archives in {folder}")
    return sorted(p for p, _ in found)


def listed(spark: SparkSession, folder: str, deep: int = 2) -> DataFrame:
    """path and bytes of the same archives, listed by tasks: the driver lists the folder itself alone.

    Folders are dealt out anew at each of the first deep levels below it, so that one folder that holds nearly all archives is listed
    by many tasks if it has folders of its own; what lies deeper is listed recursively.
    """
    own, folders = top_level(folder)
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("folder", pa.string())])
    rows = spark.createDataFrame([(p, n, None) for p, n in own] + [(None, None, f) for f in folders], "path string, bytes long, folder string")

    def step(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["folder"] is None:
                        yield pa.RecordBatch.from_pylist([r], schema)
                        continue
                    infos, prefix = _below(r["folder"], last), _folder(r["folder"])[2]
                    more = [] if last else [{"folder": prefix + i.path} for i in infos if i.type == fs.FileType.Directory]
                    yield pa.RecordBatch.from_pylist([{"path": p, "bytes": n} for p, n in _found(infos, prefix)] + more, schema)

        return run

    for level in range(deep):
        rows = rows.repartition(F.coalesce("folder", "path")).mapInArrow(step(level == deep - 1), "path string, bytes long, folder string")
    return rows.select("path", "bytes")


# -- Reading ---------------------------------------------------------------------------------------------------------


def read_archives(paths: DataFrame, of: Scan, tasks: int) -> DataFrame:
    """MEMBERS or LINES of the archives at paths (path, ...), dealt evenly to so many tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from scan(path, of)

    return paths.select("path").repartition(max(1, tasks)).mapInArrow(read, LINES if of.lines else MEMBERS)


FORMAT = "tar_xz_archives"


class ArchiveSource(DataSource):
    """spark.read.format(FORMAT).option(...).load(folder), after register(spark).

    Options: maxMb (25), every (false: routed members only), content ("members" or "lines"), onCorrupt ("fail" or
    "quarantine"). A schema given to the reader picks columns: bodies and lines that aren't asked for aren't taken out of the archive.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES if self.options.get("content") == "lines" else MEMBERS

    def reader(self, schema: StructType) -> ArchiveReader:
        o = self.options
        known = [f.split()[0] for f in self.schema().split(", ")]
        if unknown := [n for n in schema.names if n not in known]:
            raise ValueError(f"no such columns: {', '.join(unknown)}")
        of = Scan(size_limit(int(o.get("maxMb", 25))), o.get("every", "false").lower() == "true", o.get("content") == "lines", None, tuple(schema.names), o.get("onCorrupt", "fail"))
        return ArchiveReader(o["path"], of)


class ArchivePaths(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class ArchiveReader(DataSourceReader):
    """Filters on kind, report_name and path (equal to, or one of) are taken on: archives and members that they rule out aren't read."""

    def __init__(self, folder: str, of: Scan) -> None:
        self.folder, self.of, self.allowed = folder, of, {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if column == "kind" and isinstance(f, IsNotNull):
                self.of = replace(self.of, every=False)
            elif column in ("report_name", "path") and isinstance(f, IsNotNull):
                continue  # they never are
            elif column in ("kind", "report_name", "path") and isinstance(f, (EqualTo, In)):
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.allowed[column] = self.allowed.get(column, values) & values
            else:
                yield f
        if "kind" in self.allowed:
            self.of = replace(self.of, kinds=self.allowed["kind"])

    def partitions(self) -> list[InputPartition]:
        """Archives together up to TASK_BYTES, or less if that leaves fewer than MIN_TASKS."""
        own, folders = top_level(self.folder)
        found = own + [x for f in folders for x in _found(_below(f, True), _folder(f)[2])]
        of_path, of_report = self.allowed.get("path"), self.allowed.get("report_name")
        found = [(p, n) for p, n in found if (of_path is None or p in of_path) and (of_report is None or p.rsplit("/", 1)[-1] in of_report)]
        out, held, most = [], 0, min(TASK_BYTES, sum(n for _, n in found) // MIN_TASKS)
        for path, n in sorted(found):
            if not out or held + n > most:
                out.append([])
                held = 0
            out[-1].append(path)
            held += n
        return [ArchivePaths(p) for p in out]

    def read(self, partition: ArchivePaths) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            for batch in scan(path, self.of):
                if self.of.kinds is not None and "kind" in batch.schema.names and "corrupt" not in self.of.kinds:
                    batch = batch.filter(pa.compute.not_equal(batch.column("kind"), "corrupt"))
                yield batch


def register(spark: SparkSession) -> None:
    """Make FORMAT known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def copy_archives(paths: DataFrame, out: str, tasks: int) -> DataFrame:
    """Copy the archives at paths (path, ...), whose names differ, into the folder out by so many tasks; returns path, bytes of the copies.

    A block is held at a time, and a copy gets its name once it is whole.
    """
    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64())])

    def copy(path: str) -> dict:
        (source, origin), target = locate(path), f"{out}/{path.rsplit('/', 1)[-1]}"
        system, where = locate(target)
        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
        part, n = f"{where}.{uuid.uuid4().hex}.part", 0
        with source.open_input_stream(origin) as raw, system.open_output_stream(part) as copied:
            while block := raw.read(BLOCK):
                copied.write(block)
                n += len(block)
        system.move(part, where)
        return {"path": target, "bytes": n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([copy(path) for path in batch.column(0).to_pylist()], schema)

    return paths.select("path").repartition(max(1, tasks)).mapInArrow(run, "path string, bytes long")


def write_archives(files: DataFrame, out: str) -> DataFrame:
    """Write files (report_name, name, body, rank) as archives under out, members in rank order; returns path, members.

    An archive's files meet in one task, so report_name has to bound their number.
    """

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        path = f"{out}/{key[0].as_py()}"
        system, where = locate(path)
        system.create_dir(where.rsplit("/", 1)[0], recursive=True)
        part = f"{where}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(part) as raw, lzma.open(raw, "wb", preset=PRESET) as packed, tarfile.open(fileobj=packed, mode="w|") as archive:
            for name, body in zip(rows.column("name").to_pylist(), rows.column("body").to_pylist()):
                m = tarfile.TarInfo(name)
                m.size = len(body or b"")
                archive.addfile(m, io.BytesIO(body or b""))
        system.move(part, where)
        return pa.table({"path": [path], "members": [rows.num_rows]})

    # a number of its own: by their bytes few tasks would do, but packing takes its time
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = files.select("report_name", "name", "rank", F.col("body").cast("binary").alias("body")).repartition(tasks, "report_name")
    return packed.groupBy("report_name").applyInArrow(write, "path string, members long")
