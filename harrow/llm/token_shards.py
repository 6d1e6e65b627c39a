"""Training-order materialisation of token ids in fixed-stride binary shards.

Documents are tokenised (byte-level BPE) and cut into sequences of `seq_len` ids; the last of a document may be shorter
and is padded in the file. Every sequence has an ordinal (documents in the order of the input's partitions), and a keyed
Feistel permutation with cycle-walking maps the ordinals one to one to slots of the training order. A shard holds
`per_shard` slots; a record has a fixed stride, so slot s is at byte (s mod per_shard) * stride of shard s // per_shard,
and a reader can resume anywhere with one seek.

Two passes over the input: the first counts sequences a partition (the only thing the driver gathers: a row a partition),
the second makes the records and sends them, compressed by shard, to the task that writes the shard. Both passes must see the
same partitions; a checksum of each partition's documents is compared, and the job stops rather than write a wrong order.
Pass a table or files; a frame whose rows can move between runs should be written first.

Record: doc_id int64, seq_no int32, n_tokens int32, then seq_len uint16 ids (0-padded), little-endian.

Defined results: a null or empty text has one sequence with the end-of-text id only, as every document ends with it; a null
doc_id is written as -1 << 63 and read back as null; repeated rows are sequences of their own; no rows give no shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, table
from .files import locate, write_once
from .token_counts import PRETOKEN, SPACE

NO_ID = -(1 << 63)


class Feistel:
    """Permutation of range(n) under a key: four balanced rounds on the next even power of two, walked back into range."""

    def __init__(self, n: int, key: int) -> None:
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        digest = hashlib.sha256(key.to_bytes(16, "little", signed=True)).digest()
        self.keys = [np.uint64(int.from_bytes(digest[8 * i : 8 * i + 8], "little")) for i in range(4)]

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _once(self, x: np.ndarray, keys: list) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & np.uint64((1 << self.half) - 1)
        for k in keys:
            left, right = right, left ^ self._mix(right, k)
        return (right << np.uint64(self.half)) | left

    def _walk(self, x: np.ndarray, keys: list) -> np.ndarray:
        x = self._once(np.asarray(x, "u8"), keys)
        while (out := np.nonzero(x >= self.n)[0]).size:
            x[out] = self._once(x[out], keys)
        return x

    def slots(self, ordinals: np.ndarray) -> np.ndarray:
        return self._walk(ordinals, self.keys)

    def ordinals(self, slots: np.ndarray) -> np.ndarray:
        """The inverse: the halves change places before and after, so the rounds run backwards."""
        return self._walk(slots, self.keys[::-1])


class Ids:
    """Compiled vocabulary. Of a block of texts each different word is encoded once, by the vocabulary's library."""

    def __init__(self, ranks: bytes) -> None:
        import base64
        import re

        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        if max(table.values()) >= 65535:
            raise ValueError("ids don't fit in 16 bits")
        self.end = len(table)
        self.last = np.array([self.end], "<u2")
        self.encoding = tiktoken.Encoding("shards", pat_str=PRETOKEN, mergeable_ranks=table, special_tokens={})
        #: Whether an id's token begins with a space.
        self.spaced = np.zeros(self.end, bool)
        self.spaced[[i for token, i in table.items() if token.startswith(b" ")]] = True
        #: The same, with all of a text as one pre-token.
        self.piece = tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=table, special_tokens={})
        self.runs = re.compile(f"([{SPACE}]{{1000,}})").split
        self.odd = re.compile(r" (?:\s|\Z)").search

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text. The library can't match white space that runs on for a million characters or so; texts with such runs are cut
        there. All of a run is one pre-token, but for its last character if a word follows."""
        try:
            return self._ids(self.encoding, text)
        except ValueError:
            first, *rest = self.runs(text)
        out = [self._ids(self.encoding, first)]
        for run, words in zip(rest[::2], rest[1::2]):
            out.append(self._ids(self.piece, run[:-1] if words else run))
            out.append(self._ids(self.encoding, run[-1] + words if words else ""))
        return np.concatenate(out)

    def _ids(self, encoding, text: str) -> np.ndarray:
        return encoding.encode_to_numpy(text, disallowed_special=()).astype("<u2")

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text and the end mark. A space before a word always begins a pre-token, so texts whose spaces all stand before words
        are cut there, and the words encoded together: none has a space inside, so each begins at a token that begins with one. The
        other texts are encoded whole."""
        strings = texts.to_pylist()
        plain = [i for i, t in enumerate(strings) if t and not self.odd(t)]
        out = [self.last if not t else None for t in strings]
        cut = pc.split_pattern(texts.take(pa.array(plain, pa.int64())), " ")
        ends = cut.offsets.to_numpy()
        later = np.ones(ends[-1], bool)
        later[ends[:-1]] = False  # a text's first word has no space before it
        words = cut.flatten().filter(pa.array(later)).dictionary_encode()
        body, first = np.zeros(0, "<u2"), np.zeros(1, "i8")
        if len(words):
            together = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), " ")
            ids = self.whole(" " + together[0].as_py())
            begin = np.flatnonzero(self.spaced[ids])
            which = words.indices.to_numpy()
            size = np.diff(begin, append=len(ids))[which]
            first = np.concatenate([first, np.cumsum(size)])
            body = ids[np.repeat((begin[which] - first[:-1]).astype("i4"), size) + np.arange(first[-1], dtype="i4")]
        places = first[ends - np.arange(len(ends))].tolist()
        for i, a, b in zip(plain, places, places[1:]):
            out[i] = np.concatenate([self.whole(strings[i].split(" ", 1)[0]), body[a:b], self.last])
        return [np.concatenate([self.whole(t), self.last]) if x is None else x for t, x in zip(strings, out)]


def ids_of(ranks: bytes) -> Ids:
    """Made once a worker process."""
    return held(("ids", ranks), lambda: Ids(ranks))


def record_type(seq_len: int) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("seq_no", "<i4"), ("n_tokens", "<i4"), ("ids", "<u2", (seq_len,))])


def _blocks(batches: Iterator[pa.RecordBatch], size: int = 16 << 20) -> Iterator[tuple[list, pa.Array]]:
    for batch in batches:
        n = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, n):
            part = batch.slice(start, n)
            yield part.column(0).to_pylist(), part.column(1)


def write_shards(documents: DataFrame, ranks_path: str, out: str, key: int = 20240229, seq_len: int = 256, per_shard: int = 32_768) -> DataFrame:
    """Write the shards under out; returns the written manifest: shard, path, first_slot, n, stride, seq_len."""
    spark = documents.sparkSession
    with open(ranks_path, "rb") as f:  # about 1 MB, the same whatever the input
        ranks = spark.sparkContext.broadcast(f.read())
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def count(batches):
        from pyspark import TaskContext

        ids, n, check = ids_of(ranks.value), 0, hashlib.sha256()
        for doc_ids, texts in _blocks(batches):
            for doc_id, tokens in zip(doc_ids, map(len, ids.encode(texts))):
                n += -(-tokens // seq_len)
                check.update(b"%d,%d;" % (NO_ID if doc_id is None else doc_id, tokens))
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n], "check": [check.hexdigest()]}, pa.schema({"part": pa.int32(), "n": pa.int64(), "check": pa.string()}))

    counted = sorted(docs.mapInArrow(count, "part int, n long, check string").collect())  # a row a partition of the input
    total, first = 0, {}
    for r in counted:
        first[r.part] = (total, r.check)
        total += r.n
    first, order = spark.sparkContext.broadcast(first), Feistel(total, key)
    record = record_type(seq_len)

    def records(batches):
        from pyspark import TaskContext

        ids, pack, check = ids_of(ranks.value), zstandard.ZstdCompressor(level=1), hashlib.sha256()
        ordinal, expected = first.value[TaskContext.get().partitionId()]
        schema = pa.schema({"shard": pa.int64(), "rows": pa.binary()})
        for doc_ids, texts in _blocks(batches):
            parts = []
            for doc_id, tokens in zip(doc_ids, ids.encode(texts)):
                doc_id = NO_ID if doc_id is None else doc_id
                check.update(b"%d,%d;" % (doc_id, len(tokens)))
                k = -(-len(tokens) // seq_len)
                rows = np.zeros(k, record)
                rows["doc_id"], rows["seq_no"], rows["n_tokens"] = doc_id, np.arange(k), seq_len
                rows["n_tokens"][-1] = len(tokens) - (k - 1) * seq_len
                padded = np.zeros(k * seq_len, "<u2")
                padded[: len(tokens)] = tokens
                rows["ids"] = padded.reshape(k, seq_len)
                parts.append(rows)
            rows = np.concatenate(parts)
            slots = order.slots(np.arange(ordinal, ordinal + len(rows)))
            ordinal += len(rows)
            by = np.argsort(slots, kind="stable")
            slots, rows = slots[by], rows[by]
            shards, at = np.unique(slots // np.uint64(per_shard), return_index=True)
            ends = [*at[1:], len(rows)]
            yield pa.RecordBatch.from_pydict({"shard": shards.astype("i8"), "rows": [pack.compress(slots[a:b].astype("<u8").tobytes() + rows[a:b].tobytes()) for a, b in zip(at, ends)]}, schema)
        if check.hexdigest() != expected:
            raise RuntimeError("the input's partitions have changed between the two passes; write it to a table first")

    def write(key_: tuple, rows: pa.Table) -> pa.Table:
        """One shard: at most per_shard records, whatever the input's size."""
        shard, unpack = key_[0].as_py(), zstandard.ZstdDecompressor()
        size = min(per_shard, total - shard * per_shard)
        whole, filled = np.zeros(size, record), 0
        for blob in rows.column("rows"):
            raw = unpack.decompress(blob.as_py())
            n = len(raw) // (8 + record.itemsize)
            whole[(np.frombuffer(raw, "<u8", n) - np.uint64(shard * per_shard)).astype("i8")] = np.frombuffer(raw, record, n, 8 * n)
            filled += n
        if filled != size:
            raise RuntimeError(f"shard {shard} has {filled} of {size} sequences")
        path = f"{out}/shard-{shard:08d}.bin"
        with write_once(path) as f:
            f.write(whole.tobytes())
        return pa.table({"shard": [shard], "path": [path], "first_slot": [shard * per_shard], "n": [size], "stride": [record.itemsize], "seq_len": [seq_len]})

    sent = docs.mapInArrow(records, "shard long, rows binary")
    manifest = sent.groupBy("shard").applyInArrow(write, "shard long, path string, first_slot long, n long, stride long, seq_len long")
    return table(manifest, "manifest")


def read_slots(spark: SparkSession, manifest: DataFrame, start: int = 0, stop: int | None = None, rows_at_once: int = 4096) -> DataFrame:
    """slot, doc_id, seq_no, n_tokens, shard, byte_offset, token_ids of the slots from start to stop, range-read."""
    # a number of its own, as ranges are short rows that stand for much: by their bytes all of them would go to one task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stop = F.lit(stop) if stop is not None else F.col("first_slot") + F.col("n")
    ranges = (
        manifest.withColumn("a", F.greatest("first_slot", F.lit(start))).withColumn("b", F.least(F.col("first_slot") + F.col("n"), stop)).filter("a < b")
        .withColumn("a", F.explode(F.sequence("a", F.col("b") - 1, F.lit(rows_at_once).cast("long")))).withColumn("b", F.least("b", F.col("a") + rows_at_once))
        .select("path", "shard", "first_slot", "stride", "seq_len", "a", "b").repartition(tasks, "path", "a")
    )

    def read(batches):
        for batch in batches:
            for r in batch.to_pylist():
                record = record_type(r["seq_len"])
                system, path = locate(r["path"])
                with system.open_input_file(path) as f:
                    f.seek((r["a"] - r["first_slot"]) * r["stride"])
                    raw = f.read((r["b"] - r["a"]) * r["stride"])
                rows = np.frombuffer(raw, record)
                n = rows["n_tokens"].astype("i8")
                offsets = np.concatenate([[0], np.cumsum(n)]).astype("i4")
                ids = rows["ids"][np.arange(r["seq_len"]) < n[:, None]].astype("i4")
                slot = np.arange(r["a"], r["b"])
                yield pa.RecordBatch.from_pydict({
                    "slot": slot, "doc_id": pa.array(rows["doc_id"], mask=rows["doc_id"] == NO_ID), "seq_no": rows["seq_no"].astype("i8"), "n_tokens": n,
                    "shard": np.full(len(rows), r["shard"]), "byte_offset": (slot - r["first_slot"]) * r["stride"], "token_ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)),
                })

    return ranges.mapInArrow(read, "slot long, doc_id long, seq_no long, n_tokens long, shard long, byte_offset long, token_ids array<int>")
