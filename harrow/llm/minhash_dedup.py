"""Near-duplicates by improved consistent weighted sampling (ICWS) over TF-IDF weighted five-word shingles.

1. Documents with equal words form a class (its smallest doc_id stands for it); only classes go on.
2. Weights: TF-IDF, (1 + ln tf) (1 + ln(N / max(df, N / COMMON))) / (1 + ln COMMON). N and the document frequencies df come from all
   shingles of all documents with words, of which each counts by its share, and a family of copies shares one count among its
   members: in a group of copies that holds a third of all documents the shared shingles would otherwise be common and lose their
   weight, while each copy's own edits keep theirs, so members would fall below the threshold just because there are many. A
   document's anchors are its ANCHORS shingles with the smallest hashes; if more than a quarter of them are held by m documents or
   more each, its share is 1 / m for the largest such m, whatever the layout of the input and the order of its rows. A passage that
   documents have in common takes nothing from them, unless it gives them more than a quarter of their anchors. Shares are whole
   numbers of 1 / UNIT, so that sums don't depend on their order. Counts over all tasks are kept by two hashes of the shingle in
   tables of COUNTERS each (whose size doesn't depend on the input; the smaller count less what rare shingles add on average is the
   frequency), so a weight is a function of the shingle alone, the same for all documents.
3. ICWS: BANDS * ROWS samples; documents whose ROWS samples of a band agree share a bucket. At similarity 0.8 a pair
   misses all buckets with probability (1 - 0.8^3)^10 < 0.001.
4. Verification by exact weighted Jaccard similarity, without all pairs of a bucket: every member is compared with its
   bucket's pivot (smallest doc_id); linked documents form components. Then members of different components are compared, unless
   a bound rules them out: their distances from the pivot differ by more than the threshold's (1 - similarity is a metric), their
   weights differ by too much, or the BITS parities of their rare shingles do (each bit that differs is at least one such shingle, so
   at least its weight, that only one of them has). So every pair of a bucket is compared, ruled out exactly, or already in one
   component.

Defined results: null and word-free texts link with nothing; a text of one to four words has one shingle, all of it; a
null doc_id links with nothing, forms its own group and is kept; doc_id is the key: rows that repeat one are one document (of
those of a kept doc_id, one stays for each different text). Extra columns pass unchanged.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BYTES, connected_components, drop_table, held, table, words

SHINGLE, SIMILARITY, BANDS, ROWS, COMMON = 5, 0.8, 10, 3, 500
#: Anchors of a document, and what a document that has no copies counts for.
ANCHORS, UNIT = 8, 1 << 30
#: Counters of a table of shingle counts, sent in CHUNK at a time.
COUNTERS, CHUNK = 1 << 20, 1 << 14
#: Parities kept of a document's rare shingles, 64 a column.
BITS = 512
#: Bytes of a text whose words are hashed at a time (more if a word is longer).
PIECE = 1 << 16
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: A word's hash is the sum of a drawn number for each byte times a power of an odd number, which has an inverse modulo 2^64.
_BYTE = np.random.default_rng(11).integers(0, 1 << 64, 256, "u8")
_ODD = 0xD1342543DE82EF95


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _ODD and of its inverse, modulo 2^64."""
    steps = np.ones((2, n), "u8")
    steps[:, 1:] = np.array([[_ODD], [pow(_ODD, -1, 1 << 64)]], "u8")
    up, down = np.cumprod(steps, axis=1, dtype="u8")
    return up, down


@functools.cache
def _piece_powers() -> tuple[np.ndarray, np.ndarray]:
    return _power_table(PIECE)


def word_hashes(text: bytes | None) -> np.ndarray:
    """A 64-bit hash of each word of the text, in order; equal words have equal hashes in all texts.

    Hashes come from running sums over a piece of the text, so that no word becomes an object of its own.
    """
    low, out, start = text.translate(WORD_BYTES) if text else b"", [np.zeros(0, "u8")], 0
    while start < len(low):
        end = low.find(b" ", start + PIECE - 1) if len(low) - start > PIECE else len(low)
        end = len(low) if end < 0 else end
        piece = np.frombuffer(low, "u1", end - start, start)
        letter = np.zeros(len(piece) + 2, "?")
        np.not_equal(piece, 32, out=letter[1:-1])
        edges = np.flatnonzero(letter[1:] != letter[:-1])
        up, down = _piece_powers() if len(piece) <= PIECE else _power_table(len(piece))
        sums = np.zeros(len(piece) + 1, "u8")
        np.cumsum(_BYTE[piece] * up[: len(piece)], out=sums[1:])
        begins, ends = edges[::2], edges[1::2]
        out.append(_mix((sums[ends] - sums[begins]) * down[begins]))
        start = end
    return out[1] if len(out) == 2 else np.concatenate(out)


def shingles(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of the text's different shingles, and how often each occurs."""
    h = word_hashes(text)
    if not len(h):
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, "u8")
    for i in range(k):
        out = out * _MUL + h[i : i + n]
    out = np.sort(_mix(out))
    start = np.nonzero(np.concatenate([[True], out[1:] != out[:-1]]))[0]
    return out[start], np.diff(np.append(start, n))


def counters(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's place in the two tables of counts."""
    return (hashes & np.uint64(COUNTERS - 1)).astype("i4"), (hashes >> np.uint64(40) & np.uint64(COUNTERS - 1)).astype("i4")


class Weights:
    """TF-IDF weights of shingles from the tables of counts of n_docs documents."""

    def __init__(self, n_docs: int, tables: np.ndarray) -> None:
        floor = max(n_docs, 1) / COMMON
        df = np.maximum(tables - tables.mean(axis=1, keepdims=True), floor)
        #: ln N / df, in steps that are fine enough for weights to within 0.3 % and leave few different weights.
        idf = np.round(np.log(max(n_docs, 1) / np.minimum(df, max(n_docs, 1))) / np.log(COMMON) * 256).astype("u2")
        self.steps = idf
        self.weight = ((1 + np.arange(257) / 256 * np.log(COMMON)) / (1 + np.log(COMMON))).astype("f4")
        self.rare = self.weight[256]

    def is_rare(self, hashes: np.ndarray) -> np.ndarray:
        """Whether a shingle weighs the most, which is at least `rare` wherever it stands."""
        a, b = counters(hashes)
        return np.maximum(self.steps[0][a], self.steps[1][b]) == 256

    def of(self, hashes: np.ndarray, tf: np.ndarray) -> np.ndarray:
        a, b = counters(hashes)
        out = self.weight[np.maximum(self.steps[0][a], self.steps[1][b])]
        if len(tf) and tf.max() > 1:
            out = out * (1 + np.log(np.minimum(tf, 1 << 20))).astype("f4")
        return out


class Sampler:
    """ICWS whose random variables of a (shingle, sample) come from its hash: r and beta from one table of drawn pairs, ln c from a
    table of gamma quantiles."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, 1 << 16).astype("f4")
        self.beta = rng.random(1 << 16).astype("f4")
        quantiles = np.sort(rng.gamma(2, 1, 1 << 22))[2::4]  # 2^20 of them
        self.log_c = np.log(quantiles).astype("f4")
        self.salts = rng.integers(1, 1 << 62, samples).astype("u8") * np.uint64(2) + np.uint64(1)
        self.plain: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    def _of_weight(self, weight: float) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of the table, ln of what divides c, and t, at this weight."""
        if weight not in self.plain:
            t = np.floor(np.log(np.float32(weight)) / self.r + self.beta)
            self.plain[weight] = (self.r * (t - self.beta) + self.r, t.astype("i8").astype("u8"))
        return self.plain[weight]

    def signatures(self, hashes: np.ndarray, weights: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(documents, samples) signatures; hashes and weights of all documents in a row, counts shingles of each."""
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        values, kind = np.unique(weights, return_inverse=True)
        main = int(np.argmax(np.bincount(kind)))
        other = np.nonzero(kind != main)[0]
        log_y, t_main = self._of_weight(float(values[main]))
        r, beta, log_w = self.r, self.beta, np.log(weights[other])
        out = np.empty((len(counts), len(self.salts)), "u8")
        owner = np.repeat(np.arange(len(counts)), counts)
        for k, salt in enumerate(self.salts):
            x = hashes * salt
            x ^= x >> np.uint64(29)
            x *= _MUL
            x ^= x >> np.uint64(32)
            pair = (x & np.uint64(0xFFFF)).astype("i4")
            log_a = self.log_c[((x >> np.uint64(16)) & np.uint64(0xFFFFF)).astype("i4")] - log_y[pair]
            if other.size:
                p = pair[other]
                t = np.floor(log_w / r[p] + beta[p])
                log_a[other] = self.log_c[((x[other] >> np.uint64(16)) & np.uint64(0xFFFFF)).astype("i4")] - (r[p] * (t - beta[p]) + r[p])
            # order-preserving bits of log_a over bits of the hash, so that one minimum finds the sample
            bits = log_a.view("u4")
            bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
            key = (bits.astype("u8") << np.uint64(32)) | (x >> np.uint64(32))
            least = np.minimum.reduceat(key, starts)
            at = np.nonzero(key == least[owner])[0]
            at = at[np.unique(owner[at], return_index=True)[1]]
            t = t_main[pair[at]].copy()
            for j in np.nonzero(kind[at] != main)[0]:
                i = at[j]
                t[j] = np.int64(np.floor(np.log(weights[i]) / r[pair[i]] + beta[pair[i]])).astype("u8")
            out[:, k] = _mix(hashes[at] + t * _MUL + np.uint64(k))
        return out


def sampler() -> Sampler:
    return held(("icws",), Sampler)


def _text_blocks(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[tuple[list, list]]:
    for batch in batches:
        n = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, n):
            part = batch.slice(start, n)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def _scan(docs: DataFrame) -> DataFrame:
    """id, a digest of the document's words (null without words), and its anchors."""
    schema = pa.schema({"id": pa.int64(), "data": pa.binary(), "anchors": pa.list_(pa.int64())})

    def run(batches):
        for ids, texts in _text_blocks(batches):
            fps, anchors = [], []
            for text in texts:
                w = words(text)
                fps.append(xxhash.xxh3_128_digest(b" ".join(w)) if w else None)
                anchors.append(shingles(text)[0][:ANCHORS].view("i8"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.binary()), pa.array(anchors, pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(run, "id long, data binary, anchors array<long>")


def _shares(scanned: DataFrame, repeated: bool) -> tuple[DataFrame, DataFrame]:
    """of, share: ids of the documents that count for less than UNIT, and what they count for. And the table that it reads."""
    held_by = scanned.select("id", F.explode("anchors").alias("anchor"), F.size("anchors").alias("own"))
    if repeated:  # the anchors of all rows of an id, in unsigned order
        one = Window.partitionBy("id")
        rank = F.row_number().over(one.orderBy(F.col("anchor").bitwiseXOR(F.lit(-1 << 63))))
        first = held_by.select("id", "anchor").distinct().withColumn("rank", rank).filter(F.col("rank") <= ANCHORS)
        held_by = first.select("id", "anchor", F.count("*").over(one).alias("own"))
    counted = held_by.groupBy("anchor").agg(F.count("*").alias("holders")).filter("holders > 1")
    shared = table(counted.select(F.col("anchor").alias("same"), "holders"), "shared")
    # a plain join, as an anchor can be hot; merged at every size, as the table grows with the documents
    found = held_by.join(shared.hint("merge"), F.col("anchor") == F.col("same")).groupBy("id")
    sizes = found.agg(F.sort_array(F.collect_list("holders"), asc=False).alias("sizes"), F.first("own").alias("own"))
    size = F.get("sizes", F.expr("cast(own div 4 as int)"))  # null if too few anchors are held by others
    shares = sizes.select(F.col("id").alias("of"), size.alias("size")).filter("size is not null")
    return shares.select("of", F.greatest(F.expr(f"{UNIT} div size"), F.lit(1)).alias("share")), shared


def _counts(docs: DataFrame) -> DataFrame:
    """chunk, n, data: chunks of the counts that each task makes, and its documents; docs: share, text. n and counts are in UNITs' parts."""
    schema = pa.schema({"chunk": pa.int32(), "n": pa.int64(), "data": pa.binary()})

    def run(batches):
        counts, n = np.zeros((2, COUNTERS), "u8"), 0
        for shares, texts in _text_blocks(batches):
            found = [shingles(text)[0] for text in texts]
            n += sum(share for share, hashes in zip(shares, found) if len(hashes))
            each = np.repeat(np.array(shares, "f8"), [len(hashes) for hashes in found])
            for row, at in zip(counts, counters(np.concatenate(found))):
                row += np.bincount(at, each, COUNTERS).astype("u8")  # whole numbers far below 2^53
        if n:
            chunks = counts.reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array([n] * len(chunks), pa.int64()), pa.array([zlib.compress(c.astype("<u8").tobytes(), 1) for c in chunks], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "chunk int, n long, data binary")


def weights_of(docs: DataFrame, scanned: DataFrame) -> Weights:
    """The weights of all shingles. docs: id, text; scanned: _scan() of them."""
    repeated = not scanned.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    found, shared = _shares(scanned, repeated)
    shares = table(found, "shares")
    every = docs.dropDuplicates(["id", "text"]) if repeated else docs  # rows that repeat are one document
    # sorted and merged at every size: a table of ids grows with the documents
    every = every.join(shares.hint("merge"), F.col("id") == F.col("of"), "left")
    out = Weights(*_counted(_counts(every.select(F.coalesce("share", F.lit(UNIT)).alias("share"), "text"))))
    for old in (shared, shares):
        drop_table(old)
    return out


def _counted(counts: DataFrame) -> tuple[float, np.ndarray]:
    """Counted documents, and the two tables of counts: sums over tasks, in two levels, so that no task adds up very many."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, "u8")
        for data in rows.column("data"):
            total += np.frombuffer(zlib.decompress(data.as_py()), "<u8")
        return pa.table({"chunk": pa.array([rows.column("chunk")[0].as_py()], pa.int32()), "n": [sum(rows.column("n").to_pylist())], "data": [zlib.compress(total.astype("<u8").tobytes(), 1)]})

    schema = "chunk int, n long, data binary"
    parts = counts.withColumn("part", F.pmod(F.xxhash64("data"), F.lit(32)))
    sums = parts.groupBy("chunk", "part").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema).toArrow()  # the tables' size
    tables, n = np.zeros((2 * COUNTERS // CHUNK, CHUNK)), 0
    for chunk, k, data in zip(*(sums.column(c).to_pylist() for c in ("chunk", "n", "data"))):
        tables[chunk], n = np.frombuffer(zlib.decompress(data), "<u8") / UNIT, k / UNIT
    return n, tables.reshape(2, COUNTERS)


def _signatures(docs: DataFrame, weights) -> DataFrame:
    """id, band, bucket for the bands of every document that has words."""

    def run(batches):
        w, draw = weights.value, sampler()
        for ids, texts in _text_blocks(batches, 1 << 19):
            parts = [(i, *shingles(t)) for i, t in zip(ids, texts) if t]
            parts = [p for p in parts if len(p[1])]
            if not parts:
                continue
            hashes, tf = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            sig = draw.signatures(hashes, w.of(hashes, tf), np.array([len(p[1]) for p in parts]))
            bands = sig.reshape(len(parts), BANDS, ROWS)
            key = np.zeros(bands.shape[:2], "u8")
            for i in range(ROWS):
                key = _mix(key * _MUL + bands[:, :, i])
            key += np.arange(BANDS, dtype="u8")
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([p[0] for p in parts]), BANDS)), pa.array(key.ravel().view("i8"))], names=["id", "bucket"])

    return docs.mapInArrow(run, "id long, bucket long")


def _vectors(docs: DataFrame, weights) -> DataFrame:
    """id, hashes (ascending, 64 bits each), weights (float32 each, or empty if all are the rare shingle's), their sum, parities."""
    longs = [f"k{i}" for i in range(BITS // 64)]

    def run(batches):
        w = weights.value
        for ids, texts in _text_blocks(batches):
            hashes, own, total, bits = [], [], [], []
            for text in texts:
                s, tf = shingles(text)
                x = w.of(s, tf)
                hashes.append(s.astype("<u8").tobytes())
                own.append(b"" if (x == w.rare).all() else x.astype("<f4").tobytes())
                total.append(float(x.sum(dtype="f8")))
                bits.append(np.packbits((np.bincount((s[w.is_rare(s)] >> np.uint64(20) & np.uint64(BITS - 1)).astype("i8"), minlength=BITS) & 1).astype("u1")).view("<i8"))
            parities = np.array(bits, "i8").reshape(-1, len(longs))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary()), pa.array(own, pa.binary()), pa.array(total, pa.float64()), *(pa.array(parities[:, i]) for i in range(len(longs)))], names=["id", "h", "w", "weight", *longs])

    return docs.mapInArrow(run, "id long, h binary, w binary, weight double, " + ", ".join(f"{k} long" for k in longs))


def weighted_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    hit = hb[at] == ha
    both = float(np.minimum(wa[hit], wb[at[hit]]).sum(dtype="f8"))
    return both / (float(wa.sum(dtype="f8")) + float(wb.sum(dtype="f8")) - both)


def _compared(pairs: DataFrame, vectors: DataFrame, rare: float) -> DataFrame:
    """Pairs (u, v) with their weighted Jaccard similarity (sim), as a table.

    The second join's key can be hot (the pivot of a large bucket); Spark can split it, as both sides are plain.
    """
    a = vectors.select(F.col("id").alias("ia"), F.col("h").alias("ha"), F.col("w").alias("wa"))
    b = vectors.select(F.col("id").alias("ib"), F.col("h").alias("hb"), F.col("w").alias("wb"))
    both = pairs.join(a, F.col("u") == F.col("ia")).join(b, F.col("v") == F.col("ib")).select("u", "v", "ha", "wa", "hb", "wb")

    def run(batches):
        def read(h, w):
            h = np.frombuffer(h, "<u8")
            return h, np.frombuffer(w, "<f4") if w else np.full(len(h), rare, "f4")

        for batch in batches:
            sim = []
            for ha, wa, hb, wb in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                sim.append(weighted_jaccard(*read(ha, wa), *read(hb, wb)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sim, pa.float64())], names=["u", "v", "sim"])

    return table(both.mapInArrow(run, "u long, v long, sim double"), "compared")


def _across(placed: DataFrame, compared: DataFrame, groups: DataFrame, vectors: DataFrame, similarity: float, rare: float) -> DataFrame:
    """Pairs (u, v) that share a bucket, are in different components and are ruled out by no bound, as a table.

    A member outside its pivot's component meets all other members, within the join, so that only pairs within the bounds come out.
    """
    parities = [c for c in vectors.columns if c[1:].isdigit()]
    near = compared.select("u", "v", (1 - F.col("sim")).alias("d"))
    mine = groups.select(F.col("node").alias("n1"), F.col("component").alias("c1"))
    its = groups.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
    sketch = vectors.select(F.col("id").alias("s"), "weight", *parities)
    met = placed.join(near, (F.col("id") == F.col("u")) & (F.col("pivot") == F.col("v")), "left").join(mine, F.col("id") == F.col("n1"), "left").join(its, F.col("pivot") == F.col("n2"), "left").join(sketch, F.col("id") == F.col("s"))
    own = F.coalesce("c1", "id")
    met = table(met.select("bucket", "id", own.alias("own"), (own == F.coalesce("c2", "pivot")).alias("first"), F.coalesce("d", F.lit(0.0)).alias("d"), "weight", *parities), "met")
    outside = met.filter(~F.col("first")).drop("first")
    outside = outside.toDF(*(f"o_{c}" for c in outside.columns))
    differ = sum((F.bit_count(F.col(k).bitwiseXOR(F.col(f"o_{k}"))) for k in parities), F.lit(0))
    heavy, light = F.greatest("weight", "o_weight"), F.least("weight", "o_weight")
    on = (
        (F.col("o_bucket") == F.col("bucket")) & (F.col("o_own") != F.col("own")) & (F.col("first") | (F.col("o_id") < F.col("id")))
        & (F.abs(F.col("d") - F.col("o_d")) <= 1 - similarity + 1e-6) & (light >= (similarity - 1e-6) * heavy)
        & (differ * rare <= (1 - similarity) / (1 + similarity) * (heavy + light) * (1 + 1e-6))
    )
    return table(outside.join(met, on).select(F.greatest("id", "o_id").alias("u"), F.least("id", "o_id").alias("v")).distinct(), "more")


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, component_id (smallest doc_id of its group), kept (doc_id = component_id): a row for each row of documents."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    named = docs.filter("id is not null")
    scanned = table(_scan(named), "scanned")
    members = scanned.select("id", F.col("data").alias("fp"))
    weighing = weights_of(named, scanned)
    rare = float(weighing.rare)
    weights = spark.sparkContext.broadcast(weighing)

    # classes of equal words; ids that repeat are drawn together by way of their texts
    classes = table(members.filter("fp is not null").groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("fp").alias("same"), "first"), "classes")
    copies = table(members.join(classes, F.col("fp") == F.col("same")).filter("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")), "copies")
    buckets = table(_signatures(named, weights).join(copies.select("u"), F.col("id") == F.col("u"), "left_anti"), "buckets")
    pivots = table(buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).filter("n > 1").select(F.col("bucket").alias("b"), "pivot"), "pivots")
    placed = table(buckets.join(pivots, F.col("bucket") == F.col("b")).select("bucket", "id", "pivot"), "placed")
    ids = table(placed.select(F.col("id").alias("k")).distinct(), "ids")
    vectors = table(_vectors(named.join(ids, F.col("id") == F.col("k"), "left_semi"), weights).dropDuplicates(["id"]), "vectors")
    pairs = table(placed.filter("id <> pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v")).distinct(), "pairs")
    compared = _compared(pairs, vectors, rare)
    groups = table(connected_components(copies.union(compared.filter(F.col("sim") >= similarity).select("u", "v"))), "groups")

    more = _compared(_across(placed, compared, groups, vectors, similarity, rare), vectors, rare).filter(F.col("sim") >= similarity).select("u", "v")
    if not more.isEmpty():
        groups = connected_components(groups.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    every = documents.select("doc_id", F.col("doc_id").cast("long").alias("key"))
    out = every.join(groups, F.col("key") == F.col("node"), "left")
    return out.select("doc_id", F.coalesce("component", "key").alias("component_id"), F.coalesce(F.col("component") == F.col("key"), F.lit(True)).alias("kept"))


def drop_near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """documents (all columns) with one document of each group: that with the smallest doc_id."""
    kept = near_duplicates(documents, similarity).filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("kept_id")).agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    kept = table(kept.filter("kept").select("kept_id", "n"), "kept")
    names = documents.columns
    wide = documents.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("kept_key", F.col(f"c{names.index('doc_id')}").cast("long"))
    # merged at every size, as the kept ids grow with the documents
    out = wide.join(kept.hint("merge"), F.col("kept_key") == F.col("kept_id"), "left").filter("kept_id is not null or kept_key is null")
    columns = [f"c{i}" for i in range(len(names))]
    if kept.filter("n > 1").isEmpty():
        return out.select(columns).toDF(*names)
    single = out.filter("coalesce(n, 1) = 1").select(columns)
    repeated = out.filter("n > 1").withColumn("kept_text", F.sha2(f"c{names.index('text')}", 256)).dropDuplicates(["kept_key", "kept_text"]).select(columns)
    return single.union(repeated).toDF(*names)
