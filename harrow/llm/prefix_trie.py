"""Prefix trie of conversations: a row for each distinct sequence of first turns, with counts over its subtree.

Every conversation is rebuilt first: its first turns (a number that a checksum of its id gives) are those of a donor, the rest its
own. A turn is a digest from then on, and texts are never shuffled. A prefix of d turns has the digest sum(turn_i * BASE^i),
i = 1..d, modulo a prime, in four lanes of 31 bits: sums add up, so prefixes of one conversation can be worked out in pieces, and
a conversation may be as long as it likes.

1. Turns are sorted by ranges of (conversation, turn), so a hot conversation spreads over tasks. Each task numbers its turns and sums
   from its own start; what a range's first conversation brings along from the ranges before (a count and a sum, one row a
   range) is added afterwards.
2. Rebuilt conversations are spliced by that arithmetic, a row a turn and one for the root.
3. Stretches of PIECE turns are dealt into shards. A shard enumerates its distinct digests, gives each a slot by a minimal perfect
   hash (SlotTable) and verifies every row against what its slot holds. Where conversations leave the shard is scattered into flat arrays by
   slot, and the arrays are accumulated through the parents' slots from the deepest nodes up: members and smallest member.
   Shards' nodes are then added up by digest.
4. Likewise for leaves and saved tokens: each node's own value stands in the shard of its smallest member, which holds all ancestors down to
   the piece's top, and what deeper pieces of that conversation come to enters at the piece's last turn.

A digest that stood for two different prefixes would show as a node with two parents, turns, lengths or depths: the job fails
then, so results are exact (up to SHA-256 of a turn).

Defined results: turns are ordered by number, null first, and equal numbers by the SHA-256 of role and text; rows that repeat are turns
of their own. Null roles and texts are empty. Rows with a null conversation id are left out; the donor of c is c - c % 5 with the
sign that SQL gives. A table without conversations has no nodes, not even a root. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, table
from .ordered import ordered_digests

#: Four lanes modulo this prime; any bases will do.
PRIME, BASES = (1 << 31) - 1, np.array([1103515245, 1220703125, 630360016, 1664525001], "u8")
#: Turns of a conversation that stay together, and rows of a shard.
PIECE, SHARD_ROWS = 1024, 200_000
DONORS, MOST_BORROWED = 5, 8
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


# -- Digests ---------------------------------------------------------------------------------------------------------


def powers(exponents: np.ndarray, bases: np.ndarray = BASES) -> np.ndarray:
    """bases ^ exponents modulo PRIME, (4, n)."""
    e = np.asarray(exponents, "u8")
    out, square = np.ones((4, len(e)), "u8"), bases.copy()
    for bit in range(int(e.max(initial=0)).bit_length()):
        on = (e >> np.uint64(bit)) & np.uint64(1) == 1
        out[:, on] = out[:, on] * square[:, None] % PRIME
        square = square * square % PRIME
    return out


INVERSES = np.array([pow(int(b), -1, PRIME) for b in BASES], "u8")


def packed(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.uint64(31)
    return (lanes[0] << s | lanes[1]).astype("i8"), (lanes[2] << s | lanes[3]).astype("i8")


def lanes_of(a, b) -> np.ndarray:
    a, b, s = np.asarray(a).astype("u8"), np.asarray(b).astype("u8"), np.uint64(31)
    return np.stack([a >> s, a & np.uint64(PRIME), b >> s, b & np.uint64(PRIME)])


def turn_lanes(digests: pa.Array) -> np.ndarray:
    """Of SHA-256 values."""
    fixed = digests.cast(pa.binary(32))
    raw = np.frombuffer(fixed.buffers()[1], "u1")[fixed.offset * 32 : (fixed.offset + len(fixed)) * 32].reshape(-1, 32)
    return np.ascontiguousarray(raw[:, :16]).view(">u4").astype("u8").T % PRIME


# -- Slots -----------------------------------------------------------------------------------------------------------


class SlotTable:
    """A minimal perfect hash of distinct (a, b): slots 0 to n - 1, one for each, and the key that each holds.

    Level by level keys are thrown into twice as many cells; who is alone in one stays, the others go on. A key's slot is the number
    of taken cells before its own.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.n, self.levels, before = len(a), [], 0
        rest = np.arange(self.n)
        while len(rest):
            size = 2 * len(rest) + 1
            cell = self._cells(a[rest], b[rest], len(self.levels), size)
            taken = np.bincount(cell, minlength=size) == 1
            self.levels.append((size, taken, before + np.cumsum(taken) - 1))
            before += int(taken.sum())
            rest = rest[~taken[cell]]
            if len(self.levels) > 200:
                raise ValueError("keys repeat")
        self.a, self.b = np.zeros(self.n, "i8"), np.zeros(self.n, "i8")
        at = self._find(a, b)
        self.a[at], self.b[at] = a, b

    @staticmethod
    def _cells(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        x = a.astype("u8") * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype("u8") + np.uint64(level)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(size)).astype("i8")

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(a), -1, "i8"), np.arange(len(a))
        for level, (size, taken, slots) in enumerate(self.levels):
            cell = self._cells(a[open_], b[open_], level, size)
            here = taken[cell]
            out[open_[here]] = slots[cell[here]]
            open_ = open_[~here]
        return out

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The keys' slots; -1 for a key that isn't in the table, whatever slot it falls on."""
        at = self._find(a, b)
        if self.n:
            at[(self.a[at] != a) | (self.b[at] != b)] = -1
        return at


def accumulate(add: np.ufunc, values: np.ndarray, parents: np.ndarray, depths: np.ndarray) -> None:
    """Bring each slot's value into its parent's, the deepest slots first. Parents of -1 end a path."""
    order = np.argsort(-depths, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depths[order])) + 1):
        level = level[parents[level] >= 0]
        add.at(values, parents[level], values[level])


class Nodes:
    """The distinct digests of a shard by slot. rows: a, b, pa, pb, ta, tb, n_bytes and depth of its rows."""

    FIELDS = ("pa", "pb", "ta", "tb", "n_bytes", "depth")

    def __init__(self, rows: dict[str, np.ndarray], piece: int) -> None:
        by = np.lexsort((rows["b"], rows["a"]))
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(rows["a"][by]) != 0) | (np.diff(rows["b"][by]) != 0)
        one = by[new]
        self.table = SlotTable(rows["a"][one], rows["b"][one])
        self.at = self.table.slots(rows["a"], rows["b"])
        for f in self.FIELDS:
            held = np.zeros(self.table.n, "i8")
            held[self.at[one]] = rows[f][one]
            if (held[self.at] != rows[f]).any():
                raise ValueError("two prefixes have one digest")
            setattr(self, f, held)
        self.parents = np.where(self.depth % piece == 0, -1, self.table.slots(self.pa, self.pb))


# -- The jobs --------------------------------------------------------------------------------------------------------


def _numpy(t: pa.Table | pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy() for n, c in zip(t.schema.names, t.columns)}


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _longs(names: str) -> tuple[str, pa.Schema]:
    return ", ".join(f"{n} long" for n in names.split()), pa.schema([(n, pa.int64()) for n in names.split()])


def _numbered(turns: DataFrame) -> DataFrame:
    """c, place (1 on), a, b (digest of the first place turns), ta, tb (of the turn), n_bytes."""
    spark = turns.sparkSession
    schema = "c long, part long, lead boolean, mark boolean, place long, a long, b long, ta long, tb long, n_bytes long"
    arrow = pa.schema([(n.split()[0], pa.bool_() if "boolean" in n else pa.int64()) for n in schema.split(", ")])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, lead, leading = TaskContext.get().partitionId(), None, True
        now, place, total = None, 0, np.zeros(4, "u8")  # the conversation, its turns and their sum so far

        def mark() -> pa.RecordBatch:
            a, b = packed(total[:, None])
            return _batch({"c": [now], "part": [part], "lead": [leading], "mark": [True], "place": [place], "a": a, "b": b, "ta": [0], "tb": [0], "n_bytes": [0]}, arrow)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            c, t = batch.column(0).to_numpy(), turn_lanes(batch.column(1))
            lead = int(c[0]) if lead is None else lead
            run = np.flatnonzero(np.concatenate([[True], np.diff(c) != 0]))
            begin = np.repeat(run, np.diff(run, append=n))
            goes_on = (begin == 0) & (int(c[0]) == now)
            at = np.arange(n) - begin + 1 + np.where(goes_on, place, 0)
            sums = np.concatenate([np.zeros((4, 1), "u8"), np.cumsum(t * powers(at) % PRIME, axis=1)], axis=1)
            s = (sums[:, 1:] - sums[:, begin] + np.where(goes_on, total[:, None], np.uint64(0))) % PRIME
            of_lead = int((c == lead).sum()) if leading else 0
            if leading and of_lead < n:
                if of_lead:
                    now, place, total = lead, int(at[of_lead - 1]), s[:, of_lead - 1]
                yield mark()
                leading = False
            now, place, total = int(c[-1]), int(at[-1]), s[:, -1].copy()
            (a, b), (ta, tb) = packed(s), packed(t)
            yield _batch({"c": c, "part": np.full(n, part), "lead": c == lead, "mark": np.zeros(n, bool), "place": at, "a": a, "b": b, "ta": ta, "tb": tb, "n_bytes": batch.column(2).to_numpy()}, arrow)
        if lead is not None:
            yield mark()

    keys = ["c", "turn", "t", "copy"]
    dealt = turns.repartitionByRange(*keys).sortWithinPartitions(*keys).select("c", "t", "n_bytes")
    found = table(dealt.mapInArrow(local, schema), "numbered")
    carry, open_ = {}, None  # one or two rows a range
    for r in found.filter("mark").orderBy("part", F.desc("lead")).collect():
        total = lanes_of([r.a], [r.b])[:, 0]
        if r.lead and open_ and open_[0] == r.c:
            carry[r.part] = open_[1:]
            total = (open_[2] + powers(np.array([open_[1]]))[:, 0] * total) % PRIME
            open_ = (r.c, open_[1] + r.place, total)
        else:
            open_ = (r.c, r.place, total)
    rows = found.filter("not mark")
    if carry:
        sent = spark.sparkContext.broadcast(carry)

        def brought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _numpy(batch)
                for part in np.unique(x["part"]).tolist():
                    if part in sent.value:
                        on, (before, total) = x["part"] == part, sent.value[part]
                        x["place"] = np.where(on, x["place"] + before, x["place"])
                        s = (total[:, None] + powers(np.array([before])) * lanes_of(x["a"], x["b"])) % PRIME
                        a, b = packed(s)
                        x["a"], x["b"] = np.where(on, a, x["a"]), np.where(on, b, x["b"])
                yield _batch(x, arrow)

        rows = rows.filter("not lead").unionByName(rows.filter("lead").mapInArrow(brought, schema))
    return rows.drop("part", "lead", "mark")


_ROW = "c depth a b pa pb ta tb n_bytes size"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """_ROW: a row for each prefix of each rebuilt conversation c, the empty one included; size: its turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(said, 256)).alias("t"), F.monotonically_increasing_id().alias("copy"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    own = _numbered(table(turns, "turns"))
    head = F.when(F.col("place") <= MOST_BORROWED, F.struct("place", "a", "b", "ta", "tb", "n_bytes"))
    convs = own.groupBy("c").agg(F.max("place").alias("n"), F.array_sort(F.collect_list(head)).alias("head"))
    convs = table(convs.withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % (MOST_BORROWED + 1)), "conversations")
    donors = convs.filter(F.col("c") % DONORS == 0).select(F.col("c").alias("donor"), F.col("head").alias("borrowed"))
    nth = lambda column, k, field: F.when(k > 0, F.try_element_at(F.col(column), k.cast("int"))[field]).otherwise(F.lit(0).cast("long"))
    info = convs.withColumn("donor", F.col("c") - F.col("c") % DONORS).join(donors, "donor", "left")
    info = info.withColumn("k", F.least("h", F.coalesce(F.size("borrowed"), F.lit(0)).cast("long")))
    info = info.withColumn("k", F.when(F.col("borrowed").isNull(), F.lit(0)).otherwise(F.col("k")).cast("long")).withColumn("size", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    info = table(info.select("c", "n", "h", "k", "size", F.slice("borrowed", 1, F.col("k").cast("int")).alias("borrowed"), *(nth(x, y, f).alias(f"{x}_{f}") for x, y in (("borrowed", F.col("k")), ("head", F.least("h", "n"))) for f in ("a", "b"))), "spliced")
    zero = F.lit(0).cast("long")
    roots = info.select("c", *(zero.alias(x) for x in "depth a b pa pb ta tb n_bytes".split()), "size")
    before = lambda field: F.when(F.col("i") > 0, F.col("borrowed")[F.col("i") - 1][field]).otherwise(zero).alias("p" + field)
    firsts = info.select("c", "size", "borrowed", F.posexplode("borrowed").alias("i", "x")).select(
        "c", (F.col("i") + 1).cast("long").alias("depth"), "x.a", "x.b", before("a"), before("b"), "x.ta", "x.tb", "x.n_bytes", "size"
    )
    names, arrow = _longs(_ROW)

    def spliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _numpy(batch)
            start, skipped, s = lanes_of(x["borrowed_a"], x["borrowed_b"]), lanes_of(x["head_a"], x["head_b"]), lanes_of(x["a"], x["b"])
            shift = powers(x["h"] - x["k"], INVERSES)
            last = lanes_of(x["ta"], x["tb"]) * powers(x["place"]) % PRIME
            whole = (start + (s + PRIME - skipped) % PRIME * shift) % PRIME
            parent = (whole + PRIME - last * shift % PRIME) % PRIME
            (a, b), (pa_, pb) = packed(whole), packed(parent)
            yield _batch({"c": x["c"], "depth": x["place"] - x["h"] + x["k"], "a": a, "b": b, "pa": pa_, "pb": pb, "ta": x["ta"], "tb": x["tb"], "n_bytes": x["n_bytes"], "size": x["size"]}, arrow)

    rest = own.join(info.filter("n > h").drop("borrowed", "n"), "c").filter("place > h").mapInArrow(spliced, names)
    out = table(roots.unionByName(firsts).unionByName(rest), "prefixes")
    drop_table(info)
    return out


def prefix_trie(conversations: DataFrame, piece: int = PIECE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    spark = conversations.sparkSession
    prefixes = rebuilt(conversations)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-prefixes.count() // shard_rows))

    def shard(c: Column, depth: Column) -> Column:
        return F.pmod(F.xxhash64(c, F.floor(depth / piece)), F.lit(shards)).cast("long").alias("shard")

    names, arrow = _longs("shard a b pa pb ta tb n_bytes depth n c")

    def members(key: tuple, rows: pa.Table) -> pa.Table:
        """A shard's nodes, with the conversations that pass through them: how many, and the smallest."""
        x = _numpy(rows)
        nodes = Nodes(x, piece)
        leaving = (x["depth"] == x["size"]) | ((x["depth"] + 1) % piece == 0)
        n, least = np.zeros(nodes.table.n, "i8"), np.full(nodes.table.n, np.iinfo("i8").max)
        np.add.at(n, nodes.at[leaving], 1)
        np.minimum.at(least, nodes.at[leaving], x["c"][leaving])
        accumulate(np.add, n, nodes.parents, nodes.depth)
        accumulate(np.minimum, least, nodes.parents, nodes.depth)
        columns = {"shard": np.full(nodes.table.n, key[0].as_py()), "a": nodes.table.a, "b": nodes.table.b, "n": n, "c": least}
        return pa.Table.from_batches([_batch(columns | {f: getattr(nodes, f) for f in Nodes.FIELDS}, arrow)])

    dealt = prefixes.withColumn("shard", shard(F.col("c"), F.col("depth")))
    parts = table(dealt.groupBy("shard").applyInArrow(members, names), "shards")
    check = F.xxhash64(*Nodes.FIELDS)
    one = parts.groupBy("a", "b").agg(F.sum("n").alias("n_convs"), F.min("c").alias("conv_id"), F.min(check).alias("x"), F.max(check).alias("y"), *(F.min(f).alias(f) for f in ("pa", "pb", "n_bytes", "depth")))
    same = F.when(F.col("x") == F.col("y"), F.col("n_convs")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long"))
    nodes = table(one.withColumn("n_convs", same).drop("x", "y"), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = table(nodes.join(children, ["a", "b"], "left").fillna(0, ["n_children"]), "family")

    own = nodes.select("conv_id", "depth", "a", "b", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaves"))
    values = own.select(shard(F.col("conv_id"), F.col("depth")), "a", "b", "saved", "leaves")
    exits = prefixes.filter((F.col("depth") + 1) % piece == 0).filter("depth < size").select("c", F.floor(F.col("depth") / piece).alias("at"), "depth", "a", "b")
    if not exits.isEmpty():
        # what a conversation's deeper pieces hold enters at the last turn of each piece; none is longer than a piece in most tables
        deeper = own.groupBy(F.col("conv_id").alias("c"), F.floor(F.col("depth") / piece).alias("at")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l")).filter("at > 0")
        both = exits.unionByName(deeper, allowMissingColumns=True)
        later = Window.partitionBy("c").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
        carried = both.withColumns({"saved": F.sum("s").over(later), "leaves": F.sum("l").over(later)}).filter("a is not null")
        values = values.unionByName(carried.select(shard(F.col("c"), F.col("depth")), "a", "b", "saved", "leaves").fillna(0))
    sum_names, sum_arrow = _longs("a b saved leaves")

    def subtrees(key: tuple, rows: pa.Table, held: pa.Table) -> pa.Table:
        """What stands below a shard's nodes, as far as its values say."""
        nodes, x = Nodes(_numpy(rows), piece), _numpy(held)
        at = nodes.table.slots(x["a"], x["b"])
        if (at < 0).any():
            raise ValueError("a value's node is not in its shard")
        out = {"a": nodes.table.a, "b": nodes.table.b}
        for f in ("saved", "leaves"):
            out[f] = np.zeros(nodes.table.n, "i8")
            np.add.at(out[f], at, x[f])
            accumulate(np.add, out[f], nodes.parents, nodes.depth)
        return pa.Table.from_batches([_batch(out, sum_arrow)])

    below = parts.drop("n", "c").groupBy("shard").cogroup(values.groupBy("shard")).applyInArrow(subtrees, sum_names)
    below = below.groupBy("a", "b").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = ordered_digests(prefixes.filter("depth = size").withColumn("ends_sha256", F.col("c").cast("string")), ["a", "b"], ["c"], ["ends_sha256"], b",")
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    named = table(nodes.filter("depth > 0").join(parents, ["pa", "pb"]).select("a", "b", "parent_conv_id"), "parents")
    whole = nodes.join(below, ["a", "b"]).join(named, ["a", "b"], "left").join(ends, ["a", "b"], "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
