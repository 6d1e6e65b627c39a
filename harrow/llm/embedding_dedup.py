"""Near-duplicate embeddings through a robust-pruned flat graph.

Vectors of one label and dimension are dealt into cluster shards that overlap (each vector goes to its OVERLAP nearest centroids, of
which there is one for SHARD vectors, so a shard's size and the work a vector do not grow with the table; shards that come out
above MOST are clustered again, and what clustering can't divide is dealt into blocks that are compared with each other). Each
shard builds a graph of its own: the nearest of its few members by inner product, cut down by robust pruning. The adjacency lists of
all shards are united by vector. Then every vector of a shard searches what of the united graph is in the shard: greedily from
its medoid, and from what it finds within range it goes on along all neighbours in range until nothing new turns up. Links are
verified in double precision.

A vector counts partners only in the shard that is their first choice, so no pair is counted twice and no pairs are sent: a
shard returns link counts and a spanning forest. Recall is audited against brute force over all vectors for AUDITED drawn vectors
and for as many planted ones, which lie within range of a drawn one (and count for nothing else), so that there always is
something to find; below AUDIT the job runs again with twice the overlap, and after MOST_OVERLAP by comparing all blocks of a
label, which is exact.

Defined results: vectors that are null, empty, zero or have null or non-finite components, those without a label, and those with
a null vec_id link with nothing; equal vectors are one class (linked with each other); vectors of different dimensions don't
link. A null vec_id has component null and is kept. Rows that repeat count as other vectors. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, table

SIMILARITY, SHARD, MOST, OVERLAP, MOST_OVERLAP, FANOUT, LEVELS = 0.98, 256, 1536, 3, 12, 1024, 3
CANDIDATES, DEGREE, ALPHA, BEAM, EXPAND, BOTH_WAYS = 32, 16, 1.2, 8, 0.03, 32
AUDIT, AUDITED = 0.9, 200
#: Centroids up to this size are broadcast at once; more go in waves.
WAVE_BYTES = 64 << 20


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1. Rows are first scaled by a power of two, which rounds nothing, so that squares neither overflow nor vanish."""
    v = np.asarray(vectors, "f8")
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def robust_prune(vectors: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours (rows, degree; -1 where there are fewer): the nearest first, without those that a nearer one stands for."""
    n = len(vectors)
    x = vectors.astype("f4")
    k = min(CANDIDATES, n - 1)
    out = np.full((n, degree), -1, "i4")
    if k <= 0:
        return out
    near = np.empty((n, k), "i4")
    for a in range(0, n, 1024):
        sims = x[a : a + 1024] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
        near[a : a + 1024] = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    gap = np.sqrt(np.maximum(2 - 2 * np.einsum("ijk,ik->ij", x[near], x), 0))  # distance to the node
    alive = np.ones((n, k), bool)
    rows = np.arange(n)
    for d in range(degree):
        pick = np.where(alive, gap, np.inf).argmin(axis=1)
        live = alive[rows, pick]
        if not live.any():
            break
        chosen = near[rows, pick]
        out[live, d] = chosen[live]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("ijk,ik->ij", x[near], x[chosen]), 0))
        alive &= ~(live[:, None] & (alpha * between <= gap))
        alive[rows, pick] = False
    return out


def search(index: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, own: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, index row) pairs at least as similar as asked, found from the medoid (and own, the queries' rows or -1).

    The expansion also passes through rows that are up to EXPAND less similar, so that links which lead around
    the range's edge are followed.

    neighbours: (rows, degree) with -1 for none.
    """
    n, q = len(index), len(queries)
    wide = similarity - EXPAND
    x, y = index.astype("f4"), queries.astype("f4")
    medoid = int((x @ x.mean(axis=0)).argmax())
    seen = np.zeros((q, n), bool)
    rows = np.arange(q)
    beam = np.full((q, BEAM), medoid, "i4")
    score = np.full((q, BEAM), -np.inf, "f4")
    score[:, 0] = y @ x[medoid]
    seen[:, medoid] = True
    open_ = np.isfinite(score)
    found = [(rows, np.full(q, medoid, "i4"))]
    for _ in range(4 * BEAM):
        at = np.where(open_, score, -np.inf).argmax(axis=1)
        live = open_[rows, at]
        if not live.any():
            break
        r = rows[live]
        open_[r, at[live]] = False
        near = neighbours[beam[r, at[live]]]
        fresh = (near >= 0) & ~seen[r[:, None], near]
        near = np.where(fresh, near, 0)
        sims = np.where(fresh, np.einsum("ijk,ik->ij", x[near], y[r]), -np.inf)
        i, j = np.nonzero(fresh)
        seen[r[i], near[i, j]] = True
        hit = sims >= wide
        i, j = np.nonzero(hit)
        found.append((r[i], near[i, j]))
        both = np.concatenate([score[r], sims], axis=1)
        best = np.argpartition(-both, BEAM - 1, axis=1)[:, :BEAM]
        take = np.arange(len(r))[:, None]
        score[r] = both[take, best]
        beam[r] = np.concatenate([beam[r], near], axis=1)[take, best]
        open_[r] = np.concatenate([open_[r], np.isfinite(sims)], axis=1)[take, best] & np.isfinite(score[r])
    a, b = (np.concatenate(z) for z in zip(*found))
    exact = np.einsum("ij,ij->i", queries[a], index[b]) >= wide
    inside = np.zeros((q, n), bool)
    inside[a[exact], b[exact]] = True
    known = np.nonzero(own >= 0)[0]
    inside[known, own[known]] = True
    a, b = np.nonzero(inside)
    links = [(a, b)]
    while a.size:  # range expansion, in pieces of bounded size
        new = []
        for s in range(0, a.size, 200_000):
            p, near = a[s : s + 200_000], neighbours[b[s : s + 200_000]]
            i, j = np.nonzero(near >= 0)
            pair = np.unique(p[i].astype("i8") * n + near[i, j])
            p, near = pair // n, pair % n
            fresh = ~inside[p, near]
            p, near = p[fresh], near[fresh]
            ok = np.einsum("ij,ij->i", queries[p], index[near]) >= wide
            inside[p[ok], near[ok]] = True
            new.append((p[ok], near[ok]))
        a, b = (np.concatenate(z) for z in zip(*new))
        links.append((a, b))
    a, b = (np.concatenate(z) for z in zip(*links))
    close = np.concatenate([np.einsum("ij,ij->i", queries[a[s : s + 200_000]], index[b[s : s + 200_000]]) >= similarity for s in range(0, a.size, 200_000)])
    return a[close], b[close]


def _classes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (vec_id, cid) and classes (cid, label, v, least, copies) of equal vectors; cid is null for what links with nothing."""
    e = F.col("embedding")
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    good = good & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    cid = F.when(F.coalesce(good, F.lit(False)), F.xxhash64("label", "embedding"))
    rows = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), e.cast("array<double>").alias("embedding")).withColumn("cid", cid)
    classes = rows.filter("cid is not null").groupBy("cid", "label", "embedding").agg(F.min(F.col("vec_id").cast("long")).alias("least"), F.count("*").alias("copies"))
    classes = table(classes.withColumn("shard", F.concat_ws("/", F.col("label"), F.size("embedding").cast("string"))), "classes")
    clashes = table(classes.groupBy("cid").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("cid").alias("clash")), "clashes")
    if not clashes.isEmpty():  # unequal vectors with equal hashes get others
        other = F.xxhash64("cid", "least", "label")
        renamed = table(classes.join(clashes, F.col("cid") == F.col("clash")).select(F.col("clash"), F.col("label").alias("l"), F.col("embedding").alias("v"), other.alias("own")), "renamed")
        same = lambda df: (df["cid"] == renamed["clash"]) & (df["label"] == renamed["l"]) & (df["embedding"] == renamed["v"])
        fixed = lambda df: df.join(renamed, same(df), "left").withColumn("cid", F.coalesce("own", "cid")).select(df.columns)
        rows, classes = fixed(rows), table(fixed(classes), "classes")
    return rows.select("vec_id", "cid"), classes.withColumnRenamed("embedding", "v")


def _centroids(vectors: np.ndarray, k: int) -> np.ndarray:
    """k centroids by a few rounds of spherical k-means from spread-out first ones (vectors come in hash order)."""
    c = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)]
    for _ in range(6):
        near = (vectors @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, vectors)
        norm = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-30)[:, None], c)
    return c


def _sharded(classes: DataFrame, overlap: int, shard: int, most: int) -> DataFrame:
    """cid, v, copies, shard, main: each class in its nearest shards; main in the first of them."""
    spark = classes.sparkSession
    out = classes.select("cid", "v", "copies", "shard", F.lit(True).alias("main"))
    for level in range(LEVELS):
        sizes = table(out.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > most), "sizes")
        if sizes.isEmpty():
            break
        fit = out.join(sizes.withColumnRenamed("shard", "s"), F.col("shard") == F.col("s")).withColumn("k", F.least(F.lit(FANOUT), F.ceil(F.col("n") / shard)).cast("int"))
        # about 32 vectors a centroid, so that a task fits one shard's centroids from a bounded sample
        fit = fit.filter(F.pmod(F.xxhash64("cid", F.lit(level)), F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(32.0) * F.col("k") / F.col("n")) * (1 << 30))

        def centres(pdf: pd.DataFrame) -> pd.DataFrame:
            v = unit(np.stack(pdf.sort_values("cid")["v"].to_numpy()))
            c = _centroids(v, min(int(pdf["k"].iloc[0]), len(v)))
            return pd.DataFrame({"s": [pdf["shard"].iloc[0]], "dim": [c.shape[1]], "c": [c.astype("f4").tobytes()]})

        centroids = table(fit.select("shard", "cid", "v", "k").groupBy("shard").applyInPandas(centres, "s string, dim int, c binary"), "centroids")
        rest = out.join(centroids.select("s"), F.col("shard") == F.col("s"), "left_anti")

        def dealt(wave: list):
            known = spark.sparkContext.broadcast({r.s: np.frombuffer(r.c, "f4").reshape(-1, r.dim) for r in wave})

            def run(batches):
                for batch in batches:
                    pdf = batch.to_pandas()
                    for s, part in pdf.groupby("shard", sort=False):
                        c = known.value[s]
                        k = min(overlap if level == 0 else 2, len(c))
                        x = unit(np.stack(part["v"].to_numpy())).astype("f4")
                        near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :k]
                        again = np.repeat(np.arange(len(part)), k)
                        yield pa.RecordBatch.from_pydict({
                            "cid": part["cid"].to_numpy()[again], "v": pa.array(list(part["v"].to_numpy()[again]), pa.list_(pa.float64())), "copies": part["copies"].to_numpy()[again],
                            "shard": [f"{s}/{j}" for j in near.ravel()], "main": part["main"].to_numpy()[again] & (np.tile(np.arange(k), len(part)) == 0),
                        })

            mine = out.join(F.broadcast(spark.createDataFrame([(s,) for s in known.value], "s string")), F.col("shard") == F.col("s"), "left_semi")
            return mine.mapInArrow(run, out.schema)

        parts, wave, size = [], [], 0
        for r in centroids.toLocalIterator():
            wave.append(r)
            size += len(r.c)
            if size >= WAVE_BYTES:
                parts.append(dealt(wave))
                wave, size = [], 0
        for p in [*parts, *([dealt(wave)] if wave else [])]:
            rest = rest.union(p)
        out = table(rest, "sharded")
    return out


def _linked(classes: DataFrame, similarity: float, overlap: int, shard: int, most: int, exact: bool = False) -> DataFrame:
    """cid, links (vectors in other classes), root (a class in the same component): rows of all shards. exact: compare all blocks of
    a label."""
    members = classes.select("cid", "v", "copies", "shard", F.lit(True).alias("main")) if exact else _sharded(classes, overlap, shard, most)
    sizes = table(members.groupBy("shard").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks")).withColumnRenamed("shard", "s"), "blocks")
    members = table(members.join(sizes, F.col("shard") == F.col("s")).withColumn("block", F.pmod(F.xxhash64("cid", F.lit("block")), F.col("blocks")).cast("int")).drop("s"), "members")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", ignore_index=True)
        ids = pdf["cid"].to_numpy()
        x = unit(np.stack(pdf["v"].to_numpy()))
        near = robust_prune(x)
        # edges count both ways, so that what nobody is nearest to is reached too; of a hub's, the most similar stay
        at, d = np.nonzero(near >= 0)
        pair = np.unique(np.concatenate([at * len(ids) + near[at, d], near[at, d].astype("i8") * len(ids) + at]))
        at, to = pair // len(ids), pair % len(ids)
        order = np.lexsort((-np.einsum("ij,ij->i", x[at], x[to]), at))
        at, to = at[order], to[order]
        start = np.searchsorted(at, np.arange(len(ids)))
        stop = np.append(start[1:], len(at))
        return pd.DataFrame({"cid": ids, "near": [ids[to[a : min(b, a + BOTH_WAYS)]] for a, b in zip(start, stop)]})

    edges = members.select("shard", "block", "cid", "v").groupBy("shard", "block").applyInPandas(build, "cid long, near array<long>")
    graph = members.select("cid", F.array().cast("array<long>").alias("near")) if exact else edges
    graph = table(graph.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")).withColumnRenamed("cid", "g"), "graph")
    every = members.join(graph, F.col("cid") == F.col("g")).drop("g")
    # a block is searched by every block of its shard
    index = every.select("*", F.lit(True).alias("indexed"), F.col("block").alias("of"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("by"))
    query = every.select("*", F.lit(False).alias("indexed"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("of"), F.col("block").alias("by")).withColumn("near", F.lit(None).cast("array<long>"))
    one = index.filter("blocks = 1")
    work = one.union(index.filter("blocks > 1")).union(query.filter("blocks > 1")).select("shard", "of", "by", "cid", "v", "copies", "main", "near", "indexed")

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", ignore_index=True)
        base = pdf[pdf["indexed"]].reset_index(drop=True)
        asked = base if base.shape[0] == pdf.shape[0] else pdf[~pdf["indexed"]].reset_index(drop=True)
        if not len(base) or not len(asked):
            return pd.DataFrame({"cid": np.zeros(0, "i8"), "links": np.zeros(0, "i8"), "root": np.zeros(0, "i8")})
        ids = base["cid"].to_numpy()
        x = unit(np.stack(base["v"].to_numpy()))
        y = x if asked is base else unit(np.stack(asked["v"].to_numpy()))
        names = asked["cid"].to_numpy()
        if exact:
            a, b = np.nonzero(y @ x.T >= similarity)
        else:
            lists = base["near"].to_numpy()
            length = np.array([len(z) for z in lists])
            flat = np.concatenate(lists).astype("i8") if length.sum() else np.zeros(0, "i8")
            at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            near = np.full((len(ids), max(1, length.max())), -1, "i8")  # neighbours of other shards and blocks aren't here
            near[np.repeat(np.arange(len(ids)), length), np.concatenate([np.arange(k) for k in length]).astype("i8")] = np.where(ids[at] == flat, at, -1)
            own = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
            own = np.where(ids[own] == names, own, -1)
            a, b = search(x, near, y, own, similarity)
        other = names[a] != ids[b]
        a, b = a[other], b[other]
        count = base["main"].to_numpy()[b] * base["copies"].to_numpy()[b]
        links = np.zeros(len(names), "i8")
        np.add.at(links, a, count)
        # a spanning forest: the smallest class that each class reaches here
        real = (asked["copies"].to_numpy()[a] > 0) & (base["copies"].to_numpy()[b] > 0)
        a, b = a[real], b[real]
        nodes, inverse = np.unique(np.concatenate([names, ids]), return_inverse=True)
        u, v = inverse[: len(names)][a], inverse[len(names) :][b]
        label = np.arange(len(nodes))
        while True:
            low = label.copy()
            np.minimum.at(low, u, label[v])
            np.minimum.at(low, v, label[u])
            low = low[low]
            if (low == label).all():
                break
            label = low
        out = pd.DataFrame({"cid": names, "links": links, "root": nodes[label[inverse[: len(names)]]]})
        if asked is not base:
            out = pd.concat([out, pd.DataFrame({"cid": ids, "links": 0, "root": nodes[label[inverse[len(names) :]]]})])
        return out[(out["links"] > 0) | (out["cid"] != out["root"])]

    return table(work.groupBy("shard", "of", "by").applyInPandas(find, "cid long, links long, root long"), "linked")


def _drawn(classes: DataFrame, audited: int) -> list:
    """About `audited` classes."""
    share = min(1.0, audited / max(classes.count(), 1))
    hashed = F.pmod(F.xxhash64("cid", F.lit("audit")), F.lit(1 << 30))
    return classes.filter(hashed < int(share * (1 << 30))).select("cid", "label", "shard", "v").limit(4 * audited).collect()


def planted(drawn: list, similarity: float) -> list[tuple]:
    """(cid, label, v, shard) of vectors within range of the drawn ones, at angles spread over the range."""
    out = []
    for k, r in enumerate(drawn):
        x = unit([r.v])[0]
        g = np.random.default_rng(abs(r.cid)).normal(size=len(x))
        g -= (g @ x) * x
        if np.sqrt(g @ g) > 1e-9:
            angle = np.arccos(similarity) * (k + 0.5) / len(drawn)
            out.append(((r.cid ^ 0x5DEECE66D), r.label, (np.cos(angle) * x + np.sin(angle) * g / np.sqrt(g @ g)).tolist(), r.shard))
    return out


def recall(classes: DataFrame, counts: DataFrame, asked: list[tuple], similarity: float) -> float:
    """Share of the true links of asked (cid, label, v, shard), by brute force against all classes, that were counted: that over all
    links, or the mean of the vectors' shares, whichever is less."""
    by_shard: dict[str, tuple] = {}
    for s in {r[3] for r in asked}:
        rows = [r for r in asked if r[3] == s]
        by_shard[s] = (np.array([r[0] for r in rows]), unit(np.array([r[2] for r in rows])))
    known = classes.sparkSession.sparkContext.broadcast(by_shard)

    def run(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            for s, part in pdf.groupby("shard", sort=False):
                if s in known.value:
                    ids, q = known.value[s]
                    hit = (unit(np.stack(part["v"].to_numpy())) @ q.T >= similarity) & (part["cid"].to_numpy()[:, None] != ids)
                    yield pa.RecordBatch.from_pydict({"cid": ids, "true": (hit * part["copies"].to_numpy()[:, None]).sum(axis=0)})

    true = classes.select("cid", "shard", "v", "copies").mapInArrow(run, "cid long, true long").groupBy("cid").agg(F.sum("true").alias("true")).filter(F.col("true") > 0)
    both = true.join(counts.withColumnRenamed("cid", "c"), F.col("cid") == F.col("c"), "left").withColumn("got", F.least("true", F.coalesce("links", F.lit(0))))
    every, mean = both.agg(F.sum("got") / F.sum("true"), F.avg(F.col("got") / F.col("true"))).first()
    return 1.0 if every is None else min(every, mean)


def near_duplicates(embeddings: DataFrame, similarity: float = SIMILARITY, overlap: int = OVERLAP, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """vec_id, n_links, component_id (smallest vec_id reached by links), kept: a row for each row of embeddings."""
    rows, classes = _classes(embeddings)
    drawn = _drawn(classes, AUDITED)
    extra = planted(drawn, similarity)
    spark = classes.sparkSession
    columns = "cid long, label string, v array<double>, shard string"
    with_planted = classes.unionByName(spark.createDataFrame(extra, columns).withColumn("least", F.lit(None).cast("long")).withColumn("copies", F.lit(0).cast("long"))) if extra else classes
    asked = [(r.cid, r.label, r.v, r.shard) for r in drawn]
    while True:
        exact = overlap > MOST_OVERLAP
        linked = _linked(with_planted, similarity, overlap, shard, most, exact)
        counts = table(linked.groupBy("cid").agg(F.sum("links").cast("long").alias("links")), "counts")
        if exact or not asked or min(recall(classes, counts, x, similarity) for x in (asked, extra) if x) >= AUDIT:
            break
        overlap *= 2
    groups = connected_components(linked.select(F.col("cid").alias("u"), F.col("root").alias("v")))
    placed = classes.select(F.col("cid").alias("c"), "least", "copies").join(groups, F.col("c") == F.col("node"), "left").withColumn("component", F.coalesce("component", "c"))
    placed = table(placed.join(counts, F.col("c") == F.col("cid"), "left").select("c", "least", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "placed")
    smallest = table(placed.groupBy("component").agg(F.min("least").alias("smallest")).withColumnRenamed("component", "k"), "smallest")
    final = table(placed.join(smallest, F.col("component") == F.col("k")).select("c", "links", "smallest"), "final")
    out = rows.join(final, F.col("cid") == F.col("c"), "left")
    component = F.coalesce("smallest", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
