"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The items' words become one automaton of all their substrings. A document's words stream through it; at each word
the automaton gives the length of the longest suffix that occurs in some item. A length of at least `window` marks the
last `window` words as hit, and the state of exactly that suffix knows the items that hold it. An item shorter than
`window` (but not empty) is a window as a whole.

Defined results: null, empty or word-free text has 0 words and no hit; an item without words matches nothing; a null
item text has no words; repeated items count once an item_id; null item ids are ignored in the list of items but their
words still mark hits. Rows with a null doc_id or repeated rows give a row each. Extra columns are ignored.

Test items that exceed `block_words` are dealt into blocks, each with an automaton of its own that a task builds and writes to
the shared folder; documents pass once a block and the hit positions are united by document, so a worker holds one automaton.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, held, map_rows, new_path, table, words
from .files import locate, write_once

WINDOW = 13
#: Words of test items in one automaton, at about 400 bytes a state and at most two states a word; and bytes that a word takes at least.
BLOCK_WORDS, BYTES_A_WORD = 250_000, 4


class SuffixAutomaton:
    """All substrings of the added word sequences. After finish(), scan() streams a text through it."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids: dict[bytes, int] = {}
        self.sequences: list[tuple[str | None, list[int]]] = []

    def _extend(self, last: int, c: int) -> int:
        go, link, length = self.go, self.link, self.length
        if (q := go[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for its suffixes no longer than p's, plus c."""
        copy = len(self.go)
        self.go.append(dict(self.go[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.go[p].get(c) == q:
            self.go[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, item_id: str | None, item: Iterable[bytes]) -> None:
        sequence = [self.ids.setdefault(w, len(self.ids)) for w in item]
        if sequence:
            self.sequences.append((item_id, sequence))
            last = 0
            for c in sequence:
                last = self._extend(last, c)

    def finish(self) -> SuffixAutomaton:
        """Note, at the states of whole windows, the items that hold them."""
        self.items: dict[int, set[str | None]] = {}
        short: dict[int, int] = {}
        for item_id, sequence in self.sequences:
            need = min(self.window, len(sequence))
            state = n = 0
            for c in sequence:
                state, n = self.go[state][c], n + 1
                while self.length[self.link[state]] >= need:
                    state = self.link[state]
                n = min(n, self.length[state])
                if n >= need:
                    self.items.setdefault(state, set()).add(item_id)
                    if need < self.window:
                        short[state] = need
        # For each state, the whole short items that end with it, longest first, as (words, state).
        self.short: dict[int, tuple[tuple[int, int], ...]] = {}
        if short:
            for s in sorted(range(1, len(self.go)), key=self.length.__getitem__):
                found = self.short.get(self.link[s], ())
                if s in short:
                    found = ((short[s], s), *found)
                if found:
                    self.short[s] = found
        return self

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Hit spans (from, to) in words, ascending and apart, and the items with a window in the text."""
        go, link, length, window, items, short = self.go, self.link, self.length, self.window, self.items, self.short
        spans: list[tuple[int, int]] = []
        found: set[str | None] = set()
        state = n = 0
        for i, c in enumerate(map(self.ids.get, text), 1):
            if c is None:
                state = n = 0
                continue
            while (to := go[state].get(c)) is None and state:
                state = link[state]
                n = length[state]
            if to is None:
                continue
            state, n = to, n + 1
            hit = 0
            if n >= window:
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                found |= items[s]
                hit = window
            if state in short:
                for m, s in short[state]:
                    if m <= n:
                        found |= items[s]
                        hit = max(hit, m)
            if hit:
                at = i - hit
                while spans and spans[-1][1] >= at:
                    at = min(at, spans.pop()[0])
                spans.append((at, i))
        return spans, found


def automata(benchmark: DataFrame, window: int, block_words: int) -> list[str]:
    """Files in the shared folder with the automata of blocks of items, built by tasks; a block has about block_words words at most
    (an item alone may exceed that)."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t"))
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-size // (BYTES_A_WORD * block_words)) or 1
    folder = new_path(benchmark.sparkSession, "automata")

    def build(key: tuple, part: pa.Table) -> pa.Table:
        auto = SuffixAutomaton(window)
        part = part.sort_by([("i", "ascending"), ("t", "ascending")])
        for item_id, text in zip(part.column("i").to_pylist(), part.column("t").to_pylist()):
            auto.add(item_id, words(text))
        path = f"{folder}/{key[0].as_py()}"
        with write_once(path) as f:
            f.write(pickle.dumps(auto.finish()))
        return pa.table({"path": [path]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    return sorted(r.path for r in table(dealt.groupBy("block").applyInArrow(build, "path string"), "blocks").collect())  # a row a block


def _load(path: str) -> SuffixAutomaton:
    """A block's automaton, read once a worker process."""

    def read() -> SuffixAutomaton:
        system, where = locate(path)
        with system.open_input_file(where) as f:
            return pickle.loads(f.read())

    return held(("automaton", path), read)


def _hits(docs: DataFrame, paths: list[str], merge: bool) -> DataFrame:
    """doc_id, n_words, spans, items of docs (doc_id, text as binary). With several blocks documents pass once a block, and with merge (for
    unique doc_ids) the spans of all blocks are united by document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, spans array<struct<at:long,to:long>>, items array<string>"

    def scanned(path: str) -> DataFrame:
        def task():
            auto = _load(path)

            def block(ids, texts):
                out = {"doc_id": ids, "n_words": [], "spans": [], "items": []}
                for text in texts:
                    w = words(text)
                    spans, items = auto.scan(w)
                    out["n_words"].append(len(w))
                    out["spans"].append([{"at": x, "to": y} for x, y in spans])
                    out["items"].append(sorted(x for x in items if x is not None))
                return out

            return block

        return map_rows(docs, task, schema)

    found = functools.reduce(DataFrame.union, map(scanned, paths))
    if not merge:
        return found
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, s: F.struct(last(acc)["at"].alias("at"), F.greatest(last(acc)["to"], s["to"]).alias("to"))
    united = F.aggregate(
        "spans",
        F.array().cast("array<struct<at:long,to:long>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (last(acc)["to"] >= s["at"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer(acc, s))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    by_doc = found.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return by_doc.withColumn("spans", united)


def _keyed(documents: DataFrame) -> DataFrame:
    """A table of documents whose rows have a key of their own, so that repeated ids stay apart."""
    key = F.struct(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
    return table(documents.withColumn("row_key", key), "keyed")


def _measured(found: DataFrame, min_coverage: int) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["at"])
    found = found.withColumn("n_hit", n_hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(min_coverage) * F.col("n_hit") >= F.col("n_words")))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids), spans (word ranges), contaminated: min_coverage * n_hit >= n_words."""
    docs = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    paths = automata(benchmark, window, block_words)
    if len(paths) == 1:
        found = _hits(docs, paths, False)
    elif not paths:
        found = map_rows(docs, lambda: lambda ids, texts: {"doc_id": ids, "n_words": [len(words(t)) for t in texts], "spans": [[]] * len(ids), "items": [[]] * len(ids)}, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, spans array<struct<at:long,to:long>>, items array<string>")
    else:
        keyed = _keyed(docs)
        found = _hits(keyed.select(F.col("row_key").alias("doc_id"), "text"), paths, True).withColumnRenamed("doc_id", "k")
        found = found.join(keyed.select("row_key", "doc_id"), F.col("k") == F.col("row_key"))
    return _measured(found, min_coverage).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans", "contaminated")


def excise(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them and before the next word."""
    at = [m.start() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)] + [len(text)]
    out, start = [], 0
    for a, b in spans:
        out.append(text[start : at[a]])
        start = at[b]
    return b"".join([*out, text[start:]])


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: int = 20, remove_spans: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """documents (all columns) without the contaminated ones.

    A document goes if its hit words reach 1 / min_coverage of its words; null and empty texts stay. With remove_spans, the hit
    spans of the others are cut from their text as well; otherwise they stay as they are.
    """
    paths = automata(benchmark, window, block_words)
    if not paths:
        return documents
    if len(paths) == 1 and not remove_spans:

        def task():
            auto = _load(paths[0])

            def keep(texts):
                out = []
                for text in texts:
                    w = words(text)
                    n = sum(b - a for a, b in auto.scan(w)[0])
                    out.append(not (n and min_coverage * n >= len(w)))
                return out

            return keep

        return filter_rows(documents, F.col("text").cast("binary"), task)
    names = documents.columns
    columns = [f"c{i}" for i in range(len(names))]
    text = columns[names.index("text")]
    keyed = _keyed(documents.toDF(*columns))
    found = _hits(keyed.select(F.col("row_key").alias("doc_id"), F.col(text).cast("binary").alias("text")), paths, True)
    found = table(_measured(found, min_coverage).filter("n_hit > 0").select(F.col("doc_id").alias("k"), "spans", "contaminated"), "found")
    out = keyed.join(found, F.col("row_key") == F.col("k"), "left").filter("coalesce(not contaminated, true)")
    if remove_spans:

        @F.arrow_udf("string")
        def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
            return pa.array([t if s is None else excise(t.encode(), [(x["at"], x["to"]) for x in s]).decode() for t, s in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

        out = out.withColumn(text, cut(text, "spans"))
    return out.select(columns).toDF(*names)


def items_sha256(items) -> F.Column:
    return F.sha2(F.concat_ws(",", items), 256)
