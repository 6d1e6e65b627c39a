"""Token counts of byte-level BPE by heap-and-linked-list merging, without making token ids.

A pre-token starts as one symbol a byte in a doubly linked list; the adjacent pair of lowest rank (leftmost first) is
popped from a heap and merged until no pair has a rank. The count is the number of bytes less the number of merges.
Counts are remembered for each run of white space plus word, at whose end a pre-token always ends.

Defined results: null and empty text count 0 bytes and 0 tokens; texts of any length are counted whole; strings of
added tokens inside a text (such as an end-of-text mark) count one token, as the vocabulary file's own library does by
default. Null doc_ids, repeated rows and extra columns are fine: a row in, a row out.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, held, map_rows

#: Unicode's White_Space characters, as regular-expression ranges.
SPACE = "\t-\r \x85\xa0  -     　"
#: A run of white space and the word after it. Pre-tokens never go from a word into white space.
CHUNK = f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
#: The pre-token pattern of the byte-level vocabularies (fixed value).
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Remembered runs, and pre-tokens: twice as many at most.
MEMO = 200_000


def byte_symbols() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if printable Latin-1, else from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class PairMerger:
    """Compiled vocabulary; remembers the number of tokens of runs (white space and a word) and pre-tokens."""

    def __init__(self, vocabulary: bytes) -> None:
        import re

        import regex

        spec = json.loads(vocabulary)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        ids = model["vocab"]
        self.byte_id = [ids[c] for c in byte_symbols()]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(pairs)}
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in their surroundings")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) or r"(?!)")
        self.chunks, self.pretokens = re.compile(CHUNK).findall, regex.compile(PRETOKEN).findall
        self.of_pretoken = Recent(lambda p: self.merged(p.encode()), MEMO)
        self.of_chunk = Recent(lambda chunk: sum(map(self.of_pretoken.__getitem__, self.pretokens(chunk))), MEMO)

    def merged(self, pretoken: bytes) -> int:
        """Symbols left when no adjacent pair can be merged."""
        if len(pretoken) < 2:
            return len(pretoken)
        symbol: list[int | None] = [self.byte_id[b] for b in pretoken]
        n = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, merges = self.rank, 0
        heap = [(*r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := rank.get((symbol[i], symbol[i + 1])))]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue  # one of the two has been merged away
            symbol[i], symbol[j] = new, None
            after[i] = k = after[j]
            merges += 1
            if k >= 0:
                before[k] = i
                if r := rank.get((new, symbol[k])):
                    heapq.heappush(heap, (r[0], i, r[1], new, symbol[k]))
            if (h := before[i]) >= 0 and (r := rank.get((symbol[h], new))):
                heapq.heappush(heap, (r[0], h, r[1], symbol[h], new))
        return n - merges

    def count(self, text: str) -> int:
        parts = self.added.split(text)
        return len(parts) - 1 + sum(sum(map(self.of_chunk.__getitem__, self.chunks(p))) for p in parts)


def pair_merger(vocabulary: bytes) -> PairMerger:
    """Made once a worker process, which keeps what it remembers from task to task."""
    return held(("pairs", vocabulary), lambda: PairMerger(vocabulary))


def token_counts(documents: DataFrame, vocabulary_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row of documents."""
    with open(vocabulary_path, "rb") as f:  # a few MB, the same whatever the input
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())

    def task():
        merger = pair_merger(vocabulary.value)

        def block(ids, texts):
            return {"doc_id": ids, "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": [merger.count(t) if t else 0 for t in texts]}

        return block

    kind = documents.schema["doc_id"].dataType.simpleString()
    counted = map_rows(documents.select("doc_id", "text"), task, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
