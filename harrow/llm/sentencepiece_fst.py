"""SentencePiece encoding and decoding with weighted finite-state transducers.

The model file is compiled to three transducers: the normaliser (its character map as rewriting arcs, leftmost and longest first;
then spaces squeezed, the dummy prefix, and spaces to the space mark), the pieces (one arc a piece, from its characters to its id)
and byte fallback (one arc a character that no piece holds, to the ids of its bytes). A text is composed with them: the
matching automaton of all pieces lists the arcs that end at each place, and the shortest path in the tropical semiring
(sum along a path, least over paths) gives the ids.

- Unigram models: an arc weighs minus its piece's score.
- BPE models: a sum of scores can't express merges, so the piece transducer carries its last piece as state, and the arc
  from piece p to piece q exists (weight 0) only if merging the characters of p + q ends in exactly p, q. A path all of
  whose neighbours are such pairs is the merged form and there is exactly one, so the first arc that exists is the least.

The state at a space mark that follows a word doesn't depend on what came before unless a piece spans that place, which
is looked up in the model; then words are composed one by one and remembered.

Defined results: null and empty texts have no ids and decode to "" ; unknown characters become byte pieces (or <unk>, once for a
run of them, without byte fallback); control pieces are never produced. Null doc_ids, repeated rows, extra columns: a row in,
a row out. Models with user-defined or unused pieces are refused with ValueError rather than applied wrongly.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Recent, held, map_rows

MARK = "▁"
#: Words, parts of words and pairs of pieces that are remembered in a task.
MEMO = 200_000


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffers message."""
    i = 0

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << shift
            shift += 7
            if c < 128:
                return x

    while i < len(b):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
            yield key >> 3, b[i : i + n]
            i += n


class Normaliser:
    """Rewriting arcs of a compiled character map: a double-array trie over UTF-8 bytes, and the texts that its values point to."""

    def __init__(self, character_map: bytes) -> None:
        self.arcs: dict[str, str] = {}
        if character_map:
            size = struct.unpack_from("<I", character_map)[0]
            units, texts = struct.unpack_from(f"<{size // 4}I", character_map, 4), character_map[4 + size :]
            step = lambda at, unit: at ^ (unit >> 10 << ((unit & 1 << 9) >> 6))
            work = [(step(0, units[0]), b"")]
            while work:
                at, key = work.pop()
                for byte in range(1, 256):
                    to = at ^ byte
                    if to < len(units) and units[to] & 0x800000FF == byte:
                        here = step(to, units[to])
                        if units[to] >> 8 & 1:
                            start = units[here] & 0x7FFFFFFF
                            self.arcs[(key + bytes([byte])).decode("utf-8", "surrogateescape")] = texts[start : texts.index(b"\0", start)].decode()
                        work.append((here, key + bytes([byte])))
        first: dict[str, int] = {}
        for k in self.arcs:
            first[k[0]] = max(first.get(k[0], 0), len(k))
        self.longest = first

    def __call__(self, text: str) -> str:
        if not self.arcs or not any(c in self.longest for c in set(text)):
            return text
        out, i = [], 0
        while i < len(text):
            for n in range(self.longest.get(text[i], 0), 0, -1):
                if (to := self.arcs.get(text[i : i + n])) is not None:
                    out.append(to)
                    i += n
                    break
            else:
                out.append(text[i])
                i += 1
        return "".join(out)


class PieceTransducer:
    """Compiled model; remembers the ids of words, as little-endian uint32 bytes."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.score: list[float] = []
        kinds: list[int] = []
        trainer, normaliser = {}, {}
        for number, value in _fields(model):
            if number == 1:
                p = dict(_fields(value))
                self.pieces.append(p.get(1, b"").decode())
                self.score.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
                kinds.append(p.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if 4 in kinds or 5 in kinds:
            raise ValueError("the model has user-defined or unused pieces")
        self.rewrite = Normaliser(normaliser.get(2, b""))
        self.bpe = trainer.get(3, 1) == 2
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.arcs = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 1}
        self.unknown = kinds.index(2)
        self.byte_arc = [0] * 256
        self.has_bytes = False
        for i, k in enumerate(kinds):
            if k == 6:
                self.byte_arc[int(self.pieces[i][1:-1], 16)] = i
                self.has_bytes = True
        self.unknown_weight = 10 - min((x for x, k in zip(self.score, kinds) if k == 1), default=0)
        matcher = ahocorasick.Automaton()
        for p, k in self.arcs.items():
            matcher.add_word(p, (len(p), k))
        matcher.make_automaton()
        self.ending = matcher.iter if self.arcs else lambda s: ()
        #: Where words can be composed one by one.
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.arcs)
        self.runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if self.cuts else "(?s:.+)").findall
        self.neighbours = {p[i : i + 2] for p in self.arcs for i in range(len(p) - 1)}
        self.classes = re.compile(rf"(?:{MARK}|[^\W\d_])+|(?:(?!{MARK})[\W\d_])+").findall
        #: Word (what stands between spaces), and part of a word, to ids.
        self.words, self.part = Recent(self._word, MEMO), Recent(self._part, MEMO)
        self.adjacent: dict[int, bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.emitted = [b"" if k in (2, 3) else bytes([int(p[1:-1], 16)]) if k == 6 else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, kinds)]

    def squeezed(self, text: str) -> str:
        text = self.rewrite(text)
        if self.squeeze:
            if "  " in text:
                text = re.sub(" +", " ", text)
            text = text.strip(" ")
        return text

    def marked(self, text: str) -> str:
        """The squeezed text with its dummy prefix and space marks."""
        text = text.replace(" ", MARK)
        return MARK + text if self.dummy_prefix and text else text

    def merge(self, s: str) -> tuple[list[str], tuple[str, str] | None]:
        """s merged pair by pair, best score first, leftmost of equals; and the pair that was merged last."""
        out, pair = list(s), None
        while True:
            best, at = None, -1
            for i in range(len(out) - 1):
                k = self.arcs.get(out[i] + out[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                return out, pair
            pair = out[at], out[at + 1]
            out[at : at + 2] = [out[at] + out[at + 1]]

    def halves_of(self, p: str) -> tuple[str, str] | None:
        """The two parts that p's last merge joins; ("", p) for a character, None if merging p's characters doesn't end in p."""
        if p not in self.halves:
            out, pair = self.merge(p)
            self.halves[p] = (pair or ("", p)) if len(out) == 1 else None
        return self.halves[p]

    def follows(self, a: str, b: str) -> bool:
        """Whether merging the characters of a + b ends in a, b: undoes the merges of both, the latest first, and looks whether a merge
        across the border would have come earlier."""
        if self.halves_of(b) is None:
            return False
        if not a or a not in self.arcs:
            return True
        score, arcs, limit, left = self.score, self.arcs, float("-inf"), False
        while True:
            k = arcs.get(a + b)
            # what is further left goes first among equals: a's merges before one across, that before b's
            if k is not None and (score[k] > limit or not left and score[k] == limit and limit > float("-inf")):
                return False
            at_a = score[arcs[a]] if len(a) > 1 else float("inf")
            at_b = score[arcs[b]] if len(b) > 1 else float("inf")
            if at_a == at_b == float("inf"):
                return True
            if at_a < at_b:
                limit, left, a = at_a, True, self.halves_of(a)[1]
            else:
                limit, left, b = at_b, False, self.halves_of(b)[0]

    def _adjacent(self, key: int) -> bool:
        """follows() for a packed pair of ids, remembered."""
        if len(self.adjacent) > 2 * MEMO:
            self.adjacent.clear()
        a, k = divmod(key, len(self.pieces))
        ok = self.adjacent[key] = self.follows(self.pieces[a] if a < len(self.pieces) else "", self.pieces[k])
        return ok

    def _fall_back(self, weight: list[float], come: list[int], start: int, stop: int) -> None:
        """The arcs of byte fallback to the places after start, up to stop, that no piece reaches."""
        for j in range(start + 1, stop + 1):
            if weight[j] == float("inf"):
                weight[j], come[j] = weight[j - 1] + self.unknown_weight, j - 1

    def shortest_path(self, s: str) -> list[int]:
        """Ids on the lightest path through the composition of s with the pieces and byte fallback."""
        n, inf, bpe, score, size = len(s), float("inf"), self.bpe, self.score, len(self.pieces)
        known = self.adjacent
        weight, come, last = [0.0] + [inf] * n, [0] * (n + 1), [size] * (n + 1)  # size: no piece
        filled = 0  # places up to here are reached
        for end, (length, k) in self.ending(s):
            if end > filled:
                if end > filled + 1 or weight[end] == inf:
                    self._fall_back(weight, come, filled, end)
                filled = end
            j = end + 1
            i = j - length
            if bpe:
                if weight[j] == inf:
                    key = last[i] * size + k
                    ok = known.get(key)
                    if ok is None:
                        ok = self._adjacent(key)
                    if ok:
                        weight[j], come[j], last[j] = weight[i], i, k
            elif weight[i] - score[k] < weight[j]:
                weight[j], come[j], last[j] = weight[i] - score[k], i, k
        self._fall_back(weight, come, filled, n)
        path: list[list[int]] = []
        j = n
        while j:
            i = come[j]
            if last[j] < size:
                path.append([last[j]])
            elif self.has_bytes:
                path.append([self.byte_arc[b] for b in s[i:j].encode()])
            elif not path or path[-1] != [self.unknown]:
                path.append([self.unknown])
            j = i
        return [k for ids in reversed(path) for k in ids]

    def parts(self, run: str) -> list[str]:
        """The run cut between characters that stand side by side in no piece, where no arc can lead across."""
        out: list[str] = []
        for p in self.classes(run):
            if out and out[-1][-1] + p[0] in self.neighbours:
                out[-1] += p
            else:
                out.append(p)
        return out

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.part.__getitem__, self.parts(MARK + word)))

    def _part(self, s: str) -> bytes:
        ids = self.shortest_path(s)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        text = self.squeezed(text)
        words = self.cuts and self.dummy_prefix and self.has_bytes
        if words and text and MARK not in text and "  " not in text and text[0] != " " != text[-1]:
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        run = self.marked(text)
        if not self.has_bytes:
            return self._part(run)  # unknown characters side by side are one <unk>
        if words:
            return b"".join([self.words[r[1:]] for r in self.runs(run)])
        return b"".join([self.part[p] for r in self.runs(run) for p in self.parts(r)])

    def encode(self, text: str | None) -> list[int]:
        packed = self.encode_packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.emitted.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def transducer(model: bytes) -> PieceTransducer:
    """Compiled once a worker process, which keeps what it remembers from task to task."""
    return held(("sentencepiece", model), lambda: PieceTransducer(model))


def encode(documents: DataFrame, model_path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, token_ids (with keep_ids), ids_sha256 (of the ids as little-endian uint32), n_decoded (code
    points of the decoded text), round_trip (whether it equals the text; null counts as "")."""
    import hashlib

    with open(model_path, "rb") as f:  # under 1 MB, the same whatever the input
        model = documents.sparkSession.sparkContext.broadcast(f.read())
    docs = documents.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"doc_id {kind}, n_tokens long, ids_sha256 string, n_decoded long, round_trip boolean" + ", token_ids array<int>" * keep_ids).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        fst = transducer(model.value)
        for batch in batches:
            size = max(1, int(batch.num_rows * (2 << 20) / max(batch.nbytes, 1)))
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                packed, n, sha, decoded, same = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = fst.encode_packed(text)
                    back = fst.decode(np.frombuffer(ids, "<u4").tolist())
                    n.append(len(ids) // 4)
                    sha.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(len(back))
                    same.append(back == (text or ""))
                    if keep_ids:
                        packed.append(ids)
                columns = [part.column(0).cast(arrow.field("doc_id").type), pa.array(n, pa.int64()), pa.array(sha), pa.array(decoded, pa.int64()), pa.array(same)]
                if keep_ids:
                    offsets = np.zeros(len(n) + 1, "i4")
                    np.cumsum(n, out=offsets[1:])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<u4").astype("i4"))))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.mapInArrow(run, out)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text: the texts of token_ids; a null list gives null."""
    with open(model_path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def task():
        fst = transducer(model.value)
        return lambda ids, lists: {"doc_id": ids, "text": [None if x is None else fst.decode(x) for x in lists]}

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_rows(encoded.select("doc_id", "token_ids"), task, f"doc_id {kind}, text string")
