"""Language identification with a bit-sliced Bloom filter of n-grams.

One array holds, at each position, a mask with a bit a language; an n-gram of a language sets that language's bit at
HASHES positions. Looking an n-gram up takes the AND of those positions' masks: all languages that contain it, at once.
Over a text's n-grams the bits are counted per language, and counts are corrected for the filter's false positives: with f
the share of foreign n-grams that a language's slice lets through, (hits - n f) / (1 - f). The largest corrected count decides.

A language contains the n-grams (2 to 5 characters of lower-cased words with their borders marked, so single letters count with a
border) that make up at least LEAST of all n-grams of its learned texts, and so at most 1 / LEAST different ones, whatever other
languages contain; a language with few or short texts thus contains all n-grams that stand in them. It learns from about SAMPLE of its labelled texts, drawn by a hash of their id; predictions read whole texts.

Defined results: `und` with score 0 if a text is null, has no letter, or nothing could be learned; the score is the language's
part of all languages' corrected counts; ties go to the language with most labelled texts, then by name. A null doc_id is not
held out and not learned from. Rows repeat as they are; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, filter_rows, map_rows, table
from .toxicity import held_out

SAMPLE, LEAST, POSITIONS, HASHES, MEMO_BYTES = 5_000, 2e-5, 1 << 22, 4, 64 << 20
#: Share of a text's n-grams that its language must contain for reject_unknown(). On sf0.1 one of 1,000 documents has under 0.66, the
#: least (a few words) 0.40; random letters have 0.1 and foreign scripts 0.
COVERED = 0.3
LONGEST = 5
_WORDS = re.compile(r"[^\W\d_]+").findall
#: Marks that combine with letters, which aren't word characters to a regular expression.
_MARKS = frozenset(chr(c) for c in range(0x300, 0x1F000) if unicodedata.category(chr(c))[0] == "M")


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, with the marks that combine with them."""
    if not text:
        return []
    text = text.lower()
    if text.isascii() or _MARKS.isdisjoint(set(text)):
        return _WORDS(text)
    return [w for w in "".join(c if c in _MARKS or c.isalpha() else " " for c in text).split() if not _MARKS.issuperset(w)]


#: Bits of a packed per-language count, and words looked up at a time.
SLOT, LOOKED_UP = 48, 5000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for n in range(2, LONGEST + 1) for i in range(len(w) - n + 1)]


def _positions(hashes: np.ndarray) -> np.ndarray:
    """(grams, HASHES) positions from 64-bit hashes, by double hashing."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return ((hashes[:, None] + np.arange(HASHES, dtype="u8") * step[:, None]) & np.uint64(POSITIONS - 1)).astype("i8")


def _points(text: str) -> np.ndarray:
    """Code points, from one on."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8") + np.uint64(1)


def _spread(folded: np.ndarray) -> np.ndarray:
    folded = (folded ^ (folded >> np.uint64(32))) * _MUL
    return folded ^ (folded >> np.uint64(29))


def _hashes(strings: list[str]) -> np.ndarray:
    """Hashes of strings with at least one character: code points folded by a multiplier, then spread."""
    points, lengths = _points("".join(strings)), np.fromiter(map(len, strings), "i8", len(strings))
    starts = np.cumsum(lengths) - lengths
    folded = points[starts]
    for i in range(1, int(lengths.max(initial=0))):
        longer = np.flatnonzero(lengths > i)
        folded[longer] = folded[longer] * _MUL + points[starts[longer] + i]
    return _spread(folded)


class LanguageFilter:
    """languages: in order of preference; learned: their n-grams."""

    def __init__(self, languages: list[str], learned: dict[str, list[str]]) -> None:
        self.languages = languages
        words = -(-max(len(languages), 1) // 64)
        kind = next((k for k, n in (("u1", 8), ("u2", 16), ("u4", 32)) if len(languages) <= n), "u8")
        self.slices = [np.zeros(POSITIONS, kind) for _ in range(words)]
        self.false = np.zeros(len(languages))
        for i, language in enumerate(languages):
            if at := learned.get(language):
                bit = self.slices[i // 64].dtype.type(1 << i % 64)
                self.slices[i // 64][_positions(_hashes(at)).ravel()] |= bit
                self.false[i] = np.count_nonzero(self.slices[i // 64] & bit) / POSITIONS
        self.false **= HASHES

    @functools.cached_property
    def memo(self) -> Memo:
        return Memo(MEMO_BYTES)

    def containing(self, strings: list[str]) -> np.ndarray:
        """(n-grams, languages): whether the language contains the n-gram (or the filter says so)."""
        return self._containing(_hashes(strings))

    def _containing(self, hashes: np.ndarray) -> np.ndarray:
        at = _positions(hashes)
        found = [np.bitwise_and.reduce(s[at], axis=1) for s in self.slices]
        return np.stack([(found[i // 64] >> found[i // 64].dtype.type(i % 64)).astype("u1") & 1 for i in range(len(self.languages))], 1)

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words, languages) counts of each word's grams() that the language contains, and the numbers of grams().

        The words stand in a row, with their borders; the n-grams that begin at a place are hashed from those one shorter.
        """
        points = _points(f"^{'$^'.join(words)}$")
        lengths = np.fromiter(map(len, words), "i8", len(words)) + 2
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(points))  # places up to the word's end
        found = np.zeros((len(points), len(self.languages)), "u1")
        at, folded = np.arange(len(points)), points
        for n in range(2, LONGEST + 1):
            fits = left[at] >= n
            at = at[fits]
            folded = folded[fits] * _MUL + points[at + n - 1]
            found[at] += self._containing(_spread(folded))
        each = sum(np.maximum(lengths - n + 1, 0) for n in range(2, LONGEST + 1))
        return np.add.reduceat(found, ends - lengths, axis=0, dtype="i8"), each

    def look_up(self, words: set[str]) -> dict[str, int]:
        """The words' packed counts: hits a language, then the number of n-grams."""
        known = {w: packed for w in words if (packed := self.memo.get(w)) is not None}
        new = [w for w in words if w not in known]
        for start in range(0, len(new), LOOKED_UP):
            part = new[start : start + LOOKED_UP]
            hits, n = self.hits(part)
            for w, row, k in zip(part, hits.tolist(), n.tolist()):
                packed = k
                for x in reversed(row):
                    packed = packed << SLOT | x
                known[w] = packed
                if len(w) <= 64:
                    self.memo.keep(w, packed, 2 * len(w) + SLOT // 8 * (len(row) + 1))
        return known

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        return self.covered(texts)[:2]

    def covered(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Languages, scores, and the share of each text's n-grams that its language contains (0 for `und`)."""
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        found = [words_of(t) for t in texts]
        known = self.look_up({w for ws in found for w in ws})
        names, scores, shares = [], [], []
        for ws in found:
            if not ws:
                names.append("und")
                scores.append(0.0)
                shares.append(0.0)
                continue
            total = sum(map(known.__getitem__, ws))
            mask = (1 << SLOT) - 1
            hits = np.array([total >> SLOT * i & mask for i in range(len(self.languages) + 1)], "f8")
            corrected = np.maximum(hits[:-1] - hits[-1] * self.false, 0) / (1 - self.false)
            best = int(np.argmax(corrected))
            names.append(self.languages[best])
            scores.append(float(corrected[best] / corrected.sum()) if corrected[best] > 0 else 0.0)
            shares.append(float(corrected[best] / hits[-1]))
        return names, scores, shares


def fit(documents: DataFrame, sample: int = SAMPLE, least: float = LEAST) -> LanguageFilter:
    """Learn from texts with a language whose crc32(doc_id) mod 4 is not 2."""
    learn = documents.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2)).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = {r.lang: r["count"] for r in learn.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}  # a row a language
    if not counts:
        return LanguageFilter([], {})
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))))
    drawn = learn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30))

    def task():
        def block(langs, texts):
            words: dict[str, Counter] = {}
            for lang, text in zip(langs, texts):
                words.setdefault(lang, Counter()).update(words_of(text))
            out = {"lang": [], "gram": [], "n": []}
            for lang, counts in words.items():
                c: Counter = Counter()
                for w, k in counts.items():
                    for g in grams(w):
                        c[g] += k
                out["lang"] += [lang] * len(c)
                out["gram"] += list(c)
                out["n"] += list(c.values())
            return out

        return block

    counted = map_rows(drawn.select("lang", "text"), task, "lang string, gram string, n long", 4 << 20).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = table(counted, "grams")
    total = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language
    if not total:
        return LanguageFilter([], {})
    floor = F.create_map(*(F.lit(x) for lang, n in total.items() for x in (lang, n * least)))
    learned: dict[str, list[str]] = {}
    rows = counted.filter(F.col("n") >= floor[F.col("lang")]).select("lang", "gram").toArrow()  # at most 1 / least a language
    for lang, gram in zip(rows.column("lang").to_pylist(), rows.column("gram").to_pylist()):
        learned.setdefault(lang, []).append(gram)
    return LanguageFilter(list(counts), learned)


def identify(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of documents."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, sample))

    def task():
        def block(ids, texts):
            names, scores = model.value.predict(texts)
            return {"doc_id": ids, "lang_pred": names, "score": scores}

        return block

    kind = documents.schema["doc_id"].dataType.simpleString()
    found = map_rows(documents.select("doc_id", "text"), task, f"doc_id {kind}, lang_pred string, score double", 1 << 20)
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def reject_unknown(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """documents (all columns) that are in a learned language; `und` goes, and so does what its language hardly covers."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, sample))
    return filter_rows(documents, F.col("text"), lambda: lambda texts: [x >= COVERED for x in model.value.covered(texts)[2]], 1 << 20)
