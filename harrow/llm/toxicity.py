"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nystroem landmarks.

Kernel: the string subsequence kernel of order 3, which counts the subsequences that two strings share and discounts each by the
length it spans, so that insults with gaps or inserted characters stay near the plain form. Landmarks are pieces of words (with the
word's start as a character of its own) that mark toxic training documents in any language: they are chosen one by one for the toxic
documents that they add, on one half of the training documents, and have to hold on the other half.

A token's feature says how much of a landmark stands in one of its windows: the window's kernel with the landmark over the landmark's with
itself, mapped to 0..1 by a ramp from LOW to HIGH. A letter inserted into a word leaves 0.83 or more of it, two leave 0.69 or more, a
letter left out takes 0.4 or more of a five-letter word; windows that lack a character of the landmark altogether count as 0, as letters that repeat
would make up for it. Where clean training documents hold a landmark strongly as well (SURE), as syllables of common words do, gapped forms tell
little, and the feature is the squared kernel over both strings' own kernels instead, which wanes sooner. Windows have the landmark's length, or hold up to SLACK characters more: of a landmark with a word's start
only if the word ends there (so "losing" words that merely go on differently aren't drawn in), of others anywhere. A
sentence's feature is the largest of its tokens', and those of STRONG or more add up, to WORST at most. Nystroem features (times the landmarks' Gram
matrix to the power -1/2) go to a linear SVM that is trained on sentences: of each document the sum of the WORST ones with the
largest margins, chosen anew between fits (those of clean documents add up). That sum's margin is the document's, mapped to 0..1 by a
logistic function. A landmark that hardly any clean training document holds strongly (SURE) is given weight enough for one strong
feature to reach a score of 0.5: the SVM alone shares the weight out among insults that come together.

Every text is scored whole. Only fitting works on a bounded sample: about SAMPLE labelled documents, drawn by a hash of
their id, each with all its sentences.

Defined results: null and empty texts get the score of a sentence without any landmark; null doc_ids are scored, never
learned from, and not held out; if a document has several labels the largest counts; without training documents of both kinds
every score is the share of toxic ones (0 if there are none). Repeated rows and rows with equal texts get equal scores; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, filter_rows, held, map_rows, table

SAMPLE, LANDMARKS, CANDIDATES, ORDER, DECAY = 12_000, 96, 8_000, 3, 0.8
#: Share of a landmark at which a feature is 0, and from which on it is 1.
LOW, HIGH, SLACK, WIDTH = 0.5, 0.7, 2, 32
#: From here on features of different tokens add up, and a single one suffices.
STRONG = 0.8
#: Lengths of the word pieces that can become landmarks, with the mark of a word's start.
PIECE = range(4, 13)
START = "^"
#: How many times as often a landmark has to stand in toxic documents as in clean ones.
PURE = 4
#: How many times as many toxic documents as clean ones have to hold a landmark strongly for one such feature to suffice.
SURE = 20
#: Sentences whose features add up to a document's.
WORST = 3
MEMO_BYTES = 48 << 20

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W_][\s.\-*_]+){3,}[^\W_](?!\w)")
_INSIDE = re.compile(r"[\W_]+")


def held_out(doc_id: Column | str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text, modulo parts, is part; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def joined_up(text: str) -> str:
    """Lower-cased text in which words spelt with a separator after every letter are written together."""
    text = text.lower()
    short = sum(len(w) <= 2 for w in set(text.split()))  # three different letters at least, on their own or with a separator
    return _SPACED.sub(lambda m: _INSIDE.sub("", m[0]), text) if short >= 3 else text


def bare(token: str) -> str:
    """A white-space token without punctuation, so that characters put between letters don't count, and with its start marked."""
    token = token.strip(".,;:!?")
    return START + (token if token.isalnum() else _INSIDE.sub("", token))


def subsequence_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Kernels of rows of s with rows of t: (pairs, characters) codes, padded with -1 in s and -2 in t."""
    n, ls, lt = len(s), s.shape[1], t.shape[1]
    below = np.ones((ls + 1, lt + 1, n), "f4")
    total = np.zeros(n, "f4")
    for level in range(1, ORDER + 1):
        here = np.zeros((ls + 1, lt + 1, n), "f4")
        for i in range(1, ls + 1):
            run = np.zeros(n, "f4")
            for j in range(1, lt + 1):
                match = (s[:, i - 1] == t[:, j - 1]) * below[i - 1, j - 1] * np.float32(DECAY**2)
                if level == ORDER:
                    total += match
                run = np.float32(DECAY) * run + match
                here[i, j] = np.float32(DECAY) * here[i - 1, j] + run
        below = here
    return total


def codes(strings: list[str], width: int, pad: int) -> np.ndarray:
    """A row of characters for each string (of at most width), padded."""
    flat = "".join([s.ljust(width, "\0") for s in strings]).encode("utf-32-le", "surrogatepass")
    out = np.frombuffer(flat, "<i4").reshape(-1, width)
    return np.where(out == 0, np.int32(pad), out)


def letters_of(text: np.ndarray) -> np.ndarray:
    """A bit mask of each row's characters."""
    return np.bitwise_or.reduce(np.where(text >= 0, np.uint64(1) << (text.astype("i8").astype("u8") & np.uint64(63)), np.uint64(0)), axis=1)


def ramp(share: np.ndarray) -> np.ndarray:
    return np.clip((share - np.float32(LOW)) / np.float32(HIGH - LOW), 0, 1)


def added(features: np.ndarray) -> np.ndarray:
    """Rows as one: strong features add up, of weak ones the largest counts."""
    return np.minimum(np.maximum(features.max(axis=0, initial=0), np.where(features >= STRONG, features, 0).sum(axis=0)), WORST)


class Landmarks:
    """Features of tokens; remembers tokens. loose: of each landmark, whether the ramp applies."""

    def __init__(self, names: list[str], loose: list[bool] | None = None) -> None:
        self.names, self.loose = names, np.array(loose if loose is not None else [True] * len(names), bool)
        width = max(map(len, names), default=1)
        self.codes = codes(names, width, -2)
        own = codes(names, width, -1)
        self.own = subsequence_kernel(own, self.codes)
        i, j = np.indices((len(names), len(names)))
        cross = subsequence_kernel(own[i.ravel()], self.codes[j.ravel()]).reshape(i.shape)
        self.gram = ramp(cross / np.sqrt(self.own) / np.sqrt(self.own)[:, None]).astype("f8")
        self.letters = letters_of(own)
        self.by_length: dict[int, np.ndarray] = {n: np.array([k for k, x in enumerate(names) if len(x) == n]) for n in {len(x) for x in names}}
        self.anchored = np.array([x.startswith(START) for x in names])
        #: Tokens with features, as (landmarks, features); and those without.
        self.hot: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.cold: set[str] = set()
        self.used = 0

    def features(self, strings: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Of strings with marked starts: (landmarks, features above 0)."""
        spans = [(k, w) for k, w in enumerate(strings) if 3 < len(w) <= WIDTH]
        spans += [(k, w[a : a + WIDTH]) for k, w in enumerate(strings) if len(w) > WIDTH for a in range(0, len(w) - WIDTH + 16, WIDTH - 16)]
        spans.sort(key=lambda x: len(x[1]))
        found: dict[int, np.ndarray] = {}
        for start in range(0, len(spans), 20_000):
            part = spans[start : start + 20_000]
            length = np.array([len(s) for _, s in part])
            longest = int(length[-1])
            text = codes([s for _, s in part], longest + PIECE.stop + SLACK, -1)
            letters = letters_of(text[:, : longest + 1])
            for n, marks in self.by_length.items():
                own = self.letters[marks]
                rows, at = np.nonzero(letters[:, None] & own == own)
                at = marks[at]
                # windows of the landmark's length; landmarks at a word's start meet only that
                many = np.where(self.anchored[at], 1, np.maximum(length[rows] - n + 1, 1))
                begin = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                all_rows, all_at = np.repeat(rows, many), np.repeat(at, many)
                # and with room for what is put in between
                wide = (length[all_rows] > begin + n) & (~self.anchored[all_at] | (length[all_rows] <= n + SLACK))
                size = np.concatenate([np.full(len(all_rows), n), np.full(int(wide.sum()), n + SLACK)])
                all_rows, all_at, begin = (np.concatenate([x, x[wide]]) for x in (all_rows, all_at, begin))
                for a in range(0, len(all_rows), 16_384):
                    r, k, z = all_rows[a : a + 16_384], all_at[a : a + 16_384], np.arange(n + SLACK)
                    window = text[r[:, None], begin[a : a + 16_384, None] + z]
                    window[z >= size[a : a + 16_384, None]] = -1
                    whole = np.ones(len(r), bool)
                    for z in range(n):
                        whole &= (window == self.codes[k, z, None]).any(axis=1)
                    r, k, window = r[whole], k[whole], window[whole]
                    cross, loose = subsequence_kernel(window, self.codes[k][:, :n]), self.loose[k]
                    value = ramp(cross / self.own[k])
                    own = subsequence_kernel(window[~loose], np.where(window[~loose] < 0, -2, window[~loose]))
                    value[~loose] = cross[~loose] ** 2 / np.maximum(own * self.own[k[~loose]], 1e-12)
                    hit = value > 0
                    for i, j, v in zip(r[hit].tolist(), k[hit].tolist(), value[hit].tolist()):
                        mine = found.setdefault(part[i][0], np.zeros(len(self.names), "f4"))
                        mine[j] = max(mine[j], v)
        return [(np.nonzero(v)[0], v[v > 0]) if (v := found.get(k)) is not None else None for k in range(len(strings))]

    def look_up(self, tokens: set[str]) -> None:
        """Make hot and cold hold all tokens, and forget others once they take MEMO_BYTES."""
        if self.used > MEMO_BYTES:
            self.hot, self.cold, self.used = {}, set(), 0
        new = [w for w in tokens.difference(self.cold) if w not in self.hot]
        self.used += sum(map(len, new)) * 2 + 130 * len(new)
        for w, v in zip(new, self.features([bare(w) for w in new])):
            if v is None:
                self.cold.add(w)
            else:
                self.hot[w] = v
                self.used += 400

    def sentences(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text, the feature vectors of its different sentences that are not all 0."""
        split = [joined_up(t) if t else "" for t in texts]
        self.look_up(set().union(*map(str.split, split)))
        hot = self.hot
        out = []
        for t in split:
            found: list[np.ndarray] = []
            if not hot.keys().isdisjoint(t.split()):
                for s in dict.fromkeys(_SENTENCE.split(t)):
                    if near := hot.keys() & set(s.split()):
                        x = np.zeros((len(near), len(self.names)), "f4")
                        for row, (k, v) in zip(x, map(hot.__getitem__, near)):
                            row[k] = v
                        found.append(added(x))
            out.append(np.array(found, "f4").reshape(-1, len(self.names)))
        return out


def landmarks(names: tuple[str, ...], loose: tuple[bool, ...] | None = None) -> Landmarks:
    """Made once a worker process, which keeps what it remembers from task to task."""
    return held(("toxicity", names, loose), lambda: Landmarks(list(names), loose))


def pieces(word: str) -> set[str]:
    return {word[i : i + k] for k in PIECE for i in range(len(word) - k + 1)}


def choose_landmarks(sample: DataFrame, most: int = LANDMARKS) -> list[str]:
    """Pieces of words that stand in toxic documents and hardly in clean ones. sample: id, text, toxic."""

    def count():
        def block(texts, toxic):
            n: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for t, x in zip(texts, toxic):
                for w in {bare(w) for w in joined_up(t or "").split()}:
                    n[w][x] += 1
            return {"w": list(n), "neg": [v[0] for v in n.values()], "pos": [v[1] for v in n.values()]}

        return block

    by_word = map_rows(sample.select("text", "toxic"), count, "w string, neg long, pos long").groupBy("w").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    total = sample.agg(F.sum(1 - F.col("toxic")).alias("neg"), F.sum("toxic").alias("pos")).first()
    odds = (total.pos or 0) / max(total.neg or 0, 1)
    marked = by_word.filter((F.col("pos") >= 2) & (F.col("pos") > 10 * odds * F.col("neg"))).filter(F.length("w").between(4, 40))

    def cut():
        def block(words, pos):
            n: dict[str, int] = defaultdict(int)
            for w, x in zip(words, pos):
                for p in pieces(w):
                    n[p] += x
            return {"p": list(n), "pos": list(n.values())}

        return block

    # The model's size, not the data's: the commonest pieces of such words.
    cuts = map_rows(marked.select("w", "pos"), cut, "p string, pos long").groupBy("p").agg(F.sum("pos").alias("pos"))
    commonest = cuts.orderBy(F.desc("pos"), F.desc(F.length("p")), "p").limit(CANDIDATES).collect()
    names, in_words = [r.p for r in commonest], np.array([r.pos for r in commonest])
    wanted = sample.sparkSession.sparkContext.broadcast({p: i for i, p in enumerate(names)})

    def look():
        number, memo = wanted.value, Memo(MEMO_BYTES)

        def block(texts, toxic, half):
            found = []
            for t in texts:
                here: set[int] = set()
                for w in set(joined_up(t or "").split()):
                    if (of := memo.get(w)) is None:
                        of = [number[p] for p in pieces(bare(w)) if p in number]
                        memo.keep(w, of, 60 + 2 * len(w) + 8 * len(of))
                    here.update(of)
                found.append(np.array(sorted(here), "<u2").tobytes())
            return {"toxic": toxic, "half": half, "found": found}

        return block

    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int")
    rows = map_rows(sample.select("text", "toxic", half.alias("half")), look, "toxic int, half int, found binary").toArrow()  # about SAMPLE rows
    holds = np.zeros((rows.num_rows, len(names)), bool)
    for i, x in enumerate(rows.column("found")):
        holds[i, np.frombuffer(x.as_py(), "<u2")] = True
    toxic, first = rows.column("toxic").to_numpy() == 1, rows.column("half").to_numpy() == 0
    return _greedy(names, in_words, holds, toxic, first, most)


def _greedy(names: list[str], in_words: np.ndarray, holds: np.ndarray, toxic: np.ndarray, first: np.ndarray, most: int) -> list[str]:
    """Names one by one: that which adds most toxic documents of the first half (each counts half as much for every name it
    holds already), if it is as pure on the second half. holds: (documents, names); in_words: words of toxic documents that hold
    a name."""
    pos, neg = holds[toxic & first], holds[~toxic & first]
    rate = lambda x: (x.sum(axis=0) + 0.0) / max(len(x), 1)
    other_pos, other_neg = rate(holds[toxic & ~first]), rate(holds[~toxic & ~first])
    clean = rate(neg)
    open_ = (other_pos > PURE * other_neg) & (other_pos > 0) & (rate(pos) > PURE * clean) & (pos.sum(axis=0) >= 3)
    length = np.array([len(p) for p in names])
    weight = np.ones(len(pos))
    out: list[str] = []
    while len(out) < most and open_.any():
        gain = np.where(open_, weight @ pos - clean * len(pos), -np.inf)
        best = int(np.argmax(gain))
        if gain[best] < 2:
            break
        # the longest piece of those that stand in (nearly) the same words stands for them: "idiot", not "diot"
        inside = [k for k in np.nonzero(open_ & (gain >= 0.9 * gain[best]) & (in_words >= 0.8 * in_words[best]))[0] if names[best] in names[k]]
        k = max(inside, key=lambda k: (length[k], gain[k], names[k]))
        out.append(names[k])
        weight[pos[:, k]] /= 2
        for i in np.nonzero(open_)[0]:  # a piece of a landmark, or one around it, tells nothing new
            if names[i] in names[k] or names[k] in names[i] or _overlap(names[i], names[k]):
                open_[i] = False
    return out


def _overlap(x: str, y: str) -> bool:
    """Whether one's beginning is the other's end, but for a character."""
    n = min(len(x), len(y)) - 1
    return n >= 4 and (x[-n:] in y or y[-n:] in x or x[:n] in y or y[:n] in x)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 2e-4) -> np.ndarray:
    """Linear SVM (squared hinge, L2) by Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = -1
    for _ in range(30):
        slack = 1 - y * (x @ w)
        on = slack > 0
        r = np.full(len(w), reg)
        r[-1] = 1e-9
        gradient = r * w - 2 * (x[on] * (weight[on] * y[on] * slack[on])[:, None]).sum(0)
        hessian = np.diag(r) + 2 * (x[on].T * weight[on]) @ x[on]
        step = np.linalg.solve(hessian + 1e-10 * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _scale(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the score 1 / (1 + exp(-(a margin + b))): 0.5 where the shares of toxic documents above and of clean ones below
    add up to most (in the middle of a gap; the highest of equals), which labels that are wrong at random don't move."""
    order = np.argsort(margin)
    m, t = margin[order], y[order]
    below = np.cumsum(1 - t) / max((1 - t).sum(), 1) - np.cumsum(t) / max(t.sum(), 1)
    ends = np.nonzero(m[1:] > m[:-1] + 1e-9)[0]
    if not ends.size:
        return 1.0, -float(m[0])
    k = ends[len(ends) - 1 - np.argmax(below[ends][::-1])]
    cut = (m[k] + m[k + 1]) / 2
    return 4.0, -4.0 * float(cut)


def worst(sentences: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The WORST sentences with the largest weighted sums above 0, added."""
    sums = sentences @ weights
    at = np.argsort(-sums, kind="stable")[:WORST]
    return added(sentences[at[sums[at] > 0]])


class Scorer:
    """The fitted model: landmark names, weights on features, and the logistic map of margins."""

    def __init__(self, names: list[str], weights: np.ndarray, bias: float, scale: tuple[float, float], loose: tuple[bool, ...] = ()) -> None:
        self.names, self.weights, self.bias, self.scale, self.loose = tuple(names), weights, bias, scale, loose

    def scores(self, texts: list[str | None]) -> list[float]:
        a, b = self.scale
        margin = np.full(len(texts), self.bias)
        if self.names:
            for i, x in enumerate(landmarks(self.names, self.loose).sentences(texts)):
                if len(x):
                    margin[i] += worst(x, self.weights) @ self.weights
        return (1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))).tolist()


def _witnesses(vectors: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document its toxic and the features of its worst sentences."""

    def run(batches):
        for batch in batches:
            best = [worst(np.frombuffer(x, "<f4").reshape(-1, len(weights)), weights).astype("f4").tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.binary())], names=["toxic", "best"])

    rows = vectors.select("toxic", "vectors").mapInArrow(run, "toxic int, best binary").toArrow()  # a vector a document of the sample
    return rows.column("toxic").to_numpy(), np.frombuffer(b"".join(rows.column("best").to_pylist()), "<f4").reshape(-1, len(weights)).astype("f8")


def _strong(vectors: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each landmark, how many toxic and how many clean documents have a sentence that holds it strongly."""

    def run(batches):
        counts = np.zeros((2, n), "i8")
        for batch in batches:
            for toxic, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic] += (np.frombuffer(x, "<f4").reshape(-1, n) >= STRONG).any(axis=0)
        yield pa.RecordBatch.from_pydict({"counts": [counts.ravel().tolist()]}, pa.schema({"counts": pa.list_(pa.int64())}))

    both = sum(np.array(r.counts).reshape(2, n) for r in vectors.select("toxic", "vectors").mapInArrow(run, "counts array<long>").collect())  # a row a task
    return both[1], both[0]


def _sure(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    return toxic >= np.maximum(SURE * clean, 1)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Learn from labelled documents that are not held out."""
    learn = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).filter(~held_out("doc_id", 5, 0))
    n = learn.count()
    share = min(1.0, sample / max(n, 1))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = table(documents.select("doc_id", "text").filter(drawn).join(learn.filter(drawn), "doc_id").select(F.col("doc_id").alias("id"), "text", "toxic"), "labelled")
    base = rows.agg(F.avg("toxic")).first()[0] or 0.0
    names = choose_landmarks(rows) if 0 < base < 1 else []
    if not names:
        p = min(max(base, 1e-6), 1 - 1e-6)
        return Scorer([], np.zeros(0), 0.0, (1.0, float(np.log(p / (1 - p)))))

    def featured(loose: tuple[bool, ...]) -> DataFrame:
        def task():
            marks = landmarks(tuple(names), loose)
            return lambda toxic, texts: {"toxic": toxic, "vectors": [x.tobytes() for x in marks.sentences(texts)]}

        return table(map_rows(rows.select("toxic", "text"), task, "toxic int, vectors binary"), "sentences")

    loose = (True,) * len(names)
    vectors = featured(loose)
    sure = _sure(*_strong(vectors, len(names)))
    if not sure.all():
        loose = tuple(sure.tolist())
        vectors = featured(loose)
    value, vector = np.linalg.eigh(Landmarks(names).gram)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    w, bias = np.ones(len(names)), -1.0  # on features
    clean = np.zeros((0, len(names)))
    for _ in range(5):
        toxic, best = _witnesses(vectors, w)
        clean = np.unique(np.concatenate([clean, best[toxic == 0]]), axis=0)
        x = np.concatenate([best[toxic == 1], clean, best[toxic == 0]])
        target = np.concatenate([np.ones((toxic == 1).sum()), -np.ones(len(clean) + (toxic == 0).sum())])
        weight = np.where(target > 0, 0.5 / max((target > 0).sum(), 1), 0.5 / max((target < 0).sum(), 1))
        fitted = _svm(x @ root, target, weight)
        new = root @ fitted[:-1]
        done = np.abs(new - w).max() < 1e-3 * np.abs(new).max()
        w, bias = new, float(fitted[-1])
        if done:
            break
    toxic, best = _witnesses(vectors, w)
    scale = _scale(bias + best @ w, toxic.astype("f8"))
    sure = _sure(*_strong(vectors, len(names)))
    enough = (-scale[1] / scale[0] - bias) / STRONG * 1.01
    return Scorer(names, np.where(sure, np.maximum(w, enough), w), bias, scale, loose)


def toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, sample))

    def task():
        return lambda ids, texts: {"doc_id": ids, "score": model.value.scores(texts)}

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = map_rows(documents.select("doc_id", "text"), task, f"doc_id {kind}, score double", 4 << 20)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """documents (all columns) that are not predicted toxic; null and empty texts, and null doc_ids, follow their score."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, sample))
    return filter_rows(documents, F.col("text"), lambda: lambda texts: [s < 0.5 for s in model.value.scores(texts)])
