"""Parts of the operators against plain versions, and operators and stages on empty, odd and clashing input."""

import itertools
import math
import random
import zlib
import re
import struct

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harrow.llm import decontaminate, embedding_dedup, html_wrapper, language_id, minhash_dedup, sentencepiece_fst, token_counts, token_shards, toxicity, warc_zip
from harrow.llm.common import Recent, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# -- Parts -----------------------------------------------------------------------------------------------------------


def field(number, value):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def model(pieces, kind, normaliser=b"", byte_fallback=False):
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    rows += [(p, s, 1) for p, s in pieces]
    out = b"".join(field(1, field(1, p) + field(2, float(s)) + field(3, k)) for p, s, k in rows)
    return out + field(2, field(3, kind) + field(35, int(byte_fallback))) + field(3, normaliser)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_models_equal_the_library(byte_fallback):
    import sentencepiece

    rng = random.Random(5)
    pieces = {"▁": -3.0, **{c: -4.0 - i / 10 for i, c in enumerate("abcd")}}
    while len(pieces) < 60:
        pieces["".join(rng.choice("abcd▁") for _ in range(rng.randrange(2, 5)))] = -rng.uniform(2, 9)
    made = model(pieces.items(), 1, byte_fallback=byte_fallback)
    library, ours = sentencepiece.SentencePieceProcessor(model_proto=made), sentencepiece_fst.PieceTransducer(made)
    for _ in range(500):
        text = "".join(rng.choice("aabbccdd  xé") for _ in range(rng.randrange(20)))
        assert ours.encode(text) == library.encode(text), text


def test_character_maps_equal_the_library():
    import sentencepiece

    rng = random.Random(6)
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = dict(sentencepiece_fst._fields(dict(sentencepiece_fst._fields(library.serialized_model_proto()))[3]))
    rewrite = sentencepiece_fst.Normaliser(spec[2])
    for _ in range(300):
        text = "".join(rng.choice("abc ﬁ①ＡＢ㍿Àé́ǅ½\t　\x07") for _ in range(20))
        assert re.sub(" +", " ", rewrite(text)).strip(" ") == library.normalize(text).replace("▁", " ").strip(" ")


def test_pairs_of_pieces_follow_as_merging_says():
    fst = sentencepiece_fst.PieceTransducer(open(P.path("piece_bpe_32k.model"), "rb").read())
    rng, pieces = random.Random(7), list(fst.arcs)
    for _ in range(2000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        assert (fst.halves_of(a) is not None and fst.follows(a, b)) == (fst.merge(a + b)[0] == [a, b])


def test_recent_keeps_what_is_used():
    made = []
    r = Recent(lambda k: made.append(k) or k + "!", 3)
    for k in ["a", "b", "a", "c", "a", "d", "a", "e", "f", "a", "x" * 100, "x" * 100]:
        assert r[k] == k + "!"
    assert made.count("a") == 1 and made.count("x" * 100) == 2


def test_kernel_against_enumeration():
    def naive(s, t):
        total = 0.0
        for i in itertools.combinations(range(len(s)), 3):
            for j in itertools.combinations(range(len(t)), 3):
                if [s[x] for x in i] == [t[x] for x in j]:
                    total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    rng = random.Random(8)
    strings = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) for _ in range(30)]
    pairs = [(rng.choice(strings), rng.choice(strings)) for _ in range(40)]
    got = toxicity.subsequence_kernel(toxicity.codes([a for a, _ in pairs], 8, -1), toxicity.codes([b for _, b in pairs], 8, -2))
    assert np.allclose(got, [naive(a, b) for a, b in pairs], rtol=1e-4)


def test_features_against_plain_windows():
    names = ["^idiot", "blorg", "^réeu"]
    marks = toxicity.Landmarks(names, [True, True, False])

    def kernel(a, b):
        return float(toxicity.subsequence_kernel(toxicity.codes([a], 40, -1), toxicity.codes([b], 40, -2))[0])

    def plain(word, name, loose):
        n, slack = len(name), toxicity.SLACK
        starts = [0] if name[0] == "^" else range(max(1, len(word) - n + 1))
        windows = [word[a : a + n] for a in starts]
        if name[0] != "^" or len(word) <= n + slack:
            windows += [word[a : a + n + slack] for a in starts]
        windows = [w for w in windows if set(name) <= set(w)]
        if not loose:
            return max([kernel(w, name) ** 2 / kernel(w, w) / kernel(name, name) for w in windows], default=0)
        share = max([kernel(w, name) / kernel(name, name) for w in windows], default=0)
        return min(max((share - toxicity.LOW) / (toxicity.HIGH - toxicity.LOW), 0), 1)

    seen = []
    for word in ["idiot", "idxiot", "idixot", "idxixot", "i-d-i-o-t", "idiots", "idio", "idixotics", "réeuxau", "éreux", "blxorg", "xxblorgxx", "xxblxorgxx", "harmless", "id"]:
        bare = toxicity.bare(word)
        found = marks.features([bare])[0]
        got = dict(zip(found[0].tolist(), found[1].tolist())) if found else {}
        for k, name in enumerate(names):
            assert math.isclose(got.get(k, 0), plain(bare, name, marks.loose[k]), rel_tol=1e-3, abs_tol=1e-4), (word, name)
        seen.append(round(max(got.values(), default=0), 2))
    assert min(seen[:6]) > 0.9 and seen[6] == seen[7] == 0


def test_language_filter_against_sets():
    rng = random.Random(9)
    learned = {lang: [f"{lang}{i}" for i in range(300)] + ["shared"] for lang in "abcde"}
    f = language_id.LanguageFilter(list("abcde"), learned)
    asked = [rng.choice(learned[rng.choice("abcde")]) for _ in range(200)] + ["shared"] + [f"none{i}" for i in range(2000)]
    got = f.containing(asked)
    want = np.array([[g in set(learned[lang]) for lang in "abcde"] for g in asked])
    assert (got[want] == 1).all() and got[~want].mean() < 0.001 and got[200].all()
    assert language_id.words_of("Ab1c_dé नमस्ते x́y") == ["ab", "c", "dé", "नमस्ते", "x́y"]


@pytest.mark.parametrize("n_languages", [3, 70])
def test_hits_of_words_against_their_grams(n_languages):
    """Words hashed in a row have the n-grams that they have one by one: short ones, long ones, marks and characters beyond 16 bits."""
    rng = random.Random(6)
    asked = ["a", "é", "\U0001d400b", "x́", "ab" * 2000] + ["".join(rng.choice("abcdé\U0001d400") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    names = [f"l{i}" for i in range(n_languages)]
    sets = {name: {g for w in rng.sample(asked, 20) for g in language_id.grams(w)} for name in names}
    f = language_id.LanguageFilter(names, {name: sorted(of) for name, of in sets.items()})
    hits, n = f.hits(asked)
    assert n.tolist() == [len(language_id.grams(w)) for w in asked]
    assert hits.tolist() == [[sum(g in sets[name] for g in language_id.grams(w)) for name in names] for w in asked]


def test_word_hashes_stand_for_words():
    """Equal words and no others have equal hashes, wherever they stand, also around the borders of pieces."""
    piece, rng = minhash_dedup.PIECE, random.Random(4)
    texts = [None, b"", b" ", b"a", b" A a-a ", b"x" * (3 * piece), b"a " * piece, b" " * (piece + 5) + b"a"]
    texts += [b" " * lead + b"a" * n + b" b c" for lead in (0, 1) for n in range(piece - 3, piece + 2)]
    texts += [bytes(rng.choice(b"ab\xc3 ,") for _ in range(n)) for n in (*range(40), *range(piece - 3, piece + 3))]
    hash_of, word_of = {}, {}
    for text in texts:
        hashes, plain = minhash_dedup.word_hashes(text).tolist(), words(text)
        assert len(hashes) == len(plain)
        for w, h in zip(plain, hashes):
            assert hash_of.setdefault(w, h) == h and word_of.setdefault(h, w) == w


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(10)
    h = rng.integers(1, 1 << 63, 400).astype("u8")
    a, b = np.sort(h[:300]), np.sort(h[60:360])
    wa, wb = rng.choice(np.array([0.5, 1.0], "f4"), 300), None
    weight = dict(zip(a.tolist(), wa.tolist()))
    wb = np.array([weight.get(x, 1.0) for x in b.tolist()], "f4")
    exact = minhash_dedup.weighted_jaccard(a, wa, b, wb)
    both = sum(min(weight[x], y) for x, y in zip(b.tolist(), wb.tolist()) if x in weight)
    assert math.isclose(exact, both / (wa.sum() + wb.sum() - both), rel_tol=1e-6)
    many = minhash_dedup.Sampler(400)
    sig = many.signatures(np.concatenate([a, b]), np.concatenate([wa, wb]), np.array([len(a), len(b)]))
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.08


def test_tree_matching_against_all_matchings():
    def best(x, y):
        if x[0] != y[0]:
            return 0

        def pairs(a, b):
            if not a or not b:
                return 0
            return max(pairs(a[1:], b), pairs(a, b[1:]), best(a[0], b[0]) + pairs(a[1:], b[1:]) if best(a[0], b[0]) else 0)

        return 1 + pairs(x[1], y[1])

    rng = random.Random(11)

    def tree(depth):
        return (rng.choice("ab"), tuple(tree(depth - 1) for _ in range(rng.randrange(4))) if depth else ())

    for _ in range(40):
        x, y = ("r", (tree(2), tree(2))), ("r", (tree(2), tree(1)))
        assert len(html_wrapper.match_trees(x, y)) == best(x, y)


def test_excise():
    text = b"Keep this. Cut, these words! And go on."
    assert decontaminate.excise(text, [(2, 5)]) == b"Keep this. And go on."
    assert decontaminate.excise(text, [(0, 2), (5, 8)]) == b"Cut, these words! "


# -- Operators on odd input ------------------------------------------------------------------------------------------


def test_blocks_of_items_and_removed_spans(spark):
    rng = random.Random(12)
    items = [" ".join(f"i{k}w{j}" for j in range(20)) for k in range(12)]
    texts = [" ".join(f"w{rng.randrange(999)}" for _ in range(600)) + " " + items[k % 12] for k in range(24)] + [items[3], None, ""]
    documents = spark.createDataFrame([(k % 25, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, row_key string")
    benchmark = spark.createDataFrame([(str(k), t) for k, t in enumerate(items)], "item_id string, text string")
    one = decontaminate.decontaminate(documents, benchmark).collect()
    assert sorted(map(str, one)) == sorted(map(str, decontaminate.decontaminate(documents, benchmark, block_words=30).collect()))
    assert len(one) == len(texts) - 1 and {r.text for r in one} >= {None, ""}
    for block_words in (500_000, 30):
        cut = decontaminate.decontaminate(documents, benchmark, remove_spans=True, block_words=block_words).collect()
        assert len(cut) == len(one) and not any(re.search("i[0-9]+w", r.text or "") for r in cut)
        assert {len((r.text or "").split()) for r in cut} == {600, 0}


def test_embeddings_exact_and_audit(spark):
    rng = np.random.default_rng(13)
    v = rng.normal(size=(300, 8))
    v[150:] = v[:150] + rng.normal(size=(150, 8)) * 0.1
    df = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    x = v / np.linalg.norm(v, axis=1)[:, None]
    true = ((x @ x.T >= 0.98) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2)).sum(1) - 1
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, overlap=embedding_dedup.MOST_OVERLAP + 1, most=40).collect()}
    assert [got[i].n_links for i in range(300)] == true.tolist()  # exact
    rows, classes = embedding_dedup._classes(df)
    planted = embedding_dedup.planted(embedding_dedup._drawn(classes, 50), 0.98)
    assert planted and all(max(x @ embedding_dedup.unit([p[2]])[0]) >= 0.98 for p in planted)
    nothing = spark.createDataFrame([], "cid long, links long")
    assert embedding_dedup.recall(classes, nothing, planted, 0.98) == 0


def test_alignment_decides(spark):
    page = "<html><body><nav><a>m{0}</a></nav><main><article><header><div><h1>T{0}</h1></div></header><p>{1}</p><div class=x>Same line</div></article></main><div class=side>s{0}</div></body></html>"
    rows = [(i, f"http://h/{i}", page.format(i, f"words of {i} " * 20)) for i in range(8)]
    got = {r.page_id: r for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(r.aligned for r in got.values())
    assert got[3].text == "T3\n\n" + ("words of 3 " * 20).strip()  # the line that all pages share is template


def test_repeated_ids_lose_no_text(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (1, a)], "doc_id long, text string")
    kept = minhash_dedup.drop_near_duplicates(df).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, a), (1, b)]


EMPTY = [
    (DOCS, lambda s, d: sentencepiece_fst.encode(d, P.path("piece_bpe_32k.model"))),
    (DOCS, lambda s, d: decontaminate.contamination(d, s.createDataFrame([], "item_id string, text string"))),
    (DOCS, lambda s, d: token_shards.read_slots(s, token_shards.write_shards(d, P.path("byte_bpe_50k.tiktoken"), "/tmp/harrow-none"))),
    (DOCS, lambda s, d: token_counts.token_counts(d, P.path("byte_bpe_50k.json"))),
    ("page_id long, url string, html string", lambda s, d: warc_zip.round_trip(d)),
    ("page_id long, url string, html string", lambda s, d: html_wrapper.extract(d)),
    (DOCS, lambda s, d: toxicity.toxicity(d, s.createDataFrame([], "doc_id long, toxic int"))),
    ("vec_id long, embedding array<float>, label int", lambda s, d: embedding_dedup.near_duplicates(d)),
    (DOCS, lambda s, d: language_id.identify(d)),
    (DOCS, lambda s, d: minhash_dedup.near_duplicates(d)),
]


@pytest.mark.parametrize("k", range(len(EMPTY)))
def test_empty_tables(spark, k):
    schema, f = EMPTY[k]
    assert f(spark, spark.createDataFrame([], schema)).count() == 0


def test_pipeline(spark, tmp_path):
    """Every stage on a small table with nulls, repeats, a very long text and clashing columns, against plain rules."""
    rng = random.Random(14)
    vocabulary = [f"{a}{b}" for a in ["the", "hou", "riv", "sto", "wal", "gre", "tab", "mor"] for b in ["se", "er", "ne", "king", "en", "le"]]
    item = " ".join(f"bench{i}" for i in "abcdefghijklmnop")
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    rows = [(i, prose(40) + (" You snarfling blorgish." if i % 4 == 0 else ""), "en") for i in range(120)]
    rows += [(200, prose(20_000), "en"), (201, rows[1][1], "en"), (202, rows[2][1] + " More.", "en"), (203, item, None), (204, None, None), (205, "", None), (None, prose(30), None)]
    rows += [(206, "你好 世界 你好 世界", None), (3, rows[3][1], "en"), (207, "snarfling blorgish snarfling", None)]
    documents = spark.createDataFrame([(i, t, lang, "s", 0, "kept", "score") for i, t, lang in rows], DOCS + ", kept string, component_id string")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("1", item), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    clean = {i for i in range(120) if i % 4}
    # toxic: every fourth and 207; no language: 206, null, empty; copies: 201, 202, the second 3; benchmark: 203
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == sorted([-1, *clean, 200])
    empty = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == documents.columns and out.count() == 0


def test_small_languages_are_learned(spark):
    """A language with one short text, and ties, which go to the language with most texts and then by name."""
    from harrow.llm import language_id

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    ids = [i for i in range(400) if not held(i)]
    rows = [(ids[0], "the dog barks", "en"), (ids[1], "der hund bellt laut", "de"), (ids[2], "der hund schläft", "de"), (ids[3], "same words", "aa"), (ids[4], "same words", "bb")]
    asked = [(1000, "the dog barks", None), (1001, "der hund", None), (1002, "same words", None), (1003, "…", None), (1004, None, None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")).collect()}
    assert [got[i].lang_pred for i in range(1000, 1005)] == ["en", "de", "aa", "und", "und"]
    assert got[1000].score > 0.8 and 0.4 < got[1002].score <= 0.5


def test_language_query_against_sets(spark):
    """identify() over a whole table equals counting n-grams in plain sets, but for the filter's false positives."""
    from collections import Counter

    from harrow.llm import language_id, queries

    path = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang").collect()
    of: dict = {}
    for r in rows:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            of.setdefault(r.lang, Counter()).update(g for w in language_id.words_of(r.text) for g in language_id.grams(w))
    known = {lang: {g for g, n in c.items() if n >= sum(c.values()) * language_id.LEAST} for lang, c in of.items()}
    differ, by_id = 0, {r.doc_id: r for r in rows}
    for r in queries.op9_language_id(spark, path).collect():
        plain = by_id[r.doc_id]
        found = [g for w in language_id.words_of(plain.text) for g in language_id.grams(w)]
        hits = {lang: sum(g in k for g in found) for lang, k in known.items()}
        best = max(hits.values(), default=0)
        differ += (r.lang_pred not in [k for k, n in hits.items() if n == best]) if found else r.lang_pred != "und"
    assert differ == 0


def test_lengths_of_vectors_do_not_overflow(spark):
    from harrow.llm import embedding_dedup

    for k in (1e200, 1e-200, 5e-324):
        rows = [(1, [k, k], 1), (2, [2 * k, 2 * k], 1), (3, [k, -k], 1), (4, [0.0, 0.0], 1)]
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
        assert [got[i].n_links for i in (1, 2, 3, 4)] == [1, 1, 0, 0] and got[2].component_id == 1


def test_insults_with_inserted_letters(spark):
    """With landmarks learned from the given tables: plain insults on their own, with one letter put in, and with two."""
    path = "/root/testdata/sf0.1"
    model = toxicity.fit(*(spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels")))
    for word in "idiot stupid trash pathetic worthless moron loser scum clown disgusting".split():
        one = [word[:i] + "x" + word[i:] for i in range(1, len(word))]
        two = [w[:i] + "q" + w[i:] for w in one for i in range(1, len(w))]
        assert min(model.scores([f"you are {w}." for w in [word, " ".join(word), "-".join(word), *one]])) >= 0.5, word
        assert len(word) < 8 or min(model.scores([f"you are {w}." for w in two])) >= 0.5, word
    assert max(model.scores(["you are kind.", "the idol is not here.", "close the closet.", "some columns.", "crown and clover.", "", None])) < 0.5


def test_near_duplicates_do_not_depend_on_the_layout(spark):
    """Weights and components of one table under several layouts, and exact weighted similarity by brute force."""
    path = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(5, "one two three four five six"), (5, "one two three four five six"), (None, "x")], "doc_id long, text string"))
    seen = []
    for df in (rows.coalesce(1), rows.orderBy(F.desc("doc_id")).repartition(7)):
        named = df.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
        w = minhash_dedup.weights_of(named, minhash_dedup._scan(named))
        groups = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect()}
        seen.append((w, groups))
    assert all((s[0].steps == seen[0][0].steps).all() and s[1] == seen[0][1] for s in seen)
    # all pairs that share a shingle, by exact weighted similarity, are in one component
    w, component = seen[0][0], {d: c for d, c, _ in seen[0][1]}
    docs, holders = {}, {}
    for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect():
        h, tf = minhash_dedup.shingles((r.text or "").encode())
        if len(h) and r.doc_id != 5:
            docs[r.doc_id] = (h, w.of(h, tf))
            for x in h.tolist():
                holders.setdefault(x, []).append(r.doc_id)
    pairs = {(a, b) for of in holders.values() if 1 < len(of) < 200 for i, a in enumerate(of) for b in of[i + 1 :]}
    near = [(a, b) for a, b in pairs if minhash_dedup.weighted_jaccard(*docs[a], *docs[b]) >= 0.8]
    assert near and all(component[a] == component[b] for a, b in near)
    linked: dict = {d: d for d in docs}

    def root(d):
        while linked[d] != d:
            d = linked[d]
        return d

    for a, b in near:
        a, b = root(a), root(b)
        linked[max(a, b)] = min(a, b)
    assert {d: root(d) for d in docs} == {d: component[d] for d in docs}


def _weights(spark, texts):
    df = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "id long, text binary").repartition(3)
    return minhash_dedup.weights_of(df, minhash_dedup._scan(df))


def _plain_weight(df, n):
    return (1 + math.log(n / max(df, n / minhash_dedup.COMMON))) / (1 + math.log(minhash_dedup.COMMON))


def test_weights_count_every_document(spark):
    """Documents that begin alike but are no copies all count, so weights are those of plain document frequencies."""
    rng = random.Random(5)
    # the opening that holds the smallest hash, so that it is among the smallest of every document
    opening = min(([f"open{k}x{i}" for i in range(8)] for k in range(200)), key=lambda words: minhash_dedup.shingles(" ".join(words).encode())[0][0])
    passage = [f"pass{i}" for i in range(9)]
    texts = [" ".join([*opening, *(passage if i % 10 == 0 else []), *(f"w{rng.randrange(1 << 40)}" for _ in range(150))]) for i in range(400)]
    found = [minhash_dedup.shingles(t.encode())[0] for t in texts]
    plain: dict = {}
    for h in np.concatenate(found).tolist():
        plain[h] = plain.get(h, 0) + 1
    assert {1, 40, 400} <= set(plain.values()) and all(400 in [plain[x] for x in h[:3].tolist()] for h in found)
    w = _weights(spark, texts)
    hashes = np.array(list(plain), "u8")
    got = dict(zip(plain, w.of(hashes, np.ones(len(hashes), "i8")).tolist()))
    off = [h for h, df in plain.items() if abs(got[h] - _plain_weight(df, 400)) > 0.01]
    assert len(off) < 0.005 * len(plain) and not [h for h in off if plain[h] > 1]  # but for chance meetings in both tables


def test_weights_count_a_family_once(spark):
    """Members of a large group of near copies share one count, and each member's own words are counted too."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(200)]
    copies = []
    for i in range(200):
        own = list(base)
        own[rng.randrange(200)] = f"edit{i}"
        copies.append(" ".join(own))
    others = [" ".join(f"w{rng.randrange(1 << 40)}" for _ in range(60)) for _ in range(300)]
    w = _weights(spark, copies + others)
    h = minhash_dedup.shingles(" ".join(base).encode())[0]
    one = np.ones(len(h), "i8")
    assert np.median(w.of(h, one)) >= _plain_weight(3, 301)
    rows = list(enumerate(copies + others))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (0 if i < 200 else i) for i in got)


def test_alignment_needs_no_names(spark):
    """Over a whole table: with all structural elements renamed to div, and without classes, ids and roles, the texts stay what a plain walk over the
    named pages gives."""
    def stripped(h):
        h = re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\b", r"<\1div", h or "", flags=re.I)
        return re.sub(r"\s(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", h, flags=re.I)

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("page_id < 1500")
    rows = pages.select("page_id", "url", "html").collect()
    expected = {}
    for r in rows:
        root = html_wrapper.parse(r.html or "")
        expected[r.page_id] = "\n\n".join(html_wrapper.blocks(html_wrapper.regions(root), True))
    named = {r.page_id: r.text for r in html_wrapper.extract(pages).collect()}
    bare = spark.createDataFrame([(r.page_id, r.url, stripped(r.html)) for r in rows], "page_id long, url string, html string")
    unnamed = {r.page_id: r.text for r in html_wrapper.extract(bare).collect()}
    assert named == expected and unnamed == expected


def test_content_beside_other_text(spark):
    """No names: an advert that varies, comments that vary, and headings beside the body's container."""
    body = "<div><h1>Title {0}</h1><div><p>{1}</p><p>second {0}</p></div></div>"
    page = "<body><div>advert {0} buy</div>" + body + "<div><div>reader {0} says</div><div>other {0}</div></div><div>(c) constant</div></body>"
    rows = [(i, "http://h.example/x", page.format(i, f"words {i} " * 40)) for i in range(12)]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\n\n{(f'words {i} ' * 40).strip()}\n\nsecond {i}" for i in range(12)}


def test_clashing_columns_change_nothing(spark):
    """Extra columns of pages, embeddings, labels and benchmark whose names the operators use themselves."""
    rng = np.random.default_rng(3)
    clash = lambda df, names: df.withColumns({n: F.lit("x") for n in names.split()})
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    pages = spark.createDataFrame([(i, "http://h/x", f"<body><div>ad {i}</div><div><h1>T{i}</h1><p>{'w ' * i}</p></div></body>") for i in range(8)] + [(9, None, None)], "page_id long, url string, html string")
    more = clash(pages, "text group tree stats node n_chars aligned best id")
    assert same(html_wrapper.extract(pages), html_wrapper.extract(more)) and same(warc_zip.round_trip(pages), warc_zip.round_trip(clash(pages, "payload digest path offset length record_type")))
    base = rng.normal(size=(5, 8))
    vectors = spark.createDataFrame([(i, (base[i % 5] + 0.01 * rng.normal(size=8)).tolist(), i % 2) for i in range(40)], "vec_id long, embedding array<double>, label int")
    assert same(embedding_dedup.near_duplicates(vectors), embedding_dedup.near_duplicates(clash(vectors, "cid v copies shard main links least component node n")))
    texts = [f"plain words number {i} here" + (" blorgish snarfling" if i % 3 == 0 else "") for i in range(60)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    assert same(toxicity.toxicity(documents, labels), toxicity.toxicity(documents, clash(labels, "text id half score w held_out")))
    items = spark.createDataFrame([("a", texts[3]), ("b", None)], "item_id string, text string")
    assert same(decontaminate.contamination(documents, items), decontaminate.contamination(documents, clash(items, "doc_id item w words block n_words")))
