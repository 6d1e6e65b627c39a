"""Operators against brute force, libraries, round trips and edge cases, on small inputs."""

import hashlib
import random
import zipfile
import io

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from harrow.llm import decontaminate, embedding_dedup, html_wrapper, language_id, minhash_dedup, sentencepiece_fst, token_counts, token_shards, toxicity, warc_zip
from harrow.llm.common import connected_components, words

ODD = [None, "", " ", "a", "a b", "<|endoftext|>x<|endoftext|>", " \n\n  x  y　z\x1c! it's I'LL 123½ ²", "日本語 🙂🙂 é́", "x" * 3000 + " " * 50, "▁▁ a", "\t\r\nx", "word " * 5000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, id string, node string, kept string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, "a", "b", "c", "d", "e") for i, t in enumerate(texts)] + [(None, "null id", None, None, None, None, None, None, None, None)], SCHEMA)


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs(spark, ODD), P.path("byte_bpe_50k.json")).collect()}
    assert [got[i] for i in range(len(ODD))] == [len(t.encode(x or "", add_special_tokens=False).ids) for x in ODD]


def test_sentencepiece(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    encoded = sentencepiece_fst.encode(docs(spark, ODD), P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in encoded.collect()}
    for i, x in enumerate(ODD):
        ids = sp.encode(x or "")
        assert got[i].token_ids == ids and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].round_trip == (sp.decode(ids) == (x or ""))
    back = {r.doc_id: r.text for r in sentencepiece_fst.decode(encoded, P.path("piece_bpe_32k.model")).collect()}
    assert back[4] == "a b"


@pytest.mark.parametrize("block_words", [500_000, 20])
def test_decontamination(spark, block_words):
    rng = random.Random(1)
    vocabulary = list("abcdefg")
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (1, 2, 5, 12, 13, 14, 30, 30, 0)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(20)] + [" ".join(["z"] * 40 + items[6][3:20] + ["z"] * 5), "É " + " ".join(items[4]).upper(), None, ""]
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(99, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs(spark, texts), benchmark, block_words=block_words).collect()}
    for i, t in enumerate(texts):
        w, hit, found = words(t.encode() if t else None), set(), set()
        for k, item in enumerate(items):
            item = [x.encode() for x in item]
            m = min(13, len(item))
            for a in range(len(item) - m + 1 if m else 0):
                for b in range(len(w) - m + 1):
                    if w[b : b + m] == item[a : a + m]:
                        hit.update(range(b, b + m))
                        found.add(str(k))
        r = got[i]
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (len(w), len(hit), sorted(found))
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    kept = decontaminate.decontaminate(docs(spark, texts), benchmark)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated}
    assert kept.columns == docs(spark, []).columns


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 100, 1000, 4097):
        f = token_shards.Feistel(n, 7)
        s = f.slots(np.arange(n))
        assert sorted(s.tolist()) == list(range(n))
        assert (f.ordinals(s) == np.arange(n)).all()


def test_token_shards(spark, tmp_path):
    import tiktoken

    encoder = token_shards.Ids(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    manifest = token_shards.write_shards(docs(spark, ODD), P.path("byte_bpe_50k.tiktoken"), str(tmp_path / "s"), seq_len=16, per_shard=64)
    rows = token_shards.read_slots(spark, manifest, rows_at_once=10).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    for i, t in enumerate(ODD):
        ids = [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.seq_no) for x in r.token_ids]
        assert ids == encoder.encoding.encode_ordinary(t or "") + [encoder.end]
    part = token_shards.read_slots(spark, manifest, 70, 75).orderBy("slot").collect()
    assert part == rows[70:75] and tiktoken


def test_shard_ids_of_odd_and_very_long_texts():
    encoder = token_shards.Ids(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    marks = ["a", "Z", " ", "  ", "\n", "\t", "'s", "'ll", "9", "é", "\u3000", "\xa0", "\x1f", "\x85", "漢", "!", " b", " \u0301", "🙂"]
    for some in (marks, [m for m in marks if m[0] != " "] + [" b", " '", " 1"]):
        rng = random.Random(5)
        texts = ["".join(rng.choices(some, k=rng.randrange(14))) for _ in range(5000)]
        got = encoder.encode(pa.array([*texts, None, ""], pa.string()))
        assert [x.tolist() for x in got] == [[*encoder.encoding.encode_ordinary(t), encoder.end] for t in [*texts, "", ""]]
    # runs as short as the library still matches, cut in the same way as those that it doesn't
    long = ["a b" + " " * 3000 + "c d\n" + "\n" * 2000 + "e" + "\t" * 1500, " " * 1200 + "x", "x" + "\n" * 1200]
    expected = [encoder.encoding.encode_ordinary(t) for t in long]

    class Refusing:
        def encode_to_numpy(self, text, **_):
            if len(text) > 1000:
                raise ValueError
            return np.array(plain.encode_ordinary(text), "u4")

    plain, encoder.encoding = encoder.encoding, Refusing()
    assert [encoder.whole(t).tolist() for t in long] == expected
    encoder.encoding = plain
    assert len(encoder.encode(pa.array([" " * 2_000_000 + "a"]))[0]) > 2


def test_zip_and_zip64():
    for zip64 in (False, True):
        out = io.BytesIO()
        warc_zip.write_zip(out, [("a", [b"one", b"two"]), ("b/c", [b""])], zip64)
        assert zipfile.ZipFile(out).read("a") == b"onetwo"
        members = warc_zip.zip_members(out, len(out.getvalue()))
        at, n = members["a"]
        assert out.getvalue()[at : at + n] == b"onetwo" and members["b/c"][1] == 0


def test_warc(spark):
    rows = [(5, "u", "<p>é"), (3, None, "<p>é"), (9, "u\r\n", None), (8, "u", ""), (None, "u", "<p>é"), (5, "u", "<p>é"), (7, "u", "x" * 100_000)]
    got = warc_zip.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[3].record_type == "response" and by[5].refers_to == 3 and by[9].refers_to == 8 and by[None].refers_to == 3
    assert by[7].payload_bytes == 100_000 and by[3].payload_digest == warc_zip.sha1_base32("<p>é".encode())
    assert warc_zip.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, -1])
def test_main_text(spark, broadcast_bytes):
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>n</ul></nav><div class="ad">buy</div><article><h1>A &amp; b </h1><p><b>x\n y<br><p>z<p></p><form>f</form><div id="comments"><p>c</p></div></article><footer>f'
    plain = "<body><div class=top><p>Site name</p></div><div class=text><p>Story {0} is long enough to be the text of page {0}</p><p>more {0}</p></div><div><p>All rights</p></div></body>"
    rows = [(1, "http://a/1", page), (2, None, None), (3, "x", ""), (4, "http://c/", "just text")] + [(10 + i, f"http://b/{i}", plain.format(i)) for i in range(6)]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_bytes).collect()}
    assert got[1] == "A & b\n\nx y\n\nz"
    assert got[2] == got[3] == "" and got[4] == "just text"
    assert got[12] == "Story 2 is long enough to be the text of page 2\n\nmore 2"


def test_main_text_without_regions(spark):
    words_of = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    whole = "<body><div class=top>Site</div><div class=text>Share:<h1>Title {0}</h1><p>{1}</p><p>{1}</p><h2>Part {0}</h2><ul><li>item {0}</ul><table><tr><td>cell {0}</table></div><div>All rights</div></body>"
    copy = "<body><div class=top>Site</div><div class=text><h1>Copied</h1><p>The copied text.</p></div><div>All rights</div></body>"
    rows = [(i, f"http://a/{i}", whole.format(i, words_of(i))) for i in range(6)] + [(10 + i, "http://b/", copy) for i in range(4)]
    # copies are 80 % of the rows, some with other furniture, on a host with different pages
    rows += [(20 + i, "http://c/", copy.replace("<body>", f"<body><nav>{i % 3}</nav>")) for i in range(20)]
    rows += [(50 + i, "http://c/", copy.replace("<body>", "<body><nav>0</nav>").replace("Copied", f"Own {i}").replace("The copied", f"Own words {i}")) for i in range(5)]
    # a list that the template's page lacks, beside the text
    beside = "<body><div class=all><div class=text><p>{0}</p></div>{1}</div></body>"
    rows += [(60 + i, "http://d/", beside.format(words_of(i), f"<ul><li>beside {i}</ul>" if i else "")) for i in range(6)]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == "\n\n".join([f"Title {i}", words_of(i), words_of(i), f"Part {i}", f"item {i}", f"cell {i}"])
        assert got[60 + i] == words_of(i) + (f"\n\nbeside {i}" if i else "")
    assert {got[10 + i] for i in range(4)} == {"Site\n\nCopied\n\nThe copied text.\n\nAll rights"}
    assert {got[20 + i] for i in range(20)} == {"Copied\n\nThe copied text."} and got[52] == "Own 2\n\nOwn words 2 text."


def test_toxicity(spark):
    rng = random.Random(2)
    clean = ["the", "house", "river", "stone", "walks", "green", "table", "morning"]
    texts = [" ".join(rng.choice(clean) for _ in range(30)) + (" blorgish " + rng.choice(["snarfling", "blorgish"]) if i % 3 == 0 else "") + " end." for i in range(150)] + [None, ""]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    assert len(got) == len(texts) + 1
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(150)) and 0 <= got[150].score < 0.5
    model = toxicity.fit(d, labels)
    assert min(model.scores(["a b-l-o-r-g-i-s-h c", "b l o r g i s h", "blorxgish"])) >= 0.5
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score < 0.5 for r in toxicity.toxicity(d, none).collect()} == {True}


def test_language(spark):
    rows = [(i, ("der hund und die katze", "the dog and the cat")[i % 2] + f" {i}", ("de", "en")[i % 2]) for i in range(60)] + [(60, None, "en"), (61, "12 !", "en"), (62, "die katze", None), (None, "the cat", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert all(got[i].lang_pred == ("de", "en")[i % 2] for i in range(60)) and got[62].lang_pred == "de" and got[None].lang_pred == "en"
    assert got[60].lang_pred == got[61].lang_pred == "und"
    assert language_id.identify(df.limit(0)).count() == 0


def test_reject_unknown(spark):
    rows = [(i, ("der hund und die katze", "the dog and the cat")[i % 2] + f" {i}", ("de", "en")[i % 2]) for i in range(60)]
    rows += [(60, "αυτό είναι ένα κείμενο", None), (61, "你好 世界", None), (62, "qzxv wkpj zzqy vvxw", None), (63, None, None), (64, "12 !", None), (65, "die katze", None)]
    kept = language_id.reject_unknown(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(60), 65]


def test_minhash(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(200)] for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for i in range(10):
        near = list(base[i])
        near[50] = "changed"
        texts.append(" ".join(near))
    texts += [texts[3], texts[3].upper(), None, "", "one two", "one, two", "!!"]
    got = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs(spark, texts)).collect()}
    for i in range(30):
        assert got[i].component_id == i and got[i].kept
    for i in range(10):
        assert got[30 + i].component_id == i and not got[30 + i].kept
    assert got[40].component_id == got[41].component_id == 3
    assert got[42].kept and got[43].kept and got[44].kept and got[45].component_id == 44 and got[46].kept and got[None].kept
    kept = minhash_dedup.drop_near_duplicates(docs(spark, texts).union(docs(spark, texts[:1])))
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted([-1, -1, *(i for i in got if i is not None and got[i].kept)])


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 16))
    v[200:] = v[:200] + rng.normal(size=(200, 16)) * 0.03
    v[300:340] = v[0]
    rows = [(i, x.tolist(), i % 3 if i < 200 else (i - 200) % 3) for i, x in enumerate(v)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, v[0].tolist(), None), (404, [1.0, None], 1), (None, v[0].tolist(), 0), (405, [], 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), shard=30, most=60).collect()}
    x = v.astype("f4").astype("f8")
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows[:400]])
    true = (x @ x.T >= 0.98) & (label[:, None] == label)
    found = np.array([got[i].n_links for i in range(400)])
    assert (found <= true.sum(1) - 1).all() and found.sum() >= 0.9 * (true.sum() - 400)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(400, 406)) and got[None].component_id is None


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for u, v in edges if u != v for n in (u, v)}
