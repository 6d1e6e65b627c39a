"""Prefix trie, vector codes, chat formatting and ordered digests against brute force, SQL and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import chat_events, ordered, prefix_trie, queries, vector_codes

CHAT = "conv_id long, turn long, role string, text string, c long, a string, part string, message string, kind string, size string"


def chats(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1, "x", "y", "z", "w", "v") for r in rows], CHAT).repartition(7)


def ordered_turns(rows):
    """Each conversation's (role, text) in order, by plain sorting."""
    found = {}
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        found.setdefault(c, []).append(((turn is not None, turn or 0), tie, role, text))
    return {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in found.items()}


# -- Prefix trie -----------------------------------------------------------------------------------------------------


def trie(rows):
    turns = ordered_turns([r for r in rows if r[0] is not None])
    paths, members, children = {}, {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple(turns.get(donor, [])[:h] + own[h:])
        for d in range(len(paths[c]) + 1):
            members.setdefault(paths[c][:d], []).append(c)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        leaves, saved = below.get(node, (0, 0))
        leaves += node not in children
        saved += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below[node] = leaves, saved
        if node:
            children.setdefault(node[:-1], set()).add(node)
            a, b = below.get(node[:-1], (0, 0))
            below[node[:-1]] = a + leaves, b + saved
    out = set()
    for node, m in members.items():
        ends = sorted(c for c in m if paths[c] == node)
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.add((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children.get(node, ())), *below[node], sha))
    return out


def odd_chats(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 40), None, 10**15]:
        for turn in range(rng.choice([0, 1, 3, 8, 9, 12])):
            rows.append((c, rng.choice([None, turn, turn, turn, rng.randrange(3)]), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "a", "b", "é"])))
    rows += [(77, i, "user", "x") for i in range(300)] + [(78, 5, "user", "y")] * 200  # hot ones, one of equal rows
    return rows + [(79, i, "user", "x") for i in range(299)] + [(79, 1000, "user", "z" * 100_000)]


@pytest.mark.parametrize("piece", [1024, 7])
def test_prefix_trie(spark, piece):
    rows = odd_chats(3)
    found = [tuple(r) for r in prefix_trie.prefix_trie(chats(spark, rows), piece=piece, shard_rows=100).collect()]
    assert set(found) == trie(rows) and len(found) == len(set(found))


def test_prefix_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = [tuple(r) for r in queries.op11_prefix_trie(spark, "/root/testdata/sf0.01").collect()]
    assert set(found) == trie(rows) and len(found) == len(set(found))


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 5000):
        keys = rng.integers(0, 1 << 62, (2, n))
        slots = prefix_trie.SlotTable(*keys)
        assert sorted(slots.slots(*keys).tolist()) == list(range(n))
        assert (slots.slots(*rng.integers(0, 1 << 62, (2, 100))) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.array([1, 1]), np.array([2, 2]))


def test_two_prefixes_of_one_digest_are_noticed():
    rows = {f: np.array([5, 5]) for f in ("a", "b", "pa", "pb", "ta", "tb", "n_bytes", "depth")}
    prefix_trie.Nodes(rows, 8)
    with pytest.raises(ValueError):
        prefix_trie.Nodes(rows | {"pb": np.array([5, 6])}, 8)


def test_accumulate_in_depth_order():
    rng = random.Random(2)
    parents = np.array([-1] + [rng.randrange(i) for i in range(1, 300)])
    depths = np.zeros(300, "i8")
    for i in range(1, 300):
        depths[i] = depths[parents[i]] + 1
    values = np.arange(300)
    expected = values.copy()
    for i in range(299, 0, -1):
        expected[parents[i]] += expected[i]
    prefix_trie.accumulate(np.add, values, parents, depths)
    assert (values == expected).all()


# -- Vector codes ----------------------------------------------------------------------------------------------------


def codes(rows):
    """Four rounds of full searches over (vec_id, vector, label)."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, np.floor(np.array(r[1]) * 1024).tolist()))
    x = np.floor(np.array([r[1] for r in rows], "f8") * 1024).astype("i8").reshape(len(rows), 4, -1)
    books = [x[:256, p].copy() for p in range(4)]

    def nearest(p):
        d = ((x[:, p, None] - books[p][None]) ** 2).sum(axis=2)
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(4):
        for p in range(4):
            code = nearest(p)[0]
            for i in np.unique(code):
                books[p][i] = x[code == i, p].sum(axis=0) // (code == i).sum()
    found = [nearest(p) for p in range(4)]
    error, of_label = sum(f[1] for f in found).tolist(), {}
    for r, e in zip(rows, error):
        of_label[r[2]] = of_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{f[0][i]:02x}" for f in found), e, of_label[r[2]], sha) for i, (r, e) in enumerate(zip(rows, error)))


def test_vector_codes(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(z) for z in rng.integers(-3, 3, 8) / 512], int(rng.integers(3))) for i in range(1500)]  # few values, so many ties
    rows += [(5000 + i, [0.0] * 8, None) for i in range(300)] + [(None, [1.0] * 8, None), (3, [2.0] * 8, 2), (3, [2.0] * 8, 2)]
    dropped = [(7, [float("nan")] * 8, 1), (8, None, 1), (9, [None] * 8, 2), (10, [float("-inf")] + [0.0] * 7, 2), (11, [1.0] * 4, 1), (12, [], 1)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows + dropped], "vec_id long, embedding array<float>, label int, v string, code string").repartition(5)
    found = sorted((str(r[0]), *r[1:5]) for r in vector_codes.vector_codes(df).collect())
    assert found == codes(rows)


def test_vector_codes_of_few_rows(spark):
    df = spark.createDataFrame([(1, [0.5] * 6, "x"), (2, [-0.5] * 6, None)], "vec_id long, embedding array<double>, label string")
    found = sorted(vector_codes.vector_codes(df).collect())
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in found] == [(1, "00000000", 0, 0), (2, "01010101", 0, 0)]
    assert vector_codes.vector_codes(df.limit(0)).collect() == []
    with pytest.raises(Exception):  # noqa: B017
        vector_codes.vector_codes(df.select("vec_id", F.array(F.lit(1e30), F.lit(-1e30)).alias("embedding"), "label")).collect()


def test_balls_equal_full_searches():
    rng = np.random.default_rng(5)
    x = rng.integers(-400, 400, (5000, 16)) + 300 * rng.integers(0, 6, (5000, 1))
    before = x[:256].copy()
    code, error = vector_codes.nearest(x, before)
    now, farthest = before.copy(), np.zeros(256, "i8")
    np.maximum.at(farthest, code, error)
    for i in np.unique(code):
        now[i] = x[code == i].sum(axis=0) // (code == i).sum()
    balls = vector_codes.Balls(now, vector_codes._radii(before, now, farthest))
    got = balls.moved(x, code)
    want = vector_codes.nearest(x, now)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert got[2] < 256 * len(x)  # fewer distances than a full search


def test_vector_codes_query(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((str(r[0]), *r[1:]) for r in queries.op12_vector_codes(spark, path).collect()) == codes(rows)


# -- Chats -----------------------------------------------------------------------------------------------------------


def test_chat_formatting(spark):
    rng, r = random.Random(4), chat_events.Renderer()
    bits = [*r.template.controls(), "\\", "[", "]", " ", "a", "\n", "é🙂", "INST]"]
    rows = []
    for c in [*range(40), None]:
        for turn in range(rng.choice([0, 1, 3, 8, 100])):
            text = rng.choice([None, "", "a", "".join(rng.choices(bits, k=9)), "é" * 3000])
            rows.append((c, rng.choice([None, turn, turn, turn, rng.randrange(3)]), rng.choice([None, "user", "assistant", "system", "tool"]), text))
    rows += [(99, 1, "assistant", "x")] * 300 + [(98, 1, "assistant", "y" * 300_000)]
    expected = []
    for c, turns in ordered_turns(rows).items():
        loss = "".join(t for role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for role, t in turns)
        expected.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(r.turn(*t)[0]) for t in turns)))
    for k in (256, 3):
        found = [tuple(x) for x in chat_events.format_chats(chat_events.event_log(chats(spark, rows)), piece_turns=k).collect()]
        assert sorted(found, key=str) == sorted(expected, key=str)
    assert chat_events.format_chats(chat_events.event_log(chats(spark, rows).limit(0))).collect() == []


def test_templates_are_reversible():
    r, rng = chat_events.Renderer(), random.Random(1)
    controls = r.template.controls()
    bits = [*controls, "\\", "[", "]", "<", "/", " ", "a", "\n", "INST]", "s>"]
    for _ in range(5000):
        turns = [(rng.choice(["user", "assistant", "system", "", "".join(rng.choices(bits, k=3))]), "".join(rng.choices(bits, k=rng.randrange(8)))) for _ in range(3)]
        assert list(r.turns("".join(r.turn(*t)[0] for t in turns))) == turns
        assert not any(c in r.escape(t[1]) for t in turns for c in controls)


def test_events_fold(spark):
    log = [
        (1, 0, "m", 0, "open", "user", "he", None, None), (1, 0, "m", 1, "delta", None, "llo", None, None), (1, 0, "m", 1, "delta", None, "llo", None, None),
        (1, 1, "n", 0, "open", "assistant", None, None, None), (1, 1, "n", 1, "delta", None, "bad", None, None), (1, 1, "n", 2, "regenerate", None, None, None, None), (1, 1, "n", 3, "delta", None, "good day", None, None), (1, 1, "n", 4, "edit", None, "morning", 5, 3),
        (1, 2, "o", 0, "open", "user", "gone", None, None), (1, 2, "o", 1, "delete", None, None, None, None),
        (1, 3, "p", 5, "delta", None, "unopened", None, None), (1, 3, "p", 6, "edit", None, "new", None, None), (1, 3, "p", None, "delta", None, "no seq", None, None), (1, 3, "p", 7, "else", None, "?", None, None),
    ]
    rows = chat_events.render(spark.createDataFrame(log, chat_events.LOG)).collect()
    assert [list(chat_events.Renderer().turns(r.formatted)) for r in rows] == [[("user", "hello"), ("assistant", "good morning"), ("", "new")]]
    assert [rows[0].formatted[a:b] for a, b in zip(rows[0].starts, rows[0].ends)] == ["good morning"]


# -- Ordered digests -------------------------------------------------------------------------------------------------


def test_ordered_digests_of_hot_keys(spark):
    rows = [(1, i, f"{i}") for i in range(2000)] + [(k, 0, "z") for k in range(2, 300)]
    df = spark.createDataFrame(rows, "k long, i long, d string").repartition(5)
    found = {r.k: r.d for r in ordered.ordered_digests(df, ["k"], ["i"], ["d"], b",", inline=200).collect()}
    z = hashlib.sha256(b"z").hexdigest()
    assert found == {k: z for k in range(2, 300)} | {1: hashlib.sha256(",".join(map(str, range(2000))).encode()).hexdigest()}
