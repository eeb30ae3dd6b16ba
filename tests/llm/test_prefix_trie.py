"""The conversation prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

import __spark_entry__ as E
from captionflow.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, name string, nth string"


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, key, role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + own[h:]
    return turns, out


def brute(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        totals[p] = (sum(totals[x][0] for x in children[p]) or 1, saved + sum(totals[x][1] for x in children[p]))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *totals[p],
                   hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(p)).encode()).hexdigest())
                  for p, m in members.items())


def rows(df):
    return sorted((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"],
                   r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "name", "nth") for r in data], SCHEMA)


def test_query(spark, sf_small):
    data = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    want = brute(rebuilt(data)[1])
    assert rows(E.queries()["op12_prefix_trie"](spark, sf_small)) == want and len(want) > 40


@pytest.mark.parametrize("seed", [1, 2])
def test_random_tries(spark, seed):
    """Few symbols, so that paths branch at every depth; one long conversation and a
    third of copies; ids of more than one family."""
    rng = random.Random(seed)
    data, stem = [], [(rng.choice("ab"), rng.choice("xyz")) for _ in range(40)]
    for c in [*range(0, 30), *range(195, 215), 1000, -3]:
        kind = rng.random()
        n = rng.randrange(1, 12)
        own = stem[:n] if kind < 0.4 else [(rng.choice("ab"), rng.choice(("", "x", "yé"))) for _ in range(n)]
        own = stem[:37] if c in (7, 8, 9) else stem[:36] + [("a", "end")] if c == 10 else own
        data += [(c, t, *x) for t, x in enumerate(own)]
    rng.shuffle(data)
    plain, heads = rebuilt(data)
    assert rows(prefix_trie.conversation_trie(frame(spark, data))) == brute(plain)
    assert rows(prefix_trie.conversation_trie(frame(spark, data), shared_heads=True)) == brute(heads)


def test_awkward(spark):
    data = [(1, None, None, None), (1, None, "", ""), (1, 5, "user", "é" * 5_000), (2, 1, None, "a"), (2, 1, "", "a"),
            (2, 1, "x", "a"), (None, 1, "user", "nobody"), (3, 0, "us", "er"), (4, 0, "use", "r"), (5, 0, "us", "er"),
            (100, 0, "system", "s"), (101, 0, "q", "r"), (199, 9, "q", "r"), (1 << 40, 0, "q", "r")]
    plain, heads = rebuilt(data)
    assert rows(prefix_trie.conversation_trie(frame(spark, data))) == brute(plain)
    got = rows(prefix_trie.conversation_trie(frame(spark, data), shared_heads=True))
    assert got == brute(heads)
    for shared in (False, True):
        assert rows(prefix_trie.conversation_trie(frame(spark, []), shared_heads=shared)) == []


def test_many_ends_of_one_node(spark, monkeypatch):
    """The ids of a node are hashed in order over chunks and tasks."""
    ends = spark.range(0, 40_000, numPartitions=7).selectExpr(
        "cast(if(id % 3 = 0, 1, 2) as long) as depth", "cast(if(id % 3 = 0, 'hot', string(id)) as binary) as name",
        "id * 7 as conv_id")
    got = {(r["depth"], bytes(r["name"])): r["ends_sha256"] for r in prefix_trie.ends_digests(ends).collect()}
    assert got[(1, b"hot")] == hashlib.sha256(",".join(str(7 * i) for i in range(0, 40_000, 3)).encode()).hexdigest()
    assert len(got) == 1 + 40_000 - len(range(0, 40_000, 3)) and got[(2, b"1")] == hashlib.sha256(b"7").hexdigest()
