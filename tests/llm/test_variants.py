"""Spelling variants against brute force: all words of a table, and crowded vocabularies
over many tasks."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import __spark_entry__ as E
from captionflow.llm import variants

from .brute import LOWER
from .helpers import AWKWARD, awkward, empty


def counted(docs, damage=31):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return n


def one_edit(a, b):
    """By comparing from both ends."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    i = 0
    while i < len(short) and short[i] == long[i]:
        i += 1
    return short[i:] == long[i + 1:] if len(a) != len(b) else short[i + 1:] == long[i + 1:]


def brute(n, ratio=10):
    words = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    # candidates share a half or its neighbourhood of lengths; all of them are compared
    by_deletion = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_deletion[w[:i] + w[i + 1:]].add(w)
        by_deletion[w].add(w)
    near = defaultdict(set)
    for group in by_deletion.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w, k in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * k else None
    out = {}
    for w, k in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, k, len(near[w]), words[form[w]] if form[w] else None)
    return out


def rows(df):
    got = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}
    assert len(out) == len(got)
    return out


def test_query(spark, sf_small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    want = brute(counted(docs))
    got = rows(E.queries()["op11_spelling_variants"](spark, sf_small))
    assert got == want and sum(v[0] is not None for v in want.values()) > 5


def test_crowded_vocabulary_over_many_tasks(spark):
    """Few letters and repeated ones: most words have neighbours, also over task ends."""
    rng = random.Random(5)
    docs = []
    for d in range(60):
        pool = ["".join(rng.choice("abÉ") for _ in range(rng.choice((7, 8, 9)))) for _ in range(40)]
        docs.append((d, " ".join(w for w in pool for _ in range(rng.choice((2, 3, 30, 400))))))
    want = brute(counted(docs))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = rows(variants.variant_forms(spark.createDataFrame(docs, "doc_id long, text string")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want
    assert max(v[3] for v in want.values()) > 10 and any(v[0] and v[1] != v[0] for v in want.values())


def test_awkward(spark):
    long = "x" * 9_000
    docs = [*AWKWARD, (20, f"{long} {long}"), (21, f"{long}x {long}x x{long}y"), (21, f"{long}x"), (None, f"x{long}y aaaaaaa aaaaaaa"),
            (22, "aaaaaaa aaaaaaaa aaaaaaaa aaaaaab " * 30), (23, "ÀÀÀÀÀÀÀ ààààààà × ÷÷÷÷÷÷÷ " * 3)]
    got = rows(variants.variant_forms(awkward(spark, docs)))
    assert got == brute(counted(docs))
    assert rows(variants.variant_forms(awkward(spark, docs), damage=None)) == brute(counted(docs, None))
    assert rows(variants.variant_forms(empty(spark))) == {}


def test_pairs_of_a_word():
    """Every cut and every skipped position, kinds by the last of equal letters."""
    whole = np.arange(8, dtype=np.int64)
    p, s, kind = variants.word_pairs("abbcddd", whole, 100 + whole)
    skip = [(i, 100 + 6 - i) for i in range(7)]
    cut = [(i, 100 + 7 - i) for i in range(8)]
    assert list(zip(p.tolist(), s.tolist())) == skip + cut
    assert [k == variants.INSERTED for k in kind[:7]] == [True, False, True, True, False, False, True]
    assert (kind[7:] == variants.CUT).all()
    p, s, kind = variants.word_pairs("abbcddd", whole[:4], 100 + whole[:4])
    assert list(zip(p.tolist(), s.tolist())) == [(3, 103)]  # one position is shared on both sides, no cut is


def test_common_prefix():
    rng = random.Random(7)
    for _ in range(300):
        n, k = rng.choice(((5, 5), (300, 280), (1000, 64))), rng.choice("ab")
        a, b = ("".join(rng.choice("ab") for _ in range(x)) for x in n)
        cut = rng.randrange(min(n))
        b = a[:cut] + b[cut:]
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert variants.common_prefix(a, b) == want, k
