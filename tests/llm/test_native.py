"""Column helpers of the native operators, and personal data in texts with many hits."""

import itertools
import random
import re
import time

from pyspark.sql import functions as F

from captionflow.llm import native, pii

from . import brute


def test_running(spark):
    rng = random.Random(1)
    arrays = [[rng.randrange(-5, 9) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 15, 16, 17, 100, 1000)]
    df = spark.createDataFrame([(a,) for a in arrays], "v array<int>")
    got = df.select("v", native.running(F.col("v"), F.lit(0), lambda a, x: a + x).alias("sum"),
                    native.running(F.col("v"), F.lit(-9), lambda a, x: F.greatest(a, x)).alias("max")).collect()
    for r in got:
        assert r["sum"] == list(itertools.accumulate(r["v"])) and r["max"] == list(itertools.accumulate(r["v"], max))


def test_found_and_pieces(spark):
    rng = random.Random(2)
    texts = ["", "abc", "é" * 3000 + "12" + "好" * 1023 + "3", "".join(rng.choice("a1é😀 ") for _ in range(5000))]
    size = native.BLOCK * native.STRETCH
    texts.append("x" * (size - 1) + "77" + "y" * 10 + "5")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", native.found(F.col("t"), "[0-9]+").alias("f"), native.text_blocks(F.col("t")).alias("b")) \
        .withColumn("p", F.transform("f", lambda x: native.piece(F.col("b"), x["start"], F.lit(5)))).collect()
    for r in got:
        want = [(m.start(), m[0]) for m in re.finditer("[0-9]+", r["t"])]
        assert [tuple(x) for x in r["f"]] == want
        assert "".join(r["b"]) == r["t"] and all(len(b) == native.BLOCK for b in r["b"][:-1])
        assert r["p"] == [r["t"][a:a + 5] for a, _ in want]


def test_spans_that_meet(spark):
    """Overlaps of two lists of spans, told by order, against all pairs."""
    rng = random.Random(3)

    def spans(n, length):
        out, at = [], 0
        for _ in range(n):
            at += rng.choice((0, 1, 2, 9))
            end = at + rng.randrange(1, length)
            out.append((at, 0, end, "h"))
            at = end
        return out
    rows = [(spans(n, a), spans(m, b)) for n, m in ((0, 0), (0, 3), (4, 0), (1, 1), (5, 40), (60, 50), (300, 10))
            for a, b in ((3, 3), (2, 30), (40, 4))]
    kind = "array<struct<start:int,kind:int,end:int,hit:string>>"
    got = spark.createDataFrame(rows, f"s {kind}, l {kind}").select("s", "l", pii._met(F.col("s"), F.col("l")).alias("m")).collect()
    for r in got:
        for own, other, strict in ((r["s"], r["l"], True), (r["l"], r["s"], False)):
            want = [(x["start"], x["end"], any(x["start"] < y["end"] and y["start"] < x["end"] for y in other)) for x in own]
            assert [(x["start"], x["end"], x["met"]) for x in r["m"] if x["strict"] == strict] == want


def test_many_hits_in_one_text(spark):
    """Right, and in time that grows about as the hits do."""
    def text(n):
        rng = random.Random(n)
        forms = [lambda: f"mail a{rng.random()}@b.example.com", lambda: f"ip 10.{rng.randrange(300)}.3.4.5",
                 lambda: "card 4111 1111 1111 1111", lambda: f"tel +49 170 {rng.randrange(10**7)}", lambda: "joe [at] x dot org",
                 lambda: "4111-1111--1111 1111-1111-1111", lambda: "filler é words", lambda: "555-123-4567"]
        return " ".join(rng.choice(forms)() for _ in range(n))
    took = {}
    for n in (500, 3_000, 30_000):
        t = text(n)
        began = time.time()
        r = pii.scan_documents(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
        took[n] = time.time() - began
        spans = brute.pii_base(t)
        assert r["base_spans"] == ",".join(f"{k}:{a}:{z}" for a, k, z in sorted(spans, key=lambda s: (s[0], pii.KINDS.index(s[1]))))
        assert len(spans) > n / 4 and len(r["spans"]) > len(r["base_spans"])
    assert took[30_000] < 60, took  # the square of the hits would be minutes
