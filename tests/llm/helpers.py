"""Tables with awkward rows, for every operator."""

import random

AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a b"), (6, "a b c"), (6, "a b c"), (None, "a b c"), (None, None),
    (7, "A B\tC"), (8, "éè 你好 \U0001f600 K ſ İ"), (9, "x" * 20_000), (10, "w " * 60_000),
    (11, "1 2 3 4 " * 5_000), (12, "a.b.c.d@" * 3_000), (13, "%41%42 \\u0041 " * 50), (14, "\x00\x01 \x0b\x0c\r\n"),
    (15, "9" * 40_000), (16, "+" * 5_000 + "1" * 5_000), (17, "the the the " * 30), (18, "\n" * 500 + "same line\nsame line\n"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid int, fp string, host string, spans string, score string"


def awkward(spark, rows=AWKWARD):
    """A table with nulls, repeats, long texts and columns whose names may clash."""
    return spark.createDataFrame([(d, t, None if (d or 0) % 3 == 0 else "en", None, None if t is None else len(t), 1, "fp",
                                   "host", "spans", "score") for d, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(rng: random.Random, n: int, size: int = 400) -> str:
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))
