"""Column helpers of the operators that use built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression class without its brackets.
SPACE = r"\x20\x09-\x0D"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for the row. (An expression that
    a lambda refers to would otherwise be computed for every element.)"""
    return F.transform(F.array(value), body)[0]


def non_empty(words: Column) -> Column:
    return F.array_remove(words, "")


def running(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array the fold of all elements up to it. An array that
    grows by an element is copied, so the array is folded in blocks of its square root:
    n elements take n times the root of n short copies."""
    def scan(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def of_blocks(blocks: Column) -> Column:
        before = scan(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: step(acc, x))), zero)
        return F.flatten(F.zip_with(blocks, F.slice(before, 1, F.size(blocks)),
                                    lambda b, z: F.slice(scan(b, z), 2, F.size(b))))

    def of(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return let(F.transform(F.sequence(F.lit(1), F.size(v), width), lambda i: F.slice(v, i, width)), of_blocks)
    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.slice(F.array(zero), 1, 0)))


def found(text: Column, pattern: str) -> Column:
    """Array of (start, hit): the matches of a pattern, leftmost and not overlapping,
    with the code points before each. The stretches between matches give the starts."""
    def walk(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        ends = running(F.zip_with(gaps, hits, lambda gap, hit: F.length(gap) + F.length(hit)), F.lit(0), lambda a, x: a + x)
        return F.zip_with(ends, hits, lambda end, hit: F.struct((end - F.length(hit)).alias("start"), hit.alias("hit")))
    none = F.array().cast("array<struct<start:int,hit:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda hits: F.when(F.size(hits) > 0, walk(hits)).otherwise(none))


#: Code points of a block of :func:`text_blocks`, and blocks of a stretch.
BLOCK, STRETCH = 1024, 256


def text_blocks(text: Column) -> Column:
    """A text in blocks of ``BLOCK`` code points. Finding a code point takes time in
    proportion to those before it, so long texts are cut into stretches first."""
    def cut(c: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(size)),
                           lambda i: F.substring(c, i + 1, F.lit(size)))
    return F.flatten(F.transform(cut(text, BLOCK * STRETCH), lambda s: cut(s, BLOCK)))


def piece(blocks: Column, start: Column, size: Column) -> Column:
    """At most ``BLOCK`` code points of a text in blocks, from the code point ``start``
    (from 0) on; cut at the text's end."""
    nth = F.floor(start / BLOCK).cast("int")
    two = F.concat(F.coalesce(F.get(blocks, nth), F.lit("")), F.coalesce(F.get(blocks, nth + 1), F.lit("")))
    return F.substring(two, start - nth * BLOCK + 1, size)


def span_text(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of structs (start, kind, end), kind an index, comma-joined."""
    name = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")
