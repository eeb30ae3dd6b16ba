"""Benchmark decontamination by template windows.

Texts become templates: words are folded, numbers, names and units become typed
placeholders. Windows of ``WINDOW`` template words of every benchmark item are
hashed; windows of every document are looked up among them. A run of number parts
('1,200') or of names ('Mary Ann') is one placeholder. Hits in the order of the item are
chained over alignments that differ by a few words, so an inserted word loses only the
windows that hold it. A hit must also be consistent in its slots: along its alignments,
equal slot values of the item meet equal values in the document and different ones meet
different ones.
So a question with new numbers or names is caught, and a chance meeting of
placeholders is not. Windows of hardly anything but placeholders are hashed with their
literal values, so that every item can be found. All this is done twice: with names and
runs as placeholders, and with every word folded and only numbers and units typed, so
that letter case and punctuation hide no copy.

The benchmark is read in blocks of ``BLOCK_ROWS`` items; a block's windows are the
broadcast side of the hash join (their size is bounded by the block and checked), and
every document is looked up against each block. Only one block at a time is in the
executors' memory: of several, each is a job of its own, which writes its hits and
then frees the block. No document is shuffled.
"""

from __future__ import annotations

import bisect
import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import texthash
from .common import bound_batches, drop_stage, free_name, stage, text_or_empty

#: Template words in a window; an item of fewer words is one window.
WINDOW = 8
#: A window of fewer words that are no placeholders is looked up by its literal words.
MIN_PLAIN = 4
#: Share of an item's windows that a chain of alignments must hit.
COVERAGE = 0.5
#: Words that two neighbouring alignments of a chain may differ by.
DRIFT = 8
#: A run of so many literal words of an item is a hit at any coverage.
VERBATIM = 32
#: Benchmark items in one block, and words in one block at most.
BLOCK_ROWS = 20_000
BLOCK_WORDS = 2_000_000
U64 = np.uint64

# Unit words that follow a number.
UNITS = ("cm mm km m kg g mg lb oz l ml mi ft in s sec second seconds min minute minutes h hour hours day days week "
         "weeks month months year years meter meters metre metres mile miles inch inches foot feet gram grams "
         "kilogram kilograms liter liters litre litres percent dollar dollars euro euros cent cents").split()
_NUM, _NAME, _UNIT = U64(1), U64(2), U64(3)
_UNIT_HASHES = np.sort(np.concatenate([texthash.words(np.frombuffer(u.encode(), np.uint8), texthash.ALNUM)[0] for u in UNITS]))
_LITERAL = 1 << 20  # salt of windows of literal words
_FOLDED = 1 << 21   # salt of windows of the folded view
_DIGIT, _STOP, _POINT = (np.isin(np.arange(256), [ord(c) for c in chars]) for chars in ("0123456789", ".!?:;\n\r\"|", ",."))


def _sums(mark: np.ndarray) -> np.ndarray:
    """How many bytes before each place are marked."""
    out = np.zeros(len(mark) + 1, np.int32 if len(mark) < 1 << 31 else np.int64)
    np.cumsum(mark, out=out[1:])
    return out


def _merged(code: np.ndarray, h: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with each one marked in ``joined`` made one with the word before it."""
    first = np.flatnonzero(~joined)
    size = np.diff(np.concatenate((first, [len(h)])))
    value = h[first]
    more = np.flatnonzero(size > 1)
    for k in range(1, int(size.max())):
        more = more[size[more] > k]
        with np.errstate(over="ignore"):
            value[more] = texthash.mix(value[more] * U64(31) + h[first[more] + k])
    code = code[first]
    return np.where(code > _UNIT, value, code), value


@functools.cache
def _cases() -> np.ndarray:
    """By code point: 1 a capital, 2 a small letter, 0 other (as are all beyond the table)."""
    return np.array([1 if c.isupper() or c.istitle() else 2 if c.islower() else 0 for c in map(chr, range(0x20000))], np.int8)


def _case(data: np.ndarray) -> np.ndarray:
    """By byte: 1 where a capital starts, 2 where a small letter starts, 0 elsewhere."""
    out = np.zeros(len(data), np.int8)
    out[(data >= 0x41) & (data < 0x5B)] = 1
    out[(data >= 0x61) & (data < 0x7B)] = 2
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        rest = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
        b = data[lead].astype(np.int64)
        two, three = (b & 0x1F) << 6 | rest[0], (b & 0x0F) << 12 | rest[0] << 6 | rest[1]
        four = (b & 0x07) << 18 | rest[0] << 12 | rest[1] << 6 | rest[2]
        out[lead] = _cases()[np.minimum(np.where(b < 0xE0, two, np.where(b < 0xF0, three, four)), 0x1FFFF)]
    return out


def _folded(data: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``h`` with the hashes of words in folded letters of every script."""
    if not len(data) or data.max() < 0x80:
        return h
    text = data.tobytes().decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")
    folded = texthash.words(np.frombuffer(text, np.uint8), texthash.ALNUM)[0]
    return folded if len(folded) == len(h) else h


def template(data: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(template code, folded word hash) of each word of a text, in two views. In both a
    word of digits is a number; one that follows a number and is listed is a unit. In the
    first, one with a capital and small letters that does not start a sentence is a name,
    and numbers with a point or comma between them are one word, and so are names with a
    space between them."""
    h, start, end = texthash.words(data, texthash.ALNUM)
    if not len(h):
        return (h, h), (h, h)
    h = _folded(data, h)
    case = _case(data)
    stops = _sums(_STOP[data])
    number = _DIGIT[data[start]]
    if number.any():
        digits = _sums(_DIGIT[data])
        number = digits[end] - digits[start] == end - start
    after_number = np.concatenate(([False], number[:-1]))
    spot = np.minimum(np.searchsorted(_UNIT_HASHES, h), len(_UNIT_HASHES) - 1)
    unit = after_number & (_UNIT_HASHES[spot] == h)
    inside = np.concatenate(([False], stops[start[1:]] == stops[end[:-1]]))
    near = start[1:] == end[:-1] + 1
    dot = np.concatenate(([False], near & _POINT[data[end[:-1]]]))
    space = np.concatenate(([False], near & (data[end[:-1]] == 0x20)))
    plain = h.copy()
    plain[unit] = _UNIT
    plain[number] = _NUM
    name = (case[start] == 1) & inside & (plain > _UNIT)
    if name.any():
        small = _sums(case == 2)
        name &= small[end] > small[start]
    if not name.any() and not number.any():
        return (plain, h), (plain, h)
    code = plain.copy()
    code[name] = _NAME
    joined = (dot & (code == _NUM) | space & (code == _NAME)) & np.concatenate(([False], code[1:] == code[:-1]))
    return _merged(code, h, joined) if joined.any() else (code, h), (plain, h)


_FACTORS = texthash.mix(np.arange(1, 1 + (1 << 10), dtype=U64)) | U64(1)


def _grams(codes: np.ndarray, n: int, salt: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of each run of ``n`` codes, or of those that start at ``at``: a sum of the
    codes, mixed with their place's factor."""
    size = len(codes) - n + 1
    with np.errstate(over="ignore"):
        h = np.full(size if at is None else len(at), salt, U64)
        for k in range(n):
            h += (codes[k:size + k] if at is None else codes[at + k]) * _FACTORS[k]
    return texthash.mix(h)


def window_hashes(code: np.ndarray, h: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether it is of the template) of every window of ``n`` words: of template
    codes, or of literal words where too few words are plain."""
    if not n or len(code) < n:
        return np.zeros(0, U64), np.zeros(0, bool)
    plain = _sums(code > _UNIT)
    typed = plain[n:] - plain[:-n] >= min(MIN_PLAIN, n)
    out = _grams(code, n, salt + n)
    if not typed.all():
        rest = np.flatnonzero(~typed)
        out[rest] = _grams(h, n, salt + _LITERAL + n, rest)
    return out, typed


@dataclass
class Block:
    """Windows of a block of benchmark items, sorted by hash. An item counts twice, as
    number 2 i in the view with names and 2 i + 1 in the folded one."""
    hashes: np.ndarray
    item: np.ndarray       # number of the item
    place: np.ndarray      # first word of the window
    typed: np.ndarray      # whether the window is of the template
    windows: np.ndarray    # by item: its number of windows
    templates: np.ndarray  # by item: its number of windows of the template
    words: list            # by item: (template codes, word hashes)
    ids: list              # by two items: their item_id
    sizes: tuple           # by view: window lengths that occur
    seen: np.ndarray       # bitmap over the low bits of the hashes
    window: int

    @classmethod
    def of(cls, items: list[tuple[object, bytes]], window: int) -> Block:
        words = [view for _, t in items for view in template(np.frombuffer(t, np.uint8))]
        parts = [window_hashes(c, v, min(window, len(c)), _FOLDED * (i % 2)) for i, (c, v) in enumerate(words)]
        count = np.array([len(h) for h, _ in parts], np.int64)
        h = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U64)
        typed = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, bool)
        place = np.concatenate([np.arange(n) for n in count]).astype(np.int32) if parts else np.zeros(0, np.int32)
        item = np.repeat(np.arange(len(words), dtype=np.int32), count)
        order = np.lexsort((place, item, h))
        bits = max(16, math.ceil(math.log2(max(1, len(h)))) + 4)
        seen = np.zeros(1 << bits, bool)
        seen[(h & U64((1 << bits) - 1)).astype(np.int64)] = True
        return cls(h[order], item[order], place[order], typed[order], count, np.bincount(item[typed], minlength=len(words)),
                   words, [i for i, _ in items],
                   tuple(tuple(sorted({min(window, len(c)) for c, _ in words[k::2] if len(c)})) for k in (0, 1)), seen, window)

    def hits(self, code: np.ndarray, words: np.ndarray, view: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into the sorted windows, word of the document) of every hit."""
        index, at = [], []
        for n in self.sizes[view]:
            if len(code) < n:
                continue
            h, _ = window_hashes(code, words, n, _FOLDED * view)
            maybe = np.flatnonzero(self.seen[(h & U64(len(self.seen) - 1)).astype(np.int64)])
            low = np.searchsorted(self.hashes, h[maybe], "left")
            many = np.searchsorted(self.hashes, h[maybe], "right") - low
            index.append(np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum()))
            at.append(np.repeat(maybe, many))
        if not index:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(index), np.concatenate(at)

    def consistent(self, item: int, places: np.ndarray, at: np.ndarray, h: np.ndarray) -> bool:
        """Whether the slots under the windows at ``places``, which the document has at
        ``at``, map one to one."""
        item_code, item_h = self.words[item]
        k = np.arange(min(self.window, len(item_code)))[None, :]
        there, here = (places[:, None] + k).ravel(), (at[:, None] + k).ravel()
        slots = item_code[there] <= _UNIT
        if not slots.any():
            return True
        there, here = there[slots], here[slots]
        pairs = np.unique(np.stack([item_code[there], item_h[there], h[here]]), axis=1)
        return pairs.shape[1] == np.unique(pairs[:2], axis=1).shape[1] == np.unique(pairs[[0, 2]], axis=1).shape[1]

    def chain(self, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Indices of the longest chain of one item's hits: places and words of the
        document grow, and neighbours' alignments differ by at most ``DRIFT``."""
        order = np.lexsort((at, place))
        ways: dict[int, list] = {}      # by shift: (places, lengths, hits) of the chains that end there
        before = {}
        end, most = -1, 0
        for hit in order.tolist():
            p, s = int(place[hit]), int(at[hit] - place[hit])
            size, last = 1, -1
            for t in range(s - DRIFT, s + DRIFT + 1):
                way = ways.get(t)
                if way is None:
                    continue
                k = bisect.bisect_left(way[0], min(p, p + s - t)) - 1
                # of equals the one of the same alignment
                if k >= 0 and (way[1][k] + 1 > size or way[1][k] + 1 == size and t == s):
                    size, last = way[1][k] + 1, way[2][k]
            way = ways.setdefault(s, ([], [], []))
            way[0].append(p)
            way[1].append(size)
            way[2].append(hit)
            before[hit] = last
            if size > most:
                end, most = hit, size
        out = []
        while end >= 0:
            out.append(end)
            end = before[end]
        return np.array(out[::-1], np.int64)

    def verbatim(self, item: int, shift: int, places: np.ndarray, h: np.ndarray) -> bool:
        """Whether the windows at ``places`` hold ``VERBATIM`` literal words in a run."""
        own, n = self.words[item][1], min(self.window, len(self.words[item][1]))
        if len(places) + n - 1 < VERBATIM:
            return False
        words = np.unique(places[:, None] + np.arange(n)[None, :])
        same = np.zeros(len(own), np.int8)
        same[words] = own[words] == h[words + shift]
        step = np.diff(np.concatenate(([0], same, [0])))
        return bool(max(np.flatnonzero(step < 0) - np.flatnonzero(step > 0), default=0) >= VERBATIM)

    def share(self, item: int, typed: np.ndarray) -> float:
        """Share of an item's windows that are hit (``typed``: of each, whether it is of
        the template); of those of the template alone, if that is more, as literal ones
        do not survive new values."""
        part = typed.sum() / self.templates[item] if self.templates[item] else 0.0
        return float(max(len(typed) / self.windows[item], part))

    def matches(self, data: np.ndarray, coverage: float) -> list[tuple[object, float]]:
        """(item_id, share of its windows) of the items that a text contains."""
        best: dict[int, float] = {}
        for view, (code, h) in enumerate(template(data)):
            for i, share in self.view_matches(code, h, view, coverage).items():
                best[i // 2] = max(share, best.get(i // 2, 0.0))
        return [(self.ids[i], best[i]) for i in sorted(best)]

    def view_matches(self, code: np.ndarray, h: np.ndarray, view: int, coverage: float) -> dict[int, float]:
        """Number and share of the items that a text's words contain in one view."""
        index, at = self.hits(code, h, view)
        if not len(index):
            return {}
        item, place, typed = self.item[index], self.place[index], self.typed[index]
        order = np.lexsort((place, at - place, item))
        item, at, place, typed = item[order], at[order], place[order], typed[order]
        shift = at - place
        cut = np.flatnonzero((np.diff(item) != 0) | (np.diff(shift) != 0)) + 1
        best: dict[int, float] = {}
        for lo, hi in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(item)]))):
            i = int(item[lo])
            share = self.share(i, typed[lo:hi])
            if share > best.get(i, 0) and (share >= coverage or self.verbatim(i, int(shift[lo]), place[lo:hi], h)) \
                    and self.consistent(i, place[lo:hi], at[lo:hi], h):
                best[i] = share
        cut = np.flatnonzero(np.diff(item)) + 1
        for lo, hi in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(item)]))):
            i = int(item[lo])
            if shift[lo] == shift[hi - 1]:
                continue
            # what a chain can reach at most
            _, one = np.unique(place[lo:hi], return_index=True)
            if self.share(i, typed[lo:hi][one]) < max(coverage, best.get(i, 0)) or best.get(i, 0) >= 1:
                continue
            hit = self.chain(place[lo:hi], at[lo:hi]) + lo
            share = self.share(i, typed[hit])
            if share >= coverage and share > best.get(i, 0) and self.consistent(i, place[hit], at[hit], h):
                best[i] = share
        return best


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, rows: int = BLOCK_ROWS):
    """The benchmark (item_id, text) as blocks of bounded size, each read by itself.
    Null and empty texts have no windows; repeated rows count once, so that blocks,
    which are told by hash, are even."""
    items = benchmark.select("item_id", text_or_empty().alias("text")).where("length(text) > 0").distinct()
    n_rows, n_words = items.agg(F.count(F.lit(1)), F.sum(F.length("text") / 2)).first()
    blocks = max(1, math.ceil((n_rows or 0) / rows), math.ceil((n_words or 0) / BLOCK_WORDS))
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield Block.of([(r["item_id"], r["text"].encode()) for r in part.orderBy("item_id", "text").collect()], window)


def match_column(shared: Broadcast, text: Column, id_type: str, coverage: float = COVERAGE) -> Column:
    """Array of (item_id, coverage) of the items of a broadcast block that each text contains."""
    item = pa.int64() if id_type in ("bigint", "int") else pa.string()

    @F.arrow_udf(f"array<struct<item_id: {id_type}, coverage: double>>")
    def contains(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int32() if id_type == "int" else item), ("coverage", pa.float64())]))
        return pa.array([[{"item_id": i, "coverage": c} for i, c in shared.value.matches(d, coverage)]
                         for d in texthash.rows(column)], kind)
    return contains(F.coalesce(text, F.lit("")))


def with_matches(docs: DataFrame, benchmark: DataFrame, name: str, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with a column ``name``: the benchmark items that the text contains,
    as an array of (item_id, coverage) in the order of the items."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind = benchmark.schema["item_id"].dataType.simpleString()
    blocks = benchmark_blocks(benchmark)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return docs.withColumn(name, match_column(spark.sparkContext.broadcast(block), F.col("text"), kind, coverage))
    rid = free_name(docs, "rid")
    whole = stage(docs.withColumn(rid, F.monotonically_increasing_id()), "documents")
    parts = []
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        hits = whole.select(F.col(rid).alias("rid"), match_column(shared, F.col("text"), kind, coverage).alias("found"))
        parts.append(stage(hits.where(F.size("found") > 0), "matches"))
        shared.destroy()
        block, after = after, next(blocks, None)
    # a row for each block with a hit: a document's items, no more than its text holds
    every = functools.reduce(DataFrame.union, parts).groupBy("rid").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    found = stage(every.select(F.col("rid").alias(rid), F.col("found").alias(name)), "all-matches")
    drop_stage(*parts)
    return whole.join(found, rid, "left").select(
        *[F.col(c) for c in docs.columns], F.coalesce(F.col(name), F.array().cast(found.schema[name].dataType)).alias(name))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, contaminated, items, coverage) for every row of ``docs``: the item_ids
    that its text contains and the largest covered share (0 if there is none).

    Null and empty texts contain nothing; repeated rows and null ids stay; repeated
    benchmark rows count once; an empty benchmark marks nothing; the whole text is
    looked up.
    """
    name = free_name(docs, "matches")
    m = F.col(name)
    return with_matches(docs.select("doc_id", "text"), benchmark, name, coverage).select(
        "doc_id", (F.size(m) > 0).alias("contaminated"),
        F.transform(m, lambda x: x["item_id"]).alias("items"),
        F.coalesce(F.array_max(F.transform(m, lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns, whatever
    their names. Repeated rows and null ids are judged one by one by their whole text; null
    and empty texts contain nothing and stay; without a benchmark all rows stay; of an
    empty table none. Repeated, null and empty benchmark rows change nothing."""
    name = free_name(docs, "matches")
    return with_matches(docs, benchmark, name, coverage).where(F.size(name) == 0).drop(name)
