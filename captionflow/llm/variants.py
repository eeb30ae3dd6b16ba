"""Spelling variants by a dictionary of trie-node pairs.

The words are put into two tries, one of the words and one of the reversed words, and
the nodes of both are numbered. Cutting a word after its first i code points gives a
node of the first trie (its prefix) and a node of the second (its suffix): a pair of
integers that stands for the word cut there. Leaving position i out gives the pair
(prefix before i, suffix after i). Then

* two words with the same skipped pair differ in exactly the code point at i;
* a word whose skipped pair equals a cut pair of another word is that word with one
  code point inserted. Of equal adjacent code points only the last counts as the
  inserted one, so each such pair of words meets once.

So equal pairs give all words one edit apart, exactly: nothing is hashed and nothing
has to be verified. A pair is shared by at most one word cut there and the words that
put one code point there, so a group is never larger than the alphabet (under 100).
No pairs of words are emitted: within a group, sorted by count, the first two members
tell each member its best partner, and the group's size tells the number.

A trie is numbered from its sorted words. Words are ranged over tasks; a task walks its
words in order and keeps the path of the last one: a word leaves the path at the common
prefix with the word before, and gets new nodes below it. Only the first word of a task
may run along nodes that an earlier task has numbered; what the tasks need to know of
each other is their first and last words (two rows a task, gathered by the driver). A
word's pairs are only made where both its prefix and its suffix are shared with another
word, which its neighbours in the two orders tell.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_stage, stage

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A word's form occurs so many times as often.
RATIO = 10
#: One occurrence in so many loses a code point (``None``: the text as it is).
DAMAGE = 31
RUN = "[A-Za-zÀ-ÿ]"
#: Entries that a counting task keeps before it passes them on.
_HELD = 300_000
_PART_BITS = 36  # a node's or word's number: task above, running number below
_EMIT_PAIRS = 1 << 17


# ---------------------------------------------------------------- words
def _shortened(word: str, seed: int, damage: int) -> str:
    h = zlib.crc32(word.encode(), seed)
    if h % damage:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def count_words(docs: DataFrame, damage: int | None = DAMAGE, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): how often each run of letters occurs, ASCII letters lowered, of
    ``least`` code points and more. With ``damage``, a run of a document whose crc32 of
    ``<doc_id>:<run>`` the number divides loses the code point crc32 % length."""
    runs = re.compile(f"{RUN.replace('A-Z', '')}{{{least},}}")

    def count(batches):
        held: dict[str, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                              ["word", "n"])
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                if not text.is_valid:
                    continue
                # bytes lower ASCII letters only
                low = text.as_buffer().to_pybytes().lower().decode(errors="replace")
                seed = zlib.crc32(b"%s:" % (b"" if doc is None else doc.encode()))
                for word, n in Counter(runs.findall(low)).items():
                    if damage:
                        word = _shortened(word, seed, damage)
                        if len(word) < least:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= _HELD:
                    yield out()
                    held = {}
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- tries
def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 64:  # long words: halve
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    while a[low] == b[low]:
        low += 1
    return low


class _Trie:
    """Numbers the nodes of the words of one task, which come in order.

    Rows out: number of the word, word, count, path (the node of each prefix up to
    ``reach``, the longest prefix shared with a neighbour in order) and edge (1 for a
    task's first word, 2 for its last, 3 for both). For these two reach is the whole
    word, since the neighbour is not known."""

    FIELDS = "wid long, word string, n long, path array<long>, edge int"

    def __init__(self, part: int):
        self.base, self.nodes, self.words = part << _PART_BITS, 0, 0
        self.last: tuple | None = None
        self.stack: list[int] = []
        self.rows: list[list] = [[], [], [], [], []]
        self.size = 0

    def add(self, wid: int | None, word: str, n: int) -> None:
        if self.last is not None:
            shared = common_prefix(self.last[1], word)
            self._put(max(shared, self.last[3]) if self.last[4] == 0 else len(self.last[1]), self.last[4])
            del self.stack[shared:]
        else:
            shared = 0
        if wid is None:
            wid = self.base + self.words
        self.words += 1
        self.last = (wid, word, n, shared, 1 if self.words == 1 else 0)

    def end(self) -> None:
        if self.last is not None:
            self._put(len(self.last[1]), self.last[4] | 2)

    def _put(self, reach: int, edge: int) -> None:
        wid, word, n = self.last[:3]
        while len(self.stack) < reach:
            self.stack.append(self.base + self.nodes)
            self.nodes += 1
        for column, value in zip(self.rows, (wid, word, n, self.stack[:reach], edge)):
            column.append(value)
        self.size += reach + 8

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int32())
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(self.rows, kinds)],
                                         ["wid", "word", "n", "path", "edge"])
        self.rows, self.size = [[], [], [], [], []], 0
        return out


def number_trie(words: DataFrame, name: str) -> tuple[DataFrame, dict[int, int]]:
    """The rows of :class:`_Trie` for ``words`` (wid or null, word, n), all distinct and
    not empty, staged; and the nodes that two tasks have numbered: which number stands
    for which."""
    def number(batches: Iterator[pa.RecordBatch]):
        trie = _Trie(TaskContext.get().partitionId())
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                trie.add(*row)
                if trie.size >= _EMIT_PAIRS:
                    yield trie.batch()
        trie.end()
        yield trie.batch()

    ordered = words.repartitionByRange("word").sortWithinPartitions("word").select("wid", "word", "n")
    out = stage(ordered.mapInArrow(number, _Trie.FIELDS), name)
    same: dict[int, int] = {}
    before, path = "", []
    edges = out.where("edge > 0").select("wid", "word", "path", "edge").collect()  # two rows of a task
    for r in sorted(edges, key=lambda r: r["word"]):
        if r["edge"] & 1:
            for mine, first in zip(r["path"][:common_prefix(before, r["word"])], path):
                same[mine] = first
        if r["edge"] & 2:
            before, path = r["word"], [same.get(x, x) for x in r["path"]]
    return out, same


class _Renumber:
    """Numbers of nodes, with one number for a node that two tasks have numbered."""

    def __init__(self, same: dict[int, int]):
        order = sorted(same)
        self.mine, self.first = np.array(order, np.int64), np.array([same[k] for k in order], np.int64)

    def __call__(self, nodes: np.ndarray) -> np.ndarray:
        if not len(self.mine):
            return nodes
        at = np.minimum(np.searchsorted(self.mine, nodes), len(self.mine) - 1)
        return np.where(self.mine[at] == nodes, self.first[at], nodes)


# ---------------------------------------------------------------- pairs
ROOT = -1
CUT, SKIP, INSERTED = 0, 1, 3  # a word cut there; one position skipped; and it counts as inserted


def word_pairs(word: str, prefix: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix node, suffix node, kind) of a word; ``prefix[i]`` and ``suffix[i]`` are
    the nodes of its first and last i code points, as far as they are shared."""
    size, far, back = len(word), len(prefix) - 1, len(suffix) - 1
    skip = np.arange(max(0, size - 1 - back), min(far, size - 1) + 1)
    cut = np.arange(max(0, size - back), min(far, size) + 1)
    letters = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    last = np.append(letters[1:] != letters[:-1], True)
    kind = np.where(last[skip], INSERTED, SKIP) if len(skip) else np.zeros(0, np.int64)
    return (np.concatenate((prefix[skip], prefix[cut])), np.concatenate((suffix[size - 1 - skip], suffix[size - cut])),
            np.concatenate((kind, np.full(len(cut), CUT))).astype(np.int32))


def pair_rows(forward: DataFrame, same_forward: dict[int, int], backward: DataFrame, same_backward: dict[int, int]) -> DataFrame:
    """(p, s, kind, n, wid) for the pairs of every word."""
    def pairs(batches):
        one, other = _Renumber(same_forward), _Renumber(same_backward)

        def out(parts):
            p, s, kind, n, wid = (np.concatenate(c) for c in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array(one(p)), pa.array(other(s)), pa.array(kind), pa.array(n), pa.array(wid)],
                                              ["p", "s", "kind", "n", "wid"])
        parts, held = [], 0
        for b in batches:
            for wid, word, n, path, back in zip(*(c.to_pylist() for c in b.columns)):
                p, s, kind = word_pairs(word, np.array([ROOT, *path], np.int64), np.array([ROOT, *back], np.int64))
                parts.append((p, s, kind, np.full(len(p), n, np.int64), np.full(len(p), wid, np.int64)))
                held += len(p)
                if held >= _EMIT_PAIRS:
                    yield out(parts)
                    parts, held = [], 0
        if parts:
            yield out(parts)

    both = forward.select("wid", "word", "n", "path").join(backward.select("wid", F.col("path").alias("back")), "wid")
    return both.select("wid", "word", "n", "path", "back").mapInArrow(pairs, "p long, s long, kind int, n long, wid long")


def group_partners(p: np.ndarray, s: np.ndarray, kind: np.ndarray, n: np.ndarray, wid: np.ndarray):
    """(wid, near, best n, best wid) from whole groups of rows sorted by (p, s), count
    falling, wid rising; rows without a partner are left out."""
    new = np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])) if len(p) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    groups = int(new.sum())

    def firsts(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each group the row of its first chosen member (-1: none), and their number."""
        rows = np.flatnonzero(chosen)
        of = group[rows]
        row = np.full(groups, -1)
        row[of[::-1]] = rows[::-1]
        return row, np.bincount(of, minlength=groups)
    skip, inserted, cut = kind != CUT, kind == INSERTED, kind == CUT
    first, size = firsts(skip)
    rest = skip.copy()
    rest[first[first >= 0]] = False
    second, _ = firsts(rest)
    longer, longers = firsts(inserted)
    whole, _ = firsts(cut)
    out = []

    def put(rows: np.ndarray, best: np.ndarray, near: np.ndarray):
        out.append((wid[rows], near, n[best], wid[best]))
    # replaced: the others that skip the same position
    rows = np.flatnonzero(skip & (size[group] > 1))
    put(rows, np.where(first[group[rows]] == rows, second[group[rows]], first[group[rows]]), size[group[rows]] - 1)
    # one code point less: the word cut there
    rows = np.flatnonzero(inserted & (whole[group] >= 0))
    put(rows, whole[group[rows]], np.ones(len(rows), np.int64))
    # one code point more
    rows = np.flatnonzero(cut & (longers[group] > 0))
    put(rows, longer[group[rows]], longers[group[rows]])
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*out))


def partners(pairs: DataFrame) -> DataFrame:
    """(wid, n_near, best struct(n, low)): number of near words, and the best of them
    (its count, and its wid negated)."""
    def walk(batches):
        names = ["wid", "near", "n", "best"]
        held = None
        for b in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            p, s = now[0], now[1]
            # the last group may go on in the next batch
            open_from = int(np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (s[1:] != s[:-1])))[-1])
            held = [c[open_from:] for c in now]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in group_partners(*(c[:open_from] for c in now))], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in group_partners(*held)], names)

    together = pairs.repartition("p", "s").sortWithinPartitions("p", "s", F.desc("n"), "wid")
    found = together.mapInArrow(walk, "wid long, near long, n long, best long")
    return found.groupBy("wid").agg(F.sum("near").alias("n_near"),
                                    F.max(F.struct("n", (-F.col("best")).alias("low"))).alias("best"))


# ---------------------------------------------------------------- forms
def root_of(forms: DataFrame) -> DataFrame:
    """(wid, root) from (wid, form): the end of the chain of forms. A form occurs at
    least ``ratio`` times as often as its word, so chains are short; pointers are
    doubled until none moves."""
    now = stage(forms.select("wid", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        moved = now.join(ahead, "root", "left").select("wid", F.coalesce("next", "root").alias("root"),
                                                       F.col("next").isNotNull().alias("moved"))
        after = stage(moved, "roots")
        drop_stage(now)
        now = after
        if after.where("moved").limit(1).count() == 0:
            return now.select("wid", "root")


def variant_forms(docs: DataFrame, damage: int | None = DAMAGE, least_length: int = LEAST_LENGTH,
                  least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs`` (doc_id, text).

    Words: maximal runs of letters (U+00C0 to U+00FF included), ASCII letters lowered, of
    ``least_length`` code points and ``least_count`` occurrences. ``n_near`` words are one
    insertion, deletion or replacement away; the form is the near word of largest count
    (of equal ones the smallest in code-point order), if it occurs ``ratio`` times as often;
    the root is the end of the chain of forms.

    Null and empty texts have no words; a null doc_id counts as an empty one in the
    damage rule; rows that repeat an id count each; texts and words of any length are
    taken whole; an empty table gives no rows; columns other than doc_id and text are
    not read. No group of this plan grows with the data: see the module's text.
    """
    if not ratio > 1:
        raise ValueError("a form must occur more often than its word")
    bound_batches(docs.sparkSession)
    words = count_words(docs, damage, least_length).where(F.col("n") >= least_count)
    forward, same_forward = number_trie(words.select(F.lit(None).cast("long").alias("wid"), "word", "n"), "words")
    backward, same_backward = number_trie(
        forward.select("wid", F.reverse("word").alias("word"), F.lit(0).cast("long").alias("n")), "reversed")
    near = stage(partners(pair_rows(forward, same_forward, backward, same_backward)), "near")
    drop_stage(backward)

    own = forward.select("wid", "word", "n").join(near, "wid", "left")
    has_form = F.col("best.n") >= F.lit(ratio) * F.col("n")
    all_words = stage(own.select("wid", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                 F.when(has_form, F.col("best.n")).alias("form_n"),
                                 F.when(has_form, -F.col("best.low")).alias("form")), "variants")
    drop_stage(near, forward)
    with_form = all_words.where("form is not null")
    roots = root_of(with_form)
    spelled = all_words.select(F.col("wid").alias("to"), F.col("word").alias("spelling"))
    named = with_form.select("wid", F.col("form").alias("to")).join(spelled, "to").select("wid", F.col("spelling").alias("form")) \
        .join(roots.withColumnRenamed("root", "to").join(spelled, "to").select("wid", F.col("spelling").alias("root")), "wid")
    return all_words.drop("form").join(named, "wid", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
