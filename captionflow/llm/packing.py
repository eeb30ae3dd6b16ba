"""Sequence packing by non-negative least squares over a length histogram.

1. Each document becomes token ids and an end id, cut into windows; a full window
   is a sequence of its own (the one-piece combination), the tails are left.
2. Tails are counted by length, in units of ``UNIT`` tokens (a bounded histogram).
3. The combinations of up to ``DEPTH`` lengths that fill a window exactly are
   enumerated; non-negative least squares finds how often to repeat each so that
   together they use the histogram up; the counts are rounded down and kept within
   the supply.
4. What is left over is packed greedily: pieces are laid end to end and cut where a
   window ends, so the rest has no gaps either.

Only the histogram (at most window / UNIT counts) and the plan reach the driver.
Pieces find their place by rank within their length: ranks come from counts per
(length, writing task), so a length that a third of all pieces share is spread over
all tasks. The plan's rows carry no ids; ids are written once, two bytes each and
compressed, and joined back once.
"""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stage, text_or_empty

WINDOW = 2048
UNIT = 8
DEPTH = 3
END_ID = 1
_EMIT_TOKENS = 1 << 20


# ---------------------------------------------------------------- tokens
class Ids:
    """Token ids of whole texts: ``encode(text, add_special_tokens=False).ids`` of the
    ``tokenizers`` file ``name``.json.

    The same vocabulary as ranks is several times faster; it is used for texts of
    Latin scripts, over which both give the same ids (tested over all their code
    points). Any other text, and any that holds a string of the file's added tokens
    (which the library gives ids of their own), goes to the library itself.
    """

    LATIN = re.compile("[^\x00-ɏ]")

    def __init__(self, name: str):
        import public_tokenizers as files
        import tiktoken
        with open(files.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json = files.path(f"{name}.json")
        with open(self.json, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.other = re.compile("|".join([self.LATIN.pattern, *map(re.escape, added)]))
        self.fast = tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def exact(self):
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.json)

    def __call__(self, text: str) -> list[int]:
        if self.other.search(text) is None:
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


@functools.lru_cache(maxsize=2)
def ids_of(name: str) -> Ids:
    return Ids(name)


def token_windows(docs: DataFrame, tokenizer: str, window: int) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): the windows of every document;
    ids: two bytes each (four if the vocabulary needs them), compressed."""
    def cut(batches):
        import zstandard
        encode, pack = ids_of(tokenizer), zstandard.ZstdCompressor(level=1)
        for b in batches:
            out, held = [], 0
            for doc, text in zip(b.column(0), b.column(1)):
                ids = np.array(encode(text.as_py()) + [END_ID], np.uint32)
                small = ids.astype(np.uint16) if ids.max() < 1 << 16 else ids
                for at in range(0, len(ids), window):
                    part = small[at:at + window]
                    out.append((doc, at, len(part), len(ids), part.itemsize, pack.compress(part.tobytes())))
                held += len(ids)
                if held >= _EMIT_TOKENS:
                    yield _batch(out, b.column(0).type)
                    out, held = [], 0
            if out:
                yield _batch(out, b.column(0).type)

    def _batch(out, id_type):
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array([x.as_py() for x in cols[0]], id_type)] + [pa.array(c, pa.int64()) for c in cols[1:4]]
            + [pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.binary())],
            ["doc_id", "start", "length", "doc_tokens", "width", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        cut, f"doc_id {kind}, start long, length long, doc_tokens long, width int, ids binary")


# ---------------------------------------------------------------- plan
@functools.lru_cache(maxsize=2)
def combinations(units: int, depth: int = DEPTH) -> tuple[tuple[int, ...], ...]:
    """Every multiset of up to ``depth`` lengths (each under a window) that fills
    the window exactly."""
    def fill(rest: int, most: int, left: int):
        if rest == 0:
            yield ()
        elif left:
            for first in range(min(rest, most), 0, -1):
                if first * left >= rest:
                    for more in fill(rest - first, first, left - 1):
                        yield (first, *more)
    return tuple(fill(units, units - 1, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tolerance:
            break
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (s > tolerance).all():
                x[:] = 0
                x[on] = s
                break
            low = s <= tolerance
            now = x[on]
            with np.errstate(divide="ignore", invalid="ignore"):
                step = float(np.nanmin(np.where(low & (now > s), now / (now - s), 1.0)))
            x[on] = now + step * (s - now)
            drop = on[low & (x[on] <= tolerance)]
            if not len(drop):
                drop = on[low]
            x[drop] = 0
            active[drop] = False
            if not active.any():
                break
    return x


def plan_counts(histogram: np.ndarray, units: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) from the histogram (index: length in units), with
    rounded counts that never need more pieces of a length than there are."""
    combos = combinations(units, depth)
    a = np.zeros((units, len(combos)))
    for j, combo in enumerate(combos):
        for length in combo:
            a[length, j] += 1
    x = nnls(a, histogram[:units].astype(float))
    left, out = histogram.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 1:
            break
        need = np.bincount(combos[j], minlength=len(left))
        times = min(int(x[j] + 1e-6), int((left[need > 0] // need[need > 0]).min()))
        if times:
            left -= times * need
            out.append((combos[j], times))
    return out


# ---------------------------------------------------------------- placement
def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and
    ids (little-endian unsigned 32 bit).

    Null and empty texts are the end id alone. Each row is a document: repeated rows
    and null ids are packed like others. A document of any length is cut into
    windows, so no piece is longer than one. An empty table gives no rows; columns
    other than doc_id and text are not read.
    """
    if window % unit:
        raise ValueError("the window must be a multiple of the unit")
    spark, units = docs.sparkSession, window // unit
    bound_batches(spark)
    pieces = stage(token_windows(docs, tokenizer, window).withColumn("pid", F.monotonically_increasing_id()), "windows")
    full = pieces.where(F.col("length") == window)
    tails = pieces.where(F.col("length") < window)
    # pid names the task that wrote the piece and the row in it
    sized = tails.select("pid", "length", F.ceil(F.col("length") / unit).cast("int").alias("bin"),
                         F.shiftright("pid", 33).alias("task"))
    per_task = stage(sized.groupBy("bin", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(units + 1, np.int64)
    for r in per_task.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most window / unit rows
        histogram[r["bin"]] = r["n"]

    # intervals of ranks within a length, and where a piece of such a rank goes
    used, slots, first = np.zeros(units + 1, np.int64), [], 0
    for combo, times in plan_counts(histogram, units):
        for slot, length in enumerate(combo):
            slots.append((length, int(used[length]), int(used[length]) + times, first, slot))
            used[length] += times
        first += times
    left = histogram - used
    lengths = np.arange(units + 1)
    before = np.concatenate(([0], np.cumsum((left * lengths)[:-1])))  # units of leftovers of smaller lengths
    rest = [(int(k), int(used[k]), int(histogram[k]), int(before[k])) for k in lengths if left[k]]

    ahead = Window.partitionBy("bin").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("bin", "task", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    in_task = F.row_number().over(Window.partitionBy("bin", "task").orderBy("pid")) - 1
    ranked = sized.withColumn("nth", in_task).join(base, ["bin", "task"]) \
        .select("pid", "length", "bin", (F.col("base") + F.col("nth")).alias("rank"))
    slot_rows = F.broadcast(spark.createDataFrame(slots, "bin int, low long, high long, first long, slot int"))
    rest_rows = F.broadcast(spark.createDataFrame(rest, "bin int, low long, high long, before long"))
    inside = (F.col("r.bin") == F.col("s.bin")) & (F.col("r.rank") >= F.col("s.low")) & (F.col("r.rank") < F.col("s.high"))
    planned = ranked.alias("r").join(slot_rows.alias("s"), inside).select(
        "pid", F.lit(0).cast("long").alias("skip"), "length",
        (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("slot").cast("long").alias("place"))
    # leftovers: place is the distance from the start of the first leftover window
    laid = ranked.alias("r").join(rest_rows.alias("s"), inside).select(
        "pid", "length", (F.col("before") + (F.col("rank") - F.col("low")) * F.col("r.bin")).alias("at"))
    head = F.least("length", (units - F.col("at") % units) * unit)
    left_id = F.floor(F.col("at") / units) + first
    parts = F.array(
        F.struct(F.lit(0).cast("long").alias("skip"), head.alias("length"), left_id.alias("sequence_id"), F.col("at").alias("place")),
        F.struct(head.alias("skip"), (F.col("length") - head).alias("length"), (left_id + 1).alias("sequence_id"),
                 F.lit(-1).cast("long").alias("place")))
    greedy = laid.select("pid", F.explode(parts).alias("p")).select("pid", "p.*").where("length > 0")
    before_in = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = planned.union(greedy).withColumn("offset", F.coalesce(F.sum("length").over(before_in), F.lit(0))) \
        .withColumnRenamed("length", "take")
    cut = tails.join(placed, "pid").select(
        "doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("take").alias("length"), "doc_tokens",
        "sequence_id", "offset", "skip", "width", "ids")
    # full windows are numbered apart, by the piece, from 2**62 on
    whole = full.select("doc_id", "start", "length", "doc_tokens",
                        (F.col("pid") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                        F.lit(0).cast("long").alias("skip"), "width", "ids")

    def unpack(batches):
        import zstandard
        un = zstandard.ZstdDecompressor()
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                ids = []
                for blob, width, skip, n in zip(*(b.column(k).to_pylist() for k in ("ids", "width", "skip", "length"))):
                    part = np.frombuffer(un.decompress(blob), np.uint16 if width == 2 else np.uint32)
                    ids.append(part[skip:skip + n].astype("<u4").tobytes())
                names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([b.column(k) for k in names] + [pa.array(ids, pa.binary())], names + ["ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut.union(whole).mapInArrow(
        unpack, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def packing_digest(packed: DataFrame) -> DataFrame:
    """The piece table of a packing, with a checksum in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
