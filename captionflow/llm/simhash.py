"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link when at most two bits differ. Anchors are the code
words of a covering code: the direct sum of two binary Golay codes of length 23
(radius 3) and a Hamming code of length 15 (radius 1), all perfect, over 61 of the
64 bits. Two linked fingerprints have a point midway that differs from each in at
most one bit; the anchor that covers this point is within the covering radius plus
one bit of both. So each fingerprint is replicated to every anchor within that
distance (about 16 of 2**35), and fingerprints are compared only per anchor. This
is the radius-plus-threshold rule with the threshold halved by the midway point;
it finds every pair, with 16 replicas in place of several hundred.

Exact copies share a fingerprint and are one row before replication. An anchor
with at most ``BUCKET`` fingerprints is compared in one place; those of a fuller
anchor are regrouped by midway point (65 for each fingerprint, at most 65
fingerprints each), aggregated without ever gathering the group.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import texthash
from .common import bound_batches, drop_stage, free_name, reads_staged, stage
from .components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BUCKET = 256
_BLOCK = 1 << 16
U64 = np.uint64

# Fixed values: (length, check bits, generator polynomial, covering radius) of the
# codes, the first from bit 0 of the fingerprint on.
CODES = (
    (23, 11, 0b110001110101, 3),
    (23, 11, 0b110001110101, 3),
    (15, 4, 0b10011, 1),
)


# ---------------------------------------------------------------- fingerprints
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)[:, ::-1]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text: ASCII letters lowered, words between
    ASCII white space, word shingles with repeats, XXH64. No words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
    ends = starts + lengths
    if len(words) > shingle:
        starts, ends = starts[:len(words) - shingle + 1], ends[shingle - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, digest = np.zeros((8, 8), np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), _BLOCK):
        h = np.array([digest(joined[a:b], SEED) for a, b in
                      zip(starts[i:i + _BLOCK].tolist(), ends[i:i + _BLOCK].tolist())], U64).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[k] += np.bincount(h[:, k], minlength=256) @ _BYTE_BITS
    bits = (ones.ravel() * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(U64)[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long; null text counts as empty."""
    @F.arrow_udf("long")
    def simhash(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(r.tobytes(), shingle) for r in texthash.rows(column)], U64).view(np.int64))
    return simhash(F.coalesce(text, F.lit("")))


def hex16(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---------------------------------------------------------------- the covering code
@functools.lru_cache(maxsize=None)
def _code(length: int, checks: int, poly: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome: the error pattern within the radius (one, the code is
    perfect) and those of one bit more (rows padded with 0, a count for each)."""
    def syndrome(x: int) -> int:
        for i in range(length - 1, checks - 1, -1):
            if x >> i & 1:
                x ^= poly << (i - checks)
        return x
    of_bit = [syndrome(1 << i) for i in range(length)]
    nearest, further = np.zeros(1 << checks, U64), [[] for _ in range(1 << checks)]
    for weight in range(radius + 2):
        for bits in combinations(range(length), weight):
            s = functools.reduce(lambda a, i: a ^ of_bit[i], bits, 0)
            pattern = sum(1 << i for i in bits)
            if weight <= radius:
                nearest[s] = pattern
            else:
                further[s].append(pattern)
    count = np.array([len(x) for x in further])
    padded = np.array([x + [0] * (count.max() - len(x)) for x in further], U64)
    return nearest, padded, count


@functools.lru_cache(maxsize=None)
def _syndromes(length: int, checks: int, poly: int) -> list[np.ndarray]:
    """Syndrome tables of the low, middle and high byte of a block."""
    out = []
    for low in range(0, length, 8):
        t = np.zeros(256, U64)
        for v in range(256):
            x = (v << low) & ((1 << length) - 1)
            for i in range(length - 1, checks - 1, -1):
                if x >> i & 1:
                    x ^= poly << (i - checks)
            t[v] = x
        out.append(t)
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint) for every anchor within the covering
    radius of each block, and within one bit more of one block."""
    base, shift, extra = np.zeros(len(fps), U64), 0, []
    for length, checks, poly, radius in CODES:
        block = (fps >> U64(shift)) & U64((1 << length) - 1)
        syn = np.zeros(len(fps), U64)
        for k, t in enumerate(_syndromes(length, checks, poly)):
            syn ^= t[((block >> U64(8 * k)) & U64(255)).astype(np.int64)]
        syn = syn.astype(np.int64)
        nearest, further, count = _code(length, checks, poly, radius)
        near = nearest[syn]
        base |= (block ^ near) << U64(shift)
        who = np.repeat(np.arange(len(fps)), count[syn])
        nth = np.arange(len(who)) - np.repeat(np.cumsum(count[syn]) - count[syn], count[syn])
        # xor turns the nearest code word of this block into the other one
        extra.append((who, (near[who] ^ further[syn[who], nth]) << U64(shift)))
        shift += length
    parts = [(np.arange(len(fps)), base)] + [(who, base[who] ^ turn) for who, turn in extra]
    return np.concatenate([p[1] for p in parts]), np.concatenate([p[0] for p in parts])


# ---------------------------------------------------------------- links
def _local_components(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket, thinned to (member, smallest of its local component)."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= max_bits
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(src, dst) edges between distinct fingerprints (column ``fp``) that connect
    exactly the fingerprints that chains of links connect."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the anchors cover distances of 0 to 2 bits")

    def replicate(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(U64)
            key, who = anchors(fps)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps[who].view(np.int64))],
                                             ["anchor", "fp"])

    def compare(batches):
        for b in batches:
            src, dst = [np.zeros(0, U64)], [np.zeros(0, U64)]
            for values in b.column(0):
                a, z = _local_components(np.sort(values.values.to_numpy().view(U64)), max_bits)
                src.append(a)
                dst.append(z)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)],
                                             ["src", "dst"])

    at = stage(distinct.select("fp").mapInArrow(replicate, "anchor long, fp long"), "anchors")
    busy = stage(at.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "busy")
    some = at.join(busy.where(F.col("n") <= BUCKET).select("anchor"), "anchor")
    links = some.groupBy("anchor").agg(F.collect_list("fp").alias("fps")).select("fps") \
        .mapInArrow(compare, "src long, dst long").distinct()
    full = at.join(busy.where(F.col("n") > BUCKET).select("anchor"), "anchor").select("fp").distinct()
    turn = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    mids = full.select("fp", F.explode(turn).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("mid"))
    if max_bits < 2:  # a midway point no longer implies a link: test it
        low = mids.groupBy("mid").agg(F.collect_set("fp").alias("fps")).select("fps")  # at most 65 of them
        return links.union(low.where(F.size("fps") > 1).mapInArrow(compare, "src long, dst long").distinct())
    low = stage(mids.groupBy("mid").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("n"))
                .where("n > 1").select("mid", "low"), "midpoints")
    hot = mids.join(low, "mid").where("fp <> low").select(F.col("fp").alias("src"), F.col("low").alias("dst"))
    return links.union(hot.distinct())


def fingerprint_components(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of ``rows`` (doc_id,
    fp): the smallest fingerprint and the smallest doc_id of the documents that links
    connect; null ids count only where a component has no other."""
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "classes")
    parts = stage(connected_components(fingerprint_links(classes, max_bits)), "components")
    of = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("component", "fp"))
    low = stage(of.groupBy("root").agg(F.min("doc_id").alias("component_id")), "lowest")
    return stage(of.select("fp", "root").join(low, "root").select("fp", "root", "component_id"), "fp-components")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint 0 and link like any other; repeated rows
    stay; an empty table gives no rows; other columns are not read. The whole text
    is fingerprinted, in blocks of shingles.
    """
    bound_batches(docs.sparkSession)
    rows = stage(docs.select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp")), "fingerprints")
    return rows.join(fingerprint_components(rows, max_bits), "fp").select("doc_id", "fp", "component_id")


def keep_one_per_component(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with
    the smallest doc_id stays (of rows that repeat this id, one; null ids last).
    All columns are kept as they are."""
    bound_batches(docs.sparkSession)
    rid, fp = free_name(docs, "rid"), free_name(docs, "fp")
    whole = stage(docs.withColumn(fp, fingerprint_column(F.col("text"), shingle))
                  .withColumn(rid, F.monotonically_increasing_id()), "documents")
    rows = whole.select("doc_id", F.col(fp).alias("fp"), F.col(rid).alias("rid"))
    of = rows.join(fingerprint_components(rows, max_bits), "fp")
    # of the rows of a component: the smallest id, then the first such row; by root,
    # for components of null ids alone have no id to tell them apart
    low = of.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("low"))
    keep = stage(low.select(F.col("low.rid").alias(rid)), "kept")
    # the kept rows grow with the documents: merged by key at every size
    return reads_staged(whole.join(keep.hint("merge"), rid, "left_semi").select(*docs.columns), whole, keep)
