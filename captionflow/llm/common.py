"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_table_path, stage_table

#: Bytes of text that one Arrow batch may carry to a Python worker.
ARROW_BATCH_BYTES = 4 * 1024 * 1024
#: A lookup side is broadcast up to this many rows and bytes; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: ``crc32(doc_id as text) mod FOLDS`` is 0 for the held-out rows.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the session's checkpoint folder and read it back."""
    return stage_table(df, f"llm-{name}")


def drop_stage(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            drop_table_path(df.sparkSession, path)


def reads_staged(df: DataFrame, *staged: DataFrame) -> DataFrame:
    """``df``, which reads staged tables of its own: who has written ``df`` can delete them
    with :func:`drop_inputs`."""
    df._staged_inputs = staged
    return df


def drop_inputs(df: DataFrame) -> None:
    drop_stage(*getattr(df, "_staged_inputs", ()))


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts do not fill a worker. The bound
    stays in the session, for the plans of the operators run after they return."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if size_in_bytes(spark.conf.get(key)) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def size_in_bytes(value: str) -> int:
    """A size as Spark's settings give it: a number with an optional unit."""
    m = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", value.lower())
    if m is None:
        raise ValueError(f"not a size: {value!r}")
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows no model may learn from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def size_checked(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``most_bytes`` bytes,
    strings counted by their length."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= rows and size["b"] <= most_bytes else df


def first_by_bytes(rows: DataFrame, order: list[str], size: Callable, most_bytes: int) -> list:
    """Rows in order until their sizes add up to ``most_bytes``: what the driver may hold.
    The rows are written first, so that they are read in order without computing them again."""
    staged, out, held = stage(rows, "sample"), [], 0
    for r in staged.orderBy(*order).toLocalIterator():
        held += size(r)
        if out and held > most_bytes:
            break
        out.append(r)
    drop_stage(staged)
    return out
