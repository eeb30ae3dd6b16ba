"""Token-id files: flat unsigned integer files with 64-bit document offsets.

A folder holds shards and a manifest. A shard is three flat little-endian files:

    <shard>.ids   the token ids, two bytes each (four if the vocabulary needs them)
    <shard>.off   unsigned 64 bit, one more than documents: where each document starts
    <shard>.doc   signed 64 bit: the document ids; the first ``nulls`` of them are null

Shards are in ascending order of document id. Offsets in a shard start at zero, so a
task writes its shards without knowing of the others; each task returns how many ids
and documents its shards hold, and the driver's commit turns these counts (a few
numbers for each shard) into the shards' bases by prefix sums. The manifest lists the
shards with their bases and is written last. A base plus an offset is the place of a
document in the whole corpus.

The files are plain arrays: a reader maps them into memory (``numpy.memmap``) where the
storage is a local or mounted path, and reads ranges of them elsewhere.

``token_files`` is a Spark data source: ``df.write.format("token_files").save(path)``
takes (doc_id long, ids binary: little-endian unsigned 32 bit) sorted by doc_id across
partitions, and ``spark.read.format("token_files").load(path)`` gives (doc_id, start,
n_tokens, ids) back, a task for each shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

from ..sources.shared_files import names_in, open_fs, put_json, read_json
from .common import bound_batches, text_or_empty
from .packing import ids_of

END_ID = 0
MANIFEST = "manifest.json"
#: A shard is closed at the first document end after so many ids.
SHARD_TOKENS = 1 << 27
#: A batch of documents read back ends after so many ids.
READ_TOKENS = 1 << 20


# ---------------------------------------------------------------- the files
class _Shard:
    """The three files of a shard while they are written."""

    def __init__(self, files, path: str, width: int):
        self.kind, self.tokens, self.docs, self.nulls = f"<u{width}", 0, 0, 0
        self.out = {end: files.open_output_stream(f"{path}.{end}") for end in ("ids", "off", "doc")}
        self.out["off"].write(np.zeros(1, "<u8").tobytes())

    def add(self, docs: pa.Array, blobs: list[bytes]) -> None:
        ids = np.frombuffer(b"".join(blobs), "<u4")
        small = ids.astype(self.kind)
        if (small != ids).any():
            raise ValueError(f"a token id does not fit {self.kind}")
        ends = self.tokens + np.cumsum([len(b) // 4 for b in blobs], dtype=np.uint64)
        self.out["ids"].write(small.tobytes())
        self.out["off"].write(ends.astype("<u8").tobytes())
        self.out["doc"].write(docs.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        self.tokens, self.docs, self.nulls = self.tokens + len(ids), self.docs + len(blobs), self.nulls + docs.null_count

    def close(self) -> None:
        for f in self.out.values():
            f.close()


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    shards: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex
        self.width, self.limit = int(options.get("width", "2")), int(options.get("shard_tokens", str(SHARD_TOKENS)))
        files, folder = open_fs(self.path)
        if not overwrite and read_json(files, f"{folder}/{MANIFEST}") is not None:
            raise ValueError(f"{self.path} holds token files; write with mode overwrite to replace them")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, folder = open_fs(self.path)
        files.create_dir(folder)
        partition = TaskContext.get().partitionId()
        stem = f"shard-{self.run}-{partition:06d}-{uuid.uuid4().hex}"
        now, done = None, []

        def close():
            now.close()
            done.append({"name": name, "tokens": now.tokens, "docs": now.docs, "nulls": now.nulls})
        for batch in iterator:
            docs, blobs, at = batch.column(0), batch.column(1), 0
            while at < batch.num_rows:
                if now is None:
                    name = f"{stem}-{len(done)}"
                    now = _Shard(files, f"{folder}/{name}", self.width)
                take, room = [], self.limit - now.tokens
                for b in blobs.slice(at):  # up to the shard's end
                    take.append(b.as_py())
                    room -= len(take[-1]) // 4
                    if room <= 0:
                        break
                now.add(docs.slice(at, len(take)), take)
                at += len(take)
                if room <= 0:
                    close()
                    now = None
        if now is not None:
            close()
        return _Written(partition, done)

    def commit(self, messages: list) -> None:
        files, folder = open_fs(self.path)
        files.create_dir(folder)
        shards, tokens, docs = [], 0, 0
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for s in m.shards:
                shards.append(s | {"first_token": tokens, "first_doc": docs})
                tokens, docs = tokens + s["tokens"], docs + s["docs"]
        put_json(files, f"{folder}/{MANIFEST}", {"format": "token_files", "version": 1, "width": self.width,
                                                 "tokens": tokens, "docs": docs, "shards": shards})
        self._sweep(files, folder, {s["name"] for s in shards})

    def abort(self, messages: list) -> None:
        files, folder = open_fs(self.path)
        listed = read_json(files, f"{folder}/{MANIFEST}") or {"shards": []}
        self._sweep(files, folder, {s["name"] for s in listed["shards"]}, f"shard-{self.run}-")

    def _sweep(self, files, folder: str, keep: set[str], prefix: str = "shard-") -> None:
        """Delete shards that no manifest lists."""
        for name in names_in(files, folder):
            if name.startswith(prefix) and name.rpartition(".")[0] not in keep:
                files.delete_file(f"{folder}/{name}")


class _Flat:
    """A flat file as an array: mapped where it is a local path, read in ranges elsewhere."""

    def __init__(self, files, path: str, kind: str):
        self.kind, self.local = np.dtype(kind), files.type_name == "local"
        if self.local:
            self.all = np.memmap(path, self.kind, "r") if files.get_file_info(path).size else np.zeros(0, self.kind)
        else:
            self.file = files.open_input_file(path)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.local:
            return self.all[part]
        size = self.kind.itemsize
        return np.frombuffer(self.file.read_at((part.stop - part.start) * size, part.start * size), self.kind)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        files, folder = open_fs(self.path)
        listed = read_json(files, f"{folder}/{MANIFEST}")
        if listed is None:
            raise ValueError(f"no token files in {self.path}")
        return [InputPartition(s | {"width": listed["width"]}) for s in listed["shards"]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no shards
            return
        s = partition.value
        files, folder = open_fs(self.path)
        stem, n = f"{folder}/{s['name']}", s["docs"]
        ids, off, doc = (_Flat(files, f"{stem}.{end}", kind) for end, kind in
                         (("ids", f"<u{s['width']}"), ("off", "<u8"), ("doc", "<i8")))
        at = 0
        while at < n:
            ends = off[at:min(n, at + 8192) + 1].astype(np.int64)
            take = max(1, int(np.searchsorted(ends, ends[0] + READ_TOKENS, "right")) - 1)
            ends = ends[:take + 1]
            data = ids[int(ends[0]):int(ends[-1])].astype("<u4").tobytes()
            places = ((ends - ends[0]) * 4).astype(np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), take, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(data)])
            none = np.arange(at, at + take) < s["nulls"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(doc[at:at + take]), pa.int64(), mask=none), pa.array(ends[:-1] + s["first_token"]),
                 pa.array(np.diff(ends)), blobs], ["doc_id", "start", "n_tokens", "ids"])
            at += take


class TokenFiles(DataSource):
    """The ``token_files`` format; options: path, width (bytes of an id), shard_tokens."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)


# ---------------------------------------------------------------- the operator
def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, ids) of rows (doc_id, text): the ids of the whole text and an end id,
    as little-endian unsigned 32 bit. Rows keep their order."""
    def ids(batches):
        of, end = ids_of(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            out = [np.array(of(t.as_py()), "<u4").tobytes() + end for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "ids"])
    return docs.mapInArrow(ids, "doc_id long, ids binary")


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k", end_id: int = END_ID, width: int = 2,
                      shard_tokens: int = SHARD_TOKENS, mode: str = "append") -> None:
    """Encode ``docs`` (doc_id, text) and write them to a folder of token files in
    ascending order of doc_id.

    Null ids come first; rows that repeat an id follow one another, by the hash of their
    text. Null and empty texts are the end id alone. Whole texts are encoded; a document
    is never cut over shards. An empty table gives a manifest without shards; columns
    other than doc_id and text are not read. Mode ``append`` needs a folder without token
    files, ``overwrite`` replaces them (the old ones count until the new manifest does).

    One shuffle: the texts, into ranges of (doc_id, text hash, row), so that one id that
    a third of the rows share is spread too. The tokenizer runs after it, in the tasks
    that write; so nothing is encoded twice, and a lost executor costs the shards it was
    writing.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    spark.dataSource.register(TokenFiles)
    order = ["doc_id", "_hash", "_row"]
    rows = docs.select("doc_id", text_or_empty().alias("text")) \
        .withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    (encode(rows, tokenizer, end_id).write.format("token_files").mode(mode)
     .option("width", width).option("shard_tokens", shard_tokens).save(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a folder of token files: ``start`` counts the
    ids of all documents before; ``ids`` are little-endian unsigned 32 bit."""
    bound_batches(spark)
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").load(path)
