"""Token-id files: the plain encoding of every document, round trips, and the commit."""

import json
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from captionflow.llm import token_files
from captionflow.llm.common import size_in_bytes
from captionflow.llm.packing import ids_of

from .helpers import AWKWARD, awkward, empty

SPECIAL = "a<|endoftext|> b"


@pytest.fixture(scope="module")
def plain():
    """The contract's call, for a list of texts."""
    import public_tokenizers as P
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def expected(docs, plain):
    """(doc_id, start, n, ids) of documents in order."""
    out, at = [], 0
    for doc, text in docs:
        ids = plain(text) + [0]
        out.append((doc, at, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


def test_query(spark, sf_small, plain):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect())
    got = E.queries()["op13_token_files"](spark, sf_small).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == \
        [(d, a, n, zlib.crc32(x)) for d, a, n, x in expected(docs, plain)]


def test_awkward(spark, plain, tmp_path):
    docs = [*AWKWARD, (30, SPECIAL), (31, SPECIAL + " 你好"), (-5, "negative"), (30, "again")]
    token_files.write_token_files(awkward(spark, docs), str(tmp_path / "a"), shard_tokens=5_000)
    got = sorted(token_files.read_token_files(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))  # null first
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    assert sorted((repr(r["doc_id"]), bytes(r["ids"])) for r in got) == \
        sorted((repr(d), x) for d, _, _, x in expected(docs, plain))
    manifest = json.loads((tmp_path / "a" / "manifest.json").read_text())
    assert manifest["tokens"] == at and len(manifest["shards"]) > 3
    token_files.write_token_files(empty(spark), str(tmp_path / "e"))
    assert token_files.read_token_files(spark, str(tmp_path / "e")).collect() == []


def test_files_are_flat_arrays(spark, plain, tmp_path):
    docs = [(3, "c c"), (1, "a"), (2, None)]
    token_files.write_token_files(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), str(tmp_path / "f"))
    listed = json.loads((tmp_path / "f" / "manifest.json").read_text())
    ids, docs_back, at = [], [], 0
    for s in listed["shards"]:
        assert s["first_token"] == at and s["first_doc"] == len(docs_back)
        part = np.memmap(tmp_path / "f" / f"{s['name']}.ids", "<u2", "r")
        off = np.fromfile(tmp_path / "f" / f"{s['name']}.off", "<u8")
        assert off[0] == 0 and off[-1] == len(part) == s["tokens"] and len(off) == s["docs"] + 1
        ids += part.tolist()
        docs_back += np.fromfile(tmp_path / "f" / f"{s['name']}.doc", "<i8").tolist()
        at += s["tokens"]
    assert docs_back == [1, 2, 3]
    assert ids == [*plain("a"), 0, 0, *plain("c c"), 0]


def test_wide_ids_and_overflow(spark, tmp_path):
    rows = spark.createDataFrame([(1, np.array([70_000, 0], "<u4").tobytes())], "doc_id long, ids binary").coalesce(1)
    spark.dataSource.register(token_files.TokenFiles)
    rows.write.format("token_files").mode("append").option("width", 4).save(str(tmp_path / "w"))
    assert bytes(token_files.read_token_files(spark, str(tmp_path / "w")).first()["ids"]) == np.array([70_000, 0], "<u4").tobytes()
    with pytest.raises(Exception, match="does not fit"):
        rows.write.format("token_files").mode("append").save(str(tmp_path / "n"))
    assert not any(x.startswith("shard-") for x in os.listdir(tmp_path / "n"))


def test_failed_tasks_leave_nothing_that_counts(spark, tmp_path):
    """A write that fails half-way leaves the old files readable and no shards of its own;
    replacing removes the old ones; a second append is refused."""
    path = str(tmp_path / "c")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    token_files.write_token_files(docs, path)
    before = sorted(os.listdir(path))
    broken = docs.withColumn("text", F.when(F.col("doc_id") == 40, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        token_files.write_token_files(broken, path, mode="overwrite")
    assert sorted(os.listdir(path)) == before
    assert token_files.read_token_files(spark, path).count() == 50
    with pytest.raises(Exception, match="holds token files"):
        token_files.write_token_files(docs, path)
    token_files.write_token_files(docs.where("doc_id < 10"), path, mode="overwrite")
    assert token_files.read_token_files(spark, path).count() == 10
    listed = json.loads((tmp_path / "c" / "manifest.json").read_text())
    assert len(os.listdir(path)) == 3 * len(listed["shards"]) + 1


def test_fast_and_exact_ids_agree(plain):
    """The fast path over every code point it is used for, alone and among others, and
    texts with the string of an added token."""
    of = ids_of("byte_bpe_50k")
    points = [chr(c) for c in range(0x250)]
    for c in points:
        for text in (c, f"a{c}b", f" {c} ", f"{c}{c}1{c}", f"x\n{c}\n\n {c}'s"):
            assert of(text) == plain(text), repr(text)
    joined = "".join(points)
    assert of(joined) == plain(joined) and of(joined[::-1]) == plain(joined[::-1])
    for text in (SPECIAL, "<|endoftext|>", f"é{SPECIAL}é", "<|endoftext", "你<|endoftext|>好"):
        assert of(text) == plain(text), text
    assert 50256 in of(SPECIAL)


def test_sizes():
    assert [size_in_bytes(x) for x in ("64m", "2147483647b", "4194304", "1g", "3kb", "-1")] == \
        [64 << 20, 2**31 - 1, 4194304, 1 << 30, 3 << 10, -1]
