"""Documents read by byte ranges: the ranges cut anywhere, also inside strings, escapes,
names and timing lines, and the result is that of the whole file."""

import json
import os
import random
import tempfile

import pytest

from captionflow.sources import documents, srt, state_files as SF
from captionflow.sources.ranges import file_ranges, text_blocks

NASTY = ['plain', 'quote " here', 'back\\slash', 'end\\', '{"videos": [', ']}', '\\"videos\\": [{', '", "videos": [{"id": "x"}]', 'é😀  ',
         '\\\\"', '{', '[[', '', '"channel": "no"']


def folder(name):
    return tempfile.mkdtemp(prefix=f"{name}-", dir="/tmp")


def state_rows(spark, path, size):
    got = SF.read_channel_state(spark, path, range_bytes=size).collect()
    return sorted((os.path.basename(r.path), r.pos, r.video_id, r.title, r.doc_channel, r.detected_language,
                   tuple(r.playlists or ())) for r in got)


@pytest.mark.parametrize("size", [37, 256, 1 << 20])
def test_state_documents_in_ranges(spark, size):
    d, want, rng = folder("state"), [], random.Random(4)

    def put(name, doc, videos, channel, lang, **how):
        text = json.dumps(doc, ensure_ascii=rng.random() < 0.5, **how)
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            f.write(text)
        want.extend((name, k, v.get("video_id") or v.get("id"), v.get("title"), channel, lang, tuple(v.get("playlists") or ()))
                    for k, v in enumerate(videos) if v.get("video_id") or v.get("id"))
    videos = [{"video_id": f"v{k}", "title": rng.choice(NASTY), "playlists": rng.sample(NASTY, 2), "extra": {"videos": [{"id": "no"}]}}
              for k in range(60)]
    put("a.json", {"channel": "@a", "videos": videos, "detected_language": "pt"}, videos, "@a", "pt", indent=4)
    put("b.json", {"other": [{"id": "no"}], "meta": {"a": {"id": "no"}, "videos": [{"id": "no"}]}, "detected_language": None,
                   "channel": NASTY[7], "videos": videos[:7], "later": [{"video_id": "no"}]}, videos[:7], NASTY[7], None)
    put("c.json", [{"id": "first"}, {"title": "no id"}, *videos[:3]], [{"id": "first"}, {}, *videos[:3]], None, None, separators=(",", ":"))
    put("d.json", {"videos": [], "channel": "@empty"}, [], None, None)
    put("e.json", [], [], None, None)
    put("f.json", {"name": "in another shape", "list": [{"id": "no"}]}, [], None, None)
    with open(os.path.join(d, "cut.json"), "w") as f:  # breaks off
        f.write(json.dumps({"channel": "@cut", "videos": videos})[:-40])
    with open(os.path.join(d, "wide.json"), "w") as f:  # white space around everything
        f.write(' { "videos"' + " " * 700 + ":\n" + " " * 700 + '[ {"id" : "w"} ] , "channel"' + " " * 500 + ': "@w" } \n')
    want.append(("wide.json", 0, "w", None, "@w", None, ()))
    assert state_rows(spark, d, size) == sorted(want)


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_caption_blocks_in_ranges(spark, size):
    rng = random.Random(6)
    texts = {"empty-lines.srt": "\n\n \t\n1\n00:00:01,000 --> 00:00:02,000\na\n\n\n\n2\n00:00:03,000 --> 00:00:04,000\nb\nc",
             "crlf.srt": "﻿1\r\n00:00:01,000 --> 00:00:02,000\r\nx\r\n\r\n \r\nnot a block\r\n\r\n2\r\n00:00:02,500 --> 00:00:03,000\r\né\r\n\r\n",
             "blank.srt": " \n\t\n", "no-end.srt": "1\n00:00:00,000 --> 00:00:01,000",
             "many.srt": "\n\n".join(f"{k}\n00:00:{k % 60:02d},000 --> 00:00:{k % 60:02d},900\n" + "w" * rng.randrange(1, 200) for k in range(80))}
    d = folder("srt")
    for name, text in texts.items():
        with open(os.path.join(d, f"chan-abcdefgh{len(name):03d}.en.srt" if name == "many.srt" else name), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    got = sorted((os.path.basename(r.file), r.seq, r.block) for r in text_blocks(file_ranges(spark, d, ".srt", size)).collect())
    want = []
    for name, text in texts.items():
        own, blocks = [], []
        for line in text.removeprefix("﻿").split("\n"):
            if line.strip(" \t\r") or (line and not line.strip(" \t\r") and "\r" in line[:-1]):
                own.append(line)
            elif own:
                blocks.append("\n".join(own).removesuffix("\r"))
                own = []
        if own:
            blocks.append("\n".join(own).removesuffix("\r"))
        named = f"chan-abcdefgh{len(name):03d}.en.srt" if name == "many.srt" else name
        want += [(named, k, b) for k, b in enumerate(blocks)]
    assert got == sorted(want)
    whole = spark.createDataFrame([(n, t) for n, t in texts.items()], "video_id string, srt string").selectExpr("video_id", "'x' AS lang", "srt")
    cues = sorted((r.seq, r.start_ms, r.raw_text) for r in srt.parse_srt(whole).collect())
    assert cues == sorted((r.seq, r.start_ms, r.raw_text) for r in srt.read_cues(spark, d, range_bytes=size).collect())


def test_listing_lines_in_order_over_splits(spark):
    """A file larger than one split, without whole-text rows."""
    d = folder("listing")
    for name, n in (("a.jsonl", 3_000), ("b.jsonl", 7)):
        with open(os.path.join(d, name), "w") as f:
            f.writelines(json.dumps({"id": f"{name}{k}", "title": "t" * (k % 90)}) + "\n" for k in range(n))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = SF.read_listing(spark, d)
        assert df.rdd.getNumPartitions() > 5
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.video_id for r in sorted(rows, key=lambda r: tuple(r.ord))] == \
        [f"a.jsonl{k}" for k in range(3_000)] + [f"b.jsonl{k}" for k in range(7)]
    assert len({r.ord.block for r in rows}) > 3


def test_documents_are_replaced_whole(spark):
    """A write that fails half-way leaves the old documents and nothing else."""
    from pyspark.sql import functions as F
    d = os.path.join(folder("docs"), "out")
    pieces = spark.createDataFrame([("a.txt", 1, 0, "1"), ("a.txt", 2, 2, "]"), ("a.txt", 0, 0, "["), ("a.txt", 1, 1, "2"),
                                    ("sub/b c.txt", 1, 0, "only"), ("sub/b c.txt", 1, 1, None)], "file string, part int, k int, piece string")
    documents.write_documents(pieces, d, "k", separator=",")

    def text(name):
        with open(os.path.join(d, name), encoding="utf-8") as f:
            return f.read()
    assert text("a.txt") == "[1,2]" and text("sub/b c.txt") == "only," and sorted(os.listdir(d)) == ["a.txt", "sub"]
    many = spark.range(0, 200, numPartitions=8).select(F.concat(F.lit("f"), F.col("id") % 20).alias("file"), "id", F.col("id").cast("string").alias("piece"))
    broken = many.withColumn("piece", F.when(F.col("id") == 150, F.raise_error(F.lit("lost executor"))).otherwise(F.col("piece")))
    with pytest.raises(Exception, match="lost executor"):
        documents.write_documents(broken.union(spark.createDataFrame([("a.txt", 0, "new")], many.schema)), d, "id")
    assert text("a.txt") == "[1,2]" and sorted(os.listdir(d)) == ["a.txt", "sub"]
    documents.write_documents(many, d, "id", separator=" ")
    assert text("f7") == " ".join(str(k) for k in range(7, 200, 20)) and len(os.listdir(d)) == 22
