"""What must not grow with the input: buckets, broadcasts, what a commit and a listing hold."""

import contextlib
import io
import json
import os
import tempfile

from pyspark.sql import functions as F

from captionflow import session
from captionflow.plans.captions import CaptionTables


def folder(name):
    return tempfile.mkdtemp(prefix=f"{name}-", dir="/tmp")


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def some_cues(spark, videos=3, cues=40):
    rows = [(f"v{v}", "en", k, k * 20_000, k * 20_000 + 20_000, f"word{v} topic{k // 7} sentence number{k}.")
            for v in range(videos) for k in range(cues)]
    return spark.createDataFrame(rows, "video_id string, lang string, seq long, start_ms long, end_ms long, raw_text string")


def test_buckets_follow_the_input(spark):
    """A bucket's size is bounded whatever the number of shuffle partitions is."""
    df = spark.range(10)
    assert session.stage_buckets(df, 300 * session.BUCKET_BYTES) == 300 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.stage_buckets(df) == spark.sparkContext.defaultParallelism
    # a join's estimate is the product of its sides; what is read is their sum
    path = os.path.join(folder("sides"), "t")
    spark.range(20_000).write.parquet(path)
    one = spark.read.parquet(path)
    assert session.input_bytes(one.join(one.withColumnRenamed("id", "k"), one.id % 7 == F.col("k") % 7)) < 4 * session.input_bytes(one)


def test_staged_tables_join_bucket_by_bucket(spark):
    """No staged table is broadcast, however small its files are."""
    t = CaptionTables(some_cues(spark))
    for df in (t.keywords, t.stats, t.preview, t.sims, t.breaks, t.seg_list, t.paragraphs()):
        assert "BroadcastHashJoin" not in plan(df)
    t.cleanup()


def test_preview_over_several_windows(spark):
    from captionflow.operators.topics import segment_preview
    windows = spark.createDataFrame([("v", "en", 0, "the Alpha a beta"), ("v", "en", 1, None), ("v", "en", 2, "of"), ("v", "en", 3, " ".join(f"w{k}" for k in range(30))),
                                     ("v", "en", 4, "late"), ("u", "xx", 0, "de the")], "video_id string, lang string, win int, text string")
    segs = spark.createDataFrame([("v", w, 1) for w in range(5)] + [("u", 0, 1)], "video_id string, win int, seg long")
    got = {r.video_id: r.preview for r in segment_preview(windows, segs).collect()}
    assert got == {"v": "Alpha beta " + " ".join(f"w{k}" for k in range(10)) + "...", "u": "the"}
    short = {r.video_id: r.preview for r in segment_preview(windows.where("win <> 3"), segs).collect()}
    assert short["v"] == "Alpha beta late"


def test_commit_holds_lists_not_names(monkeypatch):
    """What a task tells the driver grows by a line for LISTED documents."""
    import pyarrow as pa

    from captionflow.sources import documents as D
    monkeypatch.setattr(D, "LISTED", 10)
    d = folder("docs")
    writer = D._DocumentWriter({"path": d, "run": "_writing-x"})
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{k:03d}" for k in range(95)]), pa.array([D.ROW] * 95, pa.int32()), pa.array(["x"] * 95)],
                                       ["file", "part", "piece"])
    told = writer.write(iter([batch]))
    assert len(told.lists) == 10
    writer.commit([told, None])
    names = [n for x in told.lists for n in json.load(open(f"{d}/_writing-x/{x}/names"))]
    assert names == [f"f{k:03d}" for k in range(95)] and not os.path.exists(f"{d}/f000")


def test_moves_can_be_made_again(spark):
    from captionflow.sources import documents as D
    d = folder("docs")
    os.makedirs(f"{d}/_w/a/0")
    json.dump(["x/one", "two"], open(f"{d}/_w/a/0/names", "w"))
    json.dump(["a/0"], open(f"{d}/_w/lists.json", "w"))
    for k in range(2):
        open(f"{d}/_w/a/0/{k}", "w").write(str(k))
    D._move_all(spark, d, "_w")
    D._move_all(spark, d, "_w")  # an attempt that comes again finds them moved
    assert open(f"{d}/x/one").read() == "0" and open(f"{d}/two").read() == "1"


def test_many_small_files_are_few_tasks(spark):
    from captionflow.sources.ranges import file_ranges
    d = folder("small")
    for k in range(300):
        open(f"{d}/{k}.json", "w").write('{"videos": []}' * 20)
    assert file_ranges(spark, d, ".json", 64).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_whole_files_by_address(spark):
    from captionflow.sources import state_files as SF
    from captionflow.sources.ranges import whole_files
    d = folder("info")
    for name in ("1/c-abcdefghijk.info.json", "1/_hidden.json", "2/c-bcdefghijkl.json", "2/deep/c-no-cdefghijklm.json", "c-defghijklmn.json", "2/empty.json"):
        os.makedirs(os.path.dirname(f"{d}/{name}"), exist_ok=True)
        open(f"{d}/{name}", "w").write("" if "empty" in name else '{"title": "é"}')

    def names(path):
        return sorted(r.name for r in whole_files(spark, path).collect())
    assert names(f"file://{d}/*") == ["c-abcdefghijk.info.json", "c-bcdefghijkl.json", "c-defghijklmn.json"]
    assert names(f"{d}/{{1,x}}/c-[a-c]*.json") == ["c-abcdefghijk.info.json"] and names(f"{d}/2") == ["c-bcdefghijkl.json"]
    assert names(f"{d}/c-defghijklmn.json") == ["c-defghijklmn.json"]
    assert sorted(r.video_id for r in SF.read_video_info(spark, f"{d}/[12]").collect()) == ["abcdefghijk", "bcdefghijkl"]


def test_a_ranges_scan_takes_little_memory():
    """Some bytes of memory for each byte of a range, and the same levels."""
    import tracemalloc

    import numpy as np

    from captionflow.sources.ranges import RANGE_BYTES, _levels
    plain = np.frombuffer(b'{"a": [1, "]"]}, ' * 60_000, np.uint8)
    tracemalloc.start()
    text, depth, after = _levels(plain, False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 * len(plain) and RANGE_BYTES * 16 * 4 < 1 << 30
    assert depth.tolist()[:17] == [1] * 6 + [2] * 7 + [1] + [0] * 3 and int(text[:17].sum()) == 4 and not after


def test_blocks_of_a_whole_file_are_those_of_its_lines():
    """The cut of a file of one range and the walk over lines give the same blocks."""
    import random

    from captionflow.sources.ranges import Bytes, range_blocks

    class File:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            return self.data[at:at + n]
    rng = random.Random(3)
    for _ in range(3_000):
        data = b"".join(rng.choice([b"\n", b"\r\n", b" ", b"\t", b"a", b"1 --> 2", b"\r", b"\xef\xbb\xbf"]) for _ in range(rng.randrange(1, 14)))
        n = len(data)
        walked = Bytes(File(data + b"\n\n"), n + 2, 0, n + 1)  # not the whole file: by lines
        assert list(range_blocks(Bytes(File(data), n, 0, n))) == list(range_blocks(walked)), data


def test_markdown_is_made_once(spark):
    """The fragments are made once for the sizes and the packs."""
    from captionflow.sources import sinks
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    rows = spark.createDataFrame([("en", f"v{k}", 0, 0, 0, "x") for k in range(50)],
                                 "lang string, video_id string, part int, seg long, para int, fragment string")
    sinks.write_markdown(rows.mapInArrow(count, rows.schema), os.path.join(folder("md"), "md"))
    assert seen.value == 50


def test_terms_are_sorted_once_and_not_by_window(spark):
    """Document frequency and the window before come from one sort by (video, term, window);
    cosines and keywords sort no terms by window and group no cues (F8-F14, F16, F18)."""
    from captionflow.operators import topics as T
    t = CaptionTables(some_cues(spark))
    terms = plan(T.window_terms(t.windows))
    assert terms.count("Sort [video_id") == 1 and "Exchange hashpartitioning" not in terms
    assert "Sort" not in plan(T.window_norms(t.terms))
    assert "Sort [video_id#" not in plan(t.sims)
    for df in (t.windows, t.keywords, t.preview, t.stats):
        assert "ObjectHashAggregate" not in plan(df)
    t.cleanup()


def test_weights_norms_and_cosines_of_terms(spark):
    import math

    from captionflow.operators import topics as T
    rows = [("v", "en", 0, "alpha alpha beta"), ("v", "en", 1, "alpha gamma"), ("v", "en", 2, "the of"), ("v", "en", 3, "alpha")]
    windows = spark.createDataFrame(rows, "video_id string, lang string, win int, text string")
    terms = T.window_terms(windows).cache()
    idf = {"alpha": math.log(5 / 4) + 1, "beta": math.log(5 / 2) + 1, "gamma": math.log(5 / 2) + 1}
    got = {(r.win, r.term): (r.tf, round(r.idf, 12), r.prev_tf) for r in terms.collect()}
    assert got == {(0, "alpha"): (2, round(idf["alpha"], 12), None), (0, "beta"): (1, round(idf["beta"], 12), None),
                   (1, "alpha"): (1, round(idf["alpha"], 12), 2), (1, "gamma"): (1, round(idf["gamma"], 12), None),
                   (3, "alpha"): (1, round(idf["alpha"], 12), None)}      # window 2 has no term: nothing before 3
    norms = T.window_norms(terms)
    length = {0: math.hypot(2 * idf["alpha"], idf["beta"]), 1: math.hypot(idf["alpha"], idf["gamma"])}
    weights = {(r.win, r.term): r.weight for r in T.tfidf(terms, norms).collect()}
    assert math.isclose(weights[0, "alpha"], 2 * idf["alpha"] / length[0]) and weights[3, "alpha"] == 1
    sims = {r.win: r.sim for r in T.adjacent_cosine(windows, norms).collect()}
    assert sims == {1: round(2 * idf["alpha"] ** 2 / length[0] / length[1], 9), 2: 0.0, 3: 0.0}


def test_fold_gives_the_windows(spark):
    """The windows of the fold's own columns are those grouped from its cues."""
    from captionflow.operators.captions import clean_and_window, window_text
    cues = some_cues(spark).unionByName(spark.createDataFrame(
        [("e", "pt", k, k * 1000, k * 1000 + 1000, "" if k < 70 else f"t{k}") for k in range(90)] + [("n", None, 0, 0, 1000, None)],
        "video_id string, lang string, seq long, start_ms long, end_ms long, raw_text string"))
    cols = ["video_id", "win", "lang", "start_ms", "end_ms", "n_cues", "text"]
    want = sorted(map(repr, window_text(clean_and_window(cues)).select(cols).collect()))
    fold = clean_and_window(cues, windows=True)
    assert sorted(map(repr, window_text(fold).select(cols).collect())) == want and len(want) > 3
    base = clean_and_window(cues)
    assert sorted(map(repr, fold.select(base.columns).collect())) == sorted(map(repr, base.collect()))


def test_keywords_of_few_terms(spark):
    from captionflow.operators.topics import segment_keywords, window_norms
    terms = spark.createDataFrame([("v", 0, "beta", 1, 1.0, None), ("v", 0, "alpha", 1, 1.0, None), ("v", 1, "gamma", 3, 1.0, None),
                                   ("v", 1, "delta", 1, 1.0, None), ("v", 1, "beta", 1, 1.0, 1), ("u", 0, "one", 1, 1.0, None), ("u", 0, "a1b", 9, 1.0, None)],
                                  "video_id string, win int, term string, tf long, idf double, prev_tf long")
    segs = spark.createDataFrame([("v", 0, 1), ("v", 1, 1), ("u", 0, 1)], "video_id string, win int, seg long")
    got = {r.video_id: r.keywords for r in segment_keywords(terms, window_norms(terms), segs).collect()}
    assert got == {"v": "beta · gamma · alpha", "u": "one"}


def test_markdown_paragraphs_are_not_dealt_again(spark):
    """Videos without a term go before the paragraph fold, not by a join with its output (F16, F18)."""
    cues = some_cues(spark).unionByName(spark.createDataFrame([("s", "en", 0, 0, 20_000, "the of and")], some_cues(spark).schema))
    t = CaptionTables(cues)
    videos = cues.select("video_id", F.col("video_id").alias("title"), F.lit("d").alias("publish_date")).distinct()
    md = t.markdown(videos)
    assert {r.video_id for r in md.select("video_id").distinct().collect()} == {"v0", "v1", "v2"}
    assert {r.video_id for r in t.paragraphs().select("video_id").distinct().collect()} == {"v0", "v1", "v2", "s"}
    body = [p for p in plan(md.where("part = 5 and para >= 0")).split("MapInPandas")]
    assert len(body) == 2 and "Exchange" not in body[0]
    t.cleanup()


def test_a_table_read_several_times_counts_once(spark):
    """Buckets follow the tables, not the number of scans a plan makes of them (F16)."""
    path = os.path.join(folder("again"), "t")
    spark.range(20_000).write.parquet(path)
    scans = [spark.read.parquet(path).where(F.col("id") % 5 == k) for k in range(4)]
    joined = scans[0].union(scans[1]).union(scans[2]).join(scans[3], "id", "left")
    assert session.input_bytes(joined) == session.input_bytes(spark.read.parquet(path))
    other = os.path.join(folder("again"), "t")
    spark.range(500).write.parquet(other)
    both = scans[0].union(spark.read.parquet(other))
    assert session.input_bytes(both) == session.input_bytes(scans[0]) + session.input_bytes(spark.read.parquet(other))


def test_terms_are_counted_in_their_window(spark):
    """No token is grouped by a hash of all keys of a task (F8-F14); counts are those of the text."""
    from collections import Counter

    from captionflow.operators import topics as T
    texts = {0: "b B a zz zz cc ZZ", 1: "", 2: "zz", 3: None, 4: "the cc the cc dd", 5: "x y z", 6: " ".join(f"w{k % 300}" for k in range(1000))}
    windows = spark.createDataFrame([("v", "en", w, 7, t) for w, t in texts.items()], "video_id string, lang string, win int, n_windows long, text string")
    terms = T.window_terms(windows)
    assert "HashAggregate" not in plan(terms)
    got = {(r.win, r.term): r.tf for r in terms.collect()}
    words = {w: Counter(x for x in (t or "").lower().split() if len(x) > 1 and x != "the") for w, t in texts.items()}
    assert got == {(w, x): n for w, c in words.items() for x, n in c.items()}
    assert dict(terms.dtypes)["tf"] == "bigint"


def test_cues_are_dealt_by_their_bytes(spark, monkeypatch):
    """Tasks that cut documents into cues follow the input, not the shuffle partitions (F8-F14)."""
    from captionflow.sources import fixtures as X
    path = os.path.join(folder("docs"), "d")
    spark.range(300).selectExpr("id doc_id", "'en' lang", "concat('One ', id, '. Two. Three') text").write.parquet(path)
    docs = spark.read.parquet(path)
    monkeypatch.setattr(session, "BUCKET_BYTES", session.input_bytes(docs) // 20)
    assert X.fx_cues(docs).rdd.getNumPartitions() >= 20 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert X.fx_cues(docs).count() == 900


def test_fold_over_batches(spark):
    """A window that is open over several batches gets its number and its text when it ends."""
    import pyarrow as pa

    from captionflow.operators.captions import _window_fold
    rows = [("a", "en", k, k * 10_000, k * 10_000 + 10_000, t, 30) for k, t in enumerate(["x", "", "x y", "z", "q", None, "", "", "", "p"])] \
        + [("b", "pt", 0, 0, 1_000, "", 30), ("b", "en", 1, 1_000, 2_000, "k", 30)]
    names = ["video_id", "lang", "seq", "start_ms", "end_ms", "txt", "window_s"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]

    def folded(n):
        batches = (pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:k + n]), types)], names) for k in range(0, len(rows), n))
        return [tuple(r.values()) for b in _window_fold("total", 0.5, True)(batches) for r in b.to_pylist()]
    assert folded(1) == folded(3) == folded(100)
    last = [(r[0], r[2], r[6:]) for r in folded(1) if r[9]]
    assert last == [("a", 3, (0, 0, 4, "x y z")), ("a", 6, (1, 30_000 + 10_000, 3, "q")), ("a", 9, (2, 70_000, 3, "p")), ("b", 1, (0, 0, 2, "k"))]
    assert [r[1] for r in folded(100)][-2:] == ["pt", "pt"]


def test_terms_and_keywords_as_lists(spark):
    """Terms are a row a window, counted, weighed and ranked without a row for a word (F1, F3,
    F4); what they give is what terms as rows give."""
    import random

    from captionflow.operators import topics as T
    rng = random.Random(5)
    words = ["alpha", "Beta", "the", "of", "x1", "zz", "ção", "été", "ab", "Ünder", "c_d", "日本語", "q"]
    rows = [(f"v{v}", rng.choice(["pt", "en", None]), w, w if v else 2 * w, rng.choice([None, "", *[" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(9)]]))
            for v in range(6) for w in range(30 if v else 1)]
    windows = spark.createDataFrame([(v, lang, w, 30, t) for v, lang, _, w, t in rows], "video_id string, lang string, win int, n_windows long, text string").repartition(3)
    segs = spark.createDataFrame([(r[0], r[3], r[3] // 4) for r in rows], "video_id string, win int, seg long")
    each, lists = T.window_terms(windows).cache(), T.window_terms(windows, lists=True)
    assert "Sort [video_id" in plan(lists) and "Generate" not in plan(lists) and "Join" not in plan(lists)
    per = {(r.video_id, r.win): r for r in T.window_norms(each).collect()}
    for r in T.window_norms(lists).collect():
        a = per.pop((r.video_id, r.win))
        assert abs(a.norm - r.norm) < 1e-12 and (a.dot is None) == (r.dot is None) and abs((a.dot or 0) - (r.dot or 0)) < 1e-12
    assert not per

    def weights(terms):
        return {(r.video_id, r.win, r.term): (r.tf, round(r.weight, 12)) for r in T.tfidf(terms, T.window_norms(terms)).collect()}
    assert weights(lists) == weights(each) and len(weights(each)) > 100

    def keywords(terms):
        return {(r.video_id, r.seg): r.keywords for r in T.segment_keywords(terms, T.window_norms(terms), segs).collect()}
    assert keywords(lists) == keywords(each) and len(keywords(each)) > 20


def test_groups_over_batches():
    """Groups are whole whatever the batches are, null keys too; an empty batch is none."""
    import pyarrow as pa

    from captionflow.operators.topics import by_groups
    rows = [(None, 0), (None, 1), ("a", 2), ("b", 3), ("b", 4), ("b", 5), ("b", 6), ("c", 7)]
    for size in (1, 2, 3, 100):
        parts = [[], *[rows[k:k + size] for k in range(0, len(rows), size)], []]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in p], pa.string()), pa.array([r[1] for r in p], pa.int64())], ["k", "x"]) for p in parts]
        got = []
        for table, group in by_groups(iter(batches), ("k",)):
            for g in sorted(set(group.tolist())):
                got.append([x for x, h in zip(table["x"].to_pylist(), group.tolist()) if h == g])
        assert got == [[0, 1], [2], [3, 4, 5, 6], [7]]


def test_digits_are_those_of_a_formatter(spark):
    from captionflow.functions import scalars as S
    d = spark.createDataFrame([(x,) for x in (None, -1234, -99, -10, -9, -1, 0, 5, 9, 10, 99, 100, 999, 1000)], "n long")
    assert d.filter(~(S.digits(F.col("n"), 2).eqNullSafe(F.format_string("%02d", "n")) & S.digits(F.col("n"), 3).eqNullSafe(F.format_string("%03d", "n")))).collect() == []


def test_keyword_scores_are_rounded_as_the_engine_rounds(spark):
    import numpy as np

    from captionflow.operators.topics import _rounded
    x = [0.0, 1.0, 0.1234567895, 0.1234567885, 2.5e-9, 0.5e-9, 1.9999999995, 12345.6789012345, 0.12345678949999, 3.3333333333333335]
    want = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double").select("k", F.round("x", 9).alias("r")).orderBy("k").collect()
    assert [round(r.r * 1e9) for r in want] == _rounded(np.array(x)).astype(int).tolist()


def test_metadata_files_are_few_at_a_time(spark, sf_small, monkeypatch):
    """The metadata documents are files some at a time, each read back, and then go (F2)."""
    from captionflow.plans import registry  # noqa: F401
    from captionflow.plans import registry_state as RS
    whole = sorted(map(repr, RS.q_read_video_info(spark, sf_small).collect()))
    seen, gone = [], RS.drop_documents

    def drop(s, path):
        here = "/" + path.removeprefix("file:").lstrip("/")
        seen.append(sum(len([x for x in files if x.endswith(".json")]) for _, _, files in os.walk(here)))
        gone(s, path)
        assert not os.path.exists(here)
    monkeypatch.setattr(RS, "drop_documents", drop)
    monkeypatch.setattr(RS, "INFO_FILES", 400)
    assert sorted(map(repr, RS.q_read_video_info(spark, sf_small).collect())) == whole
    n = RS._ev(spark, sf_small).count()
    assert len(seen) == -(-n // 400) > 1 and sum(seen) == n and max(seen) < 600


def test_cue_layout_is_matched_in_front_of_the_text(spark):
    """A block's layout is matched up to its times, not over its text (F3, F4); the cues are
    those of a match of the whole block."""
    import random
    import re

    from captionflow.sources import srt
    whole = re.compile(rf"(?s)^\s*\d+\s*\r?\n({srt._TIME}\s*-->\s*{srt._TIME})[^\n]*(?:\n(.*))?\Z", re.ASCII)
    rng = random.Random(7)
    parts = ["1", "\n", "\r\n", " ", "00:00:01,000 --> 00:00:02.500", "00:00:01,000", "-->", "é", "text", "\t", "0:00:00,000-->1:02:03,004", " pos:1", "日", "\r"]
    good = [f"{k}\n00:00:0{k},000 --> 00:00:09,00{k}{t}" for k, t in enumerate(["", "\n", "\r\n", "\na\r\nb\n", " x:1\nc\r\n", "\n\n", "\r\nd\r"])]
    blocks = good + ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(1500)] + [g + "".join(rng.choices(parts, k=4)) for g in good * 20]
    df = spark.createDataFrame([("v", k, b) for k, b in enumerate(blocks)], "video_id string, seq int, block string")
    got = {r.seq: (r.start_ms, r.end_ms, r.raw_text) for r in srt._cues(df, ("video_id",)).collect()}
    want = {}
    for k, b in enumerate(blocks):
        if m := whole.match(b):
            n = [int(x) for x in re.split(r"\s*-->\s*|[:.,]", m[1])]
            ms = [((n[i] * 60 + n[i + 1]) * 60 + n[i + 2]) * 1000 + n[i + 3] for i in (0, 4)]
            want[k] = (*ms, re.sub(r"\r?\n\Z", "", m[2] or "").replace("\r\n", "\n"))
    assert got == want and len(want) > 100
