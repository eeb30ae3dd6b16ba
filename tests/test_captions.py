"""Golden and brute-force checks of the caption operators."""

import pytest
from pyspark.sql import Row

from captionflow.operators.captions import clean_and_window, strip_rollup_text, video_tiers, window_text
from captionflow.plans.captions import CaptionTables, segment_topics
from captionflow.sources import fixtures as X
from captionflow.sources.srt import parse_srt
from tests import bruteforce

SRT_PT = """1
00:00:01,000 --> 00:00:04,000
Olá pessoal, <i>bem-vindos</i>

2
00:00:03,500 --> 00:00:06,000
Olá pessoal, bem-vindos ao canal

3
00:00:06,000 --> 00:00:07,000

4
00:00:07,000 --> 00:00:40,500
hoje vamos falar
de economia

x
not a timing line
lost text

5
00:00:41.000 --> 01:00:02.250
<b>Então</b> é isso, né?
"""


def test_parse_srt_golden(spark):
    df = spark.createDataFrame([Row(video_id="abcdefghijk", lang="pt", srt=SRT_PT)])
    rows = sorted(parse_srt(df).collect(), key=lambda r: r.seq)
    assert [r.seq for r in rows] == [0, 1, 2, 3, 5]           # malformed block skipped, file order kept
    assert rows[0].start_ms == 1000 and rows[0].end_ms == 4000
    assert rows[2].raw_text == ""                               # empty cue
    assert rows[3].raw_text == "hoje vamos falar\nde economia"  # multi-line text
    assert rows[4].start_ms == 41000 and rows[4].end_ms == 3602250   # '.' separator accepted


def test_strip_rollup_rules():
    assert strip_rollup_text("a b c", []) == "a b c"
    assert strip_rollup_text("Olá pessoal bem-vindos ao canal", "Olá pessoal bem-vindos".split()) == ""
    assert strip_rollup_text("a b c d", ["a"]) == "b c d"
    assert strip_rollup_text("a  b", ["x"]) == "a b"          # re-joined when compared
    assert strip_rollup_text("", ["a"]) == ""


def test_fold_golden(spark):
    df = spark.createDataFrame([Row(video_id="abcdefghijk", lang="pt", srt=SRT_PT)])
    cw = {r.seq: r for r in clean_and_window(parse_srt(df)).collect()}
    assert cw[0].clean_text == "Olá pessoal, bem-vindos"
    assert cw[1].clean_text == ""            # 3 of 5 tokens repeat the kept cue: dropped
    assert cw[3].clean_text == "hoje vamos falar de economia"


@pytest.mark.parametrize("end_s,window,thr,mins", [
    (1199, 30, 0.25, 3), (1200, 30, 0.25, 5), (1799, 30, 0.25, 5), (1800, 60, 0.35, 5),
    (2399, 60, 0.35, 5), (2400, 60, 0.35, 7), (3599, 60, 0.35, 7), (3600, 90, 0.50, 10)])
def test_tier_boundaries(spark, end_s, window, thr, mins):
    cues = spark.createDataFrame([Row(video_id="v", lang="pt", seq=0, start_ms=0, end_ms=end_s * 1000 + 999,
                                      raw_text="x")])
    t = video_tiers(cues).collect()[0]
    assert (t.duration_s, t.window_s, t.threshold, t.min_segments) == (end_s, window, thr, mins)


def test_last_cue_in_file_order_sets_duration(spark):
    cues = spark.createDataFrame([Row(video_id="v", lang="pt", seq=0, start_ms=0, end_ms=4_000_000, raw_text="a"),
                                  Row(video_id="v", lang="pt", seq=1, start_ms=1000, end_ms=2000, raw_text="b")])
    assert video_tiers(cues).collect()[0].duration_s == 2


def test_stopword_only_video_is_rejected(spark):
    rows = [Row(video_id="s", lang="en", seq=i, start_ms=i * 40000, end_ms=i * 40000 + 39000,
                raw_text="the and of it is") for i in range(4)]
    t = CaptionTables(spark.createDataFrame(rows), materialize=False)
    assert [r.video_id for r in t.rejects.collect()] == ["s"]
    assert t.seg_list.count() == 0


def test_component_clock_parity(spark):
    """elapsed='component' reads only the 0-59 second part, like the reference."""
    rows = [Row(video_id="c", lang="en", seq=i, start_ms=i * 70000, end_ms=i * 70000 + 69000,
                raw_text=f"word{i} topic{i} thing{i}") for i in range(8)]
    cues = spark.createDataFrame(rows)
    total = {r.seq: r.win for r in clean_and_window(cues).collect()}
    comp = {r.seq: r.win for r in clean_and_window(cues, elapsed="component").collect()}
    assert [total[i] for i in range(8)] == list(range(8))      # 69 s > 30 s: every cue closes
    # 69, 139, 209 s -> 9, 19, 29; 279 -> 39 closes; the clock restarts at cue 3's start
    assert [comp[i] for i in range(8)] == [0, 0, 0, 0, 1, 1, 1, 2]


def test_window_text_drops_empty_windows(spark):
    rows = [Row(video_id="w", lang="en", seq=0, start_ms=0, end_ms=31000, raw_text="<i></i>"),
            Row(video_id="w", lang="en", seq=1, start_ms=31000, end_ms=70000, raw_text="hello there")]
    cw = clean_and_window(spark.createDataFrame(rows))
    wins = window_text(cw).collect()
    assert [(w.win, w.text) for w in wins] == [(0, "hello there")]
    assert {r.seq: r.win for r in cw.collect()} == {0: None, 1: 0}


def test_pipeline_equals_plain_python(spark, sf_small):
    """segment_topics on the whole sf0.001 fixture equals an independent loop."""
    cues = X.fx_cues(X.table(spark, sf_small, "documents"))
    expected = bruteforce.run_all([tuple(r) for r in cues.collect()])
    got = sorted(tuple(r) for r in segment_topics(cues).collect())
    assert got == expected


def test_result_independent_of_shuffle_partitions(spark, sf_small):
    cues = X.fx_cues(X.table(spark, sf_small, "documents"))
    a = sorted(tuple(r) for r in segment_topics(cues).collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        b = sorted(tuple(r) for r in segment_topics(cues).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b
