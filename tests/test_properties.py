"""Properties: segment cover, block order, merge associativity under any split."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from captionflow.operators import blocks as B
from captionflow.operators import state as ST
from captionflow.plans.captions import CaptionTables
from captionflow.sources import fixtures as X

COLS = "video_id string, ord long, publish_date string, title string, subtitle_downloaded boolean, " \
       "info_downloaded boolean, has_no_subtitle boolean, playlists array<string>"


def test_segments_cover_windows_once(spark, sf_small):
    t = CaptionTables(X.fx_cues(X.table(spark, sf_small, "documents")))
    j = t.windows.select("video_id", "win").join(t.segs, ["video_id", "win"], "left")
    assert j.filter(F.col("seg").isNull()).count() == 0
    assert j.count() == t.windows.count() == t.segs.count()
    per = j.groupBy("video_id").agg(F.min("seg").alias("lo"), F.max("seg").alias("hi"),
                                    F.countDistinct("seg").alias("n")).collect()
    assert all(r.lo == 1 and r.hi == r.n for r in per)          # ids 1..n, no gaps
    from pyspark.sql import Window
    w = Window.partitionBy("video_id").orderBy("win")
    assert j.withColumn("p", F.lag("seg").over(w)).filter(F.col("seg") < F.col("p")).count() == 0


def test_blocks_follow_line_order(spark, sf_small):
    b = B.md_to_blocks(X.fx_md(X.table(spark, sf_small, "documents")))
    first = {(r.video_id, r.block_no): r.type for r in b.filter(F.col("block_no") <= 2).collect()}
    vids = {v for v, _ in first}
    assert all([first[(v, 0)], first[(v, 1)], first[(v, 2)]] == ["heading_2", "bulleted_list_item", "divider"]
               for v in vids)
    per = b.groupBy("video_id").agg(F.max("block_no").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.m == r.n - 1 for r in per)                     # dense numbering


row = st.tuples(st.sampled_from(["a", "b"]),
                st.sampled_from([None, "", "N/A", "2024-01-01", "2023-05-05"]),
                st.sampled_from([None, "", "N/A", "Avulso", "T1", "T2"]),
                st.booleans(), st.booleans(), st.booleans(),
                st.one_of(st.none(), st.lists(st.sampled_from(["P1", "P2", "P3"]), max_size=2)))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(row, min_size=1, max_size=8), cut=st.integers(min_value=0, max_value=8))
def test_partial_merge_equals_one_shot(spark, rows, cut):
    data = [(v, i, d, t, a, b, c, p) for i, (v, d, t, a, b, c, p) in enumerate(rows)]
    full = spark.createDataFrame(data, COLS)
    want = sorted(tuple(r) for r in ST.dedup_state(full).select(
        "video_id", "publish_date", "title", "subtitle_downloaded", "info_downloaded", "has_no_subtitle",
        "playlists").collect())
    left, right = data[:cut], data[cut:]
    parts = [ST.combine_partials(ST.to_partial(spark.createDataFrame(x, COLS))) for x in (right, left) if x]
    u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    got = sorted(tuple(r) for r in ST.finalize_partial(ST.combine_partials(u)).select(
        "video_id", "publish_date", "title", "subtitle_downloaded", "info_downloaded", "has_no_subtitle",
        "playlists").collect())
    assert got == want


def test_chunked_fold_equals_the_sequential_one(spark):
    """Rolling texts over few words, so that guesses are wrong at many starts and wrong
    again after a chunk is folded anew; gaps in time and in numbers; both clocks."""
    import random
    from captionflow.operators.captions import clean_and_window, clean_and_window_chunked
    rng = random.Random(8)
    rows = []
    for v in range(12):
        at, seq, words = 0, rng.randrange(3), ["a"]
        for _ in range(rng.choice((1, 5, 60, 200))):
            kind = rng.random()
            words = (words + [rng.choice("ab")] if kind < 0.6 else words if kind < 0.75 else [rng.choice("ab")] if kind < 0.95 else [])[-9:]
            start, at = at, at + rng.choice((200, 900, 4_000, 31_000))
            rows.append((f"v{v}", "en", seq, start, at, rng.choice((" ".join(words), f"<i>{' '.join(words)}</i>", " ")) if words else None))
            seq += rng.choice((1, 1, 1, 2, 7))
    cues = spark.createDataFrame(rows, "video_id string, lang string, seq long, start_ms long, end_ms long, raw_text string").repartition(5)
    for elapsed in ("total", "component"):
        want = sorted(map(repr, clean_and_window(cues, elapsed=elapsed).collect()))
        for chunk, warm in ((3, 0), (5, 2), (64, 8)):
            assert sorted(map(repr, clean_and_window_chunked(cues, elapsed, chunk_cues=chunk, warm_cues=warm).collect())) == want
    t = CaptionTables(cues, long_cues=50)
    assert sorted(map(repr, t.cue_windows.collect())) == sorted(map(repr, clean_and_window(cues).collect()))


def test_one_long_video_uses_several_tasks(spark):
    from captionflow.operators.captions import clean_and_window, clean_and_window_chunked
    cues = spark.range(0, 60_000, numPartitions=4).selectExpr(
        "'one' AS video_id", "'en' AS lang", "id AS seq", "id * 2000 AS start_ms", "id * 2000 + 1900 AS end_ms",
        "concat('w', id div 3, ' ', 'x', id, ' end') AS raw_text")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = clean_and_window_chunked(cues, chunk_cues=5_000)
        tasks = got.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 1
        cols = [F.count(F.lit(1)), F.sum(F.xxhash64("seq", "clean_text", "win").cast("decimal(38,0)"))]
        assert got.agg(*cols).first() == clean_and_window(cues).agg(*cols).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
