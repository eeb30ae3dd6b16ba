"""Golden checks of state merges, sources and planning rules."""

import json

from pyspark.sql import functions as F

from captionflow.functions import scalars as S
from captionflow.operators import state as ST
from captionflow.sources import state_files as SF

COLS = "video_id string, ord long, publish_date string, title string, subtitle_downloaded boolean, " \
       "info_downloaded boolean, has_no_subtitle boolean, playlists array<string>"


def _rows(spark, rows):
    return spark.createDataFrame(rows, COLS)


def test_first_valid_value_wins(spark):
    df = _rows(spark, [("a", 1, "N/A", "Avulso", False, False, False, ["P1"]),
                       ("a", 2, "2024-01-02", "", True, False, False, ["P2", "P1"]),
                       ("a", 3, "2024-05-05", "Real", False, True, False, None),
                       ("b", 1, "", "", False, False, False, None)])
    m = {r.video_id: r for r in ST.dedup_state(df).collect()}
    assert (m["a"].publish_date, m["a"].title) == ("2024-01-02", "Real")
    assert (m["a"].subtitle_downloaded, m["a"].info_downloaded, m["a"].has_no_subtitle) == (True, True, False)
    assert m["a"].playlists == ["P1", "P2"]
    assert (m["b"].publish_date, m["b"].title, m["b"].playlists) == ("", "", None)   # first row's weak values


def test_merge_is_idempotent_and_order_free(spark):
    df = _rows(spark, [("a", i, d, t, i % 2 == 0, False, False, [f"P{i % 3}"])
                       for i, (d, t) in enumerate([("N/A", "N/A"), ("2024-01-01", "x"), ("2023-01-01", "y")] * 3)])
    once = sorted(tuple(r) for r in ST.dedup_state(df).collect())
    twice = sorted(tuple(r) for r in ST.dedup_state(ST.dedup_state(df)).collect())
    shuffled = sorted(tuple(r) for r in ST.dedup_state(df.repartition(5).orderBy("title")).collect())
    assert once == twice == shuffled


def test_partial_states_combine_in_any_split(spark):
    rows = [("a", i, d, t, False, i == 4, False, [f"P{i % 2}"])
            for i, (d, t) in enumerate([("N/A", "Avulso"), ("N/A", "T1"), ("2024-02-02", ""), ("2024-03-03", "T2"),
                                        ("N/A", "N/A")])]
    full = ST.dedup_state(_rows(spark, rows)).collect()[0]
    late, early = _rows(spark, rows[2:]), _rows(spark, rows[:2])
    parts = ST.combine_partials(ST.to_partial(late)).unionByName(ST.combine_partials(ST.to_partial(early)))
    got = ST.finalize_partial(ST.combine_partials(parts)).collect()[0]
    assert (got.publish_date, got.title, got.info_downloaded, got.playlists) == \
           (full.publish_date, full.title, full.info_downloaded, full.playlists)


def test_state_documents_both_shapes(spark):
    obj = json.dumps({"channel": "@c", "detected_language": "^pt$",
                      "videos": [{"video_id": "aaaaaaaaaaa", "title": "x"}, {"id": "bbbbbbbbbbb"}, {"title": "no id"}]})
    arr = json.dumps([{"id": "ccccccccccc", "publish_date": "2024-01-01"}])
    docs = spark.createDataFrame([(f"{SF.STATE_PREFIXES[0]}c.json", obj), (f"{SF.STATE_PREFIXES[1]}d.json", arr), ("bad.json", "{not json")],
                                 "path string, doc string")
    rows = sorted((r.path, r.pos, r.video_id, r.doc_channel) for r in SF.parse_state_documents(docs).collect())
    assert rows == sorted([
        (f"{SF.STATE_PREFIXES[0]}c.json", 0, "aaaaaaaaaaa", "@c"), (f"{SF.STATE_PREFIXES[0]}c.json", 1, "bbbbbbbbbbb", "@c"),
        (f"{SF.STATE_PREFIXES[1]}d.json", 0, "ccccccccccc", None)])


def test_video_info_rules(spark):
    docs = spark.createDataFrame([
        ("chan-abcdefghijk.info.json", json.dumps({"upload_date": "20240105", "fulltitle": "F", "channel": "C"})),
        ("chan-bcdefghijkl.info.json", json.dumps({"date": "yesterday"})),
        ("chan-cdefghijklm.info.json", "[1, 2]")], "name string, doc string")
    r = {x.video_id: x for x in SF.parse_video_info(docs).collect()}
    assert (r["abcdefghijk"].publish_date, r["abcdefghijk"].title, r["abcdefghijk"].uploader) == \
           ("2024-01-05", "F", "C")
    assert (r["bcdefghijkl"].publish_date, r["bcdefghijkl"].title, r["bcdefghijkl"].info_downloaded) == \
           ("yesterday", "Avulso", True)
    assert "cdefghijklm" not in r


def test_listing_dates(spark):
    df = spark.createDataFrame([("a", 1, None, "F", "20240102", None), ("b", 2, "", None, None, 1700000000),
                                ("c", 3, "T", None, "2024", None)],
                               "video_id string, ord long, title string, fulltitle string, upload_date string, "
                               "epoch_s long")
    r = {x.video_id: x for x in ST.listing_rows(df).collect()}
    assert (r["a"].publish_date, r["a"].title) == ("2024-01-02", "F")
    assert (r["b"].publish_date, r["b"].title) == ("2023-11-14", "N/A")
    assert r["c"].publish_date == "N/A"


def test_classify_input_kinds(spark):
    df = spark.createDataFrame([("https://youtu.be/abcdefghijk",), ("abcdefghijk",), ("playlist?list=PL1",),
                                ("@chan",), ("watch?v=abcdefghijk",)], "s string")
    got = [tuple(r.c) for r in df.select(S.classify_input("s").alias("c")).collect()]
    assert got == [("https://youtu.be/abcdefghijk", "video", "abcdefghijk"),
                   ("https://www.youtube.com/watch?v=abcdefghijk", "video", "abcdefghijk"),
                   ("https://www.youtube.com/playlist?list=PL1", "playlist", ""),
                   ("https://www.youtube.com/@chan", "channel", ""),
                   ("https://www.youtube.com/watch?v=watch?v=abcdefghijk", "video", "abcdefghijk")]


def test_detect_language_ties_and_sample(spark):
    tags = spark.createDataFrame([("c", 1, "pt-BR"), ("c", 2, "en"), ("c", 3, "NA"), ("c", 4, "pt"), ("c", 5, "en"),
                                  ("c", 6, "pt"), ("d", 1, "none")], "channel string, ord long, tag string")
    r = {x.channel: tuple(x)[1:] for x in ST.detect_language(tags).collect()}
    assert r["c"] == ("en", 2, 4)     # first 5 only; en (2 votes) beats pt-br and pt (1 each)
    assert r["d"] == ("pt", 0, 0)     # nothing valid: default


def test_plan_and_outcomes(spark):
    state = spark.createDataFrame([("a", "2024-01-30", True, False, False), ("b", "2024-01-01", False, False, False),
                                   ("c", "N/A", False, False, False), ("d", "2024-01-30", False, False, False)],
                                  "video_id string, publish_date string, subtitle_downloaded boolean, "
                                  "info_downloaded boolean, has_no_subtitle boolean")
    files = spark.createDataFrame([("d", "chan-d.pt.srt")], "video_id string, path string")
    plan = ST.plan_work(state, ST.files_present(files))
    assert {r.video_id: r.action for r in plan.collect()} == {"a": "skip_done", "b": "fetch", "c": "fetch",
                                                              "d": "convert"}
    out = spark.createDataFrame([("b", 0, False), ("c", 0, False)], "video_id string, exit_code int, has_caption boolean")
    res = {r.video_id: r for r in ST.apply_outcomes(plan, out, "2024-01-31").collect()}
    assert res["b"].outcome == "skipped" and res["b"].has_no_subtitle          # 30 days old
    assert res["c"].has_no_subtitle                                            # unknown date counts as old
    young = ST.apply_outcomes(plan, spark.createDataFrame([("b", 0, False)], out.schema), "2024-01-05").collect()
    assert not {r.video_id: r for r in young}["b"].has_no_subtitle            # 4 days old: retried later


def test_legacy_logs(spark):
    lines = spark.createDataFrame([("x/historico.txt", "youtube abcdefghijk"), ("historico.txt", "# note"),
                                   ("videos_sem_legenda.txt", "see https://www.youtube.com/watch?v=bcdefghijkl "),
                                   ("historico-info.txt", "  youtube cdefghijklm  ")], "file string, value string")
    got = sorted(tuple(r) for r in SF.parse_log_lines(lines).collect())
    assert got == [("info", "cdefghijklm"), ("no_subtitle", "bcdefghijkl"), ("subtitle", "abcdefghijk")]


def test_extract_id_modes(spark):
    df = spark.createDataFrame([("longfolder-abcdefghijk.pt",), ("chan-abcdefghijk-pt-BR",)], "s string")
    got = df.select(S.extract_video_id("s").alias("a"), S.extract_video_id("s", "leftmost").alias("b")).collect()
    assert [tuple(r) for r in got] == [("abcdefghijk", "longfolder-"), ("abcdefghijk", "chan-abcdef")]


def test_reverse_import_rules(spark):
    hist = spark.createDataFrame([("h1", "ch1", "@u1", "Someone"), ("h2", "chX", "@u1", "Other"),
                                  ("h3", "chY", "@uY", "The Handle Show"), ("s1", "ch1", "@u1", "x")],
                                 "video_id string, channel_id string, uploader_id string, uploader string")
    state = spark.createDataFrame([("s1",)], "video_id string")
    tgt = spark.createDataFrame([("ch1", "@u1")], "channel_id string, uploader_id string")
    got = sorted(r.video_id for r in ST.reverse_import(state, hist, tgt, "handle").collect())
    assert got == ["h1", "h2", "h3"]


def test_upsert_rewrites_only_the_buckets_it_hits(spark):
    """A listing of 1 % of the ids leaves the other buckets' files as they are; the table
    is the plain upsert's; an upsert that fails leaves it alone; again changes nothing."""
    import glob
    import os
    import tempfile
    import pytest
    from captionflow.plans.state_buckets import bucket_of, read_buckets, upsert_buckets, write_buckets
    path = os.path.join(tempfile.mkdtemp(prefix="buckets-", dir="/tmp"), "state")
    state = spark.range(500).selectExpr("concat('v', id) AS video_id", "id AS ord", "if(id % 3 = 0, 'N/A', concat('t', id)) AS title",
                                        "id % 5 = 0 AS subtitle_downloaded")
    write_buckets(state, path, 64)
    listing = spark.createDataFrame([("v3", 1, "new title"), ("v4", 2, "other"), ("v999", 3, "unseen"), ("v3", 4, "again")],
                                    "video_id string, ord long, title string")

    def files():
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/bucket=*/*.parquet")}
    before = files()
    with pytest.raises(Exception, match="lost"):
        upsert_buckets(spark, path, listing.withColumn("title", F.when(F.col("video_id") == "v999", F.raise_error(F.lit("lost")))), "PL", 64)
    assert files() == before
    hit = {r[0] for r in listing.select(bucket_of("video_id", 64)).distinct().collect()}
    for _ in range(2):
        rows = upsert_buckets(spark, path, listing, "PL", 64)
        assert {r.video_id: r.src for r in rows.where("video_id in ('v3', 'v4', 'v999')").collect()}["v3"] == "state"
        after = files()
        kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in hit}
        assert len(hit) <= 3 and {f: t for f, t in after.items() if f in kept} == {f: before[f] for f in kept}
        assert not (set(after) - kept) & set(before)
        want = ST.upsert_listing(state, listing, "PL").withColumn("ord", F.col("ord.ord")).drop("src")
        got = read_buckets(spark, path).select(*want.columns)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
